"""Policies of organisations as tables: what is active, what is missing, and how rows are created and changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.operators.engine import Policy, valid_pattern
from veilspark.operators.recognizers import DEFAULT_ENTITIES

DEFAULT_STYLE = "LABEL"

SCHEMAS = {
    "organizations": "id int, name string, slug string, plan string, created_at timestamp_ntz",
    "api_keys": "id string, org_id int, name string, key_hash string, rate_limit int, is_active boolean, created_at timestamp_ntz",
    "users": "id int, username string, hashed_password string, role string, is_active boolean, org_id int",
    "dlp_policies": "id int, org_id int, pii_type string, is_active boolean",
    "audit_logs": "id int, org_id int, user_id int, api_key_id string, action string, timestamp timestamp_ntz, ip_address string, details string",
    "custom_regex_policies": "id int, org_id int, name string, pattern string, is_active boolean",
    "system_settings": "id int, org_id int, masking_style string",
}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def migrate(df: DataFrame, name: str, default_org: int | None = None) -> DataFrame:
    """df with the table's columns that it lacks as nulls, and rows without an organisation given to default_org."""
    for f in df.sparkSession.createDataFrame([], SCHEMAS[name]).schema:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.withColumn("org_id", F.coalesce("org_id", F.lit(default_org))) if default_org is not None and "org_id" in df.columns else df


def of_org(df: DataFrame, org_id: int | None) -> DataFrame:
    """The organisation's rows; of none, all rows."""
    return df if org_id is None else df.filter(F.col("org_id") == org_id)


def adopted(policies: DataFrame, org_id: int) -> DataFrame:
    """The organisation's rows or, where it has none, the rows of no organisation as its own."""
    own = policies.filter(F.col("org_id") == org_id)
    shared = policies.filter("org_id is null").withColumn("org_id", F.lit(org_id).cast(policies.schema["org_id"].dataType))
    none = own.limit(1).agg(F.count("*").alias("n")).filter("n = 0")
    return own.unionByName(shared.crossJoin(F.broadcast(none)).drop("n"))


def missing_defaults(policies: DataFrame, entities: list[str] = DEFAULT_ENTITIES) -> DataFrame:
    """(pii_type, is_active) of the default entities that have no row."""
    defaults = policies.sparkSession.createDataFrame([(e, True) for e in entities], "pii_type string, is_active boolean")
    return defaults.join(policies.select("pii_type"), "pii_type", "left_anti")


def effective_policies(policies: DataFrame, org_id: int | None) -> DataFrame:
    """(pii_type, is_active): the organisation's or adopted rows, and the defaults that are missing.

    A missing default takes the state of the row of no organisation for its type, the first by id; without one it is active.
    """
    own = of_org(policies, None) if org_id is None else adopted(policies, org_id)
    own = own.select("pii_type", "is_active")
    missing = missing_defaults(own)
    if org_id is not None:
        shared = policies.filter("org_id is null").groupBy("pii_type").agg(F.min_by("is_active", "id").alias("shared"))
        missing = missing.join(shared, "pii_type", "left").select("pii_type", F.coalesce("shared", "is_active").alias("is_active"))
    return own.unionByName(missing)


def active_types(policies: DataFrame, org_id: int | None) -> DataFrame:
    return effective_policies(policies, org_id).filter("is_active").select("pii_type").distinct()


def masking_style(settings: DataFrame, org_id: int | None) -> str:
    """The first settings row's style, LABEL without one."""
    row = of_org(settings, org_id).orderBy("id").select("masking_style").first()
    return row[0] if row and row[0] else DEFAULT_STYLE


def custom_patterns(patterns: DataFrame, org_id: int | None) -> list[tuple[str, str]]:
    """Active patterns of the organisation, in order of id. They become expressions of the plan, so they are few."""
    return [(r["name"], r["pattern"]) for r in of_org(patterns, org_id).filter("is_active").orderBy("id").collect()]


def resolve_policy(policies: DataFrame, settings: DataFrame, patterns: DataFrame, org_id: int | None = None) -> Policy:
    """What the engine needs to know of an organisation, from its tables."""
    types = [r[0] for r in active_types(policies, org_id).collect()]
    return Policy(entities=sorted(types), style=masking_style(settings, org_id), custom=custom_patterns(patterns, org_id))


def upsert_policy(policies: DataFrame, changes: DataFrame) -> DataFrame:
    """policies after changes (org_id, pii_type, is_active): the organisation's row is set, else a row of no organisation is
    adopted and set, else a row is added. ids of added rows follow the largest in order of organisation and type."""
    c = changes.select(F.col("org_id").alias("o"), F.col("pii_type").alias("t"), F.col("is_active").alias("a"))
    own = policies.join(c, (F.col("org_id") == F.col("o")) & (F.col("pii_type") == F.col("t")), "left")
    kept = own.filter("org_id is not null").select("id", "org_id", "pii_type", F.coalesce("a", "is_active").alias("is_active"))
    open_ = c.join(policies.select("org_id", "pii_type"), (F.col("org_id") == F.col("o")) & (F.col("pii_type") == F.col("t")), "left_anti")
    # one change may adopt a row: of several organisations, the first
    first = open_.groupBy("t").agg(F.min_by(F.struct("o", "a"), "o").alias("x"))
    shared = policies.filter("org_id is null").join(first, F.col("pii_type") == F.col("t"), "left")
    shared = shared.select("id", F.col("x.o").alias("org_id"), "pii_type", F.coalesce("x.a", "is_active").alias("is_active"))
    new = open_.join(shared.select(F.col("org_id").alias("so"), F.col("pii_type").alias("st")), (F.col("o") == F.col("so")) & (F.col("t") == F.col("st")), "left_anti")
    top = policies.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    added = new.withColumn("i", F.row_number().over(Window.orderBy("o", "t"))).crossJoin(F.broadcast(top))
    added = added.select((F.col("top") + F.col("i")).cast("int").alias("id"), F.col("o").alias("org_id"), F.col("t").alias("pii_type"), F.col("a").alias("is_active"))
    return kept.unionByName(shared).unionByName(added)


def pattern_name(name: Column) -> Column:
    """Upper case, spaces as underscores."""
    return F.upper(F.translate(name, " ", "_"))


def create_pattern(patterns: DataFrame, org_id: int, name: str, pattern: str) -> DataFrame:
    """patterns with one more; a pattern that doesn't compile raises."""
    if not valid_pattern(pattern):
        raise ValueError(f"invalid pattern: {pattern}")
    top = patterns.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    row = top.select((F.col("top") + 1).cast("int").alias("id"), F.lit(org_id).alias("org_id"), pattern_name(F.lit(name)).alias("name"), F.lit(pattern).alias("pattern"), F.lit(True).alias("is_active"))
    return patterns.unionByName(row)


def delete_pattern(patterns: DataFrame, org_id: int, pattern_id: int) -> DataFrame:
    """patterns without one of the organisation's; a missing one is no error."""
    return patterns.filter(~((F.col("id") == pattern_id) & (F.col("org_id") == org_id)))


def set_style(settings: DataFrame, org_id: int, style: str) -> DataFrame:
    """settings with the organisation's style, added where it has no row. The style isn't checked."""
    changed = settings.withColumn("masking_style", F.when(F.col("org_id") == org_id, style).otherwise(F.col("masking_style")))
    top = settings.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"), F.count_if(F.col("org_id") == org_id).alias("n")).filter("n = 0")
    return changed.unionByName(top.select((F.col("top") + 1).cast("int").alias("id"), F.lit(org_id).alias("org_id"), F.lit(style).alias("masking_style")))


def default_org(organizations: DataFrame, slug: str = "default", name: str = "Default Organization") -> DataFrame:
    """organizations with the default one, added if its slug is missing."""
    top = organizations.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"), F.count_if(F.col("slug") == slug).alias("n")).filter("n = 0")
    row = top.select((F.col("top") + 1).cast("int").alias("id"), F.lit(name).alias("name"), F.lit(slug).alias("slug"), F.lit("free").alias("plan"), F.current_timestamp().cast("timestamp_ntz").alias("created_at"))
    return organizations.unionByName(row)


def health(spark: SparkSession) -> bool:
    return spark.sql("select 1").first()[0] == 1
