"""Audit logs, analytics, certificates, keys, rate limits and mail policy as relational queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.plans.policy import of_org

ACTIONS = ["LOGIN", "API_KEY_CREATED", "API_KEY_REVOKED", "FILE_MASK_TASK_STARTED", "TEXT_MASK", "CLOUD_SCAN_STARTED", "API_TEXT_MASK", "API_DATASET_SANITIZATION", "API_REALTIME_DLP_SCAN"]
RECENT = 100
WINDOW_SECONDS, KEY_LIMIT, IP_LIMIT = 60, 1000, 20
DETAILS = "detected array<string>"


def list_users(users: DataFrame, org_id: int | None) -> DataFrame:
    return of_org(users, org_id).select("id", "username", "role").orderBy("id")


def recent_logs(logs: DataFrame, users: DataFrame, org_id: int | None, n: int = RECENT) -> DataFrame:
    """The last n, with the user's name where known, else the id. The limit comes before the join: a top-n without a full sort."""
    last = of_org(logs, org_id).orderBy(F.desc("timestamp"), F.desc("id")).limit(n)
    named = last.join(users.select(F.col("id").alias("uid"), "username"), F.col("user_id") == F.col("uid"), "left")
    return named.select("id", "timestamp", "action", "ip_address", "details", F.coalesce("username", F.col("user_id").cast("string")).alias("user"))


def entity_analytics(logs: DataFrame, org_id: int | None) -> DataFrame:
    """(entity, events, percent): events whose details name the entity, and their part of the most frequent one's, rounded."""
    each = of_org(logs, org_id).select(F.explode(F.array_distinct(F.from_json("details", DETAILS)["detected"])).alias("entity"))
    counts = each.groupBy("entity").agg(F.count("*").alias("events"))
    top = F.max("events").over(Window.partitionBy())  # one row for each entity
    return counts.withColumn("percent", F.floor(F.col("events") * 100.0 / top + 0.5).cast("int")).orderBy(F.desc("events"), "entity")


def export_rows(logs: DataFrame, org_id: int | None) -> DataFrame:
    """The columns of the CSV export: all rows, ISO times, details as JSON or empty."""
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    return of_org(logs, org_id).select(
        F.col("id").alias("ID"), iso.alias("Timestamp"), F.col("user_id").alias("User ID"), F.col("action").alias("Action"),
        F.coalesce("ip_address", F.lit("")).alias("IP Address"), F.coalesce("details", F.lit("")).alias("Details"),
    )


def export_csv(logs: DataFrame, org_id: int | None, path: str) -> None:
    export_rows(logs, org_id).orderBy(F.desc("Timestamp"), F.desc("ID")).write.option("header", True).csv(path)


def certificate_counts(found: DataFrame, entity: str = "entity") -> DataFrame:
    """(entity, occurrences) and a Total; without any row, `No PII Detected` and a Total of 0."""
    counts = found.filter(F.col(entity).isNotNull()).rollup(entity).agg(F.count("*").alias("occurrences"), F.grouping(entity).alias("g"))
    rows = counts.select(F.when(F.col("g") == 1, "Total").otherwise(F.col(entity)).alias("entity"), "occurrences")
    blank = found.filter(F.col(entity).isNotNull()).limit(1).agg(F.count("*").alias("n")).filter("n = 0")
    none = blank.select(F.explode(F.array(F.lit("No PII Detected"), F.lit("Total"))).alias("entity"), F.lit(0).cast("long").alias("occurrences"))
    return rows.filter("entity <> 'Total' or occurrences > 0").unionByName(none)


def certificate_text(counts: list[tuple[str, int]], organisation: str, filename: str, audit_id: str, when: str) -> str:
    lines = [f"{filename} was scanned and de-identified on {when} on behalf of {organisation}.", "", "Entity Type\tOccurrences Removed"]
    return "\n".join([*lines, *(f"{e}\t{n}" for e, n in counts), "", f"Audit Tracking ID: {audit_id}"])


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def list_keys(keys: DataFrame, org_id: int | None) -> DataFrame:
    return of_org(keys, org_id).select("id", "name", "rate_limit", "is_active", "created_at").orderBy(F.desc("created_at"), "id")


def create_key(keys: DataFrame, org_id: int, key_id: str, name: str, secret: str, rate_limit: int = KEY_LIMIT) -> DataFrame:
    """keys with one more, of whose secret the hash is kept. The limit lies within 1 and a million."""
    if not 1 <= rate_limit <= 1_000_000:
        raise ValueError("rate limit out of bounds")
    row = keys.sparkSession.range(1).select(F.lit(key_id).alias("id"), F.lit(org_id).alias("org_id"), F.lit(name).alias("name"), key_hash(F.lit(secret)).alias("key_hash"), F.lit(rate_limit).alias("rate_limit"), F.lit(True).alias("is_active"), F.current_timestamp().cast("timestamp_ntz").alias("created_at"))
    return keys.unionByName(row)


def revoke_key(keys: DataFrame, org_id: int, key_id: str) -> DataFrame:
    """keys with one of the organisation's inactive; a missing one raises."""
    hit = (F.col("id") == key_id) & (F.col("org_id") == org_id)
    if keys.filter(hit).isEmpty():
        raise KeyError(key_id)
    return keys.withColumn("is_active", F.when(hit, False).otherwise(F.col("is_active")))


def verify_keys(requests: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """requests with key_id, org_id and rate_limit of the active key that their secret hashes to; null without one."""
    active = keys.filter("is_active").select(F.col("id").alias("key_id"), "org_id", "rate_limit", F.col("key_hash").alias("__hash"))
    return requests.withColumn("__hash", key_hash(F.col(key))).join(active, "__hash", "left").drop("__hash")


def rate_limited(requests: DataFrame, key: str, ts: str, limit: Column | int, order: str | None = None, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """requests with nth (in the key's fixed window) and limited. A null or blank key is never limited, a null or 0 limit is 1000."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    cap = F.coalesce(F.nullif(limit, F.lit(0)), F.lit(KEY_LIMIT))
    slot = F.floor(F.unix_timestamp(ts) / seconds)
    each = Window.partitionBy(key, slot).orderBy(ts, *([order] if order else []))
    out = requests.withColumn("nth", F.row_number().over(each))
    blank = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    return out.withColumn("limited", ~blank & (F.col("nth") > cap))


def window_counts(requests: DataFrame, key: str, ts: str, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(key, window_start, requests) of the fixed windows."""
    w = F.window(ts, f"{seconds} seconds")
    return requests.groupBy(key, w.alias("w")).agg(F.count("*").alias("requests")).select(key, F.col("w.start").alias("window_start"), "requests")


# Providers and disposable domains.
VERIFIED_PROVIDERS = (
    "gmail.com googlemail.com outlook.com outlook.in hotmail.com live.com msn.com office365.com "
    "yahoo.com yahoo.co.in yahoo.co.uk ymail.com rocketmail.com aol.com icloud.com me.com mac.com "
    "protonmail.com proton.me pm.me zoho.com fastmail.com hey.com gmx.com gmx.net web.de mail.com "
    "rediffmail.com tutanota.com runbox.com posteo.de mailfence.com startmail.com"
).split()
DISPOSABLE_DOMAINS = (
    "mailinator.com 10minutemail.com guerrillamail.com guerrillamail.net guerrillamail.org guerrillamail.biz "
    "tempmail.com temp-mail.org yopmail.com throwawaymail.com maildrop.cc mailnesia.com trashmail.com getnada.com "
    "sharklasers.com spam4.me moakt.com emailondeck.com mailcatch.com mintemail.com dropmail.me dispostable.com "
    "mailmetrash.com fakeinbox.com mohmal.com emlpro.com mytemp.email spambox.us tempinbox.com trashymail.com "
    "wegwerfmail.de meltmail.com maileater.com"
).split()
MAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]{2,}\z"


def mail_policy(df: DataFrame, mx: DataFrame, email: str = "email", verified: list[str] = VERIFIED_PROVIDERS, disposable: list[str] = DISPOSABLE_DOMAINS) -> DataFrame:
    """df with allowed and reason. mx(domain, has_mx) stands for name look-ups; a domain that it lacks has none."""
    clean = F.lower(F.trim(F.coalesce(F.col(email), F.lit(""))))
    rows = df.withColumn("__mail", clean).withColumn("__domain", F.substring_index(clean, "@", -1))
    rows = rows.join(mx.select(F.col("domain").alias("__domain"), "has_mx").dropDuplicates(["__domain"]), "__domain", "left")
    allowed_reason = (
        F.when(~F.col("__mail").rlike(MAIL), F.struct(F.lit(False).alias("a"), F.lit("invalid email format").alias("r")))
        .when(F.col("__domain").isin(disposable), F.struct(F.lit(False).alias("a"), F.lit("disposable email providers are not allowed").alias("r")))
        .when(F.col("__domain").isin(verified), F.struct(F.lit(True).alias("a"), F.lit("verified provider").alias("r")))
        .when(F.col("has_mx"), F.struct(F.lit(True).alias("a"), F.lit("verified via MX record").alias("r")))
        .otherwise(F.struct(F.lit(False).alias("a"), F.lit("email domain is not a verified provider and has no MX record").alias("r")))
    )
    return rows.withColumn("__x", allowed_reason).withColumns({"allowed": F.col("__x.a"), "reason": F.col("__x.r")}).drop("__x", "__mail", "__domain", "has_mx")


def assign_role(email: Column, admins: list[str], email_verified: Column | None = None) -> Column:
    """admin for those listed, else user; null (refused) without a mail address or where it is known to be unverified."""
    low = F.lower(F.trim(email))
    role = F.when(low.isin([a.strip().lower() for a in admins]), "admin").otherwise("user") if admins else F.lit("user")
    refused = email.isNull() | (F.trim(email) == "")
    if email_verified is not None:
        refused = refused | F.coalesce(~email_verified, F.lit(False))
    return F.when(~refused, role)


def audit_rows(results: DataFrame, action: str, org_id: int, types: str = "types") -> DataFrame:
    """The audit rows of results in which something was found."""
    found = results.filter(F.size(types) > 0)
    return found.select(F.lit(org_id).alias("org_id"), F.lit(action).alias("action"), F.current_timestamp().alias("timestamp"), F.to_json(F.struct(F.col(types).alias("detected"))).alias("details"))
