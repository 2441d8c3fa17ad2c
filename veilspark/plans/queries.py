"""The queries of the library over the driver's tables, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import checksums, persons
from veilspark.functions.language import ALIASES, COMMON_WORDS, SUPPORTED, resolve_language
from veilspark.functions.spans import mask_token, no_spans, replace_spans, resolve_overlaps
from veilspark.operators import documents as D
from veilspark.operators.engine import FAKE_FIRST, FAKE_LAST, Policy, detect, mask, sanitize, scan
from veilspark.operators.recognizers import DEFAULT_ENTITIES, PREVIEW, RECOGNIZERS, preview, recognize
from veilspark.plans import audit as A
from veilspark.plans import policy as P
from veilspark.sources import files as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


#: Bytes for each core up to which a table is dealt out before heavy work on each row.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table that may sit in fewer row groups than there are cores, dealt to all of them; a large one as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df


# ---- detection ------------------------------------------------------------------------------------------------

IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
#: The digits of m, from the right, every second doubled, add up to a multiple of ten.
LUHN_SQL = "(list_sum(list_transform(list_reverse(string_split(regexp_replace({m}, '[^0-9]', '', 'g'), '')), lambda c, i: CASE WHEN i % 2 = 0 THEN CASE WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END ELSE c::INT END)) % 10 = 0)"


def spans_sql(source: str, key: str, text: str, pattern: str, where: str = "true", columns: str = "value") -> str:
    return f"""
WITH t AS (SELECT {key}, regexp_extract_all({text}, '{_re(pattern)}') AS m, string_split_regex({text}, '{_re(pattern)}') AS g FROM {source}),
e AS (SELECT {key}, m, g, unnest(generate_series(1, len(m))) AS k FROM t WHERE len(m) > 0),
s AS (SELECT {key}, m[k] AS value,
  (list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0))::INT AS start FROM e)
SELECT {key}, start, (start + length(value))::INT AS "end", {columns} FROM s WHERE {where}"""


def found(df: DataFrame, key: str, text: Column, spans: Column) -> DataFrame:
    each = df.select(key, text.alias("__t"), F.explode(spans).alias("s"))
    value = F.substring(F.col("__t"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return each.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), value.alias("value"))


def _recognizer(entity: str):
    return next(r for r in RECOGNIZERS if r.entity == entity)


def _of_documents(entity: str, where: str = "true"):
    r = _recognizer(entity)

    @query(f"detect_{entity.lower()}", spans_sql("documents", "doc_id", "text", "(?ims)" + r.pattern, where))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
        return found(d, "doc_id", F.col("text"), recognize(F.col("text"), r))


_of_documents("EMAIL_ADDRESS")
_of_documents("PHONE_NUMBER")
_of_documents("CREDIT_CARD", "length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 12 AND 19 AND " + LUHN_SQL.format(m="value"))


@query("detect_custom_regex", spans_sql("documents", "doc_id", "text", IPV4))
def detect_custom_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Policy(entities=[], custom=[("IPV4", IPV4), ("BROKEN", "(")])
    return found(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", F.col("text"), detect(F.col("text"), p))


MASKED = Policy(entities=["EMAIL_ADDRESS", "CREDIT_CARD"], custom=[("IPV4", IPV4)])
CARD, MAIL = "(?ims)" + _recognizer("CREDIT_CARD").pattern, "(?ims)" + _recognizer("EMAIL_ADDRESS").pattern
#: Cards, addresses and IPv4 numbers never overlap here, so they are replaced one after another.
MASK_SQL = """
WITH c AS (SELECT doc_id, text, regexp_extract_all(text, '{card}') AS m, string_split_regex(text, '{card}') AS g,
  len(regexp_extract_all(text, '{mail}')) AS n_mail, len(regexp_extract_all(text, '{ip}')) AS n_ip FROM documents),
v AS (SELECT *, list_transform(m, lambda x: {luhn}) AS ok FROM c),
r AS (SELECT *, len(list_filter(ok, lambda x: x)) AS n_card,
  array_to_string(list_transform(generate_series(1, len(g)), lambda i: g[i] || CASE WHEN i > len(m) THEN '' WHEN ok[i] THEN '{tcard}' ELSE m[i] END), '') AS carded FROM v)
SELECT doc_id, (n_card + n_mail + n_ip) > 0 AS found, (n_card + n_mail + n_ip)::INT AS matches,
  array_to_string(list_filter([CASE WHEN n_card > 0 THEN 'CREDIT_CARD' END, CASE WHEN n_mail > 0 THEN 'EMAIL_ADDRESS' END, CASE WHEN n_ip > 0 THEN 'IPV4' END], lambda x: x IS NOT NULL), ',') AS types,
  regexp_replace(regexp_replace(carded, '{mail}', '{tmail}', 'g'), '{ip}', '{tip}', 'g') AS redacted FROM r"""


def _masking(style: str) -> None:
    token = {"BLACKOUT": "█" * 8, "ASTERISK": "***"}.get(style)
    tokens = {t: token or f"[{e}_MASKED]" for t, e in (("tcard", "CREDIT_CARD"), ("tmail", "EMAIL_ADDRESS"), ("tip", "IPV4"))}
    sql = MASK_SQL.format(card=_re(CARD), mail=_re(MAIL), ip=_re(IPV4), luhn=LUHN_SQL.format(m="x"), **tokens)

    @query(f"mask_{style.lower()}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = Policy(entities=MASKED.entities, custom=MASKED.custom, style=style)
        m = mask(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), policy=p)
        return m.select("doc_id", "found", "matches", F.array_join("types", ",").alias("types"), "redacted")


for _style in ("LABEL", "BLACKOUT", "ASTERISK"):
    _masking(_style)


@query(
    "scan_action",
    f"""
WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '{_re(MAIL)}')) AS a, len(regexp_extract_all(text, '{_re(IPV4)}')) AS b FROM documents)
SELECT doc_id, CASE WHEN a + b > 0 THEN 'BLOCK' ELSE 'ALLOW' END AS action, (a + b)::INT AS count,
  concat_ws(',', CASE WHEN a > 0 THEN 'EMAIL_ADDRESS' END, CASE WHEN b > 0 THEN 'IPV4' END) AS types FROM c""",
)
def scan_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Policy(entities=["EMAIL_ADDRESS"], custom=[("IPV4", IPV4)])
    return scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), policy=p).select("doc_id", "action", "count", F.array_join("types", ",").alias("types"))


@query("mask_all_entities")
def mask_all_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sixteen entities at once: without SQL, as lookaheads have none there; its parts are tested against loops and vectors."""
    m = mask(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return m.select("doc_id", "found", "matches", F.array_join("types", ",").alias("types"), "redacted")


@query(
    "heatmap_preview",
    "WITH "
    + ", ".join(
        f"r{i} AS (SELECT doc_id, start, \"end\", {i} AS rank, '{n}' AS name, '{lv}' AS level FROM ({spans_sql('documents', 'doc_id', 'text', p)}))" for i, (n, p, lv) in enumerate(PREVIEW)
    )
    + ", u AS ("
    + " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(len(PREVIEW)))
    + ") SELECT doc_id, start, \"end\", name, level FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, start, \"end\" ORDER BY rank) = 1",
)
def heatmap_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(preview(F.col("text"))).alias("s"))
    return d.select("doc_id", "s.start", "s.end", "s.name", "s.level")


# ---- overlaps -------------------------------------------------------------------------------------------------


@query(
    "overlap_resolve",
    """
WITH RECURSIVE s AS (
  SELECT l_orderkey AS k, l_linenumber AS src, (l_partkey % 40)::INT AS a, (l_partkey % 40 + 1 + l_suppkey % 15)::INT AS b, l_quantity AS score,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 40, -(l_partkey % 40 + 1 + l_suppkey % 15), -l_quantity, l_linenumber) AS i FROM lineitem),
f AS (
  SELECT k, i, b AS last, score AS best, [a || '-' || b || '-' || src] AS kept FROM s WHERE i = 1
  UNION ALL
  SELECT s.k, s.i, CASE WHEN s.a >= f.last OR (s.b > f.last AND s.score > f.best) THEN s.b ELSE f.last END,
    CASE WHEN s.a >= f.last OR (s.b > f.last AND s.score > f.best) THEN s.score ELSE f.best END,
    CASE WHEN s.a >= f.last THEN list_append(f.kept, s.a || '-' || s.b || '-' || s.src)
         WHEN s.b > f.last AND s.score > f.best THEN list_append(f.kept[1:-2], s.a || '-' || s.b || '-' || s.src) ELSE f.kept END
  FROM f JOIN s ON s.k = f.k AND s.i = f.i + 1)
SELECT k AS l_orderkey, array_to_string(arg_max(kept, i), ' ') AS kept FROM f GROUP BY k""",
)
def overlap_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("l_partkey") % 40).cast("int")
    span = F.struct(start.alias("start"), (start + 1 + F.col("l_suppkey") % 15).cast("int").alias("end"), F.lit("X").alias("entity_type"), F.col("l_quantity").cast("double").alias("score"), F.col("l_linenumber").cast("int").alias("src"))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(span).alias("spans"))
    shown = F.transform(resolve_overlaps(F.col("spans")), lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"), s["src"].cast("string")))
    return g.select("l_orderkey", F.array_join(shown, " ").alias("kept"))


# ---- check digits ---------------------------------------------------------------------------------------------


def _sum_sql(value: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"{w} * substr({value}, {i + 1}, 1)::INT" for i, w in enumerate(weights)) + ")"


def _derived(name: str, value: Callable[[], Column], value_sql: str, valid: Callable[[Column], Column], valid_sql: str) -> None:
    @query(f"valid_{name}", f"WITH v AS (SELECT o_orderkey, {value_sql} AS value FROM orders) SELECT o_orderkey, value, coalesce({valid_sql}, false) AS valid FROM v")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = table(spark, sf_dir, "orders").select("o_orderkey", value().alias("value"))
        return v.withColumn("valid", valid(F.col("value")))


def _pad(n: int, times: int = 1) -> tuple[Callable[[], Column], str]:
    return lambda: F.lpad((F.col("o_orderkey") * times).cast("string"), n, "0"), f"lpad((o_orderkey * {times})::VARCHAR, {n}, '0')"


_d = lambda i: f"substr(value, {i}, 1)::INT"
_derived("routing_number", *_pad(9), checksums.is_valid_routing_number, _sum_sql("value", [3, 7, 1] * 3) + " % 10 = 0")
_derived("npi", *_pad(10, 7919), checksums.is_valid_npi, LUHN_SQL.format(m="'80840' || value"))
_derived(
    "cpf", *_pad(11, 104729), checksums.is_valid_cpf,
    f"length(regexp_replace(value, substr(value, 1, 1), '', 'g')) > 0 AND {_sum_sql('value', list(range(10, 1, -1)))} * 10 % 11 % 10 = {_d(10)} AND {_sum_sql('value', list(range(11, 1, -1)))} * 10 % 11 % 10 = {_d(11)}",
)
_cnpj = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
_derived(
    "cnpj", *_pad(14, 15485863), checksums.is_valid_cnpj,
    f"length(regexp_replace(value, substr(value, 1, 1), '', 'g')) > 0 AND CASE WHEN {_sum_sql('value', _cnpj)} % 11 < 2 THEN 0 ELSE 11 - {_sum_sql('value', _cnpj)} % 11 END = {_d(13)}"
    f" AND CASE WHEN {_sum_sql('value', [6, *_cnpj])} % 11 < 2 THEN 0 ELSE 11 - {_sum_sql('value', [6, *_cnpj])} % 11 END = {_d(14)}",
)
_product, _powers = checksums._verhoeff()
_derived(
    "aadhaar", *_pad(12, 1299709), checksums.is_valid_aadhaar,
    f"list_reduce(list_prepend(0, list_transform(list_reverse(string_split(value, '')), lambda c, i: {_powers}[(i - 1) % 8 + 1][c::INT + 1])), lambda s, x: {_product}[s + 1][x + 1]) = 0",
)
_derived(
    "iban",
    lambda: F.concat(F.lit("DE"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lpad(F.col("o_orderkey").cast("string"), 18, "0")),
    "'DE' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || lpad(o_orderkey::VARCHAR, 18, '0')",
    checksums.is_valid_iban,
    "(substr(value, 5) || '1314' || substr(value, 3, 2))::HUGEINT % 97 = 1",
)


def _letter(m: int) -> Column:
    return F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.floor(F.col("o_orderkey") / m) % 26 + 1).cast("int"), F.lit(1))


def _pan(last: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: F.concat(*[_letter(m) for m in (1, 3, 7, 11, 13)], F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"), last())


_letters_sql = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', (o_orderkey // {m} % 26 + 1)::INT, 1)" for m in (1, 3, 7, 11, 13))
_derived(
    "pan",
    _pan(lambda: _letter(2)),
    _letters_sql + " || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', (o_orderkey // 2 % 26 + 1)::INT, 1)",
    checksums.is_valid_pan,
    "substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', (list_sum(list_transform(string_split(substr(value, 1, 9), ''), lambda c, i: i * (instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1))) % 36 + 1)::INT, 1) = substr(value, 10, 1)",
)

#: country -> (digits of the derived number, SQL of its check)
VAT_SQL = {
    "DE": (9, f"list_reduce(list_prepend(10, list_transform(string_split(substr(value, 1, 8), ''), lambda c: c::INT)), lambda p, x: CASE WHEN (p + x) % 10 = 0 THEN 10 ELSE (p + x) % 10 END * 2 % 11) + {_d(9)}", " % 10 = 1"),
    "DK": (8, _sum_sql("value", [2, 7, 6, 5, 4, 3, 2, 1]), " % 11 = 0"),
    "FI": (8, _sum_sql("value", [7, 9, 10, 5, 8, 4, 2, 1]), " % 11 = 0"),
    "GB": (9, _sum_sql("value", [8, 7, 6, 5, 4, 3, 2, 10, 1]), " % 97 IN (0, 42)"),
    "HU": (8, _sum_sql("value", [9, 7, 3, 1, 9, 7, 3, 1]), " % 10 = 0"),
    "LU": (8, "substr(value, 1, 6)::INT", " % 89 = substr(value, 7, 2)::INT"),
    "MT": (8, _sum_sql("value", [3, 4, 6, 7, 8, 9, 10, 1]), " % 37 = 0"),
    "PL": (10, _sum_sql("value", [6, 5, 7, 2, 3, 4, 5, 6, 7, -1]), " % 11 = 0"),
    "PT": (9, f"(11 - {_sum_sql('value', list(range(9, 1, -1)))} % 11) % 11 % 10", f" = {_d(9)}"),
    "EE": (9, _sum_sql("value", [3, 7, 1] * 3), " % 10 = 0"),
    "EL": (9, "list_reduce(list_prepend(0, list_transform(string_split(substr(value, 1, 8), ''), lambda c: c::INT)), lambda s, x: 2 * s + x) * 2 % 11 % 10", f" = {_d(9)}"),
}
#: Numbers whose digits vary throughout, of n digits.
_vat_sql = " UNION ALL ".join(
    f"SELECT o_orderkey, '{cc}' AS country, value, coalesce(({a}){b}, false) AS valid FROM (SELECT o_orderkey, right(lpad((o_orderkey * 7654321)::VARCHAR, {n}, '0'), {n}) AS value FROM orders)" for cc, (n, a, b) in VAT_SQL.items()
)


@query("valid_vat", _vat_sql)
def valid_vat(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey"))
    values = F.array(*[F.struct(F.lit(cc).alias("country"), F.expr(f"right(lpad(cast(o_orderkey * 7654321 as string), {n}, '0'), {n})").alias("value")) for cc, (n, *_) in VAT_SQL.items()])
    v = o.select("o_orderkey", F.explode(values).alias("x")).select("o_orderkey", "x.country", "x.value")
    return v.withColumn("valid", checksums.is_valid_vat(F.concat("country", "value")))


def _sum_of(value: str, digits: list[tuple[int, int]]) -> str:
    """Sum of weight times digit over (weight, place)."""
    return "(" + " + ".join(f"{w} * substr({value}, {i}, 1)::INT" for w, i in digits) + ")"


def _doubled_sql(first: int, odd: int) -> str:
    """Seven digits from a place on, every second doubled and its digits added."""
    digit = lambda i: f"substr(value, {first + i}, 1)::INT"
    return "(" + " + ".join(f"CASE WHEN {digit(i)} > 4 THEN 2 * {digit(i)} - 9 ELSE 2 * {digit(i)} END" if i % 2 == odd else digit(i) for i in range(7)) + ")"


def _rounds_sql(n: int, first: list[int], second: list[int]) -> str:
    a, b = _sum_sql("value", first), _sum_sql("value", second)
    return f"CASE WHEN {a} % 11 = 10 THEN {b} % 11 % 10 ELSE {a} % 11 END = {_d(n)}"


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_cy = " + ".join([f"[1, 0, 5, 7, 9, 13, 15, 17, 19, 21][{_d(i)} + 1]" if i % 2 else _d(i) for i in range(1, 9)])
_iso = lambda n: f"({VAT_SQL['DE'][1]})".replace("1, 8)", f"1, {n - 1})").replace(_d(9), _d(n)) + " % 10 = 1"
#: (country, derived number of digits {n}, SQL of its check): the prefixes with letters or two shapes.
VAT_MORE = [
    ("AT", "'U' || {8}", f"((6 - {_doubled_sql(2, 1)}) % 10 + 10) % 10 = {_d(9)}"),
    ("BE", "{10}", "(substr(value, 1, 8)::INT + substr(value, 9, 2)::INT) % 97 = 0"),
    ("BG", "{9}", _rounds_sql(9, list(range(1, 9)), list(range(3, 11)))),
    ("CY", f"{{8}} || substr({_AZ}, cast(o_orderkey % 26 as int) + 1, 1)", f"substr({_AZ}, (({_cy}) % 26 + 1)::INT, 1) = substr(value, 9, 1)"),
    ("CZ", "{9}", "true"),
    ("SK", "{10}", "true"),
    ("HR", "{11}", _iso(11)),
    ("ES", "'B' || {8}", f"(10 - {_doubled_sql(2, 0)} % 10) % 10 = {_d(9)}"),
    ("ES", "{8} || substr('TRWAGMYFPDXBNJZSQVHLCKE', cast(o_orderkey % 23 as int) + 1, 1)", "substr('TRWAGMYFPDXBNJZSQVHLCKE', substr(value, 1, 8)::INT % 23 + 1, 1) = substr(value, 9, 1)"),
    ("FR", "{11}", LUHN_SQL.format(m="substr(value, 3)") + " AND (substr(value, 3)::BIGINT * 100 + 12) % 97 = substr(value, 1, 2)::INT"),
    ("IE", "{7} || substr('ABCDEFGHIJKLMNOPQRSTUVW', cast(o_orderkey % 23 as int) + 1, 1)", f"substr('WABCDEFGHIJKLMNOPQRSTUV', {_sum_sql('value', list(range(8, 1, -1)))} % 23 + 1, 1) = substr(value, 8, 1)"),
    ("IT", "{11}", LUHN_SQL.format(m="value")),
    ("LT", "{9}", _rounds_sql(9, list(range(1, 9)), [3, 4, 5, 6, 7, 8, 9, 1])),
    ("LT", "{12}", _rounds_sql(12, [1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2], [3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4])),
    ("LV", "{11}", _sum_sql("value", [9, 1, 4, 8, 3, 10, 2, 5, 7, 6, 1]) + " % 11 = 3"),
    ("NL", "{9} || 'B01'", f"({_sum_sql('value', list(range(9, 1, -1)))} - {_d(9)}) % 11 = 0 OR ('2321' || substr(value, 1, 9) || '11' || '01')::HUGEINT % 97 = 1"),
    ("RO", "{10}", f"{_sum_sql('value', [7, 5, 3, 2, 1, 7, 5, 3, 2])} * 10 % 11 % 10 = {_d(10)}"),
    ("SE", "{10} || '01'", LUHN_SQL.format(m="substr(value, 1, 10)")),
    ("SI", "{8}", f"{_sum_sql('value', list(range(8, 1, -1)))} % 11 <> 0 AND (11 - {_sum_sql('value', list(range(8, 1, -1)))} % 11) % 10 = {_d(8)}"),
]


def _vat_value(template: str, text_type: str) -> str:
    import re

    return re.sub(r"\{(\d+)\}", lambda m: f"right(lpad(cast(o_orderkey * 7654321 as {text_type}), {m[1]}, '0'), {m[1]})", template)


@query(
    "valid_vat_letters",
    " UNION ALL ".join(f"SELECT o_orderkey, '{cc}' AS country, value, coalesce({check}, false) AS valid FROM (SELECT o_orderkey, {_vat_value(value, 'varchar')} AS value FROM orders)" for cc, value, check in VAT_MORE),
)
def valid_vat_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey"))
    values = F.expr("array(" + ", ".join(f"named_struct('country', '{cc}', 'value', {_vat_value(value, 'string')})" for cc, value, _ in VAT_MORE) + ")")
    v = o.select("o_orderkey", F.explode(values).alias("x")).select("o_orderkey", "x.country", "x.value")
    return v.withColumn("valid", checksums.is_valid_vat(F.concat("country", "value")))


def _in_sentence(entity: str, value: Callable[[], Column], value_sql: str, where: str = "true", pattern: str | None = None) -> None:
    """The entity found in a sentence around a value made from an order's key."""
    r = _recognizer(entity)
    source = f"(SELECT o_orderkey, 'Ref ' || {value_sql} || ' given, see below.' AS text FROM orders)"

    @query(f"detect_{entity.lower()}", spans_sql(source, "o_orderkey", "text", pattern or "(?ims)" + r.pattern, where))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = F.concat(F.lit("Ref "), value(), F.lit(" given, see below."))
        d = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
        return found(d, "o_orderkey", F.col("text"), recognize(F.col("text"), r))


_key_sql = "o_orderkey::VARCHAR"


def _key() -> Column:
    return F.col("o_orderkey").cast("string")


_in_sentence("MEDICAL_RECORD_NUMBER", lambda: F.concat(F.lit("mrn-"), F.lpad(_key(), 6, "0")), f"'mrn-' || lpad({_key_sql}, 6, '0')")
_in_sentence(
    "ICD10_CODE", lambda: F.concat(F.substring(F.lit("EFSU9"), (F.col("o_orderkey") % 5 + 1).cast("int"), F.lit(1)), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit("."), (F.col("o_orderkey") % 1000).cast("string")),
    "substr('EFSU9', (o_orderkey % 5 + 1)::INT, 1) || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || '.' || (o_orderkey % 1000)::VARCHAR",
)
_in_sentence(
    "HEALTH_PLAN_ID", lambda: F.concat(F.lit("plan "), F.when(F.col("o_orderkey") % 3 == 0, F.lit("GOLDEN")).otherwise(F.concat(F.lit("AB"), F.lpad(_key(), 6, "0")))),
    f"'plan ' || CASE WHEN o_orderkey % 3 = 0 THEN 'GOLDEN' ELSE 'AB' || lpad({_key_sql}, 6, '0') END",
    "regexp_matches(regexp_replace(value, '(?i)^(HPI|Plan)[- ]?', ''), '[0-9]')", r"(?ims)\b(?:HPI|Plan)[- ]?[A-Z0-9]{5,10}\b",
)
_in_sentence("VEHICLE_REG", lambda: F.concat(F.lit("MH "), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit(" ab "), F.lpad(_key(), 4, "0")), f"'MH ' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || ' ab ' || lpad({_key_sql}, 4, '0')")
_in_sentence("PAN_CARD", _pan(lambda: F.lit("K")), _letters_sql + " || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || 'K'")
_in_sentence("US_ROUTING_NUMBER", *_pad(9), _sum_sql("value", [3, 7, 1] * 3) + " % 10 = 0")
_in_sentence("PROVIDER_NPI", *_pad(10, 7919), LUHN_SQL.format(m="'80840' || value"))
_cpf = lambda: F.regexp_replace(_pad(11, 104729)[0](), r"^(\d{3})(\d{3})(\d{3})(\d{2})$", "$1.$2.$3-$4")
_digits_sql = "regexp_replace(value, '[^0-9]', '', 'g')"
_in_sentence(
    "BR_CPF", _cpf, f"regexp_replace({_pad(11, 104729)[1]}, '^(\\d{{3}})(\\d{{3}})(\\d{{3}})(\\d{{2}})$', '\\1.\\2.\\3-\\4')",
    f"length(replace({_digits_sql}, substr({_digits_sql}, 1, 1), '')) > 0 AND {_sum_sql(_digits_sql, list(range(10, 1, -1)))} * 10 % 11 % 10 = substr({_digits_sql}, 10, 1)::INT AND {_sum_sql(_digits_sql, list(range(11, 1, -1)))} * 10 % 11 % 10 = substr({_digits_sql}, 11, 1)::INT",
)

_in_sentence(
    "AADHAAR", lambda: F.regexp_replace(_pad(12, 1299709)[0](), r"^(\d{4})(\d{4})(\d{4})$", "$1 $2 $3"), f"regexp_replace({_pad(12, 1299709)[1]}, '^(\\d{{4}})(\\d{{4}})(\\d{{4}})$', '\\1 \\2 \\3')",
    f"list_reduce(list_prepend(0, list_transform(list_reverse(string_split(replace(value, ' ', ''), '')), lambda c, i: {_powers}[(i - 1) % 8 + 1][c::INT + 1])), lambda s, x: {_product}[s + 1][x + 1]) = 0",
)
_in_sentence(
    "BR_CNPJ", lambda: F.regexp_replace(_pad(14, 15485863)[0](), r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5"),
    f"regexp_replace({_pad(14, 15485863)[1]}, '^(\\d{{2}})(\\d{{3}})(\\d{{3}})(\\d{{4}})(\\d{{2}})$', '\\1.\\2.\\3/\\4-\\5')",
    SQL["valid_cnpj"].partition("coalesce(")[2].rpartition(", false)")[0].replace("value", _digits_sql.replace("value", "VALUE")).replace("VALUE", "value"),
)
_in_sentence(
    "EU_IBAN", lambda: F.expr("concat('DE', lpad(cast(o_orderkey % 100 as string), 2, '0'), lpad(cast(o_orderkey as string), 18, '0'))"),
    "'DE' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || lpad(o_orderkey::VARCHAR, 18, '0')", "(substr(value, 5) || '1314' || substr(value, 3, 2))::HUGEINT % 97 = 1",
)

#: A German tax number with a letter too many, in one piece and in groups: what is found ends with the number.
_de_value, _de_valid = _vat_value("{9}", "varchar"), f"({VAT_SQL['DE'][1]}){VAT_SQL['DE'][2]}"


@query(
    "detect_eu_vat",
    f"""WITH v AS (SELECT o_orderkey, {_de_value} AS value FROM orders), ok AS (SELECT * FROM v WHERE {_de_valid})
SELECT o_orderkey, 4::INT AS start, 15::INT AS "end", 'DE' || value AS value FROM ok
UNION ALL SELECT o_orderkey, 32::INT, 46::INT, 'DE ' || substr(value, 1, 3) || ' ' || substr(value, 4, 3) || ' ' || substr(value, 7) FROM ok""",
)
def detect_eu_vat(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.expr(_vat_value("{9}", "string"))
    text = F.concat(F.lit("Ref DE"), n, F.lit("X and, in parts, "), F.lit("DE "), F.substring(n, 1, 3), F.lit(" "), F.substring(n, 4, 3), F.lit(" "), F.substring(n, 7, 3), F.lit(" S see below."))
    d = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return found(d, "o_orderkey", F.col("text"), detect(F.col("text"), Policy(entities=["EU_VAT"])))


# ---- persons and language -------------------------------------------------------------------------------------

PREFIXES = ["Regards, ", "powered by ", "Name: ", "written by ", "near ", "Mr ", "From: ", "dear "]
NAMES = ["Zorblat Quux", "Maria Zorblat", "Quux J.", "zorblat Quux", "Zorblat Qu1x", "Peter Smith"]
_prefix_sql = "CASE c_custkey % {n} ".format(n=len(PREFIXES)) + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(PREFIXES)) + " END"
_name_sql = "CASE c_custkey // 8 % {n} ".format(n=len(NAMES)) + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(NAMES)) + " END"
_known_sql = ", ".join(f"'{n}'" for n in persons.KNOWN_NAMES)


@query(
    "person_names",
    f"""
WITH t AS (SELECT c_custkey, {_prefix_sql} AS prefix, {_name_sql} AS name FROM customer),
m AS (SELECT *, length(prefix) AS off, regexp_matches(prefix, '{_re(persons.MARKER)}') AS marked,
  len(list_filter(string_split(name, ' '), lambda x: rtrim(x, '.') IN ({_known_sql}))) > 0 AS known,
  regexp_matches(name, '^[A-Z][A-Za-z]*( ([A-Z][A-Za-z]*|[A-Z]\\.))+$') AS shaped FROM t)
-- a run that begins with Mr goes on after it and needs a known name; a full stop at the end of a run is left out
SELECT c_custkey, off::INT AS start, (off + length(rtrim(name, '.')))::INT AS "end" FROM m WHERE shaped AND (known OR (marked AND prefix <> 'Mr '))""",
)
def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(F.get(F.array(*[F.lit(x) for x in PREFIXES]), (k % len(PREFIXES)).cast("int")), F.get(F.array(*[F.lit(x) for x in NAMES]), (F.floor(k / 8) % len(NAMES)).cast("int")))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.explode(persons.find_name_spans(text)).alias("s"))
    return c.select("c_custkey", "s.start", "s.end")


LINES = ["Ann Example", "Job Description", "Ann Q. Example", "Ann", "ann example", "The Report", "Ann B C Example", "Ann B C D Example"]
_line_sql = f"CASE c_custkey % {len(LINES)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LINES)) + " END"
_header_sql = ", ".join(f"'{w}'" for w in persons.HEADER_FIRST_WORDS)


@query(
    "name_line",
    f"""
WITH t AS (SELECT c_custkey, {_line_sql} AS line FROM customer),
w AS (SELECT c_custkey, line, list_transform(string_split(line, ' '), lambda x: rtrim(x, '.')) AS ws FROM t)
SELECT c_custkey, line, len(ws) BETWEEN 2 AND 4 AND len(list_filter(ws, lambda x: NOT regexp_matches(x, '^[A-Z][A-Za-z]*$'))) = 0 AND lower(ws[1]) NOT IN ({_header_sql}) AS ok FROM w""",
)
def name_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.get(F.array(*[F.lit(x) for x in LINES]), (F.col("c_custkey") % len(LINES)).cast("int"))
    c = table(spark, sf_dir, "customer").select("c_custkey", line.alias("line"))
    return c.withColumn("ok", persons.name_line_tokens_ok(persons.tokens_of(F.col("line"))))


CODES = ["en", "ES", "no", "zh-cn", "xx", "zh-tw", "fr", "tlh"]


@query(
    "resolve_language",
    f"""
WITH t AS (SELECT c_custkey, CASE c_custkey % {len(CODES)} {" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(CODES))} END AS given FROM customer),
a AS (SELECT *, CASE lower(given) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items())} ELSE lower(given) END AS code FROM t)
SELECT c_custkey, given, CASE WHEN code IN ({", ".join(f"'{x}'" for x in SUPPORTED)}) THEN code ELSE 'en' END AS language FROM a""",
)
def resolved_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.get(F.array(*[F.lit(x) for x in CODES]), (F.col("c_custkey") % len(CODES)).cast("int"))
    c = table(spark, sf_dir, "customer").select("c_custkey", given.alias("given"))
    return c.withColumn("language", resolve_language(F.col("given"), F.lit("")))


_words_sql = " UNION ALL ".join(f"SELECT doc_id, '{code}' AS code, len(list_filter(ws, lambda x: x IN ({', '.join(chr(39) + w + chr(39) for w in words.split())}))) AS n FROM t" for code, words in COMMON_WORDS.items())


@query(
    "detect_language",
    f"""WITH t AS (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}]+') AS ws FROM documents), c AS ({_words_sql})
SELECT doc_id, CASE WHEN n >= 3 THEN code ELSE 'en' END AS language FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) = 1""",
)
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", resolve_language(None, F.col("text")).alias("language"))


# ---- datasets -------------------------------------------------------------------------------------------------


def _pick_sql(values: list[str], slot: int) -> str:
    return f"{values}[(('0x' || substr(md5(seed || '/{slot}'), 1, 12))::BIGINT % {len(values)} + 1)::INT]"


@query(
    "sanitize_dataset",
    f"""
WITH t AS (SELECT c_custkey, c_name, c_acctbal, 'Write to user' || c_custkey || '@mail.example.org today' AS note, CASE WHEN c_custkey % 2 = 0 THEN 'ab' END AS short FROM customer),
s AS (SELECT *, md5(md5(note) || '/9/EMAIL_ADDRESS') AS seed FROM t)
SELECT c_custkey, c_name, c_acctbal, 'Write to ' || lower({_pick_sql(FAKE_FIRST["en_US"], 1)} || '.' || {_pick_sql(FAKE_LAST["en_US"], 2)}) ||
  lpad((('0x' || substr(md5(seed || '/3'), 1, 12))::BIGINT % 100)::VARCHAR, 2, '0') || '@example.com today' AS note, short FROM s""",
)
def sanitize_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.concat(F.lit("Write to user"), F.col("c_custkey").cast("string"), F.lit("@mail.example.org today"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", note.alias("note"), F.when(F.col("c_custkey") % 2 == 0, "ab").alias("short"))
    return sanitize(c, Policy(entities=["EMAIL_ADDRESS"]), "en")


@query(
    "file_dispatch",
    """
WITH t AS (SELECT o_orderkey, 'Dir.x/File' || o_orderkey || CASE o_orderkey % 7 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.tar.zip' WHEN 4 THEN '.csv' WHEN 5 THEN '.exe' ELSE '' END AS path, (o_orderkey * 104729 % 209715200)::BIGINT AS length FROM orders),
e AS (SELECT *, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS ext FROM t)
SELECT o_orderkey, ext, CASE ext WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'jpeg' THEN 'image' WHEN 'zip' THEN 'zip' WHEN 'csv' THEN 'dataset' END AS kind,
  CASE WHEN length > 104857600 THEN 413 WHEN length = 0 THEN 400 ELSE 202 END::INT AS status FROM e""",
)
def file_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*[F.lit(x) for x in (".PDF", ".docx", ".jpeg", ".tar.zip", ".csv", ".exe", "")])
    path = F.concat(F.lit("Dir.x/File"), _key(), F.get(ends, (F.col("o_orderkey") % 7).cast("int")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"), (F.col("o_orderkey") * 104729 % 209715200).alias("length"))
    return o.select("o_orderkey", S.extension(F.col("path")).alias("ext"), S.file_kind(F.col("path")).alias("kind"), S.upload_status(F.col("length")).alias("status"))


# ---- policies -------------------------------------------------------------------------------------------------

POLICY_ROWS = [(1, 1, "PERSON", True), (2, 1, "EU_VAT", False), (3, None, "CREDIT_CARD", True), (4, None, "IP_ADDRESS", True), (5, 2, "URL", True), (6, 2, "PERSON", False), (7, None, "PHONE_NUMBER", False)]
_policy_values = ", ".join(f"({i}, {'NULL' if o is None else o}, '{t}', {str(a).lower()})" for i, o, t, a in POLICY_ROWS)
_default_values = ", ".join(f"('{e}')" for e in DEFAULT_ENTITIES)
_policies_sql = f"WITH p(id, org_id, pii_type, is_active) AS (VALUES {_policy_values}), d(pii_type) AS (VALUES {_default_values}), orgs(o) AS (VALUES (1), (2), (3)), own AS (SELECT o, pii_type, is_active FROM orgs JOIN p ON p.org_id = o UNION ALL SELECT o, pii_type, is_active FROM orgs, p WHERE p.org_id IS NULL AND o NOT IN (SELECT org_id FROM p WHERE org_id IS NOT NULL))"


def _policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICY_ROWS, P.SCHEMAS["dlp_policies"])


@query("policy_effective", _policies_sql + " SELECT o::INT AS org_id, pii_type, is_active FROM own UNION ALL SELECT o::INT, pii_type, coalesce((SELECT arg_min(p.is_active, p.id) FROM p WHERE p.org_id IS NULL AND p.pii_type = d.pii_type), true) FROM orgs, d WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.o = orgs.o AND own.pii_type = d.pii_type)")
def policy_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [P.effective_policies(_policies(spark), o).select(F.lit(o).alias("org_id"), "pii_type", "is_active") for o in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("policy_missing_defaults", _policies_sql + " SELECT pii_type, true AS is_active FROM d WHERE pii_type NOT IN (SELECT pii_type FROM p)")
def policy_missing_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.missing_defaults(_policies(spark))


@query(
    "policy_upsert",
    f"""WITH p(id, org_id, pii_type, is_active) AS (VALUES {_policy_values}),
c(org_id, pii_type, is_active) AS (VALUES (1, 'EU_VAT', true), (1, 'CREDIT_CARD', false), (2, 'CREDIT_CARD', true), (3, 'DATE_TIME', true))
SELECT id, org_id::INT AS org_id, pii_type, is_active FROM (
  SELECT id, org_id, pii_type, CASE WHEN org_id = 1 AND pii_type = 'EU_VAT' THEN true WHEN id = 3 THEN false ELSE is_active END AS is_active FROM (SELECT id, CASE WHEN id = 3 THEN 1 ELSE org_id END AS org_id, pii_type, is_active FROM p)
  UNION ALL SELECT 8, 2, 'CREDIT_CARD', true UNION ALL SELECT 9, 3, 'DATE_TIME', true)""",
)
def policy_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = spark.createDataFrame([(1, "EU_VAT", True), (1, "CREDIT_CARD", False), (2, "CREDIT_CARD", True), (3, "DATE_TIME", True)], "org_id int, pii_type string, is_active boolean")
    return P.upsert_policy(_policies(spark), changes)


@query("pattern_name", "SELECT c_custkey, upper(replace('Seg ' || c_mktsegment || ' no', ' ', '_')) AS name FROM customer")
def pattern_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", P.pattern_name(F.concat(F.lit("Seg "), "c_mktsegment", F.lit(" no"))).alias("name"))


# ---- audit ----------------------------------------------------------------------------------------------------

DETECTED = [["EMAIL_ADDRESS"], ["EMAIL_ADDRESS", "PERSON"], ["CREDIT_CARD", "PERSON", "EU_VAT"], []]
_details_sql = "CASE event_id % 4 " + " ".join(f"WHEN {i} THEN '{{\"detected\":[{','.join(chr(34) + x + chr(34) for x in d)}]}}'" for i, d in enumerate(DETECTED)) + " END"
LOGS_SQL = f"logs AS (SELECT event_id::INT AS id, CASE event_type WHEN 'view' THEN 1 ELSE 2 END::INT AS org_id, (user_id * 20)::INT AS user_id, event_type AS action, ts, CASE WHEN event_id % 5 > 0 THEN '10.0.0.' || user_id % 7 END AS ip_address, CASE WHEN event_id % 11 > 0 THEN {_details_sql} END AS details FROM events)"


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json

    details = F.get(F.array(*[F.lit(json.dumps({"detected": d}, separators=(",", ":"))) for d in DETECTED]), (F.col("event_id") % 4).cast("int"))
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("int").alias("id"), F.when(F.col("event_type") == "view", 1).otherwise(2).alias("org_id"), (F.col("user_id") * 20).cast("int").alias("user_id"), F.col("event_type").alias("action"), F.col("ts").alias("timestamp"),
        F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string"))).alias("ip_address"), F.when(F.col("event_id") % 11 > 0, details).alias("details"),
    )


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("int").alias("id"), F.col("c_name").alias("username"), F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("user").alias("role"), F.col("c_nationkey").cast("int").alias("org_id"))


@query("list_users", "SELECT c_custkey::INT AS id, c_name AS username, CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin' ELSE 'user' END AS role FROM customer")
def list_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.list_users(_users(spark, sf_dir), None)


@query("audit_recent_100", f'WITH {LOGS_SQL}, l AS (SELECT * FROM logs ORDER BY ts DESC, id DESC LIMIT 100) SELECT l.id, l.ts AS "timestamp", l.action, l.ip_address, l.details, coalesce(c.c_name, l.user_id::VARCHAR) AS "user" FROM l LEFT JOIN customer c ON c.c_custkey = l.user_id')
def audit_recent_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.recent_logs(_logs(spark, sf_dir), _users(spark, sf_dir), None)


@query(
    "audit_analytics",
    f"WITH {LOGS_SQL}, e AS (SELECT unnest(from_json(details, '{{\"detected\":[\"VARCHAR\"]}}').detected) AS entity FROM logs), c AS (SELECT entity, count(*) AS events FROM e GROUP BY entity) SELECT entity, events, floor(events * 100.0 / max(events) OVER () + 0.5)::INT AS percent FROM c",
)
def audit_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.entity_analytics(_logs(spark, sf_dir), None)


@query("audit_csv", f"WITH {LOGS_SQL} SELECT id AS \"ID\", strftime(ts, '%Y-%m-%dT%H:%M:%S') AS \"Timestamp\", user_id AS \"User ID\", action AS \"Action\", coalesce(ip_address, '') AS \"IP Address\", coalesce(details, '') AS \"Details\" FROM logs")
def audit_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.export_rows(_logs(spark, sf_dir), None)


@query(
    "certificate_counts",
    f"WITH {LOGS_SQL}, e AS (SELECT unnest(from_json(details, '{{\"detected\":[\"VARCHAR\"]}}').detected) AS entity FROM logs) SELECT CASE WHEN grouping(entity) = 1 THEN 'Total' ELSE entity END AS entity, count(*) AS occurrences FROM e GROUP BY ROLLUP (entity)",
)
def certificate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.certificate_counts(_logs(spark, sf_dir).select(F.explode(F.from_json("details", A.DETAILS)["detected"]).alias("entity")))


@query("certificate_of_nothing", "SELECT * FROM (VALUES ('No PII Detected', 0::BIGINT), ('Total', 0::BIGINT)) AS t(entity, occurrences)")
def certificate_of_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.certificate_counts(_logs(spark, sf_dir).filter("action = 'no such action'").select(F.col("details").alias("entity")))


# ---- keys and limits ------------------------------------------------------------------------------------------


@query("rate_limit_key", "WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 3600) ORDER BY ts, event_id)::INT AS nth FROM events) SELECT event_id, nth, nth > coalesce(nullif((user_id % 4)::INT, 0), 1000) AS limited FROM r")
def rate_limit_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return A.rate_limited(e, "user_id", "ts", F.col("user_id") % 4, "event_id", 3600).select("event_id", "nth", "limited")


@query(
    "rate_limit_ip",
    "WITH r AS (SELECT event_id, ts, CASE WHEN user_id % 5 = 0 THEN '' ELSE '10.0.0.' || user_id % 5 END AS ip FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY ip, floor(epoch(ts) / 14400) ORDER BY ts, event_id)::INT AS nth FROM r) SELECT event_id, ip, nth, ip <> '' AND nth > 20 AS limited FROM n",
)
def rate_limit_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.when(F.col("user_id") % 5 == 0, "").otherwise(F.concat(F.lit("10.0.0."), (F.col("user_id") % 5).cast("string")))
    e = table(spark, sf_dir, "events").select("event_id", "ts", ip.alias("ip"))
    return A.rate_limited(e, "ip", "ts", A.IP_LIMIT, "event_id", 14400).select("event_id", "ip", "nth", "limited")


#: Events put a tenth of a second apart, so that windows of a minute fill.
_dense_sql = "(SELECT event_id, user_id, TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds((event_id * 100)::BIGINT) AS ts FROM events)"


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_millis(F.lit(1704067200000) + F.col("event_id").cast("long") * 100)
    return table(spark, sf_dir, "events").select("event_id", "user_id", at.alias("ts"))


@query("rate_limit_key_minute", f"WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id % 50, floor(epoch(ts) / 60) ORDER BY ts, event_id)::INT AS nth FROM {_dense_sql}) SELECT event_id, nth, nth > coalesce(nullif((user_id % 50 % 12)::INT, 0), 1000) AS limited FROM r")
def rate_limit_key_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _dense(spark, sf_dir).withColumn("key", F.col("user_id") % 50)
    return A.rate_limited(e, "key", "ts", F.col("key") % 12, "event_id").select("event_id", "nth", "limited")


@query("rate_limit_ip_minute", f"WITH r AS (SELECT event_id, '10.0.0.' || user_id % 9 AS ip, row_number() OVER (PARTITION BY user_id % 9, floor(epoch(ts) / 60) ORDER BY ts, event_id)::INT AS nth FROM {_dense_sql}) SELECT event_id, ip, nth, nth > 20 AS limited FROM r")
def rate_limit_ip_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _dense(spark, sf_dir).withColumn("ip", F.concat(F.lit("10.0.0."), (F.col("user_id") % 9).cast("string")))
    return A.rate_limited(e, "ip", "ts", A.IP_LIMIT, "event_id").select("event_id", "ip", "nth", "limited")


@query("rate_window_count", "SELECT user_id, to_timestamp(floor(epoch(ts) / 3600) * 3600)::TIMESTAMP AS window_start, count(*) AS requests FROM events GROUP BY 1, 2")
def rate_window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.window_counts(table(spark, sf_dir, "events"), "user_id", "ts", 3600)


@query(
    "api_key_verify",
    "WITH k AS (SELECT 'pk_' || c_custkey AS key_id, c_nationkey::INT AS org_id, 100 AS rate_limit, sha256('sk_' || c_custkey) AS h FROM customer WHERE c_acctbal > 0) SELECT o_orderkey, key_id, k.org_id, rate_limit::INT AS rate_limit FROM orders LEFT JOIN k ON k.h = sha256('sk_' || o_custkey)",
)
def api_key_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    keys = c.select(F.concat(F.lit("pk_"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_nationkey").cast("int").alias("org_id"), F.lit(100).alias("rate_limit"), A.key_hash(F.concat(F.lit("sk_"), F.col("c_custkey").cast("string"))).alias("key_hash"), (F.col("c_acctbal") > 0).alias("is_active"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("sk_"), F.col("o_custkey").cast("string")).alias("key"))
    return A.verify_keys(o, keys).select("o_orderkey", "key_id", "org_id", "rate_limit")


MAIL_DOMAINS = ["gmail.com", "mailinator.com", "corp.example.com", "nomx.example.com", "bad", "PROTON.ME"]
_mail_sql = f"' User' || c_custkey || '@' || CASE c_custkey % 6 {' '.join(f'WHEN {i} THEN {chr(39)}{d}{chr(39)}' for i, d in enumerate(MAIL_DOMAINS))} END || ' '"


@query(
    "email_policy",
    f"""
WITH t AS (SELECT c_custkey, {_mail_sql} AS email FROM customer), c AS (SELECT *, lower(trim(email)) AS m FROM t), d AS (SELECT *, string_split(m, '@')[-1] AS dom FROM c)
SELECT c_custkey, CASE WHEN NOT regexp_matches(m, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]{{2,}}$') THEN false WHEN dom IN ({", ".join(f"'{x}'" for x in A.DISPOSABLE_DOMAINS)}) THEN false WHEN dom IN ({", ".join(f"'{x}'" for x in A.VERIFIED_PROVIDERS)}) THEN true ELSE dom = 'corp.example.com' END AS allowed,
  CASE WHEN NOT regexp_matches(m, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]{{2,}}$') THEN 'invalid email format' WHEN dom = 'mailinator.com' THEN 'disposable email providers are not allowed' WHEN dom IN ('gmail.com', 'proton.me') THEN 'verified provider' WHEN dom = 'corp.example.com' THEN 'verified via MX record' ELSE 'email domain is not a verified provider and has no MX record' END AS reason FROM d""",
)
def email_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = F.concat(F.lit(" User"), F.col("c_custkey").cast("string"), F.lit("@"), F.get(F.array(*[F.lit(d) for d in MAIL_DOMAINS]), (F.col("c_custkey") % 6).cast("int")), F.lit(" "))
    mx = spark.createDataFrame([("corp.example.com", True), ("nomx.example.com", False)], "domain string, has_mx boolean")
    return A.mail_policy(table(spark, sf_dir, "customer").select("c_custkey", mail.alias("email")), mx).select("c_custkey", "allowed", "reason")


@query("role_assignment", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 4 = 3 THEN NULL WHEN c_custkey IN (1, 2) THEN 'admin' ELSE 'user' END AS role FROM customer")
def role_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    mail = F.when(k % 7 > 0, F.concat(F.lit("User"), k.cast("string"), F.lit("@example.com")))
    return table(spark, sf_dir, "customer").select("c_custkey", A.assign_role(mail, ["user1@example.com", "USER2@example.com"], k % 4 < 3).alias("role"))


# ---- documents ------------------------------------------------------------------------------------------------

#: Words of documents by white space, their places on a page eight words wide; spans are the mail addresses and IPv4 numbers of the rebuilt text.
WORDS_SQL = """w AS (SELECT doc_id, (k - 1)::INT AS word_idx, ws[k] AS word FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+') AS ws FROM documents))),
o AS (SELECT *, (coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS start FROM w),
words AS (SELECT *, (start + length(word))::INT AS "end" FROM o)"""
PAGES_SQL = "pages_ AS (SELECT doc_id, string_agg(word, ' ' ORDER BY word_idx) AS text FROM words GROUP BY doc_id)"
_mail_spans = spans_sql("pages_", "doc_id", "text", MAIL, columns="'EMAIL_ADDRESS' AS entity_type")
_ip_spans = spans_sql("pages_", "doc_id", "text", IPV4, columns="'IPV4' AS entity_type")
SPANS_SQL = f"spans AS (SELECT * FROM ({_mail_spans}) UNION ALL SELECT * FROM ({_ip_spans}))"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))
    w = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(words).alias("word_idx", "word"))
    return D.with_offsets(w, ["doc_id"], "word_idx", "word")


def _page_spans(words: DataFrame) -> DataFrame:
    text = D.rebuild_text(words, ["doc_id"], "word_idx", "word")
    spans = detect(F.col("text"), Policy(entities=["EMAIL_ADDRESS"], custom=[("IPV4", IPV4)]))
    return text.select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.start", "s.end", "s.entity_type")


@query("words_rebuild", f"WITH {WORDS_SQL}, {PAGES_SQL} SELECT doc_id, length(text) AS n, md5(text) AS digest, (SELECT max(\"end\") FROM words w WHERE w.doc_id = p.doc_id) AS last FROM pages_ p")
def words_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _words(spark, sf_dir)
    last = w.groupBy("doc_id").agg(F.max("end").alias("last"))
    t = D.rebuild_text(w, ["doc_id"], "word_idx", "word").join(last, "doc_id")
    return t.select("doc_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"), "last")


@query("span_word_join", f'WITH {WORDS_SQL}, {PAGES_SQL}, {SPANS_SQL} SELECT DISTINCT w.doc_id, w.word_idx FROM words w JOIN spans s ON s.doc_id = w.doc_id AND w.start < s."end" AND w."end" > s.start')
def span_word_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _words(spark, sf_dir)
    return D.redacted_words(_page_spans(w), w, ["doc_id"])


@query(
    "redaction_boxes",
    f"WITH {WORDS_SQL}, {PAGES_SQL}, {SPANS_SQL}, b AS (SELECT *, (word_idx % 8) * 60.0 AS x0, (word_idx // 8) * 12.0 AS y0 FROM words) "
    'SELECT DISTINCT b.doc_id, b.word_idx, (x0 - 1)::DOUBLE AS x0, (y0 - 1)::DOUBLE AS y0, (x0 + 5.0 * length(word) + 1)::DOUBLE AS x1, (y0 + 10 + 1)::DOUBLE AS y1 FROM b JOIN spans s ON s.doc_id = b.doc_id AND b.start < s."end" AND b."end" > s.start',
)
def redaction_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _words(spark, sf_dir)
    x0, y0 = (F.col("word_idx") % 8) * 60.0, F.floor(F.col("word_idx") / 8) * 12.0
    b = w.withColumns({"x0": x0, "y0": y0, "x1": x0 + 5.0 * F.length("word"), "y1": y0 + 10})
    return D.redaction_boxes(_page_spans(w), b, ["doc_id"])


@query("page_report", f"WITH {WORDS_SQL}, {PAGES_SQL}, {SPANS_SQL} SELECT doc_id, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS pii_types FROM spans GROUP BY doc_id")
def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.page_report(_page_spans(_words(spark, sf_dir)), ["doc_id"])
    return r.select("doc_id", F.array_join("pii_types", ",").alias("pii_types"))


@query("unmapped_spans", f'WITH {WORDS_SQL}, {PAGES_SQL}, {SPANS_SQL}, kept AS (SELECT * FROM words WHERE length(word) < 18) SELECT doc_id, start, "end", entity_type FROM spans s WHERE NOT EXISTS (SELECT 1 FROM kept w WHERE w.doc_id = s.doc_id AND w.start < s."end" AND w."end" > s.start)')
def unmapped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _words(spark, sf_dir)
    return D.unmapped_spans(_page_spans(w), w.filter("length(word) < 18"), ["doc_id"]).select("doc_id", "start", "end", "entity_type")


#: Four lines for each customer: perhaps a name, then perhaps a telephone number in the fourth.
_lines_sql = f"lines AS (SELECT c_custkey, n, CASE n WHEN 0 THEN {_line_sql} WHEN 3 THEN CASE WHEN c_custkey % 3 = 0 THEN 'call 555 123 4567' ELSE 'nothing here' END ELSE 'line ' || n END AS text FROM customer, generate_series(0, 4) AS g(n))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("line")
    head = F.get(F.array(*[F.lit(x) for x in LINES]), (k % len(LINES)).cast("int"))
    text = F.when(n == 0, head).when(n == 3, F.when(k % 3 == 0, "call 555 123 4567").otherwise("nothing here")).otherwise(F.concat(F.lit("line "), n.cast("string")))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("line"))
    return D.with_offsets(c.withColumn("text", text), ["c_custkey"], "line", "text")


@query("header_name_rule", f"""WITH {_lines_sql}, ok AS ({SQL["name_line"]}) SELECT c_custkey, 0::INT AS line, 0::INT AS start, length(line)::INT AS "end" FROM ok JOIN lines l USING (c_custkey) WHERE ok AND l.n = 3 AND l.text LIKE 'call%'""")
def header_name_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.header_name_lines(_lines(spark, sf_dir), ["c_custkey"], "line")


#: Three runs for each customer, most with a telephone number that begins in the first, fills the second and ends in the third.
@query(
    "run_splice",
    "SELECT c_custkey, n::INT AS run_idx, CASE WHEN n = 0 AND c_custkey % 5 = 0 THEN 'Call me, ' || c_name WHEN n = 0 THEN 'Call me, ' || c_name || ', at [PHONE_NUMBER_MASKED]' WHEN n = 1 AND c_custkey % 5 = 0 THEN ' or' WHEN n = 1 THEN '' WHEN c_custkey % 5 = 0 THEN ' write to ' || c_mktsegment || '.' ELSE ' for ' || c_mktsegment || '.' END AS text FROM customer, generate_series(0, 2) AS g(n)",
)
def run_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.array(F.concat(F.lit("Call me, "), "c_name", F.lit(", at +1 ("), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0")), F.lit(") 555"), F.concat(F.lit("-0100 for "), "c_mktsegment", F.lit(".")))
    none = F.array(F.concat(F.lit("Call me, "), "c_name"), F.lit(" or"), F.concat(F.lit(" write to "), "c_mktsegment", F.lit(".")))
    parts = F.when(F.col("c_custkey") % 5 == 0, none).otherwise(number)
    runs = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(parts).alias("run_idx", "text"))
    text = D.rebuild_text(runs, ["c_custkey"], "run_idx", "text", "")
    spans = text.select("c_custkey", F.explode(detect(F.col("text"), Policy(entities=["PHONE_NUMBER"]))).alias("s")).select("c_custkey", "s.start", "s.end", "s.entity_type")
    return D.splice_runs(runs, spans, ["c_custkey"]).select("c_custkey", "run_idx", "text")


@query(
    "word_boxes",
    """WITH t AS (SELECT c_custkey, 'ab ' || c_name AS text FROM customer), w AS (SELECT c_custkey, length(text)::DOUBLE AS n, unnest([{'a': 0, 'b': 2, 'w': 'ab'}, {'a': 3, 'b': length(text), 'w': substr(text, 4)}]) AS m FROM t)
SELECT c_custkey, m.w AS word, (10 + m.a / n * 100)::DOUBLE AS x0, 20.0::DOUBLE AS y0, (10 + m.b / n * 100)::DOUBLE AS x1, 40.0::DOUBLE AS y1 FROM w""",
)
def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((10, 20), (110, 20), (110, 40), (10, 40))])
    c = table(spark, sf_dir, "customer").select("c_custkey", F.explode(D.word_boxes(F.concat(F.lit("ab "), "c_name"), corners)).alias("b"))
    return c.select("c_custkey", "b.word", "b.x0", "b.y0", "b.x1", "b.y1")


@query(
    "line_clip",
    f"""WITH {_lines_sql}, o AS (SELECT *, (coalesce(sum(length(text) + 1) OVER (PARTITION BY c_custkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS a FROM lines)
SELECT c_custkey, n::INT AS line, (greatest(3, a) - a)::INT AS part_start, (least(30, a + length(text)) - a)::INT AS part_end FROM o WHERE a < 30 AND a + length(text) > 3 AND least(30, a + length(text)) > greatest(3, a)""",
)
def line_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    spans = lines.filter("line = 0").select("c_custkey", F.lit(3).alias("start"), F.lit(30).alias("end"), F.lit("X").alias("entity_type"))
    return D.clip_to_lines(spans, lines, ["c_custkey"]).select("c_custkey", "line", "part_start", "part_end")


@query(
    "discovery_report",
    f"""WITH c AS (SELECT source, len(regexp_extract_all(text, '{_re(MAIL)}')) AS a, len(regexp_extract_all(text, '{_re(IPV4)}')) AS b FROM documents)
SELECT source AS file, concat_ws(',', CASE WHEN sum(a) > 0 THEN 'EMAIL_ADDRESS' END, CASE WHEN sum(b) > 0 THEN 'IPV4' END) AS pii_detected, count(*) AS items_found FROM c WHERE a + b > 0 GROUP BY source""",
)
def discovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(spread(table(spark, sf_dir, "documents").select("source", "text")), policy=Policy(entities=["EMAIL_ADDRESS"], custom=[("IPV4", IPV4)]))
    r = D.discovery_report(s.filter("action = 'BLOCK'"), "source", "types")
    return r.select(F.col("source").alias("file"), F.array_join("pii_detected", ",").alias("pii_detected"), "items_found")


@query("span_replace", "SELECT o_orderkey, 'key [' || 'KEY_MASKED] of ' || o_custkey AS redacted FROM orders")
def span_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("key "), _key(), F.lit(" of "), F.col("o_custkey").cast("string"))
    span = F.struct(F.lit(4).alias("start"), (F.length(_key()) + 4).cast("int").alias("end"), F.lit("KEY").alias("entity_type"), F.lit(1.0).alias("score"), F.lit(0).alias("src"))
    spans = F.when(F.col("o_orderkey").isNotNull(), F.array(span)).otherwise(no_spans())
    return table(spark, sf_dir, "orders").select("o_orderkey", replace_spans(text, spans, lambda s: mask_token(s["entity_type"], "LABEL")).alias("redacted"))


# ---- streaming ------------------------------------------------------------------------------------------------


@query("stream_gateway", SQL["scan_action"])
def stream_gateway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of files through the gateway; what it wrote."""
    import tempfile

    from veilspark.streaming.gateway import start_gateway

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or tempfile.mkdtemp()
    out = f"{root}/gateway-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}-{__import__('time').time_ns()}"
    schema = table(spark, sf_dir, "documents").schema
    requests = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*").select("doc_id", "text")
    q = start_gateway(requests, f"{out}/decisions", f"{out}/checkpoint", Policy(entities=["EMAIL_ADDRESS"], custom=[("IPV4", IPV4)]))
    q.awaitTermination()
    return spark.read.parquet(f"{out}/decisions").select("doc_id", "action", "count", F.array_join("types", ",").alias("types"))
