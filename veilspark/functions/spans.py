"""Spans in text as columns: find with offsets, resolve overlaps, replace.

A span is struct<start int, end int, entity_type string, score double, src int>; offsets count code points,
half-open. All of it is JVM-side: Catalyst sees plain expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,entity_type:string,score:double,src:int>"
SPANS = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.expr(f"cast(array() as {SPANS.replace('start:', '`start`:').replace('end:', '`end`:')})")


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), the value worked out once."""
    return F.element_at(F.transform(F.array(value), of), 1)


FOUND = "array<struct<start:int,end:int,value:string>>"
#: The offsets of matches m between gaps g, in SQL as it is built for every pattern.
LOCATED = f"""x -> aggregate(
  zip_with(x.m, slice(x.g, 1, size(x.m)), (m, g) -> named_struct('m', m, 'a', length(g), 'n', length(m))),
  named_struct('at', 0, 'out', cast(array() as {FOUND.replace("end:", "`end`:").replace("start:", "`start`:")})),
  (s, y) -> named_struct('at', s.at + y.a + y.n, 'out', concat(s.out, array(named_struct('start', s.at + y.a, 'end', s.at + y.a + y.n, 'value', y.m)))),
  s -> s.out)"""


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches; null text: null.

    The matches and the gaps between them are read by the same matcher, so offsets are running sums of their
    lengths. Exact for matches that aren't empty; a text without a match costs a single pass.
    """
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    none = F.lit(None).cast(FOUND)
    located = F.element_at(F.call_function("transform", F.array(both), F.expr(LOCATED)), 1)
    return F.when(text.isNull(), none).when(text.rlike(pattern), located).otherwise(F.array().cast(FOUND))


def spans_of(found: Column, entity: str, score: Column | float, src: int, score_of: Callable[[Column], Column] | None = None) -> Column:
    """find_all's matches as spans; score_of gives each match's score."""
    if score_of is None and not isinstance(score, Column):
        name = entity.replace("\\", "\\\\").replace("'", "\\'")
        return F.call_function("transform", found, F.expr(f"m -> named_struct('start', m.`start`, 'end', m.`end`, 'entity_type', '{name}', 'score', {float(score)!r}D, 'src', {src})"))
    value = lambda m: score_of(m) if score_of else score
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(entity).alias("entity_type"), value(m).cast("double").alias("score"), F.lit(src).alias("src")))


def resolve_overlaps(spans: Column) -> Column:
    """Stable order by start, longest, best score; then greedily: a span that begins at or after the last end is taken, one
    that reaches further with a better score takes the last one's place, others go. Dropped spans move nothing."""
    key = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), (-s["score"]).alias("c"), s["src"].alias("d"), s.alias("s")))
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).cast("double").alias("best"), no_spans().alias("kept"))

    def step(acc: Column, k: Column) -> Column:
        s = k["s"]
        further = (F.size(acc["kept"]) > 0) & (s["end"] > acc["last"]) & (s["score"] > acc["best"])
        taken = F.struct(s["end"].alias("last"), s["score"].alias("best"), F.concat(acc["kept"], F.array(s)).alias("kept"))
        swapped = F.struct(s["end"].alias("last"), s["score"].alias("best"), F.concat(F.slice(acc["kept"], F.lit(1), F.size(acc["kept"]) - 1), F.array(s)).alias("kept"))
        return F.when(s["start"] >= acc["last"], taken).when(further, swapped).otherwise(acc)

    return F.aggregate(F.array_sort(key), start, step, lambda acc: acc["kept"])


def mask_token(entity: Column, style: Column | str, upper: bool = False) -> Column:
    """[ENTITY_MASKED], eight blocks or three asterisks; any other style, and null, is a label. Text compares styles as they are, documents in upper case."""
    style = F.lit(style) if isinstance(style, str) or style is None else style
    style = F.upper(style) if upper else style
    return F.when(style == "BLACKOUT", F.lit("█" * 8)).when(style == "ASTERISK", F.lit("***")).otherwise(F.concat(F.lit("["), entity, F.lit("_MASKED]")))


def replace_spans(text: Column, spans: Column, token: Callable[[Column], Column]) -> Column:
    """text with each of the sorted disjoint spans replaced by its token."""

    def piece(s: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(F.lit(0))
        return F.concat(F.substring(text, before + 1, s["start"] - before), token(s))

    last = F.when(F.size(spans) > 0, F.element_at(spans, -1)["end"]).otherwise(F.lit(0))
    return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, last + 1, F.length(text)))


def types_of(spans: Column) -> Column:
    """Distinct entity types in order of name."""
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["entity_type"])))


def is_blank(text: Column) -> Column:
    """Nothing but white space of any script."""
    return text.rlike(r"(?U)^\s*$")
