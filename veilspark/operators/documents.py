"""Documents as tables of words, lines and runs: text rebuilt with offsets, spans joined to geometry, redactions as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.persons import has_contact, name_line_tokens_ok, tokens_of
from veilspark.functions.spans import find_all, mask_token

HEADER_LINES = 3
PAD = 1


def with_offsets(pieces: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """pieces with start and end in the text that joins them by one character, in order, within the keys."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0)).cast("int")
    return pieces.withColumn("start", start).withColumn("end", (start + F.length(text)).cast("int"))


def rebuild_text(pieces: DataFrame, keys: Sequence[str], order: str, text: str, separator: str = " ") -> DataFrame:
    """(keys, text): the pieces in order, joined. A page or image is one row, so a group is bounded by it."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x[text]), separator).alias("text"))


def overlapping(spans: DataFrame, pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans joined to the pieces of their keys that they share a character with; a part is enough.

    spans: keys, start, end, entity_type; pieces: keys, start, end and more. An equi-join on the keys with a range condition.
    """
    s = spans.select(*keys, F.col("start").alias("span_start"), F.col("end").alias("span_end"), "entity_type")
    return pieces.join(s, list(keys)).filter((F.col("start") < F.col("span_end")) & (F.col("end") > F.col("span_start")))


def redacted_words(spans: DataFrame, words: DataFrame, keys: Sequence[str], word_idx: str = "word_idx") -> DataFrame:
    """The words to black out, once each."""
    return overlapping(spans, words, keys).select(*keys, word_idx).distinct()


def redaction_boxes(spans: DataFrame, words: DataFrame, keys: Sequence[str], pad: float = PAD) -> DataFrame:
    """(keys, x0, y0, x1, y1): the words' boxes, padded; the masking style plays no part."""
    hit = overlapping(spans, words, keys).select(*keys, "word_idx", "x0", "y0", "x1", "y1").distinct()
    return hit.select(*keys, "word_idx", (F.col("x0") - pad).alias("x0"), (F.col("y0") - pad).alias("y0"), (F.col("x1") + pad).alias("x1"), (F.col("y1") + pad).alias("y1"))


def unmapped_spans(spans: DataFrame, words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans that meet no word."""
    w = words.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("start").alias("__s"), F.col("end").alias("__e"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    return spans.join(w, same & (F.col("__s") < F.col("end")) & (F.col("__e") > F.col("start")), "left_anti")


def page_report(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pii_types): distinct types in order, a row for each page with any."""
    return spans.groupBy(*keys).agg(F.array_sort(F.collect_set("entity_type")).alias("pii_types"))


def header_name_lines(lines: DataFrame, keys: Sequence[str], order: str, text: str = "text") -> DataFrame:
    """(keys, order, start, end) of first lines that read like a name where one of the next three has a mail address or telephone number.

    lines carry start and end. Only the first four lines of each document are looked at: they are found by rank, not by sorting all.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    near = w.rowsBetween(1, HEADER_LINES)
    seen = lines.withColumn("__rank", F.row_number().over(w)).withColumn("__next", F.array_join(F.collect_list(text).over(near), " "))
    ok = name_line_tokens_ok(tokens_of(F.col(text))) & has_contact(F.col("__next"))
    return seen.filter((F.col("__rank") == 1) & ok).select(*keys, order, "start", "end")


def lines_of_words(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, line_no, text, start, end): words gathered by (block, line), in order of first appearance. words carry start and end."""
    grouped = words.groupBy(*keys, "block", "line").agg(F.min("word_idx").alias("first"), F.array_sort(F.collect_list(F.struct("word_idx", "word"))).alias("ws"), F.min("start").alias("start"), F.max("end").alias("end"))
    no = F.dense_rank().over(Window.partitionBy(*keys).orderBy("first"))
    return grouped.withColumn("line_no", no).select(*keys, "line_no", F.array_join(F.transform("ws", lambda x: x["word"]), " ").alias("text"), "start", "end")


def splice_runs(runs: DataFrame, spans: DataFrame, keys: Sequence[str], style: str | None = "LABEL") -> DataFrame:
    """runs (keys, run_idx, text) with the spans of their paragraph replaced, each run's format its own.

    A span's token stands in the first run it touches; what it covers of the others goes. Spans are disjoint and are cut to the paragraph.
    """
    before = Window.partitionBy(*keys).orderBy("run_idx").rowsBetween(Window.unboundedPreceding, -1)
    at = runs.withColumn("start", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("int"))
    at = at.withColumn("end", (F.col("start") + F.length("text")).cast("int"))
    hit = overlapping(spans.filter("end > start"), at, keys)
    first = F.min("run_idx").over(Window.partitionBy(*keys, "span_start"))
    token = F.when(F.col("run_idx") == first, mask_token(F.col("entity_type"), style, upper=True)).otherwise("")
    edit = F.struct(F.greatest(F.col("span_start") - F.col("start"), F.lit(0)).alias("a"), F.least(F.col("span_end"), F.col("end")).alias("e"), token.alias("token"), F.col("start").alias("run"))
    edits = hit.select(*keys, "run_idx", edit.alias("x")).groupBy(*keys, "run_idx").agg(F.array_sort(F.collect_list("x")).alias("edits"))
    out = at.join(edits, [*keys, "run_idx"], "left")
    t = F.col("text")

    def piece(x: Column, i: Column) -> Column:
        done = F.when(i > 0, F.get(F.col("edits"), i - 1)["e"] - F.get(F.col("edits"), i - 1)["run"]).otherwise(F.lit(0))
        return F.concat(F.substring(t, done + 1, x["a"] - done), x["token"])

    last = F.element_at(F.col("edits"), -1)
    spliced = F.concat(F.array_join(F.transform("edits", piece), ""), F.substring(t, last["e"] - last["run"] + 1, F.length(t)))
    return out.withColumn("text", F.when(F.col("edits").isNotNull(), spliced).otherwise(t)).drop("edits", "start", "end")


def clip_to_lines(spans: DataFrame, lines: DataFrame, keys: Sequence[str], order: str = "line") -> DataFrame:
    """(keys, line, part_start, part_end, entity_type): the part of each span within each line, counted from the line's start."""
    hit = overlapping(spans, lines, keys)
    a, b = F.greatest("span_start", "start") - F.col("start"), F.least("span_end", "end") - F.col("start")
    return hit.select(*keys, order, a.alias("part_start"), b.alias("part_end"), "entity_type", "text", *(["box"] if "box" in lines.columns else [])).filter("part_end > part_start")


def word_boxes(text: Column, box: Column) -> Column:
    """array<struct<x0, y0, x1, y1, start, end, word>>: a line's box (corners from top left, clockwise) cut in proportion to its characters."""
    n = F.length(text).cast("double")
    tl, tr, br, bl = (F.get(box, F.lit(i)) for i in range(4))

    def cut(m: Column) -> Column:
        f1, f2 = m["start"] / n, m["end"] / n
        x0 = F.least(tl["x"] + f1 * (tr["x"] - tl["x"]), bl["x"] + f1 * (br["x"] - bl["x"]))
        x1 = F.greatest(tl["x"] + f2 * (tr["x"] - tl["x"]), bl["x"] + f2 * (br["x"] - bl["x"]))
        return F.struct(x0.alias("x0"), F.least(tl["y"], bl["y"]).alias("y0"), x1.alias("x1"), F.greatest(tr["y"], br["y"]).alias("y1"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("word"))

    return F.transform(find_all(text, r"\S+"), cut)


def image_redactions(spans: DataFrame, lines: DataFrame, keys: Sequence[str], pad: float = PAD) -> DataFrame:
    """A row for each word and span that meet: (keys, line, word, entity_type, x0, y0, x1, y1) in whole pixels, towards zero."""
    parts = clip_to_lines(spans, lines, keys)
    each = parts.withColumn("w", F.explode(word_boxes(F.col("text"), F.col("box"))))
    hit = each.filter((F.col("w.start") < F.col("part_end")) & (F.col("w.end") > F.col("part_start")))
    pixel = lambda c: c.cast("int")
    return hit.select(*keys, "line", F.col("w.word").alias("word"), "entity_type", pixel(F.col("w.x0") - pad).alias("x0"), pixel(F.col("w.y0") - pad).alias("y0"), pixel(F.col("w.x1") + pad).alias("x1"), pixel(F.col("w.y1") + pad).alias("y1"))


def discovery_report(items: DataFrame, file: str = "file", types: str = "pii_types") -> DataFrame:
    """(file, pii_detected, items_found) of reported items with any type."""
    return items.groupBy(file).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(types)))).alias("pii_detected"), F.count("*").alias("items_found"))
