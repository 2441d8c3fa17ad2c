"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range is retained.

Sketches merge by union, and the containment of a short document in a long one can be estimated as both keep the
same hashes. A text of few shingles would retain too few to tell anything; its sketch is whole: it has all of them, and says
so. Two sketches are compared on the fraction that both retain, so whole ones exactly. Where a short text has no hash in
that fraction its containment is unknown, not 0.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import partitions, words_of


@dataclass(frozen=True)
class Sketch:
    """One in `scale` hashes is retained; a shingle has `shingle` words. Sketches of fewer than `whole` distinct shingles are whole."""

    scale: int = 8
    shingle: int = 5
    whole: int = 128
    #: Distinct words whose hashes a Python worker remembers.
    memory: int = 1 << 18


class WordHashes(dict):
    def __init__(self, most: int):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = h
        return h


#: Odd multipliers of a shingle's words, by place.
_PLACES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of each run of k word hashes; of all of them if there are fewer."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.full(n, np.uint64(k))
    for i in range(k):
        h = (h ^ words[i : i + n]) * _PLACES[i % 5]
        h ^= h >> np.uint64(32)
    h *= np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


@dataclass(frozen=True)
class Retained:
    """The sorted distinct hashes of a text below 1 / scale of the range: all of them if scale is 1."""

    hashes: np.ndarray
    scale: int

    def below(self, scale: int) -> np.ndarray:
        return self.hashes if scale <= self.scale else self.hashes[: np.searchsorted(self.hashes, np.uint64((1 << 64) // scale))]


def retained(h: np.ndarray, how: Sketch) -> Retained:
    """The sketch of sorted distinct hashes."""
    return Retained(h, 1) if len(h) < how.whole else Retained(Retained(h, 1).below(how.scale), how.scale)


def shingle_set(text: str | None, how: Sketch, seen: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the whole text's shingles, ASCII letters in lower case; none for a wordless text."""
    words = words_of(text)
    return np.unique(shingle_hashes(np.fromiter(map(seen.__getitem__, words), np.uint64, len(words)), how.shingle))


def sketch(text: str | None, how: Sketch, seen: WordHashes) -> Retained:
    return retained(shingle_set(text, how, seen), how)


def likeness(a: Retained, b: Retained) -> float:
    """Estimated Jaccard likeness: of hashes that both fractions hold, those in both over those in either; exact for whole sketches.

    Two sketches without hashes there are alike only if both are whole.
    """
    x, y = a.below(b.scale), b.below(a.scale)
    both = len(np.intersect1d(x, y, assume_unique=True))
    either = len(x) + len(y) - both
    return both / either if either else float(a.scale == b.scale == 1)


def containment(a: Retained, b: Retained) -> float | None:
    """Estimated part of a's shingles that b has, whatever b's length; None where a has no hash to tell by. A wordless a is within everything."""
    if a.scale == 1 and not len(a.hashes):
        return 1.0
    x = a.below(b.scale)
    return len(np.intersect1d(x, b.below(a.scale), assume_unique=True)) / len(x) if len(x) else None


def merge(a: Retained, b: Retained, how: Sketch) -> Retained:
    """The sketch of both texts' shingles together."""
    scale = max(a.scale, b.scale)
    h = np.union1d(a.below(scale), b.below(scale))
    return retained(h, how) if scale == 1 else Retained(h, scale)


def text_of(s: Retained) -> str:
    """The scale, a colon and the little-endian hashes in base64."""
    return f"{s.scale}:" + base64.b64encode(s.hashes.astype("<u8").tobytes()).decode()


def sketch_of(text: str) -> Retained:
    scale, _, hashes = text.partition(":")
    return Retained(np.frombuffer(base64.b64decode(hashes), "<u8"), int(scale))


def sketches(docs: DataFrame, text_col: str = "text", how: Sketch | None = None) -> DataFrame:
    """docs with `fingerprint` (a column of that name is replaced), the sketch of each whole text as text_of writes it; null as empty.

    Equal texts have equal fingerprints; repeated rows come back as often as they come, an empty table empty.
    """
    how = how or Sketch()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        seen = WordHashes(how.memory)
        return pd.Series([text_of(sketch(t, how, seen)) for t in texts], dtype=object)

    return docs.withColumn("fingerprint", run(F.col(text_col)))


#: Ranges of ids at most; their bounds are held by the driver and each task.
MOST_RANGES = 1 << 18
#: Bytes of stored text for each range.
RANGE_BYTES = 32 << 20


def next_in_order(docs: DataFrame, id_col: str, text_col: str, each, schema: str) -> DataFrame:
    """Rows each(id, text, next id, next text) for every row of docs and the one after it in ascending id; after the last: the first.

    Nulls come first, texts are null as empty, rows of one id are in order of their texts' SHA-256. Rows are dealt
    by ranges of the id, as many as the texts' size asks for, texts compressed; an id of so many rows that it fills
    several ranges is dealt by ranges of the SHA-256. The first row of a range goes to the range before it too, so
    no range waits for another and no task sees more than its range. Rows equal in id and text share a range.
    """
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)))
    size = int(str(docs.select(F.col(f"`{text_col}`"))._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < 1 << 60 else 0  # of no known size: then the session says how many
    n = min(max(2, 2 * partitions(docs.sparkSession), -(-size // RANGE_BYTES)), MOST_RANGES)
    cuts = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], min(10 * n, 1_000_000))).first()[0] or []
    cuts = np.array(cuts, np.int64)
    values, times = np.unique(cuts, return_counts=True)
    hot = values[times > 1]

    def range_of(keys: np.ndarray, sha) -> np.ndarray:
        """The number of cuts below a key; of a key that is several cuts, as many more as its digest says."""
        r = np.searchsorted(cuts, keys, "left")
        for i in np.flatnonzero(np.isin(keys, hot)):
            m = int(times[np.searchsorted(values, keys[i])])
            r[i] += int.from_bytes(sha(i)[:4], "big") * m >> 32
        return r

    def first_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = b["k"].to_numpy(np.int64)
            keys = keys[~np.isin(keys, hot)]
            yield pd.DataFrame({"r": np.searchsorted(cuts, keys, "left"), "k": keys}).groupby("r", as_index=False).min()

    def first_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sha = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest() for t in b["t"]]
            yield pd.DataFrame({"r": range_of(b["k"].to_numpy(np.int64), sha.__getitem__), "k": b["k"], "sha": sha})

    rows = docs.select(key.alias("k"), F.col(f"`{id_col}`").isNull().alias("null"), F.col(f"`{text_col}`").alias("t"))
    firsts = [(r, k, None) for r, k in rows.select("k").mapInPandas(first_ids, "r long, k long").groupBy("r").agg(F.min("k")).collect()]  # a row for each range
    if len(hot):
        few = rows.filter(F.col("k").isin([int(x) for x in hot])).select("k", "t").mapInPandas(first_texts, "r long, k long, sha binary")
        firsts += [(r[0], r[1]["k"], bytes(r[1]["sha"])) for r in few.groupBy("r").agg(F.min(F.struct("k", "sha"))).collect()]  # no more than that
    least = {}
    for r, k, sha in firsts:  # a hot id is the least of its ranges but the last, where it may be followed by others
        least[r] = min(least.get(r, (k, sha)), (k, sha), key=lambda x: (x[0], x[1] or b""))
    ranges = sorted(least)
    before = {least[r]: ranges[i - 1] for i, r in enumerate(ranges)}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            keys, texts = b["k"].to_numpy(np.int64), [(t or "").encode("utf-8", "surrogatepass") for t in b["t"]]
            sha = [hashlib.sha256(t).digest() for t in texts]
            out = pd.DataFrame({"r": range_of(keys, sha.__getitem__), "k": keys, "null": b["null"], "extra": False, "sha": sha, "t": [z.compress(t) for t in texts]})
            other = [before.get((k, None), before.get((k, x))) for k, x in zip(keys.tolist(), sha)]
            again = out[[r is not None for r in other]].copy()
            again["extra"], again["r"] = True, [r for r in other if r is not None]
            yield out
            yield again

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        last, done = None, []
        for b in batches:
            for r, k, null, extra, t in zip(b["r"], b["k"], b["null"], b["extra"], b["t"]):
                text = z.decompress(t).decode("utf-8", "surrogatepass")
                if last is not None and last[0] == r:
                    done.append((None if last[2] else last[1], last[3], None if null else k, text))
                # of the rows that stand for the next range, the first alone ends this one
                last = None if extra else (r, k, null, text)
                if len(done) >= 500:
                    yield each(done)
                    done = []
        if done:
            yield each(done)

    dealt = rows.mapInPandas(deal, "r long, k long, null boolean, extra boolean, sha binary, t binary")
    return dealt.repartition(n, "r").sortWithinPartitions("r", "extra", "k", "sha").mapInPandas(walk, schema)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Sketch | None = None) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id, next_in_it.

    The edited text ends in the first floor(n_chars/2) code points of the next row's text. next_in_it estimates
    how much of the next text the row's holds, by its shingles themselves where the sketch has none to tell by. A
    lone row is its own next. Null ids come first; rows of one id are in order of their texts' SHA-256, equal ones
    follow one another. An empty table gives an empty one; other columns are not read.
    """
    how = how or Sketch()
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_id", "next_in_it"]

    def each(rows: list) -> pd.DataFrame:
        seen, out, known = WordHashes(how.memory), [], (None, None)
        for key, text, next_key, after in rows:
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            a = known[1] if known[0] is text else sketch(text, how, seen)
            b, c = sketch(edited, how, seen), sketch(after, how, seen)
            known = (after, c)
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            part = containment(c, a)
            if part is None:
                x = shingle_set(after, how, seen)
                part = len(np.intersect1d(x, shingle_set(text, how, seen), assume_unique=True)) / len(x)
            out.append((key, len(text), sha, text_of(a), text_of(b), likeness(a, b), likeness(a, c), next_key, part))
        frame = pd.DataFrame(out, columns=names)
        return frame.astype({"id": "Int64", "next_id": "Int64"})

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, next_id long, next_in_it double"
    return next_in_order(docs, id_col, text_col, each, schema)
