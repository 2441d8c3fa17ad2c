"""SimHash fingerprints and near-duplicate groups by covering locality-sensitive hashing.

A covering for radius r gives every fingerprint bit i a non-zero vector phi(i) of r+1 bits. The table of a
non-zero vector v hashes the bits whose phi(i) has an odd product with v. The r bits in which two
fingerprints differ span at most r of the r+1 dimensions, so some v is orthogonal to all of them and the
pair meets in that table: no pair within the radius is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import stored, trim, words_of
from veilspark.llm.components import connected_components

BITS = 64
#: Words of a shingle, seed of its hash, bits that may differ.
SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints of one bucket that one task compares; larger buckets are covered again, then dealt in pairs of chunks.
BUCKET = 4096
#: Shingles whose bits are counted at once.
CHUNK = 1 << 17


def fingerprint_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of the whole text; fewer words than a shingle: of all of them; no word: none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    k = min(shingle, len(words))
    flat = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(flat[s:e], seed) for s, e in zip(starts, ends[k - 1 :].tolist())), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """Bit i is 1 if set in over half of the hashes; 0 for none. As a signed 64-bit number."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[i : i + CHUNK]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long) for every row of docs; null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = [simhash(fingerprint_hashes(t, shingle)) for t in b["t"]]
            yield pd.DataFrame({"id": b["id"], "fp": np.array(fp, np.int64)})
            trim()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS, stride: int = 1) -> list[int]:
    """One mask for each non-zero v of radius+1 bits; stride deals phi differently for a second covering."""
    values = (1 << (radius + 1)) - 1
    phi = [1 + (i // stride) % values for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (phi[i] & v).bit_count() % 2) for v in range(1, values + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tables(df: DataFrame, masks: list[int], *keys: str) -> DataFrame:
    """A row (g, fp) for each mask: g hashes the keys so far, the mask's number and the masked bits."""
    each = F.array(*[F.xxhash64(*keys, F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])
    return df.select(F.explode(each).alias("g"), "fp")


def _links(radius: int):
    """Of rows sorted by (g, fp), a spanning forest of the links within each g: never all pairs of a group."""

    def within(x: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x.view(np.uint64)) <= radius  # of signed numbers it would count the magnitude's bits

    def forest(fps: np.ndarray) -> list[tuple[int, int]]:
        out, left = [], fps
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = within(left ^ x)
                if near.any():
                    found = left[near]
                    out.extend((int(x), int(y)) for y in found)
                    queue.extend(found)
                    left = left[~near]
        return out

    def of(g: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
        size = np.diff(np.append(at, len(g)))
        two = at[size == 2]
        two = two[within(fp[two] ^ fp[two + 1])]
        pairs = [(x, y) for s, n in zip(at[size > 2], size[size > 2]) for x, y in forest(np.unique(fp[s : s + n]))]
        more = np.array(pairs, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": np.concatenate([fp[two], more[:, 0]]), "b": np.concatenate([fp[two + 1], more[:, 1]])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            g, fp = np.append(g, b["g"].to_numpy()), np.append(fp, b["fp"].to_numpy())
            done = int(np.searchsorted(g == g[-1], True)) if len(g) else 0  # the last group may go on
            yield of(g[:done], fp[:done])
            g, fp = g[done:], fp[done:]
        yield of(g, fp)

    return run


def near_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that join all distinct fingerprints of column fp that lie within the radius, through others or directly.

    Buckets over `bucket` rows are covered a second time on other bits; those still over it are cut into
    chunks, every pair of which is compared in a task of its own. So no task holds more than two chunks.
    """

    def heavy(rows: DataFrame, name: str) -> DataFrame:
        return stored(rows.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > bucket), name)

    def light_and_heavy(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
        hot = heavy(rows, name)
        n = hot.count()
        if not n:
            return rows, None
        hot = F.broadcast(hot) if n <= 10_000 else hot
        return rows.join(hot.select("g"), "g", "left_anti"), rows.join(hot, "g")

    first, hot = light_and_heavy(_tables(fps, covering_masks(radius)), "simhash-hot")
    if hot is not None:
        again, hot = light_and_heavy(_tables(hot, covering_masks(radius, stride=4), "g").distinct(), "simhash-hotter")
        first = first.unionByName(again)
        if hot is not None:
            k = F.ceil(F.col("n") / F.lit(bucket)).cast("int")
            own = F.pmod(F.xxhash64("fp"), k).cast("int")
            pair = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.xxhash64("g", F.least(own, j), F.greatest(own, j)))
            first = first.unionByName(hot.select(F.explode(pair).alias("g"), "fp"))
    rows = first.repartition("g").sortWithinPartitions("g", "fp")
    return rows.mapInPandas(_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component): for every row its fingerprint and the least id reachable over links of at most `radius` bits.

    Null ids count for no component; a component of null ids only has a null. Repeated rows come back as
    often as they came. An empty table gives an empty one. Other columns of docs are not read.
    """
    own = stored(fingerprints(docs, id_col, text_col, shingle), "simhash")
    reps = stored(own.groupBy("fp").agg(F.min("id").alias("least")), "simhash-reps")
    parts = connected_components(near_links(reps.select("fp"), radius), "a", "b")
    rooted = reps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stored(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select("fp", "component")
    return own.join(named, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs but for near duplicates: of each group the row of least id stays (of rows with that id, one).

    A row without an id takes part under a number made from its text, above 2^62 and so behind real ids.
    """
    made = F.lit(1 << 62) + F.xxhash64(text_col).bitwiseAND(F.lit((1 << 62) - 1))
    keyed = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), made))
    named = near_duplicates(keyed.select("__id", text_col), "__id", text_col, **how)
    stay = named.filter("id = component").select(F.col("id").alias("__id")).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    least = F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("r")
    return keyed.join(stay, "__id", "left_semi").groupBy("__id").agg(least).select("r.*")
