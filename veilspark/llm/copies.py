"""Near copies by exact Jaccard similarity of word shingles: a set-similarity join with prefix filtering.

All shingles have one order, common ones last. Two sets of similarity t or more share one of their first
n - ceil(t n) + 1 shingles, so every such pair meets under a shingle and none is lost. Pairs that meet are
first held against the part of their shingles that hash below a quarter of the range: where that part alone
differs more than similar sets may, the pair is out, for certain. The rest is verified on the whole sets. Under a
shingle of many texts a star and a chain are verified first; only where texts are still unconnected are all of
them compared, in pairs of chunks. Those too are compared by parts of their shingles, and only the texts of pairs that
may be similar are verified as a whole; shingles of the same texts count once. Where most pairs of chunks may be
similar, a forest of them is verified, and what that leaves unconnected is compared as whole sets, chunk by chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import discard, free_name, release, stored, trim, words_of
from veilspark.llm.components import connected_components
from veilspark.llm.simhash import fingerprint_hashes, near_links, simhash
from veilspark.llm.sketch import WordHashes, shingle_hashes


@dataclass(frozen=True)
class Copies:
    """similarity is the least Jaccard similarity of the sets of `shingle` words; the rest bounds memory and sets the order only."""

    shingle: int = 5
    similarity: float = 0.8
    #: Texts that the order of shingles is learned from, and shingles counted as common.
    sample: int = 20_000
    common: int = 200_000
    #: Texts under a shingle all pairs of which are candidates at once; texts of a chunk.
    small: int = 16
    chunk: int = 1024
    #: Pairs for each text of two chunks up to which all that may be similar are verified one by one.
    dense: int = 32
    #: Distinct words whose hashes a Python worker remembers.
    memory: int = 1 << 18


def shingle_set(text: str | None, how: Copies, seen: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a whole text's shingles; none for a wordless text."""
    words = words_of(text)
    return np.unique(shingle_hashes(np.fromiter(map(seen.__getitem__, words), np.uint64, len(words)), how.shingle))


def probe(h: np.ndarray) -> np.ndarray:
    """Of a shingle set the hashes below a quarter of the range, cut to 32 bits: may make two alike, never one two."""
    return (h[: np.searchsorted(h, np.uint64(1 << 62))] >> np.uint64(30)).astype(np.uint32)


def may_be_similar(a: np.ndarray, b: np.ndarray, n: int, m: int, how: Copies) -> bool:
    """False only if sets of n and m shingles with probes a and b differ too much: what differs in a part differs in the whole."""
    differ = len(a) + len(b) - np.isin(a, b).sum() - np.isin(b, a).sum()
    return differ <= (1 - how.similarity) / (1 + how.similarity) * (n + m) + 1e-9


def needed(n, how: Copies):
    return np.ceil(how.similarity * n - 1e-9)


def similar(a: np.ndarray, b: np.ndarray, how: Copies) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= how.similarity * (len(a) + len(b) - both) - 1e-9


def _common(own: DataFrame, how: Copies) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found more than once in a sample of own (k, t), sorted, and how often."""
    share = min(1.0, how.sample / max(1, own.count()))
    drawn = own.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int((1 << 30) * share)).select("t")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHashes(how.memory)
        for b in batches:
            for t in b["t"]:
                yield pd.DataFrame({"h": shingle_set(t, how, seen).view(np.int64)})

    counts = drawn.mapInPandas(each, "h long").groupBy("h").count().filter("count > 2").orderBy(F.desc("count"), "h").limit(how.common).toPandas()
    counts = counts.assign(u=counts["h"].to_numpy(np.int64).view(np.uint64)).sort_values("u")
    return counts["u"].to_numpy(np.uint64), counts["count"].to_numpy(np.int64)


def _prefixes(common: np.ndarray, times: np.ndarray, how: Copies, fp: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHashes(how.memory)
        for b in batches:
            rows = []
            for t in b["t"]:
                h = shingle_set(t, how, seen)
                c = np.zeros(len(h), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    c = np.where(common[at] == h, times[at], 0)
                take = int(len(h) - needed(len(h), how) + 1) if len(h) else 0
                first = h[np.lexsort((h, c))[:take]]
                rows.append((np.int64(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64)), len(h), first.view(np.int64), probe(h).tobytes(), simhash(fingerprint_hashes(t)) if fp else 0))
            s, n, prefix, part, f = zip(*rows) if rows else ((), (), (), (), ())
            yield pd.DataFrame({"k": b["k"], "i": b["i"], "s": np.array(s, np.int64), "n": np.array(n, np.int32), "prefix": pd.Series(prefix, dtype=object, index=b.index), "probe": pd.Series(part, dtype=object, index=b.index), "fp": np.array(f, np.int64)})
            del rows, prefix, part, b
            trim()

    return run


def _candidates(how: Copies):
    """Of rows (g, s, n, p) sorted by g: pairs (a, b) that may be similar, and a row with big for each large group."""

    def of(g: np.ndarray, s: np.ndarray, n: np.ndarray, p: np.ndarray) -> pd.DataFrame:
        at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
        size = np.diff(np.append(at, len(g)))
        x, y, large = [], [], at[size > how.small]
        for d in range(1, how.small):  # all pairs of the small groups, by distance
            start = np.repeat(at, np.maximum(size - d, 0) * (size <= how.small))
            times = np.maximum(size - d, 0) * (size <= how.small)
            first = start + np.arange(len(start)) - np.repeat(np.cumsum(times) - times, times)
            x.append(first)
            y.append(first + d)
        x, y = np.concatenate(x), np.concatenate(y)
        # the first common shingle at these places leaves enough others
        rest = 1 + np.minimum(n[x] - p[x], n[y] - p[y]) - 1
        ok = rest >= how.similarity / (1 + how.similarity) * (n[x] + n[y]) - 1e-9
        x, y = x[ok], y[ok]
        for k, m in zip(large, size[size > how.small]):
            i = np.arange(k + 1, k + m)
            x, y = np.concatenate([x, np.full(m - 1, k), i[:-1]]), np.concatenate([y, i, i[1:]])
        pairs = np.unique(np.sort(np.stack([s[x], s[y]], axis=1), axis=1), axis=0) if len(x) else np.empty((0, 2), np.int64)
        pairs = pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "g": np.int64(0), "big": False})
        return pd.concat([pairs, pd.DataFrame({"a": np.int64(0), "b": np.int64(0), "g": g[large], "big": True})])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.empty(0, np.int64)] * 4
        for b in batches:
            held = [np.append(h, b[c].to_numpy(np.int64)) for h, c in zip(held, "gsnp")]
            done = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last group may go on
            yield of(*[h[:done] for h in held])
            held = [h[done:] for h in held]
        yield of(*held)

    return run


def _likely(how: Copies):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [may_be_similar(np.frombuffer(v, np.uint32), np.frombuffer(w, np.uint32), n, m, how) for v, w, n, m in zip(b["va"], b["vb"], b["na"], b["nb"])]
            yield b.loc[np.array(ok, bool), ["a", "b"]]

    return run


def _verify(how: Copies):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [similar(np.frombuffer(v, np.uint64), np.frombuffer(w, np.uint64), how) for v, w in zip(b["va"], b["vb"])]
            yield b.loc[np.array(ok, bool), ["a", "b"]]

    return run


def _alike(how: Copies):
    """Pairs of a group with other labels that may be similar; where these are very many, a forest of them and a row with big."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.drop_duplicates("s").sort_values(["n", "s"]).reset_index(drop=True)
        n, s, label, joined = p["n"].to_numpy(np.int64), p["s"].to_numpy(), p["label"].to_numpy(), p["label"].to_numpy().copy()
        parts = [np.unique(np.frombuffer(v, np.uint32)) for v in p["v"]]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(size)
        starts, at = ends - size, np.unique(np.concatenate(parts), return_inverse=True)[1].astype(np.int32)
        mark = np.zeros(at.max(initial=-1) + 1, bool)
        most, pairs, forest = how.dense * len(p), [], []
        held = 0
        for i in range(1, len(p)):
            first = int(np.searchsorted(n, needed(n[i], how)))
            there = first + np.flatnonzero(label[first:i] != label[i])
            if not len(there):
                continue
            own = at[starts[i] : ends[i]]
            mark[own] = True
            both = np.append(0, np.cumsum(mark[at[starts[first] : starts[i]]]))
            mark[own] = False
            both = both[ends[there] - starts[first]] - both[starts[there] - starts[first]]
            near = there[size[there] + size[i] - 2 * both <= (1 - how.similarity) / (1 + how.similarity) * (n[there] + n[i]) + 1e-9]
            held += len(near)
            if held <= most:
                pairs.extend((s[i], s[j]) for j in near)
            for j in near:
                if joined[j] != joined[i]:
                    forest.append((s[i], s[j]))
                    joined[joined == joined[j]] = joined[i]
        found = np.sort(np.array(pairs if held <= most else forest, np.int64).reshape(-1, 2), axis=1)
        out = pd.DataFrame({"a": found[:, 0], "b": found[:, 1], "g": np.int64(0), "big": False})
        big = pd.DataFrame({"a": [0], "b": [0], "g": [p["g"].iloc[0]], "big": [True]})
        return out if held <= most else pd.concat([out, big])

    return run


def _compare(how: Copies):
    """Links that join all similar sets of a group whose labels differ."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.drop_duplicates("s").reset_index(drop=True)
        sets = [np.frombuffer(v, np.uint64) for v in p["v"]]
        n = np.array([len(x) for x in sets])
        label, s, out = p["label"].to_numpy().copy(), p["s"].to_numpy(), []
        at = np.unique(np.concatenate(sets), return_inverse=True)[1]
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        for i in range(len(p)):
            if (label == label[i]).all():
                continue
            mark = np.zeros(at.max() + 1, np.int64)
            mark[at[starts[i] : starts[i] + n[i]]] = 1
            both = np.add.reduceat(mark[at], starts)
            for j in np.flatnonzero((both >= how.similarity * (n + n[i] - both) - 1e-9) & (label != label[i])):
                if label[j] != label[i]:
                    out.append((s[i], s[j]))
                    label[label == label[j]] = label[i]
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    return run


def similar_links(reps: DataFrame, texts_of, how: Copies) -> DataFrame:
    """(a, b): links that join all sets of reps (s, n, prefix, probe) of enough similarity; texts_of gives (s, t) for a table of s."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHashes(how.memory)
        for b in batches:
            yield pd.DataFrame({"s": b["s"], "v": [shingle_set(t, how, seen).tobytes() for t in b["t"]]})
            trim()

    def sets_of(who: DataFrame, name: str) -> DataFrame:
        return stored(texts_of(who).mapInPandas(packed, "s long, v binary").groupBy("s").agg(F.first("v").alias("v")), name)

    def both(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
        for e in "ab":
            pairs = pairs.join(of.select(F.col("s").alias(e), *[F.col(c).alias(f"{c}{e}") for c in columns]), e)
        return pairs

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct(), "copies-sets")
        release(reps.sparkSession)
        links = stored(both(pairs, sets, "v").mapInPandas(_verify(how), "a long, b long"), name)
        discard(sets)
        return links

    def labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
        parts = connected_components(links, "a", "b").select(F.col("node").alias("s"), "root")
        return rows.join(parts, "s", "left").select("g", "s", F.coalesce("root", "s").alias("label"))

    def unconnected(rows: DataFrame, *of: Column) -> DataFrame:
        labels = rows.groupBy("g").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"), *of)
        return labels.filter("lo < hi").drop("lo", "hi")

    rows = reps.select("s", "n", F.posexplode("prefix").alias("p", "g"))
    met = stored(rows.repartition("g").sortWithinPartitions("g", "s").mapInPandas(_candidates(how), "a long, b long, g long, big boolean"), "copies-met")
    probes = reps.select("s", "n", F.col("probe").alias("v"))
    pairs = stored(both(met.filter("not big").select("a", "b").distinct(), probes, "n", "v").select("a", "b", F.col("na"), F.col("nb"), F.col("va"), F.col("vb")).mapInPandas(_likely(how), "a long, b long"), "copies-pairs")
    links = verified(pairs, "copies-links")
    big = met.filter("big").select("g")
    if not big.count():
        return links
    hot = stored(labelled(rows.join(big, "g"), links), "copies-hot")
    # shingles of the same texts are one group
    who = [F.bit_xor(F.xxhash64("s", F.lit(i))).alias(f"x{i}") for i in range(2)]
    still = stored(unconnected(hot, *who).groupBy("m", "x0", "x1").agg(F.min("g").alias("g")).select("g", "m"), "copies-still")
    k = F.ceil(F.col("m") / F.lit(how.chunk)).cast("int")
    own = F.pmod(F.xxhash64("s"), k).cast("int")
    pair = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.xxhash64("g", F.least(own, j), F.greatest(own, j)))
    dealt = hot.join(still, "g").select(F.explode(pair).alias("g"), "s", "label")
    alike = stored(dealt.join(probes, "s").groupBy("g").applyInPandas(_alike(how), "a long, b long, g long, big boolean"), "copies-alike")
    release(reps.sparkSession)
    links = links.unionByName(verified(alike.filter("not big").select("a", "b").distinct(), "copies-more"))
    dense = alike.filter("big").select("g")
    if dense.count():
        left = stored(labelled(dealt.drop("label").join(dense, "g"), links), "copies-dense")
        open_ = left.join(unconnected(left).select("g"), "g")
        sets = sets_of(open_.select("s").distinct(), "copies-open")
        release(reps.sparkSession)
        links = links.unionByName(stored(open_.join(sets, "s").groupBy("g").applyInPandas(_compare(how), "a long, b long"), "copies-rest"))
        discard(sets, left)
    discard(hot, still, alike, met)
    return links


def _fingerprint_links(own: DataFrame) -> DataFrame:
    """(a, b): links between sets of own (s, fp) of equal fingerprints or of such within the radius."""
    least = stored(own.groupBy("fp").agg(F.min("s").alias("least")), "copies-fingerprints")
    same = own.select("s", "fp").distinct().join(least, "fp").filter("s <> least").select(F.col("s").alias("a"), F.col("least").alias("b"))
    end = {e: least.select(F.col("fp").alias(f"f{e}"), F.col("least").alias(e)) for e in "ab"}
    near = near_links(least.select("fp")).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    return same.unionByName(near.join(end["a"], "fa").join(end["b"], "fb").select("a", "b"))


def keep_one_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Copies | None = None, fingerprints: bool = False) -> DataFrame:
    """Of each group of near copies one row, of least id; rows without an id come last, and equal ids go by a digest of the text.

    Two texts of one id are two documents. Texts without words count as copies of one another. With
    fingerprints, texts whose SimHashes (of op4) lie within its radius are linked too.
    """
    how = how or Copies()
    kind, one, text = docs.schema[id_col].dataType.simpleString(), F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")
    key = F.md5(F.concat(F.coalesce(one, F.lit("")), F.lit("\0"), F.coalesce(text, F.lit(""))))
    key_col = free_name("__key", docs.columns)
    keyed = docs.withColumn(key_col, key)
    own = keyed.select(F.col(key_col).alias("k"), one.alias("i"), text.alias("t"))
    own = stored(own.mapInPandas(_prefixes(*_common(own, how), how, fingerprints), "k string, i string, s long, n int, prefix array<long>, probe binary, fp long"), "copies")
    least = F.min(F.struct(F.col("i").isNull().alias("none"), F.col("i").cast(kind).alias("i"), "k")).alias("least")
    names = stored(own.groupBy("s").agg(least), "copies-names")
    reps = stored(own.groupBy("s").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("probe").alias("probe")), "copies-reps")
    fps = stored(own.select("s", "fp").distinct(), "copies-prints") if fingerprints else None
    discard(own)

    def texts_of(who: DataFrame) -> DataFrame:
        wanted = names.join(who, "s").select(F.col("least.k").alias(key_col), "s")
        return keyed.select(key_col, text.alias("t")).join(wanted, key_col).select("s", "t")

    links = similar_links(reps, texts_of, how)
    discard(reps)
    if fingerprints:
        links = links.unionByName(_fingerprint_links(fps))
    parts = connected_components(links, "a", "b")
    rooted = names.join(parts.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    stay = stored(rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.k").alias(key_col)), "copies-stay")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("r")
    return keyed.join(stay, key_col, "left_semi").groupBy(key_col).agg(row).select("r.*")
