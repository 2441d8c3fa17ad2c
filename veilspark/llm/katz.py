"""Katz backoff language models of any order, learned into partitioned tables and asked by blocks of tokens.

The model: p(w|h) is the discounted relative count of the n-gram where it was seen, else a(h) p(w|h'), h' being h
without its first word, recursing to the words alone, whose discounted mass belongs to words never seen. a(h) is
exact: what the n-grams of h leave over what the shorter n-grams of their words leave. Counts up to k are
discounted by Good-Turing. A text begins in a history of its own and ends in a token of its own.

Documents are gathered into blocks of tokens. A block asks for its distinct words, then for its distinct 2-grams,
then for its 3-grams, each time as packed sorted arrays. What it asks goes by the hash of the history to buckets
(a history so frequent that it would fill one is dealt by n-gram, its sums shared). A bucket adds up what is
brought to it and is stored as a row of that order's table. Where there are more buckets than `fan`, arrays pass
through radix nodes that merge some `fan` of them and split the result by the next digit, so no level makes more
than `fan` rows of a block, however many blocks and buckets there are, and no node holds much more than a block; answers come back the same way. Nothing
but sums and the frequent histories, whose number is bounded, comes to the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import drop_path, new_path, pack, pack_ints, partitions, release, trim, unpack, unpack_ints

#: Hash of no word: the end of a text.
END = 0x2D06800538D394C2
#: Hashes are positive numbers of 63 bits.
MASK = (1 << 63) - 1
#: Directories that a table is partitioned into, by range of the bucket.
PARTS = 64


@dataclass(frozen=True)
class Katz:
    order: int = 3
    k: int = 5
    #: Counts of counts up to this one are smoothed where Good-Turing needs it.
    smooth: int = 64
    block_tokens: int = 1 << 20
    bucket_tokens: int = 1 << 20
    #: Rows that a block or node is split into at once.
    fan: int = 256
    #: Histories with over N / most_hot tokens may be dealt by the n-gram; their sums, at most most_hot, come to the driver.
    most_hot: int = 1_000_000
    #: Words, of 16 bytes each, that are told apart at once before they are hashed; of whole texts.
    memory: int = 1 << 18


# ---- discounts ------------------------------------------------------------------------------------------------


def discounts(n: np.ndarray, k: int) -> tuple[np.ndarray, list[str]]:
    """(d[r] for counts r = 0..k, how each came about) from n[r], the number of n-grams counted r times.

    Good-Turing's r* is Turing's estimate; where that gives no discount within (0, 1], from that r on Simple
    Good-Turing's, of a line through log n[r] by log r (each n[r] shared among the empty counts around it, weighted
    by n[r]); where that gives none either, half a count is taken off. "turing", "smoothed" or "half" says which.
    """
    n = np.asarray(n, float)
    d, how = np.ones(k + 1), [""] * (k + 1)
    met = np.flatnonzero(n[1:] > 0) + 1
    slope = None
    if len(met) > 1:
        gap = np.concatenate([met[1:], [2 * met[-1] - met[-2]]]) - np.concatenate([[0], met[:-1]])
        slope = float(np.polyfit(np.log(met), np.log(n[met] / (gap / 2)), 1, w=np.sqrt(n[met]))[0])
        slope = slope if slope < -1 else None

    def part(r: int, line: bool) -> float | None:
        """r*/r less what the counts over k keep, over the same for the least count; None where out of range."""
        if line:
            if slope is None:
                return None
            share, cut = ((r + 1) / r) ** (slope + 1), (k + 1) ** (slope + 1)
        else:
            if len(n) < k + 2 or not (n[1] > 0 and n[r] > 0 and n[r + 1] > 0 and n[k + 1] > 0):
                return None
            share, cut = (r + 1) * n[r + 1] / (r * n[r]), (k + 1) * n[k + 1] / n[1]
        value = (share - cut) / (1 - cut) if cut < 1 else None
        return value if value is not None and 0 < value <= 1 else None

    line = False
    for r in range(1, k + 1):
        value = None if line else part(r, False)
        if value is None:
            line, value = True, part(r, True)
        d[r], how[r] = ((r - 0.5) / r, "half") if value is None else (value, "smoothed" if line else "turing")
    return d, how[1:]


def kept(d: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return d[np.where(count < len(d), count, 0)] * count


@dataclass(frozen=True)
class Unigrams:
    """N tokens of V words in learning; scale and unseen make the discounted mass of seen words and the rest add up to 1."""

    n: int
    v: int
    d: np.ndarray
    unseen: float
    scale: float

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.scale * kept(self.d, count) / max(1, self.n), self.unseen)


def unigrams(n: int, v: int, counts_of_counts: np.ndarray, k: int) -> Unigrams:
    d, _ = discounts(counts_of_counts, k)
    r = np.arange(k + 1)
    left = float(((1 - d) * r * np.asarray(counts_of_counts[: k + 1])).sum()) / n if n else 1.0
    unseen = max(left, 1 / (n + 1))
    return Unigrams(n, v, d, unseen, (1 - unseen) / (1 - left) if left < 1 else 0.0)


def factor(t: np.ndarray) -> np.ndarray:
    """What a discounted count is multiplied by: 1/total, or 1/(total + 1) where its counts would leave no mass. t: twice the total, plus 1 there."""
    return np.where(t > 0, 1 / np.maximum((t >> 1) + (t & 1), 1), 0.0)


# ---- the way to the buckets and back --------------------------------------------------------------------------


@dataclass(frozen=True)
class Radix:
    """How arrays sorted by bucket travel: at level 1..levels a node is a prefix of the bucket and, above the last, a group of sources."""

    buckets: int
    fan: int
    sources: int
    keys: int

    @property
    def levels(self) -> int:
        n = 1
        while self.fan**n < self.buckets:
            n += 1
        return n

    def width(self, level: int) -> int:
        """Buckets of a node. The first levels split as far as they may, so a node holds about as much as a source at every level."""
        return -(-self.buckets // self.fan**level)

    def groups(self, level: int) -> int:
        return 1 if level == self.levels else max(1, -(-self.sources // self.fan**level))

    def split(self, arrays: list[np.ndarray], src: int, level: int) -> Iterator[dict]:
        """Rows for the nodes of a level; arrays[0] is the bucket, ascending."""
        prefix = arrays[0] // self.width(level)
        at = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])) if len(prefix) else np.empty(0, np.int64)
        for s, cols in zip(at, freeze(arrays, self.keys, at)):
            node = int(prefix[s]) * self.groups(level) + src % self.groups(level)
            yield {"node": node, "src": src, "cols": cols}


def by_rank(keys: int) -> list[int]:
    """Columns in the order that rows are sorted by: the bucket, the history's words from the last back to the first, the word."""
    return [0, *range(keys - 1, 0, -1), keys]


def runs_of(columns: list[np.ndarray], ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows (ids: their ascending ids, else their places) by non-negative columns, the first counting most, and which of them, so ordered, differ from the one before.

    As many columns as fit are sorted as one number, with the row's id below them if there is room: sorting numbers takes
    a sixth of the time that sorting their places takes. Of what is left the next columns are sorted with the rank so far.
    """
    n, left = len(columns[0]), list(columns)
    order, new, rank = np.arange(n), np.zeros(n, bool), None
    below = order if ids is None or len(left) > 2 else ids
    new[:1] = True
    while left:
        key, bits = rank, 0 if rank is None else n.bit_length()
        while left:
            low, top = (int(left[0].min()), int(left[0].max())) if n else (0, 0)
            width = (top - low).bit_length()
            if width and bits + width > 63:
                break
            c = left.pop(0)
            if width:
                c = c.astype(np.int64, copy=False) - low if low else c.astype(np.int64, copy=False)
                key, bits = c if key is None else (key << width) | c, bits + width
        if key is None:  # nothing but constants
            continue
        room = int(below[-1]).bit_length() if n else 0
        if left and key is rank:  # a column too wide to go with the rank
            c = left.pop(0)
            order = np.lexsort((c, rank))
            c, key = c[order], rank[order]
            new[1:] = (key[1:] != key[:-1]) | (c[1:] != c[:-1])
        elif bits + room <= 63 and (not left or below is not ids):
            key = np.sort((key << room) | below)
            order, key = key & ((1 << room) - 1), key >> room
            new[1:] = key[1:] != key[:-1]
            if below is ids:
                return order, new
        else:
            order = np.argsort(key)
            key = key[order]
            new[1:] = key[1:] != key[:-1]
        if left:
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
    return order if ids is None else ids[order], new


def freeze(arrays: list[np.ndarray], keys: int, at: np.ndarray) -> Iterator[list[bytes]]:
    """Packed, the rows from each of at to the next; of sorted columns the differences within rows that agree in the columns before."""
    out, same = list(arrays), np.ones(len(arrays[0]), bool)
    same[at] = False
    for i in by_rank(keys):
        a = arrays[i]
        out[i] = a.copy()
        out[i][1:] -= np.where(same[1:], a[:-1], 0)
        same[1:] &= a[1:] == a[:-1]
    for s, e in zip(at, [*at[1:], len(same)]):
        yield [pack_ints(x[s:e]) for x in out]


def thaw(pieces: list, keys: int) -> tuple[list[np.ndarray], np.ndarray]:
    """What was packed, piece after piece, and the pieces' sizes."""
    first = [unpack_ints(x[0]) for x in pieces]
    sizes = np.array([len(x) for x in first])
    arrays = [np.concatenate(first), *(np.concatenate([unpack_ints(x[i]) for x in pieces]) for i in range(1, len(pieces[0])))]
    new = np.zeros(len(arrays[0]), bool)  # rows that start anew in the column
    new[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    for i in by_rank(keys):
        sums = np.cumsum(arrays[i])
        at = np.flatnonzero(new)
        arrays[i] = sums - np.repeat(sums[at] - arrays[i][at], np.diff(np.append(at, len(new))))
        new[1:] |= arrays[i][1:] != arrays[i][:-1]
    return arrays, sizes


ASK_SCHEMA = "node long, src long, cols array<binary>"
REPLY_SCHEMA = "node long, src long, reply array<binary>"
TABLE_SCHEMA = "part int, node long, cols array<binary>, v long, n long, few array<long>, srcs array<long>, places array<binary>"


def _in_frames(rows: Iterator[dict], columns: list[str], most: int = 256) -> Iterator[pd.DataFrame]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def merged(arrays: list[np.ndarray], keys: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows (bucket, keys.., n, others..) of many pieces: sorted distinct keys with n added up; the others are the same in all pieces where n
    is not 0. Also the place of each row."""
    order, new = runs_of([arrays[i] for i in by_rank(keys)])
    at = np.flatnonzero(new)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    first = order[at]
    out = [a[first] for a in arrays]
    out[1 + keys] = np.add.reduceat(arrays[1 + keys][order], at) if len(at) else arrays[1 + keys]
    return out, place


def _merge(radix: Radix, level: int, smooth: int, reply: bool):
    """A row of a node: what its sources brought, and where in it what each of them asked is (sources below 0 ask nothing)."""

    keys = radix.keys

    def run(p: pd.DataFrame) -> pd.DataFrame:
        trim()  # of the node before
        arrays, sizes = thaw(list(p["cols"]), keys)
        cols, place = merged(arrays, keys)
        del arrays
        srcs, places = [], []
        for src, x in zip(p["src"], np.split(place, np.cumsum(sizes)[:-1])):
            if reply and src >= 0:
                srcs.append(int(src))
                places.append(pack_ints(np.diff(x, prepend=0)))
        n = cols[1 + keys]
        few = np.bincount(n[(n > 0) & (n <= smooth + 1)], minlength=smooth + 2)
        node = int(p["node"].iloc[0])
        part = node * PARTS // radix.buckets if level == radix.levels else node % PARTS
        return pd.DataFrame([{"part": part, "node": node, "cols": next(freeze(cols, keys, np.zeros(1, np.int64))), "v": int((n > 0).sum()), "n": int(n.sum()), "few": few.tolist(), "srcs": srcs, "places": places}])

    return run


def _onward(radix: Radix, level: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for node, cols in zip(b["node"], b["cols"]):
                yield from _in_frames(radix.split(thaw([cols], radix.keys)[0], int(node), level), ["node", "src", "cols"])

    return run


def _sent_back(answer):
    """Rows for each source of a node; answer(row of the table) gives arrays over the node's keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                arrays = answer(r)
                rows = ({"node": r.node, "src": src, "reply": [_pack_reply(a[at]) for a in arrays]} for src, x in zip(r.srcs, r.places) for at in [np.cumsum(unpack_ints(x))])
                yield from _in_frames(rows, ["node", "src", "reply"])

    return run


def _pack_reply(a: np.ndarray) -> bytes:
    return pack_ints(a.view(np.int64) if a.dtype == np.float64 else a)


def _joined(p: pd.DataFrame) -> list[np.ndarray]:
    """The replies of a source's nodes, one after another."""
    p = p.sort_values("node")
    return [np.concatenate([unpack_ints(r[i]) for r in p["reply"]]) for i in range(len(p["reply"].iloc[0]))] if len(p) else []


def _passed_on(b: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
    if b.empty:
        return pd.DataFrame({"node": [], "src": [], "reply": []})
    got, r = _joined(p), b.iloc[0]
    rows = [{"node": r["node"], "src": src, "reply": [pack_ints(a[at]) for a in got]} for src, x in zip(r["srcs"], r["places"]) for at in [np.cumsum(unpack_ints(x))]]
    return pd.DataFrame(rows, columns=["node", "src", "reply"])


def _table(df: DataFrame, path: str, *by: str) -> DataFrame:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)  # of arrays that are compressed already
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Buckets:
    """The table of one order: asked by sources with `asks`, it holds sums and the way back to the sources."""

    def __init__(self, asks: DataFrame, radix: Radix, how: Katz, path: str, base: DataFrame | None = None, reply: bool = True):
        self.spark, self.levels = asks.sparkSession, []
        for level in range(1, radix.levels + 1):
            last = level == radix.levels
            if last and base is not None:  # what was learned before is one more source
                asks = asks.unionByName(base.select("node", F.lit(-1).cast("long").alias("src"), "cols"))
            rows = asks.groupBy("node").applyInPandas(_merge(radix, level, how.smooth, reply), TABLE_SCHEMA)
            if last:
                self.table = _table(rows, path, "part")
            else:
                self.levels.append(_table(rows, new_path(self.spark, "katz-nodes"), "part"))
                asks = self.levels[-1].select("node", "cols").mapInPandas(_onward(radix, level + 1), ASK_SCHEMA)

    def sums(self) -> tuple[int, int, int, np.ndarray]:
        """(tokens, distinct keys learned, most of them in one bucket, counts of counts)."""
        n, v, top = self.table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.max("v"), F.lit(0))).first()
        few = self.table.select(F.posexplode("few").alias("r", "x")).groupBy("r").agg(F.sum("x").alias("x")).collect()  # smooth + 2 rows
        return n, v, top, np.array([x for _, x in sorted(map(tuple, few))], np.int64)

    def replies(self, answer) -> DataFrame:
        """(src, node, reply) for the blocks that asked."""
        got = self.table.mapInPandas(_sent_back(answer), REPLY_SCHEMA)
        for nodes in reversed(self.levels):
            got = nodes.select("node", "srcs", "places").groupBy("node").cogroup(got.groupBy("src")).applyInPandas(_passed_on, REPLY_SCHEMA)
        return got


# ---- blocks ---------------------------------------------------------------------------------------------------


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words as UTF-8, the place in it of each text's words and, for its end, len of it; each text's tokens). As words_of has them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = pc.dictionary_encode(lists.flatten())
    codes, lens = words.indices.to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    empty = pc.index(words.dictionary, pa.scalar("", words.dictionary.type)).as_py()
    if empty >= 0:  # beside white space at either end of a text
        real = codes != empty
        lens = np.bincount(np.repeat(np.arange(len(lens)), lens)[real], minlength=len(lens))
        codes = codes[real]
    return words.dictionary, np.insert(codes, np.cumsum(lens), len(words.dictionary)), lens + 1


def _slices(b: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold some most bytes."""
    part = np.cumsum(pc.fill_null(pc.binary_length(b.column("t")), 0).to_numpy().astype(np.int64)) // most
    at = np.flatnonzero(np.diff(part, prepend=-1))
    for s, e in zip(at, [*at[1:], len(part)]):
        yield b.slice(s, e - s)


def _blocks(how: Katz):
    """Rows (block, tokens, ids, nulls, lens, train, vocab, code, codes) of many documents: sorted word hashes, the code of each, the tokens' codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        docs: list[tuple] = []  # ids, are they null, train, tokens of some documents, hashes of words, the tokens' places in these

        def row() -> pa.RecordBatch:
            ids, nulls, train, lens, hashes, codes = zip(*docs)
            vocab, place = np.unique(np.concatenate(hashes), return_inverse=True)
            starts = np.cumsum([0, *map(len, hashes)])
            codes = np.concatenate([place[s : s + len(x)][c] for s, x, c in zip(starts, hashes, codes)])
            n = np.bincount(codes, minlength=len(vocab))
            if not n.all():  # words of documents that went to another block
                codes, vocab, n = (np.cumsum(n > 0) - 1)[codes], vocab[n > 0], n[n > 0]
            code = np.empty(len(vocab), np.uint32)  # of each word of vocab: by falling frequency, as that packs best
            code[np.argsort(-n, kind="stable")] = np.arange(len(vocab))
            r = [uuid.uuid4().int >> 65, len(codes), pack_ints(np.concatenate(ids)), pack(np.concatenate(nulls)), pack(np.concatenate(lens)), pack(np.concatenate(train)), pack_ints(np.diff(vocab, prepend=0)), pack(code), pack(code[codes])]
            return pa.RecordBatch.from_pylist([dict(zip((c.split()[0] for c in BLOCK_SCHEMA.split(", ")), r))], pa.schema([(c.split()[0], {"long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in BLOCK_SCHEMA.split(", ")]))

        for b in batches:
            for part in _slices(b, 16 * how.memory):
                words, codes, lens = _tokens(part.column("t"))
                words = words.cast(pa.binary()).to_numpy(zero_copy_only=False)
                hashes = np.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), np.uint64(END))
                hashes = (hashes & np.uint64(MASK)).view(np.int64)
                ids, nulls = pc.fill_null(part.column("id"), 0).to_numpy(), part.column("id").is_null().to_numpy(zero_copy_only=False)
                train = part.column("train").to_numpy(zero_copy_only=False).astype(np.uint8)
                ends, s = np.cumsum(lens), 0
                while s < len(lens):  # up to the document that fills the block
                    done = ends[s - 1] if s else 0
                    e = min(len(lens), int(np.searchsorted(ends, done + how.block_tokens - size)) + 1)
                    docs.append((ids[s:e], nulls[s:e], train[s:e], lens[s:e], hashes, codes[done : ends[e - 1]]))
                    size += int(ends[e - 1] - done)
                    s = e
                    if size >= how.block_tokens:
                        yield row()
                        size = 0
                        docs.clear()
                        trim()
        if docs:
            yield row()

    return run


BLOCK_SCHEMA = "block long, tokens long, ids binary, nulls binary, lens binary, train binary, vocab binary, code binary, codes binary"


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of a hash of 63 bits."""
    return (hashes >> 31) * buckets >> 32


def _ask_words(radix: Radix):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                vocab, codes = np.cumsum(unpack_ints(r.vocab)), unpack(r.codes, np.uint32)
                learned = np.repeat(unpack(r.train, np.uint8).astype(bool), unpack(r.lens, np.int64))
                counts = np.bincount(codes[learned], minlength=len(vocab))[unpack(r.code, np.uint32)]
                yield from _in_frames(radix.split([_bucket_of(vocab, radix.buckets), vocab, counts], r.block, 1), ["node", "src", "cols"])

    return run


def _number_words(buckets: int):
    """Number (0: never learned) and count of a bucket's words; numbers of all buckets interleave, frequent words first."""

    def answer(r) -> list[np.ndarray]:
        counts = unpack_ints(r.cols[2])
        number, known = np.zeros(len(counts), np.int64), np.flatnonzero(counts > 0)
        number[known[np.argsort(-counts[known], kind="stable")]] = np.arange(len(known)) * buckets + r.node + 1
        return [number, counts]

    return answer


def _numbered(b: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
    """A block with the number (0: unknown) and count of the word of each code."""
    if b.empty:
        return pd.DataFrame({c.split()[0]: [] for c in NUMBERED_SCHEMA.split(", ")})
    r, code, by_code = b.iloc[0], unpack(b["code"].iloc[0], np.uint32), []
    for a in _joined(p):
        by_code.append(np.empty_like(a))
        by_code[-1][code] = a
    return pd.DataFrame([{"block": r.block, "ids": r.ids, "nulls": r.nulls, "lens": r.lens, "train": r.train, "codes": r.codes, "number": pack_ints(by_code[0]), "counts": pack_ints(by_code[1]), "got": []}])


NUMBERED_SCHEMA = "block long, ids binary, nulls binary, lens binary, train binary, codes binary, number binary, counts binary, got array<binary>"


def _mixed(cols: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(cols[0]), np.uint64)
    for c in cols:
        h = (h ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) & np.uint64(MASK)


@dataclass(frozen=True)
class Fitted:
    """What all tasks know of a model: word statistics and the discounts of each order from 2 on; sources: how those of each order came about."""

    uni: Unigrams
    top: int
    buckets: int
    hot: int
    d: tuple[np.ndarray, ...] = ()
    sources: tuple[list[str], ...] = field(default=(), compare=False)

    def lower(self, order: int, count: np.ndarray, t: np.ndarray) -> np.ndarray:
        """p of n-grams of the order before: by their count and their history's total (as factor takes it)."""
        return self.uni.p(count) if order == 2 else kept(self.d[order - 3], count) * factor(t)


class Block:
    """The distinct n-grams of a block, order after order, and what was answered of them.

    Numbers: up to top words, top + 1 all unknown words, top + 2 the history of a text's start; n-grams are held by
    the ranks of their numbers in the block. place[i] is where the n-gram that ends in token i is, -1 where its
    history was never learned or would begin before the start.
    """

    def __init__(self, r, fit: Fitted):
        self.fit, self.order = fit, 1
        self.lens, codes = unpack(r.lens, np.int64), unpack(r.codes, np.uint32)
        number, counts = unpack_ints(r.number), unpack_ints(r.counts)
        self.learned = np.repeat(unpack(r.train, np.uint8).astype(bool), self.lens)
        self.starts = np.cumsum(self.lens) - self.lens
        numbers = np.concatenate([number, [fit.top + 1, fit.top + 2]])  # the unknown words of the block, all 0, are never in an n-gram
        by = np.argsort(numbers, kind="stable")
        self.numbers = numbers[by]
        rank = np.empty_like(by)
        rank[by] = np.arange(len(rank))
        self.start = len(number) + 1  # as a rank it is the last, as an unknown word is the last but one
        self.word = np.where(number > 0, rank[:-2], len(number)).astype(np.int32)[codes]  # as whole numbers of 32 bits more of them stay near the CPU
        self.cols, self.place = [np.arange(len(numbers), dtype=np.int32)], self.word
        self.c, self.t = np.concatenate([counts, [0, fit.hot]])[by], np.zeros(len(numbers), np.int64)
        self.c[self.numbers == 0] = 0
        self.p = fit.uni.p(self.c)[self.word]

    def ask(self, send: bool = True) -> list[np.ndarray]:
        """The n-grams of the next order; to send: bucket, n numbers, times learned, whether dealt by n-gram, count and total below."""
        before = np.empty_like(self.place)
        before[1:] = self.place[:-1]
        before[self.starts] = self.start if self.order == 1 else -1
        asked = np.flatnonzero((self.c > 0)[before] & (before >= 0))
        history = before[asked]
        if self.order > 1:  # in the order that they are sorted by
            rank = np.empty(len(self.cols[0]), np.int32)
            rank[runs_of(self.cols[::-1])[0]] = np.arange(len(rank), dtype=np.int32)
            history = rank[history]
        order, new = runs_of([history, self.word[asked]], asked)
        at = np.flatnonzero(new)
        first = order[at]
        h, w = before[first], self.word[first]
        mixed = _mixed([self.numbers[c] for c in self.cols]).view(np.int64)  # of the history
        bucket = _bucket_of(mixed, self.fit.buckets).astype(np.uint16 if self.fit.buckets <= 1 << 16 else np.int64)[h]
        hot = (self.c >= self.fit.hot)[h]
        dealt = np.flatnonzero(hot)
        if len(dealt):
            bucket[dealt] = _bucket_of(_mixed([mixed[h[dealt]], self.numbers[w[dealt]]]).view(np.int64), self.fit.buckets)
        by = np.argsort(bucket, kind="stable")
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by), dtype=np.int32)
        own = self.place[first][by] if send else None
        self.place = np.full(len(self.place), -1, np.int32)
        self.place[order] = np.repeat(place, np.diff(np.append(at, len(new))))
        h, w = h[by], w[by]
        self.cols = [*(c[h] for c in self.cols), w]
        self.order += 1
        if not send:
            return []
        n = np.add.reduceat(self.learned[order], at, dtype=np.int64)[by] if len(at) else np.empty(0, np.int64)
        return [bucket[by].astype(np.int64), *[self.numbers[c] for c in self.cols], n, hot[by].astype(np.int64), self.c[own], self.t[own]]

    def take(self, c: np.ndarray, t: np.ndarray, back: np.ndarray) -> None:
        """What was answered: counts, totals of the histories, and where the count is 0 their backoff weight."""
        seen = np.append(kept(self.fit.d[self.order - 2], c) * factor(t), 0.0)
        back = np.append(np.where(c > 0, 0.0, back.view(np.float64)), 1.0)
        self.c, self.t = np.append(c, 0), np.append(t, 0)
        self.p = seen[self.place] + back[self.place] * self.p

    def retake(self, got) -> None:
        """All orders answered so far."""
        for i in range(0, len(got), 3):
            self.ask(send=False)
            self.take(*map(unpack_ints, got[i : i + 3]))


def _ask_grams(radix: Radix, fit: Fitted):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                block = Block(r, fit)
                block.retake(r.got)
                yield from _in_frames(radix.split(block.ask(), r.block, 1), ["node", "src", "cols"])
                del block
                trim()

    return run


def _histories(r, fit: Fitted, order: int):
    """(count, history of each n-gram, sums of count, discounted count and p below of each history, its numbers, is it hot) of a bucket."""
    cols = thaw([r.cols], order)[0]
    hs, c, hot, below_c, below_t = cols[1:order], *cols[order + 1 :]
    new = np.zeros(len(c), bool)
    new[:1] = True
    for h in hs:
        new[1:] |= h[1:] != h[:-1]
    at = np.flatnonzero(new)
    below = np.where(c > 0, fit.lower(order, below_c, below_t), 0.0)
    sums = np.stack([np.add.reduceat(x, at) for x in (c.astype(float), kept(fit.d[order - 2], c), below)], axis=1)
    return c, np.cumsum(new) - 1, sums, [h[at] for h in hs], hot[at] > 0


def _hot_sums(fit: Fitted, order: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                if not unpack_ints(r.cols[order + 2]).any():
                    continue
                _, _, sums, hs, hot = _histories(r, fit, order)
                yield pd.DataFrame({"h": pd.Series([list(x) for x in zip(*[h[hot].tolist() for h in hs])], dtype=object), "c": sums[hot, 0], "kept": sums[hot, 1], "p": sums[hot, 2]})

    return run


def _answer(fit: Fitted, order: int, shared: dict[tuple, tuple]):
    """Count, total and backoff weight of each n-gram of a bucket."""

    def answer(r) -> list[np.ndarray]:
        c, of, sums, hs, hot = _histories(r, fit, order)
        for i in np.flatnonzero(hot):
            sums[i] = shared[tuple(int(h[i]) for h in hs)]
        total = sums[:, 0]
        left = 1 - sums[:, 1] / np.maximum(total, 1)
        none_left = (left <= 1e-12) & (total > 0)
        left = np.where(none_left, 1 / (total + 1), left)
        back = np.where(total > 0, left / np.maximum(1 - sums[:, 2], 1e-12), 1.0)
        t = 2 * total.astype(np.int64) + none_left
        return [c, np.where(c > 0, t[of], 0), np.where(c > 0, 0.0, back[of])]

    return answer


def _taken(b: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
    """A block with the answers of one more order."""
    if b.empty:
        return b
    out = b.copy()
    out["got"] = [[*b["got"].iloc[0], *map(pack_ints, _joined(p) or [np.empty(0, np.int64)] * 3)]]
    return out


def _scored(fit: Fitted):
    def run(b: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        names = ["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if b.empty:
            return pd.DataFrame({c: [] for c in names})
        trim()  # of the block before
        r = next(b.itertuples())
        block = Block(r, fit)
        count = block.c[block.word]
        block.retake([*r.got, *map(pack_ints, _joined(p) or [np.empty(0, np.int64)] * 3)] if fit.d else [])
        base = np.log10((count + 1) / (fit.uni.n + fit.uni.v + 1))
        sums = [np.add.reduceat(x, block.starts) for x in ((count > 0).astype(np.int64), base, np.log10(block.p))]
        ids = pd.arrays.IntegerArray(unpack_ints(r.ids), unpack(r.nulls, np.bool_))
        train = unpack(r.train, np.uint8).astype(bool)
        return pd.DataFrame({"id": ids, "train": train, "n_tokens": block.lens, "n_known": sums[0], "train_tokens": fit.uni.n, "base_score": sums[1], "score": sums[2]})

    return run


SCORE_SCHEMA = "id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# ---- models ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """A model in the folder `path`: a table order=n for each n, partitioned by range of the bucket; what tasks know of it is `fitted`."""

    path: str
    how: Katz
    fitted: Fitted

    def table(self, spark: SparkSession, order: int) -> DataFrame:
        return spark.read.schema(TABLE_SCHEMA).parquet(f"{self.path}/order={order}").select("node", "cols")


def _run(docs: DataFrame, learn_from: Column, id_col: str, text_col: str, how: Katz, base: Model | None, path: str, reply: bool, keep: bool) -> tuple[Model, DataFrame | None]:
    """Learns from rows of docs or asks base, and with reply scores all of docs. Unless keep, tables go as soon as they aren't needed."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"), F.coalesce(learn_from, F.lit(True)).alias("train"))
    held: list[str] = []

    def cut(df: DataFrame, name: str) -> DataFrame:
        """df written; the table it came from is no longer needed."""
        to = new_path(spark, name)
        df.write.parquet(to)
        while held:
            drop_path(spark, held.pop())
        held.append(to)
        return spark.read.schema(df.schema).parquet(to)

    blocks = cut(rows.mapInArrow(_blocks(how), BLOCK_SCHEMA), "katz-blocks")
    tokens, sources = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    buckets = base.fitted.buckets if base else max(partitions(spark), -(-tokens // how.bucket_tokens))
    radix = Radix(buckets, how.fan, sources, 1)
    asks = blocks.select("block", "lens", "train", "vocab", "code", "codes").mapInPandas(_ask_words(radix), ASK_SCHEMA)
    words = Buckets(asks, radix, how, f"{path}/order=1", base.table(spark, 1) if base else None)
    release(spark)
    if base:
        fit = base.fitted
    else:
        n, v, top, few = words.sums()
        few = few if len(few) else np.zeros(how.smooth + 2)
        fit = Fitted(unigrams(n, v, few, how.k), top * buckets, buckets, max(1, n // (4 * buckets), n // how.most_hot), sources=(discounts(few, how.k)[1],))
    replies = words.replies(_number_words(buckets))
    blocks = cut(blocks.drop("vocab", "tokens").groupBy("block").cogroup(replies.groupBy("src")).applyInPandas(_numbered, NUMBERED_SCHEMA), "katz-numbered")
    release(spark)
    if not keep:
        drop_path(spark, f"{path}/order=1")
    scores = None
    for order in range(2, how.order + 1):
        radix = replace(radix, keys=order)
        asks = blocks.mapInPandas(_ask_grams(radix, fit), ASK_SCHEMA)
        grams = Buckets(asks, radix, how, f"{path}/order={order}", base.table(spark, order) if base else None, reply or order < how.order)
        release(spark)
        if not base:
            few = grams.sums()[3]
            d, sources_of = discounts(few if len(few) else np.zeros(how.smooth + 2), how.k)
            fit = replace(fit, d=(*fit.d, d), sources=(*fit.sources, sources_of))
        if not reply and order == how.order:
            break
        known = replace(fit, d=fit.d[: order - 1])
        hot = grams.table.select("cols").mapInPandas(_hot_sums(known, order), "h array<long>, c double, kept double, p double")
        hot = hot.groupBy("h").agg(*[F.sum(c).alias(c) for c in ("c", "kept", "p")]).collect()  # N / hot histories at most
        replies = grams.replies(_answer(known, order, {tuple(r["h"]): (r["c"], r["kept"], r["p"]) for r in hot}))
        both = blocks.groupBy("block").cogroup(replies.groupBy("src"))
        if order < how.order:
            blocks = cut(both.applyInPandas(_taken, NUMBERED_SCHEMA), f"katz-order-{order}")
            release(spark)
            if not keep:
                drop_path(spark, f"{path}/order={order}")
        else:
            scores = both.applyInPandas(_scored(known), SCORE_SCHEMA)
    if reply and how.order < 2:
        scores = blocks.groupBy("block").cogroup(replies.groupBy("src")).applyInPandas(_scored(fit), SCORE_SCHEMA)
    return Model(path, how, fit), scores


def katz_fit(docs: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", how: Katz | None = None, path: str | None = None) -> Model:
    """The model of the rows of docs that teach (null: they do), its tables written below path, by default in the session's shared folder."""
    how, path = how or Katz(), path or new_path(docs.sparkSession, "katz-model")
    rows = docs if learn_from is None else docs.filter(F.coalesce(learn_from, F.lit(True)))
    return _run(rows, F.lit(True), id_col, text_col, how, None, path, False, True)[0]


def katz_ask(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of rows that the model need not have seen, as katz_scores gives them; train is false throughout."""
    path = new_path(docs.sparkSession, "katz-asked")
    return _run(docs, F.lit(False), id_col, text_col, model.how, model, path, True, False)[1]


def katz_scores(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", how: Katz | None = None, path: str | None = None) -> DataFrame:
    """For each row of docs: id, train, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    The same as katz_fit and katz_ask, in one pass over the tables, which stay if a path is given. learn_from says which rows teach (null: they
    do). ASCII letters count in lower case, words part at ASCII white space; a null or empty text is its end alone.
    Repeated rows teach and are scored as often as they come. Where nothing is learned every token has probability
    1. An empty table gives an empty one. Columns but id and text are read only where learn_from names them.
    """
    how, to = how or Katz(), path or new_path(docs.sparkSession, "katz-model")
    return _run(docs, learn_from, id_col, text_col, how, None, to, True, path is not None)[1]
