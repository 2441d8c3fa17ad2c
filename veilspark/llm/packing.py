"""Packing documents into token windows by non-negative least squares over the histogram of lengths.

A document is cut into whole windows and a remainder. Remainders are binned by length, rounded up to `unit`.
On the driver, with one count for each bin: combinations of at most `depth` bins that fill the window exactly
are enumerated, their repeat counts solved by non-negative least squares against the histogram and rounded
down; what is left is packed greedily, remainders over half a window being cut at the half first. The plan
gives ranges of ranks within a bin to sequences, so each piece finds its place by its rank alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import stored, trim
from veilspark.llm.tokens import encode, vocabulary_path

#: Rows of a group that one window ranks, on average over the fullest bin.
GROUP_ROWS = 20_000


@dataclass(frozen=True)
class Packing:
    window: int = 2048
    unit: int = 8
    depth: int = 3
    end_id: int = 1

    @property
    def bins(self) -> int:
        return self.window // self.unit


def pieces(docs: DataFrame, how: Packing, id_col: str, text_col: str, path: str, keep_ids: bool) -> DataFrame:
    """(id, start, length, doc_tokens, crc, crc_a, crc_b[, ids], again): whole windows and the remainder of each document.

    again numbers equal pieces that come together, so that very many of them are dealt to many groups. crc_a and crc_b are those of the halves of a remainder over half a window, should the plan cut it there.
    """
    half = how.window // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, text in zip(b["id"], b["t"]):
                ids = np.append(encode(text, path), np.uint32(how.end_id)).astype("<u4")
                for s in range(0, len(ids), how.window):
                    part = ids[s : s + how.window]
                    long = half < len(part) < how.window
                    crc = [zlib.crc32(x.tobytes()) for x in (part, part[:half], part[half:])] if long else [zlib.crc32(part.tobytes()), 0, 0]
                    out.append((key, s, len(part), len(ids), *crc, *([part.tobytes()] if keep_ids else [])))
                if len(out) >= 5000:
                    yield told_apart(out)
                    out = []
            yield told_apart(out)
            trim()

    def told_apart(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=names)
        return frame.assign(again=frame.groupby(["id", "start", "crc"], dropna=False).cumcount() if len(frame) else [])

    names = ["id", "start", "length", "doc_tokens", "crc", "crc_a", "crc_b", *(["ids"] if keep_ids else [])]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in [*names[1:], "again"])
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).mapInPandas(run, schema)


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Non-decreasing tuples of at most depth bin numbers (1..bins) that add up to bins."""

    def of(total: int, least: int, slots: int) -> Iterator[tuple[int, ...]]:
        if total >= least:
            yield (total,)
        if slots > 1:
            for first in range(least, total // 2 + 1):
                yield from ((first, *rest) for rest in of(total - first, first, slots - 1))

    return list(of(bins, 1, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """The non-negative x of least |ax - b|, by the active-set method of Lawson and Hanson."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        slope = np.where(passive, -np.inf, a.T @ (b - a @ x))
        if slope.max() <= tol:
            break
        passive[slope.argmax()] = True
        while True:
            at = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            down = z <= 0
            step = np.min(x[at][down] / np.maximum(x[at][down] - z[down], 1e-300))
            x[at] += step * (z - x[at])
            gone = at[(x[at] <= 1e-12) & down]
            x[gone] = 0
            passive[gone] = False
            if not len(gone):
                passive[at[down]] = False
    return x


@dataclass
class Plan:
    """Segments (bin, first rank, end rank, first sequence, slot), and for each long bin how many of its ranks stay whole."""

    segments: np.ndarray
    whole: np.ndarray
    cut_at: np.ndarray
    rest_at: np.ndarray
    sequences: int


def plan(counts: np.ndarray, how: Packing) -> Plan:
    """counts[k]: pieces in bin k (1..bins). Work depends on the number of bins alone."""
    n, half = how.bins, how.bins // 2
    left, used = counts.astype(np.int64).copy(), np.zeros(n + 1, np.int64)
    segments: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(pattern: tuple[int, ...], times: int) -> None:
        nonlocal sequences
        for slot, k in enumerate(pattern):
            segments.append((k, used[k], used[k] + times, sequences, slot))
            used[k] += times
            left[k] -= times
        sequences += times

    if left[n]:
        place((n,), int(left[n]))
    options = [c for c in combinations(n, how.depth) if len(c) > 1 and all(left[k] for k in c)]
    if options:
        a = np.zeros((n, len(options)))
        for j, c in enumerate(options):
            for k in c:
                a[k, j] += 1
        scale = max(1, int(left.max()))
        times = np.floor(nnls(a[1:], left[1:n] / scale) * scale + 1e-6).astype(np.int64)
        for j in np.argsort(-times, kind="stable"):
            most = min(left[k] // options[j].count(k) for k in set(options[j]))
            if t := int(min(times[j], most)):
                place(options[j], t)
    whole, own = used.copy(), left.copy()
    cut_at, rest_at = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for k in range(half + 1, n):  # what no combination took is cut at half a window
        cut_at[k], rest_at[k] = used[half] + left[half], used[k - half] + left[k - half]
        left[half] += own[k]
        left[k - half] += own[k]
        left[k] = 0
    while left.any():
        pattern, room, free = [], n, left.copy()
        while room and len(fit := np.flatnonzero(free[: room + 1])):
            k = int(fit[-1])
            m = min(room // k, int(free[k]))
            pattern += [k] * m
            free[k] -= m
            room -= m * k
        place(tuple(pattern), int(min(left[k] // pattern.count(k) for k in set(pattern))))
    at = np.array(segments, np.int64).reshape(-1, 5)
    return Plan(at[np.lexsort((at[:, 1], at[:, 0]))], whole, cut_at, rest_at, sequences)


def _placed(p: Plan, how: Packing, keep_ids: bool):
    half = how.window // 2
    span = int(p.segments[:, 2].max(initial=0)) + 1
    keys = p.segments[:, 0] * span + p.segments[:, 1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cut = (b["rank"].to_numpy() >= p.whole[b["bin"].to_numpy()]) & (b["length"].to_numpy() > half) & (b["length"].to_numpy() < how.window)
            first, second = b[cut].copy(), b[cut].copy()
            over = (first["rank"] - p.whole[first["bin"]]).to_numpy()
            first["rank"], second["rank"] = over + p.cut_at[first["bin"]], over + p.rest_at[first["bin"]]
            second["start"], second["length"], second["bin"] = second["start"] + half, second["length"] - half, second["bin"] - how.bins // 2
            first["length"], first["bin"], first["crc"], second["crc"] = half, how.bins // 2, first["crc_a"], second["crc_b"]
            if keep_ids:
                first["ids"], second["ids"] = [x[: 4 * half] for x in first["ids"]], [x[4 * half :] for x in second["ids"]]
            all_ = pd.concat([b[~cut], first, second])
            at = np.searchsorted(keys, all_["bin"].to_numpy() * span + all_["rank"].to_numpy(), "right") - 1
            all_["sequence_id"] = p.segments[at, 3] + all_["rank"].to_numpy() - p.segments[at, 1]
            all_["slot"] = p.segments[at, 4]
            yield all_[columns]

    columns = ["id", "start", "length", "doc_tokens", "crc", "sequence_id", "slot", *(["ids"] if keep_ids else [])]
    return run


def pack(docs: DataFrame, how: Packing | None = None, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, crc (of its little-endian 32-bit ids), doc_tokens, sequence_id, offset, with keep_ids also ids.

    A null or empty text is its end id alone. Repeated rows are packed as often as they come, null ids like
    others. An empty table gives an empty result. Only id and text are read.
    """
    how = how or Packing()
    path = path or vocabulary_path("byte_bpe_50k.tiktoken")
    own = stored(pieces(docs, how, id_col, text_col, path, keep_ids), "pack-pieces")
    rows = own.withColumn("bin", F.ceil(F.col("length") / how.unit).cast("long")).withColumn("h", F.xxhash64("id", "start", "crc", "again"))
    groups = 1 << min(max((own.count() // GROUP_ROWS).bit_length(), 6), 20)
    rows = rows.withColumn("part", F.pmod("h", F.lit(groups)).cast("int")).drop("h", "again")
    sums = stored(rows.groupBy("bin", "part").agg(F.count("*").alias("n")), "pack-counts")
    counts = np.zeros(how.bins + 1, np.int64)
    for r in sums.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most one row for each bin
        counts[r["bin"]] = r["n"]
    p = plan(counts, how)
    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("bin", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    each = Window.partitionBy("bin", "part").orderBy("id", "start", "crc")
    ranked = rows.withColumn("rank", F.row_number().over(each) - 1).join(bases, ["bin", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")
    kind = dict(own.dtypes)["id"]
    schema = f"id {kind}, start long, length long, doc_tokens long, crc long, sequence_id long, slot long" + ", ids binary" * keep_ids
    placed = ranked.mapInPandas(_placed(p, how, keep_ids), schema)
    within = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))).drop("slot")
