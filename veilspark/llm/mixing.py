"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Each source's documents lie on a line in hashed order, cut into blocks of about equal word counts. A source's target
is so many whole passes over its line and a part of one more. Every pass goes through the blocks in a keyed
permutation of its own, and the last one ends where the target's words are drawn; so a source has a quota of slots,
each of which names a block. The tree halves the slots of all quotas again and again: how many of each source's go
left is drawn from the multivariate hypergeometric distribution. So every output shard gets an exact number of each
source's slots, disjoint blocks of a pass all of them, and a hash orders the documents within their shard.

Rows meet their block's draws by a window over both, so documents are shuffled once and nothing is broadcast that
grows with their number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import free_name, n_words, stored

#: Multipliers of the block permutations: primes, of which those that don't divide the number of blocks are coprime to it.
PRIMES = (1073741789, 1073741783, 1073741741, 1073741723, 1073741719, 1073741717, 1073741689, 1073741671)
#: Documents of a (source, hash range) group that one window sorts, on average over the largest source; rows that count as many.
GROUP_ROWS = 20_000
#: Levels of the tree that are grown by as many tasks as the level before has nodes.
LEVELS = 8


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in code-point order, null last; share and cap are times the size."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    cap: float = 2.0
    block_words: int = 4096
    shard_words: int = 1 << 22
    seed: int = 20


def source_targets(sizes: DataFrame, how: Mix) -> DataFrame:
    """sizes: (source, source_size). Adds idx, weight and target: the share by weight, capped, the excess reshared.

    The level at which weight times level meets the share is found at once: sources in order of cap/weight
    are full as long as the level left for the rest lies above their own.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in how.weights]), (F.col("idx") % len(how.weights) + 1).cast("int"))
    s = sizes.withColumn("idx", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    s = s.withColumn("full", how.cap * F.col("source_size"))
    by_level, everyone = Window.orderBy(F.col("full") / F.col("weight"), "idx"), Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = how.share * F.sum("source_size").over(everyone) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / rest)
    s = s.withColumn("open", F.col("level") * F.col("weight") <= F.col("full"))
    level = F.max(F.when(F.col("open"), F.col("level"))).over(everyone)
    s = s.withColumn("target", F.when(F.col("open"), F.least(level * F.col("weight"), F.col("full"))).otherwise(F.col("full")))
    return s.select("source", "source_size", "idx", "weight", "target")


def with_passes(targets: DataFrame) -> DataFrame:
    """Adds passes and rest (words of the last, partial pass)."""
    words, size = F.round("target").cast("long"), F.col("source_size")
    t = targets.withColumn("passes", F.when(size > 0, F.floor(words / size)).otherwise(0).cast("long"))
    return t.withColumn("rest", F.when(size > 0, words - F.col("passes") * size).otherwise(0).cast("long"))


def _log_factorial(x: Column) -> Column:
    small = F.array(*[F.lit(v) for v in (0.0, 0.0, 0.6931471805599453, 1.791759469228055, 3.1780538303479458, 4.787491742782046, 6.579251212010101, 8.525161361065415)])
    y = x.cast("double")
    large = (y + 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return F.when(x < 8, F.element_at(small, F.least(x, F.lit(7)).cast("int") + 1)).otherwise(large)


def _let(value: Column, of) -> Column:
    """of(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` out of `total` are among the `marked`, at probability u of its distribution.

    Sums over the range of 9 standard deviations about the mean; what lies outside is below the rounding of u.
    """
    lo, hi = F.greatest(F.lit(0), drawn + marked - total), F.least(drawn, marked)
    mean = drawn * marked / F.greatest(total, F.lit(1)).cast("double")
    var = mean * (1 - marked / F.greatest(total, F.lit(1))) * (total - drawn) / F.greatest(total - 1, F.lit(1))
    far = F.ceil(9 * F.sqrt(F.greatest(var, F.lit(0.0)))) + 9
    a, b = F.greatest(lo, (F.floor(mean) - far).cast("long")), F.least(hi, (F.ceil(mean) + far).cast("long"))
    mode = F.least(F.greatest(F.floor((drawn + 1.0) * (marked + 1.0) / (total + 2)).cast("long"), lo), hi)

    def log_weight(v: Column, x: Column) -> Column:
        return -(_log_factorial(x) + _log_factorial(v["k"] - x) + _log_factorial(v["n"] - x) + _log_factorial(v["t"] - v["k"] - v["n"] + x))

    def pick(v: Column) -> Column:
        weights = F.transform(F.sequence(v["a"], v["b"]), lambda x: F.exp(log_weight(v, x) - v["top"]))
        return _let(weights, lambda w: _let(F.aggregate(w, F.lit(0.0), lambda s, y: s + y) * v["u"], lambda part: F.least(v["a"] + below(w, part), v["b"])))

    def below(w: Column, part: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("c"), F.lit(0).cast("long").alias("k"))
        return F.aggregate(w, start, lambda s, y: F.struct((s["c"] + y).alias("c"), (s["k"] + F.when(s["c"] + y < part, 1).otherwise(0)).cast("long").alias("k")), lambda s: s["k"])

    v = F.struct(total.alias("t"), marked.alias("k"), drawn.alias("n"), a.alias("a"), b.alias("b"), mode.alias("mode"), u.alias("u"))
    v = _let(v, lambda v: v.withField("top", log_weight(v, v["mode"])))
    return F.when(lo >= hi, lo).otherwise(_let(v, pick))


def _step(seed: int, level: int):
    """Of the slots left, those of a source that go left; the rest of the node is drawn from next."""

    def step(s: Column, x: Column) -> Column:
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), x["idx"]), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        drawn = hypergeometric(s["total"], x["k"], s["drawn"], u).cast("long")
        return _let(drawn, lambda d: F.struct((s["total"] - x["k"]).alias("total"), (s["drawn"] - d).alias("drawn"), F.concat(s["out"], F.array(F.struct(x["idx"].alias("idx"), d.alias("l"), (x["k"] - d).alias("r")))).alias("out")))

    return step


def split_quotas(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """(idx, shard, lo, hi): the slots of a source that a shard gets, as a range of them. sources: (idx, slots); ranges that are empty have no row.

    shards is a power of two. Nodes hold a count for each source with slots and are halved level by level.
    """
    kind = "array<struct<idx:bigint,l:bigint,r:bigint>>"
    counts = F.array_sort(F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), F.col("slots").alias("k"))))
    nodes = sources.filter("slots > 0").agg(counts.alias("counts")).select(F.lit(0).cast("long").alias("node"), "counts")
    for level in range(shards.bit_length() - 1):
        if level and level % LEVELS == 0:
            nodes = nodes.repartition("node")
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x["k"])
        start = F.struct(total.alias("total"), F.floor(total / 2).cast("long").alias("drawn"), F.array().cast(kind).alias("out"))
        nodes = nodes.select("node", F.explode(F.array(F.aggregate("counts", start, _step(seed, level), lambda s: s["out"]))).alias("cut"))

        def side(bit: int, name: str) -> Column:
            some = F.filter(F.transform("cut", lambda x: F.struct(x["idx"].alias("idx"), x[name].alias("k"))), lambda x: x["k"] > 0)
            return F.struct((F.col("node") * 2 + bit).alias("node"), some.alias("counts"))

        nodes = nodes.select(F.explode(F.array(side(0, "l"), side(1, "r"))).alias("n")).select("n.*").filter(F.size("counts") > 0)
    each = nodes.select(F.col("node").alias("shard"), F.explode("counts").alias("x")).select("shard", "x.idx", "x.k")
    hi = F.sum("k").over(Window.partitionBy("idx").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("hi", hi).select("idx", "shard", (F.col("hi") - F.col("k")).alias("lo"), "hi")


def _position(block: Column, blocks: Column, source: Column, turn: Column, seed: int) -> Column:
    """Where a block of a source comes in its turn-th pass: a permutation of 0..blocks-1."""
    key = F.xxhash64(source, turn, F.lit(seed))
    fit = F.filter(F.array(*[F.lit(p) for p in PRIMES]), lambda p: blocks % p != 0)
    by = F.element_at(fit, (F.pmod(key, F.size(fit)) + 1).cast("int"))
    return F.pmod(block * (by % blocks) + F.pmod(F.xxhash64(key), blocks), blocks)


def _drawn_blocks(narrow: DataFrame, how: Mix) -> tuple[DataFrame, DataFrame]:
    """Of rows (source, part, h, size): draws (source, part, block, first, draws) of each block, and quotas (source, source_size, target).

    block counts within a (source, part); first is the words before it there; a draw is (pass, take, shard), take being the words of it.
    """
    sums = stored(narrow.groupBy("source", "part").agg(F.sum("size").alias("words")), "mix-sums")
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    quotas = stored(with_passes(source_targets(sizes, how)), "mix-quotas")
    blocks = narrow.withColumn("at", _before("h", "size")).withColumn("block", _block(how))
    blocks = stored(blocks.groupBy("source", "part", "block").agg(F.min("at").alias("first"), F.sum("size").alias("words")).filter("words > 0"), "mix-blocks")
    each = blocks.groupBy("source", "part").agg((F.max("block") + 1).alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.select(F.col("source").alias("s"), F.col("part").alias("p"), base.alias("base"), F.sum("n").over(Window.partitionBy("source")).alias("blocks"))
    q = quotas.select(F.col("source").alias("qs"), F.col("idx").cast("long").alias("idx"), "passes", "rest")
    blocks = blocks.join(each, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).join(q, F.col("source").eqNullSafe(F.col("qs"))).drop("s", "p", "qs")
    blocks = blocks.withColumn("no", F.col("base") + F.col("block"))
    # the last pass: blocks in its order until the words are drawn, summed in two steps so that a hot source is many groups
    blocks = blocks.withColumn("at", _position(F.col("no"), F.col("blocks"), F.col("idx"), F.col("passes"), how.seed))
    blocks = stored(blocks.withColumn("range", F.floor(F.col("at") / GROUP_ROWS)), "mix-order")
    ranges = blocks.groupBy("idx", "range").agg(F.sum("words").alias("w"))
    over = F.coalesce(F.sum("w").over(Window.partitionBy("idx").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.join(ranges.select("idx", "range", over.alias("over")), ["idx", "range"])
    before = F.coalesce(F.sum("words").over(Window.partitionBy("idx", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("over") - before))
    blocks = stored(blocks.withColumn("take", take.cast("long")).drop("over", "range"), "mix-takes")
    last = F.coalesce(F.max(F.when(F.col("take") > 0, F.col("at") + 1)), F.lit(0))
    slots = blocks.groupBy("idx").agg((F.first("passes") * F.first("blocks") + last).alias("slots"))
    slots = stored(slots, "mix-slots")
    n = slots.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    shards = 1 << max(0, -(-n * how.block_words // how.shard_words) - 1).bit_length()
    # a slot finds its shard in a range join on stretches of slots as long as a source's ranges are on average
    stretch = slots.select("idx", F.greatest(F.lit(1), F.floor(F.col("slots") / shards)).cast("long").alias("stretch"))
    ranges = split_quotas(slots, shards, how.seed).join(stretch, "idx")
    ranges = ranges.withColumn("stretch_no", F.explode(F.sequence(F.floor(F.col("lo") / F.col("stretch")), F.floor((F.col("hi") - 1) / F.col("stretch")))))
    turns = F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), lambda p: F.struct(p.cast("int").alias("pass"), F.when(p < F.col("passes"), F.col("words")).otherwise(F.col("take")).alias("take"), (p * F.col("blocks") + _position(F.col("no"), F.col("blocks"), F.col("idx"), p, how.seed)).alias("slot")))
    turns = blocks.select("source", "part", "block", "first", "idx", F.explode(F.filter(turns, lambda d: d["take"] > 0)).alias("d"))
    turns = turns.join(stretch, "idx").withColumn("stretch_no", F.floor(F.col("d.slot") / F.col("stretch"))).drop("stretch")
    met = turns.join(ranges.drop("stretch"), ["idx", "stretch_no"]).filter((F.col("d.slot") >= F.col("lo")) & (F.col("d.slot") < F.col("hi")))
    draw = F.struct(F.col("d.pass").alias("pass"), F.col("d.take").alias("take"), F.col("shard"))
    return stored(met.groupBy("source", "part", "block").agg(F.first("first").alias("first"), F.sort_array(F.collect_list(draw)).alias("draws")), "mix-draws"), quotas


def _before(*order: str) -> Column:
    """Words before a row in its (source, part)."""
    line = Window.partitionBy("source", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("size").over(line), F.lit(0))


def _block(how: Mix) -> Column:
    return F.floor(F.col("at") / how.block_words).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, how: Mix | None = None) -> DataFrame:
    """One row for each of docs: row (its columns), size, source_size, target, draws.

    draws holds a struct (pass, words, shard, place) for each time the mix takes the document, or the first
    words of it where a source's target ends within; sort a shard by place. A null source is a source of its
    own, the last; a null size counts 0 and is never taken; equal rows may swap places. Documents on the line
    are sorted in groups by source and range of hash, so a hot source is many groups, and so are rows that are
    equal in id and size if there are very many. No rows: no rows. Any other columns pass through.
    """
    how = how or Mix()
    size = n_words(F.col("text")) if size is None else size
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    rows = rows.withColumn("h", F.xxhash64("id", "size", F.lit(how.seed))).drop("id")
    alike = stored(rows.groupBy("source", "size", "h").agg(F.count("*").alias("n")), "mix-alike")  # a row for all equal ones: the line is laid from these
    n, most = alike.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    bits = min(max((n // GROUP_ROWS).bit_length(), 6), 20)
    if most > GROUP_ROWS:  # so many equal rows are dealt to places of their own; there are n / GROUP_ROWS such kinds at most
        heavy = alike.filter(F.col("n") > GROUP_ROWS).select("source", "size", "h", F.ceil(F.col("n") / GROUP_ROWS).alias("ways"))
        rows = stored(_dealt(rows, heavy, how.seed), "mix-dealt")  # both passes must see the same places
        alike = stored(rows.groupBy("source", "size", "h").agg(F.count("*").alias("n")), "mix-alike")
    part = F.shiftrightunsigned("h", 64 - bits)
    narrow = alike.select("source", part.alias("part"), "h", F.explode(F.array_repeat("size", F.col("n").cast("int"))).alias("size"))
    draws, quotas = _drawn_blocks(narrow, how)
    rows = rows.select("row", "source", part.alias("part"), "h", "size", F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("first"), F.lit(None).cast(draws.schema["draws"].dataType).alias("draws"))
    marks = draws.select(F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "source", "part", F.lit(None).cast("long").alias("h"), F.lit(0).cast("long").alias("size"), "block", "first", "draws")
    both = rows.unionByName(marks).withColumn("at", _before(F.col("h").asc_nulls_first(), "size"))
    both = both.withColumn("mark", F.col("block").isNotNull()).withColumn("block", F.coalesce("block", _block(how)))
    own = Window.partitionBy("source", "part").orderBy("block", F.desc("mark")).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.last(F.when(F.col("mark"), F.struct("block", "first", "draws")), ignorenulls=True).over(own)
    both = both.withColumn("of", mark).filter(~F.col("mark"))
    mine = F.when(F.col("of.block") == F.col("block"), F.col("of.draws")).otherwise(F.array().cast(draws.schema["draws"].dataType))
    left = F.col("at") - F.col("of.first")

    def draw(d: Column) -> Column:
        words = F.greatest(F.lit(0), F.least(F.col("size"), d["take"] - left)).cast("long")
        return F.struct(d["pass"].alias("pass"), words.alias("words"), d["shard"].alias("shard"), F.xxhash64(F.col("h"), d["pass"], F.lit(how.seed)).alias("place"))

    taken = both.withColumn("draws", F.filter(F.transform(mine, draw), lambda d: d["words"] > 0))
    return taken.join(quotas.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).select("row", "size", "source_size", "target", "draws")


def _dealt(rows: DataFrame, heavy: DataFrame, seed: int) -> DataFrame:
    """rows with other hashes, of as many kinds as ways says, for those in heavy."""
    h = heavy.select(F.col("source").alias("s_"), F.col("size").alias("n_"), F.col("h").alias("h_"), "ways")
    h = F.broadcast(h) if h.count() <= 10_000 else h
    met = rows.withColumn("turn", F.monotonically_increasing_id()).join(h, F.col("source").eqNullSafe(F.col("s_")) & (F.col("size") == F.col("n_")) & (F.col("h") == F.col("h_")), "left")
    other = F.when(F.col("ways").isNotNull(), F.xxhash64("h", F.pmod("turn", "ways"), F.lit(seed))).otherwise(F.col("h"))
    return met.withColumn("h", other).drop("turn", "s_", "n_", "h_", "ways")


def mixed_rows(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself, shard by shard and each shard in order of place: the columns of docs with __shard and __place.

    A row for each draw, cut where only its first words are taken. Where docs has columns of those names, underscores are added.
    """
    each = mixed.select("row", "size", F.explode("draws").alias("d"))
    # a piece ends where a word does, so the first pieces are the first words with the white space before them
    pieces = F.split(F.col(f"row.`{text_col}`"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, 1, F.col("d.words").cast("int")), "")
    text = F.when(F.col("d.words") < F.col("size"), cut).otherwise(F.col(f"row.`{text_col}`"))
    names = [f.name for f in mixed.schema["row"].dataType.fields]
    shard, place = free_name("__shard", names), free_name("__place", names)
    rows = each.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in names], F.col("d.shard").alias(shard), F.col("d.place").alias(place))
    return rows.repartition(shard).sortWithinPartitions(shard, place)
