import random
import re

from pyspark.sql import functions as F

from veilspark.functions.spans import SPANS, find_all, mask_token, replace_spans, resolve_overlaps


def plain_resolve(spans):
    kept, last = [], -1
    for s in sorted(spans, key=lambda s: (s[0], -s[1], -s[3], s[4])):
        if s[0] >= last:
            kept.append(s)
            last = s[1]
        elif kept and s[1] > kept[-1][1] and s[3] > kept[-1][3]:
            kept[-1] = s
            last = s[1]
    return kept


def test_resolve_overlaps_against_a_loop(spark):
    rng = random.Random(3)
    lists = [[(a := rng.randint(0, 30), a + rng.randint(1, 12), "X", rng.choice([0.3, 0.5, 0.85, 1.0]), i) for i in range(rng.randint(0, 8))] for _ in range(1500)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], f"i int, s {SPANS}")
    got = {r["i"]: [tuple(x) for x in r["k"]] for r in df.select("i", resolve_overlaps(F.col("s")).alias("k")).collect()}
    assert all(got[i] == plain_resolve(x) for i, x in enumerate(lists))


def test_overlap_cases(spark):
    cases = [
        ([(0, 10, "A", 0.5, 0), (3, 14, "B", 0.9, 1)], ["B"]),  # reaches further with a better score
        ([(0, 10, "A", 0.5, 0), (3, 8, "B", 0.9, 1)], ["A"]),  # lies within, whatever its score
        ([(0, 5, "A", 0.5, 0), (5, 9, "B", 0.5, 1)], ["A", "B"]),
        ([(0, 5, "A", 0.5, 0), (0, 5, "A", 1.0, 1)], ["A"]),
        ([], []),
    ]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], f"i int, s {SPANS}")
    for r in df.select("i", resolve_overlaps(F.col("s")).alias("k")).collect():
        assert [x["entity_type"] for x in r["k"]] == cases[r["i"]][1]


def test_find_all_against_python(spark):
    rng = random.Random(5)
    alphabet = "ab1 2.\n@é😀Z"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for pattern in [r"[a-b]+\d", r"\d+", r"[a@]+|Z", r"(?i)z+a?", r"😀+"]:
        for r in df.select("i", find_all(F.col("t"), pattern).alias("m")).collect():
            if texts[r["i"]] is None:
                assert r["m"] is None
            else:
                want = [(m.start(), m.end(), m.group()) for m in re.finditer(pattern.replace("(?i)", ""), texts[r["i"]], re.I if "(?i)" in pattern else 0)]
                assert [tuple(x) for x in r["m"]] == want, (pattern, texts[r["i"]])


def test_replace_and_tokens(spark):
    df = spark.createDataFrame([("Call 😀 555 now", [(7, 10, "P", 1.0, 0)]), ("none", []), ("ab", [(0, 1, "A", 1.0, 0), (1, 2, "B", 1.0, 0)])], f"t string, s {SPANS}")
    rows = df.select(*[_masked(st) for st in ("LABEL", "BLACKOUT", "ASTERISK", "blackout")]).collect()
    assert list(rows[0]) == ["Call 😀 [P_MASKED] now", "Call 😀 ████████ now", "Call 😀 *** now", "Call 😀 [P_MASKED] now"]
    assert rows[1][0] == "none" and rows[2][0] == "[A_MASKED][B_MASKED]"
    upper = df.limit(1).select(mask_token(F.lit("P"), F.lit("blackout"), upper=True), mask_token(F.lit("P"), None, upper=True)).first()
    assert list(upper) == ["████████", "[P_MASKED]"]


def _masked(style):
    return replace_spans(F.col("t"), F.col("s"), lambda s: mask_token(s["entity_type"], style))
