from pyspark.sql import functions as F

from veilspark.functions.language import resolve_language
from veilspark.operators.engine import Policy, detect, mask, sanitize, scan, synthesize, valid_pattern
from veilspark.operators.recognizers import DEFAULT_ENTITIES, RECOGNIZERS, pack


def found(spark, text, policy=None, lines=None):
    df = spark.createDataFrame([(text, lines)], "t string, l array<struct<start:int,end:int>>")
    r = df.select(detect(F.col("t"), policy, None, F.col("l") if lines else None).alias("s")).first()["s"]
    return [(x["entity_type"], text[x["start"] : x["end"]]) for x in r]


def test_registry():
    assert len(RECOGNIZERS) >= 13 and [r.entity for r in RECOGNIZERS].count("PAN_CARD") == 2
    assert pack("nowhere") == [] and len(pack("india")) == 4 and len(DEFAULT_ENTITIES) == 16
    assert {r.entity for r in RECOGNIZERS} | {"PERSON"} == set(DEFAULT_ENTITIES)


def test_contact_line_and_brand_words(spark):
    text = "Prometheus, Java, NumPy and Tailwind CSS | priya@example.com | +91 98765 43210"
    assert found(spark, text) == [("EMAIL_ADDRESS", "priya@example.com"), ("PHONE_NUMBER", "+91 98765 43210")]


def test_persons(spark):
    assert ("PERSON", "Priya Examplewala") in found(spark, "Name: Priya Examplewala")
    assert ("PERSON", "Sarah Johnson") in found(spark, "Prepared by: Sarah Johnson")
    assert found(spark, "Contact John Smith today") == [("PERSON", "John Smith")]
    assert found(spark, "Contact Support Team") == []
    assert found(spark, "powered by Tailwind Css") == []
    line = [{"start": 0, "end": 17}]
    assert found(spark, "Priya Examplewala writes", lines=line) == [("PERSON", "Priya Examplewala")]
    assert found(spark, "Job Description here", Policy(["PERSON"]), [{"start": 0, "end": 15}]) == []


def test_codes(spark):
    p = Policy(["ICD10_CODE"])
    assert [x for _, x in found(spark, "E11.9 and S72.301A then F41, not B2B or C3PO", p)] == ["E11.9", "S72.301A", "F41"]


def test_span_trim(spark):
    df = spark.createDataFrame([("Ref DE 136 695 976 S here",), ("ATU57194903X end",)], "text string")
    assert [r["redacted"] for r in mask(df).collect()] == ["Ref [EU_VAT_MASKED] S here", "[EU_VAT_MASKED]X end"]


def test_custom_patterns(spark):
    p = Policy([], custom=[("EMP", r"EMP-\d{5}"), ("BAD", "(")])
    assert found(spark, "EMP-12345 emp-12345 EMP-54321", p) == [("EMP", "EMP-12345"), ("EMP", "EMP-54321")]
    assert not valid_pattern("(") and valid_pattern("a+")


def test_blank_null_and_long_texts(spark):
    long = "word " * 200_000 + "a@example.com"
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \t "), (4, long)], "id int, text string")
    rows = {r["id"]: r for r in mask(df, policy=Policy(["EMAIL_ADDRESS"])).collect()}
    assert [rows[i]["found"] for i in (1, 2, 3, 4)] == [False, False, False, True]
    assert rows[1]["redacted"] is None and rows[3]["redacted"] == " \t "
    assert rows[4]["redacted"].endswith("word [EMAIL_ADDRESS_MASKED]")


def test_scan_projects_no_text(spark):
    df = spark.createDataFrame([("a@example.com b@example.com",), ("x",)], "text string")
    s = scan(df, policy=Policy(["EMAIL_ADDRESS"]))
    assert [(r["action"], r["count"], r["types"]) for r in s.collect()] == [("BLOCK", 2, ["EMAIL_ADDRESS"]), ("ALLOW", 0, [])]


def test_synthesize_is_seeded_and_typed(spark):
    df = spark.createDataFrame([("Name: Sarah Johnson, 4111 1111 1111 1111, MRN 12345, AADHAAR 2345 6789 0124",)], "text string")
    a, b = synthesize(df).first()["redacted"], synthesize(df).first()["redacted"]
    assert a == b and "Sarah" not in a and "4111 1111" not in a and "[AADHAAR_SYNTHETIC]" in a and "MRN-" in a
    same = synthesize(spark.createDataFrame([("a@example.com and a@example.com",)], "text string"), policy=Policy(["EMAIL_ADDRESS"]), consistent=True).first()["redacted"].split(" and ")
    assert same[0] == same[1]


def test_sanitize_leaves_other_types_and_short_cells(spark):
    df = spark.createDataFrame([("a@example.com", 4111111111111111, "ab", ["a@example.com"]), (None, None, None, None)], "`m.x` string, n long, s string, l array<string>")
    r = sanitize(df, Policy(["EMAIL_ADDRESS", "CREDIT_CARD"])).collect()
    assert r[0]["m.x"] != "a@example.com" and "@example.com" in r[0]["m.x"]
    assert (r[0]["n"], r[0]["s"], r[0]["l"]) == (4111111111111111, "ab", ["a@example.com"]) and r[1]["m.x"] is None


def test_languages(spark):
    df = spark.createDataFrame([("xx", "", "en"), (None, None, "en"), ("es", "", "es"), ("zh-CN", "", "zh"), ("no", "", "nb"), (None, "der Hund und die Katze und das Haus ist nicht groß", "de")], "l string, t string, want string")
    assert df.filter(resolve_language(F.col("l"), F.col("t")) != F.col("want")).count() == 0


def test_masking_is_one_projection(spark):
    plan = mask(spark.createDataFrame([("x",)], "text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
