import datetime as dt

import pytest
from pyspark.sql import functions as F

from veilspark.operators.documents import image_redactions
from veilspark.plans import audit as A
from veilspark.plans import policy as P


def test_policy_tables(spark):
    pol = spark.createDataFrame([(1, None, "URL", True)], P.SCHEMAS["dlp_policies"])
    p = P.resolve_policy(pol, P.empty_table(spark, "system_settings"), P.empty_table(spark, "custom_regex_policies"), 5)
    assert p.style == "LABEL" and "URL" in p.entities and len(p.entities) == 17
    settings = P.set_style(P.empty_table(spark, "system_settings"), 5, "ASTERISK")
    assert P.masking_style(settings, 5) == "ASTERISK" and P.masking_style(P.set_style(settings, 5, "odd"), 5) == "odd"
    pats = P.create_pattern(P.empty_table(spark, "custom_regex_policies"), 5, "my id", r"X\d+")
    assert P.custom_patterns(pats, 5) == [("MY_ID", r"X\d+")]
    assert P.delete_pattern(pats, 6, 1).count() == 1 and P.delete_pattern(pats, 5, 1).count() == 0 and P.delete_pattern(pats, 5, 99).count() == 1
    with pytest.raises(ValueError):
        P.create_pattern(pats, 5, "bad", "(")
    orgs = P.default_org(P.empty_table(spark, "organizations"))
    assert orgs.count() == 1 and P.default_org(orgs).count() == 1 and P.health(spark)
    old = spark.createDataFrame([(1, "LOGIN")], "id int, action string")
    assert P.migrate(old, "audit_logs", 7).first()["org_id"] == 7


def test_certificate(spark):
    none = spark.createDataFrame([], "entity string")
    assert {tuple(r) for r in A.certificate_counts(none).collect()} == {("No PII Detected", 0), ("Total", 0)}
    some = spark.createDataFrame([("A",), ("A",), ("B",), (None,)], "entity string")
    assert {tuple(r) for r in A.certificate_counts(some).collect()} == {("A", 2), ("B", 1), ("Total", 3)}
    assert "A\t2" in A.certificate_text([("A", 2)], "Org", "f.docx", "id", "now")


def test_keys(spark):
    keys = A.create_key(P.empty_table(spark, "api_keys"), 1, "pk_1", "k", "secret", 10)
    ask = spark.createDataFrame([("secret",), ("other",), (None,)], "key string")
    assert [r["key_id"] for r in A.verify_keys(ask, keys).orderBy(F.desc("key")).collect()] == ["pk_1", None, None]
    off = A.revoke_key(keys, 1, "pk_1")
    assert A.verify_keys(ask, off).filter("key_id is not null").count() == 0
    for bad in (0, 1_000_001):
        with pytest.raises(ValueError):
            A.create_key(keys, 1, "x", "k", "s", bad)
    with pytest.raises(KeyError):
        A.revoke_key(keys, 2, "pk_1")


def test_rate_limit_edges(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t), ("a", t), ("a", t + dt.timedelta(seconds=60)), ("", t), (None, t)]
    r = A.rate_limited(spark.createDataFrame(rows, "ip string, ts timestamp"), "ip", "ts", 1).collect()
    assert sorted((x["ip"] or "-", x["limited"]) for x in r) == [("-", False), ("-", False), ("a", False), ("a", False), ("a", True)]


def test_audit_rows(spark):
    r = spark.createDataFrame([(["A", "B"],), ([],)], "types array<string>")
    got = A.audit_rows(r, "TEXT_MASK", 3).collect()
    assert len(got) == 1 and got[0]["details"] == '{"detected":["A","B"]}'
    logs = spark.createDataFrame([(i, 1, i, None, "LOGIN", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), None, "not json" if i else None) for i in range(3)], P.SCHEMAS["audit_logs"])
    assert A.entity_analytics(logs, 1).count() == 0 and A.export_rows(logs, None).count() == 3


def test_image_redaction_rows(spark):
    box = [{"x": 0.0, "y": 0.0}, {"x": 180.0, "y": 0.0}, {"x": 180.0, "y": 10.0}, {"x": 0.0, "y": 10.0}]
    lines = spark.createDataFrame([("d", 0, "mail a@example.com", box, 0, 18)], "doc string, line int, text string, box array<struct<x:double,y:double>>, start int, end int")
    spans = spark.createDataFrame([("d", 5, 18, "EMAIL_ADDRESS")], "doc string, start int, end int, entity_type string")
    r = image_redactions(spans, lines, ["doc"]).collect()
    assert len(r) == 1 and (r[0]["word"], r[0]["x0"], r[0]["y0"], r[0]["x1"], r[0]["y1"]) == ("a@example.com", 49, -1, 181, 11)


def test_a_missing_default_takes_the_shared_rows_state(spark):
    rows = spark.createDataFrame([(1, 1, "PERSON", True), (2, None, "CREDIT_CARD", False)], P.SCHEMAS["dlp_policies"])
    got = {r["pii_type"]: r["is_active"] for r in P.effective_policies(rows, 1).collect()}
    assert not got["CREDIT_CARD"] and got["PERSON"] and got["EU_VAT"] and len(got) == 16
    assert "CREDIT_CARD" not in {r[0] for r in P.active_types(rows, 1).collect()}
