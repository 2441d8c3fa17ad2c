import datetime as dt

from veilspark.operators.engine import Policy
from veilspark.streaming.gateway import over_limit, request_rates, start_gateway


def test_gateway_and_audit(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    spark.createDataFrame([(1, "a@example.com"), (2, "x")], "id int, text string").write.parquet(src)
    stream = spark.readStream.schema("id int, text string").parquet(src)
    q = start_gateway(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", Policy(["EMAIL_ADDRESS"]), audit=f"file://{tmp_path}/audit")
    q.awaitTermination()
    out = {r["id"]: r["action"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert out == {1: "BLOCK", 2: "ALLOW"}
    assert spark.read.parquet(f"file://{tmp_path}/audit").count() == 1


def test_rates(spark, tmp_path):
    src = f"file://{tmp_path}/ev"
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("a", t), ("a", t + dt.timedelta(seconds=5)), ("a", t + dt.timedelta(seconds=65)), ("b", t + dt.timedelta(seconds=600))], "k string, ts timestamp").write.parquet(src)
    stream = spark.readStream.schema("k string, ts timestamp").parquet(src)
    for name, df in (("rates", request_rates(stream, "k")), ("over", over_limit(stream, "k", 1))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "rates" else "append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/{name}").start()
        q.awaitTermination()
    assert sorted((r["k"], r["requests"]) for r in spark.table("rates").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert [(r["k"], r["requests"]) for r in spark.table("over").collect()] == [("a", 2)]
