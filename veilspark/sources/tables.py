"""The metadata tables in Parquet folders or behind JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.plans.policy import SCHEMAS, empty_table, migrate


def read_table(spark: SparkSession, root: str, name: str, jdbc: dict | None = None) -> DataFrame:
    """A table by name with all its columns; one that isn't there yet is empty. jdbc: options of Spark's JDBC source."""
    if name not in SCHEMAS:
        raise ValueError(f"no such table: {name}")
    if jdbc:
        return migrate(spark.read.format("jdbc").options(**jdbc, dbtable=name).load(), name)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return empty_table(spark, name)
    return migrate(spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}"), name)


def append(df: DataFrame, root: str, name: str) -> None:
    """Adds rows, as of the audit log. A failure is the caller's to meet: an audit must not stop the work it is about."""
    df.write.mode("append").parquet(f"{root}/{name}")
