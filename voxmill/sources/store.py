"""Batches of reviews by (app_id, country), and exports."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.functions.fixed import EXPORT_COLUMNS


class Store:
    """A folder of Parquet partitioned by app_id and country; saving a batch replaces that batch alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, app_id: int, country: str, reviews: DataFrame) -> None:
        now = datetime.now(UTC).isoformat(timespec="seconds")
        stamped = reviews.withColumns({"app_id": F.lit(app_id).cast("long"), "country": F.lit(country), "collected_at": F.lit(now)})
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("app_id", "country").parquet(self.path)

    def _all(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except Exception as e:  # nothing saved yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def get(self, app_id: int, country: str) -> DataFrame | None:
        """The batch, whatever its size; partitions of others aren't read."""
        rows = self._all()
        if rows is None:
            return None
        own = rows.filter((F.col("app_id") == app_id) & (F.col("country") == country))
        return None if own.isEmpty() else own

    def collections(self) -> DataFrame | None:
        rows = self._all()
        return None if rows is None else rows.groupBy("app_id", "country").agg(F.max("collected_at").alias("collected_at"), F.count("*").alias("reviews"))

    def clear(self) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def export_rows(df: DataFrame) -> DataFrame:
    """The twelve export columns in their order; missing ones are null, others left out."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in EXPORT_COLUMNS))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and CRLF; booleans as True and False."""
    flag = F.when(F.col("has_complaint"), "True").when(~F.col("has_complaint"), "False")
    export_rows(df).withColumn("has_complaint", flag).write.mode("overwrite").option("lineSep", "\r\n").csv(path, header=True, quote='"', escape='"')


def write_json(df: DataFrame, path: str) -> None:
    export_rows(df).write.mode("overwrite").json(path)


def download(rows: DataFrame, app: dict) -> dict:
    """A batch as one document: app, collected_at, reviews. For batches of the collection limit, which is bounded."""
    own = rows.orderBy("ord") if "ord" in rows.columns else rows
    at = rows.agg(F.max("collected_at")).first()[0] if "collected_at" in rows.columns else None
    return {"app": app, "collected_at": at, "reviews": [r.asDict() for r in export_rows(own).collect()]}


# ---- evaluation files


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """id, title, text, rating, ... of a pool file ({"app_id": .., "items": [..]}), with ord, its place in the file."""
    whole = spark.read.option("multiLine", True).json(path)
    return whole.select(F.posexplode("items").alias("ord", "r")).select("ord", "r.*")


def read_by_id(spark: SparkSession, path: str, fields: str = "score double, has_complaint boolean, note string") -> DataFrame:
    """id and fields of a file that maps ids to objects, such as labels or a score cache; missing fields are null."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,struct<{_struct(fields)}>>")).alias("id", "r")).select("id", "r.*")


def _struct(fields: str) -> str:
    return ",".join(":".join(f.split(None, 1)) for f in fields.split(", "))


def write_artifact(value: dict | list, path: str) -> None:
    """An evaluation result as JSON, readable and with its letters as they are."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")
