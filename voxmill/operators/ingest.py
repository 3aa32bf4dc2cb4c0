"""Feed pages to rows, dedupe, samples, batches and folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.session import checkpointed

PAGE_SIZE, MAX_PAGES, OVERFETCH = 50, 10, 2
_SPACE = " \t\n\r\x0b\x0c"


def pages_for(limit: int) -> int:
    """Feed pages to ask for: twice what is needed, 10 at most."""
    if not 1 <= limit <= PAGE_SIZE * MAX_PAGES:
        raise ValueError("limit must be from 1 to 500")
    return min(MAX_PAGES, max(1, math.ceil(OVERFETCH * limit / PAGE_SIZE)))


def _label(entry: Column, key: str, default: str = "") -> Column:
    """The stripped .label of a node, if it is a string; else the default."""
    path = f"$['{key}'].label"
    node = F.try_variant_get(entry, path, "variant")
    text = F.when(F.schema_of_variant(node) == "STRING", F.try_variant_get(entry, path, "string"))
    return F.coalesce(F.btrim(text, F.lit(_SPACE)), F.lit(default))


def parse_feed(pages: DataFrame, column: str = "payload") -> DataFrame:
    """Review rows of JSON feed pages, page order kept in ord.

    entry may be an array, one object, or missing; broken JSON gives no rows.
    Entries without a whole rating of 1 to 5 are dropped: a string of digits
    with or without sign and leading zeros, or a number, cut to its whole part.
    votes is a whole number of any sign that fits a long; anything else gives
    0. An author of another shape gives an empty name.
    """
    keep = [c for c in pages.columns if c != column]
    entry = F.try_variant_get(F.try_parse_json(F.col(column)), "$.feed.entry", "variant")
    typed = pages.select(*keep, entry.alias("_all")).filter("_all IS NOT NULL").withColumn("_t", F.schema_of_variant("_all"))
    each = pages.sparkSession.tvf.variant_explode(F.col("_all").outer())
    many = typed.filter(F.col("_t").startswith("ARRAY")).lateralJoin(each).select(*keep, F.col("pos").alias("_pos"), F.col("value").alias("_e"))
    one = typed.filter(F.col("_t").startswith("OBJECT")).select(*keep, F.lit(0).alias("_pos"), F.col("_all").alias("_e"))
    e, path = F.col("_e"), "$['im:rating'].label"
    kind = F.schema_of_variant(F.try_variant_get(e, path, "variant"))
    written = F.regexp_extract(F.btrim(F.try_variant_get(e, path, "string"), F.lit(_SPACE)), r"^\+?0*([1-5])$", 1)
    number = F.try_variant_get(e, path, "double")
    rating = F.when(kind == "STRING", F.nullif(written, F.lit("")).cast("int")).when(kind == "BOOLEAN", F.try_variant_get(e, path, "boolean").cast("int")).otherwise(F.when((number >= 1) & (number < 6), F.floor(number).cast("int")))
    votes = _label(e, "im:voteSum", "0")
    author = F.try_variant_get(e, "$.author.name.label", "string")
    rows = many.unionByName(one).select(*keep, "_pos", _label(e, "id").alias("id"), _label(e, "title").alias("title"), _label(e, "content").alias("text"), rating.alias("rating"), F.coalesce(author, F.lit("")).alias("author"), _label(e, "im:version").alias("version"), _label(e, "updated").alias("updated"), F.coalesce(F.when(votes.rlike("^[+-]?[0-9]+$"), votes.try_cast("long")), F.lit(0)).cast("long").alias("votes"))
    return rows.filter(F.col("rating").between(1, 5)).withColumnRenamed("_pos", "pos")


def dedupe_last_wins(df: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """Of rows with one key the last by order, at the place of the first."""
    w = Window.partitionBy(key)
    ranked = df.withColumns({"_n": F.row_number().over(w.orderBy(F.desc(order))), "_first": F.min(order).over(w)})
    return ranked.filter("_n = 1").withColumn(order, F.col("_first")).drop("_n", "_first")


def seeded(seed: int, *keys: str) -> Column:
    """A reproducible shuffle key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def sample_seeded(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """n rows without replacement, the same for the same seed. All, if there are no more, in the order of the sample."""
    return df.orderBy(seeded(seed, key), key).limit(n)


def stratified_sample(df: DataFrame, per_stratum: int, seed: int = 7, stratum: str = "rating", key: str = "id") -> DataFrame:
    """At most per_stratum rows of each stratum; a group limit runs before the shuffle."""
    w = Window.partitionBy(stratum).orderBy(seeded(seed, key), key)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_stratum).drop("_n")


def batches(df: DataFrame, size: int, order: str = "ord") -> DataFrame:
    """df with batch_id: chunks of `size` by arrival. order must be the 0-based arrival position, so no global sort is needed."""
    return df.withColumn("batch_id", F.floor(F.col(order) / size).cast("long"))


def with_position(df: DataFrame, order: str, name: str = "ord") -> DataFrame:
    """0-based position by `order`, from range-partitioned sorting and per-partition counts rather than one global window.

    The sorted rows are kept in the shared folder, as counts and positions must come from the same rows.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order).withColumn("_mid", F.monotonically_increasing_id())
    parts = checkpointed(ranged.withColumn("_p", F.shiftright("_mid", 33)))
    counts = {r["_p"]: r["n"] for r in parts.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one row per partition
    starts, at = {}, 0
    for p in sorted(counts):
        starts[p], at = at, at + counts[p]
    if not starts:
        return df.withColumn(name, F.lit(0).cast("long"))
    start = F.create_map(*(F.lit(x).cast("long") for kv in starts.items() for x in kv))
    return parts.withColumn(name, start[F.col("_p")] + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mid", "_p")


def folds(df: DataFrame, k: int = 5, order: str = "ord") -> DataFrame:
    return df.withColumn("fold", F.pmod(F.col(order), F.lit(k)).cast("int"))


def bootstrap_draws(spark, n: int, reps: int = 200, seed: int = 7, slices: int = 0) -> DataFrame:
    """(rep, ord, times): how often each of n rows is drawn when n rows are drawn with replacement, `reps` times."""
    slots = spark.range(0, reps * n, 1, slices or None)
    picked = slots.select(F.floor(F.col("id") / n).cast("int").alias("rep"), F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), 1, 12), 16, 10).cast("long"), F.lit(n)).alias("ord"))
    return picked.repartition("ord").groupBy("rep", "ord").agg(F.count("*").alias("times"))  # dealt by ord, so that grouping by ord needs no further shuffle
