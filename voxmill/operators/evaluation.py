"""Scoring of scorers: errors, ranks, F1, grid search and cross-validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmill.functions.fixed import SENTIMENTS
from voxmill.functions.scores import blend, clamp, pearson, ratio, rounded, to_label
from voxmill.session import checkpointed


def error_metrics(df: DataFrame, human: str = "human_score", predicted: str = "predicted") -> DataFrame:
    """One row: n, mae, rmse, to 4 digits; 0 when empty."""
    d = F.col(human) - F.col(predicted)
    return df.agg(F.count("*").alias("n"), F.coalesce(rounded(F.avg(F.abs(d)), 4), F.lit(0.0)).alias("mae"), F.coalesce(rounded(F.sqrt(F.avg(d * d)), 4), F.lit(0.0)).alias("rmse"))


def value_ranks(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., value, rank: the average rank of each distinct value.

    Equal values are counted first. Without groups the distinct values are
    then dealt to partitions by range, and ranks follow from counts within a
    partition and the totals of those before it, so no task orders them all.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    if by:
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.select(*by, value, (before + (F.col("_n") + 1) / 2.0).alias("rank"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(counts.repartitionByRange(parts, value).withColumn("_p", F.spark_partition_id()))
    totals = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.sum("_n").alias("n")).collect()}  # one row per partition
    starts, at = [], 0
    for p in sorted(totals):
        starts += [F.lit(p), F.lit(at).cast("long")]
        at += totals[p]
    start = F.create_map(*starts)[F.col("_p")] if starts else F.lit(0).cast("long")
    within = F.coalesce(F.sum("_n").over(Window.partitionBy("_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.select(value, (start + within + (F.col("_n") + 1) / 2.0).alias("rank"))


def spearman(df: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., n, spearman: Pearson over average ranks; 0 for a constant side, 4 digits."""
    ra, rb = (value_ranks(df, c, by).withColumnRenamed("rank", f"_r{k}") for k, c in enumerate((a, b)))
    ranked = df.select(*by, a, b).join(ra, [*by, a]).join(rb, [*by, b])
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), rounded(pearson(F.col("_r0"), F.col("_r1")), 4).alias("spearman"))


def breakdown(df: DataFrame, key: Column, human: str = "human_score", predicted: str = "predicted") -> DataFrame:
    """grp (as text), n, mae, spearman (null for a single row), sorted by grp."""
    keyed = df.select(key.cast("string").alias("grp"), F.col(human).alias("h"), F.col(predicted).alias("p"))
    errors = keyed.groupBy("grp").agg(F.count("*").alias("n"), rounded(F.avg(F.abs(F.col("h") - F.col("p"))), 4).alias("mae"))
    ranks = spearman(keyed, "h", "p", ("grp",)).drop("n")
    return errors.join(ranks, "grp").select("grp", "n", "mae", F.when(F.col("n") > 1, F.col("spearman")).alias("spearman")).orderBy("grp")


def _f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, F.coalesce(F.try_divide(p * r * 2.0, p + r), F.lit(0.0))


def flag_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1 (3 digits), support_true. Missing flags are false."""
    t, p = F.coalesce(F.col(truth), F.lit(False)), F.coalesce(F.col(predicted), F.lit(False))
    one = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    precision, recall, f1 = _f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return one.select("tp", "fp", "fn", "tn", rounded(precision, 3).alias("precision"), rounded(recall, 3).alias("recall"), rounded(f1, 3).alias("f1"), (F.col("tp") + F.col("fn")).alias("support_true"))


def class_metrics(df: DataFrame, truth: str, predicted: str, classes: tuple[str, ...] = SENTIMENTS) -> DataFrame:
    """label, precision, recall, f1 (3 digits), support for each class, absent ones too."""
    t, p = F.col(truth), F.col(predicted)
    one = df.agg(*(F.struct(F.lit(c).alias("label"), F.count_if((t == c) & (p == c)).alias("tp"), F.count_if((t != c) & (p == c)).alias("fp"), F.count_if((t == c) & (p != c)).alias("fn")).alias(f"c{k}") for k, c in enumerate(classes)))
    each = one.select(F.explode(F.array(*(F.col(f"c{k}") for k in range(len(classes))))).alias("x")).select("x.*")
    precision, recall, f1 = _f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return each.select("label", rounded(precision, 3).alias("precision"), rounded(recall, 3).alias("recall"), rounded(f1, 3).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def macro_f1(df: DataFrame, truth: str, predicted: str, classes: tuple[str, ...] = SENTIMENTS) -> DataFrame:
    """One row: the mean of the rounded F1 of all classes, 3 digits."""
    return class_metrics(df, truth, predicted, classes).agg(rounded(F.sum("f1") / len(classes), 3).alias("macro_f1"))


def evaluate(df: DataFrame, human: str = "human_score", predicted: str = "predicted") -> DataFrame:
    """One row: n, mae, rmse, spearman, macro_f1 of predictions clamped to -1..1."""
    own = df.select(F.col(human).alias("h"), clamp(F.col(predicted)).alias("p")).withColumns({"lh": to_label(F.col("h")), "lp": to_label(F.col("p"))})
    return error_metrics(own, "h", "p").crossJoin(spearman(own, "h", "p").select("spearman")).crossJoin(macro_f1(own, "lh", "lp"))  # one row each


def grid(spark: SparkSession, weights: int = 21, thresholds: int = 41) -> DataFrame:
    """w from 0 to 1 and neg < pos from -1 to 1, in steps of 0.05, as the nearest doubles."""
    w = spark.range(weights).select((F.col("id") * 5 / 100.0).alias("w"))
    neg = spark.range(thresholds).select(((F.col("id") * 5 - 100) / 100.0).alias("neg"))
    pos = neg.withColumnRenamed("neg", "pos")
    return w.crossJoin(neg.join(pos, F.col("pos") > F.col("neg")))  # 17,220 rows


def _cuts(configs: DataFrame) -> list[float]:
    return sorted({x for r in configs.select("neg", "pos").distinct().collect() for x in r})  # of the grid, 41 by default


def _placed(df: DataFrame, configs: DataFrame, cuts: list[float], by: tuple[str, ...]) -> DataFrame:
    """by..., w, above, below, truth, k: how many rows have a score at or over `above` cuts and at or under `below`. Equal rows are counted before they meet the weights."""
    edges = F.array(*(F.lit(x) for x in cuts))
    rows = df.groupBy(*by, "compound", "rating", "truth").agg(F.count("*").alias("k"))
    scored = rows.crossJoin(F.broadcast(configs.select("w").distinct())).withColumn("s", blend(F.col("compound"), F.col("rating"), F.col("w")))  # the grid's size is fixed
    above = F.size(F.filter(edges, lambda t: F.col("s") >= t)).alias("above")
    below = F.size(F.filter(edges, lambda t: F.col("s") <= t)).alias("below")
    return scored.groupBy(*by, "w", above, below, "truth").agg(F.sum("k").alias("k"))


def _met(counted: DataFrame, configs: DataFrame, cuts: list[float], by: tuple[str, ...]) -> DataFrame:
    """by..., w, neg, pos, f1 of every configuration."""
    at = F.create_map(*(F.lit(v) for k, x in enumerate(cuts) for v in (x, k)))
    pairs = configs.select("neg", "pos").distinct().select("neg", "pos", at[F.col("neg")].alias("kn"), at[F.col("pos")].alias("kp"))
    label = F.when(F.col("above") > F.col("kp"), "positive").when(F.col("below") >= F.lit(len(cuts)) - F.col("kn"), "negative").otherwise("neutral")
    met = counted.crossJoin(F.broadcast(pairs)).withColumn("pred", label)
    counts = met.groupBy(*by, "w", "neg", "pos").agg(*_confusion(F.col("k")))
    return counts.select(*by, "w", "neg", "pos", _macro().alias("f1"))


def _confusion(k: Column) -> list[Column]:
    out = []
    for c in SENTIMENTS:
        t, p = F.col("truth") == c, F.col("pred") == c
        out += [F.sum(F.when(t & p, k).otherwise(0)).alias(f"tp_{c}"), F.sum(F.when(~t & p, k).otherwise(0)).alias(f"fp_{c}"), F.sum(F.when(t & ~p, k).otherwise(0)).alias(f"fn_{c}")]
    return out


def _macro() -> Column:
    f1 = [rounded(_f1(F.col(f"tp_{c}"), F.col(f"fp_{c}"), F.col(f"fn_{c}"))[2], 3) for c in SENTIMENTS]
    return rounded((f1[0] + f1[1] + f1[2]) / len(SENTIMENTS), 3)


def _best(found: DataFrame, by: tuple[str, ...]) -> DataFrame:
    ranked = found.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("f1"), "w", "neg", "pos")))
    return ranked.filter("_n = 1").drop("_n")


def grid_search(df: DataFrame, configs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., w, neg, pos, f1: the configuration of greatest macro-F1, the first in order (w, neg, pos) on ties.

    df: by..., compound, rating, truth. Which side of a threshold a score is on
    is all that matters, so per weight the rows are first counted by the
    number of thresholds below and above their score; the grid then meets a
    few hundred counts, whatever the number of rows.
    """
    cuts = _cuts(configs)
    return _best(_met(_placed(df, configs, cuts, by), configs, cuts, by), by)


def cross_validate(df: DataFrame, configs: DataFrame, k: int = 5) -> DataFrame:
    """fold, w, neg, pos, train_f1, test_f1: the best configuration on the other folds, scored on its own.

    df: fold, compound, rating, truth. Rows are counted once, by fold and side
    of the thresholds; a fold's training counts are the sums of the other
    folds' counts. All folds are searched in one plan.
    """
    cuts = _cuts(configs)
    counted = _placed(df, configs, cuts, ("fold",))
    folds = df.sparkSession.range(k).select(F.col("id").cast("int").alias("held"))
    train = counted.join(F.broadcast(folds), F.col("fold") != F.col("held")).groupBy("held", "w", "above", "below", "truth").agg(F.sum("k").alias("k"))  # k rows
    best = _best(_met(train, configs, cuts, ("held",)), ("held",)).withColumnRenamed("f1", "train_f1")
    own = df.groupBy("fold", "compound", "rating", "truth").agg(F.count("*").alias("k"))
    test = own.join(F.broadcast(best), F.col("fold") == F.col("held"))
    scored = test.withColumn("pred", to_label(blend(F.col("compound"), F.col("rating"), F.col("w")), F.col("pos"), F.col("neg")))
    per = scored.groupBy("fold", "w", "neg", "pos", "train_f1").agg(*_confusion(F.col("k")))
    return per.select("fold", "w", "neg", "pos", "train_f1", _macro().alias("test_f1"))
