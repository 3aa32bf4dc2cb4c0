"""Model output against the data: citations, overlays, caches and label edits, all as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmill.functions.scores import to_label
from voxmill.session import checkpointed


def verify_citations(cited: DataFrame, valid: DataFrame, group: str = "theme", ids: str = "cited_review_ids", valid_id: str = "id", key: str | None = None) -> DataFrame:
    """cited with its ids cut to those of the same group that exist (order and repeats kept), citations_valid and hallucinated_citations_dropped.

    key: a column that tells the rows of cited apart. Without one they are
    numbered and kept in the shared folder, so that both uses see the same
    numbers.
    """
    keep = [c for c in cited.columns if c != ids]
    numbered = cited.withColumn("_row", F.col(key)) if key else checkpointed(cited.withColumn("_row", F.monotonically_increasing_id()))
    each = numbered.select("_row", group, F.posexplode(ids).alias("_pos", "_id"))
    known = valid.select(F.col(group), F.col(valid_id).alias("_id")).distinct().withColumn("_ok", F.lit(True))
    found = each.join(known, [group, "_id"], "left")
    per = found.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_ok"), F.struct("_pos", "_id")))), lambda x: x["_id"]).alias("_kept"), F.count_if(F.col("_ok").isNull()).alias("_dropped"))
    out = numbered.join(per, "_row", "left")
    kept = F.coalesce("_kept", F.array().cast("array<string>"))
    return out.select(*keep, kept.alias(ids), (F.size(kept) > 0).alias("citations_valid"), F.coalesce("_dropped", F.lit(0)).alias("hallucinated_citations_dropped"))


def verify_phrases(phrases: DataFrame, corpus: DataFrame, top_n: int = 15, cap: int = 150) -> DataFrame:
    """term, count, share_of_corpus, example_review_ids, example_quote, hallucinated_citations_dropped of phrases with a citation left.

    phrases: ord, phrase, review_ids, example_quote. corpus: the complaints (ord, id); the first `cap` by arrival were shown to the model, so only they can be cited.
    """
    shown = corpus.orderBy("ord").limit(cap).select(F.lit(0).alias("g"), "id")
    size = shown.agg(F.count("*").alias("size"))  # cap rows at most
    checked = verify_citations(phrases.withColumn("g", F.lit(0)), shown, "g", "review_ids", key="ord").filter("citations_valid").crossJoin(F.broadcast(size))
    n = F.size("review_ids")
    share = F.coalesce(F.bround(F.try_divide(n * 100.0, F.col("size").cast("double")), 1), F.lit(0.0))
    top = checked.withColumn("count", n).orderBy(F.desc("count"), "ord").limit(top_n)
    return top.select(F.col("phrase").alias("term"), "count", share.alias("share_of_corpus"), F.col("review_ids").alias("example_review_ids"), F.coalesce("example_quote", F.lit("")).alias("example_quote"), "hallucinated_citations_dropped")


def overlay(reviews: DataFrame, results: DataFrame, source: str = "model", key: str = "id") -> DataFrame:
    """reviews with sentiment, sentiment_score, has_complaint, sentiment_source taken from results (id, score, has_complaint) where there is one.

    Unknown result ids are ignored; of several results for an id the last by ord counts; of several reviews with an id the last by ord is changed.
    """
    if "ord" in results.columns:
        results = results.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ord")))).filter("_n = 1")
    r = results.select(F.col(key).alias("_k"), F.bround(F.col("score").cast("double"), 4).alias("_score"), F.col("score").cast("double").alias("_raw"), F.coalesce(F.col("has_complaint"), F.lit(False)).alias("_flag"))
    last = F.col("ord") == F.max("ord").over(Window.partitionBy(key))
    marked = reviews.withColumn("_last", last)
    joined = marked.join(r, F.col("_last") & (F.col(key) == F.col("_k")), "left")
    hit = F.col("_k").isNotNull()
    new = {"sentiment": to_label(F.col("_raw")), "sentiment_score": F.col("_score"), "has_complaint": F.col("_flag"), "sentiment_source": F.lit(source)}
    return joined.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()}).select(*reviews.columns)


def cache_misses(items: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    return items.join(cache.select(key).distinct(), key, "left_anti")


def with_results(items: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """items with their result; one that the response lacks gets an error instead of disappearing."""
    r = results.withColumn("_there", F.lit(True))
    error = F.when(F.col("_there").isNull(), "missing from response")
    if "error" in results.columns:
        error = F.coalesce(F.col("error"), error)
    return items.join(r.drop("error") if "error" not in results.columns else r, key, "left").withColumn("error", error).drop("_there")


def latest_labels(edits: DataFrame, key: str = "id") -> DataFrame:
    """The labels that a log of edits (id, ord, deleted, score, ...) leaves, with original_score, the first since the last deletion.

    Scores outside -1..1 are no edits.
    """
    valid = edits.filter(F.coalesce("deleted", F.lit(False)) | F.col("score").between(-1, 1))
    w = Window.partitionBy(key)
    gone = F.max(F.when(F.col("deleted"), F.col("ord"))).over(w)
    alive = valid.withColumn("_gone", gone).filter(F.col("_gone").isNull() | (F.col("ord") > F.col("_gone")))
    first = F.first("score").over(w.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = alive.withColumns({"original_score": first, "_n": F.row_number().over(w.orderBy(F.desc("ord")))})
    return ranked.filter("_n = 1").drop("_n", "_gone", "deleted")


def labeled_items(pool: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """pool rows that have a label, with human_score, has_complaint and note; missing ones false and empty."""
    have = set(labels.columns)
    flag = F.coalesce("has_complaint", F.lit(False)) if "has_complaint" in have else F.lit(False)
    note = F.coalesce("note", F.lit("")) if "note" in have else F.lit("")
    l = labels.select(key, F.col("score").cast("double").alias("human_score"), flag.alias("has_complaint"), note.alias("note"))  # noqa: E741
    return pool.drop("has_complaint", "note").join(l, key)


def audit_items(pool: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """All pool rows, with the label's score or null."""
    return pool.join(labels.select(key, F.col("score").alias("human_score")), key, "left")


def range_split(df: DataFrame, score: str = "score") -> tuple[DataFrame, DataFrame]:
    """(rows whose score is within -1..1, the rest with the reason in error). A missing score is out of range."""
    good = F.coalesce(F.col(score).between(-1, 1), F.lit(False))
    return df.filter(good), df.filter(~good).withColumn("error", F.lit("score must be from -1 to 1"))


def without_errors(items: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """The items that have a result without an error."""
    good = results.filter(F.col("error").isNull()) if "error" in results.columns else results
    return items.join(good.select(key).distinct(), key, "left_semi")


def audited(labels: DataFrame, audits: DataFrame, key: str = "id") -> DataFrame:
    """labels (id, score, has_complaint, ...) after a second reader's audits (id, ord, score, has_complaint, agreed).

    The last valid audit of an id by ord takes over; original_score and
    original_has_complaint keep what was there; reviewed and agreed tell.
    Audits of ids without a label, or with a score outside -1..1, count for
    nothing.
    """
    valid = audits.filter(F.col("score").between(-1, 1))
    last = valid.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ord")))).filter("_n = 1")
    a = last.select(F.col(key).alias("_k"), F.col("score").alias("_s"), F.col("has_complaint").alias("_c"), F.col("agreed").alias("_a"))
    joined = labels.join(a, F.col(key) == F.col("_k"), "left")
    hit = F.col("_k").isNotNull()
    flag = F.coalesce("has_complaint", F.lit(False))
    kept = [c for c in labels.columns if c not in ("score", "has_complaint")]
    return joined.select(*kept, F.when(hit, F.col("_s")).otherwise(F.col("score")).alias("score"), F.when(hit, F.col("_c")).otherwise(flag).alias("has_complaint"), F.when(hit, F.col("score")).alias("original_score"), F.when(hit, flag).alias("original_has_complaint"), hit.alias("reviewed"), F.col("_a").alias("agreed"))


def label_progress(pool: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """One row: total, labeled, reviewed."""
    reviewed = F.coalesce("reviewed", F.lit(False)) if "reviewed" in labels.columns else F.lit(False)
    own = labels.select(key, reviewed.alias("_r")).groupBy(key).agg(F.max("_r").alias("_r"))
    return pool.select(key).join(own, key, "left").agg(F.count("*").alias("total"), F.count("_r").alias("labeled"), F.count_if("_r").alias("reviewed"))
