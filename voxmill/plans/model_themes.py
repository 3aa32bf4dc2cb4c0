"""Themes of complaints from a model: embed, cluster strictly, let the model judge near pairs, merge under a cap, name and verify.

Three providers take part: embed (list of texts to list of vectors), judge
({"pairs": [{pair_id, group_a, group_b}]} to {"decisions": [{pair_id,
same_theme}]}) and name ({cluster: [{id, title, text}]} to {"themes": [..]}).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.functions.scores import is_complaint
from voxmill.operators import similarity
from voxmill.operators.ingest import dedupe_last_wins
from voxmill.operators.providers import ProviderError, call, embed_reviews
from voxmill.session import checkpointed, ship

THRESHOLD, LOW, MAX_SHARE = 0.81, 0.77, 0.35
PAIRS_PER_CALL, SHOWN_TO_JUDGE, SHOWN_TO_NAME, SHOWN_CHARS, MIN_SIZE = 10, 4, 10, 200, 2

DECISIONS = {"type": "object", "required": ["decisions"], "properties": {"decisions": {"type": "array", "items": {"type": "object", "required": ["pair_id", "same_theme"], "properties": {"pair_id": {"type": "string"}, "same_theme": {"type": "boolean"}}}}}}
NAMES = {
    "type": "object",
    "required": ["themes"],
    "properties": {
        "themes": {
            "type": "array",
            "items": {
                "type": "object",
                "required": ["cluster_id", "name", "description", "recommendation", "cited_review_ids"],
                "properties": {k: {"type": "string"} for k in ("cluster_id", "name", "description", "recommendation")} | {"cited_review_ids": {"type": "array", "items": {"type": "string"}}},
            },
        }
    },
}


def head_samples(members: DataFrame, n: int, shown: Column, cluster: str = "cluster_id", place: str = "place") -> DataFrame:
    """cluster, sample: what is shown of the first n members of each cluster, in order. The rank limit runs before the shuffle."""
    first = members.withColumn("_n", F.row_number().over(Window.partitionBy(cluster).orderBy(place))).filter(F.col("_n") <= n)
    return first.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", shown.alias("s")))), lambda x: x["s"]).alias("sample"))


def near_clusters(vectors: DataFrame, clusters: DataFrame, low: float = LOW, high: float = THRESHOLD) -> DataFrame:
    """ca, cb, sim of cluster pairs whose least similarity is from low to under high.

    Only pairs of rows at or above low are formed: where all pairs across two
    clusters are among them, their least is the clusters'.
    """
    c = clusters.select("ord", "cluster_id")
    sizes = c.groupBy("cluster_id").agg(F.count("*").alias("n"))
    pairs = similarity.cosine_pairs(vectors, low)
    ab = pairs.join(c.select(F.col("ord").alias("i"), F.col("cluster_id").alias("ca")), "i").join(c.select(F.col("ord").alias("j"), F.col("cluster_id").alias("cb")), "j")
    across = ab.filter("ca <> cb").groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.min("sim").alias("sim"), F.count("*").alias("k"))
    full = across.join(sizes.select(F.col("cluster_id").alias("ca"), F.col("n").alias("na")), "ca").join(sizes.select(F.col("cluster_id").alias("cb"), F.col("n").alias("nb")), "cb").filter(F.col("k") == F.col("na") * F.col("nb"))
    return similarity.candidate_band(full.select("ca", "cb", "sim"), low, high)


def judged(candidates: DataFrame, samples: DataFrame, judge: Callable[[dict], dict], size: int = PAIRS_PER_CALL) -> DataFrame:
    """candidates with same, the judge's verdict; a call that fails leaves its pairs apart."""
    ship(candidates.sparkSession)
    shown = candidates.join(samples.select(F.col("cluster_id").alias("ca"), F.col("sample").alias("a")), "ca").join(samples.select(F.col("cluster_id").alias("cb"), F.col("sample").alias("b")), "cb")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            same = []
            for at in range(0, len(part), size):
                rows = part.iloc[at : at + size]
                asked = [{"pair_id": str(k), "group_a": list(a), "group_b": list(b)} for k, (a, b) in enumerate(zip(rows["a"], rows["b"], strict=True))]
                try:
                    found = {d["pair_id"]: d["same_theme"] for d in call(judge, {"pairs": asked}, DECISIONS)["decisions"]}
                except ProviderError:
                    found = {}
                same += [bool(found.get(str(k), False)) for k in range(len(rows))]
            yield part[["ca", "cb", "sim"]].assign(same=same)

    return shown.select("ca", "cb", "sim", "a", "b").mapInPandas(run, "ca long, cb long, sim double, same boolean")


def model_themes(prepared: DataFrame, embed: Callable, judge: Callable, name: Callable, threshold: float = THRESHOLD, low: float = LOW, max_share: float = MAX_SHARE) -> DataFrame:
    """Named themes of the complaints among prepared reviews (ord, id, title, text, rating, sentiment, has_complaint), largest first; see similarity.name_themes().

    No complaints, or no cluster of MIN_SIZE: empty. A failing embed or name
    raises ProviderError, as the caller then keeps the rule-based themes.
    """
    spark = prepared.sparkSession
    corpus = dedupe_last_wins(prepared.filter(is_complaint()).select("ord", F.col("id").cast("string").alias("id"), "title", "text", "rating"))
    vectors = checkpointed(embed_reviews(corpus, embed))  # asked for once
    clusters = checkpointed(similarity.complete_linkage(vectors.select("ord", "vec"), threshold))
    texts = clusters.join(corpus, "ord")
    shown = F.substring(F.concat(F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce("text", F.lit(""))), 1, SHOWN_CHARS)
    samples = head_samples(texts.withColumnRenamed("member", "place"), SHOWN_TO_JUDGE, shown)
    verdicts = checkpointed(judged(near_clusters(vectors.select("ord", "vec"), clusters, low, threshold), samples, judge))
    merged = similarity.merge_clusters(clusters, verdicts, max_share)
    members = checkpointed(merged.join(corpus, "ord").select(F.col("merged_id").alias("cluster_id"), F.struct("cluster_id", "member").alias("place"), "id", "title", "text", "rating"))
    large = members.groupBy("cluster_id").count().filter(F.col("count") >= MIN_SIZE).select("cluster_id")
    sample = head_samples(members.join(large, "cluster_id"), SHOWN_TO_NAME, F.struct("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")))
    asked = {str(r["cluster_id"]): [x.asDict() for x in r["sample"]] for r in sample.orderBy("cluster_id").collect()}  # SHOWN_TO_NAME reviews a theme, all in one call
    found = call(name, asked, NAMES)["themes"] if asked else []
    rows = [(k, int(t["cluster_id"]), t["name"], t["description"], t["recommendation"], t["cited_review_ids"]) for k, t in enumerate(found) if t["cluster_id"] in asked]
    names = spark.createDataFrame(rows, "ord int, cluster_id long, name string, description string, recommendation string, cited_review_ids array<string>")
    return similarity.name_themes(members.select("id", "cluster_id"), corpus.select("id", "title", "text", "rating"), names, MIN_SIZE)
