import json

import pytest
from pyspark.sql import functions as F

from voxmill.api import Service
from voxmill.operators import evaluation, ingest, keywords, metrics, sentiment, themes, verify
from voxmill.plans import insights, report
from voxmill.sources import feed
from voxmill.sources.store import write_csv


def entry(i, rating="5", text="fine", **more):
    return {"im:rating": {"label": rating}, "id": {"label": f" {i} "}, "title": {"label": "T"}, "content": {"label": text, "attributes": {"type": "text"}}, "author": {"name": {"label": "who"}}, "im:version": {"label": "1"}, "updated": {"label": "2024-01-01T00:00:00-07:00"}, "im:voteSum": {"label": "3"}} | more


def parsed(spark, *payloads):
    pages = spark.createDataFrame([(f"{k}", p) for k, p in enumerate(payloads)], "path string, payload string")
    return ingest.parse_feed(pages).orderBy("path", "pos").collect()


@pytest.mark.parametrize("payload, n", [("{}", 0), ('{"feed": {}}', 0), ("junk", 0), (json.dumps({"feed": {"entry": entry(1)}}), 1), (json.dumps({"feed": {"entry": [entry(1), {}, entry(2)]}}), 2), (json.dumps({"feed": {"entry": ["x", entry(1, "9"), entry(1, "no"), entry(2, "1")]}}), 1)])
def test_feed_shapes(spark, payload, n):
    assert len(parsed(spark, payload)) == n


def test_feed_fields(spark):
    row = parsed(spark, json.dumps({"feed": {"entry": [entry(7, "4"), entry(8, "4", **{"im:voteSum": {"label": "many"}, "author": "x"})]}}))
    assert row[0].asDict() | {"path": "0"} == {"path": "0", "pos": 0, "id": "7", "title": "T", "text": "fine", "rating": 4, "author": "who", "version": "1", "updated": "2024-01-01T00:00:00-07:00", "votes": 3}
    assert (row[1]["votes"], row[1]["author"]) == (0, "")


@pytest.mark.parametrize("limit", [0, 501])
def test_limit(limit):
    with pytest.raises(ValueError):
        ingest.pages_for(limit)


def test_dedupe(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y"), ("a", 2, "z"), ("", 3, "p"), ("", 4, "q")], "id string, ord long, text string")
    assert [tuple(r) for r in ingest.dedupe_last_wins(df).orderBy("ord").collect()] == [("a", 0, "z"), ("b", 1, "y"), ("", 3, "q")]


def test_position(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert [r["ord"] for r in ingest.with_position(df, "k").orderBy("k").collect()] == list(range(1000))
    assert ingest.with_position(df.filter("k < 0"), "k").count() == 0


def test_metrics(spark):
    df = spark.createDataFrame([(5,), (5,), (1,), (1,)], "rating int")
    assert metrics.rating_metrics(df).first().asDict() == {"total_reviews": 4, "average_rating": 3.0, "median_rating": 5, "share_4_5": 50.0, "share_1_2": 50.0}
    assert metrics.rating_metrics(df.filter("rating > 9")).first().asDict() == {"total_reviews": 0, "average_rating": 0.0, "median_rating": 0, "share_4_5": 0.0, "share_1_2": 0.0}
    assert [(r["stars"], r["count"]) for r in metrics.rating_distribution(df).collect()] == [(5, 2), (4, 0), (3, 0), (2, 0), (1, 2)]


def keyed(spark, rows):
    return spark.createDataFrame([(k, str(k), "", t, s, c, 1) for k, (t, s, c) in enumerate(rows)], "ord long, id string, title string, text string, sentiment string, has_complaint boolean, rating int")


def test_keywords(spark):
    rows = [("refund refund billing", "negative", None)] * 4 + [("lovely design", "positive", False)] * 6 + [("great but refund slow", "positive", True)]
    got = keywords.negative_keywords(keyed(spark, rows)).orderBy("rank").collect()
    assert "refund" in [r["term"] for r in got][:3]
    assert next(r for r in got if r["term"] == "refund")["count"] == 9
    assert keywords.negative_keywords(keyed(spark, rows[4:10])).count() == 0
    alone = keywords.negative_keywords(keyed(spark, rows[:4])).collect()
    assert alone and all(r["z_score"] == 0 for r in alone)  # without a rest, nothing stands out
    assert keywords.negative_keywords(keyed(spark, [("refund refund refund refund", "negative", True)]).withColumn("text", F.lit("refund"))).count() == 0


def test_themes(spark):
    df = keyed(spark, [("they charged me twice, no refund", "negative", True), ("refund refund this is a longer billing story", "positive", True), ("crashes", "negative", False), ("love it, refund", "positive", False)])
    got = themes.theme_analysis(df).collect()
    assert got[0]["theme"].startswith("Billing") and got[0]["negative_reviews"] == 2 and got[0]["share_of_negative"] == 66.67
    assert got[0]["sample_quotes"][0].startswith("refund refund")
    assert themes.theme_analysis(df.filter("ord = 3")).count() == 0


def test_verify(spark):
    cited = spark.createDataFrame([("a", ["1", "9", "1"]), ("b", ["1"]), ("c", [])], "theme string, cited_review_ids array<string>")
    valid = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2")], "theme string, id string")
    got = {r["theme"]: r for r in verify.verify_citations(cited, valid).collect()}
    assert got["a"]["cited_review_ids"] == ["1", "1"] and got["a"]["hallucinated_citations_dropped"] == 1
    assert not got["b"]["citations_valid"] and not got["c"]["citations_valid"]


def test_overlay_and_batches(spark):
    df = spark.createDataFrame([(k, str(k), "t", f"text {k}", "neutral", 0.0, False, "lexicon") for k in range(6)], "ord long, id string, title string, text string, sentiment string, sentiment_score double, has_complaint boolean, sentiment_source string")

    def provider(batch):
        if any(r["id"] == "4" for r in batch):
            raise RuntimeError("down")
        return [{"id": r["id"], "score": -0.9, "has_complaint": True} for r in batch if r["id"] != "1"] + [{"id": "zz", "score": 1}]

    results = sentiment.score_in_batches(df.coalesce(1), provider, size=2)
    got = {r["id"]: r for r in results.collect()}
    assert got["1"]["error"] == "missing from response" and "down" in got["5"]["error"] and got["0"]["error"] is None
    new = {r["id"]: r for r in verify.overlay(df, results.filter("error IS NULL")).collect()}
    assert new["0"]["sentiment"] == "negative" and new["0"]["sentiment_source"] == "model" and new["4"]["sentiment_source"] == "lexicon" and len(new) == 6


def test_labels(spark):
    edits = spark.createDataFrame([("a", 0, False, 0.5), ("a", 1, False, -0.5), ("b", 2, False, 1.0), ("b", 3, True, None), ("c", 4, False, 7.0), ("d", 5, False, 0.1), ("d", 6, True, None), ("d", 7, False, 0.2)], "id string, ord long, deleted boolean, score double")
    got = {r["id"]: (r["score"], r["original_score"]) for r in verify.latest_labels(edits).collect()}
    assert got == {"a": (-0.5, 0.5), "d": (0.2, 0.2)}


@pytest.mark.parametrize("text, rating, label", [("I love this app, it is amazing!", 5, "positive"), ("Terrible. Crashes all the time, awful.", 1, "negative"), ("", 5, "positive"), ("", 1, "negative"), ("It is an app.", 3, "neutral"), ("not good", 2, "negative")])
def test_sentiment(spark, text, rating, label):
    df = spark.createDataFrame([(1, "", text, rating)], "id int, title string, text string, rating int")
    row = sentiment.prepare(df).first()
    assert row["sentiment"] == label and (label != "negative" or row["has_complaint"])


def test_spearman(spark):
    df = spark.createDataFrame([(1.0, 10.0, 3.0, 5.0), (2.0, 20.0, 2.0, 5.0), (3.0, 30.0, 1.0, 5.0)], "a double, b double, c double, k double")
    got = [evaluation.spearman(df, "a", x).first()["spearman"] for x in "bck"]
    assert got == [1.0, -1.0, 0.0]
    ties = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "x double")
    assert {r["x"]: r["rank"] for r in evaluation.value_ranks(ties, "x").collect()} == {1.0: 1.5, 2.0: 3.0}


def test_flags_and_f1(spark):
    df = spark.createDataFrame([(True, True), (True, True), (True, False), (False, True), (None, False)], "t boolean, p boolean")
    assert evaluation.flag_metrics(df, "t", "p").first().asDict() == {"tp": 2, "fp": 1, "fn": 1, "tn": 1, "precision": 0.667, "recall": 0.667, "f1": 0.667, "support_true": 3}
    same = spark.createDataFrame([("positive",), ("neutral",), ("negative",)], "t string").withColumn("p", F.col("t"))
    assert evaluation.macro_f1(same, "t", "p").first()[0] == 1.0
    perfect = spark.createDataFrame([(0.9,), (-0.9,), (0.0,)], "human_score double").withColumn("predicted", F.col("human_score"))
    assert evaluation.evaluate(perfect).first().asDict() == {"n": 3, "mae": 0.0, "rmse": 0.0, "spearman": 1.0, "macro_f1": 1.0}


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    texts = [("5", "love it, amazing"), ("1", "refund! charged twice, terrible billing"), ("1", "refund billing awful scam"), ("2", "billing refund bad refund"), ("4", "nice")]
    pages = [("1", json.dumps({"feed": {"entry": [entry(k, r, t) for k, (r, t) in enumerate(texts)]}}), None), ("2", None, "down")]
    apps = spark.createDataFrame([(9, "App"), (10, "Apple pie")], "app_id long, name string")
    s = Service(spark, str(tmp_path_factory.mktemp("store") / "s"), apps)
    s.collect(9, "US", spark.createDataFrame(pages, "path string, payload string, error string"), limit=50)
    return s


def test_service(service, spark, tmp_path):
    found = service.insights(9)
    assert found["metrics"]["total_reviews"] == 5 and found["themes"][0]["theme"].startswith("Billing") and found["keywords_source"] == "statistical"
    assert "Billing" in service.report(9, kind="md") and "<h2>Themes" in service.report(9)
    assert [r["reviews"] for r in service.store.collections().collect()] == [5]
    with pytest.raises(feed.NotFound):
        service.batch(10)
    write_csv(service.reviews(9), str(tmp_path / "csv"))
    head = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()[0]
    assert head.startswith("id,rating,title,text,author")


def test_upgrades(service):
    base = insights.build(service.batch(9))

    def fails():
        raise insights.ProviderError("down")

    good = [{"term": "x", "count": 2}]
    assert insights.upgrade(base, lambda: good, fails)["keywords_source"] == "model"
    assert insights.upgrade(base, lambda: good, fails)["themes_source"] == "regex"
    assert insights.upgrade(base, lambda: [], lambda: [{"theme": "t"}])["themes_source"] == "regex"
    assert "<script" not in report.html({"name": "<script>"}, base)


def test_failed_pages(spark):
    with pytest.raises(feed.Upstream):
        feed.collect(spark.createDataFrame([("1", None, "down")], "path string, payload string, error string"), 10)


def test_feed_source(spark):
    class Fake(feed.ReviewFeed):
        @classmethod
        def name(cls):
            return "fake_feed"

        @staticmethod
        def fetch(url):
            page = int(url.rsplit("/", 1)[1])
            if page == 2:
                raise OSError("down")
            return json.dumps({"feed": {"entry": [entry(page * 10 + k) for k in range(3)]}})

    spark.dataSource.register(Fake)
    pages = spark.read.format("fake_feed").option("url", "http://x/{page}").option("limit", "100").load()
    assert pages.count() == 4 and pages.filter("error IS NOT NULL").count() == 1
    assert feed.collect(pages, 5, seed=1).count() == 5


def test_stream(spark, tmp_path):
    from voxmill.streaming import reviews as R

    src = tmp_path / "in"
    spark.createDataFrame([("a", 5), ("a", 5), ("b", 1)], "id string, rating int").withColumn("seen_at", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(str(src))
    stream = spark.readStream.schema("id string, rating int, seen_at timestamp").parquet(str(src))
    got = []
    R.start(R.deduplicated(stream), lambda df, n: got.extend(r["id"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(got) == ["a", "b"]


def test_bootstrap_query_has_200_resamples(spark, sf_dir):
    from voxmill.plans import registry

    rows = registry.QUERIES["bootstrap_stability"](spark, sf_dir).collect()
    assert max(r["survived"] for r in rows) > 20 and all(abs(r["percent"] - r["survived"] / 2) < 0.1 for r in rows)
