"""Providers, themes from a model, audits and evaluation files."""

import json
import urllib.error
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_reviews import entry, parsed
from voxmill.operators import evaluation, ingest, keywords, providers, resampling, similarity, verify
from voxmill.plans import model_themes as M
from voxmill.plans import registry as R
from voxmill.sources import feed, store


@pytest.mark.parametrize("label, want", [("0005", 5), ("5", 5), (" +3 ", 3), ("5.0", None), (5, 5), (5.0, 5), (4.7, 4), (9, None), (0.5, None), (True, 1), (False, None), ("-1", None), ("", None), (None, None), ("0", None), ("12345678901234567890", None), (1e300, None)])
def test_ratings(spark, label, want):
    rows = parsed(spark, json.dumps({"feed": {"entry": [entry(1, label)]}}))
    assert [r["rating"] for r in rows] == ([] if want is None else [want])


@pytest.mark.parametrize("label, want", [("12345678901", 12345678901), ("-3", -3), ("+4", 4), ("", 0), ("x", 0), (7, 0), ("007", 7), ("9" * 30, 0)])
def test_votes(spark, label, want):
    (row,) = parsed(spark, json.dumps({"feed": {"entry": entry(1, **{"im:voteSum": {"label": label}})}}))
    assert row["votes"] == want


def test_two_plans_at_once(spark):
    """Two feeds parsed side by side don't share anything."""
    a, b = (ingest.parse_feed(spark.createDataFrame([("0", json.dumps({"feed": {"entry": [entry(i)]}}))], "path string, payload string")) for i in (1, 2))
    assert [r["id"] for r in a.collect()] == ["1"] and [r["id"] for r in b.collect()] == ["2"]


def test_small_pools_keep_their_order(spark):
    pages = spark.createDataFrame([("0", json.dumps({"feed": {"entry": [entry(i) for i in (9, 2, 7, 1)]}}))], "path string, payload string")
    assert [r["id"] for r in feed.collect(pages, 4).orderBy("ord").collect()] == ["9", "2", "7", "1"] and feed.collect(pages, 3).count() == 3


def test_fetch_errors():
    def fails(e):
        def fetch(url):
            raise e
        return fetch

    for fetch in (fails(urllib.error.HTTPError("u", 503, "busy", {}, None)), fails(urllib.error.URLError("no route")), fails(TimeoutError()), lambda u: "<html>", lambda u: "[1]"):
        with pytest.raises(feed.Upstream):
            feed.get_json("u", fetch)
    assert feed.get_json("u", lambda u: '{"a": 1}') == {"a": 1}


def test_csv_has_crlf(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "x"', True)], "id string, title string, has_complaint boolean")
    store.write_csv(df.coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    raw = part.read_bytes()
    assert raw.count(b"\r\n") == 2 == raw.count(b"\n") and b'"say ""x"""' in raw


def test_evaluation_files(spark, tmp_path):
    pool, labels, scores = tmp_path / "pool.json", tmp_path / "labels.json", tmp_path / "out" / "scores.json"
    pool.write_text(json.dumps({"app_id": 1, "items": [{"id": "b", "title": "", "text": "x", "rating": 5}, {"id": "a", "title": "t", "text": "", "rating": 1}]}))
    labels.write_text(json.dumps({"a": {"score": -1, "has_complaint": True}, "zz": {"score": 0.5}}))
    store.write_artifact({"a": {"score": 0.2, "error": None}, "b": {"error": "no answer é"}}, str(scores))
    items = store.read_pool(spark, str(pool))
    assert [r["id"] for r in items.orderBy("ord").collect()] == ["b", "a"]
    own = verify.labeled_items(items, store.read_by_id(spark, str(labels)))
    assert [(r["id"], r["human_score"], r["has_complaint"], r["note"]) for r in own.collect()] == [("a", -1.0, True, "")]
    cache = store.read_by_id(spark, str(scores), "score double, error string")
    assert "é" in scores.read_text() and [r["id"] for r in verify.without_errors(items, cache).collect()] == ["a"]


def test_audits(spark):
    labels = spark.createDataFrame([("a", 0.5, None, "n"), ("b", -0.5, True, "")], "id string, score double, has_complaint boolean, note string")
    audits = spark.createDataFrame([("a", 1, 0.1, True, False), ("a", 2, 0.2, True, False), ("a", 3, 7.0, True, True), ("zz", 4, 0.0, False, True)], "id string, ord long, score double, has_complaint boolean, agreed boolean")
    rows = {r["id"]: r.asDict() for r in verify.audited(labels, audits).collect()}
    assert rows["a"] == {"id": "a", "note": "n", "score": 0.2, "has_complaint": True, "original_score": 0.5, "original_has_complaint": False, "reviewed": True, "agreed": False}
    assert rows["b"] | {"note": ""} == {"id": "b", "note": "", "score": -0.5, "has_complaint": True, "original_score": None, "original_has_complaint": None, "reviewed": False, "agreed": None}
    pool = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert verify.label_progress(pool, verify.audited(labels, audits)).first().asDict() == {"total": 3, "labeled": 2, "reviewed": 1}
    good, bad = verify.range_split(audits)
    assert good.count() == 3 and [r["error"] for r in bad.collect()] == ["score must be from -1 to 1"]


def test_calls_are_tried_again():
    waits, tries = [], []

    def flaky(payload):
        tries.append(payload)
        if len(tries) < 3:
            raise OSError("busy")
        return {"decisions": []}

    assert providers.call(flaky, {"x": 1}, M.DECISIONS, wait=waits.append) == {"decisions": []} and waits == [1, 2]
    for wrong in ({}, {"decisions": [{"pair_id": 1, "same_theme": True}]}, {"decisions": [{"pair_id": "1"}]}, [], None):
        with pytest.raises(providers.ProviderError):
            providers.call(lambda p, w=wrong: w, {}, M.DECISIONS, wait=waits.append)


def test_embedding_batches():
    sizes = []

    def embed(texts):
        sizes.append(len(texts))
        return [[float(len(t))] for t in texts]

    assert providers.embed_texts(embed, ["x" * i for i in range(250)]) == [[float(i)] for i in range(250)] and sizes == [100, 100, 50]
    with pytest.raises(providers.ProviderError):
        providers.embed_texts(lambda t: [[1.0]], ["a", "b"], wait=lambda s: None)


def reviews(spark, rows):
    return spark.createDataFrame([(k, i, "", t, 1 + k % 2, "positive", c) for k, (i, t, c) in enumerate(rows)], "ord long, id string, title string, text string, rating int, sentiment string, has_complaint boolean")


def test_embedding_keeps_the_last_of_an_id(spark):
    df = reviews(spark, [("a", "x", True), ("b", "yy", True), ("a", "zzz", True)])
    assert [(r["ord"], r["id"], r["vec"]) for r in providers.embed_reviews(df, lambda t: [[float(len(x))] for x in t]).orderBy("ord").collect()] == [(0, "a", [3.0]), (1, "b", [2.0])]


def at(angle):
    return [float(np.cos(np.radians(angle))), float(np.sin(np.radians(angle)))]


def themed(spark, judge, name=None):
    """Groups at angles 0-10, 37-40 (near the first: cosine from .75 to .89) and 120; what is no complaint takes no part."""
    angles = {"a1": 0, "a2": 2, "a3": 4, "b1": 38, "b2": 39, "c1": 120, "c2": 121, "d": 200}
    df = reviews(spark, [(i, f"{i} {v}", True) for i, v in angles.items()] + [("good", "good 0", False)])
    name = name or (lambda asked: {"themes": [{"cluster_id": c, "name": f"theme {c}", "description": "d", "recommendation": "r", "cited_review_ids": [x["id"] for x in shown] + ["made up"]} for c, shown in asked.items()]})
    found = M.model_themes(df, lambda texts: [at(float(t.split()[-1])) for t in texts], judge, name)
    return [r.asDict() for r in found.collect()]


def test_themes_end_to_end(spark):
    def judge(payload):
        assert all(len(p["group_a"]) <= 4 and all(len(t) <= 200 for t in p["group_a"] + p["group_b"]) for p in payload["pairs"])
        return {"decisions": [{"pair_id": p["pair_id"], "same_theme": True} for p in payload["pairs"]]}

    def broken(payload):
        raise OSError("down")

    apart = themed(spark, lambda p: {"decisions": []})
    assert [(t["negative_reviews"], sorted(t["cited_review_ids"]), t["citations_valid"]) for t in apart] == [(3, ["a1", "a2", "a3"], True), (2, ["b1", "b2"], True), (2, ["c1", "c2"], True)]
    assert [t["share_of_negative"] for t in apart] == [37.5, 25.0, 25.0] and apart[0]["sample_quotes"] == ["a1 0", "a2 2"]
    assert themed(spark, judge) == apart  # the merge would pass 35 % of the complaints
    providers.time.sleep, slept = (lambda s: None), providers.time.sleep
    try:
        assert themed(spark, broken) == apart
        with pytest.raises(providers.ProviderError):
            themed(spark, judge, lambda asked: {"themes": "none"})
    finally:
        providers.time.sleep = slept
    assert M.model_themes(reviews(spark, [("good", "good 0", False)]), lambda t: [at(0)] * len(t), judge, judge).count() == 0


def test_near_clusters_against_plain_version(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(40, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ord long, vec array<double>")
    own = similarity.complete_linkage(df, 0.9)
    groups = {}
    for c in own.collect():
        groups.setdefault(c["cluster_id"], []).append(c["ord"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(a, b): min(unit[i] @ unit[j] for i in groups[a] for j in groups[b]) for a in groups for b in groups if a < b}
    want = {k: v for k, v in want.items() if 0.6 <= v < 0.9}
    got = {(p["ca"], p["cb"]): p["sim"] for p in M.near_clusters(df, own, 0.6, 0.9).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_cluster_queries_against_plain_versions(spark, sf_dir):
    """complete_linkage and capped_merge of the registry, by matrices and loops."""
    rows = sorted((r["ord"], r["vec"]) for r in R._vectors(spark, sf_dir).collect())
    ids, x = [o for o, _ in rows], np.array([v for _, v in rows], float)
    norm = np.linalg.norm(x, axis=1)
    sim = np.divide(x @ x.T, np.outer(norm, norm), out=np.zeros((len(ids), len(ids))), where=np.outer(norm, norm) > 0)
    own = sim.copy()
    own[np.tril_indices(len(ids))] = -np.inf
    members = {i: [i] for i in range(len(ids))}
    while own.max() >= 0.35:  # merge the best pair, in place
        a, b = divmod(int(np.argmax(own)), len(ids))
        members[a] += members.pop(b)
        for k in members:
            if k != a:
                s = [own[min(c, k), max(c, k)] for c in (a, b)]
                own[min(a, k), max(a, k)] = min(s)
        own[b, :] = own[:, b] = -np.inf
    got = {(r["ord"], r["cluster_id"], r["member"]) for r in R.complete_linkage(spark, sf_dir).collect()}
    assert got == {(ids[m], ids[c[0]], k) for c in members.values() for k, m in enumerate(c)}

    least = {}
    for i in range(len(ids)):
        for j in range(i + 1, len(ids)):
            key = tuple(sorted((ids[i] % 40, ids[j] % 40)))
            if key[0] != key[1]:
                least[key] = min(least.get(key, 2), sim[i, j])
    sizes = {c: sum(i % 40 == c for i in ids) for c in {i % 40 for i in ids}}
    group, cap = {c: {c} for c in sizes}, max(1, int(0.35 * len(ids)))
    for (a, b), _ in sorted(least.items(), key=lambda p: (-p[1], p[0])):
        if (a + b) % 3 == 0 and group[a] is not group[b] and sum(sizes[c] for c in group[a] | group[b]) <= cap:
            both = group[a] | group[b]
            for c in both:
                group[c] = both
    merged = {}
    for r in R.capped_merge(spark, sf_dir).collect():
        assert r["cluster_id"] == r["ord"] % 40
        merged.setdefault(r["merged_id"], set()).add(r["cluster_id"])
    assert sorted(map(sorted, merged.values())) == sorted(map(sorted, {frozenset(g) for g in group.values()}))
    sized = similarity.cluster_sizes(R.capped_merge(spark, sf_dir).select("ord", F.col("merged_id").alias("cluster_id"))).collect()
    assert sum(r["n"] for r in sized) == len(ids) and sized[0]["n"] == max(r["n"] for r in sized) and abs(sum(r["share"] for r in sized) - 100) < 1


def test_large_component(spark):
    """A component of more rows than a matrix would do for."""
    n = 6000
    items, pairs = range(n), [(i, i + 1, 0.9 - i * 1e-6) for i in range(n - 1)]
    found = similarity.linked(items, pairs)
    assert found == [[i, i + 1] for i in range(0, n, 2)]


def test_prepare_query_against_given_scores(spark, sf_dir):
    """prepare_reviews, by the scorer and the rules in a loop."""
    from voxmill.operators.sentiment import _scorer

    score = _scorer()
    raw = {r["id"]: r for r in R.reviews(spark, sf_dir).select("id", "text", "rating").collect()}
    for r in R.prepare_reviews(spark, sf_dir).collect():
        text, rating = r["text"] or "", raw[r["id"]]["rating"]
        head = text.strip(". ")
        compound, neg = score(head)
        short = len(head) < 3
        s = (rating - 3) / 2 if short else 0.6 * compound + 0.4 * ((rating - 3) / 2)
        label = "positive" if s >= 0.15 else "negative" if s <= -0.15 else "neutral"
        assert (r["sentiment"], r["has_complaint"], r["sentiment_source"]) == (label, label == "negative" or rating <= 2 or (not short and neg >= 0.12), "lexicon")
        assert abs(r["sentiment_score"] - s) <= 5.0001e-5


def test_ranks_by_ranges(spark):
    r = np.random.default_rng(1)
    values = np.round(r.normal(size=500), 2)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {x["v"]: x["rank"] for x in evaluation.value_ranks(df, "v").collect()}
    order = np.sort(values)
    assert got == {v: (np.searchsorted(order, v, "left") + 1 + np.searchsorted(order, v, "right")) / 2 for v in set(values.tolist())}
    assert evaluation.value_ranks(df.limit(0), "v").count() == 0


def test_first_appearance_of_large_ids(spark):
    """Ties go to the first document and place, however large ids and long texts are."""
    big = 1 << 50
    rows = [(big + 2, "", "zebra " * 3, True, "negative"), (big + 1, "", "yak " * 3, True, "negative"), (big, "", "plain words here", False, "positive")]
    df = spark.createDataFrame(rows, "ord long, title string, text string, has_complaint boolean, sentiment string")
    terms = [r["term"] for r in keywords.negative_keywords(df).orderBy("rank").collect()]
    assert terms.index("yak") < terms.index("zebra")


def test_bootstrap_query_against_plain_version(spark, sf_dir):
    """All 200 resamples of bootstrap_stability as one product of matrices."""
    df = R.reviews(spark, sf_dir).select("id", keywords.terms_column().alias("s"), R.S.is_complaint().alias("c")).collect()
    df.sort(key=lambda r: int(r["id"]))
    docs = [[*r["s"], *(f"{a} {b}" for a, b in zip(r["s"], r["s"][1:], strict=False))] for r in df]
    names = sorted({t for d in docs for t in d})
    at = {t: k for k, t in enumerate(names)}
    n, place = np.zeros((len(docs), len(names))), np.full((len(docs), len(names)), np.inf)
    for i, d in enumerate(docs):
        for p, t in enumerate(d):
            n[i, at[t]] += 1
            place[i, at[t]] = min(place[i, at[t]], i * 2.0**31 + p)
    hit = np.array([r["c"] for r in df])
    times = np.zeros((200, len(docs)))
    for r in ingest.bootstrap_draws(spark, len(docs), 200).collect():
        times[r["rep"], r["ord"]] = r["times"]

    def top(t, k):
        y, r = t[hit] @ n[hit], t[~hit] @ n[~hit]
        a, nt, nr = y + r, y.sum(), r.sum()
        with np.errstate(all="ignore"):
            odds = lambda x, total: np.log((x + a) / (total + nt + nr - x - a))
            z = (odds(y, nt) - odds(r, nr)) / np.sqrt(1 / (y + a) + 1 / (r + a))
        some = np.flatnonzero((y >= 3) & np.isfinite(z))
        z = np.array([float(Decimal(repr(float(x))).quantize(Decimal("0.01"), ROUND_HALF_EVEN)) for x in z[some]])
        first = place[hit & (t > 0)][:, some].min(axis=0)
        return [names[some[i]] for i in sorted(range(len(some)), key=lambda i: (-z[i], first[i], names[some[i]]))[:k]]

    today = top(np.ones(len(docs)), 10)
    kept = [set(top(t, 10)) for t in times]
    want = {(t, k + 1, sum(t in s for s in kept)) for k, t in enumerate(today)}
    got = R.bootstrap_stability(spark, sf_dir).collect()
    assert {(r["term"], r["rank"], r["survived"]) for r in got} == want and all(r["percent"] == r["survived"] / 2 for r in got)


def test_python_stems_are_those_of_the_columns(spark, sf_dir):
    df = R.reviews(spark, sf_dir)
    odd = ["running hopped cities dishes buses passes glasses freely ease agree dye shoe bees less bus this", "ıİK won't RE-TRY -a a' it''s x--y ’s", "", None]
    df = df.select("text").unionByName(spark.createDataFrame([(t,) for t in odd], "text string")).withColumn("title", F.lit(None).cast("string"))
    stems = resampling.stemmer()
    for r in df.select(F.lower(F.coalesce("text", F.lit(""))).alias("t"), keywords.terms_column().alias("s")).collect():
        assert stems(r["t"]) == r["s"]


@pytest.mark.parametrize("first, held", [(10_000, 50_000), (12, 7), (1, 50_000)])
def test_bootstrap_counts_no_more_terms_than_can_lead(spark, monkeypatch, first, held):
    """The leaders are those of all terms, however few are counted at first; terms that cannot lead are never counted per resample."""
    monkeypatch.setattr(resampling, "FIRST", first)
    monkeypatch.setattr(resampling, "HELD", held)
    counted, count = [], resampling._counted
    monkeypatch.setattr(resampling, "_counted", lambda base, wanted, *rest: counted.extend(wanted) or count(base, wanted, *rest))
    r = np.random.default_rng(5)
    words = [a + b + c for a in "bcdfgk" for b in "aou" for c in ("lmo", "rna", "tpa")]
    rows = [(1000 - i, "", " ".join(words[k] for k in np.minimum(r.zipf(1.3, 30) + (5 * (i % 3 == 0)), len(words)) - 1), i % 3 == 0, "positive") for i in range(60)]
    df = spark.createDataFrame(rows, "ord long, title string, text string, has_complaint boolean, sentiment string")
    draws = [(k, int(o), int(t)) for k in range(7) for o, t in zip(*np.unique(941 + r.integers(0, 60, 60), return_counts=True), strict=True)]
    got = keywords.bootstrap_stability(df, spark.createDataFrame(draws, "rep int, ord long, times long"), 5, reps=7).collect()
    terms = keywords.document_terms(df)
    top = lambda t: [x["term"] for x in sorted(t.collect(), key=lambda x: (-round(x["z"], 2), x["first"], x["term"]))[:5]]
    kept = [top(keywords.log_odds(terms.join(spark.createDataFrame([d[1:] for d in draws if d[0] == k], "ord long, times long"), "ord"), times=F.col("times")).filter("z IS NOT NULL").select("term", F.bround("z", 2).alias("z"), "first")) for k in range(7)]
    today = top(keywords.log_odds(terms).filter("z IS NOT NULL").select("term", F.bround("z", 2).alias("z"), "first"))
    assert sorted((x["rank"], x["term"], x["survived"]) for x in got) == [(k + 1, t, sum(t in s for s in kept)) for k, t in enumerate(today)]
    assert len(counted) == len(set(counted)) and (first > 12 or len(counted) < terms.select("term").distinct().count())
