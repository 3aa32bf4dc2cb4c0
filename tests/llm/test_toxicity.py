import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex

from voxmill.llm import queries as Q
from voxmill.llm import toxicity as X


@pytest.mark.parametrize("wide", [0, 20, 512])
def test_nearest_is_exact(monkeypatch, wide):
    monkeypatch.setattr(X, "WIDE", wide)
    r = np.random.default_rng(3)
    n, v = 700, 60
    rows, terms, counts = [], [], []
    for i in range(n):
        t = np.sort(r.choice(v, r.integers(1, 8), replace=False))
        rows += [i] * len(t)
        terms += t.tolist()
        counts += r.integers(1, 5, len(t)).tolist()
    row, term, count = np.array(rows), np.array(terms), np.array(counts, float)
    factor = r.random(v) * (np.arange(v) > 3)
    dense = np.zeros((n, v))
    dense[row, term] = (1 + np.log(count)) * factor[term]
    dense /= np.maximum(np.linalg.norm(dense, axis=1), 1e-300)[:, None]
    ids = r.permutation(n) + 10
    index = X.Search(X.Index.build(ids, np.arange(n) % 2, row, term, count, factor))
    for asked in range(60):
        t, w = index.weigh(np.sort(r.choice(v, r.integers(1, 9), replace=False)), np.ones(1))
        own = asked if asked % 3 == 0 else -1
        found, cosines = index.nearest(t, w, 15, own)
        q = np.zeros(v)
        q[t] = w
        want = dense @ q
        if own >= 0:
            want[np.flatnonzero(ids == index.ids[own])] = 0
        order = [i for i in np.lexsort((ids, -np.round(want, 12))) if want[i] > 0][:15]
        assert np.allclose(cosines, want[order]) and index.ids[found].tolist() == ids[order].tolist()


def plain_terms(text):
    out = Counter()
    for w in regex.findall(r"[\p{L}\p{N}\p{M}_]+", text.lower()):
        out.update(["=" + w] if len(w) <= 24 else [w[i : i + 3] for i in range(len(w) - 2)])
        out.update("^" + w[:n] for n in (4,) if len(w) >= n)
    return out


@pytest.mark.parametrize("window", [1 << 17, 64, 40])
def test_terms_of_whole_texts(monkeypatch, window):
    """Terms stand for the same hash wherever a text is cut, and different ones for different hashes."""
    monkeypatch.setattr(X, "WINDOW", window)
    texts = ["Bad bad. badly «Moron!» x_1", None, "", " ", "good " * 50 + "bad", "字" * 40 + "毒物毒" + "字" * 60, "é" * 25 + " ééé", "w" * 24, "w" * 25, "e\u0301te\u0301s e\u0301", "a-b " + "q" * 300 + "z end", "ab\tcd\nef", "toxic", "toxi toxicity toxic", "x" * 23 + "字" * 5]
    doc, term, n = X.Vectors()(pa.array(texts))
    own = [Counter(dict(zip(term[doc == i].tolist(), n[doc == i].tolist(), strict=True))) for i in range(len(texts))]
    want = [plain_terms(t or "") for t in texts]
    names = {}
    for got, plain in zip(own, want, strict=True):
        assert sorted(got.values()) == sorted(plain.values())
    for t in {t for c in want for t in c}:  # a term's hash is the one that is where the term is
        cands = set.intersection(*({h for h, k in own[i].items() if k == c[t]} for i, c in enumerate(want) if t in c)) - set().union(*(own[i] for i, c in enumerate(want) if t not in c))
        assert cands, t
        names[t] = cands
    monkeypatch.setattr(X, "WINDOW", 1 << 17)
    whole = X.Vectors()(pa.array(texts))
    assert all(np.array_equal(a, b) for a, b in zip(whole, (doc, term, n), strict=True))
    vocabulary = np.unique(term)[::2]
    doc2, number, n2 = X.Vectors(vocabulary)(pa.array(texts))
    keep = np.isin(term, vocabulary)
    assert np.array_equal(doc2, doc[keep]) and np.array_equal(vocabulary[number], term[keep]) and np.array_equal(n2, n[keep])
    assert not len(X.Vectors(np.zeros(0, np.uint64))(pa.array(texts))[0])


def test_query_against_plain_version(spark, sf_dir, documents):
    """Neighbours, votes and scores of every document by dictionaries; the curve by its condition for a minimum."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = X.fit(documents, labels)
    got = {r["doc_id"]: r for r in Q.op5_toxicity(spark, sf_dir).collect()}
    texts = {r["doc_id"]: plain_terms(r["text"] or "") for r in documents.collect()}
    learn = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["doc_id"] in texts}
    df, hits, has = Counter(), Counter(), Counter()
    for t in texts.values():
        df.update(t.keys())
    for i, y in learn.items():
        has.update(texts[i].keys())
        hits.update(dict.fromkeys(texts[i], y))
    p, q = sum(learn.values()), len(learn) - sum(learn.values())
    factor = {}
    for t, n in has.items():
        a, b = hits[t], n - hits[t]
        chi = (a * (q - b) - b * (p - a)) ** 2 * (p + q) / (p * q * n * max(p + q - n, 0.5))
        factor[t] = (math.log((len(texts) + 1) / (df[t] + 1)) + 1) * math.sqrt(chi)

    def unit(c):
        w = {t: (1 + math.log(n)) * factor[t] for t, n in c.items() if factor.get(t)}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    index = {i: unit(texts[i]) for i in learn}

    def odds(own, without=None):
        near = sorted(((-round(sum(x * e.get(t, 0) for t, x in own.items()), 12), i) for i, e in index.items() if i != without))
        near = [(i, -s) for s, i in near if s < 0][:15]
        w = [1 / (1.05 - min(s, 1)) for _, s in near]
        raw = (sum(x for x, (i, _) in zip(w, near, strict=True) if learn[i]) + 0.02) / (sum(w) + 0.04)
        return near, math.log(raw / (1 - raw))

    assert set(got) == set(texts)
    for i, c in texts.items():
        near, x = odds(unit(c))
        found = [(e["doc_id"], e["cosine"]) for e in got[i]["evidence"]]
        assert [s for _, s in found] == pytest.approx([s for _, s in near], abs=1e-9)
        assert all(a == b for (a, s), (b, _) in zip(found, near, strict=True) if sum(abs(s - o) < 1e-9 for _, o in near) == 1)
        want = 1 / (1 + math.exp(-(model.slope * x + model.shift))) if near else model.base
        assert got[i]["score"] == pytest.approx(want, abs=1e-9)
    x = np.array([odds(index[i], i)[1] for i in learn])
    y, p = np.array(list(learn.values())), 1 / (1 + np.exp(-(model.slope * x + model.shift)))
    assert abs(((p - y) * x).sum() + model.slope - 1) < 1e-3 and abs((p - y).sum() + model.shift) < 1e-3


@pytest.fixture(scope="module")
def planted(spark):
    words = [f"word{i}" for i in range(200)]
    r = np.random.default_rng(1)
    rows = [(i, " ".join(r.choice(words, 40)) + (" you moron scum" if i % 7 == 0 else "")) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(700)] + [(None, 1, 1), (3, 1, None), (99_999, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(spark, planted):
    docs, labels = planted
    rows = X.score(docs, X.fit(docs, labels)).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) == int(r["doc_id"] % 7 == 0)
        assert all(zlib.crc32(str(e["doc_id"]).encode()) % 5 for e in r["evidence"])
    assert all(r["evidence"] for r in rows if r["doc_id"] % 7 == 0)


def test_nothing_held_out_is_learned(spark, planted):
    docs, labels = planted
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = ({r["doc_id"]: r["score"] for r in X.score(docs, X.fit(docs, x)).collect()} for x in (labels, flipped))
    assert a == b


def test_odd_rows(spark, planted, odd_docs):
    model = X.fit(*planted)
    rows = X.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(r["predicted"] == 0 and math.isfinite(r["score"]) for r in rows)
    kept = X.keep_clean(odd_docs.unionByName(odd_docs.limit(1).selectExpr("doc_id", "'moron scum' AS text", *[f"`{c}`" for c in odd_docs.columns[2:]])), model)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert X.score(odd_docs.limit(0), model).count() == 0


def test_no_labels(spark, planted):
    docs, labels = planted
    assert {r["score"] for r in X.score(docs, X.fit(docs, labels.limit(0))).collect()} == {0.0}
    assert X.fit(docs.limit(0), labels).sent is None
    assert {r["predicted"] for r in X.score(docs, X.fit(docs, labels.filter("toxic = 1"))).collect()} == {1}


def test_all_neighbours_are_evidence(spark, planted):
    docs, labels = planted
    rows = X.score(docs, X.fit(docs, labels)).collect()
    assert {len(r["evidence"]) for r in rows} == {15}
    assert all(r["evidence"] == sorted(r["evidence"], key=lambda e: (-e["cosine"], e["doc_id"])) for r in rows)


def test_ties_and_repeats(spark):
    """Equal texts get equal scores, and of examples with equal cosines the smaller ids vote."""
    docs = spark.createDataFrame([(i, "calm words here" if i % 2 else "foul moron here") for i in range(200)] + [(6, "foul moron here")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, toxic int")
    rows = X.score(docs, X.fit(docs, labels)).collect()
    assert len(rows) == 203 and len({(r["score"], r["doc_id"] % 2) for r in rows}) == 2
    first = [i for i in range(0, 200, 2) if zlib.crc32(str(i).encode()) % 5][:15]
    assert all([e["doc_id"] for e in r["evidence"]] == first for r in rows if r["doc_id"] % 2 == 0)
