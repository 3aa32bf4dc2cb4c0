import random
import re

import numpy as np
import pyarrow as pa
import pytest

from voxmill.llm import neardup
from voxmill.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width):
    sets, parent = {}, {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in rows:
        if i is not None:
            parent[i] = i
            sets.setdefault(i, []).append(shingles(t, width))
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            for s in sets[a]:
                for t in sets[b]:
                    both = len(s & t)
                    if both and 100 * both >= 80 * (len(s) + len(t) - both):
                        x, y = root(a), root(b)
                        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def family(seed):
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(60)]
    rows = [(900 + k, " ".join(f"v{r.randrange(5000)}" for _ in range(r.randrange(1, 50)))) for k in range(30)]
    for k in range(120):  # many lie close to the threshold
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(60)] = f"x{r.randrange(10_000)}"
        rows.append((k, " ".join(w)))
    return rows + [(500 + k, rows[30 + k % 3][1]) for k in range(40)]


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(spark, width):
    rows = family(width)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), width).collect()}
    want = brute(rows, width)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(shingles(t, width)) and got[i]["kept"] == (want[i] == i) for i, t in rows)


def test_blocks_of_one(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 7)
    rows = family(5)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == brute(rows, 2)


def test_odd_rows(spark, odd_docs):
    rows = neardup.near_duplicates(odd_docs, 2).collect()
    assert len(rows) == odd_docs.count()
    want = brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()], 2)
    for r in rows:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] is None or want[r["doc_id"]] == r["doc_id"])
    assert {r["n_shingles"] for r in rows if r["doc_id"] in (2, 3, 4, 9)} == {0} and {r["n_shingles"] for r in rows if r["doc_id"] == 8} == {1}
    assert neardup.near_duplicates(odd_docs.limit(0)).count() == 0


def test_table(spark, documents):
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(documents, 2).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in documents.collect()], 2)


def test_signatures_estimate_similarity():
    sets = neardup.shingle_sets(pa.array([" ".join(f"a{i}" for i in range(1000)), " ".join(f"a{i}" for i in range(200, 1000)), "b c"]), 1)
    sig = neardup.signatures(sets, 512, block=100)
    assert abs(np.mean(sig[0] == sig[1]) - 0.8) < 0.08 and np.mean(sig[0] == sig[2]) < 0.02
    x = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(neardup._rank(x * np.uint32(65_537)))) == 1 << 16


def test_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in random.Random(1).sample(range(n), n)] + [(1000, 1001), (1000, 1000)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert components(links.limit(0)).count() == 0
