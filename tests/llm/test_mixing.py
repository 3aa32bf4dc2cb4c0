import math
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from voxmill.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w, full = {s: weights[k % len(weights)] for k, s in enumerate(names)}, set()
    total = share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(most * sizes[s] for s in full)) / sum(w[s] for s in rest) if rest else 0
        new = {s for s in rest if level * w[s] > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in full else level * w[s] for s in names}
        full |= new


def check(docs):
    rows = mixing.mix(docs, fan=8).collect()
    own = docs.select("doc_id", "text", "source").collect()
    assert len(rows) == len(own)
    sizes = {}
    for r in own:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
    want = targets(sizes)
    assert sorted(r["size"] for r in rows) == sorted(len(WORD.findall(r["text"] or "")) for r in own)
    assert all(0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in rows)
    assert {round(r["target"], 4) for r in rows} <= {round(x, 4) for x in want.values()}
    return rows, want


def by_source(rows):
    out = {}
    for r in rows:
        out.setdefault(r["source"], []).append(r)
    return out


def mixed(docs, **options):
    """mix() with each row's source."""
    own = docs.select(*mixing._named(docs, "doc_id", "text"), "source").distinct().withColumnsRenamed({"doc_id": "i", "k": "k1", "r": "r1"})
    plan = mixing.mix(docs, **options)
    return plan.join(own, plan["doc_id"].eqNullSafe(own["i"]) & (plan["k"] == own["k1"]) & (plan["r"] == own["r1"])).drop("i", "k1", "r1").collect()


def test_documents(spark, documents):
    rows, want = check(documents)
    for own in by_source(mixed(documents, fan=8)).values():  # small groups have no room for long documents
        largest = max((r["size"] for r in own if r["size"] and r["target"] % r["source_size"]), default=0)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= largest / 2 + 1e-6
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(documents.repartition(5), fan=8).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_sources_come_near_their_targets(spark, sf_dir):
    """With 50 documents a source and more: within 1 %, or half the shortest open document."""
    path = Path(sf_dir).parent / "sf0.01" / "documents.parquet"
    if not path.exists():
        pytest.skip("needs the larger table")
    for own in by_source(mixed(spark.read.parquet(str(path)))).values():
        open_ = [r["size"] for r in own if r["size"] and r["target"] % r["source_size"]]
        off = abs(sum(r["taken"] for r in own) - own[0]["target"])
        assert off <= max(0.01 * own[0]["target"], min(open_, default=0) / 2) + 1e-6, (own[0]["source"], off, own[0]["target"])


def test_against_plain_version(spark, documents):
    """What is taken, by a loop over lists of probabilities; only the draws come from the operator."""
    found = mixed(documents)
    seed = 17
    plan = mixing.mix(documents)
    keys = [F.col(c) for c in mixing._KEYS]
    drawn = {r["doc_id"]: r for r in plan.select("doc_id", mixing._draw(seed, *keys).alias("draw"), F.xxhash64(F.lit(-seed), *keys).alias("h")).collect()}
    for own in by_source(found).values():
        rate = own[0]["target"] / own[0]["source_size"] if own[0]["source_size"] else 0
        base = min(math.floor(rate + 1e-12), 2)
        docs = [r for r in own if r["size"] and rate - base > 1e-12]
        docs.sort(key=lambda r: (-r["size"], drawn[r["doc_id"]]["h"]))
        assert len(docs) <= 64 and all(r["size"] <= 16 * sum(x["size"] for x in docs) / len(docs) for r in docs)  # one group, no giants
        p, size, last = [rate - base] * len(docs), [r["size"] for r in docs], None
        for i in range(len(docs)):
            if last is not None:  # the pool has settled
                p[i] = float(p[i] >= 0.5)
                continue
            words, mass = sum(size[i + 1 :]), sum(a * b for a, b in zip(p[i + 1 :], size[i + 1 :], strict=True))
            up, down = min((1 - p[i]) * size[i], mass), min(p[i] * size[i], words - mass)
            can = [(1 - p[i]) * size[i] <= mass, p[i] * size[i] <= words - mass]
            rises = drawn[docs[i]["doc_id"]]["draw"] * (up + down) < down if can[0] == can[1] else can[0]
            moved = up if rises else -down
            whole = abs(moved) == (1 - p[i]) * size[i] if rises else down == p[i] * size[i]
            p[i] = float(rises) if whole else p[i] + moved / size[i]
            for j in range(i + 1, len(docs)):
                p[j] = p[j] * (mass - moved) / mass if moved >= 0 and mass else 1 - (1 - p[j]) * (words - mass + moved) / (words - mass) if words > mass else p[j]
            if not whole:
                last = i
        want = {r["doc_id"]: base + (x >= 0.5) for r, x in zip(docs, p, strict=True)}
        assert {r["doc_id"]: r["copies"] for r in docs} == want


def test_giants_meet_the_whole_source(spark):
    """One document of a tenth of a source with 3,000 others settles, and the source's words come near the target."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9 if i else 1700), "a" if i < 3000 else "b") for i in range(6000)], "doc_id long, text string, source string")
    for seed in (3, 1003):
        rows = mixing.mix(docs, weights=(1, 2), share=0.8, seed=seed).collect()
        for target in {r["target"] for r in rows}:
            assert abs(sum(r["taken"] for r in rows if r["target"] == target) - target) <= 1


def test_means(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "a" if i < 40 else "b") for i in range(80)], "doc_id long, text string, source string")
    total = {}
    for seed in range(12):
        for r in mixing.mix(docs, weights=(1, 3), share=1.0, seed=seed * 100).collect():
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["copies"]
    assert abs(sum(total[i] for i in range(40)) / 40 / 12 - 0.5) < 0.1


def test_odd_rows(spark, odd_docs):
    check(odd_docs)
    assert mixing.mix(odd_docs.limit(0)).count() == 0
    only_empty = odd_docs.filter("doc_id IN (2, 3, 4)")
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.mix(only_empty).collect()} == {(0, 0.0, 0)}


@pytest.mark.parametrize("name", ["odd", "table"])
def test_take(spark, odd_docs, documents, name):
    """Rows come with all their values, each as often as planned."""
    docs = odd_docs if name == "odd" else documents
    plan = mixing.mix(docs)
    copies = Counter()
    for r in plan.groupBy("doc_id", "k", "r").agg(F.sum("copies").alias("n")).collect():
        copies[r["doc_id"], r["k"], r["r"]] = r["n"]
    want = Counter()
    for r in docs.select(*mixing._named(docs, "doc_id", "text"), F.struct("*").alias("whole")).distinct().collect():
        want[tuple(r["whole"])] += copies[r["doc_id"], r["k"], r["r"]]
    for own in (docs, docs.repartition(3)):
        got = mixing.take(own)
        assert got.columns == docs.columns
        assert Counter(map(tuple, got.collect())) == +want


def test_rows_that_differ_elsewhere(spark):
    """Rows equal in id, text and source are told apart by their other columns, so reruns keep the same."""
    docs = spark.createDataFrame([(1, "a b", "s", i) for i in range(40)] + [(None, "c d", "s", i % 2) for i in range(40)] + [(None, None, None, 1)] * 5, "doc_id long, text string, source string, copies int")
    first, again = (sorted(map(tuple, mixing.take(d, share=0.7).collect()), key=repr) for d in (docs, docs.repartition(7)))
    assert first == again and 50 <= len(first) <= 62
    assert mixing.mix(docs).count() == 85
