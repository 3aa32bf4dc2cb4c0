import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.oracle import connect, same
from voxmill.llm import linededup, mixing, toxicity
from voxmill.llm import queries as Q
from voxmill.llm.common import only, release, written


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    same(Q.QUERIES[name](spark, sf_dir), connect(sf_dir), Q.ORACLE_SQL[name])


def test_registered():
    import __spark_entry__ as E

    names = list(E.queries())
    assert [sum(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)] == [1] * 10 and "pipeline" in names


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def plain_clean(spark, docs, sf_dir):
    """Scores of the operator, which has a plain version of its own; the stage's decision by a filter on rows."""
    scored = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).select("doc_id", "score").collect()
    toxic = {r["doc_id"] for r in scored if r["score"] >= 0.5}
    return Counter({r: n for r, n in rows_of(docs).items() if r[0] not in toxic})


def plain_lines(docs):
    """Texts as the operator leaves them, which has a plain version of its own; emptied documents go."""
    out = Counter()
    for r in linededup.dedup_lines(docs).collect():
        if not r["removed_lines"]:
            out[r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]] += 1
        elif r["text"].strip(" "):
            out[r["doc_id"], r["text"], r["lang"], r["source"], len(r["text"])] += 1
    return out


def plain_near(docs):
    """All pairs of five-word shingle sets."""
    rows, sets = [tuple(r) for r in docs.collect()], {}
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        if r[0] is not None and words:
            sets.setdefault(r[0], []).append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    parent = {i: i for i in sets}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if any(100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    out, best = Counter(), {}
    for r in rows:
        if r[0] is None:
            out[r] += 1
        elif r[0] not in parent or root(r[0]) == r[0]:
            key = (-len(r[1]) if r[1] is not None else 1, r[1] or "", *map(str, r[2:]))
            if r[0] not in best or key < best[r[0]][0]:
                best[r[0]] = (key, r)
    return out + Counter(r for _, r in best.values())


def plain_mix(docs):
    copies = {}
    for r in mixing.mix(docs).groupBy("doc_id", "k", "r").agg(F.sum("copies").alias("n")).collect():
        copies[r["doc_id"], r["k"], r["r"]] = r["n"]
    out = Counter()
    for r in docs.select(*mixing._named(docs, "doc_id", "text"), F.struct("*").alias("row")).distinct().collect():
        out[tuple(r["row"])] += copies[r["doc_id"], r["k"], r["r"]]
    return +out


def plain_packed(docs):
    library, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for r in docs.collect():
        ids, start = library.encode(r["text"] or "", add_special_tokens=False).ids + [1], 0
        while start < len(ids):
            n = min(2048, 1 << (len(ids) - start).bit_length() - 1)
            out[r["doc_id"], start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()), len(ids)] += 1
            start += n
    return out


def check_stages(spark, sf_dir, docs):
    """Every stage on its own input against a plain version; gives the rows of each."""
    plain = [lambda d: plain_clean(spark, d, sf_dir), plain_lines, plain_near, plain_mix]
    left = []
    for (name, stage), want in zip(C.STAGES[:-1], plain, strict=True):
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == docs.columns and rows_of(out) == want(docs), name
        left.append(out.count())
        docs = out
    packed = C.STAGES[-1][1](spark, docs, sf_dir)
    assert rows_of(packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens")) == plain_packed(docs)
    return [*left, packed.count()]


def test_stages(spark, sf_dir, documents):
    left = check_stages(spark, sf_dir, documents)
    assert 0 < left[2] < left[1] <= left[0] < documents.count()
    assert C.run(spark, sf_dir).count() == left[-1]


def test_odd_rows(spark, sf_dir, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    left = check_stages(spark, sf_dir, docs)
    assert left[0] == docs.count() and left[-1] > 0
    assert check_stages(spark, sf_dir, docs.limit(0)) == [0] * 5


def tables(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir")) / "voxmill"
    return {p.name for p in folder.iterdir()} if folder.exists() else set()


def test_intermediate_tables_go(spark):
    """What a scope writes is deleted at its end, but for what it keeps."""
    before = tables(spark)
    with only("kept") as keep:
        part = written(spark.range(10), "part")
        with only("inner") as inner:
            held = inner(written(part, "gone").filter("id > 4"))
        assert len(tables(spark) - before) == 2
        out = keep(held.filter("id > 7"))
    assert {n.split("-")[0] for n in tables(spark) - before} == {"kept"} and out.count() == 2
    release()
    assert not tables(spark) & {n for n in tables(spark) if n.startswith("kept")}
