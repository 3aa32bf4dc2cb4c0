import random
from collections import Counter

from voxmill.llm import linededup


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, removed_lines string")
    out = linededup.dedup_lines(df, **options)
    assert out.columns == ["doc_id", "text", "n_lines", "removed_lines", "removed_chunks"]
    return {r["doc_id"]: r for r in out.collect()}


def filler(seed, n):
    r = random.Random(seed)
    return [" ".join(f"u{seed}x{r.randrange(10**6)}" for _ in range(9)) for _ in range(n)]


def test_shared_passage(spark):
    passage = filler("p", 12)
    rows = [(k, "\n".join(filler(k, 3 + k) + passage + filler(k + 100, 4))) for k in range(8)]
    got = run(spark, rows)
    assert got[0]["text"] == rows[0][1] and got[0]["removed_lines"] == 0  # the first keeps it
    for k in range(1, 8):
        left = got[k]["text"].split("\n")
        assert [x for x in left if x not in passage] == filler(k, 3 + k) + filler(k + 100, 4)  # own lines all stay, in order
        assert got[k]["removed_lines"] >= 6 and len(left) == got[k]["n_lines"] - got[k]["removed_lines"]


def test_long_line_alone(spark):
    line = " ".join(f"word{i}" for i in range(55))
    got = run(spark, [(1, "\n".join(["a", line, "b"])), (2, "\n".join(["c c", line, "d d"])), (3, "short\nshort"), (4, "e")])
    assert got[1]["removed_lines"] == 0 and got[2]["text"] == "c c\nd d" and got[2]["removed_lines"] == 1


def test_short_single_lines_stay(spark):
    rows = [(k, f"own {k} a\nAll rights reserved.\nown {k} b") for k in range(20)]
    assert all(r["removed_lines"] == 0 for r in run(spark, rows).values())


def test_copies(spark):
    text = "\n".join(filler("c", 10))
    got = run(spark, [(3, text), (1, text), (2, text)])
    assert got[1]["text"] == text and got[2]["removed_lines"] == got[3]["removed_lines"] > 0


def test_clean_documents_stay(spark):
    rows = [(k, "\n".join(filler(k, 20))) for k in range(30)]
    assert {k: r["text"] for k, r in run(spark, rows).items()} == dict(rows)


def test_against_plain_version(spark, documents):
    """Chunks as the operator cuts them; which of them go, by a dictionary of their texts."""
    cut = linededup._chunked(documents.select("doc_id", "text", *linededup._keys("doc_id", "text")), "text", 2, 50).collect()
    seen, gone = {}, {}
    for r in sorted(cut, key=lambda r: (r["_k1"], r["_k2"])):
        for i, c in enumerate(r["_chunks"]):
            lines = r["_lines"][c["a"] - 1 : c["a"] - 1 + c["n"]]
            text = "\n".join(lines)
            if (c["n"] > 1 or len(text.split()) >= 50) and text.strip(" "):
                if text in seen:
                    gone.setdefault(r["doc_id"], set()).add(i)
                seen[text] = True
        assert sum(c["n"] for c in r["_chunks"]) == len(r["_lines"])
    for r in linededup.dedup_lines(documents).collect():
        assert r["removed_chunks"] == len(gone.get(r["doc_id"], ()))


def test_odd_rows(spark, odd_docs):
    out = linededup.dedup_lines(odd_docs)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and set(odd_docs.columns) <= set(out.columns)
    assert sum(r["text"] is None for r in rows) == 2 and {r["n_lines"] for r in rows if r["text"] is None} == {0}
    assert linededup.dedup_lines(odd_docs.limit(0)).count() == 0
    kept = [c for c in odd_docs.columns if c not in ("text", "removed_lines")]
    assert Counter(tuple(r[c] for c in kept) for r in rows) == Counter(tuple(r[c] for c in kept) for r in odd_docs.collect())


def plain_left(before, after, least=50):
    """Stretches of whole lines with more than `least` words that stood in two documents and stand in two still."""
    def stretches(text):
        lines = [x for x in text.split("\n") if x.split()]
        out = set()
        for i in range(len(lines)):
            n = 0
            for j in range(i, len(lines)):
                n += len(lines[j].split())
                if n > least:
                    out.add("\n".join(lines[i : j + 1]))
                    break
        return out

    seen, left = set(), set()
    for k in sorted(after):
        own = stretches(after[k]) & stretches(before[k])
        left |= own & seen
        seen |= own
    return left


def test_no_repeated_stretch_is_left(spark):
    """Passages of short lines, in contexts of their own, go whole but for the first, whatever their chunks are."""
    r, texts, own, place = random.Random(8), {}, {}, 0
    for n, width in [(3, 20), (5, 12), (8, 12), (20, 12), (60, 1), (2, 30)] * 6:
        passage = ["".join(f"p{place}l{i} " * width).strip() + f" {r.random()}" for i in range(n)]
        for copy in range(2):
            k = place * 2 + copy
            own[k] = filler(f"a{k}", 3) + filler(f"b{k}", 2)
            texts[k] = "\n".join(own[k][:3] + passage + own[k][3:])
        place += 1
    got = run(spark, list(texts.items()))
    assert all(got[k]["text"] == (texts[k] if k % 2 == 0 else "\n".join(own[k])) for k in texts)
    assert all(got[k]["removed_lines"] == got[k]["n_lines"] - len(got[k]["text"].split("\n")) for k in texts)
    assert plain_left(texts, texts) and not plain_left(texts, {k: g["text"] for k, g in got.items()})


def test_first_occurrence_stays_in_periodic_text(spark):
    line = "one two three four five six seven eight nine ten"
    got = run(spark, [(1, "\n".join([line] * 40)), (2, "\n".join(["own line", *[line] * 6, "end"]))], divisor=1 << 40)
    assert got[1]["text"] == "\n".join([line] * 5) and got[2]["text"] == "own line\nend"


def test_no_repeated_stretch_in_documents(spark, documents):
    before = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    after = {r["doc_id"]: r["text"] or "" for r in linededup.dedup_lines(documents).collect()}
    assert not plain_left(before, after)


def test_exact_copies_of_long_documents(spark):
    """Of a copy all lines go, and of a passage among others all but its rim, in the order of the document."""
    lines = filler("copy", 2000)
    passage = filler("shared", 30)
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines)), (3, "\n".join(filler("x", 5) + passage + filler("y", 5))), (4, "\n".join(filler("z", 7) + passage + filler("q", 2)))]
    got = run(spark, rows)
    assert got[1]["removed_lines"] == got[3]["removed_lines"] == 0 and got[2]["removed_lines"] >= 0.95 * 2000
    assert got[4]["removed_lines"] == 30 and got[4]["text"].split("\n") == filler("z", 7) + filler("q", 2)
