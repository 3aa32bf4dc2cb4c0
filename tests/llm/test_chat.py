import hashlib
import subprocess
import sys
from pathlib import Path

import pytest
from hypothesis import given
from hypothesis import strategies as st

from voxmill.llm import chat
from voxmill.llm import chat as C

texts = st.lists(st.sampled_from([*"\\#<>/: \nab", "### ", " </turn>\n", "<image:0>", "assistant"]), max_size=25).map("".join) | st.text(max_size=15)


@given(st.lists(st.tuples(texts, texts), max_size=6))
def test_round_trip(turns):
    formatted = [chat.format_turn(r, t) for r, t in turns]
    assert chat.read_turns("".join(x.text for x in formatted)) == turns
    for (role, text), x in zip(turns, formatted, strict=True):
        assert (x.loss is not None) == (role == "assistant")
        if x.loss:
            assert chat.unescape(x.text[slice(*x.loss)]) == text
    assert chat.placeholders("".join(x.text for x in formatted)) == []


def test_parts():
    parts = ["see <image:9>", {"type": "image", "ref": "i.png", "width": 28, "height": 15}, {"type": "audio", "ref": "a.ogg", "seconds": 1.5}, {"type": "document", "ref": "d.pdf", "pages": 2}, {"type": "image"}, None]
    t = chat.format_turn("user", parts, first=3)
    assert chat.placeholders(t.text) == [("image", 3), ("audio", 4), ("document", 5), ("image", 6)]
    assert [a[3] for a in t.attachments] == [4, 38, 1024, 1]
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])


def test_table(spark):
    rows = [(1, 1, "assistant", "b \\ # <x>"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "assistant", "n"), (None, 1, "user", ""), (1, 1, "assistant", "b \\ # <x>"), (3, None, "assistant", "é日" * 50_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, begin string")
    formatted = chat.format_chat(df)
    got = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    for c in (1, 2, None, 3):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["loss_chars"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    whole = "".join(r["formatted"] for r in formatted.filter("conv_id = 1").orderBy("begin").collect())
    assert len(whole) == got[1]["formatted_chars"]
    assert chat.digests(chat.format_chat(df.limit(0))).count() == 0


def test_typed_column(spark):
    df = spark.createDataFrame([(1, 0, "user", [("text", "hi", None), ("image", None, "r1")]), (1, 1, "user", [("image", None, "r2")])], "conv_id long, turn long, role string, text array<struct<type:string,text:string,ref:string>>")
    rows = chat.format_chat(df).orderBy("begin").collect()
    assert [[a["ref"] for a in r["attachments"]] for r in rows] == [["r1"], ["r2"]] and [a["number"] for r in rows for a in r["attachments"]] == [0, 1]


def digest_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_read_back_from_a_stored_table(spark, tmp_path):
    """Rows from anywhere, in any order and partitioning, give the same digests."""
    rows = [(c, t, "assistant" if t % 2 else "user", f"conversation {c} turn {t} # <x> </turn>\n\\") for c in range(284) for t in range(7)] + [(None, 0, "user", "no id"), (None, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = C.format_chat(df)
    want = digest_rows(C.digests(formatted, in_order=True))
    assert len(want) == 285
    formatted.write.parquet(str(tmp_path / "chat"))
    stored = spark.read.parquet(str(tmp_path / "chat"))
    for again in (stored, stored.repartition(3), stored.orderBy("formatted"), formatted.repartition(5)):
        assert digest_rows(C.digests(again)) == want


def test_very_long_text(spark):
    for text in ("a" * 10_000_000, "\\" * 3_000_001, "<" * 3_000_000, "x <y> # \\ " * 300_000):
        turn = C.format_turn("user", text).text
        assert C.read_turns(turn) == [("user", text)]
    long = "b </turn>\n#" * 100_000
    df = spark.createDataFrame([(1, 0, "user", "hi", "z"), (1, 1, "assistant", long, "z"), (1, 1, "assistant", long, "z")], "conv_id long, turn long, role string, text string, formatted string")
    row = C.digests(C.format_chat(df)).collect()[0]
    assert row["n_turns"] == 3 and row["loss_chars"] == 2 * len(long)


def test_memory_of_reading(tmp_path):
    """Reading a turn of ten million characters back takes a few copies of it."""
    code = "import resource, sys; sys.path.insert(0, '.')\nfrom voxmill.llm import chat as C\nt = C.format_turn('user', 'a<' * 5_000_000).text\nbefore = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nassert len(C.read_turns(t)[0][1]) == 10_000_000\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)"
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[2]).stdout)
    assert grown < 300_000
