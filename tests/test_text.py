import pytest
from pyspark.sql import functions as F

from voxmill.functions import scores as S
from voxmill.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("dirty, clean", [("  a &amp;  b\n<b>c</b> https://x.y/z d ", "a & b c d"), ("", ""), (None, ""), ("&lt;b&gt;x&lt;/b&gt;", "x"), ("a  b", "a b"), ("it’s", "it's"), ("go www.a.b now", "go now")])
def test_clean(spark, dirty, clean):
    assert one(spark, dirty, T.clean_text) == clean
    if "&lt;" not in (dirty or ""):
        assert one(spark, dirty, lambda c: T.clean_text(c, full=False)) == clean


def test_tokens(spark):
    assert one(spark, "I WON'T be Charged twice, re-try it!", T.tokenize) == ["charged", "twice", "re-try"]
    assert one(spark, None, T.tokenize) == []


@pytest.mark.parametrize("group", [("charge", "charged", "charging", "charges"), ("cancel", "cancelled", "cancels", "cancelling"), ("refund", "refunds", "refunded"), ("crash", "crashes", "crashed", "crashing")])
def test_stem_merges(spark, group):
    got = {r[0] for r in spark.createDataFrame([(w,) for w in group], "w string").select(T.stem(F.col("w"))).collect()}
    assert len(got) == 1


@pytest.mark.parametrize("word, stem", [("less", "less"), ("was", "was"), ("this", "this"), ("happy", "happy"), ("process", "process"), ("address", "address"), ("boxes", "boxe"), ("billing", "bil"), ("bill", "bill"), ("paying", "paying"), ("charge", "charg")])
def test_stem_exact(spark, word, stem):
    assert one(spark, word, T.stem) == stem


@pytest.mark.parametrize("tokens, want", [([], []), (["a"], []), (["a", "b", "c"], ["a b", "b c"])])
def test_bigrams(spark, tokens, want):
    assert one(spark, tokens, T.bigrams, "array<string>") == want


def test_shorten(spark):
    assert one(spark, "x" * 280, T.shorten) == "x" * 280
    assert one(spark, "x" * 281, T.shorten) == "x" * 280 + "…"
    assert one(spark, "ab " * 100, T.shorten) == ("ab " * 100)[:280].rsplit(" ", 1)[0] + "…"


def test_headline_and_bucket(spark):
    df = spark.createDataFrame([("", "hi."), ("A", "b"), (None, None)], "t string, x string")
    assert [r[0] for r in df.select(T.headline(F.col("t"), F.col("x"))).collect()] == ["hi", "A. b", ""]
    assert [one(spark, "x" * n, T.length_bucket)[:5] for n in (39, 40, 149, 150)] == ["short", "mediu", "mediu", "long "]


def test_scores(spark):
    df = spark.createDataFrame([(0.15,), (-0.15,), (0.1499,)], "s double")
    assert [r[0] for r in df.select(S.to_label(F.col("s"))).collect()] == ["positive", "negative", "neutral"]
    flags = spark.createDataFrame([(None, "negative"), (None, None), (True, "positive"), (False, "neutral")], "has_complaint boolean, sentiment string")
    assert [r[0] for r in flags.select(S.is_complaint()).collect()] == [True, False, True, False]
    vec = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in vec.select(S.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]
    assert one(spark, 0, S.rating_score, "int") == 0.0 and one(spark, 5, S.rating_score, "int") == 1.0
