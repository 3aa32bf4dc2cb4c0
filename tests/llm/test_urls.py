import pytest

from voxmill.llm import urls


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("http://a.Example.COM/en/5", "a.example.com", "/en/5", "com/en/", "block"), ("http://a.example.com/en/71?x", "a.example.com", "/en/71", "example.com/en/7", "allow"),
    ("https://net/de/x", "net", "/de/x", "net/de/", "allow"), ("https://m.example.net/de/8#a", "m.example.net", "/de/8", "example.net/de/8", "block"), ("https://x.planet/de/1", "x.planet", "/de/1", None, "allow"),
    ("https://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"), (None, "", "", None, "allow"), ("no scheme casino", "", "", None, "block"), ("", "", "", None, "allow"), ("x://h?a://b/c", "h", "", None, "allow"),
    ("http://a.org/free-bets", "a.org", "/free-bets", None, "block"), ("http://a.org/free-now-best", "a.org", "/free-now-best", None, "allow"), ("http://a.org/free-now-best-buy", "a.org", "/free-now-best-buy", None, "block"), ("http://a.org/poker", "a.org", "/poker", None, "allow"), ("http://a.org/poker_poker", "a.org", "/poker_poker", None, "allow"), ("http://a.org/free-free", "a.org", "/free-free", None, "allow"), ("http://a.org/casinos", "a.org", "/casinos", None, "allow"), ("http://h\n/p\nq?", "h\n", "/p\nq", None, "allow"),
])
def test_judge(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "z"), (None, url, "z")], "page_id long, url string, rule string")
    for r in urls.judge(df).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert urls.Vocabulary((), {})("x") == ([], [], 0.0, False)


def test_long_and_repeated(spark):
    long = "http://h.org/" + "a-free-" * 300_000 + "win-deal"
    df = spark.createDataFrame([(1, long), (1, long), (2, "http://h.org/x"), (2, "http://h.org/x")], "page_id long, url string")
    rows = urls.judge(df).collect()
    assert sorted((r["page_id"], r["verdict"], tuple(r["soft_hits"]), r["soft_weight"]) for r in rows) == [(1, "block", ("deal", "free", "win"), 2.5)] * 2 + [(2, "allow", (), 0.0)] * 2


def test_equal_rules(spark):
    """Of two rules of one name the earlier wins."""
    df = spark.createDataFrame([(1, "http://a.b/c/d")], "page_id long, url string")
    rules = (urls.Rule("block", "b", "/c"), urls.Rule("allow", "b", "/c"))
    assert [urls.judge(df, rules=x).first()["verdict"] for x in (rules, rules[::-1])] == ["block", "allow"]
