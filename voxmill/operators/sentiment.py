"""Sentiment: a lexicon scorer behind a small interface, the blend with stars, and scorers called in batches."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.functions.scores import blend, rating_score, to_label
from voxmill.functions.text import clean_text, headline
from voxmill.operators.providers import call
from voxmill.session import ship

#: Our own valence lexicon, -4 to 4.
LEXICON = {w: float(v) for v, words in {
    3: "amazing awesome excellent love loved loves perfect perfectly best fantastic wonderful brilliant outstanding superb phenomenal flawless incredible exceptional delightful",
    2: "good great happy helpful like liked likes nice recommend recommended easy beautiful enjoy enjoyed enjoying fun useful reliable fast smooth smoothly thanks glad intuitive accurate insightful impressive impressed pleased satisfied friendly comfortable relaxing motivating valuable trustworthy responsive",
    1: "fine ok okay decent works working clear better improved simple stable interesting solid fair affordable handy convenient",
    -1: "slow slower confusing confused expensive lacks lacking missing annoying hard difficult problem problems issue issues disappointing disappointed boring limited outdated clunky laggy repetitive vague generic pricey unclear unnecessary complicated",
    -2: "bad poor poorly crash crashes crashed crashing bug bugs bugged buggy broken wrong error errors fail fails failed failing frustrating frustrated refund stuck spam spammy misleading unfair unusable unreliable inaccurate glitch glitches freezes frozen overpriced greedy unhelpful unresponsive angry upset deceptive ignored overcharged shady rude sad worse",
    -3: "terrible terribly horrible horribly awful worst hate hated hates useless scam scammed scammers garbage worthless disgusting disgusted fraud fraudulent trash rubbish waste wasted pathetic predatory stole stolen theft appalling atrocious",
}.items() for w in words.split()}
NEGATIONS = frozenset("not no never none nobody cannot cant can't dont don't doesnt doesn't didnt didn't isnt isn't wasnt wasn't wont won't without hardly".split())
BOOSTERS = {"very": 0.3, "really": 0.3, "so": 0.3, "extremely": 0.3, "totally": 0.3, "absolutely": 0.3, "too": 0.2, "slightly": -0.3, "somewhat": -0.3, "kinda": -0.3}
_WORD = re.compile(r"[\w'’-]+")


def polarity(text: str) -> tuple[float, float]:
    """(compound in -1..1, share of negative weight in 0..1) by the published rules: boosters, negation within three words, a shift at "but", capitals and exclamation marks."""
    words = _WORD.findall(text)
    shouting = any(w.isupper() and len(w) > 1 for w in words) and not all(w.isupper() for w in words)
    low = [w.lower() for w in words]
    scores = []
    for i, w in enumerate(low):
        v = LEXICON.get(w, 0.0)
        if v:
            if shouting and words[i].isupper():
                v += math.copysign(0.733, v)
            for back in range(1, 4):
                if i >= back and low[i - back] in BOOSTERS:
                    v += math.copysign(BOOSTERS[low[i - back]] * (1, 0.95, 0.9)[back - 1], v) if BOOSTERS[low[i - back]] > 0 else -math.copysign(0.3, v)
            if any(x in NEGATIONS for x in low[max(0, i - 3) : i]):
                v *= -0.74
        scores.append(v)
    if "but" in low:
        at = low.index("but")
        scores = [s * (0.5 if i < at else 1.5 if i > at else 1) for i, s in enumerate(scores)]
    total = sum(scores)
    marks = min(text.count("!"), 4) * 0.292
    total += math.copysign(marks, total) if total else 0
    positive, negative = sum(s + 1 for s in scores if s > 0), -sum(s - 1 for s in scores if s < 0)
    whole = positive + negative + sum(1 for s in scores if not s)
    return total / math.sqrt(total * total + 15), (negative / whole if whole else 0.0)


def _scorer() -> Callable[[str], tuple[float, float]]:
    """The rules' reference package where it is installed; else ours."""
    try:
        from vaderSentiment.vaderSentiment import SentimentIntensityAnalyzer
    except ImportError:
        return polarity
    analyzer = SentimentIntensityAnalyzer()
    return lambda t: ((s := analyzer.polarity_scores(t))["compound"], s["neg"])


def with_polarity(df: DataFrame, text: str) -> DataFrame:
    """df with compound and neg of a text column, by Arrow batches; the scorer is made once per worker."""
    ship(df.sparkSession)

    @F.pandas_udf("compound double, neg double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = _scorer()
        for s in parts:
            yield pd.DataFrame([own(t or "") for t in s], columns=["compound", "neg"])

    return df.withColumn("_p", score(F.col(text))).withColumns({"compound": F.col("_p.compound"), "neg": F.col("_p.neg")}).drop("_p")


def classify(df: DataFrame, text: str, rating: str = "rating", compound: str = "compound", neg: str = "neg") -> DataFrame:
    """df with sentiment, sentiment_score (4 digits) and has_complaint, given compound and neg.

    Below three characters the stars alone count, unweighted. A missing rating
    scores 0 and counts as a complaint, as any rating of 2 or less.
    """
    r = F.coalesce(F.col(rating), F.lit(0))
    short = F.length(F.coalesce(F.col(text), F.lit(""))) < 3
    raw = F.when(short, rating_score(r)).otherwise(blend(F.col(compound), r))
    label = to_label(raw)
    complaint = (label == "negative") | (r <= 2) | (F.when(short, F.lit(0.0)).otherwise(F.col(neg)) >= 0.12)
    return df.withColumns({"sentiment": label, "sentiment_score": F.bround(raw, 4), "has_complaint": complaint})


def prepare(df: DataFrame, full_unescape: bool = True) -> DataFrame:
    """Reviews with clean title and text, sentiment, sentiment_score, has_complaint and sentiment_source."""
    clean = df.withColumns({"title": clean_text(F.col("title"), full_unescape), "text": clean_text(F.col("text"), full_unescape), "rating": F.coalesce("rating", F.lit(0))})
    scored = with_polarity(clean.withColumn("_h", headline(F.col("title"), F.col("text"))), "_h")
    return classify(scored, "_h").withColumn("sentiment_source", F.lit("lexicon")).drop("_h", "compound", "neg")


def score_in_batches(df: DataFrame, provider: Callable[[list[dict]], list[dict]], size: int = 15, retries: int = 3) -> DataFrame:
    """id, score, has_complaint, error from a provider called with lists of {id, title, text}.

    A failed call is tried again with growing waits. A batch whose call fails, or whose answer has another shape, gives rows
    with an error instead of scores; overlay() then leaves those reviews alone.
    """
    ship(df.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = part.to_dict("records")
            out = []
            for at in range(0, len(rows), size):
                batch = rows[at : at + size]
                try:
                    got = {str(r["id"]): (float(r["score"]), bool(r.get("has_complaint", False))) for r in call(provider, batch, retries=retries)}
                    out += [(r["id"], *got[str(r["id"])], None) if str(r["id"]) in got else (r["id"], None, None, "missing from response") for r in batch]
                except Exception as e:  # any failure of a provider is the batch's failure, not the job's
                    out += [(r["id"], None, None, f"{type(e).__name__}: {e}"[:200]) for r in batch]
            yield pd.DataFrame(out, columns=["id", "score", "has_complaint", "error"]).astype({"score": "float64", "has_complaint": "boolean"})

    return df.select("id", "title", "text").mapInPandas(run, "id string, score double, has_complaint boolean, error string")
