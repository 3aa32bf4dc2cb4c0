"""The full insight of a batch of prepared reviews, from deterministic operators with optional upgrades."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.operators import keywords, metrics, themes
from voxmill.operators.providers import ProviderError


def actions_and_summary(rating: dict, sentiment: dict, found: list[dict], corpus: int) -> tuple[list[str], str]:
    """Advice for the five largest themes, and one paragraph."""
    share = sentiment["percentages"]
    actions = [f"{t['theme']} ({t['negative_reviews']}/{corpus} complaints, {t['share_of_negative']}%): {t['recommendation']}" for t in found[:5]]
    if rating["average_rating"] >= 4.5 and share["negative"] < 15:
        actions.append("Most users are content: ask them for a rating when something has just gone well.")
    moods = ", ".join(f"{c} {share[c]}%" for c in share)
    worst = f"Most complaints are about: {found[0]['theme']}." if found else "No theme stands out."
    return actions, f"Over {rating['total_reviews']} reviews the mean rating is {rating['average_rating']} of 5; {moods}; {corpus} complain about something. {worst}"


def build(prepared: DataFrame) -> dict:
    """summary, metrics, sentiment, negative_keywords, themes, actionable_insights and their sources.

    prepared: ord, id, title, text, rating, sentiment, has_complaint. Only
    aggregates reach the driver.
    """
    rating = metrics.rating_metrics(prepared).first().asDict() | metrics.text_metrics(prepared).first().asDict()
    rating["rating_distribution"] = {r["stars"]: {"count": r["count"], "percentage": r["percentage"]} for r in metrics.rating_distribution(prepared).collect()}
    rows = metrics.sentiment_breakdown(prepared).collect()
    sentiment = {"counts": {r["sentiment"]: r["count"] for r in rows}, "percentages": {r["sentiment"]: r["percentage"] for r in rows}}
    terms = [r.asDict() for r in keywords.negative_keywords(prepared).orderBy("rank").drop("rank").collect()]
    found = [r.asDict() for r in themes.theme_analysis(prepared).collect()]
    corpus = metrics.corpus_size(prepared).first()["complaints"]
    actions, summary = actions_and_summary(rating, sentiment, found, corpus)
    return {"summary": summary, "metrics": rating, "sentiment": sentiment, "negative_keywords": terms, "themes": found, "actionable_insights": actions, "complaints": corpus, "themes_source": "regex", "keywords_source": "statistical"}


def upgrade(insights: dict, keyword_provider: Callable[[], list[dict]] | None = None, theme_provider: Callable[[], list[dict]] | None = None) -> dict:
    """insights with keywords and themes of providers, each by itself; one that fails or gives nothing leaves the value as it was."""
    out = dict(insights)
    for provider, key, source, need in ((keyword_provider, "negative_keywords", "keywords_source", {"term", "count"}), (theme_provider, "themes", "themes_source", {"theme", "negative_reviews", "share_of_negative", "recommendation"})):
        if provider is None:
            continue
        try:
            got = provider()
            if not isinstance(got, list) or not all(isinstance(x, dict) and need <= set(x) for x in got):
                raise ProviderError(f"{key}: unexpected shape")
        except Exception:  # an outage must not break the caller
            continue
        if got:
            out[key], out[source] = got, "model"
    out["actionable_insights"], out["summary"] = actions_and_summary(out["metrics"], out["sentiment"], out["themes"], out["complaints"])
    return out


def complaints(prepared: DataFrame) -> DataFrame:
    from voxmill.functions.scores import is_complaint

    return prepared.filter(is_complaint()).orderBy(F.col("ord"))
