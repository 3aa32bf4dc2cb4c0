"""Rule-based themes of complaints: one scan, all patterns into an array, then one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.functions.fixed import ADVICE, THEMES
from voxmill.functions.scores import is_complaint, percent, rounded
from voxmill.functions.text import shorten, text_or_title


def matched(themes=THEMES, title: str = "title", text: str = "text") -> Column:
    """The numbers of the themes that a review's title and text match."""
    joined = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(text), F.lit("")))
    hits = F.array(*(F.when(joined.rlike("(?i)" + pattern), F.lit(i)) for i, (_, pattern) in enumerate(themes)))
    return F.array_compact(hits)


def _hits(df: DataFrame, themes) -> DataFrame:
    return df.filter(is_complaint()).withColumn("theme_ord", F.explode(matched(themes)))


def _named(themes) -> Column:
    return F.element_at(F.array(*(F.lit(name) for name, _ in themes)), F.col("theme_ord") + 1)


def theme_hits(df: DataFrame, themes=THEMES) -> DataFrame:
    """theme, negative_reviews, share_of_negative, avg_rating; themes without hits are left out."""
    size = df.agg(F.count_if(is_complaint()).alias("size"))
    stats = _hits(df, themes).groupBy("theme_ord").agg(F.count("*").alias("n"), rounded(F.avg("rating")).alias("avg_rating"))
    return stats.crossJoin(F.broadcast(size)).select("theme_ord", _named(themes).alias("theme"), F.col("n").alias("negative_reviews"), percent(F.col("n"), F.col("size")).alias("share_of_negative"), "avg_rating")


def theme_quotes(df: DataFrame, max_quotes: int = 2, themes=THEMES) -> DataFrame:
    """theme, quote_rank, id, quote: the longest texts of each theme, ties by arrival. The rank limit runs before the shuffle."""
    w = Window.partitionBy("theme_ord").orderBy(F.length(F.coalesce("text", F.lit(""))).desc(), "ord")
    ranked = _hits(df, themes).withColumn("quote_rank", F.row_number().over(w)).filter(F.col("quote_rank") <= max_quotes)
    return ranked.select("theme_ord", _named(themes).alias("theme"), "quote_rank", "id", shorten(text_or_title(F.col("text"), F.col("title"))).alias("quote"))


def theme_analysis(df: DataFrame, max_quotes: int = 2, themes=THEMES, advice=ADVICE) -> DataFrame:
    """theme, negative_reviews, share_of_negative, avg_rating, recommendation, sample_quotes; most frequent first, ties as declared."""
    quotes = theme_quotes(df, max_quotes, themes).groupBy("theme_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("quote_rank", "quote"))), lambda x: x["quote"]).alias("sample_quotes"))
    recommendation = F.element_at(F.array(*(F.lit(advice.get(name, "")) for name, _ in themes)), F.col("theme_ord") + 1)
    out = theme_hits(df, themes).join(quotes, "theme_ord").withColumn("recommendation", recommendation)
    return out.orderBy(F.desc("negative_reviews"), "theme_ord").select("theme", "negative_reviews", "share_of_negative", "avg_rating", "recommendation", "sample_quotes")
