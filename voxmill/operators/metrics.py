"""Rating, sentiment and length metrics: each one aggregation, partial before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.fixed import SENTIMENTS
from voxmill.functions.scores import is_complaint, percent, rounded


def median_upper(rating: str) -> Column:
    """The upper of the two middle values; 0 when empty."""
    return F.coalesce(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {rating} DESC)"), F.lit(0))


def rating_metrics(df: DataFrame, rating: str = "rating") -> DataFrame:
    """One row: total_reviews, average_rating, median_rating, share_4_5, share_1_2."""
    r, total = F.col(rating), F.count("*")
    return df.agg(
        total.alias("total_reviews"),
        F.coalesce(rounded(F.avg(r)), F.lit(0.0)).alias("average_rating"),
        median_upper(rating).cast("int").alias("median_rating"),
        percent(F.count_if(r >= 4), total).alias("share_4_5"),
        percent(F.count_if(r <= 2), total).alias("share_1_2"),
    )


def rating_distribution(df: DataFrame, rating: str = "rating") -> DataFrame:
    """Stars 5 to 1, always all five, with count and percentage."""
    r = F.col(rating)
    one = df.agg(F.count("*").alias("total"), *(F.count_if(r == s).alias(f"s{s}") for s in range(1, 6)))
    stars = F.explode(F.array(*(F.struct(F.lit(s).alias("stars"), F.col(f"s{s}").alias("n")) for s in range(5, 0, -1))))
    return one.select("total", stars.alias("x")).select("x.stars", F.col("x.n").alias("count"), percent(F.col("x.n"), F.col("total")).alias("percentage"))


def sentiment_breakdown(df: DataFrame, sentiment: str = "sentiment") -> DataFrame:
    """The three classes, always all, with count and percentage."""
    s = F.col(sentiment)
    one = df.agg(F.count("*").alias("total"), *(F.count_if(s == c).alias(c) for c in SENTIMENTS))
    classes = F.explode(F.array(*(F.struct(F.lit(c).alias("sentiment"), F.col(c).alias("n")) for c in SENTIMENTS)))
    return one.select("total", classes.alias("x")).select("x.sentiment", F.col("x.n").alias("count"), percent(F.col("x.n"), F.col("total")).alias("percentage"))


def text_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: reviews_with_text, average_length (characters)."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    return df.agg(F.count_if(n > 0).alias("reviews_with_text"), F.coalesce(rounded(F.avg(n), 1), F.lit(0.0)).alias("average_length"))


def corpus_size(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(is_complaint()).alias("complaints"))


def collections(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("reviews"))
