"""Terms that tell complaints from the rest: log-odds with an informative prior.

A document's terms are counted within its row, so the one shuffle is by term,
combined before it; totals come from the counts and are one row, broadcast.
Nothing is gathered per term, and the top k is taken before the final sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.functions.fixed import STOPWORDS
from voxmill.functions.scores import is_complaint, percent, rounded
from voxmill.functions.text import bigrams, let, stem, tokenize
from voxmill.operators.resampling import leaders
from voxmill.session import checkpointed

SIGNIFICANT = 1.96


def terms_column(title: str = "title", text: str = "text", stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Stems, then bigrams of stems, of title and text."""
    joined = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(text), F.lit("")))
    return F.transform(tokenize(joined, stopwords), lambda w: stem(w, lowered=True))


def document_terms(df: DataFrame, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """ord, complaint, term, n, pos: how often a document has a term, and where first.

    Terms are sorted with their places within a row; where a run of equal
    terms begins and how long it is gives pos and n, without a shuffle.
    """
    stems = df.select("ord", is_complaint().alias("complaint"), F.explode(F.array(terms_column(stopwords=stopwords))).alias("_s"))  # one row a row; what follows cannot be merged with it and repeat it
    both = stems.select("ord", "complaint", F.explode(F.array(F.concat("_s", bigrams(F.col("_s"))))).alias("_t"))

    def runs(t: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (t[i]["t"] != F.get(t, i - 1)["t"]))
        return let(begins, lambda b: F.transform(b, lambda i, k: F.struct(t[i]["t"].alias("term"), (F.coalesce(F.get(b, k + 1), F.size(t)) - i).cast("long").alias("n"), t[i]["i"].alias("pos"))))

    placed = F.sort_array(F.transform("_t", lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
    return both.filter(F.size("_t") > 0).select("ord", "complaint", F.inline(let(placed, runs)))


def _z() -> Column:
    """Difference of log-odds over its standard deviation; null where a denominator is 0."""
    y, r = F.col("y").cast("double"), F.col("r").cast("double")
    a, nt, nr = y + r, F.col("n_target").cast("double"), F.col("n_rest").cast("double")
    a0 = nt + nr
    odds = lambda k, n: F.ln(F.try_divide(k + a, n + a0 - k - a))
    return (odds(y, nt) - odds(r, nr)) / F.sqrt(1.0 / (y + a) + 1.0 / (r + a))


def log_odds(terms: DataFrame, min_count: int = 3, by: tuple[str, ...] = (), times: Column | None = None) -> DataFrame:
    """by..., term, count, z (unrounded), docs, first; terms with count >= min_count. times: how often a document counts.

    first orders terms by document and place: ord * 2^31 + place as a decimal, so any long and any place fit and the aggregate stays hash-based.
    """
    t = F.lit(1) if times is None else times
    hit = F.col("complaint")
    place = F.col("ord").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("pos")
    counts = terms.groupBy(*by, "term").agg(
        F.sum(F.when(hit, F.col("n") * t).otherwise(0)).alias("y"),
        F.sum(F.when(hit, 0).otherwise(F.col("n") * t)).alias("r"),
        F.sum(F.when(hit, t).otherwise(0)).alias("docs"),
        F.min(F.when(hit, place.cast("decimal(38,0)"))).alias("first"),
    )
    totals = counts.groupBy(*by).agg(F.sum("y").alias("n_target"), F.sum("r").alias("n_rest"))  # from the same shuffle
    frequent = counts.filter(F.col("y") >= min_count)
    joined = frequent.join(F.broadcast(totals), list(by)) if by else frequent.crossJoin(F.broadcast(totals))  # one row per group of `by`
    return joined.select(*by, "term", F.col("y").alias("count"), _z().alias("z"), "docs", "first")


def negative_keywords(df: DataFrame, top_n: int = 15, min_count: int = 3, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """term, count, z_score, significant, share_of_corpus of the top terms, with rank (from 1); needs ord, title, text, has_complaint, sentiment.

    Sorted by the rounded score, ties by first appearance. No complaints: empty.
    """
    found = log_odds(document_terms(df, stopwords), min_count).filter(F.col("z").isNotNull())
    size = df.agg(F.count_if(is_complaint()).alias("size"))
    scored = found.crossJoin(F.broadcast(size)).select("term", "count", rounded(F.col("z")).alias("z_score"), (F.abs("z") >= SIGNIFICANT).alias("significant"), percent(F.col("docs"), F.col("size")).alias("share_of_corpus"), "first")
    top = scored.orderBy(F.desc("z_score"), "first", "term").limit(top_n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("z_score"), "first", "term"))).drop("first")  # top_n rows


def document_frequency(df: DataFrame, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """term, docs, mentions over complaints."""
    return document_terms(df.filter(is_complaint()), stopwords).groupBy("term").agg(F.count("*").alias("docs"), F.sum("n").alias("mentions"))


def bootstrap_stability(df: DataFrame, draws: DataFrame, top_n: int = 10, min_count: int = 3, reps: int = 200, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """term, rank, survived (resamples whose top_n still has it), percent.

    draws: rep (from 0, below reps), ord, times. All resamples and df itself
    are counted together, see resampling.
    """
    found = checkpointed(leaders(df, draws, _z(), top_n, min_count, reps, stopwords))
    today = found.filter(F.col("rep") == reps).select("term", "rank")
    hits = found.filter(F.col("rep") < reps).groupBy("term").agg(F.count("*").alias("survived"))
    return today.join(hits, "term", "left").select("term", "rank", F.coalesce("survived", F.lit(0)).alias("survived"), percent(F.coalesce("survived", F.lit(0)), F.lit(reps)).alias("percent"))
