"""Text functions as Column expressions; all but full unescaping stay in the JVM."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .fixed import STOPWORDS


@F.pandas_udf(StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    """All HTML entities, by Arrow batches."""
    return s.map(html.unescape, na_action="ignore")


def unescape_common(c: Column) -> Column:
    """The usual entities without leaving the JVM; &amp; last, so nothing is unescaped twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def clean_text(c: Column, full: bool = True) -> Column:
    """Unescape, drop tags and links, straighten single quotes, collapse white space. Null gives an empty text.

    full: unescape all entities (an Arrow function) instead of the usual ones.
    White space includes the separators U+001C to U+001F.
    """
    c = F.coalesce(c, F.lit(""))
    c = unescape_html(c) if full else unescape_common(c)
    c = F.regexp_replace(c, "<[^>]+>", " ")
    c = F.regexp_replace(c, r"(?U)https?://\S+|www\.\S+", " ")
    c = F.translate(c, "’‘", "''")
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def raw_tokens(c: Column) -> Column:
    """Runs of a-z with inner quotes and hyphens, of two characters or more, lower-cased, quotes dropped."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z][a-z'\-]+)"), 1)
    return F.transform(found, lambda t: F.replace(t, F.lit("'"), F.lit("")))


def tokenize(c: Column, stopwords: tuple[str, ...] = STOPWORDS, min_length: int = 3) -> Column:
    """raw_tokens without stop words and short ones."""
    return F.filter(raw_tokens(c), lambda t: (F.length(t) >= min_length) & ~t.isin(*stopwords))  # becomes a hash set


def let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _chop(w: Column, k: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - k)


def _ends(w: Column, *suffixes: str) -> Column:
    out = w.endswith(suffixes[0])
    for s in suffixes[1:]:
        out = out | w.endswith(s)
    return out


def _undouble(base: Column) -> Column:
    """Without the second of two equal consonants at the end."""
    last = F.right(base, F.lit(1))
    return F.when((F.length(base) >= 3) & (last == F.substring(base, -2, 1)) & ~last.isin("a", "e", "i", "o", "u"), _chop(base, 1)).otherwise(base)


def stem(w: Column, lowered: bool = False) -> Column:
    """Common English inflections merged: one suffix rule, then a silent e. lowered: the words are lower-case already."""

    def rules(w: Column) -> Column:
        n = F.length(w)
        cut = (
            F.when(_ends(w, "ing") & (n > 6), let(_chop(w, 3), _undouble))
            .when(_ends(w, "ed") & (n > 5), let(_chop(w, 2), _undouble))
            .when(_ends(w, "ies") & (n > 6), F.concat(_chop(w, 3), F.lit("y")))
            .when((n > 6) & _ends(w, "ches", "shes", "xes", "sses", "zes"), _chop(w, 2))
            .when(_ends(w, "es") & (n > 5), _chop(w, 1))
            .when(_ends(w, "s") & ~_ends(w, "ss", "us", "is"), _chop(w, 1))
            .when(_ends(w, "ly") & (n > 6), _chop(w, 2))
            .otherwise(w)
        )
        silent = lambda c: F.when(c.endswith("e") & (F.length(c) > 4) & ~_ends(c, "ee", "ye", "oe"), _chop(c, 1)).otherwise(c)
        return F.when(n <= 4, w).otherwise(let(cut, silent))

    return rules(w) if lowered else let(F.lower(w), rules)


def bigrams(tokens: Column) -> Column:
    """Neighbours joined by a space; empty for fewer than two."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat_ws(" ", tokens[i - 1], tokens[i]))
    return F.when(F.size(tokens) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def headline(title: Column, text: Column) -> Column:
    """"title. text" without dots and spaces at either end."""
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(text, F.lit("")))
    return F.btrim(joined, F.lit(". "))


def shorten(c: Column, width: int = 280) -> Column:
    """Cut at the last space within the width, and an ellipsis, if longer."""
    head = F.regexp_replace(F.substring(c, 1, width), r"(?s) [^ ]*$", "")
    return F.when(F.length(c) > width, F.concat(head, F.lit("…"))).otherwise(c)


def length_bucket(c: Column) -> Column:
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n < 40, "short (<40 chars)").when(n < 150, "medium (40-150)").otherwise("long (150+)")


def text_or_title(text: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), title)


def cache_key(model: Column, version: Column, review_id: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", version, model, review_id), 256), 1, 24)
