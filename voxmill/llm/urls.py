"""URL filter: host rules, then a weighted vocabulary found by Aho-Corasick.

Strict terms reject on one hit. Soft terms have weights: several different
ones reject together, when their weights reach a limit. A hit counts only between boundaries: neither neighbour may be an
ASCII letter or digit. Host rules override the vocabulary; the longest rule wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices

#: Our own default vocabulary; pass others as parameters. A soft term weighs by how much it says on its own.
STRICT = tuple("""porn pornhub xxx hentai camgirls casino slots roulette sportsbook viagra cialis tramadol steroids warez keygen
    cracked torrent escort escorts malware phishing ransomware botnet carding counterfeit payday moneymule darkweb stalkerware spyware""".split())
SOFT = {w: weight for weight, words in {
    1.5: "adult sex nude dating poker betting bet bets jackpot gambling pills pharma loan loans forex crack hack hacked pirate",
    1.0: "ads ad win winner prize lottery bonus crypto cheap replica discount promo coupon deal deals offer affiliate referral tracker track popup click clicks clickbait weightloss diet singles chat webcam stream",
    0.5: "free best buy sale cash earn rich fast now online download gift vip top hot real secret instant",
}.items() for w in words.split()}
SOFT_HITS, SOFT_WEIGHT = 2, 2.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule whose host is the URL's or a parent domain of it and whose path begins the URL's, as struct(name, verdict); else null. Ties go to the earlier rule."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):  # the last that fits wins
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _alnum(c: str) -> bool:
    return c.isascii() and c.isalnum()


class Vocabulary:
    """Both term lists in one automaton."""

    def __init__(self, strict: tuple[str, ...], soft: Mapping[str, float], soft_hits: int = SOFT_HITS, soft_weight: float = SOFT_WEIGHT):
        import ahocorasick

        self.need, self.limit, self.automaton = soft_hits, soft_weight, ahocorasick.Automaton()
        self.weights = {term.lower(): w for term, w in soft.items()}
        for kind, terms in ((False, soft), (True, strict)):
            for term in terms:
                self.automaton.add_word(term.lower(), (kind, term.lower()))
        self.empty = not (strict or soft)
        if not self.empty:
            self.automaton.make_automaton()

    def __call__(self, url: str | None) -> tuple[list[str], list[str], float, bool]:
        """Distinct strict and soft terms found, the weight of the soft ones, and whether the URL is rejected."""
        text, strict, soft = (url or "").lower(), set(), set()
        if text and not self.empty:
            for end, (kind, term) in self.automaton.iter(text):
                start = end - len(term)
                if (start < 0 or not _alnum(text[start])) and (end + 1 == len(text) or not _alnum(text[end + 1])):
                    (strict if kind else soft).add(term)
        weight = math.fsum(self.weights[t] for t in soft)
        return sorted(strict), sorted(soft), weight, bool(strict) or (len(soft) >= self.need and weight >= self.limit)


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, strict: tuple[str, ...] = STRICT, soft: Mapping[str, float] = SOFT, soft_hits: int = SOFT_HITS, soft_weight: float = SOFT_WEIGHT) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict (allow or block), strict_hits, soft_hits, soft_weight.

    A null URL, or one without ://, has empty host and path and no rule; a null
    or empty one is allowed. Repeated rows are kept, other columns not read.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Vocabulary(strict, soft, soft_hits, soft_weight)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            found = [find(u) for u in batch.column(1).to_pylist()]
            columns = [pa.array([x[0] for x in found], pa.list_(pa.string())), pa.array([x[1] for x in found], pa.list_(pa.string())), pa.array([x[2] for x in found], pa.float64()), pa.array([x[3] for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "url", "strict_hits", "soft_hits", "soft_weight", "rejected"])

    hits = df.select(df[id_col].alias("id"), df[url_col].cast("string").alias("url")).mapInArrow(run, f"id {kind}, url string, strict_hits array<string>, soft_hits array<string>, soft_weight double, rejected boolean")
    parts = hits.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = parts.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("rejected"), "block").otherwise("allow"))
    return ruled.select(F.col("id").alias(id_col), "host", "path", F.col("r.name").alias("rule"), verdict.alias("verdict"), "strict_hits", "soft_hits", "soft_weight")
