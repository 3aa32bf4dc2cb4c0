"""Which terms lead in resamples of the documents, all resamples at once and exactly.

A resample counts each document a few times, so a term's counts in all
resamples are the sum of its documents' vectors of times: one row of a sparse
matrix by a dense one. They are added up per task, in Python, as no built-in
function adds vectors, and only for terms that can lead at all.

A term that complaints hold y times has its greatest log-odds where the rest
never hold it, and that bound grows with y. A term's y in a resample is at most
the sum of its counts, each times the most that its document is drawn. Terms
are taken by that sum; where the last leader of a resample does not lie above
the bound of the terms left out, those that reach it are counted as well.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmill.functions.fixed import STOPWORDS
from voxmill.functions.scores import is_complaint, rounded
from voxmill.session import checkpointed, ship

#: Terms counted at first, terms whose vectors a task holds or adds up, and what a z worked out here may differ by from a rounded one.
FIRST, HELD, SLICE, NEAR = 10_000, 50_000, 4_000, 0.02
_WORD = re.compile(r"[a-z][a-z'\-]+")


def stem(w: str) -> str:
    """functions.text.stem of a lower-case word."""
    n = len(w)
    if n <= 4:
        return w

    def undouble(b: str) -> str:
        return b[:-1] if len(b) >= 3 and b[-1] == b[-2] and b[-1] not in "aeiou" else b

    if w.endswith("ing") and n > 6:
        w = undouble(w[:-3])
    elif w.endswith("ed") and n > 5:
        w = undouble(w[:-2])
    elif w.endswith("ies") and n > 6:
        w = w[:-3] + "y"
    elif n > 6 and w.endswith(("ches", "shes", "xes", "sses", "zes")):
        w = w[:-2]
    elif w.endswith("es") and n > 5:
        w = w[:-1]
    elif w.endswith("s") and not w.endswith(("ss", "us", "is")):
        w = w[:-1]
    elif w.endswith("ly") and n > 6:
        w = w[:-2]
    return w[:-1] if w.endswith("e") and len(w) > 4 and not w.endswith(("ee", "ye", "oe")) else w


def stemmer(stopwords: tuple[str, ...] = STOPWORDS) -> Callable[[str], list[str]]:
    """keywords.terms_column without its bigrams, of a lower-case text; a word's stem is worked out once."""
    stop, known = frozenset(stopwords), {}

    def stems(text: str) -> list[str]:
        found = _WORD.findall(text)
        for w in set(found):
            if w not in known:
                if len(known) > 1 << 20:
                    known.clear()
                for x in set(found):
                    plain = x.replace("'", "")
                    known[x] = stem(plain) if len(plain) > 2 and plain not in stop else None
        return [s for s in map(known.__getitem__, found) if s is not None]

    return stems


def _terms(s: list[str]) -> list[str]:
    return [*s, *map(" ".join, zip(s, s[1:], strict=False))]


def _weights(draws: DataFrame, reps: int) -> DataFrame:
    """ord, w: the times a row is drawn in each resample, one after the other; the first byte is their width."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.column(1)
            each = d.flatten()
            row = np.repeat(np.arange(len(d)), np.diff(d.offsets.to_numpy()))
            w = np.zeros((len(d), reps), np.int64)
            np.add.at(w, (row, each.field(0).to_numpy()), each.field(1).to_numpy())
            packed = [(b"\1" + x.astype("<u1").tobytes()) if x.max(initial=0) < 256 else (b"\4" + x.astype("<u4").tobytes()) for x in w]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["ord", "w"])

    own = draws.filter(F.col("rep").between(0, reps - 1)).select("ord", F.col("rep").cast("int").alias("rep"), F.col("times").cast("long").alias("times"))
    return own.groupBy("ord").agg(F.collect_list(F.struct("rep", "times")).alias("d")).mapInArrow(pack, "ord long, w binary")


def _times(w: bytes | None, reps: int) -> np.ndarray:
    """A row's times in each resample, and 1 for the rows as they are."""
    out = np.ones(reps + 1, np.int32)
    out[:reps] = 0 if w is None else np.frombuffer(w, f"<u{w[0]}", offset=1)
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def z_scores(y, r, nt, nr) -> np.ndarray:
    """keywords._z; not finite where that is null."""
    a, a0 = y + r, nt + nr
    with np.errstate(all="ignore"):
        return (np.log((y + a) / (nt + a0 - y - a)) - np.log((r + a) / (nr + a0 - r - a))) / np.sqrt(1 / (y + a) + 1 / (r + a))


def bound(u: int, nt: np.ndarray, nr: np.ndarray, min_count: int) -> np.ndarray:
    """The most that z can be in each resample for a term that complaints hold at most u times there; minus infinity if it cannot have min_count."""
    y = np.minimum(float(u), nt)
    z = z_scores(y, 0.0, nt, nr)
    return np.where(y < min_count, -np.inf, np.maximum(0.0, np.where(np.isnan(z), np.inf, z)))


def _reach(base: DataFrame, reps: int, stopwords: tuple[str, ...]) -> DataFrame:
    """term, u: the most that complaints can hold a term in any resample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems, u = stemmer(stopwords), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u.keys(), pa.string()), pa.array(u.values(), pa.int64())], ["term", "u"])

        for text, w in _rows(batches):
            most = int(_times(w, reps).max())
            for t, n in Counter(_terms(stems(text))).items():
                u[t] += n * most
            if len(u) > 4 * HELD:
                yield out()
                u.clear()
        yield out()

    return base.filter("complaint").select("text", "w").mapInArrow(count, "term string, u long").groupBy("term").agg(F.sum("u").alias("u"))


def _counted(base: DataFrame, wanted: list[str], reps: int, stopwords: tuple[str, ...]) -> DataFrame:
    """term, y, r: vectors of int32 with the counts of wanted terms in complaints and the rest, per resample and for the rows as they are; parts to be added. Term null, int64: those of all terms."""
    spark = base.sparkSession
    sent = spark.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems, known, at = stemmer(stopwords), {t: t for t in sent.value}, {}
        held, total, most = np.zeros((2, 1024, reps + 1), np.int32), np.zeros((2, reps + 1), np.int64), 0

        def out(names: list, y: np.ndarray, r: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(names), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(names[k : k + 2000], pa.string()), *(pa.array([row.tobytes() for row in x[k : k + 2000]], pa.binary()) for x in (y, r))], ["term", "y", "r"])

        for hit, text, w in _rows(batches):
            terms, times = _terms(stems(text)), _times(w, reps)
            side, most = 0 if hit else 1, most + len(terms) * int(times.max())
            total[side] += len(terms) * times.astype(np.int64)
            if most >= 1 << 31 or len(at) > HELD:
                yield from out(list(at), *held[:, : len(at)])
                at.clear()
                held[:] = 0
                most = len(terms) * int(times.max())
            n = Counter(map(known.get, terms))
            n.pop(None, None)
            if n:
                rows = np.fromiter((at.setdefault(t, len(at)) for t in n), np.int64, len(n))
                if len(at) > held.shape[1]:
                    held = np.concatenate((held, np.zeros((2, max(held.shape[1], len(at) - held.shape[1]), reps + 1), np.int32)), axis=1)
                held[side][rows] += np.fromiter(n.values(), np.int32, len(n))[:, None] * times  # a document's terms are distinct
        yield from out(list(at), *held[:, : len(at)])
        yield from out([None], total[:1], total[1:])

    tasks = 2 * spark.sparkContext.defaultParallelism  # each sends a term's vectors once
    return checkpointed(base.select("complaint", "text", "w").coalesce(tasks).mapInArrow(count, "term string, y binary, r binary"))


def _best(parts: DataFrame, slices: int, nt: np.ndarray, nr: np.ndarray, reps: int, top_n: int, min_count: int) -> DataFrame:
    """term, rep, y, r of all terms that may be among the top_n of a resample; rep reps: the rows as they are."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = {}, np.zeros((2, 256, reps + 1), np.int64)
        for t, *both in _rows(batches):
            k = at.setdefault(t, len(at))
            if k >= sums.shape[1]:
                sums = np.concatenate((sums, np.zeros_like(sums)), axis=1)
            for x, v in zip(sums, both, strict=True):
                x[k] += np.frombuffer(v, np.int32)
        names, (y, r), out = pa.array(list(at), pa.string()), sums[:, : len(at)], []
        for k in range(reps + 1):
            z = z_scores(y[:, k].astype(float), r[:, k].astype(float), nt[k], nr[k])
            z[~np.isfinite(z) | (y[:, k] < min_count)] = -np.inf
            some = np.flatnonzero(z > -np.inf)
            if len(some) > top_n:
                some = some[z[some] >= np.partition(z[some], -top_n)[-top_n] - NEAR]
            out.append((some, np.full(len(some), k, np.int32), y[some, k], r[some, k]))
        some, *numbers = map(np.concatenate, zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), *map(pa.array, numbers)], ["term", "rep", "y", "r"])

    return parts.filter("term IS NOT NULL").repartition(slices, "term").mapInArrow(best, "term string, rep int, y long, r long")


def _places(base: DataFrame, wanted: list[str], reps: int, stopwords: tuple[str, ...]) -> DataFrame:
    """term, rep, first: document and place where a term appears first among a resample's complaints."""
    sent = base.sparkSession.sparkContext.broadcast(wanted)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems, known, first = stemmer(stopwords), {t: t for t in sent.value}, {}
        for o, text, w in _rows(batches):
            terms = _terms(stems(text))
            found = {}
            for p, t in enumerate(map(known.get, terms)):
                if t is not None:
                    found.setdefault(t, p)
            drawn = _times(w, reps) > 0 if found else None
            for t, p in found.items():
                old = first.setdefault(t, np.full((2, reps + 1), np.iinfo(np.int64).max))
                old[:, drawn & ((old[0] > o) | ((old[0] == o) & (old[1] > p)))] = [[o], [p]]
        for t, x in first.items():
            k = np.flatnonzero(x[1] < np.iinfo(np.int64).max)
            yield pa.RecordBatch.from_arrays([pa.array([t] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(x[0, k]), pa.array(x[1, k])], ["term", "rep", "o", "p"])

    rows = base.filter("complaint").select("ord", "text", "w").mapInArrow(place, "term string, rep int, o long, p long")
    return rows.groupBy("term", "rep").agg(F.min(F.struct("o", "p")).alias("first"))


def leaders(df: DataFrame, draws: DataFrame, z, top_n: int, min_count: int, reps: int, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """rep, term, rank (from 1): the top_n terms of each resample by rounded z, first appearance and term; rep reps: those of df itself.

    z is a Column over y, r, n_target and n_rest.
    """
    spark = df.sparkSession
    ship(spark)
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
    own = df.select(F.col("ord").cast("long").alias("ord"), is_complaint().alias("complaint"), text.alias("text"))
    base = checkpointed(own.join(_weights(draws, reps), "ord", "left"))
    reach = checkpointed(_reach(base, reps, stopwords).filter(F.col("u") >= min_count))
    top = reach.select("u").orderBy(F.desc("u")).limit(FIRST)
    least = max(min_count, top.agg(F.min("u")).first()[0] or 0)
    rest = reach.filter(F.col("u") < least).agg(F.max("u")).first()[0] or 0  # the most of a term that is left out
    kept, below = None, None
    while True:
        some = reach.filter((F.col("u") >= least) & (F.col("u") < below if below else F.lit(True)))
        wanted = [r["term"] for r in some.select("term").collect()]
        parts = _counted(base, wanted, reps, stopwords)
        if kept is None:
            totals = [np.zeros(reps + 1, np.int64) for _ in range(2)]
            for r in parts.filter("term IS NULL").collect():  # one row a task
                for x, v in zip(totals, (r["y"], r["r"]), strict=True):
                    x += np.frombuffer(v, np.int64)
            nt, nr = (x.astype(float) for x in totals)
            n = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(zip(*totals, strict=True))], "rep int, n_target long, n_rest long")
        found = _best(parts, len(wanted) // SLICE + 1, nt, nr, reps, top_n, min_count)
        scored = found.join(F.broadcast(n), "rep").select("rep", "term", rounded(z).alias("z")).filter("z IS NOT NULL")  # reps + 1 rows
        both = scored if kept is None else kept.unionByName(scored)
        order = Window.partitionBy("rep").orderBy(F.desc("z"))
        kept = checkpointed(both.withColumn("_n", F.rank().over(order)).filter(F.col("_n") <= top_n).drop("_n"))
        if rest < min_count:
            break
        last = {r["rep"]: r["z"] for r in kept.groupBy("rep").agg(F.min("z").alias("z"), F.count("*").alias("n")).filter(F.col("n") >= top_n).collect()}
        at = np.array([last.get(k, -np.inf) for k in range(reps + 1)])
        safe = lambda u: bool(np.all((b := bound(u, nt, nr, min_count) + NEAR) < at, where=b > -np.inf))
        if safe(rest):
            break
        low, high = min_count - 1, rest  # safe below min_count, not at rest
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if safe(mid) else (low, mid)
        below, least, rest = least, high, low if reach.filter(F.col("u") < high).limit(1).count() else 0
    tied = kept.withColumn("_k", F.count("*").over(Window.partitionBy("rep", "z"))).filter("_k > 1").select("term").distinct()
    names = [r["term"] for r in tied.collect()]
    if names:
        kept = kept.join(_places(base, names, reps, stopwords), ["term", "rep"], "left")
    else:
        kept = kept.withColumn("first", F.lit(0))
    order = Window.partitionBy("rep").orderBy(F.desc("z"), "first", "term")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n).select("rep", "term", "rank")
