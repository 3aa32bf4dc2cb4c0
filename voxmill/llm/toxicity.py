"""Toxicity by nearest labelled examples.

A text's terms are its words, their beginnings of 4 letters and, in place
of a word longer than LONG (scripts without spaces, joined words), all its
3-grams. Every term of the labelled examples is indexed. A term
weighs (1 + ln tf) * idf, with document frequencies of all documents, times
the root of its chi-square with the labels among the examples: plain TF-IDF
finds neighbours of the same style and language, this finds those that share
what tells the labels apart.

The nearest examples by exact cosine are found in a block-max inverted index.
The postings of all but the most widespread terms are added up by example.
For the widespread ones, which weigh little and have most of the postings,
each block of examples holds only its largest weights: their sum bounds what
the terms can add. The examples that look best by that bound are completed
first; the k-th best of them is the mark, and the postings of examples that
cannot reach it are never read. Those that can are compared in full.

The neighbours vote with weights by distance, and a logistic curve fitted on
left-out votes of the examples turns votes into probabilities.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import bounded_batches, give_back, slices, written

#: Labelled rows that are learned from, at most: those first in the order of a hash of their ids.
EXAMPLES = 6000
NEIGHBOURS = 15
BEGINNINGS = (4,)
LONG, GRAM = 24, 3
BLOCK = 2  # examples that share a maximum in the index
WIDE = 512  # terms with block maxima at most: those in the most examples
EPSILON = 1e-5  # more than single precision and the order of a sum can change in a bound
KNOWN = 50_000  # texts whose neighbours a worker remembers, some 500 bytes each
WINDOW = 1 << 17  # bytes of text whose terms are worked out at once

_U64 = np.uint64
_GAPS = r"[^\x00-\x7F\p{L}\p{N}\p{M}]+"  # what lies between words, beside the ASCII characters that are no letter, digit or underscore
_ASCII = np.array([b if b > 127 or chr(b).isalnum() or b == 0x5F else 0x20 for b in range(256)], np.uint8)
_TABLE = np.random.default_rng(64).integers(0, 1 << 64, (64, 256), dtype=np.uint64)  # a byte's part in a word's hash, by place
_PARTS = _TABLE.ravel()


def held_out(doc_id: Column) -> Column:
    """Rows that nothing may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
    return x ^ (x >> _U64(32))


def _windows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, bool, bool]]:
    """(begin, end, begins within a word, ends within it) of stretches of about WINDOW bytes: cut between words, and within one where it is longer, with an overlap that keeps each gram in one stretch."""
    at, inside = 0, False
    while at < len(data):
        end = min(at + WINDOW, len(data))
        if end == len(data):
            yield at, end, inside, False
            return
        gap = np.flatnonzero(data[at + 1 : end] == 0x20)
        edge = int(offsets[np.searchsorted(offsets, end, side="right") - 1])
        cut = max(at + 1 + int(gap[-1]) if len(gap) else at, edge if edge > at else at)
        if cut > at:
            yield at, cut, inside, False
            at, inside = cut, False
        else:  # one word throughout
            back = end - np.flatnonzero((data[end - 4 * GRAM : end] & 0xC0)[::-1] != 0x80) - 1  # beginnings of the last letters, from the end
            yield at, int(back[0]), inside, True
            at, inside = int(back[GRAM - 1]), True


def _codes(data: np.ndarray, begin: np.ndarray, inside: bool, partial: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of a stretch of lower-cased words, and the byte at which each term's word begins.

    begin: where texts begin. inside: the first word began before; partial: the last goes on. Two terms of one hash would be one term.
    """
    solid = data != 0x20
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[begin] = solid[begin]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    own = data[solid]
    at = np.flatnonzero(first[solid])  # in the words' bytes alone
    ends = np.append(at[1:], len(own))
    place = np.arange(len(own)) - np.repeat(at, ends - at)
    letter = np.flatnonzero((own & 0xC0) != 0x80)
    one = np.searchsorted(letter, at)  # number of a word's first letter
    size = np.append(one[1:], len(letter)) - one
    long = size > LONG
    if inside:
        long[0] = True
    if partial:
        long[-1] = True
    with np.errstate(over="ignore"):
        part = _PARTS.take(((place & 63) << 8) + own)
        if size.max() > 16:  # a letter has 4 bytes at most
            part *= (2 * (place >> 6) + 1).astype(np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part)))
        short = np.flatnonzero(~long)
        codes, words = [_mix(sums[ends[short]] - sums[at[short]])], [short]
        edge = np.append(letter, len(own))
        for n in BEGINNINGS:
            some = np.flatnonzero(size >= n)
            if inside and len(some) and some[0] == 0:
                some = some[1:]
            codes.append(_mix((sums[edge[one[some] + n]] - sums[at[some]]) ^ _U64(0x5E)))
            words.append(some)
        runs = np.flatnonzero(long)
        if len(runs):
            letters = np.add.reduceat(_TABLE[np.arange(len(own)) - np.repeat(letter, np.diff(edge)), own], letter)
            grams = letters[: max(len(letters) - GRAM + 1, 0)].copy()
            for i in range(1, GRAM):
                grams = _mix(grams) + letters[i : i + len(grams)]
            n = np.maximum(size[runs] - GRAM + 1, 0)
            codes.append(_mix(grams[T.spread(np.arange(len(runs)), one[runs], n)] ^ _U64(0x3A)))
            words.append(np.repeat(runs, n))
    return np.concatenate(codes), starts[np.concatenate(words)]


class Vectors:
    """Term counts of whole texts. vocabulary: the terms that count, as ascending hashes; None for all."""

    def __init__(self, vocabulary: np.ndarray | None = None):
        self.vocabulary = vocabulary
        if vocabulary is not None:  # hashes spread evenly, so their leading bits lead almost to their place
            bits = max(1, len(vocabulary).bit_length())
            self.shift = _U64(64 - bits)
            self.place = np.searchsorted(vocabulary >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))

    def _numbers(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which codes are in the vocabulary, and their numbers."""
        bucket = (codes >> self.shift).astype(np.int64)
        at, end = self.place[bucket], self.place[bucket + 1]
        found = np.full(len(codes), -1)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            hit = self.vocabulary[at[open_]] == codes[open_]
            found[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        known = np.flatnonzero(found >= 0)
        return known, found[known]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) by text and term; a term is its number in the vocabulary, or its hash without one."""
        data, offsets = T.flat(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), _GAPS, " "))
        data = _ASCII[data]
        docs, terms, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64 if self.vocabulary is not None else np.uint64)], [np.zeros(0, np.int64)]
        for a, b, inside, partial in _windows(data, offsets):
            begin = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
            codes, at = _codes(data[a:b], begin, inside, partial)
            if self.vocabulary is not None:
                known, codes = self._numbers(codes)
                at = at[known]
            doc = np.searchsorted(offsets, a + at, side="right") - 1
            if self.vocabulary is None:
                parts = self._counted(doc, codes, np.ones(len(codes), np.int64))
            else:  # text and term in one number, which sorts fast
                keys = np.sort(doc * len(self.vocabulary) + codes)
                starts = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
                parts = *np.divmod(keys[starts], max(len(self.vocabulary), 1)), np.diff(np.append(starts, len(keys)))
            for held, x in zip((docs, terms, counts), parts, strict=True):
                held.append(x)
        doc, term, count = np.concatenate(docs), np.concatenate(terms), np.concatenate(counts)
        return (doc, term, count) if len(docs) < 3 else self._counted(doc, term, count)

    def _counted(self, doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.vocabulary is not None:
            order = np.argsort(doc * max(len(self.vocabulary), 1) + term, kind="stable")
        else:
            order = np.lexsort((term, doc))
        doc, term = doc[order], term[order]
        first = np.ones(len(doc), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
        starts = np.flatnonzero(first)
        return doc[starts], term[starts], np.add.reduceat(count[order], starts) if len(starts) else count


def _smallest(x: np.ndarray) -> np.ndarray:
    """The same numbers, none of them negative, in the smallest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


@dataclass
class Index:
    """The examples' term counts as postings: what is sent to the executors."""

    ids: np.ndarray  # doc ids of the examples
    labels: np.ndarray
    factor: np.ndarray  # [term] -> idf * association
    pointers: np.ndarray  # [term] -> first posting; one more at the end
    positions: np.ndarray
    counts: np.ndarray

    @staticmethod
    def build(ids: np.ndarray, labels: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray, factor: np.ndarray) -> Index:
        """row, term, count: the examples' term counts, by row. Examples with much in common get neighbouring places, so that blocks are tight; ties are settled by id all the same."""
        n, v = len(ids), len(factor)
        some = factor[term] > 0
        row, term, count = row[some], term[some], count[some]
        spread = np.bincount(term, minlength=v)
        own = np.full(n, -1, np.int64)  # neighbours share the most widespread term that not half of the examples have
        order = np.lexsort((np.where(spread[term] * 2 > n, 0, spread[term]), row))
        own[row[order]] = term[order]
        places = np.lexsort((ids, labels, own))
        place = np.empty(n, np.int32)
        place[places] = np.arange(n)
        row = place[row]
        order = np.lexsort((row, term))
        return Index(ids[places], labels[places], factor, np.searchsorted(term[order], np.arange(v + 1)).astype(np.int32), _smallest(row[order]), _smallest(count[order].astype(np.int64)))


class Search:
    """Unit vectors of the examples, made from an Index: postings by term, and for the widespread terms rows with block maxima."""

    def __init__(self, index: Index):
        self.ids, self.labels, self.factor = index.ids, index.labels, index.factor
        n, v = len(index.ids), len(index.factor)
        length = np.diff(index.pointers)
        term, row = np.repeat(np.arange(v), length), index.positions.astype(np.int64)
        weight = (1 + np.log(np.maximum(index.counts, 1).astype(float))) * index.factor[term]
        norm = np.sqrt(np.bincount(row, weight**2, minlength=n))
        weight /= np.maximum(norm[row], 1e-300)
        top = np.argsort(-length, kind="stable")[:WIDE]
        top = top[length[top] * 64 >= n]
        self.column = np.full(v, -1, np.int32)  # [term] -> its column in the two below, or -1
        self.column[top] = np.arange(len(top))
        blocks = -(-n // BLOCK)
        wide = np.zeros((blocks * BLOCK, len(top)))
        late = self.column[term] >= 0
        wide[row[late], self.column[term[late]]] = weight[late]
        self.wide, self.rough = wide[:n], wide[:n].astype(np.float32)  # [example, column] -> weight
        self.most = np.ascontiguousarray(wide.reshape(blocks, BLOCK, len(top)).max(axis=1).T.astype(np.float32)) if n else wide.T  # [column, block] -> largest weight
        self.positions, self.weights = row[~late], weight[~late]
        kept = np.where(self.column >= 0, 0, length)
        self.pointers = np.concatenate(([0], np.cumsum(kept)))

    def weigh(self, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(count)) * self.factor[term]
        norm = math.sqrt(float(w @ w))
        some = w > 0
        return term[some], w[some] / norm if norm else w[some]

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples with a positive cosine, nearest first, ties to the smaller doc id. term: ascending, with unit weights."""
        n = len(self.ids)
        if not len(term) or not n:
            return np.zeros(0, np.int64), np.zeros(0)
        column = self.column[term]
        late = column >= 0
        early = term[~late]
        starts = self.pointers[early]
        lengths = self.pointers[early + 1] - starts
        at = T.spread(np.arange(len(early)), starts, lengths)
        weights = self.weights[at]
        weights *= np.repeat(weight[~late], lengths)
        sums = np.bincount(self.positions[at], weights, minlength=n)
        if without >= 0:
            sums[without] = -2  # below any cosine
        asked = np.zeros(self.wide.shape[1])
        asked[column[late]] = weight[late]
        rows = np.arange(n)
        if n > 4 * k:
            rough = asked.astype(np.float32)
            bound = sums + np.repeat(rough[column[late]] @ self.most[column[late]], BLOCK)[:n]
            first = np.argpartition(bound, -4 * k)[-4 * k :]
            mark = np.partition(sums[first] + self.rough[first] @ rough, -k)[-k]
            rows = np.flatnonzero(bound >= mark - EPSILON)
            near = sums[rows] + self.rough[rows] @ rough
            rows = rows[near >= np.partition(near, -k)[-k] - EPSILON]
        rows = rows[rows != without]
        cosines = sums[rows] + np.einsum("ij,j->i", self.wide[rows], asked)  # row by row, so that the last bits don't depend on the others
        best = np.lexsort((self.ids[rows], -cosines))[:k]
        best = best[cosines[best] > 0]
        return rows[best], cosines[best]

    def vote(self, positions: np.ndarray, cosines: np.ndarray) -> float:
        """Share of label 1 among the neighbours, weighted by nearness."""
        w = 1 / (1.05 - np.minimum(cosines, 1))
        return float((w @ self.labels[positions] + 0.02) / (w.sum() + 0.04))


    def neighbours(self, term: np.ndarray, count: np.ndarray, without: int = -1) -> tuple[float | None, np.ndarray, np.ndarray]:
        """Log-odds of the vote, None without neighbours; positions and cosines."""
        positions, cosines = self.nearest(*self.weigh(term, count), without=without)
        if not len(positions):
            return None, positions, cosines
        raw = self.vote(positions, cosines)
        return math.log(raw / (1 - raw)), positions, cosines


@dataclass
class Model:
    sent: Broadcast | None  # (vocabulary, index), both bounded by the examples; None without examples of both labels
    slope: float = 1.0
    shift: float = 0.0
    base: float = 0.0  # of documents without any term

    def score(self, odds: float | None) -> float:
        return self.base if odds is None else 1 / (1 + math.exp(-min(30, max(-30, self.slope * odds + self.shift))))


def one_thread() -> None:
    """Products of so few numbers take less time than waking a matrix library's threads, which then spin; tasks are what runs side by side."""
    try:
        with open("/proc/self/maps") as f:
            libraries = {line.split()[-1] for line in f if "openblas" in line and ".so" in line}
        for path in libraries:
            library = ctypes.CDLL(path)
            for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(library, name):
                    getattr(library, name)(1)
                    break
    except OSError:  # no such library, or another system: slower, not wrong
        return


_last: list[tuple[object, Vectors, Search, dict]] = []


def made(sent: tuple[np.ndarray, Index]) -> tuple[Vectors, Search, dict[bytes, tuple]]:
    """What a worker makes of a model, once, and neighbours by a digest of the term counts, as copies have the same. It never holds more than one model's."""
    if not _last or _last[0][0] is not sent:
        one_thread()
        _last[:] = [(sent, Vectors(sent[0]), Search(sent[1]), {})]
    return _last[0][1:]


def _sample(documents: DataFrame, labels: DataFrame, examples: int, id_col: str, text_col: str) -> DataFrame:
    """At most `examples` labelled documents that may be learned from, with toxic. Conflicting labels of an id are averaged; of texts that share an id the first in order counts."""
    rows = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    ids = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kept = texts.join(F.broadcast(ids), "doc_id")  # bounded by `examples`
    return written(kept.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-examples")


def _counted(sample: DataFrame) -> pa.Table:
    """doc_id, toxic, terms (hashes) and counts of each example. Bounded by the examples and their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            for part in slices(batch, 2):
                doc, term, count = vectors(part.column(2))
                cut = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(cut, pa.array(term.view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(count, pa.int32()))], ["doc_id", "toxic", "terms", "counts"])

    return sample.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, terms array<long>, counts array<int>").toArrow().combine_chunks()


def _frequencies(documents: DataFrame, vocabulary: np.ndarray, text_col: str) -> tuple[int, np.ndarray]:
    """Number of documents, and of documents with each term of the vocabulary: over all of them."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the examples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, df, n = Vectors(sent.value), np.zeros(len(sent.value) + 1, np.int64), 0
        for batch in batches:
            for part in slices(batch, 0):
                _, term, _ = vectors(part.column(0))
                df[:-1] += np.bincount(term, minlength=len(df) - 1)
                n += part.num_rows
        df[-1] = n
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(df[own])], ["term", "n"])

    found = documents.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(vocabulary) + 1)
    df[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return int(df[-1]), df[:-1]


def association(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """The root of chi-square of a term's presence with the label, from how many examples of each label have it."""
    a, b, p, q = toxic, clean, n_toxic, n_clean
    return np.abs(a * (q - b) - b * (p - a)) * np.sqrt((p + q) / (p * q * (a + b) * np.maximum(p + q - a - b, 0.5)))


def fit(documents: DataFrame, labels: DataFrame, examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from at most `examples` labelled documents, whose terms are what reaches the driver."""
    bounded_batches(documents.sparkSession)
    sample = _sample(documents, labels, examples, id_col, text_col)
    rows = _counted(sample)
    toxic, ids = rows.column("toxic").to_numpy().astype(float), rows.column("doc_id").to_numpy()
    rate = float(toxic.mean()) if len(toxic) else 0.0
    if not 0 < rate < 1:
        return Model(None, base=rate)
    lists = rows.column("terms").combine_chunks()
    row = np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    vocabulary, term = np.unique(lists.flatten().to_numpy().view(np.uint64), return_inverse=True)
    term, count = term.astype(np.int32), rows.column("counts").combine_chunks().flatten().to_numpy()
    del rows, lists
    n, df = _frequencies(documents, vocabulary, text_col)
    hits = np.bincount(term, toxic[row], minlength=len(vocabulary))
    factor = (np.log((n + 1) / (df + 1)) + 1) * association(hits, np.bincount(term, minlength=len(vocabulary)) - hits, toxic.sum(), len(toxic) - toxic.sum())
    model = Model(documents.sparkSession.sparkContext.broadcast((vocabulary, Index.build(ids, toxic, row, term, count, factor))))
    bare = np.bincount(row, minlength=len(toxic)) == 0
    model.base = float((toxic[bare].sum() + rate) / (bare.sum() + 1))
    del row, term, count
    _calibrate(model, sample)
    give_back()
    return model


def _calibrate(model: Model, sample: DataFrame) -> None:
    """Fit slope and shift of the logistic curve on each example's vote without itself."""
    sent = model.sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, search, _ = made(sent.value)
        at = {int(i): p for p, i in enumerate(search.ids)}
        for batch in batches:
            for part in slices(batch, 2):
                doc, term, count = vectors(part.column(2))
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                odds = [search.neighbours(term[a:b], count[a:b], at[i])[0] for i, a, b in zip(part.column(0).to_pylist(), cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(odds, pa.float64()), part.column(1)], ["doc_id", "odds", "toxic"])

    votes = sample.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, odds double, toxic int").filter("odds IS NOT NULL").toArrow().sort_by("doc_id")
    x, y = votes.column("odds").to_numpy(), votes.column("toxic").to_numpy().astype(float)
    if not len(x):
        return
    design, beta = np.column_stack((x, np.ones(len(x)))), np.array([1.0, 0.0])
    prior, ridge = np.array([1.0, 0.0]), np.diag([1.0, 1.0])  # holds the curve where examples are few or separable
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, design.T @ (y - p) - ridge @ (beta - prior))
        beta += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.shift = float(max(beta[0], 0.0)), float(beta[1])


def _scored(model: Model, texts: pa.Array) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """Score, neighbours and cosines of each text."""
    if model.sent is None:
        for _ in range(len(texts)):
            yield model.base, np.zeros(0, np.int64), np.zeros(0)
        return
    vectors, search, known = made(model.sent.value)
    doc, term, count = vectors(texts)
    if len(known) > KNOWN:
        known.clear()
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        key = xxhash.xxh3_128_digest(term[a:b].tobytes() + count[a:b].tobytes())
        if key not in known:
            known[key] = search.neighbours(term[a:b], count[a:b])
        odds, positions, cosines = known[key]
        yield model.score(odds), positions, cosines


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted, evidence (all neighbours that voted, with cosine and label, nearest first).

    Only the text goes into a score. Null and empty texts, and texts without
    any term of the examples, get the rate of label 1 among such examples;
    without examples of both labels the score is their rate, or 0 for none.
    Repeated rows are kept, null ids stay null, other columns are not read.
    """
    bounded_batches(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()
    held = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                scores, found, near = [], [], []
                for s, positions, cosines in _scored(model, part.column(1)):
                    scores.append(s)
                    found.append(positions)
                    near.append(cosines)
                cut = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                at, cos = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64), np.concatenate(near) if near else np.zeros(0)
                index = model.sent.value[1] if model.sent else None
                ids, labels = (index.ids[at], index.labels[at]) if index else (at, at)
                voters = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(cos, pa.float64()), pa.array(labels.astype(np.int32), pa.int32())], fields=list(held.value_type))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.ListArray.from_arrays(cut, voters, type=held)], ["id", "score", "evidence"])

    out = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def keep_clean(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents, all columns as they are, whose score is under the threshold."""
    bounded_batches(documents.sparkSession)
    column = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield part.filter(pa.array([s < threshold for s, _, _ in _scored(model, part.column(column).cast(pa.string()))], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
