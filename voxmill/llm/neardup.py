"""Near-duplicate documents by circulant MinHash.

Two permutations make the whole signature. The first scatters a document's
shingles over a ring of 2^32 places. The second ranks the places; turned by
one place for each coordinate, it gives coordinate k as the least rank of the
document's places less k. Coordinates are banded; documents that share a band
are candidates, and a link counts only after their full shingle sets have been
compared.

Copies collapse first: documents with the same set are one class, whatever
their number. In a bucket of classes, each is compared with one of them, drawn
afresh per band; only where a bucket still holds several components are the
members outside the first compared with all. So a bucket of near copies costs a comparison a
member, and no link between components is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import bounded_batches, slices, written
from .components import components

#: 28 bands of 5: a pair of similarity 0.8 shares none with probability 0.00002.
BANDS, ROWS = 28, 5
#: Members of one task's group when sets are compared; a larger group is split.
CHUNK = 256

_U64 = np.uint64
_MIX = (_U64(0x9E3779B97F4A7C15), _U64(0xBF58476D1CE4E5B9), _U64(0x94D049BB133111EB))  # fixed values: the SplitMix64 constants


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _MIX[1]
    x = (x ^ (x >> _U64(27))) * _MIX[2]
    return x ^ (x >> _U64(31))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's set of shingles, as sorted 64-bit hashes of the words in it, A-Z lower-cased.

    A text with fewer words than `width` has one shingle, the whole sequence;
    without words, none.
    """
    data, offsets = T.flat(texts)
    codes, distinct, at = T.words(T.LOWER[data], offsets)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))[codes]
    with np.errstate(over="ignore"):
        n = max(len(hashes) - width + 1, 0)
        rolled = np.zeros(n, np.uint64)
        for i in range(width):
            rolled = _mix(rolled * _MIX[0] + hashes[i : i + n])
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:
                whole = np.zeros(1, np.uint64)
                for h in hashes[a:b]:
                    whole = _mix(whole * _MIX[0] + h)
                out.append(_mix(whole + _U64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _rank(place: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of 32-bit places."""
    x = place * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    x ^= x >> np.uint32(13)
    return x


def signatures(sets: list[np.ndarray], size: int, block: int = 1 << 15) -> np.ndarray:
    """size coordinates of each non-empty set."""
    out = np.zeros((len(sets), size), np.uint32)
    start = 0
    with np.errstate(over="ignore"):
        while start < len(sets):
            stop, n = start, 0
            while stop < len(sets) and (not n or n + len(sets[stop]) <= block):
                n += len(sets[stop])
                stop += 1
            places = (_mix(np.concatenate(sets[start:stop]) * _MIX[0]) >> _U64(32)).astype(np.uint32)
            edges = np.cumsum([0, *(len(s) for s in sets[start : stop - 1])])
            for k in range(size):
                out[start:stop, k] = np.minimum.reduceat(_rank(places - np.uint32(k)), edges)
            start = stop
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature, different bands apart."""
    with np.errstate(over="ignore"):
        own = signature.reshape(len(signature), bands, rows).astype(np.uint64)
        key = np.arange(1, bands + 1, dtype=np.uint64) * _MIX[0] + np.zeros((len(signature), 1), np.uint64)
        for r in range(rows):
            key = _mix(key * _MIX[1] + own[:, :, r])
    return key.view(np.int64)


def _features(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set, null if empty), keys (of its bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_sets(part.column(1), width)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(signatures([sets[i] for i in full], bands * rows), bands, rows) if full else np.zeros((0, bands), np.int64)
                digests: list[bytes | None] = [xxhash.xxh3_128_digest(s) if len(s) else None for s in sets]
                cut = np.cumsum([0, *(bands * bool(len(s)) for s in sets)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(keys.ravel()))], ["doc_id", "n_shingles", "digest", "keys"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if not small or 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """node, set: a document's shingle hashes as bytes, so that they are worked out once however often they are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in shingle_sets(part.column(1), width)], pa.binary())], ["node", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, set binary")


def _read(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets.

    Pairs are grouped by a; a group of more than CHUNK is split. A task reads
    a's set first, and streams the others past it.
    """
    groups = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("n")), "neardup-groups")  # combined before the shuffle; the join's hot keys can then be split
    cut = pairs.join(groups, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("n")).cast("int"))
    members = cut.select("a", "part", F.col("b").alias("node"), F.lit(1).alias("turn"))
    heads = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), F.col("a").alias("node"), F.lit(0).alias("turn"))
    dealt = heads.unionByName(members).join(sets.hint("merge"), "node").select("a", "part", "turn", "node", "set")
    dealt = dealt.repartition("a", "part").sortWithinPartitions("a", "part", "turn", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for part in slices(batch, 4):
                one, other = [], []
                rows = zip(*(part.column(i).to_pylist() for i in range(4)), _read(part.column(4)), strict=True)
                for a, p, turn, node, s in rows:
                    if (a, p) != group:
                        group, held = (a, p), []
                    if not turn:
                        held.append(s)
                    elif any(_linked(s, head, percent) for head in held):
                        one.append(a)
                        other.append(node)
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(other, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _across(sets: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Links between different components of a bucket that don't go through its head.

    placed: key, node, head, n_shingles, component. In a bucket, the members
    outside the component of the head are held against all members (but the
    head, which has been compared with each) of a size that allows a link:
    sizes fall in classes by a factor of 100 / percent, and only neighbouring
    classes meet. Only links leave a task, one for a member and another
    component, so no table of pairs arises. Large classes are cut into blocks
    on both sides.
    """
    main = placed.filter("node = head").select("key", F.col("component").alias("main"))
    sized = placed.filter("node <> head").withColumn("c", F.floor(F.ln("n_shingles") / math.log(100 / percent + 1e-7)).cast("int"))
    others = written(sized.join(main, "key"), "neardup-others")
    several = written(others.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key"), "neardup-open-keys")
    open_ = written(others.join(several, "key"), "neardup-open")
    per = open_.groupBy("key", "c").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("mb"), F.ceil(F.count_if(F.col("component") != F.col("main")) / CHUNK).cast("int").alias("sb"))
    per = written(per, "neardup-blocks")
    nth = F.xxhash64("node")
    near = F.explode(F.array(*(F.col("c") + d for d in (-1, 0, 1))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocks = lambda c, n: per.filter(f"{n} > 0").select("key", F.col("c").alias(c), n)
    strays = open_.filter("component <> main").join(per.select("key", "c", "sb"), ["key", "c"])
    strays = strays.select("key", F.col("c").alias("sc"), F.pmod(nth, "sb").cast("int").alias("s"), near.alias("mc"), F.lit(0).alias("turn"), "node", "component").join(blocks("mc", "mb"), ["key", "mc"]).withColumn("m", every("mb"))
    members = open_.join(per.select("key", "c", "mb"), ["key", "c"])
    members = members.select("key", F.col("c").alias("mc"), F.pmod(nth, "mb").cast("int").alias("m"), near.alias("sc"), F.lit(1).alias("turn"), "node", "component").join(blocks("sc", "sb"), ["key", "sc"]).withColumn("s", every("sb"))
    group = ["key", "sc", "s", "mc", "m"]
    columns = [*group, "turn", "node", "component"]
    dealt = strays.select(*columns).unionByName(members.select(*columns)).join(sets.hint("merge"), "node").select(*columns, "set")
    dealt = dealt.repartition(*group).sortWithinPartitions(*group, "turn", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, table, told = None, [], None, set()
        for batch in batches:
            for part in slices(batch, 8):
                sets = _read(part.column(8))
                keys = list(zip(*(part.column(i).to_pylist() for i in range(5)), strict=True))
                turns, nodes, comps = (part.column(i).to_pylist() for i in (5, 6, 7))
                one, other, i = [], [], 0
                while i < len(keys):
                    if keys[i] != group:
                        group, held, table, told = keys[i], [], None, set()
                    if not turns[i]:
                        held.append((nodes[i], comps[i], sets[i]))
                        i += 1
                        continue
                    j = i
                    while j < len(keys) and keys[j] == group and turns[j]:
                        j += 1
                    if table is None:
                        table = np.unique(np.concatenate([s for _, _, s in held])) if held else np.zeros(0, np.uint64)
                    for x, y in _block_links(held, table, nodes[i:j], comps[i:j], sets[i:j], percent, told):
                        one.append(x)
                        other.append(y)
                    i = j
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(other, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _block_links(held: list, table: np.ndarray, nodes: list, comps: list, sets: list[np.ndarray], percent: int, told: set) -> Iterator[tuple[int, int]]:
    """Links of held (node, component, set) with a run of members of other components: all intersections of one held set at once."""
    if not held or not len(table):
        return
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(table, flat), len(table) - 1)
    known = table[at] == flat
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)[known]
    at = at[known]
    mark = np.zeros(len(table), bool)
    for node, component, own in held:
        place = np.searchsorted(table, own)
        mark[place] = True
        both = np.bincount(owner[mark[at]], minlength=len(sets))
        mark[place] = False
        for k in np.flatnonzero((both > 0) & (100 * both >= percent * (sizes + len(own) - both))):
            if comps[k] != component and (node, comps[k]) not in told:
                told.add((node, comps[k]))
                yield node, nodes[k]


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their
    sets of `width`-word shingles; component_id is the smallest id reachable,
    kept says that it is the document's own. Null or empty texts, and texts
    without words, have an empty set and are linked with nothing. Rows that
    share an id are one document (linked with each other); a null id is linked
    with nothing, its component_id is null and it is kept. Other columns are
    not read. An empty table gives an empty one.
    """
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    features = written(_features(docs, width, bands, rows), "neardup-features")
    valid = features.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = written(valid.groupBy("digest").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n_shingles"), F.any_value("keys").alias("keys")), "neardup-classes")
    bucketed = classes.select("node", "n_shingles", F.explode(F.array_distinct("keys")).alias("key"))
    turned = F.xxhash64("key")  # node ^ turned orders a bucket's nodes afresh for each key, and gives the node back
    buckets = bucketed.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(turned)).alias("least"), F.count("*").alias("n")).filter("n > 1")
    buckets = written(buckets.select("key", F.col("least").bitwiseXOR(turned).alias("head")), "neardup-buckets")
    members = written(bucketed.join(buckets, "key"), "neardup-members")
    asked = members.select(F.col("node").alias("doc_id")).distinct()
    sets = _sets(docs.join(asked.hint("merge"), "doc_id", "left_semi"), width)
    repeated = written(valid.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "neardup-repeated")
    if not repeated.isEmpty():
        sets = sets.distinct()
    sets = written(sets, "neardup-sets")

    pairs = members.filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    links = written(_confirmed(sets, written(pairs, "neardup-pairs"), percent), "neardup-confirmed")
    placed = members.join(components(links), "node", "left").select("key", "node", "head", "n_shingles", F.coalesce("component", "node").alias("component"))
    more = written(_across(sets, placed, percent), "neardup-confirmed")

    # an id with several texts links their classes
    by_id = valid.join(repeated, "doc_id").select("doc_id", "digest").distinct().join(classes.select("digest", "node"), "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).filter("a <> b")
    final = written(components(links.unionByName(more).unionByName(by_id)), "neardup-components")

    own = features.select("doc_id", "n_shingles", "digest")
    found = own.join(classes.select("digest", "node"), "digest", "left").join(final, "node", "left")
    reach = F.least(F.coalesce("component", "node", "doc_id"), F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), reach)
    return found.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
