"""Mixing sources to target weights by pivotal dependent rounding, all in DataFrame functions.

A source's documents share one expected number of copies, target / size. Its
whole part is copied surely; the fraction is a probability. Parties with open
probabilities exchange mass, measured in words so that the expected number of
words stays exact, in a random direction that keeps each probability's mean,
until one of them is 0 or 1.

In a group, the longest open document meets the pool of all shorter ones as
one party: what it gains or gives is spread over their probabilities. So it is
the long document that settles, then the next, and what stays open is the
shortest. The groups, of about FAN documents each, form a tree: each settles
all but one, and those residuals meet in groups of the next level, until each
source has one, which is rounded to the nearer side.

A document that is long beside a whole group (over GIANT times the mean) could
not settle there. Such documents meet among themselves first, in the same way,
and the last of a source meets the pool of all its other documents, which is
one number a source. No group, whatever the source's size, holds more than a
few times FAN documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
FAN = 64
GIANT = 16

_DOC = "struct<doc_id:bigint,k:bigint,r:bigint,dup:int,size:bigint,p:double>"
_DONE = "struct<doc_id:bigint,k:bigint,r:bigint,dup:int,more:int>"
_STATE = f"struct<words:double,mass:double,add:double,times:double,open:{_DOC},done:array<{_DONE}>>"
_KEYS = ("doc_id", "k", "r", "dup")


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target for each source (null is one, the last by order).

    Every source gets level * weight, or most * source_size where that is
    less; level is what makes them add up to share of all sizes. With sources
    in order of the level at which they are full, the first place where the
    rest can take what is left gives it. One row per source, all in one task:
    the sources' names have to fit there.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (nth % len(weights) + 1).cast("int"))
    weighed = by.withColumn("w", weight).withColumn("full", most * F.col("source_size") / F.col("w"))
    order = Window.orderBy("full", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0))) * share
    levels = weighed.withColumn("level", (total - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))) / F.sum("w").over(rest))
    reached = levels.withColumn("open", F.col("level") < F.col("full"))
    level = F.min(F.when(F.col("open"), F.struct("full", "level"))).over(Window.partitionBy(F.lit(0)))["level"]
    return reached.select("source", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.when(level.isNull(), most * F.col("source_size")).otherwise(F.least(most * F.col("source_size"), level * F.col("w"))).cast("double").alias("target"))


def _draw(seed: int, *keys: Column) -> Column:
    """A number from 0 to 1 that depends on the keys alone."""
    return F.xxhash64(F.lit(seed), *keys).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once: within an aggregate nothing else shares what is written twice."""
    return F.transform(F.array(value), body)[0]


def _exchange(own: Column, p: Column, mass: Column, words: Column, draw: Column) -> Column:
    """One document of `own` words and probability p meets a pool of `words` words, `mass` of them expected: struct(p, mass), the new ones.

    The direction is drawn so that both means stay. Only where the pool can
    take the exchange in one direction alone, that one is taken: the document
    would stay open for good, and its rounding cost the source its target.
    """

    def ways(s: Column) -> Column:
        rise, fall = (1 - s["p"]) * s["own"], s["p"] * s["own"]
        return F.struct(rise.alias("rise"), fall.alias("fall"), F.least(rise, s["mass"]).alias("up"), F.least(fall, s["words"] - s["mass"]).alias("down"), (rise <= s["mass"]).alias("can_rise"), (fall <= s["words"] - s["mass"]).alias("can_fall"))

    def move(s: Column, w: Column) -> Column:
        rises = F.when(w["can_rise"] & ~w["can_fall"], True).when(w["can_fall"] & ~w["can_rise"], False).otherwise(s["draw"] * (w["up"] + w["down"]) < w["down"])
        return _let(rises, lambda r: F.when(r, result(s, w["up"], w["up"] == w["rise"], 1.0)).otherwise(result(s, -w["down"], w["down"] == w["fall"], 0.0)))

    def result(s: Column, moved: Column, settled: Column, end: float) -> Column:
        new = F.when(settled, F.lit(end)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["p"] + moved / s["own"])))
        return F.struct(new.alias("p"), (s["mass"] - moved).alias("mass"))

    both = F.struct(own.alias("own"), p.alias("p"), mass.alias("mass"), words.alias("words"), draw.alias("draw"))
    return _let(both, lambda s: _let(ways(s), lambda w: move(s, w)))


def _meet(acc: Column, x: Column, seed: int) -> Column:
    """The longest open document x meets the pool of those after it.

    acc: words and mass, of the documents from x on, by their first
    probabilities; add and times, which give a document's probability now as
    add + times * first; open, the document that is left if the pool settled
    before it; done.
    """
    none, whole_ = F.lit(0.0), F.lit(1.0)
    rest = F.struct((acc["words"] - x["size"]).alias("words"), (acc["mass"] - x["size"] * x["p"]).alias("mass"), F.greatest(none, F.least(whole_, acc["add"] + acc["times"] * x["p"])).alias("p"))

    def meet(b: Column) -> Column:
        now = F.greatest(none, F.least(b["words"], acc["add"] * b["words"] + acc["times"] * b["mass"]))  # of the pool
        draw = _draw(seed, x["doc_id"], x["k"], x["r"], x["dup"])
        return _let(now, lambda m: _let(_exchange(x["size"].cast("double"), b["p"], m, b["words"], draw), lambda e: end(b, m, e)))

    def end(b: Column, now: Column, e: Column) -> Column:
        # the pool's probabilities shrink towards 0, or towards 1, in proportion
        shrinks = e["mass"] <= now
        part = F.coalesce(F.when(shrinks, F.try_divide(e["mass"], now)).otherwise(F.try_divide(b["words"] - e["mass"], b["words"] - now)), none)
        left = acc["open"].isNotNull()  # the pool has settled, but for rounding of the sums
        whole = left | (e["p"] == 0) | (e["p"] == 1)
        keys = [x[c].alias(c) for c in _KEYS]
        held = F.struct(*keys, x["size"].alias("size"), e["p"].alias("p")).cast(_DOC)
        done = F.struct(*keys, (F.when(left, b["p"]).otherwise(e["p"]) >= 0.5).cast("int").alias("more")).cast(_DONE)
        return _let(F.struct(part.alias("part"), whole.alias("whole")), lambda f: F.struct(
            b["words"].alias("words"), b["mass"].alias("mass"),
            F.when(shrinks, acc["add"] * f["part"]).otherwise(1 - (1 - acc["add"]) * f["part"]).alias("add"), (acc["times"] * f["part"]).alias("times"),
            F.when(f["whole"], acc["open"]).otherwise(held).alias("open"),
            F.when(f["whole"], F.concat(acc["done"], F.array(done))).otherwise(acc["done"]).alias("done"),
        ).cast(_STATE))

    return _let(rest, meet)


def _level(open_: DataFrame, level: int, fan: int, seed: int) -> DataFrame:
    """One level of the tree: source, residual (or null), done (array) for each group."""
    groups = F.greatest(F.lit(1), F.ceil(F.col("n_open") / fan)).cast("long")
    dealt = open_.withColumn("g", F.pmod(F.xxhash64(F.lit(seed + level), *_KEYS), groups))
    member = F.struct((-F.col("size")).alias("order"), F.xxhash64(F.lit(-seed - level), *_KEYS).alias("h"), *_KEYS, "size", "p")
    grouped = dealt.groupBy("source", "g").agg(F.array_sort(F.collect_list(member)).alias("docs"))
    total = lambda f: F.aggregate("docs", F.lit(0.0), lambda a, x: a + f(x))
    start = F.struct(total(lambda x: x["size"]).alias("words"), total(lambda x: x["size"] * x["p"]).alias("mass"), F.lit(0.0).alias("add"), F.lit(1.0).alias("times"), F.lit(None).cast(_DOC).alias("open"), F.array().cast(f"array<{_DONE}>").alias("done")).cast(_STATE)
    met = F.aggregate("docs", start, lambda acc, x: _meet(acc, x, seed + level))
    return grouped.select("source", met.alias("s")).select("source", F.col("s.open").alias("residual"), F.col("s.done").alias("done"))


def _settled(open_: DataFrame, fan: int, seed: int) -> tuple[list[DataFrame], DataFrame]:
    """What the tree settles (source, keys, more), and the last document of each source (source, keys, size, p)."""
    parts, level = [], 0
    while True:
        counts = written(open_.groupBy("source").agg(F.count("*").alias("n_open")), "mix-counts")  # a row per source, so Spark sees its size and deals no hot source to one task
        most = counts.agg(F.max("n_open")).first()[0] or 0
        if level and most <= 1 or not most:
            return parts, open_
        own = counts.select(F.col("source").alias("s"), "n_open")
        dealt = open_.join(own, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        out = written(_level(dealt, level, fan, seed), "mix-level")
        parts.append(out.select("source", F.explode("done").alias("d")).select("source", *(f"d.{c}" for c in (*_KEYS, "more"))))
        open_, level = out.filter("residual IS NOT NULL").select("source", "residual.*"), level + 1


def mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, fan: int = FAN, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, copies, taken (copies * size), and k, r, dup, which tell rows with the same id apart.

    size counts words; null text has none, and documents without words are
    taken 0 times. A null source is a source. Null ids are allowed; rows that
    are equal in all columns are numbered by dup and drawn each by itself. The
    same table gives the same copies. No document is copied more than `most`
    times.
    """
    sizes = written(_units(df, id_col, text_col, source_col), "mix-sizes")
    targets = written(source_targets(sizes, weights, share, most), "mix-targets")
    per = targets.select(F.col("source").alias("s"), "source_size", "target")
    joined = sizes.join(per, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    base = F.least(F.floor(rate + 1e-12).cast("int"), F.lit(most))
    planned = written(joined.withColumn("base", base).withColumn("p", F.when((rate - F.col("base") > 1e-12) & (F.col("size") > 0), rate - F.col("base")).otherwise(0.0)), "mix-planned")

    # a source's open documents share one probability; giants settle first and move it
    mean = written(planned.filter("p > 0").groupBy("source").agg((F.avg("size") * GIANT).alias("limit")), "mix-means")
    open_ = planned.filter("p > 0").join(mean.select(F.col("source").alias("s"), "limit"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("giant", F.col("size") > F.col("limit"))
    columns = ["source", *_KEYS, "size", "p"]
    parts, left = _settled(open_.filter("giant").select(*columns), fan, seed - 1)
    pools = written(open_.filter("NOT giant").groupBy("source").agg(F.sum(F.col("size").cast("double")).alias("words"), F.max("p").alias("shared")), "mix-pools")
    last = left.select(*columns).join(pools.select(F.col("source").alias("s"), "words", "shared"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    exchanged = last.withColumn("e", _exchange(F.col("size").cast("double"), F.col("p"), F.col("shared") * F.col("words"), F.col("words"), _draw(seed - 2, *map(F.col, _KEYS))))
    met = written(exchanged.select(*(c for c in columns if c != "p"), F.col("e.p").alias("p"), F.coalesce(F.try_divide(F.col("e.mass"), F.col("words")), F.lit(0.0)).alias("pool")), "mix-giants")  # a row per source at most
    parts.append(met.select("source", *_KEYS, (F.col("p") >= 0.5).cast("int").alias("more")))
    pool = met.select(F.col("source").alias("s"), F.when(F.col("pool") < 1e-12, 0.0).when(F.col("pool") > 1 - 1e-12, 1.0).otherwise(F.col("pool")).alias("pool"))
    small = open_.filter("NOT giant").join(pool, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("p", F.coalesce("pool", "p")).select(*columns)
    parts.append(small.filter("p IN (0, 1)").select("source", *_KEYS, F.col("p").cast("int").alias("more")))
    more, left = _settled(small.filter("p > 0 AND p < 1"), fan, seed)
    parts += [*more, left.select("source", *_KEYS, (F.col("p") >= 0.5).cast("int").alias("more"))]

    drawn = parts[0]
    for part in parts[1:]:
        drawn = drawn.unionByName(part)
    drawn = drawn.select(*(F.col(c).alias(f"d_{c}") for c in _KEYS), "more")
    match = F.col("doc_id").eqNullSafe(F.col("d_doc_id")) & (F.col("k") == F.col("d_k")) & (F.col("r") == F.col("d_r")) & (F.col("dup") == F.col("d_dup"))
    found = planned.join(drawn, match, "left")
    copies = F.when(F.col("size") > 0, F.col("base") + F.coalesce("more", F.lit(0))).otherwise(0)
    return found.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"), "k", "r", "dup")


def _named(df: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """doc_id; k, a hash of the text; r, a hash of all columns that can be hashed: rows that agree in them are equal."""
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    return [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("k"), F.xxhash64(*hashed).alias("r")]


def _units(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, k, r, dup, source, size for each row. Equal rows are counted, which combines before the shuffle, and numbered."""
    rows = df.select(*_named(df, id_col, text_col), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col).cast("string")).alias("size"))
    counted = rows.groupBy("doc_id", "k", "r", "source", "size").agg(F.count("*").alias("n"))
    return counted.select("doc_id", "k", "r", "source", "size", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("dup"))


def take(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of df, all columns as they are, whatever their names, each as often as mix() takes it."""
    plan = mix(df, id_col=id_col, text_col=text_col, source_col=source_col, **options).withColumnRenamed(id_col, "doc_id")
    total = written(plan.groupBy("doc_id", "k", "r").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).filter("copies > 0"), "mix-copies")
    total = total.select(F.col("doc_id").alias("d_doc_id"), F.col("k").alias("d_k"), F.col("r").alias("d_r"), "copies", "rows")
    own = df.select(*_named(df, id_col, text_col), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    match = F.col("doc_id").eqNullSafe(F.col("d_doc_id")) & (F.col("k") == F.col("d_k")) & (F.col("r") == F.col("d_r"))
    out = own.join(total.filter("rows = 1"), match).select("row", "copies")
    several = total.filter("rows > 1")
    if not several.isEmpty():  # equal rows: one stands for all
        one = own.join(several, match, "left_semi").groupBy("doc_id", "k", "r").agg(F.any_value("row").alias("row"))
        out = out.unionByName(one.join(several, match).select("row", "copies"))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
