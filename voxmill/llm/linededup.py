"""Removing line chunks that repeat across documents, in DataFrame functions.

Chunk boundaries depend on content alone: a rolling hash over the hashes of
the last lines ends a chunk where it is 0 modulo a divisor, so a passage keeps
its inner boundaries wherever it stands. A line of many words is a chunk of
its own. Chunks are first counted by hash; those whose hash repeats are then
compared by their bytes, and all but the first occurrence are removed.

Beside the chunks go stretches of lines: where lines that each repeat follow
one another, every shortest stretch of `long_line` words or more, counted from
each line forwards and backwards, is compared with all others, and its later
occurrences are removed. They overlap, so a repeated passage of that length
goes whole, whatever its chunks are and wherever it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

DIVISOR = 2
LONG_LINE = 50


def _line_hashes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(x))


def _ends(lines: str, hashes: str, divisor: int, long_line: int) -> Column:
    """Positions (from 0) of the lines that end a chunk."""
    h, x = F.col(hashes), F.col(lines)

    def is_long(i: Column) -> Column:
        line = x[i]
        return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1 >= long_line

    def ends(i: Column) -> Column:
        before = F.when(i == 0, F.lit(0).cast("long")).otherwise(h[i - 1])
        turned = F.shiftleft(before, 1).bitwiseOR(F.shiftrightunsigned(before, 63))
        rolled = turned.bitwiseXOR(h[i])
        return F.when(i == F.size(x) - 1, F.lit(True)).otherwise((F.pmod(F.xxhash64(rolled), F.lit(divisor)) == 0) | is_long(i) | is_long(i + 1))

    return F.filter(F.sequence(F.lit(0), F.size(x) - 1), ends)


def _chunked(df: DataFrame, text_col: str, divisor: int, long_line: int) -> DataFrame:
    """df with _lines and _chunks: array of struct(a, n), the first line (from 1) and the number of lines of each chunk."""
    own = df.withColumn("_lines", F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n", -1))
    own = own.withColumn("_hashes", _line_hashes(F.col("_lines")))
    own = own.withColumn("_ends", _ends("_lines", "_hashes", divisor, long_line))
    e = F.col("_ends")
    chunk = F.transform(e, lambda x, i: F.struct((F.when(i == 0, F.lit(0)).otherwise(e[i - 1] + 1) + 1).alias("a"), (x - F.when(i == 0, F.lit(-1)).otherwise(e[i - 1])).alias("n")))
    return own.withColumn("_chunks", chunk)


def _text(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["a"], chunk["n"]), "\n")


def _keys(id_col: str, text_col: str) -> list[Column]:
    """What tells documents apart; rows that agree in both are one document."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_k1"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_k2")]


def _stretches(df: DataFrame, long_line: int) -> DataFrame:
    """df with _run, its repeated lines, and _windows: the shortest stretches of them with `long_line` words, from each line forwards and backwards.

    Every line in them has a word, so a stretch has `long_line` lines at most;
    blank lines between don't count.
    """
    lines, full = F.col("_lines"), F.col("_full")
    own = df.withColumn("_run", F.transform(F.array_sort(F.transform(F.filter("_asked", lambda i: i < 0), lambda i: -1 - i)), lambda j: F.struct(j.alias("j"), full[j].alias("at"), F.col("_hashes")[full[j]].alias("h"), F.size(F.regexp_extract_all(lines[full[j]], F.lit(r"\S+"), F.lit(0))).alias("w"))))
    run = F.col("_run")

    def reach(part: Column, first: Column, step: int) -> Column:
        """n lines of part in a row, from number first on, and their words w, till there are enough."""
        grow = lambda t, x: F.when((t["w"] < long_line) & (x["j"] == first + t["n"] * step), F.struct((t["n"] + 1).alias("n"), (t["w"] + x["w"]).alias("w"))).otherwise(t)
        return F.aggregate(part, F.struct(F.lit(0).alias("n"), F.lit(0).alias("w")), grow)

    def window(p: Column, n: Column, w: Column) -> Column:
        return F.struct(p.alias("p"), n.alias("n"), w.alias("w"))

    def onward(x: Column, p: Column) -> Column:
        t = reach(F.slice(run, p + 1, F.lit(long_line)), x["j"], 1)
        return window(p, t["n"], t["w"])

    def back(x: Column, p: Column) -> Column:
        low = F.greatest(F.lit(0), p - (long_line - 1))
        t = reach(F.reverse(F.slice(run, low + 1, p - low + 1)), x["j"], -1)
        return window(p - t["n"] + 1, t["n"], t["w"])

    own = own.withColumn("_both", F.array_distinct(F.filter(F.concat(F.transform(run, onward), F.transform(run, back)), lambda t: t["w"] >= long_line)))

    def keyed(t: Column) -> Column:
        part = F.slice(run, t["p"] + 1, t["n"])
        return F.struct(run[t["p"]]["j"].alias("j"), F.transform(part, lambda x: x["at"]).alias("ats"), F.transform(part, lambda x: x["h"]).alias("key"))

    return own.withColumn("_windows", F.transform("_both", keyed))


def removals(df: DataFrame, divisor: int = DIVISOR, long_line: int = LONG_LINE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For documents with repeats: _k1, _k2, _gone, the numbers of the chunks that repeat an earlier one, and _ranges, first and last position (from 0) of stretches that do."""
    docs = df.select(*_keys(id_col, text_col), F.col(text_col).cast("string").alias("_text"))
    cut = _chunked(docs, "_text", divisor, long_line)
    cut = cut.withColumn("_full", F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: F.col("_lines")[i].rlike(r"\S")))

    def counts(c: Column) -> Column:
        line = F.col("_lines")[c["a"] - 1]
        return (c["n"] > 1) | ((F.size(F.split(line, r"\s+")) >= long_line) & line.rlike(r"\S"))

    numbered = F.transform(F.col("_chunks"), lambda c, i: F.struct(i.alias("i"), c["a"].alias("a"), c["n"].alias("n")))
    whole = F.transform(F.filter(numbered, counts), lambda c: F.struct(c["i"].alias("i"), F.xxhash64(F.array_join(F.transform(F.slice("_hashes", c["a"], c["n"]), lambda h: h.cast("string")), ",")).alias("h")))
    single = F.transform(F.col("_full"), lambda at, j: F.struct((-1 - j).alias("i"), F.col("_hashes")[at].alias("h")))  # below 0: lines that aren't blank, by number
    seen = written(cut.select("_k1", "_k2", F.explode(F.concat(whole, single)).alias("c")).select("_k1", "_k2", "c.*"), "line-chunks")
    # aggregates are written before they are joined with: their hot keys combine before the shuffle, and the join's can then be split
    repeated = written(seen.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "line-hashes")
    asked = seen.join(repeated, "h").groupBy("_k1", "_k2").agg(F.collect_set("i").alias("_asked"))  # of one document

    found = cut.join(asked.hint("merge"), ["_k1", "_k2"])
    texts = F.transform(F.filter("_asked", lambda i: i >= 0), lambda i: F.struct(i.alias("i"), _text(F.col("_lines"), F.col("_chunks")[i]).alias("chunk")))
    parts = written(_stretches(found, long_line).select("_k1", "_k2", texts.alias("_texts"), "_windows", F.when(F.size("_windows") > 0, F.transform("_run", lambda x: F.struct(x["h"].alias("h"), F.col("_lines")[x["at"]].alias("line")))).alias("_repeats")), "line-repeats")

    chunks = parts.select("_k1", "_k2", F.inline("_texts")).filter(F.length(F.trim("chunk")) > 0)
    place = F.struct("_k1", "_k2", "i")
    first = written(chunks.groupBy("chunk").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("chunk", "first"), "line-firsts")
    later = chunks.join(first, "chunk").filter(place != F.col("first")).select("_k1", "_k2", "i", F.lit(None).cast("struct<a:int,b:int>").alias("lines"))

    # A hash that stands for two lines proves nothing; there is hardly ever one.
    doubtful = [r["h"] for r in parts.select(F.inline("_repeats")).distinct().groupBy("h").count().filter("count > 1").select("h").collect()]
    windows = parts.select("_k1", "_k2", F.inline("_windows"))
    if doubtful:
        windows = windows.filter(~F.arrays_overlap("key", F.array(*map(F.lit, doubtful))))
    start = F.struct("_k1", "_k2", "j")
    known = written(windows.groupBy("key").agg(F.min(start).alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first"), "line-windows")
    again = windows.join(known, "key").filter(start != F.col("first"))
    own = (F.col("first._k1") == F.col("_k1")) & (F.col("first._k2") == F.col("_k2"))
    common = F.when(own, F.greatest(F.lit(0), F.col("first.j") + F.size("ats") - F.col("j"))).otherwise(0)  # lines that are the first occurrence's, too
    ranges = again.select("_k1", "_k2", F.lit(None).cast("int").alias("i"), F.struct(F.col("ats")[common].alias("a"), F.element_at("ats", -1).alias("b")).alias("lines"))
    return written(later.unionByName(ranges).groupBy("_k1", "_k2").agg(F.collect_set("i").alias("_gone"), F.collect_set("lines").alias("_ranges")), "line-removals")


def dedup_lines(df: DataFrame, divisor: int = DIVISOR, long_line: int = LONG_LINE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df, all columns as they are, whatever their names, with repeated chunks taken out of the text, plus n_lines, removed_lines, removed_chunks.

    A chunk counts if it has two lines or more, or one line of at least
    `long_line` words, and isn't blank; a stretch of lines, with the blank ones
    in it, counts if it has `long_line` words, and is no chunk in
    removed_chunks. The first occurrence, by id, then text hash, then place,
    stays. Null text stays null with 0 lines; the order of
    what is left doesn't change. Rows that share id and text are one document
    and are treated alike; null ids come first. The three added names replace
    columns of df that have them already.
    """
    gone = removals(df, divisor, long_line, id_col, text_col)
    keyed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text_col).cast("string").alias("_text"), *_keys(id_col, text_col))
    joined = _chunked(keyed.join(gone.hint("merge"), ["_k1", "_k2"], "left"), "_text", divisor, long_line)
    dropped = F.coalesce(F.col("_gone"), F.array().cast("array<int>"))
    of_chunks = F.transform(dropped, lambda i: F.sequence(F.col("_chunks")[i]["a"] - 1, F.col("_chunks")[i]["a"] + F.col("_chunks")[i]["n"] - 2))
    of_stretches = F.transform(F.coalesce(F.col("_ranges"), F.array().cast("array<struct<a:int,b:int>>")), lambda r: F.sequence(r["a"], r["b"]))
    joined = joined.withColumn("_out", F.array_distinct(F.flatten(F.concat(of_chunks, of_stretches))))
    out = F.col("_out")
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), out), lambda i: F.col("_lines")[i]), "\n")
    text = F.when(F.size(out) == 0, F.col("_text")).otherwise(left)
    added = {"n_lines": F.when(F.col("_text").isNull(), 0).otherwise(F.size("_lines")), "removed_lines": F.size(out), "removed_chunks": F.size(dropped)}
    base = [(text if c == text_col else F.col("row").getField(c)).alias(c) for c in df.columns if c not in added]
    final = [*base, *(v.cast("int").alias(c) for c, v in added.items())]
    return joined.select(F.inline(F.array(F.struct(*final))))  # a caller's filter stays above; pushed below, it would repeat the work above for each use of a column
