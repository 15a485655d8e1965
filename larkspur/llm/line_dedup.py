"""Cross-site boilerplate removal by the distinct-site spread of lines; DataFrame functions only.

A HyperLogLog sketch of the sites of each line merges by aggregation, so a
line on every page costs one sketch per task.  Lines whose estimate is clearly
above the threshold are boilerplate, lines clearly below are not; those within
the sketch's error of it get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.skew import join_groups
from larkspur.llm.workspace import Scratch, broadcast_if, fresh, own

#: A line on this many sites or more is boilerplate.
SITES = 10
#: log2 of a sketch's registers; its standard error is 1.04 / sqrt(2**LOG_K), 6.5 % at 8.
LOG_K = 8
#: Estimates within this many standard errors of the threshold are counted exactly.
SIGMAS = 6
#: Most boilerplate lines that are broadcast (16 bytes each).
BROADCAST_LINES = 200_000
#: Most texts with boilerplate and lines of theirs that are broadcast whole (24 and 4 bytes each, at most).
BROADCAST_PLACES = 1_000_000
#: Most texts with boilerplate whose hashes are broadcast (16 bytes each), so that only these texts are shuffled.
BROADCAST_TEXTS = 500_000


def _lines(docs: DataFrame) -> DataFrame:
    """Each line that is not blank, by two hashes, with its place in its text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("source"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return rows.filter(F.trim("line") != "").select("source", "t1", "t2", "pos", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"))


def boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """Hashes (h1, h2) of the lines that occur on ``sites`` distinct sources or more, and how often they occur (n)."""
    lines = _lines(docs).filter("source is not null")
    # sketches start in each task and are merged after the shuffle: a line on every page sends one a task
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg(F.xxhash64("source"), F.lit(LOG_K)).alias("sketch"), F.count("*").alias("n"))
    margin = SIGMAS * 1.04 / 2 ** (LOG_K / 2) * sites + 1
    about = F.hll_sketch_estimate("sketch").alias("about")
    with Scratch(docs.sparkSession) as scratch:
        spread = scratch.keep(scratch.stage(spread.select("h1", "h2", "n", about).filter(F.col("about") >= sites - margin)))
        near = scratch.keep(scratch.stage(spread.filter(F.col("about") <= sites + margin).select("h1", "h2", "n")))
    sure = spread.filter(F.col("about") > sites + margin).select("h1", "h2", "n")
    hinted = broadcast_if(near.select("h1", "h2"), BROADCAST_LINES)
    exact = lines.join(hinted, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("source").alias("k")).filter(F.col("k") >= sites)
    return sure.unionByName(near.join(exact.drop("k"), ["h1", "h2"]))


def _without(text: Column, drop: Column) -> Column:
    """The text without the lines at the positions ``drop`` (sorted), in time linear in both.

    The positions become a mark for each line up to the last of them.
    """
    marks = F.transform(drop, lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.when(i > 0, F.element_at(drop, i)).otherwise(-1) - 1), F.lit("1")))
    flags = F.split(F.array_join(marks, ""), "")
    return F.array_join(F.zip_with(F.split(text, "\n"), flags, lambda line, flag: F.when(flag.isNull() | (flag != "1"), line)), "\n")


def remove_boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """``docs`` (doc_id, text, source and others) with boilerplate lines taken out of ``text``; adds n_lines and n_removed.

    Lines end at line feeds and are compared as they are.  Blank lines (spaces
    only) are never boilerplate.  Rows without source keep their lines' other
    sites from nothing: they count for no site, but lose boilerplate too.  A
    null text stays null, with 0 lines; an empty text is one line.  Repeated
    rows and ids are treated row by row.  Columns n_lines and n_removed of
    ``docs`` are replaced; all others stay.  An empty table gives an empty one.
    Lines and texts are compared by two hashes of 64 bits each.
    """
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.stage(boilerplate(docs.select("source", "text"), sites))
        lines = _lines(docs.select("source", "text")).select("t1", "t2", "pos", "h1", "h2")
        if found.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
            hits = lines.join(F.broadcast(found.drop("n")), ["h1", "h2"], "left_semi")
        else:
            hits = join_groups(lines, found, ["h1", "h2"], "n", docs.count())
        places = F.collect_set("pos")
        drop = hits.groupBy("t1", "t2").agg(F.sort_array(places).alias("drop"), (F.count("*") / F.size(places)).cast("long").alias("copies"))
        drop = scratch.keep(scratch.stage(drop))
    a, b, d, n = (fresh(c, docs.columns) for c in ("t1", "t2", "drop", "copies"))
    drop = drop.select(F.col("t1").alias(a), F.col("t2").alias(b), F.col("drop").alias(d), F.col("copies").alias(n))
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select("*", F.xxhash64(text).alias(a), F.xxhash64(text, F.lit(1)).alias(b))
    parts = F.when(docs["text"].isNull(), 0).otherwise(F.size(F.split(docs["text"], "\n"))).cast("long")

    def out(frame: DataFrame, clean: Column, removed: Column) -> DataFrame:
        columns = [clean.alias("text") if c == "text" else own(frame, c) for c in docs.columns if c not in ("n_lines", "n_removed")]
        return frame.select(*columns, parts.alias("n_lines"), removed.cast("long").alias("n_removed"))

    clean = F.when(F.col(d).isNull(), docs["text"]).otherwise(_without(docs["text"], F.col(d)))
    removed = F.when(F.col(d).isNull(), 0).otherwise(F.size(d))
    texts, places = drop.agg(F.count("*"), F.coalesce(F.sum(F.size(d)), F.lit(0))).first()
    if texts + places <= BROADCAST_PLACES:
        return out(rows.join(F.broadcast(drop.drop(n)), [a, b], "left"), clean, removed)
    if texts > BROADCAST_TEXTS:
        return out(rows.join(drop.drop(n), [a, b], "left"), clean, removed)
    keys = F.broadcast(drop.select(a, b))
    lost = join_groups(rows.join(keys, [a, b], "left_semi"), drop, [a, b], n, docs.count())
    return out(lost, clean, removed).unionByName(out(rows.join(keys, [a, b], "left_anti"), docs["text"], F.lit(0)))
