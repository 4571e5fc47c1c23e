"""Line deduplication by winnowing over line hashes.

Of every `run` consecutive lines (a window) the smallest hash, the last of equal ones, is
selected; neighbouring windows mostly select the same line, which is one fingerprint.
Two equal runs of `run` lines select the same line of theirs, so that a fingerprint that
stands at one place only belongs to no repeated run. Fingerprints are joined on their
hash; those that meet are extended both ways, by the windows around them that select
them, and such windows are compared. Those that occurred earlier, by document id and
line, are deleted; overlapping ones make up the maximal repeated run.

Lines are selected by 64 bits of a hash and windows compared by 128 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import broadcast_if_small, cut, fresh

RUN = 2
#: Bytes of runs to remove that are broadcast at most; beyond it the join is shuffled.
BROADCAST_BYTES = 32 << 20


def selected(h: Column, start: Column, run: int) -> Column:
    """The place in h (from 0) of the last smallest hash of the `run` lines from `start` (from 0) on."""
    lines = F.slice(h, start + 1, run)
    return start + run - F.array_position(F.reverse(lines), F.array_min(lines)).cast("int")


def fingerprints(docs: DataFrame, run: int) -> DataFrame:
    """doc_id, text_key, pos (a selected line), mark (its hash), base and h, g (the first line and two hashes of each line around).

    Around are the lines of all windows that hold the selected one.
    """
    split = F.split("text", "\n")
    hashed = docs.select("doc_id", "text_key", F.transform(split, lambda x: F.xxhash64(x)).alias("h"), F.transform(split, lambda x: F.xxhash64(F.lit(1), x)).alias("g")).where(F.size("h") >= run)
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("h") - run), lambda i: selected(F.col("h"), i, run)))

    def around(p: Column) -> Column:
        base = F.greatest(p - run + 1, F.lit(0))
        cut_out = lambda c: F.slice(c, base + 1, p + run - base).alias(c)
        return F.struct(p.alias("pos"), F.get("h", p).alias("mark"), base.alias("base"), cut_out("h"), cut_out("g"))

    return hashed.select("doc_id", "text_key", F.inline(F.transform(places, around)))


def repeated_runs(docs: DataFrame, run: int) -> DataFrame:
    """doc_id, text_key, start of the runs of lines that have occurred before."""
    marks = fingerprints(docs, run)
    met = marks.groupBy("mark").agg(F.count("*").alias("places")).where("places > 1").select("mark")
    starts = F.filter(F.sequence(F.lit(0), F.size("h") - run), lambda s: selected(F.col("h"), s, run) == F.col("pos") - F.col("base"))
    window = F.transform(starts, lambda s: F.struct((F.col("base") + s).alias("start"), F.xxhash64(F.slice("h", s + 1, run)).alias("k1"), F.xxhash64(F.slice("g", s + 1, run)).alias("k2")))
    windows = marks.join(met, "mark", "left_semi").select("doc_id", "text_key", F.inline(window))
    first = windows.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return windows.join(first, ["k1", "k2"]).where(F.struct("doc_id", "start") > F.col("first")).select("doc_id", "text_key", "start")


def remove_repeated_runs(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_lines, n_removed, kept (the text that remains) for each row of docs.

    Lines end at \\n. A line is removed where it is in `run`
    consecutive lines that also stand earlier: in a document of a smaller id, or above in
    the same one. A null text has no lines and stays null; a text whose lines are all
    removed becomes empty. Rows without an id are neither shortened nor shorten others.
    Repeated rows give repeated rows and don't shorten each other. Other columns are not
    read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    usable = rows.where("doc_id is not null and text is not null")
    later = cut(repeated_runs(usable, run).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("start")).alias("starts")))
    out = rows.join(broadcast_if_small(later, later.agg(F.sum(F.size("starts") * 4 + 32)).first()[0], BROADCAST_BYTES), ["doc_id", "text_key"], "left")
    lines = F.split("text", "\n")
    # what lies before the first run, and between the end of each and the next
    between = F.transform("starts", lambda s, j: F.slice(lines, s + run + 1, F.greatest(F.lit(0), F.coalesce(F.get("starts", j + 1), F.size(lines)) - s - run)))
    rest = F.flatten(F.concat(F.array(F.slice(lines, F.lit(1), F.get("starts", F.lit(0)))), between))
    out = out.select("doc_id", "text", F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.when(F.col("starts").isNotNull(), rest).alias("rest"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long")
    return out.select("doc_id", "text", n_lines.alias("n_lines"), F.when(F.col("rest").isNull(), 0).otherwise(n_lines - F.size("rest")).cast("long").alias("n_removed"), F.when(F.col("rest").isNull(), F.col("text")).otherwise(F.array_join("rest", "\n")).alias("kept"))


def shorten(docs: DataFrame, run: int = RUN) -> DataFrame:
    """The rows of docs with repeated runs of lines removed from text (and n_chars, where there is one, recounted).

    Rows whose text had lines and lost them all go; other columns, and texts that lose
    nothing, are unchanged.
    """
    done = remove_repeated_runs(docs, run).where("n_removed > 0").select("doc_id", F.xxhash64("text").alias("key"), "kept", (F.col("n_removed") == F.col("n_lines")).alias("gone")).distinct()
    found = fresh(docs, "found")
    done = cut(done.select(F.struct("doc_id", "key", "kept", "gone").alias(found)))
    text, kept = F.col("text").cast("string"), F.col(f"{found}.kept")
    met = docs.join(done, (F.col("doc_id").cast("long") == F.col(f"{found}.doc_id")) & (F.xxhash64(text) == F.col(f"{found}.key")), "left").where(~F.coalesce(f"{found}.gone", F.lit(False)))
    changed = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(kept.isNotNull(), F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return met.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))
