"""The trie of all conversations' beginnings, rolled up in bands of depths.

A node is a sequence of turns that conversations begin with. It is named by its depth and
two 64-bit sums (xor) of hashes of its turns and their places, which a running window
gives each conversation's row, so that no text and no whole conversation is ever in one
row. A node carries its ancestors within its band of `height` depths only.

Subtree totals: bands are finished from the deepest one up. In a band each node explodes
to its ancestors in it and is summed there; so a band's first nodes (its roots) have
complete totals, which are added to their parents, the last nodes of the band above,
before those explode. That makes depth / height rounds, and at most `height` rows of a
node. Every round reads only its own band of a table that was written in order of depth.

Conversations that end at a node are hashed in order of their ids without being
gathered: sorted runs are packed into pieces, and a task streams a node's pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256
from itertools import batched, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.common import cut, shared_folder, tune

HEIGHT = 16
#: Ids of a piece.
PIECE = 1 << 16
KEY = ["depth", "s1", "s2"]


def numbered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, place (from 1), k1, k2 (hashes of role and text), chars (code points of the text).

    By turn, null first; of equal turns by role, then by the SHA-256 of the text. A null
    role or text is empty. Rows without a conversation don't count.
    """
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    rows = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(1), "role", "text").alias("k2"), F.length("text").cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return rows.select("conv_id", F.row_number().over(order).alias("place"), "k1", "k2", "chars")


def share_openings(turns: DataFrame, every: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on shared openings, as (turns, conv_ids): turns again has conv_id, place, k1, k2, chars.

    Conversation c begins with the first h turns of conversation c - c % every (fewer if
    that has fewer, none if there is none), h = crc32(c) % (longest + 1); then come its
    own turns but for its first h. % has the sign of c. An opening is at most `longest` turns of one of every
    `every` conversations.
    """
    ids = turns.select("conv_id").distinct().select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)).cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("donor"))
    openings = turns.where((F.col("conv_id") % every == 0) & (F.col("place") <= longest)).groupBy(F.col("conv_id").alias("donor")).agg(F.array_sort(F.collect_list(F.struct("place", "k1", "k2", "chars"))).alias("opening"))
    ids = ids.join(openings, "donor", "left").select("conv_id", "h", F.slice(F.coalesce("opening", F.expr("cast(array() as array<struct<place: int, k1: bigint, k2: bigint, chars: bigint>>)")), F.lit(1), F.col("h")).alias("opening"))
    own = turns.join(ids.select("conv_id", "h", F.size("opening").alias("lead")), "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("lead")).alias("place"), "k1", "k2", "chars")
    return ids.select("conv_id", F.inline("opening")).unionByName(own), ids.select("conv_id")


def prefixes(turns: DataFrame, conv_ids: DataFrame, height: int) -> DataFrame:
    """A row for each beginning of each conversation: conv_id, depth, s1, s2, the parent's p1 and p2, chars, above (ancestors in the band and itself, from the top), ends."""
    rows = turns.select("conv_id", F.col("place").alias("depth"), "k1", "k2", "chars").unionByName(conv_ids.select("conv_id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2"), F.lit(0).cast("long").alias("chars")))
    order = Window.partitionBy("conv_id").orderBy("depth")
    mark = lambda *x: F.when(F.col("depth") > 0, F.xxhash64("depth", *x)).otherwise(0)
    rows = rows.select("conv_id", "depth", "chars", F.bit_xor(mark("k1", "k2")).over(order).alias("s1"), F.bit_xor(mark("k2", "k1")).over(order).alias("s2"))
    near = F.collect_list(F.struct("s1", "s2")).over(order.rowsBetween(1 - height, 0))
    rows = rows.select("*", F.lag("s1").over(order).alias("p1"), F.lag("s2").over(order).alias("p2"), F.lead("depth").over(order).isNull().alias("ends"), near.alias("near"))
    inside = F.col("depth") % height + 1
    return rows.withColumn("above", F.slice("near", -inside, inside)).drop("near")


def nodes(paths: DataFrame) -> DataFrame:
    """depth, s1, s2, n_convs, n_ends, and of the smallest member conv_id, p1, p2, chars, above."""
    least = F.min(F.struct("conv_id", "p1", "p2", "chars", "above")).alias("least")
    return paths.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.count(F.when(F.col("ends"), 1)).alias("n_ends"), least).select(*KEY, "n_convs", "n_ends", "least.*")


def band_totals(band: DataFrame, roots: DataFrame | None, last: int) -> DataFrame:
    """The nodes of a band with n_children, n_leaves and saved_tokens. roots: totals of those of the band below, whose parents have depth `last`."""
    own = band.withColumn("leaves", (F.col("n_ends") == F.col("n_convs")).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")).withColumn("below", F.lit(0).cast("long"))
    if roots is not None:
        under = roots.groupBy(F.col("p1").alias("s1"), F.col("p2").alias("s2")).agg(F.count("*").alias("x_below"), F.sum("n_leaves").alias("x_leaves"), F.sum("saved_tokens").alias("x_saved")).withColumn("depth", F.lit(last))
        own = own.join(under, KEY, "left")
        for c in ("below", "leaves", "saved"):
            own = own.withColumn(c, F.col(c) + F.coalesce(f"x_{c}", F.lit(0)))
    itself = F.col("up") == 0
    at = own.select(F.posexplode(F.reverse("above")).alias("up", "at"), F.col("depth").alias("from_depth"), "leaves", "saved", "below", "n_convs", "conv_id", "p1", "p2")
    at = at.select((F.col("from_depth") - F.col("up")).alias("depth"), "at.*", "leaves", "saved", F.when(itself, F.col("below")).when(F.col("up") == 1, 1).otherwise(0).alias("children"), *(F.when(itself, F.col(c)).alias(c) for c in ("n_convs", "conv_id", "p1", "p2")))
    return at.groupBy(*KEY).agg(F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), *(F.max(c).alias(c) for c in ("n_convs", "conv_id", "p1", "p2")))


def _batches(rows: Iterator[tuple], names: list[str], size: int = 1000) -> Iterator[pa.RecordBatch]:
    """Rows as they come, some at a time."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size or len(row[-1]) > 1 << 16:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names=names)


def _pack(batches):
    """Sorted (depth, s1, s2, conv_id) as pieces: ids of one node in order, comma-joined."""

    def pieces():
        for key, rows in groupby((row for batch in batches for row in zip(*(x.to_pylist() for x in batch.columns))), key=lambda row: row[:3]):
            for ids in batched((row[3] for row in rows), PIECE):
                yield *key, ids[0], ",".join(map(str, ids)).encode()

    return _batches(pieces(), [*KEY, "first", "ids"])


def _digest(batches):
    """Sorted pieces as one digest of each node, a piece at a time."""

    def digests():
        for key, rows in groupby((row for batch in batches for row in zip(*(x.to_pylist() for x in batch.columns))), key=lambda row: row[:3]):
            state = sha256(next(rows)[4])
            for row in rows:
                state.update(b"," + row[4])
            yield *key, state.hexdigest()

    return _batches(digests(), [*KEY, "ends_sha256"])


def ends_digest(paths: DataFrame) -> DataFrame:
    """depth, s1, s2, ends_sha256 of the nodes at which conversations end."""
    ends = paths.where("ends").select(*(F.col(c).cast("long") for c in KEY), "conv_id")
    key = "depth long, s1 long, s2 long"
    pieces = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_pack, f"{key}, first long, ids binary")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digest, f"{key}, ends_sha256 string")


def trie(turns: DataFrame, conv_ids: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, place (1, 2, ... without gaps), k1, k2, chars, as `numbered` gives
    them; conv_ids: all conversations, those without turns too, distinct. The root has
    depth 0, no parent and no text; no conversations have no root. Tables of the rounds
    are written to a new folder of the shared one, where the result reads them.
    """
    spark = tune(conv_ids.sparkSession)
    folder = f"{shared_folder(spark)}/prefix-trie-{uuid.uuid4().hex}"
    paths = prefixes(turns, conv_ids, height)
    nodes(paths).repartitionByRange(*KEY).sortWithinPartitions("depth").write.parquet(f"{folder}/nodes")
    known = spark.read.parquet(f"{folder}/nodes")
    deepest, roots = known.agg(F.max("depth")).first()[0] or 0, None
    for band in range(deepest // height, -1, -1):
        low = band * height
        totals = band_totals(known.where((F.col("depth") >= low) & (F.col("depth") < low + height)), roots, low + height - 1)
        totals.write.parquet(f"{folder}/totals/band={band}")
        roots = spark.read.parquet(f"{folder}/totals/band={band}").where(F.col("depth") == low)
    done = spark.read.schema(totals.schema).parquet(f"{folder}/totals")
    parents = done.select((F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = done.join(parents, ["depth", "p1", "p2"], "left").join(ends_digest(paths), KEY, "left")
    none = sha256(b"").hexdigest()
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def shared_prefixes(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The trie of a table of conversations (conv_id, turn, role, text) as they are."""
    turns = cut(numbered(conversations))
    return trie(turns, turns.select("conv_id").distinct(), height)
