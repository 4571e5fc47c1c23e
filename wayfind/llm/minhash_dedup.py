"""Near-duplicates of documents by a multi-index Hamming join of MinHash signatures.

Documents with equal shingle sets form a class. A class has a signature of CHUNKS x
WIDTH MinHash values of 16 bits. Classes meet if one of the chunks differs in one value
at most: each chunk is looked up once for each value that may be wrong, by the others.
By the pigeonhole principle that finds all pairs whose signatures differ in fewer than
2 * CHUNKS values (27 of 70; at a similarity of 0.8, 14 are expected), and far more
often than not those beyond. All links are confirmed on the full sets.

A bucket of up to SMALL classes gives all its pairs. In larger ones each class is
first compared with the nearest of their central classes (linear in their sizes). Where its classes then still fall
into several components, those outside its main component are compared, in blocks, with
all members of that component and with each other, so that no link between components
is lost, and no group is ever paired within itself or gathered in one task.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.common import broadcast_if_small, connected_components, cut, fresh, tune
from wayfind.llm.wordhash import WordHash, mix, shingle_set

CHUNKS, WIDTH = 14, 5
#: Values in which the signatures of a pair may differ before its sets aren't compared: at a similarity
#: of 0.8 the mean is 14 and the deviation 3.35, so that 35 is over six deviations away.
FAR = 35
#: Classes of a bucket of which all pairs are taken; classes and bytes of a block.
SMALL, BLOCK, BLOCK_BYTES = 8, 512, 1 << 19
#: Documents whose texts are looked up by a broadcast of their ids at most; beyond it the join is shuffled.
BROADCAST_IDS = 500_000
#: Central classes that a class of large buckets is first compared with: those nearest by signature.
PIVOTS = 2

_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 2**32, CHUNKS * WIDTH, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, CHUNKS * WIDTH, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The MinHash values (16 bits of each minimum) of a set of 64-bit shingles."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 4096):
        np.minimum(low, (h[at : at + 4096, None] * _A + _B).min(0), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature, a key for each chunk and each of its values left out (rows x CHUNKS * WIDTH)."""
    s = signatures.reshape(len(signatures), CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty((len(s), CHUNKS, WIDTH), np.uint64)
    for left_out in range(WIDTH):
        key = np.zeros((len(s), CHUNKS), np.uint64)
        for j in range(WIDTH):
            if j != left_out:
                key = (key << np.uint64(16)) | s[:, :, j]
        out[:, :, left_out] = mix(key) ^ mix(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(left_out + 1))
    return out.reshape(len(s), -1)


def binary(arrays) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _hash_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, digest, node, signature of each row (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("node", pa.int64()), ("signature", pa.binary())])

    def run(batches):
        known = WordHash()
        for batch in batches:
            counts, digests, nodes, signatures = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(known.array((text or "").encode("utf-8", "surrogatepass").lower().split()), shingle)
                digest = blake2b(s.tobytes(), digest_size=16).digest()
                counts.append(len(s))
                digests.append(digest)
                nodes.append(int.from_bytes(digest[:8], "little", signed=True))
                signatures.append(signature(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(nodes, pa.int64()), pa.array(signatures, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, node long, signature binary")


def _keys(classes: DataFrame) -> DataFrame:
    """(node, key) of each class (node, signature)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                keys = chunk_keys(s)
                yield pa.RecordBatch.from_pydict({"node": pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1])), "key": pa.array(keys.ravel().view(np.int64))})

    return classes.select("node", "signature").mapInArrow(run, "node long, key long")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the wanted (node, rep): the sets of the representatives' texts."""

    def run(batches):
        known = WordHash()
        for batch in batches:
            sets = [shingle_set(known.array((t or "").encode("utf-8", "surrogatepass").lower().split()), shingle) for t in batch.column(0).to_pylist()]
            nodes = [int.from_bytes(blake2b(s.tobytes(), digest_size=16).digest()[:8], "little", signed=True) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), binary(sets)], names=["node", "shingles"])

    wanted = cut(wanted.select("node", "rep"))
    texts = docs.join(broadcast_if_small(wanted.select(F.col("rep").alias("doc_id")), wanted.count(), BROADCAST_IDS), "doc_id", "left_semi")
    found = texts.select("text").mapInArrow(run, "node long, shingles binary")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on sorted distinct shingles."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b, star) whose signatures differ in FAR values at most, and in how many (differ)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (3, 4))
                differ = (x != y).sum(1)
                ok = pa.array(differ <= FAR)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(ok) for k in range(3)), pa.array(differ, pa.int32()).filter(ok)], names=["a", "b", "star", "differ"])

    s = classes.select("node", "signature")
    full = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b")
    return full.select("a", "b", "star", "sa", "sb").mapInArrow(run, "a long, b long, star boolean, differ int")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links by their full sets."""

    def run(batches):
        for batch in batches:
            ok = pa.array([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    full = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _across(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Links between blocks: left and right have (home, node, component, signature, shingles).

    Rows of a home are dealt by hash into blocks of about BLOCK rows and BLOCK_BYTES at most; each left block meets
    each right block of its home, and only pairs of different components are compared.
    A left row gives one link for each other component it is linked with.
    """

    def blocks(df: DataFrame, side: str) -> DataFrame:
        most = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("shingles")) / BLOCK_BYTES))
        size = df.groupBy("home").agg(most.alias("n"))
        dealt = df.join(size, "home").withColumn(f"{side}_block", F.expr("pmod(xxhash64(node), n)"))
        return cut(dealt.groupBy("home", f"{side}_block").agg(F.collect_list(F.struct("node", "component", "signature", "shingles")).alias(side)))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                sx, sy = (np.frombuffer(b"".join(r["signature"] for r in rows), np.uint16).reshape(len(rows), -1) for rows in (x, y))
                flat = np.frombuffer(b"".join(r["shingles"] for r in y), np.uint64)
                sizes = np.array([len(r["shingles"]) // 8 for r in y])
                starts = np.cumsum(sizes) - sizes
                component = np.array([r["component"] for r in y])
                found = []
                for r, s in zip(x, sx):
                    open_ = np.flatnonzero(((sy != s).sum(1) <= FAR) & (component != r["component"]))
                    if len(open_):
                        own = np.frombuffer(r["shingles"], np.uint64)
                        common = np.add.reduceat(own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat, starts)[open_]
                        linked = open_[100 * common >= percent * (len(own) + sizes[open_] - common)]
                        _, one = np.unique(component[linked], return_index=True)
                        found += [(r["node"], y[j]["node"]) for j in linked[one]]
                yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    xs, ys = blocks(left, "x"), blocks(right, "y")
    meet = xs.select("home", "x_block").join(ys.select("home", "y_block"), "home")
    met = meet.join(xs, ["home", "x_block"]).join(ys, ["home", "y_block"])
    return met.select("x", "y").mapInArrow(run, "a long, b long")


def link_classes(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, component) of the classes (node, rep, n_shingles, signature) that have links."""
    # sets of fewer shingles reach the similarity only if they are equal
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
    linkable = classes.where(F.col("n_shingles") >= least)
    keys = _keys(linkable)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keys.join(sizes, "key").select("key", "node", "n"))

    listed = shared.where(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("v"))
    small = listed.select(F.explode(F.flatten(F.transform("v", lambda x, i: F.transform(F.slice("v", i + 2, F.lit(SMALL)), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.a", "p.b")
    large = shared.where(F.col("n") > SMALL)
    centre = large.groupBy("node").agg(F.sum("n").alias("weight"))
    pivots = large.join(centre, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).getField("node").alias("b"))
    star = large.join(pivots, "key").select(F.col("node").alias("a"), "b").where("a <> b")
    # both kinds go through the same joins: each would otherwise be shuffled by itself
    near = _near(small.withColumn("star", F.lit(False)).unionByName(star.withColumn("star", F.lit(True))).distinct(), linkable)
    nearest = near.withColumn("rank", F.row_number().over(Window.partitionBy("a", "star").orderBy("differ", "b"))).where(~F.col("star") | (F.col("rank") <= PIVOTS))
    pairs = cut(nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets(docs, classes.join(ends, "node", "left_semi"), shingle)
    components = cut(connected_components(_confirmed(pairs, sets, percent)))

    member = large.select("key", "node").join(components, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    main = member.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "component")).getField("component").alias("home"), F.count("*").alias("parts")).where("parts > 1")
    strays = cut(member.join(main, "key").where("component <> home").select("home", "node", "component").distinct())
    if strays.isEmpty():
        return components
    homes = strays.select("home").distinct()
    rest = components.join(homes, F.col("component") == F.col("home")).select("home", "node", "component")
    alone = homes.join(components.select(F.col("component").alias("home")).distinct(), "home", "left_anti").select("home", F.col("home").alias("node"), F.col("home").alias("component"))
    # each kept once: both sides of the blocks are made of them
    sides = cut(strays.unionByName(rest).unionByName(alone).distinct())
    wanted = classes.join(sides.select("node"), "node", "left_semi")
    full = cut(wanted.select("node", "signature").join(_sets(docs, wanted, shingle), "node"))
    more = cut(_across(strays.join(full, "node"), sides.join(full, "node"), percent))
    if more.isEmpty():
        return components
    return connected_components(components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Words are runs of anything but ASCII white space, A-Z in lower case; shingles are
    `shingle` consecutive words. Documents are linked where 100 * intersection >=
    percent * union. component_id is the smallest id reachable, kept says that it is the
    row's own. Texts that are null or have no word are linked with nothing. A null id is
    linked with nothing, has a null component and is kept. Repeated rows give repeated
    rows, of one component. Other columns are not read.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashed = cut(_hash_sets(rows, shingle))
    usable = hashed.where("doc_id is not null and n_shingles > 0")
    classes = cut(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("node").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.count("*").alias("copies")))
    linked = cut(link_classes(rows, classes, shingle, percent))
    low = linked.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    found = linked.join(low, "component").select("node", "component_id")
    several = classes.where("copies > 1").join(found.select("node"), "node", "left_anti").select("node", F.col("rep").alias("component_id"))
    by_node = found.unionByName(several)
    has = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = hashed.select("doc_id", "n_shingles", F.when(has, F.col("node")).alias("node")).join(by_node, "node", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs with one document of each group of near-duplicates: that of the smallest id.

    Of several rows of one id the one of the smallest text hash stays, so that a task that
    runs again chooses alike. Rows without an id stay. All columns unchanged.
    """
    gone = dedup(docs, shingle, percent).where("not kept").select("doc_id").distinct()
    nth = fresh(docs, "nth")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(F.col("text").cast("string")))
    left = docs.where(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti").withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1)
    return left.select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull())).select(docs.columns)
