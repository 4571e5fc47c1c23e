"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation of the centred principal axes is learned on a bounded sample so that the
signs of the rotated coordinates are balanced codes near the vectors (iterative
quantisation). The code is cut into parts, one for each table; two vectors of a label
meet in a table if their parts differ in one bit at most (one side is looked up once for
each bit that may be wrong), which finds all codes within 2 * tables - 1 bits. Pairs that
meet are ranked by the cosine of the original vectors.

A part is a little wider than the bits that number the largest label's vectors, so that
a vector meets a few others by chance, however many there are; and there are as many
tables as it takes to find FOUND of the pairs at the threshold (see layout).

Equal vectors of a label form one class first. A table's entry is dealt into blocks
of bounded size, and what leaves a pair of blocks is a count and a least link for each
vector, not the pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.common import connected_components, cut, tune

#: Rows of the sample, rounds of the quantisation, and vectors' lengths at most that get a rotation of their own.
SAMPLE, ROUNDS, LENGTHS = 4000, 30, 16
#: Share of the pairs at the threshold that shall be found; bits of a part.
FOUND, PART_BITS = 0.975, (8, 28)
#: Share of the bits in which the codes of a pair may differ before its vectors aren't compared: three times
#: what is expected at a cosine of 0.93.
FAR = 0.367
#: An entry of a table with more classes is compared in blocks of that many.
SMALL, BLOCK = 32, 256


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): a code's bits are the signs of (x - mean) @ projection, for unit vectors x.

    Vectors with fewer dimensions than bits get random directions for the others.
    """
    rng = np.random.default_rng(11)
    mean = sample.mean(0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, : min(bits, sample.shape[1])]
    v = centred @ axes
    turn, _ = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return mean, np.concatenate([axes @ turn, rng.normal(size=(sample.shape[1], bits - axes.shape[1]))], 1)


def layout(largest: int, threshold: float) -> tuple[int, int]:
    """(tables, bits of a part) for labels of up to `largest` vectors.

    A bit of two vectors at the threshold differs with a probability of angle / pi; their
    parts differ in one bit at most with p; so many tables that 1 - (1 - p) ** tables
    reaches FOUND.
    """
    width = min(max(math.ceil(math.log2(max(2, largest))) + 2, PART_BITS[0]), PART_BITS[1])
    same = 1 - math.acos(threshold) / math.pi
    p = same**width + width * (1 - same) * same ** (width - 1)
    return math.ceil(math.log(1 - FOUND) / math.log(1 - p)), width


class Code:
    """A code of tables x width bits as a few numbers, c0, c1, ...; no part is cut by their borders."""

    def __init__(self, tables: int, width: int):
        self.tables, self.width, self.per = tables, width, 63 // width
        self.names = [f"c{i}" for i in range(-(-tables // self.per))]
        self.slots = [(k // self.per, k % self.per * width) for k in range(tables)]
        self.far = int(FAR * tables * width)

    def of(self, unit: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
        """Each vector's code (rows x numbers)."""
        bits = ((unit - mean) @ projection >= 0).astype(np.int64)
        out = np.zeros((len(unit), len(self.names)), np.int64)
        for b in range(bits.shape[1]):
            i, shift = self.slots[b // self.width]
            out[:, i] |= bits[:, b] << np.int64(shift + b % self.width)
        return out

    def mask(self, k: int) -> tuple[int, int]:
        i, shift = self.slots[k]
        return i, ((1 << self.width) - 1) << shift


def usable(vec_id, vec, label) -> tuple[int, bytes, int] | None:
    """(node, vector as bytes, dimensions) of a row that can be linked, else None."""
    if vec_id is None or label is None or not vec or any(x is None for x in vec):
        return None
    a = np.array(vec, np.float64)
    if not np.isfinite(a).all() or not a.any():
        return None
    raw = (a + 0.0).tobytes()  # -0.0 is 0.0
    return int.from_bytes(hashlib.blake2b(raw + str(label).encode(), digest_size=8).digest(), "little", signed=True), raw, len(a)


def unit_rows(blobs: list[bytes]) -> np.ndarray:
    a = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    a = a / np.abs(a).max(1, keepdims=True)
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def _nodes(rows: DataFrame) -> DataFrame:
    """(vec_id, label, node, dim, vec) of every row; node null where it links with nothing."""

    def run(batches):
        for batch in batches:
            found = [usable(*r) or (None, None, None) for r in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            node, vec, dim = list(zip(*found)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node, pa.int64()), pa.array(dim, pa.int32()), pa.array(vec, pa.binary())], names=["vec_id", "label", "node", "dim", "vec"])

    return rows.mapInArrow(run, "vec_id long, label long, node long, dim int, vec binary")


def _coded(classes: DataFrame, models, code: Code) -> DataFrame:
    """(node, c0, c1, ...) of each class."""

    def run(batches):
        for batch in batches:
            dims, vec = np.array(batch.column(1).to_pylist(), int), batch.column(2).to_pylist()
            found = np.zeros((len(vec), len(code.names)), np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                found[at] = code.of(unit_rows([vec[i] for i in at]), *models.value[int(dim)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, i]) for i in range(found.shape[1]))], names=["node", *code.names])

    return classes.select("node", "dim", "vec").mapInArrow(run, "node long, " + ", ".join(f"{c} long" for c in code.names))


KEY = ["label", "dim", "slot", "part"]


def _entries(coded: DataFrame, code: Code, wrong: bool) -> DataFrame:
    """KEY, node, c0, ...: a row for each table; with wrong, also for each bit of the part that may be wrong."""
    flips = [0, *(1 << b for b in range(code.width))] if wrong else [0]
    parts = ", ".join(f"struct({k} as slot, shiftrightunsigned(c{i} & {m}L, {shift}) as part)" for k, ((i, m), (_, shift)) in enumerate(zip(map(code.mask, range(code.tables)), code.slots)))
    rows = coded.select("label", "dim", "node", *code.names, F.expr(f"explode(array({parts}))").alias("e"))
    rows = rows.select("label", "dim", F.col("e.slot").alias("slot"), F.col("e.part").alias("part"), "node", *code.names)
    if not wrong:
        return rows
    return rows.withColumn("flip", F.explode(F.array(*(F.lit(f).cast("long") for f in flips)))).withColumn("part", F.expr("part ^ flip")).drop("flip")


def _blocks(df: DataFrame, name: str, code: Code) -> DataFrame:
    size = df.groupBy(*KEY).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = df.join(size, KEY).withColumn("block", F.expr("pmod(xxhash64(node), blocks)"))
    return dealt.groupBy(*KEY, "block").agg(F.collect_list(F.struct("node", "copies", "vec", *code.names)).alias(name)).drop("block")


def _links(classes: DataFrame, threshold: float, code: Code) -> DataFrame:
    """(a, n, b): links found; n adds up to the rows linked with class a, the (a, b) connect what is linked."""
    index, probes = _entries(classes, code, False), _entries(classes, code, True)
    sizes = index.groupBy(*KEY).agg(F.count("*").alias("n"))
    sized = index.join(sizes, KEY)
    x, y = probes.alias("x"), sized.where(F.col("n") <= SMALL).alias("y")
    differ = " + ".join(f"bit_count(x.{c} ^ y.{c})" for c in code.names)
    # a pair counts in the first table where its parts differ in one bit at most
    masks = [code.mask(k) for k in range(code.tables)]
    first = " and ".join([f"(x.slot <= {k} or bit_count((x.c{i} ^ y.c{i}) & {m}L) > 1)" for k, (i, m) in enumerate(masks[:-1])] or ["true"])
    pairs = x.join(y, KEY).where(f"x.node <> y.node and {differ} <= {code.far} and {first}").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    def cosines(batches):
        for batch in batches:
            if batch.num_rows:
                u, v = (batch.column(k).to_pylist() for k in (2, 3))
                sizes, cosine = np.array(list(map(len, u))), np.zeros(len(u))
                for size in np.unique(sizes):  # rows of one length at a time
                    at = np.flatnonzero(sizes == size)
                    cosine[at] = (unit_rows([u[i] for i in at]) * unit_rows([v[i] for i in at])).sum(1)
                ok = pa.array(cosine >= threshold)
                yield pa.RecordBatch.from_arrays([c.filter(ok) for c in (batch.column(0), batch.column(4), batch.column(1))], names=["a", "n", "b"])

    own = classes.select("node", "vec", "copies")
    full = pairs.join(own.select(F.col("node").alias("a"), F.col("vec").alias("u")), "a").join(own.select(F.col("node").alias("b"), F.col("vec").alias("v"), "copies"), "b")
    few = full.select("a", "b", "u", "v", "copies").mapInArrow(cosines, "a long, n long, b long")

    def compare(batches):
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                slot, x, y = (batch.column(c)[k].as_py() for c in range(3))
                nx, ny = (np.array([r["node"] for r in s], np.int64) for s in (x, y))
                apart = [np.array([r[c] for r in x], np.int64)[:, None] ^ np.array([r[c] for r in y], np.int64) for c in code.names]
                linked = (unit_rows([r["vec"] for r in x]) @ unit_rows([r["vec"] for r in y]).T >= threshold) & (nx[:, None] != ny)
                linked &= sum(np.bitwise_count(d).astype(np.int32) for d in apart) <= code.far
                for i, m in masks[:slot]:
                    d = apart[i] & m
                    linked &= (d & (d - 1)) != 0
                copies, owner = np.array([r["copies"] for r in y], np.int64), np.full(len(y), -1)
                for i in np.flatnonzero(linked.any(1)):
                    js = np.flatnonzero(linked[i])
                    # one partner of each row that has come to own partners, and those that none owns yet
                    _, at = np.unique(owner[js], return_index=True)
                    via = set(js[at].tolist()) | set(js[owner[js] < 0].tolist())
                    owner[js[owner[js] < 0]] = i
                    rows += [(int(nx[i]), int(copies[js].sum()) if not n else 0, int(ny[j])) for n, j in enumerate(sorted(via))]
            a, n, b = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "n": pa.array(n, pa.int64()), "b": pa.array(b, pa.int64())})

    large = sizes.where(F.col("n") > SMALL)
    left = probes.join(large.select(KEY), KEY).join(own, "node")
    right = index.join(large.select(KEY), KEY).join(own, "node")
    many = _blocks(left, "x", code).join(_blocks(right, "y", code), KEY).select("slot", "x", "y").repartition(parallel(classes)).mapInArrow(compare, "a long, n long, b long")
    return few.unionByName(many)


def parallel(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism * 4


def dedup(vectors: DataFrame, threshold: float = 0.93, tables: int | None = None, width: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors.

    Vectors are linked if their labels are equal and not null and their cosine, in double
    precision, is at least the threshold (all links found have it; a few of those there
    are may not be found). n_links counts the other rows linked directly; component_id is
    the smallest id reachable. Vectors that are null, empty, zero, or hold null or
    non-finite components, and rows without an id, link with nothing (a null id has a null
    component and is kept). Vectors of unequal length don't link. Repeated rows are linked
    with each other. The rotation is learned, for each length, on SAMPLE vectors at most,
    in the order of a hash. Other columns are not read.
    """
    tune(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("long").alias("label"))
    named = cut(_nodes(rows))
    classes = cut(named.where("node is not null").groupBy("node", "label", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")))
    sizes = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    code = Code(*((tables, width) if tables and width else layout(sizes, threshold)))
    models, bits = {}, code.tables * code.width
    lengths = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).select("dim")
    nth = F.row_number().over(Window.partitionBy("dim").orderBy("order", "node"))
    drawn = classes.join(F.broadcast(lengths), "dim").select("dim", "node", F.xxhash64("node").alias("order"), "vec").withColumn("nth", nth).where(F.col("nth") <= SAMPLE)
    samples: dict[int, list[bytes]] = {}
    for r in drawn.select("dim", "vec").collect():  # LENGTHS * SAMPLE rows at most
        samples.setdefault(r.dim, []).append(bytes(r.vec))
    for dim, vec in samples.items():
        models[dim] = learn_rotation(unit_rows(sorted(vec)), bits)
    # vectors of rarer lengths have no principal axes; random directions serve
    for r in classes.select("dim").distinct().join(F.broadcast(lengths), "dim", "left_anti").collect():
        models[r.dim] = (np.zeros(r.dim), np.random.default_rng(11).normal(size=(r.dim, bits)))
    coded = cut(classes.join(_coded(classes, rows.sparkSession.sparkContext.broadcast(models), code), "node"))
    links = cut(_links(coded, threshold, code))
    counts = links.groupBy("a").agg(F.sum("n").alias("others"))
    components = cut(connected_components(links.select("a", "b")))
    low = components.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    table = classes.join(counts, F.col("node") == F.col("a"), "left").join(components, "node", "left").join(low, "component", "left")
    table = table.select("node", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = named.select("vec_id", "node").join(table, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
