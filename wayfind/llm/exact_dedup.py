"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Every partition sorts the fingerprints of its texts, keeps one of each, and sends
   each owner (a range of fingerprints) its part of them as one Golomb code: about
   log2(range / entries) + 1.5 bits for a distinct text, and nothing else.
2. An owner finds what several partitions have and answers each with a bitmap: one bit
   for each of the entries that it was sent.
3. A partition adds what it has several times itself; the entries marked are suspects.
   A fingerprint is so short (log2 of the rows, and EXTRA bits more) that about one text
   in 2 ** EXTRA is suspected for nothing.
4. Only texts of suspects are shuffled and compared byte by byte: they are grouped by
   hash and text, with a partial aggregation in each task, so that a text that a third
   of all rows have leaves each task once.

A row finds its class by a 64-bit hash and the SHA-256 of its text. What is broadcast is
measured; beyond BROADCAST_BYTES the join is shuffled, and Spark may split its skew.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm import golomb
from wayfind.llm.common import broadcast_if_small, cut, tune

#: Bits of a fingerprint beyond those that number the rows.
EXTRA = 10
#: Rows that a partition sorts at once; rows whose fingerprints one owner gets.
FLUSH, OWNED = 1 << 20, 1 << 22
#: Bytes of suspects, or of classes, that are broadcast at most.
BROADCAST_BYTES = 32 << 20

SENT = "owner long, flush long, n long, unary binary, rest binary, repeated binary"
ANSWER = "owner long, flush long, marks binary"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def as_batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if kind == "long" else pa.binary()) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def bits_of(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def suspects(hashes: DataFrame, rows: int, flush_rows: int = FLUSH, owned: int = OWNED, extra: int = EXTRA) -> tuple[DataFrame, int]:
    """(fp) of more than one row, distinct; and how far fp is h shifted right. hashes: h long; rows: how many there are."""
    bits = min(64, math.ceil(math.log2(max(rows, 2))) + extra)
    owner_bits = max(4, math.ceil(math.log2(max(rows / owned, 1))))
    shift, inner = 64 - bits, bits - owner_bits
    cut_off = np.uint64((1 << inner) - 1)

    def lists(h: np.ndarray, flush: int) -> pa.RecordBatch:
        fp, count = np.unique(h.view(np.uint64) >> np.uint64(shift), return_counts=True)
        edges = np.searchsorted(fp >> np.uint64(inner), np.arange((1 << owner_bits) + 1, dtype=np.uint64))
        out = []
        for k in np.flatnonzero(np.diff(edges)).tolist():
            own, n = slice(edges[k], edges[k + 1]), int(edges[k + 1] - edges[k])
            out.append((k, flush, n, *golomb.encode(fp[own] & cut_off, golomb.rest_bits(n, inner)), np.packbits(count[own] > 1).tobytes()))
        return as_batch(SENT, out)

    def send(batches):
        held, size, number, part = [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            size += len(held[-1])
            if size >= flush_rows:
                yield lists(np.concatenate(held), (part << 32) + number)
                held, size, number = [], 0, number + 1
        if size:
            yield lists(np.concatenate(held), (part << 32) + number)

    def answer(table: pa.Table) -> pa.Table:
        got = [(r["owner"], r["flush"], golomb.decode(r["unary"], r["rest"], r["n"], golomb.rest_bits(r["n"], inner))) for r in table.to_pylist()]
        fp, place, count = np.unique(np.concatenate([x for *_, x in got]), return_inverse=True, return_counts=True)
        marks = np.split((count > 1)[place], np.cumsum([len(x) for *_, x in got])[:-1])
        return pa.Table.from_batches([as_batch(ANSWER, [(k, flush, np.packbits(m).tobytes()) for (k, flush, _), m in zip(got, marks) if m.any()])])

    def marked(batches):
        for batch in batches:
            for r in batch.to_pylist():
                own = bits_of(r["repeated"], r["n"])
                own |= bits_of(r["marks"], r["n"]) if r["marks"] else False
                if own.any():
                    fp = golomb.decode(r["unary"], r["rest"], r["n"], golomb.rest_bits(r["n"], inner))[own] + (np.uint64(r["owner"]) << np.uint64(inner))
                    yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64))], names=["fp"])

    # written once: both directions of the exchange must see the same flushes
    sent = cut(hashes.select("h").mapInArrow(send, SENT))
    answers = sent.select("owner", "flush", "n", "unary", "rest").groupBy("owner").applyInArrow(answer, ANSWER)
    back = sent.join(answers, ["owner", "flush"], "left").select("owner", "n", "unary", "rest", "repeated", "marks")
    return back.mapInArrow(marked, "fp long").distinct(), shift


def classes(docs: DataFrame, flush_rows: int = FLUSH, owned: int = OWNED, extra: int = EXTRA) -> DataFrame:
    """h, text_sha256, keep_id, group_size of the normalised texts that several rows have. docs: doc_id (long, not null), text, h (xxhash64 of the text)."""
    found, shift = suspects(docs, docs.count(), flush_rows, owned, extra)
    found = cut(found)
    met = docs.withColumn("fp", F.shiftrightunsigned("h", shift)).join(broadcast_if_small(found, found.count() * 8, BROADCAST_BYTES), "fp", "left_semi")
    same = met.groupBy("h", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    return same.select("h", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", flush_rows: int = FLUSH, owned: int = OWNED, extra: int = EXTRA) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs.

    Texts are equal when they are so after each run of ASCII white space has become one
    space; a null text is empty. Of equal texts the smallest id stays, and all rows with
    it: a row that repeats id and text of the one that stays is counted in group_size and
    is kept too. A row without an id is equal to nothing. Other columns are not read.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col).cast("string")).alias("text")).withColumn("h", F.when(F.col("doc_id").isNotNull(), F.xxhash64("text")))
    same = cut(classes(rows.where("doc_id is not null"), flush_rows, owned, extra))
    out = rows.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256")).join(broadcast_if_small(same, same.count() * 96, BROADCAST_BYTES), ["h", "text_sha256"], "left")
    keep = F.coalesce("keep_id", "doc_id")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")

