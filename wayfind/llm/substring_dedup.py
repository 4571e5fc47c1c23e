"""Exact substring deduplication by fixed-block anchors.

A window of WINDOW words holds a whole block of BLOCK words at a fixed place of its
document (a multiple of BLOCK), wherever it begins. So all blocks at fixed places are
the index, every rolling window of BLOCK words is a probe, and each repeated passage is
hit. Around the hits, windows of WINDOW words are then compared, and overlapping
repeated ones give the maximal repeats.

Both comparisons are grouped by hash: a map task sorts the hashes of some million words
(a flush), keeps one entry for each distinct one (that of its smallest document; so a
very common passage weighs no more than a rare one), and packs the entries by range of
the hash; a reduce task compares one range of all flushes. An entry names its words by
their place in the flush, four bytes whatever the range; the flush's list of documents
travels once, and what the ranges found returns to it, where places become spans of
documents. A probe's entry has no document at all: it only has to know that another
flush has the hash too.

Windows are compared by 64 bits of a hash. Of M windows around hits, M ** 2 / 2 ** 65
pairs of different ones are expected to clash: one for six billion, a share of 3e-7 at
10 ** 13.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import cut, tune
from wayfind.llm.wordhash import PRIME, WordHash, mix, windows

WINDOW, BLOCK = 13, 7
#: Words that a map task sorts at once, and entries of a range.
FLUSH, RANGE = 1_500_000, 1_500_000

#: Entries of a range of hashes (part from 0), or the documents of a flush with what it found itself (part below 0).
PACKED = "part long, flush long, n long, hashes binary, places binary, docs binary, flags binary, texts binary, ends binary"
#: What a range, or the flush itself, has found in a flush: spans of its places; its documents once.
FOUND = "flush long, spans binary, docs binary, texts binary, ends binary"
SPANS = "doc_id long, text_key long, spans binary"


def planes(a: np.ndarray) -> bytes:
    """An array byte plane by byte plane: small or slowly growing numbers compress well that way."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def from_planes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def steps(a: np.ndarray) -> bytes:
    """A sequence that mostly grows, as planes of its differences."""
    return planes(np.diff(a, prepend=a.dtype.type(0)))


def from_steps(b: bytes, kind) -> np.ndarray:
    return np.cumsum(from_planes(b, kind), dtype=kind)


def to_spans(places: np.ndarray, width: int = 1) -> np.ndarray:
    """Sorted places (each the begin of `width` words) as begins and ends of maximal runs, interleaved."""
    if not len(places):
        return np.zeros(0, np.uint32)
    cut_at = np.flatnonzero(places[1:] > places[:-1] + width)
    begins, ends = np.concatenate([places[:1], places[cut_at + 1]]), np.concatenate([places[cut_at], places[-1:]]) + width
    return np.stack([begins, ends], 1).astype(np.uint32).ravel()


def from_spans(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the runs cover."""
    change = np.bincount(np.minimum(spans[0::2], n), minlength=n + 1) - np.bincount(np.minimum(spans[1::2], n), minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def windows_within(words: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and begins of the windows of some texts' words in a row that lie within one text. ends: where each ends."""
    h = windows(words, width)
    place = np.flatnonzero(np.arange(len(h)) + width <= np.repeat(ends, np.diff(ends, prepend=0))[: len(h)])
    return h[place], place


def grow(h: np.ndarray, owner: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Also mark the places whose hash and owner are those of a marked one: an entry stands for all places of its document."""
    if not marked.any():
        return marked
    key = mix(h ^ (owner.astype(np.uint64) + np.uint64(1)) * PRIME)
    return np.isin(key, key[marked])


class Flush:
    """Words of some documents, whose windows are sorted, cut down to one entry a hash, and packed."""

    def __init__(self, ranges: int, width: int, block: int | None):
        """width: of the windows that are compared. block: None for the probes, else hits on blocks are extended."""
        self.ranges, self.width, self.block = ranges, width, block
        self.docs: dict[tuple[int, int], None] = {}
        self.words: list[np.ndarray] = []
        self.hits: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: int, text_key: int, words: np.ndarray, hits: np.ndarray | None = None) -> None:
        """hits: spans of the places that were hit. A row that is there already adds nothing."""
        if len(words) >= self.width and (doc, text_key) not in self.docs:
            self.docs[doc, text_key] = None
            self.words.append(words)
            if hits is not None:
                self.hits.append(hits)
            self.size += len(words)

    def _entries(self, words: np.ndarray, ends: np.ndarray, order: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, places and flags (an indexed block) of the windows to compare."""
        begins = ends - np.diff(ends, prepend=0)
        if self.block is None:
            h, place = windows_within(words, ends, self.width)
            return h, place, (place - begins[np.searchsorted(ends, place, "right")]) % self.width == 0
        spans = joined([self.hits[i] + np.uint32(begins[k]) for k, i in enumerate(order)], np.uint32)
        small = windows(words, self.block)
        hit = from_spans(spans, len(small))
        if hit.any():
            hit = np.isin(small, small[hit])
        h, place = windows_within(words, ends, self.width)
        # a window holds width - block + 1 probes
        seen = np.concatenate([[0], np.cumsum(hit)])
        near = seen[place + self.width - self.block + 1] - seen[place] > 0
        return h[near], place[near], np.ones(int(near.sum()), bool)

    def pack(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        docs = list(self.docs)
        order = sorted(range(len(docs)), key=docs.__getitem__)
        doc, text = np.array([docs[i] for i in order], np.int64).T
        words, ends = np.concatenate([self.words[i] for i in order]), np.cumsum([len(self.words[i]) for i in order])
        h, place, flag = self._entries(words, ends, order)
        # by what it holds, so that a task that runs again names it alike
        number = xxhash.xxh3_64_intdigest(doc.tobytes() + text.tobytes() + ends.tobytes()) - (1 << 63)
        who = np.searchsorted(ends, place, "right")
        ids = doc[who]
        several = len(np.unique(doc)) < len(doc)
        by_hash = np.argsort(h, kind="stable" if several else None)
        s = h[by_hash]
        new = np.concatenate([[True], s[1:] != s[:-1]])[: len(s)]
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        if not len(h):
            return
        first = np.minimum.reduceat(by_hash, start)  # of each hash the entry of the smallest document; places are in their order
        flag = np.maximum.reduceat(flag[by_hash], start)
        more = ids[by_hash] > ids[first][group]
        if several:  # each text of the smallest document has an entry of its own
            w = who[by_hash]
            also = ~more & ~new & np.concatenate([[False], w[1:] != w[:-1]])
            first, flag = np.concatenate([first, by_hash[also]]), np.concatenate([flag, flag[group[also]]])
        if self.block is None:  # hit, if the hash is in two documents and one of its places is indexed
            more = (np.maximum.reduceat(more, start) & flag[: len(start)])[group]
        here = to_spans(place[np.sort(by_hash[more])])
        rows = [(-1 - (number & 0x7FFFFFFFFFFFFFFF), number, 0, b"", steps(here), steps(doc), b"", planes(np.ascontiguousarray(text)), steps(ends))]
        part = (h[first] >> np.uint64(32)) * np.uint64(self.ranges) >> np.uint64(32)
        by_part = np.lexsort((first, part))  # in a range by place again
        edges = np.searchsorted(part[by_part], np.arange(self.ranges + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            e = by_part[edges[k] : edges[k + 1]]
            at = first[e]
            if self.block is None:
                rows.append((k, number, len(at), h[at].astype(np.uint32).tobytes(), steps(place[at].astype(np.uint32)), b"", np.packbits(flag[e]).tobytes(), b"", b""))
            else:
                rows.append((k, number, len(at), h[at].tobytes(), steps(place[at].astype(np.uint32)), steps(ids[at]), b"", b"", b""))
            if len(rows) >= 256:
                yield as_batch(rows, PACKED)
                rows = []
        yield as_batch(rows, PACKED)


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if kind == "long" else pa.binary()) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def _compare(later_only: bool):
    """One range of hashes: the places whose hash other flushes have too, by flush.

    later_only: only those of documents that aren't the hash's smallest; else all, if one
    of the hash's places is that of an indexed block.
    """

    def run(table: pa.Table) -> pa.Table:
        rows, out = table.to_pylist(), []
        out += [(r["flush"], r["places"], r["docs"], r["texts"], r["ends"]) for r in rows if r["part"] < 0]
        rows = [r for r in rows if r["part"] >= 0]
        if rows:
            h = np.concatenate([np.frombuffer(r["hashes"], np.uint64 if later_only else np.uint32) for r in rows])
            sizes = np.array([r["n"] for r in rows])
            by_hash = np.argsort(h)
            s = h[by_hash]
            new = np.concatenate([[True], s[1:] != s[:-1]])
            start, group = np.flatnonzero(new), np.cumsum(new) - 1
            if later_only:
                ids = np.concatenate([from_steps(r["docs"], np.int64) for r in rows])[by_hash]
                hit = ids > np.minimum.reduceat(ids, start)[group]
            else:
                flag = np.concatenate([np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=r["n"]) for r in rows])[by_hash]
                hit = ((np.diff(start, append=len(s)) > 1) & (np.maximum.reduceat(flag, start) > 0))[group]
            found = np.zeros(len(h), bool)
            found[by_hash[hit]] = True
            for r, b in zip(rows, np.split(found, np.cumsum(sizes)[:-1])):
                if b.any():
                    out.append((r["flush"], steps(to_spans(from_steps(r["places"], np.uint32)[b])), b"", b"", b""))
        return pa.Table.from_batches([as_batch(out, FOUND)])

    return run


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans in any order as sorted spans that don't meet."""
    pairs = spans.reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0])]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > reach[:-1]]))
    return np.stack([pairs[new, 0], reach[np.append(new[1:] - 1, len(pairs) - 1)]], 1)


def _by_document(table: pa.Table) -> pa.Table:
    """A flush: one row for each of its documents that was hit, with its spans."""
    rows = table.to_pylist()
    spans = joined([from_steps(r["spans"], np.uint32) for r in rows], np.uint32)
    out = []
    if len(spans):
        own = next(r for r in rows if r["docs"])
        docs, texts, ends = from_steps(own["docs"], np.int64), from_planes(own["texts"], np.int64), from_steps(own["ends"], np.int64)
        pairs = merged(spans).astype(np.int64)  # no span reaches over a document's end, as no window begins just before it
        who = np.searchsorted(ends, pairs[:, 0], "right")
        pairs -= np.where(who > 0, ends[who - 1], 0)[:, None]
        at = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        for k, own_pairs in zip(who[at].tolist(), np.split(pairs.astype(np.uint32), at[1:])):
            out.append((int(docs[k]), int(texts[k]), own_pairs.tobytes()))
    return pa.Table.from_batches([as_batch(out, SPANS)])


def _spans_of(packed: DataFrame, later_only: bool) -> DataFrame:
    """(doc_id, text_key, spans) from the packed windows of all map tasks: one row for each text of an id, with the distinct spans of its copies."""
    found = packed.groupBy("part").applyInArrow(_compare(later_only), FOUND).groupBy("flush").applyInArrow(_by_document, SPANS)
    return found.groupBy("doc_id", "text_key").agg(F.collect_set("spans").alias("spans"))


def _with_spans(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    return docs.join(spans, ["doc_id", "text_key"], how).select("doc_id", "text_key", "text", "spans")


def remove_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, with_text: bool = False, flush_words: int = FLUSH, range_entries: int = RANGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the remaining words) for each row of docs.

    Words are runs of anything but ASCII white space. A word is removed where a window of
    `window` words covers it whose words also start in a document of a smaller id; all
    windows are judged on the input. block: 2 * block <= window + 1. A null text has no
    words. A row without an id is never shortened and shortens no other. Repeated rows
    give as many rows and don't shorten each other. Other columns are not read. Two texts
    of one id are told apart, and windows compared, by 64 bits of a hash: one wrong
    removal is expected among six billion windows around hits. docs
    should be read from files (or a checkpoint): a task that runs again after a lost
    executor must see its rows in the same order.
    """
    if 2 * block > window + 1:
        raise ValueError("a window must hold a whole block wherever it begins")
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    usable = rows.where("doc_id is not null and text is not null").select("doc_id", "text_key", "text")
    # about the number of words; it only sets the number of ranges
    total = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(4, math.ceil(total / 6 / range_entries))

    def probe(batches):
        known, flush = WordHash(), Flush(ranges, block, None)
        for batch in batches:
            for doc, key, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                flush.add(doc, key, known.array(words_of(text)))
                if flush.size >= flush_words:
                    yield from flush.pack()
                    flush = Flush(ranges, block, None)
        yield from flush.pack()

    hits = cut(_spans_of(usable.mapInArrow(probe, PACKED), False))

    def extend(batches):
        known, flush = WordHash(), Flush(ranges, window, block)
        for batch in batches:
            for doc, key, text, spans in zip(*(batch.column(k).to_pylist() for k in range(4))):
                flush.add(doc, key, known.array(words_of(text)), np.frombuffer(b"".join(spans), np.uint32))
                if flush.size >= flush_words:
                    yield from flush.pack()
                    flush = Flush(ranges, window, block)
        yield from flush.pack()

    later = cut(_spans_of(_with_spans(usable, hits, "inner").mapInArrow(extend, PACKED), True))

    def gone_of(split: list[list[bytes]], spans: list[list[bytes]], known: WordHash) -> list[np.ndarray]:
        """Which words of each text are covered by a window that was found."""
        ends = np.cumsum([len(w) for w in split])
        words = np.concatenate([known.array(w) for w in split])
        begins = ends - np.diff(ends, prepend=0)
        found = from_spans(np.concatenate([np.frombuffer(b"".join(s), np.uint32) + np.uint32(b) for s, b in zip(spans, begins)]), len(words))
        h, place = windows_within(words, ends, window)
        start = grow(h, np.searchsorted(ends, place, "right"), found[place])
        return np.split(from_spans(to_spans(place[start], window), len(words)), ends[:-1])

    def shorten(batches):
        known = WordHash()
        for batch in batches:
            out, texts, spans = [], batch.column(2).to_pylist(), batch.column(3).to_pylist()
            split = [words_of(t) for t in texts]
            cut_down = [i for i, s in enumerate(spans) if s]
            gone = dict(zip(cut_down, gone_of([split[i] for i in cut_down], [spans[i] for i in cut_down], known))) if cut_down else {}
            for i, words in enumerate(split):
                keep = words if i not in gone else list(compress(words, (~gone[i]).tolist()))
                kept = b" ".join(keep)
                out.append((len(words), len(words) - len(keep), sha256(kept).hexdigest()) + ((kept.decode("utf-8", "replace"),) if with_text else ()))
            columns = list(zip(*out)) or [[]] * (3 + with_text)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text])

    return _with_spans(rows, later, "left").mapInArrow(shorten, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
