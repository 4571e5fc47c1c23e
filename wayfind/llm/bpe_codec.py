"""BPE encoding and decoding over a minimal acyclic transducer of frequent words.

The corpus' most frequent pieces are compiled into a minimal acyclic automaton
(words share prefixes and suffixes). Each edge carries the number of words that sort
before those behind it; their sum along a path is the word's place in a table of id
sequences, so that the automaton maps a word to its output. The arrays are one flat
file that each Python worker maps into memory. A piece that isn't in the lexicon is
merged exactly.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm import bpe_vocab
from wayfind.llm.common import cut, tune

#: Words of the lexicon at most, distinct pieces counted before a flush, and pieces a worker remembers.
WORDS, FLUSH, REMEMBER = 50_000, 200_000, 200_000
#: Longer pieces are merged, never compiled; they are no words.
LONGEST = 40


class Lexicon:
    """Read access to the flat arrays: first edge of a state, labels, targets, skipped words, final flags, outputs."""

    NAMES = ("first", "label", "target", "skip", "final", "starts", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.first, self.label, self.target, self.skip, self.final, self.starts, self.ids = (arrays[k] for k in self.NAMES)

    def find(self, word: bytes) -> list[int] | None:
        """The ids of a word, None if the lexicon doesn't have it."""
        state, place = 0, 0
        first, label, target, skip = self.first, self.label, self.target, self.skip
        for b in word:
            lo, hi = int(first[state]), int(first[state + 1])
            at = lo + int(np.searchsorted(label[lo:hi], b))
            if at == hi or label[at] != b:
                return None
            place += int(skip[at])
            state = int(target[at])
        return self.ids[self.starts[place] : self.starts[place + 1]].tolist() if self.final[state] else None

    def find_all(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the table of outputs, -1 where it is missing.

        All words walk in step; an edge is found by one search over (state, label), as
        edges are stored in that order.
        """
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.label):
            return out
        if not hasattr(self, "keys"):
            owner = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first))
            self.keys = owner * 256 + self.label
        sizes = np.fromiter(map(len, words), np.int64, n)
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(words), np.uint8)
        begins = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        state, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        alive = np.arange(n)
        for step in range(int(sizes[0])):
            alive = alive[: np.searchsorted(-sizes[alive], -step, "left")]  # words longer than step come first
            if not len(alive):
                break
            key = state[alive] * 256 + flat[begins[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            gone = alive[~ok]
            state[gone] = -1
            alive, at = alive[ok], at[ok]
            place[alive] += self.skip[at]
            state[alive] = self.target[at]
        good = (state >= 0) & (sizes > 0)
        good[good] = self.final[state[good]] != 0
        out[order] = np.where(good, place, -1)
        return out


def compile_lexicon(outputs: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """The arrays of a minimal acyclic transducer from each word to its ids.

    Words are added in sorted order; whenever a branch is complete, its states are
    replaced by equal ones already there, so that suffixes are shared.
    """
    words = sorted(w for w in outputs if w)
    nodes: list[tuple[bool, list[list[int]]]] = [(False, [])]  # final, edges [label, target]
    known: dict[tuple, int] = {}
    path = [0]

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            node = path.pop()
            final, edges = nodes[node]
            same = known.setdefault((final, tuple(map(tuple, edges))), node)
            if same != node:
                nodes[path[-1]][1][-1][1] = same
                free.append(node)

    free: list[int] = []
    last = b""
    for word in words:
        shared = len(os.path.commonprefix([last, word]))
        settle(shared)
        for b in word[shared:]:
            if free:
                node = free.pop()
                nodes[node] = (False, [])
            else:
                node = len(nodes)
                nodes.append((False, []))
            nodes[path[-1]][1].append([b, node])
            path.append(node)
        nodes[path[-1]] = (True, nodes[path[-1]][1])
        last = word
    settle(0)
    reach: dict[int, int] = {}
    order, stack, seen = [], [(0, False)], set()
    while stack:
        node, done = stack.pop()
        if done:
            reach[node] = nodes[node][0] + sum(reach[t] for _, t in nodes[node][1])
            order.append(node)
        elif node not in seen:
            seen.add(node)
            stack.append((node, True))
            stack.extend((t, False) for _, t in nodes[node][1] if t not in seen)
    order.reverse()  # the root first
    number = {node: i for i, node in enumerate(order)}
    first, label, target, skip = [0], [], [], []
    for node in order:
        before = int(nodes[node][0])
        for b, t in nodes[node][1]:
            label.append(b)
            target.append(number[t])
            skip.append(before)
            before += reach[t]
        first.append(len(label))
    ids = [outputs[w] for w in words]
    return {
        "first": np.array(first, np.int32), "label": np.array(label, np.uint8), "target": np.array(target, np.int32), "skip": np.array(skip, np.int32),
        "final": np.array([nodes[n][0] for n in order], np.uint8), "starts": np.cumsum([0, *map(len, ids)]).astype(np.int32), "ids": np.array([i for x in ids for i in x], np.int32),
    }


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """The arrays in one flat file: a header of their sizes, then each, aligned to 8 bytes."""
    head = np.array([len(arrays[k]) for k in Lexicon.NAMES], np.int64).tobytes()
    return head + b"".join(arrays[k].tobytes() + b"\0" * (-arrays[k].nbytes % 8) for k in Lexicon.NAMES)


_mapped: dict[str, Lexicon] = {}


def open_mapped(blob: bytes) -> Lexicon:
    """The lexicon over a memory-mapped file in this worker's own temporary folder.

    A few MB that any worker can write again from the broadcast. Nothing else reads the
    file, so that its name goes as soon as it is mapped and nothing is left behind.
    """
    key = hashlib.sha256(blob).hexdigest()
    if key not in _mapped:
        fd, path = tempfile.mkstemp(prefix="lexicon-")
        with os.fdopen(fd, "wb") as f:
            f.write(blob)
        flat = np.memmap(path, np.uint8, "r")
        os.unlink(path)
        sizes, at, arrays = flat[:56].view(np.int64).tolist(), 56, {}
        for name, n in zip(Lexicon.NAMES, sizes):
            kind = np.dtype(np.uint8 if name in ("label", "final") else np.int32)
            arrays[name] = flat[at : at + n * kind.itemsize].view(kind)
            at += n * kind.itemsize + -(n * kind.itemsize) % 8
        _mapped.clear()
        _mapped[key] = Lexicon(arrays)
    return _mapped[key]


def frequent_words(docs: DataFrame, vocab: str, words: int = WORDS, text_col: str = "text") -> dict[bytes, list[int]]:
    """The most frequent pieces over all texts, with their ids: at most `words`, all that reach some count, which is over 1.

    Tasks merge them, so that the driver never holds the vocabulary.
    """

    def count(batches):
        bpe, seen = bpe_vocab.load(vocab), Counter()

        def flush():
            out = pa.RecordBatch.from_pydict({"piece": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for i, part in enumerate(bpe.parts(text or "")):
                    if not i % 2:
                        seen.update(bpe.pieces(part))
            if len(seen) > FLUSH:
                yield flush()
        yield flush()

    def merge(batches):
        bpe = bpe_vocab.load(vocab)
        for batch in batches:
            ids = [bpe.merge(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["piece", "ids"])

    def merged(pieces: DataFrame) -> dict[bytes, list[int]]:
        return {row.piece.encode(): row.ids for row in pieces.select("piece").mapInArrow(merge, "piece string, ids array<int>").collect()}

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "piece string, n long")
    totals = cut(counts.where(F.length("piece") <= LONGEST).groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1"))
    # the least count that at most `words` pieces reach, by steps of an eighth of a doubling
    step = F.floor(F.log2("n") * 8)
    room, least = words, None
    for r in totals.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # some hundred steps
        room -= r["count"]
        if room < 0:
            break
        least = r.step
    if least is not None:
        return merged(totals.where(step >= least))  # at most `words` rows
    # the first step alone has more: the first by count and name
    return merged(totals.orderBy(F.desc("n"), "piece").limit(words))


class Codec:
    """Encoding through the lexicon, with a bounded memory of pieces, and decoding through the ids."""

    def __init__(self, bpe: bpe_vocab.Bpe, lexicon: Lexicon, remember: int = REMEMBER):
        self.bpe, self.lexicon, self.remember, self.known = bpe, lexicon, remember, {}

    def learn(self, pieces: set[str]) -> None:
        """Make sure that all these pieces are known: by the lexicon, else by merging."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > self.remember:
            self.known, new = {}, list(pieces)
        lex, merge, ids = self.lexicon, self.bpe.merge, None
        for piece, place in zip(new, lex.find_all([p.encode() for p in new]).tolist()):
            ids = lex.ids[lex.starts[place] : lex.starts[place + 1]].tolist() if place >= 0 else merge(piece)
            self.known[piece] = (len(ids), ",".join(map(str, ids)), b"".join(map(self.bpe.token_bytes.__getitem__, ids)))

    def encode_decode(self, texts: list[str]) -> list[tuple[int, str, bytes]]:
        """For each text: the number of ids, the ids joined by commas, the bytes they decode to."""
        split = []
        for text in texts:
            parts = self.bpe.parts(text)
            split.append([x for i, part in enumerate(parts) for x in ([part] if i % 2 else self.bpe.pieces(part))] if len(parts) > 1 else self.bpe.pieces(text))
        special = {t: (1, str(i), t.encode()) for t, i in self.bpe.special.items()}
        self.learn(set().union(*split) - special.keys())
        known = self.known | special if special.keys() & set().union(*split) else self.known
        out = []
        for pieces in split:
            if not pieces:
                out.append((0, "", b""))
                continue
            sizes, ids, raw = zip(*map(known.__getitem__, pieces))
            out.append((sum(sizes), ",".join(ids), b"".join(raw)))
        return out


def encode_decode(docs: DataFrame, vocab: str = "byte_bpe_50k.json", words: int = WORDS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs; with_ids adds ids and decoded.

    A null text counts as empty. A null id stays null; repeated rows give repeated
    rows; other columns are not read. The lexicon's words come from one counting pass
    over all texts; the encoding pass is narrow. Bytes that aren't UTF-8 (an id
    sequence cut inside a character) decode to U+FFFD, as the usual decoder does.
    """
    spark = tune(docs.sparkSession)
    blob = spark.sparkContext.broadcast(pack(compile_lexicon(frequent_words(docs, vocab, words, text_col))))
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(kinds + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * 1 if with_ids else kinds)

    def run(batches):
        codec = Codec(bpe_vocab.load(vocab), open_mapped(blob.value))
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            done = []
            at = 0
            while at < len(texts):  # some MB of text at a time
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= 4 << 20):
                    size += len(texts[to])
                    to += 1
                for n, joined, raw in codec.encode_decode(texts[at:to]):
                    text = raw.decode("utf-8", "replace")
                    row = [n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()]
                    done.append(row + [[int(i) for i in joined.split(",") if i], text] if with_ids else row)
                at = to
            columns = list(zip(*done)) or [[]] * (len(schema) - 1)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k.type) for c, k in zip(columns, list(schema)[1:]))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)
