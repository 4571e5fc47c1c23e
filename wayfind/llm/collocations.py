"""Phrase collocations, counted in HAT-tries.

A task counts phrases in a trie over word names (64-bit hashes; `Trie`): a branch leads
on by the next word, a leaf is a hash container of what follows with its counts, and a
container that grows beyond BURST entries bursts into a branch. When the trie holds more
than LIMIT entries, its largest subtrees are spilled whole, as sorted runs. Runs are dealt
to partitions by a phrase's first word and an eighth of the second ones (a word's runs by
the word), where they are merged; what occurs often enough in all of them stays. A run is
front-coded: a row has only what it doesn't share with the one before.

There are three passes over the texts: words; pairs of frequent words; phrases of three
to five words all of whose pairs are frequent. A part of a frequent phrase is at least as
frequent as the phrase, so nothing is lost. Tasks know what is frequent by a table of
FILTER_BITS bits (`bit_table`), whatever the size of the corpus; an infrequent word or
pair that shares a bit with a frequent one is only counted for nothing.

Words are compared by 64-bit hashes within phrases, and as they are when words are counted.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.common import broadcast_if_small, cut, tune
from wayfind.llm.wordhash import PRIME, WordHash, mix

#: Words of a phrase at most, its least count, and phrases that a language's report has at most.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Entries of a container before it bursts; entries of a task's trie before it spills; words counted at once.
BURST, LIMIT, CHUNK = 4096, 1_200_000, 400_000
#: Entries that a prefix partition merges, about.
PARTITION = 2_000_000
#: Bits of the table of what is frequent.
FILTER_BITS = 27
BROADCAST_ROWS = 100_000

BREAK = b"."
SEPARATORS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
#: Bytes of a text that are split at once.
SLICE = 1 << 22

WORD_RUN = "part long, lang string, words binary, counts binary"
WORDS = "lang string, word string, name long, slot long, n long, total long"
RUN = "part long, lang string, sizes binary, names binary, counts binary"
PHRASES = "lang string, names array<bigint>, slot long, n long"


class Names(WordHash):
    """Names of words; that of a break is 0."""

    def __missing__(self, word: bytes) -> int:
        return 0 if word == BREAK else super().__missing__(word)


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased (A-Z), with BREAK where a piece ends; a long text in several lists."""
    start = 0
    while start < len(text):
        end = min(len(text), start + SLICE)
        while end < len(text) and text[end] not in b" \t.,;:!?\n\x0b\x0c\r":
            end += 1
        yield text[start:end].lower().translate(SEPARATORS).replace(BREAK, b" . ").split()
        start = end


def salt(lang: str) -> np.uint64:
    return np.uint64(WordHash().__missing__(lang.encode("utf-8", "surrogatepass")))


def slots(names: np.ndarray, lang: str) -> np.ndarray:
    """The bit of each row of names (one or two words) in a table."""
    h = np.full(len(names), salt(lang))
    for k in range(names.shape[1]):
        h = mix(h * PRIME + names[:, k])
    return h >> np.uint64(64 - FILTER_BITS)


class Trie:
    """Counts of word sequences (rows of names, ended by zeros) in containers under branches.

    A branch is {name: subtree}, a container a Counter of what follows (the names' bytes).
    """

    def __init__(self, width: int, burst: int = BURST):
        self.width, self.burst, self.root = width, burst, {}
        self.sizes: Counter = Counter()

    @property
    def size(self) -> int:
        return self.sizes.total()

    def add(self, rows: np.ndarray) -> None:
        rows = rows[np.argsort(rows[:, 0])]
        first, begins = np.unique(rows[:, 0], return_index=True)
        rest = np.ascontiguousarray(rows[:, 1:]).view(np.dtype((np.void, 8 * (self.width - 1)))).ravel().tolist()
        for name, lo, hi in zip(first.tolist(), begins.tolist(), [*begins[1:].tolist(), len(rows)]):
            self.root[name], grown = self._into(self.root.get(name), rest[lo:hi], self.width - 1)
            self.sizes[name] += grown

    def _into(self, tree, keys: list[bytes], width: int):
        """Count keys in a subtree: the subtree, and by how many entries it has grown."""
        if tree is None:
            tree = Counter()
        if isinstance(tree, Counter):
            before = len(tree)
            tree.update(keys)
            grown = len(tree) - before
            return (self._burst(tree) if len(tree) > self.burst and width > 1 else tree), grown
        grown, by_next = 0, {}
        for key in keys:
            by_next.setdefault(key[:8], []).append(key[8:])
        for name, rest in by_next.items():
            tree[name], more = self._into(tree.get(name), rest, width - 1)
            grown += more
        return tree, grown

    @staticmethod
    def _burst(container: Counter) -> dict:
        branch: dict = {}
        for key, n in container.items():
            branch.setdefault(key[:8], Counter())[key[8:]] = n
        return branch

    def _entries(self, tree, before: bytes) -> Iterator[tuple[bytes, int]]:
        for key, below in tree.items():
            if isinstance(tree, Counter):
                yield before + key, below
            else:
                yield from self._entries(below, before + key)

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Take out the largest subtrees until at most `keep` entries are left: their rows of names and counts, unsorted."""
        left, names, counts = self.size, [], []
        for name, n in self.sizes.most_common():
            if left <= keep:
                break
            keys, values = zip(*self._entries(self.root.pop(name), np.uint64(name).tobytes()))
            names.append(np.frombuffer(b"".join(keys), np.uint64).reshape(-1, self.width))
            counts.append(np.array(values, np.int64))
            left -= n
            del self.sizes[name]
        return (np.concatenate(names), np.concatenate(counts)) if names else (np.zeros((0, self.width), np.uint64), np.zeros(0, np.int64))


def planes(a: np.ndarray) -> bytes:
    """Byte plane by byte plane: columns that repeat or are small compress well that way."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def from_planes(b: bytes, kind, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(-1, n).T).view(kind).ravel() if n else np.zeros(0, kind)


def front_coded(names: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted rows: of each how many names it shares with the one before and how many it has, and the names between."""
    n, width = names.shape
    same = np.zeros((n, width), bool)
    same[1:] = names[1:] == names[:-1]
    shared = np.where(same.all(1), width, np.argmin(same, 1))
    long = np.count_nonzero(names, 1)
    at = np.arange(width)
    return (shared * 16 + long).astype(np.uint8).tobytes(), planes(names[(at >= shared[:, None]) & (at < long[:, None])])


def from_front_coded(sizes: bytes, rest: bytes, width: int) -> np.ndarray:
    code = np.frombuffer(sizes, np.uint8)
    shared, long = code // 16, code % 16
    at = np.arange(width)
    names = np.zeros((len(code), width), np.uint64)
    own = (at >= shared[:, None]) & (at < long[:, None])
    names[own] = from_planes(rest, np.uint64, len(rest) // 8)
    for j in range(width):  # what is shared stands in the last row that has its own
        names[:, j] = names[np.maximum.accumulate(np.where(shared <= j, np.arange(len(code)), 0)), j]
    return names


def rows_order(names: np.ndarray) -> np.ndarray:
    return np.lexsort(names.T[::-1])


def merged(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs in a row as one sorted run."""
    order = rows_order(names)
    names, counts = names[order], counts[order]
    begins = np.flatnonzero(np.concatenate([[True], np.any(names[1:] != names[:-1], axis=1)]))
    return names[begins], np.add.reduceat(counts, begins)


def bit_table(frequent: DataFrame) -> np.ndarray:
    """A bit for each slot of a frequent one: 2 ** FILTER_BITS bits, gathered as at most 2 ** (FILTER_BITS - 6) numbers."""
    words = frequent.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return table


def known(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def count_words(docs: DataFrame, parts: int, least: int, limit: int = LIMIT) -> DataFrame:
    """lang, word, name, slot, n of the words with n >= least, and a row without a word with each partition's total of a language."""

    def run(lang: str, counter: Counter):
        words = sorted(counter)
        part = np.fromiter(map(known_words.__getitem__, words), np.uint64, len(words)) % np.uint64(parts)
        counts = np.fromiter(map(counter.__getitem__, words), np.int64, len(words))
        out = []
        for k in np.unique(part).tolist():
            own = np.flatnonzero(part == k)
            out.append((k, lang, b" ".join([words[i] for i in own.tolist()]), planes(counts[own])))
        return runs_batch(WORD_RUN, out)

    known_words = WordHash()

    def count(batches):
        tries: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counter = tries.setdefault(lang, Counter())
                for words in words_of(text):
                    counter.update(words)
                counter.pop(BREAK, None)
            while sum(map(len, tries.values())) > limit:
                lang = max(tries, key=lambda x: len(tries[x]))
                yield run(lang, tries.pop(lang))
        for lang, counter in tries.items():
            if counter:
                yield run(lang, counter)

    def merge(table: pa.Table) -> pa.Table:
        totals: dict[str, Counter] = {}
        for r in table.to_pylist():
            words = r["words"].split(b" ")
            counter = totals.setdefault(r["lang"], Counter())
            for word, n in zip(words, from_planes(r["counts"], np.int64, len(words)).tolist()):
                counter[word] += n
        out = []
        for lang, counter in totals.items():
            often = [w for w, n in counter.items() if n >= least]
            names = np.fromiter(map(known_words.__getitem__, often), np.uint64, len(often))
            out += zip([lang] * len(often), [w.decode("utf-8", "replace") for w in often], names.view(np.int64).tolist(), slots(names[:, None], lang).astype(np.int64).tolist(), [counter[w] for w in often], [None] * len(often))
            out.append((lang, None, None, None, None, sum(counter.values())))
        return pa.Table.from_batches([runs_batch(WORDS, out)])

    return docs.mapInArrow(count, WORD_RUN).groupBy("part").applyInArrow(merge, WORDS)


def runs_batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def count_phrases(docs: DataFrame, shortest: int, longest: int, parts: int, least: int, words, pairs=None, limit: int = LIMIT, burst: int = BURST, chunk: int = CHUNK) -> DataFrame:
    """lang, names, slot, n of the phrases of `shortest` to `longest` words with n >= least.

    words, pairs: broadcast tables of frequent words and pairs (None: all).
    """

    def phrases_in(names: np.ndarray, head: int, lang: str) -> np.ndarray:
        """The phrases that end after the first `head` words, as rows ended by zeros. names: zero where a phrase can't go on."""
        good = names != 0
        pair = good[:-1] & good[1:]
        if pairs is not None:
            at = np.flatnonzero(pair)
            pair[at] = known(pairs.value, slots(np.stack([names[at], names[at + 1]], 1), lang))
        out, run = [], pair
        for k in range(2, longest + 1):
            if k > 2:
                run = run[:-1] & pair[k - 2 :]
            if k >= shortest:
                at = np.flatnonzero(run)
                at = at[at + k > head]
                rows = np.zeros((len(at), longest), np.uint64)
                for j in range(k):
                    rows[:, j] = names[at + j]
                out.append(rows)
        return np.concatenate(out)

    def runs(lang: str, trie: Trie, keep: int):
        names, counts = trie.spill(keep)
        part = (mix(names[:, 0] * PRIME + (names[:, 1] >> np.uint64(61))) >> np.uint64(20)) % np.uint64(parts)
        order = np.lexsort((*names.T[::-1], part))
        edges = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
        out = []
        for k in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[k] : edges[k + 1]]
            out.append((k, lang, *front_coded(names[own]), planes(counts[own])))
        return runs_batch(RUN, out)

    def count(batches):
        names_of, tries, waiting, size = Names(), {}, {}, 0

        def put(lang: str):
            head, held = waiting[lang]
            names = np.concatenate([head, *held])
            fresh = np.flatnonzero(names)
            gone = fresh[~known(words.value, slots(names[fresh][:, None], lang))]
            names[gone] = 0
            if len(names) > 1:
                tries.setdefault(lang, Trie(longest, burst)).add(phrases_in(names, len(head), lang))
            waiting[lang] = (names[max(0, len(names) - longest + 1) :], [])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                head, held = waiting.setdefault(lang, (np.zeros(0, np.uint64), []))
                for some in words_of(text):
                    held.append(names_of.array(some))
                    size += len(some)
                    if size >= chunk:
                        for x in waiting:
                            put(x)
                        head, held = waiting[lang]
                        size = 0
                        while sum(t.size for t in tries.values()) > limit:
                            largest = max(tries, key=lambda x: tries[x].size)
                            yield runs(largest, tries[largest], tries[largest].size // 2)
                held.append(np.zeros(1, np.uint64))
        for lang in waiting:
            put(lang)
        for lang, trie in tries.items():
            if trie.root:
                yield runs(lang, trie, 0)

    def merge(table: pa.Table) -> pa.Table:
        by_lang: dict[str, list] = {}
        for r in table.to_pylist():
            n = len(r["counts"]) // 8
            by_lang.setdefault(r["lang"], []).append((from_front_coded(r["sizes"], r["names"], longest), from_planes(r["counts"], np.int64, n)))
        out = []
        for lang, got in by_lang.items():
            names, counts = merged(np.concatenate([x for x, _ in got]), np.concatenate([n for _, n in got]))
            often = counts >= least
            names, counts = names[often], counts[often]
            rows = [x[: np.count_nonzero(x)].view(np.int64).tolist() for x in names]
            out += zip([lang] * len(rows), rows, slots(names[:, :2], lang).astype(np.int64).tolist(), counts.tolist())
        return pa.Table.from_batches([runs_batch(PHRASES, out)])

    return docs.mapInArrow(count, RUN).groupBy("part").applyInArrow(merge, PHRASES)


def scored(phrases: DataFrame, totals: DataFrame, langs: int) -> DataFrame:
    """lang, phrase, width, a, l, r, n, score of phrases of two words or more. phrases: lang, words (array), a, those of one word too, and all parts of each."""
    named = phrases.select("lang", F.array_join("words", " ").alias("phrase"), F.size("words").alias("width"), "words", "a")
    part = lambda c, n: named.select("lang", F.col("phrase").alias(c), F.col("a").alias(n))
    cuts = named.where("width > 1").select("lang", "phrase", "width", "a", F.explode(F.expr("sequence(1, width - 1)")).alias("k"), "words")
    cuts = cuts.select("lang", "phrase", "width", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("words", F.col("k") + 1, F.col("width") - F.col("k")), " ").alias("right"))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cuts = cuts.join(broadcast_if_small(totals, langs, BROADCAST_ROWS), "lang")
    score = F.expr("(cast(1000 as decimal(4, 0)) * cast(a as decimal(13, 0)) * cast(n as decimal(16, 0))) div (cast(l as decimal(13, 0)) * cast(r as decimal(13, 0)))")
    best = cuts.select("lang", "phrase", "width", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.first("width").alias("width"), F.first("a").alias("a"), F.first("n").alias("n"), F.min("cut").alias("cut"))
    return best.select("lang", "phrase", "width", "a", "cut.l", "cut.r", "n", "cut.score")


def not_inside(candidates: DataFrame) -> DataFrame:
    """Candidates that are in no longer one of the same count. One of a word more is enough: what lies between two equal counts is as frequent."""
    words = F.split("phrase", " ")
    shorter = F.array(F.array_join(F.slice(words, F.lit(1), F.col("width") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("width") - 1), " "))
    inside = candidates.where("width > 2").select("lang", F.explode(shorter).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return candidates.join(inside, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, lang_col: str = "lang", text_col: str = "text", limit: int = LIMIT, burst: int = BURST, chunk: int = CHUNK, entries: int = PARTITION) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's first `top` collocations.

    Words are lower-cased (A-Z) runs of anything but blanks and tabs, within pieces that
    end at . , ; : ! ? and line ends. A phrase of two to `longest` words that occurs at
    least `least` times (a) is scored by its worst cut into two parts that occur l and r
    times, floor(1000 * a * n / (l * r)), n being all words of the language; of equal
    cuts the first counts. Phrases that lie in a longer one of the same count are dropped.
    Null languages are und; a null text is empty; repeated rows count each time. No words
    give no rows. Other columns are not read. limit, burst, chunk, entries: sizes, without influence on the result.
    """
    spark = tune(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text")).where("text is not null")
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(32, math.ceil(size / 12 / entries))
    words = cut(count_words(texts, parts, least, limit))
    totals = words.where("total is not null").groupBy("lang").agg(F.sum("total").alias("n"))
    words = words.where("total is null").drop("total")
    frequent = spark.sparkContext.broadcast(bit_table(words))
    pairs = cut(count_phrases(texts, 2, 2, parts, least, frequent, None, limit, burst, chunk))
    found = pairs
    if longest > 2:
        table = spark.sparkContext.broadcast(bit_table(pairs))
        found = pairs.unionByName(cut(count_phrases(texts, 3, longest, parts, least, frequent, table, limit, burst, chunk)))
    named = found.select("lang", "n", "names", F.posexplode("names").alias("at", "name")).join(words.select("lang", "name", "word"), ["lang", "name"])
    named = named.groupBy("lang", "names").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"), F.first("n").alias("a")).select("lang", F.transform("words", lambda x: x["word"]).alias("words"), "a")
    phrases = cut(named.unionByName(words.select("lang", F.array("word").alias("words"), F.col("n").alias("a"))))
    langs = totals.count()
    left = not_inside(scored(phrases, totals, langs))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
