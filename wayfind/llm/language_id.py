"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of a bounded sample of labelled text. A text is
parsed against each automaton into phrases, each the longest match from where the last
one ended; the language whose automaton needs the fewest phrases, normalised to bits
a symbol (phrases x log2 of the sample's length / symbols), wins.

Parsing runs over many blocks in step: a text's symbols are cut into blocks of
``BLOCK`` (a phrase ends at a block's end, whatever else is in a batch), and one array
lookup moves all blocks and languages on by a symbol.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.common import tune

#: Bounds of the sample: rows and symbols of each language, characters of one text (a piece of longer ones), and
#: symbols over all languages, of which each has LEAST at least. All languages are learned. A symbol takes up to two
#: states of 4 * (LETTERS + DIGITS + 1) bytes: 0.6 GB for TOTAL, and 0.25 MB for each language beyond TOTAL / LEAST.
ROWS, SYMBOLS, PIECE, TOTAL, LEAST = 400, 30_000, 3_000, 1_200_000, 500
#: Letters with a symbol of their own; any other is three to five digits, its code point.
LETTERS, DIGITS = 46, 16
BLOCK = 1024
#: A text of that many symbols at least that needs more bits a symbol fits no language.
FIT_SYMBOLS, FIT_BITS = 60, 5.0
BREAK = np.int32(-(2**31))


@lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(is_letter()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


class Alphabet:
    """Symbols of a text: 0 for a run of non-letters, the most frequent letters one each, and any other letter as the digits of its code point."""

    def __init__(self, letters: str):
        self.size = len(letters) + 1 + DIGITS
        self.rare = np.uint8(255)
        self.table = is_letter().astype(np.uint8) * self.rare
        for i, c in enumerate(letters):
            self.table[ord(c)] = i + 1

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.table[points]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        s, points = s[keep], points[keep]
        if (s == self.rare).any():
            size = np.where(s == self.rare, 3 + (points >= 0x1000) + (points >= 0x10000), 1)
            which = np.repeat(np.arange(len(s)), size)
            left = np.cumsum(size)[which] - np.arange(len(which)) - 1  # digits of the letter that follow this one
            digit = (points[which] >> (4 * left).astype(np.uint32)) & np.uint32(15)
            s = np.where(s[which] == self.rare, self.size - DIGITS + digit, s[which]).astype(np.uint8)
        return s[int(len(s) > 0 and s[0] == 0) :]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of a sequence; state 0 is the root."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in symbols:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[new] = clone
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
        last = new
    return step


class Model:
    """The automata of all languages in one table: entry (state, symbol) is where to go on, negative if a phrase ends.

    A state's number is its row times the alphabet's size. Where a state has no
    transition, a new phrase starts: its entry is the root's transition (or the root,
    if no sample has the symbol), marked with the sign bit.
    """

    def __init__(self, samples: dict[str, list[str]], symbols: int = SYMBOLS, total: int = TOTAL):
        """samples: texts of each language, of which the first symbols count, up to its share."""
        share = sample_share(len(samples), symbols, total)
        letters = Counter(c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha())
        self.alphabet = Alphabet("".join(c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]))
        self.langs = sorted(samples)
        a, tables, roots, weight, rows = self.alphabet.size, [], [], [], 0
        for lang in self.langs:
            parts = [self.alphabet.symbols(t) for t in samples[lang]]
            joined = np.concatenate([x for p in parts for x in (p, np.zeros(1, np.uint8))] or [np.zeros(1, np.uint8)])
            joined = joined[np.concatenate([[True], (joined[1:] != 0) | (joined[:-1] != 0)])][:share].tolist()
            step = suffix_automaton(joined)
            table = np.full((len(step), a), -1, np.int64)
            for state, out in enumerate(step):
                for c, to in out.items():
                    table[state, c] = to
            table = np.where(table >= 0, (table + rows) * a, -1)
            fresh = np.where(table[0] >= 0, table[0], rows * a)
            tables.append(np.where(table >= 0, table, fresh[None, :] - 2**31).astype(np.int32))
            if (rows + len(step)) * a >= 2**31:
                raise ValueError(f"{len(samples)} languages need a table of more than 2^31 entries; give fewer symbols to each")
            roots.append(rows * a)
            weight.append(np.log2(max(2, len(joined))))
            rows += len(step)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.roots, self.weight = np.array(roots, np.int32), np.array(weight)

    def phrase_breaks(self, blocks: list[np.ndarray]) -> np.ndarray:
        """How often a phrase ends inside each block, for each language (languages x blocks)."""
        sizes = np.array([len(b) for b in blocks])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        text = np.zeros((sizes[0], len(blocks)), np.int32)
        for k, i in enumerate(order):
            text[: len(blocks[i]), k] = blocks[i]
        active = len(blocks) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), "right")
        state = np.repeat(self.roots[:, None], len(blocks), 1)
        count = np.zeros(state.shape, np.int32)
        for t in range(sizes[0]):
            n = active[t]
            to = self.table.take(state[:, :n] + text[t, :n])
            count[:, :n] += to < 0
            state[:, :n] = to & 0x7FFFFFFF
        out = np.empty_like(count)
        out[:, order] = count
        return out

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, int, float]]:
        """For each text: the language, a score from 0 to 1, the symbols, bits a symbol of phrases ended.

        The score is the runner-up's phrases over those of both; 1 if one language was learned.
        """
        symbols = [self.alphabet.symbols(t) if t else np.zeros(0, np.uint8) for t in texts]
        blocks, owner = [], []
        for i, s in enumerate(symbols):
            if s.any():
                for at in range(0, len(s), BLOCK):
                    blocks.append(s[at : at + BLOCK])
                    owner.append(i)
        total = np.zeros((len(self.langs), len(texts)))
        pieces = np.bincount(np.array(owner, int), minlength=len(texts)) if owner else np.zeros(len(texts))
        for at in range(0, len(blocks), 4096):
            part = self.phrase_breaks(blocks[at : at + 4096])
            np.add.at(total, (slice(None), np.array(owner[at : at + 4096])), part)
        out = []
        for i, s in enumerate(symbols):
            if not s.any() or not self.langs:
                out.append(("und", 0.0, len(s), 0.0))
                continue
            bits = (total[:, i] + pieces[i]) * self.weight
            order = np.argsort(bits, kind="stable")  # ties: the first language by name
            best = order[0]
            score = 1.0 if len(order) == 1 else float(bits[order[1]] / (bits[best] + bits[order[1]]))
            out.append((self.langs[best], score, len(s), float(total[best, i] * self.weight[best] / len(s))))
        return out


def sample_share(languages: int, symbols: int = SYMBOLS, total: int = TOTAL) -> int:
    """Symbols that each of so many languages is learned from."""
    return max(1, min(symbols, max(LEAST, total // max(1, languages))))


def draw_sample(labelled: DataFrame, rows: int = ROWS, symbols: int = SYMBOLS, piece: int = PIECE, total: int = TOTAL) -> dict[str, list[str]]:
    """Texts of each language of (doc_id, text, lang): at most `rows` different ones, in the order of a hash, up to `symbols` characters.

    Of a text longer than `piece`, a piece of that length counts, from a place that
    follows from the hash. With many languages each has total / languages characters, LEAST at least.
    Rows are counted first, and only as many as are needed pass a threshold on their
    hash, so that no task sees more than some times `rows` of a language.
    """
    order = F.xxhash64("doc_id", F.xxhash64("text"))
    fit = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("order", order)
    counts = fit.groupBy("lang").agg(F.approx_count_distinct("order", 0.02).alias("n")).collect()  # a row for each language
    if not counts:
        return {}
    symbols = sample_share(len(counts), symbols, total)
    # twice the rows that are wanted, and some: fewer are next to impossible
    limits = [(r.lang, min(int(min(1.0, (2 * rows + 50) / max(1, r.n)) * 2.0**64) - (1 << 63), (1 << 63) - 1)) for r in counts]
    low = labelled.sparkSession.createDataFrame(limits, "lang string, low long")
    text = F.col("text")
    begin = F.when(F.length(text) > piece, F.pmod(F.col("order"), F.length(text) - piece).cast("int")).otherwise(0) + 1
    passed = fit.join(F.broadcast(low), "lang").where("order <= low").select("lang", "order", F.substring(text, begin, F.lit(piece)).alias("text")).dropDuplicates(["lang", "order"])
    ranked = passed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).where(F.col("rank") <= rows)
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("rank")) - F.length("text")
    drawn = ranked.withColumn("room", F.lit(symbols) - before).where("room > 0").select("lang", "rank", F.substring(text, F.lit(1), F.col("room").cast("int")).alias("text"))
    out: dict[str, list[str]] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r.lang, r.rank)):  # at most `total` characters, or LEAST for each language
        out.setdefault(r.lang, []).append(r.text)
    return out


SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("symbols", pa.int64()), ("bits", pa.float64())])


def identify(docs: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, symbols, bits for each row of docs.

    Learns from rows with a label whose crc32(id as text) mod folds isn't 0 (held_out is
    true where it is 0; a null id is neither held out nor learned from). lang_pred is
    `und`, with score 0, where the text is null or has no letter, or nothing could be
    learned. Repeated rows give repeated rows; other columns are not read.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    samples = docs.sparkSession.sparkContext.broadcast(draw_sample(rows.where(F.col("doc_id").isNotNull() & ~held)))

    def run(batches):
        model = _model(samples)
        for batch in batches:
            judged = model.judge([t if has_letter(t) else None for t in batch.column(1).to_pylist()])
            columns = list(zip(*judged)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, k.type) for c, k in zip(columns, list(SCHEMA)[2:]))], schema=SCHEMA)

    return rows.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, symbols long, bits double")


_built: dict[int, Model] = {}


def _model(samples) -> Model:
    """The model of a broadcast sample, built once in each Python worker."""
    key = hash(repr(sorted(samples.value.items())))
    if key not in _built:
        _built.clear()
        _built[key] = Model(samples.value)
    return _built[key]


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is known, all columns unchanged.

    Rejected: texts that are null or have no letter, and texts of FIT_SYMBOLS symbols or
    more that need more than FIT_BITS bits a symbol in their best language. Each row is
    judged by its own text, whatever other rows have its id, in a narrow pass. Where no
    language could be learned, all texts with a letter stay.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    samples = docs.sparkSession.sparkContext.broadcast(draw_sample(rows.where(F.col("doc_id").isNotNull() & ~held)))
    at = docs.columns.index("text")

    def run(batches):
        model = _model(samples)
        for batch in batches:
            texts = [t if has_letter(t) else None for t in batch.column(at).to_pylist()]
            if model.langs:
                good = [lang != "und" and (n < FIT_SYMBOLS or bits <= FIT_BITS) for lang, _, n, bits in model.judge(texts)]
            else:
                good = [t is not None for t in texts]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
