"""License scans by a positional rare-token index.

Templates of license notices are indexed by word and place, each by its places of the
highest inverse document frequency: so many that some of them are met wherever enough of
the template stands. A file looks up its words, counts for each template the relative
position at which they meet its postings, and keeps a template if enough of its words
stand at one position and its mandatory key phrases stand in the file. The phrases
of BASE count at all places.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import tune
from wayfind.llm.license_texts import TEMPLATES

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Votes that a template's place needs, if it has so many words.
VOTES = 3
#: Share of a template's words that must stand at their relative position.
COVER = 0.7

#: Maps a byte to itself, to its lower case (A-Z) or to a space (no part of a word); bytes over 0x7F are parts of words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def places(words: list[bytes], phrase: list[bytes], lead: list[int] | None = None) -> list[int]:
    """Where the words of a phrase stand consecutively. lead: places of the phrase's first word, if known."""
    if lead is None:
        lead, at = [], -1
        try:
            while True:
                at = words.index(phrase[0], at + 1)
                lead.append(at)
        except ValueError:
            pass
    return [p for p in lead if words[p : p + len(phrase)] == phrase]


class Index:
    """Postings of the templates' rarest words, by their inverse document frequency in the corpus.

    COVER of a template's L words leave out `missing` of them at most; of its missing +
    VOTES rarest places (or all L), VOTES (or L - missing) at least are met.
    """

    def __init__(self, templates, frequency: dict[bytes, int], n_docs: int):
        self.templates = [(label, words_of(text), [words_of(k) for k in keys]) for label, text, keys in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.votes = []
        idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) for _, words, _ in self.templates for w in words}
        for i, (_, words, _) in enumerate(self.templates):
            missing = next(k for k in range(len(words), -1, -1) if (len(words) - k) / len(words) >= COVER)
            rare = sorted(range(len(words)), key=lambda p: (-idf[words[p]], words[p], p))[: missing + VOTES]
            self.votes.append(len(rare) - missing)
            for p in rare:
                self.postings.setdefault(words[p], []).append((i, p))
        self.vocabulary = frozenset(self.postings)
        self.base = [(words_of(p), label) for p, label in BASE.items()]

    def match(self, words: list[bytes]) -> tuple[set[str], float]:
        """Labels of the templates found, and the best share of a template's words at their position."""
        present = self.vocabulary.intersection(words)
        if not present:
            return set(), 0.0
        votes: Counter = Counter()
        at: dict[bytes, list[int]] = {w: [] for w in present}
        for p, w in enumerate(words):
            if w in at:
                at[w].append(p)
        for w, where in at.items():
            for t, offset in self.postings[w]:
                votes.update((t, p - offset) for p in where)
        labels, best = set(), 0.0
        for (t, shift), n in votes.items():
            label, body, keys = self.templates[t]
            if n < self.votes[t]:
                continue
            share = sum(0 <= shift + i < len(words) and words[shift + i] == w for i, w in enumerate(body)) / len(body)
            near = words[max(0, shift - len(body)) : max(0, shift + 2 * len(body))]
            if share >= COVER and all(places(near, k) for k in keys):
                labels.add(label)
                best = max(best, share)
        return labels, best


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs.

    A null text counts as empty (0 words, no labels, score 0). score: the best share of a
    matched template's words, 0.5 at least where a base phrase stands, else 0. A null id
    stays null; repeated rows give repeated rows; other columns are not read. The words'
    frequencies are counted over all texts first; both passes are narrow.
    """
    vocabulary = frozenset(w for _, text, _ in templates for w in words_of(text))
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        seen, n = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                if text:
                    seen.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_pydict({"word": pa.array([b"", *seen], pa.binary()), "n": pa.array([n, *seen.values()], pa.int64())})

    counted = rows.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row for each licence word
    frequency = {bytes(r.word): r.n for r in counted}
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, frequency, frequency.pop(b"", 0)))

    def run(batches):
        own = index.value
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = words_of(text or "")
                found = [(p, label) for phrase, label in own.base for p in places(words, phrase)]
                labels, score = own.match(words)
                base = {label for _, label in found}
                at = [p for p, _ in found]
                out.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), max(score, 0.5 * bool(base))))
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k.type) for c, k in zip(columns, list(SCHEMA)[1:]))], schema=SCHEMA)

    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
