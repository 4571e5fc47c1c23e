"""Token counts by overlap resynchronisation.

Texts up to ``chunk`` characters are encoded whole. A longer one is encoded in
overlapping chunks; two neighbours are spliced at a token boundary that both have and
that is provably independent of what stands left of it: a change from a character
that isn't white space to white space. No piece of the split pattern reaches over such
a place and no special token holds white space, so that everything right of it is
encoded alike wherever a chunk begins, and everything left of it alike wherever a chunk
ends. If the overlap holds no such boundary, it is widened, up to a joined chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm import bpe_vocab
from wayfind.llm.common import tune

CHUNK, OVERLAP, LIMIT = 1 << 16, 256, 512
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def common_boundary(text: str, at: int, to: int, left: tuple[int, list[int]], right: tuple[int, list[int]], size: Callable[[int], int]) -> tuple[int, int, int] | None:
    """The first stable place in text[at:to) that both encodings have as a token boundary.

    left and right: where a chunk begins in the text, and its ids. Returns the place,
    how many ids of the left chunk lie before it, and how many of the right one.
    """
    places = [p for p in range(max(at, 1), to) if text[p] in bpe_vocab.WHITE and text[p - 1] not in bpe_vocab.WHITE]
    if not places:
        return None
    bounds = []
    for begin, ids in (left, right):
        bounds.append({b: i for i, b in enumerate(accumulate((size(t) for t in ids), initial=0))})
    lead = [len(text[begin : places[0]].encode()) for begin, _ in (left, right)]
    for p, q in zip(places, [*places[1:], to]):
        if lead[0] in bounds[0] and lead[1] in bounds[1]:
            return p, bounds[0][lead[0]], bounds[1][lead[1]]
        step = len(text[p:q].encode())
        lead = [x + step for x in lead]
    return None


def spliced(encode: Callable[[str], list[int]], size: Callable[[int], int], text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[int]]:
    """The ids of a text, chunk by chunk; together they equal encode(text).

    size: bytes of a token. Only two chunks are held at a time.
    """
    begin, end = 0, min(len(text), chunk)
    ids = encode(text[:end])
    while end < len(text):
        width = overlap
        while True:
            start, far = max(begin, end - width), min(len(text), end + chunk)
            if start == begin:  # widened to the whole chunk: join the two
                ids, end = encode(text[begin:far]), far
                break
            more = encode(text[start:far])
            if found := common_boundary(text, start + 1, end, (begin, ids), (start, more), size):
                place, n, m = found
                yield ids[:n]
                begin, ids, end = place, more[m:], far
                break
            width *= 2
    yield ids


def count_tokens(docs: DataFrame, vocab: str = "byte_bpe_50k.json", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs.

    A null text counts as empty (0 bytes, 0 tokens). A null id stays null; repeated
    rows give repeated rows; other columns are not read. One narrow pass, no shuffle.
    """

    def run(batches):
        bpe = bpe_vocab.load(vocab)
        size = {i: len(b) for i, b in bpe.token_bytes.items()}.__getitem__
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(len(bpe.encode(text)) if len(text) <= chunk else sum(map(len, spliced(bpe.encode, size, text, chunk, overlap))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], schema=SCHEMA)

    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
