"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

Texts are cut into windows at half a window's stride. An item's window size W is the
largest power of two of which 3 W / 2 - 1 words in a row are left as they are by every
passage of the wanted similarity, so that any such passage holds a whole window of the
item (see sure_window). The windows' 64-bit SimHashes
(the majority of their words' hashes, bit by bit) are looked up among those of all
windows of the items of that size. Both sides are split into BLOCKS blocks; the item
side also has each block with one bit flipped, which guarantees all fingerprints within
2 * BLOCKS - 1 bits. The whole window that a passage holds has equal fingerprints, so
that what is found does not depend on the number of blocks: few wide ones are looked up
less often and hardly ever met by chance. A hit tells about where the item would begin;
around it, each start that a shared shingle names is tried, and the share of the item's
weighted shingles in as many words is computed exactly.

The majority over a window is computed by adding bit-sliced counters: the k-th plane of
a counter is a number that holds bit k of 64 counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import broadcast_if_small, cut

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, BITS = 2, 64
#: Windows of up to that many words are summed in generated code.
UNROLLED = 64
#: Entries of the item side that are broadcast at most; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000
#: Bytes of candidate places, and of the items' weights, that are broadcast at most.
BROADCAST_BYTES = 96 << 20


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _sum(x: list[Column], y: list[Column]) -> list[Column]:
    """The planes of the sum of two counters: one plane more."""
    out, carry = [], None
    for a, b in zip(x, y):
        half, both = a.bitwiseXOR(b), a.bitwiseAND(b)
        out.append(half if carry is None else half.bitwiseXOR(carry))
        carry = both if carry is None else both.bitwiseOR(half.bitwiseAND(carry))
    return [*out, carry]


def _majorities(windows: DataFrame, ids: list[str], largest: int) -> DataFrame:
    """ids, size, at, f of rows (ids, h, size, at): the SimHash of each window of h, of up to `largest` words, in generated code.

    One projection for each level of the sum, so that no plane is computed twice; missing
    words of smaller windows add nothing.
    """
    keep, counters = [*ids, "size", "at"], [[f"c{k}"] for k in range(largest)]
    df = windows.select(*keep, "h", (F.col("at") * F.shiftright("size", 1)).alias("first"))
    word = lambda k: F.when(F.col("size") > k, F.get("h", F.col("first") + k))
    df = df.select(*keep, *(F.coalesce(word(k), F.lit(0).cast("long")).alias(f"c{k}") for k in range(largest)))
    while len(counters) > 1:
        made = [_sum([F.col(c) for c in x], [F.col(c) for c in y]) for x, y in zip(counters[::2], counters[1::2])]
        level = len(made[0])
        df = df.select(*keep, *(c.alias(f"l{level}_{i}_{k}") for i, sums in enumerate(made) for k, c in enumerate(sums)))
        counters = [[f"l{level}_{i}_{k}" for k in range(level)] for i in range(len(made))]
    planes, f = counters[0], F.lit(0).cast("long")  # never null: else a filter on it would be pushed down and unfold all levels
    for k in range(1, len(planes)):  # at least half of 2 ** k words: one of two planes; the higher ones are 0
        f = F.when(F.col("size") == 1 << k, F.col(planes[k]).bitwiseOR(F.col(planes[k - 1]))).otherwise(f)
    return df.select(*keep, f.alias("f"))


def _adder(planes: int):
    def add(x, y):
        return F.struct(*(c.alias(f"p{k}") for k, c in enumerate(_sum(*([v.getField(f"p{k}") for k in range(planes)] for v in (x, y))))))

    return add


def _majority(planes: int):
    """At least half of 2 ** planes: one of the two highest planes."""
    return lambda s: s.getField(f"p{planes}").bitwiseOR(s.getField(f"p{planes - 1}"))


def _window(size: int):
    return lambda f, i: F.struct(F.lit(size).alias("size"), i.alias("at"), f.alias("f"))


def _large_windows(df: DataFrame, ids: list[str], sizes: list[int]) -> DataFrame:
    """ids, size, at, f of the windows of large sizes: sums of neighbouring halves, over arrays of counters."""
    df = df.select(*ids, F.transform("h", lambda x: F.struct(x.alias("p0"))).alias("tiles"))
    made, size, planes = [], 2, 1
    while size <= max(sizes):
        # sums of neighbouring tiles: windows of `size` at half of it; every second is a tile of `size`
        n = F.greatest(F.size("tiles") - 1, F.lit(0))
        df = df.withColumn("sums", F.zip_with(F.slice("tiles", F.lit(1), n), F.slice("tiles", F.lit(2), n), _adder(planes)))
        if size in sizes:
            df = df.withColumn(f"f{size}", F.transform("sums", _majority(planes)))
            made.append(F.transform(f"f{size}", _window(size)))
        df = df.withColumn("tiles", F.filter("sums", lambda x, i: i % 2 == 0))
        size, planes = size * 2, planes + 1
    return df.select(*ids, F.inline(F.concat(*made)))


def simhashes(df: DataFrame, ids: list[str], sizes: list[int]) -> DataFrame:
    """ids, size, at, f of df (ids, h: array of word hashes): SimHashes of its windows of each size at half its stride.

    at counts half windows. Sizes are powers of two from 2 on. Ties of the majority count as ones.
    """
    small, large = [s for s in sizes if s <= UNROLLED], [s for s in sizes if s > UNROLLED]
    parts = []
    if small:
        # a window is one number, at * len(small) + the place of its size: no array is built for each
        n, none = len(small), F.array().cast("array<bigint>")
        last = [F.floor((F.size("h") - s) / (s // 2)) for s in small]
        cuts = [F.when(F.size("h") >= s, F.sequence(F.lit(k).cast("long"), last[k] * n + k, F.lit(n).cast("long"))).otherwise(none) for k, s in enumerate(small)]
        windows = df.select(*ids, "h", F.explode(F.concat(*cuts)).alias("window"))
        size = reduce(lambda c, k: F.when(F.col("window") % n == k, F.lit(small[k])).otherwise(c), range(1, n), F.lit(small[0]))
        parts.append(_majorities(windows.select(*ids, "h", size.alias("size"), F.floor(F.col("window") / n).cast("int").alias("at")), ids, max(small)))
    if large:
        parts.append(_large_windows(df, ids, large))
    return reduce(DataFrame.unionByName, parts)


def window_size(n: int) -> int:
    """Of an item of n words."""
    size = 1
    while 3 * size - 1 <= n:  # 3/2 of twice the size, less one
        size *= 2
    return size


def longest_repeat(h: Column, most: int) -> Column:
    """The length of the longest run of words that stands in h twice, as far as `most`."""
    return reduce(lambda c, k: F.when(F.size(shingles_of(h, k)) < F.size(h) - k + 1, F.lit(k)).otherwise(c), range(1, most + 1), F.lit(0))


def sure_window(shingle: int, similarity: float, longest: int) -> Column:
    """The window size of an item (n, repeat, weights, total): the largest that every passage of the similarity holds whole.

    A passage has m = n - shingle + 1 places. If no 3 W / 2 - 1 of its words in a row are
    the item's, its shared shingles stand in runs of up to c = 3 W / 2 - 1 - shingle
    places, with shingle - 1 - repeat other places between two runs at least: closer
    runs would have over `repeat` words in common, which stand in the item twice. So it
    shares at most max over R of min(c R, m - gap (R - 1)) shingles. If as many of the
    item's weightiest are less than the similarity, W is sure. One shared shingle is
    always there, whatever stands between.
    """
    m, gap, size = F.col("n") - shingle + 1, F.greatest(F.lit(shingle - 1) - F.col("repeat"), F.lit(0)), window_size(shingle)
    heavy, own = F.sort_array(F.transform("weights", lambda x: x["w"]), asc=False), F.lit(size)
    while size * 2 <= window_size(longest):
        size *= 2
        run = 3 * size // 2 - 1 - shingle
        runs = F.floor((m + gap) / (gap + run)).cast("int")
        most = F.greatest(runs * run, m - gap * runs)
        shared = F.aggregate(F.slice(heavy, F.lit(1), most), F.lit(0.0), lambda a, w: a + w)
        own = F.when(shared < F.col("total") * (similarity - 1e-6), F.lit(size)).otherwise(own)  # shares are rounded to six digits
    return own


def item_table(items: DataFrame, shingle: int) -> DataFrame:
    """item_id, h, n, weights (shingle hash -> weight as structs), total of the items of at least `shingle` words.

    A shingle's weight is 1 / the number of items that hold it. Of rows of one id, one is
    taken for each text.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), _hashes(F.col("text").cast("string")).alias("h")).where(F.size("h") >= shingle).dropna(subset=["item_id"]).distinct()
    rows = rows.withColumn("n", F.size("h")).withColumn("key", F.xxhash64("h"))
    listed = rows.select("item_id", "key", F.explode(shingles_of(F.col("h"), shingle)).alias("s"))
    weight = listed.groupBy("s").agg((1.0 / F.countDistinct("key")).alias("w"))
    weights = listed.join(weight, "s").groupBy("item_id", "key").agg(F.collect_list(F.struct("s", "w")).alias("weights"), F.sum("w").alias("total"))
    return rows.join(weights, ["item_id", "key"])


def shingles_at(h: Column, shingle: int) -> Column:
    """The shingles of an array of word hashes, by hash and in their order; none if it has fewer words."""
    return F.when(F.size(h) >= shingle, F.transform(F.sequence(F.lit(1), F.size(h) - shingle + 1), lambda i: F.xxhash64(F.slice(h, i, shingle)))).otherwise(F.array().cast("array<bigint>"))


def shingles_of(h: Column, shingle: int) -> Column:
    """The distinct shingles."""
    return F.array_distinct(shingles_at(h, shingle))


def _keys(f: str) -> Column:
    """size, number and value of each block of f as one number: joins on it take the quicker table."""
    width = BITS // BLOCKS
    value = lambda k: F.shiftrightunsigned(f, width * k).bitwiseAND(F.lit((1 << width) - 1))
    return F.array(*(F.shiftleft(F.col("size").cast("long") * BLOCKS + k, width).bitwiseOR(value(k)) for k in range(BLOCKS)))


def probes_of(windows: DataFrame) -> DataFrame:
    """windows (size, f, ...) once for each block of f."""
    return windows.select("*", F.explode(_keys("f")).alias("block"))


def entries_of(prints: DataFrame) -> DataFrame:
    """prints (size, g, ...) once for each block of g as it is, and with each of its bits flipped.

    A probe meets by chance about one entry where there are 10^7 windows of eight words.
    """
    flips = F.array(*(F.lit(x).cast("long") for x in [0, *(1 << b for b in range(BITS // BLOCKS))]))
    blocks = prints.select("*", F.explode(_keys("g")).alias("block")).drop("size")
    return blocks.select(*(c for c in blocks.columns if c != "block"), F.explode(F.transform(flips, lambda x: F.col("block").bitwiseXOR(x))).alias("block"))


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, start_word: each document and item of at least the similarity.

    items: item_id, text. similarity is the best share of the item's weighted shingles in
    as many words of the document, start_word (from 0) the first place that has it. Items of fewer than `shingle` words match nothing, nor do null or
    shorter texts or rows without an id. Rows of one id count as one document. Other
    columns are not read.
    """
    known = cut(item_table(items, shingle).withColumn("repeat", longest_repeat(F.col("h"), shingle - 1)))
    n_items, longest = known.agg(F.count("*"), F.max("n")).first()
    sized = known.withColumn("own", sure_window(shingle, similarity, longest or shingle))
    sizes = sorted(r.own for r in sized.select("own").distinct().collect())  # powers of two: few
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    hashed = rows.select("doc_id", _hashes(F.col("text")).alias("h"))
    if not n_items:
        return rows.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start_word")).limit(0)

    # every window of an item of its own size, at any word: the item from each of its words on, first windows only
    shifted = sized.select("item_id", "key", "n", "own", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("own") + 1)).alias("from"), "h")
    parts = shifted.select("item_id", "key", "n", "own", (F.col("from") - 1).alias("offset"), F.slice("h", F.col("from"), F.col("own")).alias("h"))
    prints = simhashes(parts, ["item_id", "key", "n", "own", "offset"], sizes).where("size = own and at = 0").select("item_id", "key", "n", "size", "offset", F.col("f").alias("g")).distinct()
    entries = cut(entries_of(prints))

    met = probes_of(simhashes(hashed, ["doc_id"], sizes)).join(broadcast_if_small(entries, entries.count(), BROADCAST_ROWS), "block").where(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= 2 * BLOCKS - 1)
    # a passage that holds the window begins up to n - own words before or after; beginnings are taken together by n words
    cell = F.floor((F.col("at") * F.col("size") / 2 - F.col("offset")) / F.col("n")).cast("int")
    places = cut(met.select("doc_id", "item_id", "key", "n", "size", cell.alias("cell")).distinct())

    by_doc = places.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "key", "n", "size", "cell")).alias("places"))

    def words_at(p: Column) -> Column:
        """The words of all passages that begin from `low` to `high`."""
        low, high = p["cell"] * p["n"] - p["n"] + p["size"], p["cell"] * p["n"] + 2 * p["n"] - p["size"] - 1
        base = F.greatest(low, F.lit(0))
        return F.struct(p["item_id"].alias("item_id"), p["key"].alias("key"), p["n"].alias("n"), base.alias("base"), high.alias("high"), F.slice("h", base + 1, F.greatest(high + p["n"] - base, F.lit(0))).alias("words"))

    # only the words of a place leave the document's row
    words = F.transform("places", words_at)
    # texts are joined, not their hashes: those of documents without a place are never needed, and a shuffle would carry more
    texts = rows.join(broadcast_if_small(by_doc, places.count() * 48, BROADCAST_BYTES), "doc_id")
    found = texts.select("doc_id", _hashes(F.col("text")).alias("h"), "places").select("doc_id", F.inline(words))
    grams = known.select("item_id", "key", "weights", "total", shingles_at(F.col("h"), shingle).alias("grams"))
    cut_out = found.join(broadcast_if_small(grams, known.agg(F.sum(F.size("weights") * 24 + F.col("n") * 8 + 32)).first()[0], BROADCAST_BYTES), ["item_id", "key"])
    # a generator keeps the array from being computed again for every element it is compared with
    here = cut_out.select("*", F.explode(F.array(shingles_at(F.col("words"), shingle))).alias("here")).where(F.arrays_overlap("grams", "here"))
    share = F.round(F.aggregate(F.filter("weights", lambda x: F.array_contains("here", x.s)), F.lit(0.0), lambda a, x: a + x.w) / F.col("total"), 6)
    near = here.where(share >= similarity)  # all words together have no less than one passage
    shared = F.filter(F.transform("here", lambda g, i: F.struct(g.alias("g"), i.alias("i"))), lambda x: F.array_contains("grams", x["g"]))
    froms = F.transform(shared, lambda x: F.transform(F.filter(F.transform("grams", lambda g, q: F.struct(g.alias("g"), q.alias("q"))), lambda y: y["g"] == x["g"]), lambda y: F.greatest(F.col("base") + x["i"] - y["q"], F.lit(0))))
    starts = near.select("*", F.explode(F.array_distinct(F.flatten(froms))).alias("start")).where("start between base and high")
    passages = starts.select("doc_id", "item_id", "start", "weights", "total", F.explode(F.array(F.slice("here", F.col("start") - F.col("base") + 1, F.col("n") - shingle + 1))).alias("here"))
    scored = passages.select("doc_id", "item_id", "start", share.alias("similarity")).where(F.col("similarity") >= similarity)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("b"))
    return best.select("doc_id", "item_id", "b.similarity", (-F.col("b.back")).alias("start_word"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, all columns unchanged; rows without an id stay."""
    return docs.join(contaminated(docs, items).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
