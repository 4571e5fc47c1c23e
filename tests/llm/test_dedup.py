"""The dedup operators against brute force, on a small table and on awkward rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from wayfind.llm import embedding_dedup, minhash_dedup, substring_dedup
from wayfind.llm.common import connected_components

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def near_brute(rows, k):
    sets = []
    for _, t in rows:
        w = WORDS.findall(lower(t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    c = components([i for i, _ in rows], links)
    return sorted((i, len(s), c[i], i == c[i]) for (i, _), s in zip(rows, sets))


def repeats_brute(rows, width=13):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < i:
                gone.update(range(p, p + width))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def corpus():
    """Random texts, a large group of near copies around the threshold, short and equal texts."""
    rnd = random.Random(5)
    base = [f"b{rnd.randrange(400)}" for _ in range(60)]
    rows = [" ".join(edited(rnd, base, rnd.choice([0, 1, 1, 2, 3, 4, 6]))) for _ in range(90)]
    rows += [" ".join(f"c{rnd.randrange(300)}" for _ in range(rnd.randrange(1, 80))) for _ in range(60)]
    shared = [f"s{i}" for i in range(30)]
    rows += [" ".join(edited(rnd, [f"d{rnd.randrange(900)}" for _ in range(40)], 3)[:20] + shared[rnd.randrange(3) : 13 + rnd.randrange(17)]) for _ in range(30)]
    rows += ["", " \n ", None, "One", "one", "a b", "A\tb", "a b c d e", "a b c d e f", "é É", "é é", "x " * 5000, "x " * 4000]
    ids = rnd.sample(range(10_000), len(rows))
    return list(zip(ids, rows))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, component string")


def check_near(spark, rows, k):
    got = sorted(map(tuple, minhash_dedup.dedup(frame(spark, rows), shingle=k).collect()))
    assert got == near_brute(rows, k)


def test_near(spark, corpus):
    check_near(spark, corpus, 2)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_near(spark, docs, 2)
    check_near(spark, docs, 5)


def test_near_awkward(spark, corpus):
    assert minhash_dedup.dedup(frame(spark, corpus).limit(0)).collect() == []
    rows = minhash_dedup.dedup(frame(spark, [(None, "a b c"), (5, "a b c"), (3, "a b c"), (3, "a b c"), (7, None)]), shingle=2).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (3, 3, True), (3, 3, True), (5, 3, False), (7, 7, True)]
    kept = minhash_dedup.keep_one(frame(spark, [(None, "a"), (3, "a b"), (3, "a b"), (4, "a b"), (9, None)]))
    assert kept.columns == ["doc_id", "text", "node", "component"] and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 9]


def test_repeats(spark, corpus):
    for rows in (corpus, [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]):
        assert sorted(map(tuple, substring_dedup.remove_repeats(frame(spark, rows)).collect())) == repeats_brute(rows)


def test_repeats_in_small_flushes(spark, corpus):
    for words, entries in ((1_500_000, 1_500_000), (100, 7), (1, 1), (1000, 100)):
        got = substring_dedup.remove_repeats(frame(spark, corpus).repartition(13), flush_words=words, range_entries=max(entries, 50)).collect()
        assert sorted(map(tuple, got)) == repeats_brute(corpus)


def test_repeats_awkward(spark):
    long = " ".join(map(str, range(20)))
    rows = substring_dedup.remove_repeats(frame(spark, [(None, long), (2, long), (2, long), (3, long + " end"), (4, None)]), with_text=True).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept) for r in rows) == [(-1, 20, 0, long), (2, 20, 0, long), (2, 20, 0, long), (3, 21, 20, "end"), (4, 0, 0, "")]
    assert substring_dedup.remove_repeats(frame(spark, [(1, "a")]).limit(0)).collect() == []


@pytest.mark.parametrize("copies", [1, 2, 3, 4])
def test_repeats_of_repeated_rows(spark, copies):
    """A document that loses words comes back as often as it was given, however its copies are dealt out."""
    rnd = random.Random(copies)
    first = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(first)), (9, " ".join(first[:20] + ["other"] + first[30:]))] + [(2, " ".join(first[5:50]))] * copies + [(2, " ".join(first[10:40]) + " another text")] * copies
    rows += [(i, " ".join(f"x{rnd.randrange(50)}" for _ in range(40))) for i in range(20, 40)]
    want = repeats_brute(rows)
    for parts, sizes in ((1, {}), (5, {}), (3, {"flush_words": 70, "range_entries": 40})):
        got = substring_dedup.remove_repeats(frame(spark, rows).repartition(parts), **sizes).collect()
        assert sorted(map(tuple, got)) == want


def test_pairs_at_each_distance(spark):
    """Planted pairs from a cosine of 0.93 to 0.99 among others of their label: at least nine of ten of each are found."""
    rng = np.random.default_rng(8)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    noise, rows, planted = unit(rng.normal(size=(2500, 48))), [], {}
    for c in (0.935, 0.95, 0.97, 0.99):
        a, b = unit(rng.normal(size=(150, 48))), rng.normal(size=(150, 48))
        b = unit(b - (a * b).sum(1, keepdims=True) * a)
        planted[c] = range(len(rows), len(rows) + 300, 2)
        rows += [v for pair in zip(a, c * a + np.sqrt(1 - c * c) * b) for v in pair]
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate([*rows, *noise])], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.dedup(table).collect()}
    for c, firsts in planted.items():
        assert np.mean([got[i + 1].component_id == i and got[i].n_links == got[i + 1].n_links == 1 for i in firsts]) >= 0.9, c
    assert all(got[i].n_links == 0 for i in range(len(rows), len(rows) + len(noise)))
    assert [embedding_dedup.layout(n, 0.93)[1] for n in (10, 5000, 10**6, 10**12)] == [8, 15, 22, 28]


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(8, 64))
    near = np.concatenate([b + rng.normal(size=(60, 64)) * s for b, s in zip(base, (0.05, 0.1, 0.15, 0.2, 0.25, 0.28, 0.3, 0.32))])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(np.concatenate([near, near[:40], rng.normal(size=(200, 64))]))]
    rows += [(9000, None, 1), (9001, [0.0] * 64, 1), (9002, [math.nan] * 64, 1), (9003, [None] * 64, 1), (9004, near[0].tolist(), None), (9005, [1.0, 2.0], 1), (9006, [2.0, 4.0], 1), (9007, [], 1), (None, near[0].tolist(), 0)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    got = {r.vec_id: r for r in embedding_dedup.dedup(table).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v), g) for i, v, g in rows if i is not None and i < 9000]
    m, lab = np.stack([v / np.linalg.norm(v) for _, v, _ in good]), np.array([g for *_, g in good])
    linked = (m @ m.T >= 0.93) & (lab[:, None] == lab) & ~np.eye(len(m), dtype=bool)
    counts = np.array([got[i].n_links for i, *_ in good])
    assert (counts <= linked.sum(1)).all() and counts.sum() >= 0.9 * linked.sum()
    true = components(range(len(good)), zip(*np.nonzero(linked)))
    assert np.mean([got[i].component_id == true[i] for i in true]) > 0.95
    assert got[9005].component_id == got[9006].component_id == 9005 and got[9006].n_links == 1 and not got[9006].kept
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (9000, 9001, 9002, 9003, 9004, 9007)) and got[None].kept
    assert embedding_dedup.dedup(table.limit(0)).collect() == []


def tasks_of(spark, group, run):
    """What run() gives, and how many tasks Spark had to run for it."""
    spark.sparkContext.setJobGroup(group, group)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = run()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))


def test_components_stop_at_stars(spark):
    """Stars are components already: one round, not another that finds nothing to change; a chain and nothing at all still come out right."""
    stars = [(i, i % 7) for i in range(7, 400)]
    for name, links, most in (("stars", stars, 80), ("chain", [(i, i + 1) for i in range(40)], 290), ("none", [], 20)):
        df = spark.createDataFrame(links, "a long, b long").repartition(4)
        got, tasks = tasks_of(spark, f"components-{name}", lambda df=df: sorted(map(tuple, connected_components(df).collect())))
        ids = {x for e in links for x in e}
        assert got == sorted(components(ids, links).items())
        assert tasks <= most


def test_near_shuffles_no_more_than_it_needs(spark):
    """Groups with outsiders, so that all steps run: every task of a step is kept account of in the driver's memory."""
    rnd = random.Random(5)
    rows, base = [], [f"w{i}" for i in range(120)]
    for group in range(3):
        words = [f"g{group}{w}" for w in base]
        rows += [(len(rows) + i, " ".join(edited(rnd, words, 1 + i % 9))) for i in range(60)]
    got, tasks = tasks_of(spark, "near", lambda: sorted(map(tuple, minhash_dedup.dedup(frame(spark, rows).repartition(4), shingle=5).collect())))
    assert got == near_brute(rows, 5)
    assert tasks <= 700
