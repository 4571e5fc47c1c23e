"""Exact dedup, collocations and the prefix trie against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wayfind.llm import collocations, exact_dedup, golomb, prefix_trie, queries

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.mark.parametrize("bits", [4, 20, 44, 63])
def test_golomb(bits):
    rnd = random.Random(bits)
    for n in (0, 1, 2, 15, 1000):
        numbers = np.array(sorted(rnd.sample(range(1 << min(bits, 40)), min(n, 1 << bits))), np.uint64) << np.uint64(max(0, bits - 40))
        rest = golomb.rest_bits(len(numbers), bits)
        unary, low = golomb.encode(numbers, rest)
        assert (golomb.decode(unary, low, len(numbers), rest) == numbers).all()
        if n == 1000 and bits > 20:
            assert 8 * (len(unary) + len(low)) < n * (bits - np.log2(n) + 2.2)


def exact_brute(rows):
    norm = [(i, SPACE.sub(" ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in norm:
        if i is not None:
            groups[t].append(i)
    out = []
    for i, t in norm:
        own = groups[t] if i is not None else [i]
        keep = min(own) if i is not None else None
        out.append((i, keep, len(own), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup(spark):
    rnd = random.Random(3)
    rows = [(i, f"text {rnd.randrange(60)}" + rnd.choice(["", " ", "\n", "\t \r\n"]) + rnd.choice(["x", "é"])) for i in range(300)]
    rows += [(1000 + i, "hot\ttext") for i in range(200)] + [(5, None), (6, ""), (7, " "), (8, "\n\n"), (None, "hot text"), (None, None), (1000, "hot text"), (1000, "hot text"), (9, "a\xa0b"), (10, "a b"), (11, "y" * 500_000), (12, "y" * 500_000)]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, h string, keep_id int").repartition(7)
    want = exact_brute(rows)
    for sizes in ({}, {"flush_rows": 20, "owned": 4}, {"extra": 0}, {"extra": 60}):
        assert sorted(map(tuple, exact_dedup.find(docs, **sizes).collect()), key=str) == want
    assert exact_dedup.find(docs.limit(0)).collect() == []


def test_exact_dedup_suspects(spark):
    """Suspects are all repeated fingerprints, and few others."""
    hashes = spark.range(20_000).selectExpr("xxhash64(if(id < 19000, id, id - 1000)) as h").repartition(9)
    found, shift = exact_dedup.suspects(hashes, 20_000, 500, 1000)
    want = {r.h for r in hashes.groupBy("h").count().where("count > 1").collect()}
    got = {r.fp for r in found.collect()}
    assert len(want) == 1000 and {(h % 2**64) >> shift for h in want} <= got and len(got) < 1000 + 60


def mined_brute(rows, least, top):
    counts, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, 6):
                for p in range(len(w) - k + 1):
                    counts[lang][tuple(w[p : p + k])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least}
        inside = {p[i:j] for p, a in often.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and often[p[i:j]] <= a}
        ranked = []
        for p, a in often.items():
            if len(p) > 1 and p not in inside:
                score, k = min((1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n, p.decode(), -a, left, right, words[lang], -score) for n, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def docs_of(spark, rows):
    return spark.createDataFrame([(lang, t, 1, "x") for lang, t in rows], "lang string, text string, name int, slot string").repartition(5)


def test_collocations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()]
    want = mined_brute(rows, 4, 50)
    assert sorted(map(tuple, collocations.mine(docs_of(spark, rows), least=4, top=50).collect())) == want
    # bursts, spills, chunks that end within phrases, and many partitions
    small = collocations.mine(docs_of(spark, rows), least=4, top=50, limit=3000, burst=20, chunk=97, entries=500)
    assert sorted(map(tuple, small.collect())) == want


def test_collocations_awkward(spark):
    rows = [("en", "A b a b.a b, a\tb\na b c d e f"), ("en", None), (None, "A b a b"), ("und", "a  b"), ("xx", ""), ("xx", " . "), ("en", "É b É b é b"), ("en", "q" * 100_000 + " a b"), ("long", "a b c " * 3000), ("long", "a b c " * 3000)]
    for least in (1, 2, 3):
        want = mined_brute(rows, least, 2000)
        assert sorted(map(tuple, collocations.mine(docs_of(spark, rows), least=least, chunk=1000).collect())) == want
    assert collocations.mine(docs_of(spark, rows).limit(0)).collect() == []


def test_front_coding():
    rng = np.random.default_rng(1)
    rows = rng.integers(1, 4, (2000, 5)).astype(np.uint64)
    rows[np.arange(5) >= rng.integers(2, 6, 2000)[:, None]] = 0
    rows = np.unique(rows, axis=0)
    for some in (rows, rows[:1]):
        assert (collocations.from_front_coded(*collocations.front_coded(some), 5) == some).all()


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 10)
    text = b"one two, three four five.six"
    assert sum(collocations.words_of(text), []) == [b"one", b"two", b".", b"three", b"four", b"five", b".", b"six"]


def trie_brute(rows, rebuild=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in convs.items()}
    if rebuild:
        full = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 6
            full[c] = own.get(int(c / 100) * 100, [])[:h] + turns[h:]  # towards zero, as SQL divides
    else:
        full = own
    members = defaultdict(list)
    for c, turns in sorted(full.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in m if len(full[c]) == len(node))
        out.append((m[0], len(node), members[node[:-1]][0] if node else None, len(m), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, s1 string").repartition(6)


def test_prefix_trie(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(c, t, rnd.choice(["user", None]), rnd.choice(["a", "é😀", "", None, "bb"])) for c in range(180) for t in range(rnd.randrange(1, 5))]
    rows += [(1000, t, "user", f"t{t}") for t in range(70)] + [(1001, t, "user", f"t{t}") for t in range(67)] + [(1002, t, "user", f"t{min(t, 60)}") for t in range(70)]
    rows += [(c, t, "user", f"same {t}") for c in range(5000, 5090) for t in range(8)]  # copies
    rows += [(2001, 3, "a", "x"), (2001, None, "a", "y"), (2001, 3, "a", "x"), (2001, 3, "a", "w"), (None, 1, "a", "b"), (-7, 1, "a", "b")]
    turns = prefix_trie.numbered(talk(spark, rows)).cache()
    want = trie_brute(rows)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    for height in (4, 16):
        got = prefix_trie.trie(*prefix_trie.share_openings(turns), height)
        assert sorted(map(tuple, got.collect()), key=str) == want
    plain = prefix_trie.shared_prefixes(talk(spark, rows))
    assert sorted(map(tuple, plain.collect()), key=str) == trie_brute(rows, rebuild=False)


def test_prefix_trie_awkward(spark):
    none = talk(spark, [(None, 1, "a", "b")])
    assert prefix_trie.shared_prefixes(none).collect() == []
    # an opening of one turn at most of a conversation that isn't there: conversation 102 loses its own first turns
    one = [(102, 0, "a", "b")]
    turns = prefix_trie.numbered(talk(spark, one))
    assert sorted(map(tuple, prefix_trie.trie(*prefix_trie.share_openings(turns)).collect()), key=str) == trie_brute(one)


def test_registered(spark):
    assert {"op11_exact_dedup", "op12_collocations", "op13_prefix_trie"} <= set(queries.QUERIES) & set(queries.ORACLE_SQL)
