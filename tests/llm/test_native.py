"""The native operators and the pipeline: against plain versions, SQL, and on awkward rows."""

import datetime as dt
import hashlib
import os
import random

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_dedup import near_brute
from tokenizers import Tokenizer

import corpus_pipeline
from wayfind.llm import decontaminate, language_id, line_dedup, minhash_dedup, queries, url_filter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in os.listdir(SF):
        db.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    got = queries.QUERIES[name](spark, SF)
    want = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: [(x is None, str(x)) for x in r]
    tidy = lambda x: float(x) if type(x).__name__ in ("Decimal", "float") else x
    assert sorted((tuple(tidy(r[c]) for c in names) for r in got.collect()), key=key) == sorted((tuple(map(tidy, r)) for r in want.fetchall()), key=key)


def test_urls(spark):
    day = lambda n: dt.date(2024, 1, n)
    entries = spark.createDataFrame([("bad.com", True, day(5)), ("bad.com", False, day(10)), ("bad.com", True, day(10)), ("bad.com", False, day(20)), ("ok.org/a", True, day(1)), (None, True, day(1)), ("x.net", None, day(1)), ("bad.com", True, day(5))], "pattern string, listed boolean, as_of date")
    rows = [(1, "http://www.bad.com/x", day(4)), (2, "HTTP://WWW.BAD.com:80/x?q#f", day(5)), (3, "http://bad.com", day(19)), (4, "http://bad.com", day(20)), (5, "https://ok.org/a/b", day(3)), (6, "https://ok.org/ab", day(3)), (7, None, day(3)), (8, "no url", day(3)), (9, "http://bad.com", None), (2, "http://www.bad.com/x", day(4)), (None, "http://bad.com", day(6)), (1, "http://www.bad.com/x", day(4)), (10, "http://u:p@bad.com/" + "s/" * 3000, day(6))]
    got = url_filter.filter_captures(spark.createDataFrame([(*r, "z") for r in rows], "page_id int, url string, fetched date, pattern string"), entries).collect()
    assert len(got) == len(rows)
    assert sorted((r.page_id or 0, r.blocked) for r in got) == sorted([(1, False), (1, False), (2, True), (2, False), (3, True), (4, False), (5, True), (6, False), (7, False), (8, False), (9, False), (0, True), (10, True)])
    assert url_filter.filter_captures(spark.createDataFrame([], "page_id int, url string, fetched date"), entries).collect() == []
    assert not url_filter.filter_captures(spark.createDataFrame([(1, "http://bad.com", day(6))], "page_id int, url string, fetched date"), entries.limit(0)).first().blocked


def lines_brute(rows, run):
    first = {}
    for i, text in sorted((i, t) for i, t in rows if t is not None):
        lines = text.split("\n")
        for p in range(len(lines) - run + 1):
            first.setdefault(tuple(lines[p : p + run]), (i, p))
    out = []
    for i, text in rows:
        lines = text.split("\n") if text is not None else []
        gone = {q for p in range(len(lines) - run + 1) if first[tuple(lines[p : p + run])] < (i, p) for q in range(p, p + run)}
        out.append((i, len(lines), len(gone), None if text is None else "\n".join(x for p, x in enumerate(lines) if p not in gone)))
    return sorted(out, key=str)


def test_lines(spark):
    rnd = random.Random(9)
    rows = [(i, "\n".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(0, 12)))) for i in rnd.sample(range(1000), 60)] + [(2000, None), (2001, ""), (2002, "same\n" * 500), (2003, "z" * 100_000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, start int")
    for run in (1, 2, 3):
        got = line_dedup.remove_repeated_runs(df, run).select("doc_id", "n_lines", "n_removed", "kept").collect()
        assert sorted(map(tuple, got), key=str) == lines_brute(rows, run)
    assert line_dedup.remove_repeated_runs(df.limit(0)).collect() == []
    twice = line_dedup.remove_repeated_runs(spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (2, "x\na\nb"), (None, "a\nb")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in twice) == [(0, "a\nb"), (1, "a\nb"), (1, "a\nb"), (2, "x")]
    short = line_dedup.shorten(spark.createDataFrame([(1, "a\nb", 3, "k"), (2, "a\nb\nc", 5, "k"), (3, "a\nb", 3, "k"), (4, None, 0, "k"), (None, "a\nb", 3, "k")], "doc_id long, text string, n_chars long, lang string"))
    assert sorted(map(tuple, short.collect()), key=str) == sorted([(1, "a\nb", 3, "k"), (2, "c", 1, "k"), (4, None, 0, "k"), (None, "a\nb", 3, "k")], key=str)


def simhash(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) >= len(hashes))


def test_simhashes(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, [rnd.randrange(-(2**63), 2**63) for _ in range(n)]) for i, n in enumerate([0, 1, 3, 4, 7, 8, 33, 70])]
    df = spark.createDataFrame(rows, "i int, h array<long>")
    want = sorted((i, s, k, simhash([x & (2**64 - 1) for x in h[k * s // 2 : k * s // 2 + s]])) for i, h in rows for s in (2, 8, 16) for k in range(max(0, (len(h) - s) // (s // 2) + 1)))
    for unrolled in (64, 4):
        monkeypatch.setattr(decontaminate, "UNROLLED", unrolled)
        got = sorted((r.i, r.size, r.at, r.f & (2**64 - 1)) for r in decontaminate.simhashes(df, ["i"], [2, 8, 16]).collect())
        assert got == want
    assert [decontaminate.window_size(n) for n in (5, 10, 11, 22, 23, 46, 47)] == [4, 4, 8, 8, 16, 16, 32]


def test_block_lookups(spark, monkeypatch):
    """Windows within 2 * BLOCKS - 1 bits meet, and others hardly ever: else each window of the corpus is compared with many."""
    rnd = random.Random(5)
    word = lambda: rnd.randrange(2**64)
    signed = lambda x: x - 2**64 if x >> 63 else x
    prints = [simhash([word() for _ in range(8)]) for _ in range(1500)]
    items = spark.createDataFrame([(i, 8, signed(g)) for i, g in enumerate(prints)], "item int, size int, g long")

    def met(fingerprints, size=8):
        windows = spark.createDataFrame([(i, size, signed(f)) for i, f in enumerate(fingerprints)], "doc int, size int, f long")
        return decontaminate.probes_of(windows).join(decontaminate.entries_of(items), "block")

    far = [simhash([word() for _ in range(8)]) for _ in range(1500)]
    near = [g ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(2 * decontaminate.BLOCKS))) for g in prints]
    assert met(far).count() < 15
    assert met(near).where("doc = item").select("doc").distinct().count() == len(prints)
    assert met(near, 4).count() == 0
    monkeypatch.setattr(decontaminate, "BLOCKS", 4)
    assert met(far).count() > 1500


def test_contaminated(spark):
    rnd = random.Random(6)
    say = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    items = {i: say(n) for i, n in enumerate([5, 6, 9, 14, 20, 36, 59, 100, 300])}
    items[20] = ["four", "words", "are", "few"]
    docs, planted = {}, set()
    for i, w in items.items():
        if i != 20:
            docs[100 + i] = say(rnd.randrange(80)) + w + say(rnd.randrange(80))
            planted.add((100 + i, i))
    edited = list(items[6])
    edited[2] = "changed"
    docs[200] = say(40) + edited + say(7)  # one word of 59
    planted.add((200, 6))
    docs |= {300 + i: say(150) for i in range(30)}
    rows = [(i, " ".join(w).upper() + ".", 1) for i, w in docs.items()] + [(400, None, 1), (401, "", 1), (None, " ".join(items[5]), 1), (105, " ".join(docs[105]), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, ", ".join(w)) for i, w in items.items()] + [(None, "a b c d e f"), (21, None)], "item_id long, text string")
    got = decontaminate.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted and len(got) == len(planted)
    assert all(r.similarity >= 0.8 for r in got) and {r.similarity for r in got if r.doc_id != 200} == {1.0}
    kept = decontaminate.keep_clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {None, 400, 401, *(300 + i for i in range(30))}
    assert decontaminate.contaminated(df.limit(0), bench).collect() == [] == decontaminate.contaminated(df, bench.limit(0)).collect()


def test_near_copies_of_items(spark):
    """Passages edited in every way that leaves about 0.8 of the shingles, against OP4_SQL."""
    rnd = random.Random(8)
    say = lambda n, of=5000: [f"w{rnd.randrange(of)}" for _ in range(n)]
    items = {n: say(n) for n in (5, 7, 10, 11, 12, 16, 24, 29, 47, 50, 55, 59, 96, 120)}
    common = say(30)
    items |= {200 + k: common + say(12) for k in range(4)} | {300 + k: say(40, of) for k, of in enumerate((3, 6, 12, 30))}
    docs = {}

    def plant(words):
        docs[1000 + len(docs)] = say(rnd.randrange(40)) + words + say(rnd.randrange(40))

    for w in items.values():
        n, lost = len(w), (len(w) - 4) // 5
        for run in {1, max(1, lost - 4), max(1, lost - 3)}:  # one replaced run
            for at in (0, n // 3, n // 2, n - run):
                plant(w[:at] + say(run) + w[at + run :])
        for k in {lost, lost + 1}:  # cut ends
            plant(w[k:])
            plant(w[: n - k])
            plant(w[k // 2 : n - (k + 1) // 2])
        for edits in range(1, lost // 4 + 2):  # even edits: words replaced, put in, left out; pieces in another order
            marks = [n * (k + 1) // (edits + 1) for k in range(edits)]
            plant([x for i, x in enumerate(w) for x in (say(1) if i in marks else [x])])
            plant([x for i, x in enumerate(w) for x in (say(1) + [x] if i in marks else [x])])
            plant([x for i, x in enumerate(w) if i not in marks])
            pieces = [w[a:b] for a, b in zip([0, *marks], [*marks, n])]
            plant([x for piece in pieces[::-1] for x in piece])
    for k in range(4):
        plant(items[200 + k][26:])  # the common part has little weight
        plant(say(30) + items[200 + k][30:])
    docs = {i: " ".join(w) for i, w in docs.items()}
    bench = {i: " ".join(w) for i, w in items.items()}
    db = duckdb.connect()
    for name, col, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", bench)):
        db.execute(f"create table {name} ({col} bigint, text varchar)")
        db.executemany(f"insert into {name} values (?, ?)", list(rows.items()))
    want = {(i, j): (float(x), s) for i, j, x, s in db.execute(queries.OP4_SQL).fetchall()}
    got = decontaminate.contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(bench.items()), "item_id long, text string")).collect()
    assert len(want) > 200 and len(got) == len(want)
    for r in got:
        similarity, start = want[r.doc_id, r.item_id]
        assert abs(r.similarity - similarity) < 2e-6 and r.start_word == start


def test_pipeline(spark):
    """Each stage's rows, on its own input, against a plain version."""
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs.collect(), stage(spark, docs, SF)
        rows = out.collect()
        texts = {r.doc_id: r.text for r in before}
        if name == "language_id":
            judged = {r.doc_id: r for r in language_id.identify(docs).collect()}
            fits = lambda r: r.lang_pred != "und" and (r.symbols < language_id.FIT_SYMBOLS or r.bits <= language_id.FIT_BITS)
            want = {r for r in before if any(c.isalpha() for c in r.text or "") and fits(judged[r.doc_id])}
            assert len(want) > 0.9 * len(before)
        elif name == "line_dedup":
            short = {i: (text, gone) for i, _, gone, text in lines_brute([(r.doc_id, r.text) for r in before], line_dedup.RUN)}
            want = set()
            for r in before:
                text, gone = short[r.doc_id]
                if gone == 0:
                    want.add(r)
                elif gone < len(r.text.split("\n")):
                    want.add(type(r)(**(r.asDict() | {"text": text, "n_chars": len(text)})))
        elif name == "near_dedup":
            stay = {i for i, _, c, _ in near_brute([(r.doc_id, r.text) for r in before], 5) if i == c}
            want = {r for r in before if r.doc_id in stay}
        elif name == "decontamination":
            db = duckdb.connect()
            db.execute(f"create table benchmark as select * from '{SF}/benchmark.parquet'")
            db.execute("create table documents (doc_id bigint, text varchar)")
            db.executemany("insert into documents values (?, ?)", list(texts.items()))
            hit = {r[0] for r in db.execute(queries.OP4_SQL).fetchall()}
            want = {r for r in before if r.doc_id not in hit}
        else:
            ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}
            assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {(i, len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, x in ids.items()}
            break
        assert out.columns == docs.columns
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, want), key=str), name
        kept[name] = len(rows)
        docs = spark.createDataFrame(rows, docs.schema)
    done = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, rows)) and done.count() == kept["decontamination"] > 0


def test_one_id_with_several_texts(spark):
    """A row is near to another by its own text; of one id the row of the smallest text hash stays."""
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, 1), (2, words, 2), (3, "other text of its own here", 3), (3, "a second text of this id", 4), (None, words, 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, nth int")
    for df in (table, table.repartition(3)):
        got = minhash_dedup.keep_one(df).collect()
        assert sorted((r.doc_id or -1) for r in got) == [-1, 1, 3] and table.columns == minhash_dedup.keep_one(df).columns
    assert {r.nth for r in minhash_dedup.keep_one(table).collect()} == {r.nth for r in minhash_dedup.keep_one(table.repartition(4)).collect()}


def test_fingerprints_are_selected(spark):
    """At a window of four, under half of the lines are fingerprints; tables whose columns have the operator's names pass."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").withColumn("text_key", F.xxhash64("text"))
    lines = docs.select(F.sum(F.size(F.split("text", "\n")))).first()[0]
    assert 0 < line_dedup.fingerprints(docs, 4).count() < lines / 2
    odd = spark.createDataFrame([(1, "a\nb", "x", "y"), (2, "a\nb\nc", "x", "y")], "doc_id long, text string, found string, __id string")
    assert sorted(map(tuple, line_dedup.shorten(odd).collect())) == [(1, "a\nb", "x", "y"), (2, "c", "x", "y")]
