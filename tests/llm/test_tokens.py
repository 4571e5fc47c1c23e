"""Token counts and BPE against the tokenizers library; license scan and language ID against plain versions."""

import hashlib
import random
import re
import zlib

import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfind.llm import bpe_codec, bpe_vocab, language_id, license_scan, token_count

SF = "/root/testdata/sf0.01"
EDGE = [None, "", " ", "a", "it's  <|endoftext|> 12\n\n x", "日本語 text½ ٣　z", "x" * 3000, "ab " * 40_000, " " * 5000 + "end", "퟿\U0010ffff", "é" * 70_000, "tab\t\tx \r\n"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en", 1) for i, t in enumerate(EDGE)] + [(None, "no id", None, 2), (1, "", "en", 1), (1, "", "en", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int")


def same(got, want):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_counts(spark, library, edge):
    for df in (edge, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = df.select("doc_id", "text").collect()
        want = [(r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in rows]
        same(token_count.count_tokens(df).collect(), want)
        same(token_count.count_tokens(df, chunk=100, overlap=8).collect(), want)
    assert token_count.count_tokens(edge.limit(0)).collect() == []


def test_splice_equals_whole():
    bpe, rnd = bpe_vocab.load("byte_bpe_50k.json"), random.Random(1)
    size = {i: len(b) for i, b in bpe.token_bytes.items()}.__getitem__
    for _ in range(300):
        text = "".join(rnd.choice(["a", "é", " ", "\n", "12", "it's", "<|endoftext|>", "日", "word ", "!?"]) for _ in range(rnd.randrange(200)))
        for chunk, overlap in ((16, 2), (31, 30), (64, 8)):
            assert [i for part in token_count.spliced(bpe.encode, size, text, chunk, overlap) for i in part] == bpe.encode(text)


def test_codec(spark, library, edge):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for df in (edge, spark.read.parquet(f"{SF}/documents.parquet")):
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
        same(bpe_codec.encode_decode(df).collect(), want)
        same(bpe_codec.encode_decode(df, words=50).collect(), want)
    assert bpe_codec.encode_decode(edge.limit(0)).collect() == []
    full = bpe_codec.encode_decode(edge, with_ids=True).where("doc_id = 4").first()
    assert full.decoded == EDGE[4] and full.ids == library.encode(EDGE[4]).ids


def test_lexicon_finds_its_words_only():
    rnd = random.Random(2)
    words = {bytes(rnd.choice(b"abc ") for _ in range(rnd.randrange(1, 7))): [rnd.randrange(9), i] for i in range(400)}
    arrays = bpe_codec.compile_lexicon(words)
    lex = bpe_codec.open_mapped(bpe_codec.pack(arrays))
    probes = [*words, b"", b"abcabcabc", *(w + b"x" for w in words), *(w[:-1] for w in words)]
    assert [lex.find(w) for w in probes] == [words.get(w) for w in probes]
    assert [lex.ids[lex.starts[p] : lex.starts[p + 1]].tolist() if p >= 0 else None for p in lex.find_all(probes)] == [words.get(w) for w in probes]
    assert len(arrays["final"]) < sum(map(len, words)) / 2  # prefixes and suffixes are shared
    empty = bpe_codec.open_mapped(bpe_codec.pack(bpe_codec.compile_lexicon({})))
    assert empty.find(b"a") is None and empty.find_all([b"a", b""]).tolist() == [-1, -1]


def test_license(spark, edge):
    more = [(1, "MIT License mit LICENSE", 1), (2, "GNU General-Public License; Apache\nLicense", 1), (3, "Licensed under the Apache License, Version 2.0.", 1), (4, "mit xlicense é license", 1), (5, None, 1), (6, "general public " * 3 + "license", 1)]
    for df in (edge, spark.createDataFrame(more, "doc_id long, text string, labels int"), spark.read.parquet(f"{SF}/documents.parquet")):
        got = license_scan.scan(df).collect()
        want = []
        for r in df.select("doc_id", "text").collect():
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
            at = [(i, lab) for p, lab in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
            want.append((r.doc_id, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
        same([r[:6] for r in got], want)
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(more, "doc_id long, text string, labels int")).collect()}
    assert got[3].labels == "apache,apache-2.0" and got[4].labels == "" and got[3].score == 1.0
    assert license_scan.scan(edge.limit(0)).collect() == []


def test_files_of_several_notices(spark):
    """Against a plain scan: every template at every place."""
    rnd = random.Random(5)
    texts = [text for _, text, _ in license_scan.TEMPLATES]
    files = [" ".join(texts), "\n".join(texts[::-1]), *(f"{a}\n\n{b}" for a in texts for b in texts)]
    for _ in range(150):
        words = " filler ".join(rnd.sample(texts, 4)).split()
        files.append(" ".join(w if rnd.random() < 0.85 else rnd.choice(["changed", "license", "the", ""]) for w in words))
    files += ["plain words of the day " * 50] * 20
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(files)), "doc_id long, text string")).collect()}
    assert len(set("mit apache-2.0 gpl-2.0 gpl-3.0 bsd isc cc-by cc0".split()) & set(got[0].labels.split(","))) == 8
    templates = [(label, license_scan.words_of(text), [license_scan.words_of(k) for k in keys]) for label, text, keys in license_scan.TEMPLATES]
    for i, text in enumerate(files):
        words, found, best = license_scan.words_of(text), set(), 0.0
        for label, body, keys in templates:
            for at in range(-len(body), len(words)):
                share = sum(0 <= at + k < len(words) and words[at + k] == w for k, w in enumerate(body)) / len(body)
                near = words[max(0, at - len(body)) : max(0, at + 2 * len(body))]
                if share >= license_scan.COVER and all(license_scan.places(near, k) for k in keys):
                    found.add(label)
                    best = max(best, share)
        base = set(filter(None, got[i].base_labels.split(",")))
        assert set(filter(None, got[i].labels.split(","))) == found | base
        assert got[i].score == max(best, 0.5 * bool(base))


def phrases(text, sample, block=language_id.BLOCK):
    """Phrases of a plain parse by substring search."""
    n, i = 0, 0
    for at in range(0, len(text), block):
        part, i = text[at : at + block], 0
        while i < len(part):
            m = 1
            while i + m < len(part) and part[i : i + m + 1] in sample and part[i] in sample:
                m += 1
            i, n = i + m, n + 1
    return n


def test_parse_equals_substring_search():
    rnd = random.Random(3)
    samples = {"a": ["".join(rnd.choice("abcd ") for _ in range(400))], "b": ["".join(rnd.choice("cdef ") for _ in range(400))]}
    model = language_id.Model(samples)
    code = lambda t: "".join(map(chr, model.alphabet.symbols(t)))
    for _ in range(60):
        text = "".join(rnd.choice("abcdefg ") for _ in range(rnd.randrange(1, 3000)))
        s = model.alphabet.symbols(text)
        if not s.any():
            continue
        blocks = [s[i : i + language_id.BLOCK] for i in range(0, len(s), language_id.BLOCK)]
        got = model.phrase_breaks(blocks).sum(1) + len(blocks)
        for k, lang in enumerate(model.langs):
            # an unseen symbol is a phrase of its own that the next match continues
            sample = code(samples[lang][0]) + "\0"
            if "g" not in text and all(c in sample for c in code(text)):
                assert got[k] == phrases(code(text), sample)


def test_every_letter_counts():
    """Two scripts of 1,500 letters beside two alphabets: each is told from the other, though no letter of theirs is frequent."""
    rnd = random.Random(8)

    def text(letters, words):
        return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 4))) for _ in range(words))

    scripts = {"han": [chr(0x4E00 + i) for i in range(1500)], "kan": [chr(0x6000 + i) for i in range(1500)], "high": [chr(0x20000 + i) for i in range(1500)], "lat": list("abcdefghijklmnop"), "cyr": list("абвгдежзиклмнопрст")}
    model = language_id.Model({k: [text(v, 3000)] for k, v in scripts.items()})
    for name, letters in scripts.items():
        judged = model.judge([text(letters, 40) for _ in range(40)])
        assert sum(j[0] == name for j in judged) >= 38, name
    a = model.alphabet
    assert len({bytes(a.symbols(c)) for c in scripts["han"] + scripts["kan"] + scripts["high"]}) == 4500
    assert {len(a.symbols(c)) for c in "\u0561\u4e00\U00020000"} == {3, 4, 5} and a.symbols("\u4e00, \u4e00").tolist().count(0) == 1


def test_three_hundred_languages(spark):
    """No language is left unlearned."""
    rnd = random.Random(2)
    vocabulary = {f"l{k}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(3, 8))) for _ in range(30)] for k in range(300)}
    text = lambda lang: " ".join(rnd.choice(vocabulary[lang]) for _ in range(50))
    table = spark.createDataFrame([(i, text(lang), lang) for i, lang in enumerate(k for k in vocabulary for _ in range(3))], "doc_id long, text string, lang string")
    sample = language_id.draw_sample(table)
    assert len(sample) == 300 and language_id.sample_share(300) == 4000 and language_id.sample_share(10_000) == language_id.LEAST
    asked = rnd.sample(sorted(vocabulary), 60)
    judged = language_id.Model(sample).judge([text(lang) for lang in asked])
    assert sum(j[0] == lang for j, lang in zip(judged, asked)) >= 57


def test_language(spark, edge):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).toPandas().merge(docs.select("doc_id", "lang", "text").toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.93, (held.lang_pred == held.lang).mean()
    assert got.score.between(0, 1).all()
    again = language_id.identify(docs.repartition(7)).toPandas().sort_values("doc_id")
    pd.testing.assert_frame_equal(again.reset_index(drop=True), got[again.columns].sort_values("doc_id").reset_index(drop=True))
    rows = {r.doc_id: r for r in language_id.identify(edge).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[2].lang_pred == "und" and rows[2].score == 0
    assert language_id.identify(edge.limit(0)).collect() == []
    assert {r.lang_pred for r in language_id.identify(edge.withColumn("lang", edge.lang.substr(9, 1)).where("1=1").replace("", None, "lang")).collect()} == {"und"}
    kept = language_id.keep_identified(docs)
    assert kept.schema.names == docs.columns and kept.count() >= 0.98 * docs.count()
    # one id with a good and a bad text; a long text alone has its language learned; rows without an id are judged too
    good = docs.where("lang is not null and length(text) > 300").first().text
    odd = "".join(map(chr, range(0x4E00, 0x4E00 + 400)))
    rows = [(4, good, "en", 1), (4, "123", "en", 2), (None, odd, None, 3), (None, good, None, 4), (7, "long letters here " * 40_000, "xx", 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, node int")
    assert sorted(r.node for r in language_id.keep_identified(table).collect()) == [1, 4, 5]
    assert sorted(language_id.draw_sample(table)) == ["en", "xx"] and len("".join(language_id.draw_sample(table)["xx"])) <= language_id.PIECE
    none = table.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r.node for r in language_id.keep_identified(none).collect()) == [1, 3, 4, 5]


def test_sample_is_bounded_and_stable(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    drawn = language_id.draw_sample(docs)
    assert drawn == language_id.draw_sample(docs.repartition(11)) and all(sum(map(len, t)) <= language_id.SYMBOLS for t in drawn.values())
    few = language_id.draw_sample(docs.where("lang in ('en', 'fr')"), rows=3, total=1000)
    assert len(few) == 2 and all(len(t) <= 3 and sum(map(len, t)) <= 500 for t in few.values())


def test_ids_of_control_characters_and_mixes(library):
    """Random mixes of all code points below U+0250, with contractions and every white space."""
    bpe, rnd = bpe_vocab.load("byte_bpe_50k.json"), random.Random(9)
    codec = bpe_codec.Codec(bpe, bpe_codec.Lexicon(bpe_codec.compile_lexicon({b"a": bpe.merge("a")})))
    size = {i: len(b) for i, b in bpe.token_bytes.items()}.__getitem__
    spaces = sorted(bpe_vocab.WHITE)
    for n in range(6000):
        pool = [chr(rnd.randrange(0x250)) for _ in range(4)] + ["'s", "'re", " ", "a", "\x1c", "\x1f", "1"] + ["日", *rnd.sample(spaces, 2)] * (n % 3 == 0)
        text = "".join(rnd.choice(pool) for _ in range(rnd.randrange(3, 21)))
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.encode_decode([text])[0][1] == ",".join(map(str, want)), repr(text)
        assert [i for part in token_count.spliced(bpe.encode, size, text, 8, 2) for i in part] == want, repr(text)
