"""What many questions share is done once: namesakes, titles of many films, frequent tokens, common roles."""

import random

from wayfind.operators import answer, bm25, resolve, traverse
from wayfind.operators import seeds as seed_sources


def test_namesakes(spark):
    people = spark.createDataFrame([(f"p{i}", "가나다" if i % 2 else "라마바", ["가나"] if i % 4 == 1 else [], float(i % 7), i) for i in range(400)], "id string, name string, aliases array<string>, popularity double, seq long")
    labels = people.selectExpr("id", "explode(concat(array(name), aliases)) as label", "popularity", "seq")
    few = resolve.first_alike(labels)
    assert sorted((r.id, r.label) for r in few.collect()) == [("p13", "가나"), ("p13", "가나다"), ("p27", "가나다"), ("p6", "라마바")]
    asked = spark.createDataFrame([(1, "가나다와 라마바의 영화"), (2, "가나 나온 영화"), (3, "라마바는?")], "qid long, question string")
    rows = lambda df: sorted((r.qid, r.rank, r.id, r.label) for r in df.collect())
    assert rows(resolve.people_in(asked, people)) == rows(resolve.longest_hits(resolve.mentioned(asked, labels))) == [(1, 1, "p6", "라마바"), (1, 2, "p13", "가나다"), (2, 1, "p13", "가나"), (3, 1, "p6", "라마바")]


def test_films_of_one_title(spark):
    films = spark.createDataFrame([(f"m{i}", "시" if i else "n1: 밤", float(i % 5), i, i % 3 == 0, i % 11) for i in range(200)], "id string, title string, popularity double, seq long, ko boolean, vote_count int")
    asked = spark.createDataFrame([(1, "《시》와 《n1: 밤》에 모두 출연한 배우는?")], "qid long, question string")
    titles = resolve.titles_in(asked, films)
    assert sorted((r.rank, r.id) for r in titles.collect()) == [(1, "m0"), (2, "m4")]
    assert [r.id for r in seed_sources.from_titles(asked, films).orderBy("pos").collect()] == ["m0", "m4", "m9"]
    credits = [("a", "m0", "ACTED_IN"), ("a", "m150", "DIRECTED"), ("a", "m90", "ACTED_IN"), ("b", "m0", "ACTED_IN"), ("c", "m4", "ACTED_IN")]
    edges = spark.createDataFrame([(*c, 0, i, None) for i, c in enumerate(credits)], "src string, dst string, kind string, ord int, seq long, as_role string")
    people = spark.createDataFrame([(x, x, 1.0, i) for i, x in enumerate("abc")], "id string, name string, popularity double, seq long")
    common, picked = resolve.common_people(asked, titles, films, edges, people)
    assert [(r.qid, r.id, r.acted, r.pos) for r in common.collect()] == [(1, "a", True, 1)]
    assert sorted((r.part, r.id, r.found) for r in picked.collect()) == [(1, "m0", True), (2, "m90", True)]
    shown = answer.cast_list(spark.createDataFrame([(1, ["m150"])], "qid long, seeds array<string>"), titles.limit(0), films, edges, people)
    assert shown.count() == 0  # of the title's films at home, those with most votes have no credits


def test_search_of_many(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, rng.choice(words[:4]), " ".join(rng.choices(words[:6], k=3) + rng.choices(words, k=2))) for i in range(300)], "id long, title string, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words[:5], k=2) + rng.choices(words + ["none"], k=rng.randint(0, 3)))) for i in range(120)], "qid long, text string")
    index = bm25.build_index(docs, asked=asked)
    rows = lambda df: sorted((r.qid, r.pos, r.id, round(r.score, 5)) for r in df.collect())
    want = rows(bm25.search(index, asked, 4))
    assert len(want) > 400
    for frequent in (0, 25, 80, 1000):
        assert rows(bm25.search_many(index, asked, 4, frequent=frequent)) == want


def test_common_roles(spark):
    rng = random.Random(7)
    roles = ["Ga-na", "Na-da", "Ga-da", "Da-ra ma", "가나", None]
    parts = spark.createDataFrame([(f"m{rng.randrange(30)}", f"p{i % 50}", "ACTED_IN" if i % 5 else "DIRECTED", i, rng.choice(roles)) for i in range(400)], "dst string, src string, kind string, seq long, as_role string")
    cands = spark.createDataFrame([(q, c) for q in range(9) for c in rng.sample(["가나", "나다", "가다", "라마", "없다"], 2)], "qid long, cand string")
    scope = spark.createDataFrame([(q, f"m{q * 3 + i}", i) for q in range(9) for i in range(2)], "qid long, dst string, rank int")
    got = seed_sources.cast_within(seed_sources.role_names(cands, parts), scope, parts)
    want = seed_sources.cast_as(cands, parts).join(scope, ["qid", "dst"])
    columns = ["qid", "cand", "dst", "src", "seq", "as_role", "rank"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows(got) == rows(want) and len(rows(got)) > 20


def test_reach_past_large_nodes(spark):
    rng = random.Random(3)
    links = {(f"a{i}", f"b{rng.randrange(40)}") for i in range(120)} | {(f"a{i}", f"n{i % 3}") for i in range(120)} | {(f"a{i}", "n1") for i in range(0, 120, 4)} | {(f"b{i}", f"n{i % 2}") for i in range(40)}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    hubs = ["n2"]
    want = {a: len(near[a] | {c for b in near[a] if b not in hubs for c in near[b]} - {a}) for a in near if a[0] == "a"}
    edges = spark.createDataFrame([(a, b) for a, v in near.items() for b in v], "src string, target string")
    begin = spark.createDataFrame([(a,) for a in want], "id string")
    for large in (1, 20, 1000):
        got = traverse.reach_two_hops(begin, edges, spark.createDataFrame([(h,) for h in hubs], "id string"), large)
        assert {r.id: r.reached for r in got.collect()} == want


def test_walk_past_large_nodes(spark):
    """Walks through nodes of more edges than a hop needs equal sequential ones; what lies beyond is counted, not listed."""
    rng = random.Random(11)
    nodes = [f"n{i:03}" for i in range(90)]
    links = sorted({(rng.choice(nodes), rng.choice("AB"), rng.choice(nodes)) for _ in range(120)} | {(f"n{h:03}", "A", n) for h in (0, 1) for n in rng.sample(nodes, 50)} | {(n, "B", "n002") for n in rng.sample(nodes, 50)} | {("n000", "A", "n001"), ("n001", "B", "n000"), ("n002", "A", "n001")})
    near = {n: [(k, b) for a, k, b in links if a == n] + [(k, a) for a, k, b in links if b == n] for n in nodes}
    asked = {q: rng.sample(nodes[:30], rng.randrange(1, 4)) for q in range(30)}
    n = spark.createDataFrame([(x,) for x in nodes], "id string")
    e = spark.createDataFrame([(*x, i) for i, x in enumerate(links)], "src string, kind string, dst string, seq long")
    s = spark.createDataFrame([(q, i, x) for q, v in asked.items() for i, x in enumerate(v)], "qid long, pos int, id string")
    got = {r.qid: r for r in traverse.expand_undirected(s, n, e, n.limit(0), max_hops=2, max_nodes=14, per_kind=4).collect()}
    listed = traverse.ranked_edges(traverse.near_edges(e)).where("nth <= 18 and src = 'n000'").count()
    assert listed < len({(k, b) for k, b in near["n000"]})
    for q, first in asked.items():
        order, used, dropped, front = list(first), {}, 0, list(first)
        for _ in range(2):
            if len(order) >= 14:
                break
            new = []
            for kind, other in (x for cur in front for x in near[cur]):
                if other in order:
                    continue
                if len(order) >= 14 or used.get(kind, 0) >= 4:
                    dropped += 1
                    continue
                used[kind] = used.get(kind, 0) + 1
                order.append(other)
                new.append(other)
            front = new
        assert (got[q].ids, got[q].dropped) == (order, dropped), q
