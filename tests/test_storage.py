"""What is stored: adjacency in buckets, results once in a session, triples without their repeats."""

import re

from pyspark.sql import functions as F

from wayfind.operators import etl, shared, traverse


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hops_leave_the_edges_where_they_are(spark):
    """In the plan of a hop nothing but the frontier is exchanged before the join with stored edges."""
    rows = [(f"n{i % 50}", f"n{(i * 7 + 1) % 50}", "K", i) for i in range(400)]
    edges = spark.createDataFrame(rows, "src string, dst string, kind string, seq long")
    near = shared.bucketed(traverse.near_edges(edges), "src")
    front = spark.createDataFrame([(1, 0, "n1"), (1, 1, "n2"), (2, 0, "n1")], "qid long, fpos int, src string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = front.join(near, "src")
        plan = executed(met)
        assert len(re.findall(r"Exchange hashpartitioning", plan.split("Initial Plan")[0])) == 1 and "Bucketed: true" in plan, plan
        assert met.count() == front.join(traverse.near_edges(edges), "src").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    nodes = near.select(F.col("src").alias("id")).distinct()
    seeds = spark.createDataFrame([(q, 0, f"n{q}") for q in range(5)], "qid long, pos int, id string")
    hubs = spark.createDataFrame([("n3",)], "id string")
    walk = lambda **x: sorted((r.qid, r.ids, r.dropped, r.blocked) for r in traverse.expand_undirected(seeds, nodes, edges, hubs, max_nodes=20, per_kind=6, **x).collect())
    assert walk(near=near) == walk()


def test_stored_once(spark):
    made = []

    def make():
        made.append(1)
        return spark.range(10).withColumn("k", F.col("id") % 3)

    first, second = shared.stored(spark, make, "a test"), shared.stored(spark, make, "a test")
    assert len(made) == 1 and first.count() == second.count() == 10
    assert shared.stored(spark, make, "a test", by=("k",)).groupBy("k").count().count() == 3 and len(made) == 2
    shared.forget()
    shared.stored(spark, make, "a test")
    assert len(made) == 3


def test_merged_triples(spark):
    rows = [("a", "K", "b", q, d, i) for i, (q, d) in enumerate([("q2", "d1"), ("q1", "d1"), ("q2", "d2"), ("q3", None), ("q1", "d1")])] + [("c", "K", "d", "q", "d", 9)]
    edges = spark.createDataFrame(rows, "src string, kind string, dst string, quote string, doc string, seq long")
    got = {r.src: r for r in etl.merge_triples(edges).collect()}
    assert got["a"].quotes == ["q2", "q1", "q3"] and got["a"].docs == ["d1", "d2", None] and (got["a"].n_quotes, got["a"].n_docs, got["a"].seq) == (3, 3, 0)
    few = {r.src: r for r in etl.merge_triples(edges, most=2).collect()}
    assert few["a"].quotes == ["q2", "q1"] and few["a"].docs == ["d1", "d2"] and few["a"].n_quotes == 3 and few["c"].quotes == ["q"]


def test_answers_are_made_once(spark, tmp_path):
    """A run that fails midway is started again and makes only what is missing; a run after that makes nothing."""
    from wayfind.sources import files, runs

    rows = spark.createDataFrame([(i, f"question {i % 30}") for i in range(40)] + [(99, None)], "n long, question string")
    asked = rows.withColumn("key", F.when(F.col("question").isNotNull(), files.cache_key("question")))
    made, store = [], str(tmp_path / "answers")

    def answer(part, fail_at=None):
        if len(made) == fail_at:
            raise RuntimeError("broken off")
        keys = [r.key for r in part.collect()]
        made.append(keys)
        return part.select("key", F.upper("question").alias("text"))

    try:
        runs.answer_once(asked, lambda part: answer(part, fail_at=3), store, "text string", batches=6)
        raise AssertionError("should have failed")
    except RuntimeError:
        before = sum(map(len, made))
    assert 0 < before < 30
    got = runs.answer_once(asked, answer, store, "text string", batches=6).collect()
    assert len(got) == 41 and all(r.text == (r.question.upper() if r.question else None) for r in got)
    keys = [k for part in made for k in part]
    assert len(keys) == len(set(keys)) == 30
    calls = len(made)
    assert runs.answer_once(asked, answer, store, "text string").count() == 41 and len(made) == calls
    more = rows.unionByName(spark.createDataFrame([(100, "a new one")], "n long, question string")).where("question is not null").withColumn("key", files.cache_key("question"))
    assert runs.answer_once(more, answer, store, "text string").where("n = 100").first().text == "A NEW ONE" and made[-1] == [r.key for r in more.where("n = 100").collect()]


def test_log_of_runs(spark, tmp_path):
    from wayfind.sources import runs

    result = spark.createDataFrame([(1, "q", "lookup", ["followup", "route"], False, None, ["m"])], "qid long, question string, route_kind string, trace array<string>, refused boolean, refusal_reason string, evidence array<string>")
    path = str(tmp_path / "log")
    assert runs.read_parts(spark, path, runs.RUN).count() == 0
    runs.log_run(result, path, "a")
    runs.log_run(result, path, "a")
    runs.log_run(result, path, "b")
    assert sorted((r.run, r.trace, r.n_evidence) for r in runs.read_parts(spark, path, runs.RUN).collect()) == [("a", ["followup", "route"], 1), ("b", ["followup", "route"], 1)]


def test_stored_index(spark, tmp_path):
    """After every addition and removal the index finds what a full scoring of the documents left would find."""
    import random

    from wayfind.operators import bm25, bm25_store

    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rnd.choices(words, [1 / (i + 1) for i in range(60)], k=n))
    docs = {i: (text(2), text(rnd.randrange(0, 60))) for i in range(150)}
    queries = spark.createDataFrame([(i, text(rnd.randrange(1, 6))) for i in range(25)] + [(98, "nothing here"), (99, None)], "qid long, text string")
    path = str(tmp_path / "index")
    frame = lambda ids: spark.createDataFrame([(i, *docs[i]) for i in ids], "id long, title string, text string")
    here: set[int] = set()

    def same():
        full = bm25.search(bm25.build_index(frame(sorted(here))), queries, 5)
        want = sorted((r.qid, r.pos, r.id, r.score) for r in full.collect())
        for first in (10, 10_000):
            got = bm25_store.search(spark, path, queries, 5, first=first)
            assert sorted((r.qid, r.pos, r.id, r.score) for r in got.collect()) == want

    bm25_store.add(frame(range(100)), path)
    here |= set(range(100))
    same()
    bm25_store.remove(spark, path, spark.createDataFrame([(i,) for i in [*range(0, 100, 3), 555]], "id long"))
    here -= set(range(0, 100, 3))
    for i in range(0, 40):
        docs[i] = (text(2), text(20))
    bm25_store.add(frame([*range(0, 40), *range(100, 150)]), path)
    here |= {*range(0, 40), *range(100, 150)}
    same()
    assert bm25_store.search(spark, str(tmp_path / "none"), queries).collect() == []
