"""Evaluation of retrieval and answers against golden items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wording of refusals.
REFUSAL = "확인되지 않|근거에는? 없|근거에서 확인|알 수 없|정보가 없|나와 있지 않|찾을 수 없"


def recall_tables(items: DataFrame, hit: str, *groups: str) -> DataFrame:
    """hits, n, recall by each group and over all, in one pass of grouping sets; level names the group."""
    return items.groupingSets([[F.col(g)] for g in groups] + [[]], *(F.col(g) for g in groups)).agg(F.count_if(F.col(hit)).alias("hits"), F.count("*").alias("n")).withColumn("recall", F.round(F.col("hits") / F.col("n"), 6))


def covers(expected: Column, sources: Column) -> Column:
    """Whether all expected are among the sources."""
    return F.size(F.array_except(expected, sources)) == 0


def path_names(path: Column) -> Column:
    """The nodes of a written path `A ─KIND─▶ B`, `A ◀─KIND─ B`."""
    return F.filter(F.transform(F.split(path, r"\s*(?:─[^─]*─▶|◀─[^─]*─)\s*"), lambda s: F.trim(s)), lambda s: s != "")


def pair_recall(names: Column, walked: Column) -> Column:
    """Share of neighbouring names that were walked in either direction; null for less than two names.

    walked: array of `a|b` pairs.
    """
    pairs = F.transform(F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0))), lambda b, i: F.struct(F.get(names, i).alias("a"), b.alias("b")))
    met = F.filter(pairs, lambda p: F.array_contains(walked, F.concat_ws("|", p["a"], p["b"])) | F.array_contains(walked, F.concat_ws("|", p["b"], p["a"])))
    return F.when(F.size(names) >= 2, F.size(met) / F.size(pairs))


def contingency(items: DataFrame, evidence: str, answer: str) -> DataFrame:
    return items.groupBy(F.col(evidence).alias("evidence"), F.col(answer).alias("answer")).agg(F.count("*").alias("n"))


def has_title(wanted: Column, got: Column) -> Column:
    """Equal, or one begins with the other; empty titles match nothing."""
    return (wanted != "") & (got != "") & ((wanted == got) | wanted.startswith(got) | got.startswith(wanted))


#: Wording by which an answer denies a claim; kinds of items that must not be answered, and whose answer is a person.
DENIAL = "아닙니다|아니다|아니에요|사실이 아|틀렸|맞지 않|출연하지 않|나오지 않|없습니다|없다"
UNANSWERABLE, PERSONAL = ["out_of_scope", "no-answer"], ["character", "cast", "intersect-person"]


def flat(s: Column) -> Column:
    """A text without white space, brackets and quotes."""
    return F.regexp_replace(s, r"""[\s《》「」＜＞<>'"]""", "")


def says(text: Column, needle: Column) -> Column:
    return (F.length(needle) > 0) & flat(text).contains(flat(needle))


def expected(kind: Column, answer: Column, need_person: Column, need_movies: Column, accept: Column) -> Column:
    """What counts as an item's answer: a year, a person, or any of its films; and what is accepted besides."""
    clean = F.trim(F.regexp_replace(F.coalesce(answer, F.lit("")), "[《》']", ""))
    usable = F.when((clean != "") & ~clean.startswith("("), clean)
    year = F.regexp_extract(F.coalesce(answer, F.lit("")), r"\d{4}", 0)
    none = F.array().cast("array<string>")
    dated = (kind == "release") | ((kind == "verify-claim") & (F.coalesce(need_person, F.lit("")) == ""))
    core = F.when(dated, F.array(F.when(year != "", year).otherwise(usable))).when(kind.isin(*PERSONAL), F.array(need_person, usable)).otherwise(F.concat(F.coalesce(need_movies, none), F.array(usable)))
    return F.array_distinct(F.filter(F.concat(core, F.coalesce(accept, none)), lambda x: x.isNotNull() & (x != "")))


def grade(kind: Column, text: Column, claim_true: Column, need_person: Column, wanted: Column) -> Column:
    """right, wrong, or excluded (nothing to compare with): what an answer is worth. A null text is none."""
    refused, denied = text.rlike(REFUSAL), text.rlike(DENIAL)
    silent = text.isNull()
    claim = (kind == "verify-claim") & claim_true.isNotNull() & (F.coalesce(need_person, F.lit("")) != "")
    right = F.lit("right")
    return (
        F.when(kind.isin(*UNANSWERABLE), F.when(silent | refused, right).otherwise("wrong"))
        .when((kind == "verify-claim") & ~F.coalesce(claim_true, F.lit(True)) & silent, right).when(silent, "wrong")
        .when(claim, F.when(claim_true != denied, right).otherwise("wrong"))
        .when(F.size(wanted) == 0, "excluded").otherwise(F.when(F.exists(wanted, lambda w: says(text, w)), right).otherwise("wrong"))
    )


def answer_holds(answer: Column, expect: Column) -> Column:
    """Whether an answer has one of the expected ones, which middle dots set apart."""
    bare = lambda s: F.regexp_replace(s, r"""[·・.\s《》「」"'()]""", "")
    return F.exists(F.split(expect, r"\s*·\s*"), lambda x: bare(answer).contains(bare(x)))


def rates(items: DataFrame, by: str, flag: str) -> DataFrame:
    """by, n, k, rate of a flag."""
    return items.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("k"), F.round(F.count_if(F.col(flag)) / F.count("*"), 6).alias("rate"))


def overfit_gap(items: DataFrame, split: str, flag: str) -> DataFrame:
    """One row: the rate on tuned items, on held-out ones, and how much the first is higher."""
    share = lambda s: F.count_if((F.col(split) == s) & F.col(flag)) / F.nullif(F.count_if(F.col(split) == s), F.lit(0))
    return items.agg(F.round(share("tuned"), 6).alias("tuned"), F.round(share("holdout"), 6).alias("holdout"), F.round(share("tuned") - share("holdout"), 6).alias("gap"))


def evidence_sizes(blocks: DataFrame) -> DataFrame:
    """One row of blocks (block): mean and largest size, and the share that lines of credits have."""
    lines = F.filter(F.split("block", "\n"), lambda line: line.rlike("^ {4}(감독|각본|출연) "))
    credit = F.aggregate(lines, F.lit(0), lambda a, line: a + F.length(line) + 1)
    return blocks.agg(F.round(F.avg(F.length("block"))).cast("long").alias("mean"), F.max(F.length("block")).alias("largest"), F.round(100 * F.sum(credit) / F.greatest(F.sum(F.length("block")), F.lit(1))).cast("long").alias("credit_percent"))


def golden_errors(items: DataFrame, nodes: DataFrame, kinds: list[str], quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """id, error, what: what golden items (id, path, quote, expected) say that the graph doesn't have.

    Nodes and kinds of the path, expected documents, and the quote, which may be part of
    one of the graph's or hold one (both by verified containment).
    """
    from wayfind.operators.etl import verify_quotes

    steps = items.select("id", F.explode(path_names(F.col("path"))).alias("what"))
    missing = steps.join(nodes.select(F.col("id").alias("what")), "what", "left_anti").select("id", F.lit("node").alias("error"), "what")
    said = items.select("id", F.explode(F.regexp_extract_all("path", F.lit("─([A-Z_]{3,})─"), 1)).alias("what")).where(~F.col("what").isin(*kinds)).select("id", F.lit("kind").alias("error"), "what")
    lost = items.select("id", F.explode("expected").alias("what")).join(docs.select(F.col("id").alias("what")), "what", "left_anti").select("id", F.lit("document").alias("error"), "what")
    q = items.where("quote <> ''").select(F.col("id").alias("quote_id"), F.col("quote").alias("text"))
    inside = verify_quotes(q, quotes.select("id", "text")).select(F.col("quote_id").alias("id"))
    around = verify_quotes(quotes.select(F.col("id").alias("quote_id"), "text"), q.select(F.col("quote_id").alias("id"), "text")).select("id")
    unquoted = q.select(F.col("quote_id").alias("id"), F.lit("quote").alias("error"), F.col("text").alias("what")).join(inside.unionByName(around).distinct(), "id", "left_anti")
    return missing.unionByName(said).unionByName(lost).unionByName(unquoted)
