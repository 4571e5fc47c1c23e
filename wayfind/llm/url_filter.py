"""URL filters by a temporal list join.

Dated list entries (a pattern is listed or delisted as of a date) become validity
intervals; every capture is evaluated, as of its fetch date, against the entries that
were active then. A pattern is a domain (`example.com`, also for its subdomains) or a
domain with a path prefix of whole segments (`example.com/a/b`). A capture is looked
up by each of its keys (every parent domain, every path prefix of its host), so that
the join is an equi-join on the pattern with the interval as a condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case; empty if the URL has none; null for null."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to) while a pattern is listed; valid_to is exclusive, null while open.

    entries: pattern, listed, as_of. Of several entries of a pattern on a day, a listing
    wins. Entries with a null are ignored; repeated entries count once.
    """
    days = entries.select("pattern", F.col("as_of").cast("date").alias("as_of"), F.col("listed").cast("boolean").alias("listed")).dropna().groupBy("pattern", "as_of").agg(F.max("listed").alias("listed"))
    following = F.lead("as_of").over(Window.partitionBy("pattern").orderBy("as_of"))
    return days.withColumn("valid_to", following).where("listed").select("pattern", F.col("as_of").alias("valid_from"), "valid_to")


def keys_of(host: Column, path: Column) -> Column:
    """All patterns that match a URL: its domains, and its host with each prefix of path segments."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    prefixes = F.transform(segments, lambda s, i: F.concat_ws("/", host, F.array_join(F.slice(segments, 1, i + 1), "/")))
    return F.when(host != "", F.array_distinct(F.concat(domains, prefixes))).otherwise(F.array().cast("array<string>"))


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """page_id, host, fetched, blocked, n_active, pattern for each row of captures.

    n_active counts the patterns active on the fetch date that match, pattern is the
    longest of them (ties: the first by name). A null URL, one without a host, and a null
    date match nothing. A null id stays null; repeated rows give repeated rows (rows of one
    id with different URLs or dates are told apart). Other columns are not read.
    """
    rows = captures.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(time_col).cast("date").alias("fetched"))
    # captures of one host, path and day have one answer: hot ones are looked up once
    asked = rows.where("fetched is not null and host <> ''").select("host", "path", "fetched").distinct()
    keyed = asked.select("host", "path", "fetched", F.explode(keys_of(F.col("host"), F.col("path"))).alias("pattern"))
    active = keyed.join(intervals(entries), "pattern").where("valid_from <= fetched and (valid_to is null or fetched < valid_to)")
    found = active.groupBy("host", "path", "fetched").agg(F.countDistinct("pattern").alias("n_active"), F.min(F.struct((-F.length("pattern")).alias("size"), "pattern")).getField("pattern").alias("pattern"))
    out = rows.join(found, ["host", "path", "fetched"], "left")
    return out.select("page_id", "host", "fetched", F.coalesce(F.col("n_active") > 0, F.lit(False)).alias("blocked"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), "pattern")
