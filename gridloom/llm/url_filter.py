"""URL filters by a temporal list join, in DataFrame functions only.

A list is dated entries: a pattern (a host, which stands for its subdomains too, or a host with
the beginning of a path) is added or removed on a day, to block or to allow. Entries of a pattern
in order of days become validity intervals. Every capture asks for each of its host's suffixes
and each prefix of its path, and is joined as of its fetch time with what was in force then. The
longest pattern decides; of two kinds of one pattern, allow does.

The join is an equality with a range beside it, never a cross join, and Spark can split it for a
host with a third of all captures. No side is broadcast by hand: lists may be large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """The lower-case host; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def patterns_of(url: Column, labels: int | None = None, steps: int | None = None) -> Column:
    """All patterns that can meet a URL: suffixes of its host, and the host with each prefix of its path.

    No pattern of the list has more labels or path steps than `labels` and `steps`; longer ones are left out, so
    that a very long host or path doesn't make bytes that grow with its square.
    """
    host = host_of(url)
    parts = F.split(host, "\\.")
    path = F.filter(F.split(F.coalesce(F.regexp_extract(url, PATH, 1), F.lit("")), "/"), lambda s: s != "")
    first = F.lit(1) if labels is None else F.greatest(F.lit(1), F.size(parts) - labels + 1)
    deep = F.size(path) if steps is None else F.least(F.size(path), F.lit(steps))
    none = F.array().cast("array<string>")
    suffixes = F.when(first <= F.size(parts), F.transform(F.sequence(first, F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).otherwise(none)
    prefixes = F.when(deep > 0, F.transform(F.sequence(F.lit(1), deep), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(path, F.lit(1), i), "/")))).otherwise(none)
    return F.when(host != "", F.array_distinct(F.concat(suffixes, prefixes))).otherwise(none)


def reach(entries: DataFrame) -> tuple[int, int]:
    """Most labels of a host and most path steps of a pattern of the list."""
    steps = F.size(F.split("pattern", "/")) - 1
    labels = F.size(F.split(F.substring_index("pattern", "/", 1), "\\."))
    return tuple(x or 0 for x in entries.where("pattern is not null").agg(F.max(labels), F.max(steps)).first())


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (pattern, kind, valid_from, valid_to) of entries (pattern, kind, action, dated).

    An `add` holds until the next entry of its pattern and kind, or for good (valid_to null). Of
    entries of one day the last by action counts (`remove` after `add`). Rows with nulls are no entries.
    """
    day = entries.dropna(subset=["pattern", "kind", "action", "dated"]).groupBy("pattern", "kind", "dated").agg(F.max("action").alias("action"))
    line = Window.partitionBy("pattern", "kind").orderBy("dated")
    return day.withColumn("valid_to", F.lead("dated").over(line)).where("action = 'add'").select("pattern", "kind", F.col("dated").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched) with decision, pattern and valid_from of the entry that decided.

    decision is `block` or `allow`, and `none` where no entry was in force; a null or unparsable
    url, or a null fetch time, meets none. Repeated rows are one capture. Other columns of captures
    are left out. An empty list leaves every capture with `none`.
    """
    own = captures.select("page_id", "url", "fetched").distinct()
    asked = own.withColumn("pattern", F.explode(patterns_of(F.col("url"), *reach(entries))))
    met = asked.join(intervals(entries), "pattern").where("valid_from <= fetched and (valid_to is null or fetched < valid_to)")
    best = met.groupBy("page_id", "url", "fetched").agg(F.max(F.struct(F.length("pattern").alias("n"), (F.col("kind") == "allow").alias("allow"), "pattern", "kind", "valid_from")).alias("best"))
    keys = ["page_id", "url", "fetched"]
    rows = own.alias("a").join(best.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left")
    return rows.select(*[F.col(f"a.{k}") for k in keys], F.coalesce("best.kind", F.lit("none")).alias("decision"), F.col("best.pattern").alias("pattern"), F.col("best.valid_from").alias("valid_from"))
