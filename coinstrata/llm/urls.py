"""URL filters whose lists change over time.

Dated list entries (block, allow, remove) become validity intervals; an as-of join then judges each capture by the
entries that were active when it was fetched. Intervals, cut at the first and the last fetch, are dealt to the periods
they span, and only captures with a key that the lists may name are joined, on (key, period); the captures of a busy
key and period (a top-level domain, a crawl of one week) are dealt to several tasks, each with a copy of that period's
entries. The most specific active entry decides, and of equally specific ones a block.

Defined results: keys are a host, each of its parent domains, and host plus each path prefix that ends at a slash or
at the path's end; matching is blind to case; entries with a null pattern or time are ignored; at one moment the later
of remove, allow, block (in this order) counts for a list and key; a capture without url or time, or that no entry
matches, is not blocked; repeated captures are judged alike, each on its own; empty lists or captures give none blocked
or an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import if_any, join_spread, split_by_keys

PERIOD = 30 * 86400
#: Captures from which a key and period, or a repeated capture, counts as busy.
BUSY = 1000
#: Periods that an interval is dealt to at most: longer stretches of fetch times have longer periods.
MOST_PERIODS = 1000


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1))


def keys_of(host: Column, path: Column) -> Column:
    """All keys of a capture: parent domains, host, and path prefixes."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    prefix = lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), prefix)
    return F.array_distinct(F.when(path == "", domains).otherwise(F.concat(domains, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """key, list, action, since, until (null: open) from dated entries list, pattern, action, at."""
    rows = entries.filter("pattern is not null and at is not null").select("list", F.lower("pattern").alias("key"), "action", "at")
    rank = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    last = rows.groupBy("list", "key", "at").agg(F.max_by("action", rank).alias("action"))
    line = Window.partitionBy("list", "key").orderBy("at")
    spans = last.withColumn("until", F.lead("at").over(line)).withColumnRenamed("at", "since")
    return spans.filter(F.col("action") != "remove").select("key", "list", "action", "since", "until")


def judge(captures: DataFrame, entries: DataFrame, period: int = PERIOD) -> DataFrame:
    """capture_id, url, fetched, host, n_active, decided_by, blocked of captures capture_id, url, fetched (seconds)."""
    seen = captures.select("capture_id", "url", "fetched")
    first, last = seen.agg(F.min("fetched"), F.max("fetched")).first()
    period = max(period, ((last or 0) - (first or 0)) // MOST_PERIODS)
    least, most = F.lit(first).cast("long"), F.lit(last).cast("long")
    spans = intervals(entries).filter((F.col("since") <= most) & (F.col("until").isNull() | (F.col("until") > least)))
    begin = F.floor(F.greatest(F.col("since"), least) / period)
    end = F.floor(F.least(F.coalesce(F.col("until") - 1, most), most) / period)
    slot = F.concat_ws(" ", F.col("period").cast("string"), "key").alias("slot")
    listed = spans.withColumn("period", F.explode(F.sequence(begin, end))).select(slot, "key", "list", "action", "since", "until")
    # one row for each distinct url and time, so that repeated captures cost nothing and none is lost
    once = seen.filter("url is not null and fetched is not null").select("url", "fetched").distinct()
    keyed = once.withColumns({"period": F.floor(F.col("fetched") / period), "_key": F.explode(keys_of(host_of(F.col("url")), path_of(F.col("url"))))})
    keyed, _ = split_by_keys(keyed, F.col("_key"), entries.select(F.lower("pattern").alias("key")).filter("key is not null").distinct())
    keyed = keyed.select("url", "fetched", F.concat_ws(" ", F.col("period").cast("string"), "_key").alias("slot"))
    busy = if_any(keyed.groupBy("slot").count().filter(F.col("count") > BUSY).select("slot"))
    active = (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    hits = join_spread(keyed, listed, "slot", busy, F.col("url")).filter(active)
    strength = F.struct(F.length("key"), F.col("action") == "block", "list", "key")
    verdicts = hits.groupBy("url", "fetched").agg(
        F.count("*").alias("n_active"), F.max_by(F.struct("action", F.concat_ws(":", "list", "key").alias("by")), strength).alias("v")
    )
    capture = F.concat_ws(" ", F.col("fetched").cast("string"), "url")
    verdicts = verdicts.select(capture.alias("capture"), "n_active", "v")
    asked = seen.withColumn("capture", F.when(F.col("url").isNotNull() & F.col("fetched").isNotNull(), capture))
    often = if_any(asked.groupBy("capture").count().filter(F.col("count") > BUSY).select("capture"))
    judged = join_spread(asked, verdicts, "capture", often, F.col("capture_id"), "left")
    return judged.select(
        "capture_id",
        "url",
        "fetched",
        host_of(F.coalesce("url", F.lit(""))).alias("host"),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("v.by").alias("decided_by"),
        F.coalesce(F.col("v.action") == "block", F.lit(False)).alias("blocked"),
    )


def allowed(captures: DataFrame, entries: DataFrame, period: int = PERIOD) -> DataFrame:
    """Captures that no active entry blocks."""
    return judge(captures, entries, period).filter("not blocked")
