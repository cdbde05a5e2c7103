"""URL filters as a temporal join: dated list entries become intervals, and captures meet those of their fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .line_dedup import host_of


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, key, from_day, to_day): when each key was on each list; ``to_day`` is null while it still is.

    ``entries``: list, kind (block or allow), key, action (add or remove), day. Of entries of one key and day an addition
    wins. An addition ends at the next entry of its key; one after another go on without a gap. A removal of what was not
    listed does nothing. Rows with a null key, day or list are left out. Entries are folded to one per key and day first.
    """
    valid = entries.filter("list is not null and key is not null and day is not null and kind in ('block', 'allow')")
    daily = valid.groupBy("list", "kind", "key", "day").agg(F.max(F.col("action") == "add").alias("on"))
    later = Window.partitionBy("list", "kind", "key").orderBy("day")
    return daily.withColumn("to_day", F.lead("day").over(later)).filter("on").select("list", "kind", "key", F.col("day").alias("from_day"), "to_day")


def url_keys(url: Column) -> Column:
    """What lists can name of a URL: its host and the parent domains of two labels or more, alone and with every path prefix."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(labels))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    usable = F.when(F.size(labels) >= 2, parents).otherwise(F.array(host))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(path))), lambda n: (F.substr(path, n, F.lit(1)) != "/") & F.substr(path, n + 1, F.lit(1)).isin("/", ""))
    prefixes = F.when(path != "", F.transform(ends, lambda n: F.substr(path, F.lit(1), n))).otherwise(F.array().cast("array<string>"))
    names = F.array_distinct(F.concat(usable, F.array(host)))
    return F.array_distinct(F.concat(names, F.flatten(F.transform(names, lambda d: F.transform(prefixes, lambda p: F.concat(d, p))))))


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (with url, fetched_on) and: host, n_entries, verdict, matched_key, matched_list.

    The entry in force with the longest key decides; of equally long ones an allowing entry, then the smaller key and list.
    ``verdict`` is 'allow', 'block', or 'none' for captures that no list names, that have no host or no fetch day. Captures
    are folded to distinct (keys, day), and these to distinct (key, day) before they meet the lists, so a hot host meets them
    once per day; intervals are cut by month, so a key with many entries meets a day with those of its month only.
    """
    tagged = captures.withColumns({"host": host_of(F.col("url")), "_keys": url_keys(F.col("url"))}).withColumn("_sig", F.array_join("_keys", " "))
    asked = tagged.filter("host is not null and fetched_on is not null").select("_sig", "_keys", F.col("fetched_on").alias("_day")).distinct()
    last = asked.agg(F.max("_day").alias("_last"))
    spans = intervals(entries).join(F.broadcast(last))  # one row
    months = F.sequence(_month(F.col("from_day")), F.greatest(_month(F.col("from_day")), _month(F.coalesce("to_day", "_last"))))
    by_month = spans.filter("from_day <= _last").select("list", "kind", F.col("key").alias("_key"), "from_day", "to_day", F.explode(months).alias("_month"))
    probes = asked.select("_sig", "_day", _month(F.col("_day")).alias("_of"), F.explode("_keys").alias("_probe"))
    active = (F.col("from_day") <= F.col("_day")) & (F.col("to_day").isNull() | (F.col("_day") < F.col("to_day")))
    single = probes.select("_probe", "_day", "_of").distinct()
    met = single.join(by_month, (F.col("_probe") == F.col("_key")) & (F.col("_of") == F.col("_month")) & active)
    rank = F.struct((-F.length("_key")).alias("a"), F.col("kind").alias("kind"), F.col("_key").alias("key"), F.col("list").alias("list"))
    by_key = met.groupBy("_probe", "_day").agg(F.min(rank).alias("_best"), F.count(F.lit(1)).alias("_n"))
    decided = probes.join(by_key, ["_probe", "_day"]).groupBy("_sig", "_day").agg(F.min("_best").alias("_best"), F.sum("_n").alias("_n"))
    joined = tagged.join(decided.withColumnRenamed("_sig", "_s"), (F.col("_sig") == F.col("_s")) & (F.col("fetched_on") == F.col("_day")), "left")
    return joined.select(
        *captures.columns, "host", F.coalesce("_n", F.lit(0)).alias("n_entries"), F.coalesce("_best.kind", F.lit("none")).alias("verdict"),
        F.col("_best.key").alias("matched_key"), F.col("_best.list").alias("matched_list"),
    )
