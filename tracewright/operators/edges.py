"""Provenance edges between files. Every edge carries its rule, strength and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import timestamps as T
from .scale import in_interval, null_safe_join

EDGE_COLUMNS = ["a", "b", "rule", "strength", "evidence"]


def _edges(df: DataFrame, a: Column, b: Column, rule, strength, evidence: Column) -> DataFrame:
    """Unordered edges in canonical order, without self-edges."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.filter(a != b).select(
        F.least(a, b).alias("a"), F.greatest(a, b).alias("b"),
        as_col(rule).alias("rule"), as_col(strength).alias("strength"), evidence.alias("evidence"),
    )


def _star(files: DataFrame, key: str, rule: str, evidence: Column) -> DataFrame:
    """Edges from the first file of each key to its other files.

    The first file comes from a map-side combined ``min``; only keys with several files are joined
    back. That side has one row per key, so AQE may split a hot key of the other side.
    """
    first = F.min(F.struct("ordinal", "rel_path"))
    hubs = files.groupBy(key).agg(first.alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    hubs = hubs.select(key, F.col("_first.rel_path").alias("_hub"))
    return _edges(files.join(hubs, key), F.col("_hub"), F.col("rel_path"), rule, "strong", evidence)


def same_key_edges(files: DataFrame) -> DataFrame:
    """Files of one scenario key."""
    return _star(files, "scenario_key", "same_scenario_key", F.col("scenario_key"))


def identical_content_edges(files: DataFrame) -> DataFrame:
    """Files with identical content."""
    return _star(files, "sha256", "identical_content", F.substring("sha256", 1, 16))


def _seconds(stamp: Column) -> Column:
    """Wall clock as seconds since 1970. Reads the fields, so the session zone plays no part."""
    days = F.datediff(stamp.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86_400 + F.hour(stamp) * 3_600 + F.minute(stamp) * 60 + F.second(stamp)


def _intervals(files: DataFrame) -> DataFrame:
    return files.withColumn("_s", _seconds(F.col("window_start").cast("timestamp_ntz"))).withColumn(
        "_e", _seconds(F.col("window_end").cast("timestamp_ntz"))
    )


def overlap_edges(files: DataFrame, slack_seconds: int = 0, bucket_seconds: int = 1) -> DataFrame:
    """All pairs of files whose windows overlap on one data set, OS and host (null hosts are equal).

    Of two windows that overlap, the later starts inside the earlier, so the join asks for the windows that contain a start, by
    dyadic blocks: a long window stands under some tens of blocks, and hostless files are spread over theirs. The output is as large
    as the number of overlapping pairs; grouping uses ``overlap_links`` instead, which is linear.
    """
    place = ["dataset", "os", "host"]
    base = _intervals(files).select("rel_path", "ordinal", *place, "scenario_key", "window_start", "window_end", "_s", "_e")
    named = lambda side: base.select(*place, *[F.col(c).alias(f"{side}{c}") for c in base.columns if c not in place])
    earlier = named("l_").withColumn("l_reach", F.col("l__e") + F.lit(slack_seconds))
    met = in_interval(named("r_"), earlier, "r__s", "l__s", "l_reach", place, bucket_seconds)
    once = F.struct("l__s", "l_ordinal") < F.struct("r__s", "r_ordinal")
    pairs = met.filter(once & (F.col("l_scenario_key") != F.col("r_scenario_key")))
    span = lambda side: F.concat(F.col(f"{side}_window_start"), F.lit(".."), F.col(f"{side}_window_end"))
    first = F.col("l_ordinal") < F.col("r_ordinal")
    evidence = F.concat(F.when(first, span("l")).otherwise(span("r")), F.lit(" overlaps "), F.when(first, span("r")).otherwise(span("l")))
    return _edges(pairs, F.col("l_rel_path"), F.col("r_rel_path"), "window_overlap_same_host", "strong", evidence)


def overlap_links(files: DataFrame, slack_seconds: int = 0, bucket_seconds: int = 60, buckets: int = 1_440) -> DataFrame:
    """At most one overlap edge per file, with the same connected components as ``overlap_edges``.

    In start order, a window is linked to the earlier window that ends last, if that one reaches it;
    any other earlier window that reaches it overlaps that one too. The running maximum is taken
    inside time buckets, over the buckets of a run of ``buckets``, and over the runs, so a hot host, and all files without one, are
    spread over their minutes. Files with one scenario key may be linked here; ``same_key_edges`` links them anyway.
    """
    place = ["dataset", "os", "_host"]  # without nulls, so that the join and the window share an exchange
    base = _intervals(files).withColumn("_host", F.coalesce("host", F.lit("")))
    base = base.select(
        "rel_path", *place, "window_start", "window_end", F.col("_s"), (F.col("_e") + F.lit(slack_seconds)).alias("_e")
    )
    base = base.withColumn("_bucket", F.floor(F.col("_s") / F.lit(bucket_seconds)))
    base = base.withColumn("_reach", F.struct("_e", "rel_path", "window_start", "window_end"))
    preceding = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    tops = base.groupBy(*place, "_bucket").agg(F.max("_reach").alias("_top")).withColumn("_run", F.floor(F.col("_bucket") / F.lit(buckets)))
    runs = tops.groupBy(*place, "_run").agg(F.max("_top").alias("_top"))
    runs = runs.select(*place, "_run", F.max("_top").over(preceding(*place).orderBy("_run")).alias("_before"))
    carried = tops.join(runs, [*place, "_run"]).select(
        *place, "_bucket", F.greatest("_before", F.max("_top").over(preceding(*place, "_run").orderBy("_bucket"))).alias("_carry")
    )
    inside = preceding(*place, "_bucket").orderBy("_s", "rel_path")
    joined = base.join(carried, [*place, "_bucket"])
    linked = joined.withColumn("_from", F.greatest(F.col("_carry"), F.max("_reach").over(inside)))
    linked = linked.filter(F.col("_from._e") >= F.col("_s"))
    evidence = F.concat(
        F.col("_from.window_start"), F.lit(".."), F.col("_from.window_end"), F.lit(" overlaps "),
        F.col("window_start"), F.lit(".."), F.col("window_end"),
    )
    return _edges(linked, F.col("_from.rel_path"), F.col("rel_path"), "window_overlap_same_host", "strong", evidence)


def view_name_edges(files: DataFrame, linear: bool = False) -> DataFrame:
    """Classification views named after another scenario.

    ``linear=True`` links a view to the first file of the key only; ``same_key_edges`` links that one to the others.
    """
    views = files.filter("task = 'classification'").select(
        F.col("rel_path").alias("_view"), F.col("scenario").alias("_scenario"),
        N.viewed_scenario_key(F.col("dataset"), F.col("scenario")).alias("scenario_key"),
    ).filter("scenario_key is not null")
    named = files.select("rel_path", "scenario_key")
    if linear:
        first = F.min(F.struct("ordinal", "rel_path")).alias("_first")
        named = files.groupBy("scenario_key").agg(first).select("_first.rel_path", "scenario_key")
    joined = views.join(named, "scenario_key")
    evidence = F.concat(F.col("_scenario"), F.lit(" -> "), F.col("scenario_key"))
    return _edges(joined, F.col("_view"), F.col("rel_path"), "classification_view_name", "strong", evidence)


def annotation_time_edges(files: DataFrame, annotations: DataFrame, linear: bool = False) -> DataFrame:
    """Annotation times that fall into the window of a file of another scenario.

    ``annotations``: dataset, task, scenario, timestamps. A time meets a window in exactly one dyadic block of it. With home files
    the hit must be on the OS and host of the first of them, which are
    part of the join key, and every home file is linked; without, a ``note`` edge is written. Hits are reduced
    to one row per (scenario, file) before they meet the home files. ``linear=True`` links the first home file
    to each hit and the first hit to each home file: the components of the whole product.
    """
    scope = ["dataset", "task", "scenario"]
    stamps = (
        annotations.select(*scope, F.explode("timestamps").alias("stamp")).distinct()
        .withColumn("_t", _seconds(T.parse_annotation_time(F.col("stamp"))))
    )
    home = files.groupBy(*scope).agg(F.min(F.struct("ordinal", "os", "host", "rel_path")).alias("_home"))
    stamps = stamps.join(home, scope, "left").withColumns({"_os": F.col("_home.os"), "_host": F.col("_home.host")})
    windows = _intervals(files).select(
        "dataset", F.col("rel_path").alias("_file"), F.col("filename").alias("_name"), F.col("scenario").alias("_scenario"),
        F.col("os").alias("_os"), F.col("host").alias("_host"), "_s", "_e",
    )
    other = F.col("_scenario") != F.col("scenario")
    placed = in_interval(stamps.filter("_home is not null"), windows, "_t", "_s", "_e", ["dataset", "_os", "_host"]).filter(other)
    homeless = in_interval(stamps.filter("_home is null").drop("_os", "_host"), windows, "_t", "_s", "_e", ["dataset"]).filter(other)
    once = lambda hits, *more: hits.groupBy(*scope, "_file", "_name", *more).agg(F.min("stamp").alias("stamp"))
    subject = F.concat_ws("/", "dataset", "scenario")
    inside = F.concat(F.col("stamp"), F.lit(" inside "), F.col("_name"))
    hits = once(placed, F.col("_home.rel_path").alias("_first"))
    members = files.select(*scope, "rel_path")
    if linear:
        hit = F.min(F.struct("_file", "_name", "stamp")).alias("_hit")
        others = hits.groupBy(*scope, "_first").agg(hit).join(members, scope).filter("rel_path <> _first")
        placed = hits.withColumnRenamed("_first", "rel_path").unionByName(others.select(*scope, "_hit.*", "rel_path"))
    else:
        placed = hits.join(members, scope)
    strong = _edges(
        placed, F.col("rel_path"), F.col("_file"), "annotation_time_inside_window", "strong",
        F.concat(subject, F.lit(" ts "), inside),
    )
    notes = once(homeless).select(
        F.col("_file").alias("a"), F.concat(F.lit("annotation:"), subject).alias("b"),
        F.lit("annotation_without_file_inside_window").alias("rule"), F.lit("note").alias("strength"),
        inside.alias("evidence"),
    )
    return strong.unionByName(notes)


def campaign_day_links(files: DataFrame, dataset: str = "optc") -> DataFrame:
    """Attack files of one day: strong on the same host, weak across hosts.

    Written as stars (first file of the host and day to its other files, first file of the day to the
    first file of each other host), which is linear in the files and has the components of all pairs.
    """
    day_files = files.filter((F.col("dataset") == dataset) & (F.col("label") == "attack")).select(
        "rel_path", "ordinal", "host", "scenario_key", F.substring("window_start", 1, 10).alias("day")
    )
    node = F.struct("ordinal", "rel_path", "scenario_key", "host")
    hosts = day_files.groupBy("day", "host").agg(F.min(node).alias("_hub"))
    days = hosts.groupBy("day").agg(F.min("_hub").alias("_top"))

    members = null_safe_join(day_files, hosts, ["day", "host"], "inner").filter(
        F.col("scenario_key") != F.col("_hub.scenario_key")
    )
    strong = _edges(
        members, F.col("_hub.rel_path"), F.col("rel_path"), "optc_same_host_same_day", "strong",
        F.concat_ws(" ", "host", "day"),
    )
    across = hosts.join(days, "day").filter(F.col("_hub.scenario_key") != F.col("_top.scenario_key"))
    weak = _edges(
        across, F.col("_top.rel_path"), F.col("_hub.rel_path"), "optc_same_campaign_day", "weak", F.col("day")
    )
    return strong.unionByName(weak)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge per (a, b, rule): the smallest evidence is kept."""
    return edges.groupBy("a", "b", "rule", "strength").agg(F.min("evidence").alias("evidence")).select(*EDGE_COLUMNS)


def build_edges(files: DataFrame, annotations: DataFrame, linear: bool = False) -> DataFrame:
    """All rules. ``linear=True`` replaces pairs and products by the links that suffice for grouping."""
    overlap = overlap_links(files) if linear else overlap_edges(files)
    parts = [
        same_key_edges(files), identical_content_edges(files), overlap, view_name_edges(files, linear),
        annotation_time_edges(files, annotations, linear=linear), campaign_day_links(files),
    ]
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    return distinct_edges(edges)


def rule_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rule", "strength").agg(F.count(F.lit(1)).alias("n_edges"))
