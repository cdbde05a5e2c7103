"""Counting conventions of the scenario-level scorer: cartesian ground truth, no grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as E
from ..functions import timestamps as T
from ..lookups import HIGH, MEDIUM
from ..session import cut_lineage

SCOPE = ["dataset", "task", "scenario"]
ATTEMPT = [*SCOPE, "attempt_id"]


def truth_pairs(annotations: DataFrame) -> DataFrame:
    """Distinct stamp x entity pairs of each record: (dataset, task, scenario, g_ts, g_entity)."""
    rows = annotations.select(*SCOPE, F.explode("timestamps").alias("g_ts"), "entities")
    rows = rows.select(*SCOPE, "g_ts", F.explode("entities").alias("g_entity"))
    return rows.withColumn("g_entity", E.unescape(F.col("g_entity"))).distinct()


def scored_findings(scenarios: DataFrame, findings: DataFrame, truth: DataFrame, more_defensive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): the findings that a scorer counts, with their scenario and time, and those that hit a truth pair.

    Both are written once. ``more_defensive`` rows hold those of the strict scorer, told by ``verdict``.
    """
    levels = [HIGH, MEDIUM] if more_defensive else [HIGH]
    rows = findings.filter(F.col("verdict").isin(levels)).join(scenarios, SCOPE)
    time = F.when(F.col("task") != "classification", T.norm_timestamp(F.col("timestamp"), F.col("precision")))
    rows = cut_lineage(rows.select(*ATTEMPT, "chunk_id", "verdict", "label", time.alias("ts_norm"), "entity"))
    attack = rows.filter("task <> 'classification' and ts_norm is not null and label = 'attack'")
    pairs = truth.select([F.col(c).alias(f"_t_{c}") for c in SCOPE] + ["g_ts", "g_entity"])
    same = (F.col("ts_norm") == F.col("g_ts"))
    for c in SCOPE:
        same = same & (F.col(c) == F.col(f"_t_{c}"))
    needle = F.lower(T.ws_trim(F.col("g_entity")))
    hit = F.when(F.col("task") == "lm", F.col("entity") == F.col("g_entity")).otherwise(
        F.contains(F.lower(T.ws_trim(F.col("entity"))), needle)
    )
    # one join finds the hits; whatever is timed and no hit is a false alarm
    return rows, cut_lineage(attack.join(pairs, same & hit, "left_semi"))


def compat_counts(scenarios: DataFrame, chunks: DataFrame, findings: DataFrame, truth: DataFrame,
                  more_defensive: bool = False, scored: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """tp, fp, fn, tn, accuracy and chunks per (scenario, attempt).

    ``scenarios``: dataset, task, scenario, label, log_lines, precision. ``chunks``: scenario keys,
    attempt_id, chunk_id; an unparseable chunk has no findings. ``findings`` adds finding_index,
    verdict, timestamp, entity. The truth side is matched on (scenario, time); the substring test is
    a residual of that join. ``scored``: ``scored_findings`` of the same tables, for both scorers.
    """
    levels = [HIGH, MEDIUM] if more_defensive else [HIGH]
    rows, hits = scored or scored_findings(scenarios, findings, truth, more_defensive)
    rows, hits = (df.filter(F.col("verdict").isin(levels)) for df in (rows, hits))
    n_chunks = chunks.groupBy(*ATTEMPT).agg(F.count(F.lit(1)).alias("chunks"))

    flagged = rows.filter("task = 'classification'").groupBy(*ATTEMPT, "chunk_id").agg(F.lit(1).alias("_one"))
    flagged = flagged.groupBy(*ATTEMPT).agg(F.count(F.lit(1)).alias("high_chunks"))

    timed = rows.filter("task <> 'classification' and ts_norm is not null")
    tp = hits.groupBy(*ATTEMPT).agg(F.count(F.lit(1)).alias("tp_hits"))
    seen = timed.filter("label in ('attack', 'benign')").groupBy(*ATTEMPT).agg(F.count(F.lit(1)).alias("_timed"))
    fp = seen.join(tp, ATTEMPT, "left").select(*ATTEMPT, (F.col("_timed") - F.coalesce("tp_hits", F.lit(0))).alias("fp"))
    found = hits.select(*ATTEMPT, F.col("entity").alias("g_entity")).distinct()
    unique = found.groupBy(*ATTEMPT).agg(F.count(F.lit(1)).alias("found_hosts"))

    # hosts of the truth that the attempt did not find: all hosts less the found ones among them
    hosts = truth.select(*SCOPE, "g_entity").distinct()
    n_hosts = hosts.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n_hosts"))
    met = found.join(hosts, [*SCOPE, "g_entity"], "left_semi").groupBy(*ATTEMPT).agg(F.count(F.lit(1)).alias("met_hosts"))

    out = n_chunks.join(scenarios, SCOPE).join(n_hosts, SCOPE, "left")
    for part in (flagged, fp, tp, unique, met):
        out = out.join(part, ATTEMPT, "left")
    out = out.fillna(0, ["high_chunks", "fp", "tp_hits", "found_hosts", "met_hosts", "n_hosts"])
    whole, is_attack = F.col("task") == "classification", F.col("label") == "attack"
    by_host = (F.col("dataset") == "optc") & (F.col("task") == "lm")
    high_any, hit_any = (F.col("high_chunks") >= 1).cast("long"), (F.col("tp_hits") > 0).cast("long")
    zero = F.lit(0).cast("long")
    return out.select(
        *ATTEMPT, "label", "chunks",
        F.when(whole, F.when(is_attack, high_any).otherwise(zero))
        .when(is_attack, F.when(by_host, F.col("found_hosts")).otherwise(hit_any)).otherwise(zero).alias("tp"),
        F.when(whole, F.when(is_attack, zero).otherwise(F.col("high_chunks"))).otherwise(F.col("fp")).alias("fp"),
        F.when(whole, F.when(is_attack, 1 - high_any).otherwise(zero))
        .when(is_attack, F.when(by_host, F.col("n_hosts") - F.col("met_hosts")).otherwise(1 - hit_any)).otherwise(zero).alias("fn"),
        F.when(whole, F.when(is_attack, zero).otherwise(F.col("chunks") - F.col("high_chunks")))
        .otherwise(F.col("log_lines") - F.col("fp")).alias("tn"),
        F.when(whole, F.when(is_attack, high_any.cast("double")).otherwise((F.col("chunks") - F.col("high_chunks")) / F.col("chunks"))).alias("accuracy"),
    )


def compat_rates(counts: DataFrame, *by: str) -> DataFrame:
    """Summed counts with TPR and FPR, null when the denominator is zero."""
    sums = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    return sums.withColumn("tpr", F.try_divide("tp", F.col("tp") + F.col("fn"))).withColumn(
        "fpr", F.try_divide("fp", F.col("fp") + F.col("tn"))
    )


def tuples_to_findings(responses: DataFrame) -> DataFrame:
    """Nested ``chunk -> round -> tuples`` maps to one row per finding.

    ``responses``: scenario keys, chunks MAP<STRING, MAP<STRING, ARRAY<STRUCT<timestamp, entity, verdict>>>>.
    Tuples without a time or an entity are dropped (a classification tuple has neither).
    """
    rounds = responses.select(*SCOPE, F.explode("chunks").alias("chunk_id", "_rounds"))
    tuples = rounds.select(*SCOPE, "chunk_id", F.explode("_rounds").alias("attempt_id", "_tuples"))
    rows = tuples.select(*SCOPE, "chunk_id", "attempt_id", F.posexplode("_tuples").alias("finding_index", "_t"))
    whole = F.col("task") == "classification"
    named = F.col("_t.timestamp").isNotNull() & F.col("_t.entity").isNotNull() & (
        (F.col("_t.timestamp") != "") | (F.col("_t.entity") != "")
    )
    return rows.filter(whole | named).select(
        *SCOPE, "attempt_id", "chunk_id", "finding_index", F.upper("_t.verdict").alias("verdict"),
        F.when(~whole, F.col("_t.timestamp")).alias("timestamp"), F.when(~whole, F.col("_t.entity")).alias("entity"),
    )


def compare_scores(ours: DataFrame, theirs: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Full outer comparison of two scorers per key: both values and whether they agree."""
    left = ours.select(*keys, *[F.col(c).alias(f"ours_{c}") for c in columns], F.lit(True).alias("in_ours"))
    right = theirs.select(*keys, *[F.col(c).alias(f"theirs_{c}") for c in columns], F.lit(True).alias("in_theirs"))
    rows = left.join(right, keys, "full_outer")
    match = F.col("in_ours").isNotNull() & F.col("in_theirs").isNotNull()
    for c in columns:
        match = match & F.col(f"ours_{c}").eqNullSafe(F.col(f"theirs_{c}"))
    return rows.withColumn("match", match).drop("in_ours", "in_theirs")


def mismatch_totals(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count(F.lit(1)).alias("n_compared"), F.count_if(~F.col("match")).alias("n_mismatch"))
