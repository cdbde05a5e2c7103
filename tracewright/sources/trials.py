"""Trial folders and evaluation files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Version of the trial record that this module writes.
RECORD_VERSION = "trial-1"
TIMING = ("started_at", "finished_at", "environment_setup", "agent_setup", "agent_execution", "verifier")
RESULT = (
    "trial_name string, id string, task_name string, task_checksum string, started_at string, finished_at string, "
    "environment_setup variant, agent_setup variant, agent_execution variant, verifier variant, "
    "config variant, agent_info variant, verifier_result variant, "
    "agent_result struct<n_input_tokens bigint, n_output_tokens bigint, rollout_details variant, "
    "metadata struct<n_episodes bigint, summarization_count bigint, all_messages variant>>, "
    "exception_info struct<exception_type string, exception_message string>"
)
DIAGNOSTICS = (
    "schema_valid boolean, n_findings bigint, n_high bigint, n_targets bigint, tp bigint, fp bigint, "
    "strict_success double, dense_reward double, termination string"
)


def _whole(spark: SparkSession, root: str, name: str, depth: int) -> DataFrame:
    """One row per file called ``name``; the trial folder is ``depth`` levels above it."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(root)
    return found.select(F.regexp_replace("path", f"(/[^/]+){{{depth}}}$", "").alias("trial_dir"), "content", "length")


def termination_class(reward: Column, exception: Column) -> Column:
    """``reward``: whether one was given. An exception without type and message is none."""
    kind = exception["exception_type"]
    return (
        F.when(reward, "graded")
        .when(kind == "AgentTimeoutError", "policy_timeout")
        .when(kind == "ContextLengthExceededError", "context_exhausted")
        .when(F.coalesce(kind, exception["exception_message"]).isNotNull(), "infrastructure_error")
        .otherwise("unknown")
    )


def read_trials(
    spark: SparkSession, root: str, split: str | None = None, policy: str | None = None, sampler_probability: float | None = None
) -> DataFrame:
    """Trial records: result, diagnostics, reward and output of each trial folder; missing parts are null.

    ``split``, ``policy`` and ``sampler_probability`` describe the job that the trials come from.
    """
    result = _whole(spark, root, "result.json", 1).select(
        "trial_dir", F.from_json(F.col("content").cast("string"), RESULT).alias("r")
    )
    diagnostics = _whole(spark, root, "diagnostics.json", 2).select(
        "trial_dir", F.from_json(F.col("content").cast("string"), DIAGNOSTICS).alias("diagnostics")
    )
    reward = _whole(spark, root, "reward.json", 2).select(
        "trial_dir", F.from_json(F.col("content").cast("string"), "reward double").alias("reward"),
        # an empty or broken file is no reward, though it parses to a struct of nulls
        (F.size(F.from_json(F.col("content").cast("string"), "map<string, string>")) > 0).alias("_rewarded"),
    )
    output = _whole(spark, root, "findings.json", 3).select(
        "trial_dir", F.struct(F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).alias("output")
    )
    rows = result
    for part in (diagnostics, reward, output):
        rows = rows.join(part, "trial_dir", "left")
    gaps = F.array_compact(F.array(
        F.when(F.col("r.agent_result.rollout_details").isNull(), "no token ids"),
        F.when(F.col("r.agent_result.metadata.all_messages").isNull(), "no messages"),
    ))
    return rows.select(
        "trial_dir", F.coalesce("r.trial_name", F.element_at(F.split("trial_dir", "/"), -1)).alias("trial_name"),
        F.col("r.id").alias("trial_id"), "r.task_name", "r.task_checksum", "r.config", "r.agent_info",
        F.lit(split).cast("string").alias("split"), F.lit(policy).cast("string").alias("policy"),
        F.lit(sampler_probability).cast("double").alias("sampler_probability"), F.lit(RECORD_VERSION).alias("record_version"),
        F.struct(*[f"r.{part}" for part in TIMING]).alias("timing"),
        F.struct(
            F.col("r.agent_result.n_input_tokens").alias("n_input"), F.col("r.agent_result.n_output_tokens").alias("n_output"),
            "r.agent_result.metadata.n_episodes", "r.agent_result.metadata.summarization_count",
            F.col("r.agent_result.rollout_details").isNotNull().alias("rollout_details_present"),
        ).alias("tokens"),
        F.col("r.agent_result.metadata.all_messages").alias("messages"), "output", "reward", "diagnostics",
        "r.verifier_result", F.col("r.exception_info").alias("exception"),
        termination_class(F.coalesce("_rewarded", F.lit(False)), F.col("r.exception_info")).alias("termination"), gaps.alias("gaps"),
    )


def read_evaluations(spark: SparkSession, root: str, split: str = "dev") -> DataFrame:
    """Evaluation files ``<arm>-<split>-step<NNNN>.json``: arm, step, D, rates and the mean recall over tasks."""
    per_task = "map<string, struct<ordinary_recall double>>"
    schema = f"D double, false_alert_rate double, validity double, per_task {per_task}"
    name = F.element_at(F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/"), -1)
    pattern = rf"^(.*)-{split}-step(\d+)\.json$"
    rows = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", f"*-{split}-step*.json").json(root)
    recalls = F.filter(F.map_values("per_task"), lambda m: m["ordinary_recall"].isNotNull())
    total = F.aggregate(recalls, F.lit(0.0), lambda acc, m: acc + m["ordinary_recall"])
    return rows.select(
        F.regexp_extract(name, pattern, 1).alias("arm"), F.regexp_extract(name, pattern, 2).cast("int").alias("step"),
        "D", "false_alert_rate", "validity", F.try_divide(total, F.size(recalls)).alias("positive_recall"),
    )


