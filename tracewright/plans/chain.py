"""The log pipeline up to labelled units, with the tables between its stages written once.

Numbering the lines of a log takes a shuffle of the corpus, so the numbered events are written in
columnar form and every later stage scans only the columns it needs. Annotations, targets, stamps
and evidence are tiny next to them and are read several times each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lookups import FINDING_FIELD
from ..operators import evidence as E
from ..operators import windows as W
from ..operators.inventory import timed_lines
from ..session import cut_lineage
from . import bindings as B


@dataclass
class LogChain:
    spark: SparkSession
    sf_dir: str

    @cached_property
    def files(self) -> DataFrame:
        return cut_lineage(B.log_files(self.spark, self.sf_dir))

    @cached_property
    def events(self) -> DataFrame:
        """Without the attributes that only the table of files is asked for."""
        unread = ("ordinal", "sha256", "host", "os", "ts_format", "scenario_key", "ts", "pos", "ms")
        return cut_lineage(B.log_events(self.spark, self.sf_dir).drop(*unread))

    @cached_property
    def lines(self) -> DataFrame:
        return B.log_lines(self.events)

    @cached_property
    def annotations(self) -> DataFrame:
        return cut_lineage(B.log_annotations(self.events))

    @cached_property
    def _built(self) -> tuple[DataFrame, DataFrame]:
        targets, stamps = E.build_targets(self.annotations)
        return targets, cut_lineage(stamps)

    @cached_property
    def stamps(self) -> DataFrame:
        return self._built[1]

    @cached_property
    def evidence(self) -> DataFrame:
        return cut_lineage(E.evidence_lines(*self._built, timed_lines(self.lines)))

    @cached_property
    def targets(self) -> DataFrame:
        return cut_lineage(E.target_status(self._built[0], self.files, self.evidence))

    @cached_property
    def evidence_status(self) -> DataFrame:
        return self.evidence.join(self.targets.select("target_id", "status"), "target_id")

    @cached_property
    def window_targets(self) -> DataFrame:
        return cut_lineage(W.window_targets(self.evidence_status, self.files, B.LOG_SIZES))

    @cached_property
    def windows(self) -> DataFrame:
        return W.tumbling_windows(self.files, B.SCHEMA_VERSION, B.LOG_SIZES)

    @cached_property
    def units(self) -> DataFrame:
        units = W.label_windows(self.windows, self.window_targets)
        return cut_lineage(units.withColumn("group_id", F.concat(F.lit("g:"), F.col("scenario_key"))).withColumn(
            "split", F.expr("case when u div 16 % 10 < 5 then 'train' when u div 16 % 10 < 6 then 'dev' else 'test' end")
        ))

    @cached_property
    def unit_targets(self) -> DataFrame:
        return cut_lineage(E.unit_targets(self.units, self.window_targets, self.targets, self.stamps))

    @cached_property
    def payloads(self) -> DataFrame:
        """Three submissions per unit, written from its events; the third with broken items and texts."""
        return submissions(self.events, self.windows)


_ITEM = r"""case
  when attempt_id = 2 and k = 17 then '17'
  else concat('{',
    if(attempt_id = 2 and k = 11, '', concat('"timestamp":"', if(attempt_id = 2 and k = 16, 'yesterday', time_text), '",')),
    '"', field, '":"', case when attempt_id = 2 and k = 12 then 'a.example, b.example'
                            when attempt_id = 1 and k % 10 = 7 then '10.9.9.9' else entity end, '",',
    '"source_lines":[', case when attempt_id = 2 and k = 13 then ''
                             when attempt_id = 2 and k = 14 then concat(local_no, ',', local_no)
                             when attempt_id = 2 and k = 15 then concat(local_no, '.5')
                             when attempt_id = 1 and k % 10 = 6 then concat(local_no + 1) else concat(local_no) end, '],',
    if(attempt_id = 2 and k = 8, '"note":"x",', if(k = 21, '"pid":21,', '')),
    '"verdict":"', case when attempt_id = 2 and k = 9 then 'high_suspicious' when k % 9 = 4 then 'MEDIUM_SUSPICIOUS'
                        when k % 9 = 5 then 'LOW_SUSPICIOUS' else 'HIGH_SUSPICIOUS' end, '"}') end"""


def submissions(events: DataFrame, units: DataFrame) -> DataFrame:
    """unit_id, attempt_id, task, n_lines, payload. Items of a unit are at most the lines of a window."""
    kinds = "(task = 'lm' and event_type = 'purchase') or (task = 'persistence' and event_type = 'error') or (task = 'exfiltration' and event_type = 'signup')"
    size = W.window_size(F.col("representation"), B.LOG_SIZES)
    rows = events.filter("task <> 'classification'").withColumn("window_index", W.window_index(F.col("line_no"), size))
    spans = units.select("unit_id", "rel_path", "window_index", "start_line")
    rows = rows.join(spans, ["rel_path", "window_index"]).withColumn("attempt_id", F.explode(F.expr("array(0, 1, 2)")))
    field = F.create_map(*[F.lit(x) for pair in FINDING_FIELD.items() for x in pair])[F.col("task")]
    items = rows.filter(f"({kinds}) or (attempt_id = 1 and event_type = 'click')").withColumn("field", field).selectExpr(
        "*", "line_no - start_line + 1 as local_no",
        r"case task when 'lm' then host_name when 'exfiltration' then replace(path_name, '\\', '\\\\') else 'Create Account' end as entity",
    ).selectExpr("unit_id", "attempt_id", "line_no", f"{_ITEM} as item")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "item")))
    texts = items.groupBy("unit_id", "attempt_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["item"]), ",").alias("body")
    )
    all_units = units.select("unit_id", "task", "n_lines", "window_index").withColumn(
        "attempt_id", F.explode(F.expr("array(0, 1, 2)"))
    )
    out = all_units.join(texts, ["unit_id", "attempt_id"], "left")
    verdict = "if((n_lines + attempt_id) % 2 = 0, 'HIGH_SUSPICIOUS', 'LOW_SUSPICIOUS')"
    whole = f"""concat('{{"source_lines":[],"verdict":"', {verdict}, '"}}')"""
    body = f"if(task = 'classification', if(attempt_id = 2 and n_lines % 3 = 0, concat({whole}, ',', {whole}), {whole}), coalesce(body, ''))"
    tail = "case when attempt_id = 2 and window_index % 5 = 2 then '] x' when attempt_id = 2 and window_index % 5 = 1 then '' else ']' end"
    return out.selectExpr("unit_id", "attempt_id", "task", "n_lines", f"concat('[', {body}, {tail}) as payload")
