"""Record-time columns. Every result is wall clock (``TIMESTAMP_NTZ``), never session-zone time.

Formatting goes through ``cast(ts as string)``: ``date_format`` and ``date_trunc`` would first cast
to a session-zone timestamp and move wall-clock times that fall into a daylight-saving gap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "America/Chicago"

# The recognised time formats.
FORMAT_PATTERNS = {
    "epoch": r"^\d{9,11}(\.\d+)?$",
    "windows": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AP]M$",
    "iso": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
    "iso_minute": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$",
    "iso_offset": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?[+-]\d{2}:\d{2}$",
}
# Where a line of each view carries its time.
EDGE_TIME = r"^\((.*?)\)"
RAW_TIME = r"msg=audit\((\d+\.\d+):\d+\)"

_WHITESPACE = " \t\n\r\f\u000b"
_WINDOWS_CLOCK = r"^(\d{1,2})/(\d{1,2})/(\d{4}) (0?[1-9]|1[0-2]):(\d{2}):(\d{2}) [AP]M$"
# Every format but the epoch becomes ``y-m-d h:m[:s]`` text and shares one cast.
_CALENDAR = "|".join(f"(?:{FORMAT_PATTERNS[f]})" for f in ("iso", "iso_minute", "iso_offset")) + f"|(?:{_WINDOWS_CLOCK})"


def ws_trim(text: Column) -> Column:
    """Strip all leading and trailing ASCII whitespace (SQL ``trim`` strips spaces only)."""
    return F.btrim(text, F.lit(_WHITESPACE))


def classify_format(raw: Column) -> Column:
    """Name of the time format of ``raw``, null when none applies."""
    value = ws_trim(raw)
    out = None
    for name, pattern in FORMAT_PATTERNS.items():
        out = F.when(value.rlike(pattern), name) if out is None else out.when(value.rlike(pattern), name)
    return out


def _ntz(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def _from_epoch(value: Column) -> Column:
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), value.try_cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_ZONE), start + seconds)


def _half_day(value: Column) -> Column:
    """Hours between the clock as written and the 24-hour clock: 12 AM is 0, 1 PM is 13."""
    hours = F.when(value.rlike(r"^\S+ 12:.*AM$"), -12).when(value.rlike(r"^\S+ (?!12:).*PM$"), 12).otherwise(0)
    return F.make_dt_interval(F.lit(0), hours)


def parse_record_time(raw: Column) -> Column:
    """Any recognised format to wall clock. Impossible dates give null. An offset is not applied.

    The expression is kept small: it is evaluated for every log line and must fit generated code.
    """
    value = ws_trim(raw)
    text = F.regexp_replace(value, _WINDOWS_CLOCK, r"$3-$1-$2 $4:$5:$6")
    text = F.regexp_replace(text, r"[+-]\d{2}:\d{2}$", "")
    return F.when(value.rlike(FORMAT_PATTERNS["epoch"]), _from_epoch(value)).when(
        value.rlike(_CALENDAR), _ntz(text) + _half_day(value)
    )


def extract_raw_time(line: Column, representation: Column) -> Column:
    """Time text of a log line: the leading ``(...)`` of an edge line, the audit stamp of a raw one."""
    found = F.when(representation == "raw", F.regexp_extract(line, RAW_TIME, 1)).otherwise(
        F.regexp_extract(line, EDGE_TIME, 1)
    )
    return F.nullif(found, F.lit(""))


def line_time(line: Column, representation: Column) -> Column:
    return parse_record_time(extract_raw_time(line, representation))


def to_precision(ts: Column, precision: Column) -> Column:
    """Wall clock as text, cut to ``second`` or ``minute``."""
    text = ts.cast("string")
    return F.when(precision == "minute", F.substring(text, 1, 16)).when(
        precision == "second", F.substring(text, 1, 19)
    )


def parse_annotation_time(raw: Column) -> Column:
    """Annotation stamp, to the second or else to the minute."""
    value = ws_trim(raw)
    known = value.rlike(FORMAT_PATTERNS["iso"]) | value.rlike(FORMAT_PATTERNS["iso_minute"])
    return F.when(known, _ntz(value))


def annotation_precision(raw: Column) -> Column:
    value = ws_trim(raw)
    return F.when(value.rlike(FORMAT_PATTERNS["iso"]), "second").when(
        value.rlike(FORMAT_PATTERNS["iso_minute"]), "minute"
    )


def norm_timestamp(raw: Column, precision: Column) -> Column:
    return to_precision(parse_record_time(raw), precision)
