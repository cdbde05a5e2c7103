"""Entity normalisation and alias columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lookups import SUSPICIOUS_HOSTS

from .timestamps import ws_trim


def unescape(value: Column) -> Column:
    """Doubled backslashes to single ones."""
    return F.replace(value, F.lit("\\\\"), F.lit("\\"))


def norm_host(value: Column) -> Column:
    return F.rtrim(F.btrim(F.lower(ws_trim(value)), F.lit("[]")), F.lit("."))


def norm_technique(value: Column) -> Column:
    return ws_trim(F.regexp_replace(F.replace(F.lower(value), F.lit("-"), F.lit(" ")), r"\s+", " "))


def norm_path(value: Column, case_insensitive: Column) -> Column:
    path = F.regexp_replace(F.btrim(ws_trim(value), F.lit("'\"")), r"\\{2,}", r"\\")
    return F.when(case_insensitive, F.lower(path)).otherwise(path)


def norm_entity(kind: Column, value: Column, case_insensitive: Column) -> Column:
    return (
        F.when(kind == "host", norm_host(value))
        .when(kind == "technique", norm_technique(value))
        .when(kind == "path", norm_path(value, case_insensitive))
    )


def clean_aliases(aliases: Column) -> Column:
    """Trim; drop empty and ``no value`` entries."""
    trimmed = F.transform(aliases, ws_trim)
    return F.filter(trimmed, lambda a: (a != "") & (F.lower(a) != "no value"))


_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_IPV6_TAIL = r"(:[0-9a-fA-F]{0,4}){2,7}(%.+)?$"


def suspicious_host(alias: Column) -> Column:
    """Reason why an address cannot be a movement target, else null."""
    is_v4 = alias.rlike(_IPV4)
    first = F.substring_index(alias, ".", 1).try_cast("int")
    multicast = (is_v4 & first.between(224, 239)) | alias.rlike(r"^[fF]{2}[0-9a-fA-F]{2}" + _IPV6_TAIL)
    link_local = (is_v4 & alias.startswith("169.254.")) | alias.rlike(r"^[fF][eE][89abAB][0-9a-fA-F]" + _IPV6_TAIL)
    return (
        F.when(multicast, SUSPICIOUS_HOSTS["multicast"])
        .when(link_local, SUSPICIOUS_HOSTS["link_local"])
        .when(is_v4 & alias.endswith(".255"), SUSPICIOUS_HOSTS["broadcast"])
    )


def alias_on_line(entity_kind: Column, aliases: Column, line: Column) -> Column:
    """First alias that the line contains, else the first alias."""
    hay = unescape(F.lower(line))
    found = F.filter(aliases, lambda a: F.contains(hay, unescape(F.lower(a))))
    return F.when(entity_kind == "technique", F.get(aliases, F.lit(0))).otherwise(
        F.coalesce(F.get(found, F.lit(0)), F.get(aliases, F.lit(0)))
    )


def path_pattern(alias: Column) -> Column:
    """Pattern of a path alias in which each backslash matches one to four of them, without case."""
    flexible = F.replace(alias, F.lit("\\"), F.lit(r"\E\\{1,4}\Q"))
    return F.concat(F.lit(r"(?iu)\Q"), flexible, F.lit(r"\E"))
