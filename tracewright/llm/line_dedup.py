"""Line dedup by site-relative frequency: lines on a large share of a site's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_RATIO = 0.1
MIN_PAGES = 10
# For training data, set from measured shares of a source's texts: the lines planted in every source are on 8.7 to 13.2 % of
# them, any other on 4.6 % or fewer. So small a floor leaves the verdict to the ratio from 48 texts on.
CORPUS_RATIO = 0.0625
CORPUS_PAGES = 3
# Parts that the pages of a site are dealt to where they meet its boilerplate, so that a hot site is not one task's.
SITE_PARTS = 32
# Elements whose content is not text, and those that begin and end a line.
HIDDEN = r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>|<!--.*?-->"
BREAKS = r"(?i)</?(p|div|li|ul|ol|h[1-6]|br|nav|article|section|table|tr|td|th|header|footer|title|head|body|html|aside|main)\b[^>]*>"
TAG = r"<[^>]*>"


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL; null without one."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


def html_lines(html: Column) -> Column:
    """Text of a page, a line per block, without tags, blank lines and white space at the ends of lines."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, "\n"), BREAKS, "\n"), TAG, "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n"), F.lit("\n "))


def boilerplate(docs: DataFrame, site: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(_site, _lines): per site the hashes of the lines on more than ``max_ratio`` of its pages.

    Pages are counted by distinct content, so copies of a page don't make its lines boilerplate, and a line must be on
    ``min_pages`` of them. Counting goes by (site, line, page) and then (site, line), so a hot site or line is summed before
    it meets itself. A site has fewer than (lines per page) / max_ratio such lines.
    """
    page = F.xxhash64(F.col(text)).alias("page")
    known = docs.filter(F.col(site).isNotNull() & F.col(text).isNotNull())
    lines = known.select(F.col(site).alias("site"), page, F.explode(F.array_distinct(F.split(text, "\n"))).alias("line")).filter(F.trim("line") != "")
    pages = lines.select("site", "page", F.xxhash64("line").alias("line")).distinct()
    counts = pages.groupBy("site", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    sizes = known.select(F.col(site).alias("_of"), page).distinct().groupBy("_of").agg(F.count(F.lit(1)).alias("total"))
    found = counts.join(sizes, F.col("site") == F.col("_of")).filter(F.col("n") > max_ratio * F.col("total"))
    return found.groupBy(F.col("site").alias("_site")).agg(F.collect_list("line").alias("_lines"))


def drop_boilerplate(docs: DataFrame, site: str, text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with the boilerplate lines of their site taken out of ``text``, and ``n_lines``, ``n_dropped``.

    Rows whose site or text is null, and those of sites with nothing to drop, stay as they are. A page of boilerplate
    alone keeps its row with an empty text. Blank lines stay. Repeated rows are treated alike; a line equals the whole of
    another or not, ties don't arise. Columns ``n_lines`` and ``n_dropped`` of the input are replaced.
    """
    lines = F.split(text, "\n")
    keep = F.filter(lines, lambda line: ~F.array_contains(F.col("_lines"), F.xxhash64(line)) | (F.trim(line) == ""))
    found = boilerplate(docs, site, text, max_ratio, min_pages)
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    parts = found.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SITE_PARTS - 1))))
    dealt = docs.select(*rest, F.pmod(F.xxhash64(text), F.lit(SITE_PARTS)).cast("int").alias("_of"))
    joined = dealt.join(parts, (F.col(site) == F.col("_site")) & (F.col("_of") == F.col("_part")), "left")
    kept = joined.withColumn("_kept", F.when(F.col("_lines").isNotNull(), keep))
    columns = [F.when(F.col("_kept").isNull(), F.col(c)).otherwise(F.array_join("_kept", "\n")).alias(c) if c == text else F.col(c) for c in rest]
    n = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines))
    return kept.select(*columns, n.alias("n_lines"), F.coalesce(F.size(lines) - F.size("_kept"), F.lit(0)).alias("n_dropped"))


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, host, text) of raw pages, written once."""
    return cut_lineage(pages.select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text")))
