"""Project status and page summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import visible_text
from ..operators.classify import jsonld_types, page_links, page_meta
from ..operators.quality import cross_source_duplicates, status_counts
from ..sources.pages import next_state



def project_status(sources: DataFrame, records: DataFrame, quarantine: DataFrame) -> DataFrame:
    """metric, label, value: counts by status and lane, enabled sources, records, duplicates across sources, quarantine."""
    def metric(name: str, df: DataFrame, label=None) -> DataFrame:
        return df.select(F.lit(name).alias("metric"), (F.lit("") if label is None else F.col(label)).alias("label"),
                         F.col("n").cast("bigint").alias("value"))

    def count(df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("n"))

    parts = [
        metric("sources", count(sources)),
        metric("by_status", status_counts(sources, "status", "?"), "status"),
        metric("by_lane", status_counts(sources, "lane", "undetected"), "lane"),
        metric("enabled", count(sources.filter("enabled"))),
        metric("records", count(records)),
        metric("records_by_source", records.groupBy("source").agg(F.count("*").alias("n")), "source"),
        metric("cross_source_duplicates", count(cross_source_duplicates(records))),
        metric("quarantined", count(quarantine)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def page_summary(pages: DataFrame, max_chars: int | None = None, offset: int = 0, closed: bool = False) -> DataFrame:
    """What a reader needs to judge a page: meta data, JSON-LD types, state keys, links, visible text and the HTML from `offset` on; with
    `max_chars` a slice of it and the offset of the next one."""
    html = F.col("html")
    props = F.try_variant_get(next_state(html), "$.props.pageProps", "map<string,variant>")
    size = F.length(html)
    return pages.select(
        "page_id", "url", page_meta(html, closed).alias("meta"), jsonld_types(html).alias("jsonld_types"),
        F.map_keys(props).alias("state_keys"),
        page_links(html, F.col("url"), closed=closed).alias("links"),
        visible_text(html, closed).alias("visible_text"),
        F.substring(html, offset + 1, max_chars or (1 << 31) - 1 - offset).alias("html"), size.alias("html_total"),
        F.when(size > offset + max_chars, F.lit(offset + max_chars)).alias("next_offset") if max_chars else F.lit(None).cast("int").alias("next_offset"))
