"""Paged JSON pulls that were landed as files: one page document per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "struct<items:array<map<string,string>>,page:bigint,page_size:bigint,total:bigint,has_next:boolean>"


class IncompletePull(ValueError):
    """A pull lacks pages."""


def parse_pages(documents: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """Page documents (text column `json`) with their envelope as columns."""
    page = F.from_json(F.col(json), PAGE)
    return documents.select(*keep, page.alias("_page")).select(*keep, "_page.*")


def page_items(pages: DataFrame, keep: list[str]) -> DataFrame:
    """One raw row per item; `row_index` follows pages, then places in a page."""
    return pages.select(*keep, "page", "page_size", F.posexplode("items").alias("place", "raw")).select(
        *keep, ((F.col("page") - 1) * F.col("page_size") + F.col("place")).alias("row_index"), "raw"
    )


def completeness(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Per pull: pages and items seen, and whether the last page is among them."""
    counted = pages.groupBy(*keep).agg(
        F.count_distinct("page").alias("page_count"),
        F.sum(F.size("items")).alias("item_count"),
        F.max("page").alias("last_page"),
        F.bool_or(~F.col("has_next")).alias("ended"),
    )
    return counted.select(
        *keep, "page_count", "item_count",
        (F.col("ended") & (F.col("page_count") == F.col("last_page"))).alias("complete"),
    )


def read_pull(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows of one landed pull; refuses a pull with missing pages."""
    pages = parse_pages(spark.read.text(folder), "value", [])
    seen = completeness(pages, []).first()
    if not seen or not seen.complete:
        raise IncompletePull(f"{folder} holds {seen.page_count if seen else 0} pages and no complete pull")
    return page_items(pages, [])
