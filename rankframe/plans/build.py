"""E1 as a library job: landed listing and detail pages of any site folder in, canonical catalogue out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rankframe.operators.clean import canonicalise, prepare_catalog
from rankframe.operators.extract import enrich_catalog, extract_details, extract_listing, take_pages_until_repeat
from rankframe.session import cut_lineage


def build_catalog(listing_pages: DataFrame, detail_pages: DataFrame, base_url: str) -> DataFrame:
    """Listing pages -> rows -> take-while -> left join with detail pages -> clean -> canonical.

    ``listing_pages(page_id, start, html)`` in the order of ``start``, ``detail_pages(page_id, url, html)``;
    links are resolved against ``base_url``.  Each extraction's output is written once to the checkpoint
    folder (a stage boundary, as each step of the offline build hands a table to the next), so the
    HTML is parsed exactly once even though the take-while reads the rows twice.
    """
    extracted = cut_lineage(extract_listing(listing_pages, base_url), "listing-rows")
    rows = take_pages_until_repeat(extracted, listing_pages.select("page_id", "start"))
    details = cut_lineage(extract_details(detail_pages), "detail-fields")
    return canonicalise(prepare_catalog(enrich_catalog(rows.drop("page_id", "row_pos", "start"), details)))
