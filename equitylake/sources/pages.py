"""Raw-page sources: fetched pages as a table, and the URL sets a run asks for.

Fetching is outside the engine: a crawler (or the fetch-log operators in
``operators.fetchlog``) leaves ``(page_id, url, html)`` rows; an empty or
NULL body is the ``invalid_page`` error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES: URL templates of the source site (listing page per initial
# letter and page number; detail page per ISIN), and the discovery grid.
LISTING_URL = "https://www.borsaitaliana.it/borsa/azioni/listino-a-z.html?initial=%s&page=%d&lang=it"
DETAIL_URL = "https://www.borsaitaliana.it/borsa/azioni/dati-completi.html?isin=%s&lang=it"
LETTERS = 26
PAGES_PER_LETTER = 9


def listing_grid(spark: SparkSession, pages_per_letter: int = PAGES_PER_LETTER) -> DataFrame:
    """The listing URLs that tell a crawler what to fetch: letters A-Z, pages
    1 to ``pages_per_letter`` (the site's grid has 9)."""
    g = spark.range(LETTERS * pages_per_letter)
    letter = F.char(F.lit(65) + (F.col("id") / pages_per_letter).cast("int"))
    page = (F.col("id") % pages_per_letter + 1).cast("int")
    return g.select(letter.alias("letter"), page.alias("page"),
                    F.format_string(LISTING_URL, letter, page).alias("url"))


def detail_url(isin: Column) -> Column:
    return F.format_string(DETAIL_URL, isin)
