"""Line dedup: lines that stand on a large share of a host's pages are boilerplate of that host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.tables import fresh, staged


def boilerplate(docs: DataFrame, host: str, ratio: float, least_pages: int, copies_once: bool = False) -> DataFrame:
    """``host, _lines``: hashes of each host's boilerplate lines.

    A page counts a line once; with ``copies_once`` pages of one host with the same text count as one. A host
    has fewer than (distinct lines per page) / ``ratio`` such lines, so the array of a host stays short however
    many pages the host has.
    """
    keys = F.transform(F.split("text", "\n"), lambda x: F.when(F.trim(x) != "", F.xxhash64(x)))
    pages = docs.select(F.coalesce(F.col(host), F.lit("")).alias("_host"), F.array_distinct(F.array_compact(keys)).alias("_keys"), F.xxhash64("text").alias("_page"))
    if copies_once:
        pages = pages.dropDuplicates(["_host", "_page"])
    totals = pages.groupBy("_host").agg(F.count("*").alias("_pages"))
    lines = (
        pages.select("_host", F.explode_outer("_keys").alias("_key")).where("_key IS NOT NULL")
        .groupBy("_host", "_key").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_pages)
    )
    return (
        lines.join(totals, "_host").where(F.col("_n") > F.lit(ratio) * F.col("_pages"))
        .groupBy("_host").agg(F.sort_array(F.collect_list("_key")).alias("_lines"))
    )


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = 0.1, least_pages: int = 3, copies_once: bool = False) -> DataFrame:
    """``docs`` with ``text`` rid of its host's boilerplate, and ``n_lines``, ``n_dropped``.

    Dropped are lines that stand on at least ``least_pages`` pages and on more than ``ratio`` of the pages of
    their host. Lines of ASCII spaces only are never dropped. A null text stays null and has no lines; a page
    that loses every line has an empty text. Pages without a host form one host; repeated rows are pages of
    their own, so the lines of a page with many copies are boilerplate and all its copies are emptied. With
    ``copies_once`` pages of a host with the same text count as one page, and copies keep their text; near copies
    are still pages of their own. Other columns are kept; columns named ``n_lines`` or ``n_dropped`` are replaced.
    """
    site, lines, kept = (fresh(docs, n) for n in ("host", "lines", "kept"))
    found = staged(boilerplate(docs, host, ratio, least_pages, copies_once).toDF(site, lines), "boilerplate")
    whole = F.split("text", "\n")
    rest = F.filter(whole, lambda x: (F.trim(x) == "") | ~F.array_contains(lines, F.xxhash64(x)))
    marked = docs.withColumn(site, F.coalesce(F.col(host), F.lit(""))).join(found, site, "left")
    count = lambda x: F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(x)).cast("long")
    return (
        marked.withColumn(kept, F.when(F.col(lines).isNull(), whole).otherwise(rest))
        .withColumn("n_lines", count(whole))
        .withColumn("n_dropped", F.col("n_lines") - count(F.col(kept)))
        .withColumn("text", F.when(F.col("text").isNotNull(), F.concat_ws("\n", kept)))
        .drop(site, lines, kept)
    )
