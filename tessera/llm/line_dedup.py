"""Line dedup by site-relative frequency.

For each host, the pages that contain a line are divided by the host's pages; a line over the ratio, on at least
min_pages pages, is boilerplate of that host and goes from all its pages. A host has at most (mean distinct lines a
page) / ratio such lines, so that they travel as one array a host. Texts move only if the table of these arrays is too large
to broadcast; then the pages of a host with a share of 1 / SALTS of all pages or more are dealt over salts, each of which has
a copy of the host's array, so that no key holds a larger share. There are at most SALTS such hosts and 2 * SALTS such copies.

Defined results: null text stays null and counts as a page without lines; null host is a host of its own; lines
without a word are never dropped; repeated rows are pages of their own; a text that loses all its lines becomes empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, has_columns, let, materialize

RATIO = 0.1
MIN_PAGES = 5
SALTS = 4096


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _is_text(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(_site, _drop, _pages): per host that has any the MD5 digests of its boilerplate lines, and its pages."""
    own = pages.select(_site(F.col(host)).alias("_site"), F.array_distinct(F.filter(_lines(F.col(text)), _is_text)).alias("_lines"))
    totals = own.groupBy("_site").agg(F.count(F.lit(1)).alias("_pages"))
    counts = own.select("_site", F.explode("_lines").alias("_line")).select("_site", F.md5(F.col("_line").cast("binary")).alias("_md5")).groupBy("_site", "_md5").agg(F.count(F.lit(1)).alias("_n"))
    often = counts.where(F.col("_n") >= min_pages).join(totals, "_site").where(F.col("_n") > F.col("_pages") * F.lit(ratio))
    return often.groupBy("_site").agg(F.sort_array(F.collect_set("_md5")).alias("_drop"), F.first("_pages").alias("_pages"))


def salted(pages: DataFrame, found: DataFrame, host: str, text: str, site: str, salt: str, salts: int = SALTS) -> tuple[DataFrame, DataFrame]:
    """(pages with site and salt, found with a row for each salt of a host): found is (_site, _drop, _pages)."""
    total = found.agg(F.sum("_pages")).first()[0] or 1
    share = F.ceil(F.col("_pages") * salts / F.lit(total)).cast("int")  # of the pages that have something to lose
    hot = found.where(share > 1).select(F.col("_site").alias(site), share.alias(salt))  # at most `salts` rows, as shares sum to 1
    turns = fresh(pages, "_turns")
    spread = [c for c, kind in pages.dtypes if c != text and "map<" not in kind and "variant" not in kind] or [text]  # copies of a text differ there
    dealt = pages.withColumn(site, _site(F.col(host))).join(F.broadcast(hot.withColumnRenamed(salt, turns)), site, "left")
    dealt = dealt.withColumn(salt, F.pmod(F.xxhash64(*spread), F.coalesce(turns, F.lit(1))).cast("int")).drop(turns)
    return dealt, found.withColumn(salt, F.explode(F.sequence(F.lit(0), share - 1))).withColumnRenamed("_site", site)


def _site(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))


def line_dedup(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = False, salts: int = SALTS) -> DataFrame:
    """pages with boilerplate lines taken out of text; counts adds n_lines and n_dropped (long), in place of
    existing columns of these names."""
    has_columns(pages, host, text)
    found = materialize(boilerplate(pages, host, text, ratio, min_pages))
    site, salt, drop, lines, kept = (fresh(pages, n) for n in ("_site_key", "_salt", "_drop_lines", "_all_lines", "_kept_lines"))
    dealt, found = salted(pages, found, host, text, site, salt, salts)
    joined = dealt.join(found.select(site, salt, F.col("_drop").alias(drop)), [site, salt], "left").withColumn(lines, _lines(F.col(text)))
    digest = lambda s: F.md5(s.cast("binary"))
    # the host's list is hashed once a page; its lines are then held against those of the list that the page has
    own = let(F.array_intersect(F.transform(lines, digest), drop), lambda hit: F.filter(F.col(lines), lambda s: ~(_is_text(s) & F.array_contains(hit, digest(s)))))
    joined = joined.withColumn(kept, F.when(F.col(drop).isNull(), F.col(lines)).otherwise(own))
    body = F.when(F.col(text).isNull() | F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(F.col(kept), "\n"))
    n = lambda c: F.coalesce(F.when(F.col(lines).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    out = [body.alias(c) if c == text else F.col(c) for c in pages.columns if not counts or c.lower() not in ("n_lines", "n_dropped")]
    return joined.select(*out, *([n(lines).alias("n_lines"), (n(lines) - n(kept)).alias("n_dropped")] if counts else []))
