"""Page records and corpus tables: acceptance, classification in order, link joins, statistics, crawl frontier, layout."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import web
from tessera.functions.expr import problems
from tessera.sources.store import stored


def response_problems(site: str, status: Column, success: Column, final_url: Column, content_type: Column, html: Column, title: Column, want_canonical: Column, want_title: Column, language: str = "pt") -> Column:
    """D3: why a fetched page isn't the approved one; after a failed request nothing else is looked at."""
    failed = ~F.coalesce(success, F.lit(False)) | ~status.eqNullSafe(F.lit(200))
    lang = F.coalesce(X.attribute(html, X.HTML_LANG), F.lit(""))
    canonical = X.attribute(html, X.HTML_CANONICAL)
    rest = problems(
        (web.host(final_url) != site, "left the domain"),
        (~F.contains(F.coalesce(content_type, F.lit("")), F.lit("text/html")), "unexpected content type"),
        (~F.startswith(F.lower(lang), F.lit(language)), F.concat(F.lit("html lang is "), lang)),
        (canonical.isNotNull() & (F.concat(F.rtrim(canonical, F.lit("/")), F.lit("/")) != want_canonical), "canonical address changed"),
        (~title.eqNullSafe(want_title), "title changed"),
    )
    return F.when(failed, F.array(F.concat(F.lit("HTTP "), F.coalesce(status.cast("string"), F.lit("none"))))).otherwise(rest)


def classify_pages(pages: DataFrame, rules: Sequence[web.Rule], language: str = "pt", least_words: int = 80, overlap: float = 0.6) -> DataFrame:
    """The verdict on each page, first reason first: rule, not fetched, failed, other language, second page of a canonical
    address, too few words, already in the corpus.

    pages: url, canonical_url, fetched, status_code, html_lang, content_lang, words, overlap, overlap_doc. The owner of a
    canonical address is the first page in order of url among all that were fetched in the language, whatever their rule.
    """
    rule = web.classify(F.col("canonical_url"), rules)
    foreign = (~F.startswith(F.lower(F.coalesce("html_lang", F.lit(language))), F.lit(language)) & (F.coalesce("html_lang", F.lit("")) != "")) | (F.coalesce("content_lang", F.lit("")) == "en")
    p = pages.withColumn("_r", rule).withColumn("_ok", F.coalesce(F.col("fetched") & (F.col("status_code") < 400), F.lit(False))).withColumn("_own", F.col("_ok") & ~foreign)
    owner = F.min(F.when(F.col("_own"), F.col("url"))).over(Window.partitionBy("canonical_url"))
    p = p.withColumn("_owner", owner)
    live = F.col("_r.status").isin("candidate", "review")
    told = lambda s, r: F.struct(F.lit(s).alias("status") if isinstance(s, str) else s.alias("status"), (F.lit(r) if isinstance(r, str) else r).alias("reason"))
    short = F.col("words") < least_words
    verdict = (
        F.when(~F.col("fetched") & live, told("review", F.concat("_r.reason", F.lit("; not fetched"))))
        .when(~F.col("fetched"), told(F.col("_r.status"), F.col("_r.reason")))
        .when(~F.col("_ok"), told("unavailable", F.concat(F.lit("HTTP "), F.coalesce(F.col("status_code").cast("string"), F.lit("none")))))
        .when(foreign, told("excluded", "other language"))
        .when(live & (F.col("_owner") != F.col("url")), told("duplicate", F.concat(F.lit("same canonical address as "), "_owner")))
        .when(live & short & (F.col("_r.page_type") == "experience"), told("review", "few words"))
        .when(live & short, told("excluded", "near-empty main content"))
        .when((F.col("_r.status") == "candidate") & (F.coalesce("overlap", F.lit(0.0)) >= overlap), told("already_in_corpus", F.concat(F.lit("contained in "), F.col("overlap_doc").cast("string"))))
        .otherwise(told(F.col("_r.status"), F.col("_r.reason")))
    )
    return p.withColumn("_v", verdict).select(*pages.columns, F.col("_r.page_type").alias("page_type"), F.col("_r.category").alias("category"), F.col("_v.status").alias("status"), F.col("_v.reason").alias("reason"))


def attach_sources(fetched: DataFrame, links: DataFrame, key: str = "url") -> DataFrame:
    """Fetched records with the sorted sources of their links; linked addresses that weren't fetched become rows too."""
    sources = links.groupBy(key).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return fetched.withColumn("_f", F.lit(True)).join(sources, key, "full_outer").withColumn("fetched", F.coalesce("_f", F.lit(False))).withColumn("sources", F.coalesce("sources", F.array().cast("array<string>"))).drop("_f")


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], depth: int = 3, budget: int = 300, site_map: DataFrame | None = None) -> DataFrame:
    """Breadth-first (url, depth) up to a depth and a page budget; fetch (injected) gives (url, link) for a frontier.

    Each level is an anti-join of the new links with all that was seen; of a level that passes the budget the first
    addresses in order stay (the budget is the feature). Addresses of site_map (url) that the links didn't reach follow, with
    null as depth, as far as the budget goes.
    """
    seen = stored(seeds.select("url").distinct().orderBy("url").limit(budget).withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        left = budget - seen.count()
        if left <= 0 or front.isEmpty():
            break
        links = fetch(front.select("url")).select(F.col("link").alias("url")).distinct()
        front = stored(links.join(seen.select("url"), "url", "left_anti").orderBy("url").limit(left).withColumn("depth", F.lit(d)))
        seen = stored(seen.unionByName(front))
    left = budget - seen.count()
    if site_map is None or left <= 0:
        return seen
    gaps = site_map.select("url").distinct().join(seen.select("url"), "url", "left_anti").orderBy("url").limit(left)
    return seen.unionByName(gaps.withColumn("depth", F.lit(None).cast("int")))


def listing_samples(pages: DataFrame, kinds: Sequence[str], key: str = "url", kind: str = "page_type", each: int = 2) -> DataFrame:
    """Of the pages of the named listing types the first few of each in order of address; pages of other types all stay."""
    few = pages.where(F.col(kind).isin(*kinds))
    # the first of each type by a minimum, then of the rest, so that no type is ranked in one task
    out = pages.where(~F.coalesce(F.col(kind).isin(*kinds), F.lit(False)))
    for _ in range(each):
        first = few.groupBy(kind).agg(F.min(key).alias("_first"))
        out = out.unionByName(few.join(first, (few[kind] == first[kind]) & (F.col(key) == F.col("_first")), "left_semi"))
        few = few.join(first.select("_first"), F.col(key) == F.col("_first"), "left_anti")
    return out


def first_of_each(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in order, with all its columns. Rows are compared in a partially aggregated minimum, so that
    a key of any size is no one task's."""
    at = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*key).agg(at.alias("_first")).select(*[F.col("_first")[c].alias(c) for c in rows.columns])


def group_counts(df: DataFrame, column: str) -> DataFrame:
    """A1: (value, n) by the value as text, null as "None"."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def corpus_statistics(chunks: DataFrame, size: int = 1000) -> DataFrame:
    """A3: one row of counts over a chunk table, in one pass."""
    c = F.col
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("document_id").alias("documents"),
        F.countDistinct(F.when(c("source_type") == "pdf", c("document_id"))).alias("documents_pdf"), F.countDistinct(F.when(c("source_type") == "web_page", c("document_id"))).alias("documents_web"),
        F.count_if(c("source_type") == "pdf").alias("chunks_pdf"), F.count_if(c("source_type") == "web_page").alias("chunks_web"),
        F.count_if(c("body_chars") < 100).alias("body_under_100"), F.count_if(c("body_chars") > size).alias("body_over_size"), F.count_if(F.char_length("text") > size).alias("rendered_over_size"),
        F.count_if(c("unit_chunk_count") > 1).alias("split_units_chunks"), F.count_if(c("overlap_chars") > 0).alias("chunks_with_overlap"), F.count_if(F.size("source_pages") > 1).alias("multi_page_chunks"),
        F.count_if(c("section").isNull()).alias("without_section"), F.count_if(c("subsection").isNotNull()).alias("with_subsection"),
    )


def corpus_counts(chunks: DataFrame) -> DataFrame:
    """A3: (field, value, n) by document, category, unit role and source type, null as "None"; for documents also the pages of
    labels, and notes on conflicts, where the table has them."""
    fields = [f for f in ("document_id", "primary_category", "unit_role", "source_type") if f in chunks.columns]
    each = [F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("None")).alias("value"), F.lit(True).alias("counts")) for f in fields]
    if "conflict_notes" in chunks.columns:
        each.append(F.struct(F.lit("conflict_notes").alias("field"), F.lit("with").alias("value"), (F.coalesce("conflict_notes", F.lit("")) != "").alias("counts")))
    flat = chunks.select(F.explode(F.array(*each)).alias("x")).select("x.*").where("counts")
    return flat.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def small_and_large(chunks: DataFrame, least: int = 100, most: int = 1000) -> DataFrame:
    """A3: (chunk_id, body_chars, kind) of chunks whose body is under or over a size."""
    kind = F.when(F.col("body_chars") < least, "small").when(F.col("body_chars") > most, "large")
    return chunks.select("chunk_id", "body_chars", kind.alias("kind")).where(F.col("kind").isNotNull())


def summary_counts(pages: DataFrame) -> DataFrame:
    """(field, value, n) of status, page type, category and language in one pass."""
    fields = [f for f in ("status", "page_type", "category", "html_lang") if f in pages.columns]
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return pages.select(F.explode(each).alias("x")).select("x.*").where(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def merged_headings(lines: DataFrame, key: str, position: str, line: str) -> DataFrame:
    """(key, position, line): a heading and the general headings right after it are one line."""
    order = Window.partitionBy(key).orderBy(position)
    rows = lines.select(key, position, F.trim(F.regexp_replace(line, r"[\t\f ]+", " ")).alias("line"))
    general, heading = X.is_heading(F.col("line")), X.is_heading(F.col("line")) | X.numbered_heading(F.col("line")).isNotNull()
    follows = general & F.coalesce(F.lag(heading).over(order), F.lit(False))
    islands = rows.withColumn("_i", F.sum(F.when(follows, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "_i").agg(F.min(position).alias(position), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), "line"))), lambda x: x["line"]), " ").alias("line")).drop("_i")


# The line that runs along the edge of every page, and a place's position.
RUNNING_HEADER = r"(?i)^(?:\d+\s+)?Coimbra,\s*Património Mundial(?:\s+\d+)?$"
COORDINATES = r"(?i)^coordenadas\s*:\s*([+-]?\d+(?:\.\d+)?\s*,\s*[+-]?\d+(?:\.\d+)?)$"
LIST_ITEM = r"^(?:[-•]|\d+[.)])\s+"


def page_body(lines: DataFrame, key: str, position: str, line: str, section_headings: Sequence[str] = (), running_header: str = RUNNING_HEADER) -> DataFrame:
    """(key, body, headings) of a page's lines: numbered headings, positions, headings and list items are blocks of their own,
    runs of other lines are paragraphs without their line breaks, blank lines and the running header part them."""
    merged = merged_headings(lines, key, position, line)
    x = F.col(line)
    number = X.numbered_heading(x)
    known = x.isin(*section_headings) if section_headings else F.lit(False)
    kind = (
        F.when(x == "", "blank").when(x.rlike(running_header), "blank").when(number.isNotNull(), "route").when(x.rlike(COORDINATES), "coordinates")
        .when(known, "section").when(X.is_heading(x), "heading").when(x.rlike(LIST_ITEM), "item").otherwise("text")
    )
    order = Window.partitionBy(key).orderBy(position)
    rows = merged.withColumn("_kind", kind)
    starts = (F.col("_kind") != "text") | (F.coalesce(F.lag("_kind").over(order), F.lit("")) != "text")
    islands = rows.withColumn("_island", F.count(F.when(starts, 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_kind") != "blank")
    held = islands.groupBy(key, "_island").agg(F.any_value("_kind").alias("_kind"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), x.alias("x")))), lambda e: e["x"]).alias("l"))
    one = F.get("l", F.lit(0))
    numbered = X.numbered_heading(one)
    text = (
        F.when(F.col("_kind") == "route", F.concat(F.lit("## "), numbered["number"].cast("string"), F.lit(". "), numbered["title"])).when(F.col("_kind") == "coordinates", F.concat(F.lit("**Coordenadas:** "), F.regexp_extract(one, COORDINATES, 1)))
        .when(F.col("_kind") == "section", F.concat(F.lit("## "), one)).when(F.col("_kind") == "heading", F.concat(F.lit("### "), one)).when(F.col("_kind") == "item", one).otherwise(X.join_wrapped(F.col("l")))
    )
    told = held.select(key, "_island", text.alias("text"), F.col("_kind").isin("route", "section", "heading").alias("head"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_island", "text"))), lambda e: e["text"]), "\n\n")
    return told.groupBy(key).agg(body.alias("body"), F.count_if("head").alias("headings"))


def column_of(x0: Column, width: Column) -> Column:
    """The column (0 to 2) of a block on a three-column route page."""
    return F.least(F.lit(2), F.greatest(F.lit(0), ((x0 - width * 0.25) / (width * 0.24)).cast("int")))


def panel_tops(blocks: DataFrame, page: str = "page") -> DataFrame:
    """(page, column, top) of caption panels: the nearest title of 14 pt or more above a marker ("a. b. c."), or the marker.

    blocks: page, x0, y0, width, size, text. Marks and titles are few on a page, so that the join is small.
    """
    rows = blocks.select(page, column_of(F.col("x0"), F.col("width")).alias("column"), "y0", "size", "text")
    marks = rows.where(F.col("text").rlike(r"^(?:[a-z]\.\s*){2,}$")).select(page, "column", F.col("y0").alias("mark"))
    titles = rows.where(F.col("size") >= 14.0).select(page, "column", F.col("y0").alias("title"))
    near = marks.join(titles, [page, "column"], "left").groupBy(page, "column", "mark").agg(F.max(F.when(F.col("title") <= F.col("mark"), F.col("title"))).alias("t"))
    return near.groupBy(page, "column").agg(F.min(F.coalesce("t", "mark")).alias("top"))


def route_page_text(blocks: DataFrame, page: str = "page") -> DataFrame:
    """(page, text) of a route page's body: margins cropped, caption panels cut, columns in order, and a sentence
    that a panel parted at a column break joined again."""
    tops = panel_tops(blocks, page)
    rows = blocks.where((F.col("x0") >= F.col("width") * 0.25) & (F.col("y0") >= F.col("height") * 0.12) & (F.col("y0") <= F.col("height") * 0.96) & (F.trim("text") != ""))
    body = rows.withColumn("column", column_of(F.col("x0"), F.col("width"))).join(tops, [page, "column"], "left").where(F.col("top").isNull() | (F.col("y0") < F.col("top")))
    order = Window.partitionBy(page).orderBy("column", "y0")
    last = body.withColumn("_next", F.lead("column").over(order)).withColumn("_open", F.col("top").isNotNull() & (F.col("_next") == F.col("column") + 1) & ~F.trim("text").rlike(r"[.!?:;”»\"')]$"))
    joined = last.withColumn("_glue", F.when(F.coalesce(F.lag("_open").over(order), F.lit(False)), "\n").otherwise("\n\n"))
    parts = F.array_sort(F.collect_list(F.struct("column", "y0", "_glue", "text")))
    return joined.groupBy(page).agg(F.regexp_replace(F.array_join(F.transform(parts, lambda p: F.concat(p["_glue"], F.trim(p["text"]))), ""), r"^\n+", "").alias("text"))


def map_sidebar(blocks: DataFrame, page: str = "page", least: int = 120) -> DataFrame:
    """(page, text) of a map page's sidebar, from the block before the first one of body length."""
    side = blocks.where((F.col("x0") >= F.col("width") * 0.79) & (F.col("y0") >= F.col("height") * 0.5) & (F.trim("text") != ""))
    held = side.groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct("y0", F.trim("text").alias("text")))), lambda x: x["text"]).alias("t"))
    first = F.array_position(F.transform("t", lambda s: F.char_length(F.regexp_replace(s, r"\s+", " ")) >= least), True)
    return held.select(page, F.array_join(F.slice("t", F.greatest(F.lit(1), first - 1).cast("int"), F.size("t")), "\n\n").alias("text"))


def horizontal_text(blocks: DataFrame, page: str = "page", editorial: bool = False, least: int = 120) -> DataFrame:
    """(page, text) of the horizontal blocks in reading order; editorial: only those of body length. blocks: page, x0, y0, dx, dy, text."""
    flat = blocks.where((F.abs(F.col("dx") - 1.0) <= 0.01) & (F.abs("dy") <= 0.01) & (F.trim("text") != ""))
    if editorial:
        flat = flat.where(F.char_length(F.trim(F.regexp_replace("text", r"\s+", " "))) >= least)
    return flat.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda x: F.rtrim(x["text"])), "\n\n").alias("text"))


def page_texts(blocks: DataFrame, layouts: DataFrame, page: str = "page") -> DataFrame:
    """(page, layout, text): each page read as its layout in layouts (page, layout) asks: route (columns and panels), map (the
    sidebar), editorial (horizontal blocks of body length), else plain (all horizontal blocks). Blocks: page, x0, y0, width,
    height, size, dx, dy, text. A page without text has an empty one."""
    known = layouts.select(F.col(page).alias("_page"), "layout")
    told = blocks.join(known, F.col(page) == F.col("_page"), "left").drop("_page").withColumn("layout", F.coalesce("layout", F.lit("plain")))
    readers = {"route": route_page_text, "map": map_sidebar, "editorial": lambda b, p: horizontal_text(b, p, editorial=True)}
    plain = told.where(~F.col("layout").isin(*readers))
    found = horizontal_text(plain, page).select(page, "text")
    for layout, read in readers.items():
        found = found.unionByName(read(told.where(F.col("layout") == layout), page).select(page, "text"))
    every = told.select(F.col(page).alias("_page"), "layout").distinct()
    return every.join(found, F.col(page) == F.col("_page"), "left").select(F.col("_page").alias(page), "layout", F.coalesce("text", F.lit("")).alias("text"))


def without_letter_spacing(glyphs: Column, bands: Sequence[tuple[str, float, float]], small_caps: Sequence[tuple[str, float]] = ()) -> Column:
    """The text of array<struct<char, font, size, width>> without spaces whose width over size lies in a font's half-open
    band, or that a small-caps font sets in a reduced size."""

    def spacing(g: Column) -> Column:
        out = F.lit(False)
        for font, lo, hi in bands:
            out = out | ((g["font"] == font) & (g["width"] / g["size"] >= lo) & (g["width"] / g["size"] < hi))
        for font, most in small_caps:
            out = out | ((g["font"] == font) & (g["size"] <= most))
        return (g["char"] == " ") & out

    return F.array_join(F.transform(F.filter(glyphs, lambda g: ~spacing(g)), lambda g: g["char"]), "")
