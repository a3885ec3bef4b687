"""Registered queries of pages, layouts, units and runs: inputs are made from whole driver tables, and SQL says what comes out."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import agent, chunks, dialogue, evaluation, html, records, router, similarity
from tessera.plans.catalog import _SCORES, _scores, CATEGORIES, PLACES, query
from tessera.sources import store

# A document's lines with their numbers, cleaned as the walk cleans them.
_LINES = r"""
l AS (SELECT doc_id, unnest(range(0, len(x))) AS i, trim(regexp_replace(replace(unnest(x), chr(160), ' '), '\s+', ' ', 'g')) AS t
      FROM (SELECT doc_id, string_split(nfc_normalize(text), chr(10)) AS x FROM documents))"""


def _widget(kind: str, *inner: Column | str) -> Column:
    parts = [F.lit(x) if isinstance(x, str) else x for x in inner]
    return F.concat(F.lit(f'<div data-widget_type="{kind}.default"><div class="elementor-widget-container">'), *parts, F.lit("</div></div>"))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _card(title: Column, text: Column) -> Column:
    return _widget("flip-box", '<div class="elementor-flip-box__front"><h3 class="elementor-flip-box__layer__title">', title, '</h3><div class="elementor-flip-box__layer__description">', text, "</div></div><p>back</p>")


def _page(documents: DataFrame, part) -> DataFrame:
    """(doc_id, html): the lines of a text as parts of one content container, between a header and a footer."""
    body = F.array_join(F.transform(F.split("text", "\n"), part), "")
    return documents.select("doc_id", F.concat(F.lit('<html><body><header>menu</header><div data-elementor-type="wp-page">'), body, F.lit("</div><footer>end</footer></body></html>")).alias("html"))


def _widgets(documents: DataFrame) -> DataFrame:
    def part(line: Column, i: Column) -> Column:
        t, n, k = _escaped(line), i.cast("string"), i % 6
        prose = _widget("text-editor", "<p>", t, "</p>")
        fold = lambda title, inner: F.concat(F.lit("<details><summary>"), title, F.lit("</summary>"), inner, F.lit("</details>"))
        folds = F.concat(F.lit('<div data-widget_type="nested-accordion.default">'), fold(F.concat(F.lit("• Fold "), n), prose), fold(F.concat(F.lit("Bare "), n), F.lit("")), F.lit("</div>"))
        return (
            F.when(k == 0, F.concat(_widget("heading", "<h2>Part ", n, " :</h2>"), prose)).when(k == 1, _widget("text-editor", "<ul><li>", t, "</li><li> </li><li>x</li></ul>"))
            .when(k == 2, F.concat(_widget("image", t), F.lit('<div class="elementor-hidden-desktop">'), prose, F.lit("</div>"))).when(k == 3, _card(F.concat(F.lit("Card "), n), t))
            .when(k == 4, folds).otherwise(_widget("odd", t))
        )

    return _page(documents, part)


@query("documents", sql=rf"""
WITH {_LINES},
b AS (
  SELECT doc_id, i * 4 AS p, 'heading' AS kind, 2 AS level, 'Part ' || i AS text FROM l WHERE i % 6 = 0 UNION ALL
  SELECT doc_id, i * 4 + 1, 'paragraph', 0, t FROM l WHERE i % 6 IN (0, 3, 4, 5) AND t <> '' UNION ALL
  SELECT doc_id, i * 4, 'list', 0, CASE WHEN t <> '' THEN '- ' || t || chr(10) ELSE '' END || '- x' FROM l WHERE i % 6 = 1 UNION ALL
  SELECT doc_id, i * 4, 'heading', 3, 'Card ' || i FROM l WHERE i % 6 = 3 UNION ALL
  SELECT doc_id, i * 4, 'heading', 3, 'Fold ' || i FROM l WHERE i % 6 = 4 AND t <> ''),
d AS (SELECT * FROM (SELECT *, lag(kind || ':' || text) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM b) WHERE before IS DISTINCT FROM kind || ':' || text),
n AS (SELECT * FROM (SELECT *, lead(kind) OVER (PARTITION BY doc_id ORDER BY p) AS next FROM d) WHERE NOT (level = 3 AND coalesce(next, 'heading') = 'heading')),
o AS (SELECT * FROM (SELECT *, lead(level) OVER (PARTITION BY doc_id ORDER BY p) AS after FROM n) WHERE NOT (level = 2 AND coalesce(after, 2) = 2))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS pos, kind, level, md5(text) AS text FROM o""")
def c1_x2_widgets(documents: DataFrame) -> DataFrame:
    """Every line of every text in one of six kinds of widgets."""
    blocks = _widgets(documents).select("doc_id", html.blocks_udf()(F.col("html")).alias("r")).select("doc_id", F.posexplode("r.blocks").alias("pos", "b"))
    return blocks.select("doc_id", F.col("pos").cast("long").alias("pos"), "b.kind", "b.level", F.md5(F.col("b.text").cast("binary")).alias("text"))


@query("documents", sql=rf"""
WITH {_LINES}
SELECT doc_id, count(*) FILTER (i % 6 = 2) AS images, count(*) FILTER (i % 6 = 3) AS cards, count(*) FILTER (i % 6 = 2) AS hidden, count(*) FILTER (i % 6 = 5 AND t <> '') AS warnings,
       'dropped: ' || array_to_string(list_filter([CASE WHEN count(*) FILTER (i % 6 = 3) > 0 THEN 'card backs=' || count(*) FILTER (i % 6 = 3) END, CASE WHEN count(*) FILTER (i % 6 = 2) > 0 THEN 'image=' || count(*) FILTER (i % 6 = 2) END], lambda x: x IS NOT NULL), ', ')
       || '; hidden: ' || count(*) FILTER (i % 6 = 2) || '; operational sentences: 0' AS notes FROM l GROUP BY doc_id""")
def x3_notes(documents: DataFrame) -> DataFrame:
    """What the walk leaves out, counted and as a line."""
    r = store.stored(_widgets(documents).select("doc_id", html.blocks_udf()(F.col("html")).alias("r")).where("r.blocks IS NOT NULL"))
    n = lambda k: F.coalesce(F.try_element_at("r.dropped", F.lit(k)), F.lit(0)).cast("long")
    return r.select("doc_id", n("image").alias("images"), n("card backs").alias("cards"), F.col("r.hidden").cast("long").alias("hidden"), F.size("r.warnings").cast("long").alias("warnings"), html.notes(F.col("r")).alias("notes"))


@query("documents", sql=rf"""
WITH {_LINES},
b AS (
  SELECT doc_id, i // 4 AS g, 0 AS p, 'heading' AS kind, 2 AS level, 'Part ' || i AS text FROM l WHERE i % 4 = 0 UNION ALL
  SELECT doc_id, i // 4, 1, 'list', 0, string_agg('- Card ' || i || CASE WHEN t <> '' THEN ' — ' || t ELSE '' END, chr(10) ORDER BY i) FROM l WHERE i % 4 IN (1, 2) GROUP BY doc_id, i // 4 UNION ALL
  SELECT doc_id, i // 4, 2, 'paragraph', 0, t FROM l WHERE i % 4 = 3 AND t <> ''),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM b WHERE g > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, p) - 1 AS pos, kind, level, md5(text) AS text FROM k WHERE n > 1""")
def c2_c3_cards(documents: DataFrame) -> DataFrame:
    """Cards as lists, and a section that is left out by name."""

    def part(line: Column, i: Column) -> Column:
        t, n = _escaped(line), i.cast("string")
        return F.when(i % 4 == 0, _widget("heading", "<h2>Part ", n, "</h2>")).when(i % 4 == 3, _widget("text-editor", "<p>", t, "</p>")).otherwise(_card(F.concat(F.lit("Card "), n), t))

    config = html.Config(cards_as_list=True, drop_sections=("Part 0",))
    blocks = _page(documents, part).select("doc_id", html.blocks_udf(config)(F.col("html")).alias("r")).select("doc_id", F.posexplode("r.blocks").alias("pos", "b"))
    return blocks.select("doc_id", F.col("pos").cast("long").alias("pos"), "b.kind", "b.level", F.md5(F.col("b.text").cast("binary")).alias("text"))


@query("documents", sql=rf"""
WITH {_LINES}, s AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY doc_id)
SELECT doc_id, 'Again' AS title, n FROM s WHERE n > 1""")
def c7_repeated_sections(documents: DataFrame) -> DataFrame:
    """A section that occurs once for each line; the warning names how often."""
    part = lambda line, i: F.concat(_widget("heading", "<h2>Again</h2>"), _widget("text-editor", "<p>same</p>"), _widget("text-editor", "<p>", i.cast("string"), "</p>"))
    r = _page(documents, part).select("doc_id", F.explode(html.blocks_udf()(F.col("html"))["warnings"]).alias("w"))
    told = r.select("doc_id", F.regexp_extract("w", r"^(.*): the same section (\d+) times", 1).alias("title"), F.regexp_extract("w", r"the same section (\d+) times", 1).cast("long").alias("n"))
    return told.where(F.col("n").isNotNull())


@query("documents", sql=r"""
SELECT doc_id, 'gone ' || doc_id AS text FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0""")
def c8_hidden_missing(documents: DataFrame) -> DataFrame:
    """Of the hidden blocks the first words of a text are in it, and every third text lacks the other."""
    i = F.col("doc_id").cast("string")
    flat = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    rows = documents.where("text IS NOT NULL").select("doc_id", F.array(F.substring(flat, 1, 30), F.concat(F.lit("gone "), i)).alias("hidden"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("\ngone\t"), i)).alias("markdown"))
    return html.hidden_missing(rows, "doc_id", "hidden", "markdown")


@query("documents", sql=rf"""
WITH {_LINES}, n AS (SELECT doc_id, i, lower(t) AS t FROM l),
x AS (
  SELECT doc_id, i * 4 AS p, i % 90 + 1 || '. SALA' AS x FROM n WHERE i % 5 = 0 UNION ALL SELECT doc_id, i * 4 + 1, 'Coordenadas : 1.5, -' || i FROM n WHERE i % 5 = 0 UNION ALL
  SELECT doc_id, i * 4, '• x' || t FROM n WHERE i % 5 = 1 UNION ALL SELECT doc_id, i * 4, 'ÁTRIO' FROM n WHERE i % 5 = 2 UNION ALL SELECT doc_id, i * 4, '9 Coimbra, Património Mundial' FROM n WHERE i % 5 = 4 UNION ALL
  SELECT doc_id, i * 4 + 2, t FROM n WHERE i % 5 <> 1),
k AS (SELECT *, CASE WHEN x = '' OR x = '9 Coimbra, Património Mundial' THEN 'blank' WHEN regexp_matches(x, '^\d+\. SALA$') THEN 'route' WHEN x LIKE 'Coordenadas : %' THEN 'place' WHEN x = 'ÁTRIO' THEN 'heading' WHEN regexp_matches(x, '^(?:[-•]|\d+[.)])\s+') THEN 'item' ELSE 'text' END AS kind FROM x),
s AS (SELECT *, sum(CASE WHEN kind = 'text' AND before = 'text' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM k)),
m AS (SELECT doc_id, island, any_value(kind) AS kind, list(x ORDER BY p) AS l FROM s WHERE kind <> 'blank' GROUP BY doc_id, island),
b AS (SELECT doc_id, island, kind, CASE kind WHEN 'route' THEN '## ' || l[1] WHEN 'place' THEN '**Coordenadas:** ' || l[1][15:] WHEN 'heading' THEN '### ' || l[1] WHEN 'item' THEN l[1] ELSE list_reduce(l, lambda d, y: CASE
        WHEN NOT (ends_with(d, '-') AND regexp_matches(y, '^\p{{Ll}}')) THEN d || ' ' || y WHEN regexp_matches(d, '(?i)[aeiouáéíóúâêôãõrmz]-$') AND regexp_matches(y, '^se([^\p{{L}}\p{{N}}_]|$)') THEN d || y ELSE d[:-2] || y END) END AS x FROM m)
SELECT doc_id, md5(string_agg(x, chr(10) || chr(10) ORDER BY island)) AS body, count(*) FILTER (kind IN ('route', 'heading')) AS headings FROM b GROUP BY doc_id""")
def t10_page_body(documents: DataFrame) -> DataFrame:
    """The lines of whole texts in lower case, among numbered and general headings, positions, items and running headers."""

    def part(line: Column, i: Column) -> Column:
        n = i.cast("string")
        t = F.lower(F.trim(F.regexp_replace(F.replace(line, F.lit(" "), F.lit(" ")), r"(?U)\s+", " ")))
        k = i % 5
        return (
            F.when(k == 0, F.array(F.concat((i % 90 + 1).cast("string"), F.lit(". SALA")), F.concat(F.lit("Coordenadas : 1.5, -"), n), t)).when(k == 1, F.array(F.concat(F.lit("• x"), t)))
            .when(k == 2, F.array(F.lit("ÁTRIO"), t)).when(k == 4, F.array(F.lit("9 Coimbra, Património Mundial"), t)).otherwise(F.array(t))
        )

    from tessera.functions.text import nfc

    lines = documents.select("doc_id", nfc(F.col("text")).alias("text")).select("doc_id", F.posexplode(F.flatten(F.transform(F.split("text", "\n"), part))).alias("pos", "line"))
    return records.page_body(lines, "doc_id", "pos", "line").withColumn("body", F.md5(F.col("body").cast("binary")))


_BLOCKS = "(SELECT p_partkey % 60 AS page, p_partkey, (p_partkey * 37 % 1000)::DOUBLE AS x0, (p_partkey * 13 % 500)::DOUBLE AS y0, 1000.0::DOUBLE AS width, 500.0::DOUBLE AS height, CASE WHEN p_partkey % 11 = 0 THEN 18.0 ELSE 9.0 END::DOUBLE AS size, CASE WHEN p_partkey % 7 = 3 THEN 'a. b. c.' WHEN p_partkey % 5 = 2 THEN p_name || '.' ELSE p_name END AS text, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS dx, CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS dy FROM part)"
_COLUMN = "CAST(least(2, greatest(0, trunc((x0 - 250) / 240))) AS INTEGER)"
_TOPS = f"""b AS (SELECT *, {_COLUMN} AS col FROM {_BLOCKS}), marks AS (SELECT page, col, y0 AS mark FROM b WHERE text = 'a. b. c.'), titles AS (SELECT page, col, y0 AS title FROM b WHERE size >= 14),
near AS (SELECT m.page, m.col, mark, max(CASE WHEN title <= mark THEN title END) AS t FROM marks m LEFT JOIN titles t ON m.page = t.page AND m.col = t.col GROUP BY 1, 2, 3),
tops AS (SELECT page, col, min(coalesce(t, mark)) AS top FROM near GROUP BY 1, 2)"""


def _blocks(part: DataFrame) -> DataFrame:
    """Layout blocks on sixty pages, placed by the key."""
    k = F.col("p_partkey")
    text = F.when(k % 7 == 3, "a. b. c.").when(k % 5 == 2, F.concat("p_name", F.lit("."))).otherwise(F.col("p_name"))
    turned = k % 3 == 0
    return part.select(
        (k % 60).alias("page"), (k * 37 % 1000).cast("double").alias("x0"), (k * 13 % 500).cast("double").alias("y0"), F.lit(1000.0).alias("width"), F.lit(500.0).alias("height"), F.when(k % 11 == 0, 18.0).otherwise(9.0).alias("size"), text.alias("text"),
        F.when(turned, 0.0).otherwise(1.0).alias("dx"), F.when(turned, 1.0).otherwise(0.0).alias("dy"),
    )


@query("part", sql=f'WITH {_TOPS} SELECT page, col AS "column", top FROM tops')
def c10_panel_tops(part: DataFrame) -> DataFrame:
    return records.panel_tops(_blocks(part)).withColumn("column", F.col("column").cast("int"))


@query("part", sql=rf"""
WITH {_TOPS},
body AS (SELECT b.*, top FROM b LEFT JOIN tops ON b.page = tops.page AND b.col = tops.col WHERE x0 >= 250 AND y0 >= 60 AND y0 <= 480 AND trim(text) <> '' AND (top IS NULL OR y0 < top)),
o AS (SELECT *, top IS NOT NULL AND lead(col) OVER w = col + 1 AND NOT regexp_matches(trim(text), '[.!?:;”»"'')]$') AS open FROM body WINDOW w AS (PARTITION BY page ORDER BY col, y0)),
g AS (SELECT *, CASE WHEN coalesce(lag(open) OVER (PARTITION BY page ORDER BY col, y0), false) THEN chr(10) ELSE chr(10) || chr(10) END AS glue FROM o)
SELECT page, md5(regexp_replace(string_agg(glue || trim(text), '' ORDER BY col, y0), '^\n+', '')) AS text FROM g GROUP BY page""")
def c9_c11_route_text(part: DataFrame) -> DataFrame:
    return records.route_page_text(_blocks(part)).withColumn("text", F.md5(F.col("text").cast("binary")))


@query("part", sql=rf"""
WITH b AS (SELECT * FROM {_BLOCKS})
SELECT page, md5(string_agg(rtrim(text), chr(10) || chr(10) ORDER BY y0, x0)) AS text FROM b WHERE dx = 1 AND trim(text) <> '' GROUP BY page""")
def c12_horizontal(part: DataFrame) -> DataFrame:
    return records.horizontal_text(_blocks(part)).withColumn("text", F.md5(F.col("text").cast("binary")))


@query("part", sql=rf"""
WITH b AS (SELECT page, list(trim(text) ORDER BY y0, trim(text)) AS t FROM {_BLOCKS} WHERE x0 >= 790 AND y0 >= 250 AND trim(text) <> '' GROUP BY page),
f AS (SELECT page, t, coalesce(list_position(list_transform(t, lambda s: length(s) >= 20), true), 0) AS first FROM b)
SELECT page, md5(array_to_string(t[greatest(1, first - 1):], chr(10) || chr(10))) AS text FROM f""")
def c12_map_sidebar(part: DataFrame) -> DataFrame:
    return records.map_sidebar(_blocks(part), least=20).withColumn("text", F.md5(F.col("text").cast("binary")))


@query("part", sql=r"""
WITH g AS (SELECT p_partkey, p_name, range(1, length(p_name) + 1) AS places FROM part)
SELECT p_partkey, array_to_string(list_transform(list_filter(places, lambda i: NOT (p_name[i] = ' ' AND CASE i % 4 WHEN 0 THEN p_partkey % 2 = 0 WHEN 1 THEN true ELSE false END)), lambda i: p_name[i]), '') AS text FROM g""")
def c13_letter_spacing(part: DataFrame) -> DataFrame:
    """Every fourth glyph is of a font with a band, which holds its width on even keys; the next is of a small-caps font."""
    i = lambda n: (n + 1) % 4
    font = lambda n: F.when(i(n) == 0, "banded").when(i(n) == 1, "small").otherwise("plain")
    width = F.when(F.col("p_partkey") % 2 == 0, 2.0).otherwise(4.0)
    glyphs = F.transform(F.split("p_name", ""), lambda c, n: F.struct(c.alias("char"), font(n).alias("font"), F.when(i(n) == 1, 5.0).otherwise(10.0).alias("size"), width.alias("width")))
    return part.select("p_partkey", records.without_letter_spacing(glyphs, [("banded", 0.1, 0.3)], [("small", 6.0)]).alias("text"))


@query("documents", sql=r"""
WITH l AS (SELECT doc_id, unnest(range(0, len(x))) AS i, unnest(x) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
t AS (SELECT doc_id, i, 'z' || regexp_replace(raw, '\s+$', '') AS t FROM l),
u AS (SELECT doc_id, i // 4 AS g, string_agg(t || CASE WHEN i % 2 = 0 THEN '' ELSE chr(10) || 'end.' END, chr(10) || chr(10) ORDER BY i) AS body, count(*) AS n, min(i) AS lo, max(i) AS hi FROM t GROUP BY doc_id, i // 4)
SELECT CAST(doc_id AS VARCHAR) AS document_id, g AS unit, CASE g % 3 WHEN 0 THEN 'S' || g WHEN 1 THEN 'S' || (g - 1) || ' > T' || g ELSE '' END AS path, CASE WHEN g % 3 = 2 THEN 'caption_panel' ELSE 'content' END AS role, n AS blocks, md5(body) AS body,
       CASE WHEN lo // 8 * 8 = 0 AND lo < 8 THEN NULL ELSE lo // 8 END AS first_page, CASE WHEN hi < 8 THEN NULL ELSE hi // 8 END AS last_page FROM u""")
def c16_units(documents: DataFrame) -> DataFrame:
    """Whole texts as Markdown: four lines a unit, which is a section, a subsection of it, or a caption panel in turn; a page
    marker before every eighth line but the first, and a page number alone after it."""

    def part(line: Column, i: Column) -> Column:
        g = F.floor(i / 4).cast("int")
        head = F.when(g % 3 == 0, F.concat(F.lit("## S"), g.cast("string"))).when(g % 3 == 1, F.concat(F.lit("### T"), g.cast("string"))).otherwise(chunks.CAPTIONS)
        page = F.when((i % 8 == 0) & (i > 0), F.concat(F.lit("<!-- source_page: "), F.floor(i / 8).cast("string"), F.lit(" -->\n\n12\n\n"))).otherwise("")
        # a full stop keeps a page from being one of labels
        return F.concat(page, F.when(i % 4 == 0, F.concat(head, F.lit("\n\n"))).otherwise(""), F.lit("z"), line, F.when(i % 2 == 1, "\nend.").otherwise(""))

    body = F.array_join(F.transform(F.split("text", "\n"), part), "\n\n")
    # pages whose lines are few could all be labels: a closing line on each prevents it
    rows = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("document_id"), body.alias("markdown"))
    u = chunks.units(rows)
    pages = F.transform("blocks", lambda b: b["page"])
    return u.select(
        "document_id", F.dense_rank().over(chunks.Window.partitionBy("document_id").orderBy("unit")).cast("long").alias("unit"), F.array_join(F.transform("path", lambda h: h["text"]), " > ").alias("path"), "role", F.size("blocks").cast("long").alias("blocks"),
        F.md5(F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n").cast("binary")).alias("body"), F.get(pages, F.lit(0)).cast("long").alias("first_page"), F.element_at(pages, -1).cast("long").alias("last_page"),
    ).withColumn("unit", F.col("unit") - 1)


@query("documents", sql="""
SELECT 'document_id' AS field, 'd' || doc_id AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'primary_category', coalesce(lang, 'None'), count(*) FROM documents GROUP BY 2 UNION ALL
SELECT 'unit_role', 'r' || doc_id % 3, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'source_type', CASE WHEN doc_id % 2 = 0 THEN 'pdf' ELSE 'web_page' END, count(*) FROM documents GROUP BY 2 UNION ALL
SELECT 'conflict_notes', 'with', count(*) FROM documents WHERE doc_id % 5 = 0""")
def a3_counts_by_field(documents: DataFrame) -> DataFrame:
    return records.corpus_counts(_chunk_table(documents))


def _chunk_table(documents: DataFrame) -> DataFrame:
    """One chunk a document, of its whole text."""
    i = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        F.concat(F.lit("c"), i.cast("string")).alias("chunk_id"), F.concat(F.lit("d"), i.cast("string")).alias("document_id"), F.col("lang").alias("primary_category"), F.concat(F.lit("r"), (i % 3).cast("string")).alias("unit_role"),
        F.when(i % 2 == 0, "pdf").otherwise("web_page").alias("source_type"), F.when(i % 5 == 0, "note").when(i % 5 == 1, "").alias("conflict_notes"), F.char_length(text).alias("body_chars"), F.concat(F.lit("# T\n\n"), text).alias("text"),
        (1 + i % 2).alias("unit_chunk_count"), (i % 4).alias("overlap_chars"), F.when(i % 2 == 0, F.array(F.lit(1), (i % 3 + 1).cast("int"))).alias("source_pages"), F.when(i % 7 > 0, "s").alias("section"), F.when(i % 7 > 3, "u").alias("subsection"),
    )


@query("documents", sql="""
SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, count(DISTINCT CASE WHEN doc_id % 2 = 0 THEN doc_id END) AS documents_pdf, count(DISTINCT CASE WHEN doc_id % 2 = 1 THEN doc_id END) AS documents_web,
       count(*) FILTER (doc_id % 2 = 0) AS chunks_pdf, count(*) FILTER (doc_id % 2 = 1) AS chunks_web, count(*) FILTER (n < 100) AS body_under_100, count(*) FILTER (n > 1000) AS body_over_size, count(*) FILTER (n + 5 > 1000) AS rendered_over_size,
       count(*) FILTER (doc_id % 2 = 1) AS split_units_chunks, count(*) FILTER (doc_id % 4 > 0) AS chunks_with_overlap, count(*) FILTER (doc_id % 2 = 0) AS multi_page_chunks, count(*) FILTER (doc_id % 7 = 0) AS without_section, count(*) FILTER (doc_id % 7 > 3) AS with_subsection
FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents)""")
def a3_statistics_of_chunks(documents: DataFrame) -> DataFrame:
    return records.corpus_statistics(_chunk_table(documents))


@query("documents", sql="SELECT 'c' || doc_id AS chunk_id, n AS body_chars, CASE WHEN n < 100 THEN 'small' ELSE 'large' END AS kind FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents) WHERE n < 100 OR n > 1000")
def a3_small_and_large(documents: DataFrame) -> DataFrame:
    return records.small_and_large(_chunk_table(documents)).withColumn("body_chars", F.col("body_chars").cast("long"))


@query("benchmark", "documents", sql="SELECT b.item_id, b.text, d.source AS answer FROM benchmark b JOIN documents d ON b.item_id = d.doc_id")
def j1_joined_alike(benchmark: DataFrame, documents: DataFrame) -> DataFrame:
    """Items with raw results of the same question, for the items that documents have an id for."""
    known = benchmark.join(documents.select(F.col("doc_id").alias("item_id")), "item_id", "left_semi")
    raw = known.join(documents.select(F.col("doc_id").alias("item_id"), F.col("source").alias("answer")), "item_id").select("item_id", "text", "answer")
    return evaluation.joined_alike(known, raw, "item_id", "text")


@query("documents", sql=f"""
WITH s AS (SELECT category, list_filter([CASE WHEN a = 0 THEN 'rag' END, CASE WHEN a <> 1 THEN 'weather' END], lambda x: x IS NOT NULL) AS e, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE list_filter([CASE WHEN b = 0 THEN 'rag' END, CASE WHEN b <> 1 THEN 'weather' END], lambda x: x IS NOT NULL) END AS p FROM {_SCORES})
SELECT category, count(*) FILTER (e = p) AS matches, count(*) AS total FROM s GROUP BY ROLLUP (category)""")
def a19_planner_check(documents: DataFrame) -> DataFrame:
    label = lambda c: evaluation.capability_label(F.col(c) == 0, F.col(c) != 1, F.lit(False))
    rows = _scores(documents).select("category", label("a").alias("expected"), F.when(F.col("doc_id") % 11 != 0, label("b")).alias("predicted"))
    return evaluation.planner_check(rows)


@query("labels", "documents")
def x10_classifier_run(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """Both experiments on the labelled texts; the row of the selected one is marked."""
    rows = labels.join(documents.select("doc_id", "text"), "doc_id").select("doc_id", "text", "quality")
    chosen, _, told, _ = router.train_router(rows, "text", "quality", "doc_id")
    return told.withColumn("selected", F.col("experiment") == chosen)


_PLAN = {
    0: {"use_rag": True, "rag_query": None, "tool_calls": []},
    1: {"use_rag": True, "rag_query": "need", "tool_calls": [{"server": "weather", "tool": "get_current_weather", "arguments": {"location": "C"}}]},
    2: {"use_rag": False, "rag_query": None, "tool_calls": [{"server": "places", "tool": "search_place", "arguments": {"query": "down"}}]},
}


def _planner(question: str) -> str:
    n = int(question.split()[1]) % 4
    return json.dumps(_PLAN[n]) if n in _PLAN else "no plan"


def _tool(server: str, name: str, arguments: str) -> str:
    if "down" in arguments:
        raise ValueError("503")
    return f"{server} ok"


def _retrieve(asked: DataFrame) -> DataFrame:
    return asked.select("id", F.concat(F.lit("about "), "query").alias("context"), F.lit(None).cast("string").alias("conflict_note"), F.concat(F.lit("- "), "query").alias("sources"))


@query("benchmark", sql=rf"""
SELECT item_id AS id, CASE item_id % 4 WHEN 2 THEN 'places' WHEN 3 THEN 'planner' END AS stage,
       CASE item_id % 4 WHEN 0 THEN length('CONTEXTO:' || 'about q ' || item_id || 'q ' || item_id) || chr(10) || chr(10) || '{agent.SOURCES_TITLE}' || chr(10) || '- q ' || item_id
                        WHEN 1 THEN 'w' || chr(10) || chr(10) || '{agent.SOURCES_TITLE}' || chr(10) || '- need' || chr(10) || chr(10) || '{agent.WEATHER_SOURCE}' END AS answer,
       CASE WHEN item_id % 2 = 0 THEN 'about i ' || item_id END AS oracle FROM benchmark""")
def r16_r23_agent_run(benchmark: DataFrame) -> DataFrame:
    """A question for each item: retrieval alone, with a tool, a tool that fails, and a planner that gives no plan."""
    i = F.col("item_id").cast("string")
    items = benchmark.select(F.col("item_id").alias("id"), F.concat(F.lit("q "), i).alias("question"), (F.col("item_id") % 2 == 0).alias("rag_required"), F.concat(F.lit("i "), i).alias("information_need"))
    say = lambda prompt: "w" if "weather ok" in prompt else str(len(prompt))
    out = agent.run_questions(items, _planner, _tool, _retrieve, say, F.lit("today"), lambda q, c, n: F.concat(F.lit("CONTEXTO:"), c, q))
    return out.select("id", "error.stage", "answer", F.col("oracle.context").alias("oracle"))


def _judge(message: str) -> str:
    said = message.split("A=")[1]
    if said.startswith("bad"):
        return "{}"
    return json.dumps({d: {"score": len(said) % 3, "reason": "r"} for d in evaluation.DIMENSIONS})


@query("benchmark", sql="""
SELECT item_id AS id, CASE WHEN item_id % 3 = 0 THEN 0 WHEN item_id % 3 = 1 THEN 2 ELSE 1 END AS attempts, item_id % 3 = 0 AS automatic, CASE item_id % 3 WHEN 0 THEN 0 WHEN 2 THEN length('s ' || item_id) % 3 END AS score FROM benchmark""")
def r24_judged(benchmark: DataFrame) -> DataFrame:
    """Answers that are missing, that the judge never scores, and that it does."""
    i = F.col("item_id")
    answer = F.when(i % 3 == 0, " ").when(i % 3 == 1, "bad").otherwise(F.concat(F.lit("s "), i.cast("string")))
    out = agent.judged(benchmark.select(i.alias("id"), F.col("text").alias("question"), answer.alias("final_answer")), _judge, "Q={question} G={gold} E={evidence} A={final_answer}")
    return out.select("id", "attempts", "automatic", F.col("judgement.relevance.score").alias("score"))


def _echo(text: str) -> str:
    return f"{text}. Queres saber mais sobre {'of' if 'of' in text else 'the'}?"


_OFFER = "Queres saber mais sobre"
_FALLBACK = dialogue.Guide(PLACES, CATEGORIES, _echo).fallback


@query("conversations", sql=rf"""
WITH RECURSIVE s AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, said) AS k, said FROM (
    SELECT conv_id, turn, CASE turn % 7 WHEN 1 THEN 'sim' WHEN 3 THEN 'outro' WHEN 4 THEN 'that' WHEN 5 THEN 'of' WHEN 6 THEN 'não' ELSE trim(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g')) END AS said FROM conversations)),
f(conv_id, k, turn, reply, place, category, pending) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM s
  UNION ALL
  SELECT conv_id, k, turn,
    CASE intent WHEN 'confirm' THEN CASE WHEN place IS NULL THEN '{_FALLBACK}' ELSE 'about ' || place || '. {_OFFER} ' || CASE WHEN contains(place, 'of') THEN 'of' ELSE 'the' END || '?' END
      WHEN 'decline' THEN '{_FALLBACK}' WHEN 'another' THEN CASE len(rest) WHEN 0 THEN '{_FALLBACK}' WHEN 1 THEN rest[1] || '. {_OFFER} ' || rest[1] || '?' ELSE array_to_string(rest[:-2], ', ') || ' / ' || rest[-1] END
      ELSE q || '. {_OFFER} ' || CASE WHEN contains(q, 'of') THEN 'of' ELSE 'the' END || '?' END,
    CASE WHEN intent IN ('confirm', 'decline') THEN place WHEN intent = 'another' THEN CASE WHEN len(rest) = 1 THEN rest[1] ELSE place END WHEN contains(q, 'of') THEN 'of' ELSE 'the' END,
    CASE WHEN intent IN ('confirm', 'decline') THEN category WHEN intent = 'another' THEN cat WHEN contains(q, 'of') THEN 'prepositions' ELSE 'articles' END,
    CASE WHEN intent IN ('confirm', 'decline') THEN NULL WHEN intent = 'another' THEN CASE WHEN len(rest) = 1 THEN 'about' END ELSE 'about' END
  FROM (SELECT *, list_filter(CASE cat WHEN 'articles' THEN ['the'] WHEN 'prepositions' THEN ['of', 'in'] ELSE [] END, lambda x: place IS NULL OR x <> place) AS rest,
               CASE WHEN intent = 'reference' THEN CASE WHEN regexp_matches(said, '(?i)\b(?:onde|fica|where)\b') THEN 'where ' ELSE 'about ' END || place ELSE said END AS q
        FROM (SELECT *, CASE WHEN pending IS NOT NULL AND regexp_matches(said, '(?i)^\s*(?:sim|claro|ok|yes|quero)\s*[.!?]*\s*$') THEN 'confirm'
                             WHEN pending IS NOT NULL AND regexp_matches(said, '(?i)^\s*(?:não|nao|no)\s*[.!?]*\s*$') THEN 'decline'
                             WHEN regexp_matches(said, '(?i)\b(?:outr[oa]s?|mais|another|other)\b') AND cat IS NOT NULL THEN 'another'
                             WHEN regexp_matches(said, '(?i)^\s*(?:the|of|in)\s*$') THEN 'category'
                             WHEN place IS NOT NULL AND regexp_matches(said, '(?i)\b(?:ele|ela|isso|esse|essa|it|that|there)\b') THEN 'reference' ELSE 'plain' END AS intent
              FROM (SELECT f.conv_id, s.k, s.turn, s.said, f.place, f.category, f.pending,
                           coalesce(CASE WHEN regexp_matches(s.said, '(?i)\bthe\b') THEN 'articles' WHEN regexp_matches(s.said, '(?i)\b(?:of|in)\b') THEN 'prepositions' END, f.category) AS cat
                    FROM f JOIN s ON s.conv_id = f.conv_id AND s.k = f.k + 1))))
SELECT conv_id, turn, reply, place, category, pending FROM f WHERE k > 0""")
def r9_guide(conversations: DataFrame) -> DataFrame:
    """Whole turns, among answers to what is pending, requests for another place, references and bare categories."""
    k = F.col("turn") % 7
    said = F.when(k == 1, "sim").when(k == 3, "outro").when(k == 4, "that").when(k == 5, "of").when(k == 6, "não").otherwise(F.trim(F.regexp_replace("text", r"[^\x00-\x7F]", "x")))
    return dialogue.converse(conversations.select("conv_id", "turn", said.alias("text")), dialogue.Guide(PLACES, CATEGORIES, _echo))


_NONE_GRAMS = r"""
g AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM g WHERE len(w) >= 5)"""


@query("documents", sql=rf"""
WITH RECURSIVE {_NONE_GRAMS},
o AS MATERIALIZED (SELECT doc_id, len(g) AS n, row_number() OVER (ORDER BY len(g) DESC, doc_id) AS r FROM s),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
h AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS (SELECT x.r AS a, list(y.r ORDER BY y.r) AS bs FROM h JOIN o x ON h.a = x.doc_id JOIN o y ON h.b = y.doc_id WHERE y.r < x.r AND k >= 0.8 * x.n - 1e-9 GROUP BY x.r),
q AS MATERIALIZED (SELECT a, bs, row_number() OVER (ORDER BY a) AS i FROM p),
f(i, a, owner, gone) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL SELECT q.i, q.a, list_filter(q.bs, lambda b: NOT list_contains(f.gone, b))[1], CASE WHEN len(list_filter(q.bs, lambda b: NOT list_contains(f.gone, b))) > 0 THEN list_append(f.gone, q.a) ELSE f.gone END
  FROM f JOIN q ON q.i = f.i + 1)
SELECT d.doc_id AS key, y.doc_id AS duplicate_of FROM documents d LEFT JOIN o x ON d.doc_id = x.doc_id LEFT JOIN f ON f.a = x.r AND f.i > 0 LEFT JOIN o y ON y.r = f.owner""")
def j8_greedy_verdicts(documents: DataFrame) -> DataFrame:
    return similarity.greedy_dedup(documents, "doc_id", "text")
