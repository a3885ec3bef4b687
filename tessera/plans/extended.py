"""Registered queries of positions, shapes, service calls, the vector index and reports, beside their SQL."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import web
from tessera.operators import agent, calls, chunks, dialogue, evaluation, html, ordered, reports, retrieval, shapes, similarity, vector_index
from tessera.plans import catalog
from tessera.plans.catalog import query
from tessera.plans.structure import _LINES, _escaped, _page, _widget
from tessera.sources import files, store

# --- order --------------------------------------------------------------------------------------------------------------


@query("labels", "documents", sql="""
WITH a AS (SELECT doc_id AS a_id, quality, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM labels),
d AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS position FROM documents SEMI JOIN labels USING (doc_id))
SELECT position, a_id, quality, doc_id, n_chars FROM a JOIN d USING (position)""")
def j2_positional_join(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """The i-th label by id beside the i-th labelled document by length."""
    left = labels.select(F.col("doc_id").alias("a_id"), "quality")
    right = documents.join(labels, "doc_id", "left_semi").select("doc_id", "n_chars")
    return ordered.positional_join(left, right, ["a_id"], ["n_chars", "doc_id"])


@query("documents", sql="SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars NULLS FIRST, doc_id) - 1 AS position, count(*) OVER (PARTITION BY source) AS n FROM documents")
def w1_group_positions(documents: DataFrame) -> DataFrame:
    return ordered.positions(documents.select("doc_id", "source", "n_chars"), ["n_chars", "doc_id"], ["source"], count="n").drop("n_chars")


_HEADING = r"<h([1-6])[^>]*>(.*?)</h[1-6]>"


@query("pages", sql=rf"""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '{_HEADING}', 2)) AS heading, generate_subscripts(regexp_extract_all(html, '{_HEADING}', 2), 1) AS pos FROM pages)
SELECT page_id, heading, CAST(pos AS INTEGER) AS rank FROM h WHERE pos <= 12""")
def w3_first_headings(pages: DataFrame) -> DataFrame:
    """The first 12 headings of each page."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_HEADING), 2)).alias("at", "heading"))
    return ordered.first_n(rows, ["page_id"], ["at"], 12).drop("at")


@query("pages", sql=r"""
WITH p AS (SELECT page_id, length(html) AS size, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS site FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY size DESC, url, page_id) AS rank FROM p)
SELECT page_id, site, size, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2""")
def w2_w3_largest_of_site(pages: DataFrame) -> DataFrame:
    """Each site's two largest pages, by falling size and then address."""
    rows = pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("site"), F.char_length("html").cast("long").alias("size"), "url")
    return ordered.first_n(rows, ["site"], [F.desc("size"), "url", "page_id"], 2).drop("url")


@query("pages", sql=r"""
WITH p AS (SELECT page_id, coalesce(nullif(replace(trim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/'), '/', '__'), ''), 'home') AS slug, length(html) AS chars FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY page_id) AS k FROM p)
SELECT page_id, slug || CASE WHEN k > 1 THEN '#' || k ELSE '' END || '.md' AS file, '<!-- page: ' || page_id || ' | chars: ' || chars || ' -->' AS header FROM n""")
def x6_sample_names(pages: DataFrame) -> DataFrame:
    """A file name from each page's path, no two alike, and the header of the sample."""
    slug = F.coalesce(F.nullif(F.replace(F.trim(web.path(F.col("url")), F.lit("/")), F.lit("/"), F.lit("__")), F.lit("")), F.lit("home"))
    named = ordered.unique_names(pages.select("page_id", slug.alias("slug"), F.char_length("html").alias("chars")), "slug", ["page_id"])
    header = F.format_string("<!-- page: %d | chars: %d -->", "page_id", "chars")
    return named.select("page_id", F.concat("unique_name", F.lit(".md")).alias("file"), header.alias("header"))


# --- splitting ----------------------------------------------------------------------------------------------------------


@query("conversations", sql=r"""
WITH t AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(0 AS INTEGER) AS start, body AS piece FROM t WHERE length(body) <= 1000""")
def c17_whole_conversations(conversations: DataFrame) -> DataFrame:
    """The pieces of conversations that are one piece, which are those of up to 1,000 characters."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n\n")
    told = conversations.groupBy("conv_id").agg(body.alias("body"))
    pieces = told.select("conv_id", F.char_length("body").alias("size"), F.posexplode(chunks.pieces_udf()(F.col("body"))).alias("no", "p"))
    return pieces.where("size <= 1000").select("conv_id", "p.start", "p.piece")


# --- vectors ------------------------------------------------------------------------------------------------------------


def _index(embeddings: DataFrame) -> vector_index.Index:
    return vector_index.build_index(embeddings, "vec_id", "embedding", store.scratch(embeddings.sparkSession))


@query("embeddings", sql=catalog.SQL["r2_j10_topk_cosine"])
def r2_index_all_lists(embeddings: DataFrame) -> DataFrame:
    """The index with every list probed, which is exact. Ids divisible by 100 ask."""
    found = vector_index.search(embeddings.sparkSession, index := _index(embeddings), embeddings.where("vec_id % 100 = 0"), "vec_id", "embedding", probes=index.lists)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "key", F.abs(F.round("cosine_distance", 6)).alias("cosine_distance"))


@query("embeddings")
def r2_index_topk(embeddings: DataFrame) -> DataFrame:
    """The index with as many lists as its recall needs. Ids divisible by 100 ask."""
    return vector_index.search(embeddings.sparkSession, _index(embeddings), embeddings.where("vec_id % 100 = 0"), "vec_id", "embedding")


@query("embeddings", sql="SELECT count(*) AS asked, true AS enough, true AS fraction FROM embeddings WHERE vec_id % 100 = 0")
def r2_index_recall(embeddings: DataFrame) -> DataFrame:
    """Whether nine of ten exact neighbours are found, in fewer lists than there are."""
    asked = embeddings.where("vec_id % 100 = 0")
    found = vector_index.search(embeddings.sparkSession, index := _index(embeddings), asked, "vec_id", "embedding").select("query_id", "key", F.lit(1).alias("hit"))
    exact = retrieval.top_k(asked, "vec_id", "embedding", embeddings, "vec_id", "embedding")
    both = exact.join(found, ["query_id", "key"], "left")
    return both.agg(F.countDistinct("query_id").alias("asked"), (F.count("hit") >= F.lit(0.9) * F.count(F.lit(1))).alias("enough"), F.lit(index.probes < index.lists).alias("fraction"))


# --- records ------------------------------------------------------------------------------------------------------------

_RECORD = """CASE event_id % 11
  WHEN 1 THEN '{"id": ' || event_id || ', "user": {"id": ' || user_id || '}, "props": ' || props || '}'
  WHEN 2 THEN '{"id": "' || event_id || '", "user": {"id": ' || user_id || ', "tags": ["' || event_type || '"]}, "value": 1, "props": ' || props || '}'
  WHEN 3 THEN '{"id": ' || event_id || ', "user": {"tags": ["a", 4, null]}, "value": null, "props": ' || props || ', "more": {"x": 1}}'
  WHEN 4 THEN '{"id": ' || event_id || ', "user": [' || user_id || '], "value": "much", "props": {}}'
  WHEN 5 THEN '{"id": ' || event_id || ', "user'
  WHEN 6 THEN '[' || event_id || ']'
  ELSE '{"id": ' || event_id || ', "user": {"id": ' || user_id || ', "tags": ["' || event_type || '", "t"]}, "value": 2.5, "props": ' || props || '}' END"""
_SHAPE = {"$": "object", "$.id": "int", "$.user": "object", "$.user.id": "int", "$.user.tags": "array?", "$.user.tags[]": "string", "$.value": "number|null?", "$.props": "object", "$.props.k": "int"}
_KINDS = "CASE json_type({0}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'number' ELSE 'int' END"


def _sql_member(parent: str, path: str, value: str, types: str, required: bool) -> str:
    """Of a value at path, of objects that `parent` holds for: missing, or of a wrong type."""
    allowed = [*types.split("|"), *(["int"] if "number" in types else [])]
    told = f"SELECT event_id, '{path}' AS path, {_KINDS.format(value)} || ', not {types}' AS problem FROM r WHERE {parent} AND json_type({value}) IS NOT NULL AND {_KINDS.format(value)} NOT IN ({', '.join(repr(a) for a in allowed)})"
    return told + (f" UNION ALL SELECT event_id, '{path}', 'missing' FROM r WHERE {parent} AND json_type({value}) IS NULL" if required else "")


def _sql_added(parent: str, path: str, value: str, known: list[str]) -> str:
    return f"SELECT event_id, '{path}.' || k, 'added' FROM (SELECT event_id, unnest(json_keys({value})) AS k FROM r WHERE {parent}) WHERE k NOT IN ({', '.join(repr(k) for k in known)})"


_ROOT, _USER = "json_type(j) = 'OBJECT'", "json_type(j) = 'OBJECT' AND json_type(j, '$.user') = 'OBJECT'"
_PROPS, _TAGS = "json_type(j) = 'OBJECT' AND json_type(j, '$.props') = 'OBJECT'", "json_type(j) = 'OBJECT' AND json_type(j, '$.user.tags') = 'ARRAY'"


@query("events", sql=f"WITH t AS (SELECT event_id, {_RECORD} AS body FROM events), r AS (SELECT event_id, body, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM t) " + " UNION ALL ".join([
    "SELECT event_id, '$' AS path, 'not JSON' AS problem FROM r WHERE j IS NULL",
    f"SELECT event_id, '$', {_KINDS.format('j')} || ', not object' FROM r WHERE j IS NOT NULL AND json_type(j) <> 'OBJECT'",
    _sql_member(_ROOT, "$.id", "json_extract(j, '$.id')", "int", True), _sql_member(_ROOT, "$.user", "json_extract(j, '$.user')", "object", True),
    _sql_member(_ROOT, "$.value", "json_extract(j, '$.value')", "number|null", False), _sql_member(_ROOT, "$.props", "json_extract(j, '$.props')", "object", True),
    _sql_member(_USER, "$.user.id", "json_extract(j, '$.user.id')", "int", True), _sql_member(_USER, "$.user.tags", "json_extract(j, '$.user.tags')", "array", False),
    _sql_member(_PROPS, "$.props.k", "json_extract(j, '$.props.k')", "int", True),
    f"SELECT event_id, '$.user.tags[]', {_KINDS.format('x')} || ', not string' FROM (SELECT event_id, unnest(json_extract(j, '$.user.tags[*]')) AS x FROM r WHERE {_TAGS}) WHERE json_type(x) <> 'VARCHAR'",
    _sql_added(_ROOT, "$", "j", ["id", "user", "value", "props"]), _sql_added(_USER, "$.user", "json_extract(j, '$.user')", ["id", "tags"]), _sql_added(_PROPS, "$.props", "json_extract(j, '$.props')", ["k"]),
]))
def d8_record_shape(events: DataFrame) -> DataFrame:
    """Records of seven forms, of which one keeps the shape."""
    records = events.select("event_id", F.expr(_RECORD).alias("body"))
    return shapes.shape_problems(records, "event_id", "body", _SHAPE).withColumnRenamed("key", "event_id")


# --- services -----------------------------------------------------------------------------------------------------------


def _service(request: str) -> calls.Response | str:
    """A stand-in for a service over the network, which fails by what it is asked."""
    n = int(request)
    if n % 13 == 1:
        raise TimeoutError("no answer")
    if n % 13 == 2:
        raise ConnectionError("refused")
    if n % 13 == 3:
        raise ValueError(f"bad request {n}")
    return {4: calls.Response(503, "busy"), 5: "", 6: "<html>", 7: calls.Response(404, "")}.get(n % 13, json.dumps({"id": n, "double": 2 * n}))


@query("orders", sql="""
SELECT o_orderkey, CASE k WHEN 1 THEN 'timeout' WHEN 2 THEN 'connection' WHEN 3 THEN 'error' WHEN 4 THEN 'status' WHEN 5 THEN 'empty' WHEN 6 THEN 'not_json' WHEN 7 THEN 'status' ELSE 'ok' END AS failure,
  CASE WHEN k = 0 OR k > 7 THEN 2 * o_custkey END AS double, CASE k WHEN 3 THEN 'bad request ' || o_custkey WHEN 4 THEN 'status 503' WHEN 7 THEN 'status 404' END AS told
FROM (SELECT *, o_custkey % 13 AS k FROM orders)""")
def s17_typed_failures(orders: DataFrame) -> DataFrame:
    """A call for each order, by its customer; the message is told of the types that carry one."""
    said = calls.call_service(orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("request")), "request", _service)
    r, body = F.col("result"), F.from_json("result.body", "id long, double long")
    return said.select("o_orderkey", calls.failures(r).alias("failure"), body["double"].alias("double"), F.when(r["failure"].isin("error", "status"), r["message"]).alias("told"))


def _halved(value: str) -> dict:
    n = int(value)
    if n % 5 == 0:
        raise ValueError("fives aren't halved")
    return {"half": n // 2}


def _named(value: dict) -> str:
    if value["half"] % 7 == 0:
        raise LookupError(f"no name for {value['half']}")
    return f"h{value['half']}"


@query("customer", sql="""
WITH c AS (SELECT c_custkey AS key, c_custkey // 2 AS h FROM customer)
SELECT key, CAST(1 AS INTEGER) AS seq, 'halve' AS step, '"' || key || '"' AS input, CASE WHEN key % 5 <> 0 THEN '{"half": ' || h || '}' END AS output, CASE WHEN key % 5 = 0 THEN 'ValueError: fives aren''t halved' END AS error FROM c
UNION ALL
SELECT key, 2, 'name', '{"half": ' || h || '}', CASE WHEN h % 7 <> 0 THEN '"h' || h || '"' END, CASE WHEN h % 7 = 0 THEN 'LookupError: no name for ' || h END FROM c WHERE key % 5 <> 0""")
def x11_r22_traced_calls(customer: DataFrame) -> DataFrame:
    """Each call of two steps, those of failed rows, too."""
    return calls.traced(customer, "c_custkey", "c_custkey", {"halve": _halved, "name": _named})[1]


@query("pages", sql=r"""
WITH p AS (SELECT DISTINCT url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS site FROM pages)
SELECT url, row_number() OVER (PARTITION BY site ORDER BY url) - 1 AS slot, 2.5 * (row_number() OVER (PARTITION BY site ORDER BY url) - 1) AS due FROM p""")
def s10_fetch_schedule(pages: DataFrame) -> DataFrame:
    """When each page may be fetched, 2.5 seconds after the one before of its site."""
    return calls.schedule(pages.select("url", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("site")), "url", "site", 2.5).select("url", "slot", "due")


@query("pages", sql="SELECT url, CASE WHEN length(url) % 9 <> 0 THEN '<p>' || url || '</p>' END AS content, CASE WHEN length(url) % 9 = 0 THEN 'ConnectionError: down' END AS error FROM (SELECT DISTINCT url FROM pages)")
def s10_j4_fetched_once(pages: DataFrame) -> DataFrame:
    """Pages fetched in two goes; the second one finds what the first left out, and would answer otherwise."""

    def page(url: str) -> str:
        if len(url) % 9 == 0:
            raise ConnectionError("down")
        return f"<p>{url}</p>"

    path = store.scratch(pages.sparkSession)
    rows = pages.select("url", "page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"))
    calls.fetch_pending(rows.where(F.crc32(F.col("url").cast("binary")) % 2 == 0), path, page, interval=0.0)
    return calls.fetch_pending(rows, path, page, interval=0.0).select("url", "content", "error")


@query("documents", sql="SELECT doc_id, n_chars, sha256(coalesce(text, '')) AS digest FROM documents")
def x9_resumed_run(documents: DataFrame) -> DataFrame:
    """A run that ends after three of eight parts, and is then taken up."""
    answer = lambda df: df.select("doc_id", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    path = store.scratch(documents.sparkSession)
    calls.resume_run(documents, "doc_id", path, answer, stop_after=3)
    return calls.resume_run(documents, "doc_id", path, answer, protected={"documents": documents.select("doc_id", "n_chars")})


# --- routing and reports ------------------------------------------------------------------------------------------------


@query("conversations", sql="""
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'U:' || turn WHEN 'system' THEN 'S' END AS reply,
  CASE WHEN role IS NULL THEN 'no route' WHEN role NOT IN ('user', 'system') THEN 'no branch for ' || role END AS error
FROM (SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN role END AS role FROM conversations)""")
def r14_unrouted_rows(conversations: DataFrame) -> DataFrame:
    """Rows without a route, and of a route without a branch, say so."""
    routed = conversations.select("conv_id", "turn", F.when(F.col("turn") % 4 != 3, F.col("role")).alias("role"))
    say = lambda c: lambda df: df.select("conv_id", "turn", c.alias("reply"))
    return dialogue.dispatch(routed, "role", {"user": say(F.concat(F.lit("U:"), F.col("turn").cast("string"))), "system": say(F.lit("S"))}).select("conv_id", "turn", "reply", "error")


@query("labels", sql="SELECT doc_id, '[router]' || chr(10) || 'keep=' || printf('%.2f', p) || chr(10) || 'drop=' || printf('%.2f', 1 - p) || chr(10) || 'selected=' || CASE WHEN p >= 0.45 THEN 'keep' ELSE 'drop' END AS told FROM (SELECT doc_id, (doc_id % 1009) / 1009.0 AS p FROM labels)")
def r14_routing_lines(labels: DataFrame) -> DataFrame:
    p = F.col("doc_id") % 1009 / F.lit(1009.0)
    scores = F.create_map(F.lit("keep"), p, F.lit("drop"), 1 - p)
    return labels.select("doc_id", dialogue.routing_lines(scores, F.when(p >= 0.45, "keep").otherwise("drop")).alias("told"))


@query("documents", "labels", sql="""
WITH d AS (SELECT coalesce(lang, 'none') AS lang, quality, n_chars FROM documents LEFT JOIN labels USING (doc_id)),
g AS (SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, grouping(lang) AS s, count(*) AS n, count(quality) AS labelled, count(CASE WHEN quality = 1 THEN 1 END) AS good, max(n_chars) AS longest FROM d GROUP BY ROLLUP (lang)),
q AS (SELECT coalesce(CAST(quality AS VARCHAR), '-') AS quality, count(*) AS n FROM d GROUP BY quality)
SELECT '# Corpus' || chr(10) || chr(10) || '## 1. Languages' || chr(10) || chr(10) || 'Labels as given.' || chr(10) || chr(10) || '| lang | n | labelled | good | longest |' || chr(10) || '|---|---|---|---|---|' || chr(10)
  || (SELECT string_agg('| ' || lang || ' | ' || n || ' | ' || labelled || ' | ' || good || ' | ' || longest || ' |', chr(10) ORDER BY s, lang) FROM g) || chr(10) || chr(10)
  || '## 2. Quality' || chr(10) || chr(10) || '| quality | n |' || chr(10) || '|---|---|' || chr(10)
  || (SELECT string_agg('| ' || quality || ' | ' || n || ' |', chr(10) ORDER BY CASE WHEN quality = '-' THEN '' ELSE quality END) FROM q) AS report""")
def r25_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    told = documents.join(labels, "doc_id", "left").select(F.coalesce("lang", F.lit("none")).alias("lang"), "quality", "n_chars")
    sums = [F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.max("n_chars").alias("longest")]
    langs = told.rollup("lang").agg(F.grouping("lang").alias("s"), *sums).withColumn("lang", F.when(F.col("s") == 1, "all").otherwise(F.col("lang")))
    quality = told.groupBy("quality").agg(F.count(F.lit(1)).alias("n"))
    return reports.render(documents.sparkSession, "Corpus", [
        reports.Section("Languages", langs, ["lang", "n", "labelled", "good", "longest"], ["s", "lang"], "Labels as given."),
        reports.Section("Quality", quality, ["quality", "n"], ["quality"]),
    ])


# --- pages, chunks and their checks -------------------------------------------------------------------------------------


@query("documents", sql=rf"""
WITH {_LINES}
SELECT doc_id, 2 * i AS pos, 'heading' AS kind, 2 AS level, 'Part ' || i AS text FROM l
UNION ALL SELECT doc_id, 2 * i + 1, 'paragraph', 0, CASE WHEN i % 2 = 0 THEN 'x' || chr(10) || 'y' || chr(10) || 'z' || CASE WHEN t <> '' THEN chr(10) || t ELSE '' END ELSE trim('x y ' || t) END FROM l""")
def x1_line_breaks(documents: DataFrame) -> DataFrame:
    """Every line in a paragraph after three line breaks, which keep their lines, or after two, which are wraps."""

    def part(line: Column, i: Column) -> Column:
        head = _widget("heading", F.concat(F.lit("<h2>Part "), i.cast("string"), F.lit("</h2>")))
        return F.concat(head, _widget("text-editor", F.when(i % 2 == 0, "<p>x<br>y<br>z<br>").otherwise("<p>x<br>y<br>"), _escaped(line), "</p>"))

    blocks = _page(documents, part).select("doc_id", html.blocks_udf()(F.col("html")).alias("r")).select("doc_id", F.posexplode("r.blocks").alias("pos", "b"))
    return blocks.select("doc_id", F.col("pos").cast("long").alias("pos"), "b.kind", "b.level", "b.text")


@query("documents", sql=r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw FROM documents),
t AS (SELECT doc_id, 'z' || regexp_replace(raw, '\s+$', '') AS t FROM l)
SELECT doc_id, count(*) FILTER (length(t) <= 60 AND NOT regexp_matches(t, '[.!?:;]$')) AS labels, count(*) FILTER (length(t) > 60 OR regexp_matches(t, '[.!?:;]$')) AS content FROM t GROUP BY doc_id""")
def c15_label_pages(documents: DataFrame) -> DataFrame:
    """Every line on a page of its own: short lines without closing punctuation make pages of labels."""
    page = lambda line, i: F.concat(F.lit("<!-- source_page: "), (i + 1).cast("string"), F.lit(" -->\n\nz"), line)
    body = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), page), "\n\n")
    u = chunks.units(documents.select("doc_id", body.alias("markdown")), "doc_id", "markdown")
    blocks = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.size("blocks"))), F.lit(0)).cast("long")
    return u.groupBy("doc_id").agg(blocks("page_labels").alias("labels"), blocks("content").alias("content"))


@query("documents", sql=r"""
WITH l AS (SELECT doc_id, source, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
b AS (SELECT doc_id, any_value(source) AS source, string_agg('z' || regexp_replace(raw, '\s+$', ''), chr(10) || chr(10) ORDER BY i) AS body FROM l GROUP BY doc_id),
w AS (SELECT doc_id, source, body || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'The closing page has a sentence.' ELSE '' END AS body FROM b)
SELECT printf('d%06d::c0001', doc_id) AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN [1, 2] END AS source_pages, source AS section, CAST(length(body) AS INTEGER) AS body_chars, CAST(0 AS INTEGER) AS overlap_chars,
       '# Document ' || doc_id || chr(10) || '## ' || source || chr(10) || chr(10) || body AS text FROM w WHERE length(body) <= 1000""")
def c18_c20_j11_whole_units(documents: DataFrame) -> DataFrame:
    """Chunks of documents whose one unit is one piece, with the pages that it spans."""
    half = F.col("doc_id") % 2 == 0
    lines = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("z"), x)), "\n\n")
    body = F.concat(F.when(half, "<!-- source_page: 1 -->\n\n").otherwise(""), F.lit("## "), "source", F.lit("\n\nOne."), F.lit("\n\n"), lines, F.when(half, "\n\n<!-- source_page: 2 -->\n\nThe closing page has a sentence.").otherwise(""))
    records = catalog._markdown(documents).join(documents.select(F.format_string("d%06d", "doc_id").alias("document_id"), F.replace(body, F.lit("One.\n\n"), F.lit("")).alias("own")), "document_id")
    found = chunks.chunk_documents(records.withColumn("markdown", F.col("own")).drop("own"))
    return found.where("unit_chunk_count = 1").select("chunk_id", "source_pages", "section", "body_chars", "overlap_chars", "text")


@query("documents", sql=r"""
WITH d AS (SELECT *, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, '---' || chr(10) || 'title: "' || replace(x[1], '"', '\"') || '"' || chr(10) || 'lang: "' || lang || '"' || chr(10) || 'source_type: "web_page"' || chr(10) || '---' || chr(10) || chr(10) || '# ' || x[1] || chr(10) || chr(10)
  || array_to_string(list_transform(range(1, len(x) + 1), lambda i: CASE i % 3 WHEN 1 THEN '## ' || x[i] WHEN 2 THEN '> ' || x[i] ELSE x[i] END), chr(10) || chr(10)) || chr(10) AS markdown FROM d""")
def t22_rendered_documents(documents: DataFrame) -> DataFrame:
    """Lines as headings, quotes and paragraphs in turn, under front matter."""
    lines = F.split("text", "\n")
    block = lambda t, i: F.struct(F.when(i % 3 == 0, "heading").when(i % 3 == 1, "quote").otherwise("paragraph").alias("kind"), F.lit(2).alias("level"), t.alias("text"))
    told = html.render_document({"title": F.get(lines, F.lit(0)), "lang": F.col("lang")}, F.transform(lines, block))
    return documents.where("text IS NOT NULL").select("doc_id", told.alias("markdown"))


@query("pages", sql="SELECT page_id, sha256(html || CASE WHEN html LIKE '%' || chr(10) THEN '' ELSE chr(10) END) AS digest FROM pages WHERE html IS NOT NULL")
def s6_s12_files_with_digests(pages: DataFrame) -> DataFrame:
    """Each page as a file, read back as bytes."""
    path = store.scratch(pages.sparkSession)
    files.write_markdown(pages.where("html IS NOT NULL"), path, "page_id", "html")
    back = files.read_binary(pages.sparkSession, path, below="part-*")
    return back.select(F.regexp_extract("path", "page_id=([0-9]+)/", 1).cast("long").alias("page_id"), "digest")


@query("documents", "benchmark", sql=catalog.SQL["j9_best_overlap"])
def x5_overlap_without_comments(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Corpus texts with comments full of other words in them, which don't count."""
    told = benchmark.select("item_id", F.concat(F.lit("<!-- page: 1\n of the and to in that it is -->"), F.coalesce("text", F.lit("")), F.lit("<!-- end -->")).alias("text"))
    return similarity.best_overlap(documents, "doc_id", "text", told, "item_id", "text")


# --- checks of sets and runs --------------------------------------------------------------------------------------------


@query("part", sql="""
WITH i AS (SELECT p_partkey AS id, 'c' || p_size % 9 AS category, p_size % 2 = 0 AS rag, p_partkey % 3 = 0 AS weather, p_size > 40 AS places,
             CASE WHEN p_partkey % 3 = 0 OR p_partkey % 50 = 1 THEN CASE WHEN p_partkey % 7 = 0 THEN 'get_tides' ELSE 'get_weather_forecast' END END AS tool, p_size % 2 = 0 AND p_partkey % 11 <> 0 AS gold FROM part),
e AS (SELECT CAST(id AS VARCHAR) AS id, unnest(list_filter([CASE WHEN weather AND tool = 'get_tides' THEN 'weather: expected tool missing or unknown' END, CASE WHEN NOT weather AND tool IS NOT NULL THEN 'weather: expected tool without the capability' END,
        CASE WHEN places THEN 'places: expected tool missing or unknown' END, CASE WHEN rag <> gold THEN 'rag: gold chunks do not fit the capability' END, CASE WHEN category IN ('c7', 'c8') THEN 'unknown category' END], lambda x: x IS NOT NULL)) AS problem FROM i)
SELECT * FROM e
UNION ALL SELECT category, 'category has ' || count(*) || ' items' FROM i GROUP BY category HAVING count(*) <> 5
UNION ALL SELECT * FROM (SELECT unnest(['rag', 'weather', 'places']) AS id, 'capability has ' || unnest([count(*) FILTER (rag), count(*) FILTER (weather), count(*) FILTER (places)]) || ' items' AS problem, unnest([count(*) FILTER (rag), count(*) FILTER (weather), count(*) FILTER (places)]) <> 20 AS off FROM i) SELECT id, problem WHERE off""".replace("SELECT * FROM (SELECT unnest(['rag'", "SELECT id, problem FROM (SELECT unnest(['rag'").replace(" AS off FROM i) SELECT id, problem WHERE off", " AS off FROM i) WHERE off"))
def d6_item_problems(part: DataFrame) -> DataFrame:
    """Items made from parts, some of whose tools, gold chunks and categories don't fit."""
    k, n = F.col("p_partkey"), F.col("p_size")
    weather, rag = k % 3 == 0, n % 2 == 0
    tool = F.when(weather | (k % 50 == 1), F.when(k % 7 == 0, "get_tides").otherwise("get_weather_forecast"))
    gold = F.when(rag & (k % 11 != 0), F.array(F.lit("g"))).otherwise(F.array().cast("array<string>"))
    items = part.select(k.cast("string").alias("id"), F.concat(F.lit("c"), (n % 9).cast("string")).alias("category"), rag.alias("rag"), weather.alias("weather"), (n > 40).alias("places"), tool.alias("expected_weather"), F.lit(None).cast("string").alias("expected_places"), gold.alias("gold_chunks"))
    return evaluation.item_problems(items, [f"c{i}" for i in range(7)], 5, 20)


@query("orders", sql="""
SELECT o_orderkey AS run_id, unnest(list_filter([CASE WHEN o_orderstatus <> 'F' THEN 'the run isn''t complete' END, CASE WHEN o_totalprice < 50000 THEN 'the run isn''t valid' END, CASE WHEN o_custkey % 5 = 0 THEN 'records are missing' END,
  CASE WHEN o_orderkey % 4 = 1 THEN 'the results have changed' END, CASE WHEN o_custkey % 3 = 0 THEN 'the judge must be another model than those it judges' END], lambda x: x IS NOT NULL)) AS problem FROM orders""")
def d11_judge_inputs(orders: DataFrame) -> DataFrame:
    """Orders as runs that may or may not be judged."""
    n, k = F.col("o_custkey"), F.col("o_orderkey")
    runs = orders.select(
        k.alias("run_id"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise(F.col("o_orderstatus")).alias("status"), (F.col("o_totalprice") >= 50000).alias("valid_run"), n.alias("question_count"), F.when(n % 5 == 0, n - 1).otherwise(n).alias("record_count"),
        F.sha2(k.cast("string"), 256).alias("digest"), F.sha2(F.when(k % 4 == 1, F.lit("x")).otherwise(k.cast("string")), 256).alias("expected_digest"), F.lit("m0").alias("judge_model"), F.array(F.concat(F.lit("m"), (n % 3).cast("string")), F.lit("m9")).alias("evaluated_models"),
    )
    return agent.judge_input_problems(runs)


@query("documents", "labels", sql="""
SELECT 'both' AS kind, doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT 'unlabelled', doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT 'toxic or good', doc_id FROM (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 1)""")
def w4_id_sets(documents: DataFrame, labels: DataFrame) -> DataFrame:
    ids = lambda df: df.select("doc_id")
    sets = {"both": ids(documents).intersect(ids(labels)), "unlabelled": ids(documents).subtract(ids(labels)), "toxic or good": ids(labels.where("toxic = 1")).union(ids(labels.where("quality = 1"))).distinct()}
    told = [df.select(F.lit(name).alias("kind"), "doc_id") for name, df in sets.items()]
    return told[0].unionByName(told[1]).unionByName(told[2])


# --- messages and answers -----------------------------------------------------------------------------------------------


@query("documents", sql="""
SELECT doc_id, 'CONTEXTO:' || chr(10) || chr(10) || source || chr(10) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '[Metadados de curadoria sobre conflitos conhecidos entre fontes]' || chr(10) || lang || chr(10) || chr(10) ELSE '' END
  || 'PERGUNTA:' || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'Responde apenas com base no contexto acima.' AS message, 'S' || chr(10) || chr(10) || 'CONTEXTO:' || chr(10) || chr(10) || source AS older_system, coalesce(text, '') AS older_user FROM documents""")
def r5_messages(documents: DataFrame) -> DataFrame:
    """Whole texts as questions, a conflict note on every third; and the older form."""
    question = F.coalesce("text", F.lit(""))
    older = retrieval.older_messages(F.lit("S"), question, F.col("source"))
    told = retrieval.messages(question, F.col("source"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")))
    return documents.select("doc_id", told.alias("message"), older["system"].alias("older_system"), older["user"].alias("older_user"))


@query("conversations", sql="SELECT conv_id, turn, CASE WHEN length(coalesce(text, '')) % 4 <> 0 THEN upper(role) || ' ' || length(text) END AS answer, CASE WHEN length(coalesce(text, '')) % 4 = 0 THEN 'model is busy' END AS answer_error FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL")
def r7_generated(conversations: DataFrame) -> DataFrame:
    """An injected model that fails on some prompts."""

    def model(prompt: str) -> str:
        role, _, text = prompt.partition(" ")
        if len(text) % 4 == 0:
            raise RuntimeError("model is busy")
        return f"{role.upper()} {len(text)}"

    asked = conversations.where("text IS NOT NULL AND role IS NOT NULL").select("conv_id", "turn", F.concat_ws(" ", "role", "text").alias("prompt"))
    return retrieval.generate(asked, "prompt", "answer", model).drop("prompt")
