"""The opN_ queries: each applies its operator to a whole table and derives the digest columns from its output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, clustering, jpeg, langid, line_dedup, lm_score, merkle, mixing, packing, quality, quality_fm, sharding, simhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.col("src").alias("source"), "copies")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_held_out(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), limits=packing.Limits(4096, 64, 4096))
    return packed.select("doc_id", "start", "length", F.crc32("ids_le").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens", "segments")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(_table(spark, sf_dir, "documents"))


def op4_lm_score_order2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams with one backoff step."""
    return lm_score.lm_scores(_table(spark, sf_dir, "documents"), order=2)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"), counts=True).select("doc_id", "text", "n_lines", "n_dropped")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests come from the formatted text: turns as parsed from it, loss text as cut from it by the loss spans."""
    said = F.lit("\\### Assistant: </turn> ok")
    test = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    chats = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(test)
    read = chat.read_chats(chat.format_chats(chats)).withColumn("mask", chat.loss_mask(F.col("segments")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("mask", lambda m: chat.unescape(F.substring(F.col("formatted"), m["start"] + 1, m["length"]))), "")
    out = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"), "valid")
    return out.select("conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "valid")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tensor is a column of the operator's output, of height x width x 3 bytes; the query returns its digest."""
    stored = jpeg.to_media(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    read = jpeg.read_media(stored, tensor=True, payload=True)
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        "height", "width", F.octet_length("rgb").cast("long").alias("rgb_bytes"), F.sha2("rgb", 256).alias("rgb_sha256"),
    )


def op11_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.score_held_out(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_report(_table(spark, sf_dir, "embeddings")).drop("n_exact")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows, by their id, is verified as a copy whose text has lost its capitals."""
    docs = _table(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    checked = merkle.leaf_digest(*[tampered if c == "text" else F.col(c) for c in merkle.COLUMNS])
    found = merkle.manifest(docs, checked=checked).withColumn("folded_root", merkle.fold(F.col("checked_leaf"), F.col("path")))
    proof = merkle.proof_digest(F.col("path")).alias("proof_sha256")
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "position")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_langid, op3_packing, op4_lm_score, op4_lm_score_order2, op5_simhash, op6_line_dedup, op7_chat, op8_sharding, op9_quality, op10_jpeg, op11_quality_fm, op12_clustering, op13_merkle)}


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP6_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
pages AS (SELECT source, count(*) AS n FROM docs GROUP BY source),
each AS (SELECT rid, source, unnest(list_distinct(lines)) AS line FROM docs),
often AS (
  SELECT e.source, e.line FROM each e JOIN pages p ON e.source IS NOT DISTINCT FROM p.source
  WHERE regexp_matches(e.line, '[^\x20\x09-\x0D]')
  GROUP BY e.source, e.line, p.n HAVING count(*) >= 5 AND count(*) > p.n * CAST(0.1 AS DOUBLE)),
flags AS (SELECT source, list(line) AS bad FROM often GROUP BY source),
cut AS (
  SELECT d.doc_id, d.text, d.lines, f.bad,
         list_filter(d.lines, lambda s: NOT list_contains(coalesce(f.bad, []), s)) AS kept
  FROM docs d LEFT JOIN flags f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, CASE WHEN text IS NULL OR bad IS NULL THEN text ELSE array_to_string(kept, chr(10)) END AS text,
       CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(lines), 0) - coalesce(len(kept), 0) AS BIGINT) AS n_dropped
FROM cut
"""

OP9_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
wins AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3),
keyed AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM wins),
hit AS (SELECT DISTINCT rid, i + unnest([0, 1, 2]) AS p FROM keyed WHERE n > 1),
rep AS (SELECT rid, count(*) AS n FROM hit GROUP BY rid),
base AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         len(regexp_extract_all(text, '\p{{L}}')) AS letters, len(regexp_extract_all(text, '\p{{Lu}}')) AS uppers,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS lettered
  FROM docs d LEFT JOIN rep r USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
         OR uppers * 10 > letters * 3 OR lettered * 10 < n_words * 7 OR n_dup_lines * 2 > n_lines) AS kept
FROM judged
"""


OP4_ORDER2_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
uni AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, w FROM docs),
tok AS (SELECT rid, i, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a FROM uni),
one AS (SELECT b, count(*) AS n FROM tok GROUP BY b),
two AS (SELECT a, b, count(*) AS n FROM tok WHERE a IS NOT NULL GROUP BY a, b),
allw AS (SELECT sum(n) AS n FROM one),
sc AS (
  SELECT t.rid, CASE WHEN t.a IS NULL THEN ln(CAST(o.n AS DOUBLE) / allw.n)
                     WHEN two.n >= 2 THEN ln(CAST(two.n AS DOUBLE) / c.n)
                     ELSE ln(CAST(0.4 AS DOUBLE)) + ln(CAST(o.n AS DOUBLE) / allw.n) END AS s
  FROM tok t JOIN one o ON t.b = o.b LEFT JOIN one c ON t.a = c.b LEFT JOIN two ON t.a = two.a AND t.b = two.b CROSS JOIN allw),
per AS (SELECT rid, count(*) AS n, sum(CAST(round(s * 1e6) AS BIGINT)) AS m FROM sc GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(p.n, 0) AS BIGINT) AS n_words, coalesce(CAST(p.m AS DOUBLE), 0) / 1e6 AS score
FROM docs d LEFT JOIN per p USING (rid)
"""

OP4_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
uni AS (SELECT rid, unnest(w) AS c, unnest(range(1, len(w) + 1)) AS i FROM docs),
tok AS (SELECT rid, i, c, lag(c) OVER p AS b, lag(c, 2) OVER p AS a FROM uni WINDOW p AS (PARTITION BY rid ORDER BY i)),
one AS (SELECT c, count(*) AS n FROM tok GROUP BY c),
two AS (SELECT b, c, count(*) AS n FROM tok WHERE i >= 2 GROUP BY b, c),
three AS (SELECT a, b, c, count(*) AS n FROM tok WHERE i >= 3 GROUP BY a, b, c),
allw AS (SELECT sum(n) AS n FROM one),
one_value AS (SELECT c, one.n, ln(CAST(one.n AS DOUBLE) / allw.n) AS v FROM one CROSS JOIN allw),
two_value AS (SELECT two.b, two.c, two.n, ln(CAST(two.n AS DOUBLE) / o.n) AS v FROM two JOIN one o ON two.b = o.c WHERE two.n >= 2),
three_value AS (
  SELECT t.a, t.b, t.c, ln(CAST(t.n AS DOUBLE) / w.n) AS v FROM three t JOIN two w ON t.a = w.b AND t.b = w.c WHERE t.n >= 2),
sc AS (
  SELECT t.rid, CASE WHEN t.i = 1 THEN o.v
                     WHEN t.i = 2 THEN coalesce(w.v, ln(CAST(0.4 AS DOUBLE)) + o.v)
                     ELSE coalesce(h.v, ln(CAST(0.4 AS DOUBLE)) + coalesce(w.v, ln(CAST(0.4 AS DOUBLE)) + o.v)) END AS s
  FROM tok t JOIN one_value o ON t.c = o.c LEFT JOIN two_value w ON t.b = w.b AND t.c = w.c
  LEFT JOIN three_value h ON t.a = h.a AND t.b = h.b AND t.c = h.c),
per AS (SELECT rid, count(*) AS n, sum(CAST(round(s * 1e6) AS BIGINT)) AS m FROM sc GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(p.n, 0) AS BIGINT) AS n_words, coalesce(CAST(p.m AS DOUBLE), 0) / 1e6 AS score
FROM docs d LEFT JOIN per p USING (rid)
"""

OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, role IS NULL AS none, coalesce(text, '') AS t, text FROM conversations
  UNION ALL SELECT -7, n, r, false, '\### Assistant: </turn> ok', '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)),
e AS (
  SELECT *, length(replace(replace(t, '\', '\b'), '<', '\l')) + length('</turn>')
         + CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) + 2
                WHEN none THEN length('<other>') + 1
                ELSE length('<other>') + 2 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), chr(10), '\n')) END AS n,
         lead(role) OVER w AS next_role, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS turns
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, NOT none, role, text NULLS FIRST))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars,
       bool_and(CASE WHEN k = 1 THEN role IN ('system', 'user') ELSE true END)
         AND bool_and(CASE WHEN k = turns THEN role = 'assistant'
                           WHEN role = 'system' THEN k = 1 AND next_role = 'user'
                           WHEN role = 'user' THEN next_role = 'assistant'
                           WHEN role = 'assistant' THEN next_role = 'user' ELSE false END) AS valid
FROM e GROUP BY conv_id
"""


def _op12_sql(k: int = 40, rounds: int = 5) -> str:
    """Every distance of every round, as joins."""
    made = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
comp AS MATERIALIZED (SELECT rid, unnest(range(0, 64)) AS i, CAST(floor(CAST(unnest(e) AS DOUBLE) * 256) AS BIGINT) AS x FROM kept),
first AS (SELECT rid, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k}),
p0 AS MATERIALIZED (SELECT c, i, x FROM first JOIN comp USING (rid))"""]
    for r in range(rounds + 1):
        made.append(f"""
d{r} AS (SELECT rid, c, CAST(sum((comp.x - p.x) * (comp.x - p.x)) AS BIGINT) AS d FROM comp JOIN p{r} p USING (i) GROUP BY rid, c),
a{r} AS MATERIALIZED (SELECT rid, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)""")
        if r < rounds:
            made.append(f"""
m{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN comp USING (rid) GROUP BY c, i),
p{r + 1} AS MATERIALIZED (
  SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM p{r} LEFT JOIN m{r} USING (c, i))""")
    return ",".join(made) + f""",
shas AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM p{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN shas USING (c)
"""


_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"
_HEAD = " || ".join(_FIELD.format(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"))
# CRC-32, bit by bit over the digits of the id
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda s: [CAST(ord(s) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"""


def _nodes(name: str, leaves: str) -> str:
    """All nodes of the trees over leaves (tree, idx, n, digest), and beside each node what lies before and after it in its run."""
    return f"""
{name} AS (
  SELECT tree, 0 AS level, idx, n, digest FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 8, n),
{name}_beside AS MATERIALIZED (
  SELECT tree, level, idx, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name} WHERE n > 1 WINDOW w AS (PARTITION BY tree, level, idx // 8 ORDER BY idx)),
{name}_top AS MATERIALIZED (SELECT tree, level, digest FROM {name} WHERE n = 1)"""


def _climb(name: str, nodes: str, start: str) -> str:
    return f"""
{name} AS (
  {start}
  UNION ALL
  SELECT c.rid, c.tree, c.level + 1, c.idx // 8, sha256(b.before || c.h || b.after), c.proof || b.before || b.after
  FROM {name} c JOIN {nodes}_beside b USING (tree, level, idx)),
{name}_end AS MATERIALIZED (SELECT c.rid, c.tree, c.h, c.proof FROM {name} c JOIN {nodes}_top t USING (tree, level))"""


OP13_SQL = f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS tree, {_HEAD} AS head, text, coalesce({_CRC} % 3 = 0, false) AS changed FROM documents),
leaf AS (
  SELECT rid, doc_id, tree, sha256(head || {_FIELD.format("text")}) AS digest,
         sha256(head || {_FIELD.format("(CASE WHEN changed THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END)")}) AS checked
  FROM docs),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
{_nodes("node", "leaves")},
subs AS MATERIALIZED (SELECT 'root' AS tree, tree AS sub, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM node_top),
{_nodes("upper", "subs")},
{_climb("low", "node", "SELECT rid, tree, 0 AS level, idx, checked AS h, '' AS proof FROM leaves")},
{_climb("high", "upper", "SELECT e.rid, 'root' AS tree, 0 AS level, s.idx, e.h, e.proof FROM low_end e JOIN subs s ON e.tree = s.sub")}
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, t.digest AS root, sha256(h.proof) AS proof_sha256, h.h AS folded_root,
       h.h = t.digest AS verified, l.idx AS position
FROM leaves l JOIN subs s ON l.tree = s.sub JOIN upper_top t ON t.tree = 'root' JOIN high_end h USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_clustering": _op12_sql(), "op13_merkle": OP13_SQL, "op4_lm_score": OP4_SQL, "op4_lm_score_order2": OP4_ORDER2_SQL, "op6_line_dedup": OP6_SQL, "op7_chat": OP7_SQL, "op9_quality": OP9_SQL}
