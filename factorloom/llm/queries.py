"""A query for each operator over its whole table, and its SQL where there is one."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import (alignment, bpe, chat, embedding_dedup, fingerprints, line_dedup, merkle, near_dedup, packing,
                            pii, quality, suffixes, toxicity)
from factorloom.llm.frames import read
from factorloom.session import materialize


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels, learn=~held_out())
    scored = toxicity.score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "offending")


def op2_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality.resample(documents.select("doc_id", "text"), labels, learn=~held_out())


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_neighbours(read(spark, sf_dir, "documents"))


def op5_weighted_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.classes(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", F.coalesce(
        F.col("id") == F.col("class_id"), F.lit(False)).alias("kept"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(read(spark, sf_dir, "embeddings"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(read(spark, sf_dir, "documents"))


def op8_recursive_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return bpe.decode(encoded, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.swapped_answers(read(spark, sf_dir, "conversations"))
    found = chat.format_preferences(pairs)
    spans = {f"{side}_mask": F.array_join(F.transform(f"{side}_trained", lambda s: F.concat_ws(
        "-", s["start"].cast("string"), s["end"].cast("string"))), ",") for side in ("chosen", "rejected")}
    return found.withColumns(spans).drop("chosen_trained", "rejected_trained")


def op10_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select(
        "page_id", line_dedup.url_host(F.col("url")).alias("host"),
        line_dedup.html_lines(F.col("html")).alias("text"))
    pages = materialize(pages, "page_lines")  # read twice, and cleaning is the dear part
    return line_dedup.drop_boilerplate(pages, "host", "text")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.statistics(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                public_tokenizers.path("piece_bpe_32k.model"))


def op12_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(read(spark, sf_dir, "documents"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _html_sql(column: str) -> str:
    out = f"regexp_replace({column}, {_sql(line_dedup.HIDDEN)}, ' ', 'g')"
    out = f"regexp_replace({out}, {_sql(line_dedup.BLANKS)}, ' ', 'g')"
    out = f"regexp_replace({out}, {_sql(line_dedup.BLOCK)}, chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'g')"
    for entity, plain in line_dedup.ENTITIES:
        out = f"replace({out}, {_sql(entity)}, {_sql(plain)})"
    return f"trim(regexp_replace({out}, {_sql(line_dedup.GAPS)}, chr(10), 'g'), chr(10) || ' ')"


_OP10 = f"""
WITH pages_ AS (
  SELECT row_number() OVER () AS rid, page_id, {_html_sql('html')} AS text,
         nullif(lower(regexp_extract(url, {_sql(line_dedup.HOST)}, 1)), '') AS host FROM pages),
split_ AS (
  SELECT rid, host, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS at FROM pages_),
totals AS (SELECT host, count(*) AS n FROM pages_ WHERE host IS NOT NULL GROUP BY host),
bad AS (
  SELECT s.host, trim(s.line) AS line FROM split_ s JOIN totals t ON s.host = t.host
  WHERE trim(s.line) <> '' GROUP BY s.host, trim(s.line), t.n
  HAVING count(DISTINCT rid) / t.n > {line_dedup.MAX_RATIO} AND count(DISTINCT rid) >= {line_dedup.MIN_PAGES}),
kept AS (
  SELECT s.rid, string_agg(s.line, chr(10) ORDER BY s.at) FILTER (b.line IS NULL) AS text,
         count(b.line)::INTEGER AS lines_removed
  FROM split_ s LEFT JOIN bad b ON s.host = b.host AND trim(s.line) = b.line GROUP BY s.rid)
SELECT p.page_id, p.host, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.lines_removed, 0)::INTEGER AS lines_removed
FROM pages_ p LEFT JOIN kept k ON p.rid = k.rid
"""

_OP9 = """
WITH turns AS (
  SELECT conv_id AS pair_id, turn, role, text, row_number() OVER () AS rid
  FROM conversations WHERE conv_id IS NOT NULL),
last AS (
  SELECT pair_id, turn AS at, coalesce(text, '') AS answer FROM turns WHERE role = 'assistant'
  QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC NULLS LAST, coalesce(text, '') DESC) = 1),
sides AS (
  SELECT pair_id, 'chosen' AS side, turn, role, coalesce(text, '') AS text FROM turns
  UNION ALL
  SELECT t.pair_id, 'rejected', t.turn, t.role,
         CASE WHEN t.role = 'assistant' AND t.turn IS NOT DISTINCT FROM o.at THEN n.answer
              ELSE coalesce(t.text, '') END
  FROM turns t LEFT JOIN last o ON t.pair_id = o.pair_id LEFT JOIN last n ON n.pair_id = xor(t.pair_id, 1)),
placed AS (
  SELECT pair_id, side, coalesce(role, 'unknown') AS role, text,
         row_number() OVER (PARTITION BY pair_id, side
                            ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), text) AS k
  FROM sides WHERE text IS NOT NULL),
sizes AS (
  SELECT pair_id, count(*) FILTER (side = 'chosen') AS c, count(*) FILTER (side = 'rejected') AS r
  FROM placed GROUP BY pair_id),
differs AS (
  SELECT c.pair_id, min(c.k) AS k FROM placed c JOIN placed r
    ON c.pair_id = r.pair_id AND c.k = r.k AND c.side = 'chosen' AND r.side = 'rejected'
  WHERE c.role <> r.role OR c.text <> r.text GROUP BY c.pair_id),
common AS (
  SELECT s.pair_id, CASE WHEN d.k IS NULL AND s.c = s.r AND s.c > 0 THEN s.c - 1
                         ELSE coalesce(d.k - 1, least(s.c, s.r)) END AS n
  FROM sizes s LEFT JOIN differs d ON s.pair_id = d.pair_id),
shown AS (
  SELECT p.*, c.n, '<|' || role || '|>' || chr(10) AS head, text || chr(10) || '<|end|>' || chr(10) AS body
  FROM placed p JOIN common c ON p.pair_id = c.pair_id),
ends AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, side ORDER BY k) AS stop
  FROM shown WHERE k > n)
SELECT c.pair_id, c.n::INTEGER AS common_turns,
  coalesce((SELECT string_agg(head || body, '' ORDER BY k) FROM shown s
            WHERE s.pair_id = c.pair_id AND side = 'chosen' AND k <= s.n), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY k) FILTER (side = 'chosen'), '') AS chosen_completion,
  (count(*) FILTER (side = 'chosen'))::INTEGER AS chosen_turns,
  coalesce(string_agg((stop - length(body))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY k)
           FILTER (side = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(head || body, '' ORDER BY k) FILTER (side = 'rejected'), '') AS rejected_completion,
  (count(*) FILTER (side = 'rejected'))::INTEGER AS rejected_turns,
  coalesce(string_agg((stop - length(body))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY k)
           FILTER (side = 'rejected' AND role = 'assistant'), '') AS rejected_mask
FROM common c LEFT JOIN ends e ON c.pair_id = e.pair_id GROUP BY c.pair_id, c.n
"""

_OP6 = f"""
WITH RECURSIVE usable AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.rid AS a, b.rid AS b FROM usable a JOIN usable b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {embedding_dedup.THRESHOLD}),
reached AS (SELECT rid, rid AS there FROM usable UNION SELECT r.rid, l.b FROM reached r JOIN links l ON l.a = r.there),
parts AS (SELECT r.rid, min(u.vec_id) AS component_id FROM reached r JOIN usable u ON u.rid = r.there GROUP BY r.rid),
degrees AS (SELECT a AS rid, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(p.component_id, e.vec_id) AS component_id,
       coalesce(e.vec_id = coalesce(p.component_id, e.vec_id), false) AS kept
FROM embeddings e LEFT JOIN usable u ON u.vec_id = e.vec_id LEFT JOIN parts p ON p.rid = u.rid LEFT JOIN degrees d ON d.rid = u.rid
"""

_LOWERED = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = f"regexp_extract_all({_LOWERED.format('text')}, {_sql(suffixes.WORDS)})"

_OP12 = f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS words
  FROM (SELECT item_id, w, least(len(w), {suffixes.WINDOW}) AS n,
               unnest(range(1, greatest(len(w) - {suffixes.WINDOW}, 0) + 2)) AS p FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
hits AS (
  SELECT t.rid, t.p, t.n, w.item_id
  FROM (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS words
        FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM texts JOIN sizes ON len(w) >= n)) t
  JOIN windows w ON w.n = t.n AND w.words = t.words),
hit_words AS (
  SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS place FROM hits) GROUP BY rid),
found AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit,
       coalesce(f.n_items, 0)::BIGINT AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM texts t LEFT JOIN hit_words h ON t.rid = h.rid LEFT JOIN found f ON t.rid = f.rid
"""


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, (
        "doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))) + ")"


_CRC32 = """xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                           lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _steps_sql(nodes: str) -> str:
    """The siblings before and after each node of a tree's runs."""
    run = f"PARTITION BY tree, level, pos // {merkle.FAN} ORDER BY pos"
    return f"""SELECT tree, level, pos,
      coalesce(string_agg(node, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || ':' ||
      coalesce(string_agg(node, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS step
      FROM {nodes} WHERE size > 1"""


def _grow_sql(name: str, leaves: str) -> str:
    return f"""{name}(tree, level, pos, size, node) AS (
  {leaves}
  UNION ALL
  SELECT tree, level + 1, pos // {merkle.FAN}, (size + {merkle.FAN - 1}) // {merkle.FAN},
         sha256(string_agg(node, '' ORDER BY pos)) FROM {name}
  WHERE size > 1 GROUP BY tree, level, pos // {merkle.FAN}, size)"""


_OP13 = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, {_leaf_sql('text')} AS leaf,
         CASE WHEN {_CRC32} % 5 = 0 THEN {_leaf_sql(_LOWERED.format('text'))} END AS tampered FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY tree) AS size FROM hashed),
{_grow_sql('low', 'SELECT tree, 0::BIGINT, pos::BIGINT, size::BIGINT, leaf FROM leaves')},
subroots AS (
  SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size FROM low WHERE size = 1),
{_grow_sql('top', "SELECT '', 0::BIGINT, pos::BIGINT, size::BIGINT, node FROM subroots")},
low_steps AS ({_steps_sql('low')}),
top_steps AS ({_steps_sql('top')}),
steps AS (
  SELECT l.tree, l.pos, s.level, s.step FROM leaves l JOIN low_steps s ON s.tree = l.tree AND s.pos = l.pos >> (4 * s.level)
  UNION ALL
  SELECT l.tree, l.pos, 1000 + s.level, s.step FROM leaves l JOIN subroots r ON r.tree = l.tree
  JOIN top_steps s ON s.pos = r.pos >> (4 * s.level)),
witnesses AS (SELECT tree, pos, list(step ORDER BY level) AS steps FROM steps GROUP BY tree, pos),
folded AS (
  SELECT l.*, coalesce(w.steps, []) AS steps,
         list_reduce(list_prepend(coalesce(l.tampered, l.leaf), coalesce(w.steps, [])),
                     lambda h, s: sha256(split_part(s, ':', 1) || h || split_part(s, ':', 2))) AS folded_root
  FROM leaves l LEFT JOIN witnesses w ON w.tree = l.tree AND w.pos = l.pos)
SELECT f.doc_id, f.leaf, r.node AS subroot, t.node AS root,
       sha256(replace(array_to_string(f.steps, ''), ':', '')) AS proof_sha256, f.folded_root,
       f.folded_root = t.node AS verified
FROM folded f JOIN subroots r ON r.tree = f.tree JOIN top t ON t.size = 1
"""

QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_cost_packing, op3_importance_resampling, op4_fingerprints, op5_weighted_near_dedup,
    op6_embedding_near_dedup, op7_pii_surrogates, op8_recursive_bpe, op9_preference_format,
    op10_site_lines, op11_token_alignment, op12_suffix_decontamination, op13_merkle_manifest)}
ORACLES = {"op6_embedding_near_dedup": _OP6, "op9_preference_format": _OP9, "op10_site_lines": _OP10, "op12_suffix_decontamination": _OP12,
           "op13_merkle_manifest": _OP13}
