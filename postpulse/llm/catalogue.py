"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm import (
    align,
    chat,
    forest,
    frames,
    infill,
    itq,
    lengths,
    mixing,
    packing,
    pii,
    secrets,
    simhash,
    toxicity,
)
from postpulse.llm.common import span_digest, spans_text, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return span_digest(found, secrets.BASE_KINDS)


def op2_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.cumulative(lengths.histogram(table(spark, sf_dir, "documents")))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = forest.neighbours(vectors, F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    by_field = spans_text(F.col("field_spans")).alias("field_spans")
    return span_digest(found, pii.BASE_KINDS, by_field)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op8_toxic_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.severity(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.encode_and_report(table(spark, sf_dir, "documents"))


def op10_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = itq.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"),
        "n_links",
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.arrange(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_report(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold the template's own control strings.
CONTROLS_INSIDE = """SELECT * FROM VALUES
  (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')
  AS t(conv_id, turn, role, text)"""


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = chat.read_back(chat.format_conversations(rows.union(spark.sql(CONTROLS_INSIDE))))
    turns = F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return found.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "media_tokens",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_token_lengths": op2_token_lengths,
        "op3_nearest_neighbours": op3_nearest_neighbours,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_simhash_groups": op5_simhash_groups,
        "op6_personal_data": op6_personal_data,
        "op7_source_mix": op7_source_mix,
        "op8_toxic_severity": op8_toxic_severity,
        "op9_token_files": op9_token_files,
        "op10_embedding_links": op10_embedding_links,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_token_alignment": op12_token_alignment,
        "op13_chat_formatting": op13_chat_formatting,
    }


#: All pairs, which is fine for a few hundred vectors and too slow for many.
OP10_SQL = """
WITH RECURSIVE numbered AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings),
usable AS (
  SELECT r, embedding::DOUBLE[] AS v FROM numbered
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b
  ON a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT r, r AS other FROM numbered
  UNION SELECT reach.r, l.b FROM reach JOIN links l ON l.a = reach.other)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.r) AS n_links, c.component_id,
  e.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM numbered e JOIN (SELECT reach.r, min(n.vec_id) AS component_id
  FROM reach JOIN numbered n ON n.r = reach.other GROUP BY 1) c USING (r)"""

OP11_SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
draws AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
        OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM texts),
cuts AS (SELECT *, least(x, y) AS low, greatest(x, y) AS high FROM draws),
parts AS (SELECT *, substring(t, 1, low) AS p, substring(t, low + 1, high - low) AS m, substring(t, high + 1) AS s
  FROM cuts)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN low END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts"""

#: Media links count as one private character while controls are looked for; each has its placeholder's length.
OP13_SQL = r"""
WITH every AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
texts AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''),
    '!\[[^\[\]\n]*\]\([^()\s#]+\.(?:png|jpe?g|gif|webp|mp3|wav|flac|ogg|pdf|docx?|pptx?)(?:#[^()\s]*)?\)') AS links
  FROM every),
marked AS (SELECT *, list_reduce(list_prepend(text, links), lambda t, link: replace(t, link, chr(57344))) AS plain,
    list_transform(links, lambda l: CASE WHEN regexp_matches(l, '\.(png|jpe?g|gif|webp)[)#]') THEN 'image'
      WHEN regexp_matches(l, '\.(mp3|wav|flac|ogg)[)#]') THEN 'audio' ELSE 'document' END) AS kinds FROM texts),
counted AS (SELECT *, length(plain) - len(links) + len(regexp_extract_all(role || chr(57344) || plain,
      '<\\*/?s>|\[\\*(?:/?INST|IMAGE|AUDIO|DOCUMENT)\]'))
    + coalesce(list_sum(list_transform(kinds, lambda k: length(k) + 2)), 0) + length(role) + 17 AS chars FROM marked)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  sum(len(links))::BIGINT AS n_attachments,
  coalesce(sum(list_sum(list_transform(kinds, lambda k: CASE k WHEN 'image' THEN 256 WHEN 'audio' THEN 750 ELSE 1000 END))), 0)::BIGINT
    AS media_tokens
FROM counted GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    """SQL where it gives a query's very rows; the others are tested by brute force."""
    return {
        "op10_embedding_links": OP10_SQL,
        "op11_fill_in_middle": OP11_SQL,
        "op13_chat_formatting": OP13_SQL,
    }
