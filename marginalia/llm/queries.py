"""The registered corpus queries: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import audio, bpe, html_text, langid, license_scan, packing, quality, simhash, topk, warc
from marginalia.runtime import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents", spread=True))


def op2_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings", spread=True), F.col("vec_id") % 50 == 0)


def op3_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", spread=True))


def op4_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_digest(table(spark, sf_dir, "documents", spread=True))


def op5_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents", spread=True), quality.held_out(5, 0)
    forest = quality.fit(docs, table(spark, sf_dir, "labels"), learn=~out)
    scored = quality.classify(docs, forest)
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


def op6_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents", spread=True))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages", spread=True))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents", spread=True))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents", spread=True))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents", spread=True), langid.held_out(3, 1)
    model = langid.fit(docs, learn=~out)
    return langid.identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_block_top_k": op2_block_top_k,
    "op3_html_layout": op3_html_layout,
    "op4_audio_features": op4_audio_features,
    "op5_quality_trees": op5_quality_trees,
    "op6_word_bpe": op6_word_bpe,
    "op7_warc_round_trip": op7_warc_round_trip,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_simhash_pigeonring": op9_simhash_pigeonring,
    "op10_language_spans": op10_language_spans,
}

#: Base32 of a SHA-1, five hexadecimal digits to four letters.
_BASE32 = """array_to_string(list_transform(range(8), lambda i: list_reduce(list_transform([15, 10, 5, 0], lambda s:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr({hex}, CAST(1 + 5 * i AS INT), 5) AS BIGINT) >> s) & 31), 1)), lambda a, b: a || b)), '')"""

_PLACES = " || ".join(
    f"list_filter(generate_series(0, len(w) - {len(p.split())}), lambda i: w[i + 1 : i + {len(p.split())}] = [{', '.join(repr(x) for x in p.split())}])" for p in license_scan.PHRASES
)
_NOTICES = ", ".join(f"{{'label': {t.label!r}, 'tokens': {sorted(set(t.tokens()))!r}, 'required': {list(t.required)!r}::VARCHAR[]}}" for t in license_scan.TEMPLATES)

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": f"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
split AS (SELECT doc_id, t, regexp_extract_all(t, '{license_scan.WORD}') AS w FROM low),
base AS (SELECT doc_id, len(w) AS n_words, {_PLACES} AS places, ' ' || array_to_string(w, ' ') || ' ' AS spaced FROM split),
labelled AS (SELECT *, [x.label for x in [{', '.join(f"{{'phrase': {p!r}, 'label': {label!r}}}" for p, label in license_scan.PHRASES.items())}] if contains(spaced, ' ' || x.phrase || ' ')] AS base FROM base),
notices AS (SELECT unnest([{_NOTICES}], recursive := true)),
pairs AS (SELECT doc_id, unnest(generate_series(0, len(w) - 2)) AS pos, w FROM split),
tokens AS (SELECT doc_id, pos // {license_scan.STEP} AS part, w[pos + 1] || ' ' || w[pos + 2] AS token FROM pairs WHERE w[pos + 1] || ' ' || w[pos + 2] IN (SELECT unnest(tokens) FROM notices)
  UNION ALL SELECT doc_id, pos // {license_scan.STEP}, array_to_string(w[pos + 1 : pos + 4], ' ') FROM pairs WHERE array_to_string(w[pos + 1 : pos + 4], ' ') IN (SELECT unnest(required) FROM notices)),
blocks AS (SELECT doc_id, block, list(DISTINCT token) AS b FROM (SELECT doc_id, part AS block, token FROM tokens UNION ALL SELECT doc_id, part - 1, token FROM tokens WHERE part > 0) GROUP BY doc_id, block),
found AS (SELECT doc_id, label, len(list_intersect(b, tokens)) / len(tokens) AS score FROM blocks, notices
  WHERE len(list_intersect(b, tokens)) >= ceil({license_scan.THRESHOLD} * len(tokens) - 1e-9) AND list_has_all(b, required)),
best AS (SELECT doc_id, list(DISTINCT label) AS found, max(score) AS best FROM found GROUP BY doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || coalesce(found, []))), ',') AS labels,
  greatest(CASE WHEN len(places) > 0 THEN 1.0 ELSE 0.0 END, coalesce(best, 0.0))::DOUBLE AS score
FROM labelled LEFT JOIN best USING (doc_id)
""",
    "op2_block_top_k": """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS t FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.t, d.t), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
""",
    "op7_warc_round_trip": f"""
WITH payload AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
best AS (SELECT html, max(page_id) AS response FROM payload GROUP BY html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32.format(hex="hex")} AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM payload JOIN best USING (html)
""",
}
