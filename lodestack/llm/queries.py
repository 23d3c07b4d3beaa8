"""The registered query of each operator, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, decontam, html_text, imatch, lines, mixing, negatives, pii, quality, resample, simhash, tokens, toxicity
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _remainder(modulus: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_classes(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "toxic")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.quality_rules(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return tokens.read_tokens(spark, path)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(negatives.scaled(relabelled), F.col("id") % 100 == 0)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.with_edits(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_mix_sources": op2_mix_sources,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash": op6_simhash,
    "op7_pii": op7_pii,
    "op8_html_text": op8_html_text,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_token_output": op10_token_output,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_fingerprints": op13_fingerprints,
}

ORACLE: dict[str, str] = {
    "op2_mix_sources": r"""
WITH b AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
 -ln((CAST('0x' || substr(md5('17:' || doc_id), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / coalesce(greatest(length(translate(text, '#*$%&|<>', ''))::DOUBLE / nullif(length(text), 0), 0.05::DOUBLE), 1.0::DOUBLE) AS key FROM documents),
s AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM b GROUP BY source)),
r AS (SELECT *, 3.0::DOUBLE * source_size / w AS ratio FROM s),
k AS (SELECT ratio, sum(3 * source_size) OVER p AS capped, sum(w) OVER () - sum(w) OVER p AS open, lead(ratio) OVER (ORDER BY ratio, source) AS next FROM r WINDOW p AS (ORDER BY ratio, source ROWS UNBOUNDED PRECEDING)),
t AS (SELECT sum(source_size) AS total, sum(w) AS weight, min(ratio) AS low FROM r),
l AS (SELECT CASE WHEN total::DOUBLE / weight <= low THEN total::DOUBLE / weight ELSE (SELECT (total - capped)::DOUBLE / open FROM k WHERE open > 0 AND (total - capped)::DOUBLE / open <= next ORDER BY ratio LIMIT 1) END AS share FROM t),
g AS (SELECT source, source_size, least(w * share, 3.0::DOUBLE * source_size) AS target FROM r, l),
d AS (SELECT doc_id, size, source_size, target, floor(target / nullif(source_size, 0)) AS epochs, coalesce(sum(size) OVER (PARTITION BY b.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * (coalesce(epochs, 0) + CASE WHEN ahead + size / 2.0::DOUBLE <= target - coalesce(epochs, 0) * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM d""",
    "op1_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS m FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS k FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM b)),
ms AS (SELECT DISTINCT m FROM b),
dw AS (SELECT doc_id, p, m, array_to_string(w[p:p + m - 1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, ms WHERE len(w) >= m)),
o AS (SELECT doc_id, p, item_id, m FROM dw JOIN bw USING (m, k)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM o) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op11_hard_negatives": r"""
WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INTEGER) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
g AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM g JOIN p USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 5""",
    # crc32 by its table; the terms are distinct words
    "op12_importance_resampling": r"""
WITH RECURSIVE r AS (SELECT range AS n, range AS c, 0 AS k FROM range(256) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM r WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM r WHERE k = 8),
d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS g FROM benchmark),
f AS (SELECT row, unnest(w) AS g FROM d),
v AS (SELECT g, hex(encode(g)) AS h FROM (SELECT g FROM f UNION SELECT g FROM b)),
k AS (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || h[i:i + 1] AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM v, crc),
s AS (SELECT bucket, count(*) AS s FROM f JOIN k USING (g) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (g) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM f) AS sn, (SELECT count(*) FROM b) AS tn),
a AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sn + 10000)::DOUBLE / ((s + 1)::DOUBLE * (tn + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
w AS (SELECT row, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN k USING (g) JOIN a USING (bucket) GROUP BY row),
c AS (SELECT doc_id, CAST(len(d.w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w USING (row)),
o AS (SELECT *, n_features >= 20 AS fit FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY fit) AS m FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 10 * m // 100 THEN place END AS rank FROM p""",
}
