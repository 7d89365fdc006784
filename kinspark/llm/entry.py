"""Queries of the corpus operators, as the driver calls them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import linked

    return linked(_documents(spark, sf_dir))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import scored

    return scored(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import measure

    return measure(_documents(spark, sf_dir)).drop("rejected_by")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import evaluate

    return evaluate(_documents(spark, sf_dir))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_and_decode

    return encode_and_decode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lcp import compare

    return compare(_documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import removed

    return removed(_documents(spark, sf_dir))


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokenfile import write_and_read

    return write_and_read(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op11_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import sharded

    return sharded(_documents(spark, sf_dir), 8)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mined

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(_embeddings(spark, sf_dir).withColumn("label", label), F.col("vec_id") % 50 == 0)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import compressed

    return compressed(_embeddings(spark, sf_dir)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_quality_rules": op3_quality_rules,
        "op4_html_text": op4_html_text,
        "op5_language_id": op5_language_id,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_fingerprints": op8_fingerprints,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_token_file": op10_token_file,
        "op11_rendezvous_shards": op11_rendezvous_shards,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_vector_codes": op13_vector_codes,
    }


#: The verdict in the same terms as rules.RULES.
OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), c AS (
  SELECT *, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines
  FROM w
), g AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM c WHERE len(ws) >= 5)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1
), p AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
), f AS (
  SELECT c.*, coalesce(p.n_repeat_words, 0)::BIGINT AS n_repeat_words FROM c LEFT JOIN p USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words
            OR n_symbols * 10 > n_words
            OR len(list_filter(ws, lambda x: x LIKE '%!!')) * 10 > n_words * 3
            OR len(list_filter(ws, lambda x: x = upper(x) AND x <> lower(x) AND length(x) > 1)) * 2 > n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR length(regexp_replace(t, '[^\pL]+', '', 'g')) * 2 < word_chars
            OR len(list_distinct(ws)) * 10 < n_words AND len(list_distinct(ws)) * len(list_distinct(ws)) < 10 * n_words
            OR len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) * 10 > n_words * 3
            OR n_dup_lines * 2 > n_lines) AS kept
FROM f
"""


def _crc_table() -> str:
    """The table of the reflected polynomial 0xEDB88320, as a list."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return f"[{', '.join(map(str, out))}]::BIGINT[]"


#: -ln(u) / weight falls with u, so with equal weights the shard is that of the greatest draw.
OP11_SQL = f"""
WITH t AS MATERIALIZED (SELECT {_crc_table()} AS crc),
 k AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b,
   coalesce(doc_id::VARCHAR, 'text ' || md5(text), 'none') AS key FROM documents),
 c AS (SELECT doc_id, size, key, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(b, lambda x: ('0x' || x)::BIGINT)),
   lambda a, x: xor(a >> 8, t.crc[(xor(a & 255, x) + 1)::INT]))) AS text_crc32 FROM k, t),
 d AS (SELECT *, list_transform(range(0, 9), lambda s: {{'n': ('0x' || md5(key || '/' || s::VARCHAR)[1:13])::BIGINT, 's': -s}}) AS draws,
   ('0x' || md5('place ' || key || ' ' || text_crc32::VARCHAR || ' ' || size::VARCHAR)[1:13])::BIGINT AS place FROM c),
 s AS (SELECT *, (-list_max(draws[1:8]).s)::INTEGER AS shard, (-list_max(draws).s)::INTEGER AS grown_shard FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM s
"""

_WHOLE = "label_ok AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP12_SQL = f"""
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
   FROM (SELECT *, label IS NOT NULL AS label_ok FROM embeddings) WHERE {_WHOLE}),
 s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
   FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
 p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 3
"""


def _op13_sql() -> str:
    """Four rounds, one after another."""
    step = [f"""r AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM (SELECT *, true AS label_ok FROM embeddings) WHERE {_WHOLE}),
 x AS MATERIALIZED (SELECT vec_id, label, part, v[(part * 16 + 1):(part * 16 + 16)] AS v FROM r, (SELECT unnest(range(0, 4)) AS part)),
 b0 AS MATERIALIZED (SELECT part, entry, v FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM x) WHERE entry < 256)"""]
    for k in range(5):
        step.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, label, x.part, min(row(list_sum(list_transform(range(1, 17), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))), entry)) AS m, any_value(x.v) AS v
   FROM x JOIN b{k} b ON x.part = b.part GROUP BY vec_id, label, x.part)""")
        if k < 4:
            step.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT part, entry, list(s ORDER BY i) AS v FROM
   (SELECT part, m[2] AS entry, i, floor(sum(v[i]) / count(*)) AS s FROM a{k}, (SELECT unnest(range(1, 17)) AS i) GROUP BY ALL) GROUP BY ALL) n ON n.part = b.part AND n.entry = b.entry)""")
    return f"""
WITH {', '.join(step)},
 c AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(m[2])), 2, '0'), '' ORDER BY part) AS code, sum(m[1])::BIGINT AS error FROM a4 GROUP BY vec_id, label),
 h AS (SELECT sha256(string_agg(w::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(v) AS w, unnest(range(1, 17)) AS i FROM b4))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, h
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3_SQL, "op11_rendezvous_shards": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_vector_codes": _op13_sql()}
