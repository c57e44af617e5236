"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, embedding_dedup, html_text, jaccard_join, phrases, pieces, pii, quality, sharding, substring_dedup, tokenfile, toxicity
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))
    terms = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string")))
    both = F.array_compact(F.array(F.nullif("base_spans", F.lit("")), F.nullif(F.array_join(terms, ","), F.lit(""))))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2("base_spans", 256).alias("base_sha256"),
        F.array_join(both, ",").alias("spans"),
        F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"),
    )  # fmt: skip


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths, files = tokenfile.write(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return tokenfile.read(files, lengths).withColumnRenamed("d_id", "doc_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Containment of each item's distinct shingles in each document, counted plainly.
OP6_SQL = r"""
WITH texts AS (
  SELECT 0 AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), split AS (
  SELECT kind, id, regexp_extract_all(t, '[^ 	-
]+') AS w FROM texts
), placed AS (
  SELECT kind, id, unnest(w) AS x, generate_subscripts(w, 1) AS p, len(w) AS n FROM split
), one AS (
  SELECT DISTINCT kind, id, s FROM (
    SELECT kind, id, p, n, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS s
    FROM placed WINDOW o AS (PARTITION BY kind, id ORDER BY p)
  ) WHERE p = 1 OR p <= n - 4
), items AS (
  SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n FROM one WHERE kind = 1
)
SELECT one.id AS doc_id, item_id, any_value(n) AS n_item_shingles, count(*) AS n_shared, count(*)::DOUBLE / any_value(n) AS containment
FROM one JOIN items USING (s) WHERE kind = 0
GROUP BY 1, 2 HAVING count(*) >= 0.8 * any_value(n)
"""


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = jaccard_join.join(table(spark, sf_dir, "documents"), n=4, percent=85)
    return rows.withColumnRenamed("d", "doc_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit_field(docs, table(spark, sf_dir, "labels")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


#: All pairs of usable vectors by cosine, and a walk along the links.
OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS root, vec_id AS x FROM embeddings UNION SELECT reach.root, p.y FROM reach JOIN p ON p.x = reach.x
), c AS (
  SELECT x AS vec_id, min(root) AS component_id FROM reach GROUP BY 1
), n AS (
  SELECT x AS vec_id, count(*) AS n_links FROM p GROUP BY 1
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


#: Phrases counted plainly, all cuts in 128-bit integers.
OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p0 AS (
  SELECT i, lang, regexp_split_to_array(t, '[.,;:!?

]') AS ps FROM d
), p AS (
  SELECT i, lang, generate_subscripts(ps, 1) AS j, regexp_extract_all(unnest(ps), '[^ 	]+') AS w FROM p0
), o AS (
  SELECT lang, i, j, generate_subscripts(w, 1) AS k, unnest(w) AS x FROM p
), q AS (
  SELECT lang, x, lead(x) OVER s AS y, lead(x, 2) OVER s AS z FROM o WINDOW s AS (PARTITION BY i, j ORDER BY k)
), f1 AS (SELECT lang, x, count(*)::HUGEINT AS c FROM q GROUP BY 1, 2),
f2 AS (SELECT lang, x, y, count(*)::HUGEINT AS c FROM q WHERE y IS NOT NULL GROUP BY 1, 2, 3),
f3 AS (SELECT lang, x, y, z, count(*)::HUGEINT AS c FROM q WHERE z IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
longer AS (SELECT lang, x, y, max(c) AS m FROM (SELECT lang, x, y, c FROM f3 UNION ALL SELECT lang, y, z, c FROM f3) GROUP BY 1, 2, 3),
n AS (SELECT lang, count(*) AS n FROM q GROUP BY 1),
two AS (
  SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.c AS a, l.c AS l, r.c AS r, 1000000 * f2.c * f2.c // (l.c * r.c) AS score
  FROM f2 JOIN f1 l ON l.lang = f2.lang AND l.x = f2.x JOIN f1 r ON r.lang = f2.lang AND r.x = f2.y
  LEFT JOIN longer ON longer.lang = f2.lang AND longer.x = f2.x AND longer.y = f2.y
  WHERE f2.c >= 10 AND NOT coalesce(100 * m >= 50 * f2.c, false)
), three0 AS (
  SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z AS phrase, f3.c AS a, l1.c AS l1, r1.c AS r1, l2.c AS l2, r2.c AS r2,
    1000000 * f3.c * f3.c // (l1.c * r1.c) AS s1, 1000000 * f3.c * f3.c // (l2.c * r2.c) AS s2
  FROM f3 JOIN f1 l1 ON l1.lang = f3.lang AND l1.x = f3.x JOIN f2 r1 ON r1.lang = f3.lang AND r1.x = f3.y AND r1.y = f3.z
  JOIN f2 l2 ON l2.lang = f3.lang AND l2.x = f3.x AND l2.y = f3.y JOIN f1 r2 ON r2.lang = f3.lang AND r2.x = f3.z
), every AS (
  SELECT * FROM two UNION ALL
  SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM three0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM every
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_sentencepiece": op3_sentencepiece,
        "op5_token_file": op5_token_file,
        "op4_html_text": op4_html_text,
        "op6_decontamination": op6_decontamination,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op8_toxicity": op8_toxicity,
        "op9_sharding": op9_sharding,
        "op10_quality_rules": op10_quality_rules,
        "op11_alignment": op11_alignment,
        "op12_embedding_dedup": op12_embedding_dedup,
        "op13_phrases": op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_decontamination": OP6_SQL,
        "op12_embedding_dedup": OP12_SQL,
        "op13_phrases": OP13_SQL,
    }
