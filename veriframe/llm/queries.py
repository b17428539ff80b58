"""One query for each operator of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, embedding_dedup, jaccard_join, language_id, packing, periodic_runs, pitman_yor, quality_cnn, quality_rules, sharding, substring_dedup, token_counts, whitening
from .common import bucket_of, shared_dir, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), byte_bpe.PIECES, capacity=2048, end_id=0)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"), min_words=50, width=5, percent=80)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85).select("doc_id", "n_shingles", "component_id", "class_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = token_counts.zipf_scores(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), scores)


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = bucket_of("doc_id", 5) == 1
    scores = pitman_yor.score(docs, pitman_yor.fit(docs.where(~held_out)), drop_model=True)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: Appends of the query below: more than two tiers can hold without a run to merge.
ARRIVALS = 8


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table comes in eight arrivals by a hash of the id, each appended as small shards, then compacted."""
    store = sharding.ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", shard_rows=1000)
    docs = table(spark, sf_dir, "documents")
    for k in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
    store.compact()
    store.vacuum()
    return store.places("doc_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", bucket_of("doc_id", 4) == 2)
    model = language_id.fit(language_id.sample(docs.where(~docs.held_out), sample_docs=300), order=4)
    held_out = (bucket_of("doc_id", 4) == 2).alias("held_out")
    return language_id.predict(docs, model).select("doc_id", held_out, "lang_pred", "score")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), byte_bpe.PIECES)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(bucket_of("doc_id", 3) != 1).select("doc_id", F.col("quality").alias("label"))
    scores = quality_cnn.score(docs, quality_cnn.fit(quality_cnn.sample(docs, labels, sample_docs=400)))
    return scores.select("doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"), components=32)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.judge(table(spark, sf_dir, "documents"), min_words=6, repeats=4, plant=True).drop("runs", "collapsed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_substring_dedup,
        op3_ngram_jaccard,
        op4_token_counts,
        op5_pitman_yor,
        op6_sharding,
        op7_language_id,
        op8_embedding_dedup,
        op9_byte_bpe,
        op10_quality_rules,
        op11_quality_classifier,
        op12_whitening,
        op13_periodic_runs,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard": rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS k FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, links.y FROM r JOIN links ON links.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(min(d.doc_id) OVER (PARTITION BY n.k, CASE WHEN n.k IS NULL THEN d.doc_id END), d.doc_id) AS class_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id""",
    "op8_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, links.y FROM r JOIN links ON links.x = r.y)
SELECT vec_id, coalesce(l.n, 0) AS n_links, component_id, vec_id = component_id AS kept, min(vec_id) OVER (PARTITION BY e) AS class_id
FROM v JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = vec_id LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) l ON l.x = vec_id""",
    "op10_quality_rules": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words FROM d LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 100 * n_dup_lines > 40 * n_lines
    OR 100 * len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) < 70 * n_words OR 100 * len(regexp_extract_all(t, '\p{{Lu}}')) > 40 * len(regexp_extract_all(t, '\p{{L}}'))) AS kept FROM b""",
}
