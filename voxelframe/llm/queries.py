"""The corpus operators as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embedding_dedup, filter_audit, language_id, line_dedup, ngram_join, packing, quality_ordinal, quality_rules, substring_dedup, toxicity, vector_codes, warc
from .shared import small_batches

#: Remainders of crc32(doc_id as text) that are held out of learning.
LANGUAGE_FOLD, LABEL_FOLD = "pmod(crc32(cast(doc_id as string)), 4) = 2", "pmod(crc32(cast(doc_id as string)), 5) = 0"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _held_out(result: DataFrame, fold: str) -> DataFrame:
    rest = [c for c in result.columns if c != "doc_id"]
    return result.select("doc_id", F.coalesce(F.expr(fold), F.lit(False)).alias("held_out"), *rest)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    net = language_id.fit(docs.where(f"not ({LANGUAGE_FOLD})"))
    return _held_out(language_id.predict(docs, net), LANGUAGE_FOLD)


def op2_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"), min_bytes=0)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), span=13)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 poor, 1 sound but toxic, 2 sound. Kept: P(grade >= 1) is a half or more."""
    docs = _read(spark, sf_dir, "documents")
    ratings = _read(spark, sf_dir, "labels").where(f"not ({LABEL_FOLD})").select("doc_id", F.expr("quality * (2 - toxic)").alias("label"))
    result = quality_ordinal.predict(docs, quality_ordinal.fit(docs, ratings), least=1)
    return _held_out(result, LABEL_FOLD).withColumn("kept", F.col("tail_probability") >= 0.5)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_read(spark, sf_dir, "documents"), capacity=2048)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    labels = _read(spark, sf_dir, "labels").where(f"not ({LABEL_FOLD})").select("doc_id", F.col("toxic").alias("label"))
    return _held_out(toxicity.predict(docs, toxicity.fit(docs, labels)), LABEL_FOLD)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_read(spark, sf_dir, "documents"), n=5, percent=80)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    result = line_dedup.line_dedup(docs.select("doc_id", "text"))
    return result.select("doc_id", F.col("n_removed_lines").cast("bigint").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), F.length("text").cast("bigint").alias("kept_chars"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=4, entries=256, rounds=4, scale=1024.0)


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY sha1(h)) AS lead FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(x, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = lead THEN NULL ELSE lead END AS refers_to
FROM d
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS k, unnest(range(1, len(w) - 11)) AS i
  FROM d WHERE len(w) >= 13),
f AS (SELECT k, min(doc_id) AS m FROM g GROUP BY k),
c AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS p FROM g JOIN f USING (k) WHERE f.m < g.doc_id),
w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT w.doc_id, count(c.p) AS n, string_agg(CASE WHEN c.p IS NULL THEN word END, ' ' ORDER BY w.p) AS kept
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id AND w.p = c.p GROUP BY w.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS k FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT o.a, o.b FROM o JOIN n x ON o.a = x.doc_id JOIN n y ON o.b = y.doc_id WHERE 100 * m >= 80 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.id)
SELECT c.id AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c.root) AS component_id FROM c LEFT JOIN n ON n.doc_id = c.id GROUP BY c.id
"""

#: Every variant of every distinct line that is long enough, joined without any filter before it; exact repeats of every line that is not blank.
OP9_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place, unnest(string_split(text, chr(10))) AS line FROM documents),
o AS (SELECT doc_id, place, line, doc_id * 10000000 + place AS ord FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT line, min(ord) AS ord FROM o GROUP BY line),
n AS (SELECT line, ord, unnest(range(0, length(line) + 1)) AS i FROM f WHERE length(line) >= 24),
v AS (SELECT line, ord, i, hash(CASE WHEN i = 0 THEN line ELSE left(line, (i - 1)::BIGINT) || substr(line, i + 1) END) AS x FROM n),
e AS (SELECT DISTINCT b.line FROM v a JOIN v b ON a.x = b.x AND a.ord < b.ord AND (a.i = b.i OR a.i = 0 OR b.i = 0)),
gone AS (SELECT o.doc_id, o.place FROM o JOIN f USING (line) LEFT JOIN e USING (line) WHERE o.ord > f.ord OR e.line IS NOT NULL),
k AS (SELECT l.doc_id, count(g.doc_id) AS n_removed, string_agg(CASE WHEN g.doc_id IS NULL THEN l.line END, chr(10) ORDER BY l.place) AS kept
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.place = g.place GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256,
  CASE WHEN d.text IS NOT NULL THEN length(coalesce(kept, ''))::BIGINT END AS kept_chars
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""

#: Every order by brute force over the counts of each part's masks.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY doc_id),
e AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  concat(CASE WHEN len(w) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END,
    CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN d.doc_id > e.least THEN 'E' END) AS failed
  FROM d JOIN e USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
x AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, failed),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT part, o, step, substr(o, step, 1) AS f, n, good, toxic, contains(failed, substr(o, step, 1)) AS fails, failed = substr(o, step, 1) AS alone,
    step > 1 AND regexp_matches(failed, '[' || left(o, step - 1) || '_]') AS gone FROM x, o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, o AS filter_order, step::INT AS step, f,
  coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost
  FROM s GROUP BY part, o, step, f)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""

#: Every pair.
OP12_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL
  AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c))) AND list_bool_or(list_transform(embedding, lambda c: c <> 0))),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
c AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.id),
m AS (SELECT id, min(root) AS component_id FROM c GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN m ON m.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


def _op13_sql(rounds: int = 4) -> str:
    """Every part against every entry, round by round; a table x of parts (vec_id, label, p, x) and books b0, b1, .. (p, e, x)."""
    part = "list_transform(v[(p * len(v)) // 4 + 1:((p + 1) * len(v)) // 4], lambda c: floor(1024 * c)::BIGINT)"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, p, min(d * 256 + e) % 256 AS e, min(d * 256 + e) // 256 AS d FROM
  (SELECT x.vec_id, x.p, b.e, list_sum(list_transform(list_zip(x.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b{k} b USING (p)) GROUP BY vec_id, p)""")
        if k < rounds:
            steps.append(f"""u{k} AS (SELECT p, e, i, floor(sum(c)::DOUBLE / count(*))::BIGINT AS c FROM
  (SELECT p, e, unnest(x.x) AS c, generate_subscripts(x.x, 1) AS i FROM a{k} JOIN x USING (vec_id, p)) GROUP BY p, e, i),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS x FROM u{k} GROUP BY p, e) n USING (p, e))""")
    return f"""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))),
x AS MATERIALIZED (SELECT vec_id, label, p, {part} AS x FROM v, (SELECT unnest(range(4)) AS p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM x WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256)),
{", ".join(steps)},
c AS (SELECT vec_id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT v.vec_id, code, error, (sum(error) OVER (PARTITION BY v.label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (vec_id), h
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_warc_normaliser, op3_substring_dedup, op4_benchmark_decontamination, op5_quality_classifier, op6_best_fit_packing, op7_toxicity, op8_ngram_jaccard, op9_line_dedup, op10_quality_rules, op11_filter_audit, op12_embedding_near_dedup, op13_vector_codes)
}
ORACLES: dict[str, str] = {"op2_warc_normaliser": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op8_ngram_jaccard": OP8_SQL, "op9_line_dedup": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_embedding_near_dedup": OP12_SQL, "op13_vector_codes": _op13_sql()}
