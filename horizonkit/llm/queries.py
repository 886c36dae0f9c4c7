"""The operators applied to whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horizonkit.llm import (ann, centroids, decontam, packing, quality, recipes, secrets, sharding, simhash, spelling, substring,
                            token_files, toxicity)
from horizonkit.llm.common import crc_fold
from horizonkit.session import scratch_path

#: Labels are learnt from rows whose id's checksum has another remainder than 0.
FOLDS = 5
THRESHOLD = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def learnable(labels: DataFrame, column: str) -> DataFrame:
    """``(id, y)`` of the rows that may be learnt from."""
    return labels.where(crc_fold(F.col("doc_id"), FOLDS) != 0).select(
        F.col("doc_id").cast("long").alias("id"), F.col(column).cast("int").alias("y"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, learnable(table(spark, sf_dir, "labels"), "quality"))
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
                         quality.keep_predicted(F.col("score"), THRESHOLD).alias("predicted"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and test item it contains; clean documents have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") > 0).select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", "leak.item_id", "leak.distance")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 100 == 0))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs)
    spans = F.col("secret_spans")
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] != "random")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
                        F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(spans).alias("spans"))


def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, learnable(table(spark, sf_dir, "labels"), "toxic"))
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
                         F.col("toxicity.insult").alias("p_insult"), F.col("toxicity.severe").alias("p_severe"),
                         F.col("toxicity.toxic").alias("score"), (F.col("toxicity.toxic") >= 0.5).cast("int").alias("predicted"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    parts = token_files.write_tokens(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, folder, parts).withColumnRenamed("id", "doc_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recipes.equal_texts(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return centroids.with_inertia(spark, assigned, found)


QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_simhash_near_dedup, op3_benchmark_decontamination, op4_sharding, op5_ann,
    op6_secret_scan, op7_sum_of_squares_packing, op8_toxicity, op9_token_files, op10_substring_dedup,
    op11_exact_dedup, op12_spelling_variants, op13_centroid_clustering)}

_OP4_SQL = r"""
WITH RECURSIVE nibbles AS (
  SELECT list_transform(range(16), lambda i: list_reduce([i] || [1, 2, 3, 4]::BIGINT[], lambda c, k:
         CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table
), bytes AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b
  FROM documents
), rows AS (
  SELECT doc_id, strlen(text)::BIGINT + 1 AS size,
         xor(list_reduce([4294967295::BIGINT] || b, lambda c, x:
           xor(xor(xor(c, x) >> 4, crc_table[(xor(c, x) & 15) + 1]) >> 4,
               crc_table[(xor(xor(c, x) >> 4, crc_table[(xor(c, x) & 15) + 1]) & 15) + 1])), 4294967295) AS text_crc32
  FROM bytes, nibbles
), sides AS (
  SELECT n, a, ((n + a - 1) // a)::BIGINT AS b
  FROM (SELECT count(*)::BIGINT AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM documents)
), walk AS (
  SELECT doc_id, size, text_crc32, n, a, b, 0 AS step,
         row_number() OVER (ORDER BY doc_id, size, text_crc32) - 1 AS x
  FROM rows, sides
  UNION ALL
  SELECT doc_id, size, text_crc32, n, a, b, step + 1,
         list_extract(list_reduce([[x // b, x % b], [0], [1], [2], [3], [4], [5]]::BIGINT[][], lambda s, i:
           CASE WHEN i[1] % 2 = 0
           THEN [(s[1] + ('0x' || substr(md5('7-' || i[1] || '-' || s[2]), 1, 12))::BIGINT) % a, s[2]]
           ELSE [s[1], (s[2] + ('0x' || substr(md5('7-' || i[1] || '-' || s[1]), 1, 12))::BIGINT) % b] END), 1) * b
         + list_extract(list_reduce([[x // b, x % b], [0], [1], [2], [3], [4], [5]]::BIGINT[][], lambda s, i:
           CASE WHEN i[1] % 2 = 0
           THEN [(s[1] + ('0x' || substr(md5('7-' || i[1] || '-' || s[2]), 1, 12))::BIGINT) % a, s[2]]
           ELSE [s[1], (s[2] + ('0x' || substr(md5('7-' || i[1] || '-' || s[1]), 1, 12))::BIGINT) % b] END), 2)
  FROM walk WHERE step = 0 OR x >= n
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % 16)::INTEGER AS shard, x // 16 AS slot, NULL::INTEGER AS grown_shard
FROM walk WHERE step > 0 AND x < n
"""

_OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), first AS (
  SELECT s, min(doc_id) AS m FROM windows GROUP BY s
), cut AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
  FROM (SELECT windows.doc_id, i FROM windows JOIN first USING (s) WHERE m < windows.doc_id)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM words ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


_OP11_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""

_OP12_SQL = r"""
WITH RECURSIVE nibbles AS (
  SELECT list_transform(range(16), lambda i: list_reduce([i] || [1, 2, 3, 4]::BIGINT[], lambda c, k:
         CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table
), runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[a-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL)
  WHERE length(run) >= 6 GROUP BY doc_id, run
), marked AS (
  SELECT run, n, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda h: ('0x' || h)::BIGINT),
           lambda c, x: xor(xor(xor(c, x) >> 4, crc_table[(xor(c, x) & 15) + 1]) >> 4,
             crc_table[(xor(xor(c, x) >> 4, crc_table[(xor(c, x) & 15) + 1]) & 15) + 1])), 4294967295) AS h
  FROM runs, nibbles
), words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM marked)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), shorter AS MATERIALIZED (
  SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS p FROM words)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n FROM shorter a JOIN shorter b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS best_n, arg_min(other, (-n, encode(other))) AS best FROM near GROUP BY word
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), walk AS (
  SELECT word, coalesce(form, word) AS root, form IS NULL AS done FROM forms
  UNION ALL
  SELECT k.word, coalesce(f.form, k.root), f.form IS NULL FROM walk k JOIN forms f ON k.root = f.word WHERE NOT done
)
SELECT f.word, f.form, k.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk k ON f.word = k.word AND k.done
"""


def _op13_sql(rounds: int = 5) -> str:
    """One pair of tables for each round: who is nearest, and where that moves the centroids."""
    of = """SELECT vec_id, x, c, d FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS place FROM (
    SELECT v.vec_id, v.x, m.c, (list_dot_product(v.x, v.x) + list_dot_product(m.x, m.x) - 2 * list_dot_product(v.x, m.x))::BIGINT AS d
    FROM kept v, c{r} m)) WHERE place = 1"""
    steps = "".join(f""", a{r} AS MATERIALIZED ({of.format(r=r)}
), c{r + 1} AS MATERIALIZED (
  SELECT m.c, coalesce(s.x, m.x) AS x FROM c{r} m LEFT JOIN (
    SELECT c, list(v ORDER BY i) AS x FROM (
      SELECT c, i, floor(sum(v) / count(*)) AS v FROM (SELECT c, unnest(x) AS v, unnest(range(64)) AS i FROM a{r}) GROUP BY c, i)
    GROUP BY c) s ON m.c = s.c
)""" for r in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda v: floor(v::DOUBLE * 256)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT x, sha256('2:' || vec_id) AS h FROM kept ORDER BY h LIMIT 40)
){steps}, a AS MATERIALIZED ({of.format(r=rounds)}
)
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(m.x, lambda v: v::BIGINT), ',')) AS centroid_sha256
FROM a JOIN c{rounds} m ON a.c = m.c
"""


ORACLES = {"op4_sharding": _OP4_SQL.strip(), "op10_substring_dedup": _OP10_SQL.strip(), "op11_exact_dedup": _OP11_SQL.strip(),
           "op12_spelling_variants": _OP12_SQL.strip(), "op13_centroid_clustering": _op13_sql().strip()}
