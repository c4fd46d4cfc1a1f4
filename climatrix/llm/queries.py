"""Registered queries of the training-data operators: ``opN_<name>``.

Each applies its operator with production parameters to its whole table and
derives the columns of its contract from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from climatrix.llm import audit, centroids, compression, decontaminate, hyperminhash, katz, kdtree, licenses, packing, quality, sanitise, simhash, substrings
from climatrix.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    out = licenses.license_scan(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "found")), ",").alias("labels"), "score",
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 20-word windows that start earlier."""
    out = substrings.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and compression verdict of every document."""
    out = compression.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "zstd_ratio")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces packed into sequences of 2,048."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient-boosted quality score of every document."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near copies of every document: four-word shingles, similarity of 0.8 or more."""
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 13-word windows of benchmark items."""
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op8_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every document."""
    out = sanitise.personal_data(table(spark, sf_dir, "documents"))
    kinds = F.array(*(F.lit(k) for k in sanitise.KINDS))

    def joined(column: str):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    counts = [F.expr(f"size(filter(spans, x -> x.kind = {k}))").cast("long").alias(f"n_{kind}") for k, kind in enumerate(sanitise.KINDS[:4])]
    return out.select("doc_id", *counts, F.sha2(joined("spans").cast("binary"), 256).alias("base_sha256"), joined("all_spans").alias("spans"))


def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under a Katz bigram model of the training fold."""
    return katz.language_model_scores(table(spark, sf_dir, "documents"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of nearly equal bytes."""
    out = kdtree.shard(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every source, in all of their orders."""
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after ten rounds from eight seeds."""
    out = centroids.clustered(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint of every document and of its edited text, and the documents near every fiftieth id."""
    return simhash.document_fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_substring_dedup,
        op3_compression_bands,
        op4_packing,
        op5_quality_classifier,
        op6_near_duplicates,
        op7_decontamination,
        op8_sanitisation,
        op9_katz_backoff,
        op10_kd_shards,
        op11_filter_audit,
        op12_centroid_clustering,
        op13_fingerprints,
    )
}

#: DuckDB twins, where SQL can express the query on whole tables in reasonable time.
_ALNUM = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
)


def _rounds_sql(k: int, rounds: int, dims: int) -> str:
    """Lloyd rounds, one block of CTEs each: centroids c0, c1, ... and the vectors' distances a0, a1, ..."""
    parts = [
        f"""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS k, v AS c FROM v ORDER BY k LIMIT {k})"""
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v, k, far FROM (
    SELECT vec_id, v, k, CAST(list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT) AS far FROM v, c{r})
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY far, k) = 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.k, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS c
    FROM (SELECT k, d, sum(v[d]) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(d) GROUP BY k, d) GROUP BY k) m ON m.k = c{r}.k)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a{rounds}.k AS INT) AS cluster, far AS distance, CAST(sum(far) OVER (PARTITION BY a{rounds}.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(far) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON a{rounds}.k = c{rounds}.k"""


SQL: dict[str, str] = {
    "op7_decontamination": f"""
WITH dw AS MATERIALIZED (SELECT doc_id, {_ALNUM} AS w FROM documents),
iw AS (SELECT item_id, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, len, array_to_string(w[i + 1:i + len], ' ') AS p
  FROM (SELECT item_id, w, least(len(w), 13) AS len, unnest(range(0, len(w) - least(len(w), 13) + 1)) AS i FROM iw WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, i, len, array_to_string(w[i + 1:i + len], ' ') AS p
  FROM (SELECT doc_id, w, len, unnest(range(0, len(w) - len + 1)) AS i
        FROM dw JOIN (SELECT DISTINCT len FROM win) l ON len(dw.w) >= l.len)),
hit AS MATERIALIZED (SELECT g.doc_id, g.i, g.len, win.item_id FROM grams g JOIN win ON g.p = win.p AND g.len = win.len),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len)) AS q FROM hit) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN words ON dw.doc_id = words.doc_id LEFT JOIN ids ON dw.doc_id = ids.doc_id""",
    "op11_filter_audit": """
WITH t AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
flags AS (
  SELECT doc_id, part, CAST(len(w) < 200 AS INT) AS a, CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) AS b,
    CAST(100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x) AS INT) AS c, CAST(regexp_matches(x, '[#$%&*|]') AS INT) AS d,
    coalesce(CAST(doc_id > min(doc_id) OVER (PARTITION BY x) AS INT), 0) AS e FROM t),
failed AS MATERIALIZED (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS f, a + b + c + d + e AS k, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM flags LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order FROM letter p, letter q, letter r, letter s, letter t
  WHERE len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5),
steps AS (
  SELECT filter_order, step, CAST(pow(2, instr('ABCDE', filter_order[step]) - 1) AS INT) AS bit,
    CAST(list_sum(list_transform(range(1, step), lambda i: pow(2, instr('ABCDE', filter_order[i]) - 1))) AS INT) AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
tried AS (SELECT *, f & bit <> 0 AS fails, f & coalesce(earlier, 0) <> 0 AS gone FROM failed, steps)
SELECT part, filter_order, CAST(step AS INT) AS step,
  CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (f = bit), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // greatest(k, 1)) FILTER (fails), 0) AS BIGINT) AS shapley
FROM tried GROUP BY part, filter_order, step""",
    "op12_centroid_clustering": _rounds_sql(centroids.K, centroids.ROUNDS, centroids.DIMS),
}
