"""The queries op1_ to op13_ over the driver's tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.llm import ann, decontaminate, fim, fingerprints, minhash_dedup, mixing, secrets, sharding, suffix_dedup, tokenbin, toxicity, vector_codes, warc
from tidepanel.session import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in the whole documents, scanned through a new ledger."""
    return secrets.document_secrets(_table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of the whole documents without the 200-byte strings that occur elsewhere."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of the whole documents with counts at most one apart, equal texts together."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=8)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of the whole documents, learnt from the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


#: the share of expected tokens that the mixture gives to each value of labels.quality
MIXTURE = {"1": 0.95, "0": 0.05}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the whole documents at which the expected tokens of the quality domains meet MIXTURE."""
    return mixing.mixture_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), MIXTURE)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as legacy archives, converted to WARC files and read back."""
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of the whole documents, read back."""
    import public_tokenizers

    return tokenbin.tokenize_to_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, vocabulary=49408)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the whole documents that copy a benchmark item."""
    return decontaminate.benchmark_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k fingerprints of the whole documents, of their edited texts, and their likeness."""
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of the whole documents at a Jaccard similarity of 85/100."""
    return minhash_dedup.near_duplicate_groups(_table(spark, sf_dir, "documents"), num=85, den=100)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents rearranged for filling in the middle, and the texts rebuilt from the outputs."""
    moved = fim.restore_texts(fim.fill_in_middle(_table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows of the whole embeddings found nearest to each whose id is divisible by 50."""
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of the whole embeddings, 16 parts of 64 entries each, after two rounds."""
    return vector_codes.coded_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_sharding": op3_sharding,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_warc": op6_warc,
    "op7_token_files": op7_token_files,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_vector_codes": op13_vector_codes,
}

SQL: dict[str, str] = {
    "op1_secret_scans": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
rules(kind, rank, pattern, grp, least) AS (VALUES
  ('assign', 0, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1, 12),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 18),
  ('hex', 2, '[0-9a-f]+', 0, 16)),
hits AS (
  SELECT doc_id, kind, rank, least, text,
    CASE rank WHEN 0 THEN string_split_regex(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') WHEN 1 THEN string_split_regex(text, 'AKIA[A-Z0-9]+') ELSE string_split_regex(text, '[0-9a-f]+') END AS gaps,
    CASE rank WHEN 0 THEN regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) WHEN 1 THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0) ELSE regexp_extract_all(text, '[0-9a-f]+', 0) END AS found,
    CASE rank WHEN 0 THEN regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) WHEN 1 THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0) ELSE regexp_extract_all(text, '[0-9a-f]+', 0) END AS vals
  FROM t, rules),
each AS (SELECT doc_id, kind, rank, least, unnest(gaps[:len(found)]) AS gap, unnest(found) AS hit, unnest(vals) AS val, generate_subscripts(found, 1) AS i FROM hits),
placed AS (SELECT doc_id, kind, rank, least, val, length(hit) AS n,
    sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM each),
spans AS (SELECT doc_id, kind, rank, (stop - n)::BIGINT AS start, stop::BIGINT AS stop FROM placed WHERE length(val) >= least),
docs AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN docs USING (doc_id)
""",
    "op11_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT *, len(units) AS n, [('0x' || substr(h, 1 + 8 * i, 8))::UBIGINT::BIGINT FOR i IN range(4)] AS h4 FROM t),
c AS (SELECT *, least(h4[1] % (n + 1), h4[2] % (n + 1)) AS a, greatest(h4[1] % (n + 1), h4[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h4[3] % 100 >= 90 THEN 'plain' WHEN h4[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(units[:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
""",
    "op12_nearest_neighbours": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) = len(list_filter(embedding, lambda x: isfinite(x))) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(r.v, r.v))) AS score FROM v q JOIN v r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER w AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
""",
    "op13_vector_codes": f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) > 0 AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))),
parts AS (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, (SELECT unnest(range(16)) AS p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < 64),
{",".join(f"""
a{r} AS (SELECT vec_id, label, p, x, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT * 64 + e) AS best FROM parts JOIN b{r} USING (p) GROUP BY ALL)""" + (f""",
m{r} AS (SELECT p, best % 64 AS e, i, floor(sum(x[i]) / count(*)) AS mean FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM parts))) AS i) GROUP BY ALL),
l{r} AS (SELECT p, e, list(mean ORDER BY i) AS mean FROM m{r} GROUP BY ALL),
b{r + 1} AS (SELECT p, e, coalesce(mean, c) AS c FROM b{r} LEFT JOIN l{r} USING (p, e))""" if r < 2 else "") for r in range(3))},
rows AS (SELECT vec_id, label, string_agg(format('{{:02x}}', (best % 64)::BIGINT), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY ALL),
book AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM rows, book
""",
}
