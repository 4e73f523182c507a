"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantalog.llm import bpe, exact_dedup, filter_audit, html_text, language_id, mixing, packing, simhash, source_divergence, substring_dedup, suffix_dedup, token_counts, topk
from quantalog.llm.shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than 512 tokens), fitting_bytes (of the longest prefix within 512), from the stored prefix table."""
    prefixes = token_counts.prefix_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(token_counts.BYTE_50K))
    rows = token_counts.budget_answers(written(prefixes, "prefixes", compression="zstd"), budgets=(512,))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), F.col("cut_bytes")[0].alias("fitting_bytes"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = public_tokenizers.path(bpe.MULTI_50K)
    rows = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), match=400, keep="none")
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source."""
    rows = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(token_counts.BYTE_50K), with_ids=False)
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"), most=2, shingle=3)
    return rows.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


OP5_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document and every page: doc_id or page_id, language, posterior, text_language, kept.

    Documents are judged by their text and the prior of their source. Pages are judged by their visible text, the language
    of their html tag, and their address. The text model is fitted on labelled documents.
    """
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    own = language_id.identify(docs, model, host_col="source")
    pages = table(spark, sf_dir, "pages")
    marked = F.regexp_extract("html", r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    visible = html_text.extract_text(pages, carry=("url", "html")).withColumn("declared", marked)
    of_pages = language_id.identify(visible, model, id_col="page_id", declared_col="declared", url_col="url")
    columns = ("language", "posterior", "text_language", "kept")
    return own.select("doc_id", F.lit(None).cast("long").alias("page_id"), *columns).unionByName(of_pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", *columns))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, text, n_chars, n_lines."""
    rows = html_text.extract_text(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    rows = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank."""
    return source_divergence.divergence(table(spark, sf_dir, "documents"), min_docs=30, top=50)


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
v AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
f AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER grp + 5 * count(*) OVER grp) AS p FROM f WINDOW grp AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, sum(n) AS n FROM f GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER grp + 5 * count(*) OVER grp) AS q FROM l WINDOW grp AS (PARTITION BY lang)),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS v FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.v, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT p.lang, source, 'term', p.term, CAST(p.p - q.q AS BIGINT) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM n WHERE part = 'pair' OR rank <= 50
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return filter_audit.interactions(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN lab USING (doc_id)
), c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
o(filter_order, step, bit, earlier) AS (
  SELECT '', 0, 0, 0 UNION ALL
  SELECT filter_order || f, step + 1, b, earlier | bit FROM o, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(f, b) WHERE (earlier | bit) & b = 0
), s AS (SELECT e.filter_order, o.step, o.bit, o.earlier FROM o JOIN o e ON e.step = 5 AND starts_with(e.filter_order, o.filter_order) WHERE o.step > 0),
r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit,
    CAST(sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT * EXCLUDE (bit), CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies."""
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), most=2).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS n, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, sum(n) OVER () AS total, coalesce(sum(n) OVER before, 0) AS less, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest FROM s
  WINDOW before AS (ORDER BY n * (6 // w), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, w * (3 * total - 4 * less) > 4 * n * rest AS stops FROM o),
b AS (SELECT *, 3 * total - 4 * coalesce(sum(n) FILTER (stops) OVER (), 0) AS remaining, coalesce(sum(w) FILTER (NOT stops) OVER (), 0) AS weights FROM a),
t AS (
  SELECT source, n, CASE WHEN stops THEN CAST(2 * n AS DOUBLE) ELSE CAST(w * remaining AS DOUBLE) / CAST(2 * weights AS DOUBLE) END AS target,
    CASE WHEN n = 0 THEN 0 WHEN stops THEN 2 ELSE w * remaining END::HUGEINT AS copies, CASE WHEN n = 0 OR stops THEN 1 ELSE n * 2 * weights END::HUGEINT AS parts,
    CAST('0x' || substr(sha256('mix' || coalesce('/' || source, '')), 1, 8) AS BIGINT) AS h FROM b
), k AS (
  SELECT doc_id, d.source, size, n, target, copies, parts, (parts * h) // 4294967296 AS start, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST)::HUGEINT AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (SELECT *, CAST((k * copies + start) // parts - ((k - 1) * copies + start) // parts AS INTEGER) AS c FROM k)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target, size * c AS taken, source, c AS copies FROM e
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_exact_dedup, op3_simhash, op4_byte_bpe, op5_top_k, op6_suffix_dedup, op7_packing, op8_language_id, op9_html_text, op10_substring_dedup, op11_source_divergence, op12_filter_audit, op13_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op5_top_k": OP5_SQL, "op11_source_divergence": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_mixing": OP13_SQL}
