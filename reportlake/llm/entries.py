"""Queries of the training-data operators, for the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship
from . import common


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import join

    return join(common.table(spark, sf_dir, "documents")).drop("th")


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_vectors import near

    return near(common.table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import dedup

    return dedup(common.table(spark, sf_dir, "documents"), digest=True)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(common.table(spark, sf_dir, "documents"))


def vocabulary(spark: SparkSession) -> str:
    """The public byte-level BPE file."""
    import public_tokenizers

    from .bpe import read_vocabulary

    return read_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(common.table(spark, sf_dir, "documents"), vocabulary(spark))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup

    kept = dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    return archive(common.table(spark, sf_dir, "pages"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_files

    return token_files(common.table(spark, sf_dir, "documents"), vocabulary(spark))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import rank

    return rank(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(common.table(spark, sf_dir, "embeddings"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(common.table(spark, sf_dir, "documents")).drop("copies")


def _shipped(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        common.few_rows_a_batch(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in (op1_suffix_dedup, op2_sharding, op3_bpe, op4_line_dedup, op5_warc, op6_ngram_join, op7_near_vectors, op8_toxicity, op9_tokens, op10_decontamination, op11_ranked_search, op12_whitening, op13_mixing)}

#: Base 32 of a hexadecimal SHA-1 in column h: four numbers of 40 bits, eight letters each.
BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {1 + 10 * part}, 10) AS bigint) >> {35 - 5 * k}) & 31 AS bigint) + 1, 1)" for part in range(4) for k in range(8)
)

ORACLE_SQL: dict[str, str] = {
    "op5_warc": f"""SELECT page_id, octet_length(encode(p)) AS payload_bytes, {BASE32} AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
  FROM (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages)""",
    "op6_ngram_join": """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
  g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g AS a JOIN g AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  l AS (SELECT x, y, c = nx.n AND c = ny.n AS same FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 5 * c >= 4 * (nx.n + ny.n - c)),
  t AS (SELECT doc_id, least(doc_id, coalesce(min(y), doc_id)) AS text_class FROM documents LEFT JOIN l ON x = doc_id AND same GROUP BY doc_id),
  r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
  h AS (SELECT x, min(y) AS head FROM r GROUP BY x),
  c AS (SELECT x, count(*) AS n_links, count(DISTINCT CASE WHEN NOT same THEN text_class END) AS n_text_links FROM l JOIN t ON t.doc_id = l.y GROUP BY x)
  SELECT t.doc_id, t.text_class, least(t.doc_id, coalesce(head, t.doc_id)) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_text_links, 0) AS n_text_links
  FROM t LEFT JOIN h ON h.x = t.doc_id LEFT JOIN c ON c.x = t.doc_id""",
    "op11_ranked_search": r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
  s AS (SELECT count(*) AS nn, sum(len(t))::BIGINT AS ll FROM d WHERE len(t) > 0),
  p AS (SELECT k, doc_id, n, t, count(*) AS tf FROM (SELECT k, doc_id, len(t) AS n, unnest(t) AS t FROM d) GROUP BY ALL),
  w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
  q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
  r AS (SELECT item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score FROM q JOIN p USING (t) JOIN w USING (t), s GROUP BY ALL)
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM r WHERE score > 0
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
    "op13_mixing": r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
  s AS (SELECT source, sum(size)::HUGEINT AS words, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::HUGEINT AS weight FROM d GROUP BY source),
  o AS (SELECT *, sum(words) OVER () AS total, coalesce(sum(words) OVER (ORDER BY words::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(weight) OVER (ORDER BY words::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s),
  c AS (SELECT *, weight * (3 * total - 4 * below) > 4 * words * open AS is_full FROM o),
  f AS (SELECT (3 * max(total) - 4 * coalesce(sum(words) FILTER (is_full), 0))::DOUBLE / 2 AS remaining, greatest(coalesce(sum(weight) FILTER (NOT is_full), 0), 1)::DOUBLE AS open FROM c),
  t AS (SELECT source, words, CASE WHEN is_full OR words = 0 THEN words::DOUBLE * 2 ELSE remaining * weight::DOUBLE / f.open END AS target FROM c, f),
  g AS (SELECT *, CASE WHEN words = 0 THEN 0 ELSE floor(target / words::DOUBLE)::BIGINT END AS copies FROM t),
  u AS (SELECT d.*, words, target, copies, target - (copies * words)::DOUBLE AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS c
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
  x AS (SELECT *, copies + CASE WHEN words > 0 AND (2 * c - size)::DOUBLE < 2 * rest THEN 1 ELSE 0 END AS copies_taken FROM u)
  SELECT doc_id, size::BIGINT AS size, words::BIGINT AS source_size, target, (size * copies_taken)::BIGINT AS taken FROM x""",
}
