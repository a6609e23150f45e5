"""The queries of the numbered operators, with production parameters, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from valprint.llm import backoff_language, binary_pieces, noisy_or
from valprint.llm.best_fit import pack
from valprint.llm.collocations import top_collocations
from valprint.llm.differencing import byte_shards
from valprint.llm.gray_index import simhash_components
from valprint.llm.perspectives import segments
from valprint.llm.rank_merge import token_counts
from valprint.llm.shared import table
from valprint.llm.simple8b import packed_ids
from valprint.llm.template_leaks import leaks
from valprint.llm.threshold_search import top_k
from valprint.llm.tiled_covariance import whitened

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def llm_query(name: str, oracle: str | None = None):
    def add(f):
        LLM_QUERIES[name] = f
        if oracle is not None:
            LLM_ORACLES[name] = oracle
        return f

    return add


@llm_query("op1_template_leaks")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@llm_query(
    "op2_threshold_top_k",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v, row_number() OVER () AS n FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
    ), r AS (
      SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


@llm_query("op3_backoff_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return backoff_language.identify(docs, backoff_language.learn(docs))


@llm_query(
    "op4_perspectives",
    """
    WITH r AS (
      SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, regexp_replace(coalesce(text, ''), '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS text FROM conversations
    ), p AS (
      SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE speaker <> 'system'
    ), j AS (
      SELECT r.*, p.perspective,
        CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
        CASE WHEN speaker <> perspective AND speaker <> 'system' THEN speaker END AS name
      FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id
    ), h AS (
      SELECT *, '<|im_start|>' || role || CASE WHEN name IS NULL THEN '' ELSE ' name=' || regexp_replace(regexp_replace(name, '<(\\\\*)\\|', '<\\\\\\1|', 'g'), '[\\r\\n]+', ' ', 'g') END || chr(10) AS head FROM j
    ), s AS (
      SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h
    ), t AS (
      SELECT *, coalesce(sum(length(segment)) OVER (
        PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM s
    )
    SELECT conv_id, perspective, turn, role, name, segment, start,
      CASE WHEN role = 'assistant' THEN start + length(head) END AS mask_start,
      CASE WHEN role = 'assistant' THEN start + length(segment) - 1 END AS mask_end
    FROM t
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(table(spark, sf_dir, "conversations"))


@llm_query("op5_rank_merge_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


@llm_query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@llm_query("op7_gray_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


@llm_query("op8_noisy_or_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return noisy_or.score(docs, noisy_or.learn(docs, table(spark, sf_dir, "labels")))


@llm_query("op9_differencing_shards")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(table(spark, sf_dir, "documents"))


@llm_query("op10_simple8b_ids")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids(table(spark, sf_dir, "documents"))


@llm_query("op11_binary_pieces")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_pieces.pack(table(spark, sf_dir, "documents"))


@llm_query("op12_tiled_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


@llm_query(
    "op13_hashed_collocations",
    """
    WITH t AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) AS piece FROM documents
    ), w AS (
      SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM t
    ), n AS (
      SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
    ), g AS (
      SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 6)) AS size)
    ), f AS (
      SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100
    ), c AS (
      SELECT lang, size, phrase, f AS a, unnest(range(1, size)) AS k FROM f WHERE size > 1
    ), h AS (
      SELECT *, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lp, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rp FROM c
    ), s AS (
      SELECT h.lang, h.size, h.phrase, h.a, x.f AS l, y.f AS r, n.n, ((1000 * h.a::HUGEINT * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score, h.k
      FROM h JOIN f x ON x.lang = h.lang AND x.phrase = h.lp JOIN f y ON y.lang = h.lang AND y.phrase = h.rp JOIN n ON n.lang = h.lang
    ), m AS (
      SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s
    ), u AS (
      SELECT * FROM m WHERE cut = 1 AND NOT EXISTS (
        SELECT 1 FROM f b WHERE b.lang = m.lang AND b.size > m.size AND b.f >= m.a AND contains(' ' || b.phrase || ' ', ' ' || m.phrase || ' '))
    ), o AS (
      SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM u
    )
    SELECT * FROM o WHERE rank <= 2000
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_collocations(table(spark, sf_dir, "documents"))
