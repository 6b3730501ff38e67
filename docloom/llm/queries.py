"""The thin queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, html, itq, license, mixing, packing, rollup, topk, toxicity
from .minhash import near_duplicates
from .shared import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_mixture_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer(), end_id=1, length=2048)


def op4_template_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


#: Files of the tokenizers whose counts op5 keeps; their names are the rollup's versions.
_VERSIONS = ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken")


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after five batches: both tokenizers' counts of all documents come in,

    documents that repeat a text but for that of the smallest doc_id go out, the
    second tokenizer's counts are revised to hold a document's end token, and
    the deletes are sent once more.
    """
    import public_tokenizers

    scratch = Scratch(spark, "rollup")
    paths = [public_tokenizers.path(v) for v in _VERSIONS]
    one, two = (v.split(".")[0] for v in _VERSIONS)
    docs = scratch.save(rollup.counted(_table(spark, sf_dir, "documents"), paths))
    groups = scratch.save(rollup.copies(docs))
    out = rollup.TokenRollup(spark, f"{scratch.root}/state")
    deletes = [rollup.signed(groups, -F.col("again"), F.col("tokens")[i], v) for i, v in enumerate((one, two))]
    deletes = deletes[0].unionByName(deletes[1])
    out.commit("first", rollup.signed(docs, F.lit(1), F.col("tokens")[0], one))
    out.commit("second", rollup.signed(docs, F.lit(1), F.col("tokens")[1], two))
    out.commit("copies", deletes)
    out.commit("second-revised", rollup.revised(groups, F.col("kept"), F.col("tokens")[1], F.col("tokens")[1] + 1, two))
    out.commit("copies", deletes)
    return out.totals()


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), k=4, num=80, den=100)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_binary_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.pack(_table(spark, sf_dir, "documents"), _tokenizer(), end_id=1, length=2048)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_table(spark, sf_dir, "documents"))


def op10_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_entropy_mix, op3_mixture_pack, op4_template_extract, op5_token_rollup,
        op6_minhash_near_dedup, op7_exact_topk, op8_binary_pack, op9_license_scan, op10_itq_near_dedup,
    )
}

_SPACED = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Every pair of documents that share a shingle is counted, so this is for small tables.
_OP6_SQL = f"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_SPACED}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.to_id = edges.a),
least AS (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

_OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings),
scores AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: SQL for what SQL can express; the other queries are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op6_minhash_near_dedup": _OP6_SQL, "op7_exact_topk": _OP7_SQL}
