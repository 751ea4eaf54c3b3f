"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitrine.llm.clusters import cluster
from vitrine.llm.common import table
from vitrine.llm.encode import bpe_round_trip
from vitrine.llm.fingerprints import edited_fingerprints
from vitrine.llm.jaccard import near_duplicates
from vitrine.llm.langid import identify
from vitrine.llm.media import media_columns
from vitrine.llm.packing import pack
from vitrine.llm.quality import score_quality
from vitrine.llm.ranked import search
from vitrine.llm.shards import read_shards, write_shards
from vitrine.llm.sql import RANKED, lloyd
from vitrine.llm.suffixes import remove_repeats
from vitrine.llm.urls import judge_urls, weak_labels
from vitrine.llm.wrappers import main_texts

#: The rules of the URL query.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, weak_labels(pages), URL_RULES)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), keep_media=True)


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, salt="3:")


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_suffix_dedup, op3_ngram_jaccard, op4_media_columns, op5_document_fingerprints, op6_packing, op7_bpe, op8_html_wrappers, op9_token_shards, op10_language_id, op11_centroid_clusters, op12_quality_classifier, op13_ranked_search)}
#: The other operators have no SQL: their digests rest on tokenizers, trained models, transforms or layouts.
ORACLE_SQL: dict[str, str] = {
    "op11_centroid_clusters": lloyd(),
    "op13_ranked_search": RANKED,
    # bytes as two hexadecimal digits each, taken from blocks, as reaching far into a long text is slow
    "op2_suffix_dedup": """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, z, substr(h, 2 * z + 1, 2 * (1024 + 199)) AS q FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199, 1024)) AS z FROM t)),
p AS (SELECT doc_id, z + i AS i, md5(substr(q, 2 * i + 1, 400)) AS g FROM (SELECT doc_id, z, q, unnest(range(0, length(q) // 2 - 199)) AS i FROM b)),
s AS (SELECT doc_id, i FROM p WHERE g IN (SELECT g FROM p GROUP BY g HAVING count(*) > 1)),
f AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS head FROM s),
r AS (SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM f),
x AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM r GROUP BY doc_id, run),
y AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM x),
k AS (SELECT t.doc_id, h, coalesce(sum(b - a), 0) AS removed, count(a) AS runs, coalesce(max(b), 0) AS last, coalesce(string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a), '') AS kept FROM t LEFT JOIN y ON y.doc_id = t.doc_id GROUP BY t.doc_id, h)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(runs AS BIGINT) AS n_spans, sha256(unhex(kept || substr(h, 2 * last + 1))) AS kept_sha256 FROM k""",
    "op3_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n m ON m.doc_id = x JOIN n o ON o.doc_id = y WHERE 100 * k >= 85 * (m.n + o.n - k)),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, l.y FROM r JOIN l ON l.x = r.c)
SELECT r.d AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.d GROUP BY r.d""",
}
