"""DuckDB SQL of numbered queries that is put together from repeated parts."""

from __future__ import annotations


def lloyd(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3:", most: int = 189_812_529) -> str:
    """Clusters of ``embeddings``: one common table for each assignment and each set of centroids."""
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS q FROM (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(CAST(x AS DOUBLE)) * {scale} < {most})) = {dims}))",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS k, q AS c FROM (SELECT sha256('{salt}' || CAST(vec_id AS VARCHAR)) AS h, q FROM v WHERE vec_id IS NOT NULL) ORDER BY h, q LIMIT {k})",
        "e AS (SELECT 0 AS i)",
    ]
    near = "SELECT row, vec_id, q, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT row, vec_id, q, k, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{r}) GROUP BY row, vec_id, q"
    for r in range(rounds):
        parts += [
            f"a{r} AS MATERIALIZED ({near.format(r=r)})",
            f"s{r} AS MATERIALIZED (SELECT k, i, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT k, unnest(q) AS x, unnest(range({dims})) AS i FROM a{r}) GROUP BY k, i)",
            f"c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY k) m ON m.k = c{r}.k)",
        ]
    parts.append(f"a AS MATERIALIZED ({near.format(r=rounds)})")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(c{rounds}.c, ',')) AS centroid_sha256, count(*) OVER (PARTITION BY q) AS copies FROM a JOIN c{rounds} ON c{rounds}.k = a.k"""


#: Every document is scored for every item that shares a term with it.
RANKED = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
q AS (SELECT item_id, row_number() OVER () AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d WHERE len(w) > 0),
a AS (SELECT item_id, item, term, count(*) AS qtf FROM (SELECT item_id, item, unnest(w) AS term FROM q) GROUP BY ALL),
p AS MATERIALIZED (SELECT doc_id, row, n, term, count(*) AS tf FROM (SELECT doc_id, row, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM a) GROUP BY ALL),
t AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, big_n),
r AS (SELECT a.item, a.item_id, row, doc_id, CAST(sum(qtf * t.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score FROM a JOIN p ON p.term = a.term JOIN t ON t.term = a.term, s GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, row) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM k WHERE rank <= 10"""
