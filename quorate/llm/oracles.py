"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations


def clustering(k: int = 8, rounds: int = 10, components: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Plain assignment and means, a common table expression per round; ids are unique."""
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v FROM embeddings"
        f" WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {components})",
        f"vals AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, unnest(range({components})) AS i FROM kept)",
        f"firsts AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept)",
        f"k0 AS MATERIALIZED (SELECT c, i, x FROM firsts JOIN vals USING (vec_id) WHERE c < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM"
            f" (SELECT v.vec_id, k.c, sum((v.x - k.x) * (v.x - k.x)) AS d FROM vals v JOIN k{r} k USING (i) GROUP BY 1, 2) GROUP BY 1)"
        )
        if r < rounds:
            parts.append(
                f"k{r + 1} AS MATERIALIZED (SELECT k.c, k.i, coalesce(m.x, k.x) AS x FROM k{r} k LEFT JOIN"
                f" (SELECT a.c, v.i, CAST(floor(sum(v.x) / count(*)) AS BIGINT) AS x FROM a{r} a JOIN vals v USING (vec_id) GROUP BY 1, 2) m USING (c, i))"
            )
    return f"""WITH {', '.join(parts)}, digests AS (SELECT c, sha256(string_agg(x, ',' ORDER BY i)) AS h FROM k{rounds} GROUP BY c)
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN digests USING (c)"""


def prefix_trie(group: int = 5, spread: int = 9) -> str:
    """Every prefix as a digest of its turns; CRC-32 of a decimal id is computed bit by bit."""
    bit = "lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END"
    crc = f"xor(4294967295::BIGINT, list_reduce(list_transform(range(1, len(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], {bit}), 4294967295::BIGINT))"
    return f"""WITH t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS j,
            md5(coalesce(role, '')) || md5(coalesce(text, '')) AS tok, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
        n AS (SELECT conv_id AS base, count(*) AS n FROM t GROUP BY 1),
        s AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % {group} AS base, {crc} % {spread} AS h FROM (SELECT DISTINCT conv_id FROM t)),
        r AS (SELECT s.conv_id, t.j AS d, tok, b FROM s JOIN t ON t.conv_id = s.base AND t.j <= s.h
            UNION ALL SELECT s.conv_id, least(s.h, coalesce(n.n, 0)) + t.j - s.h, tok, b FROM s JOIN t ON t.conv_id = s.conv_id AND t.j > s.h LEFT JOIN n ON n.base = s.base),
        p AS MATERIALIZED (SELECT conv_id, d, b, md5(string_agg(tok, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM r UNION ALL SELECT conv_id, 0, 0, md5('') FROM s),
        v AS MATERIALIZED (SELECT d, k, min(conv_id) AS c, count(*) AS n, min(b) AS b FROM p GROUP BY 1, 2),
        e AS (SELECT d, k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS h FROM (SELECT conv_id, max(d) AS d, arg_max(k, d) AS k FROM p GROUP BY 1) GROUP BY 1, 2),
        u AS MATERIALIZED (SELECT v.*, q.k AS up FROM v LEFT JOIN p q ON q.conv_id = v.c AND q.d = v.d - 1),
        kids AS (SELECT d - 1 AS d, up AS k, count(*) AS m FROM u WHERE d > 0 GROUP BY 1, 2),
        a AS (SELECT q.d, q.k, count(*) FILTER (WHERE kids.m IS NULL) AS leaves, sum((v.n - 1) * v.b) AS saved FROM v JOIN p q ON q.conv_id = v.c AND q.d <= v.d LEFT JOIN kids ON kids.d = v.d AND kids.k = v.k GROUP BY 1, 2)
        SELECT u.c AS conv_id, u.d AS depth, w.c AS parent_conv_id, u.n AS n_convs, coalesce(kids.m, 0) AS n_children, a.leaves AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
        FROM u JOIN a USING (d, k) LEFT JOIN v w ON w.d = u.d - 1 AND w.k = u.up LEFT JOIN kids ON kids.d = u.d AND kids.k = u.k LEFT JOIN e ON e.d = u.d AND e.k = u.k"""
