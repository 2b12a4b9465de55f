"""SQL twins of the training-data queries, for DuckDB over the same tables."""

ORACLE = {}

# Shuffled streams, blocks, golden-ratio points and their ranks, stated over whole tables.
ORACLE["op2_source_mix"] = r"""
WITH sized AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS position FROM totals),
capped AS (
  SELECT *, [5, 2, 1][1 + position % 3] AS weight, 3 * source_size AS cap FROM placed),
filled AS (
  SELECT *, coalesce(sum(cap) OVER w, 0) AS c, coalesce(sum(weight) OVER w, 0) AS used,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM capped
  WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT *, max(CASE WHEN CAST(total - c AS DOUBLE) / CAST(weights - used AS DOUBLE) * weight <= cap
                     THEN CAST(total - c AS DOUBLE) / CAST(weights - used AS DOUBLE) END) OVER () AS level
  FROM filled),
plan AS (
  SELECT source, position, source_size, least(CAST(cap AS DOUBLE), coalesce(level * weight, CAST(cap AS DOUBLE))) AS target,
         greatest(1, least(256, source_size // 256)) AS block_words
  FROM levels),
quotas AS (
  SELECT *, (source_size + block_words - 1) // block_words AS blocks,
         CAST(floor(target / block_words + 0.5) AS BIGINT) AS quota FROM plan),
bounds AS (
  SELECT position, blocks, CAST(floor(CAST(sum(quota) OVER (ORDER BY position) AS DOUBLE) * 4294967296e0
                                      / CAST(sum(quota) OVER () AS DOUBLE)) AS BIGINT) AS high,
         quota FROM quotas),
ranges AS (SELECT *, coalesce(lag(high) OVER (ORDER BY position), 0) AS low FROM bounds),
slots AS (
  SELECT i, CAST((CAST(i AS HUGEINT) * 2654435769) % 4294967296 AS BIGINT) AS point
  FROM (SELECT unnest(range(CAST((SELECT sum(quota) FROM quotas) AS BIGINT))) AS i)),
ranked AS (
  SELECT position, blocks, row_number() OVER (PARTITION BY position ORDER BY i) - 1 AS r
  FROM slots JOIN ranges ON point >= low AND point < high),
plays AS (SELECT position, r % blocks AS block, count(*) AS n FROM ranked WHERE r < 3 * blocks GROUP BY 1, 2),
streams AS (
  SELECT s.*, q.position, q.block_words, CAST(coalesce(sum(size) OVER (
           PARTITION BY q.position ORDER BY md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source),
pieces AS (
  SELECT *, unnest(range(start // block_words, (start + size - 1) // block_words + 1)) AS block
  FROM streams WHERE size > 0),
words AS (
  SELECT rid, CAST(sum((least(start + size, (p.block + 1) * block_words) - greatest(start, p.block * block_words)) * n) AS BIGINT) AS taken
  FROM pieces p JOIN plays USING (position, block) GROUP BY rid)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, coalesce(taken, 0) AS taken
FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source LEFT JOIN words USING (rid)
"""


def _centroid_rounds(clusters: int = 8, rounds: int = 10, dimension: int = 64) -> str:
    """Rounds of assignment and exact mean, one named step each; distance and cluster ride in one number."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: isfinite(CAST(x AS DOUBLE)))) = {dimension}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS cluster, v FROM kept
  QUALIFY cluster < {clusters})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT rid, vec_id, k.v, min(list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {clusters} + c.cluster) AS near
  FROM kept k CROSS JOIN c{r} c GROUP BY rid, vec_id, k.v)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (
  WITH sums AS (
    SELECT near % {clusters} AS cluster, i, sum(v[i]) AS s, count(*) AS n
    FROM a{r}, range(1, {dimension + 1}) AS t(i) GROUP BY 1, 2),
  means AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM sums GROUP BY cluster)
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN means m ON c.cluster = m.cluster)"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(c.cluster AS INTEGER) AS cluster, CAST(near // {clusters} AS BIGINT) AS distance,
       CAST(sum(near // {clusters}) OVER (PARTITION BY c.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(near // {clusters}) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.near % {clusters} = c.cluster"""


ORACLE["op12_centroid_clusters"] = _centroid_rounds()
