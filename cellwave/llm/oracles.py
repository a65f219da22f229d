"""DuckDB SQL for the queries of this package that SQL can express, besides those beside their operators."""

from __future__ import annotations


def _hash(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 15))::BIGINT"


def _sainte_lague(source: str, group: str, party: str, votes: str, seats: str, out: str, name: str) -> str:
    """CTEs that give each party of a group its seats, by the few quotients that are not settled."""
    return f"""{name}_bounds AS (
  SELECT *, CASE WHEN {votes} > 0 THEN greatest(0, floor({votes}::DOUBLE * ({seats} - k / 2.0) / v - 0.5))::BIGINT ELSE 0 END AS low,
         CASE WHEN {votes} > 0 THEN ceil({votes}::DOUBLE * ({seats} + k / 2.0) / v + 0.5)::BIGINT ELSE 0 END AS high
  FROM (SELECT *, count(*) FILTER ({votes} > 0) OVER (PARTITION BY {group}) AS k, sum({votes}::DOUBLE) OVER (PARTITION BY {group}) AS v FROM {source})
), {name}_tries AS (
  SELECT {group} AS g, {party} AS p, {votes}::DOUBLE / (2 * seat + 1) AS quotient FROM (SELECT *, unnest(range(low, high)) AS seat FROM {name}_bounds)
), {name}_ranked AS (
  SELECT t.g, t.p, row_number() OVER (PARTITION BY t.g ORDER BY quotient DESC, t.p) <= o.open AS won
  FROM {name}_tries t JOIN (SELECT {group} AS g, any_value({seats}) - sum(low) AS open FROM {name}_bounds GROUP BY {group}) o ON o.g = t.g
), {name} AS (
  SELECT b.*, low + coalesce(won, 0) AS {out} FROM {name}_bounds b
  LEFT JOIN (SELECT g, p, count(*) FILTER (won) AS won FROM {name}_ranked GROUP BY g, p) w ON w.g = {group} AND w.p = {party}
)"""


OP1_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), summed AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM sizes GROUP BY source
), weighed AS (
  SELECT *, [1, 2, 3][(source_no - 1) % 3 + 1] AS w, source_size * 3 AS cap FROM summed
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM weighed
), targets AS (
  SELECT 1 AS everything, source, source_no, source_size,
         CASE WHEN lvl * w > cap THEN cap::DOUBLE ELSE least(cap::DOUBLE, coalesce(max(CASE WHEN lvl * w <= cap THEN lvl END) OVER (), 0) * w) END AS target FROM levels
), seated AS (
  SELECT *, greatest(round(sum(target) OVER () / 16), sign(sum(target) OVER ()))::BIGINT AS seats FROM targets
), {_sainte_lague('seated', 'everything', 'source_no', 'target', 'seats', 'blocks', 'src')},
placed AS (
  SELECT s.doc_id, s.size, f.source_no, f.source_size, f.target, f.blocks,
         {_hash("'mix-shard'", 's.doc_id::VARCHAR')} % least(1048576, greatest(1, ceil(f.source_size / 131072)))::BIGINT AS shard
  FROM sizes s JOIN src f ON s.source IS NOT DISTINCT FROM f.source
), shards AS (
  SELECT source_no, shard, blocks, sum(size)::BIGINT AS shard_size FROM placed GROUP BY ALL
), {_sainte_lague('shards', 'source_no', 'shard', 'shard_size', 'blocks', 'quota', 'shd')},
streamed AS (
  SELECT p.*, q.shard_size AS c, least(q.quota * 16, q.shard_size * 3)::BIGINT AS wanted,
         sum(size) OVER (PARTITION BY p.source_no, p.shard ORDER BY {_hash("'mix'", 'p.doc_id::VARCHAR')}, p.doc_id, p.size ROWS UNBOUNDED PRECEDING)::BIGINT AS e,
         ({_hash("'mix-start'", 'p.source_no::VARCHAR', 'p.shard::VARCHAR')} % greatest(1, ceil(q.shard_size / 16))::BIGINT) * 16 AS f
  FROM placed p JOIN shd q ON p.source_no = q.source_no AND p.shard = q.shard
), cut AS (
  SELECT *, CASE WHEN c > 0 THEN wanted // c ELSE 0 END AS times, CASE WHEN c > 0 THEN wanted % c ELSE 0 END AS rest FROM streamed
)
SELECT doc_id, size, source_size, target,
       (times * size + greatest(0, least(e, f + rest) - greatest(e - size, f)) + greatest(0, least(e, f - c + rest) - greatest(e - size, f - c)))::BIGINT AS taken
FROM cut
"""

OP4_SQL = """
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sized AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL) p
  JOIN sized m ON m.doc_id = a JOIN sized o ON o.doc_id = b WHERE 100 * k >= 90 * (m.n + o.n - k)
), undirected AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS label FROM documents UNION SELECT r.node, e.b FROM reach r JOIN undirected e ON e.a = r.label
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN sized USING (doc_id)
JOIN (SELECT node AS doc_id, min(label) AS component_id FROM reach GROUP BY node) c USING (doc_id)
"""

OP10_SQL = """
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) t(i)
), marked AS (
  SELECT *, bool_or(regexp_matches(role || ' ' || text, '<\\|im_(start|end)\\|>|<\\\\+\\|') OR regexp_matches(role, '\\n|\\\\n|\\\\b')) OVER (PARTITION BY conv_id) AS escaped FROM given
), written AS (
  SELECT *, CASE WHEN escaped THEN regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') ELSE text END AS t,
         CASE WHEN escaped THEN regexp_replace(replace(replace(role, '\\', '\\b'), chr(10), '\\n'), '<(\\\\*)\\|', '<\\\\\\1|', 'g') ELSE role END AS r FROM marked
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length(r) + 1 + length(t) + 11)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""
