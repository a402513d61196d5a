r"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

CHAT_FORMAT = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), turns AS (
    SELECT *,
        replace(replace(replace(replace(role, '\', '\0'), chr(10), '\1'), '<', '\2'), '[', '\3') AS role_out,
        regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1\2\\\3', 'g') AS text_out
    FROM said
), whole AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
        sum(length('<s>[INST] ' || role_out || chr(10) || text_out || ' [/INST]</s>' || chr(10))) AS chars
    FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM whole
"""

DECONTAMINATION = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT row_number() OVER () AS r, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), item_words AS (
    SELECT r, item_id, least(13, len(w)) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM b
), item_runs AS (
    SELECT item_id, n, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS run FROM item_words
), windows AS (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, n, array_to_string(run[1:n], ' ') AS g FROM item_runs WHERE len(run) >= n
), doc_words AS (
    SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d
), doc_runs AS (
    SELECT r, i, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS run FROM doc_words
), doc_windows AS (
    SELECT r, i, n, array_to_string(run[1:n], ' ') AS g FROM doc_runs JOIN (SELECT DISTINCT n FROM windows) ON len(run) >= n
), hits AS (
    SELECT r, i, n, item_id FROM doc_windows JOIN windows USING (n, g)
), hit_words AS (
    SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, i + unnest(range(n)) AS i FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r
), items AS (
    SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN items USING (r)
"""

FILL_IN_MIDDLE = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), drawn AS (
    SELECT doc_id, t, lines, CAST(len(lines) AS BIGINT) AS n,
        CAST('0x' || h[1:8] AS BIGINT) % (len(lines) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(lines) + 1) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
             WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM d
), parts AS (
    SELECT doc_id, t, n, form, array_to_string(lines[1:least(a, b)], '') AS prefix, array_to_string(lines[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(lines[greatest(a, b) + 1:n], '') AS suffix
    FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""

SOURCE_MIX = r"""
WITH d AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        CAST('0x' || md5('13:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:15] AS BIGINT) AS h
    FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source
), w AS (
    SELECT *, ([5, 2, 1])[rank % 3 + 1] AS weight, CAST((SELECT sum(size) FROM d) AS BIGINT) AS total FROM s
), levels AS (
    SELECT rank, source_size, weight, 3 * source_size / weight AS stop,
        (total - coalesce(sum(3 * source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM w WINDOW before AS (ORDER BY 3 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
    SELECT arg_min(CAST(level AS DOUBLE), stop) AS level FROM levels WHERE 3 * source_size > level * weight
), targets AS (
    SELECT source, rank, source_size, total, least(CAST(3 * source_size AS DOUBLE), weight * coalesce(level, 0)) AS target FROM w, level
), dealt AS (
    SELECT d.doc_id, d.size, d.h, rank, source_size, target, total, CASE WHEN size > 0 THEN h % CAST(ceil(source_size / 262144) AS BIGINT) END AS shard
    FROM d JOIN targets ON d.source IS NOT DISTINCT FROM targets.source
), cells AS (
    SELECT rank, shard, CAST(sum(size) AS BIGINT) AS words, any_value(target) * CAST(sum(size) AS BIGINT) / any_value(source_size) AS vote, any_value(total) AS total FROM dealt WHERE size > 0 GROUP BY rank, shard
), quotients AS (
    SELECT rank, shard, k, vote / (2 * k - 1) AS q, total FROM (SELECT *, unnest(range(1, CAST(ceil(3 * words / 16) AS BIGINT) + 1)) AS k FROM cells)
), won AS (
    SELECT rank, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY q DESC, rank, shard, k) AS place FROM quotients) WHERE place <= round_even(total / 16, 0) GROUP BY rank, shard
), quotas AS (
    SELECT rank, shard, words, coalesce(quota, 0) AS quota, least(coalesce(quota, 0) * 16, 3 * words) AS taken,
        CAST('0x' || md5('13:' || rank || '/' || shard)[1:15] AS BIGINT) % greatest(1, words // 16) * 16 AS start
    FROM cells LEFT JOIN won USING (rank, shard)
), laid AS (
    SELECT doc_id, size, source_size, target, quota, words, taken // words AS passes, start, start + taken % words AS stop,
        coalesce(sum(size) OVER (PARTITION BY rank, shard ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
    FROM dealt JOIN quotas USING (rank, shard)
)
SELECT doc_id, size, source_size, target, quota AS quota_blocks,
    CAST(passes * size + greatest(0, least(a + size, stop, words) - greatest(a, start)) + greatest(0, least(a + size, stop - words) - a) AS BIGINT) AS taken
FROM laid
UNION ALL BY NAME
SELECT doc_id, size, source_size, target, CAST(0 AS BIGINT) AS quota_blocks, CAST(0 AS BIGINT) AS taken FROM dealt WHERE size = 0
"""
