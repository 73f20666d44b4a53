"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import chat, imatch, mixing

#: Every window of 35 words as text, counted; positions under a repeated one go.
_OP1 = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
g AS (SELECT rid, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 34)) AS i FROM w WHERE len(words) >= 35)),
r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
s AS (SELECT DISTINCT rid, i FROM g SEMI JOIN r USING (h)),
p AS (SELECT DISTINCT rid, unnest(generate_series(i, i + 34)) AS j FROM s),
u AS (SELECT rid, unnest(words) AS word, unnest(generate_series(1, len(words))) AS j FROM w),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM u ANTI JOIN p USING (rid, j) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (rid)
"""

SQL: dict[str, str] = {"op1_substring_dedup": _OP1, "op3_mixing": mixing.SQL, "op7_imatch": imatch.sql(), "op8_chat": chat.SQL}
