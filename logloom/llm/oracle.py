"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from .chat_format import BODY, END, TURN, _controls

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = "[^\\x20\\x09-\\x0D]+"

OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS l FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) >= 5 THEN list_transform(range(1, len(l) - 3), lambda i: list_slice(l, i, i + 4)) WHEN len(l) > 0 THEN [l] ELSE [] END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 k AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
 e AS (SELECT x, y FROM k UNION SELECT y, x FROM k),
 r AS (SELECT DISTINCT x AS doc, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc),
 m AS (SELECT doc, min(root) AS root FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc = d.doc_id"""

_ALNUM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_WINDOWS = "CASE WHEN len(l) >= 10 THEN list_transform(range(1, len(l) - 8), lambda i: list_slice(l, i, i + 9)) WHEN len(l) > 0 THEN [l] ELSE [] END"

OP4 = f"""WITH b AS (SELECT DISTINCT item_id, unnest({_WINDOWS}) AS g FROM (SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS l FROM benchmark)),
 w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS l FROM documents),
 sizes AS (SELECT DISTINCT len(g) AS k FROM b),
 o AS (SELECT doc_id, k, unnest(range(1, len(l) - k + 2)) AS i, l FROM w, sizes WHERE len(l) >= k),
 f AS (SELECT o.doc_id, o.i, o.k, b.item_id FROM (SELECT doc_id, i, k, list_slice(l, i, i + k - 1) AS g FROM o) o JOIN b ON b.g = o.g),
 h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM f) GROUP BY 1),
 t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM f GROUP BY 1),
 a AS (SELECT doc_id, k, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM (SELECT DISTINCT doc_id, i, k FROM f))
SELECT w.doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN h ON h.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id"""

_SAID = "</s>[INST] ok [/INST]"
_MARKS = "length(regexp_extract_all({}, '" + _controls.replace("'", "''") + "'))"

OP5 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'),
 g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
 sum({len(TURN) + len(BODY) + len(END)} + length(role) + length(text) + {_MARKS.format("role")} + {_MARKS.format("text")}) AS chars FROM c GROUP BY 1)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(t) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g"""

_SHARE = "greatest(CAST(floor(({0} - 2 * sqrt({0})) * 10000 / greatest({1}, 1)) AS BIGINT), 0)"
_FEATURES = {
    "symbols": _SHARE.format("n_symbols", "n_words"),
    "dup_lines": _SHARE.format("n_dup_lines", "n_lines"),
    "repeats": _SHARE.format("n_repeat_words", "n_words"),
    "word_length": "word_chars * 1000 // greatest(n_words, 1)",
}


def _op6() -> str:
    rows = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS feature, {v} AS x FROM m WHERE NOT base_failed" for k, v in _FEATURES.items())
    beyond = " OR ".join(f"coalesce({v} > (SELECT fence FROM fences x WHERE x.lang IS NOT DISTINCT FROM m.lang AND x.source IS NOT DISTINCT FROM m.source AND x.feature = '{k}'), false)" for k, v in _FEATURES.items())

    def fence(name: str, keys: str) -> str:
        group, over = (f"{keys}, ", f"PARTITION BY {keys}, feature") if keys else ("", "PARTITION BY feature")
        return f"""{name} AS (SELECT {group}feature, max(total) AS size, min(CASE WHEN upto * 10 >= total * 9 THEN bucket END) + (min(CASE WHEN upto * 10 >= total * 9 THEN bucket END) - min(CASE WHEN upto * 10 >= total * 5 THEN bucket END)) * CAST(8.0 AS DOUBLE) AS fence
 FROM (SELECT {group}feature, bucket, sum(n) OVER ({over} ORDER BY bucket) AS upto, sum(n) OVER ({over}) AS total FROM (SELECT {group}feature, bucket, sum(n) AS n FROM k GROUP BY ALL)) GROUP BY ALL)"""

    return f"""WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS l FROM documents),
 lines AS (SELECT doc_id, list_filter(str_split(text, chr(10)), lambda z: regexp_matches(z, '{_WORD}')) AS s FROM w),
 win AS (SELECT doc_id, unnest(range(1, len(l) - 1)) AS i, l FROM w WHERE len(l) >= 3),
 grams AS (SELECT doc_id, i, list_slice(l, i, i + 2) AS g FROM win),
 again AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
 reps AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY 1),
 m0 AS (SELECT w.doc_id, lang, source, len(l) AS n_words, length(text) - length(regexp_replace(text, '[^\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
 len(s) - len(list_distinct(s)) AS n_dup_lines, len(s) AS n_lines, coalesce(reps.n, 0) AS n_repeat_words FROM w JOIN lines ON lines.doc_id = w.doc_id LEFT JOIN reps ON reps.doc_id = w.doc_id),
 m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m0),
 k AS (SELECT lang, source, feature, CASE WHEN x < 128 THEN x ELSE (x >> (length(bin(x)) - 7)::INT) << (length(bin(x)) - 7)::INT END AS bucket, count(*) AS n FROM ({rows}) GROUP BY ALL),
 {fence("qg", "lang, source")}, {fence("ql", "lang")}, {fence("qa", "")},
 fences AS (SELECT qg.lang, qg.source, qg.feature, (qg.fence * qg.size + ((ql.fence * ql.size + qa.fence * 100) / (ql.size + 100)) * 100) / (qg.size + 100) AS fence
 FROM qg JOIN ql ON ql.lang IS NOT DISTINCT FROM qg.lang AND ql.feature = qg.feature JOIN qa ON qa.feature = qg.feature)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
 NOT base_failed AND NOT ({beyond}) AS kept FROM m"""


ORACLE_SQL = {"op1_ngram_jaccard_join": OP1, "ngram_join_exact": OP1, "op4_decontamination": OP4, "op5_chat_formatting": OP5, "op6_quality_rules": _op6()}
