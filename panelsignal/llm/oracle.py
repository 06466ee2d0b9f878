"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from panelsignal.llm.quality import STOP_WORDS

_WS = r"[\x20\x09-\x0D]"


def oracle_sql() -> dict[str, str]:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return {
        "op2_arc_to_warc": """
            WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
            k AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS last FROM p)
            SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
                CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
                CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
            FROM k
        """,
        "op6_stream_exact_dedup": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
            g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
            FROM d JOIN g USING (t)
        """,
        "op8_quality_rules": rf"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
            w AS (
                SELECT doc_id, t,
                    list_filter(string_split_regex(t, '{_WS}+'), lambda x: x <> '') AS ws,
                    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
                FROM d
            ),
            i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
            win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM i),
            cov AS (
                SELECT doc_id, count(DISTINCT p) AS n_repeat_words
                FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY doc_id
            ),
            m AS (
                SELECT doc_id,
                    len(ws) AS n_words,
                    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
                    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
                    greatest(len(ws), 1) AS n1,
                    len(ls) AS n_lines,
                    length(t) - length(replace(t, '!', '')) AS n_excl,
                    len(list_filter(ws, lambda x: list_contains([{stops}], lower(x)))) AS n_stop
                FROM w LEFT JOIN cov USING (doc_id)
            )
            SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
                NOT base_failed
                AND word_chars / n1 BETWEEN 3.0 AND 10.0
                AND n_symbols / n1 <= 0.1 AND n_excl / n1 <= 0.1
                AND n_stop / n1 >= 0.06
                AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept
            FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        """,
        "op9_tgm_jaccard": rf"""
            WITH RECURSIVE d AS (
                SELECT doc_id, list_filter(
                    string_split_regex(translate(coalesce(text, ''),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WS}+'),
                    lambda x: x <> '') AS ws
                FROM documents
            ),
            i AS (
                SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [1]
                    ELSE range(1, len(ws) - 2) END) AS i
                FROM d
            ),
            s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM i),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            c AS (
                SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g)
                WHERE a.doc_id <> b.doc_id GROUP BY ALL
            ),
            l AS (
                SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
                WHERE 100 * c >= 85 * (nx.n + ny.n - c)
            ),
            r(doc_id, least) AS (
                SELECT doc_id, doc_id FROM documents
                UNION
                SELECT l.y, r.least FROM r JOIN l ON l.x = r.doc_id WHERE r.least < l.y
            )
            SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
            FROM (SELECT doc_id, min(least) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
        """,
        "op10_line_dedup": rf"""
            WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
            l AS (
                SELECT doc_id, line,
                    translate(regexp_replace(regexp_replace(line, '^{_WS}+', ''), '{_WS}+$', ''),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key, pos
                FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d)
            ),
            k AS (
                SELECT key, max(doc_id) AS keep_id FROM l WHERE length(key) >= 40
                GROUP BY key HAVING count(DISTINCT doc_id) >= 5
            ),
            f AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.keep_id AS dropped FROM l LEFT JOIN k USING (key))
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
                sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
            FROM f GROUP BY doc_id
        """,
        "op12_prefix_contamination": r"""
            WITH d AS (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
                FROM documents
            ),
            b AS (
                SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
                FROM benchmark
            ),
            i AS (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, least(len(ws), 1)) + 1)) AS i FROM b),
            v AS (SELECT DISTINCT item_id, ws[i:i + 9] AS w FROM i),
            l AS (SELECT DISTINCT len(w) AS l FROM v),
            p AS (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS p FROM d, l),
            g AS (SELECT doc_id, p, l, ws[p:p + l - 1] AS w FROM p),
            h AS (SELECT doc_id, p, l, item_id FROM g JOIN v USING (w)),
            n AS (
                SELECT doc_id, count(DISTINCT k) AS n_hit
                FROM (SELECT doc_id, unnest(range(p, p + l)) AS k FROM h) GROUP BY doc_id
            ),
            t AS (
                SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
            )
            SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
                sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
        """,
        "op13_block_runs": rf"""
            WITH t AS (
                SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') AS ws,
                    xor(list_reduce(
                        list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                            lambda x: CAST(ascii(x) AS BIGINT))),
                        lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
                            lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) AS h
                FROM documents
            ),
            g AS (
                SELECT doc_id, ws, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN h // 10 END AS g FROM t
            ),
            d AS (
                SELECT doc_id, ws, n, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM g
            ),
            i AS (SELECT doc_id, ws, n, a, p, unnest(range(n)) AS i FROM d),
            w AS (
                SELECT doc_id, n, i, ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS w FROM i
            ),
            e AS (
                SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y
                ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND y.i <= x.i + x.n // 4
            ),
            r AS (
                SELECT doc_id, q, min(i) AS s, count(*) + q AS l
                FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e)
                GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
            ),
            u AS (SELECT doc_id, s, l, min(q) AS q FROM r GROUP BY doc_id, s, l),
            f AS (
                SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := s, l := l, q := q), (-l, s, q)) AS longest,
                    string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS lines
                FROM u GROUP BY doc_id
            ),
            k AS (
                SELECT w.doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM w
                ANTI JOIN (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM u) x
                ON x.doc_id = w.doc_id AND x.i = w.i GROUP BY w.doc_id
            )
            SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(longest.s AS BIGINT) AS start,
                CAST(longest.l AS BIGINT) AS length, CAST(longest.q AS BIGINT) AS period,
                CAST(1000 * longest.l // longest.q AS BIGINT) AS exponent_milli,
                sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
            FROM d LEFT JOIN f USING (doc_id) LEFT JOIN k USING (doc_id)
        """,
    }
