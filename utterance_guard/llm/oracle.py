"""The same in DuckDB SQL, where SQL can express it."""

from __future__ import annotations

WHITE = r"[ \t\n\x0B\f\r]+"

# SHA-1 as bare base32: four groups of 40 bits, eight letters each
BASE32 = """
    list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
        1 + ((('0x' || hex[10 * (i // 8) + 1 : 10 * (i // 8) + 10])::BIGINT
              >> (35 - 5 * (i % 8))) & 31)]), 'string_agg', '')
"""

# letters A-Z in lower case, and what separates no terms
LOWERED = """
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
"""
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE: dict[str, str] = {
    "op9_exact_dedup": rf"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{WHITE}', ' ', 'g')) AS h
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
        FROM t WINDOW w AS (PARTITION BY h)
    """,
    "op5_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS hex FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM d)
        SELECT page_id, n AS payload_bytes, {BASE32} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f
    """,
    "op10_url_filter": """
        WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
        s AS (
            SELECT page_id,
                   translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
            FROM u
        ),
        rules (verdict, domain, start) AS (
            VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
                   ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'),
                   ('block', 'com', '/de/')
        ),
        pairs AS (SELECT DISTINCT host, path FROM s),
        fits AS (
            SELECT host, path, arg_max(domain || start, length(domain || start)) AS rule,
                   arg_max(verdict, length(domain || start)) AS verdict
            FROM pairs JOIN rules
              ON (host = domain OR suffix(host, '.' || domain)) AND starts_with(path, start)
            GROUP BY host, path
        ),
        listed AS (
            SELECT DISTINCT host AS blocked FROM s
            WHERE regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)')
        ),
        hits AS (
            SELECT DISTINCT host FROM (SELECT DISTINCT host FROM s) JOIN listed
              ON host = blocked OR suffix(host, '.' || blocked)
        )
        SELECT page_id, s.host, s.path, rule,
               coalesce(verdict, CASE WHEN hits.host IS NULL THEN 'allow' ELSE 'block' END)
                   AS verdict
        FROM s LEFT JOIN fits USING (host, path) LEFT JOIN hits ON s.host = hits.host
    """,
    "op12_lexical_search": rf"""
        WITH t AS (
            SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '{TERM}')) AS term FROM documents
        ),
        p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
        c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
        w AS (
            SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))
                       ::BIGINT AS w
            FROM p, c GROUP BY term
        ),
        m AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM d, c),
        q AS (
            SELECT item_id, unnest(regexp_extract_all({LOWERED}, '{TERM}')) AS term FROM benchmark
        ),
        s AS (
            SELECT item_id, doc_id,
                   sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id)
            GROUP BY item_id, doc_id
        ),
        r AS (
            SELECT item_id, row_number() OVER (
                PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
            FROM s WHERE score > 0
        )
        SELECT * FROM r WHERE rank <= 10
    """,
    "op13_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id::VARCHAR) AS h,
                   regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u
            FROM documents
        ),
        c AS (
            SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
                   ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
            FROM d
        ),
        k AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a,
                   greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
                             OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                        WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM c
        ),
        s AS (
            SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p,
                   coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
                   coalesce(array_to_string(u[b + 1:], ''), '') AS s
            FROM k
        )
        SELECT doc_id, n, form,
               CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text
                      WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                      ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM s
    """,
}
