"""The SQL that the corpus queries must agree with, where SQL can express them.

Not here: fingerprints and shards need hashes that the SQL engine lacks, neighbours differ in the last bit of a
sum, and the classifiers and the reliabilities of labelers are fitted by iteration. Those are tested against brute force or held-out rows.
"""

from __future__ import annotations

# The remainders of the bytes, from the polynomial; SQL here has no crc32.
CRC_TABLE = """
        crc_table AS (
            SELECT list(v ORDER BY i) AS t FROM (
                SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
                FROM range(256) AS r(i)
            )
        ),"""

ORACLE: dict[str, str] = {
    "op1_suffix_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        starts AS (SELECT doc_id, h, unnest(range(n - 49)) AS p FROM d WHERE n >= 50),
        strings AS (SELECT doc_id, p, h[p + 1 : p + 50] AS s FROM starts),
        least AS (SELECT s, min(doc_id) AS m FROM strings GROUP BY s HAVING count(*) > 1),
        gone AS (SELECT doc_id, p FROM strings JOIN least USING (s) WHERE doc_id > m),
        marked AS (
            SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM gone
        ),
        numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
        runs AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, run),
        before AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM runs),
        cut AS (
            SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last,
                string_agg(CASE WHEN a > e THEN hex(h[e + 1 : a]) ELSE '' END, '' ORDER BY a) AS head
            FROM before JOIN d USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
            sha256(CASE WHEN last IS NULL THEN h ELSE unhex(head || CASE WHEN last < n THEN hex(h[last + 1 : n]) ELSE '' END) END) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id)""",
    "op2_chat_format": r"""
        WITH rows_ AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ),
        ordered AS (
            SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
                length(regexp_replace(text, '([<\[])(\\*)(\||/s>|s>|INST\]|/INST\])', '\1\2\\\3', 'g')) AS text_chars,
                length(role) AS role_chars
            FROM rows_
        ),
        judged AS (
            SELECT *, CASE role
                WHEN 'system' THEN before IS NULL
                WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
                WHEN 'assistant' THEN coalesce(before = 'user', false)
                ELSE false END AS fits
            FROM ordered
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(12 + role_chars + 1 + text_chars + 11)::BIGINT AS formatted_chars,
            bool_and(fits) AND last(role ORDER BY turn, role, text) = 'assistant' AS valid
        FROM judged GROUP BY conv_id""",
    "op4_decontamination": r"""
        WITH upper_lower AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
        d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), u, l), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
            FROM documents, upper_lower
        ),
        b AS (
            SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), u, l), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
            FROM benchmark, upper_lower
        ),
        cut AS (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, array_to_string(w[s + 1 : s + 10], ' ') AS k, len(w[s + 1 : s + 10]) AS n FROM cut),
        lengths AS (SELECT DISTINCT n FROM windows),
        places AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, lengths WHERE len(w) >= n),
        hits AS (
            SELECT p.doc_id, p.s, p.n, x.item_id
            FROM places p JOIN windows x ON x.n = p.n AND x.k = array_to_string(p.w[p.s + 1 : p.s + p.n], ' ')
        ),
        words AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS at FROM hits),
        hit AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
            FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_source_mix": r"""
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
        ),
        sums AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid
            FROM sized GROUP BY source
        ),
        weighed AS (SELECT *, ([3.0, 1.0, 2.0])[((sid - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM sums),
        levels AS (
            SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
                - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM weighed
        ),
        common AS (SELECT min_by(level, most / weight) AS level FROM levels WHERE most > level * weight),
        targets AS (SELECT l.* EXCLUDE (level), coalesce(least(most, c.level * weight), most) AS target FROM levels l, common c),
        stretches AS (
            SELECT *, sum(target) OVER (ORDER BY sid ROWS UNBOUNDED PRECEDING) AS upto, sum(target) OVER () AS total FROM targets
        ),
        plan AS (
            SELECT *, (upto - target) / total AS low, CASE WHEN sid = max(sid) OVER () THEN 1.0 ELSE upto / total END AS high
            FROM stretches
        ),
        slots AS (SELECT unnest(range(ceil((SELECT max(total) FROM plan) / 64)::BIGINT)) AS slot),
        points AS (
            SELECT slot, ((((slot + 1) // 1048576) * 0.607787409740351::DOUBLE) % 1 + (((slot + 1) % 1048576) * 0.6180339887498949::DOUBLE) % 1) % 1 AS u
            FROM slots
        ),
        counts AS (SELECT sid, count(*) AS n FROM points JOIN plan ON low <= u AND u < high GROUP BY sid),
        placed AS (
            SELECT s.doc_id, s.source, s.size, p.source_size, p.target, p.sid,
                sum(s.size) OVER (PARTITION BY p.sid ORDER BY md5('0:' || s.doc_id::VARCHAR), s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS first
            FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
        )
        SELECT doc_id, size, source_size, target, source,
            (greatest(0, least(first + size, n * 64) - first)
                + greatest(0, least(first + source_size + size, n * 64) - first - source_size))::BIGINT AS taken
        FROM placed JOIN counts USING (sid)""",
    "op10_warc": """
        WITH p AS (
            SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages
        ),
        q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
        FROM q""",
    "op11_periodic_runs": """
        WITH"""
    + CRC_TABLE
    + r"""
        d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS o,
                xor(4294967295, list_reduce(
                    [4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
                    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
            FROM documents, crc_table
        ),
        e AS (SELECT *, len(o) AS n, h // 10 AS g, CASE WHEN len(o) > 0 THEN (h // 10) % len(o) ELSE 0 END AS a FROM d),
        f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
        w AS (
            SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
                THEN list_transform(range(n), lambda i: o[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE o END AS w
            FROM f
        ),
        places AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM w),
        matches AS (
            SELECT x.doc_id, x.i, y.i - x.i AS q FROM places x
            JOIN places y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
        ),
        islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM matches),
        stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM islands GROUP BY doc_id, q, island),
        runs AS (SELECT doc_id, s, n, min(q) AS q FROM stretches WHERE n >= greatest(24, 3 * q) GROUP BY doc_id, s, n),
        listed AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
                list({'s': s, 'n': n, 'q': q} ORDER BY s, q) AS r
            FROM runs GROUP BY doc_id
        ),
        chosen AS (
            SELECT *, list_reduce(r, lambda x, y: CASE WHEN y.n * x.q > x.n * y.q THEN y ELSE x END) AS best FROM listed
        ),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM runs),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM places ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.q AS period,
            1000 * best.n // best.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
            sha256(coalesce(kept.text, '')) AS collapsed_sha256
        FROM w LEFT JOIN chosen USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op13_spelling_variants": """
        WITH RECURSIVE"""
    + CRC_TABLE
    + r"""
        runs AS (
            SELECT doc_id, unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
            FROM documents
        ),
        hashed AS (
            SELECT run, k, xor(4294967295, list_reduce(
                [4294967295] || flatten(list_transform(string_split(doc_id || ':' || run, ''),
                    lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c)::BIGINT - 64] END)),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
            FROM (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY doc_id, run), crc_table
        ),
        spelt AS (
            SELECT k, CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed
        ),
        words AS (SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
        cuts AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS cut FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
        pairs AS (
            SELECT DISTINCT x.word AS a, y.word AS b, y.n FROM cuts x JOIN cuts y ON x.i = y.i AND x.cut = y.cut AND x.word <> y.word
            UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.cut = w.word
            UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.cut = w.word
        ),
        best AS (
            SELECT a AS word, count(*) AS n_near, max(n) AS most, min(b) FILTER (n = top) AS b
            FROM (SELECT *, max(n) OVER (PARTITION BY a) AS top FROM pairs) GROUP BY a
        ),
        formed AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN b END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n
            FROM words LEFT JOIN best USING (word)
        ),
        walk AS (
            SELECT word, word AS root FROM formed
            UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON walk.root = formed.word WHERE formed.form IS NOT NULL
        ),
        ends AS (SELECT walk.word, walk.root FROM walk JOIN formed ON walk.root = formed.word WHERE formed.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)""",
}
