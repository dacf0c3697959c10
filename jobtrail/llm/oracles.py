"""The same questions in SQL, for the operators that SQL can express."""

_REACH = """
    reach AS (
        SELECT {key} AS node, {key} AS found FROM {table}
        UNION
        SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.found),
    parts AS (SELECT node, min(found) AS component_id FROM reach GROUP BY 1)"""

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLES = {
    "op1_ngram_jaccard_join": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, [x for x in regexp_split_to_array(
                translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[\\x20\\x09-\\x0D]+') if x <> ''] AS w
            FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(w) >= 5 THEN [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
            FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
        shared AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
            FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        links AS (
            SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
        {_REACH.format(key="doc_id", table="documents")}
        SELECT doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id
        FROM documents JOIN parts ON node = doc_id LEFT JOIN sizes USING (doc_id)""",
    "op2_embedding_near_dedup": f"""
        WITH RECURSIVE vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        links AS (
            SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.label = y.label AND x.vec_id <> y.vec_id
            WHERE list_inner_product(x.v, y.v)
                  / (sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v))) >= 0.98),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1),
        {_REACH.format(key="vec_id", table="embeddings")}
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN parts ON node = vec_id LEFT JOIN counts ON a = vec_id""",
    "op6_chat_formatting": """
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
        marked AS (
            SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM turns),
        escaped AS (
            SELECT *, length(text) + length(text) - length(translate(text, '\\<>', '')) AS text_chars,
                   length(role) + length(role) - length(translate(role, '\\<>', '')) AS role_chars
            FROM marked)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(8 + sum(text_chars + CASE WHEN before = role THEN 6
                                              ELSE 7 + role_chars + CASE WHEN before IS NULL THEN 0 ELSE 8 END END)
                    AS BIGINT) AS formatted_chars
        FROM escaped GROUP BY 1""",
    "op7_exact_dedup": """
        WITH texts AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER best = 1 AS kept, sha256(norm) AS text_sha256
        FROM texts WINDOW best AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)""",
    "op12_spelling_variants": """
    WITH RECURSIVE crc AS (
        SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
            lambda c, bit: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS entry),
    runs AS (
        SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
    hexed AS (SELECT *, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS bytes FROM runs),
    draws AS (
        SELECT run, n, xor(4294967295, list_reduce(
            list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(bytes) // 2), lambda k:
                CAST(('0x' || substr(bytes, CAST(2 * k + 1 AS BIGINT), 2)) AS BIGINT))),
            lambda c, byte: xor(c // 256, entry[xor(c % 256, byte) + 1]))) AS h
        FROM hexed, crc),
    spoken AS (
        SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
        FROM draws),
    words AS (
        SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoken GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
    cuts AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS spot FROM words),
    less AS (SELECT *, substr(word, 1, spot - 1) AS head, substr(word, spot + 1) AS tail FROM cuts),
    pairs AS (
        SELECT x.word AS a, y.word AS b FROM less x JOIN less y USING (head, tail) WHERE x.word <> y.word
        UNION SELECT x.word, y.word FROM less x JOIN words y ON y.word = x.head || x.tail
        UNION SELECT y.word, x.word FROM less x JOIN words y ON y.word = x.head || x.tail),
    near AS (
        SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS best, max(n) AS best_n
        FROM pairs JOIN words ON word = b GROUP BY 1),
    forms AS (
        SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form,
               CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
        FROM words LEFT JOIN near USING (word)),
    steps AS (
        SELECT word, coalesce(form, word) AS root FROM forms
        UNION ALL SELECT steps.word, forms.form FROM steps JOIN forms ON forms.word = root
        WHERE forms.form IS NOT NULL),
    ends AS (SELECT steps.word, root FROM steps JOIN forms ON forms.word = root WHERE forms.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)""",
}
