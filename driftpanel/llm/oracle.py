"""SQL that DuckDB can run on the same tables, for the text queries that SQL can express."""

from __future__ import annotations

_LETTERS = "abcdefghijklmnopqrstuvwxyz"

# CRC-32 with the usual reflected polynomial, from a table of 256 steps; all code points of a word that
# lose one place, with and without a mark in it, name the words one edit away.
SPELLING = f"""
WITH RECURSIVE steps AS (
    SELECT range AS i, range AS c, 0 AS k FROM range(256)
    UNION ALL
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (
    SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8
), runs AS (
    SELECT doc_id, translate(run, '{_LETTERS.upper()}', '{_LETTERS}') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
    GROUP BY ALL
), marked AS (
    SELECT run, n, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(
            range(octet_length(encode(bytes))),
            lambda p: ('0x' || substr(hex(encode(bytes)), 2 * p + 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h
    FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS bytes FROM runs WHERE length(run) >= 7), crc
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT)
            || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM marked)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cuts AS (
    SELECT word, n, substr(word, 1, i) || substr(word, i + 2) AS rest,
        substr(word, 1, i) || '_' || substr(word, i + 2) AS gap
    FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
    SELECT DISTINCT * FROM (
        SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.gap = b.gap AND a.word <> b.word
        UNION ALL SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest
        UNION ALL SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest)
), forms AS (
    SELECT w.word, w.n, count(b.other) AS n_near,
        arg_min(b.other, struct_pack(less := -b.n, other := b.other)) AS top, max(b.n) AS top_n
    FROM words w LEFT JOIN near b USING (word) GROUP BY w.word, w.n
), chosen AS (
    SELECT word, n, n_near, CASE WHEN top_n >= 10 * n THEN top END AS form,
        CASE WHEN top_n >= 10 * n THEN top_n END AS form_n FROM forms
), chain AS (
    SELECT word, word AS root, form AS next FROM chosen
    UNION ALL
    SELECT chain.word, c.word, c.form FROM chain JOIN chosen c ON c.word = chain.next
)
SELECT c.word, c.form, chain.root, c.n, c.n_near, c.form_n
FROM chosen c JOIN chain ON chain.word = c.word AND chain.next IS NULL
"""

_FINITE = "list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"

VECTORS = f"""
WITH RECURSIVE rows AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e,
        label IS NOT NULL AND embedding IS NOT NULL AND coalesce({_FINITE}, false)
        AND coalesce(list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) AS fit
    FROM embeddings
), fit AS (SELECT * FROM rows WHERE fit
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
    SELECT vec_id, vec_id AS other FROM rows
    UNION
    SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM rows
JOIN (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""

NEGATIVES = f"""
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce({_FINITE}, true)
), scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
        list_inner_product(a.e, r.e)::BIGINT AS score
    FROM rows a JOIN rows r ON a.vec_id <> r.vec_id AND len(a.e) = len(r.e) WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

_ALNUM = r"[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"
_WHITE = r"[^\x20\x09-\x0D]+"


def _words(text: str, pattern: str) -> str:
    lowered = f"translate({text}, '{_LETTERS.upper()}', '{_LETTERS}')"
    return f"regexp_extract_all(coalesce({lowered}, ''), '{pattern}')"


# Windows of ten words, or whole shorter items; a document is read once for each length of window.
OVERLAPS = f"""
WITH docs AS (SELECT doc_id, {_words('text', _ALNUM)} AS w FROM documents
), items AS (SELECT item_id, {_words('text', _ALNUM)} AS w FROM benchmark
), cut AS (
    SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p
    FROM items WHERE len(w) > 0
), windows AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS phrase FROM cut
), grams AS (
    SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS phrase FROM (
        SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
        FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (SELECT DISTINCT doc_id, p, n, item_id FROM grams JOIN windows USING (n, phrase)
), hit AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS place FROM found)
    GROUP BY doc_id
), own AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_words('text', _WHITE)} AS w FROM documents
), sets AS (
    SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM docs WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id
    GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * c >= 85 * (x.n + y.n - c)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT doc_id, doc_id AS other FROM docs
    UNION
    SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""
