"""SQL twins of the queries whose results SQL can express, for the checking engine."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
    bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS phrase FROM (SELECT *, unnest(range(len(w) - k + 1)) AS i FROM b WHERE k > 0)),
    dw AS (SELECT doc_id, k, i AS pos, array_to_string(w[i + 1 : i + k], ' ') AS phrase FROM
      (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
    hit AS (SELECT doc_id, pos, k, item_id FROM dw JOIN bw USING (k, phrase)),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM hit) GROUP BY 1),
    met AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY 1)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(c.n, 0) > 0 AS contaminated FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN met m USING (doc_id)"""

# the checking engine has no CRC-32: the bitwise definition, by byte and bit
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, x: list_reduce(list_prepend(xor(a, x), list_transform(range(8), lambda z: CAST(z AS BIGINT))),
    lambda b, z: xor(b >> 1, CASE WHEN b & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END))), CAST(4294967295 AS BIGINT))"""

CONVERSATION_TRIE = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
    heads AS (SELECT c.conv_id, t.i + 1 AS p, role, text FROM c JOIN t ON t.conv_id = c.base AND t.i < c.h),
    b AS (SELECT conv_id, count(*) AS b FROM heads GROUP BY 1),
    r AS (SELECT * FROM heads UNION ALL SELECT t.conv_id, t.i - h + coalesce(b, 0) + 1, role, text FROM t JOIN c USING (conv_id) LEFT JOIN b USING (conv_id) WHERE i >= h
      UNION ALL SELECT conv_id, 0, NULL, NULL FROM c),
    k AS (SELECT conv_id, p, coalesce(length(text), 0) AS chars, p = max(p) OVER (PARTITION BY conv_id) AS last,
      coalesce(string_agg(sha256(concat(length(role), ':', role, text)), '') OVER (PARTITION BY conv_id ORDER BY p), '') AS k FROM r),
    s AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY p) AS pk FROM k),
    n AS (SELECT p, k, any_value(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last) AS ends FROM s GROUP BY 1, 2),
    kids AS (SELECT p - 1 AS p, pk AS k, count(*) AS n_children FROM n WHERE p > 0 GROUP BY 1, 2),
    m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (p, k)),
    up AS (SELECT s.p, s.k, count(*) FILTER (m.n_children = 0) AS n_leaves, CAST(sum((m.n_convs - 1) * m.chars) AS BIGINT) AS saved_tokens FROM m JOIN s ON s.conv_id = m.conv_id AND s.p <= m.p GROUP BY 1, 2)
    SELECT m.conv_id, m.p AS depth, f.conv_id AS parent_conv_id, m.n_convs, m.n_children, up.n_leaves, up.saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
    FROM m JOIN up USING (p, k) LEFT JOIN n f ON f.p = m.p - 1 AND f.k = m.pk"""

HARD_NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id AND len(a.q) = len(b.q)),
    p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
    n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score QUALIFY rank <= 5"""

EMBEDDING_DEDUP = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings
      WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    n AS (SELECT vec_id, label, q, sqrt(list_dot_product(q, q)) AS size FROM v),
    e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q) AND list_dot_product(a.q, b.q) / (a.size * b.size) >= 0.93),
    r AS (SELECT DISTINCT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
    c AS (SELECT node, min(seen) AS root FROM r GROUP BY 1),
    k AS (SELECT a, count(*) AS n_links FROM e GROUP BY 1)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
    FROM embeddings LEFT JOIN k ON k.a = vec_id LEFT JOIN c ON c.node = vec_id"""

MINHASH_DEDUP = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.phrase = b.phrase AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
    r AS (SELECT DISTINCT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
    c AS (SELECT node, min(seen) AS root FROM r GROUP BY 1)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, d.doc_id = coalesce(root, d.doc_id) AS kept
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id"""
