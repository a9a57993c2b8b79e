"""DuckDB SQL for the queries of this package that SQL can express."""

ORACLES = {}

ORACLES["op9_decontaminate"] = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n,
         array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM items, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(i)
  WHERE len(w) > 0
), lengths AS (SELECT DISTINCT n FROM item_windows
), doc_windows AS (
  SELECT doc_id, i AS pos, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM lowered, lengths, unnest(generate_series(1, len(w) - n + 1)) AS t(i)
), hits AS (
  SELECT d.doc_id, d.pos, d.n, i.item_id
  FROM doc_windows d JOIN item_windows i ON d.win = i.win AND d.n = i.n
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, pos, n FROM hits), unnest(generate_series(pos, pos + n - 1)) AS t(p)
  GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words,
       CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLES["op2_line_dedup"] = r"""
WITH split AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
), lined AS (
  SELECT doc_id, source, i - 1 AS pos, lines[i] AS line,
         regexp_matches(lines[i], '[^\x20\x09-\x0D]') AS wordy,
         trim(lines[i], chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS norm
  FROM split, unnest(generate_series(1, len(lines))) AS t(i)
), spread AS (
  SELECT norm, min(doc_id) AS first_id FROM lined WHERE wordy
  GROUP BY norm HAVING count(DISTINCT source) >= 10
), hits AS (
  SELECT l.doc_id, l.pos, l.norm, s.first_id FROM lined l JOIN spread s USING (norm) WHERE l.wordy
), firsts AS (
  SELECT norm, first_id AS doc_id, min(pos) AS pos FROM hits WHERE doc_id = first_id GROUP BY ALL
), drops AS (
  SELECT DISTINCT doc_id, pos FROM hits
  WHERE NOT EXISTS (SELECT 1 FROM firsts f
    WHERE f.norm = hits.norm AND f.doc_id = hits.doc_id AND f.pos = hits.pos)
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text
  FROM lined ANTI JOIN drops USING (doc_id, pos) GROUP BY doc_id
), gone AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS removed
  FROM drops GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, coalesce(g.removed, '') AS removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN gone g USING (doc_id)
"""

#: Unsigned CRC-32 of the UTF-8 bytes of ``value``, with the table of its 256 steps made from the polynomial.
_CRC_STEPS = """crc_steps AS (
  SELECT list(list_reduce(range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS step
  FROM range(256) AS t(b)
)"""


def _crc(value: str) -> str:
    pairs = f"range(octet_length(encode({value})))"
    byte = f"('0x' || substr(hex(encode({value})), 2 * i::INT + 1, 2))::BIGINT"
    return (
        f"xor(list_reduce(list_transform({pairs}, lambda i: {byte}), "
        "lambda c, b: xor(c // 256, step[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
    )


ORACLES["op11_spelling_variants"] = f"""
WITH RECURSIVE {_CRC_STEPS}, runs AS (
  SELECT seed, word, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS seed, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS word
    FROM documents)
  WHERE length(word) >= 7 GROUP BY ALL
), checked AS (
  SELECT seed, word, n, {_crc("(seed || ':' || word)")} AS h FROM runs, crc_steps
), spelled AS (
  SELECT CASE WHEN h % 31 = 0
         THEN left(word, (h % length(word))::INT) || substr(word, (h % length(word))::INT + 2)
         ELSE word END AS word, n
  FROM checked
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM words, unnest(generate_series(1, length(word))) AS t(i)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n
  FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION
  SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top_n, arg_min(other, (-other_n, hex(encode(other)))) AS top
  FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN top_n >= 10 * w.n THEN top END AS form, CASE WHEN top_n >= 10 * w.n THEN top_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), steps AS (
  SELECT word, word AS at FROM formed
  UNION ALL
  SELECT s.word, f.form FROM steps s JOIN formed f ON f.word = s.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN steps s ON s.word = f.word JOIN formed l ON l.word = s.at AND l.form IS NULL
"""


def _framed(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_framed, ["doc_id", "source", "lang", n_chars, "text"])) + ")"


#: Groups of the leaves of one language, and a last one of their roots.  ``levels`` holds each node with the number of its
#: siblings; ``up`` carries each leaf, as it is and changed, level by level to the root, collecting siblings.
ORACLES["op13_merkle_manifest"] = f"""
WITH RECURSIVE {_CRC_STEPS}, rows AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
         CASE WHEN {_crc("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS changed
  FROM documents, crc_steps
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows
), levels AS (
  SELECT lang, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY lang) AS size FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(size) + 1) // 2
  FROM levels WHERE size > 1 GROUP BY lang, level, pos // 2
), subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS pos,
         count(*) OVER () AS size
  FROM levels WHERE size = 1
), heights AS (
  SELECT 0 AS level, pos, subroot AS digest, size FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(size) + 1) // 2
  FROM heights WHERE size > 1 GROUP BY level, pos // 2
), up AS (
  SELECT p.doc_id, p.leaf, p.lang, 0 AS level, p.pos, p.changed AS digest, '' AS proof FROM placed p
  UNION ALL
  SELECT u.doc_id, u.leaf, u.lang, u.level + 1, u.pos // 2,
         sha256(CASE WHEN s.digest IS NULL THEN u.digest
                     WHEN s.pos > u.pos THEN u.digest || s.digest ELSE s.digest || u.digest END),
         u.proof || coalesce(s.digest, '')
  FROM up u
  JOIN levels me ON me.lang IS NOT DISTINCT FROM u.lang AND me.level = u.level AND me.pos = u.pos AND me.size > 1
  LEFT JOIN levels s ON s.lang IS NOT DISTINCT FROM u.lang AND s.level = u.level AND s.pos = xor(u.pos, 1)
), tops AS (
  SELECT u.doc_id, u.leaf, u.lang, u.digest, u.proof
  FROM up u
  JOIN levels me ON me.lang IS NOT DISTINCT FROM u.lang AND me.level = u.level AND me.pos = u.pos AND me.size = 1
), further AS (
  SELECT t.doc_id, t.leaf, s.subroot, 0 AS level, s.pos, t.digest, t.proof
  FROM tops t JOIN subroots s ON s.lang IS NOT DISTINCT FROM t.lang
  UNION ALL
  SELECT u.doc_id, u.leaf, u.subroot, u.level + 1, u.pos // 2,
         sha256(CASE WHEN s.digest IS NULL THEN u.digest
                     WHEN s.pos > u.pos THEN u.digest || s.digest ELSE s.digest || u.digest END),
         u.proof || coalesce(s.digest, '')
  FROM further u
  JOIN heights me ON me.level = u.level AND me.pos = u.pos AND me.size > 1
  LEFT JOIN heights s ON s.level = u.level AND s.pos = xor(u.pos, 1)
)
SELECT f.doc_id, f.leaf, f.subroot, h.digest AS root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root,
       f.digest = h.digest AS verified
FROM further f JOIN heights h ON h.size = 1 AND h.level = f.level
"""
