"""DuckDB SQL of the queries in this subpackage."""

from __future__ import annotations

from barwright.llm.quality import RULES, STOP_WORDS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_RATIO = {
    "n_words": "n_words::DOUBLE",
    "mean_word_chars": "word_chars / nullif(n_words, 0)",
    "symbols_per_word": "n_symbols / nullif(n_words, 0)",
    "stop_words_per_word": "n_stop_words / nullif(n_words, 0)",
    "dup_lines_per_line": "n_dup_lines / nullif(n_lines, 0)",
}


def _rules() -> str:
    tests = []
    for r in RULES:
        x = f"({_RATIO[r.ratio]})"
        parts = ([f"{x} >= {float(r.least)!r}::DOUBLE"] if r.least is not None else []) + ([f"{x} <= {float(r.most)!r}::DOUBLE"] if r.most is not None else [])
        tests.append(f"coalesce({' AND '.join(parts)}, false)")
    return " AND ".join(tests)


QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS n_symbols
  FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
g AS (
  SELECT r, i, CASE WHEN lead(i, 4) OVER v IS NOT NULL THEN
           concat_ws(chr(10), word, lead(word, 1) OVER v, lead(word, 2) OVER v, lead(word, 3) OVER v, lead(word, 4) OVER v) END AS k
  FROM w WINDOW v AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i, (k IS NOT NULL AND count(*) OVER (PARTITION BY r, k) > 1)::INT AS twice FROM g),
c AS (SELECT r, max(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM t),
n AS (SELECT r, sum(covered)::BIGINT AS n_repeat_words FROM c GROUP BY r),
m AS (
  SELECT doc_id, len(words) AS n_words, word_chars, n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(words, lambda x: trim(lower(x), '.,;:!?"''()') IN ({", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))}))) AS n_stop_words
  FROM d LEFT JOIN n USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_rules()} AS kept
FROM b
"""

_BASE32 = " || ".join(f"to_base(('0x' || substr(h, {1 + 5 * k}, 5))::BIGINT, 32, 4)" for k in range(8))

WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, translate({_BASE32}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM m
"""

HAMMING = """
WITH p AS (
  SELECT q.vec_id AS query_id, e.vec_id,
         list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: ((x[1] > 0) <> (x[2] > 0))::INTEGER))::BIGINT AS distance
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p)
SELECT query_id, vec_id, distance, rank FROM r WHERE rank <= 10
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS words FROM documents),
g AS (
  SELECT DISTINCT r, list_aggregate(words[i : i + 4], 'string_agg', chr(10)) AS gram
  FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM d WHERE len(words) > 0)),
s AS (SELECT r, count(*) AS n, md5(string_agg(gram, chr(9) ORDER BY gram)) AS k FROM g GROUP BY r),
c AS (SELECT k, min(r) AS r, max(n) AS n, min(doc_id) AS first, count(*) AS copies FROM s JOIN d USING (r) GROUP BY k),
cg AS (SELECT k, gram FROM c JOIN g USING (r)),
i AS (SELECT a.k AS a, b.k AS b, count(*) AS common FROM cg a JOIN cg b ON a.gram = b.gram AND a.k < b.k GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN c x ON x.k = a JOIN c y ON y.k = b WHERE 5 * common >= 4 * (x.n + y.n - common)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
reach(u, v) AS (SELECT k, k FROM c UNION SELECT reach.u, e.v FROM reach JOIN e ON e.u = reach.v),
m AS (SELECT reach.u AS k, min(first) AS class_id FROM reach JOIN c ON c.k = reach.v GROUP BY reach.u),
n AS (SELECT e.u AS k, sum(copies) AS links FROM e JOIN c ON c.k = e.v GROUP BY e.u)
SELECT doc_id, CASE WHEN s.k IS NULL THEN doc_id ELSE class_id END AS class_id,
       CASE WHEN s.k IS NULL THEN 0 ELSE copies - 1 + coalesce(links, 0) END::BIGINT AS n_links, coalesce(copies, 1)::BIGINT AS n_copies
FROM d LEFT JOIN s USING (r) LEFT JOIN c ON c.k = s.k LEFT JOIN m ON m.k = s.k LEFT JOIN n ON n.k = s.k
"""

SUBSTRINGS = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS r, doc_id, {WORDS} AS words FROM documents),
w AS (SELECT r, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM d),
x AS (SELECT r, i, CASE WHEN i + 19 <= len(words) THEN list_aggregate(words[i : i + 19], 'string_agg', chr(10)) END AS k FROM w JOIN d USING (r)),
a AS (SELECT r, i, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY r, i) > 1 AS again FROM x),
g AS (SELECT r, i, max(again::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM a),
o AS (SELECT r, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM w JOIN g USING (r, i) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (r)
"""

_CRC_TABLE = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"


def _crc32(text: str) -> str:
    """CRC-32 of a text by the table ``crc.t``."""
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


RESAMPLING = rf"""
WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
f AS (SELECT r, word, count(*) AS k FROM (SELECT r, unnest(words) AS word FROM d) GROUP BY ALL),
g AS (SELECT word, count(*) AS k FROM (SELECT unnest(words) AS word FROM b) GROUP BY ALL),
h AS (SELECT word, {_crc32("word")} % 10000 AS bucket FROM (SELECT word FROM f UNION SELECT word FROM g), crc),
s AS (SELECT bucket, sum(k) AS s FROM f JOIN h USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(k) AS t FROM g JOIN h USING (word) GROUP BY bucket),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt),
w AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (tt + 10000))))::BIGINT AS gain
  FROM range(10000) x(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), n),
v AS (SELECT r, sum(k * gain)::BIGINT AS weight FROM f JOIN h USING (word) JOIN w USING (bucket) GROUP BY r),
c AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0))))::BIGINT AS score
  FROM d LEFT JOIN v USING (r)),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END::BIGINT AS rank FROM o
"""

_PART = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_STEP = "list_transform(range((len(hs) + 1) // 2), lambda i: sha256(hs[2 * i + 1] || coalesce(hs[2 * i + 2], '')))"
_SIBLING = "coalesce(hs[xor(pos, 1) + 1], '')"
_FOLD = "sha256(CASE WHEN pos & 1 = 1 THEN {0} || fold ELSE fold || {0} END)".format(_SIBLING)

MERKLE = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256({" || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
         CASE WHEN coalesce({_crc32("doc_id::VARCHAR")} % 7 = 0, false) THEN sha256({" || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "(n_chars + 1)", "text"))}) END AS changed
  FROM documents, crc),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
up(tree, level, hs) AS (
  SELECT tree, 0, list(leaf ORDER BY pos) FROM l GROUP BY tree
  UNION ALL SELECT tree, level + 1, {_STEP} FROM up WHERE len(hs) > 1),
subroots AS (SELECT tree, hs[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM up WHERE len(hs) = 1),
crown(level, hs) AS (
  SELECT 0, list(subroot ORDER BY place) FROM subroots
  UNION ALL SELECT level + 1, {_STEP} FROM crown WHERE len(hs) > 1),
top AS (SELECT hs[1] AS root FROM crown WHERE len(hs) = 1),
walk(tree, doc_id, leaf, pos, level, proof, fold) AS (
  SELECT tree, doc_id, leaf, pos, 0, '', coalesce(changed, leaf) FROM l
  UNION ALL SELECT walk.tree, doc_id, leaf, pos // 2, walk.level + 1, proof || {_SIBLING}, {_FOLD} FROM walk JOIN up ON up.tree = walk.tree AND up.level = walk.level WHERE len(hs) > 1),
ends AS (SELECT w.* FROM walk w JOIN up ON up.tree = w.tree AND up.level = w.level WHERE len(hs) = 1),
rise(tree, doc_id, leaf, pos, level, proof, fold) AS (
  SELECT tree, doc_id, leaf, place, 0, proof, fold FROM ends JOIN subroots USING (tree)
  UNION ALL SELECT tree, doc_id, leaf, pos // 2, rise.level + 1, proof || {_SIBLING}, {_FOLD} FROM rise JOIN crown ON crown.level = rise.level WHERE len(hs) > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM rise JOIN crown ON crown.level = rise.level AND len(hs) = 1 JOIN subroots USING (tree), top
"""
