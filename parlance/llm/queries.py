"""The queries opN_<name> and their DuckDB SQL."""

from __future__ import annotations

from . import bpe, chat_format, fingerprints, jaccard_join, license_scan, line_dedup, mixing, prefix_trie, quality_classifier, quality_rules, sentence_pieces, suffix_dedup, whitening

QUERIES = {
    f.__name__: f
    for f in (
        mixing.op1_mix_sources,
        bpe.op2_bpe,
        quality_classifier.op3_quality_classifier,
        suffix_dedup.op4_suffix_dedup,
        license_scan.op5_license_scan,
        quality_rules.op6_quality_rules,
        fingerprints.op7_fingerprints,
        jaccard_join.op8_jaccard_join,
        line_dedup.op9_line_dedup,
        chat_format.op10_chat_format,
        prefix_trie.op11_prefix_trie,
        sentence_pieces.op12_sentence_pieces,
        whitening.op13_whitening,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(k: int) -> str:
    """A word list's k-word shingles; a shorter list is one by itself."""
    return f"CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k - 2}), lambda i: w[i:i + {k - 1}]) WHEN len(w) > 0 THEN [w] ELSE [] END"


ORACLES = {
    "op8_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest({_shingles(4)}) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
k AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM k JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reached AS (SELECT r, r AS x FROM d UNION SELECT reached.r, e.b FROM reached JOIN e ON e.a = reached.x)
SELECT any_value(d.doc_id) AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n ON n.r = d.r JOIN reached ON reached.r = d.r JOIN d o ON o.r = reached.x GROUP BY d.r""",
    "op9_line_dedup": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(x))) AS i, unnest(x) AS text FROM d),
v AS (SELECT doc_id, i, text, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM l),
f AS (SELECT row_number() OVER () AS r, w, min((doc_id, i)) AS first FROM v WHERE len(w) > 0 GROUP BY w),
s AS (SELECT DISTINCT r, unnest({_shingles(5)}) AS g FROM f),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
k AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g GROUP BY a.r, b.r),
m AS (SELECT a AS r, min(f.first) AS earliest FROM k JOIN n x ON x.r = a JOIN n y ON y.r = b JOIN f ON f.r = b WHERE 100 * k >= 80 * (x.n + y.n - k) GROUP BY a),
g AS (SELECT doc_id, i, text, coalesce(m.earliest < (doc_id, i), false) AS gone FROM v LEFT JOIN f ON f.w = v.w LEFT JOIN m USING (r)),
o AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(text, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, len(kept)::BIGINT AS n_chars_kept, sha256(kept) AS kept_sha256 FROM o""",
    "op6_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM g),
p AS (SELECT r, count(DISTINCT j) AS n_repeat FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM t WHERE n > 1) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT r, line, len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS c, len(line) - len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) + 1 AS n,
  len(line) - len(regexp_replace(line, '[#*$%&<>]', '', 'g')) AS sy, len(line) - len(regexp_replace(line, '[!?]', '', 'g')) AS sh, len(line) - len(regexp_replace(line, '[|»›•·]', '', 'g')) AS se,
  regexp_matches(line, '(?i)({quality_rules.Rules().phrases.replace("'", "''")})') AS ph, regexp_matches(line, '{quality_rules.MARKS}') AS ended FROM l),
k AS (SELECT r, line, c, NOT ((sy >= 3 AND 100 * sy > 30 * n) OR (sh >= 6 AND 100 * sh > 30 * n) OR (se >= 3 AND 100 * se > 30 * n) OR (n <= 30 AND ph) OR (n >= 20 AND NOT ended)) AS good FROM m),
x AS (SELECT r, count(*) FILTER (c > 0) - count(DISTINCT line) FILTER (c > 0) AS dup, sum(CASE WHEN good THEN 0 ELSE c END) AS lost, count(*) FILTER (NOT good) AS gone FROM k GROUP BY r),
f AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost, coalesce(gone, 0)::BIGINT AS n_lines_removed
  FROM d LEFT JOIN p USING (r) LEFT JOIN x USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 50 * word_chars AS kept, n_lines_removed FROM f""",
    "op10_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS et,
  replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS er FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(len('<|turn|>') + len(er) + len('<|text|>') + len(et) + len('<|end|>') + 1) + 4)::BIGINT AS formatted_chars FROM e GROUP BY conv_id""",
    "op11_prefix_trie": r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(s)) AS i, sha256(s) AS g, b
    FROM (SELECT *, strlen(coalesce(text, '')) AS b, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS s FROM conversations WHERE conv_id IS NOT NULL)),
o AS (SELECT c, list((g, b) ORDER BY i) AS own FROM t GROUP BY c),
x AS (SELECT c, own, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda a: ascii(a)::BIGINT)),
    lambda v, a: list_reduce(list_prepend(xor(v, a), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))) AS r FROM o),
h AS (SELECT c, own, xor(r, 4294967295) % 9 AS h FROM x),
u AS (SELECT h.c, CASE WHEN h.c = h.c - h.c % 5 THEN h.own ELSE list_concat(coalesce(p.own[1:h.h], []), h.own[h.h + 1:]) END AS s FROM h LEFT JOIN o p ON p.c = h.c - h.c % 5),
m AS (SELECT c, len(s) AS n, unnest(range(0, len(s) + 1)) AS d, s FROM u),
k AS (SELECT s[1:d] AS k, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends FROM m GROUP BY s[1:d], d),
n AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE k[d][2] END AS b FROM k),
f AS (SELECT p.k, p.d, count(c.k) AS n_children, any_value(p.conv_id) AS parent_of FROM n p LEFT JOIN n c ON c.d = p.d + 1 AND c.k[1:p.d] = p.k GROUP BY p.k, p.d),
a AS (SELECT unnest(range(0, n.d + 1)) AS up, n.k, n.d, (n.n_convs - 1) * n.b AS saved, (f.n_children = 0)::BIGINT AS leaf FROM n JOIN f ON f.k = n.k AND f.d = n.d),
z AS (SELECT k[1:up] AS k, up AS d, sum(saved) AS saved, sum(leaf) AS leaves FROM a GROUP BY k[1:up], up)
SELECT n.conv_id, n.d::BIGINT AS depth, p.parent_of AS parent_conv_id, n.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, z.leaves::BIGINT AS n_leaves, z.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN f ON f.k = n.k AND f.d = n.d JOIN z ON z.k = n.k AND z.d = n.d LEFT JOIN f p ON n.d > 0 AND p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]""",
}
