"""DuckDB twins of the registered queries of this subpackage."""

from litfeed.llm.quality import SENTENCE_MARK, TERMINAL, WRAPPED

ORACLES: dict[str, str] = {}

_SP = r"[\x20\x09-\x0D]+"

# a line goes on in the next one unless it ends a sentence, one of them is blank, or it is long and the next one starts with a capital
_END = rf"[{TERMINAL}…][\p{{Pe}}\p{{Pf}}\"''*_]{{0,4}}[\x20\t\r]{{0,8}}$"
_CAPITAL = r"^[^\p{L}\p{N}]{0,8}[\p{Lu}\p{Lt}]"
_BLANK = r"^[\x20\x09-\x0D]*$"
_SHORT_BLANK = r"^[\x20\x09\x0B-\x0D]{0,80}$"
_MARKS = r"[#*$%&|<>{}\[\]=+~^_\\@]"
_FURNITURE = (r"(?i)\b(accept (all )?cookies|we use cookies|this (web)?site uses cookies|cookie (policy|settings)"
              r"|enable javascript|privacy policy|terms (of use|of service|and conditions)|skip to (main )?content"
              r"|sign (in|up)|log ?in|subscribe (now|to our)|share (this|on)|follow us|read more|click here"
              r"|back to top|add to cart|lorem ipsum)\b")


def _n(pattern: str) -> str:
    return f"(length(line) - length(regexp_replace(line, '{pattern}', '', 'g')))"


ORACLES["op6_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{_SP}'), lambda x: x <> '') AS ws FROM d),
wins AS (SELECT r, i, list_aggregate(ws[i:i+7], 'string_agg', ' ') AS win
         FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt
          FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM wins) WHERE c > 1),
rep AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM twice GROUP BY r),
split AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM w),
cuts AS (SELECT *, coalesce(lag(regexp_matches(line, '{_END}') OR regexp_matches(line, '{_SHORT_BLANK}')) OVER o
    OR regexp_matches(line, '{_BLANK}')
    OR (lag(length(line)) OVER o > {WRAPPED} AND regexp_matches(line, '{_CAPITAL}')), true) AS cut
  FROM split WINDOW o AS (PARTITION BY r ORDER BY i)),
blocks AS (SELECT *, sum(cut::INT) OVER (PARTITION BY r ORDER BY i) AS block FROM cuts),
lines AS (SELECT *, bool_or(regexp_matches(line, '{SENTENCE_MARK}')) OVER (PARTITION BY r, block) AS marked FROM blocks),
judged AS (
  SELECT r, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS full_line,
    (n >= 12 AND NOT marked) OR {_n(_MARKS)} > 0.15 * length(line)
    OR (n >= 3 AND up > 0.7 * (up + lo) AND 2 * {_n('!')} >= n)
    OR (sep >= 3 AND n <= 4 * sep) OR (n <= 20 AND regexp_matches(line, '{_FURNITURE}')) AS bad
  FROM (SELECT *, len(list_filter(string_split_regex(line, '{_SP}'), lambda x: x <> '')) AS n,
          {_n(r'\p{Lu}')} AS up, {_n(r'\p{Ll}')} AS lo, {_n('[|»›•→]')} AS sep FROM lines)),
per_doc AS (
  SELECT r, count(*) FILTER (full_line) - count(DISTINCT line) FILTER (full_line) AS dups,
    count(*) FILTER (full_line AND bad) AS n_bad, coalesce(sum(length(line)) FILTER (full_line AND bad), 0) AS lost,
    sum(length(line)) AS total FROM judged GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{_SP}', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, dups::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, n_bad::BIGINT AS n_bad_lines, lost::BIGINT AS lost_chars, total
  FROM w JOIN per_doc USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_chars <= 0.4 * total) AS kept,
  n_bad_lines, lost_chars
FROM m"""

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _worded(source: str, ident: str) -> str:
    return rf"""
SELECT {ident}, row_number() OVER () AS r, list_filter(string_split_regex({_LOWER}, '{_GAP}'), lambda x: x <> '') AS ws FROM {source}"""


# items of fewer than five words: among the documents' shingles of their own length
ORACLES["op9_decontamination"] = f"""
WITH dw AS ({_worded('documents', 'doc_id')}), qw AS (SELECT *, least(len(ws), 5) AS k FROM ({_worded('benchmark', 'item_id')}) WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM qw),
ds AS (SELECT DISTINCT r, doc_id, k, list_aggregate(ws[i:i+k-1], 'string_agg', ' ') AS s
       FROM (SELECT r, doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw CROSS JOIN ks WHERE len(ws) >= k)),
qs AS (SELECT DISTINCT r, item_id, k, list_aggregate(ws[i:i+k-1], 'string_agg', ' ') AS s
       FROM (SELECT r, item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM qw)),
n AS (SELECT r, count(*) AS n_item FROM qs GROUP BY r)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM ds JOIN qs USING (k, s) JOIN n ON n.r = qs.r
GROUP BY ds.r, doc_id, qs.r, item_id
HAVING count(*) >= 0.8 * any_value(n_item)"""


# base32 digits of a SHA-1: five hex digits are four of them
_BASE32 = "list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', " \
    "(((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::INT >> (5 * (3 - i % 4))::INT) & 31) + 1)::INT, 1)), 'string_agg', '')"

ORACLES["op4_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER () AS r FROM pages),
d AS (SELECT page_id, r, strlen(html) AS n, sha1(html) AS h FROM p),
t AS (SELECT *, first_value(page_id) OVER w AS top, row_number() OVER w AS k FROM d
      WINDOW w AS (PARTITION BY h, n ORDER BY page_id DESC NULLS LAST, r))
SELECT page_id, n::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to
FROM t"""


def _told(col: str) -> str:
    return f"coalesce(strlen({col}::VARCHAR)::VARCHAR || ':' || {col}::VARCHAR, '-')"


_SHIFTS = ", ".join(["-1"] * 8)


def _crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text up to U+07FF: each byte is mixed in, then eight shifts (-1)."""
    steps = (f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT, {_SHIFTS}] "
             f"ELSE [192 + (ord(c) >> 6)::BIGINT, {_SHIFTS}, 128 + (ord(c) & 63)::BIGINT, {_SHIFTS}] END))")
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) "
            f"ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT)")


def _levels(leaves: str) -> str:
    """All nodes of trees of three over ``leaves(g, pos, n, dg)``."""
    return f"""
SELECT 0 AS lvl, g, pos, n, dg FROM {leaves}
UNION ALL SELECT lvl + 1, g, pos // 3, (n + 2) // 3, sha256(string_agg(dg, '' ORDER BY pos)) FROM (SELECT * FROM {{self}}) t WHERE n > 1
GROUP BY lvl, g, pos // 3, (n + 2) // 3"""


def _steps(leaves: str, nodes: str, first: int) -> str:
    """(g, pos of the leaf, order, before, after): the siblings on the way from each leaf to its top."""
    return f"""
SELECT l.g, l.pos, {first} + s.lvl AS k, coalesce(string_agg(s.dg, '' ORDER BY s.pos) FILTER (s.pos < l.pos // (3 ** s.lvl)::BIGINT), '') AS before,
  coalesce(string_agg(s.dg, '' ORDER BY s.pos) FILTER (s.pos > l.pos // (3 ** s.lvl)::BIGINT), '') AS after
FROM {leaves} l JOIN {nodes} s ON s.g = l.g AND s.n > 1 AND s.pos // 3 = l.pos // (3 ** (s.lvl + 1))::BIGINT
GROUP BY l.g, l.pos, s.lvl"""


_FIELDS = ("doc_id", "source", "lang", "n_chars")
ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE h AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, sha256({' || '.join(map(_told, (*_FIELDS, 'text')))}) AS leaf,
    CASE WHEN {_crc32('doc_id::VARCHAR')} % 2 = 0 THEN sha256({' || '.join(map(_told, _FIELDS))} || {_told("replace(text, chr(10), '')")})
      ELSE sha256({' || '.join(map(_told, (*_FIELDS, 'text')))}) END AS found FROM documents),
leaves AS (SELECT *, leaf AS dg, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM h),
nodes AS ({_levels('leaves').replace('{self}', 'nodes')}),
subroots AS (SELECT g AS of, dg, '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
crown AS ({_levels('subroots').replace('{self}', 'crown')}),
own AS ({_steps('leaves', 'nodes', 0)}), top AS ({_steps('subroots', 'crown', 100)}),
steps AS (SELECT * FROM own UNION ALL
  SELECT l.g, l.pos, t.k, t.before, t.after FROM leaves l JOIN subroots s ON s.of = l.g JOIN top t ON t.pos = s.pos),
paths AS (SELECT g, pos, string_agg(before || after, '' ORDER BY k) AS proof, list(before || '|' || after ORDER BY k) AS way FROM steps GROUP BY g, pos),
folded AS (
  SELECT l.doc_id, l.leaf, s.dg AS subroot, (SELECT dg FROM crown WHERE n = 1) AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
    list_reduce(list_prepend(l.found, coalesce(p.way, []::VARCHAR[])),
                lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
  FROM leaves l JOIN subroots s ON s.of = l.g LEFT JOIN paths p ON p.g = l.g AND p.pos = l.pos)
SELECT *, folded_root = root AS verified FROM folded"""


ORACLES["op13_spelling_variants"] = f"""
WITH RECURSIVE runs AS (
  SELECT d, run, count(*) AS k FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS d,
      translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents) WHERE length(run) >= 6 GROUP BY d, run),
hashed AS (SELECT *, {_crc32("d || ':' || run")} AS h FROM runs),
words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (SELECT word, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)),
pairs AS (
  SELECT x.word AS w, y.word AS v FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word FROM cut x JOIN words y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word FROM cut x JOIN words y ON x.a || x.b = y.word),
near AS (SELECT w, count(*) AS n_near, arg_min({{'word': v, 'n': n}}, {{'a': -n, 'b': v}}) AS best FROM pairs JOIN words ON words.word = v GROUP BY w),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 5 * n THEN best.word END AS form, CASE WHEN best.n >= 5 * n THEN best.n END AS form_n
  FROM words LEFT JOIN near ON w = word),
walk AS (
  SELECT word, word AS here, form AS nxt FROM forms
  UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN forms f ON f.word = walk.nxt)
SELECT forms.*, here AS root FROM forms JOIN walk ON walk.word = forms.word AND walk.nxt IS NULL"""
