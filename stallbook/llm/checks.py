"""Check SQL of the text queries that SQL can express."""

from __future__ import annotations

from stallbook.llm.base import WORD_SQL as WORD
from stallbook.llm.pii import NUMBER_WORDS, SECRET_WORDS, account_pattern

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SHINGLES = f"""SELECT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM (
  SELECT {{key}} AS id, regexp_extract_all(translate(text, {_LETTERS}), '{WORD}') AS w FROM {{table}} WHERE {{key}} IS NOT NULL AND text IS NOT NULL))"""

DECONTAMINATION = f"""
WITH items AS (SELECT DISTINCT * FROM ({_SHINGLES.format(key='item_id', table='benchmark')})),
docs AS (SELECT DISTINCT * FROM ({_SHINGLES.format(key='doc_id', table='documents')}) WHERE s IN (SELECT s FROM items)),
short AS (SELECT DISTINCT item_id, array_to_string(w, ' ') AS s FROM (SELECT item_id, regexp_extract_all(translate(text, {_LETTERS}), '{WORD}') AS w FROM benchmark) WHERE len(w) BETWEEN 1 AND 4 AND item_id IS NOT NULL),
whole AS (SELECT doc_id, array_to_string(regexp_extract_all(translate(text, {_LETTERS}), '{WORD}'), ' ') AS t FROM documents WHERE doc_id IS NOT NULL),
pairs AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM docs d JOIN items i USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM pairs JOIN (SELECT id AS item_id, count(*) AS n_item FROM items GROUP BY 1) USING (item_id) WHERE n_shared * 100 >= n_item * 80
UNION ALL SELECT DISTINCT doc_id, item_id, 1, 1, 1.0 FROM whole JOIN short ON contains(' ' || t || ' ', ' ' || s || ' ')"""

QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
windows AS (SELECT r, i, w[i:i + 2] AS s FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{M}}]'))) AS n_letter_words,
  len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x AND length(x) > 1)) AS n_upper_words,
  length(text) - length(translate(text, '!', '')) AS n_marks,
  len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09]*[-*•]'))) AS n_bullets FROM w LEFT JOIN repeated USING (r)),
f AS (SELECT *, CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT) + 4 * CAST(10 * n_symbols > n_words AS BIGINT)
  + 8 * CAST(word_chars < 2 * n_words AS BIGINT) + 16 * CAST(word_chars > 12 * n_words AS BIGINT) + 32 * CAST(100 * n_dup_lines > 30 * n_lines AS BIGINT)
  + 64 * CAST(100 * n_letter_words < 80 * n_words AS BIGINT) + 128 * CAST(100 * n_upper_words > 50 * n_words AS BIGINT)
  + 256 * CAST(100 * n_marks > 50 * n_words AS BIGINT) + 512 * CAST(100 * n_bullets > 90 * n_lines AND n_lines > 1 AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f"""

_RULES = ["few_words", "repeated_words", "many_symbols", "short_words", "long_words", "duplicate_lines", "few_letters", "shouting", "exclaiming", "bullets"]
RULE_ABLATIONS = f"""
WITH ledger AS ({QUALITY_RULES.strip()}), rules(bit, rule) AS (VALUES {', '.join(f"({1 << k}, '{r}')" for k, r in enumerate(_RULES))})
SELECT rule, count(*) FILTER (WHERE failed & bit <> 0) AS n_failed, count(*) FILTER (WHERE failed = bit) AS n_only, count(*) FILTER (WHERE failed & ~bit = 0) AS n_kept_without
FROM ledger, rules GROUP BY rule"""


def _spans(kind: str, pattern: str, keep: str) -> str:
    """All matches of one kind with their places: the pieces between matches give the distances."""
    return f"""
SELECT r, '{kind}' AS kind, upto - length(m) AS start, upto AS "end", m FROM (
  SELECT r, m, sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i)::BIGINT AS upto FROM (
    SELECT r, unnest(hits) AS m, unnest(gaps[1:len(hits)]) AS gap, unnest(generate_series(1, len(hits))) AS i FROM (
      SELECT r, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM d))) WHERE {keep}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i:
  CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END)) % 10 = 0"""
_ACCOUNT = "replace(m, ' ', '')"
_MOD_97 = f"""list_reduce(list_concat([0], list_transform(string_split({_ACCOUNT}[5:] || {_ACCOUNT}[:4], ''),
  lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END)), lambda a, c: CASE WHEN c < 10 THEN a * 10 + c ELSE a * 100 + c END % 97) = 1"""


def _near(spans: str, words: str) -> str:
    """Spans with one of the words in the 40 characters before or behind them."""
    return f"""
SELECT s.* FROM ({spans}) s JOIN d USING (r) WHERE regexp_matches(substr(text, greatest(start - 39, 1), least(start, 40)) || ' ' || substr(text, "end" + 1, 40), '{words}')"""


_KINDS = "['email', 'ip', 'card', 'phone', 'iban', 'number', 'secret']"

PII = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({_spans('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', 'true')}
UNION ALL {_spans('ip', '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+', "len(list_filter(string_split(m, '.'), lambda x: NOT regexp_matches(x, '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$'))) = 0")}
UNION ALL {_spans('card', '[0-9](?:[ -]?[0-9])+', _LUHN)}
UNION ALL {_spans('phone', '[+][0-9][ ().0-9-]+[0-9]', f'length({_DIGITS}) BETWEEN 9 AND 15')}
UNION ALL {_spans('iban', account_pattern(), _MOD_97)}
UNION ALL {_near(_spans('number', r'\b(?:[A-Z]{0,3}[0-9]{6,12}|[0-9]{3}-[0-9]{2}-[0-9]{4})\b', 'true'), NUMBER_WORDS)}
UNION ALL {_near(_spans('secret', r'\b[A-Za-z0-9_]{16,64}\b', "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')"), SECRET_WORDS)}),
g AS (SELECT r, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card,
  count(*) FILTER (WHERE kind = 'phone') AS n_phone,
  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY list_position({_KINDS}, kind), start) FILTER (WHERE list_position({_KINDS}, kind) < 5) AS base,
  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY list_position({_KINDS}, kind), start) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""

_URL = "coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '')"

#: The given pages state no canonical links or redirects, so that rules alone decide there; tests cover aliases.
URL_FILTER = f"""
WITH p AS (SELECT page_id, translate(regexp_extract({_URL}, '^[^/?#]*'), {_LETTERS}) AS host, regexp_extract({_URL}, '^[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1, 2)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (host, path)"""

_BLANK = r"[\x20\x09-\x0D]"
EXACT_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '{_BLANK}', '', 'g') AS plain FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size, row_number() OVER best = 1 AS kept, sha256(plain) AS text_sha256
FROM d WINDOW best AS (PARTITION BY plain ORDER BY size DESC, doc_id NULLS LAST, row)"""


def _hash_tree(name: str, leaves: str, levels: int) -> list[str]:
    """CTEs of trees over leaves (tree, i, h): nodes and runs of eight, level by level; finished trees are carried on."""
    parts = [f"{name}0 AS (SELECT *, count(*) OVER (PARTITION BY tree) AS w FROM ({leaves}))"]
    for k in range(levels):
        parts.append(f"{name}r{k} AS (SELECT tree, i // 8 AS b, list(h ORDER BY i) AS hs FROM {name}{k} WHERE w > 1 GROUP BY ALL)")
        parts.append(f"""{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS w FROM (
  SELECT tree, b AS i, sha256(array_to_string(hs, '')) AS h FROM {name}r{k} UNION ALL SELECT tree, i, h FROM {name}{k} WHERE w = 1))""")
    return parts


def _climb(name: str, start: str, tree: str, levels: int) -> list[str]:
    """CTEs that take rows (i, x, p, ...) up through the tree `tree`: x is folded with the siblings, which are added to p."""
    parts = [f"{name}0 AS ({start})"]
    for k in range(levels):
        left, right = "array_to_string(hs[1:i % 8], '')", "array_to_string(hs[i % 8 + 2:], '')"
        parts.append(f"""{name}{k + 1} AS (SELECT f.* EXCLUDE (i, x, p), i // 8 AS i, CASE WHEN hs IS NULL THEN x ELSE sha256({left} || x || {right}) END AS x,
  CASE WHEN hs IS NULL THEN p ELSE p || {left} || {right} END AS p FROM {name}{k} f LEFT JOIN {tree}r{k} r ON r.tree = f.tree AND r.b = f.i // 8)""")
    return parts


def _leaf(*fields: str) -> str:
    return "sha256(" + " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}::VARCHAR) || ':' || {f}::VARCHAR END" for f in fields) + ")"


_LEVELS, _OVER = 9, 3
MERKLE_MANIFEST = "WITH " + ",\n".join([
    """crc AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n::BIGINT, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS v FROM range(256) x(n)))""",
    """digits AS (SELECT *, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT) AS ds FROM documents)""",
    """marked AS (SELECT *, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, ds), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295::BIGINT) END AS crc FROM digits, crc)""",
    f"""leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('doc_id', 'source', 'lang', 'n_chars', 'text')} AS leaf,
  CASE WHEN crc % 3 = 0 THEN {_leaf('doc_id', 'source', 'lang', 'n_chars', f"translate(text, {_LETTERS})")} END AS changed FROM marked)""",
    "placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves)",
    *_hash_tree("n", "SELECT tree, i, leaf AS h FROM placed", _LEVELS),
    f"subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM n{_LEVELS})",
    *_hash_tree("m", "SELECT 'all' AS tree, place AS i, subroot AS h FROM subroots", _OVER),
    *_climb("f", "SELECT doc_id, tree, leaf, i, coalesce(changed, leaf) AS x, '' AS p FROM placed", "n", _LEVELS),
    *_climb("g", f"SELECT doc_id, 'all' AS tree, leaf, subroot, place AS i, x, p FROM f{_LEVELS} JOIN subroots USING (tree)", "m", _OVER),
]) + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(p) AS proof_sha256, x AS folded_root, x = h AS verified FROM g{_OVER}, (SELECT h FROM m{_OVER})"""

_PIECE, _TOKEN = r"[.,;:!?\x0A-\x0D]", r"[^\x20\x09]+"
PHRASES = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_LETTERS}), '{_PIECE}')) AS p FROM documents),
ws AS (SELECT lang, regexp_extract_all(p, '{_TOKEN}') AS w FROM pieces),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS n FROM (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM ws), (VALUES (1), (2), (3), (4)) t(k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
found AS (SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND n >= 30),
cuts AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM (SELECT *, unnest(generate_series(1, len(w) - 1)) AS j FROM found)),
scored AS (SELECT c.lang, c.phrase, a, fx.n AS l, fy.n AS r, CAST(2000000::HUGEINT * a // (fx.n + fy.n) AS BIGINT) AS score
  FROM cuts c JOIN f fx ON fx.lang = c.lang AND fx.phrase = x JOIN f fy ON fy.lang = c.lang AND fy.phrase = y
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 2000000::HUGEINT * a // (fx.n + fy.n), j) = 1),
around AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS around FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM found), (VALUES (2), (3)) t(m)
  WHERE m < len(w) AND i + m - 1 <= len(w) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored LEFT JOIN around USING (lang, phrase) JOIN totals USING (lang) WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * a QUALIFY rank <= 2000"""
