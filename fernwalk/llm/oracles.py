"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from fernwalk.llm import line_frequency as L
from fernwalk.llm import mixing as M
from fernwalk.llm.url_filters import HOST_RULES, PATTERN_RULES

SPACES = r"\x20\x09-\x0D"

# Base 32 of a SHA-1: character i takes five bits, which lie in two hexadecimal digits.
_DIGIT = "(strpos('0123456789abcdef', substr(h, {0}, 1)) - 1)"
_BASE32 = (
    "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((("
    + _DIGIT.format("(5 * i) // 4 + 1")
    + " * 16 + "
    + _DIGIT.format("(5 * i) // 4 + 2")
    + ") >> CAST(3 - (5 * i) % 4 AS BIGINT)) & 31) AS BIGINT), 1)), '')"
)

OP1 = f"""
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h,
    max(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS first FROM pages)"""

OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{SPACES}]+') AS w FROM documents),
n AS (SELECT r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols FROM d),
line AS (SELECT r, source, x, trim(regexp_replace(lower(x), '[{SPACES}]+', ' ', 'g')) AS y FROM (SELECT r, source, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^{SPACES}]')),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines FROM line GROUP BY r),
win AS (SELECT r, i, array_to_string(w[i : i + {L.WINDOW - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {L.WINDOW - 2})) AS i FROM d WHERE len(w) >= {L.WINDOW})),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + {L.WINDOW})) AS p FROM again) GROUP BY r),
long AS (SELECT r, source, y, len(string_split(y, ' ')) AS n FROM line),
host AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
often AS (SELECT source, y FROM (SELECT source, y, count(DISTINCT r) AS c FROM long GROUP BY source, y) o WHERE c >= {L.MIN_DOCS}
    AND (c > {L.MAX_DOCS} OR {L.MAX_SHARE} * c > (SELECT max(docs) FROM host h WHERE h.source IS NOT DISTINCT FROM o.source))),
gone AS (SELECT r, sum(n) AS n_removed FROM long l JOIN often o ON l.y = o.y AND l.source IS NOT DISTINCT FROM o.source GROUP BY r),
a AS (SELECT n.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed, 0) AS n_removed,
    n_words < {L.MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {L.MAX_REPEATED} * n_words AS base_failed
    FROM n LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND 100 * (n_words - n_removed) >= {L.KEEP_PERCENT} * n_words AND n_words - n_removed >= {L.MIN_WORDS} AS kept, CAST(n_removed AS BIGINT) AS n_removed_words FROM a"""

OP6 = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^{SPACES}]+')) AS BIGINT) AS size, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {M.HASH_BITS // 4}) AS h FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY source),
w AS (SELECT *, list_value({", ".join(map(str, M.WEIGHTS))})[(r - 1) % {len(M.WEIGHTS)} + 1] AS w FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM p)),
o AS (SELECT *, sum(s) OVER () AS total, coalesce(sum({M.MOST} * s) OVER (ORDER BY s / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(w) OVER (ORDER BY s / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above FROM w),
f AS (SELECT *, {M.MOST} * s * above <= (total - below) * w AS isfull FROM o),
g AS (SELECT source, s, CASE WHEN isfull THEN CAST({M.MOST} * s AS DOUBLE) ELSE round(CAST(total - sum(CASE WHEN isfull THEN {M.MOST} * s ELSE 0 END) OVER () AS DOUBLE)
    / CAST(sum(CASE WHEN isfull THEN 0 ELSE w END) OVER () AS DOUBLE) * w, 6) END AS target FROM f),
k AS (SELECT *, target - copies * s AS rest FROM (SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS copies FROM g)),
b AS (SELECT source, h, sum(size) AS own FROM d GROUP BY ALL),
u AS (SELECT source, h, own, sum(own) OVER (PARTITION BY source ORDER BY h) AS upto FROM b)
SELECT d.doc_id, d.size, k.s AS source_size, k.target, CAST(d.size * (k.copies + CASE WHEN u.upto <= k.rest OR (u.upto - u.own <= k.rest AND u.upto - k.rest < k.rest - (u.upto - u.own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source JOIN u ON d.source IS NOT DISTINCT FROM u.source AND d.h = u.h"""

_AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _fits(r) -> str:
    return f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"


def _any(action: str) -> str:
    tests = [f"regexp_matches({_AZ.format('coalesce(url, chr(32))')}, '(?s){r.regex()}')" for r in PATTERN_RULES if r.action == action]
    return " OR ".join(tests) or "false"


_RULES = sorted(HOST_RULES, key=lambda r: -len(r.name))
OP9 = f"""
WITH s AS (SELECT page_id, url, {_AZ.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.name}'" for r in _RULES)} END AS rule FROM s)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r.name}' THEN '{r.action}'" for r in _RULES)} WHEN ({_any("block")}) AND NOT ({_any("allow")}) THEN 'block' ELSE 'allow' END AS verdict FROM r"""

_TERMS_OF = "regexp_extract_all({0}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')".replace("{0}", _AZ.format("coalesce({0}, '')"))
OP11 = f"""
WITH q AS (SELECT row_number() OVER () AS item, item_id, unnest(list_distinct({_TERMS_OF.format("text")})) AS term FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_OF.format("text")} AS w FROM documents),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t CROSS JOIN s GROUP BY term, n),
m AS (SELECT r, doc_id, 100 - 50 + ((50 * len(w) * n) // l) AS m FROM d CROSS JOIN s),
x AS (SELECT item, item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0) WHERE rank <= 50"""

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS whole FROM t GROUP BY ALL HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS v, sum(whole) AS words FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n FROM t GROUP BY ALL),
k AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS size, v.v, v.words, kept.whole
    FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (size + v) AS p, 1 + (1000000000 * (whole + 1)) // (words + v) AS q FROM k),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
two AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
one AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM two UNION ALL SELECT * FROM one))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200"""

ORACLES: dict[str, str] = {"op1_warc_bundles": OP1, "op4_line_frequency": OP4, "op6_source_mixing": OP6, "op9_url_filters": OP9, "op11_lexical_search": OP11, "op12_source_divergence": OP12}
