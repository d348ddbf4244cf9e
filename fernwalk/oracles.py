"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from fernwalk import queries as q
from fernwalk.constants import B, BLOCKED, BUDGET, DEFAULT_METHOD, DEFAULT_REGION, EXACT_ROUTES, FLAG_SOURCES, K1, LAMBDA, REGIONS, ROUTES
from fernwalk.functions import density as D
from fernwalk.operators import abbreviations as AB
from fernwalk.operators import lexrank as LR


def _text(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows) + f") v({names})"


def _pick(templates, number: str) -> str:
    return f"([{', '.join(map(_text, templates))}])[{number} % {len(templates)} + 1]"


def _below(urls) -> str:
    return f"(SELECT page_id AS id, replace({_pick(urls, 'page_id')}, '@id', CAST(page_id AS VARCHAR)) AS url FROM pages)"


def _written_in_scripts() -> str:
    text = "text"
    for i, c in enumerate(q.LATIN):
        text = f"replace({text}, '{c}', substr({_pick(q.ALPHABETS, 'conv_id')}, {i + 1}, 1))"
    return f"(SELECT conv_id * 10000 + turn AS id, role, CASE WHEN conv_id % 2 = 0 THEN replace(t, '.', '。') ELSE t END AS text FROM (SELECT *, {text} AS t FROM conversations))"


HOST = r"nullif(lower(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@ ]*@)?([^/?#: ]+)(?::\d*)?(?:[/?#][^ ]*)?$', 1)), '')"


def _host(url: str) -> str:
    return HOST.format(url)


def _within(host: str, domains) -> str:
    return "(" + " OR ".join(f"{host} = '{d}' OR {host} LIKE '%.{d}'" for d in domains) + ")"


END = r"[.!?]+\s+|\n+|[。！？]+"
WORD = r"[\p{L}\p{M}]+"


def _sentences(source: str, key: str = "doc_id", text: str = "text") -> str:
    split = f"regexp_split_to_array({text}, '{END}')"
    return (
        f"SELECT {key} AS doc_id, CAST(i - 1 AS INTEGER) AS pos, trim(parts[i]) AS s FROM (SELECT {key}, parts, unnest(range(1, len(parts) + 1)) AS i "
        f"FROM (SELECT {key}, {split} AS parts FROM {source})) WHERE trim(parts[i]) <> ''"
    )


def _words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORD}')"


def _bm25(rows: str, keys: str, text: str) -> str:
    """CTEs that end in ``bm(keys, bm25)``."""
    terms = ", ".join(f"'{t}'" for t in sorted(q.TERMS))
    on = " AND ".join(f"p.{k} = l.{k}" for k in keys.split(", "))
    return f"""
    tok AS (SELECT {keys}, {_words(text)} AS w FROM {rows}),
    ln AS (SELECT {keys}, len(w) AS len FROM tok WHERE len(w) > 0),
    st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS average FROM ln),
    post AS (SELECT {keys}, term, count(*) AS tf FROM (SELECT {keys}, unnest(w) AS term FROM tok) WHERE term IN ({terms}) GROUP BY ALL),
    dfs AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM post GROUP BY term),
    bm AS (SELECT {", ".join(f"p.{k}" for k in keys.split(", "))}, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * ({K1}e0 + 1)
        / (tf + {K1}e0 * (1 - {B}e0 + {B}e0 * l.len / average))), 9) AS bm25
        FROM post p JOIN dfs USING (term) JOIN ln l ON {on} CROSS JOIN st GROUP BY ALL)"""


def _centrality(rows: str) -> str:
    """CTEs that end in ``ce(doc_id, pos, centrality)``."""
    return f"""
    cp AS (SELECT doc_id, pos, term, count(*) AS tf FROM (SELECT doc_id, pos, unnest({_words("s")}) AS term FROM {rows}) GROUP BY ALL),
    cd AS (SELECT doc_id, term, sum(tf) AS dtf FROM cp GROUP BY ALL),
    cn AS (SELECT doc_id, sqrt(CAST(sum(dtf * dtf) AS DOUBLE)) AS norm FROM cd GROUP BY ALL),
    ce AS (SELECT doc_id, pos, round(CAST(sum(tf * dtf) AS DOUBLE) / (sqrt(CAST(sum(tf * tf) AS DOUBLE)) * norm), 9) AS centrality
        FROM cp JOIN cd USING (doc_id, term) JOIN cn USING (doc_id) GROUP BY doc_id, pos, norm)"""


def _links() -> str:
    """CTEs that end in ``near(doc_id, a, b, cosine)``; all pairs of a document's sentences that share a word are compared."""
    return f"""
    lp AS (SELECT doc_id, pos, term, count(*) AS tf FROM (SELECT doc_id, pos, unnest({_words("s")}) AS term FROM sent) GROUP BY ALL),
    ln_ AS (SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) AS n FROM lp),
    ld AS (SELECT term, count(DISTINCT doc_id) AS df FROM lp GROUP BY term),
    lw AS (SELECT doc_id, pos, term, tf * ln(1 + n / df) AS w FROM lp JOIN ld USING (term) CROSS JOIN ln_),
    lo AS (SELECT doc_id, pos, sqrt(sum(w * w)) AS norm FROM lw GROUP BY ALL),
    lu AS (SELECT doc_id, pos, term, w / norm AS w FROM lw JOIN lo USING (doc_id, pos)),
    near AS (SELECT x.doc_id, x.pos AS a, y.pos AS b, round(sum(x.w * y.w), 9) AS cosine FROM lu x JOIN lu y ON x.doc_id = y.doc_id AND x.term = y.term AND x.pos < y.pos
        GROUP BY ALL HAVING round(sum(x.w * y.w), 9) >= {LR.SIMILAR})"""


def _dense() -> str:
    """Pages without the article's marks, by the run of tokens of the largest sum."""
    clean = "regexp_replace(regexp_replace(html, '(?i)</?article[^>]*>', '', 'g'), '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g')"
    text = f"regexp_replace({clean}, '(?i)</?(?:p|br|h1|h2|h3|li|ul|ol|div|tr)(?:[\\s/][^>]*)?>', chr(10), 'g')"
    whole = f"trim({_decode(f"regexp_replace({text.replace(clean, "dense")}, '<[^>]+>', '', 'g')")})"
    return f"""WITH t AS (SELECT page_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM (SELECT page_id, regexp_extract_all({clean}, '<[^>]*>|[^<]+|<') AS tokens FROM pages)),
    w AS (SELECT page_id, tokens, i, CASE WHEN starts_with(tokens[i], '<') AND length(tokens[i]) > 1 THEN -{D.TAG_LOSS} ELSE {D.WORD_GAIN} * len(regexp_extract_all(tokens[i], '[^ \\t\\n\\r]+')) END AS w FROM t),
    s AS (SELECT *, sum(w) OVER (PARTITION BY page_id ORDER BY i) AS upto FROM w),
    z AS (SELECT *, least(0, coalesce(min(upto) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM s),
    e AS (SELECT page_id, any_value(tokens) AS tokens, arg_max(struct_pack(i := i, low := low), struct_pack(v := upto - low, j := -i)) AS x, max(upto - low) AS best FROM z GROUP BY page_id),
    b AS (SELECT e.page_id, e.tokens, e.x.i AS last, coalesce(max(s.i), 0) + 1 AS first FROM e LEFT JOIN s ON s.page_id = e.page_id AND s.i < e.x.i AND s.upto = e.x.low WHERE best > 0 GROUP BY ALL)
    SELECT p.page_id, CASE WHEN b.page_id IS NOT NULL THEN {whole} END AS body FROM pages p LEFT JOIN (SELECT *, array_to_string(tokens[first : last], '') AS dense FROM b) b USING (page_id)"""


def _abbreviations() -> str:
    """CTEs that end in ``ab(word, score)``."""
    return f"""
    tk AS (SELECT unnest(regexp_extract_all(lower(text), '(?:[\\p{{L}}\\p{{M}}]+\\.)*[\\p{{L}}\\p{{M}}]+\\.?')) AS token FROM documents),
    cw AS (SELECT CASE WHEN ends_with(token, '.') THEN token[:-2] ELSE token END AS word, count(*) FILTER (ends_with(token, '.')) AS stopped, count(*) FILTER (NOT ends_with(token, '.')) AS bare FROM tk GROUP BY 1),
    al AS (SELECT CAST(sum(stopped + bare) AS DOUBLE) AS n, CAST(sum(stopped) AS DOUBLE) AS stops FROM cw),
    sc AS (SELECT word, round(-2 * (stopped * ln(stops / n) + CASE WHEN bare > 0 THEN bare * ln(1 - stops / n) ELSE 0e0 END - (stopped * ln({AB.ALWAYS}e0) + bare * ln(1 - {AB.ALWAYS}e0)))
        * exp(-k) * (length(word) - k + 1) * pow(CAST(k AS DOUBLE), CAST(-bare AS DOUBLE)), 9) AS score FROM (SELECT *, length(replace(word, '.', '')) AS k FROM cw) CROSS JOIN al WHERE stopped > 0 AND stops < n),
    ab AS (SELECT word, score FROM sc WHERE score >= {AB.LEAST})"""


def _lexrank() -> str:
    """The walk as a recursive query, step by step; a step's row holds the ranks of one document as a list by place."""
    return f"""WITH RECURSIVE sent AS ({SENT}), {_links()},
    both_ AS (SELECT doc_id, a AS src, b AS dst, cosine FROM near UNION ALL SELECT doc_id, b, a, cosine FROM near),
    shared AS (SELECT doc_id, src, dst, cosine / (1 + sum(cosine) OVER (PARTITION BY doc_id, src)) AS share FROM both_),
    node AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM sent),
    own AS (SELECT node.doc_id, node.pos, node.n, node.i, 1 - coalesce(sum(share), 0) AS own FROM node LEFT JOIN shared ON shared.doc_id = node.doc_id AND src = pos GROUP BY ALL),
    into_ AS (SELECT g.doc_id, g.dst, list(own.i ORDER BY own.i) AS froms, list(g.share ORDER BY own.i) AS shares FROM shared g JOIN own ON own.doc_id = g.doc_id AND own.pos = g.src GROUP BY ALL),
    whole AS (SELECT own.doc_id, any_value(n) AS n, list(own ORDER BY i) AS own, list(coalesce(froms, []) ORDER BY i) AS froms, list(coalesce(shares, []) ORDER BY i) AS shares
        FROM own LEFT JOIN into_ ON into_.doc_id = own.doc_id AND dst = pos GROUP BY own.doc_id),
    walk AS (SELECT doc_id, 0 AS step, list_transform(range(n), lambda x: 1e0 / n) AS p FROM whole
        UNION ALL SELECT doc_id, step + 1, list_transform(range(1, n + 1), lambda i: (1 - {LR.DAMPING}e0) / n + {LR.DAMPING}e0 * (own[i] * p[i]
            + coalesce(list_sum(list_transform(range(1, len(froms[i]) + 1), lambda j: p[froms[i][j]] * shares[i][j])), 0e0))) FROM walk JOIN whole USING (doc_id) WHERE step < {LR.STEPS})
    SELECT own.doc_id, own.pos, round(p[i], 9) AS lexrank FROM walk JOIN own USING (doc_id) WHERE step = {LR.STEPS}"""


def _decode(text: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = f"replace({text}, {_text(a)}, {_text(b)})"
    return text


ARTICLE = "nullif(regexp_extract(html, '(?is)<article(?:\\s[^>]*)?>(.*?)</article>', 1), '')"


def _body() -> str:
    out = f"coalesce({ARTICLE}, html)"
    out = f"regexp_replace({out}, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g')"
    out = f"regexp_replace({out}, '(?i)</?(?:p|br|h1|h2|h3|li|ul|ol|div|tr)(?:[\\s/][^>]*)?>', chr(10), 'g')"
    return f"trim({_decode(f"regexp_replace({out}, '<[^>]+>', '', 'g')")})"


ATTEMPTS = "(SELECT event_id AS url, event_type AS phase, event_type <> 'error' AS ok, 'k' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS VARCHAR) AS error_class, value AS elapsed_ms FROM events)"
SENT = _sentences("documents")
BLOCK = _within("host", q.TEST_BLOCKED)
PAGES_KEPT = f"SELECT page_id, url FROM (SELECT page_id, url, {_host('url')} AS host FROM pages) WHERE NOT coalesce({BLOCK}, false)"


def _route_case() -> str:
    out = "CASE"
    for d, m in ROUTES:
        fits = f"h IN ('{d}', 'www.{d}')" if d in EXACT_ROUTES else _within("h", [d])
        out += f" WHEN {fits} THEN '{m}'"
    return out + f" ELSE '{DEFAULT_METHOD}' END"


def _language(t: str) -> str:
    scripts = (("ja", r"[\x{3040}-\x{30ff}]"), ("zh", r"\p{Han}"), ("ko", r"\p{Hangul}"), ("ru", r"\p{Cyrillic}"), ("ar", r"\p{Arabic}"), ("th", r"\p{Thai}"))
    return f"CASE WHEN {t} IS NULL THEN NULL" + "".join(f" WHEN regexp_matches({t}, '{s}') THEN '{c}'" for c, s in scripts) + " ELSE 'other' END"


BY_LENGTH = f"SELECT doc_id, pos, s, CAST(len({_words('s')}) AS DOUBLE) AS score FROM ({SENT})"


def _scored() -> str:
    """CTEs that end in ``sc(doc_id, pos, s, score)``: the sentences of the pages that are kept."""
    return f"""WITH kept AS (SELECT page_id, {_body()} AS text FROM pages WHERE page_id IN (SELECT page_id FROM ({PAGES_KEPT}))),
    alls AS ({_sentences("kept", "page_id")}),
    sent AS (SELECT doc_id, pos, s FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(s)) ORDER BY doc_id, pos) AS k FROM alls) WHERE k = 1),
    {_bm25("sent", "doc_id, pos", "s")}, {_centrality("sent")},
    sc AS (SELECT sent.doc_id, sent.pos, s, round(coalesce(bm25, 0e0) + {LAMBDA}e0 * coalesce(centrality, 0e0), 6) AS score FROM sent LEFT JOIN bm USING (doc_id, pos) LEFT JOIN ce USING (doc_id, pos))"""


def oracles() -> dict[str, str]:
    cjk = r"^[\x{3040}-\x{30ff}\p{Han}\p{Hangul}]+$"
    region = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REGIONS.items()) + f" ELSE '{DEFAULT_REGION}' END"
    return {
        "url_host": f"SELECT page_id, {_host('url')} AS host FROM pages",
        "blocklist_filter": PAGES_KEPT,
        "blocklist_table_filter": PAGES_KEPT,
        "blocklist_domains": f"SELECT id, url FROM (SELECT id, url, {_host('url')} AS host FROM {_below(q.BLOCKED_URLS)}) WHERE NOT coalesce({_within('host', BLOCKED)}, false)",
        "route_by_host": f"SELECT page_id, coalesce(method, '{DEFAULT_METHOD}') AS method FROM (SELECT page_id, {_host('url')} AS host FROM pages) LEFT JOIN {_values(q.TEST_ROUTES, 'host, method')} USING (host)",
        "route_known_hosts": f"SELECT id, {_route_case()} AS method FROM (SELECT id, {_host('url')} AS h FROM {_below(q.ROUTED_URLS)})",
        "article_extract": f"SELECT page_id, {ARTICLE} AS article FROM pages",
        "html_to_text": f"SELECT page_id, {_body()} AS body FROM pages",
        "sentence_split": SENT,
        "min_sentence_length": f"SELECT * FROM ({SENT}) WHERE length(s) >= 20",
        "term_freq": f"SELECT doc_id, pos, term, count(*) AS tf FROM (SELECT doc_id, pos, unnest({_words('s')}) AS term FROM ({SENT})) GROUP BY ALL",
        "bm25_docs": f"WITH {_bm25('documents', 'doc_id', 'text')} SELECT doc_id, bm25 FROM bm",
        "bm25_sentences_top3": f"WITH sent AS ({SENT}), {_bm25('sent', 'doc_id, pos', 's')} SELECT * FROM (SELECT doc_id, pos, bm25, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY bm25 DESC, pos) AS INTEGER) AS rk FROM bm) WHERE rk <= {q.SENTENCES_KEPT}",
        "sentence_centrality": f"WITH sent AS ({SENT}), {_centrality('sent')} SELECT * FROM (SELECT doc_id, pos, centrality, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY centrality DESC, pos) AS INTEGER) AS rk FROM ce) WHERE rk <= {q.CENTRAL_KEPT}",
        "cross_page_dedup": f"SELECT doc_id, pos, s FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(s)) ORDER BY doc_id, pos) AS n FROM ({SENT})) WHERE n = 1",
        "budget_prefix": f"SELECT doc_id, pos, CAST(used AS BIGINT) AS used FROM (SELECT doc_id, pos, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING) AS used FROM ({BY_LENGTH})) WHERE used <= 400",
        "budget_skip": f"""WITH RECURSIVE r AS (SELECT doc_id, pos, length(s) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rk FROM ({BY_LENGTH})),
            f AS (SELECT doc_id, rk, pos, n <= 400 AS take, CASE WHEN n <= 400 THEN n ELSE 0 END AS used FROM r WHERE rk = 1
            UNION ALL SELECT r.doc_id, r.rk, r.pos, f.used + r.n <= 400, CASE WHEN f.used + r.n <= 400 THEN f.used + r.n ELSE f.used END FROM f JOIN r ON r.doc_id = f.doc_id AND r.rk = f.rk + 1)
            SELECT doc_id, pos FROM f WHERE take""",
        "search_compress": f"""{_scored()} SELECT doc_id, pos, s, score FROM (SELECT *, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING) AS used FROM sc) WHERE used <= {BUDGET}""",
        "search_total": f"{_scored()} SELECT doc_id, pos, s, score FROM (SELECT *, sum(length(s)) OVER (ORDER BY score DESC, doc_id, pos ROWS UNBOUNDED PRECEDING) AS used FROM sc) WHERE used <= {q.ANSWER_BUDGET}",
        "batch_bm25_top5": f"""WITH qs AS (SELECT row_number() OVER () AS r, conv_id, turn, unnest(list_distinct({_words("text")})) AS term FROM conversations WHERE role = 'user'),
            tok AS (SELECT doc_id, {_words("text")} AS w FROM documents), ln AS (SELECT doc_id, len(w) AS len FROM tok WHERE len(w) > 0),
            st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS average FROM ln),
            post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM tok) WHERE term IN (SELECT term FROM qs) GROUP BY ALL),
            dfs AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM post GROUP BY term),
            bm AS (SELECT r, conv_id, turn, doc_id, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * ({K1}e0 + 1) / (tf + {K1}e0 * (1 - {B}e0 + {B}e0 * len / average))), 6) AS bm25
                FROM qs JOIN post USING (term) JOIN dfs USING (term) JOIN ln USING (doc_id) CROSS JOIN st GROUP BY ALL)
            SELECT conv_id, turn, doc_id, bm25, rk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY bm25 DESC, doc_id) AS INTEGER) AS rk FROM bm) WHERE rk <= {q.BATCH_TOP}""",
        "sentence_links": f"WITH sent AS ({SENT}), {_links()} SELECT * FROM near",
        "sentence_lexrank": _lexrank(),
        "char_references": f"SELECT page_id, {_decode("html").replace("' ')", "chr(160))")} AS plain FROM pages",
        "density_extract": _dense(),
        "learned_abbreviations": f"WITH {_abbreviations()} SELECT * FROM ab",
        "stream_first_page": f"SELECT doc_id, pos, s FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(s)) ORDER BY doc_id, pos) AS n FROM ({SENT})) WHERE n = 1",
        "event_sessions": """WITH e AS (SELECT user_id AS user, ts, event_type, value, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true) AS fresh FROM events),
            s AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
            SELECT user, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, count(*) FILTER (event_type = 'error') AS failures, round(sum(value), 4) AS total_ms, max(value) AS longest_ms FROM s GROUP BY user, k""",
        "phase_sketches": f"SELECT phase, count(*) AS n, max(elapsed_ms) AS max_ms, true AS within FROM {ATTEMPTS} GROUP BY phase",
        "budget_total": f"SELECT doc_id, pos, CAST(used AS BIGINT) AS used FROM (SELECT doc_id, pos, sum(length(s)) OVER (ORDER BY score DESC, doc_id, pos ROWS UNBOUNDED PRECEDING) AS used FROM ({BY_LENGTH})) WHERE used <= {q.TOTAL_BUDGET}",
        "running_spend": "SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM events",
        "top5_per_source": "SELECT * FROM (SELECT source, doc_id, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rk FROM documents) WHERE rk <= 5",
        "top50_results": "SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50",
        "source_union": "SELECT doc_id, 'web' AS kind, n_chars FROM documents WHERE source IS NOT DISTINCT FROM 'src0' UNION ALL SELECT doc_id, 'bonus', NULL FROM documents WHERE source IS DISTINCT FROM 'src0'",
        "fallback_source": "WITH t AS (SELECT doc_id, lang AS query_id, source, coalesce(source = 'src1' AND lang <> 'en', false) AS first FROM documents), p AS (SELECT * FROM t WHERE first) SELECT doc_id, query_id, source FROM p UNION ALL SELECT doc_id, query_id, source FROM t WHERE NOT first AND NOT EXISTS (SELECT 1 FROM p WHERE p.query_id = t.query_id)",
        "fallback_whole": "SELECT doc_id, source FROM documents WHERE source = 'none' UNION ALL SELECT doc_id, source FROM documents WHERE source IS DISTINCT FROM 'none' AND NOT EXISTS (SELECT 1 FROM documents WHERE source = 'none')",
        "per_url_fallback": "SELECT d.doc_id, coalesce(CASE WHEN lang = 'en' THEN n_chars END, CAST(quality AS BIGINT)) AS body FROM documents d LEFT JOIN labels l USING (doc_id)",
        "prefer_open_access": "SELECT a.page_id AS id, coalesce(b.url, a.url) AS url FROM pages a LEFT JOIN pages b ON b.page_id = a.page_id + 1 AND a.page_id % 3 = 0",
        "entity_decode": f"SELECT id, {_decode('t')} AS plain FROM (SELECT CAST(-id AS BIGINT) AS id, t FROM {_values(q.ENTITY_TEXTS, 'id, t')} UNION ALL SELECT page_id, html FROM pages)",
        "citation_strip": rf"SELECT id, regexp_replace(t, '\[\d+\]', '', 'g') AS plain FROM (SELECT CAST(-id AS BIGINT) AS id, t FROM {_values(q.WIKI_TEXTS, 'id, t')} UNION ALL SELECT doc_id, text FROM documents)",
        "cjk_sentences": _sentences(_written_in_scripts(), "id"),
        "cjk_bigrams": f"""SELECT id, CAST(i - 1 AS INTEGER) AS pos, terms[i] AS term FROM (SELECT id, terms, unnest(range(1, len(terms) + 1)) AS i FROM
            (SELECT id, flatten(list_transform({_words('text')}, lambda w: CASE WHEN regexp_matches(w, '{cjk}') THEN list_transform(range(1, greatest(length(w) - 1, 1) + 1), lambda k: substr(w, k, 2)) ELSE [w] END)) AS terms
            FROM {_written_in_scripts()}))""",
        "flag_sources": f"SELECT DISTINCT concat_ws(':', conv_id, turn, role) AS query_id, source FROM conversations JOIN {_values(q.FLAG_WORDS, 'flag, word')} ON contains(text, word) JOIN (SELECT * FROM {_values(FLAG_SOURCES, 'flag, source')}) c USING (flag)",
        "query_language": f"SELECT id, lang, {region} AS region FROM (SELECT id, {_language('text')} AS lang FROM {_written_in_scripts()} WHERE role = 'user')",
        "conversation_language": f"SELECT conv_id, turn, role, {_language('text')} AS lang FROM conversations",
        "phase_p95": f"SELECT phase, count(*) AS n, round(avg(elapsed_ms), 4) AS avg_ms, max(elapsed_ms) AS max_ms, round(quantile_cont(elapsed_ms, 0.95), 4) AS p95_ms FROM {ATTEMPTS} GROUP BY phase",
        "failure_breakdown": f"SELECT coalesce(error_class, 'unknown') AS error_class, count(*) AS n FROM {ATTEMPTS} WHERE NOT ok GROUP BY ALL",
        "slow_urls": f"SELECT url, phase, elapsed_ms FROM {ATTEMPTS} ORDER BY elapsed_ms DESC, url LIMIT {q.SLOWEST}",
        "ok_results": f"SELECT url, phase FROM {ATTEMPTS} WHERE ok",
        "json_field": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
        "rank_fusion": f"SELECT user_id, round(sum(1e0 / (60 + rk)), 9) AS score FROM (SELECT user_id, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, user_id) AS rk FROM (SELECT event_type, user_id, round(sum(value), 2) AS v FROM events GROUP BY ALL)) WHERE rk <= {q.FUSED} GROUP BY user_id",
    }
