"""DuckDB SQL for the queries on payloads."""

from __future__ import annotations

from fernwalk import payload_queries as q
from fernwalk.oracles import _decode, _host, _pick, _route_case

NONE = "CAST(NULL AS VARCHAR)"
#: Of each JSON service the hits, and of a hit ``h`` the URL, title, snippet, open-access address and metrics.
JSON_HITS = {
    "hackernews": ("$.hits[*]", "coalesce(h->>'$.url', 'https://news.ycombinator.com/item?id=' || (h->>'$.objectID'))", "$.title", "$.story_text", None, {"points": "$.points", "comments": "$.num_comments"}),
    "stackoverflow": ("$.items[*]", "h->>'$.link'", "$.title", "$.body", None, {"score": "$.score", "answers": "$.answer_count"}),
    "devto": ("$[*]", "h->>'$.url'", "$.title", "$.description", None, {"reactions": "$.positive_reactions_count"}),
    "github": ("$.items[*]", "h->>'$.html_url'", "$.full_name", "$.description", None, {"stars": "$.stargazers_count"}),
    "openalex": ("$.results[*]", "h->>'$.id'", "$.display_name", None, "$.open_access.oa_url", {"citations": "$.cited_by_count"}),
    "semanticscholar": ("$.data[*]", "h->>'$.url'", "$.title", "$.abstract", "$.openAccessPdf.url", {"citations": "$.citationCount"}),
    "europepmc": ("$.resultList.result[*]", "'https://europepmc.org/article/' || (h->>'$.source') || '/' || (h->>'$.id')", "$.title", "$.abstractText", "$.fullTextUrlList.fullTextUrl[0].url", {"citations": "$.citedByCount"}),
    "pubmed": ("$.esearchresult.idlist[*]", "'https://pubmed.ncbi.nlm.nih.gov/' || (h->>'$') || '/'", "$", None, None, {}),
    **{s: ("$.results[*]", "h->>'$.url'", "$.title", "$.snippet", None, {}) for s in ("web", "web_fallback", "news", "discussions")},
}


def _plain(markup: str) -> str:
    return _decode(rf"trim(regexp_replace(regexp_replace({markup}, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))")


def _filled(templates) -> str:
    text = f"regexp_replace(coalesce(text, ''), '{q.UNSAFE}', ' ', 'g')"
    out = _pick(templates, "doc_id")
    for mark, value in (("@id", "CAST(doc_id AS VARCHAR)"), ("@n", "CAST(coalesce(n_chars, 0) AS VARCHAR)"), ("@title", f"regexp_extract({text}, '{q.TITLE}')"), ("@text", text)):
        out = f"replace({out}, '{mark}', {value})"
    return out


def _hits(source: str, hits: str) -> str:
    rows = f"(SELECT CAST(doc_id AS VARCHAR) AS query_id, {_filled(q.search_templates(source))} AS payload FROM documents)"
    return f"(SELECT query_id, unnest(hits) AS h, CAST(unnest(range(1, len(hits) + 1)) AS INTEGER) AS rank FROM (SELECT query_id, {hits} AS hits FROM {rows}))"


def _json(source: str) -> str:
    path, url, title, snippet, oa, metrics = JSON_HITS[source]
    at = lambda p: NONE if p is None else f"h->>'{p}'"
    counts = "".join(f", CAST(h->>'{p}' AS DOUBLE) AS {m}" for m, p in metrics.items())
    hits = f"json_extract(CASE WHEN json_valid(payload) THEN payload END, '{path}')"
    return f"SELECT query_id, rank, {url} AS url, {at(title)} AS title, {at(snippet)} AS snippet, {at(oa)} AS oa_url{counts} FROM {_hits(source, hits)}"


def _atom(source: str) -> str:
    tag = lambda t: _decode(rf"trim(regexp_replace(regexp_extract(h, '(?s)<{t}[^>]*>(.*?)</{t}>', 1), '\s+', ' ', 'g'))")
    hits = "regexp_extract_all(payload, '(?s)<entry>.*?</entry>')"
    return f"SELECT query_id, rank, {tag('id')} AS url, {tag('title')} AS title, {tag('summary')} AS snippet, {tag('id')} AS oa_url FROM {_hits(source, hits)}"


def _pubmed() -> str:
    title = _plain("regexp_extract(h, '(?s)<ArticleTitle[^>]*>(.*?)</ArticleTitle>', 1)")
    abstract = _plain("array_to_string(regexp_extract_all(h, '(?s)<AbstractText[^>]*>(.*?)</AbstractText>', 1), ' ')")
    hits = "regexp_extract_all(payload, '(?s)<PubmedArticle[ >].*?</PubmedArticle>')"
    return f"SELECT query_id, rank, 'https://pubmed.ncbi.nlm.nih.gov/' || regexp_extract(h, '<PMID[^>]*>([0-9]+)<', 1) || '/' AS url, {title} AS title, nullif({abstract}, '') AS snippet, {NONE} AS oa_url FROM {_hits('pubmed', hits)}"


def _result_page(source: str) -> str:
    link = _decode("regexp_extract(h, 'href=\"([^\"]*)\"', 1)")
    title = _plain("regexp_extract(h, '(?s)>(.*?)</a>', 1)")
    snippet = _plain("regexp_extract(h, '(?s)class=\"result__snippet\"[^>]*>(.*?)</a>', 1)")
    hits = "string_split(payload, 'class=\"result__a\"')[2:]"
    return f"""SELECT query_id, rank, CASE WHEN link LIKE '%uddg=%' THEN url_decode(regexp_extract(link, '[?&]uddg=([^&]+)', 1)) ELSE regexp_replace(link, '^//', 'https://') END AS url,
        {title} AS title, nullif({snippet}, '') AS snippet, {NONE} AS oa_url FROM (SELECT *, {link} AS link FROM {_hits(source, hits)}) WHERE link NOT LIKE '%duckduckgo.com/y.js%'"""


def _feed(source: str) -> str:
    raw = lambda t: rf"regexp_extract(h, '(?s)<{t}>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{t}>', 1)"
    hits = "regexp_extract_all(payload, '(?s)<item[ >].*?</item>')"
    return f"SELECT query_id, rank, {_plain(raw('link'))} AS url, {_plain(raw('title'))} AS title, nullif({_plain(raw('description'))}, '') AS snippet, {NONE} AS oa_url FROM {_hits(source, hits)}"


def _searched() -> str:
    """Dev.to's answers to a search by text."""
    hits = "json_extract(CASE WHEN json_valid(payload) THEN payload END, '$.result[*]')"
    return f"SELECT query_id, rank, 'https://dev.to' || (h->>'$.path') AS url, h->>'$.title' AS title, h->>'$.highlight.body_text[0]' AS snippet, {NONE} AS oa_url, CAST(h->>'$.public_reactions_count' AS DOUBLE) AS reactions FROM {_hits('devto', hits)}"


def _markdown(raw: str) -> str:
    for pattern, plain in (
        (r"(?m)^```.*$", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?m)^ {0,3}#{1,6}\s+", ""), (r"(?m)^ {0,3}[-*+] +", ""), (r"(\*\*|__|`)", ""),
    ):
        raw = f"regexp_replace({raw}, '{pattern}', '{plain}', 'g')"
    return f"trim({raw})"


def _page(method: str) -> str:
    at = lambda p: f"json_extract_string(j, '{p}')"
    joined = lambda *ps: f"concat_ws(chr(10), {', '.join(map(at, ps))})"
    atom = lambda t: rf"trim(regexp_replace(regexp_extract(raw, '(?s)<entry>.*?<{t}[^>]*>(.*?)</{t}>', 1), '\s+', ' ', 'g'))"
    body, counts = {
        "fxtwitter": (joined("$.tweet.author.name", "$.tweet.text"), {"likes": "$.tweet.likes", "retweets": "$.tweet.retweets"}),
        "snippet": ("snippet", {}),
        "mediawiki": (rf"regexp_replace({at('$.query.pages[0].extract')}, '\[\d+\]', '', 'g')", {}),
        "github": (_markdown("raw"), {}),
        "arxiv": (f"concat_ws(chr(10), {atom('title')}, {atom('summary')})", {}),
        "semanticscholar": (joined("$.title", "$.abstract"), {"citations": "$.citationCount"}),
        "europepmc": (joined("$.resultList.result[0].title", "$.resultList.result[0].abstractText"), {"citations": "$.resultList.result[0].citedByCount"}),
    }[method]
    out = "".join(f", CAST({at(p)} AS DOUBLE) AS {m}" for m, p in counts.items())
    if method == "europepmc":
        urls = "json_extract(j, '$.resultList.result[0].fullTextUrlList.fullTextUrl[*]')"
        out += f", nullif(array_to_string([u->>'$.url' FOR u IN {urls} IF u->>'$.availabilityCode' IN ('OA', 'F')], ' '), '') AS links"
    rows = f"(SELECT doc_id AS id, {_filled(q.page_templates(method))} AS raw, source AS snippet FROM documents)"
    return f"SELECT CAST(id AS BIGINT) AS id, nullif({body}, '') AS body{out} FROM (SELECT *, CASE WHEN json_valid(raw) THEN raw END AS j FROM {rows})"


def _address() -> str:
    part = lambda pattern: f"nullif(regexp_extract(url, '{pattern}', 1), '')"
    article = "^https?://[^/]+/article/"
    wiki = "https://en.wikipedia.org/w/api.php?action=query&prop=extracts&explaintext=1&redirects=1&format=json&formatversion=2&titles="
    return f"""CASE WHEN method = 'snippet' THEN NULL ELSE coalesce(CASE method
        WHEN 'fxtwitter' THEN 'https://api.fxtwitter.com/' || {part("^https?://[^/]+/([^/?#]+/status/[0-9]+)")}
        WHEN 'mediawiki' THEN '{wiki}' || {part("^https?://[^/]+/wiki/([^?#]+)")}
        WHEN 'github' THEN 'https://api.github.com/repos/' || {part("^https?://[^/]+/([^/?#]+/[^/?#]+)")} || '/readme'
        WHEN 'arxiv' THEN 'https://export.arxiv.org/api/query?id_list=' || regexp_replace({part("^https?://[^/]+/(?:abs|pdf|html)/([^?#]+)")}, '[.]pdf$', '')
        WHEN 'semanticscholar' THEN 'https://api.semanticscholar.org/graph/v1/paper/' || {part("^https?://[^/]+/paper/(?:[^/?#]+/)?([^/?#]+)")} || '?fields=title,abstract,citationCount'
        WHEN 'europepmc' THEN 'https://www.ebi.ac.uk/europepmc/webservices/rest/search?format=json&resultType=core&query=ext_id:' || {part(article + "[^/?#]+/([^/?#]+)")} || '%20src:' || {part(article + "([^/?#]+)/[^/?#]+")}
        END, url) END"""


def oracles() -> dict[str, str]:
    out = {f"decode_{s}": _json(s) for s in JSON_HITS} | {f"page_{m}": _page(m) for m in q.PAGES}
    for s in ("web", "web_fallback", "news", "discussions"):
        out[f"decode_{s}"] += f" UNION ALL {_result_page(s)} UNION ALL {_feed(s)}"
    out["decode_devto"] += f" UNION ALL {_searched()}"
    out["decode_pubmed"] += f" UNION ALL {_pubmed()}"
    out["decode_arxiv"] = _atom("arxiv")
    routed = lambda rows: f"(SELECT *, {_route_case()} AS method FROM (SELECT *, {_host('url')} AS h FROM {rows}))"
    out["pdf_skip"] = f"SELECT CAST(id AS BIGINT) AS id FROM (SELECT page_id AS id, {_pick(q.CONTENT, 'page_id')} AS content_type FROM pages) WHERE NOT coalesce(lower(content_type) LIKE '%pdf%', false)"
    urls = f"(SELECT page_id AS id, replace({_pick(q.PAGE_URLS, 'page_id')}, '@id', CAST(page_id AS VARCHAR)) AS url FROM pages)"
    out["api_addresses"] = f"SELECT CAST(id AS BIGINT) AS id, {_address()} AS address FROM {routed(urls)}"
    out["page_addresses"] = f"SELECT page_id, {_address()} AS address, 'https://web.archive.org/web/2id_/' || url AS archive FROM {routed('pages')}"
    return out
