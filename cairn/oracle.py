"""The catalog's queries in DuckDB's SQL.

Written from the operators' definitions, not from their code; patterns are
RE2's.  Queries that are missing here have no form in SQL: they read structure out of
markup, compare names nearly, or merge in order.
"""

from __future__ import annotations

from cairn import fixed


def _list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _array(values) -> str:
    return "[" + _list(values)[1:-1] + "]"


def _scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([^:/?#]+):', 1))"


def _cased_authority(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[^:/?#]+:)?//([^/?#]*)', 1)"


def _authority(u: str) -> str:
    return f"lower({_cased_authority(u)})"


def _path(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"


def _query(u: str) -> str:
    return rf"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"


def _domain(u: str) -> str:
    return rf"regexp_replace({_authority(u)}, '^www\.', '')"


def _normalized(u: str) -> str:
    s, a, q = _scheme(u), _authority(u), _query(u)
    return (
        f"(CASE WHEN {s} <> '' THEN {s} || ':' ELSE '' END || CASE WHEN {a} <> '' THEN '//' || {a} ELSE '' END"
        f" || rtrim({_path(u)}, '/') || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END)"
    )


def _useful(u: str) -> str:
    ends, hosts = "|".join(fixed.JUNK_EXTENSIONS), "|".join(fixed.JUNK_DOMAINS)
    return rf"(regexp_matches({u}, '^https?://') AND NOT regexp_matches({u}, '(?i)\.({ends})$') AND NOT regexp_matches({u}, '(?i)({hosts})'))"


def _segments(path: str) -> str:
    return f"list_filter(string_split(lower({path}), '/'), lambda x: x <> '')"


def _any(text: str, hints) -> str:
    return "(" + " OR ".join(f"contains({text}, '{h}')" for h in hints) + ")"


def _homepage(u: str) -> str:
    s, a = _scheme(u), _cased_authority(u)
    return f"CASE WHEN {a} = '' THEN {u} ELSE CASE WHEN {s} = '' THEN 'https' ELSE {s} END || '://' || {a} || '/' END"


def _article(u: str) -> str:
    seg = _segments(_path(u))
    return (
        f"(list_has_any({seg}, {_array(fixed.VALUE_ARTICLE_SEGMENTS)}) OR regexp_matches(lower({_path(u)}), '/20\\d{{2}}/\\d{{1,2}}/\\d{{1,2}}/')"
        f" OR (len({seg}) >= 3 AND len(list_filter({seg}, lambda x: contains(x, '-') AND length(x) >= 20)) > 0))"
    )


def _directory(u: str) -> str:
    return f"(list_has_any({_segments(_path(u))}, {_array(fixed.VALUE_DIRECTORY_SEGMENTS)}) OR {_any('lower(' + _query(u) + ')', fixed.VALUE_DIRECTORY_PARAMETERS)})"


def _hub(u: str) -> str:
    seg = _segments(_path(u))
    return f"(len({seg}) = 1 AND NOT contains({seg}[1], '-') AND NOT regexp_matches({seg}[1], '\\d') AND length({seg}[1]) BETWEEN 2 AND 20)"


def _regime(u: str) -> str:
    """(regime, confidence) of an address without title, text and metadata, as a struct."""
    d, seg = _domain(u), _segments(_path(u))
    p = f"CASE WHEN {_path(u)} = '' THEN '/' ELSE {_path(u)} END"
    low = f"lower({p})"
    cases = [
        (f"{d} IN {_list(fixed.PAGE_MARKETPLACE_DOMAINS)}", "marketplace_aggregator", 0.95),
        (_any(low, fixed.PAGE_MARKETPLACE_PATHS), "marketplace_aggregator", 0.78),
        (f"{d} IN {_list(fixed.REPOSITORY_DOMAINS)}", "software_repo_or_docs", 0.94),
        (f"starts_with({d}, 'docs.') OR {_any(low, fixed.PAGE_SOFTWARE_PATHS)}", "software_repo_or_docs", 0.82),
        (
            f"list_has_any({seg}, {_array(fixed.PAGE_ARTICLE_SEGMENTS)}) OR regexp_matches({p}, '/(?:19|20)\\d{{2}}/\\d{{1,2}}/')"
            f" OR coalesce(regexp_matches({seg}[-1], '[a-z0-9]+(?:-[a-z0-9]+){{2,}}'), FALSE)",
            "editorial_article",
            0.82,
        ),
        (f"list_has_any({seg}, {_array(fixed.PAGE_DIRECTORY_SEGMENTS)}) OR {_any('lower(' + _query(u) + ')', fixed.PAGE_DIRECTORY_PARAMETERS)}", "directory_listing", 0.78),
        (f"len({seg}) <= 1", "official_site", 0.72),
    ]
    whens = " ".join(f"WHEN {test} THEN {{'regime': '{r}', 'confidence': CAST({c} AS DOUBLE)}}" for test, r, c in cases)
    return f"CASE {whens} ELSE {{'regime': 'unknown', 'confidence': CAST(0.5 AS DOUBLE)}} END"


_NAME_KEY = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"
_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"

SQL: dict[str, str] = {}

# --- addresses ---------------------------------------------------------------------

SQL["url_normalize"] = f"SELECT page_id, {_normalized('trim(url)')} AS norm_url FROM pages"
SQL["url_domain"] = f"SELECT page_id, {_domain('url')} AS domain FROM pages"
SQL["url_useful"] = f"""
SELECT page_id, form, {_useful("u")} AS useful FROM (
  SELECT page_id, unnest([url, url || '.pdf', url || '.PNG?x=1', replace(url, 'example', 'netflix'), 'ftp://' || url]) AS u, unnest(range(5)) AS form FROM pages)
"""
SQL["url_dedupe_first_wins"] = f"""
SELECT page_id, url, norm_url FROM (
  SELECT *, row_number() OVER (PARTITION BY norm_url ORDER BY page_id) AS n FROM (SELECT page_id, url, {_normalized("trim(url)")} AS norm_url FROM pages) WHERE {_useful("norm_url")})
WHERE n = 1
"""
SQL["hits_union_first_wins"] = f"""
WITH h AS (
  SELECT 'q' || (page_id % 5) AS query_id, 2 AS angle_pos, page_id AS hit_pos, url FROM pages
  UNION ALL SELECT 'q' || (page_id % 5), 1, 1000000 - page_id, url || '#again' FROM pages
  UNION ALL SELECT 'q' || (page_id % 5), 0, page_id, upper(url) FROM pages WHERE page_id % 3 = 0
), n AS (SELECT *, {_normalized("trim(url)")} AS norm_url FROM h)
SELECT query_id, norm_url, angle_pos, hit_pos FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, norm_url ORDER BY angle_pos, hit_pos) AS k FROM n WHERE {_useful("norm_url")}) WHERE k = 1
"""
SQL["domain_match_self_join"] = f"""
WITH d AS (SELECT page_id, {_domain("url")} AS domain FROM pages)
SELECT a.page_id AS left_id, b.page_id AS right_id, a.domain FROM d AS a JOIN d AS b ON a.domain = b.domain AND a.page_id < b.page_id WHERE a.domain <> ''
"""
SQL["homepage_canonical"] = f"""
SELECT page_id, {_homepage("url")} AS homepage, {_scheme("url")} || '://' || {_authority("url")} AS bare_homepage,
  CASE WHEN len(s) >= 2 THEN {_scheme("url")} || '://' || {_cased_authority("url")} || '/' || s[1] || '/' || s[2] ELSE {_homepage("url")} END AS root
FROM (SELECT *, list_filter(string_split({_path("url")}, '/'), lambda x: x <> '') AS s FROM pages)
"""
SQL["path_segment_features"] = f"""
SELECT page_id, len({_segments(_path("url"))}) AS n_segments, {_article("url")} AS article, {_directory("url")} AS directory, {_hub("url")} AS hub FROM pages
"""
_CURATED = _list((*fixed.EDITORIAL_DOMAINS, *fixed.DIRECTORY_DOMAINS, *fixed.MARKETPLACE_DOMAINS))
SQL["website_normalize"] = rf"""
WITH f AS (
  SELECT page_id, unnest(range(7)) AS form, unnest([url, {_domain("url")}, {_domain("url")} || '/about', 'https://www.forbes.com' || {_path("url")}, '', 'n/a', {_segments(_path("url"))}[1]]) AS v FROM pages
), w AS (
  SELECT *, CASE WHEN regexp_matches(trim(v), '(?i)^https?://') THEN trim(v) ELSE 'https://' || trim(v) END AS whole,
    CASE WHEN regexp_matches(trim(v), '(?i)^https?://') THEN contains({_authority("trim(v)")}, '.') ELSE regexp_matches(trim(v), '(?i)^([a-z0-9][a-z0-9\-]{{0,62}}\.)+[a-z]{{2,}}(/.*)?$') END AS plausible
  FROM f
), n AS (SELECT *, {_normalized("whole")} AS u FROM w),
k AS (
  SELECT *, coalesce(trim(v), '') = '' OR lower(trim(v)) IN {_list(fixed.PLACEHOLDERS)} AS filler,
    plausible AND contains({_authority("u")}, '.') AND {_domain("u")} NOT IN {_CURATED} AS good, {_article("u")} OR {_hub("u")} AS home
  FROM n
)
SELECT page_id, form, CASE WHEN filler THEN v WHEN NOT good THEN trim(v) WHEN home THEN {_scheme("u")} || '://' || {_authority("u")} ELSE u END AS website, NOT filler AND good AS ok FROM k
"""
SQL["cell_values_validate"] = r"""
WITH f AS (
  SELECT s_suppkey, unnest(['phone', 'rating', 'category']) AS col,
    unnest(['+1 ' || (s_suppkey * 7919), (s_suppkey % 14) || ' of 10', CASE WHEN s_suppkey % 3 = 0 THEN 'Unknown' ELSE ' ' || s_name || ' ' END]) AS v FROM supplier
)
SELECT s_suppkey, col, CASE WHEN col = 'category' AND v = 'Unknown' THEN v ELSE trim(v) END AS value,
  CASE col WHEN 'phone' THEN length(regexp_replace(v, '\D', '', 'g')) >= 7 WHEN 'rating' THEN CAST(regexp_extract(v, '(\d+)', 1) AS DOUBLE) BETWEEN 0 AND 10 ELSE v <> 'Unknown' END AS ok
FROM f
"""

# --- pages -------------------------------------------------------------------------

SQL["html_anchor_counts"] = """SELECT page_id, len(regexp_extract_all(html, '<a href="')) AS n_anchors FROM pages"""
SQL["html_title_headings"] = """
SELECT page_id, len(list_distinct(list_filter(regexp_extract_all(html, '<h[123][^>]*>([^<]*)', 1), lambda x: trim(x) <> ''))) AS n_headings,
  len(regexp_extract_all(html, '<script')) AS script_count, 0 AS n_types FROM pages
"""
_FORMS = f"""
forms AS (
  SELECT page_id, url, unnest(range(10)) AS form, unnest([url, h, h || 'blog/a', h || 'directory/x', h || 'search?q=a', h || 'docs/intro', h || 'checkout', 'https://github.com/a/b', 'https://www.etsy.com/shop/a', h || '2021/05/x']) AS address
  FROM (SELECT *, {_homepage("url")} AS h FROM pages)
), judged AS (SELECT *, {_regime("address")} AS r FROM forms)
"""
SQL["page_regime_classify"] = f"WITH {_FORMS} SELECT page_id, form, r.regime AS regime, r.confidence AS confidence FROM judged"
SQL["regime_profile_by_lang"] = f"""
WITH {_FORMS} SELECT {_segments(_path("url"))}[1] AS lang, {", ".join(f"count(*) FILTER (r.regime = '{k}') AS {k}" for k in fixed.REGIMES)} FROM judged GROUP BY 1
"""
SQL["source_kind_quality"] = f"""
WITH {_FORMS}, s AS (SELECT page_id, form, {_domain("address")} AS d, r.regime AS g, {_domain("address")} = {_domain("url")} || CASE WHEN page_id % 2 = 0 THEN '' ELSE '.x' END AS own FROM judged)
SELECT page_id, form,
  CASE WHEN own THEN 'official' WHEN d IN {_list(fixed.MARKETPLACE_DOMAINS)} OR g = 'marketplace_aggregator' THEN 'marketplace' WHEN g IN ('software_repo_or_docs', 'official_site', 'unknown') THEN 'unknown'
    WHEN g = 'editorial_article' THEN 'editorial' ELSE 'directory' END AS kind,
  CAST(CASE WHEN own THEN 1.0 WHEN d IN {_list(fixed.MARKETPLACE_DOMAINS)} OR g = 'marketplace_aggregator' THEN 0.15 WHEN g = 'software_repo_or_docs' THEN CASE WHEN d IN {_list(fixed.REPOSITORY_DOMAINS)} THEN 0.86 ELSE 0.8 END
    WHEN g = 'editorial_article' THEN 0.72 WHEN g = 'directory_listing' THEN 0.58 WHEN g = 'official_site' THEN 0.72 ELSE 0.55 END AS DOUBLE) AS quality
FROM s
"""
SQL["page_needs_js"] = f"""
WITH s AS (SELECT page_id, html || CASE WHEN page_id % 2 = 0 THEN '<div id="app">' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN 'application/ld+json' ELSE '' END AS h,
  length(left(html, CAST(page_id % 400 AS INTEGER))) AS n, page_id % 17 AS scripts FROM pages)
SELECT page_id, n < 200 AND (({_any("h", fixed.SHELL_MARKERS)} AND scripts >= 5) OR (scripts >= 12 AND n < 100) OR (contains(h, 'application/ld+json') AND n < 66)) AS needs_js FROM s
"""
SQL["js_budget"] = """
SELECT query_id, page_pos, needs_js, needs_js AND row_number() OVER (PARTITION BY query_id, needs_js ORDER BY page_pos) <= 2 AS render
FROM (SELECT page_id % 9 AS query_id, page_id AS page_pos, page_id % 4 = 0 AS needs_js FROM pages)
"""



def _visible(html: str) -> str:
    """The text of a page: without hidden elements, its title, comments and tags; entities that the pages have."""
    out = html
    for hidden in (r"(?s)<!--.*?-->", *[rf"(?is)<{t}\b.*?</{t}\s*>" for t in ("title", "script", "style", "nav", "footer", "header", "aside")], "<[^>]*>"):
        out = f"regexp_replace({out}, '{hidden}', ' ', 'g')"
    for name, mark in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{mark}')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def _inner(element: str) -> str:
    return _visible(f"regexp_replace({element}, '(?is)^<title>|</title>$', '', 'g')")


SQL["html_visible_text"] = rf"""
SELECT page_id, {_inner("regexp_extract(html, '(?is)<title>.*?</title>')")} AS title, {_visible("html")} AS visible,
  array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<h[123][^>]*>(.*?)</h[123]>', 1), lambda x: {_visible("x")}), lambda x: x <> ''), '|') AS headings FROM pages
"""

# --- text --------------------------------------------------------------------------

SQL["text_normalize_name"] = f"SELECT doc_id, md5({_NAME_KEY.format('text')}) AS name_key_md5 FROM documents"
SQL["truncate_words"] = r"""
WITH t AS (SELECT doc_id, replace(text, chr(10), ' ') AS t, left(replace(text, chr(10), ' '), 120) AS h FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 120 THEN t WHEN strpos(reverse(h), ' ') > 0 AND strpos(reverse(h), ' ') < length(h) THEN left(h, length(h) - strpos(reverse(h), ' ')) || '…' ELSE h || '…' END AS head FROM t
"""
SQL["token_estimate"] = "SELECT doc_id, length(text) // 4 AS tokens FROM documents"
# The documents have no compatibility forms, so composing is all that normalising does.
SQL["clean_text"] = r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '\s+', ' ', 'g'), '[^\x20-\x7E\x{A0}-\x{FFFF}]', ' ', 'g')) AS cleaned FROM documents
"""
# Windows of 1,200 characters that overlap by 200, each to the end of a sentence that ends in its second half.
SQL["chunk_text_windows"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, 0 AS i, 0 AS a, CASE WHEN n // 4 <= 300 THEN n ELSE 0 + s END AS stop FROM (
    SELECT *, CASE WHEN n > 1200 AND r > 0 AND 1200 - r - 1 > 600 THEN 1200 - r ELSE least(1200, n) END AS s FROM (SELECT *, strpos(reverse(left(text, 1200)), ' .') AS r FROM d))
  UNION ALL
  SELECT doc_id, i + 1, a, CASE WHEN n > a + 1200 AND r > 0 AND 1200 - r - 1 > 600 THEN a + 1200 - r ELSE least(a + 1200, n) END FROM (
    SELECT w.doc_id, w.i, greatest(w.stop - 200, w.a + 1) AS a, d.n, strpos(reverse(substr(d.text, greatest(w.stop - 200, w.a + 1) + 1, 1200)), ' .') AS r
    FROM w JOIN d USING (doc_id) WHERE w.stop < d.n)
), c AS (SELECT w.doc_id, w.i, CASE WHEN n // 4 <= 300 THEN text ELSE regexp_replace(substr(text, a + 1, stop - a), '^\s+|\s+$', '', 'g') END AS chunk, n FROM w JOIN d USING (doc_id))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, chunk FROM c WHERE chunk <> '' OR n // 4 <= 300
"""
SQL["lexical_rerank_topk"] = f"""
WITH q AS (SELECT item_id, {_WORDS.format("text")} AS wanted FROM benchmark), d AS (SELECT doc_id, {_WORDS.format("left(text, 1200)")} AS said FROM documents),
s AS (SELECT item_id, doc_id, len(list_intersect(wanted, said)) / len(wanted) AS score FROM q, d WHERE list_has_any(wanted, said)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS pos FROM s)
SELECT item_id, doc_id, pos, score FROM r WHERE pos <= 10
"""

# --- queries -----------------------------------------------------------------------

_ASKED = """
asked AS (
  SELECT CAST(p_partkey AS VARCHAR) AS query_id,
    ['best ', '', 'Top ', 'leading ', 'must visit '][CAST(p_size % 5 + 1 AS INTEGER)] || p_name || ' ' ||
    ['restaurants in Brooklyn', 'startups in Germany with funding > 5M', 'open source tools', 'brands founded after 1999', 'researchers', 'ideas', 'laptops', 'companies with more than 50 employees', 'hotels near the park in 2024'][CAST(p_partkey % 9 + 1 AS INTEGER)] AS query
  FROM part)
"""


def _signal(names) -> str:
    return "regexp_matches(lower(query), '(^|[^a-z])(" + "|".join(n.replace("-", r"\-") for n in names) + ")([^a-z]|$)')"


_FAMILY = f"""
signals AS (
  SELECT *, {_signal(fixed.SOFTWARE_SIGNALS)} OR contains(lower(query), 'open source') AS sw, {_signal(fixed.PLACE_SIGNALS)} AS pl, {_signal(fixed.ORGANIZATION_SIGNALS)} AS og,
    {_signal(fixed.PRODUCT_SIGNALS)} AS pr, {_signal(fixed.PERSON_SIGNALS)} AS pe, regexp_matches(lower(query), ' (in|near|around|at|from) ') AS lo FROM asked),
families AS (
  SELECT query_id, query, CASE WHEN sw AND NOT og THEN 'software_project' WHEN pe AND NOT og AND NOT sw THEN 'person_group' WHEN pl AND (lo OR NOT og) THEN 'place_venue' WHEN og THEN 'organization_company'
    WHEN pr THEN 'product_offering' WHEN lo THEN 'place_venue' ELSE 'generic_entity_list' END AS family FROM signals)
"""
SQL["query_tokens"] = rf"""
WITH {_ASKED} SELECT query_id, array_to_string(regexp_extract_all(trim(regexp_replace(regexp_replace(query, '\s*,\s*', ', ', 'g'), '\s+', ' ', 'g'), ' ,.;:-'), '[A-Za-z]+(?:''[A-Za-z]+)?|[0-9]+|[,]'), '|') AS tokens FROM asked
"""
SQL["query_family_classify"] = f"WITH {_ASKED}, {_FAMILY} SELECT query_id, family FROM families"
SQL["query_strict_flag"] = f"WITH {_ASKED} SELECT query_id, {_any('lower(query)', fixed.HIGH_INTENT)} AS strict FROM asked"
_TYPES = "CASE family " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, (t, _) in fixed.FAMILY_TEMPLATES.items()) + " END"
_TOPIC = f"regexp_replace(trim(query), '(?i){fixed.INTENT_PREFIX}', '')"
SQL["entity_type_derive"] = rf"""
WITH {_ASKED}, {_FAMILY}, core AS (
  SELECT *, string_split_regex(trim(regexp_replace(regexp_replace({_TOPIC}, '(?i){fixed.YEAR_SUFFIX}', ''), '(?i){fixed.TRAILING_LOCATION}', '')), '\s+') AS w FROM families
), phrase AS (SELECT *, lower(array_to_string(w[greatest(len(w) - 2, 1):], ' ')) AS p FROM core)
SELECT query_id, CASE WHEN p = '' OR p IN {_list(fixed.GENERIC_ENTITY_TYPES)} THEN {_TYPES}
  WHEN regexp_matches(p, '[^ ]{{3,}}s$') AND NOT ends_with(p, 'ss') THEN left(p, length(p) - 1) ELSE p END AS entity_type FROM phrase
"""
_TEMPLATE = "CASE family " + " ".join(f"WHEN '{k}' THEN {_array(cols)}" for k, (_, cols) in fixed.FAMILY_TEMPLATES.items()) + " END"
SQL["plan_facets_explode"] = f"""
WITH {_ASKED}, {_FAMILY}, t AS (SELECT query_id, family, {_TOPIC} AS topic, {_TEMPLATE} AS cols FROM families),
u AS (
  SELECT *, list_filter(cols, lambda c: c <> 'name')[1:3] AS fill, list_filter(cols, lambda c: c IN ('website', 'website_or_repo', 'website_or_profile')) AS own,
    list_filter(cols, lambda c: c NOT IN ('name', 'website', 'website_or_repo', 'website_or_profile'))[1:2] AS attr FROM t
), f AS (
  SELECT query_id, list_filter([
    {{'type': 'entity_list', 'search': 'top ' || topic, 'fill': 'name|' || array_to_string(fill[1:2], '|')}},
    {{'type': 'official_source', 'search': topic || ' official website', 'fill': coalesce(own[1], 'name')}},
    {{'type': 'editorial_review', 'search': topic || ' overview', 'fill': 'name|' || fill[1]}},
    {{'type': 'attribute_specific', 'search': topic || ' ' || replace(attr[1], '_', ' '), 'fill': array_to_string(attr, '|')}},
    CASE WHEN family IN ('software_project', 'product_offering') THEN {{'type': 'comparison', 'search': topic || ' comparison', 'fill': 'name|' || fill[1]}}
      WHEN family = 'organization_company' THEN {{'type': 'news_recent', 'search': topic || ' news', 'fill': 'name|' || fill[1]}} END
  ], lambda x: x IS NOT NULL) AS fs FROM u
)
SELECT query_id, pos, x.type AS type, x.search AS search, x.fill AS fill FROM (SELECT query_id, unnest(fs) AS x, unnest(range(len(fs))) AS pos FROM f)
"""

# --- requirements ------------------------------------------------------------------

SQL["requirement_money_parse"] = r"""
WITH s AS (SELECT c_custkey, '$' || CAST(round(abs(c_acctbal), 0) AS BIGINT) || ['', 'K', ' million', 'b raised', ' members'][CAST(c_custkey % 5 + 1 AS INTEGER)] AS t FROM customer)
SELECT c_custkey, CAST(regexp_extract(t, '(\d+)', 1) AS DOUBLE) * CASE lower(regexp_extract(t, '\d+\s*([kKmMbB])', 1)) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1 END AS amount, CAST(regexp_extract(t, '(\d+)', 1) AS DOUBLE) AS number FROM s
"""
SQL["requirement_numeric_3vl"] = """
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'unknown' WHEN CAST(round(abs(c_acctbal), 0) AS BIGINT) * 1000 > 5000000 THEN 'satisfied' ELSE 'not_satisfied' END AS status FROM customer
"""
_PLACES = ("New York, NY", "Berlin, Germany", "Austin", "Paris - France", "Toronto, Canada", "Texas", "Lisbon (Portugal)", "Tokyo", "London, England", "CA", "Boise, ID", "Sydney/Australia")
_SLUG = f"""CASE WHEN x IN {_list(fixed.LOCATION_NAMES["us"])} THEN 'us' WHEN x IN {_list((*fixed.LOCATION_NAMES["uk"], "england"))} THEN 'uk' WHEN x IN {_list(fixed.LOCATION_NAMES["eu"])} THEN 'eu'
 WHEN x IN {_list(fixed.LOCATION_NAMES["canada"])} THEN 'canada' WHEN x IN {_list(fixed.LOCATION_NAMES["australia"])} THEN 'australia' WHEN x IN {_list(fixed.STATES)} THEN 'us-' || x
 WHEN x IN {_list(fixed.STATE_NAMES)} THEN 'us-state' WHEN x IN {_list(fixed.EU_COUNTRIES)} THEN 'eu' ELSE x END"""
SQL["requirement_location_match"] = rf"""
WITH s AS (SELECT s_suppkey, {_array(_PLACES)}[CAST(s_nationkey % 12 + 1 AS INTEGER)] AS place, unnest(['us', 'eu', 'uk', 'canada', 'australia', 'tokyo']) AS target FROM supplier),
p AS (SELECT *, list_transform(list_concat([place], string_split_regex(place, '[,/|()\-]')), lambda y: lower(trim(y))) AS parts FROM s),
g AS (SELECT s_suppkey, place, target, list_transform(list_filter(parts, lambda y: y <> ''), lambda x: {_SLUG}) AS slugs FROM p)
SELECT s_suppkey, place, target, list_contains(slugs, target) OR (target = 'us' AND len(list_filter(slugs, lambda x: starts_with(x, 'us-'))) > 0) OR contains(lower(place), target) AS matches FROM g
"""
SQL["requirement_hard_penalty"] = "SELECT s_suppkey, s_suppkey % 6 AS failed, round(least((s_suppkey % 6) * 0.1, 0.3), 4) AS penalty FROM supplier"

# --- entities ----------------------------------------------------------------------

_CELLS = f"""
cells AS (
  SELECT 'q' || (s_suppkey % 8) AS query_id, s_suppkey AS k, s_name, unnest(range(6)) AS pos, unnest(['name', 'website', 'headquarters', 'focus_area', 'funding', 'description']) AS col,
    unnest([CASE WHEN s_suppkey % 11 = 0 THEN 'Company' ELSE s_name END, 'https://own' || s_suppkey || '.example.net/', {_array(_PLACES)}[CAST(s_nationkey % 12 + 1 AS INTEGER)], 'AI search engine ' || s_suppkey, '$' || CAST(round(abs(s_acctbal), 0) AS BIGINT) || 'K', 'some words']) AS value,
    unnest([s_suppkey % 3, s_suppkey % 5, s_suppkey % 2, s_suppkey % 7, s_suppkey % 2, s_suppkey % 3]) AS site,
    unnest([((s_suppkey * 7) % 10) / 10.0, ((s_suppkey * 3) % 10) / 10.0, ((s_suppkey * 9) % 10) / 10.0, (s_suppkey % 10) / 10.0, ((s_suppkey * 4) % 10) / 10.0, ((s_suppkey * 6) % 10) / 10.0]) AS confidence,
    unnest([s_suppkey % 13 <> 0, s_suppkey % 2 = 0, s_suppkey % 3 <> 1, s_suppkey % 5 > 1, s_suppkey % 4 <> 3, s_suppkey % 6 = 0]) AS there
  FROM supplier
), c AS (SELECT * FROM cells WHERE there), e AS (SELECT DISTINCT query_id, k FROM cells),
facts AS (
  SELECT e.query_id, e.k, count(c.col) AS n, count(DISTINCT c.site) AS sources, coalesce(round_even(avg(c.confidence), 3), 0) AS mean, coalesce(max(c.value) FILTER (c.col = 'name'), '') AS name,
    count(*) FILTER (c.col = 'name') AS has_name, count(*) FILTER (c.col IN ('website', 'headquarters', 'focus_area', 'funding')) AS acts, max(c.value) FILTER (c.col = 'headquarters') AS place,
    round(coalesce(sum(CASE c.col WHEN 'website' THEN 0.28 WHEN 'headquarters' THEN 0.2 WHEN 'focus_area' THEN 0.18 END), 0), 3) AS importance
  FROM e LEFT JOIN c USING (query_id, k) GROUP BY 1, 2
), shares AS (SELECT query_id, k, max(m) AS most, sum(m) AS total FROM (SELECT query_id, k, site, count(*) AS m FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2),
mixed AS (SELECT facts.*, CASE WHEN total IS NULL THEN 0 ELSE round_even(1.0 - most / total, 3) END AS diversity FROM facts LEFT JOIN shares USING (query_id, k))
"""
SQL["source_diversity"] = f"WITH {_CELLS} SELECT query_id, k AS row_pos, diversity FROM mixed"
SQL["completeness_field_importance"] = f"WITH {_CELLS} SELECT query_id, k AS row_pos, round_even(n / 7, 3) AS completeness, importance FROM mixed"
# All sources are of hosts without a kind of their own, and none is an entity's own host.
SQL["source_quality_weighted"] = f"WITH {_CELLS} SELECT query_id, k AS row_pos, CASE WHEN n > 0 THEN 0.55 ELSE 0.0 END AS quality FROM mixed"
_FIT = """CASE WHEN {place} IS NULL THEN 0.4 ELSE (SELECT CASE WHEN o >= 0.8 THEN 1.0 WHEN o >= 0.5 THEN 0.8 WHEN o >= 0.25 THEN 0.55 ELSE 0.2 END FROM
 (SELECT len(list_intersect({wanted}, list_filter(list_distinct(regexp_extract_all(lower({place}), '[a-z0-9]+')), lambda w: length(w) > 1))) / len({wanted}) AS o)) END"""
SQL["local_fit"] = f"WITH {_CELLS} SELECT query_id, k AS row_pos, {_FIT.format(place='place', wanted=_array(('new', 'york', 'ny')))} AS fit FROM mixed"
SQL["missing_columns_except"] = f"""
WITH {_CELLS} SELECT e.query_id, e.k AS row_pos, array_to_string(list_filter(['name', 'website', 'headquarters', 'focus_area', 'product_or_service', 'stage_or_status', 'funding'], lambda x: NOT list_contains(coalesce(h.has, []), x)), '|') AS missing
FROM e LEFT JOIN (SELECT query_id, k, list(col) AS has FROM c GROUP BY 1, 2) AS h USING (query_id, k)
"""
_SCORED = f"""
{_CELLS}, signals AS (
  SELECT query_id, k, n, has_name, acts, name, sources, CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END AS owned,
    round_even(0.13 * round_even(n / 7, 3), 4) + round_even(0.10 * importance, 4) + round_even(0.13 * mean, 4) + round_even(0.04 * round_even(least(1, log2(1 + sources) / log2(11)), 3), 4)
    + CASE WHEN acts > 0 THEN 0.04 ELSE 0 END + CASE WHEN n > 0 THEN round_even(0.16 * 0.55, 4) ELSE 0 END + round_even(0.08 * diversity, 4)
    + round_even(0.06 * {_FIT.format(place="place", wanted=_array(("new", "york", "2024")))}, 4) + round_even(0.04 * 0.45, 4) + round_even(0.04 * CASE WHEN sources >= 3 THEN 0.85 ELSE 0.5 END, 4)
    + round_even(0.04 * CASE WHEN k % 9 = 0 THEN 1.0 ELSE 0.35 END, 4) + round_even(0.02 * 0.45, 4) + 0.15 AS score
  FROM mixed
), scored AS (SELECT *, round(score, 4) AS final FROM signals)
"""
SQL["ranking_weighted_score"] = f"WITH {_SCORED} SELECT query_id, k AS row_pos, final AS base_score, 0.0 AS penalty, final AS final_score FROM scored"
SQL["ranking_with_requirements"] = f"""
WITH {_SCORED}, r AS (SELECT *, round_even((k % 3 + 0.5 * (k % 2)) / 4, 3) AS met, least((k % 6) * 0.1, 0.3) AS penalty FROM scored),
b AS (SELECT *, round(score - 0.15 + round_even(0.15 * met, 4), 4) AS base FROM r)
SELECT query_id, k AS row_pos, CAST(met AS DOUBLE) AS met, CAST(base AS DOUBLE) AS base_score, CAST(penalty AS DOUBLE) AS penalty, CAST(round(base - penalty, 4) AS DOUBLE) AS final_score FROM b
"""
SQL["source_profiles"] = f"""
WITH {_CELLS}, n AS (SELECT query_id, k, count(DISTINCT site) AS n FROM c GROUP BY 1, 2)
SELECT query_id, k AS row_pos, unnest(['kind', 'regime']) AS "by", 'unknown' AS name, n FROM n
"""
SQL["rank_topn"] = f"""
WITH {_SCORED}, r AS (SELECT query_id, k AS row_pos, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, k) AS rank_position, final AS final_score FROM scored) SELECT * FROM r WHERE rank_position <= 5
"""
_BAD = "(has_name = 0 OR (lower(name) IN ('company', 'startup') AND acts = 0) OR (n = has_name AND sources < 2 AND owned = 0))"
SQL["sparse_rows_topn"] = f"""
WITH {_SCORED}, r AS (SELECT query_id, k AS row_pos, 7 - n AS missing, row_number() OVER (PARTITION BY query_id ORDER BY 7 - n DESC, final DESC, k) AS sparse_pos FROM scored WHERE NOT {_BAD}) SELECT * FROM r WHERE sparse_pos <= 3
"""
SQL["pruned_guarded"] = f"""
WITH {_SCORED}, b AS (SELECT query_id, k, query_id = 'q3' OR {_BAD} AS bad FROM scored)
SELECT query_id, k AS row_pos FROM b QUALIFY NOT bad OR min(CAST(bad AS INTEGER)) OVER (PARTITION BY query_id) = 1
"""
SQL["eval_fill_metrics"] = f"""
WITH {_CELLS}, rows AS (
  SELECT m.*, count(c.col) FILTER (c.col IN {_list(fixed.EVALUATED_ACTIONABLE)}) AS actionable FROM mixed AS m LEFT JOIN c USING (query_id, k) GROUP BY ALL
), q AS (SELECT 'q' || unnest(range(9)) AS query_id)
SELECT q.query_id, count(k) AS rows_returned, coalesce(round_even(avg(n), 2), 0) AS avg_cells_per_row, coalesce(round_even(avg(n / 7), 3), 0) AS fill_rate, coalesce(round_even(avg(CASE WHEN k IS NOT NULL THEN CAST(actionable > 0 AS INTEGER) END), 3), 0) AS actionable_rate,
  coalesce(round_even(avg(actionable), 2), 0) AS avg_actionable_fields, coalesce(round_even(avg(CASE WHEN k IS NOT NULL THEN CAST(k % 9 = 0 AS INTEGER) END), 3), 0) AS official_site_rate,
  coalesce(round_even(avg(CASE WHEN k IS NOT NULL THEN CAST(sources > 1 AS INTEGER) END), 3), 0) AS multi_source_rate, coalesce(round_even(avg(mean), 3), 0) AS avg_aggregate_confidence,
  coalesce(round_even(avg(CASE WHEN k IS NOT NULL THEN coalesce((SELECT 1.0 - s.most / s.total FROM shares AS s WHERE s.query_id = rows.query_id AND s.k = rows.k), 0) END), 3), 0) AS avg_source_diversity
FROM q LEFT JOIN rows USING (query_id) GROUP BY 1
"""
SQL["source_support"] = "SELECT l_partkey, n, round_even(least(1, log2(1 + n) / log2(11)), 3) AS support FROM (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)"
SQL["freshness_as_of"] = """
SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2001 THEN 1.0 WHEN year(o_orderdate) = 2000 THEN 0.85 WHEN year(o_orderdate) >= 1999 THEN 0.7 ELSE 0.45 END AS freshness, 0.5 AS neutral FROM orders
"""
_EVIDENCE = """
evidence AS (
  SELECT l_partkey AS entity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) AS seq, l_returnflag AS col,
    CAST(l_extendedprice AS VARCHAR) AS value, l_suppkey % 40 AS site, CAST(l_quantity AS INTEGER) AS size, round(l_discount * 10, 1) AS confidence FROM lineitem)
"""
_FOLD = """list_reduce(list({{'seq': seq, 'confidence': confidence, 'size': size, 'value': value}} ORDER BY {order}), lambda a, b:
  CASE WHEN b.confidence > a.confidence + 0.05 OR (b.confidence >= a.confidence - 0.05 AND b.size > a.size) THEN b ELSE a END)"""
SQL["best_cell_ordered_fold"] = f"""
WITH {_EVIDENCE}, b AS (SELECT entity, col, {_FOLD.format(order="seq")} AS b FROM evidence GROUP BY 1, 2) SELECT entity, col, b.seq AS seq, b.confidence AS confidence, b.size AS size FROM b
"""
_SLUGGED = rf"regexp_replace(regexp_replace({_NAME_KEY.format('p_name')}, '\s+', '-', 'g'), '[^a-z0-9\-]', '', 'g')"
SQL["entity_cell_merge_exact"] = f"""
WITH {_EVIDENCE}, d AS (SELECT 'q' || (entity % 10) AS query_id, entity * 100000 + seq AS seq, {_SLUGGED} AS slug, col, value, site, size, confidence FROM evidence JOIN part ON p_partkey = entity),
k AS (SELECT query_id, slug, min(seq) AS row_pos, count(DISTINCT site) AS sources_count FROM d GROUP BY 1, 2),
b AS (SELECT query_id, slug, col, min(seq) AS first, {_FOLD.format(order="seq")} AS b FROM d GROUP BY 1, 2, 3),
o AS (SELECT query_id, slug, array_to_string(list(col ORDER BY r, first), '|') AS columns, array_to_string(list(b.value ORDER BY r, first), '|') AS best_values FROM (SELECT *, CASE col WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS r FROM b) GROUP BY 1, 2)
SELECT k.query_id, row_pos, slug AS entity_id, sources_count, columns, best_values FROM k JOIN o USING (query_id, slug)
"""

# --- verification ------------------------------------------------------------------

_NAMES = ("Book Now", "Order of the Phoenix", "Check Availability", "Top 10 Startups to Watch", "Best Buy", "Open Daily", "AI Tools for Companies", "Lucali")
_TERMS = _array(dict.fromkeys((*fixed.PSEUDO_TERMS, *fixed.PSEUDO_FAMILY_TERMS["organization_company"])))


def _quoted(pattern: str) -> str:
    return "(?i)" + pattern.replace("'", "''")


SQL["cta_article_filter"] = rf"""
WITH s AS (SELECT p_partkey, {_array(_NAMES)}[CAST(p_partkey % 8 + 1 AS INTEGER)] || CASE WHEN p_size % 2 = 0 THEN ' ' || p_name ELSE '' END AS name FROM part), w AS (SELECT *, len(string_split_regex(trim(name), '\s+')) AS n, {_NAME_KEY.format("name")} AS key FROM s)
SELECT p_partkey, regexp_matches(name, '{_quoted(fixed.CTA_PATTERN)}') OR (n <= 6 AND regexp_matches(name, '{_quoted(fixed.OPERATIONAL_PATTERN)}')) AS cta,
  (n >= 4 OR regexp_matches(name, '\d')) AND regexp_matches(name, '{_quoted(fixed.ARTICLE_TITLE_PATTERN)}') AS article,
  len(string_split(key, ' ')) >= 3 AND {_any("key", fixed.PSEUDO_CONNECTORS)} AND len(list_filter({_TERMS}, lambda t: contains(key, t))) >= 2 AS pseudo FROM w
"""
SQL["cell_alignment_penalty"] = f"""
WITH {_CELLS}, a AS (
  SELECT *, col IN ('name', 'description') OR name_key = '' OR contains({_NAME_KEY.format("CASE col WHEN 'headquarters' THEN s_name || ' is here' ELSE value END")}, name_key) AS ok
  FROM (SELECT c.*, {_NAME_KEY.format("f.name")} AS name_key FROM c JOIN facts AS f USING (query_id, k))
)
SELECT m.query_id, m.k AS row_pos, CASE WHEN m.name <> '' AND coalesce(bool_or(NOT ok), FALSE) THEN round_even(avg(CASE WHEN ok THEN confidence ELSE round_even(confidence * 0.6, 3) END), 3) ELSE m.mean END AS aggregate_confidence,
  count(a.col) FILTER (a.col NOT IN ('name', 'description')) AS cells_checked, count(a.col) FILTER (NOT ok) AS cells_penalized
FROM mixed AS m LEFT JOIN a USING (query_id, k) GROUP BY m.query_id, m.k, m.name, m.mean
"""

# --- gaps --------------------------------------------------------------------------

SQL["gap_queries_build"] = """
SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN '"' || p_name || '" tools|"' || p_name || '" official website'
  ELSE '"' || p_name || '" tools|"' || p_name || '" official website|"' || p_name || CASE p_partkey % 3 WHEN 0 THEN '" license' ELSE '" some field' END END AS searches FROM part
"""
_PRIORITY = " ".join(f"WHEN '{f}' THEN {list(w)}[CAST(p_size % 7 + 1 AS INTEGER)]" for f, w in fixed.GAP_PRIORITY.items())
SQL["gap_page_priority"] = f"""
SELECT p_partkey, family, {_array(fixed.REGIMES)}[CAST(p_size % 7 + 1 AS INTEGER)] AS regime, CASE family {_PRIORITY} END AS priority FROM (SELECT *, {_array(fixed.FAMILY_TEMPLATES)}[CAST(p_partkey % 6 + 1 AS INTEGER)] AS family FROM part)
"""
SQL["page_drafts_sufficient"] = f"""
WITH p AS (SELECT page_id, {_array(fixed.REGIMES)}[CAST(page_id % {len(fixed.REGIMES)} + 1 AS INTEGER)] AS regime, page_id % 4 AS n, page_id % 6 AS m, unnest([TRUE, FALSE]) AS discover FROM pages)
SELECT CAST(page_id AS VARCHAR) AS url, discover, n > 0 AND CASE WHEN discover THEN (regime IN ('directory_listing', 'local_business_listing') AND n >= 2) OR m >= 3
  WHEN regime = 'software_repo_or_docs' THEN (m - 1) / 4 >= 0.4 OR m >= 4 WHEN regime IN ('official_site', 'local_business_listing') THEN (m - 1) / 4 >= 0.4 OR m >= 2 ELSE (m - 1) / 4 >= 0.5 END AS sufficient FROM p
"""
SQL["drafts_within_pages"] = """
SELECT 'q' AS query_id, page_id * 10 AS draft_seq, 'Zebra Quartz' AS entity_name, 'funding=' || CASE WHEN page_id % 10 > 5 THEN 'f2' ELSE 'f0' END || '|website=w0|license=l2' AS cells FROM pages
UNION ALL SELECT 'q', page_id * 10 + 1, 'Mellow Harp', 'funding=f1' FROM pages
"""
SQL["answers_to_drafts"] = """
SELECT 'q' AS query_id, page_id * 1000 AS draft_seq, 'Firm ' || page_id AS entity_name, 'name=Firm ' || page_id || '=0.75|funding=$5M=1.0' AS cells FROM pages WHERE page_id % 3 < 2
"""
SQL["directory_candidates_top12"] = rf"""
WITH a AS (SELECT page_id, unnest(t) AS text, unnest(range(len(t))) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 2) AS t FROM pages)),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS nth FROM a WHERE length(text) BETWEEN 3 AND 80 AND {_useful("'https://x.org/' || text")}),
s AS (
  SELECT *, CASE WHEN lower(text) IN {_list(fixed.NAVIGATION_TEXTS)} THEN -10.0 ELSE CASE WHEN len(string_split_regex(trim(text), '\s+')) >= 2 THEN 1.0 ELSE 0 END + CASE WHEN length(text) <= 40 THEN 0.5 ELSE 0 END
    + CASE WHEN regexp_matches(left(text, 2), '\p{{Lu}}') THEN 0.5 ELSE 0 END + 0.25 + CASE WHEN regexp_matches(lower(text), '^[a-z0-9][a-z0-9 .,''&+\-]{{1,79}}$') THEN 0.25 ELSE 0 END
    - CASE WHEN regexp_matches(lower(text), '^(read|view|see|learn) ') THEN 1.0 ELSE 0 END END AS score FROM f
), o AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(text) ORDER BY nth) AS again FROM s WHERE score >= 1.0),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, nth) - 1 AS pos FROM o WHERE again = 1)
SELECT page_id, pos, text, CAST(score AS DOUBLE) AS score FROM r WHERE pos < 12
"""

# --- storage, jobs, evaluation -----------------------------------------------------

_EVENTS = """
e AS (
  SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, ts, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'running' END AS status, event_type AS phase, props, event_id FROM events
), s AS (
  SELECT job_id, arg_max(status, ROW(ts, seq)) AS status, arg_max(phase, ROW(ts, seq)) AS phase, arg_max(props, ROW(ts, seq)) FILTER (event_id % 7 = 0) AS query, arg_max(props, ROW(ts, seq)) FILTER (status = 'done') AS result,
    arg_max(props, ROW(ts, seq)) FILTER (status = 'failed') AS error, min(ts) AS created_at, max(ts) FILTER (status IN ('done', 'failed')) AS completed_at FROM e GROUP BY 1)
"""
SQL["job_latest_state"] = f"WITH {_EVENTS} SELECT * FROM s"
SQL["job_recovery"] = f"""
WITH {_EVENTS} SELECT CASE WHEN status IN ('pending', 'running') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('pending', 'running') THEN 'interrupted' ELSE error END AS error, count(*) AS n FROM s GROUP BY 1, 2
"""
SQL["stream_job_states"] = f"WITH {_EVENTS} SELECT s.job_id, s.status, s.phase, (SELECT max(ts) FROM e WHERE e.job_id = s.job_id) AS ts FROM s"
SQL["stream_event_windows"] = """
SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOURS AS "end", event_type AS status, count(*) AS n FROM events GROUP BY 1, 2, 3
"""
SQL["upsert_latest_per_key"] = "SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"
SQL["cache_ttl_left_anti"] = """
SELECT DISTINCT CAST(user_id AS VARCHAR) AS url FROM events WHERE user_id NOT IN (
  SELECT user_id FROM events WHERE event_type = 'purchase' GROUP BY user_id HAVING max(ts) > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOURS)
"""

SQL["cache_lookup"] = """
WITH c AS (SELECT user_id, max(ts) AS m FROM events WHERE event_type = 'purchase' AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1)
SELECT CAST(u.user_id AS VARCHAR) AS url, CASE WHEN m > TIMESTAMP '2024-01-13 12:00:00' THEN m END AS scraped_at, coalesce(m > TIMESTAMP '2024-01-13 12:00:00', FALSE) AS found FROM (SELECT DISTINCT user_id FROM events) AS u LEFT JOIN c USING (user_id)
"""

# --- display -----------------------------------------------------------------------


def _priority(col: str) -> str:
    known = " ".join(f"WHEN lower({col}) IN {_list(names)} THEN {i}" for i, names in enumerate(fixed.COLUMN_PRIORITY))
    return (
        f"CASE {known} WHEN ends_with(lower({col}), '_url') OR lower({col}) IN ('url', 'homepage', 'link') THEN 1"
        f" WHEN contains(lower({col}), 'description') OR contains(lower({col}), 'summary') OR contains(lower({col}), 'note') THEN 3 ELSE 2 END"
    )


SQL["display_confidence_bands"] = f"""
WITH {_CELLS} SELECT query_id, k AS row_pos, col, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band, {_priority("col")} AS priority FROM c
"""
SQL["display_columns_sorted"] = f"""
WITH n AS (SELECT p_partkey, list_concat(list_concat([p_type, 'site_url', 'notes'], CASE WHEN p_size % 2 = 0 THEN ['summary', 'name'] ELSE ['homepage'] END), [p_brand, 'founded']) AS cols FROM part),
u AS (SELECT p_partkey, unnest(cols) AS col, unnest(range(len(cols))) AS i FROM n)
SELECT p_partkey, array_to_string(list(col ORDER BY {_priority("col")}, i), '|') AS columns FROM u GROUP BY 1
"""
SQL["display_short_urls"] = f"""
SELECT page_id, CASE WHEN length(s) > 24 THEN left(s, 23) || '…' ELSE s END AS shown FROM (SELECT page_id, {_domain("url")} || CASE WHEN {_path("url")} = '' THEN '/' ELSE {_path("url")} END AS s FROM pages)
"""
SQL["display_requirement_filter"] = """
WITH r AS (SELECT s_suppkey, s_suppkey % 4 AS total, least(s_suppkey % 3, s_suppkey % 4) AS met FROM supplier), c AS (SELECT unnest(['all', 'all-req', '2plus', '1plus']) AS choice)
SELECT choice, s_suppkey FROM r, c WHERE total = 0 OR CASE choice WHEN 'all' THEN TRUE WHEN 'all-req' THEN met = total WHEN '2plus' THEN met >= 2 ELSE met >= 1 END
"""
SQL["display_badges"] = f"""
WITH {_SCORED}, r AS (SELECT s.*, m.mean, row_number() OVER (PARTITION BY s.query_id ORDER BY final DESC, s.k) AS rank_position FROM scored AS s JOIN mixed AS m USING (query_id, k))
SELECT query_id, k AS row_pos, '#' || rank_position || CASE WHEN final > 0 THEN '|score ' || printf('%.2f', final) ELSE '' END || '|' || sources || ' src|' || CASE WHEN mean >= 0.8 THEN 'high' WHEN mean >= 0.5 THEN 'medium' ELSE 'low' END || ' conf'
  || CASE WHEN sources <= 1 AND n > 1 THEN '|single-source' ELSE '' END AS badges FROM r
"""

# --- whole evaluations: the plans, names and pages of the catalog, worked out by hand ----

#: Places of which a part, or a substring, says "us": New York, Austin, Texas, Boise and Australia.
_US = "(1, 3, 6, 11, 12)"
SQL["requirement_summary"] = f"""
WITH {_CELLS}, s AS (
  SELECT e.query_id, e.k, max(CASE WHEN c.col = 'headquarters' THEN CASE WHEN list_position({_array(_PLACES)}, c.value) IN {_US} THEN 1 ELSE 0 END END) AS place,
    max(CASE WHEN c.col = 'funding' THEN CASE WHEN CAST(regexp_extract(c.value, '(\\d+)', 1) AS BIGINT) * 1000 > 4000000 THEN 1 ELSE 0 END END) AS money, max(CASE WHEN c.col = 'focus_area' THEN 1 ELSE 0 END) AS topic
  FROM e LEFT JOIN c USING (query_id, k) GROUP BY 1, 2
), n AS (SELECT *, coalesce(place, 0) + coalesce(money, 0) AS hard, coalesce(1 - place, 0) + coalesce(1 - money, 0) AS lost FROM s)
SELECT query_id, k AS row_pos, 4 AS requirements_total, hard + coalesce(topic, 0) AS requirements_satisfied, lost AS requirements_failed, 4 - hard - coalesce(topic, 0) - lost AS requirements_unknown,
  hard AS hard_satisfied, lost AS hard_failed, (hard + coalesce(topic, 0)) / 4 AS satisfaction_ratio FROM n
"""
SQL["eval_label_prf"] = f"""
WITH {_CELLS}, x AS (SELECT query_id, k, k % 8 = 0 AND k % 13 <> 0 AND k % 11 <> 0 AS found FROM e WHERE k % 4 = 0),
n AS (SELECT query_id, count(*) FILTER (has_name > 0) AS named FROM facts GROUP BY 1)
SELECT query_id, count(*) AS expected, count(*) FILTER (found) AS matched, round_even(count(*) FILTER (found) / greatest(max(named), 1), 3) AS entity_precision, round_even(count(*) FILTER (found) / count(*), 3) AS entity_recall
FROM x JOIN n USING (query_id) GROUP BY 1
"""
SQL["verify_reject_reason"] = f"""
WITH {_SCORED}, w AS (SELECT s.*, EXISTS (SELECT 1 FROM c WHERE c.query_id = s.query_id AND c.k = s.k AND c.col = 'website') AS site FROM scored AS s)
SELECT query_id, k AS row_pos, CASE WHEN has_name = 0 OR (n = 1 AND sources < 2 AND owned = 0) THEN 'not_viable' WHEN k % 8 IN (0, 2, 5) THEN 'cta_text' WHEN k % 8 = 3 THEN 'article_title'
  WHEN k % 8 = 6 AND owned = 0 AND acts <= 1 AND (NOT site OR sources < 3) THEN 'pseudo_entity' ELSE 'ok' END AS reason FROM w
"""
SQL["final_cap_guarded"] = f"""
WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, k) AS rank_position, query_id = 'q2' OR {_BAD} AS bad FROM scored),
g AS (SELECT * FROM r QUALIFY NOT bad OR min(CAST(bad AS INTEGER)) OVER (PARTITION BY query_id) = 1)
SELECT query_id, k AS row_pos, rank_position FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank_position) <= CASE WHEN query_id IN ('q1', 'q5') THEN 4 ELSE 6 END
"""
SQL["official_site_argmax"] = f"""
WITH p AS (SELECT page_id, {_homepage("url")} AS home, string_split({_domain("url")}, '.')[-3] AS label, {_NAME_KEY.format("left(" + _visible("html") + ", 200)")} AS head FROM pages),
n AS (SELECT label, min(page_id) AS row_pos, {_NAME_KEY.format("label")} AS key FROM p GROUP BY 1)
SELECT row_pos, home AS url, CAST(1.0 AS DOUBLE) AS score FROM n JOIN p ON contains({_NAME_KEY.format("p.label || ' official'")}, key) OR contains(head, key) WHERE length(key) >= 2
QUALIFY row_number() OVER (PARTITION BY row_pos ORDER BY page_id) = 1
"""
# An entity without a name is not asked about; one of a general name is like others.
SQL["gap_fill_accept"] = f"""
WITH {_CELLS}, x AS (SELECT e.query_id, e.k, e.k % 13 <> 0 AS named, list(c.value ORDER BY c.pos) FILTER (c.col IS NOT NULL) AS vals, list(c.col) AS cols FROM e LEFT JOIN c USING (query_id, k) GROUP BY 1, 2)
SELECT query_id, k AS row_pos, named AS gap_filled,
  array_to_string(list_concat(coalesce(vals, []), CASE WHEN NOT named THEN [] WHEN list_contains(cols, 'funding') THEN ['product_or_service of official_site'] ELSE ['funding of official_site', 'product_or_service of official_site'] END), '|') AS cell_values FROM x
"""
_KIND = f"""
{_ASKED}, said AS (
  SELECT CAST(p_partkey AS VARCHAR) AS query_id, p_partkey % 9 AS k, ['best ', '', 'Top ', 'leading ', 'must visit '][CAST(p_size % 5 + 1 AS INTEGER)] AS head, p_name,
    CASE WHEN p_size % 5 = 4 THEN 'must visit ' ELSE '' END || p_name || CASE WHEN p_partkey % 9 = 2 THEN ' open source' ELSE '' END AS topic FROM part)
"""
SQL["requirements_parse"] = f"""
WITH {_KIND}, r AS (
  SELECT query_id, unnest(CASE k
    WHEN 0 THEN [{{'id': 'loc_0', 'label': 'Location: Brooklyn', 'kind': 'location', 'operator': 'contains', 'target_value': 'brooklyn', 'is_hard': TRUE}}, {{'id': 'topic_0', 'label': 'Topic: ' || topic, 'kind': 'semantic', 'operator': 'matches_topic', 'target_value': topic, 'is_hard': FALSE}}]
    WHEN 1 THEN [{{'id': 'loc_0', 'label': 'Location: Germany', 'kind': 'location', 'operator': 'contains', 'target_value': 'germany', 'is_hard': TRUE}}, {{'id': 'fund_0', 'label': 'Funding > 5M', 'kind': 'numeric', 'operator': 'greater_than', 'target_value': '5M', 'is_hard': TRUE}},
      {{'id': 'stage_0', 'label': 'Stage: startup', 'kind': 'categorical', 'operator': 'contains', 'target_value': 'startup', 'is_hard': FALSE}}, {{'id': 'topic_0', 'label': 'Topic: ' || topic, 'kind': 'semantic', 'operator': 'matches_topic', 'target_value': topic, 'is_hard': FALSE}}]
    WHEN 2 THEN [{{'id': 'lic_0', 'label': 'License: open-source', 'kind': 'categorical', 'operator': 'exists', 'target_value': 'open-source', 'is_hard': FALSE}}, {{'id': 'topic_0', 'label': 'Topic: ' || topic, 'kind': 'semantic', 'operator': 'matches_topic', 'target_value': topic, 'is_hard': FALSE}}]
    WHEN 3 THEN [{{'id': 'founded_0', 'label': 'Founded after 1999', 'kind': 'numeric', 'operator': 'greater_than', 'target_value': '1999', 'is_hard': FALSE}}]
    WHEN 7 THEN [{{'id': 'emp_0', 'label': 'Employees > 50', 'kind': 'numeric', 'operator': 'greater_than', 'target_value': '50', 'is_hard': FALSE}}, {{'id': 'topic_0', 'label': 'Topic: ' || topic, 'kind': 'semantic', 'operator': 'matches_topic', 'target_value': topic, 'is_hard': FALSE}}]
    ELSE [] END) AS r FROM said
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY r.id = 'topic_0', r.id <> 'loc_0', r.id <> 'fund_0') - 1 AS pos, r.id AS id, r.label AS label, r.kind AS kind, r.operator AS operator, r.target_value AS target_value, r.is_hard AS is_hard FROM r
"""
SQL["plan_columns_augmented"] = f"""
WITH {_ASKED}, {_FAMILY} SELECT query_id, family, array_to_string({_TEMPLATE}, '|') || CASE CAST(query_id AS BIGINT) % 9 WHEN 1 THEN '|funding' WHEN 3 THEN '|founded' WHEN 7 THEN '|employees' ELSE '' END AS columns FROM families
"""
SQL["query_normalize"] = f"""
WITH {_KIND} SELECT a.query_id, CASE k WHEN 0 THEN head || p_name || ' restaurants in Brooklyn, NY' WHEN 1 THEN head || p_name || ' startups in Germany with funding 5 M' ELSE a.query END AS normalized FROM asked AS a JOIN said USING (query_id)
"""
_SHOWN = ("name", "website", "headquarters", "focus_area", "product_or_service", "stage_or_status", "funding")
SQL["csv_flatten"] = f"""
WITH {_SCORED}, r AS (SELECT s.query_id, s.k, s.sources, m.mean, row_number() OVER (PARTITION BY s.query_id ORDER BY final DESC, s.k) AS line_pos FROM scored AS s JOIN mixed AS m USING (query_id, k)),
f AS (
  SELECT query_id, k, col, CASE WHEN contains(value, ',') THEN '"' || value || '"' ELSE value END || ',https://s' || site || '.example.org/p,' || CAST(CAST(confidence AS DOUBLE) AS VARCHAR) AS three FROM c
), w AS (
  SELECT r.query_id, r.line_pos, 'supplier' || lpad(CAST(r.k AS VARCHAR), 9, '0') || {" || ".join(f"',' || coalesce(max(three) FILTER (col = '{x}'), ',,')" for x in _SHOWN)}
    || ',' || any_value(sources) || ',' || CAST(CAST(any_value(mean) AS DOUBLE) AS VARCHAR) AS line FROM r LEFT JOIN f USING (query_id, k) GROUP BY 1, 2, r.k
)
SELECT 'q' || unnest(range(8)) AS query_id, 0 AS line_pos, 'entity_id,{",".join(f"{x},{x}_source_url,{x}_confidence" for x in _SHOWN)},sources_count,aggregate_confidence' AS line
UNION ALL SELECT query_id, line_pos, line FROM w
"""
SQL["eval_run_summary"] = f"""
WITH m AS ({SQL["eval_fill_metrics"]})
SELECT count(*) AS queries, avg(rows_returned) AS avg_rows, {", ".join(f"round_even(avg({x}), 3) AS {x}" for x in ("fill_rate", "actionable_rate", "official_site_rate", "multi_source_rate", "avg_aggregate_confidence"))}, 5.25 AS median_duration
FROM m WHERE query_id <> 'q8'
"""
