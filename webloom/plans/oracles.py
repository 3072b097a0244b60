"""DuckDB SQL for the queries of ``webloom.plans.queries``."""

from __future__ import annotations

from webloom.functions import html
from webloom.plans.queries import ROBOTS, SEARCH, WORDS
from webloom.plans.search import query_terms


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def parts(u: str) -> str:
    """A struct of protocol, host, port, rest."""
    tail = f"substr({u}, strpos({u}, '//') + 2)"
    auth = f"split_part({tail}, '/', 1)"
    absolute = f"strpos({u}, '//') > 1"
    return (
        f"{{'protocol': CASE WHEN {absolute} THEN substr({u}, 1, strpos({u}, '//') - 2) END, "
        f"'host': CASE WHEN {absolute} THEN CASE WHEN strpos({auth}, ':') > 1 THEN substr({auth}, 1, strpos({auth}, ':') - 1) ELSE {auth} END END, "
        f"'port': CASE WHEN {absolute} AND strpos({auth}, ':') > 1 THEN substr({auth}, strpos({auth}, ':') + 1) END, "
        f"'rest': CASE WHEN NOT {absolute} THEN {u} WHEN strpos({tail}, '/') > 0 THEN substr({tail}, strpos({tail}, '/')) ELSE '/' END}}"
    )


def port(p: str) -> str:
    return f"CASE {p}.protocol WHEN 'http' THEN '80' WHEN 'https' THEN '443' END"


def seed(p: str) -> str:
    return f"{p}.protocol || '://' || {p}.host || ':' || coalesce({p}.port, {port(p)}) || split_part({p}.rest, '#', 1)"


def links(h: str) -> str:
    return (
        f"list_transform(list_filter(list_transform(flatten(list_transform(list_filter(regexp_extract_all({h}, '<([^/][^>]*)>', 1), "
        r"lambda t: lower(string_split_regex(t, '\s+')[1]) = 'a'), lambda t: list_filter(string_split_regex(t, '\s+'), lambda x: contains(x, 'href=')))), "
        "lambda x: substr(x, strpos(x, '=') + 1)), lambda x: length(x) > 1), lambda x: substr(x, 2, length(x) - 2))"
    )


def normalize(link: str, p: str, base: str, b: str) -> str:
    rest = f"split_part({p}.rest, '#', 1)"
    ups = f"(length(regexp_extract({rest}, '^(?:\\.\\./)*')) / 3)::INTEGER"
    folders = f"string_split(regexp_extract({base}, '^(.*)/[^/]*$', 1), '/')"
    site = f"{b}.protocol || '://' || {b}.host || ':' || coalesce({b}.port, {port(b)})"
    return (
        f"CASE WHEN {p}.protocol IS NULL AND contains({p}.rest, '#') AND {rest} = '' THEN {base} "
        f"WHEN regexp_extract({rest}, '\\.[^.]*$') IN ('.jpg', '.jpeg', '.gif', '.png', '.txt') THEN NULL "
        f"WHEN {p}.protocol IS NULL AND ({rest} = '' OR starts_with({rest}, '/')) THEN {site} || {rest} "
        f"WHEN {p}.protocol IS NULL THEN array_to_string({folders}[1:greatest(len({folders}) - {ups}, 1)], '/') || '/' || substr({rest}, 3 * {ups} + 1) "
        f"WHEN {p}.port IS NULL THEN {p}.protocol || '://' || {p}.host || ':' || {port(p)} || {rest} ELSE {link} END"
    )


def key(u: str) -> str:
    k = f"(('0x' || substr(sha1({u}), 2 * i + 1, 2))::INTEGER)"
    one = f"(CASE WHEN {k} = 0 THEN 255 WHEN {k} > 127 THEN {k} - 1 ELSE {k} END)"
    return f"array_to_string(list_transform(range(20), lambda i: chr((97 + {one} % 26)::INTEGER) || chr((97 + 2 * ({one} // 26))::INTEGER)), '')"


PAGE_WORDS = r"""list_distinct(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(lower(page), '<.*?>', ' ', 'g'), '[.,:;!?''"()-]', ' ', 'g'), '[\t\n\r]', ' ', 'g'), ' '), lambda x: x <> ''))"""
HTML_TEXT = f"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(page, '{html.SCRIPT}', ' ', 'g'), '{html.STYLE}', ' ', 'g'), '{html.ANY_TAG}', ' ', 'g'), '{html.NO_LETTER}', ' ', 'g'))"
HP_WORDS = (
    f"list_filter(flatten(list_transform(list_concat(regexp_extract_all(page, '{html.HEADING}', 1), regexp_extract_all(page, '{html.PARAGRAPH}', 1)), "
    f"lambda b: string_split_regex(lower(regexp_replace(regexp_replace(b, '{html.ANY_TAG}', ' ', 'g'), '{html.NO_LETTER}', ' ', 'g')), ' +'))), lambda x: x <> '')"
)
INSIDE = f"regexp_extract(page, '{html.HEAD}', 1)"
TITLE = f"CASE WHEN regexp_matches(page, '{html.HEAD}') AND regexp_matches({INSIDE}, '{html.TITLE}') THEN regexp_extract({INSIDE}, '{html.TITLE}', 1) END"

CRAWL = f"parsed AS (SELECT *, {parts('url')} AS p FROM pages), crawl AS (SELECT page_id, {seed('p')} AS url, html AS page, strlen(html)::BIGINT AS length FROM parsed)"
HTML_TF = (
    f"{CRAWL}, tx AS (SELECT url, {HTML_TEXT} AS text FROM crawl), wl AS (SELECT url, text, list_filter(string_split_regex(text, ' +'), lambda x: x <> '') AS words FROM tx), "
    "wt AS (SELECT url, words, len(words) - CASE WHEN starts_with(text, ' ') THEN 0 ELSE 1 END AS total FROM wl), "
    "tf AS (SELECT url, term, count(*)::DOUBLE / total AS tf FROM (SELECT url, total, unnest(words) AS term FROM wt) WHERE total <> 0 GROUP BY url, term, total)"
)
HP_TF = (
    f"{CRAWL}, wl AS (SELECT url, {HP_WORDS} AS words FROM crawl), "
    "tf AS (SELECT url, term, count(*)::DOUBLE / total AS tf FROM (SELECT url, len(words) - 1 AS total, unnest(words) AS term FROM wl) WHERE total <> 0 GROUP BY url, term, total)"
)
IDF = "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM crawl), w AS (SELECT url, term, tf * ln(n / df::DOUBLE) AS tfidf FROM tf JOIN df USING (term), n)"

GRAPH = (
    "links AS (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 "
    "WHERE a.l_quantity > 45 AND a.l_suppkey <> b.l_suppkey), deg AS (SELECT src, count(*) AS n FROM links GROUP BY src), r0 AS (SELECT s_suppkey AS node, 1.0::DOUBLE AS rank FROM supplier)"
)


def rounds(n: int) -> str:
    out = GRAPH
    for k in range(1, n + 1):
        out += (
            f", i{k} AS MATERIALIZED (SELECT dst AS node, sum(rank / n) AS came FROM links JOIN deg USING (src) JOIN r{k - 1} ON r{k - 1}.node = links.src GROUP BY dst), "
            f"r{k} AS MATERIALIZED (SELECT r.node, 0.15 + 0.85 * coalesce(came, 0) AS rank, r.rank AS prev FROM r{k - 1} r LEFT JOIN i{k} USING (node))"
        )
    return out


def converged(n: int, threshold: float) -> str:
    """Ranks after the first of n rounds in which no rank moved by more than the threshold."""
    every = " UNION ALL ".join(f"SELECT {k} AS k, node, rank, prev FROM r{k}" for k in range(1, n + 1))
    return f"WITH {rounds(n)}, every AS ({every}), done AS (SELECT k FROM every GROUP BY k HAVING max(abs(rank - prev)) <= {threshold}) SELECT node, round(rank, 9) AS rank FROM every WHERE k = (SELECT min(k) FROM done)"


def searched(norm: str = "global") -> str:
    tokens = query_terms(SEARCH, False)
    asked = ", ".join(f"({lit(x)}, {tokens.count(x)}, {tokens.count(x) / len(tokens)!r}::DOUBLE)" for x in sorted(set(tokens)))
    below = "(SELECT sqrt(sum(times * tfidf * tfidf)) FROM f)" if norm == "global" else "sqrt(own)"
    zero = "'nan'::DOUBLE" if norm == "global" else "0.0"
    return (
        f"{HTML_TF}, {IDF}, asked(term, times, qtf) AS (VALUES {asked}), f AS (SELECT * FROM w JOIN asked USING (term)), "
        "q AS (SELECT term, qtf * ln((SELECT n FROM n) / count(*)::DOUBLE) AS q FROM f GROUP BY term, qtf), "
        "s AS (SELECT url, sum(times * tfidf * q) AS dot, sum(times * tfidf * tfidf) AS own FROM f JOIN q USING (term) GROUP BY url), "
        f"c AS (SELECT url, {below} * (SELECT sqrt(sum(q * q)) FROM q) AS below, dot FROM s), "
        f"k AS (SELECT url, CASE WHEN below = 0 THEN {zero} ELSE dot / below END AS score FROM c), "
        # PageRank of pages that no crawled page links to
        "ranks AS (SELECT url, 0.15::DOUBLE AS rank FROM crawl), "
        "res AS (SELECT k.url, k.score + coalesce(rank, 0) AS score FROM k LEFT JOIN ranks USING (url))"
    )


def robot_sql(what: str) -> str:
    rules = ", ".join(f"({lit(d)}, {lit(r)})".replace("\n", "' || chr(10) || '") for d, r in ROBOTS)
    body = lambda agent: f"list_filter(flatten(list_transform(regexp_extract_all(chr(10) || robots || chr(10), '\\nUser-agent: {agent}\\n((?:[^\\n]+\\n)*)', 1), lambda b: string_split(b, chr(10)))), lambda x: contains(x, ':'))"
    value = "substr(x, strpos(x, ':') + 2)"
    own = f"(SELECT page_id, p.rest AS path, coalesce(robots, '') AS robots FROM parsed LEFT JOIN rules ON domain = split_part(p.host, '.', -1))"
    if what == "allowed":
        first = lambda agent: f"list_transform(list_filter({body(agent)}, lambda x: {value} <> '' AND starts_with(path, {value})), lambda x: split_part(x, ':', 1) <> 'Disallow')"
        out = f"coalesce(list_concat({first('webloom')}, {first(chr(92) + '*')})[1], TRUE) AS allowed"
    else:
        first = lambda agent: f"list_transform(list_filter({body(agent)}, lambda x: split_part(x, ':', 1) = 'Crawl-delay'), lambda x: substr(x, strpos(x, ':') + 1))"
        out = f"coalesce(try_cast(trim(list_concat({first('webloom')}, {first(chr(92) + '*')})[1]) AS DOUBLE) * 1000, 1000.0) AS delay_ms"
    return f"WITH {CRAWL}, rules(domain, robots) AS (VALUES {rules}), o AS {own} SELECT page_id, {out} FROM o"


MADE = "['#top', 'next.html#a', '../up/x.html', '../../../../far', '/abs?q=1#f', 'http://other.com/p#x', 'https://other.com', 'https://o.com:8443/a#b', 'ftp://f.org/x', 'pic.jpg', '/a/b.txt#z', 'mailto:a@b.c', '//cdn.net/y.js', '']"
LINKS = (
    f"{CRAWL}, l AS (SELECT DISTINCT page_id, url AS base, unnest(list_concat({MADE}, {links('page')})) AS link FROM crawl), "
    f"lp AS (SELECT *, {parts('link')} AS lp, {parts('base')} AS bp FROM l), "
    f"norm AS (SELECT page_id, link, {normalize('link', 'lp', 'base', 'bp')} AS url FROM lp)"
)
PAGE_LINKS = (
    f"{CRAWL}, l AS (SELECT page_id, url AS base, unnest({links('page')}) AS link FROM crawl), lp AS (SELECT *, {parts('link')} AS lp, {parts('base')} AS bp FROM l), "
    f"norm AS (SELECT page_id, base, {normalize('link', 'lp', 'base', 'bp')} AS url FROM lp)"
)
PUTS = "SELECT user_id::VARCHAR AS key, event_type AS \"column\", value, ts, event_id FROM events"
FILTER = (
    "NOT (contains(url, 'creativecommons.org') OR contains(url, 'robtex.com') OR contains(url, '%') OR contains(url, 'aljazeeramubasher') OR contains(url, 'poemhunter') OR contains(url, 'pinterest.com') OR contains(url, 'archive.org')) "
    "AND NOT (contains(url, 'wiki') AND (NOT (contains(url, 'wikipedia') OR contains(url, 'wikinews')) OR (strpos(url, '.') > 2 AND substr(url, strpos(url, '.') - 2, 2) <> 'en'))) "
    "AND NOT (contains(url, '.') AND length(split_part(url, '.', -1)) >= 3 AND substr(split_part(url, '.', -1), 1, 3) NOT IN ('com', 'org', 'net', 'edu', 'int', 'gov', 'mil'))"
)
MORE_URLS = "VALUES (-1, 'http://en.wikipedia.org'), (-2, 'http://de.wikipedia.org/x'), (-3, 'https://wiki.foo.com'), (-4, 'http://a.wikinews.org'), (-5, 'http://x.com/a%20b'), (-6, 'http://archive.org'), (-7, 'http://h.gov'), (-8, 'http://h.co'), (-9, 'nodots')"

SQL: dict[str, str] = {
    "parallelize": "SELECT * FROM (VALUES " + ", ".join(f"({lit(w)})" for w in WORDS) + ") v(value)",
    "from_table": "SELECT concat_ws(',', o_orderkey::VARCHAR, o_orderpriority) AS value FROM orders WHERE o_orderstatus = 'F'",
    "collect": "SELECT r_name AS value FROM region",
    "take": "SELECT c_name AS value FROM customer ORDER BY c_custkey LIMIT 7",
    "kv_range_scan": "SELECT c_name AS key, c_mktsegment FROM customer WHERE c_name >= 'Customer#000000010' AND c_name < 'Customer#000000050'",
    "kv_get_row": "SELECT c_name AS key, c_custkey, c_mktsegment FROM customer WHERE c_name = 'Customer#000000042'",
    "kv_get_cell": "SELECT c_mktsegment AS value FROM customer WHERE c_name = 'Customer#000000042'",
    "kv_exists": "SELECT key, EXISTS (SELECT 1 FROM customer WHERE c_name = key) AS found FROM (VALUES ('Customer#000000001'), ('Customer#000000099'), ('nobody')) v(key)",
    "kv_count": "SELECT count(DISTINCT o_custkey) AS n FROM orders",
    "kv_page_view": "WITH a AS (SELECT c_name AS key, c_nationkey FROM customer WHERE c_name >= 'Customer#000000020' ORDER BY 1 LIMIT 11) SELECT key, c_nationkey, (SELECT key FROM a ORDER BY key LIMIT 1 OFFSET 10) AS next_key FROM a ORDER BY key LIMIT 10",
    "kv_upsert_last_wins": f"WITH p AS ({PUTS}), r AS (SELECT *, row_number() OVER (PARTITION BY key, \"column\" ORDER BY event_id % 2 DESC, ts DESC, event_id DESC) AS n FROM p) SELECT key, \"column\", value FROM r WHERE n = 1",
    "kv_put_row_replace": "SELECT c_name AS key, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT 'new', 1.5",
    "kv_conditional_put": "SELECT c_name AS key, 'segment' AS \"column\", CASE WHEN c_mktsegment = 'BUILDING' THEN 'MOVED' ELSE c_mktsegment END AS value FROM customer",
    "rdd_flat_map": r"SELECT value, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \n]+')) AS value FROM documents) WHERE value <> '' GROUP BY value",
    "rdd_map_to_pair": "SELECT p_brand AS k, p_name AS v FROM part",
    "rdd_flat_map_to_pair": "SELECT unnest(string_split(p_name, ' ')) AS k, length(p_name)::INTEGER AS v FROM part",
    "pair_flat_map": "SELECT p_brand || ':' || unnest(string_split(p_name, ' ')) AS value FROM part",
    "pair_flat_map_to_pair": "SELECT unnest(string_split(p_name, ' ')) AS k, p_brand AS v FROM part",
    "rdd_filter": "SELECT strftime(l_shipdate, '%Y-%m-%d') AS value FROM lineitem WHERE year(l_shipdate) = 1995",
    "map_partitions": "SELECT upper(substr(c_name, 1, 10)) AS value FROM customer",
    "pair_join": "SELECT o_custkey AS k, o_orderkey::VARCHAR || ',' || c_name AS v FROM orders JOIN customer ON c_custkey = o_custkey",
    "pair_cogroup": (
        "WITH a AS (SELECT o_custkey AS k, string_agg(lpad(o_orderkey::VARCHAR, 12, '0'), ',' ORDER BY lpad(o_orderkey::VARCHAR, 12, '0')) AS x FROM orders GROUP BY 1), "
        "b AS (SELECT c_custkey AS k, string_agg(c_mktsegment, ',' ORDER BY c_mktsegment) AS y FROM customer GROUP BY 1) "
        "SELECT k, '[' || coalesce(x, '') || '],[' || coalesce(y, '') || ']' AS v FROM a FULL JOIN b USING (k)"
    ),
    "pair_save_as_rows": "SELECT o_custkey AS k, string_agg(o_orderpriority, '|' ORDER BY o_orderpriority) AS v FROM orders GROUP BY 1",
    "rdd_fold_sum": "SELECT sum(l_quantity::BIGINT)::BIGINT AS value FROM lineitem",
    "rdd_fold_max": "SELECT max(o_totalprice) AS value FROM orders",
    "fold_by_key_sum": "SELECT l_partkey AS k, sum(l_quantity::BIGINT)::BIGINT AS v FROM lineitem GROUP BY 1",
    "fold_by_key_count": "SELECT o_orderpriority AS k, count(*) AS v FROM orders GROUP BY 1",
    "fold_by_key_concat": "SELECT n_regionkey AS k, string_agg(n_name, ',' ORDER BY n_name) AS v FROM nation GROUP BY 1",
    "rdd_count": "SELECT count(*) AS n FROM lineitem",
    "rdd_distinct": "SELECT DISTINCT l_suppkey AS value FROM lineitem",
    "rdd_group_by": "SELECT substr(n_name, 1, 1) AS k, string_agg(n_name, ',' ORDER BY n_name) AS v FROM nation GROUP BY 1",
    "rdd_intersection": "SELECT l_partkey AS value FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 49",
    "url_hash": f"SELECT page_id, {key('url')} AS hash FROM pages",
    "key_encode": "SELECT page_id, array_to_string(list_transform(string_split(url, ''), lambda c: CASE WHEN regexp_matches(c, '^[a-zA-Z0-9-]$') THEN c ELSE '_' || printf('%x', unicode(c)) END), '') AS encoded, TRUE AS back FROM pages",
    "url_parse": f"WITH {CRAWL} SELECT page_id, p.protocol, p.host, p.port, p.rest FROM parsed",
    "url_seed_normalize": f"WITH {CRAWL} SELECT page_id, url FROM crawl",
    "url_normalize": f"WITH {LINKS} SELECT page_id, link, url FROM norm",
    "url_filter": f"WITH u AS (SELECT page_id, url FROM pages UNION ALL ({MORE_URLS})) SELECT page_id, url FROM u WHERE {FILTER}",
    "query_string_parse": (
        "WITH u AS (SELECT page_id, split_part(url, '#', 1) AS url FROM pages UNION ALL (VALUES (-1, '/s?a=1&b=&c&a=x%20y+z&d=1=2'), (-2, '/none'))), "
        "x AS (SELECT page_id, unnest(string_split(substr(url, strpos(url, '?') + 1), '&')) AS x, generate_subscripts(string_split(substr(url, strpos(url, '?') + 1), '&'), 1) AS i FROM u WHERE contains(url, '?')), "
        "y AS (SELECT page_id, i, url_decode(replace(split_part(x, '=', 1), '+', ' ')) AS k, CASE WHEN len(string_split(x, '=')) = 2 THEN url_decode(replace(split_part(x, '=', 2), '+', ' ')) ELSE '' END AS v FROM x) "
        "SELECT page_id, k, arg_max(v, i) AS v FROM y GROUP BY page_id, k"
    ),
    "extract_links": f"WITH l AS (SELECT page_id, {links('html')} AS l FROM pages) SELECT page_id, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, unnest(l) AS link FROM l",
    "extract_links_b": r"""WITH l AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?i)<a\s+(?:[^>]*?\s+)?href="([^"]*)"', 1), lambda x: trim(x)) AS l FROM pages) SELECT page_id, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, unnest(l) AS link FROM l""",
    "link_out_degree": f"WITH {PAGE_LINKS} SELECT pages.page_id, count(DISTINCT norm.url)::INTEGER AS degree FROM pages LEFT JOIN norm ON norm.page_id = pages.page_id GROUP BY pages.page_id",
    "page_title": f"WITH {CRAWL} SELECT page_id, {TITLE} AS title FROM crawl",
    "page_clean": f"WITH {CRAWL} SELECT page_id, array_to_string(list_sort({PAGE_WORDS}), ' ') AS words FROM crawl",
    "html_to_words": f"WITH {CRAWL}, x AS (SELECT page_id, {HTML_TEXT} AS t FROM crawl), y AS (SELECT page_id, t, list_filter(string_split_regex(t, ' +'), lambda x: x <> '') AS w FROM x) SELECT page_id, array_to_string(w, ' ') AS words, (len(w) - CASE WHEN starts_with(t, ' ') THEN 0 ELSE 1 END)::INTEGER AS total FROM y",
    "heading_paragraph_tokens": f"WITH {CRAWL} SELECT page_id, array_to_string({HP_WORDS}, ' ') AS words FROM crawl",
    "robots_allowed": robot_sql("allowed"),
    "robots_delay": robot_sql("delay"),
    "dictionary_filter": f"WITH {CRAWL}, d AS (SELECT DISTINCT trim(w) AS word FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark) WHERE length(trim(w)) > 2), x AS (SELECT unnest({HP_WORDS}) AS word FROM crawl) SELECT word, count(*) AS n FROM x WHERE word IN (SELECT word FROM d) GROUP BY word",
    "inverted_index": f"WITH {CRAWL}, x AS (SELECT DISTINCT unnest({PAGE_WORDS}) AS term, url FROM crawl) SELECT term, string_agg(url, ',' ORDER BY url) AS urls FROM x GROUP BY term",
    "inverted_index_blocks": f"WITH {CRAWL}, x AS (SELECT DISTINCT unnest({PAGE_WORDS}) AS term, url FROM crawl), b AS (SELECT term, url, ('0x' || substr(md5(url), 1, 8))::BIGINT % ceil(count(*) OVER (PARTITION BY term) / 50.0)::BIGINT AS block FROM x) SELECT term, block, string_agg(url, ',' ORDER BY url) AS urls FROM b GROUP BY term, block",
    "df_count": f"WITH {HTML_TF} SELECT term, count(*) AS df FROM tf GROUP BY term",
    "tf_html": f"WITH {HTML_TF} SELECT url, term, round(tf, 9) AS tf FROM tf",
    "tfidf_html": f"WITH {HTML_TF}, {IDF} SELECT url, term, round(tfidf, 9) AS tfidf FROM w",
    "tfidf_heading_paragraph": f"WITH {HP_TF}, {IDF} SELECT url, term, round(tfidf, 9) AS tfidf FROM w",
    "pagerank_fixed": f"WITH {rounds(3)} SELECT node, round(rank, 9) AS rank FROM r3",
    "pagerank_converged_pct": f"WITH {rounds(3)} SELECT round(avg(CASE WHEN abs(rank - prev) <= 0.05 THEN 1.0 ELSE 0.0 END) * 100, 6) AS percent FROM r3",
    "pagerank_converged": converged(25, 0.01),
    "search_ranked": f"WITH {searched()} SELECT res.url, round(score, 6) AS score, {TITLE} AS title FROM res LEFT JOIN crawl USING (url)",
    "search_per_doc": f"WITH {searched('per_doc')} SELECT url, round(score, 6) AS score FROM res",
    "search_topk": f"WITH {searched()} SELECT url, round(score, 6) AS score FROM res ORDER BY round(score, 9) DESC, url LIMIT 10",
    "search_json": f"WITH {searched()}, b AS (SELECT res.url, score, {TITLE} AS title FROM res LEFT JOIN crawl USING (url) ORDER BY round(score, 9) DESC, url LIMIT 10) SELECT '{{\"data\":[' || string_agg('{{\"url\":' || to_json(url) || CASE WHEN title IS NULL THEN '' ELSE ',\"title\":' || to_json(title) END || '}}', ',' ORDER BY round(score, 9) DESC, url) || ']}}' AS json FROM b",
    "crawl_unvisited_anti_join": f"WITH {CRAWL} SELECT DISTINCT url FROM crawl WHERE url NOT IN (SELECT url FROM crawl WHERE contains(url, '.com:'))",
    "crawl_host_politeness": f"WITH {CRAWL}, h AS (SELECT url, split_part(split_part(url, '/', 3), ':', 1) AS host FROM crawl) SELECT url, host, url = min(url) OVER (PARTITION BY host) AS now FROM h",
    "crawl_loop": (
        f"WITH {PAGE_LINKS}, s AS (SELECT DISTINCT url FROM crawl WHERE page_id IN (SELECT page_id FROM pages ORDER BY page_id LIMIT 5)), "
        "f0 AS (SELECT min(url) AS url FROM s GROUP BY split_part(split_part(url, '/', 3), ':', 1)), "
        "ahead AS (SELECT url FROM s UNION SELECT norm.url FROM norm JOIN f0 ON f0.url = norm.base WHERE norm.url IS NOT NULL), "
        "f1 AS (SELECT min(url) AS url FROM ahead WHERE url NOT IN (SELECT url FROM f0) GROUP BY split_part(split_part(url, '/', 3), ':', 1)) "
        "SELECT url, url IN (SELECT url FROM crawl) AS found FROM (SELECT url FROM f0 UNION ALL SELECT url FROM f1)"
    ),
    "crawl_round": (
        f"WITH {PAGE_LINKS}, todo AS (SELECT DISTINCT url, split_part(split_part(url, '/', 3), ':', 1) AS host FROM crawl WHERE url NOT IN (SELECT url FROM crawl WHERE contains(url, '.com:'))), "
        "pick AS (SELECT url, url = min(url) OVER (PARTITION BY host) AS now FROM todo), "
        "ahead AS (SELECT url FROM pick WHERE NOT now UNION ALL SELECT norm.url FROM norm JOIN pick ON pick.url = norm.base AND pick.now WHERE norm.url IS NOT NULL) SELECT url, count(*) AS n FROM ahead GROUP BY url"
    ),
}
