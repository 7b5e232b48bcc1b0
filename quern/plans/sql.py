"""SQL that the core's queries are held against."""

from __future__ import annotations

from quern.config import SKIPPED_SUFFIXES, STOP_WORDS

STOPS = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
SUFFIXES = "(" + "|".join(s.replace(".", r"\.") for s in SKIPPED_SUFFIXES) + ")$"

RECIPES = "recipes_ AS (SELECT * FROM recipes WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawled_at DESC NULLS LAST, loaded_at DESC NULLS LAST) = 1)"
FULL = "concat_ws(' ', title, description, coalesce(array_to_string(ingredients, ' '), ''), method)"
TOKENS = f"""{RECIPES}, tokens AS (
  SELECT doc_id, term FROM (SELECT url AS doc_id, unnest(string_split(trim(regexp_replace(regexp_replace(lower({FULL}), '[^a-zA-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) AS term FROM recipes_)
  WHERE length(term) BETWEEN 3 AND 25 AND term NOT IN {STOPS} AND NOT regexp_full_match(term, '[0-9]+')),
tf AS (SELECT term, doc_id, count(*) AS tf FROM tokens GROUP BY ALL)"""
CLEAN = "trim(regexp_replace(lower(regexp_replace({0}, '[^\\w\\s]', '', 'g')), '\\s+', ' ', 'g'))"
TITLES = f"""{RECIPES}, l AS (SELECT url, {CLEAN.format("title")} AS c FROM recipes_ WHERE title IS NOT NULL),
r AS (SELECT page_id, {CLEAN.format("min(wiki_title)")} AS c FROM dump_index GROUP BY page_id),
lt AS (SELECT DISTINCT url, c, t FROM (SELECT url, c, unnest(string_split(c, ' ')) AS t FROM l) WHERE t <> '' AND t NOT IN {STOPS}),
rt AS (SELECT DISTINCT page_id, c, t FROM (SELECT page_id, c, unnest(string_split(c, ' ')) AS t FROM r) WHERE t <> '' AND t NOT IN {STOPS})"""
SCORED = f"""{TITLES}, pairs AS (SELECT DISTINCT url, page_id, lt.c AS a, rt.c AS b FROM lt JOIN rt USING (t)),
scored AS (SELECT url, page_id, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS s FROM pairs),
kept AS (SELECT * FROM scored WHERE s >= 0.45),
best AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY url ORDER BY s DESC, page_id) = 1)"""
HREF = """(?i)<a[^>]+href\\s*=\\s*["'']([^"'']+)["''][^>]*>"""
LINKS = f"links AS (SELECT DISTINCT url, link FROM (SELECT url, unnest(regexp_extract_all(html, '{HREF}', 1)) AS link FROM raw_pages))"
EDGES = f"""{LINKS}, edges AS (SELECT DISTINCT url AS src_url, dst AS dst_url FROM (
  SELECT url, CASE WHEN link LIKE '#%' THEN url WHEN link LIKE '/%' THEN regexp_extract(url, '^https?://[^/]+') || link ELSE link END AS dst FROM links)
  WHERE regexp_extract(dst, '^https?://([^/]+)', 1) = regexp_extract(url, '^https?://([^/]+)', 1) AND NOT regexp_matches(lower(dst), '{SUFFIXES}') AND NOT contains(dst, '/search?'))"""
WEB = "pages AS (SELECT url, max(html) AS html FROM raw_pages GROUP BY url), seeds AS (SELECT min(url) AS url FROM pages GROUP BY regexp_extract(url, '^https?://([^/:]+)', 1))"
BFS = f"""{WEB}, {EDGES}, levels(url, depth) USING KEY (url) AS (
  SELECT url, 0 AS depth FROM seeds UNION SELECT DISTINCT e.dst_url, l.depth + 1 FROM levels l JOIN edges e ON e.src_url = l.url WHERE NOT EXISTS (SELECT 1 FROM recurring.levels r WHERE r.url = e.dst_url)),
state AS (SELECT l.url, min(depth) AS depth, true AS visited, bool_or(p.url IS NOT NULL) AND regexp_full_match(l.url, 'https?://[^/]+/+recipes/+[^/?#]+/*([?#].*)?') AS downloaded FROM levels l LEFT JOIN pages p ON p.url = l.url GROUP BY l.url)"""
WIKI_CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?s)<ref[^>]*>.*?</ref>', '', 'g'), '\\{{\\{{[^}}]*\\}}\\}}', '', 'g'), '\\[\\[(?:[^|\\]]*\\|)?([^\\]]+)\\]\\]', '\\1', 'g'), '''''''?([^'']+)''''''?', '\\1', 'g'), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')"
FIELD_ROWS = f"""{RECIPES}, texts AS (
  SELECT url AS doc_id, 'title' AS field, title AS t FROM recipes_ UNION ALL SELECT url, 'ingredients', array_to_string(ingredients, ' ') FROM recipes_
  UNION ALL SELECT url, 'description', description FROM recipes_ UNION ALL SELECT url, 'method', method FROM recipes_ UNION ALL SELECT url, 'chef', chef FROM recipes_),
words AS (SELECT doc_id, field, w FROM (SELECT doc_id, field, unnest(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM texts WHERE t IS NOT NULL) WHERE w <> ''),
lengths AS (SELECT doc_id, field, count(*) AS length FROM words GROUP BY ALL),
rows_ AS (SELECT field, w AS term, doc_id, count(*) AS tf, any_value(length) AS length FROM words JOIN lengths USING (doc_id, field) GROUP BY field, w, doc_id)"""


FIELD_QUERY = f"""WITH {FIELD_ROWS}, places AS (SELECT doc_id, field, term, p FROM (SELECT doc_id, field, unnest(w) AS term, unnest(range(len(w))) AS p FROM (SELECT doc_id, field, list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM texts WHERE t IS NOT NULL))),
st AS (SELECT field, count(*) AS n, avg(length) AS a FROM lengths GROUP BY field), boosts(field, boost) AS (VALUES ('title', 3.0::DOUBLE), ('ingredients', 2.5), ('description', 1.5), ('method', 1.0), ('chef', 0.5)),
idf AS (SELECT field, term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM rows_ JOIN st USING (field) GROUP BY field, term, n),
phrases AS (SELECT x.doc_id, x.field, count(*) AS tf FROM places x JOIN places y ON x.doc_id = y.doc_id AND x.field = y.field AND y.p = x.p + 1 WHERE x.term = 'lemon' AND y.term = 'juice' GROUP BY ALL),
parts AS (SELECT doc_id, field, CASE WHEN term = 'pork' THEN 5 WHEN starts_with(term, 'cinn') THEN 3 WHEN term = 'soup' THEN 1 ELSE 4 END AS clause, tf, idf, length, 1.0::DOUBLE AS b FROM rows_ JOIN idf USING (field, term)
  WHERE (term = 'soup' AND field = 'title') OR starts_with(term, 'cinn') OR levenshtein(term, 'lentl') <= 1 OR term = 'pork'
  UNION ALL SELECT doc_id, field, 2, tf, (SELECT sum(i.idf) FROM idf i WHERE i.field = p.field AND i.term IN ('lemon', 'juice')), length, 2.0 FROM phrases p JOIN lengths USING (doc_id, field)),
hits AS (SELECT doc_id, sum(CASE WHEN clause = 5 THEN 0 ELSE b * boost * idf * tf / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / a)) END) AS s FROM parts JOIN st USING (field) JOIN boosts USING (field) GROUP BY doc_id
  HAVING count(*) FILTER (WHERE clause = 1) > 0 AND count(*) FILTER (WHERE clause = 5) = 0)
SELECT rank, round(s, 6) AS score, total_hits, doc_id, title, CASE WHEN length(d) > 150 THEN substring(d, 1, 150) || '...' ELSE d END AS description, chef
FROM (SELECT (row_number() OVER (ORDER BY s DESC, doc_id))::INT AS rank, s, count(*) OVER () AS total_hits, h.doc_id, title, coalesce(description, '') AS d, chef FROM hits h JOIN recipes_ ON url = h.doc_id) WHERE rank <= 10"""
START = "'(?s)^[{|\\n]*([^{|\\n][^\\n]*?)(?:==|[\\n\\r\\x{85}\\x{2028}\\x{2029}]|$)'"


def _search(idf: str) -> str:
    terms = "(VALUES ('chicken', 1), ('lemon', 1), ('soup', 2)) q(term, times)"
    return f"""WITH {TOKENS}, n AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM tf), df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
scores AS (SELECT doc_id, sum(tf * {idf} * times) AS s FROM tf JOIN df USING (term) JOIN {terms} USING (term), n GROUP BY doc_id),
top AS (SELECT row_number() OVER (ORDER BY s DESC, doc_id)::INT AS rank, doc_id, s FROM scores WHERE s > 0 QUALIFY rank <= 5)
SELECT rank, doc_id, title, round(s, 6) AS score FROM top JOIN recipes_ ON url = doc_id"""


def _complete() -> str:
    names = ("title", "description", "ingredients", "method", "chef", "difficulty", "prep_time", "servings", "html_file")
    rows = []
    for f in names:
        full = f"{f} IS NOT NULL AND len({f}) > 0" if f == "ingredients" else f"{f} IS NOT NULL"
        some = full if f == "ingredients" else f"{f} IS NOT NULL AND trim({f}) <> ''"
        rows.append(f"SELECT '{f}' AS field, count(*) FILTER (WHERE {full}) AS non_null, count(*) FILTER (WHERE {some}) AS non_empty, count(*) AS total, round(count(*) FILTER (WHERE {full}) * 100.0::DOUBLE / count(*), 1) AS pct FROM recipes")
    return " UNION ALL ".join(rows)


def oracle_sql() -> dict[str, str]:
    wiki = "'https://en.wikipedia.org/wiki/'"
    return {
        "dedupe_url": f"WITH {RECIPES} SELECT url, title, crawled_at, loaded_at, method, prep_time FROM recipes_",
        "token_totals": f"WITH {TOKENS} SELECT doc_id, count(*) AS tokens, count(DISTINCT term) AS terms FROM tokens GROUP BY doc_id",
        "tf_counts": f"WITH {TOKENS} SELECT term, doc_id, tf FROM tf",
        "df_vocab": f"WITH {TOKENS} SELECT term, count(*) AS document_frequency FROM tf GROUP BY term",
        "postings_rows": f"WITH {TOKENS} SELECT term, (count(*) OVER (PARTITION BY term))::INT AS document_frequency, doc_id, tf::INT AS tf FROM tf",
        "corpus_stats": f"WITH {TOKENS}, b AS (SELECT sum(n)::BIGINT AS n FROM (SELECT max(strlen(html)) AS n FROM raw_pages GROUP BY url)) SELECT (SELECT count(*) FROM recipes_) AS total_documents, (SELECT count(DISTINCT term) FROM tf) AS vocabulary_size, b.n AS size_bytes, round(b.n / 1048576, 2) AS size_mb FROM b",
        "search_classic": _search("ln(n / df)"),
        "search_robertson": _search("ln((n - df + 0.5) / (df + 0.5))"),
        "search_batch": f"""WITH {TOKENS}, n AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM tf), df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT doc_id AS query_id, unnest(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ')) AS term FROM documents WHERE doc_id % 20 = 0) WHERE length(term) BETWEEN 3 AND 25 AND term NOT IN {STOPS} GROUP BY ALL),
scores AS (SELECT query_id, doc_id, sum(tf * ln(n / df) * times) AS s FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL)
SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id))::INT AS rank, round(s, 6) AS score FROM scores WHERE s > 0 QUALIFY rank <= 5""",
        "query_tokens": f"SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY p) - 1)::INT AS pos, token FROM (SELECT item_id, unnest(w) AS token, unnest(range(len(w))) AS p FROM (SELECT item_id, string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ') AS w FROM eval_items)) WHERE length(token) BETWEEN 3 AND 25 AND token NOT IN {STOPS}",
        "title_clean": f"""SELECT page_id, c AS cleaned_title, coalesce(string_agg(t, ' ' ORDER BY p), '') AS tokens FROM (
  SELECT page_id, wiki_title, c, t, min(p) AS p FROM (SELECT page_id, wiki_title, c, unnest(string_split(c, ' ')) AS t, unnest(range(len(string_split(c, ' ')))) AS p FROM (SELECT DISTINCT page_id, wiki_title, {CLEAN.format("wiki_title")} AS c FROM dump_index)) WHERE t <> '' AND t NOT IN {STOPS} GROUP BY ALL) GROUP BY page_id, wiki_title, c""",
        "link_candidates_count": f"WITH {TITLES} SELECT url, count(*) AS candidates FROM lt JOIN rt USING (t) GROUP BY url",
        "link_scored": f"WITH {SCORED} SELECT url, page_id, round(s, 6) AS similarity FROM kept",
        "link_best": f"WITH {SCORED} SELECT url, page_id, round(s, 6) AS similarity FROM best",
        "link_all_left": f"WITH {SCORED}, p AS (SELECT page_id, min(wiki_title) AS wiki_title, min(wiki_offset) AS wiki_offset FROM dump_index GROUP BY page_id) SELECT q.url AS recipe_url, q.title AS recipe_title, q.method, best.page_id, wiki_title, {wiki} || replace(wiki_title, ' ', '_') AS wiki_url, wiki_offset, round(s, 6) AS similarity, NULL::VARCHAR AS wiki_description FROM recipes_ q LEFT JOIN best ON best.url = q.url LEFT JOIN p ON p.page_id = best.page_id WHERE q.title IS NOT NULL",
        "match_rate": "SELECT count(*) AS total, count(page_id) AS matched, count(wiki_description) AS described, count(DISTINCT page_id) AS pages, round(count(wiki_description) * 100.0::DOUBLE / count(*), 6) AS described_pct FROM wiki_recipes",
        "top_articles": "SELECT wiki_title, count(*) AS n FROM wiki_recipes WHERE wiki_title IS NOT NULL GROUP BY wiki_title ORDER BY n DESC, wiki_title LIMIT 20",
        "dump_index_parse": "SELECT wiki_offset, page_id, wiki_title, count(*) AS n FROM dump_index WHERE wiki_offset IS NOT NULL AND page_id IS NOT NULL AND wiki_title IS NOT NULL GROUP BY ALL",
        "page_titles": "SELECT url, trim(regexp_replace(regexp_extract(h, '(?is)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title, trim(regexp_replace(replace(regexp_extract(h, '<h1>([^<]*)</h1>', 1), '&amp;', '&'), '\\s+', ' ', 'g')) AS heading FROM (SELECT url, max(html) AS h FROM raw_pages GROUP BY url)",
        "page_links": f"WITH {LINKS} SELECT link, count(*) AS pages FROM links GROUP BY link",
        "page_links_internal": f"WITH {EDGES} SELECT src_url, dst_url FROM edges",
        "bfs_levels": f"WITH RECURSIVE {BFS} SELECT url, depth, visited, downloaded FROM state",
        "bfs_counts": f"WITH RECURSIVE {BFS} SELECT depth, count(*) AS urls, count(*) FILTER (WHERE regexp_full_match(url, 'https?://[^/]+/+recipes/+[^/?#]+/*([?#].*)?')) AS recipes FROM state GROUP BY depth",
        "recipe_like_urls": f"WITH {EDGES}, u AS (SELECT dst_url AS url FROM edges UNION SELECT url FROM recipes) SELECT url, coalesce(regexp_full_match(url, 'https?://[^/]+/+recipes/+[^/?#]+/*([?#].*)?'), false) AS recipe, contains(url, '/recipes/') AND len(string_split(url, '/')) >= 5 AND string_split(url, '/')[4] = 'recipes' AS sitemap_recipe, regexp_matches(lower(url), '{SUFFIXES}') AS skipped, coalesce(contains(regexp_replace(url, '^https?://[^/]+', ''), '/search?'), false) AS search FROM u",
        "url_diff_missing": "SELECT url FROM recipes EXCEPT SELECT url FROM raw_pages",
        "url_diff_status": "SELECT CASE WHEN b.url IS NULL THEN 'missing' WHEN a.url IS NULL THEN 'extra' ELSE 'both' END AS status, count(*) AS n FROM (SELECT DISTINCT url FROM recipes) a FULL JOIN (SELECT DISTINCT url FROM raw_pages) b ON a.url = b.url GROUP BY 1",
        "filename_roundtrip": "SELECT url, file, 'https://' || replace(replace(file, '.html', ''), '_', '/') AS back, regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '[^\\w\\-.]', '_', 'g') || '_' || regexp_replace(trim(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/'), '[^\\w\\-.]', '_', 'g') || '.html' AS saved, replace(html_file, '\\', '/') AS path FROM (SELECT DISTINCT url, html_file, replace(replace(replace(url, 'https://', ''), 'http://', ''), '/', '_') || '.html' AS file FROM recipes)",
        "field_completeness": _complete(),
        "top_chefs": f"WITH {RECIPES} SELECT * FROM (SELECT chef, count(*) AS n FROM recipes_ GROUP BY chef ORDER BY n DESC, chef NULLS LAST LIMIT 5) WHERE coalesce(chef, '') <> ''",
        "difficulty_distribution": "SELECT difficulty, count(*) AS n FROM (SELECT trim(regexp_replace(difficulty, '\\s+', ' ', 'g')) AS difficulty FROM recipes) WHERE difficulty <> '' AND NOT regexp_full_match(difficulty, '\\d+') AND length(difficulty) < 50 GROUP BY difficulty",
        "prep_time_parse": "SELECT DISTINCT url, trim(regexp_replace(coalesce(regexp_replace(regexp_replace(prep_time, '(?i)\\bMINS?\\b', 'min', 'g'), '(?i)\\bHRS?\\b', 'hr', 'g'), ''), '\\s+', ' ', 'g')) AS prep_time FROM recipes",
        "wikitext_clean": f"SELECT page_id, trim({WIKI_CLEAN.format('max(wiki_description)')}) AS clean FROM wiki_recipes WHERE wiki_description <> '' GROUP BY page_id",
        "wiki_sections": f"SELECT page_id, nullif(trim({WIKI_CLEAN.format('s')}), '') AS section FROM (SELECT page_id, regexp_extract('<text>intro' || chr(10) || '== About ==' || chr(10) || max(wiki_description) || chr(10) || '</text>', '(?s)={{2,}}\\s*([^=\\n]+?)\\s*={{2,}}\\s*(.*?)(?:={{2,}}|</text>)', 2) AS s FROM wiki_recipes WHERE wiki_description <> '' GROUP BY page_id)",
        "wiki_abstracts": f"SELECT page_id, CASE WHEN NOT starts_with(t, '{{{{Infobox') AND NOT starts_with(t, '{{{{Short description') AND regexp_matches(t, {START}) AND length(c) >= 50 THEN c END AS abstract FROM (SELECT page_id, t, trim({WIKI_CLEAN.format('s')}) AS c FROM (SELECT page_id, t, regexp_extract(t, {START}, 1) AS s FROM (SELECT page_id, max(wiki_description) || '</text>' AS t FROM wiki_recipes WHERE wiki_description <> '' GROUP BY page_id)))",
        "field_query": FIELD_QUERY,
        "wiki_url": f"SELECT DISTINCT page_id, {wiki} || replace(wiki_title, ' ', '_') AS wiki_url FROM dump_index",
        "field_terms": f"WITH {FIELD_ROWS} SELECT field, term, doc_id, tf, length::INT AS length FROM rows_",
        "field_bm25": f"""WITH {FIELD_ROWS}, st AS (SELECT field, count(*) AS n, avg(length) AS a FROM lengths GROUP BY field), asked AS (SELECT * FROM rows_ WHERE term IN ('lemon', 'soup')), df AS (SELECT field, term, count(*) AS df FROM asked GROUP BY ALL),
boosts(field, boost) AS (VALUES ('title', 3.0::DOUBLE), ('ingredients', 2.5), ('description', 1.5), ('method', 1.0), ('chef', 0.5))
SELECT doc_id, round(sum(boost * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / a))), 6) AS score FROM asked JOIN df USING (field, term) JOIN st USING (field) JOIN boosts USING (field) GROUP BY doc_id""",
        "result_text": f"WITH hits AS ({_search('ln(n / df)')}), {RECIPES} SELECT rank, rank || '. ' || h.title || chr(10) || '   Score: ' || printf('%.4f', score) || chr(10) || '   URL: ' || doc_id || CASE WHEN d <> '' THEN chr(10) || '   ' || d ELSE '' END AS text FROM (SELECT hits.*, concat_ws(' | ', CASE WHEN chef <> '' THEN 'Chef: ' || chef END, CASE WHEN prep_time <> '' THEN 'Prep Time: ' || prep_time END) AS d FROM hits JOIN recipes_ ON url = doc_id) h",
        "excerpts": "SELECT doc_id, CASE WHEN length(text) > 150 THEN substring(text, 1, 150) || '...' ELSE text END AS excerpt FROM documents",
        "doc_mapping_rows": "SELECT doc_id, url, coalesce(title, '') AS title, coalesce(chef, '') AS chef, coalesce(difficulty, '') AS difficulty, coalesce(prep_time, '') AS prep_time, coalesce(servings, '') AS servings, coalesce(len(ingredients), 0)::INT AS n_ingredients FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY url DESC) AS k FROM (SELECT DISTINCT * FROM doc_mapping)) WHERE k = 1",
    }
