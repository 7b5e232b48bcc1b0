"""SQL for those queries of the subpackage that SQL can express over whole tables."""

from __future__ import annotations

from quern.plans.sql import STOPS

ROWS = """raw AS (SELECT lower(regexp_replace(term, '^\\s+|\\s+$', '', 'g')) AS term, unnest(map_entries(postings)) AS e FROM term_index WHERE postings IS NOT NULL),
rows_ AS (SELECT term, e.key AS doc_id, max(coalesce(e.value, 0))::BIGINT AS tf FROM raw WHERE term <> '' GROUP BY ALL),
n AS (SELECT count(DISTINCT doc_id) AS n FROM rows_), df AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM rows_ GROUP BY term)"""
TERMS = f"WITH {ROWS}, marks AS (SELECT term, tf AS occurrences, df AS documents, n AS total_documents, CASE WHEN df <= 2 THEN 'rare' WHEN df > 0.2 * n THEN 'common' END AS mark FROM df, n)"
TOP = """WITH best AS (SELECT recipe_url, page_id, max(match_score) AS match_score FROM wiki_recipes WHERE page_id IS NOT NULL AND match_score IS NOT NULL AND NOT isnan(match_score) GROUP BY ALL),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY recipe_url ORDER BY match_score DESC, page_id))::INT AS rank FROM best)"""

# Words of texts whose characters have their compatibility form; that of others is no SQL function.
WORDS = "SELECT {0}, unnest(w) AS w, unnest(range(len(w))) AS p, len(w) AS n FROM (SELECT {0}, regexp_extract_all(lower(regexp_replace(nfc_normalize(replace(text, '…', '...')), '[\\x{{AD}}\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')), '[\\p{{L}}\\p{{N}}]+') AS w FROM {1} WHERE text IS NOT NULL)"
GRAM = "SELECT {0}, p, n, string_agg(w, ' ') OVER (PARTITION BY {0} ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS g, p + 10 <= n AS full_ FROM {1}"
LEAKS = f"""WITH dw AS ({WORDS.format("doc_id", "documents")}), iw AS ({WORDS.format("item_id", "eval_items")}), dg AS ({GRAM.format("doc_id", "dw")}), ig AS ({GRAM.format("item_id", "iw")}),
hits AS (SELECT doc_id, item_id, d.p AS dp, i.p AS ip, d.n FROM dg d JOIN ig i ON d.g = i.g WHERE d.full_ AND i.full_),
runs AS (SELECT doc_id, item_id, max(n) AS n, count(*) + 9 AS run FROM (SELECT *, dp - row_number() OVER (PARTITION BY doc_id, item_id, dp - ip ORDER BY dp) AS island FROM hits) GROUP BY doc_id, item_id, dp - ip, island),
covered AS (SELECT doc_id, item_id, count(DISTINCT dp + k) AS words FROM hits, range(10) r(k) GROUP BY ALL)
SELECT doc_id, item_id, max(run)::INT AS longest, any_value(words)::INT AS words, max(n)::INT AS doc_words FROM runs JOIN covered USING (doc_id, item_id) GROUP BY ALL"""

GRAPH = f"""WITH toks AS (SELECT row_number() OVER () AS id, url, w FROM (SELECT DISTINCT url, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(method), '[^a-zA-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda t: length(t) BETWEEN 3 AND 25 AND t NOT IN {STOPS} AND NOT regexp_full_match(t, '[0-9]+')) AS w FROM recipes WHERE url IS NOT NULL AND method IS NOT NULL)),
p AS (SELECT url, id, unnest(w) AS t, unnest(range(len(w))) AS i FROM toks),
degrees AS (SELECT a.url, a.t, count(DISTINCT b.t) AS degree FROM p a LEFT JOIN p b ON a.id = b.id AND b.i BETWEEN a.i - 3 AND a.i + 3 AND a.t <> b.t GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM degrees GROUP BY t HAVING count(*) >= 2), n AS (SELECT count(DISTINCT url) AS n FROM degrees),
ranked AS (SELECT url, t AS term, score, (row_number() OVER (PARTITION BY url ORDER BY score DESC, t))::INT AS rank FROM (SELECT url, t, round(degree * ln(n / df), 6) AS score FROM degrees JOIN df USING (t), n))
SELECT url, term, score, rank FROM ranked WHERE rank <= 3"""

BUDGETS = """WITH texts AS (SELECT source, text, count(*) AS copies, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS n FROM documents WHERE text IS NOT NULL GROUP BY source, text),
per AS (SELECT source, sum(n)::BIGINT AS size, count(*) AS n_texts FROM texts GROUP BY source), whole AS (SELECT sum(n * copies)::BIGINT AS total FROM texts),
goal AS (SELECT source, max(target_share) AS target_share, max(max_uses) AS max_uses FROM mix_targets GROUP BY source),
w AS (SELECT g.*, coalesce(size, 0) AS size, coalesce(n_texts, 0) AS n_texts, total, round(target_share * total)::BIGINT AS wanted FROM goal g LEFT JOIN per p ON p.source IS NOT DISTINCT FROM g.source, whole),
e AS (SELECT *, least(max_uses, CASE WHEN size > 0 THEN wanted // size ELSE 0 END)::BIGINT AS epochs FROM w)
SELECT *, (CASE WHEN epochs < max_uses THEN least(size, wanted - epochs * size) ELSE 0 END)::BIGINT AS rest, size * max_uses >= wanted AS reached FROM e"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"WITH {ROWS} SELECT doc_id, term FROM (SELECT doc_id, term, round(tf * ln(n / df), 6) AS s FROM (SELECT r.doc_id, r.term, r.tf, df.df, n.n FROM rows_ r JOIN df USING (term), n WHERE df >= 2)) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, term) <= 3",
        "p3_graph": GRAPH,
        "p5_terms": f"{TERMS} SELECT * FROM marks",
        "p5_found": f"{TERMS} SELECT term, mark FROM marks WHERE mark IS NOT NULL",
        "p8_leaks": LEAKS,
        "p8_found": f"SELECT doc_id, item_id FROM ({LEAKS})",
        "p9_budgets": BUDGETS,
        "p7_found": f"{TOP} SELECT recipe_url, page_id FROM ranked WHERE rank <= 3",
        "p7_ranked": f"{TOP} SELECT recipe_url, page_id, match_score, rank FROM ranked WHERE rank <= 3",
    }
