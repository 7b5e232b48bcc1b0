"""Operators on small frames."""

from __future__ import annotations

import bz2
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quern import session
from quern.functions.text import tokenize_index
from quern.operators import crawl, extract, fields, index, joins, link, search, stats
from quern.plans import pipeline
from quern.sinks import files
from quern.sources import dump, pages
from quern.streaming import incremental


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    data = [(f"d{k}", t) for k, t in enumerate(["soup soup lemon", "lemon cake", "soup of duck", "duck duck duck", "plain bread"])]
    return spark.createDataFrame(data, "id string, text string")


def test_postings_properties(spark, docs):
    p = index.term_counts(docs, "id", F.col("text"))
    assert p.agg(F.sum("tf")).first()[0] == docs.select(F.sum(F.size(tokenize_index("text")))).first()[0]
    m = {r["term"]: r for r in index.postings_maps(p).collect()}
    assert m["soup"]["postings"] == {"d0": 2, "d2": 1} and m["soup"]["document_frequency"] == 2


def test_search_modes(spark, docs):
    p = index.term_counts(docs, "id", F.col("text"))
    q = spark.createDataFrame([(1, "soup soup lemon"), (2, "the nothing"), (3, "")], "query_id int, query string")
    hits = search.score_queries(p, 5, q, k=2, method="classic").orderBy("rank").collect()
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in hits] == [(1, "d0", 1), (1, "d2", 2)]
    assert search.score_queries(p.limit(0), 0, q).count() == 0


def test_robertson_drops_common_terms(spark):
    n = F.lit(10.0)
    assert spark.range(1).select(search.robertson_idf(n, F.lit(9.0))).first()[0] == pytest.approx(-1.845827, abs=1e-6)
    p = spark.createDataFrame([("t", f"d{k}", 1) for k in range(9)], "term string, doc_id string, tf int").withColumn("term", F.lit("lamb"))
    q = spark.createDataFrame([(1, "lamb")], "query_id int, query string")
    assert search.score_queries(p, 10, q).count() == 0


def test_latest_is_one_row_per_key(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 2, "x"), (None, 3, "y")], "url string, at int, v string")
    assert rows(index.latest(df, "url", ["at"])) == [("a", 2, "x")]


def test_stats(spark):
    df = spark.createDataFrame([("", ["x"], "c"), (None, [], "c"), ("t", None, None)], "title string, ingredients array<string>, chef string")
    got = {r["field"]: (r["non_null"], r["non_empty"], r["total"]) for r in stats.completeness(df, ["title", "ingredients", "chef"]).collect()}
    assert got == {"title": (2, 1, 3), "ingredients": (1, 1, 3), "chef": (2, 2, 3)}
    assert stats.completeness(df.limit(0), ["title"]).first()["pct"] is None
    assert rows(stats.top_values(df, "chef")) == [("c", 2)]


PAGES = "wiki_offset long, page_id long, wiki_title string"


def test_link(spark):
    recipes = spark.createDataFrame([("u1", "Duck soup", "m1", 1), ("u2", "The recipe", "m2", 2), ("u1", "Duck soup", "m1", 0), ("u3", None, "m", 1)], "url string, title string, method string, crawled_at int")
    wiki = spark.createDataFrame([(7, 2, "Duck Soups"), (7, 1, "Duck soupy"), (9, 3, "Lemon")], PAGES)
    got = {r["recipe_url"]: r for r in link.link(recipes, wiki).collect()}
    assert set(got) == {"u1", "u2"} and got["u1"]["page_id"] == 1 and got["u1"]["method"] == "m1"
    assert got["u1"]["wiki_url"].endswith("/Duck_soupy") and got["u2"]["page_id"] is None
    assert link.link(recipes, wiki, keep_all=False).count() == 1
    assert link.link(recipes.limit(0), wiki).count() == 0
    assert link.match_rate(link.link(recipes.limit(0), wiki)).first()["described_pct"] is None


def test_similarity_threshold_in_doubles(spark):
    pair = spark.createDataFrame([(1, 2, "a" * 20, "b" * 11 + "a" * 9)], "left_id int, right_id int, left_title string, right_title string")
    pair = pair.withColumn("token", F.lit("t")).withColumn("left_tokens", F.array(F.lit("t"), F.lit("u"))).withColumn("right_tokens", F.array(F.lit("u"), F.lit("t")))
    assert link.scored_pairs(pair).count() == 0  # 1 - 11/20 is a little under 0.45
    assert link.scored_pairs(pair.withColumn("right_title", F.lit("b" * 10 + "a" * 10))).count() == 1


def test_prefiltered_pairs_equal_all_pairs(spark):
    words = ["duck", "duck soup", "soup of ducks", "a soup", "ducks", "lemon duck soup pie with cream"]
    left = link.prepare_titles(spark.createDataFrame([(k, w) for k, w in enumerate(words)], "i int, t string"), "t")
    pairs = link.candidate_pairs(left, left, "i", "i")
    plain = pairs.select("left_id", "right_id", link.similarity(F.levenshtein("left_title", "right_title"), F.col("left_title"), F.col("right_title")).alias("similarity")).where("similarity >= 0.45").distinct()
    assert rows(plain) == rows(link.scored_pairs(pairs))


def test_multistream(spark, tmp_path):
    page = lambda i, t: f"<page><title>{t}</title><id>{i}</id><text>x\n== A ==\nAbout [[{t}]].\n== B ==\n</text></page>"
    a, b = bz2.compress((page(1, "A") + page(2, "B")).encode()), bz2.compress(page(3, "C").encode())
    path = tmp_path / "dump.bz2"
    path.write_bytes(a + b)
    offsets = spark.createDataFrame([(0,), (0,), (len(a),), (None,)], "wiki_offset long")
    got = rows(dump.block_pages(dump.read_offsets(offsets, str(path))).select("wiki_offset", "page_id", "wiki_title"))
    assert got == [(0, 1, "A"), (0, 2, "B"), (len(a), 3, "C")]
    spark.dataSource.register(dump.Multistream)
    df = spark.read.format("multistream").options(path=str(path), offsets=f"0,{len(a)}", blocksPerPartition="1").load()
    assert rows(dump.block_pages(df).select("wiki_offset", "page_id")) == [(0, 1), (0, 2), (len(a), 3)]
    links = spark.createDataFrame([("r", 0, 2, "B"), ("s", None, None, None)], "recipe_url string, wiki_offset long, page_id long, wiki_title string").withColumn("wiki_description", F.lit(None).cast("string"))
    assert {r["recipe_url"]: r["wiki_description"] for r in link.enrich(links, str(path)).collect()} == {"r": "About B.", "s": None}
    assert {r["recipe_url"]: r["wiki_description"] for r in link.enrich(links, str(path), block_first_page=True).collect()} == {"r": "About A.", "s": None}
    assert link.enrich(links, None) is links


def test_dump_index(spark, tmp_path):
    lines = spark.createDataFrame([("10:1:A:b",), ("bad",), ("",), ("x:1:t",)], "value string")
    assert rows(dump.parse_index(lines)) == [(10, 1, "A:b")]
    (tmp_path / "i.bz2").write_bytes(bz2.compress(b"1:2:X\n") + bz2.compress(b"3:4:Y\n"))
    assert rows(dump.read_dump_index(spark, str(tmp_path / "i.bz2"))) == [(1, 2, "X"), (3, 4, "Y")]
    with pytest.raises(pages.MissingInput):
        dump.read_dump_index(spark, str(tmp_path / "none"))


def test_jsonl_and_sinks(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"url": "u", "title": "é"}\n\n{broken\n', encoding="utf-8")
    df = pages.read_jsonl(spark, str(path))
    assert [r["title"] for r in df.collect()] == ["é"]
    assert [r["line"] for r in pages.broken_lines(spark, str(path)).collect()] == ["{broken"]
    out = str(tmp_path / "one.jsonl")
    files.write_single_jsonl(files.recipe_record(df.unionByName(df)).repartition(2), out)
    records = [json.loads(x) for x in open(out, encoding="utf-8")]
    assert len(records) == 2 and records[0]["title"] == "é" and records[0]["ingredients"] == [] and list(records[0])[:3] == ["url", "html_file", "title"]
    table = str(tmp_path / "pages")
    some = spark.createDataFrame([("https://h.example/recipes/a", "1"), ("https://h.example/recipes/a", "1")], "url string, html string")
    assert files.save_pages(some, table).count() == 1 and files.save_pages(some, table).count() == 0
    assert spark.read.parquet(table).count() == 1


def test_robots_sitemap_and_reconcile(spark, tmp_path):
    lines = spark.createDataFrame([(2, "SITEMAP: https://h.example/b.xml"), (1, "Sitemap: https://h.example/a.xml"), (0, "Disallow: /")], "line_no int, value string")
    assert rows(pages.robots_sitemap(lines)) == [("https://h.example/a.xml",)]
    site = tmp_path / "s.xml"
    site.write_text("<urlset><url><loc> https://h.example/recipes/a </loc></url><url><loc>https://h.example/chefs/b</loc></url><url><loc>https://h.example/recipes/c</loc></url></urlset>")
    urls = pages.sitemap_recipes(spark, str(site))
    assert rows(urls) == [("https://h.example/recipes/a",), ("https://h.example/recipes/c",)]
    top = tmp_path / "index.xml"
    top.write_text(f"<sitemapindex><sitemap><loc>{site}</loc></sitemap><sitemap><loc>{tmp_path}/gone.xml</loc></sitemap></sitemapindex>")
    assert rows(pages.sitemap_recipes(spark, str(top))) == rows(urls)
    saved = spark.createDataFrame([("https://h.example/recipes/a", "x"), ("https://h.example/recipes/z", "x")], "url string, html string")
    assert dict(rows(crawl.reconcile(urls, saved))) == {"https://h.example/recipes/a": "both", "https://h.example/recipes/c": "missing", "https://h.example/recipes/z": "extra"}
    table = str(tmp_path / "t")
    files.save_pages(saved, table)
    fetched = spark.createDataFrame([("https://h.example/recipes/c", "y")], "url string, html string")
    assert {r["status"] for r in crawl.apply_reconcile(spark, table, urls, fetched, drop_extra=True).collect()} == {"both"}


def web(spark):
    page = lambda *links: "".join(f"<a href='{x}'>.</a>" for x in links)
    h = "https://h.example"
    data = [(f"{h}/", page("/recipes/a", "/b#x", "http://other.example/", "/c.pdf")), (f"{h}/recipes/a", page("/", "/b")), (f"{h}/b", page("/recipes/d", "/search?q=1")), (f"{h}/recipes/d", "no links")]
    return spark.createDataFrame(data, "url string, html string"), spark.createDataFrame([(f"{h}/",)], "url string")


def test_crawl_visits_each_url_once(spark, tmp_path):
    pages_, seeds = web(spark)
    got = {r["url"].removeprefix("https://h.example"): (r["depth"], r["downloaded"]) for r in crawl.crawl(pages_, seeds).collect()}
    assert got == {"/": (0, False), "/recipes/a": (1, True), "/b": (1, False), "/recipes/d": (2, True)}
    part = crawl.crawl(pages_, seeds, max_depth=1)
    crawl.save_state(part, str(tmp_path / "state"))
    state = crawl.load_state(spark, str(tmp_path / "state"))
    assert sum(not r["visited"] for r in state.collect()) == 2
    again = {r["url"].removeprefix("https://h.example"): r["depth"] for r in crawl.crawl(pages_, seeds.limit(0), state=state).collect()}
    assert again == {k: v[0] for k, v in got.items()}
    assert crawl.load_state(spark, str(tmp_path / "none")) is None
    assert crawl.crawl(pages_, seeds.limit(0)).count() == 0


def test_fetch_retries(spark):
    def get(u):
        if u == "bad":
            raise OSError("down")
        return "page " + u

    got = {r["url"]: (r["html"], r["error"]) for r in pages.fetch(spark.createDataFrame([("a",), ("bad",)], "url string"), get, retries=2).collect()}
    assert got == {"a": ("page a", None), "bad": (None, "OSError: down")}


def test_grid_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "CELL", 3)
    a = spark.createDataFrame([("hot", k, None) for k in range(20)] + [("one", 1, "x"), ("left", 2, "x"), (None, 3, "x"), ("hot", 0, None)], "k string, a int, s string")
    b = spark.createDataFrame([("hot", k) for k in range(11)] + [("one", 1), ("one", 1), ("right", 2), (None, 3)], "k string, b int")
    assert rows(joins.grid_join(a, b, "k")) == rows(a.join(b, "k").select("k", "a", "s", "b")) and joins.grid_join(a.limit(0), b, "k").count() == 0


def test_many_queries_meet_postings_by_term(spark, docs, monkeypatch):
    p = index.term_counts(docs, "id", F.col("text"))
    queries = spark.createDataFrame([(1, "soup lemon lemon"), (2, "duck cake"), (3, "nothing"), (4, "")], "query_id int, query string")
    few = rows(search.score_queries(p, 5, queries, method="classic"))
    monkeypatch.setattr(search, "BROADCAST", 0)
    assert rows(search.score_queries(p, 5, queries, method="classic")) == few and len(few) > 3


def test_query_language():
    c = fields.parse_query('a AND b NOT c title:"x y"^2 d* e~1 [f TO g] -h')
    assert [(x.words, x.occur, x.kind) for x in c] == [(("a",), "must", "term"), (("b",), "must", "term"), (("c",), "not", "term"), (("x", "y"), "should", "phrase"), (("d*",), "should", "wildcard"), (("e",), "should", "fuzzy"), (("f",), "should", "range"), (("h",), "not", "term")]
    assert c[3].field == "title" and c[3].boost == 2.0
    with pytest.raises(fields.BadQuery):
        fields.parse_query("AND x")
    assert fields.parse_query("") == [] and fields.parse_query("()") == []
    g = fields.parse_query("+title:(a OR b)^2 c")[0]
    assert g.kind == "group" and g.occur == "must" and g.boost == 2.0 and [(p.words, p.field) for p in g.parts] == [(("a",), "title"), (("b",), "title")]
    for bad in ("(a", "a)"):
        with pytest.raises(fields.BadQuery):
            fields.parse_query(bad)


def test_query_language_in_full():
    one = lambda q: fields.parse_query(q)[0]
    assert one('"a b"~3').slop == 3 and one('title:"a b"~3^2').boost == 2.0 and one(r"a\:b").words == ("a", "b") and one(r"a\*").kind == "term"
    assert one("{a TO b}").closed == (False, False) and one("[a TO b}").closed == (True, False) and one("[* TO b]").words == () and one("[a TO *]").high is None
    assert one("/sou.*/").pattern == "sou.*" and one("*:*^2").kind == "all" and one(r"t:a\*b*").pattern == r"a\*b.*" and one("a~").edits == 2
    for bad in ("{a TO b", "a~3", "a~0.8", "a]", "/(/", "a:b:c", '"a a"~2', "(a)~2", "a*~1", "~a"):
        with pytest.raises(fields.BadQuery):
            fields.parse_query(bad)


def test_slop_ranges_and_patterns_against_hand_made_rows(spark):
    docs = spark.createDataFrame([("1", "red big fat hen"), ("2", "hen red"), ("3", "red hen"), ("4", None), ("5", "red red a b c hen")], "doc_id string, t string")
    p = fields.field_postings(docs, "doc_id", ["t"])
    run = lambda q: {r["doc_id"]: r["score"] for r in fields.field_search(p, docs, q, boosts={"t": 1.0}).collect()}
    assert set(run('"red hen"')) == {"3"} and set(run('"red hen"~1')) == {"3"} and set(run('"red hen"~2')) == {"1", "2", "3"} and set(run('"red hen"~3')) == {"1", "2", "3", "5"}
    assert run('"red hen"~2')["3"] > run('"red hen"~2')["2"] > 0
    assert set(run("{big TO fat}")) == {"5"} and set(run("[big TO fat}")) == {"1", "5"} and set(run("{c TO hen]")) == {"1", "2", "3", "5"} and set(run("[fat TO *]")) == {"1", "2", "3", "5"}
    assert set(run("/h.n/")) == {"1", "2", "3", "5"} and run("/h./") == {} and set(run("*:*")) == {"1", "2", "3", "4", "5"} and set(run("*:* -hen")) == {"4"}


def test_field_search(spark):
    docs = spark.createDataFrame([("1", "Duck soup", ["water", "duck"]), ("2", "Soup", ["lemon juice"]), ("3", "Lemon tart", ["juice of lemon"])], "doc_id string, title string, ingredients array<string>")
    p = fields.field_postings(docs, "doc_id", ["title", "ingredients"])
    run = lambda q, **k: [r["doc_id"] for r in fields.field_search(p, docs, q, boosts={"title": 3.0, "ingredients": 1.0}, **k).collect()]
    assert set(run("soup")) == {"1", "2"} and run("soup")[0] == "2"  # the shorter title
    assert run('"lemon juice"') == ["2"] and run("+soup -duck") == ["2"] and run("lem*")[0] == "3" and run("duk~1") == ["1"]
    assert run("title:lemon") == ["3"] and run("-soup") == [] and run("") == [] and run("[lemo TO lemz]", fields=["title"]) == ["3"]
    assert set(run("+(duck lemon) +soup")) == {"1", "2"} and set(run("soup AND NOT (duck OR tart)")) == {"2"} and run("title:(lemon)") == ["3"] and run("+(-soup) duck") == []
    e = fields.search_envelope(p, docs, "soup", k=1, boosts={"title": 1.0})
    assert e["total_hits"] == 2 and len(e["results"]) == 1 and "error" in fields.search_envelope(p, docs, "AND x")


def test_result_lines(spark):
    line = files.result_lines(F.lit(1), F.lit("T"), F.lit(0.5), F.lit("u"), {"Chef": F.lit("c"), "Serves": F.lit(""), "X": F.lit(None)})
    assert spark.range(1).select(line).first()[0] == "1. T\n   Score: 0.5000\n   URL: u\n   Chef: c"


def test_pipeline_end_to_end(spark, tmp_path):
    html = tmp_path / "raw"
    html.mkdir()
    (html / "h.example_recipes_duck.html").write_text("<html><body><h1>Duck soup</h1><h2>Ingredients</h2><ul><li><input type=checkbox> duck</li></ul></body></html>")
    (html / "h.example_recipes.html").write_text("<html><body><h1>Recipes</h1></body></html>")
    (tmp_path / "idx").write_text("0:1:Duck soup\n")
    (tmp_path / "dump").write_bytes(bz2.compress(b"<page><title>Duck soup</title><id>1</id><text>x\n== A ==\nHot.\n== B ==</text></page>"))
    p = pipeline.Paths(str(html), str(tmp_path / "rec"), str(tmp_path / "index"), str(tmp_path / "links"), str(tmp_path / "idx"), str(tmp_path / "dump"), str(tmp_path / "out.jsonl"), str(tmp_path / "fields"))
    out = pipeline.run_all(spark, p).collect()
    assert [(r["recipe_url"], r["wiki_description"]) for r in out] == [("https://h.example/recipes/duck", "Hot.")]
    assert json.loads(open(p.export).read())["wiki_title"] == "Duck soup"
    assert [r["title"] for r in pipeline.run_search(spark, p, "duck", method="classic").collect()] == []  # one document: idf 0
    assert pipeline.load_index(spark, p.index)[2].first()["total_documents"] == 1
    pipeline.run_fields(spark, p)
    e = pipeline.run_field_search(spark, p, 'duck AND wiki_title:"duck soup"')
    assert e["total_hits"] == 1 and e["results"][0]["wiki_description"] == "Hot." and "error" in pipeline.run_field_search(spark, p, "a]")
    pipeline.run_export(spark, replace(p, export=str(tmp_path / "export")))
    assert {json.loads(x)["term"] for x in open(tmp_path / "export" / "index.jsonl")} == {"duck", "soup"} and json.loads(open(tmp_path / "export" / "stats.jsonl").read())["total_documents"] == 1
    said, asked = [], iter(["2", "duck", "change", "3", "quit"])
    pipeline.run_repl(spark, p, ask=lambda _: next(asked), say=said.append)
    assert said == ["No results."]
    assert [r["wiki_description"] for r in pipeline.run_abstracts(spark, p, limit=1).collect()] == [None]
    counts = extract.extraction_counts(pages.read_html_dir(spark, str(html)), pipeline.run_extract(spark, p)).first()
    assert counts.asDict() == {"pages": 2, "records": 1, "skipped": 1, "failed": 0}


def test_crawl_and_sitemap_stages(spark, tmp_path):
    web = {"https://h.example": "<a href='/recipes/a'>a</a>", "https://h.example/recipes/a": "<p>A</p><a href='/recipes/b'>b</a>", "https://h.example/recipes/b": "<p>B</p>"}
    web["https://h.example/robots.txt"] = "User-agent: *\nSitemap: https://h.example/s.xml"
    web["https://h.example/s.xml"] = "<sitemapindex><sitemap><loc>https://h.example/1.xml</loc></sitemap><sitemap><loc>https://h.example/gone.xml</loc></sitemap></sitemapindex>"
    web["https://h.example/1.xml"] = "<urlset><url><loc>https://h.example/recipes/b</loc></url><url><loc>https://h.example/recipes/c</loc></url></urlset>"

    def get(url):
        if url not in web:
            raise OSError("not found")
        return web[url]

    p = pipeline.Paths(html_table=str(tmp_path / "pages"), state=str(tmp_path / "state"), seed="https://h.example")
    first = rows(pipeline.run_crawl(spark, p, get, max_depth=1, polite=0).select("url", "visited"))
    assert sum(v for _, v in first) == 1
    done = rows(pipeline.run_crawl(spark, p, get, polite=0).select("url", "depth"))
    assert sorted(done) == [("https://h.example", 0), ("https://h.example/recipes/a", 1), ("https://h.example/recipes/b", 2)]
    saved = lambda: {r["url"] for r in spark.read.parquet(p.html_table).collect()}
    assert saved() == {"https://h.example/recipes/a", "https://h.example/recipes/b"}
    web["https://h.example/recipes/c"] = "<p>C</p>"
    got = dict(rows(pipeline.run_sitemap(spark, p, get, drop_extra=True, polite=0)))
    assert got == {"https://h.example/recipes/a": "extra", "https://h.example/recipes/b": "both", "https://h.example/recipes/c": "missing"}
    assert saved() == {"https://h.example/recipes/b", "https://h.example/recipes/c"}


def test_tables_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_table(spark.range(3), path)
    files.replace_table(spark.read.parquet(path).where("id > 0"), path)  # reads what it replaces
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / "t.last").exists() and not (tmp_path / "t.next").exists()
    (tmp_path / "t").rename(tmp_path / "t.last")  # a crash after the old table stepped aside
    assert spark.read.parquet(files.recovered(spark, path)).count() == 2
    with pytest.raises(ValueError):
        crawl.crawl(spark.createDataFrame([], "url string, html string"), spark.createDataFrame([], "url string"), state=spark.createDataFrame([], "url string, visited boolean, downloaded boolean"))


def test_cutting_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}  # has get

    with pytest.raises(session.NoSharedFolder):
        session.shared_dir(Session())
    Context.getCheckpointDir = lambda self: "hdfs://shared"
    assert session.shared_dir(Session()) == "hdfs://shared"
    df = session.cut(spark.range(3))
    assert df.count() == 3
    path = session.CUT[-1]
    session.release(spark)
    assert not session.CUT and not pages.exists(spark, path)


def test_blocks_that_cant_be_read_say_why(spark, tmp_path):
    path = tmp_path / "d.bz2"
    path.write_bytes(bz2.compress(b"<page><title>A</title><id>1</id></page>"))
    got = dump.read_offsets(spark.createDataFrame([(0,), (5,)], "wiki_offset long"), f"file://{path}").collect()
    assert {r["wiki_offset"]: (r["block"] is None, bool(r["error"])) for r in got} == {0: (False, False), 5: (True, True)}
    assert rows(dump.block_pages(dump.read_offsets(spark.createDataFrame([(0,), (5,)], "wiki_offset long"), str(path))).select("page_id")) == [(1,)]


def test_stream_keeps_the_last_version(spark, tmp_path):
    from datetime import datetime

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    make = lambda word, day: spark.createDataFrame([("https://h.example/recipes/a", None, f"<h1>{word} pie</h1>", datetime(2022, 1, day))], incremental.PAGES)
    for word, day in (("duck", 1), ("goose", 2)):
        make(word, day).write.mode("append").parquet(src)
        incremental.keep_index(incremental.page_stream(spark, src), out, str(tmp_path / "cp")).awaitTermination()
    records, postings = incremental.current(spark, out)
    assert [r["title"] for r in records.collect()] == ["goose pie"]
    assert sorted(r["term"] for r in postings.collect()) == ["goose", "pie"]


def test_windows_count_fetches_and_drop_what_is_too_late(spark, tmp_path):
    from datetime import datetime

    src = str(tmp_path / "in")
    make = lambda rows_: spark.createDataFrame([(u, None, "x", datetime(2022, 1, d, h, m)) for u, d, h, m in rows_], incremental.PAGES)
    make([("https://a.example/1", 1, 9, 5), ("https://a.example/2", 1, 9, 50), ("https://b.example/1", 1, 9, 10), (None, 1, 10, 0)]).coalesce(1).write.mode("append").parquet(src)
    run = lambda: incremental.windowed_fetches(incremental.page_stream(spark, src), late="1 hour").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run()
    make([("https://a.example/3", 2, 9, 0)]).coalesce(1).write.mode("append").parquet(src)  # a day on: the windows before are closed
    run()
    make([("https://a.example/4", 1, 9, 30)]).coalesce(1).write.mode("append").parquet(src)  # too late
    run()
    got = {(r["start"].day, r["start"].hour, r["host"]): r["pages"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 9, "a.example"): 2, (1, 9, "b.example"): 1, (1, 10, ""): 1}
