"""Collection, batching, saving and streams on small tables; queries against their SQL twins."""

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliomill.operators import batching, collect, saving
from foliomill.plans.queries import ORACLES, QUERIES
from foliomill.sources.pages import page_nodes
from foliomill.streaming import pages as stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(rows):
    return sorted(repr([float(v) if isinstance(v, (float, np.floating)) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql_twin(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    columns = sorted(ours.columns)
    theirs = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLES[name]}) q").fetchall()
    assert shown(theirs) == shown(tuple(r) for r in ours.select(*columns).collect())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


PAGE = "<html><head><title>Never collected here</title></head><body><h1>Some heading text</h1><p>Hello there world</p><script>no text here</script><img alt='A small picture'><p>Hello there world</p></body></html>"


def test_collection(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "page_id bigint, html string")
    nodes = page_nodes(pages)
    items = collect.collect_items(nodes)
    assert sorted(r["text"] for r in items.collect()) == ["A small picture", "Hello there world", "Hello there world", "Some heading text"]
    assert collect.collect_items(nodes, skipped_attributes=False).where("attr_name is not null").count() == 0
    best = collect.filter_and_sort(items)
    assert [r["text"] for r in best.orderBy("rank").collect()] == ["A small picture", "Some heading text", "Hello there world"]
    again = collect.filter_and_sort(best.drop("rank"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, best.collect()))
    assert {r["semantic_type"] for r in items.collect()} == {"Title", "Content", "ImageAlt"}


def test_batches_by_hand():
    f = np.float32
    small = batching.BatchConfig(max_chars=50, max_effective=100.0)
    out = batching.pack([30, 30, 10, 5, 5, 60], [f(30), f(30), f(10), f(5), f(5), f(60)], [2, 2, 1, 1, 1, 0], small)
    assert [b.items for b in out] == [(0,), (1,), (2, 3, 4), (5,)] and [b.kind for b in out] == ["Single", "Single", "Standard", "Single"]
    pairs = batching.pack([10, 10, 10, 10], [f(10)] * 4, [2, 2, 1, 1], small)
    assert [b.items for b in pairs] == [(0, 1, 2, 3)] and pairs[0].effective == 20  # the first one's size stays
    apart = batching.pack([10, 10, 10, 10], [f(10)] * 4, [3, 3, 1, 1], small)
    assert [b.items for b in apart] == [(0, 1), (2, 3)]
    assert batching.pack([], [], []) == [] and batching.pack([7], [f(7)], [0])[0].kind == "Single"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 80), st.integers(0, 3)), max_size=40), st.booleans(), st.booleans())
def test_packing_keeps_every_item(items, grouping, sizing):
    config = batching.BatchConfig(max_chars=100, max_effective=120.0, min_chars=20, smart_grouping=grouping, smart_sizing=sizing)
    out = batching.pack([n for n, _ in items], [np.float32(n) for n, _ in items], [p for _, p in items], config)
    assert sorted(i for b in out for i in b.items) == list(range(len(items)))


def test_splitting(spark):
    batched = spark.createDataFrame([(1, 1, k, k, "Standard", 40) for k in range(4)] + [(1, 2, 0, 9, "Single", 5)], "page_id bigint, batch_id int, place int, ord bigint, batch_type string, chars bigint")
    items = spark.createDataFrame([(1, k, "x" * 10) for k in range(4)] + [(1, 9, "x" * 5)], "page_id bigint, ord bigint, text string")
    out = batching.split_batches(batched, items, 25)
    assert sorted((r["batch_id"], r["ord"]) for r in out.collect()) == [(1, 0), (1, 1), (2, 9), (1001, 2), (1001, 3)]


def test_saving_follows_sheets_and_lists(spark):
    pages = spark.createDataFrame([(1, "https://h.example/", "<link rel=stylesheet href=a.css>")], "page_id bigint, url string, html string")
    rows = [("https://h.example/a.css", None, b"@import 'b.css';", "text/css", ""), ("https://h.example/b.css", None, b"p{color:red}", "text/css", "")]
    assets = spark.createDataFrame(rows, "url_key string, final_url string, bytes binary, media_type string, charset string")
    html = saving.saved_pages(spark, pages, assets).first()["html"]
    assert "https://h.example" not in html and "data:text/css;base64," in html
    deny = spark.createDataFrame([(".example",)], "pattern string")
    assert 'href="https://h.example/a.css"' in saving.saved_pages(spark, pages, assets, domains=deny, deny=True).first()["html"]
    at = F.make_timestamp(F.lit(2024), F.lit(1), F.lit(2), F.lit(3), F.lit(4), F.lit(5))
    out = saving.formatted(saving.saved_pages(spark, pages, assets), at=at).first()["content"].decode()
    assert out.startswith("<!-- Saved from https://h.example/ at 2024-01-02T03:04:05Z using foliomill") and out.endswith("\n")
    assert saving.formatted(saving.saved_pages(spark, pages, assets), mhtml=True, metadata=False).first()["content"].startswith(b"MIME-Version: 1.0\r\n")


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, "u", PAGE)], stream.PAGES).write.parquet(folder)
    items = stream.item_stream(stream.page_stream(spark, folder))
    q = items.writeStream.format("memory").queryName("items").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("items").count() == 4
    spark.createDataFrame([("a", "A"), ("a", "B"), ("b", None)], "text string, translated string").write.parquet(folder + "2")
    asked = spark.readStream.schema("text string, translated string").parquet(folder + "2")
    q = stream.cached_translations(asked).writeStream.format("memory").queryName("hits").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["text"], r["hits"]) for r in spark.table("hits").collect()) == [("a", 1), ("b", 0)]


def test_translation_of_pages(spark):
    from foliomill.operators import translation

    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>short</p>")], "page_id bigint, html string")
    out = {r["page_id"]: r for r in translation.translate_pages(spark, pages, F.upper).collect()}
    assert "<p>HELLO THERE WORLD</p>" in out[1]["html"] and out[1]["html"].count("HELLO") == 2 and 'alt="A SMALL PICTURE"' in out[1]["html"]
    assert "no text here" in out[1]["html"] and "Never collected here" in out[1]["html"]
    assert (out[2]["html"], out[2]["n_items"], out[3]["html"]) == (None, 0, "<p>short</p>")
    # A translator that answers whole batches with nothing useful is asked again item by item.
    stubborn = lambda request: F.when(request.contains("\n"), "nothing").otherwise(F.upper(request))
    again = {r["page_id"]: r for r in translation.translate_pages(spark, pages, stubborn).collect()}
    assert "HELLO THERE WORLD" in again[1]["html"]


def test_retries(spark):
    from foliomill.operators import translation

    tries = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, True), (2, 0, False), (2, 3, False), (2, 9, True)], "batch_id int, attempt int, ok boolean")
    assert sorted(tuple(r) for r in translation.retried(tries).select("batch_id", "attempt", "ok").collect()) == [(1, 1, True), (2, 3, False)]


def test_pages_nested_thousands_deep_are_whole(spark):
    """No rule, search or path depends on the depth of a tree."""
    from foliomill.operators import translation

    depth = 20_000
    html = "<title>Nested page title</title>" + "<div>" * depth + "<p>Some deep text here<img src=i.png>" + "</div>" * depth + "<p>Some shallow text here"
    pages = spark.createDataFrame([(1, "https://h.example/", html)], "page_id bigint, url string, html string")
    nodes = page_nodes(pages)
    assert nodes.where("tag = 'div'").count() == depth and nodes.agg(F.max("depth"), F.max(F.size("path"))).first()[:] == (depth + 4, 128)
    deep = nodes.where("text like 'Some deep%'").first()
    assert deep["path"][:3] == ["html", "body", "div"] and deep["path"][-1] == "p" and deep["depth"] == depth + 4
    assets = spark.createDataFrame([("https://h.example/i.png", None, b"PNG", "image/png", "")], "url_key string, final_url string, bytes binary, media_type string, charset string")
    out = saving.saved_pages(spark, pages, assets).first()
    assert out["error"] is None and out["title"] == "Nested page title" and out["html"].count("<div>") == depth and "data:image/png;base64,UE5H" in out["html"]
    done = translation.translate_pages(spark, pages.select("page_id", "html"), F.upper).first()
    assert "SOME SHALLOW TEXT HERE" in done["html"] and "Some deep text here" in done["html"]  # beyond the depth that is collected


def test_settings_come_from_defaults_file_and_environment(tmp_path):
    from foliomill import settings

    file = tmp_path / "own.toml"
    file.write_text('target_lang = "fr"\nbatch_size = 500\nother = 1\n')
    got = settings.load([tmp_path / "none.json", file], {"FOLIOMILL_BATCH_SIZE": "700", "FOLIOMILL_ENABLED": "off", "FOLIOMILL_CACHE_TTL_SECS": "5", "BATCH_SIZE": "900"})
    assert (got["target_lang"], got["batch_size"], got["enabled"], got["cache_ttl_secs"], "other" in got) == ("fr", 700, False, 3600, False)
    file.with_suffix(".json").write_text('{"local_cache_size": 0}')
    with pytest.raises(ValueError, match="local_cache_size"):
        settings.load([file.with_suffix(".json")], {})
    assert settings.load([], {}) == {r.name: r.default for r in settings.RULES}


def test_job_writes_files_and_tells_failures(spark, tmp_path, capsys):
    from foliomill import job

    assets = spark.createDataFrame([("https://h.example/a", None, b"<title>Lake</title>x<script>y</script>", "text/html", "")], "url_key string, final_url string, bytes binary, media_type string, charset string")
    assets.write.parquet(str(tmp_path / "assets"))
    (tmp_path / "targets.txt").write_text("https://h.example/a\n\ndata:text/html,<title>Two\n")
    common = ["--targets", str(tmp_path / "targets.txt"), "--assets", str(tmp_path / "assets"), "--folder", str(tmp_path / "out")]
    assert job.main([*common, "--output", "sub/%title%.%ext%", "--mhtml", "--no-metadata"], spark) == 0
    assert "<script></script>" in (tmp_path / "out/sub/Lake.mht").read_text() and (tmp_path / "out/sub/Two.mht").exists()
    (tmp_path / "targets.txt").write_text("https://h.example/gone\ndata:text/html,<title>Three\n")
    assert job.main(common, spark) == 1 and (tmp_path / "out/Three.html").exists()
    assert "could not retrieve target document" in capsys.readouterr().err


def test_export(spark, tmp_path):
    from foliomill.operators import library

    records = spark.createDataFrame([("1", "é,"), ("2", None)], "id string, title string")
    for kind in ("json", "csv", "parquet"):
        library.export(records, str(tmp_path / kind), kind)
        back = {"json": spark.read.json, "csv": spark.read.option("header", True).csv, "parquet": spark.read.parquet}[kind](str(tmp_path / kind))
        assert sorted((r["id"], r["title"] or None) for r in back.select("id", "title").collect()) == [("1", "é,"), ("2", None)]


def test_scratch_tables_go_with_their_scope(spark):
    import os

    from foliomill.plans.scratch import Scratch, scope

    with scope(spark):
        inner = Scratch(spark, "inner")
        assert inner.table(spark.range(3), "t").count() == 3
        folder = inner.root.removeprefix("file://")
        assert os.path.exists(folder)
    assert not os.path.exists(folder)


def test_cookies_and_patterns_join_on_the_ends_of_hosts(spark):
    from foliomill.functions import url as uf
    from foliomill.sources import cookies as ck

    rows = spark.createDataFrame([("a.b.Example.com.", ["a.b.example.com", "b.example.com", "example.com", "com", ""]), ("", [""])], "d string, e array<string>")
    assert rows.where(uf.domain_suffixes(F.col("d")) != F.col("e")).count() == 0
    jar = spark.createDataFrame([(".example.com", True, "/", False, 0, "all"), ("example.com", False, "/", False, 0, "own"), (".com", True, "/x", False, 0, "top")], "domain string, include_subdomains boolean, path string, https_only boolean, expires long, name string")
    urls = spark.createDataFrame([(1, "https://a.example.com/x"), (2, "http://example.com"), (3, "https://other.org/")], "id int, url string")
    got = sorted((r["id"], r["name"]) for r in ck.cookies_for(urls, jar, F.lit(5)).collect())
    assert got == [(1, "all"), (1, "top"), (2, "all"), (2, "own")]
    assert "NestedLoop" not in ck.cookies_for(urls, jar, F.lit(5))._jdf.queryExecution().toString()


def test_a_piped_document_is_a_target(spark):
    import io

    from foliomill.sources.pages import piped_document, scan_documents

    class Broken(io.BytesIO):
        def read(self, size=-1):
            part = super().read(3)
            if not part:
                raise OSError("gone")
            return part

    none = spark.createDataFrame([], "url string, bytes binary, media_type string")
    out = scan_documents(spark.createDataFrame([("-",)], "target string"), none, piped_document(spark, Broken(b"<p>piped")))
    assert out.first()["html"] == b"<p>piped"
