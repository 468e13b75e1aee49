"""Pages whose markup is unclosed or cut short, and pages in great numbers."""

import gc
from functools import partial

import duckdb
import pyarrow as pa
import pytest

from foliomill.functions.html import Node, parse_html, serialize
from foliomill.functions.rewrite import Options
from foliomill.operators import saving, translation
from foliomill.plans.queries import ORACLES, QUERIES
from foliomill.sources.pages import page_nodes

HEAD = '<html><head><meta charset="utf-8"><title>{0}</title></head><body><article><h1>{0}</h1>'


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Page 1 has titles cut inside a reference, page 2 a bold text that nothing closes in every other paragraph."""
    cut = HEAD.format("One and&amp;two &lt;three&gt; and&amp") + "<p>One and&amp;two &lt;three&gt; and more</p></article></body></html>"
    bold = HEAD.format("Some heading text") + "".join(f"<p><b>Bold text {k}.<br><p>Plain text {k}.</p>" for k in range(60)) + "</article></body></html>"
    path = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame([(1, "https://h.example/1", cut), (2, "https://h.example/2", bold)], "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", ["collected_by_type", "collected_items", "collection_statistics", "node_counts", "node_metadata", "translated_page_counts"])
def test_unclosed_markup_as_in_sql(spark, folder, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    ours = QUERIES[name](spark, folder)
    theirs = duck.sql(f"SELECT {', '.join(ours.columns)} FROM ({ORACLES[name]}) q").fetchall()
    assert sorted(map(repr, theirs)) == sorted(repr(tuple(r)) for r in ours.collect())


def test_three_alike_are_opened_again():
    """As browsers do: of formatting elements with the same tag and attributes the last three."""
    assert serialize(parse_html("<p><b><b><b><b>1<p>2<p><b class=x>3<p>4")) == (
        "<html><head></head><body><p><b><b><b><b>1</b></b></b></b></p><p><b><b><b>2</b></b></b></p>"
        '<p><b><b><b><b class="x">3</b></b></b></b></p><p><b><b><b><b class="x">4</b></b></b></b></p></body></html>'
    )
    assert sum(1 for _ in parse_html("<p><b>text<p>more" * 1000).walk()) < 12_000


@pytest.mark.parametrize("text, closed, whole", [("a&amp", "a&amp", "a&"), ("&lt;&#x27;&#39;&amp;lt;", "<''&lt;", "<''&lt;"), ("&notit; &none; &copy", "&notit; &none; &copy", "¬it; &none; ©")])
def test_references_without_semicolon(text, closed, whole):
    html = f"<p title='{text}'>{text}"
    for option, expected in ((True, closed), (False, whole)):
        p = parse_html(html, option).find("p")[0]
        assert p.content() == p.get("title") == expected


class Stage:
    """Stands for a frame and gives the function of its Arrow stage."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


def passed(run, batch):
    """Rows of each outgoing batch, and the nodes of trees that are still there without a collection of garbage."""
    gc.collect()
    before = sum(type(x) is Node for x in gc.get_objects())
    gc.disable()
    try:
        return [b.num_rows for b in run(iter([batch]))], sum(type(x) is Node for x in gc.get_objects()) - before
    finally:
        gc.enable()


PLAIN = "<p>" + "Some plain text. " * 1000


def test_nodes_leave_in_batches(spark):
    """One page of very many nodes goes out in parts, and so do long texts."""
    sizes, left = passed(page_nodes(Stage()), pa.RecordBatch.from_pydict({"page_id": [1, 2], "html": ["<br>" * 30_000, None]}))
    assert sum(sizes) == 30_004 + 4 and max(sizes) <= 5_000 and left == 0
    sizes, left = passed(page_nodes(Stage()), pa.RecordBatch.from_pydict({"page_id": range(1000), "html": [PLAIN] * 1000}))
    assert sum(sizes) == 6000 and len(sizes) > 5 and left == 0


def test_saved_pages_leave_in_batches():
    pages = [{"page_id": k, "url": "https://h.example/", "html": PLAIN, "assets": None} for k in range(1000)]
    sizes, left = passed(saving._save(Options()), pa.RecordBatch.from_pylist(pages))
    assert sum(sizes) == 1000 and len(sizes) > 5 and left == 0


def test_translated_pages_leave_in_batches():
    change = {"node_id": 5, "attr_name": None, "translated": "AS TRANSLATED"}
    pages = [{"page_id": k, "html": PLAIN, "n_items": 1, "changes": [change] if k % 2 else None} for k in range(1000)]
    sizes, left = passed(partial(translation._apply, False), pa.RecordBatch.from_pylist(pages))
    assert sum(sizes) == 1000 and len(sizes) > 3 and left == 0
