"""Literal tables for what the driver's pages don't hold, with the results written out; those are the DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill import __version__
from foliomill.functions import encoding as en
from foliomill.functions import text as tf
from foliomill.functions.rewrite import Options, srcset_candidates
from foliomill.job import saved_targets
from foliomill.operators import batching, catalog, collect, library, saving, translation
from foliomill.plans.registry import literals, query, values
from foliomill.settings import checked_settings, example
from foliomill.sources.pages import page_nodes


def _at():
    return F.make_timestamp(F.lit(2024), F.lit(3), F.lit(4), F.lit(5), F.lit(6), F.lit(7))


# Trees and metadata.

TREE = "<title>Lake</title><!--note--><p class=a>One <b>two</b><p>three"
TREE_NODES = [
    (0, None, 0, "document", None, "", "", None),
    (1, 0, 1, "element", "html", "", "", None),
    (2, 1, 2, "element", "head", "html", "", None),
    (3, 2, 3, "element", "title", "html/head", "", None),
    (4, 3, 4, "text", None, "html/head/title", "", "Lake"),
    (5, 2, 3, "comment", None, "html/head", "", "note"),
    (6, 1, 2, "element", "body", "html", "", None),
    (7, 6, 3, "element", "p", "html/body", "class=a", None),
    (8, 7, 4, "text", None, "html/body/p", "", "One "),
    (9, 7, 4, "element", "b", "html/body/p", "", None),
    (10, 9, 5, "text", None, "html/body/p/b", "", "two"),
    (11, 6, 3, "element", "p", "html/body", "", None),
    (12, 11, 4, "text", None, "html/body/p", "", "three"),
]


@query(f"SELECT node_id, parent_id, depth, kind, tag, path, attrs, text FROM {values(TREE_NODES, 'node_id, parent_id, depth, kind, tag, path, attrs, text')}")
def tree_cases(spark, sf_dir):
    """Every node of a small page, with its place, its path and its attributes."""
    nodes = page_nodes(literals(spark, [(1, TREE)], "page_id bigint, html string"))
    shown = F.array_join(F.transform("attrs", lambda a: F.concat(a["name"], F.lit("="), a["value"])), " ")
    text = F.when(F.col("kind") != "document", F.col("text"))
    return nodes.select("node_id", "parent_id", "depth", "kind", "tag", F.array_join("path", "/").alias("path"), shown.alias("attrs"), text.alias("text"))


LISTS = "<div><ul><li>a</li><li><ul><li>b</li></ul></li></ul></div><ul><li>c</li></ul>"
#: What is looked for, and the place of each element found among all nodes.
SEARCHES = [("ul li", 6), ("ul li", 8), ("ul li", 10), ("ul li", 13), ("div ul", 5), ("div ul", 9), ("div li", 6), ("div li", 8), ("div li", 10), ("body", 3)]


@query(f"SELECT steps, node_id FROM {values(SEARCHES, 'steps, node_id')}")
def descendant_cases(spark, sf_dir):
    """Elements by paths of steps with anything in between."""
    nodes = page_nodes(literals(spark, [(1, LISTS)], "page_id bigint, html string"))
    out = None
    for steps in dict.fromkeys(s for s, _ in SEARCHES):
        found = catalog.descendants(nodes, *steps.split()).select(F.lit(steps).alias("steps"), "node_id")
        out = found if out is None else out.unionByName(found)
    return out


HEADS = [
    (1, "<title>A</title><title>B</title><base href=/x/><base href=/y/>", "A", None, "/x/", None, False),
    (2, "<base><base href=/y/><meta name=Robots content=all><meta name=robots content=none>", None, None, None, "all", False),
    (3, "<base href=''><link rel=' Shortcut Icon ' href=i>", None, None, "", None, True),
    (4, "<link rel='icon stylesheet' href=i><meta charset=x><meta charset=y>", None, "x", None, None, False),
    (5, "<meta http-equiv=Content-Type content='text/html; charset=gbk'>", None, "gbk", None, None, False),
    (6, "<body><base href=/late/><link rel=icon href=i><title>T</title>", None, None, None, None, False),
    (7, "<link rel=ICON href=i><meta name=robots>", None, None, None, None, True),
    (8, None, None, None, None, None, False),
]


@query(f"SELECT page_id, title, charset, base_url, robots, has_favicon FROM {values([(h[0], *h[2:]) for h in HEADS], 'page_id, title, charset, base_url, robots, has_favicon')}")
def metadata_cases(spark, sf_dir):
    """First base, first robots, icons by their whole rel; what stands in the body doesn't count."""
    out = catalog.node_metadata(page_nodes(literals(spark, [h[:2] for h in HEADS], "page_id bigint, html string")))
    return out.withColumn("page_id", F.col("page_id").cast("int"))


SRCSETS = [
    (1, "s.png 1x, m.png 2x", "s.png|1x;m.png|2x"),
    (2, "a,b.png 480w,\n\tc.png 800w,", "a,b.png|480w;c.png|800w"),
    (3, "one.png, two.png", "one.png|;two.png|"),
    (4, "in side.png 2x", "in side.png|2x"),
    (5, "a.png 100h", "a.png|100h"),
    (6, " , ,", ""),
    (7, "", ""),
    (8, "a.png 1x 2x,b.png", "a.png|1x 2x;b.png|"),
]


@query(f"SELECT id, candidates FROM {values([(i, c) for i, _, c in SRCSETS], 'id, candidates')}")
def srcset_cases(spark, sf_dir):
    rows = literals(spark, [r[:2] for r in SRCSETS], "id int, value string").select("id", srcset_candidates("value").alias("c"))
    return rows.select("id", F.array_join(F.transform("c", lambda x: F.concat(x["path"], F.lit("|"), x["descriptor"])), ";").alias("candidates"))


# Output.

STAMP = f"using foliomill v{__version__} -->"
FORMATTED = [
    (1, False, "https://h.example/p?q", f"<!-- Saved from https://h.example/p?q at 2024-03-04T05:06:07Z {STAMP}\n"),
    (2, False, "local source", f"<!-- Saved from local source at 2024-03-04T05:06:07Z {STAMP}\n"),
    (1, True, "https://h.example/p?q", "MIME-Version: 1.0\r\n"),
    (2, True, "local source", "MIME-Version: 1.0\r\n"),
]


@query(f"SELECT page_id, mhtml, head, CASE WHEN mhtml THEN '\r\n------=_NextPart_000_0000--\r\n' ELSE '</html>' || chr(10) END AS tail FROM {values([(f[0], f[1], f[3]) for f in FORMATTED], 'page_id, mhtml, head')}")
def formatted_cases(spark, sf_dir):
    """Provenance without credentials and fragment, the last newline, and the frame of MHTML."""
    rows = [(1, "https://u:p@h.example/p?q#f", "<p>x"), (2, "file:///srv/p.html", "<p>y")]
    none = literals(spark, [], "url_key string, final_url string, bytes binary, media_type string, charset string")
    saved = saving.kept(spark, saving.saved_pages(spark, literals(spark, rows, "page_id bigint, url string, html string"), none), "formatted")
    out = None
    for mhtml in (False, True):
        text = F.decode("content", "UTF-8")
        head = F.regexp_extract(text, "(?s)^(.*?\n)", 1)
        tail = F.substring(text, F.char_length(text) - (30 if mhtml else 7), F.lit(31 if mhtml else 8))
        one = saving.formatted(saved, mhtml, not mhtml, _at()).select(F.col("page_id").cast("int").alias("page_id"), F.lit(mhtml).alias("mhtml"), head.alias("head"), tail.alias("tail"))
        out = one if out is None else out.unionByName(one)
    return out


LABELS = [(1, "utf-8", None, "é€"), (2, "gb2312", None, "é&#8364;"), (3, "iso-8859-1", None, "é€"), (4, "nonsense", 'unknown encoding "nonsense"', "é€"), (5, "us-ascii", None, "é€"), (6, "shift_jis", None, "&#233;&#8364;"), (7, None, None, "é€")]


@query(f"SELECT id, error, shown FROM {values([(i, e, s) for i, _, e, s in LABELS], 'id, error, shown')}")
def output_encodings(spark, sf_dir):
    """Labels that are known, and a text written in each and read again; what an encoding lacks becomes a reference."""
    rows = literals(spark, [r[:2] for r in LABELS], "id int, label string").withColumn("content", en.encoded_page(F.lit("é€"), F.col("label")))
    return rows.select("id", en.encoding_error("label").alias("error"), en.decoded_page("content", "label")["text"].alias("shown"))


JOB = [
    ("https://h.example/a", "Lake.html", '<html><head><title>Lake</title><meta name="robots" content="none"></meta></head><body><img src="data:image/png;base64,UE5H"></body></html>\n', None),
    ("data:text/html,<title>.x/y", "x_y.html", '<html><head><title>.x/y</title><meta name="robots" content="none"></meta></head><body></body></html>\n', None),
    ("/srv/n.html", ".html", '<html><head><meta name="robots" content="none"></meta></head><body><p>né</p></body></html>\n', None),
    ("https://h.example/gone", None, None, "could not retrieve target document"),
    ("https://h.example/i.png", None, None, "unsupported document media type"),
    ("/srv/gone.html", None, None, "file not found"),
]


@query(f"SELECT target, path, content, error FROM {values(JOB, 'target, path, content, error')}")
def saved_target_cases(spark, sf_dir):
    """A job from targets to paths and contents; what can't be read is an error on its row."""
    targets = literals(spark, [(j[0],) for j in JOB], "target string")
    known = [("https://h.example/a", None, b"<title>Lake</title><body><img src=i.png>", "text/html", ""), ("https://h.example/i.png", None, b"PNG", "image/png", "")]
    assets = literals(spark, known, "url_key string, final_url string, bytes binary, media_type string, charset string")
    files = literals(spark, [("/srv/n.html", "<p>né".encode())], "path string, content binary")
    return saved_targets(spark, targets, assets, files, Options()).withColumn("content", F.decode("content", "UTF-8"))


CACHED = [("https://h.example/a.css", "new", "memory"), ("https://h.example/b.png", "old", "memory"), ("https://h.example/moved.js", "js", "memory"), ("https://h.example/big", "x" * 10_241, "disk")]


@query(f"SELECT url_key, md5(content) AS content, tier FROM {values(CACHED, 'url_key, content, tier')}")
def asset_cache(spark, sf_dir):
    """What was fetched replaces what a cache held, under the URL it came from in the end."""
    schema = "url_key string, final_url string, bytes binary, media_type string, charset string"
    cache = literals(spark, [("https://h.example/a.css", None, b"old", "text/css", ""), ("https://h.example/b.png", None, b"old", "image/png", "")], schema)
    fetched = literals(spark, [("https://h.example/a.css", None, b"new", "text/css", ""), ("https://h.example/c.js", "https://h.example/moved.js#f", b"js", "text/javascript", ""), ("https://h.example/none", None, None, "", ""), ("https://h.example/big", None, b"x" * 10_241, "", "")], schema)
    return saving.cached_assets(cache, fetched).select("url_key", F.md5("bytes").alias("content"), "tier")


ASKED = [(1, "https://a.lake.example/i.png", True), (1, "https://lake.example/s.css", False), (2, "https://lake.example/s.css", False), (2, "https://hill.example/x", True), (3, "https://hill.example/none", False)]


@query(f"SELECT page_id, url_key, found FROM {values(ASKED, 'page_id, url_key, found')}")
def asset_lookup(spark, sf_dir):
    """References with or without an asset; a list of domains denies some before the lookup."""
    refs = literals(spark, [a[:2] for a in ASKED], "page_id int, url_key string")
    known = [(u, u, b"x", "", "") for u in ("https://a.lake.example/i.png", "https://lake.example/s.css", "https://hill.example/x")]
    assets = literals(spark, known, "url_key string, final_url string, bytes binary, media_type string, charset string")
    deny = literals(spark, [("lake.example",), (".nowhere.example",), ("",)], "pattern string")
    allowed = saving.looked_up(refs, assets, deny, deny=True).where("bytes is not null")
    return refs.join(allowed.select("page_id", "url_key", F.lit(True).alias("found")), ["page_id", "url_key"], "left").fillna(False, ["found"])


# Collection.

COLLECTED_PAGE = (
    "<html><head><title>The lake in winter</title></head><body title='About this quiet page'><h1>Walking round the lake</h1>"
    "<p>Short line here<p>Short line here<ul><li><a href=/x aria-label='Go to the map'>See the whole map</a></ul>"
    "<button>Send the letter</button><label>Your full name</label><input placeholder='Type your name'><img src=i.png alt='A boat on water'>"
    "<script>not these words</script><pre>nor these words</pre><p>https://h.example/<p>42<p>menu"
    "<p>A much longer sentence that goes on for more than a hundred bytes, so that it counts among the ones that matter most.</body></html>"
)
_LONG = "A much longer sentence that goes on for more than a hundred bytes, so that it counts among the ones that matter most."
#: Text, attribute, type as collected, type by place, priority, depth, element around it.
COLLECTED = [
    ("About this quiet page", "title", "Attribute:title", "Tooltip", 0, 2, "html"),
    ("Walking round the lake", None, "Content", "Title", 1, 4, "h1"),
    ("Short line here", None, "Content", "Content", 0, 4, "p"),
    ("Short line here", None, "Content", "Content", 0, 4, "p"),
    ("Go to the map", "aria-label", "Attribute:aria-label", "Tooltip", 0, 5, "li"),
    ("See the whole map", None, "Content", "Link", 0, 6, "a"),
    ("Send the letter", None, "Content", "Button", 0, 4, "button"),
    ("Your full name", None, "Content", "FormLabel", 0, 4, "label"),
    ("Type your name", "placeholder", "Attribute:placeholder", "FormLabel", 0, 3, "body"),
    ("A boat on water", "alt", "Attribute:alt", "ImageAlt", 0, 3, "body"),
    (_LONG, None, "Content", "Content", 2, 4, "p"),
]
_COLLECTED = values([(i, *c) for i, c in enumerate(COLLECTED)], "ord, text, attr_name, text_type, semantic_type, priority, depth, parent_tag")


def _collected(spark):
    return collect.collect_items(page_nodes(literals(spark, [(1, COLLECTED_PAGE)], "page_id bigint, html string")))


@query(f"SELECT text, attr_name, text_type, semantic_type, priority, depth, parent_tag, row_number() OVER (ORDER BY ord)::INTEGER AS place FROM {_COLLECTED}")
def collected_cases(spark, sf_dir):
    """Texts and attributes in document order; titles, scripts, preformatted and untranslatable ones left out."""
    from pyspark.sql import Window

    return _collected(spark).select("text", "attr_name", "text_type", "semantic_type", "priority", "depth", "parent_tag", F.row_number().over(Window.partitionBy("page_id").orderBy("ord")).alias("place"))


@query(
    f"""SELECT text, priority, row_number() OVER (ORDER BY priority DESC, length(text), depth, ord)::INTEGER AS rank
FROM (SELECT text, text_type, arg_min(priority, ord) AS priority, arg_min(depth, ord) AS depth, min(ord) AS ord FROM {_COLLECTED} GROUP BY 1, 2) x"""
)
def sorted_cases(spark, sf_dir):
    """Without repeats, by priority, length, depth and place."""
    return collect.filter_and_sort(_collected(spark)).select("text", "priority", "rank")


@query(f"SELECT semantic_type, string_agg(text, ' / ' ORDER BY ord) AS texts FROM {_COLLECTED} GROUP BY 1")
def grouped_cases(spark, sf_dir):
    return collect.grouped_by(_collected(spark), "semantic_type").select("semantic_type", F.array_join("texts", " / ").alias("texts"))


@query(f"SELECT priority, string_agg(text, ' / ' ORDER BY ord) AS texts FROM {_COLLECTED} GROUP BY 1")
def grouped_by_priority_cases(spark, sf_dir):
    return collect.grouped_by(_collected(spark), "priority").select("priority", F.array_join("texts", " / ").alias("texts"))


@query("SELECT 34 AS nodes, 13 AS texts, 11 AS items, 10 AS distinct_items, round(11 / 13::DOUBLE, 6) AS translatability_rate, round(1 - 10 / 11::DOUBLE, 6) AS dedup_rate")
def statistics_cases(spark, sf_dir):
    nodes = page_nodes(literals(spark, [(1, COLLECTED_PAGE)], "page_id bigint, html string"))
    out = collect.collection_statistics(nodes, collect.collect_items(nodes)).drop("page_id")
    whole = [F.col(c).cast("int").alias(c) for c in ("nodes", "texts", "items", "distinct_items")]
    return out.select(*whole, *[F.round(c, 6).alias(c) for c in ("translatability_rate", "dedup_rate")])


@query(f"SELECT 'content' AS kind, text FROM {_COLLECTED} WHERE text_type = 'Content' UNION ALL SELECT 'high', text FROM {_COLLECTED} WHERE priority >= 2")
def chosen_cases(spark, sf_dir):
    """Items of one type, and those of high priority."""
    items = _collected(spark)
    return collect.of_type(items, "Content").select(F.lit("content").alias("kind"), "text").unionByName(collect.of_high_priority(items).select(F.lit("high").alias("kind"), "text"))


@query(f"SELECT upper(text) AS text FROM {_COLLECTED} WHERE contains(text, 'lake')")
def post_processed_cases(spark, sf_dir):
    """The steps of a user, one after the other."""
    steps = [lambda f: f.where(F.col("text").contains("lake")), lambda f: f.withColumn("text", F.upper("text"))]
    return collect.post_processed(_collected(spark), steps).select("text")


FILTERED = [(1, "Two words", True, True), (2, "https://h.example/", False, False), (3, "Call 555 now", True, False), (4, "", False, False), (5, "Words in a row", True, True), (6, None, False, False)]


@query(f"SELECT id, plain, strict FROM {values([(f[0], f[2], f[3]) for f in FILTERED], 'id, plain, strict')}")
def filtered_cases(spark, sf_dir):
    """Texts that pass, and those that pass a rule of the user's as well."""
    rows = literals(spark, [f[:2] for f in FILTERED], "id int, text string")
    plain = collect.filtered(rows).select("id", F.lit(True).alias("plain"))
    strict = collect.filtered(rows, rules=[lambda t: ~t.rlike(r"\d")]).select("id", F.lit(True).alias("strict"))
    return rows.select("id").join(plain, "id", "left").join(strict, "id", "left").fillna(False, ["plain", "strict"])


# Batches: sizes and priorities in order, and the batches that they make.

PACKED = {
    "by priority": (batching.BatchConfig(max_chars=50, max_effective=100.0), [(30, 2), (30, 2), (10, 1), (5, 1), (5, 1), (60, 0)], "0:Single:2:30 1:Single:2:30 2,3,4:Standard:1:20 5:Single:0:60"),
    "joined pairs": (batching.BatchConfig(max_chars=50, max_effective=100.0), [(10, 2), (10, 2), (10, 1), (10, 1)], "0,1,2,3:Standard:2:40"),
    "too far apart": (batching.BatchConfig(max_chars=50, max_effective=100.0), [(10, 3), (10, 3), (10, 1), (10, 1)], "0,1:Small:3:20 2,3:Small:1:20"),
    "no joining": (batching.BatchConfig(max_chars=50, max_effective=100.0, merging=False), [(10, 2), (10, 2), (10, 1), (10, 1)], "0,1:Small:2:20 2,3:Small:1:20"),
    "by effective size": (batching.BatchConfig(max_chars=500, max_effective=25.0), [(10, 1), (10, 1), (10, 1)], "0,1:Small:1:20 2:Single:1:10"),
    "large": (batching.BatchConfig(max_chars=50, max_effective=100.0), [(15, 1), (15, 1), (15, 1)], "0,1,2:Large:1:45"),
    "in order": (batching.BatchConfig(max_chars=50, min_chars=10, smart_grouping=False), [(20, 0), (20, 3), (60, 1), (20, 2), (20, 1), (5, 0)], "0,1:Small:3:40 2:Single:1:60 3,4,5:Large:2:45"),
    "one": (batching.BatchConfig(), [(7, 0)], "0:Single:0:7"),
    "none": (batching.BatchConfig(), [], ""),
}


@query(f"SELECT name, batches FROM {values([(n, b) for n, (_, _, b) in PACKED.items()], 'name, batches')}")
def packing_cases(spark, sf_dir):
    """Packing under small limits: by priority or in order, with and without joining."""
    out = literals(spark, [(n,) for n in PACKED], "name string")
    made = None
    for k, (name, (config, items, _)) in enumerate(PACKED.items()):
        rows = [(k, i + 1, i, "x" * size, "Content", priority, 0, None) for i, (size, priority) in enumerate(items)]
        frame = literals(spark, rows, "page_id bigint, rank int, ord bigint, text string, text_type string, priority int, depth int, parent_tag string")
        batched = batching.create_batches(frame, config)
        members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "ord"))), lambda x: x["ord"].cast("string")), ",")
        one = batched.groupBy("batch_id", "batch_type", "batch_priority", "chars").agg(members.alias("items"))
        shown = F.concat_ws(":", "items", "batch_type", "batch_priority", "chars")
        one = one.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch_id", shown.alias("s")))), lambda x: x["s"]), " ").alias("batches")).select(F.lit(name).alias("name"), "batches")
        made = one if made is None else made.unionByName(one)
    return out.join(made, "name", "left")


# Translation.

STRATEGIES = [("Single", 1, "single"), ("Small", 2, "individual"), ("Small", 1, "individual"), ("Small", 4, "indexed"), ("Standard", 2, "indexed"), ("Large", 40, "indexed")]


@query(f"SELECT batch_type, items, how FROM {values(STRATEGIES, 'batch_type, items, how')}")
def strategies(spark, sf_dir):
    rows = literals(spark, [s[:2] for s in STRATEGIES], "batch_type string, items int")
    return rows.select("batch_type", "items", translation.strategy(F.col("batch_type"), F.col("items")).alias("how"))


VERDICTS = [("single", True, 1), ("individual", True, 2), ("indexed", True, 9), ("indexed", False, 3), ("indexed", True, 5), ("individual", False, 1)]


@query(f"SELECT count(*)::INTEGER AS batches, 4 AS successful, 20 AS items, round(4 / 6::DOUBLE, 6) AS success_rate, round(2 / 3::DOUBLE, 6) AS indexed_success_rate FROM {values(VERDICTS, 'how, success, n_matched')}")
def processor_counts(spark, sf_dir):
    out = translation.processor_statistics(literals(spark, VERDICTS, "how string, success boolean, n_matched int"))
    whole = [F.col(c).cast("int").alias(c) for c in ("batches", "successful", "items")]
    return out.select(*whole, *[F.round(c, 6).alias(c) for c in ("success_rate", "indexed_success_rate")])


SHOWN = [(1, "en", "zh", "lake", "湖", "en:zh:lake", "湖"), (2, "auto", "zh", "hill", "", "auto:zh:hill", "hill"), (3, "fr", "en", "lac", None, "fr:en:lac", "lac")]


@query(f"SELECT id, key, shown FROM {values([(s[0], s[5], s[6]) for s in SHOWN], 'id, key, shown')}")
def shown_translations(spark, sf_dir):
    """Keys of a cache, and the text that is shown: the translation, or what there was."""
    rows = literals(spark, [s[:5] for s in SHOWN], "id int, source string, target string, text string, translated string")
    key = translation.cache_key(F.col("source"), F.col("target"), F.col("text"))
    return rows.select("id", key.alias("key"), translation.translated_or_original(F.col("translated"), F.col("text")).alias("shown"))


TRANSLATED = [
    (1, '<html><head></head><body><p>ONE LONE TEXT</p></body></html>', 1, 1),
    (2, '<html><head></head><body><p>FIRST TEXT HERE</p><p>SECOND TEXT HERE</p></body></html>', 2, 2),
    (3, '<html><head></head><body><p>TEXT NUMBER AA</p><p>TEXT NUMBER BB</p><p>TEXT NUMBER CC</p><p>TEXT NUMBER AA<img alt="PICTURE OF BOATS"></p></body></html>', 5, 5),
    (4, "<p>42", 0, 0),
]


@query(f"SELECT page_id, html, n_items, n_translated FROM {values(TRANSLATED, 'page_id, html, n_items, n_translated')}")
def translated_cases(spark, sf_dir):
    """A single text, a small batch, numbered lines, repeated texts and attributes, and a page with nothing to translate.

    The stand-in for a translator writes in capitals and answers numbered
    lines without their numbers, so that batches fall back to text by text.
    """
    lower = [(1, "<p>One lone text"), (2, "<p>First text here<p>Second text here"), (3, "<p>Text number aa<p>Text number bb<p>Text number cc<p>Text number aa<img alt='Picture of boats'>"), (4, "<p>42")]
    answer = lambda request: F.upper(F.regexp_replace(request, r"(?m)^\[\d+\] ", ""))
    out = translation.translate_pages(spark, literals(spark, lower, "page_id bigint, html string"), answer)
    return out.select(*[F.col(c).cast("int").alias(c) if c != "html" else F.col(c) for c in ("page_id", "html", "n_items", "n_translated")])


TRIES = [(1, 0, False), (1, 1, True), (1, 2, True), (2, 0, False), (2, 3, False), (2, 9, True), (3, 0, True)]
ENDED = [(1, 1, True, 1), (2, 3, False, 7), (3, 0, True, 0)]


@query(f"SELECT batch_id, attempt, ok, waited_seconds FROM {values(ENDED, 'batch_id, attempt, ok, waited_seconds')}")
def retried_batches(spark, sf_dir):
    """The attempt that ended each batch, with waits of 1, 2, 4 seconds before the next."""
    out = translation.retried(literals(spark, TRIES, "batch_id int, attempt int, ok boolean"))
    return out.withColumn("waited_seconds", F.col("waited_seconds").cast("int"))


HEALTH = [(1, "Healthy,Healthy", "Healthy"), (2, "Healthy,Degraded", "Degraded"), (3, "Degraded,Unhealthy", "Unhealthy"), (4, "Unhealthy", "Unhealthy")]


@query(f"SELECT id, health FROM {values([(h[0], h[2]) for h in HEALTH], 'id, health')}")
def health_cases(spark, sf_dir):
    out = None
    for i, parts, _ in HEALTH:
        one = translation.health(literals(spark, [(p,) for p in parts.split(",")], "status string")).select(F.lit(i).alias("id"), "health")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 3 AS texts_collected, 2 AS cache_hits, 12 AS total_chars_processed")
def service_counters(spark, sf_dir):
    """Counts taken while other actions run, summed over two frames, and gone after a reset."""
    counters = translation.ServiceCounters()
    schema = "text string, hit boolean"
    counters.counted(literals(spark, [("thrown away", True)], schema), texts_collected=F.count("*")).count()
    counters.reset()
    for rows in ([("four", True), ("five", False)], [("late", True)]):
        frame = counters.counted(literals(spark, rows, schema), texts_collected=F.count("*"), cache_hits=F.count_if("hit"), total_chars_processed=F.sum(F.char_length("text")))
        frame.count()
    seen = counters.snapshot()
    return literals(spark, [(seen["texts_collected"], seen["cache_hits"], seen["total_chars_processed"])], "texts_collected int, cache_hits int, total_chars_processed int")


# Settings and records.

SETTINGS = [
    ("enabled", "YES", None),
    ("enabled", "maybe", "not a boolean"),
    ("target_lang", "ZH", None),
    ("target_lang", "auto", "not a language code"),
    ("source_lang", "auto", None),
    ("api_url", "ftp://h.example", "not an http address"),
    ("api_url", " https://h.example/t ", None),
    ("max_requests_per_second", "0", "too small"),
    ("max_requests_per_second", "0.5", None),
    ("max_requests_per_second", "1000.5", "too large"),
    ("max_concurrent_requests", "100", None),
    ("max_concurrent_requests", "101", "too large"),
    ("batch_size", "99", "too small"),
    ("batch_size", "1e3", "not a number"),
    ("batch_timeout_secs", "300", None),
    ("local_cache_size", "10", None),
    ("cache_ttl_secs", "59", "too small"),
    ("cache_ttl_secs", "604801", "too large"),
    ("no_such_setting", "1", "unknown setting"),
]


@query(f"SELECT name, value, error FROM {values(SETTINGS, 'name, value, error')}")
def setting_checks(spark, sf_dir):
    return checked_settings(literals(spark, [s[:2] for s in SETTINGS], "name string, value string"))


EXAMPLE = """# bool
enabled = true
# lang
target_lang = "zh"
# source
source_lang = "auto"
# url
api_url = "http://localhost:1188/translate"
# 0 to 1000
max_requests_per_second = 5.0
# 1 to 100
max_concurrent_requests = 10
# 100 to 50000
batch_size = 9000
# 1 to 300
batch_timeout_secs = 30
# from 0
min_batch_chars = 2000
# bool
cache_enabled = true
# 10 to 100000
local_cache_size = 1000
# 60 to 604800
cache_ttl_secs = 3600
# bool
parallel_enabled = true
# bool
retry_enabled = true
# from 0
max_retry_attempts = 3
"""


@query(f"SELECT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM {values([(EXAMPLE,)], 'text').replace("AS t(", "AS v(")}) x WHERE line <> ''")
def example_settings(spark, sf_dir):
    """The lines of a settings file of the defaults."""
    return literals(spark, [(line,) for line in example().splitlines()], "line string")


RESPONSES = [
    (1, '{"status":"success","original_html":"<p>a","translated_html":"<p>A","title":"T","url":"u","translate_enabled":true,"target_lang":"zh"}'),
    (2, '{"status":"success","original_html":"<p>b","url":"v","translate_enabled":false}'),
    (3, '{"status":"error","url":"w","translate_enabled":false}'),
]


@query(f"SELECT id, response FROM {values(RESPONSES, 'id, response')}")
def page_responses(spark, sf_dir):
    rows = [(1, "u", "T", "<p>a", "<p>A", "zh"), (2, "v", None, "<p>b", None, "zh"), (3, "w", None, None, None, None)]
    return library.responses(literals(spark, rows, "id int, url string, title string, original_html string, translated_html string, target_lang string"))


@query("SELECT 'en' AS hint, 'zh' AS target UNION ALL SELECT 'zh', 'en'")
def target_languages(spark, sf_dir):
    rows = literals(spark, [("en",), ("zh",)], "hint string")
    return rows.select("hint", tf.target_language(F.col("hint")).alias("target"))
