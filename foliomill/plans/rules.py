"""Literal pages, one or more for each rule, with what must come out; the DuckDB twins are these expected values."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions import rewrite
from foliomill.operators import saving
from foliomill.plans.registry import literals, query, values

BASE = "https://h.example/d/p.html"
RED = "b{color:red}"
SHEET = "@import 's.css';u{background:url(i.png)}"
#: What the references of the pages are: name under the folder of ``BASE`` or URL, content, media type, charset.
ASSETS = [
    ("i.png", "PNG!", "image/png", ""),
    ("s.css", RED, "text/css", ""),
    ("t.css", SHEET, "text/css", ""),
    ("k.js", "if(1){x='</script>'}", "text/javascript", ""),
    ("m.js", "export {}", "text/javascript", ""),
    ("f.html", "<p>in<img src=i.png>", "text/html", "utf-8"),
    ("v.svg", "<svg><defs><symbol id='a'><g></g></symbol></defs><path></path></svg>", "image/svg+xml", ""),
    ("a.mp3", "MP3", "audio/mpeg", ""),
    ("v.mp4", "MP4", "video/mp4", ""),
    ("https://icon.example/favicon.ico", "ICO", "image/x-icon", ""),
]


def _data(kind: str, content: str) -> str:
    return f"data:{kind};base64," + base64.b64encode(content.encode()).decode()


_PNG, _RED = _data("image/png", "PNG!"), _data("text/css", RED)
#: Short names in the pages and in what is expected.
NAMES = {
    "{png}": _PNG,
    "{red}": _RED,
    "{importing}": _data("text/css", f'@import "{_RED}";u{{background:url("{_PNG}")}}'),
    "{as_it_is}": _data("text/css", SHEET),
    "{frame}": _data("text/html;charset=utf-8", f'<html><head></head><body><p>in<img src="{_PNG}"></p></body></html>'),
    "{sound}": _data("audio/mpeg", "MP3"),
    "{film}": _data("video/mp4", "MP4"),
    "{icon}": _data("image/x-icon", "ICO"),
    "{digest}": base64.b64encode(hashlib.sha256(RED.encode()).digest()).decode(),
    "{blank}": rewrite.BLANK,
    "{none}": '<meta name="robots" content="none"></meta>',
}

# fmt: off
#: Rule, options, URL (default ``BASE``), page, and what is inside <html> afterwards.
ELEMENT_RULES = [
    ('E1', {}, '', '<p><img src=i.png>', '<head>{none}</head><body><p><img src="{png}"></p></body>'),
    ('E1', {}, '', '<p><img src=small.png data-src=i.png>', '<head>{none}</head><body><p><img src="{png}" data-src="i.png"></p></body>'),
    ('E1', {}, '', '<p><img src=/gone.png>', '<head>{none}</head><body><p><img src="https://h.example/gone.png"></p></body>'),
    ('E1', {}, '', '<p><img alt=x>', '<head>{none}</head><body><p><img alt="x" src=""></p></body>'),
    ('E1', {}, '', '<p><img src=i.png#part>', '<head>{none}</head><body><p><img src="{png}#part"></p></body>'),
    ('E1', {}, 'file:///t/p.html', '<p><img src=i.png>', '<head>{none}</head><body><p><img></p></body>'),
    ('E1', {'no_images': 'true'}, '', '<p><img src="" data-src=i.png>', '<head><meta http-equiv="Content-Security-Policy" content="img-src data:;"></meta>{none}</head><body><p><img src="{blank}" data-src="{blank}"></p></body>'),
    ('E2', {}, '', '<p><img src=i.png srcset="i.png 1x, /gone.png 2x">', '<head>{none}</head><body><p><img src="{png}" srcset="{png} 1x, https://h.example/gone.png 2x"></p></body>'),
    ('E2', {'no_images': 'true'}, '', '<p><img src=i.png srcset="i.png 1x, /gone.png 2x">', '<head><meta http-equiv="Content-Security-Policy" content="img-src data:;"></meta>{none}</head><body><p><img src="{blank}" srcset="{blank} 1x, {blank} 2x"></p></body>'),
    ('E3', {}, '', '<link rel=icon href=i.png>', '<head><link rel="icon" href="{png}">{none}</head><body></body>'),
    ('E3', {'no_images': 'true'}, '', '<link rel="apple-touch-icon" href=i.png>', '<head><meta http-equiv="Content-Security-Policy" content="img-src data:;"></meta><link rel="apple-touch-icon">{none}</head><body></body>'),
    ('E3', {}, '', '<link rel=stylesheet href=s.css>', '<head><link rel="stylesheet" href="{red}">{none}</head><body></body>'),
    ('E3', {'no_css': 'true'}, '', '<link rel=stylesheet href=s.css integrity=sha256-x>', '<head><meta http-equiv="Content-Security-Policy" content="style-src \'none\';"></meta><link rel="stylesheet">{none}</head><body></body>'),
    ('E3', {}, '', '<link rel=preload href=s.css><link rel=dns-prefetch href=//x.example>', '<head><link href="s.css"><link href="//x.example">{none}</head><body></body>'),
    ('E3', {}, '', '<link rel=next href=two.html>', '<head><link rel="next" href="https://h.example/d/two.html">{none}</head><body></body>'),
    ('E0', {}, '', '<link rel=stylesheet href=s.css integrity="sha256-wrong">', '<head><link rel="stylesheet" href="s.css">{none}</head><body></body>'),
    ('E0', {}, '', '<script src=k.js integrity=""></script>', "<head><script>if(1){x='<\\/script>'}</script>{none}</head><body></body>"),
    ('E0', {}, '', '<script type=module src=m.js></script>', '<head><script type="module" src="data:module;base64,ZXhwb3J0IHt9"></script>{none}</head><body></body>'),
    ('E0', {}, '', '<script src=/gone.js></script>', '<head><script src="https://h.example/gone.js"></script>{none}</head><body></body>'),
    ('E0', {}, 'file:///t/p.html', '<script src=k.js></script>', '<head><script></script>{none}</head><body></body>'),
    ('E4', {}, '', '<meta http-equiv=Refresh content="1;url=x"><meta http-equiv=x-ua content=y>', '<head><meta content="1;url=x"><meta http-equiv="x-ua" content="y">{none}</head><body></body>'),
    ('E5', {}, '', '<base href=sub/><p><a href=q>l</a>', '<head><base href="https://h.example/d/sub/sub/">{none}</head><body><p><a href="https://h.example/d/sub/q">l</a></p></body>'),
    ('E6', {}, '', '<body background=i.png><p>x', '<head>{none}</head><body background="{png}"><p>x</p></body>'),
    ('E6', {}, '', '<body background=/gone.png><p>x', '<head>{none}</head><body background="https://h.example/gone.png"><p>x</p></body>'),
    ('E6', {'no_images': 'true'}, '', '<body background=i.png><p>x', '<head><meta http-equiv="Content-Security-Policy" content="img-src data:;"></meta>{none}</head><body><p>x</p></body>'),
    ('E7', {}, '', '<script src=k.js></script>', "<head><script>if(1){x='<\\/script>'}</script>{none}</head><body></body>"),
    ('E7', {'no_js': 'true'}, '', '<script src=k.js integrity=sha256-x>var a</script>', '<head><meta http-equiv="Content-Security-Policy" content="script-src \'none\';"></meta><script></script>{none}</head><body></body>'),
    ('E8', {}, '', '<style>p{background:url(i.png)}</style>', '<head><style>p{background:url("{png}")}</style>{none}</head><body></body>'),
    ('E8', {'no_css': 'true'}, '', '<style>p{color:red}</style>', '<head><meta http-equiv="Content-Security-Policy" content="style-src \'none\';"></meta><style></style>{none}</head><body></body>'),
    ('E9', {}, '', '<p style="background:url(i.png)">x', '<head>{none}</head><body><p style="background:url(&quot;{png}&quot;)">x</p></body>'),
    ('E9', {'no_css': 'true'}, '', '<p style="color:red">x', '<head><meta http-equiv="Content-Security-Policy" content="style-src \'none\';"></meta>{none}</head><body><p>x</p></body>'),
    ('E10', {'no_js': 'true'}, '', '<p onclick=f() onmade=g() OnLoad=h()>x', '<head><meta http-equiv="Content-Security-Policy" content="script-src \'none\';"></meta>{none}</head><body><p onmade="g()">x</p></body>'),
    ('E12', {}, '', '<form><input type=image src=i.png><input type=text src=i.png>', '<head>{none}</head><body><form><input type="image" src="{png}"><input type="text" src="i.png"></form></body>'),
    ('E12', {}, '', '<p><input type=IMAGE src="">', '<head>{none}</head><body><p><input type="IMAGE" src=""></p></body>'),
    ('E12', {'no_images': 'true'}, '', '<p><input type=image src=i.png>', '<head><meta http-equiv="Content-Security-Policy" content="img-src data:;"></meta>{none}</head><body><p><input type="image" src="{blank}"></p></body>'),
    ('E13', {}, '', '<svg><path></path></svg>', '<head>{none}</head><body><svg><path></path></svg></body>'),
    ('E13', {'no_images': 'true'}, '', '<svg><path></path></svg>', '<head><meta http-equiv="Content-Security-Policy" content="img-src data:;"></meta>{none}</head><body><svg></svg></body>'),
    ('E14', {}, '', '<svg><image href=i.png xlink:href=i.png></image></svg>', '<head>{none}</head><body><svg><image href="{png}" xlink:href="{png}"></image></svg></body>'),
    ('E14', {'no_images': 'true'}, '', '<svg><image href=i.png></image></svg>', '<head><meta http-equiv="Content-Security-Policy" content="img-src data:;"></meta>{none}</head><body><svg></svg></body>'),
    ('E15', {}, '', '<svg><use href=v.svg#a></use></svg>', '<head>{none}</head><body><svg><use href="#a"><symbol id="a"><g></g></symbol></use></svg></body>'),
    ('E15', {}, '', '<svg><use href=v.svg#none></use></svg>', '<head>{none}</head><body><svg><use href="#none"><symbol></symbol></use></svg></body>'),
    ('E15', {}, '', '<svg><use href=v.svg></use></svg>', '<head>{none}</head><body><svg><use><defs><symbol id="a"><g></g></symbol></defs><path></path></use></svg></body>'),
    ('E15', {}, '', '<svg><use href=#own></use></svg>', '<head>{none}</head><body><svg><use href="#own"></use></svg></body>'),
    ('E15', {}, '', '<svg><use href=i.png></use></svg>', '<head>{none}</head><body><svg><use href="{png}"></use></svg></body>'),
    ('E15', {}, '', '<svg><use href=/gone.svg#a></use></svg>', '<head>{none}</head><body><svg><use href="https://h.example/gone.svg#a"></use></svg></body>'),
    ('E16', {}, '', '<audio><source src=a.mp3></audio><p><source src=a.mp3>', '<head>{none}</head><body><audio><source src="{sound}"></audio><p><source src="a.mp3"></p></body>'),
    ('E16', {}, '', '<picture><source srcset="i.png 2x" src=i.png></picture>', '<head>{none}</head><body><picture><source srcset="{png} 2x" src="i.png"></picture></body>'),
    ('E16', {'no_video': 'true'}, '', '<video><source src=v.mp4></video>', '<head>{none}</head><body><video><source></video></body>'),
    ('E16', {'no_images': 'true'}, '', '<picture><source srcset="i.png 2x"></picture>', '<head><meta http-equiv="Content-Security-Policy" content="img-src data:;"></meta>{none}</head><body><picture><source srcset="{blank}"></picture></body>'),
    ('E17', {}, '', '<form action=go?x=1></form>', '<head>{none}</head><body><form action="https://h.example/d/go?x=1"></form></body>'),
    ('E18', {}, '', '<iframe src=f.html></iframe>', '<head>{none}</head><body><iframe src="{frame}"></iframe></body>'),
    ('E18', {}, '', '<iframe src=" "></iframe>', '<head>{none}</head><body><iframe src=" "></iframe></body>'),
    ('E18', {'no_frames': 'true'}, '', '<iframe src=f.html></iframe>', '<head><meta http-equiv="Content-Security-Policy" content="frame-src \'none\'; child-src \'none\';"></meta>{none}</head><body><iframe src=""></iframe></body>'),
    ('E18', {}, '', '<frameset><frame src=f.html></frameset>', '<head>{none}</head><frameset><frame src="{frame}"></frame></frameset>'),
    ('E19', {}, '', '<audio src=a.mp3></audio>', '<head>{none}</head><body><audio src="{sound}"></audio></body>'),
    ('E19', {'no_audio': 'true'}, '', '<audio src=a.mp3></audio>', '<head>{none}</head><body><audio></audio></body>'),
    ('E20', {}, '', '<video src=v.mp4 poster=i.png></video>', '<head>{none}</head><body><video src="{film}" poster="{png}"></video></body>'),
    ('E20', {'no_video': 'true', 'no_images': 'true'}, '', '<video src=v.mp4 poster=i.png></video>', '<head><meta http-equiv="Content-Security-Policy" content="img-src data:;"></meta>{none}</head><body><video poster="{blank}"></video></body>'),
    ('E21', {}, '', '<p><a href=../q>1</a><a href=#t>2</a><a href=mailto:x@y.example>3</a><a href=javascript:f()>4</a>', '<head>{none}</head><body><p><a href="https://h.example/q">1</a><a href="#t">2</a><a href="mailto:x@y.example">3</a><a href="javascript:f()">4</a></p></body>'),
    ('E21', {'no_js': 'true'}, '', '<map><area href=" javascript:f()"></map>', '<head><meta http-equiv="Content-Security-Policy" content="script-src \'none\';"></meta>{none}</head><body><map><area href="javascript:;"></map></body>'),
    ('E22', {}, '', '<body><noscript><img src=i.png></noscript>', '<head>{none}</head><body><noscript><img src="{png}"></noscript></body>'),
    ('E22', {'unwrap_noscript': 'true'}, '', '<body><noscript>plain</noscript>', '<head>{none}</head><body><!--noscript-->plain<!--/noscript--></body>'),
    ('E22', {}, '', '<body><noscript><p>a<noscript><img src=i.png></noscript></noscript>', '<head>{none}</head><body><noscript><p>a<noscript><img src="{png}"></noscript></p></noscript></body>'),
    ('E3', {}, '', '<link rel="alternate stylesheet" href=t.css>', '<head><link rel="alternate stylesheet" href="{importing}">{none}</head><body></body>'),
    ('E0', {}, '', '<link rel=stylesheet href=s.css integrity="sha256-{digest}">', '<head><link rel="stylesheet" href="{red}">{none}</head><body></body>'),
]

#: The same for style sheets.
SHEET_RULES = [
    ('C1', {}, '', '<style>a{margin:1.50px -0.5em +2.0}/* c */ .x\\:y>b~c{}</style>', '<head><style>a{margin:1.5px -0.5em +2}/* c */ .x\\:y>b~c{}</style>{none}</head><body></body>'),
    ('C1', {'no_fonts': 'true'}, '', '<style>@font-face{src:url(f.woff)}b{color:red}</style>', '<head><meta http-equiv="Content-Security-Policy" content="font-src \'none\';"></meta><style>b{color:red}</style>{none}</head><body></body>'),
    ('C1', {}, '', '<style>  </style>', '<head><style></style>{none}</head><body></body>'),
    ('C2', {}, '', '<style>@import "t.css";</style>', '<head><style>@import "{importing}";</style>{none}</head><body></body>'),
    ('C2', {}, '', '<style>@import url(s.css);</style>', '<head><style>@import url("{red}");</style>{none}</head><body></body>'),
    ('C2', {}, '', '<style>@import url("s.css");</style>', '<head><style>@import url("{red}");</style>{none}</head><body></body>'),
    ('C2', {}, '', '<style>@import "/gone.css";</style>', '<head><style>@import "https://h.example/gone.css";</style>{none}</head><body></body>'),
    ('C3', {}, '', '<style>a{x:url();y:url(#f);z:url(/gone.png)}</style>', '<head><style>a{x:url();y:url(#f);z:url("https://h.example/gone.png")}</style>{none}</head><body></body>'),
    ('C3', {'no_images': 'true'}, '', '<style>a{background-image:url(i.png);src:url(i.png)}</style>', '<head><meta http-equiv="Content-Security-Policy" content="img-src data:;"></meta><style>a{background-image:url("{blank}");src:url("{png}")}</style>{none}</head><body></body>'),
    ('C3', {}, '', '<style>a{background:url(i.png#f)}</style>', '<head><style>a{background:url("{png}#f")}</style>{none}</head><body></body>'),
    ('C5', {}, '', '<style>a::before{content:\'it\\\'s "q" \\41 \'}</style>', '<head><style>a::before{content:"it\'s \\"q\\" A"}</style>{none}</head><body></body>'),
    ('C2', {}, '', '<style>@import url("t.css");</style>', '<head><style>@import url("{as_it_is}");</style>{none}</head><body></body>'),
    ('C2', {}, '', "<style>@import 't.css' print; p{color:red}</style>", '<head><style>@import "{importing}" print; p{color:red}</style>{none}</head><body></body>'),
]

#: The same for what is done to the document as a whole.
DOCUMENT_RULES = [
    ('J1', {'base_url': 'https://b.example/x/', 'encoding': 'gbk'}, '', '<title>T</title><p><a href=q>l</a>', '<head><title>T</title><base href="https://b.example/x/"></base>{none}<meta charset="gbk"></meta></head><body><p><a href="https://b.example/x/q">l</a></p></body>'),
    ('J2', {}, '', '<meta name=ROBOTS content=index><p>x', '<head><meta name="ROBOTS" content="none"></head><body><p>x</p></body>'),
    ('J4', {'base_url': 'sub/'}, '', '<p><a href=q>l</a>', '<head><base href="sub/"></base>{none}</head><body><p><a href="https://h.example/d/q">l</a></p></body>'),
    ('J4', {'base_url': 'https://b.example/'}, '', '<base href=old/><p><a href=q>l</a>', '<head><base href="https://b.example/">{none}</head><body><p><a href="https://b.example/q">l</a></p></body>'),
    ('J6', {}, 'https://icon.example/', '<p>x', '<head><link rel="icon" href="{icon}"></link>{none}</head><body><p>x</p></body>'),
    ('J6', {}, 'https://icon.example/', '<link rel="shortcut icon" href=/gone.png><p>x', '<head><link rel="shortcut icon" href="https://icon.example/gone.png">{none}</head><body><p>x</p></body>'),
    ('J6', {'no_images': 'true'}, 'https://icon.example/', '<p>x', '<head><meta http-equiv="Content-Security-Policy" content="img-src data:;"></meta>{none}</head><body><p>x</p></body>'),
    ('M7', {'encoding': 'utf-8'}, '', '<meta charset=gb2312><p>x', '<head><meta charset="utf-8">{none}</head><body><p>x</p></body>'),
    ('M7', {'encoding': 'utf-8'}, '', '<meta http-equiv=Content-Type content="text/html; charset=x"><p>x', '<head><meta http-equiv="Content-Type" content="text/html;charset=utf-8">{none}</head><body><p>x</p></body>'),
    ('M7', {'encoding': 'utf-8'}, '', '<p>x', '<head>{none}<meta charset="utf-8"></meta></head><body><p>x</p></body>'),
    ('D8', {'isolate': 'true', 'no_fonts': 'true'}, '', '<p>x', '<head><meta http-equiv="Content-Security-Policy" content="default-src \'unsafe-eval\' \'unsafe-inline\' data:; font-src \'none\';"></meta>{none}</head><body><p>x</p></body>'),
]
# fmt: on


def _full(text: str) -> str:
    for name, value in NAMES.items():
        text = text.replace(name, value)
    return text


def _expected(rules: list[tuple]) -> str:
    rows = [(i, r[0], f"<html>{_full(r[4])}</html>\n") for i, r in enumerate(rules)]
    return f"SELECT id, rule, html, NULL::VARCHAR AS error FROM {values(rows, 'id, rule, html')}"


def _saved(spark, rules: list[tuple]) -> DataFrame:
    rows = [(i, r[0], r[2] or BASE, _full(r[3]), r[1]) for i, r in enumerate(rules)]
    pages = literals(spark, rows, "page_id bigint, rule string, url string, html string, options map<string,string>")
    folder = BASE.rpartition("/")[0] + "/"
    known = [(u if "://" in u else folder + u, None, c.encode(), kind, charset) for u, c, kind, charset in ASSETS]
    assets = literals(spark, known, "url_key string, final_url string, bytes binary, media_type string, charset string")
    out = saving.saved_pages(spark, pages, assets)
    return out.join(pages.select("page_id", "rule"), "page_id").select(F.col("page_id").cast("int").alias("id"), "rule", "html", "error")


@query(_expected(ELEMENT_RULES))
def element_rules(spark, sf_dir):
    """Every rule for elements and attributes, with assets from a table and options of each page."""
    return _saved(spark, ELEMENT_RULES)


@query(_expected(SHEET_RULES))
def sheet_rules(spark, sf_dir):
    """Imports, url(), numbers, strings and fonts of style sheets."""
    return _saved(spark, SHEET_RULES)


@query(_expected(DOCUMENT_RULES))
def document_rules(spark, sf_dir):
    """Base, icon, robots, charset and policy, in the order in which they come."""
    return _saved(spark, DOCUMENT_RULES)
