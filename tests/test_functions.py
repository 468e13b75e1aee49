"""URL, media, text, CSS and HTML rules on cases with known results."""

import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliomill.functions import css, rewrite
from foliomill.functions.html import parse_html, serialize
from foliomill.functions.url import parse, resolve, split_data_url

JOINS = [
    ("https://lake.example", "../shore/map.html", "https://lake.example/shore/map.html"),
    ("https://lake.example", "https://cdn.example/x.js", "https://cdn.example/x.js"),
    ("https://lake.example/shore/", "//hill.example/shore/pier.png", "https://hill.example/shore/pier.png"),
    ("https://lake.example/shore/map.html", "/boats/two.png", "https://lake.example/boats/two.png"),
    ("data:text/html;base64,PHA+", "//hill.example/", "data:,"),
    ("file:///srv/notes/index.html", "img\\one.png", "file:///srv/notes/img/one.png"),
    ("http://EXAMPLE.com:80/a/./b/../c", "", "http://example.com/a/c"),
    ("https://a.example/b", "c d?é", "https://a.example/c%20d?%C3%A9"),
]


@pytest.mark.parametrize(("base", "reference", "expected"), JOINS)
def test_resolve(base, reference, expected):
    assert resolve(base, reference) == expected


@pytest.mark.parametrize(("text", "ok"), [("http://h/x", True), (" data:text/html, ", True), ("//h/f", False), ("", False), ("ftp:server.example", True), ("http:///", False), ("/a:b", False)])
def test_parse(text, ok):
    assert (parse(text) is not None) == ok


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_resolving_never_fails_and_is_stable(text):
    joined = resolve("https://h.example/a/b?c", text)
    assert resolve("https://h.example/a/b?c", joined) == joined


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60))
def test_data_urls_round_trip(data):
    url = "data:text/css;charset=utf-8;base64," + base64.b64encode(data).decode()
    assert split_data_url(url) == ("text/css", "utf-8", data)


def test_broken_data_urls():
    assert split_data_url("data:text/css,i{top:%30}") == ("text/css", "", b"i{top:0}")
    assert split_data_url("data:;base64,***") == ("", "", b"") and split_data_url("https://x") == (None, None, None)


TREES = [
    ("<div><p>x</div>", "<html><head></head><body><div><p>x</p></div></body></html>"),
    ("<title>a&amp;b</title><p><b>bold<br><p>next</b> z", "<html><head><title>a&amp;b</title></head><body><p><b>bold<br></b></p><p><b>next</b> z</p></body></html>"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "<html><head></head><body><table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table></body></html>"),
    ("<ul><li>a<li>b</ul>", "<html><head></head><body><ul><li>a</li><li>b</li></ul></body></html>"),
    ("<noscript><img src=x></noscript>", "<html><head><noscript><img src=x></noscript></head><body></body></html>"),
    ("", "<html><head></head><body></body></html>"),
    ("<script>if(a<b){}</script>", "<html><head><script>if(a<b){}</script></head><body></body></html>"),
]


@pytest.mark.parametrize(("html", "expected"), TREES)
def test_trees(html, expected):
    assert serialize(parse_html(html)) == expected


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="<>/=\"' abpdiv!-&;trulscoe", max_size=60))
def test_parsing_never_fails(html):
    once = serialize(parse_html(html))
    assert once.startswith(("<html", "<!")) and "</html>" in once


def test_descendant_paths():
    tree = parse_html("<div><ul><li>a</li></ul></div><ul><li>b</li></ul>")
    assert [n.content() for n in tree.find("body", "ul", "li")] == ["a", "b"]
    assert [n.content() for n in tree.find("div", "li")] == ["a"]


def sheet(text, base="https://h.example/", **options):
    return rewrite.embedded_css(rewrite.Page(rewrite.Options(**options)), base, text)


def test_stylesheets():
    assert sheet("@import 'data:text/css,i{}';") == '@import "data:text/css;base64,aXt9";'
    assert sheet("i{mask: url(#shape)}") == "i{mask: url(#shape)}"
    assert sheet("i{margin: -0.50px +7% .250em 3.0}") == "i{margin: -0.5px +7% 0.25em 3}"
    assert sheet(".w\\/2:focus {top: 0}") == ".w\\/2:focus {top: 0}" and sheet("\t\n") == ""
    assert sheet("@font-face { src: url(own.woff) }i{}", no_fonts=True) == " i{}"
    assert sheet("a{background: url(x.png)}") == 'a{background: url("https://h.example/x.png")}'
    assert sheet("a{background: url(x.png)}", no_images=True) == f'a{{background: url("{rewrite.BLANK}")}}'
    assert sheet("a{background: url(x.png)}", base="file:///t/") == "a{background: url()}"
    assert sheet('[title^="lake"] > i { /* note */ }') == '[title^="lake"] > i { /* note */ }'
    assert css.number("+0.500") == "+0.5" and css.string('a"b\n') == '"a\\"b\\a "'


def saved(html, url="https://h.example/d/", assets=None, **options):
    return rewrite.save_page(html, url, rewrite.Options(**options), assets)[0]


def test_srcset():
    assert rewrite.srcset_parts("s.png 1x, m.png 2x") == [("s.png", "1x"), ("m.png", "2x")]
    assert rewrite.srcset_parts("a.png 100h") == [("a.png", "100h")] and rewrite.srcset_parts("a.png b.png") == [("a.png", "b.png")]
    assert rewrite.srcset_parts("a,b.png,\n c.png 2x,") == [("a,b.png", ""), ("c.png", "2x")] and rewrite.srcset_parts(" , ") == []


def test_saving():
    png = rewrite.Asset(b"PNG", "https://h.example/d/i.png", "image/png")
    out = saved("<img src=i.png><a href=/p>x</a><a href=#t>y</a>", assets={"https://h.example/d/i.png": png})
    assert '<img src="data:image/png;base64,UE5H">' in out and 'href="https://h.example/p"' in out and 'href="#t"' in out and out.endswith("\n")
    assert '<meta name="robots" content="none"></meta>' in out
    assert 'src="https://h.example/d/gone.png"' in saved("<img src=gone.png>")
    assert "<script></script>" in saved("<script src=a.js>x()</script><p onclick=f() onmade=g()>", no_js=True) and 'onmade="g()"' in saved("<p onclick=f() onmade=g()>", no_js=True)
    assert "onclick" not in saved("<p onclick=f()>", no_js=True)
    assert saved("<iframe src=x></iframe>", no_frames=True).count('src=""') == 1
    assert '<meta http-equiv="Content-Security-Policy" content="style-src \'none\';"></meta>' in saved("<p>", no_css=True)
    script = rewrite.Asset(b"x='</script>'", "https://h.example/d/a.js", "text/javascript")
    assert "<script>x='<\\/script>'</script>" in saved("<script src=a.js integrity=''></script>", assets={"https://h.example/d/a.js": script})
    assert 'src="a.js"' in saved("<script src=a.js integrity=sha256-no></script>", assets={"https://h.example/d/a.js": script})
    frame = rewrite.Asset(b"<iframe src=f.html></iframe>", "https://h.example/d/f.html", "text/html")
    assert "data:text/html;base64," in saved("<iframe src=f.html></iframe>", assets={"https://h.example/d/f.html": frame})  # ends, although it holds itself
    assert "<!--noscript-->" in saved("<body><noscript>n</noscript>", unwrap_noscript=True)


def test_encodings():
    from foliomill.functions.encoding import codec, decode_page

    assert (codec("GB2312"), codec("iso-8859-1"), codec("nonsense"), codec("")) == ("gbk", "cp1252", None, None)
    assert decode_page("<meta charset=gb2312>你好".encode("gbk")) == ("<meta charset=gb2312>你好", "gb2312")
    assert decode_page(b"\xff", None) == ("�", "utf-8") and decode_page(None) == ("", "utf-8")
    assert decode_page("é".encode("latin-1"), "latin1") == ("é", "latin1")
