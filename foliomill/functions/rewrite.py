"""Pages made self-contained: every reference of a tree is replaced by what it refers to."""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass, field, fields, replace
from urllib.parse import urldefrag

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.functions import css as css_rules
from foliomill.functions.html import Node, made, parse_html, serialize
from foliomill.functions.media import EVENT_ATTRIBUTES, EXTENSIONS, SIGNATURES
from foliomill.functions.url import UNJOINABLE, parse, resolve, split_data_url

# Fixed value: the picture of one clear pixel.
BLANK = (
    "data:image/png,"
    "%89PNG%0D%0A%1A%0A%00%00%00%0DIHDR%00%00%00%0D%00%00%00%0D%08%04%00%00%00%D8%E2%2C%F7%00%00%00%11IDATx%DAcd%C0%09%18G%A5%28%96%02%00%0A%F8%00%0E%CB%8A%EB%16%00%00%00%00IEND%AEB%60%82"
)
#: How deep frames, and noscript elements in one another, are followed; deeper ones stay as they are.
MAX_FRAMES, MAX_NOSCRIPTS = 4, 32
#: White space that separates the parts of a srcset.
_BLANKS = " \t\n\f\r"


@dataclass(frozen=True)
class Options:
    """What to leave out of a page, and how to write it."""

    no_audio: bool = False
    no_css: bool = False
    no_fonts: bool = False
    no_frames: bool = False
    no_images: bool = False
    no_js: bool = False
    no_video: bool = False
    isolate: bool = False
    unwrap_noscript: bool = False
    no_metadata: bool = True
    mhtml: bool = False
    base_url: str | None = None
    encoding: str | None = None


def with_options(options: Options, changes: dict[str, str] | None) -> Options:
    """Options with some of them changed by name; switches are on for ``true``, and an unknown name is an error."""
    kinds = {f.name: f.type for f in fields(Options)}
    return replace(options, **{k: v.strip().lower() == "true" if kinds[k] == "bool" else v for k, v in (changes or {}).items()})


@dataclass
class Asset:
    data: bytes
    url: str
    media_type: str = ""
    charset: str = ""


@dataclass
class Page:
    """The state of one rewriting: options, known assets by URL without fragment, and what was asked for."""

    options: Options = Options()
    assets: dict[str, Asset] = field(default_factory=dict)
    asked: dict[str, str] = field(default_factory=dict)
    depth: int = 0
    noscripts: int = 0

    def find(self, base: str, url: str, kind: str) -> Asset | None:
        whole = urldefrag(url)[0]
        if whole.startswith("data:"):
            media_type, charset, data = split_data_url(whole)
            return Asset(data, whole, media_type, charset)
        if whole.startswith("file:") and not base.startswith("file:"):
            return None
        self.asked.setdefault(whole, kind)
        return self.assets.get(whole)


def detected(data: bytes, url: str) -> str:
    found = next((k for prefix, k in SIGNATURES if data.startswith(prefix)), None)
    ending = re.sub(r"[?#].*", "", url).lower().rpartition(".")[2]
    return found or EXTENSIONS.get(ending, "application/octet-stream")


def data_url(asset: Asset, data: bytes | None = None, media_type: str | None = None, fragment: str = "") -> str:
    body = asset.data if data is None else data
    kind = media_type or asset.media_type or detected(body, asset.url)
    charset = asset.charset.strip()
    named = f";charset={charset}" if charset and charset.upper() != "US-ASCII" else ""
    return f"data:{kind}{named};base64,{base64.b64encode(body).decode()}" + (f"#{fragment}" if fragment else "")


def decoded(asset: Asset) -> str:
    try:
        return asset.data.decode(asset.charset or "utf-8", "replace")
    except LookupError:
        return asset.data.decode("utf-8", "replace")


def integrity_holds(data: bytes, value: str) -> bool:
    name, _, digest = value.partition("-")
    return name in ("sha256", "sha384", "sha512") and base64.b64encode(hashlib.new(name, data).digest()).decode() == digest


def embedded_css(page: Page, base: str, sheet: str, level: int = 0) -> str:
    """A sheet with everything in it embedded; imported sheets are followed to a fixed depth."""

    def reference(url: str, prop: str, importing: bool) -> str | None:
        absolute = resolve(base, url)
        fragment = urldefrag(absolute)[1]
        if not importing and page.options.no_images and css_rules.is_image_property(prop):
            return BLANK
        asset = page.find(base, absolute, "css" if importing else "url")
        if asset is None:
            return absolute if absolute.startswith("http") else None
        if importing and level < css_rules.MAX_IMPORTS:
            body = embedded_css(page, asset.url, decoded(asset), level + 1).encode()
            return data_url(asset, body, asset.media_type or "text/css", fragment)
        return data_url(asset, fragment=fragment)

    return css_rules.rewrite_css(sheet, reference, page.options.no_fonts)


def embed(page: Page, base: str, node: Node, name: str, value: str) -> None:
    """Replace an attribute's URL by the asset itself; without one, web URLs become absolute and others go."""
    absolute = resolve(base, value)
    fragment = urldefrag(absolute)[1]
    sheet = node.tag == "link" and "stylesheet" in (node.get("rel") or "").lower().split()
    asset = page.find(base, absolute, "css" if sheet else node.tag)
    if asset is None:
        node.set(name, absolute if absolute.startswith("http") else None)
        return
    if node.tag in ("link", "script"):
        wanted = node.get("integrity")
        node.set("integrity", None)
        if wanted and not integrity_holds(asset.data, wanted):
            return
    if sheet:
        node.set(name, data_url(asset, embedded_css(page, asset.url, decoded(asset)).encode()))
    elif node.tag in ("frame", "iframe"):
        inner = parse_html(decoded(asset))
        if page.depth < MAX_FRAMES:
            page.depth += 1
            walk(page, asset.url, inner)
            page.depth -= 1
        node.set(name, data_url(asset, serialize(inner).encode(), fragment=fragment))
        inner.release()
    elif node.tag == "script":
        kind = node.get("type") or "text/javascript"
        if kind in ("text/javascript", "application/javascript"):
            node.add(Node("text", text=decoded(asset).replace("</script>", "<\\/script>")))
            node.set(name, None)
        else:
            node.set(name, data_url(asset, media_type=kind, fragment=fragment))
    else:
        node.set(name, data_url(asset, fragment=fragment))


def srcset_parts(value: str) -> list[tuple[str, str]]:
    """(path, descriptor) of each candidate: paths end at ASCII white space or at commas that end them."""
    out: list[tuple[str, str]] = []
    at, size = 0, len(value)
    while at < size:
        while at < size and (value[at] in _BLANKS or value[at] == ","):
            at += 1
        start = at
        while at < size and value[at] not in _BLANKS:
            at += 1
        path = value[start:at]
        descriptor = ""
        if path.endswith(","):
            path = path.rstrip(",")
        else:
            start = at
            while at < size and value[at] != ",":
                at += 1
            descriptor = value[start:at].strip(_BLANKS)
        if path:
            out.append((path, descriptor))
    return out


_CANDIDATE = T.StructType([T.StructField("path", T.StringType()), T.StructField("descriptor", T.StringType())])


@F.pandas_udf(T.ArrayType(_CANDIDATE))
def srcset_candidates(value: pd.Series) -> pd.Series:
    """The candidates of a srcset attribute; none for a null."""
    return pd.Series([[{"path": p, "descriptor": d} for p, d in srcset_parts(v or "")] for v in value], dtype=object)


def embedded_srcset(page: Page, base: str, value: str) -> str:
    parts = []
    for path, descriptor in srcset_parts(value):
        absolute = resolve(base, path)
        asset = None if page.options.no_images else page.find(base, absolute, "image")
        new = BLANK if page.options.no_images else data_url(asset, fragment=urldefrag(absolute)[1]) if asset else absolute if absolute.startswith("http") else BLANK
        parts.append(f"{new} {descriptor}" if descriptor else new)
    return ", ".join(parts)


def _img(page: Page, base: str, n: Node) -> None:
    src, lazy = n.get("src") or "", n.get("data-src") or ""
    if page.options.no_images:
        for name in ("src", "data-src"):
            if n.get(name) is not None:
                n.set(name, BLANK)
    elif not src and not lazy:
        n.set("src", "")
    else:
        embed(page, base, n, "src", lazy or src)
    if n.get("srcset"):
        n.set("srcset", embedded_srcset(page, base, n.get("srcset")))


def _link(page: Page, base: str, n: Node) -> None:
    rel = (n.get("rel") or "").lower().split()
    href = n.get("href")
    if "icon" in rel or "apple-touch-icon" in rel:
        if href is not None:
            n.set("href", None) if page.options.no_images else embed(page, base, n, "href", href)
    elif "stylesheet" in rel:
        if page.options.no_css:
            n.set("href", None)
            n.set("integrity", None)
        elif href:
            embed(page, base, n, "href", href)
    elif "preload" in rel or "dns-prefetch" in rel:
        n.set("rel", None)
    elif href is not None:
        n.set("href", resolve(base, href))


def _script(page: Page, base: str, n: Node) -> None:
    if page.options.no_js:
        n.children = []
        n.set("src", None)
        n.set("integrity", None)
    elif n.get("src"):
        embed(page, base, n, "src", n.get("src"))


def _style(page: Page, base: str, n: Node) -> None:
    if page.options.no_css:
        n.children = []
    for c in n.children:
        if c.kind == "text":
            c.text = embedded_css(page, base, c.text)


def _source(page: Page, base: str, n: Node) -> None:
    parent = n.parent.tag if n.parent else ""
    if parent in ("audio", "video") and n.get("src"):
        drop = page.options.no_audio if parent == "audio" else page.options.no_video
        n.set("src", None) if drop else embed(page, base, n, "src", n.get("src"))
    if parent == "picture" and n.get("srcset"):
        n.set("srcset", BLANK if page.options.no_images else embedded_srcset(page, base, n.get("srcset")))


def _media(page: Page, base: str, n: Node) -> None:
    if n.get("src") is not None:
        drop = page.options.no_audio if n.tag == "audio" else page.options.no_video
        n.set("src", None) if drop else embed(page, base, n, "src", n.get("src"))
    if n.tag == "video" and n.get("poster"):
        n.set("poster", BLANK) if page.options.no_images else embed(page, base, n, "poster", n.get("poster"))


def _frame(page: Page, base: str, n: Node) -> None:
    if n.get("src") is None:
        return
    if page.options.no_frames:
        n.set("src", "")
    elif n.get("src").strip():
        embed(page, base, n, "src", n.get("src"))


def _anchor(page: Page, base: str, n: Node) -> None:
    href = n.get("href")
    if href is None:
        return
    if href.strip().startswith("javascript:"):
        if page.options.no_js:
            n.set("href", "javascript:;")
    elif not href.startswith("#") and parse(href) is None:
        absolute = resolve(base, href)
        n.set("href", absolute if absolute != UNJOINABLE or href else href)


def _noscript(page: Page, base: str, n: Node) -> None:
    if page.noscripts >= MAX_NOSCRIPTS:
        return
    page.noscripts += 1
    for c in [c for c in n.children if c.kind == "text"]:
        inner = parse_html(c.text)
        walk(page, base, inner)
        body = inner.child("html").child("body")
        head = inner.child("html").child("head")
        c.text = "".join(serialize(x) for x in [*(head.children if head else []), *(body.children if body else [])])
        inner.release()
    page.noscripts -= 1


def _svg_image(page: Page, base: str, n: Node) -> None:
    for name in ("href", "xlink:href"):
        if n.get(name) is not None:
            n.set(name, None) if page.options.no_images else embed(page, base, n, name, n.get(name))


def _svg_use(page: Page, base: str, n: Node) -> None:
    for name in ("href", "xlink:href"):
        value = n.get(name)
        if value is None or value.startswith("#"):
            continue
        if page.options.no_images:
            n.set(name, "")
            continue
        absolute = resolve(base, value)
        whole, fragment = urldefrag(absolute)
        asset = page.find(base, absolute, "image")
        if asset is None:
            n.set(name, absolute)
        elif (asset.media_type or detected(asset.data, asset.url)) == "image/svg+xml":
            tree = parse_html(decoded(asset))
            if fragment:
                symbol = next((s for s in tree.find("symbol") if s.get("id") == fragment), None) or made("symbol")
                n.add(symbol)
                n.set(name, f"#{fragment}")
            else:
                for svg in tree.find("svg")[:1]:
                    for c in list(svg.children):
                        n.add(c)
                n.set(name, None)
        else:
            n.set(name, data_url(asset, fragment=fragment))


def _simple(tag: str):
    def meta(page: Page, base: str, n: Node) -> None:
        if (n.get("http-equiv") or "").lower() in ("refresh", "location"):
            n.set("http-equiv", None)

    def base_(page: Page, base: str, n: Node) -> None:
        if base.startswith("http") and n.get("href") is not None:
            n.set("href", resolve(base, n.get("href")))

    def body(page: Page, base: str, n: Node) -> None:
        value = n.get("background")
        n.set("background", None)
        if value and not page.options.no_images:
            embed(page, base, n, "background", value)

    def form(page: Page, base: str, n: Node) -> None:
        if n.get("action") is not None:
            n.set("action", resolve(base, n.get("action")))

    def image_input(page: Page, base: str, n: Node) -> None:
        if (n.get("type") or "").lower() == "image" and n.get("src") is not None:
            if page.options.no_images or not n.get("src"):
                n.set("src", BLANK if n.get("src") else "")
            else:
                embed(page, base, n, "src", n.get("src"))

    def svg(page: Page, base: str, n: Node) -> None:
        if page.options.no_images:
            n.children = []

    return {"meta": meta, "base": base_, "body": body, "form": form, "input": image_input, "svg": svg}[tag]


#: Rules by tag; a caller may add its own.
HANDLERS = {
    "img": _img, "link": _link, "script": _script, "style": _style, "source": _source, "audio": _media, "video": _media,
    "frame": _frame, "iframe": _frame, "a": _anchor, "area": _anchor, "noscript": _noscript, "image": _svg_image, "use": _svg_use,
} | {tag: _simple(tag) for tag in ("meta", "base", "body", "form", "input", "svg")}
_EVENTS = frozenset(EVENT_ATTRIBUTES)


def walk(page: Page, base: str, node: Node) -> None:
    """Apply the rules from the top down; children are read after their parent has changed."""
    stack = [iter(list(node.children))]
    while stack:
        c = next(stack[-1], None)
        if c is None:
            stack.pop()
        elif c.kind == "element":
            if handler := HANDLERS.get(c.tag):
                handler(page, base, c)
            if c.get("style") is not None:
                c.set("style", None if page.options.no_css else embedded_css(page, base, c.get("style")))
            if page.options.no_js:
                c.attrs = [(n, v) for n, v in c.attrs if n.lower() not in _EVENTS]
            stack.append(iter(list(c.children)))


def csp(o: Options) -> str:
    parts = [
        (o.isolate, "default-src 'unsafe-eval' 'unsafe-inline' data:;"),
        (o.no_css, "style-src 'none';"),
        (o.no_fonts, "font-src 'none';"),
        (o.no_frames, "frame-src 'none'; child-src 'none';"),
        (o.no_js, "script-src 'none';"),
        (o.no_images, "img-src data:;"),
    ]
    return " ".join(text for on, text in parts if on)


def _meta(head: Node, value: str, *keys: tuple[str, str]) -> None:
    """Set the content of the first meta with an attribute of that value, or append one."""
    (name, wanted), *_ = keys
    found = next((m for m in head.find("meta") if (m.get(name) or "").lower() == wanted), None)
    if found:
        found.set("content", value)
    else:
        head.add(made("meta", **{name: wanted, "content": value}))


def base_of(document: Node, target: str, option: str | None) -> str:
    """The URL that references are resolved against."""
    if option:
        custom = parse(option)
        if custom is None:
            custom = resolve("file:///", option) if target.startswith("file:") else None
        if custom and (not custom.startswith("file:") or target.startswith("file:")):
            return custom
        return target
    first = next(iter(document.find("head", "base")), None)
    href = first.get("href") if first else None
    return resolve(target, href) if href else target


def set_charset(document: Node, charset: str) -> None:
    head = document.child("html").child("head")
    for m in head.find("meta"):
        if m.get("charset") is not None:
            m.set("charset", charset)
            return
        if (m.get("http-equiv") or "").lower() == "content-type":
            m.set("content", f"text/html;charset={charset}")
            return
    head.add(made("meta", charset=charset))


def save_page(html: str, url: str | None, options: Options = Options(), assets: dict[str, Asset] | None = None) -> tuple[str, str | None, dict[str, str]]:
    """The self-contained page, its title, and the URLs that it asked for with their kinds.

    Order matters: rules, then base, icon, robots and charset in the head, then
    the policy in front of them.
    """
    page = Page(options, assets or {})
    target = parse(url or "") or "data:text/html,"
    document = parse_html(html)
    base = base_of(document, target, options.base_url)
    walk(page, base, document)
    head = document.child("html").child("head")
    if options.base_url:
        first = next(iter(head.find("base")), None)
        if first:
            first.set("href", options.base_url)
        else:
            head.add(made("base", href=options.base_url))
    has_icon = any((n.get("rel") or "").strip().lower() in ("icon", "shortcut icon") for n in head.find("link"))
    if not options.no_images and base.startswith("http") and target.startswith("http") and not has_icon:
        icon = resolve(base, "/favicon.ico")
        if asset := page.find(base, icon, "image"):
            head.add(made("link", rel="icon", href=data_url(asset)))
    _meta(head, "none", ("name", "robots"))
    if options.encoding:
        set_charset(document, options.encoding)
    if policy := csp(options):
        head.add(made("meta", http_equiv="Content-Security-Policy", content=policy), 0)
    out = serialize(document)
    if options.unwrap_noscript:
        out = re.sub(r"<(/?noscript[^>]*)>", r"<!--\1-->", out)
    title = next((t.content() for t in document.find("head", "title") if t.content()), None)
    document.release()
    return out + ("" if out.endswith("\n") else "\n"), title, page.asked


# The frame of a page as MHTML.
MHTML_HEAD = (
    "MIME-Version: 1.0\r\n"
    'Content-Type: multipart/related; boundary="----=_NextPart_000_0000"\r\n\r\n------=_NextPart_000_0000\r\n'
    'Content-Type: text/html; charset="utf-8"\r\nContent-Location: http://example.com/\r\n\r\n'
)
MHTML_FOOT = "\r\n------=_NextPart_000_0000--\r\n"
