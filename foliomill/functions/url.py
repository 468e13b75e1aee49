"""URL functions.  Joining follows the WHATWG rules and is an Arrow UDF; the rest are native columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNJOINABLE = "data:,"
_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21", "file": ""}
_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.\-]*):(.*)$", re.DOTALL)
_SPLIT = re.compile(r"^([^?#]*)(\?[^#]*)?(#.*)?$", re.DOTALL)


def _escape(text: str, extra: str) -> str:
    return "".join("".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) if c <= "\x1f" or c > "~" or c in extra else c for c in text)


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, part in enumerate(parts):
        plain = part.lower().replace("%2e", ".")
        last = i == len(parts) - 1
        if plain == "..":
            if len(out) > 1:
                out.pop()
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(part)
    return "/".join(out)


def _host(authority: str, scheme: str) -> str | None:
    """Credentials, host and port in serialised form; None if the host is missing or can't be one."""
    login, at, rest = authority.rpartition("@")
    m = re.match(r"^(\[[0-9A-Fa-f:.]+\]|[^:]*)(?::([0-9]*))?$", rest)
    if not m or (m[1] == "" and scheme != "file") or re.search(r"[\s<>^|%\\#?@]", m[1]):
        return None
    host = m[1].lower()
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            return None
    port = m[2] or ""
    if port and int(port) > 65535:
        return None
    port = str(int(port)) if port else ""
    shown = f":{port}" if port and port != _PORTS.get(scheme) else ""
    user = _escape(login, ' "<>`#?{}/[]^|;=') if at else ""
    return (f"{user}@" if user.strip(":") else "") + host + shown


def _tail(rest: str, special: bool) -> tuple[str, str, str]:
    path, query, fragment = _SPLIT.match(rest).groups()
    if special:
        path = path.replace("\\", "/")
    query = "" if query is None else "?" + _escape(query[1:], " \"#<>" + ("'" if special else ""))
    return _escape(path, ' "<>`{}^'), query, "" if fragment is None else "#" + _escape(fragment[1:], ' "<>`')


def _clean(text: str) -> str:
    return re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))


def parse(text: str, base: str | None = None) -> str | None:
    """The serialised URL of ``text``, joined to an absolute ``base``; None if it isn't one."""
    text = _clean(text)
    found = _SCHEME.match(text)
    b = _SCHEME.match(base) if base else None
    if found:
        scheme, rest = found[1].lower(), found[2]
        special = scheme in _PORTS
        slashes = re.match(r"^[/\\]*" if special else r"^/*", rest)[0]
        if special and b and b[1].lower() == scheme and len(slashes) < 2 and scheme != "file":
            return parse(rest, base)
        if not special:
            if rest.startswith("//"):
                authority, path = re.match(r"^//([^/?#]*)(.*)$", rest, re.DOTALL).groups()
                path, query, fragment = _tail(path, False)
                return f"{scheme}://{authority}{_dots(path) if path else ''}{query}{fragment}"
            path, query, fragment = _SPLIT.match(rest).groups()
            path = _dots(path) if path.startswith("/") else path
            return f"{scheme}:{_escape(path, '')}{_escape(query or '', ' ') }{_escape(fragment or '', ' ')}"
        if scheme == "file" and len(slashes) < 2:
            rest = "//" + ("" if slashes else "/") + rest
            slashes = "//"
        authority, path = re.match(r"^([^/\\?#]*)(.*)$", rest[2 if scheme == "file" else len(slashes) :], re.DOTALL).groups()
        host = _host(authority, scheme)
        if host is None:
            return None
        path, query, fragment = _tail(path, True)
        return f"{scheme}://{'' if scheme == 'file' and host == 'localhost' else host}{_dots(path or '/')}{query}{fragment}"
    if not b:
        return None
    scheme, special = b[1].lower(), b[1].lower() in _PORTS
    path_b, query_b, _ = _SPLIT.match(b[2]).groups()
    query_b = query_b or ""
    if text.startswith("#"):
        return f"{scheme}:{path_b}{query_b}{_tail(text, special)[2]}"
    if not path_b.startswith("/"):
        return None
    authority, root = re.match(r"^(//[^/]*)?(.*)$", path_b, re.DOTALL).groups()
    authority = authority or ""
    if re.match(r"^[/\\]{2}" if special else r"^//", text):
        return parse(f"{scheme}:{text}")
    path, query, fragment = _tail(text, special)
    if path == "":
        return f"{scheme}:{authority}{root}{query or query_b}{fragment}"
    if not path.startswith("/"):
        path = root.rpartition("/")[0] + "/" + path
    return f"{scheme}:{authority}{_dots(path)}{query}{fragment}"


def resolve(base: str | None, reference: str | None) -> str | None:
    """``reference`` as an absolute URL seen from ``base``; ``data:,`` if they can't be joined, null for a null."""
    if reference is None:
        return None
    return parse(reference, parse(base or "")) or UNJOINABLE


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([resolve(b, r) for b, r in zip(base, reference, strict=True)], dtype=object)


def clean_url(url: Column) -> Column:
    """Without the fragment."""
    return F.regexp_replace(url, r"(?s)#.*\z", "")


def referer_url(url: Column) -> Column:
    """Without the fragment and credentials."""
    return F.regexp_replace(clean_url(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/?#@]*@", "$1")


def has_protocol(text: Column) -> Column:
    """Whether a text is an absolute URL; http and the like need a host."""
    t = F.regexp_replace(text, r"^[\x00-\x20]+", "")
    web = t.rlike(r"(?i)^(https?|ftp|wss?):")
    return F.when(web, t.rlike(r"(?i)^(https?|ftp|wss?):[/\\]*[^/\\?#\s]")).otherwise(t.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """The host in lower case, without credentials and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def domain_suffixes(domain: Column) -> Column:
    """The domain, each of its ends after a dot, and the empty text: what a pattern can be equal to after its own dot."""
    parts = F.split(F.lower(F.regexp_replace(domain, r"\.$", "")), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.array_distinct(F.concat(ends, F.array(F.lit(""))))


def bare_pattern(pattern: Column) -> Column:
    """A domain pattern without the dots around it, in lower case."""
    return F.regexp_replace(F.lower(pattern), r"^\.|\.$", "")


def within_domain(domain: Column, pattern: Column) -> Column:
    """Label by label from the right: ``.x`` matches x and all below it, ``x`` itself only, ``.`` everything, the empty pattern nothing."""
    d, p = F.lower(F.regexp_replace(domain, r"\.$", "")), F.lower(F.regexp_replace(pattern, r"\.$", ""))
    bare = F.regexp_replace(p, r"^\.", "")
    below = (d == bare) | F.endswith(d, F.concat(F.lit("."), bare))
    return F.when(pattern == "", False).when(pattern == ".", True).when(p.startswith("."), below).otherwise(d == p)


def is_expired(expires: Column, now: Column) -> Column:
    """A cookie's expiry in seconds; 0 never comes."""
    return (expires != 0) & (expires < now)


def encode_component(url: Column) -> Column:
    """Percent-encoding of controls, blanks, all beyond ASCII and the characters that structure a URL; ``% ~ | \\ ^ { }`` stay."""
    out = F.replace(F.replace(F.url_encode(url), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    for code, char in (("%7E", "~"), ("%7C", "|"), ("%5C", "\\"), ("%5E", "^"), ("%7B", "{"), ("%7D", "}"), ("%25", "%")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def skips_link(href: Column) -> Column:
    """Links that stay as they are: empty, or with one of these beginnings, in lower case."""
    return (href == "") | href.rlike("^(#|javascript:|mailto:|tel:|data:|blob:)")


def proxy_link(absolute: Column, prefix: str = "/website/") -> Column:
    """The path of a web link on a proxy; null for other schemes."""
    return F.when(scheme(absolute).isin("http", "https"), F.concat(F.lit(prefix), encode_component(absolute)))


_DATA_URL = T.StructType([T.StructField("media_type", T.StringType()), T.StructField("charset", T.StringType()), T.StructField("data", T.BinaryType())])


@F.pandas_udf(_DATA_URL)
def parse_data_url(url: pd.Series) -> pd.DataFrame:
    """Type, charset and bytes of data: URLs; broken base64 gives no bytes, other URLs give nulls."""
    return pd.DataFrame([split_data_url(u) for u in url], columns=["media_type", "charset", "data"])


def split_data_url(url: str | None) -> tuple:
    import base64
    from urllib.parse import unquote_to_bytes

    if url is None or not url.lower().startswith("data:"):
        return None, None, None
    head, _, body = url.partition("#")[0][5:].partition(",")
    kind, *rest = [p.strip() for p in head.split(";")]
    charset = "".join([p[8:].strip('"') for p in rest if p.startswith("charset=")][-1:])
    data = unquote_to_bytes(body)
    if "base64" in rest:
        try:
            data = base64.b64decode(data, validate=True)
        except ValueError:
            data = b""
    return kind.lower(), charset, data
