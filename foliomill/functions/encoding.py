"""Character encodings of pages: labels, decoding with a second look at the page's own label, and encoding."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.functions.html import Node, parse_html

# Labels that browsers read as another encoding than their name says.
ALIASES = {
    "ascii": "cp1252",
    "us-ascii": "cp1252",
    "iso-8859-1": "cp1252",
    "iso8859-1": "cp1252",
    "latin1": "cp1252",
    "l1": "cp1252",
    "windows-1252": "cp1252",
    "gb2312": "gbk",
    "gb_2312-80": "gbk",
    "x-gbk": "gbk",
    "chinese": "gbk",
    "shift_jis": "cp932",
    "shift-jis": "cp932",
    "sjis": "cp932",
    "x-sjis": "cp932",
    "euc-kr": "cp949",
    "ks_c_5601-1987": "cp949",
    "korean": "cp949",
    "big5": "big5hkscs",
    "iso-8859-9": "cp1254",
    "iso-8859-11": "cp874",
    "tis-620": "cp874",
    "unicode": "utf-16-le",
    "utf-16": "utf-16-le",
    "utf8": "utf-8",
    "unicode-1-1-utf-8": "utf-8",
    "x-user-defined": "latin-1",
}


def codec(label: str | None) -> str | None:
    """The Python codec of a label, None for an unknown one."""
    name = (label or "").strip().lower()
    try:
        return codecs.lookup(ALIASES.get(name, name)).name if name else None
    except LookupError:
        return None


def own_charset(document: Node) -> str | None:
    """The charset that a page states in its head: the first meta that has one."""
    for m in document.find("head", "meta"):
        if (value := m.get("charset")) is not None:
            return value
        if (m.get("http-equiv") or "").lower() == "content-type" and m.get("content") is not None:
            parts = [p.strip() for p in m.get("content").split(";")[1:]]
            return next((p[8:].strip('"') for p in parts if p.startswith("charset=")), "")
    return None


def decode_page(content: bytes | None, label: str | None = None) -> tuple[str, str]:
    """The text of a page and its charset: decoded by the label or as UTF-8, and again by the page's own label if that is known."""
    text = (content or b"").decode(codec(label) or "utf-8", "replace")
    stated = own_charset(parse_html(text))
    if codec(stated):
        return (content or b"").decode(codec(stated), "replace"), stated
    return text, label if codec(label) else "utf-8"


_DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("charset", T.StringType())])


@F.pandas_udf(_DECODED)
def decoded_page(content: pd.Series, label: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_page(c, x) for c, x in zip(content, label, strict=True)], columns=["text", "charset"])


@F.pandas_udf(T.BinaryType())
def encoded_page(text: pd.Series, label: pd.Series) -> pd.Series:
    """Bytes in a charset; characters it lacks become numeric references, an unknown label means UTF-8."""
    return pd.Series([None if t is None else t.encode(codec(x) or "utf-8", "xmlcharrefreplace") for t, x in zip(text, label, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def encoding_error(label: pd.Series) -> pd.Series:
    """What is wrong with an output encoding, null if nothing."""
    return pd.Series([None if x is None or codec(x) else f'unknown encoding "{x}"' for x in label], dtype=object)
