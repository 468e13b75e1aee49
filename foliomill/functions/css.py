"""Stylesheets: tokens, and rewriting of what they refer to."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from foliomill.functions.media import IMAGE_PROPERTIES

_NAME = r"(?:--|-?(?:[A-Za-z_\u0080-\U0010ffff]|\\[^\n]))(?:[\w\-\u0080-\U0010ffff]|\\(?:[0-9A-Fa-f]{1,6}\s?|[^\n]))*"
_STRING = r"\"(?:[^\"\\\n]|\\(?:\n|.))*\"?|'(?:[^'\\\n]|\\(?:\n|.))*'?"
TOKEN = re.compile(
    rf"""(?P<comment>/\*.*?(?:\*/|\Z))
    |(?P<space>\s+)
    |(?P<string>{_STRING})
    |(?P<url>(?i:url)\(\s*(?!["'\s])(?P<bare>(?:[^)\s"'(\\]|\\.)*)\s*\))
    |(?P<function>{_NAME}\()
    |(?P<at>@{_NAME})
    |(?P<hash>\#(?:[\w\-\u0080-\U0010ffff]|\\(?:[0-9A-Fa-f]{{1,6}}\s?|[^\n]))+)
    |(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)(?P<unit>%|{_NAME})?
    |(?P<name>{_NAME})
    |(?P<mark>~=|\|=|\^=|\$=|\*=|<!--|-->|.)""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(?:([0-9A-Fa-f]{1,6})\s?|(\n)|(.))", re.DOTALL)
#: How deep imports are followed.
MAX_IMPORTS = 8


def unescape_css(text: str) -> str:
    def plain(m: re.Match) -> str:
        if m[1]:
            code = int(m[1], 16)
            return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else "\ufffd"
        return "" if m[2] else m[3]

    return _ESCAPE.sub(plain, text)


def string(value: str) -> str:
    """A double-quoted CSS string."""
    shown = "".join(f"\\{ord(c):x} " if c < " " or c == "\x7f" else "\\" + c if c in '"\\' else c for c in value)
    return f'"{shown}"'


def number(text: str) -> str:
    """A number in single precision, shortest form, with its plus sign if it had one."""
    value = np.float32(text)
    shown = np.format_float_positional(value, trim="-")
    return ("+" if text.startswith("+") else "") + shown


def is_image_property(name: str) -> bool:
    return name.lower() in IMAGE_PROPERTIES


def rewrite_css(css: str, reference: Callable[[str, str, bool], str | None], no_fonts: bool = False) -> str:
    """The sheet with each reference replaced.

    ``reference(url, property, is_import)`` gives the new URL, or None to
    leave the reference out.  Comments, white space and punctuation stay;
    strings are quoted anew and numbers written in shortest form; a sheet of
    white space alone is empty.  With ``no_fonts`` @font-face rules go.
    """
    out: list[str] = []
    at = 0
    prop, rule, depth = "", "", 0
    function: list[str] = []
    skipping: int | None = None
    while at < len(css):
        m = TOKEN.match(css, at)
        at = m.end()
        kind, text = m.lastgroup, m[0]
        if kind in ("bare", "unit"):
            kind = "url" if m["url"] is not None else "number"
        shown = text
        importing = rule == "import"
        if kind == "string":
            value = unescape_css(text[1:-1] if len(text) > 1 and text[-1] == text[0] else text[1:])
            if function and function[-1] == "url":
                new = reference(value, prop, False) if value else ""  # quoted inside url(): embedded, not followed
                shown = string(new) if new else ""
            elif importing and not function:
                new = reference(value, prop, True)
                shown = string(new) if new else string(value)
                rule = ""
            else:
                shown = string(value)
        elif kind == "url":
            value = unescape_css(m["bare"])
            if value == "" or value.startswith("#"):
                shown = f"url({value})"
            else:
                new = reference(value, prop, importing)
                shown = f"url({string(new)})" if new else "url()"
        elif kind == "function":
            function.append(text[:-1].lower())
        elif kind == "at":
            rule, prop = text[1:].lower(), ""
            if no_fonts and rule == "font-face":
                shown = ""
        elif kind == "number":
            shown = number(m["number"]) + (m["unit"] or "")
        elif kind == "name":
            prop, rule = (text if not function else prop), rule if rule in ("import", "font-face") else ""
        elif kind == "mark":
            if text == ")" and function:
                function.pop()
            elif text == "{":
                if no_fonts and rule == "font-face" and skipping is None:
                    skipping = depth
                depth += 1
            elif text == "}":
                depth -= 1
                if skipping is not None and depth <= skipping:
                    skipping, rule = None, ""
                    continue
            elif text == ";":
                rule = ""
        if skipping is None:
            out.append(shown)
    whole = "".join(out)
    return whole if whole.strip() else ""
