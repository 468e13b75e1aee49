"""Secret scans: fixed patterns, and strings that a subword vocabulary can't compress.

Natural words and code identifiers cost about one token for four characters;
random strings cost one for every one to two.  A run of key characters whose
characters-per-token ratio is low is reported, unless it is a digest of a known
length, a UUID, a number, a date or an identifier made of word-like parts.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import cache, lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm.rows import map_texts, unpacked
from foliomill.llm.text import plain

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Strings under this many characters for each token count as random.
CHARS_PER_TOKEN = 2.1
#: Identifiers have this many letters for each token of their parts at least, whatever the case; of random strings 0.1 % do.
LETTERS_PER_TOKEN = 2.25
SHORTEST, LONGEST = 20, 512

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}")
#: What a text must hold for the patterns to be tried; RE2 over whole Arrow arrays.
_MAYBE = rf"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}|[A-Za-z0-9+/_-]{{{SHORTEST}}}"

_DIGEST = re.compile(r"(?i)^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})$")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
_NUMERIC = re.compile(r"^[0-9+/_=-]+$")  # no letter at all
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


@cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1 << 14)
def _cost(part: str, vocabulary: tiktoken.Encoding) -> int:
    """Tokens of a part in the cheapest of the ways it can be written as a word."""
    low = part.lower()
    ways = {part, low, low.capitalize(), f" {low}", f" {low.capitalize()}"}
    return min(map(len, vocabulary.encode_ordinary_batch(list(ways), num_threads=1)))


def is_identifier(run: str, vocabulary: tiktoken.Encoding) -> bool:
    """Names, paths and slugs: at least half of the letters and digits are letters, in parts that tokenise like words."""
    parts = _PARTS.findall(run)
    worded = [p for p in parts if not p[0].isdigit()]
    letters = sum(map(len, worded))
    if 2 * letters < sum(map(len, parts)):
        return False
    return letters >= LETTERS_PER_TOKEN * sum(_cost(p[i : i + LONGEST], vocabulary) for p in worded for i in range(0, len(p), LONGEST))


def is_random(run: str, vocabulary: tiktoken.Encoding, ratio: float = CHARS_PER_TOKEN) -> bool:
    """Whether a run of key characters looks drawn at random."""
    body = run.rstrip("=")
    if _DIGEST.match(body) or _UUID.match(body) or _NUMERIC.match(body):
        return False
    # Random strings stay random in every stretch, so a long one is judged by its stretches.
    cuts = [body[i : i + LONGEST] for i in range(0, len(body), LONGEST)]
    if len(body) >= ratio * sum(map(len, vocabulary.encode_ordinary_batch(cuts, num_threads=1))):
        return False
    return not is_identifier(body, vocabulary)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The spans of the fixed patterns: start, end, kind."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def all_spans(text: str, vocabulary: tiktoken.Encoding) -> list[tuple[int, int, str]]:
    """Base spans and, where none of them lies, the runs found by token efficiency."""
    base = base_spans(text)
    found, at, reach = list(base), 0, 0
    for m in _RUN.finditer(text):
        # Both lists are in order: the furthest end of the base spans that begin before the run's end tells whether one meets it.
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][1])
            at += 1
        if reach <= m.start() and is_random(m[0], vocabulary):
            found.append((m.start(), m.end(), "random"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])
RESULT = T.StructType([T.StructField("spans", T.ArrayType(SPAN))])
REDACTED = T.StructType([*RESULT.fields, T.StructField("redacted", T.StringType())])
MARK = "[SECRET]"


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = MARK) -> str:
    """The text with every stretch of spans replaced by one mark."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, carry: list[str] | None = None, redacted: bool = False, vocabulary: str | None = None) -> DataFrame:
    """Columns ``row`` and ``spans`` (start, end, kind; code points, end exclusive), and the text without secrets if asked.

    Null and empty texts have no spans (a null text stays null when redacted).
    Runs of any length are read whole.  Spans are in order of their start, and
    at one start in that of ``KINDS``; base spans of two kinds may overlap, a
    random one meets none.  Every row is scanned by itself, so repeated rows
    give equal results, and nothing is shuffled; input columns are inside
    ``row`` and clash with nothing.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def make():
        known = encoding(path)

        def work(texts: pa.Array) -> dict:
            spans: list[list] = [[] for _ in range(len(texts))]
            out = texts.to_pylist() if redacted else None
            maybe = pc.match_substring_regex(plain(texts), _MAYBE)
            rows = pc.indices_nonzero(maybe)
            for i, text in zip(rows.to_pylist(), texts.take(rows).to_pylist(), strict=True):
                spans[i] = all_spans(text, known)
                if redacted and spans[i]:
                    out[i] = redact(text, spans[i])
            made = {"spans": [[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in spans]}
            return made | ({"redacted": out} if redacted else {})

        return work

    return map_texts(docs, make, REDACTED if redacted else RESULT, carry=carry)


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def secrets_report(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and the list of all spans, per row."""
    count = lambda kind: F.expr(f"CAST(size(filter(spans, s -> s.kind = '{kind}')) AS BIGINT)")
    return unpacked(
        found,
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.expr(_joined("filter(spans, s -> s.kind <> 'random')")).cast("binary"), 256).alias("base_sha256"),
        F.expr(_joined("spans")).alias("spans"),
    )


def digest(spans: list[tuple[int, int, str]]) -> str:
    """The digest that the report holds for some base spans."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
