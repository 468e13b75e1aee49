"""Settings: defaults, a file over them, variables of the environment over both, and the checks of values.

Every setting is a row of ``RULES``, so values can be checked one by one on the
driver or as a table of (name, value).
"""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = "FOLIOMILL_"


@dataclass(frozen=True)
class Rule:
    """A setting: its kind, the least and the most it may be, and its default."""

    name: str
    kind: str
    default: object
    low: float | None = None
    high: float | None = None


# Kinds, limits and defaults.
RULES = [
    Rule("enabled", "bool", True),
    Rule("target_lang", "lang", "zh"),
    Rule("source_lang", "source", "auto"),
    Rule("api_url", "url", "http://localhost:1188/translate"),
    Rule("max_requests_per_second", "float", 5.0, 0, 1000),
    Rule("max_concurrent_requests", "int", 10, 1, 100),
    Rule("batch_size", "int", 9000, 100, 50_000),
    Rule("batch_timeout_secs", "int", 30, 1, 300),
    Rule("min_batch_chars", "int", 2000, 0),
    Rule("cache_enabled", "bool", True),
    Rule("local_cache_size", "int", 1000, 10, 100_000),
    Rule("cache_ttl_secs", "int", 3600, 60, 604_800),
    Rule("parallel_enabled", "bool", True),
    Rule("retry_enabled", "bool", True),
    Rule("max_retry_attempts", "int", 3, 0),
]
TRUE, FALSE = ("true", "1", "yes", "on", "enabled"), ("false", "0", "no", "off", "disabled")
BY_NAME = {r.name: r for r in RULES}


def parsed(rule: Rule, value: str) -> object:
    """The value of a setting, or a ValueError that says what is wrong."""
    text = value.strip()
    if rule.kind == "bool":
        if text.lower() in TRUE + FALSE:
            return text.lower() in TRUE
        raise ValueError("not a boolean")
    if rule.kind in ("lang", "source"):
        if len(text) == 2 or (rule.kind == "source" and text.lower() == "auto"):
            return text.lower()
        raise ValueError("not a language code")
    if rule.kind == "url":
        if text.startswith(("http://", "https://")):
            return text
        raise ValueError("not an http address")
    if not re.fullmatch(r"\d{1,15}" if rule.kind == "int" else r"-?\d{1,15}(\.\d+)?", text):
        raise ValueError("not a number")
    number = int(text) if rule.kind == "int" else float(text)
    if rule.low is not None and (number < rule.low or (rule.kind == "float" and number == rule.low)):
        raise ValueError("too small")
    if rule.high is not None and number > rule.high:
        raise ValueError("too large")
    return number


def validated(settings: Mapping[str, object]) -> dict[str, object]:
    """The settings, or a ValueError where a whole can't work."""
    if settings["batch_size"] == 0:
        raise ValueError("batch_size is 0")
    if settings["max_concurrent_requests"] == 0:
        raise ValueError("max_concurrent_requests is 0")
    if settings["max_requests_per_second"] <= 0:
        raise ValueError("max_requests_per_second is not above 0")
    if settings["cache_enabled"] and settings["local_cache_size"] == 0:
        raise ValueError("local_cache_size is 0")
    return dict(settings)


def load(files: Iterable[str | Path] = (), environment: Mapping[str, str] | None = None) -> dict[str, object]:
    """Defaults, over them the first file that exists (TOML by its suffix, else JSON), over both the environment.

    A variable that can't be read is passed over; a file that can't be is an
    error, and so is a whole that ``validated`` rejects.  Unknown names are
    left out.
    """
    out = {r.name: r.default for r in RULES}
    found = next((p for p in (Path(f).expanduser() for f in files) if p.exists()), None)
    if found is not None:
        text = found.read_text(encoding="utf-8")
        given = tomllib.loads(text) if found.suffix == ".toml" else json.loads(text)
        out |= {k: v for k, v in given.items() if k in BY_NAME}
    for name, value in (os.environ if environment is None else environment).items():
        rule = BY_NAME.get(name.removeprefix(PREFIX).lower()) if name.startswith(PREFIX) else None
        if rule:
            try:
                out[rule.name] = parsed(rule, value)
            except ValueError:
                continue
    return validated(out)


def example() -> str:
    """A settings file (TOML) of the defaults, each with its limits."""
    out = []
    for r in RULES:
        limits = f"{r.low:g} to {r.high:g}" if r.high is not None else f"from {r.low:g}" if r.low is not None else r.kind
        out += [f"# {limits}", f"{r.name} = {json.dumps(r.default)}"]
    return "\n".join(out) + "\n"


def checked_settings(values: DataFrame) -> DataFrame:
    """Rows (name, value) with ``error``: what is wrong with a value, null if nothing, ``unknown setting`` for other names."""
    spark = values.sparkSession
    rules = spark.createDataFrame([(r.name, r.kind, None if r.low is None else float(r.low), None if r.high is None else float(r.high)) for r in RULES], "name string, kind string, low double, high double")
    text = F.trim("value")
    lower, number = F.lower(text), text.try_cast("double")
    shape = F.when(F.col("kind") == "int", text.rlike(r"^\d{1,15}\z")).otherwise(text.rlike(r"^-?\d{1,15}(\.\d+)?\z"))
    small = (number < F.col("low")) | ((F.col("kind") == "float") & (number == F.col("low")))
    error = (
        F.when(F.col("kind").isNull(), "unknown setting")
        .when(F.col("kind") == "bool", F.when(~lower.isin(*TRUE, *FALSE), "not a boolean"))
        .when(F.col("kind").isin("lang", "source"), F.when(~((F.char_length(text) == 2) | ((F.col("kind") == "source") & (lower == "auto"))), "not a language code"))
        .when(F.col("kind") == "url", F.when(~text.rlike("^https?://"), "not an http address"))
        .when(~shape, "not a number")
        .when(small, "too small")
        .when(number > F.col("high"), "too large")
    )
    return values.join(F.broadcast(rules), "name", "left").select("name", "value", error.alias("error"))
