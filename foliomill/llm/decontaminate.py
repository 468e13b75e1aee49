"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The windows of the benchmark are the patterns.  Patterns of one length share a
shift table over hashed blocks of two words: a block that ends no pattern tells
how far the search may jump.  Blocks that end a pattern lead to a bucket keyed
by the hashes of the pattern's last and first block, and the patterns of the
bucket are compared with the text word by word.  Many stretches of text are
searched at the same time, one step of all of them per numpy call.

The tables are numpy arrays of a few bytes for each word of the benchmark.  A
large benchmark makes several, each built and broadcast by itself; a task has
one of them in memory at a time and reads its texts once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm.rows import map_texts, unpacked
from foliomill.llm.text import LOWER_ALNUM, SLICE_BYTES, STEP, hashed, mix, plain, split_words
from foliomill.plans.scratch import Scratch

WINDOW_WORDS = 10
#: Bytes of benchmark text in the tables that are in memory at a time, and words of a piece of an item.
PATTERN_BYTES, PIECE_WORDS = 16 << 20, 1 << 14
LANE_WORDS = 1024

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def item_words(text: str | None) -> list[str]:
    """The words of one text, as the search sees them."""
    return _WORD.findall((text or "").translate(_LOWER))


def _block(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    x = (a.astype(np.uint64) * np.uint64(STEP)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((x * np.uint64(STEP)) >> np.uint64(64 - bits)).astype(np.int64)


class Tables:
    """Shift table and buckets for the runs of ``width`` words that start at ``starts`` in ``words``; run i belongs to ``owners[i]``."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, owners: np.ndarray, width: int) -> None:
        self.words, self.width = words, width
        starts, self.first, self.owners = _distinct_runs(words, starts, owners, width)
        self.span = min(2, width)
        self.bits = max(10, min(24, int(len(starts) * width).bit_length()))
        self.shift = np.full(1 << self.bits, min(255, width - self.span + 1), np.uint8)
        for end in range(self.span, width + 1):
            at = self._at(words[starts + end - self.span], words[starts + end - 1])
            np.minimum.at(self.shift, at, np.uint8(min(255, width - end)))
        keys = self._bucket(starts + width - 1, words)
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts, self.order = keys[order], starts[order].astype(np.int32), order.astype(np.int32)

    def _at(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return _block(first if self.span == 2 else np.zeros_like(last), last, self.bits)

    def _bucket(self, ends: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The key of the runs that end at ``ends``, from their last and first block."""
        begin = ends - self.width + 1
        head = self._at(ids[begin], ids[begin + self.span - 1])
        return (self._at(ids[ends - self.span + 1], ids[ends]) << 24) | head

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last positions of the occurrences and the pattern found at each."""
        size, width = len(ids), self.width
        if size < width:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = np.arange(0, size, LANE_WORDS)
        at, stop = np.maximum(starts, width - 1), np.minimum(starts + LANE_WORDS, size)
        found = []
        while len(at):
            alive = at < stop
            if not alive.all():
                at, stop = at[alive], stop[alive]
                continue
            jump = self.shift[self._at(ids[at - self.span + 1], ids[at])].astype(np.int64)
            if (ready := jump == 0).any():
                found.append(at[ready])
            at = at + np.maximum(jump, 1)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.concatenate(found)
        keys = self._bucket(ends, ids)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        fits = high - low
        which = np.repeat(np.arange(len(ends)), fits)
        pattern = np.arange(fits.sum()) - np.repeat(np.cumsum(fits) - fits, fits) + np.repeat(low, fits)
        for k in range(width):
            same = ids[ends[which] - width + 1 + k] == self.words[self.starts[pattern] + k]
            which, pattern = which[same], pattern[same]
        return ends[which], self.order[pattern]

    def items_of(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry of ``patterns`` its owners, as entry numbers and item numbers."""
        begin, end = self.first[patterns], self.first[patterns + 1]
        entry = np.repeat(np.arange(len(patterns)), end - begin)
        at = np.arange(len(entry)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + np.repeat(begin, end - begin)
        return entry, self.owners[at]


def _distinct_runs(words: np.ndarray, starts: np.ndarray, owners: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One start for each distinct run, where its owners begin, and the owners (each once for a run)."""
    value = np.zeros(len(starts), np.uint64)
    for k in range(width):
        value = mix(value * np.uint64(STEP) + words[starts + k].astype(np.uint64))
    order = np.lexsort((owners, value))
    starts, owners, value = starts[order], owners[order], value[order]
    new = np.ones(len(starts), bool)
    new[1:] = value[1:] != value[:-1]
    for k in range(width):
        new[1:] |= words[starts[1:] + k] != words[starts[:-1] + k]
    fresh = new.copy()
    fresh[1:] |= owners[1:] != owners[:-1]
    run = (np.cumsum(new) - 1)[fresh]
    heads = np.flatnonzero(new)
    return starts[heads], np.searchsorted(run, np.arange(len(heads) + 1)), owners[fresh].astype(np.int32)


@dataclass
class Benchmark:
    """Search tables of some benchmark items, and the words that their numbers (from 1) stand for, ordered by hash."""

    hashes: np.ndarray
    words: pa.StringArray
    tables: list[Tables]
    items: list[str]

    def numbers(self, words: pa.StringArray, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for those that aren't in the benchmark."""
        out = np.zeros(len(words), np.int64)
        if not len(self.hashes):
            return out
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        at = np.flatnonzero(self.hashes[place] == hashes)
        same = pc.equal(words.take(pa.array(at)).cast(pa.string()), self.words.take(pa.array(place[at]))).to_numpy(zero_copy_only=False)
        out[at[same]] = place[at[same]] + 1
        return out


def compile_items(items: list[tuple[str, str]] | pa.Table, window: int = WINDOW_WORDS) -> Benchmark:
    """Tables for the windows of (item_id, text) pairs; items without words give none."""
    if isinstance(items, pa.Table):
        names, texts = items.column(0).to_pylist(), plain(items.column(1))
    else:
        names, texts = [i for i, _ in items], plain(pa.array([t for _, t in items], pa.string()))
    split = split_words(texts, LOWER_ALNUM)
    hashes = hashed(split.distinct)
    order = np.argsort(hashes, kind="stable")
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(1, len(order) + 1)
    words = number[split.codes]
    known, back = np.unique(np.array(names, dtype=object), return_inverse=True) if names else (np.zeros(0, object), np.zeros(0, np.int64))
    owner, left = back[split.owner], np.repeat(split.offsets[1:], split.counts) - np.arange(len(words))
    count = np.repeat(split.counts, split.counts)
    tables = []
    for width in sorted(set(np.minimum(split.counts[split.counts > 0], window).tolist())):
        starts = np.flatnonzero((left >= width) & (np.minimum(count, window) == width))
        tables.append(Tables(words, starts, owner[starts], width))
    return Benchmark(hashes[order], split.distinct.take(pa.array(order)).cast(pa.string()), tables, known.tolist())


def search_texts(texts: pa.Array, benchmarks: Iterable[Benchmark]) -> dict[str, list]:
    """For each text its number of words, the runs of hit words (start, end, start, end, ...) and the items found."""
    split = split_words(texts, LOWER_ALNUM)
    hashes = hashed(split.distinct)
    count = len(split.offsets) - 1
    # An unknown word after each text keeps occurrences within one text.
    ids = np.zeros(len(split.codes) + count, np.int64)
    place = np.arange(len(split.codes)) + split.owner
    first = split.offsets[:-1] + np.arange(count)
    edge = np.zeros(len(ids) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for known in benchmarks:
        ids[place] = known.numbers(split.distinct, hashes)[split.codes]
        for tables in known.tables:
            ends, patterns = tables.search(ids)
            np.add.at(edge, ends - tables.width + 1, 1)
            np.add.at(edge, ends + 1, -1)
            pairs = np.unique(np.stack([np.searchsorted(first, ends, "right") - 1, patterns]), axis=1)
            entry, item = tables.items_of(pairs[1])
            for text, number in np.unique(np.stack([pairs[0][entry], item]), axis=1).T.tolist():
                items.setdefault(text, set()).add(known.items[number])
    hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    turn = np.flatnonzero(hit[1:] != hit[:-1])
    runs: list[list[int]] = [[] for _ in range(count)]
    for text, at in zip((np.searchsorted(first, turn[::2], "right") - 1).tolist(), turn.reshape(-1, 2).tolist(), strict=True):
        runs[text] += [at[0] - int(first[text]), at[1] - int(first[text])]
    return {"n_words": split.counts.tolist(), "hit_runs": runs, "items": [sorted(items.get(i, ())) for i in range(count)]}


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_runs", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def item_pieces(benchmark: DataFrame, window: int = WINDOW_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """(item, piece, text): items cut into pieces that overlap by a window less one word, so that each window is in one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = item_words(text)
                begin = range(0, max(len(words) - window, 0) + 1, piece_words) if words else ()
                parts = [" ".join(words[i : i + piece_words + window - 1]) for i in begin]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], ["item", "piece", "text"])

    named = benchmark.select(benchmark["item_id"].cast("string").alias("item"), benchmark["text"].cast("string").alias("text")).where("item is not null")
    return named.mapInArrow(cut, "item string, piece int, text string")


def benchmark_tables(spark: SparkSession, benchmark: DataFrame, window: int = WINDOW_WORDS, pattern_bytes: int = PATTERN_BYTES) -> list[Broadcast]:
    """Search tables for about ``pattern_bytes`` of pieces each, built one after the other and broadcast."""
    scratch = Scratch(spark, "decontaminate")
    pieces = scratch.table(item_pieces(benchmark, window), "pieces")
    total = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // pattern_bytes))
    out = []
    for k in range(blocks):
        block = pieces.where(F.pmod(F.xxhash64("item", "piece"), F.lit(blocks)) == k).select("item", "text")
        out.append(spark.sparkContext.broadcast(compile_items(block.toArrow(), window)))
    scratch.drop(pieces)
    return out


def _each(shared: list[Broadcast]) -> Iterator[Benchmark]:
    """The tables in turn; with several only the one in use stays in memory."""
    for one in shared:
        yield one.value
        if len(shared) > 1:
            vars(one).pop("_value", None)  # read anew from the worker's disk when it is wanted again


def find_contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, window: int = WINDOW_WORDS, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """Columns ``row``, ``n_words``, ``hit_runs`` and ``items`` for every document.

    A document word is hit if it lies in any occurrence of ``window``
    consecutive words of an item, or of all words of a shorter item.
    ``hit_runs`` lists the starts and ends (exclusive) of the hit stretches in
    words, ``items`` the ids of the items found, sorted as strings.

    Null and wordless texts have no words and no hits; null and wordless items
    and items without an id are never found; repeated items count once by id;
    repeated document rows give a row each; input columns are inside ``row``
    and clash with nothing.  Tables hold ``pattern_bytes`` of benchmark text
    each; a long item is spread over several.  A larger benchmark has more
    tables and takes as much more time, not memory: documents are read once,
    and each slice of texts is searched with one table after the other.
    """
    shared = benchmark_tables(spark, benchmark, window, pattern_bytes)

    def make():
        return lambda texts: search_texts(texts, _each(shared))

    return map_texts(docs, make, RESULT, carry=carry, limit=SLICE_BYTES * (1 if len(shared) == 1 else 4))


def contamination_report(found: DataFrame) -> DataFrame:
    """One row per document with the counts and digests of what ``find_contamination`` gave."""
    hit = F.expr("aggregate(hit_runs, 0L, (s, x) -> x - s)")  # alternating sum: ends minus starts
    return unpacked(
        found,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_runs") > 0).alias("contaminated"),
    )


def digest(items: list[str]) -> str:
    """The digest of item ids that the report holds."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def clean_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of the benchmark, with their own columns."""
    return unpacked(find_contamination(spark, docs, benchmark).where(F.size("hit_runs") == 0))
