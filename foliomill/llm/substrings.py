"""Exact removal of repeated passages, found by difference-cover anchors.

Positions whose remainder modulo 7 is 0, 1 or 3 form a difference cover: for
any two positions some shift of at most 6 words moves both onto it.  So two
equal windows of 13 words hold, at the same place inside, a run of 7 words that
starts on the cover in both documents.  Hence three passes over the documents,
dealt into batches once: hashes of the runs on the cover tell which runs occur
in two documents; windows that hold such a run are hashed in 128 bits and the
smallest document of each is found; every window is then judged.

Hashes travel as packed arrays, one row for each batch and bucket, and a hash
once for each batch however often it occurs there, so a passage that stands in
every document costs one entry for each batch.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm.text import hashed, plain, raw, split_words, windows
from foliomill.plans.scratch import Scratch

WINDOW_WORDS = 13
#: A difference cover: every remainder modulo the period is a difference of two members.
PERIOD, COVER = 7, (0, 1, 3)
#: Bytes of text in a batch, and of hashes in a bucket, on average.
BATCH_BYTES, BUCKET_BYTES = 6 << 20, 8 << 20

HASHES = "bucket int, batch int, hashes binary, more binary"
SHARED = "batch int, hashes binary, more binary"
OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _u64(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint64)


class _Batch:
    """The words of a batch of documents, as hashes."""

    def __init__(self, table: pa.Table, window: int, seeds: int) -> None:
        self.texts = plain(table.column("text"))
        ids = table.column("doc_id").to_numpy()
        self.known = ~np.isnan(ids) if ids.dtype.kind == "f" else np.ones(len(ids), bool)
        self.ids = np.array([-1 if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
        self.words = split_words(self.texts)
        self.values = [hashed(self.words.distinct, s)[self.words.codes] if len(self.words.codes) else np.zeros(0, np.uint64) for s in range(seeds)]
        self.window = window
        self.owner = self.words.owner
        left = np.repeat(self.words.offsets[1:], self.words.counts) - np.arange(len(self.owner))
        #: Positions where a window starts.
        self.starts = (left >= window) & self.known[self.owner]
        self.left = left

    def anchors(self, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions and hashes of the runs on the cover, and their length, in documents that hold a window."""
        width = self.window - period + 1
        inside = np.arange(len(self.owner)) - np.repeat(self.words.offsets[:-1], self.words.counts)
        on = np.isin(inside % period, cover) & (self.left >= width) & self.known[self.owner]
        on &= np.repeat(self.words.counts >= self.window, self.words.counts)
        at = np.flatnonzero(on)
        rolled = windows(self.values[0], width)
        return at, rolled[at], width

    def window_hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = (windows(v, self.window) for v in self.values)
        return first[at], second[at]


def _batch_number(table: pa.Table) -> int:
    return table.column("batch")[0].as_py()


def _parts(blobs: list[bytes], sizes: list[int], kinds: list[type]) -> list[np.ndarray]:
    """The columns of packed rows, each of them whole in every blob, end to end."""
    out, at = [], [0] * len(blobs)
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.frombuffer(b"".join(b[i : i + n * width] for b, i, n in zip(blobs, at, sizes, strict=True)), kind))
        at = [i + n * width for i, n in zip(at, sizes, strict=True)]
    return out


def _rows(bucket: np.ndarray, batch: int, hashes: np.ndarray, *more: np.ndarray) -> pa.Table:
    """Packed rows by bucket; ``hashes`` and the columns in ``more`` (one entry a hash) are sorted by bucket."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    edges = np.concatenate([[0], cuts, [len(bucket)]]) if len(bucket) else np.zeros(1, int)
    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    kinds = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("hashes", pa.binary()), ("more", pa.binary())])
    return pa.table([[int(bucket[a]) for a, _ in spans], [batch] * len(spans), [hashes[a:b].tobytes() for a, b in spans], [b"".join(c[a:b].tobytes() for c in more) for a, b in spans]], schema=kinds)


def _short(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The low 48 bits as two columns; enough to tell a bucket's hashes apart, and a false match costs work only."""
    return hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint16)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _emit_anchors(window: int, period: int, cover: tuple[int, ...], buckets: int):
    def run(table: pa.Table) -> pa.Table:
        batch = _Batch(table, window, 1)
        at, values, _ = batch.anchors(period, cover)
        ids = batch.ids[batch.owner[at]]
        order = np.lexsort((ids, values))
        values, ids = values[order], ids[order]
        first = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
        heads = np.flatnonzero(first)
        tails = np.concatenate([heads[1:], [len(values)]]) - 1 if len(heads) else heads
        several = (ids[heads] != ids[tails]).astype(np.uint8)
        return _rows(_bucket(values[heads], buckets), _batch_number(table), *_short(values[heads]), several)

    return run


def _sent_back(batch: np.ndarray, hashes: np.ndarray, *more: np.ndarray) -> pa.Table:
    order = np.argsort(batch, kind="stable")
    batch, hashes, more = batch[order], hashes[order], [c[order] for c in more]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(batch)) + 1, [len(batch)]]) if len(batch) else np.zeros(1, int)
    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    kinds = pa.schema([("batch", pa.int32()), ("hashes", pa.binary()), ("more", pa.binary())])
    return pa.table([[int(batch[a]) for a, _ in spans], [hashes[a:b].tobytes() for a, b in spans], [b"".join(c[a:b].tobytes() for c in more) for a, b in spans]], schema=kinds)


def _shared_anchors(table: pa.Table) -> pa.Table:
    blobs = table.column("hashes").to_pylist()
    sizes = [len(b) // 4 for b in blobs]
    low = np.frombuffer(b"".join(blobs), np.uint32)
    high, flags = _parts(table.column("more").to_pylist(), sizes, [np.uint16, np.uint8])
    batch = np.repeat(table.column("batch").to_numpy(), sizes)
    # Once for each batch: in two batches, or in two documents of one.
    _, back, times = np.unique(low | high.astype(np.uint64) << np.uint64(32), return_inverse=True, return_counts=True)
    several = (times > 1) | (np.bincount(back, weights=flags, minlength=len(times)) > 0)
    keep = several[back]
    return _sent_back(batch[keep], low[keep], high[keep])


def _emit_windows(window: int, period: int, cover: tuple[int, ...], buckets: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if docs.num_rows == 0 or found.num_rows == 0:
            return _rows(np.zeros(0, np.int64), 0, np.zeros(0, np.uint64))
        batch = _Batch(docs, window, 2)
        at, values, _ = batch.anchors(period, cover)
        low = np.frombuffer(b"".join(found.column("hashes").to_pylist()), np.uint32)
        high = np.frombuffer(b"".join(found.column("more").to_pylist()), np.uint16)
        shared = at[np.isin(values & np.uint64(0xFFFFFFFFFFFF), low | high.astype(np.uint64) << np.uint64(32))]
        wanted = np.zeros(len(batch.owner) + 1, np.int64)
        # The windows that hold the run begin up to period - 1 words before it, in the same document.
        np.add.at(wanted, np.maximum(shared - period + 1, batch.words.offsets[batch.owner[shared]]), 1)
        np.add.at(wanted, shared + 1, -1)
        at = np.flatnonzero((np.cumsum(wanted[:-1]) > 0) & batch.starts)
        first, second = batch.window_hashes(at)
        ids = batch.ids[batch.owner[at]]
        order = np.lexsort((ids, second, first))
        first, second, ids = first[order], second[order], ids[order]
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]) if len(first) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        tails = np.concatenate([heads[1:], [len(first)]]) - 1 if len(heads) else heads
        several = (ids[heads] != ids[tails]).astype(np.uint8)
        return _rows(_bucket(first[heads], buckets), _batch_number(docs), first[heads], second[heads], ids[heads], several)

    return run


def _least_documents(table: pa.Table) -> pa.Table:
    blobs = table.column("hashes").to_pylist()
    sizes = [len(b) // 8 for b in blobs]
    first = _u64(blobs)
    second, lead, flag = _parts(table.column("more").to_pylist(), sizes, [np.uint64, np.int64, np.uint8])
    batch = np.repeat(table.column("batch").to_numpy(), sizes)
    order = np.lexsort((second, first))
    first, second, lead, flag, batch = first[order], second[order], lead[order], flag[order], batch[order]
    new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]) if len(first) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    low = np.full(int(new.sum()), np.iinfo(np.int64).max)
    np.minimum.at(low, group, lead)
    # A batch is told where one of its documents comes after the least one.
    keep = (lead > low[group]) | (flag > 0)
    return _sent_back(batch[keep], first[keep], second[keep], low[group[keep]])


def _judge(window: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
        if docs.num_rows == 0:
            return kinds.empty_table()
        batch = _Batch(docs, window, 2)
        gone = np.zeros(len(batch.owner), bool)
        if found.num_rows:
            blobs = found.column("hashes").to_pylist()
            first = _u64(blobs)
            second, low = _parts(found.column("more").to_pylist(), [len(b) // 8 for b in blobs], [np.uint64, np.int64])
            order = np.lexsort((second, first))
            first, second, low = first[order], second[order], low[order]
            all_first, all_second = (windows(v, window) for v in batch.values)
            at = np.flatnonzero(batch.starts)
            at = at[np.isin(all_first[at], first)]
            # Equal first halves are rare, but each of them is tried.
            slot, end = np.searchsorted(first, all_first[at], "left"), np.searchsorted(first, all_first[at], "right")
            edge = np.zeros(len(batch.owner) + 1, np.int64)
            while len(at):
                same = (second[slot] == all_second[at]) & (low[slot] < batch.ids[batch.owner[at]])
                np.add.at(edge, at[same], 1)
                np.add.at(edge, at[same] + window, -1)
                slot = slot + 1
                on = slot < end
                at, slot, end = at[on], slot[on], end[on]
            gone = np.cumsum(edge[:-1]) > 0
        removed = np.bincount(batch.owner[gone], minlength=docs.num_rows)
        data, offsets = raw(batch.texts)
        text, digests = data.tobytes(), []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            words = text[a:b].split()
            if removed[i]:
                words = compress(words, ~gone[batch.words.offsets[i] : batch.words.offsets[i + 1]])
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        ids = docs.column("doc_id").combine_chunks().cast(pa.int64())
        return pa.Table.from_arrays([ids, pa.array(batch.words.counts), pa.array(removed), pa.array(digests)], schema=kinds)

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW_WORDS, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    A word is removed if it lies in a window of ``window`` words whose sequence
    also starts in a document with a smaller doc_id.  Null and empty texts have
    no words; texts shorter than a window lose none; rows that share a doc_id
    don't remove each other's words; a null doc_id is neither smaller nor
    larger than another.  An empty table gives no rows.  Ids must be integers;
    other columns aren't read.

    Texts are dealt into batches by row number, so no key can fill a batch,
    and cross the network once: the passes share that exchange.  Row numbers
    must be the same when a lost part of it is made again, as they are where
    rows come from files in order; rows that come from a shuffle are written
    first.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("doc_id must be of an integer type")
    docs = docs.select("doc_id", "text")
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = Scratch(spark, "substrings").table(docs, "documents")
    if window < PERIOD + 1:
        raise ValueError(f"windows of under {PERIOD + 1} words need another cover")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-total // batch_bytes))
    buckets = max(1, -(-total // bucket_bytes) // 2)
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(batches)).cast("int")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), number.alias("batch"))
    by_batch = dealt.groupBy("batch")
    anchors = by_batch.applyInArrow(_emit_anchors(window, PERIOD, COVER, buckets), HASHES)
    shared = anchors.groupBy("bucket").applyInArrow(_shared_anchors, SHARED)
    candidates = by_batch.cogroup(shared.groupBy("batch")).applyInArrow(_emit_windows(window, PERIOD, COVER, buckets), HASHES)
    least = candidates.groupBy("bucket").applyInArrow(_least_documents, SHARED)
    return by_batch.cogroup(least.groupBy("batch")).applyInArrow(_judge(window), OUT)
