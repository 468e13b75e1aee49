"""Packing tokenised documents into fixed-length sequences with certified bin counts.

Each partition of the pieces is packed by best-fit decreasing.  Dual-feasible
functions give a lower bound on the sequences that any packing of the
partition needs; a partition that meets its bound is certified.  Partitions
with a gap give the documents of their unfilled sequences to an exchange, a
certified one lends its emptiest sequence, and what is exchanged is dealt anew
and packed again, until nothing was gained, one partition is left, or the
rounds (``ROUNDS``) are over; every piece has its place after each of them.
"""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from foliomill.llm.rows import map_texts
from foliomill.llm.text import plain, raw, split_words
from foliomill.plans.scratch import Scratch

SEQUENCE_TOKENS = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
#: Pieces that one task packs, on average.
PARTITION_PIECES = 50_000
ROUNDS = 4
#: Chunks whose ids a task keeps, twice.
CACHED_WORDS = 150_000

PIECE = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


_LETTER, _DIGIT, _OTHER = 1, 2, 3
#: Classes of ASCII bytes; 0: blanks, controls, the apostrophe and everything beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = _OTHER
#: Printable stand-ins of the bytes in a byte-level vocabulary, by the rule that bytes without one are numbered from 256 on.
_PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _PLAIN_BYTES} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PLAIN_BYTES))}
_BYTE_TABLE = {b: c for b, c in _BYTE_CHARS.items() if ord(c) != b}


def spaced(texts: pa.StringArray) -> pa.StringArray:
    """Texts with a blank wherever the tokenizer surely splits, and plain capitals in lower case.

    It splits between two ASCII characters if one is a digit or if just one is
    a letter, unless one of them is the apostrophe, which may start a suffix
    such as 's.  Neither change alters an id: capitals are changed only before
    an ASCII character, where no accent can follow.  Special tokens are kept
    whole by leaving texts that hold one as they are.
    """
    data, offsets = raw(texts)
    if len(data) < 2:
        return texts
    kind = _CLASS[data]
    a, b = kind[:-1], kind[1:]
    cut = (a > 0) & (b > 0) & ((a != b) | (a == _DIGIT))
    ends = offsets[1:-1]
    cut[ends[(ends > 0) & (ends < len(data))] - 1] = False
    lower = data.copy()
    upper = (data[:-1] >= 65) & (data[:-1] <= 90) & (data[1:] < 128)
    lower[:-1][upper] += 32
    if (special := np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))).size:
        for i in special:
            s, e = offsets[i], offsets[i + 1]
            cut[s:e] = False
            lower[s:e] = data[s:e]
    shift = np.concatenate([[0], np.cumsum(cut)])
    out = np.full(len(data) + int(shift[-1]), 32, np.uint8)
    out[np.arange(len(data)) + shift] = lower
    # shift has one entry per byte; the end of the data moves by all cuts
    moved = np.concatenate([shift, shift[-1:]])
    new = offsets + moved[np.minimum(offsets, len(data))]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(new.astype(np.int32)), pa.py_buffer(out))


class WordTokens:
    """Ids of the chunks between white space, kept for chunks seen before.

    The tokenizer normalises, splits and merges within such chunks only, so
    the ids of a text are those of its chunks in order.  A chunk of Latin
    letters is one word of the vocabulary's merges and goes straight to them;
    any other goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _word(self, chunk: str) -> bytes | None:
        if not chunk.isalpha():
            return None
        if not chunk.isascii():
            if max(chunk) >= "ɐ" or "İ" in chunk:
                return None
            chunk = chunk.lower().encode().decode("latin-1").translate(_BYTE_TABLE)
        else:
            chunk = chunk.lower()
        return array("I", [t.id for t in self.model.tokenize(chunk)]).tobytes()

    def _encode(self, chunks: list[str]) -> None:
        hard = []
        for c in chunks:
            if (ids := self._word(c)) is None:
                hard.append(c)
            else:
                self.young[c] = ids
        for c, e in zip(hard, self.tokenizer.encode_batch_fast(hard, add_special_tokens=False), strict=True):
            self.young[c] = array("I", e.ids).tobytes()

    def ids(self, chunks: list[str]) -> list[bytes]:
        if len(self.young) > CACHED_WORDS:
            self.young, self.old = {}, self.young
        young, old, new = self.young, self.old, []
        for c in chunks:
            if c not in young:
                if (ids := old.get(c)) is None:
                    new.append(c)
                else:
                    young[c] = ids
        self._encode(new)
        return [young[c] for c in chunks]


def token_arrays(texts: pa.Array, tokens: WordTokens) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one end id after each, and the offsets of the texts."""
    words = split_words(spaced(plain(texts)))
    coded = tokens.ids(words.distinct.to_pylist())
    flat = np.frombuffer(b"".join(coded), "<u4")
    sizes = np.fromiter((len(c) // 4 for c in coded), np.int64, len(coded))
    heads = np.cumsum(sizes) - sizes
    each = sizes[words.codes]
    ends = np.concatenate([[0], np.cumsum(each)])
    offsets = ends[words.offsets] + np.arange(len(words.offsets))
    out = np.full(int(offsets[-1]), END_ID, "<u4")
    total = int(ends[-1])
    source = np.repeat(heads[words.codes] - ends[:-1], each) + np.arange(total)
    out[np.arange(total) + np.repeat(words.owner, each)] = flat[source]
    return out, offsets


def pieces_of(texts: pa.Array, tokens: WordTokens, size: int) -> list[list[tuple[int, int, int, int]]]:
    """For each text its pieces: number, start, length and checksum of the ids."""
    ids, offsets = token_arrays(texts, tokens)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out.append([(k, at - a, min(size, b - at), zlib.crc32(ids[at : min(at + size, b)])) for k, at in enumerate(range(a, b, size))])
    return out


def tokenized_pieces(docs: DataFrame, carry: list[str], size: int = SEQUENCE_TOKENS, tokenizer: str | None = None) -> DataFrame:
    """The carried columns and one row for each piece of at most ``size`` tokens."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    result = T.StructType([T.StructField("pieces", T.ArrayType(PIECE))])

    def make():
        tokens = WordTokens(path)
        names = PIECE.fieldNames()
        return lambda texts: {"pieces": [[dict(zip(names, p, strict=True)) for p in ps] for ps in pieces_of(texts, tokens, size)]}

    return map_texts(docs, make, result, carry=carry).select("row.*", F.inline("pieces"))


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; a bit set of the room left finds the tightest bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, made = 0, 0
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = rooms >> length
        if fit:
            room = length + (fit & -fit).bit_length() - 1
            bin_ = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            room, bin_ = size, made
            made += 1
        bins[i], offsets[i] = bin_, size - room
        if left := room - length:
            open_by_room[left].append(bin_)
            rooms |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The largest bound that dual-feasible functions of two families give.

    For a threshold e up to half a bin, items over size - e count as a whole
    bin and items under e as nothing; for a k, an item counts as
    floor((k+1)x/size)/k of a bin unless (k+1)x is a multiple of the size.
    """
    if len(lengths) == 0:
        return 0
    counts = np.bincount(lengths, minlength=size + 1)
    x = np.arange(size + 1, dtype=np.int64)
    mass, number = np.cumsum(counts * x), np.cumsum(counts)
    best = -(-int(mass[-1]) // size)
    e = np.arange(1, size // 2 + 1)
    whole = number[size] - number[size - e]
    middle = mass[size - e] - mass[e - 1]
    best = max(best, int((-(-(whole * size + middle) // size)).max()))
    for k in range(1, 21):
        up = (k + 1) * x
        value = np.where(up % size == 0, x * k, (up // size) * size)  # in 1 / (k * size) of a bin
        best = max(best, -(-int((counts * value).sum()) // (k * size)))
    return best


PLACED = T.StructType(
    [
        T.StructField("bin", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("bin_fill", T.LongType()),
        T.StructField("bins", T.LongType()),
        T.StructField("bound", T.LongType()),
        T.StructField("released", T.BooleanType()),
    ]
)


def _packer(size: int, names: list[str]):
    def pack(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy().astype(np.int64)
        bins, offsets = best_fit_decreasing(lengths, size)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        bound = lower_bound(lengths, size)
        slack = fill < size
        if len(fill) == bound:  # certified
            emptiest = int(np.argmin(fill))
            slack = slack & (np.arange(len(fill)) == emptiest)
        n = table.num_rows
        made = [pa.array(bins), pa.array(offsets), pa.array(fill[bins]), pa.array(np.full(n, len(fill))), pa.array(np.full(n, bound)), pa.array(slack[bins])]
        return pa.Table.from_arrays([*(table.column(c) for c in names), *made], [*names, *PLACED.fieldNames()])

    return pack


def pack_pieces(spark: SparkSession, pieces: DataFrame, scratch: Scratch, size: int = SEQUENCE_TOKENS, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Columns of ``pieces`` (one of them ``length``) with ``sequence_id`` and ``offset``.

    Each round deals its pieces at random over enough tasks; one task gets
    ``partition_pieces`` rows on average, whatever their keys, as a random
    number drawn when the table was written is the key.
    """
    names = [c for c in pieces.columns if c not in ("_deal", "sequence_id", "offset")]
    kept, pool, before = [], pieces, None
    for r in range(rounds):
        count, tokens = pool.agg(F.count("*"), F.sum("length")).first()
        if not count:
            break
        parts = max(1, -(-count // partition_pieces))
        dealt = pool.withColumn("_part", F.pmod(F.xxhash64("_deal", F.lit(r)), F.lit(parts)).cast("long"))
        carried = [*names, "_deal", "_part"]
        schema = T.StructType([*dealt.select(*carried).schema.fields, *PLACED.fields])
        placed = scratch.table(dealt.select(*carried).groupBy("_part").applyInArrow(_packer(size, carried), schema), f"round{r}")
        per_part = placed.groupBy("_part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"), F.count_distinct(F.when(F.col("released"), F.col("bin"))).alias("out"))
        bins, bound, out, out_parts = per_part.agg(F.sum("bins"), F.sum("bound"), F.sum("out"), F.count_if(F.col("out") > 0)).first()
        if before is not None and bins >= before[0]:  # nothing gained: what the exchange took stays where it was
            kept.append((r - 1, before[1]))
            break
        open_bins = placed.where("released")
        last = r == rounds - 1 or out_parts <= 1
        kept.append((r, placed if last else placed.where("not released")))
        if last:
            break
        before, pool = (out, open_bins), open_bins.select(*names, "_deal")
    parts = [p.withColumn("sequence_id", F.lit(r) * F.lit(1 << 56) + F.col("_part") * F.lit(1 << 32) + F.col("bin")).select(*names, "sequence_id", "offset") for r, p in kept]
    if not parts:
        return pieces.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pack_documents(spark: SparkSession, docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), size: int = SEQUENCE_TOKENS, tokenizer: str | None = None, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """One row per piece: carried columns, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and one end id (0); only those of more than
    ``size`` tokens are cut.  A null or empty text is the end id alone; each
    row of a repeated document is packed by itself; an empty table gives none.
    Only the carried columns and the text are read; a carried name that the
    result has as well is an error.
    The text is read once, by the stage that tokenises; what is dealt and
    exchanged is a few numbers per piece.
    """
    if clash := {*carry} & {*PIECE.fieldNames(), *PLACED.fieldNames(), "sequence_id", "_deal", "_part"}:
        raise ValueError(f"carried columns have names of the result: {sorted(clash)}")
    scratch = Scratch(spark, "packing")
    pieces = tokenized_pieces(docs, list(carry), size, tokenizer).withColumn("_deal", F.rand(7))
    return pack_pieces(spark, scratch.table(pieces, "pieces"), scratch, size, partition_pieces)
