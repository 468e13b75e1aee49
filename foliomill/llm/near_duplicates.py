"""MinHash near-dedup with fast similarity sketches, banding and exact verification.

The nodes are distinct shingle sets, so exact copies share a node and thousands
of them cost nothing further on.  The sketch throws all elements of a set into
bins, round after round, and keeps for each bin the least value of the first
round that reached it; after as many rounds again every bin that is still empty
gets one of its own, so all coordinates fill.  Bands of coordinates give
buckets.  In each bucket every node is compared with the least one; where that
leaves a bucket in several components, the pairs across components whose
sketches agree enough are compared as well, in blocks that keep track of what
is connected and give back links, not pairs.  Comparison is always on whole sets.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm.rows import map_texts, unpacked
from foliomill.llm.text import LOWER_ASCII, STEP, hashed, mix, split_words, windows
from foliomill.plans.scratch import Scratch

WORDS, PERCENT = 3, 85
#: 24 bands of 4: a pair at 0.85 shares no bucket with probability (1 - 0.85**4)**24, about 2e-8.
BANDS, ROWS = 24, 4
#: Pairs across components are compared if enough sketch coordinates agree: a pair at the threshold falls short with this probability at most.
SHORT_OF = 1e-8
#: Shingles that a comparing task gets on average beside those of the centers.
GROUP_SHINGLES = 1 << 17
#: Nodes and shingles that a block of a bucket with several components has on average, whichever makes more blocks.
BLOCK_NODES, BLOCK_SHINGLES = 512, 1 << 20
#: A key of a join is hot if it has more than one row in HOT_KEYS, and more than HOT_ROWS (some 8 MB); so there are at most HOT_KEYS.
HOT_KEYS, HOT_ROWS = 4096, 200_000

SIGNATURE = T.StructType(
    [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("node", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.BinaryType()),
    ]
)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes."""
    split = split_words(texts, LOWER_ASCII)
    values = hashed(split.distinct)[split.codes] if len(split.codes) else np.zeros(0, np.uint64)
    rolled = windows(values, words)
    out = []
    for a, b in zip(split.offsets[:-1].tolist(), split.offsets[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(windows(values[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Fast similarity sketches (sets x size): all coordinates of a set that isn't empty are filled.

    A value holds its round in the high bits, so values of earlier rounds are
    smaller, and two sets agree in a coordinate with the probability of their
    similarity.
    """
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), size), most, np.uint64)
    open_ = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    flat = out.reshape(-1)
    for r in range(2 * size):
        if not len(open_):
            break
        elements = np.concatenate([sets[i] for i in open_])
        owner = np.repeat(open_, [len(sets[i]) for i in open_])
        value = mix(elements + np.uint64((2 * r + 1) * STEP & 0xFFFFFFFFFFFFFFFF))
        low = (value >> np.uint64(10)) | np.uint64(r << 54)
        if r < size:
            bin_ = ((mix(value) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        else:
            bin_ = np.full(len(owner), r - size)
        np.minimum.at(flat, owner * size + bin_, low)
        open_ = open_[(out[open_] == most).any(axis=1)]
    return out


def _bands(sketch: np.ndarray, bands: int) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, -1)
    key = np.zeros(parts.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
    for k in range(parts.shape[2]):
        key = mix(key * np.uint64(STEP) + parts[:, :, k])
    return key.astype(np.int64)


def signatures(docs: DataFrame, carry: list[str], words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Carried columns, set size, node (128-bit digest of the set; null for an empty one), band keys and sketch bytes."""

    def make():
        def work(texts: pa.Array) -> dict[str, list]:
            sets = shingle_sets(texts, words)
            sketch = sketches(sets, bands * rows)
            keys, low = _bands(sketch, bands), sketch.astype(np.uint8)
            full = [len(s) > 0 for s in sets]
            return {
                "n_shingles": [len(s) for s in sets],
                "node": [_digest(s) if ok else None for s, ok in zip(sets, full, strict=True)],
                "bands": [k.tolist() if ok else [] for k, ok in zip(keys, full, strict=True)],
                "sketch": [x.tobytes() if ok else None for x, ok in zip(low, full, strict=True)],
            }

        return work

    return unpacked(map_texts(docs, make, SIGNATURE, carry=carry), *SIGNATURE.fieldNames())


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def join_spread(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has at most one row for each ``key``; rows of a hot key stay where they are.

    The rows of ``right`` for the hot keys of ``left``, at most ``HOT_KEYS``
    of them as each has that share of the rows, are broadcast; only the rest
    is dealt by key.  ``left`` is a written table, so counting it is cheap.
    """
    total = left.count()
    if total <= HOT_ROWS:
        return left.join(right, key, how)
    many = left.groupBy(key).count().where(F.col("count") > max(HOT_ROWS, total // HOT_KEYS)).select(key)
    hot = left.join(F.broadcast(many), key, "left_semi").join(F.broadcast(right.join(F.broadcast(many), key, "left_semi")), key, how)
    return hot.unionByName(left.join(F.broadcast(many), key, "left_anti").join(right, key, how))


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node on an edge (a, b); connected nodes share a label.

    Each round relabels every node with the least label two steps away and
    keeps the edges between different labels.  The number of edges falls in
    each round and nothing but counts reaches the driver.
    """
    edges = scratch.table(edges.where("a <> b").distinct(), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = scratch.table(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("from")).agg(F.min("b").alias("b")).select("from", F.least("from", "b").alias("to"))
        least = scratch.table(least, "least")
        hop = least.alias("x").join(least.alias("y"), F.col("x.to") == F.col("y.from"), "left").select(F.col("x.from").alias("from"), F.coalesce("y.to", "x.to").alias("to"))
        hop = scratch.table(hop, "hop")
        labels_next = join_spread(labels, hop.withColumnRenamed("from", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels_next = scratch.table(labels_next, "labels")
        a, b = hop.select(F.col("from").alias("a"), F.col("to").alias("ta")), hop.select(F.col("from").alias("b"), F.col("to").alias("tb"))
        half = scratch.table(join_spread(edges, a, "a"), "half")
        fewer = join_spread(half, b, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a <> b").distinct()
        fewer = scratch.table(fewer, "edges")
        for old in (edges, labels, least, hop, half):
            scratch.drop(old)
        edges, labels = fewer, labels_next
        if edges.isEmpty():
            return labels


def _compare(words: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        sets = shingle_sets(table.column("text"), words)
        centers, members, roles = (table.column(c).to_pylist() for c in ("center", "node", "is_center"))
        # Another text under the same id is not the node that was asked for.
        real = [_digest(s) == m for s, m in zip(sets, members, strict=True)]
        of = {c: s for c, s, lead, ok in zip(centers, sets, roles, real, strict=True) if lead and ok}
        a, b = [], []
        for c, m, s, lead, ok in zip(centers, members, sets, roles, real, strict=True):
            if lead or not ok or c not in of:
                continue
            t = of[c]
            if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                continue
            both = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * both >= percent * (len(s) + len(t) - both):
                a.append(c)
                b.append(m)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _may_link(percent: int) -> str:
    """Sets whose sizes differ too much can't be similar enough."""
    return f"100 * least(size, center_size) >= {percent} * greatest(size, center_size)"


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (center, node) that are similar enough, compared on the shingles of their whole texts.

    A center's partners are dealt into chunks by their size, and its text goes
    to each of them, so a center with very many partners, or very long ones,
    is compared in many tasks.
    """
    pairs = scratch.table(pairs.where("center <> node").where(_may_link(percent)).select("center", "node", "size").distinct(), "pairs")
    chunks = pairs.groupBy("center").agg(F.ceil(F.sum("size") / F.lit(GROUP_SHINGLES)).alias("chunks"))
    total = pairs.agg(F.sum("size")).first()[0] or 0
    groups = max(1, -(-total // GROUP_SHINGLES))
    dealt = join_spread(pairs, chunks, "center").select("center", "node", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"))
    rows = dealt.withColumn("is_center", F.lit(False)).unionByName(dealt.select("center", F.col("center").alias("node"), "chunk", F.lit(True).alias("is_center")).distinct())
    rows = rows.withColumn("group", F.pmod(F.xxhash64("center", "chunk"), F.lit(groups)))
    keyed = rows.join(nodes.select("node", "lead"), "node")
    texts = docs.select(F.col("doc_id").alias("lead"), "text")
    compared = keyed.join(texts, "lead").select("group", "center", "node", "is_center", "text").groupBy("group").applyInArrow(_compare(words, percent), "a binary, b binary")
    made = scratch.table(compared, "verified")
    scratch.drop(pairs)
    return made


@cache
def least_agreeing(percent: int, size: int) -> int:
    """The largest number of ``size`` coordinates that a pair at ``percent`` falls short of with probability ``SHORT_OF`` at most."""
    p, below = percent / 100, 0.0
    for k in range(size):
        below += math.comb(size, k) * p**k * (1 - p) ** (size - k)
        if below > SHORT_OF:
            return k
    return size


def _candidates(table: pa.Table, bands: int, rows: int, percent: int) -> list[tuple[int, int, int]]:
    """Pairs (agreeing coordinates, i, j) of one block pair of a bucket that are still to be compared.

    They have different labels and sketches that agree enough, and share no
    earlier band key, where the pair was seen already.  (A sketch holds the
    low bytes only, which agree by chance without a common bucket.)
    """
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, bands * rows)
    keys = table.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, bands)
    _, number = np.unique(np.array(table.column("label").to_pylist(), dtype=object), return_inverse=True)
    block, first, second = table.column("block").to_numpy(), table.column("first")[0].as_py(), table.column("second")[0].as_py()
    index = table.column("index")[0].as_py()
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    out = []
    for i in left.tolist():
        js = right[right > i] if first == second else right
        js = js[number[js] != number[i]]
        agree = (sketch[js] == sketch[i]).sum(axis=1)
        fit = agree >= least_agreeing(percent, bands * rows)
        if fit.any():
            earlier = (keys[js[fit], :index] == keys[i, :index]).any(axis=1)
            out += [(int(n), i, j) for n, j, seen in zip(agree[fit].tolist(), js[fit].tolist(), earlier.tolist(), strict=True) if not seen]
    return out


def _flag(bands: int, rows: int, percent: int):
    """The nodes of a block pair that have a pair to compare."""

    def run(table: pa.Table) -> pa.Table:
        at = sorted({x for _, i, j in _candidates(table, bands, rows, percent) for x in (i, j)})
        return table.take(pa.array(at, pa.int64()))

    return run


def _link(words: int, percent: int, bands: int, rows: int):
    """Compare the pairs of a block pair on whole texts, the most alike first; pairs that are connected by then are left out.

    At most one edge for each node comes out, however many pairs there are.
    """

    def run(table: pa.Table) -> pa.Table:
        sets = shingle_sets(table.column("text"), words)
        node, label = table.column("node").to_pylist(), table.column("label").to_pylist()
        real = [_digest(s) == n for s, n in zip(sets, node, strict=True)]
        root = {x: x for x in label}

        def find(x: bytes) -> bytes:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        a, b = [], []
        for _, i, j in sorted(_candidates(table, bands, rows, percent), reverse=True):
            x, y = find(label[i]), find(label[j])
            if x == y or not (real[i] and real[j]):
                continue
            s, t = (sets[i], sets[j]) if len(sets[i]) < len(sets[j]) else (sets[j], sets[i])
            if 100 * len(s) < percent * len(t):
                continue
            at = np.searchsorted(t, s)
            both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
            if 100 * both >= percent * (len(s) + len(t) - both):
                root[max(x, y)] = min(x, y)
                a.append(node[i])
                b.append(node[j])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def near_duplicate_components(spark: SparkSession, docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for
    their sets of ``words``-word shingles (a text of fewer words is one
    shingle); ``component_id`` is the least doc_id that can be reached.  Null
    and wordless texts have no shingles and are alone.  Rows that share a
    doc_id are kept or dropped alike; a null doc_id takes the least id of its
    component, null if there is none, and isn't kept.

    Other columns of ``docs`` aren't read, whatever their names.

    Shuffled are the 16-byte nodes with their band keys, and the texts of
    documents with a candidate: a text goes to each chunk of each center it is
    compared with, and in the second round to each pair of blocks in which it
    has a pair still to compare, both of which may be as many as its bands.
    Tasks are bounded in shingles (``GROUP_SHINGLES``, ``BLOCK_SHINGLES``), a
    single longer text apart.
    """
    scratch = Scratch(spark, "near-duplicates")
    slim = docs.select("doc_id", "text")
    signed = scratch.table(signatures(slim, ["doc_id"], words, bands, rows), "signatures")
    grouped = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("lead"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = scratch.table(grouped, "nodes")
    banded = scratch.table(nodes.select("node", "size", F.explode("bands").alias("band")), "banded")
    least = F.min(F.struct(F.col("node").alias("center"), F.col("size").alias("center_size"))).alias("least")
    shared = scratch.table(banded.groupBy("band").agg(least, F.count("*").alias("many"), F.sum("size").alias("shingles")).where("many > 1").select("band", "least.*", "many", "shingles"), "buckets")
    members = scratch.table(join_spread(banded, shared, "band"), "members")
    scratch.drop(banded)
    named = nodes.where("lead is not null")
    edges = _verified(members, named, slim, words, percent, scratch)
    label_of = components(spark, edges, scratch)

    found = members.select("band", "node", "many", "shingles").join(label_of, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = scratch.table(found, "labelled")
    mixed = labelled.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band")
    rest = join_spread(labelled, mixed, "band", "left_semi").join(nodes.select("node", "sketch", "bands"), "node")
    blocks = F.ceil(F.greatest(F.col("many") / F.lit(BLOCK_NODES), F.col("shingles") / F.lit(BLOCK_SHINGLES))).cast("int")
    rest = rest.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("index", (F.array_position("bands", F.col("band")) - 1).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = rest.withColumn("other", each).select("band", "index", "node", "label", "sketch", "bands", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    flagged = scratch.table(paired.groupBy("band", "first", "second").applyInArrow(_flag(bands, rows, percent), paired.schema), "flagged")
    texts = slim.select(F.col("doc_id").alias("lead"), "text")
    whole = flagged.join(named.select("node", "lead"), "node").join(texts, "lead").select(*paired.columns, "text")
    more = scratch.table(whole.groupBy("band", "first", "second").applyInArrow(_link(words, percent, bands, rows), "a binary, b binary"), "linked")
    if not more.isEmpty():
        scratch.drop(label_of)
        label_of = components(spark, edges.union(more), scratch)

    class_of = scratch.table(nodes.select("node", "lead").join(label_of, "node", "left").withColumn("label", F.coalesce("label", "node")), "classes")
    component = class_of.groupBy("label").agg(F.min("lead").alias("component_id"))
    by_node = scratch.table(join_spread(class_of, component, "label").select("node", "component_id"), "components")
    for done in (nodes, shared, members, edges, label_of, labelled, flagged, more, class_of):
        scratch.drop(done)
    # Empty sets have no node; they would meet under the null key.
    alone = signed.where("node is null").select("node", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = join_spread(signed.select("doc_id", "n_shingles", "node").where("node is not null"), by_node, "node", "left").select(alone.columns).union(alone)
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = ROWS) -> DataFrame:
    """The documents with one of each component, with their own columns.

    Of equal rows (id and text) one stays.  Rows without an id all stay, as
    nothing could name the one to keep.  Null and wordless texts stay.
    """
    found = near_duplicate_components(spark, docs, words, percent, bands, rows)
    kept = found.where("kept").select(F.struct("doc_id").alias("key")).distinct()
    # Inside structs no column of the documents can clash with the key.
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.struct(docs["doc_id"].alias("doc_id")).alias("key"))
    named = whole.join(kept, "key", "left_semi").select("row.*").dropDuplicates(["doc_id", "text"])
    return named.union(docs.where(docs["doc_id"].isNull()))
