"""Near-duplicate groups by SimHash fingerprints, compared bit-sliced.

Fingerprints within the radius agree on some blocks of bits (pigeonhole), so only those that agree are put together.
There, bit b of 64 fingerprints at a time stands in one machine word (a vertical bit plane). A fingerprint is compared
with all others by exclusive-or of planes, and the distances of all 64 lanes are counted at once by carry-save adders.
Words of which every lane is beyond the radius are left out of the planes that follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, hex16, numbered, raw_texts, staged
from .components import connected_components
from .neardocs import similar_groups
from .setjoin import without

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints compared at once, and the most of a bucket that one task compares with itself.
TILE, SUB_BLOCK = 1024, 32_768


def fingerprint(raw: bytes, k: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of UTF-8 text: bit b is set if over half the shingles' XXH64 have it. No word: 0."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, seed)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    hashes = np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), (starts[k:] - 1).tolist(), strict=True)], np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp the fingerprint as a signed long. Null text counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def f(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(x) for x in raw_texts(batch.column("text"))], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": fps.view(np.int64)}

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(by_batch(f, schema), "doc_id long, fp long")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, words): bit j of word w of plane b is bit b of value 64 w + j."""
    n = len(values)
    bits = np.zeros((-(-n // 64) * 64, 64), np.uint8)
    bits[:n] = np.unpackbits(values.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within(planes: np.ndarray, queries: np.ndarray, lanes: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All (query, lane) of at most radius differing bits.

    Three bit counters and an overflow word hold the distances of 64 lanes: radius must be under 8.
    """
    words = planes.shape[1]
    q, w = (x.ravel() for x in np.meshgrid(np.arange(len(queries)), np.arange(words), indexing="ij"))
    ones, twos, fours, over = (np.zeros(len(q), np.uint64) for _ in range(4))
    flips = np.where((queries[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    for at in range(0, 64, 4):
        for b in (at, at + 2):  # a full adder takes two planes and the ones
            x, y = planes[b][w] ^ flips[q, b], planes[b + 1][w] ^ flips[q, b + 1]
            half = ones ^ x
            carry = (ones & x) | (half & y)
            ones = half ^ y
            carry2 = twos & carry
            twos ^= carry
            over |= fours & carry2
            fours ^= carry2
        dead = over | beyond(ones, twos, fours, radius)
        if at >= 12 and len(q):
            alive = dead != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not alive.all():
                q, w, ones, twos, fours, over = q[alive], w[alive], ones[alive], twos[alive], fours[alive], over[alive]
    near = ~(over | beyond(ones, twos, fours, radius))
    hit = np.nonzero(near)[0]
    bits = np.unpackbits(near[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    a, b = q[hit[row]], w[hit[row]] * 64 + bit
    return a[b < lanes], b[b < lanes]


def beyond(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit count is over the radius."""
    more, same = np.zeros_like(ones), np.full_like(ones, 0xFFFFFFFFFFFFFFFF)
    for plane, bit in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & bit:
            same &= plane
        else:
            more |= same & plane
            same &= ~plane
    return more


def joined_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels, where linked positions share the least one."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return labels
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        least = np.minimum(x, y)
        np.minimum.at(labels, x, least)
        np.minimum.at(labels, y, least)
        while not np.array_equal(labels, hop := labels[labels]):
            labels = hop


def spanning_links(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, representative) that connect all values connected within the radius: fewer than there are values."""
    labels = np.arange(len(values))
    planes = bit_planes(values)
    step = max(1, (1 << 18) // max(1, planes.shape[1]))
    for at in range(0, len(values), step):
        a, b = within(planes, values[at : at + step], len(values), radius)
        labels = joined_labels(labels, a + at, b)
    moved = np.nonzero(labels != np.arange(len(values)))[0]
    return values[moved], values[labels[moved]]


def masks(values: int, radius: int = RADIUS) -> list[int]:
    """Bits on which two values must agree: of r + radius blocks, each choice of r. More blocks, so longer keys, for more values; each is exact."""
    r = 1 + sum(values > 1 << x for x in (22, 30, 36))
    m = r + radius
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    out = [sum(x) for x in combinations(blocks, r)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def links(distinct: DataFrame, radius: int = RADIUS, sub_block: int = SUB_BLOCK) -> DataFrame:
    """Links (u, v) that connect all of the distinct values fp connected by steps within the radius.

    A bucket of more than sub_block values is dealt into parts, and each pair of parts is compared as a task's own share.
    """
    keys = masks(distinct.count(), radius)
    rows = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(k)) for k in keys))).alias("mask", "key"))
    sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / sub_block).cast("int"))
    rows = rows.join(sizes, ["mask", "key"])
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("mask", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "fp")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            values = np.unique(np.concatenate(held).view(np.uint64))
            u, v = spanning_links(values, radius)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, v)], schema=schema)

        open_: list[np.ndarray] = []
        key = None
        for batch in batches:
            columns = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("mask", "key", "i", "j", "fp")]
            if not batch.num_rows:
                continue
            change = np.nonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:4]]))[0] + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                this = tuple(int(c[a]) for c in columns[:4])
                if key is not None and this != key:  # a bucket is whole: small ones share a tile
                    n = sum(map(len, open_))
                    if size and size + n > TILE:
                        yield from flush()
                        held, size = [], 0
                    held, size, open_ = held + open_, size + n, []
                key = this
                open_.append(columns[4][a:b])
        held = held + open_
        if held:
            yield from flush()

    order = ["mask", "key", "i", "j"]
    return rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A row per document of docs (doc_id, text): doc_id, fingerprint (hex), component_id.

    component_id is the smallest doc_id among the documents reachable by links of at most radius differing bits; all
    texts without a word have fingerprint zero and are linked like any other. Equal fingerprints are compared once. Null
    text counts as empty; a row with a null doc_id belongs to its component but doesn't name it (null if no other does).
    Repeated rows stay. An empty table gives no rows. Other columns are not read.
    """
    prints = staged(fingerprints(docs), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(links(distinct.select("fp"), radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(least, "component").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of docs (doc_id, text, other columns) from each group of near duplicates: that of the smallest doc_id (null first), then of the smallest hash of the text; of equal ones any.

    Documents are linked whose fingerprints differ in at most radius bits, or whose sets of five-word shingles have a
    Jaccard similarity of 0.8 or more: fingerprints find the close copies, an exact join the links that they miss. Null
    and empty texts are alike. Null doc_ids and repeated rows are rows like others. An empty table gives no rows. All
    columns are kept as they are.
    """
    rows = numbered(docs, 1 << 62)
    texts = rows.select(F.col("no").alias("id"), F.col("row.text").cast("string").alias("text"))
    close = near_duplicates(texts.withColumnRenamed("id", "doc_id"), radius)
    labels = staged(close.select(F.col("doc_id").alias("id"), F.col("component_id").alias("component")), "near-labels")
    labels = similar_groups(texts, labels)
    return without(rows, labels.where("id <> component").select(F.col("id").alias("no")), ["no"]).select("row.*")
