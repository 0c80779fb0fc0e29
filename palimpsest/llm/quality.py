"""Quality rules: fixed repetition and length rules, then a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed byte n-grams are counted: one over trusted target documents (labelled good), one over the
whole raw corpus. A document's score is the mean log ratio of its n-grams, so its length doesn't matter, and every
document is held against one threshold; nothing is drawn at random.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_batch, raw_texts

GRAM, BUCKETS = 4, 1 << 16
#: Trusted labelled documents at most: those whose ids hash lowest. It bounds what is broadcast.
TARGET_DOCUMENTS = 20_000
#: Least mean log ratio of a kept document.
THRESHOLD = -0.25
#: The target's counts are smoothed by so many n-grams dealt as in the raw corpus.
PRIOR = 65_536.0
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = b"#*$%&|<>"


def buckets(raw: bytes) -> np.ndarray:
    """The bucket of every byte 4-gram."""
    if len(raw) < GRAM:
        return np.zeros(0, np.uint32)
    b = np.frombuffer(raw, np.uint8)
    x = b[3:].astype(np.uint32)
    for at in (2, 1, 0):
        x <<= np.uint32(8)
        x |= b[at : len(b) - 3 + at]
    x *= np.uint32(2654435761)
    x >>= np.uint32(16)
    return x


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more in the text, the first one included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter([known.setdefault(w, len(known)) for w in words], np.uint64, len(words))
    if len(known) == len(words):
        return 0
    hashes = np.zeros(n, np.uint64)
    for k in range(size):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return 0
    at = np.sort(order[np.concatenate([same, [False]]) | np.concatenate([[False], same])])
    windows = np.lib.stride_tricks.sliding_window_view(ids, size)[at]  # equal hashes are held against the words themselves
    by_words = np.lexsort(windows.T)
    equal = (windows[by_words][1:] == windows[by_words][:-1]).all(1)
    found = at[by_words[np.concatenate([equal, [False]]) | np.concatenate([[False], equal])]]
    edge = np.zeros(len(words) + 1, np.int64)
    edge[found] += 1
    edge[found + size] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_features(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8 text; words lie between ASCII white space."""
    words = raw.split()
    joined = b"".join(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(joined.decode("utf-8", "replace")), sum(joined.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))), len(lines) - len(set(lines)), repeated_words(words)


def gram_counts(docs: DataFrame, trusted: DataFrame | None) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket over all of docs, and over those of trusted ids. Every task sums its own rows first; the driver gets one row per bucket."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if trusted is None:
        read = read.select("text", F.lit(False).alias("trusted"))
    else:
        read = read.join(F.broadcast(trusted.withColumn("trusted", F.lit(True))), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for flag in (False, True):
                    found = [buckets(x) for x, t in zip(raw_texts(part.column("text")), part.column("trusted").to_pylist(), strict=True) if t == flag]
                    if found:
                        n = np.bincount(np.concatenate(found), minlength=BUCKETS)
                        total[0] += n
                        if flag:
                            total[1] += n
        at = np.nonzero(total[0])[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[0][at]), pa.array(total[1][at])], schema=schema)

    rows = read.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = rows.column("bucket").to_numpy()
    raw[at], target[at] = rows.column("raw").to_numpy(), rows.column("target").to_numpy()
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log of target over raw probability for each bucket; 0 everywhere if there is no target."""
    if not target.sum():
        return np.zeros(len(raw), np.float32)
    p = (raw + 1) / (raw + 1).sum()
    return np.log((target + prior * p) / (target.sum() + prior) / p).astype(np.float32)


def trusted_ids(labels: DataFrame, most: int = TARGET_DOCUMENTS) -> DataFrame:
    """Ids of documents that are labelled good, at most so many: those of the lowest hashes."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, base_failed boolean, kept boolean"


def quality_rules(docs: DataFrame, labels: DataFrame | None, threshold: float = THRESHOLD, target_documents: int = TARGET_DOCUMENTS) -> DataFrame:
    """docs (doc_id, text, any other columns) with a verdict for each row.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (over the whole text), score (mean log ratio of the
    n-grams; 0 for a text of fewer than 4 bytes, damaged UTF-8 taken as it is), base_failed and kept, in place of columns of those names. labels
    (doc_id, quality) names the trusted documents; without any, all scores are 0 and only the base rules decide. Null or
    empty text has no word and fails. Repeated rows get equal verdicts. An empty table gives no rows.
    """
    ratios = log_ratios(*gram_counts(docs, None if labels is None else trusted_ids(labels, target_documents)))
    names = [x.split()[0] for x in SCORED.split(", ")]
    kept = docs.drop(*names)
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    added = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in SCORED.split(", ")])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list] = [[] for _ in added]
                for raw in raw_texts(part.column("text")):
                    n, chars, symbols, dup, repeated = base_features(raw)
                    grams = buckets(raw)
                    score = float(ratios[grams].mean(dtype=np.float64)) if len(grams) else 0.0
                    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
                    for column, x in zip(out, (n, chars, symbols, dup, repeated, score, failed, not failed and score >= threshold), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, f.type) for x, f in zip(out, added, strict=True))], names=[*part.schema.names, *names])

    return kept.mapInArrow(judge, T.StructType([*kept.schema.fields, *T.StructType.fromDDL(SCORED).fields]))
