"""Packing of tokenised documents into sequences of a fixed length.

Documents are tokenised in Arrow batches, cut at the capacity, and dealt at random, by hashes of what they are, into groups
of bounded size. Each group is packed alone by first-fit decreasing, with a tournament tree of the free room in its bins
to find the first that fits. Groups are independent, so one shuffle of the pieces is all that is moved.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

CAPACITY = 2048
#: Bytes of text in a group, on average: bounds the memory of the task that packs it. Tails of 4 MB fill some 500 sequences.
GROUP_BYTES = 4 << 20
#: Bytes of parts and words with their ids that a worker remembers.
CACHE_BYTES = 128 << 20
#: Bytes that an entry takes besides its word and ids; code points of the longest word that is remembered.
ENTRY_BYTES, WORD_CHARS = 200, 64


class Remembered:
    """Ids of words, bounded in bytes but for those of the last batch. When it is full the newer half goes: frequent words come early."""

    def __init__(self, limit: int):
        self.ids: dict[str, bytes] = {"": b""}
        self.limit, self.size = limit, 0

    def missing(self, words: set[str]) -> list[str]:
        """The words that aren't remembered; makes room first, so that the others stay until the next call."""
        if self.size > self.limit:
            for w in [*self.ids][len(self.ids) // 2 + 1 :]:
                self.size -= ENTRY_BYTES + len(w) + len(self.ids.pop(w))
        return [*words.difference(self.ids)]

    def add(self, words: list[str], ids: list[bytes]) -> None:
        if words and max(map(len, words)) > WORD_CHARS:
            short = [x for x in zip(words, ids, strict=True) if len(x[0]) <= WORD_CHARS]
            words, ids = [x[0] for x in short], [x[1] for x in short]
        self.ids.update(zip(words, ids, strict=True))
        self.size += ENTRY_BYTES * len(words) + sum(map(len, words)) + sum(map(len, ids))


class WordTokenizer:
    """Ids by the tokenizers library. Where its vocabulary drops white space and case, its own rule splits texts into parts here.

    Each distinct part is encoded once and remembered. New parts are encoded many at a time as one text, and told apart by
    their word ends. Texts of other code points than PLAIN are encoded by words between spaces, each remembered as well.
    Any other vocabulary encodes whole texts.
    """

    # The vocabulary's rules for normalising and splitting, on which the way by parts rests.
    NORMALIZERS = ["NFC", "Replace", "Lowercase"]
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Code points whose case, class and composition any version of Unicode has alike: white space, Latin, punctuation.
    PLAIN = re.compile("[\\x09-\\x0d\\x20-\\x7e\\xa1-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]*")
    #: The rule for plain text in lower case.
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\w\s]|_)+")

    def __init__(self, path: str, cache: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encode = getattr(self.encoder, "encode_batch_fast", self.encoder.encode_batch)
        self.kind = np.uint16 if self.encoder.get_vocab_size() <= 1 << 16 else np.uint32
        self.words, self.parts = Remembered(cache // 4), Remembered(cache - cache // 4)
        rules = json.loads(self.encoder.to_str())
        normal, split = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}
        steps, suffix = split.get("pretokenizers") or [{}], rules["model"].get("end_of_word_suffix")
        same = [x["type"] for x in normal.get("normalizers", [])] == self.NORMALIZERS and steps[0].get("pattern", {}).get("Regex") == self.SPLIT
        self.by_parts = bool(same and suffix)
        self.special = tuple(x["content"] for x in rules.get("added_tokens", []))
        self.ends = np.zeros(self.encoder.get_vocab_size(), bool)
        if self.by_parts:
            self.ends[[i for x, i in self.encoder.get_vocab().items() if x.endswith(suffix)]] = True

    def library(self, items: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for at in range(0, len(items), 4096) for x in self.encode(items[at : at + 4096], add_special_tokens=False)]

    def of_parts(self, new: list[str]) -> list[bytes]:
        """Ids of parts, encoded as one text of 256 at a time; a part ends with the only word end among its ids."""
        out: list[bytes] = []
        groups = [new[at : at + 256] for at in range(0, len(new), 256)]
        for parts, x in zip(groups, self.encode([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(x.ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(parts) and (not len(cuts) or cuts[-1] == len(ids)):
                raw, width = ids.tobytes(), ids.itemsize
                edges = [0, *(cuts * width).tolist()]
                out += [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
            else:
                out += self.library(parts)
        return out

    def joined(self, split: list[list[str]], table: Remembered, encode: Callable[[list[str]], list[bytes]]) -> list[np.ndarray]:
        """Ids of texts that are split into pieces; encode makes those of pieces that aren't remembered."""
        new = table.missing(set().union(*split))
        made = encode(new)
        table.add(new, made)
        get = table.ids.__getitem__
        if max(map(len, new), default=0) > WORD_CHARS:  # too long to be remembered
            long = {w: x for w, x in zip(new, made, strict=True) if len(w) > WORD_CHARS}
            get = lambda w: long[w] if len(w) > WORD_CHARS else table.ids[w]
        return [np.frombuffer(b"".join(map(get, pieces)), self.kind) for pieces in split]

    def __call__(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = []
        for at in range(0, len(batch), 256):
            some = batch[at : at + 256]
            if not self.by_parts:
                out += [np.frombuffer(x, self.kind) for x in self.library(some)]
                continue
            plain = [self.PLAIN.fullmatch(x) is not None and not any(y in x for y in self.special) for x in some]
            parts = iter(self.joined([self.PARTS.findall(x.lower()) for x, y in zip(some, plain, strict=True) if y], self.parts, self.of_parts))
            words = iter(self.joined([x.replace("\n", " ").split(" ") for x, y in zip(some, plain, strict=True) if not y], self.words, self.library))
            out += [next(parts if y else words) for y in plain]
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process and vocabulary."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class TournamentTree:
    """Free room of bins 0, 1, ... in a complete binary tree of maxima."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """Takes room in the first bin that has it; the bin and the room it had."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < length:
                at += 1
        leaf, room = at - self.leaves, most[at]
        most[at] = room - length
        while at > 1:
            at >>= 1
            a, b = most[2 * at], most[2 * at + 1]
            new = a if a > b else b
            if most[at] == new:
                break
            most[at] = new
        return leaf, room


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """For pieces in falling order of length: each one's bin, and its offset there."""
    tree = TournamentTree(len(lengths), capacity)
    bins, offsets = [], []
    for n in lengths:
        leaf, room = tree.place(n)
        bins.append(leaf)
        offsets.append(capacity - room)
    return bins, offsets


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("grp", pa.int64())])
PLACED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PLACED_DDL = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"


def dealt(doc_id: int | None, ids: np.ndarray, repeat: int, start: int, groups: int) -> int:
    """The group of a piece: a hash of its document, the same whenever and wherever it is worked out.

    The last piece of a document stands for it; whole sequences before it, which fill a bin each, are dealt apart, so that
    a document of any length is spread. repeat tells repeated rows of one batch apart.
    """
    seed = xxhash.xxh64_intdigest(b"" if doc_id is None else struct.pack("<q", doc_id), repeat)
    return xxhash.xxh64_intdigest(ids.tobytes(), seed ^ start) % groups


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Every document of docs (doc_id, text) in pieces of at most capacity ids, packed into sequences.

    Returns a row per piece: doc_id, start and length (in the document's ids), doc_tokens, ids (little-endian unsigned
    32-bit), sequence_id, and offset in that sequence; the pieces of a sequence leave no gap. Null or empty text is a
    document of the end id alone. Repeated rows and ids are documents of their own. A null doc_id stays null. Text that
    isn't valid UTF-8 is read with U+FFFD for what is damaged. An empty table gives no rows. Other columns of docs are not
    read.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = read.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    groups = max(1, -(-(8 * size["n"] + (size["bytes"] or 0)) // group_bytes))
    wide = np.dtype("<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path)
        end = np.array([end_id], encode.kind)
        for batch in batches:
            seen: Counter = Counter()
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list] = [[] for _ in PIECES]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(texts(part.column("text"))), strict=True):
                    ids = np.concatenate([ids, end])
                    same = (doc_id, xxhash.xxh64_intdigest(ids.tobytes()))
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        group = dealt(doc_id, piece, seen[same], start, groups)
                        for column, x in zip(out, (doc_id, start, len(piece), len(ids), piece.tobytes(), group), strict=True):
                            column.append(x)
                    seen[same] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, PIECES, strict=True)], schema=PIECES)

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(table.column("length").to_pylist(), capacity)
        lengths, ids = table.column("length").to_pylist(), table.column("ids").to_pylist()
        kind = np.dtype("<u2") if lengths and len(ids[0]) == 2 * lengths[0] else wide
        first = table.column("grp")[0].as_py() << 32
        return pa.Table.from_arrays(
            [*(table.column(x).combine_chunks() for x in ("doc_id", "start", "length", "doc_tokens")), pa.array([np.frombuffer(x, kind).astype(wide).tobytes() for x in ids], pa.binary()), pa.array([first + b for b in bins], pa.int64()), pa.array(offsets, pa.int64())],
            schema=PLACED,
        )

    pieces = read.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary, grp long")
    return pieces.groupBy("grp").applyInArrow(place, PLACED_DDL)


def packed_digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
