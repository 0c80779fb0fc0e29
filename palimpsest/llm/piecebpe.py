"""SentencePiece encoding and decoding for merge-type vocabularies with byte fallback and no normalisation.

Symbols of a text are merged by an agenda of adjacent pairs, ordered by score and then place. No piece of the vocabulary
reaches over the begin of a word, so words are encoded apart, each distinct one once. New words of an Arrow batch are
held against the sentencepiece library before they are used, and so are the decoded texts.
"""

from __future__ import annotations

import heapq
import re
from array import array
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, texts

SPACE = "▁"
#: Words whose ids a worker remembers, and code points of the longest of them: they bound its memory.
CACHE_WORDS, WORD_CHARS = 400_000, 64
WORDS = re.compile(" +[^ \n]*|\n[^ \n]*|[^ \n]+")
BYTES = re.compile(r"(?:\x00[0-9A-F]{2})+")


class PieceTable:
    """Vocabulary of a merge-type model: pieces, scores, kinds, read through the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        names = [sp.id_to_piece(i) for i in range(n)]
        odd = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.costs = {names[i]: -sp.get_score(i) for i in range(n) if i not in odd}
        self.ids = {names[i]: i for i in range(n) if i not in odd}
        self.byte_ids = [0] * 256
        self.surface = [x.replace(SPACE, " ") for x in names]
        for i in odd:
            self.surface[i] = " ⁇ " if i == self.unknown else ""
            if sp.is_byte(i):
                value = int(names[i][3:5], 16)
                self.byte_ids[value] = i
                self.surface[i] = f"\x00{value:02X}"
        if any(SPACE in x.lstrip(SPACE) or "\n" in x or "\0" in x for x in self.costs):
            raise ValueError("a piece reaches over the begin of a word or holds a line feed")
        if sp.decode(sp.encode("  a ")) != "  a ":
            raise ValueError("this vocabulary normalises white space")

    def merge(self, word: str) -> list[int]:
        """Ids of a word, spaces written as SPACE: the best pair is merged first, the leftmost of equals."""
        symbols: list[str] = list(word)
        n = len(symbols)
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        costs, push, pop = self.costs, heapq.heappush, heapq.heappop
        agenda = [(costs[p], i, p) for i, p in enumerate(map(add, symbols, symbols[1:])) if p in costs]
        heapq.heapify(agenda)
        while agenda:
            _, a, piece = pop(agenda)
            x, b = symbols[a], after[a]
            if not x or b >= n or x + symbols[b] != piece:
                continue  # one of them was merged meanwhile
            symbols[a], symbols[b] = piece, ""
            after[a] = c = after[b]
            if c < n:
                before[c] = a
                if (p := piece + symbols[c]) in costs:
                    push(agenda, (costs[p], a, p))
            if (d := before[a]) >= 0 and (p := symbols[d] + piece) in costs:
                push(agenda, (costs[p], d, p))
        out: list[int] = []
        for s in symbols:
            if s:
                i = self.ids.get(s)
                if i is None:
                    out += [self.byte_ids[x] for x in s.encode()]
                else:
                    out.append(i)
        return out


class Words(dict):
    """Ids of words, made when they are first asked for; new lists those that are still to be checked, long those that aren't kept beyond a batch."""

    def __init__(self, table: PieceTable):
        self.table, self.new, self.long = table, [], []

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.table.merge(word if word[:1] == "\n" else SPACE + word.replace(" ", SPACE))).tobytes()
        self[word] = ids
        self.new.append(word)
        if len(word) > WORD_CHARS:
            self.long.append(word)
        return ids


class PieceCodec:
    """Encoding and decoding as the library does them, with a bounded table of words.

    A word is written without the space before it; one that begins with a line feed has none.
    """

    def __init__(self, path: str, cache: int = CACHE_WORDS):
        self.table, self.cache = PieceTable(path), cache
        self.known = Words(self.table)

    def check_new(self) -> None:
        """Holds the new words against the library, and empties a table that has grown too large."""
        new, self.known.new = self.known.new, []
        for at in range(0, len(new), 512):
            part = new[at : at + 512]
            self.check(part, [self.known[w] for w in part])
        for word in self.known.long:
            self.known.pop(word, None)
        self.known.long = []
        if len(self.known) > self.cache:  # frequent words came early
            for word in [*self.known][self.cache // 2 :]:
                del self.known[word]

    def check(self, words: list[str], found: list[bytes]) -> None:
        """Raises AssertionError unless the library gives these ids for the words in a row, as one text.

        It puts a space before a text. A word that ends with spaces would reach into the next, so it ends its text.
        """
        run: list[str] = []
        ids: list[bytes] = []
        for word, own in zip([*words, None], [*found, b""], strict=True):
            if word is not None:
                run.append(word if word[:1] == "\n" else " " + word)
                ids.append(own)
            if run and (word is None or not word or word[-1] == " "):
                text = "".join(run)
                want = self.table.library.encode(text[1:] if text[0] == " " else text, num_threads=1)
                if text == " ":
                    want = [self.table.ids[SPACE]]  # an empty text stays empty
                if text[0] == "\n":
                    want = want[1:]
                if array("I", want).tobytes() != b"".join(ids):
                    raise AssertionError(f"the library encodes {text!r} otherwise")
                run, ids = [], []

    def words(self, text: str) -> list[str]:
        if "  " not in text and text[-1:] != " " and text[:1] not in (" ", "\n") and " \n" not in text:
            return text.replace("\n", " \n").split(" ")
        return [x[1:] if x[0] == " " else x for x in WORDS.findall(" " + text)]

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of each text, with begin and end."""
        begin, end = (array("I", [x]).tobytes() for x in (self.table.begin, self.table.end))
        out = []
        for x in batch:
            words = self.words(x.replace(SPACE, " ") if SPACE in x else x) if x else ()
            out.append(np.frombuffer(b"".join([begin, *map(self.known.__getitem__, words), end]), "<u4"))
        self.check_new()
        return out

    def decode_batch(self, batch: list[np.ndarray]) -> list[str]:
        """Texts of ids, each held against the library: raises AssertionError where it decodes otherwise."""
        out = [self.decode(x) for x in batch]
        if out != self.table.library.decode([x.tolist() for x in batch], num_threads=1):
            raise AssertionError("the library decodes otherwise")
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids vanish, the space before the first word too, bytes become characters."""
        parts = [*map(self.table.surface.__getitem__, ids.tolist())]
        text = "".join(parts)
        if "\0" in text:
            text = BYTES.sub(lambda m: unfolded(bytes.fromhex(m[0].replace("\0", ""))), text)
        return text[1:] if next(filter(None, parts), "")[:1] == " " else text


def unfolded(raw: bytes) -> str:
    """UTF-8, with one replacement character for each byte that isn't part of a character."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        return raw[: e.start].decode() + "�" + unfolded(raw[e.start + 1 :])


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One for each worker process and vocabulary."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, ids (little-endian unsigned 32-bit, with begin and end), decoded.

    Null text counts as empty and gives the two marks alone. Repeated rows stay. An empty table gives no rows. Other
    columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def f(batch: pa.RecordBatch) -> dict:
        pieces = codec(model_path)
        ids = pieces.encode(texts(batch.column("text")))
        return {"doc_id": batch.column("doc_id"), "ids": [x.tobytes() for x in ids], "decoded": pieces.decode_batch(ids)}

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(by_batch(f, schema, 256), "doc_id long, ids binary, decoded string")


def pieces_digest(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
