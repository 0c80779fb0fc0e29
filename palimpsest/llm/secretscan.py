"""Secret scans: fixed patterns, and candidates confirmed by their structure.

Runs of base64 or hexadecimal text, over line breaks and from any place in them, are decoded as far as the lengths at their
begin say, and reported only if the bytes are a key: DER whose nested lengths add up to a known key layout, an OpenSSH key
whose length-prefixed fields fill it, or a signed token whose header names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_batch, texts

#: Kinds in the order in which spans of one start are listed. Base kinds, then those of the method.
KINDS = ("assign", "access", "hex", "derkey", "sshkey", "jwt")

# [ -~] etc. are not needed: letters are ASCII in either case by re.ASCII
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Where the base64 form of a DER sequence of 64 bytes or more, or of an OpenSSH key, may begin: tag, length, then a number or a sequence.
START64 = re.compile(r"M[C-I][A-Za-z0-9+/_-]{14}|b3BlbnNzaC1rZXktdjEA")
#: Parts of a base64 text over several lines, as they stand, escaped, or as pieces of a quoted string.
LINE64, BREAK64 = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"""(?:[\x20\t]*["']?[\x20\t]*[+\\]?[\x20\t]*\r?\n[\x20\t]*["']?|(?:\\r)?\\n(?:["']?[\x20\t]*[+\\]?[\x20\t]*\r?\n[\x20\t]*["']?)?)""")
START_HEX = re.compile(r"30(?:[2-7][0-9A-Fa-f]|8[1-3])(?=[0-9A-Fa-f]{28})|6[Ff]70656[Ee]7373682[Dd]6[Bb]65792[Dd]763100")
HEX_RUN = re.compile(r"[0-9A-Fa-f]+")
#: The longest key that is looked for, in characters.
KEY_CHARS = 1 << 17
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)KEY-----((?:\s|\\[nr])*(?:(?:Proc-Type|DEK-Info):[\x20-\x5b\x5d-\x7e]*(?:\s|\\[nr])+)*(?:[A-Za-z0-9+/=\s]|\\[nr])*)-----END \1KEY-----")
SEALED = re.compile(r"Proc-Type:\s*4,\s*ENCRYPTED(?:\s|\\[nr])+DEK-Info:\s*(DES|AES|CAMELLIA|SEED|IDEA|RC2)[A-Z0-9-]*,\s*(?:[0-9A-Fa-f]{16}){1,2}(?:\s|\\[nr])+")
#: Names of algorithms in headers of signed tokens (fixed values, RFC 7518 and RFC 8037).
ALGORITHMS = {"HS256", "HS384", "HS512", "RS256", "RS384", "RS512", "ES256", "ES384", "ES512", "PS256", "PS384", "PS512", "EdDSA", "none"}


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The items (tag, content) that fill data exactly, in distinguished encoding; None if they don't."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data) or data[at] == 0:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
            if n < 0x80:
                return None
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def is_der_key(data: bytes) -> bool:
    """One of the layouts of keys: PKCS#1 private or public, PKCS#8 plain or encrypted, SEC1, SubjectPublicKeyInfo.

    Public keys are no secrets: they are not reported.
    """
    if len(data) < 32 or data[0] != 0x30:
        return False
    outer = der_items(data)
    if not outer or len(outer) != 1:
        return False
    items = der_items(outer[0][1])
    if not items:
        return False
    tags = [t for t, _ in items]
    if tags[:9] == [2] * 9 and items[0][1] in (b"\0", b"\1"):
        return True  # RSA: version and eight numbers
    if tags == [2] * 6 and items[0][1] == b"\0":
        return True  # DSA
    if tags[:3] == [2, 0x30, 4] and items[0][1] in (b"\0", b"\1"):  # PKCS#8: version, algorithm, key
        algorithm = der_items(items[1][1])
        return bool(algorithm) and algorithm[0][0] == 6
    if tags[:2] == [2, 4] and items[0][1] == b"\1" and len(items[1][1]) in (24, 28, 32, 48, 66):
        return True  # elliptic curve
    if tags == [0x30, 4]:  # encrypted PKCS#8
        algorithm = der_items(items[0][1])
        return bool(algorithm) and algorithm[0][0] == 6 and len(items[1][1]) >= 32
    return False


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key: cipher, key derivation, its options, number of keys, public and private part, each with its length."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if any(field() is None for _ in range(3)) or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= keys <= 16 and all(field() is not None for _ in range(keys + 1)) and at == len(data)


def decoded64(run: str) -> bytes | None:
    run = run.rstrip("=")
    run = run.replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def key_kind(data: bytes | None) -> str | None:
    if data is None:
        return None
    return "derkey" if is_der_key(data) else "sshkey" if is_ssh_key(data) else None


def is_signed_token(found: str) -> bool:
    """The header is JSON that names an algorithm, the payload JSON, and there is a signature unless the algorithm is none."""
    head, body, signature = found.split(".")
    try:
        header = json.loads(decoded64(head) or b"")
        if not isinstance(header, dict) or header.get("alg") not in ALGORITHMS:
            return False
        if not isinstance(json.loads(decoded64(body) or b""), dict):
            return False
    except (ValueError, RecursionError):
        return False
    return header["alg"] == "none" or len(decoded64(signature) or b"") >= 16


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the fixed patterns, leftmost and without overlap within a kind; offsets in code points."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def der_size(head: bytes) -> int | None:
    """Bytes of the DER sequence that begins so, of 32 to 2 ** 16 bytes; None if no key begins so."""
    if len(head) < 8 or head[0] != 0x30:
        return None
    n, at = head[1], 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 3 or head[2] == 0:
            return None
        n, at = int.from_bytes(head[2 : 2 + k], "big"), 2 + k
    follows = head[at : at + 3] in (b"\x02\x01\x00", b"\x02\x01\x01") or head[at] == 0x30
    return at + n if follows and 32 <= at + n <= 1 << 16 else None


def ssh_size(data: bytes) -> int | None:
    """Bytes of the OpenSSH key that data begins with, by its fields; None if it has no such begin."""
    at = len(b"openssh-key-v1\0")
    for i in range(3):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return None
    for _ in range(keys + 1):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at if at <= len(data) else None


def key_at(text: str, start: int) -> tuple[int, int, str] | None:
    """The span of a key whose base64 form begins at start, over line breaks; None if its lengths or layout are wrong."""
    ssh = text.startswith("b3", start)
    size = None if ssh else der_size(base64.b64decode(text[start : start + 16].translate(URL_SAFE)))
    if not ssh and size is None:
        return None
    want = KEY_CHARS if ssh else -(-size * 8 // 6)
    runs: list[tuple[int, str]] = []
    have, at = 0, start
    while have < want and (m := LINE64.match(text, at)):
        runs.append((at, m[0][: want - have]))
        have += len(runs[-1][1])
        if not (br := BREAK64.match(text, m.end())):
            break
        at = br.end()
    joined = "".join(x for _, x in runs).translate(URL_SAFE)
    if ssh:
        data = base64.b64decode(joined[: len(joined) // 4 * 4] + {2: joined[-2:] + "==", 3: joined[-3:] + "="}.get(len(joined) % 4, ""))
        if (size := ssh_size(data)) is None:
            return None
        want = -(-size * 8 // 6)
    if have < want:
        return None
    kind = key_kind(base64.b64decode(joined[:want] + "=" * (-want % 4))[:size])
    if kind is None:
        return None
    for at, run in runs:
        if want <= len(run):
            end = at + want
            break
        want -= len(run)
    while end < len(text) and text[end] == "=" and end - at < 1 << 17 and text[end - 2 : end] != "==":
        end += 1
    return start, end, kind


URL_SAFE = str.maketrans("-_", "+/")


def hex_key_at(text: str, start: int, end: int) -> tuple[int, int, str] | None:
    """The same for a hexadecimal form in the run of digits that ends at end."""
    head = bytes.fromhex(text[start : start + min(32, (end - start) // 2 * 2)])
    if head[0] == 0x30:
        size = der_size(head)
    else:
        size = ssh_size(bytes.fromhex(text[start : start + min(KEY_CHARS, (end - start) // 2 * 2)]))
    if size is None or start + 2 * size > end:
        return None
    kind = key_kind(bytes.fromhex(text[start : start + 2 * size]))
    return (start, start + 2 * size, kind) if kind else None


def structural_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans whose decoded bytes are confirmed as keys or signed tokens."""
    out = []
    if "eyJ" in text:
        out += [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if is_signed_token(m[0])]
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            body = SEALED.sub("", m[2], 1)
            data = decoded64("".join(body.replace("\\n", " ").replace("\\r", " ").split()))  # as in JSON and source strings
            if body != m[2]:  # sealed by a cipher: whole blocks, which nothing else confirms
                kind = "derkey" if data and len(data) >= 32 and len(data) % 8 == 0 else None
            else:
                kind = key_kind(data)
            if kind:
                out.append((m.start(), m.end(), kind))
    # DER begins with 0x30 and a length, OpenSSH keys with their name: so begins their base64 or hexadecimal form
    at = 0
    while m := START64.search(text, at):
        if found := key_at(text, m.start()):
            out.append(found)
        at = found[1] if found else m.start() + 1
    if "30" in text or "6f70656e7373682d" in text.lower():
        for run in HEX_RUN.finditer(text):
            at = run.start() if run.end() - run.start() >= 64 else run.end()
            while m := START_HEX.search(text, at, run.end()):
                if found := hex_key_at(text, m.start(), run.end()):
                    out.append(found)
                at = found[1] if found else m.start() + 1
    return out


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(set(spans), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def as_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists kind:start:end of base and confirmed spans by start, then kind; base_sha256 is that of the base spans so
    listed. Offsets are code points of the whole text, ends exclusive. Null text counts as empty; no span gives an empty
    list. Repeated rows stay. An empty table gives no rows. Other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_assign", "n_access", "n_hex")), ("base_sha256", pa.string()), ("spans", pa.string())])

    def f(batch: pa.RecordBatch) -> dict:
        out: dict = {x: [] for x in schema.names} | {"doc_id": batch.column("doc_id")}
        for text in texts(batch.column("text")):
            base = ordered(base_spans(text))
            for kind in KINDS[:3]:
                out[f"n_{kind}"].append(sum(x[2] == kind for x in base))
            out["base_sha256"].append(hashlib.sha256(as_text(base).encode()).hexdigest())
            out["spans"].append(as_text(ordered(base + structural_spans(text))))
        return out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(by_batch(f, schema), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask_secrets(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with every span of a text replaced by its kind in brackets, and n_secrets, the number of spans.

    Null text stays null, with 0; empty text stays empty. Overlapping spans become one. Repeated rows stay. An empty table
    gives no rows. A column named n_secrets is replaced, others are kept.
    """
    kept = docs.drop("n_secrets")

    def f(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                new, counts = [], []
                for text in part.column(column).to_pylist():
                    spans = ordered(base_spans(text) + structural_spans(text)) if text else []
                    new.append(masked(text, spans) if spans else text)
                    counts.append(len(spans))
                arrays = [pa.array(new, part.schema.field(x).type) if x == column else part.column(x) for x in part.schema.names]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64())], names=[*part.schema.names, "n_secrets"])

    return kept.mapInArrow(f, T.StructType([*kept.schema.fields, T.StructField("n_secrets", T.LongType())]))
