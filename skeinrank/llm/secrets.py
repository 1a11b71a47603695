"""Secret scans with structural confirmation.

Base patterns (assignments, access keys, hex strings) report by shape.  The method adds spans that only
structure can confirm: long base64, base64url or hex candidates are decoded, and reported as

* ``jwt``: a dotted token whose header decodes to a JSON object with ``alg``,
* ``der``: bytes that parse as a DER key (nested lengths must end exactly at their parents' ends, and the
  members must be those of a PKCS#1, PKCS#8, SEC 1 or SubjectPublicKeyInfo key),
* ``ssh``: an OpenSSH private-key container or a length-prefixed SSH key blob,
* ``pem``: a PEM block with a key label whose body passes one of the above, or is whole cipher blocks under
  encryption headers.

Base64 may be wrapped: lines of one length and a last one that isn't longer are tried together; hex may mix its cases.

Only texts with a candidate run are looked at in Python; runs are found over the raw bytes of a batch.
Edge cases: null or empty texts have no spans; spans are code points, end exclusive; equal texts give equal
rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as at

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "der", "ssh", "pem")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
#: The words that the assign pattern starts with, and the labels of PEM keys.
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
PEM_BEGIN = re.compile(r"-----BEGIN ((?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY)-----")
_PEM_HEADER = re.compile(r"[A-Za-z0-9-]+:[^\n]*(?:\n[ \t][^\n]*)*\n")
_CIPHER = re.compile(r"DEK-Info:\s*([A-Z0-9-]+)\s*,\s*([0-9A-Fa-f]+)")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{32,}+(?:\r?\n[A-Za-z0-9+/]++)++={0,2}+")
#: A text with a run of so many characters that keys are written in is looked at; the shortest that counts has 32.
SUSPECT_RUN = 16
_RUN = at.byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x2B, 0x2B), (0x2F, 0x2F), (0x5F, 0x5F), (0x3D, 0x3D), (0x2D, 0x2E)])
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{32,}")
_B64 = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
_HEX_ANY = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{64,}(?![0-9A-Za-z])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")


def b64(text: str) -> bytes | None:
    """Bytes of base64 or base64url text with or without padding; None if it isn't."""
    core = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(core) % 4 == 1:
        return None
    try:
        return base64.b64decode(core + "=" * (-len(core) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_item(data: bytes, at_: int, end: int) -> tuple[int, int, int] | None:
    """(tag, content start, content end) of the definite-length item at a position, if it ends by ``end``."""
    if at_ + 2 > end:
        return None
    tag, first = data[at_], data[at_ + 1]
    start, size = at_ + 2, first
    if first & 0x80:
        n = first & 0x7F
        if not 1 <= n <= 4 or start + n > end:
            return None
        size = int.from_bytes(data[start : start + n], "big")
        if size < 0x80 or data[start] == 0:  # DER takes the shortest form
            return None
        start += n
    return (tag, start, start + size) if start + size <= end else None


def der_children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The items that fill [start, end) exactly."""
    out = []
    while start < end:
        item = der_item(data, start, end)
        if item is None:
            return None
        out.append(item)
        start = item[2]
    return out


def is_der_key(data: bytes) -> bool:
    top = der_item(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    kids = der_children(data, top[1], top[2])
    if not kids or len(kids) < 2:
        return False
    tags = [t for t, _, _ in kids]
    algorithm = lambda k: (inner := der_children(data, k[1], k[2])) and inner[0][0] == 0x06
    version = lambda k: k[2] - k[1] == 1 and data[k[1]] <= 1
    if tags[0] == 0x02 and version(kids[0]):
        if len(tags) >= 9 and set(tags[:9]) == {0x02}:  # RSA private: version and eight integers
            return True
        if len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:  # PKCS#8
            return bool(algorithm(kids[1]))
        return len(tags) >= 2 and tags[1] == 0x04 and kids[1][2] - kids[1][1] in (16, 24, 28, 32, 48, 66)  # SEC 1
    if tags == [0x30, 0x03]:  # SubjectPublicKeyInfo: an algorithm and a bit string without unused bits
        return bool(algorithm(kids[0])) and kids[1][2] > kids[1][1] and data[kids[1][1]] == 0
    if tags == [0x30, 0x04]:  # encrypted PKCS#8
        return bool(algorithm(kids[0]))
    return tags == [0x02, 0x02] and kids[0][2] - kids[0][1] >= 64  # RSA public: modulus and exponent


def is_ssh_key(data: bytes) -> bool:
    if data.startswith(b"openssh-key-v1\x00"):
        return True
    fields, at_ = [], 0
    while at_ + 4 <= len(data):
        n = int.from_bytes(data[at_ : at_ + 4], "big")
        if at_ + 4 + n > len(data):
            return False
        fields.append(data[at_ + 4 : at_ + 4 + n])
        at_ += 4 + n
    return at_ == len(data) and len(fields) >= 2 and re.fullmatch(rb"(ssh|ecdsa)-[a-z0-9@.-]+", fields[0]) is not None


def is_token_header(part: str) -> bool:
    try:
        header = json.loads(b64(part) or b"")
    except (ValueError, UnicodeDecodeError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def pem_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Blocks with a key label whose body is a key, or whole cipher blocks under encryption headers."""
    for m in PEM_BEGIN.finditer(text):
        end = text.find("-----", m.end())
        foot = f"-----END {m[1]}-----"
        if end < 0 or not text.startswith(foot, end):
            continue
        body, cipher, at_ = text[m.end() : end].replace("\r\n", "\n").lstrip("\n"), None, 0
        while h := _PEM_HEADER.match(body, at_):
            cipher, at_ = _CIPHER.match(h[0]) or cipher, h.end()
        data = b64(re.sub(r"\s+", "", body[at_:]))
        if not data:
            continue
        if cipher:
            block = 8 if "DES" in cipher[1] or "RC2" in cipher[1] or "BF" in cipher[1] else 16
            sound = len(data) % block == 0 and len(cipher[2]) == 2 * block
        else:
            sound = is_der_key(data) or is_ssh_key(data)
        if sound:
            yield m.start(), end + len(foot)


def _key_kind(data: bytes | None) -> str | None:
    return None if not data else "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def _wrapped(text: str) -> Iterator[tuple[str, int, int]]:
    """Keys in base64 over several lines: lines of the first one's length, and a last one that isn't longer."""
    for m in _WRAPPED.finditer(text):
        lines = [(x.start() + m.start(), x.end() + m.start(), x[0]) for x in re.finditer(r"[A-Za-z0-9+/=]+", m[0])]
        i = 0
        while i < len(lines):
            size, j = len(lines[i][2]), i + 1
            while j < len(lines) and len(lines[j][2]) == size:
                j += 1
            last = j + 1 if j < len(lines) and len(lines[j][2]) < size else j
            if last - i > 1 and (kind := _key_kind(b64("".join(x for _, _, x in lines[i:last])))):
                yield kind, lines[i][0], lines[last - 1][1]
            i = last if last > i + 1 else i + 1


def confirmed(text: str) -> list[tuple[str, int, int]]:
    """The spans that decoding and parsing confirm."""
    out = [("pem", a, b) for a, b in pem_blocks(text)] if "-----BEGIN " in text else []
    inside = lambda a, b: any(s <= a and b <= e for _, s, e in out)
    out += [x for x in _wrapped(text) if not inside(x[1], x[2])]
    for run in CANDIDATE.finditer(text):
        if inside(*run.span()):
            continue
        base, s = run.start(), run[0]
        for m in _JWT.finditer(s):
            if is_token_header(m[1]) and b64(m[2]) is not None:
                out.append(("jwt", base + m.start(), base + m.end()))
        for m in _B64.finditer(s):
            a, b = base + m.start(), base + m.end()
            if not inside(a, b) and (kind := _key_kind(b64(m[0]))):
                out.append((kind, a, b))
        for m in _HEX_ANY.finditer(s):
            a, b = base + m.start(), base + m.end()
            if not inside(a, b) and len(m[0]) % 2 == 0 and (kind := _key_kind(bytes.fromhex(m[0]))):
                out.append((kind, a, b))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches in the order of start and then kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16] if "AKIA" in text else []
    out += [("hex", *m.span()) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], BASE_KINDS.index(x[0])))


def scan_text(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans)."""
    base = base_spans(text)
    return base, sorted({*base, *confirmed(text)}, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _suspects(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows with a long candidate run, "AKIA", a PEM label or an assign word: all that can hold a span."""
    n = len(off) - 1
    flagged = np.zeros(n, bool)
    if not len(raw):
        return flagged
    starts, ends, rows = at.word_spans(raw, off, ~_RUN)
    flagged[rows[ends - starts >= SUSPECT_RUN]] = True
    data = at.LOWER[raw].tobytes()
    for word in (*WORDS, b"akia", b"-----begin "):
        start = data.find(word)
        while start >= 0:
            row = int(np.searchsorted(off, start, side="right")) - 1
            flagged[row] = True
            start = data.find(word, max(start + 1, int(off[row + 1])))
    return flagged



def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    empty = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        texts = at.strings(batch.column(1))
        raw, off = at.utf8(texts)
        rows = [i for a, b in at.slices(off) for i in a + np.flatnonzero(_suspects(raw[off[a] : off[b]], off[a : b + 1] - off[a]))]
        n = len(texts)
        counts = np.zeros((3, n), np.int64)
        digest, spans = [empty] * n, [""] * n
        for i in rows:
            base, every = scan_text(texts[int(i)].as_py())
            for k, _, _ in base:
                counts[BASE_KINDS.index(k), i] += 1
            digest[i], spans[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                                         names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of base spans and all spans (``kind:start:end``, comma-joined) of each row; map-only."""
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(_scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def span_rows(found: DataFrame) -> DataFrame:
    """One row for each span: doc_id, kind, start, end."""
    each = F.explode(F.filter(F.split("spans", ","), lambda x: x != "")).alias("s")
    parts = F.split("s", ":")
    return found.select("doc_id", each).select("doc_id", parts[0].alias("kind"), parts[1].cast("long").alias("start"), parts[2].cast("long").alias("end"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
