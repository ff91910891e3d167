"""Op 5: secrets, confirmed by their structure.

Three base kinds are found by pattern alone (assign, access, hex). Further kinds are reported only if what they encode has the
structure of a key: `pem` (a PEM block around a key encoding), `jwt` (a signed token whose header and claims are JSON and whose
header names an algorithm), `b64key` and `hexkey` (base64 or hex that decodes to a private-key encoding, or to text that holds
a confirmed PEM block or token; base64 may run over several lines). A key encoding is an OpenSSH container or DER whose nested
lengths fill each other exactly and whose outline is that of a private key (PKCS#1, PKCS#8, encrypted PKCS#8 or SEC 1). The
body of a traditional encrypted PEM block is ciphertext and has no outline: its length must be whole blocks of the cipher named.
Base64 over several lines is walked line by line: a key says itself how long it is, so it ends where its encoding does, at the end of a line, whatever
comes after it.

Edge cases: values and JSON nested without end are no keys; a text of any length is scanned whole, in time in proportion to it;
null counts as empty and has no spans; an empty table gives no rows; repeated rows are scanned alike; a span lies
by code points, its end exclusive; ties in start go by kind as listed in KINDS; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import itertools
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import slices

#: Values nested deeper than this belong to no key.
DEPTH = 16
KINDS = ("assign", "access", "hex", "pem", "jwt", "b64key", "hexkey")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Headers of an encrypted key hold single hyphens; a body never holds the five of a border.
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([^-]*+(?:-(?!----)[^-]*+)*+)-----END \1-----")
_HEADERS = re.compile(r"\s*(?:[A-Za-z0-9-]+:[^\n]*\n(?:[ \t]+[^\n]*\n)*)+[ \t\r]*\n")
_CIPHER = re.compile(r"DEK-Info:\s*([A-Z0-9-]+),([0-9A-Fa-f]+)")
_OPENSSH = b"openssh-key-v1\0"
_OPENSSH_B64 = base64.b64encode(_OPENSSH).decode()
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]*+")
_B64 = re.compile(r"[A-Za-z0-9+/_-]{48,}={0,2}")
#: Base64 over several lines without a PEM frame: a line that goes on, and what follows the last such line.
_LINE = re.compile(r"(?<![A-Za-z0-9+/])([A-Za-z0-9+/]{40,}+)\r?\n[ \t]*+")
_LAST = re.compile(r"[A-Za-z0-9+/]*+={0,2}")
_PADDING = re.compile(r"(?:(?:\r?\n[ \t]*+)?={1,2})?")
_HEXES = re.compile(r"[0-9a-fA-F]{64,}")


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, begin and end of the value at `at`, if its length is well formed and stays inside."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at : at + k]), at + k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill data[at:end] exactly; constructed ones must be filled in turn, DEPTH deep at most."""
    out, inner = [], [(at, end, 0)]
    while inner:
        at, end, depth = inner.pop()
        while at < end:
            got = _tlv(data, at, end)
            if not got or depth > DEPTH:
                return None
            if not depth:
                out.append(got)
            if got[0] & 0x20:
                inner.append((got[1], got[2], depth + 1))
            at = got[2]
    return out


def _strings(data: bytes, at: int, n: int) -> tuple[list[bytes], int] | None:
    """The n strings that begin at `at`, each behind its 32-bit length, and where the last one ends."""
    out = []
    for _ in range(n):
        size = int.from_bytes(data[at : at + 4])
        if at + 4 + size > len(data):
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out, at


def openssh_key(data: bytes) -> bool:
    """The container whole: cipher, derivation and its options, as many public keys as it says, one private part, nothing behind."""
    if not data.startswith(_OPENSSH) or not (names := _strings(data, len(_OPENSSH), 3)):
        return False
    (cipher, derivation, options), at = names
    count = int.from_bytes(data[at : at + 4])
    if not (cipher and cipher.isascii() and derivation.isascii() and 1 <= count <= len(data) // 4) or (cipher == b"none") != (derivation == b"none") or (cipher == b"none" and options):
        return False
    keys = _strings(data, at + 4, count + 1)
    if not keys or keys[1] != len(data) or not all(_strings(k, 0, 1) for k in keys[0][:-1]):
        return False
    private = keys[0][-1]
    return len(private) >= 16 and len(private) % 8 == 0 and (cipher != b"none" or private[:4] == private[4:8])


def private_key_der(data: bytes) -> bool:
    top = _tlv(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _children(data, top[1], top[2])
    if not parts:
        return False
    tags = [t for t, *_ in parts]
    small = data[parts[0][1] : parts[0][2]] in (b"\0", b"\1")
    if tags[:9] == [2] * 9 and small:
        return True  # PKCS#1
    if tags[:3] == [2, 0x30, 4] and small or tags == [0x30, 4]:  # PKCS#8, plain or encrypted
        algorithm = _children(data, *parts[0 if tags[0] == 0x30 else 1][1:])
        return bool(algorithm) and algorithm[0][0] == 6
    return tags[:2] == [2, 4] and small and set(tags[2:]) <= {0xA0, 0xA1} and len(tags) > 2  # SEC 1


def _decoded(run: str) -> bytes:
    run = re.sub(r"\s", "", run).rstrip("=").translate(str.maketrans("-_", "+/"))
    try:
        return base64.b64decode(run[: len(run) - (len(run) % 4 == 1)] + "=" * (-len(run) % 4)) if len(run) % 4 != 1 else b""
    except (binascii.Error, ValueError):
        return b""


def _pem(m: re.Match) -> bool:
    headers = _HEADERS.match(m[2])
    head, body = (headers[0], m[2][headers.end() :]) if headers else ("", m[2])
    data = _decoded(body)
    if "Proc-Type" in head and "ENCRYPTED" in head:  # ciphertext: whole blocks of the cipher, behind a start value of one block
        how = _CIPHER.search(head)
        block = how and (16 if how[1].startswith(("AES", "CAMELLIA")) else 8)
        return bool(block) and len(how[2]) == 2 * block and len(data) >= 32 and len(data) % block == 0
    return _key(data)


def _jwt(m: re.Match) -> bool:
    try:
        head, claims = (json.loads(_decoded(x)) for x in m[0].split(".")[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(claims, dict) and isinstance(head.get("alg"), str)


def _key(data: bytes, inside: bool = True) -> bool:
    if openssh_key(data) or private_key_der(data):
        return True
    if inside and data.isascii():
        text = data.decode()
        return any(_pem(m) for m in _PEM.finditer(text)) or any(_jwt(m) for m in _JWT.finditer(text))
    return False


class _Run:
    """The base64 of a block of lines as one string, decoded only where it is looked at."""

    def __init__(self, lines: list[tuple[int, str]]):
        self.starts, self.offsets, at = [p for p, _ in lines], [], 0
        for _, chars in lines:
            self.offsets.append(at)
            at += len(chars)
        self.chars, self.ends = "".join(chars for _, chars in lines), {*self.offsets[1:], at}

    def bytes(self, start: int, at: int, n: int) -> bytes:
        """n bytes from byte `at` of what begins at character `start`."""
        a = start + at // 3 * 4
        return base64.b64decode(self._even(self.chars[a : a + (at % 3 + n + 2) // 3 * 4]))[at % 3 : at % 3 + n]

    @staticmethod
    def _even(chars: str) -> str:
        chars = chars[: len(chars) - (len(chars) % 4 == 1)]
        return chars + "=" * (-len(chars) % 4)

    def whole(self, start: int, n: int) -> tuple[bytes, int] | None:
        """The n bytes from character `start`, and the character behind their encoding, if that is where a line ends."""
        end = start + (n * 4 + 2) // 3
        return (base64.b64decode(self._even(self.chars[start:end]))[:n], end) if end in self.ends else None

    def text_end(self, end: int) -> int:
        """The place in the text behind character `end` - 1."""
        k = bisect.bisect_right(self.offsets, end - 1) - 1
        return self.starts[k] + end - self.offsets[k]


def _der_size(run: _Run, start: int) -> int | None:
    """The size of a value that opens like a key, if its parts fill it: only their heads are decoded."""
    top = _tlv_head(run.bytes(start, 0, 6))
    if not top or top[0] != 0x30 or start + (sum(top[1:]) * 4 + 2) // 3 not in run.ends:
        return None
    at, end = top[1], sum(top[1:])
    for _ in range(12):  # no key has more parts
        part = _tlv_head(run.bytes(start, at, 6))
        if not part:
            return None
        at += sum(part[1:])
        if at >= end:
            return end if at == end else None
    return None


def _tlv_head(data: bytes) -> tuple[int, int, int] | None:
    """Tag, size of the head and size of the value."""
    if len(data) < 2:
        return None
    if not data[1] & 0x80:
        return data[0], 2, data[1]
    k = data[1] & 0x7F
    n = int.from_bytes(data[2 : 2 + k])
    return (data[0], 2 + k, n) if 1 <= k <= 4 and len(data) >= 2 + k and data[2] and n >= 0x80 else None


def _openssh_size(run: _Run, start: int) -> int | None:
    """The size of an OpenSSH container, by the sizes of its parts."""
    at, number = len(_OPENSSH), lambda at: int.from_bytes(x) if len(x := run.bytes(start, at, 4)) == 4 else None
    for _ in range(3):
        if (n := number(at)) is None:
            return None
        at += 4 + n
    count = number(at)
    if count is None or count > len(run.chars) // 4:
        return None
    at += 4
    for _ in range(count + 1):
        if (n := number(at)) is None:
            return None
        at += 4 + n
    return at


def _wrapped(text: str):
    """(start, end) of keys in base64 over several lines. Each line is looked at as a first one, and decoded further only where it opens like a key."""
    block: list[tuple[int, str]] = []
    end = 0
    for m in itertools.chain(_LINE.finditer(text), (None,)):
        if block and (m is None or m.start() != end):
            last = _LAST.match(text, end)
            yield from _keys_of_block(text, [*block, (end, last[0].rstrip("="))] if last[0].rstrip("=") else block)
            block = []
        if m:
            block.append((m.start(), m[1]))
            end = m.end()


def _keys_of_block(text: str, lines: list[tuple[int, str]]):
    if len(lines) < 2:
        return
    run, done, found = _Run(lines), 0, False
    for (begin, chars), start in zip(lines, run.offsets, strict=True):
        if start < done or not chars.startswith(("M", _OPENSSH_B64)):
            continue
        n = _openssh_size(run, start) if chars.startswith(_OPENSSH_B64) else _der_size(run, start)
        got = run.whole(start, n) if n else None
        if got and start + len(chars) < got[1] and (openssh_key(got[0]) or private_key_der(got[0])):
            done, found = got[1], True
            yield begin, _PADDING.match(text, run.text_end(done)).end()
    if not found:  # the text of a framed key or of a token, as far as it is text
        data = base64.b64decode(run._even(run.chars))
        data = data[: re.match(rb"[\x00-\x7f]*+", data).end()]
        said = data.decode()
        ends = [m.end() for m in _PEM.finditer(said) if _pem(m)] + [m.end() for m in _JWT.finditer(said) if _jwt(m)]
        if ends:
            k = min(bisect.bisect_left(run.offsets, (max(ends) * 4 + 2) // 3), len(lines))
            yield lines[0][0], _PADDING.match(text, lines[k - 1][0] + len(lines[k - 1][1])).end()


def scan(text: str) -> list[tuple[int, int, int]]:
    """All (start, kind's place in KINDS, end) of a text, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "-----BEGIN " in text:
        out += [(m.start(), 3, m.end()) for m in _PEM.finditer(text) if _pem(m)]
    if "eyJ" in text:
        out += [(m.start(), 4, m.end()) for m in _JWT.finditer(text) if _jwt(m)]
    for m in _B64.finditer(text):
        if _key(_decoded(m[0])):
            out.append((m.start(), 5, m.end()))
        out += [(h.start() + m.start() + skip, 6, h.end() + m.start() - (len(h[0]) % 2 - skip)) for h in _HEXES.finditer(m[0]) for skip in range(1 + len(h[0]) % 2) if _hex_key(h[0], skip)]
    framed = [(a, b) for a, k, b in out if k == 3]  # in order, and apart from each other
    begins = [a for a, _ in framed]
    for a, b in _wrapped(text):
        k = bisect.bisect_right(begins, a) - 1
        if k < 0 or framed[k][1] <= a:
            out.append((a, 5, b))
    return sorted(out)


def _hex_key(run: str, skip: int) -> bool:
    """A run of odd length holds a key either before its last digit (skip 0) or behind its first (skip 1)."""
    return _key(bytes.fromhex(run[skip : len(run) - (len(run) % 2 - skip)]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, the base spans' digest, all spans, and the number of confirmed ones."""

    def run(batches):
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = scan(text or "")
                base = [x for x in found if x[1] < 3]
                said = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in xs) for xs in (base, found)]
                rows.append((doc_id, *(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(said[0].encode()).hexdigest(), said[1], len(found) - len(base)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()], strict=True)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan every whole text of the table."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
