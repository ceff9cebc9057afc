"""Secret scans with structural confirmation.

Base candidates (assignments of credentials, access key ids, hex strings) are always reported. Beyond them the texts are
searched for encodings with a structure of their own, and such a candidate is reported only if it decodes and parses:

* jwt: dot-separated base64url parts whose header is a JSON object, white space around it or not, with "alg" and a payload
  that is a JSON object, or with "enc" and the five parts of an encrypted token;
* pem: a BEGIN/END private key block (line breaks may be written as \\n) whose base64 body is such a DER key, the
  openssh-key-v1 layout with matching string lengths, or, under Proc-Type and DEK-Info headers, whole cipher blocks with an
  initial vector of the cipher's size;
* der: bare base64 or hex that holds a DER key: PKCS#8, plain or encrypted, PKCS#1, SEC1 or subject public key, whose
  lengths match at every level, those of values inside octet and bit strings included;
* sshkey: an ssh public key blob whose length-prefixed strings fill it and whose first names its type.

Each search is linear in the text: candidates start at the start of a run, and a key block ends at the next five dashes.
Offsets are code points, ends exclusive. Each row depends on its own text only: no shuffle, memory for one text.
Cases: a null or empty text has no spans (their list is the empty string); repeated rows each get a result; an empty
table gives an empty result; further columns are passed over; spans that start together are in the order of KINDS.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from citeweave.llm.common import map_batches, read, replaced, rows_of, sha256

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "sshkey")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A header that is JSON starts with a brace or white space: these letters in base64.
TOKEN = re.compile(r"(?a)(?<![\w-])([eICD][\w-]{7,})((?:\.[\w-]*){2,4})")
BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]{1,20} ){0,2}PRIVATE KEY)-----")
BODY = re.compile(r"[A-Za-z0-9+/=\s]+")
DEK = re.compile(r"Proc-Type: *4,ENCRYPTED\s+DEK-Info: *([A-Z0-9-]+),([0-9A-Fa-f]+)\s")
BLOB = re.compile(r"(?<![A-Za-z0-9+/_-])M[A-Za-z0-9+/_-]{39,}={0,2}")
SSH = re.compile(r"(?<![A-Za-z0-9+/])AAAA[A-Za-z0-9+/]{40,}={0,2}")
HEXBLOB = re.compile(r"(?i)(?<![0-9a-f])30[0-9a-f]{62,}(?![0-9a-f])")

#: The object identifier of RSA keys, and the block size of each cipher of an encrypted key block.
RSA = bytes.fromhex("2a864886f70d010101")
BLOCKS = {"AES": 16, "DES": 8, "CAMELLIA": 16, "SEED": 16, "RC2": 8}

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"


def debase64(s: str) -> bytes | None:
    """Strict base64, either alphabet, padding optional."""
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except binascii.Error:
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, body) values that fill data exactly, or None if lengths don't fit."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            k = size & 0x7F
            if not 1 <= k <= 4 or at + k > len(data) or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + k], "big"), at + k
            if size < 128:
                return None
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def nested(items: list[tuple[int, bytes]] | None, depth: int = 12) -> bool:
    """Whether every constructed value is itself filled by values, down to the last level."""
    return items is not None and depth > 0 and all(not tag & 0x20 or nested(der_items(body), depth - 1) for tag, body in items)


def one_value(data: bytes) -> tuple[int, bytes] | None:
    """The one DER value that data is, whole at every level."""
    items = der_items(data)
    return items[0] if items and len(items) == 1 and nested(items) else None


def der_key(data: bytes) -> bool:
    """Whether data is one DER sequence in the layout of a key."""
    top = one_value(data)
    if not top or top[0] != 0x30 or not (parts := der_items(top[1])):
        return False
    tags = [t for t, _ in parts]
    algorithm = der_items(parts[tags.index(0x30)][1]) if 0x30 in tags[:2] else None
    named = bool(algorithm) and algorithm[0][0] == 0x06 and len(algorithm[0][1]) >= 3
    if tags[0] == 0x02:
        if tags[1:3] == [0x30, 0x04]:  # PKCS#8: version, algorithm, a key that is a value itself
            return named and len(parts[0][1]) == 1 and one_value(parts[2][1]) is not None
        if tags[1:2] == [0x04]:  # SEC1: version 1, key, curve and point
            return parts[0][1] == b"\1" and len(parts[1][1]) >= 16 and set(tags[2:]) <= {0xA0, 0xA1}
        return len(tags) in (2, 9) and set(tags) == {0x02} and len(parts[len(tags) == 9][1]) >= 32  # PKCS#1
    if tags == [0x30, 0x03]:  # subject public key: algorithm, bit string without unused bits; of RSA a value itself
        bits = parts[1][1]
        return named and len(bits) > 16 and bits[0] == 0 and (algorithm[0][1] != RSA or one_value(bits[1:]) is not None)
    return tags == [0x30, 0x04] and named and len(parts[1][1]) >= 16  # encrypted PKCS#8


def ssh_strings(data: bytes) -> list[bytes] | None:
    """The length-prefixed strings that fill data exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 4 > len(data) or at + 4 + (size := int.from_bytes(data[at : at + 4], "big")) > len(data):
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def openssh_key(data: bytes) -> bool:
    """The openssh-key-v1 layout: cipher, kdf, its options, a count, the public keys and a private part."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, data = 0, data[len(magic) :]
    for k in range(99):
        if k == 3:
            count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
            if not 1 <= count <= 64:
                return False
            return (rest := ssh_strings(data[at:])) is not None and len(rest) == count + 1
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        at += 4 + size
    return False


def json_object(part: str) -> dict | None:
    try:
        x = json.loads(debase64(part) or b"")
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of signed and encrypted tokens."""
    at = 0
    while m := TOKEN.search(text, at):
        at, parts = m.end(1), m[2].split(".")[1:]
        if not (head := json_object(m[1])):
            continue
        size = 0
        if isinstance(head.get("enc"), str) and len(parts) == 4 and all(map(debase64, parts[1:])):
            size = 4
        elif isinstance(head.get("alg"), str) and json_object(parts[0]) is not None:
            size = 2
        if size:
            at = m.end(1) + sum(len(p) + 1 for p in parts[:size])
            yield m.start(), at


def key_block(body: str) -> bool:
    """Whether what stands between the lines of a private key block is a key."""
    body = body.replace("\\r", "").replace("\\n", "\n").lstrip() + "\n"
    dek = DEK.match(body)
    if dek:
        body = body[dek.end() :]
    if not BODY.fullmatch(body):
        return False
    data = debase64("".join(body.split()))
    if not data:
        return False
    if dek:
        block = BLOCKS.get(dek[1].split("-")[0], 0)
        return block > 0 and len(dek[2]) == 2 * block and len(data) >= 32 and len(data) % block == 0
    return der_key(data) or openssh_key(data)


def key_blocks(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := BEGIN.search(text, at):
        at = text.find("-----", m.end())
        if at < 0:
            return
        end = f"-----END {m[1]}-----"
        if text.startswith(end, at) and key_block(text[m.end() : at]):
            at += len(end)
            yield m.start(), at


def confirmed(text: str) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end) of what decodes and parses."""
    out = [(a, 3, z) for a, z in tokens(text)] if "." in text else []
    if "-----BEGIN " in text:
        out += [(a, 4, z) for a, z in key_blocks(text)]
    for m in BLOB.finditer(text):
        if (data := debase64(m[0])) and der_key(data):
            out.append((m.start(), 5, m.end()))
    for m in HEXBLOB.finditer(text):
        if len(m[0]) % 2 == 0 and der_key(bytes.fromhex(m[0])):
            out.append((m.start(), 5, m.end()))
    if "AAAA" in text:
        for m in SSH.finditer(text):
            parts = ssh_strings(debase64(m[0]) or b"\0")
            if parts and len(parts) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", parts[0]):
                out.append((m.start(), 6, m.end()))
    return out


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans and the confirmed ones, each (start, index in KINDS, end), sorted."""
    if not text:
        return [], []
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(base), sorted(confirmed(text))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str | None) -> str | None:
    """The text with each span, overlapping ones as one, replaced by its kind in angle brackets; null stays null."""
    if not text:
        return text
    base, more = scan(text)
    out, at = [], 0
    for a, k, b in sorted([*base, *more], key=lambda x: (x[0], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, and all spans."""

    def run(b: dict) -> dict:
        rows = []
        for i, t in zip(b["doc_id"], b["text"], strict=True):
            base, more = scan(t)
            kinds = [k for _, k, _ in base]
            rows.append((i, kinds.count(0), kinds.count(1), kinds.count(2), sha256(joined(base).encode()), joined(sorted(base + more)), len(more)))
        return rows_of(rows, [f.split()[0] for f in SCHEMA.split(", ")])

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), run, SCHEMA)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with redact() applied to the texts, n_chars to match, other columns as they are."""
    return replaced(docs, lambda texts: [redact(t) for t in texts], text_col)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(read(spark, sf_dir, "documents"))
