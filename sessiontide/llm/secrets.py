"""Secret scans with structural confirmation.

Plain rules find assignments, access keys and hex runs. Beside them, base64 and hex candidates are decoded and
kept only if their structure holds: DER keys by nested lengths, OpenSSH keys by their length-prefixed fields,
signed tokens by a JSON header that names an algorithm, PEM blocks by what they enclose, and encoded text by a plain
rule or one of these structures inside it, encoded again up to `DEPTH` times. Runs wrapped over lines of equal length are
joined. A key may be glued to what stands before or after it by a sign that base64 knows too (a path, a URL): its header
tells where it begins and how long it is. Escapes of JSON and of URLs are read as what they stand for; spans are places in the text itself.

Null and empty texts have no spans; the whole text is scanned however long it is. Repeated rows, and rows with a null id, each
give a row with equal spans, and an empty table none. Spans of one kind that start together stand in order of their ends.
Only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, slices, table

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "pem", "der", "openssh", "encoded")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+={0,2})+")
LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
DEPTH = 3
#: Signs of base64 that may also part a run from what stands beside it, and how keys begin after them.
GLUE = re.compile(r"[/+_=-](?=M[A-P]|b3BlbnNzaC1rZXktdjEA)")
OPENSSH_START = "b3BlbnNzaC1rZXktdjEA"
#: Escapes and what they stand for.
ESCAPED = {"%2b": "+", "%2f": "/", "%3d": "=", "\\n": "\n", "\\r": "\r", "\\t": "\t", "\\/": "/"}
ESCAPE = re.compile(r"%2[BbFf]|%3[Dd]|\\[nrt/]")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----(.*?)-----END \1-----", re.S)
OPENSSH = b"openssh-key-v1\0"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The plain rules. A run of hex digits, or of what follows AKIA, is one match however short, so asking for its
    least length at once finds the same spans; an assignment's short value may hide a later match, so it is dropped after."""
    low = text.encode().lower()
    found = []
    if any(w in low for w in WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def decode64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_parts(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents if the lengths fill the data to its end."""
    parts, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data):
            return None
        parts.append((tag, data[at : at + size]))
        at += size
    return parts


def is_der_key(data: bytes) -> bool:
    """PKCS#1, SEC1 and PKCS#8 private keys."""
    outer = der_parts(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    parts = der_parts(outer[0][1])
    if not parts or len(parts) < 2 or parts[0][0] != 2 or len(parts[0][1]) != 1:
        return False
    tags = [t for t, _ in parts]
    if tags[:9] == [2] * 9 or tags[:2] == [2, 4] and parts[0][1] == b"\x01" and len(parts[1][1]) >= 16:
        return True
    if tags[:3] == [2, 0x30, 4]:
        algorithm = der_parts(parts[1][1])
        return bool(algorithm) and algorithm[0][0] == 6
    return False


def is_openssh_key(data: bytes) -> bool:
    if not data.startswith(OPENSSH):
        return False
    at, fields = len(OPENSSH), []
    for k in range(5):
        if k == 3:  # the number of keys stands between the options and the first public key
            at += 4
            continue
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    inner = int.from_bytes(fields[-1][:4], "big")
    return fields[0].isascii() and 0 < inner <= len(fields[-1]) - 4


def is_token(header: str, payload: str) -> bool:
    head, body = decode64(header), decode64(payload)
    try:
        return body is not None and isinstance(x := json.loads(head or b""), dict) and isinstance(x.get("alg"), str)
    except (ValueError, RecursionError):
        return False


def confirmed(data: bytes | None, depth: int = DEPTH) -> str | None:
    """The kind of what a candidate decodes to."""
    if not data:
        return None
    if is_der_key(data):
        return "der"
    if is_openssh_key(data):
        return "openssh"
    if len(data) >= 12:
        try:
            inner = data.decode()
        except UnicodeDecodeError:
            return None
        if any(c < " " and c not in "\t\n\r" or "\x7f" <= c < "\xa0" for c in inner):
            return None
        if ACCESS.search(inner) or any(len(m[2]) >= 8 for m in ASSIGN.finditer(inner)) or structures(inner, depth - 1):
            return "encoded"
    return None


def of_run(run: str, depth: int) -> str | None:
    kind = None
    if len(run) % 2 == 0 and len(run) >= 32 and re.fullmatch("[0-9a-fA-F]+", run):
        kind = confirmed(bytes.fromhex(run), depth)
    return kind or confirmed(decode64(run), depth)


def der_length(run: str) -> int:
    """Characters of base64 that the DER value at the beginning of a run takes, 0 if it is none."""
    head = decode64(run[:8])
    if not head or len(head) < 6 or head[0] != 0x30:
        return 0
    size, skip = head[1], 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4:
            return 0
        size, skip = int.from_bytes(head[2 : 2 + n], "big"), 2 + n
    return -(-(size + skip) * 4 // 3)


def glued(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """Keys inside a run, after a sign at their beginning or before one at their end. Only what has the header of a key, and the
    length that it names, is decoded, so a run of signs takes no more than a look at each."""
    found = []
    for at in [start, *(m.end() for m in GLUE.finditer(text, start, end))]:
        if text.startswith(OPENSSH_START, at):
            if at > start and is_openssh_key(decode64(text[at:end]) or b""):
                found.append(("openssh", at, end))
        elif (n := der_length(text[at : at + 8])) and at + n <= end and (at > start or at + n < end):
            if (at + n == end or text[at + n] in "/+_-=") and is_der_key(decode64(text[at : at + n]) or b""):
                found.append(("der", at, at + n))
    return found


def unescaped(text: str) -> tuple[str, list[int], list[int]]:
    """The text with its escapes read, and for places in it from the k-th of some on, by how much the text's own are further."""
    out, places, shifts, at, shift, size = [], [0], [0], 0, 0, 0
    for m in ESCAPE.finditer(text):
        out += [text[at : m.start()], ESCAPED[m[0].lower()]]
        size += m.start() - at + 1
        at, shift = m.end(), shift + len(m[0]) - 1
        places.append(size)
        shifts.append(shift)
    return "".join([*out, text[at:]]), places, shifts


def escaped_spans(text: str) -> list[tuple[str, int, int]]:
    """Structures that hold only when escapes inside them are read."""
    if "%" not in text and "\\" not in text or not ESCAPE.search(text):
        return []
    plain, places, shifts = unescaped(text)
    place = lambda k: k + shifts[bisect_right(places, k) - 1]
    spans = [(kind, place(a), place(b - 1) + 1) for kind, a, b in structures(plain, DEPTH)]
    return [(kind, a, b) for kind, a, b in spans if ESCAPE.search(text, a, b)]


def wrapped(text: str, depth: int) -> list[tuple[str, int, int]]:
    """Runs over lines of equal length, the last one with or without a shorter line after it."""
    found = []
    for m in WRAPPED.finditer(text):
        lines = list(LINE.finditer(text, m.start(), m.end()))
        k = 0
        while k < len(lines):
            n = k + 1
            while n < len(lines) and len(lines[n][0]) == len(lines[k][0]):
                n += 1
            for end in (n + 1, n):
                if k + 1 < end <= len(lines) and len(lines[k][0]) >= len(lines[end - 1][0]):
                    if kind := of_run("".join(x[0] for x in lines[k:end]), depth):
                        found.append((kind, lines[k].start(), lines[end - 1].end()))
                        break
            k = n
    return found


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by start, then kind as listed; code points, end exclusive."""
    if not text:
        return []
    found = base_spans(text) + structures(text, DEPTH) + escaped_spans(text)
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def structures(text: str, depth: int) -> list[tuple[str, int, int]]:
    """What is confirmed by structure; encoded runs only while depth is left."""
    found = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            body = decode64("".join(line for line in m[2].split("\n") if ":" not in line).replace(" ", "").replace("\r", "").strip())
            if body and (m[1].startswith("ENCRYPTED") and der_parts(body) or is_der_key(body) or is_openssh_key(body)):
                found.append(("pem", m.start(), m.end()))
    if ".ey" in text or "ey" in text or "ew" in text:
        found += [("jwt", m.start(), m.end()) for m in TOKEN.finditer(text) if is_token(m[1], m[2])]
    if depth > 0:
        for m in CANDIDATE.finditer(text):
            kind = of_run(m[0], depth)
            found += [(kind, m.start(), m.end())] if kind else glued(text, m.start(), m.end())
        found += wrapped(text, depth)
    return found


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): a pass over the rows without a shuffle."""
    rows = id_text(docs, id_col, text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(SPAN))], ["doc_id", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
