"""Operator 10, secret scans with structural confirmation.

Patterns find what is said to be a secret (an assignment, an access key id, a hex string): the base
kinds. Beyond these, candidates that only look random are decoded and reported if their structure
confirms a secret: signed tokens whose header is a JSON object naming an algorithm, private keys in
armour, base64 or hex whose nested DER lengths add up to a private key (PKCS#1, PKCS#8, SEC1), and
OpenSSH private keys whose length-prefixed fields parse. A public key, a certificate or a random
string that merely decodes is not reported.

Keys are looked for at every place of a run, not only at its first character, and may be broken into
lines, by real line breaks or by escaped ones (a backslash and a letter, as in JSON and .env files).
The span of a bare key ends where its own lengths say; bare keys inside a confirmed armour belong to
it. Encrypted armour with header lines (Proc-Type, DEK-Info) is confirmed by its headers and a body of
whole cipher blocks.

One pass over the texts in Arrow batches, without a shuffle; a text is scanned whole. Offsets are
code points, the end exclusive.

Defined cases: a null text is empty; a null id stays null; repeated rows each get their own equal
row; an empty table gives an empty result; further columns are ignored by ``scan`` and returned by
``redacted``.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "token", "armour", "key_base64", "key_hex", "openssh")   # ties by this order
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")         # a run is taken whole, so a minimum length is the same as a filter
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
ESCAPED = re.compile(r"\\+[nrt]")                  # line breaks of JSON and .env files
DEK = re.compile(r"DEK-Info: *[A-Z0-9-]+, *(?:[0-9A-Fa-f]{2})+")
PIECE = re.compile(r"[A-Za-z0-9+/]+")
HEX_PIECE = re.compile(r"[0-9a-fA-F]+")
BREAK = re.compile(r"[ \t]*(?:\\+[nr]|[\r\n])(?:\\+[nrt]|\s)*")
# how a sequence that begins with a version number, and an OpenSSH key, begin; a line may end between any two characters
DER_START = re.compile("M~(?:[A-H]~[AEIMQUYcgkosw048]~C|I~[E-T])".replace("~", f"(?:{BREAK.pattern})?"))
OPENSSH_START = re.compile(f"(?:{BREAK.pattern})?".join("b3BlbnNzaC1rZXktdjE"))
HEX_START = re.compile("3~0~(?:[0-7]~.|8~[1-4])".replace("~", f"(?:{BREAK.pattern})?"))
OPENSSH = b"openssh-key-v1\x00"
SEQUENCE, INTEGER, OCTETS, OID = 0x30, 0x02, 0x04, 0x06


def decoded(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fields(raw: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the DER values that ``raw`` consists of; None if the lengths do not add up."""
    out, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw):
            return None
        tag, size, at = raw[at], raw[at + 1], at + 2
        if size >= 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or at + more > len(raw):
                return None
            size, at = int.from_bytes(raw[at:at + more], "big"), at + more
        if at + size > len(raw):
            return None
        out.append((tag, raw[at:at + size]))
        at += size
    return out


def is_private_der(raw: bytes) -> bool:
    """A DER sequence with the fields of a private key."""
    top = der_fields(raw) if raw[:1] == b"\x30" else None
    if not top or len(top) != 1 or top[0][0] != SEQUENCE:
        return False
    fields = der_fields(top[0][1]) or []
    tags = [t for t, _ in fields]
    if len(tags) >= 9 and tags[:9] == [INTEGER] * 9 and len(fields[1][1]) >= 32:            # RSA
        return True
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS]:                                             # PKCS#8
        kind = der_fields(fields[1][1]) or []
        return bool(kind) and kind[0][0] == OID and len(fields[2][1]) >= 16
    if tags[:2] == [INTEGER, OCTETS] and fields[0][1] == b"\x01":                           # SEC1
        return 20 <= len(fields[1][1]) <= 66
    return tags == [INTEGER] * 6 and fields[0][1] == b"\x00" and len(fields[1][1]) >= 64    # DSA


def is_openssh(raw: bytes) -> bool:
    """The cipher, the derivation and its options, the number of keys, the public and private parts."""
    size = openssh_size(lambda a, b: raw[a:b])
    return size is not None and size <= len(raw)


def openssh_size(part: Callable[[int, int], bytes]) -> int | None:
    """Bytes of the OpenSSH key whose bytes a to b are ``part(a, b)``."""
    if part(0, len(OPENSSH)) != OPENSSH:
        return None
    at, field, fields = len(OPENSSH), 0, 6
    while field < fields:
        size = part(at, at + 4)
        if len(size) < 4:
            return None
        n, at = int.from_bytes(size, "big"), at + 4
        if field == 3:
            if not 1 <= n <= 16:
                return None
            fields = 5 + n                                  # n public parts and the private one
        else:
            at += n
        field += 1
    return at


def der_size(head: bytes) -> int | None:
    """Bytes of the DER sequence that begins with ``head``, if its first field is a version number and
    the next one may be a private key's."""
    if len(head) < 2 or head[0] != SEQUENCE:
        return None
    more = head[1] & 0x7F if head[1] >= 0x80 else 0
    if more > 4 or head[1] == 0x80:
        return None
    at = 2 + more
    size = int.from_bytes(head[2:at], "big") if more else head[1]
    version = head[at:at + 4]
    if len(version) < 4 or version[:2] != b"\x02\x01" or version[2] > 3 or version[3] not in (INTEGER, SEQUENCE, OCTETS):
        return None
    return at + size


def gathered(text: str, at: int, count: int, piece: re.Pattern = PIECE) -> tuple[str, int]:
    """Up to ``count`` characters from ``at`` on without the line breaks between them, and their end."""
    parts, end = [], at
    while count > 0 and (m := piece.match(text, at, at + count)):
        parts.append(m[0])
        count, end = count - len(m[0]), m.end()
        pause = BREAK.match(text, end) if count else None
        if not pause:
            break
        at = pause.end()
    return "".join(parts), end


def bare_der(text: str, at: int, is_hex: bool = False) -> int | None:
    """The end of the private key in base64 or hex that begins at ``at``."""
    piece = HEX_PIECE if is_hex else PIECE
    chars = lambda n: 2 * n if is_hex else -(-4 * n // 3)
    plain = lambda t: bytes.fromhex(t[:len(t) & ~1]) if is_hex else decoded(t[:len(t) & ~3])
    size = der_size(plain(gathered(text, at, 24, piece)[0]) or b"")
    if size is None or chars(size) > len(text) - at:
        return None
    body, end = gathered(text, at, chars(size), piece)
    if len(body) < chars(size):
        return None
    # the last character may hold bits of what follows
    raw = bytes.fromhex(body) if is_hex else (decoded(body + "A" * (-len(body) % 4)) or b"")[:size]
    if not is_private_der(raw):
        return None
    return end if is_hex else end + len(re.compile("={0,2}").match(text, end)[0])


def bare_openssh(text: str, at: int) -> int | None:
    """The end of the OpenSSH key in base64 that begins at ``at``."""
    body, _ = gathered(text, at, len(text))
    part = lambda a, b: (decoded(body[a // 3 * 4:-(-b // 3) * 4]) or b"")[a - a // 3 * 3:][:b - a]
    size = openssh_size(part)
    if size is None or -(-4 * size // 3) > len(body):
        return None
    end = gathered(text, at, -(-4 * size // 3))[1]
    return end + len(re.compile("={0,2}").match(text, end)[0])


def is_armoured_key(label: str, body: str) -> bool:
    """A private key between the lines of its armour."""
    lines = [line.strip() for line in re.split(r"[\r\n]", ESCAPED.sub("\n", body).replace("\\/", "/"))]
    headers = [line for line in lines if ":" in line]
    raw = decoded(re.sub(r"[\s\\]", "", "".join(line for line in lines if ":" not in line)))
    if raw is None:
        return False
    if any(h.startswith("Proc-Type:") and h.endswith("ENCRYPTED") for h in headers):
        return len(raw) >= 32 and len(raw) % 8 == 0 and any(DEK.fullmatch(h) for h in headers)
    return is_private_der(raw) or is_openssh(raw) or (label.startswith("ENCRYPTED") and der_fields(raw) is not None)


def is_token_header(part: str) -> bool:
    raw = decoded(part, url=True)
    try:
        header = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what only its structure gives away."""
    out = []
    if "eyJ" in text:
        for m in TOKEN.finditer(text):
            if is_token_header(m[1]) and decoded(m[2], url=True) is not None:
                out.append((m.start(), 3, m.end()))
    armoured = []
    if "-----BEGIN" in text:
        starts = list(ARMOUR.finditer(text))
        for m, after in zip(starts, [*(x.start() for x in starts[1:]), len(text)]):
            line = f"-----END {m[1]}-----"
            end = text.find(line, m.end(), after)
            if end >= 0 and is_armoured_key(m[1], text[m.end():end]):
                armoured.append((m.start(), 4, end + len(line)))
    out += armoured
    for start, kind, key_end in ((DER_START, 5, bare_der), (OPENSSH_START, 7, bare_openssh),
                                 (HEX_START, 6, lambda t, a: bare_der(t, a, True))):
        at, inside = 0, iter([*armoured, (len(text), 4, len(text))])
        a, _, b = next(inside)
        while m := start.search(text, at):
            at = m.start() + 1
            while b <= m.start() < len(text) and a < len(text):
                a, _, b = next(inside)
            if a <= m.start() < b:
                at = b
            elif end := key_end(text, m.start()):
                out.append((m.start(), kind, end))
                at = end
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = []
            for text in part.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(),
                             joined(base + confirmed_spans(text))))
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, the counts of the base kinds, their digest, and all spans."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(_scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(text: str | None) -> str | None:
    """``text`` with every span replaced by ``[secret]``; overlapping spans become one."""
    if not text:
        return text
    merged: list[list[int]] = []
    for a, _, b in sorted(base_spans(text) + confirmed_spans(text)):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    ends = [0, *(b for _, b in merged)]
    return "[secret]".join(text[e:a] for e, a in zip(ends, [*(a for a, _ in merged), len(text)]))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans masked in its text."""
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            text = pa.array([mask(t.as_py()) for t in batch.column(place)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], text, *batch.columns[place + 1:]], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
