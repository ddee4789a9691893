"""Secret scan by structural confirmation.

Three base patterns find assignments, access keys and long hex runs. On top of them, candidates that look like an
encoding (base64 or hex runs, armoured blocks, dotted tokens) are decoded and their structure is checked before they
are reported: DER lengths must nest exactly and have the shape of a private key, the OpenSSH container's length-prefixed
fields must parse, a token's header must be JSON that names an algorithm, and text hidden in base64 must itself match a
base pattern.

Nulls count as empty texts; an empty text has no spans; a repeated row is scanned like any other; texts of any length are
scanned whole. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_batches, texts

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "pem", "der", "openssh", "hexkey", "encoded")

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: Runs of token letters and dots, whole: no place within a run begins another search.
DOTTED = re.compile(r"[A-Za-z0-9_.-]++")
#: A line break as it stands in a text, or escaped (once or more) inside JSON or YAML; \\u000a and the like too.
_BREAK = r"(?:\s|\\+(?:[nrt]|u000[aAdD9]))"
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40})PRIVATE KEY-----((?:[A-Za-z0-9+=]|\\*/|" + _BREAK + r"|(?<=[nrdDaA\s])[A-Z][A-Za-z-]{1,30}:\x20?[^\r\n\\]{0,200}(?=[\r\n\\]))+)-----END \1PRIVATE KEY-----")
PEM_HEADER = re.compile(r"(?m)^[A-Z][A-Za-z-]{1,30}:.*$")
DEK = re.compile(r"(?m)^DEK-Info:\x20?[A-Z0-9-]+,([0-9A-Fa-f]{16,32})\s*$")
BREAKS = re.compile(_BREAK)
#: Lines of base64 of one width and a shorter last one; the breaks may be escaped and indented.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{24,}(?:(?:[\x20\t]*(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*)[A-Za-z0-9+/_-]{1,}){1,}={0,2})")
_WRAP = re.compile(r"[\x20\t]*(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*")
#: Where a key may start inside a run: the first bytes of a DER sequence, of the OpenSSH container, and what follows a separator.
INSIDE = re.compile(r"M[C-I]|b3BlbnNzaC1rZXktdjEA|(?<=[/_-])")
B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
HEXKEY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{48,}")
#: Signature bytes by algorithm (RFC 7518); others may have any length.
SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "none": 0}

_WORDS = (b"passw", b"secret", b"token", b"api")


def _runs(chars: bytes) -> bytes:
    """A translation that turns these bytes into 1 and all others into 0, so that a run is found by plain search."""
    return bytes(1 if b in chars else 0 for b in range(256))


_IS_HEX = _runs(b"0123456789abcdef")
_IS_B64 = _runs(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def unbase64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of each element, or None if a length doesn't fit or bytes are left over."""
    out, k = [], 0
    while k < len(data):
        if k + 2 > len(data):
            return None
        tag, n = data[k], data[k + 1]
        k += 2
        if n & 0x80:
            more = n & 0x7F
            if not 1 <= more <= 4 or k + more > len(data):
                return None
            n = int.from_bytes(data[k : k + more], "big")
            k += more
        if k + n > len(data):
            return None
        out.append((tag, data[k : k + n]))
        k += n
    return out


def private_der(data: bytes) -> bool:
    """RSA (PKCS#1), PKCS#8, encrypted PKCS#8 or SEC1 private key, by its nested lengths and tags."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    items = der_items(top[0][1])
    if not items:
        return False
    tags = [t for t, _ in items]
    if tags == [2] * 6 and items[0][1] == b"\0":  # DSA: version, p, q, g, public, private
        return len(items[1][1]) >= 32 and len(items[2][1]) >= 16
    if tags[:9] == [2] * 9:
        return len(items[1][1]) >= 16
    if tags[:3] == [2, 0x30, 4] or tags == [0x30, 4]:
        oid = der_items(items[tags.index(0x30)][1])
        return bool(oid) and oid[0][0] == 6
    return tags[:2] == [2, 4] and items[0][1] == b"\x01" and len(items[1][1]) >= 16


def openssh_private(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    k = len(magic)
    for field in range(3):  # cipher, kdf, kdf options
        if k + 4 > len(data):
            return False
        k += 4 + int.from_bytes(data[k : k + 4], "big")
    if k + 4 > len(data):
        return False
    keys = int.from_bytes(data[k : k + 4], "big")
    k += 4
    for _ in range(keys + 1):  # public keys, then the private part
        if k + 4 > len(data) or keys > 64:
            return False
        k += 4 + int.from_bytes(data[k : k + 4], "big")
    return k == len(data) and keys > 0


def signed_token(s: str) -> bool:
    head, body, sig = s.split(".")
    try:
        header = json.loads(unbase64(head) or b"")
        claims = json.loads(unbase64(body) or b"")
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(header.get("alg"), str) or not isinstance(claims, dict):
        return False
    raw = unbase64(sig) if sig else b""
    return raw is not None and len(raw) == SIGNATURE.get(header["alg"], len(raw)) and (bool(raw) or header["alg"] == "none")


def base_spans(text: str, data: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the base patterns. data: the text as UTF-8; plain searches in it spare most texts the patterns."""
    data = text.encode("utf-8", "surrogatepass") if data is None else data
    out, low = [], data.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if b"\1" * 16 in data.translate(_IS_HEX):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def hidden(body: bytes) -> bool:
    """Decoded bytes that are UTF-8 and hold a base pattern."""
    try:
        return bool(base_spans(body.decode("utf-8"), body))
    except UnicodeDecodeError:
        return False


def structure(body: bytes) -> int | None:
    """The kind's index of decoded bytes: a key in DER, an OpenSSH container, or text that holds a base pattern."""
    return 5 if private_der(body) else 6 if openssh_private(body) else 8 if hidden(body) else None


def armoured(inside: str) -> bool:
    """Whether what stands between the marks of a PEM block is a private key; header lines are skipped."""
    lines = re.sub(r"\\+/", "/", BREAKS.sub(lambda m: m[0] if m[0] in " \t" else "\n", inside))
    dek = DEK.search(lines)
    body = unbase64(re.sub(r"\s", "", PEM_HEADER.sub("", lines)))
    if not body:
        return False
    if dek:  # encrypted as a whole: only its length in cipher blocks can be seen
        return len(body) >= 16 and len(body) % (len(dek[1]) // 2) == 0
    return private_der(body) or openssh_private(body)


def key_inside(run: str) -> tuple[int, int, int] | None:
    """(start, kind's index, end) of what is confirmed in a base64 run: the whole run, or from a place inside where a key may start."""
    if (body := unbase64(run)) and (kind := structure(body)) is not None:
        return 0, kind, len(run)
    for m in INSIDE.finditer(run, 1):
        k = m.start()
        if len(run) - k < 24:
            break
        if run.startswith("b3BlbnNz", k):
            if (body := unbase64(run[k:])) and openssh_private(body):
                return k, 6, len(run)
        elif (head := unbase64(run[k : k + 8])) and head[0] == 0x30 and (n := der_length(head)) and head[2 + (head[1] & 0x7F if head[1] & 0x80 else 0)] in (2, 0x30):
            stop = k + -(-n * 4 // 3)  # the sequence says how long it is, so what follows it in the run doesn't matter
            body = unbase64(run[k:stop]) if stop <= len(run) else None
            if body and private_der(body[:n]):
                return k, 5, stop + len(run[stop:]) * (not run[stop:].strip("="))
        elif run[k - 1] in "/_-" and utf8_begins(run[k : k + 24]) and (body := unbase64(run[k:])) and hidden(body):
            return k, 8, len(run)
    return None


def utf8_begins(run: str) -> bool:
    """Whether 24 characters decode to UTF-8, a last character may be cut: it spares long runs of other data their decoding at each separator."""
    try:
        (unbase64(run) or b"\xff").decode("utf-8")
    except UnicodeDecodeError as e:
        return e.start >= 15 and e.reason == "unexpected end of data"
    return True


def der_length(head: bytes) -> int:
    """The whole length that the first bytes of an element tell, or 0."""
    if not head[1] & 0x80:
        return 2 + head[1]
    more = head[1] & 0x7F
    return 2 + more + int.from_bytes(head[2 : 2 + more], "big") if 1 <= more <= 3 else 0


def tokens(text: str) -> list[tuple[int, int]]:
    """Where three parts joined by dots stand, the first from its first eyJ on with five letters more at least, the second not empty; leftmost, apart from each other, in one pass."""
    out = []
    for m in DOTTED.finditer(text):
        parts, at, k = m[0].split("."), [], 0
        start = m.start()
        for p in parts:
            at.append(start)
            start += len(p) + 1
        while k + 2 < len(parts):
            j = parts[k].find("eyJ")
            if j >= 0 and len(parts[k]) - j >= 8 and parts[k + 1]:
                out.append((at[k] + j, at[k + 2] + len(parts[k + 2])))
                k += 3
            else:
                k += 1
    return out


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end), in order, of base patterns and of confirmed structures."""
    data = text.encode("utf-8", "surrogatepass")
    out = base_spans(text, data)
    if b"eyJ" in data:
        out += [(a, 3, b) for a, b in tokens(text) if signed_token(text[a:b])]
    if b"PRIVATE KEY-----" in data:
        out += [(m.start(), 4, m.end()) for m in PEM.finditer(text) if armoured(m[2])]
    if b"\1" * 24 in data.translate(_IS_B64):
        whole = []
        for m in WRAPPED.finditer(text):
            parts, at = [], m.start()
            for w in [*_WRAP.finditer(text, m.start(), m.end()), None]:
                parts.append((at, text[at : w.start() if w else m.end()]))
                at = w.end() if w else at
            joined_up = "".join(p for _, p in parts)
            if found := key_inside(joined_up):
                ends = list(accumulate(len(p) for _, p in parts))
                place = lambda k: (j := bisect_right(ends, k), parts[j][0] + k - (ends[j] - len(parts[j][1])))[1]
                whole.append((place(found[0]), found[1], place(found[2] - 1) + 1))
        out += whole
        for m in B64.finditer(text):
            if (found := key_inside(m[0])) and not any(a <= m.start() + found[0] and m.start() + found[2] <= b for a, _, b in whole):
                out.append((m.start() + found[0], found[1], m.start() + found[2]))
        for m in HEXKEY.finditer(text):
            if len(m[0]) % 2 == 0 and structure(bytes.fromhex(m[0])) is not None:
                out.append((m.start(), 7, m.end()))
    return sorted(out)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """Each run of overlapping spans becomes one mark that names the first kind."""
    out, at, k = [], 0, 0
    while k < len(found):
        start, kind, end = found[k]
        k += 1
        while k < len(found) and found[k][0] < end:
            end = max(end, found[k][2])
            k += 1
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def scan_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and spans: array<struct<kind, start, stop>> in order of start, then kind as listed in KINDS."""
    kept = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]

    def run(b: pa.RecordBatch) -> dict:
        found = [[{"kind": KINDS[k], "start": s, "stop": e} for s, k, e in spans(t)] for t in texts(b, text)]
        return {c: b.column(i) for i, c in enumerate(keep)} | {"spans": found}

    return map_batches(df.select(*keep, text), run, ", ".join([*kept, "spans array<struct<kind:string,start:long,stop:long>>"]))


def redact_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns; secrets in the text become marks. A null text stays null. n_chars, where there is one, follows the text."""
    names, at = df.columns, df.columns.index(text)

    def run(b: pa.RecordBatch) -> dict:
        clean = [t if t is None else (redact(t, f) if (f := spans(t)) else t) for t in b.column(at).to_pylist()]
        return {c: b.column(i) for i, c in enumerate(names)} | {text: pa.array(clean, pa.string())}

    out = map_batches(df, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))
    return out.withColumn("n_chars", F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast("long")) if "n_chars" in names else out


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def secret_digest(df: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, and all spans."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return scan_secrets(df).select("doc_id", *map(count, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
