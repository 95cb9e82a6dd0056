"""Secret scans with structural confirmation.

Three patterns find what looks like a secret: an assignment to a telling name, an access key id and a
long run of hex digits. Beyond them nothing is reported for its looks. Runs of base64 or hex digits are
decoded, and a span is added only if the bytes are a key or the text a signed token: private keys are
read as nested lengths that must fill each other exactly (DER of PKCS #1, PKCS #8, SEC 1 and DSA, and
the OpenSSH container), signed tokens by their header, their claims and the length that the header's
algorithm gives a signature. Decoded text is scanned again, as often as it is encoded.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.textwords import slices

#: The base kinds as the contract lists them, then what the decoding confirms.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "der_key", "ssh_key", "signed_token", "encoded")

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

_BREAK = r"(?:\r?\n[ \t]*|(?:\\r)?\\n)"
#: Encoded runs: a line of 40 or 64 digits at least, with the lines that follow it.
BASE64_RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{40,}}(?:{_BREAK}[A-Za-z0-9+/_-]+)*")
HEX_RUN = re.compile(rf"(?<![0-9A-Fa-f])[0-9A-Fa-f]{{64,}}(?:{_BREAK}[0-9A-Fa-f]+)*")
_SEPARATOR = re.compile(_BREAK)
_STANDARD = str.maketrans("-_", "+/")
#: How a DER sequence of more than 31 bytes, or the magic of the OpenSSH container, begins in each encoding.
BASE64_START = re.compile(r"M(?:I[E-L]|[A-H])|b3BlbnNzaC1rZXktdjEA")
HEX_START = re.compile(r"30(?:8[12]|[2-7][0-9a-f])|6f70656e7373682d6b65792d763100")
_TOKEN_START = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9]")
_TOKEN = re.compile(r"([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)(?!\.[A-Za-z0-9_-])")
_PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]+")

#: Object identifiers in DER, as their standards give them.
OID_RSA = bytes.fromhex("2a864886f70d010101")
OID_EC = bytes.fromhex("2a8648ce3d0201")
OID_DSA = bytes.fromhex("2a8648ce380401")
OID_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
#: X25519, X448, Ed25519 and Ed448, and the bytes of their private keys.
OID_CURVES = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
#: Bytes of a signature by algorithm; RSA signatures have those of the modulus.
SIGNATURES = {
    "HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114),
    "RS256": (), "RS384": (), "RS512": (), "PS256": (), "PS384": (), "PS512": (),
}
_MAGIC = b"openssh-key-v1\0"
Span = tuple[str, int, int, str]


# ---------------------------------------------------------------- base patterns


def base_spans(text: str) -> Iterator[Span]:
    """Matches of the three patterns that are long enough, each kind from left to right."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 12:
            yield "assign", m.start(), m.end(), m[1].lower()
    for m in ACCESS.finditer(text):
        yield "access", m.start(), m.end(), ""
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end(), ""


# ---------------------------------------------------------------- key encodings


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, begin, end) of the DER element at a place, with the shortest form of its length."""
    if at + 2 > end:
        return None
    size, begin = data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or begin + n > end or data[begin] == 0:
            return None
        size, begin = int.from_bytes(data[begin : begin + n]), begin + n
        if size < 0x80:
            return None
    return (data[at], begin, begin + size) if begin + size <= end else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill a stretch exactly; no key has more than twelve side by side."""
    out: list[tuple[int, int, int]] = []
    while at < end and len(out) < 13:
        e = _element(data, at, end)
        if e is None:
            return None
        out.append(e)
        at = e[2]
    return out if at == end and len(out) < 13 else None


def _positive(data: bytes, e: tuple[int, int, int]) -> bool:
    tag, i, j = e
    return tag == 2 and i < j and data[i] < 0x80 and (j == i + 1 or data[i] > 0 or data[i + 1] >= 0x80)


def _version(data: bytes, e: tuple[int, int, int]) -> int | None:
    return data[e[1]] if e[0] == 2 and e[2] == e[1] + 1 else None


def der_key(data: bytes, at: int, end: int) -> tuple[str, int] | None:
    """What private key begins at a place, and where it ends."""
    outer = _element(data, at, end)
    if outer is None or outer[0] != 0x30:
        return None
    parts = _elements(data, outer[1], outer[2])
    kind = _private(data, parts) if parts else None
    return (kind, outer[2]) if kind else None


def _private(data: bytes, parts: list[tuple[int, int, int]]) -> str | None:
    tags, version = [t for t, _, _ in parts], _version(data, parts[0])
    bits = lambda e: 8 * (e[2] - e[1])
    if tags[:9] == [2] * 9 and (tags[9:], version) in (([], 0), ([0x30], 1)):
        ok = all(_positive(data, e) for e in parts[1:9]) and bits(parts[1]) >= 512 and data[parts[1][2] - 1] & 1 and data[parts[2][2] - 1] & 1
        return "rsa" if ok else None
    if tags == [2] * 6 and version == 0:
        return "dsa" if all(_positive(data, e) for e in parts[1:]) and bits(parts[1]) >= 512 else None
    if tags[:2] == [2, 4] and version == 1 and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1]):
        inside = {t: _elements(data, i, j) for t, i, j in parts[2:]}
        curve, point = inside.get(0xA0, [(6, 0, 1)]), inside.get(0xA1, [(3, 0, 1)])
        ok = curve and len(curve) == 1 and curve[0][0] in (6, 0x30) and point and len(point) == 1 and point[0][0] == 3
        return "ec" if ok and 14 <= parts[1][2] - parts[1][1] <= 72 else None
    if tags[:3] == [2, 0x30, 4] and version in (0, 1) and set(tags[3:]) <= {0xA0, 0x81, 0xA1}:
        name = _algorithm(data, parts[1])
        return f"pkcs8 {kind}" if name and (kind := _wrapped(data, name, parts[2])) else None
    if tags == [0x30, 4] and parts[1][2] - parts[1][1] >= 8:
        name = _algorithm(data, parts[0])
        return "pkcs8 encrypted" if name and name.startswith(OID_PBE) else None
    return None


def _algorithm(data: bytes, e: tuple[int, int, int]) -> bytes | None:
    parts = _elements(data, e[1], e[2])
    return data[parts[0][1] : parts[0][2]] if parts and parts[0][0] == 6 else None


def _wrapped(data: bytes, name: bytes, octets: tuple[int, int, int]) -> str | None:
    """What a PKCS #8 key of an algorithm holds."""
    inner = _element(data, octets[1], octets[2])
    if inner is None or inner[2] != octets[2]:
        return None
    if name in OID_CURVES:
        return "curve" if inner[0] == 4 and inner[2] - inner[1] == OID_CURVES[name] else None
    if name == OID_DSA:
        return "dsa" if _positive(data, inner) else None
    if name in (OID_RSA, OID_EC) and inner[0] == 0x30 and (parts := _elements(data, inner[1], inner[2])):
        kind = _private(data, parts)
        return kind if kind == ("rsa" if name == OID_RSA else "ec") else None
    return None


def _string(data: bytes, at: int) -> tuple[bytes, int] | None:
    """A string behind its length in four bytes."""
    end = at + 4 + int.from_bytes(data[at : at + 4])
    return (data[at + 4 : end], end) if at + 4 <= end <= len(data) else None


def ssh_key(data: bytes, at: int) -> tuple[str, int] | None:
    """What OpenSSH key begins at a place, and where it ends."""
    if not data.startswith(_MAGIC, at):
        return None
    at += len(_MAGIC)
    fields = []
    for _ in range(3):
        if (s := _string(data, at)) is None:
            return None
        fields.append(s[0])
        at = s[1]
    cipher, kdf, options = fields
    if data[at : at + 4] != b"\0\0\0\1" or (cipher == b"none") != (kdf == b"none") or (kdf == b"none" and options):
        return None
    public = _string(data, at + 4)
    private = _string(data, public[1]) if public else None
    name = _string(public[0], 0) if public else None
    if not private or not name or len(private[0]) % 8 or not private[0]:
        return None
    if cipher != b"none":
        return "ssh encrypted", private[1]
    own = _string(private[0], 8)
    return ("ssh", private[1]) if private[0][:4] == private[0][4:8] and own and own[0] == name[0] else None


def signed_token(text: str, at: int) -> tuple[str, int] | None:
    """The algorithm of the signed token that begins at a place, and where it ends."""
    m = _TOKEN.match(text, at)
    if m is None:
        return None
    try:
        header = json.loads(_base64(m[1]))
        if not isinstance(header, dict) or header.get("alg") not in SIGNATURES or not isinstance(json.loads(_base64(m[2])), dict):
            return None
        size, known = len(_base64(m[3])), SIGNATURES[header["alg"]]
    except (ValueError, TypeError, RecursionError):
        return None
    return (header["alg"], m.end()) if size in known or (not known and size >= 128) else None


def _base64(digits: str) -> bytes:
    """The bytes of digits without their padding; one digit over is not base64."""
    if len(digits) % 4 == 1:
        raise ValueError("not base64")
    return base64.b64decode(digits.translate(_STANDARD) + "=" * (-len(digits) % 4))


# ---------------------------------------------------------------- encoded runs


class _Run:
    """Digits of an encoded run without its line breaks, and where each stands in the text."""

    def __init__(self, text: str, m: re.Match, bits: int):
        self.text, self.unit, self.bytes_of = text, *((4, 3) if bits == 6 else (2, 1))
        pieces, at = [], m.start()
        for gap in _SEPARATOR.finditer(text, m.start(), m.end()):
            pieces.append((at, gap.start()))
            at = gap.end()
        self.pieces = [p for p in (*pieces, (at, m.end())) if p[0] < p[1]]
        self.sums = [0, *accumulate(j - i for i, j in self.pieces)]
        self.digits = "".join(text[i:j] for i, j in self.pieces)
        self.digits = self.digits.translate(_STANDARD) if bits == 6 else self.digits.lower()
        self.starts = BASE64_START if bits == 6 else HEX_START
        self._decoded: dict[int, bytes] = {}

    def decoded(self, shift: int) -> bytes:
        """The bytes from one of the first digits on; what is left over at the end goes."""
        if shift not in self._decoded:
            digits = self.digits[shift : shift + (len(self.digits) - shift) // self.unit * self.unit]
            rest = self.digits[shift + len(digits) :]
            if self.unit == 2:
                self._decoded[shift] = bytes.fromhex(digits)
            else:
                digits += rest + "=" * (4 - len(rest)) if len(rest) > 1 else ""
                self._decoded[shift] = base64.b64decode(digits)
        return self._decoded[shift]

    def place(self, digit: int) -> int:
        """Where a digit stands."""
        low, high = 0, len(self.pieces) - 1
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.sums[mid] <= digit else (low, mid - 1)
        return self.pieces[low][0] + digit - self.sums[low]

    def end(self, shift: int, size: int) -> int:
        """The place behind the last digit of the first ``size`` bytes, and behind their padding."""
        used = -(-size * self.unit // self.bytes_of) if self.unit == 4 else 2 * size
        at = self.place(shift + used - 1) + 1
        pad = -used % 4 if self.unit == 4 else 0
        while pad and self.text[at : at + 1] == "=":
            at, pad = at + 1, pad - 1
        return at

    def keys(self) -> Iterator[Span]:
        """Every key that begins at some digit, outermost ones only."""
        done = 0
        at = self.starts.search(self.digits)
        while at:
            i = at.start()
            shift = i % self.unit
            data, offset = self.decoded(shift), (i - shift) // self.unit * self.bytes_of
            found, kind = ssh_key(data, offset), "ssh_key"
            if found is None:
                found, kind = der_key(data, offset, len(data)), "der_key"
            done = i + 1
            if found:
                yield kind, self.place(i), self.end(shift, found[1]), found[0]
                done = shift + found[1] * self.unit // self.bytes_of
            at = self.starts.search(self.digits, done)


def confirmed_spans(text: str) -> Iterator[Span]:
    """Keys and signed tokens, by their structure; found in decoded text, they span the run that holds it."""
    for pattern, bits in ((BASE64_RUN, 6), (HEX_RUN, 4)):
        for m in pattern.finditer(text):
            run = _Run(text, m, bits)
            found = list(run.keys())
            yield from found
            if found or len(run.digits) % run.unit == 1:
                continue
            data = run.decoded(0)
            if _PRINTABLE.fullmatch(data):
                inner = data.decode()
                spans = [*confirmed_spans(inner), *(("encoded", i, j, k) for k, i, j, _ in base_spans(inner) if k != "hex")]
                if spans:
                    kind, _, _, detail = min(spans, key=lambda s: KINDS.index(s[0]))
                    yield kind, m.start(), run.end(0, len(data)), f"{'base64' if bits == 6 else 'hex'} {detail}"
    at = _TOKEN_START.search(text)
    while at:
        found = signed_token(text, at.start())
        if found:
            yield "signed_token", at.start(), found[1], found[0]
        at = _TOKEN_START.search(text, found[1] if found else at.start() + 1)


def find_spans(text: str) -> list[Span]:
    """All spans of a text, by start, kind and end."""
    spans = {*base_spans(text), *confirmed_spans(text)}
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2], s[3]))


# ---------------------------------------------------------------- over tables


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``(id, found)``, ``found`` being an array of (kind, start, end, detail).

    Places are code points, ends exclusive, in order of start, kind and end. Base kinds are reported by
    their pattern alone; ``der_key``, ``ssh_key``, ``signed_token`` and ``encoded`` (an assignment or an
    access key in decoded text) only after decoding.

    Defined results: null and empty texts have no spans; a text of any length is scanned whole, by one
    task, in time linear in it; repeated rows and ids, null ids too, are scanned alike; an empty table
    gives an empty result; other columns are ignored, so their names can't clash.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("detail", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [
                    [dict(zip(("kind", "start", "end", "detail"), s, strict=True)) for s in find_spans(t)] if t else []
                    for t in (x.as_py() for x in batch.column("text"))
                ]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(span))], ["id", "found"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, found array<struct<kind:string,start:int,end:int,detail:string>>")


def described(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans, for each row of ``scan_secrets``."""
    of = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    return found.select(
        F.col("id").alias("doc_id"), *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(described(of(*BASE)).cast("binary"), 256).alias("base_sha256"), described(F.col("found")).alias("spans"),
    )
