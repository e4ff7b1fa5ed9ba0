"""Secret scans with a recursive decoding worklist (4)."""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from seclake.llm.blocks import small_batches
from seclake.session import spread

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
    r"""([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run is matched whole, so shorter ones are those dropped

_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\x[0-9A-Fa-f]{2})+")
_POINTS = re.compile(
    r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{([0-9A-Fa-f]{1,6})\}|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_URLSAFE = str.maketrans("-_", "+/")
# Base64 over line ends, real ones or escaped; a run of 16 letters opens it.
_LINE_END = r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*"
_WRAPPED = re.compile(
    rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+(?:{_LINE_END}[A-Za-z0-9+/_-]++)++(?:{_LINE_END})?={{0,2}}")
_LINE_ENDS = re.compile(_LINE_END)
_PARTS = re.compile(r"[A-Za-z0-9+]{16,}")
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")

Span = tuple[int, int, int]  # start, end, kind's number


def find(text: str) -> list[Span]:
    """Base findings of one layer."""
    low = text.lower()
    out = []
    if any(cue in low for cue in ("pass", "secret", "token", "api")):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]


def _inflated(raw: bytes) -> bytes | None:
    """The whole content of a gzip or zlib stream, of all members; None if it is none."""
    if raw[:2] == b"\x1f\x8b":
        kind = 31
    elif len(raw) > 2 and raw[0] & 0x0F == 8 and (raw[0] << 8 | raw[1]) % 31 == 0:
        kind = 15
    else:
        return None
    parts = []
    while raw:
        stream = zlib.decompressobj(kind)
        try:
            parts.append(stream.decompress(raw) + stream.flush())
        except zlib.error:
            break
        if not stream.eof or kind == 15:
            break
        raw = stream.unused_data
    return b"".join(parts) or None


def _may_inflate(start: bytes) -> bool:
    """False if a stream that starts so is broken in these bytes, and gives nothing."""
    stream, given = zlib.decompressobj(47), b""
    try:
        for k in range(len(start)):
            given = stream.decompress(start[k:k + 1])
            if given or stream.eof:
                return True
        return True
    except zlib.error:
        return False


def _texts(raw: bytes) -> list[str]:
    """Texts that decoded bytes may be: as UTF-8 with what isn't replaced, as UTF-16 of either
    order if there are NULs, and those of compressed streams that start anywhere in them."""
    texts, work, seen = [], [raw], set()
    while work:
        raw = work.pop()
        if (key := hashlib.sha256(raw).digest()) in seen:
            continue
        seen.add(key)
        texts.append(raw.decode(errors="replace"))
        if b"\0" in raw:
            texts += [raw.decode(order, "replace") for order in ("utf-16-le", "utf-16-be")]
        starts = {0} | {m.start() for m in _PACKED.finditer(raw)}
        work += [inner for at in sorted(starts) if _may_inflate(raw[at:at + 256]) and (
            inner := _inflated(raw[at:])) is not None]
    return [t for t in texts if t]


def _from_base64(body: str) -> bytes:
    """The bytes of base64 letters; one letter too many at the end is left out."""
    body = body[:len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _unescaped(m: re.Match) -> str | None:
    for group, base in ((1, 16), (2, 10), (3, 16)):
        if m[group]:
            value = int(m[group], base)
            return chr(value) if 0 < value < 0x110000 and not 0xD800 <= value < 0xE000 else None
    units = bytes.fromhex(m[0].replace("\\u", ""))
    try:
        return units.decode("utf-16-be")
    except UnicodeDecodeError:
        return None


def _run_texts(m: re.Match) -> list[str]:
    return _texts(bytes.fromhex(m[0].replace("%", "").replace("\\x", "")))


class _Layer:
    """A decoded text and where in the original each of its characters comes from.

    at and upto: start and end per character, or one span for all.
    """

    def __init__(self, text: str, at: list[int] | int, upto: list[int] | int):
        self.text, self.at, self.upto = text, at, upto

    def span(self, start: int, end: int) -> tuple[int, int]:
        if isinstance(self.at, int):
            return self.at, self.upto
        return self.at[start], self.upto[end - 1]

    def key(self) -> tuple:
        return (hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest(),
                *self.span(0, len(self.text)))

    def replaced(self, pattern: re.Pattern, decode) -> _Layer | None:
        """This layer with every run that decodes put in place; None if none does."""
        pieces, at, upto, last, changed = [], [], [], 0, False
        one = isinstance(self.at, int)

        def keep(lo: int, hi: int) -> None:
            pieces.append(self.text[lo:hi])
            if not one:
                at.extend(self.at[lo:hi])
                upto.extend(self.upto[lo:hi])

        for m in pattern.finditer(self.text):
            new = decode(m)
            if new is None:
                continue
            changed = True
            keep(last, m.start())
            pieces.append(new)
            if not one:
                run = m.end() - m.start()
                if run % len(new) == 0:  # every character took as much room
                    each = run // len(new)
                    edges = range(m.start(), m.end(), each)
                    at.extend(self.at[e] for e in edges)
                    upto.extend(self.upto[e + each - 1] for e in edges)
                else:
                    at.extend([self.at[m.start()]] * len(new))
                    upto.extend([self.upto[m.end() - 1]] * len(new))
            last = m.end()
        if not changed:
            return None
        keep(last, len(self.text))
        text = "".join(pieces)
        return _Layer(text, self.at, self.upto) if one else _Layer(text, at, upto)

    def inner(self) -> Iterator[_Layer]:
        """Layers one decoding step further in."""
        text = self.text
        if "%" in text or "\\x" in text:
            told = {m.start(): _run_texts(m) for m in _BYTES.finditer(text)}
            for k in range(max(map(len, told.values()), default=0)):
                yield self.replaced(_BYTES, lambda m: told[m.start()][min(
                    k, len(told[m.start()]) - 1)])
        if ("\\u" in text or "&#" in text) and (new := self.replaced(_POINTS, _unescaped)):
            yield new
        for start, end, body in self._encoded():
            for decoded in _texts(_from_base64(body)):
                yield _Layer(decoded, *self.span(start, end))

    def _encoded(self) -> Iterator[tuple[int, int, str]]:
        """Start, end and letters of what may be base64: each run at all four alignments, so
        that it may start and end inside, its parts between "/", "_" and "-", and lines that
        only line ends part, as a whole and those of one width."""
        for m in _BASE64.finditer(self.text):
            body = m[0].rstrip("=").translate(_URLSAFE)
            for shift in range(4):
                yield m.start(), m.end(), body[shift:]
            if len(parts := list(_PARTS.finditer(m[0]))) > 1 or parts and len(parts[0][0]) < len(body):
                for part in parts:
                    yield m.start() + part.start(), m.start() + part.end(), part[0]
        for m in _WRAPPED.finditer(self.text):
            lines, at = [], m.start()
            for cut in [*_LINE_ENDS.finditer(self.text, m.start(), m.end()), None]:
                upto = cut.start() if cut else m.end()
                if line := self.text[at:upto].rstrip("=").translate(_URLSAFE):
                    lines.append((at, upto, line))
                at = cut.end() if cut else upto
            body = "".join(line for _, _, line in lines)
            for shift in range(4):
                yield m.start(), m.end(), body[shift:]
            first = 0
            while first < len(lines):
                last = first
                while last + 1 < len(lines) and len(lines[last][2]) == len(lines[first][2]):
                    last += 1
                    if len(lines[last][2]) > len(lines[first][2]):
                        last -= 1
                        break
                if last > first and (first > 0 or last + 1 < len(lines)):
                    yield (lines[first][0], lines[last][1],
                           "".join(line for _, _, line in lines[first:last + 1]))
                first = max(first + 1, last)


def _order(span: Span) -> tuple[int, int, int]:
    start, end, kind = span
    return start, kind, end


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base findings, and all findings with those of decoded layers; both by start, then
    kind.

    The worklist ends when no layer gives a new one. A layer that came up before at the same
    place of the text is not taken again, so encodings that lead back to themselves end.
    """
    base = sorted(find(text), key=_order)
    first = _Layer(text, range(len(text)), range(1, len(text) + 1))
    work, seen, every = list(first.inner()), set(), set(base)
    while work:
        layer = work.pop()
        if (key := layer.key()) in seen:
            continue
        seen.add(key)
        every.update((*layer.span(s, e), k) for s, e, k in find(layer.text))
        work.extend(layer.inner())
    return base, sorted(every, key=_order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def secret_scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Secrets in each text and in what it holds encoded, as spans of the text.

    ``found`` lists kind, start and end (code points, end exclusive) and whether the plain
    text shows the secret or a decoded layer does: URL and Unicode escapes, base64, gzip and
    zlib, nested in any order. A span of a decoded layer covers the encoded text it came from.
    Decoded bytes need not be clean text: what isn't UTF-8 is replaced, and UTF-16 is tried.
    Base64 may go over line ends and may be a part of a longer run, as of a path; a secret that
    is read from a run and from a part of it is told with both spans.

    One row for each input row. Null and empty texts have no findings. Repeated rows and null
    ids are scanned each for itself; other columns are not read. No shuffle.
    """
    kind = pa.list_(pa.struct([
        ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(1):
                base, every = scan(value.as_py() or "")
                plain = set(base)
                found.append([{"kind": KINDS[k], "start": s, "end": e, "base": (s, e, k) in plain}
                              for s, e, k in every])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, kind)], ["doc_id", "found"])

    small_batches(docs.sparkSession)
    narrow = spread(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")))
    id_kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, (
        f"doc_id {id_kind}, "
        "found array<struct<kind:string,start:long,end:long,base:boolean>>"))
