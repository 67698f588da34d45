"""Secret scans through nested encodings.

A worklist starts with the document's text. Each layer is scanned; then every percent-encoded run, every run of
``\\uXXXX`` escapes and every base64 run in it is decoded, inflated if it is gzip, zlib, bzip2 or xz data, and put on the
list if it gives readable text that was not seen before in this document (so cycles end). Each character of a layer knows
the stretch of the document it came from, so a secret found deep inside is reported where it stands in the document:
exactly for percent and Unicode escapes, as the whole encoded run for base64 and compressed data.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberlog.llm.common import batches, ready

KINDS = ("assign", "access", "hex")

_NAMES = ("password", "passwd", "secret", "token", "api_?key")
_ANY_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in _NAMES)
_ASSIGN = re.compile(rf"(?:{_ANY_CASE})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+")
#: A run, over line ends if it goes on at the start of the next line, as encoders wrap long ones.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)*={0,2}")
_LEAST_RUN = 16
_PIECE = re.compile(r"[A-Za-z0-9+/_-]+")
_SEPARATOR = re.compile(r"[/_-]")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
_CLUES = ("password", "passwd", "secret", "token", "api")

#: What compressed data unfolds to is read in blocks of about BLOCK bytes, cut at a blank and overlapping by OVERLAP, so that
#: memory is bounded. A block grows until there is a blank to cut at, to LARGEST_BLOCK at most: only an encoded run inside
#: that is longer may be cut.
BLOCK = 1 << 22
LARGEST_BLOCK = 1 << 24
OVERLAP = 1 << 10
_STEP = 1 << 16


def scan(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)``: of each kind the leftmost non-overlapping matches that are long enough."""
    found = []
    lowered = text.lower()
    if any(clue in lowered for clue in _CLUES):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


@dataclass
class _Layer:
    """A text and, unless it is the document itself, where each of its characters begins and ends in the document, or all do."""

    text: str
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None
    fixed: tuple[int, int] | None = None

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.fixed:
            return self.fixed
        if self.starts is None:
            return start, end
        return int(self.starts[start]), int(self.ends[end - 1])

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if self.fixed:
            return np.full(len(self.text), self.fixed[0]), np.full(len(self.text), self.fixed[1])
        if self.starts is None:
            places = np.arange(len(self.text), dtype=np.int64)
            return places, places + 1
        return self.starts, self.ends


def _escapes_removed(layer: _Layer, pattern: re.Pattern, decode) -> _Layer | None:
    """The layer with every match replaced by what it stands for; None if nothing could be decoded."""
    matches = [(m.start(), m.end(), decode(m.group())) for m in pattern.finditer(layer.text)]
    matches = [m for m in matches if m[2] is not None]
    if not matches:
        return None
    starts, ends = layer.whole()
    texts, begins, stops, at = [], [], [], 0
    for start, end, text in matches:
        texts += [layer.text[at:start], text]
        begins += [starts[at:start], np.full(len(text), starts[start])]
        stops += [ends[at:start], np.full(len(text), ends[end - 1])]
        at = end
    texts.append(layer.text[at:])
    return _Layer("".join(texts), np.concatenate([*begins, starts[at:]]), np.concatenate([*stops, ends[at:]]))


def _percent_decoded(layer: _Layer) -> _Layer | None:
    """Runs of ``%XX`` as UTF-8, character by character; bytes that are not UTF-8 stay as they are."""

    def whole_run(run: str) -> str | None:
        return None if (text := _utf8(binascii.unhexlify(run.replace("%", "")))) is None else text

    runs = re.compile(f"{_PERCENT.pattern}+")
    ascii_only = re.compile("%[0-7][0-9A-Fa-f]")
    # A plain ASCII byte maps exactly; only a run with other bytes is mapped as a whole.
    first = _escapes_removed(layer, ascii_only, lambda m: chr(int(m[1:], 16)))
    rest = _escapes_removed(first or layer, runs, whole_run) if runs.search((first or layer).text) else None
    return rest or first


def _unicode_decoded(run: str) -> str | None:
    units = b"".join(int(x, 16).to_bytes(2, "little") for x in run.split("\\u")[1:])
    try:
        return units.decode("utf-16-le")
    except UnicodeDecodeError:
        return None


def _utf8(data: bytes) -> str | None:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _is_compressed(head: bytes) -> bool:
    zlib_mark = head[:1] == b"\x78" and len(head) > 1 and int.from_bytes(head[:2], "big") % 31 == 0
    return zlib_mark or head.startswith((b"\x1f\x8b", b"BZh", b"\xfd7zXZ"))


def _unpacker(head: bytes):
    if head.startswith(b"\x1f\x8b"):
        return zlib.decompressobj(31)
    if head.startswith(b"BZh"):
        return bz2.BZ2Decompressor()
    if head.startswith(b"\xfd7zXZ"):
        return lzma.LZMADecompressor(memlimit=1 << 28)
    return zlib.decompressobj()


def _steps(unpack, data: bytes) -> Iterator[bytes]:
    """What ``data`` adds, in steps of bounded size."""
    if isinstance(unpack, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
        yield unpack.decompress(data, _STEP)
        while not unpack.eof and not unpack.needs_input:
            yield unpack.decompress(b"", _STEP)
        return
    out = unpack.decompress(data, _STEP)
    yield out
    while not unpack.eof and (unpack.unconsumed_tail or len(out) == _STEP):
        out = unpack.decompress(unpack.unconsumed_tail, _STEP)
        yield out


def _members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """One compressed layer removed, of all members one after the other. Ends where the data does or is broken."""
    unpack, rest = None, b""
    for piece in pieces:
        rest += piece
        while rest:
            if unpack is None:
                if len(rest) < 6:
                    break
                if not _is_compressed(rest):
                    return
                unpack = _unpacker(rest)
            try:
                yield from _steps(unpack, rest)
            except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
                return
            rest = b""
            if unpack.eof:
                unpack, rest = None, unpack.unused_data


def _begins_text(head: bytes) -> bool:
    try:
        return not _CONTROL.search(codecs.getincrementaldecoder("utf-8")().decode(head))
    except UnicodeDecodeError:
        return False


def _inflated(pieces: Iterator[bytes], heads: frozenset[bytes] = frozenset()) -> Iterator[bytes]:
    """All compressed layers removed. Data that unfolds to its own beginning is not followed."""
    head = b""
    for piece in pieces:
        head += piece
        if len(head) >= 1024:
            break
    if head[:1024] in heads:
        return
    if _is_compressed(head) and not _begins_text(head):
        yield from _inflated(_members(chain([head], pieces)), heads | {head[:1024]})
    else:
        yield head
        yield from pieces


def _blocks(pieces: Iterator[bytes]) -> Iterator[bytes]:
    held = bytearray()
    for piece in pieces:
        held += piece
        if len(held) < BLOCK:
            continue
        cut = held.rfind(b" ", OVERLAP + 1)
        while cut > 0 and held[cut - 1] in b" \t\r\n":
            cut = held.rfind(b" ", OVERLAP + 1, cut)
        if cut < 0 and len(held) < LARGEST_BLOCK:
            continue
        cut = cut if cut > 0 else len(held)
        while cut < len(held) and held[cut] & 0xC0 == 0x80:
            cut -= 1
        yield bytes(held[:cut])
        back = cut - OVERLAP
        while held[back] & 0xC0 == 0x80 and back < cut:
            back += 1
        del held[:back]
    if held:
        yield bytes(held)


def _text(data: bytes) -> str | None:
    text = _utf8(data)
    return None if not text or _CONTROL.search(text) else text


def _decoded_base64(run: str) -> Iterator[str]:
    """The readable text in a base64 run, through any number of compressed layers; in blocks if it was compressed."""
    body = run.rstrip("=")
    if len(body) % 4 == 1:
        return
    # Words and identifiers decode to noise; what was encoded mixes cases or digits.
    if body.isalpha() and (body.islower() or body.isupper() or body.istitle()):
        return
    try:
        data = base64.b64decode(_standard(body) + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return
    if text := _text(data):
        yield text
    elif _is_compressed(data):
        pieces = (data[i : i + _STEP] for i in range(0, len(data), _STEP))
        yield from filter(None, map(_text, _blocks(_inflated(pieces))))


def _standard(chars: str) -> str:
    return chars.replace("-", "+").replace("_", "/")


def _readable(chars: str, at: int) -> int:
    """Where the characters from ``at`` on stop to decode to readable text, to within four."""
    decoder, size = codecs.getincrementaldecoder("utf-8")(), 32
    while len(chars) - at >= 4:
        block = chars[at : at + size]
        block = block[: len(block) // 4 * 4]
        waiting = len(decoder.getstate()[0])
        try:
            text = decoder.decode(base64.b64decode(_standard(block)))
        except UnicodeDecodeError as error:
            text = error.object[: error.start].decode()
            bad = _CONTROL.search(text)
            return at + (len(text[: bad.start()].encode() if bad else text.encode()) - waiting) * 4 // 3
        if bad := _CONTROL.search(text):
            return at + (len(text[: bad.start()].encode()) - waiting) * 4 // 3
        at, size = at + len(block), 4096
    return len(chars)


def _base64_parts(run: str) -> Iterator[tuple[int, int, str]]:
    """``(start, end, text)`` of what can be read in a run: all of it, or else stretches between separators and line ends.

    From each possible start the longest stretch is taken, and the search goes on behind it.
    """
    pieces = [m.span() for m in _PIECE.finditer(run)]
    joined = "".join(run[a:b] for a, b in pieces)
    found = False
    for text in _decoded_base64(joined):
        found = True
        yield 0, len(run), text
    if found:
        return
    sizes = list(accumulate(b - a for a, b in pieces))
    cuts = {m.start() for m in _SEPARATOR.finditer(joined)}
    starts = sorted({0, *(c + 1 for c in cuts), *sizes[:-1]})
    ends = sorted({*cuts, *sizes})

    def place(at: int) -> int:
        k = bisect_right(sizes, at) if at < sizes[-1] else len(sizes) - 1
        return pieces[k][0] + at - (sizes[k - 1] if k else 0)

    behind = 0
    for start in starts:
        if start < behind or len(joined) - start < _LEAST_RUN:
            continue
        head = base64.b64decode(_standard(joined[start : start + 8]))
        # One character more than whole bytes take is none of them.
        whole = len(joined) - ((len(joined) - start) % 4 == 1)
        if _is_compressed(head):
            for text in _decoded_base64(joined[start:whole]):
                found = True
                yield place(start), len(run), text
            if found:
                return
        limit = _readable(joined, start) + 4
        for k in range(bisect_right(ends, limit) - 1, -1, -1):
            if ends[k] - start < _LEAST_RUN:
                break
            if text := next(_decoded_base64(joined[start : ends[k]]), None):
                # The padding belongs to the last stretch.
                behind = ends[k]
                yield place(start), len(run) if behind == len(joined) else place(behind - 1) + 1, text
                break


def _unwrapped(layer: _Layer) -> Iterator[_Layer]:
    text = layer.text
    if "%" in text and _PERCENT.search(text) and (one := _percent_decoded(layer)):
        yield one
    if "\\u" in text and (one := _escapes_removed(layer, _ESCAPE, _unicode_decoded)):
        yield one
    for run in _BASE64.finditer(text):
        for begin, stop, inner in _base64_parts(run.group()):
            start, end = layer.span(run.start() + begin, run.start() + stop)
            yield _Layer(inner, fixed=(start, end))


def find_secrets(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """``(base, all)`` spans by start, then kind. ``base`` is the scan of the text itself; ``all`` adds inner layers."""

    def in_order(spans):
        return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))

    base = in_order(scan(text or ""))
    found, seen = list(base), set()
    # Layers wait as iterators, so that of long compressed data there is one block at a time.
    work = [_unwrapped(_Layer(text or ""))]
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
            continue
        if not inner.text or inner.text == text:
            continue
        # The same inner text at another place is another finding, so the place is part of what was seen.
        mark = (sha256(inner.text.encode("utf-8", "surrogatepass")).digest(), inner.span(0, 1)[0], inner.span(0, len(inner.text))[1])
        if mark in seen:
            continue
        seen.add(mark)
        found += {(kind, *inner.span(start, end)) for kind, start, end in scan(inner.text)}
        work.append(_unwrapped(inner))
    return base, in_order(found)


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _report(text: str | None) -> tuple:
    base, spans = find_secrets(text)
    counts = [sum(s[0] == kind for s in base) for kind in KINDS]
    return *counts, sha256(_listed(base).encode()).hexdigest(), _listed(spans)


_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_FOUND_ARROW = pa.schema(
    [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())]
)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts and digest of the base spans, and all spans.

    Null and empty texts have none. Repeated rows give repeated rows; an empty table gives none; further columns are
    left out. There is no limit on depth or length, but see :data:`LARGEST_BLOCK`.
    """
    ready(docs.sparkSession)

    def run(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (name, *_report(text))
            for batch in texts
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        )
        return batches(rows, _FOUND_ARROW, 2_000)

    return docs.select("doc_id", "text").mapInArrow(run, _FOUND)


def without_secrets(docs: DataFrame) -> DataFrame:
    """The same rows and columns, each secret in ``text`` replaced by ``[kind]``. ``n_chars``, if there, follows."""
    ready(docs.sparkSession)
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [redacted(text) for text in batch.column(at).to_pylist()]
            columns = [*batch.columns]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if size is not None and pa.types.is_integer(batch.schema.field(size).type):
                old = columns[size].to_pylist()
                columns[size] = pa.array([n if t is None else len(t) for n, t in zip(old, texts)], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def redacted(text: str | None) -> str | None:
    """The text with each stretch of overlapping findings replaced by the kind of its first."""
    spans = find_secrets(text)[1]
    if not spans:
        return text
    parts, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]
