"""Secrets in texts, also below URL, Unicode, base64 and compressed layers.

A text is the first layer of a worklist. Every layer is scanned for the three kinds of secrets and then unwrapped:
lines with escapes give a layer with their escapes decoded, base64 runs one with their bytes, compressed bytes one
with what they inflate to. Layers are unwrapped in turn until nothing new comes; a layer with content and place of an
earlier one is left out, which also ends cycles. A layer knows how its positions map to the layer it came from, so
that each secret found anywhere has a span in the text.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.texts import arrow, blocks, per_text, utf8

# Kinds of secrets, their patterns and least lengths (of the value for assignments).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
ASSIGN_VALUE = 8
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
HEX = re.compile(rb"[0-9a-f]{32,}")

ESCAPE = re.compile(
    rb"%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}"
    rb"|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
)
LONGEST_ESCAPE = 10
RUN = re.compile(rb"[A-Za-z0-9+/_-]{16,}")
WRAPPED = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:\r?\n[A-Za-z0-9+/_-]{4,})+")
# No secret and no further layer is shorter than this.
READABLE = re.compile(rb"[\t\n\r\x20-\x7e]{14,}")
WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){14,}|(?:\x00[\t\n\r\x20-\x7e]){14,}")

Back = Callable[[int, int], tuple[int, int]]
Span = tuple[int, int, int]


class Limits(NamedTuple):
    """``escape_layers``: a line is unescaped layer by layer that often, then to its fixpoint at once.
    ``piece_bytes``: inflated bytes are read in pieces of this size, cut at a line end. ``inflated_bytes``: what the
    compressed layers of one text may inflate to in all; beyond, the text is marked as not complete."""

    escape_layers: int = 16
    piece_bytes: int = 16 << 20
    inflated_bytes: int = 1 << 30


class Layer(NamedTuple):
    data: bytes
    back: Back
    path: str
    escapes: int = 0


def matches(data: bytes) -> list[Span]:
    """(kind, start, end) of every secret of a layer; without overlaps within a kind, leftmost first."""
    found = [(0, *m.span()) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if b"AKIA" in data:
        found += [(1, *m.span()) for m in ACCESS.finditer(data)]
    return found + [(2, *m.span()) for m in HEX.finditer(data)]


def unescaped(token: bytes) -> bytes:
    if token[:1] == b"%" or token[:2] == b"\\x":
        return bytes([int(token[-2:], 16)])
    digits = token.strip(b"\\uU{}&#xX;")
    point = int(digits, 10 if token[:1] == b"&" and token[2:3] not in (b"x", b"X") else 16)
    return chr(point).encode("utf-8", "surrogatepass") if point < 0x110000 else token


def spliced(parent: Layer, start: int, end: int, cuts: list[tuple[int, int, bytes]], path: str, escapes: int) -> Layer:
    """``parent.data[start:end]`` with each cut (start, end, bytes) replaced, as a layer."""
    data, here, there, exact, at, size = [], [], [], [], start, 0
    for a, b, new in [*cuts, (end, end, b"")]:
        for piece, begin, whole in ((parent.data[at:a], at, True), (new, a, False)):
            if piece:
                here.append(size)
                there.append((begin, b))
                exact.append(whole)
                data.append(piece)
                size += len(piece)
        at = b

    def back(s: int, e: int) -> tuple[int, int]:
        first, last = bisect_right(here, s) - 1, bisect_right(here, max(e - 1, s)) - 1
        if first < 0:
            return parent.back(start, end)
        low = there[first][0] + (s - here[first] if exact[first] else 0)
        high = there[last][0] + e - here[last] if exact[last] else there[last][1]
        return parent.back(low, high)

    return Layer(b"".join(data), back, path, escapes)


def settled(parent: Layer, start: int, end: int, path: str, escapes: int) -> Layer:
    """A line with its escapes decoded until none is left, from left to right in one pass."""
    data, starts, ends = bytearray(), [], []
    for at in range(start, end):
        data.append(parent.data[at])
        starts.append(at)
        ends.append(at + 1)
        while (tail := re.search(rb"(?:" + ESCAPE.pattern + rb")\Z", data[-LONGEST_ESCAPE:])) is not None:
            new, size = unescaped(tail[0]), len(tail[0])
            if new == tail[0]:
                break
            low = starts[-size]
            del data[-size:], starts[-size:], ends[-size:]
            data += new
            starts += [low] * len(new)
            ends += [at + 1] * len(new)

    def back(s: int, e: int) -> tuple[int, int]:
        if not starts:
            return parent.back(start, end)
        return parent.back(starts[min(s, len(starts) - 1)], ends[max(e - 1, s)])

    return Layer(bytes(data), back, path, escapes)


def escaped_lines(layer: Layer, limits: Limits) -> Iterator[Layer]:
    """Lines that hold URL or Unicode escapes, decoded. No secret reaches over a line end."""
    if not (b"%" in layer.data or b"\\" in layer.data or b"&#" in layer.data):
        return
    cuts: list[tuple[int, int, bytes]] = []
    start = end = -1

    def line() -> Layer:
        if layer.escapes < limits.escape_layers:
            return spliced(layer, start, end, cuts, f"{layer.path}>escape", layer.escapes + 1)
        return settled(layer, start, end, f"{layer.path}>escapes", layer.escapes + 1)

    for m in ESCAPE.finditer(layer.data):
        if m.start() >= end:
            if cuts:
                yield line()
            cuts = []
            start = layer.data.rfind(b"\n", 0, m.start()) + 1
            end = layer.data.find(b"\n", m.start())
            end = len(layer.data) if end < 0 else end
        new = unescaped(m[0])
        if new != m[0]:
            cuts.append((*m.span(), new))
    if cuts:
        yield line()


def magic(data: bytes) -> str | None:
    if data[:3] == b"\x1f\x8b\x08":
        return "gzip"
    if len(data) > 2 and data[0] & 0x8F == 0x08 and not int.from_bytes(data[:2], "big") % 31 and not data[1] & 0x20:
        return "zlib"
    for name, start in (("bz2", b"BZh"), ("xz", b"\xfd7zXZ\x00"), ("zstd", b"\x28\xb5\x2f\xfd")):
        if data.startswith(start):
            return name
    return None


def decoded_run(run: bytes) -> tuple[int, bytes] | None:
    """(characters to leave out in front, bytes) of a base64 run. Other letters may stand before it unseparated."""
    best, most = None, 0
    for skip in range(4):
        body = run[skip:]
        body = body[: len(body) - (len(body) % 4 == 1)]
        try:
            data = binascii.a2b_base64(body + b"=" * (-len(body) % 4))
        except binascii.Error:
            continue
        if skip == 0 and magic(data):
            return skip, data
        readable = sum(len(m[0]) for m in READABLE.finditer(data)) or len(b"".join(WIDE.findall(data)))
        if readable > most:
            best, most = (skip, data), readable
    return best


def base64_runs(layer: Layer) -> Iterator[Layer]:
    for m in WRAPPED.finditer(layer.data):
        cuts = [(*b.span(), b"") for b in re.compile(rb"\r?\n").finditer(layer.data, *m.span())]
        yield spliced(layer, *m.span(), cuts, f"{layer.path}>joined", layer.escapes)
    for m in RUN.finditer(layer.data):
        if made := decoded_run(m[0].translate(bytes.maketrans(b"-_", b"+/"))):
            skip, data = made
            begin, stop = m.start() + skip, m.end()

            def back(s: int, e: int, begin: int = begin, stop: int = stop) -> tuple[int, int]:
                return layer.back(begin + s * 4 // 3, min(begin - (-e * 4 // 3), stop))

            yield Layer(data, back, f"{layer.path}>base64")


def wide_runs(layer: Layer) -> Iterator[Layer]:
    """Letters of two bytes each, as UTF-16 writes them."""
    for m in WIDE.finditer(layer.data):
        begin, odd = m.start(), m[0][0] == 0

        def back(s: int, e: int, begin: int = begin) -> tuple[int, int]:
            return layer.back(begin + 2 * s, begin + 2 * e)

        yield Layer(m[0][odd::2], back, f"{layer.path}>utf-16")


class Budget:
    """Bytes that compressed layers of a text may still inflate to."""

    def __init__(self, size: int) -> None:
        self.left, self.complete = size, True


def inflated(layer: Layer, limits: Limits, budget: Budget) -> Iterator[Layer]:
    """What a compressed layer holds, as layers of bounded size. Each of them stands for the whole compressed run."""
    name = magic(layer.data)
    if name is None:
        return
    whole = layer.back(0, len(layer.data))
    path = f"{layer.path}>{name}"

    def reader() -> Callable[[int], bytes]:
        if name == "zstd":
            return zstandard.ZstdDecompressor().stream_reader(layer.data).read
        held = bz2.BZ2Decompressor() if name == "bz2" else lzma.LZMADecompressor() if name == "xz" else None
        if held is not None:
            fed = [layer.data]
            return lambda size: b"" if held.eof else held.decompress(fed.pop() if fed else b"", size)
        stream, rest = zlib.decompressobj(47), [layer.data]

        def read(size: int) -> bytes:
            data = stream.decompress(rest[0], size)
            rest[0] = stream.unconsumed_tail
            return data

        return read

    read, held, overlap = reader(), b"", min(1 << 16, limits.piece_bytes // 2)
    while True:
        try:
            data = read(limits.piece_bytes)
        except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError):
            data = b""
        if not data:
            break
        if budget.left <= 0:
            budget.complete = False
            break
        budget.left -= len(data)
        held += data
        if len(held) >= limits.piece_bytes:
            cut = held.rfind(b"\n") + 1
            yield Layer(held[:cut] if cut else held, lambda s, e: whole, path)
            held = held[cut:] if cut else held[-overlap:]
    if held:
        yield Layer(held, lambda s, e: whole, path)


def unwrapped(layer: Layer, limits: Limits) -> Iterator[Layer]:
    yield from escaped_lines(layer, limits)
    yield from base64_runs(layer)
    if b"\x00" in layer.data:
        yield from wide_runs(layer)


class Found(NamedTuple):
    """``base``: spans of the text itself; ``spans``: all, with the layers each was first found below; in bytes."""

    base: list[Span]
    spans: dict[Span, str]
    layers: int
    complete: bool


def scan(text: bytes, limits: Limits = Limits()) -> Found:
    """Secrets of a UTF-8 text. Layers are made one at a time, so that only one of each depth is held."""
    base = matches(text)
    spans = dict.fromkeys(base, "")
    root, budget = Layer(text, lambda s, e: (s, e), ""), Budget(limits.inflated_bytes)
    work, seen, layers = [unwrapped(root, limits)], set(), 0
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        key = (hashlib.blake2b(layer.data, digest_size=16).digest(), layer.back(0, len(layer.data)))
        if key in seen:
            continue
        seen.add(key)
        layers += 1
        inner = inflated(layer, limits, budget)
        if first := next(inner, None):
            # Packed bytes are no text: what looks like a secret in them is none.
            work.append(chain([first], inner))
            continue
        for kind, s, e in matches(layer.data):
            spans.setdefault((kind, *layer.back(s, e)), layer.path[1:])
        work.append(unwrapped(layer, limits))
    return Found(base, spans, layers, budget.complete)


def in_points(text: bytes, spans: Sequence[Span]) -> list[Span]:
    """Spans in bytes as spans in code points, by start, then kind, then end."""
    if text.isascii():
        return sorted(spans, key=lambda x: (x[1], x[0], x[2]))
    raw, points, at, count = np.frombuffer(text, np.uint8), {}, 0, 0
    for place in sorted({p for _, s, e in spans for p in (s, e)}):
        count += int(np.count_nonzero((raw[at:place] & 0xC0) != 0x80))
        points[place], at = count, place
    return sorted(((k, points[s], points[e]) for k, s, e in spans), key=lambda x: (x[1], x[0], x[2]))


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


FIELDS = T.StructType(
    [
        *[T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS],
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("n_added", T.LongType()),
        T.StructField("n_layers", T.LongType()),
        T.StructField("complete", T.BooleanType()),
    ]
)
SPAN_FIELDS = T.StructType([T.StructField("found", T.ArrayType(T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("layers", T.StringType()),
    ]
)))])


def secret_counts(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", limits: Limits = Limits()
) -> DataFrame:
    """Secrets of every text, in one pass without a shuffle.

    ``n_assign``, ``n_access``, ``n_hex`` and ``base_sha256`` are of the secrets in the text itself, ``spans`` also
    has those of its layers (``n_added`` spans more, in ``n_layers`` layers). ``complete`` is false where compressed
    layers inflate beyond the limit. Null and empty texts have no secrets; repeated rows each give a row, null
    ids stay null, other columns are not read, and an empty table gives no rows.
    """

    def start() -> Callable:
        def make(texts: Sequence[bytes | None]) -> list:
            rows = []
            for data in texts:
                found = scan(data or b"", limits)
                counts = [sum(k == kind for k, _, _ in found.base) for kind in range(len(KINDS))]
                base = joined(in_points(data or b"", found.base))
                every = joined(in_points(data or b"", list(found.spans)))
                added = len(found.spans) - len(found.base)
                digest = hashlib.sha256(base.encode()).hexdigest()
                rows.append((*counts, digest, every, added, found.layers, found.complete))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.bool_()]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            return [pa.array(list(c), kind) for c, kind in zip(columns, kinds)]

        return make

    return per_text(docs, text, [id_column], FIELDS, start)


def secret_spans(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", limits: Limits = Limits()
) -> DataFrame:
    """One row (id, kind, start, end, layers) per secret; ``layers`` names what had to be unwrapped, e.g.
    ``base64>gzip``, and is empty for those of the text itself. Positions are code points, ends exclusive.
    Texts without secrets, null and empty texts give no row."""

    def start() -> Callable:
        def make(texts: Sequence[bytes | None]) -> list:
            rows = []
            for data in texts:
                data = data or b""
                found = scan(data, limits).spans
                place = dict(zip(in_order(found), in_points(data, list(found))))
                rows.append([(KINDS[k], s, e, found[span]) for span, (k, s, e) in place.items()])
            kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layers", pa.string())])
            return [pa.array([[dict(zip(kind.names, r)) for r in row] for row in rows], pa.list_(kind))]

        return make

    rows = per_text(docs, text, [id_column], SPAN_FIELDS, start)
    return rows.select(F.col(f"`{id_column}`"), F.inline("found"))


def in_order(spans: Sequence[Span]) -> list[Span]:
    """The order of :func:`in_points`; bytes and code points sort alike."""
    return sorted(spans, key=lambda x: (x[1], x[0], x[2]))


def masked(text: bytes, limits: Limits = Limits()) -> bytes:
    """The text with what its secrets cover replaced by ``[kind]``; overlapping spans become one."""
    parts, at = [], 0
    for kind, s, e in in_order(scan(text, limits).spans):
        if e > at:
            if s >= at:
                parts += [text[at:s], b"[", KINDS[kind].encode(), b"]"]
            at = e
    return b"".join([*parts, text[at:]])


def mask_secrets(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The same rows and columns with secrets masked in the texts. Null texts stay null."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.columns[at])
            for a, b in blocks(texts):
                made = [None if t is None else masked(t, limits).decode() for t in texts[a:b]]
                columns = [c.slice(a, b - a) for c in batch.columns]
                columns[at] = pa.array(made, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return arrow(docs, run, docs.schema)
