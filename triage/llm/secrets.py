"""Secret scan: texts are unwrapped layer by layer until nothing new appears, each layer is scanned, and
every find is mapped back to the place in the text that it came from."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
# Parts of which an assignment has one; looked for first, in lower case.
ASSIGN_PARTS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN_LENGTH = 6
# "AKIA[A-Z0-9]+" of 20 or more, "[0-9a-f]+" of 24 or more: both take whole runs, so the length can be asked for.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\x[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{4,})*={0,2}")
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
# Layers of percent signs that are opened one by one; deeper ones are resolved at once.
URL_LAYERS = 16
# A compressed layer that would grow beyond this stays closed and is counted, so memory is bounded.
LAYER_BYTES = 64 << 20


class Find(NamedTuple):
    start: int
    end: int
    kind: str
    path: str  # the wrappings passed, outermost first; empty for the text itself
    value: str


class Layer(NamedTuple):
    text: str
    starts: list[int] | None  # for each character where it begins in the original; None: the same places
    ends: list[int] | None
    path: str

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])


def scan_layer(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end): leftmost matches that do not overlap, for each kind."""
    found = []
    low = text.lower()
    if any(p in low for p in ASSIGN_PARTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def _inflate(data: bytes) -> tuple[bytes | None, bool]:
    """(content, True) if ``data`` begins with a compressed stream, the content of all its members one after
    the other; content None if the first is broken or all are too large."""
    import zstandard

    if data[:4] == b"\x28\xb5\x2f\xfd":
        try:
            with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as stream:
                content = stream.read(LAYER_BYTES + 1)
        except zstandard.ZstdError:
            return None, False
        return (content, True) if len(content) <= LAYER_BYTES else (None, True)
    whole, packed = b"", False
    while data:
        if data[:2] == b"\x1f\x8b" or (data[:1] == b"\x78" and data[1:2] in (b"\x01", b"\x5e", b"\x9c", b"\xda")):
            machine, wrong = zlib.decompressobj(wbits=47), zlib.error
        elif data[:3] == b"BZh":
            machine, wrong = bz2.BZ2Decompressor(), (OSError, ValueError)
        elif data[:6] == b"\xfd7zXZ\x00":
            machine, wrong = lzma.LZMADecompressor(), lzma.LZMAError
        else:
            break
        try:
            content = machine.decompress(data, LAYER_BYTES + 1 - len(whole))
        except wrong:
            break
        whole, packed = whole + content, True
        if len(whole) > LAYER_BYTES:
            return None, True
        data = machine.unused_data if machine.eof else b""
    return (whole, True) if packed else (None, False)


def _open(data: bytes) -> tuple[str | None, str, int, bool]:
    """(text, names of the compressions passed, layers left closed for their size, whether it is plain text).

    Bytes that are no UTF-8 are read one character each, so what is text among them is still found."""
    path, seen = "", set()
    while data not in seen:  # a stream may unpack to itself
        content, packed = _inflate(data)
        if not packed:
            break
        if content is None:
            return None, path, 1, False
        seen.add(data)
        data, path = content, path + "compressed/"
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1"), path, 0, False
    return text, path, 0, not CONTROL.search(text)


def _escaped(run: str) -> tuple[str | None, bytes | None]:
    """The text of a run of escapes, and its bytes where they are written as bytes."""
    if run[0] == "%" or run[:2] == "\\x":
        data = bytes.fromhex(run.replace("%", "").replace("\\x", ""))
        try:
            return data.decode("utf-8"), data
        except UnicodeDecodeError:
            return None, data
    if run[:2] == "&#":
        number = run[2:-1]
        codes = [int(number[1:], 16) if number[0] in "xX" else int(number)]
    elif run[:3] == "\\u{":
        codes = [int(run[3:-1], 16)]
    elif run[:2] == "\\U":
        codes = [int(run[2:], 16)]
    else:
        units = b"".join(int(h, 16).to_bytes(2, "big") for h in run.split("\\u")[1:])
        return units.decode("utf-16-be", "replace"), None
    return ("".join(map(chr, codes)) if all(c < 0x110000 and not 0xD800 <= c < 0xE000 for c in codes) else None), None


def _replace(layer: Layer, pattern: re.Pattern, name: str) -> tuple[list[Layer], int]:
    """The layer with its escapes of one sort resolved, and what compressed runs of them hold."""
    pieces, starts, ends, at, out, closed = [], [], [], 0, [], 0

    def keep(a: int, b: int) -> None:
        pieces.append(layer.text[a:b])
        starts.extend(range(a, b) if layer.starts is None else layer.starts[a:b])
        ends.extend(range(a + 1, b + 1) if layer.ends is None else layer.ends[a:b])

    for m in pattern.finditer(layer.text):
        text, data = _escaped(m[0])
        span = layer.span(*m.span())
        if text is None and data is not None:
            inner, path, left, _ = _open(data)
            closed += left
            if inner and path:
                out.append(_whole(inner, span, layer.path + name + "/" + path))
                continue
            text = inner
        if text is None:
            continue
        keep(at, m.start())
        width = (m.end() - m.start()) // len(text) if text and m[0].isascii() else 0
        even = layer.starts is None and width * len(text) == m.end() - m.start()
        for k, c in enumerate(text):
            pieces.append(c)
            starts.append(m.start() + k * width if even else span[0])
            ends.append(m.start() + (k + 1) * width if even else span[1])
        at = m.end()
    if at:
        keep(at, len(layer.text))
        out.append(Layer("".join(pieces), starts, ends, layer.path + name + "/"))
    return out, closed


def _whole(text: str, span: tuple[int, int], path: str) -> Layer:
    """A layer each of whose characters comes from the whole of ``span``."""
    return Layer(text, [span[0]] * len(text), [span[1]] * len(text), path)


def _from_base64(layer: Layer) -> tuple[list[Layer], int]:
    out, closed = [], 0
    for m in BASE64.finditer(layer.text):
        whole = (m.start(), m.end())
        parts = [whole]
        if "\n" in m[0]:
            parts += [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[^\r\n]+", m[0])]
        for a, b in parts:
            run = re.sub(r"[\r\n=]", "", layer.text[a:b]).replace("-", "+").replace("_", "/")
            if len(run) < 16:
                continue
            # Behind letters that do not belong to it, a text begins at one of four places in a group.
            for skip in range(4):
                part = run[skip:len(run) - ((len(run) - skip) % 4 == 1)]  # one letter alone holds no byte
                text, path, left, plain = _open(base64.b64decode(part + "=" * (-len(part) % 4)))
                closed += left
                if text:
                    out.append(_whole(text, layer.span(a, b), f"{layer.path}base64/{path}"))
                if plain or path:
                    break
            if plain and (a, b) == whole:
                break
    return out, closed


def _settled(layer: Layer) -> Layer:
    """The layer with percent escapes of ASCII resolved until none is left, in one pass: what a character
    completes is resolved before the next one is read."""
    chars, starts, ends = [], [], []
    for k, c in enumerate(layer.text):
        first, last = layer.span(k, k + 1)
        chars.append(c)
        starts.append(first)
        ends.append(last)
        while len(chars) > 2 and chars[-3] == "%" and chars[-2] in "01234567" and chars[-1] in HEX_DIGITS:
            chars[-3:] = [chr(int(chars[-2] + chars[-1], 16))]
            ends[-3:] = [ends[-1]]
            del starts[-2:]
    return Layer("".join(chars), starts, ends, layer.path + "url/")


def unwrap(layer: Layer) -> tuple[list[Layer], int]:
    """All layers one step below, and how many were left closed for their size."""
    out, closed = _from_base64(layer)
    if "%" in layer.text and layer.path.count("url/") >= URL_LAYERS:
        deepest = _settled(layer)
        if deepest.text != layer.text:
            return [*out, deepest], closed
    if "%" in layer.text:
        more, left = _replace(layer, PERCENT, "url")
        out, closed = out + more, closed + left
    if "\\" in layer.text or "&#" in layer.text:
        more, left = _replace(layer, ESCAPE, "unicode")
        out, closed = out + more, closed + left
    return out, closed


def scan_text(text: str | None) -> tuple[list[Find], int]:
    """All finds of a text by start, then kind as in KINDS; and the layers left closed for their size.

    A work list holds the layers still to open. A layer whose text was seen at the same place is not
    opened again, so layers that unwrap to themselves end. Percent signs nested deeper than URL_LAYERS are
    resolved at once: the innermost text is scanned, the layers between are not. A find at a place where
    one of its kind was found already is the same find.
    """
    finds: dict[tuple[str, int, int], Find] = {}
    work, seen, closed = [Layer(text or "", None, None, "")], set(), 0
    while work:
        layer = work.pop(0)
        place = layer.span(0, len(layer.text)) if layer.text else (0, 0)
        known = (hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), place)
        if known in seen:
            continue
        seen.add(known)
        for kind, a, b in scan_layer(layer.text):
            start, end = layer.span(a, b)
            finds.setdefault((kind, start, end), Find(start, end, kind, layer.path, layer.text[a:b]))
        below, left = unwrap(layer)
        work += below
        closed += left
    return sorted(finds.values(), key=lambda f: (f.start, KINDS.index(f.kind), f.end)), closed


SCANNED = ("id long, kinds array<string>, starts array<long>, ends array<long>, paths array<string>, "
           "secrets array<string>, closed long")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, finds (array of kind, start, end, path, secret), closed.

    Places are code points of the whole text, ends exclusive; ``path`` is empty for what stands in
    the text itself, else names the wrappings. ``closed`` counts compressed layers that were not
    opened because they grow beyond LAYER_BYTES. Null text is empty: no finds. Repeated rows come out
    repeated; other columns are not read.
    """

    def start():
        def call(ids, texts):
            scanned = [scan_text(t) for t in texts]
            pick = [[[f[k] for f in finds] for finds, _ in scanned] for k in range(5)]
            starts, ends, kinds, paths, values = pick
            return ids, kinds, starts, ends, paths, values, [c for _, c in scanned]

        return call

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = per_batch(rows, start, SCANNED)
    finds = F.arrays_zip(F.col("kinds").alias("kind"), F.col("starts").alias("start"), F.col("ends").alias("end"),
                         F.col("paths").alias("path"), F.col("secrets").alias("secret"))
    return found.select("id", finds.alias("finds"), "closed")
