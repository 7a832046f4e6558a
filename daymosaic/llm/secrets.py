"""Secret scans with a recursive decoding worklist.

Each text starts a worklist with itself. A layer is scanned, then unwrapped: percent runs, Unicode escapes and look-alikes,
base64 runs (also over several lines, bare or around gzip, zlib, bzip2, xz or zstandard data). Every unwrapped layer goes on the worklist unless the
same content over the same place was seen, so the loop ends at a fixpoint also for data that decode to themselves. Each layer
keeps, for every character, the place in the original text it came from, and spans are reported there.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymosaic.llm.base import batch, id_text, query, slices, table

KINDS = ("assign", "access", "hex", "oversize")
#: The base patterns of the contract (fixed values), with the least length of the match or group.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_MIN = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")   # greedy runs: the same as AKIA[A-Z0-9]+ of 16 or more
HEX = re.compile(r"[0-9a-f]{32,}")          # likewise

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}"
    r"|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|apos|amp|equals|colon);"
    r"|[\uFF01-\uFF5E]|[\u00AD\u200B-\u200D\u2060\uFEFF]")
#: The shortest finding, token=12345678, has 14 bytes and so 19 base64 characters without padding.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{19,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)*")
BREAK = re.compile(r"[\x20\t]*\r?\n[\x20\t]*")
#: A run that says nothing as a whole may be base64 between separators, as in a path.
PIECE = re.compile(r"[A-Za-z0-9]{19,}")
#: What a layer must hold to be text: so many characters without a control or a byte that is not UTF-8 between them; likewise
#: for UTF-16 in ASCII characters.
CLEAN = re.compile(r"[^\x00-\x08\x0e-\x1f\udc80-\udcff]{14}")
WIDE = re.compile(rb"\x00?(?:[\t\n\r\x20-\x7e]\x00){13,}[\t\n\r\x20-\x7e]?")
#: How base64 of the compressed formats begins.
MAGIC = ("H4sI", "eA", "eF", "eJ", "eN", "Qlpo", "/Td6", "_Td6", "KLUv")
#: Bytes that one unwrapped layer may have. A larger one is reported as a span of kind oversize, never dropped unseen.
MAX_LAYER = 64 << 20


def matches(text: str) -> list[tuple[str, int, int]]:
    """Leftmost, non-overlapping spans for each kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def percent(run: str) -> list[tuple[str, int, int]]:
    """(character, start, end) in the run. Bytes that are not UTF-8 stand for themselves."""
    raw, out, i = unquote_to_bytes(run), [], 0
    while i < len(raw):
        n = 1 if raw[i] < 0xC0 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
        try:
            c = raw[i:i + n].decode()
        except UnicodeDecodeError:
            c, n = chr(raw[i]), 1
        out.append((c, 3 * i, 3 * (i + n)))
        i += n
    return out


def escape(run: str) -> list[tuple[str, int, int]]:
    """As ``percent`` for one escape; invisible characters give nothing."""
    if run[0] == "&":
        c = {"&equals;": "=", "&colon;": ":"}.get(run) or html.unescape(run)
    elif run[0] == "\\":
        digits = re.findall(r"[0-9A-Fa-f]+", run[2:].replace("\\u", " "))
        code = int(digits[0], 16)
        if len(digits) == 2:
            code = 0x10000 + ((code - 0xD800) << 10) + int(digits[1], 16) - 0xDC00
        c = chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\uFFFD"
    else:
        c = chr(ord(run) - 0xFEE0) if "\uFF01" <= run <= "\uFF5E" else ""
    return [(x, 0, len(run)) for x in c]


def stream(raw: bytes):
    """A decompressor for data that begin as one of the formats do."""
    if raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] << 8 | raw[1]) % 31 == 0:
        return zlib.decompressobj(47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard
        return zstandard.ZstdDecompressor().decompressobj()
    return None


def inflate(raw: bytes) -> tuple[bytes, bytes] | None:
    """One compressed layer of one or more streams, as far as it is whole, and the bytes after it.

    None if it is none, MemoryError if it would exceed MAX_LAYER.
    """
    out, rest, n, any_ = [], raw, 0, False
    while (d := stream(rest)) is not None:
        got, at, step = [], 0, 1024
        try:
            while not d.eof and at < len(rest):  # small steps, so that what a step gives is bounded for all formats
                got.append(d.decompress(rest[at:at + step]))
                at += step
                n += len(got[-1])
                if n > MAX_LAYER:
                    raise MemoryError
        except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, RuntimeError):
            pass
        except Exception as exc:  # zstandard has its own error class
            if type(exc).__name__ != "ZstdError":
                raise
        out += got
        any_ |= d.eof or any(got)
        if not d.eof:
            rest = b""
            break
        rest = d.unused_data + rest[at:]
    return (b"".join(out), rest) if any_ else None


def readings(raw: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Texts that bytes stand for, with the first byte of each character and the one after it.

    Bytes that are not UTF-8 are lone surrogates, which no pattern takes, so what is around them is read.
    """
    text = raw.decode("utf-8", "surrogateescape")
    if CLEAN.search(text):
        last = np.cumsum([len(c.encode("utf-8", "surrogateescape")) for c in text])
        yield text, np.append(0, last[:-1]), last
    if b"\x00" in raw:
        ways = set()
        for m in WIDE.finditer(raw):
            first, last = m.group()[0], m.group()[-1]
            if first or not last:  # a run from NUL to letter is whole in big-endian order alone
                ways.add(("utf-16-le", (m.start() + (not first)) % 2))
            if last:
                ways.add(("utf-16-be", (m.start() + (first > 0)) % 2))
        for name, odd in sorted(ways):
            text = raw[odd:len(raw) - (len(raw) - odd) % 2].decode(name, "replace")
            last = odd + 2 * np.cumsum([1 + (c > "\uffff") for c in text])
            yield text, np.append(odd, last[:-1]), last


class Layer:
    """A text and, but for the first, the start and end in the original of each of its characters."""

    def __init__(self, text: str, starts=None, ends=None):
        self.text, self.starts, self.ends = text, starts, ends

    def place(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (int(self.starts[a]), int(self.ends[b - 1]))

    def replaced(self, rx: re.Pattern, decode) -> "Layer | None":
        """The layer with each match decoded; None without a match."""
        starts = np.arange(len(self.text)) if self.starts is None else self.starts
        ends = np.arange(1, len(self.text) + 1) if self.ends is None else self.ends
        text, s, e, at = [], [], [], 0
        for m in rx.finditer(self.text):
            chars = decode(m.group())
            a = m.start()
            text += [self.text[at:a], "".join(c for c, _, _ in chars)]
            s += [starts[at:a], np.array([starts[a + i] for _, i, _ in chars], dtype=np.int64)]
            e += [ends[at:a], np.array([ends[a + j - 1] for _, _, j in chars], dtype=np.int64)]
            at = m.end()
        if not text:
            return None
        return Layer("".join([*text, self.text[at:]]), np.concatenate([*s, starts[at:]]),
                     np.concatenate([*e, ends[at:]]))


def unwrap(layer: Layer) -> Iterator[Layer | tuple[int, int]]:
    """Layers one decoding deeper; a pair of places for one that is too large."""
    if "%" in layer.text and (x := layer.replaced(PERCENT, percent)):
        yield x
    if x := layer.replaced(ESCAPE, escape) if ESCAPE.search(layer.text) else None:
        yield x
    for m in BASE64.finditer(layer.text):
        lines, at = [], m.start()
        for x in BREAK.finditer(layer.text, *m.span()):
            lines.append((at, x.start()))
            at = x.end()
        found = list(decoded(layer, [*lines, (at, m.end())]))
        if not found:
            for p in PIECE.finditer(layer.text, *m.span()):
                if p.span() != m.span():
                    found += decoded(layer, [p.span()])
        yield from found


def decoded(layer: Layer, lines: list[tuple[int, int]]) -> Iterator[Layer | tuple[int, int]]:
    """What a base64 run over one or more lines holds, if it is text or compressed text.

    Up to three letters may be glued to its front, and lines of other words may stand before compressed data.
    """
    run = "".join(layer.text[a:b] for a, b in lines)
    at = np.concatenate([np.arange(a, b) for a, b in lines])
    starts = np.cumsum([0] + [b - a for a, b in lines[:-1]]).tolist()
    for first in sorted({0, 1, 2, 3, *(x for x in starts if run.startswith(MAGIC, x))}):
        n = len(run) - first
        n -= n % 4 == 1
        if n < 19:
            continue
        raw = base64.b64decode(run[first:first + n].replace("-", "+").replace("_", "/") + "=" * (-n % 4))
        a, b = layer.place(int(at[first]), int(at[first + n - 1]) + 1)
        try:
            if (got := inflate(raw)) is None:
                for text, low, high in readings(raw) if first < 4 else ():
                    s, e = at[first + low * 4 // 3], at[first + (high * 4 + 2) // 3 - 1] + 1
                    yield Layer(text, s if layer.starts is None else layer.starts[s],
                                e if layer.ends is None else layer.ends[e - 1])
                continue
            work, seen = [*got], set()
            while work:
                x = work.pop()
                if not x or (h := hashlib.md5(x).digest()) in seen:
                    continue
                seen.add(h)
                if (got := inflate(x)) is not None:
                    work += got
                    continue
                for text, _, _ in readings(x):
                    yield Layer(text, np.full(len(text), a), np.full(len(text), b))
        except MemoryError:
            yield (a, b)


def spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of one text by start, kind and end; places are code points of the text itself."""
    base = matches(text)
    found = {x: True for x in base}
    work, seen = deque([Layer(text)]), set()
    while work:
        layer = work.popleft()
        for x in unwrap(layer):
            if isinstance(x, tuple):
                found.setdefault(("oversize", *x), False)
                continue
            if not x.text:
                continue
            key = (hashlib.md5(x.text.encode("utf-8", "surrogatepass")).digest(), *x.place(0, len(x.text)))
            if key in seen:
                continue
            seen.add(key)
            for kind, a, b in matches(x.text):
                found.setdefault((kind, *x.place(a, b)), False)
            work.append(x)
    order = {k: i for i, k in enumerate(KINDS)}
    return [(k, a, b, own) for (k, a, b), own in sorted(found.items(), key=lambda x: (x[0][1], order[x[0][0]], x[0][2]))]


def redact(text: str, marks: list[tuple[str, int, int, bool]]) -> str:
    """Each run of overlapping spans becomes [kind of its first]."""
    out, at = [], 0
    i = 0
    while i < len(marks):
        kind, a, b, _ = marks[i]
        i += 1
        while i < len(marks) and marks[i][1] < b:
            b = max(b, marks[i][2])
            i += 1
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, spans (array of kind, start, end, base) and, if asked, text with the spans replaced.

    Every row is kept as it comes: null ids, repeated rows and null texts (as empty ones, no spans) included; other
    columns are not read.
    """
    fields = [("doc_id", pa.int64()), ("spans", pa.list_(SPAN))] + [("text", pa.string())] * with_text

    def run(batches):
        for b in slices(batches, 512):
            texts = b.column("text").to_pylist()
            marks = [spans(t) for t in texts]
            cols = [[[dict(zip(("kind", "start", "end", "base"), m)) for m in x] for x in marks]]
            cols += [[redact(t, x) for t, x in zip(texts, marks)]] * with_text
            yield batch(fields, b.column("doc_id"), *cols)

    kinds = "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint, base: boolean>>"
    return id_text(docs, id_col, text_col).mapInArrow(run, kinds + ", text string" * with_text)


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with the found spans replaced in the text, and its length where it changed.

    Null texts stay null.
    """
    def run(batches):
        for b in slices(batches, 512):
            at = b.schema.get_field_index(text_col)
            old = b.column(at).to_pylist()
            new = [t if not t or not (m := spans(t)) else redact(t, m) for t in old]
            b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            k = b.schema.get_field_index(length_col) if length_col else -1
            if k >= 0:
                n = [v if x is y else len(y) for v, x, y in zip(b.column(k).to_pylist(), old, new)]
                b = b.set_column(k, b.schema.field(k), pa.array(n, b.schema.field(k).type))
            yield b
    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from the spans."""
    line = lambda c: F.array_join(F.transform(
        c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    n = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *(n(k).alias(f"n_{k}") for k in KINDS[:3]),
                        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


@query("op8_secret_scans")
def op8(spark, d) -> DataFrame:
    return digest(scan(table(spark, d, "documents")))
