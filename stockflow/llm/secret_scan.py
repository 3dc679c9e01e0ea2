"""Secrets in texts and in what is encoded inside them.

Each text is scanned for three kinds of secrets. Encoded stretches are unwrapped on a worklist: URL escapes, Unicode
escapes, base64 runs, and gzip or zlib data in any decoded layer. Each decoded layer is scanned again and put back on
the worklist until nothing new comes out; a layer whose content was seen before in the document is not opened twice,
so self-containing data ends. Layers are bytes, held as a string with one character for each, so no byte that is no
text hides its neighbours. Every byte of a layer knows the stretch of the original text that it comes from, in two flat
arrays; all of an inflated layer, and all below it, comes from one stretch, which is held once however far the data
grows. A layer is held whole, so data that is compressed twice needs as much memory as it holds in the end.

A base64 run may go on over line breaks. If it is text from its first letter on, that is what it holds; if not, it is
read at all four alignments, so what stands before it ('/blob/', 'id-', a word) does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import zlib
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from stockflow.llm.common import slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32
# runs are maximal, so asking for the length in the pattern gives the same matches as dropping short ones
ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (ACCESS_CHARS - 4))
HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_CHARS)
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
# the letters of the shortest secret, 'token=' and its value, without padding
BASE64_CHARS = -(-(6 + ASSIGN_CHARS) * 8 // 6)
LETTER, BREAK = r"[A-Za-z0-9+/_-]", r"[\x20\t]*\r?\n[\x20\t]*"
# possessive, so that a run of any length keeps nothing to go back to
BASE64 = re.compile(r"(?<!%s)(?:%s(?:%s(?=%s))?+){%d,}+={0,2}" % (LETTER, LETTER, BREAK, LETTER, BASE64_CHARS))
LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
CONTROL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f]")
GZIP = b"\x1f\x8b"
# the two bytes that zlib data starts with, without a preset dictionary
ZLIB = re.compile(b"|".join(
    re.escape(bytes((a, b))) for a in range(8, 128, 16) for b in range(256) if (a << 8 | b) % 31 == 0 and not b & 32
))
# what the Arrow filters look for, a superset of what the patterns find
HINTS = {
    "assign": r"(?i)password|passwd|secret|token|api_?key", "access": r"AKIA[A-Z0-9]", "hex": r"[0-9a-f]{%d}" % HEX_CHARS,
    "coded": r"%%%%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|&#|(?:%s(?:%s)?){%d}" % (LETTER, BREAK, BASE64_CHARS),
}


def names_a_secret(text: str) -> bool:
    """Whether ASSIGN can match: one of its words is there."""
    low = text.lower()
    return any(word in low for word in ("password", "passwd", "secret", "token", "apikey", "api_key"))


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets in one layer; per kind leftmost and not overlapping."""
    named = ASSIGN.finditer(text) if names_a_secret(text) else ()
    found = [("assign", m.start(), m.end()) for m in named if len(m[2]) >= ASSIGN_CHARS]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


class Origin:
    """Where each byte of a layer comes from: first and end in the text, as arrays, or once for all bytes."""

    __slots__ = ("first", "end", "one")

    def __init__(self, first: np.ndarray, end: np.ndarray, one: bool = False):
        self.first, self.end, self.one = first, end, one

    @classmethod
    def same(cls, first: int, end: int) -> Origin:
        return cls(np.array([first]), np.array([end]), True)

    @classmethod
    def of(cls, text: str, start: int, end: int) -> tuple[str, Origin]:
        """The bytes of a piece of the original text, one character each, and their places."""
        data = text[start:end].encode("utf-8", "surrogatepass")
        place = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1 + start
        return data.decode("latin-1"), cls(place, place + 1)

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The stretch of the bytes a to b, the end exclusive."""
        return (int(self.first[0]), int(self.end[0])) if self.one else (int(self.first[a]), int(self.end[b - 1]))

    def cut(self, a: int, b: int) -> Origin:
        return self if self.one else Origin(self.first[a:b], self.end[a:b])

    def groups(self, lows: Callable[[], np.ndarray], highs: Callable[[], np.ndarray]) -> Origin:
        """For bytes made of several: those places, worked out only where they differ."""
        return self if self.one else Origin(self.first[lows()], self.end[highs()])

    @staticmethod
    def joined(parts: list[Origin]) -> Origin:
        if parts[0].one or len(parts) == 1:
            return parts[0]
        return Origin(np.concatenate([p.first for p in parts]), np.concatenate([p.end for p in parts]))


def replaced(text: str, origin: Origin, pattern: re.Pattern, decode) -> tuple[str, Origin] | None:
    """The text with the matches decoded, and the origins of its characters; None if nothing changes."""
    out, places, at = [], [], 0
    for m in pattern.finditer(text):
        got = decode(m)
        if got is None:
            continue
        out += [text[at : m.start()], "".join(c for c, _, _ in got)]
        if not origin.one:
            of = lambda k: np.fromiter((g[k] for g in got), np.int64, len(got)) + m.start()  # noqa: B023, E731
            places += [origin.cut(at, m.start()), origin.groups(lambda: of(1), lambda: of(2) - 1)]  # noqa: B023
        at = m.end()
    if not out:
        return None
    return "".join(out) + text[at:], Origin.joined([*places, origin.cut(at, len(text))])


def url(m: re.Match) -> list[tuple[str, int, int]]:
    """Bytes of a run of URL escapes with their places in it."""
    return [(chr(c), 3 * i, 3 * i + 3) for i, c in enumerate(bytes.fromhex(m[0].replace("%", "")))]


def escape(m: re.Match) -> list[tuple[str, int, int]] | None:
    digits, decimal = next((g for g in m.groups()[:5] if g), None), m[6]
    code = int(digits, 16) if digits else int(decimal)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    # an escape for one byte is that byte, so that escaped binary data stays what it is
    data = bytes([code]) if m[4] and code > 127 else chr(code).encode()
    return [(chr(c), 0, m.end() - m.start()) for c in data]


def inflate(data: bytes, whole: bool = False) -> tuple[bytes, int] | None:
    """gzip (all members) or zlib data at the start, as far as it can be read, and the bytes it takes; None if it is neither.

    With `whole`, only data that is read to its end and fits its checksum.
    """
    out, rest, used = [], memoryview(data), 0
    while rest[:2] == GZIP or ZLIB.match(rest):
        engine, ended, got, at = zlib.decompressobj(47), False, [], 0
        try:
            while at < len(rest) and not engine.eof:
                got.append(engine.decompress(rest[at : at + 4096]))
                at = min(len(rest), at + 4096)
            ended = engine.eof
        except zlib.error:
            pass
        if not ended and (whole or out):
            break
        out += got
        used += at - len(engine.unused_data) if ended else len(rest)
        if not ended or rest[:2] != GZIP:
            break
        rest = rest[at - len(engine.unused_data) :]
    text = b"".join(out)
    return (text, used) if text else None


def unbase64(run: str) -> bytes:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        body = body[:-1]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def clean(data: bytes) -> bool:
    """Whether it is text: UTF-8 without control characters."""
    if CONTROL.search(data):
        return False
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def holds(text: str) -> bool:
    """Whether a decoded layer may hold a secret or something encoded."""
    return names_a_secret(text) or any(p.search(text) for p in (ACCESS, HEX, URL, ESCAPE, BASE64))


def first_text(data: bytes, starts: list[int]) -> int:
    """The first of the starts, in order, from which on the data is UTF-8, 0 if there is none."""
    view, i = memoryview(data), 0
    while i < len(starts):
        try:
            str(view[starts[i] :], "utf-8")
            return starts[i]
        except UnicodeDecodeError as error:
            # what starts at or before the byte that is wrong meets it too, or lies inside a character
            i = max(i + 1, bisect_right(starts, starts[i] + error.start))
    return 0


def below(run: str, origin: Origin, starts: list[int]):
    """The layers under a base64 run. starts: where in the run what is encoded may start, besides its first letter.

    Bytes map to the four-letter groups that hold them, those of compressed data to all letters of it.
    """
    last = len(run) - 1

    def places(shift, start, end):
        group = lambda: shift + np.arange(start, end) // 3 * 4
        return origin.groups(lambda: np.minimum(last, group()), lambda: np.minimum(last, group() + 3))

    for shift in range(4):
        data = unbase64(run[shift:])
        offsets = [(s - shift) // 4 * 3 for s in [0, *starts] if s % 4 == shift]
        packed = {*offsets, *(m.start() for m in re.finditer(GZIP, data))}
        found = [(at, got) for at in sorted(packed) if (got := inflate(data[at:] if data[at : at + 2] == GZIP or ZLIB.match(data, at) else b""))]
        for at, (text, used) in found:
            first, end = places(shift, at, at + 1).span(0, 1), places(shift, at + used - 1, at + used).span(0, 1)
            yield text.decode("latin-1"), Origin.same(first[0], end[1])
        # from the first start on after which all is text, what stands before it is no part of it
        bad = max((m.start() for m in CONTROL.finditer(data)), default=-1)
        cut = first_text(data, [o for o in offsets if bad < o < len(data)])
        for start, end in ((0, cut), (cut, len(data))):
            part = data[start:end].decode("latin-1")
            if part and holds(part):
                yield part, places(shift, start, end)
        if shift == 0 and (clean(data) or found and found[0][0] == 0):
            return


def runs(m: re.Match):
    """The base64 runs of a match, as lists of (start, end) of their lines: all lines together, and each that is long enough."""
    lines = [x.span() for x in LINE.finditer(m.string, m.start(), m.end())]
    if len(lines) == 1:
        return [lines]
    alone = [[(a, b)] for a, b in lines if b - a >= BASE64_CHARS]
    whole = unbase64("".join(m.string[a:b] for a, b in lines))
    if len(lines) > 2 and clean(whole):
        return [lines]
    if len(lines) == 2 and alone and alone[0][0] == lines[0] and clean(unbase64(m.string[slice(*lines[0])])) and not clean(whole):
        # a line that is text by itself, and a word below it that is not
        return alone
    return [lines, *alone]


def decoded_layers(text: str, origin: Origin, original: bool = False):
    """What comes out of one layer: without URL escapes, without Unicode escapes, under its base64 runs, and inflated."""
    for pattern, decode in ((URL, url), (ESCAPE, escape)):
        if got := replaced(text, origin, pattern, decode):
            yield got
    for m in BASE64.finditer(text):
        for lines in runs(m):
            run = "".join(text[a:b] for a, b in lines)
            known = Origin.joined([origin.cut(a, b) for a, b in lines])
            ends = {sum(b - a for a, b in lines[:i]) for i in range(1, len(lines))}
            starts = sorted(ends | {i + 1 for i, c in enumerate(run) if c in "/-_" and i + 1 < len(run)})
            yield from below(run, known, starts)
    if not original:
        data = text.encode("latin-1")
        for m in re.finditer(b"%s|%s" % (re.escape(GZIP), ZLIB.pattern), data):
            at = m.start()
            if got := inflate(data[at:], whole=at > 0 and m[0] != GZIP):
                yield got[0].decode("latin-1"), Origin.same(*origin.span(at, at + got[1]))


def stretches(text: str) -> list[tuple[int, int]]:
    """The lines of a text that hold something encoded, together where it goes on from one to the next."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(m.span() for p in (URL, ESCAPE, BASE64) for m in p.finditer(text)):
        if out and end <= out[-1][1]:
            continue
        start, end = text.rfind("\n", 0, start) + 1, text.find("\n", end)
        end = len(text) if end < 0 else end
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def hidden(text: str) -> set[tuple[str, int, int]]:
    """Secrets of the decoded layers, as spans of the text. Layers start from lines that hold something encoded."""
    found, seen = set(), set()
    work = []
    for start, end in stretches(text):
        work.append((*Origin.of(text, start, end), True))
    while work:
        layer, origin, original = work.pop()
        if not original:
            key = (hashlib.sha256(layer.encode("latin-1")).digest(), origin.span(0, 1), origin.span(len(layer) - 1, len(layer)))
            if key in seen:
                continue
            seen.add(key)
            found.update((kind, *origin.span(a, b)) for kind, a, b in scan(layer))
        work += [(inner, places, False) for inner, places in decoded_layers(layer, origin, original) if inner]
    return found


def listed(spans) -> str:
    """kind:start:end by start, then by kind as in KINDS, then by end."""
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


def find(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, and the secrets of the whole text as arrays of (kind, start, end).

    `base` holds the matches in the text itself, `spans` these and those of decoded layers, each once. Places count
    code points, the end is exclusive. A null text counts as empty. Every row comes back, repeated ones too; other
    columns are left out.
    """
    kind = docs.schema[id].dataType.simpleString()
    spans = "array<struct<kind: string, start: bigint, end: bigint>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in slices(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "")
            hints = {n: pc.match_substring_regex(texts, p.replace("%%", "%")).to_pylist() for n, p in HINTS.items()}
            base, every = [], []
            for i in range(len(texts)):
                own: list = []
                more: set = set()
                if hints["assign"][i] or hints["access"][i] or hints["hex"][i] or hints["coded"][i]:
                    whole = texts[i].as_py()
                    own = scan(whole)
                    more = hidden(whole) if hints["coded"][i] else set()
                order = lambda s: (s[1], KINDS.index(s[0]), s[2])
                base.append([dict(zip(("kind", "start", "end"), s)) for s in sorted(own, key=order)])
                every.append([dict(zip(("kind", "start", "end"), s)) for s in sorted({*own, *more}, key=order)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(base, arrow), pa.array(every, arrow)], names=[id, "base", "spans"])

    return docs.selectExpr(f"`{id}` as id", f"`{text}` as text").mapInArrow(run, f"`{id}` {kind}, base {spans}, spans {spans}")
