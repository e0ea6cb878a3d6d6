"""Containers as ordered parts: every byte of a file belongs to one part, or the file is malformed.

`parts(kind, data)` walks a file of a known kind. A part has a kind, its place, its size and a label; nested parts have
the path of their parents as a prefix. `recognise` finds the kind from the first bytes and, where these are shared, from
the whole. Walkers fail closed: what they can't account for raises Malformed with the reason.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple


class Malformed(ValueError):
    """A file whose structure can't be accounted for."""


class Part(NamedTuple):
    """size bytes at a place, of which the first `head` and the last `tail` frame the payload; `more` is up to the walker."""

    kind: str
    at: int
    size: int
    head: int = 0
    tail: int = 0
    more: tuple = ()

    @property
    def end(self) -> int:
        return self.at + self.size

    def payload(self, data: bytes) -> bytes:
        return data[self.at + self.head : self.end - self.tail]


def _need(ok: bool, reason: str) -> None:
    if not ok:
        raise Malformed(reason)


def _rest(data: bytes, at: int) -> Iterator[Part]:
    if at < len(data):
        yield Part("trailer", at, len(data) - at)


def toyf(data: bytes) -> Iterator[Part]:
    """Magic, content with its length, records of type, length and value."""
    _need(data[:4] == b"TOYF" and len(data) >= 8, "no toy header")
    size = int.from_bytes(data[4:8], "big")
    _need(8 + size <= len(data), "content runs past the end")
    yield Part("content", 0, 8 + size, 8)
    at = 8 + size
    while at < len(data):
        _need(at + 3 <= len(data), "a record's head runs past the end")
        n = int.from_bytes(data[at + 1 : at + 3], "big")
        _need(at + 3 + n <= len(data), "a record runs past the end")
        yield Part(f"record {data[at]}", at, 3 + n, 3)
        at += 3 + n


def pack_toyf(content: bytes, records: list[tuple[int, bytes]]) -> bytes:
    """A toy file."""
    for kind, value in records:
        _need(0 <= kind <= 255, "a type doesn't fit a byte")
        _need(len(value) <= 65535, "a value is too long")
    return b"TOYF" + struct.pack(">I", len(content)) + content + b"".join(struct.pack(">BH", k, len(v)) + v for k, v in records)


PNG_HEAD = b"\x89PNG\r\n\x1a\n"


def png_chunk(kind: bytes, payload: bytes) -> bytes:
    """A chunk with its checksum."""
    return struct.pack(">I", len(payload)) + kind + payload + struct.pack(">I", zlib.crc32(kind + payload))


def png(data: bytes) -> Iterator[Part]:
    """The signature, chunks with valid checksums up to IEND, and what follows."""
    _need(data[:8] == PNG_HEAD, "no PNG signature")
    yield Part("signature", 0, 8)
    at, first = 8, True
    while True:
        _need(at + 12 <= len(data), "no IEND chunk")
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        _need(kind.isalpha() and kind.isascii(), "a chunk type isn't alphabetic")
        _need(at + 12 + size <= len(data), "a chunk runs past the end")
        _need(not first or kind == b"IHDR", "the first chunk isn't IHDR")
        _need(zlib.crc32(data[at + 4 : at + 8 + size]) == int.from_bytes(data[at + 8 + size : at + 12 + size], "big"), "a checksum is wrong")
        yield Part(kind.decode("ascii"), at, 12 + size, 8, 4)
        at, first = at + 12 + size, False
        if kind == b"IEND":
            break
    yield from _rest(data, at)


_ENTROPY_END = re.compile(rb"\xff(?![\x00\xd0-\xd7\xff])", re.S)
_JPEG_NAMES = {0xD8: "SOI", 0xD9: "EOI", 0xDA: "SOS", 0xDB: "DQT", 0xC4: "DHT", 0xDD: "DRI", 0xCC: "DAC", 0xFE: "COM"}


def _jpeg_name(marker: int, payload: bytes) -> str:
    if marker in _JPEG_NAMES:
        return _JPEG_NAMES[marker]
    if 0xC0 <= marker <= 0xCF and marker != 0xC8:
        return f"SOF{marker - 0xC0}"
    if 0xE0 <= marker <= 0xEF:
        for sign, name in ((b"JFIF\0", "JFIF"), (b"JFXX\0", "JFXX"), (b"Exif\0", "Exif"), (b"http://ns.adobe.com/xap/", "XMP"), (b"http://ns.adobe.com/xmp/extension/", "XMP+"), (b"ICC_PROFILE\0", "ICC"), (b"MPF\0", "MPF"), (b"Photoshop 3.0\0", "Photoshop"), (b"Adobe", "Adobe")):
            if payload.startswith(sign):
                return f"APP{marker - 0xE0} {name}"
        return f"APP{marker - 0xE0}"
    return f"marker {marker:02X}"


def jpeg(data: bytes) -> Iterator[Part]:
    """Segments from SOI to EOI, a scan with its entropy-coded data as one part, and what follows."""
    _need(data[:2] == b"\xff\xd8", "no SOI")
    yield Part("SOI", 0, 2)
    at = 2
    while True:
        _need(at + 2 <= len(data) and data[at] == 0xFF, "no EOI" if at >= len(data) else "no marker where one is due")
        start = at
        while at + 1 < len(data) and data[at + 1] == 0xFF:
            at += 1
        _need(at + 1 < len(data), "no EOI")
        marker = data[at + 1]
        _need(marker != 0, "a stuffed byte where a marker is due")
        if marker == 0xD9:
            yield Part("EOI", start, at + 2 - start)
            yield from _rest(data, at + 2)
            return
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            yield Part(f"marker {marker:02X}", start, at + 2 - start)
            at += 2
            continue
        _need(at + 4 <= len(data), "a segment runs past the end")
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        _need(size >= 2, "a segment's length is less than 2")
        end = at + 2 + size
        _need(end <= len(data), "a segment runs past the end")
        if marker == 0xDA:
            found = _ENTROPY_END.search(data, end)
            _need(found is not None and found.start() + 1 < len(data), "a scan never ends")
            yield Part("SOS", start, found.start() - start, at + 4 - start)
            at = found.start()
        else:
            yield Part(_jpeg_name(marker, data[at + 4 : at + 40]), start, end - start, at + 4 - start)
            at = end


def _colour_table(flags: int) -> int:
    return 3 << ((flags & 7) + 1) if flags & 0x80 else 0


def _sub_blocks(data: bytes, at: int) -> int:
    while True:
        _need(at < len(data), "a block runs past the end")
        n = data[at]
        at += 1 + n
        if n == 0:
            return at


_GIF_EXTENSIONS = {0xF9: "graphic control", 0xFE: "comment", 0x01: "plain text"}


def gif(data: bytes) -> Iterator[Part]:
    """Header with colour table, images, extensions, the end sign, and what follows."""
    _need(data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 13, "no GIF header")
    at = 13 + _colour_table(data[10])
    _need(at <= len(data), "the colour table runs past the end")
    yield Part("header", 0, at)
    while True:
        _need(at < len(data), "no end sign")
        start, sign = at, data[at]
        if sign == 0x3B:
            yield Part("end", at, 1)
            yield from _rest(data, at + 1)
            return
        if sign == 0x2C:
            _need(at + 10 <= len(data), "an image runs past the end")
            at = _sub_blocks(data, at + 11 + _colour_table(data[at + 9]))
            yield Part("image", start, at - start)
        elif sign == 0x21:
            _need(at + 3 <= len(data), "an extension runs past the end")
            label = data[at + 1]
            name = _GIF_EXTENSIONS.get(label, f"extension {label:02X}")
            if label == 0xFF:
                name = "application " + data[at + 3 : at + 3 + data[at + 2]].decode("latin-1")
            at = _sub_blocks(data, at + 2)
            yield Part(name, start, at - start)
        else:
            raise Malformed("an unknown block")


def webp(data: bytes) -> Iterator[Part]:
    """The RIFF header, chunks with even padding, and what follows the size it states."""
    _need(data[:4] == b"RIFF" and data[8:12] == b"WEBP", "no WebP header")
    end = 8 + int.from_bytes(data[4:8], "little")
    _need(end <= len(data), "the stated size is past the end")
    yield Part("header", 0, 12)
    at, first = 12, True
    while at < end:
        _need(at + 8 <= end, "a chunk's head runs past the container")
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        _need(at + 8 + size <= end, "a chunk runs past the container")
        _need(not first or kind in (b"VP8X", b"VP8 ", b"VP8L"), "the first chunk is none of a picture")
        _need(kind != b"VP8X" or size >= 10, "a VP8X chunk is too short")
        whole = min(8 + size + size % 2, end - at)
        yield Part(kind.decode("latin-1"), at, whole, 8, whole - 8 - size)
        at, first = at + whole, False
    _need(not first, "no picture")
    yield from _rest(data, end)


def _id3_size(data: bytes, at: int = 0) -> int:
    if data[at : at + 3] != b"ID3" or len(data) < at + 10:
        return 0
    size = 0
    for b in data[at + 6 : at + 10]:
        _need(b < 128, "a tag's size isn't of seven-bit bytes")
        size = size << 7 | b
    size += 10 + (10 if data[at + 5] & 0x10 else 0)
    _need(at + size <= len(data), "a tag runs past the end")
    return size


_FLAC_BLOCKS = {0: "STREAMINFO", 1: "PADDING", 2: "APPLICATION", 3: "SEEKTABLE", 4: "VORBIS_COMMENT", 5: "CUESHEET", 6: "PICTURE"}


def flac(data: bytes) -> Iterator[Part]:
    """An ID3v2 tag if there is one, the magic, metadata blocks, audio to the end."""
    at = _id3_size(data)
    if at:
        yield Part("ID3v2", 0, at, 10)
    _need(data[at : at + 4] == b"fLaC", "no FLAC magic")
    yield Part("magic", at, 4)
    at, n, last = at + 4, 0, False
    while not last:
        _need(at + 4 <= len(data) and n < 4096, "metadata blocks never end")
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        _need(kind in _FLAC_BLOCKS, "an unknown metadata block")
        _need(n > 0 or kind == 0, "the first block isn't STREAMINFO")
        _need(at + 4 + size <= len(data), "a metadata block runs past the end")
        yield Part(_FLAC_BLOCKS[kind], at, 4 + size, 4)
        at, n = at + 4 + size, n + 1
    _need(at < len(data), "no audio")
    yield Part("audio", at, len(data) - at)


@lru_cache(1 << 16)
def _frame_length(first: int, second: int) -> int:
    version, layer, rate, sampling, pad = first >> 3 & 3, first >> 1 & 3, second >> 4, second >> 2 & 3, second >> 1 & 1
    if first & 0xE0 != 0xE0 or version == 1 or layer != 1 or rate in (0, 15) or sampling == 3:
        return 0
    # kbit/s of layer III for MPEG 1, and for MPEG 2 and 2.5.
    kbps = ((32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320) if version == 3 else (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160))[rate - 1]
    hertz = (44100, 48000, 32000)[sampling] // {3: 1, 2: 2, 0: 4}[version]
    return (144 if version == 3 else 72) * kbps * 1000 // hertz + pad


def _mpeg_frame(data: bytes, at: int) -> int:
    """The length of the layer III frame at a place, or 0."""
    return _frame_length(data[at + 1], data[at + 2]) if at + 4 <= len(data) and data[at] == 0xFF else 0


class _Lengths(dict):
    """The lengths of frames by the second and third byte of their heads, found as they are met."""

    def __missing__(self, head: int) -> int:
        self[head] = _frame_length(head >> 8, head & 255)
        return self[head]


_LENGTHS = _Lengths()


def mp3(data: bytes) -> Iterator[Part]:
    """A tag, up to 8192 bytes before the first frame, frames one after the other as one part (with their number and the
    different heads they have), and what follows them. `inner.sound_frames` lists the frames."""
    at = _id3_size(data)
    if at:
        yield Part("ID3v2", 0, at, 10)
    first = next((p for p in range(at, min(at + 8192, len(data)) + 1) if (n := _mpeg_frame(data, p)) and (p + n == len(data) or _mpeg_frame(data, p + n) or data[p + n : p + n + 3] in (b"TAG", b"APE"))), None)
    _need(first is not None, "no frames")
    if first > at:
        yield Part("before audio", at, first - at)
    at, end = first, len(data)
    lengths, heads, count = _LENGTHS, set(), 0
    while at + 4 <= end and data[at] == 0xFF and (n := lengths[data[at + 1] << 8 | data[at + 2]]) and at + n <= end:
        heads.add(data[at + 1 : at + 4])
        count += 1
        at += n
    yield Part("audio", first, at - first, 0, 0, (count, tuple(sorted(heads))))
    while at < len(data):
        if data[at : at + 3] == b"TAG" and at + 128 == len(data):
            yield Part("ID3v1", at, 128)
            return
        end = len(data) - 128 if data[-128:-125] == b"TAG" and at < len(data) - 128 else len(data)
        yield Part("APE" if data[at : at + 8] == b"APETAGEX" else "trailer", at, end - at)
        at = end


def bmp(data: bytes) -> Iterator[Part]:
    """The file header, the picture header, the palette, any gap, the pixels, and what follows."""
    _need(data[:2] == b"BM" and len(data) >= 26, "no bitmap header")
    size, pixels = int.from_bytes(data[14:18], "little"), int.from_bytes(data[10:14], "little")
    _need(size in (12, 40, 52, 56, 108, 124), "an unknown header size")
    _need(14 + size <= pixels <= len(data), "the pixels start at a wrong place")
    if size == 12:
        width, height, planes, bits = struct.unpack_from("<HHHH", data, 18)
        packed = 0
    else:
        width, height, planes, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    _need(planes == 1, "the number of planes isn't 1")
    _need(width > 0 and height != 0, "an empty picture")
    if packed in (1, 2):
        length = int.from_bytes(data[34:38], "little")
    else:
        length = (width * bits + 31) // 32 * 4 * abs(height)
    _need(pixels + length <= len(data), "the pixels run past the end")
    yield Part("file header", 0, 14)
    yield Part("picture header", 14, size)
    if pixels > 14 + size:
        yield Part("palette", 14 + size, pixels - 14 - size)
    yield Part("pixels", pixels, length)
    yield from _rest(data, pixels + length)


def zip_(data: bytes) -> Iterator[Part]:
    """Members with the bytes of their local headers, then the directory and the end record, which must close the file."""
    at = data.rfind(b"PK\5\6", max(0, len(data) - 65557))
    _need(at >= 0 and at + 22 <= len(data), "no end record")
    _need(at + 22 + int.from_bytes(data[at + 20 : at + 22], "little") == len(data), "bytes after the end record")
    disk, disk0, n_here, n, size, start = struct.unpack_from("<HHHHII", data, at + 4)
    _need(disk == disk0 == 0 and n_here == n, "an archive of several disks")
    _need(n != 0xFFFF and size != 0xFFFFFFFF and start != 0xFFFFFFFF, "a ZIP64 archive")
    _need(start + size == at, "the directory isn't where it is stated")
    members, seen, pos = [], set(), start
    for _ in range(n):
        _need(data[pos : pos + 4] == b"PK\1\2" and pos + 46 <= at, "the directory is broken")
        flags, method = struct.unpack_from("<HH", data, pos + 8)
        crc, packed, full, name_n, extra_n, note_n = struct.unpack_from("<IIIHHH", data, pos + 16)
        local = int.from_bytes(data[pos + 42 : pos + 46], "little")
        raw = data[pos + 46 : pos + 46 + name_n]
        name = raw.decode("utf-8" if flags & 0x800 else "cp437", "strict")
        _need(not flags & 1, "an encrypted member")
        _need(method in (0, 8), "an unknown compression method")
        _need(name not in seen, "two members of one name")
        _need(not name.startswith("/") and ".." not in name.split("/") and "\\" not in name, "an unsafe name")
        seen.add(name)
        _need(data[local : local + 4] == b"PK\3\4", "a member isn't where it is stated")
        name_l, extra_l = struct.unpack_from("<HH", data, local + 26)
        _need(data[local + 30 : local + 30 + name_l] == raw, "a member has two names")
        head = 30 + name_l + extra_l
        _need(local + head + packed <= start, "a member runs past the directory")
        members.append(Part(f"member {name}", local, head + packed, head, 0, (name, method, crc, full)))
        pos += 46 + name_n + extra_n + note_n
    _need(pos == at, "the directory is broken")
    members.sort(key=lambda m: m.at)
    reached = 0
    for m in members:
        _need(m.at >= reached, "members overlap")
        if m.at > reached:
            _need(reached > 0, "bytes before the first member")
            yield Part("between members", reached, m.at - reached)
        yield m
        reached = m.end
    if start > reached:
        yield Part("between members", reached, start - reached)
    yield Part("directory", start, size)
    yield Part("end record", at, len(data) - at)


def member_bytes(data: bytes, part: Part) -> bytes:
    """The content of a ZIP member, checked against its stated size and checksum."""
    _, method, crc, full = part.more
    packed = part.payload(data)
    if method == 0:
        out = packed
    else:
        engine = zlib.decompressobj(-15)
        try:
            out = engine.decompress(packed, full + 1)
        except zlib.error as e:
            raise Malformed("a member doesn't inflate") from e
    _need(len(out) == full and zlib.crc32(out) == crc, "a member isn't as stated")
    return out


ISO_NESTS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex", b"iprp", b"ipco"])


def iso(data: bytes, at: int = 0, end: int | None = None, path: str = "", depth: int = 0) -> Iterator[Part]:
    """Boxes of 32-bit, 64-bit or to-the-end sizes; a nesting box is followed by its children, which lie within it."""
    end = len(data) if end is None else end
    _need(depth <= 32, "boxes nest too deep")
    _need(at < end or depth > 0, "no boxes")
    while at < end:
        _need(at + 8 <= end, "a box's head runs past its parent")
        size, kind, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            _need(at + 16 <= end, "a box's head runs past its parent")
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            _need(depth == 0, "a nested box without size")
            size = end - at
        head += 16 if kind == b"uuid" else 0
        _need(head <= size <= end - at, "a box runs past its parent")
        name = path + kind.decode("latin-1")
        yield Part(name, at, size, head)
        if kind in ISO_NESTS:
            yield from iso(data, at + head, at + size, name + "/", depth + 1)
        elif kind == b"meta" and size >= head + 12 and data[at + head + 8 : at + head + 12] == b"hdlr":
            yield from iso(data, at + head + 4, at + size, name + "/", depth + 1)
        at += size


# Bytes of one value of each field type.
TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
TIFF_LINKS = {0x8769: "Exif", 0x8825: "GPS", 0xA005: "Interop", 0x014A: "Sub"}


def tiff(data: bytes) -> Iterator[Part]:
    """The header, and per directory its entries; an entry's payload is its value, wherever it is stored."""
    _need(data[:4] in (b"II*\0", b"MM\0*"), "no TIFF header")
    order = "<" if data[:1] == b"I" else ">"
    yield Part("header", 0, 8)
    todo, seen = [(struct.unpack_from(order + "I", data, 4)[0], "IFD0")], set()
    while todo:
        at, name = todo.pop(0)
        if at == 0 or at in seen:
            _need(at == 0, "directories form a loop")
            continue
        seen.add(at)
        _need(len(seen) <= 64 and at + 2 <= len(data), "a directory lies past the end")
        n = struct.unpack_from(order + "H", data, at)[0]
        _need(n <= 4096 and at + 6 + 12 * n <= len(data), "a directory runs past the end")
        for k in range(n):
            place = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", data, place)
            width = TIFF_SIZES.get(kind, 1) * count
            where = place + 8 if width <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
            _need(where + width <= len(data), "a value lies past the end")
            yield Part(f"{name} {tag:04X}", place, 12, 0, 0, (tag, where, width))
            if tag in TIFF_LINKS and kind in (4, 13):
                todo.extend((struct.unpack_from(order + "I", data, where + 4 * i)[0], TIFF_LINKS[tag]) for i in range(min(count, 16)))
        follows = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
        if follows:
            todo.append((follows, f"IFD{len(seen)}"))


_OPEN_TAG = re.compile(rb"""<(?:[^"'>]|"[^"]*"|'[^']*')*>""")


def xml(data: bytes) -> Iterator[Part]:
    """Elements with their spans, in the order of their start; comments and instructions as parts of their own."""
    from xml.parsers import expat

    _need(data[:2] not in (b"\xff\xfe", b"\xfe\xff"), "UTF-16 text")
    parser = expat.ParserCreate(namespace_separator=" ")
    found: list[list] = []
    stack: list[int] = []

    def start(name: str, _: dict) -> None:
        stack.append(len(found))
        found.append([name, parser.CurrentByteIndex, None])

    def stop(_: str) -> None:
        at = parser.CurrentByteIndex
        row = found[stack.pop()]
        if data[at : at + 2] == b"</":
            row[2] = data.find(b">", at) + 1
        else:  # a self-closing tag: the event stands at its start or right after it
            row[2] = at if at > row[1] else _OPEN_TAG.match(data, at).end()

    def note(kind: str, end: bytes):  # noqa: ANN202
        def seen(*_: str) -> None:
            at = parser.CurrentByteIndex
            found.append([kind, at, data.find(end, at) + len(end)])

        return seen

    def refuse(*_: object) -> None:
        raise Malformed("an entity is declared")

    parser.StartElementHandler, parser.EndElementHandler = start, stop
    parser.CommentHandler, parser.ProcessingInstructionHandler = note("comment", b"-->"), note("instruction", b"?>")
    parser.EntityDeclHandler = parser.ExternalEntityRefHandler = refuse
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        raise Malformed("not well-formed") from e
    for name, at, end in found:
        yield Part(name, at, end - at)


_PDF_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\b")


def pdf(data: bytes) -> Iterator[Part]:
    """The header, object definitions up to their ends, and the end marks of revisions."""
    _need(data[:5] == b"%PDF-", "no PDF header")
    _need(b"%%EOF" in data, "no end mark")
    yield Part("header", 0, 8)
    at = 0
    while m := _PDF_OBJECT.search(data, at):
        end = data.find(b"endobj", m.end())
        _need(end >= 0, "an object never ends")
        yield Part(f"object {int(m[1])} {int(m[2])}", m.start(), end + 6 - m.start(), m.end() - m.start(), 6)
        at = end + 6
    for m in re.finditer(rb"%%EOF", data):
        yield Part("end mark", m.start(), 5)


def elf(data: bytes) -> Iterator[Part]:
    """The header and the sections of an ELF file, with their names."""
    _need(data[:4] == b"\x7fELF" and len(data) >= 52, "no ELF header")
    wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
    if wide:
        start, width, n, names = struct.unpack_from(order + "Q", data, 40)[0], *struct.unpack_from(order + "HHH", data, 58)
    else:
        start, width, n, names = struct.unpack_from(order + "I", data, 32)[0], *struct.unpack_from(order + "HHH", data, 46)
    _need(start > 0 and n > 0, "no section headers")
    _need(start + n * width <= len(data) and names < n, "section headers lie past the end")
    yield Part("header", 0, 64 if wide else 52)
    rows = [struct.unpack_from(order + ("IIQQQQ" if wide else "IIIIII"), data, start + k * width) for k in range(n)]
    table = rows[names]
    for name, kind, _, _, at, size in rows:
        if kind in (0, 8):
            continue
        _need(at + size <= len(data), "a section lies past the end")
        text = data[table[4] + name : data.find(b"\0", table[4] + name)].decode("latin-1")
        yield Part(f"section {text}", at, size)


def emf(data: bytes) -> Iterator[Part]:
    """The records of an enhanced metafile up to its end record."""
    _need(data[:4] == b"\1\0\0\0" and data[40:44] == b" EMF", "no metafile header")
    at = 0
    while True:
        _need(at + 8 <= len(data), "no end record")
        kind, size = struct.unpack_from("<II", data, at)
        _need(size >= 8 and size % 4 == 0 and at + size <= len(data), "a record has a wrong size")
        yield Part(f"record {kind}", at, size, 8)
        at += size
        if kind == 14:
            break
    yield from _rest(data, at)


def icc(data: bytes) -> Iterator[Part]:
    """The header and the tags of a colour profile."""
    _need(len(data) >= 132 and data[36:40] == b"acsp", "no profile header")
    yield Part("header", 0, 128)
    n = int.from_bytes(data[128:132], "big")
    _need(n <= 1024 and 132 + 12 * n <= len(data), "the tag table runs past the end")
    for k in range(n):
        sign, at, size = struct.unpack_from(">4sII", data, 132 + 12 * k)
        _need(at + size <= len(data), "a tag lies past the end")
        yield Part(f"tag {sign.decode('latin-1')}", at, size)


WALKERS: dict[str, Callable[[bytes], Iterator[Part]]] = {"toyf": toyf, "jpeg": jpeg, "png": png, "flac": flac, "m4a": iso, "mp3": mp3, "pdf": pdf, "heic": iso, "mp4": iso, "raw": tiff, "tiff": tiff, "webp": webp, "gif": gif, "bmp": bmp, "svg": xml, "metafile": emf, "exe": elf, "docx": zip_, "xlsx": zip_, "pptx": zip_, "epub": zip_, "zip": zip_, "xml": xml, "icc": icc}

# Brands of still pictures and of sound.
_STILL_BRANDS = (b"heic", b"heix", b"mif1", b"msf1", b"heim", b"heis")
_SOUND_BRANDS = (b"M4A ", b"M4B ")


def recognise(data: bytes) -> str | None:
    """The kind of a file, by the first handler that claims it, in the order of the registry; None if none does."""
    head = data[:16]
    if head[:4] == b"TOYF":
        return "toyf"
    if head[:3] == b"\xff\xd8\xff":
        return "jpeg"
    if head[:8] == PNG_HEAD:
        return "png"
    tag = 0
    if head[:3] == b"ID3":
        try:
            tag = _id3_size(data)
        except Malformed:
            return None
    if data[tag : tag + 4] == b"fLaC":
        return "flac"
    if head[4:8] == b"ftyp":
        brand = head[8:12]
        return "m4a" if brand in _SOUND_BRANDS else "heic" if brand in _STILL_BRANDS else "raw" if brand == b"crx " else "mp4"
    if tag or _mpeg_frame(data, 0):
        return "mp3"
    if head[:5] == b"%PDF-":
        return "pdf"
    if head[:15] == b"FUJIFILMCCD-RAW":
        return "raw"
    if head[:4] in (b"II*\0", b"MM\0*"):
        return "raw" if head[8:10] == b"CR" or any(p.kind.endswith("C612") for p in _quiet(tiff, data)) else "tiff"
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "webp"
    if head[:6] in (b"GIF87a", b"GIF89a"):
        return "gif"
    if head[:2] == b"BM" and data[14:18] in {struct.pack("<I", n) for n in (12, 40, 52, 56, 108, 124)}:
        return "bmp"
    if re.match(rb"\s*(?:<\?xml.*?\?>\s*)?(?:<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<(?:\w+:)?svg[\s>]", data, re.S):
        return "svg"
    if head[:4] == b"\1\0\0\0" and data[40:44] == b" EMF" or head[:4] == b"\xd7\xcd\xc6\x9a":
        return "metafile"
    if head[:4] == b"\x7fELF" or head[:2] == b"MZ" or head[:4] in (b"\xcf\xfa\xed\xfe", b"\xca\xfe\xba\xbe"):
        return "exe"
    if head[:4] in (b"PK\3\4", b"PK\5\6"):
        names = {p.kind[7:] for p in _quiet(zip_, data) if p.kind.startswith("member ")}
        for kind, name in (("docx", "word/document.xml"), ("xlsx", "xl/workbook.xml"), ("pptx", "ppt/presentation.xml"), ("epub", "META-INF/container.xml")):
            if name in names:
                return kind
        return "zip"
    return None


def _quiet(walk: Callable[[bytes], Iterator[Part]], data: bytes) -> list[Part]:
    try:
        return list(walk(data))
    except (Malformed, struct.error, UnicodeDecodeError):
        return []


_RECENT: list[tuple[str, bytes, list[Part]]] = []


def parts(kind: str, data: bytes) -> list[Part]:
    """The parts of a file of a kind; Malformed if the kind is unknown or the file isn't accounted for.

    The last walk is remembered, since a clean asks for the parts of one and the same file several times in a row."""
    if _RECENT and _RECENT[0][0] == kind and _RECENT[0][1] is data:
        return _RECENT[0][2]
    walk = WALKERS.get(kind)
    _need(walk is not None, f"no walker for {kind}")
    try:
        found = list(walk(data))
    except (struct.error, UnicodeDecodeError, IndexError) as e:
        raise Malformed("the file ends too soon") from e
    if isinstance(data, bytes):  # what may be changed in place isn't remembered
        _RECENT[:] = [(kind, data, found)]
    return found
