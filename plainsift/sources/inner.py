"""Structures inside the parts of containers: comments, tags, datasets, attributes, relationships, samples, items, tokens.

Each function takes the bytes of a part and gives rows; what doesn't add up raises Malformed. `rows` makes a table of them.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from plainsift.sources.containers import Malformed, Part, member_bytes, parts

Row = tuple[str, str]


def _need(ok: bool, reason: str) -> None:
    if not ok:
        raise Malformed(reason)


def vorbis_comments(data: bytes) -> list[Row]:
    """The vendor and the comments of a comment block; its lengths are little-endian."""

    def text(at: int) -> tuple[str, int]:
        _need(at + 4 <= len(data), "a comment runs past the end")
        n = int.from_bytes(data[at : at + 4], "little")
        _need(at + 4 + n <= len(data), "a comment runs past the end")
        return data[at + 4 : at + 4 + n].decode("utf-8", "replace"), at + 4 + n

    vendor, at = text(0)
    _need(at + 4 <= len(data), "no number of comments")
    out, n = [("vendor", vendor)], int.from_bytes(data[at : at + 4], "little")
    at += 4
    for _ in range(n):
        said, at = text(at)
        name, _, value = said.partition("=")
        out.append((name.upper(), value))
    return out


def id3_frames(data: bytes) -> list[Row]:
    """The frames of an ID3v2.3 or 2.4 tag, with the text of text frames."""
    _need(data[:3] == b"ID3" and len(data) >= 10, "no tag")
    version, out, at = data[3], [], 10
    while at + 10 <= len(data) and data[at] != 0:
        name = data[at : at + 4].decode("latin-1")
        raw = data[at + 4 : at + 8]
        n = sum(b << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if version >= 4 else int.from_bytes(raw, "big")
        _need(at + 10 + n <= len(data), "a frame runs past the tag")
        body = data[at + 10 : at + 10 + n]
        if name[:1] == "T" and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            out.append((name, body[1:].decode(code, "replace").rstrip("\0")))
        else:
            out.append((name, body.hex()))
        at += 10 + n
    return out


# kbit/s of layer III by the index in a frame's head, for version 1 and for versions 2 and 2.5, and hertz of version 1.
RATES_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
HERTZ = (44100, 48000, 32000)


def sound_frames(data: bytes) -> list[Row]:
    """The frames of an MP3 file with their place, size, rate, sampling and channels; first the header that an encoder leaves in
    the first frame, if there is one: its kind, the encoder, and the numbers of frames and bytes it states."""
    sound = next(p for p in parts("mp3", data) if p.kind == "audio")
    at, out = sound.at, []
    first = data[at : at + 200]
    if (place := max(first.find(b"Xing"), first.find(b"Info"))) >= 0:
        flags, pos, told = int.from_bytes(first[place + 4 : place + 8], "big"), place + 8, {}
        for name, bit in (("frames", 1), ("bytes", 2)):
            if flags & bit:
                told[name] = int.from_bytes(first[pos : pos + 4], "big")
                pos += 4
        encoder = data[at + place + 120 : at + place + 129].rstrip(b"\0 ").decode("latin-1")
        out.append(("encoder", json.dumps({"kind": first[place : place + 4].decode(), "name": encoder, **told})))
    number = 0
    while at < sound.end:
        version, index, hertz = data[at + 1] >> 3 & 3, data[at + 2] >> 4, HERTZ[data[at + 2] >> 2 & 3] >> {3: 0, 2: 1, 0: 2}[data[at + 1] >> 3 & 3]
        kbit = (RATES_1 if version == 3 else RATES_2)[index]
        size = (144 if version == 3 else 72) * kbit * 1000 // hertz + (data[at + 2] >> 1 & 1)
        _need(size > 0, "a frame without a size")
        out.append((f"frame {number}", json.dumps({"offset": at, "size": size, "kbit": kbit, "hertz": hertz, "channels": 1 if data[at + 3] >> 6 == 3 else 2})))
        at, number = at + size, number + 1
    return out


def photoshop_resources(data: bytes) -> list[Row]:
    """The resources of a Photoshop block: number and content in hex."""
    out, at = [], data.find(b"8BIM")
    while 0 <= at < len(data) and data[at : at + 4] == b"8BIM":
        _need(at + 7 <= len(data), "a resource runs past the end")
        number = int.from_bytes(data[at + 4 : at + 6], "big")
        place = at + 6 + (data[at + 6] + 2) // 2 * 2
        n = int.from_bytes(data[place : place + 4], "big")
        _need(place + 4 + n <= len(data), "a resource runs past the end")
        out.append((f"{number:04X}", data[place + 4 : place + 4 + n].hex()))
        at = place + 4 + n + n % 2
    return out


def iptc_datasets(data: bytes) -> list[Row]:
    """The datasets of an IPTC block: record:number and text."""
    out, at = [], 0
    while at + 5 <= len(data) and data[at] == 0x1C:
        n = int.from_bytes(data[at + 3 : at + 5], "big")
        _need(n < 0x8000 and at + 5 + n <= len(data), "a dataset runs past the end")
        out.append((f"{data[at + 1]}:{data[at + 2]}", data[at + 5 : at + 5 + n].decode("utf-8", "replace")))
        at += 5 + n
    return out


def apple_attributes(data: bytes) -> list[Row]:
    """The extended attributes in an AppleDouble file, in hex."""
    _need(data[:4] == b"\0\5\26\7" and len(data) >= 26, "no AppleDouble header")
    out = []
    for k in range(int.from_bytes(data[24:26], "big")):
        kind, at, size = struct.unpack_from(">III", data, 26 + 12 * k)
        _need(at + size <= len(data), "an entry lies past the end")
        head = data.find(b"ATTR", at, at + size)
        if kind != 9 or head < 0:
            out.append((f"entry {kind}", data[at : at + size].hex()))
            continue
        n, pos = int.from_bytes(data[head + 34 : head + 36], "big"), head + 36
        for _ in range(n):
            place, length, _, name_n = struct.unpack_from(">IIHB", data, pos)
            name = data[pos + 11 : pos + 11 + name_n].rstrip(b"\0").decode("utf-8", "replace")
            _need(place + length <= len(data), "an attribute lies past the end")
            out.append((name, data[place : place + length].hex()))
            pos += (11 + name_n + 3) // 4 * 4
    return out


_TAG = re.compile(rb"<(?:\w+:)?(Relationship|Override|Default|rootfile|item|itemref)\b([^>]*)>")
_ATTRIBUTE = re.compile(rb"""([\w:]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")


def package_relations(data: bytes) -> list[Row]:
    """Of a package: content types, relationships and manifest items, each with its attributes as JSON."""
    out = []
    for p in parts("zip", data):
        if p.kind.startswith("member ") and (p.more[0] == "[Content_Types].xml" or p.more[0].endswith((".rels", ".opf", "container.xml"))):
            for name, attributes in _TAG.findall(member_bytes(data, p)):
                found = {k.decode(): (a or b).decode("utf-8", "replace") for k, a, b in _ATTRIBUTE.findall(attributes)}
                out.append((f"{p.more[0]} {name.decode()}", json.dumps(found, sort_keys=True)))
    return out


def _boxes(data: bytes) -> dict[str, list[Part]]:
    out: dict[str, list[Part]] = {}
    for p in parts("mp4", data):
        out.setdefault(p.kind, []).append(p)
    return out


def media_chunks(data: bytes) -> list[Row]:
    """Of each track: chunk number, offset, and the number and sizes of its samples, by the run that holds the chunk."""
    boxes, out = _boxes(data), []
    for track, trak in enumerate(boxes.get("moov/trak", [])):
        inside = {k.rpartition("/")[2]: p for k, ps in boxes.items() for p in ps if k.startswith("moov/trak/") and trak.at < p.at < trak.end}
        offsets = inside.get("stco") or inside.get("co64")
        if offsets is None:
            continue
        width = 4 if "stco" in inside else 8
        body = offsets.payload(data)
        n = int.from_bytes(body[4:8], "big")
        _need(8 + n * width <= len(body), "a table of offsets is too short")
        places = [int.from_bytes(body[8 + k * width : 8 + (k + 1) * width], "big") for k in range(n)]
        runs = []
        if "stsc" in inside:
            body = inside["stsc"].payload(data)
            runs = [struct.unpack_from(">II", body, 8 + 12 * k) for k in range(int.from_bytes(body[4:8], "big"))]
        sizes, fixed = [], 0
        if "stsz" in inside:
            body = inside["stsz"].payload(data)
            fixed, count = struct.unpack_from(">II", body, 4)
            sizes = [] if fixed else list(struct.unpack_from(f">{count}I", body, 12))
        at = 0
        for chunk, place in enumerate(places, 1):
            per = next((k for first, k in reversed(runs) if first <= chunk), 1)
            own = [fixed] * per if fixed else sizes[at : at + per]
            at += per
            out.append((f"track {track} chunk {chunk}", json.dumps({"offset": place, "sizes": own})))
    return out


def picture_items(data: bytes) -> list[Row]:
    """Items of a still-picture container with their types, and references between items."""
    boxes, out = _boxes(data), []
    for p in boxes.get("meta/iinf", []):
        body = p.payload(data)
        at = 6 if body[0] == 0 else 8
        while at + 8 <= len(body):
            n = int.from_bytes(body[at : at + 4], "big")
            _need(n >= 8 and at + n <= len(body), "an item runs past its table")
            wide = body[at + 8] >= 3
            number = int.from_bytes(body[at + 12 : at + (16 if wide else 14)], "big")
            kind = body[at + (18 if wide else 16) : at + (22 if wide else 20)].decode("latin-1")
            out.append((f"item {number}", kind))
            at += n
    for p in boxes.get("meta/iref", []):
        body, width = p.payload(data), 4 if p.payload(data)[:1] == b"\1" else 2
        at = 4
        while at + 8 + 2 * width <= len(body):
            n, kind = int.from_bytes(body[at : at + 4], "big"), body[at + 4 : at + 8].decode("latin-1")
            _need(n >= 8 and at + n <= len(body), "a reference runs past its table")
            source = int.from_bytes(body[at + 8 : at + 8 + width], "big")
            count = int.from_bytes(body[at + 8 + width : at + 10 + width], "big")
            first = at + 10 + width
            targets = [int.from_bytes(body[first + k * width : first + (k + 1) * width], "big") for k in range(count)]
            out.append((f"reference {kind} {source}", json.dumps(targets)))
            at += n
    return out


def item_places(data: bytes) -> list[Row]:
    """Of a still-picture container: where each item lies (`iloc`) and the properties it has (`ipma`), by item."""
    boxes, out = _boxes(data), []
    for p in boxes.get("meta/iloc", []):
        body = p.payload(data)
        version, widths = body[0], (body[4] >> 4, body[4] & 15, body[5] >> 4, body[5] & 15 if body[0] in (1, 2) else 0)
        at = 6

        def number(width: int) -> int:
            nonlocal at
            _need(at + width <= len(body), "the table of places ends too soon")
            at += width
            return int.from_bytes(body[at - width : at], "big")

        wide = 4 if version == 2 else 2
        for _ in range(number(wide)):
            item = number(wide)
            method = number(2) & 15 if version in (1, 2) else 0
            number(2)  # where the data is: this file
            base = number(widths[2])
            extents = []
            for _ in range(number(2)):
                number(widths[3])
                place = number(widths[0])
                extents.append([base + place, number(widths[1])])
            out.append((f"place {item}", json.dumps({"method": method, "extents": extents})))
    for p in boxes.get("meta/iprp/ipma", []):
        body = p.payload(data)
        wide, large, at = 4 if body[0] >= 1 else 2, body[3] & 1, 8
        for _ in range(int.from_bytes(body[4:8], "big")):
            item, n = int.from_bytes(body[at : at + wide], "big"), body[at + wide]
            at += wide + 1
            step = 2 if large else 1
            _need(at + n * step <= len(body), "the table of properties ends too soon")
            held = [int.from_bytes(body[at + k * step : at + (k + 1) * step], "big") & (0x7FFF if large else 0x7F) for k in range(n)]
            at += n * step
            out.append((f"properties {item}", json.dumps(held)))
    return out


def page_positions(data: bytes) -> list[Row]:
    """Where a content stream shows text: each string with the place on the page and the size it is shown at, by replaying the
    graphics state. A string moves nothing, as fonts' widths aren't read; a move or a new line does."""
    out: list[Row] = []
    unit = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    times = lambda m, n: (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])
    page, size, leading, saved, line = unit, 0.0, 0.0, [], unit
    for operator, operands in content_operations(data):
        given = [float(x) for x in re.findall(r"(?<![\w.(<])[+-]?(?:\d+\.?\d*|\.\d+)(?![\w)>])", operands)] if operator not in ("Tj", "TJ", "'") else []
        if operator == "q":
            saved.append((page, size, leading))
        elif operator == "Q":
            _need(bool(saved), "a state is restored that wasn't saved")
            page, size, leading = saved.pop()
        elif operator == "cm" and len(given) == 6:
            page = times(given, page)
        elif operator == "BT":
            line = unit
        elif operator == "Tf" and given:
            size = given[-1]
        elif operator == "TL" and given:
            leading = given[0]
        elif operator in ("Td", "TD") and len(given) == 2:
            leading = -given[1] if operator == "TD" else leading
            line = times((1.0, 0.0, 0.0, 1.0, *given), line)
        elif operator == "Tm" and len(given) == 6:
            line = tuple(given)
        elif operator in ("T*", "'", '"'):
            line = times((1.0, 0.0, 0.0, 1.0, 0.0, -leading), line)
        if operator in ("Tj", "TJ", "'", '"'):
            at = times(line, page)
            out.append((operands, f"{at[4]:g} {at[5]:g} {size:g}"))
    return out


_TOKEN = re.compile(rb"""%[^\r\n]*|(?P<string>\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\))|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<mark><<|>>|[\[\]{}])|(?P<name>/[^\s()<>\[\]{}/%]*)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?![^\s()<>\[\]{}/%]))|(?P<operator>[^\s()<>\[\]{}/%]+)""", re.S)


def content_tokens(data: bytes) -> list[Row]:
    """The tokens of a page's content stream: kind and spelling."""
    return [(m.lastgroup, m.group().decode("latin-1")) for m in _TOKEN.finditer(data) if m.lastgroup]


def content_operations(data: bytes) -> list[Row]:
    """The operations of a content stream: operator and operands."""
    out, operands = [], []
    for kind, spelling in content_tokens(data):
        if kind == "operator" and spelling not in ("true", "false", "null"):
            out.append((spelling, " ".join(operands)))
            operands = []
        else:
            operands.append(spelling)
    return out


def joined_packets(chunks: list[tuple[bytes, int, int, bytes]]) -> dict[bytes, bytes]:
    """Packets put together from (identifier, full size, offset, piece), pieces in the order of offsets; gaps are refused."""
    by: dict[bytes, list] = {}
    for key, size, at, piece in chunks:
        by.setdefault(key, []).append((at, piece, size))
    out = {}
    for key, found in by.items():
        body = b""
        for at, piece, _ in sorted(found):
            _need(at == len(body), "a packet has a gap")
            body += piece
        _need(len(body) == found[0][2], "a packet is incomplete")
        out[key] = body
    return out


def profile_from_segments(segments: list[bytes]) -> bytes:
    """A colour profile from its numbered segments, which must be 1 to n, each once."""
    _need(bool(segments) and all(len(s) >= 14 and s[:12] == b"ICC_PROFILE\0" for s in segments), "no profile segments")
    numbers = sorted((s[12], s[13], s[14:]) for s in segments)
    _need([n for n, _, _ in numbers] == list(range(1, len(numbers) + 1)) and all(c == len(numbers) for _, c, _ in numbers), "profile segments are missing")
    return b"".join(p for _, _, p in numbers)


def pe_sections(data: bytes) -> list[Row]:
    """The sections of a PE file: name, offset and size."""
    _need(data[:2] == b"MZ" and len(data) >= 64, "no MZ header")
    at = int.from_bytes(data[60:64], "little")
    _need(data[at : at + 4] == b"PE\0\0", "no PE header")
    n, optional = int.from_bytes(data[at + 6 : at + 8], "little"), int.from_bytes(data[at + 20 : at + 22], "little")
    out = []
    for k in range(n):
        row = at + 24 + optional + 40 * k
        _need(row + 40 <= len(data), "a section header lies past the end")
        size, place = struct.unpack_from("<II", data, row + 16)
        _need(place + size <= len(data), "a section lies past the end")
        out.append((data[row : row + 8].rstrip(b"\0").decode("latin-1"), json.dumps({"offset": place, "size": size})))
    return out


def macho_commands(data: bytes) -> list[Row]:
    """The load commands of a 64-bit Mach-O file, or of each slice of a fat one."""
    if data[:4] == b"\xca\xfe\xba\xbe":
        out = []
        for k in range(int.from_bytes(data[4:8], "big")):
            at, size = struct.unpack_from(">II", data, 8 + 20 * k + 8)
            _need(at + size <= len(data), "a slice lies past the end")
            out += [(f"slice {k} {n}", v) for n, v in macho_commands(data[at : at + size])]
        return out
    _need(data[:4] == b"\xcf\xfa\xed\xfe" and len(data) >= 32, "no Mach-O header")
    out, at = [], 32
    for _ in range(int.from_bytes(data[16:20], "little")):
        _need(at + 8 <= len(data), "a command lies past the end")
        kind, size = struct.unpack_from("<II", data, at)
        _need(size >= 8 and at + size <= len(data), "a command runs past the end")
        out.append((f"command {kind & 0x7FFFFFFF:X}", json.dumps({"offset": at, "size": size})))
        at += size
    return out


def wmf_records(data: bytes) -> list[Row]:
    """The records of a Windows metafile: function and size in bytes."""
    at = 22 if data[:4] == b"\xd7\xcd\xc6\x9a" else 0
    _need(at + 18 <= len(data), "no metafile header")
    at, out = at + 18, []
    while True:
        _need(at + 6 <= len(data), "no end record")
        size, function = struct.unpack_from("<IH", data, at)
        _need(size >= 3 and at + 2 * size <= len(data), "a record has a wrong size")
        out.append((f"{function:04X}", str(2 * size)))
        if function == 0:
            return out
        at += 2 * size


def pe_checksum(data: bytes, at: int) -> int:
    """The checksum of a PE file whose own field of four bytes lies at a place: a one's-complement sum and the length."""
    body = data[:at] + bytes(4) + data[at + 4 :]
    body += b"\0" * (len(body) % 2)
    total = sum(struct.unpack(f"<{len(body) // 2}H", body))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return total + len(data)


def box_headers(path: str, skip_above: int = 64 << 20) -> list[tuple[str, int, int, bytes | None]]:
    """Top-level boxes of a file by seeks: name, offset, size, and the bytes of all but media and very large ones."""
    out = []
    with open(path, "rb") as file:
        end = file.seek(0, 2)
        at = 0
        while at < end:
            file.seek(at)
            head = file.read(16)
            _need(len(head) >= 8, "a box's head runs past the end")
            size = int.from_bytes(head[:4], "big")
            size = int.from_bytes(head[8:16], "big") if size == 1 else end - at if size == 0 else size
            _need(8 <= size <= end - at, "a box runs past the end")
            name = head[4:8].decode("latin-1")
            body = None
            if name != "mdat" and size <= skip_above:
                file.seek(at)
                body = file.read(size)
            out.append((name, at, size, body))
            at += size
    return out


READERS: dict[str, Callable[[bytes], list[Row]]] = {f.__name__: f for f in (vorbis_comments, id3_frames, photoshop_resources, iptc_datasets, apple_attributes, package_relations, media_chunks, picture_items, item_places, content_tokens, content_operations, page_positions, sound_frames, pe_sections, macho_commands, wmf_records)}


def rows(df: DataFrame, key: str, content: str, reader: str) -> DataFrame:
    """`<key>, seq, name, value, error`: the rows of a reader over each content; what doesn't add up gives one row with the reason."""
    read = READERS[reader]

    def found(data: bytes | None) -> list[tuple]:
        if data is None:
            return []
        try:
            return [(n, a, b, None) for n, (a, b) in enumerate(read(data))]
        except Malformed as e:
            return [(0, None, None, str(e))]
        except (struct.error, IndexError, UnicodeDecodeError):
            return [(0, None, None, "the part ends too soon")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [found(x) for x in batch.column(content).to_pylist()]
            at = pa.array([n for n, r in enumerate(each) for _ in r], pa.int32())
            flat = [x for r in each for x in r]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(at), pa.array([x[0] for x in flat], pa.int32()), *[pa.array([x[k] for x in flat], pa.string()) for k in (1, 2, 3)]], names=[key, "seq", "name", "value", "error"])

    return df.select(key, content).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, seq int, name string, value string, error string")
