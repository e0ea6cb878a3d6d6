"""Light cleaning of programs, still pictures of film containers, and metafiles: what tells about a file, by its places.

Nothing of a program or a still picture moves, so its places are blanked: of programs times, build identifiers, names of
compilers and debug files; of still pictures the items that hold Exif or packets. Signed programs are refused, as a blanked one
no longer has its signature's content. Metafiles are rebuilt without comment records and the description in their header.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

from plainsift.sources import inner
from plainsift.sources.containers import Malformed, Part, parts

Place = tuple[str, int, int]

# Sections of a program that only tell how it was made, and load commands and records by number.
TELLING_SECTIONS = (".comment", ".gnu_debuglink", ".gnu_debugaltlink", ".gnu.build.attributes", ".GCC.command.line")
MACHO_UUID, MACHO_SIGNATURE, MACHO_SOURCE, MACHO_BUILD_PATH = 0x1B, 0x1D, 0x2A, 0x27
PE_CERTIFICATES, PE_DEBUG = 4, 6
EMF_HEADER, EMF_END, EMF_COMMENT, WMF_ESCAPE, WMF_COMMENT = 1, 14, 70, 0x0626, 15
TELLING_ITEMS = ("Exif", "mime", "uri ")


def _elf(data: bytes) -> Iterator[Place]:
    for p in parts("exe", data):
        name = p.kind.removeprefix("section ")
        if name in TELLING_SECTIONS:
            yield name, p.at, p.end
        elif name == ".note.gnu.build-id" and p.size > 16:
            yield name, p.at + 16, p.end  # behind the head of the note, which readers still walk


def _pe(data: bytes) -> Iterator[Place]:
    inner.pe_sections(data)  # all sections lie within the file
    head = int.from_bytes(data[60:64], "little")
    n, width = int.from_bytes(data[head + 6 : head + 8], "little"), int.from_bytes(data[head + 20 : head + 22], "little")
    yield "time of the header", head + 8, head + 12
    optional = head + 24
    wide = data[optional : optional + 2] == b"\x0b\x02"
    first = optional + (112 if wide else 96)
    entry = lambda k: struct.unpack_from("<II", data, first + 8 * k) if first + 8 * (k + 1) <= optional + width else (0, 0)
    if any(entry(PE_CERTIFICATES)):
        raise Malformed("a signed program")
    address, size = entry(PE_DEBUG)
    rows = [struct.unpack_from("<IIII", data, optional + width + 40 * k + 8) for k in range(n)]
    for section_size, virtual, raw_size, raw in rows:
        if address and virtual <= address < virtual + max(section_size, raw_size):
            table = raw + address - virtual
            for at in range(table, table + size - 27, 28):
                yield "time of debug data", at + 4, at + 8
                length, place = struct.unpack_from("<II", data, at + 16)[0], struct.unpack_from("<I", data, at + 24)[0]
                if place + length > len(data):
                    raise Malformed("debug data lie past the end")
                yield "debug data", place, place + length


def _macho(data: bytes, base: int = 0) -> Iterator[Place]:
    if data[:4] == b"\xca\xfe\xba\xbe":
        for k in range(int.from_bytes(data[4:8], "big")):
            at, size = struct.unpack_from(">II", data, 16 + 20 * k)
            if at + size > len(data):
                raise Malformed("a slice lies past the end")
            yield from _macho(data[at : at + size], at)
        return
    for name, told in inner.macho_commands(data):
        kind, place = int(name.split()[-1], 16), json.loads(told)
        if kind == MACHO_SIGNATURE:
            raise Malformed("a signed program")
        if kind in (MACHO_UUID, MACHO_SOURCE):
            yield name, base + place["offset"] + 8, base + place["offset"] + place["size"]


def program_places(data: bytes) -> list[Place]:
    """Name, start and end of what tells about a program and isn't zero yet."""
    walk = _pe if data[:2] == b"MZ" else _elf if data[:4] == b"\x7fELF" else _macho
    try:
        return [(n, a, b) for n, a, b in walk(data) if any(data[a:b])]
    except (struct.error, IndexError, ValueError) as e:
        raise e if isinstance(e, Malformed) else Malformed("the program ends too soon") from e


def _blank(data: bytes, places: list[Place]) -> bytes:
    out = bytearray(data)
    for _, a, b in places:
        out[a:b] = bytes(b - a)
    return bytes(out)


def program(data: bytes) -> bytes:
    """A program with its telling places as zeros; a Windows program's checksum is made anew where it had one."""
    out = _blank(data, program_places(data))
    if data[:2] == b"MZ":
        head = int.from_bytes(data[60:64], "little")
        at = head + 24 + 64
        if int.from_bytes(data[head + 20 : head + 22], "little") >= 68 and any(out[at : at + 4]):
            out = out[:at] + struct.pack("<I", inner.pe_checksum(out, at)) + out[at + 4 :]
    return out


def still_places(data: bytes) -> list[Place]:
    """Item, start and end of the Exif and packets of a still picture that aren't zero yet, and its free and user boxes."""
    kinds = {int(n.split()[1]): k for n, k in inner.picture_items(data) if n.startswith("item ")}
    telling, others = [], []
    for name, told in inner.item_places(data):
        if not name.startswith("place "):
            continue
        item, where = int(name.split()[1]), json.loads(told)
        for at, size in where["extents"]:
            if kinds.get(item) in TELLING_ITEMS:
                if where["method"] != 0 or at + size > len(data) or not size:
                    raise Malformed(f"item {item} doesn't lie in the file by a plain place")
                telling.append((f"item {item} {kinds[item].strip()}", at, at + size))
            elif where["method"] == 0:
                others.append((at, at + size))
    for name, a, b in telling:
        if any(a < end and start < b for start, end in others):
            raise Malformed(f"{name} shares bytes with a picture")
    telling += [(p.kind, p.at + p.head, p.end) for p in parts("heic", data) if p.kind in ("free", "skip", "uuid", "udta")]
    return [(n, a, b) for n, a, b in telling if any(data[a:b])]


def still(data: bytes) -> bytes:
    """A still picture whose Exif and packets are zeros."""
    return _blank(data, still_places(data))


def _described(data: bytes) -> tuple[int, int]:
    """Start and end of the description in a metafile's header."""
    size = int.from_bytes(data[4:8], "little")
    n, at = struct.unpack_from("<II", data, 60)
    if n and not (88 <= at and at + 2 * n <= size):
        raise Malformed("the description lies outside the header")
    return at, at + 2 * n


def _is_drawing(data: bytes, p: Part) -> bool:
    if p.kind != f"record {EMF_COMMENT}":
        return True
    if data[p.at + 12 : p.at + 16] == b"EMF+":
        raise Malformed("a metafile that draws by records of another kind")
    return False


def _wmf_records(data: bytes) -> list[tuple[int, int, bool]]:
    """Start, end of every record of a Windows metafile, and whether it is a comment."""
    at, out = (40 if data[:4] == b"\xd7\xcd\xc6\x9a" else 18), []
    for name, size in inner.wmf_records(data):
        comment = name == f"{WMF_ESCAPE:04X}" and int.from_bytes(data[at + 6 : at + 8], "little") == WMF_COMMENT
        out.append((at, at + int(size), comment))
        at += int(size)
    return out


def metafile(data: bytes) -> bytes:
    """A metafile without comments, description and what follows its end, its counts made anew."""
    if data[40:44] != b" EMF":
        records = _wmf_records(data)
        kept = [(a, b) for a, b, comment in records if not comment]
        head = bytearray(data[: records[0][0]])
        at = len(head) - 18
        struct.pack_into("<I", head, at + 6, (18 + sum(b - a for a, b in kept)) // 2)
        struct.pack_into("<I", head, at + 12, max((b - a) // 2 for a, b in kept))
        return bytes(head) + b"".join(data[a:b] for a, b in kept)
    walked = [p for p in parts("metafile", data) if p.kind != "trailer" and _is_drawing(data, p)]
    head = bytearray(data[walked[0].at : walked[0].end])
    a, b = _described(data)
    head[a:b] = bytes(b - a)
    body = b"".join(data[p.at : p.end] for p in walked[1:])
    struct.pack_into("<IIHHII", head, 48, len(head) + len(body), len(walked), *struct.unpack_from("<HH", head, 56), 0, 0)
    return bytes(head) + body


def metafile_told(data: bytes) -> list[tuple[str, bytes]]:
    """Name and bytes of what a metafile would lose."""
    if data[40:44] != b" EMF":
        records = _wmf_records(data)
        rest = data[records[-1][1] :]
        return [("comment", data[a:b]) for a, b, comment in records if comment] + ([("trailer", rest)] if rest else [])
    a, b = _described(data)
    told = [("description", data[a:b])] if any(data[a:b]) else []
    return told + [("comment" if p.kind != "trailer" else "trailer", p.payload(data)) for p in parts("metafile", data) if p.kind == "trailer" or not _is_drawing(data, p)]
