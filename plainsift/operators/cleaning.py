"""Light cleaning of containers: what draws or sounds stays bit for bit, what only tells about it goes.

`clean` rebuilds a file from the parts a rule keeps; kinds without a keep rule, and files that aren't accounted for, are
refused. `residuals` walks a cleaned file again and names what should be gone. `describe` lists the fields of a file.
Cleaning a cleaned file gives the same bytes.
"""

from __future__ import annotations

import html
import re
import struct
import zlib
from collections.abc import Callable

from plainsift.operators import inplace, packages
from plainsift.operators.beside import is_text, sidecar
from plainsift.sources.containers import Malformed, Part, member_bytes, parts, png_chunk, recognise

# The parts that define a picture or its rendering, and the parts of a film that may go.
PNG_KEPT = frozenset(["IHDR", "PLTE", "IDAT", "IEND", "tRNS", "gAMA", "cHRM", "sRGB", "sBIT", "bKGD", "acTL", "fcTL", "fdAT"])
JPEG_KEPT = re.compile(r"SOI|EOI|SOS|DQT|DHT|DRI|DAC|SOF\d+")
JPEG_JFIF = bytes.fromhex("ffe000104a46494600010100000100010000")
WEBP_KEPT = frozenset(["VP8X", "ICCP", "ANIM", "ANMF", "ALPH", "VP8 ", "VP8L"])
GIF_KEPT = frozenset(["header", "image", "graphic control", "plain text", "application NETSCAPE2.0", "application ANIMEXTS1.0", "application ICCRGBG1012", "end"])
ISO_KEPT = frozenset(["ftyp", "moov", "mdat"])
ISO_GONE = frozenset(["udta", "meta", "uuid", "free", "skip", "wide"])
ISO_REFUSED = frozenset(["moof", "mfra", "sidx", "styp", "ssix", "emsg", "sinf", "pssh", "schm", "frma", "senc", "tenc"])
TIFF_BLANK = frozenset([0x010E, 0x0131, 0x0132, 0x013C, 0x9003, 0x9004, 0x9010, 0x9011, 0x9012, 0x9290, 0x9291, 0x9292, 0x9286, 0xC62F, 0xC68B, 0x010D, 0x011D, 0x010F, 0x0110, 0x013B, 0x8298, 0x9C9B, 0x9C9C, 0x9C9D, 0x9C9E, 0x9C9F, *range(0xA430, 0xA43D), 0xA420, 0x02BC, 0x83BB, 0x8649, 0x927C])
PACKAGES = ("docx", "xlsx", "pptx", "epub")
#: Archives inside archives that are opened; more may be made to fill the memory.
MAX_NESTED = 16


def _kept(data: bytes, kept: list[Part]) -> bytes:
    """The bytes of parts in order; neighbours are taken in one slice."""
    spans: list[list[int]] = []
    for p in kept:
        if spans and spans[-1][1] == p.at:
            spans[-1][1] += p.size
        else:
            spans.append([p.at, p.at + p.size])
    return b"".join(data[a:b] for a, b in spans)


def _toyf(data: bytes) -> bytes:
    return _kept(data, [p for p in parts("toyf", data) if p.kind == "content"])


def _png(data: bytes) -> bytes:
    return _kept(data, [p for p in parts("png", data) if p.kind in PNG_KEPT or p.kind == "signature"])


def _orientation_segment(value: int) -> bytes:
    body = b"Exif\0\0MM\0*" + struct.pack(">IHHHIHHI", 8, 1, 0x0112, 3, 1, value, 0, 0)
    return b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body


#: The one form in which an orientation other than the plain one stays, for each value.
JPEG_ORIENTATION = {_orientation_segment(n): n for n in range(2, 9)}


def _orientation(block: bytes) -> int:
    """The orientation that an Exif block states, or 1."""
    try:
        for p in parts("tiff", block[6:]):
            if p.more and p.more[0] == 0x0112 and p.kind.startswith("IFD0"):
                order = "little" if block[6:7] == b"I" else "big"
                value = int.from_bytes(block[6 + p.more[1] : 8 + p.more[1]], order)
                return value if 2 <= value <= 8 else 1
    except Malformed:
        pass
    return 1


def _jpeg(data: bytes) -> bytes:
    """What draws the picture, with plain JFIF and Adobe blocks, and the orientation alone of an Exif block."""
    out, turned = [], 1
    for p in parts("jpeg", data):
        if JPEG_KEPT.fullmatch(p.kind):
            out.append(data[p.at : p.end])
        elif p.kind == "APP0 JFIF":
            out.append(JPEG_JFIF)
        elif p.kind == "APP14 Adobe" and p.size - p.head >= 12:
            out.append(b"\xff\xee\0\x0eAdobe\0\x64\0\0\0\0" + data[p.at + p.head + 11 : p.at + p.head + 12])
        elif p.kind == "APP1 Exif" and turned == 1 and (turned := _orientation(p.payload(data))) > 1:
            out.append(_orientation_segment(turned))
    return b"".join(out)


def _not_plain(kind: str, data: bytes) -> list[Part]:
    """The parts that may not stay: by their kind, unless they are the one form in which an orientation stays."""
    walked = parts(kind, data)
    allowed = {k for k in {p.kind for p in walked} if _ALLOWED[kind](Part(k, 0, 0))}
    return [p for p in walked if p.kind not in allowed and not (kind == "jpeg" and p.kind == "APP1 Exif" and data[p.at : p.end] in JPEG_ORIENTATION)]


def _gif(data: bytes) -> bytes:
    return _kept(data, [p for p in parts("gif", data) if p.kind in GIF_KEPT])


def _webp(data: bytes) -> bytes:
    body = []
    for p in parts("webp", data):
        if p.kind in WEBP_KEPT:
            chunk = bytearray(data[p.at : p.end])
            if p.kind == "VP8X":
                chunk[8] &= ~0x0C & 0xFF
            body.append(bytes(chunk) + b"\0" * (len(chunk) % 2))
    joined = b"".join(body)
    return b"RIFF" + struct.pack("<I", 4 + len(joined)) + b"WEBP" + joined


def _flac(data: bytes) -> bytes:
    walked = parts("flac", data)
    blocks = [p for p in walked if p.kind in ("STREAMINFO", "SEEKTABLE")]
    out = [b"fLaC"]
    for n, p in enumerate(blocks):
        out.append(bytes([(data[p.at] & 0x7F) | (0x80 if n == len(blocks) - 1 else 0)]) + data[p.at + 1 : p.end])
    return b"".join(out) + _kept(data, [p for p in walked if p.kind == "audio"])


def _mp3(data: bytes) -> bytes:
    return _kept(data, [p for p in parts("mp3", data) if p.kind == "audio"])


def _bmp(data: bytes) -> bytes:
    walked = {p.kind: p for p in parts("bmp", data)}
    head = bytearray(data[walked["picture header"].at : walked["picture header"].end])
    pixels = bytearray(data[walked["pixels"].at : walked["pixels"].end])
    if len(head) >= 40:
        width, height, _, bits, packed = struct.unpack_from("<iiHHI", head, 4)
        head[24:32] = bytes(8)  # the resolution
    else:
        width, height, _, bits = struct.unpack_from("<HHHH", head, 4)
        packed = 0
    if width <= 0 or bits <= 0:
        raise Malformed("a picture without width or depth")
    if packed not in (1, 2):
        stride, used = (width * bits + 31) // 32 * 4, width * bits
        spare = bytes([0xFF << (8 - used % 8) & 0xFF]) if used % 8 else b""
        for row in range(0, len(pixels), stride):
            end = row + (used + 7) // 8
            if spare:
                pixels[end - 1] &= spare[0]
            pixels[end : row + stride] = bytes(row + stride - end)
    palette = data[walked["palette"].at : walked["palette"].end] if "palette" in walked else b""
    start = 14 + len(head) + len(palette)
    return b"BM" + struct.pack("<IHHI", start + len(pixels), 0, 0, start) + bytes(head) + palette + bytes(pixels)


def zip_bytes(members: list[tuple[str, bytes]]) -> bytes:
    """A canonical archive: no times, deflated at level 6 only where that is smaller, the UTF-8 flag only where needed."""
    body, directory, at = [], [], 0
    for name, content in members:
        engine = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = engine.compress(content) + engine.flush()
        method, stored = (8, packed) if len(packed) < len(content) else (0, content)
        raw = name.encode("utf-8")
        common = struct.pack("<HHHHHIIIHH", 20, 0 if name.isascii() else 0x800, method, 0, 33, zlib.crc32(content), len(stored), len(content), len(raw), 0)
        body.append(b"PK\3\4" + common + raw + stored)
        directory.append(b"PK\1\2" + struct.pack("<H", 20 | 3 << 8) + common + struct.pack("<HHHII", 0, 0, 0, (0o40755 if name.endswith("/") else 0o100644) << 16, at) + raw)
        at += len(body[-1])
    listed = b"".join(directory)
    return b"".join(body) + listed + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, len(members), len(members), len(listed), at, 0)


def _contents(data: bytes) -> list[tuple[str, bytes, str | None, str]]:
    """Name, bytes, kind and fate of every member of an archive: `folder`, `beside` (it goes), `text`, `known` or `unknown`."""
    out, seen = [], set()
    for p in parts("zip", data):
        if not p.kind.startswith("member "):
            continue
        name, body = p.more[0], member_bytes(data, p)
        if name in seen:
            raise Malformed(f"{name}: two members of one name")
        seen.add(name)
        kind = recognise(body) if body else None
        if name.endswith("/"):
            fate = "folder"
        elif sidecar(name, body[:64]):
            fate = "beside"
        else:
            fate = "known" if kind else "text" if is_text(body) else "unknown"
        out.append((name, body, kind, fate))
    return out


def _zip(data: bytes, depth: int = 0) -> bytes:
    """The archive rebuilt in the order of names: each member cleaned by the rules of its own kind, plain text as it is, empty
    folders, and nothing of what lies beside files. A member that no rule knows refuses the archive, by its name."""
    if depth > MAX_NESTED:
        raise Malformed(f"archives in archives more than {MAX_NESTED} deep")
    found = _contents(data)
    if unknown := [name for name, _, _, fate in found if fate == "unknown"]:
        raise Malformed(f"{len(unknown)} members of unknown types: " + ", ".join(unknown[:10]) + ("" if len(unknown) <= 10 else ", ..."))
    out = {}
    for name, body, kind, fate in found:
        if fate == "known":
            try:
                out[name] = _zip(body, depth + 1) if kind == "zip" else clean(kind, body)
            except Malformed as e:
                raise Malformed(f"{name}: {e}") from e
        elif fate == "text":
            out[name] = body
    out |= {name: b"" for name, _, _, fate in found if fate == "folder" and not any(o.startswith(name) for o in out) and not name.startswith("__MACOSX/")}
    return zip_bytes(sorted(out.items()))


def _zip_left(data: bytes) -> list[str]:
    left = []
    for name, body, kind, fate in _contents(data):
        if fate == "known":
            left += [f"{name}: {r}" for r in residuals(kind, body)]
        elif fate in ("beside", "unknown"):
            left.append(name)
    return left


def _zip_told(data: bytes) -> list[tuple[str, bytes]]:
    told = []
    for name, body, kind, fate in _contents(data):
        if fate == "known":
            told += [(f"{name}: {n}", v) for n, v in _told(kind, body)]
        elif fate == "beside":
            told.append((f"member {name}", body))
    return told


def _members(data: bytes) -> dict[str, bytes]:
    return {p.more[0]: member_bytes(data, p) for p in parts("zip", data) if p.kind.startswith("member ")}


def _opened(kind: str, members: dict[str, bytes]) -> tuple[dict[str, bytes], list[tuple[str, bytes]]]:
    """The members of a cleaned package, and locus and value of all that goes: whole members, then what stood in others."""
    if kind == "epub":
        kept, told, gone = packages.epub(members, clean)
    else:
        kept, told = packages.office(kind, members, clean)
        gone = {n for n in members if packages.GONE[kind].fullmatch(n) and not n.endswith("/")}
    return kept, [(f"member {n}", members[n]) for n in members if n in gone] + told


_RECENT_PACKAGE: list[tuple[str, bytes, tuple]] = []


def _opened_file(kind: str, data: bytes) -> tuple[dict[str, bytes], list[tuple[str, bytes]]]:
    """`_opened` of a whole package; the last one is remembered, since a clean asks for it several times in a row."""
    if not (_RECENT_PACKAGE and _RECENT_PACKAGE[0][0] == kind and _RECENT_PACKAGE[0][1] is data):
        _RECENT_PACKAGE[:] = [(kind, data, _opened(kind, _members(data)))]
    return _RECENT_PACKAGE[0][2]


def _package(kind: str) -> Callable[[bytes], bytes]:
    def run(data: bytes) -> bytes:
        kept, _ = _opened_file(kind, data)
        return zip_bytes(sorted(kept.items(), key=lambda m: (m[0] != "mimetype", m[0] != "[Content_Types].xml", m[0])))

    return run


def _package_left(kind: str, data: bytes) -> list[str]:
    """What a second cleaning would still take from a package, and what the rules of embedded files still find."""
    members = _members(data)
    kept, told = _opened_file(kind, data)
    left = [n for n, _ in told] + [f"{n}: still changes" for n in sorted(members) if kept.get(n) != members[n]]
    for name, content in members.items():
        if not name.endswith((".xml", ".rels", ".vml", ".odttf")) and (inner := recognise(content)) in CLEANERS and inner not in packages.ARCHIVES:
            left += [f"{name}: {r}" for r in residuals(inner, content)]
    return left


def _svg(data: bytes) -> bytes:
    gone, until = [], -1
    for p in sorted(parts("svg", data), key=lambda p: (p.at, -p.size)):
        foreign = p.kind.rpartition(" ")[0] not in ("http://www.w3.org/2000/svg", "") and p.kind not in ("comment", "instruction")
        if p.at >= until and (foreign or p.kind in ("comment", "instruction") or p.kind.rpartition(" ")[2] == "metadata"):
            gone.append((p.at, p.end))
            until = p.end
    out, at = [], 0
    for start, end in gone:
        out.append(data[at:start])
        at = end
    out.append(data[at:])
    return b"".join(out)


def _iso(data: bytes) -> bytes:
    """ftyp, moov and mdat alone; the offsets of samples follow the media, and times become 0."""
    walked = parts("mp4", data)
    if any(p.kind.rpartition("/")[2] in ISO_REFUSED for p in walked):
        raise Malformed("fragments or protection")
    top = [p for p in walked if "/" not in p.kind]
    kept = [p for p in top if p.kind in ISO_KEPT]
    if [p.kind for p in kept].count("moov") != 1 or kept[0].kind != "ftyp":
        raise Malformed("not one movie after its type")

    tables: list[tuple[int, int, int]] = []  # start and end of the entries of each table of offsets in the movie, and their width

    def box(p: Part, at: int = 0) -> bytes:
        inner = [q for q in walked if q.kind.startswith(p.kind + "/") and "/" not in q.kind[len(p.kind) + 1 :] and p.at < q.at < p.end]
        name = p.kind.rpartition("/")[2]
        if inner:
            content = b""
            for q in inner:
                if q.kind.rpartition("/")[2] not in ISO_GONE:
                    content += box(q, at + 8 + len(content))
        else:
            content = bytearray(p.payload(data))
            if name in ("mvhd", "tkhd", "mdhd") and len(content) >= 20:
                content[4 : 20 if content[0] == 1 else 12] = bytes(16 if content[0] == 1 else 8)
            if name in ("stco", "co64") and len(content) >= 8:
                width = 4 if name == "stco" else 8
                n = min(int.from_bytes(content[4:8], "big"), (len(content) - 8) // width)
                tables.append((at + 16, at + 16 + n * width, width))
            content = bytes(content)
        return struct.pack(">I", 8 + len(content)) + name.encode("latin-1") + content

    movie = box(next(p for p in kept if p.kind == "moov"))
    places, at = [], 0
    for p in kept:
        size = len(movie) if p.kind == "moov" else p.size
        places.append((p.at, p.end, at - p.at))
        at += size

    def moved(offset: int) -> int:
        for start, end, by in places:
            if start <= offset < end:
                return offset + by
        raise Malformed("samples lie outside the media")

    movie = bytearray(movie)
    for start, end, width in tables:
        for where in range(start, end, width):
            movie[where : where + width] = moved(int.from_bytes(movie[where : where + width], "big")).to_bytes(width, "big")
    return b"".join(bytes(movie) if p.kind == "moov" else data[p.at : p.end] for p in kept)


def _tiff(data: bytes) -> bytes:
    out = bytearray(data)
    for p in parts("tiff", data):
        if not p.more:
            continue
        tag, where, width = p.more
        if tag in TIFF_BLANK or p.kind.startswith("GPS "):
            out[where : where + width] = bytes(width)
    return bytes(out)


_PDF_STRING = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>(?!>)", re.S)
_PDF_ID = re.compile(rb"/ID\s*\[\s*<([0-9A-Fa-f\s]*)>\s*<([0-9A-Fa-f\s]*)>\s*\]")
_PDF_STREAM = re.compile(rb"stream\r?\n(.*?)endstream", re.S)


def _pdf_places(data: bytes) -> list[tuple[str, int, int]]:
    """Locus, start and end of what tells about a document: strings of its information, its metadata packets, its ids.

    Nothing moves, so what can't be seen in place is refused: encrypted files and objects packed in streams."""
    walked = parts("pdf", data)
    if b"/Encrypt" in data:
        raise Malformed("an encrypted document")
    if b"/ObjStm" in data:
        raise Malformed("objects packed in streams")
    told = {f"object {int(n)} {int(g)}" for n, g in re.findall(rb"/Info\s+(\d{1,10})\s+(\d{1,5})\s+R", data)}
    out = []
    for p in walked:
        if not p.kind.startswith("object "):
            continue
        start, end = p.at + p.head, p.end - p.tail
        body = data[start:end]
        if p.kind in told:
            out += [(f"{p.kind} string", start + m.start() + 1, start + m.end() - 1) for m in _PDF_STRING.finditer(body)]
        if re.search(rb"/Type\s*/Metadata\b", body) and (m := _PDF_STREAM.search(body)):
            out.append((f"{p.kind} metadata", start + m.start(1), start + m.end(1)))
    out += [("identifier", *m.span(k)) for m in _PDF_ID.finditer(data) for k in (1, 2)]
    return [(n, a, b) for n, a, b in out if data[a:b].strip(b" 0\r\n")]


def _pdf(data: bytes) -> bytes:
    out = bytearray(data)
    for name, a, b in _pdf_places(data):
        out[a:b] = (b"0" if name == "identifier" or data[a - 1 : a] == b"<" else b" ") * (b - a)
    return bytes(out)


CLEANERS: dict[str, Callable[[bytes], bytes]] = {"toyf": _toyf, "png": _png, "jpeg": _jpeg, "gif": _gif, "webp": _webp, "flac": _flac, "mp3": _mp3, "bmp": _bmp, "zip": _zip, **{k: _package(k) for k in PACKAGES}, "svg": _svg, "m4a": _iso, "mp4": _iso, "tiff": _tiff, "pdf": _pdf, "exe": inplace.program, "heic": inplace.still, "metafile": inplace.metafile}
#: What is blanked in place, by kind.
PLACES: dict[str, Callable[[bytes], list[tuple[str, int, int]]]] = {"pdf": _pdf_places, "exe": inplace.program_places, "heic": inplace.still_places}
_ALLOWED: dict[str, Callable[[Part], bool]] = {
    "toyf": lambda p: p.kind == "content",
    "png": lambda p: p.kind in PNG_KEPT or p.kind == "signature",
    "jpeg": lambda p: bool(JPEG_KEPT.fullmatch(p.kind)) or p.kind in ("APP0 JFIF", "APP14 Adobe"),
    "gif": lambda p: p.kind in GIF_KEPT,
    "webp": lambda p: p.kind in WEBP_KEPT or p.kind == "header",
    "flac": lambda p: p.kind in ("magic", "STREAMINFO", "SEEKTABLE", "audio"),
    "mp3": lambda p: p.kind == "audio",
    "bmp": lambda p: p.kind != "trailer",
    "svg": lambda p: p.kind not in ("comment", "instruction") and p.kind.rpartition(" ")[2] != "metadata",
    "m4a": lambda p: p.kind.rpartition("/")[2] not in ISO_GONE,
    "mp4": lambda p: p.kind.rpartition("/")[2] not in ISO_GONE,
}


def _png_packed_anew(data: bytes) -> bytes:
    """A cleaned PNG whose picture data are deflated in one way and lie in one chunk: what its encoder chose is gone, and the
    filtered rows are the same."""
    cleaned = _png(data)
    walked = parts("png", cleaned)
    packed = [p for p in walked if p.kind == "IDAT"]
    rows = zlib.decompress(b"".join(p.payload(cleaned) for p in packed))
    again = zlib.compress(rows, 9)
    out = []
    for p in walked:
        if p.kind != "IDAT":
            out.append(cleaned[p.at : p.end])
        elif p is packed[0]:
            out.append(png_chunk(b"IDAT", again))
    return b"".join(out)


def _zip_again(data: bytes) -> bytes:
    """An archive whose members are cleaned at the second level where their kind has one."""
    found = {name: (LEVELS["F2"][kind](body) if kind in LEVELS["F2"] else body) for name, body, kind, _ in _contents(_zip(data))}
    return zip_bytes(sorted(found.items()))


#: Levels beyond the first, by kind: what an encoder or packer chose is made anew, without loss.
LEVELS: dict[str, dict[str, Callable[[bytes], bytes]]] = {"F2": {"png": _png_packed_anew, "zip": _zip_again}}


def clean(kind: str, data: bytes, level: str = "F1") -> bytes:
    """The cleaned file. Malformed if it can't be accounted for, or no rule says what of its kind may stay at this level."""
    if kind not in CLEANERS:
        raise Malformed(f"no rule for {kind}")
    if level != "F1" and kind not in LEVELS.get(level, ()):
        raise Malformed(f"level {level} isn't built for {kind}")
    try:
        return _accounted(CLEANERS[kind] if level == "F1" else LEVELS[level][kind], data)
    except zlib.error as e:
        raise Malformed("data that don't inflate") from e


def _accounted(rule: Callable, data: bytes):  # noqa: ANN202
    """What a rule gives; a number that leads past the end of the file is the file's fault."""
    try:
        return rule(data)
    except (struct.error, IndexError, UnicodeDecodeError) as e:
        raise Malformed("the file ends too soon") from e


def residuals(kind: str, data: bytes) -> list[str]:
    """What a cleaned file still has and shouldn't."""
    if kind in PACKAGES:
        return _package_left(kind, data)
    if kind == "zip":
        return _zip_left(data)
    if kind in PLACES:
        return [n for n, _, _ in PLACES[kind](data)]
    if kind == "metafile":
        return [n for n, _ in inplace.metafile_told(data)]
    if kind == "tiff":
        return [p.kind for p in parts("tiff", data) if p.more and (p.more[0] in TIFF_BLANK or p.kind.startswith("GPS ")) and any(data[p.more[1] : p.more[1] + p.more[2]])]
    return [p.kind for p in _not_plain(kind, data)]


def _told(kind: str, data: bytes) -> list[tuple[str, bytes]]:
    if kind in PACKAGES:
        return _opened_file(kind, data)[1]
    if kind == "zip":
        return _zip_told(data)
    if kind in PLACES:
        return [(n, data[a:b]) for n, a, b in PLACES[kind](data)]
    if kind == "metafile":
        return inplace.metafile_told(data)
    if kind == "tiff":
        blank = [p for p in parts("tiff", data) if p.more and (p.more[0] in TIFF_BLANK or p.kind.startswith("GPS "))]
        return [(p.kind, data[p.more[1] : p.more[1] + p.more[2]]) for p in blank if any(data[p.more[1] : p.more[1] + p.more[2]])]
    return [(p.kind, p.payload(data)) for p in _not_plain(kind, data)]


def describe(kind: str, data: bytes) -> list[tuple[str, str]]:
    """Locus and value of every part that cleaning would take out or rewrite, whole; members as they inflate."""
    return [(n, v.decode("latin-1")) for n, v in _accounted(lambda d: _told(kind, d), data)]


# The elements of properties that name people, places or copies, and the values too short to be told apart.
NAMING = re.compile(r"(?:dc:)?(?:creator|contributor|publisher|rights|source|identifier)|(?:\w+:)?(?:lastModifiedBy|Manager|Company|HyperlinkBase|Template|keywords|lpw?str)|docAuthor|h:meta (?:author|creator)|unused relationship")
MIN_SEARCHED = 5


def removed_values(kind: str, described: list[tuple[str, str]]) -> list[tuple[str, bytes]]:
    """What a search of the cleaned file looks for, out of its description: locus and value, of removed parts whole, of packages also what names.

    A value counts if it has five bytes that aren't blank or zero. Of a member of properties each naming element is a value
    of its own, since it may stand alone elsewhere; the other words of a package (`Title`, `en-US`) stand in any document."""
    found = []
    for locus, value in [(n, v.encode("latin-1")) for n, v in described]:
        if kind not in PACKAGES:
            found.append((locus, value))
        elif locus.startswith("member "):
            found.append((locus, value))
            if value.lstrip(b"\xef\xbb\xbf \r\n\t").startswith(b"<"):
                found += [(f"{locus} {m[1].decode('latin-1')}", html.unescape(m[2].decode("utf-8", "replace")).encode()) for m in re.finditer(rb"<([\w.:-]+)(?:\s[^<>]*)?>([^<>]+)</", value) if NAMING.fullmatch(m[1].decode("latin-1"))]
                found += [(f"{locus} {m[1].decode('latin-1')}", html.unescape(m[2].decode("utf-8", "replace")).encode()) for m in re.finditer(rb'\s((?:\w+:)?(?:author|userId|displayName|initials))="([^"]*)"', value)]
        elif NAMING.fullmatch(locus.rpartition(": ")[2]):
            found.append((locus, value))
    return [(n, v.strip(b"\0 \t\r\n")) for n, v in found if len(v.translate(None, b"\0 \t\r\n")) >= MIN_SEARCHED]


def searched_values(kind: str, data: bytes, fields: list[tuple[str, str]] | None = None) -> list[tuple[str, bytes]]:
    """The values to search for after cleaning the file `data`, which `fields` describes; of an archive those of each member by its kind."""
    if kind != "zip":
        return removed_values(kind, describe(kind, data) if fields is None else fields)
    found = []
    for name, body, inner, fate in _contents(data):
        if fate == "known":
            found += [(f"{name}: {n}", v) for n, v in searched_values(inner, body)]
        elif fate == "beside":
            found += removed_values("zip", [(f"member {name}", body.decode("latin-1"))])
    return found


def still_readable(kind: str, data: bytes, values: list[tuple[str, bytes]]) -> tuple[list[str], list[str]]:
    """Loci of the values that a cleaned file still holds: anywhere in it, and only in text that it shows.

    Archives are searched in their bytes and, at every depth, in every member as it inflates; of a member in XML what stands
    between tags is text that a document shows, which stays by the rules, as are members of plain text; all else is not."""
    held, shown = _searched(kind, data)
    readable = sorted({n for n, v in values if any(v in h for h in held)})
    return readable, sorted({n for n, v in values if any(v in s for s in shown)} - set(readable))


def _searched(kind: str, data: bytes) -> tuple[list[bytes], list[bytes]]:
    """What is searched of a file: what it doesn't show as text, and what it does."""
    held, shown = [data], []
    if kind == "zip":
        for name, body, inner, fate in _contents(data):
            held.append(name.encode())
            if fate == "known":
                more = _searched(inner, body)
                held += more[0]
                shown += more[1]
            else:
                (shown if fate == "text" else held).append(body)
    elif kind in PACKAGES:
        for name, body in _members(data).items():
            held.append(name.encode())
            if name.endswith((".xml", ".rels", ".xhtml", ".html", ".htm", ".opf", ".ncx")):
                plain = lambda b: html.unescape(b.decode("utf-8", "replace")).encode()
                shown.append(plain(re.sub(rb"<[^>]*>", b"", body)))
                held += [plain(b"\n".join(re.findall(rb"<[^>]*>", body)))]
            else:
                held.append(body)
    if kind == "zip":
        held = held[1:]  # stored members stand in the archive's own bytes too, shown text among them
    return held, shown
