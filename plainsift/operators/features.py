"""Structural features of files, the input of the statistical oracle: what a writer chooses and a reader doesn't see.

`features` gives (feature_id, value) of one file; `feature_table` does so for a table of files. Every kind has the features of
its parts (order, counts, sizes of what isn't content), and those of its own choices: times, methods and order of archives,
tables and filters of pictures, rates of sound, brands and time scales of films, spelling of markup and pages.
A file that can't be accounted for has the one feature `struct:malformed`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from plainsift.sources.containers import Malformed, Part, member_bytes, parts, recognise

Found = Iterator[tuple[str, object]]


def _short(data: bytes) -> str:
    return f"{zlib.crc32(data):08x}/{len(data)}"


def _runs(kinds: list[str]) -> str:
    """The kinds of parts in order, with repetitions in a row once."""
    return " ".join(k for n, k in enumerate(kinds) if not n or kinds[n - 1] != k)


def _archive(data: bytes, walked: list[Part]) -> Found:
    held = [p for p in walked if p.kind.startswith("member ")]
    names = [p.more[0] for p in held]
    heads = [data[p.at : p.at + 30] for p in held]
    stamps = {h[10:14] for h in heads}
    yield "zip:times", {frozenset([b"\0\0\x21\0"]): "first day", frozenset([b"\0\0\0\0"]): "unset"}.get(frozenset(stamps), f"clock, {len(stamps)} times")
    yield "zip:methods", sorted({int.from_bytes(h[8:10], "little") for h in heads})
    yield "zip:versions", sorted({int.from_bytes(h[4:6], "little") for h in heads})
    yield "zip:flags", sorted({int.from_bytes(h[6:8], "little") for h in heads})
    yield "zip:extra", sorted({int.from_bytes(h[28:30], "little") for h in heads})
    yield "zip:order", "sorted" if names == sorted(names) else "types first, then sorted" if names[:1] == ["[Content_Types].xml"] and names[1:] == sorted(names[1:]) else "own order"
    yield "zip:names", sorted(names)


def _package(data: bytes, walked: list[Part]) -> Found:
    yield from _archive(data, walked)
    for p in walked:
        if p.kind.startswith("member ") and p.more[0].endswith((".xml", ".rels", ".opf", ".xhtml")):
            for name, value in _markup(member_bytes(data, p), []):
                yield f"{name}@{p.more[0]}", value


def _markup(data: bytes, _: list[Part]) -> Found:
    head = re.match(rb"<\?xml[^>]*\?>(\r\n|\r|\n)?", data)
    spaced, every = len(re.findall(rb"\s/>", data)), data.count(b"/>")
    yield "xml:declaration", head[0].decode("latin-1") if head else "none"
    yield "xml:empty", "none" if not every else "spaced" if spaced == every else "mixed" if spaced else "tight"
    yield "xml:prefixes", sorted({m.decode("latin-1") for m in re.findall(rb"xmlns:([\w.-]+)=", data)})
    yield "xml:quotes", sorted({chr(q[0]) for q in re.findall(rb"=\s*([\"'])", data)})


def _png(data: bytes, walked: list[Part]) -> Found:
    head = next(p.payload(data) for p in walked if p.kind == "IHDR")
    yield "png:header", list(head[8:13])
    body = b"".join(p.payload(data) for p in walked if p.kind == "IDAT")
    yield "png:deflate", list(body[:2])
    yield "png:chunk sizes", sorted({p.size - 12 for p in walked if p.kind == "IDAT"})[:8]


def _jpeg(data: bytes, walked: list[Part]) -> Found:
    for name, kind in (("jpeg:quantisation", "DQT"), ("jpeg:huffman", "DHT"), ("jpeg:restart", "DRI"), ("jpeg:scan", "SOS")):
        yield name, [_short(data[p.at : min(p.end, p.at + 600)]) for p in walked if p.kind == kind]
    yield "jpeg:frame", [(p.kind, p.payload(data)[:1].hex(), p.payload(data)[5:].hex()) for p in walked if p.kind.startswith("SOF")]


def _mp3(data: bytes, walked: list[Part]) -> Found:
    sound = next(p for p in walked if p.kind == "audio")
    heads = sound.more[1]
    yield "mp3:rates", sorted({h[1] >> 4 for h in heads})
    yield "mp3:sampling", sorted({(h[0] >> 3 & 3, h[1] >> 2 & 3) for h in heads})
    yield "mp3:channels", sorted({h[2] >> 6 for h in heads})
    first = data[sound.at : sound.at + 2000]
    at = max(first.find(b"Xing"), first.find(b"Info"))
    yield "mp3:encoder", "none" if at < 0 else (first[at : at + 4] + b" " + first[at + 120 : at + 129]).decode("latin-1").rstrip("\0")


def _flac(data: bytes, walked: list[Part]) -> Found:
    info = next(p.payload(data) for p in walked if p.kind == "STREAMINFO")
    yield "flac:blocks", info[:4].hex()
    yield "flac:form", info[10:13].hex()
    yield "flac:padding", [p.size - 4 for p in walked if p.kind == "PADDING"]
    comments = [p.payload(data) for p in walked if p.kind == "VORBIS_COMMENT"]
    yield "flac:vendor", [c[4 : 4 + int.from_bytes(c[:4], "little")].decode("utf-8", "replace") for c in comments]


def _film(data: bytes, walked: list[Part]) -> Found:
    for p in walked:
        name = p.kind.rpartition("/")[2]
        if name == "ftyp":
            yield "film:brands", p.payload(data).decode("latin-1")
        elif name in ("mvhd", "mdhd") and len(p.payload(data)) >= 20:
            yield f"film:scale@{p.kind}", int.from_bytes(p.payload(data)[12:16], "big")
        elif name == "hdlr":
            yield f"film:handler@{p.kind}", p.payload(data)[8:].decode("latin-1").rstrip("\0")


def _page(data: bytes, walked: list[Part]) -> Found:
    yield "pdf:version", data[:8].decode("latin-1")
    yield "pdf:marker", data[8:20].split(b"%")[-1][:5].hex() if b"%" in data[8:20] else "none"
    yield "pdf:line ends", [name for name, end in (("crlf", b"\r\n"), ("lf", b"\n"), ("cr", b"\r")) if end in data[:1024]][:1]
    yield "pdf:numbers", [p.kind.split()[1] for p in walked if p.kind.startswith("object ")]
    yield "pdf:filters", sorted({m.decode("latin-1") for m in re.findall(rb"/Filter\s*\[?\s*/(\w+)", data)})
    yield "pdf:references", [kind for kind, sign in (("table", rb"\nxref\b"), ("stream", rb"/Type\s*/XRef\b")) if re.search(sign, data)]
    yield "pdf:revisions", len(re.findall(rb"%%EOF", data))


def _bitmap(data: bytes, walked: list[Part]) -> Found:
    head = next(p for p in walked if p.kind == "picture header")
    yield "bmp:header", head.size
    yield "bmp:depth", data[head.at + 14 : head.at + 20].hex() if head.size >= 40 else data[head.at + 8 : head.at + 12].hex()


def _gif(data: bytes, _: list[Part]) -> Found:
    yield "gif:screen", data[:6].decode("latin-1") + " " + data[10:13].hex()


def _webp(data: bytes, walked: list[Part]) -> Found:
    yield "webp:flags", [p.payload(data)[:1].hex() for p in walked if p.kind == "VP8X"]


def _tiff(data: bytes, walked: list[Part]) -> Found:
    yield "tiff:order", data[:2].decode("latin-1")
    yield "tiff:tags", [p.more[0] for p in walked if p.more]


OWN: dict[str, Callable[[bytes, list[Part]], Found]] = {
    "zip": _archive, "docx": _package, "xlsx": _package, "pptx": _package, "epub": _package, "xml": _markup, "svg": _markup, "png": _png, "jpeg": _jpeg, "mp3": _mp3, "flac": _flac,
    "mp4": _film, "m4a": _film, "heic": _film, "pdf": _page, "bmp": _bitmap, "gif": _gif, "webp": _webp, "tiff": _tiff, "raw": _tiff,
}


def features(kind: str, data: bytes) -> list[tuple[str, str]]:
    """The features of a file of a known kind, by name; the values as text."""
    try:
        walked = parts(kind, data)
        kinds = [re.sub(r"\d+", "#", p.kind) if kind not in ("mp4", "m4a") else p.kind for p in walked]
        found = [("struct:order", _runs(kinds)), ("struct:kinds", sorted(set(kinds))), ("struct:parts", len(walked)), *(OWN[kind](data, walked) if kind in OWN else ())]
    except (Malformed, IndexError, StopIteration):
        return [("struct:malformed", "true")]
    return sorted((n, v if isinstance(v, str) else str(v)) for n, v in dict(found).items())


def feature_table(files: DataFrame, keys: list[str], content: str) -> DataFrame:
    """The columns `keys`, and `format, feature_id, value` for every feature of every file; unknown and null files have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # one file at a time: files may be large
                data = batch.column(content)[at].as_py()
                kind = recognise(data) if data else None
                if kind and (found := features(kind, data)):
                    same = pa.array([at] * len(found), pa.int32())
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).take(same) for k in keys], pa.array([kind] * len(found)), pa.array([n for n, _ in found]), pa.array([v for _, v in found])], names=[*keys, "format", "feature_id", "value"])

    head = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)
    return files.select(*keys, content).mapInArrow(run, f"{head}, format string, feature_id string, value string")
