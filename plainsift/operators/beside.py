"""What lies beside files, and what is plain text: decided by bytes, for folders and archives alike."""

from __future__ import annotations

import re

# The first bytes of the files that systems leave beside others.
MAC_ATTRIBUTES = b"\0\5\26\7"
FOLDER_VIEW = b"\0\0\0\1Bud1"
THUMBNAILS = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"


def sidecar(path: str, head: bytes) -> str | None:
    """What a file is that only lies beside others, by its first bytes where its name suggests one; a folder is none."""
    folder, _, name = path.rpartition("/")
    mac = folder.partition("/")[0] == "__MACOSX" or name.startswith("._")
    suggested = [(mac, MAC_ATTRIBUTES, "attributes kept by a Mac"), (name == ".DS_Store", FOLDER_VIEW, "view settings of a folder"), (name.lower() == "thumbs.db", THUMBNAILS, "store of thumbnails")]
    return next((what for named, magic, what in suggested if named and head.startswith(magic)), None)


def is_text(data: bytes) -> bool:
    """Whether a file is plain text: UTF-8, no control bytes but tab and line ends, no metadata packet."""
    if re.search(rb"[\x00-\x08\x0b\x0e-\x1f\x7f]", data) or b"<?xpacket" in data[:256] or b"<x:xmpmeta" in data[:256]:
        return False
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True
