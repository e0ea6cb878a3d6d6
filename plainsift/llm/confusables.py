"""Letters of other scripts that have the shape of an ASCII letter, by the public confusables data that Spark's jars bring.

The data is the binary form of Unicode's confusables: a header of big-endian 32-bit numbers, sorted keys (a code point in the
low 24 bits, the length of its prototype less one in the high 8), a value per key, and the prototypes longer than one unit.
"""

from __future__ import annotations

import glob
import os
import struct
import unicodedata
import warnings
import zipfile
from functools import lru_cache

MAGIC = 0x3845FDEF
MEMBER = "com/ibm/icu/impl/data/icudata/confusables.cfu"

# The scripts, as Unicode's names of letters begin, that are written with letters of Latin shape, and of those
# without cased twins of their own the case they look like. Greek small letters are left out but for those listed by shape.
SCRIPTS = ("CYRILLIC ", "ARMENIAN ", "GREEK CAPITAL ", "COPTIC ", "CHEROKEE ", "LISU ", "ROMAN NUMERAL ", "SMALL ROMAN NUMERAL ")
UPPER_ONLY = ("CHEROKEE LETTER", "LISU ", "ROMAN NUMERAL ")


def _archives() -> list[str]:
    import pyspark

    homes = [os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)]
    return [p for h in homes if h for p in sorted(glob.glob(os.path.join(h, "jars", "icu4j*.jar")))]


@lru_cache(1)
def prototypes() -> dict[str, str]:
    """The prototype of each character that has one; none, with a warning, where the data isn't installed."""
    for path in _archives():
        with zipfile.ZipFile(path) as jar:
            if MEMBER in jar.namelist():
                return read(jar.read(MEMBER))
    warnings.warn("no confusables data beside Spark: only the fixed look-alike letters are known", stacklevel=2)
    return {}


def read(data: bytes) -> dict[str, str]:
    """The prototypes in a file of confusables."""
    data = data[struct.unpack_from(">H", data)[0] :]
    magic, _, _, keys_at, n_keys, values_at, _, text_at, n_text = struct.unpack_from(">9I", data)
    if magic != MAGIC:
        raise ValueError("not a file of confusables")
    keys = struct.unpack_from(f">{n_keys}I", data, keys_at)
    values = struct.unpack_from(f">{n_keys}H", data, values_at)
    text = data[text_at : text_at + 2 * n_text].decode("utf-16-be", "surrogatepass")
    units = text.encode("utf-16-be", "surrogatepass")
    out = {}
    for key, value in zip(keys, values, strict=True):
        size = (key >> 24) + 1
        raw = struct.pack(">H", value) if size == 1 else units[2 * value : 2 * (value + size)]
        out[chr(key & 0xFFFFFF)] = raw.decode("utf-16-be", "surrogatepass")
    return out


@lru_cache(1)
def letters() -> dict[str, str]:
    """Letters of the SCRIPTS with the prototype of an ASCII letter of their case, each with that letter."""
    found = prototypes()
    plain = [chr(c) for c in range(0x41, 0x7B) if chr(c).isalpha()]
    by = {(found.get(a, a), a.isupper()): a for a in plain}
    out = {}
    for c in found:
        name = unicodedata.name(c, "")
        if not c.isascii() and name.startswith(SCRIPTS):
            upper = name.startswith(UPPER_ONLY) or c.isupper()
            if a := by.get((found[c], upper)):
                out[c] = a
    return out
