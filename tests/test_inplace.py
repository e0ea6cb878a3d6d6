"""Programs, still pictures and metafiles cleaned in their places."""

import random
import struct

import pytest

from plainsift.operators import folder, inplace
from plainsift.sources import containers, fixtures, inner

NOTE = b"a note of more than twenty bytes"
KINDS = ["heic", "metafile", "windows metafile", "built", "dated", "mac"]


@pytest.mark.parametrize("kind", KINDS)
def test_cleaned_once_and_for_all(kind):
    data = fixtures.MAKERS[kind](NOTE)
    row, out = folder.clean_one("x", data)
    assert row["outcome"] == "cleaned", row
    assert NOTE not in out and NOTE[:20] not in out
    again, same = folder.clean_one("x", out)
    assert (again["removed"], same) == (0, out)


@pytest.mark.parametrize("kind", KINDS)
def test_damage_is_never_an_error(kind):
    rng = random.Random(3)
    data = fixtures.MAKERS[kind](NOTE)
    for _ in range(200):
        broken = bytearray(data[: rng.randrange(len(data) + 1)] if rng.random() < 0.3 else data)
        for _ in range(rng.randrange(1, 8)):
            if broken:
                broken[rng.randrange(len(broken))] = rng.randrange(256)
        row, _ = folder.clean_one("x", bytes(broken))
        assert row["outcome"] != "error", row["notes"]


def test_what_runs_stays():
    out = inplace.program(fixtures.built_file(NOTE))
    assert b"code that stays" in out
    before, after = (containers.parts("exe", x) for x in (fixtures.built_file(NOTE), out))
    assert before == after
    assert b"GNU\0" in out


def test_a_checksum_is_made_anew():
    data = fixtures.dated_program(NOTE)
    out = inplace.program(data)
    at = 64 + 24 + 64
    assert struct.unpack_from("<I", out, at)[0] == inner.pe_checksum(out, at) != 1234
    signed = bytearray(data)
    struct.pack_into("<II", signed, 64 + 24 + 112 + 8 * 4, 9, 9)
    with pytest.raises(containers.Malformed, match="signed"):
        inplace.program(bytes(signed))


def test_fat_and_signed_programs():
    one = fixtures.macho_file(NOTE)
    fat = b"\xca\xfe\xba\xbe" + struct.pack(">I", 1) + struct.pack(">IIIII", 0, 0, 64, len(one), 0)
    fat = fat.ljust(64, b"\0") + one
    out = inplace.program(fat)
    assert NOTE not in out and len(out) == len(fat)
    signed = b"\xcf\xfa\xed\xfe" + bytes(12) + struct.pack("<II", 1, 16) + bytes(8) + struct.pack("<IIII", 0x1D, 16, 0, 0)
    with pytest.raises(containers.Malformed, match="signed"):
        inplace.program(signed)


def test_pictures_that_share_bytes_are_refused():
    data = fixtures.still_file(NOTE)
    start = data.index(b"mdat") + 4
    shared = data.replace(struct.pack(">II", start, 1) if False else struct.pack(">HHHIHII", 1, 0, 0, start, 1, 0, 9), struct.pack(">HHHIHII", 1, 0, 0, start, 1, 0, 12))
    with pytest.raises(containers.Malformed, match="shares"):
        inplace.still(shared)


def test_counts_of_metafiles():
    out = inplace.metafile(fixtures.emf_file(NOTE))
    assert struct.unpack_from("<II", out, 48) == (len(out), 2)
    plus = fixtures.emf_file(b"EMF+" + NOTE)
    with pytest.raises(containers.Malformed, match="another kind"):
        inplace.metafile(plus)
    out = inplace.metafile(fixtures.wmf_file(NOTE))
    assert inner.wmf_records(out) == [("020C", "10"), ("0000", "6")]
    assert struct.unpack_from("<I", out, 22 + 6)[0] * 2 == len(out) - 22
