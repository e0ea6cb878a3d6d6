"""Signatures of tools."""

from hypothesis import given, settings
from hypothesis import strategies as st

from plainsift.operators import guard


def brute(blobs, size):
    base = min(blobs, key=len)
    runs = {base[i:j] for i in range(len(base)) for j in range(i + size, len(base) + 1) if all(base[i:j] in b for b in blobs)}
    return {r for r in runs if not any(r != o and r in o for o in runs)}


@settings(max_examples=600, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=24).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=4))
def test_shared_runs_against_brute_force(blobs):
    assert set(guard.shared_runs(blobs, 3)) == brute(blobs, 3)


def test_long_run_of_one_byte():
    blobs = [bytes(200_000) + b"a", b"b" + bytes(200_000)]
    assert guard.shared_runs(blobs) == [bytes(200_000)]


def test_marks_explain():
    assert guard.explained(b"\0\0\0\0name", [b"\0"], [b"a name b"])
    assert not guard.explained(b"\0\0\0\0tool-1", [b"\0"], [b"a name b"])
    assert not guard.explained(b"tool-1", [], [b""])


def test_verdicts(spark):
    rows = [("clean", b"alpha", b"alpha"), ("clean", b"beta!", b"beta!"), ("tagged", b"alpha", b"alpha tag-7"), ("tagged", b"beta!", b"beta! tag-7"), ("tagged", None, b"x")]
    got = guard.tool_verdicts(spark.createDataFrame(rows, "tool string, input binary, output binary")).collect()
    assert {r["tool"]: (r["verdict"], r["signature"]) for r in got} == {"clean": ("pass", None), "tagged": ("fail", " tag-7")}
