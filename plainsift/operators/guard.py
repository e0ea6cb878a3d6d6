"""Signatures of a tool: byte runs that all its outputs share, that no input has, and that no declared mark explains.

`shared_runs` sorts all suffixes of the outputs, by doubling ranks, and reads from the common prefixes of neighbours how far
every place of the first output agrees with some place of each other one. `explained` covers a run with the declared marks
and looks at what stays uncovered. `tool_verdicts` does so per tool, in one group per tool: a tool's trial is a few files by
its nature.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MIN_RUN = 4


class Suffixes:
    """All suffixes of several byte strings in order, with the length of the prefix each shares with the one before."""

    def __init__(self, blobs: Sequence[bytes]):
        self.starts = np.cumsum([0, *[len(b) + 1 for b in blobs]])
        text = np.zeros(int(self.starts[-1]), np.int64)
        for n, (blob, at) in enumerate(zip(blobs, self.starts, strict=False)):
            text[at : at + len(blob)] = np.frombuffer(blob, np.uint8).astype(np.int64) + len(blobs)
            text[at + len(blob)] = n  # an end of its own, so no common prefix goes over it
        self.order, self.rank = self._sorted(text)
        self.common = self._common(text)
        self.owner = np.searchsorted(self.starts, self.order, "right") - 1

    @staticmethod
    def _sorted(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        width = 1
        while True:
            after = np.full(len(text), -1, np.int64)
            after[: max(0, len(text) - width)] = rank[width:]
            key = rank * (len(text) + 1) + after + 1
            order = np.argsort(key, kind="stable")
            rank = np.empty_like(rank)
            rank[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            if rank[order[-1]] == len(text) - 1:
                return order, rank
            width *= 2

    def _common(self, text: np.ndarray) -> np.ndarray:
        chars, order, rank = text.tolist(), self.order.tolist(), self.rank.tolist()
        common, same = np.zeros(len(chars), np.int64), 0
        for at, place in enumerate(rank):
            if not place:
                same = 0
                continue
            other = order[place - 1]
            while at + same < len(chars) and other + same < len(chars) and chars[at + same] == chars[other + same]:
                same += 1
            common[place] = same
            same = max(0, same - 1)
        return common

    def reach(self) -> np.ndarray:
        """Of each place of the first string, the longest run from there that every string holds."""
        least = np.full(len(self.order), np.iinfo(np.int64).max)
        for blob in range(1, len(self.starts) - 1):
            best = np.zeros(len(self.order), np.int64)
            for places, ahead in ((range(len(self.order)), 0), (range(len(self.order) - 1, -1, -1), 1)):
                near = 0  # what the current suffix shares with the nearest one of this blob, on this side
                for place in places:
                    edge = place + ahead
                    near = min(near, self.common[edge]) if edge < len(self.common) else 0
                    if self.owner[place] == blob:
                        near = np.iinfo(np.int64).max
                    elif near > best[place]:
                        best[place] = near
            least = np.minimum(least, best)
        return least[self.rank[: self.starts[1] - 1]]

    def occurrences(self, at: int, size: int) -> Iterator[int]:
        """The places of the first string that begin with its `size` bytes from `at`."""
        place = int(self.rank[at])
        low = place
        while low > 0 and self.common[low] >= size:
            low -= 1
        high = place + 1
        while high < len(self.order) and self.common[high] >= size:
            high += 1
        return (int(self.order[p]) for p in range(low, high) if self.owner[p] == 0)


def shared_runs(blobs: Sequence[bytes], size: int = MIN_RUN) -> list[bytes]:
    """The runs of at least `size` bytes that lie in every blob and in no longer such run, the longest first."""
    if not blobs:
        return []
    first, *others = sorted(set(blobs), key=len)
    if not others:
        return [first] if len(first) >= size else []
    suffixes = Suffixes([first, *others])
    reach = suffixes.reach()
    found, seen = [], set()
    for at in np.flatnonzero(reach >= size).tolist():
        length = int(reach[at])
        if at and reach[at - 1] > length:
            continue  # the run began a place earlier
        run = first[at : at + length]
        if run in seen:
            continue
        seen.add(run)
        if all(reach[p] == length and not (p and reach[p - 1] > length) for p in suffixes.occurrences(at, length)):
            found.append(run)
    return sorted(found, key=lambda r: (-len(r), r))


def _places(mark: bytes, run: bytes) -> Iterator[int]:
    at = run.find(mark)
    while at >= 0:
        yield at
        at = run.find(mark, at + 1)


def uncovered(run: bytes, marks: Sequence[bytes], size: int = MIN_RUN) -> list[bytes]:
    """What no mark covers of a run. A mark of one byte is a filling: it covers `size` or more of itself in a row, and what
    there is of it beside other marks or at the ends."""
    covered = np.zeros(len(run), bool)
    filling = np.isin(np.frombuffer(run, np.uint8), [m[0] for m in marks if len(m) == 1])
    for mark in marks:
        wide = mark if len(mark) > 1 else mark * size
        for at in _places(wide, run) if mark else ():
            covered[at : at + len(wide)] = True
    out = []
    edges = np.flatnonzero(np.diff(np.concatenate(([True], covered, [True])).astype(np.int8)))
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        solid = np.flatnonzero(~filling[start:end])
        if len(solid):
            out.append(run[start + int(solid[0]) : start + int(solid[-1]) + 1])
    return out


def explained(run: bytes, constants: Sequence[bytes], inputs: Sequence[bytes], size: int = MIN_RUN) -> bool:
    """Whether marks cover a part of the run and all that they leave is too short to tell or stands in an input."""
    left = uncovered(run, constants, size)
    return sum(map(len, left)) < len(run) and all(len(p) < size or any(p in i for i in inputs) for p in left)


def signatures(outputs: Sequence[bytes], inputs: Sequence[bytes], constants: Sequence[bytes] = (), size: int = MIN_RUN) -> list[bytes]:
    """The runs that only the tool can have brought in, the longest first."""
    known = [*inputs, *constants]
    return [r for r in shared_runs(outputs, size) if not any(r in k for k in known) and not explained(r, constants, inputs, size)]


def tool_verdicts(trials: DataFrame, constants: Sequence[bytes] = ()) -> DataFrame:
    """`tool, verdict, signature` from `tool, input, output` (binaries): fail with the longest signature, or pass."""
    marks = list(constants)

    def run(trial: pd.DataFrame) -> pd.DataFrame:
        found = signatures([bytes(x) for x in trial["output"]], [bytes(x) for x in trial["input"]], marks)
        return pd.DataFrame({"tool": [trial["tool"].iloc[0]], "verdict": ["fail" if found else "pass"], "signature": [found[0].decode("latin-1") if found else None]})

    known = trials.where("output is not null and input is not null").select("tool", "input", "output")
    return known.groupBy("tool").applyInPandas(run, "tool string, verdict string, signature string")
