"""Entry points: clean one file, clean a folder, look at the installation, check evidence, and the command line.

Exit codes: 0 done, 1 unexpected, 2 wrong use, 3 unsupported format, 4 not accounted for, 5 level not built, 6 something
left over or still readable, 7 too little memory, 8 a folder's run finished but not every file was written.
"""

from __future__ import annotations

import argparse
import csv
import importlib
import os
import shutil
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plainsift.operators import folder, matching
from plainsift.operators.cleaning import LEVELS
from plainsift.sources import files

OK, UNEXPECTED, USAGE, UNSUPPORTED, STRUCTURE, LEVEL, CONTENT, MEMORY, INCOMPLETE = 0, 1, 2, 3, 4, 5, 6, 7, 8
SHEET_NAME = "scrub-results.csv"
#: How often its size a file is held while it is cleaned.
MEMORY_FACTOR = 5


def exit_code(row: dict) -> int:
    """The exit code of one file's row."""
    outcome = row["outcome"]
    if outcome in folder.WRITTEN or outcome == "dropped":
        return OK
    if outcome == "not supported":
        return UNSUPPORTED
    if outcome == "refused":
        return CONTENT if (row["notes"] or "").startswith("left over") or "disagrees" in (row["independent_check"] or "") else STRUCTURE
    return UNEXPECTED


def _write(path: str, data: bytes) -> None:
    draft = f"{path}.part-{os.getpid()}"
    with open(draft, "wb") as file:
        file.write(data)
    os.replace(draft, path)


def free_memory() -> int | None:
    """The bytes of memory that are free, or None where the system doesn't say."""
    try:
        with open("/proc/meminfo", encoding="ascii") as file:
            return next(int(line.split()[1]) * 1024 for line in file if line.startswith("MemAvailable:"))
    except (OSError, StopIteration, ValueError):
        return None


def clean_file(source: str, target: str, level: str = "F1", keep_unknown: bool = False, check_memory: bool = True, verify: bool = True) -> tuple[int, dict]:
    """Clean one file into target, which is written whole or not at all; gives the exit code and the row. A file that memory
    can't hold MEMORY_FACTOR times is refused, unless check_memory is off; with verify off removed values aren't searched."""
    if level not in ("F1", *LEVELS):
        return LEVEL, {"path": source, "outcome": "refused", "notes": f"level {level} isn't built"}
    size, free = os.path.getsize(source), free_memory() if check_memory else None
    if free is not None and size * MEMORY_FACTOR > free:
        return MEMORY, {"path": source, "outcome": "refused", "notes": f"cleaning takes some {size * MEMORY_FACTOR} bytes of memory, and {free} are free"}
    with open(source, "rb") as file:
        data = file.read()
    row, out = folder.clean_one(os.path.basename(source), data, keep_unknown, level, verify)
    if row["outcome"] == "refused" and "isn't built" in (row["notes"] or ""):
        return LEVEL, row
    if out is not None:
        _write(target, out)
    return exit_code(row), row


def check_layout(source: str, target: str) -> None:
    """ValueError if target is source, lies in it or around it, or isn't an empty place."""
    if not os.path.isdir(source):
        raise ValueError(f"{source} is not a folder")
    a, b = os.path.realpath(source), os.path.realpath(target)
    if os.path.commonpath([a, b]) in (a, b):
        raise ValueError("one folder lies in the other")
    if os.path.exists(target) and (not os.path.isdir(target) or os.listdir(target)):
        raise ValueError(f"{target} is not an empty folder")


def clean_folder(spark: SparkSession, source: str, target: str, keep_unknown: bool = False, verify: bool = True, report: bool = True, progress: Callable[[dict], None] | None = None) -> tuple[int, str | None]:
    """Clean every file below source into the same place below target, which all executors must share, and write the
    sheet unless report is off; gives the exit code and the sheet's path. A file that fails never stops the run. `progress`
    is called with the row of each file, in the order of paths."""
    check_layout(source, target)
    os.makedirs(target, exist_ok=True)
    from plainsift.shared import materialize

    cleaned = materialize(folder.clean_files(files.folder(spark, source), keep_unknown=keep_unknown, verify=verify), "cleaned-folder")
    written = {r["path"] for r in folder.write_cleaned(cleaned.where("cleaned is not null"), target).where("not written").collect()}
    path, n = os.path.join(target, SHEET_NAME), 2
    while os.path.exists(path):
        path, n = os.path.join(target, SHEET_NAME.replace(".csv", f"-{n}.csv")), n + 1
    columns = [c.split()[0] for c in folder.SHEET.split(", ")]
    complete = not written
    draft = f"{path}.part-{os.getpid()}"
    with open(draft, "w", encoding="utf-8-sig", newline="") as file:
        out = csv.writer(file)
        out.writerow(columns)
        for row in folder.sheet(cleaned).toLocalIterator():
            out.writerow(["" if row[c] is None else row[c] for c in columns])
            complete &= row["outcome"] in (*folder.WRITTEN, "dropped")
            if progress is not None:
                progress(row.asDict())
    if report:
        os.replace(draft, path)
    else:
        os.remove(draft)
    return (OK if complete else INCOMPLETE), path if report else None


#: What the engine stands on, and what only parts of it need.
NEEDED = ("pyspark", "pyarrow", "pandas", "numpy", "xxhash")
OPTIONAL = ("regex", "ahocorasick", "tokenizers", "duckdb")


def doctor() -> list[tuple[str, bool, str]]:
    """Name, whether it is there, and version or reason, of what the engine needs; names of optional parts end in `?`."""
    out = [("java", shutil.which("java") is not None or "JAVA_HOME" in os.environ, os.environ.get("JAVA_HOME", shutil.which("java") or "not found"))]
    for name in (*NEEDED, *OPTIONAL):
        label = name + ("?" if name in OPTIONAL else "")
        try:
            out.append((label, True, str(getattr(importlib.import_module(name), "__version__", "unknown"))))
        except ImportError as e:
            out.append((label, False, str(e)))
    return out


def check_evidence(published: DataFrame, measured: DataFrame, on: list[str], value: str) -> tuple[int, DataFrame]:
    """Whether published verdicts hold: an exit code, and the rows of `matching.evidence_diff` that aren't confirmed. A cell that
    wasn't measured counts against them."""
    found = matching.evidence_diff(published, measured, on, value).where("status <> 'confirmed'")
    return (OK if found.isEmpty() else CONTENT), found


def main(argv: list[str] | None = None) -> int:
    """The command line."""
    parser = argparse.ArgumentParser(prog="plainsift", description="Clean a file, or every file of a folder.")
    parser.add_argument("input", help="a file, a folder, or `doctor` alone")
    parser.add_argument("output", nargs="?")
    parser.add_argument("--fidelity", default="F1", choices=("F1", "F2", "F3"))
    parser.add_argument("--keep-unknown-members", action="store_true")
    parser.add_argument("--skip-memory-check", action="store_true")
    parser.add_argument("--no-verify", action="store_true")
    parser.add_argument("--no-report", action="store_true")
    parser.add_argument("--jobs", type=int, default=None, help="tasks at once, for a folder without a cluster")
    args = parser.parse_args(argv)
    if args.input == "doctor" and args.output is None:
        rows = doctor()
        print("\n".join(f"{name}: {'found' if there else 'MISSING'} ({told})" for name, there, told in rows))
        return OK if all(there or name.endswith("?") for name, there, _ in rows) else UNEXPECTED
    if args.output is None or not os.path.exists(args.input):
        print(f"{args.input} does not exist" if args.output else "an output is needed", file=sys.stderr)
        return USAGE
    if os.path.isdir(args.input):
        if args.fidelity != "F1":
            return LEVEL
        made = SparkSession.builder.master(f"local[{args.jobs}]") if args.jobs else SparkSession.builder
        try:
            code, path = clean_folder(made.getOrCreate(), args.input, args.output, args.keep_unknown_members, not args.no_verify, not args.no_report)
        except ValueError as e:
            print(e, file=sys.stderr)
            return USAGE
        print(path or "done")
        return code
    code, row = clean_file(args.input, args.output, args.fidelity, args.keep_unknown_members, not args.skip_memory_check, not args.no_verify)
    if not args.no_report:
        print(f"{row['outcome']}: {row.get('notes') or row.get('removed_fields') or ''}")
    return code


if __name__ == "__main__":
    sys.exit(main())
