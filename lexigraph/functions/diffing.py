"""Line diffs: longest common subsequence, hunks with context, unified text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beyond these a diff counts all lines as changed.
MAX_LINES, MAX_CELLS = 4_000, 1_000_000


def split_lines(text: str) -> list[str]:
    lines = text.replace("\r\n", "\n").split("\n")
    return lines[:-1] if len(lines) > 1 and not lines[-1] else lines


def common_ends(a: list[str], b: list[str]) -> tuple[int, int]:
    """How many lines the two begin with and end with alike."""
    most = min(len(a), len(b))
    head = next((i for i in range(most) if a[i] != b[i]), most)
    tail = next((i for i in range(most - head) if a[-1 - i] != b[-1 - i]), most - head)
    return head, tail


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Longest common subsequence of every pair of suffixes."""
    names = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([names[x] for x in b], np.int64)
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        below = table[i + 1]
        # A row's value is the largest of the one below and, leftwards, of matches: a running maximum.
        take = np.where(y == names[a[i]], below[1:] + 1, below[:-1])
        table[i, :-1] = np.maximum.accumulate(take[::-1])[::-1]
    return table


def _edits(a: list[str], b: list[str]):
    table, i, j = _lengths(a, b), 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            yield " ", i, j
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and table[i + 1, j] >= table[i, j + 1]:
            yield "-", i, None
            i += 1
        else:
            yield "+", None, j
            j += 1


def diff(before: str, after: str, context: int = 3) -> dict:
    a, b = split_lines(before), split_lines(after)
    if a == b:
        return {"added": 0, "removed": 0, "identical": True, "truncated": False, "hunks": []}
    head, tail = common_ends(a, b)
    cells = (len(a) - head - tail + 1) * (len(b) - head - tail + 1)
    if max(len(a), len(b)) > MAX_LINES or cells > MAX_CELLS:
        return {"added": len(b), "removed": len(a), "identical": False, "truncated": True, "hunks": []}
    lines = [(" ", a[i], i + 1, i + 1) for i in range(head)]
    for op, i, j in _edits(a[head : len(a) - tail], b[head : len(b) - tail]):
        text = b[head + j] if i is None else a[head + i]
        lines.append((op, text, None if i is None else head + i + 1, None if j is None else head + j + 1))
    lines += [(" ", a[len(a) - k], len(a) - k + 1, len(b) - k + 1) for k in range(tail, 0, -1)]
    spans: list[list[int]] = []
    for at in (k for k, line in enumerate(lines) if line[0] != " "):
        if spans and at - context <= spans[-1][1] + 1:
            spans[-1][1] = min(len(lines) - 1, at + context)
        else:
            spans.append([max(0, at - context), min(len(lines) - 1, at + context)])
    hunks = []
    for lo, hi in spans:
        part = lines[lo : hi + 1]
        old, new = [x[2] for x in part if x[2]], [x[3] for x in part if x[3]]
        hunks.append({"before_start": (old or [0])[0], "before_count": len(old), "after_start": (new or [0])[0], "after_count": len(new), "lines": [{"op": x[0], "text": x[1]} for x in part]})
    return {"added": sum(x[0] == "+" for x in lines), "removed": sum(x[0] == "-" for x in lines), "identical": False, "truncated": False, "hunks": hunks}


def unified(found: dict) -> str:
    out = []
    for h in found["hunks"]:
        out.append(f"@@ -{h['before_start']},{h['before_count']} +{h['after_start']},{h['after_count']} @@")
        out += [line["op"] + line["text"] for line in h["lines"]]
    return "\n".join(out)


DIFF = "struct<added:int,removed:int,identical:boolean,truncated:boolean,hunks:array<struct<before_start:int,before_count:int,after_start:int,after_count:int,lines:array<struct<op:string,text:string>>>>,unified:string>"


def diffs(before: Column, after: Column, context: int = 3) -> Column:
    @F.pandas_udf(DIFF)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [diff(x or "", y or "", context) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame([r | {"unified": unified(r)} for r in rows], columns=["added", "removed", "identical", "truncated", "hunks", "unified"])

    return run(before, after)
