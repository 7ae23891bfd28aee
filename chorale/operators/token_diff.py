"""Token diff of an original and a changed text, and what it says about protected spans.

Tokens are runs of letters, runs of digits and single signs, compared without case.  A longest common subsequence aligns the two sides; it is
computed bit by bit, a row of the table in one integer, in blocks of bounded size: larger tables are halved at the best split, so the
alignment stays a longest one whatever the length of the texts.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from chorale.functions.text import as_col
from chorale.operators.protect import EXACT, spans_in

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
#: Bits of the table of one block.
BLOCK_BITS = 1 << 27
#: Signs whose insertion counts, and signs that make the form of an identifier.
PUNCTUATION, STRUCTURE = frozenset(".,!?;:()[]{}\"'-"), frozenset("-_./")


def rows_of(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Rows 1 to len(a) of the table; a zero bit at j says that row's length grows at b[j]."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def last_row(a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    """Lengths of the common subsequences of all of ``a`` and every beginning of ``b``."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def aligned(a: Sequence[int], b: Sequence[int], limit: int | None = None) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence."""
    limit = BLOCK_BITS if limit is None else limit
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) > limit and a1 - a0 > 1:
            middle = (a0 + a1) // 2
            total = last_row(a[a0:middle], b[b0:b1]) + last_row(a[middle:a1][::-1], b[b0:b1][::-1])[::-1]
            cut = b0 + int(np.argmax(total))
            todo += [(a0, middle, b0, cut), (middle, a1, cut, b1)]
            continue
        rows = rows_of(a[a0:a1], b[b0:b1])
        i, j = a1 - a0, b1 - b0
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.append((a0 + i, b0 + j))
    return sorted(out)


class Diff:
    """Tokens of both texts and which of them belong together."""

    def __init__(self, original: str, changed: str):
        self.original, self.changed = original, changed
        self.left, self.right = ([m.span() for m in TOKEN.finditer(t)] for t in (original, changed))
        number: dict[str, int] = {}
        a, b = ([number.setdefault(t[x:y].casefold(), len(number)) for x, y in spans] for t, spans in ((original, self.left), (changed, self.right)))
        self.pairs = aligned(a, b)

    def counts(self) -> dict[str, int]:
        met = {i for i, _ in self.pairs}, {j for _, j in self.pairs}
        lost, new = ([t[x:y] for k, (x, y) in enumerate(s) if k not in m] for t, s, m in ((self.original, self.left, met[0]), (self.changed, self.right, met[1])))
        signs = lambda ts: sum(not (t[0].isalnum()) for t in ts)
        case = sum(self.original[slice(*self.left[i])] != self.changed[slice(*self.right[j])] for i, j in self.pairs)
        spacing = sum((self.left[i][1] == self.left[i + 1][0]) != (self.right[j][1] == self.right[j + 1][0]) for (i, j), (k, m) in zip(self.pairs, self.pairs[1:]) if (k, m) == (i + 1, j + 1))
        return {"tokens": len(self.left), "kept": len(self.pairs), "removed": len(lost) - signs(lost), "added": len(new) - signs(new), "signs_removed": signs(lost), "signs_added": signs(new), "case_changed": case, "spacing_changed": spacing}

    def violations(self) -> list[tuple[int, str, str, str | None, str, str]]:
        """start, category, token, found, check, severity for every protected span that did not come through."""
        left, right = (np.array([x[k] for x in self.pairs], np.int64) for k in (0, 1))
        starts = np.array([s for s, _ in self.left], np.int64)
        out = []
        for start, end, category, *_ in spans_in(self.original):
            token = self.original[start:end]
            first, last = int(np.searchsorted(starts, start)), int(np.searchsorted(starts, end)) - 1
            lo, hi = int(np.searchsorted(left, first)), int(np.searchsorted(left, last, side="right"))  # pairs inside the span
            # where the span's edge has no partner, what stands up to the neighbouring pair may be what became of it
            a = self.right[right[lo]][0] if lo < hi and left[lo] == first else self.right[right[lo - 1]][1] if lo else 0
            b = self.right[right[hi - 1]][1] if lo < hi and left[hi - 1] == last else self.right[right[hi]][0] if hi < len(right) else len(self.changed)
            found = self.changed[a:b].strip()
            if lo == hi and core(found) != core(token):
                out.append((start, category, token, None, "removed", "critical"))
                continue
            if category in EXACT:
                checks = [("exact", "critical")] if found != token else []
            else:
                checks = [(name, severity) for name, check in CHECKS.items() if (severity := check(token, found))]
            out += [(start, category, token, found, name, severity) for name, severity in checks]
        return out


def core(text: str) -> str:
    """Letters and digits alone, without case."""
    return "".join(c for c in text.casefold() if c.isalnum())


def inserted_signs(token: str, found: str) -> str | None:
    bare = lambda t: "".join(c for c in t if c not in PUNCTUATION)
    signs = lambda t: [c for c in t if c in PUNCTUATION]
    return "moderate" if bare(token) == bare(found) and len(signs(found)) > len(signs(token)) and set(signs(found)) - set(signs(token)) else None


def changed_spaces(token: str, found: str) -> str | None:
    if token.count(" ") != found.count(" "):
        return "moderate"
    return "minor" if token.split() != found.split() and "".join(token.split()) == "".join(found.split()) else None


def changed_case(token: str, found: str) -> str | None:
    if token == found or token.lower() != found.lower():
        return None
    return "critical" if any(c.isdigit() for c in token) and any(c.isalpha() for c in token) else "moderate"


def changed_structure(token: str, found: str) -> str | None:
    return "critical" if [c for c in token if c in STRUCTURE] != [c for c in found if c in STRUCTURE] else None


CHECKS: dict[str, Callable[[str, str], str | None]] = {"punctuation": inserted_signs, "spacing": changed_spaces, "case": changed_case, "structure": changed_structure}
COUNTS = ["tokens", "kept", "removed", "added", "signs_removed", "signs_added", "case_changed", "spacing_changed"]


def token_diff(pairs: DataFrame, original: str = "original", changed: str = "normalized") -> DataFrame:
    """``pairs`` with the counts of the diff; a null text is empty."""

    @F.pandas_udf(f"struct<{', '.join(f'{c}:int' for c in COUNTS)}>")
    def count(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([Diff(x or "", y or "").counts() for x, y in zip(a, b, strict=True)], columns=COUNTS)

    return pairs.withColumn("_d", count(as_col(original), as_col(changed))).select(*pairs.columns, "_d.*")


def protection_checks(pairs: DataFrame, keys: list[str], original: str = "original", changed: str = "normalized") -> DataFrame:
    """One row for every check that a protected span of the original fails in the changed text."""

    @F.pandas_udf("array<struct<start:int,category:string,token:string,found:string,check:string,severity:string>>")
    def check(a: pd.Series, b: pd.Series) -> pd.Series:
        names = ("start", "category", "token", "found", "check", "severity")
        return pd.Series([[dict(zip(names, v, strict=True)) for v in (Diff(x or "", y or "").violations() if spans_in(x) else ())] for x, y in zip(a, b, strict=True)])

    return pairs.select(*keys, F.inline(check(as_col(original), as_col(changed))))
