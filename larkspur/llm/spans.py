"""Spans of kinds in texts: how they are listed, counted and hashed, and which ranges are taken."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Span = tuple[str, int, int]


def ordered(spans: Iterable[Span], kinds: list[str]) -> list[Span]:
    """By start, then by kind as listed."""
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


class Taken:
    """The ranges of a text that are taken, in order and merged, so that each question takes a binary search."""

    def __init__(self, spans: Iterable[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted((a, b) for _, a, b in spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, start: int, end: int) -> bool:
        """Whether the range meets none of those taken."""
        k = bisect_right(self.starts, start)
        return (not k or self.ends[k - 1] <= start) and (k == len(self.starts) or self.starts[k] >= end)

    def take(self, start: int, end: int) -> bool:
        """Take a range if it is free."""
        if not self.free(start, end):
            return False
        k = bisect_right(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        return True


def digest(text: str) -> Column:
    return F.sha2(F.encode(F.col(text), "utf-8"), 256)
