"""Which questions are answered: a fold in which each verdict depends on those before it.

A question passes three gates in turn. A conversation that has had its turns takes no more (`limit`); then its code's requests of the
hour are counted, refused ones too (`rate`); then its code's spending of the day, and that of all codes, must be below their
limits (`budget`). Only an answered question spends; one that is refused for its budget is still a turn of its conversation, one
that is refused before is none and, at the first gate, is no request either.

Turns and requests thus depend on each other, so they are folded: rows are dealt out by code, sorted by time in their partition, and read as a
stream that holds the counters of one code and the turns of its conversations, never a code's rows. A code's questions
are a chain by nature. What all codes spend is no chain of codes: costs are not negative, so once a day's limit is
reached all that follows in the day is refused, and the running sum over what the codes' own gates let through, taken by ranges
(`windows.running`), decides.

Nulls: a null code or conversation is one code or conversation; a null cost is 0; rows of a null time come first. Rows of equal time are ordered by tie.
Rows that repeat are questions each. Other columns are kept, but for one called out, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import DAY, DOLLARS_PER_DAY, DOLLARS_PER_DAY_ALL, HOUR, REQUESTS_PER_HOUR, running

#: Fixed value: turns of a conversation.
MAX_TURNS = 40
ANSWERED, LIMIT, RATE, BUDGET = "answered", "limit", "rate", "budget"


class Gates:
    """The counters of one code."""

    def __init__(self, turns: int, requests: int, dollars: float):
        self.most = turns, requests, dollars
        self.turns: dict = {}
        self.hour = self.day = None
        self.requests, self.spent = 0, 0.0

    def verdict(self, conversation, second: int, cost: float) -> str:
        turns, requests, dollars = self.most
        if self.turns.get(conversation, 0) >= turns:
            return LIMIT
        if (hour := second // HOUR) != self.hour:
            self.hour, self.requests = hour, 0
        self.requests += 1
        if self.requests > requests:
            return RATE
        self.turns[conversation] = self.turns.get(conversation, 0) + 1
        if (day := second // DAY) != self.day:
            self.day, self.spent = day, 0.0
        if self.spent >= dollars:
            return BUDGET
        self.spent += cost
        return ANSWERED


def _folded(limits: tuple[int, int, float], columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gates, code = None, None
        for batch in batches:
            given = dict(zip(batch.schema.names, batch.columns, strict=True))
            out = []
            for own, *rest in zip(*(given[c].to_pylist() for c in ("_code", "_conversation", "_second", "_cost")), strict=True):
                if gates is None or own != code:
                    gates, code = Gates(*limits), own
                out.append(gates.verdict(*rest))
            yield pa.RecordBatch.from_arrays([*(given[c] for c in columns), pa.array(out, pa.string())], [*columns, "_own"])

    return run


def gated(questions: DataFrame, *, code: str = "code", conversation: str = "session_id", at: str = "at", tie: str = "pos", cost: str = "cost_usd", out: str = "outcome", turns: int = MAX_TURNS, requests: int = REQUESTS_PER_HOUR, dollars: float = DOLLARS_PER_DAY, dollars_all: float = DOLLARS_PER_DAY_ALL) -> DataFrame:
    """questions with their outcome: answered, or the gate that refused them."""
    name = lambda c: F.col(f"`{c}`")
    second = F.coalesce(F.unix_timestamp(name(at)), F.lit(0))
    rows = questions.drop(out).withColumns({"_code": name(code).cast("string"), "_conversation": name(conversation).cast("string"), "_second": second, "_cost": F.coalesce(name(cost).cast("double"), F.lit(0.0)), "_tie": name(tie)})
    dealt = rows.repartition("_code").sortWithinPartitions("_code", name(at), "_tie")
    kept = [c for c in rows.columns if c not in ("_code", "_conversation")]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept), "_own string"])
    own = dealt.mapInArrow(_folded((turns, requests, dollars), kept), kinds).withColumn("_at", F.timestamp_seconds("_second"))
    total = running(own, F.when(F.col("_own") == ANSWERED, F.col("_cost")).otherwise(0.0), at="_at", tie="_tie", size=DAY, out="_spent")
    before = F.col("_spent") - F.when(F.col("_own") == ANSWERED, F.col("_cost")).otherwise(0.0)
    outcome = F.when((F.col("_own") == ANSWERED) & (before >= dollars_all), F.lit(BUDGET)).otherwise(F.col("_own"))
    return total.withColumn(out, outcome).select(*questions.drop(out).columns, out)
