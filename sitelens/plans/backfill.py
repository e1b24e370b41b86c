"""A backfill with a deadline (T5): windows in chunks, as many as the time that is left allows, and the rest given back."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from sitelens.plans.identity import identity
from sitelens.plans.matrix import by_name, run
from sitelens.plans.windows import Scheduled, Span
from sitelens.sources.stores import SummaryStore


@dataclass(frozen=True)
class Progress:
    computed: tuple[Span, ...]
    #: What another run goes on with.
    rest: tuple[Span, ...]
    chunks: int


def lacking(store: SummaryStore, scheduled: Sequence[Scheduled], spans: Sequence[Span]) -> list[Span]:
    """The windows that some scheduled question has no answer of, oldest first; answers to other narrowings are none."""
    open_: set[Span] = set()
    for name, own in by_name(scheduled).items():
        asked = identity(own[0].question, own[0].request)
        wanted = [w for w in spans if w.granularity in {s.granularity for s in own}]
        have = {Span(e["start"], e["granularity"]) for e in store.entries(name, wanted) if e["digest"] == asked["digest"] and e["limit"] == asked["limit"]}
        open_ |= set(wanted) - have
    return sorted(open_)


def backfill(
    log: DataFrame, store: SummaryStore, scheduled: Sequence[Scheduled], spans: Sequence[Span], computed_at: Column, seconds: float,
    first: int = 24, reserve: float = 30.0, clock: Callable[[], float] = time.monotonic,
) -> Progress:
    """Compute what the store lacks of ``spans`` until the deadline nears.

    A chunk is one job for all questions. The first has ``first`` windows; each later one as many as should take half of the time that is left, by the pace of the slowest so
    far, at least one and at most four times as many as the last. No chunk begins once less is left than ``reserve`` or than twice what a chunk as small as the smallest took;
    the first one always runs, so every run gets on.
    """
    deadline = clock() + seconds
    due = lacking(store, scheduled, spans)
    done, size, pace, overhead, chunks = 0, first, 0.0, float("inf"), 0
    while done < len(due):
        left = deadline - clock()
        if chunks:
            if left < max(reserve, 2 * overhead):
                break
            size = max(1, min(4 * size, int(left / 2 / max(pace, 1e-9))))
        begun = clock()
        chunk = due[done : done + size]
        run(log, store, scheduled, chunk, computed_at)
        took = clock() - begun
        pace, overhead = max(pace, took / len(chunk)), min(overhead, took)
        done, chunks = done + len(chunk), chunks + 1
    return Progress(tuple(due[:done]), tuple(due[done:]), chunks)
