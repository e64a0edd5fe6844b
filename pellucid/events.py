"""What a run does, as a sequence of events that adds up."""

from __future__ import annotations

import contextvars
import threading
import time
from collections import Counter
from collections.abc import Callable
from typing import Any, TypeVar

T = TypeVar("T")
#: The log and the number of the check that this thread works on.
_current: contextvars.ContextVar[tuple[EventLog, int] | None] = contextvars.ContextVar("check", default=None)
ENDS = ("run_finished", "run_faulted")


class EventLog:
    """Numbers events from 1, in the order in which they come, from any thread; sink gets each of them."""

    def __init__(self, run_id: str, sink: Callable[[dict], Any] | None = None):
        self.run_id, self.sink, self.events, self.lock = run_id, sink, [], threading.Lock()

    def emit(self, kind: str, **fields) -> None:
        with self.lock:
            event = {"sequence": len(self.events) + 1, "run_id": self.run_id, "kind": kind, **fields}
            self.events.append(event)
            if self.sink is not None:
                self.sink(event)

    def queries(self, check: int | None = None) -> list[dict]:
        return [e for e in self.events if e["kind"] == "query_finished" and check in (None, e["check"])]

    def start(self, check: int) -> contextvars.Token:
        return _current.set((self, check))

    def processed(self, check: int, token: contextvars.Token, result: dict) -> None:
        _current.reset(token)
        own = self.queries(check)
        self.emit("check_processed", check=check, id=result["id"], verdict=result["verdict"], skip_reason=result["skip_reason"], queries=len(own), query_ms=sum(e["ms"] for e in own))


def timed(run: Callable[[], T]) -> T:
    """Runs a query; if a check of a logged run asks it, how long it took is an event."""
    at, began = _current.get(), time.monotonic()
    try:
        return run()
    finally:
        if at is not None:
            at[0].emit("query_finished", check=at[1], ms=round(1000 * (time.monotonic() - began)))


def reconcile(events: list[dict], results: dict | None = None) -> None:
    """Raises ValueError with all that does not add up: order, one run, one end, each check once with its own queries, sums.

    results: the stored run, whose id and verdicts must be those of the events.
    """
    wrong = []
    if results is not None:
        if {e["run_id"] for e in events} - {results["run"]["id"]}:
            wrong.append("events of another run than the results")
        told = [(e["id"], e["verdict"], e["skip_reason"]) for e in sorted((e for e in events if e["kind"] == "check_processed"), key=lambda e: e["check"])]
        if told != [(c["id"], c["verdict"], c["skip_reason"]) for c in results["checks"]]:
            wrong.append("the results have other verdicts than the events")
    if [e["sequence"] for e in events] != list(range(1, len(events) + 1)):
        wrong.append("the sequence has gaps")
    if len({e["run_id"] for e in events}) > 1:
        wrong.append("events of several runs")
    kinds = Counter(e["kind"] for e in events)
    if not events or events[0]["kind"] != "run_started" or kinds["run_started"] > 1:
        raise ValueError("; ".join([*wrong, "a run begins once, first of all"]))
    if kinds["probe_finished"] > 1:
        wrong.append("more than one probe")
    selected, done, asked_, ms = events[0]["selected"], {}, Counter(), Counter()
    for e in events:
        if e["kind"] in ("query_finished", "check_processed") and not 1 <= e["check"] <= selected:
            wrong.append(f"event {e['sequence']} names no selected check")
        elif e["kind"] == "query_finished":
            asked_[e["check"]] += 1
            ms[e["check"]] += e["ms"]
            if e["check"] in done:
                wrong.append(f"a query of check {e['check']} after its end")
        elif e["kind"] == "check_processed":
            if e["check"] in done:
                wrong.append(f"check {e['check']} ends twice")
            if (e["queries"], e["query_ms"]) != (asked_[e["check"]], ms[e["check"]]):
                wrong.append(f"check {e['check']} does not have the queries that it counts")
            done[e["check"]] = e
    if sum(kinds[k] for k in ENDS) != 1 or events[-1]["kind"] not in ENDS:
        wrong.append("a run ends once, last of all")
    elif len(done) != selected:
        wrong.append(f"{len(done)} of {selected} checks have ended")
    if events[-1]["kind"] == "run_finished":
        end, verdicts = events[-1], Counter(e["verdict"] for e in done.values())
        if (end["queries"], end["query_ms"]) != (sum(asked_.values()), sum(ms.values())) or end["verdicts"] != dict(verdicts):
            wrong.append("the end's sums are not those of the checks")
    if wrong:
        raise ValueError("; ".join(wrong))
