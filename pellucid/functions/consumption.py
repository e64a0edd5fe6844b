"""Incremental assertions over rows that are read one after the other."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class Consumption:
    """What the rows that have come decide so far: a row counter, the rows seen, the pinned values still open.

    The same object follows the rows inside a task and, once more, the rows that tasks sent to the driver. What
    it settles further rows cannot change, so whoever holds it may stop.
    """

    def __init__(self, expect, columns: list[str], pinned: Iterable = ()):
        """pinned: what the values of `contains` look like in the rows that are taken."""
        r = expect.rows
        self.least = None if r is None or r.max is not None or r.exactly is not None else r.min
        self.most = None if r is None else min((x for x in (r.max, r.exactly) if x is not None), default=None)
        self.empty, self.unique = expect.empty, expect.unique
        self.open = set(pinned)
        #: Assertions that only the end of the result can meet, and those that fail whatever comes.
        self.to_the_end = expect.equals is not None or expect.unique is True or expect.empty is True or self.most is not None
        self.lost = expect.columns is not None and list(columns) != expect.columns
        self.count, self.repeated = 0, False
        self.seen: set = set()

    def take(self, row, cell) -> bool:
        """Counts a row (its own key and that of its cell); true if nothing more is needed."""
        self.count += 1
        if self.unique is not None and not self.repeated:
            self.repeated = row in self.seen
            self.seen.add(row)
        self.open.discard(cell)
        return self.decided

    @property
    def decided(self) -> bool:
        over = self.most is not None and self.count > self.most
        if self.lost or over or self.empty is True and self.count or self.unique is True and self.repeated:
            return True
        held = not self.open and (self.unique is None or self.repeated) and self.count >= max(self.least or 0, int(self.empty is False))
        return held and not self.to_the_end and self.count > 0


def sieve(rows: Iterable, state: Consumption, most: int) -> Iterator:
    """The rows (with their keys in front) until they decide or `most` have come; no further row is asked for."""
    for n, row in enumerate(rows, 1):
        yield row
        if state.take(row[0], row[1]) or n >= most:
            return
