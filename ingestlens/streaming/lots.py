"""Keys of a stateful stream in lots: rows that wait, file names and the timer of a lot, a call of the state for many rows."""

from __future__ import annotations

from operator import itemgetter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys are dealt to so many lots, each a key of the state; a micro-batch is held by the lot.
LOTS = 512
#: Rows that wait are kept in pieces of at most so many, of one stretch of time from ``FEW`` rows on, so that a timer reads and writes few that are not due.
PIECE_ROWS, FEW, STRETCH = 500, 32, 60_000_000


def lot_of(key: Column, lots: int = LOTS) -> Column:
    """The lot of a key, as text."""
    return F.pmod(F.xxhash64(key), F.lit(lots)).cast("string")


def reached(at: int) -> int:
    """The first watermark (milliseconds) that is not before a time in microseconds; Spark drops rows up to the watermark."""
    return -(-at // 1000)


def as_tuples(rows, names: list[str]) -> list[tuple]:
    """The fields ``names`` of each row, looked up once."""
    rows, out, take = iter(rows), [], None
    for r in rows:
        take = take or itemgetter(*map(r.__fields__.index, names))
        out.append(take(r))
    return out


def wake(handle, due: list[int]) -> None:
    """The one timer, at the earliest of ``due`` (milliseconds)."""
    for at in list(handle.listTimers()):
        handle.deleteTimer(at)
    if due:
        handle.registerTimer(min(due))


class Waiting:
    """Rows ``(id, at, ...)`` that wait for the watermark, in a map state of pieces by their first row's time and id."""

    def __init__(self, state):
        self.state = state

    def keep(self, rows: list[tuple]) -> None:
        """Adds rows in new pieces; nothing that waits already is read."""
        piece: list[tuple] = []
        for r in sorted(rows, key=lambda r: (r[1], r[0])):
            if len(piece) >= PIECE_ROWS or (len(piece) >= FEW and r[1] // STRETCH != piece[0][1] // STRETCH):
                self._write(piece)
                piece = []
            piece.append(r)
        if piece:
            self._write(piece)

    def _write(self, piece: list[tuple]) -> None:
        # Rows of one time and id, sent twice, may begin several pieces.
        nth, (first_id, at, *_) = 0, piece[0]
        while self.state.containsKey((at, first_id, nth)):
            nth += 1
        self.state.updateValue((at, first_id, nth), (piece,))

    def due(self, now: int) -> tuple[list[tuple], list[int]]:
        """The rows up to ``now`` in order of time and id, which wait no more, and times that the others begin with."""
        due, later, firsts = [], [], []
        for piece in [tuple(k) for k in self.state.keys()] if self.state.exists() else []:
            if piece[0] > now:
                firsts.append(piece[0])
                continue
            for r in map(tuple, self.state.getValue(piece)[0]):
                (due if r[1] <= now else later).append(r)
            self.state.removeKey(piece)
        self.keep(later)
        due.sort(key=lambda r: (r[1], r[0]))
        return due, firsts + [r[1] for r in later]


class Names:
    """The names that an owner (a batch) has: those of earlier calls are asked for one by one, new ones kept here until :meth:`save`.

    ``parts`` counts the saved stretches of names, by which they are found when the owner is over.
    """

    def __init__(self, names, parts, owner: tuple, saved: int = 0, count: int = 0):
        self.names, self.parts, self.owner, self.saved, self.count, self.new = names, parts, owner, saved, count, {}

    def __contains__(self, name) -> bool:
        return name in self.new or (self.saved > 0 and self.names.containsKey((*self.owner, name)))

    def __setitem__(self, name, value) -> None:
        self.new[name] = value
        self.count += 1

    def __len__(self) -> int:
        return self.count

    def save(self) -> int:
        if self.new:
            for name, value in self.new.items():
                self.names.updateValue((*self.owner, name), (value,))
            self.parts.updateValue((*self.owner, self.saved), (list(self.new),))
            self.saved, self.new = self.saved + 1, {}
        return self.saved

    def forget(self) -> None:
        """Drops what was saved; the owner is over."""
        for k in range(self.saved):
            for name in self.parts.getValue((*self.owner, k))[0]:
                self.names.removeKey((*self.owner, name))
            self.parts.removeKey((*self.owner, k))
        self.saved, self.new = 0, {}
