"""Token ids of text pieces, worked out once per worker and looked up afterwards."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Hashable, Iterable, Sequence
from itertools import chain

import numpy as np

LIMIT = 500_000  # pieces a worker remembers, of one table at a time; then it starts anew, which changes no result


class Pieces(dict):
    """piece -> row of a table of ids. ``encode`` gives the ids of a piece that is not in it yet.

    A worker lives longer than an operator: the table that is used next makes the one before forget.
    """

    in_use: Pieces | None = None

    def __init__(self, encode: Callable[[Hashable], Sequence[int]]):
        super().__init__()
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids, self.ends = array("I"), array("q", [0])

    def __missing__(self, piece: Hashable) -> int:
        self.ids.extend(self.encode(piece))
        self.ends.append(len(self.ids))
        self[piece] = row = len(self.ends) - 2
        return row

    def documents(self, pieces: list[Sequence[Hashable]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents in a row, and each document's number of ids."""
        if Pieces.in_use is not self:
            if Pieces.in_use is not None:
                Pieces.in_use.forget()
            Pieces.in_use = self
        if len(self) > LIMIT:
            self.forget()
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        rows = np.fromiter(map(self.__getitem__, chain.from_iterable(pieces)), np.int64, int(n.sum()))
        table, ends = np.frombuffer(self.ids, np.uint32), np.frombuffer(self.ends, np.int64)
        starts, lengths = ends[rows], ends[rows + 1] - ends[rows]
        upto = np.concatenate(([0], np.cumsum(lengths)))
        ids = table[np.arange(upto[-1]) + np.repeat(starts - upto[:-1], lengths)]
        bounds = upto[np.concatenate(([0], np.cumsum(n)))]
        return ids, np.diff(bounds)


def slices(texts: Iterable[str | None], chars: int = 1_000_000) -> Iterable[list[str]]:
    """Runs of texts of about so many characters (one longer text is a run of its own); null is empty."""
    run, held = [], 0
    for text in texts:
        text = text or ""
        if run and held + len(text) > chars:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run
