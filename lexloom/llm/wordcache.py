"""Per-chunk results with a bounded memory: real text repeats its words, so each distinct word of a task is worked on once."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class ChunkCache:
    """Maps chunks to values; `fill` gets the list of unseen chunks and returns their values in order.

    There are two generations of about `most` entries each: when the younger is full it becomes the older one, and what is still asked for
    moves over. So the memory does not follow the corpus, and frequent chunks are not worked on again.
    """

    def __init__(self, fill: Callable[[list], Iterable], most: int = 60_000):
        self.fill, self.most, self.known, self.old = fill, most, {}, {}

    def forget(self) -> None:
        self.known, self.old = {}, {}

    def get(self, wanted: set) -> dict:
        """A dictionary that holds every wanted chunk."""
        missing = [x for x in wanted if x not in self.known]
        if missing:
            if len(self.known) + len(missing) > self.most:
                self.old, self.known = self.known, {x: self.known[x] for x in wanted if x in self.known}
            old = self.old
            new = []
            for x in missing:
                if x in old:
                    self.known[x] = old[x]
                else:
                    new.append(x)
            self.known.update(zip(new, self.fill(new), strict=True))
        return self.known
