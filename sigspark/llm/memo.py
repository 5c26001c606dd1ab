"""Token ids of text units that repeat: each distinct unit is encoded once and then looked up."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import compress
from operator import not_


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for reference cycles meanwhile: it would walk through all the small objects again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Memo:
    """Encoded units as bytes of little-endian 32-bit ids.

    At most `limit` units stay; what a call needs beyond that is dropped after it. The result does not
    depend on the limit, memory does.
    """

    def __init__(self, encode_many: Callable[[list], list[bytes]], limit: int = 700_000) -> None:
        self.encode_many, self.limit, self.known = encode_many, limit, {}

    def encode(self, documents: Iterable[list]) -> list[bytes]:
        with uncollected():
            return self._encode(documents)

    def _encode(self, documents: Iterable[list]) -> list[bytes]:
        get, held, fresh = self.known.get, [], set()
        for units in documents:
            ids = list(map(get, units))
            gaps = list(compress(range(len(ids)), map(not_, ids)))  # a unit without ids is asked for each time
            words = [units[i] for i in gaps]
            fresh.update(words)
            held.append((ids, gaps, words))
        order = list(fresh)
        late = dict(zip(order, self.encode_many(order), strict=True))
        out = []
        for ids, gaps, words in held:
            for i, word in zip(gaps, words, strict=True):
                ids[i] = late[word]
            out.append(b"".join(ids))
        room = max(0, self.limit - len(self.known))
        self.known.update(late if room >= len(late) else {unit: late[unit] for unit in order[:room]})
        return out


def grouped(texts: list[bytes], size: int = 4_000_000) -> Iterable[list[bytes]]:
    """Runs of texts of about `size` bytes."""
    group, total = [], 0
    for text in texts:
        group.append(text)
        total += len(text)
        if total >= size:
            yield group
            group, total = [], 0
    if group:
        yield group
