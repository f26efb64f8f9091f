"""Map states in which keys that lie together share an entry.

Each look at a state is a round trip to the JVM, so one entry for each key makes a large batch slow. An
entry here is a page of up to PAGE keys that differ in the low bits of their last number; the pages last used
are kept, at most MOST of them, and written back when they go or at flush.
"""

from __future__ import annotations

import json
from collections import OrderedDict

VALUES = "page string"
_BITS = 10
#: Keys of a page, and pages kept at a time.
PAGE, MOST = 1 << _BITS, 64


class Pages:
    """A keyed map over a map state whose values are VALUES; the last part of a key is a number."""

    def __init__(self, state: object):
        self.state = state
        self.kept: OrderedDict[tuple, dict[int, tuple]] = OrderedDict()
        self.changed: set[tuple] = set()

    def _page(self, at: tuple) -> dict[int, tuple]:
        page = self.kept.get(at)
        if page is not None:
            self.kept.move_to_end(at)
            return page
        while len(self.kept) >= MOST:
            self._write(*self.kept.popitem(last=False))
        found = self.state.getValue(at)
        page = self.kept[at] = {int(k): tuple(v) for k, v in json.loads(found[0]).items()} if found else {}
        return page

    def _write(self, at: tuple, page: dict[int, tuple]) -> None:
        if at not in self.changed:
            return
        self.changed.discard(at)
        if page:
            self.state.updateValue(at, (json.dumps(page, separators=(",", ":")),))
        else:
            self.state.removeKey(at)

    def getValue(self, key: tuple) -> tuple | None:
        return self._page((*key[:-1], key[-1] >> _BITS)).get(key[-1] & PAGE - 1)

    def updateValue(self, key: tuple, value: tuple) -> None:
        at = (*key[:-1], key[-1] >> _BITS)
        self._page(at)[key[-1] & PAGE - 1] = value
        self.changed.add(at)

    def removeKey(self, key: tuple) -> None:
        at = (*key[:-1], key[-1] >> _BITS)
        if self._page(at).pop(key[-1] & PAGE - 1, None) is not None:
            self.changed.add(at)

    def flush(self) -> None:
        """Write what changed and keep nothing: what comes next may be another group's."""
        while self.kept:
            self._write(*self.kept.popitem(last=False))
