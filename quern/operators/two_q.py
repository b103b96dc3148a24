"""A simulator of the 2Q replacement policy: pages seen once leave first come first served, before pages seen again, which
leave least recently used first. Spark's block manager does its own replacement; this serves to study traces."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Hashable


class TwoQ:
    def __init__(self) -> None:
        self._once: OrderedDict[Hashable, None] = OrderedDict()
        self._again: OrderedDict[Hashable, None] = OrderedDict()

    def access(self, page: Hashable) -> None:
        if page in self._once:
            del self._once[page]
            self._again[page] = None
        elif page in self._again:
            self._again.move_to_end(page)
        else:
            self._once[page] = None

    def evict(self) -> Hashable:
        queue = self._once or self._again
        if not queue:
            raise LookupError("nothing to evict")
        return queue.popitem(last=False)[0]

    def erase(self, page: Hashable) -> None:
        self._once.pop(page, None)
        self._again.pop(page, None)

    def __len__(self) -> int:
        return len(self._once) + len(self._again)
