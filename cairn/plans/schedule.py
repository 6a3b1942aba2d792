"""Orders of short work lists."""

from __future__ import annotations

from collections.abc import Iterable
from graphlib import CycleError, TopologicalSorter


def schedule(items: Iterable[str], needs: dict[str, Iterable[str]]) -> list[str]:
    """Items with what they need before them, in their given order where that is free; unknown needs are ignored.

    Raises ValueError for a circle.
    """
    given = list(dict.fromkeys(items))
    place = {x: i for i, x in enumerate(given)}
    sorter = TopologicalSorter({x: [n for n in needs.get(x, ()) if n in place] for x in given})
    try:
        sorter.prepare()
    except CycleError as e:
        raise ValueError(f"circle: {' > '.join(e.args[1])}") from e
    out: list[str] = []
    ready = list(sorter.get_ready())
    while ready:
        ready.sort(key=place.__getitem__, reverse=True)
        x = ready.pop()
        out.append(x)
        sorter.done(x)
        ready += sorter.get_ready()
    return out
