"""Which days each partition of a fact table supplies, where merged partitions and their parts stand side by side."""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterable

Partition = tuple[str, str, str, dt.date]  # site, search type, tier, first day
Days = tuple[dt.date, dt.date]  # first and last
DAY = dt.timedelta(1)


def within(claimed: list[Days], first: dt.date, last: dt.date) -> list[Days]:
    """The parts of ``claimed`` (disjoint, in order) from ``first`` to ``last``, neighbours joined."""
    at = max(0, bisect_right(claimed, (first, dt.date.max)) - 1)
    found: list[Days] = []
    for a, b in claimed[at : bisect_left(claimed, (last, dt.date.max))]:
        a, b = max(a, first), min(b, last)
        if a > b:
            continue
        if found and found[-1][1] + DAY == a:
            found[-1] = (found[-1][0], b)
        else:
            found.append((a, b))
    return found


def shadowed(
    partitions: Iterable[Partition], tiers: tuple[str, ...], end: Callable[[dt.date, str], dt.date], first: dt.date | None = None, last: dt.date | None = None
) -> dict[Partition, list[Days]]:
    """The days that each partition must not supply, as finer ones of its site and search type do.

    A sweep from the finest tier (the first of ``tiers``) to the coarsest: each
    partition claims the days of its span that none before it has. With
    ``first`` and ``last``, spans are cut to that period, so a partition whose
    other days lie outside counts as covered. A partition that supplies
    nothing is given with its whole span; one with another tier stays as it
    is; those that supply all their days are not in the result.
    """
    claimed: dict[tuple[str, str], list[Days]] = {}
    found: dict[Partition, list[Days]] = {}
    ranked = sorted((p for p in set(partitions) if p[2] in tiers), key=lambda p: (tiers.index(p[2]), p))
    for p in ranked:
        a, b = p[3], end(p[3], p[2])
        low, high = max(a, first or a), min(b, last or b)
        if low > high:
            found[p] = [(a, b)]
            continue
        own = claimed.setdefault((p[0], p[1]), [])
        taken = within(own, low, high)
        if taken == [(low, high)]:
            found[p] = [(a, b)]
            continue
        if taken:
            found[p] = taken
        edge = low
        for x, y in [*taken, (high + DAY, high + DAY)]:
            if edge < x:
                insort(own, (edge, x - DAY))
            edge = y + DAY
    return found


def spans(partition: Partition, days: list[Days], end: Callable[[dt.date, str], dt.date]) -> bool:
    """Whether ``days`` are all that a partition holds."""
    return days == [(partition[3], end(partition[3], partition[2]))]
