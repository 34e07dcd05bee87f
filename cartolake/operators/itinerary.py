"""A day through one group of sights: the best that are open, in the shortest order in which each is open on arrival, with meals."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from cartolake.operators.greedy import metres

#: When the day starts and until when a sight may be entered to count as open that day, sights and minutes walked between them.
DAY_START, OPEN_UNTIL, EVERY = 570, 1020, 30
LEAST, MOST, LONGEST_WALK = 3, 5, 60
DETOUR, WALK_PER_MINUTE = 1.3, 75
#: Minutes to a meal, when meals are due, how long after lunch coffee is, and how long they take.
TO_MEAL, LUNCH_FROM, DESSERT_FROM, DINNER_FROM, COFFEE_AFTER = 5, 720, 960, 1110, 90
STAY = {"LUNCH": 60, "COFFEE": 45, "DESSERT": 30, "DINNER": 75}


@dataclass(frozen=True)
class Sight:
    """open: spans of the day in minutes, those that touch being one; None where hours are not known."""

    place_id: int
    at: tuple[float, float]
    minutes: int
    open: tuple[tuple[int, int], ...] | None = None

    def is_open(self, arrival: int) -> bool:
        start = arrival % 1440
        return self.open is None or any(o <= start and start + self.minutes <= c for o, c in self.open)


@dataclass(frozen=True)
class Item:
    """A sight, or a meal where that is None."""

    kind: str
    sight: Sight | None
    arrival: int


def rounded(minutes: int) -> int:
    return math.ceil(minutes / 5) * 5


def walk(a: Sight, b: Sight) -> int:
    return math.ceil(metres(a.at, b.at) * DETOUR / WALK_PER_MINUTE)


@functools.cache
def orders(n: int) -> tuple[tuple[int, ...], ...]:
    """All orders of n, by exchanges from the front; of orders that walk as long the first counts."""

    def exchanged(order: list[int], k: int):
        if k == n:
            yield tuple(order)
        for i in range(k, n):
            order[k], order[i] = order[i], order[k]
            yield from exchanged(order, k + 1)
            order[k], order[i] = order[i], order[k]

    return tuple(exchanged(list(range(n)), 0))


def walked(order: list[Sight]) -> list[Item] | None:
    """The sights in this order from the day's start, with meals as the clock advances; None where one is closed on arrival."""
    items: list[Item] = []
    clock, lunch, coffee = DAY_START, None, False

    def meal(kind: str, not_before: int = 0) -> int:
        items.append(Item(kind, None, rounded(max(clock + TO_MEAL, not_before))))
        return items[-1].arrival + STAY[kind]

    for n, sight in enumerate(order):
        if n:
            if lunch is None and clock >= LUNCH_FROM:
                clock = lunch = meal("LUNCH", LUNCH_FROM)
            elif lunch is not None and not coffee and clock >= lunch + COFFEE_AFTER:
                clock, coffee = meal("COFFEE"), True
        arrival = rounded(clock + (walk(order[n - 1], sight) if n else 0))
        if not sight.is_open(arrival):
            return None
        items.append(Item("SIGHTSEEING", sight, arrival))
        clock = arrival + sight.minutes
    if lunch is None:
        clock = meal("LUNCH", LUNCH_FROM)
    if not coffee:
        clock = meal("DESSERT" if clock >= DESSERT_FROM else "COFFEE")
    if clock >= DINNER_FROM:
        meal("DINNER", DINNER_FROM)
    return items


def itinerary(sights: list[Sight]) -> list[Item]:
    """The day of these sights, the best first, all open at some time; the last is dropped until an order is open and not too long. Empty where none is."""
    chosen = sights[:MOST]
    while len(chosen) >= LEAST:
        legs = [[walk(a, b) for b in chosen] for a in chosen]
        best = None
        for order in orders(len(chosen)):
            length = sum(legs[a][b] for a, b in zip(order, order[1:]))
            if length <= LONGEST_WALK and (best is None or length < best[0]) and (items := walked([chosen[k] for k in order])) is not None:
                best = length, items
        if best is not None:
            return best[1]
        chosen = chosen[:-1]
    return []
