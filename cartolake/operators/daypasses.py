"""Day plans of many requests over the same candidates at once: what `dayplan.one_pass` and `dayplan.passes` give each of them alone.

A step fills one slot of all requests, in arrays of requests by candidates. What hangs on place, clock, weather, interests and
limits is worked out once for the requests that agree in them; budgets, places used and pulls are each request's own. Sums are made as
Python makes them, distances are those of one request alone, and what lies too close to be told in arrays is scored one by one, so that
the plans are the same to the last digit.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from cartolake.operators import dayplan as D


class Total:
    """Sums of floats by element, as Python's sum() makes them: with the digits that an addition loses kept apart."""

    def __init__(self, like: np.ndarray):
        self.sum, self.lost = np.zeros_like(like), np.zeros_like(like)

    def add(self, x: np.ndarray, where: np.ndarray) -> None:
        t = self.sum + x
        lost = np.where(np.abs(self.sum) >= np.abs(x), (self.sum - t) + x, (x - t) + self.sum)
        self.sum, self.lost = np.where(where, t, self.sum), np.where(where, self.lost + lost, self.lost)

    def value(self) -> np.ndarray:
        return self.sum + self.lost


@dataclass
class Passed:
    """Plans as arrays of requests by slots: the candidate (-1: none), when it is reached, minutes walked and metres."""

    chosen: np.ndarray
    arrival: np.ndarray
    walk: np.ndarray
    metres: np.ndarray

    @property
    def made(self) -> np.ndarray:
        return self.chosen >= 0

    def path(self) -> np.ndarray:
        total = Total(np.zeros(len(self.chosen)))
        for i in range(self.chosen.shape[1]):
            total.add(self.metres[:, i], self.made[:, i])
        return total.value()

    def put(self, rows: np.ndarray, other: Passed, of: np.ndarray) -> None:
        for mine, its in ((self.chosen, other.chosen), (self.arrival, other.arrival), (self.walk, other.walk), (self.metres, other.metres)):
            mine[rows] = its[of]


def coded(keys: list) -> tuple[list, np.ndarray]:
    """The distinct keys and, for each key, its place among them."""
    places: dict = {}
    codes = np.array([places.setdefault(k, len(places)) for k in keys], np.int64)
    return list(places), codes


class Days:
    """Requests and their candidates."""

    def __init__(self, requests: list[D.Request], candidates: list[dict]):
        self.requests, self.f = requests, D.Field.of(candidates)
        f, n = self.f, len(requests)
        self.order = np.argsort(f.id, kind="stable")  # of equals the smallest id comes first
        ids, self.id_code = np.unique(f.id, return_inverse=True)
        of_id = {int(k): c for c, k in enumerate(ids)}
        _, self.alike = coded([(p["category"], p["cost"], p["rating"], p["lat"], p["lon"], bool(p.get("indoor")), tuple(p.get("tags") or ()), p.get("opens"), p.get("closes")) for p in f])
        self.meets = np.array([[any(t in (p.get("tags") or ()) for t in kinds) for kinds in f.kinds] for p in f], np.int64).reshape(len(f), len(f.kinds))
        # Points: the candidates, then the starts.
        starts, start = coded([r.start for r in requests])
        self.points = [(p["lat"], p["lon"]) for p in f] + starts
        self.at = np.array(self.points, np.float64).reshape(-1, 2)
        self.start = start + len(f)
        self.far, self.known = np.zeros((len(self.points), len(f))), np.zeros(len(self.points), bool)
        # Requests that agree in weather, interests and limits are of one mode.
        hours, self.sky = {}, []
        for r in requests:
            self.sky.append(hours.setdefault(id(r.hours), r.hours))
        seen: dict = {}
        by_id = {k: seen.setdefault(h, len(seen)) for k, h in hours.items()}
        modes, self.mode = coded([(by_id[id(r.hours)], r.wet, r.interests, r.leg, r.end) for r in requests])
        first = np.full(len(modes), -1)
        first[self.mode[::-1]] = np.arange(n)[::-1]
        self.modes = [requests[k] for k in first]
        self.leg = np.array([r.leg for r in requests], np.float64)
        self.clock, self.budget = np.array([r.clock for r in requests], np.int64), np.array([r.budget for r in requests], np.float64)
        self.excluded = [[of_id[x] for x in r.excluded if x in of_id] for r in requests]
        # Slots without what is pinned, and for each request and slot which one it is and the candidate's id that is pinned.
        self.width = max((len(r.slots) for r in requests), default=0)
        self.slot, self.pin = np.full((n, self.width), -1), np.full((n, self.width), -1)
        self.pins = np.zeros(n, bool)
        kinds: dict = {}
        of_slots: dict = {}
        for k, r in enumerate(requests):
            if id(r.slots) not in of_slots:
                of_slots[id(r.slots)] = (
                    [kinds.setdefault((s.kind, s.target, s.stay, s.categories, s.share), len(kinds)) for s in r.slots],
                    [-1 if s.pinned is None else of_id.get(s.pinned, -1) for s in r.slots],
                    any(s.pinned is not None for s in r.slots),
                )
            codes, pinned, self.pins[k] = of_slots[id(r.slots)]
            self.slot[k, : len(codes)], self.pin[k, : len(codes)] = codes, pinned
        self.slots = [D.Slot(*k) for k in kinds]
        self.share = np.array([s.share for s in self.slots], np.float64)

    def away(self, here: np.ndarray) -> np.ndarray:
        """Metres from points to all candidates."""
        for k in here[~self.known[here]]:
            self.far[k], self.known[k] = self.f.far(self.points[k]), True
        return self.far[here]

    def one_pass(self, rows: np.ndarray, anchors: np.ndarray | None = None, weight: float = 0) -> Passed:
        """A pass for the requests of these numbers; anchors: a point for each of them and slot, not a number where nothing pulls."""
        n, f = len(rows), self.f
        shape = (n, self.width)
        out = Passed(np.full(shape, -1), np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape))
        if not len(f):
            return out
        here, clock, left = self.start[rows].copy(), self.clock[rows].copy(), self.budget[rows].copy()
        used = np.zeros((n, self.id_code.max() + 1), bool)
        for k, r in enumerate(rows):
            used[k, self.excluded[r]] = True
        count = np.zeros((n, len(f.kinds)), np.int64)
        slot = self.slot[rows]
        share = np.where(slot >= 0, self.share[slot], 0.0)
        total = Total(np.zeros(n))
        for i in range(self.width):
            total.add(share[:, i], slot[:, i] >= 0)
        shares = total.value()
        for i in range(self.width):
            with np.errstate(divide="ignore", invalid="ignore"):
                allowance = np.where(shares > 0, left * share[:, i] / shares, left)
            shares = shares - share[:, i]
            for code in np.unique(slot[slot[:, i] >= 0, i]):
                k = np.nonzero(slot[:, i] == code)[0]
                pull = anchors[k, i] if anchors is not None else None
                cand, arrival = self._fill(rows[k], i, self.slots[code], here[k], clock[k], left[k], allowance[k], used[k], count[k], pull, weight, out.chosen[k, :i])
                k, cand, arrival = k[cand >= 0], cand[cand >= 0], arrival[cand >= 0]
                far = self.far[here[k], cand]
                out.chosen[k, i], out.arrival[k, i], out.metres[k, i] = cand, arrival, far
                out.walk[k, i] = np.ceil(far * D.DETOUR / D.WALK_PER_MINUTE)
                used[k, self.id_code[cand]] = True
                count[k] += self.meets[cand]
                here[k], clock[k], left[k] = cand, arrival + self.slots[code].stay, left[k] - f.spent[cand]
        return out

    def _fill(self, rows, i, slot, here, clock, left, allowance, used, count, pull, weight, day) -> tuple[np.ndarray, np.ndarray]:
        """`dayplan.fill` for one slot of some requests: the candidate of each (-1: none) and when it is reached."""
        f, n = self.f, len(rows)
        pin = self.pin[rows, i]
        serves = f.serves(slot.categories)
        wanted = serves.copy()
        if (pinned := pin >= 0).any():
            wanted |= np.isin(self.id_code, pin[pinned])
        cols = self.order[wanted[self.order]]
        none = np.full(n, -1), np.zeros(n, np.int64)
        if not len(cols):
            return none
        # Once for all that are at one place at one time in one mode.
        long = int(clock.max()) + 1
        keys, of = np.unique((self.mode[rows] * len(self.points) + here) * long + clock, return_inverse=True)
        at_clock, at_point, at_mode = keys % long, keys // long % len(self.points), keys // long // len(self.points)
        far = self.away(at_point)[:, cols]
        leg = np.array([r.leg for r in self.modes], np.float64)[at_mode][:, None]
        end = np.array([r.end for r in self.modes], np.float64)[at_mode][:, None]
        arrival = at_clock[:, None] + np.ceil(far * D.DETOUR / D.WALK_PER_MINUTE).astype(np.int64)
        if slot.target is not None:
            today = slot.target + at_clock // 1440 * 1440
            now, then = at_clock - today <= D.UPCOMING, today + 1440 - at_clock <= D.UPCOMING
            earliest = (np.where(now, today, today + 1440) - (D.MEAL_EARLY if slot.meal else D.OTHER_EARLY))[:, None]
            waited = np.maximum(arrival, np.minimum(earliest, arrival + D.LONGEST_WAIT) if slot.flexible else earliest)
            arrival = np.where((now | then)[:, None], waited, arrival)
        arrival = -(-arrival // 5) * 5
        leaves = arrival + slot.stay
        opens, closes = f.opens[cols], f.closes[cols]
        possible = (leaves <= end) & (far <= D.FARTHER * leg)
        possible &= f.always[cols] | ((opens - 1440 <= arrival) & (leaves <= closes - 1440)) | ((opens <= arrival) & (leaves <= closes))
        hour, mode = arrival // 60 % 24, at_mode[:, None]
        wet, windy, hot, cold = (np.array([r.by_hour[c] for r in self.modes])[mode, hour] for c in range(4))
        indoor = f.indoor[cols]
        outside = np.where(wet, D.WET, np.where(windy, np.where(f.sea[cols], D.SEA_WIND, D.WIND), np.where(hot, D.HEAT, np.where(cold, D.COLD, 0))))
        worth = 20 * f.rating[cols] - 25 * far / D.LEG + np.where(indoor, np.where(wet | windy | hot | cold, D.ROOF, 0), outside)
        rained = wet & ~indoor
        if slot.kind == "SIGHTSEEING":
            worth += np.where(np.array([f.liked(r.interests)[cols] for r in self.modes])[at_mode] & ~rained, 12, 0)
        near = np.where(far <= leg, np.int8(1), np.int8(2))
        # Each request's own.
        ok, tier = possible[of] & ~used[:, self.id_code[cols]], near[of]
        tier[~(f.spent[cols] <= left[:, None])] = 3
        if pinned.any():
            kept = (self.id_code[cols] == pin[:, None]) & ~rained[of]
            tier[kept] = 0
            ok &= serves[cols] | kept
        elif not serves[cols].all():
            ok &= serves[cols]
        tier[~ok] = 9
        best = tier.min(axis=1)
        some = best < 9
        if not some.any():
            return none
        cost = f.cost[cols]
        with np.errstate(invalid="ignore"):
            price = np.where(cost <= allowance[:, None], 10 - cost * (10 / np.maximum(1.0, allowance))[:, None], -20.0)
        price[:, np.isnan(cost)] = -4.0
        nearly = worth[of] + price
        if slot.kind == "SIGHTSEEING" and count.any():
            nearly += D.AGAIN * count[:, f.kind[cols]]
        if pull is not None and (pulled := ~np.isnan(pull[:, 0])).any():
            points, which = np.unique(np.where(pulled[:, None], pull, 0.0), axis=0, return_inverse=True)
            y, x = np.radians(f.lat[cols] - points[:, :1]), np.radians(f.lon[cols] - points[:, 1:])
            h = np.sin(y / 2) ** 2 + np.cos(np.radians(points[:, :1])) * np.cos(np.radians(f.lat[cols])) * np.sin(x / 2) ** 2
            off = 2 * 6_371_000.0 * np.arcsin(np.minimum(1.0, np.sqrt(h)))
            nearly -= np.where(pulled, weight / self.leg[rows], 0.0)[:, None] * off[which.reshape(-1)]
        nearly[tier != best[:, None]] = -np.inf
        close = nearly >= nearly.max(axis=1)[:, None] - D.CLOSE
        close &= some[:, None]
        found = close.argmax(axis=1)
        # Of places alike in all but their ids the first is taken; others within CLOSE are scored one by one.
        alike = self.alike[cols]
        unlike = np.nonzero(np.where(close, alike, len(f)).min(axis=1) < np.where(close, alike, -1).max(axis=1))[0]
        for k in unlike:
            m, top, seen = self.modes[self.mode[rows[k]]], None, set()
            day_ = [f[c] for c in day[k] if c >= 0]
            anchor = tuple(pull[k].tolist()) if pull is not None and not np.isnan(pull[k, 0]) else None
            for c in np.nonzero(close[k])[0]:
                if alike[c] in seen:
                    continue
                seen.add(alike[c])
                place = f[cols[c]]
                key = (round(D.score(slot, place, float(far[of[k], c]), float(allowance[k]), m, anchor, weight, int(arrival[of[k], c]), day_), 4), -place["place_id"])
                if top is None or key > top[0]:
                    top = (key, c)
            found[k] = top[1]
        return np.where(some, cols[found], -1), arrival[of, found]

    def better(self, rows: np.ndarray, a: Passed, b: Passed) -> np.ndarray:
        """`dayplan.is_better` for each request."""
        stops = a.made.sum(axis=1), b.made.sum(axis=1)
        liking = np.array([self.f.liked(r.interests) for r in self.modes])[self.mode[rows]]
        liked = [(np.take_along_axis(liking, np.maximum(p.chosen, 0), axis=1) & p.made).sum(axis=1) for p in (a, b)]
        more = (stops[0] > stops[1]) | ((stops[0] == stops[1]) & (liked[0] > liked[1]))
        return more | ((stops[0] == stops[1]) & (liked[0] == liked[1]) & (a.path() + D.LEAST_SAVING < b.path()))

    def ahead(self, p: Passed) -> np.ndarray:
        """For each stop but the last the middle of the stops after it."""
        n, width = p.chosen.shape
        out, made, at = np.full((n, width, 2), np.nan), p.made, self.at[p.chosen]
        for i in range(width):
            total = Total(np.zeros((n, 2)))
            for j in range(i + 1, width):
                total.add(at[:, j], made[:, j, None])
            later = made[:, i + 1 :].sum(axis=1)
            pulls = made[:, i] & (later > 0)
            out[pulls, i] = total.value()[pulls] / later[pulls, None]
        return out

    def between(self, rows: np.ndarray, p: Passed) -> np.ndarray:
        """For each stop the middle of the stop before it, or the start, and the one after it."""
        n, width = p.chosen.shape
        made, at = p.made, self.at[p.chosen]
        before, after = np.zeros((n, width, 2)), np.full((n, width, 2), np.nan)
        line = self.at[self.start[rows]].copy()
        for i in range(width):
            before[:, i] = line
            line = np.where(made[:, i, None], at[:, i], line)
        line = np.full((n, 2), np.nan)
        for i in reversed(range(width)):
            after[:, i] = line
            line = np.where(made[:, i, None], at[:, i], line)
        return np.where(made[:, :, None], np.where(np.isnan(after), before, (before + after) / 2), np.nan)

    def greedy(self) -> Passed:
        return self.one_pass(np.arange(len(self.requests)))

    def passes(self) -> Passed:
        """`dayplan.passes` for each request."""
        rows = np.arange(len(self.requests))
        pull = np.repeat(np.where(self.pins[:, None], np.nan, self.at[self.start])[:, None, :], self.width, axis=1)
        plan = self.one_pass(rows, pull, D.START_PULL)
        going = rows[~self.pins & (plan.made.sum(axis=1) >= 3)]
        for n in range(1 + D.BETWEEN_ROUNDS):
            if not len(going):
                break
            now = Passed(plan.chosen[going], plan.arrival[going], plan.walk[going], plan.metres[going])
            found = self.one_pass(going, self.between(going, now) if n else self.ahead(now), D.LOOK_AHEAD)
            better = self.better(going, found, now)
            plan.put(going[better], found, better)
            going = going[better] if n else going  # a round that is no better is the last
        return plan

    def plans(self, p: Passed) -> list[D.Plan]:
        """The same as plans of stops."""
        out = []
        for r, chosen, arrival, walk, far in zip(self.requests, p.chosen.tolist(), p.arrival.tolist(), p.walk.tolist(), p.metres.tolist(), strict=True):
            out.append(D.Plan([D.Stop(i, r.slots[i], self.f[c], arrival[i], walk[i], far[i]) for i, c in enumerate(chosen) if c >= 0]))
        return out

    def same(self, p: Passed) -> list[tuple]:
        """Keys that agree for requests of one mode, start, clock and slots with the same stops at the same times."""
        given = np.column_stack([self.mode, self.start, self.clock, self.slot, self.pin, p.chosen, p.arrival])
        return list(map(tuple, given.tolist()))
