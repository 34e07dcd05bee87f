"""Plans of many requests at once are those of each request alone."""

import random
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from cartolake.operators import dayplan as D
from cartolake.operators.daypasses import Days
from cartolake.operators.relational import first_per
from cartolake.plans import resolution
from cartolake.sources.tables import BASE, Tables
from tests.test_dayplan import SF, skies, town


def asked(seed, n=30):
    """Requests from two points under three skies, with budgets, clocks, limits and interests of their own."""
    r = random.Random(seed)
    hours = [skies(seed + k) for k in range(3)]
    return [
        D.Request(r.choice([(41.0, 29.0), (41.005, 28.99)]), r.uniform(100, 3000), interests=r.choice([("sea",), ("art",), ()]), hours=r.choice(hours), clock=r.choice([540, 700, 1290]), end=r.choice([1380, 1700, 2100]), wet=r.random() < 0.2)
        for _ in range(n)
    ]


def copied(places, times):
    return [{**p, "place_id": p["place_id"] + 1000 * k} for k in range(times) for p in places]


@pytest.mark.parametrize("seed", range(8))
def test_many_as_one_by_one(seed):
    """Stops, times and metres to the last digit, also after edits with pinned stops and with copies of places."""
    places = D.Field(copied(town(seed, (5, 40, 120, 200)[seed % 4]), 1 + seed % 3))
    days = Days(asked(seed), places)
    made = days.passes()
    plans = days.plans(made)
    assert [p.stops for p in plans] == [D.passes(r, places).stops for r in days.requests]
    assert [p.stops for p in days.plans(days.greedy())] == [D.one_pass(r, places).stops for r in days.requests]
    edits = [D.edited(D.EDITS[k % len(D.EDITS)], p, r, chosen=k, interest="old") for k, (p, r) in enumerate(zip(plans, days.requests, strict=True))]
    again = Days(edits, places)
    assert [p.stops for p in again.plans(again.passes())] == [D.passes(r, places).stops for r in edits]
    assert any(p.stops for p in plans)


def test_odd_requests():
    """No budget known, no slots, no candidates, a pinned place that is not there."""
    nan, none, lost = D.Request((41.0, 29.0), float("nan")), D.Request((41.0, 29.0), 900.0, slots=()), D.Request((41.0, 29.0), 900.0, slots=(replace(D.SLOTS[0], pinned=-5), D.SLOTS[1]))
    for places in (D.Field(town(1)), D.Field([])):
        days = Days([nan, none, lost], places)
        assert [p.stops for p in days.plans(days.passes())] == [D.passes(r, places).stops for r in days.requests]
    assert not Days([], D.Field(town(1))).passes().made.any()


def test_copies_of_places_are_not_scored_one_by_one(monkeypatch):
    """Candidates that are alike in all but their ids are told apart by id alone, however many requests there are."""
    scored, real = [], D.score
    monkeypatch.setattr(D, "score", lambda *a: scored.append(1) or real(*a))
    places, requests = D.Field(copied(town(2, 60), 10)), [D.Request((41.0, 29.0), 500.0 + k, interests=("sea",)) for k in range(200)]
    days = Days(requests, places)
    plans = days.plans(days.passes())
    assert len(scored) < len(requests) and [p.stops for p in plans[:5]] == [D.passes(r, places).stops for r in requests[:5]]


def test_orders_are_shared_by_equal_plans():
    """Requests that differ in budget alone and get the same stops have one key, and one better order."""
    places, requests = D.Field(town(4)), [D.Request((41.0, 29.0), 5000.0 + k, interests=("sea",)) for k in range(100)]
    days = Days([*requests, replace(requests[0], end=1700)], places)
    made = days.passes()
    keys, orders = days.same(made), {}
    for key, plan, request in zip(keys, days.plans(made), days.requests, strict=True):
        stops = D.reordered(plan, request).stops
        assert orders.setdefault(key, stops) == stops
    assert len(set(keys[:-1])) < 20 and keys[-1] not in keys[:-1]


def test_weather_of():
    assert D.weather_of("01") == ((0, D.FAIR), (1, D.Weather(wet=True))) and D.weather_of("e")[0][1] == D.Weather(False, True, True, True) and D.weather_of(None) == D.weather_of("") == ()


def test_places_at_one_point_are_cut_before_they_meet_starts(spark, monkeypatch, tmp_path):
    """Of 60 copies of each place no more meet a start than a group takes, and the group is the same as with all of them."""
    for t in BASE:
        copies = "SELECT a.* REPLACE (a.p_partkey + 2000 * k AS p_partkey) FROM (%s) a CROSS JOIN range(60) r(k)" if t == "part" else "%s"
        duckdb.execute(f"COPY ({copies % f"SELECT * FROM '{SF}/{t}.parquet'"}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    met = []
    monkeypatch.setattr(D, "plan_days", lambda requests, near, how, by: met.append(near))
    resolution.days(Tables(spark, str(tmp_path)), "passes")
    monkeypatch.setattr(resolution, "first_per", lambda df, *_: df)
    resolution.days(Tables(spark, str(tmp_path)), "passes")
    most = [n.groupBy("start", "lat", "lon", "category").count().agg(F.max("count")).first()[0] for n in met]
    assert most[0] == D.NEAREST < most[1]
    groups = [sorted(map(str, first_per(n, ["start", "category"], [F.col("metres"), F.col("place_id")], D.NEAREST).collect())) for n in met]
    assert groups[0] == groups[1]
