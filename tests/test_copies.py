"""Queries over pairs, on tables that repeat the same places: equal rows are worked out once, and the results are those of the SQL."""

import importlib

import duckdb
import pytest

from cartolake.plans import catalog
from cartolake.sources.tables import BASE

COPIES = {"part": ("p_partkey", 2000), "supplier": ("s_suppkey", 100)}
TIMES = 8
#: Query, module, and the operator whose pairs must not grow with copies.
CASES = (
    ("jn_google_match", "joins", "within"),
    ("jn_dedupe_verified", "more", "within"),
    ("jn_nearest_within", "joins", "within"),
    ("topk_best_sight", "ranking", "within"),
    ("geo_polygon_distance_holes", "geometry", "expanded"),
    ("jn_cross_bbox", "joins", "expanded"),
    ("jn_exists_spatial", "more", "within"),
    ("jn_radius_self", "joins", "within"),
    ("jn_fuzzy_match", "joins", "near_and_alike"),
    ("pl_template_find", "templates", "within"),
)
#: Greedy queries, whose rivals must not grow with copies.
GREEDY = ("er_dedupe_self", "er_match_confirm_add", "pl_clusters", "pl_itinerary", "pl_popular_routes")


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """The tables once, and with each place and district several times under ids that end alike."""
    made = {}
    for times in (1, TIMES):
        at = tmp_path_factory.mktemp(f"x{times}")
        for t in BASE:
            source = f"SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'"
            if t in COPIES:
                key, step = COPIES[t]
                source = f"SELECT a.* REPLACE (a.{key} + {step} * k AS {key}) FROM ({source}) a CROSS JOIN range({times}) r(k)"
            duckdb.execute(f"COPY ({source}) TO '{at}/{t}.parquet' (FORMAT parquet)")
        made[times] = str(at)
    return made


@pytest.mark.parametrize("name, module, operator", CASES, ids=[c[0] for c in CASES])
def test_copies_are_worked_out_once(spark, monkeypatch, folders, name, module, operator):
    home = importlib.import_module(f"cartolake.plans.{module}")
    real, pairs = getattr(home, operator), []

    def counted(*args, **more):
        found = real(*args, **more)
        pairs[-1] += (args[0] if operator == "expanded" else found).count()
        return found

    monkeypatch.setattr(home, operator, counted)
    for times, at in folders.items():
        pairs.append(0)
        con = duckdb.connect()
        for t in BASE:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
        found = catalog.queries()[name](spark, at)
        assert sorted(map(tuple, found.collect())) == sorted(con.execute(catalog.oracle_sql()[name]).fetchall())
    assert pairs[1] <= 3 * pairs[0]


@pytest.mark.parametrize("name", GREEDY)
def test_rivals_do_not_grow_with_copies(spark, monkeypatch, folders, name):
    from cartolake.operators import greedy

    real, rivals = greedy.first_come, []

    def counted(ids, pairs):
        rivals.append(pairs.count())
        return real(ids, pairs)

    monkeypatch.setattr(greedy, "first_come", counted)
    for at in folders.values():
        catalog.queries()[name](spark, at).count()
    once, copied = rivals  # one pass for each folder
    assert copied <= 3 * max(once, 10)


@pytest.mark.parametrize("name", ["pl_start_resolve", "src_pageviews", "er_area_match", "agg_geom_union_overlap"])
def test_copies_against_sql(spark, folders, name):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folders[TIMES]}/{t}.parquet'")
    found = catalog.queries()[name](spark, folders[TIMES])
    assert sorted(map(tuple, found.collect()), key=str) == sorted(con.execute(catalog.oracle_sql()[name]).fetchall(), key=str)


def test_name_rules_are_whole():
    """Every kind of reason that names were judged by is in the tables and in the SQL."""
    from cartolake.plans import classify

    assert {r.outcome for r in classify.NAMES} == {"no name", "generic name", "institution", "school", "another business", "livestock market", "not a sight"}
    assert all(word in catalog.oracle_sql()[q] for q in ("er_realism_element", "er_realism_name") for word in ("yemekhane", "fakulte", "jandarma", "otopark"))


def test_sentence_patterns_match_as_in_sql(spark):
    """Marked letters in either case, and ends of words next to marked letters."""
    from pyspark.sql import functions as F

    from cartolake.plans import classify

    texts = ["Çis was", "éis x", "isé x", "gitmiŞtir", "mıŞtır aa", "A\x0bis", "x yaptıĞı yer", "x yaptığı\x0byer", " ÇĞmaktadır"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    for pattern in (classify.EVENT, classify.VERB):
        wanted = [duckdb.execute(f"SELECT regexp_matches(?, '{pattern}')", [x]).fetchone()[0] for x in texts]
        assert [r[0] for r in rows.select(F.rlike("x", F.lit(classify.as_re2(pattern)))).collect()] == wanted
