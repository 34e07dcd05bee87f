"""Extracts and expiring state against plain versions, with failures."""

import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartolake.sources import extract
from cartolake.sources.files import Files
from cartolake.streaming import expiring

SCHEMA = "id long, version int, lat double, lon double, changed long, tags map<string,string>"


def elements(seed, n):
    r = random.Random(seed)
    tags = lambda: r.choice([None, {}, {"name": "Çay \x00 é𝒳", "a": ""}, {"k": None}, {f"k{r.randint(0, 9)}": "x" * r.randint(0, 300) for _ in range(4)}])
    return [(r.randint(-(2**40), 2**40), r.randint(0, 99), None if r.random() < 0.1 else round(r.uniform(-90, 90), 7), round(r.uniform(-180, 180), 7), r.randint(0, 2**33), tags()) for _ in range(n)]


def rows(df):
    return sorted((tuple(tuple(sorted(x.items(), key=repr)) if isinstance(x, dict) else round(x, 7) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def as_written(data):
    """A point without one coordinate has none."""
    out = []
    for i, v, lat, lon, at, tags in data:
        lat, lon = (None, None) if lat is None or lon is None else (lat, lon)
        out.append((i, v, lat, lon, at, None if tags is None else tuple(sorted(tags.items(), key=repr))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    spark.dataSource.register(extract.ExtractSource)


def test_round_trip(spark, tmp_path):
    data = elements(1, 3000)
    path = f"{tmp_path}/x"
    spark.createDataFrame(data, SCHEMA).repartition(3).write.format("extract").option("block", 70).mode("append").save(path)
    read = spark.read.format("extract").option("split", 20_000).load(path)
    assert read.rdd.getNumPartitions() > 3
    assert rows(read) == as_written(data)
    spark.createDataFrame(data[:5], SCHEMA).write.format("extract").mode("append").save(path)
    assert spark.read.format("extract").option("columns", "id").load(path).count() == 3005
    spark.createDataFrame(data[:7], SCHEMA).write.format("extract").mode("overwrite").save(path)
    assert rows(spark.read.format("extract").load(path)) == as_written(data[:7])
    assert sum(n.startswith("attempt") for n in Files(path).names()) <= 7  # an overwrite drops what it replaces
    spark.createDataFrame([], SCHEMA).write.format("extract").mode("append").save(f"{tmp_path}/empty")
    assert spark.read.format("extract").load(f"{tmp_path}/empty").count() == 0


def test_only_wanted_columns_are_decoded(monkeypatch):
    table = pa.table({"id": [3, 1], "version": pa.array([1, 2], pa.int32()), "lat": [1.0, 2.0], "lon": [1.0, 2.0], "changed": [5, 6], "tags": pa.array([[("a", "b")], None], pa.map_(pa.string(), pa.string()))})
    body = extract.encode(table)[extract.HEAD.size :]
    calls = []
    monkeypatch.setattr(extract, "numbers", lambda raw, f=extract.numbers: calls.append(1) or f(raw))
    assert extract.decode(body, ["id"])["id"].to_pylist() == [3, 1] and len(calls) == 1


def test_failed_and_repeated_tasks(spark, tmp_path):
    path = f"{tmp_path}/x"
    spark.createDataFrame(elements(2, 50), SCHEMA).write.format("extract").mode("append").save(path)
    broken = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"), F.lit(1).alias("version"), *[F.lit(1.0).alias(c) for c in ("lat", "lon")], F.lit(1).cast("long").alias("changed"), F.lit(None).cast("map<string,string>").alias("tags"))
    with pytest.raises(Exception, match="lost|abort"):
        broken.write.format("extract").mode("append").save(path)
    assert spark.read.format("extract").load(path).count() == 50
    # An attempt that ran to its end but whose report did not count, and a second one of the same task.
    writer = extract.ExtractWriter(extract.SCHEMA, {"path": path}, False)
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "version": pa.array([1, 1], pa.int32()), "lat": [0.0, 0.0], "lon": [0.0, 0.0], "changed": [1, 1], "tags": pa.array([[], []], pa.map_(pa.string(), pa.string()))})
    lost, counted = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([counted, None])
    assert spark.read.format("extract").load(path).count() == 52
    writer.abort([lost])
    assert lost.file not in Files(path).names()


def test_damage_is_seen(spark, tmp_path):
    path = f"{tmp_path}/x"
    spark.createDataFrame(elements(3, 50), SCHEMA).coalesce(1).write.format("extract").mode("append").save(path)
    name = next(n for n in Files(path).names() if n.startswith("attempt"))
    data = bytearray(Files(path).read(name))
    data[-3] ^= 255
    Files(path).write(name, bytes(data))
    with pytest.raises(Exception, match="damaged"):
        spark.read.format("extract").load(path).count()
    with pytest.raises(Exception, match="columns of an extract"):
        spark.range(3).write.format("extract").mode("append").save(path)


class Row:
    def __init__(self, at, ends, event_id=0):
        self.at, self.ends, self.event_id = at, ends, event_id


def test_limits_count_from_the_first_failure():
    p, now, said = expiring.Attempts(100, 3), None, []
    for at, ok in [(0, 0), (50, 0), (99, 0), (120, 0), (130, 1), (140, 0), (150, 0), (240, 0), (250, 0)]:
        if now is not None and at >= now[2]:
            now = None
        now, out = p.step(Row(at, ok), now)
        said += [(at, *o) for o in out]
    # The third of the first window; 120 begins a new one, 130 clears it, and 140's ends before 240.
    assert said == [(99, 0, 100)]


def events(folder, parts):
    for k, part in enumerate(parts):
        pd.DataFrame(part, columns=["event_id", "user_id", "ts", "event_type"]).assign(ts=lambda d: pd.to_datetime(d.ts, unit="s").astype("datetime64[us]")).to_parquet(f"{folder}/{k}.parquet")


def test_cache_over_batches_and_state_goes(spark, tmp_path):
    """The same rows in one batch or many, equal to a plain fold; keys leave no state once their values have run out."""
    r = random.Random(4)
    rows_ = [(k, r.randint(0, 5), 1_700_000_000 + 40 * k + r.randint(0, 30), r.choice(["view", "view", "purchase"])) for k in range(400)]
    rows_ += [(1000 + k, 99, 1_700_000_000 + 10**6 + 100 * k, "view") for k in range(3)]  # much later: all others have run out
    rows_.sort(key=lambda x: (x[2], x[0]))
    filled, wanted = {}, set()
    for i, u, at, kind in rows_:
        live = u in filled and at < filled[u] + 600
        wanted.add((i, kind == "purchase", live))
        if kind == "purchase":
            filled.pop(u, None)
        elif not live:
            filled[u] = at
    (tmp_path / "in").mkdir()
    events(tmp_path / "in", [rows_[:150], rows_[150:300], rows_[300:400], rows_[400:401], rows_[401:402], rows_[402:]])
    source = spark.readStream.schema("event_id long, user_id long, ts timestamp_ntz, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    progress = []
    found = expiring.run(spark, source, lambda s: expiring.watched(s, expiring.Cache(600_000_000), "event_type = 'purchase'"), progress)
    assert {(x.event_id, x.evicts, x.live) for x in found.collect()} == wanted
    counts = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert max(counts) > counts[-1] and sum(p.numInputRows for p in progress) >= len(rows_)


def test_stored_tables_can_be_removed(spark):
    from cartolake.session import discard_stored, shared_path

    path = shared_path(spark, "x")
    spark.range(3).write.parquet(path)
    other = f"{path.rsplit('/', 2)[0]}/kept"
    spark.range(2).write.mode("overwrite").parquet(other)
    discard_stored(spark)
    assert spark.read.parquet(other).count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_listings_are_read_to_their_end(spark, tmp_path):
    """Runs of pages cover a listing, pages that were added since are read, missing ones in between are empty."""
    from cartolake.sources import listing

    spark.dataSource.register(listing.ListingSource)
    rows = [(k, f"p{k}" if k % 5 else None) for k in range(95) if not 30 <= k < 40]
    path = f"{tmp_path}/pages"
    listing.write_pages(spark.createDataFrame(rows, "place_id long, name string"), path, 10)
    read = spark.read.format("listing").option("size", 10).option("run", 3).load(path)
    assert read.rdd.getNumPartitions() == 3
    assert sorted((x.place_id, x.name) for x in read.collect()) == rows
    (tmp_path / "pages" / "page=10").mkdir()
    (tmp_path / "pages" / "page=10" / "part-0.txt").write_text('{"total":96,"items":[{"place_id":100,"name":"new"}]}\n')
    assert read.where("place_id = 100").count() == 1
    assert spark.read.format("listing").option("size", 10).load(f"{tmp_path}/none").count() == 0
