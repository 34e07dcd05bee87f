"""Listings that are given out page by page, as a Spark data source.

A listing is a folder with a file `page=N/...` of JSON for each page: the total number of items and those of the page. Page 0
tells the total, so that runs of pages become partitions; the last run goes on until a page is missing or empty, as a client
does that pages until nothing comes, so items added since are read too.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cartolake.sources.files import Files

SCHEMA = T.StructType().add("place_id", "long").add("name", "string")
#: Pages of a partition.
RUN = 8


def write_pages(rows: DataFrame, path: str, size: int) -> None:
    """Rows (place_id, name) as pages of `size` numbers of place_id each."""
    total = rows.agg(F.count("*").alias("total"))  # one row
    pages = rows.groupBy(F.floor(F.col("place_id") / size).alias("page")).agg(F.array_sort(F.collect_list(F.struct("place_id", "name"))).alias("items"))
    pages.crossJoin(total).select("page", F.to_json(F.struct("total", "items")).alias("value")).write.partitionBy("page").text(path)


class Pages(InputPartition):
    def __init__(self, first: int, last: int | None):
        self.first, self.last = first, last


class ListingSource(DataSource):
    """spark.read.format("listing").load(folder); options: size (items of a page), run (pages of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ListingReader(self.options)


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.size, self.run = options["path"].rstrip("/"), int(options["size"]), int(options.get("run", RUN))

    def page(self, number: int) -> dict | None:
        """A page's content; None where there is none."""
        folder = Files(f"{self.root}/page={number}")
        lines = [line for name in sorted(folder.names()) if not name.startswith((".", "_")) for line in folder.read(name).decode().splitlines() if line]
        return json.loads(lines[0]) if lines else None

    def partitions(self) -> list[InputPartition]:
        first = self.page(0)
        pages = -(-first["total"] // self.size) if first else 1
        starts = range(0, max(pages, 1), self.run)
        return [Pages(a, a + self.run if a + self.run < pages else None) for a in starts]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        number = partition.first
        while partition.last is None or number < partition.last:
            found = self.page(number)
            if found is None or not found["items"]:
                if partition.last is None:
                    return
            else:
                yield pa.RecordBatch.from_arrays([pa.array([x["place_id"] for x in found["items"]], pa.int64()), pa.array([x.get("name") for x in found["items"]], pa.string())], ["place_id", "name"])
            number += 1
