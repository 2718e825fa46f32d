"""A paged source for playlist services: one Spark partition a page. Offline it replays stored JSON pages."""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedPlaylist(DataSource):
    """Options: path, a folder of JSON pages, each a list of items; items without a track, local ones and booleans are skipped."""

    @classmethod
    def name(cls):
        return "paged_playlist"

    def schema(self):
        return "page int, track_id string, title string, artist string"

    def reader(self, schema):
        return PagedReader(self.options["path"])


class PagedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(p) for p in sorted(glob.glob(os.path.join(self.path, "*.json")))] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        with open(partition.value) as f:
            for item in json.load(f):
                track = item.get("track") if isinstance(item, dict) else None
                if isinstance(track, dict) and not track.get("is_local") and track.get("id"):
                    yield int("".join(c for c in os.path.basename(partition.value) if c.isdigit()) or 0), track["id"], track.get("name"), ", ".join(a["name"] for a in track.get("artists", []))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedPlaylist)
