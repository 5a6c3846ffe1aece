"""A Spark data source over any paged service: each partition fetches some pages, a failed page ends that partition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Pages(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def paged_source(name: str, schema: str, fetch: Callable[[int, int], list[tuple]], total: int, page: int = 100, pages_per_task: int = 10) -> type[DataSource]:
    """A class for ``spark.dataSource.register``: ``fetch(offset, length)`` gives rows in the schema's order."""

    class Reader(DataSourceReader):
        def partitions(self):
            pages = -(-total // page)
            return [_Pages(a, min(a + pages_per_task, pages)) for a in range(0, pages, pages_per_task)]

        def read(self, partition):
            for k in range(partition.first, partition.last):
                try:
                    rows = fetch(k * page, min(page, total - k * page))
                except OSError:
                    return
                yield from rows

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    return Source
