"""Paged feeds as a Spark data source: cursors, early stop, one partition for each repository.

A feed lists a repository's records newest first, 100 to a page. Reading on from
a cursor means opening pages from the first until one reaches back to the cursor
less the overlap, and no further. ``PagedFeed`` does so for every repository at
once, each a partition of its own, in a batch (``spark.read.format("paged_feed")``)
or as a stream whose offsets are the cursors
(``spark.readStream.format("paged_feed")``).

Pages lie as Parquet under ``path/repo=<name>/page=<n>`` in a store that the
executors reach through Arrow's file systems; :func:`write_pages` lands them.

Options: ``path``; ``time`` (the column that the feed is ordered by); ``since``
(JSON: repository to ISO time; a repository that it lacks is read in full);
``overlap_minutes``. A stream starts at no cursor at all.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from keelson.operators.kpis import REPO
from keelson.operators.ranking import ranked

# Records of a page, and what is read again behind a cursor.
PER_PAGE = 100
OVERLAP_MINUTES = 5


def write_pages(rows: DataFrame, time: str, order: list[str], path: str, per_page: int = PER_PAGE) -> None:
    """Land ``rows`` as pages, newest first; ``order`` tells records of one instant apart."""
    newest = rows.withColumn("_age", -F.unix_micros(time))
    placed = ranked(newest, [REPO], ["_age", *order], "_place").withColumn("page", F.floor(F.col("_place") / per_page).cast("int"))
    pages = placed.drop("_age").withColumn("repo", F.col(REPO)).repartition("repo", "page")
    pages.sortWithinPartitions("repo", "page", "_place").drop("_place").write.partitionBy("repo", "page").parquet(path)


class _Pages:
    """The page files below a folder, wherever Arrow can reach it."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        if re.match(r"^[a-z0-9]+:", self.path):
            # Hadoop writes file:/folder where a URI has file:///folder
            return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", self.path))
        return pafs.LocalFileSystem(), self.path

    def repositories(self) -> list[str]:
        fs, root = self._fs()
        found = fs.get_file_info(pafs.FileSelector(root))
        return sorted(unquote(f.base_name.removeprefix("repo=")) for f in found if f.base_name.startswith("repo="))

    def page(self, repository: str, number: int) -> pa.Table | None:
        """One page's records, None behind the last page."""
        fs, root = self._fs()
        folder = f"{root}/repo={_escaped(repository)}/page={number}"
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        files = [f.path for f in found if f.base_name.endswith(".parquet")]
        return pa.concat_tables(pq.ParquetFile(fs.open_input_file(f)).read() for f in files) if files else None


def _escaped(name: str) -> str:
    """A partition value as Spark names its folder."""
    return quote(name, safe=" !$&()+,-.;@[]_`|~<>")


def _instant(text: str) -> datetime:
    at = datetime.fromisoformat(text)
    return at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)


class _Share(InputPartition):
    """One repository: records at or after ``since`` (text or None), and up to ``until`` if given."""

    def __init__(self, repository: str, since: str | None, until: str | None = None) -> None:
        super().__init__(repository)
        self.repository, self.since, self.until = repository, since, until


class _Reader:
    def __init__(self, options: dict, schema: StructType) -> None:
        self.pages, self.time = _Pages(options["path"]), options["time"]
        self.overlap = timedelta(minutes=float(options.get("overlap_minutes", OVERLAP_MINUTES)))
        self.arrow = to_arrow_schema(schema)

    def read(self, share: _Share) -> Iterator[pa.RecordBatch]:
        """Pages from the newest on, until one reaches back behind the cursor."""
        since = None if share.since is None else _instant(share.since) - self.overlap
        number = 0
        while (page := self.pages.page(share.repository, number)) is not None:
            at = page[self.time]
            if at.type.tz is None:
                at = at.cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))
            oldest = pc.min(at).as_py()
            page = page.append_column("page", pa.array([number] * page.num_rows, pa.int32()))
            keep = pc.is_null(at)  # records without a time are always read
            inside = pc.is_valid(at)
            if since is not None:
                inside = pc.and_kleene(inside, pc.greater_equal(at, pa.scalar(since, at.type)))
            if share.until is not None:
                inside = pc.and_kleene(inside, pc.less_equal(at, pa.scalar(_instant(share.until), at.type)))
            page = page.filter(pc.or_kleene(keep, pc.fill_null(inside, False)))
            if page.num_rows:
                yield from page.select(self.arrow.names).cast(self.arrow).to_batches()
            if since is not None and oldest is not None and oldest < since:
                return
            number += 1


class _BatchReader(_Reader, DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        super().__init__(options, schema)
        self.since = json.loads(options.get("since", "{}"))

    def partitions(self) -> list[InputPartition]:
        return [_Share(r, self.since.get(r)) for r in self.pages.repositories()]


class _StreamReader(_Reader, DataSourceStreamReader):
    """Offsets: the newest instant of each repository (its first page tells)."""

    def initialOffset(self) -> dict:  # noqa: N802 - named by Spark
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        newest = {}
        for r in self.pages.repositories():
            page = self.pages.page(r, 0)
            at = pc.max(page[self.time]).as_py() if page is not None else None
            if at is not None:
                newest[r] = at.replace(tzinfo=timezone.utc).isoformat() if at.tzinfo is None else at.isoformat()
        return newest

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Share(r, start.get(r), until) for r, until in sorted(end.items()) if start.get(r) != until]

    def commit(self, end: dict) -> None:
        """Nothing to release: pages stay where they are."""


class PagedFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BatchReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(dict(self.options), schema)


def with_page(schema: StructType) -> StructType:
    """``schema`` and the number of the page that a record stood on."""
    return StructType([*schema.fields, StructField("page", IntegerType())])


def read_since(spark: SparkSession, path: str, schema: StructType, time: str, since: DataFrame | None = None) -> DataFrame:
    """The feed's records from each repository's cursor on; ``since`` (repository, since) is one row per repository.

    The cursors, some bytes for each repository, are part of the request.
    """
    spark.dataSource.register(PagedFeed)
    cursors = {} if since is None else {r[REPO]: r["since"] for r in since.selectExpr(REPO, "cast(since as string) as since").collect() if r["since"]}
    reader = spark.read.format("paged_feed").schema(with_page(schema)).option("path", path).option("time", time)
    return reader.option("since", json.dumps(cursors)).load()
