"""A keyed table in hash buckets: batches are added as deltas, a manifest says which files count.

Rows of one key lie in one of ``buckets`` buckets. An upsert reduces its batch to
one row per key, writes that as one sorted delta file per touched bucket, and
commits by creating the next manifest, a small JSON file that lists each
bucket's files. Nothing stored is read or rewritten. A reader takes the newest
complete manifest: buckets of base files only are passed through, in the others
the newest version of each key is kept. A bucket of more than ``max_deltas``
deltas is compacted by the upsert that makes it so; only such buckets are
rewritten.

* Commit: manifest ``n + 1`` is written under another name and renamed, and the
  rename fails where the name exists. Of two writers one wins; the other reads
  the new manifest and adds its files to that. What a killed writer left is in
  no manifest and is never read.
* Batches carry an id: one that is in the manifest is not applied again, so a
  replayed micro-batch changes nothing.
* Layouts: a file is listed with the number of the columns it was written with.
  A new layout is a new manifest; older files are read with what they have,
  renamed and filled with defaults as the manifest says. No file is rewritten.
* Skipping: a file is listed with the least and greatest values of the columns
  in ``stats``; a read with bounds opens only files that can hold such rows.
* ``vacuum`` removes manifests but the last few, and files that none of these
  lists.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keelson.operators.upsert import keep_last


class CommitConflict(Exception):
    """Another writer committed this version first."""


@dataclass
class Manifest:
    """One committed state of a table."""

    version: int = 0
    keys: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)
    buckets: int = 1
    #: Layouts by number: {"schema": ..., "renamed": {new: old}, "defaults": {column: value}}.
    layouts: list[dict] = field(default_factory=list)
    #: Files by bucket, oldest first: {"path", "rows", "base", "layout", "low": {...}, "high": {...}}.
    files: dict[str, list[dict]] = field(default_factory=dict)
    #: Last applied number of each stream of batches.
    applied: dict[str, int] = field(default_factory=dict)

    def paths(self) -> set[str]:
        return {f["path"] for group in self.files.values() for f in group}


class BucketedTable:
    """See the module. ``path`` must be shared by the driver and all executors."""

    def __init__(
        self, spark: SparkSession, path: str, max_deltas: int = 4, stats: Sequence[str] = (), max_rows: int = 4_000_000
    ) -> None:
        self.spark, self.path, self.max_deltas, self.stats, self.max_rows = spark, path, max_deltas, list(stats), max_rows

    # --- files ------------------------------------------------------------------

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        p, fs = self._hadoop(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _read_text(self, path: str) -> str:
        p, fs = self._hadoop(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put_if_absent(self, path: str, text: str) -> None:
        """Create ``path`` whole or not at all; fails where it exists."""
        jvm = self.spark.sparkContext._jvm
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        p, fs = self._hadoop(temporary)
        out = fs.create(p, False)
        out.write(text.encode())
        out.close()
        target, _ = self._hadoop(path)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(fs.makeQualified(p), fs.makeQualified(target), never)
        except Exception as e:
            fs.delete(p, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(path) from e
            raise

    def versions(self) -> list[int]:
        names = self._names(os.path.join(self.path, "manifest"))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The newest (or a given) committed state; None where nothing was committed."""
        if version is None:
            found = self.versions()
            if not found:
                return None
            version = found[-1]
        return Manifest(**json.loads(self._read_text(os.path.join(self.path, "manifest", f"{version:012d}.json"))))

    def _commit(self, m: Manifest) -> None:
        text = json.dumps(m.__dict__, sort_keys=True)
        self._put_if_absent(os.path.join(self.path, "manifest", f"{m.version:012d}.json"), text)

    def _change(self, apply) -> Manifest:
        """Commit ``apply(newest manifest)``; where another writer was first, apply it to what that one committed."""
        while True:
            m = apply(self.manifest())
            if m is None:
                return self.manifest()
            m.version += 1
            try:
                self._commit(m)
            except CommitConflict:
                continue
            return m

    # --- layout --------------------------------------------------------------------

    def create(self, schema: StructType, keys: Sequence[str], order: Sequence[str], buckets: int) -> BucketedTable:
        """Commit an empty table; one that exists is left as it is."""
        first = Manifest(keys=list(keys), order=list(order), buckets=buckets, layouts=[
            {"schema": schema.jsonValue(), "renamed": {}, "defaults": {}}])
        self._change(lambda now: first if now is None else None)
        return self

    def evolve(self, schema: StructType, defaults: dict | None = None, renamed: dict[str, str] | None = None) -> Manifest:
        """A new layout: columns may be added (older rows take ``defaults``), dropped, or renamed (new: old)."""
        layout = {"schema": schema.jsonValue(), "renamed": renamed or {}, "defaults": defaults or {}}

        def apply(m: Manifest) -> Manifest | None:
            if m.layouts[-1] == layout:
                return None
            m.layouts.append(layout)
            return m

        return self._change(apply)

    def _bucket(self, m: Manifest):
        return F.pmod(F.xxhash64(*m.keys), F.lit(m.buckets)).cast("int")

    def _written(self, m: Manifest, rows: DataFrame, base: bool) -> dict[str, list[dict]]:
        """Rows as sorted files for each bucket, of at most ``max_rows``; their entries for the manifest."""
        folder = os.path.join(self.path, "data", uuid.uuid4().hex)
        dealt = rows.withColumn("_bucket", self._bucket(m)).repartition("_bucket")
        inside = [*self.stats, *(k for k in m.keys if k not in self.stats)] if base else m.keys
        rows_of = dealt.sortWithinPartitions("_bucket", *inside).write.partitionBy("_bucket")
        rows_of.option("maxRecordsPerFile", self.max_rows).parquet(folder)
        stored = self.spark.read.parquet(folder) if any(n.startswith("_bucket=") for n in self._names(folder)) else None
        if stored is None:
            return {}
        low = [F.min(c).cast("string").alias(f"low_{c}") for c in self.stats]
        high = [F.max(c).cast("string").alias(f"high_{c}") for c in self.stats]
        found = stored.groupBy("_bucket", F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"), *low, *high)
        out: dict[str, list[dict]] = {}
        for r in sorted(found.collect(), key=lambda r: r.path):  # one row for each file just written
            out.setdefault(str(r["_bucket"]), []).append({
                "path": r.path, "rows": r["rows"], "base": base, "layout": len(m.layouts) - 1,
                "low": {c: r[f"low_{c}"] for c in self.stats}, "high": {c: r[f"high_{c}"] for c in self.stats},
            })
        return out

    # --- writing -------------------------------------------------------------------

    def upsert(
        self, batch: DataFrame, batch_id: int | None = None, stream: str = "batch", expect: int | None = None
    ) -> Manifest:
        """Add ``batch``; of each key the row greatest in ``order`` counts, stored or new.

        With ``expect`` the batch was made from that version: if another one was
        committed since, nothing is added and :class:`CommitConflict` is raised.
        """
        now = self.manifest()
        if batch_id is not None and now.applied.get(stream, -1) >= batch_id:
            return now
        columns = [f["name"] for f in now.layouts[-1]["schema"]["fields"]]
        delta = self._written(now, keep_last(batch, now.keys, now.order).select(*columns), base=False)

        def apply(m: Manifest) -> Manifest | None:
            if expect is not None and m.version != expect:
                raise CommitConflict(f"{self.path}: version {m.version}, not {expect}")
            if batch_id is not None:
                if m.applied.get(stream, -1) >= batch_id:
                    return None
                m.applied[stream] = batch_id
            for bucket, files in delta.items():
                m.files.setdefault(bucket, []).extend(files)
            return m

        done = self._change(apply)
        full = [b for b in delta if sum(not f["base"] for f in done.files[b]) > self.max_deltas]
        return self.compact(full) if full else done

    def compact(self, buckets: Sequence[str] | None = None) -> Manifest:
        """Rewrite ``buckets`` (else all that have deltas) as one base each."""
        before = self.manifest()
        chosen = [b for b, files in before.files.items() if any(not f["base"] for f in files) and (buckets is None or b in buckets)]
        if not chosen:
            return before
        old = {b: before.files[b] for b in chosen}
        new = self._written(before, self._rows(before, old), base=True)

        def apply(m: Manifest) -> Manifest | None:
            for b in chosen:
                if m.files[b][: len(old[b])] != old[b] or len(m.layouts) != len(before.layouts):
                    return None  # compacted by another writer, or a new layout came: leave it
                m.files[b] = new.get(b, []) + m.files[b][len(old[b]):]
            return m

        return self._change(apply)

    def vacuum(self, keep: int = 2, older_than_s: float = 3600.0) -> int:
        """Remove manifests but the last ``keep``, and data files that none of those lists.

        Files younger than ``older_than_s`` stay where no removed manifest lists
        them: a writer may be about to commit them. Returns the files removed.
        """
        found = self.versions()
        kept, gone = found[-keep:], found[:-keep]
        live = {_place(p) for v in kept for p in self.manifest(v).paths()}
        listed = {_place(p) for v in gone for p in self.manifest(v).paths()}
        root, fs = self._hadoop(os.path.join(self.path, "data"))
        removed = 0
        if fs.exists(root):
            every = fs.listFiles(root, True)
            while every.hasNext():
                f = every.next()
                place = f.getPath().toUri().getPath()
                old = f.getModificationTime() < (time.time() - older_than_s) * 1000
                if place not in live and (old or place in listed):
                    fs.delete(f.getPath(), False)
                    removed += place.endswith(".parquet")
        for v in gone:
            p, fs = self._hadoop(os.path.join(self.path, "manifest", f"{v:012d}.json"))
            fs.delete(p, False)
        return removed

    # --- reading -------------------------------------------------------------------

    def _files(self, m: Manifest, files: list[dict]) -> DataFrame:
        """The rows of some files in the newest layout."""
        wanted = StructType.fromJson(m.layouts[-1]["schema"])
        parts = []
        for number in sorted({f["layout"] for f in files}):
            schema = StructType.fromJson(m.layouts[number]["schema"])
            df = self.spark.read.schema(schema).parquet(*[f["path"] for f in files if f["layout"] == number])
            for later in m.layouts[number + 1 :]:
                df = _in_layout(df, later)
            parts.append(df.select(*[F.col(f.name).cast(f.dataType) for f in wanted.fields]))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _rows(self, m: Manifest, files: dict[str, list[dict]]) -> DataFrame:
        """One row per key: buckets of a single base as they are, the others reduced."""
        wanted = StructType.fromJson(m.layouts[-1]["schema"])
        clean = [f for group in files.values() if all(f["base"] for f in group) for f in group]
        dirty = [f for group in files.values() if not all(f["base"] for f in group) for f in group]
        parts = []
        if clean:
            parts.append(self._files(m, clean))
        if dirty:
            parts.append(keep_last(self._files(m, dirty), m.keys, m.order).select(*wanted.names))
        if not parts:
            return self.spark.createDataFrame([], wanted)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def files_for(self, bounds: dict[str, tuple] | None = None, m: Manifest | None = None) -> dict[str, list[dict]]:
        """The files a read with ``bounds`` (column: (least, greatest), either may be None) opens.

        Only buckets of base files skip: a version that is out of bounds may
        replace one that is in them.
        """
        m = m or self.manifest()
        if not bounds:
            return m.files
        out = {}
        for bucket, files in m.files.items():
            if all(f["base"] for f in files):
                files = [f for f in files if all(_meets(f, c, *ends) for c, ends in bounds.items())]
            if files:
                out[bucket] = files
        return out

    def read(self, bounds: dict[str, tuple] | None = None, version: int | None = None) -> DataFrame:
        """The table, or its rows with each bounded column between its ends."""
        m = self.manifest(version)
        df = self._rows(m, self.files_for(bounds, m))
        for c, (least, greatest) in (bounds or {}).items():
            if least is not None:
                df = df.where(F.col(c) >= F.lit(least))
            if greatest is not None:
                df = df.where(F.col(c) <= F.lit(greatest))
        return df


def _place(path: str) -> str:
    """The path without scheme and host, as Hadoop names it."""
    return unquote(urlparse(path).path)


def _meets(file: dict, column: str, least, greatest) -> bool:
    """Whether a file's range of ``column`` meets the bounds; text compares as Spark casts it."""
    low, high = file["low"].get(column), file["high"].get(column)
    if low is None or high is None:
        return column not in file["low"]
    if isinstance(least if least is not None else greatest, (int, float)):
        low, high = Decimal(low), Decimal(high)
    else:
        least, greatest = (None if x is None else str(x) for x in (least, greatest))
    return (greatest is None or low <= greatest) and (least is None or high >= least)


def _in_layout(df: DataFrame, layout: dict) -> DataFrame:
    """Rows of the layout before in this one."""
    schema, renamed, defaults = StructType.fromJson(layout["schema"]), layout["renamed"], layout["defaults"]
    columns = []
    for f in schema.fields:
        old = renamed.get(f.name, f.name)
        if old in df.columns:
            columns.append(F.col(old).cast(f.dataType).alias(f.name))
        else:
            columns.append(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name))
    return df.select(*columns)
