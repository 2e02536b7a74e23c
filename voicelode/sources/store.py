"""Stored tables: posts, history, analyzed, alerts and runs as Parquet folders.

Every load writes its own `load_id=...` folder.  A load that is repeated writes another folder, and a manifest
makes that one count instead (see `sources.snapshots`), so a load that is run again after a failure leaves the
same tables, and readers see the load as it was or as it is.  The name of
the folder holds all that makes a load another one: its kind, its topic or streaming query,
and the caller's id or the batch.  The analyzed flag is a small table of its own, joined on read.
`compact` puts all loads of a table into one part of few files, and `vacuum` deletes what no reader needs any more.
"""

from __future__ import annotations

import hashlib
import math
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voicelode import schemas
from voicelode.operators.collapse import first_per_key
from voicelode.operators.tables import HISTORY_KEY, mark_analyzed, with_insert_defaults
from voicelode.sources.keyfilters import KeyFilters
from voicelode.sources.snapshots import Manifest, Snapshots

TABLES = {
    "posts": schemas.SCORED_POST,
    "history": schemas.HISTORY,
    "analyzed": schemas.ANALYZED,
    "alerts": schemas.SCORED_POST,
    "revisions": schemas.SCORED_POST,
    "raised": schemas.SCORED_POST,
    "runs": schemas.RUNS,
}
_PARTITIONED = {"posts": ["topic"], "alerts": ["topic"]}
#: Posts and alerts that a later micro-batch has changed: a table of their own, whose last row of a post counts.
_REVISED = {"posts": "revisions", "alerts": "raised"}


def load_name(kind: str, of: str, load_id: str) -> str:
    """The name of a load: `kind` of run, `of` which topic or streaming query, and its own id.

    Loads that differ in any of the three have different folders.
    """
    mark = hashlib.sha256("\x00".join([kind, of, load_id]).encode()).hexdigest()[:16]
    plain = "".join(c if c.isalnum() or c in "-_." else "_" for c in load_id)
    return f"{kind}-{mark}-{plain}"


class PostStore:
    def __init__(self, spark: SparkSession, root: str, few: int = 32):
        """`few`: so many load folders are read as they are; beyond that, filters choose among them."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.few = few

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str, but: str | None = None) -> DataFrame:
        """A table as it is, or without the load `but`, which is being written; posts and alerts by their last revision."""
        stored = self._stored(table, but)
        if table not in _REVISED or not self._exists(_REVISED[table]):
            return stored
        columns = StructType.fromDDL(TABLES[table]).fieldNames()
        changed = self._stored(_REVISED[table], but)
        rest = [c for c in columns if c not in ("id", "topic", "load_id")]
        last = changed.groupBy("id", "topic").agg(F.max_by(F.struct(*rest), "load_id").alias("_last"), F.max("load_id").alias("_by"))
        if table == "alerts":  # a revision may be what raises one
            first = stored.select("id", "topic", "load_id")
            last = last.join(first, ["id", "topic"], "left").select(
                "id", "topic", "_last.*", F.coalesce("load_id", "_by").alias("load_id")
            )
            return stored.join(last.select("id", "topic"), ["id", "topic"], "left_anti").unionByName(last).select(*columns)
        joined = stored.join(last.drop("_by"), ["id", "topic"], "left")
        return joined.withColumns({c: F.when(F.col("_last").isNotNull(), F.col(f"_last.{c}")).otherwise(F.col(c)) for c in rest}).select(*columns)

    def _exists(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _stored(self, table: str, but: str | None = None) -> DataFrame:
        schema = TABLES[table]
        manifest = self._snapshots(table).latest()[1]
        if manifest != Manifest():
            return self._rows(table, self._units(table, manifest), but)
        try:
            stored = self.spark.read.schema(schema).parquet(self.path(table))
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        if but is not None:
            stored = stored.filter(F.col("load_id") != but)
        return stored.select(*StructType.fromDDL(schema).fieldNames())

    def holding(self, table: str, rows: DataFrame, but: str | None = None) -> DataFrame:
        """The loads and parts of posts or history that may hold an id of `rows`, whole, but for the load `but`.

        Enough to see which ids are stored; rows are as first written, without later revisions.
        """
        units = self._units(table, self._snapshots(table).latest()[1])
        if but is not None:
            units.pop(but, None)
        if len(units) <= self.few:
            return self._rows(table, units, but)
        filters = self._filters(table)
        names = {self._filter_name(unit, at): unit for unit, (at, _) in units.items()}
        known = filters.known()
        lacking = [name for name, unit in names.items() if name not in known and (units[unit][0] or self._finished(table, unit))]
        if lacking:
            wanted = {names[name]: units[names[name]] for name in lacking}
            filters.build(self._rows(table, wanted, named=True).select("load_id", "id"), lacking)
            known = filters.known()
        found = filters.may_hold(rows.select("id"), {name: known[name] for name in names if name in known})
        chosen = {names[name]: units[names[name]] for name in names if name in found or name not in known}
        return self._rows(table, chosen, but)

    def _filters(self, table: str) -> KeyFilters:
        return KeyFilters(self.spark, f"{self.root}/filters-{table}")

    def _snapshots(self, table: str) -> Snapshots:
        return Snapshots(self.spark, f"{self.root}/snapshots-{table}")

    def _loads(self, table: str) -> list[str]:
        """The loads that have a first folder."""
        folders = self._filters(table)._folders(self.path(table))
        return sorted(f.removeprefix("load_id=") for f in folders if f.startswith("load_id="))

    def _finished(self, table: str, load: str) -> bool:
        """Whether the first folder of a load is written."""
        at = f"{self.path(table)}/load_id={load}/_SUCCESS"
        return self._system(at).exists(self.spark._jvm.org.apache.hadoop.fs.Path(at))

    def _units(self, table: str, manifest: Manifest) -> dict[str, tuple[str | None, list[str]]]:
        """What a version of the table is made of: (folder, loads in it that do not count) of each load or part; no folder: the first one."""
        own = {load: (None, []) for load in manifest.own(self._loads(table))}
        moved = {load: (at, []) for load, at in manifest.moved.items()}
        return own | moved | {f"part/{part}": (part, without) for part, without in manifest.parts.items()}

    def _filter_name(self, unit: str, at: str | None) -> str:
        """A folder is written once, so a filter belongs to a folder."""
        return unit if at is None else at.rsplit("/", 1)[-1]

    def _new_folder(self, table: str) -> str:
        return f"{self.root}/{table}-parts/{uuid.uuid4().hex}"

    def _rows(
        self, table: str, units: dict[str, tuple[str | None, list[str]]], but: str | None = None, named: bool = False
    ) -> DataFrame:
        """The rows of some units, no other folder is listed or read; `named`: with the name of the unit's filter as load."""
        columns = StructType.fromDDL(TABLES[table]).fieldNames()
        reader = self.spark.read.schema(TABLES[table])
        own = [f"{self.path(table)}/load_id={unit}" for unit, (at, _) in units.items() if at is None]
        parts = [reader.option("basePath", self.path(table)).parquet(*own)] if own else []
        for unit, (at, without) in units.items():
            if at is None:
                continue
            rows = reader.option("basePath", at).parquet(at)
            if without:
                rows = rows.filter(~F.col("load_id").isin(without))
            parts.append(rows.withColumn("load_id", F.lit(self._filter_name(unit, at))) if named else rows)
        if not parts:
            # the optimizer knows that nothing is left of it, so joins with it go and move no rows
            return self.spark.createDataFrame([], TABLES[table]).limit(0)
        parts = [rows.select(*columns) for rows in parts]
        while len(parts) > 1:  # a flat tree of unions
            parts = [a.unionByName(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) - len(parts) % 2 :]
        return parts[0].filter(F.col("load_id") != but) if but is not None else parts[0]

    def write(self, df: DataFrame, table: str, load_id: str) -> None:
        """Write one load of a table; a repeated load replaces itself, at once, when it is written."""
        snapshots = self._snapshots(table)
        manifest = snapshots.latest()[1]
        if load_id in manifest.settled:
            raise ValueError(f"load {load_id} of {table} is settled: its updates were compacted to the last ones")
        again = load_id in manifest.folded or load_id in manifest.moved or load_id in self._loads(table)
        folder = self._new_folder(table) if again else self.path(table)
        wanted = [f for f in StructType.fromDDL(TABLES[table]).fields if f.name != "load_id"]
        if table == "posts":
            df = with_insert_defaults(df, {f.name: f.dataType for f in wanted})
        columns = [
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in wanted
        ]
        writer = df.select(*columns).write.mode("overwrite")
        if table in _PARTITIONED:
            writer = writer.partitionBy(*_PARTITIONED[table])
        writer.parquet(f"{folder}/load_id={load_id}", compression="zstd")
        if again:
            snapshots.publish(lambda latest: latest.with_moved(load_id, folder))

    def compact(self, table: str, settle: bool = False, file_bytes: int = 1 << 28) -> bool:
        """Write all loads of a table into one part of files of about `file_bytes`; False if another compaction was first.

        Rows stay as they are, ordered by id (by topic and id where topics are folders), so that files have narrow
        ranges of ids.  With `settle`, of several updates of one post only the last stays, in the tables that hold updates;
        the loads must not be written again then.  Old folders stay for those who read them; see `vacuum`.
        """
        snapshots = self._snapshots(table)
        manifest = snapshots.latest()[1]
        own = [load for load in manifest.own(self._loads(table)) if self._finished(table, load)]
        units = self._units(table, manifest)
        units = {unit: units[unit] for unit in units if unit in own or units[unit][0] is not None}
        if len(units) < 2:
            return False
        rows = self._rows(table, units)
        if settle and table == "analyzed":
            rows = first_per_key(rows, ["id"], [F.col("analyzed_at").desc()])
        if settle and table in _REVISED.values():
            rows = first_per_key(rows, ["id", "topic"], [F.col("load_id").desc()])
        order = [*_PARTITIONED.get(table, []), "id"]
        files = max(1, math.ceil(sum(self._bytes(at or f"{self.path(table)}/load_id={unit}") for unit, (at, _) in units.items()) / file_bytes))
        writer = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write
        if table in _PARTITIONED:
            writer = writer.partitionBy(*_PARTITIONED[table])
        folder = self._new_folder(table)
        writer.parquet(folder, compression="zstd")
        return snapshots.publish(lambda latest: latest.with_part(manifest, own, folder, settle))

    def vacuum(self, table: str, older_than: float = 7 * 86400.0) -> list[str]:
        """Delete the folders that no version of the last `older_than` seconds reads, and return them.

        Neither a reader nor a writer may take longer than that.
        """
        before = int((time.time() - older_than) * 1000)
        readable = self._snapshots(table).readable(before)
        needed = {path for m in readable for path in [*m.moved.values(), *m.parts]}
        loads = self._loads(table)
        first = set(loads).difference(*(m.own(loads) for m in readable))
        gone = [f"{self.path(table)}/load_id={load}" for load in sorted(first)]
        written = self._filters(table)._folders(f"{self.root}/{table}-parts")
        gone += [at for f in sorted(written) if (at := f"{self.root}/{table}-parts/{f}") not in needed and self._time(at) < before]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for at in gone:
            self._system(at).delete(path(at), True)
        return gone

    def _system(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _bytes(self, at: str) -> int:
        return self._system(at).getContentSummary(self.spark._jvm.org.apache.hadoop.fs.Path(at)).getLength()

    def _time(self, at: str) -> int:
        return self._system(at).getFileStatus(self.spark._jvm.org.apache.hadoop.fs.Path(at)).getModificationTime()

    def posts(self) -> DataFrame:
        """Stored posts with `analyzed` and `analysis_result`."""
        latest = first_per_key(self.read("analyzed"), ["id"], [F.col("analyzed_at").desc()])
        bare = self.read("posts").withColumns(
            {"analyzed": F.lit(False), "analysis_result": F.lit(None).cast("string")}
        )
        return mark_analyzed(bare, latest)

    def history_keys(self, but: str | None = None) -> DataFrame:
        return self.read("history", but).select(*HISTORY_KEY)
