"""Versioned Parquet tables with merge, append, change feed, time travel and a stream of commits.

``<path>/_commits/NNNNNNNN.json`` names a version's data files, its folder of changes and the last batch of each stream that wrote to the table. Data
and change files are immutable and lie in folders of their own run; a commit file is put in place by a rename that doesn't replace, as the last step, so readers and streams
see whole versions only, and of two writers one fails and leaves nothing that is read. Beside each run's data lie its files' statistics: rows, range and a Bloom filter of
each key. A merge asks these first and reads those files alone that may hold a key of its batch; ``compact`` joins small files. A merge writes the batch's own rows and those data files again that hold rows which it changes; an append writes new rows alone.
What changes nothing commits nothing. A streaming batch that was committed before is not committed again.
"""

from __future__ import annotations

import json
import uuid

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks rows that a replacement takes away.
ROW = "_gone"
#: Tables of fewer files are read without asking which may hold a key. Keys of a batch that are looked up in the files' filters; a larger batch goes by ranges alone. Bits of a filter for each key, places that a key sets, and most bits.
FEW_FILES, LOOKED_UP, BITS, PLACES, MOST_BITS = 32, 100_000, 12, 4, 1 << 26
#: Of data, changes and a merge's plan: what is written is mostly texts.
CODEC = "zstd"
_STATS = "file string, key string, n long, least long, most long, filter binary"


def _hashes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    x = h.view(np.uint64)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return [((x + np.uint64(i) * step) % np.uint64(bits)).astype(np.int64) for i in range(PLACES)]


def _file_stats(t: pa.Table) -> pa.Table:
    """(file, key, h), the hashes of a file's keys -> its row of statistics."""
    h = np.unique(t.column("h").to_numpy())
    bits = min(MOST_BITS, 64 * -(-BITS * len(h) // 64))
    table = np.zeros(bits, np.uint8)
    for at in _hashes(h, bits):
        table[at] = 1
    one = {"file": t.column("file")[:1], "key": t.column("key")[:1], "n": [len(t)], "least": [int(h.min())], "most": [int(h.max())], "filter": [np.packbits(table).tobytes()]}
    return pa.table(one, schema=pa.schema([("file", pa.string()), ("key", pa.string()), ("n", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("filter", pa.binary())]))


def _may_hold(shared):
    """(file, filter) -> (file) of those whose filter has one of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        for b in batches:
            keep = []
            for x in b.column(1):
                table = np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8))
                got = np.ones(len(h), bool)
                for at in _hashes(h, len(table)):
                    got &= table[at] > 0
                keep.append(bool(got.any()))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_()))], names=["file"])

    return run


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, ddl: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType.fromDDL(ddl)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> list[int]:
        d = self._path(f"{self.path}/_commits")
        if not self._fs.exists(d):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(d)]
        return sorted(int(n[:8]) for n in names if n.endswith(".json") and n[:8].isdigit())

    def _commit_path(self, version: int):
        return self._path(f"{self.path}/_commits/{version:08d}.json")

    def _commit(self, version: int) -> dict:
        if version == 0:
            return {"files": [], "streams": {}}
        stream = self._fs.open(self._commit_path(version))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def version(self) -> int:
        """The latest version, 0 before the first commit."""
        return max(self._commits(), default=0)

    def ensure(self) -> VersionedTable:
        self._fs.mkdirs(self._path(f"{self.path}/_commits"))
        return self

    def _read_files(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{f}" for f in files))

    def read(self, version: int | None = None) -> DataFrame:
        return self._read_files(self._commit(self.version() if version is None else version)["files"])

    def changes(self, after: int, upto: int | None = None) -> DataFrame | None:
        """Change rows of versions (after, upto] with _change_type and _version; None if part of the history is gone."""
        upto = self.version() if upto is None else upto
        return self.changes_of(range(after + 1, upto + 1))

    def changes_of(self, versions) -> DataFrame | None:
        """Change rows of the given versions, in one scan."""
        schema = T.StructType([*self.schema, T.StructField("_change_type", T.StringType()), T.StructField("_version", T.IntegerType())])
        runs = {v: self._commit(v).get("changes") if self._fs.exists(self._commit_path(v)) else None for v in versions}
        if not runs:
            return self.spark.createDataFrame([], schema)
        folders = {f"{self.path}/_changes/_run={r}": v for v, r in runs.items()}
        if None in runs.values() or not all(self._fs.exists(self._path(f)) for f in folders):
            return None
        number = F.create_map(*(x for r, v in ((r, v) for v, r in runs.items()) for x in (F.lit(r), F.lit(v))))  # an entry a version
        rows = self.spark.read.schema(T.StructType([*schema.fields[:-1], T.StructField("_run", T.StringType())])).option("basePath", f"{self.path}/_changes").parquet(*folders)
        return rows.withColumn("_version", number[F.col("_run")]).drop("_run")

    def commits_stream(self, max_files: int = 500) -> DataFrame:
        """The commits as a stream of (version), for a job that reads ``changes_of`` the versions of each batch."""
        self.ensure()
        src = self.spark.readStream.schema("version BIGINT").option("pathGlobFilter", "[0-9]*.json").option("maxFilesPerTrigger", max_files)
        return src.json(f"{self.path}/_commits")

    def done(self, stream: str, batch_id: int) -> bool:
        """Whether a batch of a stream was committed; batches of a stream come in order."""
        return self._commit(self.version())["streams"].get(stream, -1) >= batch_id

    def merge(self, source: DataFrame, key: str, update_if: Column | None = None, delete_if: Column | None = None, insert_if: Column | None = None,
              stream: str | None = None, batch_id: int | None = None) -> dict[str, int]:
        """Merges ``source`` by ``key``; conditions see t and s. Gives the number of the source's rows by action: insert, update, delete, keep or ignore."""
        if stream is not None and self.done(stream, batch_id):
            return {}
        action = F.when(delete_if, F.when(F.col("t").isNull(), "ignore").otherwise("delete")) if delete_if is not None else F.when(F.lit(False), "")
        action = action.when(F.col("t").isNull(), F.when(insert_if if insert_if is not None else F.lit(True), "insert").otherwise("ignore"))
        action = action.when(F.lit(True) if update_if is None else update_if, "update").otherwise("keep")
        return self._apply(source, key, action, stream, batch_id)

    def _key_hash(self, key: str) -> Column:
        return F.xxhash64(F.col(key).cast("string"))

    def _note(self, run: str, names: list[str], keys: tuple[str, ...]) -> None:
        """Writes the statistics of a run's files. Only the keys are read; a file's keys are gathered as hashes in one task, as they were written by one."""
        if not names:
            return
        file = F.concat(F.lit(f"{run}/"), F.element_at(F.split(F.input_file_name(), "/"), -1))
        rows = self._read_files(names).select(file.alias("file"), *(self._key_hash(k).alias(k) for k in keys))
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("h")) for k in keys)))
        rows.select("file", each.alias("x")).select("file", "x.key", "x.h").groupBy("file", "key").applyInArrow(_file_stats, _STATS).write.parquet(f"{self.path}/_stats/_run={run}")

    def candidates(self, batch: DataFrame, key: str, last: dict | None = None) -> list[str]:
        """The data files of the latest version that may hold a row with one of ``batch``'s keys."""
        files = (self._commit(self.version()) if last is None else last)["files"]
        if len(files) < FEW_FILES:
            return files
        runs = sorted({f.split("/")[0] for f in files})
        noted = [f"{self.path}/_stats/_run={r}" for r in runs if self._fs.exists(self._path(f"{self.path}/_stats/_run={r}"))]
        if not noted:
            return files
        stats = self.spark.read.schema(_STATS).parquet(*noted).filter(F.col("key") == key)
        known = {r["file"] for r in stats.select("file").collect()}  # names that the commit lists anyway
        keys = batch.select(self._key_hash(key).alias("h")).distinct()
        edge = keys.agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("n")).first()
        hits: set[str] = set()
        if edge["n"]:
            near = stats.filter((F.col("least") <= edge["b"]) & (F.col("most") >= edge["a"]))
            if edge["n"] <= LOOKED_UP:
                shared = self.spark.sparkContext.broadcast(np.array([r["h"] for r in keys.collect()], np.int64))  # at most LOOKED_UP numbers
                near = near.select("file", "filter").mapInArrow(_may_hold(shared), "file string")
            hits = {r["file"] for r in near.select("file").collect()}
        return [f for f in files if f in hits or f not in known]

    def compact(self, rows_a_file: int) -> int:
        """Writes again as few files what lies in files of less than half of ``rows_a_file`` rows. No row changes, nor does the change feed. Gives the number of files that went."""
        last = self._commit(self.version())
        sizes = self._read_files(last["files"]).groupBy(F.input_file_name().alias("f")).count() if last["files"] else None
        small = {self._name(r["f"]): r["count"] for r in sizes.filter(F.col("count") < rows_a_file / 2).collect()} if sizes is not None else {}
        if len(small) < 2:
            return 0
        rows = self._read_files(sorted(small)).repartition(-(-sum(small.values()) // rows_a_file))
        none = self.spark.createDataFrame([], self.schema).withColumn("_change_type", F.lit(None).cast("string"))
        self._write(last, [f for f in last["files"] if f not in small], rows, none, None, None)
        return len(small)

    def _work(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.path}/_work/{uuid.uuid4().hex}"
        df.write.option("compression", CODEC).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def _apply(self, source: DataFrame, key: str, action: Column, stream: str | None, batch_id: int | None, extra: tuple[str, ...] = (), units: tuple[str, ...] = ()) -> dict[str, int]:
        """Applies ``action`` of (t, s), the target's and the source's row, to each row of ``source``; other rows of the target stay as they are. s has the columns ``extra``, too."""
        self.ensure()
        last = self._commit(self.version())
        names = self.schema.names
        some = self.candidates(source, key, last)
        target = self._read_files(some)
        target = target.select(F.col(key).alias("_tk"), F.struct(*names).alias("t"), (F.input_file_name() if some else F.lit(None).cast("string")).alias("_file"))
        s = source.select(F.col(key).alias("_sk"), F.struct(*names, *extra).alias("s"))
        plan, work = self._work(s.join(target, F.col("_tk") == F.col("_sk"), "left").select(action.alias("_action"), "_sk", "t", "s", "_file"))
        try:
            if not plan.groupBy("_sk").count().filter("count > 1").isEmpty():
                raise ValueError(f"source has several rows for one {key}")
            counts = {r["_action"]: r["count"] for r in plan.groupBy("_action").count().collect()}
            if any(counts.get(a) for a in ("insert", "update", "delete")):
                changed = plan.filter("_action in ('update', 'delete')")
                # Names of data files, which the commit lists anyway.
                touched = {self._name(r["_file"]) for r in changed.select("_file").distinct().collect()}
                kept = self._read_files(sorted(touched)).join(changed.select(F.col("_sk").alias(key)), key, "left_anti").select(names)
                new = plan.filter("_action in ('insert', 'update')").select("s.*").select(names)
                kind = F.col("_action")
                old = changed.select("t.*", F.when(kind == "update", "update_preimage").otherwise("delete").alias("_change_type"))
                fresh = plan.filter("_action in ('insert', 'update')").select("s.*", F.when(kind == "update", "update_postimage").otherwise("insert").alias("_change_type")).select(*names, "_change_type")
                self._write(last, sorted(set(last["files"]) - touched), kept.unionByName(new), old.select(*names, "_change_type").unionByName(fresh), stream, batch_id, (key, *units))
            return counts
        finally:
            self._fs.delete(self._path(work), True)

    @staticmethod
    def _name(file: str) -> str:
        """A data file's name below ``data``: its run's folder and its own."""
        return "/".join(file.rsplit("/", 2)[-2:])

    def _write(self, last: dict, files: list[str], rows: DataFrame, changes: DataFrame, stream: str | None, batch_id: int | None, keys: tuple[str, ...] = ()) -> None:
        """Writes a version. Its files are noted by ``keys`` and those by which files were noted before."""
        version, run = last.get("version", 0) + 1, uuid.uuid4().hex
        folder = self._path(f"{self.path}/data/{run}")
        rows.write.option("compression", CODEC).parquet(folder.toString())
        new = [f"{run}/{x.getPath().getName()}" for x in self._fs.listStatus(folder) if x.getPath().getName().endswith(".parquet")]
        changes.select(*self.schema.names, "_change_type").write.option("compression", CODEC).parquet(f"{self.path}/_changes/_run={run}")
        streams = last["streams"] | ({stream: batch_id} if stream is not None else {})
        keys = tuple(sorted({*last.get("keys", ()), *keys}))
        self._note(run, new, keys)
        self._publish(version, {"version": version, "files": files + new, "changes": run, "streams": streams, "keys": list(keys)})

    def append_new(self, source: DataFrame, key: str, stream: str | None = None, batch_id: int | None = None) -> dict[str, int]:
        """Insert-only merge: rows whose key is new, of repeated keys one row. Only keys are read, of files that may hold one of them, and nothing is written again."""
        if stream is not None and self.done(stream, batch_id):
            return {}
        self.ensure()
        last = self._commit(self.version())
        new = source.select(self.schema.names).dropDuplicates([key]).join(self._read_files(self.candidates(source, key, last)).select(key), key, "left_anti").select(self.schema.names)
        rows, work = self._work(new)
        try:
            n = rows.count()
            if n:
                self._write(last, last["files"], rows, rows.withColumn("_change_type", F.lit("insert")), stream, batch_id, (key,))
            return {"insert": n}
        finally:
            self._fs.delete(self._path(work), True)

    def replace_where(self, rows: DataFrame, key: str, unit: str, units: DataFrame, ignore: tuple[str, ...] = (), stream: str | None = None, batch_id: int | None = None) -> dict[str, int]:
        """Replaces all rows of the given ``units`` by ``rows`` in one commit. Rows that differ in columns to ``ignore`` alone stay as they are."""
        if stream is not None and self.done(stream, batch_id):
            return {}
        names = self.schema.names
        units = units.select(unit).distinct()
        gone = self._read_files(self.candidates(units, unit)).join(units, unit, "left_semi").join(rows.select(key), key, "left_anti")
        both = rows.select(*names, F.lit(False).alias(ROW)).unionByName(self._keys_alone(gone, key).withColumn(ROW, F.lit(True)))
        same = F.struct(*(F.col(f"t.{c}") for c in names if c not in ignore)).eqNullSafe(F.struct(*(F.col(f"s.{c}") for c in names if c not in ignore)))
        action = F.when(F.col(f"s.{ROW}"), "delete").when(F.col("t").isNull(), "insert").when(~same, "update").otherwise("keep")
        return self._apply(both, key, action, stream, batch_id, extra=(ROW,), units=(unit,))

    def keep_only(self, keep: DataFrame, key: str) -> dict[str, int]:
        """Deletes all rows whose key isn't among ``keep``."""
        gone = self._keys_alone(self.read().select(key).join(keep.select(key), key, "left_anti"), key)
        return {} if gone.isEmpty() else self._apply(gone, key, F.lit("delete"), None, None)

    def _keys_alone(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows to delete: of these the target's columns count, so no other column travels."""
        return rows.select(*(F.col(key) if f.name == key else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema))

    def _publish(self, version: int, commit: dict) -> None:
        """Puts the whole commit file in place by a rename that fails if there is one, as Spark's own logs of streams do."""
        jvm = self.spark.sparkContext._jvm
        temp = self._path(f"{self.path}/_commits/.{commit['changes']}")
        out = self._fs.create(temp)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._fs.makeQualified(temp), self._fs.makeQualified(self._commit_path(version)), options)
        except Exception as e:
            self._fs.delete(temp, False)
            raise RuntimeError(f"version {version} was committed by another writer") from e
