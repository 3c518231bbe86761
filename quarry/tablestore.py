"""Files of the engine's tables: appended, or exchanged under a journal.

A table is a folder of Parquet files. A change is written to a hidden folder `_staged-<id>` in it first. Then a
journal `_journal-<id>` names the files that go and those that come; from there on the change is made, and who
finds the journal finishes it: files that go are deleted, staged ones moved in, both as often as need be. So a
statement that fails before its journal leaves the table as it was, and one that fails after it is completed by
the next statement. There is one writer at a time; readers may see a change half made.
"""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of `__at`: the row's place in its file; the file's number is above it.
_ROW_BITS = 40
#: A placed row's file without its folder, which Spark writes in more than one way.
_NAME = "substring_index(__file, '/', -1)"


class TableStore:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def location(self, place: str) -> str:
        return self.spark.sql(f"DESCRIBE FORMATTED {place}").filter("col_name = 'Location'").first()["data_type"]

    def schema_root(self, space: str) -> str:
        return self.spark.sql(f"DESCRIBE SCHEMA `{space}`").filter("info_name = 'Location'").first()["info_value"]

    def new_location(self, place: str) -> str:
        space, label = place.replace("`", "").split(".")
        return f"{self.schema_root(space)}/{label}-{uuid.uuid4().hex}"

    def remove(self, path: str) -> None:
        fs, Path = self._fs(path)
        fs.delete(Path(path), True)

    def names(self, folder: str, prefix: str = "part-") -> list[str]:
        fs, Path = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(Path(folder)) if s.getPath().getName().startswith(prefix))

    def stage(self, folder: str, rows: DataFrame, cluster: list[str] | None = None) -> tuple[str, DataFrame]:
        """Write rows to a hidden folder of a table's; its id, and the rows as written. Files are sorted by
        `cluster`, so that readers can skip row groups."""
        key = uuid.uuid4().hex
        path = f"{folder}/_staged-{key}"
        (rows.sortWithinPartitions(*cluster) if cluster else rows).write.parquet(path)
        return key, self.spark.read.schema(rows.schema).parquet(path)

    def commit(self, place: str, folder: str, key: str | None, old: list[str] = ()) -> None:
        """Move staged files in and delete old ones."""
        key = key or uuid.uuid4().hex
        fs, Path = self._fs(folder)
        staged = f"{folder}/_staged-{key}"
        new = self.names(staged) if fs.exists(Path(staged)) else []
        out = fs.create(Path(f"{folder}/.journal-{key}"), True)
        out.write(bytearray(json.dumps({"old": list(old), "new": new}).encode()))
        out.close()
        fs.rename(Path(f"{folder}/.journal-{key}"), Path(f"{folder}/_journal-{key}"))
        self._finish(folder, f"_journal-{key}")
        self.spark.catalog.refreshTable(place)

    def discard(self, folder: str, key: str) -> None:
        self.remove(f"{folder}/_staged-{key}")

    def _finish(self, folder: str, journal: str) -> None:
        fs, Path = self._fs(folder)
        stream = fs.open(Path(f"{folder}/{journal}"))
        plan = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        for name in plan["old"]:
            fs.delete(Path(f"{folder}/{name}"), False)
        key = journal.removeprefix("_journal-")
        for name in plan["new"]:
            if fs.exists(Path(f"{folder}/_staged-{key}/{name}")):
                fs.rename(Path(f"{folder}/_staged-{key}/{name}"), Path(f"{folder}/{name}"))
        fs.delete(Path(f"{folder}/_staged-{key}"), True)
        fs.delete(Path(f"{folder}/{journal}"), False)

    def recover(self, place: str, folder: str) -> None:
        """Finish changes whose journal is there."""
        fs, Path = self._fs(folder)
        left = self.names(folder, "_journal-") if fs.exists(Path(folder)) else []
        for journal in left:
            self._finish(folder, journal)
        if left:
            self.spark.catalog.refreshTable(place)

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows of a table or of files with `__file` and `__row`, which tell them apart."""
        return rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))

    def located(self, placed: DataFrame, files: list[str]) -> DataFrame:
        """placed rows with one number, `__at`, for file and row, so that joins hold 8 bytes for a row and not its file's
        path. `files` are all of the table's, in the order that `files_of` is given."""
        first = self.spark.createDataFrame([(f.rsplit("/", 1)[1], i << _ROW_BITS) for i, f in enumerate(files)], "__name string, __first long")
        at = F.coalesce("__first", F.raise_error(F.lit("a file of the table is not among its files")).cast("long")) + F.col("__row")
        return placed.withColumn("__name", F.expr(_NAME)).join(F.broadcast(first), "__name", "left").withColumn("__at", at).drop("__file", "__row", "__name", "__first")

    def files_of(self, located: DataFrame, files: list[str]) -> list[str]:
        """The files that hold rows with an `__at`."""
        return [files[i] for i in sorted(r["i"] for r in located.select(F.shiftright("__at", _ROW_BITS).cast("int").alias("i")).distinct().collect())]

    def read(self, rows: DataFrame, files: list[str]) -> DataFrame:
        """The rows of some of a table's files."""
        return self.placed(self.spark.read.schema(rows.schema).parquet(*files))

    def without(self, rows: DataFrame, files: list[str]) -> DataFrame:
        """The rows of a table's other files. A short list of files prunes the scan, a long one is joined."""
        placed, names = self.placed(rows), [f.rsplit("/", 1)[1] for f in files]
        if len(names) > 500:
            placed = placed.withColumn("__name", F.expr(_NAME)).join(F.broadcast(self.spark.createDataFrame([(n,) for n in names], "__name string")), "__name", "left_anti")
        elif names:
            placed = placed.filter(~F.expr(_NAME).isin(names))
        return placed.select(*rows.columns)

    def numbered(self, folder: str, rows: DataFrame) -> DataFrame:
        """rows with `__n`, counted from 0 without gaps, the same in every reading: they are written, and a file's
        rows follow those of the files before it. One count a file reaches the driver."""
        path = f"{folder}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        back = self.placed(self.spark.read.schema(rows.schema).parquet(path))
        starts, at = [], 0
        for r in sorted(back.groupBy("__file").count().collect(), key=lambda r: r["__file"]):
            starts.append((r["__file"], at))
            at += r["count"]
        start = self.spark.createDataFrame(starts, "__file string, __start long")
        return back.join(F.broadcast(start), "__file").withColumn("__n", F.col("__start") + F.col("__row")).drop("__file", "__row", "__start")
