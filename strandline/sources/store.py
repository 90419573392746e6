"""Sinks and stores: tables in a directory, insert-if-absent, deletion, upsert, status, snapshots, plug-in backends."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merging import upsert


class TableStore:
    """Named tables, each a Parquet directory of versions.

    A write makes a new version and then moves the pointer, so a reader, and a
    writer that reads what it replaces, always sees a whole table.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _read_text(self, path) -> str:
        return self.spark.read.text(path.toString(), wholetext=True).first()[0]

    def _write_text(self, path, text: str) -> None:
        out = self._fs.create(path, True)
        out.write(bytearray(text.encode()))
        out.close()

    def names(self) -> list[str]:
        if not self._fs.exists(self._path()):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path()) if self._fs.exists(self._path(s.getPath().getName(), "current")))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name, "current"))

    def read(self, name: str) -> DataFrame:
        """All versions that the table's list names, in their order."""
        versions = self._read_text(self._path(name, "current")).split()
        return self.spark.read.parquet(*[self._path(name, v).toString() for v in versions])

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> None:
        version = f"v-{uuid.uuid4().hex}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self._path(name, version).toString())
        self._write_text(self._path(name, "current"), version)

    def append_new(self, name: str, rows: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Insert rows whose key is not stored; ``compute`` runs on those only. Gives their number."""
        rows = rows.dropDuplicates([key])
        new = rows.join(self.read(name).select(key), key, "left_anti") if self.exists(name) else rows
        # written once under a version of its own: computed once, and what is stored is not written again
        version = f"v-{uuid.uuid4().hex}"
        made = self._path(name, version)
        (compute(new) if compute else new).write.mode("overwrite").parquet(made.toString())
        n = self.spark.read.parquet(made.toString()).count()
        if n or not self.exists(name):
            before = self._read_text(self._path(name, "current")).split() if self.exists(name) else []
            self._write_text(self._path(name, "current"), "\n".join([*before, version]))
        else:
            self._fs.delete(made, True)
        return n

    def delete(self, name: str, keys: DataFrame, key: str) -> None:
        self.write(name, self.read(name).join(keys.select(key).distinct(), key, "left_anti"))

    def upsert(self, name: str, rows: DataFrame, key: str) -> None:
        self.write(name, upsert(self.read(name), rows, key) if self.exists(name) else rows)

    def get(self, name: str, keys: list, key: str) -> DataFrame:
        """Rows of the keys in the order of the request, nulls for keys not stored."""
        ask = self.spark.createDataFrame(list(enumerate(keys)), f"ord int, `{key}` {self.read(name).schema[key].dataType.simpleString()}")
        return ask.join(self.read(name), key, "left").orderBy("ord").drop("ord")

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def checkpoint(self, target: str) -> dict:
        """Copy all current tables to a directory with a manifest."""
        made = {}
        for name in self.names():
            df = self.read(name)
            df.write.mode("overwrite").parquet(f"{target.rstrip('/')}/{name}")
            made[name] = df.count()
        manifest = {"version": 1, "tables": made}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}/manifest.json")
        self._write_text(path, json.dumps(manifest, sort_keys=True))
        return manifest

    def restore(self, source: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{source.rstrip('/')}/manifest.json")
        for name in json.loads(self._read_text(path))["tables"]:
            self.write(name, self.spark.read.parquet(f"{source.rstrip('/')}/{name}"))


def write_jsonl(df: DataFrame, path: str, order: str | None = None) -> None:
    (df.orderBy(order).drop(order) if order else df).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """A summary as one CSV file with a header, doubles with so many digits."""
    shown = [F.format_string(f"%.{digits}f", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*shown).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


class Backends:
    """Named makers of dataset backends, with other names for them."""

    def __init__(self) -> None:
        self._made: dict[str, Callable] = {}
        self._alias: dict[str, str] = {}

    def register(self, name: str, make: Callable, aliases: tuple[str, ...] = ()) -> None:
        if name in self._made:
            raise ValueError(f"there is a backend {name!r} already")
        self._made[name] = make
        self._alias |= dict.fromkeys(aliases, name)

    def create(self, name: str, *args, **kwargs):
        name = self._alias.get(name, name)
        if name not in self._made:
            raise KeyError(f"no backend {name!r}; there are {', '.join(sorted(self._made))}")
        return self._made[name](*args, **kwargs)

    def names(self) -> list[str]:
        return sorted(self._made)


BACKENDS = Backends()
BACKENDS.register("parquet", TableStore, ("table", "local"))
