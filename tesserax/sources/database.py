"""Versioned sets of tables: one writer, staged changes, an atomic publish.

Each commit writes its changed tables to a folder of its own, named at random, so writers
never touch each other's files. The pointer file names the folder of each table; a commit
replaces it by a rename, if it still is the one that the transaction began with. Readers see
the old version or the new one, and a crash leaves the old one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..spec import Database, SpecError
from .runstore import _fs, _read_text


class TransactionError(RuntimeError):
    """A transaction used out of order: a second one, or one that is over."""


class Store:
    """A database image at a path, bound to a spec by its fingerprint."""

    def __init__(self, spark: SparkSession, path: str, spec: Database):
        self.spark, self.path, self.spec, self._open = spark, path, spec, None

    @classmethod
    def create(cls, spark: SparkSession, path: str, spec: Database) -> Store:
        """Format an image; the path must not exist."""
        p, fs = _fs(spark, path)
        if fs.exists(p):
            raise SpecError(f"{path} exists")
        self = cls(spark, path, spec)
        for t in spec.tables:
            spark.createDataFrame([], t.struct()).write.parquet(self._folder("new", t.name))
        self._publish({"version": 0, "schema": spec.fingerprint(), "tables": {t.name: [0, "new"] for t in spec.tables}})
        return self

    @classmethod
    def open(cls, spark: SparkSession, path: str, spec: Database) -> Store:
        """Bind to an image; one of another schema is refused."""
        self = cls(spark, path, spec)
        if self._pointer()["schema"] != spec.fingerprint():
            raise SpecError(f"{path} has another schema")
        return self

    def _folder(self, part: str, name: str) -> str:
        return f"{self.path}/{part}/{name}"

    def versions(self) -> dict[str, int]:
        """The version that last changed each table."""
        return {name: version for name, (version, _) in self._pointer()["tables"].items()}

    def _pointer(self) -> dict:
        return json.loads(_read_text(self.spark, f"{self.path}/current.json"))

    def _publish(self, pointer: dict) -> None:
        text = json.dumps(pointer).encode()
        tmp, fs = _fs(self.spark, f"{self.path}/current.next")
        out = fs.create(tmp, True)
        out.write(bytearray(text))
        out.close()
        place, _ = _fs(self.spark, f"{self.path}/current.json")
        # FileContext replaces in one step where the store can.
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(tmp, place, options)

    def table(self, name: str) -> DataFrame:
        """The committed state of a table."""
        spec = self.spec.table(name)
        return self.spark.read.schema(spec.struct()).parquet(self._folder(self._pointer()["tables"][name][1], name))

    def begin(self) -> Transaction:
        if self._open is not None:
            raise TransactionError("a transaction is active")
        self._open = Transaction(self)
        return self._open


class Transaction:
    """Staged changes of several tables, all or none."""

    def __init__(self, store: Store):
        self.store, self.pointer, self.staged = store, store._pointer(), {}

    def _live(self) -> Store:
        if self.store._open is not self:
            raise TransactionError("the transaction is over")
        return self.store

    def table(self, name: str) -> DataFrame:
        """A table as this transaction sees it."""
        return self.staged[name] if name in self.staged else self._live().table(name)

    def put(self, name: str, df: DataFrame) -> None:
        struct = self._live().spec.table(name).struct()
        self.staged[name] = df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in struct))

    def commit(self) -> None:
        """Write what is staged and publish it; a failure on the way rolls all back, as does a
        version that another writer has published since the begin."""
        store = self._live()
        version, part = self.pointer["version"] + 1, uuid.uuid4().hex
        try:
            for name, df in self.staged.items():
                df.write.parquet(store._folder(part, name))
            if store._pointer()["version"] != self.pointer["version"]:
                raise TransactionError("another version was published meanwhile")
            store._publish({"version": version, "schema": store.spec.fingerprint(), "tables": self.pointer["tables"] | {n: [version, part] for n in self.staged}})
        finally:
            store._open = None

    def rollback(self) -> None:
        self._live()._open = None
        self.staged = {}
