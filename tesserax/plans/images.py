"""Queries that go through a ``Store``: what its transactions publish, keep and refuse."""

from __future__ import annotations

import getpass
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import maps
from ..sources.database import Store, TransactionError
from ..spec import Database, SpecError, Table
from .keyed import KV, kv
from .registry import query

SPEC = Database().add(Table("prices", "map", (("k", "bigint"), ("v", "double")))).add(Table("notes", "map", (("k", "bigint"), ("v", "string"))))


def _path(t) -> str:
    """A new folder in the shared one; a local session without one gets it on this machine."""
    shared = t.spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not t.spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"file:/tmp/checkpoints/{getpass.getuser()}"
    return f"{shared.rstrip('/')}/tesserax/{t.spark.sparkContext.applicationId}/store-{uuid.uuid4().hex[:12]}"


def _filled(t) -> Store:
    store = Store.create(t.spark, _path(t), SPEC)
    change = store.begin()
    change.put("prices", kv(t))
    change.put("notes", kv(t).where("k % 50 = 0").select("k", F.lit("noted").alias("v")))
    change.commit()
    return store


@query("q_store_commit", f"with {KV} select k, case when k % 3 = 0 then 0.0::double else v end as v from kv where k % 97 <> 0")
def _(t):
    store = _filled(t)
    change = store.begin()
    change.put("prices", maps.update_if_present(change.table("prices"), kv(t).where("k % 3 = 0").select("k", F.lit(0.0).alias("v"))))
    change.put("prices", maps.delete(change.table("prices"), kv(t).where("k % 97 = 0")))
    change.commit()
    return Store.open(t.spark, store.path, SPEC).table("prices")


@query("q_store_rollback", f"with {KV} select 'prices' as name, count(*) as n from kv union all select 'notes', count(*) from kv where k % 50 = 0")
def _(t):
    store = _filled(t)
    change = store.begin()
    change.put("prices", change.table("prices").limit(0))
    change.rollback()
    return _counts(store, "prices").union(_counts(store, "notes"))


def _counts(store: Store, name: str) -> DataFrame:
    return store.table(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")


@query("q_store_snapshot", f"with {KV} select (select count(*) from kv) as before, (select count(*) from kv where k % 2 = 0) as staged, (select count(*) from kv) as seen, (select count(*) from kv where k % 2 = 0) as after")
def _(t):
    """A reader sees the committed state until the commit, the transaction its own."""
    store = _filled(t)
    before, change = store.table("prices"), store.begin()
    change.put("prices", change.table("prices").where("k % 2 = 0"))
    staged, seen = change.table("prices"), store.table("prices")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    early = n(before, "before").crossJoin(n(staged, "staged")).crossJoin(n(seen, "seen"))  # one row each
    change.commit()
    return early.crossJoin(n(store.table("prices"), "after"))


@query("q_store_refusals", "select * from (values ('other schema', true), ('path exists', true), ('second transaction', true), ('over', true), ('published meanwhile', true), ('unknown table', true)) x(rule, refused)")
def _(t):
    store = Store.create(t.spark, _path(t), SPEC)

    def refused(error, call):
        try:
            call()
        except error:
            return True
        return False

    other = Database().add(Table("prices", "map", (("k", "bigint"), ("v", "string"))))
    found = [("other schema", refused(SpecError, lambda: Store.open(t.spark, store.path, other))), ("path exists", refused(SpecError, lambda: Store.create(t.spark, store.path, SPEC)))]
    change = store.begin()
    found.append(("second transaction", refused(TransactionError, store.begin)))
    found.append(("unknown table", refused((SpecError, KeyError), lambda: change.put("none", kv(t)))))
    change.rollback()
    found.append(("over", refused(TransactionError, lambda: change.put("prices", kv(t)))))
    late, first = Store.open(t.spark, store.path, SPEC).begin(), store.begin()
    first.put("prices", kv(t).limit(1))
    first.commit()
    late.put("prices", kv(t).limit(2))
    found.append(("published meanwhile", refused(TransactionError, late.commit)))
    return t.spark.createDataFrame(found, "rule string, refused boolean")


@query("q_store_tables", f"with {KV} select 'prices' as name, 1::bigint as version, count(*) as n, 0::bigint as least from kv where k >= 0 union all select 'notes', 1, count(*), 0 from kv where k % 50 = 0")
def _(t):
    store = _filled(t)
    held = store.versions()
    made = t.spark.createDataFrame([(n, v, 0) for n, v in held.items()], "name string, version long, least long")
    return made.join(_counts(store, "prices").union(_counts(store, "notes")), "name").select("name", "version", "n", "least")
