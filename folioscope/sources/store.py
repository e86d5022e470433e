"""A store of items with revisions behind one protocol: a table in the shared folder, and a fake of it in memory.

Items are (pk, sk, revision, value as JSON).  Every write is a batch of operations (create, update, check, delete) with expected revisions that
happens as a whole or not at all.
"""

from __future__ import annotations

import json
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.lineage import cut, discard

SCHEMA = "pk string, sk string, revision long, value string"


class Conflict(Exception):
    """Some item of a batch is not as it was expected; nothing was changed."""


class Store(Protocol):
    def get(self, pk: str, sk: str) -> tuple[int, dict] | None: ...

    def query(self, pk: str, prefix: str = "", limit: int = 100, after: str | None = None) -> tuple[list[tuple[str, int, dict]], str | None]: ...

    def transact(self, operations: list[tuple[str, str, str, int | None, dict | None]]) -> None: ...


def put(store: Store, pk: str, sk: str, value: dict) -> None:
    store.transact([("create", pk, sk, None, value)])


def update(store: Store, pk: str, sk: str, expected: int, value: dict) -> None:
    store.transact([("update", pk, sk, expected, value)])


def delete(store: Store, pk: str, sk: str, expected: int) -> None:
    store.transact([("delete", pk, sk, expected, None)])


def _problem(op: str, there: int | None, expected: int | None) -> str | None:
    if op == "create":
        return "exists" if there is not None else None
    return "missing" if there is None else "revision" if there != expected else None


class MemoryStore:
    """The protocol over a dictionary, for tests."""

    def __init__(self) -> None:
        self.items: dict[tuple[str, str], tuple[int, dict]] = {}

    def get(self, pk: str, sk: str) -> tuple[int, dict] | None:
        return self.items.get((pk, sk))

    def query(self, pk: str, prefix: str = "", limit: int = 100, after: str | None = None) -> tuple[list[tuple[str, int, dict]], str | None]:
        found = sorted((sk, r, v) for (p, sk), (r, v) in self.items.items() if p == pk and sk.startswith(prefix) and (after is None or sk > after))
        return found[:limit], found[limit - 1][0] if len(found) > limit else None

    def transact(self, operations: list[tuple[str, str, str, int | None, dict | None]]) -> None:
        if len({o[1:3] for o in operations}) < len(operations):
            raise Conflict("repeated key")
        for op, pk, sk, expected, _ in operations:
            if problem := _problem(op, (self.items.get((pk, sk)) or (None,))[0], expected):
                raise Conflict(f"{pk} {sk}: {problem}")
        for op, pk, sk, expected, value in operations:
            if op == "delete":
                del self.items[pk, sk]
            elif op != "check":
                self.items[pk, sk] = (1 if op == "create" else expected + 1, value or {})


class TableStore:
    """The protocol over a table: reads are pruned scans, a write gives the next table and then the one before goes."""

    def __init__(self, spark: SparkSession, items: DataFrame | None = None):
        self.table = cut(items if items is not None else spark.createDataFrame([], SCHEMA))

    def get(self, pk: str, sk: str) -> tuple[int, dict] | None:
        r = self.table.where((F.col("pk") == pk) & (F.col("sk") == sk)).first()
        return (r.revision, json.loads(r.value)) if r else None

    def query(self, pk: str, prefix: str = "", limit: int = 100, after: str | None = None) -> tuple[list[tuple[str, int, dict]], str | None]:
        found = self.table.where((F.col("pk") == pk) & F.col("sk").startswith(prefix))
        rows = (found if after is None else found.where(F.col("sk") > after)).orderBy("sk").limit(limit + 1).collect()
        return [(r.sk, r.revision, json.loads(r.value)) for r in rows[:limit]], rows[limit - 1].sk if len(rows) > limit else None

    def transact(self, operations: list[tuple[str, str, str, int | None, dict | None]]) -> None:
        if len({o[1:3] for o in operations}) < len(operations):
            raise Conflict("repeated key")
        rows: list[tuple[Any, ...]] = [(op, pk, sk, expected, json.dumps(value or {}, sort_keys=True)) for op, pk, sk, expected, value in operations]
        ops = self.table.sparkSession.createDataFrame(rows, "op string, pk string, sk string, expected long, new string")
        for r in ops.join(self.table, ["pk", "sk"], "left").collect():  # as many as the batch has operations
            if problem := _problem(r.op, r.revision, r.expected):
                raise Conflict(f"{r.pk} {r.sk}: {problem}")
        changed = ops.where("op <> 'check'")
        j = self.table.join(changed, ["pk", "sk"], "full_outer").where("op is null or op <> 'delete'")
        before, self.table = self.table, cut(j.select("pk", "sk", F.when(F.col("op") == "create", 1).when(F.col("op") == "update", F.col("revision") + 1).otherwise(F.col("revision")).cast("long").alias("revision"), F.when(F.col("op").isNull(), F.col("value")).otherwise(F.col("new")).alias("value")))
        discard(before)
