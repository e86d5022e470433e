"""A ledger of reservations under caps: what each entry of a log does, in the log's order.

A reservation is held if what is reserved and settled with it stays within the member's cap and the period's; else it is refused and changes nothing.  Settling moves its
amount out of what is reserved and adds what was billed, releasing only moves it out, and one whose bill is unknown stays reserved.  Each happens once; a repeat
of it changes nothing, another change of what is over is invalid, and one of what was never held is missing.

Members are folded apart, each in the order of its entries, with its own cap only.  The period's cap is then held against running sums over the period, made range by range.  Where it never
binds that is the result; only periods in which it does are folded again as a whole, entry by entry, in one task that keeps its counters and reservations' states.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.lineage import cut
from folioscope.operators.packing import running
from folioscope.sizes import small

#: From which states a reservation may come into one.
FROM = {"settled": ("held", "unknown"), "released": ("held", "unknown"), "unknown": ("held",)}
TARGET = {"settle": "settled", "release": "released", "unknown": "unknown"}
_IN = ["period", "member_id", "at", "seq", "op", "rid", "micros", "member_cap", "lab_cap"]


class Ledger:
    """The counters and reservations of one period, or of one member in it."""

    def __init__(self, with_lab: bool) -> None:
        self.with_lab, self.lab, self.members, self.states = with_lab, 0, {}, {}

    def enter(self, member, op: str, rid, micros: int | None, member_cap: int | None, lab_cap: int | None) -> tuple:
        """outcome, refused_by, available, and the change of what is used; the member's counters change in place."""
        own = self.members.setdefault(member, [0, 0])
        if op == "reserve":
            for scope, cap, used in (("lab", lab_cap if self.with_lab else None, self.lab), ("member", member_cap, own[0] + own[1])):
                if cap is not None and used + micros > cap:
                    return "refused", scope, max(cap - used, 0), 0
            if rid in self.states:
                return "invalid", None, None, 0
            self.states[rid] = ("held", micros)
            own[0] += micros
            self.lab += micros
            return "held", None, None, micros
        state, held = self.states.get(rid, (None, 0))
        target = TARGET.get(op)
        if state is None or target is None:
            return "missing" if target else "invalid", None, None, 0
        if state == target:
            return "same", None, None, 0
        if state not in FROM[target]:
            return "invalid", None, None, 0
        self.states[rid] = (target, held)
        if target == "unknown":
            return target, None, None, 0
        billed = (micros or 0) if target == "settled" else 0
        own[0] -= held
        own[1] += billed
        self.lab += billed - held
        return target, None, None, billed - held


def _folded(group: list[str], with_lab: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ledger = None, Ledger(with_lab)
        for batch in batches:
            rows = {c: batch.column(c).to_pylist() for c in _IN}
            out = []
            for i in range(batch.num_rows):
                key = tuple(rows[c][i] for c in group)
                if key != now:
                    now, ledger = key, Ledger(with_lab)
                member = rows["member_id"][i]
                found = ledger.enter(member, *[rows[c][i] for c in ("op", "rid", "micros", "member_cap", "lab_cap")])
                out.append((*found, *ledger.members[member]))
            cols = list(zip(*out)) if out else [()] * 6
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            added = [pa.array(list(c), k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "outcome", "refused_by", "available", "delta", "reserved", "settled"])

    return run


def ledger(log: DataFrame) -> DataFrame:
    """``log`` with outcome, refused_by (lab, member), available (to a refused one), and the member's reserved and settled after the entry.

    ``log``: period, member_id, at, seq (the order, total), op (reserve, settle, release, unknown), rid, micros, member_cap, lab_cap (null: no cap).
    """
    slim = log.select("period", "member_id", "at", "seq", "op", "rid", *[F.col(c).cast("long").alias(c) for c in ("micros", "member_cap", "lab_cap")])
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in slim.schema)}, outcome string, refused_by string, available long, delta long, reserved long, settled long"
    fold = lambda d, group, lab: d.repartition(*group).sortWithinPartitions(*group, "at", "seq").mapInArrow(_folded(group, lab), schema)
    apart = cut(fold(slim, ["period", "member_id"], False))
    over = running(apart.where("lab_cap is not null"), "period", "at", "seq", value="delta").where((F.col("op") == "reserve") & (F.col("outcome") == "held") & (F.col("before") + F.col("delta") > F.col("lab_cap")))
    bound = small(cut(over.select(F.col("period").alias("p")).distinct()))
    same = F.col("period").eqNullSafe(F.col("p"))
    whole = fold(slim.join(bound, same, "left_semi"), ["period"], True)
    return apart.join(bound, same, "left_anti").unionByName(whole).drop("delta")
