"""Codes of vectors by parts: codebooks of integers from a few rounds of Lloyd's algorithm, kept cheap by heaps (heap Lloyd).

A vector's components become integers floor(scale * x) and are cut into equal parts; each part position has its own codebook,
whose entries begin as the parts of the vectors with the smallest ids.  A round gives every part its nearest entry (squared distance, ties to the
lower index) and replaces each entry by its parts' floored mean; an entry without parts stays.

A part's slack is how much farther its second nearest entry is than its own.  Each entry of a block of rows has a heap of its parts, keyed by slack
plus the entry's cumulative drift when the part came in.  After a round an entry's drift grows by its own move and the largest move of another entry; only parts
whose key the drift has passed can have a new nearest entry.  They are popped, compared with all entries exactly, and pushed on the heap of their entry.
Distances are exact integers; keys are rounded down by more than their error, so that ties and doubts are popped.

Blocks (``BLOCK`` rows: integers, heaps, sums) are rows of one table that the first pass writes.  Later passes read it and replay the pops of the rounds since, so
nothing else is written, a lost executor's blocks are replayed from the table, and a task holds one block.  Rounds send sums by (part, entry, component), of which there are as many
as numbers in the codebooks.

Defined results: rows whose vector is null, holds null, NaN or infinity are dropped, as are those whose length isn't
the most common one (of equally common ones the smaller) among positive multiples of the number of parts; components are held between -LIMIT and LIMIT after scaling, so that squared distances fit 64 bits; a null
id is after all others, and equal ids come by their vectors, for choosing first entries; repeated rows count and are returned as often as they came; fewer rows than
entries give fewer entries; null labels are one label; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioscope.llm.common import bounded_batches, cut, small

#: Rows of a block; rows times parts must fit 16 bits.
BLOCK = 4096
LIMIT = 1 << 26
#: Distances below this are whole numbers that a double holds exactly, with what they are summed from.
EXACT = 1 << 52


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -LIMIT, LIMIT).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each part, its squared distance, and the next entry's (infinity if there is none)."""
    most = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * x.shape[1] * most * most < EXACT:
        own = (x * x).sum(1)
        d = x.astype(np.float64) @ (-2.0 * book.T) + (book * book).sum(1).astype(np.float64) + own[:, None].astype(np.float64)
    else:
        d = np.stack([((x - e) ** 2).sum(1) for e in book], 1)
    rows, at = np.arange(len(x)), d.argmin(1)
    best = d[rows, at].astype(np.int64)
    d = d.astype(np.float64, copy=False)
    d[rows, at] = np.inf
    return at, best, d.min(1)


def slack(best: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How far the bounds of a part are apart, rounded down."""
    upper, lower = np.sqrt(best.astype(np.float64)), np.sqrt(second)
    sure = np.where(np.isinf(lower), 0.0, lower)
    return np.where(np.isinf(lower), np.inf, (sure - upper) - 1e-9 * (sure + upper) - 1e-9)


class Heaps:
    """A heap for each cell, in arrays: node i of a cell has the children 2i+1 and 2i+2.

    A layer holds the heaps of what one round pushed.  A popped node stays in its place and only counts as gone.
    """

    def __init__(self, cells: int) -> None:
        self.cells, self.layers = cells, []

    def push(self, cells: np.ndarray, items: np.ndarray, keys: np.ndarray) -> None:
        by = np.lexsort((keys, cells))  # sorted runs are heaps
        self.layer(np.bincount(cells, minlength=self.cells), items[by], keys[by])

    def layer(self, counts: np.ndarray, items: np.ndarray, keys: np.ndarray) -> None:
        self.layers.append((np.cumsum(counts) - counts, counts, items, keys, np.ones(len(items), bool)))

    def pop(self, limits: np.ndarray) -> np.ndarray:
        """The items whose keys are at most their cell's limit; nodes below a larger key are never looked at."""
        out = [np.zeros(0, np.int64)]
        for starts, counts, items, keys, live in self.layers:
            cell = np.flatnonzero(counts)
            node = np.zeros(len(cell), np.int64)
            while len(cell):
                at = starts[cell] + node
                under = keys[at] <= limits[cell]
                cell, node, at = cell[under], node[under], at[under]
                out.append(items[at[live[at]]].astype(np.int64))
                live[at] = False
                cell, node = np.concatenate((cell, cell)), np.concatenate((2 * node + 1, 2 * node + 2))
                inside = node < counts[cell]
                cell, node = cell[inside], node[inside]
        return np.concatenate(out)


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By how much the bounds of an entry's parts may have come together: the entry's own move and the largest of another's."""
    moved = np.sqrt(((new - old).astype(np.float64) ** 2).sum(2))
    top = np.sort(moved, 1)
    largest = np.where(moved == top[:, -1:], top[:, -2:-1] if moved.shape[1] > 1 else 0.0, top[:, -1:])
    # Of equal largest moves another one is as large.
    largest = np.where((moved == top[:, -1:]).sum(1, keepdims=True) > 1, top[:, -1:], largest)
    return ((moved + largest) * (1 + 1e-9)).ravel()


class Block:
    """The parts of some rows, the entry of each, and the heaps."""

    def __init__(self, x: np.ndarray, parts: int, entries: int) -> None:
        self.x, self.parts, self.entries = x.reshape(len(x) * parts, -1), parts, entries
        self.heaps, self.drift, self.scanned = Heaps(parts * entries), np.zeros(parts * entries), 0
        self.of = np.zeros(len(self.x), np.int64)

    def rescan(self, items: np.ndarray, books: np.ndarray) -> np.ndarray:
        """Compares the items with all entries, pushes them, and returns by how much sums and counts change."""
        sums = np.zeros((self.parts * self.entries, self.x.shape[1] + 1), np.int64)
        cells, keys, position = np.empty(len(items), np.int64), np.empty(len(items)), items % self.parts
        for p in range(self.parts):
            own = np.flatnonzero(position == p)
            if len(own):
                at, best, second = nearest(self.x[items[own]], books[p])
                cells[own], keys[own] = p * self.entries + at, slack(best, second)
        with_one = np.column_stack((self.x[items], np.ones(len(items), np.int64)))
        np.add.at(sums, cells, with_one)
        if self.heaps.layers:
            np.subtract.at(sums, self.of[items], with_one)
        self.of[items] = cells
        self.scanned += len(items)
        self.heaps.push(cells, items, keys + self.drift[cells])
        return sums

    def move(self, old: np.ndarray, new: np.ndarray) -> np.ndarray:
        """The books have changed from ``old`` to ``new``: pops and rescans what may have another entry now."""
        self.drift = self.drift + drifts(old, new)
        return self.rescan(self.heaps.pop(self.drift), new)

    def errors(self, books: np.ndarray) -> np.ndarray:
        apart = self.x - books.reshape(self.parts * self.entries, -1)[self.of]
        return (apart * apart).sum(1).reshape(-1, self.parts).sum(1)


def updated(books: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Floored means; entries without parts stay."""
    parts, entries, width = books.shape
    table = sums.reshape(parts, entries, width + 1)
    counts = table[:, :, -1:]
    return np.where(counts > 0, table[:, :, :-1] // np.maximum(counts, 1), books)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


@dataclass
class Codes:
    """``rows``: vec_id, label, code, error.  ``books``: the final entries by part, entry, component."""

    rows: DataFrame
    books: np.ndarray


def _kept(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def first_entries(df: DataFrame, vec_id: str, vector: str, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """The integers of the vectors with the smallest ids, by part; None for a table without vectors."""
    kept = df.select(F.col(vec_id).alias("i"), F.col(vector).alias("v")).where(_kept(F.col("v")) & (F.size("v") > 0) & (F.size("v") % parts == 0))
    common = kept.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if common is None:
        return None
    first = kept.where(F.size("v") == common.width).orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).collect()  # ``entries`` rows
    width = common.width
    x = integers(np.array([r.v for r in first], np.float64), scale)
    return x.reshape(len(x), parts, width // parts).transpose(1, 0, 2).copy()


def _vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that are kept, and their vectors."""
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False))
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)  # nulls are NaN
    fine = np.isfinite(x).all(1)
    return at[fine], x[fine]


def _narrow(x: np.ndarray) -> tuple[str, bytes]:
    kind = next(t for t in (np.int16, np.int32) if np.abs(x).max(initial=0) <= np.iinfo(t).max)
    return np.dtype(kind).str, x.astype(kind).tobytes()


def _down(keys: np.ndarray) -> np.ndarray:
    return np.nextafter(keys.astype(np.float32), np.float32(-np.inf))


def _opened(row: dict, parts: int, entries: int) -> Block:
    n = len(row["ids"])
    block = Block(np.frombuffer(row["x"], row["kind"]).astype(np.int64).reshape(n, -1), parts, entries)
    items, counts = np.frombuffer(row["items"], np.uint16), np.frombuffer(row["counts"], np.int32)
    block.of[items] = np.repeat(np.arange(parts * entries), counts)
    block.heaps.layer(counts.astype(np.int64), items, np.frombuffer(row["keys"], np.float32))
    return block


def _added(changes: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row for each number of the sum of the changes that isn't 0."""
    total = None
    for c in changes:
        total = c.copy() if total is None else total + c
    if total is not None:
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at], pa.int64())], names=["slot", "value"])


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for r in rows.groupBy("slot").agg(F.sum("value").alias("value")).collect():  # as many as numbers in the codebooks
        out[r.slot] = r.value
    return out


def encode(df: DataFrame, vec_id: str, vector: str, label: str, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codes:
    """Codebooks after ``rounds`` rounds, and every kept row's code (two hex digits a part) and error (squared distances summed over its parts)."""
    if not 0 < entries <= 256 or BLOCK * parts > 1 << 16:
        raise ValueError("at most 256 entries and 16 parts")
    bounded_batches(df.sparkSession)
    id_type, label_type = df.schema[vec_id].dataType, df.schema[label].dataType
    plain = f"vec_id {id_type.simpleString()}, label {label_type.simpleString()}, code string, error long"
    books = first_entries(df, vec_id, vector, parts, entries, scale)
    if books is None:
        return Codes(df.sparkSession.createDataFrame([], plain), np.zeros((parts, 0, 0), np.int64))
    entries, width = books.shape[1], books.shape[0] * books.shape[2]
    arrow_id, arrow_label = to_arrow_type(id_type), to_arrow_type(label_type)
    names = ["ids", "labels", "kind", "x", "items", "keys", "counts", "sums"]
    start = books

    def block_of(ids: list[pa.Array], labels: list[pa.Array], vectors: list[np.ndarray]) -> pa.RecordBatch:
        x = integers(np.concatenate(vectors), scale)
        block = Block(x, parts, entries)
        sums = block.rescan(np.arange(len(block.x)), start)
        _, counts, items, keys, _ = block.heaps.layers[0]
        kind, packed = _narrow(x)
        one = lambda a, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.concat_arrays([y.cast(t) for y in a]))
        blobs = [packed, items.astype(np.uint16).tobytes(), _down(keys).tobytes(), counts.astype(np.int32).tobytes(), sums.tobytes()]
        return pa.RecordBatch.from_arrays([one(ids, arrow_id), one(labels, arrow_label), pa.array([kind]), *[pa.array([b], pa.binary()) for b in blobs]], names=names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, held = [], [], [], 0
        for batch in batches:
            at, x = _vectors(batch.column(2), width)
            for k in range(0, len(at), BLOCK):
                own = slice(k, k + BLOCK)
                if held + len(at[own]) > BLOCK:
                    yield block_of(ids, labels, vectors)
                    ids, labels, vectors, held = [], [], [], 0
                rows = pa.array(at[own])
                ids.append(batch.column(0).take(rows))
                labels.append(batch.column(1).take(rows))
                vectors.append(x[own])
                held += len(at[own])
        if held:
            yield block_of(ids, labels, vectors)

    schema = f"ids array<{id_type.simpleString()}>, labels array<{label_type.simpleString()}>, kind string, x binary, items binary, keys binary, counts binary, sums binary"
    source = df.select(F.col(vec_id), F.col(label), F.col(vector) if "float" in df.schema[vector].dataType.simpleString() else F.col(vector).cast("array<double>"))
    blocks = cut(source.mapInArrow(first, schema))
    shape = (parts * entries, books.shape[2] + 1)
    size = shape[0] * shape[1]
    totals = _summed(blocks.select("sums").mapInArrow(lambda it: _added(np.frombuffer(b.as_py(), np.int64) for batch in it for b in batch.column(0)), "slot long, value long"), size)
    history = [books, updated(books, totals)] if rounds else [books]

    def replayed(batches: Iterator[pa.RecordBatch], history: list[np.ndarray]):
        """Each row of ``blocks`` with its block after the given books, and what the last of them changed."""
        for batch in batches:
            for row in _rows(batch):
                block, change = _opened(row, parts, entries), np.zeros(shape, np.int64)
                for old, new in zip(history, history[1:]):
                    change = block.move(old, new)
                yield row, block, change

    def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].values if c in ("ids", "labels") else batch.column(c)[i].as_py() for c in batch.schema.names}

    state = ["ids", "labels", *names[2:-1]]
    for _ in range(1, rounds):
        past = list(history)
        changes = blocks.select(*state).mapInArrow(lambda it, past=past: _added(c for _, _, c in replayed(it, past)), "slot long, value long")
        totals = totals + _summed(changes, size)
        history.append(updated(history[-1], totals))
    last = history[-1]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block, _ in replayed(batches, history):
            text = (block.of % entries).astype(np.uint8).tobytes().hex()
            codes = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([row["ids"], row["labels"], pa.array(codes, pa.string()), pa.array(block.errors(last), pa.int64())], names=["vec_id", "label", "code", "error"])

    return Codes(blocks.select(*state).mapInArrow(coded, plain), last)


def with_label_errors(codes: Codes) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, nulls together) and codebooks_sha256."""
    rows = cut(codes.rows)
    # Summed before it shuffles; a label's rows then meet one row, which is sent to them where the labels are few, and a hot label's join can be split.
    sums = small(cut(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))))
    joined = rows.join(sums, rows["label"].eqNullSafe(sums["of"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(codes.books)).alias("codebooks_sha256"))
