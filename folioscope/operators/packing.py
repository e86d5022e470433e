"""Sequential packing: byte budgets, size-bounded batches and their merges, trimming to a limit.

None of it takes a group into one task, however many rows the group has.  ``batches`` cuts a group's order into chunks; what a chunk does to
the room that is left when it begins is a step function of that room, found by range searches on prefix sums, and chunks' functions are composed.
``allocate`` folds only the rows that can be granted anything, of which a budget allows a bounded number.  The rest are windows and sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.lineage import cut
from folioscope.sizes import small

#: Items of a chunk.
CHUNK = 1 << 16


def granted(rows: pa.Table, budget: int, slots: int) -> pa.Table:
    """question, at, granted of the rows of one question that get room, in the order of ``at``."""
    left, last, used, share, out = budget, None, 0, 0, []
    for at, nth, first, size in sorted(zip(*[rows.column(c).to_pylist() for c in ("at", "doc_nth", "first", "size")])):
        if nth != last:
            last, used, share = nth, 0, left // max(1, slots + 1 - nth)
        if size <= (left if first else min(left, share - used)):
            used, left = used + size, left - size
            out.append((at, size))
    question = rows.column("question")[0].as_py()
    return pa.table({"question": pa.array([question] * len(out), pa.int64()), "at": pa.array([a for a, _ in out], pa.int64()), "granted": pa.array([n for _, n in out], pa.int64())})


def allocate(parts: DataFrame, budget: int, slots: int) -> DataFrame:
    """question, doc_id, ord, granted, reason: a shared budget over documents in rank order.

    A document may use what is left over the slots that are left; its first section needs only what is
    left at all; room that isn't used flows on.

    Only documents of the first ``slots`` ranks can get room.  In a document the room that a section may use only shrinks, so if one gets room, all earlier ones of its size
    did: of each size only the first budget // size (and the document's first section) are candidates, and these (a bound that the budget gives) are folded.  The reasons of all others follow from
    running sums of what was granted, made range by range.
    """
    slim = parts.select(F.col("question").cast("long").alias("question"), "rank", F.col("ord").cast("int").alias("ord"), F.col("doc_id").cast("long").alias("doc_id"), F.col("size").cast("long").alias("size"))
    nth = F.row_number().over(Window.partitionBy("question").orderBy("rank"))
    docs = cut(slim.select("question", "rank").distinct().withColumn("doc_nth", nth).where(F.col("doc_nth") <= slots))
    d = small(docs).select(F.col("question").alias("q"), F.col("rank").alias("r"), "doc_nth")
    all_ = slim.join(d, (F.col("question") == F.col("q")) & (F.col("rank") == F.col("r")), "left").drop("q", "r")
    placed = cut(positions(all_.where("doc_nth is not null"), "question", "rank", "ord", "doc_id", "size"))
    starts = cut(placed.groupBy("question", "doc_nth").agg(F.min("at").alias("start")))
    s = small(starts).select(F.col("question").alias("q"), F.col("doc_nth").alias("n"), "start")
    placed = placed.join(s, (F.col("question") == F.col("q")) & (F.col("doc_nth") == F.col("n"))).drop("q", "n").withColumn("first", F.col("at") == F.col("start"))
    can = placed.where((F.col("size") > 0) & (F.col("size") <= budget)).select("question", "at", "doc_nth", "first", "size", F.struct("question", "doc_nth", "size").alias("alike"))
    can = positions(can.withColumnRenamed("at", "place"), "alike", "place").where(F.col("first") | (F.col("at") <= F.floor(budget / F.col("size")))).select("question", F.col("place").alias("at"), "doc_nth", "first", "size")
    got = cut(can.groupBy("question").applyInArrow(lambda t: granted(t, budget, slots), "question long, at long, granted long"))
    g = got.select(F.col("question").alias("q"), F.col("at").alias("a"), "granted")
    met = placed.join(g, (F.col("question") == F.col("q")) & (F.col("at") == F.col("a")), "left").drop("q", "a").withColumn("granted", F.coalesce("granted", F.lit(0).cast("long")))
    sums = cut(running(met, "question", "at", value="granted"))
    opened = sums.where("first").select(F.col("question").alias("q"), F.col("doc_nth").alias("n"), F.col("before").alias("spent"))
    o = small(cut(opened))
    rows = sums.join(o, (F.col("question") == F.col("q")) & (F.col("doc_nth") == F.col("n"))).drop("q", "n")
    room, share = budget - F.col("before"), F.floor((budget - F.col("spent")) / F.greatest(F.lit(1), slots + 1 - F.col("doc_nth")))
    free = F.col("first") | (share - (F.col("before") - F.col("spent")) >= 0)  # a section of no bytes
    ok = (F.col("granted") > 0) | ((F.col("size") <= 0) & free)
    reason = F.when(ok, None).when(F.col("size") > room, "over budget").otherwise("over share")
    done = rows.select("question", "doc_id", "ord", "granted", reason.alias("reason"))
    return done.unionByName(all_.where("doc_nth is null").select("question", "doc_id", "ord", F.lit(0).cast("long").alias("granted"), F.lit("no slot").alias("reason")))


def positions(df: DataFrame, by: str, *order: str) -> DataFrame:
    """``df`` with ``at``, each row's place (from 0) in its group by the order, which must be total.

    Rows are dealt out by ranges of (group, order), each range counts its rows of a group, and the counts' prefix sums (a row for each group and range)
    give every range its offset: a group of any size is spread over many tasks.
    """
    return running(df, by, *order).drop("before")


def running(df: DataFrame, by: str, *order: str, value: str | None = None) -> DataFrame:
    """``df`` with ``at`` as ``positions`` gives it (or its own) and ``before``, the sum of ``value`` over the rows before in the group."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once: the bounds of the ranges are sampled, so a second evaluation could cut elsewhere.
    ranged = cut(df.repartitionByRange(parts, by, *order).withColumn("__part", F.spark_partition_id()))
    own_value = F.col(value) if value else F.lit(0)
    n = ranged.groupBy(F.col(by).alias("__by"), F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__n"), F.sum(own_value).alias("__s"))
    earlier = Window.partitionBy("__by").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = n.select("__by", "__p", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("__n", "__s")])
    inside = Window.partitionBy(by, "__part").orderBy(*order)
    sums = F.coalesce(F.sum(own_value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = ranged.withColumn("__nth", F.row_number().over(inside) - 1).withColumn("__sum", sums)
    met = own.join(offsets, own[by].eqNullSafe(offsets["__by"]) & (own["__part"] == offsets["__p"]))
    at = [] if "at" in df.columns else [(F.col("__n0") + F.col("__nth")).alias("at")]
    return met.select(*df.columns, *at, (F.col("__s0") + F.col("__sum")).alias("before"))


def weights(sizes: np.ndarray, room: int) -> np.ndarray:
    """Sizes as a batch of ``room`` sees them: what is larger than all of it closes its batch, so one more is as good as any."""
    return np.minimum(sizes, room + 1)


def steps(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """What a chunk does to the room that is left of the batch it begins in.

    (low, left, new, total): for a room from low[k] to below low[k + 1] the chunk ends with left[k] and opens new[k] batches; a room of at least the chunk's
    ``total`` only shrinks by it.  -1 is a closed batch, in which nothing fits.
    """
    w = weights(sizes, room)
    upto = np.concatenate(([0], np.cumsum(w)))
    n = len(w)
    # A batch that begins at i ends before the first sum beyond its room; it holds i at least.
    after = np.maximum(np.searchsorted(upto[1:], upto[:-1] + room, side="right"), np.arange(1, n + 1))
    last, opened, to = np.arange(n), np.ones(n, np.int64), np.append(after, n)
    while (to[:-1] < n).any():  # pointer doubling over the batches of the chunk
        go = to[:-1] < n
        at = to[:-1][go]
        last[go], opened[go] = last[at], opened[go] + opened[at]
        to = np.append(np.where(go, to[np.minimum(to[:-1], n)], n), n)
    left = np.maximum(room - (upto[n] - upto[last]), -1)
    # The first item that does not fit a room r is the first with a sum above r: one step for each sum up to the whole room.
    first = np.flatnonzero(upto[:-1] <= room)
    first = first[np.concatenate(([True], upto[first][1:] != upto[first][:-1]))] if len(first) else first
    starts = np.searchsorted(upto[1:], np.concatenate(([-1], upto[first])), side="right")
    low = np.concatenate(([-1], upto[first]))
    inside = starts < n
    low, starts = low[inside], starts[inside]
    new = np.ones(len(low), bool)
    new[1:] = (left[starts][1:] != left[starts][:-1]) | (opened[starts][1:] != opened[starts][:-1])
    return low[new], left[starts][new], opened[starts][new], int(upto[n])


def after(low: list[int], left: list[int], new: list[int], total: int, room: int) -> tuple[int, int]:
    """The room after a chunk that began with ``room``, and how many batches it opened."""
    if total <= room:
        return room - total, 0
    k = int(np.searchsorted(low, room, side="right")) - 1
    return left[k], new[k]


def numbered(sizes: np.ndarray, room: int, entry: int, batch: int) -> np.ndarray:
    """The batch of each item of a chunk that begins with ``entry`` left of ``batch``."""
    upto = np.concatenate(([0], np.cumsum(weights(sizes, room))))
    n, edges = len(sizes), []
    at = int(np.searchsorted(upto[1:], entry, side="right"))
    while at < n:
        edges.append(at)
        at = max(at + 1, int(np.searchsorted(upto[1:], upto[at] + room, side="right")))
    marks = np.zeros(n, np.int64)
    marks[edges] = 1
    return batch + np.cumsum(marks)


def batches(items: DataFrame, budget: int, header: int = 0) -> DataFrame:
    """grp, item, batch, taken of (grp, item, pos, size): items in order, a new batch when the next would exceed the budget with the header; one larger than the budget is cut and alone.

    Items are dealt out by ranges of (grp, pos) and stored in chunks of one group each, with each chunk's step function.  A group's functions, a few numbers for each CHUNK items, are
    composed in order; then every chunk numbers its own items.
    """
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    room = budget - header

    def chunks(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, group, held = TaskContext.get().partitionId(), 0, None, []

        def chunk() -> pa.RecordBatch:
            item, size = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            low, left, new, total = steps(size, room)
            lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (item, size, low, left, new)]
            return pa.RecordBatch.from_arrays([pa.array([group], pa.string()), pa.array([part], pa.int32()), pa.array([nth], pa.int32()), *lists, pa.array([total], pa.int64())], names=["grp", "part", "nth", "item", "size", "low", "left", "new", "total"])

        for batch in found:
            names = batch.column("grp").to_pylist()
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            item, size = batch.column("item").to_numpy(zero_copy_only=False), batch.column("size").to_numpy(zero_copy_only=False)
            for a, b in zip(cuts, cuts[1:]):
                if held and (names[a] != group or sum(len(h[0]) for h in held) + b - a > CHUNK):
                    yield chunk()
                    nth, held = nth + 1, []
                group = names[a]
                held.append((item[a:b].astype(np.int64), size[a:b].astype(np.int64)))
        if held:
            yield chunk()

    def composed(t: pa.Table) -> pa.Table:
        left, batch, out = -1, -1, []
        for part, nth, low, to, new, total in sorted(zip(*[t.column(c).to_pylist() for c in ("part", "nth", "low", "left", "new", "total")]), key=lambda r: r[:2]):
            out.append((t.column("grp")[0].as_py(), part, nth, left, batch))
            left, opened = after(low, to, new, total, left)
            batch += opened
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=["grp", "part", "nth", "entry", "batch"])

    def written(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for i in range(b.num_rows):
                item, size = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("item", "size"))
                batch = numbered(size, room, b.column("entry")[i].as_py(), b.column("batch")[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array([b.column("grp")[i].as_py()] * len(item), pa.string()), pa.array(item), pa.array(batch, pa.int32()), pa.array(np.minimum(size, budget))], names=["grp", "item", "batch", "taken"])

    slim = items.select(F.col("grp").cast("string").alias("grp"), F.col("pos").cast("long").alias("pos"), F.col("item").cast("long").alias("item"), F.col("size").cast("long").alias("size"))
    order = ["grp", "pos", "item", "size"]
    ranged = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    stored = cut(ranged.mapInArrow(chunks, "grp string, part int, nth int, item array<long>, size array<long>, low array<long>, left array<long>, new array<long>, total long"))
    entries = stored.select("grp", "part", "nth", "low", "left", "new", "total").groupBy("grp").applyInArrow(composed, "grp string, part int, nth int, entry long, batch long")
    e = small(cut(entries)).select(F.col("grp").alias("g"), F.col("part").alias("p"), F.col("nth").alias("n"), "entry", "batch")
    met = stored.join(e, F.col("grp").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")) & (F.col("nth") == F.col("n")))
    return met.select("grp", "item", "size", "entry", "batch").mapInArrow(written, "grp string, item long, batch int, taken long")


def merge_tree(batched: DataFrame, fan: int = 15) -> DataFrame:
    """grp, level, node, first, last: which partials of the level below each page is merged from, ``fan`` at a time, up to one page; level 0 are the batches."""
    n = batched.groupBy("grp").agg((F.max("batch") + 1).alias("n"))
    step = lambda s: F.ceil(s / F.lit(fan)).cast("int")
    # Sizes of the levels: more than eight of them would need fan ** 8 batches.
    sizes = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.array(F.col("n").cast("int")), lambda a, _: F.when(F.element_at(a, -1) > 1, F.concat(a, F.array(step(F.element_at(a, -1))))).otherwise(a))
    levels = n.select("grp", sizes.alias("sizes")).select("grp", "sizes", F.posexplode("sizes").alias("level", "size"))
    below = F.when(F.col("level") > 0, F.col("sizes")[F.col("level") - 1])
    nodes = levels.select("grp", "level", below.alias("below"), F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("node"))
    return nodes.select("grp", "level", "node", F.when(F.col("level") > 0, F.col("node") * fan).otherwise(F.col("node")).alias("first"), F.when(F.col("level") > 0, F.least(F.col("node") * fan + fan, F.col("below")) - 1).otherwise(F.col("node")).alias("last"))


def trimmed(parts: DataFrame, limit: int) -> DataFrame:
    """grp, kept, dropped, bytes of (grp, kind, pos, size): passages go first, all of them, then excerpts from the end, until the rest fits; else nothing."""
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("size")).otherwise(0))
    n = lambda k: F.count_if(F.col("kind") == k)
    sums = parts.groupBy("grp").agg(of("base").alias("base"), of("passage").alias("p"), of("excerpt").alias("e"), n("passage").alias("n_p"), n("excerpt").alias("n_e"))
    upto = F.sum("size").over(Window.partitionBy("grp").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    runs = parts.where("kind = 'excerpt'").select("grp", upto.alias("upto")).join(sums.select("grp", "base"), "grp").where(F.col("base") + F.col("upto") <= limit)
    fit = runs.groupBy("grp").agg(F.count(F.lit(1)).alias("fit"), F.max("upto").alias("used"))
    total = F.col("base") + F.col("p") + F.col("e")
    whole, fits = total <= limit, (total <= limit) | (F.col("base") <= limit)
    kept = F.when(whole, F.col("n_p") + F.col("n_e")).otherwise(F.coalesce("fit", F.lit(0)))
    return sums.join(fit, "grp", "left").select("grp", F.when(fits, kept).alias("kept"), F.when(fits, F.col("n_p") + F.col("n_e") - kept).otherwise(F.col("n_p") + F.col("n_e")).alias("dropped"), F.when(whole, total).when(fits, F.col("base") + F.coalesce("used", F.lit(0))).alias("bytes"))


def searched(files: DataFrame, most: int) -> DataFrame:
    """``files`` (stem, doc_id, n_chars, skipped, hits) with place, state and matches: smallest first, until ``most`` matches of a stem are found."""
    order = Window.partitionBy("stem").orderBy("n_chars", "doc_id")
    open_ = F.col("skipped").isNull()
    before = F.coalesce(F.sum(F.when(open_, F.col("hits"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    f = files.withColumn("before", before).withColumn("place", F.row_number().over(order))
    reached = F.col("before") < most
    return f.withColumn("state", F.when(~open_, F.col("skipped")).when(reached, "searched").otherwise("not reached")).withColumn("matches", F.when(open_ & reached, F.least(F.col("hits").cast("long"), most - F.col("before"))).otherwise(0).cast("long"))


#: The marks of parts that lost rows or cells, and the stages of narrowing: characters of a cell and cells of a row.
ROWS_CUT, CELLS_CUT = ', "rows_cut_to_fit": true', ', "cells_cut_to_fit": {{"chars": {}, "columns": {}}}'
STAGES = [(80, 60), (40, 30), (20, 15)]


def written_size(no: Column, cells: Column) -> Column:
    """Characters of a row as JSON: its number and a list of its cells."""
    each = F.aggregate(cells, F.lit(0), lambda n, c: n + F.length(F.to_json(F.array(c))) - 2)
    return (6 + F.length(no.cast("string")) + each + 2 * F.greatest(F.size(cells) - 1, F.lit(0))).cast("long")


def narrowed(cells: Column, chars: int, width: int) -> Column:
    return F.transform(F.slice(cells, 1, width), lambda c: F.when(F.length(c) <= chars, c).otherwise(F.concat(F.left(c, F.lit(chars)), F.lit("…"))))


def fitted(rows: DataFrame, frames: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The rows (resp, part, no, cells) that a response of at most ``limit`` characters keeps, and (resp, size, stage, cut): its size, how far cells were narrowed (0: not), and whether even that is too long.

    ``rows``: resp, part, header (boolean), nth (its place in the part, from 1), no, cells; ``frames``: resp and the characters around the rows.  While a response is too long its longest part loses the last row (of
    equally long ones the first part), but each keeps one; then cells are narrowed in three stages.  Popping from the longest takes rows by their place from the end, level by level, so what goes is a
    beginning of that order, and running sums of what it saves, made range by range, show how far it goes.
    """
    r = rows.withColumn("len", written_size(F.col("no"), F.col("cells")))
    for k, (chars, width) in enumerate(STAGES, 1):
        r = r.withColumn(f"len{k}", written_size(F.col("no"), narrowed(F.col("cells"), chars, width)))
    r = cut(r)
    n = r.where("not header").groupBy("resp", "part").agg(F.max("nth").alias("n"))
    parts = r.groupBy("resp", "part").agg(F.sum("len").alias("s"), F.greatest(F.count_if("header") - 1, F.lit(0)).alias("h"), F.greatest(F.count_if(~F.col("header")) - 1, F.lit(0)).alias("b"), F.count(F.lit(1)).alias("m"))
    full = parts.groupBy("resp").agg(F.sum(F.col("s") + 2 * (F.col("h") + F.col("b"))).alias("held"), F.count(F.lit(1)).alias("parts"))
    sizes = cut(frames.join(full, "resp", "left").select("resp", (F.col("frame") + F.coalesce("held", F.lit(0))).alias("whole"), F.coalesce("parts", F.lit(0)).alias("parts"), "frame"))
    can = r.where("not header and nth > 1").join(small(cut(n)), ["resp", "part"])
    can = can.select("resp", "part", "nth", (-F.col("nth")).alias("level"), (F.col("len") + 2 - F.when(F.col("nth") == F.col("n"), len(ROWS_CUT)).otherwise(0)).alias("saves"))
    order = running(can, "resp", "level", "part", value="saves").join(small(sizes), "resp")
    gone = cut(order.where(F.col("whole") - F.col("before") > limit).select("resp", "part", "nth", "saves"))
    left = gone.groupBy("resp", "part").agg((F.min("nth") - 1).alias("kept"), F.sum("saves").alias("saved"))
    left = small(cut(left))
    saved = left.groupBy("resp").agg(F.sum("saved").alias("saved"))
    kept = r.join(left.select(F.col("resp").alias("g"), F.col("part").alias("p"), "kept"), F.col("resp").eqNullSafe(F.col("g")) & F.col("part").eqNullSafe(F.col("p")), "left").where(F.col("header") | F.col("kept").isNull() | (F.col("nth") <= F.col("kept")))
    marks = [len(CELLS_CUT.format(c, w)) for c, w in STAGES]
    narrow = kept.groupBy("resp").agg(*[F.sum(F.col("len") - F.col(f"len{k}")).alias(f"less{k}") for k in (1, 2, 3)])
    now = sizes.join(saved, "resp", "left").join(narrow, "resp", "left").withColumn("size0", F.col("whole") - F.coalesce("saved", F.lit(0)))
    for k, mark in enumerate(marks, 1):
        now = now.withColumn(f"size{k}", F.col("size0") - F.coalesce(f"less{k}", F.lit(0)) + mark * F.col("parts"))
    stage = F.when(F.col("size0") <= limit, 0).when(F.col("size1") <= limit, 1).when(F.col("size2") <= limit, 2).otherwise(3)
    of = F.when(F.col("stage") == 0, F.col("size0")).when(F.col("stage") == 1, F.col("size1")).when(F.col("stage") == 2, F.col("size2")).otherwise(F.col("size3"))
    now = cut(now.withColumn("stage", stage).withColumn("size", of).select("resp", F.least("size", F.lit(limit)).alias("size"), "stage", (F.col("size") > limit).alias("cut")))
    cells = F.col("cells")
    for k, (chars, width) in enumerate(STAGES, 1):
        cells = F.when(F.col("stage") == k, narrowed(F.col("cells"), chars, width)).otherwise(cells)
    out = kept.select("resp", "part", "header", "nth", "no", "cells").join(small(now.select("resp", "stage")), "resp").select("resp", "part", "header", "nth", "no", cells.alias("cells"))
    return out, now
