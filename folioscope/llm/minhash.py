"""Near duplicates: fast similarity sketches, bands, exact verification, components.

Sets.  Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z; a document's set is its distinct
shingles of ``width`` words (with fewer words, the whole sequence as one), as 64-bit hashes.

Sketches.  In round i < BINS every element falls into a random bin; in round BINS + j all elements fall
into bin j.  A bin keeps the least hash of the first round that fills it, so that after at most
2 * BINS rounds every coordinate is filled, after one or two for large sets, and the share of equal coordinates
is concentrated around the Jaccard similarity.

Candidates.  Documents with equal sets are one class.  BANDS bands of ROWS coordinates put classes into
buckets; a pair of similarity 0.8 misses all of them with probability (1 - 0.8**ROWS)**BANDS, under 1e-6.

Links.  Each member is compared with its bucket's first member, which settles most copies in one
comparison each: classes that are now in one component need no more comparing.  Each bucket that
still holds several components is cut into blocks of bounded size, and each pair of its blocks counts
all intersections exactly and gives a spanning forest of its links.  So no link is lost, and no pair
that isn't a link ever becomes a row.  Components come from contracting the graph of links.

Nothing that grows with the corpus reaches the driver, and every table that a loop reads again is
written to the shared checkpoint folder.

Defined results: documents without words (null, empty, white space) have an empty set and are linked with
nothing; in ``components`` a null doc_id is linked with nothing and has a null component, and rows that share a
doc_id share a component, whatever their texts; in ``representatives`` a row is a document.  Repeated rows
repeat; ties go to the least doc_id, then the least hash of the text; texts of any length are read whole; an
empty table gives an empty result; other columns are carried in a struct, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import ROW, bounded_batches, carried, cut, discard, slices, small
from folioscope.llm.linededup import among
from folioscope.llm.wordhash import mixed, words

BANDS, ROWS = 48, 6
BINS = BANDS * ROWS
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Sets and elements of a block; groups up to SMALL sets share tasks of about SHARED sets.
BLOCK, BLOCK_ELEMENTS, SMALL, SHARED = 800, 600_000, 64, 400
#: Elements in at least DENSE sets of a comparison are counted by matrix products over SLICE of them.
DENSE, SLICE = 24, 4096
SEEDS = np.random.default_rng(20170925).integers(1, 1 << 63, 2 * BINS + BANDS + 16, dtype=np.uint64)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted set of each text, one after the other, and where each begins (one more for the end)."""
    parts = [(t or "").encode("utf-8").translate(LOWER) for t in texts]
    data = np.frombuffer(b"\n".join(parts), np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    ws, _, h = words(data)
    first = np.searchsorted(ws, begins)
    out, at = [], [0]
    m = len(h)
    windows = max(0, m - width + 1)
    rolled = np.zeros(windows, np.uint64)
    for j in range(width):
        rolled += h[j : j + windows] * SEEDS[2 * BINS + BANDS + j]
    rolled = mixed(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            own = np.unique(rolled[a : b - width + 1])
        elif b > a:
            own = mixed(np.array([sum(int(x) * int(SEEDS[2 * BINS + BANDS + j]) for j, x in enumerate(h[a:b])) + (b - a) & int(FULL)], np.uint64))
        else:
            own = h[:0]
        out.append(own)
        at.append(at[-1] + len(own))
    return np.concatenate(out) if out else h[:0], np.array(at)


def sketches(elements: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of BINS coordinates for each set."""
    n = np.diff(at)
    out = np.full((len(n), BINS), FULL, np.uint64)
    active = np.flatnonzero(n)
    for i in range(2 * BINS):
        if not len(active):
            break
        own = np.repeat(np.arange(len(active)), n[active])
        if len(active) == len(n):
            e = elements
        else:
            keep = np.repeat(np.isin(np.arange(len(n)), active), n)
            e = elements[keep]
        x = mixed(e ^ SEEDS[i])
        new = np.full((len(active), BINS), FULL, np.uint64)
        if i < BINS:
            np.minimum.at(new.ravel(), own * BINS + (x % np.uint64(BINS)).astype(np.int64), x >> np.uint64(1))
        else:
            new[:, i - BINS] = np.minimum.reduceat(x >> np.uint64(1), np.cumsum(n[active]) - n[active])
        old = out[active]
        out[active] = np.where(old == FULL, new, old)
        active = active[(out[active] == FULL).any(axis=1)]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(sketch), BANDS), np.uint64)
    for b in range(BANDS):
        k = np.full(len(sketch), SEEDS[2 * BINS + b], np.uint64)
        for r in range(ROWS):
            k = mixed(k ^ sketch[:, b * ROWS + r])
        keys[:, b] = k
    return keys


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
    return total[at[1:]] - total[at[:-1]]


def signed_sets(df: DataFrame, width: int) -> DataFrame:
    """(key, doc_id, n, d1, d2, h, bands): the size and digest of each row's set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n in slices(batch.column(3), 512):
                part = batch.slice(a, n)
                e, at = sets(part.column(3).to_pylist(), width)
                keys = band_keys(sketches(e, at))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (part.num_rows + 1) * BANDS, BANDS), pa.int32()), _signed(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.diff(at), pa.int64()), _signed(_sums(mixed(e ^ SEEDS[0]), at)), _signed(_sums(mixed(e ^ SEEDS[1]), at)), bands], names=["key", "doc_id", "h", "n", "d1", "d2", "bands"])

    return df.select("key", "doc_id", "h", "text").mapInArrow(run, "key long, doc_id long, h long, n long, d1 long, d2 long, bands array<long>")


def keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, doc_id, h, text): a hash of the text, and the doc_id or, where it is null, that hash."""
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return df.select(F.coalesce(F.col(doc_id).cast("long"), h).alias("key"), F.col(doc_id).cast("long").alias("doc_id"), h.alias("h"), F.col(text).alias("text"))


def full_sets(df: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, elements) of the wanted (id, key, h, again); ``again``: other rows have that key too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n in slices(batch.column(1), 256):
                part = batch.slice(a, n)
                e, at = sets(part.column(1).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), _signed(e))], names=["id", "elements"])

    alone = df.select("key", "text").join(small(wanted.where("not again").select("id", "key")), "key").select("id", "text")
    rest = small(wanted.where("again").select("id", "key", "h"))
    again = df.select("key", "h", "text").join(rest, ["key", "h"]).groupBy("id").agg(F.min("text").alias("text"))
    return alone.unionByName(again).mapInArrow(run, "id long, elements array<long>")


def verified(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = pairs.join(own.select(F.col("id").alias("a"), F.col("elements").alias("ea")), "a")
    both = left.join(own.select(F.col("id").alias("b"), F.col("elements").alias("eb")), "b")
    inter = F.size(F.array_intersect("ea", "eb"))
    return both.select("a", "b", inter.alias("i"), (F.size("ea") + F.size("eb")).alias("s")).where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, label) after joining what the links (a, b) connect; a label is the least id of its component.

    Contraction: every label hooks on its least neighbour that is less, pointer jumping leads each to its
    tree's root, and the edges between different roots are the next round's, far fewer each time.
    """
    to = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
    edges = cut(links.join(to("a"), "a").join(to("b"), "b").where("la <> lb").select(F.greatest("la", "lb").alias("u"), F.least("la", "lb").alias("v")).distinct())
    steps = []
    while not edges.isEmpty():
        hook = cut(edges.groupBy("u").agg(F.min("v").alias("root")))
        while True:
            # Two jumps in a plan; whether the second still moved anything is written with it.
            ahead = hook.select(F.col("u").alias("root"), F.col("root").alias("next"))
            once = hook.join(ahead, "root", "left").select("u", F.coalesce("next", "root").alias("root"))
            twice = once.join(ahead, "root", "left").select("u", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
            before, hook = hook, cut(twice)
            discard(before)
            if hook.where("moved").isEmpty():
                break
        steps.append(hook)
        roots = hook.select("u", "root")
        far = hook.select(F.col("u").alias("v"), F.col("root").alias("rv"))
        near = edges.join(roots, "u").join(far, "v", "left").select("root", F.coalesce("rv", "v").alias("rv")).where("root <> rv")
        before, edges = edges, cut(near.select(F.greatest("root", "rv").alias("u"), F.least("root", "rv").alias("v")).distinct())
        discard(before)
    discard(edges)
    if not steps:
        return labels
    out = labels
    for hook in steps:
        out = out.join(hook.select(F.col("u").alias("label"), "root"), "label", "left").select("id", F.coalesce("root", "label").alias("label"))
    out = cut(out)
    discard(labels, *steps)
    return out


CLASS = ["n", "d1", "d2"]


def grouped(df: DataFrame, width: int, percent: int, join_ids: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(signed, named, several): the rows of ``keyed`` with their sets' digests, each set with the first row of its component, and sets that share a doc_id.

    The first row, (none, key, h), has the least doc_id, null ones last.  With ``join_ids`` rows that share a doc_id are joined too
    and null ones left out.
    """
    bounded_batches(df.sparkSession)
    signed = cut(signed_sets(df, width))
    some = signed.where("n > 0 and doc_id is not null" if join_ids else "n > 0")
    # One row for each set; its number is given once, as it is written.
    classes = cut(some.groupBy(*CLASS).agg(F.any_value("bands").alias("bands"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "key", "h")).alias("of")).withColumn("id", F.monotonically_increasing_id()))
    own_set = F.xxhash64(*CLASS)
    repeated = cut(signed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min(own_set).alias("lo"), F.max(own_set).alias("hi")).where("rows > 1").select("key", (F.col("lo") != F.col("hi")).alias("differ")))
    several = None
    if join_ids:
        rows = signed.where("doc_id is not null").join(repeated.where("differ").select("key"), "key", "left_semi").select("doc_id", *CLASS).distinct()
        several = cut(rows.join(classes.select(*CLASS, "id"), CLASS).select("doc_id", "id"))
    members = classes.select("id", "n", F.explode("bands").alias("bucket"))
    firsts = cut(members.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("bucket", "first"))
    members = cut(members.join(firsts, "bucket").select("bucket", "id", "n", "first").distinct())
    discard(firsts)
    met = members.select("id").distinct()
    labels = cut((met if several is None else met.union(several.select("id")).distinct()).select("id", F.col("id").alias("label")))
    # One row stands for each set that is compared: the set is made again from its text.
    wanted = classes.join(met, "id", "left_semi").select("id", "of.key", "of.h").join(repeated.select("key", F.lit(True).alias("r")), "key", "left")
    wanted = cut(wanted.select("id", "key", "h", F.col("r").isNotNull().alias("again")))
    own = cut(full_sets(df, wanted, width))
    discard(wanted)
    sizes = members.select(F.col("id").alias("first"), F.col("n").alias("n_first")).distinct()
    close = 100 * F.least("n", "n_first") >= percent * F.greatest("n", "n_first")  # else the sizes rule a link out
    if several is not None:
        least = several.groupBy("doc_id").agg(F.min("id").alias("b"))
        labels = relabelled(labels, several.join(least, "doc_id").select(F.col("id").alias("a"), "b").where("a <> b").distinct())
    # Each member with its buckets' first ones: rows grow with the members, and most copies are settled here.
    pairs = members.where("id > first").select("id", "n", "first").distinct().join(sizes, "first").where(close)
    labels = relabelled(labels, verified(pairs.select(F.col("id").alias("a"), F.col("first").alias("b")).distinct(), own, percent))
    # What no first member settles is compared block by block: all pairs of a bucket that holds several components.
    told = members.join(labels, "id")
    split = told.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    labels = relabelled(labels, block_links(told.join(split, "bucket").select("bucket", "id", "n", "first"), own, percent))
    discard(own, members)
    # Tables of their own, so that the join of a large component can be split.
    told = cut(classes.select(*CLASS, "id", "of").join(labels, "id", "left").select(*CLASS, "id", "of", F.coalesce("label", "id").alias("component")))
    least = cut(told.groupBy("component").agg(F.min("of").alias("first")))
    named = cut(told.join(least, "component").select(*CLASS, "id", "component", "first"))
    return signed.select("key", "doc_id", "h", *CLASS), named, several


def components(df: DataFrame, doc_id: str, text: str, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row."""
    signed, named, several = grouped(keyed(df, doc_id, text), width, percent, True)
    by_set = named.select(*CLASS, F.col("first.key").alias("by_set"))
    # Rows without words have the component of their doc_id's other rows.
    by_id = cut(several.join(named.select("id", F.col("first.key").alias("by_id")), "id").groupBy("doc_id").agg(F.min("by_id").alias("by_id")))
    rows = signed.select("doc_id", *CLASS).join(by_set, CLASS, "left").join(by_id, "doc_id", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("by_set", "by_id", "doc_id")).alias("component_id"))


def block_links(rest: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all similar members (bucket, id, n, first) of the same bucket; inside a pair of blocks, a spanning forest of them.

    Work and copies of a set are bounded by the buckets it is in, whatever other buckets their members are in.
    """
    rest = cut(rest)
    x = lambda k: F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}")
    marks = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("elements"), x(1), x(2))
    # Buckets with the same members are compared once.
    once = marks.groupBy("members", "elements", "x1", "x2").agg(F.min("bucket").alias("bucket")).drop("x1", "x2")
    placed = cut(rest.join(once, "bucket"))
    discard(rest)
    # Small buckets share a task, those with the same first member the same one; comparing across buckets does no harm.
    few = (F.col("members") <= SMALL) & (F.col("elements") <= BLOCK_ELEMENTS // 8)
    n, e = placed.where(few).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bins = max(1, n // SHARED, e // BLOCK_ELEMENTS)
    shared = placed.where(few).select("id", F.lit(-1).cast("long").alias("of"), F.pmod(F.xxhash64("first"), F.lit(bins)).cast("int").alias("lo"), F.lit(-1).alias("hi")).distinct()
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("elements") / BLOCK_ELEMENTS)).cast("int")
    large = placed.where(~few).select("id", F.col("bucket").alias("of"), blocks.alias("blocks"), F.pmod(F.xxhash64("id", F.lit(1)), blocks).cast("int").alias("block"))
    large = large.select("id", "of", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    large = large.select("id", "of", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    filled = shared.unionByName(large).join(own, "id")

    def compare(found: pa.Table) -> pa.Table:
        e = found.column("elements").combine_chunks()
        at = np.concatenate(([0], np.cumsum(e.value_lengths().to_numpy(zero_copy_only=False))))
        label = forest(e.flatten().to_numpy(zero_copy_only=False), at, percent)
        ids = found.column("id").to_numpy()
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(ids[moved], pa.int64()), "b": pa.array(ids[label[moved]], pa.int64())})

    return filled.groupBy("of", "lo", "hi").applyInArrow(compare, "a long, b long").where("a <> b").distinct()


def forest(elements: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """For each set the least index of the sets that similar ones connect it with."""
    n = len(at) - 1
    sizes = np.diff(at)
    of = np.repeat(np.arange(n), sizes)
    order = np.argsort(elements, kind="stable")
    e, of = elements[order], of[order]
    begins = np.flatnonzero(np.concatenate(([True], e[1:] != e[:-1])))
    counts = np.diff(np.append(begins, len(e)))
    inter = np.zeros((n, n), np.float32)
    # Elements in few sets add to pairs one by one; the rest through products of 0/1 matrices, a slice at a time.
    for d in range(2, DENSE):
        own = begins[counts == d]
        for i in range(d - 1 if len(own) else 0):
            for j in range(i + 1, d):
                np.add.at(inter, (of[own + i], of[own + j]), 1)
    inter += inter.T
    dense = np.flatnonzero(counts >= DENSE)
    for s in range(0, len(dense), SLICE):
        part = dense[s : s + SLICE]
        matrix = np.zeros((n, len(part)), np.float32)
        for k, b in enumerate(part.tolist()):
            matrix[of[begins[b] : begins[b] + counts[b]], k] = 1
        inter += matrix @ matrix.T
    similar = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
    similar[np.arange(n), np.arange(n)] = False
    a, b = np.nonzero(np.triu(similar))
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def representatives(df: DataFrame, doc_id: str, text: str, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` of which one stays for each group of rows that links join: of those with the least doc_id (null last) the one whose text has the least hash.

    A row is a document here, so rows that share a doc_id but not their text are apart, and null doc_ids take part.  Rows without words are
    linked with nothing, so all of them stay.
    """
    rows = carried(df, __id=F.col(doc_id).cast("long"), __text=text).withColumn("__h", F.xxhash64(F.coalesce(F.col("__text"), F.lit(""))))
    rows = rows.withColumn("__key", F.coalesce("__id", "__h"))
    signed, named, _ = grouped(keyed(df, doc_id, text), width, percent, False)
    told = signed.where("n > 0").select("key", "doc_id", "h", *CLASS).join(named.select(*CLASS, "first"), CLASS)
    other = F.struct(F.col("doc_id").isNull().alias("none"), "key", "h") != F.col("first")
    # What isn't the only row of its group's first document: of all rows with words these alone, and what a filter takes for them, are shuffled with their texts.
    counted = told.select("key", "h", other.alias("other")).groupBy("key", "h").agg(F.count(F.lit(1)).alias("rows"), F.bool_or("other").alias("other"))
    doubtful = cut(counted.where("other or rows > 1").select(F.xxhash64("key", "h").alias("x")))
    has_words = F.coalesce(F.col("__text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    marked = rows.withColumn("__odd", has_words & among(doubtful)(F.xxhash64("__key", "__h")))
    firsts = cut(named.groupBy("component").agg(F.any_value("first").alias("first")).select("first.*"))
    odd = marked.where("__odd")
    found = odd.join(firsts, (odd["__key"] == firsts["key"]) & (odd["__h"] == firsts["h"]) & (odd["__id"].isNull() == firsts["none"]), "left_semi")
    # Repeated rows of a document: one of them.
    once = Window.partitionBy("__key", "__h").orderBy(F.xxhash64(ROW))
    one = found.select(ROW, "__key", "__h").withColumn("__nth", F.row_number().over(once)).where("__nth = 1")
    return marked.where("not __odd").select(ROW).unionByName(one.select(ROW)).select(f"{ROW}.*")
