"""Link graphs and closures: backlinks, orphans, coverage, edge checks, merge closure, components, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.lineage import cut, discard
from folioscope.operators.packing import positions
from folioscope.sizes import small


def backlinks(links: DataFrame, docs: DataFrame) -> DataFrame:
    """target, doc_id, title: who links to each target."""
    return links.join(docs, "doc_id").select("target", "doc_id", "title").distinct()


def orphans(docs: DataFrame, links: DataFrame) -> DataFrame:
    """Documents that no link reaches; an anti join, so that a null target hides nothing."""
    return docs.join(links.select(F.col("target").alias("doc_id")), "doc_id", "left_anti")


def coverage(docs: DataFrame, links: DataFrame, by: str) -> DataFrame:
    """For each group its notes, those some link reaches, the rest, and their share."""
    cited = links.select(F.col("target").alias("doc_id"), F.lit(1).alias("cited")).distinct()
    n, c = F.count(F.lit(1)), F.count("cited")
    return docs.join(cited, "doc_id", "left").groupBy(by).agg(n.alias("notes"), c.alias("connected"), (n - c).alias("orphans"), F.round(c / n, 3).alias("ratio"))


def edge_report(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """source, target, present, reciprocal: whether each edge's target exists and links back."""
    known = pages.select(F.col("page").alias("target"), F.lit(True).alias("p"))
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(True).alias("r")).distinct()
    return edges.join(known, "target", "left").join(back, ["source", "target"], "left").select("source", "target", F.coalesce("p", F.lit(False)).alias("present"), F.coalesce("r", F.lit(False)).alias("reciprocal"))


def merge_closure(merges: DataFrame) -> DataFrame:
    """slug, target: where following merges ends; members of a cycle, and what leads into one, stay unmapped.

    Pointer jumping: each round doubles the distance followed, so log n rounds end every chain that ends.
    """
    now = cut(merges.select("slug", "target"))
    for _ in range(now.count().bit_length() + 1):
        ahead = now.select(F.col("slug").alias("target"), F.col("target").alias("next"))
        # Whether a row moved is written with it, so that no round compares whole tables.
        step = cut(now.join(ahead, "target", "left").select("slug", F.coalesce("next", "target").alias("target"), (F.col("next").isNotNull() & (F.col("next") != F.col("target"))).alias("moved")))
        still = step.where("moved").isEmpty()
        discard(now)
        now = step
        if still:
            break
    return now.join(merges.select(F.col("slug").alias("target")), "target", "left_anti").select("slug", "target")


def record_groups(records: DataFrame, key: str, links: list[str]) -> DataFrame:
    """Each record with the least key of those it shares a value of some link column with, however indirectly."""
    values = records.select(key, F.explode(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in links])).alias("value")).where("value is not null")
    values = cut(values.distinct())
    label = cut(records.select(key, F.col(key).alias("root")).distinct())
    while True:
        least = values.join(label, key).groupBy("value").agg(F.min("root").alias("least"))
        near = values.join(least, "value").groupBy(key).agg(F.min("least").alias("near"))
        moved = label.join(near, key, "left").select(key, F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = moved.select(F.col(key).alias("root"), F.col("root").alias("next"))
        found = F.least("root", F.coalesce("next", "root"))
        step = cut(moved.join(jump, "root", "left").join(label.select(key, F.col("root").alias("was")), key).select(key, found.alias("root"), (found != F.col("was")).alias("moved")))
        still = step.where("moved").isEmpty()
        discard(label)
        label = step
        if still:
            discard(values)
            return label.select(key, "root")


def membership_change(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """For each group how many members came, went or changed, and what to do: skip, refresh or generate."""
    b, a = before.select(by, "member", F.col("hash").alias("h0")), after.select(by, "member", F.col("hash").alias("h1"))
    both = b.join(a, [by, "member"], "full_outer")
    changed = F.count_if(~F.col("h0").eqNullSafe(F.col("h1")))
    was = F.count("h0")
    mode = F.when(changed == 0, "skip").when((changed >= 5) | (changed >= 0.2 * was), "generate").otherwise("refresh")
    return both.groupBy(by).agg(was.alias("was"), F.count("h1").alias("now"), changed.alias("changed"), mode.alias("mode"))


def member_digest(members: DataFrame, by: str, buckets: int = 256) -> DataFrame:
    """A digest of a group's member:hash lines that is the same whatever their order.

    Two levels: the sorted lines of each bucket of members, then the buckets' digests in order, so that no task holds the lines of a large group.
    """
    line = F.concat_ws(":", F.col("member").cast("string"), "hash")
    bucket = F.conv(F.substring(F.md5(F.col("member").cast("string")), 1, 4), 16, 10).cast("int") % buckets
    parts = members.select(by, bucket.alias("bucket"), line.alias("line")).groupBy(by, "bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "part"))), lambda x: F.concat_ws(":", x["bucket"].cast("string"), x["part"])), "\n")
    return parts.groupBy(by).agg(F.sha2(whole, 256).alias("digest"))


def merged_records(records: DataFrame, key: str, links: list[str], sets: list[str]) -> DataFrame:
    """One row for each group of ``record_groups``: its least key, how many records it has, and the sorted union of each array column."""
    labelled = records.join(record_groups(records, key, links), key)
    union = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in sets]
    return labelled.groupBy("root").agg(F.count(F.lit(1)).alias("records"), *union)


def first_of_union(*parts: DataFrame, key: str) -> DataFrame:
    """A union without repeats in which the first occurrence stays; parts hold ``key`` and ``pos``."""
    both = parts[0].withColumn("src", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        both = both.unionByName(p.withColumn("src", F.lit(i)))
    once = both.groupBy(key).agg(F.min(F.struct("src", "pos")).alias("at"))
    return once.select(key, "at.src", "at.pos")


def partition_defects(assigned: DataFrame, expected: DataFrame) -> DataFrame:
    """member, defect: members assigned twice, not at all, or unknown."""
    n = assigned.groupBy("member").agg(F.count(F.lit(1)).alias("times"))
    both = n.join(expected.select("member", F.lit(True).alias("known")), "member", "full_outer")
    defect = F.when(F.col("known").isNull(), "unknown").when(F.col("times").isNull(), "unassigned").when(F.col("times") > 1, "assigned twice")
    return both.select("member", defect.alias("defect")).where("defect is not null")


#: Slugs of a member from which on it is heavy, and members of a bitmap.
HEAVY, BITS = 64, 1 << 13


def _bitmaps(rows: DataFrame, key: str) -> DataFrame:
    """key, chunk, bits, n: the heavy members of a slug as bitmaps of BITS members each; ``rows``: key, place."""
    word = F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))"))
    words = rows.groupBy(key, F.floor(F.col("place") / BITS).alias("chunk"), F.floor(F.col("place") % BITS / 64).cast("int").alias("w")).agg(word.alias("b"))
    # At most BITS / 64 words of a chunk are gathered.
    packed = words.groupBy(key, "chunk").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS // 64 - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long")))
    count = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.bit_count(x))
    return packed.select(key, "chunk", bits.alias("bits")).withColumn("n", count(F.col("bits")))


def co_occurrence(members: DataFrame, top: int) -> DataFrame:
    """slug, other, shared, rank: the slugs that share most members with each.

    Members of fewer than HEAVY slugs meet in a join on the member, which grows with the sum of their slugs' squares, each less than HEAVY.  The others, which would
    make most of its pairs, are numbered and every slug's become bitmaps.  A slug pair is counted by them chunk by chunk, but only if what they may share (the smaller of both in each chunk, with
    what they share of light members) reaches the ``top``-th best count that light members alone already give the slug.
    """
    m = cut(members.select("slug", "member").distinct())
    often = m.groupBy("member").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HEAVY).select("member", F.lit(0).alias("all"))
    often = cut(positions(often, "all", "member").select("member", F.col("at").alias("place")))
    h = small(often)
    light = m.join(h.select("member"), "member", "left_anti")
    a, b = light, light.withColumnRenamed("slug", "other")
    pairs = cut(a.join(b, "member").where("slug <> other").groupBy("slug", "other").agg(F.count(F.lit(1)).alias("shared")))
    if often.limit(1).count():
        x = cut(_bitmaps(m.join(h, "member").select("slug", "place"), "slug"))
        y = x.select(F.col("slug").alias("other"), "chunk", F.col("bits").alias("theirs"), F.col("n").alias("m"))
        bound = x.select("slug", "chunk", "n").join(y.select("other", "chunk", "m"), "chunk").where("slug <> other").groupBy("slug", "other").agg(F.sum(F.least("n", "m")).alias("most"))
        both = bound.join(pairs, ["slug", "other"], "full_outer").select("slug", "other", F.coalesce("most", F.lit(0)).alias("most"), F.coalesce("shared", F.lit(0)).alias("light"))
        both = cut(both)
        # What light members give is a count that is reached.
        kth = both.withColumn("nth", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("light")))).where(F.col("nth") == top).select(F.col("slug").alias("s"), F.col("light").alias("reached"))
        open_ = cut(both.join(kth, F.col("slug") == F.col("s"), "left").where(F.col("most") + F.col("light") >= F.coalesce("reached", F.lit(0))).select("slug", "other", "light"))
        common = F.aggregate(F.zip_with("bits", "theirs", lambda p, q: F.bit_count(p.bitwiseAND(q)).cast("long")), F.lit(0).cast("long"), lambda n, c: n + c)
        met = open_.select("slug", "other").join(x, "slug").join(y, ["other", "chunk"]).groupBy("slug", "other").agg(F.sum(common).alias("heavy"))
        pairs = open_.join(met, ["slug", "other"], "left").select("slug", "other", (F.col("light") + F.coalesce("heavy", F.lit(0))).alias("shared")).where("shared > 0")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("shared"), "other"))).where(F.col("rank") <= top)


def reciprocal_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """source, target, action: what publishing the new edges of a source adds, removes and keeps."""
    o, n = old.select("source", "target", F.lit(1).alias("o")).distinct(), new.select("source", "target", F.lit(1).alias("n")).distinct()
    both = o.join(n, ["source", "target"], "full_outer")
    return both.select("source", "target", F.when(F.col("o").isNull(), "add").when(F.col("n").isNull(), "remove").otherwise("keep").alias("action"))


def nearest_caption(items: DataFrame, captions: DataFrame, penalty: Column) -> DataFrame:
    """The caption of least distance between rectangles on the same page plus a penalty."""
    gap = lambda lo1, hi1, lo2, hi2: F.greatest(F.lit(0.0), F.col(lo1) - F.col(hi2), F.col(lo2) - F.col(hi1))
    dx, dy = gap("x0", "x1", "cx0", "cx1"), gap("y0", "y1", "cy0", "cy1")
    cost = F.sqrt(dx * dx + dy * dy) + penalty
    return items.join(captions, "page").groupBy("page", "item").agg(F.min(F.struct(F.round(cost, 6).alias("cost"), "caption")).alias("best")).select("page", "item", "best.caption", "best.cost")
