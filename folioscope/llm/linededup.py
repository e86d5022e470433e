"""Repeated lines, found through two Bloom filters.

A line's key is the line without white space (``[\\x20\\x09-\\x0D]``) at its ends, with A-Z lower-cased.
Keys of at least ``min_chars`` code points that occur in at least ``min_docs`` documents lose all their
lines but those in the largest doc_id that holds the key.

1. Each task puts the hashes of its keys in a pair of Bloom filters: once seen and seen again.  Two
   pairs merge without loss: what both have once may be there twice, so
   ``twice = twice1 | twice2 | (once1 & once2)``.  Tasks send non-empty chunks, merged chunk by chunk.
2. Only keys that pass the merged second filter are suspects; they alone shuffle, as (digest, doc_id, text's hash),
   and are counted exactly.  A full filter costs shuffling, never a result.
3. Up to SENT_KEYS confirmed keys go to all tasks with the document that keeps each, and no text is shuffled.  More of
   them join back to the suspects, and only texts that a filter of the documents with drops lets through are
   shuffled to meet their drops.  Both ways give the same rows.

Defined results: null text is one empty line; null doc_id is a document smaller than all others; rows
that share a doc_id are one document for counting and are rewritten each; repeated rows repeat;
ties cannot occur, as the doc_id decides; texts and lines of any length are read whole; an empty table gives an empty
result; other columns travel in a struct, so their names don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from folioscope.llm.common import ROW, bounded_batches, carried, cut, slices

WHITE = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Probes of a key, bits of a filter for each line, and the bounds of a filter (2**29 bits are 64 MB).
PROBES, BITS_PER_LINE, LEAST_BITS, MOST_BITS = 4, 8, 1 << 16, 1 << 29
#: Bits of a chunk of a filter, and how many groups of tasks merge a chunk before it is merged as a whole.
CHUNK, GROUPS = 1 << 19, 32
#: Confirmed keys (16 bytes and a doc_id each) that may be sent to every task.
SENT_KEYS = 200_000


#: Bytes of whole lines that are worked on at once.
PIECE = 1 << 18


def pieces(text: str | None) -> Iterator[bytes]:
    """A text in runs of whole lines of about PIECE bytes; a longer line is a run of its own."""
    data = (text or "").encode("utf-8")
    at = 0
    while (end := data.find(b"\n", at + PIECE)) >= 0:
        yield data[at:end]
        at = end + 1
    yield data[at:]


def keys_of(piece: bytes, min_chars: int) -> list[bytes | None]:
    """The key of each line; None for those too short to count."""
    out: list[bytes | None] = []
    for line in piece.translate(LOWER).split(b"\n"):
        key = line.strip(WHITE)
        n = len(key)
        out.append(key if n >= min_chars and (n >= 4 * min_chars or len(key.decode("utf-8")) >= min_chars) else None)
    return out


def hashes_of(text: str | None, min_chars: int) -> np.ndarray:
    """The hashes of a text's keys, each once."""
    found = [np.fromiter((xxhash.xxh3_64_intdigest(k) for k in {*keys_of(p, min_chars)} if k is not None), np.uint64) for p in pieces(text)]
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:16]


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES places of each 64-bit hash in a filter of a power of two of bits."""
    low, high = hashes, (hashes >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(PROBES, dtype=np.uint64) * high[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def holds(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def put(bitmap: np.ndarray, at: np.ndarray) -> None:
    flat = at.ravel()
    np.bitwise_or.at(bitmap, flat >> 3, np.left_shift(1, flat & 7).astype(np.uint8))


def see(once: np.ndarray, twice: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    """Puts the hashes, one for each document and key, in the pair."""
    hashes, counts = np.unique(hashes, return_counts=True)
    at = probes(hashes, bits)
    put(twice, at[(counts > 1) | holds(once, at)])
    put(once, at)


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] | b[0], a[1] | b[1] | (a[0] & b[0])


def filter_bits(lines: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, lines * BITS_PER_LINE - 1).bit_length()))


_CHUNKS = "chunk int, part int, once binary, twice binary"


def _packed(chunk: int, part: int, once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part], pa.int32()), pa.array([zlib.compress(once.tobytes(), 1)], pa.binary()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], names=["chunk", "part", "once", "twice"])


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), np.uint8)


def _merged(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair, chunk = None, 0
    for batch in found:
        chunk = batch.column("chunk")[0].as_py()
        for o, t in zip(batch.column("once"), batch.column("twice")):
            new = _unpacked(o.as_py()), _unpacked(t.as_py())
            pair = new if pair is None else merge(pair, new)
    yield _packed(chunk, -1, *pair)


def filters(df: DataFrame, column: str, hashes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged pair of filters of hashes(value), one list for each value of the column."""
    step = min(bits, CHUNK) // 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        waiting: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for t in batch.column(0):
                waiting.append(hashes(t.as_py()))
                held += len(waiting[-1])
                if held >= 50_000 or len(waiting) >= 5_000:
                    see(once, twice, np.concatenate(waiting), bits)
                    waiting, held = [], 0
        if waiting:
            see(once, twice, np.concatenate(waiting), bits)
        part = TaskContext.get().partitionId() % GROUPS
        for c in range(bits // 8 // step):
            o, t = once[c * step : (c + 1) * step], twice[c * step : (c + 1) * step]
            if o.any():
                yield _packed(c, part, o, t)

    chunks = df.select(column).mapInArrow(fill, _CHUNKS)
    # Chunks of a bounded number of tasks first, then those of all groups: no task holds the filters of all tasks.
    chunks = chunks.groupBy("chunk", "part").applyInArrow(_merged, _CHUNKS).groupBy("chunk").applyInArrow(_merged, _CHUNKS)
    pair = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for r in chunks.collect():  # MOST_BITS in all at most, however many lines there are
        for whole, own in zip(pair, (r.once, r.twice)):
            whole[r.chunk * step : (r.chunk + 1) * step] = _unpacked(bytes(own))
    return pair


def among(values: DataFrame):
    """A function of a long column that is false only for numbers that are not among the values (x); a filter of at most MOST_BITS."""
    bits = filter_bits(values.count())
    once = values.sparkSession.sparkContext.broadcast(zlib.compress(filters(values, "x", lambda x: np.array([x % (1 << 64)], np.uint64), bits)[0].tobytes(), 1))
    opened: list[np.ndarray] = []

    @arrow_udf(T.BooleanType())
    def maybe(x: pa.Array) -> pa.Array:
        if not opened:
            opened.append(_unpacked(once.value))
        return pa.array(holds(opened[0], probes(x.to_numpy(zero_copy_only=False).view(np.uint64), bits)))

    return maybe


def seen_again(df: DataFrame, text: str, min_chars: int) -> tuple[np.ndarray, int]:
    """The merged filter of keys that may be in two documents or more, and its bits."""
    lines = df.agg(F.sum(F.least(F.size(F.split(text, "\n")), F.floor(F.length(text) / F.lit(min_chars)).cast("int")))).first()[0] or 0
    bits = filter_bits(lines)
    return filters(df, text, lambda t: hashes_of(t, min_chars), bits)[1], bits


def suspects(df: DataFrame, min_chars: int) -> DataFrame:
    """(key, doc_id, h): digests of the keys of each (doc_id, h, text) that pass the second filter."""
    bitmap, bits = seen_again(df, "text", min_chars)
    sent = df.sparkSession.sparkContext.broadcast(zlib.compress(bitmap.tobytes(), 1))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = _unpacked(sent.value)
        for batch in batches:
            keys, of, held = [], [], 0

            def passed() -> pa.RecordBatch:
                hit = np.flatnonzero(holds(twice, probes(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64), bits)))
                rows = pa.array([of[k] for k in hit], pa.int32())
                return pa.RecordBatch.from_arrays([pa.array([digest(keys[k]) for k in hit], pa.binary()), batch.column(0).take(rows), batch.column(1).take(rows)], names=["key", "doc_id", "h"])

            for j, t in enumerate(batch.column(2)):
                # A key of two pieces of a text comes twice; it counts once where documents are counted.
                for piece in pieces(t.as_py()):
                    own = {*keys_of(piece, min_chars)} - {None}
                    keys.extend(own)
                    of.extend([j] * len(own))
                    held += len(piece)
                    if held >= 4 * PIECE and keys:
                        yield passed()
                        keys, of, held = [], [], 0
            if keys:
                yield passed()

    return df.select("doc_id", "h", "text").mapInArrow(find, f"key binary, doc_id {df.schema['doc_id'].dataType.simpleString()}, h long")


_LINES = T.StructType().add("text", T.StringType()).add("n_lines", T.LongType()).add("n_dropped", T.LongType())


def _without(text: str | None, least: int, gone) -> dict:
    """A text without the lines whose keys' digests are ``gone``."""
    parts, n, left = [], 0, 0
    for piece in pieces(text):
        lines = piece.split(b"\n")
        kept = [x for x, k in zip(lines, keys_of(piece, least)) if k is None or not gone(digest(k))]
        n, left = n + len(lines), left + len(kept)
        if kept:
            parts.append(piece if len(kept) == len(lines) else b"\n".join(kept))
    return {"text": b"\n".join(parts).decode("utf-8"), "n_lines": n, "n_dropped": n - left}


_ARROW_LINES = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])


def _rows_of(make, values: pa.Array) -> pa.Array:
    """make(i) for each value, in slices, so that what Python holds at once is bounded by its bytes."""
    return pa.chunked_array([pa.array([make(i) for i in range(at, at + n)], _ARROW_LINES) for at, n in slices(values, 256)], _ARROW_LINES).combine_chunks()


@arrow_udf(_LINES)
def _rewritten(text: pa.Array, drops: pa.Array, least: pa.Array) -> pa.Array:
    return _rows_of(lambda i: _without(text[i].as_py(), least[i].as_py(), {*drops[i].as_py()}.__contains__), text)


def dedup_lines(df: DataFrame, doc_id: str, text: str, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Rows as (``__row``, ``lines``): the input row, and text, n_lines and n_dropped after dropping repeated lines."""
    bounded_batches(df.sparkSession)
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = carried(df, __id=doc_id, __text=text, __h=h)
    found = cut(suspects(df.select(F.col(doc_id).alias("doc_id"), h.alias("h"), F.col(text).alias("text")), min_chars))
    # A key of a third of all documents is many rows: pairs are made distinct on both columns, counts are summed before they shuffle.
    held = found.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    confirmed = cut(held.groupBy("key").agg(F.count("one").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).select("key", "keeper"))
    if confirmed.limit(SENT_KEYS + 1).count() <= SENT_KEYS:
        sent = df.sparkSession.sparkContext.broadcast({bytes(r.key): r.keeper for r in confirmed.collect()})  # SENT_KEYS at most

        @arrow_udf(_LINES)
        def kept(text: pa.Array, ids: pa.Array) -> pa.Array:
            keeper = sent.value

            def one(j: int) -> dict:
                own = ids[j].as_py()
                return _without(text[j].as_py(), min_chars, lambda d: d in keeper and keeper[d] != own)

            return _rows_of(one, text)

        return rows.select(ROW, kept("__text", "__id").alias("lines"))
    # Both sides are tables of their own here, so that a hot key's join can be split; repeated texts of a document need its keys once.
    pairs = found.distinct().join(confirmed, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = cut(pairs.groupBy(F.col("doc_id").alias("__of"), F.col("h").alias("__oh")).agg(F.collect_set("key").alias("__drops")))
    has_drops = among(drops.select(F.xxhash64("__of", "__oh").alias("x")))
    marked = rows.withColumn("__hit", has_drops(F.xxhash64("__id", "__h")))
    hit = marked.where("__hit").join(drops, marked["__id"].eqNullSafe(drops["__of"]) & (marked["__h"] == drops["__oh"]), "left")
    hit = hit.select(ROW, _rewritten("__text", F.coalesce("__drops", F.array().cast("array<binary>")), F.lit(min_chars)).alias("lines"))
    whole = F.coalesce("__text", F.lit(""))
    plain = marked.where("not __hit").select(ROW, F.struct(whole.alias("text"), F.size(F.split(whole, "\n")).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).alias("lines"))
    return hit.unionByName(plain)
