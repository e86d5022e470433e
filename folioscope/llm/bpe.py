"""Byte-level BPE by prefix dynamic programming.

For a valid BPE vocabulary every prefix of a byte string has exactly one token that can end its
encoding, so the encoding of a piece is stored as one token per prefix.  A token may end a prefix
if it is a suffix of it and is *compatible* with the token that ends the rest: undoing merges
around the border never meets a pair that would have been merged earlier.  Following the stored
tokens back from the end gives the encoding; an append adds states at the end, and an edit
recomputes states only until they agree with the old ones for as long as the longest token.

The tokens that end at each byte come from an automaton over the vocabulary, so a piece costs a step for each of them.

Defined results: null text encodes as the empty text (no tokens, no bytes); repeated rows repeat;
pieces of any length are encoded whole (short ones are kept with their ids, long ones are not); bytes that are in no token cannot occur, as every byte is a token; there are no ties, as
every prefix has one last token; an empty table gives an empty result; clashing names: see ``common.beside``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folioscope.llm.common import beside, bounded_batches

#: Pieces up to this many bytes are kept with their ids.
SHARED_BYTES = 48
#: Entries of a generation of a worker's pieces, of which two are kept, and of its pairs (some 140 MB in all); what is dropped is only found again.
PIECES, PAIRS = 300_000, 400_000


class _Pieces(dict):
    """piece (str) -> its ids as little-endian 32-bit integers; pieces that a whole generation hasn't met go."""

    def __init__(self, encoder: "PrefixEncoder"):
        self.encoder = encoder
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.before.get(piece)
        if out is None:
            b = piece.encode("utf-8")
            ids = self.encoder.encode_piece(b)
            out = pack(f"<{len(ids)}I", *ids)
            if len(b) > SHARED_BYTES:
                return out
        if len(self) >= PIECES:
            self.before = dict(self)
            self.clear()
        self[piece] = out
        return out


class PrefixEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = dict(zip(ranks.values(), ranks))
        self.length = {t: len(b) for b, t in ranks.items()}
        self.longest = max(map(len, ranks))
        # Finds the tokens that end at each byte; bytes are looked at as characters of Latin-1.
        self.ends = ahocorasick.Automaton()
        for b, t in ranks.items():
            self.ends.add_word(b.decode("latin-1"), (t, len(b)))
        self.ends.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(self)

    def half(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; itself twice for a byte; None if merging its bytes never gives it."""
        if token in self.halves:
            return self.halves[token]
        b = self.bytes_of[token]
        if len(b) == 1:
            out = (token, token)
        else:
            parts = [b[i : i + 1] for i in range(len(b))]
            while len(parts) > 2:
                best, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 31), i) for i in range(len(parts) - 1)))
                if best == 1 << 31:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            out = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        self.halves[token] = out
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of a and b together leaves these two tokens; never for a token that no merges give."""
        key = a << 32 | b
        if (known := self.pairs.get(key)) is not None:
            return known
        bound, left, right, ok = 1 << 31, a, b, None if self.half(b) is not None else False
        while ok is None:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < bound:
                ok = False
                break
            # Undo the later merge of the two; at equal ranks the right one came later, as merging goes from the left.
            l_half, r_half = self.half(left), self.half(right)
            l_open, r_open = l_half is not None and l_half[1] != left, r_half is not None and r_half[0] != right
            if not l_open and not r_open:
                ok = True
            elif l_open and (left > right or not r_open):
                bound, left = (left, l_half[1])
            else:
                bound, right = (right + 1, r_half[0])
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def states(self, data: bytes, last: list[int], begin: int) -> Iterator[int]:
        """Adds the one last token of each prefix of ``data`` longer than ``begin`` to ``last`` and gives the prefix's length.

        ``last`` holds those of the prefixes up to ``begin`` (the first is the empty one's).
        """
        offset = max(0, begin - self.longest)
        known = self.pairs.get
        for end, (t, n) in self.ends.iter(data[offset:].decode("latin-1")):
            end += offset + 1
            if end < len(last):
                continue  # found, or before the beginning
            if end > len(last):
                break
            start = end - n
            if start:
                ok = known(last[start] << 32 | t)
                if ok is None:
                    ok = self.compatible(last[start], t)
            else:
                ok = self.half(t) is not None
            if ok:
                last.append(t)
                yield end
        if len(last) <= len(data):
            raise ValueError(f"no token ends {data[: len(last)]!r}: the vocabulary isn't a byte-level BPE")

    def followed(self, last: list[int]) -> list[int]:
        """The ids that the stored tokens give, from the end back."""
        out, end = [], len(last) - 1
        while end:
            t = last[end]
            out.append(t)
            end -= self.length[t]
        return out[::-1]

    def encode_piece(self, b: bytes) -> list[int]:
        """Ids of one piece, as merging the pair of lowest rank again and again would give."""
        if not b:
            return []
        if (whole := self.ranks.get(b)) is not None:
            return [whole]
        # As ``states`` does from the empty prefix on, without handing each one out.
        last, size, known, compatible = [-1], 1, self.pairs.get, self.compatible
        for end, (t, n) in self.ends.iter(b.decode("latin-1")):
            if end + 1 < size:
                continue
            start = end + 1 - n
            if start:
                ok = known(last[start] << 32 | t)
                if ok is None:
                    ok = compatible(last[start], t)
            else:
                ok = self.half(t) is not None
            if ok:
                last.append(t)
                size += 1
        if size <= len(b):
            raise ValueError(f"no token ends {b[:size]!r}: the vocabulary isn't a byte-level BPE")
        return self.followed(last)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


class PrefixTable:
    """The stored last tokens of one piece, open to appends and edits."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        for _ in self.encoder.states(self.data, self.last, start):
            pass

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Puts ``new`` for the bytes from start to stop; returns how many states were found anew."""
        old, shift = self.last, start + len(new) - stop
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[: start + 1]
        same = done = 0
        for end in self.encoder.states(self.data, self.last, start):
            done += 1
            same = same + 1 if end > start + len(new) and old[end - shift] == self.last[end] else 0
            if same >= self.encoder.longest:
                self.last.extend(old[end - shift + 1 :])
                break
        return done

    def ids(self) -> list[int]:
        return self.encoder.followed(self.last)


def load_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


_ENCODERS: dict[tuple[str, str], PrefixEncoder] = {}


def encoder_of(content: bytes, pattern: str) -> PrefixEncoder:
    """One encoder for each worker process and vocabulary."""
    key = (hashlib.sha256(content).hexdigest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = PrefixEncoder(load_ranks(content), pattern)
    return _ENCODERS[key]


def _added(df: DataFrame, text: str, ranks_path: str, pattern: str, fields: list[pa.Field], row) -> DataFrame:
    """``df`` without ``text``, with the columns that row(encoder, text) gives."""
    with open(ranks_path, "rb") as f:  # the driver's file; its bytes (under 1 MB for 50,000 tokens) go to the workers
        content = df.sparkSession.sparkContext.broadcast(f.read())
    bounded_batches(df.sparkSession)

    def start():
        enc = encoder_of(content.value, pattern)

        def make(values: pa.Array) -> list[pa.Array]:
            rows = [row(enc, t.as_py()) for t in values]
            return [pa.array(list(c), f.type) for c, f in zip(zip(*rows), fields)]

        return make

    return beside(df, text, fields, start)


def encode_documents(df: DataFrame, text: str, ranks_path: str, pattern: str) -> DataFrame:
    """``df`` without ``text``, with ids (array<int>), n_tokens (long) and decoded_sha256 (of the bytes decoded from the ids)."""
    extra = [pa.field("ids", pa.list_(pa.int32())), pa.field("n_tokens", pa.int64()), pa.field("decoded_sha256", pa.string())]

    def row(enc: PrefixEncoder, t: str | None) -> tuple:
        ids = enc.encode(t)
        return np.frombuffer(ids, "<u4").astype(np.int32), len(ids) // 4, hashlib.sha256(enc.decode(ids)).hexdigest()

    return _added(df, text, ranks_path, pattern, extra, row)


def token_digests(df: DataFrame, text: str, ranks_path: str, pattern: str) -> DataFrame:
    """``df`` without ``text``, with n_tokens and the SHA-256 of the ids and of the bytes decoded from them."""
    extra = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]

    def row(enc: PrefixEncoder, t: str | None) -> tuple:
        ids = enc.encode(t)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest()

    return _added(df, text, ranks_path, pattern, extra, row)
