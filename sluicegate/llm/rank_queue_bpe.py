"""Byte-level BPE by rank files: encoding to ids and decoding back.

A pre-token's bytes are a linked list. Every neighbouring pair that a merge exists for sits
in the bucket of that merge's rank; a hierarchy of bitmaps over the ranks finds the lowest
one that is not empty by find-first-set, and a bucket gives its positions from the left.
A pair that changed meanwhile leaves a stale entry, which is skipped when it comes up. The
work for a pre-token of n bytes is n log n however long it is.

Defined results: a NULL text is an empty one and has no ids; equal rows are encoded alike;
an empty frame gives an empty frame. Only the named columns are read, so no name can clash.
Nothing is shuffled, and a text's ids are never more than its bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.llm.tables import text_batches

# Pre-tokens up to this size are remembered, and so many of them per worker.
MEMO_BYTES, MEMO_ENTRIES = 48, 600_000
_NONE = -1


class _Memo(dict):
    """Pre-token -> its packed ids; computes what it lacks."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, text: str) -> bytes:
        piece = text.encode()
        ids = self.encoder.encode_piece(piece)
        packed = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_BYTES:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[text] = packed
        return packed


def _ranges(inside: str) -> str:
    """The characters up to U+FFFF of a class, as ranges that any engine reads alike."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    codes = np.array([ord(c) for m in regex.finditer(f"[{inside}]+", plane) for c in m.group()])
    if not len(codes):
        return ""
    last = np.flatnonzero(np.append(np.diff(codes) > 1, True))
    first = np.append(0, last[:-1] + 1)
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(codes[first].tolist(), codes[last].tolist()))


def _plain_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for the faster engine, its classes written out, for texts without characters
    beyond U+FFFF. None if it has more than letters, numbers and spaces as classes."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        found = re.match(r"\\p\{(\w+)\}|\\([sS])|\\.|.", pattern[at:], re.DOTALL)
        token = found.group()
        at += len(token)
        if found.group(1) or found.group(2) == "s":
            out.append(_ranges(token) if inside else f"[{_ranges(token)}]")
        elif token == r"\S":
            if inside:
                return None
            out.append(f"[^{_ranges(r'\s')}]")
        elif len(token) > 1 and token[1].isalpha() and token[1] not in "nrt" or token in ("(?i", "&&"):
            return None
        else:
            inside = token == "[" or inside and token != "]"
            out.append(token)
    return None if "(?i" in pattern else re.compile("".join(out))


_BEYOND = re.compile("[\U00010000-\U0010ffff]")


class Encoder:
    """The merges of one rank file. Not shared between threads."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.plain = _plain_pattern(pattern)
        self.words = [0] * ((max(ranks.values(), default=0) >> 8) + 1)
        self.byte_ids = [ranks.get(bytes([b]), _NONE) for b in range(256)]
        if _NONE in self.byte_ids:
            raise ValueError("the vocabulary lacks a byte")
        self.memo = _Memo(self)
        self.pieces: list[bytes] = [b""] * (max(ranks.values(), default=0) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        # What two tokens side by side make: the key is left * base + right.
        self.base = len(self.pieces)
        self.pairs = {
            ranks[piece[:cut]] * self.base + ranks[piece[cut:]]: rank
            for piece, rank in ranks.items()
            for cut in range(1, len(piece))
            if piece[:cut] in ranks and piece[cut:] in ranks
        }

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed."""
        pattern = self.pattern if self.plain is None or _BEYOND.search(text) else self.plain
        return b"".join(map(self.memo.__getitem__, pattern.findall(text)))

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token. A piece that is a token as a whole is that token.

        The queue is written out here, as this is where the time goes. A bucket is the one
        position that it holds or a heap of them. `words` are bitmaps of 256 ranks each, a
        bit per rank with a bucket; `top` has a bit per word that isn't zero. All of them
        are empty again at the end. `pair` has the rank of the pair that begins at a
        position; the last place stands for the end of the list.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        rank_of, base, words, buckets = self.pairs.get, self.base, self.words, {}
        byte_ids = self.byte_ids
        ids = [byte_ids[b] for b in piece]
        size = len(ids)
        after = list(range(1, size + 1))
        before = list(range(-1, size))
        pair = [rank_of(left * base + right) for left, right in zip(ids, ids[1:])]
        pair += (None, None)
        top = 0
        for start, rank in enumerate(pair):
            if rank is not None:
                if rank not in buckets:
                    buckets[rank] = start
                    words[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
                elif type(bucket := buckets[rank]) is int:
                    buckets[rank] = [bucket, start]
                else:
                    bucket.append(start)  # positions rise, so this is a heap
        while top:
            # Find the first set bits, and take the leftmost position.
            first = top & -top
            at = first.bit_length() - 1
            word = words[at]
            bit = word & -word
            rank = at << 8 | bit.bit_length() - 1
            start = buckets[rank]
            if type(start) is int:
                del buckets[rank]
                words[at] = word = word ^ bit
                if not word:
                    top ^= first
            else:
                bucket, start = start, heappop(start)
                if len(bucket) == 1:
                    buckets[rank] = bucket[0]
            if pair[start] != rank:
                continue  # stale: merged away, or its neighbour has grown
            ids[start] = rank
            gone = after[start]
            end = after[start] = after[gone]
            pair[gone] = None
            before[end] = start
            # The pairs that the grown token makes with its neighbours.
            if end < size:
                new = pair[start] = rank_of(rank * base + ids[end])
                if new is not None:
                    if new not in buckets:
                        buckets[new] = start
                        words[new >> 8] |= 1 << (new & 255)
                        top |= 1 << (new >> 8)
                    elif type(bucket := buckets[new]) is int:
                        buckets[new] = [bucket, start] if bucket < start else [start, bucket]
                    else:
                        heappush(bucket, start)
            else:
                pair[start] = None
            left = before[start]
            if left >= 0:
                new = pair[left] = rank_of(ids[left] * base + rank)
                if new is not None:
                    if new not in buckets:
                        buckets[new] = left
                        words[new >> 8] |= 1 << (new & 255)
                        top |= 1 << (new >> 8)
                    elif type(bucket := buckets[new]) is int:
                        buckets[new] = [bucket, left] if bucket < left else [left, bucket]
                    else:
                        heappush(bucket, left)
        found, start = [], 0
        while start < size:
            found.append(ids[start])
            start = after[start]
        return found

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def read_ranks(path: str) -> bytes:
    """The rank file, as it is: a line per token, base64 and rank."""
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=2)
def encoder(file: bytes, pattern: str) -> Encoder:
    """Built once per Python worker."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines()) if token}
    return Encoder(ranks, pattern)


def _mapped(df: DataFrame, path: str, pattern: str, work: Callable, source: str, schema: str, columns: list[str]) -> DataFrame:
    """Rows of `df` whose column `source` is replaced by what `work` makes of its batch."""
    text_batches(df.sparkSession)
    vocabulary = df.sparkSession.sparkContext.broadcast(read_ranks(path))  # about 1 MB
    at = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary.value, pattern)
        for batch in batches:
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, *work(tool, batch.column(at))], columns)

    return df.mapInArrow(run, schema)


def encode_texts(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids: the ids as little-endian unsigned 32-bit integers."""

    def work(tool: Encoder, texts: pa.Array) -> list[pa.Array]:
        ids = [tool.encode(t.as_py() or "") for t in texts]
        return [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]

    narrow = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    encoded = _mapped(
        narrow, path, pattern, work, "text", f"key {kind}, n_tokens bigint, ids binary", ["key", "n_tokens", "ids"]
    )
    return encoded.withColumnRenamed("key", key)


def decode_ids(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """The frame with `decoded`, the bytes that its ids stand for, in place of the ids."""

    def work(tool: Encoder, packed: pa.Array) -> list[pa.Array]:
        whole = [tool.decode(p.as_py() or b"") for p in packed]
        return [pa.array(whole, pa.binary())]

    kept = [f for f in encoded.schema if f.name != ids]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "decoded binary"])
    return _mapped(encoded, path, pattern, work, ids, schema, [*(f.name for f in kept), "decoded"])
