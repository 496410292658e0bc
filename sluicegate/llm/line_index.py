"""Dropping lines that many documents share, by a sharded minimal perfect hash.

Line keys (trimmed, ASCII lower case) are hashed to 128 bits and counted, combined before the
shuffle. The hashes that reach the least count are dealt into shards by their first half, and
each shard is built by one task: a minimal perfect hash (levels of bitmaps; a key whose bit
collides goes to the next level, and a set bit's rank is the key's slot) and, by slot, the
other half of the hash as a fingerprint, the number of documents and the largest id. Documents
probe these arrays; no line is joined to another. A line that is not indexed fails on its
64-bit fingerprint.

If the arrays measure `BROADCAST_BYTES` or less, every task holds all shards and documents do
not move. Otherwise the lines' hashes travel: each shard is sent to as many tasks as its
counted lines need, and a task reads its arrays first and then its probes, row by row, so that
neither a line of a third of all documents nor a large index gathers in one place. Both ways
give the same rows.

Defined results: every row is a document, also one that is equal to another; a NULL or empty
text is one empty line; a NULL id counts as smaller than all others; of equal largest ids all
rows keep their lines; very long texts are taken whole; an empty frame gives an empty frame.
Only the named columns are read, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.llm.tables import Staging, text_batches

MIN_CHARS, MIN_DOCS = 40, 5
# Keys of a shard (about), bytes of all arrays up to which they are broadcast, and probes that
# one task of a shard answers (about).
SHARD_KEYS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
PROBES_PER_TASK = 2_000_000

_NO_ID = -(2**63)
_ONE, _WORD = np.uint64(1), np.uint64(64)
# Fixed values of the mixing step (odd multipliers of a published 64-bit finaliser).
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A hash of its own for each level."""
    out = keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for factor in _MIX:
        out = (out ^ (out >> np.uint64(33))) * factor
    return out ^ (out >> np.uint64(33))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: bitmaps by level, about 3 bits a key."""

    MAX_LEVELS = 64

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        sizes = [int(np.bitwise_count(words).sum()) for words in levels]
        self.first = np.cumsum([0, *sizes])
        # Set bits of a level before each word.
        self.before = [np.cumsum(counts) - counts for counts in (np.bitwise_count(w).astype(np.int64) for w in levels)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) == cls.MAX_LEVELS:
                raise ValueError("keys are not distinct")
            words = len(left) // 64 + 1
            at = (_mixed(left, len(levels)) % np.uint64(words * 64)).astype(np.int64)
            alone = np.bincount(at, minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key, 0 to keys - 1; some slot or -1 for a key that is not in it."""
        slots = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, words in enumerate(self.levels):
            at = _mixed(keys[open_], level) % np.uint64(len(words) * 64)
            word, bit = (at // _WORD).astype(np.int64), at % _WORD
            held = words[word]
            there = (held >> bit) & _ONE == _ONE
            below = np.bitwise_count(held & ((_ONE << bit) - _ONE))
            found = self.first[level] + self.before[level][word] + below
            slots[open_[there]] = found[there]
            open_ = open_[~there]
            if not len(open_):
                break
        return slots


class Shard:
    """Fingerprint, count and largest id of every indexed hash, by its slot."""

    def __init__(self, levels: list[bytes], fingerprints: bytes, counts: bytes, largest: bytes):
        self.hash = PerfectHash([np.frombuffer(level, "<u8") for level in levels])
        self.fingerprints = np.frombuffer(fingerprints, "<u8")
        self.counts = np.frombuffer(counts, "<u4")
        self.largest = np.frombuffer(largest, "<i8")

    @staticmethod
    def build(low: np.ndarray, high: np.ndarray, counts: np.ndarray, largest: np.ndarray) -> dict:
        made = PerfectHash.build(low)
        order = np.empty(len(low), dtype=np.int64)
        order[made.slots(low)] = np.arange(len(low))
        return {
            "levels": [w.astype("<u8").tobytes() for w in made.levels],
            "fingerprints": high[order].astype("<u8").tobytes(),
            "counts": np.minimum(counts[order], 2**32 - 1).astype("<u4").tobytes(),
            "largest": largest[order].astype("<i8").tobytes(),
        }

    def dropped(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, min_docs: int) -> np.ndarray:
        """Which (hash, document) pairs lose their lines."""
        slots = self.hash.slots(low)
        there = np.maximum(slots, 0)
        known = (slots >= 0) & (self.fingerprints[there] == high)
        return known & (self.counts[there] >= min_docs) & (ids != self.largest[there])


_SHARD = "levels array<binary>, fingerprints binary, counts binary, largest binary"
_SHARD_TYPES = [pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary()]
_PARTS = ["levels", "fingerprints", "counts", "largest"]


def _lines(text: bytes | None, min_chars: int) -> tuple[list[bytes], list[tuple[int, bytes]]]:
    """The lines of a text, and the place and 128-bit hash of those whose key is long enough."""
    lines = (text or b"").split(b"\n")
    hashed = []
    for place, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip().lower()  # of bytes: ASCII white space, A-Z
            if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                hashed.append((place, xxhash.xxh3_128_digest(key)))
    return lines, hashed


def _halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _narrow(docs: DataFrame, key: str, text: str) -> DataFrame:
    text_batches(docs.sparkSession)
    return docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))


def count_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """low, high: the halves of a line key's hash; n_docs: documents that have it; largest: their
    largest id. Once per document, however often it says the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = {h for _, h in _lines(text.as_py(), min_chars)[1]}
                hashes += own
                ids += [_NO_ID if doc is None else doc] * len(own)
            low, high = _halves(hashes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(low.view("<i8")), pa.array(high.view("<i8")), pa.array(ids, pa.int64())], ["low", "high", "id"]
            )

    said = _narrow(docs, key, text).mapInArrow(run, "low bigint, high bigint, id bigint")
    return said.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("largest"))


def build_index(counted: DataFrame, staging: Staging, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """shard, shards, probes and the shard's arrays, a row per shard that has a line of at least
    `min_docs` documents. `probes` is how many documents say one of its lines. Starts jobs."""
    common = staging.keep(counted.filter(F.col("n_docs") >= min_docs), "common-lines")
    shards = max(1, -(-common.count() // shard_keys))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        low, high = (table.column(c).to_numpy().view("<u8") for c in ("low", "high"))
        # Two hashes may agree in one half: later ones go to a shard row of their own.
        _, turn = np.unique(low, return_index=True)
        rows, left = [], np.ones(len(low), dtype=bool)
        while left.any():
            chosen = turn if not rows else np.flatnonzero(left)[np.unique(low[left], return_index=True)[1]]
            left[chosen] = False
            counts, largest = (table.column(c).to_numpy()[chosen] for c in ("n_docs", "largest"))
            made = Shard.build(low[chosen], high[chosen], counts, largest)
            rows.append({"shard": key[0].as_py(), "shards": shards, "probes": int(counts.sum())} | made)
        kinds = [pa.int64(), pa.int64(), pa.int64(), *_SHARD_TYPES]
        names = ["shard", "shards", "probes", *_PARTS]
        return pa.table([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    dealt = common.withColumn("shard", F.pmod(F.col("low"), F.lit(shards)))
    schema = f"shard bigint, shards bigint, probes bigint, {_SHARD}"
    return staging.keep(dealt.groupBy("shard").applyInArrow(build, schema), "line-index")


def _size(index: DataFrame) -> int:
    parts = [F.octet_length(c) for c in _PARTS[1:]]
    levels = F.aggregate("levels", F.lit(0), lambda n, x: n + F.octet_length(x))
    return index.agg(F.sum(sum(parts, levels).cast("bigint"))).first()[0] or 0


def _kept(lines: list[bytes], gone: set[int]) -> bytes:
    return b"\n".join([line for place, line in enumerate(lines) if place not in gone]) if gone else b"\n".join(lines)


def _clean(docs: DataFrame, marked: Callable[[list, list, pa.RecordBatch], list[set[int]]], min_chars: int) -> DataFrame:
    """key, n_lines, n_dropped, kept of every text, without the places that `marked` names,
    given a batch's ids, its lines as `_lines` has them, and the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [_lines(text.as_py(), min_chars) for text in batch.column(1)]
            gone = marked(ids, found, batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(lines) for lines, _ in found], pa.int64()),
                    pa.array([len(places) for places in gone], pa.int64()),
                    pa.array([_kept(lines, places) for (lines, _), places in zip(found, gone)], pa.string()),
                ],
                ["key", "n_lines", "n_dropped", "kept"],
            )

    return docs.mapInArrow(run, "key bigint, n_lines bigint, n_dropped bigint, kept string")


def _probed_in_place(narrow: DataFrame, index: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """Every task probes all shards, which were measured."""
    rows = [r.asDict() for r in index.collect()]  # at most BROADCAST_BYTES
    arrays = narrow.sparkSession.sparkContext.broadcast(rows)
    opened: dict[str, list] = {}

    def marked(ids: list, found: list, batch: pa.RecordBatch) -> list[set[int]]:
        if "shards" not in opened:
            opened["shards"] = [(r["shard"], Shard(*(r[c] for c in _PARTS))) for r in arrays.value]
        gone: list[set[int]] = [set() for _ in found]
        hashes = [h for _, hashed in found for _, h in hashed]
        if not hashes or not arrays.value:
            return gone
        low, high = _halves(hashes)
        owner = np.repeat(np.arange(len(found)), [len(hashed) for _, hashed in found])
        docs = np.array([_NO_ID if i is None else i for i in ids], dtype=np.int64)[owner]
        home = low.view("<i8") % arrays.value[0]["shards"]
        dropped = np.zeros(len(low), dtype=bool)
        for number, shard in opened["shards"]:
            mine = np.flatnonzero(home == number)
            dropped[mine] |= shard.dropped(low[mine], high[mine], docs[mine], min_docs)
        places = [place for _, hashed in found for place, _ in hashed]
        for i in np.flatnonzero(dropped).tolist():
            gone[owner[i]].add(places[i])
        return gone

    return _clean(narrow, marked, min_chars)


def _probed_in_shards(narrow: DataFrame, index: DataFrame, staging: Staging, min_chars: int, min_docs: int, probes_per_task: int) -> DataFrame:
    """Hashes go to their shard's tasks; the places that are to go come back to the texts.

    A document is known by its id and a digest of its text: rows that are equal in both lose
    the same lines. `index` gives each shard as many slices as its probes need.
    """
    slices = F.greatest(F.lit(1), F.ceil(F.col("probes") / F.lit(probes_per_task)).cast("bigint"))
    sizes = staging.keep(index.groupBy("shard").agg(F.max("shards").alias("shards"), F.max(slices).alias("slices")), "slices")
    shards = (sizes.agg(F.max("shards")).first()[0]) or 1
    known = narrow.withColumn("digest", F.md5(F.coalesce("text", F.lit(b"")))).withColumn("id", F.coalesce("key", F.lit(_NO_ID)))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            found = [_lines(text.as_py(), min_chars)[1] for text in batch.column(at["text"])]
            hashes = [h for hashed in found for _, h in hashed]
            low, high = _halves(hashes)
            owner = np.repeat(np.arange(len(found)), [len(hashed) for hashed in found])
            places = [place for hashed in found for place, _ in hashed]
            columns = [pa.array(low.view("<i8")), pa.array(high.view("<i8")), pa.array(places, pa.int64())]
            columns += [batch.column(at[c]).take(pa.array(owner)) for c in ("id", "digest")]
            yield pa.RecordBatch.from_arrays(columns, ["low", "high", "place", "id", "digest"])

    asked = known.select("text", "id", "digest").mapInArrow(probes, "low bigint, high bigint, place bigint, id bigint, digest string")
    empty_shard = [F.lit(None).cast(kind).alias(n) for n, kind in zip(_PARTS, ("array<binary>", "binary", "binary", "binary"))]
    empty_probe = [F.lit(None).cast(kind).alias(n) for n, kind in (("low", "bigint"), ("high", "bigint"), ("place", "bigint"), ("id", "bigint"), ("digest", "string"))]
    # At most as many rows as shards, of three numbers each.
    asked = asked.withColumn("shard", F.pmod("low", F.lit(shards))).join(F.broadcast(sizes.select("shard", "slices")), "shard")
    dealt = asked.select(
        "shard", F.pmod(F.xxhash64("id", "digest", "place"), "slices").alias("slice"), F.lit(1).alias("turn"), *empty_shard, "low", "high", "place", "id", "digest"
    )
    sent = index.join(sizes.select("shard", "slices"), "shard").select(
        "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("turn"), *_PARTS, *empty_probe
    )
    tasks = max(int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions")), sizes.agg(F.sum("slices")).first()[0] or 1)
    together = sent.unionByName(dealt).repartition(tasks, "shard", "slice").sortWithinPartitions("shard", "slice", "turn")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Shard] = []
        where = None
        for batch in batches:
            turn = batch.column(2).to_numpy()
            numbers = batch.column(0).to_numpy() * (1 << 32) + batch.column(1).to_numpy()
            edges = np.flatnonzero(np.append(True, (np.diff(numbers) != 0) | (np.diff(turn) != 0)))
            for begin, end in zip(edges.tolist(), [*edges[1:].tolist(), len(turn)]):
                part = batch.slice(begin, end - begin)
                if turn[begin] == 0:
                    if where != numbers[begin]:
                        held, where = [], numbers[begin]
                    held += [Shard(*(r[c] for c in _PARTS)) for r in part.select(_PARTS).to_pylist()]
                    continue
                low, high, ids = (part.column(c).to_numpy() for c in ("low", "high", "id"))
                gone = np.zeros(len(low), dtype=bool)
                for shard in held:
                    gone |= shard.dropped(low.view("<u8"), high.view("<u8"), ids, min_docs)
                yield part.select(["id", "digest", "place"]).filter(pa.array(gone))

    gone = together.mapInArrow(answer, "id bigint, digest string, place bigint")
    # A document's places: no more than its lines.
    places = staging.keep(gone.groupBy("id", "digest").agg(F.collect_set("place").alias("places")), "places")
    with_places = known.join(places, ["id", "digest"], "left").select("key", "text", "places")

    def marked(ids: list, found: list, batch: pa.RecordBatch) -> list[set[int]]:
        return [set(p or ()) for p in batch.column(2).to_pylist()]

    return _clean(with_places, marked, min_chars)


def drop_common_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    shard_keys: int = SHARD_KEYS,
    broadcast_bytes: int = BROADCAST_BYTES,
    probes_per_task: int = PROBES_PER_TASK,
) -> DataFrame:
    """key, n_lines (before), n_dropped, kept: the text without the lines whose key, of at least
    `min_chars` code points, `min_docs` documents have; the largest id keeps them. Starts jobs."""
    staging = Staging(docs.sparkSession, "lines")
    index = build_index(count_lines(docs, key, text, min_chars), staging, min_docs, shard_keys)
    narrow = _narrow(docs, key, text)
    if _size(index) <= broadcast_bytes:
        cleaned = _probed_in_place(narrow, index, min_chars, min_docs)
    else:
        cleaned = _probed_in_shards(narrow, index, staging, min_chars, min_docs, probes_per_task)
    return cleaned.withColumnRenamed("key", key)
