"""Near-duplicates: banded MinHash, odd sketches, then full sets.

A document's set is its distinct 5-word shingles (64-bit hashes of lower-cased words).

1. Documents with equal sets are one class, known by a 128-bit digest of the set; from here
   on a class is its smallest doc_id.
2. 160 MinHash samples make 32 bands of 5. Two sets of similarity 0.85 or more share a band
   but for a chance of 7e-9.
3. The samples are also folded into an odd sketch: each flips one of 1024 bits. Two samples
   that differ flip two bits, so the population count of the XOR of two sketches tells, for
   similar sets precisely, how many of the samples differ. More than 102 set bits need 52
   differing samples of 160, which sets of similarity 0.85 have with a chance below 1e-7.
   Members of a band bucket whose sketches pass are joined into groups: every link lies
   inside a group, and a group is no wider than chains of near-copies.
4. Each group's full sets meet once. Pairs of different components, most alike first, are
   compared exactly until nothing is left to join.
5. Links are reduced to connected components.

No step gathers a whole bucket or group in one task, collects it, or writes out its pairs.
Large buckets are dealt into blocks that share a few hubs; members that no hub reaches there
are put into the bucket's group unseen, which can only widen it. Large groups are dealt into
blocks with hubs, too; what remains outside the largest component after that is compared
with all of its group, block by block.

Defined results: a NULL or empty text, or one without words, has the empty set and is linked
with nothing. A row without doc_id is linked with nothing, has no component and is kept.
Rows with the same doc_id are one document: its texts are linked, and all rows stay or go.
Texts that are equal are compared once; very long ones count whole. Of documents that are
equally good the smallest id stands for a group. Every input row gives one row, an empty
frame none. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.llm.links import components
from sluicegate.llm.tables import Staging, fresh_name, text_batches
from sluicegate.sources.workspace import broadcast_if_small

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 85
BANDS, BAND_ROWS = 32, 5
SAMPLES = BANDS * BAND_ROWS
SKETCH_BITS = 1024
MAX_ODD_BITS = 102

BLOCK_ROWS = 1024
BLOCK_BYTES = 64 << 20
HUBS = 8

_WORD = regex.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_WORD_MEMO = 300_000
_SLICE = 2048

_random = np.random.Generator(np.random.PCG64(20240607))
_SCALE = _random.integers(0, 2**64, SAMPLES, dtype=np.uint64) | np.uint64(1)
_SHIFT = _random.integers(0, 2**64, SAMPLES, dtype=np.uint64)
_ORDER = _random.integers(0, 2**64, SHINGLE_WORDS, dtype=np.uint64) | np.uint64(1)
_IN_BAND = _random.integers(0, 2**64, BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_BAND = _random.integers(0, 2**64, BANDS, dtype=np.uint64)
_SAMPLE = _random.integers(0, 2**64, SAMPLES, dtype=np.uint64)


class _Hashes(dict):
    """Word -> 64-bit hash; forgets all when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _WORD_MEMO:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: dict[str, int]) -> np.ndarray:
    """Sorted distinct hashes of all 5-word windows, of the whole if there are fewer words."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return np.empty(0, dtype=np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(SHINGLE_WORDS, len(each))
    windows = np.full(len(each) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        windows += _mixed(each[i : len(each) - size + 1 + i] + _ORDER[i]) * _ORDER[i]
    return np.unique(_mixed(windows))


def samples(values: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that isn't empty."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(values), _SLICE):
        part = values[i : i + _SLICE, None] * _SCALE[None, :] + _SHIFT[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    return least


def band_keys(sampled: np.ndarray) -> np.ndarray:
    return _mixed((_mixed(sampled.reshape(BANDS, BAND_ROWS)) * _IN_BAND).sum(axis=1, dtype=np.uint64) + _BAND)


def odd_sketch(sampled: np.ndarray) -> bytes:
    """A bit is set if an odd number of samples fall on it."""
    bits = _mixed(sampled + _SAMPLE) % np.uint64(SKETCH_BITS)
    odd = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, n_shingles, set_key, bands, sketch of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            sizes, keys, bands, sketches = [], [], [], []
            for value in batch.column(1):
                values = shingles(value.as_py(), hashes)
                sizes.append(len(values))
                if len(values):
                    sampled = samples(values)
                    keys.append(_digest(values))
                    bands.append(band_keys(sampled).view(np.int64))
                    sketches.append(odd_sketch(sampled))
                else:
                    keys.append(None)
                    bands.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketches, pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_key", "bands", "sketch"],
            )

    narrow = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return narrow.mapInArrow(
        work, "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, sketch binary"
    )


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _in_blocks(rows: DataFrame, by: list[str], names: list[str], work: Callable, schema: str) -> DataFrame:
    """`work` on the columns `names` of each block, a list per column, the block's rows by
    `doc_id`. Blocks are bounded; a task holds one at a time."""
    columns = [*by, *names]
    kinds = schema.replace(",", " ").split()[::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, [[] for _ in names]
        for batch in batches:
            lists = [c.to_pylist() for c in batch.columns]
            for row in zip(*lists, strict=True):
                block = row[: len(by)]
                if block != current:
                    if current is not None:
                        yield _batch(work(*held), kinds)
                    current, held = block, [[] for _ in names]
                for column, value in zip(held, row[len(by) :], strict=True):
                    column.append(value)
        if current is not None:
            yield _batch(work(*held), kinds)

    return rows.select(*columns).repartition(*by).sortWithinPartitions(*by, "doc_id").mapInArrow(run, schema)


def _batch(pairs: list[tuple[int, int]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in range(2)], names)


def _odd_bits(sketches: list[bytes], others: list[bytes] | None = None) -> np.ndarray:
    """Population counts of the XOR of all sketches with all (others)."""
    words = lambda s: np.frombuffer(b"".join(s), dtype=np.uint64).reshape(len(s), -1)
    left = words(sketches)
    right = left if others is None else words(others)
    bits = np.empty((len(left), len(right)), dtype=np.uint16)
    for i in range(0, len(left), 64):
        bits[i : i + 64] = np.bitwise_count(left[i : i + 64, None, :] ^ right[None, :, :]).sum(axis=2, dtype=np.uint16)
    return bits


def _alike(doc_ids: list[int], sketches: list[bytes], hubs: list[int | None]) -> list[tuple[int, int]]:
    """A tree of links for each set of members that sketches connect. In a bucket of several
    blocks, trees without a hub are tied to the first one."""
    near = _odd_bits(sketches) <= MAX_ODD_BITS
    first_hub = next((i for i, h in enumerate(hubs) if h), None)
    fresh = np.ones(len(doc_ids), dtype=bool)
    links = []
    for start in range(len(doc_ids)):
        if not fresh[start]:
            continue
        fresh[start] = False
        queue, has_hub = [start], False
        while queue:
            at = queue.pop()
            has_hub |= bool(hubs[at])
            found = np.nonzero(near[at] & fresh)[0]
            fresh[found] = False
            queue += found.tolist()
            links += [(doc_ids[at], doc_ids[j]) for j in found]
        if first_hub is not None and not has_hub:
            links.append((doc_ids[start], doc_ids[first_hub]))
    return links


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 85 * union, of sorted distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < SIMILAR_PERCENT * len(b):
        return False
    at = b.searchsorted(a)
    common = int(np.count_nonzero(b.take(at, mode="clip") == a))
    return 100 * common >= SIMILAR_PERCENT * (len(a) + len(b) - common)


class _Joined:
    """Union-find over row numbers."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def _confirmed(
    doc_ids: list[int], sketches: list[bytes], sets: list[bytes], sides: list[int], known: list[int]
) -> list[tuple[int, int]]:
    """Links of full sets that connect a block: between any two rows, or, where rows have
    the sides 0 and 1, between these. Rows with the same `known` component need none."""
    joined = _Joined(len(doc_ids))
    first: dict[int, int] = {}
    for i, component in enumerate(known):
        joined.join(first.setdefault(component, i), i)
    values = [np.frombuffer(s, dtype=np.uint64) for s in sets]
    sizes = np.array([len(v) for v in values])
    side = np.array(sides)
    rows = np.arange(len(doc_ids)) if not side.any() else np.nonzero(side)[0]
    columns = np.arange(len(doc_ids)) if not side.any() else np.nonzero(side == 0)[0]
    bits = _odd_bits([sketches[i] for i in rows], [sketches[j] for j in columns])
    small = np.minimum(sizes[rows, None], sizes[None, columns])
    large = np.maximum(sizes[rows, None], sizes[None, columns])
    maybe = (bits <= MAX_ODD_BITS) & (100 * small >= SIMILAR_PERCENT * large)
    if not side.any():
        maybe &= rows[:, None] < columns[None, :]
    at_row, at_column = np.nonzero(maybe)
    links = []
    for k in np.argsort(bits[at_row, at_column], kind="stable"):
        i, j = int(rows[at_row[k]]), int(columns[at_column[k]])
        if joined.find(i) != joined.find(j) and similar(values[i], values[j]):
            joined.join(i, j)
            links.append((doc_ids[i], doc_ids[j]))
    return links


def _hubs(rows: DataFrame, by: str, blocks: str) -> DataFrame:
    """Up to `HUBS` members of each `by`, once for each of its blocks: by, block, doc_id."""
    slot = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(HUBS))
    least = [F.min(F.when(slot == i, F.col("doc_id"))) for i in range(HUBS)]
    return (
        rows.groupBy(by, blocks)
        .agg(F.array_compact(F.array(*least)).alias("hubs"))
        .select(by, F.explode("hubs").alias("doc_id"), blocks)
        .select(by, "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1)).alias("block"))
    )


def _with_hubs(rows: DataFrame, by: str, blocks: str) -> DataFrame:
    """Members with their block and, for those of several blocks, the hubs in each of them:
    by, doc_id, block, hub."""
    own = rows.select(
        by, "doc_id", F.pmod(F.xxhash64("doc_id"), F.col(blocks)).alias("block"), F.lit(False).alias("hub")
    )
    hubs = _hubs(rows.filter(F.col(blocks) > 1), by, blocks).select(by, "doc_id", "block", F.lit(True).alias("hub"))
    # A hub's own row is in one of the blocks already.
    return own.unionByName(hubs).groupBy(by, "doc_id", "block").agg(F.max("hub").alias("hub"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row per row of `docs`: key, n_shingles, component_id (the smallest doc_id that
    links reach, itself included) and kept (it is that one). Starts jobs."""
    spark = docs.sparkSession
    text_batches(spark)
    staging = Staging(spark, "duplicates")
    rows = staging.keep(_features(docs, key, text), "features")
    classes = staging.keep(
        rows.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("set_key")
        .agg(F.min_by(F.struct("doc_id", "bands", "sketch"), "doc_id").alias("first"))
        .select("set_key", "first.*"),
        "classes",
    )
    groups = staging.keep(_groups(classes, staging, block_rows), "groups")
    linked = _components(docs, key, text, classes, groups, staging, block_rows)
    of_class = classes.select("set_key", "doc_id").join(
        linked.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left"
    )
    component = F.coalesce("component", "first_id", "doc_id")
    return (
        rows.select("doc_id", "n_shingles", "set_key")
        .join(of_class.select("set_key", "component", F.col("doc_id").alias("first_id")), "set_key", "left")
        .select(
            F.col("doc_id").alias(key),
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
            F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        )
    )


def _groups(classes: DataFrame, staging: Staging, block_rows: int) -> DataFrame:
    """node, component: groups of classes that sketches connect within band buckets."""
    banded = classes.select("doc_id", F.explode("bands").alias("bucket"))
    shared = staging.keep(
        banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "buckets"
    )
    blocks = F.ceil(F.col("rows") / block_rows).alias("blocks")
    members = staging.keep(
        banded.join(broadcast_if_small(shared.select("bucket", blocks)), "bucket"), "members"
    )
    dealt = _with_hubs(members, "bucket", "blocks").join(classes.select("doc_id", "sketch"), "doc_id")
    alike = _in_blocks(dealt, ["bucket", "block"], ["doc_id", "sketch", "hub"], _alike, "a bigint, b bigint")
    return components(alike, staging)


def _components(
    docs: DataFrame,
    key: str,
    text: str,
    classes: DataFrame,
    groups: DataFrame,
    staging: Staging,
    block_rows: int,
) -> DataFrame:
    """node, component: what links of full sets connect."""
    members = classes.select("doc_id", "set_key", "sketch").join(
        groups.select(F.col("node").alias("doc_id"), F.col("component").alias("group")), "doc_id"
    )
    members = staging.keep(members, "grouped")
    sets = staging.keep(_sets(docs, key, text, members), "sets")
    blocks = sets.groupBy("group").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum(F.length("values")) / F.lit(BLOCK_BYTES))
        ).alias("blocks")
    )
    blocks = staging.keep(blocks, "blocks")
    placed = sets.select("group", "doc_id").join(blocks, "group")
    dealt = _with_hubs(placed, "group", "blocks").join(sets.drop("group"), "doc_id")
    dealt = dealt.select("*", F.lit(0).alias("side"), F.col("doc_id").alias("known"))
    names = ["doc_id", "sketch", "values", "side", "known"]
    links = staging.keep(_in_blocks(dealt, ["group", "block"], names, _confirmed, "a bigint, b bigint"), "confirmed")
    found = components(links, staging)

    # Groups of several blocks: what is outside the largest component meets all others.
    several = placed.filter("blocks > 1").join(
        found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left"
    )
    several = staging.keep(several.select("group", "doc_id", "blocks", F.coalesce("component", "doc_id").alias("known")), "several")
    largest = (
        several.groupBy("group", "known")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("group")
        .agg(F.max_by("known", F.struct("rows", "known")).alias("largest"))
    )
    outside = several.join(largest, "group").filter("known <> largest").drop("largest")
    outside = staging.keep(outside, "outside")
    if outside.isEmpty():
        return found
    rest = outside.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("rest_blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col(n))
    base = several.join(rest, "group").select(
        "group", "doc_id", "known", F.lit(0).alias("side"), own("blocks").alias("block"), every("rest_blocks").alias("rest")
    )
    facing = outside.join(rest, "group").select(
        "group", "doc_id", "known", F.lit(1).alias("side"), every("blocks").alias("block"), own("rest_blocks").alias("rest")
    )
    met = base.unionByName(facing).join(sets.drop("group"), "doc_id")
    more = _in_blocks(met, ["group", "block", "rest"], names, _confirmed, "a bigint, b bigint")
    return components(links.unionByName(more), staging)


def _sets(docs: DataFrame, key: str, text: str, members: DataFrame) -> DataFrame:
    """group, doc_id, sketch, values: the full sets of grouped classes, read from the texts
    again rather than stored for all documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            values = [shingles(t.as_py(), hashes) for t in batch.column(3)]
            # Another text under the same doc_id is not the one that the class is about.
            same = pa.array([_digest(v) == k.as_py() for v, k in zip(values, batch.column(4), strict=True)])
            packed = pa.array([v.tobytes() for v in values], pa.binary())
            whole = pa.RecordBatch.from_arrays(
                [*batch.columns[:3], packed], ["group", "doc_id", "sketch", "values"]
            )
            yield whole.filter(same)

    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return (
        texts.join(broadcast_if_small(members), "doc_id")
        .select("group", "doc_id", "sketch", "text", "set_key")
        .mapInArrow(work, "group bigint, doc_id bigint, sketch binary, values binary")
    )


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that link to a smaller doc_id, with their own columns."""
    staging = Staging(docs.sparkSession, "copies")
    name = fresh_name(docs, "gone")
    gone = near_duplicates(docs, key, text).filter("not kept").select(F.col(key).alias(name)).distinct()
    gone = staging.keep(gone, "gone")
    return docs.join(broadcast_if_small(gone), F.col(f"`{key}`") == F.col(name), "left_anti")
