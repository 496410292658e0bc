"""The trie of conversation prefixes, as balanced parentheses per shard.

A conversation is narrowed to its turns' digests and token counts, so no text moves.
Conversations are sorted by their digests and cut into shards. A shard writes its trie as one
sequence of parentheses, in the order of a depth-first walk; blocks of the excess (open minus
closed) with their smallest values, and a tree of smallest values over them, find the
parenthesis that closes a node. Between the two lies the node's subtree: ranks of "()" count
its leaves, and differences of cumulative arrays give its conversations and savings.

The nodes on the paths to a shard's first and last conversation, its spines, may go on in
other shards. A shard gives them out as two rows with, for each depth, what hangs from that
node in this shard only. These rows are sorted and cut in the same way, until one shard is
left; each level has a small part of the rows of the one below. The numbers of the
conversations that end at a spine's node travel apart, in pieces, and are digested as a
stream; so a conversation that a third of all rows repeat is never in one place.

Defined results: turns are ordered by turn, NULL first, and equal ones by digest; a NULL role
or text is an empty one, very long ones are digested whole; rows without a conv_id belong to no
conversation; repeated rows are repeated turns; conversations that are equal share their
node, the smallest conv_id stands for it; an empty frame gives an empty frame. Only the named
columns are read, so no name can clash. A conversation's own turns, 20 bytes each, have to
fit into a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicegate.llm.tables import Staging, text_batches
from sluicegate.plans.skew import measured_lookup

WORDS = r"[^\x20\x09-\x0D]+"
ROWS_PER_SHARD = 200_000
# Parentheses per block of the excess, and numbers of ended conversations per piece.
BLOCK, PIECE = 256, 2_000

_DIGEST = 16
_ROOT = bytes(_DIGEST)
_WEIGHTS = ("ends", "convs", "leaves", "saved", "children")
_NODE = (
    "key binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
_NODE_TYPES = {
    "key": pa.binary(), "parent": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(),
    "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(),
}
_SPINE = "path binary, tokens array<int>, least array<bigint>, " + ", ".join(f"{w} array<bigint>" for w in _WEIGHTS)
_SPINE_TYPES = {"path": pa.binary(), "tokens": pa.list_(pa.int32()), "least": pa.list_(pa.int64())} | {w: pa.list_(pa.int64()) for w in _WEIGHTS}
_PIECE = "key binary, first bigint, ids string"
_PIECE_TYPES = {"key": pa.binary(), "first": pa.int64(), "ids": pa.string()}
# A shard gives rows of three kinds; two of the three parts are NULL in each.
_KINDS = {"node": _NODE, "spine": _SPINE, "piece": _PIECE}
_OUT = ", ".join(f"{n} struct<{', '.join(c.replace(' ', ': ', 1) for c in kind.split(', '))}>" for n, kind in _KINDS.items())
_OUT_TYPES = {n: pa.struct(list(t.items())) for n, t in (("node", _NODE_TYPES), ("spine", _SPINE_TYPES), ("piece", _PIECE_TYPES))}


class Parentheses:
    """A balanced sequence (1 opens, 0 closes) with range minima of its excess."""

    def __init__(self, bits: np.ndarray, block: int = BLOCK):
        self.block = block
        self.excess = np.cumsum(bits.astype(np.int64) * 2 - 1)
        blocks = max(1, -(-len(bits) // block))
        padded = np.full(blocks * block, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        self.minima = [padded.reshape(blocks, block).min(axis=1)]
        while len(self.minima[-1]) > 1:
            below = self.minima[-1]
            if len(below) % 2:
                below = np.append(below, np.iinfo(np.int64).max)
            self.minima.append(below.reshape(-1, 2).min(axis=1))
        leaf = np.zeros(len(bits), dtype=np.int64)
        leaf[:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self.leaf_pairs = np.append(0, np.cumsum(leaf))
        self.opened = np.append(0, np.cumsum(bits.astype(np.int64)))

    def findclose(self, start: int) -> int:
        """Where the parenthesis that opens at `start` closes: the first later place whose excess
        is one less than at `start`."""
        wanted = self.excess[start] - 1
        number = start // self.block
        inside = np.flatnonzero(self.excess[start + 1 : (number + 1) * self.block] == wanted)
        if len(inside):
            return start + 1 + int(inside[0])
        level = 0
        while True:  # to the right, and up where a pair of ranges ends
            number += 1
            if number < len(self.minima[level]) and self.minima[level][number] <= wanted:
                break
            while number % 2:
                number, level = number // 2, level + 1
            if level >= len(self.minima) or number >= len(self.minima[level]):
                raise ValueError("the sequence is not balanced")
        while level:  # down, to its first block
            level, number = level - 1, number * 2
            if self.minima[level][number] > wanted:
                number += 1
        begin = number * self.block
        return begin + int(np.flatnonzero(self.excess[begin : begin + self.block] == wanted)[0])

    def leaves(self, start: int, close: int) -> int:
        return int(self.leaf_pairs[close] - self.leaf_pairs[start])

    def nodes(self, start: int, close: int) -> tuple[int, int]:
        """The subtree as a range of nodes in the order of their opening."""
        return int(self.opened[start]), int(self.opened[close])


class _Shard:
    """Takes sorted paths, writes the parentheses, and gives out nodes, spines and pieces."""

    def __init__(self):
        self.bits: list[int] = []
        self.opens: list[int] = []
        self.parents: list[int] = []
        self.depths: list[int] = []
        self.tokens: list[int] = []
        self.keys: list[bytes] = []
        self.marks: list[bytes] = []
        self.least: list[int | None] = []
        self.weights: dict[str, list[int]] = {w: [] for w in _WEIGHTS}
        self.ended: dict[int, list[int]] = {}
        self.open: list[int] = []  # the nodes of the last path
        self.first: list[int] = []
        self.path = b""

    def _node(self, mark: bytes, tokens: int) -> None:
        parent = self.open[-1] if self.open else -1
        self.open.append(len(self.opens))
        self.opens.append(len(self.bits))
        self.bits.append(1)
        self.parents.append(parent)
        self.depths.append(len(self.open) - 1)
        self.tokens.append(tokens)
        self.marks.append(mark)
        self.keys.append(hashlib.md5(self.keys[parent] + mark).digest() if mark else _ROOT)
        self.least.append(None)
        for held in self.weights.values():
            held.append(0)

    def add(self, path: bytes, tokens: list[int]) -> list[int]:
        """Open what is new on a path; its nodes, from the root."""
        if not self.open:
            self._node(b"", 0)
            common = 0
        else:
            common = 0
            most = min(len(path), len(self.path))
            if path[:most] == self.path[:most]:
                common = most // _DIGEST
            else:
                while path[common * _DIGEST : (common + 1) * _DIGEST] == self.path[common * _DIGEST : (common + 1) * _DIGEST]:
                    common += 1
            self.bits += [0] * (len(self.open) - 1 - common)
            del self.open[common + 1 :]
        for d in range(common, len(path) // _DIGEST):
            self._node(path[d * _DIGEST : (d + 1) * _DIGEST], tokens[d])
        self.path = path
        if not self.first:
            self.first = list(self.open)
        return self.open

    def end(self, node: int, conv_id: int) -> None:
        self.weights["ends"][node] += 1
        self.lower(node, conv_id)
        self.ended.setdefault(node, []).append(conv_id)

    def lower(self, node: int, conv_id: int | None) -> None:
        if conv_id is not None and (self.least[node] is None or conv_id < self.least[node]):
            self.least[node] = conv_id

    def results(self, final: bool) -> Iterator[tuple[str, dict]]:
        if not self.open:
            return
        size = len(self.opens)
        last = list(self.open)
        bits = np.array(self.bits + [0] * len(self.open), dtype=np.int8)
        walk = Parentheses(bits)
        closes = [walk.findclose(start) for start in self.opens]
        spine = [] if final else sorted({*self.first, *last})
        on_spine = np.zeros(size, dtype=bool)
        on_spine[spine] = True
        w = {name: np.array(held, dtype=np.int64) for name, held in self.weights.items()}
        begins, ends = (np.array(x, dtype=np.int64) for x in zip(*(walk.nodes(s, c) for s, c in zip(self.opens, closes))))
        parents = np.array(self.parents, dtype=np.int64)
        children = np.bincount(parents[1:], minlength=size) + w["children"]

        def below(values: np.ndarray) -> np.ndarray:
            """Sums over subtrees."""
            running = np.append(0, np.cumsum(values))
            return running[ends] - running[begins]

        convs = below(w["ends"] + w["convs"])
        own = np.where(on_spine, 0, (convs - 1) * np.array(self.tokens, dtype=np.int64))
        saved = below(own + w["saved"])
        # A "()" is a leaf, unless it is a spine's node or has children in the level below.
        pairs = np.array([walk.leaves(s, c) for s, c in zip(self.opens, closes)], dtype=np.int64)
        no_leaf = (ends - begins == 1) & (on_spine | (w["children"] > 0))
        leaves = pairs + below(w["leaves"] - no_leaf)
        for node in range(size - 1, 0, -1):
            self.lower(self.parents[node], self.least[node])

        for node in range(size):
            if on_spine[node]:
                continue
            parent = self.parents[node]
            hangs = parent >= 0 and on_spine[parent]
            yield "node", {
                "key": self.keys[node], "parent": self.keys[parent] if hangs else None, "conv_id": self.least[node],
                "depth": self.depths[node], "parent_conv_id": self.least[parent] if parent >= 0 and not hangs else None,
                "n_convs": int(convs[node]), "n_children": int(children[node]), "n_leaves": int(leaves[node]),
                "saved_tokens": int(saved[node]), "ends_sha256": _digest(self.ended.get(node)),
            }
        # What hangs from a spine's node, without what hangs from the next ones on a spine.
        alone = {"ends": w["ends"], "convs": convs - w["ends"], "leaves": leaves.copy(), "saved": saved.copy(), "children": children}
        for node in spine[1:]:
            parent = self.parents[node]
            for name, whole in (("convs", convs), ("leaves", leaves), ("saved", saved)):
                alone[name][parent] -= whole[node]
            alone["children"][parent] -= 1
        yield from self._spines(spine, last, alone)

    def _spines(self, spine: list[int], last: list[int], alone: dict[str, np.ndarray]) -> Iterator[tuple[str, dict]]:
        """The paths to the first and the last conversation, and who ends on them."""
        told: set[int] = set()
        for nodes in (self.first, last) if spine else ():
            fresh = [node not in told for node in nodes]
            told.update(nodes)
            yield "spine", {
                "path": b"".join(self.marks[node] for node in nodes),
                "tokens": [self.tokens[node] for node in nodes[1:]],
                "least": [self.least[node] for node in nodes],
            } | {name: [int(alone[name][node]) if new else 0 for node, new in zip(nodes, fresh)] for name in _WEIGHTS}
        for node in spine:
            ids = self.ended.get(node, [])
            for begin in range(0, len(ids), PIECE):
                part = ids[begin : begin + PIECE]
                yield "piece", {"key": self.keys[node], "first": part[0], "ids": ",".join(map(str, part))}


def _digest(ids: list[int] | None) -> str:
    return hashlib.sha256(",".join(map(str, ids or ())).encode()).hexdigest()


def _batches(rows: Iterator[tuple[str, dict]], size: int = 4_000) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {n: [] for n in _OUT_TYPES}
    for kind, row in rows:
        for name, column in held.items():
            column.append(row if name == kind else None)
        if len(held["node"]) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, _OUT_TYPES[n]) for n, c in held.items()], list(held))
            held = {n: [] for n in _OUT_TYPES}
    if held["node"]:
        yield pa.RecordBatch.from_arrays([pa.array(c, _OUT_TYPES[n]) for n, c in held.items()], list(held))


def _from_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = _Shard()
    for batch in batches:
        for conv_id, path, tokens in zip(*(c.to_pylist() for c in batch.columns)):
            shard.end(shard.add(path, tokens)[-1], conv_id)
    yield from _batches(shard.results(final=False))


def _from_spines(final: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for row in batch.to_pylist():
                for depth, node in enumerate(shard.add(row["path"], row["tokens"])):
                    shard.lower(node, row["least"][depth])
                    for name, held in shard.weights.items():
                        held[node] += row[name][depth]
        yield from _batches(shard.results(final))

    return run


def _streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of key and first number: one digest for each key."""
    key, hashed = None, hashlib.sha256()
    done: list[tuple[bytes, str]] = []
    for batch in batches:
        for own, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if own != key:
                if key is not None:
                    done.append((key, hashed.hexdigest()))
                key, hashed = own, hashlib.sha256(ids.encode())
            else:
                hashed.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.binary(), pa.string()))], ["key", "streamed"])
            done = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([hashed.hexdigest()], pa.string())], ["key", "streamed"])


def conversation_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns: for each turn in order, `mark` (a digest of role and text) and `tokens`."""
    said_by, said = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    narrow = rows.filter(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("bigint").alias("conv_id"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"),
            F.unhex(F.md5(F.concat(F.length(said_by).cast("string"), F.lit(":"), said_by, said))).alias("mark"),
            F.regexp_count(said, F.lit(WORDS)).alias("tokens"),
        ).alias("entry"),
    )
    entries = F.array_sort(F.collect_list("entry"))
    return narrow.groupBy("conv_id").agg(F.transform(entries, lambda e: F.struct(e["mark"].alias("mark"), e["tokens"].alias("tokens"))).alias("turns"))


def prefix_trie(conversations: DataFrame, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """A row for each node of the trie of `conversations` (conv_id, turns; distinct conv_ids).

    conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves
    and saved_tokens (over the subtree: members beyond the first times the node's own tokens),
    ends_sha256 (of the members that end here, numerically, joined by commas). Starts jobs.
    """
    spark = conversations.sparkSession
    text_batches(spark)
    staging = Staging(spark, "trie")
    marks: Column = F.array_join(F.transform("turns", lambda t: F.hex(t["mark"])), "")
    paths = staging.keep(conversations.select("conv_id", F.unhex(marks).alias("path"), F.col("turns.tokens").alias("tokens")), "paths")
    shards = max(-(-paths.count() // rows_per_shard), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["path", "conv_id"]
    dealt = paths.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    told = staging.keep(dealt.mapInArrow(_from_conversations, _OUT), "shards")
    staging.drop(paths)
    lowest = told.filter("node is not null").select("node.*")
    upper = []
    pieces = told.filter("piece is not null").select("piece.*")
    while True:
        spines = told.filter("spine is not null").select("spine.*")
        rows = spines.count()
        final = rows <= rows_per_shard
        dealt = spines.coalesce(1) if final else spines.repartitionByRange(-(-rows // rows_per_shard), "path")
        told = staging.keep(dealt.sortWithinPartitions("path").mapInArrow(_from_spines(final), _OUT), "spines")
        upper.append(told.filter("node is not null").select("node.*"))
        if final:
            break
        rows_per_shard *= 2
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    digests = pieces.repartition(parts, "key").sortWithinPartitions("key", "first").mapInArrow(_streamed_digests, "key binary, streamed string")
    joined = upper[0]
    for more in upper[1:]:
        joined = joined.unionByName(more)
    joined = joined.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("streamed", "ends_sha256")).drop("streamed")
    shared = staging.keep(joined, "shared")
    hung = measured_lookup(
        lowest.unionByName(shared),
        staging.keep(shared.select(F.col("key").alias("parent"), F.col("conv_id").alias("hangs_from")), "parents"),
        ["parent"],
        "conv_id",
    )
    return hung.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "hangs_from").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    )
