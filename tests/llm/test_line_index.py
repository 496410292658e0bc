import random
from collections import defaultdict

import numpy as np
import pytest

from sluicegate.llm.line_index import PerfectHash, Shard, build_index, count_lines, drop_common_lines
from sluicegate.llm.tables import Staging

SPACE = " \t\n\x0b\x0c\r"
WAYS = [
    {},
    {"shard_keys": 4},
    {"broadcast_bytes": -1},
    {"broadcast_bytes": -1, "shard_keys": 4, "probes_per_task": 20},
]


def key_of(line):
    return line.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})


def brute_force(rows, min_chars=40, min_docs=5):
    counts, largest = defaultdict(int), {}
    as_id = lambda i: -(2**63) if i is None else i
    for doc_id, text in rows:
        for key in {key_of(line) for line in (text or "").split("\n")}:
            counts[key] += 1
            largest[key] = max(largest.get(key, -(2**63)), as_id(doc_id))
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = lambda k, i=as_id(doc_id): len(k) >= min_chars and counts[k] >= min_docs and largest[k] != i
        kept = [line for line in lines if not gone(key_of(line))]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [0, 1, 2, 3, 64, 1000, 50_000])
def test_perfect_hash(size):
    draw = np.random.default_rng(size)
    keys = np.unique(draw.integers(0, 2**64, size, dtype=np.uint64))
    made = PerfectHash.build(keys)
    assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
    if size > 1000:
        assert sum(len(words) * 64 for words in made.levels) < 3.2 * size


def test_shard_tells_strangers_apart():
    draw = np.random.default_rng(1)
    low, high = (draw.integers(0, 2**64, 500, dtype=np.uint64) for _ in range(2))
    parts = Shard.build(low, high, np.full(500, 7), np.arange(500))
    shard = Shard(*(parts[c] for c in ("levels", "fingerprints", "counts", "largest")))
    ids = np.arange(500) + 1
    assert shard.dropped(low, high, ids, 5).all()
    assert not shard.dropped(low, high, np.arange(500), 5).any()
    assert not shard.dropped(low, high, ids, 8).any()
    assert not shard.dropped(low, high + np.uint64(1), ids, 5).any()
    assert not shard.dropped(high, low, ids, 5).any()


def documents():
    draw = random.Random(2)
    pool = ["x" * 39, "é" * 39, "é" * 40, " \tAb " + "Ab " * 19 + "\r", "ab " * 20, "ab " * 19 + "ab\x0b", " " + "ab " * 20, "\x00" * 45]
    pool += [f"line {i} " * 8 for i in range(30)] + ["short", "", " " * 60]
    rows = [(i, "\n".join(draw.choice(pool) for _ in range(draw.randint(0, 12)))) for i in range(150)]
    rows += rows[:20] + [(None, pool[4]), (None, None), (3, None), (4, "\n".join(pool * 900)), (900, pool[9] + "\n" + pool[9]), (900, pool[9])]
    return rows


@pytest.mark.parametrize("way", WAYS)
def test_against_brute_force(frame, way):
    rows = documents()
    docs = frame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, low string, places int")
    got = sorted(map(tuple, drop_common_lines(docs, **way).collect()), key=repr)
    assert sum(r[2] for r in got) > 100
    assert got == brute_force(rows)


@pytest.mark.parametrize("way", WAYS)
def test_empty(frame, way):
    assert drop_common_lines(frame([], "doc_id bigint, text string"), **way).collect() == []


def test_hashes_that_agree_in_one_half(spark, frame):
    counted = frame([(5, 1, 6, 9), (5, 2, 7, 9), (8, 1, 8, 9), (9, 9, 2, 1)], "low bigint, high bigint, n_docs bigint, largest bigint")
    index = build_index(counted, Staging(spark, "agreeing")).collect()
    assert sorted(r.probes for r in index) == [7, 14]
    shards = [Shard(r.levels, r.fingerprints, r.counts, r.largest) for r in index]
    low, high = np.array([5, 5, 8, 9], dtype=np.uint64), np.array([1, 2, 1, 9], dtype=np.uint64)
    found = np.array([s.dropped(low, high, np.zeros(4, dtype=np.int64), 5) for s in shards])
    assert found.any(axis=0).tolist() == [True, True, True, False]


def test_counts_are_of_documents(frame):
    line = "this line is said by more than one of them"
    counted = count_lines(frame([(1, line + "\n" + line), (2, line.upper()), (2, None)], "doc_id bigint, text string")).collect()
    assert [(r.n_docs, r.largest) for r in counted] == [(2, 2)]
