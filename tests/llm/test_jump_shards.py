import zlib
from collections import defaultdict

import numpy as np
import pytest

from sluicegate.llm.jump_shards import jump, shard_rows, write_shards


def plain_jump(key, shards):
    state, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        state = (state * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((state >> 33) + 1)))
    return b


def test_jump_against_plain_loop():
    keys = np.concatenate([np.arange(-50, 500), np.array([2**63 - 1, -(2**63)])]).astype(np.int64)
    for shards in (1, 2, 24, 25, 1000):
        assert jump(keys, shards).tolist() == [plain_jump(int(k), shards) for k in keys]


def test_growth_moves_only_into_the_new_shard():
    keys = np.arange(100_000)
    old, new = jump(keys, 24), jump(keys, 25)
    moved = old != new
    assert set(new[moved]) == {24}
    assert abs(moved.mean() - 1 / 25) < 0.005
    counts = np.bincount(old, minlength=24)
    assert counts.min() > 0.95 * counts.mean()


def test_rows_against_brute_force(frame):
    texts = [None, "", "a", "é€𝄞", "x" * 50_000, "same", "same"]
    rows = [(i, texts[i % len(texts)], "clash", 1) for i in range(300)]
    rows += [(5, "hot", "clash", 2)] * 150 + [(None, "no key", "clash", 3), (7, texts[0], "clash", 1)]
    docs = frame(rows, "doc_id bigint, text string, shard string, slot int")
    got = shard_rows(docs, 24, rows_per_piece=40).collect()
    by_shard = defaultdict(list)
    for doc_id, text, *_ in rows:
        body = (text or "").encode()
        by_shard[plain_jump(doc_id or 0, 24)].append((doc_id, zlib.crc32(body), len(body) + 8))
    first = lambda row: tuple(-1 if v is None else v for v in row)
    expected = {
        (k, size, crc, "key", shard, slot, plain_jump(k or 0, 25))
        for shard, members in by_shard.items()
        for slot, (k, crc, size) in enumerate(sorted(members, key=first))
    }
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == expected


def test_written_shards(spark, frame, tmp_path):
    docs = frame([(i, f"t{i}", "x") for i in range(60)], "doc_id bigint, text string, law string")
    placed = shard_rows(docs, 5)
    write_shards(placed, docs, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {(r.doc_id, r.text, r.shard) for r in back.collect()} == {(i, f"t{i}", plain_jump(i, 5)) for i in range(60)}
    with pytest.raises(ValueError):
        write_shards(placed, docs.withColumnRenamed("law", "Slot"), str(tmp_path / "t"))


def test_empty(frame):
    assert shard_rows(frame([], "doc_id bigint, text string"), 24).collect() == []
