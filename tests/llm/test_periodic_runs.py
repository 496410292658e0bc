import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from sluicegate.llm import periodic_runs
from sluicegate.llm.periodic_runs import find_runs, runs_of
from sluicegate.llm.queries import QUERIES
from tests.llm.test_llm_queries import DATA


def period_of(words):
    fall, k = [0] * len(words), 0
    for i in range(1, len(words)):
        while k and words[i] != words[k]:
            k = fall[k - 1]
        k += words[i] == words[k]
        fall[i] = k
    return len(words) - fall[-1]


def plain_runs(words, min_length=6, exponent=4):
    found = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, exponent * q) and period_of(words[i : j + q]) == q:
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(found)


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("max_classes", [0, 2, 16])
def test_runs_against_brute_force(monkeypatch, max_classes):
    monkeypatch.setattr(periodic_runs, "MAX_CLASSES", max_classes)
    draw = random.Random(max_classes)
    for _ in range(700):
        texts = []
        for _ in range(draw.randint(0, 4)):
            words, size = [], draw.randint(0, 80)
            while len(words) < size:
                part = [draw.randrange(draw.choice([1, 2, 3, 6])) for _ in range(draw.randint(1, 5))]
                words += part * draw.choice([1, 1, 2, 4, 5, 9])
            texts.append(words)
        for least, exponent in ((6, 4), (8, 3), (2, 3), (40, 4)):
            got = runs_of([np.array(t, dtype=np.int64) for t in texts], least, exponent)
            assert got == [plain_runs(t, least, exponent) for t in texts]


def test_long_texts():
    for words, expected in (([0] * 60_000, [(0, 60_000, 1)]), ([0, 1, 2] * 20_000, [(0, 60_000, 3)])):
        assert runs_of([np.array(words, dtype=np.int64)], 6, 4) == [expected]
    same_passage = [w for i in range(8_000) for w in (i + 10, 0, 1, 2, 3, 4)]
    assert runs_of([np.array(same_passage, dtype=np.int64)], 6, 4) == [[]]


def test_frame_with_odd_rows(frame):
    texts = [None, "", " \t\n", "a", "a " * 6, "x a b a b a b a b y", "ä ä " * 7, "w" * 80_000 + " z" * 70_000, "a\x1ca " * 6]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(4, "a " * 6, "clash"), (None, "a " * 9, None)]
    got = find_runs(frame(rows, "doc_id bigint, text string, runs string")).collect()
    expected = []
    for doc_id, text, _ in rows:
        words = (text or "").encode().split()
        runs = plain_runs(words) if len(words) < 1000 else [(1, 70_000, 1)]
        expected.append((doc_id, len(words), runs, plain_collapsed(words, runs).decode()))
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(expected, key=key)


def test_empty(frame):
    assert find_runs(frame([], "doc_id bigint, text string")).collect() == []


def test_too_small_an_exponent(frame):
    with pytest.raises(ValueError):
        find_runs(frame([], "doc_id bigint, text string"), min_exponent=2)


def test_query_against_brute_force(spark):
    expected = {}
    for doc_id, text in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        row = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
        said = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
        expected[doc_id] = (*row, hashlib.sha256(said).hexdigest(), hashlib.sha256(plain_collapsed(words, runs)).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, DATA).collect()}
    assert any(row[0] for row in expected.values())
    assert got == expected
