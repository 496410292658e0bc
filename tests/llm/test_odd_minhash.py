import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sluicegate.llm import odd_minhash as odd
from sluicegate.llm.links import components
from sluicegate.llm.queries import op10_odd_minhash
from sluicegate.llm.tables import Staging
from tests.llm.test_llm_queries import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_force(rows):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text) rows, by an inverted index."""
    sets = [plain_set(t) for _, t in rows]
    up = {i: i for i, _ in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    def join(i, j):
        i, j = find(i), find(j)
        up[max(i, j)] = min(i, j)

    index = defaultdict(list)
    for at, members in enumerate(sets):
        seen = Counter()
        for s in members:
            seen.update(index[s])
            index[s].append(at)
        for other, common in seen.items():
            if 100 * common >= 85 * (len(members) + len(sets[other]) - common):
                join(rows[at][0], rows[other][0])
    return Counter((i, len(s), find(i), i == find(i)) for (i, _), s in zip(rows, sets))


def result(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed, copies):
    """Families of chains of copies, of copies with growing distance, and unrelated texts."""
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = [" ".join(words(rng.randrange(1, 300))) for _ in range(60)]
    for _ in range(6):
        base = words(rng.choice((8, 40, 150, 400)))
        texts += [changed(rng, base, rng.randrange(0, max(2, len(base) // 12))) for _ in range(copies)]
    chain = words(200)
    for _ in range(25):
        chain = changed(rng, chain, 2).split(" ")
        texts.append(" ".join(chain))
    texts += texts[:20] + [t.upper() for t in texts[20:30]] + [t.replace(" ", "\n\t") for t in texts[30:35]]
    texts += [None, "", " \n", "one", "One", "a b c d", "a b c d e", "A B C D E", "é " * 7, "x " * 30_000]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(3 * i + 1, texts[at]) for i, at in enumerate(order)]


@pytest.mark.parametrize("seed, copies, block_rows", [(1, 20, 1024), (2, 60, 16), (3, 40, 8)])
def test_against_brute_force(frame, seed, copies, block_rows):
    rows = corpus(seed, copies)
    docs = frame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, component_id string, bands int")
    assert result(odd.near_duplicates(docs, block_rows=block_rows)) == brute_force(rows)


def test_repeated_rows_and_missing_ids(frame):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (5, "A b c d e f"), (None, "a b c d e f"), (7, None)]
    got = result(odd.near_duplicates(frame(rows, "doc_id bigint, text string")))
    assert got == Counter({(1, 2, 1, True): 2, (5, 2, 1, False): 1, (None, 2, None, True): 1, (7, 0, 7, True): 1})


def test_empty(frame):
    assert odd.near_duplicates(frame([], "doc_id bigint, text string")).collect() == []


def test_rows_keep_their_columns(frame):
    rows = [(4, "a b c d e f", "x"), (2, "a b c d e f", "y"), (9, "other words stand in this text", None), (None, "a", "z")]
    docs = frame(rows, "doc_id bigint, text string, _gone string")
    left = odd.drop_near_copies(docs)
    assert left.schema == docs.schema
    assert {r.doc_id for r in left.collect()} == {2, 9, None}


def test_sketches_keep_every_similar_pair():
    rng = np.random.default_rng(5)
    worst = 0
    for _ in range(400):
        common = rng.integers(0, 2**63, 850, dtype=np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2**63, 75, dtype=np.uint64)]) for _ in range(2))
        bits = odd._odd_bits([odd.odd_sketch(odd.samples(a))], [odd.odd_sketch(odd.samples(b))])
        worst = max(worst, int(bits[0, 0]))
    assert worst <= odd.MAX_ODD_BITS
    far = [odd.odd_sketch(odd.samples(rng.integers(0, 2**63, 900, dtype=np.uint64))) for _ in range(2)]
    assert odd._odd_bits(far)[0, 1] > 200


def test_components(frame):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 180)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 7)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    df = frame(links, "a bigint, b bigint")
    got = {r.node: r.component for r in components(df, Staging(df.sparkSession, "test")).collect()}
    up = {}
    for a, b in links:
        up.setdefault(a, a), up.setdefault(b, b)
    for _ in range(200):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    alone = {n for n in up if not any(a != b and n in (a, b) for a, b in links)}
    assert got == {n: c for n, c in up.items() if n not in alone}


def test_components_without_links(frame):
    df = frame([(7, 7), (None, 3), (3, None)], "a bigint, b bigint")
    assert components(df, Staging(df.sparkSession, "test")).collect() == []


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert result(op10_odd_minhash(spark, DATA)) == brute_force(rows)
