import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from sluicegate.llm.prefix_trie import Parentheses, conversation_turns, prefix_trie


def brute_force(conversations):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for conv_id, turns in conversations:
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv_id)
        ends[tuple(turns)].append(conv_id)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path in list(members):
        if path:
            children[path[:-1]].add(path)
    for path, own in members.items():
        tokens = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(own) - 1) * tokens
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (
            (min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(children[p]), leaves[p], saved[p], digest(ends[p]))
            for p, own in members.items()
        ),
        key=repr,
    )


def test_findclose_against_a_stack():
    draw = random.Random(5)
    for _ in range(300):
        bits, depth = [], 0
        for _ in range(draw.randint(1, 250)):
            bits.append(1)
            depth += 1
            while depth > 1 and draw.random() < draw.choice([0.3, 0.6]):
                bits.append(0)
                depth -= 1
        bits += [0] * depth
        walk = Parentheses(np.array(bits), draw.choice([2, 4, 8, 256]))
        stack = []
        for at, bit in enumerate(bits):
            if bit:
                stack.append(at)
            else:
                start = stack.pop()
                assert walk.findclose(start) == at
                inside = bits[start : at + 1]
                assert walk.leaves(start, at) == sum(a == 1 and b == 0 for a, b in zip(inside, inside[1:]))


def conversations(seed):
    draw = random.Random(seed)
    rows, plain = [], []
    hot = [("user", "hot start"), ("assistant", "a b c"), (None, None), ("user", ""), ("assistant", "x  y\tz")]
    for conv_id in range(-3, 140):
        turns = [(draw.choice(["user", "assistant"]), draw.choice(["a", "b c", "", None, "hot start"])) for _ in range(draw.randint(1, 4))]
        if draw.random() < 0.5:
            turns = hot[: draw.randint(1, 5)] + (turns if draw.random() < 0.5 else [])
        if conv_id == 7:
            turns = hot + [("user", f"w {i} " * 3) for i in range(60)] + [("user", "long " * 30_000)]
        plain.append((conv_id, [(role or "", text or "") for role, text in turns]))
        rows += [(conv_id, i or None, role, text, "clash") for i, (role, text) in enumerate(turns)]
    draw.shuffle(rows)
    return [*rows, (None, 1, "user", "of no conversation", "clash")], plain


SCHEMA = "conv_id bigint, turn int, role string, text string, mark string"


@pytest.mark.parametrize("rows_per_shard", [8, 20, 100_000])
def test_against_brute_force(frame, rows_per_shard):
    rows, plain = conversations(rows_per_shard)
    got = prefix_trie(conversation_turns(frame(rows, SCHEMA)), rows_per_shard).collect()
    assert sorted(map(tuple, got), key=repr) == brute_force(plain)


def test_a_conversation_that_many_repeat_spans_shards(frame):
    rows = [(i, t, "user", f"turn {t}") for i in range(400) for t in range(3)]
    rows += [(1000 + i, 0, "user", "turn 0") for i in range(300)]
    got = prefix_trie(conversation_turns(frame(rows, "conv_id bigint, turn int, role string, text string")), 10).collect()
    plain = [(i, [("user", f"turn {t}") for t in range(3)]) for i in range(400)]
    plain += [(1000 + i, [("user", "turn 0")]) for i in range(300)]
    assert sorted(map(tuple, got), key=repr) == brute_force(plain)


def test_repeated_rows_and_roles_that_run_into_texts(frame):
    rows = [(1, 0, "ab", "c"), (1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "ab", "c"), (4, None, "", "abc")]
    got = prefix_trie(conversation_turns(frame(rows, "conv_id bigint, turn int, role string, text string"))).collect()
    plain = [(1, [("ab", "c")] * 2), (2, [("a", "bc")]), (3, [("ab", "c")]), (4, [("", "abc")])]
    assert sorted(map(tuple, got), key=repr) == brute_force(plain)


def test_conversations_without_turns(frame):
    turns = frame([(5, []), (3, [])], "conv_id bigint, turns array<struct<mark: binary, tokens: int>>")
    assert [tuple(r) for r in prefix_trie(turns).collect()] == brute_force([(5, []), (3, [])])


def test_empty(frame):
    assert prefix_trie(conversation_turns(frame([], SCHEMA))).collect() == []
