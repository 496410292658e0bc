"""Token counts by a transducer compiled from a byte-level BPE vocabulary.

The tokenizer as a deterministic finite-state transducer over characters: a transition
carries by how much the number of tokens changes when the text goes on with its character.
A state holds what the future depends on and nothing else:

- where in the pre-token pattern the text stands (a run of letters, digits, other signs or
  white space, or an apostrophe that may become a contraction), and
- for every suffix of the pre-token that could still grow into a token, the token that ends
  where the suffix begins and how many tokens stand up to there.

The second part is enough because a sequence of tokens is what the merges give exactly if
each neighbouring pair is: the last token of a prefix is its one suffix that goes with the
token before it. Few suffixes are open at a time, so there are finitely many states. They
are compiled when a text first reaches them and kept per Python worker up to a bound, past
which compilation starts afresh. After the first white space behind another character all
states meet, and few states are such meetings; from there a transition is also kept for the
whole stretch to the next meeting, mostly a word, so that text of known words takes one
look-up per word.

Long texts are cut into chunks. What a chunk does to any state is a small map: a head, up to
the first white space after another character, where all states meet, and from there a count
and an exit state. Such maps compose associatively; a text's maps are composed pairwise.

Defined results: a NULL text is empty and has 0 tokens; equal rows are counted alike; an
empty frame gives an empty frame. Only the named columns are read, so no name can clash.
Added tokens of the vocabulary that occur in a text count as one token each.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.llm.tables import text_batches

CHUNK_CHARS = 1 << 16
# What a worker keeps: states, transitions by whole stretches up to a length, judged pairs.
MAX_STATES = 400_000
MAX_STRETCHES, STRETCH_CHARS = 1_000_000, 40
MAX_PAIRS = 500_000

_LETTER, _NUMBER = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
_SPACE, _MEETING = regex.compile(r"\s"), regex.compile(r"\S\s")
# White space as the pattern has it, listed, as `re` is faster but counts some more signs.
_SPACES = "".join(c for c in map(chr, range(0x3100)) if _SPACE.match(c))
_STRETCH = re.compile(f"[{_SPACES}]*+[^{_SPACES}]++[{_SPACES}]")
# Fixed values of the pre-token pattern: what may follow an apostrophe at its start.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

# A window: (open suffix, token before it, tokens up to there less tokens so far), suffix and
# token as nodes of the vocabulary's tree.
Window = tuple[tuple[int, int, int], ...]
_ROOT, _NOTHING = 0, -1
_EMPTY: Window = ((_ROOT, _NOTHING, 0),)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable ones for themselves,
    the others for the code points from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class State(dict):
    """Transitions by character: (next state, change of the token count). Looking up a
    character that is not there compiles its transition. `stretches` has those by whole
    stretches, of meetings."""

    __slots__ = ("key", "owner", "stretches")

    def __init__(self, key: tuple, owner: Transducer):
        self.key, self.owner, self.stretches = key, owner, {}

    def __missing__(self, char: str) -> tuple[State, int]:
        return self.owner.compile(self, char)


class Transducer:
    def __init__(self, vocabulary: bytes, max_states: int = MAX_STATES):
        whole = json.loads(vocabulary)
        letters = byte_letters()
        in_bytes = lambda word: bytes(letters[c] for c in word)
        self.tokens = {in_bytes(t) for t in whole["model"]["vocab"] if all(c in letters for c in t)}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in whole["model"]["merges"])
        self.merges = {(in_bytes(a), in_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        # By token: the merge that makes it, and its halves.
        self.made = {a + b: (i, a, b) for (a, b), i in reversed(self.merges.items())}
        # The tree: child by node * 256 + byte; the token that a node spells; can it grow?
        self.child: dict[int, int] = {}
        self.spelled: list[bytes | None] = [None]
        self.grows: list[bool] = [True]
        for token in sorted(self.tokens):
            node = _ROOT
            for byte in token:
                self.grows[node] = True
                node = self.child.setdefault(node << 8 | byte, len(self.spelled))
                if node == len(self.spelled):
                    self.spelled.append(None)
                    self.grows.append(False)
            self.spelled[node] = token
        added = [t["content"] for t in whole["added_tokens"]]
        if any(t[k] for t in whole["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.max_states = max_states
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.states: dict[tuple, State] = {}
        self.stretches = 0
        self.start = self.state(("start",))

    # -- merges

    def merged(self, word: bytes) -> list[bytes]:
        """The tokens of a short byte string, merge by merge."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            none = len(self.merges)
            rank, at = min((self.merges.get((a, b), none), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == none:
                break
            pair = (parts[at], parts[at + 1])
            joined, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    joined.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    joined.append(parts[i])
                    i += 1
            parts = joined
        return parts

    def goes_with(self, before: int, token: int) -> bool:
        """Do the merges leave `token` as it is after `before`, or at the start?"""
        whole = self.whole.get(token)
        if whole is None:
            whole = self.whole[token] = self.merged(self.spelled[token]) == [self.spelled[token]]
        if before == _NOTHING or not whole:
            return whole
        known = self.pairs.get((before, token))
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[before, token] = not self.merge_across(self.spelled[before], self.spelled[token])
        return known

    def merge_across(self, left: bytes, right: bytes) -> bool:
        """Does any merge join what stands on both sides of the border of two tokens?

        Looks back in time: the later of the two merges that made the neighbours is undone
        first (of equal ones the right one, as merges go from the left). The neighbours of
        that time would have been joined if their merge came before those that took them in.
        """
        never = len(self.merges)
        byte = (-1, b"", b"")
        left_until = right_until = never
        while True:
            joined = self.merges.get((left, right), never)
            if joined < left_until and joined <= right_until and joined != never:
                return True
            left_made, right_made = self.made.get(left, byte), self.made.get(right, byte)
            if left_made[0] > right_made[0]:
                left_until, _, left = left_made
            elif right_made[0] >= 0:
                right_until, right, _ = right_made
            else:
                return False

    def feed(self, window: Window, data: bytes) -> tuple[Window, int]:
        """The window after more bytes of the pre-token, and the change of its count."""
        change = 0
        child, spelled, grows = self.child, self.spelled, self.grows
        for byte in data:
            open_, last, count = [], _NOTHING, 0
            for suffix, before, tokens in window:
                grown = child.get(suffix << 8 | byte)
                if grown is None:
                    continue
                if last == _NOTHING and spelled[grown] is not None and self.goes_with(before, grown):
                    last, count = grown, tokens + 1
                if grows[grown]:
                    open_.append((grown, before, tokens))
            if last == _NOTHING:
                raise ValueError("the vocabulary lacks a byte or its merges are out of order")
            window = (*[(s, b, t - count) for s, b, t in open_], (_ROOT, last, 0))
            change += count
        return window, change

    # -- the pre-token pattern

    def state(self, key: tuple) -> State:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(key, self)
        return found

    def compile(self, state: State, char: str) -> tuple[State, int]:
        if len(self.states) >= self.max_states:
            kept = {self.start.key: self.start}
            for old in self.states.values():
                old.clear()
                if old.stretches:
                    kept[old.key] = old
            self.states = kept
        key, change = self.step(state.key, char)
        made = state[char] = (self.state(key), change)
        return made

    def step(self, key: tuple, char: str) -> tuple[tuple, int]:
        kind = key[0]
        if kind == "start":
            return self.begin(char)
        if kind == "apostrophe":
            return self.contract(key[1], char)
        if kind == "space":
            return self.after_space(key, char)
        if self.kind(char) == kind:
            window, change = self.feed(key[1], char.encode())
            return (kind, window), change
        return self.begin(char)

    @staticmethod
    @lru_cache(maxsize=1 << 16)
    def kind(char: str) -> str:
        if _SPACE.match(char):
            return "space"
        return "letter" if _LETTER.match(char) else "number" if _NUMBER.match(char) else "other"

    def begin(self, char: str) -> tuple[tuple, int]:
        """The state after the first character of a pre-token."""
        window, change = self.feed(_EMPTY, char.encode())
        kind = self.kind(char)
        if kind == "space":
            return ("space", _EMPTY, window, change, char, False), change
        return (("apostrophe", "'") if char == "'" else (kind, window)), change

    def contract(self, pending: str, char: str) -> tuple[tuple, int]:
        """After an apostrophe that began a pre-token, and at most one letter. Until the
        contraction is whole, they count as the sign and the letter that they may be."""
        count = lambda text: self.feed(_EMPTY, text.encode())[1]
        longer = pending[1:] + char
        if longer in _CONTRACTIONS:
            return ("start",), count("'" + longer) - sum(map(count, pending))
        if len(pending) == 1 and any(c.startswith(char) for c in _CONTRACTIONS):
            return ("apostrophe", pending + char), count(char)
        window, _ = self.feed(_EMPTY, pending[-1].encode())
        return self.step(("other" if len(pending) == 1 else "letter", window), char)

    def after_space(self, key: tuple, char: str) -> tuple[tuple, int]:
        """A run of white space is one pre-token at the end of the text. Before another
        character its last sign is left out; a blank then begins the next pre-token."""
        _, before, window, change, last, several = key
        kind = self.kind(char)
        if kind == "space":
            longer, more = self.feed(window, char.encode())
            return ("space", window, longer, more, char, True), more
        back = 0
        if several:
            window, alone = self.feed(_EMPTY, last.encode())
            back = alone - change
        if last != " ":
            key, more = self.begin(char)
            return key, back + more
        window, more = self.feed(window, char.encode())
        return (kind, window), back + more

    # -- texts

    @staticmethod
    def run(state: State, text: str) -> tuple[State, int]:
        total = 0
        for char in text:
            state, change = state[char]
            total += change
        return state, total

    def run_from_meeting(self, state: State, text: str) -> tuple[State, int]:
        """`run` from a meeting, stretch by stretch."""
        total = 0
        stretches = _STRETCH.findall(text)
        table = state.stretches
        for stretch in stretches:
            try:
                table, change, state = table[stretch]
            except KeyError:
                reached, change = self.run(state, stretch)
                if len(stretch) <= STRETCH_CHARS:
                    self.remember(state, stretch, (reached.stretches, change, reached))
                state, table = reached, reached.stretches
            total += change
        state, change = self.run(state, text[sum(map(len, stretches)) :])
        return state, total + change

    def remember(self, state: State, stretch: str, transition: tuple) -> None:
        if self.stretches >= MAX_STRETCHES:
            for each in self.states.values():
                each.stretches.clear()
            self.stretches = 0
        state.stretches[stretch] = transition
        self.stretches += 1

    def chunk_map(self, chunk: str) -> tuple[str, bool, int, State | None]:
        """(head, do states meet, count behind the meeting, exit state)."""
        meeting = _MEETING.search(chunk)
        if meeting is None:
            return chunk, False, 0, None
        met, _ = self.begin(chunk[meeting.end() - 1])
        exit_, count = self.run_from_meeting(self.state(met), chunk[meeting.end() :])
        return chunk[: meeting.end()], True, count, exit_

    def compose(self, first: tuple, second: tuple) -> tuple:
        """The map of two neighbouring chunks."""
        head, meets, count, exit_ = first
        if not meets:
            return (head + second[0], *second[1:])
        reached, between = self.run(exit_, second[0])
        return head, True, count + between + second[2], second[3] if second[1] else reached

    def count(self, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
        if self.added is not None and (found := self.added.findall(text)):
            return len(found) + sum(self.count_plain(t, chunk_chars) for t in self.added.split(text))
        return self.count_plain(text, chunk_chars)

    def count_plain(self, text: str, chunk_chars: int) -> int:
        maps = [self.chunk_map(text[i : i + chunk_chars]) for i in range(0, len(text), chunk_chars)]
        while len(maps) > 1:
            pairs = [self.compose(*maps[i : i + 2]) for i in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[2 * len(pairs) :]
        return self.run(self.start, maps[0][0])[1] + maps[0][2] if maps else 0


@lru_cache(maxsize=2)
def transducer(vocabulary: bytes) -> Transducer:
    """Built once per Python worker, and compiled further by what it meets."""
    return Transducer(vocabulary)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens of every whole text. Nothing is shuffled."""
    text_batches(docs.sparkSession)
    with open(path, "rb") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())  # about 2 MB

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary.value)
        # States refer to each other, are bounded and are cleared by hand. Searching millions
        # of them for garbage over and over takes longer than the counting.
        gc.disable()
        for batch in batches:
            counts = [machine.count(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["key", "n_bytes", "n_tokens"]
            )

    narrow = docs.select(
        F.col(f"`{key}`").alias("key"),
        F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("bigint").alias("n_bytes"),
        F.col(f"`{text}`").alias("text"),
    )
    kind = narrow.schema["key"].dataType.simpleString()
    return narrow.mapInArrow(count, f"key {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("key", key)
