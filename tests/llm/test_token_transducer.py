import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluicegate.llm.queries import op2_token_counts
from sluicegate.llm.token_transducer import Transducer, count_tokens
from tests.llm.texts import HARD, hard_text
from tests.llm.test_llm_queries import DATA

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
MACHINE = Transducer(open(PATH, "rb").read())


def plain(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(hard_text, st.sampled_from([1, 2, 3, 7, 1000]))
def test_against_library(text, chunk_chars):
    assert MACHINE.count(text, chunk_chars) == plain(text)


@pytest.mark.parametrize("chunk_chars", [5, 64, 1 << 16])
def test_hard_texts(chunk_chars):
    assert [MACHINE.count(t, chunk_chars) for t in HARD] == [plain(t) for t in HARD]


def test_every_ascii_pair_and_class():
    for a in map(chr, range(128)):
        text = "".join(f"{a}{chr(b)} x{a}{chr(b)}1" for b in range(128))
        assert MACHINE.count(text) == plain(text)


def test_maps_compose_in_any_grouping():
    chunks = ["The qu", "ick br", "own", " ", "fox's", "  jumped\n"]
    maps = [MACHINE.chunk_map(c) for c in chunks]
    left = maps[0]
    for m in maps[1:]:
        left = MACHINE.compose(left, m)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = MACHINE.compose(m, right)
    for head, _, count, _ in (left, right):
        assert MACHINE.run(MACHINE.start, head)[1] + count == plain("".join(chunks))


def test_few_states_are_enough():
    small = Transducer(open(PATH, "rb").read(), max_states=20)
    text = "Words that don't repeat: antidisestablishmentarianism, 12345 \n\n  and more words. " * 3
    assert small.count(text) == plain(text)
    assert len(small.states) <= 22


def test_frame(frame):
    rows = [(i, t, "clash") for i, t in enumerate([None, *HARD])] + [(None, "no id", "c"), (3, "twice", "c"), (3, "twice", "c")]
    got = count_tokens(frame(rows, "doc_id bigint, text string, n_tokens string"), PATH).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=key) == sorted(((i, len((t or "").encode()), plain(t)) for i, t, _ in rows), key=key)
    assert count_tokens(frame([], "doc_id bigint, text string"), PATH).collect() == []


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op2_token_counts(spark, DATA).collect()}
    assert {k: (r.n_bytes, r.n_tokens, r.over_limit) for k, r in got.items()} == {
        k: (len(t.encode()), plain(t), plain(t) > 512) for k, t in docs.items()
    }
