import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sluicegate.llm.queries import op8_byte_bpe
from sluicegate.llm.rank_queue_bpe import decode_ids, encode_texts, encoder, read_ranks
from tests.llm.texts import HARD, hard_text
from tests.llm.test_llm_queries import DATA

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = encoder(read_ranks(PATH), PATTERN)


def unpacked(ids):
    return np.frombuffer(ids, dtype="<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abe \u0301=", max_size=60), st.integers(0, 30))
def test_queue_against_merging_by_hand(text, times):
    """The lowest rank first, the leftmost of equal ones, for one pre-token."""
    piece = (text * (times + 1)).encode()
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while parts and piece not in RANKS:
        found = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS]
        if not found:
            break
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    expected = [RANKS[piece]] if piece in RANKS else [RANKS[p] for p in parts]
    assert OWN.encode_piece(piece) == expected
    assert not any(OWN.words)


@settings(max_examples=400, deadline=None)
@given(hard_text)
def test_against_library(text):
    packed = OWN.encode(text)
    assert unpacked(packed) == LIBRARY.encode_ordinary(text)
    assert OWN.decode(packed) == text.encode()


@given(st.binary(max_size=200))
def test_any_bytes(piece):
    assert OWN.decode(np.array(OWN.encode_piece(piece), dtype="<u4").tobytes()) == piece


def test_very_long_pre_tokens():
    for text in ("a" * 40_000, "abracadabra" * 8_000, "=-" * 30_000):
        assert unpacked(OWN.encode(text)) == LIBRARY.encode_ordinary(text)


def test_frame(frame):
    rows = [(i, t, "clash") for i, t in enumerate([None, *HARD])] + [(None, "no id", "c"), (3, "twice", "c"), (3, "twice", "c")]
    encoded = encode_texts(frame(rows, "doc_id bigint, text string, ids string"), PATH, PATTERN)
    key = lambda r: (r[0] is None, r)
    wanted = [(i, LIBRARY.encode_ordinary(t or "")) for i, t, _ in rows]
    got = [(r.doc_id, unpacked(r.ids)) for r in encoded.collect()]
    assert sorted(got, key=key) == sorted(wanted, key=key)
    back = decode_ids(encoded, PATH, PATTERN).collect()
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in back), key=key) == sorted(
        ((i, (t or "").encode()) for i, t, _ in rows), key=key
    )
    assert decode_ids(encode_texts(frame([], "doc_id bigint, text string"), PATH, PATTERN), PATH, PATTERN).collect() == []


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    digest = lambda data: hashlib.sha256(data).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op8_byte_bpe(spark, DATA).collect()}
    ids = {k: LIBRARY.encode_ordinary(t) for k, t in docs.items()}
    assert got == {
        k: (len(ids[k]), digest(np.array(ids[k], dtype="<u4").tobytes()), digest(t.encode())) for k, t in docs.items()
    }
