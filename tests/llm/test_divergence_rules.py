import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sluicegate.llm import divergence_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    repeated = {i + d for at in places.values() if len(at) > 1 for i in at for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), failed


def prose(rng, n):
    common = ["the", "of", "and", "to", "in", "a", "is", "it"]
    return " ".join(rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(500)}ord" for _ in range(n)).capitalize()


def documents():
    rng = random.Random(3)
    good = [prose(rng, rng.choice((60, 200, 900))) + ".\nEnd of it. " for _ in range(60)]
    junk = [
        " ".join(f"w{rng.randrange(500)}ord$$$###" for _ in range(200)),
        " | ".join(f"w{rng.randrange(500)}ord" for _ in range(200)),
        prose(rng, 200).upper().replace(" ", "!! "),
    ]
    odd = [
        None, "", " \t\n\x0b\f\r", "one", "a b c", "a b c a b c", "x " * 60, "a b c d e\n" * 30, "é𝄞 x y " * 20,
        "\n\n a\n a\n\na\n", "# * $ % & | < >", prose(rng, 40_000), "a a a a a", "longword" * 20_000,
    ]
    return good, junk, odd


def test_base_counts_and_verdicts(frame):
    good, junk, odd = documents()
    rows = [(i, t, "en", "clash", True) for i, t in enumerate(good + junk + odd)]
    rows += [(0, good[0], "en", "clash", True), (900, good[1], None, "clash", True), (None, good[2], "en", "c", True)]
    docs = frame(rows, "doc_id bigint, text string, lang string, n_words string, kept boolean")
    got = rules.judge(docs).collect()
    assert len(got) == len(rows)
    expected = Counter((r[0], *base(r[1])) for r in rows)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[c] for c in columns) for r in got) == expected
    kept = {r.doc_id for r in got if r.kept}
    assert set(range(len(good))) <= kept
    assert not kept & set(range(len(good), len(good) + len(junk)))
    assert all(not r.kept for r in got if r.base_failed)


def test_rows_keep_their_columns(frame):
    good, junk, _ = documents()
    docs = frame([(i, t, "en", i) for i, t in enumerate(good + junk)], "doc_id bigint, text string, lang string, kept int")
    left = rules.keep_good(docs)
    assert left.schema == docs.schema
    assert sorted(r.kept for r in left.collect()) == list(range(len(good)))


def test_distance(frame):
    pairs = [([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.2, 0.8], [0.6, 0.4]), ([0.0, 1.0], [0.0, 1.0])]
    df = frame(pairs, "p array<double>, q array<double>")
    for r in df.select("*", rules.squared_distance(F.col("p"), F.col("q")).alias("d")).collect():
        half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x)
        assert math.isclose(r.d, (half(r.p, r.q) + half(r.q, r.p)) / 2, abs_tol=1e-12)


def test_empty(frame):
    assert rules.judge(frame([], "doc_id bigint, text string, lang string")).collect() == []


def test_short_documents_are_held_to_the_distances(frame):
    good, _, _ = documents()
    rng = random.Random(5)
    junk = [" ".join(f"w{rng.randrange(500)}ord$$$###" for _ in range(n)) for n in (50, 60, 79)]
    docs = frame([(i, t, "en") for i, t in enumerate(good + junk)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    for i, _ in enumerate(junk, len(good)):
        assert not got[i].base_failed and got[i].class_distance > 0 and not got[i].kept
