from collections import Counter

import corpus_pipeline
from sluicegate.llm import settings
from tests.llm.test_divergence_rules import base
from tests.llm.test_llm_queries import DATA
from tests.llm.test_odd_minhash import brute_force
from tests.llm.test_rank_queue_bpe import LIBRARY, unpacked


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{i}")
        kept = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 3:
            assert kept.columns == columns
        seen.append((name, docs.collect(), kept.collect()))
        docs = kept
    (_, before, good), (_, _, single), (_, _, mixed), (_, _, encoded) = seen

    truth = {r.id: r.domain for r in settings.labelled_domains(spark, DATA).collect()}
    assert not [r.doc_id for r in good if base(r.text)[-1]]
    left = {r.doc_id for r in good}
    assert all(r.doc_id in left for r in before if truth.get(r.doc_id) == "good" and not base(r.text)[-1])

    components = brute_force([(r.doc_id, r.text) for r in good])
    assert Counter(r.doc_id for r in single) == Counter(i for i, _, _, kept in components if kept)

    texts = {r.doc_id: r.text for r in single}
    assert {r.doc_id: r.text for r in mixed}.items() <= texts.items()
    copies = Counter(r.doc_id for r in mixed)
    assert all(copies[i] >= 1 for i in texts if truth.get(i) == "good")

    assert Counter((r.doc_id, r.n_tokens, tuple(unpacked(r.ids))) for r in encoded) == Counter(
        (r.doc_id, len(ids), tuple(ids)) for r in mixed for ids in [LIBRARY.encode_ordinary(r.text)]
    )


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.columns == ["doc_id", "n_tokens", "ids"]
    assert rows.count() > 0


def test_stages_on_odd_rows(spark, frame):
    """NULLs in every column, empty and very long texts, repeated rows and clashing names."""
    good = spark.read.parquet(f"{DATA}/documents.parquet").limit(40).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "clash", 1) for r in good]
    long = " ".join(r.text for r in good if r.text) * 20
    rows += [(None, None, None, None, None, None, None), (10_001, "", "en", "s", 0, "c", 2), (10_002, long, "en", "s", 1, "c", 2)]
    rows += rows[:3] + [(None, good[0].text, "en", None, 5, None, 3)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, n_words int"
    for part in (rows, []):
        docs = frame(part, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, DATA)
            assert kept.columns == docs.columns, name
            docs = frame([tuple(r) for r in kept.collect()], schema)
        ids = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
        assert ids.count() == docs.count()
