"""The pipeline's decisions on a small corpus, against plain forms."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = prose(30)
    clean = [(i, prose(120)) for i in range(60)]
    rows = clean + [(100 + i, clean[i][1]) for i in range(5)] + [(200, prose(20)), (201, "a b c " * 40), (202, item + " " + prose(40))]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}", rows, item


def test_stages(spark, corpus):
    path, rows, item = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, path)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {200, 201}
    once = corpus_pipeline.drop_near_duplicates(spark, kept, path)
    assert {r["doc_id"] for r in once.collect()} == {*range(60), 202}
    clean = corpus_pipeline.drop_contaminated(spark, once, path)
    bad = {d for d, _, _, _, c in brute.contamination(rows, [(1, item)]) if c}
    assert {r["doc_id"] for r in clean.collect()} == {*range(60), 202} - bad
    mixed = corpus_pipeline.mix_domains(spark, clean, path)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} == set(range(60))


def test_run(spark, corpus):
    path, _, _ = corpus
    out = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in out} == set(range(60))
    places = sorted((r["start"], r["n_tokens"]) for r in out)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
