"""The pipeline's near-duplicates against brute force over five-word shingles."""

import random

import pytest

import corpus_pipeline
from paperloom.llm import near_dedup
from tests.llm.conftest import DOCS, lorem


def plain_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_least(texts):
    sets = [plain_shingles(t) for t in texts]
    label = list(range(len(sets)))
    between = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            share = len(a & b) / len(a | b) if a | b else 1
            between += 0.8 <= share < 0.93
            if share >= 0.8 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return sorted(set(label)), between


@pytest.mark.parametrize("tile", [2048, 3])
def test_near_dedup_stage_equals_brute_force(spark, monkeypatch, tile):
    """Similarities on both sides of 0.8, also with buckets cut into tiny tiles."""
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rng = random.Random(5)
    texts = [lorem(s, 120) for s in range(20)]
    for s in range(80):
        w = texts[s % 20].split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"changed{s}"
        texts.append(" ".join(w))
    texts += ["", None, "a b", "A  b"]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    out = corpus_pipeline.near_dedup_stage(spark, df, "")
    kept, between = plain_least(texts)
    assert out.columns == df.columns and between > 20
    assert sorted(r["doc_id"] for r in out.collect()) == kept


def test_near_dedup_rows(spark, odd_docs, clashing):
    out = near_dedup.near_dedup(clashing)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == clashing.columns and len(ids) == len(set(ids)) and 1 in ids and 2 not in ids and 3 not in ids
    assert near_dedup.near_dedup(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("opens", [True, False])
def test_near_dedup_takes_one_worker_a_core(spark, monkeypatch, opens):
    """No written stage has two Arrow passes, each of which holds a worker process; also where pyarrow can't open the folder."""
    plans = []

    class Closed:
        @staticmethod
        def from_uri(uri):
            raise ValueError(uri)

    def seen(df, name, **more):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString().count("MapInArrow ")))
        return materialize(df, name, **more)

    materialize = near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", seen)
    if not opens:
        monkeypatch.setattr("pyarrow.fs.FileSystem", Closed)
    texts = [lorem(s % 9, 90) + " more" * (s // 9) for s in range(30)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    kept = sorted(r["doc_id"] for r in near_dedup.near_dedup(df).collect())
    assert kept == plain_least(texts)[0] and len(kept) < 30
    assert {name for name, n in plans if n} >= {"fingerprints", "sets", "links-0"} and max(n for _, n in plans) == 1
