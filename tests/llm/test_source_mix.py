import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import source_mix as X

DOCS = "doc_id bigint, source string, text string"
TARGETS = "mix_id int, source string, target_share double, max_repeats int, size_factor double"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "big" if i % 3 else "small", "工人的联合会讨论了制度。" * (1 + i % 7)) for i in range(300)]
    rows += [(1000, None, "x"), (1001, "big", None), (1002, "big", ""), (None, "big", "x"), (0, "small", "工人的联合会讨论了制度。")]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS tokens", "'k' AS copies", "2 AS mix_id")


def test_shares(spark, docs):
    t = spark.createDataFrame([(1, "big", 0.5, 3, 0.4), (1, "small", 0.5, 3, 0.4), (2, "small", 0.7, 2, 2.0), (2, "none", 0.3, 4, 2.0), (1, None, 0.1, 1, 0.4), (1, "big", None, 1, 0.4)], TARGETS)
    mix = X.Mix(docs, t)
    total = mix.counts.agg({"tokens": "sum"}).first()[0]
    got = {(r.mix_id, r.source): r for r in mix.shares().collect()}
    assert len(got) == 4
    largest = 7 * 30
    for source in ("big", "small"):
        r = got[1, source]
        assert abs(r.actual_share - 0.5) < 0.02 and abs(r.tokens - 0.2 * total) < largest and not r.short
    small = mix.counts.where("source = 'small'").agg({"tokens": "sum"}).first()[0]
    assert got[2, "small"].tokens == 2 * small and got[2, "small"].most_copies == 2 and got[2, "small"].short
    assert got[2, "none"].tokens == 0 and got[2, "none"].short
    copies = mix.copies().collect()
    assert len({(r.mix_id, r.doc_id) for r in copies}) == len(copies) and max(r.copies for r in copies) <= 3
    assert sorted(copies) == sorted(X.Mix(docs, t).copies().collect())


def brute(have, targets, total, keep):
    """tokens of each source of one mix, by bisection on the factor."""
    size = targets[0][3] * total
    cap = {s: have.get(s, 0) * r for s, _, r, _ in targets}
    if keep == "shares":
        there = [(s, share) for s, share, *_ in targets if cap[s] > 0]
        factor = min([size / sum(x for _, x in there), *(cap[s] / x for s, x in there)]) if there else 0
    else:
        lo, hi = 0.0, 1e12
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(cap[s], mid * x) for s, x, *_ in targets) < size else (lo, mid)
        factor = hi
    return {s: min(cap[s], factor * x) for s, x, *_ in targets}


@pytest.mark.parametrize("keep", ["size", "shares"])
def test_feasible_equals_brute_force(spark, keep):
    rng = random.Random(4)
    rows, want, total = [], {}, 10_000
    for mix in range(12):
        sources = [f"s{i}" for i in range(rng.randrange(1, 9))]
        weights = [rng.random() ** 2 + 0.001 for _ in sources]
        have = {s: rng.choice([0, 5, 100, 2000, 8000]) for s in sources}
        targets = [(s, w / sum(weights), rng.randrange(1, 5), rng.choice([0.5, 1.0, 1.5])) for s, w in zip(sources, weights)]
        targets = [(s, w, r, targets[0][3]) for s, w, r, _ in targets]
        rows += [(mix, *t, have[t[0]]) for t in targets]
        want |= {(mix, s): n for s, n in brute(have, targets, total, keep).items()}
    frame = spark.createDataFrame(rows, TARGETS + ", have bigint")
    got = {(r.mix_id, r.source): r.use for r in X.feasible(frame, total, keep).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1 for k in want)


def test_shares_kept(spark, docs):
    t = [(1, "big", 0.6, 1, 1.0), (1, "small", 0.3, 1, 1.0), (1, "none", 0.1, 1, 1.0)]
    got = {r.source: r for r in X.Mix(docs, spark.createDataFrame(t, TARGETS), keep="shares").shares().collect()}
    assert abs(got["big"].actual_share - 2 / 3) < 0.01 and abs(got["small"].actual_share - 1 / 3) < 0.01 and got["none"].actual_share == 0


@pytest.mark.parametrize("q", [1.0, 0.1, 0.05])
def test_no_bucket_is_hot(spark, q):
    n = 200_000
    keys = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("mix_id"), F.lit(q).alias("quality"))
    most = keys.groupBy(X.bucket_of(X._key(X.SEED)).alias("b")).count().agg(F.max("count")).first()[0]
    assert most / n < 3 / 4096


def test_epochs_before_fraction(spark, docs):
    share = 0.9
    mix = X.Mix(docs, spark.createDataFrame([(1, "small", share, 8, 1.0), (1, "big", 1 - share, 8, 1.0)], TARGETS))
    have = mix.counts.where("source = 'small'").agg({"tokens": "sum"}).first()[0]
    total = mix.counts.agg({"tokens": "sum"}).first()[0]
    epochs = int(share * total // have)
    counts = [r.copies for r in mix.copies().where("source = 'small'").collect()]
    assert set(counts) <= {epochs, epochs + 1} and len(counts) == mix.counts.where("source = 'small' and tokens > 0").count()


def test_prefix_equals_a_full_sort(spark, docs, monkeypatch):
    monkeypatch.setattr(X, "STEPS", 1)
    t = spark.createDataFrame([(1, "big", 0.3, 1, 0.3)], TARGETS)
    few = {(r.doc_id, r.copies) for r in X.Mix(docs, t).copies().collect()}
    monkeypatch.setattr(X, "STEPS", 1024)
    assert few == {(r.doc_id, r.copies) for r in X.Mix(docs, t).copies().collect()}


def test_empty(spark):
    mix = X.Mix(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a", 1.0, 2, 1.0)], TARGETS))
    assert mix.copies().count() == 0 and [r.tokens for r in mix.shares().collect()] == [0]
    assert X.Mix(spark.createDataFrame([(1, "a", "x")], DOCS), spark.createDataFrame([], TARGETS)).shares().count() == 0
