"""Boosting on Spark against plain boosting that tries every split of every row."""

import numpy as np
import pytest

from tapeloom.plans import boosting as bo

CFG = bo.BoostConfig(rounds=3, step=0.3, depth=2, bins=8, least_rows=5, keep_every=2)


def table(spark, n=200, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    x[rng.random((n, 3)) < 0.2] = np.nan
    score = np.nan_to_num(x[:, 0], nan=0.8) + 0.5 * np.nan_to_num(x[:, 1]) + rng.normal(scale=0.3, size=n)
    y = np.where(score > 0.5, 1.0, np.where(score < -0.5, -1.0, 0.0))
    w = np.where(y == 0, 1.0, 1.5)
    rows = [(*[None if v != v else float(v) for v in r], float(a), float(b)) for r, a, b in zip(x, y, w)]
    return x, y, w, spark.createDataFrame(rows, "a double, b double, c double, label double, weight double")


def brute(x, y, w, cfg):
    """The same model by plain loops: quantile bins, every cut, both sides for missing values."""
    edges = [sorted(set(np.quantile(c[~np.isnan(c)], [i / cfg.bins for i in range(1, cfg.bins)]))) for c in x.T]
    bins = np.array([[0 if v != v else 1 + np.searchsorted(e, v, side="left") for v, e in zip(r, edges)] for r in x])
    classes = sorted(set(y))
    prior = np.log([w[y == c].sum() / w.sum() for c in classes])
    scores = np.tile(prior - prior.mean(), (len(x), 1))
    for _ in range(cfg.rounds):
        p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        step = np.zeros_like(scores)
        for k, c in enumerate(classes):
            g, h = (p[:, k] - (y == c)) * w, p[:, k] * (1 - p[:, k]) * w

            def grow(rows, depth):
                worth = lambda r: g[r].sum() ** 2 / max(h[r].sum(), 1e-12)  # noqa: B023, E731
                best = (1e-9, None)
                if depth < cfg.depth:
                    for j in range(x.shape[1]):
                        for b in range(1, cfg.bins):
                            for missing in (True, False):
                                left = rows[np.where(bins[rows, j] == 0, missing, bins[rows, j] <= b)]
                                right = np.setdiff1d(rows, left)
                                if min(len(left), len(right)) >= cfg.least_rows:
                                    gain = worth(left) + worth(right) - worth(rows)
                                    if gain > best[0] + 1e-7:
                                        best = (gain, (left, right))
                if best[1] is None:
                    step[rows, k] = -cfg.step * g[rows].sum() / max(h[rows].sum(), 1e-12)  # noqa: B023
                else:
                    for side in best[1]:
                        grow(side, depth + 1)

            grow(np.arange(len(x)), 0)
        scores = scores + step
    return np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)


def probabilities(df, model):
    names = [f"p_{c:g}" for c in model.classes]
    return np.array([[r[n] for n in names] for r in bo.class_probabilities(df, model).collect()])


def test_probabilities_equal_plain_boosting(spark):
    x, y, w, df = table(spark)
    model = bo.fit_boosted_classes(df, ["a", "b", "c"], weight="weight", cfg=CFG)
    got = probabilities(df, model)
    assert model.classes == [-1.0, 0.0, 1.0] and np.allclose(got.sum(axis=1), 1.0)
    assert np.allclose(got, brute(x, y, w, CFG), atol=1e-5)
    most = max((y == c).mean() for c in model.classes)
    assert (np.array(model.classes)[got.argmax(axis=1)] == y).mean() > most + 0.1


def test_the_model_does_not_depend_on_the_partitions(spark, tmp_path):
    _, _, _, df = table(spark, 300, 4)
    fit = lambda d: bo.fit_boosted_classes(d, ["a", "b", "c"], weight="weight", cfg=CFG).to_json()
    one = fit(df.coalesce(1))
    assert one == fit(df.repartition(7)) == fit(df.repartition(3, "a"))
    model = bo.BoostedModel.from_json(one)
    bo.save_model(model, str(tmp_path / "m"), spark)
    assert bo.load_boosted(str(tmp_path / "m"), spark).to_json() == one


def test_missing_values_take_the_side_that_helps(spark):
    rows = [(None if i % 3 == 0 else float(i % 10), 1.0 if i % 3 == 0 or i % 10 > 6 else 0.0) for i in range(120)]
    df = spark.createDataFrame(rows, "a double, label double")
    model = bo.fit_boosted_classes(df, ["a"], cfg=bo.BoostConfig(rounds=4, step=0.5, depth=1, bins=16, least_rows=5))
    root = model.trees[0][1]
    assert root.feature[0] == 0 and not root.missing_left[0]  # beside the high values
    unseen = spark.createDataFrame([(None,), (float("nan"),), (9.0,), (1.0,)], "a double")
    p = probabilities(unseen, model)
    assert p[0, 1] == p[1, 1] == pytest.approx(p[2, 1]) and p[3, 1] < 0.3 < p[2, 1]


def test_odd_tables(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 1.0), (None, 1.0)], "a double, label double")
    model = bo.fit_boosted_classes(df, ["a"], cfg=CFG)
    assert probabilities(df, model).tolist() == [[1.0], [1.0], [1.0]]
    with pytest.raises(ValueError, match="no labelled rows"):
        bo.fit_boosted_classes(df.limit(0), ["a"], cfg=CFG)
    constant = spark.createDataFrame([(3.0, float(i % 2)) for i in range(40)], "a double, label double")
    assert np.allclose(probabilities(constant, bo.fit_boosted_classes(constant, ["a"], cfg=CFG)), 0.5)
    assert bo.class_probabilities(df.limit(0), model).collect() == []


def test_edges_are_exact_whatever_the_blocks(spark):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=500), rng.integers(0, 4, 500), np.where(rng.random(500) < 0.9, 0.0, rng.random(500)), np.full(500, np.nan), np.exp(rng.normal(scale=9, size=500))])
    x[rng.random(x.shape) < 0.1] = np.nan
    names = list("abcde")
    df = spark.createDataFrame([tuple(None if v != v and i % 2 else float(v) for i, v in enumerate(r)) for r in x], ", ".join(f"{n} double" for n in names))
    want = [sorted({float(q) for q in np.quantile(c[~np.isnan(c)], [i / 16 for i in range(1, 16)])}) if not np.isnan(c).all() else [] for c in x.T]
    for parts, block_rows, marks in ((1, 1 << 17, 2048), (3, 40, 5), (5, 7, 1)):
        got = bo.bin_edges(df.repartition(parts), names, 16, block_rows, marks)
        assert [len(g) for g in got] == [len(w) for w in want]
        assert all(np.allclose(g, w, rtol=1e-12, atol=0) for g, w in zip(got, want))
    assert bo.bin_edges(df.limit(0), names, 16) == [[]] * 5


def test_a_level_counts_the_smaller_sisters_only(spark, monkeypatch):
    """Rows of the larger one are the rest of the parent; the last level is not counted at all."""
    _, _, _, df = table(spark, 300, 4)
    jobs = []
    seen = df.sparkSession.sparkContext.broadcast
    monkeypatch.setattr(type(df.sparkSession.sparkContext), "broadcast", lambda self, v: jobs.append(v) or seen(v))
    bo.fit_boosted_classes(df, ["a", "b", "c"], weight="weight", cfg=bo.BoostConfig(rounds=2, step=0.3, depth=3, bins=8, least_rows=5))
    assert len(jobs) == 2 * 3
