"""Selection for the late label against dense algebra and plain loops."""
import numpy as np
import pytest

from lanewise.operators import logit

COLUMNS = ["a", "b", "c1", "c2", "twin"]
UNITS = {"a": ["a"], "b": ["b"], "c": ["c1", "c2"], "twin": ["twin"]}


def dense_fit(z, y, rounds=200):
    """Newton on the whole matrix."""
    beta = np.zeros(z.shape[1])
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-z @ beta))
        step = np.linalg.pinv((z * (mu * (1 - mu))[:, None]).T @ z) @ (z.T @ (y - mu))
        beta = beta + step
        if np.abs(step).max() < 1e-12:
            break
    eta = z @ beta
    return beta, float(y @ eta - np.logaddexp(0, eta).sum())


def dense_ap(score, y):
    order = np.argsort(-score, kind="stable")
    score, y = score[order], y[order]
    last = np.append(score[1:] != score[:-1], True)
    hits, rows = np.cumsum(y)[last], np.flatnonzero(last) + 1
    return float((np.diff(np.append(0, hits)) * hits / rows).sum() / y.sum())


@pytest.fixture(scope="module")
def made(spark):
    """Training rows of fold 0, of folds 0 and 1, of all three, and validation rows of folds 1 and 2; the last column repeats the first."""
    rng = np.random.default_rng(8)
    rows, dense = [], {}
    for lo, hi, valid, n in ((0, 0, None, 400), (0, 1, None, 300), (0, 2, None, 500), (1, 0, 1, 150), (0, 0, 2, 150)):
        x = np.round(rng.normal(size=(n, 4)), 1)
        x[:, 2:] = x[:, 2:] > 0.8
        x = np.column_stack([x, x[:, 0]])
        y = (rng.random(n) < 1 / (1 + np.exp(2 - 1.5 * x[:, 0] - x[:, 2]))).astype(float)
        rows += [(lo, hi, valid, float(b), *map(float, a)) for a, b in zip(x, y)]
        for part in [(f, "train") for f in range(lo, hi + 1)] + [(valid, "valid")] * (valid is not None):
            dense.setdefault(part, []).append((np.column_stack([np.ones(n), x]), y))
    df = spark.createDataFrame(rows, "train_lo int, train_hi int, valid int, y double, x0 double, x1 double, x2 double, x3 double, x4 double").repartition(5)
    return logit.Rows(df, 5, {}), {k: (np.concatenate([z for z, _ in v]), np.concatenate([y for _, y in v])) for k, v in dense.items()}


def test_preparation_per_fold(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(3, 2, (90, 2)), 1)
    x[rng.random((90, 2)) < 0.2] = np.nan
    x[:, 1] = np.where(np.arange(90) < 60, np.nan, 5.0)  # no value in fold 1, one value in fold 2
    rows = [(1 if i < 60 else 2, 1 if i < 30 else 2, None, 0.0, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)]
    made = logit.prepare(spark.createDataFrame(rows, "train_lo int, train_hi int, valid int, y double, x0 double, x1 double"), 2, [1, 2])
    for f, mine in ((1, x[:60]), (2, x[30:])):
        prep = made.preps[f]
        fill = [np.nanmedian(c) if (~np.isnan(c)).any() else 0.0 for c in mine.T]
        full = np.where(np.isnan(mine), fill, mine)
        sd = np.where(full.std(axis=0) > 0, full.std(axis=0), 1.0)
        assert np.allclose(prep.fill, fill) and np.allclose(prep.mean, full.mean(axis=0)) and np.allclose(prep.scale, sd)
        assert np.allclose(prep.apply(mine)[:, 1:], (full - full.mean(axis=0)) / sd)


def test_batch_of_models_equals_dense_fits(made):
    df, dense = made
    models = logit.fit_many(df, [logit.Model((0,)), logit.Model((0, 1, 2, 3)), logit.Model((2, 3), 1), logit.Model((0, 4), 2), logit.Model(())])
    for m in models:
        z, y = dense[m.fold, "train"]
        assert m.converged and m.loglik == pytest.approx(dense_fit(z[:, [0, *(c + 1 for c in m.cols)]], y)[1], rel=1e-9)
    assert [m.method for m in models] == ["newton"] * 3 + ["pseudo-inverse", "newton"]


def test_separated_labels_end(spark):
    rows = [(0, 0, float(i > 5), float(i > 5)) for i in range(12)]
    m = logit.fit_many(logit.Rows(spark.createDataFrame(rows, "train_lo int, train_hi int, y double, x0 double"), 1, {}), [logit.Model((0,))])[0]
    assert m.loglik > -1e-3 and np.isfinite(m.beta).all() and m.method


def test_ic_paths_equal_a_plain_loop(made):
    df, dense = made
    z, y = dense[0, "train"]
    paths, log = logit.forward_ic(df, 0, COLUMNS, UNITS)
    at = {c: i + 1 for i, c in enumerate(COLUMNS)}
    for name, price in (("aic", 2.0), ("bic", np.log(len(y)))):
        def cost(units):
            cols = [0, *(at[c] for u in units for c in UNITS[u])]
            return price * len(cols) - 2 * dense_fit(z[:, cols], y)[1]
        have, path = [], [cost([])]
        while len(have) < len(UNITS):
            value, unit = min(((cost([*have, u]), u) for u in UNITS if u not in have), key=lambda x: x[0])
            if value >= path[-1] - 1e-7:
                break
            have.append(unit)
            path.append(value)
        assert [r["added_unit"] for r in paths[name][1:]] == have and have
        assert [r[name] for r in paths[name]] == pytest.approx(path, rel=1e-9)
    assert any(r["unit"] == "twin" and r["method"] == "pseudo-inverse" for r in log)


def test_average_precision_with_ties(spark, made):
    df, dense = made
    models = [logit.Model((0, 1), f, beta=np.array([-1.0, 1.0, 0.5])) for f in (1, 2)] + [logit.Model((2,), 1, beta=np.array([0.0, 1.0]))]
    got = logit.average_precision(logit.scores(df, models))
    for i, m in enumerate(models):
        z, y = dense[m.fold, "valid"]
        assert got[i] == pytest.approx(dense_ap(np.round(z[:, [0, *(c + 1 for c in m.cols)]] @ m.beta, 12), y), rel=1e-12)
    none = spark.createDataFrame([(0, 1.0, 0.0), (0, 900.0, 0.0)], "model int, eta double, y double")
    assert logit.average_precision(none) == {}


def test_cv_path_equals_a_plain_loop(made):
    df, dense = made
    units = {u: UNITS[u] for u in ("a", "b", "c")}
    path = logit.forward_cv(df, COLUMNS, units, [1, 2])
    at = {c: i + 1 for i, c in enumerate(COLUMNS)}

    def folds_ap(have):
        cols = [0, *(at[c] for u in have for c in units[u])]
        return [dense_ap(np.round(dense[f, "valid"][0][:, cols] @ dense_fit(dense[f, "train"][0][:, cols], dense[f, "train"][1])[0], 9), dense[f, "valid"][1]) for f in (1, 2)]
    have = []
    for row in path[1:]:
        best = max((u for u in units if u not in have), key=lambda u: np.mean(folds_ap([*have, u])))
        assert row["added_unit"] == best
        have.append(best)
        assert row["cv_mean"] == pytest.approx(np.mean(folds_ap(have)), rel=1e-6)
    assert path[0]["cv_mean"] == pytest.approx(np.mean([dense[f, "valid"][1].mean() for f in (1, 2)]))
    assert len(logit.forward_cv(df, COLUMNS, units, [1, 2], early_stop=1)) <= len(path)


def test_l1_models_meet_the_optimality_conditions(made):
    df, dense = made
    grid = [0.003, 0.1, 10.0]
    models = logit.fit_many(df, [logit.Model((0, 1, 2, 3), f, 1 / c) for c in grid for f in (0, 1)])
    for m in models:
        z, y = dense[m.fold, "train"]
        z = z[:, :5]
        pull = z.T @ (y - 1 / (1 + np.exp(-z @ m.beta)))
        on = m.beta[1:] != 0
        assert m.converged and abs(pull[0]) < 2e-3
        assert np.all(np.abs(pull[1:]) <= m.penalty * (1 + 1e-4) + 1e-3)
        assert np.allclose(pull[1:][on], m.penalty * np.sign(m.beta[1:][on]), atol=2e-3 * max(1, m.penalty))
    assert (models[0].beta[1:] != 0).sum() < (models[-2].beta[1:] != 0).sum()
    table, best = logit.l1_path(df, 0, COLUMNS, [1, 2], grid)
    assert sum(r["best"] for r in table) == 1 and best.fold == 0 and best.converged
