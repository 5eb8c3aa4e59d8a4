"""Threshold search against loops, calibrators by the equations they solve, pipelines saved and loaded."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from twinsieve.operators import evaluate, tuning


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 1500
    y = rng.random(n) < 0.4
    c, s, k = np.round(0.86 + 0.1 * rng.random(n) + 0.04 * y, 3), np.round(0.8 + 0.15 * rng.random(n) + 0.05 * y, 3), rng.integers(0, 32, n) + 14 * y
    data = [(i, bool(y[i]), int(y[i]), float(c[i]) if i % 17 else None, float(s[i]) if i % 19 else None, int(k[i]) if i % 13 else None, int(8 - 6 * y[i])) for i in range(n)]
    return spark.createDataFrame(data, "id long, should_detect boolean, label int, cosine double, ssim double, orb_inliers int, hamming int").cache()


def plain(data, grid, floor):
    best, won = 0.0, None
    for c in grid["cosine"]:
        for s in grid["ssim"]:
            for n in grid["orb_inliers"]:
                tp, fp, fn, tn = judged(data, (c, s, n))
                precision, recall = tp / (tp + fp) if tp + fp else 0, tp / (tp + fn) if tp + fn else 0
                if precision >= floor and recall > best:
                    best, won = recall, (c, s, n)
    return won


def judged(data, setting):
    hit = [((r.cosine or 0) >= setting[0] and (r.ssim or 0) >= setting[1]) or (r.orb_inliers or 0) >= setting[2] for r in data]
    y = [r.should_detect for r in data]
    return sum(a and b for a, b in zip(hit, y)), sum(a and not b for a, b in zip(hit, y)), sum(b and not a for a, b in zip(hit, y)), sum(not a and not b for a, b in zip(hit, y))


@pytest.mark.parametrize("floor", [0.7, 0.999999])
def test_fold_search_equals_loops(rows, floor):
    dealt = evaluate.k_folds(rows, 5, 42).collect()
    got = sorted(tuning.fold_search(rows, floor=floor).collect(), key=lambda r: r.fold)
    for r in got:
        want = plain([x for x in dealt if x.fold != r.fold], tuning.FOLDED, floor) or tuning.FALLBACK
        assert (r.cosine_t, r.ssim_t, r.inliers_t) == want
        tp, fp, fn, tn = judged([x for x in dealt if x.fold == r.fold], want)
        assert (r.precision, r.recall, r.fpr) == pytest.approx((tp / (tp + fp) if tp + fp else 0, tp / (tp + fn), fp / (fp + tn)))
    recalls = [r.recall for r in got]
    assert [r.fold for r in got if r.chosen] == [int(np.argmax(recalls))] and got[0].recall_mean == pytest.approx(np.mean(recalls)) and got[0].recall_sd == pytest.approx(np.std(recalls))


def test_coarse_to_fine_equals_loops_and_gains(rows):
    data = rows.collect()
    coarse, fine = tuning.coarse_to_fine(rows, floor=0.8).collect()
    want = plain(data, tuning.COARSE, 0.8)
    assert (coarse.cosine_t, coarse.ssim_t, coarse.inliers_t) == want
    assert (fine.cosine_t, fine.ssim_t, fine.inliers_t) == plain(data, tuning.around(want), 0.8)
    assert fine.recall >= coarse.recall > 0.1


def test_one_pass_whatever_the_grid(rows, spark):
    cube = tuning.cube(rows, tuning.COARSE)
    hits = cube.hits()[0]
    for at in ((0, 0, 0), (3, 2, 1), (9, 5, 2)):
        tp, fp, *_ = judged(rows.collect(), cube.setting(at))
        assert (hits[(1, *at)], hits[(0, *at)]) == (tp, fp)
    none = tuning.fold_search(rows.limit(0)).collect()
    assert len(none) == 5 and all((r.cosine_t, r.ssim_t, r.inliers_t) == tuning.FALLBACK and r.recall == 0 for r in none)


def test_platt_solves_its_equations(rows):
    out = tuning.Calibrator(method="platt", c=1.0, scoreCol="cosine").fit(rows)
    data = out.transform(rows).select(F.coalesce("cosine", F.lit(0.0)).alias("x"), "label", "calibrated").collect()
    x, y, p = (np.array([r[k] for r in data], float) for k in range(3))
    w = out.getOrDefault("slope")
    assert abs((p - y).sum()) < 1e-3 and abs(((p - y) * x).sum() + w) < 1e-3 and w > 0


def test_isotonic_pools_blocks(rows):
    out = tuning.Calibrator(method="isotonic", scoreCol="ssim").fit(rows).transform(rows).select(F.coalesce("ssim", F.lit(0.0)).alias("x"), "label", "calibrated").collect()
    at = {}
    for r in out:
        at.setdefault(r.x, []).append(r.label)
    blocks = []  # [sum, weight, scores]: neighbours that violate the order are pooled
    for x in sorted(at):
        blocks.append([sum(at[x]), len(at[x]), [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + xs]
    want = {x: s / n for s, n, xs in blocks for x in xs}
    assert max(abs(want[r.x] - r.calibrated) for r in out) < 1e-9
    assert out[0].calibrated is not None


def test_a_tuned_pipeline_is_saved_and_loaded(rows, tmp_path):
    model, report = tuning.tuned(rows, floor=0.8, path=str(tmp_path / "tuned"))
    again = PipelineModel.load(str(tmp_path / "tuned"))
    columns = ["id", "calibrated", "unified", "was_detected"]
    assert again.transform(rows).select(columns).exceptAll(model.transform(rows).select(columns)).count() == 0
    r = report.first()
    assert r.log_loss_after < r.log_loss_before and r.n == 1500 and 0 < r.recall <= 1
    hit = model.transform(rows).where("was_detected").agg(F.avg("label")).first()[0]
    assert hit >= 0.8 and model.transform(rows).agg(F.min(F.when(F.col("was_detected"), F.col("unified")))).first()[0] == pytest.approx(r.threshold)


def test_calibrated_isotonic_outside_its_range_and_one_class(rows, spark):
    model = tuning.Calibrator(method="isotonic").fit(spark.createDataFrame([(0.2, 0), (0.4, 1), (0.6, 1)], "score double, label int"))
    out = model.transform(spark.createDataFrame([(0.0,), (0.3,), (9.0,), (None,)], "score double")).collect()
    assert [r.calibrated for r in out] == pytest.approx([0, 0.5, 1, 0])


def test_no_threshold_reaches_the_floor(spark):
    rows = spark.createDataFrame([(0.9, 0), (0.1, 1)], "unified double, label int")
    assert tuning.Cut(floor=0.99).fit(rows).transform(rows).where("was_detected").count() == 0


def test_a_classifier_is_saved_plugged_in_and_solves_its_equations(rows, tmp_path, spark):
    pipeline = tuning.fitted_classifier(rows, path=str(tmp_path / "c"))
    loaded = tuning.load_classifier(spark, str(tmp_path / "c"))
    assert tuning.load_classifier(spark, str(tmp_path / "none")) is None and tuning.load_classifier(spark, None) is None
    out = tuning.classified(rows, loaded, 0.5)
    p = np.array([(r.classifier_score, r.label) for r in out.collect()])
    assert out.columns == [*rows.columns, "classifier_score", "classifier_hit"] and abs((p[:, 0] - p[:, 1]).mean()) < 1e-2
    assert out.exceptAll(tuning.classified(rows, pipeline, 0.5)).count() == 0
    assert tuning.classified(rows, None).where("classifier_score is not null").count() == 0
