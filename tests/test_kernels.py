"""Image kernels: identities, invariances, brute force."""

import numpy as np
import pytest

from twinsieve.kernels import geometry as geo, images as im, udfs
from twinsieve.plans import tables


def picture(seed=0, size=200):
    rng = np.random.default_rng(seed)
    return np.clip(im.resized(rng.integers(0, 256, (size // 8, size // 8)), size, size) + rng.normal(0, 3, (size, size)), 0, 255)


def test_codec():
    g = picture().astype("u1")
    assert (im.decoded(im.encoded(g)) == g).all()
    assert im.decoded(b"P6 # note\n2 1 255\n" + bytes(range(6))).shape == (1, 2, 3)
    for bad in (None, b"", b"P5", b"P5 3 3 255\nxx", b"\x89PNG", b"P5 a b c\n", b"P5 0 4 255\n"):
        assert im.decoded(bad) is None


def test_ssim():
    g = picture()
    assert im.ssim(g, g) == pytest.approx(1)
    noisy = g + np.random.default_rng(1).uniform(-10, 10, g.shape)
    assert abs(im.ssim(g, noisy) - im.ssim(g / 255, noisy / 255, 1.0)) < 1e-9
    assert im.ssim(g, picture(5)) < 0.3 < im.ssim(g, noisy) < 1
    small = np.arange(25.0).reshape(5, 5)
    assert im.ssim(small, small) == pytest.approx(1)
    a, b = g[:20, :20], noisy[:20, :20]
    brute = []
    for y in range(14):
        for x in range(14):
            p, q = a[y : y + 7, x : x + 7].ravel(), b[y : y + 7, x : x + 7].ravel()
            c = np.cov(p, q)
            brute.append((2 * p.mean() * q.mean() + 6.5025) * (2 * c[0, 1] + 58.5225) / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (c[0, 0] + c[1, 1] + 58.5225)))
    assert im.ssim(a, b) == pytest.approx(np.mean(brute))


def test_bundles_are_invariant():
    g = picture()
    base = im.phash_bundle(g)
    for other in (np.rot90(g), np.rot90(g, 2), g[:, ::-1], g[::-1], g * 0.5 + 30):
        assert im.bundle_distance(base, im.phash_bundle(other))[0] <= 2
    assert im.bundle_distance(base, im.phash_bundle(picture(7)))[0] > 8
    assert im.bundle_distance({}, base) == (999, "none")


def test_patches_and_normalisation():
    g = picture()
    s = im.patch_scores(g, np.clip(g * 1.2, 0, 255), height=160)
    assert s["patches"] == 9 and s["patch_min"] <= s["patch_topk"] and s["ssim"] == pytest.approx(0.4 * s["global_ssim"] + 0.6 * s["patch_topk"])
    n = im.normalised(g)
    assert n.min() >= 0 and n.max() <= 255 and abs(n.mean() - 128) < 5
    assert np.ptp(im.normalised(np.full((40, 40), 7.0))) < 1e-9


def test_ncc():
    g = picture()
    assert im.ncc(g, 2 * g + 5) == pytest.approx(1) and im.ncc(g, np.full_like(g, 3)) == 0 and im.ncc(g, g[:10]) == 0


def test_alignment_and_deep_verify():
    g = picture(3, 160)
    moved = im.sampled(g, *(np.mgrid[0:160, 0:160] + np.array([1.5, -2.0])[:, None, None]))
    assert im.ncc(g, im.aligned(g, moved)) > max(0.99, im.ncc(g, moved))
    assert im.deep_verified(g, moved)["ok"] and not im.deep_verified(g, picture(9, 160))["ok"]


def test_geometry():
    g = picture(1, 260)
    turned = im.sampled(g, *[f(np.mgrid[0:260, 0:260] - 130.0) + 130 for f in (lambda z: z[0] * np.cos(0.26) - z[1] * np.sin(0.26), lambda z: z[0] * np.sin(0.26) + z[1] * np.cos(0.26))])
    same, rot, other = geo.verified(g, g), geo.verified(g, turned), geo.verified(g, picture(2, 260))
    assert same["is_partial"] and same["reproj_error"] < 1e-6 and rot["orb_inliers"] >= 30 and other["orb_inliers"] == 0
    assert geo.verified(np.zeros((50, 50)), g)["reason"] == "few_matches"
    rng = np.random.default_rng(0)
    h = np.array([[0.9, 0.1, 5], [-0.08, 1.1, -3], [1e-4, -2e-4, 1]])
    p = rng.uniform(0, 200, (80, 2))
    q = geo.projected(h, p)
    q[60:] = rng.uniform(0, 200, (20, 2))
    got, fit = geo.homography(p, q)
    assert np.linalg.norm(geo.projected(got, p[:60]) - q[:60], axis=1).max() < 1 and fit[:60].all() and fit.sum() < 66  # an outlier may fit by chance
    assert geo.coverage(np.eye(3), (100, 80), (100, 80)) == pytest.approx(1) and geo.coverage(np.diag([0.5, 0.5, 1]), (100, 100), (100, 100)) == pytest.approx(0.25)


def test_ratio_matching_equals_brute_force():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 256, (40, 32), dtype="u1"), rng.integers(0, 256, (50, 32), dtype="u1")
    b[:20] = a[:20] ^ (rng.random((20, 32)) < 0.05)
    want = []
    for i, x in enumerate(a):
        d = np.unpackbits(x ^ b, axis=1).sum(1)
        order = np.argsort(d, kind="stable")
        if d[order[0]] < 0.75 * d[order[1]]:
            want.append([i, order[0]])
    assert geo.matched(a, b).tolist() == want and len(geo.matched(a, b[:1])) == 0


def test_warping_equals_brute_force():
    rng = np.random.default_rng(6)
    for n, m in ((1, 1), (1, 7), (9, 4), (30, 31)):
        a, b = rng.random(n), rng.random(m)
        cost = np.full((n + 1, m + 1), np.inf)
        cost[0, 0] = 0
        for i in range(n):
            for j in range(m):
                cost[i + 1, j + 1] = abs(a[i] - b[j]) + min(cost[i, j + 1], cost[i + 1, j], cost[i, j])
        assert im.warping_distance(a, b) == pytest.approx(cost[n, m] / (n + m))
    p = im.lane_profiles(picture(), [(0, 50), (60, 120)])
    assert len(p) == 2 and len(p[0]) == 256 and im.lanes_distance(p, p) == 0 and im.lanes_distance(p, p[:1]) == 0.5 and im.lanes_distance([], p) is None


def hue_pixel(degrees):
    """A bright, fully coloured pixel of a hue from 0 to 120 degrees."""
    return (255, round(255 * degrees / 60), 0) if degrees <= 60 else (round(255 * (120 - degrees) / 60), 255, 0)


def test_grid_and_stain():
    g = np.full((300, 300), 180.0)
    g[145:155], g[:, 145:155] = 20, 20
    found = im.grid_cells(g)
    assert len(found) == 4 and {(x >= 145, y >= 145) for x, y, _, _ in found} == {(False, False), (True, False), (False, True), (True, True)}
    assert all(140 <= n <= 160 for c in found for n in c[2:])  # each from the border to about the middle of the dark cross
    assert im.grid_cells(np.full((300, 300), 9.0)) == []
    brown = np.full((20, 20, 3), (150, 90, 40), "u1")
    assert im.ihc_like(brown) and not im.ihc_like(np.full((20, 20, 3), 128, "u1"))
    mixed = np.full((10, 10, 3), 128, "u1")
    mixed[0, :6], mixed[1, :6] = (150, 90, 40), (90, 40, 150)  # 6 % of each stain: neither reaches a tenth
    assert im.stain_share(mixed) == (0.06, 0.06) and not im.ihc_like(mixed)
    mixed[2, :4] = (90, 40, 150)
    assert im.stain_share(mixed) == (0.06, 0.10) and im.ihc_like(mixed)
    # hue at both ends of a band, in degrees: 20 and 70 belong to brown, 16 and 74 to neither; too grey or too dark does not count
    for degrees, inside in ((20, True), (70, True), (16, False), (74, False)):
        assert (im.stain_share(np.array([[hue_pixel(degrees)]], "u1"))[0] == 1) == inside
    assert im.stain_share(np.array([[(140, 130, 120), (20, 12, 5)]], "u1")) == (0.0, 0.0)


def test_tables(spark):
    files, pairs = tables.image_files(spark), tables.image_pairs(spark)
    broken = files.unionByName(spark.createDataFrame([("x.pgm", b"no"), ("y.pgm", None)], "path string, content binary"))
    bundles = udfs.hash_bundles(broken)
    assert bundles.where("bundle is null").count() == 2
    from twinsieve.operators.hashing import bundle_distance

    met = pairs.selectExpr("path_a as i", "path_b as j")
    got = {(r.i, r.j): r.hamming for r in bundle_distance(met, udfs.bundle_rows(bundles)).collect()}
    assert all((d <= 4) == (a.split("_")[1] == b.split("_")[1]) for (a, b), d in got.items()) and len(got) == 24
    scores = {(r.path_a, r.path_b): r.ssim for r in udfs.ssim_scores(pairs, files, 160).collect()}
    assert min(s for (_, b), s in scores.items() if "bright" in b) > 0.8
    assert udfs.grid_tiles(files).columns == ["path", "n", "x", "y", "w", "h"]


def test_page_panels(spark):
    got = udfs.page_panels(tables.page_images(spark), tables.SMALL_BOXES).collect()
    by = {}
    for r in got:
        by.setdefault(r.page, []).append((r.panel_num, r.x, r.y, r.w, r.h))
    assert {p: len(v) for p, v in by.items()} == {1: 3, 2: 4, 3: 5, 4: 6}
    assert sorted(by[1]) == [(1, 20, 20, 120, 110), (2, 170, 20, 120, 110), (3, 20, 150, 120, 110)]


def test_jpeg_like_and_text_like():
    g = picture(2, 64)
    blocks = np.kron(im.resized(g, 8, 8), np.ones((8, 8)))
    assert im.jpeg_like(blocks) and not im.jpeg_like(g) and not im.jpeg_like(g[:4, :4])
    assert im.text_like([(2, 50, 40, 8), (40, 40, 40, 8), (2, 50, 9, 8)], (100, 100)) == [(2, 50, 40, 8)]
