"""Pixel routines against plain definitions, recovery against what was put in, operators on odd rows."""

from dataclasses import replace

import numpy as np
import pytest

from assayer.imaging import degrade, film, findings, inverse, pixels, targets
from assayer.operators import imaging

RNG = np.random.default_rng(7)


def test_blur_keeps_flats_sums_and_matches_the_definition():
    assert np.allclose(pixels.blur(np.full((9, 13), 4.0), 20.0), 4.0)
    image = RNG.random((40, 30))
    assert abs(pixels.blur(image, 2.0).sum() - image.sum()) < 1e-9
    weights = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    wide = np.pad(image, 8, mode="symmetric")
    rows = np.apply_along_axis(lambda v: np.convolve(v, weights / weights.sum(), "valid"), 0, wide)
    assert np.allclose(pixels.blur(image, 2.0), np.apply_along_axis(lambda v: np.convolve(v, weights / weights.sum(), "valid"), 1, rows))


@pytest.mark.parametrize("share", [0.0, 0.2, 0.45, 0.6, 1.0])
def test_components_match_flood_fill(share):
    mask = RNG.random((30, 41)) < share
    labels, seen, n = pixels.components(mask), np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if not seen[start]:
            n, todo = n + 1, [start]
            while todo:
                y, x = todo.pop()
                if 0 <= y < 30 and 0 <= x < 41 and mask[y, x] and not seen[y, x]:
                    seen[y, x] = n
                    todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    assert (labels == seen).all()
    assert sum(s["area"] for s in pixels.shapes(labels)) == mask.sum()


def test_shapes_and_geometry():
    mask = np.zeros((20, 20), bool)
    mask[5:9, 6:12] = True
    assert (pixels.erode(pixels.dilate(mask, 2), 2) == mask).all() and not pixels.erode(mask, 2).any()
    quad = np.array([[3, 4], [30, 2], [33, 28], [1, 31]], float)
    m = pixels.homography(np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float), quad)
    assert np.allclose(pixels.project(m, np.array([[0, 0], [10, 10]])), quad[[0, 2]])
    assert (pixels.corners(quad[[2, 0, 3, 1]]) == quad).all()
    assert np.allclose(pixels.meet(np.array([1, 0, -3.0]), np.array([0, 1, -4.0])), [3, 4]) and pixels.meet(np.array([1, 0, 0.0]), np.array([2, 0, 5.0])) is None
    line, rms = pixels.line_fit(np.column_stack([np.arange(9), 2 * np.arange(9) + 1.0]))
    assert rms < 1e-9 and abs(line @ [4, 9, 1]) < 1e-9
    y, x = np.mgrid[:20, :30]
    assert np.allclose(pixels.surface(y.ravel(), x.ravel(), (1 + y * 0.1 + x * x * 0.01).ravel(), 20, 30, 2), 1 + y * 0.1 + x * x * 0.01)
    low, high = RNG.normal(1, 0.5, 500), RNG.normal(7, 0.5, 500)
    assert low.max() <= pixels.otsu_level(np.r_[low, high]) + 1e-9 < high.min()
    assert np.isnan(pixels.robust_std(np.array([])))


def test_codec_hash_and_features():
    smooth = 255 * film.density_to_display(film.chest(96, RNG).density)
    worse = [np.abs(pixels.jpeg(smooth, q) - smooth).mean() for q in (95, 60, 20)]
    assert worse == sorted(worse) and worse[0] < 2 and pixels.jpeg(smooth[:13, :9], 50).shape == (13, 9)
    bits = lambda a, b: int(np.unpackbits(pixels.difference_hash(a) ^ pixels.difference_hash(b)).sum())
    other = 255 * film.density_to_display(film.chest(96, np.random.default_rng(99)).density)
    assert bits(smooth, degrade.rebundled(smooth, 128)) < bits(smooth, other)
    assert pixels.features(np.full((4, 8), 9.0)) | {} == dict(mean=9, std=0, p05=9, p95=9, entropy=0, laplacian_var=0, height=4, width=8, aspect=2)


def test_degradations():
    image = 255 * film.density_to_display(film.chest(64, RNG).density)
    for name, f in degrade.DEGRADATIONS.items():
        out = f(image, 0.7, np.random.default_rng(1))
        assert out.shape == image.shape and np.isfinite(out).all() and np.abs(out - image).max() > 0, name
    same, record = degrade.degraded(image, 0.0, RNG)
    assert same is image and record == {} and degrade.total_severity(record) == 0
    for seed in range(30):
        record = degrade.degraded(image, 0.5, np.random.default_rng(seed))[1]
        assert len(set(record) & set(degrade.BLURS)) < 2 and all(0.3 <= s <= 0.6 for s in record.values())
    assert degrade.total_severity({"jpeg": 0.5, "glare": 0.5}) > degrade.total_severity({"jpeg": 0.9})
    with pytest.raises(ValueError):
        degrade.degraded(image, 0.5, RNG, ["nope"])


@pytest.mark.parametrize("seed", range(4))
def test_recovery_finds_what_was_put_in(seed):
    rng = np.random.default_rng(seed)
    shot, truth = film.photograph(film.chest(192, rng), film.Capture.drawn(0.25, rng), rng)
    r = inverse.recover(shot)
    assert r.fiducials.coverage == "full" and r.blur.method == "slanted_edge"
    assert np.abs(r.fiducials.quad - truth.quad).max() < 1.5
    assert abs(r.blur.sigma - truth.blur) < 0.3
    assert abs(np.median((r.density - truth.density)[truth.lung])) < 0.5
    assert np.corrcoef(r.density[truth.lung], truth.density[truth.lung])[0, 1] > 0.4


def test_no_fiducials_abstains():
    r = inverse.recover(np.full((64, 64), 120.0))
    c = inverse.certify(r)
    assert r.fiducials.coverage == "none" and c["abstained"] and c["reason"] == "no_fiducials" and c["verdict"] is None


def test_floor_and_channel():
    """Each impairment alone, without the codec, which hides noise from any estimate made after it."""
    floors = {}
    for name, change in {"none": {}, "blur": {"psf_sigma": 4.0}, "glare": {"glare_fraction": 0.25}, "dim": {"full_well": 1000.0}}.items():
        rng = np.random.default_rng(2)
        f = film.chest(192, rng)
        shot, truth = film.photograph(f, replace(film.Capture(quality=None, rotation_deg=2.0), **change), rng)
        r = inverse.recover(shot)
        got = {k.key: inverse.density_floor(r, k) for k in findings.core()}
        floors[name] = {k: float(np.median(x.floor[truth.lung])) for k, x in got.items()}
        assert floors[name]["miliary_nodule"] > floors[name]["consolidation"]
        assert got["miliary_nodule"].energy <= got["miliary_nodule"].energy_sharp
        ch = inverse.channel(r, findings.core()[1])
        assert 0 < ch["delivered_fraction"] <= 1 and all(ch[k] >= -1e-9 for k in ch if k.startswith("lost_"))
    for name in ("blur", "glare", "dim"):
        assert all(floors[name][k] > floors["none"][k] for k in floors["none"]), name
    blurred, sharp = inverse.energies(6.0, lambda f: np.ones_like(f))
    spot = film.profile(37, 37, (18, 18), 6.0)
    assert abs(sharp - (spot**2).sum()) < 1e-6 and abs(blurred - sharp) < 1e-9


def test_tone_needs_three_lights_for_gamma():
    light = np.array([0.6, 0.3, 0.1, 0.03])
    t = inverse.tone_fit([(x, 0.9 * x ** (1 / 1.8), 1e-3) for x in light])
    assert t.method == "three_point" and abs(t.gamma - 1.8) < 0.03 and abs(t.scale - 0.9) < 0.02
    assert inverse.tone_fit([(0.6, 0.5, 1e-3)]).gamma == inverse.GAMMA and inverse.tone_fit([]).method == "prior"
    assert inverse.verdict_of(3.0) == "detectable" and inverse.verdict_of(0.0) == "insufficient" and inverse.verdict_of(1.0) == "marginal"


def test_sheet_and_aids():
    s = targets.sheet(256)
    sane = targets.sanity(s)
    assert sane["overlaps"] == 0 and sane["inside"] and sane["wide_discs"] == 0
    rng = np.random.default_rng(1)
    shot, truth = film.photograph(s.film, film.Capture.drawn(0.0, rng), rng)
    got = targets.score(shot, s)
    assert got["ok"] and got["wedge_rmse"] < 0.05 and abs(got["edge_sigma"] - truth.blur) < 0.5 and 0.7 < got["slope"] < 1.4
    by = {d["patch"]: d for d in got["discs"]}
    assert by["d0.320_s12"]["seen"] and not by["d0.010_s1.5"]["seen"] and by["d0.320_s12"]["dprime"] > by["d0.040_s12"]["dprime"]
    assert not targets.score(np.full((64, 64), 99.0), s)["ok"]
    assert {c["n"] for c in targets.characterise([shot, shot], s)} == {2}
    scale = 0.9
    light = pixels.blur(film.transmittance(targets.aids_strip(256, 40, scale)), 1.0)
    v = film.Capture(gamma=2.0, scurve=0, black=0).tone(light)
    steps = targets.read_wedge(v)
    assert len(steps) == 21 and abs(targets.read_ruler(v) - scale) < 0.03
    assert targets.read_wedge(np.full((40, 256), 0.5)) == [] and targets.read_ruler(np.full((40, 256), 0.5)) is None
    slope, fit = targets.through_origin(np.array([1.0, 2, 3]), np.array([2.0, 4, 6]))
    assert slope == 2 and fit == 1


def test_operators_on_odd_rows(spark):
    d = spark.createDataFrame([(1, 8, 8, bytes(range(64)), "x"), (2, 8, 8, None, "y"), (3, 8, 9, b"abc", "z"), (4, None, None, b"", None)], "id long, h int, w int, photo binary, hash string")
    for f in (imaging.photo_features, imaging.photo_hashes, imaging.rehosted_distance, imaging.fiducial_rows, imaging.certificates):
        rows = {r["id"]: r.asDict() for r in f(d).collect()}
        assert set(rows) == {1, 2, 3, 4} and all(v is None for k in (2, 3, 4) for n, v in rows[k].items() if n != "id"), f.__name__
    assert {r["id"] for r in imaging.degraded_photos(d, 0.0).where("photo is not null").collect()} == {1}
    assert imaging.degraded_photos(d, 0.0).where("id = 1").first()["photo"] == bytes(range(64))
    assert imaging.certificates(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        imaging.degraded_photos(d, 0.5, ["nope"])


def test_captures_are_the_same_every_time(spark):
    ids = spark.range(3).selectExpr("id", "0.5D as severity")
    a, b = ({r["id"]: r["photo"] for r in imaging.captures(ids, 64).collect()} for _ in range(2))
    assert a == b and len(set(a.values())) == 3
