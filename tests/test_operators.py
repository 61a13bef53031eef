"""Properties of the operators on small fixtures."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import audit, kernels, metrics, montecarlo, provenance, selective, survey
from assayer.sources import tables
from assayer.streaming import monitor


def predictions(spark, rows):
    return spark.createDataFrame([(i, "m", *r) for i, r in enumerate(rows)], "case_id long, clinic string, label int, prob double")


def test_single_class_is_null(spark):
    df = predictions(spark, [(1, 0.9), (1, 0.2)])
    assert metrics.roc_auc(df, "clinic").first().auc is None
    r = metrics.rates(metrics.confusion(df, "clinic")).first()
    assert r.specificity is None and r.sensitivity == 0.5
    assert metrics.brier_skill(df, "clinic").first().skill is None


def test_auc_ties_are_half(spark):
    assert metrics.roc_auc(predictions(spark, [(i % 2, 0.5) for i in range(10)]), "clinic").first().auc == 0.5


def test_reliability_keeps_empty_bins(spark):
    r = metrics.reliability(predictions(spark, [(1, 0.99), (0, 0.02)]), "clinic").collect()
    assert len(r) == 15 and sum(x.n for x in r) == 2 and sum(x.mean_confidence is None for x in r) == 14


def test_murphy_adds_up(spark):
    rng = random.Random(0)
    rows = [(y := rng.randint(0, 1), 1 / (1 + math.exp(-(2 * (y - 0.5) + rng.gauss(0, 1.2))))) for _ in range(500)]
    m = metrics.murphy(predictions(spark, rows), "clinic").first()
    assert abs(m.reconstructed - m.actual) < 1e-2 and min(m.reliability, m.resolution, m.uncertainty) >= 0


def test_constant_base_rate_has_no_skill(spark):
    rows = [(i % 4 == 0, 0.25) for i in range(300)]
    assert abs(metrics.brier_skill(predictions(spark, [(int(y), p) for y, p in rows]), "clinic").first().skill) < 1e-9


def test_conformal_not_attainable(spark):
    fit = metrics.conformal_quantile(predictions(spark, list(zip([0, 1, 0, 1, 0], [0.2, 0.8, 0.3, 0.7, 0.1]))), 0.05, "clinic").first()
    assert not fit.attainable and fit.q == 1.0


def test_conformal_set_sizes(spark):
    fit = spark.createDataFrame([(0.2,)], "q double")
    s = metrics.conformal_sets(predictions(spark, [(1, 0.99), (1, 0.5), (0, 0.01)]), fit).orderBy("case_id").collect()
    assert [r["size"] for r in s] == [1, 0, 1] and [r.decision for r in s] == ["report", "no_plausible_label", "report"]
    assert metrics.conformal_sets(predictions(spark, [(1, 0.5)]), fit.select(F.lit(0.9).alias("q"))).first().decision == "ambiguous"


def test_rescue(spark):
    df = predictions(spark, list(zip([0, 0, 1, 1], [0.9, 0.4, 0.6, 0.1])))
    r = selective.human_rescue(df, 0.7, "clinic").first()
    assert r.n_deferred == 2 and r.would_correct == 0.0


def test_better_confidence_has_less_risk(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), rng.random()) for _ in range(400)]
    df = predictions(spark, rows).withColumn("right", ((F.col("prob") >= 0.5) == (F.col("label") == 1)).cast("double"))
    oracle = df.withColumn("c", F.col("right") + F.col("prob") * 1e-3)
    blind = df.withColumn("c", F.abs(F.col("prob") - 0.5))
    a, b = (selective.aurc(selective.risk_coverage(d, "c", "clinic"), "clinic").first().aurc for d in (oracle, blind))
    assert a < b


def manifest(spark):
    return spark.createDataFrame([(f"{c}/{i}.png", c, i % 2) for c in ("a", "b") for i in range(60)] + [(f"n/{i}.png", "n", 1) for i in range(10)], "path string, clinic string, label int")


def test_splits(spark):
    m = manifest(spark)
    s = provenance.split(m, "loco", holdout="a").cache()
    assert {r.clinic for r in s.where("split = 'test'").collect()} == {"a"} and s.where("clinic = 'a' and split <> 'test'").isEmpty()
    assert s.where("split = 'val'").count() == 12 + 2
    assert s.exceptAll(provenance.split(m, "loco", holdout="a")).isEmpty()
    for bad in ("n", "zzz"):
        with pytest.raises(ValueError, match="only class|unknown holdout"):
            provenance.split(m, "loco", holdout=bad)
    with pytest.raises(ValueError, match="unknown split mode"):
        provenance.split(m, "other")
    with pytest.raises(ValueError, match="fractions"):
        provenance.split(m, "random", val_fraction=0.6, test_fraction=0.6)


def test_provenance(spark):
    d = spark.createDataFrame([("MCUCXR_0001_0.png", -1), ("CHNCXR_0002_1.png", -1), ("x/rsna/abc.png", -1), ("y_1.png", 0)], "path string, label int")
    r = d.select(provenance.clinic_of_path(F.col("path")), provenance.label_of_name(F.col("path"), F.col("label"))).collect()
    assert [tuple(x) for x in r] == [("montgomery", 0), ("shenzhen", 1), ("rsna", -1), ("unknown", 0)]


def test_banded_pairs_match_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(20)]
    hashes = base + [h ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for h in base]
    df = spark.createDataFrame([(i, "e0", h) for i, h in enumerate(hashes)], "id long, clinic string, hash long")
    got = {(r.id_a, r.id_b) for r in audit.near_pairs(df, df, 6).collect()}
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if (hashes[i] ^ hashes[j]).bit_count() <= 6} and len(got) >= 20


def test_strata_and_weights(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,), (None,)], "x double")
    s = [r.s for r in survey.quantile_stratum(d, "x", 3, "s").collect()]
    assert s.count(-1) == 2 and all(v >= 0 for v in s if v != -1)
    cells = spark.createDataFrame([(i % 12,) for i in range(600)], "cell int")
    w = survey.stratum_weights(cells, 10, "cell").collect()
    assert len(w) == 12 and abs(sum(r.drawn * r.weight for r in w) - 600) < 1e-9


def test_unmeasured_ranks_worst(spark):
    d = spark.createDataFrame([(-5.0,), (-1.0,), (None,)], "margin_db double")
    r = [x.referral for x in survey.referral_score(d).collect()]
    assert r[2] > r[0] > r[1]


def test_rare_agreement(spark):
    pairs = spark.createDataFrame([(0, 0)] * 97 + [(1, 1), (0, 1), (1, 0)], "a int, b int").withColumn("g", F.lit(1))
    r = survey.agreement(pairs, "g").first()
    assert r.kappa < 0.8 and r.ac1 > 0.95


def readings(spark):
    rng = random.Random(1)
    values = [rng.gauss(0.2, 0.02) for _ in range(15)] + [rng.gauss(0.35, 0.02) for _ in range(20)]
    return values, spark.createDataFrame([("m", i, i, v) for i, v in enumerate(values)], "clinic string, ts long, seq long, value double")


def test_cusum_finds_the_shift_and_the_stream_agrees(spark, tmp_path):
    values, df = readings(spark)
    batch = monitor.cusum(df, 0.2, 0.05, 0.5).orderBy("seq").collect()
    high = 0.0
    for r, v in zip(batch, values):
        high = max(0.0, high + v - 0.25)
        assert abs(r.high - high) < 1e-9
    assert not any(r.alarm for r in batch[:15]) and batch[-1].alarm
    df.write.parquet(str(tmp_path / "in"))
    q = monitor.cusum_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 0.2, 0.05, 0.5).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    stream = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [(r.seq, r.alarm) for r in stream] == [(r.seq, r.alarm) for r in batch]


def test_assignment_is_balanced():
    edges = [(f"f{i}", f"c{j}") for i in range(40) for j in range(4) if (i + j) % 2 == 0 or j == 0]
    drawn = montecarlo.balanced_assignment(edges, 8)
    sizes = [list(drawn.values()).count(f"c{j}") for j in range(4)]
    assert max(sizes) - min(sizes) <= 1 and len(drawn) == sum(sizes)


def test_cluster_interval_is_wider(spark):
    rng = random.Random(3)
    rows = []
    for film in range(40):
        shift = rng.gauss(0, 1)
        rows += [(film * 5 + k, film, y := film % 2, y + shift + rng.gauss(0, 0.3)) for k in range(5)]
    df = spark.createDataFrame(rows, "case_id long, film long, label int, prob double")
    a, b = (montecarlo.cluster_bootstrap(df, "prob", c, draws=100).first() for c in ("film", "case_id"))
    assert a.high - a.low > b.high - b.low


def test_degradation(spark):
    d = spark.createDataFrame([(i, [float(x) for x in range(64)]) for i in range(5)], "id long, px array<double>")
    assert all(r.px == [float(x) for x in range(64)] and r.ops == [] for r in kernels.degrade(d, 0.0).collect())
    assert all(len(r.px) == 64 for r in kernels.degrade(d, 0.5).collect())
    with pytest.raises(ValueError, match="unknown"):
        kernels.degrade(d, 0.5, ["nope"])
    assert abs(statistics.mean(kernels.blurred(d, 1.0).first().px) - 31.5) < 1e-6


def test_sources(spark, tmp_path):
    (tmp_path / "f.csv").write_text("key,name,delta_d,delta_d_sigma,size_mm,size_sigma_mm,note,source\nnodule,,0.1,,8,,,\n")
    f = tables.read_findings(spark, str(tmp_path / "f.csv")).first()
    assert f["name"] == "nodule" and f.delta_d_sigma == 0.0
    (tmp_path / "e.csv").write_text("key,name,delta_d\n")
    with pytest.raises(ValueError, match="no findings"):
        tables.read_findings(spark, str(tmp_path / "e.csv"))
    for p in ("tb/a.PNG", "normal/b.jpg", "other/c.bmp", "tb/d.txt"):
        (tmp_path / "img" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "img" / p).write_bytes(b"x")
    got = tables.scan_directory(spark, str(tmp_path / "img"), {"tb": 1, "normal": 0}).collect()
    assert sorted(r.label for r in got) == [-1, 0, 1]


def test_global_rank_is_exact(spark):
    from assayer.operators.ranking import global_rank

    rng = random.Random(9)
    rows = [(i, rng.choice([0.0, 1.5, rng.random()])) for i in range(2000)]
    got = {r.i: r.r for r in global_rank(spark.createDataFrame(rows, "i long, x double").repartition(5), "x", "i", "r").collect()}
    assert got == {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda t: (t[1], t[0])), 1)}


def test_assignment_reads_all_films(spark):
    """The design of all edges, more than a driver is asked to hold, by the search over all of them."""
    cells = {f"c{j}": [f"f{i}" for i in range(9_000) if (i + j) % 3 and (j > 1 or i % 4_000 == 1)] for j in range(6)}
    edges = [(film, c) for c, films in cells.items() for film in films]
    assert len(edges) > 20_000
    df = spark.createDataFrame(edges, "film string, cell string")
    drawn = [tuple(r) for r in montecarlo.assigned(df, "film", "cell", 4).collect()]
    assert drawn == sorted(montecarlo.balanced_assignment(edges, 4).items())


def test_assignment_query_reads_all_films(spark):
    from types import SimpleNamespace

    from assayer.registry import catalogue

    rows = spark.createDataFrame([(i, f"c{i % 2}", 0.25 * (i % 5)) for i in range(200, 300)], "film long, clinic string, severity double")
    assert catalogue.balanced_assignment(SimpleNamespace(predictions=rows)).count() == 50


def test_coral_reads_whole_vectors(spark):
    """Against numpy, with clinics that differ in their last values only."""
    import numpy as np

    from assayer.plans.views import Views
    from assayer.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    clinics: dict = {}
    for r in Views(spark, sf).images.select("clinic", "px").collect():
        clinics.setdefault(r.clinic, []).append(r.px)
    stats = {k: (np.mean(x, 0), np.cov(np.array(x, float).T)) for k, x in clinics.items() if len(x) > 1}
    got = {(r.clinic_a, r.clinic_b): r.distance for r in QUERIES["coral_distance"](spark, sf).collect()}
    assert len(got) == len(stats) * (len(stats) - 1) // 2
    for (a, b), distance in got.items():
        (ma, ca), (mb, cb) = stats[a], stats[b]
        assert distance == pytest.approx(((ma - mb) ** 2).sum() + ((ca - cb) ** 2).sum() / (4 * len(ma) ** 2), abs=1e-6)

    from assayer.operators.physics import coral

    rows = [("ab"[i % 2], [float(i % 3)] * 63 + [float(i % 2) * 5]) for i in range(12)]
    assert coral(spark.createDataFrame(rows, "clinic string, x array<float>").repartition(3)).first().distance == pytest.approx(25)


def test_left_join_drops_no_partner(spark):
    """A row is unmatched only if its key is in no row of the other table."""
    from assayer.plans.views import Views
    from assayer.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    known = {r.doc_id for r in Views(spark, sf).table("labels").collect()}
    rows = QUERIES["left_join_labels"](spark, sf).collect()
    assert {r.doc_id for r in rows if r.quality is not None} == known & {r.doc_id for r in rows}
    assert any(r.quality is None for r in rows)


def test_bootstrap_draws_are_those_of_a_plain_loop(spark):
    """Each draw's weights, and its AUC by all pairs; scores that tie, clusters with one label, a null cluster; by group."""
    rng = random.Random(6)
    rows = [("ab"[i % 2], rng.choice([0.1, 0.2, 0.5, rng.random()]), None if i % 13 == 0 else i % 7, int(rng.random() < 0.4)) for i in range(120)] + [("a", None, 1, 1), ("c", 0.5, 1, 1)]
    got = {r.g: r for r in montecarlo.cluster_bootstrap(spark.createDataFrame(rows, "g string, x double, film int, label int"), "x", "film", draws=60, by=["g"]).collect()}
    for g in "ab":
        aucs = []
        for b in range(60):
            total = above = 0.0
            own = [(x, y, montecarlo.draws_of("" if c is None else str(c), 60, 1)[b]) for h, x, c, y in rows if h == g and x is not None]
            for x, y, w in own:
                for u, z, t in own:
                    if y == 1 and z == 0:
                        total += w * t
                        above += w * t * ((x > u) + (x == u) / 2)
            if total:
                aucs.append(above / total)
        assert got[g].draws == len(aucs)
        assert (got[g].low, got[g].median, got[g].high) == pytest.approx(tuple(np.quantile(aucs, [0.025, 0.5, 0.975])), abs=1e-9)
    assert got["c"].draws == 0 and got["c"].low is None


def test_folds_keep_groups_and_are_even(spark):
    rng = random.Random(4)
    rows = [(g, int(rng.random() < (0.3 if g % 3 else 0.0))) for g in range(60) for _ in range(rng.randint(1, 30))]
    rows = rows + [(None, 1), (None, 0), (61, None)]
    got = montecarlo.stratified_folds(spark.createDataFrame(rows, "g int, y int"), "g", "y", 5).collect()
    sizes, positives = [0] * 5, [0] * 5
    for r in got:
        sizes[r.fold] += r.n
        positives[r.fold] += r.positives
    assert len(got) == 61 and sum(sizes) == len(rows) - 1 and len({r.g for r in got}) == 61
    assert max(sizes) - min(sizes) <= 2 * max(r.n for r in got) and max(positives) - min(positives) <= 2 * max(r.n for r in got)
    few = montecarlo.stratified_folds(spark.createDataFrame([(i, int(i < 2)) for i in range(30)], "g int, y int"), "g", "y", 5).collect()
    assert {r.fold for r in few} == {0, 1}
    one = montecarlo.stratified_folds(spark.createDataFrame([(i, 1) for i in range(30)], "g int, y int"), "g", "y", 5).collect()
    assert {r.fold for r in one} == {None}
    assert montecarlo.out_of_fold(spark.createDataFrame([(i, 1, 0.5) for i in range(9)], "id int, y int, x double"), ["x"], "y")[0].collect() == []
