import numpy as np
import pytest

from nubes.operators import clouds, generators, topology, transforms, trials


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "pid long, x array<double>")


def dist(x, y):
    return np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))


@pytest.fixture(scope="module")
def pair():
    rng = np.random.default_rng(0)
    return rng.normal(size=(70, 3)), rng.normal(size=(60, 3)) + 1.0


def test_radii_coverage_and_shares_agree_with_numpy(spark, pair, monkeypatch):
    monkeypatch.setattr(clouds, "BLOCK", 16)
    x, y = pair
    d = dist(x, x)
    np.fill_diagonal(d, np.inf)
    radii = np.sort(d, axis=1)[:, 2]
    got = {r.pid: r.radius for r in clouds.knn_radii(frame(spark, x), 3).collect()}
    assert np.allclose([got[i] for i in range(70)], radii)
    row = clouds.precision_recall(frame(spark, x), frame(spark, y), (3,)).first()
    assert row.precision == pytest.approx((dist(y, x) <= radii + 1e-12).any(axis=1).mean())


def test_copies_have_radius_zero_and_a_copy_covers_fully(spark):
    x = np.array([[0.0, 0], [0, 0], [3, 4], [3, 4]])
    assert {r.radius for r in clouds.knn_radii(frame(spark, x), 1).collect()} == {0.0}
    assert tuple(clouds.precision_recall(frame(spark, x), frame(spark, x), (1,)).first()) == (1, 1.0, 1.0)
    with pytest.raises(Exception, match="k must"):
        clouds.knn_radii(frame(spark, x), 4).collect()


def test_median_distance_is_exact(spark, pair, monkeypatch):
    monkeypatch.setattr(clouds, "BLOCK", 16)
    for x in (pair[0], np.zeros((5, 2)), np.array([[0.0], [1.0]])):
        d = dist(x, x)[np.triu_indices(len(x), 1)]
        assert clouds.median_distance(frame(spark, x)) == pytest.approx(np.median(d))
    assert clouds.median_distance(frame(spark, np.zeros((1, 2)))) is None


def test_moments_and_frechet(spark, pair):
    x, y = pair
    n, mean, cov = clouds.moments(frame(spark, x))
    assert n == 70 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x, rowvar=False))
    same = clouds.moments(frame(spark, x))
    assert topology.frechet(same, same) == pytest.approx(0, abs=1e-5)


def test_spanning_tree_and_mtd0_agree_with_prim(spark, pair, monkeypatch):
    monkeypatch.setattr(clouds, "BLOCK", 16)
    x, y = pair[0][:40], pair[1][:30]
    lengths = sorted(r.length for r in topology.spanning_tree(frame(spark, x)).collect())
    assert np.allclose(lengths, np.sort(topology.prim(dist(x, x))))
    assert topology.mtd0(frame(spark, x), frame(spark, y)).first().mtd0 == pytest.approx(topology.joined_mean(x, y))
    # ties: a grid whose edges all have one length
    grid = np.array([[i, j] for i in range(4) for j in range(4)], float)
    assert [r.length for r in topology.spanning_tree(frame(spark, grid)).collect()] == [1.0] * 15


def test_rtd_of_equal_rows_is_zero_and_sinkhorn_grows(spark, pair):
    x, y = pair
    f = frame(spark, x)
    assert topology.rtd(topology.paired(f, f), trials=1, batch=14).first().rtd == pytest.approx(0, abs=1e-9)
    near, far = (topology.sinkhorn(f, frame(spark, x[:60] + s)).first().cost for s in (0.0, 5.0))
    assert far > near


def test_pca_projects_as_numpy(spark, pair):
    x, y = pair
    model = transforms.pca_fit(frame(spark, x), 2)
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    got = np.array([r.x for r in transforms.pca_transform(frame(spark, y), model).orderBy("pid").collect()])
    assert np.allclose(np.abs(got), np.abs((y - x.mean(0)) @ axes[:2].T))
    assert model.shares.sum() == pytest.approx(1)


def test_image_filters(spark):
    images = spark.createDataFrame([(1, [10, 200, 30, 40] * 4)], "image_id long, pixels array<int>")
    assert transforms.noise(images, 0.0).first().pixels == [10, 200, 30, 40] * 4
    assert transforms.noise(images, 0.1).first().pixels != [10, 200, 30, 40] * 4
    assert transforms.blur(images, 0.0, 4, 4).first().pixels == [10, 200, 30, 40] * 4
    flat = spark.createDataFrame([(1, [77] * 16)], "image_id long, pixels array<int>")
    assert transforms.blur(flat, 1.0, 4, 4).first().pixels == [77] * 16


def test_generators(spark):
    g = generators
    sizes = g.quotas(10, 4)
    assert sizes.tolist() == [3, 3, 2, 2]
    one = g.generate(g.requests(spark, [("a", 40, 1), ("b", 40, 1)]), g.exact_mass(8, 40, 6))
    a, b = (np.array([r.x for r in one.where(f"cloud_id = '{c}'").orderBy("pid").collect()]) for c in "ab")
    assert np.array_equal(a, b) and (np.abs(a[:, 0]) > 11).sum() == 6
    for bad in (lambda: g.dropped_pairs(8, 8, [(0, 3)]), lambda: g.exact_mass(8, 4, 9), lambda: g.mixture(1.0, 2)):
        with pytest.raises(ValueError):
            bad()
    ring8, square4 = g.matched_pair(64)
    m8, m4 = (g.population_moments(c, 1.0) for c in (g.circle(8, 8.0), np.sqrt(32) * np.array([[1, 1], [1, -1], [-1, 1], [-1, -1.0]])))
    assert np.allclose(m8[0], m4[0]) and np.allclose(m8[1], m4[1]) and np.allclose(m8[1], 33 * np.eye(2))


def test_rtd_counts_what_one_cloud_joins_later(spark):
    """Two rows at distance 5 in one cloud and 1 in the other: after scaling by the 0.9 quantile both clouds are alike; three rows
    whose order of merging differs are not."""
    p, q = np.array([[0.0], [1.0], [5.0]]), np.array([[0.0], [4.0], [5.0]])
    a, b = (np.abs(x - x.T) / np.quantile(np.abs(x - x.T), 0.9) for x in (p, q))

    def one_way(a, b):
        # single-linkage merges: the smaller distances against a, matched by the lengths of their spanning trees
        tree = lambda d: sorted(topology.prim(d))
        return sum(tree(a)) - sum(tree(np.minimum(a, b)))

    got = topology.rtd(topology.paired(frame(spark, p), frame(spark, q)), trials=1, batch=3).first().rtd
    assert got == pytest.approx((one_way(a, b) + one_way(b, a)) / 2) and got > 0.1


def test_many_trials_equal_one_at_a_time(spark, pair):
    x, y = pair
    pool = clouds.pooled(frame(spark, x), frame(spark, y))
    weights = trials.relabelled(pool, len(x), 3, 1)
    values = {r.trial: r.value for r in trials.trial_energy(trials.weighted(pool, weights), 4).collect()}
    both = {**{2 * i: v for i, v in enumerate(x)}, **{2 * i + 1: v for i, v in enumerate(y)}}
    dist = lambda a, b: np.linalg.norm(np.array(a)[:, None] - np.array(b)[None], axis=2).mean()
    for t in range(4):
        sides = {"p": [], "q": []}
        for r in weights.where(f"trial = {t}").collect():
            sides[r.side] += [both[r.pid]] * r.w
        p, q = sides["p"], sides["q"]
        assert len(p) == len(x) and values[t] == pytest.approx(2 * dist(p, q) - dist(p, p) - dist(q, q))
    table = trials.permutation_table(trials.trial_energy(trials.weighted(pool, weights), 4).selectExpr("*", "'energy' AS metric")).first()
    assert table.p == pytest.approx((sum(values[t] >= values[0] for t in (1, 2, 3)) + 1) / 4)


def test_turned_images(spark):
    rng = np.random.default_rng(3)
    images = rng.integers(0, 256, (4, 6, 6))
    f = spark.createDataFrame([(i, im.ravel().tolist()) for i, im in enumerate(images)], "id long, pixels array<int>")
    from pyspark.sql import functions as F

    def turn(angle, scale):
        rows = f.select("id", transforms.turned(F.col("pixels"), F.lit(angle), F.lit(scale), 6, 6).alias("x")).orderBy("id").collect()
        return np.array([r.x for r in rows]).reshape(-1, 6, 6)

    assert (turn(0.0, 1.0) == images).all() and (turn(360.0, 1.0) == images).all()
    assert all((turn(90.0 * k, 1.0)[i] == np.rot90(images[i], k)).all() for k in range(4) for i in range(4))
    assert turn(45.0, 1.0)[:, 0, 0].max() <= 40 and (turn(30.0, 0.5)[:, 0, :] == 0).mean() > 0.9
    assert transforms.scale_grid() == pytest.approx(np.linspace(0.6, 1.4, 9)) and len(transforms.angles_by_step(10.0)) == 36 and transforms.angles_by_step(10.0)[-1] == 350.0
