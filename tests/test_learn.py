import numpy as np
import pytest

from timberline.operators import learn, training


def numeric(net, at, *args, eps=1e-5):
    """Central differences of the loss for some entries of one weight array."""
    out = []
    for k in at[1]:
        flat, old = net.weights[at[0]].reshape(-1), net.weights[at[0]].reshape(-1)[k]
        values = []
        for step in (eps, -eps):
            flat[k] = old + step
            values.append(net.gradient(*args)[0])
        flat[k] = old
        out.append((values[0] - values[1]) / (2 * eps))
    return np.array(out)


@pytest.mark.parametrize("keep", [1.0, 0.7])
def test_gradients_of_the_segmenter_equal_differences(keep):
    r = np.random.default_rng(0)
    net = learn.Segmenter.random(channels=2, seed=1, keep_prob=keep)
    grid = (r.random((6, 7, 5)) < 0.3).astype(float)
    target = np.where(grid > 0, r.integers(1, 3, grid.shape), 0)
    args = (grid, target, np.array([0.5, 2.0, 3.0]), 3)
    for layer, g in enumerate(net.gradient(*args)[1]):
        at = r.integers(0, g.size, 6)
        assert np.allclose(g.ravel()[at], numeric(net, (layer, at), *args), atol=1e-6)


def test_gradients_of_the_latent_net_equal_differences():
    r = np.random.default_rng(2)
    net = learn.LatentNet.random((6, 7, 5), codes=3, channels=2, alpha=0.7)
    args = ((r.random((6, 7, 5)) < 0.3).astype(float), None, None, 5)
    for layer, g in enumerate(net.gradient(*args)[1]):
        at = r.integers(0, g.size, 6)
        assert np.allclose(g.ravel()[at], numeric(net, (layer, at), *args), atol=1e-4)


def test_layers():
    r = np.random.default_rng(3)
    x, w, b = r.normal(size=(4, 9, 2)), r.normal(size=(3, 2, 5)), r.normal(size=5)
    for padding, pad in (("SAME", 1), ("VALID", 0)):
        for stride in (1, 2):
            if padding == "SAME" and stride == 2:
                pad = 1  # nine cells by two: five places, one cell before
            wide = np.pad(x, ((0, 0), (pad, pad), (0, 0)))
            n = (wide.shape[1] - 3) // stride + 1
            want = np.stack([np.einsum("nkc,kco->no", wide[:, s * stride : s * stride + 3], w) for s in range(n)], 1) + b
            assert np.allclose(learn.conv1d(x, w, b, stride, padding), want)
            y = r.normal(size=want.shape)
            back = learn.deconv1d(y, w.transpose(0, 1, 2), np.zeros(2), 9, stride, padding)
            assert np.isclose((learn.conv1d(x, w, 0.0, stride, padding) * y).sum(), (back * x).sum())  # the adjoint
    assert np.allclose(learn.dense(x[:, 0], w[0], b), x[:, 0] @ w[0] + b)
    n = learn.batch_norm(r.normal(3, 5, (500, 4)), eps=0.0)
    assert np.allclose(n.mean(0), 0) and np.allclose(n.var(0), 1)
    kept = learn.dropout(np.ones(10_000), 0.25, 1)
    assert set(np.unique(kept)) == {0.0, 4.0} and abs(kept.mean() - 1) < 0.1 and (learn.dropout(kept, 1.0) == kept).all()
    assert learn.activation("lrelu")(np.array([-1.0, 2.0])).tolist() == [-0.2, 2.0] and learn.activation("sigmoid")(0.0) == 0.5
    for kind in ("gaussian", "uniform", "he", "constant", "zeros"):
        assert learn.initial_weights(kind, (3, 4)).shape == (3, 4)
    for bad in (lambda: learn.activation("x"), lambda: learn.initial_weights("x", (1,)), lambda: learn.Optimiser("x"), lambda: learn.conv1d(x, w, b, 0)):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("method", ["Adam", "SGD", "RMS"])
def test_optimisers_find_a_minimum(method):
    o, w = learn.Optimiser(method, 0.05), [np.array([3.0, -2.0])]
    for _ in range(600):
        w = o.update(w, [2 * (w[0] - 1)])
    assert np.allclose(w[0], 1, atol=0.1)
    stairs = learn.Optimiser("SGD", 1.0, decay_steps=1, decay_rate=0.5)
    steps = [float(stairs.update([np.zeros(1)], [np.ones(1)])[0][0]) for _ in range(3)]
    assert steps == [-1.0, -0.5, -0.25]


def trees(spark, n=6):
    """Trees with a stem (cube 2) in the middle column and foliage (1) around its top."""
    r, rows = np.random.default_rng(4), []
    for t in range(n):
        rows += [(t, 3, 3, z, 2) for z in range(6)]
        rows += [(t, int(x), int(y), int(z), 1) for x, y, z in {(x, y, 4 + x % 2) for x, y in r.integers(0, 6, (8, 2)).tolist() if (x, y) != (3, 3)}]
    return spark.createDataFrame(rows, "tree_id int, ix int, iy int, iz int, cube int")


def test_training_lowers_the_loss_and_resumes(spark, tmp_path):
    batches = training.voxel_batches(trees(spark), 3, "tree_id")
    whole, o = learn.Segmenter.random(channels=2), learn.Optimiser("Adam", 0.02)
    history = learn.train(batches, (6, 6, 6), whole, o, 4, str(tmp_path / "a"), save_epochs=(1,))
    assert [e for e, _ in history] == [0, 1, 2, 3] and history[-1][1] < history[0][1]
    again, o2 = learn.Segmenter.random(channels=2, seed=9), learn.Optimiser("Adam", 0.02)
    rest = learn.train(batches, (6, 6, 6), again, o2, 4, str(tmp_path / "b"), resume=str(tmp_path / "a" / "epoch_1"))
    assert [e for e, _ in rest] == [2, 3] and all(np.allclose(a, b) for a, b in zip(whole.weights, again.weights, strict=True))
    loaded, o3 = learn.Segmenter.random(channels=2, seed=5), learn.Optimiser()
    assert learn.load_model(spark, str(tmp_path / "b" / "epoch_3"), loaded, o3) == 4 and o3.step == 8
    assert all(np.array_equal(a, b) for a, b in zip(loaded.weights, again.weights, strict=True))
    assert learn.train(batches.limit(0), (6, 6, 6), loaded, o3, 1, str(tmp_path / "c")) == []


def test_latent_net_learns_and_reconstructs(spark, tmp_path):
    voxels = trees(spark).drop("cube")
    net = learn.LatentNet.random((6, 6, 6), codes=3, channels=2, alpha=0.1)
    history = learn.train(training.voxel_batches(voxels, 3, "tree_id"), (6, 6, 6), net, learn.Optimiser("Adam", 0.02), 8, str(tmp_path / "v"))
    assert history[-1][1] < 0.8 * history[0][1]
    found = {(r.tree_id, r.ix, r.iy, r.iz) for r in learn.reconstructed(voxels, net).collect()}
    stem = {(t, 3, 3, z) for t in range(6) for z in range(6)}
    assert all(0 <= x < 6 for _, x, _, _ in found) and len(found & stem) >= 0.5 * len(stem)
