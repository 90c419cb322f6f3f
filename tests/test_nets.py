"""Gradients against finite differences, and that the networks learn what they should."""

import numpy as np
import pytest

from pairloom.operators import nets as N


@pytest.mark.parametrize("make", [lambda: N.classifier(1, widths=(2, 3, 3), hidden=4, dropout=0.0), lambda: N.autoencoder(1, (2, 2, 3))])
def test_gradients(make):
    rng = np.random.default_rng(0)
    x, net = rng.normal(size=(3, 1, 8, 8)), make()
    y, weight = np.array([0, 2, 1]), np.array([1.0, 2.0, 0.5])
    loss = (lambda: N.cross_entropy(net.forward(x, True), y, weight)) if "hidden" in net.marks else (lambda: N.squared_error(net.forward(x, True), x))
    net.backward(loss()[1])
    for layer in net.layers:
        for name, g in layer.grads.items():
            p = layer.params[name]
            for k in rng.choice(p.size, min(4, p.size), replace=False):
                at = np.unravel_index(k, p.shape)
                was = p[at]
                p[at] = was + 1e-5
                up = loss()[0]
                p[at] = was - 1e-5
                down = loss()[0]
                p[at] = was
                assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def pictures(n, seed):
    """Three classes: rows of light in a corner, columns of light there, noise alone."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.normal(0, 0.3, (n, 1, 16, 16))
    for k, c in enumerate(y):
        if c == 0:
            x[k, 0, :7:2, :7] += 3
        elif c == 1:
            x[k, 0, :7, :7:2] += 3
    return x, y, np.arange(n)


def test_classifier_learns_and_looks_where_it_should():
    train, val = pictures(150, 1), pictures(60, 2)
    net, best, history = N.fit_classifier(train, val, epochs=12, patience=5, widths=(6, 8, 8), hidden=16, dropout=0.1)
    assert history[best - 1]["score"] == max(h["score"] for h in history)
    assert (N.predict(net, val[0]).argmax(1) == val[1]).mean() > 0.9
    x = pictures(40, 3)
    corner = [N.grad_cam(net, v) for v, y in zip(x[0], x[1]) if y == 0]
    assert all(0 <= c.min() and c.max() <= 1 for c in corner)
    assert np.mean([c[:6, :6].mean() > c[8:, 8:].mean() for c in corner]) > 0.8


def test_autoencoder_learns():
    train, val = pictures(120, 4)[0], pictures(40, 5)[0]
    net, best, history = N.fit_autoencoder(train, val, epochs=8, patience=8, widths=(6, 6, 8))
    first, last = -history[0]["score"][0], -history[best - 1]["score"][0]
    assert last < 0.8 * first and ((N.predict(net, val) - val) ** 2).mean() == pytest.approx(last)


def test_bilinear_and_images(spark):
    assert np.allclose(N.bilinear(4, 8).sum(1), 1) and np.allclose(N.bilinear(2, 4) @ [0.0, 1.0], [0, 0.25, 0.75, 1])
    df = spark.createDataFrame([("a", 0, 1, 2.0), ("a", 2, 2, 5.0)], "k string, i int, j int, value double")
    m = np.array(N.images(df, ["k"], 3).first()["image"]).reshape(3, 3)
    assert m.tolist() == [[0, 2, 0], [2, 0, 0], [0, 0, 5]]
