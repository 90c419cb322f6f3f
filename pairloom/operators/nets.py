"""Small convolutional networks in NumPy, with hand-written gradients: a classifier of contact windows, a background autoencoder, Grad-CAM.

Training runs on the driver over a bounded number of matrices (MOST_IMAGES, an error beyond), as the annotated structures and the background of a
genome's blocks are; prediction runs over Arrow batches of any table. Images are float arrays (n, channels, height, width).
"""

from __future__ import annotations

import copy
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most matrices that one training holds.
MOST_IMAGES = 20_000


class Layer:
    """params and grads are dictionaries of arrays; forward keeps what backward needs."""

    def __init__(self):
        self.params: dict[str, np.ndarray] = {}
        self.grads: dict[str, np.ndarray] = {}

    def forward(self, x: np.ndarray, train: bool) -> np.ndarray:
        raise NotImplementedError

    def backward(self, g: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class Conv(Layer):
    """3 x 3 convolution with zero padding, as one matrix product over shifted copies."""

    def __init__(self, rng: np.random.Generator, inputs: int, outputs: int):
        super().__init__()
        self.params = {"w": rng.normal(0, np.sqrt(2 / (9 * inputs)), (outputs, inputs, 3, 3)), "b": np.zeros(outputs)}

    def forward(self, x, train):
        padded = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
        self.patches = np.lib.stride_tricks.sliding_window_view(padded, (3, 3), axis=(2, 3))
        return np.einsum("nchwij,ocij->nohw", self.patches, self.params["w"], optimize=True) + self.params["b"][:, None, None]

    def backward(self, g):
        self.grads = {"w": np.einsum("nohw,nchwij->ocij", g, self.patches, optimize=True), "b": g.sum((0, 2, 3))}
        padded = np.pad(g, ((0, 0), (0, 0), (1, 1), (1, 1)))
        views = np.lib.stride_tricks.sliding_window_view(padded, (3, 3), axis=(2, 3))
        return np.einsum("nohwij,ocij->nchw", views, self.params["w"][:, :, ::-1, ::-1], optimize=True)


class Norm(Layer):
    """Batch normalization by channel, with running moments for prediction."""

    def __init__(self, channels: int, momentum: float = 0.1, eps: float = 1e-5):
        super().__init__()
        self.params = {"scale": np.ones(channels), "shift": np.zeros(channels)}
        self.mean, self.var, self.momentum, self.eps = np.zeros(channels), np.ones(channels), momentum, eps

    def forward(self, x, train):
        if train:
            mean, var = x.mean((0, 2, 3)), x.var((0, 2, 3))
            n = x.size / len(mean)
            self.mean += self.momentum * (mean - self.mean)
            self.var += self.momentum * (var * n / max(1.0, n - 1) - self.var)
        else:
            mean, var = self.mean, self.var
        self.train, self.inv = train, 1 / np.sqrt(var + self.eps)[:, None, None]
        self.unit = (x - mean[:, None, None]) * self.inv
        return self.unit * self.params["scale"][:, None, None] + self.params["shift"][:, None, None]

    def backward(self, g):
        self.grads = {"scale": (g * self.unit).sum((0, 2, 3)), "shift": g.sum((0, 2, 3))}
        g = g * self.params["scale"][:, None, None]
        if not self.train:
            return g * self.inv
        return self.inv * (g - g.mean((0, 2, 3), keepdims=True) - self.unit * (g * self.unit).mean((0, 2, 3), keepdims=True))


class Relu(Layer):
    def forward(self, x, train):
        self.on = x > 0
        return x * self.on

    def backward(self, g):
        return g * self.on


class MaxPool(Layer):
    """The largest of each 2 x 2 cells; of equal ones the first has the gradient."""

    def forward(self, x, train):
        n, c, h, w = x.shape
        cells = x.reshape(n, c, h // 2, 2, w // 2, 2).transpose(0, 1, 2, 4, 3, 5).reshape(n, c, h // 2, w // 2, 4)
        self.at, self.shape = cells.argmax(-1), x.shape
        return np.take_along_axis(cells, self.at[..., None], -1)[..., 0]

    def backward(self, g):
        n, c, h, w = self.shape
        cells = np.zeros((*g.shape, 4))
        np.put_along_axis(cells, self.at[..., None], g[..., None], -1)
        return cells.reshape(n, c, h // 2, w // 2, 2, 2).transpose(0, 1, 2, 4, 3, 5).reshape(self.shape)


def bilinear(size: int, to: int) -> np.ndarray:
    """The matrix (to, size) of linear interpolation with half-pixel centers."""
    at = np.clip((np.arange(to) + 0.5) * size / to - 0.5, 0, size - 1)
    low = np.minimum(at.astype(int), size - 1)
    high, part = np.minimum(low + 1, size - 1), at - low
    out = np.zeros((to, size))
    np.add.at(out, (np.arange(to), low), 1 - part)
    np.add.at(out, (np.arange(to), high), part)
    return out


class Upsample(Layer):
    """Twice the size, bilinear."""

    def forward(self, x, train):
        self.rows, self.cols = bilinear(x.shape[2], 2 * x.shape[2]), bilinear(x.shape[3], 2 * x.shape[3])
        return np.einsum("ah,nchw,bw->ncab", self.rows, x, self.cols, optimize=True)

    def backward(self, g):
        return np.einsum("ah,ncab,bw->nchw", self.rows, g, self.cols, optimize=True)


class MeanPool(Layer):
    """The mean of each channel, as rows."""

    def forward(self, x, train):
        self.shape = x.shape
        return x.mean((2, 3))

    def backward(self, g):
        return np.broadcast_to(g[:, :, None, None] / (self.shape[2] * self.shape[3]), self.shape)


class Dense(Layer):
    def __init__(self, rng: np.random.Generator, inputs: int, outputs: int):
        super().__init__()
        self.params = {"w": rng.normal(0, np.sqrt(2 / inputs), (inputs, outputs)), "b": np.zeros(outputs)}

    def forward(self, x, train):
        self.x = x
        return x @ self.params["w"] + self.params["b"]

    def backward(self, g):
        self.grads = {"w": self.x.T @ g, "b": g.sum(0)}
        return g @ self.params["w"].T


class Dropout(Layer):
    def __init__(self, rng: np.random.Generator, share: float):
        super().__init__()
        self.rng, self.share = rng, share

    def forward(self, x, train):
        self.keep = (self.rng.random(x.shape) >= self.share) / (1 - self.share) if train else np.ones(1)
        return x * self.keep

    def backward(self, g):
        return g * self.keep


class Net:
    """Layers in turn; marks name the places of layers whose output has a meaning."""

    def __init__(self, layers: list[Layer], **marks: int):
        self.layers, self.marks = layers, marks

    def forward(self, x: np.ndarray, train: bool = False, stop: int | None = None) -> np.ndarray:
        for layer in self.layers[:stop]:
            x = layer.forward(x, train)
        return x

    def backward(self, g: np.ndarray, down_to: int = 0) -> np.ndarray:
        for layer in reversed(self.layers[down_to:]):
            g = layer.backward(g)
        return g

    def at(self, x: np.ndarray, mark: str) -> np.ndarray:
        return self.forward(x, stop=self.marks[mark])


def classifier(seed: int, classes: int = 3, widths: tuple[int, ...] = (32, 64, 128), hidden: int = 64, dropout: float = 0.3) -> Net:
    """Three blocks of convolution, normalization and rectifier, halved after the first two; a hidden vector; logits."""
    rng, layers, before = np.random.default_rng(seed), [], 1
    for k, width in enumerate(widths):
        layers += [Conv(rng, before, width), Norm(width), Relu()] + ([MaxPool()] if k + 1 < len(widths) else [])
        before = width
    maps = len(layers)
    layers += [MeanPool(), Dense(rng, before, hidden), Relu()]
    return Net([*layers, Dropout(rng, dropout), Dense(rng, hidden, classes)], conv=maps - 2, maps=maps, hidden=len(layers))


def autoencoder(seed: int, widths: tuple[int, int, int] = (16, 32, 64)) -> Net:
    """Three convolutions down to a quarter of the size and three back up."""
    rng = np.random.default_rng(seed)
    a, b, c = widths
    down = [Conv(rng, 1, a), Relu(), MaxPool(), Conv(rng, a, b), Relu(), MaxPool(), Conv(rng, b, c), Relu()]
    up = [Conv(rng, c, b), Relu(), Upsample(), Conv(rng, b, a), Relu(), Upsample(), Conv(rng, a, 1)]
    return Net(down + up, code=len(down))


def cross_entropy(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss weighted by class, and its gradient."""
    z = logits - logits.max(1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    w = weight[y] / weight[y].sum()
    g = p.copy()
    g[np.arange(len(y)), y] -= 1
    return float(-(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum()), g * w[:, None]


def squared_error(out: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
    return float(((out - x) ** 2).mean()), 2 * (out - x) / out.size


class Adam:
    """Adam; decay is taken off the weights themselves."""

    def __init__(self, net: Net, rate: float, decay: float = 0.0):
        self.net, self.rate, self.decay, self.step, self.state = net, rate, decay, 0, {}

    def update(self) -> None:
        self.step += 1
        for k, layer in enumerate(self.net.layers):
            for name, g in layer.grads.items():
                m, v = self.state.get((k, name), (0.0, 0.0))
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                self.state[k, name] = m, v
                p = layer.params[name]
                p *= 1 - self.rate * self.decay
                p -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


def fit(net: Net, x: np.ndarray, loss: Callable, score: Callable[[Net], tuple], epochs: int, patience: int, batch: int = 32, rate: float = 1e-3, decay: float = 0.0, seed: int = 20260920) -> tuple[Net, int, list[dict]]:
    """The net of the epoch with the largest score (a tuple, compared in order; the earliest of equals), that epoch, and the history.

    loss(rows, outputs) gives the loss of some rows and its gradient. Training ends after `patience` epochs without a better score.
    """
    rng, adam = np.random.default_rng(seed), Adam(net, rate, decay)
    best, kept, at, history = None, net, 0, []
    for epoch in range(1, epochs + 1):
        total, order = 0.0, rng.permutation(len(x))
        for i in range(0, len(x), batch):
            rows = order[i : i + batch]
            value, g = loss(rows, net.forward(x[rows], True))
            net.backward(g)
            adam.update()
            total += value * len(rows)
        now = score(net)
        history.append({"epoch": epoch, "train_loss": total / max(1, len(x)), "score": now})
        if best is None or now > best:
            best, kept, at = now, copy.deepcopy(net), epoch
        elif epoch - at >= patience:
            break
    return kept, at, history


def macro_f1(y: np.ndarray, pred: np.ndarray, classes: int) -> float:
    out = []
    for c in range(classes):
        hit = ((y == c) & (pred == c)).sum()
        out.append(2 * hit / max(1, (y == c).sum() + (pred == c).sum()))
    return float(np.mean(out))


def fit_classifier(train: tuple, val: tuple, classes: int = 3, epochs: int = 120, patience: int = 15, seed: int = 20260920, **shape) -> tuple[Net, int, list[dict]]:
    """train and val: (images, labels, structure of each image). Classes are weighted to be equal; an epoch is judged by the macro F1 of validation
    structures, whose replicates' logits are averaged, then by their loss."""
    x, y, _ = train
    if len(x) > MOST_IMAGES:
        raise ValueError(f"over {MOST_IMAGES} images")
    size = np.bincount(y, minlength=classes)
    weight = len(y) / (classes * np.maximum(1, size))

    def score(net: Net) -> tuple[float, float]:
        _, of = np.unique(val[2], return_inverse=True)
        logits = predict(net, val[0])
        mean = np.stack([np.bincount(of, logits[:, c]) / np.bincount(of) for c in range(classes)], axis=1)
        true = np.zeros(len(mean), dtype=int)
        true[of] = val[1]
        return macro_f1(true, mean.argmax(1), classes), -cross_entropy(mean, true, weight)[0]

    net = classifier(seed, classes, **shape)
    return fit(net, x, lambda rows, out: cross_entropy(out, y[rows], weight), score, epochs, patience, decay=1e-2, seed=seed)


def fit_autoencoder(train: np.ndarray, val: np.ndarray, epochs: int = 60, patience: int = 10, seed: int = 20260920, **shape) -> tuple[Net, int, list[dict]]:
    """The autoencoder with the least mean squared error on the validation images."""
    if len(train) > MOST_IMAGES:
        raise ValueError(f"over {MOST_IMAGES} images")
    score = lambda net: (-float(((predict(net, val) - val) ** 2).mean()),)
    return fit(autoencoder(seed, **shape), train, lambda rows, out: squared_error(out, train[rows]), score, epochs, patience, seed=seed)


def predict(net: Net, x: np.ndarray, mark: str | None = None, batch: int = 64) -> np.ndarray:
    """Outputs, or those at a mark, of all images in batches."""
    parts = [net.forward(x[i : i + batch], stop=net.marks[mark] if mark else None) for i in range(0, max(1, len(x)), batch)]
    return np.concatenate(parts)


def grad_cam(net: Net, image: np.ndarray, target: int | None = None) -> np.ndarray:
    """Where in an image (channels, height, width) the last convolution speaks for a class (the predicted one by default), from 0 to 1."""
    logits = net.forward(image[None])
    maps = net.at(image[None], "conv")
    net.forward(image[None])
    g = np.zeros_like(logits)
    g[0, int(logits[0].argmax()) if target is None else target] = 1
    slope = net.backward(g, net.marks["conv"])
    cam = np.maximum(0, (slope.mean((2, 3))[0][:, None, None] * maps[0]).sum(0))
    cam = bilinear(cam.shape[0], image.shape[1]) @ cam @ bilinear(cam.shape[1], image.shape[2]).T
    span = cam.max() - cam.min()
    return (cam - cam.min()) / span if span > 0 else np.zeros_like(cam)


def images(cells: DataFrame, keys: list[str], n: int, value: str = "value") -> DataFrame:
    """(keys, image): the dense n x n matrix of each window's cells (i <= j are stored), row by row, zeros in place."""
    both = cells.select(*keys, "i", "j", F.col(value).alias("_v")).unionByName(cells.where("i <> j").select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), F.col(value).alias("_v")))
    stored = both.groupBy(*keys, (F.col("i") * n + F.col("j")).cast("int").alias("_at")).agg(F.max("_v").cast("double").alias("_v"))
    filled = lambda m: F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda k: F.coalesce(F.element_at(m, k), F.lit(0.0)))
    return stored.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_at", "_v"))).alias("_m")).select(*keys, filled(F.col("_m")).alias("image"))


def pixels_of(pdf: pd.DataFrame, n: int) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float).reshape(1, n, n) for v in pdf["image"]]) if len(pdf) else np.zeros((0, 1, n, n))


def apply(df: DataFrame, n: int, run: Callable[[np.ndarray], dict[str, list]], schema: str, keys: list[str]) -> DataFrame:
    """(keys and what `run` makes of the images) for every row of df(keys, image), in Arrow batches of bounded size."""

    def batches(parts):
        for pdf in parts:
            for i in range(0, len(pdf), 64):
                own = pdf.iloc[i : i + 64]
                yield own[keys].reset_index(drop=True).assign(**run(pixels_of(own, n)))

    return df.select(*keys, "image").mapInPandas(batches, schema)
