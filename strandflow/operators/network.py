"""Acoustic network for inference: strided convolutions, bidirectional GRUs, per-step classes.

NumPy kernels in Arrow tasks; weights are a few MB and broadcast. There are no trained
weights, so `random_weights` gives seeded ones and `load_weights` reads an `.npz` file.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NetConfig:
    conv_channels: tuple = (32, 64, 128, 256)
    kernels: tuple = (5, 5, 5, 5)
    strides: tuple = (2, 2, 2, 1)
    gru_hidden: int = 256
    gru_layers: int = 3
    classes: int = 5

    def __post_init__(self):
        if not len(self.conv_channels) == len(self.kernels) == len(self.strides):
            raise ValueError("channels, kernels and strides differ in length")

    @classmethod
    def from_dict(cls, values: dict) -> NetConfig:
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})

    @property
    def total_stride(self) -> int:
        return math.prod(self.strides)

    def output_length(self, n: int) -> int:
        for k, s in zip(self.kernels, self.strides):
            n = (n + 2 * ((k - 1) // 2) - k) // s + 1
        return n


def output_length(n: Column, config: NetConfig = NetConfig()) -> Column:
    for k, s in zip(config.kernels, config.strides):
        n = F.floor((n + (2 * ((k - 1) // 2) - k)) / s).cast("int") + 1
    return n


def shapes(config: NetConfig) -> dict[str, tuple]:
    out, width = {}, 1
    for i, (c, k) in enumerate(zip(config.conv_channels, config.kernels)):
        out |= {f"conv{i}.w": (c, width, k), f"conv{i}.scale": (c,), f"conv{i}.shift": (c,)}
        width = c
    h = config.gru_hidden
    for i in range(config.gru_layers):
        for d in ("f", "b"):
            out |= {f"gru{i}{d}.wi": (3 * h, width), f"gru{i}{d}.wh": (3 * h, h), f"gru{i}{d}.bi": (3 * h,), f"gru{i}{d}.bh": (3 * h,)}
        out |= {f"norm{i}.scale": (2 * h,), f"norm{i}.shift": (2 * h,)}
        width = 2 * h
    return out | {"out.w": (config.classes, width), "out.b": (config.classes,)}


def count_parameters(config: NetConfig = NetConfig()) -> int:
    return sum(math.prod(s) for s in shapes(config).values())


def random_weights(config: NetConfig = NetConfig(), seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {}
    for name, shape in shapes(config).items():
        kind = name.split(".")[1]
        if kind == "scale":
            out[name] = np.ones(shape, np.float32)
        elif kind in ("shift", "bi", "bh", "b"):
            out[name] = np.zeros(shape, np.float32)
        else:
            out[name] = (rng.standard_normal(shape) * math.sqrt(2 / math.prod(shape[1:]))).astype(np.float32)
    return out


def load_weights(path: str) -> dict[str, np.ndarray]:
    with np.load(path) as found:
        return {k: found[k] for k in found.files}


def _erf(x: np.ndarray) -> np.ndarray:
    """Error function within 2e-7 (rational approximation)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def _gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + _erf(x / math.sqrt(2)))


def _conv(x: np.ndarray, w: np.ndarray, stride: int) -> np.ndarray:
    """(signals, channels, samples) of the same."""
    pad = (w.shape[2] - 1) // 2
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), (pad, pad))), w.shape[2], axis=2)[:, :, ::stride]
    return np.einsum("bctk,ock->bot", windows, w, optimize=True)


def conv_block(x: np.ndarray, w: dict[str, np.ndarray], name: str, stride: int = 1) -> np.ndarray:
    """Convolution, normalisation by fixed statistics, GELU."""
    return _gelu(_conv(x, w[f"{name}.w"], stride) * (w[f"{name}.scale"] / math.sqrt(1 + 1e-5))[:, None] + w[f"{name}.shift"][:, None])


def residual_block(x: np.ndarray, w: dict[str, np.ndarray], name: str) -> np.ndarray:
    """Two convolution blocks of one width, added to their input."""
    return x + conv_block(conv_block(x, w, f"{name}a"), w, f"{name}b")


def _gru(x: np.ndarray, w: dict[str, np.ndarray], name: str, hidden: int, active: np.ndarray) -> np.ndarray:
    """(entries, hidden) of packed (entries, width): step t is the next `active[t]` entries, of the first so many signals.

    Gates are in the order reset, update, new.
    """
    inputs = x @ w[f"{name}.wi"].T + w[f"{name}.bi"]
    wh, bh = w[f"{name}.wh"].T, w[f"{name}.bh"]
    h, out = np.zeros((active[0] if len(active) else 0, hidden), x.dtype), np.empty((len(x), hidden), x.dtype)
    at = 0
    for n in active:
        h = h[:n]  # the signals that have ended are the last ones
        g, i = h @ wh + bh, inputs[at : at + n]
        both = 0.5 + 0.5 * np.tanh(0.5 * (i[:, : 2 * hidden] + g[:, : 2 * hidden]))  # the logistic function, which cannot overflow so
        new = np.tanh(i[:, 2 * hidden :] + both[:, :hidden] * g[:, 2 * hidden :])
        h = (1 - both[:, hidden:]) * new + both[:, hidden:] * h
        out[at : at + n] = h
        at += n
    return out


def forward_packed(signals: list[np.ndarray], w: dict[str, np.ndarray], config: NetConfig = NetConfig()) -> list[np.ndarray]:
    """(steps, classes) log-probabilities of each signal, of any lengths, in one pass.

    Convolutions run over signals padded to the longest; what lies beyond a signal's end is set to 0 after each, as the
    padding of the signal alone would be. Then only steps that exist are kept, ordered by step and, within a step, by
    falling length: a recurrent step works on the signals that are still going on. The backward direction reads each
    signal's entries from its own end.
    """
    empty = np.zeros((0, config.classes), np.float32)
    order = [i for i in sorted(range(len(signals)), key=lambda i: -len(signals[i])) if len(signals[i])]
    if not order:
        return [empty] * len(signals)
    lengths = np.array([len(signals[i]) for i in order])
    x = np.zeros((len(order), 1, lengths[0]), np.float32)
    for r, i in enumerate(order):
        x[r, 0, : lengths[r]] = signals[i]
    for i, (k, s) in enumerate(zip(config.kernels, config.strides)):
        x = conv_block(x, w, f"conv{i}", s)
        lengths = np.maximum((lengths + 2 * ((k - 1) // 2) - k) // s + 1, 0)
        x *= np.arange(x.shape[2]) < lengths[:, None, None]
    steps = np.arange(x.shape[2])
    there = steps[:, None] < lengths[None, :]
    step, row = np.nonzero(there)
    active = there.sum(1)
    active = active[active > 0]
    first = np.concatenate([[0], np.cumsum(active)])
    mirrored = first[lengths[row] - 1 - step] + row
    x = x[row, :, step]
    for i in range(config.gru_layers):
        back = np.empty((len(x), config.gru_hidden), x.dtype)
        back[mirrored] = _gru(x[mirrored], w, f"gru{i}b", config.gru_hidden, active)
        x = np.concatenate([_gru(x, w, f"gru{i}f", config.gru_hidden, active), back], 1)
        x = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5) * w[f"norm{i}.scale"] + w[f"norm{i}.shift"]
    z = x @ w["out.w"].T + w["out.b"]
    z = z - z.max(1, keepdims=True)
    z = z - np.log(np.exp(z).sum(1, keepdims=True))
    out = [empty] * len(signals)
    for r, i in enumerate(order):
        out[i] = z[first[: lengths[r]] + r]
    return out


def forward(signals: np.ndarray, w: dict[str, np.ndarray], config: NetConfig = NetConfig()) -> np.ndarray:
    """(signals, steps, classes) log-probabilities of signals of one length; (steps, classes) of one signal."""
    x = np.asarray(signals, np.float32)
    if x.ndim == 1:
        return forward_packed([x], w, config)[0]
    if not x.size:
        return np.zeros((len(x), 0, config.classes), np.float32)
    return np.stack(forward_packed(list(x), w, config))


#: Samples, padding included, of the signals that go through the network together.
BATCH_SAMPLES = 1 << 18


def _log_probs(signals: list[np.ndarray], w: dict[str, np.ndarray], config: NetConfig) -> list[list]:
    """Log-probabilities of each signal; neighbours in length run together."""
    order = sorted(range(len(signals)), key=lambda i: -len(signals[i]))
    out: list = [None] * len(signals)
    at = 0
    while at < len(order):
        step = max(BATCH_SAMPLES // max(len(signals[order[at]]), 1), 1)
        some = order[at : at + step]
        for i, lp in zip(some, forward_packed([signals[i] for i in some], w, config)):
            out[i] = lp.astype(float).tolist()
        at += step
    return out


def infer(signals: DataFrame, weights: dict[str, np.ndarray], config: NetConfig = NetConfig()) -> DataFrame:
    """(read_id, lp): log-probabilities of each signal; empty for an empty or null one."""
    shared = signals.sparkSession.sparkContext.broadcast(weights)
    kind = signals.schema["read_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lp = _log_probs([np.array(s.as_py() or [], np.float32) for s in batch.column("signal")], shared.value, config)
            yield pa.RecordBatch.from_arrays([batch.column("read_id"), pa.array(lp, pa.list_(pa.list_(pa.float64())))], names=["read_id", "lp"])

    return signals.select("read_id", "signal").mapInArrow(run, f"read_id {kind}, lp array<array<double>>")
