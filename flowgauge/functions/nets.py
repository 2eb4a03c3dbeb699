"""Training arithmetic for small tanh networks, used inside Spark tasks.

Weights are flat: output row first, then one row per hidden neuron, bias last in
each row (the layout :func:`flowgauge.functions.scalars.tanh_net` scores).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def size(inputs: int, hidden: int) -> int:
    return hidden + 1 + hidden * (inputs + 1)


def initial_weights(inputs: int, hidden: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).uniform(-1.0, 1.0, size(inputs, hidden))


def _split(w: np.ndarray, inputs: int, hidden: int):
    inner = w[hidden + 1 :].reshape(hidden, inputs + 1)
    return w[:hidden], w[hidden], inner[:, :-1], inner[:, -1]


def forward(w: np.ndarray, x: np.ndarray, hidden: int):
    """Hidden activations and outputs for rows ``x``."""
    out, out_bias, inner, inner_bias = _split(w, x.shape[1], hidden)
    h = np.tanh(x @ inner.T + inner_bias)
    return h, np.tanh(h @ out + out_bias)


def jacobian(w: np.ndarray, x: np.ndarray, hidden: int):
    """Outputs and their derivative by every weight, one row per input row."""
    out = _split(w, x.shape[1], hidden)[0]
    h, f = forward(w, x, hidden)
    df = 1.0 - f * f
    dh = df[:, None] * out * (1.0 - h * h)
    inner = np.concatenate([dh[:, :, None] * x[:, None, :], dh[:, :, None]], axis=2)
    return f, np.hstack([df[:, None] * h, df[:, None], inner.reshape(len(x), -1)])


def normal_sums(
    w: np.ndarray, x: np.ndarray, n: np.ndarray, sum_y: np.ndarray, sum_yy: np.ndarray, hidden: int
) -> np.ndarray:
    """Additive sums of a Gauss-Newton step over rows grouped by equal input: J'J, J'r, squared error.

    ``n``, ``sum_y`` and ``sum_yy`` are the count and sums of the targets that share an input.
    """
    f, jac = jacobian(w, x, hidden)
    error = (sum_yy - 2.0 * f * sum_y + n * f * f).sum()
    return np.concatenate([(jac.T @ (jac * n[:, None])).ravel(), jac.T @ (n * f - sum_y), [error]])


def gradient_sums(
    w: np.ndarray, x: np.ndarray, n: np.ndarray, sum_y: np.ndarray, sum_yy: np.ndarray, hidden: int
) -> np.ndarray:
    """Additive sums of a gradient step, see :func:`normal_sums`: J'r and the squared error."""
    f, jac = jacobian(w, x, hidden)
    return np.append(jac.T @ (n * f - sum_y), (sum_yy - 2.0 * f * sum_y + n * f * f).sum())


def mean_start(w: np.ndarray, mean: float, hidden: int) -> np.ndarray:
    """The network that always gives the mean; hidden neurons as they are."""
    w = w.copy()
    w[:hidden], w[hidden] = 0.0, np.arctanh(np.clip(mean, -0.999999, 0.999999))
    return w


def line_start(
    w: np.ndarray, mean: float, slope: np.ndarray, centre: np.ndarray, hidden: int, span: tuple[float, float] | None = None
) -> np.ndarray:
    """The network that follows a line through the mean, on the straight part of its first neuron.

    The output bends it the more the farther the line goes from the mean; with the ``span`` of
    the line's distances from it, the other neurons bend it back.
    """
    w = mean_start(w, mean, hidden)
    flat = np.clip(mean, -0.999999, 0.999999)
    steep = slope / (1.0 - flat * flat)
    reach = np.abs(steep).sum()
    if reach > 0:
        small = 0.05 / (2.0 * reach)
        first = np.append(steep * small, -(steep * small) @ centre)
        w[0], w[hidden + 1 : hidden + 1 + len(first)] = 1.0 / small, first
        if span is not None:
            w = _unbent(w, flat, slope, centre, hidden, span)
    return w


def _unbent(w: np.ndarray, flat: float, slope: np.ndarray, centre: np.ndarray, hidden: int, span: tuple[float, float]) -> np.ndarray:
    """The same network with all neurons along the line, fitted to points of the line itself."""
    low, high = max(span[0], -0.999999 - flat), min(span[1], 0.999999 - flat)
    reach = max(-low, high)
    if not reach > 0:
        return w
    t = np.linspace(low, high, 65)
    own = np.concatenate([w[: hidden + 1], np.random.default_rng(1).uniform(-1.0, 1.0, 2 * hidden)])
    own[0], own[hidden + 1 : hidden + 3] = 40.0 * reach / (1.0 - flat * flat), (0.025, 0.0)
    fit = Newton(own, np.ones(1), 1e-10 * reach * reach, len(t))
    y = flat + t
    rows = ((t / reach)[:, None], np.ones(len(t)), y, y * y)
    fit.accept(own, fit.sums(own, *rows, hidden))
    while not fit.done and fit.epochs < 100:
        trials = fit.trials()
        fit.choose(trials, [fit.sums(trial, *rows, hidden) for trial in trials])
    along = fit.w[hidden + 1 :].reshape(hidden, 2)
    steep = along[:, :1] * (slope / reach)
    return np.concatenate([fit.w[: hidden + 1], np.hstack([steep, along[:, 1:] - steep @ centre[:, None]]).ravel()])


@dataclass
class Search:
    """The search for one network's weights, from sums that others have added up."""

    w: np.ndarray
    scale: np.ndarray
    limit: float
    rows: float
    sse: float = np.inf
    epochs: int = 0
    centre: np.ndarray | float = 0.0

    @property
    def mse(self) -> float:
        return max(0.0, float(self.sse / self.rows))

    def scaled_back(self, inputs: int, hidden: int) -> list[float]:
        w = self.w.copy()
        inner = w[hidden + 1 :].reshape(hidden, inputs + 1)
        inner[:, :-1] /= self.scale
        inner[:, -1] -= (inner[:, :-1] * self.centre).sum(axis=1)
        return w.tolist()


@dataclass
class Propagation(Search):
    """Resilient propagation: each weight has a step of its own, which the sign of its gradient changes.

    A step grows while the sign stays and halves where it turns; there the weight goes back if
    the error rose. The best weights met are the result.
    """

    sums = staticmethod(gradient_sums)

    def accept(self, w: np.ndarray, found: np.ndarray) -> None:
        self.w = self.at = w
        self.gradient, self.sse = found[:-1], found[-1]
        self.error = self.sse
        self.step = np.maximum(0.02 * np.abs(w), 1e-6)
        self.back = np.zeros_like(w)
        self.turned = np.zeros(len(w), dtype=bool)

    @property
    def done(self) -> bool:
        return self.mse <= self.limit or bool((self.step <= 1e-12 * np.maximum(1.0, np.abs(self.at))).all())

    def trials(self) -> list[np.ndarray]:
        self.move = np.where(self.turned, self.back, -np.sign(self.gradient) * self.step)
        return [self.at + self.move]

    def choose(self, trials: list[np.ndarray], found: list[np.ndarray]) -> None:
        self.epochs += 1
        gradient, error = found[0][:-1], found[0][-1]
        same = gradient * np.where(self.turned, 0.0, self.gradient)
        self.step = np.clip(self.step * np.where(same > 0, 1.2, np.where(same < 0, 0.5, 1.0)), 0.0, 50.0)
        self.turned = same < 0
        self.back = -self.move if error > self.error else np.zeros_like(self.move)
        self.at, self.gradient, self.error = trials[0], gradient, error
        if error < self.sse:
            self.w, self.sse = trials[0], error


@dataclass
class Newton(Search):
    """Damped Gauss-Newton steps; one that does not lower the error is not taken."""

    damping: float = 1e-2

    sums = staticmethod(normal_sums)

    def accept(self, w: np.ndarray, found: np.ndarray) -> None:
        k = len(w)
        self.w, self.jtj, self.jtr, self.sse = w, found[: k * k].reshape(k, k), found[k * k : k * k + k], found[-1]

    @property
    def done(self) -> bool:
        # At this damping a step no longer changes the weights.
        return self.mse <= self.limit or self.damping > 1e16

    def trials(self) -> list[np.ndarray]:
        curve = np.diag(np.diag(self.jtj) + 1e-9 * max(1e-300, np.diag(self.jtj).max()))
        return [
            self.w - np.linalg.lstsq(self.jtj + d * curve, self.jtr, rcond=None)[0]
            for d in (self.damping / 10, self.damping, self.damping * 10)
        ]

    def choose(self, trials: list[np.ndarray], found: list) -> None:
        self.epochs += 1
        best = min(range(len(found)), key=lambda i: found[i][-1])
        if found[best][-1] < self.sse:
            self.accept(trials[best], found[best])
            self.damping = max(1e-12, self.damping * (0.1, 1.0, 10.0)[best])
        else:
            self.damping *= 1000  # the three lengths tried reach from a tenth to ten times


METHODS = {"rprop": Propagation, "newton": Newton}
