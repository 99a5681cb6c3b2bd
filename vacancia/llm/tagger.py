"""A character-level bidirectional LSTM with CRF transitions, in numpy: training by Adam, decoding by Viterbi.

Rows are padded at their ends. A mask tells the time steps that count; both directions start anew where it ends, and paths
end there, so padding changes nothing.
"""

from __future__ import annotations

import io

import numpy as np

#: Characters are themselves up to 126; beyond that letters, other marks. 0 pads.
ALPHABET = 129


def char_ids(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(codes < 127, np.maximum(codes, 1), 127 + (codes < 0x2000))


def start(labels: int, embed: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    scaled = lambda *s: rng.normal(0, 1 / np.sqrt(s[-2]), s)
    p = {"embed": rng.normal(0, 0.3, (ALPHABET, embed)), "wx": scaled(2, embed, 4 * hidden), "wh": scaled(2, hidden, 4 * hidden), "b": np.zeros((2, 1, 4 * hidden)), "wo": scaled(2 * hidden, labels), "bo": np.zeros(labels), "trans": np.zeros((labels, labels)), "first": np.zeros(labels)}
    p["b"][:, :, hidden : 2 * hidden] = 1.0  # remember by default
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def emissions(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Scores (n, time, label) of x (n, time), and what the way back needs. mask: time steps that count, from the first."""
    n, time = x.shape
    hidden = p["wh"].shape[1]
    both = np.stack([x, x[:, ::-1]])
    inputs = p["embed"][both]
    ahead = inputs @ p["wx"][:, None] + p["b"][:, None]
    h, c = np.zeros((2, n, hidden)), np.zeros((2, n, hidden))
    kept, out = [], np.zeros((2, n, time, hidden))
    counts = np.stack([mask, mask[:, ::-1]])[..., None].astype(ahead.dtype)
    for t in range(time):
        z = ahead[:, :, t] + h @ p["wh"]
        s = _sigmoid(z)
        i, f, o, g = s[..., :hidden], s[..., hidden : 2 * hidden], s[..., 2 * hidden : 3 * hidden], np.tanh(z[..., 3 * hidden :])
        before, h_before = c, h
        c = (f * c + i * g) * counts[:, :, t]
        tc = np.tanh(c)
        h = o * tc
        out[:, :, t] = h
        kept.append((i, f, o, g, before, tc, h_before))
    features = np.concatenate([out[0], out[1][:, ::-1]], axis=-1)
    return features @ p["wo"] + p["bo"], (both, inputs, kept, features, counts)


def _back(p: dict[str, np.ndarray], kept: tuple, d: np.ndarray) -> dict[str, np.ndarray]:
    both, inputs, steps, features, counts = kept
    n, time, labels = d.shape
    hidden = p["wh"].shape[1]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["wo"], g["bo"] = features.reshape(-1, 2 * hidden).T @ d.reshape(-1, labels), d.sum(axis=(0, 1))
    df = d @ p["wo"].T
    dout = np.stack([df[..., :hidden], df[:, ::-1, hidden:]])
    dz = np.zeros((2, n, time, 4 * hidden))
    dh, dc = np.zeros((2, n, hidden)), np.zeros((2, n, hidden))
    for t in reversed(range(time)):
        i, f, o, gg, before, tc, h_before = steps[t]
        dh = dh + dout[:, :, t]
        dc = (dc + dh * o * (1 - tc * tc)) * counts[:, :, t]
        z = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=-1)
        dz[:, :, t] = z
        g["wh"] += h_before.transpose(0, 2, 1) @ z
        dh, dc = z @ p["wh"].transpose(0, 2, 1), dc * f
    flat = dz.reshape(2, -1, 4 * hidden)
    g["wx"] = inputs.reshape(2, n * time, -1).transpose(0, 2, 1) @ flat
    g["b"] = flat.sum(axis=1, keepdims=True)
    np.add.at(g["embed"], both.reshape(-1), (flat @ p["wx"].transpose(0, 2, 1)).reshape(-1, inputs.shape[-1]))
    return g


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)


def loss(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Negative log likelihood of the label sequences under the CRF, and its gradients. mask: time steps that count, from the first."""
    e, kept = emissions(p, x, mask)
    n, time, labels = e.shape
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    alpha[:, 0] = p["first"] + e[:, 0]
    for t in range(1, time):
        a = _logsum(alpha[:, t - 1, :, None] + p["trans"], 1) + e[:, t]
        alpha[:, t] = np.where(mask[:, t, None], a, alpha[:, t - 1])
    for t in reversed(range(time - 1)):
        b = _logsum(p["trans"] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(mask[:, t + 1, None], b, 0.0)
    z = _logsum(alpha[:, -1], 1)
    d = np.where(mask[..., None], np.exp(alpha + beta - z[:, None, None]), 0)
    rows, times = np.nonzero(mask)
    gold = np.zeros_like(d)
    gold[rows, times, y[rows, times]] = 1
    pairs = alpha[:, :-1, :, None] + p["trans"] + (e + beta)[:, 1:, None, :] - z[:, None, None, None]
    both = mask[:, 1:]
    expected = np.where(both[..., None, None], np.exp(np.minimum(pairs, 0)), 0).sum(axis=(0, 1))
    seen = np.zeros_like(expected)
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    score = (e * gold).sum() + (p["trans"] * seen).sum() + p["first"][y[:, 0]].sum()
    g = _back(p, kept, (d - gold) / n)
    g["trans"], g["first"] = (expected - seen) / n, (d - gold)[:, 0].sum(axis=0) / n
    return float((z.sum() - score) / n), g


def fit(x: np.ndarray, y: np.ndarray, mask: np.ndarray, labels: int, embed: int = 12, hidden: int = 16, epochs: int = 8, batch: int = 48, rate: float = 0.012, seed: int = 0) -> dict[str, np.ndarray]:
    p, rng = start(labels, embed, hidden, seed), np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            own = order[at : at + batch]
            _, g = loss(p, x[own], y[own], mask[own])
            step += 1
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            for k in p:
                a = g[k] * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.999 * v[k] + 0.001 * a * a
                p[k] -= rate * (0.5 ** (epoch / 4)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p


def decode(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The best label sequence of each row, as far as its mask goes."""
    e, _ = emissions(p, x, mask)
    n, time, labels = e.shape
    best, back = p["first"] + e[:, 0], np.zeros((n, time, labels), np.int64)
    for t in range(1, time):
        s, goes_on = best[:, :, None] + p["trans"], mask[:, t, None]
        back[:, t] = np.where(goes_on, s.argmax(axis=1), np.arange(labels))
        best = np.where(goes_on, s.max(axis=1) + e[:, t], best)
    out = np.zeros((n, time), np.int64)
    out[:, -1] = best.argmax(axis=1)
    for t in reversed(range(time - 1)):
        out[:, t] = back[np.arange(n), t + 1, out[:, t + 1]]
    return out


def dump(p: dict[str, np.ndarray]) -> bytes:
    to = io.BytesIO()
    np.savez(to, **p)
    return to.getvalue()


def load(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k].astype(np.float32) for k in z.files}
