"""A small character-level bidirectional LSTM with CRF transitions in numpy, for windows of one length.

Inputs are character classes, so the first layer is a table look-up. Tags are O and, for each kind, B and I. The CRF may
not enter an I but from its own B or I. Sizes are few thousand numbers, whatever the corpus has.
"""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # O, B and I of each kind
HIDDEN = 16
BANNED = -1e4

# Classes: 0 padding, 1 digit, 2 a-z, 3 A-Z, 4 other letters and signs, then one for each of these characters.
SINGLE = " \n\t.@-+()_%:=\"/,;'[]#*|&<>"
CLASSES = 5 + len(SINGLE)
_CLASS = np.full(128, 4, dtype=np.uint8)
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91] = 1, 2, 3
for _k, _c in enumerate(SINGLE):
    _CLASS[ord(_c)] = 5 + _k


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.full(len(points), 4, dtype=np.uint8)
    low = points < 128
    out[low] = _CLASS[points[low]]
    return out


def rules() -> np.ndarray:
    """0 where a tag may follow another, BANNED where it may not."""
    out = np.zeros((TAGS, TAGS), dtype=np.float32)
    for i in range(2, TAGS, 2):
        out[:, i] = BANNED
        out[i - 1, i] = out[i, i] = 0
    return out


def first_rules() -> np.ndarray:
    out = np.zeros(TAGS, dtype=np.float32)
    out[2::2] = BANNED
    return out


def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    f = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
    out = {}
    for d in "fb":
        out["x" + d], out["h" + d] = f(CLASSES, 4 * HIDDEN, k=0.3), f(HIDDEN, 4 * HIDDEN, k=0.25)
        out["x" + d][:, HIDDEN : 2 * HIDDEN] += 0.7  # remember at first
    return out | {"out": f(2 * HIDDEN, TAGS, k=0.2), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (length, batch, HIDDEN) of one direction, and what the way back needs."""
    length, batch = x.shape
    h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    states, saved = np.empty((length, batch, HIDDEN), np.float32), []
    for t in range(length):
        z = wx[x[t]] + h @ wh
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            saved.append((h, before, i, f, o, g, tc))
        h = o * tc
        states[t] = h
    return states, saved


def _back(x: np.ndarray, wh: np.ndarray, saved: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length, batch = x.shape
    dx, dwh = np.zeros((CLASSES, 4 * HIDDEN), np.float32), np.zeros_like(wh)
    dh, dc = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    for t in range(length - 1, -1, -1):
        h, before, i, f, o, g, tc = saved[t]
        dh = dh + d_states[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        np.add.at(dx, x[t], dz)
        dwh += h.T @ dz
        dh, dc = dz @ wh.T, dc * f
    return dx, dwh


def _states(x: np.ndarray, wx: np.ndarray, wh: np.ndarray) -> np.ndarray:
    """The hidden states of `_run`, as (length, HIDDEN, batch): rows of one gate lie together, and one tanh serves all gates."""
    length, batch = x.shape
    half = np.full((4 * HIDDEN, 1), 0.5, np.float32)
    half[3 * HIDDEN :] = 1
    wx, wh = np.ascontiguousarray(wx.T) * half, np.ascontiguousarray(wh.T) * half
    states = np.empty((length, HIDDEN, batch), np.float32)
    h, c, s = (np.zeros((HIDDEN, batch), np.float32) for _ in range(3))
    z, y = (np.empty((4 * HIDDEN, batch), np.float32) for _ in range(2))
    gates, (i, f, o, g) = z[: 3 * HIDDEN], np.split(z, 4)
    for t in range(length):
        np.take(wx, x[t], axis=1, out=z, mode="clip")
        z += np.matmul(wh, h, out=y)
        np.tanh(z, out=z)
        gates *= 0.5
        gates += 0.5
        c *= f
        c += np.multiply(i, g, out=s)
        h = np.multiply(o, np.tanh(c, out=s), out=states[t])
    return states


def emissions(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Tag scores (length, TAGS, batch) of windows x (length, batch)."""
    x, out = x.astype(np.intp), np.ascontiguousarray(model["out"].T)
    ahead, behind = _states(x, model["xf"], model["hf"]), _states(x[::-1], model["xb"], model["hb"])
    return out[:, :HIDDEN] @ ahead + out[:, HIDDEN:] @ behind[::-1] + model["bias"][:, None]


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def forward_backward(e: np.ndarray, trans: np.ndarray, start: np.ndarray, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """alpha, beta (length, batch, tags) and log normaliser. live (length, batch): False past a sequence's end."""
    length = len(e)
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + start
    for t in range(1, length):
        step = _logsum(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        alpha[t] = step if live is None else np.where(live[t][:, None], step, alpha[t - 1])
    for t in range(length - 2, -1, -1):
        step = _logsum(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        beta[t] = step if live is None else np.where(live[t + 1][:, None], step, 0)
    return alpha, beta, _logsum(alpha[-1], 1)


def gradients(model: dict[str, np.ndarray], x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood of windows (length, batch) and its slopes."""
    length, batch = x.shape
    ahead, kept_f = _run(x, model["xf"], model["hf"], True)
    behind, kept_b = _run(x[::-1], model["xb"], model["hb"], True)
    both = np.concatenate([ahead, behind[::-1]], axis=2)
    e = both @ model["out"] + model["bias"]
    trans, start = model["trans"] + rules(), model["start"] + first_rules()
    alpha, beta, norm = forward_backward(e, trans, start)
    de = np.exp(alpha + beta - norm[None, :, None])
    cols = np.arange(batch)
    score = start[tags[0]] + e[0, cols, tags[0]]
    d_trans, d_start = np.zeros_like(trans), de[0].sum(axis=0)
    for t in range(1, length):
        pair = np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - norm[:, None, None])
        d_trans += pair.sum(axis=0)
        np.add.at(d_trans, (tags[t - 1], tags[t]), -1)
        score = score + trans[tags[t - 1], tags[t]] + e[t, cols, tags[t]]
    np.add.at(d_start, tags[0], -1)
    de[np.arange(length)[:, None], cols[None, :], tags] -= 1
    d_both = de @ model["out"].T
    xf, hf = _back(x, model["hf"], kept_f, d_both[:, :, :HIDDEN])
    xb, hb = _back(x[::-1], model["hb"], kept_b, d_both[::-1, :, HIDDEN:])
    flat = both.reshape(-1, 2 * HIDDEN)
    out = {"xf": xf, "hf": hf, "xb": xb, "hb": hb, "out": flat.T @ de.reshape(-1, TAGS), "bias": de.sum(axis=(0, 1)), "trans": d_trans, "start": d_start}
    return float((norm - score).mean()), {k: v / batch for k, v in out.items()}


def train(x: np.ndarray, tags: np.ndarray, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam over windows (number, length) of classes and tags; the same rows give the same model."""
    model, r = new_model(seed), np.random.default_rng(seed)
    mean, var = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    for step in range(1, steps + 1):
        rows = r.integers(0, len(x), min(batch, len(x)))
        _, slope = gradients(model, x[rows].T, tags[rows].T)
        size = np.sqrt(sum(float((g * g).sum()) for g in slope.values()))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in slope.items():
            g = g * min(1.0, 5 / (size + 1e-9))
            mean[k] = 0.9 * mean[k] + 0.1 * g
            var[k] = 0.99 * var[k] + 0.01 * g * g
            model[k] = (model[k] - now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def begin_chances(e: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """The greatest chance of any B at each step (length, batch) of scores e (length, TAGS, batch): the marginals of `decode` with
    chances in place of their logarithms, so that a step is one small product for the whole batch."""
    length, _, batch = e.shape
    follow, start = np.exp(model["trans"] + rules()).astype(np.float32), np.exp(model["start"] + first_rules()).astype(np.float32)
    p = np.exp(np.maximum(e - e.max(axis=1, keepdims=True), -60))
    ahead, back = np.empty_like(p), follow.T.copy()
    now = p[0] * start[:, None]
    for t in range(length):
        if t:
            now = np.matmul(back, now, out=ahead[t])
            now *= p[t]
        now = np.divide(now, now.sum(axis=0), out=ahead[t])
    out, after = np.empty((length, batch), np.float32), np.ones((TAGS, batch), np.float32)
    for t in range(length - 1, -1, -1):
        both = ahead[t] * after
        out[t] = both[1::2].max(axis=0) / both.sum(axis=0)
        after = follow @ (after * p[t])
        after /= after.max(axis=0)
    return out


def decode(e: np.ndarray, model: dict[str, np.ndarray], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tags and their marginal chances (length, batch); steps past a sequence's own length mean nothing."""
    trans, start = (model["trans"] + rules()).astype(np.float32), model["start"] + first_rules()
    length, batch = e.shape[:2]
    live = np.arange(length)[:, None] < lengths[None, :]
    score, back = e[0] + start, np.zeros((length, batch, TAGS), dtype=np.int8)
    for t in range(1, length):
        every = score[:, :, None] + trans
        back[t] = every.argmax(axis=1)
        score = np.where(live[t][:, None], every.max(axis=1) + e[t], score)
    tags = np.zeros((length, batch), dtype=np.int8)
    last, cols = score.argmax(axis=1), np.arange(batch)
    for t in range(length - 1, -1, -1):
        tags[t] = last
        last = np.where(live[t], back[t, cols, last], last)
    alpha, beta, norm = forward_backward(e, trans, start, live)
    chance = np.exp(alpha + beta - norm[None, :, None])[np.arange(length)[:, None], cols[None, :], tags]
    return tags, chance
