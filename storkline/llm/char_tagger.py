"""A bidirectional LSTM over characters with a CRF on top, in numpy.

Both directions run side by side as one batch. Training maximises the log-likelihood of whole tag
sequences with Adam. Windows of a longer stretch overlap; a character's tag scores are the mean over
the windows it lies in, weighted by its distance from their edges, and one Viterbi pass over the whole
stretch decides.
"""

from __future__ import annotations

import numpy as np

WINDOW, STRIDE = 64, 32
EMBED, HIDDEN = 16, 24
CHARACTERS = 130  # ASCII, one for all others, one for padding
PAD = 129


def encode(s: str) -> np.ndarray:
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(codes, 128).astype(np.int64)


def start(tags: int, seed: int = 1) -> dict[str, np.ndarray]:
    pick = np.random.default_rng(seed)
    draw = lambda *shape: (pick.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)
    bias = np.zeros((2, 1, 4 * HIDDEN), np.float32)
    bias[:, :, HIDDEN:2 * HIDDEN] = 1
    return {
        "embed": draw(CHARACTERS, EMBED), "x": draw(2, EMBED, 4 * HIDDEN), "h": draw(2, HIDDEN, 4 * HIDDEN), "b": bias,
        "out": draw(2 * HIDDEN, tags), "out_b": np.zeros(tags, np.float32),
        "move": np.zeros((tags, tags), np.float32), "first": np.zeros(tags, np.float32),
    }


def silent(tags: int) -> dict[str, np.ndarray]:
    """Parameters that tag everything 0."""
    p = {name: np.zeros_like(x) for name, x in start(tags).items()}
    p["out_b"][0] = 1
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(p: dict, codes: np.ndarray, keep: bool = False):
    """Tag scores (batch, time, tags) of code windows (batch, time)."""
    n, t = codes.shape
    embedded = p["embed"][codes]
    both = np.stack([embedded, embedded[:, ::-1]])
    gates_in = both @ p["x"][:, None] + p["b"][:, None]
    h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    states, kept = np.zeros((2, n, t, HIDDEN), np.float32), []
    for i in range(t):
        z = gates_in[:, :, i] + h @ p["h"]
        s = _sigmoid(z[..., :3 * HIDDEN])
        g = np.tanh(z[..., 3 * HIDDEN:])
        before_h, before_c = h, c
        c = s[..., HIDDEN:2 * HIDDEN] * c + s[..., :HIDDEN] * g
        tc = np.tanh(c)
        h = s[..., 2 * HIDDEN:] * tc
        states[:, :, i] = h
        if keep:
            kept.append((s, g, before_h, before_c, tc))
    joined = np.concatenate([states[0], states[1][:, ::-1]], axis=-1)
    scores = joined @ p["out"] + p["out_b"]
    return (scores, joined, both, kept) if keep else scores


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _gradients(p: dict, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood of the tag sequences and its gradients."""
    n, t = codes.shape
    k = len(p["first"])
    scores, joined, both, kept = _forward(p, codes, keep=True)
    alpha, beta = np.zeros((n, t, k), np.float32), np.zeros((n, t, k), np.float32)
    alpha[:, 0] = scores[:, 0] + p["first"]
    for i in range(1, t):
        alpha[:, i] = scores[:, i] + _lse(alpha[:, i - 1][:, :, None] + p["move"], 1)
    for i in range(t - 2, -1, -1):
        beta[:, i] = _lse(p["move"] + (scores[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
    whole = _lse(alpha[:, -1], 1)
    share = np.exp(alpha + beta - whole[:, None, None])
    pair = np.exp(alpha[:, :-1, :, None] + p["move"] + (scores + beta)[:, 1:, None, :] - whole[:, None, None, None])
    truth = np.eye(k, dtype=np.float32)[tags]
    right = (scores * truth).sum((1, 2)) + p["first"][tags[:, 0]] + p["move"][tags[:, :-1], tags[:, 1:]].sum(1)
    d = {name: np.zeros_like(v) for name, v in p.items()}
    d["first"] = (share[:, 0] - truth[:, 0]).mean(0)
    d["move"] = pair.sum((0, 1)) / n
    np.add.at(d["move"], (tags[:, :-1], tags[:, 1:]), -1 / n)
    d_scores = (share - truth) / n
    d["out"] = np.einsum("nth,ntk->hk", joined, d_scores)
    d["out_b"] = d_scores.sum((0, 1))
    d_joined = d_scores @ p["out"].T
    d_states = np.stack([d_joined[..., :HIDDEN], d_joined[:, ::-1, HIDDEN:]])
    d_h, d_c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    d_in = np.zeros((2, n, t, 4 * HIDDEN), np.float32)
    for i in range(t - 1, -1, -1):
        s, g, before_h, before_c, tc = kept[i]
        enter, forget, leave = s[..., :HIDDEN], s[..., HIDDEN:2 * HIDDEN], s[..., 2 * HIDDEN:]
        d_h = d_h + d_states[:, :, i]
        d_c = d_c + d_h * leave * (1 - tc * tc)
        z = np.concatenate([
            d_c * g * enter * (1 - enter), d_c * before_c * forget * (1 - forget),
            d_h * tc * leave * (1 - leave), d_c * enter * (1 - g * g),
        ], axis=-1)
        d_in[:, :, i] = z
        d["h"] += before_h.transpose(0, 2, 1) @ z
        d_h = z @ p["h"].transpose(0, 2, 1)
        d_c = d_c * forget
    d["b"] = d_in.sum((1, 2))[:, None]
    d["x"] = np.einsum("dnte,dntz->dez", both, d_in)
    d_both = d_in @ p["x"].transpose(0, 2, 1)[:, None]
    np.add.at(d["embed"], codes, d_both[0] + d_both[1][:, ::-1])
    return float((whole - right).mean()), d


def train(codes: np.ndarray, tags: np.ndarray, kinds: int, epochs: int, batch: int = 32, rate: float = 0.01, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters learned from windows (n, WINDOW) of codes and their tags."""
    p = start(kinds, seed)
    m, v = ({name: np.zeros_like(x) for name, x in p.items()} for _ in range(2))
    pick, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order = pick.permutation(len(codes))
        for a in range(0, len(order), batch):
            rows = order[a:a + batch]
            _, grads = _gradients(p, codes[rows], tags[rows])
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            pace = rate * (1 - epoch / epochs) * min(1.0, 5 / (size + 1e-9))
            for name, g in grads.items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                p[name] = p[name] - pace * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)
    return p


def window_starts(length: int) -> list[int]:
    """Overlapping windows that cover a stretch; a short stretch has one, padded."""
    if length <= WINDOW:
        return [0]
    return [*range(0, length - WINDOW, STRIDE), length - WINDOW]


_NEARNESS = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def tag(p: dict, stretches: list[np.ndarray], batch: int = 128) -> list[np.ndarray]:
    """The best tag sequence of each stretch of codes."""
    windows = [(i, a) for i, s in enumerate(stretches) for a in window_starts(len(s))]
    sums = [np.zeros((len(s), len(p["first"])), np.float32) for s in stretches]
    weights = [np.zeros((len(s), 1), np.float32) for s in stretches]
    for k in range(0, len(windows), batch):
        part = windows[k:k + batch]
        codes = np.full((len(part), WINDOW), PAD)
        for row, (i, a) in enumerate(part):
            own = stretches[i][a:a + WINDOW]
            codes[row, :len(own)] = own
        for (i, a), found in zip(part, _forward(p, codes), strict=True):
            own = slice(a, min(a + WINDOW, len(stretches[i])))
            near = _NEARNESS[:own.stop - a, None]
            sums[i][own] += found[:own.stop - a] * near
            weights[i][own] += near
    scores = [s / w for s, w in zip(sums, weights, strict=True)]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(stretches)
    part: list[int] = []
    for i in sorted(range(len(scores)), key=lambda i: len(scores[i])):
        if part and (len(part) + 1) * len(scores[i]) > _PADDED:
            _decide(p, scores, part, out)
            part = []
        part.append(i)
    _decide(p, scores, part, out)
    return out


#: characters of stretches, padded to the longest, that are decided at once
_PADDED = 100_000


def _decide(p: dict, scores: list[np.ndarray], part: list[int], out: list[np.ndarray]) -> None:
    if part:
        for i, best in zip(part, _viterbi(p, [scores[i] for i in part]), strict=True):
            out[i] = best


def _viterbi(p: dict, scores: list[np.ndarray]) -> list[np.ndarray]:
    """Best sequences of stretches ordered by length, all at once; shorter ones stand still at the end."""
    sizes = np.array([len(s) for s in scores])
    t, k = int(sizes.max()), len(p["first"])
    padded = np.zeros((len(scores), t, k), np.float32)
    for i, s in enumerate(scores):
        padded[i, :len(s)] = s
    back = np.zeros((len(scores), t, k), np.int8)
    best = padded[:, 0] + p["first"]
    for i in range(1, t):
        moves = best[:, :, None] + p["move"]
        live = (i < sizes)[:, None]
        back[:, i] = np.where(live, moves.argmax(1), np.arange(k))
        best = np.where(live, moves.max(1) + padded[:, i], best)
    path = np.zeros((len(scores), t), np.int64)
    path[:, -1] = best.argmax(1)
    rows = np.arange(len(scores))
    for i in range(t - 1, 0, -1):
        path[:, i - 1] = back[rows, i, path[:, i]]
    return [path[i, :n] for i, n in enumerate(sizes)]
