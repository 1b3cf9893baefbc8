"""Bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the embedding of its hash next to the summed embeddings of its character
n-grams, so unseen words of known parts have a meaning too. Both directions run side
by side over windows of words; attention pools their states into one logit per window.
All gradients are written out; ``test_toxicity`` compares them with differences.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

WORD_BUCKETS = GRAM_BUCKETS = 1 << 14
EMBED, HIDDEN, ATTEND = 16, 12, 12
GRAMS = (3, 4, 5)
EDGE = 2  # code of a word's beginning and end
Params = dict[str, np.ndarray]


class Words(NamedTuple):
    """Different words as hashes: one word bucket each, their n-gram buckets one after another."""
    word: np.ndarray
    gram: np.ndarray
    start: np.ndarray  # first n-gram of each word
    count: np.ndarray


def fresh(seed: int = 1) -> Params:
    """Random weights; the output starts low, as most windows are clean."""
    rng = np.random.default_rng(seed)
    d, h, a = 2 * EMBED, HIDDEN, ATTEND

    def draw(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {"word": draw(WORD_BUCKETS, EMBED, scale=0.1), "gram": draw(GRAM_BUCKETS, EMBED, scale=0.1),
            "wx": draw(2, d, 3 * h, scale=d**-0.5), "bx": np.zeros((2, 3 * h), np.float32),
            "u": draw(2, h, 3 * h, scale=h**-0.5), "wa": draw(2 * h, a, scale=(2 * h)**-0.5), "ba": np.zeros(a, np.float32),
            "va": draw(a, scale=1.0), "wo": draw(2 * h, scale=0.5), "bo": np.full(1, -3.0, np.float32)}


def hashed(words: list[str]) -> Words:
    """Buckets of words and of their character n-grams, edges included."""
    codes = np.frombuffer(("\x02" + "\x02".join(words) + "\x02").encode("utf-32-le"), np.uint32).astype(np.uint64)
    edges = np.flatnonzero(codes == EDGE)
    lengths = np.diff(edges)  # characters and one edge
    multiplier = np.uint64(0x9E3779B97F4A7C15)
    grams, owners = [], []
    with np.errstate(over="ignore"):
        weights = np.cumprod(np.full(int(lengths.max(initial=1)), np.uint64(1_000_003)))
        place = np.arange(len(codes)) - np.repeat(np.append(edges, 0)[:-1], np.append(lengths, 1))
        word = np.add.reduceat((codes * weights[place])[:-1], edges[:-1]) * multiplier
        of = np.repeat(np.arange(len(words)), lengths)
        for n in GRAMS:
            at = np.arange(max(0, len(codes) - n + 1))
            if not len(at):
                continue
            value = np.zeros(len(at), np.uint64)
            for k in range(n):
                value = value * np.uint64(0x100000001B3) + codes[k:k + len(at)]
            own = of[np.minimum(at, len(of) - 1)]
            inside = (at + n - 1 <= edges[own + 1]) & (at < len(of))
            grams.append((value[inside] + np.uint64(n)) * multiplier)
            owners.append(own[inside])
        # words shorter than an n-gram have the one of their whole
        grams.append(word ^ np.uint64(0x5555))
        owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    count = np.bincount(owner, minlength=len(words))
    shift = np.uint64(40)
    return Words(((word >> shift) % np.uint64(WORD_BUCKETS)).astype(np.int64),
                 ((np.concatenate(grams)[order] >> shift) % np.uint64(GRAM_BUCKETS)).astype(np.int64),
                 np.cumsum(count) - count, count)


def inputs(p: Params, words: Words) -> np.ndarray:
    """(words, 2 * EMBED) inputs of different words."""
    grams = np.add.reduceat(p["gram"][words.gram], words.start, axis=0) / np.sqrt(words.count)[:, None]
    return np.concatenate([p["word"][words.word], grams.astype(p["gram"].dtype)], axis=1)


def projected(p: Params, x: np.ndarray) -> np.ndarray:
    """(2, words + 1, 3 * HIDDEN): the inputs as both directions see them; the last one is padding."""
    x = np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)])
    return x @ p["wx"] + p["bx"][:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def forward(p: Params, g: np.ndarray, windows: np.ndarray, keep: bool = False):
    """Logit of every row of ``windows`` (places in ``g``; the last one pads), and what ``backward`` needs."""
    n, length = windows.shape
    h = HIDDEN
    pad = windows == g.shape[1] - 1
    state = np.zeros((2, n, h), g.dtype)
    states = np.empty((length, 2, n, h), g.dtype)  # by place in the window, for both directions
    tape = []
    for t in range(length):
        x = np.stack([g[0, windows[:, t]], g[1, windows[:, length - 1 - t]]])
        y = state @ p["u"]
        zr = _sigmoid(x[..., :2 * h] + y[..., :2 * h])
        z, r = zr[..., :h], zr[..., h:]
        c = np.tanh(x[..., 2 * h:] + r * y[..., 2 * h:])
        new = c + z * (state - c)
        if keep:
            tape.append((state, zr, c, y[..., 2 * h:]))
        state = new
        states[t, 0], states[length - 1 - t, 1] = new[0], new[1]
    both = np.concatenate([states[:, 0], states[:, 1]], axis=2)  # (length, n, 2h)
    a = np.tanh(both @ p["wa"] + p["ba"])
    e = np.where(pad.T, -np.inf, a @ p["va"])
    e = np.exp(e - np.where(pad.all(axis=1), 0, e.max(axis=0)))
    alpha = e / np.maximum(e.sum(axis=0), 1e-30)  # all zero where a window has no word
    pooled = np.einsum("tn,tnk->nk", alpha, both)
    logit = pooled @ p["wo"] + p["bo"][0]
    return logit, (windows, tape, both, a, alpha, pooled) if keep else None


def backward(p: Params, g: np.ndarray, saved, d_logit: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients of the weights behind ``g``, and of ``g`` itself."""
    windows, tape, both, a, alpha, pooled = saved
    n, length = windows.shape
    h = HIDDEN
    grad = {"wo": pooled.T @ d_logit, "bo": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * p["wo"]
    d_alpha = np.einsum("nk,tnk->tn", d_pooled, both)
    d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
    grad["va"] = np.einsum("tn,tna->a", d_e, a)
    d_a = d_e[..., None] * p["va"] * (1 - a * a)
    grad["wa"] = np.einsum("tnk,tna->ka", both, d_a)
    grad["ba"] = d_a.sum(axis=(0, 1))
    d_both = alpha[..., None] * d_pooled + d_a @ p["wa"].T
    d_u = np.zeros_like(p["u"])
    d_x = np.empty((length, 2, n, 3 * h), g.dtype)  # by step
    d_state = np.zeros((2, n, h), g.dtype)
    for t in range(length - 1, -1, -1):
        state, zr, c, yc = tape[t]
        z, r = zr[..., :h], zr[..., h:]
        d_state[0] += d_both[t, :, :h]
        d_state[1] += d_both[length - 1 - t, :, h:]
        d_c = d_state * (1 - z) * (1 - c * c)
        d_z = d_state * (state - c) * z * (1 - z)
        d_r = d_c * yc * r * (1 - r)
        d_y = np.concatenate([d_z, d_r, d_c * r], axis=2)
        d_x[t] = np.concatenate([d_z, d_r, d_c], axis=2)
        d_u += state.transpose(0, 2, 1) @ d_y
        d_state = d_state * z + d_y @ p["u"].transpose(0, 2, 1)
    grad["u"] = d_u
    d_g = np.stack([summed(windows.T.ravel(), d_x[:, 0].reshape(-1, 3 * h), g.shape[1]),
                    summed(windows[:, ::-1].T.ravel(), d_x[:, 1].reshape(-1, 3 * h), g.shape[1])])
    return grad, d_g


def summed(keys: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows of ``values`` by key."""
    order = np.argsort(keys, kind="stable")
    found, first = np.unique(keys[order], return_index=True)
    out = np.zeros((size, values.shape[1]), values.dtype)
    out[found] = np.add.reduceat(values[order], first, axis=0)
    return out


def input_gradients(p: Params, words: Words, x: np.ndarray, d_g: np.ndarray, seen: np.ndarray) -> Params:
    """Gradients of the embeddings and of the input weights; ``seen`` is the mask of the inputs."""
    padded = np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)])
    grad = {"wx": padded.T @ d_g, "bx": d_g.sum(axis=1)}
    d_x = (d_g @ p["wx"].transpose(0, 2, 1)).sum(axis=0)[:-1] * seen
    grad["word"] = summed(words.word, d_x[:, :EMBED], WORD_BUCKETS)
    shares = np.repeat(d_x[:, EMBED:] / np.sqrt(words.count)[:, None], words.count, axis=0)
    grad["gram"] = summed(words.gram, shares.astype(x.dtype), GRAM_BUCKETS)
    return grad


class Adam:
    """Adam steps over a dictionary of weights, in place."""

    def __init__(self, p: Params, rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))

    def step(self, p: Params, grad: Params) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, d in grad.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.001 * (d * d - self.v[k])
            p[k] -= scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)
