"""A gated recurrent language model in numpy: one recurrent layer, a softmax over classes of symbols and one within the class.

Symbols are numbers: 0 ends a text, CLASSES x CLASS - 1 others stand for a word each, in classes of CLASS by rank, and RARE stands for any other word and is a class of its
own. A text starts from the state zero. Texts follow one another in lanes, which are worked on side by side, a window of steps at a time; the state goes on from
window to window, so a text of any length is read whole, and in training gradients go back within the window."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

CLASSES = CLASS = 48
RARE = CLASSES * CLASS
HIDDEN = EMBEDDED = 16
SHAPES = {
    "embedding": (RARE + 1, EMBEDDED), "input": (EMBEDDED, 3 * HIDDEN), "gate": (3 * HIDDEN,), "state": (HIDDEN, 3 * HIDDEN),
    "classes": (HIDDEN, CLASSES + 1), "class_bias": (CLASSES + 1,), "words": (CLASSES, HIDDEN, CLASS), "word_bias": (CLASSES, CLASS),
}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())
#: Steps of a window, and lanes in training and in scoring.
STEPS, LANES, SCORE_LANES = 32, 256, 512
#: Training takes fewer lanes where a lane would have fewer symbols than this.
LANE_SYMBOLS = 2048
RATE, CLIP = 0.01, 1.0

Weights = dict[str, np.ndarray]


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


def shaped(x: np.ndarray) -> Weights:
    """Views into one array."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = x[at : at + n].reshape(s)
        at += n
    return out


def initial(counts: np.ndarray, seed: int = 11) -> Weights:
    """Knows how often each symbol occurs and nothing about order. counts has RARE + 1 numbers; a negative one is of a symbol that isn't used."""
    rng = np.random.default_rng(seed)
    w = {k: rng.normal(0, 0.3 if k == "embedding" else s[0] ** -0.5, s).astype(np.float32) for k, s in SHAPES.items()}
    for k in ("gate", "classes", "words"):
        w[k][:] = 0
    mass = np.maximum(counts[:RARE], 0).reshape(CLASSES, CLASS)
    w["class_bias"][:] = np.log(np.append(mass.sum(axis=1), counts[RARE]) / max(np.maximum(counts, 0).sum(), 1) + 1e-9)
    used = counts[:RARE].reshape(CLASSES, CLASS) >= 0
    w["word_bias"][:] = np.where(used, np.log((mass + 0.1) / (mass.sum(axis=1, keepdims=True) + 0.1 * CLASS)), -40)
    return w


class Lanes:
    """Texts dealt to lanes, longest first; each is an array of symbols that ends with 0."""

    def __init__(self, texts: list[np.ndarray], lanes: int) -> None:
        sizes = np.array([len(t) for t in texts])
        load = [(0, k) for k in range(max(1, min(lanes, len(texts))))]
        dealt: list[list[int]] = [[] for _ in load]
        for i in np.argsort(-sizes, kind="stable").tolist():
            n, k = heapq.heappop(load)
            dealt[k].append(i)
            heapq.heappush(load, (n + int(sizes[i]), k))
        dealt.sort(key=lambda some: -int(sizes[some].sum()))
        self.order = np.array([i for some in dealt for i in some], np.int64)
        self.symbols = np.concatenate([texts[i] for i in self.order]).astype(np.int64)
        self.text_starts = np.cumsum(sizes[self.order]) - sizes[self.order]
        self.sizes = np.array([int(sizes[some].sum()) for some in dealt])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.before = np.concatenate([[0], self.symbols[:-1]])
        self.before[self.starts] = 0

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the symbols of each window (steps x lanes that aren't at their end), and which of them are within their lane."""
        for t in range(0, int(self.sizes.max(initial=0)), STEPS):
            n = int((self.sizes > t).sum())
            step = t + np.arange(min(STEPS, int(self.sizes[0]) - t))[:, None]
            inside = step < self.sizes[:n]
            yield np.where(inside, self.starts[:n] + step, 0), inside


def _steps(w: Weights, gates: np.ndarray, h: np.ndarray, before: np.ndarray, keep: tuple | None = None) -> np.ndarray:
    """The states of a window. keep: arrays for what the way back needs."""
    out = np.empty((*before.shape, HIDDEN), np.float32)
    a = gates[before]
    goes_on = (before != 0).astype(np.float32)[:, :, None]
    u = w["state"]
    for t in range(len(before)):
        h = h * goes_on[t]
        b = h @ u
        zr = b[:, : 2 * HIDDEN] + a[t, :, : 2 * HIDDEN]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(a[t, :, 2 * HIDDEN :] + r * b[:, 2 * HIDDEN :])
        if keep is not None:
            for kept, x in zip(keep, (h, zr, n, b[:, 2 * HIDDEN :]), strict=True):
                kept[t] = x
        h = n + z * (h - n)
        out[t] = h
    return out


def _chosen(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The log softmax of one row of each column, a column being a symbol, so that numpy goes along the symbols; x is used up."""
    x -= x.max(axis=0)
    value = x[of, np.arange(x.shape[1])]
    np.exp(x, out=x)
    return value - np.log(np.ones(len(x), np.float32) @ x)


def _error(x: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The gradient of the mean loss of n columns by the logits x, where row `of` is right; in place."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x *= np.float32(1 / n) / (np.ones(len(x), np.float32) @ x)
    x[of, np.arange(x.shape[1])] -= np.float32(1 / n)
    return x


def _logits(states: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """A row for each class or word, a column for each state."""
    x = weights.T @ states.T
    x += bias[:, None]
    return x


def _rows(states: np.ndarray, inside: np.ndarray) -> np.ndarray:
    return states.reshape(-1, HIDDEN) if inside.all() else states[inside]


def _by_class(kind: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of the symbols by class, and the range of each class that has words of its own and symbols here."""
    kind = kind.astype(np.uint16)
    order = np.argsort(kind, kind="stable")
    bounds = np.searchsorted(kind[order], np.arange(CLASSES + 1)).tolist()
    return order[: bounds[-1]], [(c, slice(*bounds[c : c + 2])) for c in range(CLASSES) if bounds[c] < bounds[c + 1]]


def log10_probabilities(w: Weights, texts: list[np.ndarray]) -> np.ndarray:
    """The log10 probability of each text's symbols, one after the other."""
    if not texts:
        return np.zeros(0)
    lanes = Lanes(texts, SCORE_LANES)
    gates = w["embedding"] @ w["input"] + w["gate"]
    found = np.zeros(len(lanes.symbols), np.float64)
    h = np.zeros((len(lanes.sizes), HIDDEN), np.float32)
    for at, inside in lanes.windows():
        states = _steps(w, gates, h[: at.shape[1]], lanes.before[at])
        h = states[-1]
        where = at[inside]
        states, symbols = _rows(states, inside), lanes.symbols[where]
        kind, place = np.divmod(symbols, CLASS)
        p = _chosen(_logits(states, w["classes"], w["class_bias"]), kind)
        order, classes = _by_class(kind)
        states, place, within = states[order], place[order], np.empty(len(order), np.float32)
        for c, some in classes:
            within[some] = _chosen(_logits(states[some], w["words"][c], w["word_bias"][c]), place[some])
        p[order] += within
        found[where] = p
    out = np.zeros(len(texts))
    out[lanes.order] = np.add.reduceat(found, lanes.text_starts)
    return out / np.log(10)


def _gradient(w: Weights, gates: np.ndarray, h: np.ndarray, before: np.ndarray, symbols: np.ndarray, inside: np.ndarray, g: Weights) -> np.ndarray:
    """Writes the gradient of the mean loss over a window to g; returns the state at its end."""
    keep = tuple(np.empty((*before.shape, size), np.float32) for size in (HIDDEN, 2 * HIDDEN, HIDDEN, HIDDEN))
    states = _steps(w, gates, h, before, keep)
    n = int(inside.sum())
    s, target = _rows(states, inside), symbols[inside]
    kind, place = np.divmod(target, CLASS)
    d = _error(_logits(s, w["classes"], w["class_bias"]), kind, n)
    g["classes"][:], g["class_bias"][:] = (d @ s).T, d.sum(axis=1)
    ds = d.T @ w["classes"].T
    g["words"][:], g["word_bias"][:] = 0, 0
    order, classes = _by_class(kind)
    s, place, within = s[order], place[order], np.empty((len(order), HIDDEN), np.float32)
    for c, some in classes:
        d = _error(_logits(s[some], w["words"][c], w["word_bias"][c]), place[some], n)
        g["words"][c], g["word_bias"][c] = (d @ s[some]).T, d.sum(axis=1)
        np.matmul(d.T, w["words"][c].T, out=within[some])
    ds[order] += within
    if n == inside.size:
        d_states = ds.reshape(states.shape)
    else:
        d_states = np.zeros_like(states)
        d_states[inside] = ds
    h0, zr, new, b = keep
    z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
    slope = zr * (1 - zr)
    by_z, by_r = slope[..., :HIDDEN], slope[..., HIDDEN:]
    by_z *= h0 - new
    by_r *= b
    by_n = 1 - new * new
    by_n *= 1 - z
    goes_on = (before != 0).astype(np.float32)[:, :, None]
    kept = z * goes_on
    d_input = np.empty((*before.shape, 3 * HIDDEN), np.float32)
    d_state = np.empty_like(d_input)
    dh = np.zeros_like(states[0])
    back = np.ascontiguousarray(w["state"].T)
    for t in range(len(before) - 1, -1, -1):
        dh += d_states[t]
        di, du = d_input[t], d_state[t]
        dn = di[:, 2 * HIDDEN :]
        np.multiply(dh, by_z[t], out=di[:, :HIDDEN])
        np.multiply(dh, by_n[t], out=dn)
        np.multiply(dn, by_r[t], out=di[:, HIDDEN : 2 * HIDDEN])
        du[:] = di
        du[:, 2 * HIDDEN :] *= r[t]
        dh *= kept[t]
        dh += (du @ back) * goes_on[t]
    d_input, used = d_input.reshape(-1, 3 * HIDDEN), before.ravel()
    g["state"][:] = h0.reshape(-1, HIDDEN).T @ d_state.reshape(-1, 3 * HIDDEN)
    g["gate"][:] = np.ones(len(d_input), np.float32) @ d_input
    g["input"][:] = w["embedding"][used].T @ d_input
    order = np.argsort(used.astype(np.uint16), kind="stable")
    first = np.flatnonzero(np.diff(used[order], prepend=-1))
    g["embedding"][:] = 0
    g["embedding"][used[order[first]]] = np.add.reduceat(d_input[order], first, axis=0) @ w["input"].T
    return states[-1]


class Trainer:
    """Adam over windows, from given weights."""

    def __init__(self, weights: np.ndarray, rate: float = RATE) -> None:
        self.x, self.g = weights.astype(np.float32).copy(), np.zeros(SIZE, np.float32)
        self.w, self.gradient = shaped(self.x), shaped(self.g)
        self.m, self.v, self.steps, self.symbols, self.rate = np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0, 0, rate

    def learn(self, texts: list[np.ndarray]) -> None:
        total = sum(map(len, texts))
        lanes = Lanes(texts, max(8, min(LANES, total // LANE_SYMBOLS)))
        h = np.zeros((len(lanes.sizes), HIDDEN), np.float32)
        for at, inside in lanes.windows():
            gates = self.w["embedding"] @ self.w["input"] + self.w["gate"]
            h = _gradient(self.w, gates, h[: at.shape[1]], lanes.before[at], lanes.symbols[at], inside, self.gradient)
            # a window with few symbols, at the end of a long text, says less
            self._step(min(1.0, inside.sum() / min(LANES * STEPS, LANE_SYMBOLS)))
        self.symbols += total

    def _step(self, share: float) -> None:
        g = self.g
        norm = float(np.sqrt(np.dot(g, g)))
        if norm > CLIP:
            g *= np.float32(CLIP / norm)
        self.steps += 1
        self.m *= np.float32(0.9)
        self.m += np.float32(0.1) * g
        g *= g
        g *= np.float32(0.01)
        self.v *= np.float32(0.99)
        self.v += g
        np.sqrt(self.v, out=g)
        g += np.float32(1e-5)
        np.divide(self.m, g, out=g)
        g *= np.float32(self.rate * share * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps))
        self.x -= g
