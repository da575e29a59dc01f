"""A small gated recurrent language model in numpy.

Inputs and outputs are codes: code i < n_words is a frequent word, code
n_words + r is "some word of rare class r". The output softmax is factored: first
a softmax over classes (frequent classes, then rare ones), then, in a frequent
class, one over its words. What a rare class's words get within it is not this
module's business. Training is truncated backpropagation through windows of
``STEPS`` tokens with Adam, longer ones (``MOST_STEPS`` at most) where few texts are left; the state
goes on from window to window until a text ends. Gradients of small windows make one step, of ``STEP_TOKENS``
tokens at least, so that a long text's end is no row of steps on few tokens each.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

STEPS, SLOTS = 20, 256
STEP_TOKENS, MOST_STEPS = 2048, 160


@dataclass(frozen=True)
class Shape:
    """Sizes: frequent words, words in each frequent class, rare classes, embedding, state."""

    n_words: int
    width: int
    n_rare: int
    embed: int = 16
    state: int = 16

    @property
    def n_frequent(self) -> int:
        return -(-self.n_words // self.width)

    @property
    def n_classes(self) -> int:
        return self.n_frequent + self.n_rare

    def parts(self) -> dict[str, tuple[int, ...]]:
        e, h = self.embed, self.state
        return {"embedding": (self.n_words + self.n_rare, e), "wx": (e, 3 * h), "wh": (h, 3 * h), "b": (3 * h,), "wc": (h, self.n_classes), "bc": (self.n_classes,), "wo": (self.n_words, h), "bo": (self.n_words,)}

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.parts().items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.parts().values())

    def start(self, class_mass: np.ndarray, word_mass: np.ndarray, seed: int = 11) -> np.ndarray:
        """First parameters: small weights, and biases that make the outputs the given masses."""
        rng = np.random.default_rng(seed)
        flat = np.zeros(self.size(), np.float32)
        v = self.views(flat)
        v["embedding"][:] = rng.normal(0, 0.3, v["embedding"].shape)
        v["wx"][:] = rng.normal(0, self.embed**-0.5, v["wx"].shape)
        v["wh"][:] = rng.normal(0, self.state**-0.5, v["wh"].shape)
        v["bc"][:] = np.log(class_mass)
        v["bo"][:] = np.log(word_mass)
        return flat


def lay_out(lengths: list[int], slots: int = SLOTS) -> list[list[int]]:
    """Texts dealt to slots, longest first to the emptiest; the fullest slot comes first."""
    tokens, longest = sum(lengths), max([1, *lengths])
    # a long text leaves fewer slots, so that cells are at most 8 times the tokens
    slots = max(1, min(slots, len(lengths), max(8, tokens // (STEPS * 16)), max(8, 8 * tokens // longest)))
    heap = [(0, s) for s in range(slots)]
    out: list[list[int]] = [[] for _ in range(slots)]
    total = [0] * slots
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n, s = heapq.heappop(heap)
        out[s].append(i)
        total[s] = n + lengths[i]
        heapq.heappush(heap, (total[s], s))
    return [out[s] for s in sorted(range(slots), key=lambda s: -total[s])]


def _rows_last(x: np.ndarray) -> np.ndarray:
    """(steps, n, slots) as n rows of steps * slots."""
    return np.ascontiguousarray(x.transpose(1, 0, 2)).reshape(x.shape[1], -1)


def _may_overflow(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether exponentials of logits (weights by states, and bias) could overflow: states are in [-1, 1], so these bound them."""
    return float(np.max(np.abs(weights).sum(axis=0) + np.abs(bias))) > 60


class Model:
    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.flat = shape, flat
        self.p = shape.views(flat)

    def _forward(self, x, reset, h):
        """Arrays of one window, slots last, so that every operation runs over long rows."""
        p, n = self.p, self.shape.state
        steps, slots = x.shape
        parts = (p["embedding"] @ p["wx"] + p["b"]).T.copy()  # few codes: each code's part once
        parts[: 2 * n] *= 0.5
        a = np.take(parts, x.ravel(), axis=1).reshape(3 * n, steps, slots)
        wh = p["wh"].T.copy()
        wh[: 2 * n] *= 0.5
        hs = np.empty((steps + 1, n, slots), np.float32)
        hs[0] = h
        zr = np.empty((steps, 2 * n, slots), np.float32)
        un, nn = np.empty((steps, n, slots), np.float32), np.empty((steps, n, slots), np.float32)
        keep, fresh = ~reset, reset.any(axis=1)
        for t in range(steps):
            before = hs[t] * keep[t] if fresh[t] else hs[t]  # hs[t] itself still predicts the end of the text before
            u = wh @ before
            g = zr[t]
            np.add(a[: 2 * n, t], u[: 2 * n], out=g)
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            un[t] = u[2 * n :]
            c = nn[t]
            np.multiply(g[n:], un[t], out=c)
            c += a[2 * n :, t]
            np.tanh(c, out=c)
            after = hs[t + 1]
            np.subtract(before, c, out=after)
            after *= g[:n]
            after += c
        return hs, zr, un, nn

    def _outputs(self, out, y, grads=None):
        """Natural log probability of each code y from states out, a column each; adds to grads, and returns the states' gradient."""
        p, s = self.p, self.shape
        y_class = np.where(y < s.n_words, y // s.width, y - s.n_words + s.n_frequent)
        at = np.arange(len(y))
        ones = np.ones(max(s.n_classes, s.width), np.float32)  # sums by ones: a product is faster than a reduction
        logits = p["wc"].T @ out
        logits += p["bc"][:, None]
        if _may_overflow(p["wc"], p["bc"]):
            logits -= logits.max(axis=0)
        picked = logits[y_class, at]
        np.exp(logits, out=logits)
        total = ones[: s.n_classes] @ logits
        logp = (picked - np.log(total)).astype(np.float64)
        d = None
        if grads is not None:
            logits *= 1 / total
            logits[y_class, at] -= 1
            grads["wc"] += out @ logits.T
            grads["bc"] += logits.sum(axis=1)
            d = p["wc"] @ logits
        frequent = np.flatnonzero(y < s.n_words)
        frequent = frequent[np.argsort(y_class[frequent].astype(np.int16), kind="stable")]
        cuts = np.searchsorted(y_class[frequent], np.arange(s.n_frequent + 1))
        large = _may_overflow(p["wo"].T, p["bo"])
        for c in range(s.n_frequent):
            own = frequent[cuts[c] : cuts[c + 1]]
            if not len(own):
                continue
            words = slice(c * s.width, min((c + 1) * s.width, s.n_words))
            h = np.take(out, own, axis=1)
            q = p["wo"][words] @ h
            q += p["bo"][words, None]
            if large:
                q -= q.max(axis=0)
            r, w = at[: len(own)], y[own] - c * s.width
            picked = q[w, r]
            np.exp(q, out=q)
            total = ones[: len(q)] @ q
            logp[own] += picked - np.log(total)
            if grads is not None:
                q *= 1 / total
                q[w, r] -= 1
                grads["wo"][words] += q @ h.T
                grads["bo"][words] += q.sum(axis=1)
                d[:, own] += p["wo"][words].T @ q
        return logp, d

    def _backward(self, x, reset, state, d, grads):
        p, n = self.p, self.shape.state
        hs, zr, un, nn = state
        steps, slots = x.shape
        keep, fresh = ~reset, reset.any(axis=1)
        z, r, before = zr[:, :n], zr[:, n:], hs[:-1] * keep[:, None]
        # the gates' and the candidate's gradients are the state's gradient times these
        by_input = np.empty((steps, 3, n, slots), np.float32)
        np.multiply(1 - z, 1 - nn * nn, out=by_input[:, 2])
        np.multiply((before - nn) * z, 1 - z, out=by_input[:, 0])
        np.multiply(by_input[:, 2] * un, r * (1 - r), out=by_input[:, 1])
        by_state = by_input.copy()
        by_state[:, 2] *= r
        dh = np.empty((steps, n, slots), np.float32)
        du = np.empty((steps, 3, n, slots), np.float32)
        back = np.zeros((n, slots), np.float32)
        for t in range(steps - 1, -1, -1):
            np.add(d[t], back, out=dh[t])
            np.multiply(dh[t], by_state[t], out=du[t])
            back = dh[t] * z[t]
            back += p["wh"] @ du[t].reshape(3 * n, slots)
            if fresh[t]:
                back *= keep[t]
        grads["wh"] += _rows_last(before) @ _rows_last(du.reshape(steps, 3 * n, slots)).T
        by_input *= dh[:, None]
        flat = _rows_last(by_input.reshape(steps, 3 * n, slots))
        grads["b"] += flat.sum(axis=1)
        # few codes: sums of the gates' gradients for each code, then one small product
        codes = x.ravel().astype(np.int16)  # a radix sort
        order = np.argsort(codes, kind="stable")
        code = codes[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        met = code[first]
        sums = np.add.reduceat(np.take(flat, order, axis=1), first, axis=1)
        grads["wx"] += (sums @ p["embedding"][met]).T
        grads["embedding"][met] += (p["wx"] @ sums).T

    def run(self, texts: list[np.ndarray], end: int, learner: Adam | None = None) -> np.ndarray:
        """The natural log probability of each text (its codes, which end with ``end``); learns if asked to."""
        out = np.zeros(len(texts))
        if not texts:
            return out
        slots = lay_out([len(t) for t in texts])
        totals = np.array([sum(len(texts[i]) for i in s) for s in slots])
        longest = int(totals[0])
        y = np.full((longest, len(slots)), -1, np.int32)
        owner = np.zeros((longest, len(slots)), np.int32)
        reset = np.zeros((longest, len(slots)), bool)
        for s, own in enumerate(slots):
            at = 0
            for i in own:
                n = len(texts[i])
                y[at : at + n, s], owner[at : at + n, s], reset[at, s] = texts[i], i, True
                at += n
        x = np.empty_like(y)
        x[0] = end
        x[1:] = y[:-1]
        x[reset | (x < 0)] = end
        h = np.zeros((self.shape.state, len(slots)), np.float32)
        at = pending = 0
        while at < longest:
            live = int(np.searchsorted(-totals, -at))
            w = slice(at, min(at + max(STEPS, min(MOST_STEPS, STEP_TOKENS // live)), longest))
            at = w.stop
            state = self._forward(x[w, :live], reset[w, :live], h[:, :live])
            h = state[0][-1]
            codes = y[w, :live].ravel()
            told = np.flatnonzero(codes >= 0)
            states = _rows_last(state[0][1:])
            if len(told) < len(codes):
                states = np.take(states, told, axis=1)
            if learner is None:
                logp, _ = self._outputs(states, codes[told])
            else:
                logp, d = self._outputs(states, codes[told], learner.grads)
                full = np.zeros((self.shape.state, len(codes)), np.float32)
                full[:, told] = d
                full = full.reshape(self.shape.state, -1, live).transpose(1, 0, 2)
                self._backward(x[w, :live], reset[w, :live], state, full, learner.grads)
                pending += len(told)
                if pending >= STEP_TOKENS or at == longest:
                    learner.step(self.flat, pending)
                    learner.zero()
                    pending = 0
            out += np.bincount(owner[w, :live].ravel()[told], weights=logp, minlength=len(texts))
        return out


class Adam:
    def __init__(self, shape: Shape, rate: float = 0.01):
        self.flat = np.zeros(shape.size(), np.float32)
        self.grads = shape.views(self.flat)
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.rate, self.t = rate, 0

    def zero(self) -> None:
        self.flat[:] = 0

    def step(self, params: np.ndarray, tokens: int) -> None:
        self.t += 1
        g = self.flat
        g /= tokens
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        rate = self.rate * (1 - 0.99**self.t) ** 0.5 / (1 - 0.9**self.t)
        params -= rate * self.m / (np.sqrt(self.v) + 1e-7)
