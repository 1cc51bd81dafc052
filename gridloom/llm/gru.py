"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax.

The vocabulary is `classes * size` frequent words, ordered by frequency and cut into classes of
equal size, and one class for all other words. log P(word | past) = log P(class | past) +
log P(word | class, past); within the last class the caller's counts take the second place.
"""

from __future__ import annotations

import numpy as np

CLASSES, SIZE, HIDDEN, WINDOW = 64, 64, 16, 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in the place of x."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _softmax(logits: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """exp(logits) and its sums over the last axis; where `bound` doesn't rule an overflow out, the greatest of each row is first taken off logits themselves."""
    if bound >= 60:
        logits -= logits.max(axis=-1, keepdims=True)
    e = np.exp(logits)
    return e, e.sum(axis=-1)


def _reach(v: np.ndarray) -> float:
    """The greatest absolute value."""
    return float(max(v.max(initial=0.0), -v.min(initial=0.0)))


class GatedModel:
    """Word ids: 0 .. classes*size - 1 are known, classes*size is any other word; an input of classes*size + 1 begins a text."""

    def __init__(self, counts: np.ndarray, other: float, classes: int = CLASSES, size: int = SIZE, hidden: int = HIDDEN, seed: int = 0):
        rng, f = np.random.default_rng(seed), np.float32
        self.classes, self.size, self.hidden, self.known = classes, size, hidden, classes * size
        within = np.full(self.known, 0.5)
        within[: len(counts)] += counts[: self.known]
        within = within.reshape(classes, size)
        share = np.append(within.sum(axis=1), other + 0.5)
        scale = 1 / np.sqrt(hidden)
        self.p = {
            "e": rng.normal(0, 0.3, (self.known + 2, hidden)).astype(f),
            "w": rng.normal(0, scale, (hidden, 3 * hidden)).astype(f),
            "u": rng.normal(0, scale, (hidden, 3 * hidden)).astype(f),
            "b": np.zeros(3 * hidden, f),
            "c": np.zeros((hidden, classes + 1), f),
            "cb": np.log(share / share.sum()).astype(f),
            "v": np.zeros((classes, size, hidden), f),
            "vb": np.log(within / within.sum(axis=1, keepdims=True)).astype(f),
        }  # untrained, it is the smoothed unigram model

    def copy(self) -> GatedModel:
        other = GatedModel.__new__(GatedModel)
        other.__dict__.update(self.__dict__, p={k: v.copy() for k, v in self.p.items()})
        return other

    def flat(self) -> np.ndarray:
        """All weights end to end."""
        return np.concatenate([v.reshape(-1) for v in self.p.values()])

    def set_flat(self, weights: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = weights[at : at + v.size].reshape(v.shape).astype(v.dtype)
            at += v.size

    def _step(self, x: np.ndarray, h: np.ndarray, u: np.ndarray):
        n = self.hidden
        a = h @ u
        gates = _sigmoid(x[:, : 2 * n] + a[:, : 2 * n])
        z, r, a = gates[:, :n], gates[:, n:], a[:, 2 * n :]
        g = r * a
        g += x[:, 2 * n :]
        np.tanh(g, out=g)
        new = h - g
        new *= z
        new += g
        return new, z, r, g, a

    def _output(self, h: np.ndarray, target: np.ndarray, grads: dict | None = None):
        """Natural log-probabilities of the targets, and with grads the gradient of their negative sum by h.

        Within classes, rows are laid out in blocks of rows of one class, so that all blocks are one product.
        """
        p, kind, size = self.p, np.minimum(target // self.size, self.classes), self.size
        reach = self.hidden * _reach(h)
        logits = h @ p["c"]
        logits += p["cb"]
        e, norm = _softmax(logits, reach * _reach(p["c"]) + _reach(p["cb"]))
        row = np.arange(len(h))
        out = logits[row, kind] - np.log(norm)
        dh = None
        if grads is not None:
            e /= norm[:, None]
            e[row, kind] -= 1
            grads["c"] += h.T @ e
            grads["cb"] += e.sum(axis=0)
            dh = e @ p["c"].T
        order = np.argsort(kind, kind="stable")
        counts = np.bincount(kind, minlength=self.classes + 1)[: self.classes]
        order = order[: int(counts.sum())]
        if not len(order):
            return out, dh
        rows = max(16, len(order) // (2 * self.classes))
        blocks = -(-counts // rows)
        of = np.repeat(np.arange(self.classes), blocks)
        slot = np.arange(len(order)) + np.repeat((np.cumsum(blocks) - blocks) * rows - (np.cumsum(counts) - counts), counts)
        x = np.zeros((len(of) * rows, self.hidden), h.dtype)
        x[slot] = h[order]
        x = x.reshape(len(of), rows, self.hidden)
        logits = x @ np.ascontiguousarray(p["v"].transpose(0, 2, 1))[of]
        logits += p["vb"][of][:, None]
        e, norm = _softmax(logits, reach * _reach(p["v"]) + _reach(p["vb"]))
        own = target[order] - kind[order] * size
        out[order] += logits.reshape(-1, size)[slot, own] - np.log(norm.reshape(-1)[slot])
        if grads is not None:
            used = np.zeros(len(of) * rows, h.dtype)
            used[slot] = 1
            e *= (used / norm.reshape(-1)).reshape(len(of), rows, 1)
            e.reshape(-1, size)[slot, own] -= 1
            dv, dvb, first = e.transpose(0, 2, 1) @ x, e.sum(axis=1), np.cumsum(blocks) - blocks
            one = np.flatnonzero(blocks == 1)
            grads["v"][one] += dv[first[one]]
            grads["vb"][one] += dvb[first[one]]
            for k in np.flatnonzero(blocks > 1).tolist():
                own = slice(first[k], first[k] + blocks[k])
                grads["v"][k] += dv[own].sum(axis=0)
                grads["vb"][k] += dvb[own].sum(axis=0)
            dh[order] += (e @ p["v"][of]).reshape(-1, self.hidden)[slot]
        return out, dh

    def _window(self, ids: np.ndarray, target: np.ndarray, h: np.ndarray, grads: dict | None = None):
        """Loss, gradients and last state of one window (steps, streams); the state that enters is a constant.

        A target below 0 is none: its place has no loss. Gradients are written to grads, if given.
        """
        p, n = self.p, self.hidden
        steps, streams = ids.shape
        if grads is None:
            grads = {k: np.zeros_like(v) for k, v in p.items()}
        embedded = p["e"][ids]
        x = embedded @ p["w"] + p["b"]
        begins = ids == self.known + 1
        keep, cuts = (~begins).astype(x.dtype)[..., None], begins.any(axis=1).tolist()
        state, before, z, r, g, a = (np.empty((steps, streams, n), x.dtype) for _ in range(6))
        for t in range(steps):
            before[t] = h * keep[t] if cuts[t] else h
            h, z[t], r[t], g[t], a[t] = self._step(x[t], before[t], p["u"])
            state[t] = h
        flat, real = target.reshape(-1), np.flatnonzero(target.reshape(-1) >= 0)
        dh_out = np.zeros((steps * streams, n), x.dtype)
        logp, dh_out[real] = self._output(state.reshape(-1, n)[real], flat[real], grads)
        # all that a step's gradient is multiplied by is known beforehand
        by = np.empty((steps, streams, 3, n), x.dtype)
        dg = (1 - z) * (1 - g * g)
        by[:, :, 0] = (before - g) * z * (1 - z)
        by[:, :, 1] = dg * a * r * (1 - r)
        by[:, :, 2] = dg * r
        d, da, turned = dh_out.reshape(steps, streams, n), np.empty_like(by), np.ascontiguousarray(p["u"].T)
        for t in range(steps - 1, -1, -1):
            if t + 1 < steps:
                d[t] += back
            np.multiply(d[t][:, None], by[t], out=da[t])
            back = da[t].reshape(streams, 3 * n) @ turned
            back += d[t] * z[t]
            if cuts[t]:
                back *= keep[t]
        da = da.reshape(-1, 3 * n)
        grads["u"] += before.reshape(-1, n).T @ da
        da[:, 2 * n :] = (d * dg).reshape(-1, n)
        grads["b"] += da.sum(axis=0)
        grads["w"] += embedded.reshape(-1, n).T @ da
        cell = ids.reshape(-1, 1) * n + np.arange(n)
        grads["e"] += np.bincount(cell.reshape(-1), (da @ p["w"].T).reshape(-1), grads["e"].size).reshape(-1, n)
        return -float(logp.sum()), grads, h

    def _views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Parts of a vector of all weights, by name."""
        ends = np.cumsum([v.size for v in self.p.values()]).tolist()
        return {k: flat[b - v.size : b].reshape(v.shape) for (k, v), b in zip(self.p.items(), ends, strict=True)}

    def train(self, texts: list[np.ndarray], streams: int = 64, window: int = WINDOW, epochs: int = 2, rate: float = 0.01) -> list[float]:
        """Adam over windows of `window` steps; returns the mean loss of each epoch. Texts follow each other in each stream.

        Every token is learned from; the last stream is filled up with places that have no target.
        """
        if not sum(map(len, texts)):
            return []
        ids = np.concatenate([np.append(self.known + 1, t[:-1]) for t in texts if len(t)])
        target = np.concatenate(texts)
        count = len(ids)
        streams = max(1, min(streams, count // (2 * window)))
        long = -(-count // streams)
        fill = long * streams - count
        ids, target = (np.ascontiguousarray(np.append(v, np.full(fill, f)).reshape(streams, long).T) for v, f in ((ids, self.known + 1), (target, -1)))
        weights = self.flat()
        self.p = self._views(weights)
        g, m, s, move = (np.zeros_like(weights) for _ in range(4))
        grads, losses, step, total = self._views(g), [], 0, epochs * -(-long // window)
        for _ in range(epochs):
            h, loss = np.zeros((streams, self.hidden), np.float32), 0.0
            for at in range(0, long, window):
                now = target[at : at + window]
                g.fill(0)
                one, _, h = self._window(ids[at : at + window], now, h, grads)
                loss, step = loss + one, step + 1
                g *= 8 / max(1, int((now >= 0).sum()))
                np.clip(g, -1, 1, out=g)
                np.subtract(g, m, out=move)
                move *= 0.1
                m += move
                g *= g
                g -= s
                g *= 0.01
                s += g
                np.multiply(s, 1 / (1 - 0.99**step), out=move)
                np.sqrt(move, out=move)
                move += 1e-6
                np.divide(m, move, out=move)
                move *= rate * (1 - 0.9 * step / total) / (1 - 0.9**step)
                weights -= move
            losses.append(loss / count)
        return losses

    def score(self, texts: list[np.ndarray], window: int = 64, hold: int = 1 << 12) -> np.ndarray:
        """Natural log-probability of each whole text; the state goes on from window to window to its end.

        Texts run side by side, longest first, so that those still going are always the first rows.
        """
        total = np.zeros(len(texts))
        lens = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lens, kind="stable")
        order = order[lens[order] > 0]
        if not len(order):
            return total
        lens, first = lens[order], np.concatenate([[0], np.cumsum(lens[order])])
        target = np.concatenate([texts[i] for i in order])
        p = self.p
        table = p["e"] @ p["w"] + p["b"]
        h = np.zeros((len(order), self.hidden), np.float32)
        states, wanted, owner, have = [], [], [], 0

        def flush():
            logp, _ = self._output(np.concatenate(states), np.concatenate(wanted))
            np.add.at(total, order[np.concatenate(owner)], logp.astype(np.float64))
            states.clear(), wanted.clear(), owner.clear()

        before, places, at = np.full(len(order), self.known + 1), np.arange(len(order)), first[:-1].copy()
        going = len(order) - np.cumsum(np.bincount(lens))  # texts longer than t
        for n in going[: int(lens[0])].tolist():
            h = self._step(table[before[:n]], h[:n], p["u"])[0]
            now = target[at[:n]]
            at[:n] += 1
            states.append(h)
            wanted.append(now)
            owner.append(places[:n])
            before, have = now, have + n
            if have >= hold:
                flush()
                have = 0
        if states:
            flush()
        return total
