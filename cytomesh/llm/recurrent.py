"""A gated recurrent word model in numpy with a class-factored output.

P(word | before) = P(class | state) * P(word | class, state). The classes are runs of the most frequent words; one more
class holds all other words, whose share in it follows their counts in the corpus, plus one, with one place for words
never seen. Training is truncated backpropagation through time, the state carried on from window to window. Documents
follow one another in streams of about equal length and start from an empty state. A window holds about the same number
of tokens throughout: ``WINDOW`` steps at least, more where fewer streams are left, so a long document costs no more
updates than its words. Inside, features come before streams, so that every operation runs along the streams.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN, EMBEDDED = 24, 24
CLASSES, CLASS_WORDS = 40, 50
WINDOW, STREAMS = 16, 48
#: Streams and tokens of a window at most, and updates from which on windows grow beyond STREAMS * WINDOW.
MOST_STREAMS, BATCH, UPDATES = 192, 8192, 200
RATE, CLIP = 8e-3, 5.0
#: Tokens whose outputs are computed together.
OUTPUTS = 8192
#: Tokens that are read in step at a time, about.
READ = 32_768


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _log_softmax(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The target's logarithm of every column; works in place."""
    x -= x.max(axis=0)
    found = x[target, np.arange(len(target))]
    np.exp(x, out=x)
    return found - np.log(x.sum(axis=0))


def _softmax_errors(x: np.ndarray, target: np.ndarray, n: int) -> np.ndarray:
    """In place: what the mean loss of ``n`` tokens changes with the logits of every column."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    x[target, np.arange(len(target))] -= 1
    x /= n
    return x


class GatedModel:
    """Ids: 0 .. listed - 1 are listed words by falling count, ``listed`` every other word, ``listed + 1`` the beginning."""

    def __init__(self, counts: np.ndarray, other: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.listed = len(counts)
        self.classes = -(-self.listed // CLASS_WORDS)
        h, d = HIDDEN, EMBEDDED
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        padded = np.zeros(self.classes * CLASS_WORDS)
        padded[: self.listed] = counts
        mass = np.append(padded.reshape(self.classes, CLASS_WORDS).sum(axis=1), other) + 1.0
        inner = np.where(np.arange(len(padded)) < self.listed, np.log(padded + 0.5), -1e9).reshape(self.classes, CLASS_WORDS)
        self.p = {
            "embed": small(self.listed + 2, d), "wx": small(d, 3 * h), "bx": np.zeros(3 * h, np.float32), "wh": small(h, 3 * h), "bh": np.zeros(3 * h, np.float32),
            "wc": small(h, self.classes + 1) * 0.1, "bc": np.log(mass / mass.sum()).astype(np.float32),
            "wi": small(self.classes, h, CLASS_WORDS) * 0.1, "bi": inner.astype(np.float32),
        }

    def inputs(self) -> np.ndarray:
        """What every word adds to the gates."""
        return self.p["embed"] @ self.p["wx"] + self.p["bx"]

    def step(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        n = HIDDEN
        g = h @ self.p["wh"] + self.p["bh"]
        zr = _sigmoid(x[:, : 2 * n] + g[:, : 2 * n])
        c = np.tanh(x[:, 2 * n :] + zr[:, n:] * g[:, 2 * n :])
        return c + zr[:, :n] * (h - c)

    def _classes(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of the targets by class, their classes in that order, and where each class begins."""
        cls = np.where(target >= self.listed, self.classes, target // CLASS_WORDS)
        order = np.argsort(cls.astype(np.uint16 if self.classes < 65_536 else np.int64), kind="stable")
        cls = cls[order]
        return order, cls, np.searchsorted(cls, np.arange(self.classes + 1))

    def log_probs(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log-probability of listed ids, or of the class of other words, after the states h."""
        p = self.p
        order, cls, bounds = self._classes(target)
        h, target = h[order].T, target[order]
        found = _log_softmax(p["wc"].T @ h + p["bc"][:, None], cls)
        for c in range(self.classes):
            a, b = bounds[c], bounds[c + 1]
            if b > a:
                found[a:b] += _log_softmax(p["wi"][c].T @ h[:, a:b] + p["bi"][c][:, None], target[a:b] - c * CLASS_WORDS)
        out = np.empty_like(found)
        out[order] = found
        return out

    def _gates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What every word and the state add to the gates, negative for the two that go through a sigmoid, and the bias
        that the state brings into the third one."""
        n, sign = HIDDEN, np.ones(3 * HIDDEN, self.p["wh"].dtype)
        sign[: 2 * n] = -1
        table = self.inputs()
        table[:, : 2 * n] += self.p["bh"][: 2 * n]
        table *= sign
        return table, np.ascontiguousarray((self.p["wh"] * sign).T), self.p["bh"][2 * n :, None]

    @staticmethod
    def _step(x: np.ndarray, h: np.ndarray, wh: np.ndarray, bu: np.ndarray, zr: np.ndarray, u: np.ndarray, c: np.ndarray, out: np.ndarray) -> None:
        """One step of all streams, into the last four."""
        n = HIDDEN
        g = wh @ h
        np.add(x[: 2 * n], g[: 2 * n], out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        np.add(g[2 * n :], bu, out=u)
        np.multiply(zr[n:], u, out=c)
        c += x[2 * n :]
        np.tanh(c, out=c)
        np.subtract(h, c, out=out)
        out *= zr[:n]
        out += c

    def _read(self, gates: np.ndarray, h: np.ndarray, wh: np.ndarray, bu: np.ndarray) -> np.ndarray:
        """States (steps, features, streams) after the gates of every step, from the state h (features, streams)."""
        n, s = HIDDEN, h.shape[1]
        states = np.empty((len(gates), n, s), h.dtype)
        zr, u, c = np.empty((2 * n, s), h.dtype), np.empty((n, s), h.dtype), np.empty((n, s), h.dtype)
        for x, out in zip(gates, states, strict=True):
            self._step(x, h, wh, bu, zr, u, c, out)
            h = out
        return states

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Sum of ``log_probs`` of every document, all read in step, each to its end."""
        sums = np.zeros(len(docs))
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        lens = np.array([len(docs[i]) for i in order])
        table, wh, bu = self._gates()
        h = np.zeros((HIDDEN, len(docs)), table.dtype)
        before = np.full(len(docs), self.listed + 1)
        at, longest = 0, int(lens[0]) if len(lens) else 0
        while at < longest:
            live = int(np.searchsorted(-lens, -at, side="left"))  # documents longer than ``at``
            steps = min(longest - at, max(16, READ // live))
            block = np.full((live, steps), -1)
            for k in range(live):
                part = docs[order[k]][at : at + steps]
                block[k, : len(part)] = part
            gates = table[np.concatenate([before[:live, None], np.maximum(block[:, :-1], 0)], axis=1).T].transpose(0, 2, 1)
            states = self._read(np.ascontiguousarray(gates), h[:, :live], wh, bu)
            h = states[-1].copy()
            before = block[:, -1].copy()
            rows, block = states.transpose(0, 2, 1).reshape(-1, HIDDEN), block.T.ravel()
            own = np.flatnonzero(block >= 0)
            for a in range(0, len(own), OUTPUTS):
                part = own[a : a + OUTPUTS]
                sums[:live] += np.bincount(part % live, self.log_probs(rows[part], block[part]), minlength=live)
            at += steps
        out = np.zeros(len(docs))
        out[order] = sums
        return out

    # training

    def _window(self, x_ids: np.ndarray, y_ids: np.ndarray, h0: np.ndarray, keep: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean loss of a window (steps by streams, -1 where there is no token), and the last state.
        ``keep`` is 0 where a document starts, and 1 elsewhere."""
        p, n = self.p, HIDDEN
        steps, streams = y_ids.shape
        kind, ids = p["wh"].dtype, x_ids.reshape(-1)
        keep = np.ones((steps, streams), kind) if keep is None else keep.astype(kind)
        xs = p["embed"][ids]
        table, wh, bu = self._gates()
        gates = np.ascontiguousarray(table[x_ids].transpose(0, 2, 1))
        olds, zr, cs, us = (np.empty((steps, k, streams), kind) for k in (n, 2 * n, n, n))
        hs = np.empty((steps + 1, n, streams), kind)
        hs[0] = h0.T
        for t in range(steps):
            np.multiply(hs[t], keep[t], out=olds[t])
            self._step(gates[t], olds[t], wh, bu, zr[t], us[t], cs[t], hs[t + 1])
        grads = {k: np.zeros_like(p[k]) for k in ("wc", "bc", "wi", "bi")}
        y = y_ids.reshape(-1)
        own = np.flatnonzero(y >= 0)
        dflat = np.zeros((steps * streams, n), kind)
        if len(own):
            order, cls, bounds = self._classes(y[own])
            own = own[order]
            h, target = hs[1:].transpose(0, 2, 1).reshape(-1, n)[own].T, y[own]
            d = _softmax_errors(p["wc"].T @ h + p["bc"][:, None], cls, len(own))
            grads["wc"], grads["bc"] = h @ d.T, d.sum(axis=1)
            dh = p["wc"] @ d
            for c in range(self.classes):
                a, b = bounds[c], bounds[c + 1]
                if b > a:
                    e = _softmax_errors(p["wi"][c].T @ h[:, a:b] + p["bi"][c][:, None], target[a:b] - c * CLASS_WORDS, len(own))
                    grads["wi"][c], grads["bi"][c] = h[:, a:b] @ e.T, e.sum(axis=1)
                    dh[:, a:b] += p["wi"][c] @ e
            dflat[own] = dh.T
        dhs = np.ascontiguousarray(dflat.reshape(steps, streams, n).transpose(0, 2, 1))
        # what a step's gates change with its state; only the state's own share goes from step to step
        z, r = zr[:, :n], zr[:, n:]
        to_c = (1 - z) * (1 - cs * cs)
        to = np.stack([(olds - cs) * z * (1 - z), to_c * us * r * (1 - r), to_c * r], axis=1)
        dg, carry = np.empty_like(to), np.zeros((n, streams), kind)
        for t in range(steps - 1, -1, -1):
            dhs[t] += carry
            np.multiply(dhs[t], to[t], out=dg[t])
            carry = p["wh"] @ dg[t].reshape(3 * n, streams)
            carry += dhs[t] * z[t]
            carry *= keep[t]

        def flat(x: np.ndarray) -> np.ndarray:
            return x.reshape(steps, -1, streams).transpose(1, 0, 2).reshape(-1, steps * streams)

        both = flat(dg)
        grads["wh"], grads["bh"] = flat(olds) @ both.T, both.sum(axis=1)
        both[2 * n :] = flat(dhs * to_c)
        grads["wx"], grads["bx"] = (both @ xs).T, both.sum(axis=1)
        words = len(p["embed"])
        grads["embed"] = np.stack([np.bincount(ids, row, words) for row in p["wx"] @ both], axis=1).astype(kind)
        return grads, hs[-1].T

    def _streams(self, docs: list[np.ndarray], most: int = STREAMS) -> list[np.ndarray]:
        """Rows (input, token, keep) of up to ``most`` streams, longest first."""
        heap = [(0, k) for k in range(min(most, len(docs)))]
        dealt: list[list[np.ndarray]] = [[] for _ in heap]
        for d in sorted(docs, key=len, reverse=True):
            size, k = heapq.heappop(heap)
            dealt[k].append(d)
            heapq.heappush(heap, (size + len(d), k))
        out = []
        for own in dealt:
            y = np.concatenate(own[::-1])  # short documents first
            starts = np.cumsum([0] + [len(d) for d in own[::-1]])[:-1]
            x, keep = np.concatenate([[0], y[:-1]]), np.ones(len(y), np.int64)
            x[starts], keep[starts] = self.listed + 1, 0
            out.append(np.stack([x, y, keep]))
        return sorted(out, key=lambda s: -s.shape[1])

    def train(self, docs: list[np.ndarray], rate: float = RATE) -> int:
        """One pass over the documents; returns the number of their tokens."""
        docs = [d for d in docs if len(d)]
        if not docs:
            return 0
        total = sum(map(len, docs))
        batch = min(BATCH, max(STREAMS * WINDOW, total // UPDATES))
        streams = self._streams(docs, min(MOST_STREAMS, batch // WINDOW))
        lens = np.array([s.shape[1] for s in streams])
        own = np.concatenate([v.ravel() for v in self.p.values()])
        ends = np.cumsum([0] + [v.size for v in self.p.values()])
        self.p = {k: own[a:b].reshape(v.shape) for (k, v), a, b in zip(self.p.items(), ends, ends[1:], strict=False)}
        first, second, kept = np.zeros_like(own), np.zeros_like(own), np.empty_like(own)
        h = np.zeros((len(streams), HIDDEN), own.dtype)
        t, longest, update = 0, int(lens[0]), 0
        while t < longest:
            live = int(np.searchsorted(-lens, -t, side="left"))
            steps = min(max(WINDOW, batch // live), longest - t)
            block = np.full((3, steps, live), -1)
            block[0], block[2] = 0, 1
            for k in range(live):
                part = streams[k][:, t : t + steps]
                block[:, : part.shape[1], k] = part
            grads, h = self._window(block[0], block[1], h[:live], block[2])
            g = np.concatenate([grads[k].ravel() for k in self.p])
            g *= min(1.0, CLIP / (float(np.sqrt(np.dot(g, g))) + 1e-12))
            t, update = t + steps, update + 1
            pace = rate * float(np.sqrt(1 - 0.999**update)) / (1 - 0.9**update)
            first *= 0.9
            first += np.multiply(g, 0.1, out=kept)
            g *= g
            g *= 0.001
            second *= 0.999
            second += g
            np.sqrt(second, out=g)
            g += 1e-8
            np.divide(first, g, out=g)
            g *= pace
            own -= g
        return total

    # weights as one list of numbers

    def weights(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()]).astype(np.float64)

    def set_weights(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
