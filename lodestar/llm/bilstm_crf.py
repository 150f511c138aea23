"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Characters are classes, so that the input weights are a table with a row a class. Both directions run in one
loop. Training is Adam on the CRF's negative log-likelihood, with a fixed seed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """w: weights by name. x: windows x characters, classes of characters; class 0 is padding, at a window's end."""

    w: dict[str, np.ndarray]

    @staticmethod
    def fresh(classes: int, labels: int, hidden: int, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        bias = np.zeros((2, 1, 4 * hidden), np.float32)
        bias[:, :, hidden : 2 * hidden] = 1  # the forget gates start open
        return Tagger(
            {
                "table": draw(2, classes, 4 * hidden, scale=0.3),
                "inner": draw(2, hidden, 4 * hidden, scale=hidden**-0.5),
                "bias": bias,
                "out": draw(2 * hidden, labels, scale=(2 * hidden) ** -0.5),
                "out_bias": np.zeros(labels, np.float32),
                "step": np.zeros((labels, labels), np.float32),
            }
        )

    def _states(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states, windows x characters x both directions; and what going back needs."""
        n, length = x.shape
        table, inner, bias = self.w["table"], self.w["inner"], self.w["bias"]
        hidden = inner.shape[1]
        both = np.stack([x, x[:, ::-1]])
        h, c = np.zeros((2, n, hidden), np.float32), np.zeros((2, n, hidden), np.float32)
        out, held = np.empty((2, length, n, hidden), np.float32), []
        for t in range(length):
            gates = np.matmul(h, inner) + bias
            gates[0] += table[0][both[0, :, t]]
            gates[1] += table[1][both[1, :, t]]
            s = _sigmoid(gates[:, :, : 3 * hidden])
            i, f, o, g = s[:, :, :hidden], s[:, :, hidden : 2 * hidden], s[:, :, 2 * hidden :], np.tanh(gates[:, :, 3 * hidden :])
            c_new = f * c + i * g
            tanh_c = np.tanh(c_new)
            if keep:
                held.append((h, c, i, f, o, g, tanh_c))
            h, c = o * tanh_c, c_new
            out[:, t] = h
        out[1] = out[1, ::-1].copy()
        return np.concatenate([out[0], out[1]], axis=2).transpose(1, 0, 2), held

    @np.errstate(over="ignore")  # an infinite exp() is a closed gate
    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Labels x characters x windows. Padding has label 0, and what precedes it does not depend on how much there is."""
        n, length = x.shape
        hidden, labels = self.w["inner"].shape[1], self.w["out"].shape[1]
        # exp takes about half the time of tanh, and a sigmoid is 1 / (1 + exp(-x)), a tanh 2 / (1 + exp(-2 x)) - 1: the weights
        # hold the signs and the 2; cells are kept times -1/2 and states times 1/2, so that neither needs a pass of its own
        scale = np.append(np.full(3 * hidden, -1), np.full(hidden, -2)).astype(np.float32)
        table, inner, out = (self.w["table"] + self.w["bias"]) * scale, self.w["inner"] * scale * np.float32(2), self.w["out"] * np.float32(2)
        by_gate = lambda w: np.ascontiguousarray(w.reshape(-1, 4, hidden).transpose(1, 0, 2), np.float32)
        total = np.zeros((labels, length * n), np.float32)
        states = np.empty((length, n, hidden), np.float32)
        gates, drawn, part = np.empty((4, n, hidden), np.float32), np.empty((4, n, hidden), np.float32), np.empty((n, hidden), np.float32)
        by_step = np.ascontiguousarray(x.T)
        there = by_step != 0
        # windows as long as the longest come first: in a step only those are taken that still go on, all up to the last of them
        reach = n - np.argmax(there[:, ::-1], axis=1)
        reach[~there.any(axis=1)] = 0
        padded = there.sum(axis=1) < reach
        for d in (0, 1):
            own, back = by_gate(table[d]), by_gate(inner[d])
            h, c = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
            for t in range(length) if d == 0 else range(length - 1, -1, -1):
                m = int(reach[t])
                states[t, m:] = 0
                if not m:
                    h = states[t]
                    continue
                gate, taken = (w.reshape(-1)[: 4 * m * hidden].reshape(4, m, hidden) for w in (gates, drawn))
                (i, f, o, g), cell, rest = gate, c[:m], part[:m]
                np.matmul(h[:m], back, out=gate)
                own.take(by_step[t, :m], axis=1, out=taken, mode="clip")
                gate += taken
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
                np.subtract(0.5, g, out=rest)
                rest *= i
                cell *= f
                cell += rest
                h = states[t]
                if padded[t]:
                    cell *= there[t, :m, None]
                np.multiply(cell, 4, out=rest)
                np.exp(rest, out=rest)
                rest += 1
                np.reciprocal(rest, out=rest)
                rest -= 0.5
                np.multiply(o, rest, out=h[:m])
            total += out[d * hidden : (d + 1) * hidden].T.astype(np.float32) @ states.reshape(-1, hidden).T
        total = total.reshape(labels, length, n)
        total += self.w["out_bias"].astype(np.float32)[:, None, None]
        total[0][~there] = 0
        total[1:, ~there] = -1e4
        return total

    def _stretches(self, e: np.ndarray) -> list[tuple[int, int, int]]:
        """Window, start and end of each stretch outside which its best labels are 0: no run of other labels there makes
        up for itself, even at its very best. With a character of label 0 on either side, where there is one."""
        a = self.w["step"]
        gain = np.maximum.reduce(list(e[1:])) - e[0]
        enter, leave, stay = a[0, 1:].max() - a[0, 0], a[1:, 0].max() - a[0, 0], a[1:, 1:].max() - a[0, 0]
        length = len(gain)
        ending = np.empty_like(gain)  # the most that a run ending here can gain, its beginning paid for
        ending[0] = run = gain[0]
        for t in range(1, length):
            ending[t] = run = gain[t] + np.maximum(run + stay, enter)
        some = np.flatnonzero((ending + leave).max(axis=0) > 0) if leave < 0 else np.arange(gain.shape[1])
        gain, ending = gain[:, some], ending[:, some]
        inside = np.zeros((len(some), length + 2), bool)
        run = gain[-1]
        for t in range(length - 1, -1, -1):
            run = gain[t] + np.maximum(run + stay, leave) if t < length - 1 else run
            inside[:, t + 1] = ending[t] + run - gain[t] > 0
        window, start = np.nonzero(inside[:, 1:] & ~inside[:, :-1])
        _, end = np.nonzero(inside[:, :-1] & ~inside[:, 1:])
        return list(zip(some[window].tolist(), np.maximum(start - 1, 0).tolist(), np.minimum(end + 1, length).tolist()))

    def _sums(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The CRF's forward and backward sums and the logarithm of the total, for emissions."""
        a, length = self.w["step"], e.shape[1]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, length):
            alpha[:, t] = e[:, t] + _logsum(alpha[:, t - 1, :, None] + a, 1)
        for t in range(length - 2, -1, -1):
            beta[:, t] = _logsum(a + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        return alpha, beta, _logsum(alpha[:, -1], 1)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of windows with labels y, and its gradients."""
        n, length = x.shape
        states, held = self._states(x, True)
        e, a = states @ self.w["out"] + self.w["out_bias"], self.w["step"]
        labels = a.shape[0]
        alpha, beta, z = self._sums(e)
        rows = np.arange(n)[:, None]
        gold = e[rows, np.arange(length), y].sum(1) + a[y[:, :-1], y[:, 1:]].sum(1)
        de = np.exp(alpha + beta - z[:, None, None])
        de[rows, np.arange(length), y] -= 1
        de /= n
        pairs = np.exp(alpha[:, :-1, :, None] + a + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
        np.subtract.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        grad = {"step": pairs / n, "out_bias": de.sum(axis=(0, 1)), "out": states.reshape(-1, states.shape[2]).T @ de.reshape(-1, labels)}
        # back through both LSTMs
        hidden = self.w["inner"].shape[1]
        ds = (de @ self.w["out"].T).transpose(1, 0, 2)
        dh_out = np.stack([ds[:, :, :hidden], ds[::-1, :, hidden:]])
        both = np.stack([x, x[:, ::-1]])
        dh, dc = np.zeros((2, n, hidden), np.float32), np.zeros((2, n, hidden), np.float32)
        back = self.w["inner"].transpose(0, 2, 1)
        slopes = np.empty((2, length, n, 4 * hidden), de.dtype)
        for t in range(length - 1, -1, -1):
            _, c, i, f, o, g, tanh_c = held[t]
            dh = dh + dh_out[:, t]
            dc = dc + dh * o * (1 - tanh_c**2)
            dg = slopes[:, t]
            np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tanh_c * o * (1 - o), dc * i * (1 - g**2)], axis=2, out=dg)
            dh, dc = np.matmul(dg, back), dc * f
        flat = slopes.reshape(2, length * n, -1)
        entered = np.stack([h[0] for h in held], axis=1).reshape(2, length * n, hidden)
        classes = np.arange(self.w["table"].shape[1])
        table = np.stack([(classes[:, None] == both[d].T.ravel()).astype(de.dtype) @ flat[d] for d in (0, 1)])
        return float((z - gold).mean()), grad | {"table": table, "inner": np.matmul(entered.transpose(0, 2, 1), flat), "bias": flat.sum(axis=1, keepdims=True)}

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> float:
        """The last steps' mean loss."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses = []
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(x), batch)
            loss, grad = self.gradients(x[rows], y[rows])
            losses.append(loss)
            size = sum(float((g**2).sum()) for g in grad.values()) ** 0.5
            now = rate * (1 if step < 0.75 * steps else 0.2)
            for k, g in grad.items():
                g = g * min(1, 100 / max(size, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g**2
                self.w[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return float(np.mean(losses[-20:]))

    def _best(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best labels for emissions, characters x labels x stretches, and the probability of each."""
        a = self.w["step"][:, :, None]
        length, labels, n = e.shape
        score, back = e[0], np.empty((length, labels, n), np.int8)
        for t in range(1, length):
            total = score[:, None] + a
            back[t] = total.argmax(axis=0)
            score = total.max(axis=0) + e[t]
        best, every = np.empty((length, n), np.int64), np.arange(n)
        best[-1] = score.argmax(axis=0)
        for t in range(length - 1, 0, -1):
            best[t - 1] = back[t][best[t], every]
        sure = np.ones((length, n), np.float32)
        some = np.flatnonzero(best.any(axis=0))
        if len(some):  # what comes before and after each character, scaled to a sum of 1
            weight, step = np.exp(e[:, :, some] - e[:, :, some].max(axis=1, keepdims=True)), np.exp(self.w["step"])
            before, after = np.empty_like(weight), np.ones_like(weight)
            before[0] = weight[0] / weight[0].sum(axis=0)
            for t in range(1, length):
                now = (step.T @ before[t - 1]) * weight[t]
                before[t] = now / now.sum(axis=0)
            for t in range(length - 2, -1, -1):
                now = step @ (weight[t + 1] * after[t + 1])
                after[t] = now / now.sum(axis=0)
            both = before * after
            sure[:, some] = np.take_along_axis(both / both.sum(axis=1, keepdims=True), best[:, None, some], 1)[:, 0]
        return best, sure

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best labels of each window, and the probability of each; 1 beyond the stretches that may have any but 0."""
        e = self.emissions(x)
        best, sure = np.zeros(x.shape, np.int64), np.ones(x.shape, np.float32)
        todo = sorted(self._stretches(e), key=lambda s: s[2] - s[1])
        at = 0
        while at < len(todo):
            _, start, end = todo[min(at + 1023, len(todo) - 1)]
            part = todo[at : at + max(1, min(1024, 200_000 // (end - start + 1)))]
            at += len(part)
            longest = max(end - start for _, start, end in part)
            rows = np.zeros((longest + 1, e.shape[0], len(part)), np.float32)
            rows[:, 1:] = -1e4
            for k, (window, start, end) in enumerate(part):
                rows[: end - start, :, k] = e[:, start:end, window].T
                if start:  # label 0, as before it
                    rows[0, 1:, k] = -1e4
            labels, chance = self._best(rows)
            for k, (window, start, end) in enumerate(part):
                best[window, start:end], sure[window, start:end] = labels[: end - start, k], chance[: end - start, k]
        return best, sure
