"""A character-level bidirectional LSTM with CRF transitions, in numpy.

The network reads two characters a step (each with its own table of letters)
and gives one tag to both, so a text takes half the steps; spans are set to the
edges of words afterwards. Texts are cut into overlapping windows; emissions
are blended where windows overlap, and one path over the whole text is decoded
with the CRF transitions. A text begins and ends outside items (a blank step is
put before and after it). Texts in which no tag comes near are not decoded: the
bound of ``Tagger.bound`` proves that their best path has no span.
"""

from __future__ import annotations

import numpy as np

PAIR = 2  # characters of a step
WINDOW, STEP = 256, 224  # steps of a window, and from one window to the next
LETTERS, PAD = 128 + 0x60, 0


class Tagger:
    """The network: letter tables, two LSTM directions, a linear layer and CRF transitions; tag 0 is no item."""

    def __init__(self, tags: int, hidden: int = 8, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.w = {
            "x": rng.normal(0, 0.3, (2, PAIR * LETTERS, 4 * hidden)).astype(np.float32),
            "u": (rng.normal(0, 1, (2, hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32),
            "o": (rng.normal(0, 1, (2, hidden, tags)) / np.sqrt(2 * hidden)).astype(np.float32),
            "b": np.zeros(tags, np.float32),
            "t": np.zeros((tags, tags), np.float32),
        }
        self.w["x"][:, :, hidden : 2 * hidden] += 0.25  # remember at first

    def _forward(self, codes: np.ndarray) -> tuple[np.ndarray, list]:
        """Emissions of windows ``codes`` (rows x steps x characters), and what the gradients need."""
        n, size, _ = codes.shape
        codes = codes.astype(np.int64) + np.arange(PAIR) * LETTERS
        both = np.stack([codes, codes[:, ::-1]])
        h, c = np.zeros((2, n, self.h), np.float32), np.zeros((2, n, self.h), np.float32)
        out = np.empty((size, 2, n, self.h), self.w["x"].dtype)
        tape, d = [], self.h
        for t in range(size):
            g = np.matmul(h, self.w["u"])
            for s in (0, 1):
                for p in range(PAIR):
                    g[s] += self.w["x"][s][both[s, :, t, p]]
            g[..., : 3 * d] = np.tanh(g[..., : 3 * d] * 0.5) * 0.5 + 0.5
            g[..., 3 * d :] = np.tanh(g[..., 3 * d :])
            old, before = c, h
            c = g[..., d : 2 * d] * c + g[..., :d] * g[..., 3 * d :]
            tc = np.tanh(c)
            h = g[..., 2 * d : 3 * d] * tc
            out[t] = h
            tape.append((g, old, tc, before))
        emitted = np.matmul(out[:, 0], self.w["o"][0]) + np.matmul(out[::-1, 1], self.w["o"][1]) + self.w["b"]
        return emitted.transpose(1, 0, 2), [both, tape, out]

    def ready(self) -> dict[str, np.ndarray]:
        """The weights as inference wants them: one tanh serves all gates, states are doubled, features come first."""
        half = np.repeat(np.array([0.5, 0.5, 0.5, 1.0], np.float32), self.h)[:, None]
        return {
            "x": np.ascontiguousarray(self.w["x"].transpose(0, 2, 1)) * half,
            "u": np.ascontiguousarray(self.w["u"].transpose(0, 2, 1)) * half * np.float32(0.5),
            "o": np.ascontiguousarray(self.w["o"].transpose(0, 2, 1)) * np.float32(0.5),
        }

    def emissions(self, codes: np.ndarray, ready: dict[str, np.ndarray]) -> np.ndarray:
        """Emissions (tags x steps x rows) of windows ``codes`` (steps x rows): numbers into the table ``ready["pairs"]``."""
        size, n = codes.shape
        d = self.h
        u, pairs = ready["u"], ready["pairs"]
        h, c, tc, g = (np.zeros((2, k, n), np.float32) for k in (d, d, d, 4 * d))
        read = np.empty((4 * d, n), np.float32)
        out = np.empty((2, size, d, n), np.float32)
        for t in range(size):
            np.matmul(u, h, out=g)
            for s, at in ((0, t), (1, size - 1 - t)):
                np.take(pairs[s], codes[at], axis=1, out=read, mode="clip")
                g[s] += read
            np.tanh(g, out=g)
            gates = g[:, : 3 * d]
            gates += 1
            c *= gates[:, d : 2 * d]
            c += gates[:, :d] * g[:, 3 * d :]
            c *= 0.5
            np.tanh(c, out=tc)
            np.multiply(gates[:, 2 * d :], tc, out=h)
            out[0, t], out[1, size - 1 - t] = h[0], h[1]
        e = np.matmul(ready["o"][0], out[0]) + np.matmul(ready["o"][1], out[1])
        return e.transpose(1, 0, 2) + self.w["b"][:, None, None]

    def _gradients(self, codes: np.ndarray, tags: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        e, (both, tape, out) = self._forward(codes)
        n, size, k = e.shape
        # Forward and backward sums as probabilities, scaled at every step: a holds what comes before, b what follows.
        T = self.w["t"].astype(np.float64)
        M = np.exp(T)
        e64 = np.where(real[..., None], e, 0).astype(np.float64).transpose(1, 0, 2)
        top = e64.max(axis=2)
        E = np.exp(e64 - top[..., None])
        live = real.T[..., None]
        a, scale = np.empty((size, n, k)), np.ones((size, n, 1))
        scale[0] = E[0].sum(axis=1, keepdims=True)
        a[0] = E[0] / scale[0]
        for t in range(1, size):
            step = (a[t - 1] @ M) * E[t]
            scale[t] = np.where(live[t], step.sum(axis=1, keepdims=True), 1)
            a[t] = np.where(live[t], step / scale[t], a[t - 1])
        total = (np.log(scale[..., 0]) + top * real.T).sum(axis=0)
        b = np.ones((n, k))
        grad_e, grad_t = np.empty((size, n, k)), np.zeros((k, k))
        for t in range(size - 1, -1, -1):
            grad_e[t] = a[t] * b
            if t:
                ahead = np.where(live[t], E[t] * b / scale[t], 0)
                grad_t += (a[t - 1].T @ ahead) * M
                b = np.where(live[t], ahead @ M.T, b)
        tagged = np.eye(k)[tags.T]
        grad_e = (np.where(live, grad_e - tagged, 0)).transpose(1, 0, 2)
        pairs = real[:, 1:]
        np.subtract.at(grad_t, (tags[:, :-1][pairs], tags[:, 1:][pairs]), 1)
        gold = (e64 * tagged * live).sum() + (T[tags[:, :-1], tags[:, 1:]] * pairs).sum()
        ge = (grad_e / n).astype(np.float32).transpose(1, 0, 2)
        grads = {"t": (grad_t / n).astype(np.float32), "b": ge.sum(axis=(0, 1)), "o": np.stack([np.einsum("tnh,tnk->hk", out[:, 0], ge), np.einsum("tnh,tnk->hk", out[::-1, 1], ge)])}
        back = np.stack([np.matmul(ge, self.w["o"][0].T), np.matmul(ge, self.w["o"][1].T)[::-1]], axis=1)
        d = self.h
        gx, gu = np.zeros_like(self.w["x"]), np.zeros_like(self.w["u"])
        dh, dc = np.zeros((2, n, d), np.float32), np.zeros((2, n, d), np.float32)
        steps = np.empty((size, 2, n, 4 * d), self.w["x"].dtype)
        for t in range(size - 1, -1, -1):
            g, old, tc, before = tape[t]
            i, f, o, a = g[..., :d], g[..., d : 2 * d], g[..., 2 * d : 3 * d], g[..., 3 * d :]
            dh = dh + back[t]
            dc = dc + dh * o * (1 - tc * tc)
            dg = steps[t] = np.concatenate((dc * a * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - a * a)), axis=-1)
            gu += np.matmul(before.transpose(0, 2, 1), dg)
            dh = np.matmul(dg, self.w["u"].transpose(0, 2, 1))
            dc = dc * f
        for s in (0, 1):  # sums by letter: sorted once, then added run by run
            flat = steps[:, s].reshape(size * n, 4 * d)
            for p in range(PAIR):
                letter = both[s, :, :, p].T.ravel()
                order = np.argsort(letter, kind="stable")
                runs = np.flatnonzero(np.diff(letter[order], prepend=-1))
                gx[s][letter[order][runs]] += np.add.reduceat(flat[order], runs, axis=0)
        return float((total.sum() - gold) / n), grads | {"x": gx, "u": gu}

    def fit(self, codes: np.ndarray, tags: np.ndarray, real: np.ndarray, steps: int = 900, batch: int = 64, rate: float = 0.015, seed: int = 5) -> Tagger:
        """Adam over shuffled windows, ``steps`` batches whatever their number; of a batch only as many characters as its longest window."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        sizes, turn = real.sum(axis=1), []
        for step in range(1, steps + 1):
            if not turn:
                order = rng.permutation(len(codes))
                order = order[np.argsort(sizes[order] // 16, kind="stable")]  # windows of like length together
                turn = [order[at : at + batch] for at in rng.permutation(np.arange(0, len(order), batch))]
            pick = turn.pop()
            width = int(sizes[pick].max())
            self.loss, grads = self._gradients(codes[pick, :width], tags[pick, :width], real[pick, :width])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            pace = rate * (1 - 0.95 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for key, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[key] = 0.9 * m[key] + 0.1 * g
                v[key] = 0.999 * v[key] + 0.001 * g * g
                self.w[key] -= (pace * m[key] / (np.sqrt(v[key]) + 1e-8)).astype(np.float32)
        return self

    def bound(self) -> tuple[float, float]:
        """``(stay, cost)``: where the margins of the best tag over no item, each raised by ``stay``, have positive parts that sum to less than ``cost``, the best path has no span.

        A span gains at most the margins of its steps and ``stay`` for each transition inside it, and pays at least
        ``cost`` for the way in and out, as no text begins or ends in an item.
        """
        T = self.w["t"] - self.w["t"][0, 0]
        return max(0.0, float(T[1:, 1:].max())), float(-T[0, 1:].max() - T[1:, 0].max())

    def paths(self, e: np.ndarray) -> np.ndarray:
        """The best path over the emissions (tags x steps x rows) of several texts: a tag for each step and row."""
        k, size, n = e.shape
        T = self.w["t"]
        best = np.empty((size, k, n), np.float32)
        best[0] = e[:, 0]
        for t in range(1, size):
            np.max(best[t - 1][:, None, :] + T[:, :, None], axis=0, out=best[t])
            best[t] += e[:, t]
        out = np.zeros((size, n), np.uint8)
        out[-1] = best[-1].argmax(axis=0)
        for t in range(size - 1, 0, -1):
            out[t - 1] = (best[t - 1] + T[:, out[t]]).argmax(axis=0)
        return out

    def gain(self, e: np.ndarray, tag: int, begin: int, end: int) -> float:
        """By how much the path with the span scores above the path without it; ``e``: tags x steps."""
        T = self.w["t"] - self.w["t"][0, 0]
        return float((e[tag, begin:end] - e[0, begin:end]).sum() + (end - begin - 1) * T[tag, tag] + T[0, tag] + T[tag, 0])


_BLEND = (np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1.0).astype(np.float32)


def spans(letters: np.ndarray, sizes: np.ndarray, model: Tagger, lean: float = 0.0, rows: int = 384) -> list[list[tuple[int, int, int, float]]]:
    """For each text its decoded spans ``(tag, begin, end, gain)`` in characters.

    ``letters``: the codes of all texts, one after another, of ``sizes``
    characters each. ``lean`` is taken from the score of no item in decoding,
    not in ``gain``. Spans cover whole steps, so an edge may lie a character
    outside the item.
    """
    steps = -(-sizes // PAIR) + 2
    flat = np.full(int(steps.sum()) * PAIR, PAD, np.int64)
    begins, froms = np.cumsum(steps) - steps, np.cumsum(sizes) - sizes
    flat[np.repeat((begins + 1) * PAIR - froms, sizes) + np.arange(len(letters))] = letters
    pair = flat[::PAIR] * LETTERS + flat[1::PAIR]
    seen = np.zeros(LETTERS * LETTERS, np.int32)
    seen[pair] = 1
    known = np.flatnonzero(seen)  # the first is the blank step, number 0
    seen[known] = np.arange(len(known))
    ready = model.ready()
    ready["pairs"] = np.ascontiguousarray(ready["x"][:, :, known // LETTERS] + ready["x"][:, :, LETTERS + known % LETTERS])
    pair = seen[pair]
    counts = np.where(sizes > 0, np.maximum(1, -(-(steps - (WINDOW - STEP)) // STEP)), 0)
    row = np.repeat(np.arange(len(sizes)), counts)
    first = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * STEP
    lengths = np.minimum(WINDOW, steps[row] - first)
    order = np.argsort(-lengths, kind="stable")
    stay, cost = model.bound()
    reach, kept = np.zeros(len(sizes)), []
    for b in range(0, len(order), rows):
        some = order[b : b + rows]
        spot = np.arange(lengths[some[0]])[:, None]
        inside = spot < lengths[some]
        codes = np.where(inside, pair[np.minimum((begins[row[some]] + first[some]) + spot, len(pair) - 1)], 0)
        e = model.emissions(codes, ready)
        margin = e[1:].max(axis=0) - e[0] + np.float32(lean + stay)
        margin[~(inside & (codes > 0))] = -1e9
        run, best = np.zeros((2, len(some)), np.float32)
        for m in margin:  # the best sum of adjacent steps
            run += m
            np.maximum(run, 0, out=run)
            np.maximum(best, run, out=best)
        several = counts[row[some]] > 1
        best[several] = np.maximum(margin[:, several], 0).sum(axis=0)  # a span may cross windows, so all its positive steps count
        np.add.at(reach, row[some], best)
        kept.append((some, e))
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in sizes]
    near = reach >= cost
    parts: dict[int, list[tuple[int, np.ndarray]]] = {}  # tags x steps
    for some, e in kept:
        for at in np.flatnonzero(near[row[some]]):
            parts.setdefault(int(row[some[at]]), []).append((int(first[some[at]]), e[:, : lengths[some[at]], at]))
    wanted = sorted(parts, key=lambda r: -steps[r])
    for at in range(0, len(wanted), rows):
        some = wanted[at : at + rows]
        e = np.zeros((len(model.w["b"]), steps[some[0]], len(some)), np.float32)
        for i, r in enumerate(some):
            weight = np.zeros(steps[r], np.float32)
            for f, w in parts[r]:
                share = _BLEND[: w.shape[1]]
                e[:, f : f + w.shape[1], i] += w * share
                weight[f : f + w.shape[1]] += share
            e[:, : steps[r], i] /= weight
            e[1:, steps[r] - 1 :, i] = -1e9
        e[1:, 0] = -1e9
        e[0] -= lean
        tags = model.paths(e)
        e[0] += lean
        for i, b in zip(*(x.tolist() for x in np.nonzero(((tags[1:] != tags[:-1]) & (tags[1:] > 0)).T))):
            r, b, tag = some[i], b + 1, int(tags[b + 1, i])
            end = b + int(np.argmax(tags[b:, i] != tag))
            out[r].append((tag, (b - 1) * PAIR, min((end - 1) * PAIR, int(sizes[r])), model.gain(e[:, :, i], tag, b, end)))
    return out
