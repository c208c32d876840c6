"""A linear-chain conditional random field over hashed features, in numpy.

Sequences are padded side by side, so that forward-backward is a loop over
positions and not over sequences. Edges are of two kinds (0: within a sentence,
1: across a boundary), each with its own transition weights.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Chain:
    labels: int
    bits: int = 18
    weights: np.ndarray = field(default=None)  # type: ignore[assignment]
    edges: np.ndarray = field(default=None)  # type: ignore[assignment]

    def __post_init__(self) -> None:
        if self.weights is None:
            self.weights = np.zeros((1 << self.bits, self.labels), dtype=np.float32)
            self.edges = np.zeros((2, self.labels, self.labels), dtype=np.float32)

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """Scores (..., labels) of features (..., n); -1: no feature."""
        w = self.weights[features]
        w[features < 0] = 0
        return w.sum(axis=-2)

    def marginals(self, scores: np.ndarray, edge: np.ndarray, mask: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """P(label at position) of scores (batch, length, labels); edge: the kind of the edge into each position; mask: positions that exist, from the left.

        pairs: also the sums of the pairwise marginals by kind of edge.
        """
        n, length, k = scores.shape
        if k == 2:
            return self._two(scores, edge, mask, pairs)
        e = np.exp(scores - scores.max(axis=2, keepdims=True)).astype(np.float32)
        t = np.exp(self.edges - self.edges.max())
        alpha = np.zeros((length, n, k), dtype=np.float32)
        a = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        alpha[0] = a
        for i in range(1, length):
            step = np.where(edge[:, i, None] == 1, a @ t[1], a @ t[0]) * e[:, i]
            step /= step.sum(axis=1, keepdims=True) + 1e-30
            a = np.where(mask[:, i, None], step, a)
            alpha[i] = a
        beta = np.ones((n, k), dtype=np.float32)
        out = np.zeros((n, length, k), dtype=np.float32)
        xi = np.zeros((2, k, k), dtype=np.float64) if pairs else None
        for i in range(length - 1, -1, -1):
            g = alpha[i] * beta
            g /= g.sum(axis=1, keepdims=True) + 1e-30
            out[:, i] = g
            if i == 0:
                break
            v = e[:, i] * beta
            if pairs:
                for kind in (0, 1):
                    at = mask[:, i] & (edge[:, i] == kind)
                    if at.any():
                        p = alpha[i - 1][at][:, :, None] * t[kind][None] * v[at][:, None, :]
                        xi[kind] += (p / (p.sum(axis=(1, 2), keepdims=True) + 1e-30)).sum(axis=0)
            b = np.where(edge[:, i, None] == 1, v @ t[1].T, v @ t[0].T)
            b /= b.sum(axis=1, keepdims=True) + 1e-30
            beta = np.where(mask[:, i, None], b, beta)
        return out, xi

    def _two(self, scores: np.ndarray, edge: np.ndarray, mask: np.ndarray, pairs: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """The same for two labels: messages are odds of the second label, so that a step is a few operations on a vector."""
        n, length, _ = scores.shape
        lean = np.clip(scores[:, :, 1] - scores[:, :, 0], -60, 60).astype(np.float64).T
        e, kind, here = np.exp(lean), edge.T == 1, mask.T
        t = np.exp(self.edges.astype(np.float64) - float(self.edges.max()))
        (a, b), (c, d) = (np.where(kind, t[1, i, j], t[0, i, j]) for i, j in ((0, 0), (0, 1))), (np.where(kind, t[1, i, j], t[0, i, j]) for i, j in ((1, 0), (1, 1)))
        before, after = np.empty((length, n)), np.ones((length, n))
        r = before[0] = e[0]
        for i in range(1, length):
            r = before[i] = np.where(here[i], e[i] * (b[i] + r * d[i]) / (a[i] + r * c[i]), r)
        s = after[length - 1]
        for i in range(length - 1, 0, -1):
            v = e[i] * s
            s = after[i - 1] = np.where(here[i], (c[i] + d[i] * v) / (a[i] + b[i] * v), s)
        odds = before * after
        p = odds / (1 + odds)
        out = np.stack([1 - p, p], axis=2).astype(np.float32).transpose(1, 0, 2)
        if not pairs:
            return out, None
        xi = np.zeros((2, 2, 2))
        r, v = before[:-1], e[1:] * after[1:]
        cells = [a[1:], b[1:] * v, r * c[1:], r * d[1:] * v]
        total = sum(cells)
        for q in (0, 1):
            at = here[1:] & (kind[1:] == bool(q))
            xi[q] = np.array([(x[at] / total[at]).sum() for x in cells]).reshape(2, 2)
        return out, xi

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-5, batch: int = 64, seed: int = 7) -> Chain:
        """sequences: features (length, n), kind of the edge into each position, label of each position. AdaGrad on the log likelihood."""
        rng = np.random.default_rng(seed)
        sequences = [s for s in sequences if len(s[2])]
        square, edge_square = np.full(self.weights.shape, 1e-2, dtype=np.float32), np.full(self.edges.shape, 1e-2)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i][2]))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        k = self.labels
        for _ in range(epochs):
            rng.shuffle(groups)
            for g in groups:
                length = max(len(sequences[i][2]) for i in g)
                width = max(sequences[i][0].shape[1] for i in g)
                f = np.full((len(g), length, width), -1, dtype=np.int64)
                edge = np.zeros((len(g), length), dtype=np.int8)
                y = np.zeros((len(g), length), dtype=np.int64)
                mask = np.zeros((len(g), length), dtype=bool)
                for r, i in enumerate(g):
                    x, c, lab = sequences[i]
                    f[r, : len(lab), : x.shape[1]], edge[r, : len(lab)], y[r, : len(lab)], mask[r, : len(lab)] = x, c, lab, True
                p, xi = self.marginals(self.emissions(f), edge, mask, pairs=True)
                d = p
                r, c = np.nonzero(mask)
                d[r, c, y[r, c]] -= 1
                flat, grad = f[mask], d[mask]
                has = flat >= 0
                ids, back = np.unique(flat[has], return_inverse=True)
                rows = np.broadcast_to(np.arange(len(flat))[:, None], flat.shape)[has]
                total = np.zeros((len(ids), k), dtype=np.float32)
                for j in range(k):
                    total[:, j] = np.bincount(back, weights=grad[rows, j], minlength=len(ids))
                total += decay * len(g) * self.weights[ids]
                square[ids] += total**2
                self.weights[ids] -= rate * total / np.sqrt(square[ids])
                gold = np.zeros_like(xi)
                for kind in (0, 1):
                    at = mask[:, 1:] & (edge[:, 1:] == kind)
                    np.add.at(gold[kind], (y[:, :-1][at], y[:, 1:][at]), 1)
                step = xi - gold + decay * self.edges
                edge_square += step**2
                self.edges -= (rate * step / np.sqrt(edge_square)).astype(np.float32)
        return self


def batches(lengths: list[int], most: int = 60_000) -> list[list[int]]:
    """Sequences of like length put together so that a padded batch holds about so many positions."""
    order = sorted((i for i in range(len(lengths)) if lengths[i]), key=lambda i: lengths[i])
    out: list[list[int]] = []
    for i in order:
        if out and (len(out[-1]) + 1) * lengths[i] <= most:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def hashed(keys: list[str], bits: int) -> list[int]:
    """Feature numbers of feature names; the same in every process."""
    import xxhash

    m = (1 << bits) - 1
    return [xxhash.xxh3_64_intdigest(k) & m for k in keys]
