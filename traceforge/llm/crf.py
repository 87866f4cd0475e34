"""A linear-chain conditional random field over sequences of sparse binary features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Weights: of features by label, of label pairs, and of the first label."""

    features: dict[str, int]
    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    def scores(self, sequence: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(sequence), self.emission.shape[1]))
        for i, fs in enumerate(sequence):
            known = [self.features[f] for f in fs if f in self.features]
            if known:
                out[i] = self.emission[known].sum(axis=0)
        return out

    def decode(self, sequence: list[list[str]]) -> list[int]:
        """The most probable labels, by Viterbi; the lower label wins a tie."""
        if not sequence:
            return []
        e = self.scores(sequence)
        best, back = self.start + e[0], []
        for i in range(1, len(e)):
            step = best[:, None] + self.transition
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + e[i]
        labels = [int(best.argmax())]
        for b in reversed(back):
            labels.append(int(b[labels[-1]]))
        return labels[::-1]


def train(sequences: list[list[list[str]]], labels: list[list[int]], n_labels: int = 2, rounds: int = 120, rate: float = 0.3, decay: float = 1e-3, seen: int = 2) -> Chain:
    """Maximum likelihood with an L2 penalty by AdaGrad on the whole set; all sequences step together."""
    counts: dict[str, int] = {}
    for s in sequences:
        for fs in s:
            for f in fs:
                counts[f] = counts.get(f, 0) + 1
    features = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= seen))}
    pages, longest = len(sequences), max(map(len, sequences))
    where, which = [], []
    gold = np.full((pages, longest), -1)
    for p, (s, y) in enumerate(zip(sequences, labels)):
        gold[p, : len(y)] = y
        for t, fs in enumerate(s):
            known = [features[f] for f in fs if f in features]
            where += [p * longest + t] * len(known)
            which += known
    where, which = np.array(where), np.array(which)
    real = gold >= 0
    length = real.sum(axis=1)
    emission, transition, start = np.zeros((len(features), n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)
    sums = [np.full_like(w, 1e-8) for w in (emission, transition, start)]
    hot = np.zeros((pages, longest, n_labels))
    hot[np.nonzero(real)[0], np.nonzero(real)[1], gold[real]] = 1
    pairs = real[:, 1:] & real[:, :-1]
    gold_pairs = np.zeros((n_labels, n_labels))
    np.add.at(gold_pairs, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    for _ in range(rounds):
        e = np.zeros((pages * longest, n_labels))
        for k in range(n_labels):
            e[:, k] = np.bincount(where, emission[which, k], minlength=pages * longest)
        e = e.reshape(pages, longest, n_labels)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = start + e[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.where(real[:, t, None], total(alpha[:, t - 1, :, None] + transition, 1) + e[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(real[:, t + 1, None], total(transition + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        z = total(alpha[np.arange(pages), length - 1], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * real[..., None]
        edge = np.exp(alpha[:, :-1, :, None] + transition + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[..., None, None]
        diff = (hot - node).reshape(-1, n_labels)
        grads = [
            np.stack([np.bincount(which, diff[where, k], minlength=len(features)) for k in range(n_labels)], axis=1) / pages - decay * emission,
            (gold_pairs - edge.sum(axis=(0, 1))) / pages - decay * transition,
            (hot[:, 0] - node[:, 0]).sum(axis=0) / pages - decay * start,
        ]
        for w, g, s in zip((emission, transition, start), grads, sums):
            s += g * g
            w += rate * g / np.sqrt(s)
    return Chain(features, emission, transition, start)
