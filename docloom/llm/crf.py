"""A linear-chain conditional random field in numpy: training by gradient, decoding by Viterbi in batches.

A token is described by features of its own and of its neighbours, each at its
offset. As the score of a feature depends on the token's type alone, scores are
kept per type and offset, and a text is scored by gathering rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

OFFSETS = (-3, -2, -1, 0, 1, 2)
PAD = "\0"


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Model:
    """Weights of features by offset and label, transitions, and which labels may begin."""

    def __init__(self, labels: Sequence[str], vocabulary: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.labels, self.vocabulary, self.weights, self.moves = list(labels), vocabulary, weights, moves


def train(
    sequences: list[tuple[list[str], list[str]]],
    features: Callable[[str], list[str]],
    labels: Sequence[str],
    allowed: Callable[[str, str], bool],
    epochs: int = 12,
    batch: int = 48,
    rate: float = 0.12,
    decay: float = 2e-5,
    least: int = 2,
    seed: int = 7,
) -> Model:
    """Fits a model to (tokens, labels) pairs by Adam on the conditional log-likelihood with weight decay.

    A feature counts if it stands at ``least`` tokens of the table.
    """
    index = {label: i for i, label in enumerate(labels)}
    counts: dict[str, int] = {}
    cached: dict[str, list[str]] = {PAD: ["pad"]}
    for tokens, _ in sequences:
        for token in tokens:
            if token not in cached:
                cached[token] = features(token)
            for name in cached[token]:
                counts[name] = counts.get(name, 0) + 1
    counts["pad"] = least
    vocabulary = {name: i for i, name in enumerate(sorted(n for n, c in counts.items() if c >= least))}
    width = max(len(v) for v in cached.values())
    types = {t: i for i, t in enumerate(cached)}
    nothing = len(vocabulary)
    table = np.full((len(types), width), nothing)
    for t, i in types.items():
        known = [vocabulary[n] for n in cached[t] if n in vocabulary]
        table[i, : len(known)] = known
    size, n_off = len(labels), len(OFFSETS)
    weights = np.zeros((n_off, nothing + 1, size))
    forbidden = np.array([[0.0 if allowed(a, b) else -1e4 for b in labels] for a in labels])
    moves = forbidden.copy()
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    rng = np.random.default_rng(seed)
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i][0]))
    batches = [order[i : i + batch] for i in range(0, len(order), batch)]
    reach = max(-OFFSETS[0], OFFSETS[-1])
    packed = []
    for rows in batches:
        longest = max(len(sequences[i][0]) for i in rows)
        ids = np.full((len(rows), longest + 2 * reach), types[PAD])
        gold = np.zeros((len(rows), longest), dtype=np.int64)
        mask = np.zeros((len(rows), longest), dtype=bool)
        for r, i in enumerate(rows):
            tokens, marks = sequences[i]
            ids[r, reach : reach + len(tokens)] = [types[t] for t in tokens]
            gold[r, : len(marks)] = [index[m] for m in marks]
            mask[r, : len(marks)] = True
        used, local = np.unique(ids, return_inverse=True)
        packed.append((local.reshape(ids.shape), table[used], gold, mask))
    step = 0
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs) + 0.004
        for which in rng.permutation(len(packed)):
            ids, names, gold, mask = packed[which]
            rows, longest = gold.shape
            by_type = [weights[o][names].sum(axis=1) for o in range(n_off)]
            score = sum(by_type[o][ids[:, reach + off : reach + off + longest]] for o, off in enumerate(OFFSETS))
            alpha, beta = np.empty_like(score), np.zeros_like(score)
            alpha[:, 0] = score[:, 0]
            for t in range(1, longest):
                nxt = _logsumexp(alpha[:, t - 1, :, None] + moves, 1) + score[:, t]
                alpha[:, t] = np.where(mask[:, t, None], nxt, alpha[:, t - 1])
            for t in range(longest - 2, -1, -1):
                prv = _logsumexp(moves[None] + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(mask[:, t + 1, None], prv, beta[:, t + 1])
            total = _logsumexp(alpha[:, -1], 1)
            there = mask[..., None]
            soft = np.where(there, np.exp(np.minimum(alpha + beta - total[:, None, None], 0)), 0)
            hard = np.zeros_like(soft)
            hard[np.arange(rows)[:, None], np.arange(longest)[None], gold] = 1
            delta = (hard * there - soft) / rows
            gm = np.zeros_like(moves)
            for t in range(1, longest):
                live = mask[:, t]
                if live.any():
                    joint = alpha[live, t - 1, :, None] + moves + (score[live, t] + beta[live, t])[:, None, :] - total[live, None, None]
                    gm -= np.exp(np.minimum(joint, 0)).sum(axis=0) / rows
                    np.add.at(gm, (gold[live, t - 1], gold[live, t]), 1 / rows)
            gw = np.zeros_like(weights)
            flat = delta.reshape(-1, size)
            for o, off in enumerate(OFFSETS):
                where = ids[:, reach + off : reach + off + longest].reshape(-1)
                by = np.stack([np.bincount(where, flat[:, k], len(names)) for k in range(size)], axis=1)
                np.add.at(gw[o], names.ravel(), np.repeat(by, width, axis=0))
            step += 1
            for value, grad, m, v in ((weights, gw - decay * weights, state[0], state[1]), (moves, np.where(forbidden < 0, 0, gm), state[2], state[3])):
                m *= 0.9
                m += 0.1 * grad
                v *= 0.99
                v += 0.01 * grad * grad
                value += pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            weights[:, nothing] = 0
    return Model(labels, vocabulary, weights.astype(np.float32), moves.astype(np.float32))


class Decoder:
    """Viterbi over token lists. Types are learnt as they come; the table is begun anew beyond ``keep`` types, which changes no result."""

    def __init__(self, model: Model, features: Callable[[str], list[str]], keep: int = 400_000):
        self.model, self.features, self.keep = model, features, keep
        self.size = len(model.labels)
        self.outside = model.labels.index("O") if "O" in model.labels else 0
        #: begin and inside labels of each kind, which may not be parted
        self.parts = [(model.labels.index(b), model.labels.index("I" + b[1:])) for b in model.labels if b[:2] == "B-" and "I" + b[1:] in model.labels]
        self._bounds()
        self._reset()

    def _bounds(self) -> None:
        """What the moves of a best path can gain at most by a label other than outside.

        ``gain``: over being outside at that token alone. ``anew``: over being
        outside where an inside label follows, which then has to begin anew.
        """
        moves, o = self.model.moves.astype(np.float64), self.outside
        fine = moves > -1e3
        inside = np.zeros(self.size, dtype=bool)
        inside[[i for _, i in self.parts]] = True
        into = np.where(fine, moves - moves[:, [o]], -np.inf).max(axis=0)
        out_of = np.where(fine & ~inside[None], moves - moves[[o]], -np.inf).max(axis=1)
        self.gain = (into + out_of + 1e-3).astype(np.float32)
        self.anew = []
        for b, i in self.parts:
            rest = np.where(fine[i], moves[i] - moves[b], -np.inf).max()
            for x in (b, i):
                if fine[x, i]:
                    self.anew.append((x, b, i, np.float32(into[x] + moves[x, i] - moves[o, b] + rest + 1e-3)))

    def _reset(self) -> None:
        self.types: dict[str, int] = {}
        self.scores = np.zeros((1024, len(OFFSETS), self.size), dtype=np.float32)
        self._id(PAD)

    def _id(self, token: str) -> int:
        i = self.types[token] = len(self.types)
        if i >= len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        names = ["pad"] if token == PAD else self.features(token)
        known = [self.model.vocabulary[n] for n in names if n in self.model.vocabulary]
        self.scores[i] = self.model.weights[:, known].sum(axis=1) if known else 0
        return i

    def ids(self, tokens: list[str]) -> np.ndarray:
        if len(self.types) > self.keep:
            self._reset()
        types = self.types
        for token in set(tokens):
            if token not in types:
                self._id(token)
        return np.fromiter(map(types.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def decode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Labels of all tokens of several texts, one after the other, and where each text begins."""
        reach = max(-OFFSETS[0], OFFSETS[-1])
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        flat: list[str] = [PAD] * reach
        for t in texts:
            flat += t
            flat += [PAD] * reach
        ids = self.ids(flat)
        begin = np.cumsum(lengths + reach) - lengths  # place of each text's first token in flat
        n = len(ids)
        score = np.zeros((n, self.size), dtype=np.float32)
        for o, off in enumerate(OFFSETS):
            lo, hi = max(0, -off), min(n, n - off)
            score[lo:hi] += self.scores[ids[lo + off : hi + off], o]
        # a token that can't gain by another label is outside in every best path, and parts the rest into runs
        out_score = score[:, self.outside]
        best = np.full(n, -np.inf, dtype=np.float32)
        for x in range(self.size):
            if x != self.outside:
                np.maximum(best, score[:, x] + self.gain[x], out=best)
        for x, b, i, more in self.anew:
            np.maximum(best[:-1], score[:-1, x] + (score[1:, i] - score[1:, b] + more), out=best[:-1])
        live = best >= out_score
        live[ids == self.types[PAD]] = False
        out = np.full(n, self.outside, dtype=np.int8)
        if live.any():
            edges = np.flatnonzero(np.diff(np.concatenate(([False], live, [False])).astype(np.int8)))
            self._runs(score, edges[0::2], edges[1::2], out)
        keep = np.ones(n, dtype=bool)
        keep[:reach] = False
        for k in range(reach):
            keep[begin + lengths + k] = False
        return out[keep], np.concatenate(([0], np.cumsum(lengths)))

    def _runs(self, score: np.ndarray, starts: np.ndarray, ends: np.ndarray, out: np.ndarray) -> None:
        """Best labels of runs that have "outside" (or nothing) on both sides, all of them at once, step by step; ended runs drop out."""
        moves, outside = self.model.moves, self.outside
        order = np.argsort(starts - ends, kind="stable")
        first, many = starts[order], (ends - starts)[order]
        active = np.searchsorted(-many, -np.arange(int(many[0]) + 1), side="left")
        best = moves[outside] + score[first]
        back: list[np.ndarray] = [np.zeros((0, self.size), dtype=np.int8)]
        for t in range(1, int(many[0])):
            k = int(active[t])
            here = best[:k, :, None] + moves
            came = here.argmax(axis=1)
            best[:k] = np.take_along_axis(here, came[:, None, :], axis=1)[:, 0] + score[first[:k] + t]
            back.append(came.astype(np.int8))
        last = (best + moves[:, outside]).argmax(axis=1)
        for t in range(int(many[0]) - 1, -1, -1):
            k = int(active[t])
            out[first[:k] + t] = last[:k]
            if t:
                last[:k] = back[t][np.arange(k), last[:k]]
