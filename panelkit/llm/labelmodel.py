"""A generative model of voters: how often each is right, which go together, and what their votes say.

Every item has a hidden class (0 or 1) and a vote, yes or no, of each of a few voters.
Within a class votes follow a log-linear model: a rate for each voter and, for pairs
that agree more than the classes explain, a correlation weight.  Pairs are added one by
one, the worst explained first, each time with a new fit: added all at once, they would
take over what the classes explain.  All patterns of votes
can be listed (``2**voters``), so that the model is fitted exactly, by expectation
maximisation with Newton steps, from a count of each pattern; no true class is seen."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MAX_VOTERS = 14
ROUNDS = 60
TIED, TIES = 0.02, 8  # a pair gets a weight of its own where the model misses their correlation by so much; so many pairs at most
PULL = 1.0  # of the weights towards 0, in items; keeps rates of 0 and 1 finite


def all_votes(voters: int) -> np.ndarray:
    """(2**voters, voters): the votes of every pattern, bit j for voter j."""
    if voters > MAX_VOTERS:
        raise ValueError(f"{voters} voters: patterns of at most {MAX_VOTERS} are listed")
    return (np.arange(1 << voters)[:, None] >> np.arange(voters) & 1).astype(float)


@dataclass
class LabelModel:
    """``rates``: (2, voters) chance of a yes by class; ``pairs``: correlated voters and ``ties`` their weights;
    ``prior``: share of class 1; ``posterior``: chance of class 1 by pattern."""

    rates: np.ndarray
    pairs: list[tuple[int, int]]
    ties: np.ndarray
    prior: float
    posterior: np.ndarray


def _design(votes: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """(2, patterns, weights): a weight for each voter and class, and one for each pair."""
    m, k = votes.shape[1], len(pairs)
    out = np.zeros((2, len(votes), 2 * m + k))
    for y in (0, 1):
        out[y, :, y * m: (y + 1) * m] = votes
        for e, (a, b) in enumerate(pairs):
            out[y, :, 2 * m + e] = votes[:, a] * votes[:, b]
    return out


def _log_parts(design: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(2, patterns) log probability of a pattern within each class."""
    s = design @ w
    top = s.max(axis=1, keepdims=True)
    return s - top - np.log(np.exp(s - top).sum(axis=1, keepdims=True))


def _posterior(parts: np.ndarray, prior: float) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(parts[0] + np.log1p(-prior) - parts[1] - np.log(prior), -50, 50)))


def _newton(design: np.ndarray, w: np.ndarray, counts: np.ndarray, q: np.ndarray, steps: int = 2) -> np.ndarray:
    """Steps towards the weights that fit the counts, shared out to the classes by ``q``."""
    share = np.array([counts * (1 - q), counts * q])
    for _ in range(steps):
        p = np.exp(_log_parts(design, w))
        slope, bend = -PULL * w, PULL * np.eye(len(w))
        for y in (0, 1):
            n, mean = share[y].sum(), p[y] @ design[y]
            slope = slope + share[y] @ design[y] - n * mean
            off = design[y] - mean
            bend = bend + n * (off.T * p[y]) @ off
        w = w + np.clip(np.linalg.solve(bend, slope), -2, 2)
    return w


def _fit(votes: np.ndarray, counts: np.ndarray, pairs: list[tuple[int, int]], q: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    design = _design(votes, pairs)
    w, total = np.zeros(design.shape[2]), counts.sum()
    for _ in range(ROUNDS):
        prior = min(max(float(counts @ q / total), 1e-6), 1 - 1e-6)
        w = _newton(design, w, counts, q)
        new = _posterior(_log_parts(design, w), prior)
        moved, q = np.abs(counts * (new - q)).sum() / total, new
        if moved < 1e-7:
            break
    return w, prior, q


def _worst_pair(votes: np.ndarray, counts: np.ndarray, pairs: list[tuple[int, int]], w: np.ndarray, prior: float) -> tuple[float, tuple[int, int]]:
    """How much of the correlation of some pair the model misses at worst, and which pair that is."""
    parts = np.exp(_log_parts(_design(votes, pairs), w))
    model, seen = (1 - prior) * parts[0] + prior * parts[1], counts / counts.sum()
    mean = seen @ votes
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-4))  # a voter that hardly ever votes ties with nobody
    miss = np.abs((votes.T * (seen - model)) @ votes) / np.outer(sd, sd)
    miss[np.tril_indices(len(miss))] = 0
    for p in pairs:
        miss[p] = 0
    a, b = np.unravel_index(int(miss.argmax()), miss.shape)
    return float(miss[a, b]), (int(a), int(b))


def fit(counts: np.ndarray, voters: int, guess: np.ndarray) -> LabelModel:
    """``counts``: items by pattern; ``guess``: a first chance of class 1 by pattern, which says which class is which."""
    votes, counts, pairs = all_votes(voters), counts.astype(float), []
    if not counts.any():
        counts = np.ones(len(counts))
    while True:
        w, prior, q = _fit(votes, counts, pairs, guess)
        miss, pair = _worst_pair(votes, counts, pairs, w, prior)
        if miss < TIED or len(pairs) == TIES:
            break
        pairs = [*pairs, pair]
    parts = np.exp(_log_parts(_design(votes, pairs), w))
    return LabelModel(parts @ votes, pairs, w[2 * voters:], prior, q)
