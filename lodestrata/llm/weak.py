"""Weak supervision: expectation-maximisation over labelers' votes (driver side, numpy)."""

from __future__ import annotations

import numpy as np


def estimate(patterns: np.ndarray, counts: np.ndarray, known: np.ndarray | None = None, prior: float = 0.1, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns (Dawid and Skene's model; abstaining is a third answer).

    ``patterns`` (m x k) holds votes of 1, -1 or 0 (abstain), ``counts`` how many items have
    each pattern, ``known`` fixes the label of a pattern (1, -1) where it is not 0. Returns the
    posterior of the positive class for each pattern, the labelers' answer shares (k x 2 x 3:
    negatives and positives; votes -1, 0, 1), and the share of positives.

    A labeler begins as mostly right: its answers on either class have a weak prior of five
    items, three of which agree with the class.
    """
    m, k = patterns.shape
    known = np.zeros(m) if known is None else known
    p = np.where(known > 0, 1.0, np.where(known < 0, 0.0, 0.5 + 0.45 * np.sign(patterns.sum(1))))
    belief = np.array([[3.0, 1.0, 1.0], [1.0, 1.0, 3.0]])
    share = np.tile(belief / belief.sum(axis=1, keepdims=True), (k, 1, 1))
    answer = patterns.astype(int) + 1
    for _ in range(rounds):
        prior = float(np.clip((counts * p).sum() / max(counts.sum(), 1), 1e-4, 1 - 1e-4))
        new = np.empty_like(share)
        for j in range(k):
            for c, weight in ((0, counts * (1 - p)), (1, counts * p)):
                seen = np.bincount(answer[:, j], weights=weight, minlength=3) + belief[c]
                new[j, c] = seen / seen.sum()
        ratio = np.log(new[:, 1] / new[:, 0])
        log = np.log(prior / (1 - prior)) + ratio[np.arange(k)[None, :], answer].sum(axis=1)
        q = 1 / (1 + np.exp(-np.clip(log, -40, 40)))
        q = np.where(known > 0, 1.0, np.where(known < 0, 0.0, q))
        done = np.abs(q - p).max(initial=0) < 1e-7
        p, share = q, new
        if done:
            break
    return p, share, prior
