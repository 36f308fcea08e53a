"""Sums over the paths of a linear chain (random field or hidden Markov model) for many sequences at once.

Sequences are cut into short segments, whose transfer matrices are computed side by side. A pass over each sequence's
segments then gives the exact vector at every segment's start and end, and the places inside are filled in side by
side again. The result is that of the usual forward-backward recursion, scaled at each step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEGMENT = 32


@dataclass
class Segments:
    """Places of all sequences, laid out as (segments, SEGMENT); what lies behind a sequence's end is padding."""

    places: np.ndarray  # index of each place, 0 where padded
    real: np.ndarray  # False where padded
    first: np.ndarray  # first segment of each sequence, and the number of segments

    @classmethod
    def of(cls, bounds: np.ndarray) -> Segments:
        sizes = np.diff(bounds)
        counts = -(-sizes // SEGMENT)
        first = np.concatenate([[0], np.cumsum(counts)])
        owner = np.repeat(np.arange(len(sizes)), counts)
        start = bounds[owner] + (np.arange(first[-1]) - first[owner]) * SEGMENT
        places = start[:, None] + np.arange(SEGMENT)[None, :]
        real = places < bounds[owner + 1][:, None]
        return cls(np.where(real, places, 0), real, first)

    def steps(self):
        """For each round, the sequences that have a segment in it and that segment, longest sequences first."""
        counts = np.diff(self.first)
        order = np.argsort(-counts, kind="stable")
        counts = counts[order]
        for k in range(int(counts[0]) if len(counts) else 0):
            alive = order[: np.searchsorted(-counts, -k, side="left")]
            yield alive, self.first[alive] + k


def _normal(x: np.ndarray, axes) -> tuple[np.ndarray, np.ndarray]:
    total = x.sum(axis=axes, keepdims=True)
    total = np.where(total > 0, total, 1.0)
    return x / total, np.log(total).reshape(len(x))


def transfers(emit: np.ndarray, seg: Segments, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled product of ``trans`` and emissions over each segment, and the logarithm of its scale.

    ``emit`` is (segments, SEGMENT, states), with ones in the padding; padded places change nothing.
    """
    n, _, states = emit.shape
    out = np.broadcast_to(np.eye(states), (n, states, states)).copy()
    scale = np.zeros(n)
    for t in range(SEGMENT):
        here = np.flatnonzero(seg.real[:, t])
        if not len(here):
            break
        moved = (out[here].reshape(-1, states) @ trans).reshape(-1, states, states) * emit[here, t][:, None, :]
        if t % 4 == 3 or t == SEGMENT - 1:
            moved, grown = _normal(moved, (1, 2))
            scale[here] += grown
        out[here] = moved
    out, grown = _normal(out, (1, 2))
    return out, scale + grown


def starts(matrices: np.ndarray, scales: np.ndarray, seg: Segments, initial: np.ndarray):
    """Vector at the start of each segment, and the log of the path sum of each sequence.

    ``initial`` is the vector before the first transition.
    """
    sequences = len(seg.first) - 1
    now = np.broadcast_to(initial, (sequences, len(initial))).copy()
    total = np.zeros(sequences)
    begin = np.empty((len(matrices), len(initial)))
    for alive, at in seg.steps():
        begin[at] = now[alive]
        moved, grown = _normal(np.einsum("ns,nst->nt", now[alive], matrices[at]), 1)
        now[alive] = moved
        total[alive] += grown + scales[at]
    return begin, total


def ends(matrices: np.ndarray, seg: Segments) -> np.ndarray:
    """Backward vector at the end of each segment."""
    sequences, states = len(seg.first) - 1, matrices.shape[1]
    now = np.full((sequences, states), 1.0 / states)
    finish = np.empty((len(matrices), states))
    for alive, at in reversed(list(seg.steps())):
        finish[at] = now[alive]
        now[alive] = _normal(np.einsum("nst,nt->ns", matrices[at], now[alive]), 1)[0]
    return finish


def forward(emit: np.ndarray, seg: Segments, trans: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Scaled forward vectors (segments, SEGMENT, states), each summing to 1 over states."""
    out = np.empty_like(emit)
    now = begin
    for t in range(SEGMENT):
        now = (now @ trans) * emit[:, t]
        now = now / np.maximum(now.sum(axis=1, keepdims=True), 1e-300)
        out[:, t] = now
    return out


def backward(emit: np.ndarray, seg: Segments, trans: np.ndarray, finish: np.ndarray) -> np.ndarray:
    """Scaled backward vectors; padded places hand on what comes from behind them."""
    out = np.empty_like(emit)
    now = finish
    for t in reversed(range(SEGMENT)):
        out[:, t] = now
        before = (now * emit[:, t]) @ trans.T
        before = before / np.maximum(before.sum(axis=1, keepdims=True), 1e-300)
        now = np.where(seg.real[:, t][:, None], before, now)
    return out


def laid_out(scores: np.ndarray, seg: Segments) -> np.ndarray:
    """Rows of ``scores`` at their places, ones in the padding."""
    return np.where(seg.real[:, :, None], scores[seg.places], 1.0) if len(scores) else np.ones((*seg.real.shape, scores.shape[1]))


def marginals(scores: np.ndarray, bounds: np.ndarray, trans: np.ndarray, initial: np.ndarray) -> np.ndarray:
    """Probability of each state at each place, given all of its sequence. ``scores`` (places, states) are positive."""
    if not len(scores):
        return np.empty_like(scores)
    seg = Segments.of(bounds)
    emit = laid_out(scores, seg)
    matrices, scales = transfers(emit, seg, trans)
    begin, _ = starts(matrices, scales, seg, initial)
    both = forward(emit, seg, trans, begin) * backward(emit, seg, trans, ends(matrices, seg))
    both /= np.maximum(both.sum(axis=2, keepdims=True), 1e-300)
    return both[seg.real]


def log_sums(scores: np.ndarray, bounds: np.ndarray, trans: np.ndarray, initial: np.ndarray) -> np.ndarray:
    """Natural logarithm of the sum over all paths, per sequence; 0 for an empty one."""
    if not len(scores):
        return np.zeros(len(bounds) - 1)
    seg = Segments.of(bounds)
    matrices, scales = transfers(laid_out(scores, seg), seg, trans)
    return starts(matrices, scales, seg, initial)[1]
