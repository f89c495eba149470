"""Recursions over many ragged sequences at once, in time that doesn't follow the longest one.

Sequences lie one after the other.  Each is cut to segments of bounded length
and all segments are stepped through together, so a text of a million words
costs no more steps than one of ``SEGMENT``.  The recursions are exact: of a
sequence with several segments the product of the steps of each is worked out
first (a matrix over the states), and their chain gives what every segment
starts from and what follows it.
"""

from __future__ import annotations

import numpy as np

#: Elements of a segment at most.
SEGMENT = 1024


class Packed:
    """The order in which the segments of sequences of ``counts`` elements are stepped through.

    ``order`` are the positions of all elements step by step, the longest
    segments first in each step; ``active`` is how many segments reach each step.
    """

    def __init__(self, counts: np.ndarray, segment: int = SEGMENT):
        counts = np.asarray(counts, np.int64)
        self.count = len(counts)
        parts = -(-counts // segment)
        sequence = np.repeat(np.arange(len(counts)), parts)
        number = np.arange(len(sequence)) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(counts[sequence] - number * segment, segment)
        by_length = np.argsort(-size, kind="stable")
        size = size[by_length]
        start = ((np.cumsum(counts) - counts)[sequence] + number * segment)[by_length]
        #: For each segment, longest first: its sequence, its number in it, and how many there are.
        self.sequence, self.number, self.parts = sequence[by_length], number[by_length], parts[sequence][by_length]
        longest = int(size[0]) if len(size) else 0
        self.active = len(size) - np.searchsorted(size[::-1], np.arange(longest), side="right")
        step = np.repeat(np.arange(longest), self.active)
        self.rank = np.arange(len(step)) - np.repeat(np.cumsum(self.active) - self.active, self.active)
        self.order = start[self.rank] + step
        self.size = size

    def _chain(self, phi: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each segment: the scaled state before it (0 for first ones), the weight of what follows it (1 for last ones)."""
        states, n = len(start), len(self.size)
        before, after = np.zeros((states, n)), np.ones((states, n))
        long = np.flatnonzero(self.parts > 1)
        if not len(long):
            return before, after, long
        # Segments of long sequences among the packed ones, still the longest first.
        place = np.full(n, -1)
        place[long] = np.arange(len(long))
        first = self.number[long] == 0
        # total[s, t, k]: from state s before segment k to state t at its end.
        total, at = np.zeros((states, states, len(long))), 0
        for k, m in enumerate(self.active.tolist()):
            own = place[:m]
            pick = np.flatnonzero(own >= 0)
            if not len(pick):
                break
            here = phi[:, at + pick]
            if k == 0:
                now = np.where(first[None, None, :], start[None, :, None], step[:, :, None]) * here[None]
            else:
                now = np.matmul(step.T, total[:, :, : len(pick)]) * here[None]
            total[:, :, : len(pick)] = now / now.sum(axis=(0, 1))
            at += m
        for one in np.unique(self.sequence[long]).tolist():
            own = np.flatnonzero(self.sequence[long] == one)
            own = own[np.argsort(self.number[long[own]])]
            state = total[0, :, own[0]]
            for k in own[1:].tolist():
                before[:, long[k]] = state / state.sum()
                state = before[:, long[k]] @ total[:, :, k]
            rest = np.ones(states)
            for back, k in zip(own[:0:-1].tolist(), own[-2::-1].tolist(), strict=True):
                rest = total[:, :, back] @ rest
                rest = rest / rest.sum()
                after[:, long[k]] = rest
        return before, after, long

    def forward(self, phi: np.ndarray, start: np.ndarray, step: np.ndarray, chain: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward recursion over packed emissions ``phi (states, n)``: the scaled alphas, and each element's scale.

        The logarithms of a sequence's scales sum to the logarithm of its exact likelihood.
        """
        before, _, long = chain or self._chain(phi, start, step)
        alpha, scale = np.empty_like(phi), np.empty(phi.shape[1])
        first = np.repeat(start[:, None], len(self.size), axis=1)
        later = long[self.number[long] > 0]
        first[:, later] = step.T @ before[:, later]
        at, last = 0, None
        turn = np.ascontiguousarray(step.T)
        for k, m in enumerate(self.active.tolist()):
            now = phi[:, at : at + m] * (first if k == 0 else turn @ last[:, :m])
            s = now.sum(axis=0)
            now /= s
            alpha[:, at : at + m] = last = now
            scale[at : at + m] = s
            at += m
        return alpha, scale

    def backward(self, phi: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """State marginals of each element, expected first states, expected steps between states, and the scales."""
        chain = self._chain(phi, start, step)
        before, after, long = chain
        alpha, scale = self.forward(phi, start, step, chain)
        marginal, pairs = np.empty_like(phi), np.zeros_like(step)
        ends = np.cumsum(self.active)
        beta = np.ones((len(start), 0))
        ahead = None
        for k in range(len(self.active) - 1, -1, -1):
            m, at = int(self.active[k]), int(ends[k] - self.active[k])
            old = beta.shape[1]
            if old < m:
                # Segments that end here; the weights of what follows are scaled as the rest is.
                new = after[:, old:m]
                beta = np.concatenate([beta, new / (new * alpha[:, at + old : at + m]).sum(axis=0)], axis=1)
            np.multiply(alpha[:, at : at + m], beta, out=marginal[:, at : at + m])
            ahead = phi[:, at : at + m] * beta
            ahead /= scale[at : at + m]
            if k:
                back = int(ends[k - 1] - self.active[k - 1])
                pairs += alpha[:, back : back + m] @ ahead.T
                beta = step @ ahead
        later = long[self.number[long] > 0]
        if len(later):
            pairs += before[:, later] @ ahead[:, later].T
        heads = marginal[:, : int(self.active[0])][:, self.number == 0].sum(axis=1) if len(self.active) else np.zeros(len(start))
        return marginal, heads, step * pairs, scale

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of packed ``values`` over each sequence."""
        return np.bincount(self.sequence[self.rank], weights=values, minlength=self.count)
