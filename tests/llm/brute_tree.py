"""The suffix tree in one process: the divergence test straight from its definition, and scores."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np

from feedloom.llm import suffix_tree as st


def retained(windows: Counter) -> set[tuple[int, int, int, int]]:
    """(depth, context, symbol, n) of the root and of every context whose followers differ from those of the context
    without its oldest code by more than chance."""
    followers: dict = defaultdict(Counter)
    for window, n in windows.items():
        codes = [(window >> st.CODE_BITS * i) & (st.CODES - 1) for i in range(st.DEPTH, -1, -1)]
        for depth in range(st.DEPTH + 1):
            followers[tuple(codes[st.DEPTH - depth : st.DEPTH])][codes[st.DEPTH]] += n
    kept = {(): followers[()]}
    for context, counts in followers.items():
        if not context:
            continue
        shorter = followers[context[1:]]
        total, before = sum(counts.values()), sum(shorter.values())
        divergence = 2 * sum(n * math.log((n / total) / (shorter[s] / before)) for s, n in counts.items())
        freedom = max(len(counts) - 1, 1)
        if divergence > freedom + st.DEVIATIONS * math.sqrt(2 * freedom):
            kept[context] = counts

    def number(context: tuple) -> int:
        out = 0
        for code in context:
            out = (out << st.CODE_BITS) | code
        return out

    return {(len(c), number(c), s, n) for c, counts in kept.items() for s, n in counts.items()}


class Tree:
    """A tree with all its smoothed distributions; what the operator finds by joins, held in arrays."""

    def __init__(
        self,
        followers: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray],
        byte_counts: np.ndarray,
        alphabet: np.ndarray,
    ) -> None:
        """`followers`: depth, context, symbol and n of each follower of a retained context."""
        depth, context, symbol, n = followers
        # The root is there without any follower, too.
        names = np.unique(np.append((depth << (st.DEPTH * st.CODE_BITS)) | context, 0))
        self.depths = names >> (st.DEPTH * st.CODE_BITS)
        self.contexts = names & ((1 << (st.DEPTH * st.CODE_BITS)) - 1)
        states = {name: i for i, name in enumerate(names.tolist())}
        at = np.searchsorted(names, (depth << (st.DEPTH * st.CODE_BITS)) | context)
        counts = np.zeros((len(names), st.CODES))
        np.add.at(counts, (at, symbol), n)
        totals = counts.sum(axis=1)
        shares = np.empty_like(counts)
        shares[0] = (counts[0] + st.HALF) / (totals[0] + st.HALF * st.CODES)
        for i in range(1, len(names)):
            up, suffix = int(self.depths[i]) - 1, int(self.contexts[i])
            while (above := states.get((up << (st.DEPTH * st.CODE_BITS)) | (suffix & ((1 << st.CODE_BITS * up) - 1)))) is None:
                up -= 1
            shares[i] = (counts[i] + st.SMOOTHING * shares[above]) / (totals[i] + st.SMOOTHING)
        self.logs = np.log10(shares).astype(np.float32)
        self.alphabet = alphabet
        self.byte_logs = st.byte_logs_of(byte_counts, alphabet)
        self.names = names

    def states_of(self, keys: np.ndarray) -> np.ndarray:
        """State before each window's last code."""
        contexts = keys >> st.CODE_BITS
        states = np.zeros(len(keys), np.int64)
        for depth in range(1, st.DEPTH + 1):
            wanted = (depth << (st.DEPTH * st.CODE_BITS)) | (contexts & ((1 << st.CODE_BITS * depth) - 1))
            at = np.minimum(np.searchsorted(self.names, wanted), len(self.names) - 1)
            states = np.where(self.names[at] == wanted, at, states)
        return states

    def score(self, tokens: list[bytes]) -> float:
        """Log10 probability of the tokens and the end."""
        codes = st._coded(tokens, self.alphabet)
        keys = st.windows_of(codes)
        logs = self.logs[self.states_of(keys), codes]
        total = float(logs.sum(dtype=np.float64))
        return total + st._rare_bytes(tokens, codes, self.byte_logs)
