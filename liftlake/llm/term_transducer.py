"""A minimal acyclic transducer: sorted terms in, their lexicographic ordinals out.

States are frozen as soon as the sorted input has left them, so equal tails are shared
at once and building needs no second pass. Each edge carries the number of terms that sort
before those behind it, so the sum along a path is the ordinal of its term. The edges are
four arrays; many terms are looked up side by side, one byte of each at a step.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class TermTransducer:
    """``keys`` (state << 8 | byte, sorted), ``targets`` and ``skips`` by edge; ``final`` by state; ``root``."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, skips: np.ndarray, final: np.ndarray, root: int):
        self.keys, self.targets, self.skips, self.final, self.root = keys, targets, skips, final, root

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> TermTransducer:
        """``terms`` ascending by bytes, without repeats."""
        known: dict[tuple, int] = {}
        below: list[int] = []  # terms behind each state
        edges: list[tuple[bytes, list[int]]] = []
        ends: list[bool] = []
        # the states along the last term: labels and targets of their finished edges, and whether a term ends there
        path: list[tuple[bytearray, list[int], list[bool]]] = [(bytearray(), [], [False])]

        def freeze(depth: int) -> int:
            labels, targets, end = path[depth]
            name = (end[0], bytes(labels), *targets)
            state = known.get(name)
            if state is None:
                state = known[name] = len(ends)
                edges.append((bytes(labels), targets))
                ends.append(end[0])
                below.append(end[0] + sum(below[t] for t in targets))
            return state

        last = b""
        for term in terms:
            shared = 0
            while shared < min(len(last), len(term)) and last[shared] == term[shared]:
                shared += 1
            while len(path) - 1 > shared:
                state = freeze(len(path) - 1)
                path.pop()
                path[-1][1].append(state)
            for byte in term[shared:]:
                path[-1][0].append(byte)
                path.append((bytearray(), [], [False]))
            path[-1][2][0] = True
            last = term
        while len(path) > 1:
            state = freeze(len(path) - 1)
            path.pop()
            path[-1][1].append(state)
        root = freeze(0)

        sizes = np.array([len(t) for _, t in edges], np.int64)
        labels = np.frombuffer(b"".join(x for x, _ in edges), np.uint8)
        targets = np.array([t for _, ts in edges for t in ts], np.int32)
        state = np.repeat(np.arange(len(edges)), sizes)
        behind = np.array(below, np.int64)[targets] if len(targets) else np.zeros(0, np.int64)
        sums = np.cumsum(behind) - behind
        first = np.repeat((np.cumsum(sizes) - sizes), sizes)
        final = np.array(ends, bool)
        skips = sums - sums[first] + final[state] if len(targets) else behind
        return cls((state << 8) | labels, targets, skips.astype(np.int64), final, root)

    def ordinals(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The ordinal of each ``data[start:stop]``, -1 for those that are no terms."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.keys):
            return out
        token = np.arange(len(starts))
        at, stops = starts.astype(np.int64), stops.astype(np.int64)
        state, ordinal = np.full(len(starts), self.root, np.int64), np.zeros(len(starts), np.int64)
        while len(token):
            wanted = (state << 8) | data[at]
            edge = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            on = self.keys[edge] == wanted
            edge, token, stops, at = edge[on], token[on], stops[on], at[on] + 1
            state, ordinal = self.targets[edge].astype(np.int64), ordinal[on] + self.skips[edge]
            done = at == stops
            term = done & self.final[state]
            out[token[term]] = ordinal[term]
            go = ~done
            token, stops, at, state, ordinal = token[go], stops[go], at[go], state[go], ordinal[go]
        return out

    def term(self, ordinal: int) -> bytes:
        """The term of an ordinal."""
        out, state = bytearray(), self.root
        while not (self.final[state] and ordinal == 0):
            lo, hi = np.searchsorted(self.keys, [state << 8, (state + 1) << 8])
            edge = lo + int(np.searchsorted(self.skips[lo:hi], ordinal, "right")) - 1
            out.append(int(self.keys[edge]) & 255)
            ordinal -= int(self.skips[edge])
            state = int(self.targets[edge])
        return bytes(out)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.keys), len(self.final), self.root], np.int64)
        return b"".join(a.tobytes() for a in (head, self.keys, self.skips, self.targets, self.final))

    @classmethod
    def from_bytes(cls, raw: bytes) -> TermTransducer:
        edges, states, root = np.frombuffer(raw, np.int64, 3).tolist()
        keys = np.frombuffer(raw, np.int64, edges, 24)
        skips = np.frombuffer(raw, np.int64, edges, 24 + 8 * edges)
        targets = np.frombuffer(raw, np.int32, edges, 24 + 16 * edges)
        return cls(keys, targets, skips, np.frombuffer(raw, bool, states, 24 + 20 * edges), root)
