"""Minimal acyclic transducer of frequent words: shared suffixes, ids as output.

The automaton is built once from sorted words (Daciuk et al., 2000): a state
whose final flag and outgoing edges equal those of a registered state is
replaced by it, so that words share prefixes and suffixes.  An edge carries
the number of words that come before it in its state; their sum along a path
is the word's rank, which addresses its ids in one flat array.  All parts are
plain arrays, written as .npy files and memory-mapped by the workers.
"""

from __future__ import annotations

import os

import numpy as np

PARTS = ("edge_key", "edge_target", "edge_skip", "final", "id_offset", "ids")


class _State:
    __slots__ = ("edges", "final", "number", "words")

    def __init__(self):
        self.edges: list[tuple[int, _State]] = []
        self.final, self.number, self.words = False, -1, 0

    def signature(self):
        return self.final, tuple((c, id(t)) for c, t in self.edges)


def build(entries: dict[bytes, bytes]) -> dict[str, np.ndarray]:
    """Arrays of the automaton of ``entries`` (word -> its ids as 16-bit integers)."""
    words = sorted(w for w in entries if w)
    root, register, last = _State(), {}, b""
    path: list[_State] = [root]

    def close(depth: int) -> None:
        for d in range(len(path) - 1, depth, -1):
            state, parent = path[d], path[d - 1]
            label = parent.edges[-1][0]
            parent.edges[-1] = (label, register.setdefault(state.signature(), state))
            path.pop()

    for w in words:
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        close(common)
        for c in w[common:]:
            state = _State()
            path[-1].edges.append((c, state))
            path.append(state)
        path[-1].final = True
        last = w
    close(0)

    order: list[_State] = []
    stack = [(root, False)]
    while stack:  # targets before sources, so that word counts add up
        state, done = stack.pop()
        if done:
            if state.number < 0:
                state.number = len(order)
                order.append(state)
                state.words = state.final + sum(t.words for _, t in state.edges)
        elif state.number < 0:
            stack.append((state, True))
            stack.extend((t, False) for _, t in state.edges if t.number < 0)
    n = len(order)
    renumber = lambda s: n - 1 - s.number  # noqa: E731  the root becomes state 0
    rows = []
    for s in order:
        skip = int(s.final)
        for c, t in s.edges:
            rows.append((renumber(s) << 8 | c, renumber(t), skip))
            skip += t.words
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    final = np.zeros(n, bool)
    final[[renumber(s) for s in order if s.final]] = True
    ids = [entries[w] for w in words]
    return {"edge_key": table[:, 0].copy(), "edge_target": table[:, 1].astype(np.int32), "edge_skip": table[:, 2].astype(np.int32),
            "final": final, "id_offset": np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64),
            "ids": np.frombuffer(b"".join(ids), np.uint8).copy()}


def save(arrays: dict[str, np.ndarray], folder: str) -> None:
    os.makedirs(folder, exist_ok=True)
    for part in PARTS:
        np.save(os.path.join(folder, f"{part}.npy"), arrays[part])


class Lexicon:
    """Look up many words at once in a saved automaton."""

    def __init__(self, folder: str):
        self.a = {}
        for part in PARTS:
            file = os.path.join(folder, f"{part}.npy")
            try:
                self.a[part] = np.load(file, mmap_mode="r")
            except ValueError:  # an empty array cannot be mapped
                self.a[part] = np.load(file)

    def look_up(self, words: list[str]) -> list[bytes | None]:
        """Ids of each known word, else None."""
        a, out = self.a, [None] * len(words)
        if not len(a["edge_key"]):
            return out
        by_length: dict[int, list[int]] = {}
        raw = [w.encode() for w in words]
        for i, b in enumerate(raw):
            if b:
                by_length.setdefault(len(b), []).append(i)
        last = len(a["edge_key"]) - 1
        data, offset = a["ids"], a["id_offset"]
        for width, where in by_length.items():
            letters = np.frombuffer(b"".join([raw[i] for i in where]), np.uint8).reshape(-1, width)
            who = np.arange(len(where))
            state, rank = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
            for k in range(width):
                key = state << 8 | letters[who, k]
                at = np.minimum(np.searchsorted(a["edge_key"], key), last)
                there = a["edge_key"][at] == key
                who, at, rank = who[there], at[there], rank[there]
                if not len(who):
                    break
                state = a["edge_target"][at].astype(np.int64)
                rank = rank + a["edge_skip"][at]
            else:
                ends = a["final"][state]
                for i, r in zip(who[ends].tolist(), rank[ends].tolist()):
                    out[where[i]] = data[offset[r]:offset[r + 1]].tobytes()
        return out
