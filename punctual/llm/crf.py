"""Linear-chain conditional random field over words, in numpy.

A word's score per label is the sum of weights of its features: prefixes and
suffixes (affixes with a boundary mark), character n-grams, and membership in
the lexicon of frequent words; all features are hashed to one weight table.
Transitions are learned.  The forward and backward passes run over many texts
at once: the word sequence is cut into lanes of equal length, every lane is
first reduced to one transfer matrix, and a second pass fills in messages, so
long texts cost no more steps than short ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FEATURES = 1 << 16
GRAMS = (1, 2, 3, 4)
LANE = 128


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word, flat, and where each word's begin.

    Letters are enclosed in boundary marks, so that n-grams at an edge are
    affixes; the whole word is one more feature (its lexicon entry).
    """
    joined = "".join(f"\x02{w}\x03" for w in words)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    end = np.cumsum(size)
    last = np.repeat(end, size) - np.arange(len(c))  # letters left in the word, this one included
    owner = np.repeat(np.arange(len(words)), size)
    hashed, who = [], []
    for n in GRAMS:
        if len(c) < n:
            break
        h = np.full(len(c) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ c[k:len(c) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        ok = last[:len(h)] >= n
        hashed.append(h[ok])
        who.append(owner[:len(h)][ok])
    whole = np.add.reduceat((c + np.uint64(1)) * ((last.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)), end - size)
    hashed.append(whole * np.uint64(0x94D049BB133111EB) ^ whole >> np.uint64(31))
    who.append(np.arange(len(words)))
    who_all = np.concatenate(who)
    order = np.argsort(who_all, kind="stable")
    index = (np.concatenate(hashed)[order] >> np.uint64(40)).astype(np.int64) % FEATURES
    counts = np.bincount(who_all, minlength=len(words))
    return index, np.concatenate([[0], np.cumsum(counts)[:-1]])


def lane_messages(emit: np.ndarray, reset: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Normalised messages m[t] ~ (m[t-1] @ trans) * emit[t], or start * emit[t] where ``reset``."""
    n, s = emit.shape
    lanes = -(-n // LANE)
    pad = lanes * LANE - n
    e = np.concatenate([emit, np.ones((pad, s))]).reshape(lanes, LANE, s)
    r = np.concatenate([reset, np.zeros(pad, bool)]).reshape(lanes, LANE)
    matrix = np.broadcast_to(np.eye(s), (lanes, s, s)).copy()
    for t in range(LANE):
        step = matrix @ trans
        at = r[:, t]
        if at.any():  # whatever came in, the message restarts from the prior
            step[at] = matrix[at].sum(2, keepdims=True) * start
        matrix = step * e[:, t][:, None, :]
        matrix /= matrix.sum((1, 2), keepdims=True)
    carry = np.empty((lanes, s))
    m = start / start.sum()
    for k in range(lanes):
        carry[k] = m
        m = m @ matrix[k]
        m = m / m.sum()
    out = np.empty((lanes, LANE, s))
    for t in range(LANE):
        step = carry @ trans
        at = r[:, t]
        if at.any():
            step[at] = start
        carry = step * e[:, t]
        carry /= carry.sum(1, keepdims=True)
        out[:, t] = carry
    return out.reshape(-1, s)[:n]


def marginals(score: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: label marginals per word, forward and backward messages.

    ``score`` holds log scores per word and label, ``first`` marks words that begin a sequence.
    """
    emit = np.exp(score - score.max(1, keepdims=True))
    emit = np.maximum(emit, 1e-30)
    trans, prior = np.exp(transition - transition.max()), np.exp(start - start.max())
    ahead = lane_messages(emit, first, trans, prior)
    # Backward on the reversed words: message of a word covers what follows it, its own emission included.
    last = np.concatenate([first[1:], [True]])
    back = lane_messages(emit[::-1], last[::-1], trans.T, np.ones(len(prior)))[::-1]
    after = np.empty_like(back)  # sum over the next word's message
    after[:-1] = back[1:] @ trans.T
    after[last] = 1.0
    p = ahead * after
    return p / p.sum(1, keepdims=True), ahead, back


@dataclass
class Model:
    labels: list[str]
    weight: np.ndarray  # [FEATURES, labels]
    transition: np.ndarray
    start: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)))
        index, at = features(words)
        return np.add.reduceat(self.weight[index], at, axis=0)


def train(sequences: list[list[tuple[str, int]]], labels: list[str], epochs: int = 25, rate: float = 0.15, penalty: float = 1e-4) -> Model:
    """Maximise the penalised conditional likelihood of labelled word sequences by Adam (full gradient)."""
    s = len(labels)
    flat = [w for q in sequences for w, _ in q]
    gold = np.array([y for q in sequences for _, y in q])
    first = np.zeros(len(flat), bool)
    first[np.cumsum([0] + [len(q) for q in sequences[:-1]])] = True
    vocabulary = sorted(set(flat))
    number = {w: i for i, w in enumerate(vocabulary)}
    word = np.array([number[w] for w in flat])
    index, at = features(vocabulary)
    owner = np.repeat(np.arange(len(vocabulary)), np.diff(np.append(at, len(index))))
    m = Model(labels, np.zeros((FEATURES, s)), np.zeros((s, s)), np.zeros(s))
    one = np.eye(s)[gold]
    inner = np.flatnonzero(~first)  # words with a predecessor
    gold_pairs = np.zeros((s, s))
    np.add.at(gold_pairs, (gold[inner - 1], gold[inner]), 1)
    parts = [m.weight, m.transition, m.start]
    memory = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    n = len(flat)
    for epoch in range(1, epochs + 1):
        score = np.add.reduceat(m.weight[index], at, axis=0)[word]
        p, ahead, back = marginals(score, first, m.transition, m.start)
        trans = np.exp(m.transition - m.transition.max())
        pair = ahead[inner - 1][:, :, None] * trans * back[inner][:, None, :]
        pair = (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        residual = one - p
        per_word = np.zeros((len(vocabulary), s))
        np.add.at(per_word, word, residual)
        grad = np.zeros_like(m.weight)
        for y in range(s):
            grad[:, y] = np.bincount(index, per_word[owner, y], FEATURES)
        grads = [grad / n - penalty * m.weight, (gold_pairs - pair) / n - penalty * m.transition, residual[first].sum(0) / n - penalty * m.start]
        for part, g, (a, b) in zip(parts, grads, memory):
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            part += rate * (a / (1 - 0.9 ** epoch)) / (np.sqrt(b / (1 - 0.999 ** epoch)) + 1e-8)
    return m
