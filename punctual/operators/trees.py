"""Decision trees, forests and boosted trees on binned columns.

Training rows become blocks of codes, cached on the executors: a categorical
column's code is its level, a numeric one's is its bin.  A level of all trees
in hand is one job: every block adds up (gradient, hessian, rows) per (node,
slot) and Spark adds the blocks' sums.  Few sums go to the driver, which
chooses the splits; many are shuffled by (tree, nodes) and each task chooses
the splits of its nodes, so that only splits reach the driver.  A slot of a
categorical column tests one level against the rest, i.e. one column of its
one-hot encoding.

Gradients are rounded to multiples of ``STEP``, so their sums are exact and
the trees do not depend on how rows are spread over blocks.  Row samples are
hashes of (row key, tree), so a retried task draws the same rows.

Nodes of at most ``LOCAL_ROWS`` rows of a single tree or forest are finished
elsewhere: their rows are shuffled by (tree, node) and each group grows its
subtree in one task by the same rule, so depth needs no limit.  A grid search
sends the held-out rows along and keeps their votes, not the subtrees.
"""

from __future__ import annotations

import base64
import json
import pickle
import sys
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext, cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.session import release

# Tasks carry this module's code, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_BINS = 256
# A block holds at least the first number of rows where there are cores for it, and never much above the second.
BLOCK_ROWS = 16_000
BLOCK_ROWS_MOST = 400_000
LOCAL_ROWS = 50_000
STEP = 2.0 ** -20
# Sums of this many (node, slot) cells are asked for in one job, and blocks of margins are renewed this often.
CELLS_PER_JOB = 4_000_000
RENEW = 16
# Bytes of rows' states that a Python worker remembers, and ensembles up to which it remembers their statistics too; up to
# the last number of bytes of all blocks, blocks and states are in files instead, which all workers of an executor read.
REMEMBERED = 256 << 20
STATS_OF = 4
FILED = 4 << 30
# Columns are counted together while their joint slots are no more than this, in chunks of so many rows.
JOINT = 1024
CHUNK = 1 << 16
# Up to this many blocks, a task's first result is so many bytes, see ``_at_once``.
AT_ONCE_BLOCKS = 64
AT_ONCE = 1 << 16
# What a level's tasks are told goes to them as a property of the job up to this size, else in the task's code.
TOLD = "punctual.trees.level"
TOLD_MOST = 1 << 19
# Sums of more cells than this, over all blocks, do not go to the driver: nodes are shuffled in groups of this many.
DIRECT_CELLS = 2_000_000
NODES_TOGETHER = 32
# Bytes of small nodes' rows that are shuffled at once.
SHUFFLED = 8 << 30
# Rows of a shuffled partition of small nodes.
PARTITION_ROWS = 400_000
# Votes are whole multiples of this, so that their sums do not depend on their order.
VOTE = 2.0 ** -30
NONE = -1


@dataclass(frozen=True)
class Layout:
    """Columns of a block and their slots; the last slot of a column holds what training never saw."""
    categorical: list[str]
    sizes: list[int]            # levels per categorical column
    numeric: list[str]
    cuts: list[list[float]]     # a bin holds values up to its cut
    drop_first: bool = False

    @property
    def widths(self) -> list[int]:
        return [n + 1 for n in self.sizes] + [len(c) + 2 for c in self.cuts]

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.widths)]).astype(np.int64)

    def features(self) -> np.ndarray:
        """Feature of each slot in the encoded vector, or NONE for a slot that is no candidate."""
        out, at = [], 0
        for n in self.sizes:
            first = int(self.drop_first)
            out += [NONE] * first + list(range(at, at + n - first)) + [NONE]
            at += n - first
        for i, c in enumerate(self.cuts):
            out += [at + i] * len(c) + [NONE, NONE]
        return np.array(out, np.int64)

    def codes(self, columns: list[np.ndarray]) -> np.ndarray:
        """Slots of rows, from level numbers and numeric values."""
        out = np.empty((len(columns[0]) if columns else 0, len(columns)), np.int32)
        for j, (x, off, width) in enumerate(zip(columns, self.offsets, self.widths)):
            if j < len(self.sizes):
                seen = np.isfinite(x) & (x >= 0) & (x < width - 1)
                code = np.where(seen, x, width - 1)
            else:
                code = np.where(np.isnan(x), width - 1, np.searchsorted(self.cuts[j - len(self.sizes)], x, "left"))
            out[:, j] = off + code.astype(np.int64)
        return out


@dataclass(frozen=True)
class Rule:
    """How trees grow: ``newton`` (second order, L2), ``residual`` (gradient boosting) or ``gini``."""
    kind: str
    max_depth: int | None
    min_split: int = 2
    l2: float = 0.0
    min_child: float = 0.0
    rate: float = 1.0
    subsample: float = 1.0
    by_tree: float = 1.0        # share of features of a tree
    by_node: int | None = None  # number of features of a node
    bootstrap: bool = False

    def value(self, total: np.ndarray) -> np.ndarray:
        """Leaf value from sums (g, h, rows, curvature)."""
        if self.kind == "newton":
            return -self.rate * total[:, 0] / (total[:, 1] + self.l2)
        if self.kind == "residual":
            return self.rate * total[:, 0] / np.maximum(total[:, 3], 1e-12)
        return total[:, 0] / np.maximum(total[:, 1], 1e-300)

    def may_split(self, total: np.ndarray, depth: int) -> np.ndarray:
        ok = total[:, 2] >= max(2, self.min_split)
        if self.kind == "gini":
            ok &= (total[:, 0] > 0) & (total[:, 0] < total[:, 1])
        return ok & (self.max_depth is None or depth < self.max_depth)


NODE = {"column": np.int16, "slot": np.int32, "yes": np.int32, "no": np.int32, "value": float, "rows": float, "weight": float,
        "gain": float, "path": np.uint64}


ROUTE = ("column", "slot", "yes", "no", "value")


class Tree:
    """Flat node arrays; node 0 is the root, ``yes`` and ``no`` are children of the test (column, slot).

    A node's ``path`` is the same however its tree was grown.
    """

    def __init__(self, path: int = 1):
        self.nodes = {k: np.zeros(0, kind) for k, kind in NODE.items()}
        self.add(np.zeros(1), np.zeros(1), np.zeros(1), np.array([path], np.uint64))

    def __len__(self) -> int:
        return len(self.nodes["column"])

    def add(self, value: np.ndarray, rows: np.ndarray, weight: np.ndarray, path: np.ndarray) -> None:
        """More nodes, leaves so far."""
        given = {"value": value, "rows": rows, "weight": weight, "path": path, "gain": np.zeros(len(value))}
        for k, kind in NODE.items():
            self.nodes[k] = np.concatenate([self.nodes[k], given.get(k, np.full(len(value), NONE)).astype(kind)])

    def set_root(self, total: np.ndarray, value: float) -> None:
        self.nodes["value"][0], self.nodes["rows"][0], self.nodes["weight"][0] = value, total[2], total[1]

    def arrays(self) -> dict[str, np.ndarray]:
        return dict(self.nodes)


def mix(x: np.ndarray | int, salt: np.ndarray | int) -> np.ndarray:
    """Well-mixed 64-bit hash (splitmix finisher)."""
    with np.errstate(over="ignore"):
        salt = np.uint64(salt & (2**64 - 1)) if isinstance(salt, int) else salt
        z = np.asarray(x, np.uint64) + salt * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    return (mix(key, salt) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


# Poisson(1) draws by inversion, for bootstrap weights.
_POISSON = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880)])


def route(tree: dict, codes: np.ndarray, n_categorical: int, depth: int | None = None, min_split: int = 0,
          start: np.ndarray | None = None) -> np.ndarray:
    """Node that each row reaches, at most ``depth`` tests down and never past a node of fewer than ``min_split`` rows."""
    at = np.zeros(len(codes), np.int32) if start is None else start.copy()
    live = np.arange(len(codes))
    steps = 0
    while len(live) and (depth is None or steps < depth):
        node = at[live]
        column = tree["column"][node]
        inner = (column >= 0) & (tree["rows"][node] >= min_split)
        live, node, column = live[inner], node[inner], column[inner]
        code, slot = codes[live, column], tree["slot"][node]
        met = np.where(column < n_categorical, code == slot, code <= slot)
        at[live] = np.where(met, tree["yes"][node], tree["no"][node])
        steps += 1
    return at


def _in_one(count: np.ndarray, other: np.ndarray, quantum: float | None = None) -> float | None:
    """A power of two ``unit`` such that any sum of ``other + unit * count`` tells both sums exactly, if there is one.

    ``quantum``: what all of ``other`` are known to be whole multiples of.
    """
    if not len(other) or other.min() < 0:
        return None
    if quantum is None:
        whole = np.rint(other)
        quantum = 1.0 if np.array_equal(whole, other) else STEP
        if quantum == STEP and not np.array_equal(np.rint(other / STEP) * STEP, other):
            return None
    unit = 2.0 ** np.ceil(np.log2(other.sum() + 1))
    return unit if unit * (count.sum() + 1) / quantum < 2.0 ** 53 else None


def cells(codes: np.ndarray, node: np.ndarray, stats: np.ndarray, nodes: int, layout: Layout, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``stats`` (rows x s; the third counts rows) per (node, slot) that occurs, ordered; only of ``rows`` if given."""
    if rows is None or len(rows) == len(codes):
        rows = slice(None)
    offsets, columns = layout.offsets, [np.ascontiguousarray(s[rows], float) for s in stats.T]
    node, width, parts = node[rows].astype(np.int64), int(offsets[-1]), []
    same = len(columns) > 2 and np.array_equal(columns[1], columns[2])
    # Rows are counted along with the last other column, where one double holds both.
    beside = next((i for i in (3, 1, 0) if i < len(columns) and not (i == 1 and same)), None)
    unit = None if len(columns) < 3 or (columns[2] != np.rint(columns[2])).any() else _in_one(columns[2], columns[beside])
    both = None if unit is None else columns[beside] + unit * columns[2]

    def sums_of(index: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Groups with rows below ``size``, and their sums."""
        count = np.bincount(index, columns[2] if unit is None else both, size)
        held, count = count, count if unit is None else np.floor(count / unit)
        used = np.flatnonzero(count)
        count = count[used]
        sums = np.empty((len(used), len(columns)))
        for i, s in enumerate(columns):
            if i == 2 or i == 1 and same:
                sums[:, i] = count
            else:
                sums[:, i] = held[used] - unit * count if unit is not None and i == beside else np.bincount(index, s, size)[used]
        return used, sums

    for j, (off, n) in enumerate(zip(offsets, layout.widths)):
        index = node * n
        index += codes[:, j][rows]
        index -= off
        if nodes * n <= 4 * len(index) + 4096:
            used, sums = sums_of(index, nodes * n)
        else:
            names, group = np.unique(index, return_inverse=True)
            used, sums = sums_of(group, len(names))
            used = names[used]
        parts.append((used // n * width + off + used % n, sums))
    if not parts:
        return np.zeros(0, np.int64), np.zeros((0, stats.shape[1]))
    index, sums = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(index, kind="stable")
    return index[order], sums[order]


def together(widths: list[int]) -> list[list[int]]:
    """Columns to be counted together: as few groups as first fit finds, the widest column first."""
    out: list[tuple[list[int], int]] = []
    for j in sorted(range(len(widths)), key=lambda j: -widths[j]):
        i = next((i for i, (_, size) in enumerate(out) if size * widths[j] <= JOINT), None)
        if i is None:
            out.append(([j], widths[j]))
        else:
            out[i] = [*out[i][0], j], out[i][1] * widths[j]
    return [group for group, _ in out]


def joint_codes(codes: np.ndarray, layout: Layout) -> list[tuple[list[int], np.ndarray]]:
    """(columns, each row's joint slot) of every group of columns."""
    out, offsets, widths = [], layout.offsets, layout.widths
    for group in together(widths):
        slot = np.zeros(len(codes), codes.dtype)
        for j in group:
            slot *= codes.dtype.type(widths[j])
            slot += codes[:, j] - codes.dtype.type(offsets[j])
        out.append((group, slot))
    return out


def joint_cells(joint: list[tuple[list[int], np.ndarray]], node: np.ndarray, stats: np.ndarray, nodes: int, layout: Layout, rows: np.ndarray,
                quantum: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``cells`` of few nodes, for statistics whose sums are exact: columns are counted together, then summed apart."""
    offsets, widths, kinds = layout.offsets, layout.widths, stats.shape[1]
    sizes = [int(np.prod([widths[j] for j in group])) for group, _ in joint]
    whole = [np.zeros((kinds, nodes * size)) for size in sizes]
    for a in range(0, len(rows), CHUNK):
        part = rows[a:a + CHUNK]
        columns = [np.ascontiguousarray(s[part], float) for s in stats.T]
        same = np.array_equal(columns[1], columns[2])
        # Rows are counted along with the last other column, where one double holds both.
        beside = next(i for i in (3, 1, 0) if i < kinds and not (i == 1 and same))
        unit = _in_one(columns[2], columns[beside], quantum)
        both = None if unit is None else columns[beside] + unit * columns[2]
        at = node[part].astype(np.int64)
        for (_, slot), size, out in zip(joint, sizes, whole):
            index = at * size
            index += slot[part]
            count = np.bincount(index, columns[2] if unit is None else both, out.shape[1])
            if unit is not None:
                held, count = count, np.floor(count / unit)
                out[beside] += held - unit * count
            out[2] += count
            for i in range(kinds):
                if i != 2 and not (i == beside and unit is not None):
                    out[i] += count if i == 1 and same else np.bincount(index, columns[i], out.shape[1])
    sums = np.zeros((kinds, nodes, int(offsets[-1])))
    for (group, _), out in zip(joint, whole):
        apart = out.reshape(kinds, nodes, *[widths[j] for j in group])
        for i, j in enumerate(group):
            sums[:, :, offsets[j]:offsets[j + 1]] = apart.sum(tuple(2 + k for k in range(len(group)) if k != i))
    flat = sums.reshape(kinds, -1)
    used = np.flatnonzero(flat[2])
    return used, np.ascontiguousarray(flat[:, used].T)


def added(parts: Iterable[tuple], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells below ``size`` of several blocks, added up."""
    whole = None
    for index, sums in parts:
        whole = np.zeros((size, sums.shape[1])) if whole is None else whole
        whole[index] += sums
    if whole is None:
        return np.zeros(0, np.int64), np.zeros((0, 3))
    used = np.flatnonzero(whole[:, 2])
    return used, whole[used]


def merged(a: tuple, b: tuple) -> tuple:
    used, group = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    both = np.concatenate([a[1], b[1]])
    return used, np.stack([np.bincount(group, s, len(used)) for s in both.T], 1) if len(used) else both


def best_splits(sums: tuple, total: np.ndarray, layout: Layout, rule: Rule, allowed) -> tuple[np.ndarray, ...]:
    """(node, gain, column, slot, sums of its yes side) of the nodes to split; ``allowed(node, feature)`` are candidate masks."""
    index, stats = sums
    offsets, feature = layout.offsets, layout.features()
    width, columns = int(offsets[-1]), len(offsets) - 1
    node, slot = index // width, index % width
    column = np.searchsorted(offsets, slot, "right") - 1
    segment = node * columns + column
    first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(segment) else np.zeros(0, np.int64)
    running = np.cumsum(stats, 0)
    before = np.concatenate([np.zeros((1, stats.shape[1])), running])[first]
    size = np.diff(np.concatenate([first, [len(segment)]]))
    numeric = column >= len(layout.sizes)
    yes = np.where(numeric[:, None], running - np.repeat(before, size, 0), stats)
    no = total[node] - yes
    ok = (feature[slot] >= 0) & (yes[:, 2] > 0) & (no[:, 2] > 0) & (yes[:, 1] >= rule.min_child) & (no[:, 1] >= rule.min_child)
    ok &= allowed(node, feature[slot])
    keep = np.flatnonzero(ok)
    node, slot, column, yes, no = node[keep], slot[keep], column[keep], yes[keep], no[keep]

    def score(s):
        return s[:, 0] ** 2 / np.maximum(s[:, 1] + rule.l2, 1e-300)

    gain = score(yes) + score(no) - score(total[node])
    # Sums are exact, so equal splits have equal gains but for the last bits of a division; the first slot wins.
    rounded = np.round(gain, 9)
    starts = np.flatnonzero(np.diff(node, prepend=-1))
    most = np.maximum.reduceat(rounded, starts) if len(starts) else rounded
    top = np.flatnonzero(rounded == np.repeat(most, np.diff(np.append(starts, len(node)))))
    first = top[np.flatnonzero(np.diff(node[top], prepend=-1))]
    first = first[gain[first] > (1e-6 if rule.kind == "newton" else -1e-9)]
    return node[first], gain[first], column[first], slot[first], yes[first]


def feature_masks(rule: Rule, n_features: int, usable: np.ndarray, seed: int, paths: np.ndarray):
    """``allowed`` of ``best_splits``: the features of a tree (hash order) or of each of its nodes."""
    if rule.by_node:
        chosen = np.argsort(mix(usable[None, :], mix(paths, seed)[:, None]), axis=1)[:, :rule.by_node]
        mask = np.zeros((len(paths), n_features), bool)
        mask[np.arange(len(paths))[:, None], usable[chosen]] = True
        return lambda node, feature: mask[node, feature]
    mask = np.ones(n_features, bool)
    if rule.by_tree < 1.0:
        mask[:] = False
        count = max(1, int(rule.by_tree * len(usable)))
        mask[usable[np.argsort(mix(usable, seed))[:count]]] = True
    return lambda node, feature: mask[feature]


def _apply(tree: Tree, nodes: np.ndarray, total: np.ndarray, found: tuple, rule: Rule, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Split ``nodes`` as found; the children that may be split again, with their sums."""
    at, gain, column, slot, yes = found
    parent, size = nodes[at], len(tree)
    sides = np.stack([yes, total[at] - yes], 1).reshape(-1, total.shape[1])  # yes and no side in turn
    may = rule.may_split(sides, depth + 1)
    path = tree.nodes["path"][parent]
    tree.add(rule.value(sides), sides[:, 2], sides[:, 1], np.stack([mix(path, 1), mix(path, 2)], 1).ravel())
    ids = size + np.arange(len(sides))
    for name, v in (("column", column), ("slot", slot), ("yes", ids[::2]), ("no", ids[1::2]), ("gain", gain)):
        tree.nodes[name][parent] = v
    return ids[may], sides[may]


def finish_locally(codes: np.ndarray, stats: np.ndarray, layout: Layout, rule: Rule, seed: int, path: int, depth: int) -> Tree:
    """The whole subtree of a node from its rows."""
    tree = Tree(path)
    total = stats.sum(0)[None, :]
    tree.set_root(total[0], rule.value(total)[0])
    frontier = np.flatnonzero(rule.may_split(total, depth))
    feature = layout.features()
    usable = np.unique(feature[feature >= 0])
    at = np.zeros(len(codes), np.int32)
    here = np.arange(len(codes))
    codes = np.asfortranarray(codes)
    while len(frontier):
        place = np.full(len(tree), NONE, np.int64)
        place[frontier] = np.arange(len(frontier))
        here = here[place[at[here]] >= 0]
        sums = cells(codes, place[at], stats, len(frontier), layout, here)
        masks = feature_masks(rule, int(feature.max(initial=0)) + 1, usable, seed, tree.nodes["path"][frontier])
        frontier, total = _apply(tree, frontier, total, best_splits(sums, total, layout, rule, masks), rule, depth)
        depth += 1
        at[here] = route(tree.nodes, codes[here], len(layout.sizes), 1, start=at[here])
    return tree


@dataclass
class Plan:
    """One ensemble to train: its rule, the fold it must not see, and its trees so far."""
    rule: Rule
    count: int
    fold: int = NONE
    seed: int = 42
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)


def _stats(rule: Rule, block: dict, plan: dict, margin: np.ndarray | None) -> np.ndarray:
    """(g, h, rows, curvature) per row, all zero for a row outside the tree's sample."""
    y, w = block["y"], block["w"]
    use = (block["fold"] != plan["fold"]).astype(np.float64)
    if rule.subsample < 1.0:
        use *= uniform(block["key"], plan["seed"]) < rule.subsample
    if rule.bootstrap:
        use *= np.searchsorted(_POISSON, uniform(block["key"], plan["seed"]), "right")
    if rule.kind == "gini":
        return np.stack([use * w * y, use * w, use > 0]).T
    p = 1.0 / (1.0 + np.exp(-margin))
    if rule.kind == "newton":
        g, h, c = (p - y) * w, p * (1 - p) * w, None
    else:
        g, h, c = y - p, np.ones(len(y)), p * (1 - p)
    parts = [np.rint(use * g / STEP) * STEP, np.rint(use * h / STEP) * STEP, use]
    return np.stack(parts if c is None else [*parts, np.rint(use * c / STEP) * STEP]).T


def _margin(block: dict, plan: dict, n_categorical: int) -> np.ndarray | None:
    if plan["rule"].kind == "gini":
        return None
    margin = block["margin"].get(plan["id"])
    margin = np.full(len(block["y"]), plan["base"]) if margin is None else margin.copy()
    for t in plan["done"]:
        margin += t["value"][route(t, block["codes"], n_categorical)]
    return margin


def _file_of(block: dict) -> str | None:
    """Where an executor's workers find a block and what they noted of it: in Spark's scratch folder, which goes with the executor."""
    import os
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return f"{folder}/rows-{block['name']}" if folder else None


def _read(path: str) -> tuple[int, np.ndarray | None]:
    """What was noted, and the number of the tree that it belongs to."""
    try:
        with open(path, "rb") as f:
            return int.from_bytes(f.read(8), "little"), np.load(f)
    except OSError:
        return NONE, None


def _write(path: str, what: np.ndarray, number: int = 0) -> None:
    import os
    with open(own := f"{path}.{os.getpid()}", "wb") as f:
        f.write(number.to_bytes(8, "little"))
        np.save(f, what)
    try:  # a rename over a file would wait for the disk
        os.remove(path)
    except FileNotFoundError:
        pass
    os.rename(own, path)


IN_FILES = ("codes", "y", "w", "fold", "key")


def _keep(block: dict, plans: list[dict], n_categorical: int) -> str:
    """Write a block and its margins to files; its name."""
    path = _file_of(block)
    try:
        for part in IN_FILES:
            np.save(f"{path}-{part}.npy", block[part])
        for plan in plans:
            if _number(plan):
                _write(f"{path}-{plan['id']}-margin", _margin(block, plan, n_categorical), _number(plan))
    except (OSError, TypeError):  # whoever misses a file says so
        pass
    return block["name"]


class _Kept(dict):
    """A block in files, each part read when it is asked for."""

    def __init__(self, name: str):
        super().__init__(name=name)

    def __missing__(self, part: str) -> np.ndarray:
        self[part] = np.load(f"{_file_of(self)}-{part}.npy", mmap_mode="r")
        return self[part]


def _forget(block: dict) -> None:
    """Remove the files of a block."""
    import glob
    import os
    for path in glob.glob(f"{glob.escape(_file_of(block) or '/nowhere')}-*"):
        try:
            os.remove(path)
        except OSError:
            pass


def _settle() -> None:
    """Spark collects a worker's garbage after every task: what it has loaded by now is left out of that."""
    import gc
    if not vars(sys).get("_settled"):
        gc.collect()
        gc.freeze()
        sys._settled = True


def _step(tree: dict, codes: np.ndarray, n_categorical: int, at: np.ndarray) -> np.ndarray:
    """``route`` for rows that are a test or two away from their end."""
    column, slot = tree["column"].astype(np.int64), tree["slot"].astype(np.int64)
    inner, self = column >= 0, np.arange(len(column))
    place = np.where(inner, column, 0) * len(codes)
    # A test asks whether a code lies between two slots.
    low = np.where(inner & (column < n_categorical), slot, 0)
    child = np.stack([np.where(inner, tree["no"], self), np.where(inner, tree["yes"], self)], 1).ravel()
    flat, row, at = codes.ravel("F"), np.arange(len(codes)), at.astype(np.int64)
    while inner[at].any():
        code = flat[place[at] + row]
        at = child[2 * at + ((code >= low[at]) & (code <= slot[at]))]
    return at


def _number(plan: dict) -> int:
    """Trees of the ensemble before the one that grows."""
    return plan["number"] if "number" in plan else len(plan["done"]) + plan["renewed"]


def _state_in_files(block: dict, plan: dict, tree: dict, n_categorical: int) -> tuple[np.ndarray, np.ndarray] | None:
    """``_state`` as it is noted in files between the levels of a tree; nothing where a file is missing.

    Margin, statistics and nodes are written in this order, each with the number of its tree: a task that
    is run again finds them as they were or as it had left them.
    """
    path, number = f"{_file_of(block)}-{plan['id']}", _number(plan)
    (of_nodes, at), (of_stats, stats) = _read(f"{path}-nodes"), _read(f"{path}-stats")
    if not of_nodes == of_stats == number:
        of_margin, margin = _read(f"{path}-margin")
        if margin is None and number <= 1:  # no tree is in it
            of_margin, margin = 0, np.full(len(block["y"]), plan["base"])
        if of_margin == number - 1 == of_nodes:
            last = plan["done"][-1]
            margin += last["value"][_step(last, block["codes"], n_categorical, at)]
            _write(f"{path}-margin", margin, number)
        elif of_margin != number:
            return None
        stats = np.ascontiguousarray(_stats(plan["rule"], block, plan, margin).T)
        short = stats.astype(np.float32)
        _write(f"{path}-stats", short if np.array_equal(short, stats) else stats, number)
        at = np.zeros(len(margin), np.uint8)
    at = _step(tree, block["codes"], n_categorical, at)
    _write(f"{path}-nodes", at.astype(np.min_scalar_type(len(tree["column"]))), number)
    return stats.T, at


def _state(block: dict, plan: dict, tree: dict, n_categorical: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Statistics of the rows for the tree that grows, and the node that each has reached.

    Both are remembered between the levels of a tree; who does not find them works them out.
    """
    if plan["rule"].kind == "gini":
        return _stats(plan["rule"], block, plan, None), route(tree, block["codes"], n_categorical)
    if plan.get("filed"):
        return _state_in_files(block, plan, tree, n_categorical)
    memo = vars(sys).setdefault("_rows_of_growing_trees", {})
    name, number = (block["name"], plan["id"]), _number(plan)
    known, reached = memo.get(name, (None, None))
    # known: (trees in the margin, margin, seed of the tree that the statistics belong to, statistics); reached: (seed, nodes)
    start = stats = None
    if known is None or not plan["renewed"] <= known[0] <= number:
        margin = _margin(block, plan, n_categorical)
    else:
        margin, behind = known[1], plan["done"][known[0] - plan["renewed"]:]
        for i, t in enumerate(behind):
            on_its_way = reached is not None and reached[0] == plan["seed"] - len(behind) + i
            margin = margin + t["value"][route(t, block["codes"], n_categorical, start=reached[1] if on_its_way else None)]
        if known[2] == plan["seed"]:
            stats = known[3]
    if reached is not None and reached[0] == plan["seed"]:
        start = reached[1]
    stats = _stats(plan["rule"], block, plan, margin) if stats is None else stats
    at = route(tree, block["codes"], n_categorical, start=start)
    entry = (number, margin, plan["seed"], stats if plan.get("few") else None), (plan["seed"], at)

    def size(e: tuple) -> int:
        return e[0][1].nbytes + e[1][1].nbytes + (0 if e[0][3] is None else e[0][3].nbytes)

    held = sum(size(e) for k, e in memo.items() if k != name)
    if held + size(entry) > REMEMBERED:
        for k in [k for k in memo if not k[0].startswith(block["name"].rpartition("-")[0])]:  # rows of earlier ensembles
            held -= size(memo.pop(k)) if k != name else 0
    if held + size(entry) <= REMEMBERED:
        memo[name] = entry
    else:
        memo.pop(name, None)
    return stats, at


class Blocks:
    """Binned training rows on the executors."""

    def __init__(self, encoded: DataFrame, layout: Layout, label: str, weight: str | None, fold: str | None, key: str | None):
        self.spark, self.layout = encoded.sparkSession, layout
        columns = [f"{c}__idx" for c in layout.categorical] + [f"{c}_scaled" for c in layout.numeric]
        rows = encoded.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)], F.col(label).cast("double").alias("y"),
                              (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
                              (F.col(fold).cast("int") if fold else F.lit(NONE - 1)).alias("fold"),
                              F.xxhash64(key if key else F.struct(*columns, label)).alias("key"))
        sizes = [r[1] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        self.rows = count = sum(sizes)
        cores = encoded.sparkSession.sparkContext.defaultParallelism
        parts = max(1, min(-(-count // BLOCK_ROWS), max(cores, -(-count // BLOCK_ROWS_MOST))))
        # Many rows that lie evenly are cut into blocks where they are.
        stay = parts > cores and len(sizes) >= cores and max(sizes) <= 2 * count / len(sizes)
        most = BLOCK_ROWS_MOST if stay else max(1, count)
        self.parts = sum(-(-n // most) for n in sizes) if stay else parts
        n, one = len(columns), layout
        kind = np.uint16 if int(layout.offsets[-1]) < 2**16 else np.int32
        run = uuid.uuid4().hex
        # Sums of rows without weights or of rounded gradients are exact, so a node's are its parent's less its sibling's.
        self.exact = weight is None
        self.kept: RDD | None = None  # names of the blocks, where their files are
        self.levels_of_kept: RDD | None = None
        # The code that every level runs is sent once.
        self.level_code = self.spark.sparkContext.broadcast((run, cloudpickle.dumps(partial(_sums_of_groups, layout))))

        def block_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            got = pa.Table.from_batches(held)
            x = [got.column(f"c{i}").fill_null(float("nan")).to_numpy() for i in range(n)]
            return pa.RecordBatch.from_pydict({
                "codes": [np.ascontiguousarray(one.codes(x).astype(kind).T).tobytes()], "y": [got.column("y").to_numpy().tobytes()],
                "w": [got.column("w").to_numpy().tobytes()], "fold": [got.column("fold").to_numpy().astype(np.int32).tobytes()],
                "key": [got.column("key").to_numpy().astype(np.int64).tobytes()]})

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for b in batches:
                while b.num_rows:
                    room = most - sum(h.num_rows for h in held)
                    held.append(b.slice(0, room))
                    b = b.slice(room)
                    if sum(h.num_rows for h in held) == most:
                        yield block_of(held)
                        held = []
            if held:
                yield block_of(held)

        def unpack(part: int, found: Iterator) -> Iterator[dict]:
            for i, r in enumerate(found):
                yield {"codes": np.frombuffer(r.codes, kind).reshape(n, len(r.y) // 8).T, "y": np.frombuffer(r.y), "w": np.frombuffer(r.w),
                       "fold": np.frombuffer(r.fold, np.int32), "key": np.frombuffer(r.key, np.int64).view(np.uint64), "margin": {}, "name": f"{run}-{part}.{i}"}

        binary = "codes binary, y binary, w binary, fold binary, key binary"
        self.blocks: RDD = (rows if stay else rows.repartition(parts)).mapInArrow(pack, binary).rdd.mapPartitionsWithIndex(unpack).persist(StorageLevel.MEMORY_AND_DISK)

    def keep(self, plans: list[dict]) -> None:
        """From now on levels of these plans read blocks, margins, statistics and nodes from files of the executors."""
        self.let_go()
        n = len(self.layout.sizes)
        self.kept = self.blocks.map(lambda b: _keep(b, plans, n)).persist(StorageLevel.MEMORY_AND_DISK)
        self.kept.foreachPartition(lambda _: None)
        code, few = self.level_code, self.parts <= AT_ONCE_BLOCKS
        self.levels_of_kept = self.kept.mapPartitions(lambda names: _at_once(names, code, few))

    def of_level(self, sent: list[tuple]) -> list[tuple[int, tuple]]:
        """``_sums_of_groups`` of all kept blocks."""
        sc, told = self.spark.sparkContext, base64.b64encode(zlib.compress(pickle.dumps(sent, 5), 1)).decode()
        if len(told) > TOLD_MOST:
            code = self.level_code
            found = self.kept.mapPartitions(lambda names: _at_once(names, code, False, sent)).collect()
        else:
            # One and the same job definition for every level: only the property differs.
            sc.setLocalProperty(TOLD, told)
            try:
                found = self.levels_of_kept.collect()
            finally:
                sc.setLocalProperty(TOLD, None)
        return [x for x in found if isinstance(x, tuple)]

    def let_go(self) -> None:
        if self.kept is not None:
            self.kept.foreach(lambda name: _forget({"name": name}))
            self.kept.unpersist()
            self.kept = self.levels_of_kept = None

    def together(self, trees: int) -> int:
        """How many of these trees may have the rows of their small nodes shuffled at once."""
        return max(1, min(trees, SHUFFLED // max(1, self.rows * (4 * len(self.layout.widths) + 16))))

    def filed(self, plans: int) -> bool:
        """Whether files can take the blocks, and margins, statistics and nodes of so many plans."""
        return self.rows * (4 * len(self.layout.widths) + 28 + plans * 28) <= FILED

    def close(self) -> None:
        self.let_go()
        self.blocks.unpersist()
        self.level_code.unpersist()

    def few(self, cells: int) -> bool:
        """Whether the driver can take this many cells of every block."""
        return self.parts * cells <= DIRECT_CELLS

    def sums(self, task, size: int) -> tuple:
        """``task(block)``, a pair of cells below ``size`` and their sums, added up over all blocks."""
        out = self.blocks.map(task)
        if not self.few(size):
            return out.treeReduce(merged)
        return added(out.collect(), size)

    def root_sums(self, rule: Rule) -> tuple:
        """Sums per slot over all rows, at margin 0."""
        layout, width = self.layout, int(self.layout.offsets[-1])
        plan = {"id": 0, "rule": rule, "base": 0.0, "fold": NONE, "seed": 0, "done": []}

        def task(block: dict) -> tuple:
            stats = _stats(rule, block, plan, np.zeros(len(block["y"])))
            return cells(block["codes"], np.zeros(len(stats), np.int64), stats, 1, layout)

        return self.sums(task, width)

    def renew(self, plans: list[dict]) -> None:
        """Add finished trees to the margins that blocks hold."""
        n = len(self.layout.sizes)

        def add(block: dict) -> dict:
            return block | {"margin": {p["id"]: _margin(block, p, n) for p in plans}}

        new = self.blocks.map(add).persist(StorageLevel.MEMORY_AND_DISK)
        new.foreachPartition(lambda _: None)
        self.blocks.unpersist()
        self.blocks = new


def _totals(sums: tuple, layout: Layout, nodes: int, columns: int) -> np.ndarray:
    """Sums per node: those of its first column's slots."""
    width, first = int(layout.offsets[-1]), int(layout.offsets[1])
    inside = sums[0] % width < first
    node = sums[0][inside] // width
    return np.stack([np.bincount(node, s, nodes) for s in sums[1][inside].T], 1) if columns else np.zeros((nodes, 3))


def _choice(sums: tuple, paths: np.ndarray, layout: Layout, rule: Rule, seed: int, depth: int) -> tuple[np.ndarray, tuple]:
    """Sums of nodes, and the splits found for them (see ``best_splits``)."""
    totals = _totals(sums, layout, len(paths), len(layout.widths))
    feature = layout.features()
    if depth == 0 and not rule.may_split(totals, 0)[0]:
        sums = np.zeros(0, np.int64), np.zeros((0, totals.shape[1]))
    masks = feature_masks(rule, int(feature.max(initial=0)) + 1, np.unique(feature[feature >= 0]), seed, paths)
    return totals, best_splits(sums, totals, layout, rule, masks)


def grow(blocks: Blocks, plans: list[Plan], together: int = 64, finish=None) -> None:
    """Train all plans; trees that do not wait for one another share their jobs.

    ``finish(blocks, trees, given, small)`` takes the place of growing small nodes to the end; the trees are dropped then.
    """
    boosted = plans[0].rule.kind != "gini"
    if boosted:
        held: list[list[dict]] = [[] for _ in plans]  # trees since the margins were renewed
        filed = blocks.filed(len(plans))
        for round_ in range(max(p.count for p in plans)):
            going = [i for i, p in enumerate(plans) if round_ < p.count]
            _grow_level_by_level(blocks, [(i, plans[i], round_) for i in going], held, filed=filed)
            for i in going:
                held[i].append(plans[i].trees[-1].arrays())
            if (round_ + 1) % RENEW == 0 and not filed:
                blocks.renew([{"id": i, "rule": p.rule, "base": p.base, "done": held[i]} for i, p in enumerate(plans)])
                held = [[] for _ in plans]
        return
    wanted = [(i, p, t) for i, p in enumerate(plans) for t in range(p.count)]
    for a in range(0, len(wanted), together):
        _grow_level_by_level(blocks, wanted[a:a + together], [[] for _ in plans], finish)


def _grow_level_by_level(blocks: Blocks, wanted: list[tuple[int, Plan, int]], held: list[list[dict]], finish=None,
                         filed: bool = False) -> None:
    layout = blocks.layout
    width, n_cat = int(layout.offsets[-1]), len(layout.sizes)
    trees = [Tree() for _ in wanted]
    given = [{"id": i, "rule": p.rule, "base": p.base, "fold": p.fold, "seed": p.seed * 1_000_003 + n, "number": n, "done": held[i],
              "renewed": n - len(held[i]), "few": len(wanted) <= STATS_OF, "exact": blocks.exact or p.rule.kind != "gini"} for i, p, n in wanted]
    if filed and blocks.kept is None:
        blocks.keep(given)
    frontier: list[np.ndarray] = [np.zeros(1, int) for _ in trees]
    small: list[tuple[int, int, int]] = []  # (tree, node, depth)
    depth = 0
    parents: dict[tuple[int, int], np.ndarray] = {}  # sums per slot of the nodes split last, by (tree, node)
    while any(len(f) for f in frontier):
        # Groups of nodes of a tree, and jobs of groups.
        groups = [(k, f[a:a + NODES_TOGETHER]) for k, f in enumerate(frontier) for a in range(0, len(f), NODES_TOGETHER)]
        jobs: list[list[tuple[int, np.ndarray]]] = [[]]
        for group in groups:
            if jobs[-1] and (sum(len(n) for _, n in jobs[-1]) + len(group[1])) * width > CELLS_PER_JOB:
                jobs.append([])
            jobs[-1].append(group)
        sums_of: dict[tuple[int, int], np.ndarray] = {}
        found = [one for job in jobs for one in zip(job, _level(blocks, job, trees, given, depth, width, parents, sums_of))]
        parents = sums_of
        more: list[list[np.ndarray]] = [[] for _ in trees]
        for (k, nodes), (totals, splits) in found:
            if depth == 0:
                trees[k].set_root(totals[0], given[k]["rule"].value(totals)[0])
            again, sums = _apply(trees[k], nodes, totals, splits, given[k]["rule"], depth)
            if given[k]["rule"].kind == "gini":
                little = sums[:, 2] <= LOCAL_ROWS
                small += [(k, int(n), depth + 1) for n in again[little]]
                again = again[~little]
            more[k].append(again)
        depth += 1
        frontier = [np.concatenate(m) if m else np.zeros(0, int) for m in more]
    if finish is not None:
        finish(blocks, trees, given, small)
        return
    if small:
        _finish(blocks, trees, given, small)
    for (_, plan, _), tree in zip(wanted, trees):
        plan.trees.append(tree)


def _loaded(code):
    """The broadcast code of a level's tasks, unpacked once per worker."""
    (name, text), loaded = code.value, vars(sys).setdefault("_code_of_levels", {})
    if name not in loaded:
        loaded.clear()
        loaded[name] = pickle.loads(text)
    return loaded[name]


def _at_once(names: Iterator[str], code, few: bool, sent: list[tuple] | None = None) -> Iterator:
    """``_sums_of_groups`` of the blocks that a task is given by name.

    The first bytes fill the worker's buffer and so leave at once: with them goes the acknowledgement without which
    Spark's next small message to the worker would wait for 40 ms (Nagle's rule and a delayed acknowledgement).
    """
    _settle()
    if few:
        yield AT_ONCE * b"0"
    if sent is None:
        sent = pickle.loads(zlib.decompress(base64.b64decode(TaskContext.get().getLocalProperty(TOLD))))
    for name in names:
        yield from _loaded(code)(name, sent)


def _sums_of_groups(layout: Layout, block: dict | str, sent: list[tuple]) -> list[tuple[int, tuple]]:
    """(group, its cells) of the rows of a block, or of the block that has this name; (NONE, the name) where its files are not all there."""
    if isinstance(block, str):
        try:
            return list(_cells_of_groups(layout, _Kept(block), sent))
        except (OSError, TypeError):
            return [(NONE, block)]
    return list(_cells_of_groups(layout, block, sent))


def _cells_of_groups(layout: Layout, block: dict, sent: list[tuple]) -> Iterator[tuple[int, tuple]]:
    width, n_cat = int(layout.offsets[-1]), len(layout.sizes)
    joint = None
    for plan, tree, groups in sent:
        state = _state(block, plan | {"rule": Rule(**plan["rule"])}, tree, n_cat)
        if state is None:
            raise FileNotFoundError(block["name"])
        stats, at = state
        number = np.full(len(tree["column"]), NONE, np.int64)
        asked = sum(len(n) for _, n in groups)
        number[np.concatenate([n for _, n in groups])] = np.arange(asked)
        node = number[at]
        rows = np.flatnonzero((node >= 0) & (stats[:, 2] > 0))
        if plan["exact"] and layout.widths and asked * JOINT <= 2 * len(rows):
            joint = joint or joint_codes(block["codes"], layout)
            index, sums = joint_cells(joint, node, stats, asked, layout, rows, None if plan["rule"]["kind"] == "gini" else STEP)
        else:
            index, sums = cells(block["codes"], node, stats, asked, layout, rows)
        first = 0
        for g, nodes in groups:
            a, z = np.searchsorted(index, [first * width, (first + len(nodes)) * width])
            if z > a:
                yield g, (index[a:z] - first * width, sums[a:z])
            first += len(nodes)


def _told_by_siblings(job: list[tuple[int, np.ndarray]], trees: list[Tree], parents: dict) -> dict[tuple[int, int], tuple[int, int]]:
    """(tree, node) -> (parent, sibling) of the larger of two children whose parent's sums are at hand."""
    asked = {(k, int(n)) for k, nodes in job for n in nodes}
    out = {}
    for k, parent in parents:
        nodes = trees[k].nodes
        yes, no = int(nodes["yes"][parent]), int(nodes["no"][parent])
        if (k, yes) in asked and (k, no) in asked:
            more, less = (yes, no) if nodes["rows"][yes] > nodes["rows"][no] else (no, yes)
            out[k, more] = parent, less
    return out


def _level(blocks: Blocks, job: list[tuple[int, np.ndarray]], trees: list[Tree], given: list[dict], depth: int, width: int,
           parents: dict[tuple[int, int], np.ndarray], sums_of: dict[tuple[int, int], np.ndarray]) -> list[tuple]:
    """Sums and splits of every group of nodes of a job.

    Where sums come to the driver, only the smaller of two siblings is added up, the
    other is what ``parents`` have left; ``sums_of`` gets the sums of this job's nodes.
    """
    layout = blocks.layout
    told = _told_by_siblings(job, trees, parents)
    direct = blocks.few((sum(len(nodes) for _, nodes in job) - len(told)) * width)
    asked = [np.array([n for n in nodes if not direct or (k, int(n)) not in told], int) for k, nodes in job]
    of_tree: dict[int, list[int]] = {}
    for g, (k, _) in enumerate(job):
        if len(asked[g]):
            of_tree.setdefault(k, []).append(g)
    kept = direct and blocks.kept is not None
    # Files have the margins of all trees but the last, and the rows' places in it.
    sent = [({**given[k], "rule": asdict(given[k]["rule"]), "filed": kept, "done": [{n: t[n] for n in ROUTE} for t in given[k]["done"][-1:] if depth == 0] if kept else given[k]["done"]},
             {n: trees[k].nodes[n] for n in ROUTE} if kept else trees[k].arrays(), [(g, asked[g]) for g in mine]) for k, mine in of_tree.items()]
    paths = [trees[k].nodes["path"][nodes] for k, nodes in job]
    rules = [(given[k]["rule"], given[k]["seed"]) for k, _ in job]
    code = blocks.level_code

    def groups_of(block: dict):
        return _loaded(code)(block, sent)

    if direct:
        if kept:
            found = blocks.of_level(sent)
            if any(g == NONE for g, _ in found):  # another executor has the files, or none: they are written again
                blocks.keep(given)
                return _level(blocks, job, trees, given, depth, width, parents, sums_of)
        else:
            found = blocks.blocks.flatMap(groups_of).collect()
        got: dict[int, list] = {}
        for g, one in found:
            got.setdefault(g, []).append(one)
        out, kinds = [], 4 if given[job[0][0]]["rule"].kind == "residual" else 3
        for g, (k, _) in enumerate(job):
            whole = np.zeros((len(asked[g]) * width, kinds))
            for index, sums in got.get(g, ()):
                whole[index] += sums
            sums_of.update(zip([(k, int(n)) for n in asked[g]], whole.reshape(len(asked[g]), width, kinds)))
        for (k, node), (parent, sibling) in told.items():
            sums_of[k, node] = parents[k, parent] - sums_of[k, sibling]
        for g, (k, nodes) in enumerate(job):
            whole = np.concatenate([sums_of[k, int(n)] for n in nodes])
            used = np.flatnonzero(whole[:, 2])
            out.append(_choice((used, whole[used]), paths[g], layout, *rules[g], depth))
        if not (blocks.exact or given[job[0][0]]["rule"].kind != "gini"):
            sums_of.clear()
        return out

    def choose(item: tuple) -> tuple:
        g, parts = item
        return g, _choice(added(parts, len(paths[g]) * width), paths[g], layout, *rules[g], depth)

    cores = blocks.spark.sparkContext.defaultParallelism
    chosen = dict(blocks.blocks.flatMap(groups_of).groupByKey(max(1, min(len(job), 4 * cores))).map(choose).collect())
    return [chosen[g] if g in chosen else _choice(added((), 0), paths[g], layout, *rules[g], depth) for g in range(len(job))]


def _small_nodes(trees: list[Tree], given: list[dict], small: list[tuple[int, int, int]]) -> list[tuple]:
    """(tree, its plan, its nodes, [(small node, depth, path)]) per tree."""
    wanted: dict[int, list[tuple[int, int, int]]] = {k: [] for k in range(len(trees))}
    for k, node, depth in small:
        wanted[k].append((node, depth, int(trees[k].nodes["path"][node])))
    return [(k, given[k], trees[k].arrays(), nodes) for k, nodes in wanted.items()]


def _by_group(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, its places) of every group from 0."""
    order = np.argsort(group, kind="stable")[np.count_nonzero(group < 0):]
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    for places in np.split(order, starts[1:]) if len(order) else ():
        yield int(group[places[0]]), places


def _rows_of_small_nodes(block: dict, sent: list[tuple], n_cat: int) -> Iterator[tuple[tuple[int, int], tuple]]:
    """((tree, number of a small node), its training rows as codes and sums without their count)."""
    for k, plan, tree, nodes in sent:
        if nodes:
            stats = _stats(plan["rule"], block, plan, None)
            number = np.full(len(tree["column"]), NONE, np.int64)
            number[[n for n, _, _ in nodes]] = np.arange(len(nodes))
            group = np.where(stats[:, 2] > 0, number[route(tree, block["codes"], n_cat)], NONE)
            short = stats[:, :2].astype(np.float32)
            short = short if np.array_equal(short, stats[:, :2]) else stats[:, :2]
            for g, rows in _by_group(group):
                yield (k, g), (block["codes"][rows], short[rows])


def _subtree(found: list[tuple], layout: Layout, rule: Rule, seed: int, path: int, depth: int) -> Tree:
    stats = np.concatenate([s for _, s in found]).astype(float)
    return finish_locally(np.concatenate([c for c, _ in found]), np.concatenate([stats, np.ones((len(stats), 1))], 1), layout, rule, seed, path, depth)


def _group_parts(blocks: Blocks, trees: list[Tree], small: list[tuple[int, int, int]]) -> int:
    """Partitions for the rows of small nodes."""
    rows = sum(trees[k].nodes["rows"][node] for k, node, _ in small)
    return max(1, min(len(small), max(4 * blocks.spark.sparkContext.defaultParallelism, int(rows // PARTITION_ROWS))))


def _finish(blocks: Blocks, trees: list[Tree], given: list[dict], small: list[tuple[int, int, int]]) -> None:
    """Shuffle the rows of small nodes by (tree, node); every group grows its subtree in a task of its own."""
    layout, n_cat = blocks.layout, len(blocks.layout.sizes)
    sent = _small_nodes(trees, given, small)
    rules = {k: (plan["rule"], plan["seed"], nodes) for k, plan, _, nodes in sent}

    def subtree(item):
        (k, g), found = item
        rule, seed, nodes = rules[k]
        node, depth, path = nodes[g]
        return k, node, _subtree(list(found), layout, rule, seed, path, depth).nodes

    grown: dict[int, list[tuple[int, dict]]] = {}
    rows = blocks.blocks.flatMap(lambda b: _rows_of_small_nodes(b, sent, n_cat)).groupByKey(_group_parts(blocks, trees, small))
    for k, node, sub in sorted(rows.map(subtree).collect(), key=lambda r: r[:2]):
        grown.setdefault(k, []).append((node, sub))
    for k, subs in grown.items():
        nodes, size = trees[k].nodes, len(trees[k])
        parts: dict[str, list] = {name: [nodes[name]] for name in NODE}
        for node, sub in subs:
            for name in NODE:
                moved = np.where(sub[name] != NONE, sub[name] + (size - 1), NONE).astype(NODE[name]) if name in ("yes", "no") else sub[name]
                nodes[name][node] = moved[0]
                parts[name].append(moved[1:])
            size += len(sub["column"]) - 1
        trees[k].nodes = {name: np.concatenate(v) for name, v in parts.items()}


class Votes:
    """Leaf values of the held-out rows, for every setting (depth, rows of a split) and number of trees at once.

    Rows of a block are told by their place in it.  Subtrees of small nodes
    vote in the task that grows them, so no whole tree is held anywhere.
    """

    def __init__(self, settings: list[tuple[int | None, int]], counts: list[int]):
        self.settings, self.counts, self.total = settings, counts, None

    def add(self, blocks: Blocks, trees: list[Tree], given: list[dict], small: list[tuple[int, int, int]]) -> None:
        layout, n_cat, settings, counts = blocks.layout, len(blocks.layout.sizes), self.settings, self.counts
        sent = _small_nodes(trees, given, small)
        plans = {k: (plan["rule"], plan["seed"], nodes, int(np.searchsorted(counts, plan["number"], "right"))) for k, plan, _, nodes in sent}

        def of_tops(block: dict) -> tuple[str, np.ndarray]:
            out = np.zeros((len(block["y"]), len(counts), len(settings)), np.int64)
            for k, plan, tree, nodes in sent:
                held, ends = np.flatnonzero(block["fold"] == plan["fold"]), np.ones(len(tree["column"]), bool)
                ends[[n for n, _, _ in nodes]] = False
                for s, (depth, least) in enumerate(settings):
                    at = route(tree, block["codes"][held], n_cat, depth, least)
                    mine = ends[at]
                    out[held[mine], plans[k][3], s] += np.rint(tree["value"][at[mine]] / VOTE).astype(np.int64)
            return block["name"], out

        def rows_of(block: dict) -> Iterator[tuple]:
            yield from _rows_of_small_nodes(block, sent, n_cat)
            for k, plan, tree, nodes in sent:
                held = np.flatnonzero(block["fold"] == plan["fold"])
                codes = block["codes"][held]
                at = route(tree, codes, n_cat)
                number = np.full(len(tree["column"]), NONE, np.int64)
                number[[n for n, _, _ in nodes]] = np.arange(len(nodes))
                reached = np.stack([route(tree, codes, n_cat, *s) == at for s in settings], 1)
                for g, rows in _by_group(number[at]):
                    yield (k, g), (block["name"], held[rows].astype(np.int32), codes[rows], reached[rows[0]])

        def of_subtree(item: tuple) -> Iterator[tuple]:
            (k, g), found = item
            found = list(found)
            held, (rule, seed, nodes, count) = [f for f in found if len(f) == 4], plans[k]
            node, depth, path = nodes[g]
            if held:
                tree = _subtree([f for f in found if len(f) == 2], layout, rule, seed, path, depth).nodes
                for name, rows, codes, reached in held:
                    out = np.zeros((len(rows), len(settings)), np.int32)
                    for s, (most, least) in enumerate(settings):
                        if reached[s]:
                            at = route(tree, codes, n_cat, None if most is None else most - depth, least)
                            out[:, s] = np.rint(tree["value"][at] / VOTE)
                    yield name, (count, rows, out)

        def summed(parts) -> np.ndarray:
            parts = list(parts)
            out = sum(p for p in parts if not isinstance(p, tuple))
            for count, rows, votes in (p for p in parts if isinstance(p, tuple)):
                out[rows, count] += votes
            return out

        votes = blocks.blocks.map(of_tops)
        if small:
            groups = blocks.blocks.flatMap(rows_of).groupByKey(_group_parts(blocks, trees, small))
            votes = votes.union(groups.flatMap(of_subtree))
        before, votes = self.total, votes if self.total is None else votes.union(self.total)
        self.total = votes.groupByKey(blocks.parts).mapValues(summed).persist(StorageLevel.MEMORY_AND_DISK)
        self.total.foreachPartition(lambda _: None)
        if before is not None:
            before.unpersist()

    def hits(self, blocks: Blocks, wanted: list[tuple[tuple[int | None, int], int]], folds: list[int]) -> np.ndarray:
        """(rows told right, rows) of every wanted (setting, number of trees) and fold."""
        settings, counts = self.settings, self.counts

        def one(item: tuple) -> np.ndarray:
            (fold, y), votes = item[1]
            votes = np.cumsum(votes, 1)
            out = np.zeros((len(wanted), len(folds), 2))
            for i, (setting, count) in enumerate(wanted):
                right = (votes[:, counts.index(count), settings.index(setting)] * VOTE / max(1, count) > 0.5) == (y == 1)
                for j, f in enumerate(folds):
                    out[i, j] = (right & (fold == f)).sum(), (fold == f).sum()
            return out

        rows = blocks.blocks.map(lambda b: (b["name"], (b["fold"], b["y"])))
        got = rows.join(self.total, blocks.parts).map(one).treeReduce(np.add)
        self.total.unpersist()
        return got


# --- estimators ---------------------------------------------------------------------------

BOOSTED = ("Boosted Trees", "xgboost")
KINDS = ("Decision Tree Classifier", "tree", "Random Forest Classifier", "Gradient Boosting Classifier", *BOOSTED)


def rule_of(kind: str, params: dict, n_features: int) -> Rule:
    p = params
    if kind in BOOSTED:
        return Rule("newton", p.get("max_depth", 6), l2=float(p.get("reg_lambda", 1.0)), min_child=float(p.get("min_child_weight", 1.0)),
                    rate=float(p.get("learning_rate", 0.05)), subsample=float(p.get("subsample", 0.8)), by_tree=float(p.get("colsample", 0.8)))
    split = int(p.get("min_samples_split", 2))
    if kind == "Gradient Boosting Classifier":
        return Rule("residual", p.get("max_depth", 3), split, rate=float(p.get("learning_rate", 0.1)))
    if kind == "Random Forest Classifier":
        return Rule("gini", p.get("max_depth"), split, by_node=max(1, int(np.sqrt(n_features))), bootstrap=True)
    return Rule("gini", p.get("max_depth", 10), split)


def rounds_of(kind: str, params: dict) -> int:
    return int(params.get("n_estimators", 400 if kind in BOOSTED else 1 if kind in KINDS[:2] else 100))


def layout_of(encoded: DataFrame, encoder: PipelineModel, spec, max_bins: int = MAX_BINS) -> Layout:
    """Levels of the encoder and bins of the scaled numeric columns: all values if few, else quantiles."""
    from punctual.operators.encode import category_sizes
    cuts = []
    for c in spec.numeric:
        x = F.col(f"{c}_scaled")
        few = [r[0] for r in encoded.where(x.isNotNull()).select(x.alias("x")).distinct().limit(max_bins + 1).collect()]
        if len(few) <= max_bins:
            v = np.sort(np.array(few, float))
            cuts.append(((v[1:] + v[:-1]) / 2).tolist())
        else:
            q = encoded.approxQuantile(f"{c}_scaled", [i / max_bins for i in range(1, max_bins)], 1 / (4 * max_bins))
            cuts.append(np.unique(q).tolist())
    return Layout(list(spec.categorical), category_sizes(encoder, spec), list(spec.numeric), cuts, spec.drop_first)


@dataclass
class TreeModel:
    """A trained ensemble: probability of label 1 from encoded columns."""
    kind: str
    layout: Layout
    trees: list[dict]
    base: float = 0.0
    uid: str = field(default_factory=lambda: f"trees-{uuid.uuid4().hex[:12]}")

    @property
    def additive(self) -> bool:
        return self.kind not in KINDS[:3]

    def scores(self, codes: np.ndarray, trees: list[dict] | None = None) -> np.ndarray:
        """Margins (boosted) or mean leaf shares."""
        out = np.zeros(len(codes))
        for t in self.trees if trees is None else trees:
            out += t["value"][route(t, codes, len(self.layout.sizes))]
        return self.base + out if self.additive else out / max(1, len(self.trees))

    def transform(self, encoded: DataFrame, chosen: str = "probability") -> DataFrame:
        spark = encoded.sparkSession
        columns = [f"{c}__idx" for c in self.layout.categorical] + [f"{c}_scaled" for c in self.layout.numeric]
        given = spark.sparkContext.broadcast((asdict(self.layout), packed(self), self.base, self.additive, len(self.trees)))

        @F.pandas_udf("double")
        def late(*x: pd.Series) -> pd.Series:
            layout, forest, base, additive, n = given.value
            s = run_packed(forest, Layout(**layout).codes([v.to_numpy(dtype=float, na_value=np.nan) for v in x]))
            return pd.Series(1.0 / (1.0 + np.exp(-(base + s))) if additive else s / max(1, n))

        p = late(*[F.col(c).cast("double") for c in columns])
        out = encoded.withColumn("_late", p)
        return out.withColumn(chosen, array_to_vector(F.array(F.lit(1.0) - F.col("_late"), F.col("_late")))).drop("_late")

    @property
    def feature_names_count(self) -> int:
        return int(self.layout.features().max()) + 1

    @property
    def featureImportances(self):
        """Impurity decrease per feature, each tree's shares averaged (gini, residual), or mean gain (newton)."""
        from pyspark.ml.linalg import Vectors
        feature, n = self.layout.features(), self.feature_names_count
        total, splits = np.zeros(n), np.zeros(n)
        for t in self.trees:
            inner = t["column"] >= 0
            gain = np.bincount(feature[t["slot"][inner]], np.maximum(t["gain"][inner], 0), n)
            splits += np.bincount(feature[t["slot"][inner]], minlength=n)
            total += gain if self.kind in BOOSTED else gain / max(gain.sum(), 1e-300)
        if self.kind in BOOSTED:
            total = np.divide(total, splits, out=np.zeros(n), where=splits > 0)
        return Vectors.dense(total / total.sum() if total.sum() > 0 else total)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The node table."""
        frames = [pd.DataFrame({"tree": i, "node": np.arange(len(t["column"])), **{k: v for k, v in t.items() if k != "path"}}) for i, t in enumerate(self.trees)]
        return spark.createDataFrame(pd.concat(frames).astype({"column": "int64"}))

    def save(self, spark: SparkSession, path: str) -> None:
        self.nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = json.dumps({"kind": self.kind, "layout": asdict(self.layout), "base": self.base, "uid": self.uid})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TreeModel":
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
        rows = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])
        trees = [{"column": g["column"].to_numpy(np.int16), **{k: g[k].to_numpy(np.int32) for k in ("slot", "yes", "no")},
                  **{k: g[k].to_numpy(float) for k in ("value", "rows", "weight", "gain")}} for _, g in rows.groupby("tree")]
        return TreeModel(meta["kind"], Layout(**meta["layout"]), trees, meta["base"], meta["uid"])


def packed(model: TreeModel) -> dict:
    """All trees in one pair of arrays, each distinct test once: made for scoring many rows."""
    tests: dict[tuple[int, int], int] = {}
    child, test, value, roots = [], [], [], []
    depth = 1
    for t in model.trees:
        at = len(value)
        roots.append(at)
        node = np.arange(len(t["column"]))
        inner = t["column"] >= 0
        numbers = [tests.setdefault((int(c), int(s)), len(tests)) if i else 0 for c, s, i in zip(t["column"], t["slot"], inner)]
        test += numbers
        child += np.stack([np.where(inner, t["no"], node), np.where(inner, t["yes"], node)], 1).__add__(at).tolist()
        value += t["value"].tolist()
        level, deep = np.zeros(1, np.int64), 0
        while (inner[level]).any():
            level = level[inner[level]]
            level = np.concatenate([t["yes"][level], t["no"][level]])
            deep += 1
        depth = max(depth, deep)
    return {"tests": list(tests), "child": np.array(child, np.int32).reshape(-1), "test": np.array(test, np.int32), "value": np.array(value),
            "roots": np.array(roots, np.int32), "depth": depth, "categorical": len(model.layout.sizes)}


def run_packed(forest: dict, codes: np.ndarray, rows: int = 2048) -> np.ndarray:
    """Sum of all trees' leaf values per row."""
    out = np.zeros(len(codes))
    for a in range(0, len(codes), rows):
        part = codes[a:a + rows]
        met = np.zeros((len(part), max(1, len(forest["tests"]))), np.int32)
        for j, (column, slot) in enumerate(forest["tests"]):
            met[:, j] = part[:, column] == slot if column < forest["categorical"] else part[:, column] <= slot
        met = met.ravel()
        base = (np.arange(len(part), dtype=np.int32) * max(1, len(forest["tests"])))[:, None]
        for b in range(0, len(forest["roots"]), 64):
            at = np.broadcast_to(forest["roots"][b:b + 64], (len(part), len(forest["roots"][b:b + 64])))
            for _ in range(forest["depth"]):
                at = forest["child"][2 * at + met[base + forest["test"][at]]]
            out[a:a + rows] += forest["value"][at].sum(1)
    return out


def _bases(blocks: Blocks, rules: list[Rule], folds: list[int]) -> list[float]:
    """Log-odds of the training rows for gradient boosting; 0 (probability one half) for second-order boosting."""
    if all(rule.kind != "residual" for rule in rules):
        return [0.0] * len(rules)

    def counted(b: dict) -> np.ndarray:
        return np.array([[b["y"][b["fold"] != f].sum(), (b["fold"] != f).sum()] for f in folds], float)

    counts = blocks.blocks.map(counted).treeReduce(np.add)
    return [float(np.log(max(late, 1e-12) / max(n - late, 1e-12))) if rule.kind == "residual" else 0.0 for rule, (late, n) in zip(rules, counts)]


def fit(encoded: DataFrame, encoder: PipelineModel, spec, kind: str, params: dict, label: str = "label", weight: str | None = None,
        key: str | None = None, seed: int = 42) -> TreeModel:
    layout = layout_of(encoded, encoder, spec, int(params.get("max_bins", MAX_BINS)))
    blocks = Blocks(encoded, layout, label, weight, None, key)
    try:
        rule = rule_of(kind, params, int(layout.features().max()) + 1)
        plan = Plan(rule, rounds_of(kind, params), seed=seed, base=_bases(blocks, [rule], [NONE])[0])
        grow(blocks, [plan], blocks.together(64))
    finally:
        blocks.close()
    return TreeModel(kind, layout, [t.arrays() for t in plan.trees], plan.base)


def search(encoded: DataFrame, encoder: PipelineModel, spec, kind: str, candidates: list[dict], folds: list[int], fold: str = "fold",
           label: str = "label", key: str | None = None, seed: int = 42) -> list[float]:
    """Mean held-out accuracy of every candidate.

    Candidates that only cut a larger one (depth, split size, number of trees)
    are read off its trees; the others train side by side, all folds at once.
    """
    layout = layout_of(encoded, encoder, spec)
    blocks = Blocks(encoded, layout, label, None, fold, key)
    n_features, n_cat = int(layout.features().max()) + 1, len(layout.sizes)
    boosted = kind not in KINDS[:3]

    def whole(c: dict) -> tuple:
        return (c.get("learning_rate"), c.get("max_depth")) if boosted else ()

    plans: dict[tuple, Plan] = {}
    for c in candidates:
        for f in folds:
            top = {"n_estimators": max(rounds_of(kind, d) for d in candidates if whole(d) == whole(c))}
            if not boosted:
                depths = [d.get("max_depth", 10 if kind in KINDS[:2] else None) for d in candidates]
                top |= {"max_depth": None if None in depths else max(depths), "min_samples_split": min(d.get("min_samples_split", 2) for d in candidates)}
            plans.setdefault((whole(c), f), Plan(rule_of(kind, c | top, n_features), rounds_of(kind, c | top), f, seed))
    try:
        for p, base in zip(plans.values(), _bases(blocks, [p.rule for p in plans.values()], [f for _, f in plans])):
            p.base = base
        if not boosted:
            def cut(c: dict) -> tuple[int | None, int]:
                return c.get("max_depth", 10 if kind in KINDS[:2] else None), c.get("min_samples_split", 2)

            found = []
            # Folds whose rows are too many to be shuffled at once come one after another.
            for some in [folds] if blocks.together(len(plans)) >= len(plans) else [[f] for f in folds]:
                votes = Votes(list(dict.fromkeys(cut(c) for c in candidates)), sorted({rounds_of(kind, c) for c in candidates}))
                grow(blocks, [p for (_, f), p in plans.items() if f in some], blocks.together(64), votes.add)
                found.append(votes.hits(blocks, [(cut(c), rounds_of(kind, c)) for c in candidates], some))
                if len(some) < len(folds):
                    del votes
                    release(blocks.spark)
            got = np.concatenate(found, 1)
        else:
            grow(blocks, list(plans.values()))
            sent = blocks.spark.sparkContext.broadcast({k: (p.base, [t.arrays() for t in p.trees]) for k, p in plans.items()})

            def hits(block: dict) -> np.ndarray:
                out = np.zeros((len(candidates), len(folds), 2))
                for j, f in enumerate(folds):
                    held = np.flatnonzero(block["fold"] == f)
                    codes = block["codes"][held]
                    for group in dict.fromkeys(whole(c) for c in candidates):  # shorter ensembles are beginnings of the longest
                        base, trees = sent.value[group, f]
                        s, at = np.full(len(held), base), 0
                        for i, c in sorted(((i, c) for i, c in enumerate(candidates) if whole(c) == group), key=lambda x: rounds_of(kind, x[1])):
                            for t in trees[at:rounds_of(kind, c)]:
                                s += t["value"][route(t, codes, n_cat)]
                            at = max(at, rounds_of(kind, c))
                            out[i, j] = ((s > 0) == (block["y"][held] == 1)).sum(), len(held)
                return out

            got = blocks.blocks.map(hits).treeReduce(np.add)
    finally:
        blocks.close()
    return [float(np.mean(got[i, :, 0] / np.maximum(got[i, :, 1], 1))) for i in range(len(candidates))]
