"""Second-order boosted trees for a binary target, trained by histogram passes over packed rows.

Rows are packed once into blocks of category places, numeric bins, labels and weights, written as a table and
kept by the executors. A tree level is one pass: each task routes its rows down the tree so far, sums gradients and hessians by
(node, column, bin), the sums are added up by (node, column, slice) across tasks, and each slice returns its best
split. The driver sees one candidate for each of them, never rows; it adds up the sums itself only where they are
small, whatever the rows, and then has one of two children from the sums of the parent and the other. Wide category columns are cut into slices, so no task holds a whole one.

A category column stands for its one-hot inputs: a split sends one category right and all other rows left. Gradients
are whole numbers of a fixed scale, so sums, splits and leaves don't depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel

ROW_BLOCK = 16_384
SLICE = 4_096  # categories whose sums travel together
GATHERED_BYTES = 64 << 20  # sums of a level that take no more of the driver are added up by it, which saves a shuffle
MERGED_ROWS = 65_536  # blocks of a partition are joined up to so many rows, as each costs the same few steps for a node and column
PART_ROWS = 4_000_000  # of a task, where there are more rows than cores take at once
WIDE = 1_024  # codes of a column, above which a block's sums are taken over the range of those that it has
REFRESH = 5  # trees after which the margins are kept anew
BINS = 256  # of a numeric column, at approximate quantiles


@dataclass(frozen=True)
class Settings:
    rounds: int = 300
    rate: float = 0.03
    depth: int = 4
    min_child: float = 2.0  # hessian of a child
    ridge: float = 1.0
    row_share: float = 0.8  # of the rows, drawn for each tree
    column_share: float = 0.8  # of the one-hot and numeric inputs, drawn for each tree
    least_gain: float = 1e-6
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number: ``column`` (-1: a leaf) with ``code``, a category's place or the last bin that goes left."""

    column: list = field(default_factory=lambda: [-1])
    code: list = field(default_factory=lambda: [0])
    gap_left: list = field(default_factory=lambda: [True])
    left: list = field(default_factory=lambda: [0])
    right: list = field(default_factory=lambda: [0])
    g: list = field(default_factory=lambda: [0])
    h: list = field(default_factory=lambda: [0])

    def split(self, node, column, code, gap_left, sums) -> tuple[int, int]:
        """Turn a leaf into a split; ``sums`` are g and h of the left and of the right child."""
        self.column[node], self.code[node], self.gap_left[node] = column, code, gap_left
        for side, (g, h) in zip((self.left, self.right), sums):
            side[node] = len(self.column)
            for values, new in ((self.column, -1), (self.code, 0), (self.gap_left, True), (self.left, 0), (self.right, 0),
                                (self.g, g), (self.h, h)):
                values.append(new)
        return self.left[node], self.right[node]

    def leaf_values(self, settings: Settings, scale: float) -> np.ndarray:
        g, h = np.array(self.g) / scale, np.array(self.h) / scale
        return np.where(np.array(self.column) < 0, -settings.rate * g / (h + settings.ridge), 0.0)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with every bit spread."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(keys: np.ndarray, share: float, *salt: int) -> np.ndarray:
    """Whether each key is in a draw of ``share`` of all keys; the same for the same salt, wherever the key is."""
    if share >= 1:
        return np.ones(len(keys), bool)
    state = np.zeros(1, np.uint64)
    for s in salt:
        state = mixed(state + np.uint64(s + 1))
    return mixed(keys.astype(np.uint64) ^ state) < np.uint64(int(share * 2.0 ** 64))


@dataclass
class Block:
    """Packed rows: ``codes`` holds, by column, the places of categories (-1: unseen) and then the numeric bins (0: a gap)."""

    codes: np.ndarray
    y: np.ndarray
    w: np.ndarray
    key: np.ndarray
    margin: np.ndarray

    def route(self, tree: Tree, values: np.ndarray, n_categorical: int) -> np.ndarray:
        """The value, one for each node, of the leaf that each row reaches.

        Rows carry the leaf's number in as few bytes as it takes until they have come to the root; the values are looked up then.
        """
        out, kind = {}, np.min_scalar_type(len(tree.column))
        for node in range(len(tree.column) - 1, -1, -1):  # children have larger numbers
            c = tree.column[node]
            if c < 0:
                out[node] = kind.type(node)
                continue
            code, split = self.codes[:, c], tree.code[node]
            if c < n_categorical:
                goes_right = code == split
            else:
                goes_right = code > split
                if not tree.gap_left[node]:
                    goes_right |= code == 0
            left, right = out.pop(tree.left[node]), out.pop(tree.right[node])
            out[node] = left ^ ((left ^ right) & -goes_right.astype(kind))  # all bits are set where the row goes right
        return np.broadcast_to(values[out[0]], len(self.y))

    def taken(self, rows: np.ndarray) -> Block:
        """The block of some of its rows."""
        if len(rows) == len(self.y):
            return self
        codes = np.empty((len(rows), self.codes.shape[1]), self.codes.dtype, order="F")
        for c in range(codes.shape[1]):
            np.take(self.codes[:, c], rows, out=codes[:, c])
        return Block(codes, self.y[rows], self.w[rows], self.key[rows], self.margin[rows])


def merged_blocks(blocks, rows: int = MERGED_ROWS):
    """The same rows in order in fewer blocks of at most ``rows`` rows, where a single block isn't larger."""
    held, n = [], 0
    for block in blocks:
        if held and n + len(block.y) > rows:
            yield _joined(held)
            held, n = [], 0
        held.append(block)
        n += len(block.y)
    if held:
        yield _joined(held)


def _joined(blocks: list[Block]) -> Block:
    if len(blocks) == 1:
        return blocks[0]
    codes = np.empty((sum(len(b.y) for b in blocks), blocks[0].codes.shape[1]), blocks[0].codes.dtype, order="F")
    np.concatenate([b.codes for b in blocks], out=codes)
    return Block(codes, *[np.concatenate([getattr(b, c) for b in blocks]) for c in ("y", "w", "key", "margin")])


def gradients(block: Block, margin: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted logistic gradient and hessian as whole numbers."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint(block.w * (p - block.y) * scale), np.rint(block.w * p * (1.0 - p) * scale)


def level_sums(block: Block, place: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray, widths: list[int], into: dict) -> None:
    """Add the block's sums to ``into``, by (node's place, column, slice); rows of place -1 have no part.

    A column's ``width`` counts its codes, for a category column without the unseen one. Each slice ends with the sums of the
    rows that have none of its codes, so its total is that of the node; it is that row alone where no row has any.
    """
    part_of = place >= 0
    n = np.count_nonzero(part_of)
    if 2 * n < len(place):
        rows = np.flatnonzero(part_of)
        place, g, h, codes = place[rows], g[rows], h[rows], lambda c: block.codes[:, c][rows]
        there = np.bincount(place, minlength=nodes) > 0
    else:  # the others add nothing, which takes less than leaving them out of every column
        there = np.bincount(place + 1, minlength=nodes + 1)[1:] > 0
        place, g, h, codes = np.where(part_of, place, 0), g * part_of, h * part_of, lambda c: block.codes[:, c]
    whole = np.stack([np.bincount(place, x, nodes) for x in (g, h)], 1).astype(np.int64)
    for c, width in enumerate(widths):
        code = codes(c)
        known = code >= 0
        step, parts = min(SLICE, max(width, 1)), max(1, -(-width // SLICE))
        at = place * (parts * step) + code
        at, weights = (at, (g, h)) if known.all() else (at[known], (g[known], h[known]))
        touched = range(nodes * parts)
        if nodes * parts * step > max(1 << 18, 4 * len(place)):  # a wide column: only the slices that have rows
            touched, where = np.unique(at // step, return_inverse=True)
            at = where * step + at % step
        sums = np.stack([np.bincount(at, x, len(touched) * step) for x in weights], 1).astype(np.int64)
        sums = sums.reshape(len(touched), step, 2)
        held = {int(k): sums[i] for i, k in enumerate(touched)}
        for node in np.flatnonzero(there):
            for part in range(parts):
                size, values = min(step, width - part * step), whole[node][None]
                mine = held.get(int(node) * parts + part)
                if mine is not None and mine.any():
                    values = np.concatenate([mine[:size], (whole[node] - mine[:size].sum(0))[None]])
                key = (int(node), c, part)
                into[key] = added(into[key], values) if key in into else values


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of one slice from two places."""
    if len(a) == len(b):
        return a + b
    longer, last = (a, b) if len(a) > len(b) else (b, a)
    out = longer.copy()
    out[-1] += last[-1]
    return out


def best_split(values: np.ndarray, categorical: bool, column: int, part: int, first_input: int, round_: int,
               settings: Settings, scale: float, allowed: np.ndarray | None = None):
    """The best split of one slice: ``(gain, column, code, gap_left, left sums, right sums)`` or None.

    ``allowed`` may bring the slice's draw of inputs where several nodes share it.
    """
    whole = values.sum(0)
    if categorical:
        right = values[:-1]  # empty where no row has a category of the slice
        sides = [(right, 0, True)]
    else:
        upto = np.cumsum(values[1:-1], 0)[:-1]  # code 0 is the gap; the last bin has nothing to its right
        # Gaps go with the left part or, where that is better, with the right one.
        sides = [(whole - upto - values[0], 1, True), (whole - upto, 1, False)]
    if allowed is None:
        allowed = drawn_inputs(len(right) if categorical else 1, categorical, part, first_input, round_, settings)
    if not allowed.any():
        return None
    best = None
    for right, first, gap_left in sides:
        if not len(right):
            continue
        (rg, rh), (lg, lh) = right.T / scale, (whole - right).T / scale
        score = lambda g, h: g * g / (h + settings.ridge)
        gain = score(lg, lh) + score(rg, rh) - score(*(whole / scale))
        gain[~((lh >= settings.min_child) & (rh >= settings.min_child) & allowed[:len(right)])] = -np.inf
        at = int(np.argmax(gain))
        if gain[at] > settings.least_gain and (best is None or gain[at] > best[0]):
            r = right[at]
            best = (float(gain[at]), column, first + at + (part * SLICE if categorical else 0), gap_left,
                    tuple((whole - r).tolist()), tuple(r.tolist()))
    return best


def drawn_inputs(n: int, categorical: bool, part: int, first_input: int, round_: int, settings: Settings) -> np.ndarray:
    """Whether each of a slice's ``n`` inputs is in the draw of a tree; a numeric column has one."""
    inputs = first_input + part * SLICE + np.arange(n) if categorical else np.array([first_input])
    return drawn(inputs, settings.column_share, settings.seed, 2, round_)


def fit_trees(blocks, widths: list[int], n_categorical: int, rows: int, heaviest: float, settings: Settings) -> tuple[list[Tree], float]:
    """Boost over an RDD of ``Block``; returns the trees and the scale of their sums.

    ``widths`` are the numbers of codes by column (numeric: bins and the gap), ``heaviest`` the largest row weight. The
    margins of the rows are kept by the executors every ``REFRESH`` trees; whatever an executor loses is made
    again from the written blocks and the trees.
    """
    bits = math.ceil(math.log2(max(2, rows) * max(1.0, heaviest)))
    scale = 2.0 ** min(30, 62 - bits)
    inputs = np.cumsum([0] + [w if c < n_categorical else 1 for c, w in enumerate(widths)]).tolist()
    parts = blocks.getNumPartitions()
    tasks = max(1, min(parts, blocks.context.defaultParallelism * 4))
    gathered = CodeSums(widths).gathered_bytes(parts, 2 ** (settings.depth - 1)) <= GATHERED_BYTES
    kept, trees, since = blocks.persist(StorageLevel.MEMORY_AND_DISK_DESER), [], []
    older = None
    try:
        for round_ in range(settings.rounds):
            tree, places = Tree(), {0: 0}
            level = _GatheredLevels(widths, n_categorical, inputs, round_, settings, scale) if gathered else None
            for _ in range(settings.depth):
                found = level.found(kept, since, tree, places) if gathered else _level(
                    kept, since, tree, places, widths, n_categorical, inputs, round_, settings, scale, tasks)
                new = _add_splits(tree, places, found)
                if not new:
                    break
                places = {n: i for i, n in enumerate(n for _, *children in new for n in children)}
            if tree.column == [-1]:
                tree.g[0], tree.h[0] = _totals(kept, since, round_, n_categorical, settings, scale)
            since.append((tree, tree.leaf_values(settings, scale)))
            trees.append(tree)
            if len(since) == REFRESH and round_ + 1 < settings.rounds:
                if older is not None:
                    older.unpersist()
                older, kept = kept, _advanced(kept, since, n_categorical).persist(StorageLevel.MEMORY_AND_DISK_DESER)
                since = []
        return trees, scale
    finally:
        for held in (older, kept):
            if held is not None:
                held.unpersist()


def widest(widths: list[int]) -> int:
    """The column by whose codes rows are dealt to tasks."""
    return int(np.argmax(widths))


def _add_splits(tree: Tree, places: dict, found) -> list[tuple[int, int, int]]:
    """Split the open nodes (``places`` by node) where a slice has a split; ``(node, left, right)`` of each.

    ``found`` are ``((place, column, slice), split)``; the largest gain counts, then the first column and code.
    """
    best = {}
    for (place, *_), split in found:
        if split is not None:
            order = (-split[0], split[1], split[2])
            if place not in best or order < best[place][0]:
                best[place] = (order, split)
    node_of, new = {p: n for n, p in places.items()}, []
    for place in sorted(best):
        _, column, code, gap_left, left, right = best[place][1]
        node = node_of[place]
        if node == 0:
            tree.g[0], tree.h[0] = left[0] + right[0], left[1] + right[1]
        new.append((node, *tree.split(node, column, code, gap_left, (left, right))))
    return new


class CodeSums:
    """Sums of a node's rows as one array of all columns: for each a place for the unseen code, then one for each of its codes.

    The widest column is the last; of that one a task tells only the range of codes that its rows have.
    """

    def __init__(self, widths: list[int]):
        self.widths, wide = widths, widest(widths)
        self.order = [c for c in range(len(widths)) if c != wide] + [wide]
        self.start = dict(zip(self.order, np.cumsum([0] + [widths[c] + 1 for c in self.order]).tolist()))
        self.narrow, self.size = self.start[wide], self.start[wide] + widths[wide] + 1

    def add(self, block: Block, place: np.ndarray, g: np.ndarray, h: np.ndarray, into: np.ndarray) -> None:
        """Add the rows' sums to ``into``, by (place, code)."""
        if not len(place):
            return
        for c in self.order:
            codes, width, start = block.codes[:, c], self.widths[c] + 1, self.start[c]
            if width > WIDE:  # rows are dealt by ranges of the widest column, so a block has few of its codes
                low, high = int(codes.min()), int(codes.max()) + 1
                codes, width, start = codes - codes.dtype.type(low + 1), high - low, start + low + 1
            code = place * width + codes + 1
            for i, x in enumerate((g, h)):
                into[:, start:start + width, i] += np.bincount(code, x, len(into) * width).astype(np.int64).reshape(-1, width)

    def gathered_bytes(self, parts: int, nodes: int) -> int:
        """What a level of ``nodes`` takes of the driver: what ``parts`` tasks tell of half of the nodes, and the sums of all.

        The tasks' ranges of the widest column together are that column, as rows are dealt by its codes; they may share their ends.
        """
        told = -(-nodes // 2) * (parts * (self.narrow + 1) + self.size - self.narrow)
        return 16 * (told + 2 * nodes * self.size)

    def told(self, sums: np.ndarray) -> tuple[int, bytes, bytes]:
        met = np.flatnonzero(sums[:, self.narrow:].any((0, 2)))
        low, high = (self.narrow + int(met[0]), self.narrow + int(met[-1]) + 1) if len(met) else (self.narrow, self.narrow)
        return low, sums[:, :self.narrow].tobytes(), sums[:, low:high].tobytes()

    def added(self, told, nodes: int) -> np.ndarray:
        total = np.zeros((nodes, self.size, 2), np.int64)
        for low, narrow, wide in told:
            total[:, :self.narrow] += np.frombuffer(narrow, np.int64).reshape(nodes, -1, 2)
            wide = np.frombuffer(wide, np.int64).reshape(nodes, -1, 2)
            total[:, low:low + wide.shape[1]] += wide
        return total

    def slices(self, sums: np.ndarray, n_categorical: int):
        """``(column, slice)`` of one node with the values that ``best_split`` takes; numeric columns are one slice."""
        whole = sums[self.start[0]:self.start[0] + self.widths[0] + 1].sum(0)
        for c, width in enumerate(self.widths):
            known = sums[self.start[c] + 1:self.start[c] + 1 + width]
            step = SLICE if c < n_categorical else max(1, width)
            for part in range(max(1, -(-width // step))):
                mine = known[part * step:(part + 1) * step]
                yield (c, part), np.concatenate([mine, (whole - mine.sum(0))[None]])


class _GatheredLevels:
    """The levels of one tree where the driver adds up the sums.

    Of two children the rows of one are summed, of the other the sums are what that one leaves of the parent's; whole numbers
    make that exact.
    """

    def __init__(self, widths, n_categorical, inputs, round_, settings, scale):
        self.sums, self.by_code, self.draws = {}, CodeSums(widths), {}
        self.n_categorical, self.inputs, self.round_, self.settings, self.scale = n_categorical, inputs, round_, settings, scale

    def found(self, blocks, since, tree: Tree, places: dict):
        if not self.sums:
            self.sums = dict(zip(places, self._summed(blocks, since, tree, list(places))))
        else:
            parents = [n for n in self.sums if tree.column[n] >= 0]
            pairs = [sorted((tree.left[n], tree.right[n]), key=lambda child: tree.h[child]) for n in parents]
            fewer = self._summed(blocks, since, tree, [less for less, _ in pairs])
            self.sums = {child: sums for n, (less, more), mine in zip(parents, pairs, fewer)
                         for child, sums in ((less, mine), (more, self.sums[n] - mine))}
        for node, place in places.items():
            for (column, part), values in self.by_code.slices(self.sums[node], self.n_categorical):
                yield (place, column, part), self._best(values, column, part)

    def _best(self, values, column, part):
        categorical = column < self.n_categorical
        if (column, part) not in self.draws:
            n = len(values) - 1 if categorical else 1
            self.draws[column, part] = drawn_inputs(n, categorical, part, self.inputs[column], self.round_, self.settings)
        return best_split(values, categorical, column, part, self.inputs[column], self.round_, self.settings, self.scale,
                          self.draws[column, part])

    def _summed(self, blocks, since, tree, nodes: list[int]) -> np.ndarray:
        """The sums of all tasks' rows of ``nodes``, by (node, code)."""
        by_code, n_categorical, round_, settings, scale = self.by_code, self.n_categorical, self.round_, self.settings, self.scale
        since, lookup = list(since), np.full(len(tree.column), -1, np.int64)
        lookup[nodes] = range(len(nodes))

        def partial(some):
            into = np.zeros((len(nodes), by_code.size, 2), np.int64)
            for block in some:
                place = block.route(tree, lookup, n_categorical)
                rows = np.flatnonzero((place >= 0) & drawn(block.key, settings.row_share, settings.seed, 1, round_))
                block, place = block.taken(rows), place[rows]
                by_code.add(block, place, *gradients(block, _margin(block, since, n_categorical), scale), into)
            return [by_code.told(into)]

        return by_code.added(blocks.mapPartitions(partial).collect(), len(nodes))


def _margin(block: Block, since, n_categorical: int) -> np.ndarray:
    margin = block.margin
    for tree, values in since:
        margin = margin + block.route(tree, values, n_categorical)
    return margin


def _advanced(blocks, since, n_categorical: int):
    since = list(since)

    def step(block: Block) -> Block:
        return Block(block.codes, block.y, block.w, block.key, _margin(block, since, n_categorical))

    return blocks.map(step, preservesPartitioning=True)


def _totals(blocks, since, round_, n_categorical, settings, scale):
    since = list(since)

    def of(block: Block):
        g, h = gradients(block, _margin(block, since, n_categorical), scale)
        mine = drawn(block.key, settings.row_share, settings.seed, 1, round_)
        return np.array([g[mine].sum(), h[mine].sum()]).astype(np.int64)

    return blocks.map(of).fold(np.zeros(2, np.int64), lambda a, b: a + b).tolist()


def _level(blocks, since, tree, places, widths, n_categorical, inputs, round_, settings, scale, tasks):
    """``((place, column, slice), best split)`` of every slice of the open nodes, ``places`` by node."""
    since, nodes = list(since), len(places)
    lookup = np.full(len(tree.column), -1, np.int64)
    for node, place in places.items():
        lookup[node] = place

    def partial(some):
        into = {}
        for block in some:
            g, h = gradients(block, _margin(block, since, n_categorical), scale)
            place = block.route(tree, lookup, n_categorical).copy()
            place[~drawn(block.key, settings.row_share, settings.seed, 1, round_)] = -1
            level_sums(block, place, nodes, g, h, widths, into)
        return into.items()

    def best(item):
        (place, column, part), values = item
        split = best_split(values, column < n_categorical, column, part, inputs[column], round_, settings, scale)
        return (place, column, part), split

    return blocks.mapPartitions(partial).reduceByKey(added, tasks).map(best).collect()
