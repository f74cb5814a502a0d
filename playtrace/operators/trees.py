"""Boosted trees, forests and single trees of all games at once, grown from histograms.

Feature values become bins, the distinct values of a game's feature where there are at most BINS of them, else its quantiles. Rows
become blocks of one game each (bins, target, margin), written once and kept in memory where they lie. A level of all trees
under way costs one job: each task sums gradients, Hessians and counts of its blocks by (game, tree, open node, feature, bin),
the sums are added by (game, tree), and the best split of each open node is chosen there; only splits reach the driver. Gradients are second-order: a
split gains 1/2 (GL^2 / (HL + l) + GR^2 / (HR + l) - G^2 / (H + l)), a leaf is worth -G / (H + l).

A forest or a tree needs as many jobs as it has levels, as its trees do not wait for each other; boosting needs that many a round, for all games together. Bootstrap
rows are drawn with Poisson weights from a hash of the row's id, so every task draws alike, also when it runs again. A lost block is read
again from the written table and gets its margin by the trees so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.session import durable

BINS = 255
TASK_ROWS = 250_000  # rows of one task
GAMES = 200  # games that grow together; more are grown in turns, which bounds what the driver and the tasks hold
HISTOGRAM_BYTES = 64 << 20  # of all trees that one task sums up at once
TINY, NEAR = 1e-12, 1e-9  # gains up to TINY are none, gains within a share of NEAR are equal
FLUSH = 10  # rounds of boosting after which margins are stored
NARROW = 3  # first levels of a tree whose splits, seven at most, are tested on whole columns
POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])


@dataclass
class Tree:
    """Nodes in heap order: the children of i are 2 i + 1 and 2 i + 2. feature is -1 for leaves."""

    feature: np.ndarray
    cut: np.ndarray  # the last bin that goes left
    threshold: np.ndarray  # the largest value that goes left
    value: np.ndarray
    cover: np.ndarray

    @classmethod
    def of_depth(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n))

    def leaf_of(self, columns: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """The leaf of each row; columns has a row for each feature. The splits of the first levels are tested on whole columns and their
        answers looked up together, which is faster than gathering each row's own feature; below, only rows not in a leaf go on."""
        top = [i for i in range(2**NARROW - 1) if i < len(self.feature) and self.feature[i] >= 0]
        code = np.zeros(columns.shape[1], np.uint8)
        for bit, i in enumerate(top):
            code |= (columns[self.feature[i]] > limits[i].item()).view(np.uint8) << np.uint8(bit)
        node = self._after(top)[code]
        rows = np.flatnonzero((self.feature >= 0)[node]) if (self.feature[2**NARROW - 1 :] >= 0).any() else []
        while len(rows):
            at = node[rows]
            f = self.feature[at]
            if (f < 0).any():
                rows, at, f = rows[f >= 0], at[f >= 0], f[f >= 0]
            node[rows] = 2 * at + 1 + (columns[f, rows] > limits[at])
        return node

    def _after(self, top: list[int]) -> np.ndarray:
        """The node below the first levels for every combination of answers of their splits, a bit for each."""
        answers = np.arange(1 << len(top))
        node, bit = np.zeros(len(answers), np.int64), {i: k for k, i in enumerate(top)}
        for _ in range(NARROW):
            for i in set(node.tolist()) & set(top):
                at = node == i
                node[at] = 2 * i + 1 + (answers[at] >> bit[i] & 1)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaf_of(x.T, self.threshold)]


@dataclass
class Ensemble:
    base: float
    weight: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.weight * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


@dataclass
class Block:
    """Rows of one game."""

    game: str
    columns: np.ndarray  # bins, a row for each feature
    y: np.ndarray
    key: np.ndarray
    margin: np.ndarray


@dataclass(frozen=True)
class Rule:
    """How trees are grown."""

    depth: int
    share: float  # of a game's rows that a leaf has at least, but three
    ridge: float
    boosted: bool
    logistic: bool
    rate: float = 1.0
    seed: int = 42


def edges(train: DataFrame) -> dict[str, list[np.ndarray]]:
    """For each game and feature the largest value of every bin."""
    values = train.select("game_id", F.posexplode("x").alias("feature", "value")).distinct()
    cuts = values.groupBy("game_id", "feature").agg(F.percentile_approx("value", F.lit([k / BINS for k in range(BINS + 1)]), 10_000).alias("cuts"), F.count("*").alias("n"))
    out: dict[str, dict[int, np.ndarray]] = {}
    for r in cuts.collect():  # GAMES x features rows of at most BINS + 1 numbers
        cut = np.unique(np.array(r["cuts"]), return_inverse=True)[0]
        out.setdefault(r["game_id"], {})[r["feature"]] = np.concatenate([cut, [np.inf]]) if r["n"] > len(cut) else cut
    return {g: [f[k] for k in range(len(f))] for g, f in out.items()}


def _threshold(cuts: np.ndarray, bin_: int, after: int) -> float:
    """Between neighbouring values where bins are single values, else the end of the bin."""
    return float(cuts[bin_]) if np.isinf(cuts[-1]) else float(cuts[bin_] + cuts[after]) / 2


def blocks(train: DataFrame, cuts: dict[str, list[np.ndarray]], rows: int) -> RDD:
    """train (game_id, id, y, x) as blocks, in as many tasks as the rows need."""
    shared = train.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            games, x = np.array(batch.column("game_id").to_pylist(), object), batch.column("x")
            y, key = batch.column("y").to_numpy(), batch.column("key").to_numpy()
            for game in sorted(set(games)):
                at = np.flatnonzero(games == game)
                own = np.array(x.take(pa.array(at)).to_pylist(), float)
                bins = np.stack([np.searchsorted(c, own[:, k]) for k, c in enumerate(shared.value[game])])
                yield pa.RecordBatch.from_arrays([pa.array([game]), *(pa.array([a.tobytes()], pa.binary()) for a in (bins.astype(np.uint16), y[at], key[at]))], ["game", "bins", "y", "key"])

    tasks = max(1, -(-rows // TASK_ROWS))
    cells = train.select("game_id", F.xxhash64("game_id", "id").alias("key"), F.col("y").cast("double").alias("y"), "x")
    cells = durable(cells.mapInArrow(run, "game string, bins binary, y binary, key binary"))

    def block(r) -> Block:
        y = np.frombuffer(r["y"])
        return Block(r["game"], np.frombuffer(r["bins"], np.uint16).reshape(-1, len(y)), y, np.frombuffer(r["key"], np.int64).view(np.uint64), np.zeros(len(y)))

    return cells.rdd.coalesce(tasks).map(block).persist(StorageLevel.MEMORY_AND_DISK)


def _draws(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a bootstrap sample holds each row."""
    h = key ^ np.uint64((0x9E3779B97F4A7C15 * (tree + 1) + seed) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(POISSON, (h >> np.uint64(11)) / 2.0**53).astype(float)


def _margin(block: Block, pending: list[dict[str, Tree]], rate: float) -> np.ndarray:
    return block.margin + rate * sum((t[block.game].value[t[block.game].leaf_of(block.columns, t[block.game].cut)] for t in pending if block.game in t), np.zeros(len(block.y)))


def _sums(parts: Iterator[Block], rule: Rule, trees: dict, open_: dict, features: dict, pending: list, start: dict) -> Iterator[tuple]:
    """((game, tree), sums of gradient, Hessian and count by open node, feature and bin) of a task."""
    total: dict[tuple, np.ndarray] = {}
    for b in parts:
        g, h = -b.y, np.ones(len(b.y))
        if rule.boosted:
            m = start[b.game] + _margin(b, pending, rule.rate)
            p = 1 / (1 + np.exp(-m)) if rule.logistic else m
            g, h = p - b.y, np.maximum(1e-6, p * (1 - p)) if rule.logistic else h
        for (game, number), tree in trees.items():
            if game != b.game or not open_[game, number]:
                continue
            nodes, own = open_[game, number], features[game, number]
            slot = np.full(len(tree.feature), -1)
            slot[nodes] = np.arange(len(nodes))
            at = slot[tree.leaf_of(b.columns, tree.cut)]
            weights, keep, size = [g, h if rule.logistic else None, None], at >= 0, len(nodes) * (BINS + 2)
            if not rule.boosted and number >= 0:
                w = _draws(b.key, number, rule.seed)
                weights, keep = [w * g, w, w], keep & (w > 0)
            keep = np.flatnonzero(keep)
            at, weights = at[keep] * (BINS + 2), [v if v is None else v[keep] for v in weights]
            once = not rule.logistic  # every Hessian is 1, so its sum is the count
            sums = np.empty((3, len(nodes), len(own), BINS + 2))
            for j, f in enumerate(own):
                cell = at + (b.columns[f] if len(keep) == len(b.y) else b.columns[f][keep])
                for v, place in list(zip(weights, sums))[: 3 - once]:
                    place[:, j] = np.bincount(cell, weights=v, minlength=size).reshape(len(nodes), -1)
                if once:
                    sums[2, :, j] = sums[1, :, j]
            total[game, number] = total[game, number] + sums if (game, number) in total else sums
    yield from total.items()


def _best(sums: np.ndarray, least: float, ridge: float) -> list[tuple]:
    """For each open node: its sums, and its best split (place of the feature, bin, next bin, sums on the left) or None."""
    left = np.cumsum(sums, axis=3)
    whole = left[:, :, :1, -1:]
    right = whole - left
    worth = lambda s: s[0] ** 2 / (s[1] + ridge)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 0.5 * (worth(left) + worth(right) - worth(whole))
    gain[(sums[2] == 0) | (left[2] < least) | (right[2] < least) | ~np.isfinite(gain)] = -np.inf
    out = []
    for node in range(gain.shape[0]):
        top, split = gain[node].max(), None
        if top > TINY:  # the first of equal gains, whatever the order of summation
            f, b = divmod(int(np.argmax(gain[node] >= top - NEAR * top)), gain.shape[2])
            after = b + 1 + int(np.argmax(sums[2, node, f, b + 1 :] > 0))
            split = (f, b, after, *left[:, node, f, b])
        out.append((tuple(whole[:, node, 0, 0]), split))
    return out


def _grow(data: RDD, rule: Rule, names: list[tuple], features: dict, least: dict, cuts: dict, pending=(), start=None) -> dict[tuple, Tree]:
    """The trees of the given (game, number), all together, level by level."""
    trees = {n: Tree.of_depth(rule.depth) for n in names}
    open_ = {n: np.array([0]) for n in names}
    for level in range(rule.depth):
        if not any(map(len, open_.values())):
            break
        sums = data.mapPartitions(partial(_sums, rule=rule, trees=trees, open_={k: list(v) for k, v in open_.items()}, features=features, pending=list(pending), start=start))
        if data.getNumPartitions() > 1:
            sums = sums.reduceByKey(np.add, min(data.getNumPartitions(), len(names)))
        ridge = rule.ridge
        found = sums.map(lambda kv: (kv[0], _best(kv[1], least[kv[0][0]], ridge))).collect()
        following: dict[tuple, list[int]] = {n: [] for n in names}
        for name, nodes in found:
            t, game = trees[name], name[0]
            for i, (whole, split) in zip(open_[name], nodes):
                if not level:
                    t.value[i], t.cover[i] = -whole[0] / (whole[1] + ridge), whole[2]
                if split is None or whole[2] < 2 * least[game]:
                    continue
                place, bin_, after, *left = split
                t.feature[i], t.cut[i] = features[name][place], bin_
                t.threshold[i] = _threshold(cuts[game][t.feature[i]], bin_, after)
                for child, s in ((2 * i + 1, left), (2 * i + 2, [a - b for a, b in zip(whole, left)])):
                    t.value[child], t.cover[child] = -s[0] / (s[1] + ridge), s[2]
                    following[name].append(child)
        open_ = {n: np.array(v, int) for n, v in following.items()}
    return trees


def _totals(data: RDD) -> dict[str, tuple[float, float]]:
    """Rows and mean target of each game."""
    sums = dict(data.map(lambda b: (b.game, np.array([len(b.y), b.y.sum()]))).reduceByKey(np.add).collect())
    return {g: (s[0], s[1] / s[0]) for g, s in sums.items()}


def _turns(train: DataFrame) -> Iterator[tuple[DataFrame, int]]:
    """Games in turns of GAMES, the rows of each turn and their number."""
    sizes = sorted((r["game_id"], r["count"]) for r in train.groupBy("game_id").count().collect())  # a row for each game
    for a in range(0, len(sizes), GAMES):
        some = sizes[a : a + GAMES]
        rows = train if len(sizes) <= GAMES else train.where(F.col("game_id").isin([g for g, _ in some]))
        yield rows, sum(n for _, n in some)


def boosted(train: DataFrame, logistic: bool, estimators: int, rate: float, depth: int) -> dict[str, Ensemble]:
    """Gradient boosting of squared or logistic error for each game; train has game_id, id, y and the array x."""
    rule, out = Rule(depth, 0.01, 1.0, True, logistic, rate), {}
    for rows, n in _turns(train):
        cuts = edges(rows)
        data = blocks(rows, cuts, n)
        facts = _totals(data)
        start = {g: float(np.log((m + 1e-6) / (1 - m + 1e-6))) if logistic else m for g, (_, m) in facts.items()}
        least = {g: max(3, int(c * rule.share + 0.5)) for g, (c, _) in facts.items()}
        features = {(g, t): list(range(len(cuts[g]))) for g in facts for t in range(estimators)}
        trees: dict[str, list[Tree]] = {g: [] for g in facts}
        pending: list[dict[str, Tree]] = []
        for t in range(estimators):
            if len(pending) == FLUSH:
                done, older, pending = list(pending), data, []
                data = data.map(lambda b, done=done: Block(b.game, b.columns, b.y, b.key, _margin(b, done, rate))).persist(StorageLevel.MEMORY_AND_DISK)
                data.count()
                older.unpersist()
            grown = _grow(data, rule, [(g, t) for g in facts], features, least, cuts, pending, start)
            pending.append({g: grown[g, t] for g in facts})
            for g in facts:
                trees[g].append(grown[g, t])
        data.unpersist()
        out |= {g: Ensemble(start[g], rate, trees[g]) for g in facts}
    return out


def averaged(train: DataFrame, estimators: int, depth: int, seed: int) -> dict[str, Ensemble]:
    """A forest for each game: bootstrap rows and the root of the number of features, drawn for each tree. One estimator is a plain tree of all rows and features."""
    rule, out = Rule(depth, 0.02, 1e-6, False, False, seed=seed), {}
    for rows, n in _turns(train):
        cuts = edges(rows)
        data = blocks(rows, cuts, n)
        facts = _totals(data)
        least = {g: max(3, int(c * rule.share + 0.5)) for g, (c, _) in facts.items()}
        numbers = range(estimators) if estimators > 1 else [-1]  # no draws for a plain tree
        features = {}
        for g in facts:
            k = len(cuts[g])
            for t in numbers:
                some = np.random.default_rng([seed, t, *g.encode()]).permutation(k)[: max(1, int(k**0.5 + 0.5))] if t >= 0 else range(k)
                features[g, t] = [int(f) for f in sorted(some)]
        widest = 24 * (BINS + 2) * min(50, 2 ** (depth - 1)) * max(map(len, features.values()))
        together = max(1, HISTOGRAM_BYTES // (widest * len(facts)))
        trees: dict[tuple, Tree] = {}
        for a in range(0, len(numbers), together):
            trees |= _grow(data, rule, [(g, t) for g in facts for t in numbers[a : a + together]], features, least, cuts)
        data.unpersist()
        out |= {g: Ensemble(0.0, 1.0 / len(numbers), [trees[g, t] for t in numbers]) for g in facts}
    return out
