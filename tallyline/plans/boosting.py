"""Gradient boosted trees, grown best leaf first over histograms, several models side by side.

Feature values are cut into at most 255 bins at exact quantiles and stored once, as byte blocks.
A round adds one tree to every model. Tasks keep the scores of their rows and add up, for each open
leaf and each bin of each feature, gradients, hessians and rows; only these sums reach the
driver, whose work is therefore bounded by models x leaves x features x bins, however many rows there are.

Splitting the best leaf first is played through on what is counted so far, and all leaves that this would split
are split and counted in one pass, until nothing new comes up. So a tree of n leaves costs about as many passes as
it is deep instead of n - 1, and comes out as if leaves were split one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.scoring import finite_or_zero
from tallyline.operators.ranks import below
from tallyline.session import ensure_checkpoint_dir, staged

BINS = 255
# Rows of one stored block at most, and at least where there are fewer blocks than cores.
BLOCK_ROWS = 20_000
SMALL_BLOCK_ROWS = 1_500
# Partial sums that the driver adds itself; more are added in a tree of tasks.
FLAT_SUMS = 16
# Stored blocks and scores of up to so many bytes are given to a task for each model as they are.
SMALL_BYTES = 32 << 20
KEPT = StorageLevel.MEMORY_AND_DISK
# Rounds after which the scores are written to the shared folder.
CHECKPOINT_ROUNDS = 40
# --- Fixed values -----------------------------------------------------------
L2 = 1.0
LEARNING_RATE = 0.05
MIN_HESSIAN = 1e-3
# More rows than this: a tenth is held out, and a model whose loss there has not
# improved for this many rounds is finished.
EARLY_STOP_ROWS = 10_000
HELD_OUT = 10
PATIENCE = 10
IMPROVEMENT = 1e-7
# ----------------------------------------------------------------------------
NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, base double, features array<string>"


@dataclass(frozen=True)
class Trees:
    """A fitted model: nodes of all trees in flat arrays, ``feature`` -1 at a leaf."""

    features: tuple[str, ...]
    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of rows of feature values."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                low = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)
            out += self.value[at]
        return out

    def probability(self, inputs: Sequence[Column]) -> Column:
        """P(label = 1) of sanitized inputs, given in the order of the features."""
        model = self

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(np.float64) for c in columns])
            return pd.Series(1.0 / (1.0 + np.exp(-model.raw(x))))

        return score(*inputs)

    def save(self, spark: SparkSession, path: str) -> None:
        tree = np.searchsorted(self.roots, np.arange(len(self.feature)), "right") - 1
        columns = (tree, np.arange(len(tree)), self.feature, self.threshold, self.left, self.right, self.value)
        rows = [(*(c[i].item() for c in columns), self.base, list(self.features)) for i in range(len(tree))]
        # A model without trees still has its base.
        rows = rows or [(-1, -1, -1, 0.0, -1, -1, 0.0, self.base, list(self.features))]
        spark.createDataFrame(rows, NODES).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Trees":
        stored = spark.read.schema(NODES).parquet(path).toPandas().sort_values("node")
        base, features = float(stored["base"].iloc[0]), tuple(stored["features"].iloc[0])
        nodes = stored[stored["node"] >= 0]
        roots = nodes.groupby("tree")["node"].min().to_numpy(np.int64)
        kinds = {"feature": np.int32, "threshold": np.float64, "left": np.int32, "right": np.int32, "value": np.float64}
        return Trees(features, base, roots, *(nodes[n].to_numpy(k) for n, k in kinds.items()))


@dataclass(frozen=True)
class Fit:
    """One model to fit: its features, its rows, its size."""

    features: tuple[str, ...]
    rows: Column | None = field(default_factory=lambda: F.lit(True))
    period: str = ""
    rounds: int = 300
    leaves: int = 15
    min_leaf: int = 30
    depth: int | None = None


# --- bins --------------------------------------------------------------------
def cut_points(df: DataFrame, features: Sequence[str], masks: Sequence[str]) -> list[list[np.ndarray]]:
    """For each mask and feature, ascending cut points between at most 255 bins of about equal size.

    Up to 255 distinct values have a bin each. A cut lies half way between the values on its two sides.
    """
    cells = [
        F.struct(F.lit(i).alias("m"), F.lit(j).alias("f"), F.col(f).alias("v"), F.col(m).alias("on"))
        for i, m in enumerate(masks)
        for j, f in enumerate(features)
    ]
    long = df.select(F.explode(F.array(*cells)).alias("c")).where("c.on").select("c.m", "c.f", (F.col("c.v") + 0.0).alias("v"))
    hist = staged(long.groupBy("m", "f", "v").agg(F.count(F.lit(1)).alias("n")))
    sizes = hist.groupBy("m", "f").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("total"))
    ranked = below(hist, ["m", "f"], "v", ["n"]).join(F.broadcast(sizes), ["m", "f"])  # one row for each mask and feature
    by_rank = F.floor(F.lit(BINS) * F.col("n_below") / F.col("total")).cast("double")
    own = F.when(F.col("distinct") <= BINS, F.col("v")).otherwise(by_rank)
    bins = ranked.groupBy("m", "f", own.alias("bin")).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    # At most 255 rows for each mask and feature.
    found = bins.select("m", "f", "low", "high").toPandas().sort_values(["m", "f", "low"])
    out = [[np.zeros(0) for _ in features] for _ in masks]
    for (m, f), part in found.groupby(["m", "f"]):
        high, low = part["high"].to_numpy()[:-1], part["low"].to_numpy()[1:]
        middle = high + (low - high) / 2
        # Neighbouring doubles have no middle.
        out[m][f] = np.where(middle < low, middle, high)
    return out


def _blocks(df: DataFrame, features, masks, label, weight, cuts) -> DataFrame:
    """Rows as byte blocks: bins of each mask, label, weight, masks, and which rows are held out."""
    n_f, n_m = len(features), len(masks)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(k, BLOCK_ROWS)
                column = [part.column(i).to_numpy(zero_copy_only=False) for i in range(part.num_columns)]
                x = column[:n_f]
                bins = np.array([[np.searchsorted(cuts[m][f], x[f], "left") for f in range(n_f)] for m in range(n_m)], np.uint8)
                rest = np.array(column[n_f : n_f + n_m], bool), column[-3].astype(bool), column[-2].astype(np.float64), column[-1].astype(bool)
                yield pa.record_batch(
                    {
                        "n": pa.array([part.num_rows], pa.int64()),
                        "block": pa.array([b"".join(np.ascontiguousarray(v).tobytes() for v in (bins, *rest))], pa.binary()),
                    }
                )

    held = F.pmod(F.xxhash64(*features, F.col(label)), F.lit(HELD_OUT)) == 0
    return df.select(*features, *masks, F.col(label), weight.alias("_w"), held.alias("_held")).mapInArrow(pack, "n long, block binary")


def _unpacked(row, n_f: int, n_m: int) -> dict:
    n, raw, at = row["n"], row["block"], 0
    out = {}
    for name, kind, shape in (
        ("bins", np.uint8, (n_m, n_f, n)), ("masks", bool, (n_m, n)), ("y", bool, (n,)), ("w", np.float64, (n,)), ("held", bool, (n,)),
    ):
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = np.frombuffer(raw[at : at + size], kind).reshape(shape)
        at += size
    return out


# --- trees while they grow ----------------------------------------------------
class _Tree:
    """Nodes by number; the root is 0. Inner nodes know feature place, bin and children."""

    def __init__(self) -> None:
        self.feature, self.bin, self.left, self.right = [-1], [-1], [-1], [-1]

    def split(self, node: int, feature: int, bin_: int) -> tuple[int, int]:
        left = len(self.feature)
        for values in (self.feature, self.bin, self.left, self.right):
            values += [-1, -1]
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, bin_, left, left + 1
        return left, left + 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of a (feature, row) table of bins."""
        at = np.zeros(bins.shape[1], np.int32)
        waiting = [(0, np.arange(bins.shape[1]))]
        while waiting:
            node, rows = waiting.pop()
            if self.feature[node] < 0:
                at[rows] = node
                continue
            low = bins[self.feature[node], rows] <= self.bin[node]
            waiting += [(self.left[node], rows[low]), (self.right[node], rows[~low])]
        return at


def _split_of(hist: np.ndarray, min_leaf: int) -> tuple[float, int, int]:
    """The best gain of a leaf with its feature and bin; a gain of 0 means none. ``hist``: (3, feature, bin)."""
    g, h, n = np.cumsum(hist, axis=2)
    total_g, total_h, total_n = g[:, -1:], h[:, -1:], n[:, -1:]
    right_g, right_h, right_n = total_g - g, total_h - h, total_n - n
    ok = (n >= min_leaf) & (right_n >= min_leaf) & (h >= MIN_HESSIAN) & (right_h >= MIN_HESSIAN)
    gain = g * g / (h + L2) + right_g * right_g / (right_h + L2) - total_g * total_g / (total_h + L2)
    gain = np.where(ok, gain, 0.0)
    at = int(np.argmax(gain))
    best = float(gain.flat[at])
    return (best, at // gain.shape[1], at % gain.shape[1]) if best > 1e-12 else (0.0, -1, -1)


class _Grower:
    """Grows one tree of one model from the histograms of its leaves, pass by pass."""

    def __init__(self, fit: Fit) -> None:
        self.fit, self.tree = fit, _Tree()
        self.hist: dict[int, np.ndarray] = {}
        self.gain: dict[int, tuple[float, int, int]] = {}
        self.depth = {0: 0}
        self.open = [0]
        self.parents: dict[int, int] = {}

    def asked(self) -> list[int]:
        """Leaves to count in the next pass: of two children only the first, the other is the rest of the parent."""
        return [k for k in self.open if k == 0 or k % 2 == 1]

    def take(self, counted: dict[int, np.ndarray]) -> None:
        for node in self.open:
            self.hist[node] = counted[node] if node in counted else self.hist[self.parents[node]] - counted[node - 1]
            deep = self.fit.depth is not None and self.depth[node] >= self.fit.depth
            self.gain[node] = (0.0, -1, -1) if deep else _split_of(self.hist[node], self.fit.min_leaf)
        self.open = []
        splits = self.chosen()
        for n, node in enumerate(splits, 1):
            # What the last split leads to decides nothing.
            if self.tree.feature[node] < 0 and n < self.fit.leaves - 1:
                for child in self._divide(node):
                    self.open.append(child)

    def _divide(self, node: int) -> tuple[int, int]:
        _, feature, cut = self.gain[node]
        children = self.tree.split(node, feature, cut)
        for child in children:
            self.parents[child], self.depth[child] = node, self.depth[node] + 1
        return children

    def chosen(self) -> list[int]:
        """The splits of the tree, best leaf first, as far as leaves are counted; equal gains go by number."""
        out, heap = [], [(-self.gain[0][0], 0)]
        while heap and len(out) < self.fit.leaves - 1:
            loss, node = heappop(heap)
            if loss >= 0:
                break
            out.append(node)
            if self.tree.feature[node] >= 0:
                for child in (self.tree.left[node], self.tree.right[node]):
                    if child in self.gain:
                        heappush(heap, (-self.gain[child][0], child))
        return out

    def finished(self) -> tuple[_Tree, np.ndarray]:
        """The tree of the chosen splits alone, with the values of its leaves."""
        out, values = _Tree(), [0.0]
        chosen, waiting = set(self.chosen()), [(0, 0)]
        for node in chosen:
            if self.tree.feature[node] < 0:
                # Its children were not counted, but their sums are those on both sides of the cut.
                _, feature, cut = self.gain[node]
                left, right = self._divide(node)
                low = self.hist[node][:, feature, : cut + 1].sum(axis=1)
                self.hist[left] = low[:, None, None]
                self.hist[right] = (self.hist[node][:, feature].sum(axis=1) - low)[:, None, None]
        while waiting:
            old, new = waiting.pop()
            if old in chosen:
                children = out.split(new, self.tree.feature[old], self.tree.bin[old])
                values += [0.0, 0.0]
                waiting += zip((self.tree.left[old], self.tree.right[old]), children)
            else:
                g, h = self.hist[old][0, 0].sum(), self.hist[old][1, 0].sum()
                values[new] = -LEARNING_RATE * g / (h + L2)
        return out, np.array(values)


# --- passes -------------------------------------------------------------------
def _start(bases: Sequence[float]) -> Callable[[dict], dict]:
    return lambda b: b | {"score": np.repeat(np.array(bases)[:, None], b["bins"].shape[2], axis=1)}


def _scored(trees: dict[int, tuple[_Tree, np.ndarray]], mask_of, places) -> Callable[[dict], dict]:
    """Add a round's trees to the scores of a block."""

    def add(b: dict) -> dict:
        score = b["score"].copy()
        for m, (tree, values) in trees.items():
            score[m] += values[tree.leaf_of(b["bins"][mask_of[m]][places[m]])]
        return b | {"score": score}

    return add


def _counted(growers: dict[int, tuple[_Tree, list[int]]], mask_of, places, held_out, with_loss: bool) -> Callable[[Iterable[dict]], Iterator[dict]]:
    """Sums of one task: {(model, leaf): (3, feature, bin)} and, by model, the loss on held-out rows."""

    def count(blocks: Iterable[dict]) -> Iterator[dict]:
        sums: dict = {}
        for b in blocks:
            for m, (tree, leaves) in growers.items():
                on = b["masks"][mask_of[m]]
                score = b["score"][m]
                if with_loss and held_out[m]:
                    test = on & b["held"]
                    z = np.where(b["y"][test], score[test], -score[test])
                    loss = np.array([(b["w"][test] * np.logaddexp(0.0, -z)).sum(), b["w"][test].sum()])
                    sums["loss", m] = sums.get(("loss", m), 0) + loss
                rows = np.flatnonzero(on & ~b["held"] if held_out[m] else on)
                bins = b["bins"][mask_of[m]][places[m]][:, rows]
                p = 1.0 / (1.0 + np.exp(-score[rows]))
                w = b["w"][rows]
                g, h = w * (p - b["y"][rows]), w * p * (1.0 - p)
                at = tree.leaf_of(bins)
                # Each asked leaf has a slot, and all of them are counted in one go.
                slot = np.full(len(tree.feature), -1)
                slot[leaves] = np.arange(len(leaves))
                place = slot[at]
                if (mine := np.flatnonzero(place >= 0)).size < len(place):
                    place, bins, g, h = place[mine], bins[:, mine], g[mine], h[mine]
                cells = len(leaves) * (BINS + 1)
                found = np.empty((3, len(bins), cells))
                for f in range(len(bins)):
                    cell = place * (BINS + 1) + bins[f]
                    for k, v in enumerate((g, h, None)):
                        found[k, f] = np.bincount(cell, v, cells)
                found = found.reshape(3, len(bins), len(leaves), BINS + 1)
                for k, leaf in enumerate(leaves):
                    sums[m, leaf] = sums[m, leaf] + found[:, :, k] if (m, leaf) in sums else found[:, :, k].copy()
        yield sums

    return count


def _added(a: dict, b: dict) -> dict:
    return {k: a[k] + b[k] if k in a and k in b else a.get(k, b.get(k)) for k in a.keys() | b.keys()}


def fit_many(df: DataFrame, fits: Sequence[Fit], label: str, weight: str | None = None) -> list[Trees]:
    """Fit several models on one table, round by round side by side.

    ``df`` has 0/1 labels without NULLs. Fits that name the same ``period`` share their rows and bins. A model without
    rows is an error; one class alone gives a model of its share. Row order, and how the rows are
    dealt over tasks, change sums only in their last bits.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    features = list(dict.fromkeys(f for fit in fits for f in fit.features))
    periods = list(dict.fromkeys(fit.period for fit in fits))
    masks = [f"_on_{i}" for i in range(len(periods))]
    of_period = {fit.period: fit.rows for fit in fits}
    on = {m: F.coalesce(of_period[p], F.lit(False)) for m, p in zip(masks, periods)}
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    columns = {f: finite_or_zero(F.col(f)) for f in features}
    rows = staged(df.select(*[c.alias(f) for f, c in columns.items()], *[c.alias(m) for m, c in on.items()], F.col(label).cast("int").alias(label), w.alias("_weight")))
    facts = rows.agg(*[F.count_if(m).alias(f"n{m}") for m in masks], *[F.sum(F.when(F.col(m), F.col("_weight"))).alias(f"w{m}") for m in masks], *[F.sum(F.when(F.col(m), F.col("_weight") * F.col(label))).alias(f"p{m}") for m in masks], F.count(F.lit(1)).alias("n")).first()
    mask_of = [periods.index(fit.period) for fit in fits]
    places = [[features.index(f) for f in fit.features] for fit in fits]
    if not all(facts[f"n{m}"] for m in masks):
        raise ValueError("cannot fit a model on an empty frame")
    shares = [min(max(facts[f"p{m}"] / facts[f"w{m}"], 1e-9), 1 - 1e-9) for m in masks]
    bases = [float(np.log(shares[k] / (1 - shares[k]))) for k in mask_of]
    held_out = [facts[f"n{masks[k]}"] > EARLY_STOP_ROWS for k in mask_of]
    cuts = cut_points(rows, features, masks)
    n_f, n_m = len(features), len(masks)
    spread = min(spark.sparkContext.defaultParallelism, -(-facts["n"] // SMALL_BLOCK_ROWS))
    parts = max(-(-facts["n"] // BLOCK_ROWS), spread)
    blocks = staged(_blocks(rows.repartition(parts), features, masks, label, F.col("_weight"), cuts))
    size = blocks.agg(F.sum(F.length("block"))).first()[0]
    plan = _Plan(list(fits), bases, mask_of, places, held_out)
    if size + facts["n"] * 8 * len(fits) <= SMALL_BYTES:
        # Few rows: a task for each model, with all blocks; the same passes, without a job for each.
        near = spark.sparkContext.broadcast([(row["n"], bytes(row["block"])) for row in blocks.collect()])

        def alone(m: int) -> list[tuple[_Tree, np.ndarray]]:
            return _Near(plan, [_unpacked({"n": n, "block": raw}, n_f, n_m) for n, raw in near.value]).grown([m])[m]

        done = spark.sparkContext.parallelize(range(len(fits)), len(fits)).map(alone).collect()
        near.destroy()
    else:
        found = _Far(plan, blocks.rdd.map(lambda row: _unpacked(row, n_f, n_m)), parts).grown(range(len(fits)))
        done = [found[m] for m in range(len(fits))]
    return [_flat(fit, base, trees, cuts[k], place) for fit, base, trees, k, place in zip(fits, bases, done, mask_of, places)]


@dataclass
class _Plan:
    """What is to be fitted: by model its size, start, mask, places of its features and whether rows are held out."""

    fits: list[Fit]
    bases: list[float]
    mask_of: list[int]
    places: list[list[int]]
    held_out: list[bool]

    def __getstate__(self) -> dict:
        # Tasks need sizes only; a condition on rows is bound to the driver.
        plain = [Fit(f.features, None, f.period, f.rounds, f.leaves, f.min_leaf, f.depth) for f in self.fits]
        return self.__dict__ | {"fits": plain}


class _Rounds:
    """Rounds of several models over rows that a subclass holds."""

    def __init__(self, plan: _Plan) -> None:
        self.plan = plan

    def grown(self, models: Iterable[int]) -> dict[int, list[tuple[_Tree, np.ndarray]]]:
        """The trees of some models, round by round."""
        fits, held_out = self.plan.fits, self.plan.held_out
        done: dict[int, list[tuple[_Tree, np.ndarray]]] = {m: [] for m in models}
        losses: dict[int, list[float]] = {m: [] for m in done}
        live = {m for m in done if fits[m].rounds}
        while live:
            growers, first = {m: _Grower(fits[m]) for m in sorted(live)}, True
            while asked := {m: (g.tree, g.asked()) for m, g in growers.items() if g.open}:
                sums = self.counted(asked, first)
                if first:
                    for m in asked:
                        if held_out[m]:
                            loss, total = sums["loss", m]
                            losses[m].append(loss / max(total, 1e-300))
                            if _stalled(losses[m]):
                                live.discard(m)
                    growers = {m: g for m, g in growers.items() if m in live}
                for m, g in growers.items():
                    if m in asked and g.open:
                        g.take({leaf: sums[m, leaf] for leaf in asked[m][1]})
                first = False
            trees = {m: g.finished() for m, g in growers.items()}
            for m, tree in trees.items():
                done[m].append(tree)
                # Where nothing can be split, later rounds would not find more.
                if len(tree[1]) == 1 or len(done[m]) >= fits[m].rounds:
                    live.discard(m)
            if live:
                self.advance(trees)
        self.end()
        return done

    def counted(self, asked: dict, first: bool) -> dict:
        raise NotImplementedError

    def advance(self, trees: dict) -> None:
        raise NotImplementedError

    def end(self) -> None:
        pass


class _Near(_Rounds):
    """All blocks in this task."""

    def __init__(self, plan: _Plan, blocks: list[dict]) -> None:
        super().__init__(plan)
        self.blocks = list(map(_start(plan.bases), blocks))

    def counted(self, asked: dict, first: bool) -> dict:
        (sums,) = _counted(asked, self.plan.mask_of, self.plan.places, self.plan.held_out, first)(self.blocks)
        return sums

    def advance(self, trees: dict) -> None:
        self.blocks = list(map(_scored(trees, self.plan.mask_of, self.plan.places), self.blocks))


class _Far(_Rounds):
    """Blocks dealt over the cluster; a pass is a job, a round's scores are kept by the executors."""

    def __init__(self, plan: _Plan, blocks, parts: int) -> None:
        super().__init__(plan)
        self.state, self.before, self.parts, self.turn = blocks.map(_start(plan.bases)).persist(KEPT), None, parts, 0

    def counted(self, asked: dict, first: bool) -> dict:
        partial = self.state.mapPartitions(_counted(asked, self.plan.mask_of, self.plan.places, self.plan.held_out, first))
        sums = partial.reduce(_added) if self.parts <= FLAT_SUMS else partial.treeReduce(_added)
        if first and self.before is not None:
            self.before.unpersist()
        return sums

    def advance(self, trees: dict) -> None:
        add = _scored(trees, self.plan.mask_of, self.plan.places)
        self.before, self.state, self.turn = self.state, self.state.map(add).persist(KEPT), self.turn + 1
        if self.turn % CHECKPOINT_ROUNDS == 0:
            self.state.checkpoint()

    def end(self) -> None:
        for held in (self.before, self.state):
            if held is not None:
                held.unpersist()


def _stalled(losses: list[float]) -> bool:
    """Whether none of the last rounds improved on the loss before them."""
    if len(losses) <= PATIENCE:
        return False
    return min(losses[-PATIENCE:]) > losses[-PATIENCE - 1] - IMPROVEMENT


def _flat(fit: Fit, base: float, trees, cuts: list[np.ndarray], place: list[int]) -> Trees:
    roots, feature, threshold, left, right, value = [], [], [], [], [], []
    for tree, values in trees:
        at = len(feature)
        roots.append(at)
        for k, f in enumerate(tree.feature):
            feature.append(f)
            threshold.append(float(cuts[place[f]][tree.bin[k]]) if f >= 0 else 0.0)
            left.append(at + tree.left[k] if f >= 0 else -1)
            right.append(at + tree.right[k] if f >= 0 else -1)
            value.append(float(values[k]))
    return Trees(
        fit.features, base, np.array(roots, np.int64), np.array(feature, np.int32), np.array(threshold, np.float64),
        np.array(left, np.int32), np.array(right, np.int32), np.array(value, np.float64),
    )
