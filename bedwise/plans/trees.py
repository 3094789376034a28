"""Deep regression trees on Spark: rows are dealt to nodes, and a node that is small enough is finished in one task.

Rows travel as blocks: the bins of up to a batch of rows in one binary value. Each (tree, block) draws its bootstrap weights from a
generator of its own, so a row has the same weight in all passes. Nodes of more than ``NODE_ROWS`` rows are split level by level
by histograms that all tasks add up; of those only, bounded by rows / NODE_ROWS for a tree, the driver holds the splits. The rows of
the nodes below are dealt by (tree, node), and everything under such a node is grown in its task and written as one record.

As in MLlib a split is the one of largest variance gain among all features, at bounds between at most ``bins`` bins, and leaves
hold ``min_leaf`` rows or more, repeated draws counted.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedwise.sources.work import ship_package, written

#: Rows of a node that one task finishes, megabytes of histograms in a task, trees that a task deals rows of.
NODE_ROWS = 32_000
HISTOGRAM_MB = 64
TREES_PER_DEAL = 10
#: Values of a feature that are counted one by one for its bounds.
MOST_VALUES = 10_000
#: Smallest gain of a split, as a share of the squares in its group: below it is rounding.
LEAST_GAIN = 1e-12
DRAWS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
NODES = "tree int, node int, feature binary, cut binary, left binary, value binary"
WITH_GAINS = f"{NODES}, gains array<double>"


def bounds_between(counts: list[tuple[float, float]], bins: int) -> list[float]:
    """At most ``bins`` - 1 bounds midway between neighbours of the given (value, count), as MLlib sets them: nearest to equal counts."""
    counts = sorted(counts)
    middle = [(a + b) / 2 for (a, _), (b, _) in zip(counts, counts[1:])]
    if len(counts) <= bins:
        return middle
    step = sum(c for _, c in counts) / bins
    out, below, target = [], counts[0][1], step
    for bound, (_, c) in zip(middle, counts[1:]):
        if abs(below - target) < abs(below + c - target):
            out.append(bound)
            target += step
        below += c
    return out


def bin_bounds(vectors: DataFrame, column: str, bins: int) -> list[list[float]]:
    """Bounds per feature from the counts of its values, of quantiles where there are more than MOST_VALUES. A value up to a bound lies left of it."""
    values = vectors.select(F.posexplode(vector_to_array(column)).alias("f", "x"))
    marks = [k / (16 * bins) for k in range(1, 16 * bins)]
    found = values.groupBy("f").agg(F.approx_count_distinct("x").alias("many"), F.percentile_approx("x", marks, 10_000).alias("q")).collect()
    counts = [list(Counter(r["q"]).items()) if r["many"] > MOST_VALUES else [] for r in sorted(found, key=lambda r: r["f"])]
    few = [f for f, own in enumerate(counts) if not own]
    for r in values.where(F.col("f").isin(few)).groupBy("f", "x").count().collect():
        counts[r["f"]].append((r["x"], r["count"]))
    return [bounds_between(own, bins) for own in counts]


def blocks_of(rows: DataFrame, column: str, bounds: list[list[float]], number: str, value: str) -> DataFrame:
    """(block, numbers, bins, total): the bins, the column ``number`` and the doubles ``value`` of some rows in one record."""
    kind = bin_type(bounds)

    def run(batches):
        for k, batch in enumerate(batches):
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, len(bounds))
                out = np.empty(x.shape, kind)
                for f, own in enumerate(bounds):
                    out[:, f] = np.searchsorted(np.asarray(own, float), x[:, f])
                parts = [batch.column(1).to_numpy().astype(np.int64), out, batch.column(2).to_numpy().astype(float)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(TaskContext.get().partitionId() << 24) + k], pa.int64()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]],
                    ["block", "numbers", "bins", "total"])

    table = rows.select(vector_to_array(column).alias("x"), F.col(number).cast("long").alias("n"), F.col(value).cast("double").alias("y"))
    return written(table.mapInArrow(run, "block long, numbers binary, bins binary, total binary"), "blocks")


def bin_type(bounds: list[list[float]]):
    return np.uint8 if max(map(len, bounds), default=0) < 256 else np.uint16


def drawn(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often the bootstrap sample of a tree has each row of a block."""
    return np.searchsorted(DRAWS, np.random.default_rng([seed & 0xFFFFFFFF, tree, block]).random(n), side="right").astype(np.uint8)


class Top:
    """The nodes of a tree that are split before rows are dealt. ``feature`` is -1 where a node has no split."""

    def __init__(self, feature=(-1,), cut=(0,), left=(0,), depth=(0,)):
        self.feature, self.cut, self.left, self.depth = map(list, (feature, cut, left, depth))

    def split(self, node: int, feature: int, cut: int) -> int:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for column, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.depth, self.depth[node] + 1)):
            column += [x, x]
        return self.left[node]


def route(x: np.ndarray, feature, cut, left) -> np.ndarray:
    """The leaf of each row of bins."""
    feature, cut, left = np.asarray(feature), np.asarray(cut), np.asarray(left)
    at = np.zeros(len(x), np.int64)
    on = np.flatnonzero(feature[at] >= 0)
    while len(on):
        node = at[on]
        at[on] = left[node] + (x[on, feature[node]] > cut[node])
        on = on[feature[at[on]] >= 0]
    return at


def dealt(blocks: DataFrame, trees: int, some: int) -> DataFrame:
    """Each block once for every ``some`` trees, ``first`` the first of them; spread over tasks by both."""
    spread = blocks.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(trees - 1), F.lit(some))))
    tasks = min(20_000, max(1, blocks.count() * -(-trees // some)))
    return spread.repartition(tasks, "first", "block").select("block", "first", "numbers", "bins", "total")


def split_large(blocks: DataFrame, bounds: list[list[float]], tops: list[Top], depth: int, min_leaf: int, seed: int, rows: int):
    """Split nodes of more than NODE_ROWS rows, level by level. Returns (leaves with their values, gains of each tree by feature)."""
    k, bins, kind = len(bounds), max(map(len, bounds), default=0) + 1, bin_type(bounds)
    wide, spark = k * bins, blocks.sparkSession
    gains, final = np.zeros((len(tops), k)), {}
    large = {(t, 0) for t in range(len(tops))} if rows > NODE_ROWS else set()
    while large:
        most = max(sum(t == tree for t, _ in large) for tree in {t for t, _ in large})
        some = max(1, (HISTOGRAM_MB << 20) // (most * wide * 24))
        sent = spark.sparkContext.broadcast(([(t.feature, t.cut, t.left) for t in tops], [sorted(n for u, n in large if u == t) for t in range(len(tops))]))

        def counted(batches, some=some, sent=sent):
            top, open_nodes = sent.value
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, first, bin_bytes, y_bytes in zip(*(batch.column(c).to_pylist() for c in ("block", "first", "bins", "total"))):
                    x, y = np.frombuffer(bin_bytes, kind).reshape(-1, k), np.frombuffer(y_bytes)
                    if sums and first // some != next(iter(sums)) // some:
                        yield from told(sums, open_nodes)
                        sums = {}
                    for t in range(first, min(first + some, len(top))):
                        if open_nodes[t]:
                            w, at = drawn(seed, t, block, len(x)), route(x, *top[t])
                            use = np.flatnonzero((w > 0) & np.isin(at, open_nodes[t]))
                            place = np.searchsorted(open_nodes[t], at[use])
                            cell = (place[:, None] * wide + np.arange(k) * bins + x[use]).ravel()
                            own = sums.setdefault(t, np.zeros((3, len(open_nodes[t]) * wide)))
                            for j, v in enumerate((np.ones(len(use)), w[use], w[use] * y[use])):
                                own[j] += np.bincount(cell, np.repeat(v, k), own.shape[1])
            yield from told(sums, open_nodes)

        def told(sums, open_nodes):
            for t, own in sums.items():
                nodes = open_nodes[t]
                parts = [np.ascontiguousarray(own[:, i * wide:(i + 1) * wide]).tobytes() for i in range(len(nodes))]
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(nodes), pa.int32()), pa.array(nodes, pa.int32()), pa.array(parts, pa.binary())], ["tree", "node", "sums"])

        def best(key, table):
            total = np.zeros(3 * wide)
            for s in table.column("sums").to_pylist():
                total += np.frombuffer(s)
            total = total.reshape(3, k, bins)
            whole = total[:, 0].sum(axis=1)
            below = np.cumsum(total, axis=2)
            above = whole[:, None, None] - below
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((below[1] >= min_leaf) & (above[1] >= min_leaf), below[2] ** 2 / below[1] + above[2] ** 2 / above[1] - whole[2] ** 2 / whole[1], -np.inf)
            f, c = divmod(int(np.argmax(gain)), bins)
            low, high = below[:, f, c], above[:, f, c]
            return pa.Table.from_pylist([{"tree": key[0].as_py(), "node": key[1].as_py(), "f": f, "c": c, "gain": float(gain[f, c]), "draws": float(whole[1]), "value": float(whole[2] / whole[1]), **{
                f"{n}_{what}": float(v) for n, side in (("low", low), ("high", high)) for what, v in (("rows", side[0]), ("value", side[2] / max(side[1], 1)))}}])

        found = dealt(blocks, len(tops), some).sortWithinPartitions("first").mapInArrow(counted, "tree int, node int, sums binary").groupBy("tree", "node").applyInArrow(
            best, "tree long, node long, f long, c long, gain double, draws double, value double, low_rows double, low_value double, high_rows double, high_value double").collect()
        large = set()
        for r in found:
            t, top = r["tree"], tops[r["tree"]]
            if r["gain"] <= LEAST_GAIN * r["value"] ** 2 * r["draws"]:
                final[t, r["node"]] = r["value"]
                continue
            left = top.split(r["node"], r["f"], r["c"])
            gains[t, r["f"]] += r["gain"]
            for node, side in ((left, "low"), (left + 1, "high")):
                if top.depth[node] >= depth:
                    final[t, node] = r[f"{side}_value"]
                elif r[f"{side}_rows"] > NODE_ROWS:
                    large.add((t, node))
        sent.unpersist()
    return final, gains


def subtree(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, min_leaf: int):
    """(feature, cut, left, value) of the nodes under the one that holds all given rows, and the gains of each feature.

    All nodes of a level at once: for each feature the rows stay ordered by (node, bin), so running sums give every split.
    """
    n, k = x.shape
    mean = np.average(y, weights=w)
    w, xt = w.astype(float), np.ascontiguousarray(x.T)
    wy = w * (y - mean)
    least = LEAST_GAIN * float((wy * (y - mean)).sum() + LEAST_GAIN * w.sum() * mean ** 2)
    order = np.ascontiguousarray(np.argsort(xt, axis=1, kind="stable"))
    feature, cut, left, value = [np.array([-1])], [np.array([0])], [np.array([0])], [np.array([wy.sum() / w.sum()])]
    gains, ids, sizes, many = np.zeros(k), np.array([0]), np.array([n]), 1
    for level in range(depth):
        n, seg, ends = order.shape[1], np.repeat(np.arange(len(ids)), sizes), np.cumsum(sizes)
        if not n:
            break
        starts, every = ends - sizes, np.arange(n)
        ow, oy, bins = w[order], wy[order], np.take_along_axis(xt, order, axis=1)
        lw, ly = np.cumsum(ow, axis=1), np.cumsum(oy, axis=1)
        lw -= (lw[:, starts] - ow[:, starts])[:, seg]
        ly -= (ly[:, starts] - oy[:, starts])[:, seg]
        tw, ty = lw[0, ends - 1], ly[0, ends - 1]
        rw, ry = tw[seg] - lw, ty[seg] - ly
        ok = (lw >= min_leaf) & (rw >= min_leaf)
        ok[:, :-1] &= bins[:, :-1] != bins[:, 1:]
        ok[:, ends - 1] = False
        score = np.full(ok.shape, -np.inf)
        score[ok] = ly[ok] ** 2 / lw[ok] + ry[ok] ** 2 / rw[ok]
        top = np.maximum.reduceat(score, starts, axis=1)
        f = top.argmax(axis=0)
        most = top[f, np.arange(len(ids))]
        gain = most - ty ** 2 / tw
        hit = np.flatnonzero(score[f[seg], every] == most[seg])
        place = hit[np.searchsorted(hit, starts)]
        split = np.flatnonzero(gain > least)
        c = bins[f, place].astype(np.int64)
        first = many + 2 * np.arange(len(split))
        feature[-1][ids[split] - (many - len(feature[-1]))], cut[-1][ids[split] - (many - len(cut[-1]))] = f[split], c[split]
        left[-1][ids[split] - (many - len(left[-1]))] = first
        np.add.at(gains, f[split], gain[split])
        # Two children for each split, in the order of their parents; those that may be split again go on.
        cw = np.stack([lw[f, place], tw - lw[f, place]], axis=1)[split].ravel()
        cy = np.stack([ly[f, place], ty - ly[f, place]], axis=1)[split].ravel()
        feature.append(np.full(len(cw), -1)), cut.append(np.zeros(len(cw), int)), left.append(np.zeros(len(cw), int)), value.append(cy / np.maximum(cw, 1))
        go_on = np.flatnonzero(cw >= 2 * min_leaf)
        number = np.full(2 * len(ids), -1)
        child = (2 * split[:, None] + np.arange(2)).ravel()
        number[child[go_on]] = np.arange(len(go_on))
        row_seg = np.zeros(len(w), np.int64)
        row_seg[order[0]] = seg
        goes_left = xt[f[row_seg], np.arange(len(w))] <= c[row_seg]
        row_child = number[2 * row_seg + ~goes_left]
        ids, sizes = many + go_on, np.bincount(row_child[order[0]] + 1, minlength=len(go_on) + 1)[1:]
        many += len(cw)
        # Stable: rows of a child keep their order by bin.
        lefts = goes_left[order]
        count = np.cumsum(lefts, axis=1)
        count -= (count[:, starts] - lefts[:, starts])[:, seg]
        inside = np.where(lefts, count - 1, (every - starts[seg]) - count)
        to, kept = row_child[order], int(sizes.sum())
        new = np.empty((k, kept + 1), order.dtype)
        np.put_along_axis(new, np.where(to >= 0, np.append(np.cumsum(sizes) - sizes, 0)[to] + inside, kept), order, axis=1)
        order = np.ascontiguousarray(new[:, :kept])
    return np.concatenate(feature), np.concatenate(cut), np.concatenate(left), np.concatenate(value) + mean, gains


def packed(feature, cut, left, value) -> list[bytes]:
    return [np.asarray(a).astype(t).tobytes() for a, t in ((feature, np.int32), (cut, np.int32), (left, np.int32), (value, np.float64))]


def grow_trees(vectors: DataFrame, column: str, target: str, trees: int, depth: int, min_leaf: int, bins: int, seed: int, path: str) -> list[float]:
    """Grow ``trees`` trees into the folder ``path``; returns the importance of each feature."""
    spark = vectors.sparkSession
    ship_package(spark)
    bounds = bin_bounds(vectors, column, bins)
    k, kind = len(bounds), bin_type(bounds)
    blocks = blocks_of(vectors.withColumn("__number", F.lit(0)), column, bounds, "__number", target)
    rows = vectors.count()
    tops = [Top() for _ in range(trees)]
    final, gains = split_large(blocks, bounds, tops, depth, min_leaf, seed, rows)
    sent = spark.sparkContext.broadcast([(t.feature, t.cut, t.left, t.depth) for t in tops])
    done = spark.sparkContext.broadcast(set(final))

    def deal(batches):
        for batch in batches:
            for block, first, bin_bytes, y_bytes in zip(*(batch.column(c).to_pylist() for c in ("block", "first", "bins", "total"))):
                x, y = np.frombuffer(bin_bytes, kind).reshape(-1, k), np.frombuffer(y_bytes)
                if not np.isfinite(y).all():
                    raise ValueError("a target is NaN or infinite")
                for t in range(first, min(first + TREES_PER_DEAL, len(sent.value))):
                    w = drawn(seed, t, block, len(x))
                    at = np.where(w > 0, route(x, *sent.value[t][:3]), -1)
                    for node in np.unique(at).tolist():
                        if node >= 0 and (t, node) not in done.value:
                            own = at == node
                            yield pa.RecordBatch.from_arrays([
                                pa.array([t], pa.int32()), pa.array([node], pa.int32()), pa.array([block], pa.int64()),
                                *[pa.array([a[own].tobytes()], pa.binary()) for a in (x, y, w)]], ["tree", "node", "block", "bins", "y", "w"])

    def finish(key, table):
        t, node = key[0].as_py(), key[1].as_py()
        table = table.sort_by("block")
        x, y, w = (np.frombuffer(b"".join(table.column(c).to_pylist()), d) for c, d in (("bins", kind), ("y", float), ("w", np.uint8)))
        *arrays, own = subtree(x.reshape(-1, k), y, w, depth - sent.value[t][3][node], min_leaf)
        return pa.table([pa.array([t], pa.int32()), pa.array([node], pa.int32()), *[pa.array([a], pa.binary()) for a in packed(*arrays)], pa.array([own.tolist()], pa.list_(pa.float64()))],
                        names=["tree", "node", "feature", "cut", "left", "value", "gains"])

    tasks = min(20_000, trees * max(1, 2 * rows // NODE_ROWS))
    small = dealt(blocks, trees, TREES_PER_DEAL).mapInArrow(deal, "tree int, node int, block long, bins binary, y binary, w binary")
    grown = small.repartition(tasks, "tree", "node").groupBy("tree", "node").applyInArrow(finish, WITH_GAINS)
    grown.write.parquet(f"{path}/nodes")
    leaves = [(t, node, *map(bytearray, packed([-1], [0], [0], [v]))) for (t, node), v in final.items()]
    if leaves:
        spark.createDataFrame(leaves, NODES).write.mode("append").parquet(f"{path}/nodes")
    spark.createDataFrame([(t, top.feature, top.cut, top.left) for t, top in enumerate(tops)], "tree int, feature array<int>, cut array<int>, left array<int>").write.parquet(f"{path}/tops")
    spark.createDataFrame(list(enumerate(bounds)), "f int, bounds array<double>").write.parquet(f"{path}/bounds")
    for r in spark.read.schema(WITH_GAINS).parquet(f"{path}/nodes").select("tree", F.posexplode("gains").alias("f", "gain")).groupBy("tree", "f").agg(F.sum("gain").alias("gain")).collect():
        gains[r["tree"], r["f"]] += r["gain"]
    # Trees weigh alike; one without a split has no weight.
    sums = gains.sum(axis=1, keepdims=True)
    shares = (gains / np.where(sums > 0, sums, 1)).sum(axis=0)
    return (shares / (shares.sum() or 1)).tolist()


def add_votes(spark: SparkSession, rows: DataFrame, column: str, number: str, path: str) -> DataFrame:
    """(number, mean): the mean of all trees for each row. Blocks of rows meet the nodes that they are dealt to, NODE_ROWS rows or so in a group."""
    ship_package(spark)
    bounds = [r["bounds"] for r in spark.read.parquet(f"{path}/bounds").orderBy("f").collect()]
    tops = [(r["feature"], r["cut"], r["left"]) for r in spark.read.parquet(f"{path}/tops").orderBy("tree").collect()]
    nodes = spark.read.schema(NODES).parquet(f"{path}/nodes")
    k, kind, trees = len(bounds), bin_type(bounds), len(tops)
    sent = spark.sparkContext.broadcast(tops)
    blocks = blocks_of(rows.withColumn("__zero", F.lit(0.0)), column, bounds, number, "__zero")
    parts = max(1, -(-rows.count() // NODE_ROWS))

    def deal(batches):
        for batch in batches:
            for block, first, bin_bytes in zip(*(batch.column(c).to_pylist() for c in ("block", "first", "bins"))):
                x = np.frombuffer(bin_bytes, kind).reshape(-1, k)
                for t in range(first, min(first + TREES_PER_DEAL, trees)):
                    at = route(x, *sent.value[t])
                    for node in np.unique(at).tolist():
                        own = np.flatnonzero(at == node)
                        yield pa.RecordBatch.from_arrays([
                            pa.array([t], pa.int32()), pa.array([node], pa.int32()), pa.array([((block >> 24) + (block & 0xFFFFFF)) % parts], pa.int32()), pa.array([block], pa.int64()),
                            *[pa.array([a.tobytes()], pa.binary()) for a in (own.astype(np.int32), x[own])]], ["tree", "node", "part", "block", "places", "bins"])

    def vote(key, some, own):
        feature, cut, left = (np.frombuffer(own.column(c)[0].as_py(), np.int32) for c in ("feature", "cut", "left"))
        value = np.frombuffer(own.column("value")[0].as_py())
        votes = [value[route(np.frombuffer(b, kind).reshape(-1, k), feature, cut, left)].tobytes() for b in some.column("bins").to_pylist()]
        return pa.table([some.column("tree"), some.column("block"), some.column("places"), pa.array(votes, pa.binary())], names=["tree", "block", "places", "votes"])

    def mean(key, numbers, votes):
        numbers = np.frombuffer(numbers.column("numbers")[0].as_py(), np.int64)
        total, votes = np.zeros(len(numbers)), votes.sort_by("tree")  # one order of sums
        for places, v in zip(votes.column("places").to_pylist(), votes.column("votes").to_pylist()):
            total[np.frombuffer(places, np.int32)] += np.frombuffer(v)
        return pa.table([pa.array(numbers), pa.array(total / trees)], names=["number", "mean"])

    met = dealt(blocks, trees, TREES_PER_DEAL).mapInArrow(deal, "tree int, node int, part int, block long, places binary, bins binary")
    whole = nodes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = ["tree", "node", "part"]
    votes = met.groupBy(*keys).cogroup(whole.groupBy(*keys)).applyInArrow(vote, "tree int, block long, places binary, votes binary")
    means = blocks.select("block", "numbers").groupBy("block").cogroup(votes.groupBy("block")).applyInArrow(mean, "number long, mean double")
    return written(means, "votes")
