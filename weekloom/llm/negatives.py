"""Hard-negative mining by dual-tree search over anchors and candidates, exactly.

A tree of balls over all candidates is fitted on a bounded sample: cuts halve the sample; every row is sent down to a
cell, and the balls' radii are taken over all rows. Anchors have a tree of their own, and come in groups of its leaves. For a group's ball and a node's
ball all inner products lie in an interval; a node outside of what the group's anchors can use is left out with all that is below it, and
for all anchors of the group at once. What is left are pairs of anchors and cells. In a cell's task the search goes on
between the groups and small leaves, which are cut by label first; only leaf pairs are scored, exactly. Once an anchor
has as many rows as it can use, the last one's score takes further leaves away.

Anchors look for positives first, with the fifth best row of the sample as their first bound, then for negatives
between the bounds that the positives set. Cells of more than PART rows are dealt in parts, so that equal vectors
in any number don't come together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm import vectors
from weekloom.llm.common import written

SCALE, TOP, EVERY = 256, 5, 100
#: Rows on which the candidates' and the anchors' trees are fitted.
SAMPLE = 4096
#: Rows that a cell has on average, cells at most, rows of a cell that come to one task, and rows of a leaf there.
CELL, CELLS, PART, LEAF = 16_384, 1024, 65_536, 512
#: Anchors that are met at once.
GROUP = 256
#: Squares' sum up to which inner products fit in a long.
MOST = float(1 << 62)
#: Hits after which a group keeps only its best.
HELD = 300_000


class Tree:
    """Cuts by hyperplanes between two far rows of a sample; a node's ball holds all rows that were sent to cells below it."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.centre, self.normal, self.cut, self.children, self.cell = [], [], [], [], []
        sample = sample.astype(np.float64)
        parts, nodes = [self._node(sample)], [sample]
        cells = []
        while parts and len(parts) + len(cells) < leaves:
            i = max(range(len(parts)), key=lambda k: len(nodes[k]))
            node, rows = parts.pop(i), nodes.pop(i)
            far = rows[np.argmax(((rows - rows.mean(0)) ** 2).sum(1))]
            normal = rows[np.argmax(((rows - far) ** 2).sum(1))] - far
            along = rows @ normal
            cut = float(np.median(along))
            right = along > cut
            if not right.any():
                cells.append(node)
                continue
            self.normal[node], self.cut[node] = normal, cut
            self.children[node] = (self._node(rows[~right]), self._node(rows[right]))
            parts += self.children[node]
            nodes += [rows[~right], rows[right]]
        self.leaves = sorted(cells + parts)
        for k, node in enumerate(self.leaves):
            self.cell[node] = k
        self.radius = np.zeros(len(self.centre))

    def _node(self, rows: np.ndarray) -> int:
        self.centre.append(rows.mean(0))
        for x, value in ((self.normal, None), (self.cut, None), (self.children, None), (self.cell, -1)):
            x.append(value)
        return len(self.centre) - 1

    def sent(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.children[node] is None:
                out[rows] = self.cell[node]
                continue
            right = x[rows] @ self.normal[node] > self.cut[node]
            todo += [(self.children[node][0], rows[~right]), (self.children[node][1], rows[right])]
        return out

    def spread(self, radius: dict[int, float]) -> None:
        """Sets radii from those of the cells; a cell without rows has none."""
        self.radius = np.full(len(self.centre), -1.0)
        for node in reversed(range(len(self.centre))):  # children have larger numbers
            if self.children[node] is None:
                self.radius[node] = radius.get(self.cell[node], -1.0)
            else:
                self.radius[node] = max((np.linalg.norm(self.centre[node] - self.centre[c]) + self.radius[c] for c in self.children[node] if self.radius[c] >= 0), default=-1.0)


def interval(a: np.ndarray, ra: float | np.ndarray, c: np.ndarray, rc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of inner products between rows of balls around a (one, or rows) and around the rows of c, with room for rounding."""
    na, nc = np.linalg.norm(a, axis=-1), np.linalg.norm(c, axis=-1)
    if a.ndim == 2:
        na, ra = na[:, None], np.asarray(ra)[..., None]
    middle = a @ c.T
    slack = ra * nc + rc * na + ra * rc + 1e-9 * (na + ra) * (nc + rc) + 1e-6
    return middle - slack, middle + slack


def scores(a: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole numbers; exact: doubles hold them."""
    return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if exact else a @ x.T


def best(group: np.ndarray, score: np.ndarray, number: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group: higher scores first, then smaller numbers."""
    order = np.lexsort((number, -score, group))
    ordered = group[order]
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


_LOW = -(1 << 63)


class Block:
    """Candidates of a cell's part, cut into leaves: by label first, then by the widest component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int, exact: bool):
        order, edges, todo = [], [0], []
        by = np.argsort(labels, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(labels[by])) + 1, len(by))
        todo, small = [], []
        for a, b in zip([0, *ends[:-1]], ends, strict=True):  # labels with few rows share leaves
            if b - a >= leaf // 4:
                todo.append(by[a:b])
            else:
                small.append(by[a:b])
        if small:
            rows = np.concatenate(small)
            todo += [rows[a : a + leaf] for a in range(0, len(rows), leaf)]
        while todo:
            rows = todo.pop()
            if len(rows) > leaf:
                width = x[rows].max(0) - x[rows].min(0)
                rows = rows[np.argsort(x[rows, int(np.argmax(width))], kind="stable")]
                todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
                continue
            order.append(rows)
            edges.append(edges[-1] + len(rows))
        order = np.concatenate(order)
        self.ids, self.labels, self.x, self.edges, self.exact = ids[order], labels[order], x[order], edges, exact
        self.centre = np.array([self.x[a:b].mean(0) for a, b in zip(edges, edges[1:], strict=False)])
        self.radius = np.array([np.sqrt(((self.x[a:b] - c) ** 2.0).sum(1).max()) for a, b, c in zip(edges, edges[1:], self.centre, strict=False)])
        self.low, self.high = np.minimum.reduceat(self.labels, edges[:-1]), np.maximum.reduceat(self.labels, edges[:-1])

    def search(self, a: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, candidate id, score): the first top rows for each slot (anchor, j) with low <= score <= high, and the anchor's label if same, else another one."""
        slots = low.shape[1]
        floor = low.copy()
        centre = a.mean(0)
        ra = float(np.sqrt(((a - centre) ** 2.0).sum(1).max()))
        least, most = interval(centre, ra, self.centre, self.radius)
        found = [np.empty((3, 0), np.int64)]
        held = 0
        for leaf in np.argsort(-most, kind="stable").tolist():
            # the group's interval first, then each anchor's own
            if most[leaf] < floor.min() or least[leaf] > high.max():
                continue
            lo, hi = interval(a, 0.0, self.centre[leaf : leaf + 1], self.radius[leaf : leaf + 1])
            on = (hi[:, 0] >= floor.min(1)) & (lo[:, 0] <= high.max(1))
            on &= (labels >= self.low[leaf]) & (labels <= self.high[leaf]) if same else (labels != self.low[leaf]) | (labels != self.high[leaf])
            who = np.flatnonzero(on)
            if not len(who):
                continue
            rows = slice(self.edges[leaf], self.edges[leaf + 1])
            s = scores(a[who], self.x[rows], self.exact)
            right = (self.labels[rows][None, :] == labels[who][:, None]) == same
            if same:
                right &= self.ids[rows][None, :] != ids[who][:, None]
            for j in range(slots):
                i, c = np.nonzero(right & (s >= floor[who, j][:, None]) & (s <= high[who, j][:, None]))
                if len(i):
                    found.append(np.stack([who[i] * slots + j, self.ids[rows][c], s[i, c]]))
                    held += len(i)
            if held > HELD or leaf % 4 == 0:  # now and then, as a sort costs more than a few leaves
                every = np.concatenate(found, 1)
                every = every[:, best(every[0], every[2], every[1], top)]
                found, held = [every], every.shape[1]
                slot, n = np.unique(every[0], return_counts=True)
                last = np.cumsum(n)[n == top] - 1  # rows are in order, so that this is the slot's last one
                np.maximum.at(floor.reshape(-1), slot[n == top], every[2][last])
        every = np.concatenate(found, 1)
        every = every[:, best(every[0], every[2], every[1], top)]
        return every[0], every[1], every[2]


def _cell_batches(tree: Tree, width: int, dims: int):
    """(vec_id, label, v, cell, away): v packed, away the distance to the cell's centre."""
    centres = np.array([tree.centre[n] for n in tree.leaves])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.matrix(batch.column("v"), dims)
            cell = tree.sent(x)
            away = np.sqrt(((x - centres[cell]) ** 2.0).sum(1)) * (1 + 1e-9) + 1e-6
            data, step = x.astype(f"<i{width}").tobytes(), width * dims
            rows = [data[i * step : (i + 1) * step] for i in range(len(x))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(rows, pa.binary()), pa.array(cell.astype(np.int32)), pa.array(away)], ["vec_id", "label", "v", "cell", "away"])

    return run


def _matrix(column, width: int, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), f"<i{width}").astype(np.int64).reshape(-1, dims)


def _bounds(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Positives' scores as upper bounds and ceil(4/5 of them) as lower ones; for slots that aren't there no score fits."""
    lists = batch.column("positive_scores").to_pylist()
    high = np.full((len(lists), max(map(len, lists))), _LOW, np.int64)
    low = np.full(high.shape, -(_LOW + 1), np.int64)
    for i, x in enumerate(lists):
        high[i, : len(x)] = x
        low[i, : len(x)] = [p - p // 5 for p in x]
    return low, high


def _visit_batches(tree: Tree, parts: dict[int, int], sample: tuple | None, width: int, dims: int, exact: bool, top: int):
    """The anchors again with each part of each cell that they must meet. sample: rows that give the first bound of positives; without it, bounds are those of negatives."""
    centres, radii = np.array(tree.centre), tree.radius

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                some = batch.slice(at, GROUP)
                a = _matrix(some.column("v"), width, dims)
                ids, labels = some.column("vec_id").to_numpy(), some.column("label").to_numpy()
                low, high = np.full(len(a), float("-inf")), np.full(len(a), float("inf"))
                if sample is not None:
                    s = np.where((sample[1][None, :] == labels[:, None]) & (sample[0][None, :] != ids[:, None]), scores(a, sample[2], exact), _LOW)
                    if s.shape[1] >= top:
                        fifth = np.sort(s, axis=1)[:, -top]
                        low[fifth > _LOW] = fifth[fifth > _LOW]
                else:
                    lows, highs = _bounds(some)
                    low, high = lows.min(1).astype(float), highs.max(1).astype(float)
                centre = a.mean(0)
                ra = float(np.sqrt(((a - centre) ** 2.0).sum(1).max()))
                todo, taken = [0], []
                while todo:
                    node = todo.pop()
                    if radii[node] < 0:
                        continue
                    least, most = (x[0] for x in interval(centre, ra, centres[node : node + 1], radii[node : node + 1]))
                    if most < low.min() or least > high.max():
                        continue
                    if tree.children[node] is not None:
                        todo += tree.children[node]
                        continue
                    lo, hi = interval(a, 0.0, centres[node : node + 1], radii[node : node + 1])
                    who = np.flatnonzero((hi[:, 0] >= low) & (lo[:, 0] <= high))
                    if len(who):
                        taken.append((tree.cell[node], who))
                for cell, who in taken:
                    for part in range(parts[cell]):
                        rows = some.take(pa.array(who))
                        n = len(who)
                        bound = np.where(np.isfinite(low[who]), low[who], float(_LOW)).clip(float(_LOW), 2.0**62).astype(np.int64) if sample is not None else np.full(n, _LOW)
                        # a bound kept as a double may be a little too high
                        bound = np.where(bound > _LOW, bound - np.abs(bound >> 50) - 1, bound)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, cell, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(np.ones(n, bool)), rows.column("vec_id"), rows.column("label"), rows.column("v"), pa.array(bound), rows.column("positives"), rows.column("positive_scores")],
                            ["cell", "part", "anchor", "vec_id", "label", "v", "bound", "positives", "positive_scores"],
                        )

    return run


_VISIT = "cell int, part int, anchor boolean, vec_id long, label long, v binary, bound long, positives array<long>, positive_scores array<long>"
_HITS = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _score_batches(same: bool, width: int, dims: int, exact: bool, top: int, leaf: int):
    """Rows come with each part's candidates before its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            key = batch.column("cell").to_numpy().astype(np.int64) << 33 | batch.column("part").to_numpy().astype(np.int64) << 1 | batch.column("anchor").to_numpy(zero_copy_only=False)
            edges = [*np.flatnonzero(np.diff(key, prepend=-1)).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                some = batch.slice(a, b - a)
                if key[a] >> 1 != now:
                    now, held, block = key[a] >> 1, [], None
                if not key[a] & 1:
                    held.append((some.column("vec_id").to_numpy(), some.column("label").to_numpy(), _matrix(some.column("v"), width, dims)))
                    continue
                if block is None and held:
                    block, held = Block(*(np.concatenate(x) for x in zip(*held, strict=True)), leaf, exact), []
                for at in range(0, some.num_rows if block else 0, GROUP):
                    group = some.slice(at, GROUP)
                    ids, labels = group.column("vec_id").to_numpy(), group.column("label").to_numpy()
                    low, high = _bounds(group) if not same else (group.column("bound").to_numpy()[:, None].copy(), np.full((group.num_rows, 1), -(_LOW + 1)))
                    slot, other, score = block.search(_matrix(group.column("v"), width, dims), ids, labels, low, high, same, top)
                    i, j = slot // low.shape[1], slot % low.shape[1]
                    if same:
                        none = pa.nulls(len(slot), pa.int64())
                        columns = [pa.array(ids[i]), pa.array(other), pa.array(score), none, none]
                    else:
                        positives = group.column("positives").to_pylist()
                        columns = [pa.array(ids[i]), pa.array([positives[x][y] for x, y in zip(i.tolist(), j.tolist(), strict=True)], pa.int64()), pa.array(high[i, j]), pa.array(other), pa.array(score)]
                    yield pa.RecordBatch.from_arrays(columns, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def mined(embeddings: DataFrame, every: int = EVERY, top: int = TOP, scale: int = SCALE, sample: int = SAMPLE, cell: int = CELL, part: int = PART, leaf: int = LEAF) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the first top negatives of each anchor's first top positives.

    Anchors are the rows whose vec_id is divisible by every. Components count as floor(scale * x); a score is the inner
    product, higher ones come first, equal ones by the smaller vec_id. Positives are other rows of the anchor's label;
    negatives are rows of another label with 80 * positive_score <= 100 * negative_score <= 100 * positive_score.

    Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part, nor do vectors whose
    squares add up to more than MOST, as no long holds their scores. What a shorter vector lacks is 0. Of several rows of
    one vec_id, the one with the smallest label, then vector, counts. An empty table, or one without anchors, gives no
    rows. Only vec_id, label and embedding are read, whatever other columns there are. All rows are searched; the sample only places cuts.
    """
    rows = vectors.kept(embeddings.where("vec_id is not null and label is not null").select("vec_id", "label", "embedding"), scale, MOST)
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")
    rows = written(rows, "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    n, dims, most, largest, anchors = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square), F.max(F.array_max(F.transform("v", F.abs))), F.count_if(F.col("vec_id") % every == 0)).first()
    if not anchors:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dims, exact, width = max(1, dims), most < float(1 << 52), 2 if (largest or 0) < 1 << 15 else 4 if (largest or 0) < 1 << 31 else 8

    def taken(df: DataFrame, total: int) -> list:
        """A bounded sample: by a hash, at most about sample rows."""
        return df.where(F.pmod(F.xxhash64("vec_id"), F.lit(-(-total // sample))) == 0).orderBy("vec_id").limit(2 * sample).collect()

    def fitted(some: list, leaves: int) -> Tree:
        x = np.zeros((max(1, len(some)), dims))
        for i, r in enumerate(some):
            x[i, : len(r["v"])] = r["v"]
        return Tree(x, leaves)

    is_anchor = F.col("vec_id") % every == 0
    some = taken(rows, n)
    tree, anchor_tree = fitted(some, min(CELLS, -(-n // cell))), fitted(taken(rows.where(is_anchor), anchors), min(CELLS, -(-anchors // GROUP)))
    held = written(rows.mapInArrow(_cell_batches(tree, width, dims), "vec_id long, label long, v binary, cell int, away double"), "cells")
    of_cell = held.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()  # CELLS rows at most
    tree.spread({r["cell"]: r["radius"] for r in of_cell})
    parts = {r["cell"]: -(-r["n"] // part) for r in of_cell}
    many = F.broadcast(rows.sparkSession.createDataFrame(list(parts.items()), "cell int, parts int"))
    none = F.lit(None).cast("array<long>")
    candidates = held.join(many, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("anchor"), "vec_id", "label", "v", F.lit(0).cast("long").alias("bound"), none.alias("positives"), none.alias("positive_scores"))
    groups = rows.where(is_anchor).mapInArrow(_cell_batches(anchor_tree, width, dims), "vec_id long, label long, v binary, cell int, away double")
    groups = written(groups.select(F.col("cell").alias("leaf"), "vec_id", "label", "v"), "anchors")
    tasks = max(8, min(4096, -(-anchors // (4 * GROUP))), 2 * len(parts))

    def searched(df: DataFrame, same: bool, first: tuple | None) -> DataFrame:
        # a leaf's anchors stay together, equal ones in any number are dealt out
        by = df.repartition(tasks, "leaf", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, anchors // 65_536)))).sortWithinPartitions("leaf")
        visits = by.mapInArrow(_visit_batches(tree, parts, first, width, dims, exact, top), _VISIT)
        both = candidates.unionByName(visits).repartition(max(8, 2 * sum(parts.values())), "cell", "part").sortWithinPartitions("cell", "part", "anchor")
        return both.mapInArrow(_score_batches(same, width, dims, exact, top, leaf), _HITS)

    x = np.zeros((len(some), dims), np.int64)
    for i, r in enumerate(some):
        x[i, : len(r["v"])] = r["v"]
    first = (np.array([r["vec_id"] for r in some], np.int64), np.array([r["label"] for r in some], np.int64), x)
    own = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = searched(groups.withColumns({"positives": none, "positive_scores": none}), True, first)
    found = found.select("anchor_id", "positive_id", "positive_score", F.row_number().over(own).alias("k")).where(F.col("k") <= top)
    lists = F.sort_array(F.collect_list(F.struct("k", "positive_id", "positive_score")))
    found = written(found.groupBy("anchor_id").agg(lists.alias("l")).select(F.col("anchor_id").alias("vec_id"), F.col("l.positive_id").alias("positives"), F.col("l.positive_score").alias("positive_scores")), "positives")
    negatives = searched(groups.join(found, "vec_id").select(*groups.columns, "positives", "positive_scores"), False, None)
    pair = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return negatives.withColumn("rank", F.row_number().over(pair)).where(F.col("rank") <= top).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


report = mined
