"""Softmax gradient boosting over binned features, with missing values on a learned side.

Features are cut into bins at their exact quantiles once; bin 0 holds missing values.
Every level of a round's trees (one per class) costs one pass over the bins: tasks add
up gradients and curvatures per (tree, node, feature, bin), a shuffle sums them, and
the best split of each node is chosen from these sums, whose number does not depend on
the rows. Of two sister nodes the smaller is counted, the other is the rest of their
parent; the last level's totals are known from the splits above it. A split also says
on which side missing values go. Sums are kept in fixed point, so they and the trees do
not depend on the order or the number of tasks. Binned rows are stored in blocks, a
feature's bins side by side.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.session import cut

_ONE = 1 << 28  # fixed point of gradients and curvatures
_BLOCK = 1 << 15  # binned rows stored as one
_SORTED = 1 << 17  # rows whose values are sorted at a time
_MARKS = 2048  # kept of each feature's sorted values


@dataclass(frozen=True)
class BoostConfig:
    """rounds: trees per class. step: learning rate. depth: levels of a tree. bins: per feature, missing aside.

    least_rows: rows a leaf must hold. penalty: added to the curvature of a leaf.
    keep_every: rounds after which the scores of the rows are written down.
    """

    rounds: int = 20
    step: float = 0.1
    depth: int = 5
    bins: int = 64
    least_rows: int = 20
    penalty: float = 0.0
    keep_every: int = 8


@dataclass
class Tree:
    """Complete tree in arrays; node k has the children 2k + 1 and 2k + 2, a leaf's feature is -1."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Node in which each row of ``bins`` (rows x features) ends."""
        node = np.zeros(len(bins), np.int64)
        todo = [(0, np.arange(len(bins)))]
        while todo:
            k, rows = todo.pop()
            if self.feature[k] < 0 or not rows.size:
                node[rows] = k
                continue
            b = bins[:, self.feature[k]].take(rows)
            left = b <= self.bin[k] if self.missing_left[k] else (b <= self.bin[k]) & (b != 0)
            todo += [(2 * k + 1, rows[left]), (2 * k + 2, rows[~left])]
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(bins)]


@dataclass
class BoostedModel:
    """names: features. edges: per feature the upper ends of its bins but the last. classes: label values.

    base: scores before the first round. trees: one list per round, a tree per class.
    """

    names: list[str]
    edges: list[list[float]]
    classes: list[float]
    base: list[float]
    trees: list[list[Tree]] = field(default_factory=list)

    def binned(self, values: np.ndarray) -> np.ndarray:
        """Bin of every value (rows x features); 0 where it is missing."""
        out = np.zeros(values.shape, np.uint8)
        for j, edges in enumerate(self.edges):
            there = ~np.isnan(values[:, j])
            out[there, j] = 1 + np.searchsorted(edges, values[there, j], side="left")
        return out

    def scores(self, bins: np.ndarray, start: np.ndarray | None = None, from_round: int = 0) -> np.ndarray:
        out = np.tile(np.array(self.base), (len(bins), 1)) if start is None else start.copy()
        for trees in self.trees[from_round:]:
            for k, tree in enumerate(trees):
                out[:, k] += tree.predict(bins)
        return out

    def to_json(self) -> str:
        plain = {"names": self.names, "edges": self.edges, "classes": self.classes, "base": self.base}
        return json.dumps(plain | {"trees": [[{k: v.tolist() for k, v in asdict(t).items()} for t in ts] for ts in self.trees]})

    @staticmethod
    def from_json(text: str) -> BoostedModel:
        d = json.loads(text)
        kinds = {"feature": np.int64, "bin": np.int64, "missing_left": bool, "value": float}
        trees = [[Tree(**{k: np.array(t[k], kind) for k, kind in kinds.items()}) for t in ts] for ts in d.pop("trees")]
        return BoostedModel(**d, trees=trees)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches as tables of about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _sorted_values(table: pa.Table, names: Sequence[str]) -> Iterator[tuple[int, np.ndarray]]:
    for j, name in enumerate(names):
        x = table.column(name).cast(pa.float64()).to_numpy()
        yield j, np.sort(x[~np.isnan(x)] + 0.0)  # no negative zeros


def _distinct(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with the sums of their counts."""
    order = np.argsort(v, kind="stable")
    v, c = v[order], c[order]
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
    return v[first], np.add.reduceat(c, first) if len(v) else c


def _parts(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _places(n: int, bins: int) -> list[float]:
    """Positions of the inner quantiles among n sorted values; between two of them a quantile is interpolated."""
    return [(n - 1) * (i / bins) for i in range(1, bins)]


def bin_edges(rows: DataFrame, names: Sequence[str], bins: int, block_rows: int = _SORTED, marks: int = _MARKS) -> list[list[float]]:
    """Distinct inner quantiles of each feature: exact, from two passes that shuffle a small share of the values.

    The first pass sorts blocks of rows and keeps evenly spaced marks of each feature's values; their
    counts bound every wanted value from both sides. The second counts the values up to the lower
    bounds and brings together those between the bounds, in which the wanted places are then found.
    """
    names = list(names)
    values = rows.select(*[F.col(n).cast("double").alias(n) for n in names])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, block_rows):
            out = []
            for j, x in _sorted_values(table, names):
                step = -(-len(x) // marks)
                at = np.append(np.arange(step - 1, len(x) - 1, step), len(x) - 1) if step else np.zeros(0, np.int64)
                out.append((j, x[at].tobytes(), np.diff(np.append(-1, at)).tobytes(), max(0, step - 1)))
            yield pa.RecordBatch.from_pylist([dict(zip(("j", "v", "c", "slack"), r)) for r in out], schema=pa.schema([("j", pa.int32()), ("v", pa.binary()), ("c", pa.binary()), ("slack", pa.int64())]))

    def bound(group: pa.Table) -> pa.Table:
        """Of each wanted place a value that lies below it (NaN: none is known) and one that doesn't."""
        v, c = _distinct(_parts(group.column("v"), np.float64), _parts(group.column("c"), np.int64))
        upto, slack = np.cumsum(c), sum(group.column("slack").to_pylist())
        n = int(upto[-1]) if len(upto) else 0
        wanted = np.unique([f(p) for p in _places(n, bins) for f in (np.floor, np.ceil)]).astype(np.int64) if n else np.zeros(0, np.int64)
        high = v[np.searchsorted(upto, wanted + 1)] if n else v
        below = np.searchsorted(upto, wanted + 1 - slack) - 1
        low = np.where(below >= 0, v[np.maximum(below, 0)], np.nan) if n else v
        return pa.table({"j": group.column("j").slice(0, 1), "n": pa.array([n], pa.int64()), "low": pa.array([low.tobytes()], pa.binary()), "high": pa.array([high.tobytes()], pa.binary()), "wanted": pa.array([wanted.tobytes()], pa.binary())})

    found = values.mapInArrow(mark, "j int, v binary, c binary, slack long").groupBy("j").applyInArrow(bound, "j int, n long, low binary, high binary, wanted binary").collect()  # one row per feature
    size, spans = {}, []  # spans: (feature, lower bound, upper bound, places)
    for r in sorted(found, key=lambda r: r["j"]):
        size[r["j"]] = r["n"]
        for low, high, k in zip(np.frombuffer(r["low"]), np.frombuffer(r["high"]), np.frombuffer(r["wanted"], np.int64)):
            if spans and spans[-1][0] == r["j"] and not low >= spans[-1][2]:
                spans[-1] = (r["j"], spans[-1][1], max(high, spans[-1][2]), [*spans[-1][3], int(k)])
            else:
                spans.append((r["j"], low, high, [int(k)]))

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, block_rows):
            sorted_ = dict(_sorted_values(table, names))
            out = []
            for g, (j, low, high, _) in enumerate(spans):
                x = sorted_[j]
                i = 0 if np.isnan(low) else int(np.searchsorted(x, low, side="right"))
                v, c = _distinct(x[i : np.searchsorted(x, high, side="right")], np.ones(max(0, int(np.searchsorted(x, high, side="right")) - i), np.int64))
                out.append({"part": g // 8, "g": g, "below": i, "v": v.tobytes(), "c": c.tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("part", pa.int32()), ("g", pa.int32()), ("below", pa.int64()), ("v", pa.binary()), ("c", pa.binary())]))

    def pick(group: pa.Table) -> pa.Table:
        out = []
        numbers = group.column("g").to_numpy()
        for g in np.unique(numbers).tolist():
            own = group.filter(pa.array(numbers == g))
            v, c = _distinct(_parts(own.column("v"), np.float64), _parts(own.column("c"), np.int64))
            upto = sum(own.column("below").to_pylist()) + np.cumsum(c)
            out += [{"j": spans[g][0], "place": k, "v": float(v[np.searchsorted(upto, k, side="right")])} for k in spans[g][3]]
        return pa.Table.from_pylist(out, schema=pa.schema([("j", pa.int32()), ("place", pa.int64()), ("v", pa.float64())]))

    if not spans:
        return [[] for _ in names]
    at = {(r["j"], r["place"]): r["v"] for r in values.mapInArrow(between, "part int, g int, below long, v binary, c binary").groupBy("part").applyInArrow(pick, "j int, place long, v double").collect()}  # two per feature and quantile
    edges: list[list[float]] = []
    for j in range(len(names)):
        cuts = set()
        for p in _places(size.get(j, 0), bins) if size.get(j) else []:
            low, high = at[j, int(np.floor(p))], at[j, int(np.ceil(p))]
            cuts.add(low + (high - low) * (p - np.floor(p)))
        edges.append(sorted(map(float, cuts)))
    return edges


def _matrix(batch: pa.RecordBatch | pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(n).cast(pa.float64()).to_pandas().to_numpy() for n in names]) if names else np.zeros((batch.num_rows, 0))


def best_splits(sums: np.ndarray, cfg: BoostConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, bin, missing left) per node from ``sums[node, feature, bin, (g, h, n)]``; feature -1: no split.

    Ties go to the smallest feature, then bin, then missing values on the left.
    """
    whole = sums.sum(axis=2)[:, :, None, :]  # the same for every feature
    seen = np.cumsum(sums[:, :, 1:, :], axis=2)[:, :, :-1, :]  # bins up to each cut, without missing
    missing = sums[:, :, :1, :]
    best = None
    for side in (True, False):
        left = seen + missing if side else seen
        right = whole - left
        worth = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + cfg.penalty, 1e-12)
        gain = worth(left) + worth(right) - worth(whole)
        gain = np.where((left[..., 2] >= cfg.least_rows) & (right[..., 2] >= cfg.least_rows), gain, -np.inf)
        best = gain if best is None else np.stack([best, gain], axis=-1)
    flat = best.reshape(len(sums), -1)
    at = flat.argmax(axis=1)
    gain = flat[np.arange(len(flat)), at]
    side = at % 2
    cuts = max(1, sums.shape[2] - 2)
    feature, cut_bin = at // 2 // cuts, at // 2 % cuts + 1
    good = np.isfinite(gain) & (gain > 1e-9)
    return gain, np.where(good, feature, -1), cut_bin, side == 0


def _exact_sums(at: np.ndarray, values: np.ndarray, size: int, least: int) -> np.ndarray:
    """Sums of whole numbers per place, in pieces whose sums a double holds exactly; ``least``: rows of a piece."""
    out = np.zeros(size, np.int64)
    for i in range(0, len(at), least):
        out += np.bincount(at[i : i + least], values[i : i + least], size).astype(np.int64)
    return out


def _piece(values: np.ndarray) -> int:
    top = float(np.abs(values).max(initial=1.0))
    return max(1, int(2.0**52 / top))


def _side_sums(node: np.ndarray, feature: int, at: int, missing_left: bool) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) totals of a split from ``node[feature, bin, (g, h, n)]``."""
    left = node[feature, 1 : at + 1].sum(axis=0) + (node[feature, 0] if missing_left else 0)
    return left, node[feature].sum(axis=0) - left


def fit_boosted_classes(rows: DataFrame, names: Sequence[str], label: str = "label", weight: str | None = None, cfg: BoostConfig = BoostConfig()) -> BoostedModel:
    """Fit on the rows with a label; every distinct label is a class (a handful).

    Null and NaN features are missing; rows without a label or with a null weight don't
    count. Rows may be in any order and any number of partitions.
    """
    names = list(names)
    w = F.lit(1.0) if weight is None else F.col(weight)
    used = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("_y"), w.cast("double").alias("_w"), *names).where("_w is not null")
    share = {r["_y"]: r["w"] for r in used.groupBy("_y").agg(F.sum("_w").alias("w")).collect()}  # one row per class
    if not share:
        raise ValueError("no labelled rows")
    classes = sorted(share)
    total = sum(share.values())
    prior = np.log(np.array([max(share[c] / total, 1e-12) for c in classes]))
    model = BoostedModel(names, bin_edges(used, names, cfg.bins) if names else [], classes, (prior - prior.mean()).tolist())
    width, k = cfg.bins + 1, len(classes)
    shape = (len(names), width, 3)

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, _BLOCK):
            y = np.searchsorted(classes, table.column("_y").to_numpy()).astype(np.int32)
            scores = np.tile(np.array(model.base), (len(y), 1))
            yield block(y.tobytes(), table.column("_w").to_numpy().astype(float).tobytes(), model.binned(_matrix(table, names)).T.tobytes(), scores.tobytes())

    def block(*columns: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["y", "w", "bins", "scores"])

    schema = "y binary, w binary, bins binary, scores binary"
    data = cut(used.mapInArrow(to_blocks, schema))
    kept = 0

    def blocks(batches: Iterator[pa.RecordBatch], now: BoostedModel, since: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(class, weight, bins, scores) of the rows of each block."""
        for batch in batches:
            for i in range(batch.num_rows):
                y, w, bins, scores = (batch.column(c)[i].as_buffer() for c in ("y", "w", "bins", "scores"))
                y = np.frombuffer(y, np.int32)
                bins = np.frombuffer(bins, np.uint8).reshape(len(names), len(y)).T
                yield y, np.frombuffer(w), bins, now.scores(bins, np.frombuffer(scores).reshape(len(y), k), since)

    def counted(now: BoostedModel, since: int, growing: list[Tree], nodes: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
        """Sums[feature, bin, (g, h, n)] of the (class, node)s."""
        sent = data.sparkSession.sparkContext.broadcast((now.trees, growing))
        slots = {node: i for i, node in enumerate(nodes)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, open_trees = sent.value
            here = BoostedModel(now.names, now.edges, now.classes, now.base, trees)
            out = np.zeros((len(nodes), *shape), np.int64)
            for y, weights, bins, scores in blocks(batches, here, since):
                p = softmax(scores)
                for c in sorted({c for c, _ in nodes}):
                    own = [n for d, n in nodes if d == c]
                    place = np.full(len(open_trees[c].feature), -1)
                    place[own] = np.arange(len(own))
                    slot = place[open_trees[c].leaves(bins)]
                    inside = np.flatnonzero(slot >= 0)
                    start, pc, wide = slot[inside] * width, p[inside, c], weights[inside]
                    g = np.rint((pc - (y[inside] == c)) * wide * _ONE)
                    h = np.rint(pc * (1 - pc) * wide * _ONE)
                    g_piece, h_piece, cells = _piece(g), _piece(h), len(own) * width
                    first = slots[c, own[0]]
                    for j in range(len(names)):
                        at = start + bins[:, j].take(inside)
                        sums = (_exact_sums(at, g, cells, g_piece), _exact_sums(at, h, cells, h_piece), np.bincount(at, minlength=cells))
                        for i, s in enumerate(sums):
                            out[first : first + len(own), j, :, i] += s.reshape(len(own), width)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(nodes)), pa.int32()), pa.array([o.tobytes() for o in out], pa.binary())], ["slot", "sums"])

        def add(group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(s.as_buffer(), np.int64) for chunk in group.column("sums").chunks for s in chunk)
            return pa.table({"slot": group.column("slot").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

        found = data.mapInArrow(run, "slot int, sums binary").groupBy("slot").applyInArrow(add, "slot int, sums binary").collect()  # one row per class and node
        return {nodes[r["slot"]]: np.frombuffer(r["sums"], np.int64).reshape(shape) for r in found}

    def plain(sums: np.ndarray) -> np.ndarray:
        return np.stack([sums[..., 0] / _ONE, sums[..., 1] / _ONE, sums[..., 2].astype(float)], axis=-1)

    for round_no in range(cfg.rounds if names else 0):
        size = 2 ** (cfg.depth + 1) - 1
        trees = [Tree(np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size)) for _ in classes]
        totals: dict[tuple[int, int], np.ndarray] = {}
        above: dict[tuple[int, int], np.ndarray] = {}  # sums of the level before
        open_ = [(c, 0) for c in range(k)]
        for level in range(max(1, cfg.depth)):
            if not open_:
                break
            small = [n for n in open_ if level == 0 or totals[n][2] < totals[n[0], _sister(n[1])][2] or (totals[n][2] == totals[n[0], _sister(n[1])][2] and n[1] % 2)]
            sums = counted(model, kept, trees, small)
            sums |= {n: above[n[0], (n[1] - 1) // 2] - sums[n[0], _sister(n[1])] for n in open_ if n not in sums}
            if level == 0:
                totals = {n: s[0].sum(axis=0) for n, s in sums.items()}
                for c, t in enumerate(trees):
                    t.value[0] = leaf(plain(totals[c, 0]), cfg)
            if level == cfg.depth or width < 3:
                break
            split = best_splits(plain(np.stack([sums[n] for n in open_])), cfg)
            grown = []
            for (c, node), f, b, m in zip(open_, *(x.tolist() for x in split[1:])):
                if f < 0:
                    continue
                t = trees[c]
                t.feature[node], t.bin[node], t.missing_left[node] = f, b, m
                for child, s in zip((2 * node + 1, 2 * node + 2), _side_sums(sums[c, node], f, b, m)):
                    totals[c, child] = s
                    t.value[child] = leaf(plain(s), cfg)
                    grown.append((c, child))
            open_, above = grown if level + 1 < cfg.depth else [], sums
        model.trees.append(trees)
        if (round_no + 1) % cfg.keep_every == 0 and round_no + 1 < cfg.rounds:
            sent = data.sparkSession.sparkContext.broadcast(model)
            since = kept

            def advance(batches: Iterator[pa.RecordBatch], sent=sent, since=since) -> Iterator[pa.RecordBatch]:
                for y, weights, bins, scores in blocks(batches, sent.value, since):
                    yield block(y.tobytes(), weights.tobytes(), bins.T.tobytes(), scores.tobytes())

            data = cut(data.mapInArrow(advance, schema))
            kept = len(model.trees)
    return model


def _sister(node: int) -> int:
    return node + 1 if node % 2 else node - 1


def leaf(total: np.ndarray, cfg: BoostConfig) -> float:
    return -cfg.step * total[0] / max(total[1] + cfg.penalty, 1e-12)


def class_probabilities(df: DataFrame, model: BoostedModel, prefix: str = "p_") -> DataFrame:
    """Add one probability per class, ``p_-1``, ``p_0``, ``p_1`` for labels -1, 0 and 1; they add up to one."""
    sent = df.sparkSession.sparkContext.broadcast(model.to_json())
    out = [f"{prefix}{c:g}" for c in model.classes]
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BoostedModel.from_json(sent.value)
        for batch in batches:
            p = softmax(own.scores(own.binned(_matrix(batch, own.names)))) if batch.num_rows else np.zeros((0, len(out)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, i]) for i in range(len(out)))], [*kept, *out])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in out]]))


def save_model(model: BoostedModel, path: str, spark: SparkSession) -> None:
    """The model as a folder with one text row."""
    spark.createDataFrame([(model.to_json(),)], "model string").write.mode("overwrite").parquet(path)


def load_boosted(path: str, spark: SparkSession) -> BoostedModel:
    return BoostedModel.from_json(spark.read.parquet(path).first()["model"])
