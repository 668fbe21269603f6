"""Filling missing values with a Chow-Liu dependency tree over discretised and categorical fields.

All fields become small sets of states: numeric ones by quantile cuts, categorical ones by their values. Pairwise state
counts over all rows give mutual informations; the maximum spanning tree of these is the best tree-shaped model of the
fields. A missing cell's posterior given the row's known fields follows from message passing along the tree, and is
decoded to the most probable value (categorical) or to the median of the most probable bin (numeric).

The model is a bounded summary: ``fields * states`` marginals and ``fields^2 / 2 * states^2`` pair counts, whatever the
number of rows. Rows are read four times: for the numeric fields' quantiles, for the values of the categorical ones, for the pair counts and for filling.
They are not shuffled by this operator, but for cells that turn out to be one of a field's rare values: a field with more
values than states keeps the rest in one shared state, and where such a state takes part, a cell is decoded in a second step to the
value most frequent beside the value of the field's strongest neighbour in the tree, by a join with a table of those.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.functions.columns import finite, fresh

OTHER = "\x00other"


@dataclass
class Field:
    """States of one field. Numeric: ``cuts`` between neighbouring bins and the ``medians`` of the bins. Categorical:
    ``values``, the last one being ``OTHER`` if there were more than the limit."""

    name: str
    numeric: bool
    cuts: np.ndarray = field(default_factory=lambda: np.empty(0))
    medians: np.ndarray = field(default_factory=lambda: np.empty(0))
    values: list[str] = field(default_factory=list)

    @property
    def size(self) -> int:
        return len(self.medians) if self.numeric else len(self.values)

    def states(self, column: pa.Array) -> np.ndarray:
        """State of each value, -1 for a missing one."""
        if not self.size:
            return np.full(len(column), -1)
        if self.numeric:
            x = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
            return np.where(np.isfinite(x), np.searchsorted(self.cuts, x, side="right"), -1)
        code = pc.fill_null(pc.index_in(column, value_set=pa.array(self.values, pa.string())), -1).to_numpy(zero_copy_only=False)
        if self.values[-1] == OTHER:
            code = np.where((code < 0) & column.is_valid().to_numpy(zero_copy_only=False), len(self.values) - 1, code)
        return code

    @property
    def shared(self) -> bool:
        return not self.numeric and self.size > 1 and self.values[-1] == OTHER

    def state_column(self, name: str) -> Column:
        """What tells the field's values apart as a key: the bin of a number, the value itself of a category."""
        if self.numeric:
            return F.size(F.filter(F.array(*[F.lit(float(c)) for c in self.cuts]), lambda c: c <= finite(name))).cast("string") if len(self.cuts) else F.lit("0")
        return F.col(name).cast("string")

    def decode(self, posterior: np.ndarray) -> np.ndarray:
        """The most probable state's value: a bin's median, a category, or ``OTHER`` for the shared state."""
        return (self.medians if self.numeric else np.array(self.values, dtype=object))[posterior.argmax(1)]


@dataclass
class Tree:
    fields: list[Field]
    edges: list[tuple[int, int]]
    marginals: list[np.ndarray]
    given: dict[tuple[int, int], np.ndarray]  # (u, v): P(u | v), one row per state of v
    weight: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))  # mutual informations
    #: By the name of a category that has a shared state itself or beside it: its strongest neighbour in the tree, the most frequent
    #: rare value of all and, as ``key, value``, the most frequent value beside each bin or value of the neighbour.
    rare: dict[str, tuple[int | None, str | None, DataFrame | None]] = field(default_factory=dict)

    def posterior(self, target: int, states: np.ndarray) -> np.ndarray:
        """P(target | known fields) for rows with the same fields missing; ``states`` is rows x fields."""
        near: dict[int, list[int]] = {i: [] for i in range(len(self.fields))}
        for a, b in self.edges:
            near[a].append(b)
            near[b].append(a)

        def message(u: int, v: int) -> np.ndarray:
            table = self.given[u, v]
            if len(states) and states[0, u] >= 0:
                return table[:, states[:, u]].T
            inside = np.ones((len(states), self.fields[u].size))
            for w in near[u]:
                if w != v:
                    inside = inside * message(w, u)
            out = inside @ table.T
            return out / out.sum(1, keepdims=True)

        p = np.repeat(self.marginals[target][None, :], len(states), 0)
        for u in near[target]:
            p = p * message(u, target)
        return p / p.sum(1, keepdims=True)


def _numeric_field(name: str, quantiles: list[float] | None) -> Field:
    if not quantiles:
        return Field(name, True)
    q = np.array(quantiles, float)
    cuts = np.unique(q[1::2])  # q: 1/2n, 2/2n, ..., (2n-1)/2n; the odd positions separate bins, the even ones are mid-bin
    middle = np.searchsorted(cuts, q[0::2], side="right")
    kept = [b for b in range(len(cuts) + 1) if (middle == b).any()]
    # Bins that hold no mid-bin quantile (values between tied cuts) join the next lower one.
    cuts = cuts[np.array(kept[1:], int) - 1]
    middle = np.searchsorted(cuts, q[0::2], side="right")
    return Field(name, True, cuts, np.array([np.median(q[0::2][middle == b]) for b in range(len(cuts) + 1)]))


def fit_tree(df: DataFrame, numeric: dict[str, int], categorical: Sequence[str], max_states: int = 128, accuracy: int = 5000, smoothing: float = 0.5) -> Tree:
    """The Chow-Liu tree of ``numeric`` (name -> bins) and ``categorical`` fields of all rows of ``df``.

    Quantile cuts have a rank error of at most 1 / ``accuracy`` of the rows. A categorical field of more than
    ``max_states`` values has a state for each of the most frequent ones and one shared by all others, which are told apart
    by a second table. Counts of a pair use the rows that know both fields.
    """
    fields = []
    if numeric:
        asked = {c: [i / (2 * n) for i in range(1, 2 * n)] for c, n in numeric.items()}
        row = df.agg(*[F.percentile_approx(finite(c), p, accuracy).alias(f"q{i}") for i, (c, p) in enumerate(asked.items())]).first()
        fields += [_numeric_field(c, row[i]) for i, c in enumerate(asked)]
    if categorical:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(categorical)])).alias("x"))
        counted = long.where("x.v is not null").groupBy("x.i", "x.v").count()
        place = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("count"), "v"))
        top: dict[int, list[str]] = {}
        for r in counted.withColumn("place", place).where(F.col("place") <= max_states + 1).orderBy("i", "place").collect():
            top.setdefault(r["i"], []).append(r["v"])
        for i, c in enumerate(categorical):
            values = top.get(i, [])
            fields.append(Field(c, False, values=values if len(values) <= max_states else [*values[: max_states - 1], OTHER]))
    names = [f.name for f in fields]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            s = [f.states(batch.column(i)) for i, f in enumerate(fields)]
            for a in range(len(fields)):
                for b in range(a, len(fields)):
                    if fields[a].size and fields[b].size:
                        both = (s[a] >= 0) & (s[b] >= 0)
                        cell = s[a][both] * fields[b].size + s[b][both]
                        totals[a, b] = totals.get((a, b), 0) + np.bincount(cell, minlength=fields[a].size * fields[b].size)
        for (a, b), t in totals.items():
            (cell,) = np.nonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), v, np.int32)) for v in (a, b)] + [pa.array(cell.astype(np.int32)), pa.array(t[cell].astype(np.int64))], names=["a", "b", "cell", "n"])

    counts = {(a, b): np.zeros((fields[a].size, fields[b].size)) for a in range(len(fields)) for b in range(a, len(fields))}
    typed = df.select(*[F.col(c).cast("double" if c in numeric else "string").alias(c) for c in names])
    for r in typed.mapInArrow(count, "a int, b int, cell int, n long").groupBy("a", "b", "cell").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["a"], r["b"]][divmod(r["cell"], fields[r["b"]].size)] = r["n"]
    tree = chow_liu(fields, counts, smoothing)
    for i, f in enumerate(fields):
        near = [b if a == i else a for a, b in tree.edges if i in (a, b)]
        u = max(near, key=lambda k: tree.weight[i, k]) if near else None
        if f.shared or not f.numeric and u is not None and fields[u].shared:
            tree.rare[f.name] = _rare_values(df, tree, i, u)
    return tree


def _rare_values(df: DataFrame, tree: Tree, i: int, u: int | None) -> tuple[int | None, str | None, DataFrame | None]:
    """The values that shared states hide: the most frequent rare one of field ``i``, and the most frequent one beside each value of
    its neighbour ``u`` (of equals the smallest). One row per value of the neighbour, however many rare values there are."""
    f = tree.fields[i]
    rows = df.select(F.col(f.name).cast("string").alias("value"), *[F.col(g.name) for g in tree.fields if g.name != f.name]).where(F.col("value").isNotNull())
    rare = ~F.col("value").isin(f.values[:-1]) if f.shared else F.lit(False)
    first = rows.where(rare).groupBy("value").count().orderBy(F.desc("count"), "value").limit(1).collect()
    first = first[0]["value"] if first else None
    if u is None:
        return None, first, None
    near = tree.fields[u]
    beside = ~F.col(near.name).isin(near.values[:-1]) if near.shared else F.lit(False)
    pairs = rows.where(rare | beside).withColumn("key", near.state_column(near.name)).where(F.col("key").isNotNull()).groupBy("key", "value").count()
    most = F.min(F.struct((-F.col("count")).alias("n"), F.col("value")))["value"]
    return u, first, pairs.groupBy("key").agg(most.alias("value"))


def chow_liu(fields: list[Field], counts: dict[tuple[int, int], np.ndarray], smoothing: float = 0.5) -> Tree:
    """The maximum spanning tree by mutual information (ties: the earlier fields), with smoothed tables."""
    n = len(fields)
    marginals = [np.diag(counts[i, i]) + smoothing for i in range(n)]
    marginals = [m / m.sum() if len(m) else m for m in marginals]
    weight = np.full((n, n), -1.0)
    for (a, b), c in counts.items():
        if a != b and c.sum() > 0:
            p = c / c.sum()
            expected = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
            weight[a, b] = weight[b, a] = float((p[p > 0] * np.log(p[p > 0] / expected[p > 0])).sum())
    edges, todo = [], [i for i in range(n) if fields[i].size]
    inside = todo[:1]
    todo = todo[1:]
    while todo:
        _, a, b = max(((weight[a, b], a, b) for a in inside for b in todo), key=lambda x: (x[0], -x[1], -x[2]))
        if weight[a, b] >= 0:
            edges.append((a, b))
        inside.append(b)
        todo.remove(b)
    given = {}
    for a, b in edges:
        c = counts[min(a, b), max(a, b)]
        c = c if a < b else c.T
        # Smoothed towards the marginals, so that a state never seen with another keeps a small probability.
        ab, ba = c.T + smoothing * marginals[a][None, :] * 2, c + smoothing * marginals[b][None, :] * 2
        given[a, b], given[b, a] = ab / ab.sum(1, keepdims=True), ba / ba.sum(1, keepdims=True)
    return Tree(fields, edges, marginals, given, weight)


def fill_missing(df: DataFrame, tree: Tree, targets: Sequence[str], suffix: str = "_filled") -> DataFrame:
    """``df`` with the missing cells of ``targets`` filled and a boolean column ``<target><suffix>`` that marks them.

    A numeric cell is missing if null, NaN or infinite, a categorical one if null: make other codes for "missing" null
    before. Known cells are kept as they are. A field without any known value in the fitted data cannot be filled: its
    cells stay missing, without a mark. All rows and all other columns come through; a mark whose name is taken by a column
    of ``df`` gets a leading underscore.
    """
    marks = fresh(df, *[t + suffix for t in targets])
    rare, tree = tree.rare, replace(tree, rare={})  # tables do not travel to the workers
    steps = {t: (rare[t][0], rare[t][1]) for t in targets if t in rare}
    second = dict(zip(steps, fresh(df, *marks, *[f"second_{t}" for t in steps])[len(marks) :]))
    index = {f.name: i for i, f in enumerate(tree.fields)}
    helpers = fresh(df, *[f"state_of_{i}" for i in range(len(tree.fields))])
    given = df.select("*", *[F.col(f.name).cast("double" if f.numeric else "string").alias(h) for f, h in zip(tree.fields, helpers)])
    kinds = {t: (T.DoubleType() if tree.fields[index[t]].numeric else T.StringType()) for t in targets}
    schema = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in df.schema] + [T.StructField(m, T.BooleanType()) for m in (*marks, *second.values())])
    width = len(df.columns)
    place = {t: df.columns.index(t) for t in targets}

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            states = np.stack([f.states(columns[width + i]) for i, f in enumerate(tree.fields)], 1) if batch.num_rows else np.empty((0, len(index)), int)
            known = (states >= 0) @ (1 << np.arange(states.shape[1]))
            made, again = [], []
            for t in targets:
                i = index[t]
                f = tree.fields[i]
                given_column = columns[width + i]
                missing = (states[:, i] < 0) & bool(f.size)
                out = np.array(given_column.to_numpy(zero_copy_only=False), dtype=float if f.numeric else object)
                for pattern in np.unique(known[missing]):
                    rows = np.flatnonzero(missing & (known == pattern))
                    evidence, which = np.unique(states[rows], axis=0, return_inverse=True)
                    out[rows] = f.decode(tree.posterior(i, evidence))[which.ravel()]
                made.append(missing)
                if t in steps:  # a shared state is not a value yet
                    u, first = steps[t]
                    hidden = missing & (out == OTHER)
                    out[hidden] = first
                    again.append(hidden | missing & (states[:, u] == tree.fields[u].size - 1) if u is not None and tree.fields[u].shared else hidden)
                columns[place[t]] = pa.array(out, pa.float64() if f.numeric else pa.string(), from_pandas=False, mask=~missing & ~given_column.is_valid().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*columns[:width], *[pa.array(m, pa.bool_()) for m in (*made, *again)]], names=[f.name for f in schema])

    out = given.mapInArrow(fill, schema)
    for t, flag in second.items():
        u, _, values = rare[t]
        out = _tell_apart(out, t, flag, tree.fields[u], values) if values is not None else out.drop(flag)
    return out


def _tell_apart(out: DataFrame, target: str, flag: str, near: Field, values: DataFrame) -> DataFrame:
    """Cells with the ``flag`` become the value that goes with the neighbour's. Rows without it get keys of their own that spread over
    the cluster and meet nothing."""
    key, found = fresh(out, "key", "found")
    spread = F.concat(F.lit(OTHER), F.pmod(F.monotonically_increasing_id(), F.lit(997)).cast("string"))
    keyed = out.withColumn(key, F.coalesce(F.when(F.col(flag), near.state_column(near.name)), spread))
    joined = keyed.join(values.select(F.col("key").alias(key), F.col("value").alias(found)), key, "left")
    return joined.select(*[F.coalesce(found, F.col(c)).alias(c) if c == target else F.col(c) for c in out.columns if c != flag])
