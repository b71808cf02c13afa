"""A fitted boosted model: scoring and additive contributions in Arrow batches, and its stored form.

The model holds its trees, with the text of each category that a split names (at most one for each node, whatever the size of the
training dictionary), the values that fill gaps, and nothing else; scoring joins nothing.
"""

from __future__ import annotations

import json
from functools import cached_property, reduce
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidentlens import fixed_values as fv
from incidentlens.plans.workers import ship

TABLED = 6  # leaves with up to so many inputs have the contributions of all patterns tabled

NODE_SCHEMA = ("tree int, node int, feature string, category string, threshold double, gap_left boolean, left int, right int, "
               "value double, cover double")


class Ensemble:
    """The trees as arrays, for batches of rows; travels to the workers."""

    def __init__(self, nodes: list[dict], categorical: list[str], numerical: list[str]):
        columns = {c: i for i, c in enumerate([*categorical, *numerical])}
        self.n_categorical = len(categorical)
        self.codes = [{} for _ in categorical]  # number of each category that some split names
        slots = {(c, None): i for i, c in enumerate(numerical)}
        self.trees, by_tree = [], {}
        for n in nodes:
            by_tree.setdefault(n["tree"], []).append(n)
        for number in sorted(by_tree):
            part = sorted(by_tree[number], key=lambda n: n["node"])
            column = np.array([-1 if n["feature"] is None else columns[n["feature"]] for n in part])
            split, slot = np.zeros(len(part)), np.full(len(part), -1)
            for i, n in enumerate(part):
                if n["feature"] is None:
                    continue
                if n["category"] is None:
                    split[i] = n["threshold"]
                else:
                    known = self.codes[column[i]]
                    split[i] = known.setdefault(n["category"], len(known))
                slot[i] = slots.setdefault((n["feature"], n["category"]), len(slots))
            self.trees.append((column, split, np.array([n["gap_left"] for n in part]), np.array([n["left"] for n in part]),
                               np.array([n["right"] for n in part]), np.array([n["value"] for n in part]),
                               np.array([n["cover"] for n in part]), slot))
        self.slots = list(slots)
        self.leaves = [self._leaves(tree) for tree in self.trees]
        self.upwards = [self._upwards(tree) for tree in self.trees]

    @staticmethod
    def _leaves(tree) -> list:
        """(value, slots, share of each slot, tests of each slot as (node, goes right)) of every leaf."""
        column, _, _, left, right, value, cover, slot = tree
        out, todo = [], [(0, [])]
        while todo:
            node, taken = todo.pop()
            if column[node] < 0:
                shares, tests = {}, {}
                for at, to_right, share in taken:
                    s = int(slot[at])
                    shares[s] = shares.get(s, 1.0) * share
                    tests.setdefault(s, []).append((at, to_right))
                out.append((float(value[node]), list(shares), np.array(list(shares.values())), list(tests.values())))
                continue
            for child, to_right in ((left[node], False), (right[node], True)):
                todo.append((child, [*taken, (node, to_right, cover[child] / cover[node] if cover[node] else 0.0)]))
        return out

    def matrix(self, columns: list[pd.Series]) -> np.ndarray:
        """Category numbers (-1: none that a split names) and numeric values (gaps: NaN) of a batch; its columns lie together."""
        out = np.empty((len(columns[0]), len(columns)), order="F")
        for i, values in enumerate(columns):
            if i < self.n_categorical:
                out[:, i] = values.map(self.codes[i]).fillna(-1).to_numpy(np.float64)
            else:
                out[:, i] = values.to_numpy(np.float64, na_value=np.nan)
        return out

    def goes_right(self, x: np.ndarray, tree) -> np.ndarray:
        """For each row and node of a tree whether the row goes right there; not at a leaf. Columns lie together."""
        column, split, gap_left = tree[:3]
        out = np.zeros((len(x), len(column)), bool, order="F")
        for node in np.flatnonzero(column >= 0):
            value, to = x[:, column[node]], out[:, node]
            if column[node] < self.n_categorical:
                np.equal(value, split[node], out=to)
            elif gap_left[node]:
                np.greater_equal(value, split[node], out=to)
            else:  # true of a gap, too
                np.logical_not(value < split[node], out=to)
        return out

    @staticmethod
    def _upwards(tree) -> list[int]:
        """The nodes of a tree, children before their parents."""
        column, left, right = tree[0], tree[3], tree[4]
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            out.append(node)
            if column[node] >= 0:
                todo += [int(left[node]), int(right[node])]
        return out[::-1]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for tree, upwards in zip(self.trees, self.upwards):
            column, _, _, left, right, value, *_ = tree
            test, reached = self.goes_right(x, tree), {}
            for node in upwards:
                inner = column[node] >= 0
                reached[node] = np.where(test[:, node], reached.pop(right[node]), reached.pop(left[node])) if inner else value[node]
            out += reached[0]
        return out

    @property
    def base(self) -> float:
        """The margin that is expected before any input is known."""
        return float(sum(value * np.prod(shares) for leaves in self.leaves for value, _, shares, _ in leaves))

    @cached_property
    def tables(self) -> list:
        """For each leaf of few inputs its contributions, by input and pattern of met conditions."""
        return [[self._table(*leaf[:3]) for leaf in leaves] for leaves in self.leaves]

    @staticmethod
    def _table(value, slots, shares) -> np.ndarray | None:
        if not 0 < len(slots) <= TABLED:
            return None
        every = (np.arange(1 << len(slots))[:, None] >> np.arange(len(slots)) & 1).astype(bool)
        return np.ascontiguousarray(path_contributions(every, shares, value).T)

    def slot_contributions(self, x: np.ndarray) -> np.ndarray:
        """Rows x slots: each input's additive share of the margin beyond ``base``."""
        out = np.zeros((len(self.slots), len(x)))
        for tree, leaves, tables in zip(self.trees, self.leaves, self.tables):
            test = self.goes_right(x, tree)
            other = ~test
            for (value, slots, shares, tests), table in zip(leaves, tables):
                if not slots:
                    continue
                met = [reduce(np.logical_and, [(test if to_right else other)[:, node] for node, to_right in of_slot])
                       for of_slot in tests]
                if table is not None:
                    pattern = met[0].astype(np.intp)
                    for j, m in enumerate(met[1:], 1):
                        pattern |= m.astype(np.intp) << j
                    for slot, by_pattern in zip(slots, table):
                        out[slot] += by_pattern[pattern]
                else:
                    kinds, which = np.unique(np.stack(met, 1), axis=0, return_inverse=True)
                    found = path_contributions(kinds, shares, value)[which.reshape(-1)]
                    for j, slot in enumerate(slots):
                        out[slot] += found[:, j]
        return np.ascontiguousarray(out.T)


def path_contributions(met: np.ndarray, shares: np.ndarray, value: float) -> np.ndarray:
    """Shapley values of one leaf for patterns of met conditions (patterns x inputs), for any number of inputs.

    For a set of known inputs the leaf counts with the product, over the known ones, of 1 or 0 (condition met or not) and,
    over the others, of their shares. The path's polynomial, the product of (share + met * t), is extended input by
    input: its coefficient of t**s sums up all sets of s inputs. To leave one input out, its factor is unwound again, and the
    coefficients that are left are weighted by how many orders have s inputs before it.
    """
    n, d = met.shape
    one = met.astype(float)
    full = np.zeros((n, d + 1))
    full[:, 0] = 1.0
    for j in range(d):
        full[:, 1:] = full[:, 1:] * shares[j] + full[:, :-1] * one[:, j:j + 1]
        full[:, 0] *= shares[j]
    weight = np.array([factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)])
    out = np.empty((n, d))
    for i in range(d):
        rest, carry = np.empty((n, d)), np.zeros(n)
        for s in range(d - 1, -1, -1):
            carry = full[:, s + 1] - shares[i] * carry  # the factor (share + t)
            rest[:, s] = carry
        unmet = ~met[:, i]
        if unmet.any():  # the factor is the share alone
            if shares[i] > 0:
                rest[unmet] = full[unmet, :-1] / shares[i]
            else:
                rest[unmet] = _without(met[unmet], shares, i)
        out[:, i] = value * (one[:, i] - shares[i]) * (rest @ weight)
    return out


def _without(met: np.ndarray, shares: np.ndarray, i: int) -> np.ndarray:
    full = np.zeros((len(met), len(shares)))
    full[:, 0] = 1.0
    for j in range(len(shares)):
        if j != i:
            full[:, 1:] = full[:, 1:] * shares[j] + full[:, :-1] * met[:, j:j + 1]
            full[:, 0] *= shares[j]
    return full


class BoostedModel:
    """Trees over the 13 features. ``nodes`` are dicts of ``NODE_SCHEMA``; ``fills`` maps features to what fills their gaps."""

    def __init__(self, nodes: list[dict], fills: dict, categorical=tuple(fv.CATEGORICAL), numerical=tuple(fv.NUMERICAL)):
        self.nodes, self.fills = nodes, fills
        self.categorical, self.numerical = list(categorical), list(numerical)
        self.ensemble = Ensemble(nodes, self.categorical, self.numerical)

    @property
    def features(self) -> list[str]:
        return [*self.categorical, *self.numerical]

    @property
    def n_trees(self) -> int:
        return len(self.ensemble.trees)

    def inputs(self) -> list:
        """The model's inputs as columns, gaps filled."""
        out = []
        for c in self.features:
            value = F.col(c).cast("string" if c in self.categorical else "double")
            out.append(F.coalesce(value, F.lit(self.fills[c])) if c in self.fills else value)
        return out

    def udf(self, spark, compute, kind):
        """An Arrow function of the inputs: ``compute(ensemble, matrix)``."""
        ship(spark)
        shared = spark.sparkContext.broadcast(self.ensemble)

        @F.pandas_udf(kind)
        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series(list(compute(shared.value, shared.value.matrix(list(columns)))) if len(columns[0]) else [])

        return run(*self.inputs())

    def with_margin(self, df: DataFrame, name: str = "margin") -> DataFrame:
        """Append the log odds of the positive class."""
        return df.withColumn(name, self.udf(df.sparkSession, Ensemble.margins, T.DoubleType()))

    def transform(self, df: DataFrame) -> DataFrame:
        """All columns and ``prediction`` (int), ``probability`` of the positive class."""
        out = self.with_margin(df.drop("prediction", "probability"), "_margin")
        return out.withColumns({"prediction": (F.col("_margin") > 0).cast("int"),
                                "probability": 1 / (1 + F.exp(-F.col("_margin")))}).drop("_margin")

    def node_table(self, spark: SparkSession) -> DataFrame:
        """One row for each node of each tree."""
        names = [f.split()[0] for f in NODE_SCHEMA.split(", ")]
        return spark.createDataFrame([tuple(n[c] for c in names) for n in self.nodes], NODE_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write ``nodes`` as Parquet and ``about``, one line of JSON."""
        self.node_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        about = {"class": "BoostedModel", "trees": self.n_trees, "fills": self.fills, "categorical": self.categorical,
                 "numerical": self.numerical}
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedModel:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        nodes = [r.asDict() for r in spark.read.parquet(f"{path}/nodes").collect()]
        return cls(nodes, about["fills"], about["categorical"], about["numerical"])
