"""Isolation forest (Liu et al., ICDM 2008): one task builds one tree from its own small sample."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logspark.detectors.kept import keep_settings, kept_settings
from logspark.detectors.vectors import distinct_vectors, score_by_vector
from logspark.operators.rank import running_totals

_NODES = "tree int, node int, feature int, split double, left int, right int, path double"


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(values: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes ``(node, feature, split, left, right, path)``; leaves have feature -1."""
    limit = int(np.ceil(np.log2(max(len(values), 2))))
    nodes: list[list] = []
    todo = [(values, 0, -1, "")]
    while todo:
        rows, depth, parent, side = todo.pop()
        place = len(nodes)
        if parent >= 0:
            nodes[parent][3 if side == "left" else 4] = place
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes.append([place, -1, 0.0, -1, -1, depth + average_path(len(rows))])
            continue
        feature = int(rng.choice(usable))
        split = float(rng.uniform(low[feature], high[feature]))
        nodes.append([place, feature, split, -1, -1, 0.0])
        below = rows[:, feature] <= split
        todo += [(rows[below], depth + 1, place, "left"), (rows[~below], depth + 1, place, "right")]
    return [tuple(n) for n in nodes]


@dataclass
class IsolationForest:
    columns: list[str]
    nodes: pd.DataFrame
    trees: int
    sample: int
    threshold: float = 1.0

    def transform(self, matrix: DataFrame) -> DataFrame:
        """Add ``score`` (close to 1 = easily isolated) and ``pred``."""
        return score_by_vector(matrix, self.columns, self.score).withColumn(
            "pred", (F.col("score") > self.threshold).cast("int"))

    def save(self, path: str) -> None:
        """Replace what is at ``path``. Nodes are a table, as many as trees and samples give."""
        SparkSession.active().createDataFrame(self.nodes, _NODES).write.mode("overwrite").parquet(f"{path}/nodes")
        keep_settings(path, {name: value for name, value in vars(self).items() if name != "nodes"})

    @classmethod
    def load(cls, path: str) -> IsolationForest:
        nodes = SparkSession.active().read.parquet(f"{path}/nodes").toPandas()
        return cls(nodes=nodes[[part.split(" ")[0] for part in _NODES.split(", ")]], **kept_settings(path))

    def score(self, rows: DataFrame) -> DataFrame:
        """Add ``score`` row by row."""
        columns, scale = self.columns, average_path(self.sample)
        forest = rows.sparkSession.sparkContext.broadcast([
            tuple(tree[c].to_numpy() for c in ("feature", "split", "left", "right", "path"))
            for _, tree in self.nodes.sort_values(["tree", "node"]).groupby("tree")])

        def isolation(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                values = batch[columns].to_numpy(float)
                every, depth = np.arange(len(values)), np.zeros(len(values))
                for feature, split, left, right, path in forest.value:
                    at = np.zeros(len(values), int)
                    while (inner := feature[at] >= 0).any():
                        below = values[every, np.maximum(feature[at], 0)] <= split[at]
                        at = np.where(inner, np.where(below, left[at], right[at]), at)
                    depth += path[at]
                yield batch.assign(score=2.0 ** (-depth / max(len(forest.value), 1) / max(scale, 1e-12)))

        schema = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)
        return rows.mapInPandas(isolation, schema + ", score double")


def fit_forest(
    matrix: DataFrame, columns: list[str], key: str, trees: int = 100, sample: int = 256,
    contamination: float = 0.03, seed: int = 42,
) -> IsolationForest:
    """Samples are drawn by hash: the same rows whatever the partitioning.

    A hash per row thins the table to half as many rows again as all trees need, and each row kept goes to one tree. A
    table with fewer rows than that gives each row to several trees, so the number drawn is the same; no task sees
    more rows than a tree needs.
    """
    n = matrix.count()
    sample = min(sample, n)
    pool = max(int(1.5 * trees * (sample + 64)), 1)

    def keep_share(share: float):
        return F.lit(min(int(share * 2**64) - 2**63, 2**63 - 1))

    def draw(*values):
        return F.xxhash64(F.lit(seed).cast("bigint"), *values)

    copies = min(trees, -(-pool // max(n, 1)))
    own = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda c: (
        c if copies == trees else F.pmod(draw(F.lit("tree"), c, F.col(key)), F.lit(trees))).cast("int"))
    picked = (
        matrix.select(key, *columns).where(draw(F.col(key)) <= keep_share(pool / max(n, 1)))
        .withColumn("tree", F.explode(F.array_distinct(own)))
        .withColumn("_draw", draw(F.col("tree"), F.col(key)))
        # A fixed number of partitions: growing trees is work for the cores, however few the bytes.
        .repartition(int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tree")
        .withColumn("_place", F.row_number().over(W.partitionBy("tree").orderBy("_draw", key)))
        .where(F.col("_place") <= sample)
    )

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_place")
        tree = int(group["tree"].iloc[0])
        nodes = grow_tree(group[columns].to_numpy(float), np.random.default_rng([seed, tree]))
        frame = pd.DataFrame(nodes, columns=["node", "feature", "split", "left", "right", "path"])
        return frame.assign(tree=tree)[["tree", "node", "feature", "split", "left", "right", "path"]]

    # trees x (2 x sample - 1) nodes at most.
    nodes = picked.groupBy("tree").applyInPandas(grow, _NODES).toPandas()
    forest = IsolationForest(columns, nodes, trees, sample)
    # Exact quantile over the sessions, from the running weight of the distinct vectors.
    ranked = running_totals(
        forest.score(distinct_vectors(matrix, columns)), [F.col("score"), *[F.col(c) for c in columns]],
        sums={"below": F.col("weight")})
    forest.threshold = ranked.where(
        F.col("below") >= F.col("total_below") * (1.0 - contamination)).agg(F.min("score")).first()[0] or 1.0
    return forest
