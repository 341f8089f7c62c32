"""Connected components and spanning forests by minimum-edge (Borůvka-style) contraction, as DataFrame rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melisma.tables import materialise

#: Edges of a forest that one task finishes by itself; with more, another round contracts them first.
ONE_TASK = 1_000_000
_EDGE = "src long, dst long, a long, b long"


class _Sets:
    """Disjoint sets of nodes, each named by its smallest one."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if parent[p] != p else p
        return x

    def join(self, a: int, b: int) -> bool:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)
        return ra != rb


def _local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of one partition's edges, those of a spanning forest: at most one per node, so memory is bounded by the partition."""
    sets = _Sets()
    for batch in batches:
        keep = [sets.join(x, y) for x, y in zip(batch["src"].tolist(), batch["dst"].tolist())]
        yield batch[keep]


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All edges left -> rows of kind 0 (node, root) and of kind 1 (an edge of the forest)."""
    sets = _Sets()
    for batch in batches:
        keep = [sets.join(x, y) for x, y in zip(batch["src"].tolist(), batch["dst"].tolist())]
        yield pd.DataFrame({"kind": 1, "x": batch["a"][keep], "y": batch["b"][keep]})
    nodes = list(sets.parent)
    for s in range(0, len(nodes), 100_000):
        part = nodes[s : s + 100_000]
        yield pd.DataFrame({"kind": 0, "x": part, "y": [sets.root(x) for x in part]})


def spanning_forest(edges: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK) -> tuple[DataFrame, DataFrame]:
    """`src`, `dst` (bigint) -> (`node`, `root`), (`src`, `dst`): the smallest node of every node's component, and the edges of a spanning forest.

    Every round each contracted component takes the edge to its smallest neighbour if that is smaller than itself, the
    resulting trees are pointer-jumped to their roots, and the edges are relabelled, freed of loops and thinned to a forest
    within each partition. Once at most `one_task` edges are left, one task joins them. Each round's labels and edges are
    written to the shared folder, so a lost executor costs no earlier round. Only nodes of an edge to another node have a
    row; null ends and loops are dropped; an empty input gives no rows.
    """
    lo, hi = F.least("src", "dst").cast("long"), F.greatest("src", "dst").cast("long")
    clean = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(lo.alias("src"), hi.alias("dst")).select("src", "dst", F.col("src").alias("a"), F.col("dst").alias("b"))
    now = materialise(clean.mapInPandas(_local_forest, _EDGE), "edges")
    labels: list[DataFrame] = []
    kept: list[DataFrame] = []
    for _ in range(max_rounds):
        if now.count() <= one_task:
            last = materialise(now.coalesce(1).mapInPandas(_finish, "kind int, x long, y long"), "roots")
            labels.append(last.where("kind = 0").select(F.col("x").alias("node"), F.col("y").alias("up")))
            kept.append(last.where("kind = 1").select(F.col("x").alias("src"), F.col("y").alias("dst")))
            break
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "a", "b"))
        least = both.groupBy("src").agg(F.min(F.struct("dst", "a", "b")).alias("e"))
        hooks = materialise(least.select(F.col("src").alias("node"), F.least("src", "e.dst").alias("up"), "e.a", "e.b"), "hook")
        kept.append(hooks.where("up < node").select(F.col("a").alias("src"), F.col("b").alias("dst")))
        jumped = hooks.select("node", "up")
        while True:  # pointer jumping: every pass halves the distance to the root
            up = jumped.select(F.col("node").alias("up"), F.col("up").alias("top"))
            nxt = materialise(jumped.join(up, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "jump")
            jumped = nxt.select("node", "up")
            if nxt.where("moved").isEmpty():
                break
        labels.append(jumped)
        x = jumped.select(F.col("node").alias("src"), F.col("up").alias("x"))
        y = jumped.select(F.col("node").alias("dst"), F.col("up").alias("y"))
        moved = now.join(x, "src").join(y, "dst").where("x <> y").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "a", "b")
        now = materialise(moved.mapInPandas(_local_forest, _EDGE), "edges")
    else:
        raise RuntimeError("components did not converge")
    out = labels[0].select("node", F.col("up").alias("root"))
    for nxt in labels[1:]:  # the k-th table labels the roots of the one before
        out = out.join(nxt.select(F.col("node").alias("root"), F.col("up").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    forest = kept[0]
    for more in kept[1:]:
        forest = forest.unionByName(more)
    return out, forest


def components(edges: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """`src`, `dst` -> `node`, `root`: one row per node that stands in an edge to another node, with the smallest node of its component."""
    return spanning_forest(edges, max_rounds, one_task)[0]
