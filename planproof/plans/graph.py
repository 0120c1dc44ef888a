"""The model graph. Its size is that of a project, so the driver walks it; the same closures over large edge tables
are iterative joins."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Graph:
    """Edges parent -> child."""

    def __init__(self, edges):
        self.children: dict[str, list[str]] = {}
        self.parents: dict[str, list[str]] = {}
        for a, b in edges:
            self.children.setdefault(a, []).append(b)
            self.parents.setdefault(b, []).append(a)
            self.children.setdefault(b, [])
            self.parents.setdefault(a, [])

    def depths(self, seeds, up: bool = False) -> dict[str, int]:
        """Nodes reached from the seeds with their least number of steps."""
        near = self.parents if up else self.children
        out = dict.fromkeys(seeds, 0)
        queue = deque(out)
        while queue:
            at = queue.popleft()
            for n in near.get(at, ()):
                if n not in out:
                    out[n] = out[at] + 1
                    queue.append(n)
        return out

    def descendants(self, *nodes: str) -> set[str]:
        return set(self.depths(nodes)) - set(nodes)

    def ancestors(self, *nodes: str) -> set[str]:
        return set(self.depths(nodes, up=True)) - set(nodes)

    def affected(self, modified, tests: dict[str, set[str]] | None = None) -> set[str]:
        """What to build for a change: the modified, what is downstream, models that share a test with either, and all
        that these read. tests: test -> the models it reads."""
        hit = set(self.depths(modified))
        for models in (tests or {}).values():
            if models & hit:
                hit |= models
        return set(self.depths(hit, up=True))

    def changed_ancestors(self, node: str, changed) -> list[tuple[str, int]]:
        """The nearest first, then by name."""
        up = self.depths([node], up=True)
        return sorted(((n, d) for n, d in up.items() if n in set(changed) and n != node), key=lambda x: (x[1], x[0]))

    def reads_source(self, node: str) -> bool:
        return any(n.startswith(("source.", "src.")) for n in self.depths([node], up=True))

    def bound(self, marked: dict[str, set[str]]) -> dict[str, set[str]]:
        """Sets of columns (or sources) carried downstream: each node with the union of what its ancestors are marked with."""
        out: dict[str, set[str]] = {}
        for node, columns in marked.items():
            for n in self.depths([node]):
                out.setdefault(n, set()).update(columns)
        return out

    def ordered(self, nodes=None) -> list[str]:
        """Parents before children; by name where free. A cycle raises."""
        todo = set(self.children) if nodes is None else set(nodes)
        left = {n: sum(p in todo for p in self.parents.get(n, ())) for n in todo}
        ready, out = sorted(n for n, k in left.items() if not k), []
        while ready:
            n = ready.pop(0)
            out.append(n)
            for c in self.children.get(n, ()):
                if c in left:
                    left[c] -= 1
                    if not left[c]:
                        ready = sorted([*ready, c])
        if len(out) < len(todo):
            raise ValueError(f"the models form a cycle: {', '.join(sorted(todo - set(out)))}")
        return out

    def comparable(self, changed, built: set[str], snapshots: set[str] = frozenset()) -> list[str]:
        """Models to compare: changed or downstream, built, and not behind a snapshot that both branches share."""
        behind = set(self.depths(snapshots))
        return sorted(n for n in self.depths(changed) if n in built and n not in behind)


#: Levels of up to this many nodes are held on the driver as they are found; larger ones are checkpoints.
ON_DRIVER = 10_000


def reachable(edges: DataFrame, seeds: list[str] | DataFrame, up: bool = False) -> DataFrame:
    """node, depth over an edge table (parent, child) of any size: breadth first, one join a level, from names or a table
    with a column node. planproof.graph.onDriver=false makes every level a checkpoint."""
    a, b = ("child", "parent") if up else ("parent", "child")
    step = edges.select(F.col(a).alias("at"), F.col(b).alias("node")).distinct()
    spark = edges.sparkSession
    most = ON_DRIVER if spark.conf.get("planproof.graph.onDriver", "true") == "true" else 0
    seen = seeds.select("node", F.lit(0).alias("depth")) if isinstance(seeds, DataFrame) else spark.createDataFrame([(s, 0) for s in seeds], "node string, depth int")
    front = seen
    while True:
        nxt = front.select(F.col("node").alias("at"), (F.col("depth") + 1).alias("depth")).join(step, "at").select("node", "depth").distinct()
        nxt = nxt.join(seen.select("node"), "node", "left_anti")
        rows = nxt.limit(most + 1).collect() if most else None
        if rows is None or len(rows) > most:
            nxt = nxt.checkpoint()
            if nxt.isEmpty():
                return seen
        else:
            nxt = spark.createDataFrame(rows, "node string, depth int")
            if not rows:
                return seen
        seen, front = seen.unionByName(nxt), nxt


def affected(edges: DataFrame, modified: list[str]) -> DataFrame:
    return reachable(edges, reachable(edges, modified), up=True).select("node")


def changed_ancestors(edges: DataFrame, node: str, changed: list[str]) -> DataFrame:
    return reachable(edges, [node], up=True).where(F.col("node").isin(changed) & (F.col("depth") > 0)).orderBy("depth", "node").select("node", "depth")
