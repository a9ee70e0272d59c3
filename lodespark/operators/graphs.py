"""Graph operators on edges (src, dst)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lineage, sizes


def mutual(edges: DataFrame) -> DataFrame:
    """(a, b) with a before b, of nodes that have an edge each way."""
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["src", "dst"], "left_semi").filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def inverse(edges: DataFrame) -> DataFrame:
    """(node, referenced_by, references): how many distinct others point to a node, and whither it points."""
    n = sizes.partitions(edges)
    e = edges.filter("src <> dst").select("src", "dst").repartition(n, "src").distinct()
    inward = e.select(F.col("dst").alias("node"), F.col("src").cast("string").alias("source")).repartition(n, "node")
    to = inward.groupBy("node").agg(F.count("*").alias("referenced_by"), F.array_join(F.sort_array(F.collect_list("source")), ",").alias("sources"))
    frm = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("references"))
    return to.join(frm.hint("merge"), "node", "full").select("node", F.coalesce("referenced_by", F.lit(0)).alias("referenced_by"), F.coalesce("references", F.lit(0)).alias("references"), F.coalesce("sources", F.lit("")).alias("sources"))


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) for every path of edges, by squaring: each round doubles the length of the paths, so rounds grow as the logarithm of the longest."""
    pairs = lineage.cut(edges.select("src", "dst").distinct())
    n = pairs.count()
    while True:
        x, y = pairs.alias("x"), pairs.alias("y")
        longer = x.join(y, F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("src"), F.col("y.dst").alias("dst"))
        pairs = lineage.cut(pairs.union(longer).distinct())
        before, n = n, pairs.count()
        if n == before:
            return pairs


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node, reachable): nodes that reach themselves, and how many nodes they reach."""
    reach = closure(edges).groupBy("src").agg(F.count("*").alias("reachable"), F.bool_or(F.col("src") == F.col("dst")).alias("back"))
    return reach.filter("back").select(F.col("src").alias("node"), "reachable")


def back_edges(groups: DataFrame) -> DataFrame:
    """(group, ord, cycle) of rows (group, ord, node, targets): the cycles that a depth-first walk closes, nodes and targets in order; edges to nodes outside the group don't count."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        graph = {r.node: list(dict.fromkeys(r.targets)) for r in pdf.sort_values("ord").itertuples() if r.node}
        done: set[str] = set()
        cycles: dict[str, None] = {}
        for root in graph:
            if root in done:
                continue
            done.add(root)
            path, place, todo = [root], {root: 0}, [iter(graph[root])]
            while todo:
                for to in todo[-1]:
                    if to not in graph:
                        continue
                    if to in place:
                        cycles[" -> ".join([*path[place[to] :], to])] = None
                    elif to not in done:
                        done.add(to)
                        place[to] = len(path)
                        path.append(to)
                        todo.append(iter(graph[to]))
                        break
                else:
                    todo.pop()
                    del place[path.pop()]
        return pd.DataFrame({"group": [pdf["group"].iloc[0]] * len(cycles), "ord": range(len(cycles)), "cycle": list(cycles)}).astype({"ord": "int64"})

    return groups.groupBy("group").applyInPandas(walk, "group string, ord long, cycle string")


def resolved(references: DataFrame, types: DataFrame) -> DataFrame:
    """references (name, package) with resolved: the only type of that simple name, else the one in the same package, else null. types: (fqn, simple, package)."""
    known = types.select("fqn", "simple", "package").distinct()
    unique = known.groupBy("simple").agg(F.min("fqn").alias("only"), F.count("*").alias("n"))
    near = known.groupBy(F.col("simple").alias("s"), F.col("package").alias("p")).agg(F.min("fqn").alias("near"))
    rows = references.join(unique, references["name"] == unique["simple"], "left").join(near, (F.col("name") == F.col("s")) & (references["package"] == F.col("p")), "left")
    return rows.select(*[references[c] for c in references.columns], F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("near")).alias("resolved"))
