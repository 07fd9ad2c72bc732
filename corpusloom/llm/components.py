"""Connected components of a link table, by hooking onto the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, release


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Of undirected links (a, b): one row (node, root) for each node, root the smallest node reachable.

    Each round contracts the graph: every node hooks onto the smallest node next to it if that is smaller, chains of
    hooks are halved by pointer jumping until they are stars, and links inside a star go. A node that neither hooks nor
    gains another in a round has a smaller neighbour in the next, so two rounds at least halve the nodes that still
    have links. All state stays in tables of the shared folder, those of past rounds are deleted; minima are
    pre-aggregated before their shuffle, so a hub with a third of all links costs one row a task.
    Links with a null end, and self-links, count as none. Empty input gives an empty table.
    """
    edges = (
        links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    edges = materialise(edges, "cc-links")
    parents: list[DataFrame] = []
    for _ in range(max_rounds):
        both = edges.select(F.col("v").alias("node"), F.col("u").alias("to")).union(edges.select(F.col("u").alias("node"), F.col("v").alias("to")))
        hooks = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("parent"))
        hooks = materialise(hooks, "cc-hooks")
        while True:
            up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            jumped = hooks.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), (F.coalesce("above", "parent") != F.col("parent")).alias("moved"))
            jumped = materialise(jumped, "cc-jump")
            release(hooks)
            settled = jumped.where("moved").isEmpty()
            hooks = jumped.select("node", "parent")
            hooks._written_at = jumped._written_at
            if settled:
                break
        parents.append(hooks)
        to = lambda end: hooks.select(F.col("node").alias(end), F.col("parent").alias(f"{end}_root"))
        rest = (
            edges.join(to("u"), "u").join(to("v"), "v").where("u_root <> v_root")
            .select(F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v")).distinct()
        )
        rest = materialise(rest, "cc-links")
        release(edges)
        edges = rest
        if edges.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    if len(parents) == 1:
        return parents[0].select("node", F.col("parent").alias("root"))
    found = parents[0].select("node", F.col("parent").alias("root"))
    for later in parents[1:]:
        found = found.join(later.select(F.col("node").alias("root"), "parent"), "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
    found = materialise(found, "cc-roots")
    release(*parents)
    return found
