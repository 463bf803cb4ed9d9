"""Graph operators on an edge table (src, dst); each is a function from tables to tables.

Loops run once per level or per doubling, cut their lineage by a table in the shared folder and look at one count per
round. Nothing grows on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.sources.shared import Rounds, cut

LOCAL_EDGES = 1_000_000  # edges that one task solves by itself; beyond them, rounds of joins shrink the graph first


def _solved(edges: DataFrame, solve: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(id, component) of a graph of at most LOCAL_EDGES edges (src, dst), in one task."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        whole = pd.concat(parts) if parts else pd.DataFrame({"src": [], "dst": []}, dtype=np.int64)
        ids, component = solve(whole["src"].to_numpy(np.int64), whole["dst"].to_numpy(np.int64))
        yield pd.DataFrame({"id": ids, "component": component})

    return edges.select("src", "dst").coalesce(1).mapInPandas(run, f"id {kind}, component {kind}")


def _local_strong(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of two and more nodes, by one depth-first walk that keeps its own stack."""
    ids, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = flat[: len(src)], flat[len(src) :]
    order = np.argsort(a, kind="stable")
    first, ends = np.searchsorted(a[order], np.arange(len(ids))).tolist(), np.searchsorted(a[order], np.arange(len(ids)), "right").tolist()
    onward = b[order].tolist()
    n = len(ids)
    number, low, at, member = [0] * n, [0] * n, list(first), [-1] * n
    on_stack, stack, counter = [False] * n, [], 0
    for root in range(n):
        if number[root]:
            continue
        path = [root]
        while path:
            v = path[-1]
            if not number[v]:
                counter += 1
                number[v] = low[v] = counter
                stack.append(v)
                on_stack[v] = True
            if at[v] < ends[v]:
                w = onward[at[v]]
                at[v] += 1
                if not number[w]:
                    path.append(w)
                elif on_stack[w]:
                    low[v] = min(low[v], number[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == number[v]:
                found = []
                while True:
                    w = stack.pop()
                    on_stack[w] = False
                    found.append(w)
                    if w == v:
                        break
                if len(found) > 1:
                    name = max(found)  # places keep the order of ids
                    for w in found:
                        member[w] = name
    member = np.array(member, np.int64)
    kept = member >= 0
    return ids[kept], ids[member[kept]]


def _local_components(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node with the least id of its undirected component, by minima over edges and jumps."""
    ids, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = flat[: len(src)], flat[len(src) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = np.minimum(new, new[label])
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def dependents(edges: DataFrame) -> DataFrame:
    """(dst, src): who depends on what, each pair once."""
    return edges.where("dst IS NOT NULL").select("dst", "src").distinct()


def hotspots(edges: DataFrame, least: int = 2) -> DataFrame:
    """(dst, imports, importers): import rows and distinct importers of the files with at least ``least`` rows."""
    return edges.where("dst IS NOT NULL").groupBy("dst").agg(F.count(F.lit(1)).alias("imports"), F.count_distinct("src").alias("importers")).where(F.col("imports") >= least)


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, labels: tuple[str, ...] = ()) -> DataFrame:
    """(*labels, id, depth): the least number of steps from the seeds (*labels, id) to what they reach, seeds at 0."""
    steps = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    keys = [*labels, "id"]
    frontier = cut(seeds.select(*keys).distinct().withColumn("depth", F.lit(0)), "reach")
    seen, depth = frontier, 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        onward = frontier.join(steps, F.col("id") == F.col("src")).select(*labels, F.col("dst").alias("id")).distinct()
        frontier = cut(onward.join(seen.select(*keys), keys, "left_anti").withColumn("depth", F.lit(depth)), "reach")
        seen = seen.unionByName(frontier)
    return seen


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of an undirected graph, isolated nodes included; a component is named by its least id.

    Each round, every node takes the least label among its neighbours and then the label of its label, so paths halve.
    """
    pairs = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    pairs = cut(pairs, "components")
    if pairs.count() <= LOCAL_EDGES:
        linked = _solved(pairs, _local_components)
        return linked.unionByName(nodes.select("id").distinct().join(linked, "id", "left_anti").withColumn("component", F.col("id")))
    pairs = cut(pairs.union(pairs.select("dst", "src")), "components")
    ids = nodes.select("id").union(pairs.select("src")).distinct()
    rounds = Rounds("components")
    labels = rounds.cut(ids.select("id", F.col("id").alias("label")))
    while True:
        best = pairs.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("_n"))
        least = labels.join(best, "id", "left").select("id", F.col("label").alias("_old"), F.least("label", F.coalesce("_n", "label")).alias("label"))
        # what a node's label hears is also heard by the node that gave the label its name
        hooks = least.groupBy(F.col("_old").alias("id")).agg(F.min("label").alias("_h"))
        hooked = least.join(hooks, "id", "left").select("id", "_old", F.least("label", F.coalesce("_h", "label")).alias("label"))
        jump = hooked.select(F.col("id").alias("label"), F.col("label").alias("_up"))
        now = rounds.cut(hooked.join(jump, "label", "left").select("id", "_old", F.least("label", F.coalesce("_up", "label")).alias("label")))
        changed = now.where("label <> _old").isEmpty()
        labels = now.select("id", "label")
        if changed:
            return labels.withColumnRenamed("label", "component")


def islands_page(labels: DataFrame, least: int = 2, most: int | None = None, offset: int = 0, limit: int = 200, ascending: bool = False) -> DataFrame:
    """(component, files, rank): a page of the components of ``least`` to ``most`` nodes, the largest first or last.

    Without ``most``, it is half of all nodes, at most 500. Ranks count from 1 over all that pass.
    """
    if most is None:
        most = min(500, max(least, labels.count() // 2))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("files")).where((F.col("files") >= least) & (F.col("files") <= most))
    order = [F.asc("files") if ascending else F.desc("files"), F.asc("component")]
    page = sizes.orderBy(*order).offset(offset).limit(limit)
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*order)) + offset)  # of one page


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes on directed cycles; a component is named by its greatest id.

    Nodes without a way in or out are trimmed away; then the greatest id that reaches a node colours it, and what the
    node of a colour is reached from within the colour is one component. Both repeat on what is left.
    """
    left = cut(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), "scc")
    loops = left.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("component"))
    left = cut(left.where("src <> dst"), "scc")
    found = None
    n = left.count()
    while n:
        if n <= LOCAL_EDGES:
            rest = _solved(left, _local_strong).select("id", F.col("component").alias("colour"))
            found = rest if found is None else found.unionByName(rest)
            break
        while True:  # trim
            kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            kept = cut(kept.join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "scc")
            m = kept.count()
            left = kept
            if m == n:
                break
            n = m
        if not n:
            break
        colour = cut(left.select(F.col("src").alias("id")).union(left.select("dst")).distinct().withColumn("colour", F.col("id")), "scc")
        while True:
            heard = left.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("_c"))
            new = cut(colour.join(heard, "id", "left").select("id", F.greatest("colour", F.coalesce("_c", "colour")).alias("colour"), F.col("colour").alias("_old")), "scc")
            done = new.where("colour <> _old").isEmpty()
            colour = new.drop("_old")
            if done:
                break
        coloured = left.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("_a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("_b")), "dst").where("_a = _b")
        back = cut(coloured.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("_a").alias("colour")), "scc")
        members = frontier = cut(colour.where("id = colour"), "scc")
        while not frontier.isEmpty():
            onward = frontier.join(back, (frontier["id"] == back["src"]) & (frontier["colour"] == back["colour"])).select(back["dst"].alias("id"), back["colour"].alias("colour")).distinct()
            frontier = cut(onward.join(members, ["id", "colour"], "left_anti"), "scc")
            members = members.unionByName(frontier)
        members = cut(members, "scc")
        found = members if found is None else found.unionByName(members)
        left = cut(left.join(members.select(F.col("id").alias("src")), "src", "left_anti").join(members.select(F.col("id").alias("dst")), "dst", "left_anti"), "scc")
        n = left.count()
    if found is None:
        return loops
    sizes = found.groupBy("colour").count().where("count > 1")
    out = found.join(sizes, "colour", "left_semi").select("id", F.col("colour").alias("component"))
    return out.unionByName(loops.join(out.select("id"), "id", "left_anti"))


def entry_point(path: Column) -> Column:
    """Whether nothing needs to import a file: fixed names, test folders and test names."""
    name = F.element_at(F.split(path, "/"), -1)
    # Fixed values.
    return path.isin("src/lib.rs", "src/main.rs", "build.rs", "lib.rs", "main.rs") | path.rlike(r"^(tests|benches|examples)/") | name.startswith("test_") | name.endswith("_test.rs") | name.endswith("_spec.rs")


def entry_kind(path: Column) -> Column:
    """Kind of an entry point by its file name, the first rule that holds; NULL for other files."""
    name = F.element_at(F.split(path, "/"), -1)
    stem, depth = F.regexp_replace(name, r"\.[^.]*$", ""), F.size(F.split(path, "/"))
    # Fixed values.
    return (
        F.when(name.rlike(r"^main\.(rs|go|py|c|cpp|zig)$|^cli\.(rs|ts|py|js)$"), "cli")
        .when(name.rlike(r"^(server|app)\.(rs|ts|js|py|go)$|^routes\.(rs|ts|js|py)$"), "http")
        .when(name.isin("lib.rs", "index.ts", "index.js", "mod.rs", "__init__.py") & (depth <= 2), "library")
        .when(path.rlike(r"(^|/)(scripts|bin)/"), "script")
        .when(stem.rlike(r"^(conftest|jest\.config|vitest\.config|test_main)$"), "test_runner")
    )


def unused(nodes: DataFrame, edges: DataFrame, exports: DataFrame) -> DataFrame:
    """(id, path) of files that nothing imports, directly or through re-exports (src, dst), and that are no entry points."""
    imported = edges.where("dst IS NOT NULL").select(F.col("dst").alias("id")).distinct()
    alive = reach(exports, imported).select("id")
    return nodes.join(alive, "id", "left_anti").where(~entry_point(F.col("path"))).select("id", "path")
