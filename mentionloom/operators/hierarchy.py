"""Parent-child rows of unknown depth to full hierarchies.

``live_edges`` brings the rows to one live term each with the parents that count. ``hierarchy`` then works in three steps:

1. contract: terms are laid out in blocks of neighbouring ids; within a block every chain of single parents is followed
   to its exit - a root, a term with several parents, a term whose parent lies in another block, or the smallest term of a
   loop - so that only exits remain as nodes of the quotient graph, each edge carrying the chain it stands for;
2. solve the quotient recursively: it is laid out anew, a term beside its parent by the throw of a coin, and contracted
   again, which takes away at least a quarter of the single-parent terms that are left, so that levels are logarithmic;
   when it fits one block (``SOLVE_ROWS``) that block gives shortest, smallest paths and what hangs below each exit;
3. expand: fragments of all levels are put together; paths of exits are prefixed to the chains of their fragments; a term's
   descendants are those of its own fragment plus the fragments that hang below it; it is on a loop, local or global, if
   its own exit hangs below it.

Terms with several parents are never contracted. If more of them are left than fit one block, the quotient is solved by
relaxation from the roots and by joins of new ancestor pairs alone, in rounds that follow its depth.

Defined cases: null and blank ids give no rows; of several rows of one id the latest holds (ties: the greatest row); blank
and null parents, unknown ids and replacement loops don't count; a term that is its own parent is on a cycle; a term with
no way from a root has an empty root and path and depth -1; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionloom.session import cut

BLOCK_ROWS = 20_000
#: the quotient is solved in one block up to so many exits
SOLVE_ROWS = 50_000
#: a level that leaves more than this share of its nodes is the last
LEAST_SHRINK = 0.97
_EDGES = "array<struct<id:string,steps:int,label:string>>"


def tidy_id(c: Column) -> Column:
    """An id without remark, white space and spelling variants: ``\xa0hp_12 ! name`` is ``HP:12``."""
    bare = F.upper(F.regexp_replace(F.regexp_replace(c, "(?s)!.*$", ""), r"(?U)^\s+|\s+$", ""))
    bare = F.regexp_replace(bare, r"^HP[_:]\s*", "HP:")
    return F.when(bare != "", bare)


def latest_terms(terms: DataFrame) -> DataFrame:
    """One row per identifier: identifier, parents, dead, successor."""
    row = F.struct("loaded_at", F.coalesce("obsolete", F.lit(False)).alias("dead"), "replaced_by", "parents")
    named = terms.filter(F.trim("identifier") != "")
    best = named.groupBy("identifier").agg(F.max(row).alias("r"))
    return best.select("identifier", F.col("r.parents").alias("parents"), F.col("r.dead").alias("dead"), tidy_id(F.col("r.replaced_by")).alias("successor"))


def live_successors(latest: DataFrame) -> DataFrame:
    """(dead, alive): the term at the end of each obsolete term's replacement chain, if it is live. Pointers are doubled until none resolves any more."""
    dead = latest.filter("dead").select(F.col("identifier").alias("dead_id"), "successor")
    status = latest.select(F.col("identifier").alias("successor"), F.col("dead").alias("next_dead"))
    chain = cut(dead.join(status, "successor").select("dead_id", "successor", "next_dead"))
    open_before = None
    while True:
        left = chain.filter("next_dead").count()
        if left == 0 or left == open_before:
            break
        open_before = left
        hop = chain.select(F.col("dead_id").alias("successor"), F.col("successor").alias("hop"), F.col("next_dead").alias("hop_dead"))
        joined = chain.join(hop, "successor", "left")
        # a pointer to a dead term that leads nowhere goes with it
        chain = cut(joined.filter(~F.col("next_dead") | F.col("hop").isNotNull()).select("dead_id", F.when(F.col("next_dead"), F.col("hop")).otherwise(F.col("successor")).alias("successor"), F.when(F.col("next_dead"), F.col("hop_dead")).otherwise(F.lit(False)).alias("next_dead")))
    return chain.filter(~F.col("next_dead")).select(F.col("dead_id").alias("dead"), F.col("successor").alias("alive"))


def live_edges(terms: DataFrame) -> DataFrame:
    """(identifier, parents): every live term with the sorted live terms that its parent entries stand for."""
    latest = cut(latest_terms(terms))
    alive = latest.filter(~F.col("dead"))
    entries = alive.select("identifier", F.explode_outer("parents").alias("p")).select("identifier", tidy_id(F.col("p")).alias("p"))
    stands_for = alive.select(F.col("identifier").alias("p"), F.col("identifier").alias("parent")).unionByName(live_successors(latest).select(F.col("dead").alias("p"), F.col("alive").alias("parent")))
    return entries.join(stands_for, "p", "left").groupBy("identifier").agg(F.sort_array(F.collect_set("parent")).alias("parents"))


def _contract(batches):
    """One block: every node's exit, the steps and the chain to it; exits keep the edges to their parents."""
    parts = list(batches)
    if not parts:
        return
    above = {i: list(ps) for p in parts for i, ps in zip(p["node"], p["parents"], strict=True)}
    up = {i: ps[0] for i, ps in above.items() if len(ps) == 1 and ps[0]["id"] in above and ps[0]["id"] != i}
    at: dict[str, tuple[str, int, str]] = {}
    for i in above:
        while i not in at:
            trail, seen, x = [], set(), i
            while x not in at and x in up and x not in seen:
                seen.add(x)
                trail.append(x)
                x = up[x]["id"]
            if x in seen:  # a loop inside the block: its smallest node becomes an exit
                x = min(trail[trail.index(x) :])
                del up[x]
                at[x] = (x, 0, "")
                continue
            e, d, c = at.setdefault(x, (x, 0, ""))
            for s in reversed(trail):
                d, c = d + up[s]["steps"], f"{c}{up[s]['label']}>{s}"
                at[s] = (e, d, c)
    ids = list(above)
    yield pd.DataFrame({"node": ids, "exit": [at[i][0] for i in ids], "steps": [at[i][1] for i in ids], "chain": [at[i][2] for i in ids], "parents": [above[i] if at[i][0] == i else [] for i in ids]})


def contract(laid: DataFrame) -> DataFrame:
    """(node, exit, steps, chain, parents): the fragments of the partitions of ``laid`` (node, parents)."""
    return laid.select("node", "parents").mapInPandas(_contract, f"node string, exit string, steps int, chain string, parents {_EDGES}")


def _quotient(fragments: DataFrame) -> DataFrame:
    """(node, parents) of the exits, each edge leading to the exit of the fragment that holds the parent, with the chain on the way."""
    links = fragments.filter("exit = node").select("node", F.explode_outer("parents").alias("p"))
    member = fragments.select(F.col("node").alias("_id"), "exit", F.col("steps").alias("_steps"), "chain")
    led = links.join(member, F.col("p.id") == F.col("_id"), "left")
    edge = F.when(F.col("exit").isNotNull(), F.struct(F.col("exit").alias("id"), (F.col("_steps") + F.col("p.steps")).alias("steps"), F.concat("chain", "p.label").alias("label")))
    return led.groupBy("node").agg(F.collect_list(edge).alias("parents"))


def _levels(edges: DataFrame, block_rows: int, solve_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """Fragments (node, exit, steps, chain) over all levels of contraction, the last quotient (node, parents) and its size."""
    n = edges.count()
    none = F.transform("parents", lambda p: F.struct(p.alias("id"), F.lit(1).alias("steps"), F.lit("").alias("label")))
    graph = edges.select(F.col("identifier").alias("node"), none.alias("parents"))
    laid = graph.repartitionByRange(max(1, math.ceil(n / block_rows)), "node")
    levels = []
    while True:
        fragments = cut(contract(laid))
        levels.append(fragments.select("node", "exit", "steps", "chain"))
        graph = cut(_quotient(fragments))
        left = graph.count()
        if left <= solve_rows or len(levels) > 1 and left > LEAST_SHRINK * n:
            break
        n = left
        # a single-parent node whose coin shows tails goes where its parent is kept, if the parent's shows heads
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(len(levels))), F.lit(2))
        parent = F.when(F.size("parents") == 1, F.col("parents")[0]["id"])
        home = F.when((coin(F.col("node")) == 0) & (coin(parent) == 1), parent).otherwise(F.col("node"))
        laid = graph.withColumn("home", home).repartition(max(1, math.ceil(n / block_rows)), "home")
    whole = levels[-1]
    for lower in reversed(levels[:-1]):
        upper = whole.select(F.col("node").alias("exit"), F.col("exit").alias("_exit"), F.col("steps").alias("_steps"), F.col("chain").alias("_chain"))
        whole = lower.join(upper, "exit").select("node", F.col("_exit").alias("exit"), (F.col("steps") + F.col("_steps")).alias("steps"), F.concat("_chain", "chain").alias("chain"))
    return whole, graph, left


def _solve(batches):
    """One block that holds the whole quotient: (exit, depth, path, below) by Dijkstra over (steps, path), and what hangs below by uniting from the leaves of the condensation."""
    parts = list(batches)
    if not parts:
        return
    above = {i: list(ps) for p in parts for i, ps in zip(p["node"], p["parents"], strict=True)}
    below: dict[str, list] = {i: [] for i in above}
    for i, ps in above.items():
        for p in ps:
            below[p["id"]].append((i, p["steps"], p["label"]))
    best: dict[str, tuple[int, str]] = {}
    heap = [(0, f"{i}>", i) for i, ps in above.items() if not ps]
    heapq.heapify(heap)
    while heap:
        d, path, i = heapq.heappop(heap)
        if i not in best:
            best[i] = (d, path)
            for c, steps, label in below[i]:
                if c not in best:
                    heapq.heappush(heap, (d + steps, f"{path}{label[1:]}>{c}>" if label else f"{path}{c}>", c))
    number = {i: k for k, i in enumerate(above)}
    names = np.array(list(above), dtype=object)
    reach: dict[str, np.ndarray] = {}
    for group in _components({i: [c for c, _, _ in cs] for i, cs in below.items()}):
        own = set(group)
        loops = len(group) > 1 or any(c == group[0] for c, _, _ in below[group[0]])
        sets = [np.array([number[c] for i in group for c, _, _ in below[i]], np.int64), *(reach[c] for c in {c for i in group for c, _, _ in below[i]} - own)]
        met = np.unique(np.concatenate(sets))
        if not loops:
            met = met[met != number[group[0]]]
        for i in group:
            reach[i] = met
    ids = list(above)
    yield pd.DataFrame({"exit": ids, "depth": [best.get(i, (None, None))[0] for i in ids], "path": [best.get(i, (None, None))[1] for i in ids], "below": [names[reach[i]] for i in ids]}).astype({"depth": "Int32"})


def _components(below: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected components, those below first."""
    order, low, stack, on, out = {}, {}, [], set(), []
    for root in below:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack.append(root)
        on.add(root)
        work = [(root, iter(below[root]))]
        while work:
            i, rest = work[-1]
            for c in rest:
                if c not in order:
                    order[c] = low[c] = len(order)
                    stack.append(c)
                    on.add(c)
                    work.append((c, iter(below[c])))
                    break
                if c in on:
                    low[i] = min(low[i], order[c])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[i])
                if low[i] == order[i]:
                    group = []
                    while not group or group[-1] != i:
                        group.append(stack.pop())
                        on.discard(group[-1])
                    out.append(group)
    return out


def _hops(graph: DataFrame) -> DataFrame:
    label = F.when(F.col("p.label") == "", "").otherwise(F.concat(F.substring("p.label", 2, 1 << 30), F.lit(">")))
    return graph.select(F.col("node").alias("to_exit"), F.explode("parents").alias("p")).select("to_exit", F.col("p.id").alias("from_exit"), F.col("p.steps").alias("weight"), label.alias("label"))


def _shortest(graph: DataFrame, hops: DataFrame) -> DataFrame:
    """(exit, depth, path) of every exit that a root leads to; path ends in '>' so that text order is path order."""
    best = cut(graph.filter(F.size("parents") == 0).select(F.col("node").alias("exit"), F.lit(0).alias("depth"), F.concat("node", F.lit(">")).alias("path")))
    fresh = best
    while not fresh.isEmpty():
        reached = hops.join(fresh.withColumnRenamed("exit", "from_exit"), "from_exit").select(F.col("to_exit").alias("exit"), (F.col("depth") + F.col("weight")).alias("depth"), F.concat("path", "label", "to_exit", F.lit(">")).alias("path"))
        step = reached.groupBy("exit").agg(F.min(F.struct("depth", "path")).alias("new"))
        both = cut(step.join(best, "exit", "full").select("exit", "depth", "path", "new", (F.col("new").isNotNull() & (F.col("path").isNull() | (F.col("new") < F.struct("depth", "path")))).alias("better")))
        fresh = both.filter("better").select("exit", "new.depth", "new.path")
        best = both.select("exit", F.when(F.col("better"), F.col("new.depth")).otherwise(F.col("depth")).alias("depth"), F.when(F.col("better"), F.col("new.path")).otherwise(F.col("path")).alias("path"))
    return best


def _closure(hops: DataFrame) -> DataFrame:
    """(from_exit, to_exit): every exit with all exits below it; each round extends the new pairs alone by one edge."""
    edges = cut(hops.select("from_exit", "to_exit").distinct())
    reach = fresh = edges
    on = edges.select(F.col("from_exit").alias("to_exit"), F.col("to_exit").alias("far"))
    while True:
        more = fresh.join(on, "to_exit").select("from_exit", F.col("far").alias("to_exit")).distinct()
        fresh = cut(more.join(reach, ["from_exit", "to_exit"], "left_anti"))
        if fresh.isEmpty():
            return reach
        reach = cut(reach.unionByName(fresh))


def hierarchy(edges: DataFrame, block_rows: int = BLOCK_ROWS, solve_rows: int = SOLVE_ROWS) -> DataFrame:
    """(identifier, root, depth, path, n_descendants, on_cycle) of every term of ``edges`` (identifier, parents)."""
    fragments, graph, size = _levels(edges, block_rows, solve_rows)
    fragments = cut(fragments.withColumnRenamed("node", "identifier"))
    if size <= solve_rows:
        solved = cut(graph.repartition(1).mapInPandas(_solve, "exit string, depth int, path string, below array<string>"))
        best = solved.filter("path IS NOT NULL").select("exit", "depth", "path")
        reach = solved.select(F.col("exit").alias("from_exit"), F.explode("below").alias("to_exit"))
    else:
        hops = cut(_hops(graph))
        best, reach = _shortest(graph, hops), _closure(hops)

    # of every term of a fragment the terms in it over or at it, from the exit on
    on_chain = lambda exit_, chain: F.concat(F.array(exit_), F.filter(F.split(chain, ">"), lambda x: x != ""))
    below = fragments.select(F.explode(on_chain("exit", "chain")).alias("identifier")).groupBy("identifier").agg(F.count("*").alias("below"))
    # terms with exits hanging below them: the parent of the exit and everything over it in its chain
    sizes = cut(fragments.groupBy("exit").agg(F.count("*").alias("size")))
    direct = graph.select(F.col("node").alias("exit"), F.explode("parents").alias("p")).select("exit", F.col("p.id").alias("own"), F.explode(on_chain("p.id", "p.label")).alias("identifier"))
    under = reach.unionByName(graph.select(F.col("node").alias("from_exit"), F.col("node").alias("to_exit"))).join(sizes.withColumnRenamed("exit", "to_exit"), "to_exit")
    hanging = direct.join(under.withColumnRenamed("from_exit", "exit"), "exit").select("identifier", "own", "to_exit", "size").distinct()
    hanging = hanging.groupBy("identifier").agg(F.sum(F.when(F.col("to_exit") != F.col("own"), F.col("size")).otherwise(0)).alias("others"), F.max((F.col("to_exit") == F.col("own")).cast("int")).alias("looped"))

    rows = fragments.join(below, "identifier").join(hanging, "identifier", "left").join(sizes.join(best.withColumnRenamed("depth", "_depth"), "exit", "left"), "exit")
    looped = F.coalesce("looped", F.lit(0))
    path = F.concat(F.expr("substring(path, 1, length(path) - 1)"), "chain")
    return rows.select(
        "identifier",
        F.coalesce(F.split("path", ">")[0], F.lit("")).alias("root"),
        F.coalesce(F.col("_depth") + F.col("steps"), F.lit(-1)).cast("int").alias("depth"),
        F.coalesce(path, F.lit("")).alias("path"),
        (F.when(looped == 1, F.col("size")).otherwise(F.col("below")) - 1 + F.coalesce("others", F.lit(0))).cast("bigint").alias("n_descendants"),
        looped.cast("int").alias("on_cycle"),
    )


def term_hierarchy(terms: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return hierarchy(cut(live_edges(terms)), block_rows)
