"""Graph operators over internal import edges (analysis_id, source, target), for any number of repositories at once."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.tables import discard, numbered, written

LARGE_FILE_LINES = 400
TOP_CONNECTED = 400
#: A repository of at most so many import edges is searched in one task, a larger one by joins.
TASK_EDGES = 2_000_000
#: The fewest components worth a task; a repository's are dealt over SLICES tasks at most.
SLICES, SLICE_TARGETS = 16, 512
#: Components followed through the links at once, the bits that this may take, and the rows of a batch that a task gives out.
WAVE, WAVE_BITS, BATCH = 4096, 64 << 20, 1 << 16
#: Rows that travel as one list where all of them go with all of others.
BLOCK = 1024


def internal_edges(edges: DataFrame) -> DataFrame:
    """Import edges that end at a file of the repository, as (analysis_id, source, target)."""
    kept = edges.where("type = 'imports' AND target_path IS NOT NULL")
    return kept.select("analysis_id", F.col("source_path").alias("source"), F.col("target_path").alias("target"))


def fan_in_out(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(analysis_id, path, fan_in, fan_out) of every node; one aggregation over both ends of the edges."""
    ends = edges.select(
        "analysis_id",
        F.explode(F.array(F.struct(F.col("target").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"),
    )
    counts = ends.groupBy("analysis_id", F.col("e.path").alias("path")).agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int").alias(c)
    return nodes.select("analysis_id", "path").join(counts, ["analysis_id", "path"], "left").select("analysis_id", "path", zero("fan_in"), zero("fan_out"))


def ranked_fan(fan: DataFrame, top: int | None = None) -> DataFrame:
    """Most connected first; of each repository the ``top``, if given."""
    from pyspark.sql import Window

    total = F.desc(F.col("fan_in") + F.col("fan_out"))
    if top is not None:
        fan = fan.withColumn("__n", F.row_number().over(Window.partitionBy("analysis_id").orderBy(total, "path"))).where(F.col("__n") <= top).drop("__n")
    return fan.orderBy("analysis_id", total, "path")


def degrees(edges: DataFrame) -> DataFrame:
    """(analysis_id, path, degree): edge ends at each node."""
    ends = edges.select("analysis_id", F.explode(F.array("source", "target")).alias("path"))
    return ends.groupBy("analysis_id", "path").agg(F.count("*").cast("int").alias("degree"))


def top_connected(nodes: DataFrame, edges: DataFrame, cap: int = TOP_CONNECTED) -> DataFrame:
    """Of each repository the ``cap`` nodes of highest degree, ties by path: (analysis_id, path, degree)."""
    from pyspark.sql import Window

    known = nodes.select("analysis_id", "path").join(degrees(edges), ["analysis_id", "path"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    order = Window.partitionBy("analysis_id").orderBy(F.desc("degree"), "path")
    return known.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= cap).drop("__n")


def visible_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among the kept nodes."""
    names = kept.select("analysis_id", F.col("path").alias("source"))
    return edges.join(names, ["analysis_id", "source"], "left_semi").join(names.withColumnRenamed("source", "target"), ["analysis_id", "target"], "left_semi")


def isolated_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches, not even one to themselves."""
    ends = edges.select("analysis_id", F.explode(F.array("source", "target")).alias("path"))
    return nodes.select("analysis_id", "path").join(ends, ["analysis_id", "path"], "left_anti")


def large_files(files: DataFrame, threshold: int = LARGE_FILE_LINES) -> DataFrame:
    """Files of more than ``threshold`` lines, largest first."""
    return files.where(F.col("line_count") > threshold).select("analysis_id", "path", "line_count").orderBy("analysis_id", F.desc("line_count"), "path")


def _neighbours(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(at, to): the b of each a from 0 to n - 1 are to[at[a] : at[a + 1]], in order; 12 bytes an edge at most."""
    key = a.astype(np.int64) << 32
    key |= b.astype(np.int64)
    key.sort()
    at = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.bincount(a, minlength=n), out=at[1:])
    return at, (key & 0xFFFFFFFF).astype(np.int32)


def components(source: np.ndarray, target: np.ndarray, n: int) -> np.ndarray:
    """The strongly connected component of each of n nodes, as its smallest member; no recursion.

    Depth-first search forwards gives finishing order, search backwards in reverse order collects the components.
    """

    at, to = map(memoryview, _neighbours(source, target, n))
    seen, finished = bytearray(n), array("q")
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        path, nxt = array("q", [root]), array("q", [at[root]])
        while path:
            v, k = path[-1], nxt[-1]
            if k < at[v + 1]:
                nxt[-1] = k + 1
                w = to[k]
                if not seen[w]:
                    seen[w] = True
                    path.append(w)
                    nxt.append(at[w])
            else:
                finished.append(path.pop())
                nxt.pop()
    at, to = map(memoryview, _neighbours(target, source, n))
    label = np.full(n, -1, dtype=np.int64)
    told = memoryview(label)
    for root in reversed(finished):
        if told[root] >= 0:
            continue
        members, todo = array("q"), array("q", [root])
        told[root] = root
        while todo:
            v = todo.pop()
            members.append(v)
            for w in to[at[v] : at[v + 1]]:
                if told[w] < 0:
                    told[w] = root
                    todo.append(w)
        label[np.frombuffer(members, dtype=np.int64)] = min(members)
    return label


def fits_task(edges: DataFrame) -> bool:
    """Whether the edges of each repository fit a task."""
    return (edges.groupBy("analysis_id").count().agg(F.max("count")).first()[0] or 0) <= TASK_EDGES


def cycle_members(edges: DataFrame, *, method: str | None = None) -> DataFrame:
    """(analysis_id, cycle, path): files on import cycles; ``cycle`` is the smallest path of the component.

    A file that only imports itself is a cycle of one. ``grouped``: one task a repository; ``distributed``: repeated joins;
    by default the first, if the edges of each repository fit a task, else joins until what is left of them does.
    """
    if method == "distributed" or (method is None and not fits_task(edges)):
        return _distributed_cycles(edges, in_tasks=method is None)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(np.concatenate([part["source"].to_numpy(), part["target"].to_numpy()]).astype(str), return_inverse=True)
        s, t = codes[: len(part)], codes[len(part) :]
        label = components(s, t, len(names))
        on = (np.bincount(label, minlength=len(names)) > 1)[label]
        on[s[s == t]] = True
        return pd.DataFrame({"analysis_id": part["analysis_id"].iloc[0], "cycle": names[label[on]], "path": names[on]})

    return edges.distinct().groupBy("analysis_id").applyInPandas(run, "analysis_id string, cycle string, path string")


def _meets(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by shuffle only: a table that is joined in every round would pass the driver in every round if it were broadcast."""
    return a.join(b.hint("merge"), on, how)


def _doubled(chain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ends of chains by pointer doubling. chain: (analysis_id, node, left, right) of nodes with one edge in and one out.

    Gives (analysis_id, node, left, right) with the two nodes outside the chain that each node lies between, and (analysis_id,
    node, low) of the nodes that only form rings, with the ring's smallest. A round doubles the distance that each node sees, so
    a chain of n nodes takes log n rounds; once no more nodes see an end, those left see none: rings, whose smallest members
    are known when no node's changes.
    """
    key = ["analysis_id", "node"]
    now = written(chain.select(*key, "left", "right", F.col("node").alias("low"), F.lit(False).alias("changed")))
    inside = written(chain.select(*key))
    unfinished = None
    while True:
        ahead = now.select("analysis_id", F.col("node").alias("right"), F.col("right").alias("__right"), F.col("low").alias("__low"))
        behind = now.select("analysis_id", F.col("node").alias("left"), F.col("left").alias("__left"))
        low = F.least("low", F.coalesce("__low", "low"))
        nxt = written(
            _meets(_meets(now, ahead, ["analysis_id", "right"], "left"), behind, ["analysis_id", "left"], "left")
            .select(*key, F.coalesce("__left", "left").alias("left"), F.coalesce("__right", "right").alias("right"), low.alias("low"), (low != F.col("low")).alias("changed"))
        )
        discard(now)
        now = nxt
        open_ = _meets(now, inside.withColumnRenamed("node", "right"), ["analysis_id", "right"], "left_semi")
        n, changed = open_.agg(F.count("*"), F.coalesce(F.max("changed"), F.lit(False))).first()
        if not n or (n == unfinished and not changed):
            ends = _meets(now, inside.withColumnRenamed("node", "right"), ["analysis_id", "right"], "left_anti").select(*key, "left", "right")
            return ends, open_.select(*key, "low")
        unfinished = n


def contracted(edges: DataFrame, in_tasks: bool = False) -> tuple[DataFrame, list[tuple[str, DataFrame]]]:
    """(edges of the core, what went), for distinct edges without loops: what lies on no cycle is cut off, chains become single edges.

    Each round drops the nodes without an edge in or out, then replaces every chain of nodes with one edge in and one out by an edge
    between its ends, until neither changes anything: trees and chains of any depth are gone after a logarithmic number of
    rounds; ``in_tasks``: no further than until what is left fits a task. What went is, in order, ``ring`` (analysis_id, node, low): nodes of a cycle of their own; ``chain``
    (analysis_id, node, left, right): nodes that are on a cycle if and only if their ends are on the same one; ``loop``
    (analysis_id, node): ends of a chain that leads back to them.
    """
    went: list[tuple[str, DataFrame]] = []
    key = ["analysis_id", "node"]
    while True:
        if in_tasks and fits_task(edges):
            return edges, went
        end = lambda node, o, right, left: F.struct(F.col(node).alias("node"), F.lit(o).alias("o"), F.lit(1 - o).alias("i"), right.alias("r"), left.alias("l"))
        nothing = F.lit(None).cast("string")
        ends = edges.select("analysis_id", F.explode(F.array(end("source", 1, F.col("target"), nothing), end("target", 0, nothing, F.col("source")))).alias("e"))
        degree = written(ends.groupBy("analysis_id", F.col("e.node").alias("node")).agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"), F.max("e.l").alias("left"), F.max("e.r").alias("right")))
        dead = degree.where("i = 0 OR o = 0").select(*key)
        narrow = degree.where("i = 1 AND o = 1")
        chain = _meets(narrow, narrow.select("analysis_id", F.col("node").alias("right")), ["analysis_id", "right"], "left_semi").select(*key)
        n, n_dead = degree.agg(F.count("*"), F.coalesce(F.sum(((F.col("i") == 0) | (F.col("o") == 0)).cast("int")), F.lit(0))).first()
        n_chain = chain.count()
        if not n_dead and not n_chain:
            discard(degree)
            return edges, went
        if n_dead and 8 * n_chain < n:  # chains wait until there are some
            n_chain = 0
        without = lambda e, gone: _meets(_meets(e, gone.withColumnRenamed("node", "source"), ["analysis_id", "source"], "left_anti"), gone.withColumnRenamed("node", "target"), ["analysis_id", "target"], "left_anti")
        if n_chain:
            between, rings = _doubled(narrow.select(*key, "left", "right"))
            between, rings = written(between), written(rings)
            short = between.select("analysis_id", F.col("left").alias("source"), F.col("right").alias("target")).distinct()
            went += [("ring", rings), ("chain", between), ("loop", written(short.where("source = target").select("analysis_id", F.col("source").alias("node"))))]
            edges = without(edges, narrow.select(*key)).unionByName(short.where("source <> target").select("analysis_id", "source", "target")).distinct()
        edges = written(without(edges, dead))
        discard(degree)


def _coloured(open_: DataFrame, in_tasks: bool = False) -> DataFrame:
    """(analysis_id, node, label) of the nodes on cycles, by joins: colour forwards by the smallest name, collect backwards inside a colour, contract what is left.

    ``in_tasks``: a core that fits a task, once it is contracted, is searched in one.
    """
    key = ["analysis_id", "node"]
    open_, went = contracted(open_, in_tasks)
    found = open_.select("analysis_id", F.col("source").alias("node"), F.col("source").alias("label")).limit(0)
    if in_tasks and fits_task(open_):
        found = written(cycle_members(open_, method="grouped").select("analysis_id", F.col("path").alias("node"), F.col("cycle").alias("label")))
    elif not open_.isEmpty():
        nodes = open_.select("analysis_id", F.explode(F.array("source", "target")).alias("node")).distinct()
        colour = written(nodes.withColumn("colour", F.col("node")))
        while True:  # the smallest name that reaches each node
            near = _meets(open_, colour.withColumnRenamed("node", "source"), ["analysis_id", "source"]).select("analysis_id", F.col("target").alias("node"), "colour")
            nxt = written(colour.unionByName(near).groupBy(*key).agg(F.min("colour").alias("colour")))
            if _meets(nxt, colour, [*key, "colour"], "left_anti").isEmpty():
                break
            discard(colour)
            colour = nxt
        inside = written(
            _meets(
                _meets(open_, colour.select("analysis_id", F.col("node").alias("source"), F.col("colour").alias("a")), ["analysis_id", "source"]),
                colour.select("analysis_id", F.col("node").alias("target"), F.col("colour").alias("b")), ["analysis_id", "target"],
            )
            .where("a = b")
            .select("analysis_id", "source", "target", F.col("a").alias("colour"))
        )
        reached = written(colour.where("node = colour"))
        while True:  # backwards from each colour's root, inside the colour
            more = _meets(inside, reached.select("analysis_id", F.col("node").alias("target"), "colour"), ["analysis_id", "target", "colour"]).select("analysis_id", F.col("source").alias("node"), "colour")
            nxt = written(reached.unionByName(more).distinct())
            if nxt.count() == reached.count():
                break
            discard(reached)
            reached = nxt
        alone = reached.groupBy("analysis_id", "colour").agg(F.count("*").alias("n")).where("n > 1")
        found = _meets(reached, alone, ["analysis_id", "colour"]).select(*key, F.col("colour").alias("label"))
        done = reached.select(*key)
        rest = _meets(_meets(open_, done.withColumnRenamed("node", "source"), ["analysis_id", "source"], "left_anti"), done.withColumnRenamed("node", "target"), ["analysis_id", "target"], "left_anti")
        found = written(found.unionByName(_coloured(written(rest), in_tasks)))
    for what, table in reversed(went):  # what a contraction took out follows its ends
        if what == "loop":
            found = found.unionByName(_meets(table, found, key, "left_anti").withColumn("label", F.col("node")))
        elif what == "ring":
            found = written(found.unionByName(table.select(*key, F.col("low").alias("label"))))
        else:
            end = lambda side, name: found.select("analysis_id", F.col("node").alias(side), F.col("label").alias(name))  # noqa: B023, E731
            on = _meets(_meets(table, end("left", "label"), ["analysis_id", "left"]), end("right", "__other"), ["analysis_id", "right"]).where("label = __other")
            found = written(found.unionByName(on.select(*key, "label")))
    return found


def _distributed_cycles(edges: DataFrame, in_tasks: bool = False) -> DataFrame:
    """By joins only; a node that imports itself is a cycle of its own if it is on no other."""
    key = ["analysis_id", "path"]
    loops = edges.where("source = target").select("analysis_id", F.col("source").alias("path")).distinct()
    found = _coloured(written(edges.where("source <> target").distinct()), in_tasks).withColumnRenamed("node", "path")
    found = found.unionByName(_meets(loops, found, key, "left_anti").withColumn("label", F.col("path")))
    names = found.groupBy("analysis_id", "label").agg(F.min("path").alias("cycle"))
    return _meets(found, names, ["analysis_id", "label"]).select("analysis_id", "cycle", "path")


def cycles(members: DataFrame) -> DataFrame:
    """(analysis_id, members array): each cycle once, members sorted."""
    return members.groupBy("analysis_id", "cycle").agg(F.sort_array(F.collect_list("path")).alias("members")).select("analysis_id", "members")


def _apart(df: DataFrame) -> DataFrame:
    """The same rows under new column identities: one side of a cogroup whose sides stem from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def coded(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(analysis_id, path, node) of the files that edges touch, numbered in the order of their paths, and the different edges as
    (analysis_id, source, target) of such numbers, written: tasks hold eight bytes an edge and no paths."""
    ends = edges.select("analysis_id", F.explode(F.array("source", "target")).alias("path")).distinct()
    nodes = written(numbered(ends, "analysis_id", "path", name="node").select("analysis_id", "path", "node"))
    end = lambda side: nodes.select("analysis_id", F.col("path").alias(side), F.col("node").alias(f"__{side}"))
    pairs = edges.select("analysis_id", "source", "target").distinct().join(end("source"), ["analysis_id", "source"]).join(end("target"), ["analysis_id", "target"])
    return nodes, written(pairs.select("analysis_id", F.col("__source").alias("source"), F.col("__target").alias("target")))


def _read_pairs(batches: Iterator[pa.RecordBatch]) -> tuple[str, int, np.ndarray, np.ndarray]:
    """(analysis_id, first node, source, target) of a repository's coded edges, counted from its first node."""
    name, base, parts = None, 0, ([], [])
    for b in batches:
        if name is None:
            name, base = b.column("analysis_id")[0].as_py(), b.column("source")[0].as_py()
        for part, side in zip(parts, ("source", "target"), strict=True):
            part.append((b.column(side).to_numpy() - base).astype(np.int32))
    s, t = (np.concatenate(p) for p in parts)
    first = min(int(s.min()), int(t.min()))
    s -= first
    t -= first
    return name, base + first, s, t


def _batches(name: str, **columns: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Columns of a repository as batches, its analysis_id first; None is a column of nulls."""
    n = next(len(c) for c in columns.values() if c is not None)
    for lo in range(0, n, BATCH):
        m = min(BATCH, n - lo)
        arrays = [pa.nulls(m, pa.int64()) if c is None else pa.array(c[lo : lo + m], type=pa.int64()) for c in columns.values()]
        yield pa.RecordBatch.from_arrays([pa.array([name] * m, pa.string()), *arrays], names=["analysis_id", *columns])


#: Where a component stands to its repository's hub: nowhere, it leads to it, it comes after it, it is the hub.
APART, BEFORE, AFTER, HUB = range(4)


def _beyond(at: np.ndarray, to: np.ndarray, n: int, start: int) -> np.ndarray:
    """Which of n nodes edges lead to from ``start``, itself included."""
    at, to, seen, todo = memoryview(at), memoryview(to), bytearray(n), [start]
    seen[start] = True
    while todo:
        v = todo.pop()
        for w in to[at[v] : at[v + 1]]:
            if not seen[w]:
                seen[w] = True
                todo.append(w)
    return np.frombuffer(seen, dtype=np.uint8).astype(bool)


def _condense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, base, s, t = _read_pairs(batches)
    total = int(max(s.max(), t.max())) + 1
    roots, of = np.unique(components(s, t, total), return_inverse=True)
    n = len(roots)
    key = np.unique((of[s].astype(np.int64) << 32 | of[t])[of[s] != of[t]])
    s, t = key >> 32, key & 0xFFFFFFFF
    at, to = _neighbours(s, t, n)
    waits, number = np.bincount(t, minlength=n), np.zeros(n, dtype=np.int64)
    todo = np.flatnonzero(waits == 0).tolist()
    left, place, first, after = memoryview(waits), memoryview(number), memoryview(at), memoryview(to)
    for k in range(n):
        c = todo.pop()
        place[c] = k
        for d in after[first[c] : first[c + 1]]:
            left[d] -= 1
            if not left[d]:
                todo.append(d)
    # the hub: the largest component, of equal ones that with most links
    ways = (np.bincount(s, minlength=n) + 1) * (np.bincount(t, minlength=n) + 1)
    hub = int(np.lexsort((ways, np.bincount(of, minlength=n)))[-1])
    side = np.zeros(n, dtype=np.int64)
    side[_beyond(*_neighbours(t, s, n), n, hub)] = BEFORE
    side[_beyond(at, to, n, hub)] = AFTER
    side[hub] = HUB
    yield from _batches(name, node=base + np.arange(total), comp=number[of], target=None, side=side[of])
    if len(s):
        told = ((side[s] == BEFORE) | (side[s] == HUB)) & ((side[t] == AFTER) | (side[t] == HUB))
        yield from _batches(name, node=None, comp=number[s], target=number[t], side=told.astype(np.int64))


def condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(analysis_id, path, comp, side) of the files that edges touch and (analysis_id, source, target, told) links between components, written.

    Components are numbered from 0 so that one comes after all that import it, as far as links are not told. ``side`` tells where a component
    stands to the hub, a large one: all that lead to the hub lead to all that come after it, so a link between those (``told``) tells nothing
    more about who depends on whom. A graph that fits a task is condensed in one, once, as numbers; of a larger one, only what is
    left when files without importers or imports have been cut off by joins (``_condensed_by_parts``).
    """
    nodes, pairs = coded(edges)
    if not fits_task(pairs):
        return _condensed_by_parts(nodes, pairs)
    both = written(pairs.groupBy("analysis_id").applyInArrow(_condense, "analysis_id string, node long, comp long, target long, side long"))
    of = both.where("target IS NULL").select("analysis_id", "node", "comp", F.col("side").cast("int").alias("side")).join(nodes, ["analysis_id", "node"])
    links = both.where("target IS NOT NULL").select("analysis_id", F.col("comp").alias("source"), "target", (F.col("side") == 1).alias("told"))
    return of.select("analysis_id", "path", "comp", "side"), links


def _condensed_by_parts(nodes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``condensed`` of a graph beyond a task. nodes, pairs: as ``coded`` gives them.

    Rounds cut off the nodes without an edge in or out until the rest fits a task, which condenses it and finds its hub. Where that does not
    help, as too much lies on cycles, those become single nodes first (``_coloured``), and what has no cycle is cut off entirely in the end. Of
    what a round cut off, from the last to the first, a node comes after the hub if an importer does, or leads to it if an import does.
    """
    key = ["analysis_id", "node"]
    side_of = lambda table, side: table.select("analysis_id", F.col("node").alias(side))
    label, went, open_ = None, [], written(pairs.where("source <> target"))
    n = open_.count()
    while not fits_task(open_):
        ends = open_.select("analysis_id", F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
        gone = written(ends.groupBy("analysis_id", F.col("e.node").alias("node")).agg(F.max("e.o").alias("o"), F.max("e.i").alias("i")).where("o = 0 OR i = 0").select(*key, (F.col("o") == 0).alias("sink")))
        left = written(_meets(_meets(open_, side_of(gone, "source"), ["analysis_id", "source"], "left_anti"), side_of(gone, "target"), ["analysis_id", "target"], "left_anti"))
        discard(open_)
        m = left.count()
        went.append(gone)
        if label is None and 10 * m > 9 * n and not fits_task(left):  # cycles and what lies between them
            text = left.select("analysis_id", F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
            label = written(_coloured(text, in_tasks=True).select("analysis_id", F.col("node").cast("long").alias("node"), F.col("label").cast("long").alias("label")))
            whole = written(_relabelled(left, label).where("source <> target").distinct())
            discard(left)
            left, m = whole, whole.count()
        open_, n = left, m
    core_nodes, core = coded(open_)
    both = written(core.groupBy("analysis_id").applyInArrow(_condense, "analysis_id string, node long, comp long, target long, side long"))
    # level: rounds of sources, the core, what has no edge left, rounds of sinks from the last to the first
    inner = both.where("target IS NULL").select("analysis_id", "node", "comp", "side").join(core_nodes, key)
    placed = written(inner.select("analysis_id", F.col("path").alias("node"), F.lit(0).alias("level"), F.col("comp").alias("nth"), F.col("side").cast("int").alias("side")))
    all_nodes, links = nodes.select(*key), pairs
    if label is not None:
        all_nodes = all_nodes.join(label, key, "left").select("analysis_id", F.coalesce("label", "node").alias("node")).distinct()
        links = _relabelled(pairs, label)
    links = written(links.where("source <> target"))
    for k in range(len(went) - 1, -1, -1):
        ahead = links.join(side_of(placed.where(F.col("side").isin(BEFORE, HUB)), "target"), ["analysis_id", "target"], "left_semi").select("analysis_id", F.col("source").alias("node"), F.lit(BEFORE).alias("near"))
        behind = links.join(side_of(placed.where(F.col("side").isin(AFTER, HUB)), "source"), ["analysis_id", "source"], "left_semi").select("analysis_id", F.col("target").alias("node"), F.lit(AFTER).alias("near"))
        # a node without importers comes after nothing, one without imports leads to nothing
        near = ahead.unionByName(behind).distinct().withColumn("sink", F.col("near") == AFTER)
        level = F.when(F.col("sink"), F.lit(len(went) + 1 - k)).otherwise(F.lit(k - len(went)))
        told = went[k].join(near, [*key, "sink"], "left").select(*key, level.alias("level"), F.col("node").alias("nth"), F.coalesce("near", F.lit(APART)).alias("side"))
        placed = written(placed.unionByName(told))
    rest = all_nodes.join(placed, key, "left_anti").select(*key, F.lit(1).alias("level"), F.col("node").alias("nth"), F.lit(APART).alias("side"))
    placed = written(placed.unionByName(rest))
    comps = numbered(placed.select("analysis_id", "level", "nth").distinct(), "analysis_id", "level", "nth", name="__n")
    first = comps.groupBy("analysis_id").agg(F.min("__n").alias("__first"))
    comps = comps.join(first, "analysis_id").select("analysis_id", "level", "nth", (F.col("__n") - F.col("__first")).alias("comp"))
    placed = written(placed.join(comps, ["analysis_id", "level", "nth"]).select(*key, "comp", "side"))
    own = nodes if label is None else nodes.join(label, key, "left").select("analysis_id", "path", F.coalesce("label", "node").alias("node"))
    of = written(own.join(placed, key).select("analysis_id", "path", "comp", "side"))
    end = lambda side: placed.select("analysis_id", F.col("node").alias(side), F.col("comp").alias(f"__{side}"), F.col("side").alias(f"{side}_side"))
    told = F.col("source_side").isin(BEFORE, HUB) & F.col("target_side").isin(AFTER, HUB)
    between = links.join(end("source"), ["analysis_id", "source"]).join(end("target"), ["analysis_id", "target"]).where("__source <> __target")
    return of, written(between.select("analysis_id", F.col("__source").alias("source"), F.col("__target").alias("target"), told.alias("told")).distinct())


def _relabelled(edges: DataFrame, label: DataFrame) -> DataFrame:
    """Edges with ends replaced by their labels, where they have one. label: (analysis_id, node, label)."""
    for side in ("source", "target"):
        own = label.select("analysis_id", F.col("node").alias(side), F.col("label").alias("__label"))
        edges = edges.join(own, ["analysis_id", side], "left").withColumn(side, F.coalesce("__label", side)).drop("__label")
    return edges


def _waves(side: np.ndarray, source: np.ndarray, target: np.ndarray, first: int, end: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(rows, lo, bits): which of the components lo, lo + 1, ... of those from ``first`` to ``end`` lead to each component in ``rows``.

    A few are followed through the links at once, only components that they lead to have a row, and a wave that would
    take more than WAVE_BITS is halved, so memory is bounded. What comes after the hub leaves out what leads to it.
    """
    n = len(side)
    at, to = map(memoryview, _neighbours(source, target, n))
    by_at, by = _neighbours(target, source, n)
    before, place = (side == BEFORE) | (side == HUB), np.full(n, -1, dtype=np.int64)
    lo, width = first, WAVE
    while lo < end:
        hi = min(end, lo + width)
        seen, todo, rows = bytearray(n), list(range(lo, hi)), array("q")
        while todo:
            v = todo.pop()
            for w in to[at[v] : at[v + 1]]:
                if not seen[w]:
                    seen[w] = True
                    todo.append(w)
                    rows.append(w)
        if len(rows) * (hi - lo) > WAVE_BITS and hi - lo > 8:
            width = max(8, (hi - lo) // 2)
            continue
        if len(rows):
            rows = np.sort(np.frombuffer(rows, dtype=np.int64))  # one comes after all that import it
            place[rows] = np.arange(len(rows))
            bits = np.zeros((len(rows), (hi - lo + 7) // 8), dtype=np.uint8)
            kept = ~np.packbits(before[lo:hi])
            for k, c in enumerate(rows.tolist()):
                importers = by[by_at[c] : by_at[c + 1]]
                own = importers[(importers >= lo) & (importers < hi)] - lo
                np.bitwise_or.at(bits[k], own >> 3, (128 >> (own & 7)).astype(np.uint8))
                near = place[importers]
                near = near[near >= 0]
                for part in range(0, len(near), 1024):
                    bits[k] |= np.bitwise_or.reduce(bits[near[part : part + 1024]], axis=0)
                if side[c] == AFTER:
                    bits[k] &= kept
            place[rows] = -1
            yield rows, lo, bits
        lo, width = hi, min(WAVE, 2 * width)


def _dealt(comps: DataFrame, links: DataFrame, columns: list[str]) -> DataFrame:
    """Components and the links that are not told by the hub, for each task that follows a slice of a repository's components."""
    n = F.least(F.lit(SLICES), F.ceil(F.count("*") / SLICE_TARGETS)).cast("int")
    slices = comps.groupBy("analysis_id").agg(n.alias("slices"))
    none = [F.lit(None).cast("long").alias(c) for c in columns]
    both = comps.select("analysis_id", "comp", F.lit(None).cast("long").alias("target"), *columns).unionByName(links.where("NOT told").select("analysis_id", F.col("source").alias("comp"), "target", *none))
    return both.join(slices, "analysis_id").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))


def _read_slice(batches: Iterator[pa.RecordBatch], columns: list[str]) -> tuple[str, dict[str, np.ndarray], np.ndarray, np.ndarray, int, int]:
    """(analysis_id, columns by component, source, target, first, end) of what ``_dealt`` gives a task."""
    name, nth, slices, rows, pairs = None, 0, 1, [], []
    for b in batches:
        if name is None:
            name, nth, slices = (b.column(c)[0].as_py() for c in ("analysis_id", "slice", "slices"))
        link = b.column("target").is_valid()
        pairs.append([b.column(c).filter(link).to_numpy() for c in ("comp", "target")])
        rows.append([b.column(c).filter(b.column("target").is_null()).to_numpy() for c in ("comp", *columns)])
    comp, *values = (np.concatenate(p) for p in zip(*rows, strict=True))
    order = np.argsort(comp)
    source, target = (np.concatenate(p) for p in zip(*pairs, strict=True))
    n = len(comp)
    return name, {c: v[order] for c, v in zip(columns, values, strict=True)}, source, target, n * nth // slices, n * (nth + 1) // slices


def crossed(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Each row of ``targets`` (analysis_id, target, ..) with each row of ``sources`` (analysis_id, path, ..) of its repository, but for target = path.

    Both are dealt into lists of BLOCK rows or so and written, once each. Lists meet in a nested loop of Spark and only then open, row by row: nothing that
    grows with the pairs is shuffled, written or held.
    """
    spark = sources.sparkSession

    def lists(rows: DataFrame, name: str) -> DataFrame:
        known = rows.groupBy("analysis_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__n"))
        columns = [c for c in rows.columns if c != "analysis_id"]
        dealt = rows.join(F.broadcast(known), "analysis_id")  # one row a repository
        dealt = dealt.select("analysis_id", F.pmod(F.xxhash64(*columns), F.col("__n")).cast("int").alias("list"), F.struct(*columns).alias("row"))
        made = dealt.groupBy("analysis_id", "list").agg(F.collect_list("row").alias(name))
        return written(made.repartition(spark.sparkContext.defaultParallelism, "analysis_id", "list").drop("list"))

    by, of = lists(sources, "by"), lists(targets, "of").withColumnRenamed("analysis_id", "__a")
    met = of.hint("shuffle_replicate_nl").join(by, F.col("__a") == F.col("analysis_id"))
    one = met.select("analysis_id", "by", F.explode("of").alias("t")).select("analysis_id", "t", F.explode("by").alias("s")).where("t.target <> s.path")
    return one.select("analysis_id", *[F.col(f"t.{c}").alias(c) for c in targets.columns if c != "analysis_id"], *[F.col(f"s.{c}").alias(c) for c in sources.columns if c != "analysis_id"])


def affected_files(edges: DataFrame, targets: DataFrame, *, method: str | None = None) -> DataFrame:
    """(analysis_id, target, path): files that import ``target`` directly or through others, never the target itself.

    ``targets``: (analysis_id, target). ``grouped``, the default: the condensed graph; what leads to the hub goes with what comes after it as a whole, the
    rest is followed by tasks that give it out a batch at a time; ``distributed``: a frontier that grows by joins.
    """
    if method == "distributed":
        return _distributed_reach(edges, targets)
    before, after, pairs = affected_parts(edges, targets)
    return crossed(before, after).unionByName(pairs)


def affected_parts(edges: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``affected_files`` gives, in three tables: (analysis_id, path) and (analysis_id, target), of which each goes with each but itself, and
    all other pairs (analysis_id, target, path)."""
    of, links = condensed(edges)
    of = written(of)
    asked = written(targets.select("analysis_id", "target").distinct().join(of.withColumnRenamed("path", "target"), ["analysis_id", "target"]))
    wanted = asked.select("analysis_id", "comp", F.lit(1).cast("long").alias("wanted")).distinct()
    comps = of.select("analysis_id", "comp", F.col("side").cast("long").alias("side")).distinct().join(wanted, ["analysis_id", "comp"], "left").fillna(0, ["wanted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, value, source, target, first, end = _read_slice(batches, ["side", "wanted"])
        for rows, lo, bits in _waves(value["side"], source, target, first, end):
            own = np.flatnonzero(value["wanted"][rows])
            for at in range(0, len(own), 256):
                k, by = np.nonzero(np.unpackbits(bits[own[at : at + 256]], axis=1))
                yield from _batches(name, of=rows[own[at : at + 256]][k], comp=lo + by)

    far = written(_dealt(comps, links, ["side", "wanted"]).groupBy("analysis_id", "slice").applyInArrow(run, "analysis_id string, of long, comp long"))
    by = of.select("analysis_id", "comp", "path")
    apart = asked.select("analysis_id", "target", F.col("comp").alias("of")).join(far, ["analysis_id", "of"]).join(by, ["analysis_id", "comp"]).select("analysis_id", "target", "path")
    # a component's own files; the hub's are among those that all after it get
    inside = asked.where(F.col("side") != HUB).select("analysis_id", "comp", "target").join(by, ["analysis_id", "comp"]).where("path <> target").select("analysis_id", "target", "path")
    before, after = of.where(F.col("side").isin(BEFORE, HUB)).select("analysis_id", "path"), asked.where(F.col("side").isin(AFTER, HUB)).select("analysis_id", "target")
    return before, after, apart.unionByName(inside)


def affected_totals(nodes: DataFrame, edges: DataFrame, weights: list[str]) -> DataFrame:
    """(analysis_id, path, affected_files, and of each weight column the sum over the affected files) for every node.

    All that comes after the hub of a repository (``condensed``) has the sums of all that leads to it; what else leads to a component
    is followed by tasks, each a slice of the components, a few megabytes of bits at a time, so memory is bounded; no pair is ever a row.
    """
    names, key = ["affected_files", *weights], ["analysis_id", "path"]
    known = nodes.dropDuplicates(key)
    inside = lambda side: known.select("analysis_id", F.col("path").alias(side))
    of, links = condensed(edges.join(inside("source"), ["analysis_id", "source"], "left_semi").join(inside("target"), ["analysis_id", "target"], "left_semi"))
    linked = written(known.join(of, key).select(*key, "comp", F.col("side").cast("long").alias("side"), F.lit(1).cast("long").alias("affected_files"), *[F.col(w).cast("long").alias(w) for w in weights]))
    comps = written(linked.groupBy("analysis_id", "comp", "side").agg(*[F.sum(c).alias(c) for c in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, value, source, target, first, end = _read_slice(batches, ["side", *names])
        weight = np.column_stack([value[c] for c in names]).astype(float)
        for rows, lo, bits in _waves(value["side"], source, target, first, end):
            for at in range(0, len(rows), 1024):
                sums = np.rint(np.unpackbits(bits[at : at + 1024], axis=1, count=min(end - lo, 8 * bits.shape[1])).astype(float) @ weight[lo : lo + 8 * bits.shape[1]][: end - lo]).astype(np.int64)
                yield from _batches(name, comp=rows[at : at + 1024], **{c: sums[:, k] for k, c in enumerate(names)})

    schema = "analysis_id string, comp long, " + ", ".join(f"`{c}` long" for c in names)
    found = _dealt(comps, links, ["side", *names]).groupBy("analysis_id", "slice").applyInArrow(run, schema)
    sums = found.groupBy("analysis_id", "comp").agg(*[F.sum(c).alias(f"__far_{c}") for c in names])
    before = lambda c: F.sum(F.when(F.col("side") == BEFORE, F.col(c)).otherwise(0))
    hub = comps.groupBy("analysis_id").agg(*[before(c).alias(f"__before_{c}") for c in names], *[F.sum(F.when(F.col("side") == HUB, F.col(c)).otherwise(0)).alias(f"__hub_{c}") for c in names])
    by_hub = lambda c: F.when(F.col("side") == AFTER, F.col(f"__before_{c}") + F.col(f"__hub_{c}")).when(F.col("side") == HUB, F.col(f"__before_{c}")).otherwise(0)
    # with the others of the own component, never the file itself
    to_comp = comps.join(sums, ["analysis_id", "comp"], "left").join(hub, "analysis_id").select("analysis_id", "comp", *[(F.col(c) + by_hub(c) + F.coalesce(f"__far_{c}", F.lit(0))).alias(f"__{c}") for c in names])
    told = linked.join(to_comp, ["analysis_id", "comp"]).select(*key, *[(F.col(f"__{c}") - F.col(c)).alias(c) for c in names])
    return known.select(*key).join(told, key, "left").select(*key, *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def two_hop_labels(source: np.ndarray, target: np.ndarray, n: int) -> tuple[list[list[int]], list[list[int]]]:
    """For each of n nodes of a graph without cycles the hubs that it leads to and those that lead to it, itself among them.

    a leads to b if and only if a hub is in both lists. Nodes become hubs in the order of how many paths may pass them; a hub is
    noted forwards and backwards as far as the hubs before it do not tell the same, which keeps the lists short.
    """
    paths = (np.bincount(source, minlength=n) + 1) * (np.bincount(target, minlength=n) + 1)
    order = np.lexsort((np.random.default_rng(0).permutation(n), -paths)).tolist()  # ties at random: hubs along a chain halve it

    def neighbours(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        by = np.argsort(a, kind="stable")
        return np.searchsorted(a[by], np.arange(n + 1)).tolist(), b[by].tolist()

    sides = (neighbours(source, target), neighbours(target, source))
    leads: list[list[int]] = [[] for _ in range(n)]
    comes: list[list[int]] = [[] for _ in range(n)]
    for v in order:
        for (at, to), own, noted in ((sides[0], leads, comes), (sides[1], comes, leads)):
            told, seen, todo = set(own[v]), {v}, [v]
            while todo:
                w = todo.pop()
                if not told.isdisjoint(noted[w]):
                    continue
                noted[w].append(v)
                for x in to[at[w] : at[w + 1]]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
    return leads, comes


def reach_labels(edges: DataFrame) -> DataFrame:
    """(analysis_id, path, comp, hub, leads): who depends on whom as a table to be joined, without a search.

    Rows with a path tell the component of a file; rows with a hub that a component leads to it (``leads``) or comes after it. Any
    file depends on another if their components share a hub in that order. What the hub of the condensed graph tells is a label without a search; the
    links beyond that are labelled in one task a repository.
    """
    of, links = condensed(edges)
    of = written(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ends = None, ([], [])
        for b in batches:
            name = b.column("analysis_id")[0].as_py()
            for part, side in zip(ends, ("source", "target"), strict=True):
                part.append(b.column(side).to_numpy())
        comps, codes = np.unique(np.concatenate([np.concatenate(p) for p in ends]), return_inverse=True)
        s, t = codes[: len(codes) // 2], codes[len(codes) // 2 :]
        for leads, lists in enumerate(reversed(two_hop_labels(s, t, len(comps)))):
            for lo in range(0, len(lists), BATCH):
                part = lists[lo : lo + BATCH]
                own, hubs = np.repeat(np.arange(lo, lo + len(part)), [len(h) for h in part]), np.fromiter(chain.from_iterable(part), dtype=np.int64)
                other = own != hubs
                if other.any():
                    yield from _batches(name, comp=comps[own[other]], hub=comps[hubs[other]], leads=np.full(int(other.sum()), leads))

    far = links.where("NOT told").groupBy("analysis_id").applyInArrow(run, "analysis_id string, comp long, hub long, leads long").select("analysis_id", "comp", "hub", (F.col("leads") == 1).alias("leads"))
    sides = of.select("analysis_id", "comp", "side").distinct()
    first = sides.where(F.col("side") == HUB).select("analysis_id", F.col("comp").alias("hub"))  # one row a repository
    told = sides.where(F.col("side").isin(BEFORE, AFTER)).join(first, "analysis_id").select("analysis_id", "comp", "hub", (F.col("side") == BEFORE).alias("leads"))
    comps = of.select("analysis_id", "comp").distinct()  # each is a hub of its own, on both sides
    both = comps.select("analysis_id", "comp", F.col("comp").alias("hub"), F.explode(F.array(F.lit(True), F.lit(False))).alias("leads"))
    hubs = far.unionByName(told).unionByName(both)
    none = lambda kind: F.lit(None).cast(kind)
    return of.select("analysis_id", "path", "comp", none("long").alias("hub"), none("boolean").alias("leads")).unionByName(hubs.select("analysis_id", none("string").alias("path"), "comp", "hub", "leads"))


def affected_by_labels(labels: DataFrame, targets: DataFrame) -> DataFrame:
    """(analysis_id, target, path) as ``affected_files`` gives it, by joins of ``reach_labels``. targets: (analysis_id, target).

    What leads to the hub that most targets come after goes with all of those as a whole; only what other hubs tell beyond
    that is joined pair by pair.
    """
    of = labels.where("path IS NOT NULL").select("analysis_id", "path", "comp")
    hubs = labels.where("hub IS NOT NULL")
    asked = written(targets.select("analysis_id", "target").distinct().join(of.withColumnRenamed("path", "target"), ["analysis_id", "target"]))
    comps = asked.groupBy("analysis_id", F.col("comp").alias("of")).agg(F.count("*").alias("n"))
    near = written(comps.join(hubs.where("NOT leads").select("analysis_id", F.col("comp").alias("of"), "hub"), ["analysis_id", "of"]))
    top = near.groupBy("analysis_id", "hub").agg(F.sum("n").alias("n")).groupBy("analysis_id").agg(F.max_by("hub", F.struct("n", "hub")).alias("top"))
    leads = written(hubs.where("leads").select("analysis_id", "comp", "hub").join(top, "analysis_id"))
    before = leads.where("hub = top").select("analysis_id", "comp", F.lit(True).alias("before"))
    after = near.join(top, "analysis_id").where("hub = top").select("analysis_id", "of", F.lit(True).alias("after"))
    whole = crossed(of.join(before, ["analysis_id", "comp"]).select("analysis_id", "path"), asked.withColumnRenamed("comp", "of").join(after, ["analysis_id", "of"]).select("analysis_id", "target"))
    others = near.join(after, ["analysis_id", "of"], "left").select("analysis_id", "of", "hub", "after")
    by = others.join(leads.where("hub <> top").join(before, ["analysis_id", "comp"], "left"), ["analysis_id", "hub"]).where("after IS NULL OR before IS NULL")
    pairs = asked.withColumnRenamed("comp", "of").join(written(by.select("analysis_id", "of", "comp").distinct()), ["analysis_id", "of"]).join(of, ["analysis_id", "comp"])
    return whole.unionByName(pairs.where("path <> target").select("analysis_id", "target", "path"))


def _distributed_reach(edges: DataFrame, targets: DataFrame) -> DataFrame:
    back = written(edges.select("analysis_id", F.col("target").alias("path"), F.col("source").alias("by")).distinct())
    frontier = targets.select("analysis_id", "target", F.col("target").alias("path")).distinct()
    seen = written(frontier.limit(0))
    while True:
        new = back.join(frontier, ["analysis_id", "path"]).where("by <> target").select("analysis_id", "target", F.col("by").alias("path")).distinct()
        new = written(new.join(seen, ["analysis_id", "target", "path"], "left_anti"))
        if new.isEmpty():
            return seen
        seen, frontier = seen.unionByName(new), new


def neighbour_state(nodes: DataFrame, edges: DataFrame, selected: str | DataFrame, query: str = "") -> DataFrame:
    """(analysis_id, path, state) around a selected file: selected, outgoing (it imports), incoming (imports it), or default;
    without a selection, a trimmed case-blind substring makes nodes matched or dimmed. A table (analysis_id, path) selects
    a file of each repository."""
    base = nodes.select("analysis_id", "path")
    if isinstance(selected, DataFrame):
        chosen = selected.select("analysis_id", F.col("path").alias("__own"))
        out = edges.join(chosen.withColumnRenamed("__own", "source"), ["analysis_id", "source"], "left_semi").select("analysis_id", F.col("target").alias("path"), F.lit(3).alias("__s"))
        into = edges.join(chosen.withColumnRenamed("__own", "target"), ["analysis_id", "target"], "left_semi").select("analysis_id", F.col("source").alias("path"), F.lit(2).alias("__s"))
        best = out.unionByName(into).unionByName(chosen.select("analysis_id", F.col("__own").alias("path"), F.lit(4).alias("__s"))).groupBy("analysis_id", "path").agg(F.max("__s").alias("__s"))
        s = F.coalesce("__s", F.lit(1))
        state = F.when(s == 4, "selected").when(s == 3, "outgoing").when(s == 2, "incoming").otherwise("dimmed")
        return base.join(best, ["analysis_id", "path"], "left").select("analysis_id", "path", state.alias("state"))
    if query.strip() and not selected:
        return base.withColumn("state", F.when(F.contains(F.lower("path"), F.lit(query.strip().lower())), "matched").otherwise("dimmed"))
    out = edges.where(F.col("source") == selected).select("analysis_id", F.col("target").alias("path"), F.lit(True).alias("__out")).distinct()
    into = edges.where(F.col("target") == selected).select("analysis_id", F.col("source").alias("path"), F.lit(True).alias("__in")).distinct()
    state: Column = F.when(F.col("path") == selected, "selected").when(F.col("__out"), "outgoing").when(F.col("__in"), "incoming").otherwise("dimmed" if selected else "default")
    key = ["analysis_id", "path"]
    return base.join(out, key, "left").join(into, key, "left").select(*key, state.alias("state"))


def file_tree(nodes: DataFrame) -> DataFrame:
    """(analysis_id, path, parent, name, depth, is_file, place): the directories that paths imply, then files, in display order.

    ``place`` counts the entries of a directory from 0: directories first, then by name as a reader of any language expects it
    (the Unicode collation), equal names by their bytes.
    """
    from pyspark.sql import Window

    from codeloom.functions import files as FF
    from codeloom.functions import paths as P

    parts = nodes.select("analysis_id", F.col("path").alias("__file"), F.explode(P.prefixes(F.col("path"))).alias("path"))
    tree = parts.groupBy("analysis_id", "path").agg(F.max(F.col("path") == F.col("__file")).alias("is_file"))
    told = tree.select(
        "analysis_id", "path", P.dirname(F.col("path")).alias("parent"), FF.file_name(F.col("path")).alias("name"),
        (F.size(F.split("path", "/")) - 1).alias("depth"), "is_file",
    )
    order = Window.partitionBy("analysis_id", "parent").orderBy("is_file", F.collate("name", "UNICODE"), "name")  # a directory's entries
    return told.withColumn("place", F.row_number().over(order) - 1).orderBy("analysis_id", "parent", "place")


def grid_layout(nodes: DataFrame, columns: int) -> DataFrame:
    """(analysis_id, path, row, col): nodes in the order of their paths, ``columns`` to a row; for files without edges."""
    placed = numbered(nodes.select("analysis_id", "path"), "analysis_id", "path", name="__n")
    first = placed.groupBy("analysis_id").agg(F.min("__n").alias("__first"))
    own = F.col("__n") - F.col("__first")
    return placed.join(first, "analysis_id").select("analysis_id", "path", F.floor(own / columns).cast("int").alias("row"), (own % columns).cast("int").alias("col"))


# Fixed values of the drawing: a file's box, gaps between layers and between boxes, margins, and the grid of files without edges.
NODE_WIDTH, NODE_HEIGHT, LAYER_GAP, NODE_GAP, MARGIN = 190, 40, 110, 28, 20
GRID_GAP_X, GRID_GAP_Y, GRID_TOP = 24, 16, 80


def layered_coordinates(source: np.ndarray, target: np.ndarray, n: int, sweeps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(layer, y) of n files: long edges pass every layer between by a point of their own, medians of neighbours order the
    layers (the sweep with the fewest crossings stays), then boxes move to the mean of their neighbours as far as the gaps allow."""
    label = components(source, target, n)
    layer = np.zeros(n, dtype=np.int64)
    a, b = label[source], label[target]
    between = np.unique(np.column_stack([a, b])[a != b], axis=0)
    for _ in range(n):
        deeper = layer.copy()
        np.maximum.at(deeper, between[:, 1], layer[between[:, 0]] + 1)
        if (deeper == layer).all():
            break
        layer = deeper
    layer = layer[label]
    at, links, total = layer.tolist(), [], n
    for s, t in np.unique(np.column_stack([source, target])[layer[source] < layer[target]], axis=0).tolist():
        last = s
        for k in range(at[s] + 1, at[t]):
            at.append(k)
            links.append((last, total))
            last, total = total, total + 1
        links.append((last, t))
    at = np.array(at)
    links = np.array(links, dtype=np.int64).reshape(-1, 2)
    depth = int(at.max()) + 1 if total else 0
    rows = [np.flatnonzero(at == k) for k in range(depth)]
    left, right = [[] for _ in range(total)], [[] for _ in range(total)]
    for s, t in links.tolist():
        right[s].append(t)
        left[t].append(s)
    place = np.zeros(total)

    def settle(rows: list[np.ndarray]) -> None:
        for row in rows:
            place[row] = np.arange(len(row))

    def crossings() -> int:
        count = 0
        for k in range(depth - 1):
            own = links[at[links[:, 0]] == k]
            ends = place[own[np.lexsort((place[own[:, 1]], place[own[:, 0]]))][:, 1]]
            count += int(np.triu(ends[:, None] > ends[None], 1).sum())
        return count

    settle(rows)
    best, fewest = [r.copy() for r in rows], crossings()
    for sweep in range(sweeps):
        ks = range(1, depth) if sweep % 2 == 0 else range(depth - 2, -1, -1)
        near = left if sweep % 2 == 0 else right
        for k in ks:
            median = [float(np.median(place[near[v]])) if near[v] else place[v] for v in rows[k].tolist()]
            rows[k] = rows[k][np.lexsort((rows[k], median))]
            place[rows[k]] = np.arange(len(rows[k]))
        if (now := crossings()) < fewest:
            best, fewest = [r.copy() for r in rows], now
    # coordinates: boxes are a step apart, points of edges as well; each layer moves towards its neighbours in turn
    step = NODE_HEIGHT + NODE_GAP
    y = np.zeros(total)
    for row in best:
        y[row] = np.arange(len(row)) * step
    for sweep in range(sweeps):
        near = left if sweep % 2 == 0 else right
        for row in best if sweep % 2 == 0 else best[::-1]:
            wish = np.array([np.mean(y[near[v]]) if near[v] else y[v] for v in row.tolist()])
            down, up = wish.copy(), wish.copy()
            for i in range(1, len(row)):
                down[i] = max(down[i], down[i - 1] + step)
            for i in range(len(row) - 2, -1, -1):
                up[i] = min(up[i], up[i + 1] - step)
            y[row] = (down + up) / 2  # both keep the gaps, so their mean does
    return layer, y[:n] - (y[:n].min() if n else 0)


def layout(nodes: DataFrame, edges: DataFrame, cap: int = TOP_CONNECTED) -> DataFrame:
    """(analysis_id, path, x, y): the upper left corner of each file's box in a drawing of the ``cap`` most connected files.

    Files with edges stand in layers from left to right, an importing file left of what it imports; files without stand in a grid
    below. A drawing has at most ``cap`` boxes, so a repository's is one task's work.
    """
    shown = top_connected(nodes, edges, cap).select("analysis_id", "path")
    drawn = visible_edges(edges, shown).select("analysis_id", "source", "target").distinct()

    def run(part: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({"analysis_id": [], "path": [], "x": [], "y": []})
        paths = np.sort(part["path"].to_numpy().astype(str))
        s, t = (np.searchsorted(paths, pairs[c].to_numpy().astype(str)) for c in ("source", "target"))
        tied = np.zeros(len(paths), dtype=bool)
        tied[s] = tied[t] = True
        x, y, code = np.zeros(len(paths)), np.zeros(len(paths)), np.cumsum(tied) - 1
        wide, bottom = NODE_WIDTH, 0.0
        if tied.any():
            layer, down = layered_coordinates(code[s], code[t], int(tied.sum()))
            x[tied], y[tied] = MARGIN + layer * (NODE_WIDTH + LAYER_GAP), MARGIN + down
            wide, bottom = x[tied].max() + NODE_WIDTH, y[tied].max() + NODE_HEIGHT + GRID_TOP
        columns, i = max(1, int(wide // (NODE_WIDTH + GRID_GAP_X))), np.arange(int((~tied).sum()))
        x[~tied], y[~tied] = i % columns * (NODE_WIDTH + GRID_GAP_X), bottom + i // columns * (NODE_HEIGHT + GRID_GAP_Y)
        return pd.DataFrame({"analysis_id": part["analysis_id"].iloc[0], "path": paths, "x": x, "y": y})

    return shown.groupBy("analysis_id").cogroup(_apart(drawn).groupBy("analysis_id")).applyInPandas(run, "analysis_id string, path string, x double, y double")


def _layered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, base, s, t = _read_pairs(batches)
    n = int(max(s.max(), t.max())) + 1
    label = components(s, t, n).astype(np.int32)
    layer = np.zeros(n, dtype=np.int64)
    a, b = label[s], label[t]
    a, b = a[a != b], b[a != b]
    waits = np.bincount(b, minlength=n)
    at, to = _neighbours(a, b, n)
    todo = [v for v in np.unique(label).tolist() if not waits[v]]
    at, to, deep, left = map(memoryview, (at, to, layer, waits))
    del a, b
    while todo:  # a component once all that import it are done
        v = todo.pop()
        below = deep[v] + 1
        for w in to[at[v] : at[v + 1]]:
            if deep[w] < below:
                deep[w] = below
            left[w] -= 1
            if not left[w]:
                todo.append(w)
    layer = layer[label]
    place, within = np.zeros(n), np.zeros(n, dtype=np.int64)
    forward = layer[s] < layer[t]
    s, t = s[forward], t[forward]
    order = np.argsort(layer[t], kind="stable")
    s, t, by_node = s[order], t[order], np.argsort(layer, kind="stable")
    depths = np.arange(int(layer.max()) + 2)
    edge_at, node_at = np.searchsorted(layer[t], depths), np.searchsorted(layer[by_node], depths)
    for depth in depths[:-1].tolist():  # each edge and file is looked at once
        own, into = by_node[node_at[depth] : node_at[depth + 1]], slice(edge_at[depth], edge_at[depth + 1])
        within[own] = np.arange(len(own))
        count, total = (np.bincount(within[t[into]], w, minlength=len(own)) for w in (None, place[s[into]]))
        place[own[np.lexsort((own, total / np.maximum(1, count)))]] = np.arange(len(own))
    yield from _batches(name, node=base + np.arange(n), layer=layer, place=place.astype(np.int64))


def layers(edges: DataFrame) -> DataFrame:
    """(analysis_id, path, layer, place): connected files from left to right, an importing file left of what it imports.

    The layer is the longest chain of imports into the file's component, so members of a cycle share one; places count
    within a layer by the mean place of the importers in earlier layers, then by path. One task a repository, which holds numbers only.
    """
    nodes, pairs = coded(edges)
    found = pairs.groupBy("analysis_id").applyInArrow(_layered, "analysis_id string, node long, layer long, place long")
    return found.join(nodes, ["analysis_id", "node"]).select("analysis_id", "path", F.col("layer").cast("int").alias("layer"), F.col("place").cast("int").alias("place"))
