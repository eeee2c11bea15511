import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.operators import graph, impact
from codeloom.tables import written


def tables(spark, nodes, edges):
    n = spark.createDataFrame([("r", p) for p in nodes], "analysis_id string, path string")
    return n, spark.createDataFrame([("r", a, b) for a, b in edges], "analysis_id string, source string, target string")


def closure(edges):
    reach = {}
    for a, b in edges:
        reach.setdefault(a, set()).add(b)
    changed = True
    while changed:
        changed = False
        for a in reach:
            new = set().union(*(reach.get(b, set()) for b in reach[a])) - reach[a]
            if new:
                reach[a] |= new
                changed = True
    return reach


@pytest.mark.parametrize("method", ["grouped", "distributed"])
def test_cycles(spark, method):
    _, e = tables(spark, [], [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "f"), ("f", "e"), ("s", "s"), ("x", "y")])
    got = {tuple(r["members"]) for r in graph.cycles(graph.cycle_members(e, method=method)).collect()}
    assert got == {("a", "b", "c"), ("e", "f"), ("s",)}


def test_a_long_chain_has_no_cycle(spark):
    _, e = tables(spark, [], [(f"n{i:05}", f"n{i + 1:05}") for i in range(5000)])
    assert graph.cycle_members(e).isEmpty()


def shapes():
    rng = random.Random(9)
    ring = lambda names: list(zip(names, names[1:] + names[:1]))
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)]
    yield "ring", ring([f"r{i:02}" for i in range(37)])
    yield "chain", chain
    yield "ring of chains", ring([f"r{i}" for i in range(9)]) + [("r3", "x1"), ("x1", "x2"), ("x2", "x3"), ("x3", "r5"), ("r0", "t1"), ("t1", "t2"), ("t2", "t3")]
    yield "two rings by a chain", ring(list("abcd")) + ring(list("wxyz")) + [("a", "m1"), ("m1", "m2"), ("m2", "w")]
    yield "chain back to its start", [("h", "p1"), ("p1", "p2"), ("p2", "p3"), ("p3", "h"), ("h", "q1"), ("q1", "q2"), ("q2", "h"), ("z", "h"), ("s", "s"), ("h", "h")]
    yield "caterpillar", chain + [(a, f"leaf{a}") for a, _ in chain] + [(f"root{a}", a) for a, _ in chain]
    yield "random", [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(75)]


def test_joins_find_the_same_cycles_as_a_search(spark):
    rows = [(name, a, b) for name, edges in shapes() for a, b in edges]  # each shape a repository
    e = spark.createDataFrame(rows, "analysis_id string, source string, target string")
    assert {tuple(r) for r in graph.cycle_members(e, method="distributed").collect()} == {tuple(r) for r in graph.cycle_members(e, method="grouped").collect()}


def test_rounds_of_joins_send_no_table_through_the_driver(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(graph, "written", lambda df, f=graph.written: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df))
    _, e = tables(spark, [], [(f"n{k % 7}", f"n{k * 3 % 11}") for k in range(60)] + [("x", "y"), ("y", "x")])
    graph.cycle_members(e, method="distributed").collect()
    assert len(plans) > 5 and not any("BroadcastHashJoin" in p for p in plans)


def test_a_core_that_fits_a_task_is_searched_in_one(spark, monkeypatch):
    rows = [(name, a, b) for name, edges in shapes() for a, b in edges]
    e = spark.createDataFrame(rows, "analysis_id string, source string, target string")
    want = {tuple(r) for r in graph.cycle_members(e).collect()}
    monkeypatch.setattr(graph, "TASK_EDGES", 60)
    assert not graph.fits_task(e) and {tuple(r) for r in graph.cycle_members(e).collect()} == want


def test_labels_tell_what_a_search_tells(spark):
    rows = [(name, a, b) for name, edges in shapes() for a, b in edges]
    e = spark.createDataFrame(rows, "analysis_id string, source string, target string")
    labels = graph.reach_labels(e)
    targets = e.selectExpr("analysis_id", "explode(array(source, target, 'unknown')) AS target").distinct()
    assert {tuple(r) for r in graph.affected_by_labels(labels, targets).collect()} == {tuple(r) for r in graph.affected_files(e, targets).collect()}
    chain = labels.where("analysis_id = 'chain' AND hub IS NOT NULL").count()
    assert chain < 151 * 2 * 9  # a path of n files has n log n labels, not n ** 2


def test_a_chain_takes_a_logarithmic_number_of_tables(spark, monkeypatch):
    made = []
    monkeypatch.setattr(graph, "written", lambda df, f=graph.written: made.append(1) or f(df))
    _, e = tables(spark, [], [(f"n{i:04}", f"n{i + 1:04}") for i in range(4096)])
    assert graph.cycle_members(e, method="distributed").isEmpty()
    assert len(made) < 40


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_against_closure(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(25)]
    edges = list({(rng.choice(names), rng.choice(names)) for _ in range(35)})
    n, e = tables(spark, names, edges)
    reach = closure(edges)
    on_cycle = {a for a in names if a in reach.get(a, set())}
    assert {r["path"] for r in graph.cycle_members(e).collect()} == on_cycle
    pairs = {(b, a) for a in names for b in reach.get(a, set()) if a != b}
    targets = n.withColumnRenamed("path", "target")
    for method in ("grouped", "distributed"):
        assert {(r["target"], r["path"]) for r in graph.affected_files(e, targets, method=method).collect()} == pairs
    totals = {r["path"]: r["affected_files"] for r in graph.affected_totals(n, e, []).collect()}
    assert totals == {t: sum(x == t for x, _ in pairs) for t in names}


def test_fan_isolated_top_and_visible(spark):
    n, e = tables(spark, ["a", "b", "c", "d"], [("a", "b"), ("c", "b"), ("d", "d"), ("a", "zz")])
    assert {tuple(r)[1:] for r in graph.fan_in_out(n, e).collect()} == {("a", 0, 2), ("b", 2, 0), ("c", 0, 1), ("d", 1, 1)}
    n2, e2 = tables(spark, ["a", "b", "lone"], [("a", "b")])
    assert [r["path"] for r in graph.isolated_files(n2, e2).collect()] == ["lone"]
    top = graph.top_connected(n, e, 2)
    assert {r["path"] for r in top.collect()} == {"a", "b"}
    assert [(r["source"], r["target"]) for r in graph.visible_edges(e, top).collect()] == [("a", "b")]
    states = {r["path"]: r["state"] for r in graph.neighbour_state(n, e, "b").collect()}
    assert states == {"a": "incoming", "b": "selected", "c": "incoming", "d": "dimmed"}


def test_large_files_are_strictly_larger_and_sorted(spark):
    f = spark.createDataFrame([("r", "a", 400), ("r", "b", 401), ("r", "c", 600)], "analysis_id string, path string, line_count int")
    assert [r["path"] for r in graph.large_files(f).collect()] == ["c", "b"]


def test_tree(spark):
    n, _ = tables(spark, ["a/b/x.py", "a/y.py", "z"], [])
    got = [(r["path"], r["parent"], r["depth"], r["is_file"]) for r in graph.file_tree(n).collect()]
    assert set(got) == {("a", "", 0, False), ("a/b", "a", 1, False), ("a/b/x.py", "a/b", 2, True), ("a/y.py", "a", 1, True), ("z", "", 0, True)}


def test_risks(spark):
    rows = [(11, 21, 0, 0, "function"), (10, 20, 1, 0, "method"), (0, 0, 1, 0, "function"), (0, 0, 1, 3, "function")]
    df = spark.createDataFrame(rows, "fan_in int, affected int, tests int, callers int, kind string")
    c = [df[x] for x in ("fan_in", "affected", "tests", "callers", "kind")]
    got = [r[0] for r in df.select(impact.risk_indicators(*c)).collect()]
    assert got == [impact.RISKS, [], [impact.RISKS[3]], []]


def test_layers_and_grid(spark):
    n, e = tables(spark, list("abcdefg"), [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "c"), ("e", "d")])
    assert {r["path"]: r["layer"] for r in graph.layers(e).collect()} == {"a": 0, "e": 0, "b": 1, "c": 2, "d": 2}
    assert [(r["path"], r["row"], r["col"]) for r in graph.grid_layout(n, 3).orderBy("path").collect()][2:5] == [("c", 0, 2), ("d", 1, 0), ("e", 1, 1)]


def test_the_size_of_the_graph_decides_the_method(spark, monkeypatch):
    n, e = tables(spark, list("abcde"), [("a", "b"), ("b", "a"), ("c", "a"), ("d", "c")])
    want = [{tuple(r) for r in f.collect()} for f in (graph.cycle_members(e), graph.affected_files(e, n.withColumnRenamed("path", "target")))]
    monkeypatch.setattr(graph, "TASK_EDGES", 2)
    assert [{tuple(r) for r in f.collect()} for f in (graph.cycle_members(e), graph.affected_files(e, n.withColumnRenamed("path", "target")))] == want


def test_targets_are_dealt_over_tasks(spark, monkeypatch):
    rng = random.Random(2)
    names = [f"n{i}" for i in range(60)]
    n, e = tables(spark, names, {(rng.choice(names), rng.choice(names)) for _ in range(90)})
    n = n.selectExpr("*", "length(path) AS w")
    whole = [sorted(map(tuple, f.collect())) for f in (graph.affected_totals(n, e, ["w"]), graph.affected_files(e, n.withColumnRenamed("path", "target")))]
    monkeypatch.setattr(graph, "SLICE_TARGETS", 7)
    assert [sorted(map(tuple, f.collect())) for f in (graph.affected_totals(n, e, ["w"]), graph.affected_files(e, n.withColumnRenamed("path", "target")))] == whole


def test_state_around_a_selected_table_and_top_fan(spark):
    n, e = tables(spark, ["a", "b", "c", "d"], [("a", "b"), ("c", "b"), ("b", "b")])
    by_table = graph.neighbour_state(n, e, n.where("path = 'b'"))
    assert sorted(map(tuple, by_table.collect())) == sorted(map(tuple, graph.neighbour_state(n, e, "b").collect()))
    assert [r["path"] for r in graph.ranked_fan(graph.fan_in_out(n, e), 2).collect()] == ["b", "a"]


def test_places_in_a_directory_follow_the_language_not_the_bytes(spark):
    n, _ = tables(spark, ["B.py", "a.py", "_x.py", "a_b.py", "ab.py", "Zed/q.py", "é.py", "e.py", "f.py", "apple/r.py"], [])
    got = {r["path"]: r["place"] for r in graph.file_tree(n).where("parent = ''").collect()}
    assert sorted(got, key=got.get) == ["apple", "Zed", "_x.py", "a_b.py", "a.py", "ab.py", "B.py", "e.py", "é.py", "f.py"]


def crossings(pos, edges):
    rows = [(pos[a], pos[b]) for a, b in edges]
    return sum((a[0] == c[0] and b[0] == d[0]) and (a[1] - c[1]) * (b[1] - d[1]) < 0 for i, (a, b) in enumerate(rows) for c, d in rows[:i])


@pytest.mark.parametrize("seed", range(2))
def test_layout(spark, seed):
    rng = random.Random(seed)
    names = [f"f{i:02}" for i in range(40)]
    edges = sorted({tuple(sorted(rng.sample(names[:34], 2))) for _ in range(50)}) + [("f03", "f01"), ("f01", "f03"), ("f02", "f02")]
    n, e = tables(spark, names, edges)
    pos = {r["path"]: (r["x"], r["y"]) for r in graph.layout(n, e).collect()}
    assert set(pos) == set(names)
    boxes = list(pos.values())
    assert all(abs(a[0] - b[0]) >= graph.NODE_WIDTH or abs(a[1] - b[1]) >= graph.NODE_HEIGHT for i, a in enumerate(boxes) for b in boxes[:i])
    reach = closure(edges)
    for a, b in edges:  # left to right, but on cycles
        assert pos[a][0] < pos[b][0] or (a in reach.get(b, set()) and pos[a][0] == pos[b][0])
    layer = {}
    for p in sorted(pos):
        layer.setdefault(pos[p][0], []).append(p)
    plain = {p: (x, k) for x, ps in layer.items() for k, p in enumerate(ps)}
    assert crossings(pos, edges) <= crossings(plain, edges)
    tied = {x for pair in edges for x in pair}
    assert min(pos[p][1] for p in names if p not in tied) >= max(pos[p][1] for p in tied) + graph.NODE_HEIGHT
    few = graph.layout(n, e, 10)
    assert few.count() == 10


def hub_graph():
    """Files around a cycle: before it, after it, beside it, and both."""
    rng = random.Random(5)
    ring = [f"h{i:02}" for i in range(30)]
    edges = set(zip(ring, ring[1:] + ring[:1])) | {(f"b{rng.randrange(40)}", rng.choice(ring)) for _ in range(40)} | {(rng.choice(ring), f"z{rng.randrange(40)}") for _ in range(40)}
    edges |= {(f"b{rng.randrange(40)}", f"b{rng.randrange(40)}") for _ in range(20)} | {(f"b{rng.randrange(40)}", f"s{rng.randrange(20)}") for _ in range(20)}
    edges |= {(f"s{rng.randrange(20)}", f"z{rng.randrange(40)}") for _ in range(20)} | {(f"z{rng.randrange(40)}", f"z{rng.randrange(40)}") for _ in range(20)}
    return sorted(edges), sorted({x for e in edges for x in e})


@pytest.mark.parametrize("bits", [1 << 20, 200])
def test_what_leads_to_the_hub_is_told_once_to_all_after_it(spark, monkeypatch, bits):
    edges, names = hub_graph()
    n, e = tables(spark, names, edges)
    reach = closure(edges)
    pairs = {(b, a) for a in names for b in reach.get(a, set()) if a != b}
    monkeypatch.setattr(graph, "WAVE_BITS", bits)
    monkeypatch.setattr(graph, "SLICE_TARGETS", 25)
    monkeypatch.setattr(graph, "BLOCK", 8)
    targets = n.withColumnRenamed("path", "target")
    for got in (graph.affected_files(e, targets), graph.affected_by_labels(graph.reach_labels(e), targets)):
        rows = [(r["target"], r["path"]) for r in got.collect()]
        assert len(rows) == len(pairs) and set(rows) == pairs
    few = targets.where("target IN ('h03', 'z1', 's2', 'b4')")
    assert {(r["target"], r["path"]) for r in graph.affected_files(e, few).collect()} == {p for p in pairs if p[0] in ("h03", "z1", "s2", "b4")}
    weight = n.selectExpr("*", "length(path) + ascii(path) AS w")
    assert {r["path"]: (r["affected_files"], r["w"]) for r in graph.affected_totals(weight, e, ["w"]).collect()} == {
        t: (sum(x == t for x, _ in pairs), sum(len(a) + ord(a[0]) for x, a in pairs if x == t)) for t in names
    }
    links = graph.condensed(e)[1]
    assert 0 < links.where("NOT told").count() < links.count()


def test_waves_hold_rows_only_for_what_they_lead_to():
    # a chain of 6,000 beside 6,000 alone: the waves of those alone have no rows, the others stay below the bound
    chain = np.arange(6000)
    waves = list(graph._waves(np.zeros(12_000, dtype=np.int64), chain[:-1], chain[1:], 0, 12_000))
    assert all(bits.size * 8 <= graph.WAVE_BITS + 8 * len(rows) for rows, _, bits in waves) and max(lo for _, lo, _ in waves) < 6000
    assert sum(int(np.unpackbits(bits).sum()) for _, _, bits in waves) == 6000 * 5999 // 2


def test_tasks_that_condense_and_layer_hold_numbers_only(spark, monkeypatch):
    seen = []
    edges, names = hub_graph()
    _, e = tables(spark, names, edges)
    monkeypatch.setattr(graph, "written", lambda df, f=graph.written: seen.append(f(df)) or seen[-1])
    graph.layers(e).collect()
    graph.condensed(e)
    plain = [dict(t.dtypes) for t in seen if "source" in t.columns]
    assert plain and all(t["source"] == t["target"] == "bigint" for t in plain)


def test_entries_are_the_lists_row_by_row(spark):
    edges, names = hub_graph()
    _, e = tables(spark, names, edges)
    imports = e.selectExpr("analysis_id", "source AS source_path", "target AS target_path", "CAST(NULL AS STRING) AS external_module", "'imports' AS type")
    symbols = spark.createDataFrame([("r", p, k, f"{p}_{k}", "function", None) for p in names for k in range(2)], "analysis_id string, path string, ord int, name string, kind string, parent string")
    calls = [("r", a, f"{a}_0", b, f"{b}_1", f"{b}_1", None) for a, b in edges] + [("r", p, f"{p}_0", p, f"{p}_1", f"{p}_1", None) for p in names[::3]]
    calls = spark.createDataFrame(calls, "analysis_id string, source_path string, source_symbol string, target_path string, target_symbol string, callee_name string, target_parent string")
    of = symbols.where("path LIKE 'z1%' OR path LIKE 'h2%'")
    lists = impact.impact_lists(symbols, imports, calls, of)
    want = []
    for r in lists.collect():
        key = (r["path"], r["ord"])
        want += [(*key, "direct_callers", c["path"], c["symbol"]) for c in r["direct_callers"]] + [(*key, name, p, None) for name in ("affected_files", "affected_tests") for p in r[name]]
        want += [(*key, "affected_symbols", s["path"], s["name"]) for s in r["affected_symbols"]]
    got = impact.impact_entries(symbols, imports, calls, of).select("path", "ord", "list", "by_path", "by_name").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_entries_of_whole_sides_meet_as_lists(spark):
    rows = wheel()
    _, e = tables(spark, [], rows)
    imports = e.selectExpr("analysis_id", "source AS source_path", "target AS target_path", "CAST(NULL AS STRING) AS external_module", "'imports' AS type")
    symbols = spark.createDataFrame([("r", p, 0, p, "function", None) for p in sorted({x for r in rows for x in r})], "analysis_id string, path string, ord int, name string, kind string, parent string")
    calls = spark.createDataFrame([], "analysis_id string, source_path string, source_symbol string, target_path string, target_symbol string, callee_name string, target_parent string")
    got = impact.impact_entries(symbols, imports, calls, symbols)
    assert "CartesianProduct" in got._jdf.queryExecution().toString()  # not a shuffle of all pairs
    assert got.count() == 2 * sum(len(bs - {a}) for a, bs in closure(rows).items())


def wheel():
    """A ring of 40 files between 60 that lead to it and 60 that come after it, and some pairs beside it; 218 edges."""
    rows = [(f"r{i:02}", f"r{(i + 1) % 40:02}") for i in range(40)] + [(f"s{i:02}", f"r{i % 40:02}") for i in range(60)] + [(f"r{i % 40:02}", f"t{i:02}") for i in range(60)]
    return [*rows, *[(f"s{i:02}", f"x{i:02}") for i in range(0, 60, 2)], *[(f"y{i}", f"t{i:02}") for i in range(10, 38)]]


def test_a_graph_beyond_a_task_is_told_by_its_hub_and_no_pair_is_written(spark, monkeypatch):
    rows, sizes = wheel(), []
    n, e = tables(spark, sorted({x for r in rows for x in r}), rows)
    pairs = {(b, a) for a, bs in closure(rows).items() for b in bs if a != b}

    def counted(df):
        out = written(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "TASK_EDGES", 60)
    monkeypatch.setattr(graph, "written", counted)
    got = graph.affected_files(e, n.withColumnRenamed("path", "target"))
    assert "CartesianProduct" in got._jdf.queryExecution().toString()
    assert {(r["target"], r["path"]) for r in got.collect()} == pairs and got.count() == len(pairs) > 9000
    assert max(sizes) <= len(rows)  # the largest table has the edges


def test_labels_of_a_graph_beyond_a_task_take_no_more_than_that_into_one(spark, monkeypatch):
    rows, tasks, coded = wheel(), [], graph.coded
    n, e = tables(spark, sorted({x for r in rows for x in r}), rows)
    pairs = {(b, a) for a, bs in closure(rows).items() for b in bs if a != b}

    def counted(df):
        out = coded(df)
        tasks.append(out[1].count())
        return out

    monkeypatch.setattr(graph, "TASK_EDGES", 60)
    monkeypatch.setattr(graph, "coded", counted)
    labels = graph.reach_labels(e)
    assert {(r["target"], r["path"]) for r in graph.affected_by_labels(labels, n.withColumnRenamed("path", "target")).collect()} == pairs
    assert tasks[-1] <= 60 < tasks[0]


def test_a_graph_is_contracted_no_further_than_a_task_needs(spark, monkeypatch):
    rows = wheel()
    _, e = tables(spark, [], rows)
    monkeypatch.setattr(graph, "TASK_EDGES", 60)
    core, went = graph.contracted(e, True)
    assert core.count() == 40 and went == []  # the ring was not taken apart
    assert {tuple(r) for r in graph.cycle_members(e).collect()} == {("r", "r00", f"r{i:02}") for i in range(40)}
