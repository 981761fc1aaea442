"""Bundles of roots that lead to the same nodes: searched once, and the same as a plain search from each root."""

import pytest

from weftline.operators import graph


def plain(starts, edges, depth, max_nodes=None):
    out = {}
    for root in starts:
        order = [(root, 0)]
        for k in range(1, depth + 1):
            held = {i for i, _ in order}
            for n in [i for i, level in order if level == k - 1]:
                new = sorted({d for s, d in edges if s == n} - held)
                held |= set(new)
                order += [(d, k) for d in new]
        out[root] = order if max_nodes is None else order[:max_nodes]
    return out


def test_roots_of_a_hub_are_searched_once(spark):
    starts = [f"s{i}" for i in range(60)] + ["loop", "alone"]
    links = [(f"s{i}", f"hub{i % 2}") for i in range(60)] + [(f"hub{i % 2}", f"leaf{i}") for i in range(80)]
    links += [("loop", "hub0"), ("leaf0", "loop"), ("s0", "hub0"), ("s1", "leaf3"), ("leaf3", "hub1")]
    s, e = spark.createDataFrame([(x,) for x in starts], "id string"), spark.createDataFrame(links, "src string, dst string")
    for limit in (None, 5):
        want = plain(starts, links, 2, limit)
        found = graph.search(s, e, 2, limit)
        assert found.found.count() < 200  # one search for each kind of root, not 62
        rows = found.rows().collect()
        assert {(r.root, r.id, r.level) for r in rows} == {(root, i, k) for root, o in want.items() for i, k in o} and len(rows) == sum(map(len, want.values()))
        if limit:
            assert {(r.root, r.place, r.id) for r in rows} == {(root, p + 1, i) for root, o in want.items() for p, (i, _) in enumerate(o)}
    want, found = plain(starts, links, 2), graph.search(s, e, 2)
    sets = {root: {i for i, _ in o} for root, o in want.items()}
    assert sorted(map(tuple, found.edges(e.distinct()).collect())) == sorted({(r, a, b) for r, held in sets.items() for a, b in links if a in held and b in held})
    index = {r.id: (r.n_roots, r.first_root) for r in found.reverse_index().collect()}
    assert index == {i: (len(m), min(m)) for i in set().union(*sets.values()) for m in [[r for r in sets if i in sets[r]]]}
    assert tuple(found.totals().first()) == (62, sum(map(len, sets.values())), 2)
    gone = spark.createDataFrame([("leaf1",), ("alone",)], "id string")
    assert {r.root for r in found.affected_roots(gone).collect()} == {r for r, held in sets.items() if held & {"leaf1", "alone"}}
    uses = spark.createDataFrame([("hub0", "X", None), ("s1", "X", None), ("leaf4", "Y", None)], "src string, name string, dst string")
    lost = graph.missing(found.rows(), uses, 2)
    assert sorted(map(tuple, found.missing(uses, 2).collect())) == sorted(map(tuple, lost.collect()))


def test_many_roots_meet_in_slices(spark, monkeypatch):
    s = spark.createDataFrame([(f"s{i}",) for i in range(40)], "id string")
    e = spark.createDataFrame([(f"s{i}", "hub") for i in range(40)] + [("hub", f"l{i}") for i in range(9)], "src string, dst string")
    found = graph.search(s, e, 2)
    monkeypatch.setattr(graph, "MAX_ROOTS", 7)
    monkeypatch.setattr(graph, "TASK_ROWS", 50)
    rows = found.rows()
    assert rows.count() == rows.distinct().count() == 40 * 11


def test_rows_of_a_hub_are_cut_into_runs(spark, monkeypatch):
    starts = [f"s{i}" for i in range(20)]
    links = [(f"s{i}", f"hub{i % 2}") for i in range(20)] + [(f"hub{i % 2}", f"leaf{i}") for i in range(70)]
    found = graph.search(spark.createDataFrame([(x,) for x in starts], "id string"), spark.createDataFrame(links, "src string, dst string"), 2)
    monkeypatch.setattr(graph, "BLOCK_ROWS", 10)
    monkeypatch.setattr(graph, "RUN_ROWS", 4)
    monkeypatch.setattr(graph, "TASK_ROWS", 50)
    want = sorted((root, i, k) for root, o in plain(starts, links, 2).items() for i, k in o)
    assert sorted((r.root, r.id, r.level) for r in found.rows().collect()) == want
    edges = found.edges(spark.createDataFrame(links, "src string, dst string").distinct())
    assert sorted(map(tuple, edges.collect())) == sorted((root, a, b) for root in starts for a, b in links if a == root or (root, a) in links)


@pytest.mark.parametrize("kind", ["rows", "edges"])
def test_files_of_a_hub_take_little(spark, tmp_path, kind):
    """20000 roots of one hub with 100 leaves: a column repeats in runs, so that a row takes a fraction of a byte."""
    s = spark.range(20000).selectExpr("concat('supplier:', id * 37) as id")
    e = s.selectExpr("id as src", "'hub' as dst").union(spark.range(100).selectExpr("'hub'", "concat('customer:', id * 7919)"))
    found = graph.search(s, e, 2)
    out = found.rows().select("root", "id", "level") if kind == "rows" else found.edges(e)
    out.write.parquet(str(tmp_path / "out"))
    n = spark.read.parquet(str(tmp_path / "out")).count()
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert n == 20000 * (102 if kind == "rows" else 101) and size < 0.6 * n
