import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dagwright import graph
from dagwright.graph import Dag


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_formulas():
    assert Dag.parse("~A+B|C", "ABC").arcs == {("C", "B")}
    d = Dag.parse("~a|b:c + b|c:d + a|e:f", "abcdef")
    assert d.parents("a") == ["b", "c", "e", "f"] and d.parents("b") == ["c", "d"]
    assert Dag.parse("~a|.", "abcdef").parents("a") == list("bcdef")
    assert Dag.parse("~b1|b10", ["b1", "b10"]).arcs == {("b10", "b1")}
    for bad in ("~a|b+b|a", "a|b", "~a|z"):
        with pytest.raises(ValueError):
            Dag.parse(bad, "ab")


def test_matrix():
    d = Dag.parse("~a|b", "ab")
    assert d.matrix() == [[0, 1], [0, 0]] and Dag.from_matrix(d.matrix(), "ab") == d
    with pytest.raises(ValueError):
        Dag.from_matrix([[0, 0.5], [0, 0]], "ab")
    assert Dag.from_masks(d.masks(), "ab") == d


def test_blanket(spark):
    d = Dag.parse("~ f|e:a + e|c + c|a:b + d|b", "abcdef")
    e = d.edges(spark)
    blanket = lambda *n: {r[0] for r in graph.markov_blanket(e, n).collect()}
    assert blanket("b") == {"a", "c", "d"}
    assert blanket("e") == {"a", "c", "f"}


def test_summary(spark):
    n = graph.node_frame(spark, "abcdef")
    one = graph.summary(Dag.parse("~b|a+c|a", "abcdef").edges(spark), n).first()
    assert one["n_arcs"] == 2 and one["mb_average"] == 1 and abs(one["nh_average"] - 2 / 3) < 1e-12
    two = graph.summary(Dag.parse("~b|a+c|a+d|a", "abcdef").edges(spark), n).first()
    assert two["n_arcs"] == 3 and two["mb_average"] == 2 and two["parent_average"] == 0.5


def test_compare(spark):
    a1 = Dag.from_matrix([[0, 1, 1], [0, 0, 0], [0, 0, 0]], "abc").edges(spark)
    a2 = Dag.from_matrix([[0, 1, 1], [0, 0, 1], [0, 0, 0]], "abc").edges(spark)
    b = Dag.from_matrix([[0, 1, 1], [0, 0, 0], [0, 1, 0]], "abc").edges(spark)
    none = Dag.of("abc").edges(spark)
    x, y, z = graph.compare(a1, b, 3).first(), graph.compare(a2, b, 3).first(), graph.compare(none, b, 3).first()
    assert x["hamming"] == 1 and x["tpr"] == 1 and abs(x["ppv"] - 2 / 3) < 1e-12
    assert y["hamming"] == 1 and abs(y["ppv"] - 2 / 3) < 1e-12 and abs(y["fdr"] - 1 / 3) < 1e-12 and abs(y["tpr"] - 2 / 3) < 1e-12
    assert z["hamming"] == 3 and z["tpr"] is None


def test_essential(spark):
    eg = lambda f, n, k="minimal": pairs(graph.essential_graph(Dag.parse(f, n).edges(spark), k))
    assert eg("~a|b+c|b", "abc") == eg("~b|a+c|b", "abc")
    assert eg("~a|b:c+b|c", "abc") == {("b", "a"), ("c", "a"), ("c", "b"), ("b", "c")}
    f = "~f|e:a + e|c + c|a:b + d|b"
    assert eg(f, "abcdef") == {("e", "f"), ("a", "f"), ("c", "e"), ("e", "c"), ("a", "c"), ("b", "c"), ("b", "d"), ("d", "b")}
    assert eg(f, "abcdef", "completed") == {("e", "f"), ("a", "f"), ("c", "e"), ("a", "c"), ("b", "c"), ("b", "d"), ("d", "b")}


arcs = st.sets(st.tuples(st.integers(0, 4), st.integers(0, 4)).filter(lambda p: p[0] != p[1]), max_size=12)


@settings(max_examples=60, deadline=None)
@given(arcs)
def test_cycles_are_found_and_broken(found):
    nodes = [str(i) for i in range(5)]
    d = Dag.of(nodes, [(str(a), str(b)) for a, b in found], acyclic=False)
    reach = {(a, b) for a, b in d.arcs}
    for k, i, j in itertools.product(nodes, repeat=3):
        if (i, k) in reach and (k, j) in reach:
            reach.add((i, j))
    assert d.has_cycle() == any((n, n) in reach for n in nodes)
    fixed = d.without_cycles()
    assert not fixed.has_cycle() and fixed.arcs <= d.arcs and (d.has_cycle() or fixed == d)
