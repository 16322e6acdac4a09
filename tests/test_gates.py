from pyspark.sql import functions as F

from kinweave.operators import linkage as ln
from kinweave.operators.components import components

from .conftest import rows


def gate(df):
    return ln.gated_classes(df, "r", F.array("n"), [("E1", F.col("x")), ("E2", F.col("y"))])


def test_evidence_beside_a_namesake_merges(spark):
    df = spark.createDataFrame([("1", "kim", "a", None), ("2", "kim", "b", None), ("3", "kim", "b", "z"), ("4", "kim", "c", "z"), ("5", "lee", "b", "z"), ("6", None, "b", "z"), ("7", "", "b", "z")], "r string, n string, x string, y string")
    merges, queue = gate(df)
    assert rows(merges) == [("2", "3", "E1", "b"), ("3", "4", "E2", "z")]
    assert rows(queue) == [("1", "2")]


def test_classes_are_the_components_of_all_pairs(spark):
    data = [(f"{i:03}", f"n{i * 7 % 3 if i % 4 else 0}", f"x{i * 13 % 29}" if i % 5 else None, f"y{i * 11 % 37}") for i in range(120)]
    merges, queue = gate(spark.createDataFrame(data, "r string, n string, x string, y string"))
    pairs = {(a[0], b[0]): (("E1", a[2]) if a[2] and a[2] == b[2] else ("E2", a[3])) for a in data for b in data if a[0] < b[0] and a[1] == b[1] and (a[2] and a[2] == b[2] or a[3] == b[3])}
    got = rows(merges)
    assert got and all(pairs[g[:2]] == g[2:] for g in got)
    want = components(spark.createDataFrame(list(pairs), "a string, b string"), "a", "b")
    roots = dict(rows(want, "id", "root"))
    assert dict(rows(components(merges, "src", "dst"), "id", "root")) == roots
    reps = {(n, min(r for r, m, *_ in data if m == n and roots.get(r, r) == k)) for n, k in {(m, roots.get(r, r)) for r, m, *_ in data}}
    assert set(rows(queue)) == {(min(x for m, x in reps if m == n), r) for n, r in reps} - {(r, r) for _, r in reps}
