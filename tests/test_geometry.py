from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions.geometry import Box, domain

coordinate = st.integers(0, 20).map(float)
box = st.tuples(coordinate, coordinate, coordinate, coordinate).map(lambda b: (min(b[0], b[2]), min(b[1], b[3]), max(b[0], b[2]), max(b[1], b[3])))


def frame(spark, pairs):
    return spark.createDataFrame([(*a, *b) for a, b in pairs], ", ".join(f"{p}{c} double" for p in "ab" for c in "ltrb"))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(box, box), min_size=1, max_size=40))
def test_measures_equal_cell_counts(spark, pairs):
    a, b = Box.of("a"), Box.of("b")
    got = frame(spark, pairs).select(a.iou(b), a.intersects(b), a.union(b).struct(), a.contains(b), a.overlap_x(b), a.intersection(b).l).collect()
    cells = lambda x: {(i, j) for i in range(int(x[0]), int(x[2])) for j in range(int(x[1]), int(x[3]))}
    for (x, y), row in zip(pairs, got, strict=True):
        p, q = cells(x), cells(y)
        assert abs(row[0] - (len(p & q) / len(p | q) if p & q else 0)) < 1e-12
        assert row[1] == (x[0] <= y[2] and y[0] <= x[2] and x[1] <= y[3] and y[1] <= x[3])
        assert tuple(row[2]) == (min(x[0], y[0]), min(x[1], y[1]), max(x[2], y[2]), max(x[3], y[3]))
        assert row[3] == (x[0] <= y[0] and x[1] <= y[1] and x[2] >= y[2] and x[3] >= y[3])
        assert row[4] == max(0, min(x[2], y[2]) - max(x[0], y[0]))
        assert (row[5] is None) == (not p & q)


def test_changes(spark):
    df = frame(spark, [((0.1, 0.25, 0.5, 0.5), (-5.0, 2.0, 12.5, 30.0)), ((0.0, 0.0, 1.0, 1.0), (40.0, 0.0, 50.0, 9.0))])
    a, b = Box.of("a"), Box.of("b")
    w, h = F.lit(10.0), F.lit(20.0)
    got = df.select(a.scale(w, h).struct(), b.clamp(w, h).struct(), b.expand(1, 2).struct(), a.in_unit(), b.split_x(F.lit(3.0))[1].struct(), b.pixels(w, h).struct(), domain(F.col("ar"), w)).first()
    assert [tuple(x) if hasattr(x, "l") else x for x in got] == [(1, 5, 5, 10), (0, 2, 10, 20), (-6, 0, 13.5, 32), True, (3, 2, 12.5, 30), (0, 2, 10, 20), 1.0]
    assert df.select(b.clamp(w, h).l).collect()[1][0] is None


def test_half_pixels_go_to_even(spark):
    got = spark.range(1).select(Box(F.lit(0.25), F.lit(0.75), F.lit(1.0), F.lit(1.0)).scale(F.lit(10), F.lit(10)).struct()).first()[0]
    assert (got.l, got.t) == (2, 8)
