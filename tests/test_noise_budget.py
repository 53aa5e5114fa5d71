"""The budget of noise: points are met only where they can matter, and travel packed."""

import numpy as np
from pyspark.sql import functions as F

from granella.operators import geometry as G
from granella.plans import drawings as W


def test_pages_full_of_diagonals_meet_no_points(spark, monkeypatch):
    # a: diagonal lines fill the budget; b and the lines without a page: they don't; a line without an end is diagonal too
    lines = [("a", i, 10.0 * i, 10.0, 10.0 * i + 40, 60.0 if i % 2 else 10.0) for i in range(12)] + [("b", i, 10.0, 10.0 * i, 60.0, 10.0 * i) for i in range(9)]
    lines += [("b", 20, 5.0, 5.0, 50.0, 60.0), ("a", -1, None, 1.0, 2.0, 2.0), (None, 7, 1.0, 1.0, 60.0, 80.0), ("a", 3, 30.0, 10.0, 70.0, 60.0)]
    points = [(p, 10.0 + i, 20.0 + i, "texts") for p in "ab" for i in range(30)]
    s = spark.createDataFrame(lines, "page string, idx int, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame(points, "page string, px double, py double, what string")
    met, near_counts = [], G.near_counts

    def seen(segments, points, *args, **kwargs):
        met.append({r[0] for d in (segments, points) for r in d.select("page").collect()})
        return near_counts(segments, points, *args, **kwargs)

    monkeypatch.setattr(G, "near_counts", seen)
    got = W.noise(s, p, 5)
    assert met == [{"b", None}]
    rank = F.array_position(F.array(*map(F.lit, G.NOISE)), F.col("bucket"))
    want = G.budget(W.classified(s, p).filter(F.col("bucket").isin(*G.NOISE)), [rank, F.col("idx")], 5).select("page", "idx", "bucket")
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert rows(got) == rows(want)
    assert {r[2] for r in rows(got) if r[0] == "b"} > {G.DIAGONAL}


def test_points_travel_packed(spark):
    points = spark.range(0, 40000, 1, 2).selectExpr("cast(id % 3 as string) as page", "cast(id * 7 % 600 as double) as px", "case when id = 5 then double('nan') else id * 11 % 500 - 100.5 end as py", "cast(id % 2 as int) as _k")
    packed = G._packed(points, 256.0, "page").collect()
    assert len(packed) < 400 and max(len(r["_k"]) for r in packed) <= G.PACKED
    got = sorted((r["page"], r["_gx"], r["_gy"], *v) for r in packed for v in zip(*(np.frombuffer(r[c], t).tolist() for c, t in (("_px", float), ("_py", float), ("_k", np.int8))), strict=True))
    assert got == sorted((r["page"], int(r["px"] // 256), int(r["py"] // 256), r["px"], r["py"], r["_k"]) for r in points.collect() if r["py"] == r["py"])
