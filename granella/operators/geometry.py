"""Vector geometry as relations: segments, buckets, merged walls, closed cells, adjacency, components, composites.

Everything is keyed by (doc/)page; joins of a page's elements with each other
carry a grid cell as an equality key, so no page's elements meet all pairwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def orientation(x0: Column, y0: Column, x1: Column, y1: Column, tolerance: float = 0.5) -> Column:
    dx, dy = F.abs(x1 - x0), F.abs(y1 - y0)
    return F.when((dx <= tolerance) & (dy <= tolerance), "ponto").when(dy <= tolerance, "horizontal").when(dx <= tolerance, "vertical").otherwise("diagonal")


def length(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.round(F.hypot(x1 - x0, y1 - y0), 3)


def point_segment_distance2(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Squared distance of a point from a segment; a segment without length is a point."""
    dx, dy = x1 - x0, y1 - y0
    n = dx * dx + dy * dy
    t = F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.greatest(((px - x0) * dx + (py - y0) * dy) / n, F.lit(0.0)), F.lit(1.0)))
    ex, ey = px - (x0 + t * dx), py - (y0 + t * dy)
    return ex * ex + ey * ey


class _Near:
    """Points of one tile, to count those within a radius of segments without meeting them one by one.

    Of every line of points with the same y, a segment's surroundings hold one
    interval of x, as they are convex. What lies inside by more than a rounding
    error is counted by places in the sorted points; what lies on the margin is
    judged by the formula of point_segment_distance2.
    """

    def __init__(self, px: np.ndarray, py: np.ndarray, kind: np.ndarray, kinds: int):
        self.xs, column = np.unique(px, return_inverse=True)
        self.ys, row = np.unique(py, return_inverse=True)
        key = row.astype(np.int64) * len(self.xs) + column
        o = np.argsort(key, kind="stable")
        self.px, self.py, self.kind, self.key, self.kinds = px[o], py[o], kind[o], key[o], kinds
        size = len(self.xs) * len(self.ys) + 1
        self.upto = None
        if size <= max(1 << 18, 8 * len(px)):  # places of all keys
            self.upto = np.concatenate(([0], np.cumsum(np.bincount(self.key, minlength=size))))
        self.sums = np.zeros((kinds, len(px) + 1), np.int64)
        for k in range(kinds):
            np.cumsum(self.kind == k, out=self.sums[k, 1:])
        self.below = self.sums if self.upto is None else self.sums[:, self.upto]
        self.rank = None
        if np.all(self.xs == np.floor(self.xs)) and self.xs[-1] - self.xs[0] < 1 << 20 and abs(self.xs[0]) < 1 << 50:  # places of whole numbers
            self.rank = np.searchsorted(self.xs, self.xs[0] + np.arange(int(self.xs[-1] - self.xs[0]) + 2))

    def _place(self, key: np.ndarray) -> np.ndarray:
        return self.upto[key] if self.upto is not None else np.searchsorted(self.key, key)

    def _column(self, v: np.ndarray, after: bool) -> np.ndarray:
        """How many xs are below v; after: or equal to it."""
        if self.rank is None:
            return np.searchsorted(self.xs, v, side="right" if after else "left")
        whole = np.floor(v) + (1 - self.xs[0]) if after else np.ceil(v) - self.xs[0]
        return self.rank[np.minimum(np.maximum(whole, 0), len(self.rank) - 1).astype(np.int64)]

    def counts(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, radius: float) -> np.ndarray:
        """Of each segment and kind, the points within the radius. |dy| <= |dx|."""
        out = np.zeros((self.kinds, len(x0)), np.int64)
        scale = max([radius, 1.0, *(float(np.abs(v).max(initial=0)) for v in (self.xs, self.ys, x0, y0, x1, y1))])
        eps = 1e-6 * scale
        level = (y0 == y1) & (scale < 1e6 * radius)
        for own, interval in ((level, _level_intervals), (~level, _intervals)):
            at = np.flatnonzero(own)
            ends = tuple(v[at] for v in (x0, y0, x1, y1))
            first = np.searchsorted(self.ys, np.minimum(ends[1], ends[3]) - radius - eps)
            rows = np.searchsorted(self.ys, np.maximum(ends[1], ends[3]) + radius + eps, side="right") - first
            upto = np.cumsum(rows)
            lo = 0
            while lo < len(at):  # some hundred thousand lines of points at once
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 100_000, side="right")))
                out[:, at[lo:hi]] = self._some(first[lo:hi], rows[lo:hi], tuple(v[lo:hi] for v in ends), interval, radius, eps, scale)
                lo = hi
        return out

    def _some(self, first, rows, ends, interval, radius, eps, scale) -> np.ndarray:
        out = np.zeros((self.kinds, len(rows)), np.int64)
        seg = np.repeat(np.arange(len(rows)), rows)
        if not len(seg):
            return out
        row = np.arange(len(seg)) + np.repeat(first - (np.cumsum(rows) - rows), rows)
        x0, y0, x1, y1 = ends = tuple(v[seg] for v in ends)
        a, b, c, d = interval(self.ys[row], *ends, radius, eps, scale)
        base = row * len(self.xs)
        ol, oh = base + self._column(a, False), base + self._column(b, True)
        il, ih = base + self._column(c, False), base + self._column(d, True)
        oh = np.maximum(ol, oh)
        il = np.minimum(np.maximum(il, ol), oh)
        ih = np.minimum(np.maximum(ih, il), oh)
        margins = [(np.flatnonzero(x < y), x, y) for x, y in ((ol, il), (ih, oh))]
        if self.upto is None:
            il, ih = self._place(il), self._place(ih)
        for k in range(self.kinds):
            out[k] += np.bincount(seg, weights=self.below[k][ih] - self.below[k][il], minlength=len(rows)).astype(np.int64)
        for some, start, end in margins:
            start, end = self._place(start[some]), self._place(end[some])
            met = end > start
            some, start, n = some[met], start[met], (end - start)[met]
            upto = np.cumsum(n)
            at = 0
            while at < len(some):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 400_000, side="right")))
                s, m = some[at:to], n[at:to]
                p = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[at:to], m)
                s = np.repeat(s, m)
                inside = _distance2(self.px[p], self.py[p], x0[s], y0[s], x1[s], y1[s]) <= radius * radius
                for k in range(self.kinds):
                    out[k] += np.bincount(seg[s[inside & (self.kind[p] == k)]], minlength=len(rows))
                at = to
        return out


def _distance2(px, py, x0, y0, x1, y1) -> np.ndarray:
    """point_segment_distance2 of arrays, operation by operation."""
    dx, dy = x1 - x0, y1 - y0
    n = dx * dx + dy * dy
    with np.errstate(all="ignore"):
        t = np.where(n == 0, 0.0, np.minimum(np.maximum(((px - x0) * dx + (py - y0) * dy) / n, 0.0), 1.0))
    ex, ey = px - (x0 + t * dx), py - (y0 + t * dy)
    return ex * ex + ey * ey


def _interval(y, x0, y0, x1, y1, dx, dy, r) -> tuple[np.ndarray, np.ndarray]:
    """Where the points within r of a segment begin and end on the line at y; inf and -inf where there are none."""
    low, high = np.full(len(y), np.inf), np.full(len(y), -np.inf)
    if r < 0:
        return low, high
    with np.errstate(all="ignore"):
        for cx, cy in ((x0, y0), (x1, y1)):
            half = np.sqrt(r * r - (y - cy) * (y - cy))  # nan: not met
            low, high = np.fmin(low, cx - half), np.fmax(high, cx + half)
        up, n = dy * (y - y0), dx * dx + dy * dy
        # between the ends: the foot of the perpendicular lies on the segment, and it is no longer than r
        a, b = x0 - up / dx, x0 + (n - up) / dx
        a, b = np.minimum(a, b), np.maximum(a, b)
        c, d = x0 + (dx * (y - y0) - r * np.sqrt(n)) / dy, x0 + (dx * (y - y0) + r * np.sqrt(n)) / dy
        c, d = np.minimum(c, d), np.maximum(c, d)
        near = np.abs(y - y0) <= r
        c, d = np.where(dy == 0, np.where(near, -np.inf, np.inf), c), np.where(dy == 0, np.where(near, np.inf, -np.inf), d)
        a, b = np.maximum(a, c), np.minimum(b, d)
        ok = (a <= b) & (dx != 0)
    return np.where(ok, np.minimum(low, a), low), np.where(ok, np.maximum(high, b), high)


def _intervals(y, x0, y0, x1, y1, radius, eps, scale) -> tuple[np.ndarray, ...]:
    """On the line at y, where the points begin and end that may be within the radius, and those that surely are."""
    dx, dy = x1 - x0, y1 - y0
    return *_interval(y, x0, y0, x1, y1, dx, dy, radius + eps), *_interval(y, x0, y0, x1, y1, dx, dy, radius - eps)


def _level_intervals(y, x0, y0, x1, y1, radius, eps, scale) -> tuple[np.ndarray, ...]:
    """_intervals of level segments. Between their ends the distance is that of y, without rounding."""
    low, high, d2 = np.minimum(x0, x1), np.maximum(x0, x1), (y - y0) * (y - y0)
    out = np.sqrt(np.maximum((radius + eps) * (radius + eps) - d2, 0.0))
    inner = (radius - eps) * (radius - eps) - d2
    by = np.where(inner >= 0, np.sqrt(np.maximum(inner, 0.0)), np.where(d2 <= radius * radius, -eps, -np.inf))
    return low - out, high + out, low - by, high + by


def _tile_counts(points, segments, radius: float, kinds: int) -> np.ndarray:
    """Counts of a tile. points: (x, y, kind), or two _Near of them, made when first needed, in a dict; segments: their ends."""
    x0, y0, x1, y1 = segments
    out = np.zeros((kinds, len(x0)), np.int64)
    real = np.isfinite(x0) & np.isfinite(y0) & np.isfinite(x1) & np.isfinite(y1)
    flat = np.abs(y1 - y0) <= np.abs(x1 - x0)
    px, py, kind = points["all"]
    for name, own, swap in (("flat", flat & real, False), ("steep", ~flat & real, True)):
        at = np.flatnonzero(own)
        if len(at) and len(px):
            if name not in points:
                points[name] = _Near(py, px, kind, kinds) if swap else _Near(px, py, kind, kinds)
            a, b, c, d = (v[at] for v in segments)
            out[:, at] = points[name].counts(b, a, d, c, radius) if swap else points[name].counts(a, b, c, d, radius)
    return out


#: Fixed value: points of a tile in one packed row.
PACKED = 1024


def _packed(points: DataFrame, grid: float, page: str) -> DataFrame:
    """(page, _gx, _gy, _px, _py, _k): points (page, px, py, _k) as bytes of 8, 8 and 1 each, up to PACKED of a tile in a row. Points that are nowhere are left out."""

    def rows(held):
        t = pa.Table.from_batches(held)
        px, py, kind = (t.column(c).to_numpy() for c in ("px", "py", "_k"))
        pages = t.column(page).combine_chunks().dictionary_encode()
        code = pages.indices.to_numpy(zero_copy_only=False)
        real = np.flatnonzero(np.isfinite(px) & np.isfinite(py))
        if not len(real):
            return
        gx, gy = (np.floor(v / grid).astype(np.int64) for v in (px[real], py[real]))
        o = np.lexsort((gy, gx, code[real]))
        key, o = [code[real][o], gx[o], gy[o]], real[o]
        new = np.ones(len(o), bool)
        new[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])
        place = np.arange(len(o))
        start = np.flatnonzero(new | ((place - np.maximum.accumulate(np.where(new, place, 0))) % PACKED == 0))
        ends = np.append(start, len(o))
        blob = lambda v: pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((ends * v.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(v[o]))])
        yield pa.RecordBatch.from_arrays([pages.dictionary.take(pa.array(key[0][start])), pa.array(key[1][start]), pa.array(key[2][start]), blob(px), blob(py), blob(kind.astype(np.int8))], names=[page, "_gx", "_gy", "_px", "_py", "_k"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= 500_000:
                yield from rows(held)
                held, n = [], 0
        if n:
            yield from rows(held)

    return points.mapInArrow(run, T.StructType([T.StructField(page, points.schema[page].dataType), *(T.StructField(c, T.LongType()) for c in ("_gx", "_gy")), *(T.StructField(c, T.BinaryType()) for c in ("_px", "_py", "_k"))]))


def near_counts(segments: DataFrame, points: DataFrame, radius: float, grid: float = 256.0, page: str = "page", kinds: tuple[str, ...] = ()) -> DataFrame:
    """segments with how many of their page's points (px, py) lie within radius; with kinds, of each value of points' column ``what``, as columns of that name.

    A segment is dealt to the tiles that its box, grown by the radius, covers; a
    point has one tile, so nothing is counted twice. Points travel packed, many of a
    tile in a row. A tile's points are read first, then its segments go by in batches: their points are counted by intervals
    of sorted points, so no segment meets all points of its surroundings. One
    grouping adds up the tiles' counts; rows that repeat are one segment.
    """
    names = list(kinds) or ["near"]
    tile = lambda c: F.floor(c / grid)
    xs = F.sequence(tile(F.least("x0", "x1") - radius), tile(F.greatest("x0", "x1") + radius))
    ys = F.sequence(tile(F.least("y0", "y1") - radius), tile(F.greatest("y0", "y1") + radius))
    own = segments.columns
    what = F.coalesce(*(F.when(F.col("what") == k, i) for i, k in enumerate(kinds))) if kinds else F.lit(0)
    spots = points.filter(F.col(page).isNotNull() & F.col("px").isNotNull() & F.col("py").isNotNull()).select(F.col(page).cast(segments.schema[page].dataType).alias(page), F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"), what.alias("_k")).filter("_k >= 0")
    dealt = segments.select("*", F.explode_outer(xs).alias("_gx")).select("*", F.explode_outer(ys).alias("_gy"), F.lit(True).alias("_seg"), *(F.lit(None).cast("binary").alias(c) for c in ("_px", "_py", "_k")))
    empty = [F.lit(None).cast(segments.schema[c].dataType).alias(c) for c in own if c != page]
    both = dealt.unionByName(_packed(spots, grid, page).select("*", F.lit(False).alias("_seg"), *empty))
    key = [page, "_gx", "_gy"]
    # one number to sort by: tiles by their hash, a tile's points before its segments; tiles of the same hash may be mixed
    number = F.xxhash64(*key).bitwiseAND(F.lit(-2)).bitwiseOR(F.col("_seg").cast("bigint"))
    ordered = both.withColumn("_h", number).repartition(*key).sortWithinPartitions("_h")

    def run(batches):
        last, tiles = None, {}
        for b in batches:
            if not b.num_rows:
                continue
            codes = [b.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in key]
            hashes = b.column("_h").to_numpy(zero_copy_only=False)
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for c in (*codes, hashes):
                new[1:] |= c[1:] != c[:-1]
            cut = np.flatnonzero(new)  # a run is one tile's points or one tile's segments
            counts = np.zeros((len(names), b.num_rows), np.int64)
            ends = [b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x0", "y0", "x1", "y1")]
            for lo, hi in zip(cut, np.append(cut[1:], b.num_rows), strict=True):
                if (now := int(hashes[lo]) & -2) != last:
                    last, tiles = now, {}
                points = tiles.setdefault(tuple(b.column(c)[int(lo)].as_py() for c in key), {"parts": []})
                if not hashes[lo] & 1:
                    points["parts"] += zip(*([np.frombuffer(v, t) for v in b.column(c)[int(lo) : int(hi)].to_pylist()] for c, t in (("_px", float), ("_py", float), ("_k", np.int8))), strict=True)
                elif points["parts"]:
                    if "all" not in points:
                        points["all"] = [np.concatenate(x) for x in zip(*points["parts"], strict=True)]
                    counts[:, lo:hi] = _tile_counts(points, [v[lo:hi] for v in ends], radius, len(names))
            some = pa.array(np.flatnonzero(hashes & 1))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(some) for c in own), *(pa.array(x).take(some) for x in counts)], names=[*own, *names])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in segments.schema.fields] + [T.StructField(n, T.LongType()) for n in names])
    return ordered.mapInArrow(run, schema).groupBy(*own).agg(*(F.sum(n).alias(n) for n in names))


#: Buckets of lines, their reasons, and limits of classes.
WALL, AXIS, DIAGONAL, THIN, SHORT, TEXT_NEAR, TITLE = "wall_candidates", "axis_aligned_segments", "diagonal_segments", "thin_noise", "short_noise", "text_nearby_noise", "titleblock_or_legend_noise"
NOISE = (DIAGONAL, TITLE, TEXT_NEAR, SHORT, THIN)
LEAST_WALL, LEAST_POINT, TITLE_SHARE, NEAR_RADIUS, MOST_TEXTS, MOST_RECTS = 10.0, 0.5, 0.72, 12.0, 4, 3
IS_POINT, NO_LENGTH, TOO_SHORT, IS_DIAGONAL, IN_TITLE, NEAR_TITLE, AMONG_TEXTS, IS_WALL = (
    "orientation_point", "length_near_zero", "length_below_min_length_wall", "orientation_diagonal", "inside_titleblock_region_strong", "inside_titleblock_region_suspect", "near_text_density", "axis_aligned_long_segment",
)


def title_block(cx: Column, cy: Column, width: Column | float, height: Column | float) -> tuple[Column, Column]:
    """Whether a place is in the page's lower right corner, and whether it is in its right or lower band only."""
    right, low = cx > F.lit(TITLE_SHARE) * width, cy > F.lit(TITLE_SHARE) * height
    return right & low, (right | low) & ~(right & low)


def classify(seg_length: Column, kind: Column, cx: Column, cy: Column, texts: Column, rects: Column, width: Column | float = 1000.0, height: Column | float = 1000.0) -> Column:
    """(bucket, reason) of a line: the first rule that holds. texts and rects: how many are near."""
    strong, suspect = title_block(cx, cy, width, height)
    pair = lambda b, r: F.struct(F.lit(b).alias("bucket"), F.lit(r).alias("reason"))
    return (
        F.when(kind == "ponto", pair(THIN, IS_POINT))
        .when(seg_length < LEAST_POINT, pair(THIN, NO_LENGTH))
        .when(seg_length < LEAST_WALL, pair(SHORT, TOO_SHORT))
        .when(kind == "diagonal", pair(DIAGONAL, IS_DIAGONAL))
        .when(strong, pair(TITLE, IN_TITLE))
        .when(suspect & ((texts >= MOST_TEXTS) | (rects >= MOST_RECTS)), pair(TITLE, NEAR_TITLE))
        .when(texts >= MOST_TEXTS, pair(TEXT_NEAR, AMONG_TEXTS))
        .otherwise(pair(WALL, IS_WALL))
    )


def long_axis_line(seg_length: Column, kind: Column) -> Column:
    """What the layer of axis-parallel lines shows, whatever its bucket."""
    return kind.isin("horizontal", "vertical") & (seg_length >= LEAST_WALL)


def shapes_outside_title(shapes: DataFrame, width: float, height: float) -> DataFrame:
    """Rectangles and curves (kind rect or curve, x0, top, x1, bottom) whose centre isn't in the title block, with bucket and reason."""
    strong, _ = title_block((F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2, width, height)
    return shapes.filter(~strong).withColumns({"bucket": F.concat(F.col("kind"), F.lit("_candidates")), "reason": F.concat(F.col("kind"), F.lit("_outside_titleblock"))})


def budget(items: DataFrame, order: list, limit: int, page: str = "page") -> DataFrame:
    """A shared budget of a page's items, used up in the given order."""
    return items.withColumn("_n", F.row_number().over(Window.partitionBy(page).orderBy(*order))).filter(F.col("_n") <= limit).drop("_n")


def merge_segments(segments: DataFrame, tolerance: float = 2.0, page: str = "page") -> DataFrame:
    """Axis-parallel segments (page, orient, pos, start, end) chained by position, then by extent: gaps and islands twice.

    Positions that follow each other within the tolerance are one group, at
    their mean; within it, segments that overlap or leave a gap within the
    tolerance are one.
    """
    w = Window.partitionBy(page, "orient").orderBy("pos")
    jump = (F.col("pos") - F.lag("pos").over(w) > tolerance).cast("int")
    run = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = segments.withColumn("_j", F.coalesce(jump, F.lit(0))).withColumn("g", F.sum("_j").over(run)).drop("_j")
    v = Window.partitionBy(page, "orient", "g").orderBy("start", "end", "pos")
    reach = F.max("end").over(v.rowsBetween(Window.unboundedPreceding, -1))
    broken = F.coalesce((F.col("start") > reach + tolerance).cast("int"), F.lit(0))
    islands = grouped.withColumn("_b", broken).withColumn("i", F.sum("_b").over(v.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    mean = Window.partitionBy(page, "orient", "g")
    return islands.withColumn("_p", F.avg("pos").over(mean)).groupBy(page, "orient", "g", "i").agg(F.round(F.first("_p"), 3).alias("pos"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("sources")).drop("g", "i")


def _covered(walls: DataFrame, gaps: DataFrame, snap: float, grid: float, page: str) -> DataFrame:
    """(page, pos, lo, hi, sources): gaps (page, lo, hi) that a wall (page, pos, start, end) covers. Walls meet gaps by the strips that they run through."""
    strip = lambda c: F.floor(c / grid)
    dealt = walls.select(page, "pos", "start", "end", "sources", F.explode(F.sequence(strip(F.col("start") - snap), strip(F.col("end") + snap))).alias("k"))
    met = dealt.join(gaps.withColumn("k", strip(F.col("lo"))), [page, "k"]).filter((F.col("start") <= F.col("lo") + snap) & (F.col("end") >= F.col("hi") - snap))
    return met.groupBy(page, "pos", "lo", "hi").agg(F.max("sources").alias("sources"))


def closed_cells(merged: DataFrame, snap: float = 2.0, grid: float = 64.0, page: str = "page") -> DataFrame:
    """Rectangles between consecutive wall positions of both directions whose four sides are covered by a merged segment, with the segments behind each side.

    Only gaps that a wall covers are tops; bottoms and sides are found by
    equality. So a page's columns and rows never meet all pairwise.
    """
    pos = merged.select(page, "orient", "pos").distinct()
    nxt = pos.withColumn("next", F.lead("pos").over(Window.partitionBy(page, "orient").orderBy("pos"))).filter("next is not null")
    gap = lambda o: nxt.filter(F.col("orient") == o).select(page, F.col("pos").alias("lo"), F.col("next").alias("hi"))
    wall = lambda o: merged.filter(F.col("orient") == o).select(page, "pos", "start", "end", "sources")
    flat, upright = _covered(wall("h"), gap("v"), snap, grid, page), _covered(wall("v"), gap("h"), snap, grid, page)
    side = lambda d, at, lo, hi, name: d.select(page, F.col("pos").alias(at), F.col("lo").alias(lo), F.col("hi").alias(hi), F.col("sources").alias(name))
    cells = side(flat, "top", "left", "right", "top_sources").join(gap("h").withColumnsRenamed({"lo": "top", "hi": "bottom"}), [page, "top"])
    cells = cells.join(side(flat, "bottom", "left", "right", "bottom_sources"), [page, "bottom", "left", "right"])
    for at in ("left", "right"):
        cells = cells.join(side(upright, at, "top", "bottom", f"{at}_sources"), [page, at, "top", "bottom"])
    rn = F.row_number().over(Window.partitionBy(page).orderBy("top", "left"))
    return cells.withColumn("cell", rn).withColumn("area", F.round((F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top")), 3))


def adjacency(cells: DataFrame, tolerance: float = 2.0, grid: float = 64.0, page: str = "page") -> DataFrame:
    """(page, src, dst), src < dst: cells that touch on one axis and overlap by max(tolerance, a quarter of the smaller) on the other.

    Touching sides meet by grid line: the right (bottom) side of one and the
    left (top) side of the other lie in the same strip or in neighbouring ones.
    """
    a = cells.select(page, *(F.col(c).alias(f"a_{c}") for c in ("cell", "left", "right", "top", "bottom")))
    b = cells.select(page, *(F.col(c).alias(f"b_{c}") for c in ("cell", "left", "right", "top", "bottom")))
    out = []
    for near, far, lo, hi in (("right", "left", "top", "bottom"), ("bottom", "top", "left", "right")):
        strip = lambda c: F.floor(c / grid)
        x = a.withColumn("k", F.explode(F.array_distinct(F.array(*(strip(F.col(f"a_{near}") + d) for d in (-tolerance, tolerance))))))
        y = b.withColumn("k", strip(F.col(f"b_{far}")))
        overlap = F.least(f"a_{hi}", f"b_{hi}") - F.greatest(f"a_{lo}", f"b_{lo}")
        small = F.least(F.col(f"a_{hi}") - F.col(f"a_{lo}"), F.col(f"b_{hi}") - F.col(f"b_{lo}"))
        ok = (F.abs(F.col(f"a_{near}") - F.col(f"b_{far}")) <= tolerance) & (overlap >= F.greatest(F.lit(tolerance), small * 0.25)) & (F.col("a_cell") != F.col("b_cell"))
        out.append(x.join(y, [page, "k"]).filter(ok).select(page, F.least("a_cell", "b_cell").alias("src"), F.greatest("a_cell", "b_cell").alias("dst")))
    return out[0].union(out[1]).distinct()


def page_components(cells: DataFrame, edges: DataFrame, page: str = "page") -> DataFrame:
    """(page, cell, component): the smallest cell that adjacency reaches. One union-find for each page, whose cells are few by nature."""
    import pandas as pd

    rows = cells.select(page, F.col("cell").alias("src"), F.col("cell").alias("dst")).union(edges.select(page, "src", "dst"))

    def components(pdf: pd.DataFrame) -> pd.DataFrame:
        up = {c: c for c in pdf["src"]}

        def root(c):
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        for s, d in zip(pdf["src"], pdf["dst"], strict=True):
            a, b = sorted((root(s), root(d)))
            up[b] = a
        cs = sorted(up)
        return pd.DataFrame({page: pdf[page].iloc[0], "cell": cs, "component": [root(c) for c in cs]})

    return rows.groupBy(page).applyInPandas(components, f"{page} {cells.schema[page].dataType.simpleString()}, cell int, component int")


#: Reasons to reject a composite, and its limits.
SINGLE, MANY, SPARSE, WIDE, HIGH = "single_cell_component", "too_many_cells", "fill_ratio_below_min", "width_above_page_ratio", "height_above_page_ratio"
MOST_CELLS, LEAST_COMPOSITE_SIDE, LEAST_COMPOSITE_AREA, LEAST_FILL, MOST_COMPOSITE_SHARE, MOST_COMPOSITE_SIDE = 200, 20.0, 400.0, 0.05, 0.25, 0.5


def composite_reason(cells: Column, w: Column, h: Column, fill: Column, width: float, height: float, lone: Column | None = None) -> Column:
    """The first reason to reject a component of cells, or the empty string. lone: single cells that are regions themselves."""
    single = cells < 2 if lone is None else (cells < 2) & ~lone
    area = F.round(w * h, 3)
    return (
        F.when(single, SINGLE).when(cells > MOST_CELLS, MANY).when(w < LEAST_COMPOSITE_SIDE, NARROW).when(h < LEAST_COMPOSITE_SIDE, FLAT).when(area < LEAST_COMPOSITE_AREA, SMALL).when(fill < LEAST_FILL, SPARSE)
        .when(area > MOST_COMPOSITE_SHARE * width * height, LARGE).when(F.round(w / width, 4) > MOST_COMPOSITE_SIDE, WIDE).when(F.round(h / height, 4) > MOST_COMPOSITE_SIDE, HIGH).otherwise("")
    )


def composites(cells: DataFrame, components_: DataFrame, edges: DataFrame, width: float = 1000.0, height: float = 1000.0, page: str = "page") -> DataFrame:
    """Union box, fill ratio, cells and edges of each component, with the first reason to reject it."""
    c = cells.join(components_, [page, "cell"])
    box = c.groupBy(page, "component").agg(F.count("*").alias("cells"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.sum("area").alias("covered"))
    e = edges.join(components_.withColumnRenamed("cell", "src"), [page, "src"]).groupBy(page, "component").agg(F.count("*").alias("edges"))
    got = box.join(e, [page, "component"], "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    w, h = F.round(F.col("right") - F.col("left"), 3), F.round(F.col("bottom") - F.col("top"), 3)
    got = got.withColumn("fill", F.when(w * h > 0, F.round(F.col("covered") / (w * h), 4)).otherwise(0.0))
    return got.withColumn("reason", composite_reason(F.col("cells"), w, h, F.col("fill"), width, height))


#: Reasons to reject a region, their limits, and confidences.
NARROW, FLAT, SMALL, LARGE = "width_below_min", "height_below_min", "area_below_min", "area_above_page_ratio"
LEAST_SIDE, LEAST_AREA, MOST_SHARE, MOST_REGIONS, MOST_REJECTED = 8.0, 100.0, 0.25, 5000, 1000
ACCEPTED_CONFIDENCE, REJECTED_CONFIDENCE = "candidate", "rejected"


def region_reason(w: Column, h: Column, area: Column, page_area: Column | float) -> Column:
    """The first reason to reject a region, or the empty string."""
    return F.when(w < LEAST_SIDE, NARROW).when(h < LEAST_SIDE, FLAT).when(area < LEAST_AREA, SMALL).when(area > F.lit(MOST_SHARE) * page_area, LARGE).otherwise("")


def regions(cells: DataFrame, width: float, height: float, most: int = MOST_REGIONS, most_rejected: int = MOST_REJECTED, page: str = "page") -> DataFrame:
    """Cells as named regions with centre, the first reason to reject, confidence, and a number among the accepted or the rejected, by place.

    As many of both as their limits are kept of a page.
    """
    w, h = F.round(F.col("right") - F.col("left"), 3), F.round(F.col("bottom") - F.col("top"), 3)
    cx, cy = F.round((F.col("left") + F.col("right")) / 2, 3), F.round((F.col("top") + F.col("bottom")) / 2, 3)
    got = cells.withColumns({"cx": cx, "cy": cy, "reason": region_reason(w, h, F.col("area"), width * height)})
    ok = F.col("reason") == ""
    n = F.row_number().over(Window.partitionBy(page, ok).orderBy("top", "left"))
    numbered = got.withColumn("_n", n).filter(F.when(ok, F.col("_n") <= most).otherwise(F.col("_n") <= most_rejected))
    name = F.format_string("p%03d_%s%04d", F.col(page).cast("int"), F.when(ok, "r").otherwise("x"), F.col("_n"))
    return numbered.withColumns({"region": name, "confidence": F.when(ok, ACCEPTED_CONFIDENCE).otherwise(REJECTED_CONFIDENCE)}).drop("_n")


def edge_sources() -> Column:
    """How many segments are behind each side of a cell, as `top:1,right:2,bottom:1,left:3`."""
    return F.concat_ws(",", *(F.concat(F.lit(f"{side}:"), F.col(f"{side}_sources").cast("string")) for side in ("top", "right", "bottom", "left")))


def box_key(left: Column, top: Column, right: Column, bottom: Column, snap: float) -> Column:
    """A box on the grid of the snap, by which equal boxes are found; a snap of 0 counts as 1."""
    s = snap if snap > 0 else 1.0
    return F.struct(*((c / s).cast("int").alias(n) for c, n in ((left, "x0"), (top, "top"), (right, "x1"), (bottom, "bottom"))))


def base_cells(regions_: DataFrame, eligible: tuple[str, ...] = (SMALL, NARROW, FLAT)) -> DataFrame:
    """What composites are built from: accepted regions, and rejected ones of the eligible reasons."""
    return regions_.filter((F.col("reason") == "") | F.col("reason").isin(*eligible))
