"""Page drawings as SVG text, one row per page: layers of elements, a title block of metadata, and legends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granella.functions.text import escape_xml, visual_cut
from granella.operators import geometry as G

#: Limits of layers.
MOST_LINES, MOST_CURVES, MOST_TEXTS, MOST_REGIONS = 50_000, 20_000, 20_000, 50_000
#: Classes and colours of elements.
LINE_CLASSES = {"horizontal": "geo-line-horizontal", "vertical": "geo-line-vertical", "diagonal": "geo-line-diagonal"}
BUCKET_LAYERS = {
    G.WALL: ("layer-wall-candidates", "cls-wall"), G.AXIS: ("layer-axis-aligned", "cls-axis"), G.DIAGONAL: ("layer-diagonal", "cls-diagonal"), G.TITLE: ("layer-titleblock-noise", "cls-titleblock"),
    G.TEXT_NEAR: ("layer-text-nearby-noise", "cls-text-near"), G.SHORT: ("layer-short-noise", "cls-short"), G.THIN: ("layer-thin-noise", "cls-thin"),
}
#: Legends, (label, class, colour, dashed or round).
GEOMETRY_LEGEND = (("Texto", "geo-text", "#222222", "T"), ("Horizontal", "geo-line-horizontal", "#0066cc", ""), ("Vertical", "geo-line-vertical", "#228833", ""), ("Diagonal", "geo-line-diagonal", "#cc6600", ""), ("Retangulo", "geo-rect", "#6633cc", ""), ("Curva (bbox)", "geo-curve", "#cc2222", "-"))
CLASS_LEGEND = (
    ("Contorno candidato", "cls-wall", "#00cccc", ""), ("Eixo alinhado", "cls-axis", "#88ddff", ""), ("Diagonal", "cls-diagonal", "#cc6600", ""), ("Carimbo/legenda", "cls-titleblock", "#999999", ""), ("Texto denso", "cls-text-near", "#ddaa00", ""),
    ("Curta", "cls-short", "#ff9999", ""), ("Fina/ponto", "cls-thin", "#ffcccc", ""), ("Retangulo", "cls-rect", "#6633cc", ""), ("Curva bbox", "cls-curve", "#cc2222", "-"),
)
REGION_LEGEND = (("Regiao candidata", "cls-region", "#00cc88", ""), ("Rejeitada", "cls-rejected", "#ff6633", "-"), ("Centroide", "cls-centroid", "#333333", "o"))


def number(c: Column) -> Column:
    """Whole numbers without a point, others with three places at most."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(F.round(c, 3).cast("string"))


def _element(tag: str, attributes: list[tuple[str, Column | str]], title: Column | None = None, body: Column | None = None) -> Column:
    """An element with a title, escaped, and a body; without both it is closed at once."""
    parts = [F.lit(f"<{tag}")]
    for name, value in attributes:
        parts += [F.lit(f' {name}="'), F.lit(value) if isinstance(value, str) else value, F.lit('"')]
    if title is None and body is None:
        return F.concat(*parts, F.lit("/>"))
    inner = [F.lit(">"), *([F.lit("<title>"), escape_xml(title), F.lit("</title>")] if title is not None else []), *([body] if body is not None else []), F.lit(f"</{tag}>")]
    return F.concat(*parts, *inner)


def _ends() -> list[tuple[str, Column]]:
    return [("x1", number(F.col("x0"))), ("y1", number(F.col("y0"))), ("x2", number(F.col("x1"))), ("y2", number(F.col("y1")))]


def line_element(css: Column, title: Column | None = None) -> Column:
    """A line from columns x0, y0, x1, y1."""
    return _element("line", [("class", css), *_ends()], title)


def line_class(kind: Column) -> Column:
    """The class of a line by its orientation; null for points, which aren't drawn."""
    return F.when(kind != "ponto", F.coalesce(F.create_map(*(F.lit(x) for p in LINE_CLASSES.items() for x in p))[kind], F.lit("geo-line-diagonal")))


def line_title() -> Column:
    """What a classified line is: bucket, reason, orientation, length and ends."""
    place = lambda a, b: F.concat(F.lit("("), number(F.col(a)), F.lit(","), number(F.col(b)), F.lit(")"))
    return F.concat_ws(
        " | ", F.concat(F.lit("bucket="), F.col("bucket")), F.concat(F.lit("reason="), F.col("reason")), F.concat(F.lit("orientation="), F.col("kind")), F.concat(F.lit("length="), number(F.col("length"))),
        F.concat(F.lit("coords="), place("x0", "y0"), F.lit("-"), place("x1", "y1")),
    )


def shape_element(css: Column | str, title: Column | None = None) -> Column:
    """The box of a rectangle or curve from columns x0, top, x1, bottom."""
    w, h = F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")
    return _element("rect", [("class", css), ("x", number(F.col("x0"))), ("y", number(F.col("top"))), ("width", number(w)), ("height", number(h))], title)


def shape_title() -> Column:
    w, h = F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")
    box = F.concat(F.lit("bbox=("), number(F.col("x0")), F.lit(","), number(F.col("top")), F.lit(")+"), number(w), F.lit("x"), number(h))
    return F.concat_ws(" | ", F.concat(F.lit("bucket="), F.col("bucket")), F.concat(F.lit("reason="), F.col("reason")), box)


def text_element() -> Column:
    """A text from columns px, py, label: title in full, label cut."""
    return _element("text", [("class", "geo-text"), ("x", number(F.col("px"))), ("y", number(F.col("py")))], F.col("label"), escape_xml(visual_cut(F.col("label"))))


def layer(items: DataFrame, name: str, limit: int, order: list, page: str = "page") -> DataFrame:
    """(page, layer, body, n): a page's first elements joined; items has a column element, null for what isn't drawn."""
    n = F.row_number().over(Window.partitionBy(page).orderBy(*order))
    few = items.withColumn("_n", n).filter(F.col("_n") <= limit)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "element"))), lambda x: x["element"]), "")
    return few.groupBy(page).agg(F.lit(name).alias("layer"), F.concat(F.lit(f'<g id="{name}">'), body, F.lit("</g>")).alias("body"), F.count("*").alias("n"))


def legend(entries: tuple, width: float, box: float, inset: float) -> str:
    """A legend in the upper right corner; a fixed text for a page's width."""
    rows = [f'<rect x="0" y="0" width="{box:g}" height="{14 + 11 * len(entries)}" fill="#ffffff" stroke="#cccccc" stroke-width="0.5" opacity="0.92"/>']
    for i, (label, css, colour, mark) in enumerate(entries):
        y = 12 + 11 * i
        if mark == "T":
            rows.append(f'<text class="geo-legend-text" x="6" y="{y}">T</text>')
        elif mark == "o":
            rows.append(f'<circle class="{css}" cx="14" cy="{y - 2}" r="2" fill="{colour}"/>')
        else:
            dashes = ' stroke-dasharray="2 2"' if mark else ""
            rows.append(f'<line class="geo-legend-sample {css}" x1="6" y1="{y}" x2="22" y2="{y}" stroke="{colour}"{dashes}/>')
        rows.append(f'<text class="geo-legend-text" x="28" y="{y}">{label}</text>')
    return f'<g id="layer-legend" transform="translate({max(8.0, width - inset):.3f},8.000)">' + "".join(rows) + "</g>"


def metadata(name: str, values: Column) -> Column:
    """A struct as JSON in a metadata element."""
    return F.concat(F.lit(f"<metadata><nbr12721:{name}>"), escape_xml(F.to_json(values)), F.lit(f"</nbr12721:{name}></metadata>"))


def pages(layers: list[DataFrame], width: float, height: float, page: str = "page", legend_: str = "", head: DataFrame | None = None) -> DataFrame:
    """(page, svg): metadata of the page (page, meta) if given, layers in the given order, a legend."""
    every = None
    for i, d in enumerate(layers):
        d = d.select(page, F.lit(i).alias("_i"), "body")
        every = d if every is None else every.union(d)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "body"))), lambda x: x["body"]), "")
    got = every.groupBy(page).agg(body.alias("_body"))
    meta = F.lit("")
    if head is not None:
        got, meta = got.join(head, page, "left"), F.coalesce("meta", F.lit(""))
    return got.select(page, _page(width, height, meta, F.col("_body"), legend_))


def _page(width: float, height: float, meta: Column, body: Column, legend_: str) -> Column:
    start = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}pt" height="{height:g}pt" viewBox="0 0 {width:g} {height:g}">'
    return F.concat(F.lit(start), meta, F.lit(f'<rect class="geo-page" width="{width:g}" height="{height:g}"/>'), body, F.lit(legend_ + "</svg>")).alias("svg")


def geometry_page(lines: DataFrame, shapes: DataFrame, texts: DataFrame, width: float, height: float, page: str = "page") -> DataFrame:
    """(page, svg) of a page as it is: rectangles, curves, lines by orientation, texts."""
    drawn = lines.withColumn("element", line_element(line_class(F.col("kind")))).filter("element is not null")
    boxes = lambda kind, css: shapes.filter(F.col("kind") == kind).withColumn("element", shape_element(css))
    order = ["x0", "top", "x1", "bottom"]
    layers = [
        layer(boxes("rect", "geo-rect"), "layer-rects", 1 << 30, order, page),
        layer(boxes("curve", "geo-curve"), "layer-curves", MOST_CURVES, order, page),
        layer(drawn, "layer-lines", MOST_LINES, ["idx"], page),
        layer(texts.filter("label <> ''").withColumn("element", text_element()), "layer-texts", MOST_TEXTS, ["px", "py", "label"], page),
    ]
    counts = lines.groupBy(page).agg(F.count("*").alias("lines"))
    head = counts.select(page, metadata("geometryDebug", F.struct(F.col(page).alias("page_number"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.struct("lines").alias("stats"))).alias("meta"))
    return pages(layers, width, height, page, legend(GEOMETRY_LEGEND, width, 110, 118), head)


def first_by_x(shapes: DataFrame, limit: int, page: str = "page") -> DataFrame:
    """shapes without those that surely aren't among the first of a page and kind by x0, ties and all: so many lie in whole units to the left of theirs.

    Units are counted, not sorted. One row for each page and kind with more than
    the limit is broadcast, so at most one for as many shapes.
    """
    unit = F.coalesce(F.when(F.isnan("x0"), F.lit((1 << 63) - 1)).otherwise(F.floor(F.col("x0").cast("double"))), F.lit(-(1 << 63)))
    w = Window.partitionBy(page, "kind").orderBy("_u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = shapes.groupBy(page, "kind", unit.alias("_u")).agg(F.count("*").alias("_n")).withColumn("_n", F.sum("_n").over(w))
    last = upto.filter(F.col("_n") >= limit).groupBy(page, "kind").agg(F.min("_u").alias("_last"))
    return shapes.join(F.broadcast(last), [page, "kind"], "left").filter(F.col("_last").isNull() | (unit <= F.col("_last"))).drop("_last")


def classified_page(lines: DataFrame, shapes: DataFrame, width: float, height: float, axis: bool = False, most_noise: int = MOST_LINES, page: str = "page") -> DataFrame:
    """(page, svg) of classified lines and shapes: axis lines if wanted, curves, rectangles, noise within a shared budget, walls.

    Lines and shapes are one relation that is dealt by page once. One window
    numbers a page's groups (axis lines, curves, rectangles, noise, walls, other
    lines), elements are made of what their limits leave, and a group's last row
    tells how many it has.
    """
    curve, rect, noise, wall, other, axial = range(6)
    buckets = (*G.NOISE, G.WALL)
    names = [BUCKET_LAYERS[G.AXIS][0], "layer-curve-candidates", "layer-rect-candidates", *(BUCKET_LAYERS[k][0] for k in buckets), ""]
    css = [BUCKET_LAYERS[G.AXIS][1], "cls-curve", "cls-rect", *(BUCKET_LAYERS[k][1] for k in buckets), ""]
    last = len(names) - 1
    order = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    shared = ["bucket", "reason"]
    one = lambda group, number, at, by: [group.alias("_g"), number.alias("_i"), by.alias("_by"), *at]
    at = F.coalesce(*(F.when(F.col("bucket") == k, 3 + i) for i, k in enumerate(buckets)), F.lit(last))
    group = F.when(at == last, other).when(F.col("bucket") == G.WALL, wall).otherwise(noise)
    rows = lines.select(page, *one(group, at, order, F.col("idx")), *shared, "kind", "length")
    if axis:
        rows = rows.union(lines.filter(G.long_axis_line(F.col("length"), F.col("kind"))).select(page, *one(F.lit(axial), F.lit(0), order, F.col("idx")), *shared, "kind", "length"))
    drawn = first_by_x(shapes.filter(F.col("kind").isin("curve", "rect")), MOST_CURVES, page)
    is_rect = (F.col("kind") == "rect").cast("int")
    box = [F.col(a).cast("double").alias(b) for a, b in (("x0", "x0"), ("top", "y0"), ("x1", "x1"), ("bottom", "y1"))]
    nothing = [F.lit(None).cast(lines.schema[c].dataType) for c in ("idx", "length")]
    rows = rows.union(drawn.select(page, *one(is_rect, is_rect + 1, box, nothing[0]), *shared, "kind", nothing[1]))

    is_shape = F.col("_g") <= rect
    by_place = [F.when(is_shape, F.col(c)) for c in ("x0", "y0", "x1", "y1")]
    w = Window.partitionBy(page, "_g").orderBy("_i", "_by", *by_place)
    numbered = rows.repartition(page).withColumns({"_n": F.row_number().over(w), "_end": F.lead(F.lit(1)).over(w).isNull()})
    limit = F.when(F.col("_g") == noise, most_noise).when(is_shape, MOST_CURVES).otherwise(MOST_LINES)
    shown = (F.col("_n") <= limit) & (F.col("_g") != other)
    numbered = numbered.withColumn("_shown", shown).filter(F.col("_shown") | F.col("_end"))
    if most_noise > MOST_LINES:  # a layer's own limit
        v = Window.partitionBy(page, "_g", "_i").orderBy("_n")
        numbered = numbered.withColumn("_shown", F.col("_shown") & ((F.col("_g") != noise) | (F.row_number().over(v) <= MOST_LINES)))
    pick = lambda of: F.element_at(F.array(*map(F.lit, of)), F.col("_i") + 1)
    as_box = numbered.select("*", F.col("y0").alias("top"), F.col("y1").alias("bottom"))
    element = F.when(is_shape, shape_element(pick(css), shape_title())).otherwise(line_element(pick(css), line_title()))
    layers = as_box.groupBy(page, "_g", "_i").agg(F.collect_list(F.when(F.col("_shown"), F.struct("_n", element.alias("element")))).alias("_all"), F.max(F.when(F.col("_end"), F.col("_n"))).alias("_count"))
    body = F.concat(F.lit('<g id="'), pick(names), F.lit('">'), F.array_join(F.transform(F.array_sort("_all"), lambda x: x["element"]), ""), F.lit("</g>"))
    some = layers.select(page, "_g", "_count", F.when(F.size("_all") > 0, F.struct("_i", body.alias("body"))).alias("_layer"))
    count = lambda *g: F.sum(F.when(F.col("_g").isin(*g), F.col("_count")).cast("long"))
    got = some.groupBy(page).agg(F.collect_list("_layer").alias("_layers"), count(noise, wall, other).alias("input_lines"), F.coalesce(count(wall), F.lit(0)).alias("wall_candidates")).filter(F.size("_layers") > 0)
    stats = metadata("vectorClassificationDebug", F.struct(F.col(page).alias("page_number"), F.struct("input_lines", "wall_candidates").alias("stats")))
    meta = F.when(F.col(page).isNotNull() & F.col("input_lines").isNotNull(), stats).otherwise("")
    bodies = F.array_join(F.transform(F.array_sort("_layers"), lambda x: x["body"]), "")
    entries = CLASS_LEGEND if axis else tuple(e for e in CLASS_LEGEND if e[1] != "cls-axis")
    return got.select(page, _page(width, height, meta, bodies, legend(entries, width, 135, 145)))


def region_title() -> Column:
    """A region's name, verdict, box, size and the segments behind its sides."""
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    return F.concat_ws(
        " | ", F.concat(F.lit("id="), F.col("region")), F.concat(F.lit("confidence="), F.col("confidence")), F.concat(F.lit("rejection_reason="), F.col("reason")),
        F.concat(F.lit("bbox=("), number(F.col("left")), F.lit(","), number(F.col("top")), F.lit(")-("), number(F.col("right")), F.lit(","), number(F.col("bottom")), F.lit(")")),
        F.concat(F.lit("width="), number(w)), F.concat(F.lit("height="), number(h)), F.concat(F.lit("area_pdf_units="), number(F.col("area"))), F.concat(F.lit("edge_source_counts="), G.edge_sources()),
    )


def region_element(css: str) -> Column:
    """A rectangle from left, top, right, bottom with its title."""
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    return _element("rect", [("class", css), ("x", number(F.col("left"))), ("y", number(F.col("top"))), ("width", number(w)), ("height", number(h))], region_title())


def centre_element() -> Column:
    return _element("circle", [("class", "cls-centroid"), ("cx", number(F.col("cx"))), ("cy", number(F.col("cy"))), ("r", "2")], region_title())


def short_label(region: Column) -> Column:
    """A region's name without its page."""
    return F.when(F.contains(region, F.lit("_")), F.regexp_extract(region, "^[^_]*_(.*)$", 1)).otherwise(region)


def label_element() -> Column:
    """The region's short name, three units above its centre."""
    return _element("text", [("class", "cls-label"), ("x", number(F.col("cx"))), ("y", number(F.col("cy") - 3))], region_title(), short_label(F.col("region")))


def region_page(regions: DataFrame, width: float, height: float, rejected: bool = True, labels: bool = True, page: str = "page") -> DataFrame:
    """(page, svg) of accepted and, if wanted, rejected regions, with their centres and labels."""
    good, bad = regions.filter("reason = ''"), regions.filter("reason <> ''")
    shown = regions if rejected else good
    order = [F.col("reason") != "", F.col("region")]
    layers = [layer(bad.withColumn("element", region_element("cls-rejected")), "layer-rejected-regions", MOST_REGIONS, ["region"], page)] if rejected else []
    layers += [layer(good.withColumn("element", region_element("cls-region")), "layer-regions", MOST_REGIONS, ["region"], page), layer(shown.withColumn("element", centre_element()), "layer-centroids", MOST_REGIONS, order, page)]
    if labels:
        layers.append(layer(shown.withColumn("element", label_element()), "layer-labels", MOST_REGIONS, order, page))
    counts = regions.groupBy(page).agg(F.sum((F.col("reason") == "").cast("long")).alias("rendered_regions"), F.sum((F.col("reason") != "").cast("long")).alias("rendered_rejected_regions"))
    head = counts.select(page, metadata("regionDebug", F.struct(F.col(page).alias("page_number"), F.col("rendered_regions"), F.col("rendered_rejected_regions"))).alias("meta"))
    return pages(layers, width, height, page, legend(REGION_LEGEND, width, 120, 130), head)
