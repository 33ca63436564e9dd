"""What a recogniser's raw output becomes, as column expressions: boxes of several shapes, reading order, kept lines, decoded characters, input sizes.

Finding text in pixels is left to a plug-in (sources.recognizer); nothing here looks at an image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
DROP_SCORE = 0.5
SAME_LINE = 10.0
SIDE, MULTIPLE, MOST_PIXELS = 736, 32, 8 * 1024 * 1024
LINE_HEIGHT, LEAST_WIDTH, MOST_WIDTH = 48, 320, 2048


def first_number(*values: Column) -> Column:
    """The first of several texts or numbers that is a finite number."""
    numbers = F.transform(F.array(*(v.cast("string") for v in values)), lambda v: v.try_cast("double"))
    return F.get(F.filter(numbers, lambda n: n.isNotNull() & ~F.isnan(n) & (F.abs(n) != F.lit(float("inf")))), F.lit(0))


def _let(x: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    def made(p: Column) -> Column:
        edges = F.struct(*(f(p[c], p[d]).alias(n) for f, c, d, n in ((F.least, "a", "c", "x_min"), (F.least, "b", "d", "y_min"), (F.greatest, "a", "c", "x_max"), (F.greatest, "b", "d", "y_max"))))
        return F.when(p["a"].isNotNull() & p["b"].isNotNull() & p["c"].isNotNull() & p["d"].isNotNull(), edges)

    return _let(F.struct(x0.alias("a"), y0.alias("b"), x1.alias("c"), y1.alias("d")), made)


def _of(v: Column, path: str) -> Column:
    """What a variant holds at a path, as text; null for JSON's null."""
    return F.try_variant_get(v, path, "string")


def _points(v: Column) -> Column:
    """A box's points: the first of its fields of that meaning that is there and not null, as a variant."""
    held = [F.try_variant_get(v, f"$.{p}", "variant") for p in ("box", "points", "boxes", "bbox")]
    return F.coalesce(*(F.when(~F.is_variant_null(x), x) for x in held))


def _rect_of(v: Column, points: Column) -> Column:
    at = lambda *paths: first_number(*(_of(v, f"$.{p}") for p in paths))
    each = F.coalesce(F.try_variant_get(points, "$", "array<variant>"), F.array())
    real = lambda k, name: F.filter(F.transform(each, lambda p: first_number(_of(p, f"$[{k}]"), _of(p, f"$.{name}"))), lambda x: x.isNotNull())
    xs, ys = real(0, "x"), real(1, "y")
    of_points = _rect(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    corner = lambda name, axis: first_number(_of(points, f"$.{name}.{axis}"))
    pair = lambda name: F.struct(corner(name, "x").alias("x"), corner(name, "y").alias("y"))
    low = F.when(_of(points, "$.bottomRight").isNotNull(), pair("bottomRight")).otherwise(pair("bottomLeft"))
    high = F.when(_of(points, "$.topRight").isNotNull(), pair("topRight")).otherwise(pair("topLeft"))
    of_corners = _rect(corner("topLeft", "x"), corner("topLeft", "y"), F.coalesce(low["x"], high["x"]), F.coalesce(low["y"], high["y"]))
    left, top = at("x_min", "xMin", "left"), at("y_min", "yMin", "top")
    right = F.coalesce(at("x_max", "xMax", "right"), F.coalesce(left, F.lit(0.0)) + at("width", "w"), left, F.lit(0.0))
    bottom = F.coalesce(at("y_max", "yMax", "bottom"), F.coalesce(top, F.lit(0.0)) + at("height", "h"), top, F.lit(0.0))
    of_edges = F.when(left.isNotNull() | top.isNotNull(), F.struct(F.coalesce(left, F.lit(0.0)).alias("x_min"), F.coalesce(top, F.lit(0.0)).alias("y_min"), right.alias("x_max"), bottom.alias("y_max")))
    return F.coalesce(of_points, of_corners, of_edges)


def _parsed(box: Column, f) -> Column:
    """f of a JSON text's variant and its points; the text is parsed once."""
    whole = _let(F.try_parse_json(box), lambda v: _let(F.struct(v.alias("v"), _points(v).alias("points")), lambda x: f(x["v"], x["points"])))
    return whole


def rect_of(box: Column) -> Column:
    """struct(x_min, y_min, x_max, y_max) of a JSON text, or null.

    A box is told by corner points ([x, y] pairs or {x, y} objects), by named corners (topLeft with bottomRight,
    bottomLeft or topRight), by its edges, or by an edge and a size; what is asked for first counts first.
    """
    return _parsed(box, _rect_of)


def box_of_json(box: Column) -> Column:
    """A box as layout.lines() takes it, from JSON text of any of rect_of()'s shapes; one without a place, and text that is no JSON, is at 0."""
    def made(v: Column, points: Column) -> Column:
        at = lambda *paths: first_number(*(_of(v, f"$.{p}") for p in paths))
        text = F.coalesce(_of(v, "$.text"), _of(v, "$.txt"), F.lit(""))

        def placed(r: Column) -> Column:
            x0, y0, x1, y1 = (F.coalesce(r[c], F.lit(0.0)) for c in ("x_min", "y_min", "x_max", "y_max"))
            return F.struct(
                text.alias("text"), F.coalesce(at("confidence", "score"), F.lit(0.0)).alias("confidence"), x0.alias("x_min"), x1.alias("x_max"), y0.alias("y_min"), y1.alias("y_max"),
                F.coalesce(at("y_center", "yCenter"), (y0 + y1) / 2).alias("y_center"), F.coalesce(at("height", "h"), F.abs(y1 - y0)).alias("height"),
            )

        return _let(_rect_of(v, points), placed)

    return _parsed(box, made)


def ingredient_of(value: Column) -> Column:
    """struct(raw, standard) of an ingredient given as plain text or as a JSON object."""
    is_object = F.btrim(value).startswith("{")
    return F.when(is_object, F.from_json(value, "raw string, standard string")).otherwise(F.struct(value.alias("raw"), F.lit(None).cast("string").alias("standard")))


def word_map(raw: Column) -> Column:
    """A JSON object of word lists as map<string, array<string>>; null and broken ones are empty."""
    empty = F.create_map().cast("map<string,array<string>>")
    return F.coalesce(F.transform_values(F.from_json(raw, "map<string,array<string>>"), lambda _, words: F.coalesce(words, F.array().cast("array<string>"))), empty)


def reading_order(boxes: Column) -> Column:
    """Boxes (structs with y and x of their first corner) by y, then x; a box moves before those of its line that stand right of it."""
    ordered = F.array_sort(boxes, lambda a, b: F.when(a["y"] != b["y"], F.signum(a["y"] - b["y"])).otherwise(F.signum(a["x"] - b["x"])).cast("int"))

    def placed(done: Column, b: Column) -> Column:
        stays = lambda a, i: F.when(~((F.abs(b["y"] - a["y"]) < SAME_LINE) & (b["x"] < a["x"])), i + 1)
        k = F.coalesce(F.array_max(F.transform(done, stays)), F.lit(0))
        return F.concat(F.slice(done, F.lit(1), k), F.array(b), F.slice(done, k + 1, F.greatest(F.size(done) - k, F.lit(0))))

    return F.aggregate(ordered, F.slice(boxes, 1, 0), placed)


def rounded(value: Column, digits: int) -> Column:
    """Half goes up, on the binary product."""
    return F.floor(value * float(10**digits) + 0.5) / float(10**digits)


def kept_lines(lines: DataFrame, key: str, least: float = DROP_SCORE) -> DataFrame:
    """(key, place, text, confidence) -> one row for each key: full_text and mean confidence of the lines kept, how many there were, and problem with the best line where none is left.

    The mean adds up in the order of places, then of texts and confidences, so it is the same however the rows are dealt out.
    """
    good = (F.col("text") != "") & (F.col("confidence") >= least)
    out = lines.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(good, F.struct("place", "text", "confidence")))).alias("kept"), F.count("*").alias("n_lines"),
        F.max_by("text", F.struct("confidence", -F.col("place"))).alias("best"),
    )
    total = F.aggregate("kept", F.lit(0.0), lambda a, x: a + x["confidence"])
    return out.select(key, "n_lines", F.size("kept").alias("n_kept"), F.array_join(F.transform("kept", lambda x: x["text"]), "\n").alias("full_text"), F.when(F.size("kept") > 0, rounded(total / F.size("kept"), 4)).alias("confidence"), F.when(F.size("kept") == 0, F.concat(F.lit("no line is clear enough; the best one: "), "best")).alias("problem"))


def softmax(row: Column) -> Column:
    """array<double> as probabilities."""
    def shared(top: Column) -> Column:
        powers = F.transform(row, lambda x: F.exp(x - top))
        total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
        return F.transform(powers, lambda x: x / total)

    return shared(F.array_max(row))


def charset(dictionary: list[str], classes: int) -> list[str]:
    """The characters of a model's classes: the blank, the dictionary and, if there is one class more, a space."""
    for chars in (["", *dictionary], ["", *dictionary, " "]):
        if len(chars) == classes:
            return chars
    raise ValueError(f"a dictionary of {len(dictionary)} characters does not fit {classes} classes")


def ctc_text(steps: Column, chars: Column, raw_scores: bool = False) -> Column:
    """struct(text, confidence) of array<array<double>>, one row of class scores for each step: each step's best class, without repeats and blanks (class 0)."""
    def best(row: Column) -> Column:
        return F.struct((F.array_position(row, F.array_max(row)) - 1).cast("int").alias("k"), (F.array_max(softmax(row)) if raw_scores else F.array_max(row)).alias("p"))

    def shown(found: Column) -> Column:
        placed = F.transform(found, lambda x, i: F.struct(x["k"].alias("k"), x["p"].alias("p"), F.when(i > 0, F.get(found, i - 1)["k"]).otherwise(F.lit(-1)).alias("before")))
        return F.filter(placed, lambda x: (x["k"] != 0) & (x["k"] != x["before"]) & F.get(chars, x["k"]).isNotNull())

    def told(kept: Column) -> Column:
        total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["p"])
        return F.struct(F.array_join(F.transform(kept, lambda x: F.get(chars, x["k"])), "").alias("text"), F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.lit(0.0)).alias("confidence"))

    # Each step of the way is worked out once a row, whatever expression the scores are.
    return _let(F.transform(steps, best), lambda found: _let(shown(found), told))


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def detection_size(width: Column, height: Column) -> Column:
    """struct(width, height) that an image is scaled to before text is looked for: its short side SIDE at least, multiples of 32, at most 8 megapixels."""
    short = F.least(width, height)
    ratio = F.when(short < SIDE, F.lit(float(SIDE)) / short).otherwise(F.lit(1.0))
    w, h = (F.greatest(_half_up(x * ratio / MULTIPLE) * MULTIPLE, F.lit(MULTIPLE)) for x in (width, height))
    shrink = F.sqrt(F.lit(float(MOST_PIXELS)) / (w * h))
    less = lambda x: F.when(w * h > MOST_PIXELS, F.greatest(F.floor(x * shrink / MULTIPLE) * MULTIPLE, F.lit(MULTIPLE))).otherwise(x)
    return F.struct(less(w).cast("int").alias("width"), less(h).cast("int").alias("height"))


def line_size(width: Column, height: Column) -> Column:
    """struct(width, padded) of a line's crop at height 48: the scaled width, and the width that it is padded to."""
    ratio = LINE_HEIGHT * width / F.greatest(height, F.lit(1))
    padded = F.least(F.greatest(F.floor(ratio), F.lit(LEAST_WIDTH)), F.lit(MOST_WIDTH))
    return F.struct(F.greatest(F.least(padded, F.ceil(ratio)), F.lit(1)).cast("int").alias("width"), padded.cast("int").alias("padded"))


def _around(points: Column):
    """For a polygon's points, each with the next."""
    return lambda p, i: F.struct(p.alias("a"), F.get(points, (i + 1) % F.size(points)).alias("b"))


def polygon_area(points: Column) -> Column:
    """Of array<struct<x, y>>."""
    return F.abs(F.aggregate(F.transform(points, _around(points)), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def polygon_perimeter(points: Column) -> Column:
    return F.aggregate(F.transform(points, _around(points)), F.lit(0.0), lambda s, e: s + F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Whether a point is inside: a ray to its right crosses an odd number of edges."""
    crosses = F.filter(F.transform(points, _around(points)), lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["a"]["x"] - e["b"]["x"]) * (y - e["b"]["y"]) / (e["a"]["y"] - e["b"]["y"]) + e["b"]["x"]))
    return F.size(crosses) % 2 == 1


def _turn(o: Column, a: Column, b: Column) -> Column:
    """Over 0 for a left turn at a on the way from o to b."""
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def _chain(points: Column) -> Column:
    """Half of a hull as a fold over points in order: before a point is added, those go from the end that are no left turn on the way to it."""
    def added(done: Column, p: Column) -> Column:
        bends = lambda x, i: F.when((i > 0) & (_turn(F.get(done, i - 1), x, p) > 0), i + 1)
        kept = F.coalesce(F.array_max(F.transform(done, bends)), F.least(F.size(done), F.lit(1)))
        return F.concat(F.slice(done, F.lit(1), kept), F.array(p))

    return F.aggregate(points, F.slice(points, 1, 0), added)


def convex_hull(points: Column) -> Column:
    """The corners of the hull of array<struct<x:double,y:double>>, from the leftmost lowest one, counter-clockwise; null for fewer than three points that are not on one line.

    Nulls and repeated points do not count.
    """
    own = _let(F.array_distinct(F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())), lambda s: F.array_sort(s))
    both = _let(own, lambda s: F.struct(_chain(s).alias("low"), _chain(F.reverse(s)).alias("high")))
    hull = _let(both, lambda b: F.concat(F.slice(b["low"], F.lit(1), F.greatest(F.size(b["low"]) - 1, F.lit(0))), F.slice(b["high"], F.lit(1), F.greatest(F.size(b["high"]) - 1, F.lit(0)))))
    return _let(hull, lambda h: F.when(F.size(h) >= 3, h))


def smallest_rectangle(hull: Column) -> Column:
    """struct(area, width, height, points) of the rectangle of least area around a hull: one of its sides lies on one of the hull's; the first of equals. Null for null."""
    def on(e: Column, i: Column) -> Column:
        a, n = e["a"], F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])
        return _let(F.struct(a.alias("a"), ((e["b"]["x"] - a["x"]) / n).alias("ux"), ((e["b"]["y"] - a["y"]) / n).alias("uy")), lambda s: measured(s, i))

    def measured(s: Column, i: Column) -> Column:
        a, ux, uy = s["a"], s["ux"], s["uy"]
        along = F.transform(hull, lambda p: (p["x"] - a["x"]) * ux + (p["y"] - a["y"]) * uy)
        across = F.transform(hull, lambda p: (p["y"] - a["y"]) * ux - (p["x"] - a["x"]) * uy)
        edges = F.struct(F.array_min(along).alias("l"), F.array_max(along).alias("r"), F.array_min(across).alias("b"), F.array_max(across).alias("t"))
        at = lambda u, v: F.struct((a["x"] + u * ux - v * uy).alias("x"), (a["y"] + u * uy + v * ux).alias("y"))
        return _let(edges, lambda g: F.struct(
            ((g["r"] - g["l"]) * (g["t"] - g["b"])).alias("area"), i.alias("ord"), (g["r"] - g["l"]).alias("width"), (g["t"] - g["b"]).alias("height"),
            F.array(at(g["l"], g["b"]), at(g["r"], g["b"]), at(g["r"], g["t"]), at(g["l"], g["t"])).alias("points"),
        ))

    every = F.transform(F.transform(hull, _around(hull)), on)
    return _let(F.array_min(every), lambda b: F.when(b.isNotNull(), F.struct(b["area"].alias("area"), b["width"].alias("width"), b["height"].alias("height"), b["points"].alias("points"))))


def corners_in_order(points: Column) -> Column:
    """Four corners from the upper left clockwise, y downwards: of the two left ones the upper is first and the lower last, of the two right ones likewise the second and third."""
    s = lambda p: F.array_sort(p, lambda a, b: F.signum(a["x"] - b["x"]).cast("int"))
    upper = lambda a, b: F.when(b["y"] > a["y"], a).otherwise(b)
    lower = lambda a, b: F.when(b["y"] > a["y"], b).otherwise(a)
    return _let(s(points), lambda p: F.array(upper(p[0], p[1]), upper(p[2], p[3]), lower(p[2], p[3]), lower(p[0], p[1])))
