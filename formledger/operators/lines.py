"""Page geometry as interval work on ink runs: ink_runs(doc_id, page_no, axis, pos, start, end), end exclusive.

axis "h": pos is y and runs lie along x; axis "v": pos is x and runs lie along y. A request names its page and the strip
it looks at, so every join is an equality on (doc_id, page_no, axis) with range conditions beside it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LADDER = (0.7, 0.5, 0.35, 0.15)


#: Pixels of a position bin, a join key beside document and page: a run meets only the requests that look at its part of the page.
BIN = 64


def bin_of(pos: Column) -> Column:
    return F.floor(pos / BIN).cast("int")


def bins_of(low: Column, high: Column) -> Column:
    """The bins that [low, high) touches; none if it is empty. A position is in one of them only, so no pair comes twice."""
    return F.when(high > low, F.sequence(bin_of(low), bin_of(F.ceil(high) - 1)))


def _at(requests: DataFrame, runs: DataFrame, axis: str, low: Column, high: Column) -> DataFrame:
    """Requests beside the runs of their page with low <= pos < high."""
    r = runs.where(F.col("axis") == axis).select(
        F.col("doc_id").alias("__d"), F.col("page_no").alias("__p"), bin_of(F.col("pos")).alias("__run_bin"), "pos", F.col("start").alias("run_start"), F.col("end").alias("run_end")
    )
    asked = requests.withColumn("__own_bin", F.explode(bins_of(low, high)))
    on = (F.col("doc_id") == F.col("__d")) & (F.col("page_no") == F.col("__p")) & (F.col("__own_bin") == F.col("__run_bin"))
    return asked.join(r, on & (F.col("pos") >= low) & (F.col("pos") < high)).drop("__d", "__p", "__own_bin", "__run_bin")


def _kept_length(low: Column, high: Column, k: Column, start: Column | str = "run_start", end: Column | str = "run_end") -> Column:
    """Length of the run inside [low, high) if an opening by k pixels keeps it there, else 0.

    Pixels beyond the strip do not count against a run: one that touches an edge needs about half the length, one that
    spans the strip none.
    """
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    inside = F.least(end, high) - F.greatest(start, low)
    at_low, at_high = start <= low, end >= high
    half = F.floor(k / 2)
    need = F.when(at_low & at_high, F.lit(0)).when(at_low, k - half).when(at_high, half + 1).otherwise(k)
    return F.when((inside > 0) & (inside >= need), inside).otherwise(F.lit(0))


def _strength(requests: DataFrame, runs: DataFrame, ladder: Sequence[float], axis: str, keep: Sequence[str] = ()) -> DataFrame:
    """hline_strength(), with columns of the requests to keep."""
    beside = _at(requests, runs, axis, F.col("lo"), F.col("hi"))
    width = F.col("x1") - F.col("x0")
    steps = [_kept_length(F.col("x0"), F.col("x1"), F.greatest(F.floor(width * share), F.lit(10))).cast("long") for share in ladder]
    # All steps side by side: a row's sums, and over the request's rows the first step that finds anything.
    sums = beside.groupBy("request", *keep, "pos").agg(*[F.sum(kept).alias(f"__s{i}") for i, kept in enumerate(steps)])
    there = W.partitionBy("request")
    found = lambda i: F.max(f"__s{i}").over(there) > 0
    first = F.when(found(0), F.col("__s0"))
    for i in range(1, len(ladder)):
        first = first.when(found(i), F.col(f"__s{i}"))
    return sums.withColumn("strength", first).where("strength > 0").select("request", *keep, "pos", "strength")


def hline_strength(requests: DataFrame, runs: DataFrame, ladder: Sequence[float] = LADDER, axis: str = "h") -> DataFrame:
    """Requests (request, doc_id, page_no, x0, x1, lo, hi) -> (request, pos, strength) at the first step of the ladder
    that finds anything. For axis "v" x0 and x1 are the strip's y range."""
    return _strength(requests, runs, ladder, axis)


def _picked(strong: DataFrame, prefer_near: bool, excluded: DataFrame | None, outermost: str | None) -> DataFrame:
    """Strengths (request, expected, pos, strength) -> (request, pos): the place that each request takes."""
    if prefer_near:
        strong = strong.withColumn("most", F.max("strength").over(W.partitionBy("request"))).where("2 * strength >= most").drop("most")
    else:
        strong = strong.groupBy("request", "expected").agg(F.max_by("pos", F.struct("strength", -F.col("pos"))).alias("pos"))
    if excluded is not None:
        x = excluded.select(F.col("request").alias("__of"), F.col("pos").alias("__x"))
        close = strong.join(x, (F.col("request") == F.col("__of")) & (F.abs(F.col("pos") - F.col("__x")) < 5), "left_semi").select("request", "pos").withColumn("hit", F.lit(1))
        marked = strong.join(close, ["request", "pos"], "left")
        strong = marked.withColumn("free", F.max(F.col("hit").isNull().cast("int")).over(W.partitionBy("request"))).where("free = 0 OR hit IS NULL").drop("hit", "free")
    if outermost:
        band = F.col("pos") - F.row_number().over(W.partitionBy("request").orderBy("pos"))
        bands = strong.withColumn("band", band).groupBy("request", "band").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
        centre = F.bround((F.col("a") + F.col("b")) / 2).cast("int")
        return bands.groupBy("request").agg((F.min_by(centre, "a") if outermost == "left" else F.max_by(centre, "b")).alias("pos"))
    near = F.min(F.struct(F.abs(F.col("pos") - F.col("expected")).alias("off"), "pos"))["pos"]
    return strong.groupBy("request").agg(near.alias("pos"))


def pick_line(requests: DataFrame, strengths: DataFrame, prefer_near: bool = True, excluded: DataFrame | None = None, outermost: str | None = None) -> DataFrame:
    """(request, found): the nearest of the lines of at least half the greatest strength; nothing: the expected place.

    excluded (request, pos): candidates within 5 pixels of these go, unless all would. outermost "left" or "right": the
    centre of the outermost unbroken band of candidates.
    """
    asked = requests.select("request", "expected")
    best = _picked(strengths.join(asked, "request"), prefer_near, excluded, outermost)
    return asked.join(best, "request", "left").select("request", F.coalesce("pos", "expected").alias("found"))


def _found(requests: DataFrame, runs: DataFrame, name: str, axis: str, ladder: Sequence[float], strip: dict[str, Column], prefer_near: bool, excluded: DataFrame | None = None, outermost: str | None = None) -> DataFrame:
    """requests with a column more: where their line is. strip: x0, x1, lo and hi of the strip that each looks at."""
    asked = requests.select("request", "doc_id", "page_no", "expected", *[c.alias(n) for n, c in strip.items()])
    best = _picked(_strength(asked, runs, ladder, axis, ("expected",)), prefer_near, excluded, outermost).withColumnRenamed("pos", "__pos")
    return requests.join(best, "request", "left").withColumn(name, F.coalesce("__pos", "expected")).drop("__pos")


def with_hline(requests: DataFrame, runs: DataFrame, name: str = "found", prefer_near: bool = True, excluded: DataFrame | None = None) -> DataFrame:
    """Requests (request, doc_id, page_no, x0, x1, expected, back, fwd, any others) with the place found."""
    strip = {"x0": F.col("x0"), "x1": F.col("x1"), "lo": F.greatest(F.lit(0), F.col("expected") - F.col("back")), "hi": F.col("expected") + F.col("fwd")}
    return _found(requests, runs, name, "h", LADDER, strip, prefer_near, excluded)


def find_hline(requests: DataFrame, runs: DataFrame, prefer_near: bool = True, excluded: DataFrame | None = None) -> DataFrame:
    """As with_hline() -> (request, found)."""
    return with_hline(requests, runs, "found", prefer_near, excluded).select("request", "found")


def with_vline(requests: DataFrame, runs: DataFrame, name: str = "found", prefer_near: bool = False, outermost: str | None = None) -> DataFrame:
    """Requests (request, doc_id, page_no, y0, y1, expected, radius, any others) with the place found. With prefer_near the runs must
    come from pages thickened sideways by 4 pixels (the pass over the images makes them)."""
    strip = {"x0": F.col("y0"), "x1": F.col("y1"), "lo": F.greatest(F.lit(0), F.col("expected") - F.col("radius")), "hi": F.col("expected") + F.col("radius")}
    return _found(requests, runs, name, "v", (0.7,), strip, prefer_near, None, outermost if prefer_near else None)


def find_vline(requests: DataFrame, runs: DataFrame, prefer_near: bool = False, outermost: str | None = None) -> DataFrame:
    """As with_vline() -> (request, found)."""
    return with_vline(requests, runs, "found", prefer_near, outermost).select("request", "found")


def ink_ratio(boxes: DataFrame, runs: DataFrame) -> DataFrame:
    """Boxes (box, doc_id, page_no, x0, y0, x1, y1) -> (box, ratio): the share of ink, 0 for an empty box."""
    inside = F.greatest(F.lit(0), F.least("run_end", "x1") - F.greatest("run_start", "x0"))
    ink = _at(boxes, runs, "h", F.col("y0"), F.col("y1")).groupBy("box").agg(F.sum(inside).alias("ink"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    ok = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    return boxes.join(ink, "box", "left").select("box", F.when(ok, F.coalesce("ink", F.lit(0)) / area).otherwise(0.0).alias("ratio"))


def has_crossing_line(gaps: DataFrame, runs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Gaps (box, doc_id, page_no, x0, x1, y0, gap) -> (box, crosses): a row of the middle band nearly full of ink."""
    band = gaps.withColumns({"top": F.col("y0") + F.floor(F.col("gap") * 0.35), "bottom": F.col("y0") + F.floor(F.col("gap") * 0.75)})
    inside = F.greatest(F.lit(0), F.least("run_end", "x1") - F.greatest("run_start", "x0"))
    rows = _at(band, runs, "h", F.col("top"), F.col("bottom")).groupBy("box", "pos", (F.col("x1") - F.col("x0")).alias("w")).agg(F.sum(inside).alias("ink"))
    most = rows.where("w > 0").groupBy("box").agg(F.max(F.col("ink") / F.col("w")).alias("most"))
    return gaps.join(most, "box", "left").select("box", F.coalesce(F.col("most") > threshold, F.lit(False)).alias("crosses"))


def page_y_offset(pages: DataFrame, runs: DataFrame, zones: DataFrame) -> DataFrame:
    """Zones (zone, doc_id, page_no, page_top_line) -> (zone, doc_id, page_no, dy); pages (doc_id, page_no, width).

    dy: the topmost rule of half the page's width or more, plus 5, less the template's; 0 if there is none or it is unset.
    """
    long = runs.where("axis = 'h'").join(pages, ["doc_id", "page_no"]).where(F.col("end") - F.col("start") >= F.floor(F.col("width") * 0.5))
    top = long.groupBy("doc_id", "page_no").agg(F.min("pos").alias("top"))
    return zones.join(top, ["doc_id", "page_no"], "left").select(
        "zone", "doc_id", "page_no", F.coalesce(F.col("top") + 5 - F.col("page_top_line"), F.lit(0)).cast("int").alias("dy")
    )


def detect_template_version(documents: DataFrame, runs: DataFrame, rules: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """Documents (doc_id, template, width, dy) and rules (template, version_no, version_template, page, y_from, y_to,
    min_width_frac) -> (doc_id, template): the first version whose rule line is there, else the template itself.

    offsets (doc_id, version_no, width, dy): each rule's own page width and shift, in place of one a document.
    """
    asked = documents.join(rules, "template")  # a few rows a template: adaptive execution broadcasts them if so
    if offsets is not None:
        asked = asked.drop("width", "dy").join(offsets, ["doc_id", "version_no"])
    r = runs.where("axis = 'h'").select(F.col("doc_id").alias("__d"), F.col("page_no").alias("__p"), "pos", (F.col("end") - F.col("start")).alias("length"))
    there = asked.join(
        r,
        (F.col("doc_id") == F.col("__d")) & (F.col("page") == F.col("__p")) & (F.col("pos") >= F.col("y_from") + F.col("dy"))
        & (F.col("pos") < F.col("y_to") + F.col("dy")) & (F.col("length") >= F.floor(F.col("width") * F.col("min_width_frac"))),
    )
    first = there.groupBy("doc_id").agg(F.min_by("version_template", "version_no").alias("version"))
    return documents.join(first, "doc_id", "left").select("doc_id", F.coalesce("version", "template").alias("template"))


def affine(frames: DataFrame) -> DataFrame:
    """G10, last step: found (top, bottom, left, right) and template anchors -> x0, y0, x_scale, y_scale."""
    span = lambda a, b: F.col(f"anchor_{b}") - F.col(f"anchor_{a}")
    scale = lambda a, b: F.when(span(a, b) != 0, (F.col(b) - F.col(a)) / span(a, b)).otherwise(1.0)
    return frames.withColumns({"x_scale": scale("left", "right"), "y_scale": scale("top", "bottom"), "x0": F.col("left"), "y0": F.col("top")})


def slack(distance: Column, has_top_line: Column) -> Column:
    """How much a search widens on pages with a top line: 4 % of the distance."""
    return F.when(has_top_line, F.floor(F.abs(distance) * 0.04)).otherwise(0).cast("int")


def zone_affine(zones: DataFrame, runs: DataFrame, thick: DataFrame | None = None, settle: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Zones (request, doc_id, page_no, anchor_*, page_top_line, y_search, x_search, dy) -> the zone's transform.

    The bottom is looked for from the found top where the page has a top line. thick: runs for the sides, see with_vline. settle: what
    is done with the zones between the searches; stored() keeps the plan of one search from holding those of all before it twice.
    """
    lined = F.col("page_top_line").isNotNull()
    wide = F.col("y_search") + slack(F.col("anchor_top") - F.coalesce("page_top_line", F.lit(0)), lined)
    strip = {"x0": F.col("anchor_left"), "x1": F.col("anchor_right")}
    spare = ("x0", "x1", "y0", "y1", "expected", "back", "fwd", "radius")
    top = zones.withColumns(strip | {"expected": F.col("anchor_top") + F.col("dy"), "back": wide, "fwd": wide})
    zones = settle(with_hline(top, runs, "top").drop(*spare))
    deep = F.col("y_search") + slack(F.col("anchor_bottom") - F.col("anchor_top"), lined)
    below = F.when(lined, F.col("top") + F.col("anchor_bottom") - F.col("anchor_top")).otherwise(F.col("anchor_bottom") + F.col("dy"))
    zones = settle(with_hline(zones.withColumns(strip | {"expected": below, "back": deep, "fwd": deep}), runs, "bottom").drop(*spare))
    for side in ("left", "right"):
        asked = zones.withColumns({"y0": F.col("top"), "y1": F.col("bottom"), "expected": F.col(f"anchor_{side}"), "radius": F.col("x_search")})
        zones = with_vline(asked, thick if thick is not None else runs, side, thick is not None, side if thick is not None else None).drop(*spare)
    return affine(zones)


def remap_boxes(fields: DataFrame, y_maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields (field, doc_id, page_no, zone, box, tx0, left, x_scale and for plain zones ty0, top, y_scale).

    y_maps (doc_id, page_no, zone, template_y, found): rows of a zone by declared lines; a plain zone has none. Returns the
    boxes, and the fields of row zones whose y is on no declared line.
    """
    placed = _remapped(fields, y_maps)
    out = ["field", "doc_id", "page_no", "zone", *[F.col(f"n{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]]
    return placed.where("NOT off_lines").select(*out), placed.where("off_lines").select("field", "doc_id", "page_no", "zone")


def _remapped(fields: DataFrame, y_maps: DataFrame) -> DataFrame:
    """fields with their new box (nx0, ny0, nx1, ny1), and whether it is on no declared line (off_lines). A zone's lines are a few dozen:
    they come to its fields as one list, so that fields are dealt by zone once."""
    on = ["doc_id", "page_no", "zone"]
    line = F.struct(F.col("template_y").cast("int").alias("t"), F.col("found").cast("int").alias("f"))
    listed = fields.join(y_maps.groupBy(*on).agg(F.collect_list(line).alias("__lines")), on, "left")
    scaled = lambda c, t, o, s: F.bround(F.col(o) + (F.col(c) - F.col(t)) * F.col(s)).cast("int")
    declared = lambda c: F.try_element_at(F.filter("__lines", lambda x: x["t"] == F.col(c)), F.lit(1))["f"]
    x = {f"n{c}": scaled(c, "tx0", "left", "x_scale") for c in ("x0", "x1")}
    y = {f"n{c}": F.when(F.col("ty0").isNull(), declared(c)).otherwise(scaled(c, "ty0", "top", "y_scale")) for c in ("y0", "y1")}
    return listed.withColumns(x | y).withColumn("off_lines", F.col("ty0").isNull() & (F.col("ny0").isNull() | F.col("ny1").isNull())).drop("__lines")


def nearest_line_above(requests: DataFrame, runs: DataFrame, ladder: Sequence[float] = (0.6, 0.4, 0.25)) -> DataFrame:
    """Requests (request, doc_id, page_no, x0, x1, y_top, max_up) -> (request, found): the centre of the thickness of
    the nearest rule above, null if none."""
    strips = requests.withColumns({"lo": F.greatest(F.lit(0), F.col("y_top") - F.col("max_up")), "hi": F.greatest(F.lit(0), F.col("y_top") - 2)})
    rows = hline_strength(strips, runs, ladder)
    band = F.col("pos") - F.row_number().over(W.partitionBy("request").orderBy("pos"))
    bands = rows.withColumn("band", band).groupBy("request", "band").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    last = bands.groupBy("request").agg(F.max_by(F.floor((F.col("a") + F.col("b")) / 2).cast("int"), "b").alias("found"))
    return requests.select("request").join(last, "request", "left")


def label_line_seeds(seeds: DataFrame) -> DataFrame:
    """Seeds (doc_id, page_no, zone, template_y, y) -> those accepted from the top down.

    The first is; each other must lie below the last accepted one, 40 pixels before to 300 after where that one predicts.
    A zone has a few dozen lines, so its list is short.
    """
    state = "struct<t:int,y:int,out:array<struct<t:int,y:int>>>"
    start = F.struct(F.lit(None).cast("int").alias("t"), F.lit(None).cast("int").alias("y"), F.array().cast("array<struct<t:int,y:int>>").alias("out")).cast(state)

    def step(a: Column, s: Column) -> Column:
        expected = a["y"] + s["t"] - a["t"]
        ok = a["y"].isNull() | ((s["y"] > a["y"]) & (s["y"] >= expected - 40) & (s["y"] <= expected + 300))
        return F.when(ok, F.struct(s["t"].alias("t"), s["y"].alias("y"), F.concat(a["out"], F.array(s)).alias("out")).cast(state)).otherwise(a)

    lines = F.array_sort(F.collect_list(F.struct(F.col("template_y").cast("int").alias("t"), F.col("y").cast("int").alias("y"))))
    lists = seeds.where("y IS NOT NULL").groupBy("doc_id", "page_no", "zone").agg(lines.alias("lines"))
    kept = lists.withColumn("x", F.explode(F.aggregate("lines", start, step, lambda a: a["out"])))
    return kept.select("doc_id", "page_no", "zone", F.col("x.t").alias("template_y"), F.col("x.y").alias("y"))


def _beside_rules(boxes: DataFrame, runs: DataFrame, expected: dict[str, Column], radius: int, least: int, when: Column, cover: float = 0.85) -> DataFrame:
    """boxes with, for each name, the place of the rule nearest to what is expected, the left one on a tie; null if there is
    none within the radius, the row is lower than ``least``, or ``when`` does not hold. Rules run through the box's row."""
    top, bottom = F.greatest(F.lit(0), F.col("y0") + 3), F.col("y1") - 3
    need = F.greatest(F.floor((bottom - top) * cover), F.lit(10))
    asked = boxes.withColumns({f"__{n}": c for n, c in expected.items()} | {"__asked": F.coalesce(when, F.lit(False)) & (bottom - top >= least)})
    # A page's rules come to its boxes as one map by bin: both are dealt by page once, and no box is copied for the bins it looks at.
    r = runs.where("axis = 'v'").select(
        F.col("doc_id").alias("__d"), F.col("page_no").alias("__p"), bin_of(F.col("pos")).alias("__bin"), F.struct("pos", "start", "end").alias("__run")
    ).repartition("__d", "__p")
    binned = r.groupBy("__d", "__p", "__bin").agg(F.collect_list("__run").alias("__runs"))
    packed = binned.groupBy("__d", "__p").agg(F.map_from_entries(F.collect_list(F.struct("__bin", "__runs"))).alias("__rules"))
    beside = asked.join(packed, (F.col("doc_id") == F.col("__d")) & (F.col("page_no") == F.col("__p")), "left")

    def near(n: str) -> Column:
        at = F.col(f"__{n}")
        seen = F.flatten(F.filter(F.transform(bins_of(at - radius, at + radius), lambda b: F.try_element_at("__rules", b)), lambda x: x.isNotNull()))
        good = lambda x: (x["pos"] >= at - radius) & (x["pos"] < at + radius) & (_kept_length(top, bottom, need, x["start"], x["end"]) > 0)
        places = F.transform(F.filter(seen, good), lambda x: F.struct(F.abs(x["pos"] - at).alias("off"), x["pos"].alias("pos")))
        return F.when(F.col("__asked"), F.array_min(places)["pos"]).alias(n)

    return beside.select(*boxes.columns, *[near(n) for n in expected])


def row_local_x(boxes: DataFrame, runs: DataFrame, radius: int = 110, when: Column | None = None) -> DataFrame:
    """Boxes (box, doc_id, page_no, x0, y0, x1, y1, t_x0, t_x1, anchor_left, anchor_right): x by the row's own frame.

    Boxes for which ``when`` does not hold stay; other columns stay.
    """
    scale = (F.col("x1") - F.col("x0")) / F.greatest(F.lit(1), F.col("t_x1") - F.col("t_x0"))
    sides = {
        "l": F.bround(F.col("x0") - (F.col("t_x0") - F.col("anchor_left")) * scale),
        "r": F.bround(F.col("x1") + (F.col("anchor_right") - F.col("t_x1")) * scale),
    }
    both = _beside_rules(boxes, runs, sides, radius, 15, F.lit(True) if when is None else when)
    frame = F.col("anchor_right") - F.col("anchor_left")
    good = F.coalesce(F.col("r") - F.col("l") >= frame * 0.7, F.lit(False)) & (frame != 0)
    moved = lambda t, old: F.when(good, F.bround(F.col("l") + (F.col(t) - F.col("anchor_left")) * (F.col("r") - F.col("l")) / frame).cast("int")).otherwise(F.col(old))
    return both.withColumns({"x0": moved("t_x0", "x0"), "x1": moved("t_x1", "x1")}).drop("l", "r")


def snap_cell_x(boxes: DataFrame, runs: DataFrame, radius: int = 90, when: Column | None = None) -> DataFrame:
    """Boxes with left and right edges on the nearest rules of their row; kept where the width would shrink below half."""
    both = _beside_rules(boxes, runs, {"l": F.col("x0"), "r": F.col("x1")}, radius, 20, F.lit(True) if when is None else when)
    l, r = F.coalesce("l", "x0"), F.coalesce("r", "x1")  # noqa: E741
    good = r - l >= (F.col("x1") - F.col("x0")) * 0.5
    return both.withColumns({"x0": F.when(good, l).otherwise(F.col("x0")), "x1": F.when(good, r).otherwise(F.col("x1"))}).drop("l", "r")


def refine_divider(boxes: DataFrame, runs: DataFrame, radius: int = 40, when: Column | None = None) -> DataFrame:
    """The top is looked for again in the box's own x range; the height stays."""
    asked = (boxes if when is None else boxes.where(F.coalesce(when, F.lit(False)))).withColumns(
        {"request": F.col("box"), "expected": F.col("y0"), "back": F.lit(radius), "fwd": F.lit(radius)}
    )
    found = find_hline(asked, runs).withColumnRenamed("request", "box")
    top = F.coalesce("found", "y0")
    return boxes.join(found, "box", "left").withColumns({"y0": top, "y1": top + F.col("y1") - F.col("y0")}).drop("found")


def resolve_boxes(fields: DataFrame, transforms: DataFrame, y_maps: DataFrame, runs: DataFrame, settle: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """Fields (field, doc_id, page_no, zone, type, x0 ..., column_refine) and transforms (doc_id, page_no, zone, tx0, left,
    x_scale, ty0, top, y_scale, anchor_left, anchor_right, row_local_x, snap_cell_x) -> boxes, and fields on no line.

    Fields of no or an unknown zone keep their box. settle: what is done with the boxes between the steps; stored() lets the shuffle
    files of one step go before the next, and each step be done once for all that comes of it.
    """
    on = ["doc_id", "page_no", "zone"]
    of = ["field", *on, "type", "column_refine", "x0", "y0", "x1", "y1"]
    solved = ["tx0", "left", "x_scale", "ty0", "top", "y_scale", "anchor_left", "anchor_right", "row_local_x", "snap_cell_x"]
    known = fields.select(*of).join(transforms.select(*on, *solved, F.lit(True).alias("known")), on, "left")
    new = [F.when(F.col("known"), F.col(f"n{c}")).otherwise(F.col(c).cast("int")).alias(c) for c in ("x0", "y0", "x1", "y1")]
    flags = ["anchor_left", "anchor_right", "row_local_x", "snap_cell_x", "known"]
    aside = (F.col("known") & F.col("off_lines")).alias("off_lines")
    placed = settle(_remapped(known, y_maps).select("field", *on, "type", "column_refine", *new, F.col("x0").alias("t_x0"), F.col("x1").alias("t_x1"), *flags, aside))

    boxes = placed.where("known AND NOT off_lines")
    boxes = row_local_x(boxes, runs, when=F.col("row_local_x"))
    boxes = snap_cell_x(boxes, runs, when=F.col("snap_cell_x") & (F.col("type") == "text"))
    boxes = settle(boxes.select("field", *on, "x0", "y0", "x1", "y1", F.coalesce("column_refine", F.lit(False)).alias("column_refine")))
    refined = refine_divider(boxes.where("column_refine").withColumn("box", F.concat_ws("/", "field", *on)), runs)
    out = ["field", *on, "x0", "y0", "x1", "y1"]
    whole = boxes.where("NOT column_refine").select(*out).unionByName(refined.select(*out)).unionByName(placed.where("known IS NULL").select(*out))
    return whole, placed.where("off_lines").select("field", *on)
