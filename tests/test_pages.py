"""Page geometry: helpers against plain versions, and whole pages drawn for the purpose."""

import random

import numpy as np

from formledger.operators import ink, lines


def page(h=400, w=300):
    return np.full((h, w), 255, np.uint8)


def image_rows(spark, images):
    rows = [(i, 1, *a.shape, 1, bytearray(a.tobytes())) for i, a in enumerate(images)]
    return spark.createDataFrame(rows, "doc_id long, page_no int, height int, width int, nChannels int, data binary")


def blobs(mask):
    """8-connected components by flood fill."""
    seen, out = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x]:
            continue
        stack, cells = [(y, x)], []
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            cells.append((a, b))
            for c in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                for d in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                    if mask[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        stack.append((c, d))
        out.append(np.array(cells))
    return out


def test_marks_as_flood_fill():
    rng = np.random.default_rng(3)
    for _ in range(40):
        mask = rng.random((30, 40)) < rng.choice([0.1, 0.35, 0.6])
        total = 0
        for cells in blobs(mask):
            h, w = np.ptp(cells, axis=0) + 1
            if not (w >= 0.9 * 40 or (h >= 0.95 * 30 and w <= 6)) and h >= 12 and w >= 8 and len(cells) >= 25:
                total += len(cells)
        assert ink.mark_of(ink.runs_of(mask), 40, 30) == (total >= 25, total / mask.size)


def test_tick_and_frame(spark):
    tick, frame = page(), page()
    for d in range(20):
        tick[110 + d, 50 + d : 54 + d] = 0
    frame[125, 40:100] = 0
    boxes = spark.createDataFrame([(f"b{i}", i, 1, 40, 100, 90, 140) for i in range(2)], "box string, doc_id long, page_no int, x0 int, y0 int, x1 int, y1 int")
    found = {r["box"]: r["checked"] for r in ink.checkbox_mark(boxes, ink.ink_runs(image_rows(spark, [tick, frame]), ink.MARKS)).collect()}
    assert found == {"b0": True, "b1": False}


def test_skew_of_a_slanted_rule():
    for angle in (-1.0, 0.5, 0.0):
        mask = np.zeros((600, 500), bool)
        for y0 in (100, 300, 500):
            for x in range(20, 480):
                mask[int(round(y0 + (x - 250) * np.tan(np.deg2rad(angle)))), x] = True
        found = ink.skew_of(ink.runs_of(ink.thickened(mask.T, 2).T), 600, 500)
        assert abs(found - angle) <= 0.15


def test_shifted_page_moves_lines_alike(spark):
    places = (50, 120, 200, 310)
    base, moved = page(), page()
    for y in places:
        base[y, 20:280] = 0
        moved[y + 7, 20:280] = 0
    for image, by in ((base, 0), (moved, 7)):
        for x in range(30, 270, 9):
            for y in places:
                image[y + by + 12 : y + by + 28, x : x + 5] = 0
    pages = image_rows(spark, [base, moved])
    zones = pages.selectExpr("doc_id", "page_no", "'z' AS zone", "20 AS anchor_left", "280 AS anchor_right", "CAST(NULL AS INT) AS check_x0", "CAST(NULL AS INT) AS check_x1", "0 AS dy")
    steps = spark.createDataFrame([("z", y, 15, 15) for y in places], "zone string, template_y int, radius_back int, radius_fwd int")
    seeds = zones.where("false").selectExpr("doc_id", "page_no", "zone", "0 AS template_y", "0 AS y")
    found = {(r["doc_id"], r["template_y"]): r["found"] for r in ink.row_sequence(zones, steps, ink.ink_runs(pages), seeds).collect()}
    assert found == {(i, y): y + 7 * i for i in range(2) for y in places}


def test_walk_search_as_spark_search(spark):
    rng = random.Random(5)
    runs = [(1, 1, "h", rng.randrange(300), a := rng.randrange(200), a + rng.randrange(5, 250)) for _ in range(200)]
    asked = [(i, 1, 1, rng.randrange(80), 150 + rng.randrange(120), rng.randrange(300), 40, 60) for i in range(60)]
    found = lines.find_hline(
        spark.createDataFrame(asked, "request long, doc_id long, page_no int, x0 int, x1 int, expected int, back int, fwd int"),
        spark.createDataFrame(runs, "doc_id long, page_no int, axis string, pos int, start int, end int"),
    )
    plain = ink.Page(np.array([r[3:] for r in runs]))
    assert {r["request"]: r["found"] for r in found.collect()} == {i: plain.hline((x0, x1), e, b, w) for i, _, _, x0, x1, e, b, w in asked}


def test_identity_transform(spark):
    fields = spark.createDataFrame([("f", 1, 1, "z", 10, 20, 30, 40, 0, 0, 1.0, 0, 0, 1.0)], "field string, doc_id long, page_no int, zone string, x0 int, y0 int, x1 int, y1 int, tx0 int, left int, x_scale double, ty0 int, top int, y_scale double")
    none = spark.createDataFrame([], "doc_id long, page_no int, zone string, template_y int, found int")
    box = lines.remap_boxes(fields, none)[0].first()
    assert (box["x0"], box["y0"], box["x1"], box["y1"]) == (10, 20, 30, 40)


def test_box_off_the_lines_is_set_aside(spark):
    fields = spark.createDataFrame([("f", 1, 1, "z", 10, 21, 30, 40, 0, 0, 1.0, None, None, None)], "field string, doc_id long, page_no int, zone string, x0 int, y0 int, x1 int, y1 int, tx0 int, left int, x_scale double, ty0 int, top int, y_scale double")
    maps = spark.createDataFrame([(1, 1, "z", 20, 25), (1, 1, "z", 40, 45)], "doc_id long, page_no int, zone string, template_y int, found int")
    good, lost = lines.remap_boxes(fields, maps)
    assert good.count() == 0 and lost.count() == 1


def test_slack_and_pairs_of_steps():
    # The first search widens by 4 % of the way from the top line, where the template has one.
    zone, asked = {"anchor_left": 0, "anchor_right": 200, "dy": 0}, []

    class Watched(ink.Page):
        def first_anchor(self, x, expected, gap, radius, check):
            asked.append((expected, gap, radius))
            return expected

    for top in (None, 50, 400):
        Watched(np.zeros((0, 3), int)).walk(zone | {"page_top_line": top}, [(400, 10, 10, False), (450, 10, 10, False)], {})
    assert asked == [(400, 50, 10), (400, 50, 24), (400, 50, 10)]
    # A step given as a pair is looked at again a gap further down if there is no ink below what was found, be its radii alike or not.
    bare = ink.Page(np.array([[100, 0, 200], [150, 0, 200], [215, 0, 200], *[[y, 20, 60] for y in range(110, 122)], *[[y, 20, 60] for y in range(225, 240)]]))
    assert bare.walk(zone, [(100, 5, 5, False), (150, 8, 8, False), (200, 8, 8, False)], {100: 100})[150] == 150
    assert bare.walk(zone, [(100, 5, 5, False), (150, 20, 20, True), (200, 8, 8, False)], {100: 100})[150] == 215


def test_outermost_band(spark):
    strengths = spark.createDataFrame([(1, p, 10) for p in (5, 6, 7, 20, 40, 41)], "request long, pos int, strength long")
    asked = spark.createDataFrame([(1, 18), (2, 33)], "request long, expected int")
    for side, place in (("left", 6), ("right", 40)):
        assert {r["request"]: r["found"] for r in lines.pick_line(asked, strengths, True, None, side).collect()} == {1: place, 2: 33}
    excluded = spark.createDataFrame([(1, 19)], "request long, pos int")
    assert {r["request"]: r["found"] for r in lines.pick_line(asked, strengths, True, excluded).collect()} == {1: 7, 2: 33}


def test_empty_and_crossed_boxes(spark):
    runs = spark.createDataFrame([(1, 1, "h", 50, 0, 100)], "doc_id long, page_no int, axis string, pos int, start int, end int")
    gaps = spark.createDataFrame([("a", 1, 1, 0, 100, 40, 20), ("b", 1, 1, 10, 10, 40, 20), ("c", 1, 1, 0, 300, 40, 20)], "box string, doc_id long, page_no int, x0 int, x1 int, y0 int, gap int")
    assert {r["box"]: r["crosses"] for r in lines.has_crossing_line(gaps, runs).collect()} == {"a": True, "b": False, "c": False}


def test_boxes_of_all_kinds(spark):
    """G18 on a page whose rules are known: a zoneless field, a plain zone, a row zone with each refinement."""
    runs = [(1, 1, "v", x, 0, 400) for x in (18, 102, 222)] + [(1, 1, "h", y, 0, 230) for y in (42, 83)] + [(1, 1, "h", 90, 100, 222)]
    runs = spark.createDataFrame(runs, "doc_id long, page_no int, axis string, pos int, start int, end int")
    fields = [("free", None, "text", False, 1, 2, 3, 4), ("plain", "p", "text", False, 10, 20, 30, 40), ("snapped", "r", "text", False, 100, 40, 220, 80), ("ticked", "r", "checkbox_single", False, 100, 40, 220, 80),
              ("refined", "r", "text", True, 100, 80, 220, 120), ("lost", "r", "text", False, 0, 41, 9, 80)]
    fields = spark.createDataFrame([(n, 1, 1, *r) for n, *r in fields], "field string, doc_id long, page_no int, zone string, type string, column_refine boolean, x0 int, y0 int, x1 int, y1 int")
    transforms = spark.createDataFrame([(1, 1, "p", 0, 5, 2.0, 0, 7, 0.5, 0, 100, None, None), (1, 1, "r", 20, 19, 1.0, None, None, None, 20, 220, None, True)],
        "doc_id long, page_no int, zone string, tx0 int, left int, x_scale double, ty0 int, top int, y_scale double, anchor_left int, anchor_right int, row_local_x boolean, snap_cell_x boolean")
    maps = spark.createDataFrame([(1, 1, "r", 40, 42), (1, 1, "r", 80, 83), (1, 1, "r", 120, 124)], "doc_id long, page_no int, zone string, template_y int, found int")
    found, lost = lines.resolve_boxes(fields, transforms, maps, runs)
    got = {r["field"]: (r["x0"], r["y0"], r["x1"], r["y1"]) for r in found.collect()}
    assert got == {"free": (1, 2, 3, 4), "plain": (25, 17, 65, 27), "snapped": (102, 42, 222, 83), "ticked": (99, 42, 219, 83), "refined": (102, 83, 222, 124)}
    assert [r["field"] for r in lost.collect()] == ["lost"]


def test_shares_of_a_width_are_floored_as_floats(spark):
    # 0.7 of 90, 180, 340 and 650 is a little less than a whole number in floating point: the opening is by one pixel less.
    for width in (90, 180, 340, 650):
        k = int(width * 0.7)
        runs = spark.createDataFrame([(1, 1, "h", 50, 5, 5 + k), (1, 1, "h", 60, 5, 5 + k - 1)], "doc_id long, page_no int, axis string, pos int, start int, end int")
        asked = spark.createDataFrame([(1, 1, 1, 0, width, 0, 100)], "request long, doc_id long, page_no int, x0 int, x1 int, lo int, hi int")
        assert [(r["pos"], r["strength"]) for r in lines.hline_strength(asked, runs).collect()] == [(50, k)]


def test_pairs_meet_in_one_bin_only(spark):
    rng = random.Random(9)
    runs = [(1, 1, "h", rng.randrange(700), a := rng.randrange(200), a + rng.randrange(5, 250)) for _ in range(300)]
    boxes = [(i, 1, 1, x := rng.randrange(200), y := rng.randrange(700), x + rng.randrange(-3, 200), y + rng.randrange(-3, 400)) for i in range(80)]
    got = {r["box"]: r["ratio"] for r in lines.ink_ratio(
        spark.createDataFrame(boxes, "box long, doc_id long, page_no int, x0 int, y0 int, x1 int, y1 int"), spark.createDataFrame(runs, "doc_id long, page_no int, axis string, pos int, start int, end int")
    ).collect()}
    for i, _, _, x0, y0, x1, y1 in boxes:
        ink_ = sum(max(0, min(e, x1) - max(s, x0)) for *_, p, s, e in runs if y0 <= p < y1)
        assert abs(got[i] - (ink_ / ((x1 - x0) * (y1 - y0)) if x1 > x0 and y1 > y0 else 0.0)) < 1e-12


def test_boxes_are_dealt_by_page_once(spark):
    """Both looks at a row's rules take one exchange of the boxes, and copy none for the bins it looks at."""
    runs = spark.createDataFrame([(1, 1, "v", p, 0, 400) for p in (98, 103, 702, 1290)], "doc_id long, page_no int, axis string, pos int, start int, end int")
    boxes = spark.createDataFrame([(k, 1, 1, 100 + k, 50, 700 + k, 90, 100, 700, 100, 700) for k in range(9)], "box long, doc_id long, page_no int, x0 int, y0 int, x1 int, y1 int, t_x0 int, t_x1 int, anchor_left int, anchor_right int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        made = lines.snap_cell_x(lines.row_local_x(boxes, runs), runs)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert {(r["x0"], r["x1"]) for r in made.collect()} == {(98, 702), (103, 702)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Generate " not in plan
    assert plan.count("Exchange hashpartitioning") <= 3  # boxes, and the rules for each look
