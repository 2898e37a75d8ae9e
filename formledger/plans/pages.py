"""Queries on page geometry and reader tokens, each with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formledger.operators import ink, lines, tokens
from formledger.plans import adapters as a
from formledger.plans.registered import register
from formledger.sources.intermediate import scratch, stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


query = register(QUERIES, ORACLES)


def rows(spark: SparkSession, sf_dir: str, adapter) -> DataFrame:
    return a.frame(spark, sf_dir, adapter)


# --- pages: ink runs by event, requests by document


def runs(q, t) -> str:
    """Horizontal rules of a page at every tenth pixel or so, some thick, some short; vertical ones likewise."""
    return f"""
      SELECT user_id AS doc_id, 1 AS page_no, CASE WHEN event_id % 3 = 0 THEN 'v' ELSE 'h' END AS axis, CAST(min(event_id * 37 % 2300) AS INT) AS pos,
             CAST(event_id * 13 % 400 AS INT) AS {q("start")}, CAST(event_id * 13 % 400 + 20 + event_id * 7 % 1500 AS INT) AS {q("end")}
      FROM {t("events")} GROUP BY user_id, event_id"""


def requests(q, t) -> str:
    return f"""
      SELECT event_id AS request, user_id AS doc_id, 1 AS page_no, CAST(100 + event_id % 200 AS INT) AS x0, CAST(900 + event_id % 500 AS INT) AS x1,
             CAST(event_id * 53 % 2200 AS INT) AS expected, CAST(60 + event_id % 90 AS INT) AS back, CAST(80 + event_id % 50 AS INT) AS fwd
      FROM {t("events")}"""


def boxes(q, t) -> str:
    return f"""
      SELECT event_id AS box, user_id AS doc_id, 1 AS page_no, CAST(event_id * 11 % 1000 AS INT) AS x0, CAST(event_id * 53 % 2200 AS INT) AS y0,
             CAST(event_id * 11 % 1000 + event_id % 300 AS INT) AS x1, CAST(event_id * 53 % 2200 + event_id % 120 AS INT) AS y1
      FROM {t("events")}"""


_RS, _RE = '"start"', '"end"'


def _kept(low: str, high: str, k: str) -> str:
    inside = f"(least(r.{_RE}, {high}) - greatest(r.{_RS}, {low}))"
    need = (
        f"CASE WHEN r.{_RS} <= {low} AND r.{_RE} >= {high} THEN 0 WHEN r.{_RS} <= {low} THEN {k} - floor({k} / 2) "
        f"WHEN r.{_RE} >= {high} THEN floor({k} / 2) + 1 ELSE {k} END"
    )
    return f"CASE WHEN {inside} > 0 AND {inside} >= {need} THEN {inside} ELSE 0 END"


def strength(asked: str, ladder=lines.LADDER, axis: str = "h", p: str = "") -> str:
    """CTEs that end in s(request, pos, strength), their names prefixed by p."""
    steps = " UNION ALL ".join(
        f"SELECT request, {i} AS step, pos, {_kept('x0', 'x1', f'greatest(floor((x1 - x0) * {share}::DOUBLE), 10)')} AS kept FROM {p}z q JOIN runs r "
        f"ON r.doc_id = q.doc_id AND r.page_no = q.page_no AND axis = '{axis}' AND pos >= lo AND pos < hi"
        for i, share in enumerate(ladder)
    )
    return f"""{p}z AS ({asked}), {p}y AS ({steps}),
{p}x AS (SELECT request, step, pos, sum(kept) AS strength FROM {p}y WHERE kept > 0 GROUP BY 1, 2, 3),
{p}s AS (SELECT request, pos, CAST(strength AS BIGINT) AS strength FROM (SELECT *, min(step) OVER (PARTITION BY request) AS first FROM {p}x) WHERE step = first)"""


_STRIP = "SELECT *, greatest(0, expected - back) AS lo, expected + fwd AS hi FROM requests"
_NEAR = """p AS (SELECT s.request, arg_min(pos, (abs(pos - expected), pos)) AS pos FROM (SELECT *, max(strength) OVER (PARTITION BY request) AS most FROM s) s
  JOIN requests q ON q.request = s.request WHERE 2 * strength >= most GROUP BY 1)"""
_H = a.cte(runs, requests) + ", " + strength(_STRIP)


def asked(spark, sf_dir):
    return rows(spark, sf_dir, requests)


@query(_H + " SELECT request, pos, strength FROM s")
def g2_hline_strength(spark, sf_dir):
    strips = asked(spark, sf_dir).withColumns({"lo": F.greatest(F.lit(0), F.col("expected") - F.col("back")), "hi": F.col("expected") + F.col("fwd")})
    return lines.hline_strength(strips, rows(spark, sf_dir, runs)).withColumn("strength", F.col("strength").cast("long"))


@query(_H + ", " + _NEAR + " SELECT q.request, coalesce(pos, expected) AS found FROM requests q LEFT JOIN p ON p.request = q.request")
def g3_pick_hline(spark, sf_dir):
    return lines.find_hline(asked(spark, sf_dir), rows(spark, sf_dir, runs))


_V = a.cte(runs, requests) + ", " + strength("SELECT request, doc_id, page_no, expected, x0, x1, greatest(0, expected - back) AS lo, expected + back AS hi FROM requests", (0.7,), "v")


@query(_V + ", p AS (SELECT request, arg_max(pos, (strength, -pos)) AS pos FROM s GROUP BY 1) SELECT q.request, coalesce(pos, expected) AS found FROM requests q LEFT JOIN p ON p.request = q.request")
def g4_pick_vline(spark, sf_dir):
    sides = asked(spark, sf_dir).selectExpr("request", "doc_id", "page_no", "x0 AS y0", "x1 AS y1", "expected", "back AS radius")
    return lines.find_vline(sides, rows(spark, sf_dir, runs))


_INK = f"greatest(0, least(r.{_RE}, x1) - greatest(r.{_RS}, x0))"
_ON = "r.doc_id = b.doc_id AND r.page_no = b.page_no AND axis = 'h'"


@query(a.cte(runs, boxes) + f""", i AS (SELECT box, sum({_INK}) AS ink FROM boxes b JOIN runs r ON {_ON} AND pos >= y0 AND pos < y1 GROUP BY 1)
SELECT b.box, CASE WHEN x1 > x0 AND y1 > y0 THEN coalesce(ink, 0) / ((x1 - x0) * (y1 - y0)) ELSE 0.0 END::DOUBLE AS ratio FROM boxes b LEFT JOIN i ON i.box = b.box""")
def g5_ink_ratio(spark, sf_dir):
    return lines.ink_ratio(rows(spark, sf_dir, boxes), rows(spark, sf_dir, runs))


@query(a.cte(runs, boxes) + f""", g AS (SELECT *, y0 + floor((y1 - y0) * 0.35::DOUBLE)::INT AS a, y0 + floor((y1 - y0) * 0.75::DOUBLE)::INT AS z FROM boxes),
i AS (SELECT box, pos, sum({_INK}) / (x1 - x0) AS share FROM g b JOIN runs r ON {_ON} AND pos >= a AND pos < z WHERE x1 > x0 GROUP BY box, pos, x1 - x0)
SELECT b.box, coalesce(max(share) > 0.8, false) AS crosses FROM boxes b LEFT JOIN i ON i.box = b.box GROUP BY b.box""")
def g6_has_crossing_line(spark, sf_dir):
    gaps = rows(spark, sf_dir, boxes).selectExpr("box", "doc_id", "page_no", "x0", "x1", "y0", "y1 - y0 AS gap")
    return lines.has_crossing_line(gaps, rows(spark, sf_dir, runs))


_TOPS = f", t AS (SELECT doc_id, min(pos) AS top FROM runs WHERE axis = 'h' AND {_RE} - {_RS} >= 826 GROUP BY 1)"


@query(a.cte(runs) + _TOPS + "SELECT DISTINCT r.doc_id, coalesce(top + 5 - 139, 0)::INT AS dy FROM runs r LEFT JOIN t ON t.doc_id = r.doc_id")
def g8_page_y_offset(spark, sf_dir):
    found = rows(spark, sf_dir, runs)
    pages = found.select("doc_id", "page_no").distinct().withColumn("width", F.lit(1653))
    zones = pages.select("doc_id", "page_no", F.lit("z").alias("zone"), F.lit(139).alias("page_top_line"))
    return lines.page_y_offset(pages, found, zones).select("doc_id", "dy")


@query(a.cte(runs) + _TOPS + f""", d AS (SELECT DISTINCT r.doc_id, coalesce(top + 5 - 139, 0)::INT AS dy FROM runs r LEFT JOIN t ON t.doc_id = r.doc_id),
v AS (SELECT * FROM (VALUES (1, 'v1.1', 1960, 2250, 826), (2, 'v1.2', 500, 900, 1322)) v(no, name, y0, y1, least))
SELECT d.doc_id, coalesce(arg_min(name, no) FILTER (WHERE r.doc_id IS NOT NULL), 'base') AS template FROM d CROSS JOIN v
  LEFT JOIN runs r ON r.doc_id = d.doc_id AND axis = 'h' AND pos >= y0 + dy AND pos < y1 + dy AND {_RE} - {_RS} >= least GROUP BY d.doc_id""")
def g9_detect_template_version(spark, sf_dir):
    documents = g8_page_y_offset(spark, sf_dir).selectExpr("doc_id", "dy", "'base' AS template", "1653 AS width")
    rules = spark.createDataFrame(
        [("base", 1, "v1.1", 1, 1960, 2250, 0.5), ("base", 2, "v1.2", 1, 500, 900, 0.8)],
        "template string, version_no int, version_template string, page int, y_from int, y_to int, min_width_frac double",
    )
    return lines.detect_template_version(documents, rows(spark, sf_dir, runs), rules)


def zones(q, t) -> str:
    return f"""
      SELECT event_id AS request, user_id AS doc_id, 1 AS page_no, concat('z', event_id) AS zone, 163 AS anchor_left, CAST(300 + event_id % 900 AS INT) AS anchor_top,
             1473 AS anchor_right, CAST(700 + event_id % 1100 AS INT) AS anchor_bottom, CASE WHEN event_id % 2 = 0 THEN 139 END AS page_top_line,
             40 AS y_search, 120 AS x_search, CAST(event_id % 30 AS INT) AS dy
      FROM {t("events")}"""


_SLACK = "CASE WHEN page_top_line IS NOT NULL THEN floor(abs({}) * 0.04::DOUBLE)::INT ELSE 0 END"


def _found(asked: str, name: str, p: str, axis: str = "h") -> str:
    """CTEs that end in a table ``name``: the zones of ``asked`` with the line found as one more column of that name."""
    best = (
        f"SELECT s.request, arg_min(pos, (abs(pos - expected), pos)) AS pos FROM (SELECT *, max(strength) OVER (PARTITION BY request) AS most FROM {p}s) s "
        f"JOIN {p}z q ON q.request = s.request WHERE 2 * strength >= most GROUP BY 1"
        if axis == "h"
        else f"SELECT request, arg_max(pos, (strength, -pos)) AS pos FROM {p}s GROUP BY 1"
    )
    ladder = lines.LADDER if axis == "h" else (0.7,)
    return strength(asked, ladder, axis, p) + f""", {p}p AS ({best}),
{name}_of AS (SELECT q.* EXCLUDE (x0, x1, expected, lo, hi), coalesce(pos, expected) AS "{name}" FROM {p}z q LEFT JOIN {p}p ON {p}p.request = q.request)"""


def _strip(of: str, expected: str, wide: str, x0: str = "anchor_left", x1: str = "anchor_right") -> str:
    return f"SELECT *, greatest(0, expected - wide) AS lo, expected + wide AS hi FROM (SELECT *, {x0} AS x0, {x1} AS x1, {expected} AS expected, {wide} AS wide FROM {of})"


_ZONES = a.cte(runs, zones) + ", " + ", ".join(
    (
        _found(_strip("zones", "anchor_top + dy", "y_search + " + _SLACK.format("anchor_top - coalesce(page_top_line, 0)")), "top", "t_"),
        _found(_strip("(SELECT * EXCLUDE (wide) FROM top_of)", "CASE WHEN page_top_line IS NOT NULL THEN top + anchor_bottom - anchor_top ELSE anchor_bottom + dy END", "y_search + " + _SLACK.format("anchor_bottom - anchor_top")), "bottom", "b_"),
        _found(_strip("(SELECT * EXCLUDE (wide) FROM bottom_of)", "anchor_left", "x_search", "top", "bottom"), "left", "l_", "v"),
        _found(_strip("(SELECT * EXCLUDE (wide) FROM left_of)", "anchor_right", "x_search", "top", "bottom"), "right", "r_", "v"),
    )
)


@query(_ZONES + """ SELECT request, doc_id, "left" AS x0, top AS y0, (("right" - "left") / (anchor_right - anchor_left))::DOUBLE AS x_scale,
  CASE WHEN anchor_bottom = anchor_top THEN 1.0 ELSE (bottom - top) / (anchor_bottom - anchor_top) END::DOUBLE AS y_scale FROM right_of""")
def g10_zone_affine(spark, sf_dir):
    return lines.zone_affine(rows(spark, sf_dir, zones), rows(spark, sf_dir, runs)).select("request", "doc_id", "x0", "y0", "x_scale", "y_scale")


def placed(q, t) -> str:
    return f"""
      SELECT event_id AS field, user_id AS doc_id, 1 AS page_no, CASE WHEN event_id % 2 = 0 THEN 'rows' ELSE 'plain' END AS zone,
             CAST(200 + event_id % 300 AS INT) AS x0, CAST(300 + event_id % 8 * 50 AS INT) AS y0, CAST(600 + event_id % 500 AS INT) AS x1, CAST(350 + event_id % 8 * 50 AS INT) AS y1,
             160 AS tx0, CAST(150 + user_id % 20 AS INT) AS {q("left")}, 1 + CAST(user_id % 7 AS DOUBLE) / 100 AS x_scale, CASE WHEN event_id % 2 = 1 THEN 290 END AS ty0,
             CAST(295 + user_id % 11 AS INT) AS top, 1 - CAST(user_id % 5 AS DOUBLE) / 100 AS y_scale
      FROM {t("events")}"""


def y_maps(q, t) -> str:
    return f"""SELECT user_id AS doc_id, 1 AS page_no, 'rows' AS zone, CAST(300 + event_id % 8 * 50 AS INT) AS template_y, CAST(max(303 + event_id % 8 * 51) AS INT) AS found
      FROM {t("events")} WHERE event_id % 8 < 6 GROUP BY 1, 4"""


@query(a.cte(placed, y_maps) + """, b AS (SELECT f.*, a.found AS ny0, z.found AS ny1 FROM placed f
  LEFT JOIN y_maps a ON a.doc_id = f.doc_id AND a.zone = f.zone AND a.template_y = f.y0 LEFT JOIN y_maps z ON z.doc_id = f.doc_id AND z.zone = f.zone AND z.template_y = f.y1)
SELECT field, doc_id, 'box' AS status, round_even("left" + (x0 - tx0) * x_scale, 0)::INT AS x0, CASE WHEN ty0 IS NULL THEN ny0 ELSE round_even(top + (y0 - ty0) * y_scale, 0)::INT END AS y0,
  round_even("left" + (x1 - tx0) * x_scale, 0)::INT AS x1, CASE WHEN ty0 IS NULL THEN ny1 ELSE round_even(top + (y1 - ty0) * y_scale, 0)::INT END AS y1
FROM b WHERE ty0 IS NOT NULL OR (ny0 IS NOT NULL AND ny1 IS NOT NULL)
UNION ALL SELECT field, doc_id, 'set aside', NULL, NULL, NULL, NULL FROM b WHERE ty0 IS NULL AND (ny0 IS NULL OR ny1 IS NULL)""")
def g12_remap_boxes(spark, sf_dir):
    return _both(*lines.remap_boxes(rows(spark, sf_dir, placed), rows(spark, sf_dir, y_maps)))


def _both(found: DataFrame, lost: DataFrame) -> DataFrame:
    """Boxes, and the fields that no line was declared for."""
    boxes_ = found.withColumn("status", F.lit("box")).drop("page_no", "zone")
    return boxes_.unionByName(lost.select("field", "doc_id", F.lit("set aside").alias("status")), allowMissingColumns=True)


_ABOVE = a.cte(runs, requests) + ", " + strength("SELECT *, greatest(0, expected - 120) AS lo, greatest(0, expected - 2) AS hi FROM requests", (0.6, 0.4, 0.25))


@query(_ABOVE + """, i AS (SELECT request, pos, pos - row_number() OVER (PARTITION BY request ORDER BY pos) AS band FROM s),
b AS (SELECT request, band, min(pos) AS a, max(pos) AS z FROM i GROUP BY 1, 2), l AS (SELECT request, arg_max(((a + z) // 2)::INT, z) AS found FROM b GROUP BY 1)
SELECT q.request, found FROM requests q LEFT JOIN l ON l.request = q.request""")
def g13_nearest_line_above(spark, sf_dir):
    return lines.nearest_line_above(asked(spark, sf_dir).selectExpr("request", "doc_id", "page_no", "x0", "x1", "expected AS y_top", "120 AS max_up"), rows(spark, sf_dir, runs))


@query(_ABOVE.replace("WITH ", "WITH RECURSIVE ", 1) + """, i AS (SELECT request, pos, pos - row_number() OVER (PARTITION BY request ORDER BY pos) AS band FROM s),
b AS (SELECT request, band, min(pos) AS a, max(pos) AS z FROM i GROUP BY 1, 2), l AS (SELECT request, arg_max(((a + z) // 2)::INT, z) AS found FROM b GROUP BY 1),
o AS (SELECT q.doc_id, expected AS t, found AS y, row_number() OVER (PARTITION BY q.doc_id ORDER BY expected, found) AS n FROM requests q JOIN l ON l.request = q.request),
c AS (
  SELECT doc_id, n, t, y, t AS at_t, y AS at_y, true AS ok FROM o WHERE n = 1
  UNION ALL
  SELECT doc_id, n, t, y, CASE WHEN ok THEN t ELSE at_t END, CASE WHEN ok THEN y ELSE at_y END, ok FROM (
    SELECT o.doc_id, o.n, o.t, o.y, c.at_t, c.at_y, o.y > c.at_y AND o.y >= c.at_y + o.t - c.at_t - 40 AND o.y <= c.at_y + o.t - c.at_t + 300 AS ok
    FROM c JOIN o ON o.doc_id = c.doc_id AND o.n = c.n + 1)
)
SELECT doc_id, 1 AS page_no, 'z' AS zone, t AS template_y, y FROM c WHERE ok""")
def g14_label_line_seeds(spark, sf_dir):
    above = g13_nearest_line_above(spark, sf_dir).join(asked(spark, sf_dir), "request")
    return lines.label_line_seeds(above.selectExpr("doc_id", "page_no", "'z' AS zone", "expected AS template_y", "found AS y"))


def _rules(floor: int) -> str:
    top, bottom = "greatest(0, y0 + 3)", "(y1 - 3)"
    k = f"greatest(floor(({bottom} - {top}) * 0.85::DOUBLE), 10)"
    return f"""v AS (SELECT DISTINCT box, pos FROM (SELECT box, pos, {_kept(top, bottom, k)} AS kept FROM boxes b JOIN runs r
  ON r.doc_id = b.doc_id AND r.page_no = b.page_no AND axis = 'v' AND pos >= 0 WHERE {bottom} - {top} >= {floor}) WHERE kept > 0)"""


def _nearest(name: str, expected: str, radius: int) -> str:
    return f"""{name} AS (SELECT b.box, arg_min(pos, (abs(pos - {expected}), pos)) AS at FROM boxes b JOIN v ON v.box = b.box
  WHERE pos >= {expected} - {radius} AND pos < {expected} + {radius} GROUP BY 1)"""


_T0, _T1 = "(x0 - 5)", "(x1 + 7)"
_SCALE = f"((x1 - x0) / greatest(1, {_T1} - {_T0}))"


@query(a.cte(runs, boxes) + ", " + _rules(15) + ", " + _nearest("l", f"round_even(x0 - ({_T0} - 100) * {_SCALE}, 0)", 110) + ", " + _nearest("h", f"round_even(x1 + (700 - {_T1}) * {_SCALE}, 0)", 110) + f"""
SELECT b.box, CASE WHEN h.at - l.at >= 420 THEN round_even(l.at + ({_T0} - 100) * (h.at - l.at) / 600, 0)::INT ELSE x0 END AS x0,
  CASE WHEN h.at - l.at >= 420 THEN round_even(l.at + ({_T1} - 100) * (h.at - l.at) / 600, 0)::INT ELSE x1 END AS x1
FROM boxes b LEFT JOIN l ON l.box = b.box LEFT JOIN h ON h.box = b.box""")
def g15_row_local_x(spark, sf_dir):
    framed = rows(spark, sf_dir, boxes).selectExpr("*", "x0 - 5 AS t_x0", "x1 + 7 AS t_x1", "100 AS anchor_left", "700 AS anchor_right")
    return lines.row_local_x(framed, rows(spark, sf_dir, runs)).select("box", "x0", "x1")


@query(a.cte(runs, boxes) + ", " + _rules(20) + ", " + _nearest("l", "x0", 90) + ", " + _nearest("h", "x1", 90) + """
SELECT b.box, CASE WHEN coalesce(h.at, x1) - coalesce(l.at, x0) >= (x1 - x0) * 0.5 THEN coalesce(l.at, x0) ELSE x0 END AS x0,
  CASE WHEN coalesce(h.at, x1) - coalesce(l.at, x0) >= (x1 - x0) * 0.5 THEN coalesce(h.at, x1) ELSE x1 END AS x1
FROM boxes b LEFT JOIN l ON l.box = b.box LEFT JOIN h ON h.box = b.box""")
def g16_snap_cell_x(spark, sf_dir):
    return lines.snap_cell_x(rows(spark, sf_dir, boxes), rows(spark, sf_dir, runs)).select("box", "x0", "x1")


_OWN = a.cte(runs, boxes) + ", " + strength("SELECT *, box AS request, greatest(0, y0 - 40) AS lo, y0 + 40 AS hi FROM boxes")


@query(_OWN + """, p AS (SELECT s.request, arg_min(pos, (abs(pos - y0), pos)) AS pos FROM (SELECT *, max(strength) OVER (PARTITION BY request) AS most FROM s) s
  JOIN boxes b ON b.box = s.request WHERE 2 * strength >= most GROUP BY 1)
SELECT box, coalesce(pos, y0) AS y0, coalesce(pos, y0) + y1 - y0 AS y1 FROM boxes b LEFT JOIN p ON p.request = b.box""")
def g17_refine_divider(spark, sf_dir):
    return lines.refine_divider(rows(spark, sf_dir, boxes), rows(spark, sf_dir, runs)).select("box", "y0", "y1")


@query()
def g18_resolve_boxes(spark, sf_dir):
    fields = rows(spark, sf_dir, placed).selectExpr("field", "doc_id", "page_no", "zone", "x0", "y0", "x1", "y1", "'text' AS type", "field % 6 = 0 AS column_refine")
    moved = rows(spark, sf_dir, placed).where("doc_id % 10 > 0").groupBy("doc_id", "page_no", "zone").agg(
        *[F.first(c).alias(c) for c in ("tx0", "left", "x_scale", "ty0", "top", "y_scale")]
    )
    flags = moved.selectExpr("*", "160 AS anchor_left", "1470 AS anchor_right", "zone = 'rows' AS row_local_x", "zone = 'rows' AS snap_cell_x")
    with scratch(spark) as keep:
        return keep(_both(*lines.resolve_boxes(fields, flags, rows(spark, sf_dir, y_maps), rows(spark, sf_dir, runs), stored)))


# --- helpers on pixels


def images(vectors: DataFrame) -> DataFrame:
    """A page image for each vector: rules where its elements are large, across a small page, and a tick."""

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for number, v in zip(part["vec_id"], part["embedding"], strict=True):
                x = np.abs(np.asarray(v, float))
                page = np.full((160, 120), 255, np.uint8)
                for k in np.flatnonzero(x > 0.15):
                    page[2 * k + 4, 10 : 110 - int(k) % 7] = 0
                page[4:150, 10] = page[4:150, 109] = 0
                for d in range(16):
                    page[20 + d, 40 + d // 2 : 43 + d // 2] = 40
                out.append((number, 1, 160, 120, 1, page.tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "page_no", "height", "width", "nChannels", "data"])

    return vectors.select("vec_id", "embedding").mapInPandas(draw, "doc_id long, page_no int, height int, width int, nChannels int, data binary")


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query()
def g1_ink_runs(spark, sf_dir):
    return ink.ink_runs(drawn(spark, sf_dir), least=5)


@query()
def g11_row_sequence(spark, sf_dir):
    """The first line is verified, the others follow from the one before."""
    pages = drawn(spark, sf_dir)
    walked = pages.selectExpr("doc_id", "page_no", "'table' AS zone", "10 AS anchor_left", "109 AS anchor_right", "CAST(NULL AS INT) AS check_x0", "CAST(NULL AS INT) AS check_x1", "CAST(doc_id % 3 AS INT) AS dy")
    steps = spark.createDataFrame([("table", 10, 6, 6), ("table", 40, 8, 8), ("table", 70, 4, 20), ("table", 100, 8, 8)], "zone string, template_y int, radius_back int, radius_fwd int")
    seeds = pages.where("doc_id % 4 = 0").selectExpr("doc_id", "page_no", "'table' AS zone", "40 AS template_y", "41 AS y")
    return ink.row_sequence(walked, steps, ink.ink_runs(pages), seeds)


@query()
def g19_estimate_skew(spark, sf_dir):
    pages = drawn(spark, sf_dir)
    return ink.estimate_skew(pages, ink.ink_runs(pages, ink.SKEW, least=12))


@query()
def g20_checkbox_mark(spark, sf_dir):
    pages = drawn(spark, sf_dir)
    marked = pages.selectExpr("concat('b', doc_id) AS box", "doc_id", "page_no", "30 AS x0", "CASE WHEN doc_id % 2 = 0 THEN 12 ELSE 60 END AS y0", "64 AS x1", "CASE WHEN doc_id % 2 = 0 THEN 44 ELSE 92 END AS y1")
    return ink.checkbox_mark(marked, ink.ink_runs(pages, ink.MARKS))


# --- tokens


_LABELS = ("The", "the", "of", "inthe", "dela", "de", "der", "quela", "ofthe", "and", "zzz")


def _words(spark, sf_dir):
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    each = talks.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("p", "text")).where("text <> ''")
    return each.selectExpr(
        "conv_id AS doc_id", "1 AS page_no", "CAST(turn AS INT) AS block", "0 AS para", "p + 1 AS word", "text", "CAST((p + 1) * 40 % 1600 AS INT) AS x0",
        "CAST(turn * 60 + (p + 1) * 40 div 1600 AS INT) AS y0", "CAST((p + 1) * 40 % 1600 + 35 AS INT) AS x1", "CAST(turn * 60 + (p + 1) * 40 div 1600 + 18 AS INT) AS y1",
    )


_WORDS_SQL = """WITH e AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS text, unnest(range(1, len(string_split(text, ' ')) + 1)) AS word FROM conversations),
words AS (SELECT conv_id AS doc_id, turn::INT AS block, word::INT AS word, text, (word * 40 % 1600)::INT AS x0, (turn * 60 + word * 40 // 1600)::INT AS y0,
  (word * 40 % 1600 + 35)::INT AS x1, (turn * 60 + word * 40 // 1600 + 18)::INT AS y1 FROM e WHERE text <> '')"""


@query(_WORDS_SQL + f""", n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY word) AS i FROM words),
k AS (SELECT unnest(range(1, 7)) AS k), l AS (SELECT unnest({list(_LABELS)}) AS label),
r AS (SELECT a.doc_id, a.block, a.word, k.k, string_agg(b.text, '' ORDER BY b.word) AS joined, count(*) AS c, min(b.x0) AS x0, min(b.y0) AS y0, max(b.x1) AS x1, max(b.y1) AS y1
  FROM n a CROSS JOIN k JOIN n b ON b.doc_id = a.doc_id AND b.block = a.block AND b.i >= a.i AND b.i < a.i + k.k GROUP BY 1, 2, 3, 4),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block, word, k ORDER BY length(label) DESC, label) AS q FROM r JOIN l ON starts_with(joined, label) WHERE c = k),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY block, word, k) AS z FROM h WHERE q = 1)
SELECT doc_id, label, x0, y0, x1, y1, k::INT AS n_words FROM f WHERE z = 1""")
def o1_find_label_boxes(spark, sf_dir):
    labels = spark.createDataFrame([(x,) for x in _LABELS], "label string")
    return tokens.find_label_boxes(_words(spark, sf_dir), labels).drop("page_no")


_FIELD_BOXES = (
    "conv_id AS doc_id", "1 AS page_no", "concat('f', turn) AS field", "CAST(turn * 90 % 900 AS INT) AS x0", "CAST(turn * 60 AS INT) AS y0",
    "CAST(turn * 90 % 900 + 500 AS INT) AS x1", "CAST(turn * 60 + 40 AS INT) AS y1",
)


@query(_WORDS_SQL + f""", b AS (SELECT {", ".join(_FIELD_BOXES)} FROM conversations)
SELECT b.doc_id, b.field, coalesce(trim(replace(string_agg(w.text, '' ORDER BY w.block, w.word, w.text), chr(10), ' ')), '') AS value
FROM b LEFT JOIN words w ON w.doc_id = b.doc_id AND (w.x0 + w.x1) / 2 >= b.x0 AND (w.x0 + w.x1) / 2 < b.x1 AND (w.y0 + w.y1) / 2 >= b.y0 AND (w.y0 + w.y1) / 2 < b.y1 GROUP BY 1, 2""")
def o2_tokens_to_fields(spark, sf_dir):
    placed_ = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr(*_FIELD_BOXES)
    return tokens.tokens_to_fields(_words(spark, sf_dir), placed_)


def symbols(q, t) -> str:
    return f"""SELECT user_id AS sheet_id, concat('', event_id % 10) AS text, CAST(event_id * 17 % 600 AS INT) AS x0, CAST(event_id * 29 % 400 AS INT) AS y0,
      CAST(event_id * 17 % 600 + 20 AS INT) AS x1, CAST(event_id * 29 % 400 + 30 AS INT) AS y1, 100 AS slot_w, 100 AS slot_h, event_id FROM {t("events")}
      UNION ALL SELECT user_id, concat('', event_id % 10), CAST(event_id * 17 % 600 + 1 AS INT), CAST(event_id * 29 % 400 + 1 AS INT),
      CAST(event_id * 17 % 600 + 21 AS INT), CAST(event_id * 29 % 400 + 31 AS INT), 100, 100, event_id + 1000000000 FROM {t("events")} WHERE event_id % 4 = 0"""


def slots(q, t) -> str:
    return f"SELECT DISTINCT user_id AS sheet_id, CAST(event_id % 24 AS BIGINT) AS slot FROM {t('events')} WHERE event_id % 5 <> 0"


@query(a.cte(symbols, slots) + """, s AS (SELECT *, (floor((y0 + y1) / 2 / slot_h) * 6 + floor((x0 + x1) / 2 / slot_w))::BIGINT AS slot FROM symbols)
SELECT event_id, s.sheet_id, s.slot FROM s WHERE EXISTS (SELECT 1 FROM slots p WHERE p.sheet_id = s.sheet_id AND p.slot = s.slot)""")
def o3_assign_symbols_to_slots(spark, sf_dir):
    return tokens.assign_symbols_to_slots(rows(spark, sf_dir, symbols), rows(spark, sf_dir, slots)).select("event_id", "sheet_id", "slot")


_OVERLAP = "(least({0}.{2}1, {1}.{2}1) - greatest({0}.{2}0, {1}.{2}0))"
_AREA = "(greatest(0, {0}.x1 - {0}.x0) * greatest(0, {0}.y1 - {0}.y0))"
_SAME = " AND ".join((
    "k.text = o.cell.text", _OVERLAP.format("k", "o.cell", "x") + " > 0", _OVERLAP.format("k", "o.cell", "y") + " > 0",
    _OVERLAP.format("k", "o.cell", "x") + " * " + _OVERLAP.format("k", "o.cell", "y") + f" > 0.5 * greatest(least({_AREA.format('k')}, {_AREA.format('o.cell')}), 1)",
))


@query(a.cte(symbols, slots).replace("WITH ", "WITH RECURSIVE ", 1) + f""", s AS (SELECT *, (floor((y0 + y1) / 2 / slot_h) * 6 + floor((x0 + x1) / 2 / slot_w))::BIGINT AS slot FROM symbols),
o AS (SELECT sheet_id, slot, row_number() OVER (PARTITION BY sheet_id, slot ORDER BY x0, y0, x1, y1, text) AS n, struct_pack(text := text, x0 := x0, y0 := y0, x1 := x1, y1 := y1) AS cell
  FROM s WHERE EXISTS (SELECT 1 FROM slots p WHERE p.sheet_id = s.sheet_id AND p.slot = s.slot)),
r AS (
  SELECT sheet_id, slot, n, [cell] AS kept FROM o WHERE n = 1
  UNION ALL
  SELECT o.sheet_id, o.slot, o.n, CASE WHEN len(list_filter(kept, lambda k: {_SAME})) > 0 THEN kept ELSE list_append(kept, o.cell) END
  FROM r JOIN o ON o.sheet_id = r.sheet_id AND o.slot = r.slot AND o.n = r.n + 1
), f AS (SELECT sheet_id, slot, arg_max(array_to_string(list_transform(kept, lambda k: k.text), ''), n) AS value FROM r GROUP BY 1, 2)
SELECT p.sheet_id, p.slot, coalesce(value, '') AS value FROM slots p LEFT JOIN f ON f.sheet_id = p.sheet_id AND f.slot = p.slot""")
def o4_dedupe_symbols(spark, sf_dir):
    held = rows(spark, sf_dir, slots)
    return tokens.dedupe_symbols(tokens.assign_symbols_to_slots(rows(spark, sf_dir, symbols), held), held)
