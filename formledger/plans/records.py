"""Queries on records, readings, ledgers and scores, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formledger.functions import fields as f
from formledger.functions import values as v
from formledger.operators import cells, intake, ledger, scoring, validation
from formledger.plans import adapters as a
from formledger.plans.registered import register

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


query = register(QUERIES, ORACLES)


Q = a.ansi_name
NUM = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip(x: str) -> str:
    return f"trim(coalesce({x}, ''), '{v.SPACE}')"


def num(x: str) -> str:
    text = f"translate({strip(x)}, '{v.WIDE_DIGITS}', '0123456789')"
    return f"CASE WHEN regexp_matches({text}, '{NUM}') THEN CAST({text} AS DOUBLE) END"


def num_comma(x: str) -> str:
    return num(f"replace(coalesce({x}, ''), ',', '')")


LOOK = "translate({x}, '" + v.LOOKALIKES + "', '" + v.MEANT + "')"


def clean(x: str) -> str:
    kept = rf"regexp_replace(regexp_replace({LOOK.format(x=x)}, '[^0-9.]', '', 'g'), '^\.+|\.+$', '', 'g')"
    return f"CASE WHEN regexp_matches({kept}, '[0-9]') THEN {kept} ELSE {x} END"


def rows(spark: SparkSession, sf_dir: str, adapter) -> DataFrame:
    return a.frame(spark, sf_dir, adapter)


# --- intake


@query(a.cte(a.submissions) + """
SELECT doc_id, CASE document_type WHEN 'vendor_form' THEN 'supplier_form' WHEN 'supplier' THEN 'supplier_form' WHEN 'evaluation' THEN 'supplier_evaluation'
  WHEN 'eval_form' THEN 'supplier_evaluation' WHEN 'supplier_eval' THEN 'supplier_evaluation' ELSE document_type END AS document_type FROM submissions""")
def i1_canonical_doc_type(spark, sf_dir):
    return rows(spark, sf_dir, a.submissions).select("doc_id", v.canonical_doc_type(F.col("document_type")).alias("document_type"))


@query(a.cte(a.submissions) + """
SELECT doc_id, CASE WHEN document_type = 'quotation' THEN '501_quotation' WHEN document_type = 'letter' THEN '400_document_type'
  WHEN size_bytes = 0 THEN '400_empty' WHEN size_bytes > 20971520 THEN '413_too_large' END AS reason FROM submissions""")
def i2_triage_submissions(spark, sf_dir):
    good, bad = intake.triage_submissions(rows(spark, sf_dir, a.submissions))
    return bad.select("doc_id", "reason").unionByName(good.select("doc_id", F.lit(None).cast("string").alias("reason")))


@query(a.cte(a.submissions) + r"""
SELECT doc_id, CASE WHEN lower(file_name) LIKE '%.pdf' OR starts_with(html, '%PDF') THEN 'pdf'
  WHEN regexp_matches(lower(file_name), '\.(png|jpg|jpeg|webp|bmp|tif|tiff)$') THEN 'image' END AS format FROM submissions""")
def i3_supported_format(spark, sf_dir):
    return rows(spark, sf_dir, a.submissions).select("doc_id", intake.file_format(F.col("file_name"), F.col("html").cast("binary")).alias("format"))


_PAGES = """
      SELECT b * 3 + CASE WHEN k = 0 THEN 0 WHEN k < 3 THEN 1 ELSE 2 END AS doc_id, CASE WHEN b % 2 = 0 THEN 'supplier_form' ELSE 'supplier_evaluation' END AS document_type,
             CAST(k - CASE WHEN k = 0 THEN 0 WHEN k < 3 THEN 1 ELSE 3 END + 1 AS INT) AS page_no
      FROM (SELECT CAST(floor(event_id / 6) AS BIGINT) AS b, event_id % 6 AS k FROM {})"""


def pages_of(q, t) -> str:
    """Documents of one, two and three pages: every event is a page."""
    return _PAGES.format(t("events"))


@query(a.cte(pages_of) + """, c AS (SELECT doc_id, document_type, count(*) AS n FROM pages_of GROUP BY 1, 2),
j AS (SELECT *, CASE document_type WHEN 'supplier_form' THEN 1 ELSE 2 END AS needed FROM c)
SELECT p.doc_id, p.document_type, page_no, n AS n_pages, needed, CASE WHEN n > needed THEN 'cut' WHEN n < needed THEN 'rejected' ELSE 'ok' END AS status
FROM pages_of p JOIN j ON p.doc_id = j.doc_id AND p.document_type = j.document_type WHERE page_no <= needed""")
def i4_check_page_count(spark, sf_dir):
    """The pages to read, and those of documents that are rejected."""
    pages = rows(spark, sf_dir, pages_of)
    read, aside = intake.check_page_count(pages)
    return read.unionByName(pages.join(aside, ["doc_id", "document_type"]))


@query(a.cte(a.submissions) + """
SELECT doc_id, digest FROM (SELECT doc_id, md5(html) AS digest,
  row_number() OVER (PARTITION BY document_type, file_name, md5(html) ORDER BY received_ts, doc_id) AS n FROM submissions) WHERE n = 1""")
def i5_dedupe_submissions(spark, sf_dir):
    found = rows(spark, sf_dir, a.submissions).withColumn("content", F.col("html").cast("binary")).drop("html")
    return intake.dedupe_submissions(found).select("doc_id", "digest")


def token_boxes(q, t) -> str:
    return f"""SELECT event_id AS doc_id, CAST(event_id % 900 AS INT) AS x0, CAST(event_id % 700 AS INT) AS y0, CAST(event_id % 900 + 40 AS INT) AS x1,
      CAST(event_id % 700 + 15 AS INT) AS y1, CASE WHEN event_id % 3 = 0 THEN 2400 ELSE 1700 END AS page_width,
      CASE WHEN event_id % 3 = 0 THEN 1700 ELSE 2400 END AS page_height, 1653 AS width, 2339 AS height FROM {t("events")}"""


@query(a.cte(token_boxes) + """, r AS (SELECT *, (page_width > page_height) <> (width > height) AS turned FROM token_boxes),
s AS (SELECT *, CASE WHEN turned THEN y0 ELSE x0 END AS a0, CASE WHEN turned THEN y1 ELSE x1 END AS a1, CASE WHEN turned THEN page_width - x1 ELSE y0 END AS b0,
  CASE WHEN turned THEN page_width - x0 ELSE y1 END AS b1, CASE WHEN turned THEN page_height ELSE page_width END AS w, CASE WHEN turned THEN page_width ELSE page_height END AS h FROM r)
SELECT doc_id, round_even(a0 * width / w, 0)::INT AS x0, round_even(b0 * height / h, 0)::INT AS y0, round_even(a1 * width / w, 0)::INT AS x1,
  round_even(b1 * height / h, 0)::INT AS y1 FROM s""")
def i6_normalize_page_size(spark, sf_dir):
    return intake.normalize_page_size(rows(spark, sf_dir, token_boxes)).select("doc_id", "x0", "y0", "x1", "y1")


@query(a.cte(pages_of, a.cells) + """, e AS (SELECT doc_id, field, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 3 + 1 AS INT) END AS page FROM cells),
k AS (SELECT *, coalesce(page, 1) AS page_no FROM e)
SELECT k.doc_id, k.field, k.page_no, p.doc_id IS NOT NULL AS there FROM k LEFT JOIN pages_of p ON p.doc_id = k.doc_id AND p.page_no = k.page_no""")
def i7_select_field_page(spark, sf_dir):
    fields = rows(spark, sf_dir, a.cells).select("doc_id", "field", F.expr("CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 3 + 1 AS INT) END").alias("page"))
    there, lost = intake.select_field_page(fields, rows(spark, sf_dir, pages_of).select("doc_id", "page_no"))
    out = lambda d, ok: d.select("doc_id", "field", "page_no", F.lit(ok).alias("there"))
    return out(there, True).unionByName(out(lost, False))


# --- readings, marks, cells


@query(a.cte(a.readings) + f"SELECT event_id, regexp_matches(field, '(_{f.LIMIT}|_{f.SCORE}|_{f.BONUS})$') OR field = '{f.TOTAL}' AS numeric_field FROM readings")
def o5_is_numeric_field(spark, sf_dir):
    return rows(spark, sf_dir, a.readings).select("event_id", v.is_numeric_field(F.col("field")).alias("numeric_field"))


@query(a.cte(a.readings) + f"SELECT event_id, {clean('batch_text')} AS cleaned FROM readings")
def o6_clean_number(spark, sf_dir):
    return rows(spark, sf_dir, a.readings).select("event_id", v.clean_number(F.col("batch_text")).alias("cleaned"))


_PLAUSIBLE = "coalesce({x} <= CASE WHEN field = '" + f.TOTAL + "' THEN 100 ELSE 10 END, false)"


@query(a.cte(a.readings) + f"SELECT event_id, {_PLAUSIBLE.format(x=num('batch_text'))} AS plausible FROM readings")
def o7_plausible_score(spark, sf_dir):
    return rows(spark, sf_dir, a.readings).select("event_id", v.plausible_score(F.col("field"), F.col("batch_text")).alias("plausible"))


@query(a.cte(a.readings) + f""", c AS (SELECT *, {clean('batch_text')} AS x, {clean('single_text')} AS y FROM readings),
d AS (SELECT *, regexp_matches(x, '[0-9]') AS dx, regexp_matches(y, '[0-9]') AS dy, {_PLAUSIBLE.format(x=num('x'))} AS px, {_PLAUSIBLE.format(x=num('y'))} AS py FROM c)
SELECT doc_id, field, CASE WHEN NOT (regexp_matches(field, '(_{f.LIMIT}|_{f.SCORE}|_{f.BONUS})$') OR field = '{f.TOTAL}') THEN batch_text
  WHEN dx AND px THEN x WHEN dy AND (py OR NOT dx) THEN y ELSE x END AS value FROM d""")
def o8_choose_reading(spark, sf_dir):
    return cells.cleaned_readings(rows(spark, sf_dir, a.readings))


@query(a.cte(a.marks) + "SELECT doc_id, field, opt_no, CASE WHEN checked THEN '是' ELSE '否' END AS value FROM marks")
def o9_checkbox_single_value(spark, sf_dir):
    return rows(spark, sf_dir, a.marks).select("doc_id", "field", "opt_no", v.checkbox_value(F.col("checked")).alias("value"))


@query(a.cte(a.marks) + """SELECT doc_id, field,
  coalesce(list(label ORDER BY ratio DESC, opt_no) FILTER (WHERE checked)[1], '') AS value, count(*) FILTER (WHERE checked) AS n_checked,
  coalesce(string_agg(label, '、' ORDER BY opt_no) FILTER (WHERE checked), '') AS labels FROM marks GROUP BY 1, 2""")
def o10_checkbox_group_value(spark, sf_dir):
    return cells.checkbox_group_value(rows(spark, sf_dir, a.marks))


_WIDE = ", ".join(f"max(value) FILTER (WHERE field = '{n}') AS {Q(n)}" for n in f.score_fields())


@query(a.cte(a.cells) + f"SELECT doc_id, {_WIDE} FROM cells GROUP BY doc_id")
def o11_cells_to_record(spark, sf_dir):
    return cells.cells_to_record(rows(spark, sf_dir, a.cells), f.score_fields())


@query(a.cte(a.cells) + """SELECT doc_id, field, CASE WHEN event_id % 5 = 0 THEN concat('c', value) ELSE value END AS value FROM cells
UNION ALL SELECT doc_id, 'added', concat('c', max_by(value, event_id)) FROM cells WHERE event_id % 5 = 0 GROUP BY doc_id""")
def o12_apply_corrections(spark, sf_dir):
    """Corrections of a field's cell, an earlier one of the same field, and ones of a field without a cell."""
    suggested = rows(spark, sf_dir, a.cells)
    fixed = suggested.where("event_id % 5 = 0").select("doc_id", "field", F.concat(F.lit("c"), "value").alias("value"), F.col("event_id").alias("seq"))
    early = fixed.withColumns({"value": F.lit("early"), "seq": F.lit(-1).cast("long")})
    return cells.apply_corrections(suggested, fixed.unionByName(early).unionByName(fixed.withColumn("field", F.lit("added"))))


_FIRST = {n: f"o{k}" for k, n in enumerate(f.score_fields()) if k % 2}


@query(a.cte(a.cells) + f"""SELECT doc_id, field, CASE WHEN event_id % 3 > 0 THEN value
  ELSE CASE field {' '.join(f"WHEN '{n}' THEN '{first}'" for n, first in _FIRST.items())} ELSE '' END END AS value FROM cells""")
def o12_default_options(spark, sf_dir):
    """Groups nobody ticked get their first option, where they have options."""
    held = rows(spark, sf_dir, a.cells).withColumn("value", F.expr("CASE WHEN event_id % 3 > 0 THEN value ELSE '' END"))
    options = spark.createDataFrame([(n, k, first if not k else "later") for n, first in _FIRST.items() for k in (1, 0)], "field string, opt_no int, label string")
    return cells.default_options(held, options)


# --- validation


@query(a.cte(a.eval_units) + f"SELECT seq, {num_comma(Q(f'b1_{f.SCORE}'))} AS number FROM eval_units")
def v1_parse_number(spark, sf_dir):
    return rows(spark, sf_dir, a.eval_units).select("seq", v.parse_number(v.column(f"b1_{f.SCORE}")).alias("number"))


_SUB = " + ".join([f"coalesce({num_comma(Q(f'{i}_{f.SCORE}'))}, 0.0)" for i in f.EVAL_ITEMS] + [f"CASE WHEN ({num_comma(Q(f'{i}_{f.BONUS}'))}) > 10 THEN 10.0 ELSE coalesce({num_comma(Q(f'{i}_{f.BONUS}'))}, 0.0) END" for i in f.BONUS_ITEMS])
_FULL = " + ".join(f"CASE WHEN ({num_comma(Q(f'{i}_{f.SCORE}'))}) IS NOT NULL THEN coalesce({num_comma(Q(f'{i}_{f.LIMIT}'))}, 0.0) ELSE 0.0 END" for i in f.EVAL_ITEMS)


def _bad(name: str, most: str) -> list[str]:
    """Texts of the warnings on one number, null where there is none."""
    text, n = strip(Q(name)), f"({num_comma(Q(name))})"
    return [
        f"CASE WHEN {text} <> '' AND {n} IS NULL THEN concat('not_a_number:{name}:', {text}) END",
        f"CASE WHEN {n} > {most} THEN concat_ws(':', 'over_limit', '{name}', CAST({n} AS VARCHAR), CAST({most} AS VARCHAR)) END",
    ]


_BAD = []
for _i in f.EVAL_ITEMS:
    _score, _over = _bad(f"{_i}_{f.SCORE}", f"({num_comma(Q(f'{_i}_{f.LIMIT}'))})")
    _BAD += [_score, _bad(f"{_i}_{f.LIMIT}", "NULL")[0], _over]
for _i in f.BONUS_ITEMS:
    _BAD += _bad(f"{_i}_{f.BONUS}", "10.0::DOUBLE")


@query(a.cte(a.eval_units) + f""", c AS (SELECT *, ({_SUB})::DOUBLE AS subtotal, ({_FULL})::DOUBLE AS full_score, {num_comma(Q(f.TOTAL))} AS written FROM eval_units)
SELECT seq, subtotal, full_score, concat_ws(',', {', '.join(_BAD)},
  CASE WHEN abs(written - subtotal) > 0.01 THEN concat_ws(':', 'total_differs', '{f.TOTAL}', CAST(written AS VARCHAR), CAST(subtotal AS VARCHAR)) END) AS warnings FROM c""")
def v2_check_eval_record(spark, sf_dir):
    checked = validation.check_eval_record(rows(spark, sf_dir, a.eval_units))
    text = F.transform("warnings", lambda w: F.concat_ws(":", w["code"], w["field"], w["value"], w["limit"].cast("string")))
    return checked.select("seq", "subtotal", "full_score", F.array_join(text, ",").alias("warnings"))


@query(a.cte(a.supplier_rows) + f"""SELECT seq, {Q(f.COMPANY)} AS company_name_zh, {Q(f.TAX_ID)} AS tax_id, {Q('聯絡人')} AS contact_person, '' AS bank_name,
  {Q('附件1_設立證明文件')} AS first_attachment, 2 AS n_attachments FROM supplier_rows""")
def v3_build_supplier(spark, sf_dir):
    made = validation.build_supplier(rows(spark, sf_dir, a.supplier_rows), ("seq",))
    first = F.element_at("attachments", "附件1_設立證明文件").alias("first_attachment")
    return made.select("seq", "company_name_zh", "tax_id", "contact_person", "bank_name", first, F.size("attachments").alias("n_attachments"))


_TAX = f"translate({Q(f.TAX_ID)}, '{v.SPACE}', '')"


@query(a.cte(a.supplier_rows) + f"""SELECT seq, concat_ws(',', CASE WHEN {strip(Q(f.COMPANY))} = '' THEN 'blank:{f.COMPANY}' END,
  CASE WHEN {strip(Q('聯絡人'))} = '' THEN 'blank:聯絡人' END,
  CASE WHEN regexp_matches({_TAX}, '^[0-9{v.WIDE_DIGITS}]+$') AND length({_TAX}) <> 8 THEN 'tax_id_length:{f.TAX_ID}' END) AS warnings FROM supplier_rows""")
def v4_supplier_warnings(spark, sf_dir):
    found = validation.supplier_warnings(rows(spark, sf_dir, a.supplier_rows), (f.COMPANY, "聯絡人"))
    return found.select("seq", F.array_join(F.transform("warnings", lambda w: F.concat_ws(":", w["code"], w["field"])), ",").alias("warnings"))


@query(a.cte(a.eval_units) + f"""SELECT seq, {Q(f.SUPPLIER)} AS supplier_name, {Q(f'a1_{f.SCORE}')} AS a1, {Q(f'd3_{f.LIMIT}')} AS d3_max, {Q(f'e2_{f.BONUS}')} AS e2,
  {Q(f.TOTAL)} AS total_score_written, CAST({_SUB} AS DOUBLE) AS unit_subtotal FROM eval_units""")
def v5_build_evaluation(spark, sf_dir):
    made = validation.build_evaluation(rows(spark, sf_dir, a.eval_units), ("seq",))
    return made.select(
        "seq", "supplier_name", F.col("items")["a1"]["score"].alias("a1"), F.col("items")["d3"]["max_score"].alias("d3_max"),
        F.col("bonus")["e2"]["bonus"].alias("e2"), "total_score_written", "unit_subtotal",
    )


@query(f"SELECT o_orderkey, 'form.pdf' AS {Q(f.SOURCE_FILE)}, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS {Q(f.PROCESSED)} FROM orders")
def v6_stamp_audit(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    return validation.stamp_audit(orders, F.lit("form.pdf"), F.col("o_orderdate")).drop("o_orderdate")


_SAFE = r"""regexp_replace({x}, '[\\/:*?"<>|]', '', 'g')"""
_ID, _CO = strip(Q(f.TAX_ID)), strip(Q(f.COMPANY))


@query(a.cte(a.supplier_rows) + f"""SELECT seq, CASE WHEN {_ID} <> '' AND {_CO} <> '' THEN concat({_ID}, '_', {_CO})
  ELSE {_SAFE.format(x=f"CASE WHEN {_ID} <> '' THEN {_ID} WHEN {_CO} <> '' THEN {_CO} ELSE '{f.UNNAMED}' END")} END AS record_key FROM supplier_rows""")
def v7_supplier_record_key(spark, sf_dir):
    return rows(spark, sf_dir, a.supplier_rows).select("seq", v.supplier_record_key(v.column(f.TAX_ID), v.column(f.COMPANY)).alias("record_key"))


_KEY = f"CASE WHEN {_SAFE.format(x=strip(Q(f.SUPPLIER)))} = '' THEN '{f.UNNAMED}' ELSE {_SAFE.format(x=strip(Q(f.SUPPLIER)))} END"


@query(a.cte(a.big_units) + f"SELECT seq, {_KEY} AS record_key FROM big_units")
def v8_eval_record_key(spark, sf_dir):
    return rows(spark, sf_dir, a.big_units).select("seq", v.eval_record_key(v.column(f.SUPPLIER)).alias("record_key"))


# --- scores


def keyed_units(spark: SparkSession, sf_dir: str, adapter=a.eval_units) -> DataFrame:
    return rows(spark, sf_dir, adapter).withColumn("record_key", v.eval_record_key(v.column(f.SUPPLIER)))


_UNIT = f"NOT coalesce(starts_with({Q(f.UNIT)}, '{f.ROLLUP_PREFIX}'), false)"
_MEANS = ", ".join([f"avg({num(Q(f'{i}_{f.SCORE}'))}) AS {i}_mean" for i in f.EVAL_ITEMS] + [f"CASE WHEN avg({num(Q(f'{i}_{f.BONUS}'))}) > 10 THEN 10.0 ELSE avg({num(Q(f'{i}_{f.BONUS}'))}) END AS {i}_mean" for i in f.BONUS_ITEMS])
_TOTAL = "0.0::DOUBLE + " + " + ".join(f"coalesce({i}_mean, 0.0)" for i in (*f.EVAL_ITEMS, *f.BONUS_ITEMS))


def _scored(adapter) -> str:
    n = adapter.__name__
    return a.cte(adapter) + f""", u AS (SELECT *, {_KEY} AS record_key FROM {n} WHERE {_UNIT}),
m AS (SELECT record_key, count(*) AS n_rows, {_MEANS} FROM u GROUP BY record_key)"""


@query(a.cte(a.eval_units) + f"SELECT seq, {Q(f.UNIT)} AS unit FROM eval_units WHERE {_UNIT}")
def a3_unit_rows(spark, sf_dir):
    return scoring.unit_rows(rows(spark, sf_dir, a.eval_units)).select("seq", v.column(f.UNIT).alias("unit"))


@query(_scored(a.eval_units) + " SELECT record_key, n_rows FROM m WHERE n_rows >= 2")
def a4_min_units_gate(spark, sf_dir):
    counted = scoring.unit_rows(keyed_units(spark, sf_dir)).groupBy("record_key").agg(F.count(F.lit(1)).alias("n_rows"))
    return scoring.min_units_gate(counted)


@query(_scored(a.big_units) + " SELECT record_key, n_rows, " + ", ".join(f"round({i}_mean, 9) AS {i}_mean" for i in f.EVAL_ITEMS) + " FROM m")
def a5_item_means(spark, sf_dir):
    means = scoring.item_means(scoring.unit_rows(keyed_units(spark, sf_dir, a.big_units)), "record_key")
    return means.select("record_key", "n_rows", *[F.round(f"{i}_mean", 9).alias(f"{i}_mean") for i in f.EVAL_ITEMS])


@query(_scored(a.big_units) + " SELECT record_key, round(e1_mean, 9) AS e1_mean, round(e2_mean, 9) AS e2_mean FROM m")
def a6_bonus_means(spark, sf_dir):
    means = scoring.item_means(scoring.unit_rows(keyed_units(spark, sf_dir, a.big_units)), "record_key")
    return means.select("record_key", F.round("e1_mean", 9).alias("e1_mean"), F.round("e2_mean", 9).alias("e2_mean"))


@query(_scored(a.eval_units) + f""", t AS (SELECT record_key, n_rows, {_TOTAL} AS total FROM m WHERE n_rows >= 2)
SELECT record_key, n_rows, round(total, 9) AS total, round_even(total, 1) AS total_shown, CASE WHEN total >= 90 THEN 'A' WHEN total >= 70 THEN 'B' ELSE 'C' END AS grade FROM t""")
def a7_total_and_grade(spark, sf_dir):
    means = scoring.item_means(scoring.unit_rows(keyed_units(spark, sf_dir)), "record_key")
    graded = scoring.total_and_grade(scoring.min_units_gate(means))
    return graded.select("record_key", "n_rows", F.round("total", 9).alias("total"), "total_shown", "grade")


_HEADER = f"""arg_min({Q(f.SUPPLIER)}, seq) AS supplier, arg_min({Q(f.CATEGORY)}, seq) AS category,
  concat('{f.ROLLUP_PREFIX}', coalesce(array_to_string(list_sort(list(DISTINCT {Q(f.UNIT)}) FILTER (WHERE {Q(f.UNIT)} <> '')), '、'), ''), ')') AS units,
  coalesce(string_agg({Q(f.PERSON)}, '、' ORDER BY seq) FILTER (WHERE {Q(f.PERSON)} <> ''), '') AS people, max({Q(f.DATE)}) AS latest"""
_NAMES = {f.SUPPLIER: "supplier", f.CATEGORY: "category", f.UNIT: "units", f.PERSON: "people", f.DATE: "latest"}


@query(_scored(a.big_units) + f" SELECT record_key, {_HEADER} FROM u GROUP BY record_key")
def a8_rollup_header(spark, sf_dir):
    units = scoring.unit_rows(keyed_units(spark, sf_dir, a.big_units))
    return units.groupBy("record_key").agg(*scoring.rollup_header()).withColumnsRenamed(_NAMES)


# --- ledgers

_LEDGER = (f.SOURCE_FILE, f.PROCESSED, f.TAX_ID, f.COMPANY, "服務範疇", "聯絡人")
_LEDGER_SQL = ", ".join(Q(c) for c in _LEDGER)


@query(a.cte(a.supplier_rows) + f""", k AS (SELECT *, max(seq) OVER (PARTITION BY {Q(f.TAX_ID)}) AS last, min(seq) OVER (PARTITION BY {Q(f.TAX_ID)}) AS first FROM supplier_rows)
SELECT CASE WHEN {Q(f.TAX_ID)} = '' THEN seq ELSE first END AS seq, {_LEDGER_SQL} FROM k WHERE {Q(f.TAX_ID)} = '' OR seq = last""")
def a1_upsert_summary(spark, sf_dir):
    all_rows = rows(spark, sf_dir, a.supplier_rows)
    old = all_rows.where("seq % 2 = 0").select("seq", *[v.column(c) for c in _LEDGER])
    # Batch rows come after the ledger: here a row's own number decides, whichever side it stands on.
    return ledger.upsert_summary(old, all_rows.where("seq % 2 = 1"))


@query(a.cte(a.supplier_rows) + f"SELECT seq, {Q(f.TAX_ID)}, '' AS {Q('分行別')}, {Q('聯絡人')} FROM supplier_rows")
def a2_align_to_header(spark, sf_dir):
    return ledger.align_to_header(rows(spark, sf_dir, a.supplier_rows), (f.TAX_ID, "分行別", "聯絡人"), keep=("seq",))


def _ledger_and_rollups(spark, sf_dir):
    units = keyed_units(spark, sf_dir)
    columns = [c for c in units.columns if c not in ("seq", "record_key")]
    made = scoring.as_rollup_rows(scoring.rollups(units), columns)
    last = F.conv(F.substring(F.md5("record_key"), 1, 8), 16, 10).cast("long") + 1_000_000_000
    return units.drop("record_key"), made.withColumn("seq", last).drop("record_key")


_ROLLED = _scored(a.eval_units) + f""", h AS (SELECT record_key, {_HEADER} FROM u GROUP BY record_key),
r AS (SELECT h.*, {_TOTAL} AS total FROM h JOIN m ON h.record_key = m.record_key WHERE n_rows >= 2),
o AS (SELECT {Q(f.SUPPLIER)} AS supplier, min(seq) AS place FROM eval_units WHERE starts_with({Q(f.UNIT)}, '{f.ROLLUP_PREFIX}') GROUP BY 1),
n AS (SELECT coalesce(place, ('0x' || substr(md5(record_key), 1, 8))::BIGINT + 1000000000) AS seq, r.supplier, units, CAST(round_even(total, 1) AS VARCHAR) AS total FROM r LEFT JOIN o ON o.supplier = r.supplier)"""


@query(_ROLLED + f""" SELECT seq, {Q(f.SUPPLIER)} AS supplier, {Q(f.UNIT)} AS units, {Q(f.TOTAL)} AS total FROM eval_units WHERE seq NOT IN (SELECT seq FROM n)
UNION ALL SELECT seq, supplier, units, total FROM n""")
def a9_upsert_rollup(spark, sf_dir):
    existing, made = _ledger_and_rollups(spark, sf_dir)
    out = ledger.upsert_rollup(existing, made)
    return out.select("seq", v.column(f.SUPPLIER).alias("supplier"), v.column(f.UNIT).alias("units"), v.column(f.TOTAL).alias("total"))


@query(_ROLLED + f""" SELECT {Q(f.SUPPLIER)} AS supplier, {Q(f.UNIT)} AS units, {Q(f.TOTAL)} AS total FROM eval_units WHERE {_UNIT}
UNION ALL SELECT supplier, units, total FROM n""")
def a10_eval_summary_table(spark, sf_dir):
    existing, made = _ledger_and_rollups(spark, sf_dir)
    out = ledger.eval_summary_table(scoring.unit_rows(existing), made)
    return out.select(v.column(f.SUPPLIER).alias("supplier"), v.column(f.UNIT).alias("units"), v.column(f.TOTAL).alias("total"))
