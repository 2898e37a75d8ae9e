"""Golden cases, worked out by hand."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from formledger.functions import fields as f
from formledger.functions import values as v
from formledger.operators import cells, ledger, scoring, tokens, validation


def one(spark, column, **cells_):
    schema = ", ".join(f"`{k}` string" for k in cells_)
    return spark.createDataFrame([tuple(cells_.values())], schema).select(column.alias("x")).first()["x"]


def test_clean_number(spark):
    for text, wanted in (("O", "0"), ("l0", "10"), ("７", "7"), ("q", "9"), (".5.", "5"), ("—", "—"), ("Z$", "28"), ("", "")):
        assert one(spark, v.clean_number(F.col("t")), t=text) == wanted


def test_numbers_and_commas(spark):
    assert one(spark, v.parse_number(F.col("t")), t="1,000") == 1000.0
    assert one(spark, v.to_number(F.col("t")), t="1,000") is None
    for text in ("nan", "inf", "1.0d", "1_0", "", " ", None):
        assert one(spark, v.parse_number(F.col("t")), t=text) is None
    assert one(spark, v.parse_number(F.col("t")), t=" -2.5e1 ") == -25.0


def test_choose_reading(spark):
    name = f"a1_{f.SCORE}"
    pick = v.choose_reading(F.col("n"), F.col("a"), F.col("b"))
    assert one(spark, pick, n=name, a="1100", b="10") == "10"
    assert one(spark, pick, n=name, a="7", b="9") == "7"
    assert one(spark, pick, n=name, a="x", b="99") == "99"
    assert one(spark, pick, n=name, a="1100", b="99") == "1100"
    assert one(spark, pick, n=f.TOTAL, a="88", b="9") == "88"


def test_keys(spark):
    key = v.supplier_record_key(F.col("i"), F.col("c"))
    assert one(spark, key, i="12", c="A/B") == "12_A/B"
    assert one(spark, key, i="", c="A/B") == "AB"
    assert one(spark, key, i=None, c=" ") == f.UNNAMED
    assert one(spark, v.eval_record_key(F.col("c")), c="A/B") == one(spark, v.eval_record_key(F.col("c")), c="AB")


def unit(seq, name, unit_, score="", **more):
    row = {"seq": seq, f.SUPPLIER: name, f.CATEGORY: "k", f.UNIT: unit_, f.PERSON: f"p{seq}", f.DATE: "2024-01-01", f.TOTAL: ""}
    row |= {f"{i}_{f.SCORE}": score for i in f.EVAL_ITEMS} | {f"{i}_{f.LIMIT}": "10" for i in f.EVAL_ITEMS}
    return row | {f"{i}_{f.BONUS}": "" for i in f.BONUS_ITEMS} | more


def frame(spark, rows):
    names = list(rows[0])
    schema = ", ".join(f"`{n}` {'long' if n == 'seq' else 'string'}" for n in names)
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def rolled(spark, rows):
    made = scoring.rollups(frame(spark, rows).withColumn("record_key", v.eval_record_key(v.column(f.SUPPLIER))))
    return {r["record_key"]: r.asDict() for r in made.collect()}


def test_units_gate_and_update(spark):
    first = [unit(1, "A", "U1", "8")]
    assert rolled(spark, first) == {}
    two = [*first, unit(2, "A", "U2", "10"), unit(3, "B", "U1", "5"), unit(4, "A", f"{f.ROLLUP_PREFIX}x)", "1")]
    assert rolled(spark, two)["A"]["total"] == 90.0 and rolled(spark, two)["A"]["grade"] == "A"
    assert rolled(spark, two)["A"][f.UNIT] == "彙總(U1、U2)" and rolled(spark, two)["A"][f.PERSON] == "p1、p2"
    three = [*two, unit(5, "A", "U1", "3")]
    assert list(rolled(spark, three)) == ["A"] and rolled(spark, three)["A"]["n_rows"] == 3


def test_grade_by_unrounded_total(spark):
    scores = {f"a1_{f.SCORE}": "9.96"} | {f"{i}_{f.SCORE}": "10" for i in f.EVAL_ITEMS[1:9]} | {f"d3_{f.SCORE}": "0"}
    made = rolled(spark, [unit(1, "A", "U1", "", **scores), unit(2, "A", "U2", "", **scores)])["A"]
    assert round(made["total"], 6) == 89.96 and made["total_shown"] == 90.0 and made["grade"] == "B"


def beside_a_tie(*sums):
    """Five unit rows of A: the means, of five rows each and of four for the last item, add up to one bit beside a tie."""
    of = lambda k: {f"{i}_{f.SCORE}": str(n) if k == 0 else "0" for i, n in zip(f.EVAL_ITEMS, sums, strict=True)}
    return [unit(k, "A", f"U{k}", **of(k) | ({f"{f.EVAL_ITEMS[-1]}_{f.SCORE}": ""} if k == 4 else {})) for k in range(5)]


LOW_TIE, HIGH_TIE = (30, 24, 32, 32, 35, 27, 39, 12, 30, 27), (35, 37, 19, 37, 18, 34, 20, 26, 18, 21)


def test_summary_table_shows_totals_as_sql_rounds_them(spark):
    for sums, shown in ((LOW_TIE, "59.0"), (HIGH_TIE, "54.0")):
        units = frame(spark, beside_a_tie(*sums))
        made = scoring.rollups(units.withColumn("record_key", v.eval_record_key(v.column(f.SUPPLIER))))
        table = ledger.eval_summary_table(units, scoring.as_rollup_rows(made, units.columns[1:]).withColumn("seq", F.lit(9)))
        assert [r[f.TOTAL] for r in table.collect() if r[f.UNIT].startswith(f.ROLLUP_PREFIX)] == [shown]


def test_total_and_grade_as_sql_rounds(spark):
    rng = np.random.default_rng(5)
    ties = rng.integers(0, 2400, 3000) / 20
    totals = [*ties, *np.nextafter(ties, 200), *np.nextafter(ties, -1), *-ties, *(rng.integers(0, 60, (3000, 8)) / rng.integers(1, 9, 8)).sum(1), 0.0, 1e22, 1.7e308]
    rows = spark.createDataFrame([(k, float(x)) for k, x in enumerate(totals)], "k long, a1_mean double")
    none = {f"{i}_mean": F.lit(None).cast("double") for i in (*f.EVAL_ITEMS, *f.BONUS_ITEMS) if i != "a1"}
    shown = dict(scoring.total_and_grade(rows.withColumns(none)).select("k", "total_shown").collect())
    ours = [float(shown[k]) for k in range(len(totals))]
    con = duckdb.connect()
    theirs = [con.execute("SELECT round_even(?::DOUBLE, 1)", [float(x)]).fetchone()[0] for x in totals]
    assert ours == theirs
    assert [r["total_shown"] for r in scoring.rollups(frame(spark, beside_a_tie(*LOW_TIE)).withColumn("record_key", F.lit("A"))).collect()] == [59.0]


def test_roll_up_in_its_place_shows_the_total_as_sql_rounds_it(spark):
    old = unit(7, "A", f"{f.ROLLUP_PREFIX}old)", **{f.TOTAL: "1.0"})
    existing = frame(spark, [*beside_a_tie(*LOW_TIE), old])
    made = scoring.as_rollup_rows(scoring.rollups(existing.withColumn("record_key", F.lit("A"))), existing.columns[1:]).withColumn("seq", F.lit(99).cast("long"))
    out = ledger.upsert_rollup(existing, made).collect()
    assert sorted(r["seq"] for r in out) == [0, 1, 2, 3, 4, 7]
    assert [r[f.TOTAL] for r in out if r["seq"] == 7] == ["59.0"]


def test_bonus_caps(spark):
    rows = [unit(1, "A", "U1", "", **{f"e1_{f.BONUS}": "15", f"e2_{f.BONUS}": "3"}), unit(2, "A", "U2", "", **{f"e1_{f.BONUS}": "3"})]
    checked = validation.check_eval_record(frame(spark, rows)).orderBy("seq").collect()
    assert checked[0]["subtotal"] == 13.0 and [w["code"] for w in checked[0]["warnings"]] == ["over_limit"]
    assert rolled(spark, rows)["A"]["e1_mean"] == 9.0


def test_score_with_comma_and_blank_limit(spark):
    rows = [unit(1, "A", "U1", "", **{f"a1_{f.SCORE}": "1,0", f"a1_{f.LIMIT}": ""})]
    checked = validation.check_eval_record(frame(spark, rows)).first()
    assert checked["subtotal"] == 10.0 and checked["full_score"] == 0.0 and checked["warnings"] == []


def test_tax_id(spark):
    rows = spark.createDataFrame([(1, "1234567"), (2, "1234 5678"), (3, "A123"), (4, None)], f"seq int, `{f.TAX_ID}` string")
    found = {r["seq"]: len(r["warnings"]) for r in validation.supplier_warnings(rows, ()).collect()}
    assert found == {1: 1, 2: 0, 3: 0, 4: 0}


def test_upsert_keeps_place_and_blank_keys(spark):
    cells_ = f"seq long, `{f.TAX_ID}` string, name string"
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "", "z")], cells_)
    batch = spark.createDataFrame([(4, "a", "new", 1), (5, "", "w", 1), (6, "c", None, 1), (7, "a", "newest", 1)], cells_ + ", extra int")
    once = ledger.upsert_summary(old, batch)
    wanted = [(1, "a", "newest"), (2, "b", "y"), (3, "", "z"), (5, "", "w"), (6, "c", "")]
    assert sorted(tuple(r) for r in once.collect()) == wanted
    keyed = batch.where(f"`{f.TAX_ID}` <> ''")
    assert sorted(tuple(r) for r in ledger.upsert_summary(once, keyed).collect()) == wanted


def test_two_marks(spark):
    marks = spark.createDataFrame([(1, "g", 0, "x", True, 0.1), (1, "g", 1, "y", True, 0.3), (1, "h", 0, "x", False, 0.9)], "doc_id long, field string, opt_no int, label string, checked boolean, ratio double")
    found = {r["field"]: (r["value"], r["n_checked"], r["labels"]) for r in cells.checkbox_group_value(marks).collect()}
    assert found == {"g": ("y", 2, "x、y"), "h": ("", 0, "")}


def test_symbols_read_twice(spark):
    cells_ = "sheet_id long, slot long, text string, x0 int, y0 int, x1 int, y1 int"
    symbols = spark.createDataFrame([(1, 0, "6", 0, 0, 10, 10), (1, 0, "6", 1, 1, 11, 11), (1, 1, "1", 0, 0, 5, 10), (1, 1, "0", 3, 0, 8, 10)], cells_)
    slots = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "sheet_id long, slot long")
    assert {r["slot"]: r["value"] for r in tokens.dedupe_symbols(symbols, slots).collect()} == {0: "6", 1: "10", 2: ""}


def test_empty_tables(spark):
    rows = frame(spark, [unit(1, "A", "U1")]).limit(0)
    assert validation.check_eval_record(rows).count() == 0
    assert scoring.rollups(rows.withColumn("record_key", F.lit("x"))).count() == 0


WIDE, HARD = "\u3000", "\u00a0"  # the ideographic and the no-break space


def test_all_white_space_counts(spark):
    assert one(spark, v.stripped(F.col("t")), t=f"{WIDE} a{WIDE}b {HARD}\x1f") == f"a{WIDE}b"
    assert one(spark, v.to_number(F.col("t")), t=f"{WIDE}７.5{HARD}") == 7.5
    assert one(spark, v.parse_number(F.col("t")), t=f"{HARD}1,０００") == 1000.0
    assert one(spark, v.supplier_record_key(F.col("i"), F.col("c")), i=f"{WIDE}12", c=HARD) == "12"
    assert one(spark, v.eval_record_key(F.col("c")), c=f"{WIDE}A{HARD}") == "A"
    assert one(spark, v.eval_record_key(F.col("c")), c=WIDE) == f.UNNAMED
    rows = spark.createDataFrame([(1, f"1234{WIDE}567", WIDE), (2, f"{HARD}12345678", "x"), (3, "１２３", "x")], f"seq int, `{f.TAX_ID}` string, name string")
    found = {r["seq"]: [w["code"] for w in r["warnings"]] for r in validation.supplier_warnings(rows, ("name",)).collect()}
    assert found == {1: ["blank", "tax_id_length"], 2: [], 3: ["tax_id_length"]}
    two = [unit(1, "A", "U1", f"{WIDE}8"), unit(2, f"A{WIDE}", "U2", "10")]
    assert rolled(spark, two)["A"]["total"] == 90.0
    assert validation.check_eval_record(frame(spark, two[:1])).first()["subtotal"] == 80.0


def test_absent_columns_are_blank(spark):
    rows = spark.createDataFrame([(1, "7", "x")], f"seq int, `a1_{f.SCORE}` string, `e1_{f.BONUS}` string")
    checked = validation.check_eval_record(rows).first()
    assert (checked["subtotal"], checked["full_score"]) == (7.0, 0.0)
    assert [(w["code"], w["field"], w["value"]) for w in checked["warnings"]] == [("not_a_number", f"e1_{f.BONUS}", "x")]
    assert checked.asDict().keys() == {"seq", f"a1_{f.SCORE}", f"e1_{f.BONUS}", "subtotal", "full_score", "warnings"}
    made = validation.build_evaluation(rows, ("seq",)).first()
    assert made["supplier_name"] == "" and made["items"]["a1"]["score"] == "7" and made["unit_subtotal"] == 7.0
    assert validation.build_supplier(rows, ("seq",)).first()["tax_id"] == ""
    assert len(validation.supplier_warnings(rows, ("none",)).first()["warnings"]) == 1


def test_warnings_in_order(spark):
    cells_ = {f"a1_{f.SCORE}": "12", f"a2_{f.LIMIT}": "x", f"a3_{f.SCORE}": "9", f"e2_{f.BONUS}": "11", f.TOTAL: "50"}
    found = validation.check_eval_record(frame(spark, [unit(1, "A", "U1", "", **cells_)])).first()
    assert [(w["code"], w["field"], w["value"], w["limit"]) for w in found["warnings"]] == [
        ("over_limit", f"a1_{f.SCORE}", "12.0", 10.0), ("not_a_number", f"a2_{f.LIMIT}", "x", None), ("over_limit", f"e2_{f.BONUS}", "11.0", 10.0),
        ("total_differs", f.TOTAL, "50.0", 22.0),
    ]


def test_corrections(spark):
    held = spark.createDataFrame([(1, "x", "old"), (1, "y", "kept")], "doc_id long, field string, value string")
    fixed = spark.createDataFrame([(1, "x", "second", 2), (1, "x", "first", 1), (1, "z", "added", 1), (2, "x", "", 1)], "doc_id long, field string, value string, seq int")
    got = sorted(tuple(r) for r in cells.apply_corrections(held, fixed).collect())
    assert got == [(1, "x", "second"), (1, "y", "kept"), (1, "z", "added"), (2, "x", "")]


def test_default_options(spark):
    held = spark.createDataFrame([(1, "g", ""), (2, "g", "b"), (3, "h", "")], "doc_id long, field string, value string")
    options = spark.createDataFrame([("g", 1, "b"), ("g", 0, "a")], "field string, opt_no int, label string")
    assert sorted(tuple(r) for r in cells.default_options(held, options).collect()) == [(1, "g", "a"), (2, "g", "b"), (3, "h", "")]
