"""Files: images through Spark's own reader, and a stream whose batch is replayed."""

import hashlib
import shutil
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from formledger.functions import fields as f
from formledger.operators import ink, keyed, ledger, scoring
from formledger.plans import flows
from formledger.sources import intermediate, submissions, templates
from formledger.streaming import incremental
from tests.oracle import SMALL
from tests.test_records import frame, unit


def png(a):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in a)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_files_to_runs(spark, tmp_path):
    a = np.full((20, 30), 255, np.uint8)
    a[7, 3:25] = 0
    (tmp_path / "p.png").write_bytes(png(a))
    pages = submissions.read_pages(spark, str(tmp_path)).selectExpr("1L AS doc_id", "1 AS page_no", "height", "width", "nChannels", "data")
    assert [tuple(r)[2:] for r in ink.ink_runs(pages, least=10).collect()] == [("h", 7, 3, 25)]
    assert submissions.read_submissions(spark, str(tmp_path)).first()["file_name"] == "p.png"


@pytest.mark.parametrize("rows", [[], [(7, "b"), (7, "b"), (8, None), (9, ""), (10, "é\n\nx"), (107, "b"), (-3, "y"), (None, "z"), (None, None)]])
def test_each_page_is_a_submission(spark, tmp_path, rows):
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in flows.s3_read_submissions(spark, str(tmp_path)).select("page_id", "size_bytes", "digest").collect()]
    files = [(i, ((h or "") + "\n").encode()) for i, h in rows]
    assert sorted(got, key=repr) == sorted([(i, len(x), hashlib.md5(x).hexdigest()) for i, x in files], key=repr)


def test_pages_are_written_alone_and_again_without_harm(spark, tmp_path):
    rows = spark.createDataFrame([(0, 7, "b"), (0, 7, "b"), (1, 7, "b"), (1, None, None), (0, -3, "é\ny")], "bucket int, page_id long, value string")
    for _ in range(2):  # as a task that is run again
        submissions.write_texts(rows, str(tmp_path / "files"), ("bucket", "page_id"))
    found = sorted((str(p.relative_to(tmp_path / "files").parent), p.read_bytes()) for p in (tmp_path / "files").rglob("*") if p.is_file())
    assert found == sorted([
        ("bucket=0/page_id=7", b"b\n"), ("bucket=0/page_id=7", b"b\n"), ("bucket=1/page_id=7", b"b\n"), ("bucket=1/page_id=__HIVE_DEFAULT_PARTITION__", b"\n"), ("bucket=0/page_id=-3", "é\ny\n".encode()),
    ])
    flows.s3_read_submissions(spark, SMALL)
    newest = max(Path(intermediate.shared_folder(spark).removeprefix("file:")).glob("flow-*"), key=lambda p: p.stat().st_mtime)
    names = [p.name for p in newest.rglob("*") if p.is_file()]
    assert len(names) == spark.read.parquet(f"{SMALL}/pages.parquet").count() and not any(n.endswith(".crc") for n in names)


def test_template_files(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"form_name": "x", "zones": {"z": {"type": "rows", "row_boundaries": [5, 9, 14], "row_search_radii": [30, [1, 2]]}}, "fields": [{"name": "n", "type": "text", "box": [1, 2, 3, 4]}]}')
    made = templates.load_templates(spark, str(tmp_path))
    field = templates.template_fields(made).first()
    assert (field["name"], field["page"], field["required"]) == ("n", 1, True)
    assert [(r["template_y"], r["radius_back"], r["radius_fwd"]) for r in templates.template_lines(made).orderBy("line_no").collect()] == [(5, 40, 40), (9, 30, 30), (14, 1, 2)]


def schema_of(data):
    return ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in data.schema)


def ingested(spark, tmp_path, data, checkpoint):
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    where = [str(tmp_path / x) for x in ("history", "partials", "rollups")]
    incremental.ingest_stream(stream, *where, schema_of(data), str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
    return incremental.rollup_table(spark, where[2])


def test_replayed_stream_changes_nothing(spark, tmp_path):
    rows = [unit(1, "A", "U1", "8"), unit(2, "A", "U2", "10"), unit(3, "B", "U1", "5")]
    data = frame(spark, rows)
    data.coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(checkpoint):
        return [(r["record_key"], r["n_rows"], r["total"]) for r in ingested(spark, tmp_path, data, checkpoint).read().collect()]

    assert run("c1") == [("A", 2, 90.0)]
    assert run("c2") == [("A", 2, 90.0)]  # the same batch number again
    assert ledger.read_history(spark, str(tmp_path / "history"), schema_of(data)).count() == 3
    assert f.UNIT in data.columns


def test_stream_of_many_batches_gives_the_roll_ups_of_a_batch_job(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed.KeyedTable, "fold", lambda self, fan=3, plain=keyed.KeyedTable.fold: plain(self, fan))
    monkeypatch.setattr(keyed, "compact", lambda *a, plain=keyed.compact: plain(*a, fan=3))
    rows = [unit(i, "ABC"[i * i % 3], f"U{i % 4}", str(i % 11), **{f"b1_{f.SCORE}": "" if i % 2 else "7.3"}) for i in range(1, 19)]
    data = frame(spark, rows)
    for i in range(0, 18, 3):
        frame(spark, rows[i : i + 3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {r["record_key"]: r.asDict() for r in ingested(spark, tmp_path, data, "c").read().collect()}
    plain = scoring.rollups(data.withColumn("record_key", F.col(f"`{f.SUPPLIER}`")))
    want = {r["record_key"]: r.asDict() for r in plain.collect()}
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert {c: round(x, 9) if isinstance(x, float) else x for c, x in row.items()} == {c: round(got[key][c], 9) if isinstance(got[key][c], float) else got[key][c] for c in row}
    assert len(keyed.live_batches(spark, str(tmp_path / "history"))) < 6


# --- tables that grow by batches


def _batch_names(path, kind):
    return sorted(x.name for x in path.iterdir() if x.name.startswith(f"{kind}="))


def test_compaction_keeps_files_few_and_survives_breaks(spark, tmp_path):
    path, schema = str(tmp_path / "h"), "seq long, record_key string"
    rows = lambda n: spark.createDataFrame([(10 * n + i, f"k{i}") for i in range(3)], schema).coalesce(1)
    read = lambda: sorted(r["seq"] for r in ledger.read_history(spark, path, schema).collect())
    for n in range(30):
        ledger.append_history(rows(n), path, f"{n:03}", buckets=2)
        keyed.compact(spark, path, schema, buckets=2, fan=4)
    assert read() == [10 * n + i for n in range(30) for i in range(3)]
    assert len(keyed.live_batches(spark, path)) < 14  # fewer than fan of each size, and the newest
    some = ledger.read_history(spark, path, schema, spark.createDataFrame([("k1",)], "record_key string"))
    assert sorted(r["seq"] for r in some.collect()) == [10 * n + 1 for n in range(30)]
    whole = read()
    # A break in mid-merge: a span without its _SUCCESS. A break after the merge: the batches it took up are still there.
    live = [x for x in keyed.live_batches(spark, path) if "~" not in x]
    assert len(live) >= 2
    name = f"{live[0]}~{live[-1]}"
    broken = tmp_path / "h" / f"batch={name}"
    shutil.copytree(tmp_path / "h" / f"batch={live[0]}", broken)
    (broken / "_SUCCESS").unlink()
    assert read() == whole
    taken = spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/batch={x}" for x in live]).select("seq", "record_key")
    keyed._written(taken, str(broken), 2, F.col("record_key"))
    assert read() == whole and (tmp_path / "h" / f"batch={live[0]}").exists()
    keyed.compact(spark, path, schema, buckets=2, fan=99)  # clears what is left over
    assert read() == whole and not (tmp_path / "h" / f"batch={live[0]}").exists()
    with pytest.raises(ValueError):
        ledger.append_history(rows(0), path, "000", buckets=2)
    with pytest.raises(ValueError):
        ledger.append_history(rows(0), path, "000~001", buckets=2)


def test_small_batches_rewrite_few_buckets(spark, tmp_path):
    schema = f"seq long, `{f.TAX_ID}` string, name string"
    table = ledger.summary_table(spark, str(tmp_path / "s"), schema, buckets=32)
    made = [(i, f"t{i % 150}" if i % 9 else "", f"n{i}") for i in range(400)]
    rows = lambda part: spark.createDataFrame(part, schema).coalesce(2)
    table.add(rows(made[:300]), "000")
    assert table.fold(fan=1) == []  # the newest batch may come again
    table.add(rows(made[300:310]), "001")
    assert len(table.fold(fan=1)) == 32
    table.add(rows(made[310:320]), "002")
    touched = table.fold(fan=1)
    assert 0 < len(touched) <= 10
    table.add(rows(made[320:]), "003")
    table.add(rows(made[320:]), "003")  # again
    table.add(rows(made[300:310]), "001")  # long since in the base
    want, first = {}, {}
    for seq, key, name in made:
        first.setdefault(key, seq)
        want[key or seq] = (first[key] if key else seq, key, name)
    assert sorted(tuple(r) for r in table.read().collect()) == sorted(want.values())
    before = sorted(tuple(r) for r in table.read(before="003").collect())
    assert len(before) < len(want) and max(r[2] for r in before) != "n399"
    keys = spark.createDataFrame([("t7",), ("t8",), ("no",)], f"`{f.TAX_ID}` string")
    assert sorted(tuple(r) for r in table.read(keys).collect()) == sorted(want[k] for k in ("t7", "t8"))
    # A broken fold: a base without its _SUCCESS is not read.
    half = tmp_path / "s" / "base=002"
    shutil.copytree(tmp_path / "s" / _batch_names(tmp_path / "s", "base")[-1], half, dirs_exist_ok=True)
    (half / "_SUCCESS").unlink(missing_ok=True)
    assert sorted(tuple(r) for r in table.read().collect()) == sorted(want.values())
    table.fold(fan=1)
    assert sorted(tuple(r) for r in table.read().collect()) == sorted(want.values())
    assert ledger.summary_table(spark, str(tmp_path / "none"), schema).read().count() == 0


def test_history_of_several_bucket_counts(spark, tmp_path):
    path, schema = str(tmp_path / "history"), "seq long, record_key string, note string"
    rows = spark.createDataFrame([(i, f"k{i % 40}", None) for i in range(200)], schema)
    assert ledger.read_history(spark, path, schema).count() == 0
    ledger.append_history(rows.where("seq < 120"), path, "a", buckets=8)
    ledger.append_history(rows.where("seq >= 120"), path, "b", buckets=3)
    assert sorted(r["seq"] for r in ledger.read_history(spark, path, schema).collect()) == list(range(200))
    keys = spark.createDataFrame([("k3",), ("k17",), ("k3",), ("none",)], "record_key string")
    some = ledger.read_history(spark, path, schema, keys)
    assert sorted(r["seq"] for r in some.collect()) == [i for i in range(200) if i % 40 in (3, 17)]
    assert {r["note"] for r in some.collect()} == {""}
    opened = {x.rpartition("/")[0] for x in some.inputFiles()}
    everything = {x.rpartition("/")[0] for x in ledger.read_history(spark, path, schema).inputFiles()}
    assert opened < everything and len(opened) <= 6  # other buckets are not opened: three keys, two batches


def test_half_written_batch_is_replayed_whole(spark, tmp_path):
    data = frame(spark, [unit(1, "A", "U1", "8"), unit(2, "A", "U2", "10"), unit(3, "B", "U1", "5"), unit(4, "B", "U2", "5")])
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = schema_of(data)
    # What a crash left of batch 0: one of its rows.
    keyed = data.where("seq = 2").selectExpr("*", f"`{f.SUPPLIER}` AS record_key")
    ledger.append_history(keyed, str(tmp_path / "history"), f"{0:010}")
    table = ingested(spark, tmp_path, data, "c")
    history = ledger.read_history(spark, str(tmp_path / "history"), schema)
    assert sorted(r["seq"] for r in history.collect()) == [1, 2, 3, 4]
    assert sorted((r["record_key"], r["total"]) for r in table.read().collect()) == [("A", 90.0), ("B", 50.0)]
    both = incremental.eval_summary(history, table.read(), [f.SUPPLIER, f.UNIT, f.TOTAL])
    assert sorted(tuple(r) for r in both.collect() if r[1].startswith(f.ROLLUP_PREFIX)) == [("A", "彙總(U1、U2)", "90.0"), ("B", "彙總(U1、U2)", "50.0")]
    assert both.count() == 6


def test_supplier_summary_in_a_stream(spark, tmp_path):
    schema = f"seq long, `{f.TAX_ID}` string, name string"
    for n, rows in enumerate(([(1, "a", "x"), (2, "", "y")], [(3, "a", "z"), (4, "b", "w")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for checkpoint in ("c", f"again{n}"):  # the second time from the start, as after a loss of the checkpoint
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            incremental.ingest_suppliers(stream, str(tmp_path / "summary"), schema, str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
    got = ledger.summary_table(spark, str(tmp_path / "summary"), schema).read()
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", "z"), (2, "", "y"), (4, "b", "w")]


def test_template_tables(spark):
    made = templates.parse_templates(spark.createDataFrame([("t", """{"versions": [{"template": "n", "detect_hline": {"y_range": [1, 9], "page_top_line": 4}}, {"template": "no"}],
      "zones": {"z": {"anchor_left": 5, "ocr_anchors": {"9": "A|B"}, "type": "rows", "row_boundaries": [5, 9, 12], "row_search_radii": [[30, 30], 7]}},
      "fields": [{"name": "g", "type": "checkbox_group", "options": [{"label": "x", "zone": "z", "box": [1, 2, 3, 4]}, {"label": "y", "page": 2}]}]}""")], "template string, json string"))
    tables = templates.all_tables(made)
    assert [tuple(r) for r in tables.versions.collect()] == [("t", 0, "n", 1, 1, 9, 0.5, 4)]
    assert [(r["opt_no"], r["label"], r["page"], r["zone"], r["box"]) for r in tables.options.orderBy("opt_no").collect()] == [(0, "x", None, "t/z", [1, 2, 3, 4]), (1, "y", 2, None, None)]
    assert [(r["template_y"], r["radius_back"], r["radius_fwd"], r["pair"], r["ocr_label"]) for r in tables.lines.orderBy("line_no").collect()] == [(5, 40, 40, False, None), (9, 30, 30, True, "A|B"), (12, 7, 7, False, None)]
    assert [(r["zone"], r["type"], r["anchor_left"]) for r in tables.zones.collect()] == [("t/z", "rows", 5)]
