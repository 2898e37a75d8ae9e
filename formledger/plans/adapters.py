"""Form-shaped tables derived from the general ones, in SQL that both Spark and DuckDB run.

Each function gives SQL text; ``q`` quotes a column name for the engine and ``t`` names a source table. frame() runs one
on Spark; cte() makes one a common table expression for an oracle.
"""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame, SparkSession

from formledger.functions import fields as f


def spark_name(name: str) -> str:
    return f"`{name}`"


def ansi_name(name: str) -> str:
    return f'"{name}"'


def _score(k: int, key: str = "event_id") -> str:
    return (
        f"CASE WHEN {key} % 11 = {k % 11} THEN '' WHEN {key} % 13 = {k} THEN 'l0' WHEN {key} % 17 = {k} THEN '1,0' WHEN {key} % 19 = {k} THEN 'abc' "
        f"WHEN {key} % 23 = {k} THEN '\u3000 7.5\u00a0' WHEN {key} % 27 = {k} THEN '７' ELSE CAST(({key} * 7 + {3 * k}) % 11 AS STRING) END"
    )


def eval_units(q, t, key: str = "concat('S', user_id, '-', event_id % 60, CASE WHEN event_id % 8 = 3 THEN '\u3000' ELSE '' END)") -> str:
    cells = [f"{_score(k)} AS {q(f'{i}_{f.SCORE}')}" for k, i in enumerate(f.EVAL_ITEMS)]
    cells += [f"CASE WHEN event_id % 29 = {k} THEN 'x' ELSE '10' END AS {q(f'{i}_{f.LIMIT}')}" for k, i in enumerate(f.EVAL_ITEMS)]
    cells += [f"CASE WHEN event_id % 7 = {k} THEN '15' ELSE {_score(k + 10)} END AS {q(f'{i}_{f.BONUS}')}" for k, i in enumerate(f.BONUS_ITEMS)]
    return f"""
      SELECT event_id AS seq, concat('scan', event_id % 7, '.pdf') AS {q(f.SOURCE_FILE)}, substring(CAST(ts AS STRING), 1, 10) AS {q(f.PROCESSED)},
             {key} AS {q(f.SUPPLIER)}, event_type AS {q(f.CATEGORY)}, concat('K', event_id % 5) AS {q(f.PURCHASE)},
             CASE WHEN event_id % 31 = 0 THEN '彙總(old)' WHEN event_id % 37 = 0 THEN '' ELSE concat('U', event_id % 4) END AS {q(f.UNIT)},
             CASE WHEN event_id % 9 = 0 THEN '' ELSE concat('P', event_id % 6) END AS {q(f.PERSON)}, substring(CAST(ts AS STRING), 1, 10) AS {q(f.DATE)},
             {", ".join(cells)}, CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(event_id % 101 AS STRING) END AS {q(f.TOTAL)}, '' AS {q(f.GRADE)}
      FROM {t("events")}"""


def big_units(q, t) -> str:
    """Unit rows with few very large suppliers and names that need cleaning."""
    return eval_units(q, t, "CASE WHEN event_id % 2 = 0 THEN concat('S/', user_id % 20) ELSE concat('S', user_id % 20) END")


def supplier_rows(q, t) -> str:
    return f"""
      SELECT o_orderkey AS seq, concat('form', o_orderkey % 11, '.pdf') AS {q(f.SOURCE_FILE)}, substring(CAST(o_orderdate AS STRING), 1, 10) AS {q(f.PROCESSED)},
             CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN substring(concat('0000000', o_custkey), -7, 7)
                  ELSE concat(lpad(CAST(o_custkey AS STRING), 8, '0'), CASE WHEN o_orderkey % 29 = 0 THEN '\u3000' ELSE '' END) END AS {q(f.TAX_ID)},
             CASE WHEN o_orderkey % 19 = 0 THEN ' \u3000' WHEN o_orderkey % 7 = 0 THEN concat(c_name, '/x:y') ELSE c_name END AS {q(f.COMPANY)},
             o_orderpriority AS {q("服務範疇")}, CASE WHEN o_orderkey % 5 = 0 THEN '\u00a0' ELSE c_mktsegment END AS {q("聯絡人")},
             o_orderstatus AS {q("附件1_設立證明文件")}, CASE WHEN o_orderkey % 3 = 0 THEN '是' ELSE '否' END AS {q("附件2_存摺封面")}
      FROM {t("orders")} JOIN {t("customer")} ON o_custkey = c_custkey"""


def submissions(q, t) -> str:
    kinds = "CASE page_id % 8 WHEN 0 THEN 'vendor_form' WHEN 1 THEN 'evaluation' WHEN 2 THEN 'quotation' WHEN 3 THEN 'supplier_form' WHEN 4 THEN 'letter' WHEN 5 THEN 'eval_form' WHEN 6 THEN 'supplier' ELSE 'supplier_evaluation' END"
    name = "concat('f', page_id % 50, CASE page_id % 9 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpg' WHEN 3 THEN '.tiff' WHEN 4 THEN '.docx' WHEN 5 THEN '' WHEN 6 THEN '.webp' WHEN 7 THEN '.bmp' ELSE '.jpeg' END)"
    size = "CASE WHEN page_id % 23 = 0 THEN 0 WHEN page_id % 29 = 0 THEN 20971521 ELSE length(html) END"
    row = f"{kinds} AS document_type, {name} AS file_name, CAST({size} AS BIGINT) AS size_bytes, html"
    return f"""
      SELECT page_id * 2 AS doc_id, {row}, CAST(page_id AS BIGINT) AS received_ts FROM {t("pages")}
      UNION ALL SELECT page_id * 2 + 1 AS doc_id, {row}, CAST(page_id + 1000000 AS BIGINT) AS received_ts FROM {t("pages")} WHERE page_id % 10 = 0"""


def readings(q, t) -> str:
    names = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate([*f.score_fields(), f.TOTAL, f.SUPPLIER]))
    return f"""
      SELECT event_id % 4000 AS doc_id, CASE event_id % 14 {names} END AS field,
             CASE event_id % 10 WHEN 0 THEN '' WHEN 1 THEN 'l0' WHEN 2 THEN '1100' WHEN 3 THEN 'q' WHEN 4 THEN '.5.' WHEN 5 THEN '—'
                  WHEN 6 THEN '７' WHEN 7 THEN 'O' WHEN 8 THEN ' 8 x' ELSE CAST(event_id % 12 AS STRING) END AS batch_text,
             CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN '10' WHEN 2 THEN 'S' WHEN 3 THEN 'zz' WHEN 4 THEN '99' ELSE '6' END AS single_text, event_id
      FROM {t("events")}"""


def marks(q, t) -> str:
    return f"""
      SELECT user_id AS doc_id, concat('G', event_id % 40) AS field, CAST(event_id % 6 AS INT) AS opt_no, concat('L', event_id % 6) AS label,
             max(value) > 50 AS checked, max(value) / 1000 AS ratio
      FROM {t("events")} GROUP BY 1, 2, 3, 4"""


def cells(q, t) -> str:
    names = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(f.score_fields()))
    return f"""
      SELECT user_id AS doc_id, CASE event_id % 12 {names} END AS field, min(CAST(event_id % 11 AS STRING)) AS value, min(event_id) AS event_id
      FROM {t("events")} GROUP BY 1, 2"""


def frame(spark: SparkSession, sf_dir: str, adapter) -> DataFrame:
    used: dict[str, DataFrame] = {}

    def named(name: str) -> str:
        used[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return "{" + name + "}"

    text = adapter(spark_name, named)
    return spark.sql(text, **used)


def cte(*adapters) -> str:
    return "WITH " + ", ".join(f"{a.__name__} AS ({a(ansi_name, lambda n: n)})" for a in adapters if inspect.isfunction(a))
