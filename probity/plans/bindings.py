"""The test tables as the library's tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

VIEWS = {
    "samples": "SELECT doc_id AS sample_id, sha256, source AS contributor, lang AS label, path FROM (SELECT doc_id, lang, source, sha2(coalesce(text, ''), 256) AS sha256, concat(source, CASE doc_id % 10 WHEN 0 THEN '/validation/' WHEN 1 THEN '/test/' ELSE '/train/' END, lang, '/', CAST(doc_id AS STRING), '.txt') AS path FROM {documents}) d",
    "findings": """SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS finding_id,
      l_orderkey AS analysis_id, CASE WHEN l_quantity >= 48 THEN 'CRITICAL' WHEN l_quantity >= 40 THEN 'HIGH' WHEN l_quantity >= 25 THEN 'MEDIUM' WHEN l_quantity >= 10 THEN 'LOW' WHEN l_quantity >= 3 THEN 'INFO' ELSE 'ODD' END AS severity,
      CASE l_returnflag WHEN 'A' THEN 'SEC-ARCHIVE' WHEN 'N' THEN 'DS-LABEL-FLIPPING' ELSE 'MOD-BACKDOOR' END AS category, 1 - l_discount * 10 AS raw_confidence, 1 - l_discount AS confidence,
      CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE concat('owner', CAST(l_suppkey % 5 AS STRING)) END AS owner_id, CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS acknowledged_at, l_shipdate AS created_at FROM {lineitem}""",
    "analyses": """SELECT o_orderkey AS analysis_id, CASE o_orderkey % 4 WHEN 0 THEN 'DATASET' WHEN 1 THEN 'MODEL' WHEN 2 THEN 'INFERENCE' ELSE 'DISTRIBUTION' END AS type, concat('asset', CAST(o_custkey AS STRING)) AS sha256, o_totalprice / 5500 AS risk_score,
      CASE WHEN o_orderpriority = '5-LOW' THEN 'fallback' ELSE 'engine' END AS engine, CASE WHEN o_orderstatus = 'P' THEN 'ANALYSIS FAILED' ELSE 'DONE' END AS status, concat('owner', CAST(o_custkey % 7 AS STRING)) AS owner_id, o_orderkey % 9 = 0 AS is_demo, o_orderdate AS created_at FROM {orders}""",
    "records": """SELECT event_id AS record_id, md5(concat(CAST(user_id AS STRING), '/', CAST(CAST(floor(value) AS BIGINT) AS STRING))) AS nonce, md5(event_type) AS record_hash, CAST(user_id AS STRING) AS input_hash, CAST(event_id % 3 AS STRING) AS model_hash, event_type AS prediction, ts,
      CASE WHEN event_id % 40 = 0 THEN TIMESTAMP '2023-06-01 00:00:00' ELSE ts END AS received_at, CASE WHEN event_type = 'error' THEN 'TAMPERED' ELSE 'VERIFIED' END AS status FROM {events}""",
    "attempts": "SELECT CAST(user_id AS STRING) AS identifier, event_type <> 'error' AS successful, event_type = 'error' AS failed, ts AS attempted_at, ts FROM {events}",
    "observations": "SELECT concat('sensor', CAST(user_id % 6 AS STRING)) AS sensor, ts, event_id, value AS signal, value > 400 AS hard FROM {events}",
    "submissions": """SELECT CASE WHEN l_linenumber % 2 = 0 THEN upper(s_name) ELSE s_name END AS name, CAST(l_quantity AS BIGINT) AS samples, CAST(floor(l_tax * 100) AS BIGINT) AS defects, l_discount * 1000 AS risk, concat(l_returnflag, l_linestatus) AS drivers, l_orderkey AS analysis_id, l_returnflag AS archive, l_shipdate AS created_at FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey""",
    "values": """SELECT CAST(p AS BIGINT) AS comparison_id, feature, side, value FROM (SELECT l_linenumber AS p, 'quantity' AS feature, CASE WHEN l_shipdate < TIMESTAMP '1998-06-01 00:00:00' THEN 0 ELSE 1 END AS side, l_quantity AS value, l_tax FROM {lineitem} UNION ALL SELECT l_linenumber, 'price', CASE WHEN l_shipdate < TIMESTAMP '1998-06-01 00:00:00' THEN 0 ELSE 1 END, l_extendedprice, l_tax FROM {lineitem}
      UNION ALL SELECT l_linenumber, 'moved', l_suppkey % 2, l_quantity + (l_suppkey % 2) * 20, l_tax FROM {lineitem}) v""",
    "classes": "SELECT CAST(l_linenumber AS BIGINT) AS comparison_id, CASE WHEN l_shipdate < TIMESTAMP '1998-06-01 00:00:00' THEN 0 ELSE 1 END AS side, CASE WHEN l_quantity > 40 AND l_suppkey % 3 = 0 THEN 'X' ELSE l_returnflag END AS cls FROM {lineitem}",
    "chain": """SELECT conv_id, turn + 1 AS sequence, payload, previous_hash, CASE WHEN conv_id % 11 = 3 AND turn = 1 THEN 'zz' ELSE current_hash END AS current_hash, conv_id % 13 <> 5 OR turn <> 2 AS signature_valid FROM (
      SELECT conv_id, turn, payload, lag(own) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_hash, own AS current_hash FROM (SELECT conv_id, turn, coalesce(text, '') AS payload, sha2(coalesce(text, ''), 256) AS own FROM {conversations}) c0) c1""",
    "manifest": "SELECT l_suppkey AS archive_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS entry_no, CAST(floor(l_extendedprice * 4000) AS BIGINT) AS file_size, CAST(l_quantity * 10000 + 30000 AS BIGINT) AS compressed_size, l_tax > 0.075 AS is_link FROM {lineitem}",
    "responses": "SELECT CAST(user_id AS BIGINT) AS sample, concat('t', CAST(event_id % 5 AS STRING)) AS trigger_name, 1 + CAST(user_id % 4 AS BIGINT) AS clean_pred, CASE WHEN event_id % 5 = 2 THEN CASE WHEN event_id % 10 = 2 THEN 9 ELSE 1 + CAST(user_id % 4 AS BIGINT) END ELSE 1 + CAST((user_id + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) % 4 AS BIGINT) END AS pred FROM {events}",
    "masks": "SELECT CAST(s_nationkey AS BIGINT) AS model, s_suppkey AS cls, CASE WHEN s_suppkey % 17 = 0 THEN 20.0 ELSE 800 + s_acctbal / 100 END AS l1_norm, 0.5 + (s_suppkey % 50) / 100.0 AS attack_success FROM {supplier}",
    "tensors": "SELECT p_brand AS tensor, p_partkey AS row_idx, CASE WHEN p_size = 7 THEN 0.0 ELSE (p_retailprice - 1000) / 100 END AS x FROM {part}",
    "annotations": "SELECT l_orderkey AS image_id, CASE WHEN l_suppkey % 23 = 0 THEN 900 ELSE l_suppkey % 5 END AS category_id, CAST(l_partkey * 10 + l_linenumber AS BIGINT) AS annotation_id, l_quantity - 2 AS w, l_tax * 100 AS h, CASE WHEN l_orderkey % 50 = 7 THEN l_orderkey + 100000000 ELSE l_orderkey END AS annotated FROM {lineitem}",
}


def placed(name: str, wrap) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: wrap(m[1]), VIEWS[name])


def view(spark, sf_dir: str, name: str) -> DataFrame:
    """A bound table as a DataFrame; only the tables and columns it names are read."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", VIEWS[name]))}
    return spark.sql(VIEWS[name], **tables)


def sql(body: str) -> str:
    """DuckDB SQL of ``body`` over the bound tables that it names, with Spark's sha2 spelled its way."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", body)]
    heads = [f"{n} AS ({placed(n, str)})" for n in used]
    text = body.strip()
    joined = ", ".join(heads)
    recursive = text[:15].upper() == "WITH RECURSIVE "
    text = "WITH " + text[15:] if recursive else text
    out = text if not heads else f"WITH {joined}, {text[5:]}" if text[:5].upper() == "WITH " else f"WITH {joined} {text}"
    out = "WITH RECURSIVE " + out[5:] if recursive else out
    return re.sub(r"sha2\((.*?), 256\)", r"sha256(\1)", out)
