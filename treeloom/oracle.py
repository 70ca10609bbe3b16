"""The same results in SQL, written independently of the Spark plans."""

from __future__ import annotations

RUNS = """runs AS (
  SELECT CAST(o_orderkey AS INT) AS sequence_no,
    CASE WHEN o_orderkey % 50 = 9 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS extracted_at,
    CASE WHEN o_orderkey % 50 = 9 THEN NULL ELSE o_orderdate END AS extracted,
    CAST(o_custkey AS INT) AS record_count, sha256(CAST(o_orderkey AS VARCHAR)) AS sha256,
    CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Released' ELSE 'Pending' END AS status,
    'run ' || o_orderkey AS data_file_name,
    CASE WHEN o_orderkey % 4 = 0 AND o_orderstatus = 'O' THEN 'done' END AS delivered_at
  FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW'))"""

JUDGED = RUNS + """, requests AS (
  SELECT event_id AS request_no, CAST(event_id * 3 % 17000 AS INT) AS sequence_no,
    CASE event_id % 3 WHEN 0 THEN 'release' WHEN 1 THEN 'deliver' ELSE 'skip' END AS action,
    'u' || user_id AS actor,
    CASE WHEN event_id % 11 = 0 THEN ' ' WHEN event_id % 7 = 0 THEN 'U' || user_id ELSE 'u' || (user_id + 1) END AS approver,
    CAST(event_id % 100 AS INT) AS imported_record_count, props AS notes
  FROM events),
checked AS (
  SELECT q.*, r.status AS run_status, CASE
    WHEN action = 'release' AND trim(approver) = '' THEN 'no_approver'
    WHEN action = 'release' AND lower(actor) = lower(approver) THEN 'same_person'
    WHEN action = 'release' AND lower(approver) NOT IN (SELECT 'u' || user_id FROM events WHERE value > 200)
      THEN 'unknown_approver'
    WHEN r.status IS NULL THEN 'no_run'
    WHEN action = 'release' AND r.status <> 'Pending' THEN 'not_pending'
    WHEN action = 'deliver' AND r.status <> 'Released' THEN 'not_released'
    WHEN action = 'deliver' AND r.delivered_at IS NOT NULL THEN 'delivered_before'
    WHEN action = 'deliver' AND length(notes) > 2000 THEN 'long_notes'
    WHEN action = 'skip' AND r.status NOT IN ('Pending', 'Failed')
      THEN 'not_skippable'
    END AS refusal
  FROM requests q LEFT JOIN runs r ON r.sequence_no = q.sequence_no),
judged AS (
  SELECT *, refusal IS NULL AND request_no = min(request_no) FILTER (WHERE refusal IS NULL)
    OVER (PARTITION BY sequence_no) AS accepted
  FROM checked)"""

# Requests take turns: each run is walked through its well-formed requests, one after the other.
CHAIN = JUDGED.replace("event_id * 3 % 17000", "event_id % 211 * 7") + """, formed AS (
  SELECT q.*, r.status AS s, r.delivered_at IS NOT NULL AS d, row_number() OVER (PARTITION BY q.sequence_no ORDER BY request_no) AS turn
  FROM requests q JOIN runs r ON r.sequence_no = q.sequence_no),
walk AS (
  SELECT sequence_no, turn, request_no, s, d, action, coalesce(refusal IN ('no_approver', 'same_person', 'unknown_approver') OR
    (action = 'deliver' AND length(notes) > 2000), false) AS bad FROM formed JOIN (SELECT request_no, refusal FROM checked) USING (request_no)),
steps AS (
  WITH RECURSIVE run(sequence_no, turn, request_no, s, d, yes) AS (
    SELECT sequence_no, 0::BIGINT, NULL::BIGINT, min(s), bool_or(d), false FROM walk GROUP BY sequence_no
    UNION ALL
    SELECT w.sequence_no, w.turn, w.request_no,
      CASE WHEN w.bad THEN r.s WHEN w.action = 'release' AND r.s = 'Pending' THEN 'Released' WHEN w.action = 'skip' AND r.s IN ('Pending', 'Failed') THEN 'Skipped' ELSE r.s END,
      r.d OR (NOT w.bad AND w.action = 'deliver' AND r.s = 'Released'),
      NOT w.bad AND ((w.action = 'release' AND r.s = 'Pending') OR (w.action = 'skip' AND r.s IN ('Pending', 'Failed')) OR (w.action = 'deliver' AND r.s = 'Released' AND NOT r.d))
    FROM run r JOIN walk w ON w.sequence_no = r.sequence_no AND w.turn = r.turn + 1)
  SELECT * FROM run),
chain AS (
  SELECT q.request_no, q.sequence_no, q.action, q.actor, q.approver, q.imported_record_count, coalesce(n.yes, false) AS accepted, CASE WHEN NOT coalesce(n.yes, false) THEN CASE
    WHEN action = 'release' AND trim(approver) = '' THEN 'no_approver'
    WHEN action = 'release' AND lower(actor) = lower(approver) THEN 'same_person'
    WHEN action = 'release' AND lower(approver) NOT IN (SELECT 'u' || user_id FROM events WHERE value > 200) THEN 'unknown_approver'
    WHEN b.sequence_no IS NULL THEN 'no_run'
    WHEN action = 'release' THEN 'not_pending'
    WHEN action = 'deliver' AND b.s <> 'Released' THEN 'not_released'
    WHEN action = 'deliver' AND b.d THEN 'delivered_before'
    WHEN action = 'deliver' THEN 'long_notes'
    ELSE 'not_skippable' END END AS reason
  FROM requests q LEFT JOIN steps n ON n.request_no = q.request_no LEFT JOIN steps b ON b.sequence_no = n.sequence_no AND b.turn = n.turn - 1)"""

SPARSE = """sparse AS (SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS priority,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS ordered FROM orders)"""

PART = "CAST(0 AS BIGINT) AS part"


def _joined_orders(delimiter: str) -> str:
    return f"""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name,
      coalesce((SELECT string_agg(CAST(o_orderkey AS VARCHAR), '{delimiter}' ORDER BY o_orderkey) FROM orders
        WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'), '') AS orders,
      coalesce((SELECT string_agg(CAST(o_orderdate AS VARCHAR), '{delimiter}' ORDER BY o_orderkey) FROM orders
        WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'), '') AS dates,
      {PART} FROM customer"""


def _document(before: str, after: str) -> str:
    record = """'{"id":"' || c_custkey || '","name":"' || c_name || '"}'"""
    return f"""SELECT 0 AS section, CAST(NULL AS BIGINT) AS c_custkey, {PART}, '{before}' AS line
      UNION ALL SELECT 2, NULL, 0, '{after}'
      UNION ALL SELECT 1, c_custkey, 0, {record} FROM customer
      UNION ALL SELECT 1, c_custkey, -1, ',' FROM customer WHERE c_custkey > (SELECT min(c_custkey) FROM customer)"""


def _catalog() -> str:
    tables = {
        "region": ["r_regionkey int", "r_name string"],
        "nation": ["n_nationkey int", "n_name string", "n_regionkey int"],
        "customer": ["c_custkey bigint", "c_name string", "c_nationkey int", "c_acctbal double", "c_mktsegment string"],
        "supplier": ["s_suppkey bigint", "s_name string", "s_nationkey int", "s_acctbal double"],
        "part": ["p_partkey bigint", "p_name string", "p_brand string", "p_type string", "p_size int", "p_retailprice double"],
        "orders": ["o_orderkey bigint", "o_custkey bigint", "o_orderstatus string", "o_totalprice double",
                   "o_orderdate timestamp_ntz", "o_orderpriority string"],
        "lineitem": ["l_orderkey bigint", "l_partkey bigint", "l_suppkey bigint", "l_linenumber int", "l_quantity double",
                     "l_extendedprice double", "l_discount double", "l_tax double", "l_returnflag string",
                     "l_linestatus string", "l_shipdate timestamp_ntz"],
        "events": ["event_id bigint", "ts timestamp_ntz", "user_id bigint", "event_type string", "value double", "props string"],
        "documents": ["doc_id bigint", "text string", "lang string", "source string", "n_chars bigint"],
        "embeddings": ["vec_id bigint", "embedding array<float>", "label int"],
        "pages": ["page_id bigint", "url string", "html string"],
        "benchmark": ["item_id bigint", "text string"],
        "labels": ["doc_id bigint", "quality int", "toxic int"],
        "conversations": ["conv_id bigint", "turn bigint", "role string", "text string"],
    }
    references = {
        "n_regionkey": ("region", "r_regionkey"), "c_nationkey": ("nation", "n_nationkey"),
        "s_nationkey": ("nation", "n_nationkey"), "o_custkey": ("customer", "c_custkey"),
        "l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey"),
    }
    rows = []
    for table, columns in tables.items():
        for number, text in enumerate(columns, 1):
            name, kind = text.split()
            key = "false"
            if number == 1:
                key = f"(SELECT count(*) = count(DISTINCT {name}) FROM {table})"
            target = ("documents", "doc_id") if (table, name) == ("labels", "doc_id") else references.get(name)
            fk = f"'{target[0]}', '{target[1]}'" if target else "CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)"
            rows.append(
                f"SELECT '{table}' AS table_name, {number} AS ordinal, '{name}' AS column_name, '{kind}' AS data_type, "
                f"(SELECT count(*) > count({name}) FROM {table}) AS nullable, {key} AS primary_key, {fk}"
            )
    first, *rest = rows
    head = first.replace("CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR) AS fk_table, CAST(NULL AS VARCHAR) AS fk_column")
    return " UNION ALL ".join([head, *rest])


ORACLE: dict[str, str] = {
    "project_rename": f"SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand AS brand, {PART} FROM part",
    "flat_export": f"""SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS nation,
        coalesce((SELECT string_agg(c_name, ', ' ORDER BY c_custkey) FROM customer WHERE c_nationkey = n_nationkey), '') AS customers,
        coalesce((SELECT string_agg(c_mktsegment, ', ' ORDER BY c_custkey) FROM customer WHERE c_nationkey = n_nationkey), '') AS segments,
        coalesce((SELECT string_agg(s_name, ' | ' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '') AS suppliers,
        {PART} FROM nation""",
    "flat_iso_dates": f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d') AS ordered,
        o_orderstatus AS status, {PART} FROM orders""",
    "flat_null_to_empty": f"""WITH {SPARSE} SELECT CAST(o_orderkey AS VARCHAR) AS id, coalesce(priority, '') AS priority,
        coalesce(strftime(ordered, '%Y-%m-%d'), '') AS ordered, {PART} FROM sparse""",
    "relation_string_join": _joined_orders("; "),
    "relation_array_join": _joined_orders(","),
    "flat_json_records": f"""WITH j AS ({_joined_orders("; ")})
        SELECT CAST(id AS BIGINT) AS c_custkey, part,
        CAST(json_object('id', id, 'name', name, 'orders', orders, 'dates', dates) AS VARCHAR) AS line FROM j""",
    "strip_denied_flat": f"""SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(s_nationkey AS VARCHAR) AS nation, {PART}
        FROM supplier""",
    "object_lookup": f"""SELECT c_custkey, {PART}, CAST(json_object('id', CAST(c_custkey AS VARCHAR), 'name', c_name, 'nation',
        json_object('name', n_name, 'region', json_object('name', r_name))) AS VARCHAR) AS json
        FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "array_embed": f"""SELECT c_custkey, {PART}, CAST(json_object('id', CAST(c_custkey AS VARCHAR), 'name', c_name, 'orders',
        coalesce((SELECT to_json(list(json_object('key', CAST(o_orderkey AS VARCHAR), 'status', o_orderstatus) ORDER BY o_orderkey))
          FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'),
          CAST('[]' AS JSON))) AS VARCHAR) AS json FROM customer""",
    "object_lookup_mixed_keys": f"""SELECT c_custkey, {PART}, CAST(json_object('id', CAST(c_custkey AS VARCHAR), 'nation',
        json_object('name', n_name)) AS VARCHAR) AS json FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "array_embed_mixed_keys": f"""SELECT c_name, {PART}, CAST(json_object('name', c_name, 'orders',
        coalesce((SELECT to_json(list(json_object('key', CAST(o_orderkey AS VARCHAR)) ORDER BY o_orderkey)) FROM orders
          WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'),
          CAST('[]' AS JSON))) AS VARCHAR) AS json FROM customer""",
    "null_join_keys": f"""SELECT n_nationkey, {PART}, CAST(json_object('nation', n_name, 'region',
        CASE WHEN n_regionkey <> 2 THEN json_object('name', r_name) END, 'customers', coalesce(
        (SELECT to_json(list(json_object('id', CAST(c_custkey AS VARCHAR)) ORDER BY c_custkey)) FROM customer
          WHERE c_nationkey = n_nationkey AND c_nationkey <> 3), CAST('[]' AS JSON))) AS VARCHAR) AS json
        FROM nation JOIN region ON r_regionkey = n_regionkey""",
    "map_number_long": f"""SELECT {PART}, '{{"id":"' || p_partkey || '","value":' || CASE p_partkey % 4
        WHEN 0 THEN '1234567890123456789012345678' || (p_size % 10) WHEN 1 THEN '0.' || repeat('3', 28)
        WHEN 2 THEN '"9' || repeat('0', 27) || (p_size % 10) || '"'
        ELSE '-' || p_size || '.' || repeat('6', 28 - length(CAST(p_size AS VARCHAR)) - CASE WHEN p_size > 7 AND p_size < 10 OR p_size > 78 THEN 1 ELSE 0 END) || '7' END || '}}' AS json,
        CAST(p_partkey AS BIGINT) AS p_partkey FROM part""",
    "csv_lines_same_names": f"""WITH j AS ({_joined_orders("; ")})
        SELECT CAST(id AS BIGINT) AS c_custkey, part, id || ',' || name || ',' || orders AS line FROM j""",
    "package_manifests": """SELECT format, (SELECT count(*) FROM customer) AS record_count, CAST(0 AS BIGINT) AS problems
        FROM (VALUES ('json'), ('csv'), ('xlsx')) AS f(format)""",
    "tree_three_levels": f"""WITH n AS (SELECT n_nationkey, n_regionkey, json_object('name', n_name, 'customers',
          coalesce((SELECT to_json(list(json_object('id', CAST(c_custkey AS VARCHAR), 'name', c_name) ORDER BY c_custkey))
            FROM customer WHERE c_nationkey = n_nationkey), CAST('[]' AS JSON))) AS j FROM nation)
        SELECT r_regionkey, {PART}, CAST(json_object('region', r_name, 'nations', coalesce(
          (SELECT to_json(list(j ORDER BY n_nationkey)) FROM n WHERE n_regionkey = r_regionkey), CAST('[]' AS JSON))) AS VARCHAR) AS json
        FROM region""",
    "tree_three_levels_split": """SELECT r_regionkey, '{"region":"' || r_name || '","nations":[' AS json FROM region
        UNION ALL SELECT r_regionkey, ']}' FROM region
        UNION ALL SELECT n_regionkey, CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) > 1
          THEN ',' ELSE '' END || '{"name":"' || n_name || '","customers":[' FROM nation
        UNION ALL SELECT n_regionkey, ']}' FROM nation
        UNION ALL SELECT n_regionkey, CASE WHEN row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) > 1
          THEN ',' ELSE '' END || '{"id":"' || c_custkey || '","name":"' || c_name || '"}'
          FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "tree_scalars_text": f"""SELECT o_orderkey, {PART}, CAST(json_object('key', CAST(o_orderkey AS VARCHAR), 'ordered',
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), 'status', o_orderstatus, 'customer',
        CASE WHEN c_custkey IS NOT NULL THEN json_object('nation', CAST(c_nationkey AS VARCHAR)) END) AS VARCHAR) AS json
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
    "tree_root_filter": f"""SELECT c_custkey, {PART}, CAST(json_object('id', CAST(c_custkey AS VARCHAR), 'orders', coalesce(
        (SELECT to_json(list(json_object('key', CAST(o_orderkey AS VARCHAR)) ORDER BY o_orderkey)) FROM orders
          WHERE o_custkey = c_custkey), CAST('[]' AS JSON))) AS VARCHAR) AS json
        FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 10""",
    "tree_node_filter": f"""SELECT c_custkey, {PART}, CAST(json_object('name', c_name, 'failed', coalesce(
        (SELECT to_json(list(json_object('key', CAST(o_orderkey AS VARCHAR)) ORDER BY o_orderkey)) FROM orders
          WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '5-LOW'), CAST('[]' AS JSON)),
        'africa', (SELECT json_object('name', n_name) FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 0)
        ) AS VARCHAR) AS json FROM customer""",
    "tree_disabled_pruned": f"""SELECT c_custkey, {PART}, CAST(json_object('id', CAST(c_custkey AS VARCHAR), 'orders', coalesce(
        (SELECT to_json(list(json_object('key', CAST(o_orderkey AS VARCHAR)) ORDER BY o_orderkey)) FROM orders
          WHERE o_custkey = c_custkey), CAST('[]' AS JSON))) AS VARCHAR) AS json FROM customer""",
    "tree_same_table_twice": f"""WITH l AS (SELECT l_orderkey,
          list(json_object('line', CAST(l_linenumber AS VARCHAR), 'part', CAST(l_partkey AS VARCHAR))
            ORDER BY l_linenumber, l_partkey) FILTER (WHERE l_returnflag = 'R') AS returned,
          list(json_object('line', CAST(l_linenumber AS VARCHAR), 'part', CAST(l_partkey AS VARCHAR))
            ORDER BY l_linenumber, l_partkey) FILTER (WHERE l_returnflag <> 'R') AS kept
          FROM lineitem GROUP BY l_orderkey)
        SELECT o_orderkey, {PART}, CAST(json_object('key', CAST(o_orderkey AS VARCHAR),
          'returned', coalesce(to_json(returned), CAST('[]' AS JSON)), 'kept', coalesce(to_json(kept), CAST('[]' AS JSON))
          ) AS VARCHAR) AS json FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
    "tree_flatten_columns": f"""SELECT n_name AS nation, r_name AS "region.name",
        coalesce((SELECT string_agg(CAST(s_suppkey AS VARCHAR), ', ' ORDER BY s_suppkey) FROM supplier
          WHERE s_nationkey = n_nationkey), '') AS "suppliers.key",
        coalesce((SELECT string_agg(s_name, ', ' ORDER BY s_suppkey) FROM supplier
          WHERE s_nationkey = n_nationkey), '') AS "suppliers.name", {PART}
        FROM nation JOIN region ON r_regionkey = n_regionkey""",
    "tree_flatten_split": """SELECT n_nationkey, n_name AS nation, r_name AS "region.name", '' AS "suppliers.key", '' AS "suppliers.name"
        FROM nation JOIN region ON r_regionkey = n_regionkey
        UNION ALL SELECT s_nationkey, '', '', d || s_suppkey, d || s_name FROM (SELECT *, CASE WHEN row_number()
          OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) > 1 THEN ', ' ELSE '' END AS d FROM supplier)
          JOIN nation ON n_nationkey = s_nationkey""",
    "scope_exists_filter": f"""SELECT c_custkey, {PART}, CAST(json_object('id', CAST(c_custkey AS VARCHAR), 'name', c_name) AS VARCHAR) AS json
        FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)""",
    "preview_first_n": f"""SELECT o_orderkey, {PART}, CAST(json_object('key', CAST(o_orderkey AS VARCHAR), 'customer',
        (SELECT json_object('name', c_name) FROM customer WHERE c_custkey = o_custkey), 'lines', coalesce(
        (SELECT to_json(list(json_object('line', CAST(l_linenumber AS VARCHAR), 'part', CAST(l_partkey AS VARCHAR))
          ORDER BY l_linenumber, l_partkey)) FROM lineitem WHERE l_orderkey = o_orderkey), CAST('[]' AS JSON))) AS VARCHAR) AS json
        FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50)""",
    "nested_native_types": f"""SELECT o_orderkey, {PART}, CAST(json_object('key', o_orderkey, 'ordered',
        strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), 'customer', CASE WHEN c_custkey IS NOT NULL
        THEN json_object('id', c_custkey, 'name', c_name) END) AS VARCHAR) AS json
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
    "strip_denied_nested": f"""SELECT s_suppkey, {PART}, CAST(json_object('id', CAST(s_suppkey AS VARCHAR), 'nation',
        json_object('name', n_name)) AS VARCHAR) AS json FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "strip_denied_any": """WITH said AS (SELECT conv_id, '[' || string_agg('{"said":{"role":"' || role || '"},"sizes":' ||
        CASE role WHEN 'assistant' THEN '{}' ELSE '{"' || role || '":' || length(text) || '}' END || ',"turn":' || turn || '}', ',' ORDER BY turn) || ']'
        AS turns FROM conversations GROUP BY conv_id) SELECT conv_id, turns, turns AS document FROM said""",
    "flatten_any": "SELECT conv_id, " + ", ".join(
        f"""coalesce(string_agg({value}, ', ' ORDER BY turn), '') AS "{column}.{path}" """ for column in ("turns", "document") for path, value in (
            ("said.Contact_Name", "length(text)::varchar"), ("said.role", "role"), ("turn", "turn::varchar"),
            *((f"sizes.{role}", f"CASE role WHEN '{role}' THEN length(text)::varchar END") for role in ("assistant", "system", "user")),
        )
    ) + " FROM conversations GROUP BY conv_id",
    "package_flattened": """SELECT CAST(c_custkey AS VARCHAR) AS id, n_name AS "nation.name", coalesce((SELECT string_agg(o_orderkey::varchar, ', ' ORDER BY o_orderkey)
        FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'), '') AS "orders.key"
        FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "lateral_first_match": """SELECT n_nationkey, n_name, f.s_suppkey, f.s_name FROM nation LEFT JOIN LATERAL
        (SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_suppkey LIMIT 1) f ON true""",
    "map_upper": f"SELECT CAST(p_partkey AS VARCHAR) AS id, upper(p_name) AS value, {PART} FROM part",
    "map_lower": f"SELECT CAST(p_partkey AS VARCHAR) AS id, lower(p_brand) AS value, {PART} FROM part",
    "map_trim": f"SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS value, {PART} FROM part",
    "map_constant": f"SELECT CAST(o_orderkey AS VARCHAR) AS id, 'EU' AS value, {PART} FROM orders",
    "map_default": f"""WITH {SPARSE} SELECT CAST(o_orderkey AS VARCHAR) AS id,
        CASE WHEN priority IS NULL THEN 'unknown' ELSE upper(priority) END AS value, {PART} FROM sparse""",
    "map_date_format": f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderkey % 10 WHEN 3 THEN 'no date' WHEN 4 THEN ''
        ELSE strftime(o_orderdate, '%m/%d/%Y') END AS value, {PART} FROM orders""",
    "map_number": f"""SELECT p_partkey, {PART}, '{{"id":"' || p_partkey || '","value":' || CASE p_partkey % 6
        WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(1100 + p_size AS VARCHAR) || '.50'
        WHEN 2 THEN CASE WHEN p_size = 0 THEN '0' ELSE '-' || p_size END
        WHEN 3 THEN '"' || p_size || 'e3"' WHEN 4 THEN '"' || p_brand || '"' ELSE 'null' END || '}}' AS json FROM part""",
    "map_boolean": f"""SELECT p_partkey, {PART}, '{{"id":"' || p_partkey || '","value":' || CASE p_partkey % 5
        WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '"t"' WHEN 3 THEN '"1"' ELSE 'null' END || '}}' AS json FROM part""",
    "map_in_array": f"""SELECT c_custkey, {PART}, CAST(json_object('id', CAST(c_custkey AS VARCHAR), 'orders', coalesce(
        (SELECT to_json(list(json_object('status', lower(o_orderstatus), 'key', o_orderkey) ORDER BY o_orderkey)) FROM orders
          WHERE o_custkey = c_custkey), CAST('[]' AS JSON))) AS VARCHAR) AS json FROM customer""",
    "csv_lines": f"""SELECT conv_id, turn, {PART}, conv_id || ',' || role || ',' || CASE
        WHEN contains(text, ',') OR contains(text, '"') OR contains(text, chr(10)) THEN '"' || replace(text, '"', '""') || '"'
        ELSE text END AS line FROM conversations""",
    "json_envelope": _document(
        '{"schema_version":"2.0","extracted_at":"2026-06-28T06:00:00.0000000+00:00","records":[', "]}"
    ),
    "json_envelope_custom": _document(
        '{"export":{"about":{"owner":"sales","at":"2026-06-28T06:00:00.0000000+00:00"},"customers":[', "]}}"
    ),
    "typed_cells": f"""SELECT o_orderkey, {PART}, 'ordered' AS "column", 'date' AS kind, strftime(o_orderdate, '%Y-%m-%d') AS text,
          CAST(o_orderdate AS DATE) AS date FROM orders
        UNION ALL SELECT o_orderkey, 0, 'status', 'text', o_orderstatus, NULL FROM orders
        UNION ALL SELECT o_orderkey, 0, 'customer', 'text', CAST(o_custkey AS VARCHAR), NULL FROM orders""",
    "row_checksums": """WITH s AS (SELECT p_partkey, sha256(p_partkey || '|' || p_name || '|' || p_brand || '|' || p_type || '|' || p_size) AS h
        FROM part) SELECT p_partkey, h AS sha256, substring(h, 1, 12) AS sha256_short FROM s""",
    "manifest_counts": """SELECT o_orderstatus, count(*) AS record_count, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date
        FROM orders GROUP BY o_orderstatus""",
    "package_file_names": """SELECT o_orderkey, printf('export_%04d_', o_orderkey) || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '.json' AS file_name,
        printf('export_%04d_', o_orderkey) || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '.manifest.json' AS manifest_name FROM orders""",
    "catalog_columns": _catalog(),
    "suggest_joins": f"""WITH c AS ({_catalog()}) SELECT table_name AS related_table, column_name AS join_key, fk_column AS source_join_key
        FROM c WHERE fk_table = 'nation' AND table_name <> 'nation' AND table_name <> 'supplier'""",
    "ledger_runs": f"""WITH {RUNS} SELECT sequence_no, extracted_at, record_count, substring(sha256, 1, 12) AS sha256_short, status,
        data_file_name, status = 'Pending' AND coalesce(extracted < TIMESTAMP '1998-05-31 00:00:00', false) AS is_stale FROM runs""",
    "ledger_next_seq": f"WITH {RUNS} SELECT coalesce(max(sequence_no), 0) + 1 AS next_sequence FROM runs",
    "ledger_gap_warning": f"""WITH {RUNS}, open AS (
          SELECT sequence_no, row_number() OVER (ORDER BY sequence_no) AS place FROM runs WHERE status NOT IN ('Released', 'Skipped')),
        pending AS (SELECT sequence_no, status, count(*) FILTER (WHERE status NOT IN ('Released', 'Skipped'))
          OVER (ORDER BY sequence_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runs),
        told AS (SELECT p.sequence_no, count(*) AS c, string_agg('#' || o.sequence_no, ', ' ORDER BY o.sequence_no DESC) AS t
          FROM pending p JOIN (VALUES (0), (1), (2)) back(n) ON true JOIN open o ON o.place = p.before - back.n
          WHERE p.status = 'Pending' GROUP BY p.sequence_no)
        SELECT p.sequence_no, 'Sequence gap: ' || c || ' earlier run(s) are unresolved (' || t ||
          '). Investigate or skip them before releasing #' || p.sequence_no || '.' AS gap_warning
        FROM pending p LEFT JOIN told ON told.sequence_no = p.sequence_no WHERE p.status = 'Pending'""",
    "ledger_expired": f"""WITH {RUNS} SELECT sequence_no, status, extracted_at FROM runs
        WHERE status <> 'Pending' AND extracted < TIMESTAMP '1997-06-01 00:00:00'""",
    "ledger_retained": f"""WITH {RUNS} SELECT sequence_no, status, extracted_at FROM runs
        WHERE status = 'Pending' OR extracted IS NULL OR extracted >= TIMESTAMP '1997-06-01 00:00:00'""",
    "sequence_gaps": f"""WITH {RUNS} SELECT CAST(k AS BIGINT) AS missing_sequence_no
        FROM range((SELECT min(sequence_no) FROM runs), (SELECT max(sequence_no) FROM runs)) r(k)
        WHERE k NOT IN (SELECT sequence_no FROM runs)""",
    "ledger_release_check": f"""WITH {JUDGED} SELECT request_no, sequence_no, action, coalesce(accepted, false) AS accepted,
        CASE WHEN refusal IS NOT NULL THEN refusal WHEN NOT accepted THEN 'overtaken' END
        AS reason FROM judged""",
    "ledger_after_requests": f"""WITH {JUDGED} SELECT r.sequence_no,
        CASE j.action WHEN 'release' THEN 'Released' WHEN 'skip' THEN 'Skipped' ELSE r.status END AS status,
        CASE WHEN j.action = 'release' THEN j.actor END AS operated_by,
        CASE WHEN j.action = 'release' THEN j.approver END AS approved_by,
        CASE WHEN j.action = 'deliver' THEN j.actor END AS delivered_by,
        CASE WHEN j.action = 'deliver' THEN j.imported_record_count END AS imported_record_count
        FROM runs r LEFT JOIN (SELECT * FROM judged WHERE accepted) j ON j.sequence_no = r.sequence_no""",
    "ledger_request_chain": f"WITH {CHAIN} SELECT request_no, sequence_no, action, accepted, reason FROM chain",
    "ledger_after_chain": f"""WITH {CHAIN} SELECT r.sequence_no, CASE WHEN bool_or(c.action = 'skip') THEN 'Skipped' WHEN bool_or(c.action = 'release') THEN 'Released'
        ELSE any_value(r.status) END AS status, max(c.actor) FILTER (WHERE c.action = 'release') AS operated_by,
        max(c.approver) FILTER (WHERE c.action = 'release') AS approved_by, max(c.actor) FILTER (WHERE c.action = 'deliver') AS delivered_by,
        max(c.imported_record_count) FILTER (WHERE c.action = 'deliver') AS imported_record_count
        FROM runs r LEFT JOIN (SELECT * FROM chain WHERE accepted) c ON c.sequence_no = r.sequence_no GROUP BY r.sequence_no""",
    "audit_latest": """SELECT event_id AS id, 'u' || user_id AS username, event_type AS action, props AS detail
        FROM events ORDER BY event_id DESC LIMIT 100""",
}
