"""Where queries register with their oracles."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a (spark, sf_dir) function under its name; views name CTEs of VIEW_SQL put before the oracle."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            text = sql.strip()
            if views:
                ctes = ", ".join(f"{v} AS ({VIEW_SQL[v]})" for v in views)
                if text.upper().startswith("WITH RECURSIVE"):
                    text = f"WITH RECURSIVE {ctes}, {text[14:]}"
                elif text.upper().startswith("WITH"):
                    text = f"WITH {ctes}, {text[4:]}"
                else:
                    text = f"WITH {ctes} {text}"
            ORACLE_SQL[f.__name__] = text
        return f

    return register


#: The investigation views over the test tables, as DuckDB SQL.
VIEW_SQL = {
    "v_tx": """SELECT CASE WHEN l_returnflag = 'R' THEN 'S:' || l_suppkey ELSE 'C:' || o_custkey END AS src, CASE WHEN l_returnflag = 'R' THEN 'C:' || o_custkey ELSE 'S:' || l_suppkey END AS dst,
  CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4))) AS amount, l_shipdate AS ts, l_linestatus AS channel, l_orderkey AS order_id, l_linenumber AS line_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_call": """SELECT event_id, event_type AS relation, 'U:' || user_id AS src, 'U:' || nxt AS dst, ts, value FROM
  (SELECT *, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL AND nxt <> user_id""",
    "v_loc": """SELECT 'C:' || c_custkey AS src, 'N:' || c_nationkey AS dst FROM customer UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey FROM supplier UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation""",
    "pairs": """SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM v_call""",
    "adj": """SELECT a AS u, b AS v FROM pairs UNION ALL SELECT b, a FROM pairs""",
    "v_edge": """SELECT 'CALL-' || event_id AS edge_id, src, dst, CASE relation WHEN 'click' THEN 'CALLED' WHEN 'view' THEN 'MET' WHEN 'purchase' THEN 'TRANSFERRED_FUNDS' WHEN 'signup' THEN 'MEMBER_OF' ELSE 'ASSOCIATED_WITH' END AS relation, ts,
  CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 100 AS DOUBLE) / 100 END AS confidence, value FROM v_call UNION ALL SELECT 'LOC-' || src, src, dst, 'LOCATED_AT', NULL, 1.0, NULL FROM v_loc""",
    "v_node": """SELECT 'C:' || c_custkey AS id, c_name AS label, 'PERSON' AS entity_type FROM customer UNION ALL SELECT 'S:' || s_suppkey, s_name, 'ORGANIZATION' FROM supplier UNION ALL SELECT 'N:' || n_nationkey, n_name, 'LOCATION' FROM nation
  UNION ALL SELECT 'R:' || r_regionkey, r_name, 'LOCATION' FROM region UNION ALL SELECT DISTINCT 'U:' || user_id, 'User ' || user_id, 'PERSON' FROM events""",
    "v_member": """SELECT DISTINCT 'U:' || user_id AS node, 'G' || (user_id % 5) AS community, CASE WHEN user_id % 10 = 0 THEN 'boss' ELSE 'soldier' END AS role FROM events""",
    "v_meet": """SELECT 'M-' || strftime(h, '%Y%m%d%H') || '-' || k AS meeting_id, k AS location, h AS ts, list_sort(list(DISTINCT node)) AS attendees FROM
  (SELECT date_trunc('hour', ts) AS h, regexp_extract(props, '"k": ([0-9]+)', 1) AS k, 'U:' || user_id AS node FROM events) GROUP BY h, k HAVING count(DISTINCT node) >= 2""",
    "v_evidence": """SELECT 'E-' || substr(sha256('CALL|CALL-' || event_id), 1, 16) AS evidence_id, 'CALL' AS source_type, 'CALL-' || event_id AS record_id, src || ' made a ' || relation || ' call to ' || dst AS text, ts, [src, dst] AS nodes FROM v_call
  UNION ALL SELECT 'E-' || substr(sha256('CONVERSATION|CONV-' || conv_id || '-' || turn), 1, 16), 'CONVERSATION', 'CONV-' || conv_id || '-' || turn, text, NULL, ['U:' || (conv_id % 150)] FROM conversations""",
}
