"""The views of FIXTURES.md as DuckDB common table expressions."""

EV = """ev AS (SELECT event_id AS transaction_id, user_id AS card_id, event_type AS merchant_id,
  value AS amount, ts AS event_time, epoch_us(ts) AS us,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 80 THEN 'FOREIGN' ELSE 'LOCAL' END AS country,
  event_type = 'error' AS is_fraud FROM events)"""

NULLS = EV + """, nulls AS (SELECT * REPLACE (
  CASE WHEN k % 10 <> 0 THEN amount END AS amount,
  CASE WHEN k % 13 <> 0 THEN merchant_id END AS merchant_id) FROM ev)"""

TX = """tx AS (SELECT o_orderkey AS transaction_id, o_custkey AS card_id, o_totalprice AS amount,
  CAST(epoch(o_orderdate) AS BIGINT) AS dt, o_orderpriority AS product_cd,
  CAST(o_orderstatus = 'F' AS INTEGER) AS is_fraud FROM orders)"""

PROF = """prof AS (SELECT c_custkey AS card_id, c_mktsegment AS card4, c_nationkey AS card1,
  c_acctbal AS addr1 FROM customer)"""

SCORED = """scored AS (SELECT l_orderkey AS id, l_linenumber AS line, CAST(l_returnflag = 'R' AS INTEGER) AS y,
  round(l_discount * 10, 6) AS p FROM lineitem)"""

SCORED2 = """scored2 AS (SELECT d.doc_id AS id, l.toxic AS y, least(1.0::DOUBLE, d.n_chars / 20000.0::DOUBLE) AS p_a,
  ((d.doc_id * 7919 + 104729) % 1009) / 1009.0::DOUBLE AS p_b FROM documents d JOIN labels l USING (doc_id))"""

LOG = EV + """, log AS (SELECT CAST(card_id % 6 AS INTEGER) AS partition,
  row_number() OVER (PARTITION BY card_id % 6 ORDER BY transaction_id) - 1 AS "offset",
  transaction_id, card_id, us, amount FROM ev)"""

API_LOG = EV + """, api_log AS (SELECT transaction_id, us, event_time, amount AS latency_ms,
  CASE WHEN k < 85 THEN 200 WHEN k < 95 THEN 422 ELSE 500 END AS status FROM ev)"""

MONEY = "DECIMAL(28,6)"


def odd(view: str) -> str:
    """``view`` with the odd amounts of ``views.odd``, named ``odd``."""
    return f"""odd AS (SELECT * REPLACE (CASE transaction_id % 499 WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 'Infinity'::DOUBLE
  WHEN 3 THEN '-Infinity'::DOUBLE WHEN 4 THEN 1e33 ELSE CASE WHEN transaction_id % 499 % 5 = 0 THEN 1e-7 ELSE amount END END AS amount) FROM {view})"""


def digits(x: str, n: int) -> str:
    """Rounded, unless so large that there are no such digits."""
    return f"CASE WHEN abs({x}) < 1e15 THEN round({x}, {n}) ELSE {x} END"


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "
