"""DuckDB SQL for the queries, over the raw test tables; shaped differently from the plans where that is possible."""

from __future__ import annotations

FAMILIES = "['FAN-OUT','FAN-IN','CYCLE','SCATTER-GATHER','GATHER-SCATTER','BIPARTITE','STACK','RANDOM']"

ALL_EVENTS = """ev_all AS (
  SELECT event_id AS tx_id, ts, floor(epoch(ts))::BIGINT AS secs, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS day_idx, user_id AS src_node,
    regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT AS dst_node, value AS amount, event_type AS fmt, round_even(value * 100, 0)::BIGINT AS cents,
    user_id = regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT AS self, (event_type = 'error' AND value >= 20)::INTEGER AS label FROM events)"""
EVENTS = ALL_EVENTS + ", ev AS (SELECT * FROM ev_all WHERE day_idx <= 9)"
TYPOLOGY = f"ty AS (SELECT tx_id, src_node * 4 + (day_idx + 1) // 3 AS attempt_id, ({FAMILIES})[src_node % 8 + 1] AS typology FROM ev WHERE label = 1 AND tx_id % 3 <> 0)"
SCORES = """sc AS (SELECT tx_id, day_idx, src_node, ((tx_id * 7919 + src_node * 104729) % 1000) / 1000.0::DOUBLE AS score, label,
    CASE WHEN day_idx <= 5 THEN 'train' WHEN day_idx = 6 THEN 'val' ELSE 'test' END AS split FROM ev)"""
SALES = """sa AS (
  SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS tx_id, l_shipdate AS ts, epoch(l_shipdate)::BIGINT AS secs,
    date_diff('day', DATE '1995-01-01', l_shipdate::DATE)::INTEGER // 250 AS day_idx, o_custkey AS src_node, l_partkey % (SELECT count(*) FROM customer) AS dst_node,
    l_extendedprice AS paid, l_extendedprice * (1 - l_discount) AS received, round_even(l_extendedprice * 100, 0)::BIGINT AS cents,
    nc.n_regionkey::VARCHAR AS currency_paid, ns.n_regionkey::VARCHAR AS currency_received, o_orderpriority AS fmt, c_nationkey AS src_bank, s_nationkey AS dst_bank,
    (l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity >= 45)::INTEGER AS label, l_orderkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation nc ON c_nationkey = nc.n_nationkey JOIN nation ns ON s_nationkey = ns.n_nationkey)"""
# Snapshots by a range join of days and rows; medians by unit.
EDGES = """med AS (SELECT fmt, median(amount) AS m FROM ev WHERE NOT self GROUP BY fmt HAVING median(amount) > 0),
  gr AS (SELECT ev.*, amount / coalesce(m, 1) AS norm FROM ev LEFT JOIN med USING (fmt) WHERE NOT self),
  days AS (SELECT unnest(range(0, 10))::INTEGER AS d),
  ed AS (SELECT d AS day_idx, src_node AS src, dst_node AS dst, sum(cents)::BIGINT / 100 AS w_amount, sum(norm) AS w_norm, count(*) AS tx_count, max(secs) AS last_ts
    FROM days JOIN gr ON gr.day_idx BETWEEN {first} AND d GROUP BY ALL)"""
GRAPH = f"{EVENTS}, {EDGES.format(first=0)}"
STATS = """st AS (SELECT day_idx, node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, sum(ow) AS out_strength, sum(iw) AS in_strength, sum(ot)::BIGINT AS out_tx, sum(it)::BIGINT AS in_tx FROM (
    SELECT day_idx, src AS node, 1 AS o, 0 AS i, w_norm AS ow, 0.0 AS iw, tx_count AS ot, 0 AS it FROM ed
    UNION ALL SELECT day_idx, dst, 0, 1, 0.0, w_norm, 0, tx_count FROM ed) GROUP BY ALL)"""
PAIRS = "un AS (SELECT day_idx, src AS node, dst AS other FROM ed UNION SELECT day_idx, dst, src FROM ed)"
CURVE = """cu AS (SELECT score, sum(label)::BIGINT AS pos, (count(*) - sum(label))::BIGINT AS neg FROM {rows} GROUP BY score),
  cv AS (SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(pos + neg) OVER () AS n, row_number() OVER w AS place, count(*) OVER () AS steps FROM cu WINDOW w AS (ORDER BY score DESC))"""
BANKS = "bk AS (SELECT src_bank AS bank, src_node AS acct FROM sa UNION SELECT dst_bank, dst_node FROM sa)"
# Annotated rows made from the positives: the natural key, a row number of their own, and one of which a cent was changed.
PATTERNS = """pa AS (SELECT row_number() OVER (ORDER BY tx_id) AS pattern_row, secs, src_node, dst_node, cents + CASE WHEN tx_id % 50 = 1 THEN 1 ELSE 0 END AS cents, fmt AS payment_format, 'USD' AS currency_paid
    FROM ev WHERE label = 1 AND tx_id % 3 <> 0)"""


def state_events(source: str, currency: str, amount: str = "amount") -> str:
    return f"""e AS (SELECT tx_id, secs, 'out' AS dir, src_node AS node, dst_node AS other, {amount} AS amount, cents, {currency} AS cur, fmt FROM {source}
    UNION ALL SELECT tx_id, secs, 'in', dst_node, src_node, {amount}, cents, {currency}, fmt FROM {source})"""


def state(source: str, currency: str, columns: str, amount: str = "amount") -> str:
    """Window frames over both events of each transaction; distinct values by count(DISTINCT) over the frame."""
    return f"""{state_events(source, currency, amount)},
  g AS (SELECT *, CASE WHEN dir = 'out' THEN secs - max(CASE WHEN dir = 'in' THEN secs END) OVER b END AS gap FROM e WINDOW b AS (PARTITION BY node ORDER BY tx_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  s AS (SELECT tx_id, dir, {columns} FROM g WINDOW b AS (PARTITION BY node ORDER BY tx_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def ends(columns: list[str]) -> str:
    return ", ".join(f"max(CASE WHEN dir = '{d}' THEN {c} END) AS {e}_{c}" for c in columns for e, d in (("src", "out"), ("dst", "in")))


def wilson(k: str, n: str) -> tuple[str, str]:
    middle = f"({k} / {n}::DOUBLE + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n})"
    half = f"1.96 * sqrt(({k} / {n}::DOUBLE) * (1 - {k} / {n}::DOUBLE) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n})"
    return f"CASE WHEN {n} > 0 THEN greatest(0.0, {middle} - {half}) END", f"CASE WHEN {n} > 0 THEN least(1.0, {middle} + {half}) END"


def pagerank(rounds: int, n: str = "(SELECT n FROM nn)") -> str:
    """Power iteration, each round a CTE of its own."""
    parts = [
        "nn AS (SELECT max(greatest(src_node, dst_node)) + 1.0::DOUBLE AS n FROM ev)",
        "pn AS (SELECT DISTINCT day_idx, node FROM (SELECT day_idx, src AS node FROM ed UNION SELECT day_idx, dst FROM ed))",
        "po AS (SELECT day_idx, src, sum(w_norm) AS total FROM ed GROUP BY ALL)",
        "ps AS MATERIALIZED (SELECT ed.day_idx, ed.src, ed.dst, w_norm / total AS share FROM ed JOIN po ON ed.day_idx = po.day_idx AND ed.src = po.src)",
        f"r0 AS (SELECT pn.day_idx, node, (po.src IS NULL) AS dangles, 1.0::DOUBLE / {n} AS rank, 1.0::DOUBLE / {n} AS idle FROM pn LEFT JOIN po ON pn.day_idx = po.day_idx AND pn.node = po.src)",
    ]
    for k in range(rounds):
        parts += [
            f"l{k} AS (SELECT day_idx, (sum(CASE WHEN dangles THEN rank ELSE 0 END) + ({n} - count(*)) * min(idle)) / {n} AS lost FROM r{k} GROUP BY day_idx)",
            f"g{k} AS (SELECT ps.day_idx, ps.dst AS node, sum(rank * share) AS got FROM ps JOIN r{k} r ON ps.day_idx = r.day_idx AND ps.src = r.node GROUP BY ALL)",
            f"r{k + 1} AS MATERIALIZED (SELECT r.day_idx, r.node, dangles, 0.15 / {n} + 0.85 * lost + 0.85 * coalesce(got, 0) AS rank, 0.15 / {n} + 0.85 * lost AS idle FROM r{k} r JOIN l{k} USING (day_idx) LEFT JOIN g{k} g ON g.day_idx = r.day_idx AND g.node = r.node)",
        ]
    return ", ".join(parts)
