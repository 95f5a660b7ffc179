"""SQL pieces shared by the oracles. They restate the derived inputs over the raw tables."""

from __future__ import annotations

from .inputs import DAY, EPSILON, GAMMA, HOUR, LOG_SCALE, PICKS, TRACE_SCALE, TYPES

TAB = "chr(9)"
G = repr(GAMMA)


def draw(key: str, m: str | int, name: str = "", seed: int = 42) -> str:
    digest = f"substr(md5(CAST({key} AS VARCHAR) || ':{seed}{name}'), 1, 8)"
    return f"(CAST('0x' || {digest} AS BIGINT) % {m})"


def tick(seconds: int, ts: str = "ts") -> str:
    return f"(epoch_us({ts}) // {seconds * 1_000_000})"


GROUP = "CAST(user_id % 8 AS VARCHAR)"
COST = "CAST(value AS DECIMAL(18,2))"
COST_TEXT = f"CAST({COST} AS VARCHAR)"
TYPE_LIST = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
CANDIDATES = f"list_filter({TYPE_LIST}, lambda x, i: i - 1 <> {draw('event_id', 5, 'candidates')})"
UPDATE = f"(event_type || {TAB} || {COST_TEXT})"


def features(millis: str) -> str:
    parts = [
        f"CAST({millis} AS VARCHAR)", "'0.1'", "'1200'", "'2.5'", GROUP, "CAST(user_id % 5 AS VARCHAR)", "'us'",
        "'wifi'", "'ok'", "CAST(event_id % 3 AS VARCHAR)", "'vod'", "'obj'", "'html5'", "'800'", "'cdn'",
    ]
    return "[" + ", ".join(parts) + "]"


FEATURES = features("epoch_us(ts) // 1000")
RECORD = f"(array_to_string({FEATURES}, {TAB}) || {TAB} || {UPDATE})"
MESSAGE = f"""('{{"update":"' || event_type || '\\t' || {COST_TEXT} || '","group_id":"' || {GROUP} || '"}}')"""

UPDATES = f"""
u AS (SELECT event_id, ts, {GROUP} AS group_id, event_type AS decision, {COST} AS cost,
             {tick(DAY)} AS day, {tick(HOUR)} AS hour FROM events)
"""

# Decayed state at the last day.
LATEST = f"""
{UPDATES},
last_day AS (SELECT max(day) AS t FROM u),
st AS (SELECT group_id, decision, max(t) AS b, sum(CAST(-cost AS DOUBLE) * pow({G}, t - day)) AS s,
              sum(pow({G}, t - day)) AS n
       FROM u, last_day GROUP BY group_id, decision)
"""


def rounds(source: str, keys: str, k: int, gamma: str = G, scale: float = 1000.0) -> str:
    """A recursive table ``rounds`` with the pick of each round, and ``picked`` with the lists."""
    score = (
        f"CASE WHEN n > 0 THEN m + (CASE WHEN nt > 1 THEN {scale} * sqrt(2 * ln(nt)) ELSE 0 END) / sqrt(n) ELSE 0 END"
    )
    part = f"PARTITION BY {keys}"
    return f"""
arms AS (SELECT {keys}, decision AS d, CASE WHEN n > 0 THEN s / n ELSE 0 END AS m, CAST(n AS DOUBLE) AS n,
                CAST(sum(floor(n)) OVER ({part}) AS DOUBLE) AS nt FROM {source}),
rounds AS (
    SELECT 0 AS r, {keys}, d, m, n, nt, CAST(NULL AS VARCHAR) AS pick FROM arms
    UNION ALL
    SELECT r + 1, {keys}, d, m, (n + CASE WHEN d = p THEN 1 ELSE 0 END) * {gamma}, nt + 1, p
    FROM (SELECT *, first_value(d) OVER ({part} ORDER BY {score} DESC, d) AS p FROM rounds WHERE r < {k})
),
picked AS (SELECT {keys}, list(pick ORDER BY r) AS picks
           FROM (SELECT DISTINCT r, {keys}, pick FROM rounds WHERE r > 0) GROUP BY {keys})
"""


PICKED = f"{LATEST}, {rounds('st', 'group_id', PICKS)}"

# Best decision of each group over everything.
BEST = f"""
{UPDATES},
totals AS (SELECT group_id, decision, CAST(sum(-cost) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS m FROM u GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY m DESC, decision) AS place FROM totals),
best AS (SELECT group_id, max(CASE WHEN place = 1 THEN decision END) AS best,
                list(decision ORDER BY decision) FILTER (WHERE place > 1) AS others, {EPSILON} AS epsilon
         FROM ranked GROUP BY group_id)
"""

SESSIONS = f"""
sess AS (SELECT event_id, CAST(user_id % 9 AS VARCHAR) AS group_id, {CANDIDATES} AS cands,
                (user_id % 5 <> 4) AS matched FROM events)
"""
FALLBACK = f"cands[1 + {draw('event_id', 'len(cands)', 'fallback')}]"


def trace_cost(i: int) -> str:
    return f"CAST({COST} * (10 + (event_id + {i}) % 5) / 10 AS DECIMAL(18,3))"


TRACE_MS = f"(epoch_us(ts) // 1000 // {TRACE_SCALE})"
SERVED = f"(CASE WHEN {draw('event_id', 50, 'served')} = 0 THEN 'none' ELSE event_type END)"
CHOSEN = "CASE decision " + " ".join(f"WHEN '{t}' THEN {trace_cost(i)}" for i, t in enumerate(TYPES)) + " END"
TRACE = f"""
t0 AS (SELECT event_id AS line_no, {TRACE_MS} // 1000 AS sec, {GROUP} AS group_id, {SERVED} AS decision, value,
              event_id, {draw('event_id', 20, 'answered')} <> 0 AS answered FROM events),
tr AS (SELECT *, {CHOSEN} AS cost, decision <> 'none' AS valid,
              (sec - (SELECT min(sec) FROM t0)) // 60 AS minute FROM t0)
"""

LOG = f"""
lg AS (SELECT event_id AS id, CAST(user_id % 16 AS VARCHAR) AS worker, epoch_us(ts) // {LOG_SCALE} AS sent_us,
              CAST(round(value * 1000) AS BIGINT) AS rt_us, event_type <> 'error' AS ok FROM events),
lr AS (SELECT *, sent_us + rt_us AS recv_us FROM lg WHERE ok)
"""
