"""Queries of load-test logs and message streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import responses
from . import inputs as I
from . import oracle_parts as P
from .catalog import query

HEAD = """hd AS (SELECT worker, count(*) AS sent, max(sent_us) - min(sent_us) AS span_us FROM lg GROUP BY worker)"""


def _summary(by: str) -> str:
    keys = f"{by} AS run, " if by else ""
    tail = "GROUP BY 1" if by else ""
    link = "USING (run)" if by else "ON true"
    return f"""
{P.LOG}, {HEAD},
a AS (SELECT {keys}sum(sent) AS sent, CAST(sum(span_us) AS DOUBLE) / 1000000 / count(*) AS mean_seconds FROM hd {tail}),
c AS (SELECT {keys}count(*) AS succeeded, CAST(sum(rt_us) AS DOUBLE) / 1000000 / count(*) AS mean_rt FROM lr {tail}),
sm AS (SELECT {'run, ' if by else ''}CAST(sent AS BIGINT) AS sent, succeeded, CAST(sent - succeeded AS BIGINT) AS failed,
              mean_seconds, mean_rt, CAST(sent AS DOUBLE) / mean_seconds AS rate FROM a LEFT JOIN c {link})
"""


@query("response_summary", f"WITH {_summary('')} SELECT * FROM sm")
def response_summary(spark, sf):
    return responses.response_summary(I.response_headers(spark, sf), I.response_rows(spark, sf))


RUN = "CAST(worker AS INTEGER) % 4"


@query("response_summary_runs", f"WITH {_summary(RUN)} SELECT * FROM sm")
def response_summary_runs(spark, sf):
    """The summary of each of four runs."""
    headers = I.response_headers(spark, sf).withColumn("run", I.run_of())
    rows = I.response_rows(spark, sf).withColumn("run", I.run_of())
    return responses.response_summary(headers, rows, ["run"])


@query(
    "response_mean_of_runs",
    f"""WITH {_summary(RUN)} SELECT count(*) AS runs, round(avg(rate), 6) AS mean_rate, round(avg(mean_rt), 9) AS mean_rt FROM sm""",
)
def response_mean_of_runs(spark, sf):
    means = responses.mean_of_runs(response_summary_runs(spark, sf))
    return means.select("runs", F.round("mean_rate", 6).alias("mean_rate"), F.round("mean_rt", 9).alias("mean_rt"))


def _by(time: str) -> str:
    # Mean in milliseconds, half up, by whole microseconds.
    return f"""WITH {P.LOG},
    z AS (SELECT {time}_us - (SELECT min(sent_us) FROM lr) AS d, rt_us FROM lr),
    y AS (SELECT greatest(CAST(ceil(d / 1000000.0) AS BIGINT) - 1, 0) AS second, rt_us FROM z),
    g AS (SELECT second, count(*) AS n, sum(rt_us) AS us FROM y GROUP BY second),
    spine AS (SELECT unnest(range(0, (SELECT CAST(ceil(max(d) / 1000000.0) AS BIGINT) + 1 FROM z))) AS second)
    SELECT second, CAST(coalesce((2 * us + 1000 * n) // (2000 * n), 0) AS DOUBLE) AS mean_rt, coalesce(n, 0) AS succeeded
    FROM spine LEFT JOIN g USING (second)"""


@query("response_by_sent", _by("sent"))
def response_by_sent(spark, sf):
    return responses.response_by(I.response_rows(spark, sf), "sent")


@query("response_by_received", _by("recv"))
def response_by_received(spark, sf):
    return responses.response_by(I.response_rows(spark, sf), "recv")


@query(
    "response_cdf",
    f"""WITH {P.LOG}, o AS (SELECT rt_us, row_number() OVER (ORDER BY rt_us, worker, id) AS i, count(*) OVER () AS n FROM lr)
    SELECT i, rt_us / 1000.0 AS rt, (i - 1) / CAST(n AS DOUBLE) AS share FROM o""",
)
def response_cdf(spark, sf):
    return responses.response_cdf(I.response_rows(spark, sf))


@query(
    "response_p90",
    f"""WITH {P.LOG}, o AS (SELECT rt_us, row_number() OVER (ORDER BY rt_us) AS i, count(*) OVER () AS n FROM lr)
    SELECT rt_us / 1000.0 AS rt FROM o WHERE i = CAST(floor(0.9 * n) AS BIGINT) + 1""",
)
def response_p90(spark, sf):
    return responses.response_quantile(I.response_rows(spark, sf))


@query(
    "interarrival_avg_10",
    """WITH g AS (SELECT epoch_us(ts) AS t, row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
    d AS (SELECT i, t - lag(t) OVER (ORDER BY i) AS gap FROM g),
    k AS (SELECT (i - 2) // 10 AS block, gap FROM d WHERE i > 1)
    SELECT block, CAST(sum(gap) AS DOUBLE) / 10000000 AS mean_gap FROM k GROUP BY block HAVING count(*) = 10""",
)
def interarrival_avg_10(spark, sf):
    return responses.interarrival(I.events(spark, sf).select("event_id", "ts"))


@query(
    "message_gaps",
    """WITH g AS (SELECT event_id, epoch_us(ts) AS t, row_number() OVER (ORDER BY ts, event_id) AS i FROM events)
    SELECT event_id, i, (t - lag(t) OVER (ORDER BY i)) / 1000000.0 AS gap FROM g""",
)
def message_gaps(spark, sf):
    return responses.message_gaps(I.events(spark, sf).select("event_id", "ts")).select("event_id", "i", "gap")


@query(
    "throughput_blocks",
    """WITH g AS (SELECT epoch_us(ts) AS t, row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
    m AS (SELECT i // 100 AS block, t FROM g WHERE i % 100 = 0)
    SELECT block, block * 100 AS total, (t - coalesce(lag(t) OVER (ORDER BY block), (SELECT min(t) FROM g))) / 1000000.0 AS seconds FROM m""",
)
def throughput_blocks(spark, sf):
    return responses.throughput_blocks(I.events(spark, sf).select("event_id", "ts"), 100)
