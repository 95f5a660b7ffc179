"""Run queries against their oracles: ``python -m tests.check [sf] [name ..]``."""

from __future__ import annotations

import sys
import time
import traceback

from sessionloom.session import build_session
from tests.oracle import connect, differences


def main() -> int:
    import __spark_entry__ as entry

    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="6g")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf), entry.oracle_sql(), 0
    for name in names:
        begin = time.time()
        try:
            df = entry.queries()[name](spark, sf)
            result = differences(df, con, oracles[name]) if name in oracles else f"no oracle, {df.count()} rows"
        except Exception as error:  # report and go on
            result = f"ERROR {str(error)[:1500]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += bool(result)
        print(f"{'ok  ' if not result else 'DIFF'} {name} {time.time() - begin:.2f}s {result}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
