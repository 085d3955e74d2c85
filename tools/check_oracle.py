"""Run every named query against its SQL: ``python tools/check_oracle.py [folder] [query ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from outage_spark.plans.catalog import QUERIES  # noqa: E402
from outage_spark.plans.oracles import ORACLES  # noqa: E402
from outage_spark.session import build_session  # noqa: E402
from tests.compare import assert_same, connect  # noqa: E402


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions=8, spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        started = time.time()
        try:
            df = QUERIES[name](spark, folder)
            n = assert_same(df, con, ORACLES[name]) if name in ORACLES else df.count()
            note = "same" if name in ORACLES else "rows only"
        except Exception as problem:
            bad, n, note = bad + 1, -1, f"FAILED {str(problem)[:700]}"
        print(f"{name:28s} {n:8d} {time.time() - started:6.2f}s {note}", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")


if __name__ == "__main__":
    main()
