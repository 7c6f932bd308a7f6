"""Compare registered queries with their SQL on one data directory.

    python tools/check.py DIRECTORY [name prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from cohortry.catalog import CATALOG  # noqa: E402
from cohortry.session import local_session  # noqa: E402
from tests.compare import connect, difference  # noqa: E402


def main(directory: str, prefixes: list[str]) -> int:
    spark = local_session("check", cores="8")
    connection = connect(directory)
    failures = 0
    for name, item in CATALOG.items():
        if prefixes and not name.startswith(tuple(prefixes)):
            continue
        started = time.perf_counter()
        try:
            result = item.run(spark, directory)
            sql = item.oracle()
            if sql is None:
                problem, note = None, f"{result.count()} rows, no SQL"
            else:
                problem, note = difference(result, connection, sql), "ok"
        except Exception as error:  # report and go on with the next query
            problem, note = f"{type(error).__name__}: {str(error)[:900]}", ""
        failures += problem is not None
        print(f"{name:32s} {time.perf_counter() - started:6.2f}s  {problem or note}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
