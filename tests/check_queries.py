"""Command line: ``python -m tests.check_queries SF_DIR [name prefix ...]`` compares queries with their SQL twins."""

import sys
import time
import traceback

import __spark_entry__ as entry
from loomgraph.session import build_session
from tests.harness import compare, connect


def main() -> int:
    import faulthandler
    faulthandler.dump_traceback_later(600, exit=True)
    sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark, con = build_session("check"), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                ok, msg = compare(df, con, oracles[name])
            else:
                n = len(df.collect())
                ok, msg = True, f"{n} rows, no SQL"
        except Exception as e:  # report and go on with the next query
            ok, msg = False, "".join(traceback.format_exception_only(e))[:1500]
        if not ok:
            bad.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {msg}", flush=True)
    print(f"{len(bad)} failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
