"""Compare registered queries with their oracles: ``python check.py [--sf DIR] [names or family modules]``."""

from __future__ import annotations

import importlib
import sys
import time
import traceback

from plumbline.plans import registry
from plumbline.plans.compare import compare, oracle_connection
from plumbline.session import local_session


def main(argv: list[str]) -> int:
    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    fams = [a for a in argv if a in registry.FAMILIES]
    names = [a for a in argv if a not in registry.FAMILIES]
    if fams and not names:
        for f in fams:
            importlib.import_module(f"plumbline.plans.{f}")
        mods = {f"plumbline.plans.{f}" for f in fams}
        build, sqls = {n: fn for n, fn in registry._BUILDERS.items() if fn.__module__ in mods}, dict(registry._ORACLES)
        build = {n: (lambda s, d, fn=fn: fn(registry.Tables(s, d))) for n, fn in build.items()}
    else:
        build, sqls = registry.builders(), registry.oracles()
    names = names or list(build)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = build[n](spark, sf)
            if n in sqls:
                ok, why, rows = compare(df, sqls[n], con)
            else:
                rows = df.count()
                ok, why = True, "(rows only)"
        except Exception as e:  # report and go on with the other queries
            ok, why, rows = False, "".join(traceback.format_exception_only(e))[:900], -1
        bad += not ok
        flag = "" if rows else "  <-- NO ROWS"
        print(f"{'ok  ' if ok else 'FAIL'} {n:24s} rows={rows:<7d} {time.time() - t0:5.1f}s {why}{flag}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
