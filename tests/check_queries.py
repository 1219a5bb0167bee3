"""Run registered queries against their oracles: ``python tests/check_queries.py sf0.01 A1 G``."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.oracle import compare, connect
from tidemark.catalog import ORACLES, QUERIES
from tidemark.session import local_session


def main(scale: str, prefixes: list[str]) -> int:
    folder = f"/root/testdata/{scale}"
    spark, connection = local_session("8"), connect(folder)
    bad = 0
    for name, function in QUERIES.items():
        if prefixes and not any(name == p or name.startswith(p + "_") or (p.endswith("*") and name.startswith(p[:-1])) for p in prefixes):
            continue
        began, alone = time.time(), -1.0
        try:
            frame = function(spark, folder)
            frame.write.format("noop").mode("overwrite").save()
            alone = time.time() - began
            if name in ORACLES:
                problems = compare(frame, connection, ORACLES[name])
                verdict = "ok" if not problems else "DIFFERS " + "\n   ".join(problems)
            else:
                verdict = f"rows {frame.count()}"
        except Exception:
            verdict = "FAILED " + traceback.format_exc()[-1800:]
        bad += not (verdict == "ok" or verdict.startswith("rows"))
        print(f"{name:34s} {alone:6.2f}s {time.time() - began:6.2f}s {verdict}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(min(main(sys.argv[1], sys.argv[2:]), 1))
