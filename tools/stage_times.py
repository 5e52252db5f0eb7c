"""Summarise a Spark event log: wall time and task time per stage call site.

    BENCH_EVENTLOG=1 python bench.py          # writes the log to a fresh /tmp/run-events-* folder
    python tools/stage_times.py /tmp/run-events-XXXX [top]

Reads ``SparkListenerStageCompleted`` events (JSON lines) and groups stages by
the user call site Spark records for them.
"""

from __future__ import annotations

import collections
import glob
import json
import os
import sys


def _lines(f: str):
    """Lines of one event-log file (plain, or zstd-compressed by Spark)."""
    if f.endswith(".zstd"):
        import io

        import zstandard
        with open(f, "rb") as fh:
            reader = zstandard.ZstdDecompressor().stream_reader(fh)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
        return
    with open(f, encoding="utf-8") as fh:
        yield from fh


def stages(path: str):
    files = [path] if os.path.isfile(path) else sorted(
        f for f in glob.glob(os.path.join(path, "**", "*"), recursive=True) if os.path.isfile(f))
    for f in files:
        for line in _lines(f):
            if '"SparkListenerStageCompleted"' not in line:
                continue
            info = json.loads(line)["Stage Info"]
            start, end = info.get("Submission Time"), info.get("Completion Time")
            if start is None or end is None:
                continue
            task_ms = sum(int(a.get("Value", 0)) for a in info.get("Accumulables", [])
                          if a.get("Name") == "internal.metrics.executorRunTime")
            yield info["Stage Name"], end - start, task_ms, info.get("Number of Tasks", 0)


def main(argv):
    top = int(argv[2]) if len(argv) > 2 else 15
    agg = collections.defaultdict(lambda: [0, 0, 0, 0])
    for name, wall, task, ntasks in stages(argv[1]):
        a = agg[name]
        a[0] += 1
        a[1] += wall
        a[2] += task
        a[3] += ntasks
    total = sum(a[1] for a in agg.values())
    print(f"{'stages':>6} {'wall s':>8} {'task s':>8} {'tasks':>6}  call site   (total wall {total / 1000:.1f} s)")
    for name, (n, wall, task, ntasks) in sorted(agg.items(), key=lambda kv: -kv[1][1])[:top]:
        print(f"{n:>6} {wall / 1000:>8.2f} {task / 1000:>8.2f} {ntasks:>6}  {name}")


if __name__ == "__main__":
    main(sys.argv)
