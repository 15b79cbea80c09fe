"""python -m parley DATA index PATH | build | search TEXT | related ID | chunk ID | stats | watch PATH | start PATH | stop | status"""

from __future__ import annotations

import argparse
import os
import signal
import subprocess
import sys
from pathlib import Path

from parley.engine import Engine
from parley.operators import lookups
from parley.session import session


def running(data: str) -> int | None:
    """The process that watches for this data folder."""
    note = Path(data, "watch.pid")
    try:
        pid = int(note.read_text())
        os.kill(pid, 0)
    except (OSError, ValueError):
        return None
    return pid


def start(data: str, path: str) -> int:
    """Watches in a process of its own; its number is noted in the data folder."""
    if pid := running(data):
        return pid
    Path(data).mkdir(parents=True, exist_ok=True)
    with Path(data, "watch.log").open("a") as log:
        child = subprocess.Popen([sys.executable, "-m", "parley", data, "watch", path], stdout=log, stderr=log, start_new_session=True)
    Path(data, "watch.pid").write_text(str(child.pid))
    return child.pid


def stop(data: str) -> bool:
    """Ends the process that watches; false if there is none."""
    pid = running(data)
    if pid:
        os.kill(pid, signal.SIGTERM)
    Path(data, "watch.pid").unlink(missing_ok=True)
    return pid is not None


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="parley", description=__doc__)
    p.add_argument("data")
    p.add_argument("command", choices=["index", "build", "search", "related", "chunk", "stats", "watch", "start", "stop", "status"])
    p.add_argument("what", nargs="?")
    for name in ("project", "session", "after", "before"):
        p.add_argument(f"--{name}")
    p.add_argument("--has-code", action="store_true")
    p.add_argument("--same-session", action="store_true")
    p.add_argument("--fast", action="store_true", help="stats by the manifest's sketches")
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--json", action="store_true")
    p.add_argument("--index-type", default="flat")
    p.add_argument("--force", action="store_true")
    p.add_argument("--full", action="store_true")
    a = p.parse_args(arguments)
    if a.command == "start":
        print(f"watching, process {start(a.data, a.what)}")
        return 0
    if a.command in ("stop", "status"):
        print(("stopped" if stop(a.data) else "not watching") if a.command == "stop" else f"watching, process {pid}" if (pid := running(a.data)) else "not watching")
        return 0
    try:
        engine = Engine(session(), a.data, index_type=a.index_type)
        if a.command == "build":
            engine.build_index()
        elif a.command == "index":
            run = engine.index(a.what, a.force)
            print(run, *run.first_errors(), sep="\n")
        elif a.command == "watch":
            engine.watch(a.what).awaitTermination()
        elif a.command == "stats":
            print(engine.stats(exact=False) if a.fast else engine.status())
        else:
            found = engine.chunk(a.what) if a.command == "chunk" else engine.related(a.what, a.top_k, a.same_session) if a.command == "related" else engine.semantic_search(a.what, a.top_k, project=a.project, has_code=a.has_code, session=a.session, after=a.after, before=a.before)
            if "similarity" not in found.columns:
                found = found.selectExpr("*", "1.0D AS similarity")
            print(lookups.json_document(found).first().json if a.json else "\n".join(f"{r.id} {r.similarity}\n{r.body}" for r in lookups.text_lines(found, a.full).collect()))
    except (KeyError, ValueError) as e:  # no such chunk, a date that is none
        print(e.args[0], file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
