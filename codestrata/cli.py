"""``python -m codestrata.cli COMMAND --root DIR [--store DIR] …``: the engine's methods on the command line."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .config import Config
from .engine import Engine
from .errors import CodestrataError
from .session import local_session

COMMANDS = "init scan diff status verify explain detect search context task impact history revision-diff clean".split()


def split_list(text: str) -> list[str]:
    """Parts between commas that aren't inside braces."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*out, text[start:]] if p.strip()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codestrata", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("target", nargs="?", default="")
    p.add_argument("--root", default=".")
    p.add_argument("--store")
    p.add_argument("--repo")
    p.add_argument("--include", action="append", default=[])
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--types", default="")
    p.add_argument("--base", default="HEAD")
    p.add_argument("--force", action=argparse.BooleanOptionalAction, default=False)
    p.add_argument("--dry-run", action=argparse.BooleanOptionalAction, default=False)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    repo = a.repo or os.path.basename(os.path.abspath(a.root))
    given = {k: tuple(x for v in getattr(a, k) for x in split_list(v)) for k in ("include", "exclude") if getattr(a, k)}

    def show(df, n: int = 200) -> None:
        """One JSON line a row; more than ``n`` rows are left in the store, and that is said."""
        found = df.limit(n + 1).collect()
        for r in found[:n]:
            print(json.dumps(r.asDict(True), default=str))
        if len(found) > n:
            print(f"the first {n} rows; read the stored tables for all", file=sys.stderr)

    try:
        e = Engine(local_session(), {repo: a.root}, a.store or os.path.join(a.root, ".codestrata"), Config(**given))
        if a.command == "init":
            e.init(a.force)
        elif a.command == "scan":
            report = e.scan(a.dry_run)
            print(json.dumps(report))
            return int(not report["files"])
        elif a.command == "verify":
            return int(not e.verify())
        elif a.command == "clean":
            e.clean()
        elif a.command == "detect":
            found = e.issues.orderBy("rank", "kind", "detail").collect()
            for r in found:
                print(json.dumps(r.asDict(True)))
            return 2 if any(r["severity"] == "error" for r in found) else int(any(r["severity"] == "warning" for r in found))
        elif a.command == "search":
            rows = e.search(a.target, a.limit, split_list(a.types) or None).collect()
            for r in rows:
                print(json.dumps(r.asDict(True)))
            return int(not rows)
        elif a.command in ("explain", "context"):
            parts = e.overview(repo) if a.command == "context" else e.explain(repo, a.target)
            if parts is None:
                return 1
            for name, df in parts.items():
                print(f"## {name}")
                show(df)
        elif a.command in ("task", "impact"):
            print(json.dumps(e.task(repo, a.target) if a.command == "task" else e.impact(repo, a.target)))
        else:
            show({"diff": lambda: e.diff(), "status": lambda: e.status(), "history": lambda: e.module_history(repo, a.target, a.limit), "revision-diff": lambda: e.revision_diff(repo, a.target, a.base)}[a.command]())
    except CodestrataError as err:
        print(f"error: {err}" + (f" ({err.hint})" if err.hint else ""), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
