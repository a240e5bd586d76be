"""``python -m tidemark run|status|reset FILE``: operate the models that a Python file defines."""

from __future__ import annotations

import argparse
import importlib.util
import sys
import time
import uuid
from pathlib import Path

from tidemark.streaming.pipeline import Model, Session
from tidemark.version import __version__


def sessions_of(path: str) -> list[Session]:
    if not Path(path).is_file():
        raise SystemExit(f"there is no file {path}")
    spec = importlib.util.spec_from_file_location(f"tidemark_user_{uuid.uuid4().hex}", path)
    module = importlib.util.module_from_spec(spec)
    sys.modules[spec.name] = module
    spec.loader.exec_module(module)
    found = list({id(v): v for v in vars(module).values() if isinstance(v, Session)}.values())
    if not found:
        raise SystemExit(f"{path} makes no session; call tidemark.connect(...) in it")
    return found


def models_of(path: str) -> dict[str, Model]:
    out: dict[str, Model] = {}
    for s in sessions_of(path):
        for m in s.ordered():
            out.setdefault(m.name, m)
    return out


def shown(position: int | None) -> str:
    return "earliest" if position is None or position < 0 else str(position)


def _unknown(name: str, models: dict[str, Model]) -> int:
    print(f"no model {name!r}; there are: {', '.join(models) or 'none'}", file=sys.stderr)
    return 2


def run(args) -> int:
    models = models_of(args.file)
    if args.model and args.model not in models:
        return _unknown(args.model, models)
    chosen = [models[args.model]] if args.model else list(models.values())
    if not chosen:
        print(f"{args.file} has no models", file=sys.stderr)
        return 2
    once = args.once and not args.loop
    if once or len(chosen) == 1:
        for m in chosen:
            print(f"running {m.name} ({'once' if once else 'loop'})", flush=True)
            print(f"{m.name}: {m.run(once=once)} rows")
        return 0
    for m in chosen:
        print(f"running {m.name} (loop)", flush=True)
    while True:  # all models in turn, so that each gets what the ones before it made
        if not sum(m.step() for m in chosen):
            time.sleep(1.0)


def status(args) -> int:
    models = models_of(args.file)
    if not models:
        print("no models")
        return 0
    rows = [("model", "source", "sink", "position", "lag")]
    rows += [(m.name, m.source, m.sink, shown(m.position()), str(m.lag())) for m in models.values()]
    widths = [max(len(r[i]) for r in rows) for i in range(5)]
    rows.insert(1, tuple("-" * w for w in widths))
    for r in rows:
        print("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip())
    return 0


def reset(args) -> int:
    models = models_of(args.file)
    if args.model not in models:
        return _unknown(args.model, models)
    consumer = models[args.model].pipeline.consumer
    before = consumer.position()
    if args.to == "earliest":
        consumer.reset()
    elif args.to == "latest":
        consumer.seek(consumer.source.latest_offset())
    else:
        try:
            consumer.seek(int(args.to))
        except ValueError:
            raise SystemExit(f"--to is earliest, latest or an offset, not {args.to!r}") from None
    consumer.save()
    print(f"{args.model}: position {shown(before)} -> {shown(consumer.position())}")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description="Operate incremental pipelines.")
    parser.add_argument("--version", action="version", version=f"tidemark {__version__}")
    commands = parser.add_subparsers(dest="command", metavar="command")
    one = commands.add_parser("run", help="run a file's models")
    one.add_argument("file")
    one.add_argument("--model", help="this one only")
    one.add_argument("--once", action="store_true", help="one batch each, then end")
    one.add_argument("--loop", action="store_true", help="go on until stopped (the default; wins over --once)")
    one.set_defaults(do=run)
    two = commands.add_parser("status", help="positions and lags of a file's models")
    two.add_argument("file")
    two.set_defaults(do=status)
    three = commands.add_parser("reset", help="move a model's stored position")
    three.add_argument("file")
    three.add_argument("--model", required=True)
    three.add_argument("--to", default="earliest", help="earliest, latest or an offset")
    three.set_defaults(do=reset)
    args = parser.parse_args(argv)
    if not args.command:
        parser.print_help()
        return 0
    return args.do(args)


if __name__ == "__main__":
    sys.exit(main())
