"""Command line: build, balance, train --dry-run, baseline, tfidf, blend, moe, collect, cvsummary."""

from __future__ import annotations

import argparse
import json

from strataweave.session import get_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strataweave")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="raw checkout to table")
    b.add_argument("--raw", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--prefix", default="", help="what annotation paths begin with")
    for name, default in (("min-class-files", 20), ("n-folds", 5), ("seed", 42), ("eval-min-files", 0), ("near-dup-group-cap", 300)):
        b.add_argument(f"--{name}", type=int, default=default)
    b.add_argument("--near-dup-threshold", type=float, default=0.8)
    for name in ("keep-project-level", "keep-interfaces", "keep-tests"):
        b.add_argument(f"--{name}", action="store_true")
    s = sub.add_parser("balance", help="all labelled rows and a part of the others")
    s.add_argument("--table", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--safe-ratio", type=float, default=1.0)
    s.add_argument("--seed", type=int, default=42)
    for name in ("train", "baseline", "tfidf", "blend", "moe"):
        t = sub.add_parser(name)
        t.add_argument("--config")
        t.add_argument("--table")
        t.add_argument("--out")
        t.add_argument("--test-fold", type=int)
        t.add_argument("--val-fold", type=int)
        t.add_argument("--seed", type=int)
        if name == "train":
            t.add_argument("--dry-run", action="store_true", help="windows and sample only; models are trained elsewhere")
        if name == "blend":
            t.add_argument("--run-a", required=True)
            t.add_argument("--run-b", required=True)
        if name == "moe":
            t.add_argument("--experts", nargs="+", required=True, help="folders of finished runs")
            for option, kind, default in (("hidden", int, 512), ("epochs", int, 50), ("rate", float, 3e-4), ("batch", int, 64), ("top-k", int, 4), ("even", float, 0.5), ("patience", int, 8)):
                t.add_argument(f"--{option}", type=kind, default=default)
    for name in ("collect", "cvsummary"):
        sub.add_parser(name).add_argument("--outputs", required=True)
    return p


def main(argv: list[str] | None = None) -> None:
    a = vars(parser().parse_args(argv))
    command = a.pop("command")
    if command == "train" and not a.pop("dry_run"):
        raise SystemExit("models are trained elsewhere: use --dry-run for windows and sample")
    spark = get_session()
    from strataweave.plans import build as b
    from strataweave.plans import evaluate as e

    if command == "build":
        print(json.dumps(b.build(spark, **a)["counts"], indent=2))
    elif command == "balance":
        print(json.dumps(b.balance(spark, **a)["counts"], indent=2))
    elif command in ("collect", "cvsummary"):
        print((e.collect if command == "collect" else e.cv_summary)(spark, a["outputs"]))
    else:
        runs = [a.pop(k) for k in ("run_a", "run_b", "experts") if k in a]
        options = {k: a.pop(k) for k in ("hidden", "epochs", "rate", "batch", "top_k", "even", "patience") if k in a}
        config = e.RunConfig.load(a.pop("config"), **a)
        do = {"train": e.dry_run, "baseline": e.baseline, "tfidf": e.tfidf, "blend": e.blend, "moe": e.moe}[command]
        print(json.dumps(do(spark, config, *runs, **options), indent=2, default=str))


if __name__ == "__main__":
    main()
