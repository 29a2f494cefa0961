"""python -m tidepool: the engine from the command line."""

from __future__ import annotations

import argparse
import json


def session(name: str):
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def queries(_) -> None:
    from .plans import catalog, recordings  # noqa: F401

    for name in sorted(catalog.QUERIES):
        print(name, "" if name in catalog.ORACLES else "(no SQL twin)")


def run(args) -> None:
    from .plans import catalog, recordings  # noqa: F401

    result = catalog.QUERIES[args.query](session(args.query), args.tables)
    if args.out:
        result.write.mode("error").parquet(args.out)
    else:
        result.show(args.rows, truncate=False)


def ledger(args) -> None:
    """Rows of a stored event ledger (row_id, sample_index, channel_index, amplitude_uv, snr)."""
    from .operators import ledger as L

    found = L.query(session("ledger").read.parquet(args.ledger), args.snr, saved_floor=args.saved_floor, time=(args.start, args.stop), channels=args.channels, polarity=args.polarity)
    if args.out:
        found.write.mode("error").parquet(args.out)
    else:
        print(json.dumps({"rows": found.count()}))


def quality(args) -> None:
    """Which found unit stands for which true one, from times and labels (t, label)."""
    from .operators import quality as Q

    spark = session("quality")
    Q.unit_assignment(spark.read.parquet(args.truth), spark.read.parquet(args.found), args.tolerance).show(args.rows, truncate=False)


def lfp(args) -> None:
    from .sources.lfp import export_lfp

    done = export_lfp(session("lfp"), args.recording, args.out, args.channels, args.rate, args.out_rate, args.passband, resume=args.resume)
    print(json.dumps(done))


def inspect(args) -> None:
    """The manifest of a stored ledger, after a check of its rows."""
    from .sources.ledger_store import Ledger

    found = Ledger(session("inspect"), args.ledger)
    found.verify()
    print(json.dumps({k: v for k, v in found.manifest.items() if k != "blocks"} | {"blocks": len(found.manifest["blocks"])}))


def export(args) -> None:
    """Rows of a stored ledger, with waveforms if asked for, into a new folder."""
    from .sources.ledger_store import Ledger

    found = Ledger(session("export"), args.ledger)
    ask = found.fetch if args.waveforms else found.query
    ask(args.snr, start=args.start, stop=args.stop, channels=args.channels, polarity=args.polarity).write.mode("error").parquet(args.out)


def sample(args) -> None:
    """A stratified and a uniform sample of a stored ledger; channels is a table (channel_index, x, y, shank)."""
    from .operators.sampling import sample_ledger
    from .sources import files
    from .sources.ledger_store import Ledger

    spark = session("sample")
    found = Ledger(spark, args.ledger)
    m = found.manifest
    chosen, even, told = sample_ledger(found.events(), spark.read.parquet(args.channels), args.budget, args.seed, m["start_sample"], m["stop_sample"], args.time_bins, args.depth_bin, args.least)
    chosen.write.mode("error").parquet(f"{args.out}/stratified")
    even.write.mode("error").parquet(f"{args.out}/uniform")
    files.write_text(spark, f"{args.out}/manifest.json", json.dumps(told | {"ledger": args.ledger}))
    print(json.dumps(told))


def stream_sort(args) -> None:
    """Assigns events (row_id, t, channel, contacts, w) to rolling templates (unit, anchor, contacts, w); goes on where a run before stopped."""
    from .sources import files
    from .streaming import assignment

    spark = session("stream-sort")
    if files.exists(spark, f"{args.out}/templates/state.json"):
        templates = assignment.RollingTemplates(spark, f"{args.out}/templates")
    else:
        templates = assignment.RollingTemplates.begin(spark, f"{args.out}/templates", spark.read.parquet(args.templates), args.frame, args.bin, args.window)
    events = spark.read.parquet(args.events).where(f"t >= {templates.meta['through']}")
    done = assignment.sort_epochs(events, templates, f"{args.out}/assigned", spark.read.parquet(args.patches), args.length, args.most)
    print(json.dumps({"epochs": done} | templates.meta))


def score(args) -> None:
    """Counts and rates of a sorting against ground truth, both (t, label)."""
    from .operators.report import score_sorting

    spark = session("score")
    print(score_sorting(spark.read.parquet(args.truth), spark.read.parquet(args.found), args.tolerance, args.collision).toJSON().first())


def suite(args) -> int:
    """The gate over a suite: a JSON list of cases (name, kind, truth, session, baseline, tolerance); exit code 2 if it isn't passed."""
    from .operators.report import score_sorting, suite_gate
    from .sources import files

    spark = session("suite")
    rows = None
    for case in json.loads(files.read_text(spark, args.cases)):
        for route in ("session", "baseline"):
            row = score_sorting(*(spark.read.parquet(case[k]) for k in ("truth", route)), case["tolerance"]).selectExpr(f"'{case['name']}' as name", f"'{case['kind']}' as kind", f"'{route}' as route", "*")
            rows = row if rows is None else rows.unionByName(row)
    told = suite_gate(rows).first().asDict()
    print(json.dumps(told))
    return 0 if told["passed"] else 2


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidepool")
    kinds = top.add_subparsers(required=True)

    def kind(f, *positional: str) -> argparse.ArgumentParser:
        p = kinds.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        p.set_defaults(run=f)
        for name in positional:
            p.add_argument(name)
        return p

    kind(queries)
    p = kind(run, "query", "tables")
    p.add_argument("--out")
    p.add_argument("--rows", type=int, default=20)
    p = kind(ledger, "ledger")
    p.add_argument("--snr", type=float, required=True)
    p.add_argument("--saved-floor", type=float, default=0.0)
    p.add_argument("--start", type=int)
    p.add_argument("--stop", type=int)
    p.add_argument("--channels", type=int, nargs="+")
    p.add_argument("--polarity", choices=["both", "neg", "pos"], default="both")
    p.add_argument("--out")
    kind(inspect, "ledger")
    p = kind(export, "ledger", "out")
    p.add_argument("--snr", type=float, required=True)
    p.add_argument("--start", type=int)
    p.add_argument("--stop", type=int)
    p.add_argument("--channels", type=int, nargs="+")
    p.add_argument("--polarity", choices=["both", "neg", "pos"], default="both")
    p.add_argument("--waveforms", action="store_true")
    p = kind(sample, "ledger", "channels", "out")
    for name, default in (("--budget", 30000), ("--seed", 0), ("--time-bins", 30), ("--least", 4)):
        p.add_argument(name, type=int, default=default)
    p.add_argument("--depth-bin", type=float, default=80.0)
    p = kind(stream_sort, "events", "templates", "patches", "out")
    p.add_argument("--frame", default="probe")
    for name, default in (("--bin", 6_000_000), ("--window", 6), ("--length", 61), ("--most", 4096)):
        p.add_argument(name, type=int, default=default)
    p = kind(score, "truth", "found")
    p.add_argument("--tolerance", type=int, required=True)
    p.add_argument("--collision", type=int)
    kind(suite, "cases")
    p = kind(quality, "truth", "found")
    p.add_argument("--tolerance", type=int, required=True)
    p.add_argument("--rows", type=int, default=1000)
    p = kind(lfp, "recording", "out")
    p.add_argument("--channels", type=int, required=True)
    p.add_argument("--rate", type=int, required=True)
    p.add_argument("--out-rate", type=int, default=1250)
    p.add_argument("--passband", type=float, default=500.0)
    p.add_argument("--resume", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args) or 0


if __name__ == "__main__":
    raise SystemExit(main())
