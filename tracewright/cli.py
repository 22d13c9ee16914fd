"""Command line: check and validate files of traces, train on labelled ones, and print a report of recorded predictions.

Exit codes: 0, or 1 if a verdict of --fail-on occurred, or 2 for a usage error, an invalid line or no valid trace.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracewright.functions.scores import Thresholds
from tracewright.operators import assembly as evaluation_report
from tracewright.operators import claims as claim_ops
from tracewright.operators import detectors, training
from tracewright.operators import steps as step_ops
from tracewright.sources import artifacts
from tracewright.sources.packs import builtin_packs, load_pack
from tracewright.sources.recorded import RunFolder
from tracewright.sources.traces import TraceLineError, dump, load_traces

VERDICTS = ("verified", "false_success", "unverifiable", "skipped")


def check(spark: SparkSession, args: argparse.Namespace) -> int:
    fail_on = {v.strip() for v in args.fail_on.split(",") if v.strip()}
    if fail_on - set(VERDICTS):
        print(f"error: unknown verdicts: {', '.join(sorted(fail_on - set(VERDICTS)))}", file=sys.stderr)
        return 2
    try:
        loaded = load_traces(spark, args.path, args.strict)
    except TraceLineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    packs = builtin_packs() + [load_pack(p) for p in args.rules]
    traces, steps = loaded.traces(), loaded.steps()
    found = claim_ops.resolve_claims(loaded.claims(), claim_ops.extract_claims(traces, steps, packs))
    success = claim_ops.success_claims(found)
    results = detectors.results(traces, detectors.rules(traces, steps, success, packs), success, Thresholds(args.verified, args.false_success)).cache()
    counts = {r.verdict: r.n for r in results.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    if args.out:
        dump(results, args.out)
    else:
        results.orderBy("trace_id").show(args.rows, truncate=False)
    results.unpersist()
    print(", ".join(f"{v}: {counts.get(v, 0)}" for v in VERDICTS))
    invalid = report_errors(loaded.errors, args.rows)
    return 2 if invalid or not counts else int(bool(fail_on & set(counts)))


def report_errors(errors, rows: int) -> int:
    n = errors.select("file", "line_no").distinct().count()
    for e in errors.orderBy("file", "line_no", "json_path", "message").limit(rows).collect():
        print(f"{e.file}, line {e.line_no}: {e.json_path}: {e.message}", file=sys.stderr)
    return n


def validate(spark: SparkSession, args: argparse.Namespace) -> int:
    loaded = load_traces(spark, args.path)
    invalid = report_errors(loaded.errors, args.rows)
    valid = loaded.lines.count()
    print(f"{valid} valid, {invalid} invalid")
    return 0 if valid and not invalid else 2


def train(spark: SparkSession, args: argparse.Namespace) -> int:
    """Fit the classifier and its calibrator, and that of the rules if asked for, on labelled traces with a success claim."""
    wanted = [k.strip() for k in args.calibrate.split(",") if k.strip()]
    if set(wanted) - {"rules"}:
        print(f"error: --calibrate knows rules, not {', '.join(sorted(set(wanted) - {'rules'}))}", file=sys.stderr)
        return 2
    loaded = load_traces(spark, args.path)
    report_errors(loaded.errors, args.rows)
    packs = builtin_packs()
    traces, steps = loaded.traces(), loaded.steps()
    claims = claim_ops.resolve_claims(loaded.claims(), claim_ops.extract_claims(traces, steps, packs))
    success = claim_ops.success_claims(claims)
    known = traces.where("gt_outcome IN ('success', 'failure')")
    labels = known.join(success.select("trace_id").distinct(), "trace_id", "left_semi").select("trace_id", (F.col("gt_outcome") == "success").cast("int").alias("label"))
    rows = step_ops.features(steps, traces, claims).join(labels, "trace_id")
    n = {"all": traces.count(), "labelled": known.count(), "used": labels.count()}
    print(f"training on {n['used']} traces (skipped {n['all'] - n['labelled']} unlabelled, {n['labelled'] - n['used']} without a success claim)")
    try:
        model, c, losses, scores = training.train(rows, step_ops.FEATURES)
        scored = scores.select(F.lit("classifier-lr").alias("detector"), "p", "label", F.lit(False).alias("abstain"))
        if "rules" in wanted:
            by_rules = detectors.rules(traces, steps, success, packs).join(labels, "trace_id")
            scored = scored.unionByName(by_rules.select("detector", "p", "label", "abstain"))
        calibrators = artifacts.CalibratorSet.fitted(training.fit_calibrators(scored), args.path, model.base_rate)
        out = artifacts.ArtifactFolder(spark, args.out)
        out.save(out.MODEL, artifacts.model_object(model, c, losses, n["used"]))
        out.save(out.CALIBRATION, calibrators.to_object())
    except (ValueError, FileExistsError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    print(f"wrote {args.out}/{out.MODEL}, {args.out}/{out.CALIBRATION}")
    return 0


def report(spark: SparkSession, args: argparse.Namespace) -> int:
    """Print the table of a recorded run's predictions on its test split."""
    run = RunFolder(spark, args.path).read()
    rows = evaluation_report.recorded_predictions(run.predictions.where(F.col("split") == args.split))
    print(evaluation_report.markdown(evaluation_report.assemble(rows)), end="")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tracewright", description=__doc__)
    commands = parser.add_subparsers(required=True)
    for name, run in (("check", check), ("validate", validate), ("train", train), ("report", report)):
        p = commands.add_parser(name)
        p.add_argument("path")
        p.add_argument("--rows", type=int, default=50, help="rows of results and errors to print")
        p.set_defaults(run=run)
        if name == "train":
            p.add_argument("--out", required=True, help="folder of lr.json and calibration.json")
            p.add_argument("--calibrate", default="", help="rules: fit their calibrator too")
        if name == "report":
            p.add_argument("--split", default="test")
        if name == "check":
            p.add_argument("--strict", action="store_true")
            p.add_argument("--out")
            p.add_argument("--rules", action="append", default=[])
            p.add_argument("--fail-on", default="false_success")
            p.add_argument("--verified", type=float, default=0.80)
            p.add_argument("--false-success", type=float, default=0.20)
    args = parser.parse_args(argv)
    if spark is None:
        from tracewright.session import session

        spark = session()
    return args.run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
