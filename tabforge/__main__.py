"""Command line: python -m tabforge {profile,generate,history,job} ...

  profile PATH                      contract, samples and row count of a csv/json/parquet file
  generate NAME ROWS --schema FILE  rule-based rows for a contract file, written in FORMAT
  history --ledger PATH             the newest 10 jobs of a ledger
  job --ledger PATH JOB_ID          one job record and its downloadable artifact key
"""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tabforge")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("profile")
    p.add_argument("path")
    p.add_argument("--samples", type=int, default=10)
    g = sub.add_parser("generate")
    g.add_argument("name")
    g.add_argument("rows", type=int)
    g.add_argument("--schema", required=True, help="JSON contract file")
    g.add_argument("--format", default="csv", choices=["csv", "json", "parquet", "tsv"])
    g.add_argument("--key", default=None, help="primary key column (must be in the contract)")
    g.add_argument("--out", default=None, help="base folder (default: the shared output folder)")
    g.add_argument("--ledger", default=None)
    g.add_argument("--seed", type=int, default=42)
    h = sub.add_parser("history")
    h.add_argument("--ledger", required=True)
    j = sub.add_parser("job")
    j.add_argument("--ledger", required=True)
    j.add_argument("job_id")
    args = ap.parse_args(argv)

    from .session import get_spark
    spark = get_spark()
    if args.cmd == "profile":
        from .operators.profile import extract_profile
        print(json.dumps(extract_profile(spark, args.path, args.samples), default=str, indent=2))
    elif args.cmd == "generate":
        from .plans.job import synthesize
        from .spec import DatasetSpec, resolve_contract
        spec = DatasetSpec(args.name, args.rows, format=args.format,
                           columns=resolve_contract(None, args.schema, None), primary_key=args.key,
                           seed=args.seed)
        res = synthesize(spark, spec, base=args.out, ledger_path=args.ledger)
        print(json.dumps({"job_id": res.job_id, "dataset_name": args.name, "rows_generated": res.rows_generated,
                          "columns": [c.name for c in spec.columns], "file_path": res.path,
                          "generated_at": res.generated_at, "status": res.status,
                          "quality_report": res.quality}, indent=2))
    elif args.cmd == "history":
        from .operators import ledger
        rows = ledger.latest_jobs(ledger.read_ledger(spark, args.ledger)).drop("written_at").collect()
        print(json.dumps([r.asDict() for r in rows], default=str, indent=2))
    else:
        from .operators import ledger
        lg = ledger.read_ledger(spark, args.ledger)
        rec = ledger.get_job(lg, args.job_id).drop("written_at").collect()
        art = ledger.resolve_artifacts(lg.where(lg.job_id == args.job_id)).collect()
        if not rec:
            print(json.dumps({"error": f"Job '{args.job_id}' not found"}))
            return 1
        out = rec[0].asDict()
        out["artifact"] = art[0]["artifact"] if art else None
        print(json.dumps(out, default=str, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
