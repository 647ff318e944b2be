"""python -m plumbline: scan, validate, report, audits, demo and serve."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.config import SEVERITIES, find_config, load_config
from plumbline.errors import PlumblineError
from plumbline.operators import gate
from plumbline.session import Audit, AuditSession
from plumbline.sinks import reports
from plumbline.sinks.store import AuditStore
from plumbline.sources.paths import home

RATES = ("max_corrupt_rate", "max_leakage_rate", "max_invalid_annotation_rate", "max_duplicate_rate", "max_blur_rate")


def spark_session() -> SparkSession:
    b = SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def summary(audit: Audit) -> str:
    o, t = audit["health_overall"].first(), audit["totals"].first()
    lines = [f"{audit.meta['dataset']}  ({audit.id})", f"  score {'n/a' if o.overall is None else o.overall}  grade {o.grade or 'n/a'}", f"  images {t.images} ({t.valid_images} valid), boxes {t.annotations}, splits {', '.join(audit.meta['splits'])}"]
    shown = audit["findings"].orderBy("place", F.desc("affected_count"), "id").limit(12).collect()
    return "\n".join(lines + [f"  {f.severity:<8} {f.title} ({f.affected_count})" for f in shown])


def _audit(args: argparse.Namespace, mode: str) -> Audit:
    own = args.config or find_config(args.dir)
    now = [""]

    def tell(stage: str, n: int, of: int) -> None:
        now[0] = f"{n}/{of} {stage}"
        print(f"\r\033[K{now[0]}", file=sys.stderr)

    def count(done: int, of: int) -> None:
        print(f"\r\033[K{now[0]} {done}/{of} tasks", end="", file=sys.stderr, flush=True)

    shown = {} if args.quiet else {"progress": tell} | ({"tasks": count} if sys.stderr.isatty() else {})
    return AuditSession(spark_session(), load_config(own), f"file://{home() / 'cache'}").run(args.dir, mode, **shown)


def _scan(args: argparse.Namespace) -> int:
    audit = _audit(args, "scan")
    AuditStore(spark_session(), home() / "audits").save(audit)
    print(json.dumps(audit.meta, ensure_ascii=False) if args.json else summary(audit))
    return gate.PASS


def _validate(args: argparse.Namespace) -> int:
    config = load_config(args.config or find_config(args.dir))
    for name in (*RATES, "fail_under"):
        if (v := getattr(args, name)) is not None:
            setattr(config.ci, name, v)
    if args.fail_on is not None:
        config.ci.fail_on = None if args.fail_on == "none" else args.fail_on
    mode = "scan" if args.full else "validate"
    if args.fail_under is not None and not args.full:
        raise PlumblineError("--fail-under needs --full")
    audit = AuditSession(spark_session(), config).run(args.dir, mode)
    code, reasons = gate.evaluate(audit["health_components"], audit["health_overall"], audit["findings"], config.ci, mode)
    print("\n".join(["FAIL", *(f"  {r}" for r in reasons)] if reasons else ["PASS"]))
    return code


def _report(args: argparse.Namespace) -> int:
    store = AuditStore(spark_session(), home() / "audits")
    if os.path.isdir(args.source):
        args.dir = args.source
        audit = _audit(args, "scan")
    else:
        audit = store.load(args.source)
    for path in reports.write(audit, args.out, args.format):
        print(path)
    return gate.PASS


def _audits(args: argparse.Namespace) -> int:
    for m in AuditStore(spark_session(), home() / "audits").list():
        print(f"{m['id']}  {m['created_at']}  {m.get('overall')}  {m['dataset']}")
    return gate.PASS


def _demo(args: argparse.Namespace) -> int:
    from plumbline.sources.demo import generate

    print(json.dumps(generate(args.dir)))
    return gate.PASS


def _serve(args: argparse.Namespace) -> int:
    from plumbline.http import serve
    from plumbline.service import AuditService

    allowed = [p for p in os.environ.get("PLUMBLINE_ALLOWED_ROOTS", "").split(os.pathsep) if p]
    server = serve(AuditService(spark_session(), home(), allowed or None), args.host, args.port)
    print(f"http://{args.host}:{server.server_port}")
    server.serve_forever()
    return gate.PASS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("plumbline", description="Audits datasets for machine learning.")
    sub = p.add_subparsers(required=True)

    def add(name: str, run, help: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=help)
        c.set_defaults(run=run)
        c.add_argument("--config")
        c.add_argument("--quiet", action="store_true")
        return c

    c = add("scan", _scan, "audit a folder and keep the audit")
    c.add_argument("dir")
    c.add_argument("--json", action="store_true")
    c = add("validate", _validate, "pass or fail, for CI")
    c.add_argument("dir")
    c.add_argument("--full", action="store_true")
    c.add_argument("--fail-on", choices=[*SEVERITIES, "none"])
    for name in (*RATES, "fail_under"):
        c.add_argument("--" + name.replace("_", "-"), type=float)
    c = add("report", _report, "write reports of a folder or a kept audit")
    c.add_argument("source")
    c.add_argument("--out", default=".")
    c.add_argument("--format", nargs="+", choices=reports.FORMATS)
    add("audits", _audits, "list kept audits")
    add("demo", _demo, "write a small dataset with defects").add_argument("dir")
    c = add("serve", _serve, "answer over HTTP")
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=8000)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except PlumblineError as e:
        print(f"error: {e}", file=sys.stderr)
        return gate.ERROR
