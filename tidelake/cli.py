"""The command line: ingest, status, maintenance, table, validate."""

from __future__ import annotations

import argparse
import json
import sys
import time

from tidelake import config
from tidelake.errors import INTERRUPTED, ConfigError, EngineError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidelake")
    p.add_argument("--config", default="tidelake.toml")
    sub = p.add_subparsers(dest="command", required=True)
    ingest = sub.add_parser("ingest", help="read the topic into the table")
    ingest.add_argument("--log", help="a file log's folder, instead of Kafka")
    ingest.add_argument("--once", action="store_true", help="stop when what is there has been read")
    sub.add_parser("status", help="what recovery finds in the ledger")
    sub.add_parser("validate", help="check the configuration")
    m = sub.add_parser("maintenance").add_subparsers(dest="task", required=True)
    m.add_parser("compact")
    m.add_parser("run", help="all that the configuration turns on, once")
    m.add_parser("expire-snapshots").add_argument("--dry-run", action="store_true")
    orphans = m.add_parser("clean-orphans")
    orphans.add_argument("--dry-run", action="store_true")
    t = sub.add_parser("table").add_subparsers(dest="task", required=True)
    t.add_parser("register").add_argument("sources", nargs="+")
    t.add_parser("reset").add_argument("--keep-data", action="store_true", required=True)
    return p


def run(args: argparse.Namespace) -> int:
    c = config.load_file(args.config)
    if found := config.problems(c):
        raise ConfigError("; ".join(found))
    if args.command == "validate":
        print("the configuration is fine")
        return 0
    from tidelake.operators import maintenance, recovery
    from tidelake.operators.ledger import Ledger
    from tidelake.session import session
    from tidelake.sources import files, log
    from tidelake.streaming import ingest

    spark = session(**{k.replace(".", "__"): v for k, v in (config.catalog_options(c.table) | config.filesystem_options(c.table)).items()})
    ledger = Ledger(spark, c.ledger.log_dir)
    now, day = int(time.time() * 1000), 86_400_000
    if args.command == "status":
        print(json.dumps(recovery.summary(ledger.entries()).first().asDict(), indent=1))
    elif args.command == "ingest":
        stream = log.stream_log(spark, args.log, c.kafka.topic, c.kafka.auto_offset_reset, c.kafka.batch_size) if args.log else log.stream_kafka(spark, c.kafka)
        sink = ingest.build(ledger, c)
        q = sink.start(stream, f"{c.ledger.log_dir}/stream", None if args.once else f"{c.buffer.flush_interval_seconds} seconds")
        try:
            q.awaitTermination()
        except KeyboardInterrupt:
            q.stop()
            ledger.checkpoint()
            return INTERRUPTED
    elif args.command == "maintenance" and args.task == "compact":
        n = maintenance.compact(ledger, c.table.database_name, c.table.table_name, c.table.warehouse_path, c.maintenance.compaction_threshold_mb << 20, c.maintenance.compaction_target_mb << 20)
        print(f"{n} files merged")
    elif args.command == "maintenance":
        if args.task == "expire-snapshots":
            print(json.dumps(maintenance.expire(ledger, c.table.database_name, c.table.table_name, now, c.maintenance.snapshot_retention_days * day, args.dry_run)))
        elif args.task == "run":
            print(json.dumps(ingest.maintain(ledger, c, now)))
        else:
            n = maintenance.clean_orphans(ledger, f"{c.table.warehouse_path}/data", now, c.maintenance.orphan_retention_days * day, args.dry_run)
            print(f"{n} orphans" + " found" * args.dry_run)
    elif args.task == "register":
        print(f"{files.register_parquet(ledger, c.table.database_name, c.table.table_name, args.sources)} files registered")
    else:
        files.reset_table(ledger, c.table.database_name, c.table.table_name)
        print("the table was reset; its files stay")
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code
    except KeyboardInterrupt:
        return INTERRUPTED


if __name__ == "__main__":
    sys.exit(main())
