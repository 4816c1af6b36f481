"""python -m spindrel COMMAND, one of COMMANDS: on the tables in --folder, or a collection in --store."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from spindrel import __version__
from spindrel.config import from_environment
from spindrel.operators import changes as log
from spindrel.operators.artifacts import DUPLICATE_CONTRACT
from spindrel.operators.collection import Collections
from spindrel.operators.encoding import HashingEncoder
from spindrel.operators.evaluation import environment, latency, measure
from spindrel.operators.retrieval import live_retriever
from spindrel.plans import changes, registry, retrieval
from spindrel.session import local_session, table
from spindrel.sources.catalog import checksums, integrity, load_manifest, write_csv, write_experiments
from spindrel.workspace import staged

COMMANDS = ("doctor", "list", "run", "latency", "ingest", "verify", "reset", "version", "search", "evaluate", "calibrate", "predict", "deliver", "experiment", "events")


def _arguments(arguments: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="spindrel")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("name", nargs="?", help="a query's name, or the text to search")
    parser.add_argument("--folder", help="the folder of the tables")
    parser.add_argument("--out", help="where to write")
    parser.add_argument("--store", help="the folder of collections")
    parser.add_argument("--brand")
    parser.add_argument("--top", type=int, default=10)
    parser.add_argument("--expected", type=int, help="rows that the collection must have")
    parser.add_argument("--yes", action="store_true", help="confirm a reset, which the settings must allow, too")
    parser.add_argument("--sweep", action="store_true", help="evaluate several numbers of visited cells, too")
    parser.add_argument("--twice", action="store_true", help="apply the events twice")
    asked = parser.parse_args(arguments)
    needs = {"run": ["name", "folder"], "latency": ["name", "folder"], "ingest": ["folder", "store"], "verify": ["store"], "reset": ["store"], "search": ["name", "store"], "evaluate": ["folder"], "calibrate": ["folder"], "predict": ["folder", "out"], "deliver": ["folder", "out"], "experiment": ["folder", "out"], "events": ["folder"]}
    lacking = [x for x in needs.get(asked.command, []) if not getattr(asked, x)]
    if lacking or (asked.command in ("run", "latency") and asked.name not in registry.QUERIES):
        parser.error(f"{asked.command} needs {', '.join(lacking) or 'a known query'}")
    return asked


def main(arguments: list[str] | None = None) -> int:
    asked = _arguments(arguments)
    if asked.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    if asked.command == "version":
        print(f"spindrel {__version__}")
        return 0
    spark, settings = local_session(), from_environment()
    folder, encoder = asked.folder, HashingEncoder(settings.dimension)
    if asked.command == "doctor":
        print(json.dumps(environment(spark) | {"model": settings.model, "dimension": str(settings.dimension), "collection": settings.collection}, indent=1))
        if folder:
            files = integrity(load_manifest(spark, f"{folder}/manifest.json"), checksums(spark, folder))
            files.show(truncate=False)
            return 0 if files.where(~F.col("ok")).isEmpty() else 1
    elif asked.command == "run":
        rows = registry.QUERIES[asked.name](spark, folder)
        rows.write.mode("overwrite").parquet(asked.out) if asked.out else rows.show(50, truncate=60)
    elif asked.command == "latency":
        samples = spark.createDataFrame([(x,) for x in measure(lambda: registry.QUERIES[asked.name](spark, folder))], "ms double")
        latency(samples, "ms").show(truncate=False)
    elif asked.command == "ingest":
        rows = table(spark, folder, "documents").select(F.col("doc_id").alias("product_id"), F.col("lang").alias("brand"), "text")
        Collections(spark, asked.store, settings).ingest(rows, encoder).show(truncate=False)
    elif asked.command == "verify":
        stored = Collections(spark, asked.store, settings)
        stored.verify(stored.read().count() if asked.expected is None else asked.expected, encoder.dimension).show(truncate=False)
    elif asked.command == "reset":
        Collections(spark, asked.store, settings).reset(asked.yes)
    elif asked.command == "search":
        live_retriever(Collections(spark, asked.store, settings), encoder, settings.model).search(asked.name, asked.top, asked.brand).show(asked.top, truncate=60)
    elif asked.command == "evaluate":
        for name in ("macro_metrics", "ann_fidelity", "compliance_summary") + ("nprobe_sweep",) * asked.sweep:
            registry.QUERIES[name](spark, folder).show(50, truncate=False)
    elif asked.command == "calibrate":
        for name in ("dup_class_stats", "dup_threshold"):
            registry.QUERIES[name](spark, folder).show(truncate=False)
    elif asked.command == "predict":
        rows = staged(registry.QUERIES["duplicate_artifact_rows"](spark, folder), "predicted")
        write_csv(rows, asked.out, DUPLICATE_CONTRACT)
        rows.show(truncate=False)
    elif asked.command == "deliver":
        retrieval.deliver(spark, folder, asked.out).show(truncate=False)
    elif asked.command == "experiment":
        rows = retrieval._compared(spark, folder)
        write_experiments(rows, asked.out)
        rows.drop("retrieved").show(truncate=False)
    else:
        log.apply_events(changes._events(spark, folder), changes._base(spark, folder), asked.twice)[1].show(vertical=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
