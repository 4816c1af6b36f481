"""Token counts as delta-maintained rollups.

A ledger is a folder of written batches and a log. Each batch holds signed rows of its documents (what a later delete
or revision must take back) and a rollup: signed sums per (source, lang, tokenizer). Totals are sums of rollups only;
documents are read where a batch takes some of them back. A log entry makes a batch valid: it names the batch's folder
and is created under the next number, which only one of several committers can get; the others take back anew and try
the number after it. A batch that the log has is not applied again, and what a failed attempt left is never read.
Compaction nets all batches into one.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.llm.common import release, remove, slices, small_or_shuffled, staged, text_bytes
from spindrel.llm.words import SPACED, spans

INSERT, DELETE, REVISE = "insert", "delete", "revise"
GROUP = ["source", "lang", "tokenizer"]
DOC = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"
SUMS = "source string, lang string, tokenizer string, docs long, tokens long"
#: Committers that may come in between before a commit gives up.
ATTEMPTS = 100

_encodings: dict[str, object] = {}


def rank_tokenizer(path: str) -> bytes:
    """The content of a rank file (a bounded file on the driver)."""
    with open(path, "rb") as f:
        return f.read()


def _encoding(name: str, ranks: bytes, pattern: str):
    if name not in _encodings:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encodings[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[name]


def _count(tokenizers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, (kind, data, pattern) in tokenizers.value.items():
                if kind == "words":
                    tokens = []
                    flat, offsets = text_bytes(batch.column(3))
                    for i, j in slices(offsets, 1 << 20):
                        part = offsets[i : j + 1]
                        firsts = spans(flat[part[0] : part[-1]], part - part[0], SPACED)[2]
                        tokens += (firsts[1:] - firsts[:-1]).tolist()
                else:
                    encoding = _encoding(name, data, pattern)
                    tokens = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(3).to_pylist()]
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([name] * n, pa.string()), pa.array([1] * n, pa.int64()), pa.array(tokens, pa.int64())], names=[c.split()[0] for c in DOC.split(", ")])
        release()

    return run


def counted(docs: DataFrame, tokenizers: dict[str, tuple[str, bytes, str]]) -> DataFrame:
    """doc_id, source, lang, tokenizer, docs (1), tokens: whole texts under each tokenizer version. A null text has 0 tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(_count(shared), DOC)


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


class Ledger:
    """A folder with written batches in `data` and their log in `log`."""

    def __init__(self, spark: SparkSession, where: str, tokenizers: dict[str, tuple[str, bytes, str]]) -> None:
        self.spark, self.where, self.tokenizers = spark, where.rstrip("/"), tokenizers

    def _path(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _log(self) -> tuple[int, list[dict]]:
        """(last number, entries of the last compaction and all after it). An entry cut short is void."""
        fs, path = self._path(f"{self.where}/log")
        if not fs.exists(path):
            return 0, []
        numbers = sorted(int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit())
        entries: list[dict] = []
        for n in reversed(numbers):
            stream = self._path(f"{self.where}/log/{n:012d}")
            reader = stream[0].open(stream[1])
            try:
                text = bytes(reader.readAllBytes()).decode()
            finally:
                reader.close()
            if text.endswith("\n"):
                entries.append(json.loads(text))
                if entries[-1]["compacts"]:
                    break
        return (numbers[-1] if numbers else 0), entries[::-1]

    def _publish(self, number: int, entry: dict) -> bool:
        """Creates the log entry of this number; False if another committer has it."""
        fs, path = self._path(f"{self.where}/log/{number:012d}")
        try:
            stream = fs.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or fs.exists(path):
                return False
            raise
        stream.write(bytearray((json.dumps(entry) + "\n").encode()))
        stream.close()
        return True

    def batches(self) -> list[str]:
        """Ids of all committed batches."""
        return sorted(b for e in self._log()[1] for b in e["batches"])

    def _read(self, entries: list[dict], what: str, schema: str) -> DataFrame:
        folders = [f for e in entries for f in e[what]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def documents(self) -> DataFrame:
        """The signed document rows of all committed batches."""
        return self._read(self._log()[1], "docs", DOC)

    def commit(self, batch: str, events: DataFrame, order: str | None = None) -> bool:
        """Applies a batch of events (doc_id, op, source, lang, text) once; whether it was applied now.

        insert and revise put the batch's rows of a doc_id in the place of all that the ledger has of it; delete takes
        back all. Several rows of a doc_id are all its rows, unless `order` names a column: then only those that are
        greatest by it count. If a delete is among those that count, the doc_id goes. A delete of an unknown document
        changes nothing. Rows with a null doc_id are documents that nothing takes back; deleting them, or another op,
        is an error of the whole batch. Null source or lang are groups of their own. Other columns are not read.
        """
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"a batch id has letters, digits, - and _ only: {batch!r}")
        if batch in self.batches():
            return False
        events = events.withColumn("doc_id", F.col("doc_id").cast("long"))
        known = F.coalesce(F.col("op").isin(INSERT, DELETE, REVISE), F.lit(False)) & (F.col("doc_id").isNotNull() | (F.col("op") != DELETE))
        if not events.where(~known).isEmpty():
            raise ValueError("a batch has an unknown op, or a delete without doc_id")
        folder = f"{self.where}/data/{batch}-{uuid.uuid4().hex}"
        if order:
            last = staged(events.where("doc_id is not null").groupBy("doc_id").agg(F.max(order).alias("_last")), "last-events")
            events = events.join(small_or_shuffled(last), "doc_id", "left").where(F.col("doc_id").isNull() | F.col(order).eqNullSafe(F.col("_last")))
        ids = staged(events.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("op") == DELETE).alias("gone")), "event-ids")
        gone = ids.where("gone").select("doc_id")
        stays = events if gone.isEmpty() else events.join(small_or_shuffled(gone), "doc_id", "left_anti")
        counted(stays.where(F.col("op") != DELETE), self.tokenizers).write.parquet(f"{folder}/new")
        new = self._read([{"docs": [f"{folder}/new"]}], "docs", DOC)
        for _ in range(ATTEMPTS):
            number, entries = self._log()
            if any(batch in e["batches"] for e in entries):
                return False
            docs, rollup = [f"{folder}/new"], f"{folder}/rollup-{number}"
            delta = new
            if entries:
                taken = _summed(self._read(entries, "docs", DOC).join(small_or_shuffled(ids.select("doc_id")), "doc_id", "left_semi"), ["doc_id", *GROUP])
                docs.append(f"{folder}/taken-{number}")
                taken.select("doc_id", *GROUP, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")).write.parquet(docs[1])
                delta = self._read([{"docs": docs}], "docs", DOC)
            _summed(delta, GROUP).write.parquet(rollup)
            if self._publish(number + 1, {"batches": [batch], "docs": docs, "rollup": [rollup], "compacts": False}):
                return True
        remove(self.spark, folder)
        raise RuntimeError(f"{ATTEMPTS} other commits came in between")

    def compact(self) -> bool:
        """Nets all batches into one; False if another commit came in between (nothing has changed then)."""
        number, entries = self._log()
        folder = f"{self.where}/data/compacted-{uuid.uuid4().hex}"
        _summed(self._read(entries, "docs", DOC), ["doc_id", *GROUP]).write.parquet(f"{folder}/docs")
        _summed(self._read(entries, "rollup", SUMS), GROUP).write.parquet(f"{folder}/rollup")
        entry = {"batches": [b for e in entries for b in e["batches"]], "docs": [f"{folder}/docs"], "rollup": [f"{folder}/rollup"], "compacts": True}
        if self._publish(number + 1, entry):
            return True
        remove(self.spark, folder)
        return False

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens: sums of the committed batches' rollups; groups without documents are left out."""
        return _summed(self._read(self._log()[1], "rollup", SUMS), GROUP)
