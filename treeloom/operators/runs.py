"""Corpus runs that can be interrupted and taken up again.

Every attempt at a corpus writes a folder of its own; a small file in the log, which appears in one
step when the attempt is whole, makes it count. A run skips corpora whose input has a committed
attempt, and what a broken attempt left is never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from ..sources.scratch import exists, put_text

_ENTRY = "name string, fingerprint string, attempt string, status string, error string, n long"


def _entry(path: str, name: str, fingerprint: str) -> str:
    return f"{path}/log/{hashlib.sha256(f'{name}/{fingerprint}'.encode()).hexdigest()}.json"


def run_corpora(spark: SparkSession, inputs: Iterable[tuple[str, str]], work: Callable[[str], DataFrame], path: str) -> DataFrame:
    """Runs ``work(name)`` for each of ``inputs(name, fingerprint)`` whose result isn't committed yet; ``(name, fingerprint, attempt, status, error, n)`` of all.

    Status is "ok" for what this run did, "kept" for what an earlier one had, "error" where a
    corpus failed, which doesn't end the others and is tried again by the next run. Of two runs
    at once, the first to commit counts. Corpora are tens; their rows stay on the executors.
    """
    states = []
    for name, fingerprint in inputs:
        where = _entry(path, name, fingerprint)
        if exists(spark, where):
            states.append((name, fingerprint, None, "kept", None, None))
            continue
        attempt = uuid.uuid4().hex
        try:
            seen = Observation(attempt)
            work(name).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/data/{attempt}")
            n = seen.get["n"]
            won = put_text(spark, where, json.dumps({"name": name, "fingerprint": fingerprint, "attempt": attempt, "status": "ok", "error": None, "n": n}))
            states.append((name, fingerprint, attempt, "ok" if won else "kept", None, n))
        except Exception as e:  # one corpus's failure is a result
            states.append((name, fingerprint, attempt, "error", (str(e).splitlines() or [repr(e)])[0][:500], None))
    return spark.createDataFrame(states, _ENTRY)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The log: a row for each committed attempt."""
    if not exists(spark, f"{path}/log"):
        return spark.createDataFrame([], _ENTRY)
    return spark.read.schema(_ENTRY).option("pathGlobFilter", "*.json").json(f"{path}/log")


def results(spark: SparkSession, path: str, schema: str | T.StructType, current: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """The rows of committed attempts with ``name`` and ``fingerprint``; with ``current`` only of these inputs, so that a changed input's old rows go."""
    log = committed(spark, path)
    if current is not None:
        log = log.join(F.broadcast(spark.createDataFrame([*current], "name string, fingerprint string")), ["name", "fingerprint"], "left_semi")
    rows = log.select("name", "fingerprint", "attempt").collect()  # a row a corpus
    parts = [spark.read.schema(schema).parquet(f"{path}/data/{r.attempt}").select("*", F.lit(r["name"]).alias("name"), F.lit(r.fingerprint).alias("fingerprint")) for r in rows]
    if not parts:
        return spark.createDataFrame([], schema).select("*", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("fingerprint"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
