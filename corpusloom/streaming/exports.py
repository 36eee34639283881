"""Export files that come in over time, read by ranges and committed once each."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.sources import exports
from corpusloom.streaming.jobs import commit_once

FILES = "path string, modificationTime timestamp, length long, content binary"
HITS = "_id string, _source map<string,string>, load_seq long"


def commit_exports(spark: SparkSession, folder: str, out: str, ledger: str, mark: str, encoding: str = "UTF-16LE", size: int = 32 << 20, files_a_batch: int = 1000, errors: tuple[str, str] | None = None) -> StreamingQuery:
    """Commit the hits of export files new under ``folder``, batch by batch, into the table ``out`` with its ``ledger`` (read_committed(..., HITS)); ``mark`` is the stream's checkpoint.

    The stream carries names of files, not their bytes. A batch that fails and runs again replaces its own rows. Files that could not be parsed go, likewise, to
    ``errors`` (a table and its ledger), if given; load_seq orders hits within a batch.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(folder).select("path", "length")
    commit, commit_errors = commit_once(out, ledger), commit_once(*errors) if errors else None

    def batch(rows, i: int) -> None:
        hits, bad = exports.hits_of(rows.select(F.lit(0).alias("i"), "path", "length"), encoding, size)
        if commit_errors:
            commit_errors(bad, i)
        commit(hits, i)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", mark).trigger(availableNow=True).start()
