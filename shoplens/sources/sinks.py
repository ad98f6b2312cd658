"""Writers: request chunks, raw copies, manifests, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shoplens import fixed
from shoplens.operators.numbering import numbered


TASK_LINES = 1 << 16            # that one task writes, in as many chunks


def chunk_count(rows: int, chunk_size: int = fixed.CHUNK_SIZE) -> int:
    return max(1, -(-rows // chunk_size))


def write_request_chunks(df: DataFrame, path: str, line: str = "line",
                         chunk_size: int = fixed.CHUNK_SIZE) -> int:
    """One JSON line per record in files of exactly `chunk_size` lines; only the last may be shorter.

    Records are numbered and a chunk is a range of numbers, so a retried task
    writes the same chunks. A task has whole chunks, several if they are small.
    Returns the number of files (one, empty, for no rows).
    """
    rows, total = numbered(df.select(F.col(line).alias("value")), "_number", "chunk-lines")
    chunks = chunk_count(total, chunk_size)
    share = -(-chunks // df.sparkSession.sparkContext.defaultParallelism)
    each = max(1, min(share, TASK_LINES // chunk_size, 999))        # so names keep the order of the chunks
    task = F.floor(F.col("_number") / F.lit(chunk_size * each)).cast("int")
    (rows.repartitionById(-(-chunks // each), task).sortWithinPartitions("_number").select("value")
         .write.mode("overwrite").option("maxRecordsPerFile", chunk_size).text(path))
    return chunks


def write_raw_copy(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def write_manifest(stats: DataFrame, path: str) -> None:
    """Append the one-row summary of a run to the table of runs."""
    stats.write.mode("append").parquet(path)


def write_vector_file(vectors: DataFrame, path: str, index_name: str,
                      dimensions: int = fixed.EMBED_DIMENSIONS) -> None:
    """Vector records as JSON lines, each carrying the properties of its index."""
    (vectors.select(F.lit(index_name).alias("indexName"),
                    F.lit(dimensions).alias("dimensions"),
                    F.lit(fixed.DISTANCE_METRIC).alias("distanceMetric"),
                    "key", "vector", "metadata")
            .write.mode("overwrite").json(path))


def write_csv_like_input(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with the header order of the input; values quoted when they need it."""
    (df.select(columns).write.mode("overwrite")
       .option("header", True).option("escape", '"').csv(path))
