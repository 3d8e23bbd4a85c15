"""Result writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from voltlens.sources.readers import read_inferred_csv

MODES = ("overwrite", "append", "error", "ignore")
#: Most rows of a packed CSV file.
PACKED_ROWS = 250_000


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    files: int | None = None,
    partition_by: Sequence[str] = (),
    compression: str | None = None,
) -> str:
    """Write ``df`` as CSV or snappy Parquet and return ``path``.

    ``compression`` packs CSV files (``gzip``, say); readers know them by their names.  A packed file is read
    by one task, so none holds more than ``PACKED_ROWS`` rows.

    ``files`` sets the number of output files.  It redistributes the finished
    rows, so that asking for one file does not make the work above it run in
    one task.
    """
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"format must be csv or parquet, not {fmt!r}")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if compression and fmt != "csv":
        raise ValueError("compression is for csv; parquet is written with snappy")
    if files is not None:
        if files < 1:
            raise ValueError("files must be at least 1")
        df = df.repartition(files)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if compression:
        writer = writer.option("maxRecordsPerFile", PACKED_ROWS)
    if fmt == "parquet":
        writer.parquet(path, compression="snappy")
    else:
        writer.csv(
            path,
            header=True,
            encoding="UTF-8",
            timestampFormat="yyyy-MM-dd HH:mm:ss",
            dateFormat="yyyy-MM-dd",
            compression=compression,
        )
    return path


def import_csv(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Inferred CSV import: read, tidy the header, drop empty rows, write CSV."""
    frame = read_inferred_csv(spark, source)
    write_table(frame, target, fmt="csv")
    return frame
