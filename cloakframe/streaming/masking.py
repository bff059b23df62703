"""Lines that arrive as a stream are masked batch by batch, by the same dataflow as a table of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from cloakframe.operators.matching import Guard
from cloakframe.plans.masking import run


def mask_stream(rows: DataFrame, guard: Guard, target: str, instructions: DataFrame | None = None) -> DataStreamWriter:
    """A writer that puts the masked lines, report and restore rows of a stream of lines under target, as Parquet.

    rows: a stream of (file, line_num, line). A batch replaces its own folder, so that one which is run again after a
    failure leaves no row twice. Replacements depend on the word alone and agree between batches.
    """

    def mask(batch: DataFrame, number: int) -> None:
        result = run(batch, guard, instructions)
        for name, frame in (("lines", result.lines), ("report", result.report), ("restore", result.restore)):
            frame.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
        result.close()

    return rows.writeStream.foreachBatch(mask)
