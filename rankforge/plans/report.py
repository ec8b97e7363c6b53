"""Driver-side sinks of small results: Markdown tables, timing, run status."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame

from rankforge.sources.readers import write_status

#: Metrics by which a report sorts: the first that a table has.
ORDER = ("recall_at_10", "recall_at_5", "ndcg_at_10")


def markdown(df: DataFrame, columns: Sequence[str] | None = None, rows: int = 200, digits: int = 4) -> str:
    """A table of the first rows, best first."""
    columns = [c for c in (columns or df.columns) if c in df.columns]
    by = next((c for c in ORDER if c in df.columns), None)
    df = df.orderBy(df[by].desc(), *[df[c] for c in columns[:1]]) if by else df
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    body = ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in df.select(*columns).limit(rows).collect()]
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *body])


def report(title: str, sections: dict[str, DataFrame | str | None]) -> str:
    """Sections in order; missing tables are named as missing."""
    parts = [f"# {title}"]
    for name, x in sections.items():
        parts += [f"## {name}", "not available" if x is None else x if isinstance(x, str) else markdown(x)]
    return "\n\n".join(parts) + "\n"


class Timing:
    """Seconds and pairs per second of each model."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, float, float]] = []

    def record(self, model: str, action: Callable[[], int]) -> int:
        began = time.perf_counter()
        pairs = action()
        took = time.perf_counter() - began
        self.rows.append((model, pairs, took, pairs / took if took else 0.0))
        return pairs

    def save(self, spark: Any, path: str) -> None:
        """The rows as CSV with a header; nothing where nothing was recorded."""
        if self.rows:
            self.table(spark).write.mode("overwrite").option("header", True).csv(path)

    def table(self, spark: Any) -> DataFrame:
        return spark.createDataFrame(self.rows, "model string, num_pairs long, elapsed_seconds double, throughput_pairs_per_sec double")


def run_models(models: dict[str, Callable[[], DataFrame]], sink: Callable[[str, DataFrame], None], status: str | None = None) -> dict[str, str]:
    """Runs every model; one that fails is reported and the others go on. Returns the failures."""
    failed = {}
    for name, build in models.items():
        try:
            sink(name, build())
        except Exception as e:  # noqa: BLE001  failures are isolated by model and written to the status
            failed[name] = f"{type(e).__name__}: {e}"
    if status:
        write_status(status, status="failed" if len(failed) == len(models) else "partial" if failed else "ok", num_models=len(models), failed=failed)
    return failed
