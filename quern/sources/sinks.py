"""Writers. Files are replaced as a whole by Spark's commit protocol, or appended."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.userdata import latest


def replace_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def replace_parquet(rows: DataFrame, path: str, by: str | None = None) -> None:
    (rows.write.partitionBy(by) if by else rows.write).mode("overwrite").parquet(path)


def save_documents(rows: DataFrame, path: str) -> None:
    """The last row of each id, and the links as an edge table; both replaced."""
    last = latest(rows, ["doc_id"], "crawled_at")
    last.drop("outlinks").write.mode("overwrite").parquet(f"{path}/documents")
    last.select(F.col("doc_id").alias("from_doc_id"), F.explode("outlinks").alias("to_url")).write.mode("overwrite").parquet(f"{path}/outlinks")


def clear(rows: DataFrame, path: str) -> None:
    rows.limit(0).write.mode("overwrite").parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_urls(rows: DataFrame, path: str) -> None:
    rows.select("url").write.mode("append").text(path)


def by_host(rows: DataFrame, partitions: int) -> DataFrame:
    """Dealt by host, as a keyed topic would be."""
    return rows.repartition(partitions, "host")


def fan_out(sinks: dict[str, Callable[[DataFrame], None]], failures: dict[str, int]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each batch to every sink; one that fails is counted and stops no other."""

    def each(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            for name, sink in sinks.items():
                try:
                    sink(batch)
                except Exception:  # noqa: BLE001  a sink's own failure
                    failures[name] = failures.get(name, 0) + 1
        finally:
            batch.unpersist()

    return each


def due(pages: int, last: int, every: int, growth: float = 0.25) -> bool:
    """Whether a checkpoint is due: at multiples of `every`, when enough has been added since the last."""
    return pages % every == 0 and pages - last >= max(every, growth * last)


def report(rows: DataFrame, title: str, path: str | None = None) -> str:
    """A small result as a Markdown table."""
    names = rows.columns
    lines = [f"# {title}", "", f"| {' | '.join(names)} |", f"|{'---|' * len(names)}", *(f"| {' | '.join(str(v) for v in r)} |" for r in rows.collect())]
    text = "\n".join(lines) + "\n"
    if path:
        rows.sparkSession.createDataFrame([(text,)], "value STRING").coalesce(1).write.mode("overwrite").text(path)
    return text


def as_json(values: dict) -> str:
    return json.dumps(values, ensure_ascii=False, default=str, sort_keys=True)
