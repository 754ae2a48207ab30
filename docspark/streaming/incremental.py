"""Streams: documents stripped as they arrive, numbering with state, rolling counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docspark.operators.pseudonyms import PMAP
from docspark.operators.strip import Options, strip


def strip_stream(docs: DataFrame, out: str, maps: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Strip (doc_id, text) micro-batches; each extends the map of the last.

    Every batch writes its texts and the whole map as of then to folders named by its number, and reads the map of the
    number before; a batch that is run again after a failure overwrites its own folders and so gives the same names.
    """

    def one(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(PMAP).parquet(f"{maps}/batch={n - 1}") if n else None
        done, made = strip(batch, options, pmap=before)
        made.write.mode("overwrite").parquet(f"{maps}/batch={n}")
        done.select("doc_id", "stripped").write.mode("overwrite").parquet(f"{out}/batch={n}")

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def rolling_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", size: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Events per window and kind; rows later than ``late`` are dropped by the watermark."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w, kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, ts: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """Events per user and session, closed by a gap."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n"))


def first_seen_numbers(values: DataFrame) -> DataFrame:
    """(prefix, norm_value, n) in the strict order of arrival, with state kept per prefix: see operators.pseudonyms for batches."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def number(key, frames, state):
        seen = dict(zip(*state.get, strict=True)) if state.exists else {}
        out = []
        for pdf in frames:
            for v in pdf["norm_value"]:
                if v not in seen:
                    seen[v] = len(seen) + 1
                    out.append((key[0], v, seen[v]))
        state.update((list(seen), list(seen.values())))
        yield pd.DataFrame(out, columns=["prefix", "norm_value", "n"])

    return values.groupBy("prefix").applyInPandasWithState(number, "prefix string, norm_value string, n long", "v array<string>, n array<long>", "append", GroupStateTimeout.NoTimeout)
