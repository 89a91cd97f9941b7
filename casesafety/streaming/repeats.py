"""Predictions as they arrive, each once: repeated keys are told by keyed state, and batches are written so that a rerun replaces its own rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.pairing import attach_cases
from ..operators.scoring import good_rows, score
from ..schemas import PREDICTION_KEY
from ..sources.predictions import write_batch, written_scores

DAY = 24 * 3600 * 1000


def numbered_arrivals(preds: DataFrame, keys: tuple[str, ...] = PREDICTION_KEY, lifetime_ms: int = 30 * DAY) -> DataFrame:
    """A stream with ``arrival``: 1 for a key's first row, 2 and more for those that repeat it.

    The state is a number for each key, and lives on for ``lifetime_ms`` after the batch of the key's last row; a key that comes again after that is a
    first one again. Time is that of the batches, not of the rows, so no row is dropped for being late, and a batch that is run again has the same time. Null
    keys are a key. Which of a batch's rows with one key is the first is open; how many there are isn't, whatever the order of the batches.
    """
    schema = T.StructType([*preds.schema.fields, T.StructField("arrival", T.LongType())])

    def count(_key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, now = state.get[0] if state.exists else 0, state.getCurrentWatermarkMs()
        for part in parts:
            now = max(now, int(part["_ms"].max()))
            yield part.drop(columns=["_seen", "_ms"]).assign(arrival=np.arange(n + 1, n + len(part) + 1))
            n += len(part)
        state.update((n,))
        state.setTimeoutTimestamp(now + lifetime_ms)

    timed = preds.withColumn("_seen", F.current_timestamp()).withColumn("_ms", F.unix_millis("_seen")).withWatermark("_seen", "1 minute")
    return timed.groupBy(*keys).applyInPandasWithState(count, schema, "n long", "append", GroupStateTimeout.EventTimeTimeout)


def start_scoring_once_each(preds: DataFrame, cases: DataFrame | None, scores_path: str, rejects_path: str, checkpoint: str, once: bool = False, lifetime_ms: int = 30 * DAY) -> StreamingQuery:
    """One query: each key's first row, if it is good, is scored (and joined with ``cases``) into ``scores_path``; bad and repeated rows go to ``rejects_path`` with a ``reason``.

    Both are tables of batches (``sources.predictions.write_batch``): a batch that is run again after a failure replaces its own rows, so they are those of one run.
    ``read_batches`` reads them.
    """
    numbered = numbered_arrivals(preds, lifetime_ms=lifetime_ms)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        good = good_rows(rows)
        first = F.col("arrival") == 1
        scored = score(rows.where(first & good))
        facts = [c for c in ("anchor_id", "domain", "variant", "source_type") if cases is not None and c in cases.columns]
        kept = written_scores(scored)
        write_batch(attach_cases(kept, cases, tuple(facts)) if cases is not None else kept, scores_path, number)
        reason = F.when(~good, "bad rating or count").otherwise("repeated")
        write_batch(rows.where(~(first & good)).withColumn("reason", reason), rejects_path, number)
        rows.unpersist()

    out = numbered.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
