"""Events that are delivered more than once."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions.timeline import span_text

DELAY = timedelta(hours=1)


def dedupe_events(
    events: DataFrame, ids: str | list[str], ts: str = "ts", delay: timedelta = DELAY, salts: int = 1
) -> DataFrame:
    """The first copy of each event: in a table the one with the smallest time, on a stream the one that arrives first.

    On a stream, copies further apart than `delay` are not recognised. All copies of an id meet in one task. If one id
    may have very many copies, `salts` above 1 first reduces them in that many tasks picked at random, for twice the
    state and shuffle.
    """
    names = [ids] if isinstance(ids, str) else list(ids)
    if not events.isStreaming:
        others = [name for name in events.columns if name not in names]
        if not others:
            return events.dropDuplicates(names)
        # NULL times come last; among equal times the smallest row counts, so that the result is the same every time.
        first = F.min_by(F.struct(*others), F.struct(F.col(ts).isNull(), F.col(ts), F.struct(*others)))
        return events.groupBy(*names).agg(first.alias("_row")).select(*names, "_row.*").select(*events.columns)
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, span_text(delay))
    if salts > 1:
        salted = timed.withColumn("_salt", F.floor(F.rand() * salts).cast("int"))
        timed = salted.dropDuplicatesWithinWatermark([*names, "_salt"]).drop("_salt")
    return timed.dropDuplicatesWithinWatermark(names)
