"""Change feeds: notifications of other systems as a stream, applied to the engine batch by batch."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.engine import Engine

log = logging.getLogger("strata")


def follow(engine: Engine, name: str, changes: DataFrame, checkpoint: str, origin: str | None = "origin", tenant: str | None = None, **trigger) -> StreamingQuery:
    """Apply a streaming DataFrame of changed keys. Only rows whose ``origin`` is ``remote`` count (None: all rows).

    A batch that fails is a gap: what can't be applied is answered by trusting nothing, and the stream goes on.
    """
    keys = list(engine.resources[name].primary_key)

    def apply(batch: DataFrame, _: int) -> None:
        rows = batch if origin is None else batch.where(F.col(origin) == "remote")
        rows = rows.select(*keys).distinct()
        try:
            if rows.limit(1).count():
                engine.on_external_change(name, rows, tenant)
        except Exception as e:
            log.warning("%s: a change batch failed, all coverage is dropped: %s", name, e)
            engine.on_external_gap(name, tenant)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
