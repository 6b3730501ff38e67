"""Streams into collections.

A stream's micro-batches are upserts of one batch each.  The number of the batch
is part of the commit that holds its rows, so a batch that Spark repeats after a
failure is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.collection import Collection


def feed(stream: DataFrame, into: Collection, id: str, name: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts a query that upserts the rows of ``stream`` by its column ``id``.

    ``name`` tells this feed's batches from those of others; ``once`` takes in
    what is there and stops.
    """

    def put(batch: DataFrame, number: int) -> None:
        into.put_frame(batch, id, (name, number))

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
