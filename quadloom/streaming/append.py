"""Files of facts that arrive over time, appended to a store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quadloom.session import cut_lineage
from quadloom.sources.text import facts_of, hyper_of
from quadloom.store import GraphStore


def append_stream(spark: SparkSession, folder: str, store: GraphStore, checkpoint: str, once: bool = True, most_parts: int = 64) -> StreamingQuery:
    """Append every new text file of `folder` to `store`.

    The checkpoint remembers the files. The number of a batch is committed with its facts and hyperedges, so a batch
    that runs again after a failure adds nothing twice. Beyond `most_parts` parts the store is compacted.
    """

    def append(batch: DataFrame, number: int) -> None:
        lines = cut_lineage(batch)
        store.append(facts_of(lines), cut_lineage(hyper_of(lines, store.next_hid())), (checkpoint, number))
        if store.parts() > most_parts:
            store.compact()

    stream = spark.readStream.schema("value string").text(folder)
    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
