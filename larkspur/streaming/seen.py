"""What was seen, carried from run to run: a stream's rows are stored the first time that their key comes, and never again.

The sink is given to `writeStream.foreachBatch`. It joins each batch with the keys of a store (`larkspur.sources.store`) and appends the
rows whose keys that lacks. The number of the batch is published in the same manifest as its rows, so a batch that is
replayed after a crash, whether it had been written or not, is written once. A stream that is started again with its checkpoint
goes on from the batch behind; one without needs a name of its own, as its batches are numbered from 0.

Rows whose key is null or empty are not stored, as with `dedupe.unseen`. Of rows that share a key in a batch the first by order is
stored; that is a minimum, summed up before the shuffle, so a key on a third of the rows is no hot group. An empty batch is only marked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.dedupe import unseen
from larkspur.sources.store import Store


class SeenSink:
    def __init__(self, store: Store, key: str, order: list[str], name: str = "seen"):
        self.store, self.key, self.order, self.name = store, key, order, f"batch:{name}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        base = self.store.latest()
        if base is not None and base.marks.get(self.name, -1) >= batch_id:
            return
        named = batch.where(F.coalesce(F.col(self.key).cast("string"), F.lit("")) != "")
        first = named.groupBy(self.key).agg(F.min_by(F.struct(*batch.columns), F.struct(*self.order)).alias("_row")).select("_row.*")
        fresh = first if base is None else unseen(first, self.store.read(base), self.key)
        self.store.write(fresh, base=base, append=True, marks={self.name: batch_id})


def carried(stream: DataFrame, store: Store, checkpoint: str, *, key: str, order: list[str], name: str = "seen") -> None:
    """Run a stream over all that has come by now, storing first sightings; the next run goes on from here."""
    query = stream.writeStream.foreachBatch(SeenSink(store, key, order, name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
