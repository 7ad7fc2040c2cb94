"""Edge updates from a stream, applied batch by batch to a graph in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from vertexloom.operators.graph import Graph
from vertexloom.operators.mutate import batch_update
from vertexloom.operators.rounds import settle


class LiveGraph:
    """Holds the graph after the last finished batch."""

    def __init__(self, graph: Graph):
        self.graph, self.done = graph, -1

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """batch(op, src, dst, weight, ord); a batch that is delivered again changes nothing."""
        if batch_id > self.done:
            self.graph = self.graph.with_edges(settle(batch_update(self.graph, batch).edges, "edges"))
            self.done = batch_id

    def writer(self, stream: DataFrame) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(self.apply)
