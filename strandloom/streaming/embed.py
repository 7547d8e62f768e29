"""Sequences that keep arriving, embedded and encoded batch by batch over one graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strandloom.operators import encode, walk
from strandloom.operators.encode import Params
from strandloom.operators.graph import Graph
from strandloom.session import materialise, scratch


def encode_stream(contigs: DataFrame, graph: Graph, out: str, checkpoint: str, params: Params = Params()) -> StreamingQuery:
    """A streaming (seq_id, contig_idx, seq) -> extension rows and trims under out, one folder per batch, so a repeated batch replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        with scratch(df.sparkSession):
            walks, trims = walk.embed(materialise(df.select("seq_id", "contig_idx", "seq"), "batch"), graph)
            trims.write.mode("overwrite").parquet(f"{out}/trims/batch={number}")
            encode.greedy(materialise(walks, "walks"), graph, params).write.mode("overwrite").parquet(f"{out}/extensions/batch={number}")

    graph.edge_table()  # written ahead, so no batch deletes it

    return contigs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
