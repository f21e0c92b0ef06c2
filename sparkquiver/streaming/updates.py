"""Index files as a stream brings them: each micro-batch replaces its files in the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkquiver.engine import parse_files
from sparkquiver.functions.paths import language_of
from sparkquiver.graph import Graph
from sparkquiver.operators import incremental, search
from sparkquiver.operators.resolve import last_wins
from sparkquiver.sources.store import GraphStore


def index_stream(changes: DataFrame, store: GraphStore, checkpoint: str, **trigger) -> StreamingQuery:
    """Start indexing a stream (path, text, mtime); a null text takes the file away.

    A batch's result doesn't depend on what it replaces, so a batch that is run again after a failure leaves the same graph.
    """

    def apply(batch: DataFrame, _epoch: int) -> None:
        last = last_wins(batch, ["path"], "mtime").drop("version")
        files = last.where("text is not null").withColumn("language", language_of(F.col("path"))).where("language is not null").withColumn("size_bytes", F.octet_length("text").cast("long"))
        nodes, edges, coverage = parse_files(files)
        g = store.read()
        out = incremental.replace_files(g, last.select("path"), nodes, edges)
        vectors = None if g.embeddings is None else g.embeddings.join(out.nodes.select("id"), "id", "left_semi")  # new ones come with relate
        index = None if g.postings is None else search.updated_index(g.postings, g.nodes, out.nodes)
        store.write(Graph(out.nodes, out.edges, out.files, g.coverage.join(last.select("path"), "path", "left_anti").unionByName(coverage), vectors, index))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
