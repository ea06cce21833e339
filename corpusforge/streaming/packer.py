"""Incremental packing: each micro-batch appends whole blocks to a global stream and carries the rest.

State is one small file for each batch: the number of tokens so far and the tail that fills no block yet. A batch that
is replayed starts from its predecessor's state and writes to the same folder again, so the result is the same.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.operators import packing
from corpusforge.sources.tokenshards import write_json


class Packer:
    """foreachBatch target: Packer(folder, block)."""

    def __init__(self, folder: str, block: int = 512) -> None:
        self.folder, self.block = folder, block

    def state(self, batch: int) -> dict:
        """The state that batch leaves behind; before the first it is empty."""
        if batch < 0:
            return {"tokens": 0, "tail": ""}
        with open(os.path.join(self.folder, "state", f"{batch}.json")) as f:
            return json.load(f)

    def __call__(self, docs: DataFrame, batch: int) -> None:
        before = self.state(batch - 1)
        tail, start = before["tail"], before["tokens"]
        held = len(tail) // packing.DIGITS
        spark = docs.sparkSession
        counted = packing.with_offsets(packing.token_counts(docs), start)
        placed = packing.tokens(docs).join(counted.select("doc_id", "off"), "doc_id")
        # The carried tail comes before all documents of the batch and fills at most one block.
        carried = spark.createDataFrame([(-1, tail, held, start - held)], "doc_id long, stream string, n long, off long").where("n > 0")
        cut = packing.pieces(placed.select("doc_id", "stream", "n", "off").unionByName(carried), self.block)
        joined = cut.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "piece"))).alias("p"), F.sum("n_tokens").alias("n_tokens"))
        out = joined.select("block", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("stream"), "n_tokens").persist()
        out.where(F.col("n_tokens") == self.block).write.mode("overwrite").parquet(os.path.join(self.folder, "blocks", f"batch={batch}"))
        rest = out.where(F.col("n_tokens") < self.block).select("stream").first()
        total = start + (docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1)).first()[0] or 0)
        out.unpersist()
        write_json(os.path.join(self.folder, "state"), f"{batch}.json", {"tokens": total, "tail": rest["stream"] if rest else ""})


def pack_stream(docs: DataFrame, folder: str, block: int = 512):
    """Start a query over a streaming frame of documents that runs over what is there and stops."""
    sink = docs.writeStream.foreachBatch(Packer(folder, block)).option("checkpointLocation", os.path.join(folder, "offsets"))
    return sink.trigger(availableNow=True).start()
