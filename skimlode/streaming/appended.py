"""Files that grow, as a stream of their chunks: blocks come as soon as they are full, and state survives restarts."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import IndexConfig

#: Blocks that are given back at once, and groups of files: one call and one entry of state for a group, not for a file.
BATCH_BLOCKS, GROUPS = 4096, 1 << 12


def appended_blocks(chunks: DataFrame, block_size: int, groups: int = GROUPS) -> DataFrame:
    """file_id, block_id, offset, length, own, ext of a stream of chunks (file_id, seq, data): what segment() makes of whole files.

    Files are dealt to `groups` groups by a hash of their ids; a group's state holds its files. A checkpoint keeps the number.
    State of a file: its next block's number, the last byte of the block before, and the bytes that don't fill a block yet
    (fewer than block_size). Chunks of a file may come in any number of batches, in order of seq from batch to batch; in a
    batch they are put in order. A chunk with null data closes its file: what is left becomes the last block, and a later
    chunk begins the file anew. Empty chunks add nothing. One task has a group's chunks of one batch.
    """
    IndexConfig(block_size).validate()
    kind = chunks.schema["file_id"].dataType.simpleString()

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = pickle.loads(state.get[0]) if state.exists else {}
        chunks_of: dict = {}
        for part in parts:
            names_of = [None] * len(part) if key[1] else part["file_id"].tolist()  # ids that are null have groups of their own
            for name, seq, chunk in zip(names_of, part["seq"], part["data"]):
                chunks_of.setdefault(name, []).append((seq, chunk))
        blocks: list[tuple] = []
        for name, rows in chunks_of.items():
            number, last, data = kept.pop(name, (0, b"", b""))
            ended = False

            def cut(least: int) -> None:
                nonlocal number, last, data
                at = 0
                while len(data) - at >= least:
                    own = data[at : at + block_size]
                    blocks.append((name, number, number * block_size, len(own), own, last + own))
                    number, last, at = number + 1, own[-1:], at + len(own)
                data = data[at:]

            for _, chunk in sorted(rows, key=lambda r: r[0]):
                ended = chunk is None
                if ended:
                    cut(1)
                    number, last = 0, b""
                else:
                    data += bytes(chunk)
                    cut(block_size)
                while len(blocks) >= BATCH_BLOCKS:
                    yield pd.DataFrame(blocks[:BATCH_BLOCKS], columns=names)
                    del blocks[:BATCH_BLOCKS]
            if not ended:
                kept[name] = (number, last, data)
        if blocks:
            yield pd.DataFrame(blocks, columns=names)
        if kept:
            state.update((pickle.dumps(kept),))
        elif state.exists:
            state.remove()

    names = ["file_id", "block_id", "offset", "length", "own", "ext"]
    out = f"file_id {kind}, block_id long, offset long, length long, own binary, ext binary"
    rows = chunks.select("file_id", F.col("seq").cast("long").alias("seq"), F.col("data").cast("binary").alias("data"))
    rows = rows.withColumns({"group": F.pmod(F.xxhash64("file_id"), F.lit(groups)), "unnamed": F.col("file_id").isNull()})
    return rows.groupBy("group", "unnamed").applyInPandasWithState(advance, out, "files binary", "append", GroupStateTimeout.NoTimeout)
