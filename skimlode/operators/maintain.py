"""Index maintenance: appending, merging and cutting block summaries. Boundary bytes are columns, so none is lost."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import IncompatibleIndexConfiguration, IndexConfig, InvalidBlockId, NonSuffixBlockRemoval, TrailingPartialBlock, ZeroBloomBits
from ..functions.hashing import position_columns
from .segment import metadata, segment
from .summary import summarize


BLOCK_COLUMNS = ("file_id", "block_id", "offset", "length", "bytes_present", "pairs", "words")
FILE_COLUMNS = ("file_id", "total_len", "n_blocks", "first_byte", "last_byte")


@dataclass(frozen=True)
class BlockIndex:
    """Summaries (summary.summarize) and a row for each file: total_len, n_blocks, first_byte, last_byte."""

    config: IndexConfig
    blocks: DataFrame
    files: DataFrame

    def save(self, path: str) -> None:
        self.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
        self.files.write.mode("overwrite").parquet(f"{path}/files")

    @classmethod
    def load(cls, spark, path: str, config: IndexConfig) -> BlockIndex:
        return cls.assemble(config, spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/files"))

    @classmethod
    def assemble(cls, config: IndexConfig, blocks: DataFrame, files: DataFrame) -> BlockIndex:
        """An index from its parts, whose columns are checked, and the blooms' size by the first block."""
        config.validate()
        for df, names in ((blocks, BLOCK_COLUMNS), (files, FILE_COLUMNS)):
            if lacking := [c for c in names if c not in df.columns]:
                raise IncompatibleIndexConfiguration(f"no column {', '.join(lacking)}")
        first = blocks.select(F.size("words").alias("n")).first()
        if first is not None and first.n <= 0:
            raise ZeroBloomBits("blooms without words")
        if first is not None and first.n * 64 != config.bits:
            raise IncompatibleIndexConfiguration(f"blooms of {first.n * 64} bits, {config.bits} are configured")
        return cls(config, blocks, files)

    @classmethod
    def from_parts(cls, block_size: int, blocks: DataFrame, files: DataFrame) -> BlockIndex:
        """An index whose blooms' size nobody states: the first block has it, and without blocks (to append to, or to merge) that is an error."""
        first = blocks.select(F.size("words").alias("n")).first()
        if first is None or first.n <= 0:
            raise ZeroBloomBits("an index without blocks doesn't say how large blooms are")
        return cls.assemble(IndexConfig(block_size, first.n * 64), blocks, files)


def build(files: DataFrame, config: IndexConfig, id_col: str = "file_id", data_col: str = "data") -> BlockIndex:
    config.validate()
    return BlockIndex(config, summarize(segment(files, config.block_size, id_col, data_col), config), metadata(files, config.block_size, id_col, data_col))


def _aligned(files: DataFrame, block_size: int) -> None:
    if files.where(F.col("total_len") % block_size != 0).limit(1).count():
        raise TrailingPartialBlock("the last block isn't full: nothing can follow it")


def append(index: BlockIndex, more: DataFrame, id_col: str = "file_id", data_col: str = "data") -> BlockIndex:
    """The index with further bytes of some files (or new files); equal to building it from all bytes.

    Files that get bytes must end with a full block. Only the new bytes are read: the byte before them is in the index.
    """
    size = index.config.block_size
    new = more.select(F.col(id_col).alias("file_id"), F.col(data_col).cast("binary").alias("data")).where(F.length("data") > 0)
    old = index.files.select("file_id", "total_len", "n_blocks", F.col("first_byte").alias("first_old"), "last_byte")
    both = new.join(old, "file_id", "left")
    _aligned(both.where("total_len IS NOT NULL"), size)
    blocks = segment(new, size)
    before = old.select("file_id", "total_len", "n_blocks", "last_byte")
    blocks = blocks.join(before, "file_id", "left")
    first = (F.col("block_id") == 0) & F.col("last_byte").isNotNull()
    blocks = blocks.select("file_id", (F.col("block_id") + F.coalesce("n_blocks", F.lit(0))).alias("block_id"), (F.col("offset") + F.coalesce("total_len", F.lit(0))).alias("offset"), "length", "own", F.when(first, F.concat("last_byte", "ext")).otherwise(F.col("ext")).alias("ext"))
    meta = metadata(new, size)
    joined = index.files.alias("a").join(meta.alias("b"), "file_id", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    files = joined.select("file_id", (zero("a.total_len") + zero("b.total_len")).alias("total_len"), (zero("a.n_blocks") + zero("b.n_blocks")).alias("n_blocks"), F.coalesce("a.first_byte", "b.first_byte").alias("first_byte"), F.coalesce("b.last_byte", "a.last_byte").alias("last_byte"))
    return BlockIndex(index.config, index.blocks.unionByName(summarize(blocks, index.config)), files)


def merge(a: BlockIndex, b: BlockIndex, boundary: bool = True, strict: bool = True) -> BlockIndex:
    """b's blocks after a's, file by file. boundary: with the pair across the seam, as building from all bytes has it.

    Files must end with full blocks; not strict: only those of a that b goes on.
    """
    if a.config != b.config:
        raise IncompatibleIndexConfiguration(f"{a.config} and {b.config}")
    size, bits = a.config.block_size, a.config.bits
    seam = a.files.select("file_id", F.col("n_blocks").alias("n0"), F.col("total_len").alias("t0"), F.col("last_byte").alias("l0")).join(b.files.select("file_id", "first_byte"), "file_id")
    _aligned(a.files.join(b.files.where("n_blocks > 0"), "file_id", "left_semi"), size)
    if strict:
        _aligned(b.files, size)
    moved = b.blocks.join(seam, "file_id", "left")
    code = F.conv(F.hex(F.concat("l0", "first_byte")), 16, 10).cast("int")
    at_seam = (F.col("block_id") == 0) & code.isNotNull() & F.lit(boundary)
    pairs = F.when(at_seam, F.array_sort(F.array_union("pairs", F.array(code)))).otherwise(F.col("pairs"))
    at = position_columns(code, bits)
    one = lambda k, i: F.when(F.shiftright(at[k], 6) == i, F.call_function("shiftleft", F.lit(1).cast("long"), at[k].bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long"))
    seamed = F.transform("words", lambda w, i: w.bitwiseOR(one(0, i)).bitwiseOR(one(1, i)).bitwiseOR(one(2, i)))
    set_ = F.when(at_seam, seamed).otherwise(F.col("words"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    moved = moved.select("file_id", (F.col("block_id") + zero("n0")).alias("block_id"), (F.col("offset") + zero("t0")).alias("offset"), "length", "bytes_present", pairs.alias("pairs"), set_.alias("words"))
    joined = a.files.alias("a").join(b.files.alias("b"), "file_id", "full")
    files = joined.select("file_id", (zero("a.total_len") + zero("b.total_len")).alias("total_len"), (zero("a.n_blocks") + zero("b.n_blocks")).alias("n_blocks"), F.coalesce("a.first_byte", "b.first_byte").alias("first_byte"), F.coalesce("b.last_byte", "a.last_byte").alias("last_byte"))
    return BlockIndex(a.config, a.blocks.unionByName(moved), files)


def remove_blocks(index: BlockIndex, file_id, ids: Sequence[int]) -> BlockIndex:
    """The index without a file's last blocks; ids (in any order, repeated or not) must be just those.

    The byte that the file now ends with isn't known any more, so its last_byte is null.
    """
    cut = sorted(set(ids))
    if not cut:
        return index
    row = index.files.where(F.col("file_id") == F.lit(file_id)).first()
    n = row.n_blocks if row else 0
    if cut[0] < 0 or cut[-1] >= n:
        raise InvalidBlockId(f"file {file_id} has {n} blocks")
    if cut != list(range(n - len(cut), n)):
        raise NonSuffixBlockRemoval("only a file's last blocks can go")
    keep, size = n - len(cut), index.config.block_size
    own = F.col("file_id") == F.lit(file_id)
    files = index.files.select(
        "file_id", F.when(own, F.lit(keep * size)).otherwise(F.col("total_len")).alias("total_len"), F.when(own, F.lit(keep)).otherwise(F.col("n_blocks")).alias("n_blocks"),
        F.when(own & F.lit(keep == 0), F.lit(None)).otherwise(F.col("first_byte")).alias("first_byte"), F.when(own, F.lit(None)).otherwise(F.col("last_byte")).alias("last_byte"),
    )
    return BlockIndex(index.config, index.blocks.where(~(own & (F.col("block_id") >= keep))), files)


def remove_suffixes(index: BlockIndex, gone: DataFrame, data: DataFrame | None = None, id_col: str = "file_id", data_col: str = "data") -> BlockIndex:
    """The index without the blocks of `gone` (file_id, block_id; repeated or not): of each file the last ones, of any number of files.

    One look at all of `gone` says whether a file lacks a block (InvalidBlockId) or would lose one that isn't among its last
    (NonSuffixBlockRemoval); only an offending row comes to the driver. data: the files' bytes, from which the byte that a
    file now ends with is taken; without them it is unknown, so last_byte is null and nothing can be appended with its pair.
    """
    size = index.config.block_size
    cut = gone.select("file_id", "block_id").distinct().groupBy("file_id").agg(F.count("*").alias("n"), F.min("block_id").alias("keep"), F.max("block_id").alias("most"))
    there = cut.join(index.files.select("file_id", "n_blocks"), "file_id", "left")
    lacking = F.col("n_blocks").isNull() | F.col("keep").isNull() | (F.col("keep") < 0) | (F.col("most") >= F.col("n_blocks"))
    wrong = there.select("file_id", lacking.alias("lacking"), (F.col("keep") != F.col("n_blocks") - F.col("n")).alias("inner")).where("lacking OR inner").first()
    if wrong is not None:
        if wrong.lacking:
            raise InvalidBlockId(f"file {wrong.file_id} hasn't all of these blocks")
        raise NonSuffixBlockRemoval(f"only a file's last blocks can go: file {wrong.file_id}")
    cut = cut.select("file_id", "keep")
    blocks = index.blocks.join(cut, "file_id", "left").where(F.col("keep").isNull() | (F.col("block_id") < F.col("keep"))).drop("keep")
    if data is None:
        cut = cut.withColumn("ends", F.lit(None).cast("binary"))
    else:
        bytes_ = data.select(F.col(id_col).alias("file_id"), F.col(data_col).cast("binary").alias("data"))
        ends = F.when((F.col("keep") > 0) & (F.length("data") >= F.col("keep") * size), F.substring(F.col("data"), (F.col("keep") * size).cast("int"), F.lit(1)))
        cut = cut.join(bytes_, "file_id", "left").select("file_id", "keep", ends.alias("ends"))
    own = F.col("keep").isNotNull()
    files = index.files.join(cut, "file_id", "left").select(
        "file_id", F.when(own, F.col("keep") * size).otherwise(F.col("total_len")).alias("total_len"), F.when(own, F.col("keep")).otherwise(F.col("n_blocks")).alias("n_blocks"),
        F.when(own & (F.col("keep") == 0), F.lit(None)).otherwise(F.col("first_byte")).alias("first_byte"), F.when(own, F.col("ends")).otherwise(F.col("last_byte")).alias("last_byte"),
    )
    return BlockIndex(index.config, blocks, files)
