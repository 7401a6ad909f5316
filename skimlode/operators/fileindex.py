"""Whole files pruned by the union of their blocks' blooms, before any block is looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EmptyBlockIndex
from ..functions import blooms
from ..plans.candidates import candidate_blocks, data_tests
from .filters import ByteFilter, NgramFilter
from .summary import file_words


def file_index(blocks: DataFrame, bits: int) -> DataFrame:
    """file_words(), of an index that has blocks."""
    if not blocks.limit(1).count():
        raise EmptyBlockIndex("an index without blocks has no bloom to unite")
    return file_words(blocks, bits)


def matching_files(words_of_files: DataFrame, bits: int, ngram: NgramFilter) -> DataFrame:
    """file_id of files whose united bloom may hold a pattern. words_of_files: file_id, words. Files without blocks have no row."""
    words = F.col("words")
    return words_of_files.where(ngram.matches(lambda p: blooms.bloom_has(words, p, bits))).select("file_id")


def pruned_candidates(blocks: DataFrame, block_size: int, bits: int, byte: ByteFilter | None, ngram: NgramFilter | None, test=data_tests, words_of_files: DataFrame | None = None) -> DataFrame:
    """candidate_blocks() of the files that the united bloom leaves; words_of_files: the stored unions, if there are any.

    Unions know pairs only, so without an n-gram filter all files are looked at.
    """
    if ngram is None:
        return candidate_blocks(blocks, block_size, byte, None, test)
    files = matching_files(file_words(blocks, bits) if words_of_files is None else words_of_files, bits, ngram)
    return candidate_blocks(blocks.join(files, "file_id", "left_semi"), block_size, byte, ngram, test)
