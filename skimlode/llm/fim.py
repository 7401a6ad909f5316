"""Fill-in-middle: texts cut at two places drawn from their ids, by a sparse index of byte and code-point offsets.

While the code points of a batch of texts are counted, the count is kept at every STEP-th byte. A cut, given in code
points, is found by binary search among these checkpoints and a look at the STEP bytes after one: no text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from . import common

#: Bytes from one checkpoint to the next, cuts that are looked for at once, and bytes of text that are held at once.
STEP, LOOKUPS, BATCH_BYTES = 256, 4096, 8 << 20
#: Per cent of texts that are cut, and of these the ones with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_P, _S, _M = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))


class Checkpoints:
    """Of a buffer of UTF-8: how many code points start before each STEP-th byte."""

    def __init__(self, data: np.ndarray, step: int = STEP):
        self.step, self.size = step, len(data)
        self.first = np.zeros(-(-max(1, len(data)) // step) * step, bool)  # where code points start
        self.first[: len(data)] = (data & 0xC0) != 0x80
        self.blocks = self.first.reshape(-1, step)
        self.points = np.concatenate(([0], np.cumsum(self.blocks.sum(axis=1, dtype=np.int64))))

    def before(self, at: np.ndarray) -> np.ndarray:
        """Code points that start before each byte offset."""
        out = np.empty(len(at), np.int64)
        for lo in range(0, len(at), LOOKUPS):
            block, rest = np.divmod(at[lo : lo + LOOKUPS], self.step)
            inside = self.blocks[np.minimum(block, len(self.blocks) - 1)] & (np.arange(self.step) < rest[:, None])
            out[lo : lo + LOOKUPS] = self.points[block] + inside.sum(axis=1)
        return out

    def byte_of(self, number: np.ndarray) -> np.ndarray:
        """Where the code point of each number (from 0) starts; the buffer's size for those after the last."""
        out = np.full(len(number), self.size, np.int64)
        for lo in range(0, len(number), LOOKUPS):
            n = number[lo : lo + LOOKUPS]
            block = np.searchsorted(self.points, n, "right") - 1
            there = np.flatnonzero(block < len(self.blocks))
            # of the block, the first byte by which one more code point has started than come before the wanted one
            seen = np.cumsum(self.blocks[block[there]], axis=1)
            wanted = (n[there] - self.points[block[there]])[:, None]
            out[lo + there] = block[there] * self.step + (seen <= wanted).sum(axis=1)
        return out


def _transformer(seed_at: int, rate: int, suffix_first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = pc.fill_null(b.column(seed_at + 1).cast(pa.binary()), b"")
            for lo, hi in common.pieces(column, BATCH_BYTES):
                texts = column[lo:hi]
                draws = np.frombuffer(b"".join(x.as_py() for x in b.column(seed_at)[lo:hi]), ">u4").reshape(hi - lo, -1)[:, :4].astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in b.columns[:seed_at]), *_cut(texts, draws, rate, suffix_first)], [*b.schema.names[:seed_at], *ADDED])

    return common.releasing(run)


def _cut(texts: pa.Array, draws: np.ndarray, rate: int, suffix_first: int) -> list[pa.Array]:
    data, ends = vectors.raw_bytes(texts)
    index = Checkpoints(data)
    points = index.before(ends)
    n = np.diff(points)
    one, two = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    taken = np.zeros(len(n), bool)
    for sentinel in (_P, _S, _M):
        taken |= np.asarray(pc.match_substring(texts, sentinel), bool)
    plain = (n == 0) | taken | (draws[:, 2] % 100 >= rate)
    spm = ~plain & (draws[:, 3] % 100 < suffix_first)
    cuts = [np.clip(index.byte_of(points[:-1] + k), ends[:-1], ends[1:]) for k in (low, high)]
    cuts[0][low == 0] = ends[:-1][low == 0]
    raw, out = data.tobytes(), []
    for is_plain, is_spm, start, a, z, end in zip(plain.tolist(), spm.tolist(), ends[:-1].tolist(), cuts[0].tolist(), cuts[1].tolist(), ends[1:].tolist()):
        if is_plain:
            out.append(raw[start:end])
        elif is_spm:
            out.append(b"".join((_S, raw[z:end], _P, raw[start:a], _M, raw[a:z])))
        else:
            out.append(b"".join((_P, raw[start:a], _S, raw[z:end], _M, raw[a:z])))
    forms = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    return [pa.array(n), pa.array(forms.tolist(), pa.string()), pa.array(low, mask=plain), pa.array(high - low, mask=plain), pa.array(out, pa.binary()).view(pa.string())]


ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def transform(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs and n (code points), form, prefix_chars, middle_chars, output.

    `rate` per cent of texts are cut in three, `suffix_first` per cent of these with the suffix first (form spm, else psm).
    Draws come from the SHA-256 of seed and id, so repeated ids draw alike, and a null id draws as an empty one. Null and
    empty texts and those that hold a sentinel stay as they are (form plain; prefix_chars and middle_chars null; the
    output of a null text is empty). In bytes that aren't UTF-8 every byte but 0x80-0xBF counts as a code point. Columns
    of docs with the added names are replaced; an empty table gives no rows. No shuffle; BATCH_BYTES of text at once, one text at least.
    """
    kept = docs.drop(*ADDED)
    drawn = F.unhex(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit(""))).cast("binary"), 256))
    seed_name, text_name = common.fresh(docs, "_draws"), common.fresh(docs, "_text")
    raw = docs.select(*[docs[c] for c in kept.columns], drawn.alias(seed_name), docs[text_col].alias(text_name))
    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, k) for c, k in zip(ADDED, kinds))])
    return raw.mapInArrow(_transformer(len(kept.columns), rate, suffix_first), schema)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of. Texts with sentinels are plain, so each stands once in the others."""

    def part(after: str, upto: str | None) -> Column:
        rest = F.substring_index(output, after, -1)
        return rest if upto is None else F.substring_index(rest, upto, 1)

    psm = F.concat(part(PREFIX, SUFFIX), part(MIDDLE, None), part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), part(MIDDLE, None), part(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS h1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS h2, CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM d),
c AS (SELECT *, least(h1, h2) AS a, greatest(h1, h2) AS z, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, z - a) AS mid, substr(t, z + 1) AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN z - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
ORACLES = {"op11_fill_in_middle": _SQL}
