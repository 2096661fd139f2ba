"""Fill-in-the-middle samples, cut at line borders by rank and select over packed bits.

The bytes of a batch of texts are one vector. A bit marks the last byte of each line and of each text; the bits are packed
in 64-bit words, with a directory of ones before each block of eight words and one of ones before each word in its block.
The number of lines of a text is the difference of two ranks (ones up to its end and up to its start); the byte at which k
lines have passed is one select. A second vector marks the first byte of each code point: a part's length in code points
is again a difference of ranks. No line is ever built as a string of its own.

The cut points and the form of a document follow from hashes of its id alone, computed in the JVM; so do reruns and lost
tasks. There is no shuffle.

Defined results: null and empty texts have 0 lines and stay plain, as do texts that hold a control string; a null id hashes
like an empty one; equal rows are rows of their own; a text of any length is one row's memory (some three times its bytes);
an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import pieces

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Percent of documents that are rearranged, and of those the percent with the suffix first.
RATE, SUFFIX_FIRST = 100, 50
#: Words (of 64 bits) of a block of the directory.
BLOCK = 8
SAMPLES = "doc_id {id}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary"


class Bits:
    """A packed bit vector with rank and select, both for arrays of arguments."""

    def __init__(self, flags: np.ndarray):
        blocks = len(flags) // (64 * BLOCK) + 1  # one bit of room at least: rank(len(flags)) falls into a word
        raw = np.zeros(blocks * BLOCK * 8, np.uint8)
        packed = np.packbits(flags, bitorder="little")
        raw[: len(packed)] = packed
        self.words = raw.view("<u8")
        counts = np.bitwise_count(self.words).reshape(blocks, BLOCK).astype(np.int64)
        self.before = np.zeros(blocks + 1, np.int64)
        np.cumsum(counts.sum(axis=1), out=self.before[1:])
        self.inside = (counts.cumsum(axis=1) - counts).astype(np.uint16)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        part = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
        return self.before[word // BLOCK] + self.inside[word // BLOCK, word % BLOCK] + part

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the one that has k ones before it."""
        block = np.searchsorted(self.before, k, "right") - 1
        left = k - self.before[block]
        word = (self.inside[block] <= left[:, None]).sum(axis=1) - 1
        left = left - self.inside[block, word]
        bits = np.unpackbits(self.words[block * BLOCK + word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = (bits.cumsum(axis=1) == (left + 1)[:, None]).argmax(axis=1)
        return (block * BLOCK + word) * 64 + bit


def line_bits(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Bits:
    """A one at the last byte of every line; the texts are data[start:end], one after the other."""
    flags = data == 10
    flags[ends[ends > starts] - 1] = True
    return Bits(flags)


def _batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, texts = batch.column("doc_id"), batch.column("text")
    h = [batch.column(f"h{k}").to_numpy() for k in (1, 2)]
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    data, offsets = np.frombuffer(raw, np.uint8), offsets - offsets[0]
    starts, ends = offsets[:-1], offsets[1:]
    lines, points = line_bits(data, starts, ends), Bits((data & 0xC0) != 0x80)
    first = lines.rank(starts)
    n = lines.rank(ends) - first
    cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
    at = np.tile(starts, (2, 1))
    some = cuts > 0
    at[some] = lines.select((first + cuts - 1)[some]) + 1
    # the places of code points: before the text, at both cuts
    ranks = points.rank(np.stack([starts, *at]))
    chars = np.diff(ranks, axis=0)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    form, outputs = batch.column("form").to_pylist(), []
    for k, name in enumerate(form):
        a, x, y, b = starts[k], at[0, k], at[1, k], ends[k]
        if name == "plain":
            outputs.append(bytes(raw[a:b]))
        elif name == "psm":
            outputs.append(b"".join((p, raw[a:x], s, raw[y:b], m, raw[x:y])))
        else:
            outputs.append(b"".join((s, raw[y:b], p, raw[a:x], m, raw[x:y])))
    plain = np.array([name == "plain" for name in form], bool)
    columns = [ids, pa.array(n), batch.column("form"), pa.array(chars[0], mask=plain), pa.array(chars[1], mask=plain), pa.array(outputs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _rearranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in pieces(batch, "text"):
            yield _batch(some)


def fill_in_middle(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """doc_id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars, output: each text rearranged for learning to
    fill in its middle."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digest.alias("digest"))
    h = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]
    held = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | held | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = given.select("doc_id", F.col("text").cast("binary").alias("text"), h[0].alias("h1"), h[1].alias("h2"), form.alias("form"))
    out = rows.mapInArrow(_rearranged, SAMPLES.format(id=docs.schema["doc_id"].dataType.simpleString()))
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Texts with control strings stay plain, so each occurs once in the others,
    and none can arise at a border: a control string has its only < in front and its only > at its end."""
    p, s, m = (F.instr(output, F.lit(x)) for x in (PREFIX, SUFFIX, MIDDLE))
    width = len(PREFIX)
    between = lambda a, b: F.substr(output, a + width, b - a - width)
    rest = F.substr(output, m + width)
    return F.when(form == "psm", F.concat(between(p, s), rest, between(s, m))).when(form == "spm", F.concat(between(p, m), rest, between(s, p))).otherwise(output)


def digests(samples: DataFrame) -> DataFrame:
    """The contract's columns: digests of each output and of the text restored from it."""
    text = restored(F.col("output"), F.col("form"))
    return samples.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))
