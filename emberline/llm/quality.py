"""Quality rules: word and line counts of whole texts, and zstandard compression bands over documents and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from emberline.llm.shingles import WordHashes
from emberline.llm.tables import slices, text_bytes, without

# Ratio of compressed to plain bytes that a text of at least so many bytes may have: (bytes, lowest, highest).
# Short texts carry frame overhead and little context, so their band is wide; a long text may repeat itself more.
DOCUMENT_BANDS = [(0, 0.3, 1.15), (256, 0.25, 0.92), (512, 0.25, 0.82), (1024, 0.25, 0.74), (4096, 0.22, 0.70), (65_536, 0.08, 0.68)]
CHUNK_SIZES = [(0, 512), (4096, 1024), (16_384, 4096)]  # a text of at least so many bytes is cut into chunks of so many
SHORTEST_CHUNK = 256  # a shorter rest belongs to the chunk before it
CHUNK_BANDS = [(256, 0.35, 0.92), (512, 0.33, 0.82), (1024, 0.28, 0.74), (4096, 0.22, 0.70)]  # by the chunk's length
BAD_SHARE = 0.4  # of a text's bytes that may lie in chunks below, or above, their band
LEVEL = 3
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, ratio double, n_chunks long, n_low_bytes long, n_high_bytes long"
_SYMBOLS = b"#*$%&|<>"
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_TAILS = bytes(range(0x80, 0xC0))


def repeated_window_words(words: list[bytes], memo: WordHashes) -> int:
    """Words inside a 3-word window that occurs at least twice in the text, its first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    ids = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    key = ids[:-2] * np.uint64(0x9E3779B97F4A7C15) + ids[1:-1]
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= again
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


def chunks(text: bytes) -> list[bytes]:
    """Fixed chunks of a text, their size by its length; none for a text shorter than the shortest chunk."""
    size = [c for least, c in CHUNK_SIZES if least <= len(text)][-1]
    ends = [i for i in range(size, len(text), size) if len(text) - i >= SHORTEST_CHUNK]
    return [text[i:j] for i, j in zip([0, *ends], [*ends, len(text)])] if len(text) >= SHORTEST_CHUNK else []


def measure(text: bytes, memo: WordHashes, packer: zstandard.ZstdCompressor) -> tuple:
    words = text.split()
    plain = text.translate(None, _SPACES)
    parts = [(len(c), len(packer.compress(c)) / len(c)) for c in chunks(text)]
    bands = [next((lo, hi) for least, lo, hi in reversed(CHUNK_BANDS) if least <= n) for n, _ in parts]
    return (
        len(words),
        len(plain.translate(None, _TAILS)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        duplicate_lines(text),
        repeated_window_words(words, memo),
        len(text),
        len(packer.compress(text)) / len(text) if text else None,
        len(parts),
        sum(n for (n, r), (lo, _) in zip(parts, bands) if r < lo),
        sum(n for (n, r), (_, hi) in zip(parts, bands) if r > hi),
    )


def _measured(schema: pa.Schema):
    """Task function: the input rows with the measures beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, packer = WordHashes(), zstandard.ZstdCompressor(level=LEVEL)
        for batch in slices(batches):
            columns = zip(*[measure(t, memo, packer) for t in text_bytes(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, f.type) for c, f in zip(columns, schema)]], names=[*batch.schema.names, *schema.names])

    return run


def quality_rules(docs: DataFrame) -> DataFrame:
    """Adds the counts, the compression measures, base_failed and kept to every row; nothing is dropped here.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows. kept: not base_failed,
    the whole text's compression ratio inside the band of its length, and at most BAD_SHARE of its bytes in chunks whose
    ratio is below (or above) the band of the chunk's length. Chunks have 512, 1024 or 4096 bytes by the text's length
    and cover all of it; a text under 256 bytes has none.

    A null or empty text has no word, so it fails; its ratio is null. Repeated rows are judged one by one, ties cannot
    arise, an empty table gives an empty result. Extra columns pass through; input columns named like an output
    column give way to it. Very long texts are measured whole, a few hundred rows at a time.
    """
    fields = [f.split() for f in MEASURES.split(", ")]
    schema = pa.schema([(name, pa.float64() if kind == "double" else pa.int64()) for name, kind in fields])
    docs = without(docs, [*schema.names, "base_failed", "kept"])
    out = StructType([*docs.schema.fields, *[StructField(name, DoubleType() if kind == "double" else LongType()) for name, kind in fields]])
    measured = docs.mapInArrow(_measured(schema), out)
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for least, lo, hi in DOCUMENT_BANDS:
        low, high = F.when(F.col("n_bytes") >= least, lo).otherwise(low), F.when(F.col("n_bytes") >= least, hi).otherwise(high)
    banded = F.coalesce(F.col("ratio").between(low, high), F.lit(False))
    chunked = (F.col("n_low_bytes") <= BAD_SHARE * F.col("n_bytes")) & (F.col("n_high_bytes") <= BAD_SHARE * F.col("n_bytes"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & banded & chunked)
