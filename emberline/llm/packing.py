"""Sequence packing: tokens of whole documents into windows of fixed length by the online sum-of-squares rule."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from emberline.llm.tables import slices

WINDOW = 2048
END = 1
GRAIN = 8
OPEN_WINDOWS = 16  # held by a task at most; what is in them at its end is laid without the rule
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
PIECES = "doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FLUSH = 2_000_000
_SPECIAL = "<|endoftext|>"
_CUT = re.compile(r"\S(?= \S)")


class Encoder:
    """Byte-level BPE ids of a text as little-endian unsigned 32-bit bytes.

    A text is encoded as a whole; a longer one than ``longest`` characters in parts, so that few ids are Python objects
    at once. It is cut in front of a single space between two characters that are no white space: the vocabulary's word
    pattern always starts a new word there. Texts that spell a special token go through the vocabulary's own library,
    which is loaded for the first of them.
    """

    def __init__(self, vocabulary: str, longest: int = 1_000_000):
        import public_tokenizers
        import tiktoken

        self.library, self.special = public_tokenizers.path(f"{vocabulary}.json"), None
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.longest = longest

    def spelled(self, text: str) -> bytes:
        if self.special is None:
            from tokenizers import Tokenizer

            self.special = Tokenizer.from_file(self.library)
        return np.asarray(self.special.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def parts(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > self.longest and (before := _CUT.search(text, start + self.longest - 1)):
            yield text[start : before.end()]
            start = before.end()
        yield text[start:]

    def __call__(self, text: str) -> bytes:
        if _SPECIAL in text:
            return self.spelled(text)
        return b"".join(np.asarray(self.plain.encode_ordinary(part), "<u4").tobytes() for part in self.parts(text))


class SumOfSquares:
    """Online packing of pieces (doc, start, ids, ...) into windows of ``size`` tokens.

    ``counts[h]`` holds how many open windows are filled to level h (levels of ``grain`` tokens, rounded up). A piece
    goes to the level, or to a new window, that makes the sum of squared counts smallest; among equals the fullest
    level wins. A window whose level is the last one is closed. With ``most`` windows open no further one is begun: the
    piece goes to the best level it fits into, or else it is cut, its head closing a window of the most crowded level,
    which lowers the sum of squares most, and its tail is placed like any piece. So at most ``most`` windows are held.
    """

    def __init__(self, size: int, grain: int, most: int | None = None):
        self.size, self.grain, self.top, self.most = size, grain, -(-size // grain), most
        self.counts = np.zeros(self.top + 1, np.int64)
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(self.top + 1)]  # by level: (tokens, pieces)

    def level(self, tokens: int) -> int:
        return -(-tokens // self.grain)

    def _choice(self, tokens: int) -> int:
        """Level of the window for a piece; 0 for a new one, -1 for a cut."""
        step = self.level(tokens)
        best, cost = 0, (1 - self.size if step == self.top else 2 * int(self.counts[step]) + 1)
        if step < self.top and self.most is not None and self.counts.sum() >= self.most:
            best, cost = -1, np.iinfo(np.int64).max - 1
        last = (self.size - tokens) // self.grain
        if last > 0:
            here = self.counts[1 : last + 1]
            after = self.counts[np.minimum(np.arange(1, last + 1) + step, self.top)]
            change = np.where(here > 0, 2 * (after - here) + 2, np.iinfo(np.int64).max)
            if last + step >= self.top and here[self.top - step - 1 :].any():
                ends = slice(self.top - step - 1, None)
                change[ends] = np.where(here[ends] > 0, 1 - 2 * here[ends], change[ends])
            at = last - 1 - int(np.argmin(change[::-1]))
            if change[at] <= cost:
                best = at + 1
        return best

    def place(self, piece: tuple, tokens: int) -> list[list]:
        """Put a piece of fewer than ``size`` tokens; the pieces of each window this closes."""
        closed = []
        while (best := self._choice(tokens)) < 0:
            crowded = self.top - int(np.argmax(self.counts[::-1]))  # the fullest of the most crowded levels
            held, pieces = self.open[crowded].pop()
            self.counts[crowded] -= 1
            doc, start, ids, *more = piece
            room = min(tokens, self.size - held)
            closed.append([*pieces, (doc, start, ids[: 4 * room], *more)])
            piece, tokens = (doc, start + room, ids[4 * room :], *more), tokens - room
            if not tokens:
                return closed
        held, pieces = (0, [])
        if best:
            held, pieces = self.open[best].pop()
            self.counts[best] -= 1
        held += tokens
        pieces.append(piece)
        if (now := self.level(held)) == self.top:
            return [*closed, pieces]
        self.open[now].append((held, pieces))
        self.counts[now] += 1
        return closed

    def rest(self) -> Iterator[tuple]:
        """Pieces of the windows still open, the fullest windows first."""
        for windows in reversed(self.open):
            for _, pieces in windows:
                yield from pieces


def _packer(window: int, grain: int, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary)
        end = np.asarray([END], "<u4").tobytes()
        packing = SumOfSquares(window, grain, OPEN_WINDOWS)
        sequence = TaskContext.get().partitionId() << 33
        out, pending = [], 0

        def flush() -> pa.RecordBatch:
            doc, start, ids, total, seq, offset = zip(*out)
            lengths = np.array([len(b) // 4 for b in ids], np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)
            crcs = pa.array([zlib.crc32(b) for b in ids], pa.int64())
            whole = lambda x: pa.array(x, pa.int64())
            return pa.RecordBatch.from_arrays([whole(doc), whole(start), whole(lengths.astype(np.int64)), lists, crcs, whole(total), whole(seq), whole(offset)], schema=_OUT)

        def lay(pieces: list) -> None:
            """One window: its pieces one behind the other."""
            nonlocal sequence, pending
            offset = 0
            for doc, start, ids, total in pieces:
                out.append((doc, start, ids, total, sequence, offset))
                offset += len(ids) // 4
            sequence += 1
            pending += offset

        for batch in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text or "") + end
                total = len(ids) // 4
                full = total // window * window
                for start in range(0, full, window):
                    lay([(doc, start, ids[4 * start : 4 * (start + window)], total)])
                if full < total:
                    for closed in packing.place((doc, full, ids[4 * full :], total), total - full):
                        lay(closed)
                if pending >= _FLUSH:
                    yield flush()
                    out, pending = [], 0
        # the few windows open at the end share new ones, by further cuts, so at most one window is padded
        tail, room = [], window
        for doc, start, ids, total in packing.rest():
            while ids:
                take, ids = ids[: 4 * room], ids[4 * room :]
                tail.append((doc, start, take, total))
                start += len(take) // 4
                room -= len(take) // 4
                if not room:
                    lay(tail)
                    tail, room = [], window
        if tail:
            lay(tail)
        if out:
            yield flush()

    return run


def pack(docs: DataFrame, window: int = WINDOW, grain: int = GRAIN, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Pieces of all documents in windows of ``window`` tokens: PIECES, one row per piece; ids hold the tokens.

    A document is its tokens and the end id. What fills whole windows is cut off first; the remainder is placed by the
    sum-of-squares rule over levels of ``grain`` tokens, with OPEN_WINDOWS windows open at most. Every Spark task packs
    the stream of its own split, so nothing is shuffled and memory is bounded by those windows; the ones open at the
    end of a split are laid anew with cuts. A task that runs again gives the same pieces.

    A null or empty text is the end id alone. A null doc_id is kept. Repeated rows are packed once per row, an empty
    table gives no piece. Other input columns, clashing names included, are not carried over.
    """
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_packer(window, grain, vocabulary), PIECES)
