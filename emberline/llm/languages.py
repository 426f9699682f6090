"""Language identification: multinomial naive Bayes over hashed character n-grams, scored in numpy batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.tables import slices, without

LONGEST = 4  # n-grams of 1 to LONGEST folded characters
BUCKETS = 1 << 16
MATRIX_BYTES = 64 << 20  # bound of the broadcast matrix: more languages get fewer buckets
SMOOTHING = 0.1
POINTS = 1 << 18  # characters folded and hashed at once
UNKNOWN = "und"
_SPACE = 32
_FACTOR = np.uint32(0x9E3779B1)
_SALTS = (np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def folding() -> np.ndarray:
    """Code point -> its lower case if it is a letter, else a space."""
    table = np.full(0x110000, _SPACE, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def _pieces(text: str, fold: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(points, n): folded characters with one space for every run of others and at both ends; n-grams start at the first n.

    A long text comes in pieces that overlap by LONGEST - 1 points, so every n-gram of the text starts in one piece.
    """
    carry = np.array([_SPACE], np.uint32)
    for at in range(0, len(text), POINTS):
        codes = np.frombuffer(text[at : at + POINTS].encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.concatenate([carry, fold[codes]])
        points = points[np.append(True, (points[1:] != _SPACE) | (points[:-1] != _SPACE))]
        if at + POINTS >= len(text):
            if points[-1] != _SPACE:
                points = np.append(points, np.uint32(_SPACE))
            yield points, len(points)
        else:
            n = max(0, len(points) - LONGEST + 1)
            yield points, n
            carry = points[n:]


def _hashed(pieces: list[tuple[np.ndarray, int]], buckets: int) -> Iterator[np.ndarray]:
    """Per n-gram length the bucket of the n-gram at every point of all pieces, ``buckets`` where none starts."""
    points = np.concatenate([p for p, _ in pieces])
    room = np.concatenate([np.arange(len(p), 0, -1) for p, _ in pieces])  # points left in the piece
    starts = np.concatenate([np.arange(len(p)) < n for p, n in pieces])
    value = np.zeros(len(points), np.uint32)
    shift = np.uint32(33 - buckets.bit_length())
    for n in range(1, LONGEST + 1):
        value = (value + np.uint32(n)) * _FACTOR
        value[: len(points) - n + 1] += points[n - 1 :]
        mixed = (value ^ (value >> np.uint32(15))) * _SALTS[0]
        mixed = (mixed ^ (mixed >> np.uint32(13))) * _SALTS[1]
        yield np.where(starts & (room >= n), (mixed >> shift).astype(np.int64), buckets)


def _packs(texts: Iterable[tuple[object, str | None]], fold: np.ndarray) -> Iterator[tuple[list, list[tuple[np.ndarray, int]]]]:
    """(owners, pieces) of about POINTS points each, from (owner, text)."""
    owners, pieces, size = [], [], 0
    for owner, text in texts:
        for piece in _pieces(text or "", fold):
            owners.append(owner)
            pieces.append(piece)
            size += len(piece[0])
            if size >= POINTS:
                yield owners, pieces
                owners, pieces, size = [], [], 0
    if pieces:
        yield owners, pieces


def _counter(fold: Broadcast, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            labelled = sorted(zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()), key=lambda x: x[0])
            for owners, pieces in _packs(labelled, fold.value):
                langs = np.array(owners, object)
                for lang in dict.fromkeys(owners):
                    own = [pieces[i] for i in np.flatnonzero(langs == lang)]
                    total = counts.setdefault(lang, np.zeros(buckets, np.int64))
                    for at in _hashed(own, buckets):
                        total += np.bincount(at, minlength=buckets + 1)[:buckets]
        for lang, total in counts.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used])], names=["lang", "bucket", "n"])

    return run


class Model:
    """languages in code point order, and the log-probability matrix (buckets + 1, languages), its last row zero."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray):
        self.languages = languages
        share = counts + SMOOTHING
        self.weights = np.vstack([np.log(share / share.sum(0)), np.zeros(len(languages))]).astype(np.float32)
        self.prior = np.log(documents / documents.sum())

    def scores(self, texts: list[str | None], fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log joint probabilities (texts, languages), whether a text has a letter)."""
        buckets = len(self.weights) - 1
        joint, lettered = np.tile(self.prior, (len(texts), 1)), np.zeros(len(texts), bool)
        for owners, pieces in _packs(enumerate(texts), fold):
            owners = np.array(owners)
            first = np.cumsum([0, *(len(p) for p, _ in pieces[:-1])])
            for at in _hashed(pieces, buckets):
                np.add.at(joint, owners, np.add.reduceat(self.weights[at], first, axis=0, dtype=np.float64))
            some = np.logical_or.reduceat(np.concatenate([p for p, _ in pieces]) != _SPACE, first)
            np.logical_or.at(lettered, owners, some)
        return joint, lettered


def learn(labelled: DataFrame) -> Model | None:
    """The model of all rows of (text, lang) with a language; None if there is none.

    A task counts its n-grams in one array per language it meets and hands on the buckets in use; the driver gets
    languages x buckets sums, which MATRIX_BYTES bounds.
    """
    spark = labelled.sparkSession
    labelled = labelled.where(F.col("lang").isNotNull()).select("lang", "text")
    rows = labelled.groupBy("lang").agg(F.count("*").alias("rows")).collect()
    if not rows:
        return None
    languages = sorted(r.lang for r in rows)
    buckets = BUCKETS
    while buckets > 256 and 4 * buckets * len(languages) > MATRIX_BYTES:
        buckets //= 2
    place = {lang: i for i, lang in enumerate(languages)}
    fold = spark.sparkContext.broadcast(folding())
    summed = labelled.mapInArrow(_counter(fold, buckets), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((buckets, len(languages)))
    column = np.array([place[x] for x in summed.column("lang").to_pylist()], np.int64)
    counts[summed.column("bucket").to_numpy(), column] = summed.column("n").to_numpy()
    documents = {r.lang: r.rows for r in rows}
    return Model(languages, counts, np.array([documents[x] for x in languages], float))


def _predictor(model: Broadcast, fold: Broadcast):
    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(texts: pa.Array) -> pa.Array:
        own, names, scores = model.value, [], []
        for at in range(0, len(texts), 1024):
            joint, lettered = own.scores(texts.slice(at, 1024).to_pylist(), fold.value)
            share = np.exp(joint - joint.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            best = share.argmax(1)
            names += [own.languages[b] if known else UNKNOWN for b, known in zip(best, lettered)]
            scores.append(np.where(lettered, share[np.arange(len(best)), best], 0.0))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]), pa.float64())], names=["lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred and score (posterior of the predicted language) to every row, from its text alone."""
    docs = without(docs, ["lang_pred", "score"])
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    context = SparkSession.active().sparkContext
    found = _predictor(context.broadcast(model), context.broadcast(folding()))
    return docs.withColumn("__l", found("text")).withColumns({"lang_pred": F.col("__l.lang_pred"), "score": F.col("__l.score")}).drop("__l")


def identify_languages(docs: DataFrame) -> DataFrame:
    """Adds held_out, lang_pred and score to every row (doc_id, text, lang, ...).

    The model learns from the rows with a language whose crc32(doc_id as text) mod 4 is not 2 (a null doc_id counts as
    an empty text); the others are held out. Characters are folded: letters to lower case, runs of anything else to one
    space; n-grams of 1 to 4 of them fall into 65,536 buckets by hash (fewer from 257 languages on, so that the matrix
    stays within 64 MB). Learning and prediction read whole texts in blocks. Languages that tie: the least by code point.

    A text that is null or has no letter is ``und`` with score 0, as is every text if nothing can be learned. Repeated
    rows each count. An empty table gives an empty result. Extra columns pass through; input columns named like an
    output column give way.
    """
    docs = without(docs, ["held_out", "lang_pred", "score"])
    named = F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")
    docs = docs.withColumn("held_out", F.crc32(named) % 4 == 2)
    return predict(docs, learn(docs.where(~F.col("held_out"))))
