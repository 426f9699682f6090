"""Secret scan: candidate strings of whole texts, and a random forest that tells secrets from false positives."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.tables import cut, is_empty, slices

RUN_LENGTH = 16  # token characters in a row that are a candidate without further signs
DICTIONARY_SHARE = 0.005  # a dictionary word is in that share of all rows, so there are few hundred times a row's words
TRAIN_ROWS = 20_000  # labelled findings of either class used to fit
TREES, DEPTH = 40, 8
KEYWORDS = ("token", "password", "passwd", "secret", "apikey", "api_key", "access_key", "auth", "credential", "private_key")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+={0,2}" % RUN_LENGTH)
# any value of four characters or more behind a keyword, and the password in the user-info of a url
_VALUE = re.compile(r"(?i)(?:%s)[\"']?\s{0,8}[=:]\s{0,8}(?:\"([^\"\s]{4,})|'([^'\s]{4,})|([^\s\"'][^\s]{3,}))" % "|".join(KEYWORDS))
_USER = re.compile(r"://[^\s/:@]{1,256}:([^\s/@]{1,1024})@")
_DIGEST = re.compile(r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}")
_NATURAL = re.compile(r"[A-Za-z][a-z]+(?:-[A-Za-z]?[a-z]+)*")
_ISSUED = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{20,}")
_ASSIGNED = re.compile(r"[=:]\s*[\"']?$")
_WORDS = re.compile(r"[^\W\d]+")
FEATURES = ["length", "digits", "upper", "lower", "marks", "changes", "entropy", "transition", "dictionary", "quoted", "assigned", "keyword", "path", "before", "after"]
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("value_hash", pa.int64()), ("label", pa.int32()), *[(f, pa.float64()) for f in FEATURES]])
_DDL = "doc_id long, start long, end long, value_hash long, label int, " + ", ".join(f"{f} double" for f in FEATURES)


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(65_536, np.int64)
    for batch in slices(batches):
        joined = "\n".join(t for t in batch.column("text").to_pylist() if t).lower().encode()
        at = np.frombuffer(joined, np.uint8).astype(np.int32)
        total += np.bincount(at[:-1] * 256 + at[1:], minlength=65_536)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["pair", "n"])


def transitions(docs: DataFrame) -> np.ndarray:
    """Log probability of each byte after each other in the lower-cased corpus, from counts over all texts (65,536 at most)."""
    counts = np.ones(65_536)
    for pair, n in docs.select("text").mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        counts[pair] += n
    square = counts.reshape(256, 256)
    return np.log(square / square.sum(1, keepdims=True))


def dictionary(docs: DataFrame, share: float = DICTIONARY_SHARE) -> frozenset[str]:
    """Words of 3 to 12 letters in at least ``share`` of all rows: at most (mean distinct words of a row) / share words."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: F.length(x).between(3, 12)))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return frozenset(r[0] for r in counted.where(F.col("n") >= max(2, math.ceil(share * docs.count()))).select("word").collect())


def _covered(value: str, known: frozenset[str]) -> float:
    """Share of the value's characters that the longest dictionary words, taken from the left, cover."""
    low, at, hit = value.lower(), 0, 0
    while at < len(low):
        step = next((k for k in range(min(12, len(low) - at), 2, -1) if low[at : at + k] in known), 0)
        hit += step
        at += step or 1
    return hit / len(value)


def candidates(text: str) -> list[tuple[int, int]]:
    """Places of all candidates, in order: values behind a keyword or in a url's user-info, then runs that touch none."""
    spans = []
    for pattern in (_VALUE, _USER):
        for m in pattern.finditer(text):
            start, end = next(m.span(i) for i in range(1, m.re.groups + 1) if m[i] is not None)
            end = start + len(text[start:end].rstrip(".,;:!?)]}>"))
            if end - start >= (4 if pattern is _VALUE else 1):
                spans.append((start, end))
    taken, at = [], 0
    for span in sorted(spans):
        if span[0] >= at:
            taken.append(span)
            at = span[1]
    out, i = list(taken), 0
    for m in _RUN.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i == len(taken) or taken[i][0] >= m.end():
            out.append(m.span())
    return sorted(out)


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def features(text: str, start: int, end: int, path: str | None, logs: np.ndarray, known: frozenset[str]) -> tuple[int | None, list[float]]:
    """Label (1 secret, 0 not, None unknown) and FEATURES of one candidate.

    Labels need evidence that settles the matter: an issued format, or a digest's length in hex behind an assigned
    keyword, for secrets; a checksum of digits, an address around it or a plain word for false positives. Everything
    else - passwords, mixed runs, odd numbers - has no label and is the forest's to judge.
    """
    value = text[start:end]
    left, right = text[max(0, start - 64) : start], text[end : end + 48]
    behind, ahead = _WORDS.findall(left.lower()), _WORDS.findall(right.lower())
    raw = np.frombuffer(value.lower().encode(), np.uint8)
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in value]
    share = [kinds.count(k) / len(value) for k in range(4)]
    counts = np.unique(raw, return_counts=True)[1] / len(raw)
    keyword = any(w in KEYWORDS for w in behind[-2:])
    assigned = bool(_ASSIGNED.search(left))
    label = None
    if _ISSUED.fullmatch(value) or (keyword and assigned and _DIGEST.fullmatch(value)):
        label = 1
    elif not keyword and (right.startswith("@") or left.endswith("@") or _NATURAL.fullmatch(value) or (value.isascii() and value.isdigit() and 13 <= len(value) <= 19 and _luhn(value))):
        label = 0
    bucket = lambda w: float(zlib.crc32(w.encode()) % 32)
    return label, [
        float(len(value)),
        *share,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, len(value) - 1),
        float(-(counts * np.log2(counts)).sum()),
        float(logs[raw[:-1], raw[1:]].mean()) if len(raw) > 1 else 0.0,
        _covered(value, known),
        float(left[-1:] in ("'", '"') and left[-1:] != ""),
        float(assigned),
        float(keyword),
        bucket(path or ""),
        bucket(behind[-1]) if behind else -1.0,
        bucket(ahead[0]) if ahead else -1.0,
    ]


def _scanner(logs: np.ndarray, known: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, text, path in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "path"))):
                for start, end in candidates(text or ""):
                    label, measured = features(text, start, end, path, logs, known)
                    rows.append((doc, start, end, zlib.crc32(text[start:end].encode()), label, *measured))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_SCHEMA), _SCHEMA)], schema=_SCHEMA)

    return run


def find_candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """Every candidate of every text: place in code points, FEATURES, label where known.

    Candidates are wide, as the forest is there to remove the false ones: RUN_LENGTH or more token characters in a row,
    any value of four or more characters behind an assigned keyword, and passwords in urls.
    """
    logs, known = transitions(docs), dictionary(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(f"`{path}`").cast("string").alias("path")).mapInArrow(_scanner(logs, known), _DDL)


def _vectors(findings: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(findings)


def train(findings: DataFrame, rows: int = TRAIN_ROWS) -> RandomForestClassificationModel | None:
    """Random forest on labelled findings (label 0 or 1, FEATURES): up to ``rows`` of either class, by hash of the value.

    The sample is one sorted partition, so the same findings give the same forest. None without both classes.
    """
    order = F.xxhash64("value_hash")
    sample = [findings.where(F.col("label") == k).orderBy(order, "doc_id", "start").limit(rows) for k in (0, 1)]
    if any(is_empty(s) for s in sample):
        return None
    fixed = cut(sample[0].unionByName(sample[1]).coalesce(1).sortWithinPartitions(order, "doc_id", "start"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, featuresCol="features", labelCol="label", cacheNodeIds=False)
    return forest.fit(_vectors(fixed).withColumn("label", F.col("label").cast("double")))


def score(findings: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Adds probability (null without a model) and is_secret; a finding without a model goes by its label."""
    if model is None:
        return findings.withColumn("probability", F.lit(None).cast("double")).withColumn("is_secret", F.coalesce(F.col("label") == 1, F.lit(False)))
    scored = model.transform(_vectors(findings)).withColumn("probability", vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "prediction").withColumn("is_secret", F.col("probability") >= 0.5)


def scan_secrets(docs: DataFrame, path: str = "source") -> DataFrame:
    """Findings (doc_id, start, end, FEATURES, label, probability, is_secret) of all documents, one row per candidate.

    The forest is trained on the labelled findings of the same corpus and judges all findings, labelled or not.
    A null or empty text has no finding, a null path or id is kept as such, repeated rows repeat their findings, an
    empty table gives none. Other input columns are not carried over. Very long texts are scanned whole in linear time.
    """
    findings = cut(find_candidates(docs, path))
    return score(findings, train(findings))
