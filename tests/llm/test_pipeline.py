"""The corpus pipeline stage by stage against brute force, each stage on what its predecessor wrote."""

import random
from collections import Counter, defaultdict

import brute
import corpus_pipeline
import duckdb
import pytest

from emberline.llm import lines, mixing, quality
from test_operators import DOCS, edited, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    texts = []
    for i in range(90):
        body = prose(rng.randint(60, 240), rng)
        texts += [body] if i % 5 else [body, body, edited(body, 0.01, rng)]
    texts = [f"{t}\nAll rights reserved" if i % 4 == 0 else t for i, t in enumerate(texts)]
    texts += [None, "", "short text", "again and again " * 60]
    rows = [(i, t, "en", [None, "a", "b", "b"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([*rows, rows[1]], DOCS).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def rows(df):
    return [tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in df.collect()]


def test_stages(spark, corpus, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "packing"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    before, seen = rows(docs), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, corpus)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
            seen.append(rows(docs))
    judged, cleaned, single, mixed = seen
    ok = lambda t: brute.kept_by_quality(t, quality)
    assert Counter(judged) == Counter(r for r in before if ok(r[1])) and len(judged) > 100
    lined = brute.boilerplate([(r[1], r[3]) for r in judged], lines.MAX_RATIO, lines.MIN_PAGES)
    assert Counter((r[0], r[1], r[4]) for r in cleaned) == Counter((r[0], t, len(t) if cut else r[4]) for r, (t, _, cut) in zip(judged, lined))
    assert any(cut for *_, cut in lined)
    groups = brute.near_duplicates({r[0]: r[1] for r in cleaned}.items(), 5, 80)
    assert Counter(r[0] for r in single) == Counter({root for _, root in groups.values()}) and len(single) < len(cleaned)
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(single, DOCS).toPandas())
    taken = con.execute(f"SELECT doc_id, taken // size FROM ({mixing.ORACLE}) WHERE taken > 0").fetchall()
    assert Counter(r[0] for r in mixed) == Counter(dict(taken))
    assert {r[1] for r in mixed} <= {r[1] for r in single}
    tokens, windows = Counter(), defaultdict(int)
    for p in docs.collect():
        tokens[p.doc_id, p.doc_tokens] += p.length
        windows[p.sequence_id] = max(windows[p.sequence_id], p.offset + p.length)
    assert {d for d, _ in tokens} == {r[0] for r in mixed} and max(windows.values()) <= 2048
    assert all(n == total * Counter(r[0] for r in mixed)[d] for (d, total), n in tokens.items())


def test_run_is_the_stages_in_a_row(spark, corpus):
    found = corpus_pipeline.run(spark, corpus)
    assert {"doc_id", "ids", "sequence_id", "offset"} <= set(found.columns) and found.count() > 50


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
