"""Language identification, conversation repair and whitening against plain versions on small tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import conversations, languages, whitening
from emberline.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def held_out(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 4 == 2


def folded(text):
    letters = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "")
    return " " + " ".join(letters.split()) + " " if letters.split() else " "


def bucket(gram):
    mask, value = 2**32 - 1, 0
    for n, c in enumerate(gram, 1):
        value = ((value + n) * 0x9E3779B1 + ord(c)) & mask
    mixed = (value ^ value >> 15) * 0x85EBCA77 & mask
    return ((mixed ^ mixed >> 13) * 0xC2B2AE3D & mask) >> 16


def grams(text):
    own = folded(text)
    return [bucket(own[i : i + n]) for n in range(1, 5) for i in range(len(own) - n + 1)]


def naive_bayes(rows):
    """[(lang_pred, score)] of (doc_id, text, lang) rows."""
    counts, rows_of = defaultdict(Counter), Counter()
    for doc_id, text, lang in rows:
        if lang is not None and not held_out(doc_id):
            counts[lang].update(grams(text))
            rows_of[lang] += 1
    out = []
    for _, text, _ in rows:
        if not any(map(str.isalpha, text or "")):
            out.append(("und", 0.0))
            continue
        own, joint = grams(text), {}
        for lang in sorted(rows_of):
            total = sum(counts[lang].values()) + languages.SMOOTHING * languages.BUCKETS
            joint[lang] = math.log(rows_of[lang] / sum(rows_of.values())) + sum(math.log((counts[lang][g] + languages.SMOOTHING) / total) for g in own)
        best = max(joint, key=joint.get)
        out.append((best, 1 / sum(math.exp(v - joint[best]) for v in joint.values())))
    return out


def language_rows():
    rng = random.Random(2)
    syllables = {"aa": "ba be lo ni tu", "bb": "schu ver keit öß ung", "ccc": "ção nh ão ri que"}
    rows = []
    for i in range(120):
        lang = ["aa", "bb", "ccc"][i % 3]
        parts = [rng.choice(syllables[lang].split()) for _ in range(rng.choice([1, 3, 40, 400]))]
        rows.append((i, rng.choice([" ", "", "-"]).join(parts).capitalize() + ".", lang if i % 7 else None))
    odd = [(500, None, "aa"), (501, "", "bb"), (502, "123 !?", None), (503, "Ǆ Σς 漢字 İ", "ccc"), (None, "ba be lo", "aa"), (None, None, None), (3, rows[3][1], "bb")]
    return [*rows, *odd, rows[0], rows[0], (600, "ver keit " * 3000 + "  " * 900, "bb")]


@pytest.mark.parametrize("points", [languages.POINTS, 7])
def test_languages(spark, monkeypatch, points):
    monkeypatch.setattr(languages, "POINTS", points)
    rows = language_rows() if points > 7 else [r for r in language_rows() if len(r[1] or "") < 3000]
    df = spark.createDataFrame([(*r, j, "x", "y") for j, r in enumerate(rows)], "doc_id long, text string, lang string, j int, lang_pred string, Score string")
    got = {r.j: r for r in languages.identify_languages(df).collect()}
    assert len(got) == len(rows) and list(got[0].asDict()) == ["doc_id", "text", "lang", "j", "held_out", "lang_pred", "score"]
    for j, (want, row) in enumerate(zip(naive_bayes(rows), rows)):
        assert got[j].held_out == held_out(row[0])
        assert got[j].score == pytest.approx(want[1], abs=1e-3)
        assert got[j].lang_pred == want[0] or want[1] < 0.51


def test_languages_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert languages.identify_languages(df).collect() == []
    one = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in languages.identify_languages(one).collect()] == [("und", 0.0)]


def test_language_accuracy(spark):
    found = QUERIES["op11_naive_bayes_language"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = found.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def after_damage(rows):
    """{conv_id: [(turn, role, text)] in order}; every conversation has an entry."""
    out = {c: [] for c, *_ in rows}
    blank = lambda x: " " if x is None else x
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out[conv] += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    return out


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("b" if not solid else "d" if (role, text) in seen else "-" if solid[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def every_repair(rows, marks):
    """(cost, audit, lines) of the cheapest of all edit sequences with up to two inserted turns a gap."""
    gaps = [[("I", 2, r, "") for r in combo] for k in range(3) for combo in itertools.product(["user", "assistant"], repeat=k)]
    choices = [gaps]
    for (_, role, text), mark in zip(rows, marks):
        own = [[("D", 3, None, None)]]
        if mark not in "bd":
            extra = mark == "t"
            own += [[("K", extra, role, text)], *([("R", 2 + extra, r, text)] for r in ("user", "assistant"))]
        choices += [own, gaps]
    best = None
    for combo in itertools.product(*choices):
        edits = [e for part in combo for e in part]
        if re.fullmatch("(s?(ua)+)?", "".join((e[2] or "~")[:1] if e[0] != "D" else "" for e in edits)):
            found = (sum(e[1] for e in edits), "".join(e[0] for e in edits), [f"{e[2]}:{e[3]}" for e in edits if e[0] != "D"])
            best = found if best is None else min(best, found)
    return best


def by_relaxation(rows, marks):
    """The same for longer conversations: all ways to every (row, roles so far mod pattern) relaxed until nothing changes."""
    best = {(0, "0"): (0, "", ())}
    step = {"0": "su", "s": "u", "u": "a", "a": "u"}
    changed = True
    while changed:
        changed = False
        for (i, state), (cost, audit, lines) in list(best.items()):
            offers = [((i, r), (cost + 2, audit + "I", (*lines, f"{conversations.NAMES[r]}:"))) for r in step[state] if r != "s"]
            if i < len(rows):
                _, role, text = rows[i]
                offers.append(((i + 1, state), (cost + 3, audit + "D", lines)))
                if marks[i] not in "bd":
                    extra = marks[i] == "t"
                    if role[:1] and role[:1] in step[state]:
                        offers.append(((i + 1, role[0]), (cost + extra, audit + "K", (*lines, f"{role}:{text}"))))
                    offers += [((i + 1, r), (cost + 2 + extra, audit + "R", (*lines, f"{conversations.NAMES[r]}:{text}"))) for r in step[state] if r != "s"]
            for at, offer in offers:
                if at not in best or offer[:2] < best[at][:2]:
                    best[at], changed = offer, True
    return min((best[len(rows), s] for s in "0a" if (len(rows), s) in best), key=lambda b: b[:2])


def conversation_rows():
    rng = random.Random(4)
    rows = []
    texts = ["Hello.", "hello", "Fine!", "", " \t", None, "why?", "End . \n", "No end,", "long " * 2000 + "."]
    for conv in [*range(60), None]:
        n = rng.choice([1, 2, 3, 3, 4, 6, 12])
        for turn in range(n):
            role = rng.choice(["user", "assistant", "user" if turn % 2 == 0 else "assistant", "system" if turn == 0 else "user", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None]), role, rng.choice(texts)))
    rows += [(77, t, ["user", "assistant"][t % 2], f"Part {t % 9}{'.' if t % 5 else ''}") for t in range(300)]
    return [*rows, *rows[:5], rows[0]]


@pytest.mark.parametrize("piece", [conversations.PIECE, 7])
def test_repair(spark, monkeypatch, piece):
    monkeypatch.setattr(conversations, "PIECE", piece)
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, h int").repartition(5)
    got = {r.conv_id: r for r in conversations.repair_conversations(df).collect()}
    want = after_damage(rows)
    assert set(got) == set(want)
    for conv, own in want.items():
        marks, r = faults(own), got[conv]
        turns = [t for t, *_ in own if t is not None]
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert (r.blank, r.duplicate, r.truncated) == tuple(marks.count(m) for m in "bdt")
        assert r.illegal == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = by_relaxation(own, marks)
        if len(own) <= 3:
            assert (cost, audit, list(lines)) == every_repair(own, marks)
        assert (r.cost, r.audit) == (cost, audit)
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "tool", "Out."), (2, 0, "system", "Be."), (3, 0, "assistant", "Yes?"), (3, 1, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, conversations.repaired_turns(df).collect()))
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn, role, " " if text is None else text))
    want = []
    for conv, turns in own.items():
        _, audit, lines = by_relaxation(turns, faults(turns))
        want += [(conv, i, e, *line.split(":", 1)) for i, (e, line) in enumerate(zip(audit.replace("D", ""), lines))]
    assert got == sorted(want)


def test_repair_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversations.repair_conversations(spark.createDataFrame([], schema)).collect() == []
    gone = next(i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (r,) = conversations.repair_conversations(spark.createDataFrame([(gone, 0, "user", "x")], schema)).collect()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def vectors():
    rng = np.random.default_rng(3)
    mix = rng.standard_normal((40, 40)) * np.linspace(3, 0.2, 40)
    rows = [(i, (rng.standard_normal(40) @ mix).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(100)]
    rows += [(400 + i, rng.standard_normal(5).tolist()) for i in range(30)]
    odd = [None, [], [1.0, None] * 20, [float("nan")] * 40, [float("inf")] * 40, [0.5, 0.25, 7.0]]
    return rows + [(500 + i, v) for i, v in enumerate(odd)] + [(None, rows[1][1])]


def whitened(rows, components=16):
    """{(row number): (n, deviation, projections, explained)} by numpy's dense solver."""
    usable = {j: np.floor(64 * np.array(v)).astype(np.int64) + 1_000_000 for j, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for dim in {len(x) for x in usable.values()}:
        own = {j: x for j, x in usable.items() if len(x) == dim}
        fit = np.array(sorted({tuple(x.tolist()) for x in own.values()}))
        n, sums = len(fit), [int(s) for s in fit.sum(0)]
        centred = (fit * n - np.array(sums)) / n
        values, axes = np.linalg.eigh(centred.T @ centred / n)
        values, axes = values[::-1], axes[:, ::-1]
        some = [i for i in range(min(components, dim)) if values[i] > 1e-10 * max(values[0], 1e-300)]
        for j, x in own.items():
            exact = sum((n * int(a) - s) ** 2 for a, s in zip(x, sums))
            out[j] = (n, exact, ((x * n - np.array(sums)) / n) @ axes[:, some] / np.sqrt(values[some]), values[some] / max(values.sum(), 1e-300))
    return out


def test_whitening(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, j, "mine") for j, (i, v) in enumerate(rows)], "vec_id long, embedding array<float>, j int, n string").repartition(6)
    rows = [(r.vec_id, r.embedding) for r in sorted(df.collect(), key=lambda r: r.j)]
    got = {r.j: r for r in whitening.whiten(df).collect()}
    want = whitened(rows)
    assert set(got) == set(want)
    for j, (n, deviation, projections, explained) in want.items():
        r = got[j]
        assert (r.n, r.deviation) == (n, deviation)
        assert np.allclose(np.abs(r.whitened), np.abs(projections), atol=1e-8)
        assert np.allclose(r.explained, explained, rtol=1e-9) and r.identity_error < 1e-9
    assert len(got[0].whitened) == 16 and len(got[400].whitened) == 5 and len(got[435].whitened) == 0


def test_whitening_of_extremes(spark):
    """Entries far beyond a long's squares: exact integers, null where a long cannot hold the deviation."""
    rows = [(i, [3e38 * (i % 2), float(i), -float(i * i)]) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 6 and all(r.deviation is None and r.n == 6 for r in got)
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_eigenpairs_with_a_flat_spectrum():
    rng = np.random.default_rng(1)
    axes = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    values = np.sort(np.r_[np.repeat(5.0, 4), np.linspace(4.9, 0.01, 86)])[::-1]
    matrix = axes * values @ axes.T
    found, vectors_, residual = whitening.leading_eigenpairs(lambda q: matrix @ q, 90)
    assert np.allclose(found, values[:16], atol=1e-11) and residual.max() < 1e-12
    assert np.allclose(vectors_.T @ vectors_, np.eye(16), atol=1e-12)


def test_queries(spark):
    assert QUERIES["op13_chebyshev_whitening"](spark, SMALL).columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert QUERIES["op12_lightest_repair"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id").distinct().count()
