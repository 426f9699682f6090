"""Conversation structure repair: lightest derivations from a Knuth agenda, long conversations deduced in pieces."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.tables import WORD, cut, joinable

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
# The roles of a repaired conversation are (s?(ua)+)?: states by the last role, and the state that the next role leads to
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ACCEPTED = (START, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
PIECE = 2048  # rows deduced at once
CACHED = 100_000  # shapes of short conversations whose derivation a task remembers
_BLANK, _DUPLICATE, _TRUNCATED = "bdt"

Lightest = list[tuple[int, str] | None]
COUNTS = ["rows", "blank", "duplicate", "truncated", "illegal", "distinct"]
_PIECES = "conv_id {key}, at long, rows long, blank long, duplicate long, truncated long, illegal long, distinct long, low long, high long, first string, last string, first_turn long, last_turn long, costs array<long>, audits array<string>"
_SUMMARY = "conv_id {key}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def derive(shape: tuple[str, ...], entry: int, whole: bool) -> Lightest:
    """Per state the lightest (cost, audit) that leads from ``entry`` over all rows to it; None where nothing does.

    shape: per row its role's initial and, behind it, the letter of its fault. An item (i, state) says that the first i
    rows are settled and the last role put out is the state's. Every deduction extends one item by one edit: its value is
    (cost + cost of the edit, audit + letter of the edit), never below that of the item it comes from, and rising with
    it, since no two audits of one item and cost begin alike. So items are final in the order in which the agenda yields
    them. ``whole``: stop at the first item that ends a conversation.
    """
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, entry)]
    final: set[tuple[int, int]] = set()
    out: Lightest = [None] * STATES
    while agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == len(shape):
            out[state] = (cost, audit)
            if whole and state in ACCEPTED:
                break
        reach = NEXT[state]
        for role in NAMES:
            if role in reach:
                heapq.heappush(agenda, (cost + INSERT, audit + "I", i, reach[role]))
        if i == len(shape):
            continue
        initial, fault = shape[i][:-1], shape[i][-1]
        heapq.heappush(agenda, (cost + DELETE, audit + "D", i + 1, state))
        if fault in (_BLANK, _DUPLICATE):
            continue
        more = cost + (TRUNCATED if fault == _TRUNCATED else 0)
        if initial in reach:
            heapq.heappush(agenda, (more + KEEP, audit + "K", i + 1, reach[initial]))
        for role in NAMES:
            if role in reach and role != initial:
                heapq.heappush(agenda, (more + REROLE, audit + "R", i + 1, reach[role]))
    return out


def extend(before: Lightest, costs: list[int | None], audits: list[str | None]) -> Lightest:
    """Lightest derivations over a further piece, whose table lists (entry, exit) row by row."""
    out: Lightest = [None] * STATES
    for entry, known in enumerate(before):
        for exit_ in range(STATES):
            cost = costs[STATES * entry + exit_]
            if known is None or cost is None:
                continue
            found = known[0] + cost
            if out[exit_] is None or found <= out[exit_][0]:
                found = (found, known[1] + audits[STATES * entry + exit_])
                out[exit_] = found if out[exit_] is None else min(out[exit_], found)
    return out


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


class _Piece:
    """Rows of one conversation in a row, as one record."""

    def __init__(self, conv_id):
        self.conv_id, self.shape, self.turns = conv_id, [], []

    def record(self, at: int, whole: bool, cache: dict) -> tuple:
        shape, turns = tuple(self.shape), self.turns
        known = [t for t in turns if t is not None]
        faults = [s[-1] for s in shape]
        illegal = sum(a[:-1] + b[:-1] not in LEGAL for a, b in zip(shape, shape[1:]))
        distinct = sum(t is not None and (j == 0 or turns[j - 1] != t) for j, t in enumerate(turns))
        key = (whole, shape)
        table = cache.get(key)
        if table is None:
            rows = [derive(shape, entry, whole) if entry == START or not whole else [None] * STATES for entry in range(STATES)]
            flat = [x for row in rows for x in row]
            table = [x and x[0] for x in flat], [x and x[1] for x in flat]
            if len(shape) <= 32 and len(cache) < CACHED:
                cache[key] = table
        counts = [len(shape), faults.count(_BLANK), faults.count(_DUPLICATE), faults.count(_TRUNCATED), illegal, distinct]
        ends = [min(known, default=None), max(known, default=None), shape[0][:-1], shape[-1][:-1], turns[0], turns[-1]]
        return (self.conv_id, at, *counts, *ends, *table)


def _deducer(schema: pa.Schema):
    """Records of the pieces of a split of rows in order; the first and the last conversation may go on in another split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, cache, done = TaskContext.get().partitionId() << 33, 0, {}, []
        piece, first, split = None, True, False  # split: the conversation has a piece already

        def close(ended: bool) -> None:
            nonlocal number, first, split
            done.append(piece.record(base + number, ended and not first and not split, cache))
            number += 1
            split = not ended
            first = first and not ended

        for conv_id, turn, initial, fault in _piece_rows(batches):
            if piece is None:
                piece = _Piece(conv_id)
            elif piece.conv_id != conv_id:
                close(True)
                piece = _Piece(conv_id)
            elif len(piece.shape) == PIECE:
                close(False)
                piece = _Piece(conv_id)
            piece.shape.append(initial + fault)
            piece.turns.append(turn)
            if len(done) >= 1024:
                yield _batch(done, schema)
                done.clear()
        if piece is not None:
            close(False)
        yield _batch(done, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _joiner(schema: pa.Schema):
    """One row per conversation from its pieces in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None

        def close() -> None:
            cost, audit = min(now["lightest"][q] for q in ACCEPTED if now["lightest"][q] is not None)
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["distinct"]
            done.append((now["conv_id"], gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], cost, audit))

        for batch in slices_of(batches):
            for r in batch.to_pylist():
                if now is None or now["conv_id"] != r["conv_id"]:
                    if now is not None:
                        close()
                    now = r | {"lightest": extend([(0, ""), None, None, None], r["costs"], r["audits"])}
                    continue
                now["illegal"] += now["last"] + r["first"] not in LEGAL
                now["distinct"] -= now["last_turn"] is not None and now["last_turn"] == r["first_turn"]
                for c in COUNTS:
                    now[c] += r[c]
                now["low"] = min((x for x in (now["low"], r["low"]) if x is not None), default=None)
                now["high"] = max((x for x in (now["high"], r["high"]) if x is not None), default=None)
                now["last"], now["last_turn"] = r["last"], r["last_turn"]
                now["lightest"] = extend(now["lightest"], r["costs"], r["audits"])
            if len(done) >= 1024:
                yield _batch(done, schema)
                done.clear()
        if now is not None:
            close()
        yield _batch(done, schema)

    return run


def slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield batch.slice(at, 1024)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after the damage of crc32(conv_id:turn) % 20, with ``copy`` 1, or 1 and 2.

    0 drops the row, 1 empties its text, 2 takes the characters .!? from it, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(F.encode(name, "UTF-8")) % 20).alias("__d")).where("__d <> 0")
    text = F.when(F.col("__d") == 1, "").when(F.col("__d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("__d") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("__d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies)


def _ordered(rows: DataFrame) -> DataFrame:
    """Adds the text's digest, by which rows of one turn are ordered behind their role."""
    return rows.withColumn("h", F.unhex(F.md5(F.encode("text", "UTF-8"))))


def _summaries(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, copy): its counts, and the cost and audit of its repair.

    No text is moved: rows travel as initial, fault and digest. They are dealt by ranges of (conversation, order), so a
    conversation of any length is split over tasks, each deduces its pieces from every state they may be entered in,
    and the pieces of a conversation are chained. Repeats are told by the first place of each (conversation, role,
    digest), which is combined per task.
    """
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    small = _ordered(rows).select(
        "conv_id", "turn", "role", "h", F.monotonically_increasing_id().alias("id"), "copy", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(WORD)).alias("blank"), (~last.isin(".", "!", "?")).alias("open")
    )
    small = cut(small)
    place = F.struct(F.col("turn").isNotNull().alias("t"), "turn", "id", "copy")
    firsts = small.groupBy("conv_id", "role", "h").agg(F.min(place).alias("at"), F.count("*").alias("rows")).where("rows > 1").select(*(F.col(c).alias(f"__{c}") for c in ("conv_id", "role", "h", "at")))
    same = F.col("conv_id").eqNullSafe(F.col("__conv_id")) & (F.col("role") == F.col("__role")) & (F.col("h") == F.col("__h"))
    marked = small.withColumn("at", place).join(joinable(firsts), same, "left")
    fault = F.when(F.col("blank"), _BLANK).when(F.col("at") > F.col("__at"), _DUPLICATE).when(F.col("open"), _TRUNCATED).otherwise("-")
    order = ["conv_id", "turn", "role", "h", "id", "copy"]
    flagged = marked.select(*order, "initial", fault.alias("fault")).repartitionByRange(*order).sortWithinPartitions(*order)
    key = rows.schema["conv_id"].dataType.simpleString()
    pieces_type, summary_type = _PIECES.format(key=key), _SUMMARY.format(key=key)
    spark = rows.sparkSession
    arrow = lambda ddl: spark.createDataFrame([], ddl).toArrow().schema
    pieces = flagged.select("conv_id", "turn", "initial", "fault").mapInArrow(_deducer(arrow(pieces_type)), pieces_type)
    chained = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return cut(chained.mapInArrow(_joiner(arrow(summary_type)), summary_type))


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str | None, str, str | None, bool]]:
    """(conv_id, edit, role, text, ended) of the repaired turns, from rows in order behind their conversation's audit.

    ``edit`` is null, and there is no text, where a conversation ends.
    """
    conv_id, audit, at, state = None, None, 0, START

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role = next(r for r in NAMES if r in NEXT[state])
            state, at = NEXT[state][role], at + 1
            yield conv_id, "I", NAMES[role], "", False

    for batch in slices_of(batches):
        for conv, plan, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if plan is not None:
                if audit is not None:
                    yield from inserted()
                    yield conv_id, None, "", None, True
                conv_id, audit, at, state = conv, plan, 0, START
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = NEXT[state][role[:1]]
                yield conv_id, edit, role, text, False
            elif edit == "R":
                initial = next(r for r in NAMES if r in NEXT[state])
                state = NEXT[state][initial]
                yield conv_id, edit, NAMES[initial], text, False
    if audit is not None:
        yield from inserted()
        yield conv_id, None, "", None, True


def _digester(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, digest, fresh = [], hashlib.sha256(), True
        for conv_id, _, role, text, ended in _replayed(batches):
            if ended:
                done.append((conv_id, digest.hexdigest()))
                digest, fresh = hashlib.sha256(), True
                if len(done) >= 1024:
                    yield _batch(done, schema)
                    done.clear()
            else:
                digest.update(f"{'' if fresh else chr(10)}{role}:{text}".encode())
                fresh = False
        yield _batch(done, schema)

    return run


def _teller(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, number = [], 0
        for conv_id, edit, role, text, ended in _replayed(batches):
            if ended:
                number = 0
                continue
            done.append((conv_id, number, edit, role, text))
            number += 1
            if len(done) >= 256:
                yield _batch(done, schema)
                done.clear()
        yield _batch(done, schema)

    return run


def _scripted(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """The rows of every conversation in order behind its audit, in one split."""
    texts = _ordered(rows).select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "h", "copy", "text")
    audits = summaries.select("conv_id", "audit", *(F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in ("turn", "role", "h", "copy", "text")))
    both = audits.unionAll(texts).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "h", "copy")
    return both.select("conv_id", "audit", "role", "text")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the turns of every conversation of (conv_id, turn, role, text) after the
    cheapest repair, without damage first. Deleted rows are absent; edit is K, R or I."""
    rows = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).alias("copy"))
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, position long, edit string, role string, text string"
    arrow = rows.sparkSession.createDataFrame([], schema).toArrow().schema
    return _scripted(rows, _summaries(rows)).mapInArrow(_teller(arrow), schema)


def repair_conversations(turns: DataFrame, damage: bool = True) -> DataFrame:
    """One row per conv_id of (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256, of its rows after ``damage``.

    Rows are taken by turn (nulls first), rows of one turn by role and then by the digest of their text, so repeats are
    adjacent. audit: initials of the cheapest Keep, Rerole, Delete and Insert edits that give the roles (s?(ua)+)?, the
    least in ASCII order among those that cost the same; repaired_sha256: digest of the repaired role:text lines.

    Nulls in role and text count as one space, in conv_id and turn as one space in the damage's key; a null conv_id is a
    conversation. Fully repeated rows are duplicates of the first. Conversations without rows after the damage: zeros,
    an empty audit, the digest of the empty string. An empty table gives an empty result. Other columns are not used,
    whatever their names. A conversation's rows are deduced in pieces of 2,048 over any number of tasks; only the
    digest, a chain by nature, reads them one by one in one task, which holds one batch and the audit.
    """
    if damage:
        rows = damaged(turns)
    else:
        rows = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).alias("copy"))
    found = _summaries(rows)
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"
    arrow = rows.sparkSession.createDataFrame([], schema).toArrow().schema
    digests = _scripted(rows, found).mapInArrow(_digester(arrow), schema)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    every = turns.select("conv_id").distinct()
    joined = every.join(found.withColumnRenamed("conv_id", "__c"), same("conv_id", "__c"), "left")
    joined = joined.join(digests.withColumnRenamed("conv_id", "__e"), same("conv_id", "__e"), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
