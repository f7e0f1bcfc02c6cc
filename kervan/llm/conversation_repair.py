"""Conversation repair: the cheapest edits that give every conversation roles of the form s?(ua)*, by dynamic programming.

A row's part in the problem is one letter (its role's initial, whether it must go, whether it is cut short), so a
conversation is a string of letters, kept in chunks of CHUNK rows. The edits of a chunk are paths through a graph of four
role states. An edge weighs one big integer: the cost in the high digits, and in the low digits the audit letter, DIGIT bits
wide at its place from the left; places behind the last letter are zero. The smallest integer is the cheapest path and,
among those, the one with the least audit in ASCII order. Audits of one number of rows end with a letter that is no insert, so none
starts another one; the smallest path of each pair of states is therefore all that later rows need, and chunks combine by
cost and by the rank of their audit. Texts shuffle once, to be rewritten in order; a conversation's rows stream through one
task there and are never held together, as its digest asks for that order. A conversation whose audit fits a cell (2 GB)
has at most 4 million chunks, which one task combines.

Order of rows: turn (null first), then role, then SHA-256 of the text. Defined results: nulls of role and text become one
space; a null conv_id is a conversation of its own; an empty role fits nowhere and may be changed or deleted; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

CHUNK = 256
DIGIT = 3
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
# States: nothing yet, after s, after u, after a.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_FILLS = {0: "u", 1: "u", 2: "a", 3: "u"}
_FINAL = (0, 3)
# Moves: keep, delete, make user or assistant, insert User or Assistant. Audits name the kind of edit alone.
_AUDIT = {"D": 1, "U": 2, "A": 2, "K": 3, "u": 4, "a": 4}
_INSERT_COST, _DELETE_COST, _ROLE_COST, _CUT_COST = 5, 2, 1, 5
_UNREACHED = -1


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations with one row in twenty dropped, emptied, stripped of its sentence ends,
    repeated or given to the user, as the CRC-32 of conv_id:turn says; nulls are written as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(h == 4, "user").otherwise(space("role"))
    times = F.when(h == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.filter(h != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_time")).drop("_time")


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows without their texts, numbered, with faults and the letter of each."""
    bare = F.rtrim("text", F.lit(_SPACE))
    keyed = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), (bare == "").alias("_blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("_open"))
    whole = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    same = Window.partitionBy("conv_id", "role", "digest").orderBy("at")
    initial = F.substring("role", 1, 1)
    # In this order both windows share one exchange by conversation.
    keyed = keyed.select("*", (F.row_number().over(whole) - 1).cast("long").alias("at"), F.lag(initial).over(whole).alias("_before"), F.lag("turn").over(whole).alias("_turn_before"))
    keyed = keyed.withColumn("_again", F.row_number().over(same) > 1)
    fault = F.when(F.col("_blank"), "blank").when(F.col("_again"), "duplicate").when(F.col("_open"), "truncated")
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return keyed.withColumn("fault", fault).select(
        "conv_id", "turn", "role", "digest", "at", "fault",
        F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter).alias("letter"),
        (F.col("_before").isNotNull() & ~F.concat("_before", initial).isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn_before"))).alias("new_turn"),
    )


def _row_moves(state: int, letter: str) -> Iterator[tuple[int, int, str]]:
    """(cost, next state, move) of what may be done with a row."""
    yield _DELETE_COST, state, "D"
    if letter == "d":
        return
    extra = _CUT_COST if letter.isupper() else 0
    kept = _NEXT.get((state, letter.lower()))
    if kept is not None:
        yield extra, kept, "K"
    fill = _FILLS[state]
    yield extra + _ROLE_COST, _NEXT[state, fill], fill


def _inserts(state: int) -> Iterator[tuple[int, int, str]]:
    """(cost, next state, moves) of none, one or two inserted rows; a third one would lead back."""
    cost, moves = 0, ""
    for _ in range(3):
        yield cost, state, moves
        fill = _FILLS[state]
        cost, state, moves = cost + _INSERT_COST, _NEXT[state, fill], moves + fill.upper()


@functools.cache
def _steps(state: int, letter: str) -> tuple[tuple[int, int, str], ...]:
    return tuple((c + cost, after, moves + move) for c, between, moves in _inserts(state) for cost, after, move in _row_moves(between, letter))


@functools.lru_cache(maxsize=100_000)
def solve_chunk(letters: str) -> tuple[list[int], list[int], list[str]]:
    """Costs, ranks and moves for each (state before, state after), 16 of each. Ranks order the audits of one state before."""
    width = DIGIT * 3 * len(letters)  # a row is one letter and at most two inserts
    costs, ranks, moves = [_UNREACHED] * 16, [0] * 16, [""] * 16
    for begin in range(4):
        best: dict[int, tuple[int, int, tuple | None]] = {begin: (0, width, None)}
        for letter in letters:
            reached: dict[int, tuple[int, int, tuple | None]] = {}
            for state, (weight, place, way) in best.items():
                for cost, after, step in _steps(state, letter):
                    total, at = weight + (cost << width), place
                    for move in step:
                        at -= DIGIT
                        total += _AUDIT[move] << at
                    if after not in reached or total < reached[after][0]:
                        reached[after] = (total, at, (way, step))
            best = reached
        low = (1 << width) - 1
        for rank, end in enumerate(sorted(best, key=lambda s: best[s][0] & low)):
            total, _, way = best[end]
            parts = []
            while way is not None:
                way, step = way
                parts.append(step)
            costs[4 * begin + end], ranks[4 * begin + end], moves[4 * begin + end] = total >> width, rank, "".join(reversed(parts))
    return costs, ranks, moves


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [solve_chunk(x) for x in batch.column(2).to_pylist()]
        yield pa.record_batch(
            [batch.column(0), batch.column(1), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()))))],
            ["conv_id", "chunk", "costs", "ranks", "moves"],
        )


def best_path(costs: np.ndarray, ranks: np.ndarray) -> tuple[int, list[int], str]:
    """Cost, the states before, between and behind a conversation's chunks, and the inserts at its end. costs, ranks: (n, 16).
    Backwards: from each state the least (cost, rank), as what follows one pair of states is the same whatever came before."""
    ends = {s: next((c, moves) for c, after, moves in _inserts(s) if after in _FINAL) for s in range(4)}
    total = [ends[s][0] for s in range(4)]
    chosen = np.zeros((len(costs), 4), np.int8)
    for k in range(len(costs) - 1, -1, -1):
        step, order = costs[k].tolist(), ranks[k].tolist()
        now = []
        for s in range(4):
            cost, _, after = min((step[4 * s + e] + total[e], order[4 * s + e], e) for e in range(4) if step[4 * s + e] != _UNREACHED)
            now.append(cost)
            chosen[k, s] = after
        total = now
    states = [0]
    for k in range(len(costs)):
        states.append(int(chosen[k, states[-1]]))
    return total[0], states, ends[states[-1]][1]


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for chunks in batch.column(1).to_pylist():
            found.append(best_path(np.array([c["costs"] for c in chunks]), np.array([c["ranks"] for c in chunks])))
        pairs = [[4 * a + b for a, b in zip(states, states[1:])] for _, states, _ in found]
        yield pa.record_batch(
            [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array(pairs, pa.list_(pa.int32())), pa.array([f[2] for f in found], pa.string())],
            ["conv_id", "cost", "pairs", "tail"],
        )


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and, before them, the moves of their chunks, in order; out come the repaired rows, numbered."""
    started, conv, n, pending, at = False, None, 0, "", 0
    inserted = {"U": "user", "A": "assistant"}
    for batch in batches:
        out: list[tuple] = []
        for key, moves, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if not started or key != conv:
                started, conv, n, pending, at = True, key, 0, "", 0
            if moves is not None:
                pending, at = pending[at:] + moves, 0
            if role is not None:
                while pending[at] in inserted:
                    out.append((key, n, inserted[pending[at]], ""))
                    n, at = n + 1, at + 1
                move, at = pending[at], at + 1
                if move != "D":
                    out.append((key, n, role if move == "K" else {"u": "user", "a": "assistant"}[move], text))
                    n += 1
            elif moves is None:  # the conversation's end
                for move in pending[at:]:
                    out.append((key, n, inserted[move], ""))
                    n += 1
                at = len(pending)
        columns = list(zip(*out)) if out else [[], [], [], []]
        yield pa.record_batch([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.string()) for c in columns[2:])], ["conv_id", "seq", "role", "text"])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries, repaired rows) of conversation rows (conv_id, turn, role, text), nulls of role and text as one space.

    Summaries: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Repaired rows: conv_id, seq, role, text,
    partitioned by conversation and in order within each partition.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "letter"))), lambda x: x["letter"]), "")
    counts = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    chunks = (
        _ordered(rows)
        .groupBy("conv_id", F.floor(F.col("at") / CHUNK).alias("chunk"))
        .agg(letters.alias("letters"), F.min(F.struct("at", "turn", "role", "digest")).alias("first"), *counts, F.count_if("illegal").alias("illegal"), F.count_if("new_turn").alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    )
    chunks = stage(chunks, "conversation_chunks")
    solved = chunks.select("conv_id", "chunk", "letters").mapInArrow(_solve, f"conv_id {id_type}, chunk bigint, costs array<bigint>, ranks array<int>, moves array<string>")
    solved = stage(solved, "conversation_moves")

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "costs", "ranks"))), lambda c: F.struct(c["costs"].alias("costs"), c["ranks"].alias("ranks")))
    paths = solved.groupBy("conv_id").agg(ordered.alias("chunks")).mapInArrow(_paths, f"conv_id {id_type}, cost bigint, pairs array<int>, tail string")
    paths = stage(paths, "conversation_paths")
    taken = paths.select(F.col("conv_id").alias("_conv"), F.posexplode("pairs").alias("_chunk", "_pair"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk"))
    moves = stage(solved.join(taken.hint("merge"), same).select("conv_id", "chunk", F.element_at("moves", F.col("_pair") + 1).alias("moves")), "chosen_moves")

    edits = moves.unionByName(paths.select("conv_id", F.lit(2**62).alias("chunk"), F.col("tail").alias("moves")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "moves"))), lambda x: x["moves"]), "")
    audits = edits.groupBy(F.col("conv_id").alias("_conv")).agg(F.translate(whole, "UAua", "IIRR").alias("audit"))
    stats = chunks.groupBy("conv_id").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).cast("long").alias("gaps"), *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    )
    costs = paths.select(F.col("conv_id").alias("_conv2"), "cost")
    summaries = stats.join(costs.hint("merge"), F.col("conv_id").eqNullSafe(F.col("_conv2"))).join(audits.hint("merge"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv", "_conv2")

    # Moves come before the first row of their chunk, the end behind all rows.
    texts = rows.select("conv_id", F.lit(0).alias("part"), "turn", F.col("role").alias("by_role"), F.sha2("text", 256).alias("digest"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("chunk"), F.lit(None).cast("string").alias("moves"), "role", "text")
    nothing = [F.lit(None).cast("string").alias(c) for c in ("role", "text")]
    first = chunks.select(F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"), "first")
    placed = moves.join(first.hint("merge"), same)
    places = placed.select("conv_id", F.lit(0).alias("part"), "first.turn", F.col("first.role").alias("by_role"), "first.digest", F.lit(0).alias("kind"), "chunk", "moves", *nothing)
    last = [F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in ("turn", "by_role", "digest")]
    tails = paths.filter("tail <> ''").select("conv_id", F.lit(1).alias("part"), *last, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("chunk"), F.col("tail").alias("moves"), *nothing)
    ends = tails.withColumn("kind", F.lit(1)).withColumn("moves", F.lit(None).cast("string"))
    stream = texts.unionByName(places).unionByName(tails).unionByName(ends)
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "by_role", "digest", "kind", "chunk")
    repaired = stream.select("conv_id", "moves", "role", "text").mapInArrow(_rewritten, f"conv_id {id_type}, seq bigint, role string, text string")
    return summaries, repaired


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """conv_id and SHA-256 of the lines role:text of each conversation; rows come as repair() gives them."""
    id_type = repaired.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv = None, None
        for batch in batches:
            done = []
            for key, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                if state is not None and key == conv:
                    state.update(b"\n" + line)
                else:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    state, conv = hashlib.sha256(line), key
            if done:
                yield _digest_rows(done, batch.schema.field(0).type)
            kind = batch.schema.field(0).type
        if state is not None:
            yield _digest_rows([(conv, state.hexdigest())], kind)

    return repaired.select("conv_id", "role", "text").mapInArrow(digest, f"conv_id {id_type}, repaired_sha256 string")


def _digest_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ids, digests = zip(*rows)
    return pa.record_batch([pa.array(ids, kind), pa.array(digests, pa.string())], ["conv_id", "repaired_sha256"])


def repair_report(rows: DataFrame, damaged_rows: DataFrame) -> DataFrame:
    """Every conv_id of rows, with the summary and the digest of the repair of damaged_rows."""
    summaries, repaired = repair(damaged_rows)
    digests = conversation_digests(repaired).withColumnRenamed("conv_id", "_conv")
    empty: Column = F.sha2(F.lit(""), 256)
    ids = rows.select(F.col("conv_id").alias("_id")).distinct()
    same = lambda c: F.col("_id").eqNullSafe(F.col(c))
    joined = ids.join(summaries.hint("merge"), same("conv_id"), "left").join(digests.hint("merge"), same("_conv"), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
