"""Chat formatting from raw transcripts: a hidden Markov model over lines, then canonical turns.

A state is a role and whether a line begins a turn or goes on with it; a line is seen as the name before its colon or
bracket (by hash: which names speak for which role is learnt) and, on its own, the shape of the rest. Transition and emission counts are added
up over all labelled lines in Spark. Roles are recovered by Viterbi, of turns without a marker as well.
Long transcripts are cut into segments: each segment is a max-plus matrix, a conversation combines its segments'
matrices to the states at the cuts, and every segment is then solved between its two cut states. So no task holds
more lines than a segment, and a conversation's task holds one small matrix for SEGMENT lines.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrel.llm.common import staged

ROLES = ("system", "user", "assistant")
#: Begin and continue states, by role.
STATES = [(r, b) for r in ROLES for b in (True, False)]
SEGMENT = 512
#: Hash values of a marker's name and the signs before it, 0 for none; shapes: length in steps, and a question mark.
MARKS, SHAPES, STEP = 64, 62, 30
SYMBOLS = MARKS * SHAPES
_MARKER = re.compile(r"\s*((?:[#>*\[<(|-]+\s*)?\**[A-Za-z]{1,14})\**\s*[\]:>)|]+\**\s*")
BLOCK_TURNS, BLOCK_LINES = 1024, 4096


def mark(line: str) -> int:
    found = _MARKER.match(line)
    return 1 + zlib.crc32(found[1].lower().encode()) % (MARKS - 1) if found else 0


def symbol(line: str) -> int:
    """Marker of a line and shape of the rest."""
    found = _MARKER.match(line)
    rest = len(line) - (found.end() if found else 0)
    return mark(line) * SHAPES + 2 * min(SHAPES // 2 - 1, rest // STEP) + ("?" in line)


def unmarked(line: str) -> str:
    """The line without its marker."""
    found = _MARKER.match(line)
    return line[found.end() :] if found else line


def speakers(emission: np.ndarray) -> np.ndarray:
    """Whether each mark is a speaker's: likelier where a turn begins than where it goes on, in some role."""
    each = np.exp(emission).reshape(len(STATES), MARKS, SHAPES).sum(2)
    begins = np.array([b for _, b in STATES])
    names = each[begins].max(0) > each[~begins].max(0)
    names[0] = False
    return names


def held_out(conv_id: str):
    """crc32(conv_id as text) mod 3 is 1: such conversations never train. False for a null conv_id."""
    return F.coalesce(F.crc32(F.col(conv_id).cast("string")) % 3 == 1, F.lit(False))


def marked_lines(turns: DataFrame, rough: bool = False) -> DataFrame:
    """Raw transcripts from turns (conv_id, turn, role, text): conv_id, line_no, line, and the true role and begins.

    The marker style depends on the conversation. If rough, a fifth of the turns (but a conversation's first) have no
    marker, and a tenth of the lines inside turns begin with what looks like one: a heading, or a quoted speaker. Which
    ones follows from hashes. A null text is an empty line, a null or unknown role "user", a null turn 0, and all turns
    without a conv_id are one conversation. Turns that repeat a number are all there. Other columns are not read.
    """
    role = F.when(F.lower("role").isin(*ROLES), F.lower("role")).otherwise("user")
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    name = F.when((style == 1) & (role == "user"), "Human").when((style == 1) & (role == "assistant"), "AI").otherwise(F.initcap(role))
    mark = F.when(style == 2, F.concat(F.lit("["), F.lower(name), F.lit("] "))).when(style == 3, F.concat(F.lit("### "), name, F.lit(": "))).otherwise(F.concat(name, F.lit(": ")))
    if rough:
        mark = F.when((F.coalesce("turn", F.lit(0)) > 0) & (F.pmod(F.xxhash64("conv_id", "turn", F.lit(1)), F.lit(5)) == 0), "").otherwise(mark)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), role.alias("role"), F.split(F.concat(mark, F.coalesce("text", F.lit(""))), "\n").alias("lines"))
    rows = rows.withColumns({"uid": F.monotonically_increasing_id(), "block": F.floor(F.col("turn") / BLOCK_TURNS)})
    rows = staged(rows, "turns")
    # Line numbers: sums over blocks of turns, then within a block, so that no task needs all turns of a conversation.
    blocks = rows.groupBy("conv_id", "block").agg(F.sum(F.size("lines")).alias("size"))
    before = F.sum("size").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("conv_id", "block", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum(F.size("lines")).over(Window.partitionBy("conv_id", "block").orderBy("turn", "uid").rowsBetween(Window.unboundedPreceding, -1))
    slim = rows.select("uid", "conv_id", "block", "turn", "lines").withColumn("inside", F.coalesce(inside, F.lit(0))).drop("turn", "lines")
    start = slim.join(blocks, [slim.conv_id.eqNullSafe(blocks.conv_id), slim.block == blocks.block]).select("uid", (F.col("base") + F.col("inside")).alias("start"))
    out = rows.join(start, "uid").select("conv_id", "role", "start", F.posexplode("lines").alias("k", "line"))
    line = F.col("line")
    if rough:
        chance = F.pmod(F.xxhash64("conv_id", "start", "k", F.lit(2)), F.lit(20))
        line = F.when((F.col("k") > 0) & (chance == 0), F.concat(F.lit("Note: "), line)).when((F.col("k") > 0) & (chance == 1), F.concat(F.lit("> User: "), line)).otherwise(line)
    return out.select("conv_id", (F.col("start") + F.col("k")).cast("long").alias("line_no"), line.alias("line"), "role", (F.col("k") == 0).alias("begins"))


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (state, symbol) of the task's labelled lines."""
    count = np.zeros((len(STATES), SYMBOLS), np.int64)
    for batch in batches:
        for line, role, begins in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            count[STATES.index((role, begins)), symbol(line)] += 1
    state, seen = np.nonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(state.astype(np.int32)), pa.array(seen.astype(np.int32)), pa.array(count[state, seen])], names=["state", "symbol", "n"])


def train(lines: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, transition, emission) log probabilities, counted over all labelled lines and smoothed.

    Only fixed-size count tables come to the driver.
    """
    names, shapes = np.full((len(STATES), MARKS), 0.1), np.full((len(STATES), SHAPES), 0.5)
    for s, x, n in lines.select("line", "role", "begins").mapInArrow(_observed, "state int, symbol int, n long").groupBy("state", "symbol").agg(F.sum("n")).collect():
        names[s, x // SHAPES] += n
        shapes[s, x % SHAPES] += n
    emission = (names / names.sum(1, keepdims=True))[:, :, None] * (shapes / shapes.sum(1, keepdims=True))[:, None]
    emission = emission.reshape(len(STATES), SYMBOLS)
    move = np.full((len(STATES), len(STATES)), 0.5)
    start = np.full(len(STATES), 0.5)
    # A turn's role after the last one's: within blocks of lines, then over the blocks that have turns.
    turns = lines.where("begins").select("conv_id", "line_no", "role", F.floor(F.col("line_no") / BLOCK_LINES).alias("block"))
    follows = F.lag("role").over(Window.partitionBy("conv_id", "block").orderBy("line_no"))
    inner = turns.withColumn("last", follows)
    ends = turns.groupBy("conv_id", "block").agg(F.min_by("role", "line_no").alias("role"), F.max_by("role", "line_no").alias("end"))
    outer = ends.withColumn("last", F.lag("end").over(Window.partitionBy("conv_id").orderBy("block")))
    for a, b, n in inner.where("last is not null").select("last", "role").unionByName(outer.select("last", "role")).groupBy("last", "role").count().collect():
        if a is None:
            start[STATES.index((b, True))] += n
        else:
            move[STATES.index((a, False)), STATES.index((b, True))] += n
            move[STATES.index((a, True)), STATES.index((b, True))] += n
    for r, b, n in lines.groupBy("role", "begins").count().collect():
        if not b:
            move[STATES.index((r, True)), STATES.index((r, False))] += n
            move[STATES.index((r, False)), STATES.index((r, False))] += n
    for a, (ra, _) in enumerate(STATES):
        for b, (rb, begins) in enumerate(STATES):
            if not begins and ra != rb:
                move[a, b] = 0  # a turn goes on in its own role only
    start[[k for k, (_, b) in enumerate(STATES) if not b]] = 0.01
    with np.errstate(divide="ignore"):
        return np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), np.log(emission)


def viterbi(symbols: np.ndarray, first: np.ndarray, move: np.ndarray, emission: np.ndarray, last: int | None = None) -> tuple[float, list[int]]:
    """Best states for the symbols; first has the scores of entering each state, last fixes the final state."""
    score, back = first + emission[:, symbols[0]], []
    for x in symbols[1:]:
        ways = score[:, None] + move
        best = ways.argmax(0)
        back.append(best)
        score = ways[best, np.arange(len(best))] + emission[:, x]
    state = int(score.argmax()) if last is None else last
    top, path = float(score[state]), [state]
    for best in reversed(back):
        path.append(int(best[path[-1]]))
    return top, path[::-1]


def segment_matrix(symbols: np.ndarray, move: np.ndarray, emission: np.ndarray) -> np.ndarray:
    """Best score from each state before the segment to each state at its end."""
    matrix = move + emission[:, symbols[0]]
    for x in symbols[1:]:
        matrix = (matrix[:, :, None] + move[None]).max(1) + emission[:, x]
    return matrix


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def _matrices(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, move, emission = model.value
        for (conv, seg), rows in _grouped(batches, 2):
            symbols = np.array([symbol(line) for _, line in rows])
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([seg], pa.int64()), pa.array([segment_matrix(symbols, move, emission).tobytes()])], names=["conv_id", "seg", "matrix"])

    return run


def _cuts(model):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The best state at the end of each segment of one conversation."""
        start, _, _ = model.value
        n = len(STATES)
        pdf = pdf.sort_values("seg")
        mats = [np.frombuffer(m).reshape(n, n) for m in pdf["matrix"]]
        entry, back = None, []
        for k, m in enumerate(mats):
            ways = (start[:, None] + np.frombuffer(pdf["entered"].iloc[0]).reshape(n, n) if k == 0 else entry[:, None] + m)
            best = ways.argmax(0)
            back.append(best)
            entry = ways[best, np.arange(n)]
        states = [int(entry.argmax())]
        for best in reversed(back[1:]):
            states.append(int(best[states[-1]]))
        states = states[::-1]
        return pd.DataFrame({"conv_id": pdf["conv_id"], "seg": pdf["seg"], "enter": [-1, *states[:-1]], "leave": states})

    return run


def _entered(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For first segments: best score from each first state to each state at the end."""
        _, move, emission = model.value
        n = len(STATES)
        for (conv, seg), rows in _grouped(batches, 2):
            symbols = np.array([symbol(line) for _, line in rows])
            inner = np.full((n, n), -np.inf)
            np.fill_diagonal(inner, emission[:, symbols[0]])
            for x in symbols[1:]:
                inner = (inner[:, :, None] + move[None]).max(1) + emission[:, x]
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([inner.tobytes()])], names=["conv_id", "entered"])

    return run


def _solved(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emission = model.value
        names = speakers(emission)
        out: list[tuple] = []
        for (conv, seg), rows in _grouped(batches, 2):
            symbols = np.array([symbol(r[1]) for r in rows])
            enter, leave = rows[0][2], rows[0][3]
            _, path = viterbi(symbols, start if enter is None or enter < 0 else move[enter], move, emission, leave)
            for (line_no, line, _, _), state in zip(rows, path, strict=True):
                role, begins = STATES[state]
                out.append((conv, seg, line_no, role, begins or (seg == 0 and line_no == rows[0][0]), unmarked(line) if begins and names[mark(line)] else line))
            if len(out) >= 5000:
                yield _lines(out)
                out = []
        if out:
            yield _lines(out)

    return run


def _lines(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=["conv_id", "seg", "line_no", "role", "begins", "line"])


def recovered(lines: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], segment: int = SEGMENT) -> DataFrame:
    """conv_id, line_no, turn_no, role, begins, line (without its marker) of each line (conv_id, line_no, line).

    line_no must count from 0 without gaps in each conversation. All lines with a null conv_id are one conversation.
    Lines are read whole, whatever their length. A marker is taken off where a turn begins and the model knows it.
    """
    spark = lines.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = staged(lines.select("conv_id", F.floor(F.col("line_no") / segment).cast("long").alias("seg"), "line_no", "line"), "lines")
    many = rows.where("seg > 0")
    dealt = lambda x: x.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "line_no")
    if many.isEmpty():
        cuts = None
        solved = dealt(rows).withColumns({"enter": F.lit(-1), "leave": F.lit(None).cast("int")}).mapInArrow(_solved(shared), "conv_id long, seg long, line_no long, role string, begins boolean, line string")
    else:
        long = staged(many.select("conv_id").distinct(), "long")
        same = rows.conv_id.eqNullSafe(long.conv_id)
        inside = staged(rows.join(long, same, "left_semi"), "long-lines")
        matrices = dealt(inside).mapInArrow(_matrices(shared), "conv_id long, seg long, matrix binary")
        firsts = dealt(inside.where("seg = 0")).mapInArrow(_entered(shared), "conv_id long, entered binary")
        firsts = firsts.withColumnRenamed("conv_id", "c")
        cuts = matrices.join(firsts, matrices.conv_id.eqNullSafe(firsts.c)).drop("c").groupBy("conv_id").applyInPandas(_cuts(shared), "conv_id long, seg long, enter int, leave int")
        cuts = staged(cuts, "cuts").withColumnsRenamed({"conv_id": "c", "seg": "s"})
        placed = rows.join(cuts, rows.conv_id.eqNullSafe(cuts.c) & (rows.seg == cuts.s), "left").drop("c", "s")
        solved = dealt(placed).mapInArrow(_solved(shared), "conv_id long, seg long, line_no long, role string, begins boolean, line string")
    solved = staged(solved, "solved")
    # Turn numbers: turns before the segment, and those in it.
    heads = solved.groupBy("conv_id", "seg").agg(F.sum(F.col("begins").cast("long")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select(F.col("conv_id").alias("c"), F.col("seg").alias("s"), before.alias("base"))
    inner = F.sum(F.col("begins").cast("long")).over(Window.partitionBy("conv_id", "seg").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    out = solved.withColumn("inner", inner).join(heads, solved.conv_id.eqNullSafe(F.col("c")) & (solved.seg == F.col("s")))
    return out.select("conv_id", "line_no", (F.col("base") + F.col("inner") - 1).alias("turn_no"), "role", "begins", "line")


def canonical_turns(lines: DataFrame) -> DataFrame:
    """conv_id, turn_no, role, n_lines, rendered: each recovered turn as <|im_start|>role, its text, <|im_end|>. A turn's
    text is one value, so its lines meet in one row."""
    turns = lines.groupBy("conv_id", "turn_no").agg(F.min_by("role", "line_no").alias("role"), F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("all"))
    text = F.array_join(F.col("all.line"), "\n")
    return turns.select("conv_id", "turn_no", "role", "n_lines", F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), text, F.lit("<|im_end|>\n")).alias("rendered"))
