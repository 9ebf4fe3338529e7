"""Speaker roles of transcript lines by a hidden Markov model.

States are a role's first line and its further lines.  A line shows its
speaker marker, its length and its last character; each is drawn from the
state's own distribution.  Distributions and transitions are counted over all
labelled turns.  A marker that training hasn't met is as likely in every first
line, and as unlikely in every further one, so it begins a turn whose role the
other features and the order of roles tell.

Transcripts are decoded by Viterbi, many at a time.  A long one is cut into
parts: a part's max-plus product gives the best score from each state before
it to each state at its end, products give the best states at the borders, and
then each part is decoded between its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.shared import table, written

#: lines are numbered turn * 2**LINE_BITS + line; a part is 64 turns, one with
#: more than PART_ROWS rows is dealt by turn and by leading bits of a hash
LINE_BITS, PART_BITS = 32, 38
PART_ROWS, PART_HASH_BITS = 4096, 16
#: lines that meet in one task, parts being whole
TASK_LINES = 20_000
FOLDS, HELD_OUT = 4, 2
#: markers with a distribution of their own; rarer ones count as unknown
MOST_MARKERS = 256
#: share of a state's marked lines that an unknown marker has at least
UNKNOWN_SHARE = 0.05
NONE, UNKNOWN = "", None

MARKER = r"^\s*[\[<#*]*\s*(\w{1,16})\s*[:\]>]"


def features(line: Column) -> list[Column]:
    marker = F.lower(F.regexp_extract(line, MARKER, 1)).alias("marker")
    size = F.least(F.lit(40), F.floor(2 * F.log2(F.length(line) + 1))).cast("int").alias("size")
    end = F.right(F.rtrim(line), F.lit(1))
    last = F.when(end == "", "blank").when(end == "?", "question").when(end.isin(".", "!"), "stop").otherwise("other").alias("last")
    return [marker, size, last]


class Model:
    """Log probabilities.  Their size depends on the number of roles and on
    MOST_MARKERS only."""

    def __init__(self, roles: list[str], tables: list[dict], start: np.ndarray, step: np.ndarray):
        self.roles, self.tables, self.start, self.step = roles, tables, start, step

    def emissions(self, columns: list[list]) -> np.ndarray:
        out = np.zeros((len(columns[0]), 2 * len(self.roles)))
        for values, known in zip(columns, self.tables):
            distinct = {v: i for i, v in enumerate(dict.fromkeys(values))}
            rows = np.array([known.get(v, known[UNKNOWN]) for v in distinct]).reshape(-1, out.shape[1])
            out += rows[np.fromiter(map(distinct.__getitem__, values), np.int64, len(values))]
        return out


def marker_table(counts: dict, first: np.ndarray) -> dict:
    """Log probabilities of markers in each state; ``counts`` by marker, with
    those of all rarer ones under UNKNOWN."""
    unknown = counts.pop(UNKNOWN, 0) + np.zeros(len(first))
    total = sum(counts.values(), unknown) + 0.5 * (len(counts) + 2)
    marked = 1 - (counts.get(NONE, 0) + 0.5) / total
    rare = np.zeros(len(first))
    for group in (first, ~first):  # shared by first and by further lines
        rare[group] = (unknown[group].sum() + 0.5) / total[group].sum() + UNKNOWN_SHARE * (marked[group] * total[group]).sum() / total[group].sum()
    rare = np.minimum(rare, 0.5)
    out = {v: np.log((c + 0.5) / total * (1 - rare)) for v, c in counts.items()}
    return out | {UNKNOWN: np.log(rare)}


def fit(turns: DataFrame) -> Model | None:
    """Counts over all labelled turns (own, turn, role, text with its marker);
    None without any.  No text is shuffled: lines are counted where they lie,
    transitions on ids and roles."""
    turns = turns.where(F.col("role").isNotNull())
    lines = turns.select("role", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("role", (F.col("pos") == 0).alias("begins"), *features(F.col("line")))
    counted = written(lines.groupBy("role", "begins", "marker", "size", "last").agg(F.count("*").alias("n")), "line-counts")
    roles = [r[0] for r in counted.select("role").distinct().orderBy("role").collect()]  # a role each
    if not roles:
        return None
    k = 2 * len(roles)
    state = {(r, b): 2 * i + (not b) for i, r in enumerate(roles) for b in (True, False)}
    first = np.arange(k) % 2 == 0
    common = [r[0] for r in counted.groupBy("marker").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "marker").limit(MOST_MARKERS + 1).collect()]
    tables = []
    for column in ("marker", "size", "last"):
        value = F.col(column) if column != "marker" else F.when(F.col("marker").isin(common), F.col("marker"))
        counts: dict = {}
        for r in counted.groupBy("role", "begins", value.alias("value")).agg(F.sum("n").alias("n")).collect():
            counts.setdefault(r["value"], np.zeros(k))[state[r["role"], r["begins"]]] += r["n"]
        if column == "marker":
            tables.append(marker_table(counts, first))
            continue
        total = sum(counts.values()) + len(counts) + 1
        tables.append({v: np.log((c + 1) / total) for v, c in counts.items()} | {UNKNOWN: np.log(1 / total)})
    start, step = np.full(k, 1e-3), np.full((k, k), 1e-3)
    before = Window.partitionBy("own", F.shiftright("turn", PART_BITS - LINE_BITS)).orderBy("turn", "place")
    steps = turns.select("own", "turn", "role", F.xxhash64("text").alias("place"), F.size(F.split("text", "\n")).alias("lines"))
    steps = steps.withColumn("previous", F.lag("role").over(before)).withColumn("before", F.lag("lines").over(before))
    # turns 64, 128, ... have no row before them there, and count for neither
    opening = F.col("previous").isNull() & (F.pmod("turn", F.lit(64)) == 0) & (F.col("turn") != 0)
    for r in steps.where(~opening).groupBy("role", "previous").agg(F.count("*").alias("n"), F.sum(F.when(F.col("before") > 1, 1).otherwise(0)).alias("long")).collect():
        to = state[r["role"], True]
        if r["previous"] is None:
            start[to] += r["n"]
        else:
            step[state[r["previous"], True], to] += r["n"] - r["long"]
            step[state[r["previous"], False], to] += r["long"]
    for r in steps.groupBy("role").agg(F.sum(F.when(F.col("lines") > 1, 1).otherwise(0)).alias("turns"), F.sum(F.greatest(F.col("lines") - 2, F.lit(0))).alias("more")).collect():
        further = state[r["role"], False]
        step[state[r["role"], True], further] += r["turns"]
        step[further, further] += r["more"]
    for i in range(len(roles)):  # a role's further lines follow its own
        for j in range(len(roles)):
            if i != j:
                step[[2 * i, 2 * i + 1], 2 * j + 1] = 1e-12
    start[1::2] = 1e-12
    return Model(roles, tables, np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)))


def _like_lengths(first: np.ndarray) -> Iterator[np.ndarray]:
    """Sequences in groups whose lengths differ by a factor of two at most."""
    lengths = np.diff(first)
    kind = np.frexp(lengths.astype(np.float64))[1]
    for e in np.unique(kind).tolist():
        own = np.flatnonzero(kind == e)
        width = max(1, (1 << 18) >> e)
        for lo in range(0, len(own), width):
            yield own[lo : lo + width]


def best_paths(scores: np.ndarray, first: np.ndarray, step: np.ndarray, entry: np.ndarray, exits: np.ndarray) -> np.ndarray:
    """The best state of every line of sequences: those between ``first``.
    ``entry`` scores each sequence's states at its first line; ``exits`` has
    its last state, -1 where that is free.  Ties go to the smaller state."""
    out = np.zeros(len(scores), np.int64)
    for own in _like_lengths(first):
        begin, length = first[own], first[own + 1] - first[own]
        best = entry[own] + scores[begin]
        back = np.zeros((int(length.max()), len(own), scores.shape[1]), np.int16)
        for t in range(1, len(back)):
            on = length > t
            ways = best[:, :, None] + step
            back[t] = ways.argmax(axis=1)
            best = np.where(on[:, None], ways.max(axis=1) + scores[np.minimum(begin + t, len(scores) - 1)], best)
        at = np.where(exits[own] >= 0, exits[own], best.argmax(axis=1))
        for t in range(len(back) - 1, -1, -1):
            on = length > t
            out[(begin + t)[on]] = at[on]
            if t:
                at = np.where(on, back[t][np.arange(len(own)), at], at)
    return out


def products(scores: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """Best scores of sequences from each state before them to each state at
    their ends; the last row is for the start of a transcript."""
    out = np.zeros((len(first) - 1, len(model.start) + 1, len(model.start)))
    for own in _like_lengths(first):
        begin, length = first[own], first[own + 1] - first[own]
        held = np.vstack((model.step, model.start[None]))[None] + scores[begin][:, None, :]
        for t in range(1, int(length.max())):
            more = (held[:, :, :, None] + model.step).max(axis=2) + scores[np.minimum(begin + t, len(scores) - 1)][:, None, :]
            held = np.where((length > t)[:, None, None], more, held)
        out[own] = held
    return out


ORDER = ("own", "part", "turn", "place", "line_no", "line")


def _sequences(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    """Lines in order and the first one of each part."""
    got = pa.Table.from_batches(list(batches))
    got = got.sort_by([(c, "ascending") for c in ORDER if c in got.column_names]).combine_chunks()
    ids = [got[c].to_numpy() for c in ("own", "part")]
    new = np.concatenate(([True], (ids[0][1:] != ids[0][:-1]) | (ids[1][1:] != ids[1][:-1])))
    return got, np.append(np.flatnonzero(new), got.num_rows)


def _product(shared):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, first = _sequences(batches)
        held = products(shared.value.emissions([got[c].to_pylist() for c in ("marker", "size", "last")]), first, shared.value)
        begin = pa.array(first[:-1])
        yield from pa.table([got["own"].take(begin), got["part"].take(begin), pa.array([x.ravel().tolist() for x in held], pa.list_(pa.float64()))], ["own", "part", "product"]).to_batches()

    return run


def _borders(shared):
    """(entry state or -1 at the start, exit state) of each part of a
    transcript: one row a part."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(shared.value.start)
        got = pa.Table.from_batches(list(batches)).sort_by("part")
        best, back = None, []
        for p in got["product"].to_pylist():
            m = np.array(p).reshape(n + 1, n)
            if best is None:
                best = m[n]
            else:
                ways = best[:, None] + m[:n]
                back.append(ways.argmax(axis=0))
                best = ways.max(axis=0)
        exits = [int(best.argmax())]
        for choice in reversed(back):
            exits.append(int(choice[exits[-1]]))
        exits = exits[::-1]
        yield from pa.table([got["own"], got["part"], pa.array([-1, *exits[:-1]], pa.int32()), pa.array(exits, pa.int32())], ["own", "part", "entry", "exit"]).to_batches()

    return run


def _turns(shared):
    """A row for each turn of a part; what comes before a part's first turn
    has no start_line, as its turn began in an earlier part."""
    lead = re.compile(MARKER + r"\s*", re.ASCII)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        got, first = _sequences(batches)
        markers = got["marker"].to_pylist()
        scores = model.emissions([markers, got["size"].to_pylist(), got["last"].to_pylist()])
        begin = first[:-1]
        entry, exits = got["entry"].to_numpy()[begin], got["exit"].to_numpy()[begin]
        path = best_paths(scores, first, model.step, np.where(entry[:, None] < 0, model.start, model.step[entry]), exits)
        opens = path % 2 == 0
        cut = opens.copy()
        cut[begin] = True
        at = np.append(np.flatnonzero(cut), len(path))
        lines = got["line"].to_pylist()
        bodies = []
        for lo, hi, opened in zip(at[:-1].tolist(), at[1:].tolist(), opens[at[:-1]].tolist()):
            if opened and markers[lo] != NONE:
                lines[lo] = lead.sub("", lines[lo], count=1)
            bodies.append("\n".join(lines[lo:hi]))
        where = pa.array(at[:-1])
        starts, places = (pa.array(got[c].to_numpy()[at[:-1]], mask=~opens[at[:-1]]) for c in ("line_no", "place"))
        roles = pa.array(model.roles, pa.string()).take(pa.array(path[at[:-1]] // 2))
        yield from pa.table(
            [got["conv_id"].take(where), got["own"].take(where), got["part"].take(where), starts, places, roles, pa.array(np.diff(at)), pa.array(bodies, pa.string())],
            ["conv_id", "own", "part", "start_line", "start_place", "role", "n_lines", "body"],
        ).to_batches()

    return run


def recover_turns(lines: DataFrame, model: Model) -> DataFrame:
    """(conv_id, start_line, role, n_lines, rendered) of the turns found in
    lines (conv_id, line_no, line): start_line is the number of the turn's
    first line, rendered the turn in canonical form without its marker.

    Optional columns: ``place`` (long) orders lines of the same turn number
    before their line number does, ``own`` names the transcript of a line
    (by default its conv_id, and a transcript for each line without one), and
    ``part`` the run of lines it is decoded with; parts go in ascending order.
    A null line is an empty one.  Equal lines stay, one after the other.
    """
    shared = lines.sparkSession.sparkContext.broadcast(model)
    default = {"own": F.coalesce("conv_id", F.xxhash64(F.lit("own"), "line_no", "line")), "place": F.lit(0), "part": F.shiftright("line_no", PART_BITS)}
    for name, value in default.items():
        lines = lines.withColumn(name, (F.col(name) if name in lines.columns else value).cast("long"))
    rows = lines.select("conv_id", "own", "part", F.shiftright("line_no", LINE_BITS).alias("turn"), "place", "line_no", F.coalesce("line", F.lit("")).alias("line"))
    seen = written(rows.groupBy("own", "part").agg(F.count("*").alias("n")), "transcript-parts")
    tasks = max(1, (seen.agg(F.sum("n")).first()[0] or 0) // TASK_LINES)
    rows = rows.select("*", *features(F.col("line"))).withColumn("task", F.pmod(F.xxhash64("own", "part"), F.lit(tasks)))
    several = seen.groupBy("own").agg(F.count("*").alias("parts")).where("parts > 1").select("own")
    whole = not several.take(1)
    if whole:
        rows = rows.withColumn("entry", F.lit(-1)).withColumn("exit", F.lit(-1))
    else:
        some = rows.drop("line").join(several, "own", "left_semi")
        product = some.groupBy("task").applyInArrow(_product(shared), "own long, part long, product array<double>")
        borders = written(product.groupBy("own").applyInArrow(_borders(shared), "own long, part long, entry int, exit int"), "borders")
        rows = rows.join(borders, ["own", "part"], "left").fillna(-1, ["entry", "exit"])
    found = rows.groupBy("task").applyInArrow(_turns(shared), "conv_id long, own long, part long, start_line long, start_place long, role string, n_lines long, body string")
    text = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "body", F.lit("<|end|>\n")).alias("rendered")
    if whole:
        return found.select("conv_id", "start_line", "role", "n_lines", text)
    # pieces of a turn that goes on in later parts belong to the last start
    found = written(found, "turn-pieces")
    start = F.when(F.col("start_line").isNotNull(), F.struct("part", "start_line", "start_place"))
    last = found.groupBy("own", "part").agg(F.max(start).alias("last"))
    earlier = Window.partitionBy("own").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.last("last", ignorenulls=True).over(earlier)).select("own", "part", "carried")
    pieces = found.withColumn("start", start).join(carried, ["own", "part"], "left").withColumn("start", F.coalesce("start", "carried"))
    ordered = F.sort_array(F.collect_list(F.struct(F.col("part"), "body")))
    turns = pieces.groupBy("own", "start").agg(F.first("conv_id").alias("conv_id"), F.first("role").alias("role"), F.sum("n_lines").alias("n_lines"), ordered.alias("pieces"))
    turns = turns.withColumn("body", F.array_join(F.transform("pieces", lambda x: x["body"]), "\n"))
    return turns.select("conv_id", F.col("start.start_line").alias("start_line"), "role", "n_lines", text)


_MARKERS = (("User: ", "Assistant: ", "System: "), ("Human: ", "AI: ", "Instructions: "), ("Q: ", "A: ", "Note: "), ("[user] ", "[assistant] ", "[system] "))
STYLES = len(_MARKERS)


def marked(conversations: DataFrame, styles: range = range(STYLES)) -> DataFrame:
    """Turns (conv_id, own, turn, role, text) as transcripts would have them:
    a marker style for each conversation, from a hash that has nothing to do
    with folds, and one turn in five without a marker."""
    style = F.pmod(F.xxhash64(F.lit("style"), "conv_id"), F.lit(len(styles)))
    marker = F.lit("")
    for k, number in enumerate(styles):
        user, assistant, system = _MARKERS[number]
        own = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", assistant).when(F.col("role") == "system", system).otherwise("")
        marker = F.when(style == k, own).otherwise(marker)
    bare = F.pmod(F.xxhash64(F.lit("bare"), "conv_id", "turn"), F.lit(5)) == 0
    text = F.concat(F.when(bare, "").otherwise(marker), F.coalesce("text", F.lit("")))
    alone = F.xxhash64(F.lit("own"), "turn", "role", "text")
    return conversations.select("conv_id", F.coalesce("conv_id", alone).alias("own"), F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), "role", text.alias("text"), bare.alias("bare"))


def lines_of(turns: DataFrame) -> DataFrame:
    """Lines of turns (conv_id, own, turn, text), with the part of each."""
    block = F.shiftright("turn", PART_BITS - LINE_BITS)
    rows = turns.select("conv_id", "own", "turn", "text", F.xxhash64("text").alias("place"), block.alias("block"))
    crowded = written(rows.groupBy("own", "block").agg(F.count("*").alias("n")).where(F.col("n") > PART_ROWS).select("own", "block", F.lit(True).alias("crowded")), "crowded")
    rows = rows.join(crowded, ["own", "block"], "left") if crowded.take(1) else rows.withColumn("crowded", F.lit(None).cast("boolean"))
    # in a crowded block parts are turns and ranges of their rows' hashes
    within = F.shiftleft(F.pmod("turn", F.lit(64)), PART_HASH_BITS) + F.shiftrightunsigned(F.col("place").bitwiseXOR(F.lit(-(1 << 63))), 64 - PART_HASH_BITS)
    part = F.shiftleft("block", PART_HASH_BITS + 6) + F.when(F.col("crowded"), within).otherwise(0)
    rows = rows.select("conv_id", "own", "turn", "place", part.alias("part"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.select("conv_id", "own", "part", "place", (F.shiftleft("turn", LINE_BITS) + F.col("pos")).alias("line_no"), "line")


def op7_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns recovered from transcripts of all conversations: conv_id,
    start_line, role, n_lines and rendered.

    Learns from conversations whose crc32(conv_id as text) mod 4 isn't 2.
    Nulls: a row without conv_id is a transcript of its own, a null turn is
    turn 0, a null text an empty line, a null role isn't learned from.  Rows
    that repeat a turn are lines one after the other, in the order of a hash
    of their text.  Long texts are lines like others.  Ties go to the role
    first in the alphabet.  No rows, or no role at all, give no rows.  Other
    columns are ignored.
    """
    turns = marked(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    outside = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % FOLDS, F.lit(-1)) != HELD_OUT
    model = fit(turns.where(outside))
    if model is None:
        return spark.createDataFrame([], "conv_id long, start_line long, role string, n_lines long, rendered string")
    return recover_turns(lines_of(turns), model)
