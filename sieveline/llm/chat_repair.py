"""Conversation structure repair: cheapest edits to `(s?(ua)+)?` by lazy weighted determinisation.

A weighted automaton reads the rows of a conversation: Keep, Rerole, Delete and Insert move over four states
(start, after system, after user, after assistant). The vector of least costs from each state to an accepted
end, less its minimum, is a state of the determinised automaton; states and transitions are made when a
conversation first needs them and kept in a table, so a scan is one lookup a row. The scan runs from the last row
to the first; the trace then goes the other way over it, backward in the scan's sense, and takes at each place
the ASCII-least letter whose arc is tight. That is the least of all cheapest edit sequences.

Rows are range-partitioned and sorted by conversation and turn, numbered, and worked on in segments of SEGMENT
rows in a row. A segment gives, for each conversation in it, a 4 x 4 table of least costs; tables are combined
over the few segments of a long conversation, each segment is scanned from the vector found at its end,
traced from each state in which it may begin, and the traces are chained. So no conversation is one task's work;
only its audit string and its repaired text are one value each.

Defined results: null role and text are one space, and so are null conv_id and turn in the damage key; rows
with a null conv_id are one conversation; rows of one turn are ordered by role and text; rows equal in all are
kept as often as they come; empty roles have no initial and fit nowhere; an empty table gives an empty result;
long texts are not cut; other columns are ignored. `repair` works on any rows, `damage` is the query's own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

NAME = "op13_chat_repair"
SEGMENT = 4096
SPACES = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
NEVER = 1 << 60
#: state after an inserted or reroled row, and after a kept row by its initial (s, u, a, other)
ADDED = (2, 2, 3, 2)
KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
ROLE = {2: "user", 3: "assistant"}
ENDS = (0, 3)
LEGAL = {(0, 1), (1, 2), (2, 1)}
OK, TRUNCATED, DOOMED = 0, 1, 2  # a row's symbol is 3 * initial + one of these


def inserted(v: list[int]) -> list[int]:
    """Costs to go with insertions before what follows."""
    for _ in range(3):
        v = [min(v[q], INSERT + v[ADDED[q]]) for q in range(4)]
    return v


class Determinised:
    """Normalised cost vectors as states, made when they are first reached, and their transition table."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.vector: list[tuple] = []
        self.table: list[list[tuple[int, int] | None]] = []

    def state(self, v) -> tuple[int, int]:
        """(state, what was taken off) of a vector."""
        low = min(v)
        key = tuple(min(x - low, NEVER) if x < NEVER else NEVER for x in v)
        if key not in self.number:
            self.number[key] = len(self.vector)
            self.vector.append(key)
            self.table.append([None] * 12)
        return self.number[key], low

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """(state, weight) before a row, from the state after it."""
        got = self.table[state][symbol]
        if got is None:
            v, (initial, kind) = self.vector[state], divmod(symbol, 3)
            out = [DELETE + x for x in v]
            if kind != DOOMED:
                more = CUT if kind == TRUNCATED else 0
                for q in range(4):
                    out[q] = min(out[q], REROLE + more + v[ADDED[q]])
                    if q in KEPT[initial]:
                        out[q] = min(out[q], more + v[KEPT[initial][q]])
            got = self.table[state][symbol] = self.state(inserted(out))
        return got

    def scan(self, symbols: list[int], end) -> tuple[list[int], list[int], int]:
        """States and weights at each place (the last is the end), and the weight of all."""
        state, total = self.state(end)
        states, weights = [state], [0]
        for s in reversed(symbols):
            state, w = self.step(state, s)
            states.append(state)
            weights.append(w)
            total += w
        return states[::-1], weights[::-1], total

    def trace(self, symbols: list[int], states: list[int], weights: list[int], q: int, last: bool) -> tuple[int, str]:
        """(state at the end, least string of edits) from state q; `last` adds what must come after all rows."""
        out = []
        for t, symbol in enumerate(symbols):
            now, then = self.vector[states[t]], self.vector[states[t + 1]]
            initial, kind = divmod(symbol, 3)
            more = CUT if kind == TRUNCATED else 0
            while True:
                goal = now[q] + weights[t]
                if DELETE + then[q] == goal:
                    out.append("D")
                    break
                if INSERT + now[ADDED[q]] == now[q]:
                    out.append("I")
                    q = ADDED[q]
                elif q in KEPT[initial] and more + then[KEPT[initial][q]] == goal:
                    out.append("K")
                    q = KEPT[initial][q]
                    break
                else:
                    out.append("R")
                    q = ADDED[q]
                    break
        while last and q not in ENDS:
            out.append("I")
            q = ADDED[q]
        return q, "".join(out)


FINAL = inserted([0 if q in ENDS else NEVER for q in range(4)])


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by a checksum of `conv_id:turn` modulo 20."""
    mark = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))).cast("binary")) % 20
    d = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), mark.alias("m")).where("m <> 0")
    text = F.when(F.col("m") == 1, "").when(F.col("m") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("m") == 4, "user").otherwise(F.col("role"))
    d = d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("m") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("n"))
    return d.withColumn("n", F.explode("n")).drop("n")


def faulted(rows: DataFrame) -> DataFrame:
    """Written rows in order: at (a number that grows along conversations and turns), ck, fault flags and symbol."""
    spark = rows.sparkSession
    d = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")).alias("ck"), "turn",
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(parts, "ck", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("ck", "turn", "role", "text")
    d = materialise(d.withColumn("at", F.monotonically_increasing_id()), "ordered")
    d = d.withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("sha", F.sha2("text", 256))
    first = d.where("not blank").groupBy("ck", "role", "sha").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    d = d.join(first, "at", "left")
    cut = ~F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1).isin(".", "!", "?")
    d = d.withColumn("duplicate", ~F.col("blank") & F.col("first").isNull()).withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & cut)
    initial = F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1))
    initial = F.when(initial == 0, F.lit(3)).otherwise(initial - 1).cast("int")
    kind = F.when(F.col("blank") | F.col("duplicate"), DOOMED).when(F.col("truncated"), TRUNCATED).otherwise(OK)
    d = d.withColumn("symbol", initial * 3 + kind).withColumn("seg", F.floor(F.col("at") / SEGMENT))
    return materialise(d.select("at", "seg", "ck", "turn", "role", "text", "blank", "duplicate", "truncated", "symbol"), "faults")


def costs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a segment: for each conversation its table of least costs, illegal neighbours, first and last initial."""
    auto, out = Determinised(), []
    for ck, p in pdf.sort_values("at").groupby("ck", sort=False):
        symbols, table = p["symbol"].tolist(), []
        for j in range(4):
            states, _, total = auto.scan(symbols, [0 if q == j else NEVER for q in range(4)])
            table.append([min(x + total, NEVER) for x in auto.vector[states[0]]])
        kinds = [s // 3 for s in symbols]
        out.append((ck, int(p["seg"].iloc[0]), [x for row in table for x in row], sum(x not in LEGAL for x in zip(kinds, kinds[1:])), kinds[0], kinds[-1]))
    return pd.DataFrame(out, columns=["ck", "seg", "table", "illegal", "head", "tail"])


def ends(frames):
    """Of segments sorted by conversation, last first: the vector of costs to go at the end of each, illegal pairs
    (with the one to the next segment) and cost (at a conversation's first segment that of the whole, else less than it
    by what comes before). Only the vector, the initial and the conversation are carried from row to row."""
    ck, v, after = None, FINAL, None
    for pdf in frames:
        out = []
        for name, seg, table, illegal, head, tail in pdf.itertuples(index=False):
            if name != ck:
                ck, v, after = name, FINAL, None
            crossing = 0 if after is None else int((tail, after) not in LEGAL)
            was = v
            v = inserted([min(min(int(table[4 * j + q]) + v[j], NEVER) for j in range(4)) for q in range(4)])
            out.append((name, seg, was, after is None, illegal + crossing, v[0]))
            after = head
        yield pd.DataFrame(out, columns=["ck", "seg", "end", "last", "illegal", "cost"])


def traces(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a segment: for each conversation the state reached and the edits, from each state it may begin in."""
    auto, out = Determinised(), []
    for ck, p in pdf.sort_values("at").groupby("ck", sort=False):
        symbols, last = p["symbol"].tolist(), bool(p["last"].iloc[0])
        states, weights, _ = auto.scan(symbols, [int(x) for x in p["end"].iloc[0]])
        got = [auto.trace(symbols, states, weights, q, last) if auto.vector[states[0]][q] < NEVER else (q, "") for q in range(4)]
        out.append((ck, int(p["seg"].iloc[0]), [g[0] for g in got], [g[1] for g in got]))
    return pd.DataFrame(out, columns=["ck", "seg", "leads", "edits"])


def chained(frames):
    """Of segments sorted by conversation: the state in which each begins and its edits; the state is carried."""
    ck, q = None, 0
    for pdf in frames:
        out = []
        for name, seg, leads, edits in pdf.itertuples(index=False):
            ck, q = name, 0 if name != ck else q
            out.append((name, seg, q, edits[q]))
            q = int(leads[q])
        yield pd.DataFrame(out, columns=["ck", "seg", "begins", "edits"])


def edited(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a segment: rows that stay (with their new role, null where kept) and inserted ones, by (at, place)."""
    out = []
    for ck, p in pdf.sort_values("at").groupby("ck", sort=False):
        ats, symbols, q = p["at"].tolist(), p["symbol"].tolist(), int(p["begins"].iloc[0])
        t = place = 0
        for letter in p["edits"].iloc[0]:
            if letter == "I":
                q, place = ADDED[q], place + 1
                after = t == len(ats)
                out.append((ats[t - after], place if after else place - (1 << 20), ROLE[q], True))
                continue
            if letter == "K":
                q = KEPT[symbols[t] // 3][q]
                out.append((ats[t], 0, None, False))
            elif letter == "R":
                q = ADDED[q]
                out.append((ats[t], 0, ROLE[q], False))
            t, place = t + 1, 0
    d = pd.DataFrame(out, columns=["at", "place", "new_role", "is_new"])
    return d.astype({"at": "int64", "place": "int64", "new_role": object, "is_new": bool})


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired rows) of conv_id, turn, role, text rows.

    Report: ck (a text key of conv_id), gaps, blank, duplicate, truncated, illegal, cost, audit. Repaired rows:
    ck, at, place (their order), role, text, is_new."""
    d = faulted(rows)
    slim = d.select("at", "seg", "ck", "symbol")
    tables = slim.groupBy("seg").applyInPandas(costs, "ck string, seg long, table array<long>, illegal long, head int, tail int")
    tables = tables.repartition("ck").sortWithinPartitions("ck", F.desc("seg"))
    closing = materialise(tables.mapInPandas(ends, "ck string, seg long, end array<long>, last boolean, illegal long, cost long"), "ends")
    traced = slim.join(closing.select("ck", "seg", "end", "last"), ["ck", "seg"]).groupBy("seg").applyInPandas(traces, "ck string, seg long, leads array<int>, edits array<string>")
    traced = traced.repartition("ck").sortWithinPartitions("ck", "seg")
    parts = materialise(traced.mapInPandas(chained, "ck string, seg long, begins int, edits string"), "edits")
    moves = slim.join(parts, ["ck", "seg"]).groupBy("seg").applyInPandas(edited, "at long, place long, new_role string, is_new boolean")
    out = d.select("at", "ck", "role", "text").join(moves, "at")
    out = out.select("ck", "at", "place", F.coalesce("new_role", "role").alias("role"), F.when(F.col("is_new"), "").otherwise(F.col("text")).alias("text"), "is_new")
    number = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps")
    counts = d.groupBy("ck").agg(gaps, number("blank"), number("duplicate"), number("truncated"))
    sums = closing.groupBy("ck").agg(F.sum("illegal").alias("illegal"), F.min_by("cost", "seg").alias("cost"))
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "edits"))), lambda x: x["edits"]), "").alias("audit")
    return counts.join(sums, "ck").join(parts.groupBy("ck").agg(audit), "ck"), out


def digests(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """The report with the SHA-256 of each repaired conversation, a row for every conv_id of conversations."""
    report, fixed = repair(rows)
    line = F.struct("at", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n")
    texts = fixed.groupBy("ck").agg(F.sha2(text, 256).alias("sha"))
    every = conversations.select("conv_id").distinct().withColumn("ck", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")))
    d = every.join(report, "ck", "left").join(texts, "ck", "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return d.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return digests(conversations, damage(conversations))
