"""Conversation structure repair by the auction shortest-path algorithm.

A conversation's rows are the layers of a lattice whose nodes say how its repaired part ends: nothing yet,
a system turn, a user turn, an assistant turn. Keep, Rerole and Delete lead to the next layer, Insert stays in its
layer; costs are integers. The auction extends a path from a node by its best arc while its price allows
and else raises the price and contracts the path. The prices at its end are an optimal dual: an arc
is on a cheapest path exactly if it is tight and leads on to the end over tight arcs, and of those the trace
takes the least letter at each step, for all nodes that the same letters reach at once.

Whole conversations are repaired where the sorted rows lie. Those cut by a border between partitions, or longer than
a segment, are repaired in segments: each gives its matrix of costs between its ends, a sweep over the
matrices gives the prices at the borders, and each segment is traced on its own with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandsieve.llm.common import HOT_SHARE, checkpointed

# --- fixed values: costs and letters of the edits -----------------------------
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# ------------------------------------------------------------------------------
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES = (NONE, SYSTEM, USER, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60
#: Rows of a lattice that one auction solves; a longer one is solved block by block from its end.
BLOCK = 32
#: Rows of a conversation that are held at once.
SEGMENT = 1024
WHITE = " \t\n\x0b\x0c\r"

Step = tuple[str, int, bool]  # initial or "d" for rows that must go, how many rows, truncated


def _after(state: int, initial: str) -> int | None:
    """The state after a turn of that initial, or None if the turn may not stand there."""
    if initial == "s":
        return SYSTEM if state == NONE else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def _lattice(steps: tuple[Step, ...], ends: tuple[int, ...], final: bool) -> list[list[tuple[int, int, str]]]:
    """Arcs (cost, target, letters) of each node 4 * layer + state; the last node is the target behind ``ends``."""
    n = len(steps)
    target = 4 * (n + 1)
    arcs: list[list[tuple[int, int, str]]] = [[] for _ in range(target + 1)]
    for layer in range(n + 1):
        for q in STATES:
            own = arcs[4 * layer + q]
            if layer < n:
                kind, count, cut = steps[layer]
                own.append((DELETE * count, 4 * (layer + 1) + q, "D" * count))
                if kind != "d":
                    stays = _after(q, kind)
                    if stays is not None:
                        own.append((TRUNCATED * cut, 4 * (layer + 1) + stays, "K"))
                    turned = ASSISTANT if q == USER else USER
                    own.append((REROLE + TRUNCATED * cut, 4 * (layer + 1) + turned, "R"))
            elif ends[q] < FAR:
                own.append((ends[q], target, ""))
            if layer < n or final:
                own.append((INSERT, 4 * layer + (ASSISTANT if q == USER else USER), "I"))
    reach = [False] * target + [True]
    for layer in range(n, -1, -1):
        for _ in range(2):  # arcs inside a layer
            for q in STATES:
                node = 4 * layer + q
                reach[node] = reach[node] or any(reach[j] for _, j, _ in arcs[node])
    return [[a for a in own if reach[a[1]]] for own in arcs]


def _auction(arcs: list[list[tuple[int, int, str]]], price: list[int], origin: int) -> None:
    """Raise ``price`` until ``origin`` has a path of tight arcs to the last node."""
    path, target = [origin], len(arcs) - 1
    while path[-1] != target:
        node = path[-1]
        cost, best = min((cost + price[j], j) for cost, j, _ in arcs[node])
        if price[node] < cost:
            price[node] = cost
            if len(path) > 1:
                path.pop()
        else:
            path.append(best)


@lru_cache(maxsize=1 << 14)
def _solved(steps: tuple[Step, ...], ends: tuple[int, ...], final: bool):
    """Arcs, prices and the nodes that tight arcs lead on from, once every node of the first layer is priced."""
    arcs = _lattice(steps, ends, final)
    price = [0] * len(arcs)
    for q in STATES:
        if arcs[q]:
            _auction(arcs, price, q)
    leads = [False] * (len(arcs) - 1) + [True]
    for layer in range(len(steps), -1, -1):
        for _ in range(2):
            for q in STATES:
                node = 4 * layer + q
                leads[node] = leads[node] or any(leads[j] and price[node] == cost + price[j] for cost, j, _ in arcs[node])
    return arcs, price, leads


def _blocks(steps: tuple[Step, ...], ends: tuple[int, ...], final: bool) -> list[tuple]:
    """The solved blocks of a lattice, first to last, each with its end prices from the next."""
    out = []
    cuts = list(range(0, len(steps), BLOCK)) or [0]
    for at in reversed(cuts):
        solved = _solved(steps[at : at + BLOCK], ends, final and not out)
        out.append((*solved, not out and final))
        arcs, price, _ = solved
        ends = tuple(price[q] if arcs[q] else FAR for q in STATES)
    return out[::-1]


def entry_costs(steps: tuple[Step, ...], ends: tuple[int, ...], final: bool) -> tuple[int, ...]:
    """The least cost from each state in front of ``steps`` to the end, whose states cost ``ends``."""
    arcs, price, _, _ = _blocks(steps, ends, final)[0]
    return tuple(price[q] if arcs[q] else FAR for q in STATES)


def trace(steps: tuple[Step, ...], ends: tuple[int, ...], final: bool, front: tuple[int, ...]) -> tuple[str, tuple[int, ...]]:
    """The least letters of cheapest paths from the states ``front``, and the states behind them."""
    letters = []
    for arcs, price, leads, last in _blocks(steps, ends, final):
        target, layers = len(arcs) - 1, len(arcs) // 4 - 1
        nodes = {q for q in front if leads[q] and arcs[q]}
        layer = 0
        while True:
            tight = [(word, j) for i in nodes for cost, j, word in arcs[i] if leads[j] and price[i] == cost + price[j]]
            if layer == layers:
                stops = {i for i in nodes for cost, j, _ in arcs[i] if j == target and price[i] == cost}
                if stops or not last:
                    nodes = stops
                    break
            word = min(word for word, _ in tight)
            nodes = {j for w, j in tight if w == word}
            letters.append(word)
            layer += word != "I"
        front = tuple(sorted(i % 4 for i in nodes))
    return "".join(letters), front


#: Where a conversation may end.
ENDS = (0, FAR, FAR, 0)


def applied(steps: list[Step], audit: str, state: int) -> tuple[list[tuple[int, str | None]], int]:
    """(step, role) of the rows that stand after the edits, step -1 for inserted ones and role None for kept ones; the state behind."""
    out, at, place = [], 0, 0
    while place < len(audit):
        letter = audit[place]
        if letter == "D":
            place += steps[at][1]
            at += 1
            continue
        place += 1
        if letter == "K":
            state = _after(state, steps[at][0])
            out.append((at, None))
        else:
            state = ASSISTANT if state == USER else USER
            out.append((at if letter == "R" else -1, ROLE[state]))
        at += letter != "I"
    return out, state


def _lines(steps: list[Step], rows: list[int], roles: list[str], texts: list[str], audit: str, state: int) -> tuple[list[str], int]:
    found, state = applied(steps, audit, state)
    return [f"{role or roles[rows[at]]}:{texts[rows[at]] if at >= 0 else ''}" for at, role in found], state


# ------------------------------------------------------------------------------ rows


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``n`` (how often the row stands there), by the checksum of ``conv_id:turn``."""
    c = conversations
    blank = lambda name: F.coalesce(c[name].cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    return c.select(
        c["conv_id"].alias("conv_id"), c["turn"].alias("turn"),
        F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("n"), kind.alias("kind"),
    ).where("kind <> 0").drop("kind")


def _with_faults(rows: DataFrame) -> DataFrame:
    """Distinct rows with ``n`` repeats, ``fault`` of the first of them (the others are duplicates) and a hash of the text.

    A row is a duplicate if an equal role and text stands under an earlier turn; rows of one turn are
    ordered by role and text, so that equal ones are neighbours.
    """
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role").cast("string"), "role", "text").cast("binary"), 256)
    rows = checkpointed(rows.withColumn("key", key).withColumn("h", F.xxhash64("text")))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = checkpointed(rows.groupBy("key").agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1"))
    hot = F.col("times") * HOT_SHARE > rows.count()
    # of hot keys there are fewer than HOT_SHARE
    few, rest = (again.where(c).drop("times") for c in (hot, ~hot))
    few = F.broadcast(few)
    met = rows.join(few, "key").unionByName(rows.join(few.select("key"), "key", "left_anti").join(rest, "key", "left"))
    text = F.col("text")
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    repeated = F.coalesce(F.col("first") < turn, F.lit(False))
    cut = ~F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1)).isin(".", "!", "?")
    fault = F.when(blank, "b").when(repeated, "d").when(cut, "t").otherwise("")
    return met.select("conv_id", "turn", "role", "text", "h", "n", fault.alias("fault"))


def _steps(initials: list[str], faults: list[str], counts: list[int]) -> tuple[list[Step], list[int]]:
    """The steps of rows, and the row of each step."""
    steps, rows = [], []
    for i, (initial, fault, n) in enumerate(zip(initials, faults, counts, strict=True)):
        if fault in ("b", "d"):
            steps.append(("d", n, False))
            rows.append(i)
            continue
        steps.append((initial if initial in ("s", "u", "a") else "x", 1, fault == "t"))
        rows.append(i)
        if n > 1:
            steps.append(("d", n - 1, False))
            rows.append(i)
    return steps, rows


def _illegal(initials: list[str], counts: list[int]) -> int:
    pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return pairs + sum(counts) - len(counts)


#: What the pass over sorted rows gives: results of whole conversations (cut false), rows of the others.
_MET = "cut boolean, conv_id {id}, illegal long, cost long, audit string, repaired_sha256 string, part long, seq long, role string, text string, n long, fault string"


def _assembled(ordered: DataFrame, segment: int) -> DataFrame:
    schema = _MET.format(id=ordered.schema["conv_id"].dataType.simpleString())
    id_type = "conv_id"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []  # rows of the conversation at hand
        name, first, long = None, True, False
        kind = None

        def results(rows: list[tuple]) -> tuple:
            initials, roles, texts = [r[1][:1] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
            counts, faults = [r[3] for r in rows], [r[4] for r in rows]
            steps, of = _steps(initials, faults, counts)
            cost = entry_costs(tuple(steps), ENDS, True)[NONE]
            audit, _ = trace(tuple(steps), ENDS, True, (NONE,))
            lines, _ = _lines(steps, of, roles, texts, audit, NONE)
            digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
            return (False, rows[0][0], _illegal(initials, counts), cost, audit, digest, None, None, None, None, None, None)

        def pieces(rows: list[tuple]) -> list[tuple]:
            nonlocal seq
            out = []
            for r in rows:
                out.append((True, r[0], None, None, None, None, part, seq, *r[1:]))
                seq += 1
            return out

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            names = [f.split()[0] for f in schema.split(", ")]
            kinds = [pa.bool_(), kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            kind = batch.schema.field(id_type).type
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "n", "fault")), strict=True):
                if held and row[0] != name:
                    out += pieces(held) if first or long else [results(held)]
                    held, first, long = [], False, False
                elif not held and long and row[0] != name:
                    first, long = False, False
                name = row[0]
                held.append(row)
                if len(held) >= segment:
                    out += pieces(held)
                    held, long = [], True
            yield batch_of(out)
        if held:
            yield batch_of(pieces(held))  # may go on in the next partition

    return ordered.mapInArrow(run, schema)


# ------------------------------------------------------------------------------ cut conversations

_FRONTS = [tuple(q for q in STATES if bits >> q & 1) for bits in range(16)]


def _number(front: tuple[int, ...]) -> int:
    return sum(1 << q for q in front)


def _segment_steps(rows: pd.DataFrame) -> tuple[list[Step], list[int], list[str]]:
    initials = [r[:1] for r in rows["role"]]
    steps, of = _steps(initials, rows["fault"].tolist(), rows["n"].tolist())
    return steps, of, initials


def _repaired_cuts(cuts: DataFrame, segment: int) -> DataFrame:
    """Results of conversations whose rows come as (part, seq) in order; no group holds more than a segment's rows."""
    id_type = cuts.schema["conv_id"].dataType.simpleString()
    keys = ["conv_id", "part", "seg"]
    rows = checkpointed(cuts.withColumn("seg", F.floor(F.col("seq") / segment)))

    def matrices(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        steps, _, initials = _segment_steps(group)
        costs = [entry_costs(tuple(steps), tuple(0 if q == end else FAR for q in STATES), False) for end in STATES]
        return pd.DataFrame(
            {
                **{k: [group[k].iloc[0]] for k in keys},
                "costs": [np.array(costs, np.int64).tobytes()],
                "illegal": [_illegal(initials, group["n"].tolist())],
                "first": [initials[0]],
                "last": [initials[-1]],
            }
        )

    schema = f"conv_id {id_type}, part long, seg long, costs binary, illegal long, first string, last string"
    parts = checkpointed(rows.groupBy(*keys).applyInPandas(matrices, schema))

    def borders(group: pd.DataFrame) -> pd.DataFrame:
        """The prices behind each segment; small rows, one for a segment."""
        group = group.sort_values(["part", "seg"]).reset_index(drop=True)
        ends = entry_costs((), ENDS, True)
        behind, finals = [], []
        for at in range(len(group) - 1, -1, -1):
            behind.append(np.array(ends, np.int64).tobytes())
            finals.append(at == len(group) - 1)
            costs = np.frombuffer(group["costs"][at], np.int64).reshape(4, 4)  # by end, then by entry
            ends = tuple(min(FAR, *(int(costs[e][q]) + ends[e] for e in STATES)) for q in STATES)
        pairs = [b + a not in ("su", "ua", "au") for b, a in zip(group["last"], group["first"][1:], strict=False)]
        return pd.DataFrame(
            {
                **{k: group[k] for k in keys},
                "ends": behind[::-1],
                "final": finals[::-1],
                "cost": ends[NONE],
                "illegal": int(group["illegal"].sum()) + sum(pairs),
            }
        )

    schema = f"conv_id {id_type}, part long, seg long, ends binary, final boolean, cost long, illegal long"
    priced = checkpointed(parts.groupBy("conv_id").applyInPandas(borders, schema))

    # a final segment is traced to its border, then the conversation's end by an empty lattice of its own
    def exits(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Where the trace from each set of states, and the edits from each state, lead behind the segment."""
        left, ends = left.sort_values("seq"), tuple(np.frombuffer(right["ends"].iloc[0], np.int64).tolist())
        steps, _, _ = _segment_steps(left)
        fronts, states = [], []
        costs = entry_costs(tuple(steps), ends, False)
        for front in _FRONTS:
            if not front or any(costs[q] >= FAR for q in front):
                fronts.append(0)
                states.append([0] * 4)
                continue
            audit, behind = trace(tuple(steps), ends, False, front)
            fronts.append(_number(behind))
            states.append([_state_behind(steps, audit, q) if q in front else 0 for q in STATES])
        return pd.DataFrame({**{k: [left[k].iloc[0]] for k in keys}, "fronts": [bytes(fronts)], "states": [bytes(sum(states, []))]})

    schema = f"conv_id {id_type}, part long, seg long, fronts binary, states binary"
    led = checkpointed(rows.groupBy(*keys).cogroup(priced.groupBy(*keys)).applyInPandas(exits, schema))

    def entries(group: pd.DataFrame) -> pd.DataFrame:
        """The set of states and the state in front of each segment; small rows, one for a segment."""
        group = group.sort_values(["part", "seg"]).reset_index(drop=True)
        front, state, fronts, states = 1 << NONE, NONE, [], []
        for f, s in zip(group["fronts"], group["states"], strict=True):
            fronts.append(front)
            states.append(state)
            front, state = f[front], s[4 * front + state]
        return pd.DataFrame({**{k: group[k] for k in keys}, "front": fronts, "state": states})

    entered = led.groupBy("conv_id").applyInPandas(entries, f"conv_id {id_type}, part long, seg long, front int, state int")
    same = [priced[k].eqNullSafe(entered[k]) for k in keys]
    entered = checkpointed(priced.join(entered, same).select(priced["*"], entered["front"], entered["state"]))

    def pieces(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The letters and repaired lines of a segment."""
        left, right = left.sort_values("seq"), right.iloc[0]
        ends = tuple(np.frombuffer(right["ends"], np.int64).tolist())
        steps, of, _ = _segment_steps(left)
        audit, front = trace(tuple(steps), ends, False, _FRONTS[right["front"]])
        lines, state = _lines(steps, of, left["role"].tolist(), left["text"].tolist(), audit, right["state"])
        if right["final"]:
            more, _ = trace((), ENDS, True, front)
            added, _ = _lines([], [], [], [], more, state)
            audit, lines = audit + more, lines + added
        return pd.DataFrame({**{k: [left[k].iloc[0]] for k in keys}, "audit": [audit], "lines": [len(lines)], "body": ["\n".join(lines)], "final": [bool(right["final"])], "cost": [right["cost"]], "illegal": [right["illegal"]]})

    schema = f"conv_id {id_type}, part long, seg long, audit string, lines long, body string, final boolean, cost long, illegal long"
    cut = rows.groupBy(*keys).cogroup(entered.groupBy(*keys)).applyInPandas(pieces, schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pass over the segments in order: a digest takes a conversation's texts one after the other."""
        digest, audit, any_ = hashlib.sha256(), [], False
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["lines"]:
                    digest.update((b"\n" if any_ else b"") + r["body"].encode())
                    any_ = True
                audit.append(r["audit"])
                if r["final"]:
                    done.append((r["conv_id"], r["illegal"], r["cost"], "".join(audit), digest.hexdigest()))
                    digest, audit, any_ = hashlib.sha256(), [], False
            columns = list(zip(*done, strict=True)) or [()] * 5
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "illegal", "cost", "audit", "repaired_sha256"])

    ordered = cut.repartition("conv_id").sortWithinPartitions(*keys)
    return ordered.mapInArrow(digests, f"conv_id {id_type}, illegal long, cost long, audit string, repaired_sha256 string")


def _state_behind(steps: list[Step], audit: str, state: int) -> int:
    """The state after ``audit``, or the first one if its letters can't be applied from ``state``."""
    try:
        return applied(steps, audit, state)[1] or NONE
    except (KeyError, TypeError):
        return NONE


def repair(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Per conv_id of ``conversations``, after the damage: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first, and inside a turn by role and text; repeated rows are duplicates.
    A null conv_id is one conversation; null turns, roles and texts read as one blank (null turns leave gaps
    alone). Roles count by their first letter; a role without one of s, u and a cannot be kept. A
    conversation without rows has zeros, an empty audit and the digest of nothing; an empty table gives an empty
    result. Other columns are not read. Texts of a conversation meet in one place only to be digested,
    one after the other.
    """
    rows = checkpointed(_with_faults(damaged(conversations)))
    counts = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("fault") == "b", F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "d", F.col("n")).when(F.col("fault") != "b", F.col("n") - 1).otherwise(0)).alias("duplicate"),
        F.sum((F.col("fault") == "t").cast("long")).alias("truncated"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "h", "text"]
    ordered = rows.repartitionByRange(*order[:4]).sortWithinPartitions(*order)
    met = checkpointed(_assembled(ordered, segment))
    results = ["conv_id", "illegal", "cost", "audit", "repaired_sha256"]
    whole = met.where("NOT cut").select(*results)
    cuts = met.where("cut").select("conv_id", "part", "seq", "role", "text", "n", "fault")
    done = whole.unionByName(_repaired_cuts(cuts, segment).select(*results))
    every = conversations.select(conversations["conv_id"].alias("conv_id")).distinct()
    return (
        every.join(counts.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left")
        .join(done.withColumnRenamed("conv_id", "r"), F.col("conv_id").eqNullSafe(F.col("r")), "left")
        .select(
            "conv_id",
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
        )
    )
