"""Chat formatting with role repair of least cost.

A legal conversation is an optional system turn, then user and assistant turns in alternation, a user turn first; it may end with either. Each
source turn may stay as it is, be merged into the turn before it, be given another role, or have one empty turn put in front of it; each of these
has a cost, and dynamic programming over the automaton of legal turns finds the cheapest repair. A step depends on the source role only,
so a stretch of turns is a small matrix of costs from state to state: a conversation of any length is cut into segments, whose
matrices are made in parallel, joined per conversation, and then traced back segment by segment.

The result has a row for each source turn and each inserted one; the fragments of a conversation in the order of ``seq`` are its rendered text.

Defined cases: roles are compared trimmed and in lower case, and any other role, or none, has to be relabelled; a null text is empty; turns go by (turn, role, text), null
turns first; repeated turns are turns; turns without a conv_id are one conversation; the template's own marks inside a text are broken by a space; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shelfspark.llm.common import own_id, text_or_empty
from shelfspark.operators.ranking import rank_in_group
from shelfspark.session import materialize

SEGMENT_TURNS = 4096
ROLES = ("system", "user", "assistant")
#: Costs: merge with the turn before; insert an empty turn; give another role to a turn of a known role, and of an unknown one.
MERGE, INSERT, RELABEL, NAME = 1, 2, 3, 1
#: States: nothing yet, and after a turn of each role. What may follow each.
START, AFTER = 0, {role: k + 1 for k, role in enumerate(ROLES)}
_NEXT = {0: ("system", "user"), 1: ("user",), 2: ("assistant",), 3: ("user",)}
_FAR = 1 << 60
Step = tuple[int, str, str, str]  # cost, action, role, inserted role


def steps(source: str | None) -> dict[tuple[int, int], Step]:
    """The cheapest way from state to state by one source turn of that role; of equal costs, the first in the order keep, merge, relabel, insert."""
    def label(role: str) -> int:
        return 0 if role == source else RELABEL if source in ROLES else NAME

    ways: dict[tuple[int, int], list[Step]] = {}
    for state in range(4):
        for role in _NEXT[state]:
            ways.setdefault((state, AFTER[role]), []).append((label(role), "keep" if role == source else "relabel", role, ""))
        if state:
            role = ROLES[state - 1]
            ways.setdefault((state, state), []).append((MERGE + label(role), "merge", role, ""))
        for inserted in _NEXT[state]:
            for role in _NEXT[AFTER[inserted]]:
                ways.setdefault((state, AFTER[role]), []).append(
                    (INSERT + label(role), "keep" if role == source else "relabel", role, inserted))
    order = ("keep", "merge", "relabel")
    return {ends: min(found, key=lambda w: (w[0], w[3] != "", order.index(w[1]), w[3])) for ends, found in ways.items()}


def table_of_steps() -> dict[str | None, dict[tuple[int, int], Step]]:
    return {role: steps(role) for role in (*ROLES, None)}


def through(costs: list[int], ways: dict[tuple[int, int], Step]) -> list[int]:
    """Least costs to reach each state after one more turn."""
    out = [_FAR] * 4
    for (a, b), way in ways.items():
        if (cost := costs[a] + way[0]) < out[b]:
            out[b] = cost
    return out


def end_cost(state: int) -> int:
    """What it takes to end there: a lone system turn gets an empty user turn."""
    return 0 if state in (2, 3) else INSERT if state == 1 else _FAR


def trace(roles: list[str | None], entry: int, leave: int, table: dict) -> list[Step]:
    """The steps of a cheapest way from one state to another."""
    costs = [[0 if s == entry else _FAR for s in range(4)]]
    for role in roles:
        costs.append(through(costs[-1], table[role]))
    state, out = leave, []
    for k in range(len(roles) - 1, -1, -1):
        ways = table[roles[k]]
        before = min((s for s in range(4) if (s, state) in ways), key=lambda s: (costs[k][s] + ways[s, state][0], s))
        out.append(ways[before, state])
        state = before
    return out[::-1]


def repair(roles: list[str | None]) -> tuple[int, list[Step]]:
    """Cost and steps of the cheapest repair of a whole conversation of known roles and None."""
    table, costs = table_of_steps(), [0, _FAR, _FAR, _FAR]
    for role in roles:
        costs = through(costs, table[role])
    leave = min(range(4), key=lambda s: (costs[s] + end_cost(s), s))
    return costs[leave] + end_cost(leave), trace(roles, START, leave, table)


def _known(role: str | None) -> str | None:
    return role if role in ROLES else None


def _runs(batches: Iterator[pa.RecordBatch], names: list[str], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows, as tuples of the named columns, that agree in the first ``keys`` of them."""
    rows = (row for batch in batches for k in range(0, batch.num_rows, 1024)
            for row in zip(*(batch.slice(k, 1024).column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True))
    return groupby(rows, key=lambda r: r[:keys])


def _emit(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _in_blocks(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _emit(held, names, kinds)
            held = []
    yield _emit(held, names, kinds)


def _break_marks(text: str) -> str:
    return text.replace("<|im_start|>", "<|im_start |>").replace("<|im_end|>", "<|im_end |>")


def format_conversations(conversations: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """(conv_id, seq, turn, action, source_role, role, fragment, cost) of every source turn and every inserted one.

    ``action`` is keep, merge, relabel or insert; ``cost`` that of the conversation's whole repair.
    """
    spark = conversations.sparkSession
    turns = conversations.select(own_id(conversations, "conv_id").alias("conv_id"), own_id(conversations, "turn").alias("turn"),
                                 F.lower(F.trim(F.col("role"))).alias("_role"), text_or_empty("text").alias("_text"))
    # Always by slices, so that a conversation of any length is spread over several tasks.
    ranked = rank_in_group(turns, ["conv_id"], ["turn", "_role", "_text"], "_rank", slices=int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranked = materialize(ranked.withColumn("_segment", F.floor((F.col("_rank") - 1) / segment_turns).cast("bigint")), "turns")
    table = table_of_steps()
    names = ["conv_id", "_segment", "_role"]
    conv_type, turn_type = ranked.schema["conv_id"].dataType, ranked.schema["turn"].dataType
    kind, turn_kind, conv_sql, turn_sql = to_arrow_type(conv_type), to_arrow_type(turn_type), conv_type.simpleString(), turn_type.simpleString()

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for key, run in _runs(batches, names, 2):
                costs = [[0 if a == b else _FAR for b in range(4)] for a in range(4)]
                for *_, role in run:
                    costs = [through(line, table[_known(role)]) for line in costs]
                yield (*key, [c for line in costs for c in line])
        return _in_blocks(rows(), ["conv_id", "_segment", "_costs"], [kind, pa.int64(), pa.list_(pa.int64())])

    by_segment = ranked.select(*names, "_rank").repartition("conv_id", "_segment").sortWithinPartitions("conv_id", "_segment", "_rank")
    segments = by_segment.mapInArrow(matrices, f"conv_id {conv_sql}, _segment long, _costs array<long>")

    def joints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (conv,), run in _runs(batches, ["conv_id", "_segment", "_costs"], 1):
                maps = [r[2] for r in run]  # one small matrix for each segment
                costs = [[0, _FAR, _FAR, _FAR]]
                for m in maps:
                    costs.append([min(min(costs[-1][a] + m[4 * a + b] for a in range(4)), _FAR) for b in range(4)])
                leave = min(range(4), key=lambda s: (costs[-1][s] + end_cost(s), s))
                total, out = costs[-1][leave] + end_cost(leave), []
                for k in range(len(maps) - 1, -1, -1):
                    entry = min(range(4), key=lambda s: (costs[k][s] + maps[k][4 * s + leave], s))
                    out.append((conv, k, entry, leave, total, k == len(maps) - 1))
                    leave = entry
                yield from out
        return _in_blocks(rows(), ["conv_id", "_segment", "_entry", "_leave", "_cost", "_last"], [kind, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()])

    joined = segments.repartition("conv_id").sortWithinPartitions("conv_id", "_segment").mapInArrow(
        joints, f"conv_id {conv_sql}, _segment long, _entry int, _leave int, _cost long, _last boolean")
    # A segment's ends travel with its turns, in front of them.
    both = ranked.unionByName(joined.withColumn("_rank", F.lit(0).cast("bigint")), allowMissingColumns=True)
    both = both.repartition("conv_id", "_segment").sortWithinPartitions("conv_id", "_segment", "_rank")
    all_names = ["conv_id", "_segment", "_rank", "turn", "_role", "_text", "_entry", "_leave", "_cost", "_last"]
    out_names = ["conv_id", "seq", "turn", "action", "source_role", "role", "fragment", "cost"]

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (conv, _), run in _runs(batches, all_names, 2):
                head, *own = run  # at most segment_turns turns
                entry, leave, cost, last = head[6:]
                way = trace([_known(r[4]) for r in own], entry, leave, table)
                for k, (row, (_, action, role, inserted)) in enumerate(zip(own, way, strict=True)):
                    rank, turn, source, text = row[2:6]
                    close = "" if rank == 1 else "<|im_end|>\n"
                    if inserted:
                        yield conv, 2 * rank - 1, None, "insert", None, inserted, f"{close}<|im_start|>{inserted}\n", cost
                        close = "<|im_end|>\n"
                    text = _break_marks(text)
                    fragment = f"\n\n{text}" if action == "merge" else f"{close}<|im_start|>{role}\n{text}"
                    ends = last and k == len(own) - 1
                    lone = ends and leave == 1
                    yield conv, 2 * rank, turn, action, source, role, fragment + "<|im_end|>\n" * (ends and not lone), cost
                    if lone:
                        yield conv, 2 * rank + 1, None, "insert", None, "user", "<|im_end|>\n<|im_start|>user\n<|im_end|>\n", cost
        return _in_blocks(rows(), out_names, [kind, pa.int64(), turn_kind, *[pa.string()] * 4, pa.int64()])

    return both.mapInArrow(render, f"conv_id {conv_sql}, seq long, turn {turn_sql}, action string, source_role string, role string, fragment string, cost long")


def rendered(fragments: DataFrame) -> DataFrame:
    """(conv_id, cost, n_turns, text) of conversations short enough for one string each."""
    whole = F.array_sort(F.collect_list(F.struct("seq", "fragment")))
    return fragments.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.count(F.when(F.col("action") != "merge", True)).alias("n_turns"),
                                            F.concat_ws("", F.transform(whole, lambda f: f["fragment"])).alias("text"))
