"""Repair of the structure of conversations at the least cost.

A repaired conversation is empty, or has an optional system turn and then user and assistant turns in alternation. Its rows are
kept, given another role or deleted, and empty turns are inserted; the cheapest edits are the shortest path from the first
row to the last through four states: nothing yet (0), after system (1), after user (2), after assistant (3). Of all cheapest
edits those are taken whose initials, read in order, come first (D, I, K, R).

First costs: what each state costs from there to the end. Rows are cut into blocks of at most 1,024; a block is a 4 x 4 table
of costs from each state at its start to each at its end, and a conversation of several blocks combines the tables of 1,
2, 4, ... blocks by joins. Then paths, by prefix doubling: nodes are (row, state), arcs those on a cheapest path. Each node
knows the rank of the least initials of its next 1, 2, 4, ... edits among all nodes and a pointer to the node after them; a rank
of twice the length is the rank of the pair of its own and its pointer's rank. The arcs of one node have different initials, so
what follows a block can't change what is least inside it, and blocks are ranked apart; which state a block is entered in
follows by doubled pointers from block to block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.storage import materialise, stored

#: Rows of a conversation that are gone through together.
BLOCK_BITS = 10
#: Rows whose paths are ranked together.
TOGETHER = 50_000
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 3, 3, 4, 3
_FAR = 1 << 40
#: Where the initials s, u, a lead from each state (None of them from a state that has no such turn), and any other initial.
_NEXT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: The state that an inserted or renamed turn leads to: user after all but user, assistant after user.
_TURN = np.array([2, 2, 3, 2])
_ENDS = [0, 6, 3, 0]
_SPACE = " \t\n\x0b\x0c\r"
_LETTERS = "DIKR"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there): rows harmed by the remainder of crc32('conv_id:turn') by 20; nulls read as one space.

    0 drops the row (there is false, so that its conversation is not lost), 1 empties its text, 2 takes . ! ? out of it, 3
    repeats it, 4 makes its role user.
    """
    kind = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(_text("text"), ".!?", "")).otherwise(_text("text"))
    role = F.when(kind == 4, "user").otherwise(_text("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("there"), times.alias("_")).drop("_")


def _initial(role: str) -> Column:
    return F.coalesce(F.when(F.col(role) != "", F.array_position(F.array(*map(F.lit, "sua")), F.substring(role, 1, 1)) - 1), F.lit(-1))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows in the order (conv_id, turn with nulls first, role, text), with a number that grows in it and their faults.

    Written down once, sorted by range, so a long conversation lies in several partitions. Rows equal in all of these are told apart
    by where they were read.
    """
    order = ["conv_id", "turn", "role", "text", "_read"]
    placed = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_read")
    placed = placed.withColumn("number", F.monotonically_increasing_id()).withColumn("_end", F.rtrim(F.col("text"), F.lit(_SPACE)))
    return stored(placed.withColumns({
        "blank": F.col("_end") == "", "truncated": ~F.substring("_end", -1, 1).isin(".", "!", "?"), "initial": _initial("role"),
        "alike": F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256),
    }).drop("_end"), "turns")


def _same(a: DataFrame, b: DataFrame, *more: Column, how: str = "inner") -> DataFrame:
    """a joined with b by conv_id, of which nulls are alike; b's own column must be named other_id."""
    condition = a["conv_id"].eqNullSafe(b["other_id"])
    for m in more:
        condition = condition & m
    return a.join(b, condition, how).drop("other_id")


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, block, of, numbers, codes): the rows of a conversation in blocks, block counting from 0 to of - 1.

    A code is the initial (3 for any other) + 4 if the row is blank or repeats an earlier one, + 8 if it is cut off and neither, + 16
    if it is blank.
    """
    there = turns.where("there").select("conv_id", "number", "blank", "truncated", "initial", "alike")
    firsts = there.groupBy("conv_id", "alike").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("first"))
    coded = there.join(firsts, "number", "left").withColumn("must", F.col("blank") | F.col("first").isNull())
    code = F.when(F.col("initial") < 0, 3).otherwise(F.col("initial")) + F.col("must").cast("int") * 4
    code = code + (F.col("truncated") & ~F.col("must")).cast("int") * 8 + F.col("blank").cast("int") * 16
    coded = coded.withColumn("code", code).withColumn("place", F.shiftright("number", BLOCK_BITS))
    blocks = coded.groupBy("conv_id", "place").agg(F.array_sort(F.collect_list(F.struct("number", "code"))).alias("rows"))
    of = Window.partitionBy("conv_id")
    blocks = blocks.withColumn("block", F.row_number().over(of.orderBy("place")) - 1).withColumn("of", F.count("*").over(of))
    return blocks.select("conv_id", "block", "of", F.col("rows.number").alias("numbers"), F.col("rows.code").alias("codes"))


def _row_costs(codes: np.ndarray) -> np.ndarray:
    """For each row, what keeping, renaming and deleting it cost, whatever the state."""
    must, late = codes & 4 > 0, (codes & 8 > 0) * TRUNCATED
    free = np.where(must, _FAR, late)
    return np.stack([free + KEEP, free + REROLE, np.full(len(codes), DELETE)])


def _costs_to_go(lengths: np.ndarray, codes: np.ndarray, ends: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cost of each (row, state) to the end of its block, for blocks laid end to end with a node more than rows each.

    ends has the costs of the four states where a block ends; turns may be inserted there only where last says so. Goes from the
    ends to the starts, all blocks together. Returns costs and the first node of each block.
    """
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    cost = np.full((int((lengths + 1).sum()), 4), _FAR)
    cost[first + lengths] = ends
    step, order = _row_costs(codes), np.argsort(-lengths, kind="stable")
    sorted_lengths = -lengths[order]

    def insert(nodes: np.ndarray) -> None:
        for _ in range(2):
            cost[nodes] = np.minimum(cost[nodes], cost[nodes][:, _TURN] + INSERT)

    insert((first + lengths)[last])
    for back in range(1, int(lengths.max(initial=0)) + 1):
        some = order[: np.searchsorted(sorted_lengths, -back, side="right")]
        node, row = (first + lengths)[some] - back, (begin + lengths)[some] - back
        after = cost[node + 1]
        to = _NEXT[:, codes[row] & 3].T
        kept = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 1), _FAR) + step[0, row][:, None]
        cost[node] = np.minimum(np.minimum(kept, after[:, _TURN] + step[1, row][:, None]), after + step[2, row][:, None])
        insert(node)
    return np.minimum(cost, _FAR), first


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of batches of blocks with about TOGETHER rows of conversations each."""
    for batch in batches:
        rows = np.cumsum([len(c) for c in batch.column("codes")])
        while batch.num_rows:
            n = int(np.searchsorted(rows, TOGETHER)) + 1
            yield batch.slice(0, n)
            batch, rows = batch.slice(n), rows[n:] - rows[min(n, len(rows)) - 1]


def _ragged(columns: list) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(c) for c in columns], np.int64)
    return lengths, np.array([x for c in columns for x in c], np.int64)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (conv_id, block, of, codes) with table: the 16 costs from each state at the start to each at the end."""
    for batch in _slices(batches):
        lengths, codes = _ragged(batch.column("codes").to_pylist())
        last = (batch.column("block").to_numpy(zero_copy_only=False) + 1 == batch.column("of").to_numpy(zero_copy_only=False)).astype(bool)
        table = np.full((len(lengths), 4, 4), _FAR)
        for end in range(4):
            ends = np.where(np.arange(4) == end, 0, _FAR) * np.ones((len(lengths), 1), np.int64)
            cost, first = _costs_to_go(lengths, codes, ends, last)
            table[:, :, end] = cost[first]
        made = pa.array(table.reshape(len(lengths), 16).tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), batch.column("of"), made], ["conv_id", "block", "of", "table"])


def _after_blocks(blocks: DataFrame) -> DataFrame:
    """(other_id, other_block, ends): the costs of the four states where a block ends, for blocks of which another follows.

    A block's table is combined with that of the block after it, then with that of the two after those, and so on.
    """
    kind = blocks.schema["conv_id"].dataType.simpleString()
    several = blocks.where("of > 1")
    tables = several.select("conv_id", "block", "of", "codes").mapInArrow(_tables, f"conv_id {kind}, block int, of long, table array<long>")
    tables = materialise(tables)
    most = tables.agg(F.max("of")).first()[0] or 0
    reach = 1
    while reach < most:
        then = tables.select(F.col("conv_id").alias("other_id"), (F.col("block") - reach).alias("other_block"), F.col("table").alias("then"))
        both = [F.least(*(F.col("table")[4 * i + k] + F.col("then")[4 * k + j] for k in range(4)), F.lit(_FAR)) for i in range(4) for j in range(4)]
        joined = _same(tables, then, tables["block"] == then["other_block"], how="left").drop("other_block")
        tables = materialise(joined.withColumn("table", F.when(F.col("then").isNull(), F.col("table")).otherwise(F.array(*both))).drop("then"))
        reach *= 2
    ends = F.array(*(F.least(*(F.col("table")[4 * i + k] + _ENDS[k] for k in range(4))) for i in range(4)))
    return tables.where("block > 0").select(F.col("conv_id").alias("other_id"), (F.col("block") - 1).alias("other_block"), ends.alias("ends"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (conv_id, block, of, numbers, codes, ends) as the edits of the least path from each state they may be entered in.

    A row is (conv_id, block, of, entry, exit, cost, numbers, codes, before, edit, after): for each row of the block the turns inserted before it,
    what is done to it (K, D or R with the new role's initial), and after the last row of a conversation the turns added there.
    """
    for batch in _slices(batches):
        block, of = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "of"))
        lengths, codes = _ragged(batch.column("codes").to_pylist())
        numbers, code_lists = batch.column("numbers").to_pylist(), batch.column("codes").to_pylist()
        ends = np.array(batch.column("ends").to_pylist(), np.int64)
        last = (block + 1 == of).astype(bool)
        cost, first = _costs_to_go(lengths, codes, ends, last)
        owner = np.repeat(np.arange(len(lengths)), lengths + 1)
        at_end = np.arange(len(owner)) == (first + lengths)[owner]
        row = np.arange(len(owner)) - owner  # the row that starts at a node
        code = np.where(at_end, 3 + 4, codes[np.minimum(row, max(len(codes) - 1, 0))] if len(codes) else 7)
        step = _row_costs(code)
        after = np.vstack([cost[1:], np.full((1, 4), _FAR)])
        node, states = np.arange(len(owner))[:, None], np.arange(4)[None, :]
        kept = _NEXT[:, code & 3].T
        ways = [  # in the order of their letters: D, I, K, R
            (after + step[2][:, None], (node + 1) * 4 + states, ~at_end),
            (cost[:, _TURN] + INSERT, node * 4 + _TURN[None, :], ~at_end | last[owner]),
            (np.where(kept >= 0, np.take_along_axis(after, np.maximum(kept, 0), 1), _FAR) + step[0][:, None], (node + 1) * 4 + np.maximum(kept, 0), ~at_end),
            (after[:, _TURN] + step[1][:, None], (node + 1) * 4 + _TURN[None, :], ~at_end),
        ]
        arcs = np.stack([((way == cost) & (cost < _FAR) & may[:, None]).ravel() for way, _, may in ways])
        targets = np.stack([np.broadcast_to(to, cost.shape).ravel() for _, to, _ in ways])
        here, longest = np.arange(arcs.shape[1]), int(3 * lengths.max(initial=0)) + 3

        def doubled(arc: np.ndarray) -> list[np.ndarray]:
            """Pointers past 1, 2, 4, ... edits if each node takes the given arc; a path that has ended stays at its end."""
            pointers = [np.where(arcs.any(0), targets[arc, here], here)]
            while 1 << len(pointers) <= longest:
                pointers.append(pointers[-1][pointers[-1]])
            return pointers

        # Ranks by the next 1, 2, 4, ... initials; the ended have rank 0.
        rank = np.where(arcs.any(0), arcs.argmax(0) + 1, 0)
        for pointer in doubled(arcs.argmax(0)):
            rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1]
        # Of a node's arcs the least initial, and among equal ones the target of least rank, as the whole of what follows is ranked.
        beyond = np.where(arcs, np.arange(4)[:, None] * (rank.max() + 1) + rank[np.where(arcs, targets, 0)], np.iinfo(np.int64).max)
        arc = beyond.argmin(0)
        letter, target, pointer = np.where(arcs.any(0), arc, -1), targets[arc, here], doubled(arc)
        # From an entry the greatest power of two first: the nodes on its path, each with the number of edits before it.
        found = {c: [] for c in ("entry", "exit", "cost", "numbers", "codes", "before", "edit", "after", "from")}
        for entry in range(4):
            starts = np.flatnonzero((block > 0) | (entry == 0))
            starts = starts[cost[first[starts], entry] < _FAR]
            if not len(starts):
                continue
            place = np.full(len(letter), -1)
            place[first[starts] * 4 + entry] = 0
            for k in range(len(pointer) - 1, -1, -1):
                on = np.flatnonzero(place >= 0)
                to = pointer[k][on]
                new = place[to] < 0
                place[to[new]] = place[on[new]] + (1 << k)
            on = np.flatnonzero(place >= 0)
            mine = owner[on // 4]
            on = on[np.lexsort((place[on], mine))]
            mine = owner[on // 4]
            cuts = np.searchsorted(mine, starts), np.searchsorted(mine, starts, side="right")
            for b, low, high in zip(starts.tolist(), *(c.tolist() for c in cuts)):
                before, edit, held = [], [], ""
                path = on[low:high]
                for x, y in zip(letter[path].tolist(), target[path].tolist()):
                    turn = ".sua"[y % 4]
                    if x == 1:
                        held += turn
                    elif x >= 0:
                        before.append(held)
                        edit.append(_LETTERS[x] + (turn if x == 3 else ""))
                        held = ""
                values = (entry, int(path[-1]) % 4, int(cost[first[b], entry]), numbers[b], code_lists[b], before, edit, held, b)
                for c, v in zip(found, values):
                    found[c].append(v)
        source = pa.array(found.pop("from"), pa.int64())
        kinds = {"entry": pa.int32(), "exit": pa.int32(), "cost": pa.int64(), "numbers": pa.list_(pa.int64()), "codes": pa.list_(pa.int32()), "before": pa.list_(pa.string()), "edit": pa.list_(pa.string()), "after": pa.string()}
        held = [batch.column(c).take(source) for c in ("conv_id", "block", "of")]
        yield pa.RecordBatch.from_arrays(held + [pa.array(found[c], t) for c, t in kinds.items()], ["conv_id", "block", "of", *kinds])


def _entered(paths: DataFrame) -> DataFrame:
    """The paths that are taken: of a conversation's first block that from state 0, of another that from where the one before ends.

    The states where 1, 2, 4, ... blocks before a block lead are combined by joins.
    """
    several = paths.where("of > 1").groupBy("conv_id", "block", "of").agg(F.map_from_entries(F.collect_list(F.struct("entry", "exit"))).alias("ways"))
    ways = materialise(several)
    most = ways.agg(F.max("of")).first()[0] or 0
    reach = 1
    while reach < most:
        earlier = ways.select(F.col("conv_id").alias("other_id"), (F.col("block") + reach).alias("other_block"), F.col("ways").alias("_earlier"))
        joined = _same(ways, earlier, ways["block"] == earlier["other_block"], how="left").drop("other_block")
        through = F.map_filter(F.transform_values("_earlier", lambda _, state: F.try_element_at("ways", state)), lambda _, state: state.isNotNull())
        ways = materialise(joined.withColumn("ways", F.when(F.col("_earlier").isNull(), F.col("ways")).otherwise(through)).drop("_earlier"))
        reach *= 2
    entries = ways.select(F.col("conv_id").alias("other_id"), (F.col("block") + 1).alias("other_block"), F.element_at("ways", F.lit(0)).alias("state"))
    rest = paths.where("block > 0")
    rest = _same(rest, entries, rest["block"] == entries["other_block"], rest["entry"] == entries["state"]).drop("other_block", "state")
    return paths.where("block = 0 and entry = 0").unionByName(rest)


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, there, turn, role, text, code, cost, before, edit, after) in order, a result a conversation.

    Of a conversation the hash, the initials of its edits and a few counts are held, not its rows.
    """
    roles, made = {"u": "user", "a": "assistant"}, []
    now, state = None, None

    def end() -> None:
        low, high, turns, _, counts, cost, audit, digest, _, _ = state
        gaps = 0 if low is None else high - low + 1 - turns
        made.append((now[0], gaps, *counts, cost, audit.decode(), digest.hexdigest()))

    def out(kind: pa.DataType) -> pa.RecordBatch:
        names = ["conv_id", *(c.split()[0] for c in _RESULT.split(", "))]
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        columns = list(zip(*made)) or [[]] * len(names)
        made.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for conv, there, turn, role, text, code, cost, before, edit, after in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now[0] != conv:
                if now is not None:
                    end()
                if len(made) >= 10_000:
                    yield out(kind)
                # least and greatest turn, different turns, the last one, [blank, duplicate, truncated, illegal], cost, edits, hash, whether it has begun, the last initial
                now, state = (conv,), [None, None, 0, None, [0, 0, 0, 0], 0, bytearray(), hashlib.sha256(), False, None]
            if not there:
                continue
            if turn is not None:
                if state[0] is None:
                    state[0] = turn
                state[2] += turn != state[3]
                state[1] = state[3] = turn
            counts, initial = state[4], code & 3
            fault = 0 if code & 16 else 1 if code & 4 else 2 if code & 8 else -1
            if fault >= 0:
                counts[fault] += 1
            if state[9] is not None and (state[9], initial) not in ((0, 1), (1, 2), (2, 1)):
                counts[3] += 1
            state[9] = initial
            if cost is not None:
                state[5] = cost
            state[6] += ("I" * len(before) + edit[0] + "I" * len(after)).encode()
            said = [f"{roles[c]}:" for c in before]
            if edit != "D":
                said.append(f"{role if edit == 'K' else roles[edit[1]]}:{text}")
            for line in [*said, *(f"{roles[c]}:" for c in after)]:
                state[7].update((("\n" if state[8] else "") + line).encode())
                state[8] = True
    if now is not None:
        end()
    if kind is not None:
        yield out(kind)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv_id, turn, role, text, there).

    Rows of a conversation go by turn, nulls first, then by role and text. A row's first fault counts: blank if its text has no
    character but spaces, duplicate if an earlier row has its role and text, truncated if its last character that isn't a space
    is none of . ! ?; a role without a letter has no place in a repaired conversation. Rows that are not there (false) only
    name their conversation: one that has no others has zeros, no edits and the hash of nothing. Conversations with a null id are one.
    An empty table gives no rows; other columns are left out.

    Long conversations: rows are placed by range, edits found in blocks, so no task but the last holds more than a block. The last
    goes through each conversation in order, sorted by Spark (which spills), since its hash is one of all its text; it keeps the
    initials of the edits, which are the result, and nothing else.
    """
    turns = numbered(rows)
    blocks = stored(_blocks(turns), "blocks")
    ends = _after_blocks(blocks)
    posed = _same(blocks, ends, blocks["block"] == ends["other_block"], how="left").drop("other_block")
    posed = posed.withColumn("ends", F.coalesce("ends", F.array(*(F.lit(x).cast("long") for x in _ENDS))))
    kind = rows.schema["conv_id"].dataType.simpleString()
    posed = posed.select("conv_id", "block", "of", "numbers", "codes", "ends")
    schema = f"conv_id {kind}, block int, of long, entry int, exit int, cost long, numbers array<long>, codes array<int>, before array<string>, edit array<string>, after string"
    paths = stored(posed.mapInArrow(_paths, schema), "paths")
    taken = _entered(paths)
    zipped = F.posexplode(F.arrays_zip("numbers", "codes", "before", "edit")).alias("_at", "_e")
    each = taken.select("block", "cost", "after", F.size("numbers").alias("_n"), zipped)
    start, end = (F.col("block") == 0) & (F.col("_at") == 0), F.col("_at") == F.col("_n") - 1
    parts = [F.col(f"_e.{c}").alias(n) for c, n in (("numbers", "number"), ("codes", "code"), ("before", "before"), ("edit", "edit"))]
    edits = each.select(*parts, F.when(start, F.col("cost")).alias("cost"), F.when(end, F.col("after")).otherwise("").alias("after"))
    whole = turns.join(edits, "number", "left").withColumn("text", F.when(F.col("edit") != "D", F.col("text")))
    columns = ["conv_id", "there", "turn", "role", "text", "code", "cost", "before", "edit", "after"]
    ordered = whole.select(*columns, "number").repartition("conv_id").sortWithinPartitions("conv_id", "number").select(*columns)
    return ordered.mapInArrow(_summed, f"conv_id {kind}, {_RESULT}")
