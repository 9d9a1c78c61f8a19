"""Repair of broken conversation structure at the least cost, by A* over an edit lattice.

A conversation should be nothing, or turns of user and assistant in alternation, after one of the system
at most. Each turn is kept, given another role or deleted, and empty turns can be inserted; turns that are
blank or repeat an earlier one must go, and turns that break off cost something unless they go. A state of
the lattice is the number of turns that are dealt with and the kind of the last turn of the outcome.
States are taken by (cost so far plus heuristic, audit), where the audit is the edits' initials so far and
the heuristic what the turns that are left cost at least: a deletion for each that must go, and the least
charge of each that breaks off, as sums over suffixes. It never overstates, and never falls by more than a
step costs, so a state is final when it is first taken, and with the least audit of the cheapest ones.

Scale: a conversation may hold a third of all turns, so none is gathered. Turns without their texts (a
digest stands for one) are dealt out by ranges of their order. Where a conversation lies in one range, it is
solved there; long ones in blocks of ``BLOCK`` turns. What a block costs from each kind of last turn to each
other is a matrix of 4 by 4, with the order of the audits beside it; matrices of consecutive blocks
multiply (sums for products, least values for sums), so a range tells of a conversation that it shares
with others one matrix. Their products, over as many rows as ranges at most, give the states at the borders
of ranges, and each range then solves its own part between them. Insertions stand before a turn or at the end
of all, so that no audit of a block is the beginning of another and the order of audits is decided block by block.
Later copies of a turn are told by joining the first place of each (role, digest), with the place as a part
of the key, and equal turns at one place are a row with a count: neither is a hot key.

Defined results: a null role or text is one space; turns are ordered by turn (nulls first), role and the
text's SHA-256; equal rows are repeats of each other; a null id is a conversation like others; roles go by their
first character, so roles of other initials are never kept; an empty table gives empty results.
Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.session import with_checkpoints

from .lean import lean, small_batches
from .storage import stored

#: What edits cost.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Kinds of last turn: none yet, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: Turns of a block.
BLOCK = 256
#: More than any cost.
NEVER = 1 << 60
#: Rows of edits that are given on at a time.
_ROWS = 20_000

_SPACES = " \t\n\x0b\x0c\r"
#: What a turn of user or assistant, inserted or with a new role, makes of the last kind.
_NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Kept turns: (last kind, initial) to kind.
_KEPT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Insertions that end a conversation well, by its last kind.
_END = {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}


class Turn(NamedTuple):
    """A turn as the search sees it: ``n`` equal ones, of which all but the first must go."""

    initial: str
    must_go: bool
    truncated: bool
    n: int


def least_costs(turns: list[Turn]) -> list[int]:
    """Of each suffix, the deletions that must be and the charges that can't be avoided."""
    out = [0]
    for t in reversed(turns):
        first = DELETE if t.must_go else min(TRUNCATED, DELETE) if t.truncated else 0
        out.append(out[-1] + first + DELETE * (t.n - 1))
    return out[::-1]


def search(turns: list[Turn], start: int, end: int | None = None, finish: bool = False) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) of each last kind, from ``start``; equal turns' deletions are left out of the audit.

    The search ends with ``end``, if it is given. With ``finish`` insertions may follow the last turn, and it ends
    with the first good outcome.
    """
    left = least_costs(turns)
    heap, final, out = [(left[0], "", 0, start, 0)], set(), {}
    while heap:
        _, audit, at, kind, cost = heapq.heappop(heap)
        if (at, kind) in final:
            continue
        final.add((at, kind))
        steps = [(at, _NEXT[kind], INSERT, "I")]
        if at == len(turns):
            if not finish or kind in (NONE, ASSISTANT):
                out[kind] = (cost, audit)
            if finish and out or kind == end:
                break
            if not finish:
                continue
        else:
            turn = turns[at]
            charge = DELETE * (turn.n - 1)
            steps.append((at + 1, kind, DELETE + charge, "D"))
            if not turn.must_go:
                charge += TRUNCATED * turn.truncated
                steps.append((at + 1, _NEXT[kind], REROLE + charge, "R"))
                if (kind, turn.initial) in _KEPT:
                    steps.append((at + 1, _KEPT[kind, turn.initial], KEEP + charge, "K"))
        for to, new, more, edit in steps:
            if (to, new) not in final:
                heapq.heappush(heap, (cost + more + left[to], audit + edit, to, new, cost + more))
    return out


class Costs:
    """What turns cost from each kind to each other, and the order of the audits from one kind."""

    def __init__(self, cost: list[list[int]], rank: list[list[int]]):
        self.cost, self.rank = cost, rank

    @classmethod
    def of(cls, turns: list[Turn]) -> Costs:
        cost, rank = [], []
        for start in range(4):
            found = search(turns, start)
            order = sorted(found, key=lambda k: found[k][1])
            cost.append([found[k][0] if k in found else NEVER for k in range(4)])
            rank.append([order.index(k) if k in found else 4 for k in range(4)])
        return cls(cost, rank)

    def then(self, other: Costs) -> Costs:
        cost, rank = [], []
        for a in range(4):
            best = [min((self.cost[a][m] + other.cost[m][b], self.rank[a][m], other.rank[m][b]) for m in range(4)) for b in range(4)]
            order = sorted(b for b in range(4) if best[b][0] < NEVER)
            order.sort(key=lambda b: best[b][1:])
            cost.append([x[0] if x[0] < NEVER else NEVER for x in best])
            rank.append([order.index(b) if b in order else 4 for b in range(4)])
        return Costs(cost, rank)


#: Costs from each kind to a good end.
_TO_END = [INSERT * _END[k] for k in range(4)]


def borders(parts: list[Costs], start: int, to_end: list[int]) -> list[int]:
    """The kinds before, between and after ``parts``, on the cheapest way from ``start`` with the least audit."""
    left = [to_end]
    for p in reversed(parts):
        left.append([min(p.cost[a][b] + left[-1][b] for b in range(4)) for a in range(4)])
    left, out = left[::-1], [start]
    for k, p in enumerate(parts):
        a = out[-1]
        out.append(min(range(4), key=lambda b: (p.cost[a][b] + left[k + 1][b], p.rank[a][b])))
    return out


def solve(blocks: Callable[[], Iterator[list[Turn]]], start: int = NONE, end: int | None = None) -> Iterator[str]:
    """The audit of each block, on the cheapest way from ``start`` to ``end``, or to a good end if it is None."""
    several = blocks()
    one, more = next(several), next(several, None)
    if more is None:
        (_, audit), *_ = (search(one, start, finish=True) if end is None else {end: search(one, start, end)[end]}).values()
        yield audit
        return
    del one, more, several
    kinds = borders([Costs.of(b) for b in blocks()], start, _TO_END if end is None else [0 if k == end else NEVER for k in range(4)])
    for k, turns in enumerate(blocks()):
        last = end is None and k == len(kinds) - 2
        yield search(turns, kinds[k], kinds[k + 1])[kinds[k + 1]][1] + "I" * (_END[kinds[k + 1]] if last else 0)


class _Part:
    """The turns of a conversation in one range, as slices of batches."""

    def __init__(self, conv_id):
        self.conv_id, self.slices = conv_id, []

    def blocks(self) -> Iterator[tuple[pa.RecordBatch, list[Turn]]]:
        for whole in self.slices:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                columns = (batch.column(c).to_pylist() for c in ("initial", "must_go", "truncated", "n"))
                yield batch, [Turn(*x) for x in zip(*columns)]

    def turns(self) -> Iterator[list[Turn]]:
        return (turns for _, turns in self.blocks())


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[_Part]:
    """The conversations of a sorted range, one after the other."""
    part = None
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        at = 0
        while at < len(ids):
            to = at + 1
            while to < len(ids) and ids[to] == ids[at]:
                to += 1
            if part is None or part.conv_id != ids[at]:
                if part is not None:
                    yield part
                part = _Part(ids[at])
            part.slices.append(batch.slice(at, to - at))
            at = to
    if part is not None:
        yield part


_TOLD = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first_initial", "last_initial")
_LEGAL = ("su", "ua", "au")


def _told(part: _Part) -> dict:
    """What ``summaries`` needs of a part."""
    out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0) | {"low": None, "high": None, "first_initial": None}
    last = None
    for batch in part.slices:
        for turn, initial, blank, must_go, truncated, n in zip(*(batch.column(c).to_pylist() for c in ("turn", "initial", "blank", "must_go", "truncated", "n"))):
            out["blank"] += n * blank
            out["duplicate"] += 0 if blank else n if must_go else n - 1
            out["truncated"] += truncated and not must_go
            out["illegal"] += n - 1 + (last is not None and last + initial not in _LEGAL)
            if turn is not None and turn != out["high"]:
                out["turns"] += 1
                out["low"], out["high"] = turn if out["low"] is None else out["low"], turn
            last = initial
            if out["first_initial"] is None:
                out["first_initial"] = initial
    return out | {"last_initial": last}


def _matrix(part: _Part) -> Costs:
    total = None
    for turns in part.turns():
        own = Costs.of(turns)
        total = own if total is None else total.then(own)
    return total


_KEYS = ("conv_id", "turn", "role", "digest")


def _same(keys: Sequence[str], prefix: str) -> Column:
    """Whether keys equal those with the prefix, nulls too."""
    return reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys))


def ordered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Different turns in ranges of their order, with their faults and without texts; and the turns with their texts."""
    with_checkpoints(turns.sparkSession)
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    texts = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), told(role).alias("role"), told(text).alias("text"))
    texts = texts.withColumn("digest", F.unhex(F.sha2("text", 256)))
    last = F.right(F.rtrim("text", F.lit(_SPACES)), F.lit(1))
    rows = texts.select("conv_id", "turn", "role", "digest", (last == "").alias("blank"), last.isin(".", "!", "?").alias("ended"))
    rows = rows.groupBy(*_KEYS).agg(F.first("blank").alias("blank"), F.first("ended").alias("ended"), F.count(F.lit(1)).alias("n"))
    # nulls in a struct come first, so that the least one is that of the first turn
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn"))["turn"].alias("turn")).withColumnsRenamed({c: f"f_{c}" for c in _KEYS})
    rows = rows.join(first, _same(_KEYS, "f_"), "left")
    must_go = F.col("blank") | F.col("f_digest").isNull()
    rows = rows.select(*_KEYS, "blank", "n", F.substring("role", 1, 1).alias("initial"), must_go.alias("must_go"), (~F.col("ended") & ~must_go).alias("truncated"))
    order = [F.col(c).asc_nulls_first() for c in _KEYS]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    return rows.withColumn("range", F.spark_partition_id()), texts


def _kind(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def told(rows: DataFrame) -> DataFrame:
    """A row for each conversation and range of ``ordered`` rows, with counts, and with ``cost`` and ``rank`` (4 by 4) where
    the conversation may go on in another range."""
    small_batches(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(part: _Part, edge: bool) -> dict:
            costs = _matrix(part) if edge else None
            sides = {k: costs and [x for row in getattr(costs, k) for x in row] for k in ("cost", "rank")}
            return {"conv_id": part.conv_id, "range": part.slices[0].column("range")[0].as_py(), **_told(part), **sides}

        out, before, kind = [], None, None
        for number, part in enumerate(_parts(batches)):
            kind = part.slices[0].schema.field("conv_id").type
            if before is not None:
                out.append(row(before, number == 1))
            if len(out) >= _ROWS:
                yield _batch(out, kind)
                out = []
            before = part
        if before is not None:
            yield _batch([*out, row(before, True)], kind)

    schema = f"conv_id {_kind(rows)}, range int, " + ", ".join(f"{c} {'string' if 'initial' in c else 'long'}" for c in _TOLD) + ", cost array<long>, rank array<long>"
    return rows.mapInArrow(lean(work), schema)


def _batch(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    kinds = {"conv_id": kind, "range": pa.int32()} | {c: pa.string() if "initial" in c else pa.int64() for c in _TOLD} | dict.fromkeys(("cost", "rank"), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds.items()], list(kinds))


def summaries(parts: DataFrame) -> DataFrame:
    """Each conversation's ``gaps``, ``blank``, ``duplicate``, ``truncated`` and ``illegal``, from ``told``.

    ``gaps`` is null if it doesn't fit 64 bits.
    """
    by = Window.partitionBy("conv_id").orderBy("range")
    met = F.lag("last_initial").over(by).isNotNull() & ~F.concat(F.lag("last_initial").over(by), "first_initial").isin(*_LEGAL)
    rows = parts.withColumn("met", met.cast("long")).withColumn("again", F.coalesce(F.lag("high").over(by) == F.col("low"), F.lit(False)).cast("long"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    sums = rows.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], (F.sum("illegal") + F.sum("met")).alias("illegal"), F.min("low").alias("low"), F.max("high").alias("high"), (F.sum("turns") - F.sum("again")).alias("turns"))
    gaps = F.coalesce(wide("high") - wide("low"), F.lit(-1).cast("decimal(38,0)")) + 1 - wide("turns")
    return sums.select("conv_id", gaps.try_cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal")


def joints(parts: DataFrame) -> DataFrame:
    """The last kinds before (``start``) and after (``end``, null at the end) each range's part of the conversations
    that ``told`` has matrices of."""

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("range")
        costs = [Costs(*([x[k : k + 4] for k in range(0, 16, 4)] for x in both)) for both in zip(group["cost"].to_pylist(), group["rank"].to_pylist())]
        kinds = borders(costs, NONE, _TO_END)
        ends = [*kinds[1:-1], None]
        return pa.table([group["conv_id"], group["range"], pa.array(kinds[:-1], pa.int32()), pa.array(ends, pa.int32())], ["conv_id", "range", "start", "end"])

    return parts.where("cost IS NOT NULL").select("conv_id", "range", "cost", "rank").groupBy("conv_id").applyInArrow(work, f"conv_id {_kind(parts)}, range int, start int, end int")


def edits(rows: DataFrame, joints: DataFrame) -> DataFrame:
    """The cheapest edits of ``ordered`` rows, in the order of ``range`` and ``place``: ``edit`` (K, R, D or I), how many
    ``times``, what they ``cost`` together, the turn's new ``role``, and ``turn``, ``was`` and ``digest`` of the turn that
    it is, or that an insertion stands beside."""
    small_batches(rows.sparkSession)
    # at most two rows for each range
    beside = F.broadcast(joints.select(F.col("conv_id").alias("_id"), F.col("range").alias("_range"), "start", "end"))
    rows = rows.join(beside, F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("range") == F.col("_range")), "left").drop("_id", "_range")
    price = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for part in _parts(batches):
            start, end = (part.slices[0].column(c)[0].as_py() for c in ("start", "end"))
            kind = NONE if start is None else start
            for (batch, turns), audit in zip(part.blocks(), solve(part.turns, kind, end)):
                roles, out, at = batch.column("role").to_pylist(), [], 0
                for edit in audit:
                    turn = turns[min(at, len(turns) - 1)]
                    if edit == "K":
                        kind = _KEPT[kind, turn.initial]
                    elif edit != "D":
                        kind = _NEXT[kind]
                    role = roles[at] if edit == "K" else _NAMES[kind] if edit != "D" else None
                    out.append((min(at, len(turns) - 1), edit, 1, price[edit] + TRUNCATED * (edit in "KR" and turn.truncated), role))
                    if edit != "I":
                        if turn.n > 1:
                            out.append((at, "D", turn.n - 1, DELETE * (turn.n - 1), None))
                        at += 1
                own, what, times, cost, role = zip(*out)
                own = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv_id").take(own), batch.column("range").take(own), pa.array(range(place, place + len(what)), pa.int64()), pa.array(what), pa.array(times, pa.int64()), pa.array(cost, pa.int64()), pa.array(role, pa.string())]
                    + [batch.column(c).take(own) for c in ("turn", "role", "digest")],
                    ["conv_id", "range", "place", "edit", "times", "cost", "role", "turn", "was", "digest"],
                )
                place += len(what)

    return rows.mapInArrow(lean(work), f"conv_id {_kind(rows)}, range int, place long, edit string, times long, cost long, role string, turn long, was string, digest binary")


def repaired(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The ``edits`` with the texts that stay (empty for an insertion, null for a deletion), and the ``summaries``."""
    rows, texts = ordered(turns, conv_id, turn, role, text)
    parts = stored(told(rows), "parts")
    made = edits(rows, joints(parts))
    texts = texts.groupBy(*_KEYS).agg(F.first("text").alias("text")).withColumnsRenamed({k: f"t_{k}" for k in _KEYS})
    beside = made.withColumnsRenamed({"role": "new", "was": "role"})
    kept = F.when(F.col("edit").isin("K", "R"), F.col("text")).when(F.col("edit") == "I", F.lit(""))
    turns = beside.join(texts, _same(_KEYS, "t_")).select("conv_id", "range", "place", "edit", "times", "cost", F.col("new").alias("role"), kept.alias("text"))
    return turns, summaries(parts)


def digests(repaired: DataFrame) -> DataFrame:
    """Each conversation's ``cost``, ``audit`` and ``repaired_sha256`` of its lines ``role:text``.

    Lines are hashed one by one as they come in order, never together, but those of one conversation in one task, as
    SHA-256 goes from its beginning to its end.
    """
    small_batches(repaired.sparkSession)
    rows = repaired.select("conv_id", "range", "place", "edit", "times", "cost", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "range", "place")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now, kind, out = False, None, None, []

        def told() -> pa.RecordBatch:
            ids, costs, audits, shas = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(costs, pa.int64()), pa.array(audits), pa.array(shas)], ["conv_id", "cost", "audit", "repaired_sha256"])

        cost, audit, sha, lines = 0, [], hashlib.sha256(), 0
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, edit, times, price, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "times", "cost", "role", "text"))):
                if not known or conv != now:
                    if known:
                        out.append((now, cost, "".join(audit), sha.hexdigest()))
                    known, now, cost, audit, sha, lines = True, conv, 0, [], hashlib.sha256(), 0
                    if len(out) >= _ROWS:
                        yield told()
                        out = []
                cost += price
                audit.append(edit * times)
                if edit != "D":
                    sha.update((f"\n{role}:{text}" if lines else f"{role}:{text}").encode())
                    lines += 1
        if known:
            out.append((now, cost, "".join(audit), sha.hexdigest()))
            yield told()

    return rows.mapInArrow(lean(work), f"conv_id {_kind(repaired)}, cost long, audit string, repaired_sha256 string")
