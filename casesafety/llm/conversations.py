"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation's rows are taken by turn (nulls first; rows of one turn by role, then text). A row's first fault counts: blank (nothing but
ASCII white space), duplicate (role and text stood earlier) or truncated (its last character that isn't white space is none of ``.!?``).
The cheapest edits then give role initials ``(s?(ua)+)?``: Keep costs 0, Rerole (to user or assistant) 1, Delete 2, which blank and
duplicate rows need, and Insert (an empty user or assistant row) 5; a truncated row that isn't deleted costs 5 more. Of equally
cheap edits those count whose initials, the audit, are the least string.

Four states say what stands in front: nothing, a first ``s``, a ``u``, an ``a``. A step goes over one row, with what is inserted
before it; inserts after the last row come last. So no audit of the same rows is the beginning of another, and of two audits to
different states the lesser one stays the lesser, whatever follows: a forward vector of four costs carries the four audits' order
as ranks instead of the strings. Forward and backward vectors meet at the middle row, the cheapest crossing of the least rank
is taken, and either half is solved on its own: time n log n, four numbers besides the rows' codes.

Conversations of at most ``LONG_ROWS`` rows and ``LONG_CHARS`` characters are solved each in one step. Longer ones are range-sorted
over the cluster and cut into pieces of that size; a piece is known by its costs and ranks from each state to each other, so the
pieces of a conversation meet as small rows (a top level of the same divide and conquer), and are solved apart from each other. Only the
digest of a long conversation is read in order by one task, piece by piece, since SHA-256 can't be computed otherwise. Both ways give the same rows.

A null role or text counts as one space; null ids are one conversation; a null turn stands first and is no turn for the gaps. Roles go by their first
character. Rows that repeat are rows each. Texts are read whole, however long. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Rows and characters that a conversation, or a piece of one, is solved with at once; long conversations whose ids are broadcast, at most.
LONG_ROWS, LONG_CHARS, BROADCAST_LONG = 4096, 1 << 22, 100_000
#: White space, and costs. Fixed values.
SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FINE, CUT, GONE = 0, 1, 2  # what a row's fault asks for
INITIALS = "sua"
NEVER = 1 << 40
#: The state after the next row of the pattern other than a first s; the state of a kept row by its initial and the state before.
NEXT = (2, 2, 3, 2)
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
#: What has to be inserted after the last row, by state.
LAST = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _steps(initial: str, fault: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) -> the cheapest, then least, edits over one row and what is inserted before it."""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for before in range(4):
        at = before
        for inserted in range(3):
            edits = [(at, DELETE, "D")]
            if fault != GONE:
                extra = TRUNCATED if fault == CUT else 0
                edits.append((NEXT[at], REROLE + extra, "R"))
                if (initial, at) in KEPT:
                    edits.append((KEPT[initial, at], extra, "K"))
            for after, cost, letter in edits:
                new = (cost + INSERT * inserted, "I" * inserted + letter)
                found[before, after] = min(found.get((before, after), new), new)
            at = NEXT[at]
    return found


#: By code: a row's initial (one of ``INITIALS`` or another) times three, plus what its fault asks for.
STEPS = [_steps(initial, fault) for initial in (*INITIALS, "") for fault in (FINE, CUT, GONE)]


def code(role: str, fault: int) -> int:
    at = INITIALS.find(role[:1]) if role else -1
    return (at if at >= 0 else 3) * 3 + fault


@lru_cache(maxsize=1 << 16)
def _ahead(row: int, costs: tuple[int, ...], ranks: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """The vectors after one more row; costs are relative to the least, which comes first."""
    best = [min((costs[s] + c, ranks[s], edits) for (s, e), (c, edits) in STEPS[row].items() if e == t) if any(e == t and costs[s] < NEVER for s, e in STEPS[row]) else None for t in range(4)]
    best = [b if b and b[0] < NEVER else None for b in best]
    least = min(b[0] for b in best if b)
    order = {t: k for k, (_, t) in enumerate(sorted((b[1:], t) for t, b in enumerate(best) if b))}
    return least, tuple(b[0] - least if b else NEVER for b in best), tuple(order.get(t, 4) for t in range(4))


@lru_cache(maxsize=1 << 16)
def _behind(row: int, costs: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """The costs to the end from before one more row, relative to the least."""
    back = [min([costs[e] + c for (s, e), (c, _) in STEPS[row].items() if s == t], default=NEVER) for t in range(4)]
    least = min(back)
    return least, tuple(min(NEVER, b - least) if b < NEVER else NEVER for b in back)


def _only(state: int) -> tuple[int, ...]:
    return tuple(0 if t == state else NEVER for t in range(4))


def forward(codes: bytes, state: int) -> tuple[list[int], tuple[int, ...]]:
    """Costs of the cheapest edits from ``state`` to each state, and the order of their audits."""
    total, costs, ranks = 0, _only(state), (0, 0, 0, 0)
    for row in codes:
        least, costs, ranks = _ahead(row, costs, ranks)
        total += least
    return [total + c if c < NEVER else NEVER for c in costs], ranks


def backward(codes: bytes, state: int) -> list[int]:
    """Costs of the cheapest edits from each state to ``state``."""
    total, costs = 0, _only(state)
    for row in reversed(codes):
        least, costs = _behind(row, costs)
        total += least
    return [total + c if c < NEVER else NEVER for c in costs]


def audit(codes: bytes, start: int, end: int) -> str:
    """The least of the cheapest audits from state to state."""
    out, open_ = [], [(0, len(codes), start, end)]
    while open_:
        lo, hi, s, t = open_.pop()
        if hi - lo == 1:
            out.append(STEPS[codes[lo]][s, t][1])
        elif hi > lo:
            mid = (lo + hi) // 2
            (there, ranks), back = forward(codes[lo:mid], s), backward(codes[mid:hi], t)
            c = min(range(4), key=lambda c: (there[c] + back[c], ranks[c]))
            open_ += [(mid, hi, c, t), (lo, mid, s, c)]
    return "".join(out)


def best_end(costs: list[int], ranks: tuple[int, ...]) -> int:
    return min(range(4), key=lambda t: (costs[t] + LAST[t][0], ranks[t]))


def applied(roles: list[str], texts: list[str], edits: str, state: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows that the edits leave, from ``state`` on."""
    at = 0
    for letter in edits:
        if letter == "K":
            state = KEPT[roles[at][:1], state]
            yield roles[at], texts[at]
        elif letter in "RI":
            state = NEXT[state]
            yield "user" if state == 2 else "assistant", texts[at] if letter == "R" else ""
        at += letter != "I"


def faults(roles: list[str], texts: list[str], known: list[bool] | None = None) -> tuple[bytes, list[int]]:
    """The rows' codes, and the numbers of blank, duplicate and truncated rows; ``known`` tells the duplicates, if they are known."""
    seen: set[tuple[str, str]] = set()
    codes, n = bytearray(), [0, 0, 0]
    for k, (role, text) in enumerate(zip(roles, texts, strict=True)):
        bare = text.rstrip(SPACE)
        again = known[k] if known is not None else (role, text) in seen
        kind = 0 if not bare else 1 if again else 2 if bare[-1] not in ".!?" else 3
        if kind < 3:
            n[kind] += 1
        codes.append(code(role, (GONE, GONE, CUT, FINE)[kind]))
        if known is None:
            seen.add((role, text))
    return bytes(codes), n


def _illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows spoilt by ``crc32(conv_id:turn) % 20``. 0 drops a row (no copies), 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes it the user's."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(named("text"), ".!?", "")).otherwise(named("text"))
    role = F.when(fate == 4, "user").otherwise(named("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"))


_SCHEMA = "piece long, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, roles array<string>, texts array<string>"


def _arrow(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    names = ("conv_id", "piece", "last", *FACTS, "audit", "roles", "texts")
    kinds = (id_type, pa.int64(), pa.bool_(), *[pa.int64()] * len(FACTS), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def _solved_at_once(rows: DataFrame) -> DataFrame:
    """Conversations of bounded size, one row for each."""
    each = F.when(F.col("copies") > 0, F.struct("turn", "role", "text", "copies"))
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(each)).alias("rows"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, out = b.column(1), []
            at = lists.offsets.to_pylist()
            turns, roles, texts, copies = (lists.values.field(k).to_pylist() for k in range(4))
            for k, conv in enumerate(b.column(0).to_pylist()):
                every = [i for i in range(at[k], at[k + 1]) for _ in range(copies[i])]
                role, text = [roles[i] for i in every], [texts[i] for i in every]
                known = {turns[i] for i in every} - {None}
                codes, n = faults(role, text)
                costs, ranks = forward(codes, 0)
                end = best_end(costs, ranks)
                edits = audit(codes, 0, end) + LAST[end][1]
                left = list(applied(role, text, edits, 0))
                gaps = max(known) - min(known) + 1 - len(known) if known else 0
                out.append((conv, 0, True, gaps, *n, _illegal(role), costs[end] + LAST[end][0], edits, [r for r, _ in left], [t for _, t in left]))
            if out:
                yield _arrow(out, b.schema.field(0).type)

    return held.mapInArrow(solve, f"conv_id {dict(rows.dtypes)['conv_id']}, {_SCHEMA}")


def _solved_in_pieces(rows: DataFrame, n_rows: int) -> DataFrame:
    """Conversations of any size, a row for each piece; the facts of a conversation stand in its last one."""
    id_type, turn_type = dict(rows.dtypes)["conv_id"], dict(rows.dtypes)["turn"]
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    # Equal rows are one while duplicates are told, so that a group of copies is no task of its own.
    alike = rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n")).withColumn("same", same)
    first = F.row_number().over(Window.partitionBy("conv_id", "same").orderBy(F.col("turn").asc_nulls_first())) == 1
    every = alike.withColumn("first", first).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("conv_id", "turn", "role", "text", "copy", (~F.col("first") | (F.col("copy") > 1)).alias("again"))
    ranges = max(1, n_rows // LONG_ROWS + 1)
    dealt = every.withColumn("start", F.substring("text", 1, 32)).repartitionByRange(ranges, "conv_id", F.col("turn").asc_nulls_first(), "role", "start", "copy").drop("start")
    ordered = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, chars = (TaskContext.get().partitionId() << 32) + 1, [], 0

        def piece() -> pa.RecordBatch:
            nonlocal number, held, chars
            turns, roles, texts, again = (list(c) for c in list(zip(*held, strict=True))[1:])
            codes, n = faults(roles, texts, again)
            vectors = [forward(codes, s) for s in range(4)]
            known = [t for t in turns if t is not None]
            row = {"conv_id": held[0][0], "piece": number, "low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known)), "blank": n[0], "duplicate": n[1], "truncated": n[2],
                   "illegal": _illegal(roles), "first": roles[0][:1], "final": roles[-1][:1], "costs": [c for v, _ in vectors for c in v], "ranks": [r for _, v in vectors for r in v], "codes": codes, "roles": roles, "texts": texts}
            number, held, chars = number + 1, [], 0
            kinds = {"conv_id": ids, "low": pa.int64(), "high": pa.int64(), "codes": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([x], kinds.get(k)) for k, x in row.items()], names=list(row))

        ids = None
        for b in batches:
            ids = b.schema.field(0).type
            for r in zip(*[b.column(k).to_pylist() for k in (0, 1, 2, 3, 5)], strict=True):
                if held and (held[0][0] != r[0] or len(held) >= LONG_ROWS or chars + len(r[3]) > LONG_CHARS):
                    yield piece()
                held.append(r)
                chars += len(r[3])
        if held:
            yield piece()

    facts = "low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, final string, costs array<long>, ranks array<long>"
    pieces = staged(ordered.withColumn("turn", F.col("turn").cast("long")).mapInArrow(cut, f"conv_id {id_type}, piece long, {facts}, codes binary, roles array<string>, texts array<string>"), "pieces")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        """The states between a conversation's pieces, from the last to the first: the cheapest, then least, way on from each state."""
        pdf = pdf.sort_values("piece").reset_index(drop=True)
        on = [(LAST[t][0], None) for t in range(4)]
        ways = []
        for costs, ranks in zip(pdf["costs"][::-1], pdf["ranks"][::-1], strict=True):
            costs, ranks, after = np.reshape(costs, (4, 4)).tolist(), np.reshape(ranks, (4, 4)).tolist(), [c for c, _ in on]
            on = [min((costs[s][t] + after[t], ranks[s][t], t) for t in range(4)) for s in range(4)]
            ways.append([t for _, _, t in on])
            on = [(c, t) for c, _, t in on]
        state, start, end = 0, [], []
        for way in reversed(ways):
            start.append(state)
            state = way[state]
            end.append(state)
        low, high = pdf["low"].min(), pdf["high"].max()
        known = pdf[pdf["low"].notna()]
        distinct = int(pdf["turns"].sum()) - int((known["low"].to_numpy()[1:] == known["high"].to_numpy()[:-1]).sum())
        between = sum(a + b not in ("su", "ua", "au") for a, b in zip(pdf["final"], pdf["first"][1:], strict=False))
        sums = {c: int(pdf[c].sum()) for c in ("blank", "duplicate", "truncated")}
        totals = {"gaps": int(high) - int(low) + 1 - distinct if len(known) else 0, **sums, "illegal": int(pdf["illegal"].sum()) + between, "cost": int(on[0][0])}
        return pd.DataFrame({"piece": pdf["piece"], "start": start, "end": end, "last": pdf.index == len(pdf) - 1, **totals})

    small = pieces.drop("codes", "roles", "texts")
    joined = small.groupBy("conv_id").applyInPandas(meet, "piece long, start int, end int, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")
    ways = staged(joined, "ways")
    told = pieces.select("conv_id", "piece", "codes", "roles", "texts").join(ways, "piece").select("conv_id", "piece", "last", *FACTS, "start", "end", "codes", "roles", "texts")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for *facts, start, end, codes, roles, texts in zip(*[c.to_pylist() for c in b.columns], strict=True):
                edits = audit(codes, start, end) + (LAST[end][1] if facts[2] else "")
                left = list(applied(roles, texts, edits, start))
                out.append((*facts, edits, [r for r, _ in left], [t for _, t in left]))
            if out:
                yield _arrow(out, b.schema.field(0).type)

    return told.mapInArrow(solve, f"conv_id {id_type}, {_SCHEMA}")


def _long(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Ids of conversations that aren't solved at once, their number, and the number of their rows."""
    size = rows.groupBy("conv_id").agg(F.sum("copies").alias("rows"), F.sum(F.length("text") * F.col("copies")).alias("chars"))
    ids = staged(size.where((F.col("rows") > LONG_ROWS) | (F.col("chars") > LONG_CHARS)).withColumnRenamed("conv_id", "its"), "long")
    n, n_rows = ids.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    return ids.select("its"), n, n_rows


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Conversations solved at once, and the pieces of the others, if there are any."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    copies = F.col("copies").cast("int") if "copies" in rows.columns else F.lit(1)
    rows = rows.select("conv_id", "turn", text("role"), text("text"), copies.alias("copies"))
    ids, n, n_rows = _long(rows)
    if not n:
        return _solved_at_once(rows), None
    ids = F.broadcast(ids) if n <= BROADCAST_LONG else ids
    same = F.col("conv_id").eqNullSafe(F.col("its"))
    return _solved_at_once(rows.join(ids, same, "left_anti")), _solved_in_pieces(rows.join(ids, same, "left_semi"), n_rows)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, piece, last, gaps, blank, duplicate, truncated, illegal, cost, audit, roles, texts) of ``rows`` (conv_id, turn, role, text, copies).

    One row for a conversation, or for a piece of a long one, in order of ``piece``; the facts stand in each of them. Copies, 1
    where there is no such column, tells how often a row stands; a conversation of which no row stands comes through empty.
    """
    whole, pieces = _parts(rows)
    return whole if pieces is None else whole.unionByName(pieces)


def repaired_rows(solved: DataFrame) -> DataFrame:
    """(conv_id, piece, place, role, text) of the rows that ``repair`` leaves."""
    return solved.select("conv_id", "piece", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "r")).select("conv_id", "piece", "place", F.col("r.roles").alias("role"), F.col("r.texts").alias("text"))


def report(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conversation of ``rows``; the digest is of its repaired rows ``role:text``, one to a line."""
    whole, pieces = _parts(rows)
    digest = F.sha2(F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n"), 256)
    alone = whole.select("conv_id", *FACTS, "audit", digest.alias("repaired_sha256"))
    if pieces is None:
        return alone
    names = ("conv_id", *FACTS, "audit", "repaired_sha256")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A conversation's pieces come one after another; no more than one of them is held, besides the audit."""
        digest, edits, empty = hashlib.sha256(), [], True
        for b in batches:
            for conv, last, *facts, part, roles, texts in zip(*[c.to_pylist() for c in b.columns], strict=True):
                edits.append(part)
                if roles:
                    lines = "\n".join(f"{r}:{t}" for r, t in zip(roles, texts, strict=True))
                    digest.update((b"" if empty else b"\n") + lines.encode("utf-8", "surrogatepass"))
                    empty = False
                if last:
                    row = (conv, *facts, "".join(edits), digest.hexdigest())
                    kinds = (b.schema.field(0).type, *[pa.int64()] * len(FACTS), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=list(names))
                    digest, edits, empty = hashlib.sha256(), [], True

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "last", *FACTS, "audit", "roles", "texts")
    return alone.unionByName(ordered.mapInArrow(fold, ", ".join(f"{c} {dict(alone.dtypes)[c]}" for c in names)))
