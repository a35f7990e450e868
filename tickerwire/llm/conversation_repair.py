"""Cheapest repair of a conversation's turns, by an auction for shortest paths.

A conversation of n turns is a lattice of (turns read, role state) nodes. The
states follow ``(s?(ua)+)?`` over role initials: nothing yet, after system,
after user, after assistant. Arcs keep, re-role or delete the next turn, or
insert one, at integer costs. Every node has a price that never exceeds an
arc's cost plus the price at its end. A path grows from a node: where the
price at its tip is below the best arc out of it, the price rises to that and
the path is contracted by one node, else it is extended along that arc, until
it meets a node whose way to the end is known. Prices are kept from one origin
to the next, and origins are taken from the last turn to the first, each layer
starting from the least price of the next one, so a node's price rises a few
times only and the work is linear in the turns.

Prices are then the exact costs to the end. Arcs whose cost equals the fall in
price are tight; the repair is read from the start along the tight arc of the
least letter. No two arcs out of a node share a letter, so this gives the
least of all cheapest edit strings.

Turns are damaged data: blank, repeated, cut off or out of turn. Repeats are
found by a window over (conversation, role, text hash). The lattice needs two
letters a turn, so turns travel without their texts first; the texts meet the
edits in a second sort and are streamed, never gathered. One conversation is
read by one task: its edits and its digest are one row's values.

Defined results: a null role or text is one blank; null turns come first; turns
of equal number are ordered by role and text hash; a null conversation
identifier is a conversation of its own; a conversation all of whose turns are
``gone`` has zeros and no edits; an empty table gives no rows; columns other
than those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerwire.llm.common import cut, ship

WHITE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: State that a kept turn's role initial leads to.
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: State that a re-roled or inserted turn leads to, and its role.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
FAULTS = "blank", "duplicate", "truncated"
STATS = ("gaps", *FAULTS, "illegal", "cost")
SOLVED = "conv_id long, " + ", ".join(f"{s} long" for s in STATS) + ", audit string"
TURNS = "conv_id long, position long, edit string, role string, text string"
DIGESTS = SOLVED + ", repaired_sha256 string"


def arcs(fault: str, initial: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state) of the arcs that read a turn, in letter order."""
    out = [("D", DELETE, state)]
    if fault not in ("b", "d"):
        more = TRUNCATED if fault == "t" else 0
        if (state, initial) in STEP:
            out.append(("K", more, STEP[state, initial]))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


_ARCS: dict[tuple[str, str], list[list[tuple[str, int, int]]]] = {}


def _out(code: tuple[str, str]) -> list[list[tuple[str, int, int]]]:
    if code not in _ARCS:
        _ARCS[code] = [arcs(*code, s) for s in range(4)]
    return _ARCS[code]


def prices(codes: list[tuple[str, str]]) -> list[list[int]]:
    """Converged prices [turns read][state] of a conversation's lattice."""
    n = len(codes)
    price: list[list[int]] = [[0] * 4 for _ in range(n + 1)]
    ends = [0, None, None, 0]   # cost from (n, state) to the end, where there is one
    for layer in range(n, -1, -1):
        here = price[layer]
        if layer < n:
            after, out = price[layer + 1], _out(codes[layer])
            here[:] = [min(after)] * 4
        settled = [False] * 4
        for origin in range(4):
            path = [] if settled[origin] else [origin]
            while path:
                tip = path[-1]
                # the best arc out of the tip: to the next layer (or the end), or an insertion in this one
                to, best = NEXT[tip], INSERT + here[NEXT[tip]]
                if layer < n:
                    least = min([c + after[s] for _, c, s in out[tip]])
                else:
                    least = ends[tip]
                if least is not None and least <= best:
                    to, best = None, least
                if here[tip] < best:
                    here[tip] = best        # the price rises and the path is contracted
                    if len(path) > 1:
                        path.pop()
                elif to is None or settled[to]:
                    for s in path:          # the rest of the way is known
                        settled[s] = True
                    break
                else:
                    path.append(to)
    return price


def repair_string(codes: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, edits) of the cheapest repair; of equal ones the least string."""
    price = prices(codes)
    layer, state, edits = 0, START, []
    while layer < len(codes) or state not in (START, ASSISTANT):
        here = price[layer][state]
        options = [("I", INSERT, layer, NEXT[state])]
        if layer < len(codes):
            options += [(letter, c, layer + 1, s) for letter, c, s in _out(codes[layer])[state]]
        letter, _, layer, state = min(o for o in options if here == o[1] + price[o[2]][o[3]])
        edits.append(letter)
    return price[0][START], "".join(edits)


def apply_edits(edits: str) -> Iterator[tuple[str, bool, str | None]]:
    """(letter, whether it reads a turn, the role it sets) of each edit; after
    a kept turn it is sent that turn's role initial."""
    state = START
    for letter in edits:
        if letter in "RI":
            state = NEXT[state]
            yield letter, letter == "R", ROLE[state]
        elif letter == "D":
            yield letter, True, None
        else:
            initial = yield letter, True, None
            state = STEP[state, initial]


def _grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list]:
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            yield from zip(*(c.to_pylist() for c in batch.slice(k, size).columns))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, turn, fault, initial) -> ``SOLVED``; a row whose fault
    is null only names its conversation."""
    def finished(conv: int | None, codes: list, first: int | None, last: int | None, distinct: int) -> tuple:
        cost, audit = repair_string(codes)
        count = [sum(f == k for f, _ in codes) for k in "bdt"]
        illegal = sum(a + b not in ("su", "ua", "au") for (_, a), (_, b) in zip(codes, codes[1:]))
        return conv, 0 if first is None else last - first + 1 - distinct, *count, illegal, cost, audit

    def rows() -> Iterator[tuple]:
        conv, codes, first, last, distinct, some = None, [], None, None, 0, False
        for c, turn, fault, initial in _grouped(batches, 4096):
            if some and c != conv:
                yield finished(conv, codes, first, last, distinct)
                codes, first, last, distinct = [], None, None, 0
            conv, some = c, True
            if fault is not None:
                codes.append((fault, initial))
                if turn is not None:
                    distinct += last is None or turn != last
                    first, last = turn if first is None else first, turn
        if some:
            yield finished(conv, codes, first, last, distinct)

    yield from _rows_out(rows(), SOLVED)


def _rows_out(rows: Iterator[tuple], schema: str, size: int = 1024) -> Iterator[pa.RecordBatch]:
    names, types = zip(*(x.split(" ") for x in schema.split(", ")))
    kinds = [{"long": pa.int64(), "string": pa.string()}[t] for t in types]

    def made(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=list(names))
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield made(held)
            held = []
    if held:
        yield made(held)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted solved rows, each followed by its conversation's turns ->
    (solved values, None) where a conversation starts, then (edit, role, text)
    of each repaired turn in order."""
    def inserted(edits: Iterator, sent: str | None = None) -> Iterator[tuple]:
        """Edits up to the next one that reads a turn, which is kept in ``now``."""
        nonlocal now
        now = None
        while True:
            try:
                now = edits.send(sent)
            except StopIteration:
                return
            sent = None
            if now[1]:
                return
            yield now[0], now[2], ""

    now, edits = None, None
    for *solved, role, text in _grouped(batches, 256):
        if role is None:
            yield solved, None
            edits = apply_edits(solved[-1])
            yield from inserted(edits)
        else:
            letter, _, given = now
            if letter != "D":
                yield letter, given or role, text
            yield from inserted(edits, role[:1] if letter == "K" else None)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        solved = None
        for item in _repaired(batches):
            if item[1] is None:
                if solved is not None:
                    yield *solved, sha.hexdigest()
                solved, sha, sep = item[0], hashlib.sha256(), ""
            else:
                sha.update(f"{sep}{item[1]}:{item[2]}".encode())
                sep = "\n"
        if solved is not None:
            yield *solved, sha.hexdigest()
    yield from _rows_out(rows(), DIGESTS)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for item in _repaired(batches):
            if item[1] is None:
                conv, position = item[0][0], 0
            else:
                yield conv, position, *item
                position += 1
    yield from _rows_out(rows(), TURNS, 256)


def _faulty(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, gone: Column | None) -> DataFrame:
    """(conv_id, turn, role, text, sig, gone, fault, initial); the fault is
    what a turn's own text shows, repeats not yet told."""
    whole = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
                        F.coalesce(gone, F.lit(False)).alias("gone") if gone is not None else F.lit(False).alias("gone"))
    ends = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    return (whole.withColumn("sig", F.unhex(F.md5("text"))).withColumn("initial", F.left("role", F.lit(1)))
            .withColumn("fault", F.when(ends == "", "b").when(~ends.isin(".", "!", "?"), "t").otherwise("n")))


def solve(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
          gone: Column | None = None) -> DataFrame:
    """``SOLVED``: faults, cost and edits of every conversation. Rows where
    ``gone`` holds only name their conversation."""
    ship(rows.sparkSession)
    narrow = _faulty(rows, conv_id, turn, role, text, gone).drop("text")
    same = Window.partitionBy("conv_id", "role", "sig", "gone").orderBy(F.col("turn").asc_nulls_first())
    told = narrow.withColumn("fault", F.when(F.col("gone"), F.lit(None)).when(
        (F.col("fault") != "b") & (F.row_number().over(same) > 1), "d").otherwise(F.col("fault")))
    # a row and its repeats are side by side only where nothing lies between: the first is not a repeat
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "sig", F.col("fault").desc()]
    return (told.repartition("conv_id").sortWithinPartitions(*order)
            .select("conv_id", "turn", "fault", "initial").mapInArrow(_solve, SOLVED))


def _applied(rows: DataFrame, run: Callable, schema: str, **named) -> DataFrame:
    solved = cut(solve(rows, **named), "solved-conversations")
    names = {"conv_id": "conv_id", "turn": "turn", "role": "role", "text": "text", "gone": None} | named
    turns = _faulty(rows, **names).where("NOT gone")
    extra = [c for c in solved.columns if c != "conv_id"]
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    told = solved.select("*", none("turn", "long"), none("role", "string"), none("sig", "binary"), none("text", "string"))
    both = told.unionByName(turns.select("conv_id", *[none(c, "string" if c == "audit" else "long") for c in extra], "turn", "role", "sig", "text"))
    laid = both.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("role").isNotNull(), F.col("turn").asc_nulls_first(), "role", "sig")
    return laid.select("conv_id", *extra, "role", "text").mapInArrow(run, schema)


def repair(rows: DataFrame, **named) -> DataFrame:
    """``TURNS``: the repaired conversations' turns with their edits."""
    return _applied(rows, _turns, TURNS, **named)


def repair_digests(rows: DataFrame, **named) -> DataFrame:
    """``DIGESTS``: ``solve`` with the sha256 of each repaired conversation,
    its turns ``role:text`` joined by line ends."""
    return _applied(rows, _digest, DIGESTS, **named)
