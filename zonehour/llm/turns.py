"""Repair of conversations whose roles break the grammar of turns, by generalised LR parsing.

The grammar of roles is S -> empty | P | s P, P -> u a | P u a. Its LR(0) states
are built from these rules. A conversation is parsed over a graph-structured
stack: after each row there is one stack top per state, and tops share what lies
below them. A row may be kept, given another role or deleted, and turns may be
inserted before it, each at a cost; stacks that arrive at the same top merge, and
the one of the least (cost, audit) stays, audit being the initials of the edits.

Merging is exact here. Tops of the same state differ at most in whether an s lies
deep in the stack, which allows the same continuations. Of two audits of the
same cost and rows neither begins the other: the cost follows from the audit, and
an insertion costs something. So what is appended later keeps their order.

What a row means to the parser is one symbol. A conversation's symbols are
gathered in blocks; its texts stay rows, which are joined to the edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonehour.llm.common import dropped, staged

#: Rules of the role grammar: left side, right side. S is the start.
GRAMMAR = (("S", ""), ("S", "P"), ("S", "sP"), ("P", "ua"), ("P", "Pua"))
#: Roles that a row may be given, or an inserted row has, by initial.
ROLES = {"u": "user", "a": "assistant"}
#: What edits cost; TRUNCATED is added where a truncated row isn't deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Insertions before one row: u and a, after which the stack allows what it allowed before, or s.
MOST_INSERTED = 2
#: Rows whose symbols travel as one string.
BLOCK = 4096

BLANK = r"^[\x20\x09-\x0D]*$"
ENDED = r"[.!?][\x20\x09-\x0D]*$"


# --- the automaton ------------------------------------------------------------


def _automaton() -> tuple[list[dict[str, int]], list[tuple[str, int] | None], list[bool]]:
    """Moves of each state, the rule of P that it completes (left side, length), and whether S is complete there."""

    def closure(items: frozenset) -> frozenset:
        out, todo = set(items), list(items)
        while todo:
            _, right, dot = todo.pop()
            if dot < len(right):
                for left, r in GRAMMAR:
                    if left == right[dot] and (left, r, 0) not in out:
                        out.add((left, r, 0))
                        todo.append((left, r, 0))
        return frozenset(out)

    states = [closure(frozenset((left, r, 0) for left, r in GRAMMAR if left == "S"))]
    moves: list[dict[str, int]] = []
    for state in states:  # grows while it is walked
        step = {}
        for symbol in sorted({r[dot] for _, r, dot in state if dot < len(r)}):
            to = closure(frozenset((left, r, dot + 1) for left, r, dot in state if r[dot : dot + 1] == symbol))
            if to not in states:
                states.append(to)
            step[symbol] = states.index(to)
        moves.append(step)
    done = [next(((left, len(r)) for left, r, dot in sorted(s) if left == "P" and dot == len(r)), None) for s in states]
    return moves, done, [any(left == "S" and dot == len(r) for left, r, dot in s) for s in states]


MOVES, COMPLETES, ACCEPTS = _automaton()


class Stack(NamedTuple):
    """A stack top and what lies below it, shared."""

    state: int
    below: Stack | None


def shift(stack: Stack, symbol: str) -> Stack | None:
    """The stack after a symbol and the reductions that follow, or None if the grammar doesn't allow it."""
    to = MOVES[stack.state].get(symbol)
    if to is None:
        return None
    stack = Stack(to, stack)
    while rule := COMPLETES[stack.state]:
        left, n = rule
        for _ in range(n):
            stack = stack.below
        stack = Stack(MOVES[stack.state][left], stack)
    return stack


# --- repair -------------------------------------------------------------------


class Edit(NamedTuple):
    """One row's edit: the roles inserted before it, then K, R or D, and the role that the row has then."""

    inserted: str
    action: str
    role: str


class _Top(NamedTuple):
    """The best parse that ends at a stack top: rank is its audit's place among those of the other tops."""

    cost: int
    rank: int
    stack: Stack
    path: tuple | None


def _actions(symbol: str) -> list[tuple[str, str, int]]:
    """(action, role, cost) that a row's symbol allows."""
    out = [("D", "", DELETE)]
    if symbol != "x":
        more = TRUNCATED if symbol.isupper() or symbol == "!" else 0
        role = symbol.lower()
        if role in "sua":
            out.append(("K", role, more))
        out += [("R", r, more + REROLE) for r in ROLES if r != role]
    return out


def _inserted(stack: Stack) -> Iterator[tuple[str, Stack]]:
    """The stack itself, and with turns inserted: what was inserted, and the stack after it."""
    todo = [("", stack)]
    for said, s in todo:
        yield said, s
        if len(said) < MOST_INSERTED:
            todo += [(said + r, after) for r in ROLES if (after := shift(s, r))]


def parse(symbols: str) -> tuple[int, list[Edit], str]:
    """The least cost, the edit of each row, and the roles inserted at the end. See `symbol` for symbols.

    Among the cheapest edits those of the ASCII-least audit.
    """
    tops = {0: _Top(0, 0, Stack(0, None), None)}
    for symbol in symbols:
        actions = _actions(symbol)
        best: dict[int, tuple] = {}
        for top in tops.values():
            for said, stack in _inserted(top.stack):
                for action, role, cost in actions:
                    to = shift(stack, role) if role else stack
                    if to is None:
                        continue
                    key = (top.cost + INSERT * len(said) + cost, top.rank, "I" * len(said) + action)
                    if to.state not in best or key < best[to.state][0]:
                        best[to.state] = (key, to, (top.path, Edit(said, action, role)))
        # Audits of one number of rows, each ending in a row's edit: none begins another, so a rank stands for each.
        order = {k: i for i, k in enumerate(sorted({key[1:] for key, _, _ in best.values()}))}
        tops = {s: _Top(key[0], order[key[1:]], to, path) for s, (key, to, path) in best.items()}
    ends = [((top.cost + INSERT * len(said), top.rank, "I" * len(said)), said, top.path) for top in tops.values() for said, s in _inserted(top.stack) if ACCEPTS[s.state]]
    (cost, _, _), said, path = min(ends, key=lambda e: e[0])
    edits = []
    while path:
        path, edit = path
        edits.append(edit)
    return cost, edits[::-1], said


#: Conversations are short and alike in their symbols; long ones are parsed each time.
_remembered = lru_cache(1 << 16)(parse)


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, blocks of symbols): rows of (id, cost, audit) and, per block, the rows' edits as text: inserted roles, action, role."""
    for b in batches:
        out: dict[str, list] = {"conv": [], "first": [], "cost": [], "audit": [], "edits": [], "tail": []}
        for conv, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            symbols = "".join(p["symbols"] for p in parts)
            cost, edits, tail = (_remembered if len(symbols) <= 64 else parse)(symbols)
            audit = "".join("I" * len(e.inserted) + e.action for e in edits) + "I" * len(tail)
            at = 0
            for k, p in enumerate(parts):
                n = len(p["symbols"])
                out["conv"].append(conv)
                out["first"].append(p["first"])
                out["cost"].append(None if k else cost)
                out["audit"].append(None if k else audit)
                out["edits"].append([f"{e.inserted}{e.action}{e.role}" for e in edits[at : at + n]])
                out["tail"].append(tail if k == len(parts) - 1 else "")
                at += n
        yield pa.RecordBatch.from_arrays([pa.array(out["conv"], b.schema.field(0).type), pa.array(out["first"], pa.int64()), pa.array(out["cost"], pa.int64()), pa.array(out["audit"], pa.string()), pa.array(out["edits"], pa.list_(pa.string())), pa.array(out["tail"], pa.string())], list(out))


def symbol(role: Column, fault: Column) -> Column:
    """What a row means to the parser: x if it must go, else its role's initial (? if not s, u or a), as a capital (!) if truncated."""
    initial = F.substring(role, 1, 1)
    known = initial.isin("s", "u", "a")
    return F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", F.when(known, F.upper(initial)).otherwise("!")).otherwise(F.when(known, initial).otherwise("?"))


class Repaired(NamedTuple):
    """conversations: a row each of (conv, blank, duplicate, truncated, illegal, gaps, cost, audit);
    turns: the rows of the repaired ones (conv, place, role, text), places ascend within each conversation."""

    conversations: DataFrame
    turns: DataFrame


def _ordered(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """A table of all rows as (conv, turn, role, text, at): at ascends with turn (nulls first), role and text within a conversation.

    Rows are dealt by ranges of these columns, so that a conversation of many rows is many tasks' work.
    """
    x = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    keys = ["conv", F.col("turn").asc_nulls_first(), "role"]
    # Bounds of ranges hold the beginning of a text only: they meet on the driver.
    x = x.repartitionByRange(*keys, F.substring("text", 1, 64)).sortWithinPartitions(*keys, "text")
    return staged(x.withColumn("at", F.monotonically_increasing_id()), "turns")


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    """Finds faults of rows and gives each conversation the cheapest edits that make its roles fit the grammar.

    Rows of a conversation go by turn, nulls first; ties by role, then text.
    A null role or text counts as one space. A row's first fault counts: blank
    (nothing but white space), duplicate (role and text seen earlier), truncated (its last
    character that isn't white space is none of . ! ?). Blank and duplicate rows must be
    deleted. Roles go by their first character; one that isn't s, u or a can't be kept. Rows of a null
    conversation are one conversation. Texts of any length stay rows of their own;
    a conversation is gathered as one symbol a row, in blocks. An empty table gives
    empty ones; other columns are ignored, whatever their names.
    """
    turns = _ordered(rows, conv_col, turn_col, role_col, text_col)
    named = turns.withColumn("said", F.sha2(F.concat_ws(":", F.sha2(F.col("role").cast("binary"), 256), F.col("text")).cast("binary"), 256))
    same = lambda a, b: a["conv"].eqNullSafe(b["conv"])
    # Repeated rows first become a key each, in a table: what is joined to it may then be split by its size.
    firsts = staged(named.groupBy("conv", "said").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("conv", "said", "first"), "repeats")
    x = named.alias("r").join(firsts.alias("f"), (F.col("r.said") == F.col("f.said")) & F.col("r.conv").eqNullSafe(F.col("f.conv")), "left").select("r.conv", "r.turn", "r.role", "r.text", "r.at", F.coalesce(F.col("r.at") > F.col("f.first"), F.lit(False)).alias("again"))
    fault = F.when(F.col("text").rlike(BLANK), "blank").when(F.col("again"), "duplicate").when(~F.col("text").rlike(ENDED), "truncated")
    x = staged(x.select("conv", "turn", "at", F.coalesce(fault, F.lit("")).alias("fault"), F.substring("role", 1, 1).alias("initial")).withColumn("block", F.expr(f"at div {BLOCK}")).withColumn("symbol", symbol(F.col("initial"), F.col("fault"))), "faults")
    # A block's symbols in order, then the blocks of a conversation: one byte a row is all that meets.
    listed = F.array_sort(F.collect_list(F.struct("at", "symbol", "initial")))
    count = lambda what: F.count(F.when(F.col("fault") == what, 1)).alias(what)
    parts = x.groupBy("conv", "block").agg(listed.alias("l"), count("blank"), count("duplicate"), count("truncated"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.min("at").alias("first"))
    initials = F.transform("l", lambda r: r["initial"])
    pairs = F.zip_with(F.slice(initials, 1, F.size("l") - 1), F.slice(initials, 2, F.size("l")), lambda a, b: F.concat(a, b))
    illegal = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))
    parts = parts.select("conv", "block", F.array_join(F.transform("l", lambda r: r["symbol"]), "").alias("symbols"), "first", "blank", "duplicate", "truncated", "low", "high", illegal.alias("illegal"), initials[0].alias("begins"), F.element_at(initials, -1).alias("ends"))
    # Turns are counted by themselves: distinct ones of a conversation, combined before they meet.
    distinct = x.where("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(F.count("*").alias("n_turns"))
    whole = parts.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "symbols", "first", "begins", "ends"))).alias("parts"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.min("low").alias("low"), F.max("high").alias("high"))
    joints = F.zip_with(F.slice("parts", 1, F.size("parts") - 1), F.slice("parts", 2, F.size("parts")), lambda a, b: F.concat(a["ends"], b["begins"]))
    whole = whole.withColumn("illegal", F.col("illegal") + F.size(F.filter(joints, lambda p: ~p.isin("su", "ua", "au"))))
    whole = staged(whole.join(distinct.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")), "left").drop("c"), "symbols")
    dropped(firsts)
    dropped(x)
    kind = whole.schema["conv"].dataType.simpleString()
    edits = staged(whole.select("conv", "parts").mapInArrow(_repairs, f"conv {kind}, first long, cost long, audit string, edits array<string>, tail string"), "edits")

    found = edits.where("audit IS NOT NULL").select(F.col("conv").alias("c"), "cost", "audit")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0)).cast("long").alias("gaps")
    conversations = whole.join(found, F.col("conv").eqNullSafe(F.col("c"))).select(F.col("conv").alias(conv_col), gaps, *[F.col(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], "audit")

    # Rows of a conversation in a block follow one another, so an edit's place in its list is that of its row.
    e = edits.select("first", "tail", F.size("edits").alias("n"), F.posexplode("edits").alias("k", "edit"))
    e = e.select((F.col("first") + F.col("k")).alias("at"), "edit", F.when(F.col("k") == F.col("n") - 1, F.col("tail")).alias("tail"))
    t = turns.join(e, "at")
    given = F.create_map(*[F.lit(v) for pair in ROLES.items() for v in pair])
    roles = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    before = F.transform(roles(F.regexp_extract("edit", "^([ua]*)", 1)), lambda c: F.struct(given[c].alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("edit").contains("D"), F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(F.struct(F.when(F.col("edit").contains("R"), given[F.substring("edit", -1, 1)]).otherwise(F.col("role")).alias("role"), F.col("text"))))
    after = F.transform(roles(F.coalesce("tail", F.lit(""))), lambda c: F.struct(given[c].alias("role"), F.lit("").alias("text")))
    t = t.select("conv", "at", F.posexplode(F.concat(before, own, after)).alias("k", "turn"))
    repaired = t.select(F.col("conv").alias(conv_col), F.struct("at", "k").alias("place"), "turn.role", "turn.text")
    return Repaired(conversations, repaired)


def turn_digests(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, repaired_sha256): the hash of `role:text` of a conversation's turns, newline-joined.

    Turns stream past in order; a conversation is never held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, kind = None, None, None
        convs, digests = [], []
        for b in batches:
            kind = b.schema.field(0).type
            for conv, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if h is None or conv != now:
                    if h is not None:
                        convs.append(now)
                        digests.append(h.hexdigest())
                    now, h = conv, hashlib.sha256(line.encode())
                else:
                    h.update(b"\n" + line.encode())
            if convs:
                yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(digests)], ["conv", "repaired_sha256"])
                convs, digests = [], []
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([h.hexdigest()])], ["conv", "repaired_sha256"])

    x = turns.repartition(conv_col).sortWithinPartitions(conv_col, "place").select(F.col(conv_col).alias("conv"), F.concat("role", F.lit(":"), "text").alias("line"))
    x = x.mapInArrow(run, f"conv {x.schema['conv'].dataType.simpleString()}, repaired_sha256 string")
    return x.withColumnRenamed("conv", conv_col)


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults put in, by crc32 of `conv:turn` mod 20: 0 drops a row, 1 empties its text, 2 takes . ! ? out, 3 repeats it, 4 makes it the user's. Nulls are one space there, and in role and text."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(word(conv_col), F.lit(":"), word(turn_col)).cast("binary")) % 20
    x = rows.select(F.col(conv_col), F.col(turn_col), word(role_col).alias(role_col), word(text_col).alias(text_col), h.alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace(text_col, "[.!?]", "")).otherwise(F.col(text_col))
    x = x.select(conv_col, turn_col, F.when(F.col("h") == 4, "user").otherwise(F.col(role_col)).alias(role_col), text.alias(text_col), F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return x.drop("col")

