"""Conversation structure repair: the cheapest edits that make a dialogue's roles a sentence of the role grammar.

A generalised LR parser reads the turns with the actions keep, rerole, delete and insert, each with a cost. Its
graph-structured stack keeps one node per LR state: nodes with equal tops merge to the one with the least (cost,
audit), the audit being the edits' initials in order. Both shrink to the same minimum whatever follows, since the
rest of the parse depends on the top alone and no audit of equal cost is another's beginning.

A turn matters to the parser only by its role's initial and its first fault, so a run of turns is a map from the top
before it to (cost, audit) per top after it. Turns are sorted by ranges of (conversation, turn), cut into blocks of
bounded size, and each block gets its map where it lies; the blocks of a conversation are then read in order. Neither
step holds a conversation: what is still undecided at the end of a block is passed on, and is decided as soon as
all tops share their edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import WHITE, staged

#: The grammar: conversation = nothing | head pairs; head = nothing | s; pairs = pair | pairs pair; pair = u a.
#: Its LR states by the symbol on top of the stack: nothing read, s, u, pairs.
START, HEAD, USER, PAIRS = range(4)
SHIFT = {(START, "s"): HEAD, (START, "u"): USER, (HEAD, "u"): USER, (PAIRS, "u"): USER}
ACCEPTING = (START, PAIRS)

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
ROLES = {"u": "user", "a": "assistant"}

OK, CUT, BAD = "o", "t", "x"  # a turn without fault, truncated, and one that must go


class Top:
    """A node of the graph-structured stack: an LR state, the cheapest way to it, and the node below."""

    __slots__ = ("state", "cost", "audit", "below")

    def __init__(self, state: int, cost: int, audit: str, below: Top | None):
        self.state, self.cost, self.audit, self.below = state, cost, audit, below


def read_role(top: Top, role: str, cost: int, mark: str) -> Top | None:
    """Shift a role onto a stack and reduce; None where the grammar has no place for it."""
    cost, audit = top.cost + cost, top.audit + mark
    if role == "a" and top.state == USER:  # u a is a pair; a pair joins the pairs before it
        below = top.below
        if below is not None and below.state == PAIRS:
            below = below.below
        return Top(PAIRS, cost, audit, below)
    state = SHIFT.get((top.state, role))
    return None if state is None else Top(state, cost, audit, top)


def merge(tops: dict[int, Top], new: Top | None) -> bool:
    """Put a node among the tops unless one of its state is as cheap."""
    if new is None:
        return False
    old = tops.get(new.state)
    if old is not None and (old.cost, old.audit) <= (new.cost, new.audit):
        return False
    tops[new.state] = new
    return True


def with_inserts(tops: dict[int, Top]) -> dict[int, Top]:
    """The tops and all that inserted turns lead to."""
    todo = list(tops.values())
    while todo:
        top = todo.pop()
        if tops[top.state] is top:
            for role in "ua":
                new = read_role(top, role, INSERT, "I")
                if merge(tops, new):
                    todo.append(new)
    return tops


@lru_cache(maxsize=200_000)
def run_of(turns: str, entry: int) -> tuple[tuple[int, str] | None, ...]:
    """(cost, audit) per state after a run of turns, from state ``entry``. A turn is two characters: initial and fault."""
    below = Top(START, 0, "", None)
    first = {START: below, HEAD: Top(HEAD, 0, "", below), USER: Top(USER, 0, "", below), PAIRS: Top(PAIRS, 0, "", below)}[entry]
    tops = with_inserts({entry: first})
    for i in range(0, len(turns), 2):
        initial, fault = turns[i], turns[i + 1]
        after: dict[int, Top] = {}
        for top in tops.values():
            merge(after, Top(top.state, top.cost + DELETE, top.audit + "D", top.below))
            if fault != BAD:
                extra = TRUNCATED if fault == CUT else 0
                merge(after, read_role(top, initial, KEEP + extra, "K"))
                for role in "ua":
                    merge(after, read_role(top, role, REROLE + extra, "R"))
        tops = with_inserts(after)
    return tuple((tops[s].cost, tops[s].audit) if s in tops else None for s in range(4))


def ways_of(turns: str, entries: Iterable[int]) -> list[str]:
    """The maps of a run from several states, as text: entry, state after, cost, audit."""
    return [f"{e} {s} {way[0]} {way[1]}" for e in entries for s, way in enumerate(run_of(turns, e)) if way]


# --- turns and their faults ---


def text_digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault, dealt out and sorted by (conv_id, turn, role, text), nulls first.

    A null role or text is one space. The first fault counts: blank (no other character than white space), duplicate
    (role and text seen earlier in the conversation), truncated (the last such character is not one of ``.!?``).
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    rows = rows.withColumn("same", text_digest(F.col("role"), F.col("text")))
    repeated = rows.groupBy("conv_id", "same").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeated = repeated.select(F.col("conv_id").alias("_conv"), F.col("same").alias("_same"), F.col("first.turn").alias("_turn"), F.lit(True).alias("_several"))
    repeated = staged(repeated)  # few rows, so that Spark sees their size
    met = rows.join(repeated, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("same") == F.col("_same")), "left")
    later = F.col("_several") & ~F.col("turn").eqNullSafe(F.col("_turn"))
    core = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)  # empty where nothing else is left
    fault = F.when(core == "", "blank").when(F.coalesce(later, F.lit(False)), "duplicate").when(~core.isin(".", "!", "?"), "truncated").otherwise("")
    out = met.select("conv_id", "turn", "role", "text", fault.alias("fault"))
    keys = ["conv_id", "turn", "role", "text"]
    return out.repartitionByRange(*keys).sortWithinPartitions(*keys)


BLOCK = (
    "part long, block long, ways array<string>, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, "
    "head string, tail string, least long, most long, distinct long, first long, last long"
)
BLOCK_TYPES = [pa.int64(), pa.int64(), *[pa.list_(pa.string())] * 3, *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 5]
BLOCK_NAMES = [c.split()[0] for c in BLOCK.split(", ")]


def id_types(df: DataFrame) -> tuple[str, pa.DataType]:
    """The type of conv_id for Spark and for Arrow."""
    return df.select("conv_id").dtypes[0][1], to_arrow_type(df.schema["conv_id"].dataType)


def initial_of(role: str) -> str:
    return role[:1]


def legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def in_blocks(turns: DataFrame, rows: int, size: int) -> DataFrame:
    """Runs of at most ``rows`` turns and about ``size`` characters of one conversation, with their maps and counts.

    A run that surely begins its conversation has a map from the start alone, others from every state. Texts of
    turns that must go are left out.
    """
    conv_type, arrow_type = id_types(turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        conv, own, chars, opened, before, first_of_part = None, [], 0, False, None, True
        out: list[list] = []

        def close() -> None:
            nonlocal own, chars, made
            codes, roles, texts = [], [], []
            counts = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
            illegal, seen = 0, [t for t, _, _, _ in own if t is not None]
            for i, (_, role, text, fault) in enumerate(own):
                counts[fault] += 1
                initial = initial_of(role)
                illegal += i > 0 and not legal(initial_of(own[i - 1][1]), initial)
                codes.append((initial if initial in ("s", "u", "a") else "-") + {"": OK, "truncated": CUT}.get(fault, BAD))
                live = fault in ("", "truncated")
                roles.append(role if live else "")
                texts.append(text if live else "")
            distinct = len(set(seen))
            ways = ways_of("".join(codes), (START,) if opened else range(4))
            out.append([conv, part, made, ways, roles, texts, counts["blank"], counts["duplicate"], counts["truncated"], illegal, initial_of(own[0][1]), initial_of(own[-1][1]), *((min(seen), max(seen), distinct, seen[0], seen[-1]) if seen else (None, None, 0, None, None))])
            own, chars, made = [], 0, made + 1

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first_of_part or row[0] != conv:
                    if own:
                        close()
                    conv, opened, before = row[0], not first_of_part, None
                    first_of_part = False
                elif len(own) >= rows or chars >= size:
                    close()
                    opened = False
                fault = row[4]
                if fault in ("", "truncated") and before == row[:4]:
                    fault = "duplicate"  # an identical row just before: the first of them stays
                before = row[:4]
                own.append((row[1], row[2], row[3], fault))
                chars += len(row[3])
            if len(out) >= 1000:
                yield as_batch(out)
                out = []
        if own:
            close()
        if out:
            yield as_batch(out)

    def as_batch(rows: list[list]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow_type), *(pa.array(c, t) for c, t in zip(columns[1:], BLOCK_TYPES, strict=True))], ["conv_id", *BLOCK_NAMES])

    return turns.mapInArrow(run, f"conv_id {conv_type}, {BLOCK}")


# --- reading the blocks of a conversation ---


class Conversation:
    """Reads blocks in order. Decided blocks leave at once: ``ready`` holds (roles, texts, audit) of each."""

    def __init__(self):
        self.ways: dict[int, tuple[int, str, tuple]] = {START: (0, "", ())}  # top -> cost, audit since what is decided, audits of the pending blocks
        self.pending: list[dict] = []
        self.ready: list[tuple[list[str], list[str], str]] = []
        self.state = START  # top at the end of what is decided
        self.cost = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.tail: str | None = None
        self.least = self.most = self.last = None

    def add(self, block: dict) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + block[name])
        if self.tail is not None:
            self.illegal += not legal(self.tail, block["head"])
        self.tail = block["tail"]
        if block["least"] is not None:
            self.least = block["least"] if self.least is None else min(self.least, block["least"])
            self.most = block["most"] if self.most is None else max(self.most, block["most"])
            self.distinct += block["distinct"] - (self.last == block["first"])
            self.last = block["last"]
        ways: dict[int, tuple[int, str, tuple]] = {}
        for way in block["ways"]:
            top, after, more, edits = way.split(" ")
            if int(top) in self.ways:
                cost, audit, parts = self.ways[int(top)]
                new = (cost + int(more), audit + edits, (*parts, edits))
                if int(after) not in ways or new[:2] < ways[int(after)][:2]:
                    ways[int(after)] = new
        self.ways = ways
        self.pending.append({"roles": block["roles"], "texts": block["texts"]})
        self.settle()

    def settle(self) -> None:
        """Blocks on whose edits all tops agree are decided."""
        n = len(self.pending)
        while n and len({parts[:n] for _, _, parts in self.ways.values()}) > 1:
            n -= 1
        if n:
            shared = next(iter(self.ways.values()))[2][:n]
            self.ready += [(b["roles"], b["texts"], a) for b, a in zip(self.pending[:n], shared, strict=True)]
            self.pending = self.pending[n:]
            self.ways = {s: (c, "".join(p[n:]), p[n:]) for s, (c, _, p) in self.ways.items()}

    def finish(self) -> None:
        """The cheapest way that the grammar accepts."""
        cost, _, parts = min((self.ways[s] for s in ACCEPTING if s in self.ways), key=lambda w: w[:2])
        self.cost = cost
        self.ready += [(b["roles"], b["texts"], a) for b, a in zip(self.pending, parts, strict=True)]
        self.pending = []

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.distinct

    def repaired(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns that stay or come in, block by block as they are decided."""
        for roles, texts, audit in self.ready:
            at = 0
            for edit in audit:
                role, text = ("", "") if edit == "I" else (roles[at], texts[at])
                at += edit != "I"
                if edit == "D":
                    continue
                if edit != "K":
                    role = ROLES["a" if self.state == USER else "u"]
                initial = initial_of(role)
                self.state = PAIRS if initial == "a" else SHIFT[self.state, initial]
                yield edit, role, text
        self.ready = []


def each_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Conversation, bool]]:
    """(conv_id, conversation, whole) after every block, and once with ``whole`` at its end."""
    conv, reader = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if reader is None or row["conv_id"] != conv:
                if reader is not None:
                    reader.finish()
                    yield conv, reader, True
                conv, reader = row["conv_id"], Conversation()
            reader.add(row)
            yield conv, reader, False
    if reader is not None:
        reader.finish()
        yield conv, reader, True


def blocks_of(conversations: DataFrame, rows: int, size: int) -> DataFrame:
    """The blocks of every conversation together and in order."""
    return in_blocks(ordered_turns(conversations), rows, size).repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")


def repair_turns(conversations: DataFrame, rows: int = 256, size: int = 1 << 20) -> DataFrame:
    """The repaired conversations, a row per turn: conv_id, position (long, from 0), edit (K, R or I), role, text.

    Nulls in role or text are one space; a null conv_id is a conversation like others; null turns come first. Rows of
    one turn are read by role, then text; of identical rows the first stays. Turns of conversations of any length are
    repaired; an empty table gives no rows; other columns are ignored.
    """
    conv_type, arrow_type = id_types(conversations)
    names = ["conv_id", "position", "edit", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        position, out = 0, []
        for conv, reader, whole in each_conversation(batches):
            for edit, role, text in reader.repaired():
                out.append((conv, position, edit, role, text))
                position += 1
            position = 0 if whole else position
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)

    schema = pa.schema([("conv_id", arrow_type), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return blocks_of(conversations, rows, size).mapInArrow(run, f"conv_id {conv_type}, position long, edit string, role string, text string")


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair_summary(conversations: DataFrame, rows: int = 256, size: int = 1 << 20) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256.

    See ``repair_turns``. ``gaps`` are the turn numbers missing between the least and the greatest. The digest is that
    of ``role:text`` of the repaired turns, joined by line feeds, and is computed block by block.
    """
    conv_type, arrow_type = id_types(conversations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, audit, begun, out = hashlib.sha256(), [], False, []
        for conv, reader, whole in each_conversation(batches):
            audit += [a for _, _, a in reader.ready]
            for _, role, text in reader.repaired():
                digest.update((("\n" if begun else "") + role + ":" + text).encode())
                begun = True
            if whole:
                out.append((conv, reader.gaps(), reader.blank, reader.duplicate, reader.truncated, reader.illegal, reader.cost, "".join(audit), digest.hexdigest()))
                digest, audit, begun = hashlib.sha256(), [], False
            if len(out) >= 5000:
                yield as_batch(out)
                out = []
        if out:
            yield as_batch(out)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        types = [arrow_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", *SUMMARY, "audit", "repaired_sha256"])

    fields = ", ".join(f"{c} long" for c in SUMMARY)
    return blocks_of(conversations, rows, size).mapInArrow(run, f"conv_id {conv_type}, {fields}, audit string, repaired_sha256 string")
