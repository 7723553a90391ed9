"""Repair of the turn structure of conversations, by a suffix-shared automaton.

A conversation is a word over row signatures: a letter for the role's initial
(user, system, assistant, other) and the row's first fault (none, truncated,
duplicate, blank). Repaired initials must be of the form (s?(ua)+)?, reached by
the cheapest edits: Keep 0, Rerole to user or assistant 1, Delete 2 (blank and
duplicate rows must go), Insert an empty user or assistant row 5; a truncated
row that stays adds 5.

The words of all conversations are merged from their ends: equal suffixes are
one node (a letter and the node after it), so a node stands for one suffix of
any number of conversations. For each node and each of the four grammar states
the cost to go and the first edit of the best audit are computed once; edits
that cost the same are told apart by their letters (D < I < K < R), which gives
the ASCII-least audit, since each letter has one outcome in a state. An audit
is then read off by following the edits.

In Spark: rows become narrow (ids, order, letter); equal rows are counted first,
so repeated rows are combined before any shuffle; duplicates come from the
first turn of each role and text by a join; rows are range-partitioned by
conversation and order, so a conversation of any length is spread over tasks,
each of which writes its part of the word. Words are made distinct, dealt by
their last letters, so that nodes of more letters than that are in one task
alone, and joined back. Words are followed beyond SHARED letters without
nodes, with four bytes a letter. Texts are shuffled once, for the hash of the
repaired conversation, which is fed row by row: SHA-256 is sequential, so one
conversation's hash is one task's work, in bounded memory.

Defined results: in damage and below, a null role or text is one space, and a
null conv_id or turn is one space in the damage key; a null conv_id is a
conversation of its own; turns are ordered nulls first, equal turns by role and
then by the SHA-256 of the text, so equal rows stand side by side; an empty
role has no initial and is other; an empty table gives an empty result; only
conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

COST_REROLE, COST_DELETE, COST_INSERT, COST_TRUNCATED = 1, 2, 5, 5
#: Letters at a word's end whose suffixes are shared; a conversation beyond them is followed on its own.
SHARED = 512
#: Nodes that a task remembers; beyond them it starts anew.
NODES = 500_000
#: Last letters of a word that tell its task.
TAIL = 4
#: Letters of a word's part that a task writes at once.
PART = 100_000

#: Faults in the order in which the first one counts, after none.
NONE, TRUNCATED, DUPLICATE, BLANK = range(4)
_ROLES = "usa"  # and other
_LETTERS = "ABCDEFGHIJKLMNOP"  # role class x fault

#: Grammar states: at the start, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant row that an edit makes, and the role it gives.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
_KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("a", USER): ASSISTANT, ("u", ASSISTANT): USER}
_NEVER = 1 << 60

_WORDY = r"[^\x20\x09-\x0D]"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage; a repeated row comes twice."""
    blank = F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.withColumn("damage", F.crc32(key) % 20).filter("damage <> 0")
    text = F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    )
    return rows.select("conv_id", "turn", "role", "text", F.explode("copies")).drop("col")


def _digest() -> Column:
    return F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))


def _fault() -> Column:
    ends_well = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return F.when(~F.col("text").rlike(_WORDY), BLANK).when(ends_well, NONE).otherwise(TRUNCATED)


def letters(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, part): per group of equal rows, its letters."""
    narrow = rows.select("conv_id", "turn", "role", _digest().alias("digest"), _fault().alias("fault"))
    same = stored(narrow.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.count(F.lit(1)).alias("n")), "turns")
    # The first turn of a role and text: null before all others.
    first = same.groupBy("conv_id", "role", "digest").agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unplaced"))
    met = same.alias("r").join(first.alias("f"), F.expr("r.conv_id <=> f.conv_id and r.role = f.role and r.digest = f.digest"))
    leads = F.when(F.col("f.unplaced"), F.col("r.turn").isNull()).otherwise(F.col("r.turn") == F.col("f.least"))
    met = met.select("r.*", leads.alias("leads"))
    initial = F.substring("role", 1, 1)
    kind = F.coalesce(*[F.when(initial == c, i) for i, c in enumerate(_ROLES)], F.lit(len(_ROLES)))

    def letter(fault: Column) -> Column:
        return F.substring(F.lit(_LETTERS), kind * 4 + fault + 1, F.lit(1))

    again = F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)
    lead = F.when(F.col("leads"), F.col("fault")).otherwise(again)
    part = F.concat(letter(lead), F.repeat(letter(again), (F.col("n") - 1).cast("int")))
    return met.select("conv_id", "turn", "role", "digest", part.alias("part"))


def _parts(batches):
    """(conv_id, place, part): the letters of a conversation's rows in this task, in order."""
    from pyspark import TaskContext

    place, held, names, out = TaskContext.get().partitionId() << 40, [], ["conv_id", "place", "part"], []
    current, size, kinds = None, 0, None

    def close():
        nonlocal held, size, place
        if held:
            out.append((current, place, "".join(held)))
            place, held, size = place + 1, [], 0

    def emit():
        nonlocal out
        columns = list(zip(*out, strict=True))
        out = []
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kinds), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names)

    for batch in batches:
        kinds = batch.column("conv_id").type
        for conv, part in zip(batch.column("conv_id").to_pylist(), batch.column("part").to_pylist(), strict=True):
            if conv != current or size >= PART:
                close()
                current = conv
            held.append(part)
            size += len(part)
        if len(out) >= 1_000:
            yield emit()
    close()
    if out:
        yield emit()


def words(rows: DataFrame) -> DataFrame:
    """(conv_id, word): the letters of all rows of each conversation, in order."""
    parts = letters(rows)
    order = ["conv_id", "turn", "role", "digest"]
    parts = parts.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "part")
    parts = parts.mapInArrow(_parts, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, part string")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda p: p["part"]), "")
    return parts.groupBy("conv_id").agg(whole.alias("word"))


def _steps(letter: str) -> tuple[bool, int, str]:
    """(must go, cost of staying, initial) of a letter."""
    kind, fault = divmod(_LETTERS.index(letter), 4)
    return fault in (DUPLICATE, BLANK), COST_TRUNCATED * (fault == TRUNCATED), (_ROLES + "?")[kind]


def _closed(costs: list[int], edits: list[str]) -> tuple[tuple[int, ...], str]:
    """Costs and first edits of a node when rows may be inserted before its row."""
    for state in (USER, ASSISTANT):
        other = _NEXT[state]
        if (costs[other] + COST_INSERT, "I") < (costs[state], edits[state]):
            costs[state], edits[state] = costs[other] + COST_INSERT, "I"
            break  # the other one cannot gain from this state as well
    for state in (START, SYSTEM):
        if (costs[USER] + COST_INSERT, "I") < (costs[state], edits[state]):
            costs[state], edits[state] = costs[USER] + COST_INSERT, "I"
    return tuple(costs), "".join(edits)


#: Cost to go and first edit of each state at a word's end; "." ends the audit.
END = _closed([0, _NEVER, _NEVER, 0], [".", ".", ".", "."])


def before(letter: str, costs: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    """(cost to go, first edit) of each state before a row, from the costs after it."""
    must_go, stay, initial = _steps(letter)
    new, edits = [], []
    for state in range(4):
        ways = [(costs[state] + COST_DELETE, "D")]
        if not must_go:
            if (initial, state) in _KEPT:
                ways.append((costs[_KEPT[initial, state]] + stay, "K"))
            ways.append((costs[_NEXT[state]] + COST_REROLE + stay, "R"))
        cost, edit = min(ways)
        new.append(min(cost, _NEVER))
        edits.append(edit)
    return _closed(new, edits)


class Automaton:
    """Nodes by (letter, node after it); the costs and edits of each node are computed when it is first met."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.node = {}
        self.costs, self.edits = [END[0]], [END[1]]  # node 0 is the end

    def solve(self, word: str) -> tuple[int, str]:
        """(cost, audit) of a word."""
        if len(self.node) > NODES:
            self.clear()
        at, path = 0, []  # edits before each row, from the last one
        for letter in reversed(word[-SHARED:]):
            key = (letter, at)
            at = self.node.get(key, -1)
            if at < 0:
                at = self.node[key] = len(self.costs)
                costs, edits = before(letter, self.costs[key[1]])
                self.costs.append(costs)
                self.edits.append(edits)
            path.append(self.edits[at])
        costs = self.costs[at]
        for letter in reversed(word[:-SHARED]):
            costs, edits = before(letter, costs)
            path.append(edits)
        return costs[START], audit(word, "".join(reversed(path)) + END[1])


def audit(word: str, edits: str) -> str:
    """The edits from the start state on; ``edits`` holds four letters for each row and for the end."""
    out, state, at = [], START, 0
    while True:
        edit = edits[4 * at + state]
        if edit == ".":
            return "".join(out)
        out.append(edit)
        if edit == "K":
            state = _KEPT[_steps(word[at])[2], state]
        elif edit != "D":
            state = _NEXT[state]
        at += edit != "I"


def _solved(batches):
    """Per word: its counts of faults and of illegal neighbours, cost and audit."""
    known = Automaton()
    legal = {"su", "ua", "au"}
    for batch in batches:
        rows = []
        for word in batch.column("word").to_pylist():
            counts = [sum(word.count(c) for c in _LETTERS[fault::4]) for fault in (BLANK, DUPLICATE, TRUNCATED)]
            initials = word.translate(_INITIALS)
            illegal = sum(initials[i:i + 2] not in legal for i in range(len(initials) - 1))
            rows.append((word, *counts, illegal, *known.solve(word)))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
        names = ["word", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


_INITIALS = str.maketrans({c: (_ROLES + "?")[i // 4] for i, c in enumerate(_LETTERS)})


def solved(found: DataFrame) -> DataFrame:
    """(word, blank, duplicate, truncated, illegal, cost, audit) of each distinct word."""
    distinct = found.select("word").distinct().repartition(F.substring("word", -TAIL, TAIL), F.length("word") > SHARED)
    return distinct.mapInArrow(_solved, "word string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _repaired(batches):
    """(conv_id, repaired_sha256) from rows sorted by conversation: first its audit, then its rows in order."""
    current, state, at, plan, digest, first, kinds, out = None, START, 0, None, None, True, None, []

    def write(role: str, text: str):
        nonlocal first
        digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
        first = False

    def inserted():
        nonlocal state, at
        while at < len(plan) and plan[at] == "I":
            state, at = _NEXT[state], at + 1
            write(_ROLE_OF[state], "")

    def close():
        if plan is not None:
            inserted()
            out.append((current, digest.hexdigest()))

    def emit():
        nonlocal out
        ids, hashes = zip(*out, strict=True)
        out = []
        return pa.RecordBatch.from_arrays([pa.array(ids, kinds), pa.array(hashes, pa.string())], ["conv_id", "repaired_sha256"])

    for batch in batches:
        kinds = batch.column("conv_id").type
        for conv, edits, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
            if edits is not None:
                close()
                current, state, at, plan, digest, first = conv, START, 0, edits, hashlib.sha256(), True
                continue
            inserted()
            edit, at = plan[at], at + 1
            if edit == "K":
                state = _KEPT[role[:1], state]
                write(role, text)
            elif edit == "R":
                state = _NEXT[state]
                write(_ROLE_OF[state], text)
        if len(out) >= 5_000:
            yield emit()
    close()
    if out:
        yield emit()


def repaired_hashes(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the conversations with an audit."""
    no_text = F.lit(None).cast("string")
    heads = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), no_text.alias("role"), no_text.alias("text"), "audit")
    body = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", no_text.alias("audit"))
    both = heads.union(body).withColumn("digest", _digest())
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return both.select("conv_id", "audit", "role", "text").mapInArrow(_repaired, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text; no null role or text): conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256."""
    found = stored(words(rows), "conversation-words")
    audits = found.join(stored(solved(found), "solved-words"), "word").drop("word")
    audits = stored(audits, "conversation-audits")
    hashes = repaired_hashes(rows, audits.select("conv_id", "audit"))
    turns = rows.select("conv_id", "turn").distinct().groupBy("conv_id")
    gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    out = audits.alias("a").join(gaps.alias("g"), F.expr("a.conv_id <=> g.conv_id")).join(hashes.alias("h"), F.expr("a.conv_id <=> h.conv_id"))
    return out.select("a.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged conversations, with a row for every original conv_id: zeros and an empty audit where
    no row is left."""
    found = repair(damaged(conversations))
    every = conversations.select("conv_id").distinct()
    out = every.alias("e").join(found.alias("f"), F.expr("e.conv_id <=> f.conv_id"), "left")
    counts = [F.coalesce(f"f.{c}", F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("e.conv_id", *counts, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
