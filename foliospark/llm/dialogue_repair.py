"""Conversation repair by bidirectional Dijkstra over the lattice of edits.

A node is (rows read, last role kept): nothing yet, system, user or assistant. Keep, rerole and delete read
a row, insert reads none. A forward heap grows from the start, a reverse heap from the accepted ends; they
stop when no cheaper or equally cheap crossing can be left, and of all crossings of least cost the one with
the ASCII-least audit (forward part and reverse part joined) is taken. At one node two audits of equal cost
are never prefixes of each other, since only paid insertions read no row, so the least parts make the least whole.

Rows are sorted by conversation and turn over range partitions, so a long conversation spreads over tasks. A
task streams them and searches each conversation in blocks of at most ``BLOCK`` rows. Most conversations are
one block and done. For the others each block is searched between every pair of roles at its borders; the
blocks of a conversation are then chained in order, four labels at a time, and the chosen path goes back
to the blocks, whose texts are streamed in order into one digest. That digest is sequential by its definition; nothing is grouped.

Defined cases. Null role and text are one space, and in the damage key null conv_id and turn; a null conv_id is a
conversation, a null turn comes first. Rows of one turn come by role, the first 64 characters of the text, and
SHA-256 of the text. Repeated rows are duplicates but for the first. A role's initial is its first character (none if
empty). No rows after damage: zeros, empty audit, digest of the empty string. Empty table: no rows. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliospark.llm.common import hot_join, named, stored

BLOCK = 1024  # rows searched at once
CHARS = 8 << 20  # characters of text held at once
# The faults, and what an edit costs.
SOUND, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
BEFORE = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
AFTER = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAME = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)


# ---------------------------------------------------------------- the search


def steps(rows: list[tuple[str, int]], at: int, state: int, back: bool) -> Iterator[tuple[int, int, int, str]]:
    """Edits from a node, or into it: (rows read, state, cost, letter) of the other end."""
    for other in BEFORE.get(state, ()) if back else AFTER[state]:
        if (state if back else other) != SYSTEM:
            yield at, other, INSERT, "I"
    place = at - 1 if back else at
    if not 0 <= place < len(rows):
        return
    there = place if back else at + 1
    role, fault = rows[place]
    yield there, state, DELETE, "D"
    if fault in (BLANK, DUPLICATE):
        return
    extra = UNFINISHED if fault == TRUNCATED else 0
    for other in BEFORE.get(state, ()) if back else AFTER[state]:
        into = state if back else other
        if INITIAL.get(role) == into:
            yield there, other, extra, "K"
        if into != SYSTEM:
            yield there, other, REROLE + extra, "R"


def search(rows: list[tuple[str, int]], entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit): cheapest, then ASCII-least edits of rows (initial, fault) from a state to one of some states."""
    n = len(rows)
    # Nodes of equal cost come in the order of their rows, so that a free edit never improves a settled node.
    heaps = ([(0, 0, entry)], [(0, 0, s) for s in exits])
    labels = ({(0, entry): (0, "")}, {(n, s): (0, "") for s in exits})
    settled = (set(), set())
    best = NONE
    for heap in heaps:
        heapq.heapify(heap)
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best[0]:
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, read, state = heapq.heappop(heaps[side])
        node = (n - read if side else read, state)
        if node in settled[side]:
            continue
        settled[side].add(node)
        audit = labels[side][node][1]
        if node in settled[1 - side]:  # a crossing at a node: both parts are final
            rest = labels[1 - side][node]
            best = min(best, (cost + rest[0], rest[1] + audit if side else audit + rest[1]))
        for at, other, more, letter in steps(rows, *node, bool(side)):
            found = (cost + more, letter + audit if side else audit + letter)
            if (at, other) in settled[1 - side]:  # a crossing on an edge
                rest = labels[1 - side][at, other]
                best = min(best, (found[0] + rest[0], rest[1] + found[1] if side else found[1] + rest[1]))
            if (at, other) not in settled[side] and found < labels[side].get((at, other), NONE):
                labels[side][at, other] = found
                heapq.heappush(heaps[side], (found[0], n - at if side else at, other))
    return None if best == NONE else best


def replay(rows: list[tuple[str, str]], audit: str, state: int) -> Iterator[str]:
    """Repaired ``role:text`` of rows (role, text); the audit fixes every role."""
    rest = iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rest)
        if letter == "D":
            continue
        state = INITIAL[role[0]] if letter == "K" else ASSISTANT if state == USER else USER
        yield f"{role if letter == 'K' else NAME[state]}:{text}"


class Digest:
    """SHA-256 of lines joined by line breaks, line by line."""

    def __init__(self):
        self.sha, self.started = hashlib.sha256(), False

    def add(self, lines: Iterator[str]) -> None:
        for text in lines:
            self.sha.update(("\n" if self.started else "").encode() + text.encode())
            self.started = True


# ---------------------------------------------------------------- rows after damage


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): the stated damage. A dropped row stays as ``gone``, so that its conversation does."""
    blank = lambda c: F.coalesce(named(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 0, "").when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(kind == 4, "user").otherwise(blank("role"))
    rows = conversations.select(named("conv_id").alias("conv_id"), named("turn").alias("turn"), role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), kind.alias("kind"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", "role", "text", "gone", copies.alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """Rows with their fault but for duplicates, and a row ``copy_of`` ahead of each duplicate, as sort keys tell."""
    kept = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(kept == "", BLANK).when(~F.right(kept, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    same = F.concat_ws(":", F.isnull("conv_id").cast("string"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"), "role", "text")
    rows = rows.select(
        "conv_id", "turn", "role", "text", "gone", fault.alias("fault"), F.unhex(F.sha2(same, 256)).alias("same"), F.left("role", F.lit(64)).alias("by_role"),
        F.left("text", F.lit(64)).alias("by_text"), F.monotonically_increasing_id().alias("uid"),
    )
    rows = stored(rows, "dialogue-rows")  # fixes the numbers
    order = F.struct("turn", "uid")
    groups = rows.where("not gone").groupBy("same").agg(
        F.min(order).alias("first"), F.count("*").alias("n"), F.first("conv_id").alias("conv_id"), F.first("by_role").alias("by_role"), F.first("by_text").alias("by_text")
    )
    groups = stored(groups.where("n > 1"), "dialogue-groups")
    later = hot_join(rows.where("not gone").select("same", "turn", "uid"), groups, "same", "n").where("uid <> first.uid")
    marks = later.select(
        "conv_id", "turn", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("gone"), F.lit(DUPLICATE).alias("fault"),
        "same", "by_role", "by_text", "uid",
    )
    return rows.unionByName(marks)


# ---------------------------------------------------------------- blocks


BLOCKS = (
    "place long, rows long, least long, most long, turns long, blank long, duplicate long, truncated long, illegal long, opens string, closes string, "
    "cost long, audit string, repaired_sha256 string, ways array<string>, roles array<string>, texts array<string>"
)
LEGAL = ("su", "ua", "au")
NONE = (float("inf"), "")


class Block:
    """Rows of one conversation, in order."""

    def __init__(self):
        self.rows: list[tuple[str, str, int]] = []
        self.chars, self.turns, self.least, self.most = 0, 0, None, None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.rows.append((role, text, fault))
        self.chars += len(role) + len(text)
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn

    def facts(self) -> dict:
        kinds = [f for _, _, f in self.rows]
        marks = [r[:1] for r, _, _ in self.rows]
        return {
            "rows": len(kinds), "least": self.least, "most": self.most, "turns": self.turns, "blank": kinds.count(BLANK), "duplicate": kinds.count(DUPLICATE),
            "truncated": kinds.count(TRUNCATED), "illegal": sum(a + b not in LEGAL for a, b in zip(marks, marks[1:])),
            "opens": marks[0] if marks else None, "closes": marks[-1] if marks else None,
        }

    def lattice(self) -> list[tuple[str, int]]:
        return [(r[:1], f) for r, _, f in self.rows]

    def alone(self) -> dict:
        """Result of a conversation that is this block."""
        cost, audit = search(self.lattice(), START, ENDS)
        digest = Digest()
        digest.add(replay([r[:2] for r in self.rows], audit, START))
        return self.facts() | {"cost": cost, "audit": audit, "repaired_sha256": digest.sha.hexdigest()}

    def part(self, place: int) -> dict:
        """What a longer conversation needs of this block: the cheapest way between any two states, and the rows."""
        lattice, ways = self.lattice(), []
        for entry in (START, SYSTEM, USER, ASSISTANT):
            for leave in (START, SYSTEM, USER, ASSISTANT):
                found = search(lattice, entry, (leave,))
                if found:
                    ways.append(f"{entry} {leave} {found[0]} {found[1]}")
        return self.facts() | {"place": place, "ways": ways, "roles": [r for r, _, _ in self.rows], "texts": [t for _, t, _ in self.rows]}


def batched(rows: Iterator[dict], schema: pa.Schema, most: int = 500) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most or row.get("texts"):
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition to results of whole conversations and to blocks of others.

    The first and the last conversation of a partition may go on elsewhere, so they are made blocks.
    """

    def made() -> Iterator[dict]:
        now, block, whole, number, copy, base = None, None, False, 0, None, TaskContext.get().partitionId() << 32
        for batch in batches:
            for conv, turn, role, text, gone, fault, uid in zip(*(c.to_pylist() for c in batch.columns)):
                if block is None or conv != now:
                    if block is not None:
                        yield {"conv_id": now} | (block.alone() if whole else block.part(base + number))
                        number += 1
                    whole = block is not None
                    now, block = conv, Block()
                if role is None:
                    copy = uid
                elif not gone:
                    block.add(turn, role, text, DUPLICATE if fault != BLANK and uid == copy else fault)
                    if len(block.rows) >= most or block.chars >= CHARS:
                        yield {"conv_id": now} | block.part(base + number)
                        number, whole = number + 1, False
                        block = Block()
        if block is not None:
            yield {"conv_id": now} | block.part(base + number)

    return batched(made(), schema)


# ---------------------------------------------------------------- conversations of several blocks


def chained(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks (conv_id, place, facts, ways) in order to one result a conversation and its part for each block.

    A label is (cost, audit, chain). What the audits of all labels share is cut off, as only comparisons are left.
    """

    def finished(conv, root, facts, labels) -> Iterator[dict]:
        cost, _, chain = min(labels[s] for s in ENDS if s in labels)
        parts = []
        while chain:
            chain, place, entry, audit = chain
            parts.append((place, entry, audit))
        parts.reverse()
        for place, entry, audit in parts:
            yield {"root": root, "place": place, "entry": entry, "audit": audit}
        yield {"conv_id": conv, "root": root, "cost": cost, "audit": "".join(p[2] for p in parts)} | facts

    def made() -> Iterator[dict]:
        now, root, facts, labels = None, None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if labels is None or row["conv_id"] != now:
                    if labels is not None:
                        yield from finished(now, root, facts, labels)
                    now, root, labels = row["conv_id"], row["place"], {START: (0, "", None)}
                    facts = dict.fromkeys(("rows", "turns", "blank", "duplicate", "truncated", "illegal"), 0) | {"least": None, "most": None, "closes": None}
                if facts["rows"] and row["rows"]:
                    facts["illegal"] += facts["closes"] + row["opens"] not in LEGAL
                facts["turns"] -= row["least"] is not None and row["least"] == facts["most"]
                for name in ("rows", "turns", "blank", "duplicate", "truncated", "illegal"):
                    facts[name] += row[name]
                facts["least"] = row["least"] if facts["least"] is None else facts["least"]
                facts["most"] = facts["most"] if row["most"] is None else row["most"]
                facts["closes"] = row["closes"] if row["rows"] else facts["closes"]
                after = {}
                for way in row["ways"]:
                    entry, leave, cost, audit = way.split(" ", 3)
                    before = labels.get(int(entry))
                    if before:
                        found = (before[0] + int(cost), before[1] + audit, (before[2], row["place"], int(entry), audit))
                        if found[:2] < after.get(int(leave), NONE)[:2]:
                            after[int(leave)] = found
                shared = len(os.path.commonprefix([v[1] for v in after.values()]))
                labels = {s: (c, a[shared:], chain) for s, (c, a, chain) in after.items()}
        if labels is not None:
            yield from finished(now, root, facts, labels)

    return batched(made(), schema)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (root, roles, texts, entry, audit) in order to one digest a root."""
    schema = pa.schema([("root", pa.int64()), ("repaired_sha256", pa.string())])

    def made() -> Iterator[dict]:
        now, digest = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["root"] != now:
                    if now is not None:
                        yield {"root": now, "repaired_sha256": digest.sha.hexdigest()}
                    now, digest = row["root"], Digest()
                digest.add(replay(list(zip(row["roles"], row["texts"])), row["audit"], row["entry"]))
        if now is not None:
            yield {"root": now, "repaired_sha256": digest.sha.hexdigest()}

    return batched(made(), schema)


def repair(rows: DataFrame, most: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows as ``damaged`` gives them."""
    keys = ["conv_id", "turn", "by_role", "by_text", "same", "uid"]
    every = faults(rows)
    ordered = every.repartitionByRange(*keys).sortWithinPartitions(*keys, F.col("role").isNotNull())
    kind = rows.schema["conv_id"].dataType.simpleString()
    narrow = ordered.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "gone", "fault", "uid")
    shape = f"conv_id {kind}, {BLOCKS}"
    arrow = arrow_schema(shape)
    found = stored(narrow.mapInArrow(lambda b: blocks(b, arrow, most), shape), "dialogue-blocks")
    facts = ["turns", "blank", "duplicate", "truncated", "illegal", "least", "most"]
    alone = found.where("place is null")

    long = found.where("place is not null")
    links_shape = f"conv_id {kind}, root long, place long, entry int, cost long, audit string, turns long, blank long, duplicate long, truncated long, illegal long, least long, most long"
    links_arrow = arrow_schema(links_shape)
    chain = long.select("conv_id", "place", "ways", "rows", *facts, "opens", "closes").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    links = stored(chain.mapInArrow(lambda b: chained(b, links_arrow), links_shape), "dialogue-links")
    parts = links.where("place is not null").select("root", "place", "entry", "audit")
    texts = long.select("place", "roles", "texts").join(parts, "place").repartition("root").sortWithinPartitions("root", "place")
    sums = texts.select("root", "roles", "texts", "entry", "audit").mapInArrow(digests, "root long, repaired_sha256 string")
    spread = links.where("place is null").join(sums, "root")

    # Decimals: two turns may lie further apart than a long can say (then null).
    wide = lambda c: F.col(c).cast("decimal(21,0)")
    gaps = F.coalesce(wide("most") - wide("least") + 1 - wide("turns"), F.lit(0).cast("decimal(21,0)"))
    gaps = F.when(gaps <= F.lit((1 << 63) - 1).cast("decimal(21,0)"), gaps).cast("long")
    out = ["conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return alone.select(*out).unionByName(spread.select(*out))


def arrow_schema(shape: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(shape))


def op13_dialogue(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
