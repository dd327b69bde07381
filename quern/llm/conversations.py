"""Conversations that break their grammar, repaired by the cheapest edits.

The roles of a conversation should read `(s?(ua)+)?` by their first letters. Keeping a turn costs 0, giving it the role
that fits 2, deleting it 3, inserting an empty turn 2; blank and repeated turns must go, and a truncated one that
stays costs 1 more.

Cost layers: for each turn, from the last to the first, layer c is the set of grammar states, as bits, from which
the rest can be repaired at a cost of c or less; each edit shifts a layer of the turn after it (an insertion one of the same turn)
and maps its bits to the states before. The first layer of the first turn that holds the start gives the cost. A walk
from there follows the bits by the least letter that still fits the cost left, which is the least of the cheapest audits.
Layers are kept relative to the first one that isn't empty: costs of states differ by few units, so a turn has few
layers, there are few different stacks of them, and a step from stack to stack is looked up. Work grows with the turns alone.

Turns are ordered by turn (null first), then role, then md5 and value of the text, and dealt in that order by ranges, so that a conversation with a
third of all turns fills many tasks. A task repairs the conversations that lie within its range and have at most `held` turns and
`held_bytes` of text. The others' turns are judged in a distributed way: repeated ones by counts per (conversation, range,
text), then one byte a turn goes through one task, as the conversation's audit, a field of its result, does.

A null role or text stands for one space; a null conv_id is a conversation of its own; repeated rows count as
repeated turns; an empty table gives no row; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import Scratch, small_batches, table

BLANK = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or renamed turn leads to, and its role.
FORCED = [USER, USER, ASSISTANT, USER]
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The states that a role's letter leads to.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ALL = 0b1111
FINE, GOES, TRUNCATED = range(3)
LETTERS = "sua"
VERDICT = "blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _before(step: list[int | None] | dict[int, int], after: int) -> int:
    """The states that step leads into the set after."""
    pairs = step.items() if isinstance(step, dict) else enumerate(step)
    return sum(1 << q for q, to in pairs if after >> to & 1)


class Layers:
    """Stacks of cost layers and the looked-up steps between them. A stack is a tuple of sets, each within the next, the last full."""

    def __init__(self):
        self.steps, self.walks = {}, {}
        self.end = self._stack(lambda c, own: (1 << START | 1 << ASSISTANT) if c >= 0 else 0)[0]

    @staticmethod
    def _stack(layer) -> tuple[tuple[int, ...], int]:
        """The stack of layer(c, earlier layers), closed under insertion, and the cost of its first set."""
        own, c = [], 0
        while not own or own[-1] != ALL:
            own.append(layer(c, own) | (own[c - 1] if c else 0) | (_before(FORCED, own[c - 2]) if c >= 2 else 0))
            c += 1
        first = next(i for i, x in enumerate(own) if x)
        return tuple(own[first:]), first

    @staticmethod
    def _at(stack: tuple[int, ...], c: int) -> int:
        return 0 if c < 0 else stack[c] if c < len(stack) else ALL

    def step(self, after: tuple[int, ...], letter: str, fault: int) -> tuple[tuple[int, ...], int]:
        """The stack before a turn, and by how much its costs begin above those after it."""
        key = after, letter, fault
        if key not in self.steps:

            def layer(c, own):
                found = self._at(after, c - 3)
                if fault != GOES:
                    more = fault == TRUNCATED
                    found |= _before(KEPT.get(letter, {}), self._at(after, c - more)) | _before(FORCED, self._at(after, c - 2 - more))
                return found

            self.steps[key] = self._stack(layer)
        return self.steps[key]

    def walk(self, after: tuple[int, ...], letter: str, fault: int, q: int, c: int) -> tuple[str, int, int]:
        """From state q with cost c left (above the stack's first): the edits up to this turn's, the next state and cost."""
        key = after, letter, fault, q, c
        if key not in self.walks:
            here, rise = self.step(after, letter, fault)
            edits, more = "", fault == TRUNCATED
            while True:
                left = c + rise
                kept = KEPT.get(letter, {}).get(q)
                if self._at(after, left - 3) >> q & 1:
                    self.walks[key] = edits + "D", q, left - 3
                elif self._at(here, c - 2) >> FORCED[q] & 1:
                    edits, q, c = edits + "I", FORCED[q], c - 2
                    continue
                elif fault != GOES and kept is not None and self._at(after, left - more) >> kept & 1:
                    self.walks[key] = edits + "K", kept, left - more
                else:
                    self.walks[key] = edits + "R", FORCED[q], left - 2 - more
                break
        return self.walks[key]

    def repair(self, turns: list[tuple[str, int]]) -> tuple[int, list[str]]:
        """The least cost, and the edits at each turn (insertions before it, then its own; after the last one also those behind it)."""
        stack, total, stacks = self.end, 0, []
        for letter, fault in reversed(turns):
            stacks.append(stack)
            stack, rise = self.step(stack, letter, fault)
            total += rise
        c = next(i for i, x in enumerate(stack) if x >> START & 1)
        total += c
        q, edits = START, []
        for (letter, fault), after in zip(turns, reversed(stacks)):
            made, q, c = self.walk(after, letter, fault, q, c)
            edits.append(made)
        while q not in (START, ASSISTANT):
            edits[-1], q = edits[-1] + "I", FORCED[q]
        return total, edits


class Rebuilt:
    """Applies edits in order: gives the roles and texts of the repaired turns."""

    def __init__(self):
        self.q = START

    def turns(self, edits: str, role: str, text: str) -> Iterator[tuple[str, str]]:
        for e in edits:
            if e == "D":
                continue
            to = KEPT[role[0]][self.q] if e == "K" else FORCED[self.q]
            yield (role, text) if e == "K" else (ROLE[to], text if e == "R" else "")
            self.q = to


def fault_of(role: str, text: str, seen: set) -> int:
    """0 none, 1 blank, 2 duplicate, 3 truncated; seen gets the turn."""
    words = text.strip(BLANK)
    again = (role, text) in seen
    seen.add((role, text))
    return 1 if not words else 2 if again else 3 if words[-1] not in ".!?" else 0


#: What a fault asks for: nothing, that the turn goes, or a unit more if it stays.
ASKED = [FINE, GOES, GOES, TRUNCATED]


def judged(layers: Layers, letters: str, faults: list[int]) -> tuple[dict, list[str]]:
    cost, edits = layers.repair([(a, ASKED[f]) for a, f in zip(letters, faults)]) if letters else (0, [])
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
    return {"blank": faults.count(1), "duplicate": faults.count(2), "truncated": faults.count(3), "illegal": illegal, "cost": cost, "audit": "".join(edits)}, edits


def letter(role: str) -> str:
    """The role's first letter, or - for one that is in no legal pair."""
    return role[0] if role[:1] in ("s", "u", "a") else "-"


def _whole(layers: Layers, conv, turns: list[tuple[int | None, str, str, bool]]) -> dict:
    """The result row of one conversation; turns: turn, role, text, live."""
    live = [t for t in turns if t[3]]
    numbers = {t[0] for t in live if t[0] is not None}
    seen: set = set()
    faults = [fault_of(role, text, seen) for _, role, text, _ in live]
    row, edits = judged(layers, "".join(letter(t[1]) for t in live), faults)
    made = Rebuilt()
    turns = [{"role": r, "text": x} for e, (_, role, text, _) in zip(edits, live) for r, x in made.turns(e, role, text)]
    return {"conv_id": conv, "open": False, "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, **row, "turns": turns}


def _ranges(batches: Iterator[pa.RecordBatch], schema: pa.Schema, held: int, held_bytes: int) -> Iterator[pa.RecordBatch]:
    """Result rows of the conversations that lie within this range; the turns of others, numbered."""
    layers, part = Layers(), TaskContext.get().partitionId()
    rows, out, out_bytes, conv, is_open, size, pos = [], [], 0, None, True, 0, 0
    began = False

    def opened(turn, role, text, live):
        nonlocal pos
        pos += live
        return {"conv_id": conv, "open": True, "part": part, "pos": pos - 1 if live else None, "turn": turn, "role": role, "text": text}

    def flush():
        nonlocal out, out_bytes
        made, out, out_bytes = pa.RecordBatch.from_pylist(out, schema), [], 0
        return made

    for batch in batches:
        for c, *turn in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "live"))):
            if not began or c != conv:
                if began and rows:
                    out.append(_whole(layers, conv, rows))
                # What the range before or after may have too is open: its first conversation, and its last one.
                conv, is_open, rows, size, pos = c, not began, [], 0, 0
                began = True
            width = len(turn[1] or "") + len(turn[2] or "")
            size += width
            out_bytes += width
            if is_open:
                out.append(opened(*turn))
            else:
                rows.append(turn)
                if len(rows) > held or size > held_bytes:
                    out += [opened(*t) for t in rows]
                    rows, is_open = [], True
            if len(out) >= 1000 or out_bytes > held_bytes:
                yield flush()
    out += [opened(*t) for t in rows]
    if out:
        yield flush()


def _judged_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation's kinds (a letter and a fault a turn) in pieces: its verdict, and the edits of each turn, by piece."""
    layers = Layers()
    for batch in batches:
        out = []
        for conv, pieces in zip(batch.column("conv").to_pylist(), batch.column("pieces").to_pylist()):
            kinds = "".join(p["kinds"] for p in pieces)
            row, edits = judged(layers, kinds[0::2], list(map(int, kinds[1::2])))
            at, by_piece = 0, []
            for p in pieces:
                n = len(p["kinds"]) // 2
                by_piece.append({"part": p["part"], "chunk": p["chunk"], "edits": edits[at : at + n]})
                at += n
            out.append({"conv": conv, **row, "pieces": by_piece})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv", pa.string()), *((n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("pieces", pa.list_(pa.struct([("part", pa.int32()), ("chunk", pa.int64()), ("edits", pa.list_(pa.string()))])))]))


def _rebuilt_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns, in order, of sorted turns with their edits."""
    conv, made, place = None, None, 0
    for batch in batches:
        out = []
        for c, role, text, edits in zip(*(batch.column(n).to_pylist() for n in ("conv", "role", "text", "edits"))):
            if c != conv:
                conv, made, place = c, Rebuilt(), 0
            for r, x in made.turns(edits, role, text):
                out.append((c, place, r, x))
                place += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.string()))], ["conv", "place", "role", "text"]) if out else pa.RecordBatch.from_pylist([], pa.schema([("conv", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]))


@dataclass
class Repaired:
    """verdicts: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, turns (array of role and text; null where the
    conversation is long) and conv, a key that tells a null conv_id. long_turns: conv, place, role, text of the long ones'
    repaired turns, in order within each task's rows."""

    verdicts: DataFrame
    long_turns: DataFrame


def conv_key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("c"), conv.cast("string")), F.lit("null"))


def repair(turns: DataFrame, scratch: Scratch, held: int = 4096, held_bytes: int = 1 << 23, chunk: int = 4096) -> Repaired:
    """turns: conv_id, turn, role, text and live; a row that isn't live only names its conversation. scratch keeps what the result reads."""
    spark = turns.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.coalesce("live", F.lit(True)).alias("live"))
    rows = rows.withColumn("_text", F.md5("text")).withColumn("_row", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "_text"]
    dealt = rows.repartitionByRange(n, *order, "_row").sortWithinPartitions(*order, "text").select("conv_id", "turn", "role", "text", "live")
    kind = rows.schema["conv_id"].dataType.simpleString()
    numbers = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    schema = f"conv_id {kind}, open boolean, {numbers}, turns array<struct<role:string,text:string>>, part int, pos long, turn long, role string, text string"
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    parted = scratch.stored(dealt.mapInArrow(lambda it: _ranges(it, arrow, held, held_bytes), schema), "conversations", keep=True)
    conv = conv_key(F.col("conv_id")).alias("conv")
    whole = parted.where("not open").select("conv_id", conv, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns")
    rest = parted.where("open").select("conv_id", conv, "part", "pos", "turn", "role", "text")
    live = rest.where("pos is not null")
    facts = rest.groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    numbers_of = live.where("turn is not null").select("conv", "turn").distinct().groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    # Repeated turns: a text's first place in each range, and the first range that has it.
    said = F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")).alias("said")
    words = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", " "))
    letter_of = F.when(F.substring("role", 1, 1).isin(*LETTERS), F.substring("role", 1, 1)).otherwise("-")
    narrow = live.select("conv", "part", "pos", said, letter_of.alias("letter"), (F.length(words) == 0).alias("is_blank"), (~F.right(words, F.lit(1)).isin(".", "!", "?")).alias("cut_off"))
    firsts = narrow.groupBy("conv", "said", "part").agg(F.min("pos").alias("at"))
    earliest = firsts.groupBy("conv", "said").agg(F.min("part").alias("least"))
    firsts = firsts.join(earliest, ["conv", "said"]).select("conv", "said", "part", F.when(F.col("least") == F.col("part"), F.col("at")).otherwise(-1).alias("at"))
    again = F.col("pos") != F.col("at")
    fault = F.when(F.col("is_blank"), "1").when(again, "2").when(F.col("cut_off"), "3").otherwise("0")
    kinds = narrow.join(firsts, ["conv", "said", "part"]).select("conv", "part", F.floor(F.col("pos") / chunk).alias("chunk"), "pos", F.concat("letter", fault).alias("kind"))
    kinds = kinds.groupBy("conv", "part", "chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "kind"))), lambda x: x["kind"]), "").alias("kinds"))
    pieces = kinds.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "chunk", "kinds"))).alias("pieces"))
    verdict = scratch.stored(pieces.mapInArrow(_judged_long, f"conv string, {VERDICT}, pieces array<struct<part:int,chunk:long,edits:array<string>>>"), "verdicts", keep=True)
    edits = verdict.select("conv", F.explode("pieces").alias("p")).select("conv", "p.part", "p.chunk", F.posexplode("p.edits").alias("at", "edits"))
    edits = edits.select("conv", "part", (F.col("chunk") * chunk + F.col("at")).alias("pos"), "edits")
    ordered = live.select("conv", "part", "pos", "role", "text").join(edits, ["conv", "part", "pos"]).repartition(n, "conv").sortWithinPartitions("conv", "part", "pos").select("conv", "role", "text", "edits")
    long_turns = ordered.mapInArrow(_rebuilt_long, "conv string, place long, role string, text string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    long = facts.join(numbers_of, "conv", "left").join(verdict.drop("pieces"), "conv", "left")
    long = long.select("conv_id", "conv", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.lit(None).cast("array<struct<role:string,text:string>>").alias("turns"))
    return Repaired(whole.unionByName(long), long_turns)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations, damaged by the hash of their id and turn: dropped (not live), emptied, unpunctuated, repeated or given to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code").isin(0, 1), "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("code") != 0).alias("live"), times.alias("_time")).drop("_time")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each conversation's turns, read in order; a turn at a time is held."""
    conv, state = None, None
    for batch in batches:
        out = []
        for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "role", "text"))):
            if c != conv:
                if conv is not None:
                    out.append((conv, state.hexdigest()))
                conv, state = c, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.string()) for x in zip(*out)], ["conv", "digest"])
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([state.hexdigest()])], ["conv", "digest"])


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        found = repair(damaged(table(spark, sf_dir, "conversations")), scratch)
        # A digest of a sequence is made in its order: a long conversation's by one task, a turn at a time.
        digests = scratch.stored(found.long_turns.mapInArrow(_digests, "conv string, digest string"), "digests", keep=True)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    digest = F.when(F.col("turns").isNotNull(), F.sha2(told, 256)).otherwise(F.coalesce("digest", F.sha2(F.lit(""), 256)))
    out = found.verdicts.join(digests, "conv", "left")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", digest.alias("repaired_sha256"))
