"""Repair of conversations whose turns are broken, by generalised LR parsing over the grammar of roles.

A sound conversation is nothing, or a system message if any and then pairs of user and assistant: by role initials, ``(s?(ua)+)?``. An LR
parser of that grammar reads the rows; at every row it follows all actions at once: keep the row, give it another role, delete it,
or insert an empty message before it, each at its price. The stacks that are alive share their lower parts (a graph-structured stack,
whose nodes are kept once for all conversations, as reductions keep stacks shallow), and stacks that come to the same top node are merged:
the cheapest stays, of equal costs the one with the ASCII-least audit, which is the string of its actions' initials.

Audits of the same rows are never prefixes of each other before the inserts at the end, as each ends with the action of the last row, so
what is least now is least after any continuation, and merging loses nothing.

Conversations stream through tasks in order. One with over ``LIMIT`` rows or ``LIMIT_CHARS`` characters is cut into blocks which separate tasks
parse from every possible top node; what remains are small tables of costs and ranks that compose in order, after which each block is
parsed once more from its one top node. So only the tables of a long conversation meet in a task, and its texts in the final digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._util import SPACE, cut_lineage, small_side, spread_join

#: Prices of the actions, and what a truncated row adds that is not deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows and characters up to which a conversation is held in one task; rows of a block of a longer one.
LIMIT, LIMIT_CHARS, BLOCK = 2048, 4_000_000, 1024
ROLES = {"u": "user", "a": "assistant"}
NONE, BLANK, DUPLICATE, TRUNCATION = range(4)

# The LR automaton of  C -> (empty) | P | s P ;  P -> u a | P u a.  A rule is its left side and the number of symbols that it pops.
_RULES = {"C0": ("C", 0), "C1": ("C", 1), "C2": ("C", 2), "P2": ("P", 2), "P3": ("P", 3)}
_ACTIONS = {
    0: {"s": 1, "u": 2, "$": "C0"}, 1: {"u": 2}, 2: {"a": 5}, 3: {"u": 6, "$": "C1"}, 4: {"u": 6, "$": "C2"},
    5: {"u": "P2", "$": "P2"}, 6: {"a": 7}, 7: {"u": "P3", "$": "P3"}, 8: {"$": "accept"},
}
_GOTO = {(0, "P"): 3, (1, "P"): 4, (0, "C"): 8}


class Node(NamedTuple):
    """A top of the stack and what lies below."""

    state: int
    below: "Node | None"


def _step(top: Node, symbol: str) -> Node | None:
    """The top after the reductions that ``symbol`` calls for and its shift; None if it does not fit. ``$`` ends the input."""
    while (action := _ACTIONS[top.state].get(symbol)) is not None:
        if action == "accept":
            return top
        if isinstance(action, int):
            return Node(action, top)
        left, pops = _RULES[action]
        for _ in range(pops):
            top = top.below
        top = Node(_GOTO[top.state, left], top)
    return None


def _graph() -> tuple[list[Node], list[dict[str, int]], set[int]]:
    """All nodes that any input leads to, the moves between them by role initial, and those that may end the input."""
    nodes, moves, at = [Node(0, None)], [], 0
    while at < len(nodes):
        found = {x: node for x in "sua" if (node := _step(nodes[at], x))}
        nodes += [n for n in found.values() if n not in nodes]
        moves.append({x: nodes.index(n) for x, n in found.items()})
        at += 1
    return nodes, moves, {i for i, n in enumerate(nodes) if _step(n, "$")}


NODES, MOVES, FINAL = _graph()

#: Tops that are alive, each with the least (cost, audit) that leads there.
Heads = dict[int, tuple[int, str]]


def _merge(heads: Heads, top: int, cost: int, audit: str) -> bool:
    if top not in heads or (cost, audit) < heads[top]:
        heads[top] = (cost, audit)
        return True
    return False


def with_inserts(heads: Heads) -> Heads:
    """``heads`` and what inserted messages make of them."""
    out, fresh = dict(heads), list(heads)
    while fresh:
        top = fresh.pop()
        cost, audit = out[top]
        fresh += [to for x, to in MOVES[top].items() if x in ROLES and _merge(out, to, cost + INSERT, audit + "I")]
    return out


def parse(heads: Heads, rows: list[tuple[str, int]]) -> Heads:
    """The heads after all rows (role initial, fault), each ending with the last row's action."""
    for initial, fault in rows:
        before, heads = with_inserts(heads), {}
        for top, (cost, audit) in before.items():
            _merge(heads, top, cost + DELETE, audit + "D")
            if fault in (BLANK, DUPLICATE):
                continue
            cost += TRUNCATED * (fault == TRUNCATION)
            if (to := top if initial == "" else MOVES[top].get(initial)) is not None:
                _merge(heads, to, cost + KEEP, audit + "K")
            for x, to in MOVES[top].items():
                if x in ROLES:
                    _merge(heads, to, cost + REROLE, audit + "R")
    return heads


def finished(heads: Heads) -> tuple[int, str]:
    """The least (cost, audit) that may end the input."""
    return min(value for top, value in with_inserts(heads).items() if top in FINAL)


def apply_edits(audit: str, rows: list[tuple[str, str]], top: int = 0) -> list[tuple[str, str, str]]:
    """The repaired messages (edit, role, text) of rows (role, text); a given or inserted role is the only one that fits."""
    out, left = [], iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit in "RI":
            symbol = next(x for x in MOVES[top] if x in ROLES)
            role = ROLES[symbol]
        else:
            symbol = role[:1]
        top = MOVES[top][symbol] if symbol else top
        out.append((edit, role, text))
    return out


class Tally:
    """Counts over rows in order, which can be added up over consecutive blocks."""

    def __init__(self) -> None:
        self.turns, self.first_turn, self.last_turn = 0, None, None
        self.faults, self.illegal, self.first, self.last = [0] * 4, 0, None, None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            if self.first_turn is None:
                self.first_turn = turn
        self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
        self.first, self.last = initial if self.first is None else self.first, initial
        self.faults[fault] += 1

    def extend(self, other: "Tally") -> None:
        if other.turns:
            self.turns += other.turns - (other.first_turn == self.last_turn)
            self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = other.last_turn
        if other.first is not None:
            self.illegal += other.illegal + (self.last is not None and self.last + other.first not in ("su", "ua", "au"))
            self.first, self.last = other.first if self.first is None else self.first, other.last
        self.faults = [a + b for a, b in zip(self.faults, other.faults)]

    def report(self) -> dict[str, int]:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return {"gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATION], "illegal": self.illegal}


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_REPORT = "struct<" + ",".join(f"{n}:bigint" for n in _COUNTS) + ">"
_PIECE = f"conv_id long, at long, report {_REPORT}, audit string, messages array<struct<edit:string,role:string,text:string>>"
_PIECE_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("at", pa.int64()), ("report", pa.struct([(n, pa.int64()) for n in _COUNTS])), ("audit", pa.string()),
    ("messages", pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))),
])


def _runs(batches: Iterator[pa.RecordBatch], key) -> Iterator[list[dict]]:
    """Consecutive rows with the same ``key``; a run may span batches."""
    held: list[dict] = []
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            for row in batch.slice(start, 1024).to_pylist():
                if held and key(row) != key(held[-1]):
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def _pieces(found: Iterator[dict], schema: pa.Schema, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` characters of text."""
    rows, chars = [], 0
    for row in found:
        rows.append(row)
        chars += 200 + sum(len(m["text"]) for m in row.get("messages", ()))
        if chars >= size:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows, chars = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _messages(edits: list[tuple[str, str, str]]) -> list[dict]:
    return [{"edit": e, "role": r, "text": t} for e, r, t in edits]


def _whole(run: list[dict]) -> dict:
    """The piece of a conversation whose rows are all at hand, in order."""
    tally, seen, coded, rows = Tally(), set(), [], []
    for r in run:
        if not r["present"]:
            continue
        said = (r["role"], r["text"])
        fault = BLANK if r["blank"] else DUPLICATE if said in seen else TRUNCATION if r["cut"] else NONE
        seen.add(said)
        coded.append((r["role"][:1], fault))
        rows.append(said)
        tally.add(r["turn"], *coded[-1])
    cost, audit = finished(parse({0: (0, "")}, coded))
    return {"conv_id": run[0]["conv_id"], "at": 0, "report": tally.report() | {"cost": cost}, "audit": audit, "messages": _messages(apply_edits(audit, rows))}


def _prepared(turns: DataFrame, present: Column | None) -> DataFrame:
    """(conv_id, turn, role, text, present, blank, cut); nulls in role and text count as one blank."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.lit(True) if present is None else present).alias("present"))
    return rows.select("*", (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"), (~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("cut"))


#: Ascending, so nulls come first.
_ORDER = ["conv_id", "turn", "role", "text"]


def repaired_pieces(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """(conv_id, at, report, audit, messages): the repaired conversations, long ones in several pieces in the order of ``at``.

    ``messages`` has (edit, role, text); the last piece has the ``report`` of counts and cost, the others none. ``turns`` has conv_id, turn,
    role and text; rows for which ``present`` is not true only say that their conversation exists. Rows are read by turn, nulls first, equal
    turns by role and text. Null conversation ids form one conversation. A row kept with an empty role adds nothing to the initials.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _prepared(turns, present)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    long = cut_lineage(sizes.where((F.col("n") > LIMIT) | (F.col("chars") > LIMIT_CHARS)).select(F.col("conv_id").alias("long")))
    some = not long.isEmpty()
    same, side = F.col("conv_id").eqNullSafe(F.col("long")), small_side(long)
    short = rows.join(side, same, "left_anti") if some else rows
    ordered = short.repartition(n, "conv_id").sortWithinPartitions(*_ORDER)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pieces(map(_whole, _runs(batches, lambda r: r["conv_id"])), _PIECE_ARROW)

    pieces = ordered.mapInArrow(repair, _PIECE)
    return pieces.unionAll(_in_blocks(rows.join(side, same, "left_semi"), n)) if some else pieces


_TALLY = ("turns long, first_turn long, last_turn long, faults array<long>, illegal long, first string, last string")
_BLOCK = f"conv_id long, at long, initials array<string>, codes array<int>, heads array<struct<entry:int,exit:int,cost:long,rank:int>>, {_TALLY}"
_BLOCK_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("at", pa.int64()), ("initials", pa.list_(pa.string())), ("codes", pa.list_(pa.int32())),
    ("heads", pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32())]))),
    ("turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("faults", pa.list_(pa.int64())), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()),
])
_CHOICE = f"conv_id long, at long, entry int, exit int, tail int, report {_REPORT}, initials array<string>, codes array<int>"
_CHOICE_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("at", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("tail", pa.int32()), ("report", pa.struct([(n, pa.int64()) for n in _COUNTS])),
    ("initials", pa.list_(pa.string())), ("codes", pa.list_(pa.int32())),
])


def _block(run: list[dict]) -> dict:
    """A block parsed from every top node: for each pair of tops the cost, and the audit's place among those of the same entry."""
    tally, coded = Tally(), []
    for r in run:
        coded.append((r["initial"], r["fault"]))
        tally.add(r["turn"], *coded[-1])
    heads = []
    for entry in range(len(NODES)):
        found = sorted(parse({entry: (0, "")}, coded).items(), key=lambda x: x[1][1])
        heads += [{"entry": entry, "exit": to, "cost": cost, "rank": rank} for rank, (to, (cost, _)) in enumerate(found)]
    counts = {k: getattr(tally, k) for k in ("turns", "first_turn", "last_turn", "faults", "illegal", "first", "last")}
    return {"conv_id": run[0]["conv_id"], "at": run[0]["at"], "initials": [c[0] for c in coded], "codes": [c[1] for c in coded], "heads": heads} | counts


def _chosen(blocks: list[dict]) -> Iterator[dict]:
    """The tops where each block of one conversation begins and ends, from the blocks' tables in order."""
    heads, back, tally = {0: (0, 0)}, [], Tally()  # top: (cost, place of its audit among those of the other tops)
    for b in blocks:
        part = Tally()
        part.__dict__.update({k: b[k] for k in part.__dict__})
        tally.extend(part)
        best: dict[int, tuple] = {}
        for h in b["heads"]:
            if h["entry"] in heads:
                cost, place = heads[h["entry"]]
                value = (cost + h["cost"], place, h["rank"], h["entry"])
                best[h["exit"]] = min(best.get(h["exit"], value), value)
        places = {x: i for i, x in enumerate(sorted({v[1:3] for v in best.values()}))}
        back.append({x: v[3] for x, v in best.items()})
        heads = {x: (v[0], places[v[1:3]]) for x, v in best.items()}
    ends = []
    for top, (cost, place) in heads.items():
        ends += [(c + cost, place, audit, top) for to, (c, audit) in with_inserts({top: (0, "")}).items() if to in FINAL]
    cost, _, tail, top = min(ends)
    path = []
    for links in reversed(back):
        path.append((links[top], top))
        top = links[top]
    for i, (b, (entry, to)) in enumerate(zip(blocks, reversed(path))):
        last = i == len(blocks) - 1
        yield {k: b[k] for k in ("conv_id", "at", "initials", "codes")} | {"entry": entry, "exit": to, "tail": len(tail) * last, "report": tally.report() | {"cost": cost} if last else None}


def _in_blocks(rows: DataFrame, n: int) -> DataFrame:
    """Pieces of long conversations. Their rows are range-sorted over tasks and numbered; identical rows may part."""
    ranged = rows.where("present").withColumn("salt", F.rand(1)).repartitionByRange(n, *_ORDER, "salt").sortWithinPartitions(*_ORDER)
    placed = cut_lineage(ranged.select(F.monotonically_increasing_id().alias("at"), *rows.columns))
    said = F.sha2(F.concat_ws("\x00", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.length("role").cast("string"), "role", "text"), 256)
    keyed = placed.where("NOT blank").select("at", said.alias("said"))
    firsts = keyed.groupBy("said").agg(F.min("at").alias("since"), F.count("*").alias("n")).where("n > 1").select("said", "since")
    again = spread_join(keyed, firsts, "said", "at").where(F.col("at") > F.col("since")).select("at", F.lit(True).alias("again"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("again"), DUPLICATE).when(F.col("cut"), TRUNCATION).otherwise(NONE)
    coded = placed.select("at", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "cut").join(again, "at", "left")
    part = F.shiftright("at", 33)  # rows that were sorted together
    coded = coded.select("at", "conv_id", "turn", "initial", fault.alias("fault")).repartition(n, part).sortWithinPartitions("at")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _runs(batches, lambda r: (r["conv_id"], r["at"] >> 33, (r["at"] & ((1 << 33) - 1)) // BLOCK))
        yield from _pieces(map(_block, runs), _BLOCK_ARROW)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pieces((c for run in _runs(batches, lambda r: r["conv_id"]) for c in _chosen(run)), _CHOICE_ARROW)

    tables = coded.mapInArrow(blocks, _BLOCK).repartition(n, "conv_id").sortWithinPartitions("conv_id", "at")
    chosen = tables.mapInArrow(choose, _CHOICE)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in ("role string", "text string"))]
    heads = chosen.select("conv_id", "at", F.lit(0).alias("kind"), "entry", "exit", "tail", "report", "initials", "codes", *nothing)
    texts = placed.select("conv_id", "at", F.lit(1).alias("kind"), "role", "text")
    both = heads.unionByName(texts, allowMissingColumns=True).repartition(n, part).sortWithinPartitions("at", "kind")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            head, rows = None, []
            for run in _runs(batches, lambda r: r["at"]):
                if run[0]["kind"] == 0:
                    if head:
                        yield _edited(head, rows)
                    head, rows = run[0], []
                rows.append((run[-1]["role"], run[-1]["text"]))
            if head:
                yield _edited(head, rows)

        yield from _pieces(found(), _PIECE_ARROW)

    pieces = both.mapInArrow(edit, _PIECE).repartition(n, "conv_id").sortWithinPartitions("conv_id", "at")
    # A conversation of which no row is present has no block.
    gone = rows.groupBy("conv_id").agg(F.max("present").alias("some")).where("NOT some")
    report = F.struct(*[F.lit(0).cast("long").alias(c) for c in _COUNTS])
    return pieces.unionAll(gone.select("conv_id", F.lit(0).cast("long"), report, F.lit(""), F.from_json(F.lit("[]"), "array<struct<edit:string,role:string,text:string>>")))


def _edited(head: dict, rows: list[tuple[str, str]]) -> dict:
    _, audit = parse({head["entry"]: (0, "")}, list(zip(head["initials"], head["codes"])))[head["exit"]]
    audit += "I" * head["tail"]
    return {"conv_id": head["conv_id"], "at": head["at"], "report": head["report"], "audit": audit, "messages": _messages(apply_edits(audit, rows, head["entry"]))}


def repaired_messages(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """(conv_id, at, place, edit, role, text): the messages of the repaired conversations, in the order of (at, place)."""
    return repaired_pieces(turns, present).select("conv_id", "at", F.posexplode("messages").alias("place", "message")).select("conv_id", "at", "place", "message.*")


def repair_reports(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conversation.

    The digest is that of the repaired ``role:text``, joined by newlines. See ``repaired_pieces`` for what is read and how; other
    columns are not looked at, and an empty table gives an empty result. An audit is one string, so a conversation may have 2**31 rows at most.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            sha, audit, begun = hashlib.sha256(), [], False
            for batch in batches:
                for i in range(batch.num_rows):
                    piece = batch.slice(i, 1).to_pylist()[0]
                    for m in piece["messages"]:
                        sha.update(f"{chr(10) if begun else ''}{m['role']}:{m['text']}".encode("utf-8", "replace"))
                        begun = True
                    audit.append(piece["audit"])
                    if piece["report"]:  # the last piece
                        yield {"conv_id": piece["conv_id"], **piece["report"], "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
                        sha, audit, begun = hashlib.sha256(), [], False

        yield from _pieces(found(), pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())]))

    schema = "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    return repaired_pieces(turns, present).mapInArrow(digest, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): ``turns`` damaged by crc32(``conv_id:turn``) % 20, in which nulls are one blank.

    0 takes the row away (it stays as not present), 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it the user's.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    rows = turns.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), how.alias("how"))
    text = F.when(F.col("how") == 1, F.lit("")).when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("how") == 4, F.lit("user")).otherwise(F.col("role")))
    copies = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", (F.col("how") != 0).alias("present"), copies.alias("copy")).drop("copy")
