import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import repair
from fieldloom.llm.repair import apply_edits, damaged, finished, parse, repair_reports, repaired_messages, repaired_pieces

GRAMMAR = re.compile(r"(s?(ua)+)?")
NOT_BLANK = re.compile(r"[^\x20\x09-\x0D]")


def coded(rows):
    """(role, text, fault) of rows (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        last = NOT_BLANK.findall(text)[-1:]
        fault = 1 if not last else 2 if (role, text) in seen else 3 if last[0] not in ".!?" else 0
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute(rows):
    """(cost, audit, messages) by trying all edits, with up to two inserts at each place."""
    best = None
    choices = [[("D", 4, [])] + ([] if f in (1, 2) else [("K", 3 * (f == 3), [(r, t)]), ("R", 3 + 3 * (f == 3), [("user", t)]), ("R", 3 + 3 * (f == 3), [("assistant", t)])]) for r, t, f in coded(rows)]
    inserts = [("", 0, []), *[("I", 3, [(x, "")]) for x in ("user", "assistant")], *[("II", 6, [(x, ""), (y, "")]) for x, y in (("user", "assistant"), ("assistant", "user"))]]
    for picked in itertools.product(*itertools.chain.from_iterable((inserts, c) for c in choices), inserts):
        said = [m for _, _, ms in picked for m in ms]
        if GRAMMAR.fullmatch("".join(r[:1] for r, _ in said)):
            found = (sum(c for _, c, _ in picked), "".join(a for a, _, _ in picked), said)
            best = min(best or found, found, key=lambda x: x[:2])
    return best


def damage(turns):
    out = []
    for conv, turn, role, text in turns:
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if how:
            out += [(conv, turn, "user" if how == 4 else role, "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text)] * (1 + (how == 3))
    return out


def report(rows):
    """The counts of rows (turn, role, text) in order."""
    turns = {t for t, _, _ in rows if t is not None}
    faults = [f for _, _, f in coded(rows)]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(1), faults.count(2), faults.count(3), illegal)


def conversations(rng, n, longest):
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""][: 8 if conv and conv % 9 == 0 else 5])
            text = rng.choice(["Yes.", "No", "Fine! ", "", None, " \n", "é?", "Yes.", f"Word {rng.randint(0, 9)}."])
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]) if rng.random() < 0.9 else None, role, text))
    return list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())


def ordered(rows):
    by = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(row)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in by.items()}


def test_parser_against_all_edits():
    rng = random.Random(1)
    for _ in range(150):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b.", "c", ""])) for i in range(rng.randint(0, 3))]
        cost, audit = finished(parse({0: (0, "")}, [(r[:1], f) for r, _, f in coded(rows)]))
        want = brute(rows)
        assert (cost, audit) == want[:2], rows
        assert [(r, t) for _, r, t in apply_edits(audit, [(r, t) for _, r, t in rows])] == want[2]


def test_reports_and_messages(spark):
    """Counts, costs, audits and digests; long conversations are cut into blocks and come out the same."""
    turns = conversations(random.Random(2), 60, 9)
    df = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn long, role string, text string, cost int, at string").repartition(5)
    hurt = damaged(df)
    got = {r.conv_id: tuple(r)[1:] for r in repair_reports(hurt, F.col("present")).collect()}
    want, present = ordered(damage(turns)), {t[0] for t in turns}
    assert set(got) == present and len(got) < 62
    said = {}
    for r in repaired_messages(hurt, F.col("present")).orderBy("conv_id", "at", "place").collect():
        said.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv in present:
        rows = want.get(conv, [])
        cost, audit = finished(parse({0: (0, "")}, [(r[:1], f) for r, _, f in coded(rows)]))
        messages = [(r, t) for _, r, t in apply_edits(audit, [(r, t) for _, r, t in rows])]
        assert got[conv] == (*report(rows), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest())
        assert said.get(conv, []) == messages and GRAMMAR.fullmatch("".join(r[:1] for r, _ in messages))
        if len(rows) <= 3:
            assert (cost, audit) == brute(rows)[:2]


@pytest.mark.parametrize("limit,chars,block", [(3, 4_000_000, 2), (2048, 30, 4), (0, 0, 1)])
def test_blocks_give_the_same(spark, monkeypatch, limit, chars, block):
    turns = conversations(random.Random(3), 40, 40)
    df = damaged(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3))
    whole = sorted(map(repr, repair_reports(df, F.col("present")).collect()))
    for name, value in (("LIMIT", limit), ("LIMIT_CHARS", chars), ("BLOCK", block)):
        monkeypatch.setattr(repair, name, value)
    assert sorted(map(repr, repair_reports(df, F.col("present")).collect())) == whole


def test_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair_reports(spark.createDataFrame([], schema)).count() == 0
    nothing = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    gone = spark.createDataFrame([(1, 0, "user", "Hi."), (None, None, None, None)], schema)
    assert {tuple(r) for r in repair_reports(gone, F.lit(False)).collect()} == {(1, 0, 0, 0, 0, 0, 0, "", nothing), (None, 0, 0, 0, 0, 0, 0, "", nothing)}
    long = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"{'w ' * 20} {i}.") for i in range(3000)] + [(1, None, "system", "s" * 100_000 + "!")], schema)
    (r,) = repair_reports(long).collect()
    assert (r.cost, r.audit, r.gaps) == (0, "K" * 3001, 0)
    (p,) = repaired_pieces(long.where("turn < 2")).select("conv_id", "audit").collect()
    assert tuple(p) == (1, "KK")
