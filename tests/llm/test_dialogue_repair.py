"""Conversation repair against a plain dynamic program over all audits, and by exhaustive search."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from foliospark.llm import dialogue_repair as m

COLUMNS = ["conv_id", "turn", "role", "text", "gone", "fault"]
SCHEMA = "conv_id long, turn long, role string, text string, gone string, fault string"
WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        if kind:
            out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """(cost, audit) by relaxing (cost, audit) labels row by row: insertions are closed under three rounds."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    labels = {"": (0, "")}

    def insert(labels):
        for _ in range(4):
            for state, (cost, audit) in list(labels.items()):
                for to in step[state]:
                    if to != "s" and (cost + 5, audit + "I") < labels.get(to, (1e9, "")):
                        labels[to] = (cost + 5, audit + "I")
        return labels

    labels = insert(labels)
    for (_, _, role, _), kind in zip(rows, kinds):
        after = {}
        for state, (cost, audit) in labels.items():
            ways = [(state, cost + 2, audit + "D")]
            if kind not in ("blank", "duplicate"):
                more = 5 * (kind == "truncated")
                ways += [(to, cost + more, audit + "K") for to in step[state] if role[:1] == to]
                ways += [(to, cost + 1 + more, audit + "R") for to in step[state] if to != "s"]
            for to, c, a in ways:
                after[to] = min(after.get(to, (1e9, "")), (c, a))
        labels = insert(after)
    return min(labels[s] for s in ("", "a") if s in labels)


def lines(rows, audit):
    out, state, rest = [], "", iter(rows)
    for letter in audit:
        row = next(rest) if letter != "I" else None
        if letter == "D":
            continue
        name = "assistant" if state == "u" else "user"
        if letter == "K":
            state = row[2][0]
            out.append(f"{row[2]}:{row[3]}")
        else:
            state = name[0]
            out.append(f"{name}:{row[3] if row else ''}")
    return out


def brute(rows):
    out = {}
    kept = {}
    for row in rows:
        kept.setdefault(row[0], [])
    for row in damage(rows):
        kept[row[0]].append(row)
    for conv, own in kept.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2][:64], r[3][:64], m_hash(r)))
        kinds = faults(own)
        turns = {r[1] for r in own if r[1] is not None}
        cost, audit = cheapest(own, kinds)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
            sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])), cost, audit,
            hashlib.sha256("\n".join(lines(own, audit)).encode()).hexdigest(),
        )
    return out


def m_hash(row):
    conv, _, role, text = row
    return hashlib.sha256(f"{'true' if conv is None else 'false'}:{'' if conv is None else conv}:{len(role)}:{role}:{text}".encode()).digest()


def got(frame):
    rows = frame.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_search_against_all_audits():
    """Every audit with at most two insertions, tried one by one."""
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice(["s", "u", "a", "x", ""]), rng.randrange(4)) for _ in range(rng.randrange(4))]
        found = []
        for n in range(3 if len(rows) < 3 else 2):
            for places in itertools.product(range(len(rows) + 1), repeat=n):
                for letters in itertools.product("KRD", repeat=len(rows)):
                    text = "".join("I" * places.count(i) + (letters[i] if i < len(rows) else "") for i in range(len(rows) + 1))
                    cost, roles, ok, at = 5 * n, "", True, 0
                    for letter in text:
                        wanted = "a" if roles[-1:] == "u" else "u"
                        if letter == "I":
                            roles += wanted
                            continue
                        role, fault = rows[at]
                        at += 1
                        if letter == "D":
                            cost += 2
                            continue
                        ok = ok and fault not in (m.BLANK, m.DUPLICATE)
                        cost += (letter == "R") + 5 * (fault == m.TRUNCATED)
                        roles += (role or "-") if letter == "K" else wanted
                    if ok and re.fullmatch("(s?(ua)+)?", roles):
                        found.append((cost, text))
        assert m.search(rows, m.START, m.ENDS) == min(found)


def test_search_against_dynamic_program():
    rng = random.Random(4)
    names = {m.SOUND: "", m.BLANK: "blank", m.DUPLICATE: "duplicate", m.TRUNCATED: "truncated"}
    for _ in range(2000):
        rows = [(rng.choice("suauauax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(25))]
        want = cheapest([(0, 0, r, "") for r, _ in rows], [names[f] for _, f in rows])
        assert m.search(rows, m.START, m.ENDS) == want


ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello!"), (1, 2, "assistant", "Hello!"), (1, None, "user", "Hi."), (2, 5, None, None),
    (2, 5, "user", " \t\x0b"), (3, 1, "", "Yes."), (3, 2, "User", "No"), (3, 9, "user", "Ends with a non-breaking space. "), (None, None, None, "Why?"),
    (None, 1, "assistant", "So. "), (None, 7, "user", "x" * 90 + "a."), (None, 7, "user", "x" * 90 + "b."), (4, -3, "assistant", "A."), (4, 9, "assistant", "B.\n"),
    (5, 1, "tool", "{}"), (5, 2, "user", "ä" * 3000 + "."), (6, -(1 << 62), "user", "a."), (6, 1 << 62, "assistant", "b."),
]


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_odd_rows(spark, block):
    want = brute(ODD)
    for conv, row in got(m.repair(m.damaged(table(spark, ODD).repartition(3)), block)).items():
        gaps = want[conv][0] if want[conv][0] < 1 << 63 else None
        assert row == (gaps, *want[conv][1:]), conv
    assert set(want) == {r[0] for r in ODD}


def test_conversation_without_rows(spark):
    rows = [(i, 0, "user", "a.") for i in range(200)]
    out = got(m.repair(m.damaged(table(spark, rows))))
    assert out == brute(rows)
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in out.values()


def test_empty_table(spark):
    frame = m.repair(m.damaged(table(spark, [])))
    assert frame.collect() == []
    assert frame.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("block", [7, 100])
def test_one_conversation_with_a_third_of_the_rows(spark, block):
    rng = random.Random(8)
    texts = ["Yes.", "No!", "", "cut", "Why?", " ", "So it is."]
    rows = [(0, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(texts) if t % 3 else f"text {t}.") for t in range(900)]
    rows += [(1 + i // 4, i % 4, ("user", "assistant")[i % 2], rng.choice(texts) + str(i)[-1:] * (i % 2) + ".") for i in range(1800)]
    rows += [(7, 1, "user", "again.")] * 300  # one row many times
    assert got(m.repair(m.damaged(table(spark, rows).repartition(9)), block)) == brute(rows)


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(m.op13_dialogue(spark, small)) == brute(rows)
