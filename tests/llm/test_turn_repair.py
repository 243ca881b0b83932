"""Conversation repair against a search over all edits, in one piece and over many fragments."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from folioscope.llm import turn_repair as tr

TALK = "conv_id long, turn long, role string, text string, edits string, fragment int, h long"
LEGAL = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    """``(conv, turn, role, text)`` after damage; and all conversations."""
    out, convs = [], {}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for row in out:
        convs[row[0]].append(row[1:])
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, v in convs.items()}


def expected(turns):
    """Cheapest edits by a search over (cost, audit): the first complete way that comes out is the least."""
    faults, seen = [], set()
    for _, role, text in turns:
        solid = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        faults.append(fault)
        seen.add((role, text))
    best, heap, done = None, [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, t, state, said = heapq.heappop(heap)
        if t == len(turns) and state in ("", "a"):
            best = cost, audit, said
            break
        if (t, state) in done:
            continue
        done.add((t, state))
        legal = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for role in ("user", "assistant"):
            if role[0] in legal:
                heapq.heappush(heap, (cost + 3, audit + "I", t, role[0], (*said, (role, ""))))
        if t < len(turns):
            _, role, text = turns[t]
            heapq.heappush(heap, (cost + 4, audit + "D", t + 1, state, said))
            if faults[t] not in ("blank", "duplicate"):
                extra = 3 * (faults[t] == "truncated")
                if role and role[0] in legal:
                    heapq.heappush(heap, (cost + extra, audit + "K", t + 1, role[0], (*said, (role, text))))
                for other in ("user", "assistant"):
                    if other[0] in legal:
                        heapq.heappush(heap, (cost + extra + 3, audit + "R", t + 1, other[0], (*said, (other, text))))
    cost, audit, said = best
    assert LEGAL.fullmatch("".join(r[0] for r, _ in said))
    numbers = {t for t, _, _ in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns[:-1], turns[1:])]
    whole = "\n".join(f"{r}:{t}" for r, t in said)
    return (gaps, *(faults.count(f) for f in tr.FAULTS), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(whole.encode()).hexdigest())


def talk(seed, convs, longest):
    r = random.Random(seed)
    rows = []
    for conv in range(convs):
        texts = ["Yes.", "no", "What?", "  ", "", "a\n", "end! \n", f"own {conv}."]
        for turn in range(r.randrange(1, longest)):
            number = r.choice([turn, turn, turn, turn, turn + 3, None])
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv if conv else None, number, role, r.choice(texts) if r.random() < 0.5 else f"text {turn} {r.choice(['.', '', '?'])}"))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "e", 1, 2) for r in rows], TALK)


def digests(conversations, **options):
    rows = tr.digest(tr.repair(conversations, **options)).collect()
    assert len({x.conv_id for x in rows}) == len(rows)
    return {x.conv_id: tuple(x)[1:] for x in rows}


@pytest.mark.parametrize("most_rows", [tr.MOST_ROWS, 3, 1])
def test_repair_by_search(spark, most_rows):
    rows = talk(most_rows, 120, 14)
    got = digests(tr.damage(table(spark, rows)), most_rows=most_rows)
    assert got == {c: expected(t) for c, t in damaged(rows).items()}


def test_one_conversation_over_many_tasks(spark):
    rows = talk(6, 3, 8) + [(77, k, random.Random(k).choice(["user", "assistant", "system"]), f"t{k % 90}{'.' * (k % 3)}") for k in range(1500)]
    rows += [(78, None, "user", "the same.")] * 300
    got = digests(tr.damage(table(spark, rows)), most_rows=64)
    assert got == {c: expected(t) for c, t in damaged(rows).items()}
    repaired = tr.repair(tr.damage(table(spark, rows)), most_rows=64)
    sizes = {x.conv_id: x.n for x in repaired.groupBy("conv_id").count().withColumnRenamed("count", "n").collect()}
    assert sizes[77] >= 20 and sizes[78] >= 4


def test_awkward_conversations(spark):
    rows = [
        (None, 0, "user", "a."), (None, None, None, None), (1, 5, "assistant", "b"), (1, 5, "assistant", "b"), (1, 9, "system", "c!"),
        (2, 0, "user", "x" * 50_000 + "."), (2, 1, "assistant", "y?"), (3, None, "", "z."), (4, 0, "user", ""),
    ]
    plain = tr.repair(table(spark, rows))
    got = digests(table(spark, rows))
    ordered = {}
    for conv, turn, role, text in rows:
        ordered.setdefault(conv, []).append((turn, role if role is not None else " ", text if text is not None else " "))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    assert got == {c: expected(sorted(t, key=key)) for c, t in ordered.items()}
    assert plain.columns == ["conv_id", "fragment", "fragments", "gaps", *tr.FAULTS, "illegal", "cost", "edits", "said"]
    assert [[tuple(s) for s in x.said] for x in plain.where("conv_id = 2").collect()] == [[("user", "x" * 50_000 + "."), ("assistant", "y?")]]
    gone = table(spark, rows).selectExpr("conv_id", "turn", "role", "text", "true as gone")
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert digests(gone) == {c: empty for c in (None, 1, 2, 3, 4)}
    assert digests(table(spark, []) if rows is None else table(spark, rows).limit(0)) == {}


def test_least_of_all_cheapest_audits():
    """Every audit of the least cost, listed: the one taken is the ASCII-least."""
    r = random.Random(2)

    def all_audits(codes, t, state, left):
        if left < 0:
            return
        if t == len(codes):
            if state in (0, 3) and left == 0:
                yield ""
        else:
            role, fault = codes[t] & 3, codes[t] >> 2
            extra = 3 * (fault == 2)
            yield from ("D" + x for x in all_audits(codes, t + 1, state, left - 4))
            if fault != 1:
                if tr.KEPT[state, role] >= 0:
                    yield from ("K" + x for x in all_audits(codes, t + 1, int(tr.KEPT[state, role]), left - extra))
                yield from ("R" + x for x in all_audits(codes, t + 1, int(tr.NEXT[state]), left - extra - 3))
        if left >= 3:
            yield from ("I" + x for x in all_audits(codes, t, int(tr.NEXT[state]), left - 3))

    pieces = [bytes(r.choice([0, 1, 2, 3, 5, 6, 8, 9, 10]) for _ in range(r.randrange(0, 7))) for _ in range(60)]
    found = tr.solve(pieces, np.broadcast_to(tr.AT_END, (60, 4)), np.zeros(60, dtype=np.int64), np.ones(60, dtype=bool))
    for codes, cost, audit in zip(pieces, found[0], found[1]):
        audits = sorted(all_audits(codes, 0, 0, cost))
        assert audits[0] == audit and not any(list(all_audits(codes, 0, 0, c)) for c in range(cost))
