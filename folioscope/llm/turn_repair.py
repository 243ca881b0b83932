"""Conversation structure repair: the cheapest edits that give ``(s?(ua)+)?`` as role initials.

A conversation is a path through a graph. Node ``(t, state)`` means that ``t`` rows are read and
says which initials may follow; arcs keep, rerole or delete a row or insert a turn, at a cost. A
pass from the end gives the cost of every node. The arcs on cheapest ways spell audits, the initials
of the edits. Those arcs are ranked by the first 1, 2, 4, ... letters of the least audit that begins
with them: a rank of twice the length is the pair of an arc's rank and the least rank where its
pointer of that length leads. Each node takes its arc of least rank, and the pointers of all lengths
lay out the path from the start.

Rows are sorted over the whole table and cut into fragments of a bounded number of rows, so one
conversation may fill many tasks. One that lies in a single fragment, as nearly all do, is repaired
where it is read. For the others, what passes from fragment to fragment is one byte a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

SPACE = "\t\n\x0b\x0c\r "
#: Costs of the edits, and of a row that stays cut off.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 40
#: States: nothing yet, after s, after u, after a. Roles: s, u, a, any other.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: The state after the one turn that may be inserted or reroled to, and its role.
NEXT, ROLE = np.array([2, 2, 3, 2]), ("user", "user", "assistant", "user")
#: Cost from each state at the end of a conversation.
AT_END = np.array([0, 2 * INSERT, INSERT, 0])
#: In ASCII order.
LETTERS = np.frombuffer(b"DIKR", dtype=np.uint8)
FAULTS = ("blank", "duplicate", "truncated")
TURNS = "array<struct<role:string,text:string>>"
SUMS = "n long, least long, most long, turns long, first string, last string, blank long, duplicate long, truncated long, illegal long"
FRAGMENT = f"conv_id long, task long, place long, alone boolean, {SUMS}, cost long, edits string, said {TURNS}, codes binary, fresh array<int>"
#: Rows of a fragment, and code points after which one ends.
MOST_ROWS, MOST_CHARS = 4096, 4_000_000


def costs(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Cost of every node, by ``[fragment, row, state]``, from the costs ``ends`` after the last row.

    ``codes`` is a table of fragments, aligned at the end: role + 4 * (1 if the row must go, 2 if it is
    cut off). A code of 255 stands before a short fragment.
    """
    n, width = codes.shape
    cost = np.empty((n, width + 1, 4), dtype=np.int64)
    cost[:, width] = ends
    for t in range(width - 1, -1, -1):
        cost[:, t] = _before(*_steps(codes[:, t], cost[:, t + 1]))
    return cost


def _steps(code: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of delete, keep and rerole from each state, given those after the row."""
    role, fault = code & 3, code >> 2
    extra = np.where(fault == 2, TRUNCATED, 0)[:, None]
    stays = np.where(fault == 1, FAR, 0)[:, None] + extra
    target = KEPT.T[role]
    keep = np.where(target >= 0, np.take_along_axis(after, np.maximum(target, 0), 1), FAR) + stays
    return after + DELETE, keep, after[:, NEXT] + REROLE + stays


def _before(delete: np.ndarray, keep: np.ndarray, rerole: np.ndarray) -> np.ndarray:
    best = np.minimum(np.minimum(delete, keep), rerole)
    u, a = best[:, AFTER_U], best[:, AFTER_A]
    best[:, AFTER_U], best[:, AFTER_A] = np.minimum(u, a + INSERT), np.minimum(a, u + INSERT)
    best[:, :AFTER_U] = np.minimum(best[:, :AFTER_U], best[:, AFTER_U, None] + INSERT)
    return best


def least_paths(codes: np.ndarray, lengths: np.ndarray, ends: np.ndarray, starts: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Cost from the start, least audit and last state of each fragment.

    ``starts`` are the states at the start; ``last`` says that the conversation ends there, so that
    turns may be inserted after the last row too.
    """
    n, width = codes.shape
    cost = costs(codes, ends)
    node = np.arange(n * (width + 1) * 4).reshape(n, width + 1, 4)
    tails, heads, letters = [], [], []

    def offer(letter: int, tail: np.ndarray, head: np.ndarray, price: np.ndarray) -> None:
        tight = price == cost.reshape(-1)[tail]
        tails.append(tail[tight])
        heads.append(head[tight])
        letters.append(np.full(len(tails[-1]), letter))

    if width:
        flat, rows, after = codes.reshape(-1), node[:, :-1], node[:, 1:]
        delete, keep, rerole = (x.reshape(n, width, 4) for x in _steps(flat, cost[:, 1:].reshape(-1, 4)))
        kept = np.maximum(KEPT.T[flat & 3].reshape(n, width, 4), 0)
        offer(1, rows, after, delete)
        offer(2, rows, rows[:, :, NEXT], cost[:, :-1][:, :, NEXT] + INSERT)
        offer(3, rows, np.take_along_axis(after, kept, 2), keep)
        offer(4, rows, after[:, :, NEXT], rerole)
    end = node[:, -1]
    offer(2, end, end[:, NEXT], np.where(last[:, None], cost[:, -1][:, NEXT] + INSERT, FAR * 4))
    ended = end[~last[:, None] | (AT_END == 0)]
    tail, head = np.concatenate([*tails, ended]), np.concatenate([*heads, ended])
    letter = np.concatenate([*letters, np.zeros(len(ended), dtype=np.int64)])

    # Arcs are ranked by the first 1, 2, 4, ... letters of the least audit that begins with them; an
    # audit that has ended comes before all others. Each node takes its arc of least rank.
    first = np.searchsorted(np.sort(tail), node.reshape(-1))
    rank, reach, jumps = letter, head, []
    while True:
        chosen = np.lexsort((rank, tail))[first]
        jumps.append(reach[chosen])
        steps = steps + steps[jumps[-2]] if jumps[1:] else (letter[chosen] > 0).astype(np.int64)
        if np.array_equal(jumps[-1][jumps[-1]], jumps[-1]):
            break
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[chosen][reach], return_inverse=True)[1].astype(np.int64)
        reach = jumps[-1][reach]
    entry = node[np.arange(n), width - lengths, starts]
    size = steps[entry]
    at, place = np.repeat(entry, size), _counted(size)
    for k, jump in enumerate(jumps):
        at = np.where((place >> k) & 1, jump[at], at)
    spelled = LETTERS[letter[chosen][at] - 1].tobytes()
    edges = np.concatenate([[0], np.cumsum(size)])
    audits = [spelled[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return cost[np.arange(n), width - lengths, starts], audits, jumps[-1][entry] % 4


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each run of the given sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def solve(pieces: list[bytes], ends: np.ndarray, starts: np.ndarray, last: np.ndarray) -> tuple[list[int], list[str], list[int]]:
    """`least_paths` of code strings, in tables of pieces of like length."""
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    order, out = np.argsort(lengths, kind="stable"), ([0] * len(pieces), [""] * len(pieces), [0] * len(pieces))
    at = 0
    while at < len(order):
        width, end = int(lengths[order[at]]), at + 1
        while end < len(order) and lengths[order[end]] <= 2 * width + 2 and (end - at + 1) * (int(lengths[order[end]]) + 1) <= 1 << 16:
            end += 1
        chosen = order[at:end]
        width = int(lengths[chosen[-1]])
        table = np.frombuffer(b"".join(pieces[i].rjust(width, b"\x03") for i in chosen.tolist()), dtype=np.uint8).reshape(len(chosen), width)
        price, audits, state = least_paths(table.astype(np.int64), lengths[chosen], ends[chosen], starts[chosen], last[chosen])
        for i, c, audit, s in zip(chosen.tolist(), price.tolist(), audits, state.tolist(), strict=True):
            out[0][i], out[1][i], out[2][i] = c, audit.decode(), s
        at = end
    return out


def applied(said: list[tuple[str, str]], audit: str, state: int = START) -> list[tuple[str, str]]:
    """The turns that the edits leave, from rows ``(role, text)`` and the state before them."""
    out, t = [], 0
    for letter in audit:
        if letter == "I":
            out.append((ROLE[state], ""))
            state = int(NEXT[state])
            continue
        role, text = said[t]
        t += 1
        if letter == "K":
            out.append((role, text))
            state = int(KEPT[state, "sua".index(role[0])])
        elif letter == "R":
            out.append((ROLE[state], text))
            state = int(NEXT[state])
    return out


class _Run:
    """Rows of one conversation in a row, up to the bounds of a fragment."""

    def __init__(self, conv):
        self.conv, self.rows, self.chars = conv, [], 0

    def add(self, turn, role: str, text: str) -> None:
        self.rows.append((turn, role, text))
        self.chars += len(text)

    def record(self) -> dict:
        """Sums over the rows, their codes, and the places of texts that are new in this run."""
        seen, codes, fresh, count = set(), bytearray(), [], dict.fromkeys(FAULTS, 0)
        illegal, before, turns = 0, None, [t for t, _, _ in self.rows if t is not None]
        for place, (_, role, text) in enumerate(self.rows):
            solid = text.rstrip(SPACE)
            fault = "" if solid else "blank"
            if not fault and (role, text) in seen:
                fault = "duplicate"
            elif not fault:
                fresh.append(place)
                seen.add((role, text))
                fault = "" if solid[-1] in ".!?" else "truncated"
            if fault:
                count[fault] += 1
            codes.append(("sua".find(role[:1]) if role[:1] in tuple("sua") else 3) + 4 * (0, 1, 1, 2)[FAULTS.index(fault) + 1 if fault else 0])
            illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
            before = role[:1]
        first, last = (self.rows[0][1][:1], self.rows[-1][1][:1]) if self.rows else (None, None)
        return {
            "conv_id": self.conv, "n": len(self.rows), "least": min(turns, default=None), "most": max(turns, default=None),
            "turns": len(set(turns)), "first": first, "last": last, **count, "illegal": illegal,
            "codes": bytes(codes), "fresh": fresh, "said": [(role, text) for _, role, text in self.rows],
        }


def _solved(records: list[dict]) -> None:
    """Repair records that are whole conversations."""
    n = len(records)
    ends, ones = np.broadcast_to(AT_END, (n, 4)), np.ones(n, dtype=bool)
    found = solve([r["codes"] for r in records], ends, np.zeros(n, dtype=np.int64), ones)
    for r, cost, audit in zip(records, found[0], found[1], strict=True):
        r |= {"cost": cost, "edits": audit, "said": applied(r["said"], audit), "codes": None, "fresh": None}


def fragments(rows: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """Runs of sorted ``conv_id, turn, role, text, gone``; those that are ``alone`` hold a conversation and are repaired.

    A run at either end of its task may go on in another task and is not alone.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place = TaskContext.get().partitionId(), 0
        run, opened, done = None, True, []  # opened: the run may have begun before

        def close(alone: bool) -> None:
            nonlocal place
            done.append(run.record() | {"task": task, "place": place, "alone": alone})
            place += 1

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")]
            for conv, turn, role, text, gone in zip(*columns, strict=True):
                if run is None or conv != run.conv:
                    if run is not None:
                        close(alone=not opened)
                        opened = False
                    run = _Run(conv)
                elif len(run.rows) >= most_rows or run.chars >= MOST_CHARS:
                    close(alone=False)
                    run, opened = _Run(conv), True
                if not gone:
                    run.add(turn, role, text)
            yield from _batches(done)
            done.clear()
        if run is not None:
            close(alone=False)
            yield from _batches(done)

    return rows.mapInArrow(work, FRAGMENT)


def _batches(records: list[dict]) -> Iterator[pa.RecordBatch]:
    types = {
        "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
        TURNS: pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])),
    }
    fields = [f.split(" ", 1) for f in FRAGMENT.split(", ")]
    for at in range(0, len(records), 1024):
        part = records[at : at + 1024]
        whole = [r for r in part if r["alone"]]
        if whole:
            _solved(whole)
        for r in part:
            r["said"] = [{"role": role, "text": text} for role, text in r["said"]]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in part], types[t]) for f, t in fields], names=[f for f, _ in fields])


def ordered(conversations: DataFrame) -> DataFrame:
    """All rows by conversation and turn, over the whole table; ties by role, text and place read."""
    rows = conversations.select("conv_id", "turn", "role", "text", "gone").withColumn("_tie", F.monotonically_increasing_id())
    keys = ["conv_id", "turn", "role", "text", "_tie"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")


def damage(conversations: DataFrame) -> DataFrame:
    """Plant faults by the CRC-32 of ``conv_id:turn``, modulo 20, and mark dropped rows as ``gone``.

    0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats
    it, 4 makes its role ``user``. Nulls are one space, in the key too; ``conv_id`` and ``turn`` stay null.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(key) % 20).alias("_kind"),
    )
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), copies.alias("_copy")).drop("_copy")


def repair(conversations: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """The repaired conversations, one row per fragment, with what was found in the whole conversation.

    Input: ``conv_id, turn, role, text`` and, if it has it, ``gone`` (a row that does not count but whose
    conversation comes out); null role and text are one space, other columns are dropped. Rows go by
    turn, null turns first, equal ones by role and text. Null ``conv_id`` is one conversation.

    Output: ``conv_id``; ``fragment``, from 0, and ``fragments``; ``edits`` (K keep, R rerole, D delete,
    I insert) and ``said`` (the turns they leave, ``role`` and ``text``) of the fragment; ``gaps``,
    ``blank``, ``duplicate``, ``truncated``, ``illegal`` and ``cost`` of the conversation. A role whose first
    letter is not s, u or a, or that is empty, is never kept. A conversation without rows has one
    fragment without edits, all counts 0. No rows give no rows.

    One conversation may hold any share of the rows: it is sorted and cut over many tasks. Its codes,
    one byte a row, meet in one task, as its letters do in the result of `digest`.
    """
    rows = conversations if "gone" in conversations.columns else conversations.withColumn("gone", F.lit(False))
    filled = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.coalesce("gone", F.lit(False)).alias("gone"),
    )
    cut = stage(fragments(ordered(filled), most_rows), "fragments")
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    result = ["conv_id", "fragment", "fragments", "gaps", *FAULTS, "illegal", "cost", "edits", "said"]
    alone = cut.where("alone").withColumn("fragment", F.lit(0).cast("long")).withColumn("fragments", F.lit(1).cast("long"))
    parts = cut.where("not alone")
    return alone.select(*(gaps if c == "gaps" else c for c in result)).unionByName(_joined_up(parts).select(*result))


def _joined_up(parts: DataFrame) -> DataFrame:
    """Repair the conversations of more than one fragment, or at the edge of a task."""
    later = _later_copies(parts)
    marked = parts.join(later, ["task", "place"], "left").select(
        "conv_id", "task", "place", *(f.split()[0] for f in SUMS.split(", ")), "codes", F.coalesce("copies", F.array().cast("array<int>")).alias("copies")
    )
    entry = F.struct("task", "place", *(c for c in marked.columns if c not in ("conv_id", "task", "place")))
    whole = marked.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("parts"))
    schema = "conv_id long, task long, place long, fragment long, fragments long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, edits string, state int"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            for conv, entries in zip(batch.column(0), batch.column(1), strict=True):
                rows = _walked(conv.as_py(), entries.as_py())
                types = [pa.string() if c == "edits" else pa.int32() if c == "state" else pa.int64() for c in names]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)], names=names)

    done = stage(whole.mapInArrow(work, schema), "walked")
    texts = parts.select("task", "place", "said").join(done, ["task", "place"])
    carried = texts.columns[3:]

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                said = [(x["role"], x["text"]) for x in row.column("said")[0].as_py()]
                left = applied(said, row.column("edits")[0].as_py(), row.column("state")[0].as_py())
                made = pa.array([[{"role": r, "text": t} for r, t in left]], turn)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in carried), made], names=[*carried, "said"])

    kept = ", ".join(f"{c} {t}" for c, t in texts.drop("task", "place", "said").dtypes)
    return texts.mapInArrow(rebuild, f"{kept}, said {TURNS}")


def _later_copies(parts: DataFrame) -> DataFrame:
    """``task, place, copies``: rows that are new in their fragment, but repeat one of an earlier fragment."""
    fresh = parts.select("conv_id", "task", "place", "said", F.explode("fresh").alias("row"))
    turn = F.get("said", F.col("row"))
    fresh = fresh.select(
        "conv_id", F.struct("task", "place", "row").alias("at"),
        F.xxhash64(turn["role"], turn["text"]).alias("h"), F.xxhash64(F.lit(1), turn["text"], turn["role"]).alias("g"),
    )
    first = fresh.groupBy("conv_id", "h", "g").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last")
    first = first.select(F.col("conv_id").alias("conv"), F.col("h").alias("fh"), F.col("g").alias("fg"), "first")
    same = fresh["conv_id"].eqNullSafe(first["conv"]) & (F.col("h") == F.col("fh")) & (F.col("g") == F.col("fg"))
    later = fresh.join(first, same).where(F.col("at") != F.col("first"))
    return later.groupBy(F.col("at.task").alias("task"), F.col("at.place").alias("place")).agg(F.collect_list("at.row").alias("copies"))


def _walked(conv, entries: list[dict]) -> list[dict]:
    """One conversation from fragment to fragment: costs from the last to the first, then paths from the first on."""
    for e in entries:
        codes = bytearray(e["codes"])
        for row in e["copies"]:
            e["duplicate"] += 1
            e["truncated"] -= codes[row] >> 2 == 2
            codes[row] = codes[row] & 3 | 4
        e["codes"] = bytes(codes)
    ends, after = [], AT_END
    for e in reversed(entries):
        ends.append(after)
        if e["codes"]:
            after = costs(np.frombuffer(e["codes"], dtype=np.uint8).astype(np.int64)[None, :], after[None, :])[0, 0]
    ends.reverse()
    total, state, turns, before, rows = {c: 0 for c in (*FAULTS, "illegal")}, START, 0, None, []
    held = [e for e in entries if e["least"] is not None]
    edge = None
    for e in held:
        turns += e["turns"] - (edge == e["least"])
        edge = e["most"]
    gaps = held[-1]["most"] - held[0]["least"] + 1 - turns if held else 0
    for number, e in enumerate(entries):
        # A fragment without rows passes its state on; turns are inserted at the start of the next or at the end.
        last = np.array([number == len(entries) - 1])
        _, audits, states = solve([e["codes"]], ends[number][None, :], np.array([state]), last)
        for c in total:
            total[c] += e[c]
        if e["n"]:
            total["illegal"] += before is not None and before + e["first"] not in ("su", "ua", "au")
            before = e["last"]
        rows.append({"conv_id": conv, "task": e["task"], "place": e["place"], "fragment": number, "fragments": len(entries), "gaps": gaps, "edits": audits[0], "state": state})
        state = states[0]
    return [r | total | {"cost": int(after[START])} for r in rows]


def digest(repaired: DataFrame) -> DataFrame:
    """Per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    The hash is that of ``role:text`` of the repaired turns with line breaks between. One of many
    fragments is hashed fragment by fragment, in order, by one task that holds one fragment at a time:
    a hash of a text can't be put together from parts.
    """
    counts = ["conv_id", "gaps", *FAULTS, "illegal", "cost"]
    lines = F.array_join(F.transform("said", lambda s: F.concat(s["role"], F.lit(":"), s["text"])), "\n")
    single = repaired.where("fragments = 1").select(*counts, F.col("edits").alias("audit"), F.sha2(lines, 256).alias("repaired_sha256"))
    schema = ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, letters, hashed, any_turn = None, [], None, False
        for batch in batches:
            for row in batch.to_pylist():
                if row["fragment"] == 0:
                    key, letters, hashed, any_turn = [row[c] for c in counts], [], hashlib.sha256(), False
                letters.append(row["edits"])
                for turn in row["said"]:
                    hashed.update((any_turn * "\n" + turn["role"] + ":" + turn["text"]).encode("utf-8", "surrogatepass"))
                    any_turn = True
                if row["fragment"] == row["fragments"] - 1:
                    values = [*key, "".join(letters), hashed.hexdigest()]
                    types = [pa.int64()] * len(counts) + [pa.string()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[*counts, "audit", "repaired_sha256"])

    many = repaired.where("fragments > 1").repartition("conv_id").sortWithinPartitions("conv_id", "fragment").mapInArrow(work, schema)
    return single.unionByName(many)
