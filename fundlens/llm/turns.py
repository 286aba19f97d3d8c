"""Operator 12, conversation structure repair: the cheapest edits that give every conversation the
roles ``(s?(ua)+)?``, by one integer-minimum dynamic program.

Rows stand in the order of turn (null first), role and the text's hash; nulls in role and text are one
space. A row's first fault is blank, duplicate (its role and text stand earlier) or truncated. Keep
costs 0, Rerole 1, Delete 2 (the only edit of a blank or duplicate row), Insert 5; a truncated row
that stays costs 5 more.

The weight of a way through the edits is one integer: its cost above ``width`` low digits, three bits
a letter, that spell the audit from the highest digit down (D 1, I 2, K 3, R 4, as in ASCII order) and
end in zeros, so an audit that is the beginning of another comes first. An edit in front of a way adds
its cost, moves the way's digits down by one and puts its letter at the top. The least integer is then
the cheapest way, and of the cheapest the ASCII-least: nothing else decides. Nodes are (place among
the rows, inserts made there, state); the states are: nothing yet, a system turn, a user turn, an
assistant turn. At most two inserts stand at one place, since a third returns to a state it had.

Ways are computed for runs of at most ``RUN`` distinct rows, from each state to each, and runs are
joined: costs add, digits follow. Ways of the same rows and cost never continue one another, since
more inserts cost more, so the least part is part of the least whole.

Scale: narrow rows (a hash for the text) are counted, equal ones together, and range-partitioned by
conversation, turn, role and hash, so one conversation that holds a third of all rows is spread over
tasks, a run at a time. Only finished runs meet in a conversation's task. The texts are exchanged
once, beside the runs, sorted; a task streams through them, holding a conversation's audit and one
batch. That a conversation's repaired text is hashed in order by one task is in its definition.

Defined cases: a null id is a conversation; rows that share a turn are taken in the order above, equal
ones one after the other; a conversation without rows after the damage has zeros and empty strings'
digests; empty roles have no initial and break the pattern; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import write_table

RUN = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LETTERS = " DIKR"
D, I, K, R = 1, 2, 3, 4
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
INITIAL = {USER: "u", ASSISTANT: "a"}
FINAL = (START, ASSISTANT)
# first fault of a row
SOUND, BLANK, DUPLICATE, CUT = range(4)


def front(weight: int, cost: int, letters: int, n: int, width: int) -> int:
    """The way ``weight`` with ``n`` letters (a number of three bits each) and their cost before it."""
    low = weight & ((1 << width) - 1)
    return (weight >> width) + cost << width | letters << width - 3 * n | low >> 3 * n


def repeated(letter: int, n: int) -> int:
    return ((1 << 3 * n) - 1) // 7 * letter


def least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def with_inserts(ways: list[int | None], width: int) -> list[int | None]:
    """Least ways from each state with at most two inserts in front."""
    layer = ways
    for _ in range(2):
        layer = [least(ways[s], front(layer[NEXT[s][0]], INSERT, I, 1, width) if layer[NEXT[s][0]] is not None else None) for s in range(4)]
    return layer


def with_row(ways: list[int | None], initial: str, fault: int, times: int, width: int) -> list[int | None]:
    """Least ways from each state with a row, that stands ``times`` times, in front. ``fault`` is the
    first one's; the others are duplicates, or blank like it."""
    more = times - 1
    out = []
    for s in range(4):
        best = None if ways[s] is None else front(ways[s], DELETE * times, repeated(D, times), times, width)
        if fault in (SOUND, CUT):
            cost, to = DELETE * more + TRUNCATED * (fault == CUT), NEXT[s][0]
            kept = to if initial == INITIAL[to] else SYSTEM if s == START and initial == "s" else None
            if kept is not None and ways[kept] is not None:
                best = least(best, front(ways[kept], KEEP + cost, K << 3 * more | repeated(D, more), times, width))
            if ways[to] is not None:
                best = least(best, front(ways[to], REROLE + cost, R << 3 * more | repeated(D, more), times, width))
        out.append(best)
    return out


def run_ways(rows: list[tuple[str, int, int]]) -> tuple[list[list[int | None]], int]:
    """(least ways from each state to each, their width) over rows (initial, fault, times), with
    inserts before any row."""
    width = 3 * (sum(t for _, _, t in rows) + 2 * len(rows))
    to = []
    for end in range(4):
        ways = [0 if s == end else None for s in range(4)]
        for initial, fault, times in reversed(rows):
            ways = with_inserts(with_row(ways, initial, fault, times, width), width)
        to.append(ways)
    return [[to[e][s] for e in range(4)] for s in range(4)], width


def letters(digits: int, width: int) -> int:
    """Number of letters before the padding."""
    return width // 3 - ((digits & -digits).bit_length() - 1) // 3 if digits else 0


def followed(a: tuple[list, int], b: tuple[list, int]) -> tuple[list, int]:
    """The ways of two runs one after the other."""
    (one, own), (two, more) = a, b
    width = own + more
    out = [[None] * 4 for _ in range(4)]
    for s in range(4):
        for m in range(4):
            if one[s][m] is None:
                continue
            cost, digits = one[s][m] >> own, one[s][m] & ((1 << own) - 1)
            n = letters(digits, own)
            for e in range(4):
                if two[m][e] is not None:
                    tail = (two[m][e] >> more) << width | (two[m][e] & ((1 << more) - 1)) << own
                    out[s][e] = least(out[s][e], front(tail, cost, digits >> own - 3 * n, n, width))
    return out, width


def all_followed(runs: list[tuple[list, int]]) -> tuple[list, int]:
    """Neighbours are joined first, so digits are moved a logarithmic number of times."""
    while len(runs) > 1:
        runs = [followed(*runs[i:i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def finished(runs: list[tuple[list, int]]) -> tuple[int, str]:
    """(cost, audit) of the least way through all runs, with inserts after the last row."""
    last = with_inserts([0 if s in FINAL else None for s in range(4)], 6)
    table, width = all_followed([*runs, ([[w, None, None, None] for w in last], 6)])
    return read(table[START][0], width)


def solved(rows: list[tuple[str, int, int]]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation of rows (initial, fault, times)."""
    width = 3 * (sum(t for _, _, t in rows) + 2 * len(rows) + 2)
    ways = with_inserts([0 if s in FINAL else None for s in range(4)], width)
    for initial, fault, times in reversed(rows):
        ways = with_inserts(with_row(ways, initial, fault, times, width), width)
    return read(ways[START], width)


def read(weight: int, width: int) -> tuple[int, str]:
    """(cost, audit) of a weight."""
    digits = weight & ((1 << width) - 1)
    octal = format(digits, "o").rjust(width // 3, "0").rstrip("0") if digits else ""
    return weight >> width, octal.translate({ord(str(i)): c for i, c in enumerate(LETTERS)})


def as_bytes(weight: int | None) -> bytes | None:
    return None if weight is None else weight.to_bytes(weight.bit_length() // 8 + 1, "big")


BLANKS = r"\x20\x09-\x0D"


def ordered() -> list[Column]:
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def damage(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text): rows damaged by the crc32 of their conversation and turn."""
    words = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn", "role", "text")]
    kind = F.crc32(F.concat_ws(":", *words[:2])) % 20
    role, text = F.when(kind == 4, "user").otherwise(words[2]), words[3]
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0))))
    return rows.where(kind != 0).select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def narrow(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, fault, times) of the distinct rows: no texts."""
    text = F.col("text")
    marked = rows.select("conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (~text.rlike(rf"[^{BLANKS}]")).alias("blank"),
                         text.rlike(rf"[^.!?{BLANKS}][{BLANKS}]*\z").alias("cut"))
    key = ["conv", "turn", "role", "digest", "blank", "cut"]
    counted = write_table(marked.groupBy(*key).agg(F.count("*").alias("times")), "turns")
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))      # null first
    first = counted.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(when).alias("first"))
    both = counted.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    fault = (F.when(F.col("blank"), BLANK).when(~F.col("turn").eqNullSafe(F.col("first.turn")), DUPLICATE).when(F.col("cut"), CUT).otherwise(SOUND))
    return both.select("conv", "turn", "role", "digest", fault.alias("fault"), "times")


def _runs():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = ["conv", "at", "blank", "duplicate", "truncated", "cost", "audit", "ways", "width"]
        part, out, held, tables, counts, now, first = TaskContext.get().partitionId() << 32, [], [], [], [0, 0, 0], None, True

        def close(whole: bool) -> None:
            """The conversation at hand, all of it or what this task has."""
            nonlocal held, tables, counts
            found = ways = None
            if whole and not tables:
                found = solved(held)
            else:
                if held:
                    tables.append(run_ways(held))
                table, width = all_followed(tables)
                ways = ([as_bytes(w) for row in table for w in row], width)
            out.append((now, part + len(out), *counts, *(found or (None, None)), *(ways or (None, None))))
            held, tables, counts = [], [], [0, 0, 0]

        def made(rows):
            cols = list(zip(*rows)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        types, begun = None, False
        for batch in batches:
            types = types or [batch.schema.field(0).type, *[pa.int64()] * 5, pa.string(), pa.list_(pa.binary()), pa.int64()]
            for conv, role, fault, times in zip(*(c.to_pylist() for c in batch.columns)):
                if begun and conv != now:
                    close(whole=not first)           # the first may have begun in the task before
                    first = False
                now, begun = conv, True
                counts[0] += times * (fault == BLANK)
                counts[1] += times * (fault == DUPLICATE) + (times - 1) * (fault in (SOUND, CUT))
                counts[2] += fault == CUT
                held.append((role[:1], fault, times))
                if len(held) >= RUN:
                    tables.append(run_ways(held))
                    held = []
            if len(out) >= 4096:
                yield made(out)
                part, out = part + len(out), []
        if begun:
            close(whole=False)                       # the last may go on in the next task
            yield made(out)
    return run


def _finish(table: pa.Table) -> pa.Table:
    """The runs of one conversation, joined in order."""
    rows = sorted(table.to_pylist(), key=lambda r: r["at"])
    runs = []
    for r in rows:
        w = [None if x is None else int.from_bytes(x, "big") for x in r["ways"]]
        runs.append(([w[4 * i:4 * i + 4] for i in range(4)], r["width"]))
    cost, audit = finished(runs)
    sums = [sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")]
    return pa.table([table.column("conv").slice(0, 1), *([x] for x in sums), [cost], [audit]], ["conv", "blank", "duplicate", "truncated", "cost", "audit"])


def audits(rows: DataFrame) -> DataFrame:
    """(conv, blank, duplicate, truncated, cost, audit) of every conversation among rows (conv, turn,
    role, text)."""
    kind = rows.schema["conv"].dataType.simpleString()
    ranged = narrow(rows).repartitionByRange(*ordered()).sortWithinPartitions(*ordered()).select("conv", "role", "fault", "times")
    runs = write_table(ranged.mapInArrow(_runs(), f"conv {kind}, at long, blank long, duplicate long, truncated long, cost long, audit string, "
                                                      "ways array<binary>, width long"), "runs")
    schema = f"conv {kind}, blank long, duplicate long, truncated long, cost long, audit string"
    whole = runs.where("ways IS NULL").select("conv", "blank", "duplicate", "truncated", "cost", "audit")
    return whole.unionByName(runs.where("ways IS NOT NULL").groupBy("conv").applyInArrow(_finish, schema))


ROW_COLUMNS = ("kind", "conv", "turn", "role", "text", "audit", "blank", "duplicate", "truncated", "cost")


def _stream(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The conversations' rows in order, each conversation behind its audit."""
    empty = {c: F.lit(None).cast("long") for c in ("blank", "duplicate", "truncated", "cost")}
    heads = found.select(F.lit(0).alias("kind"), "conv", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"),
                         F.lit("").alias("text"), F.lit(None).cast("binary").alias("digest"), "audit", "blank", "duplicate", "truncated", "cost")
    texts = rows.select(F.lit(1).alias("kind"), "conv", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"),
                        F.lit(None).cast("string").alias("audit"), *[v.alias(k) for k, v in empty.items()])
    conv, *rest = ordered()
    return heads.unionByName(texts).repartition("conv").sortWithinPartitions(conv, "kind", *rest).select(*ROW_COLUMNS)


def edited(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(head row, None) at each conversation's beginning, then (None, (edit, turn, role, text, old
    role)) for each edit of its audit, in order."""
    audit, at, state = "", 0, START

    def inserts() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state, role = NEXT[state]
            at += 1
            yield None, ("I", None, role, "", None)

    for row in rows:
        if row[0] == 0:
            yield from inserts()
            audit, at, state = row[5], 0, START
            yield row, None
            continue
        _, _, turn, role, text, *_ = row
        yield from inserts()
        letter = audit[at]
        at += 1
        made = role
        if letter == "K":
            state = SYSTEM if state == START and role[:1] == "s" else NEXT[state][0]
        elif letter == "R":
            state, made = NEXT[state]
        yield None, (letter, turn, made, text, role)
    yield from inserts()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _repair(kind: pa.DataType, turn: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [kind, pa.int64(), pa.string(), turn, pa.string(), pa.string()]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["conv", "place", "edit", "turn", "role", "text"])

        out, conv, place = [], None, 0
        for head, edit in edited(_rows(batches)):
            if head:
                conv, place = head[1], 0
            else:
                out.append((conv, None if edit[0] == "D" else place, *edit[:4]))
                place += edit[0] != "D"
            if len(out) >= 4096:
                yield made(out)
                out = []
        if out:
            yield made(out)
    return run


def _summary(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    out, head, hashed, lines, turns, low, last, illegal, before = [], None, None, 0, 0, None, None, 0, None

    def close():
        gaps = 0 if low is None else last - low + 1 - turns
        out.append((head[1], gaps, head[6], head[7], head[8], illegal, head[9], head[5], hashed.hexdigest()))

    for new, edit in edited(_rows(batches)):
        if new:
            if head:
                close()
            head, hashed, lines, turns, low, last, illegal, before = new, hashlib.sha256(), 0, 0, None, None, 0, None
            if len(out) >= 4096:
                yield made(out)
                out = []
            continue
        letter, turn, role, text, old = edit
        if letter != "D":
            hashed.update((b"\n" if lines else b"") + f"{role}:{text}".encode())
            lines += 1
        if letter != "I":
            illegal += before is not None and before + old[:1] not in ("su", "ua", "au")
            before = old[:1]
            if turn is not None and turn != last:
                low, last, turns = turn if low is None else low, turn, turns + 1
    if head:
        close()
        yield made(out)


def standard(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text), null roles and texts one space."""
    word = {"role": role_col, "text": text_col}
    return turns.select(F.col(f"`{id_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
                        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for n, c in word.items()])


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, edit, turn, role, text): every row with its edit and, unless deleted, its place in
    the repaired conversation; inserted rows have no turn."""
    rows = standard(turns, id_col, turn_col, role_col, text_col)
    kinds = [rows.schema[c].dataType for c in ("conv", "turn")]
    schema = f"conv {kinds[0].simpleString()}, place long, edit string, turn {kinds[1].simpleString()}, role string, text string"
    return _stream(rows, audits(rows)).mapInArrow(_repair(*map(to_arrow_type, kinds)), schema)


def digest(turns: DataFrame) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    given = turns.select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    rows, kind = damage(given), given.schema["conv"].dataType
    found = audits(rows).select(F.col("conv").alias("c"), "blank", "duplicate", "truncated", "cost", "audit")
    ids = given.select("conv").distinct().join(found, F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")
    ids = ids.fillna({"audit": "", "blank": 0, "duplicate": 0, "truncated": 0, "cost": 0})
    made = _stream(rows, ids)
    arrow = to_arrow_type(kind)
    return made.mapInArrow(lambda batches: _summary(batches, arrow), f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, "
                                                                     "illegal long, cost long, audit string, repaired_sha256 string")
