import hashlib
import itertools
import random
import re
import zlib

from corpora import SF
from fundlens.llm import turns as T

BLANK = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?")


NEXT = {"0": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, audit) over rows (initial, must go, truncated), by strings, from the last row on."""
    below = None
    for i in range(len(rows), -1, -1):
        here = {}
        for inserted in (2, 1, 0):
            for state in "0sua":
                out = [(0, "")] if i == len(rows) and state in "0a" else []
                to = NEXT[state]
                if inserted < 2:
                    c, w = here[to, inserted + 1]
                    out.append((c + 5, "I" + w))
                if i < len(rows):
                    initial, gone, cut = rows[i]
                    steps = [("D", 2, state)]
                    if not gone:
                        steps.append(("R", 1 + 5 * cut, to))
                        if initial == to or (initial == "s" and state == "0"):
                            steps.append(("K", 5 * cut, initial))
                    out += [(below[after, 0][0] + cost, letter + below[after, 0][1]) for letter, cost, after in steps]
                here[state, inserted] = min(out, default=(10**9, ""))
        below = here
    return below["0", 0]


def exhaustive(rows):
    """Every edit script, judged by the pattern itself."""
    found = []
    slots = len(rows) + 1
    for edits in itertools.product("DKRr", repeat=len(rows)):            # R to user, r to assistant
        if any(gone and e != "D" for e, (_, gone, _) in zip(edits, rows)):
            continue
        for inserts in itertools.product(("", "u", "a", "ua", "au"), repeat=slots):
            roles, audit, cost = "", "", 0
            for k in range(slots):
                roles += inserts[k]
                audit += "I" * len(inserts[k])
                cost += 5 * len(inserts[k])
                if k < len(rows):
                    e, (initial, _, cut) = edits[k], rows[k]
                    audit += e.upper()
                    cost += {"D": 2, "K": 0, "R": 1, "r": 1}[e] + 5 * (cut and e != "D")
                    roles += {"D": "", "K": initial, "R": "u", "r": "a"}[e]
            if LEGAL.fullmatch(roles):
                found.append((cost, audit))
    return min(found)


def brute(rows):
    """The contract by plain loops, over rows (conv_id, turn, role, text)."""
    convs = {c: [] for c, *_ in rows}
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (t, "user" if kind == 4 else r, {1: "", 2: re.sub("[.!?]", "", x)}.get(kind, x))
        convs[c] += [row] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            last = [ch for ch in text if BLANK.match(ch)][-1:]
            faults.append("b" if not last else "d" if (role, text) in seen else "t" if last[0] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = cheapest(tuple((r[:1], f in ("b", "d"), f == "t") for (_, r, _), f in zip(own, faults)))
        state, at, lines = "0", 0, []
        for letter in audit:
            to = {"u": "user", "a": "assistant"}[NEXT[state]]
            role, text = ("", "") if letter == "I" else own[at][1:]
            at += letter != "I"
            if letter != "D":
                role = role if letter == "K" else to
                state = role[:1]
                lines.append(f"{role}:{text}")
        turns = {t for t, *_ in own if t is not None}
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
                    sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def random_rows(rng, n):
    return tuple((rng.choice("suat "), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n))


def as_runs(rows):
    return [(i, T.DUPLICATE if gone else T.CUT if cut else T.SOUND, 1) for i, gone, cut in rows]


def test_least_integer_is_the_cheapest_audit():
    rng = random.Random(1)
    for n in (0, 1, 1, 2, 2, 2, 3, 3):
        rows = random_rows(rng, n)
        assert exhaustive(rows) == cheapest(rows) == T.solved(as_runs(rows))
    for _ in range(400):
        rows = random_rows(rng, rng.randrange(0, 30))
        runs = as_runs(rows)
        cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(rng.randrange(4)))
        pieces = [runs[a:b] for a, b in zip([0, *cuts], [*cuts, len(runs)]) if a < b]
        assert cheapest(rows) == T.solved(runs) == T.finished([T.run_ways(p) for p in pieces])


def test_inserts_are_made_where_they_are_cheap(monkeypatch):
    monkeypatch.setattr(T, "INSERT", 1)
    assert T.solved(as_runs((("s", False, False), ("a", False, False)))) == (1, "KIK")
    assert T.finished([T.run_ways(as_runs((("u", False, False),)))]) == (1, "KI")


def conversations(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", "User"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            rows.append((c, t + rng.randrange(3), role, rng.choice(["Yes.", "No", " ", "Why? ", "So!\n", "", "漢字。", f"line {rng.randrange(9)}."])))
    rows += [(None, None, None, None), (None, 1, "user", "x."), (None, None, "user", None), (10**6, None, "user", "a."), (10**6, 3, None, "b."), (10**6, 2**40, "assistant", "c.")]
    rows += [(10**6 + 1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(900)] + [(10**6 + 2, 5, "user", "again.")] * 700
    return rows + rows[:40]


def test_digest_matches_brute_force(spark, monkeypatch):
    rows = conversations(random.Random(2), 250)
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema)
    want = brute(rows)
    assert rows_of(T.digest(df.repartition(5))) == want
    extra = spark.createDataFrame([r + (1,) * 5 for r in rows], schema + ", conv int, kind int, digest int, audit int, times int")
    assert rows_of(T.digest(extra)) == want
    assert T.digest(df.limit(0)).collect() == []


def test_a_conversation_over_many_tasks(spark):
    """One conversation holds most rows; ranges are small, so its runs lie in many tasks."""
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"t{t % 700}" + rng.choice([".", ""])) for t in range(3000)]
    rows += [(c, t, "user", "x.") for c in (0, 2, 3) for t in range(5)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows_of(T.digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute(rows)


def test_repaired_rows_have_the_pattern(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    damaged = T.damage(df.withColumnRenamed("conv_id", "conv"))
    by = {}
    for r in T.repair(damaged.withColumnRenamed("conv", "conv_id")).collect():
        by.setdefault(r.conv, []).append(r)
    digest = {r.conv_id: r for r in T.digest(df).collect()}
    assert set(by) <= set(digest) and set(digest) == {r.conv_id for r in df.select("conv_id").collect()}
    for c, rows in by.items():
        kept = sorted((r for r in rows if r.place is not None), key=lambda r: r.place)
        assert LEGAL.fullmatch("".join(r.role[:1] for r in kept))
        text = "\n".join(f"{r.role}:{r.text}" for r in kept)
        assert hashlib.sha256(text.encode()).hexdigest() == digest[c].repaired_sha256
        assert sorted(r.edit for r in rows) == sorted(digest[c].audit)
