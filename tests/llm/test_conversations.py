import hashlib
import random
import zlib

import pytest

from brandsieve.llm import conversations

WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def least(rows, faults):
    """(cost, letters, repaired lines) by relaxing suffixes: the plainest form of the edits."""
    states = ["", "s", "u", "a"]

    def after(q, c):
        return {"s": "s" if q == "" else None, "u": "u" if q != "u" else None, "a": "a" if q == "u" else None}.get(c)

    best = {q: (0, "", []) for q in ("", "a")}
    for at in range(len(rows), -1, -1):
        if at < len(rows):
            _, _, role, text = rows[at]
            now = {}
            for q in states:
                options = []
                if q in best:
                    c, w, lines = best[q]
                    options.append((c + 3, "D" + w, lines))
                if faults[at] not in ("b", "d"):
                    cut = faults[at] == "t"
                    t = after(q, role[:1])
                    if t in best and t is not None:
                        c, w, lines = best[t]
                        options.append((c + cut, "K" + w, [f"{role}:{text}", *lines]))
                    t = "a" if q == "u" else "u"
                    if t in best:
                        c, w, lines = best[t]
                        options.append((c + 2 + cut, "R" + w, [f"{'assistant' if t == 'a' else 'user'}:{text}", *lines]))
                if options:
                    now[q] = min(options, key=lambda o: o[:2])
            best = now
        for _ in range(4):
            for q in states:
                t = "a" if q == "u" else "u"
                if t in best:
                    c, w, lines = best[t]
                    option = (c + 2, "I" + w, [f"{'assistant' if t == 'a' else 'user'}:", *lines])
                    if q not in best or option[:2] < best[q][:2]:
                        best[q] = option
    return best[""]


def brute_force(rows):
    out = {}
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], conv_hash(r[3]), r[3]))
        seen, faults = set(), []
        for r in own:
            text = r[3].rstrip(WHITE)
            faults.append("b" if not text else "d" if r[2:] in seen else "t" if text[-1] not in ".!?" else "")
            seen.add(r[2:])
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = least(own, faults)
        counts = tuple(faults.count(k) for k in "bdt")
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conv_hash(text):
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) * (h >> 63)


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def results(df):
    rows = df.collect()
    found = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    texts = ["Yes.", "No!", "Why?", "cut off", " ", "", None, "one. two", "Well.  \n", "a.b!c?", "é"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "User", "a"]
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randrange(1, 9)):
            if rng.random() < 0.9:
                rows.append((conv, rng.choice([turn, turn, turn, None, 0]), rng.choice(roles), rng.choice(texts)))
    rows += [(500, n, rng.choice(roles[:6]), rng.choice([*texts, f"text {n}."])) for n in range(700)]  # longer than a segment in the second test
    rows += [(501, 3, "user", "the same.")] * 300
    rows += [(502, t, r, "long " * 50_000 + "end.") for t, r in ((1, "user"), (2, "assistant"))]
    schema = "conv_id long, turn long, role string, text string, key string, n long, part string"
    return rows, spark.createDataFrame([(*r, "k", 7, "p") for r in rows], schema)


def same(found, expected):
    return {k: (found.get(k), v) for k, v in expected.items() if found.get(k) != v} == {} and found.keys() == expected.keys()


@pytest.mark.parametrize(("segment", "partitions"), [(1024, 2), (40, 7), (5, 4)])
def test_repair_matches_brute_force(spark, table, segment, partitions):
    rows, df = table
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = results(conversations.repair(df, segment))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = brute_force(rows)
    assert not {k: (found.get(k), v) for k, v in expected.items() if found.get(k) != v}
    assert found.keys() == expected.keys()


def test_empty_and_dropped(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversations.repair(spark.createDataFrame([], schema)).count() == 0
    gone = next(n for n in range(1000) if zlib.crc32(f"{n}:1".encode()) % 20 == 0)
    found = results(conversations.repair(spark.createDataFrame([(gone, 1, "user", "Hi.")], schema)))
    assert found == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert results(conversations.repair(df)) == brute_force(rows)


def test_prices_do_not_depend_on_the_block(monkeypatch):
    rng = random.Random(8)
    steps = tuple((rng.choice(["s", "u", "a", "x", "d"]), 1, rng.random() < 0.2) for _ in range(90))
    costs, letters = [], []
    for size in (1, 7, 200):
        monkeypatch.setattr(conversations, "BLOCK", size)
        costs.append(conversations.entry_costs(steps, conversations.ENDS, True))
        letters.append(conversations.trace(steps, conversations.ENDS, True, (conversations.NONE,)))
    assert len(set(costs)) == len(set(letters)) == 1
