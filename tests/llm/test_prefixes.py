import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from gaugewright.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, head string, k long, size string, n string"


def brute(table):
    """The contract on (conv_id, turn, role, text): every prefix is a key."""
    given = defaultdict(list)
    for c, turn, role, text in table:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            given[c].append(((turn is not None, turn or 0, key), role, text))
    turns = {c: [(r, t) for _, r, t in sorted(rows)] for c, rows in given.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, rows in whole.items():
        for d in range(len(rows) + 1):
            members[rows[:d]].append(c)
    saves = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in members.items()}
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[q] for q in children[p]]
        sums[p] = (sum(b[0] for b in below) or 1, saves[p] + sum(b[1] for b in below))
        ends = ",".join(map(str, sorted(c for c in members[p] if whole[c] == p)))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), parent, len(members[p]), len(children[p]), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def conversations(seed):
    rng = random.Random(seed)
    table = []
    hot = [("user", "hello"), ("assistant", "hi"), ("user", "tell me"), ("assistant", "no")]
    for c in [*range(120), -3, -5, -6, -11, 4001]:
        rows = hot[: rng.randrange(5)] + [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é€", "", None])) for _ in range(rng.randrange(4))]
        if c % 7 == 0:
            rows = hot * 4
        table += [(c, i if rng.random() < 0.95 else None, r, t) for i, (r, t) in enumerate(rows)]
    return table + [(None, 1, "user", "x"), (77, 1, "user", "again"), (77, 1, "user", "again"), (78, 1, "a", "bc"), (79, 1, "ab", "c")]


@pytest.mark.parametrize("most", [None, 0, 3, 40, 400])
def test_like_all_prefixes(spark, most):
    table = conversations(3)
    df = spark.createDataFrame([(*r, "x", 7, "y", "z") for r in table], SCHEMA).repartition(5)
    found = prefixes.nodes(prefixes.rebuilt(prefixes.sequences(df)), most)
    assert result(found) == brute(table)
    assert found.filter("depth > 0").filter("turn_id IS NULL").count() == 0


def test_many_equal_conversations(spark):
    """Thousands of members end at one node, over several blocks of ids."""
    rows = spark.range(0, 9000, 3).selectExpr("id AS conv_id", "explode(sequence(0, 2)) AS turn", "'user' AS role", "concat('t', turn) AS text")
    found = prefixes.nodes(prefixes.sequences(rows), 50).collect()
    ids = ",".join(str(i) for i in range(0, 9000, 3))
    last = max(found, key=lambda r: r["depth"])
    assert len(found) == 4 and last["ends_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
    assert [r["saved_tokens"] for r in sorted(found, key=lambda r: r["depth"])] == [2999 * 6, 2999 * 6, 2999 * 4, 2999 * 2]


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefixes.nodes(prefixes.rebuilt(prefixes.sequences(none))).collect() == []
    # Conversation 6 takes its h turns from 5, which is absent, and has no more of its own if it is short.
    table = [(6, 0, "user", "x"), (8, 0, "user", "y")]
    df = spark.createDataFrame([(*r, "", 0, "", "") for r in table], SCHEMA)
    for most in (None, 0):
        assert result(prefixes.nodes(prefixes.rebuilt(prefixes.sequences(df)), most)) == brute(table)


def test_long_shared_prefix(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(40) for t in range(120)] + [(c, 200 + t, "user", f"own {c} {t}") for c in range(40) for t in range(c % 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = prefixes.nodes(prefixes.sequences(df), 100).collect()
    assert len(found) == 121 + sum(c % 5 for c in range(40))
    root = next(r for r in found if r["depth"] == 0)
    assert root["n_leaves"] == 32 and root["saved_tokens"] == 39 * sum(len(f"same {t}") for t in range(120))
