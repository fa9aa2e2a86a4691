import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from gaugewright.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit string, k long, copy string"
SHAPE = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """All edits of a few rows, cheapest first: (cost, audit, lines). Rows are (role, text, must go, truncated)."""
    queue = [(0, "", 0, "", ())]
    while queue:
        cost, audit, at, initials, lines = heapq.heappop(queue)
        if at == len(rows) and SHAPE.match(initials):
            return cost, audit, lines
        if at < len(rows):
            role, text, gone, cut = rows[at]
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, initials, lines))
            if not gone:
                more = 5 * cut
                if role:
                    heapq.heappush(queue, (cost + more, audit + "K", at + 1, initials + role[0], lines + (f"{role}:{text}",)))
                for other in ("user", "assistant"):
                    heapq.heappush(queue, (cost + 1 + more, audit + "R", at + 1, initials + other[0], lines + (f"{other}:{text}",)))
        if audit.count("I") < len(rows) + 2:
            for other in ("user", "assistant"):
                heapq.heappush(queue, (cost + 5, audit + "I", at, initials + other[0], lines + (f"{other}:",)))
        # Beginnings that no end can mend are left out.
        queue = [q for q in queue if re.match(r"(s?(ua)*u?)?\Z", q[3])]
        heapq.heapify(queue)


def judged(rows):
    """(turn, role, text) in order -> faults and rows for `cheapest`."""
    seen, out, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        cut = text.rstrip("\t\n\x0b\x0c\r ")
        blank, again = not cut, (role, text) in seen
        short = not blank and not again and cut[-1] not in ".!?"
        seen.add((role, text))
        counts[0] += blank
        counts[1] += again and not blank
        counts[2] += short
        out.append((role, text, blank or again, short))
    return counts, out


def brute(table):
    """The contract, row by row, on (conv_id, turn, role, text)."""
    found = {}
    for c in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in [r for r in table if r[0] == c]:
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        counts, given = judged(rows)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        turns = {r[0] for r in rows} - {None}
        cost, audit, lines = cheapest(given)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        found[c] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def result(rows):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows.collect()}


def test_like_all_edits(spark):
    rng = random.Random(2)
    texts = ["a.", "b!", "c", "d?", "", " \t", "e. ", "f.\n", None, "A .. b", "same."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "agent"]
    table = [(c, t if rng.random() < 0.9 else None, rng.choice(roles[:5] if c % 2 else roles), rng.choice(texts) if c % 3 else f"t{t}.")
             for c in range(160) for t in rng.sample(range(12), rng.randrange(1, 6))]
    table += [(None, 1, "user", "x."), (None, None, None, None), (-7, -3, "user", "y."), (-7, -3, "user", "y."), (9000, None, "system", "z")]
    found = result(repair.repair(repair.damage(spark.createDataFrame([(*r, "x", "y", 1, "z") for r in table], SCHEMA))))
    assert found == brute(table)


def test_all_rows_lost(spark):
    lost = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "x.")], "conv_id long, turn long, role string, text string")
    assert result(repair.repair(repair.damage(df))) == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert repair.repair(repair.damage(df.limit(0))).collect() == []


def test_spans_in_blocks_give_the_same(spark, monkeypatch):
    """A conversation longer than a block, against one pass over its rows."""
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", f"n{t}.", f"m{t}!"])) for t in range(3000)]
    whole, blocks = repair.Conversation(), repair.Conversation()
    for _, turn, role, text in rows:
        whole.add(turn, role, text, text[-1:])
        blocks.add(turn, role, text, text[-1:])
        if turn % 7 == 3:
            blocks.advance()
    found = whole.result()
    assert blocks.result() == found
    counts, given = judged([(t, r, x) for _, t, r, x in rows])
    assert list(found[1:4]) == counts
    # Least costs alone by a plain table over states.
    best = {0: 0, 2: 5, 3: 10}
    for role, _, gone, cut in given:
        nxt = {}
        for p, cost in best.items():
            nxt[p] = min(nxt.get(p, 10**9), cost + 2)
            if not gone:
                for q in ("u", "a", "s"):
                    for a, b in repair.MOVES[q]:
                        if a == p and (q == role[0] or q != "s"):
                            nxt[b] = min(nxt.get(b, 10**9), cost + 5 * cut + (q != role[0]))
        for p, q in [(0, 2), (1, 2), (3, 2), (2, 3), (0, 2), (1, 2), (3, 2)]:
            if p in nxt:
                nxt[q] = min(nxt.get(q, 10**9), nxt[p] + 5)
        best = nxt
    assert found[5] == min(best.get(0, 10**9), best.get(3, 10**9))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert result(repair.repair(df))[1] == found


def test_every_cut_of_a_span_gives_the_same_cell():
    """Full CYK over all spans and cuts, against the dyadic spans that the operator fills."""
    rng = random.Random(4)
    kinds = list(repair.ROW_CELLS)
    for _ in range(30):
        cells = [repair.ROW_CELLS[rng.choice(kinds)] for _ in range(rng.randrange(1, 10))]
        table = {(i, i + 1): c for i, c in enumerate(cells)}
        for length in range(2, len(cells) + 1):
            for i in range(len(cells) - length + 1):
                ways = [repair.combine(table[i, j], table[j, i + length]) for j in range(i + 1, i + length)]
                assert all(w == ways[0] for w in ways)
                table[i, i + length] = ways[0]
        assert repair.parse(cells) == table[0, len(cells)]


@pytest.mark.parametrize("state", range(4))
def test_insertions_alone(state):
    assert repair.INSERTED[state, state] == (0, "")
