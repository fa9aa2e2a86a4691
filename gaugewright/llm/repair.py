"""Repair of conversation structure by weighted CYK parsing of intervals.

A conversation is well formed if the initials of its roles spell `(s?(ua)+)?`. The states of that pattern are: nothing
yet, after s, after u, after a. The repair grammar has a symbol [p,q] for every pair of states, which derives the rows
that lead from p to q, and is in Chomsky normal form: [p,q] -> [p,r] [r,q], and [p,q] -> one row under one edit. Edits
cost: keep 0, change the role to user or assistant 1, delete 2, insert an empty turn of user or assistant 5; a
truncated row that isn't deleted adds 5; blank and repeated rows must be deleted.

A cell of a span holds for each symbol the least (cost, audit), where the audit spells the edits (K, R, D, I) in order.
Insertions enter by closure: the symbols over no row at all, and one-row cells with insertions on both sides. Cells are
combined bottom-up by span length. As [p,q] -> [p,r] [r,q] holds for every cut of a span with the same result (the
least of all ways from p over r to q, however bracketed), one cut of each span suffices, and only spans of 1, 2, 4, ...
rows are filled: n - 1 combinations instead of n cubed. Equal costs with unequal audits are told apart by their first
unequal letter, since two audits of a span of which one begins the other differ by insertions and so in cost; so least
cells give the least whole. Audit and rows fix the repaired roles, so the least audit leaves no choice.

Spark deals conversations to tasks by their id and sorts them on the JVM side; a task takes them row by row. What it
holds of a conversation is one block of rows with their spans, for each state the way there (audit, digest of the
repaired text so far), and a short digest of each turn seen. So a long conversation needs no memory for its texts; it
stays in one task, because the digest of its repaired text can only be taken in order.

Results: rows are taken by turn (nulls first), then role, then text. Null roles and texts count as one space. Rows with
a null conversation id are one conversation. An empty role has no initial, so its row is changed or deleted. Every id
gives one row, those whose rows are all lost too; an empty table gives an empty table. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.llm.common import checksum, enter

BLOCK = 256  # rows whose spans are held at a time,
LONG = 1 << 20  # or fewer of so many characters together

# Initial -> (state before, state after); states 0 nothing yet, 1 after s, 2 after u, 3 after a.
MOVES = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}
ENDS = (0, 3)
ROLES = {2: "user", 3: "assistant"}  # the role that a changed or inserted turn has, by the state after it
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL = ("su", "ua", "au")

Cell = dict[tuple[int, int], tuple[int, str]]


def least(cell: Cell, symbol: tuple[int, int], way: tuple[int, str]) -> None:
    if symbol not in cell or way < cell[symbol]:
        cell[symbol] = way


def combine(left: Cell, right: Cell) -> Cell:
    """[p,q] -> [p,r] [r,q] for a span of two neighbouring spans."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            if (way := right.get((r, q))) is not None:
                total = cost + way[0]
                have = out.get((p, q))
                if have is None or total < have[0] or total == have[0] and audit + way[1] < have[1]:
                    out[p, q] = (total, audit + way[1])
    return out


def closure() -> Cell:
    """Insertions alone: any number of them is tried until no cell gets cheaper."""
    once: Cell = {(p, p): (0, "") for p in range(4)}
    for initial in "ua":
        for p, q in MOVES[initial]:
            least(once, (p, q), (INSERT, "I"))
    cell = once
    while (longer := combine(cell, once)) != cell:
        cell = longer
    return cell


INSERTED = closure()


def one_row(initial: str, must_go: bool, truncated: bool) -> Cell:
    """The cell of one row, insertions before and after it included."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if not must_go:
        more = TRUNCATED if truncated else 0
        for p, q in MOVES.get(initial, []):
            least(cell, (p, q), (KEEP + more, "K"))
        for p, q in MOVES["u"] + MOVES["a"]:
            least(cell, (p, q), (REROLE + more, "R"))
    return combine(combine(INSERTED, cell), INSERTED)


#: There are few kinds of rows, so their cells are made once.
ROW_CELLS = {
    (initial, must_go, truncated): one_row(initial, must_go, truncated)
    for initial in ("s", "u", "a", "") for must_go in (False, True) for truncated in (False, True)
}


def parse(cells: list[Cell]) -> Cell:
    """The cell of a whole span, bottom-up by span length."""
    if not cells:
        return INSERTED
    while len(cells) > 1:
        cells = [combine(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def repaired(audit: str, state: int, rows: list[tuple[str, str]]) -> Iterator[str]:
    """The lines `role:text` that an audit makes of the rows, from a state on."""
    at = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(at)
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES[state := 3 if state == 2 else 2]
        else:
            state = next(q for p, q in MOVES[role[0]] if p == state)
        yield f"{role}:{text}"


class Conversation:
    """What is known of a conversation after some of its rows."""

    def __init__(self):
        # For each state: cost, audit, digest of the repaired lines so far (None while there are none).
        self.ways: dict[int, tuple] = {0: (0, "", None)}
        self.rows: list[tuple[str, str]] = []
        self.cells: list[Cell] = []
        self.size = 0
        self.seen: set[bytes] = set()
        self.before: str | None = None
        self.low = self.high = None
        self.n_turns = self.n_blank = self.n_duplicate = self.n_truncated = self.n_illegal = 0

    def add(self, turn: int | None, role: str, text: str, last: str) -> None:
        """A row; `last` is the text's last character that isn't white space, or empty."""
        if turn is not None:
            self.n_turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        whole = f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")
        key = hashlib.blake2b(whole, digest_size=16).digest()
        blank, duplicate = not last, key in self.seen
        truncated = not blank and not duplicate and last not in ".!?"
        self.seen.add(key)
        self.n_blank += blank
        self.n_duplicate += duplicate and not blank
        self.n_truncated += truncated
        initial = role[:1]
        if self.before is not None:
            self.n_illegal += self.before + initial not in LEGAL
        self.before = initial
        self.rows.append((role, text))
        self.cells.append(ROW_CELLS[initial if initial and initial in "sua" else "", blank or duplicate, truncated])
        self.size += len(text)
        if len(self.rows) >= BLOCK or self.size >= LONG:
            self.advance()

    def advance(self) -> None:
        """Leads the ways over the rows of a block, whose spans are then dropped."""
        cell = parse(self.cells)
        ways: dict[int, tuple] = {}
        for p, (cost, audit, _) in self.ways.items():
            for q in range(4):
                if (p, q) in cell:
                    more, edits = cell[p, q]
                    way = (cost + more, audit + edits, p, edits)
                    if q not in ways or way[:2] < ways[q][:2]:
                        ways[q] = way
        found = {}
        for q, (cost, audit, p, edits) in ways.items():
            digest = self.ways[p][2]
            digest = digest and digest.copy()
            for line in repaired(edits, p, self.rows):
                if digest is None:
                    digest = hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.encode("utf-8", "surrogatepass"))
            found[q] = (cost, audit, digest)
        self.ways, self.rows, self.cells, self.size = found, [], [], 0

    def result(self) -> tuple:
        if self.rows:
            self.advance()
        cost, audit, digest = min((self.ways[q] for q in ENDS if q in self.ways), key=lambda way: way[:2])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.n_turns
        sha = (digest or hashlib.sha256()).hexdigest()
        return gaps, self.n_blank, self.n_duplicate, self.n_truncated, self.n_illegal, cost, audit, sha


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows (conv_id, turn, role, text, lost) after the damage that the checksum of id and turn chooses."""
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.encode(F.concat(spaced(conv_id), F.lit(":"), spaced(turn)), "UTF-8")) % 20
    return rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), spaced("role").alias("role"),
                       spaced("text").alias("text"), kind.alias("kind")).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("lost"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


COLUMNS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame) -> DataFrame:
    """One row per conv_id of rows (conv_id, turn, role, text and, if any, lost): faults, cheapest edits, digest.

    Rows marked as lost only make their conversation known.
    """
    lost = F.coalesce(F.col("lost"), F.lit(False)) if "lost" in rows.columns else F.lit(False)
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    given = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *spaced, lost.alias("lost")).select(
        "conv_id", "turn", F.when(~F.col("lost"), F.col("role")).alias("role"),
        F.when(~F.col("lost"), F.col("text")).alias("text"), "lost",
    )
    # The last character that isn't white space, looked up where expressions are compiled.
    given = given.withColumn("last", F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", ""), -1, 1))
    dealt = given.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("repair")
        names = ["conv_id"] + [c.split()[0] for c in COLUMNS.split(", ")]
        now, key, out, schema = None, None, [], None

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in out], schema if i == 0 else pa.string() if i > 6 else pa.int64()) for i in range(9)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for whole in batches:
            schema = whole.column("conv_id").type
            for start in range(0, whole.num_rows, 256):
                part = whole.slice(start, 256)
                for c, turn, role, text, lost, last in zip(*(part.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "lost", "last"))):
                    if now is None or c != key:
                        if now is not None:
                            out.append((key, *now.result()))
                            if len(out) >= 512:
                                yield flush()
                        now, key = Conversation(), c
                    if not lost:
                        now.add(turn, role, text, last)
        if now is not None:
            out.append((key, *now.result()))
            yield flush()

    return dealt.mapInArrow(run, f"conv_id {kind.simpleString()}, {COLUMNS}")


def oracle() -> str:
    """The same in SQL: the four states' cheapest ways are carried from row to row by recursion."""
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    crc = checksum(key)
    moves = [(p, q, i) for i in "sua" for p, q in MOVES[i]]
    table = ", ".join(f"({p}, {q}, '{i}')" for p, q, i in moves)
    return f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS cut FROM hurt
), counted AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM numbered
), judged AS (
  SELECT *, left(role, 1) AS initial, cut = '' AS is_blank, cut <> '' AND nth > 1 AS is_duplicate,
    cut <> '' AND nth = 1 AND right(cut, 1) NOT IN ('.', '!', '?') AS is_truncated,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM counted
), faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank,
    count(*) FILTER (is_duplicate) AS duplicate, count(*) FILTER (is_truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM judged GROUP BY conv_id
), moves(p, q, initial) AS (VALUES {table}),
inserted AS (
  SELECT p, p AS q, 0 AS cost, '' AS audit, [] :: VARCHAR[] AS made FROM range(4) t(p)
  UNION ALL SELECT p, q, 5, 'I', [CASE q WHEN 2 THEN 'user:' ELSE 'assistant:' END] FROM moves WHERE initial <> 's'
  UNION ALL SELECT a.p, b.q, 10, 'II', [CASE a.q WHEN 2 THEN 'user:' ELSE 'assistant:' END, CASE b.q WHEN 2 THEN 'user:' ELSE 'assistant:' END]
    FROM moves a JOIN moves b ON a.q = b.p AND a.initial <> 's' AND b.initial <> 's'
), ways AS (
  SELECT conv_id, 0 AS i, s.q AS state, s.cost, s.audit, s.made FROM (SELECT DISTINCT conv_id FROM judged) c, inserted s WHERE s.p = 0
  UNION ALL
  SELECT conv_id, i, state, cost, audit, made FROM (
    SELECT w.conv_id, w.i + 1 AS i, s.q AS state, w.cost + e.cost + s.cost AS cost, w.audit || e.audit || s.audit AS audit,
      list_concat(list_concat(w.made, e.made), s.made) AS made,
      row_number() OVER (PARTITION BY w.conv_id, s.q ORDER BY w.cost + e.cost + s.cost, w.audit || e.audit || s.audit) AS best
    FROM ways w JOIN judged r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1,
      LATERAL (
        SELECT w.state AS q, 2 AS cost, 'D' AS audit, [] :: VARCHAR[] AS made
        UNION ALL SELECT m.q, CASE WHEN r.is_truncated THEN 5 ELSE 0 END, 'K', [r.role || ':' || r.text] FROM moves m
          WHERE m.p = w.state AND m.initial = r.initial AND NOT r.is_blank AND NOT r.is_duplicate
        UNION ALL SELECT m.q, 1 + CASE WHEN r.is_truncated THEN 5 ELSE 0 END, 'R', [CASE m.q WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text]
          FROM moves m WHERE m.p = w.state AND m.initial <> 's' AND NOT r.is_blank AND NOT r.is_duplicate
      ) e JOIN inserted s ON s.p = e.q
  ) WHERE best = 1
), chosen AS (
  SELECT w.conv_id, w.cost, w.audit, w.made FROM ways w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i
  WHERE w.state IN (0, 3) QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost, w.audit) = 1
)
SELECT o.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate,
  coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal, coalesce(c.cost, 0)::BIGINT AS cost,
  coalesce(c.audit, '') AS audit, sha256(coalesce(array_to_string(c.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM o.conv_id"""
