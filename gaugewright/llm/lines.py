"""Line dedup: of equal and nearly equal lines only the earliest stays.

A line is its sequence of words (runs of anything but white space); two lines are near when at most one word must be
inserted, dropped or replaced, and the shorter one has `least` words or more. Shorter lines go only when equal. A line
goes if any earlier line is equal or near to it, whether or not that one stays itself; blank lines always stay.

Method: equal lines are counted as one by two hashes. Near lines share the first or the last half of their words, so
only lines whose half occurs in another line go on (an exact filter). These emit a hashed key for every variant with
one word deleted, and one for themselves; lines meet where the keys are equal, each with the earliest of its group
only, so a group of any size costs one row per line and no pairs. The pair with that earliest line is then verified
word by word.

With `per`, the bound grows: one word for every `per` words of the shorter line, one at least. So many edits of a line
of 2 `per` words or more leave a run of words whole; of every such run the least hash of its word sequences is a key, so
near lines share one (an exact filter). Lines meet where keys are equal: each with the earliest of its keys first, then
those that are still there with all earlier lines of their keys. Pairs are verified by their word edit distance (up to
a million different words in what the two don't have in common at their ends).

Earliest is by key (nulls last), then the hash of the text, then the line's place. Rows that repeat key and text count
as one document and share one fate. A null text is an empty one. Empty tables give empty results; other columns pass
through, columns named like the added ones are replaced. Everything is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.session import materialize

#: Rows of a small table that may be sent to every task; beyond, both sides are shuffled.
SENT = 400_000


#: Anything in a line but white space.
FILLED = r"[^ \t\x0B\f\r]"


def words(line: Column) -> Column:
    return F.array_remove(F.split(line, r"[ \t\x0B\f\r]+"), "")


def sent_if_small(df: DataFrame, rows: float) -> DataFrame:
    return F.broadcast(df) if rows <= SENT else df


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line that isn't blank: its document (_none, _key, _text), its place and the line."""
    own = docs.select(
        F.col(key).isNull().alias("_none"), F.col(key).alias("_key"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("_text"),
        F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("_pos", "_line"),
    )
    return own.filter(F.col("_line").rlike(FILLED))


def halves(n: Column) -> Column:
    """Keys of a line's first and last halves, in both lengths that a line of one word more or less may have."""
    def part(mark: str, size: Column, words_of: Column) -> Column:
        return F.xxhash64(F.lit(mark), size, words_of)

    low, mid, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int"), F.floor((n + 1) / 2).cast("int")
    firsts = [part("first", m, F.slice("_w", F.lit(1), m)) for m in (low, mid)]
    lasts = [part("last", m, F.slice("_w", n - m + 1, m)) for m in (mid, high)]
    return F.array_distinct(F.array(*firsts, *lasts))


def distinct_lines(rows: DataFrame, least: int) -> DataFrame:
    """One row per distinct line: _h, _h2, _first (place of the earliest), _n words, _halves for lines long enough."""
    n = F.size("_w")
    keyed = rows.withColumn("_w", words(F.col("_line"))).select(
        F.xxhash64("_w").alias("_h"), F.xxhash64(F.lit(7), "_w").alias("_h2"),
        F.struct("_none", "_key", "_text", "_pos").alias("_at"), n.alias("_n"),
        F.when(n >= least, halves(n)).alias("_halves"),
    )
    return keyed.groupBy("_h", "_h2").agg(
        F.min("_at").alias("_first"), F.first("_n").alias("_n"), F.first("_halves").alias("_halves")
    )


def candidates(lines: DataFrame) -> DataFrame:
    """Lines that share a half with another line."""
    keys = lines.filter(F.col("_halves").isNotNull()).select("_h", "_h2", "_first", F.explode("_halves").alias("_half"))
    shared = keys.groupBy("_half").agg(F.count("*").alias("_c")).filter("_c > 1").select("_half")
    return keys.join(shared, "_half", "left_semi").groupBy("_h", "_h2").agg(F.first("_first").alias("_first"))


def variants(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hashed keys of every line with one word deleted (_h, _v, _gone), and of every line itself (_h, _v).

    A key combines the hashes of (word, place) by exclusive or; deleting word j leaves what stands before it and shifts
    the rest, so that running values give all variants of a line in one pass.
    """
    hashes = texts.select("_h", F.size("_w").alias("_n"), F.posexplode("_w").alias("_j", "_x")).select(
        "_h", "_n", "_j", F.xxhash64("_x", "_j").alias("_here"), F.xxhash64("_x", F.col("_j") - 1).alias("_shifted"),
    )
    line = Window.partitionBy("_h").orderBy("_j")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    sums = hashes.select(
        "_h", "_n", "_j", "_here", F.coalesce(F.bit_xor("_here").over(before), F.lit(0)).alias("_p"),
        F.bit_xor("_shifted").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
        F.bit_xor("_shifted").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
    )
    rest = F.col("_all").bitwiseXOR(F.col("_upto"))
    deleted = sums.select(
        "_h", F.xxhash64(F.col("_p").bitwiseXOR(rest), F.col("_n") - 1).alias("_v"), F.col("_j").alias("_gone"),
    )
    whole = sums.filter(F.col("_j") == F.col("_n") - 1).select("_h", F.xxhash64(F.col("_p").bitwiseXOR(F.col("_here")), "_n").alias("_v"))
    return deleted, whole


def one_word_apart(a: Column, b: Column) -> Column:
    """Whether at most one word must be inserted, dropped or replaced: common beginning and end cover all but one."""
    shortest, longest = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))

    def common(x: Column, y: Column) -> Column:
        differs = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(differs == 0, shortest).otherwise(F.least(differs - 1, shortest))

    return (longest - shortest <= 1) & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= longest - 1)


def texts_of(rows: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """_h (of both hashes), _me (place and hashes) and words _w of the lines found (_h, _h2, _first)."""
    # The candidates' words, read where the earliest of them stand.
    place = [F.col(f"_first.{c}").alias(c) for c in ("_none", "_key", "_text", "_pos")]
    at = found.select("_h", "_h2", "_first", *place)
    same = rows.alias("r").join(
        sent_if_small(at, size).alias("c"),
        (F.col("r._pos") == F.col("c._pos")) & (F.col("r._text") == F.col("c._text")) & F.col("r._key").eqNullSafe(F.col("c._key")),
    )
    # Rows that repeat a document give their lines more than once. Lines of one hash but another second hash are told
    # apart by their place in the hash's group.
    return materialize(
        same.select("c._h", "c._h2", F.struct("c._first", "c._h", "c._h2").alias("_me"), F.col("r._line").alias("_line"))
        .groupBy("_h", "_h2").agg(F.first("_me").alias("_me"), F.first("_line").alias("_line"))
        .select(F.xxhash64("_h", "_h2").alias("_h"), "_me", words(F.col("_line")).alias("_w"))
    )


def near_lines(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """_h, _h2 of distinct lines that have an earlier near line."""
    found = materialize(candidates(lines))
    size = found.count()
    texts = texts_of(rows, found, size)
    deleted, whole = (materialize(x) for x in variants(texts))
    # Replaced: the same word place deleted leaves the same words. Only keys of several lines go on, as two numbers.
    slots = deleted.select("_h", F.xxhash64("_v", "_gone").alias("_v"))
    several = slots.groupBy("_v").agg(F.min("_h").alias("_a"), F.max("_h").alias("_b")).filter("_a <> _b").select("_v")
    slots = materialize(slots.join(several, "_v", "left_semi"))
    # Inserted or dropped: a variant of the longer line is the shorter line.
    inserted = materialize(deleted.join(sent_if_small(whole.withColumnRenamed("_h", "_o"), size), "_v").select("_h", "_o").distinct())
    me = texts.select("_h", "_me")
    placed = slots.join(me, "_h")
    earliest = placed.groupBy("_v").agg(F.min("_me").alias("_other"))
    other = texts.select(F.col("_h").alias("_o"), F.col("_me").alias("_other"))
    apart = inserted.join(me, "_h").join(other, "_o").select("_me", "_other")
    pairs = (
        placed.join(earliest, "_v").select("_me", "_other").union(apart)
        .select(F.greatest("_me", "_other").alias("_me"), F.least("_me", "_other").alias("_other"))
        .filter("_other < _me").distinct()
    )
    known = texts.select(F.col("_me").alias("_other"), F.col("_w").alias("_o"))
    checked = pairs.join(texts, "_me").join(known, "_other").filter(one_word_apart(F.col("_w"), F.col("_o")))
    return checked.select("_me._h", "_me._h2").distinct()


def run_keys(w: Column, per: int) -> tuple[Column, Callable[[Column], Column]]:
    """Hashes of a line's word sequences, and from these the least of every run that the fewest edits may leave whole."""
    run = -(-2 * (per - 1) // 3)  # of 2 per words, all but two in three runs; longer lines leave longer ones
    gram = run // 2 + 1
    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - gram + 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(gram))))

    def least(h: Column) -> Column:
        window = run - gram + 1
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(h) - window + 1), lambda i: F.array_min(F.slice(h, i, F.lit(window)))))

    return hashes, least


def edited(pairs: DataFrame, texts: DataFrame, per: int) -> DataFrame:
    """_me of pairs (_me, _other) that at most one edit of a word for every `per` words tells apart."""
    known = texts.select(F.col("_me").alias("_other"), F.col("_w").alias("_o"))
    both = pairs.join(texts.select("_me", "_w"), "_me").join(known, "_other")
    both = both.withColumn("_least", F.least(F.size("_w"), F.size("_o")))

    def common(x: Column, y: Column) -> Column:
        differs = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False).cast("int")
        return F.when(differs == 0, F.col("_least")).otherwise(F.least(differs - 1, F.col("_least")))

    def bound(value: Column, f: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), f), F.lit(0))  # worked out once, however often f has it

    most = F.floor(F.col("_least") / per).cast("int")

    def apart(x: Column, y: Column) -> Column:
        def coded(z: Column, every: Column) -> Column:  # words become characters beyond the first 65,536
            codes = F.transform(z, lambda v: F.lpad(F.hex(F.array_position(every, v) + 65535), 8, "0"))
            return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")

        # Each word that only one of them has needs an edit.
        few = (F.size(F.array_except(x, y)) <= most) & (F.size(F.array_except(y, x)) <= most)
        near = bound(F.array_distinct(F.concat(x, y)), lambda every: F.call_function("levenshtein", coded(x, every), coded(y, every), most) >= 0)
        return F.when(few, near).otherwise(F.lit(False))

    def cut(begin: Column, end: Column) -> Column:
        return F.struct(*[F.slice(c, begin + 1, F.size(c) - begin - end).alias(c) for c in ("_w", "_o")])

    near = bound(common(F.col("_w"), F.col("_o")), lambda begin: bound(
        F.least(common(F.reverse("_w"), F.reverse("_o")), F.col("_least") - begin),
        lambda end: bound(cut(begin, end), lambda z: apart(z["_w"], z["_o"])),
    ))
    return both.filter(near).select("_me").distinct()


def edited_lines(rows: DataFrame, lines: DataFrame, per: int) -> DataFrame:
    """_h, _h2 of distinct lines of 2 `per` words or more that have an earlier near line of as many words."""
    long = rows.withColumn("_w", words(F.col("_line"))).filter(F.size("_w") >= 2 * per)
    hashes, least = run_keys(F.col("_w"), per)
    named = long.select(F.xxhash64(F.xxhash64("_w"), F.xxhash64(F.lit(7), "_w")).alias("_h"), hashes.alias("_hashes"))
    keys = materialize(named.select("_h", F.explode(least(F.col("_hashes"))).alias("_v")))
    several = keys.groupBy("_v").agg(F.min("_h").alias("_a"), F.max("_h").alias("_b")).filter("_a <> _b").select("_v")
    keys = materialize(keys.join(several, "_v", "left_semi").distinct())
    shared = keys.select(F.col("_h").alias("_id")).distinct()
    found = lines.join(shared, F.xxhash64("_h", "_h2") == F.col("_id"), "left_semi").select("_h", "_h2", "_first")
    found = materialize(found)
    texts = texts_of(rows, found, found.count())
    placed = materialize(keys.join(texts.select("_h", "_me", F.size("_w").alias("_n")), "_h").select("_v", "_me", "_n"))

    def fit(m: Column, n: Column) -> Column:
        return F.abs(m - n) <= F.floor(F.least(m, n) / per)

    earliest = placed.groupBy("_v").agg(F.min(F.struct("_me", "_n")).alias("_e"))
    first = placed.join(earliest, "_v").filter((F.col("_e._me") < F.col("_me")) & fit(F.col("_n"), F.col("_e._n")))
    settled = materialize(edited(first.select("_me", F.col("_e._me").alias("_other")).distinct(), texts, per))
    rest = placed.join(settled, "_me", "left_anti").select("_v", "_me", "_n")
    other = placed.select("_v", F.col("_me").alias("_other"), F.col("_n").alias("_m"))
    pairs = rest.join(other, "_v").filter((F.col("_other") < F.col("_me")) & fit(F.col("_n"), F.col("_m")))
    more = edited(pairs.select("_me", "_other").distinct(), texts, per)
    return settled.union(more).select("_me._h", "_me._h2")


def dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 8, per: int | None = None) -> DataFrame:
    """The rows with their text cut to the lines that stay; adds n_lines, n_removed and gone (no line stays).

    per: words of a line for each word that may be edited (at least `least`); None for one word in lines of any length.
    """
    if per is not None and per < least:
        raise ValueError("per must be least or more")
    rows = lines_of(docs, key, text)
    lines = materialize(distinct_lines(rows, least))
    near = near_lines(rows, lines)
    if per is not None:
        near = materialize(near.union(edited_lines(rows, lines, per)).distinct())
    kept = materialize(
        lines.join(near, ["_h", "_h2"], "left_anti")
        .groupBy(F.col("_first._key").alias("_key"), F.col("_first._text").alias("_text"))
        .agg(F.collect_list("_first._pos").alias("_kept"))  # at most a document's lines
    )
    # Forty line numbers weigh as much as a row of a small table.
    rows_kept, numbers = kept.agg(F.count("*"), F.sum(F.size("_kept"))).first()
    weight = max(rows_kept, (numbers or 0) / 40)
    own = docs.drop("n_lines", "n_removed", "gone").withColumn("_text", F.xxhash64(F.coalesce(text, F.lit("")))).withColumn(
        "_lines", F.split(F.coalesce(text, F.lit("")), "\n")
    )
    joined = own.alias("d").join(
        sent_if_small(kept, weight).alias("k"),
        (F.col("d._text") == F.col("k._text")) & F.col(f"d.{key}").eqNullSafe(F.col("k._key")), "left",
    )
    blank = F.filter(
        F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: ~F.get("_lines", i).rlike(FILLED)
    )
    stays = F.coalesce("_kept", F.array().cast("array<int>"))
    places = F.array_sort(F.array_union(F.col("_blank"), stays))
    columns = [F.col(f"d.{c}").alias(c) for c in docs.columns if c not in (text, "n_lines", "n_removed", "gone")]
    cut = joined.withColumn("_blank", blank).withColumn("_places", places)
    changed = F.size("_places") < F.size("_lines")
    whole = F.array_join(F.transform("_places", lambda i: F.get("_lines", i)), "\n")
    result = cut.select(
        *columns, F.when(changed, whole).otherwise(F.col(f"d.{text}")).alias(text),
        F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_places")).cast("long").alias("n_removed"),
        (changed & (F.size(stays) == 0)).alias("gone"),
    )
    return result.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed", "gone")], "n_lines", "n_removed", "gone")


def oracle(least: int = 8) -> str:
    """DuckDB SQL for doc_id, n_lines, n_removed, kept_sha256: variants as whole texts, joined pair by pair."""
    return rf"""
WITH rows AS (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
split AS (SELECT doc_id, pos, line, regexp_extract_all(line, '[^ \t\x0B\f\r]+') AS w FROM rows),
firsts AS (SELECT w, min((doc_id, pos)) AS f FROM split WHERE len(w) > 0 GROUP BY w),
cut AS (SELECT f, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS j FROM firsts WHERE len(w) >= {least}),
deleted AS (SELECT f, n, j, array_to_string(w[:j - 1], ' ') || ' | ' || array_to_string(w[j + 1:], ' ') AS v,
array_to_string(list_concat(w[:j - 1], w[j + 1:]), ' ') AS s FROM cut),
whole AS (SELECT f, len(w) AS n, array_to_string(w, ' ') AS s FROM firsts WHERE len(w) >= {least}),
near AS (
SELECT a.f FROM deleted a JOIN deleted b ON a.v = b.v AND a.n = b.n AND b.f < a.f
UNION SELECT a.f FROM deleted a JOIN whole b ON a.s = b.s AND b.n = a.n - 1 AND b.f < a.f
UNION SELECT b.f FROM deleted a JOIN whole b ON a.s = b.s AND b.n = a.n - 1 AND a.f < b.f),
kept AS (SELECT f FROM firsts WHERE f NOT IN (SELECT f FROM near)),
marked AS (SELECT doc_id, pos, line, len(w) = 0 OR (doc_id, pos) IN (SELECT f FROM kept) AS stays FROM split)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM marked GROUP BY doc_id""".strip()
