import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from gaugewright.llm import shards
from gaugewright.llm.common import raw


def test_growing_moves_rows_only_into_the_new_shard(spark):
    mapped = shards.first_map(spark, 16)
    for n in (16, 17, 18):
        grown = shards.grow(mapped)
        pairs = mapped.select("virtual_slot", F.col("shard").alias("a")).join(grown.select("virtual_slot", F.col("shard").alias("b")), "virtual_slot").collect()
        assert len(pairs) == shards.SLOTS and all(r["a"] == r["b"] or r["b"] == n for r in pairs)
        sizes = Counter(r["b"] for r in pairs)
        assert len(sizes) == n + 1 and max(sizes.values()) - min(sizes.values()) <= 16
        mapped = grown


def test_places(spark, awkward, none):
    mapped = shards.first_map(spark, 16)
    rows = shards.places(awkward, mapped).collect()
    texts = Counter((r["doc_id"], len(raw(r["text"])) + 1, zlib.crc32(raw(r["text"]))) for r in awkward.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    for s in range(16):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    where = {}
    for r in rows:
        assert where.setdefault(r["doc_id"], r["shard"]) == r["shard"]
    assert shards.places(none, mapped).count() == 0
    plan = shards.places(awkward, mapped)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rebalance_and_versions(spark, awkward, clashing, tmp_path):
    mapped = shards.first_map(spark, 4, 64)
    held = spark.range(64).select(F.col("id").cast("int").alias("virtual_slot"), F.when(F.col("id") % 4 == 0, 100).otherwise(1).alias("bytes"), F.lit(1).alias("rows"))
    even = shards.rebalance(mapped, held)
    sums = lambda m: [r["s"] for r in m.join(held, "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("s")).collect()]
    assert max(sums(mapped)) == 1600 and max(sums(even)) <= 500 and even.count() == 64
    path = str(tmp_path / "map")
    shards.save(mapped, path)
    shards.save(even, path)
    stored = shards.load(spark, path)
    assert stored.count() == 128
    newest = {r["virtual_slot"]: r["shard"] for r in shards.latest(stored).collect()}
    assert newest == {r["virtual_slot"]: r["shard"] for r in even.collect()}
    out = shards.assign(clashing, shards.first_map(spark, 16))
    assert out.count() == awkward.count() and out.columns.count("shard") == 1 and out.first()["score"] == "kept"
    total = shards.slot_bytes(awkward).agg(F.sum("bytes"), F.sum("rows")).first()
    assert tuple(total) == (sum(len(raw(r["text"])) + 1 for r in awkward.collect()), awkward.count())
