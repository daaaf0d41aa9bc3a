import zlib

from cases import crowded, frame
from pyspark.sql import functions as F

from millrace.llm.runtime import scratch
from millrace.llm.sharding import SLOTS, add_shard, assign_slots, load_map, save_map, shard, slot_table, text_size, virtual_slot


def test_rows_sizes_and_numbers(spark):
    docs = frame(spark)
    got = shard(crowded(docs), n_shards=3).toPandas()
    want = [((r["doc_id"] if r["doc_id"] is not None else -1), len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()]
    got["doc_id"] = got.doc_id.fillna(-1).astype(int)
    assert sorted(map(tuple, got[["doc_id", "size", "text_crc32"]].itertuples(index=False))) == sorted(want)
    for _, rows in got.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))


def test_shards_are_even_and_growth_moves_little(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 300).cast("int")).alias("text"))
    got = shard(rows, n_shards=16).groupBy("shard").agg(F.sum("size").alias("b")).toPandas()
    assert len(got) == 16 and got.b.max() - got.b.min() < 0.01 * got.b.mean()
    records = rows.select(virtual_slot(F.col("doc_id")).alias("vslot"), text_size(F.col("text")).alias("size"))
    slots = slot_table(records)
    first = assign_slots(slots, 16)
    path = scratch(spark, "map")
    save_map(first, path)
    save_map(add_shard(load_map(spark, path), slots, 16), path)
    old, new = (load_map(spark, path, v).toPandas().set_index("vslot").shard for v in (1, 2))
    moved = old[old != new.reindex(old.index)]
    assert set(new.reindex(moved.index)) == {16}
    size = slots.toPandas().set_index("vslot").bytes
    assert 0.8 * size.sum() / 17 < size.reindex(moved.index).sum() < 1.2 * size.sum() / 17
    assert load_map(spark, path).first()["version"] == 2


def test_an_edit_of_the_stored_map_moves_its_slots_alone(spark, tmp_path):
    rows = [(i, "x" * (i % 50), "en", "s", i) for i in range(3000)]
    docs, path = frame(spark, rows), f"file://{tmp_path}/map"
    first = shard(docs, map_path=path).toPandas().set_index("doc_id")
    again = shard(docs, map_path=path).toPandas().set_index("doc_id")
    assert (first.shard == again.shard[first.index]).all() and set(first.map_version) == set(again.map_version) == {1}
    assert load_map(spark, path).count() == SLOTS  # slots that no row has yet have a shard too
    records = docs.select(text_size(F.col("text")).alias("size"), virtual_slot(F.col("doc_id")).alias("vslot"))
    save_map(add_shard(load_map(spark, path), slot_table(records), 16), path)
    old, new = (load_map(spark, path, v).toPandas().set_index("vslot").shard for v in (1, 2))
    edited = set(old.index[old != new.reindex(old.index)])
    grown = shard(docs.union(frame(spark, [(10**6 + i, "new", "en", "s", 3) for i in range(2000)])), map_path=path).toPandas().set_index("doc_id")
    assert set(grown.map_version) == {2} and len(grown) == 5000
    for i, r in first.iterrows():
        assert grown.shard[i] == (16 if r.vslot in edited else r.shard)
    for _, own in grown.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_empty_table(spark):
    assert shard(frame(spark, [])).count() == 0


def test_slots_and_shards_match_a_plain_version(spark):
    """Hot ids, repeated rows and clashing names; slots by MD5, the largest first to the lightest shard."""
    import hashlib

    rows = [(i % 40 if i % 3 else 7, "é" * (i % 17) if i % 5 else None, "en", "s", i) for i in range(600)]
    docs = crowded(frame(spark, rows).repartition(6))
    slot = lambda k: int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) % 64
    size = lambda t: len((t or "").encode()) + 1
    total = {}
    for k, t, *_ in rows:
        total[slot(k)] = total.get(slot(k), 0) + size(t)
    loads, where = [0] * 5, {}
    for s in sorted(total, key=lambda s: (-total[s], s)):
        where[s] = loads.index(min(loads))
        loads[where[s]] += total[s]
    got = shard(docs, n_shards=5, n_slots=64).toPandas()
    assert len(got) == 600 and all(got.vslot == [slot(k) for k in got.doc_id]) and all(got.shard == [where[s] for s in got.vslot])
    for _, own in got.groupby("shard"):
        own = own.sort_values("slot")
        assert own.slot.tolist() == list(range(len(own)))
        keys = list(zip(own.vslot, own.doc_id, own["size"], own.text_crc32))
        assert keys == sorted(keys)
