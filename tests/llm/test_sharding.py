"""op6: even shards, whole rows, an order that the seed decides."""

import struct
import zlib

import pytest
import xxhash

from metricloom.llm import sharding

DOCS = "doc_id long, text string, shard int, slot string, bucket long"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 7) for r in rows], DOCS)


def dealt_rows(spark, rows, shards=4, **options):
    found = sharding.shuffled(docs_of(spark, rows), shards, **options).collect()
    return [((r.row.doc_id, r.row.text), r.shard, r.slot) for r in found]


ROWS = [(i, f"text {i} é") for i in range(500)] + [(None, None), (None, "x"), (3, ""), (3, "")] * 3


def test_shards_are_even_and_whole(spark, monkeypatch):
    for size in (1 << 20, 500, 400):
        if size == 400:
            monkeypatch.setattr(sharding, "MOST_BROADCAST", 1)
        found = dealt_rows(spark, ROWS, bucket_bytes=size)
        assert sorted(map(repr, (f[0] for f in found))) == sorted(map(repr, ROWS))
        counts = [sorted(f[2] for f in found if f[1] == s) for s in range(4)]
        assert all(c == list(range(len(c))) for c in counts)
        assert max(map(len, counts)) - min(map(len, counts)) <= 1


def test_order_is_random_but_the_seeds(spark):
    one, again, other = (
        sorted(dealt_rows(spark, ROWS, seed=s, bucket_bytes=500), key=lambda f: (f[2], f[1]))
        for s in (1, 1, 2)
    )
    assert one == again != other
    order = [f[0][0] for f in one if f[0][0] is not None]
    rising = sum(a < b for a, b in zip(order, order[1:]))  # noqa: B905
    assert 0.4 < rising / len(order) < 0.6


def test_hot_ids_spread_over_buckets(spark):
    rows = [(7, "same")] * 400 + [(i, "other") for i in range(100)]
    found = dealt_rows(spark, rows, bucket_bytes=300)
    hot = [f[1] for f in found if f[0] == (7, "same")]
    assert len(found) == 500 and min(hot.count(s) for s in range(4)) > 50


def test_few_rows_and_empty_table(spark):
    assert sorted(f[1] for f in dealt_rows(spark, [(1, "a"), (2, "b")])) == [0, 1]
    assert dealt_rows(spark, []) == []


def chained(*values):
    """Spark's xxhash64 of integers (4 bytes), ("long", n) and texts; nulls leave the hash as it is."""
    h = 42
    for v in values:
        if v is None:
            continue
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v) if isinstance(v, int) else struct.pack("<q", v[1])
        h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def brute(rows, shards, seed, bucket_bytes, bucket_rows):
    """((doc_id, text), shard, slot) of every row, by the method in plain words."""
    size = lambda t: len((t or "").encode()) + 1
    whole = sum(size(t) for _, t in rows)
    buckets = max(1, -(-whole // bucket_bytes), -(-len(rows) // bucket_rows))
    seen, held = {}, [[] for _ in range(buckets)]
    for row in rows:
        own = chained(seed, None if row[0] is None else ("long", row[0]), row[1])
        hot = rows.count(row) > 1 and rows.count(row) * size(row[1]) > bucket_bytes // sharding.HOT
        seen[row] = seen.get(row, 0) + hot
        mixed = chained(seed, ("long", own), ("long", seen[row]))
        held[mixed % buckets].append((mixed, own, row))
    out, at = [], 0
    for bucket, entries in enumerate(held):
        entries.sort(key=lambda e: e[:2])
        done = []
        for i, entry in enumerate(entries):
            j = chained(seed, ("long", bucket), i) % (i + 1)
            done.append(entry)
            done[i], done[j] = done[j], done[i]
        for _, _, row in done:
            out.append((row, at % shards, at // shards))
            at += 1
    return out


@pytest.mark.parametrize("bucket_bytes,bucket_rows", [(1 << 20, 1 << 10), (700, 1 << 10), (1 << 20, 50)])
def test_places_are_those_of_a_plain_version_however_the_input_is_split(spark, monkeypatch, bucket_bytes, bucket_rows):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket_rows)
    rows = ROWS + [(9, "hot text")] * 300
    expected = sorted(brute(rows, 4, 5, bucket_bytes, bucket_rows), key=repr)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 2, 5):
        found = sharding.shuffled(docs.repartition(parts), 4, seed=5, bucket_bytes=bucket_bytes).collect()
        assert sorted((((r.row.doc_id, r.row.text), r.shard, r.slot) for r in found), key=repr) == expected


def test_a_task_gathers_one_bucket_at_a_time_and_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.execution.useObjectHashAggregateExec")
    assert len(dealt_rows(spark, ROWS, bucket_bytes=300)) == len(ROWS)
    assert spark.conf.get("spark.sql.execution.useObjectHashAggregateExec") == before


def test_files_of_documents_with_columns_of_the_same_names(spark, tmp_path):
    docs = docs_of(spark, ROWS).withColumnRenamed("bucket", "_Shard")
    dealt = sharding.shuffled(docs, 3)
    sharding.write_shards(dealt, f"{tmp_path}/out")
    files = spark.read.parquet(f"{tmp_path}/out")
    assert set(files.columns) == {"doc_id", "text", "shard", "slot", "_Shard", "_slot", "__shard"}
    assert files.groupBy("__shard").count().count() == 3 and files.filter("shard = 1 and slot = 's'").count() == len(ROWS)
    one = files.filter("__shard = 2").orderBy("_slot").select("_slot", "doc_id").collect()
    assert [tuple(r) for r in one] == [
        (r.slot, r.doc_id) for r in dealt.filter("shard = 2").orderBy("slot").select("slot", "row.doc_id").collect()
    ]


def test_query_and_files(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sharding.op6_two_pass(spark, str(tmp_path)).collect()
    assert len(rows) == len(ROWS) and {r.shard for r in rows} == set(range(8))
    texts = {i: (t or "").encode() for i, t in ROWS if i not in (3, None)}
    assert all(
        r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.size == len(texts[r.doc_id]) + 1
        for r in rows
        if r.doc_id in texts
    )
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sharding.write_shards(sharding.shuffled(docs, 3), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("shard").count().count() == 3
