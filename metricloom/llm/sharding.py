"""Shards by a two-pass external shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.llm.common import dropped, settings, stored, table

# Bytes and rows that a bucket holds on average, at the most; it is shuffled in the memory of one task.
BUCKET_BYTES = 4 << 20
BUCKET_ROWS = 1 << 10
# Equal rows of more than this part of a bucket are spread over several.
HOT = 4
# Buckets whose offsets are summed in one task.
GROUP = 1 << 12
# Buckets up to which their offsets, 16 bytes each, are broadcast.
MOST_BROADCAST = 1 << 16


def _size(text: str) -> Column:
    """UTF-8 bytes of the text, and one."""
    return F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("bigint") + 1


def _first(counts: DataFrame) -> DataFrame:
    """(bucket, first): how many rows the buckets before have. Summed in two levels."""
    grouped = counts.withColumn("part", F.floor(F.col("bucket") / GROUP))
    parts = grouped.groupBy("part").agg(F.sum("n").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first")
    )
    inside = W.partitionBy("part").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    return (
        grouped.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(parts, F.col("part") == F.col("_part"))
        .select(F.col("bucket").alias("_bucket"), (F.col("_first") + F.col("_inside")).alias("first"))
    )


def _hashed(docs: DataFrame, seed: int) -> Column:
    """Seeded hash of a row: of all its columns, as JSON where Spark has no hash for the type."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    plain = [not ("map<" in kind or "variant" in kind) for kind in kinds.values()]
    columns = [docs[c] if ok else F.to_json(F.struct(docs[c].alias("v"))) for c, ok in zip(kinds, plain, strict=True)]
    return F.xxhash64(F.lit(seed), *columns)


def _scattered(docs: DataFrame, seed: int, text_col: str, bucket_bytes: int) -> DataFrame:
    """(hash, n_th, row): every row with its hash and a number that tells equal rows of a large group apart.

    Equal rows have one hash and would fill one bucket. Where they are more than a bucket's part, which
    their count tells, they are combined to one row and a number before the shuffle, and numbered
    from there. Nothing depends on how the input is split.
    """
    whole = F.struct(*[docs[c] for c in docs.columns])
    rows = docs.select(
        _hashed(docs, seed).alias("hash"), _size(text_col).alias("size"), whole.alias("row")
    )
    counts = rows.groupBy("hash").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    hot = stored(
        counts.filter((F.col("n") > 1) & (F.col("size") > bucket_bytes // HOT)).select(
            F.col("hash").alias("_hot")
        ),
        "hot",
    )
    few = hot.count()
    if not few:
        dropped(hot)
        return rows.select("hash", F.lit(0).cast("bigint").alias("n_th"), "row")
    hot = F.broadcast(hot) if few <= MOST_BROADCAST else hot.hint("rebalance")
    cold = rows.join(hot, F.col("hash") == F.col("_hot"), "left_anti")
    copies = (
        rows.join(hot, F.col("hash") == F.col("_hot"), "left_semi")
        .groupBy("hash", "row")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("hash", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("n_th"), "row")
    )
    return cold.select("hash", F.lit(0).cast("bigint").alias("n_th"), "row").unionByName(copies)


def _permutation(seed: int) -> Column:
    """Places 0 to n-1 of a bucket in the order of a Fisher-Yates shuffle, drawn from seed and bucket.

    The i-th place goes to a place j up to i, and what stood there to the end.
    """
    return F.expr(
        f"""aggregate(sequence(1, size(all) - 1, 1), array(0), (done, i) -> IF(draws[i] = i,
            concat(done, array(i)),
            concat(slice(done, 1, draws[i]), array(i), slice(done, draws[i] + 2, i - draws[i] - 1),
                array(get(done, draws[i])))))"""
    )


def shuffled(
    docs: DataFrame,
    shards: int,
    seed: int = 0,
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Every row of ``docs`` in a random order, dealt out to shards: (row, shard, slot).

    ``row`` is a struct of the columns of ``docs``, whatever their names; ``slot`` counts
    without gaps from 0 in each shard, and shards differ by one row at most. The order is that of the seed and the
    rows: it is the same however the input is split into files or partitions.

    First pass: each row goes to a bucket by a seeded hash of all its columns; large groups
    of equal rows are numbered, and the number is hashed too. Buckets fill evenly, and their
    number follows the bytes and rows of the input, so that one fits in memory. Second
    pass: a Fisher-Yates shuffle of each bucket. A row's place in the whole
    is its bucket's offset and its place there; places are dealt to the shards in turn.

    Null ids and texts, empty and repeated rows are rows like any other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    whole = docs.agg(F.sum(_size(text_col)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    buckets = max(1, -(-(whole.bytes or 0) // bucket_bytes), -(-whole.rows // BUCKET_ROWS))
    mixed = F.xxhash64(F.lit(seed), F.col("hash"), F.col("n_th"))
    one = F.struct(mixed.alias("order"), F.col("hash").alias("hash"), F.col("row").alias("row"))
    dealt = _scattered(docs, seed, text_col, bucket_bytes).select(
        F.pmod(mixed, F.lit(buckets)).alias("bucket"), one.alias("one")
    )
    # Sorted first: the arrival of blocks must not decide what the seed decides.
    gathered = dealt.groupBy("bucket").agg(F.array_sort(F.collect_list("one"), _by_order).alias("all"))
    draws = F.expr(
        f"transform(sequence(0, size(all) - 1), i -> CAST(pmod(xxhash64({seed}, bucket, i), i + 1) AS INT))"
    )
    order = F.when(F.size("all") > 1, _permutation(seed)).otherwise(F.array(F.lit(0)))
    # Gathered by sorting: hashing would hold many buckets at a time in a task.
    with settings(spark, {"spark.sql.execution.useObjectHashAggregateExec": "false"}):
        shuffled_buckets = stored(
            gathered.withColumn("draws", draws)
            .withColumn("order", order)
            .select("bucket", F.transform("order", lambda i: F.get("all", i)["row"]).alias("all")),
            "buckets",
        )
    first = _first(shuffled_buckets.select("bucket", F.size("all").cast("bigint").alias("n")))
    first = F.broadcast(first) if buckets <= MOST_BROADCAST else first.hint("rebalance")
    placed = shuffled_buckets.join(first, F.col("bucket") == F.col("_bucket")).select(
        "first", F.posexplode("all").alias("pos", "row")
    )
    at = F.col("first") + F.col("pos")
    return placed.select(
        "row",
        (at % shards).cast("int").alias("shard"),
        F.floor(at / shards).cast("bigint").alias("slot"),
    )


def _by_order(a: Column, b: Column) -> Column:
    def less(name: str) -> Column:
        return F.when(a[name] < b[name], -1).when(a[name] > b[name], 1)

    return F.coalesce(less("order"), less("hash"), F.lit(0))


def write_shards(dealt: DataFrame, path: str) -> None:
    """Write the shards of ``shuffled`` as folders ``shard=N``, rows in the order of their slots.

    Files have the columns of the rows and ``slot``. Where a row has a column ``shard`` or
    ``slot`` of its own, the added one gets an underscore in front.
    """
    taken = {c.lower() for c in dealt.schema["row"].dataType.names}
    shard, slot = ("_" * _underscores(name, taken) + name for name in ("shard", "slot"))
    (
        dealt.select("row.*", F.col("shard").alias(shard), F.col("slot").alias(slot))
        .repartitionByRange(shard, slot)
        .sortWithinPartitions(shard, slot)
        .write.partitionBy(shard)
        .parquet(path)
    )


def _underscores(name: str, taken: set[str]) -> int:
    return next(n for n in range(len(taken) + 1) if "_" * n + name not in taken)


def op6_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by the law of rows: counts at most one apart."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    dealt = shuffled(docs, shards=8, seed=42)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return dealt.select(
        F.col("row.doc_id").alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
