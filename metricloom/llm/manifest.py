"""Merkle tree over a table: per group, then over the groups, by levels kept as hex strings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricloom.llm.common import stored, table

# Children of a node, hex digits of a digest, and the fields of a document's leaf.
FANOUT = 3
WIDTH = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Levels that a block goes up at a time: a whole block has 243 nodes.
HEIGHT = 5


def _field(name: str, column: Column | None = None) -> Column:
    value = (F.col(name) if column is None else column).cast("string")
    told = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
    return F.coalesce(told, F.lit("-"))


def leaf(fields: Iterable[str] = FIELDS, **changed: Column) -> Column:
    """Digest of a row: of its fields one after the other, each `-` if null, else `bytes:value`.

    ``changed`` gives other values for some of the fields.
    """
    return F.sha2(F.concat(*[_field(f, changed.get(f)) for f in fields]), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a digest and the siblings on its way up give."""
    return F.aggregate(
        path, digest, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256)
    )


def proof(path: Column) -> Column:
    """Digest of all siblings on the way up, from left to right on every level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def _ranked(nodes: DataFrame) -> DataFrame:
    """Nodes (key, order, ...) with their place ``pos`` in the key and the number ``n`` of its nodes.

    A range shuffle puts them in order; a place is the place in the partition and the number
    of the key's nodes in the partitions before. A large key is spread like all others.
    """
    # `order` ends in the digest: rows that still are equal change places without effect.
    dealt = stored(
        nodes.repartitionByRange("key", "order")
        .sortWithinPartitions("key", "order")
        .select(
            "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")
        ),
        "ranked",
    )
    sizes = dealt.groupBy("key", "part").agg(F.count("*").alias("size"), F.min("at").alias("first"))
    before = F.sum("size").over(Window.partitionBy("key").orderBy("part")) - F.col("size")
    places = sizes.select(
        F.col("key").alias("_key"),
        F.col("part").alias("_part"),
        (before - F.col("first")).alias("shift"),
        F.sum("size").over(Window.partitionBy("key")).alias("n"),
    ).hint("rebalance")
    placed = dealt.join(places, (F.col("key") == F.col("_key")) & (F.col("part") == F.col("_part")))
    return placed.select("key", "n", (F.col("at") + F.col("shift")).alias("pos"), "digest", "payload")


# The next level: every run of children, a fixed width of the string, is hashed.
_PARENTS = f"""array_join(transform(
    sequence(0, (length(element_at(done, -1)) - 1) DIV {FANOUT * WIDTH}),
    run -> sha2(substring(element_at(done, -1), run * {FANOUT * WIDTH} + 1, {FANOUT * WIDTH}), 256)), '')"""


def _levels(height: int) -> Column:
    """All levels of a block, as strings. One that is its key's whole layer ends at a single node."""
    return F.expr(
        f"""aggregate(sequence(1, {height}), array(array_join(members.digest, '')),
        (done, step) -> IF(last AND length(element_at(done, -1)) = {WIDTH}, done,
            concat(done, array({_PARENTS}))))"""
    )


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """(key, n, block, members, levels, last): nodes by aligned blocks, with the levels over them.

    A level is one string, the hex digests of its nodes in order. ``last`` marks
    the one block of a key that holds all of it.
    """
    block = FANOUT**height
    return (
        nodes.groupBy("key", "n", F.expr(f"pos DIV {block}").alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "payload"))).alias("members"))
        .withColumn("last", F.col("n") <= block)
        .withColumn("levels", _levels(height))
    )


def _layers(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Blocks over the nodes, over the roots of those blocks, and so on, until no key has two."""
    block = FANOUT**height
    layers = []
    while True:
        layers.append(stored(_blocks(nodes, height), "blocks"))
        if layers[-1].filter("NOT last").isEmpty():
            return layers
        nodes = layers[-1].filter("NOT last").select(
            "key",
            F.expr(f"(n + {block - 1}) DIV {block}").alias("n"),
            F.col("block").alias("pos"),
            F.element_at("levels", -1).alias("digest"),
            F.lit(None).cast("string").alias("payload"),
        )


def _roots(layers: list[DataFrame]) -> DataFrame:
    """(key, digest): the root of every key."""
    tops = [b.filter("last").select("key", F.element_at("levels", -1).alias("digest")) for b in layers]
    whole = tops[0]
    for top in tops[1:]:
        whole = whole.unionByName(top)
    return whole


def _segments(height: int) -> Column:
    """Members with their siblings in the block: what flanks a node in its run, level by level."""
    powers = ", ".join(str(FANOUT**k) for k in range(height))
    node = f"i DIV get(array({powers}), k)"
    start = f"({node}) - ({node}) % {FANOUT}"
    return F.expr(
        f"""transform(members, (m, i) -> named_struct('member', m, 'own', transform(
            slice(levels, 1, size(levels) - 1), (level, k) -> named_struct(
                'before', substring(level, ({start}) * {WIDTH} + 1, (({node}) % {FANOUT}) * {WIDTH}),
                'after', substring(level, (({node}) + 1) * {WIDTH} + 1,
                    ({FANOUT - 1} - ({node}) % {FANOUT}) * {WIDTH})))))"""
    )


def _descended(layers: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """(key, member, path, root): every node of the lowest layer with its siblings up to the top.

    ``tops`` has (key, path, root): the way from a key's root on. Blocks, not nodes, are joined
    with the way above them.
    """
    def above_of(nodes: DataFrame, block: Column, last: bool) -> DataFrame:
        place = (F.col("key").alias("_key"), block.alias("_block"), F.lit(last).alias("_last"))
        return nodes.select(*place, "path", "root")

    ends = above_of(tops, F.lit(0).cast("bigint"), True)
    above = ends
    for blocks in reversed(layers):
        place = (
            (F.col("key") == F.col("_key"))
            & (F.col("block") == F.col("_block"))
            & (F.col("last") == F.col("_last"))
        )
        nodes = (
            blocks.join(above, place)
            .select("key", "path", "root", F.explode(_segments(height)).alias("node"))
            .select("key", "node.member", F.concat("node.own", "path").alias("path"), "root")
        )
        above = above_of(nodes, F.col("member.pos"), False).unionByName(ends)
    return nodes


def manifest(
    docs: DataFrame,
    fields: Iterable[str] = FIELDS,
    group: str = "source",
    order: str = "doc_id",
    keep: Iterable[str] = ("doc_id",),
    height: int = HEIGHT,
) -> DataFrame:
    """The columns of ``keep`` of every row, and (leaf, subroot, root, path).

    A leaf is the digest of a row's ``fields``, a subroot the root of the leaves
    of a ``group`` in the order of ``order``, and root that of the subroots in the order of
    their groups, null first and bytewise. Every three consecutive nodes, and what is left at the
    end, become their digest until one node remains. ``path`` holds the siblings ``before`` and
    ``after`` the node, from the leaf to the root, so that ``folded(leaf, path)`` is root.

    Nulls are fields like any other and come first in the order, and null texts differ from
    empty ones. Rows with equal ``order`` stand by their leaves; repeated rows are leaves each. An
    empty table gives no rows and has no root. Other columns of ``docs`` are not looked
    at. Blocks of three to the power of ``height`` nodes are what a task holds; a large group is many.
    """
    keep = tuple(keep)
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    leaves = docs.select(
        key.alias("key"),
        F.col(order).alias("_order"),
        leaf(fields).alias("digest"),
        F.struct(*keep).alias("payload"),
    ).select("key", F.struct("_order", "digest").alias("order"), "digest", "payload")
    of_leaves = _layers(_ranked(leaves), height)
    subroots = _roots(of_leaves).select(
        F.lit("").alias("key"),
        F.struct(F.col("key"), F.col("digest")).alias("order"),
        "digest",
        F.col("key").alias("payload"),
    )
    of_groups = _layers(_ranked(subroots), height)
    none = F.array().cast("array<struct<before:string,after:string>>")
    root = _roots(of_groups).select("key", none.alias("path"), F.col("digest").alias("root"))
    groups = stored(
        _descended(of_groups, root, height).select(
            F.col("member.payload").alias("key"),
            "path",
            F.struct(F.col("member.digest").alias("subroot"), "root").alias("root"),
        ),
        "groups",
    )
    return _descended(of_leaves, groups, height).select(
        "member.payload.*", F.col("member.digest").alias("leaf"), "root.subroot", "root.root", "path"
    )


def op13_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; some are tampered with and checked against the root."""
    docs = table(spark, sf_dir, "documents")
    # A text that loses its line ends; null if the document is not tampered with.
    told = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    other = leaf(text=F.replace("text", F.lit("\n"), F.lit("")))
    marked = docs.withColumn("other", F.when(told, other))
    found = manifest(marked, keep=("doc_id", "other"))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


# crc32 of the decimal id: over its bytes, eight shifts each, by the reversed polynomial 0xEDB88320.
OP13_SQL = """
WITH RECURSIVE docs AS (
  SELECT *, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(
        string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(
        [xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))) AS crc
  FROM documents
), fields AS (
  SELECT doc_id, source, crc % 2 = 1 AS told, -- before the final inversion
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
      || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, replace(text, chr(10), '') AS other
  FROM docs
), leaves AS (
  SELECT doc_id, coalesce('1' || source, '0') AS key,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN told THEN sha256(head || coalesce(strlen(other) || ':' || other, '-')) END AS other
  FROM fields
), placed AS (
  SELECT *, row_number() OVER o - 1 AS pos, count(*) OVER (PARTITION BY key) AS n
  FROM leaves WINDOW o AS (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf)
), own AS (
  SELECT key, 0 AS level, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT key, level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM own WHERE n > 1 GROUP BY key, level, pos // 3
), subroots AS (
  SELECT key, h, max(level) OVER () AS top,
    row_number() OVER (ORDER BY encode(key)) - 1 AS pos, count(*) OVER () AS n, level AS height
  FROM own WHERE n = 1
), above AS (
  SELECT 0 AS level, pos, n, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM above WHERE n > 1 GROUP BY level, pos // 3
), nodes AS (
  SELECT key, level, pos, h FROM own WHERE n > 1
  UNION ALL
  SELECT s.key, s.height + a.level, a.pos, a.h FROM subroots s, above a WHERE a.n > 1
), ways AS (
  SELECT p.key, p.pos AS leaf_pos, 0 AS level, p.pos, s.height, s.pos AS sub_pos, coalesce(p.other, p.leaf) AS node, '' AS others
  FROM placed p JOIN subroots s USING (key)
  UNION ALL
  SELECT w.key, w.leaf_pos, w.level + 1, w.at // 3, w.height, w.sub_pos,
    sha256(coalesce(w.before, '') || w.node || coalesce(w.after, '')),
    w.others || coalesce(w.before, '') || coalesce(w.after, '')
  FROM (
    SELECT v.*, string_agg(x.h, '' ORDER BY x.pos) FILTER (WHERE x.pos < v.at) AS before,
      string_agg(x.h, '' ORDER BY x.pos) FILTER (WHERE x.pos > v.at) AS after
    FROM (SELECT *, CASE WHEN level = height THEN sub_pos ELSE pos END AS at FROM ways) v
    JOIN nodes x ON x.key = v.key AND x.level = v.level AND x.pos // 3 = v.at // 3
    GROUP BY ALL
  ) w
), ends AS (
  SELECT key, leaf_pos, arg_max(node, level) AS node, arg_max(others, level) AS others
  FROM ways GROUP BY key, leaf_pos
)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(e.others) AS proof_sha256,
  e.node AS folded_root, e.node = r.h AS verified
FROM placed p JOIN subroots s USING (key) JOIN ends e ON e.key = p.key AND e.leaf_pos = p.pos
  JOIN above r ON r.n = 1
"""
