"""Near-duplicate vectors by product quantisation with inverted lists."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm.common import added, dropped, map_batches, rows, stored, table
from metricloom.llm.graph import components
from metricloom.session import scratch_path

# Fixed value: the cosine from which two vectors are linked.
COSINE = 0.9
# Vectors on which the index is fitted, at most; which ones a hash decides.
TRAINING_ROWS = 20_000
# Vectors per inverted list on average, and lists at most.
LIST_ROWS, MOST_LISTS = 256, 4096
# Lists that are searched together, so that a vector that probes several of them is sent once; and
# vectors of theirs, and of what probes them, that are compared at a time.
GROUP, BLOCK_ROWS = 16, 2048
# Components of the vectors of a block, which is sent as a whole: up to BLOCKS times BLOCK_ROWS vectors.
BLOCK_VALUES, BLOCKS = 1 << 20, 4
# Components of the vectors sent in a round; at least those of the whole table.
ROUND_VALUES = 1 << 25
# Pairs whose cosine is taken at a time.
PAIRS = 1 << 16
# Subspaces of a residual, and codes of each.
SUBSPACES, CODES = 16, 16
_ROUNDS, _SEED = 8, 7
# Points whose distances to all centres are held at a time.
_AT_ONCE = 1 << 10
# Slack for rounding where a bound decides that a pair is looked at; pairs
# themselves are decided by their cosine in double precision.
_SLACK = 1e-3


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (centres**2).sum(1)
    parts = [points[at : at + _AT_ONCE] for at in range(0, len(points), _AT_ONCE)]
    nearest = [(square - 2 * part @ centres.T).argmin(1) for part in parts]
    return np.concatenate([np.zeros(0, np.int64), *nearest])


def _k_means(points: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(_SEED)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(_ROUNDS):
        own = _nearest(points, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


@dataclass
class Index:
    """Centres of the inverted lists and, per subspace of the residuals, the codes' centres.

    At most MOST_LISTS centres and CODES codes per subspace: this bounds what is broadcast.
    """

    centres: np.ndarray
    codes: list[np.ndarray]

    def parts(self, values: np.ndarray) -> list[np.ndarray]:
        return np.array_split(values, len(self.codes), axis=1)

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and distance to the reconstruction of each point."""
        own = _nearest(points, self.centres)
        residual = points - self.centres[own]
        codes = [_nearest(p, c) for p, c in zip(self.parts(residual), self.codes, strict=True)]
        made = np.concatenate([c[k] for c, k in zip(self.codes, codes, strict=True)], axis=1)
        error = np.sqrt(((residual - made) ** 2).sum(1))
        return own, np.stack(codes, 1).astype(np.uint8), error

    def probes(self, points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, group, lists) for every group with lists to be searched for the point; lists are bits.

        A vector of that list lies beyond the plane halfway between the list's centre and
        the point's own. A plane further off than the radius hides no pair, any other may: no pair
        is lost, however the vectors are spread. Either end of a pair is near the other's list, so
        only the one in the later list searches, and both are credited.
        """
        found = [np.zeros((3, 0), np.int64)]
        for at in range(0, len(points), _AT_ONCE):
            near = self._near(points[at : at + _AT_ONCE], radius)
            spare = -near.shape[1] % GROUP
            grouped = np.pad(near, ((0, 0), (0, spare))).reshape(len(near), -1, GROUP)
            bits = grouped @ (1 << np.arange(GROUP))
            own, group = np.nonzero(bits)
            found.append(np.stack([own + at, group, bits[own, group]]))
        at, group, bits = np.concatenate(found, axis=1)
        return at, group, bits

    def _near(self, points: np.ndarray, radius: float) -> np.ndarray:
        """Whether a list is to be searched, by point and list."""
        square = (
            (points**2).sum(1)[:, None]
            - 2 * points @ self.centres.T
            + (self.centres**2).sum(1)[None, :]
        )
        own = square.argmin(1)
        between = np.sqrt(
            np.maximum(
                (self.centres**2).sum(1)[own][:, None]
                - 2 * self.centres[own] @ self.centres.T
                + (self.centres**2).sum(1)[None, :],
                0,
            )
        )
        gap = square - square[np.arange(len(points)), own][:, None]
        near = gap <= 2 * between * (radius + _SLACK)
        near &= np.arange(len(self.centres)) < own[:, None]
        near[np.arange(len(points)), own] = True
        return near

    def squares(self, queries: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of coded vectors of one list to queries, by table look-up.

        Rows are the coded vectors, so that a look-up takes whole rows of a table.
        """
        total = np.zeros((len(codes), len(queries)), np.float32)
        residual = (queries - self.centres[centre]).astype(np.float32)
        for part, own, k in zip(self.parts(residual), self.codes, codes.T, strict=True):
            own = own.astype(np.float32)
            lookup = (own**2).sum(1)[:, None] - 2 * own @ part.T + (part**2).sum(1)
            total += np.take(lookup, k, axis=0)
        return total


def _fit(sample: np.ndarray, lists: int) -> Index:
    centres = _k_means(sample, lists)
    residual = sample - centres[_nearest(sample, centres)]
    parts = np.array_split(residual, min(SUBSPACES, sample.shape[1]), axis=1)
    return Index(centres, [_k_means(p, CODES) for p in parts])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a batch as rows; shorter ones end in zeros."""
    out = np.zeros((len(column), width))
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    inside = np.arange(width) < lengths[:, None]
    out[inside] = values[offsets[0] : offsets[-1]]
    return out


def _unit(values: np.ndarray) -> np.ndarray:
    # Scaled by the largest part first, so that no square over- or underflows.
    scaled = values / np.abs(values).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _coded(nodes: DataFrame, index, width: int, kind: str) -> DataFrame:
    """(node, vector, weight, list, codes, error, probes) of each distinct vector."""

    def step(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _unit(_matrix(batch.column(1), width))
            lists, codes, error = index.value.encode(points)
            at, group, bits = index.value.probes(points, np.sqrt(2 - 2 * COSINE))
            cuts = np.searchsorted(at, np.arange(len(points) + 1)).astype(np.int32)
            probed = rows(group=group.astype(np.int32), lists=bits.astype(np.int32)).to_struct_array()
            yield rows(
                node=batch.column(0),
                vector=batch.column(1),
                weight=batch.column(2),
                list=lists.astype(np.int32),
                codes=pa.array([c.tobytes() for c in codes], pa.binary()),
                error=error,
                probes=pa.ListArray.from_arrays(cuts, probed),
            )

    return map_batches(
        nodes.select("node", "vector", "weight"),
        step,
        f"node bigint, vector {kind}, weight bigint, list int, codes binary,"
        " error double, probes array<struct<group:int,lists:int>>",
    )


def _forest(x: np.ndarray, y: np.ndarray, queries: int, members: int) -> np.ndarray:
    """Smallest vertex that each vertex reaches; queries come first, then members."""
    label = np.arange(queries + members)
    while True:
        low = np.minimum(label[x], label[queries + y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, queries + y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links_of(members: pa.Array, queries: pa.Array, index: Index, width: int):
    """(node, other, links) of one block of queries against one block of a group of lists."""
    node, weight, home = (members.field(k).to_numpy() for k in ("node", "weight", "list"))
    codes = np.frombuffer(b"".join(members.field("codes").to_pylist()), np.uint8)
    codes = codes.reshape(len(node), -1)
    kept, asked = members.field("vector"), queries.field("vector")
    points, own = _unit(_matrix(kept, width)), _unit(_matrix(asked, width))
    size, wide = kept.value_lengths().to_numpy(), asked.value_lengths().to_numpy()
    name, asks, lists, of = (queries.field(k).to_numpy() for k in ("node", "weight", "lists", "home"))
    reach = (np.sqrt(2 - 2 * COSINE) + _SLACK + members.field("error").to_numpy()) ** 2
    found = [np.zeros((2, 0), np.int64)]
    for centre in np.unique(home):
        there = np.flatnonzero(home == centre)
        here = np.flatnonzero(lists >> (centre % GROUP) & 1)
        y, x = np.nonzero(index.squares(own[here], centre, codes[there]) <= reach[there, None])
        for at in range(0, len(x), PAIRS):
            one, two = here[x[at : at + PAIRS]], there[y[at : at + PAIRS]]
            good = (np.einsum("ij,ij->i", own[one], points[two]) >= COSINE) & (name[one] != node[two])
            good &= wide[one] == size[two]
            found.append(np.stack([one[good], two[good]]))
    x, y = np.concatenate(found, axis=1)
    # Within its own list each end searches for itself.
    back = of[x] != home[y]
    label = _forest(x, y, len(name), len(node))
    total = np.bincount(x, weight[y], len(name))
    credit = np.bincount(y[back], asks[x[back]], len(node))
    names = np.concatenate([name, node])
    linked = np.unique(np.concatenate([x, len(name) + y]))
    links = np.concatenate([total, credit]).astype(np.int64)
    return names[linked], names[label[linked]], links[linked]


def _linked(blocks: DataFrame, index, width: int) -> DataFrame:
    """(node, other, links): per vector of a block how many it is linked to, copies included,
    and one that it reaches, so that the components of these rows are those of all links.

    Table look-up distances pass all that may be in reach, given each code's own
    error, and a cosine in double precision decides. Output is as long as the blocks,
    not as their pairs.
    """

    def step(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                members, queries = batch.column(0)[i].values, batch.column(1)[i].values
                for at in range(0, len(members), BLOCK_ROWS):
                    for of in range(0, len(queries), BLOCK_ROWS):
                        node, other, links = _links_of(
                            members.slice(at, BLOCK_ROWS), queries.slice(of, BLOCK_ROWS), index.value, width
                        )
                        if len(node):
                            yield rows(node=node, other=other, links=links)

    return map_batches(blocks, step, "node bigint, other bigint, links bigint")


def _sizes(coded: DataFrame, block: int) -> list:
    """(group, own, other): blocks of the vectors of each group of lists, and of what probes one of them."""
    own = coded.groupBy(F.expr(f"list DIV {GROUP}").cast("int").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    asked = coded.select(F.inline("probes")).groupBy("group").agg(F.count(F.lit(1)).alias("q"))
    counted = own.join(asked, "group").select(
        "group",
        F.ceil(F.col("n") / block).cast("bigint").alias("own"),
        F.ceil(F.col("q") / block).cast("bigint").alias("other"),
    )
    return sorted(counted.collect())  # at most MOST_LISTS rows


def _rounds(sizes: list, pairs: int):
    """(groups, low, high): pairs of blocks in runs of ``pairs``. Groups are (group, own, other, first), and
    ``first`` is the number of the first of the own x other pairs of a group."""
    numbered, total = [], 0
    for group, own, other in sizes:
        numbered.append((group, own, other, total))
        total += own * other
    for low in range(0, total, pairs):
        high = min(low + pairs, total)
        yield [g for g in numbered if g[3] < high and g[3] + g[1] * g[2] > low], low, high


def _blocks(coded: DataFrame, groups: list, low: int, high: int) -> DataFrame:
    """(members, queries): blocks of each group of lists against blocks of what probes one of them.

    Members and queries are dealt to as many blocks as their numbers ask for, and meet once. A list of
    any size is searched by many tasks of bounded size. Of all pairs of blocks these are those numbered from
    ``low`` to below ``high``.
    """
    spark, least, most = coded.sparkSession, groups[0][0], groups[-1][0]
    sizes = spark.createDataFrame(groups, "group int, own bigint, other bigint, first bigint")
    sizes = F.broadcast(sizes)  # at most MOST_LISTS rows
    own = coded.filter(F.col("list").between(least * GROUP, most * GROUP + GROUP - 1)).withColumn(
        "group", F.expr(f"list DIV {GROUP}").cast("int")
    )
    probes = F.filter("probes", lambda p: p["group"].between(least, most))
    asked = coded.select(F.inline(probes), "node", "weight", F.col("list").alias("home"), "vector")

    def dealt(number: str):
        return F.pmod(F.xxhash64("node"), F.col(number))

    members = (
        own.join(sizes, "group")
        .withColumn("m", dealt("own"))
        .withColumn("from", F.col("first") + F.col("m") * F.col("other"))
        .filter(f"from < {high} and from + other > {low}")
        .select(
            "group",
            "m",
            F.expr(f"explode(sequence(greatest({low} - from, 0), least({high} - from, other) - 1))").alias("q"),
            F.struct("node", "weight", "list", "codes", "error", "vector").alias("member"),
            F.lit(None).alias("query"),
        )
    )
    queries = (
        asked.join(sizes, "group")
        .withColumn("q", dealt("other"))
        .withColumn("from", F.expr(f"greatest(({low} - first - q + other - 1) div other, 0)"))
        .withColumn("to", F.expr(f"least(({high} - 1 - first - q) div other, own - 1)"))
        .filter(f"first + q < {high} and from <= to")
        .select(
            "group",
            F.explode(F.sequence("from", "to")).alias("m"),
            "q",
            F.lit(None).alias("member"),
            F.struct("node", "weight", "home", "lists", "vector").alias("query"),
        )
    )
    return (
        members.unionByName(queries)
        .groupBy("group", "m", "q")
        .agg(F.collect_list("member").alias("members"), F.collect_list("query").alias("queries"))
        .filter((F.size("members") > 0) & (F.size("queries") > 0))
        .select("members", "queries")
    )


def _searched(coded: DataFrame, index, width: int, n: int) -> DataFrame:
    """``_linked`` of all pairs of blocks.

    How often vectors are sent grows with the square of the table where they spread over many lists. They are
    sent in rounds of about as many as the table has, and what one sent goes before the next: disk
    stays in proportion to the table, however many rounds it takes.
    """
    block = max(BLOCK_ROWS, min(BLOCKS * BLOCK_ROWS, BLOCK_VALUES // width))
    pairs = max(1, max(n, ROUND_VALUES // width) // (2 * block))
    path = scratch_path(coded.sparkSession, "links")
    for groups, low, high in _rounds(_sizes(coded, block), pairs):
        # Joined to few files: there may be many rounds.
        added(_linked(_blocks(coded, groups, low, high), index, width).hint("rebalance"), path)
    return coded.sparkSession.read.schema("node bigint, other bigint, links bigint").parquet(path)


def _sample(nodes: DataFrame, limit: int, width: int) -> np.ndarray:
    chosen = nodes.orderBy(F.xxhash64("vector"), "node").limit(limit).select("vector").toArrow()
    return _unit(_matrix(chosen.column("vector").combine_chunks(), width))


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    training_rows: int = TRAINING_ROWS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Links are pairs of cosine >= 0.9, in double precision, found through an index of product
    quantisation: inverted lists around coarse centres, codes of the residuals, table
    look-up distances, exact cosines last. It is fitted on at most ``training_rows`` vectors (fewer if
    wider than 256) and holds all. ``n_links`` counts other rows directly linked;
    a component is named by its smallest id, and the row of that id is kept.

    Equal vectors are one node and linked to each other. Null and empty
    vectors, zeros, and vectors that hold a null or a non-finite component link with nothing; nor do
    vectors of different lengths. Repeated ids are rows of their own; a row without an id links like any
    other, has the component of its links' ids (null if none has one) and isn't kept.
    An empty table gives no rows; other columns are not looked at.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    base = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector")
    )
    valid = F.coalesce(
        F.exists("vector", lambda v: v != 0)
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))),
        F.lit(False),
    )
    nodes = stored(
        base.filter(valid)
        .groupBy("vector")
        .agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("weight"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    alone = base.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not size.n:
        return alone.withColumn("kept", F.col("vec_id").isNotNull())
    of_nodes = nodes.select("node", F.col("vector").alias("_vector"))
    of_rows = base.join(of_nodes, F.when(valid, F.col("vector")) == F.col("_vector"), "left").select("vec_id", "node")
    of_rows = stored(of_rows, "rows")
    limit = min(training_rows, max(CODES, training_rows * 256 // size.width))
    lists = min(MOST_LISTS, -(-size.n // LIST_ROWS))
    index = spark.sparkContext.broadcast(_fit(_sample(nodes, limit, size.width), lists))
    coded = stored(_coded(nodes, index, size.width, kind).sortWithinPartitions("list"), "coded")
    # From here on vectors are read from where they are coded, and rows go by their node.
    known = stored(nodes.drop("vector"), "known")
    dropped(nodes)
    found = _searched(coded, index, size.width, size.n)
    dropped(coded)
    links = found.groupBy(F.col("node").alias("_node")).agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    groups = stored(groups, "components").select(F.col("node").alias("_member"), "component")
    named = (
        known.join(links, known["node"] == links["_node"], "left")
        .join(groups, known["node"] == groups["_member"], "left")
        .select(
            "node",
            "first_id",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component"),
        )
    )
    roots = (
        named.groupBy(F.col("component").alias("root"))
        .agg(F.min("first_id").alias("component_id"))
        .hint("rebalance")
    )
    labels = named.join(roots, named["component"] == roots["root"]).select(
        F.col("node").alias("_labelled"), F.col("n_links").alias("links"), F.col("component_id").alias("component")
    )
    labels = stored(labels, "labels")
    return (
        of_rows.join(labels, F.col("node") == F.col("_labelled"), "left")
        .select(
            "vec_id",
            F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
            F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def op7_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
