"""The prefix trie of conversations: nodes are distinct sequences of first turns.

A prefix is known by a digest: 128 bits of sums over hashes of (place, turn), so a
conversation's prefix digests are running sums and a very long conversation is no single
task's work. One table holds each digest's least conversation (its owner) and its members,
another each conversation's digests by place; both are bucketed by what they are asked by. A
conversation that owns a prefix owns its longer ones too, so its first owned depth is found by
binary search: each round looks all conversations' middle depths up in two batched joins. The
owned depths of a conversation are a chain; chains hang on the chain that owns the prefix
before their first depth. Sums over subtrees are taken chain by chain from the bottom up, by
doubling distances, so that the rounds are the logarithm of the tree's height in chains.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm._common import bucketed, cut, drop_table, free_name, join_spread, positions, running

#: Ids that one row of a list of members carries.
IDS = 4096


def numbered_turns(convs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 1), digest of (role, text) and size (code points of the text) of each turn.

    Turns go by ``turn``, null first; those of one number by role and digest, a fixed order.
    Null roles and texts become empty. Rows without a conversation belong to none and go.
    """
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    slim = convs.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        by.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256)).alias("digest"),
        F.length(said).cast("long").alias("size"),
    )
    placed = positions(slim, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], ["conv_id"])
    return placed.select("conv_id", F.col("pos").cast("long").alias("pos"), "digest", "size")


def with_shared_heads(turns: DataFrame, every: int, at_most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are replaced by those of a common one; their turns and members.

    Conversation c starts with the first h turns of c - c % ``every`` (all if it has fewer, none
    if there is none) and goes on with its own turns after its first h; h is the crc32 of its
    decimal id modulo ``at_most``. members has conv_id and length, of those without turns too.
    """
    turns = cut(turns, "turns")
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % at_most
    base = F.col("conv_id") - F.col("conv_id") % every
    plan = lengths.select("conv_id", "own", head.alias("h"), base.alias("base"))
    plan = plan.join(lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own")), "base", "left")
    plan = plan.withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0).cast("long"))))
    plan = cut(plan.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "heads")
    total = turns.count()
    rest = join_spread(turns, plan.select("conv_id", "h", "taken", "own"), ["conv_id"], "own", total).where("pos > h")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "size")
    heads = turns.where((F.col("pos") < at_most) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    first = plan.select("conv_id", "base", "taken").join(heads, "base").where("pos <= taken").select("conv_id", "pos", "digest", "size")
    return rest.unionByName(first), plan.select("conv_id", "length")


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos, k and l (128 bits of the first pos turns) and size of the last of them."""
    half = lambda salt: F.xxhash64(F.lit(salt), "pos", "digest")
    lanes = turns.select("conv_id", "pos", "size", half("a").alias("x"), half("b").alias("y"))
    low = F.lit(0xFFFFFFFF).cast("long")
    # halves of 32 bits, so that sums over two thousand million turns stay within a long
    lanes = lanes.select(
        "conv_id", "pos", "size",
        F.shiftrightunsigned("x", 32).alias("s0"), F.col("x").bitwiseAND(low).alias("s1"),
        F.shiftrightunsigned("y", 32).alias("s2"), F.col("y").bitwiseAND(low).alias("s3"),
    )
    sums = ["s0", "s1", "s2", "s3"]
    done = running(lanes, "conv_id", "pos", sums)
    return done.select("conv_id", "pos", "size", F.xxhash64("pos", *sums).alias("k"), F.xxhash64(F.lit("l"), *reversed(sums), "pos").alias("l"))


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each node: each distinct sequence of first turns, and the root without turns.

    ``turns`` has conv_id, pos (1, 2, ... in each), digest and size; ``members`` conv_id and
    length (0 too) of every conversation. Returned are conv_id, the least member; depth;
    parent_conv_id; n_convs, members; n_children; n_leaves, nodes without children in the
    subtree; saved_tokens, over the subtree the sizes of last turns that members after the first
    repeat; ends_sha256, of the comma-joined ids in ascending order of the members that end
    here. No conversations give no rows.
    """
    spark = turns.sparkSession
    members = cut(members, "members")
    n_members, first, longest = members.agg(F.count("*"), F.min("conv_id"), F.max("length")).first()
    prefixes, prefix_table = bucketed(_prefixes(turns), "prefixes", ["conv_id", "pos"])
    owners = prefixes.groupBy("k", "l").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n"), F.max("pos").alias("pos"), F.max("size").alias("size"))
    minima, minima_table = bucketed(owners, "minima", ["k", "l"])

    def owned_by(asked: DataFrame) -> DataFrame:
        """``asked`` (conv_id, pos and more; pos over 0) with the owner of the prefix of pos turns."""
        digests = prefixes.select("conv_id", "pos", "k", "l").join(asked, ["conv_id", "pos"])
        return join_spread(digests, minima.select("k", "l", "owner", "n"), ["k", "l"], "n", n_members).drop("k", "l", "n")

    # the first owned depth of each conversation is in [low, high]; high is its length + 1 if it owns none
    state = members.select("conv_id", "length", F.lit(1).cast("long").alias("low"), (F.col("length") + 1).alias("high"))
    for _ in range((longest or 0).bit_length()):
        middle = F.floor((F.col("low") + F.col("high")) / 2).alias("pos")
        asked = owned_by(state.where("low < high").select("*", middle))
        mine = F.col("owner") == F.col("conv_id")
        step = asked.select("conv_id", "length", F.when(mine, F.col("low")).otherwise(F.col("pos") + 1).alias("low"), F.when(mine, F.col("pos")).otherwise(F.col("high")).alias("high"))
        state = cut(step.unionByName(state.where("low >= high")), "search")
    root = F.col("conv_id") == F.lit(first)
    start = F.when(root, 0).otherwise(F.col("low")).cast("long").alias("start")
    state = cut(state.select("conv_id", "length", start), "starts")
    chains = state.where("start <= length")

    # where a chain hangs: the owner of the prefix before its first depth
    top = chains.where("start = 1").select("conv_id", "length", "start", F.lit(first).cast("long").alias("parent"))
    below = owned_by(chains.where("start > 1").withColumn("pos", F.col("start") - 1)).select("conv_id", "length", "start", F.col("owner").alias("parent"))
    none = chains.where("start = 0").withColumn("parent", F.lit(None).cast("long"))
    chains = cut(top.unionByName(below).unionByName(none), "chains")
    hanging = chains.where("parent is not null").select(F.col("parent").alias("owner"), (F.col("start") - 1).alias("pos"), "conv_id")

    nodes = minima.select("owner", "pos", "n", "size")
    if first is not None:
        nodes = nodes.unionByName(spark.createDataFrame([(first, 0, n_members, 0)], nodes.schema))
    branches = hanging.groupBy("owner", "pos").agg(F.count("*").alias("branches"))
    sizes = nodes.groupBy("owner").agg(F.count("*").alias("nodes"), F.sum((F.col("n") - 1) * F.col("size")).alias("saved"))
    ends = chains.join(branches, (F.col("conv_id") == F.col("owner")) & (F.col("length") == F.col("pos")), "left").select("conv_id", "parent", F.col("branches").isNull().cast("long").alias("leaves"))
    sums = cut(ends.join(sizes.withColumnRenamed("owner", "conv_id"), "conv_id").select("conv_id", "parent", "leaves", "saved"), "chain-sums")
    totals = _subtree_sums(sums)

    hung = hanging.join(totals, "conv_id").groupBy("owner", "pos").agg(F.count("*").alias("branches"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    about = chains.select(F.col("conv_id").alias("owner"), "length", "start", "parent").join(sizes.select("owner", "nodes"), "owner")
    n_nodes = sizes.agg(F.coalesce(F.sum("nodes"), F.lit(0))).first()[0]
    nodes = join_spread(nodes.join(hung, ["owner", "pos"], "left"), about, ["owner"], "nodes", n_nodes)
    branches, last = F.coalesce("branches", F.lit(0)), F.col("pos") == F.col("length")
    nodes = nodes.select(
        "owner", "pos", "n",
        F.when(F.col("pos") > F.col("start"), F.col("owner")).otherwise(F.col("parent")).alias("parent_conv_id"),
        (branches + F.when(last, 0).otherwise(1)).cast("long").alias("n_children"),
        (F.coalesce("leaves", F.lit(0)) + F.when(last & (branches == 0), 1).otherwise(0)).alias("n_leaves"),
        (F.coalesce("saved", F.lit(0)) + (F.col("n") - 1) * F.col("size")).alias("saved_tokens"),
    )
    nodes = running(nodes, "owner", "pos", ["n_leaves", "saved_tokens"], backwards=True)

    # where conversations end: owners at their own last node, the others at that of an equal one
    own = state.where("start <= length").select(F.col("conv_id").alias("owner"), F.col("length").alias("pos"), "conv_id")
    other = owned_by(state.where("start > length and length > 0").withColumn("pos", F.col("length"))).select("owner", "pos", "conv_id")
    bare = state.where("start > length and length = 0").select(F.lit(first).cast("long").alias("owner"), F.lit(0).cast("long").alias("pos"), "conv_id")
    hashes = joined_hashes(own.unionByName(other).unionByName(bare), ["owner", "pos"], "conv_id")
    out = nodes.join(hashes, ["owner", "pos"], "left")
    out = out.select(
        F.col("owner").alias("conv_id"), F.col("pos").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    out = cut(out, "trie")
    drop_table(spark, prefix_table)
    drop_table(spark, minima_table)
    return out


def _subtree_sums(rows: DataFrame) -> DataFrame:
    """conv_id with leaves and saved summed over itself and all below it; ``rows`` have parents.

    After round k a row has the sums of what is less than 2^k below it, and its ancestor 2^k
    above; what hangs on that ancestor has the sums that it lacks.
    """
    state = rows.withColumnRenamed("parent", "up")
    while True:
        lifted = cut(state.where("up is not null").groupBy("up").agg(F.count("*").alias("n"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")), "lifted")
        count = lifted.agg(F.sum("n")).first()[0]
        if not count:
            return state.select("conv_id", "leaves", "saved")
        more = state.join(lifted.withColumnRenamed("up", "conv_id"), "conv_id", "left")
        summed = more.select("conv_id", "up", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        above = lifted.select("up", "n").join(state.select(F.col("conv_id").alias("up"), F.col("up").alias("next")), "up")
        jumped = join_spread(summed.where("up is not null"), above, ["up"], "n", count).select("conv_id", F.col("next").alias("up"), "leaves", "saved")
        state = cut(jumped.unionByName(summed.where("up is null")), "subtree-sums")


def joined_hashes(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each of ``keys`` the SHA-256 (lowercase hex) of its decimal values in ascending order, comma-joined.

    Ranges of values become texts of at most ``IDS`` of them in parallel; the hash, which can
    only be taken in order, then reads a key's texts one after the other and holds one at a time.
    """
    part, first, joined = free_name(rows, "part"), "first", "joined"
    ranged = rows.repartitionByRange(*keys, value).withColumn(part, F.spark_partition_id())
    names = [part, *keys]
    block_schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString() if n in keys else 'int'}" for n in names) + f", {first} long, {joined} string"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, ids = [], None, []
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in names]
            for key, v in zip(zip(*columns), batch.column(value).to_pylist()):
                if key != at or len(ids) == IDS:
                    if ids:
                        out.append((*at, ids[0], ",".join(map(str, ids))))
                    at, ids = key, []
                ids.append(v)
            yield _batch(out, [*names, first, joined], batch)
            out = []
        if ids:
            yield _batch([(*at, ids[0], ",".join(map(str, ids)))], [*names, first, joined], None)

    def _batch(found, columns, _):
        kinds = [pa.int32(), *[pa.int64()] * len(keys), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found)) or [[]] * len(columns), kinds)], columns)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, kinds = None, None, [*[pa.int64()] * len(keys), pa.string()]
        for batch in batches:
            out = []
            for key, text in zip(zip(*[batch.column(k).to_pylist() for k in keys]), batch.column(joined).to_pylist()):
                if key != at:
                    if state is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [*keys, "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*at, state.hexdigest()), kinds)], [*keys, "sha256"])

    texts = ranged.sortWithinPartitions(*keys, value).mapInArrow(blocks, block_schema)
    dealt = texts.repartition(*keys).sortWithinPartitions(*keys, first)
    return dealt.mapInArrow(hashed, ", ".join(f"{k} long" for k in keys) + ", sha256 string")


#: crc32 of a small number's decimal digits, by the polynomial's rule.
_CRC = """
crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
)
"""

#: The same in SQL: prefixes as joined hashes of turns, subtrees by the ancestors of each node.
TRIE_SQL = f"""
WITH {_CRC.strip()},
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL
),
lengths AS (SELECT conv_id, max(pos) AS own FROM turns GROUP BY 1),
heads AS (
  SELECT l.conv_id, own, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 6 AS h
  FROM lengths l, crc_table
),
plan AS (
  SELECT h.*, least(h.h, coalesce(b.own, 0)) AS taken FROM heads h LEFT JOIN lengths b ON b.conv_id = h.base
),
rebuilt AS (
  SELECT p.conv_id, t.pos, t.digest, t.size FROM plan p JOIN turns t ON t.conv_id = p.base AND t.pos <= p.taken
  UNION ALL
  SELECT p.conv_id, t.pos - p.h + p.taken, t.digest, t.size FROM plan p JOIN turns t ON t.conv_id = p.conv_id AND t.pos > p.h
),
prefixes AS (
  SELECT conv_id, pos, size, sha256(string_agg(digest, ',') OVER (PARTITION BY conv_id ORDER BY pos)) AS k FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM plan
),
nodes AS (SELECT k, min(conv_id) AS conv_id, max(pos) AS depth, count(*) AS n, max(size) AS size FROM prefixes GROUP BY k),
up AS (
  SELECT n.k, p.k AS above, n.depth, p.pos FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.pos <= n.depth
),
parents AS (SELECT u.k, m.conv_id AS parent_conv_id, u.above FROM up u JOIN nodes m ON m.k = u.above WHERE u.pos = u.depth - 1),
children AS (SELECT above AS k, count(*) AS n_children FROM parents GROUP BY 1),
below AS (
  SELECT u.above AS k, count(*) FILTER (c.n_children IS NULL) AS n_leaves, sum((n.n - 1) * n.size)::BIGINT AS saved_tokens
  FROM up u JOIN nodes n ON n.k = u.k LEFT JOIN children c ON c.k = u.k GROUP BY 1
),
lasts AS (SELECT conv_id, max_by(k, pos) AS k FROM prefixes GROUP BY 1),
ends AS (SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM lasts GROUP BY 1)
SELECT n.conv_id, n.depth, p.parent_conv_id, n.n AS n_convs, coalesce(c.n_children, 0) AS n_children, b.n_leaves, b.saved_tokens,
  sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN below b USING (k) LEFT JOIN parents p USING (k) LEFT JOIN children c USING (k) LEFT JOIN ends e USING (k)
"""
