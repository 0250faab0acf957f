"""A trie of conversations' prefixes, summed up by heavy-path decomposition.

Each conversation is rebuilt: it begins as the first one of its group of five does, and goes on by itself. Rebuilt
conversations that begin alike share the nodes of their common turns. A node is known by its depth and two 64-bit hashes of
its turns, each joined with its place, so a conversation's nodes are running XORs along its rows.

Sums over subtrees need no walk from node to node. The child with the most members is a node's heavy child; following
heavy children gives paths from a top down to a childless node. A light child has at most half of its parent's members, so
a conversation crosses at most log2(conversations) light edges, and the ones it crosses tell each of its nodes the top of its
path. Round by round, from the paths under the most light edges up, the rows of all paths of a round are summed from the
bottom to the top (suffix sums), and each top's sum is added to its parent, a node of a path of the next round.

Running sums (of places, hashes and paths) are worked out over rows dealt by ranges of (key, order): a long conversation
or path is spread over tasks, each sums its own rows, and one row a task tells the later ones what came before. Texts leave
the plan in the first stage as digests and lengths. The digest of a node's ends streams through SHA-256 in blocks of ids.

Defined results: rows of one conversation and turn are ordered by role, then by the MD5 of their text; repeated rows are turns
each for itself. A null turn comes first; rows with a null conv_id take no part. Places are counted from 1 whatever the
turns' numbers are. An empty table has no nodes, not even a root. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from gaugeline.llm._common import written

GROUP, HEADS = 5, 9  # conversations of a group; a conversation takes less than so many turns of its group's first
BLOCK_BITS = 12  # ids of a block of a node's ends: 4,096 at most


def running(rows: DataFrame, key: list[str], order: list[str], sums: list[str] = [], xors: list[str] = []) -> DataFrame:  # noqa: B006
    """rows with each column of sums and xors replaced by its running total over the rows of its key so far, in order.

    All columns must be longs without nulls. Rows are dealt by ranges of (key, order), so a key can lie in several tasks."""
    columns, schema = [*sums, *xors], StructType([*rows.schema.fields, StructField("__part", IntegerType()), StructField("__at", LongType())])
    to, names = to_arrow_schema(schema), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        held: tuple | None = None  # the last row's key
        before = dict.fromkeys(columns, 0)
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            keys = [batch.column(names.index(k)).to_numpy() for k in key]
            change = np.zeros(n, bool)
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            change[0] = held != tuple(k[0] for k in keys)
            starts = np.maximum.accumulate(np.where(change, np.arange(n), -1))
            out = dict(zip(names, batch.columns, strict=True))
            for c in columns:
                own = batch.column(names.index(c)).to_numpy()
                upto = np.cumsum(own) if c in sums else np.bitwise_xor.accumulate(own)
                gone = np.where(starts > 0, upto[starts - 1], 0)  # what earlier keys of this batch gave
                carry = np.where(starts < 0, np.int64(before[c]), 0)
                upto = upto - gone + carry if c in sums else upto ^ gone ^ carry
                before[c] = int(upto[-1])
                out[c] = pa.array(upto)
            held = tuple(k[-1] for k in keys)
            out["__part"], out["__at"] = pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))
            at += n
            yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in to], schema=to)

    dealt = rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    local = written(dealt.mapInArrow(run, schema), "local")
    # What each task's last key had in it, and in all tasks before it; the next task that has rows goes on from there.
    ends = local.groupBy("__part").agg(F.max_by(F.struct(*key, *columns), "__at").alias("end")).select("__part", "end.*")
    so_far = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    upto = [F.sum(c).over(so_far).alias(f"__{c}") for c in sums] + [F.bit_xor(c).over(so_far).alias(f"__{c}") for c in xors]
    carried = ends.withColumn("__next", F.lead("__part").over(Window.orderBy("__part"))).select(F.col("__next").alias("__part"), *key, *upto).where("__part IS NOT NULL")
    both = local.join(F.broadcast(carried), ["__part", *key], "left")  # a row a task
    none = F.lit(0).cast("long")
    whole = {c: F.col(c) + F.coalesce(F.col(f"__{c}"), none) for c in sums} | {c: F.col(c).bitwiseXOR(F.coalesce(F.col(f"__{c}"), none)) for c in xors}
    return both.withColumns(whole).select(*names)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), a and b (hashes of role and text) and bytes (of the text) of each turn."""
    c, role, text = F.col("conv_id").cast("long"), F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    number = F.col("turn").cast("long")
    digest = F.md5(text)
    rows = conversations.where(c.isNotNull()).select(
        c.alias("conv_id"), F.when(number.isNull(), 0).otherwise(1).alias("known"), F.coalesce(number, F.lit(0)).alias("turn"), role.alias("role"), digest.alias("digest"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("place"),
    )
    return running(written(rows, "turns"), ["conv_id"], ["known", "turn", "role", "digest"], sums=["place"]).select("conv_id", "place", "a", "b", "bytes")


def heads_taken(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame, all_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, depth, a, b, bytes, and last: 1 for the last one), and conv_id with depth_all, how many it has, of every conversation."""
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    own = all_ids.join(counts, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).alias("n"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("first"), heads_taken(F.col("conv_id")).alias("h"))
    of_first = own.where("conv_id = first").select("first", F.col("n").alias("n_first"))
    lengths = own.join(of_first, "first", "left").select("conv_id", "first", "h", F.least("h", F.coalesce("n_first", F.lit(0))).alias("taken"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("rest"))
    lengths = written(lengths, "lengths")
    later = turns.join(lengths, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "a", "b", "bytes", (F.col("place") - F.col("h") == F.col("rest")).cast("long").alias("last"))
    heads = turns.where((F.col("place") < HEADS) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "first")
    begun = lengths.where("taken > 0").join(heads, "first").where("place <= h").select("conv_id", F.col("place").alias("depth"), "a", "b", "bytes", ((F.col("place") == F.col("taken")) & (F.col("rest") == 0)).cast("long").alias("last"))
    return later.unionByName(begun), lengths.select("conv_id", (F.col("taken") + F.col("rest")).alias("depth_all"))


def end_digests(ends: DataFrame, key: list[str]) -> DataFrame:
    """ends_sha256 of each key: its conv_ids in order, joined by commas. Blocks of ids stream through the hash."""
    block = F.shiftright("conv_id", BLOCK_BITS)
    blocks = ends.groupBy(*key, block.alias("__block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("__ids"))
    schema = StructType([*ends.select(*key).schema.fields, *StructType.fromDDL("ends_sha256 string").fields])
    to = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for *at, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at == now:
                    digest.update(f",{ids}".encode())
                    continue
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = at, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], f.type) for k, f in enumerate(to)], schema=to)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*now, digest.hexdigest()), to, strict=True)], schema=to)

    return blocks.repartition(*key).sortWithinPartitions(*key, "__block").select(*key, "__ids").mapInArrow(run, schema)


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node."""
    key, parent = ["depth", "a", "b"], ["up", "pa", "pb"]
    turns = turns_of(conversations)
    rows, lengths = rebuilt(turns, conversations.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id IS NOT NULL").distinct())
    here = lambda *names: [F.xxhash64(c, F.col("depth")).alias(n) for c, n in zip(("a", "b"), names, strict=True)]
    chains = written(rows.select("conv_id", "depth", *here("a", "b"), *here("pa", "pb"), "bytes", "last"), "chains")
    # a and b run over the turns so far; without this turn's own they are the parent's.
    steps = running(chains, ["conv_id"], ["depth"], xors=["a", "b"])
    steps = written(steps.select("conv_id", *key, (F.col("depth") - 1).alias("up"), F.col("a").bitwiseXOR(F.col("pa")).alias("pa"), F.col("b").bitwiseXOR(F.col("pb")).alias("pb"), "bytes", "last"), "steps")

    known = [F.any_value(c).alias(c) for c in (*parent, "bytes")]
    below = steps.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *known)
    zero = F.lit(0).cast("long")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*(zero.alias(c) for c in key), "conv_id", "n_convs", *(F.lit(None).cast("long").alias(c) for c in parent), zero.alias("bytes"))
    nodes = written(below.unionByName(root), "nodes")
    # The heavy child has the most members, of equals the least conv_id, which names one node of a depth.
    kids = nodes.where("up IS NOT NULL").groupBy(*parent).agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", F.bitwise_not("conv_id").alias("least"))).alias("most"))
    kids = kids.select(*(F.col(p).alias(k) for p, k in zip(parent, key, strict=True)), "n_children", F.bitwise_not("most.least").alias("heavy"))
    about = written(nodes.join(kids, key, "left"), "about")
    # A node can have a great many children; large partitions of such a join are split by the engine.
    ups = about.select(*(F.col(k).alias(p) for k, p in zip(key, parent, strict=True)), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("parent_heavy"))
    linked = written(about.join(ups, parent, "left").select("conv_id", *key, "n_convs", "bytes", F.coalesce("n_children", zero).alias("n_children"), "parent_conv_id", F.coalesce(F.col("conv_id") != F.col("parent_heavy"), F.lit(False)).alias("light")), "linked")

    # The light nodes that a conversation passes, in order; at most log2 of the conversations.
    light = linked.where("light").select(*key, F.col("conv_id").alias("top"))
    crossed = steps.select("conv_id", *key).join(light, key).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "top"))).alias("crossed"))
    tops = F.coalesce(F.filter("crossed", lambda x: x["depth"] <= F.col("depth")), F.array().cast("array<struct<depth:bigint,top:bigint>>"))
    least = F.lit(lengths.agg(F.min("conv_id")).first()[0]).cast("long")
    last = F.when(F.size("tops") > 0, F.element_at("tops", -1)).otherwise(F.struct(zero.alias("depth"), least.alias("top")))
    on_paths = linked.join(crossed, "conv_id", "left").withColumn("tops", tops).withColumn("last", last)
    on_paths = on_paths.select("conv_id", *key, "n_convs", "n_children", "parent_conv_id", F.col("last.top").alias("top"), F.col("last.depth").alias("top_depth"), F.size("tops").alias("level"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    on_paths = written(on_paths.repartitionByRange("level", "conv_id", "depth").sortWithinPartitions("level"), "paths")

    sums = ["n_leaves", "saved_tokens"]
    done, gained = None, None
    for level in sorted((r.level for r in on_paths.select("level").distinct().collect()), reverse=True):
        own = on_paths.where(F.col("level") == level)
        if gained is not None:
            own = own.join(gained, ["conv_id", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"__{c}", zero) for c in sums}).select(*on_paths.columns)
        upward = written(own.select("conv_id", "depth", "top", "top_depth", (-F.col("depth")).alias("rise"), *sums, "parent_conv_id"), "upward")
        summed = written(running(upward, ["top", "top_depth"], ["rise"], sums=sums), "summed")
        tops = summed.where("depth = top_depth AND depth > 0")
        gained = tops.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(*(F.sum(c).alias(f"__{c}") for c in sums))
        part = summed.select("conv_id", "depth", *sums)
        done = part if done is None else done.unionByName(part)
    if done is None:
        done = on_paths.select("conv_id", "depth", *sums)

    turnless = lengths.where("depth_all = 0").select("conv_id", *(zero.alias(k) for k in key))
    ends = end_digests(turnless.unionByName(steps.where("last = 1").select("conv_id", *key)), key)
    told = on_paths.drop(*sums).join(done, ["conv_id", "depth"]).join(ends, key, "left")
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *sums, F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))



#: The same in DuckDB's SQL. A node is known by its depth and the list of its turns' digests.
ORACLE = """
WITH RECURSIVE crc_table AS (
  SELECT n, n AS v, 0 AS k FROM range(256) AS t(n) UNION ALL
  SELECT n, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END, k + 1 FROM crc_table WHERE k < 8),
crcs AS (SELECT list(v ORDER BY n) AS t FROM crc_table WHERE k = 8),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda r, b: xor(r // 256, t[xor(r % 256, b) + 1]))) % 9 AS h FROM (SELECT DISTINCT conv_id FROM o) AS d, crcs),
r AS (SELECT c.conv_id, o.place AS spot, role, text FROM convs AS c JOIN o ON o.conv_id = c.f AND place <= h UNION ALL
  SELECT c.conv_id, o.place + 100000 AS spot, role, text FROM convs AS c JOIN o USING (conv_id) WHERE place > h),
s AS (SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes, list(md5(role || chr(31) || text)) OVER w AS chain FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY spot)),
w AS (SELECT conv_id, depth, bytes, md5(array_to_string(chain, ',')) AS node, CASE WHEN depth > 1 THEN md5(array_to_string(chain[:-2], ',')) ELSE '' END AS up FROM s
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM convs),
l AS (SELECT conv_id, max(depth) AS deepest FROM w GROUP BY 1),
n AS (SELECT node, depth, any_value(up) AS up, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = deepest) AS ends FROM w JOIN l USING (conv_id) GROUP BY node, depth),
k AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
q AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
u AS (SELECT w.node, count(*) FILTER (q.n_children = 0) AS n_leaves, sum((q.n_convs - 1) * q.bytes)::BIGINT AS saved_tokens FROM q JOIN w ON w.conv_id = q.conv_id AND w.depth <= q.depth GROUP BY 1)
SELECT q.conv_id, q.depth, p.conv_id AS parent_conv_id, q.n_convs, q.n_children, n_leaves, saved_tokens, sha256(coalesce(q.ends, '')) AS ends_sha256
FROM q JOIN u USING (node) LEFT JOIN n AS p ON p.node = q.up
"""
