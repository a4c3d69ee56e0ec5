"""Trie of conversations that are rebuilt from the head of another one and their own rest.

The fingerprint of a run of turns is an element of a monoid: its length n and h = sum of t_i * B^i modulo a prime, t_i
standing for turn i. (n, h) * (m, g) = (n + m, h + B^n * g), so the fingerprint of every prefix of every stored
conversation comes from products of runs, taken inside ranges of rows and then over ranges. A rebuilt
conversation is never put together: the fingerprints of its prefixes are products of a prefix of the base and a
part of its own turns (a prefix divided by a shorter one), by arithmetic on numbers.

Prefixes of equal depth and fingerprint are one node. Each holds a reference to the turn it ends with; a group
whose references differ, or a reference that stands for two different stored turns, restarts with other primes' bases,
so that no collision reaches the result.

The smallest member of a node owns it. What a conversation owns is the lower end of its own path, and every node
below v is owned by a member of v; sums over subtrees are therefore sums over members of running totals along
their paths, and need no walk over levels.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.offsets import with_running_totals
from shelfline.operators.skew import skewed_join
from shelfline.session import stage

PRIMES = (2147483647, 2147483629)
NODE = ["depth", "h0", "h1"]
#: Conversation ids that are joined into one string before a node's digest is taken.
END_BITS = 12
POWER_BITS = 40


def _power(base: int, prime: int, n: Column) -> Column:
    """`base` to the power of `n`, modulo `prime`."""
    squares = F.array(*(F.lit(pow(base, 1 << k, prime)).cast("bigint") for k in range(POWER_BITS)))
    bit = lambda k: F.call_function("shiftright", n, k).bitwiseAND(F.lit(1))
    factors = F.transform(squares, lambda s, k: F.when(bit(k) == 1, s).otherwise(F.lit(1)))
    return F.aggregate(factors, F.lit(1).cast("bigint"), lambda a, s: a * s % F.lit(prime).cast("bigint"))


def _mod(x: Column, prime: int) -> Column:
    return F.pmod(x, F.lit(prime).cast("bigint"))


def _stored_turns(turns: DataFrame, seed: int) -> DataFrame:
    """`conv, x0, x1, words, place`: turns in order; `place` counts up along the table, its high bits being a range."""
    rows = turns.repartitionByRange("conv", F.col("turn").asc_nulls_first(), F.left("role", F.lit(32)), F.left("text", F.lit(32)))
    rows = rows.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select(
        "conv", *_identity(seed), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
        F.monotonically_increasing_id().alias("place"),
    )


def _identity(seed: int) -> list[Column]:
    return [
        F.xxhash64(F.lit(seed), "role", "text").alias("x0"),
        F.xxhash64(F.lit(seed + 1), "text", "role").alias("x1"),
    ]


def _prefixes(stored: DataFrame, bases: list[int]) -> DataFrame:
    """`conv, i, h0, h1, x0, x1, words`: fingerprint of the first `i` turns of each stored conversation, i from 1."""
    spans = stored.withColumn("span", F.shiftright("place", 33))
    run = Window.partitionBy("span", "conv").orderBy("place")
    local = spans.withColumn("j", (F.row_number().over(run) - 1).cast("bigint"))
    for k, (b, p) in enumerate(zip(bases, PRIMES, strict=True)):
        local = local.withColumn(f"t{k}", _mod(_mod(F.col(f"x{k}"), p) * _power(b, p, F.col("j")), p))
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    local = stage(local.withColumns({f"s{k}": _mod(F.sum(f"t{k}").over(upto), p) for k, p in enumerate(PRIMES)}).drop("t0", "t1"), "turns")
    # The product of each run of a conversation inside a range, and the products of all runs before it.
    runs = local.groupBy("conv", "span").agg(F.count("*").alias("n"), F.max_by(F.struct("s0", "s1"), "j").alias("s"))
    before = Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("n0", F.coalesce(F.sum("n").over(before), F.lit(0)))
    for k, (b, p) in enumerate(zip(bases, PRIMES, strict=True)):
        shifted = _mod(F.col(f"s.s{k}") * _power(b, p, F.col("n0")), p)
        runs = runs.withColumn(f"p{k}", shifted)
    runs = runs.select("conv", "span", "n0", *(F.coalesce(_mod(F.sum(f"p{k}").over(before), p), F.lit(0)).alias(f"g{k}") for k, p in enumerate(PRIMES)))
    whole = local.join(runs, ["conv", "span"])
    return whole.select(
        "conv", (F.col("n0") + F.col("j") + 1).alias("i"),
        *(_mod(F.col(f"g{k}") + F.col(f"s{k}") * _power(b, p, F.col("n0")), p).alias(f"h{k}") for k, (b, p) in enumerate(zip(bases, PRIMES, strict=True))),
        "x0", "x1", "words",
    )


def _plan(prefixes: DataFrame, base: Column, head: Column, bases: list[int]) -> DataFrame:
    """One row for each conversation: its base, how much of it is taken, and the fingerprints at the cut."""
    sizes = stage(prefixes.groupBy("conv").agg(F.max("i").alias("n")), "sizes")
    plan = sizes.select("conv", "n", base.cast("bigint").alias("base"), F.greatest(F.lit(0), head.cast("bigint")).alias("h"))
    plan = skewed_join(plan, sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), ["base"], stored=True)
    plan = plan.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("own_at", F.least("h", "n"))
    at = prefixes.select("conv", "i", "h0", "h1")
    names = {"conv": "base", "i": "taken", "h0": "b0", "h1": "b1"}
    plan = skewed_join(plan, at.withColumnsRenamed(names), ["base", "taken"], stored=True)
    plan = skewed_join(plan, at.withColumnsRenamed({"i": "own_at", "h0": "o0", "h1": "o1"}), ["conv", "own_at"], stored=True)
    return plan.select(
        "conv", "n", "base", "h", "taken", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("b0", "b1", "o0", "o1")),
        (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("size"),
    )


def _rebuilt(prefixes: DataFrame, plan: DataFrame, bases: list[int]) -> DataFrame:
    """`conv, depth, h0, h1, x0, x1, words, ends`: every prefix of every rebuilt conversation, the empty one included."""
    none = F.lit(0).cast("bigint")
    roots = plan.select("conv", none.alias("depth"), none.alias("h0"), none.alias("h1"), none.alias("x0"), none.alias("x1"),
                        none.alias("words"), (F.col("size") == 0).alias("ends"))
    asked = plan.filter("taken > 0").select("conv", "base", "size", F.explode(F.sequence(F.lit(1).cast("bigint"), "taken")).alias("depth"))
    heads = skewed_join(asked, prefixes.withColumnsRenamed({"conv": "base", "i": "depth"}), ["base", "depth"], "inner", stored=True)
    heads = heads.select("conv", "depth", "h0", "h1", "x0", "x1", "words", (F.col("depth") == F.col("size")).alias("ends"))
    own = skewed_join(prefixes, plan, ["conv"], "inner", stored=True).filter("i > h")
    depth = F.col("taken") + F.col("i") - F.col("h")
    joined = []
    for k, (b, p) in enumerate(zip(bases, PRIMES, strict=True)):
        part = _mod(F.col(f"h{k}") - F.col(f"o{k}"), p)
        moved = _mod(part * _power(pow(b, -1, p), p, F.col("h") - F.col("taken")), p)
        joined.append(_mod(F.col(f"b{k}") + moved, p).alias(f"h{k}"))
    own = own.select("conv", depth.alias("depth"), *joined, "x0", "x1", "words", (depth == F.col("size")).alias("ends"))
    return roots.unionByName(heads).unionByName(own)


def _digests(ends: DataFrame) -> DataFrame:
    """`depth, h0, h1, ends_sha256`: digest of the ids, ascending and comma-joined, of each node's rows of `ends`.

    Ids are sorted and written in blocks of a range of ids; one pass over blocks in order then feeds the digest, which
    holds none of them.
    """
    blocks = ends.groupBy(*NODE, F.shiftright("conv", END_BITS).alias("block")).agg(
        F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(done: list) -> pa.RecordBatch:
            cols = [pa.array([d[k] for d in done], pa.int64()) for k in range(3)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([d[3] for d in done], pa.string())], [*NODE, "ends_sha256"])

        node, sha = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if key == node:
                    sha.update(b",")
                else:
                    if node is not None:
                        done.append((*node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256()
                sha.update(ids.encode())
            yield closed(done)
        if node is not None:
            yield closed([(*node, sha.hexdigest())])

    ordered = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block")
    return ordered.mapInArrow(digest, "depth bigint, h0 bigint, h1 bigint, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame, base: Column | None = None, head: Column | None = None, conv_id: str = "conv_id",
    turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations.

    `base` and `head` are columns over `conv`, the id: the first `head` turns come from the stored conversation
    `base` (fewer if it has fewer, none if it is not there), the others are the conversation's own turns after its first
    `head`. Without them conversations stay as they are.

    Columns: `conv_id` (smallest member), `depth`, `parent_conv_id`, `n_convs`, `n_children`, `n_leaves`,
    `saved_tokens`, `ends_sha256`. A null role or text is empty; turns are ordered by `turn`, null first, then
    role and text, so repeated rows are turns one after another; rows without a conversation id belong to no
    conversation; an empty table has no members and no nodes; other columns are not read, whatever they are
    called. Ids are read as 64-bit integers.
    """
    base = F.col("conv") if base is None else base
    head = F.lit(0) if head is None else head
    turns = conversations.select(
        F.col(conv_id).cast("bigint").alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).filter("conv is not null")
    seed = 1
    while True:
        made = random.Random(seed)
        bases = [made.randrange(1 << 20, p - 1) for p in PRIMES]
        prefixes = stage(_prefixes(stage(_stored_turns(turns, seed), "places"), bases), "prefixes")
        plan = stage(_plan(prefixes, base, head, bases), "plan")
        rows = stage(_rebuilt(prefixes, plan, bases), "rebuilt")
        groups = rows.groupBy(*NODE).agg(
            F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.max("words").alias("words"),
            *(f(c).alias(f"{f.__name__}_{c}") for c in ("x0", "x1") for f in (F.min, F.max)),
        )
        nodes = stage(groups, "nodes")
        # Turns that share a reference are the same stored turn, and so are the last turns of a node's members.
        said = turns.select(*_identity(seed), F.struct("role", "text").alias("said")).groupBy("x0", "x1")
        unlike = said.agg(F.min("said").alias("a"), F.max("said").alias("b")).filter("a <> b")
        if nodes.filter("min_x0 <> max_x0 or min_x1 <> max_x1").isEmpty() and unlike.isEmpty():
            break
        seed += 2
    up = [
        _mod(F.col(f"h{k}") - _mod(F.col(f"min_x{k}"), p) * _power(b, p, F.col("depth") - 1), p).alias(f"up{k}")
        for k, (b, p) in enumerate(zip(bases, PRIMES, strict=True))
    ]
    keys = nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id"))
    # Under names of their own first: a lambda would read a column of this select rather than the table's.
    below = nodes.filter("depth > 0").select("conv_id", F.col("depth").alias("own"), *up)
    below = below.select("conv_id", "own", (F.col("own") - 1).alias("depth"), F.col("up0").alias("h0"), F.col("up1").alias("h1"))
    parents = stage(skewed_join(below, keys, NODE, "inner", stored=True).select("conv_id", "own", "parent_conv_id"), "parents")
    children = parents.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("own") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    linked = (
        nodes.select(*NODE, "conv_id", "n_convs", "words")
        .join(parents.withColumnRenamed("own", "depth"), ["conv_id", "depth"], "left")
        .join(children, ["conv_id", "depth"], "left")
    ).withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    linked = stage(linked, "linked")
    owned = linked.select(
        F.col("conv_id").alias("conv"), "depth", (F.col("n_children") == 0).cast("bigint").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    along = rows.select("conv", *NODE).join(owned, ["conv", "depth"], "left").fillna(0, ["leaf", "saved"])
    along = with_running_totals(along, {"leaves": "leaf", "savings": "saved"}, [F.desc("depth")], ["conv"], "paths")
    sums = along.groupBy(*NODE).agg(
        F.sum(F.col("leaves") + F.col("leaf")).alias("n_leaves"), F.sum(F.col("savings") + F.col("saved")).alias("saved_tokens")
    )
    ended = _digests(rows.filter("ends").select("conv", *NODE))
    return linked.join(sums, NODE).join(ended, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


#: The head of every conversation is that of the first one of its twenty, as long as a checksum of its id says.
GROUP, HEADS = 20, 4


def conversation_report(conversations: DataFrame) -> DataFrame:
    """`prefix_trie` of conversations whose first turns come from the first of each group of ids."""
    conv = F.col("conv")
    return prefix_trie(conversations, conv - conv % GROUP, F.crc32(conv.cast("string").cast("binary")) % HEADS)


SQL = r"""
WITH own AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), crc AS (
  SELECT conv_id, s, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda a, b: list_reduce([xor(a, b), 1, 2, 3, 4, 5, 6, 7, 8],
      lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END)) AS left_over
  FROM own
), cut AS (SELECT conv_id, s, xor(left_over, CAST(4294967295 AS BIGINT)) % 4 AS h FROM crc),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.s[1:h], []), c.s[h + 1:]) AS s
  FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
), member AS (
  SELECT conv_id, depth, s[1:depth] AS path, depth = len(s) AS ends
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM rebuilt)
), node AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS done,
         CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(path[depth].t, '[^\x20\x09-\x0D]+')) END AS words
  FROM member GROUP BY path, depth
), child AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
spread AS (
  SELECT path[1:k] AS path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT n.path, (coalesce(n_children, 0) = 0)::BIGINT AS leaf, (n_convs - 1) * words AS saved,
               unnest(range(0, depth + 1)) AS k
        FROM node n LEFT JOIN child ON child.path = n.path) GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.done) AS ends_sha256
FROM node n JOIN spread ON spread.path = n.path LEFT JOIN child ON child.path = n.path
LEFT JOIN node p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""
