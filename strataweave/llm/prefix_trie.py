r"""Conversation prefix trie: which conversations share their first turns.

A node is a distinct sequence of first d turns; its members are the conversations that begin with it, and the
smallest one *owns* it. Who owns a node owns all deeper nodes of its own, so a conversation's nodes from
its *first owned depth* on are one chain, and the chains make up the tree: each node once, without a row for each pair of
conversation and shared node.

* Prefix digests (BLAKE2b of the turns' SHA-256, chained within blocks of ``BLOCK`` turns and from block to block) are held as one
  byte string for each block of a conversation.
* Minima: the smallest conversation of each digest, for digests of two and more, found with a map-side combine.
* The first owned depth is found by binary search: each round probes the middle digest of all conversations
  still open, in one join with the minima; log2 of the turns in a block many rounds.
* Chains are added up bottom-up: in round k each chain passes the sum over its descendants of less than 2**k generations
  to the chain 2**k generations above, so a tree of height h takes log2(h) joins. Sums within a chain run by block, then over blocks.

No conversation, node or group of copies is gathered in one place: turns are placed by a range shuffle, copies meet in
sums, and the ids of a node's members are joined by range, then streamed through its SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.operators.numbering import numbered
from strataweave.session import forget, materialize

#: turns in a block; bytes of a digest
BLOCK, DIGEST = 1024, 16
#: ids of one piece of a node's list: a range of as many numbers
ID_RANGE = 4096
ROOT = hashlib.blake2b(b"", digest_size=DIGEST).digest()


def _chain(before: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(before + turn, digest_size=DIGEST).digest()


def placed_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, digest, bytes) of each turn, pos from 1 on; (conv_id, n) of each conversation), both written.

    Turns go by ``turn`` (null first), ties by role and then by SHA-256; a null role or text is empty. Rows with a null conversation belong to none.
    """
    said = F.coalesce(F.col(text), F.lit("")).cast("binary")
    who = F.coalesce(F.col(role), F.lit("")).cast("binary")
    both = F.concat(F.octet_length(who).cast("string").cast("binary"), F.lit(":").cast("binary"), who, said)
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("_turn"), F.unhex(F.sha2(both, 256)).alias("digest"), F.octet_length(said).cast("long").alias("bytes"), F.coalesce(F.col(role), F.lit("")).alias("_role"))
    order = [F.col("conv_id"), F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("digest")]
    at = materialize(numbered(rows, "_at", *order).drop("_turn", "_role"), "turns")
    convs = materialize(at.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("_at").alias("_first")), "convs")
    turns = at.join(convs.select("conv_id", "_first"), "conv_id").select("conv_id", (F.col("_at") - F.col("_first") + 1).alias("pos"), "digest", "bytes")
    return turns, convs.select("conv_id", "n")


def spliced(turns: DataFrame, convs: DataFrame, block: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with the first h turns of conversation c - c % block in place of its own first h; h = crc32(decimal c) % modulus.

    All of the other's turns if it has fewer, none if it is absent. (turns, convs) as ``placed_turns`` gives them; a conversation may be left without turns.
    A turn of the other goes to less than ``block`` conversations, and only its first ``modulus`` - 1 turns do.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % block
    size = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = convs.select("conv_id", "n", h.alias("h"), base.alias("base")).join(size, "base", "left")
    plan = materialize(plan.select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own")), "plan")
    own = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where(F.col("pos") > F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes")
    heads = turns.where((F.col("conv_id") % block == 0) & (F.col("pos") < modulus)).withColumnRenamed("conv_id", "base")
    taken = heads.join(plan.select("conv_id", "base", "taken"), "base").where(F.col("pos") <= F.col("taken")).select("conv_id", "pos", "digest", "bytes")
    return own.unionByName(taken), plan.select("conv_id", (F.col("taken") + F.col("own")).alias("n"))


# -- digests -------------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, block, len, digests): digests chained from the root within each block. Rows sorted by conv_id, block, pos."""
    out: list[tuple] = []
    last, held, now = None, [], ROOT

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array([len(x) // DIGEST for x in columns[2]], pa.int64()), pa.array(columns[2], pa.binary())], names=["conv_id", "block", "len", "digests"])

    for b in batches:
        for c, k, d in zip(b.column("conv_id").to_pylist(), b.column("block").to_pylist(), b.column("digest").to_pylist(), strict=True):
            if (c, k) != last:
                if last is not None:
                    out.append((*last, b"".join(held)))
                last, held, now = (c, k), [], ROOT
                if len(out) >= 1000:
                    yield batch(out)
                    out = []
            now = _chain(now, d)
            held.append(now)
    if last is not None:
        out.append((*last, b"".join(held)))
    if out:
        yield batch(out)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, block, before): the digest of all turns before each block. Rows (conv_id, block, end) sorted; end is the block's own last digest."""
    last, now = None, ROOT
    for b in batches:
        conv, block, before = b.column("conv_id").to_pylist(), b.column("block").to_pylist(), []
        for c, end in zip(conv, b.column("end").to_pylist(), strict=True):
            if c != last:
                last, now = c, ROOT
            before.append(now)
            now = _chain(now, end)
        yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(block, pa.int64()), pa.array(before, pa.binary())], names=["conv_id", "block", "before"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of whole prefixes: those of a first block are; later ones are chained onto the digest before their block."""
    for b in batches:
        out = []
        for held, before in zip(b.column("digests").to_pylist(), b.column("before").to_pylist(), strict=True):
            out.append(held if before is None else b"".join(_chain(before, held[i : i + DIGEST]) for i in range(0, len(held), DIGEST)))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "block", "len")), pa.array(out, pa.binary())], names=["conv_id", "block", "len", "digests"])


def _at(i: Column) -> Column:
    """Digest i, from 0 on, of ``digests``."""
    return F.expr("digests").substr((i * DIGEST + 1).cast("int"), F.lit(DIGEST))


def prefix_digests(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, block, len, digests): digests of the prefixes that end in each block of turns, written. A first block's are chained from the root.

    The blocks of a conversation are chained by one task, which holds one digest; a block is one row.
    """
    rows = turns.select("conv_id", F.floor((F.col("pos") - 1) / block).alias("block"), "pos", "digest")
    keys = ["conv_id", "block"]
    local = materialize(rows.repartition(*keys).sortWithinPartitions(*keys, "pos").select(*keys, "digest").mapInArrow(_blocks, "conv_id long, block long, len long, digests binary"), "blocks")
    if not local.where("block > 0").head(1):
        return local
    ends = local.join(local.where("block = 1").select("conv_id"), "conv_id", "left_semi").select(*keys, _at(F.col("len") - 1).alias("end"))
    heads = ends.repartition("conv_id").sortWithinPartitions(*keys).mapInArrow(_heads, "conv_id long, block long, before binary").where("block > 0")
    whole = materialize(local.join(heads, keys, "left").mapInArrow(_whole, local.schema), "digests")
    forget(local)
    return whole


# -- binary search -------------------------------------------------------------------


def first_owned(rows: DataFrame, minima: DataFrame) -> DataFrame:
    """rows (conv_id, len, digests, ...) with ``at``, the first digest (from 0) that the conversation owns, or len; written. minima: digest, owner.

    Digests that minima don't hold are the conversation's own. A round halves what is open of each row, and leaves the rows that are done.
    """
    open_ = rows.withColumns({"_low": F.lit(0).cast("long"), "_high": F.col("len")})
    done = []
    while True:
        middle = F.floor((F.col("_low") + F.col("_high")) / 2)
        probes = open_.where("_low < _high").withColumn("_mid", middle).withColumn("_probe", _at(F.col("_mid")))
        met = probes.join(minima.withColumnRenamed("digest", "_probe"), "_probe", "left")
        own = F.coalesce(F.col("owner") == F.col("conv_id"), F.lit(True))
        next_ = met.withColumns({"_low": F.when(own, F.col("_low")).otherwise(F.col("_mid") + 1), "_high": F.when(own, F.col("_mid")).otherwise(F.col("_high"))})
        now = materialize(next_.drop("_probe", "_mid", "owner"), "search")
        done.append(now.where("_low >= _high"))
        open_ = now
        if not now.where("_low < _high").head(1):
            break
    out = rows.where("len = 0").withColumns({"_low": F.lit(0).cast("long"), "_high": F.col("len")})
    for part in done:
        out = out.unionByName(part)
    return out.withColumn("at", F.col("_low")).drop("_low", "_high")


def chains(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, n, f, parent): the first owned depth of each conversation (n + 1: none) and the owner of the node before it (null at the root), written."""
    digests = prefix_digests(turns, block)
    size = F.col("len").cast("int")
    flat = digests.select("conv_id", F.explode(F.transform(F.sequence(F.lit(0), size - 1), _at)).alias("digest"))
    minima = materialize(flat.groupBy("digest").agg(F.min("conv_id").alias("owner"), F.count("*").alias("c")).where("c > 1").drop("c"), "minima")
    # of conversations with several blocks, first the block: the first one whose last digest is owned
    long = digests.join(digests.where("block = 1").select("conv_id"), "conv_id", "left_semi")
    probed = digests.where("block = 0")
    if long.head(1):
        ends = long.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", _at(F.col("len") - 1).alias("end")))).alias("ends"))
        joined = F.aggregate("ends", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["end"]))
        of_ends = first_owned(ends.select("conv_id", F.size("ends").cast("long").alias("len"), joined.alias("digests")), minima)
        found = of_ends.select("conv_id", F.least("at", F.col("len") - 1).alias("block"))
        probed = probed.join(long.select("conv_id").distinct(), "conv_id", "left_anti").unionByName(digests.join(found, ["conv_id", "block"]).select(*digests.columns))
    found = first_owned(probed, minima)
    # the node before the first owned one: digest at - 1 of this block, or the last one of the block before
    before = found.select("conv_id", (F.col("block") * block + F.col("at") + 1).alias("f"), F.when(F.col("at") > 0, _at(F.col("at") - 1)).alias("before"), F.when((F.col("at") == 0) & (F.col("block") > 0), F.col("block") - 1).alias("block"))
    lasts = long.select("conv_id", "block", _at(F.col("len") - 1).alias("last"))
    before = before.join(lasts, ["conv_id", "block"], "left").select("conv_id", "f", F.coalesce("before", "last").alias("digest"))
    owned = before.join(minima, "digest", "left").select("conv_id", "f", F.col("owner").alias("parent"))
    least = convs.agg(F.min("conv_id").alias("least"))  # the root is a prefix of all: its owner is the smallest
    every = convs.join(owned, "conv_id", "left").withColumn("f", F.coalesce("f", F.lit(1))).crossJoin(F.broadcast(least))
    first = F.col("conv_id") == F.col("least")
    out = every.select("conv_id", "n", F.when(first, F.lit(0)).otherwise(F.col("f")).cast("long").alias("f"), F.when(~first, F.coalesce("parent", "least")).alias("parent"))
    return materialize(out, "chains")


# -- sums ----------------------------------------------------------------------------


def summed_up(tree: DataFrame, *names: str) -> DataFrame:
    """(conv_id, names): each chain's values with those of all chains below it, written. tree: conv_id, parent (null: none), names.

    Distances double: after round k a chain holds its descendants of less than 2**k generations. Sums pass a map-side combine; where many chains
    hang on one, the pointers' join is one of written tables, which AQE can split.
    """
    now, held = tree.select("conv_id", F.col("parent").alias("up"), *names), None
    while True:
        passed = now.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(*[F.sum(c).alias(f"_{c}") for c in names])
        ups = now.select(F.col("conv_id").alias("up"), F.col("up").alias("_up"))
        met = now.join(passed, "conv_id", "left").join(ups, "up", "left")
        after = materialize(met.select("conv_id", F.col("_up").alias("up"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).cast("long").alias(c) for c in names]), "summed")
        if held is not None:
            forget(held)
        now = held = after
        if not now.where("up is not null").head(1):
            return now.drop("up")


def _running(rows: DataFrame, names: list[str], block: int) -> DataFrame:
    """rows (conv_id, depth, names) with the sums over the node's own chain from its depth on: within blocks of depths, then over later blocks."""
    rows = rows.withColumn("_block", F.floor(F.col("depth") / block))
    below = Window.partitionBy("conv_id", "_block").orderBy(F.desc("depth"))
    inner = rows.withColumns({f"{c}_sum": F.sum(c).over(below) for c in names})
    many = rows.where("_block > 0").select("conv_id").distinct()
    blocks = rows.join(many, "conv_id", "left_semi").groupBy("conv_id", "_block").agg(*[F.sum(c).alias(f"_{c}") for c in names])
    later = Window.partitionBy("conv_id").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "_block", *[F.sum(f"_{c}").over(later).alias(f"_{c}") for c in names])
    return inner.join(blocks, ["conv_id", "_block"], "left").withColumns({f"{c}_sum": (F.col(f"{c}_sum") + F.coalesce(f"_{c}", F.lit(0))).cast("long") for c in names}).drop("_block", *[f"_{c}" for c in names])


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, depth, ends_sha256) of pieces (conv_id, depth, piece, ids), sorted: a node's pieces pass through one hash as they come."""
    last, sha, out = None, None, []

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["conv_id", "depth", "ends_sha256"])

    for b in batches:
        for c, d, ids in zip(b.column("conv_id").to_pylist(), b.column("depth").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if (c, d) == last:
                sha.update(b",")
            else:
                if last is not None:
                    out.append((*last, sha.hexdigest()))
                last, sha = (c, d), hashlib.sha256()
            sha.update(ids.encode())
        if len(out) >= 10_000:
            yield batch(out)
            out = []
    if last is not None:
        out.append((*last, sha.hexdigest()))
    if out:
        yield batch(out)


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, pos (1 to n without gaps), digest (of role and text, equal for equal turns only), bytes. convs: conv_id (unique, not null), n; those
    without turns are members of the root. saved_tokens: over the node's subtree, each node's (n_convs - 1) times the bytes of its last text. ends_sha256: SHA-256
    of the ascending decimal ids of members that end here, joined by commas. Equal conversations are members of the same nodes; no conversations give no nodes.
    """
    turns = materialize(turns, "spliced")
    convs = materialize(convs, "lengths")
    chain = chains(turns, convs, block)
    owns = F.col("f") <= F.col("n")
    # where members end: the owner of their last node, and its depth
    ends = materialize(chain.select(F.when(owns, F.col("conv_id")).otherwise(F.coalesce("parent", "conv_id")).alias("owner"), F.col("n").alias("depth"), "conv_id"), "ends")
    tree = chain.where(owns)
    # counts of chains: members that end on them, and a leaf where nothing hangs on the last node
    ended = ends.groupBy(F.col("owner").alias("conv_id")).agg(F.count("*").alias("members"))
    hung = tree.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), (F.col("f") - 1).alias("depth")).agg(F.count("*").alias("hung"))
    last = tree.join(hung.withColumnRenamed("depth", "n"), ["conv_id", "n"], "left").select("conv_id", "n", "f", "parent", F.when(F.col("hung").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    counts = summed_up(last.join(ended, "conv_id", "left").select("conv_id", "parent", F.coalesce("members", F.lit(0)).alias("members"), "leaves"), "members", "leaves")
    # what is added at each node: members that end there, and the totals of the chains that hang on it
    at_end = ends.groupBy(F.col("owner").alias("conv_id"), "depth").agg(F.count("*").alias("members"))
    at_hung = tree.where("parent is not null").join(counts, "conv_id").groupBy(F.col("parent").alias("conv_id"), (F.col("f") - 1).alias("depth")).agg(F.count("*").alias("hung"), F.sum("members").alias("hung_members"), F.sum("leaves").alias("hung_leaves"))
    sizes = turns.select("conv_id", F.col("pos").alias("depth"), "bytes")
    # the root holds no text; a chain's other nodes are its conversation's turns from f on
    roots = tree.where("f = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"))
    nodes = sizes.unionByName(roots).join(tree.select("conv_id", "n", "f", "parent"), "conv_id").where(F.col("depth") >= F.col("f"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    added = nodes.join(at_end, ["conv_id", "depth"], "left").join(at_hung, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "bytes", "n", "f", "parent", zero("hung").alias("hung"), (zero("members") + zero("hung_members")).alias("convs"),
        (zero("hung_leaves") + F.when((F.col("depth") == F.col("n")) & F.col("hung").isNull(), 1).otherwise(0)).alias("leaves"),
    )
    counted = materialize(_running(added, ["convs", "leaves"], block), "nodes").withColumn("saved", (F.col("convs_sum") - 1) * F.col("bytes"))
    saved = summed_up(counted.groupBy("conv_id").agg(F.sum("saved").alias("saved")).join(tree.select("conv_id", "parent"), "conv_id"), "saved")
    hung_saved = tree.where("parent is not null").join(saved, "conv_id").groupBy(F.col("parent").alias("conv_id"), (F.col("f") - 1).alias("depth")).agg(F.sum("saved").alias("hung_saved"))
    with_saved = counted.join(hung_saved, ["conv_id", "depth"], "left").withColumn("saved", (F.col("saved") + zero("hung_saved")).cast("long"))
    summed = _running(with_saved, ["saved"], block)
    # ids by ranges of numbers, so that a node of many members is no single group; then its pieces in order
    ids = ends.groupBy("owner", "depth", F.floor(F.col("conv_id") / ID_RANGE).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    keys = ["conv_id", "depth"]
    lists = ids.withColumnRenamed("owner", "conv_id").repartition(*keys).sortWithinPartitions(*keys, "piece").select(*keys, "ids").mapInArrow(_hash_lists, "conv_id long, depth long, ends_sha256 string")
    return summed.join(lists, keys, "left").select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("f"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"), F.col("convs_sum").alias("n_convs"),
        (F.col("hung") + (F.col("depth") < F.col("n")).cast("long")).alias("n_children"), F.col("leaves_sum").alias("n_leaves"), F.col("saved_sum").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
