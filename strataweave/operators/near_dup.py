"""MinHash and LSH near duplicates, exposure and leakage."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.text import strip_comments, words
from strataweave.operators.graph import connected_components
from strataweave.operators.overlaps import overlaps
from strataweave.session import forget, materialize, ship

#: BUCKET_CAP is the cap of the method reproduced, for callers that ask for it
PERMUTATIONS, BANDS, BUCKET_CAP = 64, 16, 400
#: different sets in a bucket from which it is compared in blocks; sets in a block, and hashes of all of them (about)
LARGE, BLOCK, BLOCK_HASHES = 400, 512, 500_000
#: different sets in a bucket from which links are counted in blocks
SMALL = 16


def coefficients(n: int, seed: int) -> list[tuple[int, int]]:
    """(a, b) of each hash: a is odd and has 31 bits in each half, b has 31. The order of the draws fixes the signatures."""
    draw = np.random.RandomState(seed).randint
    top, low, b = (draw(least, 2**31 - 1, size=n) for least in (1, 1, 0))
    return [(int(x) << 32 | int(y) | 1, int(z)) for x, y, z in zip(top, low, b, strict=True)]


def minhash(hashes: Column, n: int = PERMUTATIONS, seed: int = 1) -> Column:
    """Array of n minima of (a h + b) mod 2**64 over 2**32, for hashes of 32 bits; in limbs, as SQL's longs have a sign."""
    mask = F.lit((1 << 32) - 1)

    def one(a: int, b: int) -> Column:
        top, low = a >> 32, a & (1 << 32) - 1

        def upper(h: Column) -> Column:
            # the upper half of low h + b, from the halves of h; and the lower half of top h
            carried = F.shiftright(F.shiftright(h, 16) * F.lit(low) + F.shiftright(h.bitwiseAND(F.lit(65535)) * F.lit(low) + F.lit(b), 16), 16)
            return (carried + (h * F.lit(top)).bitwiseAND(mask)).bitwiseAND(mask)

        return F.array_min(F.transform(hashes, upper))

    return F.array(*[one(a, b) for a, b in coefficients(n, seed)])


def gram_sets(tokens: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct CRC-32 of the k-token shingles of texts given as tokens joined by a space; with fewer tokens the whole text is one."""
    out, size = [], np.zeros(len(tokens), np.int64)
    for i, value in enumerate(tokens):
        data = value.as_buffer()
        flat = np.frombuffer(data, np.uint8)
        cut = np.flatnonzero(flat == 32)
        start, end = np.append(0, cut + 1), np.append(cut, len(flat))
        n = max(len(start) - k + 1, 1)
        view = memoryview(data)
        crc = [zlib.crc32(view[a:b]) for a, b in zip(start[:n].tolist(), end[min(k, len(end)) - 1 :].tolist(), strict=True)]
        out.append(np.unique(np.array(crc, np.uint32)))
        size[i] = len(out[-1])
    return np.concatenate(out) if out else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(size)])


def minima(hashes: np.ndarray, off: np.ndarray, n: int, seed: int) -> np.ndarray:
    """(sets, n): as ``minhash``, for sets that are not empty; products wrap at 64 bits."""
    h = hashes.astype(np.uint64)
    out = np.empty((len(off) - 1, n), np.int64)
    for j, (a, b) in enumerate(coefficients(n, seed)):
        out[:, j] = np.minimum.reduceat((h * np.uint64(a) + np.uint64(b)) >> np.uint64(32), off[:-1]) if len(off) > 1 else 0
    return out


def _sign(k: int, n: int, bands: int, seed: int):
    """(id, n, k1, k2, set, minima, sigs) of (id, tokens): the set as bytes of uint32, two hashes of it, its minima, and a signature of each band of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                hashes, off = gram_sets(batch.column("tokens"), k)
                raw = [hashes[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
                both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw)), "<i8").reshape(-1, 2)
                least = np.ascontiguousarray(minima(hashes, off, n, seed))
                sigs = [[xxhash.xxh3_64_intdigest(band.tobytes()) - (1 << 63) for band in row] for row in least.reshape(len(raw), bands, -1)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(off)), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(raw, pa.binary()), pa.array(least.tolist(), pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))], names=["id", "n", "k1", "k2", "set", "minima", "sigs"])

    return run


def signed_sets(rows: DataFrame, row_id: str = "row_id", text: str = "text", k: int = 5, n: int = PERMUTATIONS, bands: int = BANDS, seed: int = 1) -> DataFrame:
    """(id, n, k1, k2, set, minima, sigs): every text's shingle set with its MinHash values and band signatures; numpy over the tokens that SQL finds."""
    ship(rows.sparkSession)
    # white space parts tokens whether collapsed or not
    joined = F.array_join(words(strip_comments(F.coalesce(F.col(text), F.lit("")))), " ")
    return rows.select(F.col(row_id).cast("long").alias("id"), joined.alias("tokens")).mapInArrow(_sign(k, n, bands, seed), "id long, n long, k1 long, k2 long, set binary, minima array<long>, sigs array<long>")


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        out = np.empty(batch.num_rows)
        for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[at] == x).sum())
            out[i] = both / (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([batch.column("row_a"), batch.column("row_b"), pa.array(out)], names=["row_a", "row_b", "jaccard"])


def near_duplicate_pairs(rows: DataFrame, row_id: str = "row_id", text: str = "text", threshold: float = 0.8, k: int = 5, n: int = PERMUTATIONS, bands: int = BANDS, bucket_cap: int = 0, seed: int = 1) -> DataFrame:
    """(row_a, row_b, jaccard) with row_a < row_b: LSH candidates, verified on the exact shingle sets.

    Rows with equal shingle sets are one in LSH and are linked to the smallest id of
    theirs, so copies don't fill buckets. Pairs whose sizes rule out the threshold are no candidates. Buckets of
    more than ``LARGE`` different sets are compared in pairs of blocks. With a ``bucket_cap`` those of
    more sets are passed over, as the method reproduced does at ``BUCKET_CAP`` (``skipped_buckets`` counts them).
    Null texts count as empty; ids must be unique.
    """
    signed = materialize(signed_sets(rows, row_id, text, k, n, bands, seed).drop("minima"), "signatures")
    # written, so that AQE can split a text of many copies in the join
    groups = materialize(signed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("c")), "groups")
    copies = signed.select("id", "k1", "k2").join(groups.where("c > 1").drop("c"), ["k1", "k2"]).where("id != rep").select(F.col("rep").alias("row_a"), F.col("id").alias("row_b"), F.lit(1.0).alias("jaccard"))
    reps = signed.join(groups.select(F.col("rep").alias("id")), "id", "left_semi")
    members = reps.select("id", "n", F.posexplode("sigs").alias("band", "sig"))
    counted = materialize(kept_buckets(members, bucket_cap), "counted")
    shared = materialize(members.join(counted, ["band", "sig"]), "buckets")
    small = shared.where(F.col("c") <= LARGE)
    side = lambda end: small.select("band", "sig", F.col("id").alias(f"row_{end}"), F.col("n").alias(f"n_{end}"))
    near = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold
    candidates = side("a").join(side("b"), ["band", "sig"]).where((F.col("row_a") < F.col("row_b")) & near).select("row_a", "row_b").distinct()
    with_sets = candidates.join(signed.select(F.col("id").alias("row_a"), F.col("set").alias("x")), "row_a").join(signed.select(F.col("id").alias("row_b"), F.col("set").alias("y")), "row_b")
    found = with_sets.select("row_a", "row_b", "x", "y").mapInArrow(_jaccard, "row_a long, row_b long, jaccard double").where(F.col("jaccard") >= threshold)
    large = _large_buckets(shared.where(F.col("c") > LARGE).select("band", "sig", "id", "n"), signed.select("id", "set", "sigs"), threshold)
    # a pair can meet in a small bucket of one band and in a large one of another
    return found.unionByName(large).dropDuplicates(["row_a", "row_b"]).unionByName(copies)


def _block_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, tuple, tuple]]:
    """(band, whether both sides are one block, side, side) of pairs of blocks; a side has ids, sets, offsets, signatures and flags.

    Rows, sorted by bucket and pair: band, sig, lower, upper, own (its block), id, set, sigs and, if there, large.
    """

    def side(rows: list) -> tuple[np.ndarray, ...]:
        size = np.array([len(r[2]) for r in rows], np.int64)
        flat = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, np.uint32)
        return np.array([r[0] for r in rows], np.int64), flat, np.concatenate([[0], np.cumsum(size)]), np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)

    def sides(held: list, last: tuple) -> Iterator[tuple[int, bool, tuple, tuple]]:
        one = last[2] == last[3]
        a, b = side([r for r in held if r[1]]), side(held if one else [r for r in held if not r[1]])
        if len(a[0]) and len(b[0]):
            yield last[0], one, a, b

    held, last = [], None
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("band", "sig", "lower", "upper", "own", "id")), strict=True)
        sets, sigs = batch.column("set"), batch.column("sigs")
        large = batch.column("large").to_pylist() if "large" in batch.schema.names else [-1] * batch.num_rows
        for i, (band, sig, lower, upper, own, row) in enumerate(keys):
            if last != (band, sig, lower, upper):
                if held:
                    yield from sides(held, last)
                held, last = [], (band, sig, lower, upper)
            held.append((row, own == lower, np.frombuffer(sets[i].as_buffer(), np.uint32), np.array(sigs[i].values, np.int64), large[i]))
    if held:
        yield from sides(held, last)


def _block_pairs(threshold: float):
    """(row_a, row_b, jaccard) within pairs of blocks."""

    def pairs(band: int, one: bool, a: tuple, b: tuple) -> Iterator[pa.RecordBatch]:
        both = overlaps(a[1], a[2], b[1], b[2])
        jaccard = both / np.maximum(np.diff(a[2])[:, None] + np.diff(b[2]) - both, 1)
        x, y = np.nonzero((jaccard >= threshold) & ((a[0][:, None] < b[0]) if one else True))
        for i in range(0, len(x), 65_536):
            p, q = x[i : i + 65_536], y[i : i + 65_536]
            # pairs are put out in the first band that they share
            first = ~(a[3][p, :band] == b[3][q, :band]).any(1)
            p, q = p[first], q[first]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[0][p], b[0][q])), pa.array(np.maximum(a[0][p], b[0][q])), pa.array(jaccard[p, q])], names=["row_a", "row_b", "jaccard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sides in _block_sides(batches):
            yield from pairs(*sides)

    return run


def _forest(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Of edges between places those that a spanning forest needs."""
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while (parent := up.get(i, i)) != i:
            up[i] = up.get(parent, parent)
            i = parent
        return i

    kept = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        p, q = root(i), root(j)
        if p != q:
            up[max(p, q)] = min(p, q)
            kept.append((i, j))
    return kept


def _block_links(threshold: float):
    """(a, b, links) within pairs of blocks: the links of each set a (b null), and edges (a, b) that join the same sets as all links do.

    A pair counts in the first band of those with large buckets that it shares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for band, one, a, b in _block_sides(batches):
            both = overlaps(a[1], a[2], b[1], b[2])
            linked = both / np.maximum(np.diff(a[2])[:, None] + np.diff(b[2]) - both, 1) >= threshold
            if one:
                np.fill_diagonal(linked, False)
            for j in range(band):  # a pair shares a bucket, so where signatures agree its size is that of both
                if (a[4] >> j & 1).any():
                    linked &= ~((a[3][:, j][:, None] == b[3][:, j]) & ((a[4] >> j & 1) > 0)[:, None])
            x, y = np.nonzero(np.triu(linked) if one else linked)
            edges = _forest(x, y + (0 if one else len(a[0])))
            ids = a[0] if one else np.concatenate([a[0], b[0]])
            counts = linked.sum(1) if one else np.concatenate([linked.sum(1), linked.sum(0)])
            some = np.flatnonzero(counts)
            left = np.concatenate([ids[some], ids[[i for i, _ in edges]]]) if len(some) else ids[:0]
            right = pa.array([None] * len(some) + [int(ids[j]) for _, j in edges], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), right, pa.array(np.concatenate([counts[some], np.zeros(len(edges), np.int64)]).astype(np.int64))], names=["a", "b", "links"])

    return run


def _small_links(threshold: float, bands: int):
    """The pairs (a, b) that link and share no large bucket. Rows: a, b, x and y (sets), p and q (signatures), large (of a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = [np.asarray(batch.column(c).flatten()).reshape(-1, bands) for c in ("p", "q")]
            flags = (np.asarray(batch.column("large"))[:, None] >> np.arange(bands) & 1) > 0
            ok = ~((signs[0] == signs[1]) & flags).any(1)
            for i in np.flatnonzero(ok).tolist():
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint32) for c in ("x", "y"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = both / (len(x) + len(y) - both) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    return run


def near_duplicate_classes(rows: DataFrame, row_id: str = "row_id", text: str = "text", threshold: float = 0.8, k: int = 5, n: int = PERMUTATIONS, bands: int = BANDS, seed: int = 1, small: int = SMALL) -> DataFrame:
    """(row_id, class_id, n_links) for every row: the smallest id reachable by links, itself included, and how many other shingle sets its own links with.

    The links are those of ``near_duplicate_pairs``, but they aren't written out: buckets of more than ``small`` different sets are
    compared in pairs of blocks, which give counts and a spanning forest, so what comes out grows with the rows and not with the pairs. Rows with equal sets share class and count.
    Null texts count as empty; ids must be unique; no rows give none.
    """
    signed = materialize(signed_sets(rows, row_id, text, k, n, bands, seed).drop("minima"), "signatures")
    groups = materialize(signed.groupBy("k1", "k2").agg(F.min("id").alias("rep")), "groups")
    reps = signed.join(groups.select(F.col("rep").alias("id")), "id", "left_semi")
    members = reps.select("id", "n", F.posexplode("sigs").alias("band", "sig"))
    counted = materialize(kept_buckets(members), "counted")
    placed = materialize(members.join(counted, ["band", "sig"]), "buckets")
    flags = placed.where(F.col("c") > small).groupBy("id").agg(F.sum(F.expr("shiftleft(1L, band)")).alias("large"))
    known = materialize(reps.join(placed.select("id").distinct(), "id", "left_semi").join(flags, "id", "left").select("id", "set", "sigs", F.coalesce("large", F.lit(0).cast("long")).alias("large")), "sets")
    few = placed.where(F.col("c") <= small)
    side = lambda end: few.select("band", "sig", F.col("id").alias(end), F.col("n").alias(f"n_{end}"))
    near = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold
    candidates = side("a").join(side("b"), ["band", "sig"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    of = lambda end, held, sigs, *more: known.select(F.col("id").alias(end), F.col("set").alias(held), F.col("sigs").alias(sigs), *more)
    met = candidates.join(of("a", "x", "p", "large"), "a").join(of("b", "y", "q"), "b").select("a", "b", "x", "y", "p", "q", "large")
    pairs = materialize(met.mapInArrow(_small_links(threshold, bands), "a long, b long"), "pairs")
    blocks = materialize(_dealt_blocks(placed.where(F.col("c") > small).select("band", "sig", "id", "n"), known).mapInArrow(_block_links(threshold), "a long, b long, links long"), "block-links")
    for done in (counted, placed, known):
        forget(done)
    classes = connected_components(pairs.unionByName(blocks.where("b is not null").select("a", "b")))
    one = F.lit(1).cast("long").alias("links")
    links = pairs.select("a", one).unionByName(pairs.select(F.col("b").alias("a"), one)).unionByName(blocks.where("b is null").select("a", "links")).groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("n_links"))
    by_rep = groups.join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left").join(links, "rep", "left")
    by_rep = materialize(by_rep.select("k1", "k2", F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    return signed.select("id", "k1", "k2").join(by_rep, ["k1", "k2"]).select(F.col("id").alias("row_id"), "class_id", "n_links")


def _dealt_blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of pairs of blocks of buckets (band, sig, id, n) over sets (id, set, sigs, ...): members are dealt into blocks by hash, and each block meets each."""
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_HASHES))
    dealt = members.join(members.groupBy("band", "sig").agg(blocks.alias("blocks")), ["band", "sig"])
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    met = dealt.select("band", "sig", "id", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    key = ["band", "sig", "lower", "upper"]
    met = met.select("band", "sig", F.least("own", "other").alias("lower"), F.greatest("own", "other").alias("upper"), "own", "id").join(sets, "id")
    return met.select(*key, "own", "id", *[c for c in sets.columns if c != "id"]).repartition(*key).sortWithinPartitions(*key)


def _large_buckets(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(row_a, row_b, jaccard) of large buckets."""
    return _dealt_blocks(members, sets).mapInArrow(_block_pairs(threshold), "row_a long, row_b long, jaccard double")


def kept_buckets(members: DataFrame, bucket_cap: int = 0) -> DataFrame:
    """(band, sig, c): buckets with candidates, and with a cap those within it."""
    counts = members.groupBy("band", "sig").agg(F.count("*").alias("c")).where("c > 1")
    return counts.where(F.col("c") <= bucket_cap) if bucket_cap else counts


def skipped_buckets(members: DataFrame, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """How many buckets the cap passes over, and their rows."""
    return members.groupBy("band", "sig").agg(F.count("*").alias("c")).where(F.col("c") > bucket_cap).agg(F.count("*").alias("buckets"), F.coalesce(F.sum("c"), F.lit(0)).alias("rows"))


def both_directions(pairs: DataFrame) -> DataFrame:
    return pairs.select("row_a", "row_b").unionByName(pairs.select(F.col("row_b").alias("row_a"), F.col("row_a").alias("row_b")))


def exposed_rows(pairs: DataFrame, evaluated: DataFrame, train: DataFrame) -> DataFrame:
    """evaluated (row_id, ...) with ``exposed``: it has a near duplicate in train."""
    twins = both_directions(pairs).join(train.select(F.col("row_id").alias("row_b")), "row_b", "left_semi").select(F.col("row_a").alias("row_id")).distinct()
    return evaluated.join(twins.withColumn("exposed", F.lit(True)), "row_id", "left").withColumn("exposed", F.coalesce("exposed", F.lit(False)))


def pairs_within(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of which both ends are among rows."""
    ids = rows.select("row_id").distinct()
    return pairs.join(ids.withColumnRenamed("row_id", "row_a"), "row_a", "left_semi").join(ids.withColumnRenamed("row_id", "row_b"), "row_b", "left_semi").select("row_a", "row_b", "jaccard")


def leakage_report(rows: DataFrame, pairs: DataFrame, test_fold: int = 0, val_fold: int = 1) -> DataFrame:
    """One row of counts and shares (rounded to 4, 0 for empty sets). rows: row_id, fold, positive."""
    folds = rows.select("row_id", "fold")
    two = both_directions(pairs).join(folds.select(F.col("row_id").alias("row_a"), F.col("fold").alias("fold_a")), "row_a").join(folds.select(F.col("row_id").alias("row_b"), F.col("fold").alias("fold_b")), "row_b")
    train = ~F.col("fold_b").isin(test_fold, val_fold)
    twins = two.groupBy(F.col("row_a").alias("row_id")).agg(F.bool_or(F.col("fold_a") != F.col("fold_b")).alias("crossed"), F.bool_or(F.col("fold_a").isin(test_fold, val_fold) & train).alias("trained"))
    marked = rows.join(twins, "row_id", "left").select("fold", "positive", F.coalesce("crossed", F.lit(False)).cast("int").alias("crossed"), F.coalesce("trained", F.lit(False)).cast("int").alias("trained"))
    share = lambda c, where: F.round(F.coalesce(F.avg(F.when(where, F.col(c))), F.lit(0.0)), 4)
    test, val = F.col("fold") == test_fold, F.col("fold") == val_fold
    shares = marked.agg(share("crossed", F.lit(True)).alias("rows_with_cross_fold_twin"), share("trained", test).alias("test_rows_with_train_twin"), share("trained", test & F.col("positive")).alias("test_positive_rows_with_train_twin"), share("trained", val).alias("val_rows_with_train_twin"))
    counts = two.agg((F.count("*") / 2).cast("long").alias("near_dup_pairs"), F.coalesce((F.sum((F.col("fold_a") != F.col("fold_b")).cast("int")) / 2).cast("long"), F.lit(0)).alias("cross_fold_pairs"))
    return counts.crossJoin(shares)  # one row each
