"""Problem 1: clusters of mutually similar records by parallel pivots.

Records are ordered by a hash of their id. A record is a pivot if no pivot
before it in that order is similar to it; every other record belongs to a
similar pivot. Two stages find the pivots without comparing all pairs:

* *Prefix rounds.* The first `prefix` records in hash order of those not yet
  absorbed (a bounded number) are compared with each other on the driver; the
  resulting pivots are shipped and absorb similar records everywhere. Any
  cluster with a noticeable share of the collection is gone after a round.
* *Bucket stage.* What is left is bucketed by cross-polytope hashes in several
  tables, as many as five records at the threshold need to meet at all. In each
  bucket the pivots are again those of the hash order and every record proposes
  the earliest one; those that propose none are roots. Buckets beyond `block`
  rows are split by a salt.
* *Settling.* As members of a cluster may have met in parts or not at all, all
  that is left is compared exactly with the roots, in blocks, until every
  record belongs to the first pivot that is similar to it.

* *Reassignment.* Mean directions are summed, every member goes to the closest
  one, and the medoids are computed anew: the sum of a record's cosines with all
  members is its inner product with the sum of their unit vectors, so the medoid
  is the member of greatest cosine to the mean direction.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.vectors import cross_polytope, fold64, hash_head, matrix, rotations, unit
from skein.session import BROADCAST_BYTES, cut_lineage, drop_table, maybe_broadcast

#: Mean directions shipped at once.
CENTERS = BROADCAST_BYTES // 1024
EMPTY_ASSIGNED = "id string, h bigint, vector array<float>, pivot string, sim double"


def greedy_pivots(u: np.ndarray, threshold: float) -> list[int]:
    """Places of the pivots among unit rows in hash order."""
    free, found = np.ones(len(u), bool), []
    for i in range(len(u)):
        if free[i]:
            found.append(i)
            free &= u @ u[i] < threshold
            free[i] = False
    return found


def assign(rows: DataFrame, ids: list[str], pivots: np.ndarray, threshold: float) -> DataFrame:
    """``pivot`` and ``sim`` of the closest of a bounded number of pivots, null below the threshold."""
    names = np.array(ids, dtype=object)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            if len(names):
                s = unit(matrix(b)) @ pivots.T
                at = s.argmax(axis=1)
                sim = s[np.arange(len(s)), at].astype(np.float64)
                ok = sim >= threshold
                pivot = np.where(ok, names[at], None)
            else:
                ok, sim, pivot = np.zeros(b.num_rows, bool), np.zeros(b.num_rows), np.full(b.num_rows, None)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("h"), b.column("vector"), pa.array(pivot, pa.string()), pa.array(np.where(ok, sim, 0.0))],
                names=["id", "h", "vector", "pivot", "sim"],
            )

    return rows.select("id", "h", "vector").mapInArrow(run, EMPTY_ASSIGNED)


@functools.cache
def tables_needed(threshold: float, values: int, least: int = 5, miss: float = 1e-6, trials: int = 4000) -> int:
    """Tables in which `least` records, every two at the threshold, all miss each other with probability `miss`.

    The probability of a meeting in one table is counted on random groups.
    """
    rng = np.random.default_rng(11)
    c, e = unit(rng.standard_normal((trials, 128)), np.float64), unit(rng.standard_normal((trials * least, 128)), np.float64)
    x = unit(math.sqrt(threshold) * np.repeat(c, least, axis=0) + math.sqrt(1 - threshold) * e)
    k = np.sort(fold64(cross_polytope(x, rotations(13, values), 128), 0).reshape(trials, least), axis=1)
    meet = float((k[:, 1:] == k[:, :-1]).any(axis=1).mean())
    return math.ceil(math.log(miss) / math.log1p(-min(max(meet, 1 / trials), 1 - 1e-9)))


def bucket_roots(rest: DataFrame, n: int, threshold: float, tables: int | None, block: int) -> DataFrame:
    """``(id)`` of records that are the earliest of those they meet; every group of records that meet has one."""
    # As few values a key as keep a bucket within half a block by chance: pairs at the threshold meet seldom in more.
    values = max(1, math.ceil(math.log(max(2, 2 * n / block)) / math.log(2 * 128)))
    tables = tables or tables_needed(threshold, values)
    rot = rotations(7, tables * values)

    def keys(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = cross_polytope(unit(matrix(b)), rot, 128)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(fold64(x[:, t * values : (t + 1) * values], t)), b.column("h"), b.column("id")], names=["k", "h", "id"])

    keyed = cut_lineage(rest.select("id", "h", "vector").mapInArrow(keys, "k bigint, h bigint, id string"))
    # Only keys with company go on; their counts are pre-aggregated, and vectors join what is left.
    size = keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = keyed.join(size, "k").withColumn("salt", F.pmod(F.xxhash64("h", "k"), F.ceil(F.col("n") / block)).cast("int"))
    keyed = keyed.select("k", "salt", "h", "id").join(rest.select("id", "vector"), "id")

    def propose(table):
        table = table.sort_by([("h", "ascending"), ("id", "ascending")])
        u, ids = unit(matrix(table)), table.column("id").to_pylist()
        left, out = np.arange(len(u)), []
        while len(left) > 1:
            s = u[left] @ u[left[0]] >= threshold
            s[0] = True
            out += [(ids[i], ids[left[0]]) for i in left[s] if i != left[0]]
            left = left[~s]
        return pa.table([pa.array([o[k] for o in out], pa.string()) for k in range(2)], names=["id", "pivot"])

    # A proposal always points to an earlier record: the earliest one of those that meet proposes nothing.
    links = cut_lineage(keyed.groupBy("k", "salt").applyInArrow(propose, "id string, pivot string").distinct())
    return links.select(F.col("pivot").alias("id")).distinct().join(links.select("id"), "id", "left_anti")


def earliest(rows: DataFrame, live: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """``(id, pivot)``: the first record of `live` in hash order that is similar, found by comparing all with all.

    Each pass ships one block of `live` and writes ids only; a record that is
    similar to none gives no row.
    """
    passes = max(1, math.ceil(n / block))

    def first(ids, h, u):
        def run(batches):
            for b in batches:
                if not (b.num_rows and len(ids)):
                    continue
                v = unit(matrix(b))
                for i in range(0, len(v), 1024):
                    s = v[i : i + 1024] @ u.T >= threshold
                    hit = np.nonzero(s.any(axis=1))[0]
                    at = s[hit].argmax(axis=1)  # ids are in hash order
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(i + hit)), pa.array(h[at]), pa.array(ids[at], pa.string())], names=["id", "ph", "pivot"])

        return run

    found = []
    for p in range(passes):
        part = live.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == p).select("h", "id", "vector").toPandas().sort_values(["h", "id"])
        u = unit(np.stack(part["vector"].to_numpy())) if len(part) else np.zeros((0, 128), np.float32)
        found.append(rows.select("id", "vector").mapInArrow(first(part["id"].to_numpy(object), part["h"].to_numpy(np.int64), u), "id string, ph bigint, pivot string"))
    return functools.reduce(DataFrame.unionByName, found).groupBy("id").agg(F.min(F.struct("ph", "pivot")).alias("p")).select("id", "p.pivot")


def settle(rest: DataFrame, roots: DataFrame, threshold: float, block: int = 4096) -> DataFrame:
    """``(id, pivot)`` of the records in `rest` with company, by exact comparison with the roots.

    A root whose earliest similar root is itself is a pivot and takes every
    record that points to it, other roots too. Records that pointed to a root
    which was taken itself are settled among each other in the next round, until none is
    left. A set of mutually similar records without similar ones outside that has a
    root is whole after the first round.
    """
    left, live, out = rest.select("id", "h", "vector"), cut_lineage(rest.join(roots, "id", "left_semi").select("id", "h", "vector")), []
    while n := live.count():
        to = cut_lineage(earliest(left, live, n, threshold, block))
        pivots = to.filter("id = pivot").select("pivot")
        out.append(to.join(pivots, "pivot", "left_semi").select("id", "pivot"))
        late = to.join(pivots, "pivot", "left_anti").select("id")
        left = live = cut_lineage(left.join(late, "id", "left_semi"))
    if not out:
        return rest.select("id", F.col("id").alias("pivot")).limit(0)
    found = functools.reduce(DataFrame.unionByName, out)
    company = found.filter("id <> pivot").select("pivot").distinct()
    return found.join(company, "pivot", "left_semi").select("id", "pivot")


def pivot_clusters(records: DataFrame, threshold: float = 0.65, prefix: int = 1024, rounds: int = 2, tables: int | None = None, block: int = 2048) -> DataFrame:
    """``(id, vector, pivot)`` for every record; a record without company has a null pivot.

    `records` has unique ids and usable vectors, as `current_records` gives.
    An empty table gives an empty one. Copies of a vector are records like
    others. The driver holds at most ``prefix * rounds`` vectors.
    """
    rows = cut_lineage(records.select("id", F.xxhash64("id").alias("h"), "vector"))
    ids: list[str] = []
    pivots = np.zeros((0, 128), np.float32)
    for _ in range(rounds):
        left = assign(rows, ids, pivots, threshold).filter("pivot IS NULL") if ids else rows
        head = hash_head(left.select("h", "id", "vector"), prefix, left.count()).select("id", "vector").toPandas()
        if head.empty:
            break
        u = unit(np.stack(head["vector"].to_numpy()))
        new = greedy_pivots(u, threshold)
        ids += [head["id"][i] for i in new]
        pivots = np.concatenate([pivots, u[new]])
    done = cut_lineage(assign(rows, ids, pivots, threshold))
    drop_table(rows)
    # A prefix pivot that absorbed nothing takes part in the bucket stage like what is left.
    alone = done.filter("pivot IS NOT NULL").groupBy("pivot").agg(F.count("*").alias("n")).filter("n = 1").select(F.col("pivot").alias("id"))
    lone = done.filter("pivot IS NOT NULL AND id = pivot").join(F.broadcast(alone), "id", "left_semi")
    rest = cut_lineage(done.filter("pivot IS NULL").unionByName(lone).select("id", "h", "vector"))
    roots = bucket_roots(rest, rest.count(), threshold, tables, block)
    small = rest.join(cut_lineage(settle(rest, roots, threshold)), "id", "left").select("id", "vector", "pivot")
    # At most `prefix * rounds` pivots.
    main = done.filter("pivot IS NOT NULL").join(F.broadcast(alone.withColumnRenamed("id", "pivot")), "pivot", "left_anti").select("id", "vector", "pivot")
    return main.unionByName(small)


def center_sums(members: DataFrame) -> DataFrame:
    """``(pivot, n, center)``: the mean direction of each cluster, summed within tasks first."""

    def part(batches):
        sums: dict[str, list] = {}
        for b in batches:
            if b.num_rows:
                names, at = np.unique(np.array(b.column("pivot").to_pylist(), dtype=object), return_inverse=True)
                add = np.zeros((len(names), 128))
                np.add.at(add, at, unit(matrix(b), np.float64))
                for name, s, c in zip(names, add, np.bincount(at)):
                    old = sums.setdefault(name, [0, np.zeros(128)])
                    old[0] += int(c)
                    old[1] += s
                if len(sums) > 4096:
                    yield from flush(sums)
                    sums = {}
        yield from flush(sums)

    def flush(sums):
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.list_(pa.float64()))],
                names=["pivot", "n", "s"],
            )

    partial = members.select("pivot", "vector").mapInArrow(part, "pivot string, n bigint, s array<double>")

    def total(table):
        s = np.stack(table.column("s").to_pylist()).sum(axis=0)
        s = s / max(1e-300, float(np.sqrt(s @ s)))
        return pa.table([table.column("pivot").slice(0, 1), pa.array([int(np.sum(table.column("n").to_numpy()))]), pa.array([s.tolist()], pa.list_(pa.float64()))], names=["pivot", "n", "center"])

    return partial.groupBy("pivot").applyInArrow(total, "pivot string, n bigint, center array<double>")


def center_blocks(centers: DataFrame, n: int):
    """Pivots, mean directions and least typicalities of at most `CENTERS` clusters at a time."""
    passes = max(1, math.ceil(n / CENTERS))
    for p in range(passes):
        part = centers.filter(F.pmod(F.xxhash64("pivot"), F.lit(passes)) == p).toPandas()
        c = np.stack(part["center"].to_numpy()).astype(np.float32) if len(part) else np.zeros((0, 128), np.float32)
        yield part["pivot"].to_numpy(object), c, part["least"].to_numpy(float) if "least" in part else None


def reassign(labelled: DataFrame, centers: DataFrame, n: int) -> DataFrame:
    """`labelled` with the pivot of the closest mean direction for every record of these clusters; others stay."""
    known = centers.select("pivot", F.lit(-1.0).alias("best"))
    out = labelled.join(maybe_broadcast(known, n), "pivot", "left").select("id", "vector", "pivot", "best")
    for names, c, _ in center_blocks(centers, n):
        box = labelled.sparkSession.sparkContext.broadcast((names, c))

        def run(batches, box=box):
            names, c = box.value
            for b in batches:
                if b.num_rows:
                    pivot, best = np.array(b.column("pivot").to_pylist(), dtype=object), b.column("best").to_numpy(zero_copy_only=False)
                    if len(names):
                        s = unit(matrix(b)) @ c.T
                        at = s.argmax(axis=1)
                        new = s[np.arange(len(s)), at].astype(np.float64)
                        closer = new > best  # never for the nulls of other records
                        pivot, best = np.where(closer, names[at], pivot), np.where(closer, new, best)
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), pa.array(pivot, pa.string()), pa.array(best, pa.float64(), from_pandas=True)], names=["id", "vector", "pivot", "best"])

        before, out = out, cut_lineage(out.mapInArrow(run, "id string, vector array<float>, pivot string, best double"))
        drop_table(before)
    return out.select("id", "vector", "pivot")


def mutual_clusters(records: DataFrame, threshold: float = 0.65, least: int = 5, block: int = 4096) -> DataFrame:
    """``(cluster_id, id, n, typicality)`` of clusters in which every two are similar and nothing outside is.

    The clusters of at least `least` records are checked: the members exactly, in
    blocks against each other, and against all members those records outside
    that come near enough to the mean direction (see `outsiders`). A cluster that
    fails is left out. ``typicality`` is the cosine to the mean direction;
    ``cluster_id`` is the smallest id. Pairs that are compared are never written
    out. An empty table gives no row.
    """
    labelled = pivot_clusters(records, threshold)
    first = center_sums(labelled.filter("pivot IS NOT NULL"))
    # Only clusters that may count attract records.
    first = cut_lineage(first.filter(F.col("n") >= least))
    labelled = reassign(labelled, first, first.count())
    centers = cut_lineage(center_sums(labelled.filter("pivot IS NOT NULL")).filter(F.col("n") >= least))
    number = centers.count()
    members = labelled.join(F.broadcast(centers) if number <= CENTERS else centers, "pivot").select("pivot", "id", "vector", "n", "center")

    def typical(batches):
        for b in batches:
            if b.num_rows:
                t = np.einsum("ij,ij->i", unit(matrix(b), np.float64), matrix(b, "center"))
                yield pa.RecordBatch.from_arrays([b.column("pivot"), b.column("id"), b.column("vector"), b.column("n"), pa.array(t)], names=["pivot", "id", "vector", "n", "typicality"])

    members = members.mapInArrow(typical, "pivot string, id string, vector array<float>, n bigint, typicality double")
    spread = members.groupBy("pivot").agg(F.min("typicality").alias("least"))
    strangers = outsiders(labelled, cut_lineage(centers.join(spread, "pivot")), number, threshold)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    base = members.withColumn("blocks", blocks).withColumn("own", own).select("pivot", "vector", "own", "blocks")
    # One row of blocks against another: a record goes to the cells (a, b), a <= b, that hold its block.
    left = base.select("pivot", "vector", F.lit(0).alias("side"), F.col("own").alias("a"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("b"))
    right = base.filter("own > 0").select("pivot", "vector", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("a"), F.col("own").alias("b"))
    outer = strangers.join(centers.select("pivot", blocks.alias("blocks")), "pivot")
    outer = outer.select("pivot", "vector", F.lit(2).alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("a"), F.col("a").alias("b"))
    exact = 1e-6

    def broken(table):
        side = table.column("side").to_numpy()
        u = unit(matrix(table))
        x, y, z = u[side == 0], u[side == 1], u[side == 2]
        y = x if not len(y) and table.column("a")[0] == table.column("b")[0] else y  # a block against itself
        bad = False
        for i in range(0, len(x), 1024):
            bad = bad or (len(y) > 0 and float((x[i : i + 1024] @ y.T).min()) < threshold - exact)
        for i in range(0, len(z), 1024):
            bad = bad or (len(x) > 0 and float((z[i : i + 1024] @ x.T).max()) >= threshold)
        return pa.table([pa.array([table.column("pivot")[0].as_py()] if bad else [], pa.string())], names=["pivot"])

    fails = left.unionByName(right).unionByName(outer).groupBy("pivot", "a", "b").applyInArrow(broken, "pivot string").distinct()
    good = members.join(fails, "pivot", "left_anti")
    first = good.groupBy("pivot").agg(F.min("id").alias("cluster_id"))
    return good.join(first, "pivot").select("cluster_id", "id", "n", "typicality")


def outsiders(labelled: DataFrame, centers: DataFrame, n: int, threshold: float) -> DataFrame:
    """``(pivot, vector)``: records near a cluster that are not in it, candidates for breaking it.

    A record that is as similar as the threshold says to a member of typicality
    t has the cosine ``threshold * t`` to the mean direction if the rest of it
    points anywhere; the spread of that over directions in 128 dimensions is
    known, and candidates are taken down to six times the spread below, for the
    cluster's least typical member. Mean directions are compared with all
    records in blocks of `CENTERS`, one pass each; the number of clusters grew as the
    square root of the records in the test data, so one pass is the rule.
    """
    found = [labelled.select("pivot", "vector").limit(0)]
    for names, c, t in center_blocks(centers, n):
        t = np.clip(t, 0, 1)
        box = labelled.sparkSession.sparkContext.broadcast((names, c, threshold * t - 6 * np.sqrt((1 - threshold**2) * (1 - t * t) / 127)))

        def run(batches, box=box):
            names, c, floor = box.value
            place = {x: k for k, x in enumerate(names)}
            for b in batches:
                if b.num_rows and len(names):
                    s = unit(matrix(b)) @ c.T >= floor
                    own = np.array([place.get(x, -1) for x in b.column("pivot").to_pylist()])
                    s[np.nonzero(own >= 0)[0], own[own >= 0]] = False
                    i, j = np.nonzero(s)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(names[j], pa.string()), b.column("vector").take(pa.array(i))], names=["pivot", "vector"])

        found.append(labelled.select("pivot", "vector").mapInArrow(run, "pivot string, vector array<float>"))
    return functools.reduce(DataFrame.unionByName, found)


def describe(clusters: DataFrame, typical: int = 3) -> DataFrame:
    """``(cluster_id, size, typical_ids)``: the most typical members first, ties to the smaller id."""
    w = Window.partitionBy("cluster_id").orderBy(F.desc(F.round("typicality", 9)), "id")
    top = clusters.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= typical)
    return top.groupBy("cluster_id").agg(F.max("n").alias("size"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("typical_ids"))
