"""Problem 2: near-duplicate records by PartEnum signatures.

A record becomes a set of equal size: one element for each of a fixed number
of features (minima of shingle hashes for texts, cross-polytope hash values for
vectors), so similar records differ in few elements. The feature domain is cut
into `parts` partitions, each into `pieces` pieces; for every way to leave out
`drop` pieces of a partition the elements of the others make one signature.
Two records share a signature if in some partition their differences lie within
`drop` pieces. Records that share one are compared exactly.

A signature that more than `HOT` records share, as a template does that many
texts begin with, gives no pairs. Its texts go a second way that is exact: two
sets of similarity t share an element among the ``n - ceil(t n) + 1`` rarest of
each, so texts are listed under those shingles, rarest first by their number in
all hot texts. A template's shingles are the last in that order and bring nothing
together. Vectors of hot signatures are compared exactly in blocks by matrix
products, which write only the pairs that are similar.

Exact copies are grouped before and meet nothing but their representative, so a
group of copies of any size costs one row a copy.

There are many signatures a record, so they and the pairs that meet carry the
number that a record has in the written table of features; its id comes back when
the sketches of a pair are compared. Contents move only of records that are in a
pair or share a hot signature.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.vectors import cross_polytope, fold64, matrix, pair_cosine, rotations, unit
from skein.session import cut_lineage, drop_table, maybe_broadcast

WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Records of one signature up to which all their pairs are candidates.
HOT = 64
#: Up to so many copies of one text are given as all their pairs by default; beyond, as pairs with the smallest id.
ALL_PAIRS = 64


def enumerate_signatures(features: np.ndarray, parts: int, pieces: int, drop: int, salt: int) -> list[np.ndarray]:
    """One column of 64-bit signatures for each partition and choice of pieces."""
    width = features.shape[1] // parts
    step = width // pieces
    out = []
    for p in range(parts):
        own = features[:, p * width : (p + 1) * width]
        for c, kept in enumerate(combinations(range(pieces), pieces - drop)):
            cols = np.concatenate([np.arange(k * step, (k + 1) * step) for k in kept])
            out.append(fold64(own[:, cols], salt + 1000 * p + c + 1))
    return out


def word_hashes(text: str, known: dict) -> np.ndarray:
    """64-bit numbers of the words of a text in order; `known` keeps those of frequent words."""
    out = []
    for w in WORD.findall(text.lower()):
        h = known.get(w)
        if h is None:
            h = 0xCBF29CE484222325
            for b in w.encode("utf-8", "surrogatepass"):
                h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
            if len(known) < 200_000:
                known[w] = h
        out.append(h)
    return np.array(out, np.uint64)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct sequences of `width` successive words as 64-bit numbers."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ words[k : k + n]) * _MIX
        h ^= h >> np.uint64(31)
    return np.unique(h)


def text_features(texts: DataFrame, width: int, least_words: int, parts: int, pieces: int) -> DataFrame:
    """``(id, features, sketch)`` of texts with at least `least_words` words: one shingle minimum a piece.

    ``sketch`` holds one byte of each minimum, to estimate a similarity from.
    """
    rng = np.random.default_rng(11)
    m = parts * pieces
    mul = rng.integers(1, 2**63, m, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(1, 2**63, m, dtype=np.uint64)

    def run(batches):
        known: dict = {}
        for b in batches:
            ids, feats = [], []
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                # A word and what divides it from the next take two characters or more.
                if len(t) < 2 * least_words - 1 or len(w := word_hashes(t, known)) < max(least_words, width):
                    continue
                s = shingles(w, width)
                low = np.full(m, np.iinfo(np.uint64).max, np.uint64)
                for k in range(0, len(s), 4096):  # texts of any length, in stretches
                    low = np.minimum(low, (((s[k : k + 4096, None] * mul) + add) >> np.uint64(32)).min(axis=0))
                ids.append(i)
                feats.append(low.astype("<u4"))
            small = [((f ^ (f >> np.uint32(11))) & np.uint32(255)).astype(np.uint8).tobytes() for f in feats]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([f.tobytes() for f in feats], pa.binary()), pa.array(small, pa.binary())], names=["id", "features", "sketch"])

    return texts.select("id", "text").mapInArrow(run, "id string, features binary, sketch binary")


def numbered(features: DataFrame) -> DataFrame:
    """The features as a written table, with the number ``no`` of each record in it."""
    return cut_lineage(features.withColumn("no", F.monotonically_increasing_id()))


def text_signatures(features: DataFrame, parts: int, pieces: int, drop: int) -> DataFrame:
    """``(sig, no)`` from `text_features` that are `numbered`."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                f = np.frombuffer(b"".join(b.column("features").to_pylist()), "<u4").reshape(b.num_rows, -1)
                for sig in enumerate_signatures(f, parts, pieces, drop, 1):
                    yield pa.RecordBatch.from_arrays([pa.array(sig), b.column("no")], names=["sig", "no"])

    return features.select("no", "features").mapInArrow(run, "sig bigint, no bigint")


def likely(pairs: DataFrame, features: DataFrame, least: int) -> DataFrame:
    """``(a, b)``, ids with ``a < b``, of the pairs of numbers whose sketches agree in at least `least` places."""
    s = features.select("no", "id", "sketch")
    full = pairs.join(s.select(F.col("no").alias("m"), F.col("id").alias("a"), F.col("sketch").alias("sa")), "m").join(s.select(F.col("no").alias("n"), F.col("id").alias("b"), F.col("sketch").alias("sb")), "n")

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("sa", "sb"))
                yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return full.select("a", "b", "sa", "sb").mapInArrow(run, "a string, b string").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def vector_features(rows: DataFrame, parts: int, pieces: int, step: int) -> DataFrame:
    """``(id, sketch)`` of usable vectors: cross-polytope hash values, one byte each."""
    rot = rotations(5, parts * pieces * step // 2)

    def run(batches):
        for b in batches:
            if b.num_rows:
                f = cross_polytope(unit(matrix(b)), rot, 64)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for x in f], pa.binary())], names=["id", "sketch"])

    return rows.select("id", "vector").mapInArrow(run, "id string, sketch binary")


def vector_signatures(features: DataFrame, parts: int, pieces: int, drop: int) -> DataFrame:
    """``(sig, no)`` from `vector_features` that are `numbered`."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                f = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                for sig in enumerate_signatures(f, parts, pieces, drop, 2):
                    yield pa.RecordBatch.from_arrays([pa.array(sig), b.column("no")], names=["sig", "no"])

    return features.select("no", "sketch").mapInArrow(run, "sig bigint, no bigint")


def meeting(signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(m, n)``, ``m < n``: the distinct pairs of numbers that share a signature of few records, and ``(sig, no, n)`` of the others.

    One shuffle counts the records of each signature; only those with company
    are written and go on.
    """
    n = F.count("*").over(Window.partitionBy("sig"))
    met = cut_lineage(signatures.withColumn("n", n).filter("n > 1"))
    few = met.filter(F.col("n") <= HOT)
    left, right = few.select("sig", F.col("no").alias("m")), few.select("sig", F.col("no").alias("n"))
    return left.join(right, "sig").filter("m < n").select("m", "n").distinct(), met.filter(F.col("n") > HOT)


def named(hot: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Hot signatures with ids for numbers, ``(sig, id, n)``, and ``(id)`` of their distinct records with the count of these."""
    numbers = cut_lineage(hot.select("no").distinct())
    count = numbers.count()
    ids = cut_lineage(features.select("no", "id").join(maybe_broadcast(numbers, count), "no", "left_semi"))
    return hot.join(maybe_broadcast(ids, count), "no").select("sig", "id", "n"), ids.select("id"), count


def prefix_pairs(texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """``(a, b)``: all pairs of texts ``(id, text)`` that may reach the threshold, by the rarest shingles of each.

    Exact: no similar pair is missing. Texts that share more than about half of
    their shingles with very many others still meet all of them.
    """

    def run(batches):
        known: dict = {}
        for b in batches:
            sets = [shingles(word_hashes(t, known), width).view(np.int64) for t in b.column("text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "g"])

    sets = cut_lineage(texts.select("id", "text").mapInArrow(run, "id string, g array<bigint>"))
    each = sets.select("id", F.size("g").alias("size"), F.explode("g").alias("g"))
    df = each.groupBy("g").agg(F.count("*").alias("df"))
    # A shingle of one text brings nothing together, but takes its place in the order.
    order = F.row_number().over(Window.partitionBy("id").orderBy("df", "g"))
    listed = each.join(df, "g").withColumn("at", order).filter(F.col("at") <= F.col("size") - F.ceil(threshold * F.col("size")) + 1).filter("df > 1")
    listed = cut_lineage(listed.select("g", "id", "size"))
    left, right = listed.select("g", F.col("id").alias("a"), F.col("size").alias("m")), listed.select("g", F.col("id").alias("b"), F.col("size").alias("n"))
    # Equal-size bands: the smaller set of a similar pair has at least the threshold's share of the larger.
    both = left.join(right, "g").filter((F.col("a") < F.col("b")) & (F.least("m", "n") >= threshold * F.greatest("m", "n")))
    return both.select("a", "b").distinct()


def block_pairs(hot: DataFrame, rows: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """``(a, b)`` of vectors that share a hot signature and reach the threshold, compared in blocks.

    Of `rows` only those that share a hot signature move.
    """
    hot = cut_lineage(hot)
    ids = cut_lineage(hot.select("id").distinct())
    rows = rows.select("id", "vector").join(maybe_broadcast(ids, ids.count()), "id", "left_semi")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("id", "sig"), F.col("blocks")).cast("int")
    cells = hot.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("sig", "id", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(rows, "id")

    def near(table):
        own, i, j = table.column("own").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        ids, u = np.array(table.column("id").to_pylist(), dtype=object), unit(matrix(table), np.float64)
        x, y = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
        out = []
        for k in range(0, len(x), 512):
            a, b = np.nonzero(u[x[k : k + 512]] @ u[y].T >= threshold - 1e-9)
            out += [(p, q) for p, q in zip(ids[x[k + a]], ids[y[b]]) if p != q]
        return pa.table([pa.array([min(p) for p in out], pa.string()), pa.array([max(p) for p in out], pa.string())], names=["a", "b"])

    return cells.groupBy("sig", "i", "j").applyInArrow(near, "a string, b string").distinct()


def jaccard(pairs: DataFrame, width: int) -> DataFrame:
    """``(a, b, sim)`` from rows ``(a, b, ta, tb)``: similarity of the whole texts' shingle sets."""

    def run(batches):
        known: dict = {}
        for b in batches:
            sets: dict = {}

            def of(i, t, sets=sets):
                if i not in sets:
                    sets[i] = shingles(word_hashes(t, known), width)
                return sets[i]

            sim = []
            for a, c, ta, tc in zip(*(b.column(k).to_pylist() for k in ("a", "b", "ta", "tb"))):
                x, y = of(a, ta), of(c, tc)
                both = len(np.intersect1d(x, y, assume_unique=True))
                sim.append(both / max(1, len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(sim, pa.float64())], names=["a", "b", "sim"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a string, b string, sim double")


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(id_a, id_b)`` of all records from pairs of representatives and the members of their groups.

    `members` is ``(rep, ids, n)`` for groups of several copies. Groups of at
    most `ALL_PAIRS` are expanded to all pairs; a larger group is given as pairs
    of its smallest id with each other member (``ids`` then holds just that id).
    """
    of_a, of_b = members.select(F.col("rep").alias("a"), F.col("ids").alias("xs")), members.select(F.col("rep").alias("b"), F.col("ids").alias("ys"))
    two = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    across = two.select(F.explode(F.coalesce("xs", F.array("a"))).alias("x"), F.coalesce("ys", F.array("b")).alias("ys")).select("x", F.explode("ys").alias("y"))
    within = members.filter(F.size("ids") > 1).select(F.explode("ids").alias("x"), "ids").select("x", F.explode("ids").alias("y")).filter("x < y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def copies(rows: DataFrame, by: str, most: int = ALL_PAIRS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Representatives ``(id, by)``, members ``(rep, ids, n)`` of groups of copies and the star pairs of large ones.

    The last is the written table with the content, which only the
    representatives read: drop it when they have been read for the last time.

    Groups are formed by two 64-bit hashes of the content; counts and the
    smallest id are pre-aggregated. Lists are collected only of groups within
    `most`, so none grows without bound. The content moves only if there are
    too many copies to ship the list of their ids.
    """
    stored = cut_lineage(rows.select("id", by, F.xxhash64(by).alias("k1"), F.xxhash64(F.lit(1), by).alias("k2")))
    several = stored.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("id").alias("rep")).filter("n > 1")
    grouped = cut_lineage(stored.select("id", "k1", "k2").join(several, ["k1", "k2"]).select("id", "rep", "n"))
    members = grouped.filter(F.col("n") <= most).groupBy("rep").agg(F.collect_list("id").alias("ids"), F.max("n").alias("n"))
    large = grouped.filter(F.col("n") > most)
    members = members.unionByName(large.filter("id = rep").select("rep", F.array("rep").alias("ids"), "n"))
    star = large.filter("id <> rep").select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
    again = grouped.filter("id <> rep").select("id")
    reps = stored.select("id", by).join(maybe_broadcast(again, again.count()), "id", "left_anti")
    return reps, members, star, stored


def membership(rows: DataFrame, by: str) -> DataFrame:
    """``(id, rep, copies)`` of every record that has copies: the smallest id of its group, and the group's size."""
    keyed = rows.filter(F.col("id").isNotNull() & F.col(by).isNotNull()).select("id", F.xxhash64(by).alias("k1"), F.xxhash64(F.lit(1), by).alias("k2"))
    several = keyed.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("id").alias("rep")).filter("copies > 1")
    return keyed.join(several, ["k1", "k2"]).select("id", "rep", "copies")


def with_content(pairs: DataFrame, reps: DataFrame, by: str, names: tuple[str, str]) -> DataFrame:
    """Pairs ``(a, b)`` with the content of both; only records that occur in a pair move."""
    pairs = cut_lineage(pairs)
    met = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    few = cut_lineage(reps.join(maybe_broadcast(met, 2 * pairs.count()), "id", "left_semi"))
    left = pairs.join(few.select(F.col("id").alias("a"), F.col(by).alias(names[0])), "a")
    return left.join(few.select(F.col("id").alias("b"), F.col(by).alias(names[1])), "b")


def similar_texts(chunks: DataFrame, threshold: float = 0.5, width: int = 3, least_words: int = 45, parts: int = 16, pieces: int = 4, drop: int = 1, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``, of near-duplicate texts.

    `chunks` holds ``id, text`` with unique ids; null texts and those below
    `least_words` words are no record. With one shingle minimum a piece, a pair
    at 0.5 shares a signature with probability 0.9975 and one at 0.55 with
    0.9996. Texts are compared whole. Of a group of more than `all_pairs` copies
    only the pairs with the smallest id are given; `membership` gives every copy
    with that id, so that no link is lost.
    """
    reps, members, star, stored = copies(chunks.filter("id IS NOT NULL AND text IS NOT NULL"), "text", all_pairs)
    features = numbered(text_features(reps, width, least_words, parts, pieces))
    # Pairs meet by few elements; before texts move, all of them are compared. Of a pair at the threshold
    # half agree; little more than half of those, the least asked for, lies three standard deviations below.
    few, hot = meeting(text_signatures(features, parts, pieces, drop))
    met = likely(few, features, int(parts * pieces * threshold * 0.55))
    _, hot, number = named(hot, features)
    if number:
        met = met.unionByName(prefix_pairs(reps.join(maybe_broadcast(hot, number), "id", "left_semi"), width, threshold)).distinct()
    near = jaccard(with_content(met, reps, "text", ("ta", "tb")), width).filter(F.col("sim") >= threshold)
    # A text that stands alone without enough words has no signature; copies are looked at here.
    several = members.select(F.col("rep").alias("id"))
    long = cut_lineage(long_enough(reps.join(several, "id", "left_semi"), least_words))
    members = members.join(long.withColumnRenamed("id", "rep"), "rep", "left_semi")
    star = star.join(long.withColumnRenamed("id", "id_a"), "id_a", "left_semi")
    # What follows reads the written pairs and the contents of those only.
    drop_table(features)
    drop_table(stored)
    return expand(near.select("a", "b"), members).unionByName(star)


def long_enough(texts: DataFrame, least_words: int) -> DataFrame:
    """``(id)`` of texts with at least so many words."""

    def run(batches):
        for b in batches:
            t = b.column("text").to_pylist()
            # A word and what divides it from the next take two characters or more.
            keep = [i for i, x in enumerate(t) if len(x) >= 2 * least_words - 1 and len(WORD.findall(x.lower())) >= least_words]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(keep, pa.int64()))], names=["id"])

    return texts.select("id", "text").mapInArrow(run, "id string")


def similar_vectors(records: DataFrame, threshold: float = 0.99, parts: int = 5, pieces: int = 3, drop: int = 1, step: int = 4, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``, of current usable records with nearly equal vectors.

    Measured, a pair at 0.99 shares a signature with probability 0.98 and one
    at 0.995 with 0.999.
    """
    reps, members, star, stored = copies(records, "vector", all_pairs)
    features = numbered(vector_features(reps, parts, pieces, step))
    # Of a pair at the threshold 85 % of the values agree, of others in one cluster below half.
    few, hot = meeting(vector_signatures(features, parts, pieces, drop))
    met = likely(few, features, parts * pieces * step * 2 // 3)
    if hot.limit(1).count():
        met = met.unionByName(block_pairs(named(hot, features)[0], reps, threshold)).distinct()
    near = pair_cosine(with_content(met, reps, "vector", ("va", "vb"))).filter(F.col("sim") >= threshold)
    # What follows reads the written pairs and the contents of those only.
    drop_table(features)
    drop_table(stored)
    return expand(near.select("a", "b"), members).unionByName(star)
