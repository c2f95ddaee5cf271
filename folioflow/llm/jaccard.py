"""N-gram Jaccard join by PartEnum signatures.

Sets are dealt into bands of alike sizes. In a band, two sets of a similarity of at least the threshold differ in
at most k elements. The feature domain is partitioned into groups of parts such that k differences leave, in
enough groups, at most one part unequal; each subset of a group's parts with one part left out is hashed into a
signature, unless it has no element, when it would say nothing. So similar sets share a signature, and only sets that
share one are compared.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RANGE, batches_of, components, join_first, shared_counts, texts, written

PARTS, LEFT_OUT = 3, 1  # of a group; subsets of PARTS - LEFT_OUT parts are enumerated
ROUNDS = 16  # partitions of the domain that are tried
TOGETHER = 1 << 22  # bytes of texts that are shingled together
_SUBSETS = list(itertools.combinations(range(PARTS), PARTS - LEFT_OUT))
_FIRST = [[x[p] for x in _SUBSETS] for p in range(PARTS - LEFT_OUT)]
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``n``-word shingles: A-Z lower-cased, words between ASCII white
    space; with fewer words, the sequence as one; without words, none. Texts are looked at together, some MB at a time."""
    from .lm import Words  # which takes _mix from here

    out: list[np.ndarray] = []
    piece = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // TOGETHER
    edges = np.flatnonzero(np.diff(piece, prepend=-1)).tolist()
    for i, j in itertools.pairwise([*edges, len(texts)]):
        words = Words(texts.slice(i, j - i))
        k = np.minimum(n, words.n)
        many = np.where(words.n > 0, words.n - k + 1, 0)  # shingles of each text
        ends = np.cumsum(many)
        at = np.arange(many.sum()) + np.repeat(np.cumsum(words.n) - words.n - (ends - many), many)  # their first words
        k = np.repeat(k, many)
        h = k.astype(np.uint64)
        for x in range(n):
            longer = _mix(h * _M + words.h[np.minimum(at + x, len(words.h) - 1)])
            h = np.where(k > x, longer, h)
        new = np.ones(len(h), bool)
        for a, b in zip((ends - many).tolist(), ends.tolist(), strict=True):
            h[a:b].sort()
        new[1:] = h[1:] != h[:-1]
        new[(ends - many)[many > 0]] = True
        kept = np.concatenate([[0], np.cumsum(new)])[np.concatenate([[0], ends])].tolist()
        h = h[new]
        out += [h[a:b] for a, b in itertools.pairwise(kept)]
    return out


def shingle_set(text: str, n: int) -> np.ndarray:
    """See `shingle_sets`."""
    return shingle_sets(pa.array([text], pa.string()), n)[0]


class Bands:
    """Size bands for a similarity of ``num / den`` or more: band b has the sizes in (edge[b - 1], edge[b]]."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges = [1]

    def of(self, size: int) -> int:
        while self.edges[-1] < size:  # partners of a size in band b are in b - 1, b and b + 1
            self.edges.append(max(self.edges[-1] + 1, (self.edges[-1] + 1) * self.den // self.num))
        return bisect.bisect_left(self.edges, size)

    @functools.cache  # noqa: B019  a few for each task
    def differences(self, band: int) -> int:
        """The most elements in which two sets of sizes up to the band's edge can differ and yet be similar."""
        while band >= len(self.edges):
            self.of(self.edges[-1] + 1)
        return (self.den - self.num) * 2 * self.edges[band] // (self.den + self.num)

    @functools.cache  # noqa: B019
    def groups(self, band: int) -> tuple[int, int]:
        """(groups, spare ones among them): as many spare ones as make the fewest signatures, by the Poisson chance
        that a set of the band lacks elements for a subset in more groups than that."""
        k = self.differences(band)
        size = self.edges[max(0, band - 1)]
        best = (math.inf, 0, 0)
        for spare in sorted({*range(1, 9), *(int(8 * 1.25**i) for i in range(1, 40) if 8 * 1.25**i < k)}):
            groups = k // (LEFT_OUT + 1) + 1 + spare
            empty = math.exp(-size / (groups * PARTS))
            mean = max(1e-300, groups * (PARTS * empty**2 * (1 - empty) + empty**PARTS))
            more = max(0.0, 1 - sum(math.exp(-mean + i * math.log(mean) - math.lgamma(i + 1)) for i in range(spare + 1)))
            best = min(best, (groups / max(1e-9, 1 - more), groups, spare))
        return best[1:]


def signatures(elements: np.ndarray, bands: Bands) -> np.ndarray:
    """The set's signatures, in its own band and the next one (where larger partners look).

    With k differences, floor(k / 2) groups at most have two unequal parts or more, and there are 1 + ``spare`` groups
    more than that. A set that lacks elements for subsets of at most ``spare`` groups so has a group of whole subsets
    among those with one unequal part at most: it shares a signature with every similar set. A set that lacks them
    in more groups has its signatures by the next partition of the domain too, and so on; of two such sets, both go
    on as far as the first one that doesn't lack. Sets that do so in all ROUNDS partitions (next to none) also have the
    last one's signatures without elements. In a band where k is 0, only equal sets are similar.
    """
    out = []
    mixed = _mix(elements ^ np.uint64(0x5851F42D4C957F2D))
    band = bands.of(len(elements))
    for b in (band, band + 1):
        if not bands.differences(b):
            continue
        groups, spare = bands.groups(b)
        for r in range(ROUNDS):
            cell = (_mix(elements + np.uint64(b * ROUNDS + r)) % np.uint64(groups * PARTS)).astype(np.int64)
            sums = np.zeros(groups * PARTS, np.uint64)
            np.add.at(sums, cell, mixed)
            full = (np.bincount(cell, minlength=groups * PARTS).reshape(groups, PARTS)[:, _SUBSETS] > 0).any(axis=2)
            start = (b * ROUNDS + r) << 36
            h = np.arange(start, start + groups * len(_SUBSETS), dtype=np.uint64).reshape(groups, len(_SUBSETS))
            for p in range(PARTS - LEFT_OUT):
                h = h * _M + sums.reshape(groups, PARTS)[:, _FIRST[p]]
            h = _mix(h)
            enough = (~full.all(axis=1)).sum() <= spare
            out.append(h[full] if enough or r < ROUNDS - 1 else h.ravel())
            if enough:
                break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def parities(elements: np.ndarray) -> np.ndarray:
    """A bit for each of about 1.5 to 3 cells a set element: whether the cell has an odd number of elements. Two sets
    differ in at least as many elements as cells."""
    cells = max(64, 1 << (3 * len(elements) // 2).bit_length())
    odd = np.bincount((_mix(elements) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _unequal_cells(a: Column, b: Column) -> Column:
    """Cells in which two arrays of parities differ; if one has twice the cells, its halves are added first."""
    half = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda p, q: p.bitwiseXOR(q))).otherwise(x)
    return F.aggregate(F.zip_with(half(a, b), half(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, x: n + x)


def _may_link(n: Column, odd: Column, n_b: Column, odd_b: Column, num: int, den: int) -> Column:
    """False only for pairs that sizes or parities prove too far apart."""
    alike = (n * den >= n_b * num) & (n_b * den >= n * num)
    return alike & (_unequal_cells(odd, odd_b) * (den + num) <= (n + n_b) * (den - num))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with ``common`` and the two sizes; the arrays travel once for each pair and side."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("elements").alias("s_a")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("elements").alias("s_b")), "b")

    def count(batches):
        for x in batches:
            common = [len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)) for a, b in zip(x.column("s_a").to_pylist(), x.column("s_b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in ("a", "b", "n_a", "n_b")), pa.array(common, pa.int64())], ["a", "b", "n_a", "n_b", "common"])

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(count, "a long, b long, n_a long, n_b long, common long")


def similarity_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", per_range: int = RANGE) -> DataFrame:
    """(doc_id, n_shingles, n_links, component_id) of every row: sets of ``n``-word shingles link when
    den * intersection >= num * union; the component's id is the smallest id that links reach.

    Documents without words link with nothing. Equal sets are one class from the start: only its smallest id goes
    on, so copies cost no pairs. ``n_links`` counts checked links between that class and others. Rows with the
    same id count as one document; with different texts under one id, that id stands for each of the sets.
    Null ids link with nothing and are their own component (null).

    Shingles are dealt by ranges of their hashes (`shared_counts`, about ``per_range`` each) to find the sets of which enough shingles stand in
    another set too; only these have signatures made and shuffled. A similar partner shares at least ``num / den`` of a set's shingles,
    so none is lost, and a shingle that is taken for another one by chance does no harm.

    Links are found in two steps that together lose none. First every signature's members are compared with the
    smallest of them only. Then, in signatures whose members have not met in one component, the pairs from
    different components are compared, unless their parities (a short bitmap of each set, which bounds from below
    in how many elements two sets differ) already prove them too far apart.
    """
    rows = texts(docs, id_col, text_col)
    bands = Bands(num, den)

    def measure(batches):
        for b in batches_of(batches):
            sets = shingle_sets(b.column("text"), n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rid"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())], ["doc_id", "rid", "size", "same"])

    sized = written(rows.mapInArrow(measure, "doc_id long, rid long, size long, same binary"), "sets")
    known = sized.where("doc_id is not null and same is not null")
    classes = known.groupBy("same").agg(F.min(F.struct("doc_id", "rid")).alias("rep"), F.count("*").alias("n"))
    first = written(classes.select("same", F.col("rep.doc_id").alias("node"), F.col("rep.rid").alias("first_rid"), "n"), "classes")
    members = written(join_first(known, first, "same").select("doc_id", "rid", "size", "node", "first_rid"), "members")

    again = written(members.where((F.col("doc_id") != F.col("node")) | (F.col("rid") != F.col("first_rid"))).select("doc_id", "rid").distinct(), "again")
    small = again.count() <= 2_000_000  # 32 MB at most
    tag = F.pmod(F.xxhash64("doc_id", "rid"), F.lit((1 << 31) - 1)).cast("int").alias("tag")
    own = rows.where("doc_id is not null").join(F.broadcast(again) if small else again, ["doc_id", "rid"], "left_anti").select("doc_id", "text", tag)
    firsts = members.where((F.col("doc_id") == F.col("node")) & (F.col("rid") == F.col("first_rid"))).select("node", "size", tag)
    elements_in = firsts.agg(F.sum("size")).first()[0] or 0
    hits_of = shared_counts(own.select("tag", "text"), lambda b: shingle_sets(b.column("text"), n), elements_in, per_range)
    able = firsts.join(hits_of, "tag").where(F.col("hits") * den >= F.col("size") * num)

    def sign(batches):
        for b in batches_of(batches):
            each = [np.unique(signatures(s, bands)) for s in shingle_sets(b.column("text"), n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("doc_id").to_numpy(), [len(x) for x in each]), pa.int64()), pa.array(np.concatenate(each).view(np.int64) if each else np.zeros(0, np.int64))], ["node", "sig"])

    able = written(able.select("node").distinct(), "able")
    able = able.select(F.col("node").alias("doc_id"))
    signed = written(own.join(F.broadcast(able) if able.count() <= 2_000_000 else able, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(sign, "node long, sig long"), "signed")
    shared = signed.groupBy("sig").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("sig")
    hits = written(signed.join(shared, "sig").distinct(), "hits")
    pivots = hits.groupBy("sig").agg(F.min("node").alias("pivot"))
    stars = hits.join(pivots, "sig").select(F.col("pivot").alias("a"), F.col("node").alias("b")).where("a < b").distinct()

    def of_nodes(nodes: DataFrame, what, schema: str) -> DataFrame:
        """(node, n, ...) by ``what`` of the shingle sets of ``nodes``: of their classes' representatives alone."""
        nodes = written(nodes, "nodes")
        part = first.join(nodes, "node", "left_semi").select(F.col("node").alias("doc_id"), F.col("first_rid").alias("rid"))
        if nodes.count() <= 2_000_000:  # 32 MB at most
            part = F.broadcast(part)

        def pick(batches):
            for b in batches_of(batches):
                sets = shingle_sets(b.column("text"), n)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), what(sets)], ["node", "n", "x"])

        return rows.join(part, ["doc_id", "rid"], "left_semi").select("doc_id", "text").mapInArrow(pick, f"node long, n long, x {schema}")

    def elements(pairs: DataFrame) -> DataFrame:
        found = of_nodes(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), lambda sets: pa.array([s.tobytes() for s in sets], pa.binary()), "binary")
        return written(found.withColumnRenamed("x", "elements").dropDuplicates(["node", "elements"]), "elements")

    sets = of_nodes(hits.select("node").distinct(), lambda sets: pa.array([parities(s) for s in sets], pa.list_(pa.int64())), "array<long>")
    sets = written(sets.withColumnRenamed("x", "odd").dropDuplicates(["node", "n", "odd"]), "parities")
    is_link = F.expr(f"common * {den} >= (n_a + n_b - common) * {num}")
    short = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}"))
    stars = stars.join(short("a"), "a").join(short("b"), "b").where(_may_link(F.col("n_a"), F.col("odd_a"), F.col("n_b"), F.col("odd_b"), num, den)).select("a", "b").distinct()
    stars = written(stars, "stars")
    tested = written(_similar(stars, elements(stars)), "tested")
    links = tested.where(is_link)
    now = components(links.select("a", "b"))

    # members of one signature that have not met
    at = hits.join(now, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = at.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("sig")
    at = written(at.join(apart, "sig").join(sets.select("node", "n", "odd"), "node"), "apart")
    other = at.select("sig", *(F.col(c).alias(f"{c}_b") for c in ("node", "component", "n", "odd")))
    apart = (F.col("node") < F.col("node_b")) & (F.col("component") != F.col("component_b"))
    met = at.join(other, "sig").where(apart & _may_link(*(F.col(c) for c in ("n", "odd", "n_b", "odd_b")), num, den))
    more = met.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    more = written(more, "more")
    late = written(_similar(more, elements(more)).where(is_link), "late")

    # an id under which several sets stand links their classes
    same = members.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    links = links.select("a", "b").unionByName(late.select("a", "b")).distinct()
    whole = components(links.unionByName(same.distinct()))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    alone = sized.where("doc_id is null or same is null").select("doc_id", F.col("size").alias("n_shingles"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    out = members.join(whole.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(degree, "node", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "doc_id").alias("component_id")).unionByName(alone)


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id. Rows that repeat that id all stay, and so
    do null ids."""
    ids = how.get("id_col", "doc_id")
    lost = similarity_components(docs, **how).where("component_id <> doc_id").select(F.col("doc_id").alias(ids)).distinct()
    return docs.join(lost, ids, "left_anti")
