"""Near-duplicate documents by bottom-k sketches from one hash function.

1. Each document's distinct word shingles are hashed once; the sketch is the k least hashes. Documents with the same set
   form a class, and from here on a class is its least doc_id.
2. Inverted lists of retained values: with the values of all sketches put in one order, rarest first, two sketches that
   share at least c values share one among the first k - c + 1 of each. c is the least overlap that a linked pair's
   sketches show but with a probability under 1e-7 (where a set has k shingles at most, its sketch is the set and the
   bound is certain). Values that stand in one list entry only are dropped.
3. Overlaps are generated from the lists without all pairs of a large one. First each list's members are compared with one of
   them, and what passes is linked; from then on only members of different components need to meet. Lists of SMALL rows at
   most (SMALL_DIFFERENCES further on) are then compared in full. The members of the larger ones form groups, each with a centre: the shingles that more
   than half of its members have. With D shingles of the centre missing and A others added, two members that share none of
   these differences are linked just if (100 D + t A) of both add up to (100 - t) times the centre's size at most (t: the
   threshold in hundredths), and sharing some only brings them closer; so the most central member is linked to
   every member that any such pair can link. Components are joined again, and members of the most central one's component need
   to meet the others only. Pairs of different components share differences, as many as the same sum tells for the nearest of those to be met, so
   the differences, frequent ones last and cut to a prefix, are the next lists. A shingle that is added by some is not in the centre, and one that is missing
   is, so at most half of a group has the difference. Lists with one first member share a group for LEVELS levels; from then on each list is a
   group, so lists halve from level to level until all are small, and none is ever compared in all pairs.
4. A pair is filtered by size and by the estimate from the union's sketch, then verified on the full sets.

The result is exact but for that probability.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.components import components
from tracewright.llm.storage import bucketed, scratch, written
from tracewright.llm.textkernels import chunks, rolling, signed, texts_of, words_of

SKETCH = 32
#: Rows of a list of values, and of one of differences, that are compared in full. The latter are few.
SMALL, SMALL_DIFFERENCES = 32, 256
#: Levels whose lists share groups.
LEVELS = 4
_MISS = 1e-7


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Ascending distinct hashes of each text's n-word shingles, A-Z lower-cased; a text of fewer words is one shingle."""
    out: list[np.ndarray] = []
    for i, j in chunks(texts):
        w = words_of(texts[i:j])
        hashes = w.hashes(lower=True)
        grams = rolling(hashes, n, 0x9FB21C651E98DF25)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            else:
                out.append(rolling(hashes[a:b], b - a, 0x61C8864680B583EB + b - a) if b > a else np.empty(0, np.uint64))
    return out


def least_overlap(percent: int, k: int) -> int:
    """The largest c such that fewer than c of the union's k least hashes are shared with a probability under 1e-7."""
    p, total = percent / 100, 0.0
    for c in range(k + 1):
        total += math.comb(k, c) * p**c * (1 - p) ** (k - c)
        if total > _MISS:
            return c
    return k


def sure_overlap(n: int, percent: int, k: int) -> int:
    """The fewest values that the sketches of a set of n <= k shingles and of any set linked with it share.

    A partner of m shingles has ceil(percent (n + m) / (100 + percent)) of them in common at least; its sketch may leave out m - k.
    """
    return min(-(-percent * (n + m) // (100 + percent)) - max(0, m - k) for m in range(-(-percent * n // 100), 100 * n // percent + 1))


def _sketches(shingle: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(texts_of(batch.column(1)), shingle)
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            offsets = np.zeros(len(sets) + 1, np.int32)
            np.cumsum([min(k, len(s)) for s in sets], out=offsets[1:])
            flat = np.concatenate([s[:k] for s in sets]) if sets else np.empty(0, np.uint64)
            sketch = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(flat)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), sketch], ["doc_id", "n_shingles", "print", "sketch"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), texts_of(batch.column(1))
            for i, j in chunks(texts):
                sets = shingle_sets(texts[i:j], shingle)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "shingles"])

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int, k: int, least: int) -> bool:
    """The union sketch's estimate, then the exact share of two ascending sets."""
    small_x, small_y = x[:k], y[:k]
    union = np.union1d(small_x, small_y)[:k]
    # A union of under k shingles is seen whole.
    enough = least if len(union) == k else -(-percent * len(union) // 100)
    if np.isin(union, small_x).__and__(np.isin(union, small_y)).sum() < enough:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(percent: int, k: int):
    least = least_overlap(percent, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column(2), batch.column(3)
            ok = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent, k, least) for x, y in zip(xs, ys, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _lists(reps: DataFrame, percent: int, k: int) -> DataFrame:
    """(value, doc, n): the inverted lists, of the rarest values of each sketch."""
    values = reps.select("doc", "n", F.explode("sketch").alias("value"))
    counts = values.groupBy("value").agg(F.count("*").alias("c")).where("c > 1")
    size = F.least("n", F.lit(k))
    sure = F.array(*(F.lit(sure_overlap(n, percent, k)) for n in range(1, k + 1)))
    enough = F.when(F.col("n") <= k, F.get(sure, F.col("n").cast("int") - 1)).otherwise(F.lit(least_overlap(percent, k)))
    first = (size - enough + 1) - (size - F.size("shared"))
    shared = values.join(counts, "value").groupBy("doc", "n").agg(F.array_sort(F.collect_list(F.struct("c", "value"))).alias("shared"))
    return shared.withColumn("first", first.cast("int")).where("first > 0").select("doc", "n", F.explode(F.slice("shared", F.lit(1), F.col("first"))).alias("x")).select(F.col("x.value").alias("value"), "doc", "n")


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(1)]
        group = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
        yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))], ["grp", "e"])


def _differences(percent: int):
    """For each member: its distance from the centre in hundredths, the most that two linked ones add up to, and the differences.

    Differences that are known to be frequent come last, by frequency; the others come first, by value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far, most, differences = [], [], []
            for x, c, k in zip(batch.column(3), batch.column(4), batch.column(5), strict=True):
                own, centre, known = np.frombuffer(x.as_py(), np.uint64), *(np.array(v.as_py() or [], np.int64).view(np.uint64) for v in (c, k))
                added, missing = np.setdiff1d(own, centre, assume_unique=True), np.setdiff1d(centre, own, assume_unique=True)
                far.append(100 * len(missing) + percent * len(added))
                most.append((100 - percent) * len(centre))
                both, rank = np.concatenate([added, missing]), np.zeros(len(added) + len(missing), np.int64)
                _, at, place = np.intersect1d(both, known, assume_unique=True, return_indices=True)
                rank[at] = place + 1
                differences.append(both[np.lexsort((both, rank))].view(np.int64))
            columns = [*(batch.column(k) for k in range(3)), pa.array(far, pa.int64()), pa.array(most, pa.int64()), pa.array(differences, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["grp", "doc", "n", "far", "most", "differences"])

    return run


def _groups(large: DataFrame, sets: DataFrame, percent: int, level: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of members with the most central one of their group, and the members with their differences."""
    # Lists with the same first member share a group, so copies of one text meet in few groups. A list may hold a large
    # share of the rows: the join is a merge join, which adaptive execution splits.
    first = large.groupBy("value").agg(F.min(F.struct(F.xxhash64("doc").alias("order"), "doc"))["doc"].alias("grp"))
    named = large.join(first.hint("merge"), "value") if level < LEVELS else large.withColumn("grp", F.col("value"))
    members = named.select("grp", "doc", "n").distinct()
    met = written(members, "members").join(sets, "doc").select("grp", "doc", "n", "shingles")
    size = met.groupBy("grp").agg(F.count("*").alias("size"))
    counts = met.select("grp", "shingles").mapInArrow(_elements, "grp long, e long").groupBy("grp", "e").agg(F.count("*").alias("c"))
    # Fewer than eight times the shingles of an average member stand in an eighth of a group.
    known = counts.join(size, "grp").where("8 * c > size").groupBy("grp").agg(
        F.expr("collect_list(e) FILTER (WHERE 2 * c > size)").alias("centre"),
        F.array_sort(F.collect_list(F.struct(F.expr("least(c, size - c)").alias("d"), "e")))["e"].alias("known"),
    )
    rows = met.join(known, "grp", "left").select("grp", "doc", "n", "shingles", "centre", "known").mapInArrow(_differences(percent), "grp long, doc long, n long, far long, most long, differences array<long>")
    # Rows of a large group are spread again by document before their differences are taken apart.
    rows = written(rows.repartition("doc"), "differences")
    best = rows.groupBy("grp").agg(F.min(F.struct("far", "doc")).alias("best"))
    star = rows.join(best, "grp").where("far + best.far <= most AND doc != best.doc")
    return star.select(F.least("doc", "best.doc").alias("a"), F.greatest("doc", "best.doc").alias("b")).distinct(), rows


def _next_lists(rows: DataFrame, percent: int) -> DataFrame:
    """Lists of differences from members (grp, doc, n, far, most, differences, root).

    Members of the component of the most central one need to meet the others only, the nearest of which is known; all of
    a group's members in one component need not meet. Each list is cut to its prefix before it is taken apart.
    """
    gain = 100 + percent
    heads = rows.groupBy("grp").agg(F.min(F.struct("far", "doc", "root")).alias("best"))
    rows = rows.join(heads, "grp").withColumn("inside", F.expr("root = best.root"))
    others = rows.where("NOT inside").groupBy("grp").agg(F.min("far").alias("nearest"))
    rows = rows.join(others, "grp")
    # Least number of shared differences in any pair that still has to meet.
    shared = F.expr(
        f"greatest(1, CASE WHEN inside THEN greatest(ceil((far + nearest - most) / {gain}), ceil((nearest - most) / 100))"
        f" ELSE greatest(ceil((far + best.far - most) / {gain}), ceil((far - most) / 100)) END)"
    )
    rows = rows.withColumn("nd", F.size("differences").cast("long")).withColumn("keep", (F.col("nd") - shared + 1).cast("int")).where("keep > 0")
    prefixes = rows.select("grp", "doc", "n", "far", "most", "nd", F.slice("differences", F.lit(1), F.greatest("keep", F.lit(0))).alias("differences"))
    each = prefixes.select("grp", "doc", "n", "far", "most", "nd", F.explode("differences").alias("e"))
    return each.select(F.xxhash64("grp", "e").alias("value"), "doc", "n", "far", "most", "nd")


def link_classes(reps: DataFrame, texts: DataFrame, shingle: int, percent: int, k: int = SKETCH) -> DataFrame:
    """(node, root) of the classes reps (doc, n, sketch) that are linked, directly or over others."""
    with scratch() as block:
        return block.out(_linked(reps, texts, shingle, percent, k), "roots")


def _linked(reps: DataFrame, texts: DataFrame, shingle: int, percent: int, k: int) -> DataFrame:
    lists = written(_lists(reps, percent, k), "lists")
    lists = lists.join(lists.groupBy("value").agg(F.count("*").alias("c")).where("c > 1").select("value"), "value")
    lists = lists.withColumns({"far": F.lit(0).cast("long"), "most": F.lit(0).cast("long"), "nd": F.lit(1).cast("long")})
    lists = written(lists, "lists")
    # The documents in lists grow with the corpus: they are joined in a shuffle at every size, never broadcast.
    named = lists.select("doc").distinct().hint("merge")
    sets = bucketed(texts.join(named, "doc", "left_semi").mapInArrow(_sets(shingle), "doc long, shingles binary"), "sets", "doc")

    def verified(pairs: DataFrame) -> DataFrame:
        # The pairs are few beside the sets, and are written so that their number is known to the joins.
        # A document meets few others as doc, but as doc2 it may be the first member of a large list: its set is joined in a
        # shuffle, which adaptive execution splits, while the larger table of sets stays in its buckets.
        found = written(pairs.select(F.col("doc").alias("a"), F.col("doc2").alias("b")).distinct(), "pairs")
        firsts = found.select("b").distinct().join(sets.withColumnsRenamed({"doc": "b", "shingles": "y"}), "b")
        found = found.join(sets.withColumnsRenamed({"doc": "a", "shingles": "x"}), "a").join(firsts, "b")
        return written(found.select("a", "b", "x", "y").mapInArrow(_verified(percent, k), "a long, b long"), "links")

    def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))

    def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
        return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))

    close = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent
    hubs = lists.groupBy("value").agg(F.min(F.struct(F.xxhash64("doc").alias("order"), "doc", "n")).alias("h"))
    pairs = lists.join(hubs.select("value", F.col("h.doc").alias("doc2"), F.col("h.n").alias("n2")).hint("merge"), "value").where(close & (F.col("doc") != F.col("doc2")))
    roots = components(verified(pairs))
    level = 0
    while True:
        now = rooted(lists, roots)
        open_ = now.groupBy("value").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("value", "c")
        now = written(now.join(open_.hint("merge"), "value"), "open-lists")
        if now.isEmpty():
            return roots
        few = F.col("c") <= (SMALL_DIFFERENCES if level else SMALL)
        small = now.where(few)
        names = {c: c + "2" for c in ("doc", "n", "far", "nd", "root")}
        other = small.select("value", *names).withColumnsRenamed(names)
        may = close & (F.col("doc") < F.col("doc2")) & (F.col("root") != F.col("root2")) & (F.col("far") + F.col("far2") - F.col("most") <= (100 + percent) * F.least("nd", "nd2"))
        links = verified(small.join(other, "value").where(may).select("doc", "doc2"))
        large = now.where(~few)
        if large.isEmpty():
            return roots if links.isEmpty() else joined(roots, links)
        star, members = _groups(large.select("value", "doc", "n"), sets, percent, level)
        roots = joined(roots, links.unionByName(star))
        lists = written(_next_lists(rooted(members, roots), percent), "lists")
        level += 1


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, sketch: int = SKETCH) -> DataFrame:
    """Group documents whose sets of `shingle`-word shingles have a Jaccard similarity of `percent` hundredths or more.

    docs needs doc_id (integer) and text; other columns are ignored. Returns doc_id, n_shingles, component_id (the least
    doc_id that the document reaches over links) and kept (doc_id = component_id). A text of fewer words is one shingle;
    null, empty and blank texts have none and link with nothing, so they are kept. Rows with a null doc_id link with nothing:
    component_id is null and kept true. An empty table gives an empty result. Repeated rows get equal results; rows that share a doc_id count as one document in links.
    """
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = written(pairs.mapInArrow(_sketches(shingle, sketch), "doc_id long, n_shingles long, print binary, sketch array<long>"), "sketches")
    full = sketches.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = full.groupBy("print").agg(F.min("doc_id").alias("doc"))
    reps = full.groupBy("print").agg(F.min("doc_id").alias("doc"), F.any_value("n_shingles").alias("n"), F.any_value("sketch").alias("sketch")).select("doc", "n", "sketch")
    roots = link_classes(reps, pairs.select(F.col("doc_id").alias("doc"), "text"), shingle, percent, sketch)
    named = classes.join(roots, classes.doc == roots.node, "left").select("print", F.coalesce("root", "doc").alias("component"))
    out = sketches.select("doc_id", "n_shingles", "print").join(named, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
