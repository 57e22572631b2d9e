"""Near-duplicate documents: bottom-k sketches, inverted lists, exact Jaccard.

1. Every whole text becomes its set of distinct five-word shingles and a sketch,
   the ``K`` least values of that set under one hash function.
2. Documents with equal sets form a class; from here on there is one row a class.
3. Inverted lists hold the retained values.  A pair of similarity 0.75 must share
   ``needed`` values of its union's bottom k: three sevenths of both sizes where
   both sets are retained whole, else the mean of a hypergeometric draw less
   ``SIGMAS`` deviations.  With every sketch in the same order, rare values first,
   such a pair meets in the first ``prefix_length`` values of both, so only those
   are listed, and the places of a meeting bound the overlap from above.  Values
   that one class alone retains are never listed.
4. Hubs first: each list pairs its members with its most typical one, the class with
   the smallest share of values of its own.  That costs a row for each listed value,
   however large a group of copies is.  Verified links give components.
5. Members of lists that still span components are contested.  Their sketches are
   widened to their whole sets.  Values that exactly the same members hold become one
   class with a weight, so that a member is a short list of weighted classes.
6. Contested members meet in lists of their rarest classes, as many as a similar
   set may miss and one more.  A list in which pairs across components would cost
   more than going on is split by the next class that its members share, and so on:
   a list's key is then the first classes, in one order for all, that a pair has in
   common.  So documents of a template or with a passage meet in pairs, from some
   thousands in a list on, only where they have more rare classes in common.  The overlaps that classes add up to decide
   which pairs get their sets attached.
7. Pairs are filtered by the similarity that the union of their sketches
   estimates, then verified on the full sets.  The components of all links, found by
   passing and doubling labels, are the result.

The only chance taken is in step 3, for sets that don't fit in a sketch: some 10^-7 for
a pair exactly at the border of 0.75.  ``exact`` sends every set through step 5 instead.

Defined results: null or empty text, or text without a word, has no shingle and is
linked with nothing; fewer than five words are one shingle; a document without id
has a null component and is kept; rows that share an id but not a text are
documents of their own; ties go to the smaller id; an empty table gives an
empty result; other columns are ignored.  ``accept`` decides by row: of the rows
that share an id and a group one stays, rows without a shingle or an id all stay.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded, cut, fresh, release, slices
from .shingles import fingerprint, mix64, shingle_set

K = 128
#: Deviations below the mean overlap at which a sketched pair is given up.
SIGMAS = 5.0
NUMBER, WHOLE = 75, 100  # similarity of 75 / 100 at least
#: Tests of pairs within a list's join that cost as much as one more entry made, written and
#: shuffled, and classes that a list's key has at most.
SPLIT_COST, LEVELS = 256, 4
#: Rows up to which the ids of documents in pairs are broadcast to the texts; beyond, texts are shuffled.
BROADCAST_MEMBERS = 500_000


def needed(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Values that sketches of sets of ``a`` and ``b`` elements share at least if
    the sets have a similarity of 0.75."""
    union = (a + b) * WHOLE / (WHOLE + NUMBER)
    spread = np.sqrt(np.maximum(0, k * 0.1875 * (union - k) / np.maximum(union - 1, 1)))
    return np.where(np.maximum(a, b) <= k, np.ceil(NUMBER * (a + b) / (WHOLE + NUMBER) - 1e-9), np.floor(0.75 * k - SIGMAS * spread)).astype(np.int64)


def _overlap(a: Column, b: Column) -> Column:
    """Values that whole sets of ``a`` and ``b`` elements share at least."""
    return F.ceil(NUMBER * (a + b) / float(WHOLE + NUMBER) - 1e-9)


def _needed(a: Column, b: Column) -> Column:
    union = (a + b) * float(WHOLE) / float(WHOLE + NUMBER)
    spread = F.sqrt(F.greatest(F.lit(0.0), K * 0.1875 * (union - K) / F.greatest(union - 1, F.lit(1.0))))
    return F.when(F.greatest(a, b) <= K, _overlap(a, b)).otherwise(F.floor(0.75 * K - SIGMAS * spread))


def prefix_length(n: int, k: int = K) -> int:
    """How many of the first values of a set of ``n`` a similar set must meet."""
    if not n:
        return 0
    others = np.arange(-(-n * NUMBER // WHOLE), n * WHOLE // NUMBER + 1)
    return min(n, k) - int(needed(np.int64(n), others, k).min()) + 1


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, f1, f2 (fingerprint of the set), n, prefix, sketch (as signed 64 bits)."""

    def run(batches):
        lengths: dict[int, int] = {}
        for part in slices(batches, text="text"):
            rows = []
            for text in part.column("text").to_pylist():
                values = shingle_set(text)
                n = len(values)
                if n not in lengths:
                    lengths[n] = prefix_length(n)
                rows.append((*fingerprint(values), n, lengths[n], values[:K].view(np.int64)))
            f1, f2, n, prefix, sketch = zip(*rows)
            offsets = pa.array(np.cumsum([0, *map(len, sketch)]), pa.int32())
            held = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sketch)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(n, pa.int64()), pa.array(prefix, pa.int32()), held], ["doc_id", "f1", "f2", "n", "prefix", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, f1 long, f2 long, n long, prefix int, sketch array<long>")


def class_table(rows: DataFrame) -> DataFrame:
    """node, doc, f1, f2, n, prefix, sketch: one row for each distinct non-empty set.
    A node is named by its least document, or by a hash where that id has several texts."""
    several = bounded(cut(rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("f1").alias("low"), F.max("f1").alias("high")).where("low < high").select(F.col("doc_id").alias("of"))), BROADCAST_MEMBERS)
    classes = rows.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("doc"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
    named = F.when(F.col("of").isNull(), F.col("doc")).otherwise(F.xxhash64("doc", "f1", "f2")).alias("node")
    return classes.join(several, F.col("doc") == F.col("of"), "left").select(named, "doc", "f1", "f2", "n", "prefix", "sketch")


def listed(values: DataFrame, meta: DataFrame) -> DataFrame:
    """node, value -> value, node, n, kept (values retained), place, own (share of
    values that no other node retains): the values through which a node may meet another."""
    shared = cut(values.groupBy("value").agg(F.count("*").cast("int").alias("held")).where("held > 1").withColumnRenamed("value", "of"))
    release(values.sparkSession)  # the counts' shuffle goes before that of the join is written
    rows = values.join(shared, F.col("value") == F.col("of")).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "value"))).alias("values"))
    rows = rows.join(meta.select(F.col("node").alias("of"), "n", "prefix"), F.col("node") == F.col("of"))
    kept = F.least(F.col("n"), F.lit(K)).cast("int")
    own = kept - F.size("values")
    met = F.slice("values", 1, F.greatest(F.col("prefix") - own, F.lit(0)))
    return rows.select("node", "n", kept.alias("kept"), own.alias("alone"), F.posexplode(met).alias("at", "v")).select(
        F.col("v.value").alias("value"), "node", "n", "kept", (F.col("alone") + F.col("at")).alias("place"), (F.col("alone") / F.col("kept")).alias("own"))


def _alike(a: Column, b: Column) -> Column:
    """Whether sizes allow a similarity of 0.75."""
    return (NUMBER * a <= WHOLE * b) & (NUMBER * b <= WHOLE * a)


def _meets(a: str, b: str) -> Column:
    """Whether a meeting of two list entries at their places may be a similar pair."""
    c = lambda side, name: F.col(f"{side}.{name}")
    rest = F.least(c(a, "kept") - c(a, "place"), c(b, "kept") - c(b, "place"))
    return _alike(c(a, "n"), c(b, "n")) & (rest >= _needed(c(a, "n"), c(b, "n")))


def _pairs(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def hub_pairs(lists: DataFrame) -> DataFrame:
    """Each list's members with its hub: a, b."""
    entry = F.struct("own", "node", "n", "kept", "place")
    hubs = cut(lists.groupBy("value").agg(F.min(entry).alias("h"), F.count("*").alias("size")).where("size > 1").select(F.col("value").alias("of"), "h"))
    met = lists.join(hubs, F.col("value") == F.col("of")).select(F.struct("node", "n", "kept", "place").alias("m"), "h")
    return _pairs(met.where((F.col("m.node") != F.col("h.node")) & _meets("m", "h")), F.col("m.node"), F.col("h.node"))


def contested(lists: DataFrame, found: DataFrame) -> DataFrame:
    """node: the members of lists that span components."""
    labelled = lists.join(found.select(F.col("node").alias("of"), "component"), F.col("node") == F.col("of"), "left")
    labelled = cut(labelled.select("value", "node", F.coalesce("component", "node").alias("component")))
    spanning = cut(labelled.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select(F.col("value").alias("of")))
    return cut(labelled.join(spanning, F.col("value") == F.col("of"), "left_semi").select("node").distinct())


def profiles(sets: DataFrame, found: DataFrame) -> DataFrame:
    """node, component, n, slack, classes, weights: every set as classes of values that
    the same nodes hold, rare ones first.  ``slack`` is the weight that a similar set may
    lack of them; values that no other node holds have used up their part of it."""
    values = sets.select("node", F.size("full").alias("n"), F.explode("full").alias("value"))
    holders = [F.bit_xor(F.xxhash64("node", F.lit(k))) for k in (1, 2)]
    shared = cut(values.groupBy("value").agg(F.count("*").alias("held"), holders[0].alias("x"), holders[1].alias("y")).where("held > 1").select(F.col("value").alias("of"), "held", F.xxhash64("x", "y").alias("class")))
    release(sets.sparkSession)
    each = values.join(shared, F.col("value") == F.col("of")).select("node", "n", "held", "class").repartition("node")
    rows = each.groupBy("node", "n", "held", "class").agg(F.count("*").cast("int").alias("weight")).groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("held", "class", "weight"))).alias("at"))
    rows = rows.select("node", "n", F.col("at.class").alias("classes"), F.col("at.weight").alias("weights"), F.expr("aggregate(at.weight, 0, (s, w) -> s + w)").alias("total"))
    rows = rows.withColumn("slack", (F.floor(F.col("n") * (WHOLE - NUMBER) / float(WHOLE)) - (F.col("n") - F.col("total"))).cast("int")).where("slack >= 0")
    named = rows.join(found.select(F.col("node").alias("of"), "component"), F.col("node") == F.col("of"), "left")
    return cut(named.select("node", F.coalesce("component", "node").alias("component"), "n", "slack", "classes", "weights"))


#: key (the classes so far), last of them, weights skipped and in common, weight that
#: follows, ways to go on, and whether no further class is in common.
ENTRY = "key long, node long, component long, n int, last int, skipped int, common int, rest int, options int, done boolean"
_ENTRY = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
_U = np.uint64


def _grown(key: int, last: int, skipped: int, common: int, slack: int, classes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """The entries that follow one: the next class in common is any that leaves
    no more than ``slack`` behind, or none if the rest may be lacking too."""
    before = np.r_[0, np.cumsum(weights)]  # weight before each class
    stop = np.searchsorted(before[:-1], slack - skipped + before[last + 1], side="right")
    at = np.arange(last + 1, stop)
    left = skipped + before[at] - before[last + 1]
    next_stop = np.searchsorted(before[:-1], slack - left + before[at + 1], side="right")
    may_end = left + before[-1] - before[at + 1] <= slack
    keys = mix64((np.full(len(at), key, dtype=np.int64).view(np.uint64) ^ classes[at].view(np.uint64)) * _U(0x9FB21C651E98DF25) + _U(1))
    made = [keys, at, left, common + weights[at], before[-1] - before[at + 1], np.maximum(next_stop - at - 1, 0) + may_end, np.zeros(len(at), dtype=bool)]
    if last >= 0 and skipped + before[-1] - before[last + 1] <= slack:
        end = [mix64(np.array([key], dtype=np.int64).view(np.uint64) * _U(0xD6E8FEB86659FD93) + _U(2)), [len(classes)], [slack], [common], [0], [0], [True]]
        made = [np.r_[m, e] for m, e in zip(made, end)]
    return tuple(made)


def grown(entries: DataFrame) -> DataFrame:
    """Entries with their node's profile -> the entries one class longer."""

    def run(batches):
        for part in slices(batches, text="classes", chars=1 << 20):
            column = lambda c: part.column(c).to_pylist()
            rows = zip(*map(column, ("key", "node", "component", "n", "last", "skipped", "common", "slack")), part.column("classes"), part.column("weights"))
            made, same = [], []
            for key, node, component, n, last, skipped, common, slack, classes, weights in rows:
                own = _grown(key, last, skipped, common, slack, classes.values.to_numpy(), weights.values.to_numpy().astype(np.int64))
                made.append(own)
                same.append((node, component, n, len(own[0])))
            if made:
                keys, *rest = (np.concatenate(c) for c in zip(*made))
                times = [s[3] for s in same]
                who = [np.repeat(np.array([s[k] for s in same], dtype=np.int64), times) for k in range(3)]
                arrays = [keys.astype(np.uint64).view(np.int64), *who, *rest]
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(t.to_pandas_dtype()), t) for a, t in zip(arrays, _ENTRY)], [c.split()[0] for c in ENTRY.split(", ")])

    return entries.mapInArrow(run, ENTRY)


def met(profile: DataFrame) -> DataFrame:
    """Pairs of nodes of different components that may be similar: a, b.  A list
    goes on to the next class where testing its pairs costs more than the entries that this makes, to
    keys of ``LEVELS`` classes; what is left then is paired as it is, so that no pair is lost."""
    start = [F.lit(0).cast("long").alias("key"), *[F.lit(v).alias(c) for c, v in (("last", -1), ("skipped", 0), ("common", 0))]]
    entries, made = cut(grown(profile.select("*", *start))), []
    for level in range(LEVELS):
        splits = ((F.col("m") - F.col("most.m")) * F.col("m") > SPLIT_COST * F.col("o")) & F.lit(level < LEVELS - 1)
        sizes = entries.groupBy("key", "done", "component").agg(F.count("*").alias("m"), F.sum("options").alias("o"), F.min(F.struct("n", "node", "component")).alias("first"))
        lists = cut(
            sizes.groupBy("key", "done").agg(F.sum("m").alias("m"), F.sum("o").alias("o"), F.max(F.struct("m", "component")).alias("most"), F.count("*").alias("groups"), F.min("first").alias("first"))
            .where("groups > 1").select(F.col("key").alias("of"), F.col("done").alias("ended"), F.col("most.component").alias("most"), "first", splits.alias("go_on"))
        )
        held = entries.join(lists, (F.col("key") == F.col("of")) & (F.col("done") == F.col("ended")))
        ended = held.where("done and component != first.component").select(F.col("node").alias("x"), F.col("first.node").alias("y"), F.col("n").alias("p"), F.col("first.n").alias("q"), F.col("common").alias("most"))
        short = held.where("not done and not go_on").select("key", "node", "component", "n", "common", "rest", "most")
        a, b = short.where("component != most").alias("a"), short.alias("b")
        on = (F.col("a.key") == F.col("b.key")) & (F.col("a.component") != F.col("b.component")) & ((F.col("b.component") == F.col("b.most")) | (F.col("a.node") < F.col("b.node")))
        across = a.join(b, on).select(F.col("a.node").alias("x"), F.col("b.node").alias("y"), F.col("a.n").alias("p"), F.col("b.n").alias("q"), (F.col("a.common") + F.least("a.rest", "b.rest")).alias("most"))
        both = ended.union(across).where(_alike(F.col("p"), F.col("q")) & (F.col("most") >= _overlap(F.col("p"), F.col("q"))))
        made.append(cut(_pairs(both, F.col("x"), F.col("y"))))
        longer = cut(held.where("not done and go_on").select("key", "node", "last", "skipped", "common"))
        if not longer.take(1):
            break
        entries = cut(grown(longer.join(profile, "node").select("key", "node", "component", "n", "slack", "classes", "weights", "last", "skipped", "common")))
    return cut(reduce(DataFrame.union, made).distinct())


def overlapping(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """The pairs whose classes in common add up to an overlap of similar sets: a, b."""

    def run(batches):
        for part in slices(batches, text="c", chars=1 << 20):
            good = []
            for p, q, c, w, d in zip(part.column("p").to_pylist(), part.column("q").to_pylist(), *map(part.column, ("c", "w", "d"))):
                common = np.isin(c.values.to_numpy(), d.values.to_numpy())
                good.append((WHOLE + NUMBER) * int(w.values.to_numpy()[common].sum()) >= NUMBER * (p + q))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = profile.select(F.col("node").alias("a"), F.col("n").alias("p"), F.col("classes").alias("c"), F.col("weights").alias("w"))
    right = profile.select(F.col("node").alias("b"), F.col("n").alias("q"), F.col("classes").alias("d"))
    return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "p", "q", "c", "w", "d").mapInArrow(run, "a long, b long"))


def full_sets(nodes: DataFrame, meta: DataFrame, docs: DataFrame) -> DataFrame:
    """node, full: the whole shingle sets of ``nodes``, from their texts."""

    def run(batches):
        for part in slices(batches, text="text"):
            sets = [shingle_set(t) for t in part.column("text").to_pylist()]
            first = pa.array([fingerprint(s)[0] for s in sets], pa.int64())
            held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            made = pa.RecordBatch.from_arrays([part.column("node"), part.column("f1"), held, first], ["node", "f1", "full", "own"])
            made = made.filter(pc.equal(made.column("f1"), made.column("own")))  # another text under the same id
            yield pa.RecordBatch.from_arrays([made.column("node"), made.column("full")], ["node", "full"])

    members = bounded(cut(nodes.distinct().join(meta.select(F.col("node").alias("of"), "doc", "f1"), F.col("node") == F.col("of")).select("node", "doc", "f1")), BROADCAST_MEMBERS)
    read = docs.join(members, F.col("doc_id") == F.col("doc")).select("node", "f1", "text").mapInArrow(run, "node long, full array<long>")
    return cut(read.dropDuplicates(["node"]))


def similar(s: np.ndarray, t: np.ndarray) -> bool:
    """Two sorted sets: the estimate of their union sketch first, then the exact similarity."""
    least, most = sorted((len(s), len(t)))
    if WHOLE * least < NUMBER * most:
        return False
    if most > K:
        a, b = s[:K], t[:K]
        bound = np.union1d(a, b)[K - 1]
        a, b = a[a <= bound], b[b <= bound]
        if len(np.intersect1d(a, b, assume_unique=True)) < needed(np.int64(len(s)), np.int64(len(t))):
            return False
    common = len(np.intersect1d(s, t, assume_unique=True))
    return WHOLE * common >= NUMBER * (len(s) + len(t) - common)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose union sketch and full sets have a similarity of 0.75 or more: a, b."""

    def run(batches):
        for part in slices(batches, text="s"):
            good = [similar(s.values.to_numpy().view(np.uint64), t.values.to_numpy().view(np.uint64)) for s, t in zip(part.column("s"), part.column("t"))]
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = sets.select(F.col("node").alias("a"), F.col("full").alias("s")), sets.select(F.col("node").alias("b"), F.col("full").alias("t"))
    return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(run, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node in ``links`` (a, b).

    Each round a node takes the least label around it, offers it to the node that
    was its label, and takes the label of its label, until nothing changes; labels
    fall by whole paths, so that rounds grow with the logarithm of a chain's length.
    """
    edges = cut(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a != b").distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")))
    while True:
        around = edges.join(labels.select(F.col("node").alias("of"), F.col("component").alias("near")), F.col("b") == F.col("of")).groupBy("a").agg(F.min("near").alias("near"))
        offers = cut(labels.join(around, F.col("node") == F.col("a")).select("node", "component", F.least("component", "near").alias("low")))
        offered = cut(offers.select("node", "low").union(offers.select(F.col("component"), "low")).groupBy("node").agg(F.min("low").alias("low")))
        jump = offered.select(F.col("node").alias("via"), F.col("low").alias("far"))
        after = cut(offered.join(jump, F.col("low") == F.col("via"), "left").select("node", F.least("low", F.coalesce("far", "low")).alias("component")))
        changed = after.join(labels.select(F.col("node").alias("of"), F.col("component").alias("was")), F.col("node") == F.col("of")).where("component != was").limit(1).count()
        labels = after
        if not changed:
            return labels


def links(docs: DataFrame, classes: DataFrame, meta: DataFrame, exact: bool = False) -> DataFrame:
    """All links that components need, between nodes: a, b."""
    lists = cut(listed(classes.select("node", F.explode("sketch").alias("value")), meta))
    release(docs.sparkSession)
    pairs = cut(hub_pairs(lists))
    first = verified(pairs, full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), meta, docs))
    found = components(first)
    rest = meta.select("node") if exact else contested(lists, found)
    if not rest.take(1):
        return first
    sets = full_sets(rest, meta, docs)
    profile = profiles(sets, found)
    pairs = overlapping(met(profile), profile)
    return cut(first.union(verified(pairs, sets)))


def marked(docs: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, f1, f2, n_shingles, component_id, kept of every row."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    rows = cut(sketched(docs))
    classes = cut(class_table(rows))
    narrow = cut(rows.select("doc_id", "f1", "f2", "n"))
    meta = cut(classes.drop("sketch"))
    del rows
    release(docs.sparkSession)
    found = components(links(docs, classes, meta, exact))
    del classes
    labelled = cut(meta.join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).select("f1", "f2", "n", "doc", "component"))
    least = cut(labelled.groupBy(F.col("component").alias("of")).agg(F.min("doc").alias("least")))
    linked = labelled.join(least, F.col("component") == F.col("of")).select("f1", "f2", "n", F.col("least").alias("least"))
    alone = meta.join(found.select(F.col("node").alias("of")), F.col("node") == F.col("of"), "left_anti").select("f1", "f2", "n", F.col("doc").alias("least"))
    named = cut(linked.union(alone).select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("m"), "least"))
    same = (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("m"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return narrow.join(named, same, "left").select("doc_id", "f1", "f2", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return marked(docs, exact).drop("f1", "f2")


def accept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group; all columns kept."""
    marks = cut(marked(docs))
    named = marks.where("doc_id is not null")
    gone = fresh(docs, "gone")
    lost = cut(named.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias(gone)))
    stay = docs.join(bounded(lost, BROADCAST_MEMBERS), docs["doc_id"].cast("long") == F.col(gone), "left_anti")
    again = cut(named.where("n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("kept"), F.struct("f1", "f2"))).alias("first")).where("n > 1 and first is not null")
                .select(F.col("doc_id").alias(gone), "first.f1", "first.f2"))
    if not again.take(1):
        return stay
    return _one_row(stay, again, gone)


def _one_row(rows: DataFrame, again: DataFrame, name: str) -> DataFrame:
    """``rows``, of those with an id of ``again`` only one with the set named there, and those without a shingle."""
    names, at = rows.columns, rows.columns.index("text")
    marks = [fresh(rows, m) for m in ("set_one", "set_two", "set_size")]

    def run(batches):
        for part in slices(batches, text="text"):
            sets = [shingle_set(t) for t in part.column(at).to_pylist()]
            prints = [fingerprint(s) for s in sets]
            made = [pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*part.columns, *made, pa.array(list(map(len, sets)), pa.int64())], [*names, *marks])

    ids = bounded(again, BROADCAST_MEMBERS)
    of = rows["doc_id"].cast("long") == ids[name]
    told = rows.join(ids.select(name), of, "left_semi").mapInArrow(run, StructType([*rows.schema.fields, *[StructField(m, LongType()) for m in marks]]))
    one = told.join(ids, (told["doc_id"].cast("long") == ids[name]) & (told[marks[0]] == ids["f1"]) & (told[marks[1]] == ids["f2"]), "left_semi").where(F.col(marks[2]) > 0)
    return rows.join(ids.select(name), of, "left_anti").unionByName(one.dropDuplicates(["doc_id"]).select(*names)).unionByName(told.where(F.col(marks[2]) == 0).select(*names))
