"""MinHash near-duplicates with tensored banding.

Two collections of GROUPS small hash groups of GROUP_SIZE minima are computed for each distinct shingle set. A table key is
a pair (i-th group of the one, j-th of the other): GROUPS^2 tables of 2*GROUP_SIZE rows each cost only 2*GROUPS*GROUP_SIZE
minima, about the square root of what as many independent tables need. Two sets of similarity 0.8 share no table with
probability below 2*(1-0.8^GROUP_SIZE)^GROUPS = 1e-5, and of 0.9 with 5e-9. Every link is confirmed on the full sets.

No group is expanded into its pairs. Equal sets are one representative. In each table, members are first compared with one
leader, the set that shares most groups with others; members left outside the table's largest component are compared with
further pivots of it while that pays; what is still outside then is compared in blocks, the few outside with all that share
their tables. So every pair of a shared table is compared unless it is connected already.

Defined results: words are split at ASCII white space after folding A-Z; a text of fewer than `words` words has its whole
sequence as its one shingle; null texts and texts without words have no shingle and are linked with nothing; repeated rows
are linked like any copies. Texts that share a doc_id are members of their own, each with its component; the name of a component is
its least doc_id. A null doc_id cannot be named as a component: such rows have a null component and are kept. Very long texts are
compared whole, by their sets. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.llm import blocks as B
from docquery.llm.common import components, discard, id_and_text, settle, small, text_key, without

GROUPS, GROUP_SIZE = 12, 2
PIVOT_ROUNDS = 3
#: Up to so many pairs of members outside and inside are compared in blocks without further pivots.
PAIRS_AT_ONCE = 1_000_000
#: Sets on each side of a block.
BLOCK = 256
_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(1 << 63, size=2 * GROUPS * GROUP_SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _rng.integers(1 << 63, size=2 * GROUPS * GROUP_SIZE, dtype=np.uint64)

SIGNATURE = "doc_id long, text_key long, n long, d1 long, d2 long, a array<long>, b array<long>"


def signatures(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Set size, 128-bit digest of the set, and both collections; two 32-bit minima make up one long."""
    for batch in batches:
        ids = batch.column(0)
        for start, end, data, offsets in B.blocks(batch.column(1)):
            sets = B.shingle_sets(data, offsets, words)
            sizes = np.array([len(s) for s in sets], np.int64)
            d1, d2, groups = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64), np.zeros((2 * GROUPS, len(sets)), np.uint64)
            some = np.flatnonzero(sizes)
            if len(some):
                flat, at = np.concatenate([sets[i] for i in some]), np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                d1[some], d2[some] = np.add.reduceat(B.mix(flat), at), np.add.reduceat(B.mix(flat ^ B._M3), at)
                for t in range(2 * GROUPS):
                    for u in range(GROUP_SIZE):
                        k = t * GROUP_SIZE + u
                        least = np.minimum.reduceat((((flat ^ _MASKS[k]) * _MULTIPLIERS[k]) >> np.uint64(32)).astype(np.uint32), at)
                        groups[t, some] = (groups[t, some] << np.uint64(32)) | least
            nested = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * GROUPS), B.signed(np.ascontiguousarray(groups[c * GROUPS : (c + 1) * GROUPS].T).ravel())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([ids.slice(start, end - start), batch.column(2).slice(start, end - start), pa.array(sizes), B.signed(d1), B.signed(d2), *nested], names=["doc_id", "text_key", "n", "d1", "d2", "a", "b"])


def verified(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, linked) from rows (a, b, text_a, text_b); the set of a's text is kept while the text stays the same."""
    last, held = None, None
    for batch in batches:
        linked = np.zeros(batch.num_rows, bool)
        left, right = batch.column("text_a"), batch.column("text_b")
        ids = batch.column("a").to_pylist()
        for start, end, data, offsets in B.blocks(right):
            for r, s in zip(range(start, end), B.shingle_sets(data, offsets, words), strict=True):
                if held is None or ids[r] != last:
                    last = ids[r]
                    raw = np.frombuffer((left[r].as_py() or "").encode(), np.uint8)
                    held = B.shingle_sets(raw, np.array([0, len(raw)]), words)[0]
                both = len(s) + len(held) - len(np.union1d(s, held)) if len(s) and len(held) else 0
                linked[r] = both > 0 and 100 * both >= percent * (len(s) + len(held) - both)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], names=["a", "b", "linked"])


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; links need 100*intersection >= percent*union."""
    return _decided(docs, words, percent).drop("text_key")


def _decided(docs: DataFrame, words: int, percent: int) -> DataFrame:
    docs = id_and_text(docs, text_key().alias("text_key"))
    rows = settle(docs.mapInArrow(lambda it: signatures(it, words), SIGNATURE), "signatures")
    reps = settle(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "text_key")).alias("m"), F.first("a").alias("a"), F.first("b").alias("b")).select("d1", "d2", "n", "m.doc_id", "m.text_key", "a", "b"), "sets")
    # A set is known by its least doc_id, or by a negative number of its own where that doc_id has several sets.
    several = settle(reps.groupBy(F.col("doc_id").alias("again")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("again"), "several")
    reps = reps.join(small(several, several.count()), F.col("doc_id") == F.col("again"), "left")
    reps = reps.withColumn("rep", F.when(F.col("again").isNull() & (F.col("doc_id") >= 0), F.col("doc_id")).otherwise(-1 - F.shiftrightunsigned(F.xxhash64("d1", "d2", "n"), 1))).drop("again")

    # Only groups that two sets share can be part of a shared table; the others need no table rows.
    group = reps.select("rep", "n", F.posexplode(F.concat("a", "b")).alias("i", "value"))
    shared = group.groupBy("i", "value").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    hits = group.join(shared, ["i", "value"]).groupBy("rep", "n").agg(F.sum("c").alias("pop"), F.collect_list(F.struct("i", "value")).alias("g"))
    tables = hits.select("rep", "n", "pop", F.explode(F.filter("g", lambda x: x.i < GROUPS)).alias("x"), "g").select("rep", "n", "pop", "x", F.explode(F.filter("g", lambda y: y.i >= GROUPS)).alias("y"))
    tables = settle(tables.select(F.xxhash64("x.i", "x.value", "y.i", "y.value").alias("key"), "rep", "n", "pop"), "tables")
    alike = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent

    # Every member of a table against its leader, the one that shares most groups with others: the middle of its cluster.
    leaders = tables.groupBy("key").agg(F.max(F.struct("pop", -F.col("rep"), "n")).alias("x"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", (-F.col("x.col2")).alias("lead"), F.col("x.n").alias("m"))
    members = settle(tables.join(leaders, "key"), "members")
    discard(tables)
    asked = settle(members.where((F.col("rep") != F.col("lead")) & alike).select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    texts = candidates(docs, members.select("rep").distinct().join(reps.select("rep", F.col("doc_id").alias("least"), F.col("text_key").alias("key")), "rep"))
    members = members.select("key", "rep", "n", "pop")
    links = [compare(asked, texts, words, percent)]

    def joined() -> DataFrame:
        every = links[0]
        for more in links[1:]:
            every = every.union(more)
        return components(every)

    def apart(found: DataFrame) -> DataFrame:
        """Members of tables with more than one component; main: the table's largest component, pivot: a member of it."""
        at = members.join(found, members.rep == found.node, "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
        main = at.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64("rep", F.lit(len(links))).alias("h"), "rep", "n")).alias("p")).groupBy("key").agg(F.max(F.struct("c", "comp", "p")).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1")
        return settle(at.join(main.select("key", F.col("m.comp").alias("main"), F.col("m.p.rep").alias("pivot"), F.col("m.p.n").alias("m")), "key"), "apart")

    found, before = joined(), None
    while True:
        open_ = apart(found)
        outside = open_.groupBy("main").agg(F.count_distinct(F.when(F.col("comp") != F.col("main"), F.col("rep"))).alias("few"), F.count_distinct("rep").alias("all"))
        outside = settle(outside, "outside")
        cost = outside.agg(F.sum(F.col("few").cast("double") * F.col("all"))).first()[0] or 0
        if len(links) > PIVOT_ROUNDS or cost <= PAIRS_AT_ONCE or before is not None and cost > 0.7 * before:
            break
        before = cost
        pairs = open_.where((F.col("comp") != F.col("main")) & alike).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
        links.append(compare(settle(pairs, "pairs"), texts, words, percent))
        discard(open_, outside, found)
        found = joined()
    links.append(block_links(open_, outside, texts, words, percent))
    found = joined()

    at = reps.join(found, reps.rep == found.node, "left").select("d1", "d2", "n", "doc_id", "component")
    least = at.where("component IS NOT NULL").groupBy(F.col("component").alias("of")).agg(F.min("doc_id").alias("least"))
    at = at.join(least, F.col("component") == F.col("of"), "left")
    named = settle(at.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("n").alias("m"), F.coalesce("least", "doc_id").alias("comp")), "named")
    out = rows.join(named, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n") == F.col("m")), "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def block_links(open_: DataFrame, outside: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): the members outside a largest component against all that share its tables, by blocks of BLOCK sets each.

    A block of the ones meets a block of the others in one group, so a text is sent once for each block that it meets, not
    once for each pair, and one link of a member with each other component is enough.
    """
    blocks = outside.where("few > 0").select(F.col("main").alias("main_"), F.ceil(F.col("few") / BLOCK).alias("xs"), F.ceil(F.col("all") / BLOCK).alias("ys"))
    rows = open_.select("main", "rep", "comp").distinct().join(blocks, F.col("main") == F.col("main_"))
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    x = rows.where("comp <> main").select("main", place("xs").alias("bx"), F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("by"), "rep", "comp", F.lit(True).alias("few"))
    y = rows.select("main", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("bx"), place("ys").alias("by"), "rep", "comp", F.lit(False).alias("few"))
    met = settle(x.unionByName(y), "blocks").join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")
    found = met.groupBy("main", "bx", "by").applyInArrow(lambda t: compared_block(t, words, percent), "a long, b long")
    return settle(found.distinct(), "compared")


def compared_block(t: pa.Table, words: int, percent: int) -> pa.Table:
    """Links between the rows marked `few` and the others, by the postings of the former's shingles."""
    t = t.combine_chunks()
    few, rep, comp = (t.column(c).to_numpy() for c in ("few", "rep", "comp"))
    sets: list[np.ndarray] = []
    for _, _, data, offsets in B.blocks(t.column("text")):
        sets += B.shingle_sets(data, offsets, words)
    x = np.flatnonzero(few)
    out_a, out_b = [], []
    if len(x) and not few.all():
        sizes = np.array([len(sets[i]) for i in x])
        known, inverse = np.unique(np.concatenate([sets[i] for i in x]), return_inverse=True)
        owner = np.repeat(np.arange(len(x)), sizes)[np.argsort(inverse, kind="stable")]
        at = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(known)))])
        for j in np.flatnonzero(~few):
            k = np.searchsorted(known, sets[j])
            k[k == len(known)] = 0
            k = k[known[k] == sets[j]]
            n = at[k + 1] - at[k]
            both = np.bincount(owner[np.repeat(at[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())], minlength=len(x)) if len(k) else np.zeros(len(x), int)
            linked = (both > 0) & (100 * both >= percent * (sizes + len(sets[j]) - both)) & (comp[x] != comp[j])
            out_a.append(rep[x[linked]])
            out_b.append(np.full(linked.sum(), rep[j]))
    a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (out_a, out_b))
    # One link of a member with each component.
    names = {r: c for r, c in zip(rep.tolist(), comp.tolist(), strict=True)}
    once = {(p, names[q]): q for p, q in zip(a.tolist(), b.tolist(), strict=True)}
    return pa.table({"a": pa.array([p for p, _ in once], pa.int64()), "b": pa.array(list(once.values()), pa.int64())})


def candidates(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(doc_id, text): one text for each set that shares a table, under the set's name; only these are shuffled again."""
    ids = settle(reps, "candidates")
    at = docs.join(small(ids, ids.count()), (F.col("doc_id") == F.col("least")) & (F.col("text_key") == F.col("key")))
    return settle(at.select(F.col("rep").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "texts")


def compare(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) of the pairs that are linked. The join on a, whose leaders may be hot, comes last and can be split."""
    right = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return settle(both.mapInArrow(lambda it: verified(it, words, percent), "a long, b long, linked boolean").where("linked").select("a", "b"), "compared")


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near-duplicates, the smallest doc_id; all columns stay as they are."""
    return without(docs, _decided(docs, words, percent).where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_text")))
