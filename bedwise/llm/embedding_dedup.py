"""Near-duplicate vectors by NN-descent.

Vectors meet only vectors of their label. A first neighbour graph comes from random hyperplanes: in several tables
vectors are ordered by label and signature and linked with the next few. Rounds of local joins then compare the neighbours
of every vector with each other: a list keeps its best, and a pair above the threshold that joins two groups is kept
in any case. A list is saturated when all its neighbours lie above the threshold; such a vector may have more links than
its list can hold, so in the end its list is enlarged to the whole group that its links reach: within a group vectors are
compared in blocks, and links are counted, not written out.

Exact copies are one vector in the search, which stands for all of them, so copies do not fill lists; links are counted with
their numbers.

Two linked vectors always lie in one group, so the counts are whole once the graph connects what is linked. An audit
compares a sample of all vectors, another in each round and larger on a larger table (``audit_size``), with all vectors: it
measures the share of their links that lie within groups. Links that it finds across groups are used. Rounds, each with
other hyperplanes, go on until one joins no groups and its audit finds no link across groups; every other round joins
groups, so they end. The search is not exhaustive: where the table is larger than its audit, links between groups of which
no member was sampled may be missing. The measured shares are logged, and ``connect`` returns them.

Defined results. Vectors that are null, empty, zero, or hold null or non-finite components, and vectors without label, link
with nothing; vectors of different lengths do not link. Rows with one vec_id are one vector (the smallest by label and
components). A null vec_id links with nothing: component_id null, kept true. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedwise.llm.common import components, cut

TABLES, BITS, NEXT = 16, 20, 4
NEIGHBOURS = 8
#: Least vectors of an audit, and cells of one of its products.
AUDIT, CELLS = 1000, 1 << 22
BLOCK = 512

log = logging.getLogger(__name__)


def unit_rows(column: pa.Array) -> np.ndarray:
    """Lists of equal length as unit vectors in double precision."""
    out = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def usable(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All ids, and one row for each vector that may link: (id, label, dim, v)."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("v"))
    one = rows.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    nothing = rows.where("vec_id IS NULL").select("vec_id")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)
    return one.select("vec_id").unionAll(nothing), one.where(good).select(F.col("vec_id").alias("id"), "label", F.size("v").alias("dim"), "v")


def first_pairs(vectors: DataFrame, threshold: float, seed: int) -> DataFrame:
    """(a, b, sim) of vectors that stand near each other in the order of their signatures."""
    spec = vectors.schema["v"].dataType.simpleString()

    def sign(batches):
        for batch in batches:
            dims, v = batch.column(2).to_numpy(), batch.column(3)
            for dim in np.unique(dims).tolist():
                at = pa.array(np.flatnonzero(dims == dim))
                some, x = batch.take(at), unit_rows(v.take(at))
                planes = np.random.default_rng([seed, dim]).standard_normal((dim, TABLES * BITS))
                bits = (x @ planes > 0).reshape(len(x), TABLES, BITS)
                signature = bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays([
                        some.column(0), some.column(1), some.column(2), pa.array([t] * len(x), pa.int32()), pa.array(signature[:, t]), some.column(3),
                    ], ["id", "label", "dim", "t", "s", "v"])

    def link(batches):
        last = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if last is None else [last, batch])
            table = table.combine_chunks()
            old = 0 if last is None else last.num_rows
            n = table.num_rows
            ids, dim, t = (table.column(c).to_numpy() for c in ("id", "dim", "t"))
            label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            v = table.column("v").combine_chunks()
            v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
            for step in range(1, NEXT + 1):
                i = np.arange(max(0, old - step), n - step)
                j = i + step
                i, j = (x[(j >= old)] for x in (i, j))
                same = (dim[i] == dim[j]) & (t[i] == t[j]) & (label[i] == label[j]) & (ids[i] != ids[j])
                i, j = i[same], j[same]
                for d in np.unique(dim[i]).tolist():
                    p, q = i[dim[i] == d], j[dim[i] == d]
                    sim = (unit_rows(v.take(pa.array(p))) * unit_rows(v.take(pa.array(q)))).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[p], ids[q])), pa.array(np.maximum(ids[p], ids[q])), pa.array(sim)], ["a", "b", "sim"])
            last = table.slice(max(0, n - NEXT)).to_batches()[0] if n else last

    signed = vectors.select("id", "label", "dim", "v").mapInArrow(sign, f"id long, label string, dim int, t int, s long, v {spec}")
    order = ["label", "dim", "t", "s", F.xxhash64("id", F.lit(seed))]
    return signed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(link, "a long, b long, sim double").distinct()


def best_lists(pairs: DataFrame) -> DataFrame:
    """(w, list of (sim, b), best first): at most NEIGHBOURS of each vector."""
    both = pairs.select(F.col("a").alias("w"), "b", "sim").unionAll(pairs.select(F.col("b").alias("w"), F.col("a").alias("b"), "sim"))
    # A running top list would need a buffer of fixed size; a group here holds a list and what one round found.
    return both.groupBy("w").agg(F.slice(F.sort_array(F.collect_set(F.struct("sim", "b")), asc=False), 1, NEIGHBOURS).alias("list"))


def local_joins(lists: DataFrame, state: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim, across): pairs of neighbours of one vector that improve a list or join two groups (``across``).

    ``state``: id, v, comp, worst (similarity that a new neighbour has to exceed).
    """

    def run(batches):
        for batch in batches:
            members = batch.column(0)
            flat, offsets = members.flatten(), members.offsets.to_numpy() - members.offsets[0].as_py()
            ids, comp, worst = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "comp", "worst"))
            v, out = flat.field("v"), []
            x = unit_rows(v)
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                sim = x[lo:hi] @ x[lo:hi].T
                c, w, d = comp[lo:hi], worst[lo:hi], ids[lo:hi]
                across = (sim >= threshold) & (c[:, None] != c[None, :])
                take = across | (sim > np.minimum(w[:, None], w[None, :]))
                i, j = np.nonzero(take & (d[:, None] < d[None, :]))
                out.append((d[i], d[j], sim[i, j], across[i, j]))
            a, b, s, c = (np.concatenate([o[k] for o in out]) for k in range(4)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s), pa.array(c)], ["a", "b", "sim", "across"])

    # Forward and reverse neighbours, the best of each: a list never grows with the data.
    edges = lists.select("w", F.explode("list").alias("e")).select("w", F.col("e.b").alias("id"), F.col("e.sim").alias("sim"))
    reverse = best_lists(edges.select(F.col("w").alias("a"), F.col("id").alias("b"), "sim"))
    reached = reverse.select("w", F.explode("list").alias("e")).select("w", F.col("e.b").alias("id"))
    around = edges.select("w", "id").unionAll(reached).unionAll(lists.select("w", F.col("w").alias("id"))).distinct()
    groups = around.join(state, "id").groupBy("w").agg(F.collect_list(F.struct("id", "comp", "worst", "v")).alias("members"))
    return groups.where(F.size("members") > 1).select("members").mapInArrow(run, "a long, b long, sim double, across boolean").distinct()


def audit_size(n: int) -> int:
    """Vectors that an audit of ``n`` vectors samples: all up to AUDIT, then at least the square root."""
    return max(AUDIT, int(np.ceil(n ** 0.5)))


def audit(state: DataFrame, threshold: float, size: int, turn: int = 0) -> tuple[float, DataFrame]:
    """Share of a sample's links that lie within groups, and the links (a, b, sim) that do not."""
    spark = state.sparkSession
    sample = state.orderBy(F.xxhash64("id", F.lit(f"audit {turn}")), "id").limit(size).select("id", "label", "dim", "comp", "v").toArrow()
    ids, comp, dims = (sample.column(n).to_numpy() for n in ("id", "comp", "dim"))
    labels, v = np.array(sample.column("label").to_pylist(), object), sample.column("v").combine_chunks()
    asked = {}
    for d, label in set(zip(dims.tolist(), labels.tolist())):
        at = np.flatnonzero((dims == d) & (labels == label))
        asked[d, label] = ids[at], comp[at], unit_rows(v.take(pa.array(at)))
    shared = spark.sparkContext.broadcast(asked)  # audit_size vectors

    def run(batches):
        for batch in batches:
            labels, (dims, ids, comp) = np.array(batch.column(1).to_pylist(), object), (batch.column(c).to_numpy() for c in (2, 0, 3))
            for key in set(zip(dims.tolist(), labels.tolist())) & shared.value.keys():
                of, group, x = shared.value[key]
                every = np.flatnonzero((dims == key[0]) & (labels == key[1]))
                step = max(1, CELLS // len(of))
                for lo in range(0, len(every), step):
                    at = every[lo:lo + step]
                    sim = x @ unit_rows(batch.column(4).take(pa.array(at))).T
                    link = (sim >= threshold) & (of[:, None] != ids[at][None, :])
                    i, j = np.nonzero(link & (group[:, None] != comp[at][None, :]))
                    p, q = of[i], ids[at][j]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.append(np.minimum(p, q), -1)), pa.array(np.append(np.maximum(p, q), -1)), pa.array(np.append(sim[i, j], 0.0)),
                        pa.array(np.append(np.zeros(len(i), np.int64), link.sum())), pa.array(np.append(np.ones(len(i), bool), False)),
                    ], ["a", "b", "sim", "links", "missed"])

    found = cut(state.select("id", "label", "dim", "comp", "v").mapInArrow(run, "a long, b long, sim double, links long, missed boolean"), "audit")
    total, missed = found.agg(F.sum("links"), F.count(F.when(F.col("missed"), 1))).first()
    return (1.0 if not total else 1 - missed / total), found.where("missed").select("a", "b", "sim").distinct()


def link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """(id, n_links) within groups ``(comp, id, m, v)``, compared block by block; a vector counts ``m`` times."""
    blocks = members.groupBy("comp").agg(F.count("*").alias("size")).where("size > 1").select("comp", F.ceil(F.col("size") / BLOCK).cast("int").alias("nb"))
    rows = members.join(blocks, "comp").withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "m", "v")

    def run(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        own, ids, m = (table.column(c).to_numpy() for c in ("own", "id", "m"))
        x = unit_rows(table.column("v").combine_chunks())
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        link = x[left] @ x[right].T >= threshold
        link &= ids[left][:, None] != ids[right][None, :]
        if i == j:
            return pa.table({"id": ids[left], "n": link @ m[right]})
        return pa.table({"id": np.concatenate([ids[left], ids[right]]), "n": np.concatenate([link @ m[right], m[left] @ link])})

    return rows.groupBy("comp", "i", "j").applyInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n_links"))


def one_of_copies(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, copy_of) of all vectors, and (id, label, dim, m, v) of the smallest id of each group of ``m`` equal vectors."""
    keyed = vectors.withColumn("h", F.xxhash64(F.lit(1), "v")).withColumn("g", F.xxhash64(F.lit(2), "v"))
    key = ["label", "dim", "h", "g"]
    first = keyed.groupBy(*key).agg(F.min("id").alias("copy_of"), F.count("*").alias("m"))
    marked = cut(keyed.select("id", *key).join(first, key).select("id", "copy_of", "m"), "copies")
    own = marked.where("id = copy_of").select("id", "m")
    return marked.select("id", "copy_of"), cut(vectors.join(own, "id").select("id", "label", "dim", "m", "v"), "vectors")


def connect(vectors: DataFrame, threshold: float) -> tuple[DataFrame, list[float]]:
    """(id, comp) of the linked among ``vectors`` (id, label, dim, v), and the share of links that each round's audit saw within groups."""
    size = audit_size(vectors.count())
    pairs = cut(first_pairs(vectors, threshold, 0), "pairs")
    groups = components(pairs.where(F.col("sim") >= threshold).select("a", "b"))
    shares, turn = [], 0

    def grouped(frame):
        return frame.join(groups, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    def joined(links):
        return components(groups.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionAll(links.select("a", "b")))

    while True:
        turn += 1
        lists = cut(best_lists(pairs), "lists")
        # Saturated lists get no better by other neighbours; only unsaturated ones are refined.
        worst = F.element_at("list", -1)["sim"]
        full = F.size("list") == NEIGHBOURS
        marks = lists.select(F.col("w").alias("id"), F.when(full & (worst >= threshold), 2.0).when(full, worst).otherwise(-2.0).alias("worst"))
        state = grouped(vectors).join(marks, "id", "left")
        state = cut(state.select("id", "v", "comp", F.coalesce("worst", F.lit(-2.0)).alias("worst")), "state")
        new = cut(local_joins(lists, state, threshold), "pairs")
        across = new.where("across")
        quiet = across.isEmpty()
        if not quiet:
            groups = joined(across)
        share, missed = audit(grouped(vectors), threshold, size, turn)
        shares.append(share)
        log.info("round %d: %.6f of the links of %d sampled vectors lie within groups", turn, share, size)
        if share == 1.0 and quiet:
            return groups, shares
        kept = lists.select(F.col("w").alias("a"), F.explode("list").alias("e")).select(F.least("a", "e.b").alias("a"), F.greatest("a", "e.b").alias("b"), "e.sim")
        pairs = cut(kept.unionAll(new.select("a", "b", "sim")).unionAll(missed).unionAll(first_pairs(vectors, threshold, turn)).distinct(), "pairs")
        groups = joined(pairs.where(F.col("sim") >= threshold))


def near_vectors(table: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector."""
    every, vectors = usable(table)
    copies, vectors = one_of_copies(cut(vectors, "vectors"))
    groups, _ = connect(vectors.drop("m"), threshold)
    counts = link_counts(vectors.join(groups, "id").select("comp", "id", "m", "v"), threshold)
    found = vectors.select("id", "m").join(counts, "id", "left").join(groups, "id", "left")
    found = found.select(F.col("id").alias("copy_of"), (F.coalesce("n_links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("comp", "id").alias("comp"))
    of_copies = copies.join(found, "copy_of").select("id", "n_links", "comp")
    out = every.join(of_copies, every["vec_id"] == of_copies["id"], "left")
    component = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
