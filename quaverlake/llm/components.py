"""Consolidating pairwise matches into groups: rake, compress, solve the core, restore.

The graph is reduced before it is solved. Vertices of one link are stripped and hung on their
neighbour (rake); chains of vertices of two links are measured by list ranking, i.e. pointer
doubling over their arcs, and replaced by one link between their ends (compress). Trees and chains
of any length so vanish in a logarithmic number of rounds. What remains, the core, has three links
or more at each vertex and is solved by alternating large-star and small-star steps. Labels then go
back to the removed vertices, last removed first.

Every step is an equi-join or an aggregation with partial sums; no vertex's neighbours are ever
gathered in one place, and the driver sees counts only. Lineage is cut with tables in the shared
folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quaverlake.session import cut, cut_counted, release

#: A round of rake and compress that removes a smaller part of the links than this hands the rest to
#: the core solver, which is exact for any graph: it decides who works, not what comes out.
LEAST_GAIN = 0.02


def _both(edges: DataFrame) -> DataFrame:
    """Each undirected link as two arcs (v, w)."""
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("x")).select("x.v", "x.w")


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rake(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The links between vertices of two links or more, the stripped vertices with their parents,
    and how many were stripped."""
    degree = _both(edges).groupBy("v").agg(F.count("*").alias("n"), F.min("w").alias("w"))
    leaves, n = cut_counted(degree.where("n = 1").select("v", "w"))
    # of a link between two leaves the larger hangs on the smaller
    gone = leaves.groupBy(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).agg(F.max("v").alias("v"))
    hung = gone.select("v", F.when(F.col("v") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("parent"))
    return (edges.join(gone.select("a", "b"), ["a", "b"], "left_anti") if n else edges), hung, n


def _compress(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Replaces chains of vertices of two links by one link; hangs their vertices on an end.

    An arc (u, v) into a chain vertex v goes on with (v, w), w being v's other neighbour. Doubling
    follows each arc to the first vertex off the chain. Arcs that never leave belong to a ring of
    chain vertices only; its vertices hang on the smallest of them.
    """
    degree = _both(edges).groupBy("v").agg(F.count("*").alias("n"), F.min("w").alias("x"), F.max("w").alias("y"))
    chain, size = cut_counted(degree.where("n = 2").select("v", "x", "y"))
    if not size:
        return edges, chain.select("v", F.col("x").alias("parent")), 0
    arcs = chain.select("v", F.inline(F.array(F.struct(F.col("x").alias("u"), F.col("y").alias("w")), F.struct(F.col("y").alias("u"), F.col("x").alias("w")))))
    # (fu, fv): the arc reached so far; open: it goes on; low: the smallest vertex passed
    state, left = cut_counted(
        arcs.join(chain.select(F.col("v").alias("w"), F.lit(True).alias("on")), "w", "left").select(
            "u", "v", F.col("v").alias("fu"), F.col("w").alias("fv"), F.coalesce("on", F.lit(False)).alias("open"), F.least("v", "w").alias("low")
        )
    )
    while left:
        step = state.select(F.col("u").alias("fu"), F.col("v").alias("fv"), F.col("fu").alias("gu"), F.col("fv").alias("gv"), F.col("open").alias("go"), F.col("low").alias("glow"))
        moved = (
            state.where("open")
            .join(step, ["fu", "fv"])
            .select("u", "v", F.col("gu").alias("fu"), F.col("gv").alias("fv"), F.col("go").alias("open"), F.least("low", "glow").alias("low"), (~F.col("go") | (F.col("glow") < F.col("low"))).alias("news"))
        )
        seen, before = Observation(), state
        state = cut(state.where("not open").withColumn("news", F.lit(False)).unionByName(moved).observe(seen, F.count_if("open").alias("open"), F.count_if("news").alias("news")).drop("news"))
        # while a chain is open some arc of it closes in each round, and a ring's least vertex
        # reaches further arcs until all know it: without news only settled rings are open
        left = seen.get["open"] if seen.get["news"] else 0
        release(before)
    ends = cut(state.groupBy("v").agg(F.min(F.when(~F.col("open"), F.col("fv"))).alias("t1"), F.max(F.when(~F.col("open"), F.col("fv"))).alias("t2"), F.min("low").alias("low")))
    hung = ends.select("v", F.coalesce("t1", "low").alias("parent")).where(F.col("v") != F.col("parent"))
    spliced = ends.where(F.col("t1").isNotNull() & (F.col("t1") != F.col("t2"))).select(F.col("t1").alias("a"), F.col("t2").alias("b"))
    kept = edges.join(chain.select(F.col("v").alias("a")), "a", "left_anti").join(chain.select(F.col("v").alias("b")), "b", "left_anti")
    return _ordered(kept.select("a", "b").unionByName(spliced)), hung, size


def _core(edges: DataFrame) -> DataFrame:
    """(v, parent) of the core by alternating large-star and small-star; a root has no row."""
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(edges)
    own = None  # the links written in the round before
    while True:
        arcs = _both(edges)
        low = arcs.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("m"))
        large = arcs.where("w > v").join(low, "v").select(F.col("m").alias("a"), F.col("w").alias("b"))
        large = _ordered(large.unionByName(low.select(F.col("m").alias("a"), F.col("v").alias("b"))))
        # small star: links are (smaller, larger); each larger vertex links its smaller ones to their least
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = cut(_ordered(small.unionByName(least.select(F.col("m").alias("a"), "b"))))
        if own is not None:
            release(own)
        own, now = edges, mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("b").alias("v"), F.col("a").alias("parent"))


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``(vertex, group)`` of every vertex that is linked directly or indirectly to another.

    ``group`` is the smallest vertex of the group. Repeated pairs, in either direction, count once;
    a pair with a NULL end or of a vertex with itself links nothing; an empty table gives an empty
    result. Other columns are not read, so their names cannot clash. Vertices may be of any
    orderable type; both columns must have the same one.
    """
    edges, links = cut_counted(_ordered(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())))
    parents = edges.select(F.col("b").alias("v"), F.col("a").alias("parent")).limit(0)
    depth = 1
    while links:
        raked, stripped, n = _rake(edges)
        edges, spliced, m = _compress(cut(raked) if n else edges)
        parents = parents.unionByName(stripped).unionByName(spliced)
        depth += 2
        if n or m:
            edges, links = cut_counted(edges)
        if n + m < LEAST_GAIN * links:
            break
    if links:
        parents = parents.unionByName(_core(edges))
    # restoring: each removed vertex follows its parents, layer by layer, by doubling the steps
    parents = cut(parents)
    while depth > 1:
        up, before = parents.select(F.col("v").alias("parent"), F.col("parent").alias("up")), parents
        parents = cut(parents.join(up, "parent", "left").select("v", F.coalesce("up", "parent").alias("parent")))
        release(before)
        depth = (depth + 1) // 2
    # a vertex without parent is its group's label; the group is named by its smallest vertex
    least = parents.groupBy("parent").agg(F.min("v").alias("low")).select("parent", F.least("low", "parent").alias("group"))
    return parents.join(least, "parent").select(F.col("v").alias("vertex"), "group").unionByName(least.select(F.col("parent").alias("vertex"), "group"))


def track_groups(match_pairs: DataFrame, tracks: DataFrame) -> DataFrame:
    """``(track_id, group_id)`` of every track in a group of two or more.

    Letter case and blanks around an id mean nothing. A pair that lacks an id, names one track
    twice or names a track that does not exist links nothing. ``group_id`` is the smallest
    ``tracks.id`` of the group.
    """
    norm = lambda c: F.upper(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))
    ids = tracks.where(F.col("id").isNotNull()).groupBy(norm(F.col("id")).alias("key")).agg(F.min("id").alias("id"))
    pairs = (
        match_pairs.select(norm(F.col("track_a")).alias("ka"), norm(F.col("track_b")).alias("kb"))
        .where("ka is not null and kb is not null and ka <> kb")
        .select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb"))
        .distinct()
    )
    both = pairs.join(ids.select(F.col("key").alias("ka"), F.col("id").alias("a")), "ka").join(ids.select(F.col("key").alias("kb"), F.col("id").alias("b")), "kb")
    return components(both, "a", "b").select(F.col("vertex").alias("track_id"), F.col("group").alias("group_id"))


