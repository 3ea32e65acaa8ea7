"""Duplicates by acoustic fingerprint: range join on duration, bit errors, closure, canonical choice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.functions.rules import exact_signature, license_rank, source_rank
from quaverlake.functions.text import blank_to_null, fingerprint_words
from quaverlake.session import cut, release

OFFSETS, OVERLAP = 12, 20


def range_pairs(rows: DataFrame, key: str, value: str, tolerance: float, *carry: str, same: str | None = None) -> DataFrame:
    """Pairs ``a`` < ``b`` by key whose values differ by at most ``tolerance``.

    An equi-join on buckets as wide as the tolerance: a row asks its own and the next bucket, so
    each pair meets once. Rows without value pair with none. Where a column ``same`` must be equal too
    it is part of the join's key; rows without it pair with none.
    """
    width = max(tolerance, 1e-9)
    r = rows.where(F.col(value).isNotNull()).select(key, value, *carry, *([F.col(same).alias("__same")] if same else [])).withColumn("__b", F.floor(F.col(value) / width))
    on = ["__b", "__same"] if same else ["__b"]
    left = r.select(*[F.col(c).alias(f"{c}_1") for c in (key, value, *carry)], *on[1:], F.col("__b").alias("__own"), F.explode(F.array("__b", F.col("__b") + 1)).alias("__b"))
    right = r.select(*[F.col(c).alias(f"{c}_2") for c in (key, value, *carry)], *on)
    met = left.join(right, on).where((F.abs(F.col(f"{value}_1") - F.col(f"{value}_2")) <= tolerance) & ((F.col("__own") != F.col("__b")) | (F.col(f"{key}_1") < F.col(f"{key}_2"))))
    swap = F.col(f"{key}_1") < F.col(f"{key}_2")
    return met.where(F.col(f"{key}_1") != F.col(f"{key}_2")).select(*[x for c in (key, value, *carry) for x in (F.when(swap, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2")).alias(f"{c}_a"), F.when(swap, F.col(f"{c}_2")).otherwise(F.col(f"{c}_1")).alias(f"{c}_b"))])


def bit_error_rate(a: np.ndarray, b: np.ndarray) -> float:
    """The least share of differing bits over all offsets with enough overlap; 1 if there is none."""
    best = 1.0
    for off in range(-OFFSETS, OFFSETS + 1):
        lo, hi = max(0, -off), min(len(a), len(b) - off)
        if hi - lo >= OVERLAP:
            best = min(best, float(np.bitwise_count(a[lo:hi] ^ b[lo + off : hi + off]).sum()) / (32 * (hi - lo)))
    return best


def exact_links(rows: DataFrame, key: str, value: str, same: str, tolerance: float) -> DataFrame:
    """``(id_a, id_b)``: links whose closure joins all rows of equal ``same`` and like ``value``.

    Rows of one ``same`` within one bucket as wide as the tolerance all match, so each is linked with
    the bucket's least only; two buckets in a row are linked by the last of one and the first of the
    next if those are near enough. Partial aggregation bounds what a hot value costs: no pairs of its
    rows are made. Rows without ``same`` or ``value`` link nothing.
    """
    width = max(tolerance, 1e-9)
    r = rows.where(F.col(same).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("id"), F.col(value).alias("d"), F.col(same).alias("same"), F.floor(F.col(value) / width).alias("b"))
    ends = r.groupBy("same", "b").agg(F.min(F.struct("d", "id")).alias("lo"), F.max(F.struct("d", "id")).alias("hi"), F.count("*").alias("n"))
    within = r.join(ends.where("n > 1").select("same", "b", F.col("lo.id").alias("to")), ["same", "b"]).where("id <> to").select(F.col("to").alias("x"), F.col("id").alias("y"))
    after = ends.select("same", (F.col("b") - 1).alias("b"), F.col("lo").alias("next"))
    across = ends.join(after, ["same", "b"]).where(F.col("next.d") - F.col("hi.d") <= tolerance).select(F.col("hi.id").alias("x"), F.col("next.id").alias("y"))
    return within.unionByName(across).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


#: Rows of a block that is compared with another at once.
BLOCK = 256


def _block_matches(a: list[np.ndarray], b: list[np.ndarray], most: float) -> np.ndarray:
    """For each row of a and of b whether the least bit error rate over the offsets is at most ``most``."""

    def stacked(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        wide = max(map(len, words))
        out, full = np.zeros((len(words), wide), np.uint32), np.zeros((len(words), wide), np.uint32)
        for i, w in enumerate(words):
            out[i, : len(w)] = w
            full[i, : len(w)] = 0xFFFFFFFF
        return out, full

    (wa, fa), (wb, fb) = stacked(a), stacked(b)
    na, nb = np.array([len(w) for w in a])[:, None], np.array([len(w) for w in b])[None, :]
    hit = np.zeros((len(a), len(b)), bool)
    for off in range(-OFFSETS, OFFSETS + 1):
        lo, hi = max(0, -off), min(wa.shape[1], wb.shape[1] - off)
        if hi - lo < OVERLAP:
            continue
        overlap = np.minimum(na, nb - off) - lo
        enough = overlap >= OVERLAP
        if not enough.any():
            continue
        both = fa[:, None, lo:hi] & fb[None, :, lo + off : hi + off]
        bits = np.bitwise_count((wa[:, None, lo:hi] ^ wb[None, :, lo + off : hi + off]) & both).sum(2, dtype=np.int64)
        hit |= enough & (bits <= most * 32 * np.maximum(overlap, 1) + 1e-9)
    return hit


def heard_pairs(rows: DataFrame, key: str, value: str, words: str, tolerance: float, most: float) -> DataFrame:
    """``(id_a, id_b)`` of rows of like ``value`` whose fingerprints differ in few bits.

    Each bucket of values meets itself and the next one. A crowded bucket is laid out as a grid of
    cells of bounded size, so that no task holds a whole bucket; a cell compares its two blocks with
    a few array operations for each offset. Only matches leave it.
    """
    width = max(tolerance, 1e-9)
    kind = rows.schema[key].dataType.simpleString()
    r = rows.where(F.col(value).isNotNull() & (F.size(words) >= OVERLAP)).select(F.col(key).alias("id"), F.col(value).cast("double").alias("d"), F.col(words).alias("w"), F.floor(F.col(value) / width).alias("b"))
    sides = F.array(F.struct(F.col("b").alias("at"), F.lit(0).alias("side")), F.struct((F.col("b") - 1).alias("at"), F.lit(1).alias("side")))
    placed = r.select("id", "d", "w", F.inline(sides))
    load = placed.groupBy("at").agg(F.count("*").alias("n"), F.count_if(F.col("side") == 0).alias("own")).where("own > 0 and n > 1").select("at", F.ceil(F.col("n") / BLOCK).cast("int").alias("cells"))
    met = placed.join(load, "at").withColumn("h", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    cells = met.select("at", F.least("h", "k").alias("i"), F.greatest("h", "k").alias("j"), "h", "side", "id", "d", "w")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        out: list[tuple] = []
        left = pdf[pdf["side"] == 0]
        for lh, rh in {(i, j), (j, i)}:
            a, b = left[left["h"] == lh].reset_index(drop=True), pdf[pdf["h"] == rh].reset_index(drop=True)
            if a.empty or b.empty:
                continue
            wa, wb = [np.asarray(w, np.int64).astype(np.uint32) for w in a["w"]], [np.asarray(w, np.int64).astype(np.uint32) for w in b["w"]]
            rows_at_once = max(1, 4_000_000 // (len(wb) * max(map(len, wb))))
            for at in range(0, len(wa), rows_at_once):
                hit = _block_matches(wa[at : at + rows_at_once], wb, most)
                near = np.abs(a["d"].to_numpy()[at : at + rows_at_once, None] - b["d"].to_numpy()[None, :]) <= tolerance
                for x, y in zip(*np.nonzero(hit & near), strict=True):
                    one, two = a["id"][at + x], b["id"][y]
                    # rows of the same side meet twice
                    if one < two or (b["side"][y] == 1 and one != two):
                        out.append((min(one, two), max(one, two)))
        return pd.DataFrame(out, columns=["id_a", "id_b"]).drop_duplicates()

    return cells.groupBy("at", "i", "j").applyInPandas(compare, f"id_a {kind}, id_b {kind}").distinct()


def signed(tracks: DataFrame) -> DataFrame:
    """Tracks whose missing or empty fingerprint is replaced by their exact signature."""
    own = exact_signature(F.col("caf_bytes"), F.col("duration_sec"), F.col("original_sha1"))
    return tracks.withColumn("audio_fingerprint", F.coalesce(blank_to_null(F.col("audio_fingerprint")), own))


def duplicate_pairs(tracks: DataFrame, tolerance: float = 3.0, most: float = 0.2) -> DataFrame:
    """``(id_a, id_b)``: links whose closure joins all tracks of like duration with equal checksum, equal
    exact signature or near fingerprint.

    Equal ones are found by equality and linked through one of them; fingerprints are compared bit by
    bit, never with an exact signature. A missing duration counts as 0.
    """
    t = tracks.where("audio_fingerprint is not null").select("id", F.coalesce("duration_sec", F.lit(0.0)).alias("d"), blank_to_null(F.col("original_sha1")).alias("sha"), F.col("audio_fingerprint").alias("fp"))
    exact = F.col("fp").startswith("exact:")
    same = exact_links(t, "id", "d", "sha", tolerance).unionByName(exact_links(t.withColumn("fp", F.when(exact, F.col("fp"))), "id", "d", "fp", tolerance))
    heard = t.where(~exact).withColumn("w", fingerprint_words(F.col("fp")))
    return same.unionByName(heard_pairs(heard, "id", "d", "w", tolerance, most)).distinct()


def closure(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """``(id, root)``: the smallest id reachable from each, by label propagation with shortcuts."""
    links = cut(pairs.select(F.col(a).alias("v"), F.col(b).alias("w")).union(pairs.select(F.col(b), F.col(a))).where("v <> w").distinct())
    labels = cut(links.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("root")))
    while True:
        seen = labels.select(F.col("v").alias("w"), F.col("root").alias("r"))
        low = links.join(seen, "w").groupBy("v").agg(F.min("r").alias("r"))
        near = labels.join(low, "v").select("v", "root", F.least("root", "r").alias("r"))
        jump = near.join(labels.select(F.col("v").alias("r"), F.col("root").alias("rr")), "r", "left").select("v", "root", F.least("r", "rr").alias("r"))
        before, after = labels, cut(jump)
        moved = not after.where("r <> root").isEmpty()
        release(before)
        labels = after.select("v", F.col("r").alias("root"))
        if not moved:
            release(links)
            return labels.select(F.col("v").alias("id"), "root")


def canonical(members: DataFrame, group: str, *ranks: Column) -> DataFrame:
    """``(group, canonical)``: the member with the largest ranks, then the smallest id."""
    return members.groupBy(group).agg(F.min(F.struct(*[(-r).alias(f"r{i}") for i, r in enumerate(ranks)], "id")).alias("b")).select(group, F.col("b.id").alias("canonical"))


def marked_duplicates(tracks: DataFrame, roots: DataFrame) -> DataFrame:
    """``(id, root, dup_of)`` of every member of a group: ``dup_of`` is NULL for the one that stays.

    It has the freest licence, then the most trusted source, the largest packaged file and the
    smallest id.
    """
    m = roots.join(tracks, "id")
    best = canonical(m, "root", license_rank(F.col("license_short"), F.col("license_url")), source_rank(F.col("source")), F.coalesce("caf_bytes", F.lit(0)))
    return roots.join(best, "root").select("id", "root", F.nullif("canonical", "id").alias("dup_of"))


def cluster_summary(marked: DataFrame) -> DataFrame:
    """``(clusters, duplicates)``: groups of two or more, and the rows marked in them."""
    return marked.agg(F.countDistinct("root").alias("clusters"), F.count("dup_of").alias("duplicates"))
