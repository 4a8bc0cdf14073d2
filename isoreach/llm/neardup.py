"""Near duplicates: HyperMinHash registers, banded; links confirmed on full shingle sets; components."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Aside, Stash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: A register holds the leading zeros of its bucket's least hash (6 bits) and the MANTISSA bits after them.
MANTISSA = 10
#: BANDS bands of ROWS registers: two sets of Jaccard 0.8 share no band once in 190,000 pairs.
BANDS, ROWS = 40, 6
#: Pairs whose estimate lies this many standard deviations under the threshold are not verified.
SLACK = 6.0
CHUNK = 1 << 14


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; with fewer words, of the whole sequence."""
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - size + 1)
    if n == 1:
        grams = [" ".join(words)]
    elif size == 2:
        grams = list({a + " " + b for a, b in zip(words, words[1:])})
    else:
        grams = list({" ".join(words[i : i + size]) for i in range(n)})
    return np.unique(pd.util.hash_array(np.array(grams, dtype=object), categorize=False))


def registers(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Per set (the runs of hashes that begin at starts) k registers of 16 bits. Each of the k buckets
    takes the whole set under a permutation of its own, so that short sets leave none empty."""
    rng = np.random.default_rng(20)
    mult = rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, k, dtype=np.uint64)
    least = np.empty((len(starts), k), np.uint64)
    for j in range(k):
        least[:, j] = np.minimum.reduceat(hashes * mult[j] + add[j], starts)
    # least = 2**e * (1 + fraction): leading zeros 63 - e, then the first bits of the fraction
    low = np.maximum(least, np.uint64(1))
    e = np.frexp(low.astype(np.float64))[1].astype(np.int64) - 1
    e = np.where((np.uint64(1) << np.minimum(e, 63).astype(np.uint64)) > low, e - 1, np.minimum(e, 63))
    shifted = low << (63 - e).astype(np.uint64)
    bits = (shifted << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return ((63 - e).astype(np.uint16) << np.uint16(MANTISSA)) | bits.astype(np.uint16)


def collision_rate(n: float, m: float) -> float:
    """Chance that registers of two disjoint sets agree: in the exponent cell that the least of n and of
    m hashes fall in with the chances of minima, one of 2**MANTISSA mantissas agrees."""
    total, cells = 0.0, 1 << MANTISSA
    for z in range(64):
        lo, hi = 2.0 ** -(z + 1), 2.0**-z
        inside = lambda x: np.exp(x * np.log1p(-lo)) - (np.exp(x * np.log1p(-hi)) if hi < 1 else 0.0)
        total += inside(n) * inside(m) / cells
    return float(total)


_RATES: dict[tuple[int, int], float] = {}


def estimated_jaccard(agree: float, n: int, m: int) -> float:
    """Share of agreeing registers, corrected for the agreement of different minima."""
    key = (n.bit_length(), m.bit_length())
    if key not in _RATES:
        _RATES[key] = collision_rate(2.0 ** key[0], 2.0 ** key[1])
    c = _RATES[key]
    return (agree - c) / (1 - c)


def sketched(size: int, k: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                sets = [shingles(t, size) for t in part["text"]]
                filled = [i for i, s in enumerate(sets) if len(s)]
                made: list[bytes | None] = [None] * len(sets)
                group: list[int] = []
                room = 0
                for i in [*filled, -1]:
                    if group and (i < 0 or room + len(sets[i]) > CHUNK):
                        starts = np.cumsum([0, *[len(sets[g]) for g in group[:-1]]])
                        for g, row in zip(group, registers(np.concatenate([sets[g] for g in group]), starts, k)):
                            made[g] = row.tobytes()
                        group, room = [], 0
                    if i >= 0:
                        group.append(i)
                        room += len(sets[i])
                yield pd.DataFrame({"nd_key": part["nd_key"], "rep": part["rep"], "n_shingles": [len(s) for s in sets], "sketch": made, "shingles": [s.tobytes() for s in sets]})

    return work


def estimated(percent: int, k: int):
    """Of candidate pairs with both sides' registers, those whose sizes and estimate allow a link."""
    sd = (percent / 100 * (1 - percent / 100) / k) ** 0.5
    floor = percent / 100 - SLACK * sd

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for sa, sb, n, m in zip(b["sketch_a"], b["sketch_b"], b["n_a"].tolist(), b["n_b"].tolist()):
                ok = 100 * min(n, m) >= percent * max(n, m)
                if ok:
                    agree = float((np.frombuffer(sa, np.uint16) == np.frombuffer(sb, np.uint16)).mean())
                    ok = estimated_jaccard(agree, n, m) >= floor
                keep.append(ok)
            yield b.loc[np.array(keep, bool), ["a", "b"]]

    return work


def verified(percent: int):
    """Of pairs with both sides' sets, those whose sets are similar enough."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for xa, xb in zip(b["set_a"], b["set_b"]):
                u = np.concatenate([np.frombuffer(xa, np.uint64), np.frombuffer(xb, np.uint64)])
                u.sort()
                both = int((u[1:] == u[:-1]).sum())
                keep.append(100 * both >= percent * (len(u) - both))
            yield b.loc[np.array(keep, bool), ["a", "b"]]

    return work


def merged(labels: Stash | None, links: DataFrame) -> Stash:
    """(node, comp) after more links (a, b): the smallest node reachable. Only the graph whose nodes are the
    labels so far is walked, in rounds of the least label of the neighbours and then of that label's own
    label, until none falls; every round is a written table."""

    def named(rows: DataFrame, x: str) -> DataFrame:
        if labels is None:
            return rows
        return rows.join(labels.df.select(F.col("node").alias(x), F.col("comp").alias("of")), x, "left").withColumn(x, F.coalesce("of", x)).drop("of")

    bare = named(named(links.select("a", "b"), "a"), "b").where("a <> b")
    both = Stash(bare.union(bare.select(F.col("b"), F.col("a"))).distinct(), "edges")
    tops = Stash(both.df.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "tops")
    while True:
        old = tops.df
        near = both.df.join(old.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        # the label of a node's label reaches as far as all rounds before it
        jump = old.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = old.join(near, "node").join(jump, "comp", "left").select("node", F.least("low", "comp", "far").alias("comp"), F.col("comp").alias("was"))
        step = Stash(new, "tops")
        tops.drop()
        tops = step
        if not step.df.where("comp < was").limit(1).count():
            break
    now = tops.df.select("node", "comp")
    if labels is not None:
        up = tops.df.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        known = labels.df.join(up, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
        now = known.union(now.join(labels.df.select("node"), "node", "left_anti"))
    out = Stash(now, "labels")
    for done in (both, tops):
        done.drop()
    return out


def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), 64):
            part = b.iloc[at : at + 64]
            sets = [np.frombuffer(x, np.int64) for x in part["shingles"]]
            yield pd.DataFrame({"rep": np.repeat(part["rep"].to_numpy(), [len(s) for s in sets]), "shingle": np.concatenate(sets)})


def confirmed(pairs: DataFrame, sketch: Stash, percent: int, k: int) -> Stash:
    """Of candidate pairs (a, b) the links, by registers first and then by full sets."""
    s = sketch.df
    lean = lambda x: s.select(F.col("rep").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    met = pairs.distinct().join(lean("a"), "a").join(lean("b"), "b")
    near = Stash(met.mapInPandas(estimated(percent, k), "a long, b long"), "near")
    # sets are read for the documents of these pairs alone
    ends = Stash(near.df.select("a").union(near.df.select("b")).distinct().withColumnRenamed("a", "rep"), "named")
    sets = s.select("rep", F.col("shingles").alias("set")).join(ends.side(), "rep")
    full = lambda x: sets.select(F.col("rep").alias(x), F.col("set").alias(f"set_{x}"))
    out = Stash(near.df.join(full("a"), "a").join(full("b"), "b").mapInPandas(verified(percent), "a long, b long"), "links")
    near.drop()
    ends.drop()
    return out


def opened(rows: DataFrame, labels: Stash | None) -> Stash:
    """Of the members (key, rep, n, weight) of buckets those of buckets with several components, with their
    comp; the bucket's largest component, its heaviest member and its least n."""
    if labels is None:
        placed = rows.withColumn("comp", F.col("rep"))
    else:
        placed = rows.join(labels.df.select(F.col("node").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    of_comp = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least"), F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("top"))
    of_key = of_comp.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.min("least").alias("least"), F.max("top").alias("top"), F.max(F.struct("size", (-F.col("comp")).alias("minus"))).alias("main"))
    several = Stash(of_key.where("comps > 1").select("key", "least", (-F.col("top.minus")).alias("center"), (-F.col("main.minus")).alias("main_comp")), "several")
    out = Stash(placed.join(several.side(), "key"), "open")
    several.drop()
    return out


def linked(sketch: Stash, banded: DataFrame, percent: int, k: int) -> Stash | None:
    """(node, comp) under the links between texts that share a band (key, rep); others are not in it.

    First every bucket's center meets its other members: the one that shares most bands with others, which
    in a group of copies is the text they come from or is near it, so that most of the group is one component.

    What is then left are buckets of several components. A link within one has an end x outside the
    bucket's largest component. With n shingles of x and least the smallest size in its buckets, a linked text has
    need = percent * (n + least) / (100 + percent) of them at least. In the order of the number of texts left
    that hold a shingle, the first one that two linked texts share stands at n - need + 1 at most in each. Such
    places are joined: a text of a group that is changed too far has enough shingles of its own to fill
    them, and meets few others instead of the whole group. No bucket, list or number of partners is capped.
    """
    met = banded.groupBy("key").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    shared = Stash(banded.join(met, "key").select("key", "rep", "met"), "buckets")
    if not shared.df.limit(1).count():
        shared.drop()
        return None
    weight = shared.df.groupBy("rep").agg(F.sum("met").alias("weight")).join(sketch.df.select("rep", F.col("n_shingles").alias("n")), "rep")
    rows = Stash(shared.df.select("key", "rep").join(weight, "rep"), "members")
    shared.drop()
    first = opened(rows.df, None)
    stars = first.df.where(F.col("rep") != F.col("center")).select(F.least("center", "rep").alias("a"), F.greatest("center", "rep").alias("b"))
    links = confirmed(stars, sketch, percent, k)
    labels = merged(None, links.df)
    rest = opened(first.df.select("key", "rep", "n", "weight"), labels)
    for done in (rows, first, links):
        done.drop()
    if rest.df.limit(1).count():
        outer = rest.df.groupBy("rep").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.min("least").alias("least"), F.max(F.col("comp") != F.col("main_comp")).alias("outside"))
        texts = Stash(outer, "texts")
        held = Stash(sketch.df.join(texts.side("rep"), "rep").select("rep", "shingles").mapInPandas(listed, "rep long, shingle long"), "shingles")
        times = Stash(held.df.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "times")
        own = held.df.join(texts.side(), "rep").join(times.df, "shingle", "left")
        by_rarity = Window.partitionBy("rep").orderBy(F.coalesce("times", F.lit(1)), "shingle")
        enough = lambda n, m: f"{100 + percent} * ({n} - place + 1) >= {percent} * ({n} + {m})"
        rare = Stash(own.withColumn("place", F.row_number().over(by_rarity)).where(enough("n", "least")).where("times > 1").select("rep", "shingle", "place", "n", "comp", "outside"), "rare")
        sought = rare.df.where("outside").select("shingle", F.col("rep").alias("a"), F.col("n").alias("a_n"), F.col("comp").alias("a_comp"), F.col("place").alias("a_place"))
        pairs = rare.df.join(sought, "shingle").where("comp <> a_comp").where(enough("n", "a_n")).where(enough("a_n", "n").replace("- place", "- a_place"))
        links = confirmed(pairs.select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")), sketch, percent, k)
        before, labels = labels, merged(labels, links.df)
        for done in (texts, held, times, rare, links, before):
            done.drop()
    rest.drop()
    return labels


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The class of each document under links between texts whose sets of word shingles have a Jaccard
    coefficient of percent / 100 or more.

    docs: doc_id long, text and any other columns. Returned: those columns, n_shingles long,
    component_id (the smallest doc_id reachable over links, itself included) and kept (doc_id =
    component_id). Words are maximal runs without ASCII white space, A-Z in lower case; a text of fewer
    words than a shingle is one shingle, one without words is linked with nothing.

    Texts with the same sequence of words in the same case are one class from the start, so copies never meet as pairs.
    Class representatives that share a band of compressed registers are candidates, which linked() compares.
    A pair is dropped by the corrected register estimate only SLACK deviations under the threshold, and
    confirmed on the full sets, held as 64-bit hashes of the shingles.

    A null doc_id is in no class (component_id null, kept true). Rows that repeat a doc_id with equal texts
    are one document, each kept if the doc_id is; differing texts of one doc_id are one document too, linked
    with what either links with. A text of any length is cut and hashed in one task, at about 100 bytes a word; its set then takes
    8 bytes a shingle. Links are symmetric, so ties do not arise. Columns with the names returned are
    replaced; others may have any name. An empty table gives no rows.
    """
    k = bands * rows
    given = Aside(docs, ("n_shingles", "component_id", "kept"))
    # single spaces stay as they are; texts that differ in case alone have equal registers and meet as candidates
    plain = F.trim(F.regexp_replace(F.coalesce(given.col("text"), F.lit("")), "[\\x09-\\x0D][\\x09-\\x0D ]*| [\\x09-\\x0D ]+", " "))
    keyed = given.df.withColumns({"doc_id": given.col("doc_id"), "nd_key": F.unhex(F.sha2(plain.cast("binary"), 256))})
    ids = Stash(keyed.select("doc_id", "nd_key"), "ids")
    # the text of a class of copies is read at its smallest row; only these texts are shuffled, to drop repeated rows
    several = Stash(ids.df.where("doc_id is not null").groupBy("nd_key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("nd_key", "first"), "copies")
    ids.drop()
    flagged = keyed.where("doc_id is not null").select("nd_key", F.col("doc_id").alias("rep"), given.col("text").alias("text")).join(several.side(), "nd_key", "left")
    once = flagged.where("first is null").select("nd_key", "rep", "text")
    texts = once.union(flagged.where("rep = first").select("nd_key", "rep", "text").dropDuplicates(["nd_key"]))
    sketch = Stash(texts.mapInPandas(sketched(size, k), "nd_key binary, rep long, n_shingles long, sketch binary, shingles binary"), "sketch")
    width = 2 * rows
    banded = sketch.df.where("n_shingles > 0").select("rep", F.explode(F.array(*[F.xxhash64(F.substring("sketch", 1 + width * i, width), F.lit(i)) for i in range(bands)])).alias("key"))
    labels = linked(sketch, banded, percent, k)
    found = sketch.df.select("nd_key", "rep", "n_shingles")
    if labels is not None:
        found = found.join(labels.df.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    else:
        found = found.withColumn("comp", F.lit(None).cast("long"))
    classes = Stash(found.select("nd_key", "n_shingles", F.coalesce("comp", "rep").alias("comp")), "classes")
    for done in (several, sketch, labels):
        if done is not None:
            done.drop()
    out = keyed.join(classes.side(grows=True), "nd_key", "left")
    # an empty text is a class of its own document, not of all empty texts
    own = F.coalesce(F.col("n_shingles"), F.lit(0)) == 0
    component = F.when(F.col("doc_id").isNotNull(), F.when(own, F.col("doc_id")).otherwise(F.col("comp")))
    shown = out.select(*given.back(), F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    return shown
