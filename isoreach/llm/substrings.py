"""Exact substring dedup: bytes under strings of a given length that start in more than one place."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Aside, Stash

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
CODES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Length of a gram as a share of the strings: longer ones leave fewer runs to compare, and make more runs.
GRAM = 0.25
#: Bytes of its gram that a run is led by, and bytes of runs in a bucket.
LEAD, BUCKET_BYTES = 24, 4 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, n of them at least; kept up to a million."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 14), base, np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if n <= 1 << 20:
            _powers[base] = known
    return known


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any substrings of data, by prefix sums modulo 2**64."""

    def __init__(self, data: bytes):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(CODES[np.frombuffer(data, np.uint8)] * powers(BASE, n)[:n], out=self.sums[1:])
        self.down = powers(BASE_INVERSE, n + 1)

    def all_of(self, k: int) -> np.ndarray:
        return mixed((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])


def sliding(x: np.ndarray, w: int, ufunc: np.ufunc, pad: int) -> np.ndarray:
    """ufunc over every w entries, by running values from both ends of blocks of w."""
    n = len(x)
    full = np.full(-(-n // w) * w, pad, x.dtype)
    full[:n] = x
    blocks = full.reshape(-1, w)
    ahead = ufunc.accumulate(blocks, axis=1).ravel()
    back = ufunc.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(back[: n - w + 1], ahead[w - 1 : n])


def runs_of(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """Runs of starts lo..hi of strings of the length that have the same least gram hash v: equal strings
    have equal v. Also a place where that gram begins, and 2 for a run with its gram in two places."""
    k = max(1, int(length * GRAM))
    w = length - k + 1
    grams = Rolling(data).all_of(k)
    least = sliding(grams, w, np.minimum, (1 << 64) - 1)
    lo = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    hi = np.concatenate([lo[1:] - 1, [len(least) - 1]])
    v = least[lo]
    times = np.ones(len(lo), np.int64)
    around = np.zeros(len(least) + 2 * (w - 1), np.uint64)
    around[w - 1 : w - 1 + len(least)] = least
    anchors = np.flatnonzero(grams == sliding(around, w, np.maximum, 0))
    values, where = np.unique(grams[anchors], return_index=True)
    at = anchors[where[np.searchsorted(values, v)]]
    if len(values) < len(anchors):
        first, last = np.searchsorted(anchors, lo), np.searchsorted(anchors, hi + w)
        for b in range(len(lo)):
            times[b] = 1 + (np.count_nonzero(grams[anchors[first[b] : last[b]]] == v[b]) > 1)
    return v, lo, hi, at, times


def sized(batches: Iterator[pd.DataFrame], column: str = "data", most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Consecutive rows of about so many bytes in the column, one row at least."""
    for batch in batches:
        part = batch[column].map(len).cumsum() // most
        for _, rows in batch.groupby(part.to_numpy(), sort=True):
            yield rows


def run_rows(length: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in sized(batches):
            made = [runs_of(bytes(d), length) for d in part["data"]]
            v, lo, hi, at, times = (np.concatenate(x) for x in zip(*made))
            yield pd.DataFrame({"tid": np.repeat(part["tid"].to_numpy(), [len(m[0]) for m in made]), "v": v.view(np.int64), "lo": lo, "hi": hi, "at": at, "times": times})

    return work


def body_rows(length: int):
    """Of texts with their runs that may repeat: the bytes of every run's strings, led by those of its gram.
    Equal runs of some texts are one row with all their places, so that a common passage is sent on once."""
    lead = min(LEAD, max(1, int(length * GRAM)))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in sized(batches):
            met: dict[tuple[bytes, int], list] = {}
            for tid, data, runs in zip(part["tid"].tolist(), part["data"], part["runs"]):
                data = bytes(data)
                for r in runs:
                    body = data[r["lo"] : r["hi"] + length]
                    row = met.setdefault((body, r["v"]), [data[r["at"] : r["at"] + lead], r["times"], [], []])
                    row[2].append(tid)
                    row[3].append(r["lo"])
            yield pd.DataFrame([(x[0], v, x[2][0], body, x[1], x[2], x[3]) for (body, v), x in met.items()], columns=["lead", "v", "salt", "body", "times", "tids", "los"])

    return work


def multikey_sorted(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort strings of data by multikey quicksort and keep those that are equal to another.

    All ranges that are still open are split at once, by group and then by one token of 8 bytes after
    another: a range whose strings have the same token goes on as it is, another one is sorted by the token
    and split where it changes, and a range of one string is done. Returned: the positions within starts of the
    strings in ranges of several at the end, which share all bytes, and the number of each one's range.
    """
    tokens = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1)).view(">u8")[:, 0] if len(data) > 7 else None
    order = np.argsort(group, kind="stable")
    ranges = group[order]
    for depth in [*range(0, length - 7, 8), length - 8] if length >= 8 else range(length):
        if not len(order):
            break
        token = tokens[starts[order] + depth] if length >= 8 else data[starts[order] + depth]
        inside = ranges[1:] == ranges[:-1]
        if (inside & (token[1:] != token[:-1])).any():
            number = np.concatenate([[0], np.cumsum(~inside)])
            uneven = np.zeros(number[-1] + 1, bool)
            uneven[number[1:][inside & (token[1:] != token[:-1])]] = True
            at = np.flatnonzero(uneven[number])
            moved = at[np.lexsort((token[at], number[at]))]
            order[at], token[at] = order[moved], token[moved]
            inside &= token[1:] == token[:-1]
        ranges = np.concatenate([[0], np.cumsum(~inside)])
        several = np.zeros(len(order), bool)
        several[1:] |= inside
        several[:-1] |= inside
        order, ranges = order[several], ranges[several]
    return order, ranges


def bucket_rows(length: int):
    """Of one bucket of runs in the order of their leading bytes: spans (tid, lo, hi) of bytes under strings
    that are found twice in it; and for hot grams, which neighbouring buckets hold too, the digest of each
    different string, with its place if it is not found twice in this bucket."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds: dict[tuple[int, bytes], list] = {}
        for b in batches:
            for v, body, times, tids, los, hot in zip(b["v"].tolist(), b["body"], b["times"].tolist(), b["tids"], b["los"], b["hot"].tolist()):
                row = kinds.setdefault((v, bytes(body)), [hot, times, [], []])
                row[2].append(tids)
                row[3].append(los)
        if not kinds:
            return
        rows = [(v, body, hot, times, np.concatenate(t), np.concatenate(p)) for (v, body), (hot, times, t, p) in kinds.items()]
        kinds.clear()
        of_v = np.unique([r[0] for r in rows], return_inverse=True)[1]
        count = np.array([len(r[4]) for r in rows])
        n_starts = np.array([len(r[1]) for r in rows]) - length + 1
        # a gram that has one kind of run leaves nothing to sort
        open_ = (np.bincount(of_v)[of_v] > 1) | ((count == 1) & (np.array([r[3] for r in rows]) > 1))
        hit = [np.full(n, c > 1) for n, c in zip(n_starts.tolist(), count.tolist())]
        flat = np.concatenate(hit)
        base = np.cumsum(n_starts) - n_starts
        chosen = np.flatnonzero(open_)
        stands = flat.copy()
        if len(chosen):
            data = np.frombuffer(b"".join([rows[i][1] for i in chosen]) + bytes(8), np.uint8)
            size = n_starts[chosen] + length - 1
            starts = spread(np.cumsum(size) - size, n_starts[chosen])
            place = spread(base[chosen], n_starts[chosen])
            order, ranges = multikey_sorted(data, starts, np.repeat(of_v[chosen], n_starts[chosen]), length)
            flat[place[order]] = True
            # one string of each range stands for it in the comparison with other buckets
            stands[place[order]] = False
            stands[place[order[np.flatnonzero(np.diff(ranges, prepend=-1))]]] = True
        out: list[tuple] = []
        for i, (_, body, hot, _, tids, los) in enumerate(rows):
            found = flat[base[i] : base[i] + n_starts[i]]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(np.int8), [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                out += [(None, t, p + a, p + b - 1 + length) for t, p in zip(tids.tolist(), los.tolist())]
            if hot:
                for s in range(int(n_starts[i])):
                    mark = hashlib.blake2b(body[s : s + length], digest_size=16).digest
                    if not found[s]:
                        out += [(mark(), t, p + s, p + s + length) for t, p in zip(tids.tolist(), los.tolist())]
                    elif stands[base[i] + s]:
                        out.append((mark(), None, None, None))
        for at in range(0, len(out), 1 << 16):
            yield pd.DataFrame(out[at : at + (1 << 16)], columns=["digest", "tid", "lo", "hi"]).astype({"tid": "Int64", "lo": "Int64", "hi": "Int64"})

    return work


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then those of start[1], and so on."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def covered(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((int(s["lo"]), int(s["hi"])) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in sized(batches):
        rows = []
        for key, data, spans in zip(batch["digest"], batch["data"], batch["spans"]):
            data, runs = bytes(data), covered(spans)
            ends = [0, *[x for r in runs for x in r], len(data)]
            rest = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2]))
            rows.append((key, sum(b - a for a, b in runs), len(runs), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore"), [{"start": a, "end": b} for a, b in runs]))
        yield pd.DataFrame(rows, columns=["digest", "n_removed", "n_spans", "kept_sha256", "kept_text", "cut_spans"])


def repeated_substrings(docs: DataFrame, length: int = 200, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Remove every byte under a string of length bytes that starts in more than one place of all texts.

    docs: text and any other columns. Returned: those columns, n_bytes, n_removed, n_spans (long),
    kept_sha256, spans (array of removed [start, end) byte runs) and kept_text, the remaining bytes as
    text, without those of characters cut in two. Strings lie within one text, and may overlap; they are
    judged on the texts given.

    Equal texts are met once: a text of length bytes or more that several rows hold is removed whole.
    Every other text's starts fall into runs whose strings share their least gram of GRAM * length bytes;
    runs whose gram is found once cannot repeat and go. The strings of the rest are range-partitioned, a run's
    together, by their leading gram's bytes at splitters that Spark samples. A bucket sorts its strings by
    multikey quicksort, which compares all bytes. The places of a gram that fills more than a bucket are dealt over
    several, and compared across their boundaries by 128-bit digests of what differs within each.

    A null text is empty, and nothing of it is removed. Repeated rows are rows of their own, and so repeat
    each other. A text, its runs and its spans are held by one task, a bucket by another; very long texts take
    about 100 bytes of memory a byte while their runs are found. Which of several equal strings is met first does not show. Columns with
    the names returned are replaced; others may have any name. An empty table gives no rows.
    """
    given = Aside(docs, ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"))
    text = F.coalesce(given.col("text"), F.lit(""))
    keyed = given.df.withColumns({"digest": F.unhex(F.sha2(text.cast("binary"), 256)), "n_bytes": F.octet_length(text).cast("long")})
    long = keyed.where(F.octet_length(text) >= length).select("digest", given.col("text").cast("binary").alias("data"))
    # texts of one row are not shuffled: only those of several rows are, for one of each
    several = Stash(long.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    flagged = long.join(several.side(), "digest", "left")
    once = flagged.where("copies is null").select("digest", F.lit(1).cast("long").alias("copies"), "data")
    first = flagged.where("copies > 1").groupBy("digest").agg(F.first("copies").alias("copies"), F.first("data").alias("data"))
    stored = Stash(once.union(first).select(F.monotonically_increasing_id().alias("tid"), "digest", "copies", "data"), "texts")
    texts = stored.df
    made = Stash(texts.select("tid", "data").mapInPandas(run_rows(length), "tid long, v long, lo int, hi int, at int, times int"), "runs")
    # written before the join, so that the shuffles of counting are gone when those of joining begin
    twice = Stash(made.df.groupBy("v").agg(F.sum("times").alias("n")).where("n > 1").select("v"), "twice")
    kept = Stash(made.df.join(twice.side(grows=True), "v"), "held")
    made.drop()
    by_text = Stash(kept.df.groupBy("tid").agg(F.collect_list(F.struct("v", "lo", "hi", "at", "times")).alias("runs")), "by-text")
    shape = "lead binary, v long, salt long, body binary, times int, tids array<long>, los array<int>"
    bodies = Stash(texts.select("tid", "data").join(by_text.side(grows=True), "tid").mapInPandas(body_rows(length), shape), "bodies")
    kept.drop()
    by_text.drop()
    weight = F.octet_length("body") + 16 * F.size("tids")
    size = bodies.df.agg(F.sum(weight)).first()[0] or 0
    n_buckets = max(1, -(-size // bucket_bytes))
    # a gram of more bytes than a bucket is dealt over as many buckets as its places fill; any other one lies in one
    hot = Stash(bodies.df.groupBy("lead", "v").agg(F.sum(weight).alias("bytes")).where(F.col("bytes") > bucket_bytes).select("lead", "v", F.lit(True).alias("hot")), "hot")
    marked = bodies.df.join(hot.side(), ["lead", "v"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    dealt = marked.repartitionByRange(n_buckets, "lead", "v", F.when(F.col("hot"), F.xxhash64("salt")).otherwise(F.lit(0).cast("long")))
    compared = Stash(dealt.mapInPandas(bucket_rows(length), "digest binary, tid long, lo long, hi long"), "compared")
    bodies.drop()
    hot.drop()
    edges = compared.df.where("digest is not null")
    across = Stash(edges.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "across")
    hits = edges.where("tid is not null").join(across.side(), "digest").select("tid", "lo", "hi")
    spans = Stash(compared.df.where("digest is null").select("tid", "lo", "hi").union(hits).groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    single = texts.where("copies = 1").select("tid", "digest", "data").join(spans.side(grows=True), "tid").select("digest", "data", "spans")
    shape = "digest binary, n_removed long, n_spans long, kept_sha256 string, kept_text string, cut_spans array<struct<start:int,end:int>>"
    cuts = single.mapInPandas(cut, shape)
    whole = texts.where("copies > 1").select("digest", F.octet_length("data").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"), F.lit("").alias("kept_text"), F.array(F.struct(F.lit(0).alias("start"), F.octet_length("data").alias("end"))).alias("cut_spans"))
    found = Stash(cuts.union(whole), "cuts")
    for done in (several, stored, twice, compared, across, spans):
        done.drop()
    out = keyed.join(found.side(grows=True), "digest", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.lit(0).cast("long")
    return out.select(
        *given.back(), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("digest"))).alias("kept_sha256"), F.coalesce("cut_spans", none).alias("spans"), F.coalesce("kept_text", text).alias("kept_text"))
