"""SentencePiece vocabularies: batched Viterbi encoding, decoding, and token counts over a shared trie."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from .substrings import powers

#: Where the default vocabulary file is; a parameter of every operator.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: A run of marks with what follows it; no piece of the default model has a mark behind another character.
RUN = re.compile(f"{SPACE}+[^{SPACE}]*")
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: A byte's piece costs this much below the least score of a piece, so bytes stand only where no piece fits.
BYTE_COST = 10.0
LOWEST = -1e18
#: Code points of words that advance together at most; bounds the memory of a step.
STEP_CHARS = 1 << 16
#: Words of a length that fewer have than this go one by one, which then costs less than steps of numpy; and
#: words longer than LONG are kept out of the trie, which grows with its depth.
FEW_WORDS, LONG = 96, 64


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class Pieces:
    """The pieces of a model file: sorted hashes of the normal ones with their ids and scores, and the
    ids of the byte pieces. A unigram model's scores are its own. Merge ranks are not probabilities,
    so a merge model's piece of rank r scores -ln(r + 2), the law of word frequencies by rank."""

    NORMAL, BYTE = 1, 6

    def __init__(self, data: bytes):
        self.texts: list[str] = []
        self.bytes = np.full(256, -1, np.int64)
        unigram, normal = True, []
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                kind = piece.get(3, self.NORMAL)
                text = piece.get(1, b"").decode()
                if kind == self.BYTE:
                    self.bytes[int(text[1:-1], 16)] = len(self.texts)
                elif kind == self.NORMAL and text:
                    normal.append((len(self.texts), text, float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0])))
                self.texts.append(text)
            elif number == 2:
                unigram = dict(fields(value)).get(3, 1) == 1
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary lacks byte pieces")
        scores = np.array([s if unigram else -math.log(r + 2) for r, (_, _, s) in enumerate(normal)])
        keys = np.array([hash_of(t) for _, t, _ in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.scores = keys[order], scores[order]
        #: The first 20 bits of the keys: most hashes that are none of them need no search.
        self.marked = np.zeros(1 << 20, bool)
        self.marked[self.keys >> np.uint64(44)] = True
        self.ids = np.array([i for i, _, _ in normal], np.int64)[order]
        self.longest = max(len(t) for _, t, _ in normal)
        self.byte_score = float(scores.min()) - BYTE_COST
        #: What each id spells.
        self.spelled = [t.replace(SPACE, " ").encode() for t in self.texts]
        for b, i in enumerate(self.bytes.tolist()):
            self.spelled[i] = bytes([b])
        self.spelled_bytes = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.spelled_count = np.array([len(x) for x in self.spelled], np.int64)
        self.spelled_start = np.cumsum(self.spelled_count) - self.spelled_count
        self.scored = {t: (float(s), i) for (i, t, _), s in zip(normal, scores)}

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per hash the index among the sorted keys, and whether it is there."""
        at, there = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        likely = np.flatnonzero(self.marked[hashes >> np.uint64(44)])
        sought = hashes[likely]
        found = np.minimum(np.searchsorted(self.keys, sought), len(self.keys) - 1)
        at[likely], there[likely] = found, self.keys[found] == sought
        return at, there


_loaded: dict[bytes, Pieces] = {}


def loaded(model: str | bytes) -> Pieces:
    """The pieces of a model file's path or of its bytes, read once a process."""
    if isinstance(model, str):
        with open(model, "rb") as f:
            model = f.read()
    if model not in _loaded:
        _loaded[model] = Pieces(model)
    return _loaded[model]


def shipped(docs: DataFrame, path: str) -> Broadcast[bytes]:
    """The model file, read where the driver runs and sent to the workers, who need no copy of their own."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def coded(chars: np.ndarray) -> np.ndarray:
    """Code points spread over 64 bits, none of them 0."""
    x = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) | np.uint64(1)


def hash_of(text: str) -> int:
    out = 0
    for c in coded(np.array([ord(c) for c in text])).tolist():
        out = (out * int(BASE) + c) & ((1 << 64) - 1)
    return out


def utf8_size(chars: np.ndarray) -> np.ndarray:
    return 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)


def words(text: str | None) -> list[str]:
    """The pre-tokens: what begins at each run of spaces, with the whole run, its spaces written as the piece
    mark. A text is read as if a space stood before it. A mark that the text holds itself becomes code
    point 0xD800, which no text holds and which is spelled in bytes."""
    if not text:
        return []
    return RUN.findall(SPACE + text.replace(SPACE, "\ud800").replace(" ", SPACE))


def viterbi(chars: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The best segmentation of every row of chars, all rows one step at a time: an array of last pieces'
    indexes with a column for each token from a row's end, -1 for a character spelled in bytes and -2 beyond
    its start, and the place that each token ends at. Of equal scores the longest last piece wins."""
    m, n = chars.shape
    span = min(p.longest, n)
    codes = coded(chars.T)
    prefix = np.zeros((n + 1, m), np.uint64)
    for e in range(n):
        prefix[e + 1] = prefix[e] * BASE + codes[e]
    power = powers(int(BASE), p.longest + 1)
    # candidates for an end: the longest piece first, so that the first of equal maxima is the longest; bytes last
    scores = np.full((n + 1, span + 1, m), LOWEST)
    piece = np.full((n + 1, span + 1, m), -1, np.int32)
    for size in range(1, span + 1):
        at, there = p.probe((prefix[size:] - prefix[: n + 1 - size] * power[size]).ravel())
        at, there = at.reshape(-1, m), there.reshape(-1, m)
        scores[size:, span - size] = np.where(there, p.scores[at], LOWEST)
        piece[size:, span - size] = at
    scores[1:, span] = utf8_size(np.where(chars.T == 0xD800, ord(SPACE), chars.T)) * p.byte_score
    best = np.full((span + n + 1, m), 2 * LOWEST)
    best[span] = 0.0
    back, who, rows = np.zeros((n + 1, m), np.int64), np.zeros((n + 1, m), np.int32), np.arange(m)
    for e in range(1, n + 1):
        reached = scores[e]
        reached[:span] += best[e : e + span]
        reached[span] += best[e + span - 1]
        top = reached.argmax(axis=0)
        best[e + span] = reached[top, rows]
        back[e] = np.minimum(top, span - 1) - span
        who[e] = piece[e, top, rows]
    tokens, ends, at = [], [], np.full(m, n)
    while at.any():
        tokens.append(np.where(at > 0, who[at, rows], -2))
        ends.append(at)
        at = np.where(at > 0, at + back[at, rows], 0)
    return np.array(tokens[::-1]).T, np.array(ends[::-1]).T


def viterbi_of_one(word: str, p: Pieces) -> list[int]:
    """Ids of the best segmentation of one word of any length, by the same rules, a character at a time."""
    best, back = [0.0], [0]
    sizes = [len((SPACE if c == "\ud800" else c).encode()) for c in word]
    for e in range(1, len(word) + 1):
        top, size_of = best[e - 1] + sizes[e - 1] * p.byte_score, 0
        for size in range(1, min(p.longest, e) + 1):
            known = p.scored.get(word[e - size : e])
            if known is not None and best[e - size] + known[0] >= top:
                top, size_of = best[e - size] + known[0], size
        best.append(top)
        back.append(size_of)
    ids, e = [], len(word)
    while e:
        if back[e]:
            ids.append(p.scored[word[e - back[e] : e]][1])
        else:
            ids.extend(int(p.bytes[b]) for b in reversed((SPACE if word[e - 1] == "\ud800" else word[e - 1]).encode()))
        e -= back[e] or 1
    return ids[::-1]


class Words:
    """The pre-tokens of some texts, as words() cuts them, and the distinct ones among them."""

    def __init__(self, texts: list[str | None]):
        self.joined = "".join([" " + t for t in texts if t])
        self.chars = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), "<u4").copy()
        n = len(self.chars)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        space = self.chars == 32
        self.chars[self.chars == ord(SPACE)] = 0xD800
        self.chars[space] = ord(SPACE)
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[starts[sizes > 0]] = True
        self.at = np.flatnonzero(begin)
        self.lengths = np.diff(self.at, append=n)
        #: The words of each text are those from one of these numbers to the next.
        self.bounds = np.searchsorted(self.at, np.append(starts, n))
        if not len(self.at):
            self.first, self.of = np.empty(0, np.int64), np.empty(0, np.int64)
            return
        place = np.arange(n) - np.repeat(self.at, self.lengths)
        hashes = np.add.reduceat(coded(self.chars) * powers(int(BASE), int(self.lengths.max()))[place], self.at)
        _, self.first, self.of = np.unique(hashes, return_index=True, return_inverse=True)
        # words of one hash that are not the same become distinct ones of their own
        model = self.first[self.of]
        same = self.lengths == self.lengths[model]
        whole = np.repeat(same, self.lengths)
        unlike = np.flatnonzero(whole)[self.chars[whole] != self.chars[(np.repeat(self.at[model], self.lengths) + place)[whole]]]
        same[np.searchsorted(self.at, unlike, side="right") - 1] = False
        if not same.all():
            odd = np.flatnonzero(~same)
            self.of[odd] = len(self.first) + np.arange(len(odd))
            self.first = np.concatenate([self.first, odd])

    def word(self, i: int) -> str:
        """The distinct word i, its spaces as marks."""
        at = self.at[self.first[i]]
        return self.chars[at : at + self.lengths[self.first[i]]].tobytes().decode("utf-32-le", "surrogatepass")


def literal_bytes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of code points, joined, and how many each has."""
    text = "".join(SPACE if c == 0xD800 else chr(c) for c in points.tolist()).encode()
    return np.frombuffer(text, np.uint8), utf8_size(np.where(points == 0xD800, ord(SPACE), points))


def encode_words(words: Words, p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the distinct words, joined in an order of their own; where each word's begin, and how many they are."""
    lengths = words.lengths[words.first]
    start, count = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made, total = [], 0
    order = np.argsort(lengths, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []
    for group in groups:
        n = int(lengths[group[0]])
        if len(group) < FEW_WORDS:
            found = [viterbi_of_one(words.word(i), p) for i in group.tolist()]
            count[group] = [len(x) for x in found]
            made.append(np.array([i for x in found for i in x], np.int32))
            start[group] = total + np.cumsum(count[group]) - count[group]
            total += len(made[-1])
            continue
        step = max(1, STEP_CHARS // n)
        for first in range(0, len(group), step):
            part = group[first : first + step]
            chars = words.chars[words.at[words.first[part]][:, None] + np.arange(n)]
            tokens, ends = viterbi(chars, p)
            there = tokens != -2
            flat, literal = tokens[there], tokens[there] == -1
            ids = np.where(literal, 0, p.ids[flat]).astype(np.int32)
            sizes = np.ones(len(flat), np.int64)
            if literal.any():
                spelled, sizes[literal] = literal_bytes(chars[np.nonzero(there)[0][literal], ends[there][literal] - 1])
                ids = np.repeat(ids, sizes)
                ids[np.repeat(literal, sizes)] = p.bytes[spelled]
            count[part] = np.bincount(np.nonzero(there)[0], weights=sizes, minlength=len(part)).astype(np.int64)
            start[part] = total + np.cumsum(count[part]) - count[part]
            made.append(ids)
            total += len(ids)
    return np.concatenate(made) if made else np.empty(0, np.int32), start, count


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then those of start[1], and so on."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def decode(ids, p: Pieces) -> str:
    """The text that the ids spell: bytes and pieces joined, marks as spaces, the first space dropped."""
    return b"".join(map(p.spelled.__getitem__, ids)).decode("utf-8", "replace")[1:]


def decode_joined(ids: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that the ids spell, and how many each spells."""
    count = p.spelled_count[ids]
    return p.spelled_bytes[spread(p.spelled_start[ids], count)], count


def encode_texts(texts: list[str | None], p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the texts, joined; the bounds of each text's among them; and whether they spell the text."""
    words = Words(texts)
    made, start, count = encode_words(words, p)
    per_word = count[words.of]
    ids = made[spread(start[words.of], per_word)]
    bounds = np.concatenate([[0], np.cumsum(per_word)])[words.bounds]
    said, sizes = decode_joined(ids, p)
    want = np.frombuffer(words.joined.encode("utf-8", "surrogatepass"), np.uint8)
    if len(said) == len(want) and (said == want).all():
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        exact = np.diff(ends) == np.array([len(t.encode("utf-8", "surrogatepass")) + 1 if t else 0 for t in texts], np.int64)
    else:
        exact = np.array([decode(ids[a:b].tolist(), p) == (t or "") for t, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist())])
    return ids, bounds, exact


def parts(batches: Iterator[pa.RecordBatch], size: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Consecutive rows of the batches whose texts have about so many bytes, one row at least, with the texts."""
    for batch in batches:
        text = batch.column("text")
        part = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a), text.slice(a, b - a).to_pylist()


def with_columns(batch: pa.RecordBatch, more: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Encode whole texts by the best segmentation under the piece scores, and decode them again.

    docs: text and any other columns. Returned: those columns, ids array<int>, n_tokens long and
    round_trip, which says that decoding the ids gives the text. Text is cut before each run of spaces, which
    loses nothing where, as in the default model, pieces have marks at their start only. A word's
    segmentation has the largest sum of piece scores, of equal sums that with the longest last piece; what
    no piece covers is spelled in byte pieces. The distinct words of about 2 MB of texts advance together by
    length; words of a length that few have go one by one, by the same rules, so that an unbroken word of
    a million characters takes seconds. A text is held whole by one task.

    A null or empty text has no ids. Repeated rows are each encoded. Columns with the names returned are
    replaced; others may have any name. An empty table gives no rows.
    """
    base, sent = docs.drop("ids", "n_tokens", "round_trip"), shipped(docs, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = loaded(sent.value)
        for part, texts in parts(batches):
            ids, bounds, exact = encode_texts(texts, p)
            yield with_columns(part, {"ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())), "n_tokens": pa.array(np.diff(bounds), pa.int64()), "round_trip": pa.array(exact, pa.bool_())})

    shape = StructType([*base.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("round_trip", BooleanType())])
    return base.mapInArrow(work, shape)


def trie_counts(distinct: list[str], p: Pieces) -> dict[str, int]:
    """Tokens by word. The words' prefixes form a trie, built level by level; a node's best score and
    its number of tokens are computed once from its ancestors, and read at the nodes where words end."""
    order = sorted(distinct)
    alive = np.arange(len(order))
    lengths = np.array([len(w) for w in order], np.int64)
    flat = np.frombuffer("".join(order).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    node = np.zeros(len(order), np.int64)
    power = powers(int(BASE), p.longest + 1)
    # of the last levels, nearest last: parent within the level before, hash, score, tokens
    levels = [(np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1), np.zeros(1, np.int64))]
    out = np.zeros(len(order), np.int64)
    depth = 0
    while len(alive):
        alive = alive[lengths[alive] > depth]
        if not len(alive):
            break
        chars = flat[starts[alive] + depth]
        above = node[alive]
        # sorted words: those that share a prefix stand together
        new = np.ones(len(alive), bool)
        new[1:] = (above[1:] != above[:-1]) | (chars[1:] != chars[:-1])
        node[alive] = np.cumsum(new) - 1
        parent, char = above[new], chars[new]
        hashes = levels[-1][1][parent] * BASE + coded(char)
        size_of = utf8_size(np.where(char == 0xD800, ord(SPACE), char))
        top = levels[-1][2][parent] + size_of * p.byte_score
        count = levels[-1][3][parent] + size_of
        ancestor = parent
        for size in range(1, min(p.longest, depth + 1) + 1):
            level = levels[-size]
            at, there = p.probe(hashes - level[1][ancestor] * power[size])
            score = np.where(there, level[2][ancestor] + p.scores[at], LOWEST)
            better = score >= top
            top, count = np.where(better, score, top), np.where(better, level[3][ancestor] + 1, count)
            ancestor = level[0][ancestor]
        levels = [*levels[-p.longest :], (parent, hashes, top, count)]
        depth += 1
        done = alive[lengths[alive] == depth]
        out[done] = count[node[done]]
    return dict(zip(order, out.tolist()))


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Count each whole text's tokens, without writing them: as many as encode() gives.

    docs: text and any other columns. Returned: those columns, n_words long (pre-tokens) and n_tokens
    long. A null or empty text has none. Repeated rows are each counted. Columns with the names returned
    are replaced. An empty table gives no rows.
    """
    base, sent = docs.drop("n_words", "n_tokens"), shipped(docs, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = loaded(sent.value)
        for part, texts in parts(batches):
            words = Words(texts)
            distinct = [words.word(i) for i in range(len(words.first))]
            counts = trie_counts([w for w in distinct if len(w) <= LONG], p)
            each = np.array([counts[w] if len(w) <= LONG else len(viterbi_of_one(w, p)) for w in distinct], np.int64)
            sums = np.concatenate([[0], np.cumsum(each[words.of])])[words.bounds]
            yield with_columns(part, {"n_words": pa.array(np.diff(words.bounds), pa.int64()), "n_tokens": pa.array(np.diff(sums), pa.int64())})

    return base.mapInArrow(work, StructType([*base.schema.fields, StructField("n_words", LongType()), StructField("n_tokens", LongType())]))
