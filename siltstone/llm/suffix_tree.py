"""Operator 7: language-model scoring by a probabilistic suffix tree over words.

States are contexts of up to ``depth`` preceding words that occur FREQUENT times or more. A next word stays in a state
if its count there diverges from what the parent state expects, a state stays if all that it says diverges enough;
everything else is passed to the parent. What a state's words leave is shared by two classes, frequent words (FREQUENT
or more) and all others, each in proportion to the parent's probabilities, and counts are smoothed by the parent as
prior; so every state is a distribution.

With P(w|s) = P(w|parent) * b(s, class) * d(s, w), d = 1 where the state doesn't hold w, the log probability of a text
is a sum of table entries: log P0(w), log b(s, class) and log d(s, w) over the states along the suffix. Words, states
and d all grow with the corpus. Words are told by 64-bit hashes that no pattern of letters makes agree: of V different
words any two agree with odds of V^2 / 2^65. The most used words and states of each level (a fixed number, the frame) have small
numbers and go to every executor; the others are named by hashes, told by a sketch or joined. The same holds for the
entries: the most used are sent, the rest is joined. What is sent changes costs, not the model.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SKETCH_BITS, hash_words, in_sketch, keep, materialize, materialize_parts, mix64, most_used, release, sketch, text_groups

END = np.uint64(0x5EED0E4D)
#: Least number of occurrences of a frequent word and of a state, whatever the corpus.
FREQUENT = 32
#: Counts and gain (nats) that keep a word in a state; gain that keeps a state, and what each of its words costs.
WORD_COUNT, WORD_GAIN, STATE_GAIN, WORD_COST = 4, 10.0, 20.0, 5.0
#: Words of the longest contexts.
DEPTH = 3
#: Weight of the parent as a prior.
PRIOR = 20.0
#: Entries sent to every executor (16 bytes each), and words, or states of a level.
HEAD, FRAME = 400_000, 1_000_000
#: Ids from here on are hashes: of words and states outside the frame.
OUTSIDE = 1 << 62
#: Rows up to which a table of words or states is broadcast for a join.
SENT_ROWS = 200_000
#: Events that a task counts together.
COUNTED = 2_000_000
TAIL_BITS = 1 << 28
#: Entries that aren't sent are looked up in so many passes at most, each of so many lookups at least: what a pass has
#: shuffled goes before the next.
PASSES, LOOKUPS = 8, 4_000_000
#: Events that a group of counts has, and entries that a group of lookups has, on average; a task holds one group.
EVENTS_OF_GROUP, ENTRIES_OF_GROUP = 1_000_000, 1 << 18


def tokens(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, its text, its place there): words with A-Z lower-cased, then an end."""
    h, bounds = hash_words(parts, lower=True)
    n = np.diff(bounds) + 1
    row = np.repeat(np.arange(len(parts)), n)
    starts = np.cumsum(n) - n
    place = np.arange(len(row)) - starts[row]
    t = np.full(len(row), END)
    t[place < n[row] - 1] = h
    return t, row, place


class Index:
    """Positions of 64-bit keys by open addressing on arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(10, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int32)
        self.keys = np.append(keys, np.uint64(0))
        at, todo = (mix64(keys) >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = todo[self.slot[at[todo]] < 0]
            self.slot[at[free]] = free
            todo = todo[self.slot[at[todo]] != todo]
            at[todo] = at[todo] + 1 & self.mask

    def find(self, k: np.ndarray) -> np.ndarray:
        at = (mix64(k) >> self.shift).astype(np.int64)
        out = self.slot[at].astype(np.int64)
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != k))
        while len(todo):
            at[todo] = at[todo] + 1 & self.mask
            out[todo] = self.slot[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[out[todo]] != k[todo])]
        return out


_indexes: dict[str, Index] = {}


def _index(name: str, keys: np.ndarray) -> Index:
    """The worker's index of some keys that are sent; those of another model go."""
    if name not in _indexes:
        for old in [k for k in _indexes if k.split("/")[0] != name.split("/")[0]]:
            del _indexes[old]
        _indexes[name] = Index(keys)
    keep("indexes", _indexes.clear)
    return _indexes[name]


def _counts(held: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """The different events' columns, and how often each occurs."""
    cols = [np.concatenate(x) for x in zip(*held, strict=True)]
    if len(cols) == 1:
        return list(np.unique(cols[0], return_counts=True))
    if max(int(x.max(initial=0)) for x in cols) < 1 << 31:
        u, n = np.unique(cols[0] << 32 | cols[1], return_counts=True)
        return [u >> 32, u & 0xFFFFFFFF, n]
    _, at, n = np.unique(pair(0, *cols), return_index=True, return_counts=True)
    return [*(x[at] for x in cols), n]


def _portions(events: Iterator[tuple[np.ndarray, ...]]) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """Events in lists of COUNTED or so."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for x in events:
        held.append(x)
        size += len(x[0])
        if size > COUNTED:
            yield held
            held, size = [], 0
    if held:
        yield held


def _counted(events: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The events' columns and c: counts of equal events, passed on in portions."""
    for held in _portions(events):
        *out, n = _counts(held)
        yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in out), pa.array(n)], names=[*names, "c"])


#: Rows of a group (or of documents from that row on), packed.
PACKED = pa.schema([("g", pa.int64()), ("n", pa.int64()), ("packed", pa.binary())])


def pack(*cols: np.ndarray, differences: bool = True) -> bytes:
    """Columns of 64-bit numbers without the bytes that are zero in all rows, byte by byte and compressed; the first,
    best a sorted one, by differences."""
    widths, planes = [], []
    for k, x in enumerate(cols):
        x = np.ascontiguousarray(x).view(np.uint64)
        if differences and not k:
            x = np.diff(x, prepend=np.uint64(0))
        widths.append((int(x.max(initial=0)).bit_length() + 7) // 8)
        planes.append(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, : widths[-1]].T.tobytes())
    return bytes(widths) + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpack(n: int, packed: bytes, cols: int, differences: bool = True) -> list[np.ndarray]:
    """The columns (unsigned) of ``n`` rows that ``pack`` made."""
    widths = packed[:cols]
    raw, at, out = np.frombuffer(pa.decompress(packed[cols:], n * sum(widths), codec="zstd"), np.uint8), 0, []
    for k, w in enumerate(widths):
        x = np.zeros((n, 8), np.uint8)
        x[:, :w] = raw[at : at + n * w].reshape(w, n).T
        at += n * w
        x = x.view("<u8").ravel()
        out.append(np.cumsum(x, dtype=np.uint64) if differences and not k else x)
    return out


def _dealt(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each group with the places of its rows, in their order."""
    size = np.bincount(group)
    order = np.argsort(group.astype(np.uint16) if len(size) <= 1 << 16 else group, kind="stable")
    ends = np.cumsum(size)
    for g in np.flatnonzero(size).tolist():
        yield g, order[ends[g] - size[g] : ends[g]]


def _dealt_counts(events: Iterator[tuple[np.ndarray, np.ndarray]], groups: int) -> Iterator[pa.RecordBatch]:
    """Counts of equal events (s, w), packed for each of ``groups`` groups: g, n, packed (s, w, c)."""
    for held in _portions(events):
        s, w, c = _counts(held)
        group = (pair(0, s, w) % np.uint64(groups)).astype(np.int64)
        yield pa.RecordBatch.from_pylist([{"g": g, "n": len(at), "packed": pack(s[at], w[at], c[at])} for g, at in _dealt(group)], PACKED)


def _adder(least: int, always: int, often: Broadcast | None = None, z: int = 0) -> Callable[[pa.Table], pa.Table]:
    """The sums of a group's counts: of ``least`` or more, or of the word ``always``. ``often``: how often each frequent
    word occurs; states are words then, and what they can't keep, nor is a state with its word, is left out."""

    def added(packed: pa.Table) -> pa.Table:
        rows = zip(packed.column("n").to_pylist(), packed.column("packed").to_pylist(), strict=True)
        s, w, c = (np.concatenate(x).view(np.int64) for x in zip(*(unpack(n, x, 3) for n, x in rows), strict=True))
        order = np.argsort(s << 32 | w) if max(s.max(), w.max()) < 1 << 31 else np.lexsort((w, s))
        s, w = s[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (w[1:] != w[:-1])]))
        s, w, c = s[first], w[first], np.add.reduceat(c[order], first)
        stay = (c >= least) | (w == always)
        if often is not None:
            at = np.flatnonzero(stay & (w != always) & (c < FREQUENT))
            n, p = often.value[s[at]], (often.value[w[at]] + 1) / z
            stay[at[c[at] * np.log(c[at] / (n * p)) < WORD_GAIN - 1e-6]] = False
        return pa.table({"s": s[stay], "w": w[stay], "c": c[stay]})

    return added


def pair(salt: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of two ids."""
    return mix64(mix64(a.astype(np.uint64) + np.uint64(salt << 40)) + b.astype(np.uint64))


def outside(h: np.ndarray) -> np.ndarray:
    """The id of a word or state outside the frame, from its hash."""
    return (h >> np.uint64(2) | np.uint64(OUTSIDE)).astype(np.int64)


class Frame:
    """What every executor holds of a model: the most used frequent words' hashes, and for each depth beyond the first
    the most used states' (hashes of the state of all but the last word, and the last word). ``others``: for words, then
    for each of these depths, what tells those outside: False (there are none), a sketch of their ids, or None (any)."""

    def __init__(self, words: np.ndarray):
        self.name, self.words, self.longer, self.others = uuid.uuid4().hex, words, [], [False]

    def numbers(self, t: np.ndarray) -> np.ndarray:
        """Each token's number; that behind the last for all that aren't frequent; an id for those that may be."""
        at = _index(f"{self.name}/0", self.words).find(t)
        return self._or_outside(0, at, t, np.int64(len(self.words)))

    def _or_outside(self, k: int, at: np.ndarray, h: np.ndarray, none: np.int64) -> np.ndarray:
        lost = np.flatnonzero(at < 0)
        at[lost] = none
        if self.others[k] is not False:
            ids = outside(h[lost])
            if self.others[k] is not None:
                there = in_sketch(self.others[k], ids)
                lost, ids = lost[there], ids[there]
            at[lost] = ids
        return at

    def longer_states(self, level: int, shorter: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The states of ``level`` words: of a state of one word less, followed by a word; or -1."""
        h = pair(level, shorter, last)
        return self._or_outside(level - 1, _index(f"{self.name}/{level}", self.longer[level - 2]).find(h), h, np.int64(-1))

    def states(self, number: np.ndarray, t: np.ndarray, place: np.ndarray, depth: int) -> list[np.ndarray]:
        """For each depth the state of the words before each token, or -1."""
        before = np.roll(number, 1)
        out = [np.where((place >= 1) & (before != len(self.words)) & (np.roll(t, 1) != END), before, -1)]
        for level in range(2, depth + 1):
            shorter = np.roll(out[-1], 1)
            ok = (place >= level) & (shorter >= 0) & (out[0] >= 0)
            at = np.full(len(t), -1, np.int64)
            at[ok] = self.longer_states(level, shorter[ok], before[ok])
            out.append(at)
        return out


class Tree:
    """The fitted model: ``entries`` (key, kind, value, weight; kind 0: a word, 1: a state's class, 2: a state's word),
    the number of training tokens and of distinct ones, the frame, of each depth's states in the frame log10 b for
    frequent and other words (0 for states that aren't kept) and whether they are kept, and ids of words outside."""

    def __init__(self, spark: SparkSession, entries: DataFrame, n: int, v: int, frame: Frame, shares: list[tuple[np.ndarray, np.ndarray, np.ndarray]], others: DataFrame):
        self.spark, self.entries, self.n, self.v, self.frame, self.shares, self.others = spark, entries, n, v, frame, shares, others

    @property
    def depth(self) -> int:
        return len(self.shares)


def word_keys(level: int, state: np.ndarray, number: np.ndarray) -> np.ndarray:
    return pair(1000 + level, state, number)


def class_keys(level: int, state: np.ndarray, frequent: bool) -> np.ndarray:
    return pair(500_000 + 2 * level + frequent, state, np.zeros(len(state), np.int64))


def _told(ids: DataFrame) -> np.ndarray | None:
    return sketch(ids, bits=TAIL_BITS if ids.count() > SKETCH_BITS // 16 else SKETCH_BITS)


def fit(train: DataFrame, depth: int = DEPTH, frame_size: int = FRAME, *, text_col: str = "text") -> Tree:
    """Fit on all texts of ``train``; a null text is empty and counts one end."""
    spark = train.sparkSession
    d = train.select(F.col(text_col).alias("text"))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for b in batches:
            for _, _, parts in text_groups(b.column(0)):
                yield tokens(parts)

    unigrams = materialize(d.mapInArrow(lambda it: _counted(((t,) for t, _, _ in groups(it)), ["e"]), "e long, c long").groupBy("e").agg(F.sum("c").alias("c")), "unigrams")
    n, v = (int(x or 0) for x in unigrams.agg(F.sum("c"), F.count("*")).first())
    z = n + v + 1
    often = unigrams.where(F.col("c") >= FREQUENT)
    n_often, p_often = often.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    top = (often if n_often <= frame_size else often.where(most_used(often, "c", frame_size))).toArrow()
    words, counts = top.column("e").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    frame, rare_number = Frame(words), len(words)
    rare = float(np.log(max(1 - (p_often + n_often) / z, 1e-12)))
    known = spark.createDataFrame(pa.table({"w": pa.array(np.arange(rare_number)), "e": pa.array(words.view(np.int64)), "c": pa.array(counts)}))
    others = often.join(known.select("e"), "e", "left_anti").select(F.shiftrightunsigned("e", 2).bitwiseOR(F.lit(OUTSIDE)).alias("w"), "e", "c")
    if n_often > rare_number:
        others = materialize(others, "words-outside")
        frame.others[0] = _told(others.select("w"))
        known = known.union(others)
    known = materialize(known.withColumn("p0", F.log((F.col("c") + 1) / F.lit(float(z)))), "words")
    near = lambda df, rows: F.broadcast(df) if rows <= SENT_ROWS else df
    tenth = float(np.log(10))
    entries = unigrams.select(F.col("e").alias("key"), F.lit(0).alias("kind"), F.log10(F.col("c") + 1).alias("value"), F.col("c").alias("weight"))
    shares: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held: list[DataFrame] = []  # of each level: anc_<level>, w, d
    last: list[DataFrame] = []  # what the entries are made of
    # of the level's states: how often they occur, log b of all their ancestors, and the ancestors level by level
    end = int(END.view(np.int64))
    states = known.where(F.col("e") != end).select(F.col("w").alias("s"), F.col("c").alias("n"), F.lit(0.0).alias("base_f"), F.lit(0.0).alias("base_r"))
    ending = F.col("w").isin([int(x) for x in np.flatnonzero(words == END)] or [int(outside(np.array([END]))[0])])
    n_states, n_framed = n_often, rare_number
    for level in range(1, depth + 1):
        sent = spark.sparkContext.broadcast(frame)

        def events(batches: Iterator[pa.RecordBatch], level: int = level, sent=sent, groups_of: int = 1 + n // EVENTS_OF_GROUP) -> Iterator[pa.RecordBatch]:
            def found() -> Iterator[tuple[np.ndarray, ...]]:
                f = sent.value
                for t, _, place in groups(batches):
                    number = f.numbers(t)
                    s = f.states(number, t, place, level)[-1]
                    yield s[s >= 0], number[s >= 0]

            return _dealt_counts(found(), groups_of)

        least = WORD_COUNT if frame.others[0] is False else 1
        often_sent = spark.sparkContext.broadcast(counts) if level == 1 and frame.others[0] is False else None
        seen = d.mapInArrow(events, "g long, n long, packed binary").groupBy("g").applyInArrow(_adder(least, rare_number, often_sent, z), "s long, w long, c long")
        if frame.others[0] is not False:  # words that the sketch takes wrongly for frequent ones
            seen = seen.join(others.select("w", F.lit(True).alias("is")), "w", "left")
            seen = seen.withColumn("w", F.when((F.col("w") >= OUTSIDE) & F.col("is").isNull(), rare_number).otherwise(F.col("w"))).groupBy("s", "w").agg(F.sum("c").alias("c"))
        # what can't stay in a state is told by its total
        seen = materialize(seen.where((F.col("c") >= WORD_COUNT) | (F.col("w") == rare_number)), "events")
        e = seen.where(F.col("w") != rare_number).join(near(states, n_states), "s").join(near(known.select("w", "p0"), n_often), "w")
        p = F.col("p0") + F.col("base_f")
        for i, h in enumerate(held):
            e = e.join(h, [f"anc_{i + 1}", "w"], "left")
            p = p + F.coalesce(f"d_{i + 1}", F.lit(0.0))
        e = e.withColumn("p", p).where(F.col("c") * (F.log(F.col("c") / F.col("n")) - F.col("p")) >= WORD_GAIN)
        e = materialize(e.select("s", "w", "c", "n", "p"), "stays")
        own = F.log((F.col("c") + PRIOR * F.exp("p")) / (F.col("n") + PRIOR)) - F.col("p")
        sums = e.groupBy("s").agg(F.sum("c").alias("c"), F.sum(F.exp("p")).alias("q"), F.count("*").alias("k"), F.sum(F.col("c") * own).alias("g"))
        rest = seen.where(F.col("w") == rare_number).select("s", F.col("c").alias("r"))
        st = states.join(sums, "s", "left").join(rest, "s", "left").na.fill(0, ["c", "q", "k", "g", "r"])
        p_rare = F.exp(F.lit(rare) + F.col("base_r"))
        st = st.withColumns({"p_rare": p_rare, "others": F.col("n") - F.col("c") - F.col("r"), "p_others": F.greatest(1 - F.col("q") - p_rare, F.lit(1e-9))})
        share = lambda c, p: F.log((F.col(c) + PRIOR * F.col(p)) / ((F.col("n") + PRIOR) * F.col(p)))
        st = st.withColumns({"bf": share("others", "p_others"), "br": share("r", "p_rare")})
        st = st.withColumn("kept", F.col("g") + F.col("others") * F.col("bf") + F.col("r") * F.col("br") >= STATE_GAIN + WORD_COST * F.col("k"))
        st = materialize(st.drop("c", "q", "k", "g", "r", "p_rare", "others", "p_others"), "states")
        release(states)
        kept = st.where("kept")
        framed = kept.where(F.col("s") < OUTSIDE).select("s", "bf", "br").toArrow()  # frame_size rows at most
        at = framed.column("s").to_numpy()
        bf, br, is_kept = np.zeros(n_framed), np.zeros(n_framed), np.zeros(n_framed, bool)
        bf[at], br[at], is_kept[at] = framed.column("bf").to_numpy() / tenth, framed.column("br").to_numpy() / tenth, True
        shares.append((bf, br, is_kept))
        mine = materialize(e.join(near(kept.select("s", "bf"), n_states), "s").select("s", "w", (own - F.col("bf")).alias("d"), "c"), "words-of-states")
        release(e)
        last += [mine, st]
        held.append(mine.select(F.col("s").alias(f"anc_{level}"), "w", F.col("d").alias(f"d_{level}")))
        names = ["key", "kind", "value", "weight"]

        def keyed(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key = word_keys(level, b.column(0).to_numpy(), b.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), 2, np.int32)), pa.array(b.column(2).to_numpy() / tenth), b.column(3)], names=names)

        def classes(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for frequent in (False, True):
                    key = class_keys(level, b.column(0).to_numpy(), frequent)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), 1, np.int32)), pa.array(b.column(1 + frequent).to_numpy() / tenth), b.column(3)], names=names)

        schema = "key long, kind int, value double, weight long"
        entries = entries.union(mine.mapInArrow(keyed, schema))
        if frame.others[0] is not False or frame.others[level - 1] is not False:
            entries = entries.union(kept.select("s", "br", "bf", "n").mapInArrow(classes, schema))
        if level < depth:
            # a longer state (s, w); its parent is (s without its first word, w)
            more = seen.where((F.col("c") >= FREQUENT) & (F.col("w") != rare_number) & ~ending)
            more = more.join(near(st.select("s", F.col(f"anc_{level - 1}" if level > 1 else "s").alias("short")), n_states), "s").select("s", "w", "c", "short")

            def grown(batches: Iterator[pa.RecordBatch], level: int = level, sent=sent) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    s, w, short = (b.column(i).to_numpy() for i in (0, 1, 3))
                    par = w if level == 1 else sent.value.longer_states(level, short, w)
                    yield pa.RecordBatch.from_arrays([pa.array(pair(level + 1, s, w).view(np.int64)), b.column(2), pa.array(par)], names=["h", "n", "par"])

            more = written = materialize(more.mapInArrow(grown, "h long, n long, par long"), "longer")
            n_states = more.count()
            top = (more if n_states <= frame_size else more.where(most_used(more, "n", frame_size))).select("h").toArrow().column("h").to_numpy()
            n_framed = len(top)
            frame.longer.append(top.view(np.uint64))
            named = spark.createDataFrame(pa.table({"h": pa.array(top), "at": pa.array(np.arange(n_framed))}))
            more = more.join(near(named, n_framed), "h", "left").select(F.coalesce("at", F.shiftrightunsigned("h", 2).bitwiseOR(F.lit(OUTSIDE))).alias("s"), "n", "par")
            b = lambda c: F.col(f"base_{c[1]}") + F.when(F.col("kept"), F.col(c)).otherwise(0.0)
            above = st.select(F.col("s").alias("par"), b("bf").alias("base_f"), b("br").alias("base_r"), *(f"anc_{i}" for i in range(1, level)))
            states = materialize(more.join(above, "par").withColumnRenamed("par", f"anc_{level}"), "next-states")
            release(written)
            frame.others.append(False if n_states <= n_framed else _told(states.where(F.col("s") >= OUTSIDE).select("s")))
        release(seen)
        sent.destroy()
        if often_sent is not None:
            often_sent.destroy()
    entries = materialize(entries, "entries")
    release(*last)
    return Tree(spark, entries, n, v, frame, shares, others)


def score(docs: DataFrame, tree: Tree, head: int = HEAD, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, n_known, base_score and score (log10); null texts are empty, an end only.

    Repeated rows and ids, also null ones, are scored each on their own.
    """
    spark = docs.sparkSession
    used = most_used(tree.entries, "weight", head)
    top = tree.entries.where(used).toArrow()
    keys, kind, value = (top.column(c).to_numpy() for c in ("key", "kind", "value"))
    tail = tree.entries.where(~used).select("key", "kind", "value")
    bits = _told(tail.select("key"))
    # a sketch with few bits set is sent small: driver and executors keep what is sent on their disks
    bits = None if bits is None else (bits.nbytes, pa.compress(bits, codec="zstd", asbytes=True))
    sent = spark.sparkContext.broadcast((keys.view(np.uint64), kind, value, bits, tree.frame, tree.shares))
    floor, depth = float(np.log10(tree.n + tree.v + 1)), tree.depth
    groups = PASSES * (1 + tail.count() // (PASSES * ENTRIES_OF_GROUP))
    fields = [("rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    fields += [("doubt", pa.list_(pa.struct([("w", pa.int64()), ("f", pa.int64()), ("r", pa.int64())])))]
    # lookups of documents from rid on: a group's different keys (n) with how often each is asked, and who asks (m)
    fields += [("g", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("keys", pa.binary()), ("who", pa.binary())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, kind, value, bits, frame, shares = sent.value
        bits = None if bits is None else np.frombuffer(pa.decompress(bits[1], bits[0], codec="zstd"), np.uint64)
        index, rid = _index(f"{frame.name}/head{len(keys)}", keys), TaskContext.get().partitionId() << 40
        value, word = np.append(value, 0.0), np.append(kind == 0, False)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        first, size = rid, 0  # of the lookups held

        def look(k: np.ndarray, row: np.ndarray, m: int, rest: list) -> tuple[np.ndarray, np.ndarray]:
            at = index.find(k)
            lost = np.flatnonzero(at < 0)
            if bits is not None:
                lost = lost[in_sketch(bits, k[lost].view(np.int64))]
            rest.append((row[lost], k[lost]))
            return np.bincount(row, weights=value[at], minlength=m), np.bincount(row, weights=word[at], minlength=m)

        def lookups() -> Iterator[pa.RecordBatch]:
            who, what = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(what)
            u, n = np.unique(what, return_counts=True)
            who, ends = who[order], np.cumsum(n)
            rows = []
            for g, at in _dealt(_group_of(u, groups)):
                m = n[at]
                asking = np.repeat(ends[at] - np.cumsum(m), m) + np.arange(m.sum())
                rows.append({"rid": first, "g": g, "n": len(at), "m": len(asking), "keys": pack(u[at], m), "who": pack(who[asking], differences=False)})
            held.clear()
            yield pa.RecordBatch.from_pylist(rows, schema)

        for b in batches:
            for s, e, parts in text_groups(b.column(1)):
                t, row, place = tokens(parts)
                m, rest, doubt = e - s, [], [(np.zeros(0, np.int64),) * 4]
                base, known = look(t, row, m, rest)
                base -= np.bincount(row, minlength=m) * floor
                total = base.copy()
                number = frame.numbers(t)
                for level, st in enumerate(frame.states(number, t, place, depth), 1):
                    bf, br, kept = shares[level - 1]
                    here = np.flatnonzero(st >= 0)
                    framed = st[here] < OUTSIDE
                    framed[framed] = kept[st[here[framed]]]
                    here = here[framed | (st[here] >= OUTSIDE)]
                    x, w, r = st[here], number[here], row[here]
                    rare, unsure = w == len(frame.words), w >= OUTSIDE
                    f = (x < OUTSIDE) & ~unsure
                    total += np.bincount(r[f], weights=np.where(rare[f], br[x[f]], bf[x[f]]), minlength=m)
                    for frequent in (False, True):
                        f = (x >= OUTSIDE) & ~unsure & (rare != frequent)
                        if f.any():
                            total += look(class_keys(level, x[f], frequent), r[f], m, rest)[0]
                    if unsure.any():  # a word outside the frame: a join tells its class
                        doubt.append((r[unsure], w[unsure], *(class_keys(level, x[unsure], c).view(np.int64) for c in (True, False))))
                    total += look(word_keys(level, x[~rare], w[~rare]), r[~rare], m, rest)[0]
                held += [(x + (rid - first), k) for x, k in rest]
                size += sum(len(x) for x, _ in rest)
                r, *said = (np.concatenate(c) for c in zip(*doubt, strict=True))
                order = np.argsort(r, kind="stable")
                cuts = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=m))])
                doubts = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(c[order]) for c in said], names=["w", "f", "r"]))
                cols = [pa.array(rid + np.arange(m)), b.column(0).slice(s, m), pa.array(np.bincount(row, minlength=m)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(total), doubts]
                rid += m
                yield pa.RecordBatch.from_arrays(cols + [pa.nulls(m, f.type) for f in schema][len(cols) :], schema=schema)
                if size > COUNTED:
                    yield from lookups()
                    first, size = rid, 0
        if held:
            yield from lookups()

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = d.mapInArrow(run, "rid long, doc_id long, n_tokens long, n_known long, base_score double, score double, doubt array<struct<w:long,f:long,r:long>>, g long, n long, m long, keys binary, who binary")
    by_pass = materialize_parts(found.withColumn("pass", F.coalesce(F.col("g") % PASSES, F.lit(-1))), "pass", range(-1, PASSES), "scores")
    sent.destroy()
    part = by_pass.pop(-1).drop("g", "n", "m", "keys", "who")
    asked = int(reduce(DataFrame.union, by_pass.values()).agg(F.sum("m")).first()[0] or 0)
    passes = max(1, min(PASSES, -(-asked // LOOKUPS)))
    tail = tail.withColumn("g", F.shiftright(F.shiftrightunsigned("key", 33) * groups, 31))
    rests = []
    for k in range(passes):
        mine = [by_pass[j] for j in range(k, PASSES, passes)]
        asking = reduce(DataFrame.union, mine).select("rid", "g", "n", "m", "keys", "who")
        answers = asking.groupBy("g").cogroup(tail.where(F.col("g") % PASSES % passes == k).groupBy("g")).applyInArrow(_answers, "rid long, n long, packed binary")
        rests.append(materialize(answers, "sums"))
        release(*mine)
    rest = reduce(DataFrame.union, rests).groupBy("rid").applyInArrow(_sums, "rid long, words double, all double, more long")
    if tree.frame.others[0] is not False:
        doubt = part.select("rid", F.inline("doubt")).join(tree.others.select("w", F.lit(True).alias("is")), "w", "left")
        doubt = doubt.select("rid", F.when(F.col("is"), F.col("f")).otherwise(F.col("r")).alias("key"))
        is_word = F.col("kind") == 0
        doubt = doubt.join(tree.entries, "key").groupBy("rid").agg(F.sum(F.when(is_word, F.col("value")).otherwise(0.0)).alias("words"), F.sum("value").alias("all"), F.count(F.when(is_word, 1)).alias("more"))
        rest = rest.union(doubt).groupBy("rid").agg(*(F.sum(c).alias(c) for c in ("words", "all", "more")))
    out = part.drop("doubt").join(rest, "rid", "left")
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("base_score") + F.coalesce("words", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("all", F.lit(0.0))).alias("score"))


def _group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    """Ranges of keys, so that differences between a group's keys are small."""
    return ((keys >> np.uint64(33)) * np.uint64(groups) >> np.uint64(31)).astype(np.int64)


def _answers(asking: pa.Table, entries: pa.Table) -> pa.Table:
    """What a group's entries add to the documents that ask for them: for each row of ``asking`` packed (place of the
    document from rid on, sum of all values, sum of words' values, number of words)."""
    index = Index(entries.column("key").to_numpy().view(np.uint64))
    value, word = np.append(entries.column("value").to_numpy(), 0.0), np.append(entries.column("kind").to_numpy() == 0, False)
    out = []
    for r in asking.to_pylist():
        keys, often = unpack(r["n"], r["keys"], 2)
        at = np.repeat(index.find(keys), often.astype(np.int64))
        (who,) = unpack(r["m"], r["who"], 1, differences=False)
        who, at = who[at >= 0].astype(np.int64), at[at >= 0]
        docs = np.flatnonzero(np.bincount(who))
        total, words, more = (np.bincount(who, weights=w)[docs] for w in (value[at], value[at] * word[at], word[at]))
        if len(docs):
            out.append({"g": r["rid"], "n": len(docs), "packed": pack(docs, total, words, more.astype(np.int64))})
    return pa.Table.from_pylist(out, PACKED).rename_columns(["rid", "n", "packed"])


def _sums(packed: pa.Table) -> pa.Table:
    """The sums of answers to the same documents."""
    rows = sorted(zip(packed.column("n").to_pylist(), packed.column("packed").to_pylist(), strict=True))  # reruns agree
    docs, total, words, more = (np.concatenate(c) for c in zip(*(unpack(n, x, 4) for n, x in rows), strict=True))
    docs = docs.astype(np.int64)
    there = np.flatnonzero(np.bincount(docs))
    total, words, more = (np.bincount(docs, weights=w)[there] for w in (total.view(np.float64), words.view(np.float64), more.astype(np.float64)))
    return pa.table({"rid": packed.column("rid")[0].as_py() + there, "words": words, "all": total, "more": more.astype(np.int64)})
