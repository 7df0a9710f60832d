"""Operator 3: quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are measured on a random sample of documents, and the rules run in order of
rejections per second; the first that rejects a document ends its cascade. The verdict is a conjunction and doesn't
depend on the order, so a sample that misleads costs time and nothing else. Costs are rounded to powers of COST_STEP,
so that the order, and with it the rule named for a rejection, doesn't follow the clock's noise.
"""

from __future__ import annotations

import functools
import math
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _IS_SPACE, SPACE, about, hash_runs, hash_spans, materialize, same_spans, text_groups, uniform, word_spans

#: Documents, on average, on which costs and rejections are measured; only the order of rules follows from them.
SAMPLE, REPEATS, COST_STEP = 1000, 3, 8
SYMBOLS = b"#*$%&|<>"
#: Words of abuse; a rule's parameter.
ABUSE = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")

_symbol = np.zeros(256, np.int64)
_symbol[list(SYMBOLS)] = 1
_letter_kind = np.array([c.isupper() + 2 * c.isalpha() for c in map(chr, range(0x250))], np.uint8)


@dataclass
class Stats:
    """What the base rule and the result need of a document."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


class Text:
    """A document's text with what rules ask of it, worked out when first asked for."""

    def __init__(self, raw: bytes, stats: Stats):
        self.raw, self.stats = raw, stats

    @cached_property
    def letters(self) -> tuple[int, int]:
        """Upper-case letters and letters, of the Latin blocks."""
        code = np.frombuffer(self.raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        kind = _letter_kind[code[code < 0x250]]
        return int((kind & 1).sum()), int((kind >> 1).sum())

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word, without white space at their ends."""
        return [x for x in (y.strip() for y in self.raw.split(b"\n")) if x]


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def _shouts(t: Text) -> bool:
    upper, letters = t.letters
    return letters >= 20 and 10 * upper > 4 * letters


def _abuse(words: tuple[str, ...], apart: int, close: int = 600) -> Callable[[Text], bool]:
    """A word of abuse for every ``apart`` words, one at least, or three within ``close`` bytes of a text of any length."""
    found = re.compile(rb"(?<![a-z])(?:%s)(?![a-z])" % "|".join(words).encode(), re.IGNORECASE)

    def rejects(t: Text) -> bool:
        at = [m.start() for m in found.finditer(t.raw)]
        return len(at) > 0 and len(at) * apart >= t.stats.n_words or any(z - x <= close for x, z in zip(at, at[2:], strict=False))

    return rejects


_bullet = ("•".encode(), "‣".encode(), "▪".encode(), "●".encode(), b"- ", b"* ")
_no_letter = bytes(k for k in range(128) if not (chr(k).isalpha() or _IS_SPACE[k]))


def _without_letters(t: Text) -> int:
    """Words without a letter: those of which nothing is left without the other characters."""
    return t.stats.n_words - len(t.raw.translate(None, _no_letter).split())


def _top_pair(t: Text) -> bool:
    """The commonest pair of words makes more than a fifth of the text."""
    (a, b), n = Counter(zip(t.words, t.words[1:], strict=False)).most_common(1)[0]
    return 5 * n * (len(a) + len(b)) > sum(map(len, t.words))


def _same_paragraphs(t: Text) -> bool:
    """Of four paragraphs or more, over three tenths repeat an earlier one."""
    p = [x for x in (y.strip() for y in t.raw.split(b"\n\n")) if x]
    return len(p) >= 4 and 10 * (len(p) - len(set(p))) > 3 * len(p)


#: They see documents of 50 words or more.
RULES = (
    Rule("symbols", lambda t: 10 * t.stats.n_symbols > t.stats.n_words),
    Rule("word_length", lambda t: not 5 * t.stats.n_words <= 2 * t.stats.word_chars <= 24 * t.stats.n_words),
    Rule("duplicate_lines", lambda t: t.stats.n_dup_lines >= 3 and 2 * t.stats.n_dup_lines > t.raw.count(b"\n") + 1),
    Rule("duplicate_paragraphs", _same_paragraphs),
    Rule("exclamations", lambda t: 2 * t.raw.count(b"!") > t.stats.n_words),
    Rule("bullets", lambda t: len(t.lines) >= 3 and 10 * sum(x.startswith(_bullet) for x in t.lines) > 9 * len(t.lines)),
    Rule("ellipses", lambda t: len(t.lines) >= 3 and 10 * sum(x.endswith((b"...", "…".encode())) for x in t.lines) > 3 * len(t.lines)),
    Rule("shouting", _shouts),
    Rule("words_without_letters", lambda t: 5 * _without_letters(t) > t.stats.n_words),
    Rule("few_distinct_words", lambda t: t.stats.n_words >= 100 and 10 * len(set(t.words)) < t.stats.n_words),
    Rule("one_pair_of_words", _top_pair),
    Rule("digits", lambda t: 2 * sum(t.raw.count(b"%d" % k) for k in range(10)) > t.stats.word_chars),
    Rule("abuse", _abuse(ABUSE, 500)),
)


#: For learning terms of abuse: labelled documents of a kind (toxic, others) on average, prefix lengths, least shares of
#: a text's words that start with a term, terms of a language, what a false alarm costs, least gain, and prefixes of a
#: language from which its terms are chosen.
LEARN_ROWS, PREFIXES, SHARES, TERMS, FALSE_ALARM, LEARN_GAIN, CANDIDATES = 3000, (4, 5, 6, 8), (0.0, 0.005, 0.01, 0.02), 20, 10, 0.02, 200
_to_blank = dict.fromkeys(map(ord, SPACE), " ")


def _starts(raw: bytes) -> tuple[int, Counter[str]]:
    """Number of words, and how many of them start with each prefix (a shorter word counts whole)."""
    w = raw.decode("utf-8", "replace").lower().translate(_to_blank).split(" ")
    w = [x for x in w if x]
    return max(1, len(w)), Counter(p for x in w for p in {x[:k] for k in PREFIXES})


def learn_abuse(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, float]]:
    """(prefix, share) for every language: a text of which more than that share of words starts with the prefix is abuse.

    Learnt on half of LEARN_ROWS toxic and as many other labelled documents, greedily by toxic documents of the
    language found, less FALSE_ALARM times the share of other documents hit; a term stays if it still gains on the
    other half. Languages without labelled toxic documents get no terms. The sample is by hash of the id, its texts are
    whole.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"))
    lab = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    picked = [about(lab.where(c), "id", LEARN_ROWS) for c in ("toxic = 1", "toxic <> 1")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e, parts in text_groups(b.column(2)):
                found = [_starts(x) for x in parts]
                cols = [*(b.column(k).slice(s, e - s) for k in (0, 1, 3)), pa.array([n for n, _ in found], pa.int64()), pa.array([list(c) for _, c in found], pa.list_(pa.string())), pa.array([list(c.values()) for _, c in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "toxic", "lang", "n", "starts", "counts"])

    schema = "id long, toxic int, lang string, n long, starts array<string>, counts array<long>"
    some = d.join(F.broadcast(picked[0].union(picked[1])), "id").select(F.col("id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"), "text", "lang")
    some = materialize(some.mapInArrow(read, schema), "starts-of-words")
    # of each language the prefixes by which its toxic documents differ most; only they are looked at on the driver
    is_bad = F.col("toxic") == 1
    size = some.groupBy("lang").agg(F.count(F.when(is_bad, 1)).alias("bad"), F.count(F.when(~is_bad, 1)).alias("clean"))
    often = some.select("lang", "toxic", F.explode("starts").alias("p")).groupBy("lang", "p").agg(F.count(F.when(is_bad, 1)).alias("often"), F.count(F.when(~is_bad, 1)).alias("usual"))
    often = often.join(size, "lang").where(F.col("often") >= F.greatest(F.lit(2), LEARN_GAIN * F.col("bad")))
    rank = F.desc(F.col("often") / F.col("bad") - F.col("usual") / F.greatest(F.col("clean"), F.lit(1)))
    best = often.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(rank, "p"))).where(F.col("k") <= CANDIDATES)
    wanted = {r.p for r in best.select("p").distinct().collect()}  # CANDIDATES for each language at most

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [[(p, c) for p, c in zip(x, y, strict=True) if p in wanted] for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            lists = (pa.array([[x[k] for x in row] for row in pairs], pa.list_(t)) for k, t in ((0, pa.string()), (1, pa.int64())))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), *lists], names=["id", "toxic", "lang", "n", "starts", "counts"])

    rows = [(r.id % 2, r.toxic == 1, r.lang, r.n, Counter(dict(zip(r.starts, r.counts, strict=True)))) for r in some.mapInArrow(thin, schema).orderBy("id", "n").collect()]
    terms: list[tuple[str, float]] = []
    clean = [[x for x in rows if not x[1] and x[0] == half] for half in (0, 1)]
    for lang in sorted({x[2] for x in rows if x[1]}):
        bad = [[x for x in rows if x[1] and x[2] == lang and x[0] == half] for half in (0, 1)]
        peers = [[x for x in c if x[2] == lang] or c for c in clean]

        def gain(half: int, p: str, share: float, left: list, bad=bad, peers=peers) -> float:
            hit = lambda group: sum(x[4][p] > share * x[3] for x in group)
            return hit(left) / max(1, len(bad[half])) - FALSE_ALARM * hit(peers[half]) / max(1, len(peers[half]))

        left, held = bad
        for _ in range(TERMS):
            often = Counter(p for x in left for p in x[4])
            usual = Counter(p for x in peers[0] for p in x[4])
            rank = lambda p: often[p] / max(1, len(left)) - usual[p] / max(1, len(peers[0]))  # noqa: E731, B023
            best = max(((gain(0, p, s, left), p, s) for p in sorted(often, key=lambda p: (-rank(p), p))[:60] for s in SHARES), default=(0, "", 0.0))
            if best[0] < LEARN_GAIN:
                break
            _, p, s = best
            left = [x for x in left if x[4][p] <= s * x[3]]
            if gain(1, p, s, held) > 0:
                terms.append((p, s))
                held = [x for x in held if x[4][p] <= s * x[3]]
    return terms


@functools.lru_cache(maxsize=4)
def _seeker(terms: tuple[tuple[str, float], ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for p, share in terms:
        found.add_word(f" {p}", (p, share))
    found.make_automaton()
    return found


def learnt_rule(terms: list[tuple[str, float]]) -> Rule:
    terms = tuple(sorted(dict(terms).items()))

    def rejects(t: Text) -> bool:
        text = " " + t.raw.decode("utf-8", "replace").lower().translate(_to_blank)
        n = Counter(x for _, x in _seeker(terms).iter(text))
        return bool(n) and any(c > share * max(1, len(t.words)) for (_, share), c in n.items())

    return Rule("abuse_learnt", rejects)


def rules_with(docs: DataFrame, labels: DataFrame) -> tuple[Rule, ...]:
    """RULES and what labels of ``docs`` tell of abuse."""
    terms = learn_abuse(docs, labels)
    return (*RULES, learnt_rule(terms)) if terms else RULES


def _repeat_words(w: list[bytes]) -> int:
    """Words in 3-word windows found twice or more."""
    windows = list(zip(w, w[1:], w[2:], strict=False))
    often = Counter(windows)
    return len({k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(3)})


def measure(parts: list[bytes]) -> list[Stats]:
    """The base statistics, for a group of texts at once."""
    raw, starts, ends, bounds = word_spans(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    reach = np.cumsum(sizes + 1)
    at = np.concatenate([[0], reach])

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return np.diff(total[np.minimum(at, len(raw))])

    chars = per_text(((raw & 0xC0) != 0x80) & ~_IS_SPACE[raw])
    symbols = per_text(_symbol[raw])
    n = np.diff(bounds)
    repeat = np.zeros(len(parts), np.int64)
    if len(starts) >= 3:
        tri = hash_runs(hash_spans(raw, starts, ends), 3)
        doc = np.repeat(np.arange(len(parts)), n)
        inside = np.flatnonzero(doc[: len(tri)] == doc[2:])
        order = inside[np.lexsort((tri[inside], doc[inside]))]
        same = (tri[order[1:]] == tri[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        a, b = order[1:][same], order[:-1][same]
        true = np.ones(len(a), bool)
        for k in range(3):
            true &= same_spans(raw, starts[a + k], ends[a + k], starts[b + k], ends[b + k])
        mixed_up = np.unique(doc[a[~true]]).tolist()  # their hashes don't tell windows apart
        twice = np.zeros(len(starts) + 1, np.int64)
        hit = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        twice[hit] += 1
        np.subtract.at(twice, hit + 3, 1)
        repeat = np.bincount(doc, weights=np.cumsum(twice[:-1]) > 0, minlength=len(parts)).astype(np.int64)
        for i in mixed_up:
            repeat[i] = _repeat_words(parts[i].split())
    out = []
    for i, p in enumerate(parts):
        seen: set[bytes] = set()
        dup = 0
        for line in p.split(b"\n"):
            if line.strip():
                dup += line in seen
                seen.add(line)
        out.append(Stats(int(n[i]), int(chars[i]), int(symbols[i]), dup, int(repeat[i])))
    return out


def plan_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, *, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """The rules by rejections per second, from a random ``sample`` of documents; ties keep the given order."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected = np.zeros(len(rules)), np.zeros(len(rules), np.int64)
        for b in batches:
            for _, _, parts in text_groups(b.column(0)):
                for raw, stats in zip(parts, measure(parts), strict=True):
                    if stats.base_failed:
                        continue
                    for k, rule in enumerate(rules):
                        took = math.inf
                        for _ in range(REPEATS):
                            text, began = Text(raw, stats), time.perf_counter()
                            verdict = rule.rejects(text)
                            took = min(took, time.perf_counter() - began)
                        rejected[k] += verdict
                        spent[k] += took
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules))), pa.array(spent), pa.array(rejected)], names=["rule", "spent", "rejected"])

    n = docs.count()
    some = docs if n <= sample else docs.where(uniform(id_col, seed=3) < sample / n)
    seen = some.select(F.col(text_col).alias("text")).mapInArrow(probe, "rule long, spent double, rejected long")
    total = {r[0]: (r[1], r[2]) for r in seen.groupBy("rule").agg(F.sum("spent"), F.sum("rejected")).collect()}
    least = min((t for t, _ in total.values() if t), default=1.0)

    def rate(k: int) -> float:
        t, found = total.get(k, (0.0, 0))
        return (found + 0.01) / COST_STEP ** round(math.log(max(t, least) / least, COST_STEP))

    return sorted(rules, key=lambda r: (-rate(rules.index(r)), rules.index(r)))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    rejected_by ("base", a rule's name, or null).

    A null or empty text has no words and so fails the base rule. Ids pass through, null and repeated ones too; other
    columns of ``docs`` don't matter. An empty table gives an empty result.
    """
    order = plan_order(docs, rules, sample, id_col=id_col, text_col=text_col)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e, parts in text_groups(b.column(1)):
                stats = measure(parts)
                why = []
                for raw, x in zip(parts, stats, strict=True):
                    text = Text(raw, x)
                    why.append("base" if x.base_failed else next((r.name for r in order if r.rejects(text)), None))
                cols = [pa.array([getattr(x, c) for x in stats], pa.int64()) for c in names[1:6]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), *cols, pa.array([x.base_failed for x in stats], pa.bool_()), pa.array([w is None for w in why], pa.bool_()), pa.array(why, pa.string())], names=names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
