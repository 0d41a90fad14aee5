"""Quality rules in a cascade: rules that reject many documents for little work come first, and what one rejects the rest don't see.

A rule is a name and a function of a Texts, the documents of a batch, that says which of some of them it rejects. What rules share
(words, letters, repeated windows) is worked out when a rule first asks for it, and only for the documents that are left. On a
sample every rule is run on every document; from which rules reject which documents, and from the time each takes, the order
follows: again and again the rule with the most rejections per second among the documents that are left. A document is
kept if no rule rejects it, so the order changes the work and never the verdict.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of the sample on which rules are timed, about.
SAMPLE = 2000
#: Bytes of text that a task works on together.
TOGETHER = 4_000_000
WINDOW = 5
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_LOWER, _UPPER = bytes(range(0x61, 0x7B)), bytes(range(0x41, 0x5B))
_NOT_LETTERS = bytes(c for c in range(0x80) if not chr(c).isalpha())
#: Bytes of UTF-8 that don't begin a code point.
_CONTINUED = bytes(range(0x80, 0xC0))


class Texts:
    """Documents as UTF-8, and their measures: whole numbers for some of the documents, worked out once and when asked for."""

    def __init__(self, texts: Sequence[bytes]) -> None:
        self.texts = texts
        self._words: list[list[bytes] | None] = [None] * len(texts)
        self._known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def words(self, i: int) -> list[bytes]:
        """Runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return."""
        if self._words[i] is None:
            self._words[i] = self.texts[i].split()
        return self._words[i]

    def measure(self, name: str, some: np.ndarray) -> np.ndarray:
        """A measure of the documents of these numbers."""
        values, known = self._known.setdefault(name, (np.zeros(len(self.texts), np.int64), np.zeros(len(self.texts), bool)))
        new = some[~known[some]]
        if len(new):
            values[new] = MEASURES[name](self, new)
            known[new] = True
        return values[some]


def _each(of: Callable[[Texts, int], int]) -> Callable[[Texts, np.ndarray], list[int]]:
    return lambda texts, some: [of(texts, i) for i in some.tolist()]


def _repeated_lines(texts: Texts, i: int) -> int:
    lines = [line for line in texts.texts[i].split(b"\n") if line.strip(_SPACES)]
    return len(lines) - len(set(lines))


def repeated_words(texts: Texts, some: np.ndarray) -> np.ndarray:
    """Words that a window of 5 words covers which the text has twice or more, the first time included.

    Words are numbered, then windows of 2, 4 and 5 words by the numbers of their parts, each document apart; nothing is hashed.
    """
    numbers: dict[bytes, int] = {}
    lists = [[numbers.setdefault(w, len(numbers)) for w in texts.words(i)] for i in some.tolist()]
    lengths = np.array([len(x) for x in lists], np.int64)
    ids = np.array([x for held in lists for x in held], np.int64)
    owner = np.repeat(np.arange(len(lists)), lengths)
    n = len(ids) - WINDOW + 1
    if n < 1:
        return np.zeros(len(lists), np.int64)

    def pair(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
        return np.unique(a * width + b, return_inverse=True)[1]

    two = pair(ids[:-1], ids[1:], len(numbers))
    four = pair(two[:-2], two[2:], len(two))
    five = pair(four[:n], ids[4:], len(numbers))
    whole = owner[:n] == owner[4:]
    starts = np.flatnonzero(whole)
    _, inverse, counts = np.unique(owner[starts] * np.int64(five.max() + 1) + five[starts], return_inverse=True, return_counts=True)
    starts = starts[counts[inverse] > 1]
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    return np.bincount(owner[np.cumsum(change[:-1]) > 0], minlength=len(lists))


MEASURES: dict[str, Callable[[Texts, np.ndarray], Sequence[int]]] = {
    "n_words": _each(lambda t, i: len(t.words(i))),
    "word_chars": _each(lambda t, i: len(t.texts[i].translate(None, _SPACES + _CONTINUED))),
    "n_symbols": _each(lambda t, i: len(t.texts[i]) - len(t.texts[i].translate(None, _SYMBOLS))),
    "n_dup_lines": _each(_repeated_lines),
    "n_repeat_words": repeated_words,
    "n_upper": _each(lambda t, i: len(t.texts[i]) - len(t.texts[i].translate(None, _UPPER))),
    "n_lower": _each(lambda t, i: len(t.texts[i]) - len(t.texts[i].translate(None, _LOWER))),
    "n_letters": _each(lambda t, i: len(t.texts[i].translate(None, _NOT_LETTERS + _CONTINUED))),
    "n_marks": _each(lambda t, i: t.texts[i].count(b"!")),
    "n_lines": _each(lambda t, i: sum(1 for line in t.texts[i].split(b"\n") if line.strip(_SPACES))),
    "n_stutter": _each(lambda t, i: sum(map(eq, t.words(i), t.words(i)[1:]))),
    "n_most": _each(lambda t, i: max(Counter(t.words(i)).values(), default=0)),
}


class Rule(NamedTuple):
    """Rejects the documents of which the measures, in the order of `of`, make `when` true (over arrays)."""

    name: str
    of: tuple[str, ...]
    when: Callable[..., np.ndarray]


#: The base: too short, or made of repeated windows.
BASE = (
    Rule("short", ("n_words",), lambda n: n < 10),
    Rule("repeated", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 20 * n),
)
#: The rest of the cascade. All are shares in whole numbers; a text without words is left to the base.
RULES = BASE + (
    Rule("long words", ("n_words", "word_chars"), lambda n, c: c > 20 * n),
    Rule("short words", ("n_words", "word_chars"), lambda n, c: 2 * c < 3 * n),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 10 * s > n),
    Rule("repeated lines", ("n_lines", "n_dup_lines"), lambda n, d: 2 * d > n),
    Rule("capitals", ("n_upper", "n_lower"), lambda u, low: (u > low) & (u > 20)),
    Rule("marks", ("n_words", "n_marks"), lambda n, m: 10 * m > 3 * n),
    Rule("few letters", ("word_chars", "n_letters"), lambda c, m: 10 * m < 4 * c),
    Rule("one word", ("n_words", "n_most"), lambda n, m: (5 * m > 2 * n) & (n >= 20)),
    Rule("stutter", ("n_words", "n_stutter"), lambda n, s: 10 * s > 3 * n),
)


class Measured(NamedTuple):
    """What a sample says: for each set of rules (bits by place) how many documents just these reject, and seconds a document for each rule."""

    documents: dict[int, int]
    seconds: list[float]


def in_order(measured: Measured) -> list[int]:
    """The places of the rules by rejections per second, each among the documents that the ones before it leave.

    Rules that reject nothing more come last, the cheapest first.
    """
    left, order, rest = dict(measured.documents), [], list(range(len(measured.seconds)))
    while rest:
        gain = {k: sum(n for bits, n in left.items() if bits >> k & 1) for k in rest}
        best = min(rest, key=lambda k: (-gain[k] / max(measured.seconds[k], 1e-9), measured.seconds[k], k))
        left = {bits: n for bits, n in left.items() if not bits >> best & 1}
        order.append(best)
        rest.remove(best)
    return order


def _batches(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[list[pa.Array], Texts]]:
    """Pieces of about TOGETHER bytes of text: the columns before the last, and the texts of the last."""
    for batch in batches:
        low, held = 0, 0
        texts = batch.column(batch.num_columns - 1).to_pylist()
        for high, text in enumerate(texts):
            held += len(text or b"")
            if held > TOGETHER or high == len(texts) - 1:
                yield [batch.column(k).slice(low, high + 1 - low) for k in range(batch.num_columns - 1)], Texts([t or b"" for t in texts[low : high + 1]])
                low, held = high + 1, 0


def sampled(documents: DataFrame, rules: Sequence[Rule], sample: int = SAMPLE, seed: int = 7) -> Measured:
    """Run every rule on about `sample` documents, where they lie; only counts and times come back."""
    rules = list(rules)
    share = min(1.0, sample / max(documents.count(), 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seconds, n = Counter(), np.zeros(len(rules)), 0
        for _, texts in _batches(batches, []):
            some, bits = np.arange(len(texts.texts)), np.zeros(len(texts.texts), np.int64)
            for k, rule in enumerate(rules):
                fresh = Texts(texts.texts)  # each rule pays for all it needs
                began = time.process_time()
                rejected = rule.when(*(fresh.measure(m, some) for m in rule.of))
                seconds[k] += time.process_time() - began
                bits |= rejected.astype(np.int64) << k
            found.update(bits.tolist())
            n += len(some)
        kinds = list(found.items()) or [(0, 0)]
        rows = [(b, c, [0.0] * len(rules)) for b, c in kinds]
        rows[0] = (*rows[0][:2], seconds.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.float64())))], ["bits", "n", "seconds"])

    texts = documents.sample(fraction=share, seed=seed).select(F.col("text").cast("binary").alias("text"))
    rows = texts.mapInArrow(work, "bits long, n long, seconds array<double>")
    sums = [F.sum(F.col("seconds")[k]).alias(f"s{k}") for k in range(len(rules))]
    found = rows.groupBy("bits").agg(F.sum("n").alias("n"), *sums).collect()  # at most 2 ** rules rows
    n = max(sum(r["n"] for r in found), 1)
    return Measured({r["bits"]: r["n"] for r in found if r["n"]}, [sum(r[f"s{k}"] for r in found) / n for k in range(len(rules))])


def cascade(documents: DataFrame, rules: Sequence[Rule] = RULES, measures: Sequence[str] = (), sample: int = SAMPLE) -> DataFrame:
    """(doc_id, the named measures, kept): kept is false if any rule rejects the document.

    Rules run in the order that the sample gives; a document that is rejected is not measured again, but for the named measures,
    which are reported of all. Nothing is shuffled. Null text reads as '', ids may be null or repeated, every row has its
    result, an empty table none; other columns are not read.
    """
    rules = list(rules)
    order = in_order(sampled(documents, rules, sample))
    measures = list(measures)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, texts in _batches(batches, []):
            every = np.arange(len(texts.texts))
            left = every
            for k in order:
                left = left[~rules[k].when(*(texts.measure(m, left) for m in rules[k].of))]
            kept = np.zeros(len(every), bool)
            kept[left] = True
            made = [pa.array(texts.measure(m, every)) for m in measures]
            yield pa.RecordBatch.from_arrays([columns[0], *made, pa.array(kept)], ["doc_id", *measures, "kept"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    read = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    return read.mapInArrow(work, ", ".join([f"doc_id {kind}", *(f"{m} long" for m in measures), "kept boolean"]))


def judge(documents: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every document."""
    found = cascade(documents, rules, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")
