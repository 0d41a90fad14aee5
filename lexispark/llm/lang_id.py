"""Language identification of code-switched text with a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.textnum import mix, span_hashes

#: Words in one chain; hashed features; most words in a worker's cache.
CHAIN, FEATURES, CACHE = 64, 1 << 16, 300_000
#: A longer word, as in text without spaces, is several words in the chain.
LONGEST = 40
#: The training sample: at most so many documents of a language, and chains of a document. With many languages each has
#: fewer, SHARED documents in all, but FEWEST or more: every language is learned.
DOCS, CHAINS, SHARED, FEWEST = 150, 4, 3_000, 12
#: Up to so many labels the messages between the chains of a long text come from products of whole chains.
PRODUCTS = 16
#: Hashed pieces of four letters that the sample has; words taken as familiar on top of those of a text.
PIECES, GIVEN = 1 << 22, 4
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_EDGES = "".join(map(chr, range(33, 65))) + "[\\]^_`{|}~¡¿«»“”„’‘…–—"


def has_letter(text: str) -> bool:
    """Whether a character is a letter (Unicode category L); number signs such as ½ or ② are none."""
    found = _LETTER.search(text)
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text[found.start() :])))


def words_of(text: str) -> list[str]:
    words = text.split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]


def _plain(word: str) -> str:
    return "^" + word.strip(_EDGES).lower() + "$"


def _laid_out(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(whether a word has a letter, the words that have, these plain, their characters in a row, starts, lengths)."""
    lettered = np.fromiter((has_letter(w) for w in words), bool, len(words))
    rows = np.flatnonzero(lettered)
    plain = [_plain(words[i]) for i in rows]
    chars = np.frombuffer(("\n".join(plain) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, plain), np.int64, len(plain))
    return lettered, rows, plain, chars, np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64), lengths


def _pieces(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids, the word each belongs to): four characters in a row with both edges, or a shorter word as a whole."""
    _, rows, plain, chars, starts, lengths = _laid_out(words)
    if not plain:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = np.maximum(lengths - 3, 1)
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    chars = np.concatenate([chars, np.zeros(1, np.uint64)])
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(4):
            h = h * np.uint64(0x100000001B3) + chars[at + j]
    return (mix(h) & np.uint64(PIECES - 1)).astype(np.int64), np.repeat(rows, count)


def _familiar(words: list[str], known: np.ndarray) -> np.ndarray:
    """The share of each word's pieces that are known."""
    ids, owners = _pieces(words)
    return np.bincount(owners, known[ids], len(words)) / np.maximum(np.bincount(owners, minlength=len(words)), 1)


def _known(words: list[str]) -> np.ndarray:
    known = np.zeros(PIECES, bool)
    known[_pieces(words)[0]] = True
    return known


def calibrate(samples: list[tuple[str, list[str]]], quantile: float = 0.01) -> tuple[np.ndarray, float]:
    """(known pieces, the least familiarity of a text in a learned language).

    Each half of a language's chains is judged by the pieces of the other halves; twice what the hundredth part that is
    least familiar lacks, in the language where that is most, may be lacking.
    """
    place: dict[str, int] = {}
    half = []
    size = Counter(lang for lang, _ in samples)
    for lang, _ in samples:
        half.append(2 * place.get(lang, 0) >= size[lang])
        place[lang] = place.get(lang, 0) + 1
    lack: dict[str, list[float]] = {}
    for side in (False, True):
        known = _known(list({w for h, (_, ws) in zip(half, samples) if h != side for w in ws}))
        types = list({w for h, (_, ws) in zip(half, samples) if h == side for w in ws})
        share = dict(zip(types, _familiar(types, known)))
        for h, (lang, ws) in zip(half, samples):
            held = [share[w] for w in ws if has_letter(w)] if h == side else []
            if held:
                lack.setdefault(lang, []).append(1 - (sum(held) + GIVEN) / (len(held) + GIVEN))
    most = max((float(np.quantile(x, 1 - quantile)) for x in lack.values()), default=1.0)
    return _known(list({w for _, ws in samples for w in ws})), max(0.0, 1 - 2 * most)


def _features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature ids, the word each belongs to, whether a word has a letter), of all words at once.

    A word has its character pairs and triples with both edges, its first and last three and four characters,
    itself, and its lexicon entry; a word without a letter has none.
    """
    lettered, rows, plain, chars, starts, lengths = _laid_out(words)
    if not plain:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), lettered
    owner = np.repeat(rows, lengths + 1)
    ids, owners = [], []

    def add(kind: int, at: np.ndarray, n: int, who: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            h = np.full(len(at), kind, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + chars[at + j]
        ids.append(mix(h) & np.uint64(FEATURES - 1))
        owners.append(who)

    for n in (2, 3):
        inside = np.arange(len(chars) - n + 1)
        inside = inside[(np.repeat(starts + lengths, lengths + 1)[: len(inside)] - inside) >= n]
        add(n, inside, n, owner[inside])
    for n in (3, 4):
        long = lengths >= n + 2
        add(10 + n, starts[long] + 1, n, rows[long])
        add(20 + n, starts[long] + lengths[long] - 1 - n, n, rows[long])
    ids.append(span_hashes(chars, starts, starts + lengths) & np.uint64(FEATURES - 1))
    owners.append(rows)
    known = [(i, lexicon[w]) for i, w in zip(rows, plain) if w in lexicon]
    ids.append(mix(np.array([x for _, x in known], np.uint64) + np.uint64(1 << 40)) & np.uint64(FEATURES - 1))
    owners.append(np.array([i for i, _ in known], np.int64))
    return np.concatenate(ids).astype(np.int64), np.concatenate(owners).astype(np.int64), lettered


def _sums(ids: np.ndarray, owners: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """The summed weight rows of the features of each of n words."""
    return np.stack([np.bincount(owners, weights[ids, j], n) for j in range(weights.shape[1])], 1)


def forward_backward(emit: np.ndarray, real: np.ndarray, step: np.ndarray, first: np.ndarray, pairs: bool = False, after: np.ndarray | None = None):
    """Posterior label probabilities of each position of many chains at once.

    emit (chains, CHAIN, labels) and step (labels, labels) hold exponentials; real marks positions that aren't
    padding (padding only follows); first is the message into each chain (or one for all), after the one from behind its end
    (1 if nothing follows). With pairs also the summed posteriors of label pairs.
    """
    n, t, k = emit.shape
    forward, back = np.empty_like(emit), np.ones_like(emit)
    if after is not None:
        back[:, -1] = after
    now = emit[:, 0] * first
    forward[:, 0] = now = now / now.sum(1, keepdims=True)
    for i in range(1, t):
        now = (now @ step) * emit[:, i]
        forward[:, i] = now = now / now.sum(1, keepdims=True)
    total = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        right = emit[:, i + 1] * back[:, i + 1]
        if pairs:
            some = real[:, i + 1]
            left = forward[some, i]
            total += step * (left.T @ (right[some] / ((left @ step) * right[some]).sum(1, keepdims=True)))
        now = right @ step.T
        back[:, i] = np.where(real[:, i + 1, None], now / now.sum(1, keepdims=True), 1.0)
    out = forward * back
    out /= out.sum(2, keepdims=True)
    return (out, total) if pairs else out


def messages(emit: np.ndarray, real: np.ndarray, counts: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(into, behind) for each chain, where each text is counts[i] chains one after the other: the forward message that its
    first word meets, and the backward message behind its last word, so that a text is one field however long.

    Chains are taken in the order of their place in the text, all texts at once. With few labels a chain is first multiplied out
    to one matrix; with many its words are gone through.
    """
    n, t, k = emit.shape
    into, behind = np.tile(first.astype(emit.dtype), (n, 1)), np.ones((n, k), emit.dtype)
    if counts.max(initial=0) < 2:
        return into, behind
    order = np.argsort(-counts, kind="stable")
    starts, counts = (np.cumsum(counts) - counts)[order], counts[order]
    longer = lambda b: starts[: np.searchsorted(-counts, -b, side="left")]  # noqa: E731  texts of more than b chains
    whole = None
    if k <= PRODUCTS:
        rows = np.concatenate([s + np.arange(c) for s, c in zip(longer(1), counts)])
        made = np.zeros((len(rows), k, k), emit.dtype)
        made[:, np.arange(k), np.arange(k)] = emit[rows, 0]
        for i in range(1, t):
            new = (made @ step) * emit[rows, i][:, None, :]
            made = np.where(real[rows, i][:, None, None], new / new.sum((1, 2), keepdims=True), made)
        whole = np.zeros((n, k, k), emit.dtype)
        whole[rows] = made

    def through(rows: np.ndarray, now: np.ndarray) -> np.ndarray:
        if whole is not None:
            return (now[:, None, :] @ whole[rows])[:, 0]
        now = now * emit[rows, 0]
        for i in range(1, t):
            now = ((now / now.sum(1, keepdims=True)) @ step) * emit[rows, i]
        return now

    def back(rows: np.ndarray, now: np.ndarray) -> np.ndarray:
        if whole is not None:
            return (whole[rows] @ now[:, :, None])[:, :, 0]
        for i in range(t - 1, 0, -1):
            new = (emit[rows, i] * now) @ step.T
            now = np.where(real[rows, i][:, None], new / new.sum(1, keepdims=True), now)
        return now * emit[rows, 0]

    for b in range(1, int(counts[0])):
        rows = longer(b) + b
        now = through(rows - 1, into[rows - 1]) @ step
        into[rows] = now / now.sum(1, keepdims=True)
    for b in range(int(counts[0]) - 2, -1, -1):
        rows = longer(b + 1) + b
        now = back(rows + 1, behind[rows + 1]) @ step.T
        behind[rows] = now / now.sum(1, keepdims=True)
    return into, behind


@dataclass
class Tagger:
    """The learned field: labels, feature weights, transitions, first-word weights and the lexicon."""

    labels: list[str]
    weights: np.ndarray
    step: np.ndarray
    first: np.ndarray
    lexicon: dict[str, int]
    known: np.ndarray | None = None
    least: float = 0.0
    _index: dict[str, int] = field(default_factory=dict)
    _emit: np.ndarray | None = None
    _lettered: np.ndarray | None = None
    _share: np.ndarray | None = None

    def _look_up(self, docs: list[list[str]]) -> None:
        index = self._index
        new = list(dict.fromkeys(w for d in docs for w in d if w not in index))
        if self._emit is None or len(index) + len(new) > CACHE:
            index.clear()
            new = list(dict.fromkeys(w for d in docs for w in d))
            self._emit, self._lettered = np.ones((1, len(self.labels)), np.float32), np.zeros(1, bool)
            self._share = np.zeros(1)
        if new:
            index.update(zip(new, range(len(index) + 1, len(index) + 1 + len(new))))
            for at in range(0, len(new), 50_000):
                ids, owners, lettered = _features(new[at : at + 50_000], self.lexicon)
                score = _sums(ids, owners, len(lettered), self.weights)
                self._emit = np.concatenate([self._emit, np.exp(np.clip(score - score.max(1, keepdims=True), -30, 0)).astype(np.float32)])
                self._lettered = np.concatenate([self._lettered, lettered])
                if self.known is not None:
                    self._share = np.concatenate([self._share, _familiar(new[at : at + 50_000], self.known)])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(label, its share of the posterior mass of the words that have letters) for each text."""
        return [(x, y) for x, y, _ in self.judge(texts)]

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """predict, and how familiar the words that have letters are, GIVEN more of them taken as known (1 without known)."""
        docs = [words_of(t) if t and self.labels and has_letter(t) else [] for t in texts]
        out: list[tuple[str, float, float]] = [(UNKNOWN, 0.0, 1.0)] * len(docs)
        full = [i for i, d in enumerate(docs) if d]
        if not full:
            return out
        self._look_up([docs[i] for i in full])
        get = self._index.__getitem__
        chains = [-(-len(docs[i]) // CHAIN) for i in full]
        at = np.zeros((sum(chains), CHAIN), np.int64)
        flat, row = at.reshape(-1), 0
        for i, n in zip(full, chains):
            flat[row * CHAIN : row * CHAIN + len(docs[i])] = np.fromiter(map(get, docs[i]), np.int64, len(docs[i]))
            row += n
        found = self._posteriors(at, np.array(chains))
        first_rows = np.concatenate([[0], np.cumsum(chains)[:-1]])
        mass = np.add.reduceat(found, first_rows, axis=0)
        near = np.ones(len(full))
        if self.known is not None:
            held, n = (np.add.reduceat(x[at].sum(1), first_rows) for x in (self._share, self._lettered))
            near = (held + GIVEN) / (n + GIVEN)
        for i, m, f in zip(full, mass, near):
            best = int(m.argmax())
            out[i] = (self.labels[best], float(min(1.0, m[best] / max(m.sum(), 1e-9))), float(f))
        return out


    def _posteriors(self, at: np.ndarray, chains: np.ndarray) -> np.ndarray:
        """The summed posteriors of the lettered words of each chain; texts are whole in a piece of about 4096 chains."""
        step, first = np.exp(self.step).astype(np.float32), np.exp(self.first).astype(np.float32)
        found, ends = np.empty((len(at), len(self.labels))), np.cumsum(chains)
        low = text = 0
        while low < len(at):
            upto = max(text + 1, int(np.searchsorted(ends, low + 4096, side="right")))
            high = int(ends[upto - 1])
            part = at[low:high]
            emit = self._emit[part]
            into, behind = messages(emit, part > 0, chains[text:upto], step, first)
            post = forward_backward(emit, part > 0, step, into, after=behind)
            found[low:high] = (post * self._lettered[part][:, :, None]).sum(1)
            low, text = high, upto
        return found


def train(samples: list[tuple[str, list[str]]], rounds: int = 50, rate: float = 0.25, decay: float = 1e-3, seed: int = 7) -> Tagger:
    """Fit the field to chains of (language, words) by Adam steps on the likelihood.

    Every second chain is spliced with one of another language, so the transitions learn that text may switch.
    """
    labels = sorted({x for x, _ in samples})
    k = len(labels)
    if k < 2:
        return Tagger(labels, np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(k), {})
    number = {x: i for i, x in enumerate(labels)}
    rng = np.random.default_rng(seed)
    counts = [Counter() for _ in labels]
    for lang, words in samples[::2]:
        counts[number[lang]].update(map(_plain, words))
    lexicon = {}
    for i, c in enumerate(counts):
        for w, n in c.items():
            if n >= 5 and n > 0.8 * sum(x[w] for x in counts):
                lexicon[w] = i
    chains = []
    for j, (lang, words) in enumerate(samples):
        tags = [number[lang]] * len(words)
        if j % 2:
            other, more = samples[int(rng.integers(len(samples)))]
            cut = int(rng.integers(1, CHAIN))
            words, tags = words[:cut] + more[: CHAIN - cut], tags[:cut] + [number[other]] * len(more[: CHAIN - cut])
        chains.append((words[:CHAIN], tags[:CHAIN]))
    types = list(dict.fromkeys(w for ws, _ in chains for w in ws))
    place = {w: i + 1 for i, w in enumerate(types)}
    at, tag = np.zeros((len(chains), CHAIN), np.int64), np.zeros((len(chains), CHAIN), np.int64)
    for r, (ws, ts) in enumerate(chains):
        at[r, : len(ws)], tag[r, : len(ws)] = [place[w] for w in ws], ts
    real = at > 0
    flat, owner, _ = _features(types, lexicon)
    used, flat = np.unique(flat, return_inverse=True)  # the others keep the weight 0
    gold = np.zeros((k, k))
    np.add.at(gold, (tag[:, :-1][real[:, 1:]], tag[:, 1:][real[:, 1:]]), 1)
    truth = np.eye(k)[tag] * real[:, :, None]
    values = [np.zeros((len(used), k)), np.zeros((k, k)), np.zeros(k)]
    m, v = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]
    for r in range(1, rounds + 1):
        score = _sums(flat, owner, len(types), values[0])
        emit = np.concatenate([np.ones((1, k)), np.exp(score - score.max(1, keepdims=True))])
        post, pairs = forward_backward(emit[at], real, np.exp(values[1]), np.exp(values[2]), pairs=True)
        miss = post * real[:, :, None] - truth
        by_type = np.stack([np.bincount(at.ravel(), miss[:, :, j].ravel(), len(types) + 1)[1:] for j in range(k)], 1)
        slope = [
            np.stack([np.bincount(flat, by_type[owner, j], len(used)) for j in range(k)], 1),
            pairs - gold,
            (post[:, 0] - truth[:, 0]).sum(0),
        ]
        for j, g in enumerate(slope):
            g = g / real.sum() + decay * values[j] / len(labels) / 10
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.99 * v[j] + 0.01 * g * g
            values[j] -= rate / (1 + r / 40) * (m[j] / (1 - 0.9**r)) / (np.sqrt(v[j] / (1 - 0.99**r)) + 1e-8)
    weights = np.zeros((FEATURES, k), np.float32)
    weights[used] = values[0]
    return Tagger(labels, weights, values[1], values[2], lexicon)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 modulo 4 (null ids: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_chains(docs: DataFrame, per_language: int = DOCS, per_doc: int = CHAINS) -> list[tuple[str, list[str]]]:
    """A bounded sample of labelled documents that aren't held out, as chains spread over each whole text.

    Every language gets into it, a rare one with all its documents; the driver holds a count for each. Documents are drawn by
    id and text together, and rows equal in both are one, so neither an id nor a text that stands often brings more.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    wanted = min(per_language, max(FEWEST, SHARED // len(counts)))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, wanted / n))]), F.col("lang"))
    picked = F.pmod(F.xxhash64("doc_id", "text", F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                starts = range(0, len(words), CHAIN)
                for s in list(starts)[:: max(1, len(starts) // per_doc)][:per_doc]:
                    out.append((doc_id, lang, s, words[s : s + CHAIN]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string())))], ["doc_id", "lang", "s", "words"])

    found = rows.where(picked).select("doc_id", "lang", "text").mapInArrow(chains, "doc_id long, lang string, s long, words array<string>")
    return [(r.lang, list(r.words)) for r in sorted(found.distinct().collect(), key=lambda r: (r.doc_id, r.s, r.lang, r.words))]


def identify(docs: DataFrame) -> DataFrame:
    """All columns of docs, and held_out, lang_pred and score.

    Null text and text without a letter: und, score 0; the same for every text if no labelled document may be
    learned from. With one language learned, every text with a letter gets it. Repeated rows are judged each;
    a null doc_id is not held out, but nothing is learned from it. A text is one chain, however long, worked
    on CHAIN words at a time; long words are several words of LONGEST characters. Columns of
    docs named held_out, lang_pred or score are replaced.
    """
    docs = docs.drop("held_out", "lang_pred", "score")
    tagger = docs.sparkSession.sparkContext.broadcast(train(training_chains(docs)))
    return _tag(docs.withColumn("held_out", held_out(F.col("doc_id"))), tagger)


def _tag(docs: DataFrame, tagger) -> DataFrame:
    schema = docs.schema
    names = [f.name for f in schema.fields]

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tagger.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                judged = model.judge(part.column(names.index("text")).to_pylist())
                found = [(x, y) if f >= model.least else (UNKNOWN, 0.0) for x, y, f in judged]
                more = [pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*names, "lang_pred", "score"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", lang_pred string, score double"
    return docs.mapInArrow(tag, out)


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents, with their columns, whose language is known with at least that share of their words.

    The shares are of the learned languages alone, so a text must also be as familiar as calibrate asks: lettered junk
    and texts in other languages go, whatever their share. Null texts and texts without a letter go; with no document that
    may be learned from all go. Repeated rows are judged each; a null doc_id is judged like any other. An empty table gives
    no rows.
    """
    names = docs.columns
    whole = docs.select("doc_id", "text", "lang", F.struct("*").alias("doc"))
    samples = training_chains(docs)
    model = train(samples)
    model.known, model.least = calibrate(samples)
    found = _tag(whole, docs.sparkSession.sparkContext.broadcast(model)).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*[F.col("doc").getField(n).alias(n) for n in names])
