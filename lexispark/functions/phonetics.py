"""A model of how alike sounds are, and alignment by it: small kernels that tasks call for different pairs of words.

Sounds fall into classes. Classes that change into each other in many languages are linked in a graph, and two sounds are the
less alike the longer the way between their classes is. How much a sound counts depends on its place in the rise and fall of
sonority: initial consonants and vowels are seldom lost, final ones often, so gaps cost by place.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np

from lexispark.functions.phonology import FRICATIVES, GLIDES, LIQUIDS, MARKERS, NASALS, TONES, VOWELS

#: Classes of sounds and the letters of each; what isn't listed is looked up by its first letter without accents.
CLASSES = {
    "P": "pbɓ", "B": "fvɸβ", "W": "wʋɰʍ", "M": "mɱ", "T": "tdɗʈɖ", "D": "θð", "C": "cɟʦʣʧʤ", "S": "szʃʒʂʐɕʑç", "N": "nɳɲñṅ", "L": "lɭʎʟɫɬɮ", "R": "rɹɾɽʀʁɻɺ",
    "K": "kgɡɠqɢ", "X": "xɣχ", "Q": "ŋɴ", "H": "hɦħʕʔ", "J": "jɥʝ", "I": "iɪɨyʏ", "E": "eɛæøœɘɶ", "A": "aɑɐɒ", "Y": "əɜɚɝɞɤʌɯɵɿʅ", "O": "oɔ", "U": "uʊʉ",
}
#: Classes between which sounds change, and how many steps that is.
CHANGES = {
    "PB": 1, "BW": 1, "PM": 2, "BH": 2, "TD": 1, "TC": 1, "DS": 1, "CS": 1, "TS": 2, "TN": 2, "TR": 2, "KX": 1, "KC": 1, "XH": 1, "KH": 2, "SH": 1, "KQ": 2, "QN": 1,
    "NM": 1.5, "NL": 1.5, "LR": 1, "RS": 2, "BD": 1.5, "WX": 1.5, "JC": 1.5, "LJ": 1.5, "WU": 1, "WO": 1.5, "JI": 1, "JE": 1.5, "TH": 2, "TL": 2,
    "IE": 1, "EA": 1, "AO": 1, "OU": 1, "YE": 1, "YA": 1, "YO": 1, "YI": 1.5, "YU": 1.5, "IU": 1.5,
}
SAME_CLASS, STEP, LEAST, ACROSS, NEVER = 0.8, 0.3, -0.5, -1.0, -4.0
#: How much a sound in each place of the prosodic profile (see phonology.prosody, model ps) counts.
WEIGHTS = {"A": 1.6, "B": 1.3, "L": 1.1, "M": 1.1, "N": 0.8, "X": 1.5, "Y": 1.3, "Z": 1.0, "T": 1.0, "+": 2.0}
#: By how much more a match counts for sounds in the same place.
SAME_PLACE = 0.3
_CLASS_OF = {c: k for k, letters in CLASSES.items() for c in letters}


def _steps() -> dict[tuple[str, str], float]:
    """The shortest way between any two classes."""
    names = list(CLASSES)
    far = {(a, b): 0.0 if a == b else float("inf") for a in names for b in names}
    for (a, b), n in CHANGES.items():
        far[a, b] = far[b, a] = float(n)
    for k in names:
        for a in names:
            for b in names:
                far[a, b] = min(far[a, b], far[a, k] + far[k, b])
    return far


_FAR = _steps()


@lru_cache(maxsize=1 << 16)
def _own(sound: str) -> str:
    """What is said of a/b is said of b; marks before the letter are left out."""
    parts = sound.split("/")
    own = parts[1] if len(parts) > 1 and parts[1] else sound
    return own.lstrip("ˈˌ'ʼʰⁿᵐᵑ!?") or own


@lru_cache(maxsize=1 << 16)
def sound_class(sound: str) -> str:
    """A class of CLASSES; 1 for a tone, _ for a marker, 0 for what is no sound. Stop and fricative joined are affricates."""
    if sound in MARKERS:
        return "_"
    own = _own(sound)
    if own[0] in TONES:
        return "1"
    plain = "".join(c for c in unicodedata.normalize("NFD", own) if not unicodedata.combining(c) and c not in "͜͡ːˑ")
    kinds = [_CLASS_OF.get(c) or _CLASS_OF.get(p) for c, p in zip([own[0], *plain[1:]], plain)]
    if kinds and kinds[0] in ("T", "K") and len(kinds) > 1 and kinds[1] == "S":
        return "C"
    return (kinds[0] if kinds else None) or ("K" if own[0].isalpha() else "0")


@lru_cache(maxsize=1 << 18)
def similarity(a: str, b: str) -> float:
    """1 for equal sounds, less by the way between their classes; consonants and vowels are apart but for glides."""
    if a == b or _own(a) == _own(b):
        return 1.0
    x, y = sound_class(a), sound_class(b)
    if x == y:
        return SAME_CLASS if x not in "0_" else 0.0
    if x not in CLASSES or y not in CLASSES:
        return NEVER if "1" in (x, y) or "_" in (x, y) else ACROSS
    across = (x in "IEAYOU") != (y in "IEAYOU")
    if across and _FAR[x, y] > 1.5:
        return ACROSS
    return max(LEAST, SAME_CLASS - STEP * _FAR[x, y] - (STEP if across else 0.0))


@lru_cache(maxsize=1 << 16)
def sonority(sound: str) -> int:
    """As phonology.sonority."""
    if sound in MARKERS:
        return 9
    c = _own(sound)[0]
    for level, letters in ((7, VOWELS), (8, TONES), (5, GLIDES), (4, LIQUIDS), (3, NASALS), (2, FRICATIVES)):
        if c in letters:
            return level
    return 1 if c.isalpha() else 0


def profile(sounds: Sequence[str]) -> str:
    """A letter a sound, as phonology.prosody with the model ps."""
    s, out = [9, *map(sonority, sounds), 9], []
    for before, here, after in zip(s, s[1:], s[2:]):
        rising, first, last = 1 <= after <= 7 and after >= here, before >= 8, after >= 8
        if here >= 7:
            out.append("+" if here == 9 else "T" if here == 8 else "X" if first else "Z" if last else "Y")
        else:
            out.append(("A" if first else "B") if rising else "N" if last else "L" if first else "M")
    return "".join(out)


def path(score: Sequence[Sequence[float]], gaps_a: Sequence[float], gaps_b: Sequence[float], extend: float = 0.5, ends_free: bool = False) -> tuple[list[tuple[int | None, int | None]], float]:
    """The best way through a matrix of scores, and its sum: pairs of places, None for a gap.

    A gap has the price of the sound that stands against it, times `extend` if the one before it in the same word is a gap too;
    with ends_free gaps at either end of the whole cost nothing. From the end on, a match is preferred to a gap in the second word,
    and that to one in the first.
    """
    n, m, low = len(gaps_a), len(gaps_b), float("-inf")
    width = m + 1
    best: list[tuple[float, float, float]] = []
    came: list[tuple[int, int, int]] = []
    for i in range(n + 1):
        edge = ends_free and i in (0, n)
        for j in range(width):
            if not i and not j:
                best.append((0.0, low, low))
                came.append((0, 0, 0))
                continue
            match = up = left = low
            a = b = c = 0
            if i and j:
                x, y, z = best[-width - 1]
                a = 0 if x >= y and x >= z else 1 if y >= z else 2
                match = (x, y, z)[a] + score[i - 1][j - 1]
            if i:
                x, y, z = best[-width]
                price = 0.0 if ends_free and j in (0, m) else gaps_a[i - 1]
                x, y, z = x + price, y + price * extend, z + price
                b = 0 if x >= y and x >= z else 1 if y >= z else 2
                up = (x, y, z)[b]
            if j:
                x, y, z = best[-1]
                price = 0.0 if edge else gaps_b[j - 1]
                x, y, z = x + price, y + price, z + price * extend
                c = 0 if x >= y and x >= z else 1 if y >= z else 2
                left = (x, y, z)[c]
            best.append((match, up, left))
            came.append((a, b, c))
    x, y, z = best[-1]
    state = 0 if x >= y and x >= z else 1 if y >= z else 2
    total, i, j, out = best[-1][state], n, m, []
    while i or j:
        k = came[i * width + j][state]
        out.append((i - 1 if state != 2 else None, j - 1 if state != 1 else None))
        i, j, state = i - (state != 2), j - (state != 1), k
    return out[::-1], total


def alike(x: tuple[str, str], y: tuple[str, str]) -> float:
    """How alike two sounds with their places are: a match counts more in the same place."""
    s = similarity(x[0], y[0])
    return s * (1 + SAME_PLACE) if x[1] == y[1] and s > 0 else s


def align(a: Sequence[str], b: Sequence[str], gop: float = -1.0, extend: float = 0.5, mode: str = "global") -> tuple[list[str], list[str], float]:
    """Two gapped words and their score; mode is global, or overlap: gaps at either end cost nothing."""
    u, v = list(zip(a, profile(a))), list(zip(b, profile(b)))
    way, total = path([[alike(x, y) for y in v] for x in u], [gop * WEIGHTS[p] for _, p in u], [gop * WEIGHTS[q] for _, q in v], extend, _free(mode))
    return [a[i] if i is not None else "-" for i, _ in way], [b[j] if j is not None else "-" for _, j in way], total


def _free(mode: str) -> bool:
    if mode not in ("global", "overlap"):
        raise ValueError("mode must be global or overlap")
    return mode == "overlap"


def paths(score: np.ndarray, gaps_a: np.ndarray, gaps_b: np.ndarray, extend: float = 0.5, ends_free: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """path for many pairs of words of n and m sounds at once: score (pairs, n, m), gaps (pairs, n) and (pairs, m).

    Returns the sums and, from the last column to the first, which state each pair was in: 0 a match, 1 a gap in the second word, 2 one
    in the first, -1 before its start.
    """
    pairs, n, m = score.shape
    best = np.full((n + 1, m + 1, 3, pairs), -np.inf)
    came = np.zeros((n + 1, m + 1, 3, pairs), np.int8)
    best[0, 0, 0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                k = best[i - 1, j - 1].argmax(0)
                best[i, j, 0], came[i, j, 0] = best[i - 1, j - 1].max(0) + score[:, i - 1, j - 1], k
            for state, price, before, free in ((1, gaps_a[:, i - 1] if i else None, best[i - 1, j], j in (0, m)), (2, gaps_b[:, j - 1] if j else None, best[i, j - 1], i in (0, n))):
                if price is not None:
                    price = np.zeros(pairs) if ends_free and free else price
                    ways = before + price
                    ways[state] = before[state] + price * extend
                    best[i, j, state], came[i, j, state] = ways.max(0), ways.argmax(0)
    total, state, every = best[n, m].max(0), best[n, m].argmax(0), np.arange(pairs)
    i, j, out = np.full(pairs, n), np.full(pairs, m), []
    while (open_ := (i > 0) | (j > 0)).any():
        out.append(np.where(open_, state, -1))
        k = came[i, j, state, every]
        i, j, state = i - (open_ & (state != 2)), j - (open_ & (state != 1)), np.where(open_, k, state)
    return total, np.array(out, np.int8).reshape(len(out), pairs)


Item = tuple[str, str]


def align_pairs(first: Sequence[Sequence[str]], second: Sequence[Sequence[str]], gop: float = -1.0, extend: float = 0.5, mode: str = "global", score: Callable[[Item, Item], float] = alike, price: Callable[[Item, int], float] | None = None, columns: bool = False) -> tuple[np.ndarray, list]:
    """The scores of many pairs of words, and if wanted the columns of each: pairs of (sound, place), ("-", "") for a gap.

    Pairs of the same lengths are aligned together. score is of two sounds with their places, price of a sound that stands against a
    gap, with 0 or 1 for the word it is in; by default gop by the weight of its place.
    """
    price = price or (lambda x, side: gop * WEIGHTS[x[1]])
    items: dict[Item, int] = {}
    coded = [[[items.setdefault(x, len(items)) for x in zip(w, profile(w))] for w in words] for words in (first, second)]
    names, size = list(items), len(items)
    prices = [np.array([price(x, side) for x in names]) for side in (0, 1)]
    totals, made = np.zeros(len(coded[0])), [[] for _ in coded[0]] if columns else []
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (a, b) in enumerate(zip(*coded)):
        groups.setdefault((len(a), len(b)), []).append(k)
    for (n, m), held in groups.items():
        for low in range(0, len(held), 20_000):
            some = held[low : low + 20_000]
            a, b = (np.array([side[k] for k in some], np.int64).reshape(len(some), width) for side, width in zip(coded, (n, m)))
            kinds, place = np.unique(a[:, :, None] * size + b[:, None, :], return_inverse=True)
            known = np.array([score(names[k // size], names[k % size]) for k in kinds.tolist()])
            cells = known[place.ravel()].reshape(len(some), n, m) if n and m else np.zeros((len(some), n, m))
            totals[some], states = paths(cells, prices[0][a], prices[1][b], extend, _free(mode))
            if columns:
                for at, (k, way) in enumerate(zip(some, states.T[:, ::-1].tolist())):
                    x, y, out = iter(a[at].tolist()), iter(b[at].tolist()), made[k]
                    for s in way:
                        if s >= 0:
                            out.append((names[next(x)] if s != 2 else ("-", ""), names[next(y)] if s != 1 else ("-", "")))
    return totals, made


def distances(first: Sequence[Sequence[str]], second: Sequence[Sequence[str]], gop: float = -1.0, extend: float = 0.5, mode: str = "global") -> np.ndarray:
    """1 - 2 x score / (what both words score with themselves) for many pairs, from 0 for equal words to 1; 1 if one has no sounds."""
    sizes = np.array([[len(a), len(b)] for a, b in zip(first, second)], float).reshape(-1, 2)
    totals = align_pairs(first, second, gop, extend, mode)[0]
    far = np.clip(1 - 2 * totals / np.maximum((1 + SAME_PLACE) * sizes.sum(1), 1e-9), 0.0, 1.0)
    return np.where((sizes == 0).all(1), 0.0, np.where((sizes == 0).any(1), 1.0, far))


def guide_tree(far: np.ndarray, tree: str = "upgma") -> list[tuple[int, int]]:
    """The order in which items are joined, each time two heads; the smaller goes on as the head of both.

    upgma joins the closest by mean distance, nj (neighbour joining) those that are close for how far they are from all others.
    """
    if tree not in ("upgma", "nj"):
        raise ValueError("tree must be upgma or nj")
    far = [[float(x) for x in row] for row in far]
    heads, sizes, out = list(range(len(far))), [1] * len(far), []
    while len(heads) > 1:
        if tree == "upgma" or len(heads) < 3:
            _, i, j = min((round(far[i][j], 9), i, j) for at, i in enumerate(heads) for j in heads[at + 1 :])
        else:
            rest = {i: sum(far[i][j] for j in heads) for i in heads}
            _, i, j = min((round((len(heads) - 2) * far[i][j] - rest[i] - rest[j], 9), i, j) for at, i in enumerate(heads) for j in heads[at + 1 :])
        for k in heads:
            if k not in (i, j):
                far[i][k] = far[k][i] = (sizes[i] * far[i][k] + sizes[j] * far[j][k]) / (sizes[i] + sizes[j]) if tree == "upgma" else (far[i][k] + far[j][k] - far[i][j]) / 2
        sizes[i] += sizes[j]
        heads.remove(j)
        out.append((i, j))
    return out


Column = tuple[tuple[str, str], ...]


@lru_cache(maxsize=1 << 18)
def _columns_alike(p: Column, q: Column, gop: float) -> float:
    """The mean over the pairs of two columns' entries; a sound against a gap has half the price of a gap."""
    total = 0.0
    for x in p:
        for y in q:
            if x[1] and y[1]:
                total += alike(x, y)
            elif x[1] or y[1]:
                total += gop * WEIGHTS[x[1] or y[1]] / 2
    return total / (len(p) * len(q))


@lru_cache(maxsize=1 << 16)
def _column_price(p: Column, gop: float) -> float:
    return gop * sum(WEIGHTS[place] for _, place in p if place) / len(p)


def far_apart(words: Sequence[Sequence[Sequence[str]]], gop: float = -1.0, extend: float = 0.5) -> list[np.ndarray]:
    """For lists of words the matrix of their distances, each different pair aligned once for all lists."""
    lists = [[tuple(w) for w in held] for held in words]
    pairs: dict[tuple, int] = {}
    places = [[pairs.setdefault((held[i], held[j]), len(pairs)) for i in range(len(held)) for j in range(i)] for held in lists]
    known = distances([a for a, _ in pairs], [b for _, b in pairs], gop, extend)
    out = []
    for held, at in zip(lists, places):
        far, (one, other) = np.zeros((len(held), len(held))), np.tril_indices(len(held), -1)
        far[one, other] = far[other, one] = known[at] if at else 0.0
        out.append(far)
    return out


def align_many(words: Sequence[Sequence[str]], gop: float = -1.0, extend: float = 0.5, tree: str = "upgma", far: np.ndarray | None = None) -> list[list[str]]:
    """Progressive alignment: words, then columns of words, are joined in the order of the guide tree of their distances.

    Two columns score the mean over their pairs of sounds, half the price of a gap for a sound against a gap; a gap against a column
    has the mean price of its sounds.
    """
    if not words:
        return []
    far = far_apart([words], gop, extend)[0] if far is None else far
    # A column is a (sound, place) for each word of its group, ("-", "") for a gap.
    groups = {i: ([i], [((s, p),) for s, p in zip(w, profile(w))]) for i, w in enumerate(words)}
    for i, j in guide_tree(far, tree):
        (a, p), (b, q) = groups[i], groups.pop(j)
        way, _ = path([[_columns_alike(x, y, gop) for y in q] for x in p], [_column_price(x, gop) for x in p], [_column_price(y, gop) for y in q], extend)
        none_a, none_b = (("-", ""),) * len(a), (("-", ""),) * len(b)
        groups[i] = (a + b, [(p[x] if x is not None else none_a) + (q[y] if y is not None else none_b) for x, y in way])
    order, columns = groups[0]
    rows: list[list[str]] = [[] for _ in words]
    for place, which in enumerate(order):
        rows[which] = [c[place][0] for c in columns]
    return rows
