"""Column expressions over sound sequences: arrays of strings with gaps, slashes and dots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

GAP, MISSING, UNKNOWN = "-", "Ø", "?"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is computed once: what stands in a lambda is otherwise computed for each item, wherever it stands."""
    return F.transform(F.array(value), f)[0]


def second_of_slash(sound: Column) -> Column:
    """The part after the first slash of a/b; a sound without a slash as it is."""
    parts = F.split(sound, "/")
    return F.when(F.size(parts) > 1, parts[1]).otherwise(sound)


def clean_sound(sound: Column) -> Column:
    """second_of_slash for each dot-joined part."""
    return F.array_join(F.transform(F.split(sound, r"\."), second_of_slash), ".")


def unjoin(sounds: Column) -> Column:
    """Dot-joined sounds as sounds of their own."""
    return F.flatten(F.transform(sounds, lambda s: F.split(s, r"\.")))


def alignment_to_tokens(sounds: Column, gap: str = GAP) -> Column:
    """Unjoined sounds without gaps, cleaned."""
    return F.transform(F.filter(unjoin(sounds), lambda s: s != gap), clean_sound)


def matches(a: Column, b: Column, missing: str = MISSING, gap: str = GAP) -> Column:
    """Positions where two patterns of the same length agree on a sound (not on a gap), both attested."""
    return F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: (z["a"] == z["b"]) & ~z["a"].isin(missing, gap)))


def mismatches(a: Column, b: Column, missing: str = MISSING) -> Column:
    """Positions where two attested entries differ."""
    return F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: (z["a"] != z["b"]) & (z["a"] != missing) & (z["b"] != missing)))


def merge_patterns(a: Column, b: Column, missing: str = MISSING) -> Column:
    """The entries of a, and those of b where a has none."""
    return F.zip_with(a, b, lambda x, y: F.when(x == missing, y).otherwise(x))


def is_subsequence(source: Column, target: Column) -> Column:
    """Whether the items of source come in target in this order, with any others between."""
    return F.aggregate(target, F.lit(0), lambda at, x: F.when(F.get(source, at) == x, at + 1).otherwise(at)) == F.size(source)


def columns_of(pattern: Column) -> Column:
    """Entries that are not missing."""
    return F.filter(pattern, lambda x: x != MISSING)


def ngrams(tokens: Column, n: int) -> Column:
    """Padded n-grams: n - 1 boundary marks on either side."""
    if n == 1:
        return F.transform(tokens, lambda t: F.array(t))
    edge = F.array_repeat(F.lit("$"), n - 1)
    padded = F.concat(edge, tokens, edge)
    return F.transform(F.sequence(F.lit(1), F.size(padded) - n + 1), lambda i: F.slice(padded, i, n))


def bleu(word: Column, reference: Column, n: int = 4, weights: list[float] | None = None, trim: bool = True) -> Column:
    """n-gram precision of a word against a reference, with a brevity penalty.

    For each order the reference's count of every n-gram type of the word is divided by the word's n-grams;
    orders are combined by a weighted geometric mean. Counts aren't clipped, so repeated references can exceed 1.
    trim leaves out n-grams that touch the boundary. An empty word has no score (null).
    """
    weights = weights or [1 / n] * n
    total: Column = F.lit(1.0)
    for k in range(1, n + 1):
        w, r = ngrams(word, k), ngrams(reference, k)
        if trim and k > 1:
            w, r = (F.slice(x, k, F.greatest(F.size(x) - 2 * (k - 1), F.lit(0))) for x in (w, r))
        types = F.array_distinct(w)
        hits = F.size(F.filter(r, lambda g: F.array_contains(types, g)))
        total = total * F.pow(F.try_divide(hits.cast("double"), F.size(w).cast("double")), F.lit(float(weights[k - 1])))
    short = F.when(F.size(word) > F.size(reference), 1.0).otherwise(F.exp(1 - F.try_divide(F.size(reference).cast("double"), F.size(word).cast("double"))))
    return short * F.pow(total, F.lit(1.0 / sum(weights)))


def spread_classes(structure: Column, alignment: Column, gap: str = GAP) -> Column:
    """Classes of the ungapped sounds laid out over the alignment; gaps stay gaps."""
    places = F.filter(F.transform(alignment, lambda x, i: F.when(x != gap, i)), lambda i: i.isNotNull())  # of the sounds
    laid = lambda a, s, at: F.transform(a, lambda x, i: F.when(x == gap, gap).otherwise(F.get(s, (F.array_position(at, i) - 1).cast("int"))))
    return bound(alignment, lambda a: bound(structure, lambda s: bound(places, lambda at: laid(a, s, at))))


def template_places(structure: Column, template: str) -> Column:
    """For each template slot the 1-based token it takes, or 0: tokens take the next slot of their class in order."""
    slots = F.array(*[F.lit(c) for c in template])
    start = F.struct(F.lit(1).alias("next"), F.expr("cast(array() as array<int>)").alias("places"))

    def step(state: Column, slot: Column) -> Column:
        hit = F.coalesce(F.get(structure, state["next"] - 1) == slot, F.lit(False))
        return F.struct(
            F.when(hit, state["next"] + 1).otherwise(state["next"]).alias("next"),
            F.concat(state["places"], F.array(F.when(hit, state["next"]).otherwise(0))).alias("places"),
        )

    return F.aggregate(slots, start, step, lambda s: s["places"])


def align_to_template(tokens: Column, structure: Column, template: str, gap: str = GAP) -> Column:
    """Tokens in the slots of their classes, gaps elsewhere. Tokens out of the template's order are dropped.

    Fails if tokens and classes differ in number, if there are more tokens than slots, or if a class has no slot.
    """

    def placed(t: Column, s: Column) -> Column:
        bad = (F.size(t) != F.size(s)) | (F.size(t) > len(template)) | F.exists(s, lambda c: ~c.isin(*template))
        slots = F.transform(template_places(s, template), lambda p: F.when(p == 0, gap).otherwise(F.get(t, p - 1)))
        return F.when(bad, F.raise_error(F.lit("tokens and structure don't fit the template")).cast("array<string>")).otherwise(slots)

    return bound(tokens, lambda t: bound(structure, lambda s: placed(t, s)))


def shrink(tokens: Column, structure: Column, converter: dict[str, str]) -> Column:
    """struct(tokens, structure) with neighbouring pairs of classes merged, or single classes renamed, by a converter.

    Looks at each pair in turn. A pair in the converter is merged; the sound before a pair that isn't is kept alone,
    unless it has just been merged; so pairs that overlap yield two merged sounds. No tokens give empty arrays.
    """
    table = F.create_map(*[F.lit(x) for pair in converter.items() for x in pair])
    rename = lambda c: F.coalesce(F.element_at(table, c), c)
    blank = F.expr("cast(array() as array<string>)")
    start = F.struct(blank.alias("tokens"), blank.alias("structure"), F.lit(False).alias("merged"))

    def add(state: Column, token: Column, kind: Column, merged: Column) -> Column:
        return F.struct(F.concat(state["tokens"], F.array(token)).alias("tokens"), F.concat(state["structure"], F.array(kind)).alias("structure"), merged.alias("merged"))

    def step(state: Column, i: Column) -> Column:
        before, here = F.get(structure, i - 1), F.get(structure, i)
        pair = F.element_at(table, F.concat_ws(" ", before, here))
        skip = F.struct(state["tokens"].alias("tokens"), state["structure"].alias("structure"), F.lit(False).alias("merged"))
        return (
            F.when(pair.isNotNull(), add(state, F.concat(F.get(tokens, i - 1), F.get(tokens, i)), pair, F.lit(True)))
            .when(state["merged"], skip)
            .otherwise(add(state, F.get(tokens, i - 1), rename(before), F.lit(False)))
        )

    n = F.size(tokens)
    pairs = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: i < n)

    def last(state: Column) -> Column:
        end = F.struct(F.concat(state["tokens"], F.array(F.element_at(tokens, -1))).alias("tokens"), F.concat(state["structure"], F.array(rename(F.element_at(structure, -1)))).alias("structure"))
        return F.when(state["merged"] | (n == 0), F.struct(state["tokens"].alias("tokens"), state["structure"].alias("structure"))).otherwise(end)

    return F.aggregate(pairs, start, step, last)


def gap_count(sounds: Column, gap: str = GAP) -> Column:
    """How many entries are gaps."""
    return F.size(F.filter(sounds, lambda x: x == gap))


def sound_edit_distance(a: str, b: str, normalized: bool = False) -> Column:
    """Levenshtein distance over sounds of two columns, if wanted divided by the longer length.

    The different sounds of the two are written as one letter each, so that the built-in distance of texts counts sounds.
    """
    known = F.array_distinct(F.concat(F.col(a), F.col(b)))
    letters = lambda c: F.array_join(F.transform(F.col(c), lambda x: F.format_string("%c", F.array_position(known, x).cast("int") + 0x4E00)), "")
    far = F.levenshtein(letters(a), letters(b))
    return far / F.greatest(F.size(a), F.size(b), F.lit(1)) if normalized else far
