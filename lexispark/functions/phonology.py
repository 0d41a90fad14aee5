"""Sound classes of IPA symbols, as a lookup in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.functions.sequences import bound

#: Base letters of the IPA by class.
VOWELS = "aeiouyɑɐɒæəɘɚɛɜɝɞɤɨɪɔɵœɶøʉʊʌʏɯʅʮɿʯᴀᴇãẽĩõũåäëïöüàáâèéêìíîòóôùúûāēīōū"
TONES = "⁰¹²³⁴⁵⁶⁷⁸⁹˥˦˧˨˩0123456789₁₂₃₄₅"
GLIDES = "jwɥɰʋ"
LIQUIDS = "lrɹɾɽʀʁɭɺɻʎʟɫɬɮ"
NASALS = "mnŋɲɳɴɱṅñ"
FRICATIVES = "szfvθðʃʒʂʐçʝxɣχħʕhɦɸβɕʑ"
MARKERS = "_+◦#"


def main_letter(sound: Column) -> Column:
    """The first letter of a sound after its slash, without marks that stand before letters."""
    parts = F.split(sound, "/")
    own = F.when((F.size(parts) > 1) & (parts[1] != ""), parts[1]).otherwise(sound)
    letter = F.substring(F.regexp_replace(own, "^[ˈˌ'ʼʰⁿᵐᵑ!?]+(?=.)", ""), 1, 1)
    return F.when(F.length(sound) == 1, sound).otherwise(letter)


def _class_of(sound: Column, c: Column) -> Column:
    """The class of a sound with the main letter c."""
    return (
        F.when(sound.isin(*MARKERS), sound)
        .when(c.isin(*VOWELS), "V")
        .when(c.isin(*TONES), "T")
        .when(c.rlike(r"\p{L}"), "C")
        .otherwise("0")
    )


def sound_class(sound: Column) -> Column:
    """C, V or T (tone); markers as they are; 0 for a gap or what is no letter."""
    return bound(main_letter(sound), lambda c: _class_of(sound, c))


def sonority(sound: Column) -> Column:
    """1 stop, 2 fricative, 3 nasal, 4 liquid, 5 glide, 7 vowel, 8 tone, 9 marker, 0 other."""

    def degree(c: Column, kind: Column) -> Column:
        return (
            F.when(kind == "V", 7).when(kind == "T", 8).when(sound.isin(*MARKERS), 9).when(kind == "0", 0)
            .when(c.isin(*GLIDES), 5).when(c.isin(*LIQUIDS), 4).when(c.isin(*NASALS), 3).when(c.isin(*FRICATIVES), 2).otherwise(1)
        )

    return bound(main_letter(sound), lambda c: bound(_class_of(sound, c), lambda kind: degree(c, kind)))


def prosody(tokens: Column, model: str = "CcV") -> Column:
    """One letter per sound from its sonority and its neighbours'.

    CcV: C a consonant in ascending sonority (also initial), c one in descending sonority, V, T, and + for markers.
    ps: A/B first consonant of a word/other ascending, L/M/N descending (M inside, N last), X/Y/Z vowel (first of the
    word, inside, last), T tone, + marker.
    """

    def letters(s: Column) -> Column:
        def letter(here: Column, i: Column) -> Column:
            after, before = F.coalesce(F.get(s, i + 1), F.lit(9)), F.coalesce(F.get(s, i - 1), F.lit(9))
            rising = after.between(1, 7) & (after >= here)
            first, last = (i == 0) | (before >= 8), (i == F.size(s) - 1) | (after >= 8)
            if model == "CcV":
                return F.when(here == 9, "+").when(here == 8, "T").when(here == 7, "V").when(rising | (first & ~last), "C").otherwise("c")
            vowel = F.when(first, "X").when(last, "Z").otherwise("Y")
            return F.when(here == 9, "+").when(here == 8, "T").when(here == 7, vowel).when(rising & first, "A").when(rising, "B").when(last, "N").when(first, "L").otherwise("M")

        return F.transform(s, letter)

    return bound(F.transform(tokens, sonority), letters)


def structure(tokens: Column, model: str = "cv") -> Column:
    """Classes of the sounds: cv (c, v, t), c (vowels and tones count as c too), CcV or ps."""
    if model == "cv":
        return F.transform(tokens, lambda t: F.lower(sound_class(t)))
    if model == "c":
        return F.transform(tokens, lambda t: bound(sound_class(t), lambda k: F.when(k.isin("C", "V", "T"), "c").otherwise(F.lower(k))))
    if model in ("CcV", "ps"):
        return prosody(tokens, model)
    raise ValueError("model must be cv, c, CcV, ps (or nogap, see add_structure)")
