"""Source divergence, quality rules and conversation repair against brute force, with odd rows in the tables."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexispark.llm import conversations as C
from lexispark.llm import rules as R
from lexispark.llm.divergence import source_divergence

DOCUMENTS = "doc_id long, text string, lang string, source string, term string, p long, rank string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], DOCUMENTS)


# Source divergence


def divergence(rows):
    """(lang, source, part, item, value, rank) by the definition, over every term and pair."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= 10)
        groups = {s: Counter(t for d in mine if d[1] == s for t in d[2] if seen[t] >= 10) for s in {d[1] for d in mine}}
        whole = sum(groups.values(), Counter())

        def shares(counts):
            n = sum(counts.values())
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        apart = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        for s in groups:
            pairs = [(o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, apart(p[s][t], q[t])) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def source_rows(seed, n=400, sources=9):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefÄéñ") for _ in range(rng.randint(1, 4))) for _ in range(80)]
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 4 + [f"s{k}" for k in range(sources)] + [None, ""])
        text = rng.choice(["-", " ", "\n", "1"]).join(rng.choice(words[: 20 + 7 * (len(source or "") % 9)]).upper() if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 30)))
        rows.append((i // 2, rng.choice([text, text, text, None, ""]), rng.choice(["en", "en", "de", None]), source))
    return rows + [(1, "seldom words", "xx", "only"), (2, None, "xx", "other"), (3, "", "yy", "lone")] + [(5, "again again", "en", "copies")] * 30


@pytest.mark.parametrize("seed,sizes", [(1, {}), (2, {"tile": 3, "part": 40, "counts": 5})])
def test_divergence(spark, seed, sizes):
    rows = source_rows(seed)
    found = source_divergence(documents(spark, rows), **sizes)
    assert sorted(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect()) == divergence(rows)


def test_divergence_of_nothing(spark):
    assert source_divergence(documents(spark, [])).count() == 0
    found = source_divergence(documents(spark, [(None, None, None, None), (None, "a", None, "b")]))
    assert sorted(map(tuple, found.collect())) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_shares_of_large_counts(spark):
    """Counts for which 1000000000 times the count has no place in 64 bits."""
    from lexispark.llm.divergence import _share, share

    import numpy as np

    pairs = [(0, 2), (5, 9), (10**12, 3 * 10**12), (8 * 10**15, 9 * 10**15), (10**15, 9 * 10**15 + 7)]
    df = spark.createDataFrame(pairs, "n long, total long")
    got = [r[0] for r in df.select(share(F.col("n"), F.col("total"))).collect()]
    want = [1 + 10**9 * (n + 2) // t for n, t in pairs]
    assert got == want == [int(_share(np.array([n]), np.array([t]))[0]) for n, t in pairs]


# Quality rules


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def rule_texts(seed):
    rng = random.Random(seed)
    words = ["the", "Übung", "a", "日本", "x#y", "###", "loud!!", "\x00", "é" * 30, "mañana", "1234"]
    texts = [None, "", " \n\t ", "\n\n\n", "one", "a b c d e " * 9, "word " * 50, "ÄÖ\x0bb\x0cc\rd", "long " * 30_000]
    for _ in range(150):
        n, some = rng.randint(0, 60), rng.sample(words, rng.randint(1, 9))
        texts.append("".join(rng.choice(some) + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(n)))
    return texts + ["".join(rng.choice("abcdefgh") + rng.choice("aeiou") + ("" if rng.random() < 0.5 else " ") for _ in range(300)) for _ in range(30)]


def test_rules(spark):
    texts = rule_texts(3)
    rows = [(None if i % 10 == 0 else i // 2, t, "en", "s") for i, t in enumerate(texts)]
    found = R.judge(documents(spark, rows).repartition(3)).collect()
    assert [c for c in found[0].asDict()] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = Counter((i, *base(t), (b := base(t))[0] < 10 or 100 * b[4] > 20 * b[0]) for i, t, *_ in rows)
    assert Counter(tuple(r)[:-1] for r in found) == want
    assert not any(r.kept and r.base_failed for r in found) and any(r.kept for r in found)
    assert any(not r.kept and not r.base_failed for r in found)


def test_order_never_changes_the_verdict(spark):
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(rule_texts(4))])
    verdicts = [sorted((r.doc_id, r.kept) for r in R.cascade(docs, some, sample=n).collect()) for some, n in ((R.RULES, 2000), (R.RULES[::-1], 10), (R.RULES[3:] + R.RULES[:3], 0))]
    assert verdicts[0] == verdicts[1] == verdicts[2]


def test_rules_in_order_of_rejections_for_their_cost():
    measured = R.Measured({0b000: 50, 0b001: 10, 0b011: 20, 0b100: 15, 0b111: 5}, [1.0, 0.5, 3.0])
    assert R.in_order(measured) == [1, 0, 2]  # 25 for half a second; then 10 more a second; then 15 for three
    assert R.in_order(R.Measured({0: 9}, [3.0, 1.0, 2.0])) == [1, 2, 0]
    assert R.in_order(R.Measured({}, [])) == []


def test_rules_see_only_what_is_left():
    texts = R.Texts([b"a b c", b"word " * 20])
    import numpy as np

    assert texts.measure("n_repeat_words", np.array([1])).tolist() == [20]
    assert texts._known["n_repeat_words"][1].tolist() == [False, True] and texts._words[0] is None


def test_rules_of_nothing(spark):
    assert R.judge(documents(spark, [])).count() == 0


# Conversation repair


def repaired(rows):
    """The result for one conversation by cheapest edits with their letters written out from the end."""
    seen, faults, initials = set(), [], []
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
        initials.append(role[:1])
    turn = {"0": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    legal = {("0", "s"), ("0", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    best = {"0": (0, "", ()), "a": (0, "", ()), "u": (3, "I", ("assistant:",)), "s": (6, "II", ("user:", "assistant:"))}
    for (_, role, text), fault, initial in reversed(list(zip(rows, faults, initials))):
        late, new = 3 * (fault == "t"), {}
        for q in "0sua":
            ways = [(best[q][0] + 4, "D" + best[q][1], best[q][2])]
            if fault not in ("b", "d"):
                if (q, initial) in legal:
                    c, a, r = best[initial]
                    ways.append((c + late, "K" + a, (f"{role}:{text}", *r)))
                c, a, r = best[turn[q]]
                ways.append((c + late + 3, "R" + a, (f"{name[turn[q]]}:{text}", *r)))
            new[q] = min(ways)
        for _ in range(3):
            new = {q: min(new[q], (new[turn[q]][0] + 3, "I" + new[turn[q]][1], (f"{name[turn[q]]}:", *new[turn[q]][2]))) for q in new}
        best = new
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, lines = best["0"]
    return (gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


CONVERSATIONS = "conv_id long, turn long, role string, text string, number long, block string"


def turns(seed, conversations=60, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        conv = None if c == 3 else c
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "sage", "ü"])
            text = rng.choice(["Yes.", "No!", "cut off", "cut off", None, "", " \n", "What?  ", "é.", "a:b\nc."]) if rng.random() < 0.8 else f"Some {t}."
            rows.append((conv, rng.choice([t, t, t, t + 3, None]), role, text))
    return rows + rows[:7]


def plain(rows):
    return [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]


@pytest.mark.parametrize("seed,bits", [(1, 10), (2, 2), (3, 0)])
def test_repair(spark, monkeypatch, seed, bits):
    """Also where blocks are so short that most conversations have several."""
    monkeypatch.setattr(C, "BLOCK_BITS", bits)
    rows = plain(turns(seed))
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], CONVERSATIONS).withColumn("there", F.lit(True))
    found = {r.conv_id: tuple(r)[1:] for r in C.repair(df.select("conv_id", "turn", "role", "text", "there")).collect()}
    assert found == {c: repaired([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}


def test_a_long_conversation(spark):
    """One conversation over many blocks and partitions."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system", "tool"]), f"Turn {rng.randrange(9000)}" + rng.choice([".", "", "?"])) for t in range(6000)]
    df = spark.createDataFrame(rows + [(8, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string").withColumn("there", F.lit(True))
    found = {r.conv_id: tuple(r)[1:] for r in C.repair(df).collect()}
    assert found[7] == repaired([r[1:] for r in rows]) and found[8] == repaired([(0, "user", "Hi.")])


def test_damage(spark):
    import zlib

    rows = turns(4, 80)
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], CONVERSATIONS)
    want = Counter()
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind < 2 else re.sub("[.!?]", "", text) if kind == 2 else text
        want[(c, t, "user" if kind == 4 else role, text, kind != 0)] += 2 if kind == 3 else 1
    harmed = C.damage(df)
    assert Counter(map(tuple, harmed.collect())) == want
    found = {r.conv_id: tuple(r)[1:] for r in C.repair(harmed).collect()}
    left = {c: [k[1:4] for k, n in want.items() for _ in range(n) if k[0] == c and k[4]] for c in {r[0] for r in rows}}
    assert found == {c: repaired(some) for c, some in left.items()}


def test_conversations_without_rows(spark):
    df = spark.createDataFrame([(1, 2, "user", "x", False), (None, None, "", "", False)], "conv_id long, turn long, role string, text string, there boolean")
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {tuple(r) for r in C.repair(df).collect()} == {(1, *empty), (None, *empty)}
    assert C.repair(df.limit(0)).count() == 0
