"""Token counts, packing, mixing, fingerprints against plain recounts, with odd rows in the table."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import fingerprints as P
from lexispark.llm.mixing import apply_mix, plan_mix
from lexispark.llm.packing import IdEncoder, Schedule, pack
from lexispark.llm.queries import tokenizer
from lexispark.llm.tokens import PieceCounter, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, part string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x") for i, t, s in rows], SCHEMA)


def odd_rows():
    rng = random.Random(5)
    rows = [(1, None, "a"), (2, "", "a"), (3, " ", None), (4, "\n\n a  b\t", "b"), (5, "<|endoftext|> x <s>", "b"), (6, "é ù z 漢字 🙂", None), (7, "▁a ▁", "a"), (8, "word " * 20_000, "c"), (8, "word " * 20_000, "c"), (None, "no id", "a")]
    return rows + [(i, "".join(rng.choice("ab \n.,'sé1") for _ in range(rng.randint(0, 200))), rng.choice(["a", "a", "a", "b", None])) for i in range(10, 200)]


def key(x):
    return str(x)


def test_token_counts(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    rows = odd_rows()
    got = sorted((tuple(r) for r in token_counts(table(spark, rows), tokenizer("piece_bpe_32k.model"), 100).collect()), key=key)
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for i, t, _ in rows), key=key)
    assert got == want
    assert token_counts(table(spark, rows).where("doc_id < 0"), tokenizer("piece_bpe_32k.model")).count() == 0


def test_counter_with_a_full_cache(monkeypatch):
    from lexispark.llm import tokens

    monkeypatch.setattr(tokens, "CACHE", 5)
    counter = PieceCounter(tokenizer("piece_bpe_32k.model"), {" the": 1})
    texts = ["the a b c d e f g", "h i j\nk l  m", "the the"]
    for t in texts:
        assert counter.count([t]) == [len(counter.library.encode(t))]
    assert counter.count(texts) == [len(x) for x in counter.library.encode(texts)]


def check_pieces(rows, found, length, padding=None):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    ids = defaultdict(list)
    for i, t, _ in rows:
        ids[i].append(np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for i, docs in ids.items():
        covered = defaultdict(int)
        for r in by_doc[i]:
            assert r.doc_tokens == len(docs[0]) and r.ids_crc32 == zlib.crc32(docs[0][r.start : r.start + r.length].tobytes())
            for k in range(r.start, r.start + r.length):
                covered[k] += 1
        assert dict(covered) == {k: len(docs) for k in range(len(docs[0]))}
    for s, rs in by_sequence.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or s == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))


@pytest.mark.parametrize("length, window", [(2048, 64), (64, 1)])
def test_packing(spark, length, window):
    rows = odd_rows()
    check_pieces(rows, pack(table(spark, rows).repartition(5), tokenizer("byte_bpe_50k.json"), length, window).collect(), length)


def test_packing_with_weights_and_nothing(spark):
    rows = [r for r in odd_rows() if r[0] and r[0] != 8]
    check_pieces(rows, pack(table(spark, rows), tokenizer("byte_bpe_50k.json"), 128, 2, {"a": 1, "b": 5}).collect(), 128)
    assert pack(table(spark, rows).where("doc_id < 0"), tokenizer("byte_bpe_50k.json")).count() == 0


def test_many_sources_with_weights(spark):
    """2,000 sources: each keeps its own weight, so early windows hold what the weights say."""
    rows = [(i, "a b c d " * 25, f"s{i % 2000}") for i in range(4000)]
    heavy = {f"s{k}": 9 for k in range(0, 2000, 2)}
    found = pack(table(spark, rows), tokenizer("byte_bpe_50k.json"), 128, 256, heavy)
    found = found.join(table(spark, rows).select("doc_id", "source"), "doc_id").collect()
    check_pieces(rows, found, 128)
    early = [r for r in found if r.sequence_id < 200]
    share = sum(r.length for r in early if r.source in heavy) / sum(r.length for r in early)
    assert abs(share - 0.9) < 0.02


def test_windows_keep_the_proportions():
    totals, window = [70_000, 20_000, 9_990, 10], 1000
    plan = Schedule(totals, totals, window)
    place = np.full(sum(totals), -1)
    for k, n in enumerate(totals):
        for first in range(0, n, 137):
            at = first
            for pos, m in plan.pieces(k, first, min(137, n - first)):
                assert (place[pos : pos + m] == -1).all()
                place[pos : pos + m] = k
                at += m
            assert at == min(first + 137, n)
    assert (place >= 0).all()
    for w in range(90):
        seen = np.bincount(place[w * window : (w + 1) * window], minlength=4)
        assert (abs(seen - np.array(totals) * window / sum(totals)) <= 4).all()


def test_ids_equal_the_library():
    encoder = IdEncoder(tokenizer("byte_bpe_50k.json"))
    assert encoder.quick is not None
    rng = random.Random(2)
    texts = ["".join(rng.choice(" \n\tab'sé.1\xa0　\x1c\x85￮²ªµ×漢🙂") for _ in range(rng.randint(0, 30))) for _ in range(5000)] + ["a<|endoftext|>b", "it's  I'll \n x"]
    texts += ["".join(rng.choice(" \n\ré1'a–’“…€жΩßab.") for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u2").tolist() == encoder.library.encode(t, add_special_tokens=False).ids


def plain_mix(rows, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by sharing the excess again and again."""
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > most * size[s]}
        if not full:
            target.update({s: level * weight[s] for s in free})
            break
        for s in full:
            target[s] = most * size[s]
            left -= target[s]
        free -= full
    return size, target


def test_mixing(spark):
    rows = [r for r in odd_rows() if r[0] != 8]
    size, target = plain_mix(rows)
    found = plan_mix(table(spark, rows)).collect()
    assert sorted(map(key, found)) == sorted(map(key, plan_mix(table(spark, rows[::-1]).repartition(7)).collect()))
    of = {i: (len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows}
    taken, largest = defaultdict(int), defaultdict(int)
    assert len(found) == len(rows)
    for r in found:
        n, s = of[r.doc_id]
        assert (r.size, r.source_size) == (n, size[s]) and r.target == pytest.approx(target[s], rel=1e-12)
        assert r.taken in (0, n, 2 * n)
        taken[s] += r.taken
        largest[s] = max(largest[s], n)
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    mixed = apply_mix(table(spark, rows))
    assert mixed.columns == table(spark, rows).columns
    got = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(got.get(r.doc_id, 0) * r.size == r.taken for r in found if r.size)


def test_texts_under_one_id_and_empty_ones(spark):
    """Texts under one id, or none, are taken one by one, so their source comes near its target; empty ones at most twice."""
    rows = [(i, " ".join(f"w{k}" for k in range(5 + k % 7)), "a") for k, i in enumerate([None] * 200 + [7] * 200)] + [(900 + k, "", "a") for k in range(50)] + [(1000 + k, "x y z " * 9, "b") for k in range(300)]
    rows = [(i, t + f" {k}" if t else t, s) for k, (i, t, s) in enumerate(rows)]
    for r in plan_mix(table(spark, rows)).groupBy(F.when(F.col("source_size") > 0, F.col("target")).alias("target")).agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 30
    n = {r.doc_id: r.n for r in apply_mix(table(spark, rows)).where("text = ''").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(x <= 2 for x in n.values())


def test_mixing_of_nothing(spark):
    assert plan_mix(table(spark, [])).count() == 0
    blank = plan_mix(table(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert all((r.size, r.target, r.taken) == (0, 0.0, 0) for r in blank)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_fingerprints(rows):
    """One document after the other."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (i, t, _) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        n = len(t) // 4
        e = t[: len(t) - n] + after[:n]
        a, b, c = (P.fingerprint(x) for x in (t, e, after))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, plain_likeness(a, b), plain_likeness(a, c)))
    return out


def plain_likeness(x, y):
    if x == y:
        return 1.0
    (p, *u), (q, *v) = ([int(z.split(":")[0]), *z.split(":")[1:]] for z in (x, y))
    pairs = [(a, b) for i, a in enumerate(u) for j, b in enumerate(v) if p * 2**i == q * 2**j and a and b and (p != q or i == j)]
    return max([1 - levenshtein(a, b) / max(len(a), len(b)) for a, b in pairs], default=0.0)


def test_fingerprints(spark):
    rows = [r for r in odd_rows() if r[0] != 8 or r[1] is None] + [(8, "word " * 20_000, "c")]
    got = sorted((tuple(r) for r in P.compare_with_edits(table(spark, rows).repartition(6)).collect()), key=lambda r: str(r[0]))
    want = sorted(plain_fingerprints(rows), key=lambda r: str(r[0]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]])


def test_fingerprints_of_repeated_rows_and_small_parts(spark, monkeypatch):
    """Rows with one id, null ids and a text that fills parts with its copies, over parts of a few rows."""
    monkeypatch.setattr(P.with_next, "__defaults__", (400,))
    rng = random.Random(3)
    rows = [(None, f"none {k} " * 9, "a") for k in range(30)] + [(5, f"five {k} " * 9, "a") for k in range(30)] + [(6, "the same text over and over", "a")] * 40
    rows += [(i, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 90))), "a") for i in range(7, 60)] + [(60, "", "a"), (61, None, "a")]
    found = P.compare_with_edits(table(spark, rows).repartition(5)).collect()
    plain = lambda rs: sorted(map(str, rs))
    assert len(found) == len(rows) and sum(r.doc_id == 6 and r.near_next == 1.0 for r in found) == 39
    own = lambda rs: plain((i, n, f) for i, n, f in rs)
    assert own((r.doc_id, r.n_chars, r.fingerprint) for r in found) == own((i, len(t or ""), P.fingerprint(t or "")) for i, t, _ in rows)
    want = {r[0]: r for r in plain_fingerprints([r for r in rows if (r[0] or 0) > 6])}
    last = max(want)
    for r in found:
        if r.doc_id in want and r.doc_id != last:
            assert r.edited_sha256 == want[r.doc_id][2] and (r.near_edited, r.near_next) == pytest.approx(want[r.doc_id][5:])


def test_fingerprints_of_few(spark):
    assert P.compare_with_edits(table(spark, [])).count() == 0
    (r,) = P.compare_with_edits(table(spark, [(4, "abcdefgh", "a")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1.0
    same = P.compare_with_edits(table(spark, [(4, "abcdefgh", "a")] * 3)).collect()
    assert len(same) == 3 and len({tuple(r) for r in same}) == 1


def test_fingerprint_likeness_follows_edits():
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000))
    near, far = text[:9000] + "XYZ" + text[9000:], "".join(rng.choice("abcdefgh ") for _ in range(12000))
    a, b, c = (P.fingerprint(x) for x in (text, near, far))
    low, high = P.likeness([(a, c), (a, b)])
    assert high > 0.85 > 0.35 > low
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 64))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 64)))) for _ in range(200)]
    assert P.edit_distances(pairs).tolist() == [levenshtein(x, y) for x, y in pairs]
