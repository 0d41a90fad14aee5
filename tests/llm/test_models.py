"""Language ID and quality: held-out accuracy, odd rows; the pipeline stage by stage."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexispark.llm import lang_id as L
from lexispark.llm import quality as Q


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    emit, step, first = rng.random((1, 5, 3)) + 0.1, rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    real = np.array([[True, True, True, True, False]])
    post, pairs = L.forward_backward(emit, real, step, first, pairs=True)
    total, marginal, joint = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in itertools.product(range(3), repeat=4):
        p = first[path[0]] * emit[0, 0, path[0]]
        for i in range(1, 4):
            p *= step[path[i - 1], path[i]] * emit[0, i, path[i]]
        total += p
        for i, k in enumerate(path):
            marginal[i, k] += p
        for a, b in zip(path, path[1:]):
            joint[a, b] += p
    assert np.allclose(post[0, :4], marginal / total) and np.allclose(pairs, joint / total)


@pytest.mark.parametrize("products", [0, 16])
def test_whole_predictions_against_all_paths(monkeypatch, products):
    """A field of three labels with random weights: texts of one to eight words over chains of three, by all labellings."""
    monkeypatch.setattr(L, "CHAIN", 3)
    monkeypatch.setattr(L, "PRODUCTS", products)
    rng = np.random.default_rng(products)
    words = ["ab", "abc", "12", "xyz", "é", "ab,", "q1"]
    model = L.Tagger(["a", "b", "c"], rng.normal(size=(L.FEATURES, 3)).astype(np.float32), rng.normal(size=(3, 3)), rng.normal(size=3), {"^xyz$": 1})
    texts = [" ".join(rng.choice(words, n)) + " ab" for n in range(0, 8) for _ in range(3)]
    for text, (label, score) in zip(texts, model.predict(texts)):
        ws = text.split()
        ids, owners, lettered = L._features(ws, model.lexicon)
        score_of = L._sums(ids, owners, len(ws), model.weights).astype(float)
        total, mass = 0.0, np.zeros(3)
        for path in itertools.product(range(3), repeat=len(ws)):
            p = np.exp(model.first[path[0]] + sum(model.step[a, b] for a, b in zip(path, path[1:])) + sum(max(score_of[i, k] - score_of[i].max(), -30) for i, k in enumerate(path)))
            total += p
            for i, k in enumerate(path):
                mass[k] += p * lettered[i]
        mass /= total
        assert label == model.labels[int(mass.argmax())] and score == pytest.approx(mass.max() / mass.sum(), abs=1e-4)


def test_number_signs_are_no_letters():
    assert [L.has_letter(x) for x in ("½ ² ①", "12 Ⅷ _", "½a", "²é", "漢", "")] == [False, False, True, True, True, False]


def test_many_languages_and_a_very_long_word(spark):
    """Seventy languages with letters of their own: all are learned. A word of a thousand letters counts as a whole."""
    rng = np.random.default_rng(2)
    sets = [[chr(0x4E00 + 40 * k + j) for j in range(6)] for k in range(70)]
    rows = [(i, " ".join("".join(rng.choice(sets[i % 70], 4)) for _ in range(20)), f"l{i % 70:02d}") for i in range(350)]
    rows += [(1000 + k, "".join(rng.choice(sets[k], 41)) + "".join(rng.choice(sets[k + 1], 1000)), None) for k in (3, 60)]
    found = {r.doc_id: r.lang_pred for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(found[i] == f"l{i % 70:02d}" for i in range(350)) > 345
    assert found[1003] == "l04" and found[1060] == "l61"


def test_language_accuracy(spark, docs):
    found = L.identify(docs).where("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right[1] > 150 and right[0] > 0.97


@pytest.mark.parametrize("ids", ["one", "many"])
def test_sample_of_much_repeated_rows(spark, ids):
    """Very many rows of one id, with one text or with texts of their own, bring no more than the sample's bound."""
    own = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("word number "), F.col("id") if ids == "many" else F.lit("")).alias("text"), F.lit("xx").alias("lang"))
    rest = spark.range(10, 30).select(F.col("id").alias("doc_id"), F.concat(F.lit("other text "), "id").alias("text"), F.lit("yy").alias("lang"))
    docs = own.unionByName(rest).withColumn("source", F.lit("s"))
    found = L.training_chains(docs, per_language=50)
    assert len([x for x, _ in found if x == "xx"]) <= (1 if ids == "one" else 100) and found == L.training_chains(docs.repartition(3), per_language=50)
    free = {r.doc_id for r in rest.where(~L.held_out(F.col("doc_id"))).collect()}
    assert sum(x == "yy" for x, _ in found) == len(free)


def test_language_of_switched_text():
    de, en = [["der", "hund", "schläft", "nicht", "und", "ich"]] * 8, [["the", "dog", "sleeps", "where", "and", "why"]] * 8
    model = L.train([("de", w) for w in de] + [("en", w) for w in en])
    words = "der hund schläft nicht the dog sleeps where"
    model.predict([words])
    at = np.array([[model._index[w] for w in words.split()] + [0] * (L.CHAIN - 8)])
    post = L.forward_backward(model._emit[at], at > 0, np.exp(model.step), np.exp(model.first))
    assert post[0, :8].argmax(1).tolist() == [0] * 4 + [1] * 4


def test_odd_languages(spark):
    schema = "doc_id long, text string, lang string, lang_label string"
    rows = [(1, None, "en", "x"), (2, "", "en", "x"), (3, "12 34 !", "en", "x"), (None, "hello there", None, "x"), (5, "é" * 50_000, "en", "x")] + [(i, "the dog and the cat", "en", "x") for i in range(10, 20)]
    found = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(spark.createDataFrame(rows, schema)).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0)
    assert found[10] == ("en", 1.0) and found[None][0] == "en"
    none = L.identify(spark.createDataFrame([(1, "text", None, "x")], schema)).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)
    assert L.identify(spark.createDataFrame([], schema)).count() == 0


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0)
    found = Q.judge(docs, seen).join(labels.join(seen, "doc_id", "left_anti"), "doc_id")
    right = found.agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("int")), F.count("*"), F.avg(F.when(F.col("quality") == 1, F.col("keep").cast("int")))).first()
    assert right[1] > 500 and right[0] > 0.97 and right[2] > 0.97


def test_sparse_hosts_are_shrunk(spark):
    text = lambda good: "plain words in a row here" if good else "### %%% *** $$$ &&& ###"
    rows, labels, i = [], [], 0
    for host, n, share in (("good", 60, 0.9), ("bad", 60, 0.2), ("new", 1, 1.0)):
        for k in range(n):
            good = k < share * n
            rows.append((i, text(good), host, "p"))
            labels.append((i, int(good)))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    found = Q.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    rate = {r.host: r.p for r in found.groupBy("host").agg(F.avg("p_path").alias("p")).collect()}
    whole = found.agg(F.avg("p_doc")).first()[0]
    assert rate["bad"] < rate["new"] < rate["good"] and abs(rate["new"] - whole) < 0.1


def plain_rates(rows, known):
    """{row number: (p_host, p_path, score)} of rows (doc_id, host, path, p_doc) by loops over hosts and paths."""
    e = [known.get(i, p) for i, _, _, p in rows]
    clip = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    logit = lambda p: np.log(clip(p) / (1 - clip(p)))
    mean = clip(sum(e) / len(e))

    def groups(key):
        out = {}
        for k, r in enumerate(rows):
            n, t = out.get(key(r), (0, 0.0))
            out[key(r)] = n + 1, t + e[k]
        return out

    def worth(held, prior):
        noise = sum(prior[g] * (1 - prior[g]) for g in held)
        excess = sum(n * (t / n - prior[g]) ** 2 for g, (n, t) in held.items()) - noise
        total = sum(n for n, _ in held.values())
        spread = excess / max(total - sum(n * n for n, _ in held.values()) / total, 1.0)
        return min(max(noise / len(held) / max(spread, 1e-9) - 1, 1.0), 1e6)

    hosts, paths = groups(lambda r: r[1]), groups(lambda r: (r[1], r[2]))
    a = worth(hosts, {h: mean for h in hosts})
    prior = {h: (a * mean + t) / (a + n) for h, (n, t) in hosts.items()}
    b = worth(paths, {g: prior[g[0]] for g in paths})
    out = []
    for k, (_, h, p, doc) in enumerate(rows):
        of_host = (a * mean + hosts[h][1] - e[k]) / (a + hosts[h][0] - 1)
        of_path = (b * of_host + paths[h, p][1] - e[k]) / (b + paths[h, p][0] - 1)
        out.append((of_host, of_path, 1 / (1 + np.exp(-(logit(doc) + logit(of_path) - logit(mean))))))
    return out


def test_quality_against_plain_rates(spark):
    rng = np.random.default_rng(4)
    rows = [(i if i % 9 else i // 2, " ".join(rng.choice(["good", "fine", "###", "$$"], rng.integers(1, 30))), [None, "", "a", "b"][rng.integers(4)], ["x", None, "y"][rng.integers(3)]) for i in range(300)]
    labels = [(int(i), int(rng.random() < 0.6)) for i in rng.integers(0, 300, 150)] + [(3, None), (None, 1)]
    known = {}
    for i, q in labels:
        if q is not None:
            known[i] = max(q, known.get(i, 0))
    found = Q.judge(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    want = plain_rates([(r.doc_id, r.host, r.path, r.p_doc) for r in found], known)
    assert len(found) == 300 and len({r.p_doc for r in found}) > 100
    for r, w in zip(found, want):
        assert (r.p_host, r.p_path, r.score) == pytest.approx(w, abs=1e-9) and r.keep == (r.score >= 0.5)
    assert sorted(str((r.doc_id, r.host)) for r in found) == sorted(str((i, h)) for i, _, h, _ in rows)


def test_odds_of_words(spark):
    rows = [(i, "the nice words here" if i % 2 else "spam spam the casino", "s", "en") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    odds = Q.word_odds(docs, Q.drawn(labels))
    of = lambda w: odds.mean(np.unique(Q.word_hashes(w)))
    assert of("nice") > 1 and of("casino") < -1 and abs(of("the")) < 0.1 and of("never") == of("") == 0
    assert Q.drawn(labels, 50).count() == 50


def test_quality_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None, None, 0.5), (1, "", "a", "b", 0.5), (None, "x" * 100_000, "a", None, 0.5)], "doc_id long, text string, source string, lang string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.judge(docs, none).count() == 3
    assert Q.judge(docs.where("false"), none).count() == 0
    one = spark.createDataFrame([(1, 1), (1, 1), (None, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in Q.judge(docs, one).collect())


def test_pipeline(spark, docs, tmp_path):
    docs = docs.where("doc_id < 300")
    names, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.01")
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
    assert counts[1] == 300 and counts[2] <= 300 and counts[3] < counts[2] and counts[5] > 0
    full = docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n < 2048").count()
    assert full <= 1


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage on what the one before it kept, against plain loops over the same documents; run() reads each stage's result
    from where it was written, so none runs twice."""
    from test_counts_and_packing import check_pieces, plain_mix
    from test_duplicates import components, jaccard_links, plain_kept

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages, held = dict(corpus_pipeline.STAGES), [docs]
    for k, stage in enumerate(list(stages.values())[:4]):
        stage(spark, held[-1], sf).write.parquet(str(tmp_path / str(k)))
        held.append(spark.read.parquet(str(tmp_path / str(k))))
    texts = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in held[:4]]

    samples = L.training_chains(docs)
    model = L.train(samples)
    model.known, model.least = L.calibrate(samples)
    judged = dict(zip(texts[0], model.judge(list(texts[0].values()))))
    assert set(texts[1]) == {i for i, (lang, score, near) in judged.items() if lang != "und" and score >= 0.3 and near >= model.least}
    assert texts[2] == plain_kept(list(texts[1].items()))
    low = components(list(texts[2]), jaccard_links(list(texts[2].items())))
    assert set(texts[3]) == {i for i in texts[2] if low[i] == i}

    rows = [(r.doc_id, r.text, r.source) for r in held[3].collect()]
    size, target = plain_mix(rows)
    mixed = [(r.doc_id, r.text, r.source) for r in held[4].collect()]
    count = {i: sum(r[0] == i for r in mixed) for i, _, _ in rows}
    assert max(count.values()) <= 2
    for s in size:
        words = {i: len((t or "").split()) for i, t, x in rows if x == s}
        assert abs(sum(n * count[i] for i, n in words.items()) - target[s]) <= max(words.values()) / 2 + 1
    check_pieces(mixed, stages["packing"](spark, held[4], sf).collect(), 2048)

    seen = []
    spy = lambda f: lambda s, d, sf_dir: seen.append(d.inputFiles()) or f(s, d, sf_dir)
    pieces = corpus_pipeline.run
    old = corpus_pipeline.STAGES
    corpus_pipeline.STAGES = [(name, spy(f)) for name, f in old]
    try:
        found = pieces(spark, sf).agg(F.sum("length").alias("n")).first().n
    finally:
        corpus_pipeline.STAGES = old
    assert len(seen) == 5 and all("/stage-" in f for files in seen[1:] for f in files)
    assert found == stages["packing"](spark, held[4], sf).agg(F.sum("length").alias("n")).first().n


def test_junk_and_unlearned_languages_go(spark, docs):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    junk = spark.createDataFrame([(10_000_000 + i, " ".join(word() for _ in range(60)), None) for i in range(40)], "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "text", F.when(F.col("lang") != "de", F.col("lang")).alias("lang"))
    kept = {r.doc_id for r in L.keep_identified(rows.unionByName(junk)).select("doc_id").collect()}
    clean = {r.doc_id for r in rows.where("lang is not null").collect()}
    new = {r.doc_id for r in rows.where("lang is null").collect()}
    assert clean <= kept and len(new & kept) < 0.05 * len(new) and not any(i >= 10_000_000 for i in kept)
    few = rows.where("lang = 'en' or lang is null").unionByName(junk)
    assert not any(r.doc_id >= 10_000_000 for r in L.keep_identified(few).select("doc_id").collect())


def test_text_without_spaces_counts_as_a_whole():
    de, en = ["der", "hund", "schläft", "nicht", "und", "ich"], ["the", "dog", "sleeps", "where", "and", "why"]
    model = L.train([("de", de * 8)] * 8 + [("en", en * 8)] * 8)
    found = model.predict(["".join(en * 2) + "".join(de * 20), "".join(de * 20), "".join(de * 2) + "".join(en * 20)])
    assert [x for x, _ in found] == ["de", "de", "en"] and all(y > 0.8 for _, y in found)
    assert "".join(L.words_of("x" * 95 + " y")) == "x" * 95 + "y"
