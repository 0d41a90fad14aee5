"""Line dedup by winnowing (DataFrame functions only)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of so many lines or more that stand at an earlier place are deleted; also the winnowing window.
RUN = 3
#: In the pipeline a shorter run is judged as well if it has so many words or characters.
WORDS, CHARS = 50, 400
_KEY = ["doc_id", "mark"]


def _marked(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, text): documents are ordered by id, then by a hash of their text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def _hashed(line: Column) -> Column:
    """Two hashes of a line: lines are equal if both are (128 bits); the first one also chooses fingerprints."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _content(lines: Column) -> Column:
    """128 bits of the hashes of the lines of a run."""
    return F.struct(F.xxhash64(lines).alias("a"), F.xxhash64(F.lit("run"), lines).alias("b"))


def fingerprints(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(value, doc_id, mark, pos, around): the last smallest line hash of each window of `run` lines, once per place.

    around holds the hashes of up to run - 1 lines on either side, so that matches can be extended where they meet. A
    minimum stands for windows side by side, so each window is only compared with the one before it.
    """
    rows = _marked(docs).select(*_KEY, F.transform(F.split("text", "\n"), _hashed).alias("lines"))
    rows = rows.where(F.size("lines") >= run)
    value = lambda k: F.get("lines", k)["a"]
    place = lambda j: reduce(lambda x, y: F.when(value(y) <= value(x), y).otherwise(x), [j + k for k in range(run)])
    rows = rows.withColumn("places", F.transform(F.sequence(F.lit(0), F.size("lines") - run), place))
    rows = rows.withColumn("places", F.filter("places", lambda p, i: (i == 0) | (p != F.get("places", i - 1))))

    def entry(pos: Column) -> Column:
        low = F.greatest(pos - (run - 1), F.lit(0))
        return F.struct(value(pos).alias("value"), pos.alias("pos"), low.alias("low"), F.slice("lines", low + 1, pos - low + run).alias("around"))

    found = rows.select(*_KEY, F.explode(F.transform("places", entry)).alias("e"))
    return found.select("e.value", *_KEY, "e.pos", "e.low", "e.around")


def short_runs(docs: DataFrame, run: int = RUN, words: int = WORDS, chars: int = CHARS) -> DataFrame:
    """(content, doc_id, mark, start, n): runs of fewer than `run` lines that are long, and whole documents that are so short.

    A run is long if it has so many words or characters. One whose lines are all long is left to its lines.
    """
    line = lambda x: F.struct(_hashed(x).alias("h"), F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")).alias("w"), F.length(x).alias("c"))
    rows = _marked(docs).where("text is not null").select(*_KEY, F.transform(F.split("text", "\n"), line).alias("lines"))
    total = F.size("lines")
    hashes = F.transform("lines", lambda x: x["h"])
    is_long = lambda w, c: (w >= words) | (c >= chars)

    def windows(n: int) -> Column:
        def one(s: Column) -> Column:
            held = [F.get("lines", s + k) for k in range(n)]
            judged = is_long(sum(x["w"] for x in held), sum(x["c"] for x in held))
            if n > 1:
                judged = judged & ~reduce(and_, [is_long(x["w"], x["c"]) for x in held])
            content = _content(F.array(*[x["h"] for x in held]))
            return F.struct(content.alias("content"), s.cast("int").alias("start"), F.lit(n).alias("n"), judged.alias("judged"))

        return F.filter(F.transform(F.when(total >= n, F.sequence(F.lit(0), total - n)).otherwise(F.array().cast("array<int>")), one), lambda z: z["judged"])

    whole = F.struct(_content(F.concat(hashes, F.array(_hashed(F.lit("whole"))))).alias("content"), F.lit(0).alias("start"), total.alias("n"), (total < run).alias("judged"))
    found = rows.select(*_KEY, F.explode(F.concat(F.filter(F.array(whole), lambda z: z["judged"]), *[windows(n) for n in range(1, run)])).alias("z"))
    return found.select("z.content", *_KEY, "z.start", "z.n")


def repeated_runs(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """(doc_id, mark, start, n) of each run of `run` lines that is also found at an earlier place; with words, also of
    shorter ones (see short_runs).

    Equal runs choose the same fingerprint, so a fingerprint that stands at one place only can go. Around the
    others the match is extended both ways: of each run that chose the fingerprint, the first place is found by
    a partial minimum, and the later ones by a join that Spark can split. No two places are ever paired.
    """
    prints = fingerprints(docs, run)
    place = F.struct(*_KEY, "pos")
    shared = prints.groupBy("value").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("value")
    near = prints.join(shared, "value")
    first = F.greatest(F.col("pos") - (run - 1), F.lit(0))
    last = F.col("low") + F.size("around") - run
    near = near.where(first <= last).withColumn("start", F.explode(F.sequence(first, F.least(F.col("pos"), last))))
    inside = F.slice("around", F.col("start") - F.col("low") + 1, run)
    offset = F.col("pos") - F.col("start") + 1
    later = F.slice(inside, offset + 1, run)
    least = lambda lines: F.array_min(F.transform(lines, lambda x: x["a"]))
    chosen = (least(inside) == F.col("value")) & (F.coalesce(least(later) > F.col("value"), F.lit(True)))
    runs = near.where(chosen).select(_content(inside).alias("content"), *_KEY, "start", F.lit(run).alias("n"))
    if words is not None:
        runs = runs.unionByName(short_runs(docs, run, words))
    at = F.struct(*_KEY, "start")
    firsts = runs.groupBy("content").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("content", "first")
    return runs.join(firsts, "content").where(at > F.col("first")).select(*_KEY, "start", "n")


def _cut(docs: DataFrame, run: int, words: int | None = None) -> DataFrame:
    """(doc, left, n_lines, n_removed): each row as a struct with the text that is left of it."""
    cut = repeated_runs(docs, run, words).groupBy(*_KEY).agg(F.collect_set(F.struct("start", "n")).alias("starts"))
    cut = cut.select(F.col("doc_id").alias("cut_id"), F.col("mark").alias("cut_mark"), "starts")
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64("text").alias("mark"))
    rows = rows.join(cut, F.col("doc.doc_id").eqNullSafe(F.col("cut_id")) & (F.col("mark") == F.col("cut_mark")), "left")
    text, lines = F.col("doc.text"), F.col("lines")
    rows = rows.withColumn("lines", F.split(text, "\n"))
    gone = F.flatten(F.transform("starts", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
    rows = rows.withColumn("kept", F.when(F.col("starts").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)))
    left = F.when(F.col("kept").isNull(), text).otherwise(F.array_join(F.transform("kept", lambda i: F.get(lines, i)), "\n"))
    total = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    removed = F.when(F.col("kept").isNull(), 0).otherwise(total - F.size("kept")).cast("long")
    return rows.select("doc", left.alias("left"), total.alias("n_lines"), removed.alias("n_removed"))


def _columns(docs: DataFrame) -> list[Column]:
    """The columns of docs with what is left in text, and its length in n_chars, if there is such a column."""
    chars = F.when(F.col("n_removed") > 0, F.length("left").cast("long")).otherwise(F.col("doc").getField("n_chars")) if "n_chars" in docs.columns else None
    return [(F.col("left") if c == "text" else chars if c == "n_chars" else F.col("doc").getField(c)).alias(c) for c in docs.columns]


def drop_repeated_lines(docs: DataFrame, run: int = RUN) -> DataFrame:
    """All columns of docs with what is left in text (and n_chars, if there), and n_lines and n_removed.

    Lines are what newlines part; a run of `run` lines or more goes if all of its lines, one after the other, stand
    at an earlier place: in a document with a smaller id, or further up in the same one. Runs are judged on the
    input, and may overlap. Null text has no lines and stays null; the empty text is one empty line. Equal rows
    are one document and get the same result; null ids come first. An empty table gives no rows. Columns of docs
    named n_lines or n_removed are replaced.
    """
    kept = [c for c, name in zip(_columns(docs), docs.columns) if name not in ("n_lines", "n_removed")]
    return _cut(docs, run).select(*kept, "n_lines", "n_removed")


def keep_what_is_left(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """The documents, with their columns, without the lines that drop_repeated_lines takes; those that lose all go.

    Shorter runs go too if they stand at an earlier place and have `words` words or CHARS characters, and so do documents of
    fewer than `run` lines that equal an earlier one as a whole. Null text stays null and is kept; the empty text is
    one empty line, so only the first empty document stays. Rows equal in id and text are one document and share its
    fate; null ids come first. n_chars, if there, is the length of what is left. An empty table gives no rows.
    """
    return _cut(docs, run, words).where("n_lines = 0 or n_removed < n_lines").select(*_columns(docs))
