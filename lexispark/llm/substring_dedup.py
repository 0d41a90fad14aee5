"""Substring dedup: greedy parse of documents relative to the reference blocks in which their windows first stand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.storage import materialise, stored
from lexispark.llm.textnum import window_hashes, word_hashes

#: Words of a window, bytes of text in a reference block, and bytes of text whose windows share a bucket of the index.
SPAN, BLOCK, BUCKET = 13, 6 << 20, 24 << 20
#: Bytes of passages compared with a source in one task, and places of a window up to which they are tried one by one.
PART, FEW = 4 << 20, 32
#: Hashes shared by unequal windows that are sent to every task.
SENT = 200_000
PLACES = "places array<struct<doc:long,mark:long,start:int>>"


def _windows(text: str | None, span: int, bits: int) -> np.ndarray:
    """The hashes of the windows of a text; with fewer bits (in tests) unequal windows share some."""
    found = window_hashes(word_hashes(text), span)
    return found if bits == 64 else found % np.uint64(1 << bits)


class _Block:
    """The windows of a block of documents: their hashes and the first document of each."""

    def __init__(self, docs: pd.DataFrame, span: int, bits: int) -> None:
        parts = [_windows(t, span, bits) if h else np.zeros(0, np.uint64) for t, h in zip(docs["text"], docs["known"])]
        self.sizes = np.array([len(x) for x in parts], np.int64)
        self.hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        owner = np.repeat(docs["doc"].to_numpy(np.int64), self.sizes)
        order = np.lexsort((owner, self.hashes))
        ranked = self.hashes[order]
        lead = np.ones(len(ranked), bool)
        lead[1:] = ranked[1:] != ranked[:-1]
        self.unique, self.first, self.owner = ranked[lead], owner[order][lead], owner

    def place(self, buckets: int) -> np.ndarray:
        return (self.unique % np.uint64(buckets)).astype(np.int64)


def _split(place: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(place, kind="stable")
    places, starts = np.unique(place[order], return_index=True)
    for p, at in zip(places, np.split(order, starts[1:])):
        yield (int(p), *[c[at].tobytes() for c in columns])


def _stacked(blobs: list[bytes], dtype) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(b, dtype) for b in blobs]
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _text(words: list[bytes]) -> str:
    return b" ".join(words).decode("utf-8", "surrogatepass")


class Reference:
    """The words of a document with an index of its windows; equality is that of the words themselves."""

    def __init__(self, words: list[bytes], span: int) -> None:
        self.words, self.span, self.order = words, span, None
        self.at: dict[tuple[bytes, ...], list[int]] = {}
        for i in range(len(words) - span + 1):
            self.at.setdefault(tuple(words[i : i + span]), []).append(i)

    def _common(self, words: list[bytes], i: int, p: int) -> int:
        """How many words agree from i and from p here on."""
        n, step = 0, 16
        while words[i + n : i + n + step] == self.words[p + n : p + n + step]:
            if i + n + step >= len(words) or p + n + step >= len(self.words):
                return min(len(words) - i, len(self.words) - p)
            n, step = n + step, 2 * step
        while i + n < len(words) and p + n < len(self.words) and words[i + n] == self.words[p + n]:
            n += 1
        return n

    def _suffixes(self) -> np.ndarray:
        """The places in the order of what follows them, by doubling."""
        number = {w: i + 1 for i, w in enumerate(sorted(set(self.words)))}
        rank, k = np.array([number[w] for w in self.words], np.int64), 1
        while True:
            after = np.zeros(len(rank), np.int64)
            after[: max(0, len(rank) - k)] = rank[k:]
            order = np.lexsort((after, rank))
            a, b = rank[order], after[order]
            new = np.concatenate([[1], 1 + np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
            rank = np.empty(len(rank), np.int64)
            rank[order] = new
            if new[-1] == len(rank) or k >= len(rank):
                return order
            k *= 2

    def longest(self, words: list[bytes], i: int) -> tuple[int, int]:
        """(place here, length) of the longest match of words[i:] of a window or more; length 0 if there is none.

        Of equally long ones the first, where the places of the window are few; many are searched by halves in the order
        of what follows them.
        """
        places = self.at.get(tuple(words[i : i + self.span]), ())
        best, length = 0, 0
        if len(places) <= FEW:
            for p in places:
                n = self._common(words, i, p)
                if n > length:
                    best, length = p, n
            return best, length
        if self.order is None:
            self.order = self._suffixes()
        low, high = 0, len(self.order)
        while low < high:
            at = (low + high) // 2
            p = int(self.order[at])
            n = self._common(words, i, p)
            if n > length:
                best, length = p, n
            if i + n == len(words):
                break
            if p + n == len(self.words) or self.words[p + n] < words[i + n]:
                low = at + 1
            else:
                high = at
        return best, length

    def factors(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(start, length, place here) of the factors of the greedy parse that are a window or longer.

        After a factor the first window that reaches over its end is looked up, and so on, so that no window across a
        boundary is missed; factors may overlap by less than a window.
        """
        out, i = [], 0
        while i + self.span <= len(words):
            p, n = self.longest(words, i)
            if n:
                out.append((i, n, p))
                i += n - self.span
            i += 1
        return out


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal neighbours."""
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(cuts[:-1], cuts[1:]))


def _merged(spans: list[tuple]) -> list[list[int]]:
    """[start, end] of what the sorted (start, length, ...) cover."""
    out: list[list[int]] = []
    for a, n, *_ in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return out


def cut_repeats(docs: DataFrame, span: int = SPAN, block_bytes: int = BLOCK, bucket_bytes: int = BUCKET, bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (start, length, and the source and position of a factor),
    text.

    A word goes if a window of `span` words over it also starts in a document with a smaller doc_id; text is
    what stays, joined by single spaces. Windows are judged on the input.

    Documents lie in reference blocks. An index of the windows of all blocks, dealt out by hash, tells for each window the
    first document that has it, and that one's block. It is asked twice: first each block names its windows by 32 bits of
    their hash, once each; only those that other blocks name too are asked again, with 64 bits and the block's first
    document. So a window that a third of the documents share is one entry a block. Passages all of whose windows are
    first seen in one document are then parsed greedily against it: each factor is the longest match there, word
    by word, with its position; windows across the ends of factors are looked up one by one. Equal passages are parsed
    once, and the passages of a much-used source in several tasks. What the factors cover goes.

    The index says where to look, the words what goes: a hash that unequal windows share removes nothing. Windows that
    the source turns out not to have are compared by their words with all windows of that hash, so none is missed.

    Null text has no words; null doc_id keeps all its words and counts for no other; rows with equal doc_id don't cut each
    other; an empty table gives no rows. Rows with a null in either are done where they are read and lie in no block, however many.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    alone = rows.where("doc_id is null or text is null")
    rows = rows.where("doc_id is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks, buckets = int(total // block_bytes) + 1, int(total // bucket_bytes) + 1
    rows = rows.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"),
        F.coalesce("doc_id", F.lit(0)).alias("doc"),
        F.col("doc_id").isNotNull().alias("known"),
        F.xxhash64("text").alias("mark"),
        "text",
    )
    held = rows.groupBy("block")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "source", "position")]))
        for batch in batches:
            texts = [_words(t) for t in batch.column("text").to_pylist()]
            columns = {"n_words": pa.array([len(w) for w in texts], pa.int64()), "n_removed": pa.array([0] * len(texts), pa.int64()), "spans": pa.array([[]] * len(texts), kind), "text": pa.array([_text(w) for w in texts], pa.string())}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns.values()], ["doc_id", *columns])

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        block, number = _Block(frame, span, bits), int(frame["block"].iloc[0])
        short = (block.unique >> np.uint64(32)).astype(np.uint32)
        found = [(p, number, np.unique(np.frombuffer(s, np.uint32)).tobytes()) for p, s in _split(block.place(buckets), short)]
        return pd.DataFrame(found, columns=["bucket", "block", "data"])

    def shared(frame: pd.DataFrame) -> pd.DataFrame:
        values, whose = _stacked(list(frame["data"]), np.uint32)
        ranked = np.sort(values)
        again = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        many = np.isin(values, again)
        bucket, number = int(frame["bucket"].iloc[0]), frame["block"].to_numpy()
        return pd.DataFrame([(int(number[i]), bucket, v) for i, v in _split(whose[many], values[many])], columns=["block", "bucket", "data"])

    def ask_again(frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "block", "hashes", "firsts"]
        if not len(frame) or not len(replies):
            return pd.DataFrame([], columns=columns)
        block, number = _Block(frame, span, bits), int(frame["block"].iloc[0])
        wanted = np.concatenate([(np.uint64(b) << np.uint64(32)) | np.frombuffer(d, np.uint32) for b, d in zip(replies["bucket"], replies["data"])])
        place = block.place(buckets)
        ok = np.isin((place.astype(np.uint64) << np.uint64(32)) | (block.unique >> np.uint64(32)), wanted)
        return pd.DataFrame([(p, number, h, f) for p, h, f in _split(place[ok], block.unique[ok], block.first[ok])], columns=columns)

    def earliest(frame: pd.DataFrame) -> pd.DataFrame:
        """For each block the windows that another one has in an earlier document, with that document and its block."""
        hashes, whose = _stacked(list(frame["hashes"]), np.uint64)
        firsts, _ = _stacked(list(frame["firsts"]), np.int64)
        order = np.lexsort((firsts, hashes))
        lead = np.ones(len(order), bool)
        lead[1:] = hashes[order][1:] != hashes[order][:-1]
        best = np.empty(len(order), np.int64)
        best[order] = order[lead][np.cumsum(lead) - 1]
        news = firsts[best] < firsts
        number = frame["block"].to_numpy(np.int32)
        parts = _split(whose[news], hashes[news], firsts[best[news]], number[whose[best[news]]])
        return pd.DataFrame([(int(number[i]), h, f, b) for i, h, f, b in parts], columns=["block", "hashes", "firsts", "homes"])

    def propose(frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        """Passages of the block's documents all of whose windows are first seen in one earlier document, once each."""
        columns = ["home", "source", "block", "passage", "places"]
        if not len(frame):
            return pd.DataFrame([], columns=columns)
        frame = frame.drop_duplicates(["known", "doc", "mark"])
        block, number = _Block(frame, span, bits), int(frame["block"].iloc[0])
        first, home = block.first.copy(), np.full(len(block.first), number, np.int64)
        if len(replies):
            hashes, _ = _stacked(list(replies["hashes"]), np.uint64)
            low, _ = _stacked(list(replies["firsts"]), np.int64)
            where, _ = _stacked(list(replies["homes"]), np.int32)
            at = np.searchsorted(block.unique, hashes)
            nearer = low < first[at]
            first[at[nearer]], home[at[nearer]] = low[nearer], where[nearer]
        at = np.searchsorted(block.unique, block.hashes)
        source, home = first[at], home[at]
        later, end = source < block.owner, 0
        out: dict[tuple, list[dict]] = {}
        for doc, mark, text, size in zip(frame["doc"], frame["mark"], frame["text"], block.sizes):
            begin, end = end, end + size
            if not later[begin:end].any():
                continue
            words = _words(text)
            for a, b in _runs(np.where(later[begin:end], source[begin:end], doc)):
                if later[begin + a]:
                    key = int(home[begin + a]), int(source[begin + a]), number, _text(words[a : b + span - 1])
                    out.setdefault(key, []).append({"doc": int(doc), "mark": int(mark), "start": a})
        return pd.DataFrame([(*k, v) for k, v in out.items()], columns=columns)

    def serve(frame: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The texts of the block's documents that passages are compared with, once for each part."""
        mine = frame[frame["known"]].drop_duplicates(["doc", "mark"]).merge(asked, left_on="doc", right_on="source") if len(frame) and len(asked) else None
        columns = ["source", "part", "passage"]
        if mine is None or not len(mine):
            return pd.DataFrame([], columns=columns)
        return pd.DataFrame([(s, p, t) for s, n, t in zip(mine["source"], mine["parts"], mine["text"]) for p in range(n)], columns=columns)

    def factor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per passage its factors, and the hashes of windows that its source hasn't. Sources come before passages."""
        now, against = None, []
        for batch in batches:
            out = []
            for source, part, key, text in zip(batch["source"], batch["part"], batch["key"], batch["passage"]):
                if (source, part) != now:
                    now, against = (source, part), []
                if not key:
                    against.append(Reference(_words(text), span))
                    continue
                words = _words(text)
                made = sorted({f for r in against for f in r.factors(words)})
                open_ = np.ones(len(words) - span + 1, bool)
                for a, n, _ in made:
                    open_[a : a + n - span + 1] = False
                missed = _windows(text, span, bits)[open_] if open_.any() else np.zeros(0, np.uint64)
                out.append((source, key, [{"start": a, "length": n, "position": p} for a, n, p in made], [int(h) for h in missed.view(np.int64)]))
            yield pd.DataFrame(out, columns=["source", "key", "factors", "missed"])

    def cut(frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "n_words", "n_removed", "spans", "text"]
        out, of = [], {}
        for places, source, factors in zip(found["places"], found["source"], found["factors"]) if len(found) else ():
            for at in places:
                of.setdefault((at["doc"], at["mark"]), []).extend((at["start"] + f["start"], f["length"], source, f["position"]) for f in factors)
        for doc, known, mark, text in zip(frame["doc"], frame["known"], frame["mark"], frame["text"]) if len(frame) else ():
            words, spans = _words(text), sorted(of.get((doc, mark), ())) if known else []
            kept, last = [], 0
            for a, b in _merged(spans):
                kept += words[last:a]
                last = b
            kept += words[last:]
            out.append((doc if known else None, len(words), len(words) - len(kept), [dict(zip(("start", "length", "source", "position"), s)) for s in spans], _text(kept)))
        made = pd.DataFrame(out, columns=columns)
        made["doc_id"] = pd.array([r[0] for r in out], dtype="Int64")
        return made

    asked = held.applyInPandas(ask, "bucket int, block int, data binary")
    replies = asked.groupBy("bucket").applyInPandas(shared, "block int, bucket int, data binary")
    asked = held.cogroup(replies.groupBy("block")).applyInPandas(ask_again, "bucket int, block int, hashes binary, firsts binary")
    replies = asked.groupBy("bucket").applyInPandas(earliest, "block int, hashes binary, firsts binary, homes binary")
    proposed = held.cogroup(replies.groupBy("block")).applyInPandas(propose, f"home int, source long, block int, passage string, {PLACES}")
    proposed = stored(proposed.withColumn("key", F.substring(F.sha2("passage", 256), 1, 32)), "passages")

    passages = proposed.groupBy("home", "source", "key").agg(F.first("passage").alias("passage"))
    sizes = proposed.groupBy("home", "source", "key").agg(F.first(F.octet_length("passage")).alias("size"))
    sources = stored(sizes.groupBy("home", "source").agg(F.ceil(F.sum("size") / PART).cast("int").alias("parts")), "sources")
    texts = held.cogroup(sources.groupBy("home")).applyInPandas(serve, "source long, part int, passage string")
    passages = passages.join(sources, ["home", "source"]).select("source", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), "key", "passage")
    both = texts.select("source", "part", F.lit("").alias("key"), "passage").unionByName(passages)
    both = both.repartition("source", "part").sortWithinPartitions("source", "part", "key")
    schema = "source long, key string, factors array<struct<start:int,length:int,position:int>>, missed array<long>"
    factors = stored(both.mapInPandas(factor, schema), "factors")
    found = proposed.drop("passage", "home").join(factors.select("source", "key", "factors"), ["source", "key"])
    found = found.select("block", "places", "source", "factors")
    again = materialise(factors.select(F.explode("missed").alias("hash")).distinct())
    if not again.isEmpty():
        found = found.unionByName(_by_words(rows, again, span, bits))
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,length:long,source:long,position:long>>, text string"
    return held.cogroup(found.groupBy("block")).applyInPandas(cut, schema).unionByName(alone.mapInArrow(whole, schema))


def _by_words(rows: DataFrame, hashes: DataFrame, span: int, bits: int) -> DataFrame:
    """(block, places, source, factors) of the windows with one of the hashes, compared by their words.

    Up to SENT hashes go to the tasks, which only write out windows that have one of them; more are joined.
    """
    sent = np.sort(np.array([r[0] for r in hashes.limit(SENT + 1).collect()], np.int64))
    known = sent if len(sent) <= SENT else None

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for block, doc, mark, text in zip(*(batch[c] for c in ("block", "doc", "mark", "text"))):
                found, words = _windows(text, span, bits).view(np.int64), None
                for i in range(len(found)) if known is None else np.flatnonzero(np.isin(found, known)).tolist():
                    words = words or _words(text)
                    out.append((block, doc, mark, i, int(found[i]), _text(words[i : i + span])))
            yield pd.DataFrame(out, columns=["block", "doc", "mark", "start", "hash", "window"])

    all_ = rows.where("known").select("block", "doc", "mark", "text").mapInPandas(windows, "block int, doc long, mark long, start int, hash long, window string")
    some = all_.join(hashes, "hash").drop("hash").distinct()
    first = some.groupBy("window").agg(F.min(F.struct("doc", "start")).alias("first"))
    one = F.array(F.struct(F.lit(0).alias("start"), F.lit(span).alias("length"), F.col("first.start").alias("position")))
    places = F.array(F.struct("doc", "mark", "start"))
    return some.join(first, "window").where("first.doc < doc").select("block", places.alias("places"), F.col("first.doc").alias("source"), one.alias("factors"))
