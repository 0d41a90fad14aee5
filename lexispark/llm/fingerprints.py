"""Context-triggered piecewise hashes of whole texts, and their likeness."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.numbering import running_total
from lexispark.functions.storage import stored
from lexispark.llm.textnum import PrefixSums

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Code points under the rolling hash, the smallest block size, the pieces aimed at, and the most pieces of a signature.
WINDOW, LEAST, PIECES, MOST = 7, 3, 48, 64
#: Bytes of text in a part of the ordered documents, and the most parts.
PART, MOST_PARTS = 16 << 20, 50_000
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)


def block_size(n: int) -> int:
    """The smallest LEAST x 2**k that cuts n code points into PIECES pieces or fewer on average."""
    size = LEAST
    while size * PIECES < n:
        size *= 2
    return size


def _signature(sums: PrefixSums, n: int, ends: np.ndarray) -> str:
    """One letter for each piece."""
    ends = np.append(ends[ends < n][: MOST - 1], n)
    starts = np.concatenate([[0], ends[:-1]])
    return _LETTERS[(sums.spans(starts, ends) & np.uint64(63)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    """block size : signature at it : signature at twice it. The empty text has '3::'.

    A piece ends where the hash of the last WINDOW code points falls into the lowest 1/size of its range.
    """
    n = len(text)
    if not n:
        return f"{LEAST}::"
    size = block_size(n)
    sums = PrefixSums(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    rolling = sums.windows(WINDOW)
    ends = np.flatnonzero(rolling < np.uint64((1 << 64) // size))
    coarse = ends[rolling[ends] < np.uint64((1 << 64) // (2 * size))]
    return f"{size}:{_signature(sums, n, ends + WINDOW)}:{_signature(sums, n, coarse + WINDOW)}"


def edit_distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Levenshtein distances of many pairs of strings of at most 64 characters, bit-parallel over all pairs."""
    n = len(pairs)
    a, b = (np.zeros((n, MOST), np.uint8) for _ in range(2))
    la, lb = (np.zeros(n, np.int64) for _ in range(2))
    for i, (x, y) in enumerate(pairs):
        la[i], lb[i] = len(x), len(y)
        a[i, : len(x)], b[i, : len(y)] = np.frombuffer(x.encode(), np.uint8), np.frombuffer(y.encode(), np.uint8)
    bits = np.uint64(1) << np.arange(MOST, dtype=np.uint64)
    one, zero = np.uint64(1), np.uint64(0)
    last = np.where(la > 0, one << np.maximum(la - 1, 0).astype(np.uint64), zero)
    plus, minus, score = np.full(n, ~zero, np.uint64), np.zeros(n, np.uint64), la.copy()
    with np.errstate(over="ignore"):
        for j in range(int(lb.max(initial=0))):
            live = j < lb
            same = ((a == b[:, j : j + 1]) & (np.arange(MOST) < la[:, None])) @ bits
            x = same | minus
            d = (((x & plus) + plus) ^ plus) | x
            up, down = minus | ~(d | plus), plus & d
            score += np.where(live & ((up & last) > 0), 1, 0) - np.where(live & ((down & last) > 0), 1, 0)
            up, down = (up << one) | one, down << one
            plus, minus = np.where(live, down | ~(d | up), plus), np.where(live, up & d, minus)
    return np.where(la == 0, lb, score)


def likeness(pairs: list[tuple[str, str]]) -> list[float]:
    """0 to 1 for each pair of fingerprints: 1 - edit distance / longer signature, at the best common block size.

    Block sizes are compatible if equal or twice one another; others have likeness 0. Equal ones have 1.
    """
    out, todo = [0.0] * len(pairs), []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 1.0
            continue
        (p, p1, p2), (q, q1, q2) = ((int(s), u, v) for s, u, v in (z.split(":") for z in (x, y)))
        found = [(p1, q1), (p2, q2)] if p == q else [(p2, q1)] if q == 2 * p else [(p1, q2)] if p == 2 * q else []
        todo += [(i, s, t) for s, t in found if s and t]
    if todo:
        far = edit_distances([(s, t) for _, s, t in todo])
        for (i, s, t), d in zip(todo, far):
            out[i] = max(out[i], 1.0 - int(d) / max(len(s), len(t)))
    return out


def edited(text: str, after: str) -> str:
    """The last quarter of the code points replaced by as many of the next text's first ones (or all it has)."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def with_next(docs: DataFrame, part_bytes: int = PART) -> DataFrame:
    """Rows (part, guest, doc_id, text, n) such that, in a part sorted by these, each row but a guest has its successor next.

    Documents are ordered by doc_id and a hash of their text, and cut into parts of about part_bytes (more, if there were over
    MOST_PARTS of them); the first document of each part is also the guest at the end of the part before it (of the last
    part, for the first). Only the ids and lengths are looked at to find the cuts, of which the driver holds one a part;
    each text moves once, and each part to a task of its own. n counts equal rows: those of a document whose copies fill a
    part or more are counted where they are read, and sent as one row a task.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    per = docs.groupBy("doc_id", "mark").agg(F.sum(F.octet_length("text") + 64).alias("bytes"), F.max(F.octet_length("text") + 64).alias("one"))
    per = stored(per, "lengths")
    total = per.agg(F.sum("bytes")).first()[0] or 0
    size = max(part_bytes, total // MOST_PARTS)
    large = F.col("bytes") >= size
    sized = running_total(per.withColumn("sent", F.when(large, F.col("one")).otherwise(F.col("bytes"))), ["doc_id", "mark"], "sent", "before")
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "mark")
    firsts = sized.groupBy(F.floor(F.col("before") / size).alias("part")).agg(F.min(key).alias("k")).collect()
    cuts = sorted((r.k.known, r.k.doc_id or 0, r.k.mark) for r in firsts)
    hot = {(r.doc_id is not None, r.doc_id or 0, r.mark) for r in per.where(large).select("doc_id", "mark").collect()}
    held = docs.sparkSession.sparkContext.broadcast((cuts, hot))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, hot = held.value
        seen: dict[tuple, list] = {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            made = []
            for known, doc_id, mark, text, n in rows:
                part = bisect_right(cuts, (known, doc_id, mark)) - 1
                made.append((part, False, doc_id if known else None, text, n))
                if (known, doc_id, mark) == cuts[part]:
                    made.append(((part - 1) % len(cuts), True, doc_id if known else None, text, 1))
            kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * 5, kinds)], ["part", "guest", "doc_id", "text", "n"])

        for batch in batches:
            rows = []
            for doc_id, mark, text in zip(*(c.to_pylist() for c in batch.columns)):
                key = (doc_id is not None, doc_id or 0, mark)
                if key in hot:
                    seen.setdefault(key, [text, 0])[1] += 1
                else:
                    rows.append((*key, text, 1))
            for at in range(0, len(rows), 256):
                yield out(rows[at : at + 256])
        yield out([(*key, *x) for key, x in seen.items()])

    rows = docs.mapInArrow(place, "part int, guest boolean, doc_id long, text string, n long")
    return rows.repartitionById(max(1, len(cuts)), F.col("part")).sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next larger doc_id (null is the smallest; rows with equal ids follow
    each other in the order of a hash of their text), the first one after the last; a single document is its own
    next. Null text counts as empty. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # [part, doc_id, text, n] of the document whose successor isn't known yet

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            own = [fingerprint(r[1]) for r in rows]
            known = dict(zip((r[1] for r in rows), own))
            made = [edited(r[1], r[2]) for r in rows]
            changed = [p if e == r[1] else fingerprint(e) for p, e, r in zip(own, made, rows)]
            following = [known.get(r[2]) or fingerprint(r[2]) for r in rows]
            near = likeness(list(zip(own, changed)) + list(zip(own, following)))
            cols = [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in made]),
                pa.array(own),
                pa.array(changed),
                pa.array(near[: len(rows)], pa.float64()),
                pa.array(near[len(rows) :], pa.float64()),
                pa.array([r[3] for r in rows], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n"])

        def followed(held: list, text: str) -> list[tuple]:
            """Of equal rows all but the last follow each other."""
            _, doc_id, own, n = held
            return [(doc_id, own, own, n - 1)] * (n > 1) + [(doc_id, own, text, 1)]

        for batch in batches:
            rows: list[tuple] = []
            for part, guest, doc_id, text, n in zip(*(c.to_pylist() for c in batch.columns)):
                if guest:
                    if held and held[0] == part:
                        rows += followed(held, text)
                        held = None
                elif held and held[:3] == [part, doc_id, text]:
                    held[3] += n
                else:
                    if held and held[0] == part:
                        rows += followed(held, text)
                    held = [part, doc_id, text, n]
            for at in range(0, len(rows), 256):
                yield flush(rows[at : at + 256])

    columns = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    found = with_next(docs).mapInArrow(run, columns + ", n long")
    return found.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
