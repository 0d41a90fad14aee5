"""Small kernels for single groups: plain alignment, flat clusters, cliques; Spark deals the groups out."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def align(a: list[str], b: list[str], score, gap: float = -0.5, ends_free: bool = False) -> tuple[list[str], list[str], float]:
    """Needleman-Wunsch: two gapped sequences and their score; with ends_free gaps at either end cost nothing."""
    n, m = len(a), len(b)
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        best[i][0] = 0.0 if ends_free else i * gap
    for j in range(1, m + 1):
        best[0][j] = 0.0 if ends_free else j * gap
    cost = lambda edge: 0.0 if ends_free and edge else gap
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i][j] = max(best[i - 1][j - 1] + score(a[i - 1], b[j - 1]), best[i - 1][j] + cost(j == m), best[i][j - 1] + cost(i == n))
    x, y, i, j = [], [], n, m
    while i or j:
        if i and j and abs(best[i][j] - best[i - 1][j - 1] - score(a[i - 1], b[j - 1])) < 1e-9:
            i, j = i - 1, j - 1
            x.append(a[i])
            y.append(b[j])
        elif i and (not j or abs(best[i][j] - best[i - 1][j] - cost(j == m)) < 1e-9):
            i -= 1
            x.append(a[i])
            y.append("-")
        else:
            j -= 1
            x.append("-")
            y.append(b[j])
    return x[::-1], y[::-1], best[n][m]


def edit_distance(a: list[str], b: list[str], normalized: bool = False) -> float:
    """Levenshtein distance over sounds, if wanted divided by the longer length."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] / max(len(a), len(b), 1) if normalized else row[-1]


def flat_clusters(far: np.ndarray, sizes: np.ndarray, threshold: float, linkage: str = "upgma", apart: np.ndarray | None = None) -> np.ndarray:
    """For items of some size each, with a matrix of distances, the first item of their flat cluster.

    The closest two clusters are joined, ties by first items, while their distance is within the threshold: upgma: the mean over
    their items, single: the least, complete: the greatest. Clusters that hold two items which are `apart` are never joined.
    """
    far, sizes, head = far.astype(float).copy(), sizes.astype(float).copy(), np.arange(len(far))
    if apart is not None:
        far[apart] = np.inf
    np.fill_diagonal(far, np.inf)
    near = far.argmin(1) if len(far) else head
    while len(far) > 1:
        low = far[np.arange(len(far)), near]
        i = int(low.argmin())
        if not low[i] <= threshold:
            break
        i, j = sorted((i, int(near[i])))
        if linkage == "upgma":
            joined = (sizes[i] * far[i] + sizes[j] * far[j]) / (sizes[i] + sizes[j])
        else:  # what is apart from one of the two is apart from both
            joined = np.maximum(far[i], far[j])
            if linkage == "single":
                joined = np.where(np.isinf(joined), joined, np.minimum(far[i], far[j]))
        sizes[i] += sizes[j]
        head[head == j] = i
        far[i], far[:, i] = joined, joined
        far[j], far[:, j], far[i, i] = np.inf, np.inf, np.inf
        stale = (near == i) | (near == j)
        stale[[i, j]] = True
        near[stale] = far[stale].argmin(1)
        closer = far[:, i] < far[np.arange(len(far)), near]
        near[closer] = i
    return head


def maximal_cliques(nodes: Iterable[int], edges: dict[int, set[int]], taken: tuple[int, ...] = (), closed: Iterable[int] = ()):
    """Bron-Kerbosch with a pivot, without recursion: the maximal cliques of nodes and those taken already, which all are
    linked to, that no closed node could join."""
    stack = [(list(taken), set(nodes), set(closed))]
    while stack:
        taken, open_, closed = stack.pop()
        if not open_ and not closed:
            yield sorted(taken)
            continue
        if not open_:
            continue
        pivot = max(open_ | closed, key=lambda v: (len(edges[v] & open_), -v))
        for v in sorted(open_ - edges[pivot]):
            stack.append(([*taken, v], open_ & edges[v], closed & edges[v]))
            open_ = open_ - {v}
            closed = closed | {v}


def cliques_with(node: int, links: list[int], open_: int, closed: int):
    """The maximal cliques of a node with some of the open nodes that no closed node could join, as maximal_cliques.

    links has for each node those it is linked to, and sets are the bits of whole numbers; all open and closed nodes are linked to node.
    """

    stack = [([node], open_, closed)]
    while stack:
        taken, open_, closed = stack.pop()
        if not open_:
            if not closed:
                yield taken
            continue
        size, pivot, most, rest = open_.bit_count(), 0, -1, closed
        while rest and most < size:
            low = rest & -rest
            rest ^= low
            v = low.bit_length() - 1
            n = (open_ & links[v]).bit_count()
            if n > most:
                pivot, most = v, n
        if most == size:  # a closed node could join whatever comes
            continue
        rest, every = open_, []
        while rest:
            low = rest & -rest
            rest ^= low
            v = low.bit_length() - 1
            n = (open_ & links[v]).bit_count()
            if n == size - 1:
                every.append(v)
            elif n > most:
                pivot, most = v, n
        if every:  # linked to all other open nodes, they are in each clique
            for v in every:
                open_ ^= 1 << v
                closed &= links[v]
            stack.append(([*taken, *every], open_, closed))
            continue
        rest = open_ & ~links[pivot]
        while rest:
            low = rest & -rest
            rest ^= low
            v = low.bit_length() - 1
            stack.append(([*taken, v], open_ & links[v], closed & links[v]))
            open_ ^= low
            closed |= low


def links_as_bits(codes: np.ndarray, threshold: int, rows: int = 256) -> list[int]:
    """For each pattern those that share `threshold` entries with it and contradict it in none, as the bits of a whole number; 0 is missing.

    Entries are counted by products of matrices, for some rows at a time.
    """
    there = (codes != 0).astype(np.float32)
    cells = np.concatenate([(c[:, None] == np.unique(c[c != 0])[None, :]) for c in codes.T], 1).astype(np.float32)
    out = []
    for low in range(0, len(codes), rows):
        same = cells[low : low + rows] @ cells.T
        fits = (same >= threshold) & (same == there[low : low + rows] @ there.T)
        fits[np.arange(len(fits)), np.arange(low, low + len(fits))] = False
        out += [int.from_bytes(b.tobytes(), "little") for b in np.packbits(fits, axis=1, bitorder="little")]
    return out


def as_bits(flat: np.ndarray) -> np.ndarray:
    """True and false as the bits of 64-bit words, the first the lowest of the first word."""
    return np.packbits(np.pad(flat, (0, -len(flat) % 64)), bitorder="little").view(np.uint64)


def consensus_rows(codes: np.ndarray, kinds: np.ndarray, fixed: dict[int, int], limit: int = 50_000):
    """The consensus rows of all maximal cliques, for patterns of one kind each that are linked if they contradict each other in no column.

    codes has the columns of the patterns, 0 for missing. A clique of one kind is then what its consensus row holds: all patterns that
    have no other entry, and no further pattern fits. So rows are made column by column, all that are begun alike at once: an entry
    goes on with the patterns that have it or none, no entry with those that have none there (the others that fit so far must each
    be contradicted later on). fixed: only rows with these entries in these columns, for which codes needs the patterns that fit them.

    Yields (rows, {kind: (patterns of the kind, place in rows, members, size)}): of each clique the place of its row, its members as
    bits, and their number, two at least. No row comes twice, and its cliques of all kinds come together. Rows begun are cut into blocks
    of about limit, so that what is held doesn't grow with their number.
    """
    top = int(codes.max(initial=0)) + 1
    often = np.argsort(-(codes != 0).sum(0), kind="stable").tolist()
    order = [*fixed, *(j for j in often if j not in fixed)]
    of, begun = {}, {}
    for kind in np.unique(kinds).tolist():
        own = np.flatnonzero(kinds == kind)
        mine = codes[own]
        having = [{v: as_bits(c == v) for v in np.unique(c).tolist()} for c in mine.T]
        everyone = as_bits(np.ones(len(own), bool))
        lacking = [h.pop(0, np.zeros_like(everyone)) for h in having]
        support = np.zeros((len(order), top, len(everyone)), np.uint64)
        support[:, 0] = everyone  # no entry needs none that has it
        for j, h in enumerate(having):
            for v, bits in h.items():
                support[j, v] = bits
        later = [as_bits((mine[:, order[i + 1 :]] != 0).any(1)) for i in range(len(order))]
        of[kind] = own, having, lacking, support, later
        begun[kind] = np.zeros(1, np.int64), everyone[None], np.zeros_like(everyone)[None]
    stack = [(0, np.zeros((1, len(order)), np.int64), begun)]
    while stack:
        level, rows, begun = stack.pop()
        if level == len(order):
            found = {}
            for kind, (place, members, _) in begun.items():
                size = np.bitwise_count(members).sum(1, dtype=np.int64)
                if (size > 1).any():
                    found[kind] = of[kind][0], place[size > 1], members[size > 1], size[size > 1]
            if found:
                yield rows, found
            continue
        j, longer = order[level], {}
        for kind, (place, members, against) in begun.items():
            _, having, lacking, support, later = of[kind]
            parts = []
            for v in [fixed[j]] if j in fixed else [0, *having[j]]:
                if v and v not in having[j]:
                    continue
                fits = lacking[j] | having[j][v] if v else lacking[j]
                inside = members & fits
                outside = against & fits if v else against | (members & ~fits)
                good = (inside & support[j, v]).any(1) & ~(outside & ~later[level]).any(1)
                for k in order[:level]:
                    some = np.flatnonzero(good)
                    good[some] = (inside[some] & support[k, rows[place[some], k]]).any(1)
                if good.any():
                    parts.append((place[good] * top + v, inside[good], outside[good]))
            if parts:
                longer[kind] = [np.concatenate(p) for p in zip(*parts)]
        if not longer:
            continue
        named = np.unique(np.concatenate([place for place, _, _ in longer.values()]))
        rows = rows[named // top]
        rows[:, j] = named % top
        longer = {kind: (np.searchsorted(named, place), *rest) for kind, (place, *rest) in longer.items()}
        count = np.cumsum(sum(np.bincount(place, minlength=len(rows)) for place, _, _ in longer.values()))
        ends = np.unique([*np.searchsorted(count, np.arange(limit, count[-1], limit)) + 1, len(rows)])
        for low, high in zip([0, *ends.tolist()], ends.tolist()):
            block = {}
            for kind, (place, *rest) in longer.items():
                some = slice(None) if len(ends) == 1 else (place >= low) & (place < high)
                if len(place[some]):
                    block[kind] = place[some] - low, *(x[some] for x in rest)
            stack.append((level + 1, rows[low:high], block))


def most_used(asked: np.ndarray, n: int, found: dict, rows: int, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """For each of n questions (asked has the question of each pattern), the greatest sum of sizes of the cliques of one row that hold a
    pattern of it, and the first such row's place; found is as of consensus_rows, with places in `rows` rows."""
    bit = lambda members, at: members[:, at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
    most, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for own, place, members, size in found.values():  # in one kind the largest clique counts
        order, left = np.lexsort((place, -size)), as_bits(np.ones(len(own), bool))
        for low in range(0, len(order), chunk):
            some = order[low : low + chunk]
            new = np.bitwise_or.reduce(members[some], 0) & left
            if new.any():
                at = np.flatnonzero(np.unpackbits(new.view(np.uint8), bitorder="little"))
                first, q = some[bit(members[some], at).argmax(0)], asked[own[at]]
                more = (size[first] > most[q]) | ((size[first] == most[q]) & (place[first] < best[q]))
                most[q[more]], best[q[more]] = size[first[more]], place[first[more]]
                left &= ~new
    kinds = sum(np.bincount(place, minlength=rows) for _, place, _, _ in found.values())
    several, questions = np.flatnonzero(kinds > 1), np.flatnonzero(np.bincount(asked, minlength=n) > 1)
    line = np.full(n, -1)
    line[questions] = np.arange(len(questions))
    for low in range(0, len(several) if len(questions) else 0, chunk):  # where a row has cliques of several kinds, they add up
        those = several[low : low + chunk]
        sums = np.zeros((len(questions), len(those)), np.int64)
        for own, place, members, size in found.values():
            some, at = np.flatnonzero(np.isin(place, those)), np.flatnonzero(line[asked[own]] >= 0)
            sums[np.ix_(line[asked[own[at]]], np.searchsorted(those, place[some]))] += (bit(members[some], at).astype(np.int64) * size[some, None]).T
        first = sums.argmax(1)
        value, place = sums[np.arange(len(questions)), first], those[first]
        more = (value > most[questions]) | ((value == most[questions]) & (place < best[questions]))
        most[questions[more]], best[questions[more]] = value[more], place[more]
    return most, best


def with_partner(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Which patterns another one of their kind contradicts in no column; 0 is missing."""
    out = np.zeros(len(codes), bool)
    for kind in np.unique(kinds):
        own = np.flatnonzero(kinds == kind)
        fits = np.repeat(as_bits(np.ones(len(own), bool))[None], len(own), 0)
        for column in codes[own].T:
            for v in np.unique(column[column != 0]):
                fits[column == v] &= as_bits((column == v) | (column == 0))
        out[own] = np.bitwise_count(fits).sum(1, dtype=np.int64) > 1
    return out


def places(rows: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """For each row sought its place in rows, which are all different; -1 for those that aren't there."""
    by = np.random.default_rng(0).integers(1, 2**62, rows.shape[1])
    held, asked = (x.astype(np.int64) * by for x in (rows, sought))
    held, asked = held.sum(1), asked.sum(1)
    some = np.flatnonzero(np.isin(held, asked))  # few others by chance
    at = dict(zip(map(tuple, rows[some].tolist()), some.tolist()))
    return np.array([at.get(tuple(r), -1) for r in sought.tolist()], np.int64)


def best_rows(asked: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row asked the best score among rows held and the first place that has it; -1 as a place if there is none. 0 is missing.

    The same row scores most. Others that share an entry (the last column's opens none) score, without contradiction, their matches
    plus the width, else matches less contradictions, if that isn't 0.
    """
    width = held.shape[1]
    kind = np.int8 if width < 60 else np.int16
    none = np.iinfo(kind).min
    there, hits, common = [(c != 0).astype(kind) for c in held.T], {}, {}
    zero = np.zeros(len(held), kind)
    scores, at = np.full(len(asked), none, np.int64), places(held, asked)
    scores[at >= 0] = 2 * width + 1
    for i in np.flatnonzero(at < 0).tolist():
        row = asked[i].tolist()
        filled = tuple(c for c, x in enumerate(row) if x)
        if filled not in common:
            common[filled] = sum((there[c] for c in filled), zero)
        for c in filled:
            if (c, row[c]) not in hits:
                hits[c, row[c]] = (held[:, c] == row[c]).astype(kind)
        opened = sum((hits[c, row[c]] for c in filled if c < width - 1), zero)
        same = opened + hits[width - 1, row[-1]] if row[-1] else opened
        both = common[filled]
        score = np.where(both == same, same + kind(width), same + same - both)
        score[(opened == 0) | (score == 0)] = none
        k = int(score.argmax())
        if score[k] > none:
            scores[i], at[i] = score[k], k
    return scores, at
