"""Similarity join of word n-gram sets by T-occurrence search with DivideSkip.

Two sets link when 100 * intersection >= 80 * union. Sets are ordered with
their frequent shingles last, so the prefix that a partner must share holds the
short inverted lists; what follows is probed.

1. Each document gives its set's size, a digest and a parity bitmap; equal sets
   become one. Shingles of very many documents are counted (a bounded number).
2. The shingles of every prefix are dealt by hash; sets that share some meet
   again, once for each distinct list, with the bitmaps. The distance of two bitmaps
   bounds the difference of two sets from below, so a pair that it refutes is
   no link. What is left joins sets into families.
3. Within a family, T-occurrence search finds the links: the short lists of a
   set are merged by a heap, which counts their members; the long lists are
   probed by binary search for the candidates that can still reach the overlap
   that they need. Sets that are in one component already are not compared.
   A family of more than BLOCK sets is dealt into blocks: each set once, then the
   first set of each component that the blocks found, and at last the sets
   outside the family's largest component against all of it.

Sets are known by their digest, rows by doc_id and a hash of the text.

Defined results: a text of fewer words than n is one shingle, its whole
sequence; null text, or text without words, has an empty set and links with
nothing; a null doc_id links with nothing and has a null component_id; rows
with equal doc_id count once each, by their own text; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (
    map_batches, U64, Scratch, Words, blocks, bucket_count, by_bucket, by_task, components, deal, gather, groups, join_counted, join_spread, largest, long_column, may_match, mix, only, second, tune, union_find, windows,
)

N = 5
#: Shingles that may count as frequent: all shingles divided by the least count.
FREQUENT = 200_000
LEAST_FREQUENT = 64
#: Shingles whose counts a task sums at a time, and the least such sum it reports.
COUNTED, REPORTED = 2_000_000, 3
#: Sets of a family that meet in one task; a long text counts as several, of so many shingles each.
BLOCK, SET_SHINGLES = 1024, 1024
#: Lists of up to so many sets are compared all at once.
SHORT_LIST = 32
#: Digests that a task remembers at a time, so as not to send the sets of copies again.
REMEMBERED = 500_000


def needed(total: np.ndarray) -> np.ndarray:
    """Least intersection of linked sets whose sizes sum to `total`."""
    return (4 * total + 8) // 9


class Sets:
    """Sorted distinct hashes of each of some texts, with edges by text."""

    def __init__(self, doc: np.ndarray, h: np.ndarray, count: int) -> None:
        order = np.argsort(h, kind="stable")
        order = order[np.argsort(doc[order], kind="stable")]
        d, s = doc[order], h[order]
        fresh = np.ones(len(s), bool)
        fresh[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
        self.doc, self.h = d[fresh], s[fresh]
        self.edge = np.searchsorted(self.doc, np.arange(count + 1))
        self.size = np.diff(self.edge)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values of each text's shingles, modulo 2**64."""
        total = np.concatenate([np.zeros(1, U64), np.cumsum(values)])
        return total[self.edge[1:]] - total[self.edge[:-1]]

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        return self.sums(mix(self.h)).view(np.int64), self.sums(second(self.h)).view(np.int64)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = N) -> Sets:
    """Sets of the word n-grams of each text of a block."""
    w = Words(data, offsets, lower=True)
    h1, h2 = w.both_hashes()
    count = np.diff(w.first)
    left = np.repeat(w.first[1:], count) - np.arange(len(w.start))
    at = np.flatnonzero(left >= n)
    of = lambda k: mix(windows(h1, k) ^ second(windows(h2, k)))  # noqa: E731  both decide
    doc, key = [w.doc[at]], [of(n)[at]]
    for k in range(1, n):  # texts of fewer words
        few = np.flatnonzero(count == k)
        doc.append(few)
        key.append(of(k)[w.first[few]] if len(few) else np.zeros(0, U64))
    return Sets(np.concatenate(doc), np.concatenate(key), len(offsets) - 1)


#: Makes the sets of a block of texts.
Make = Callable[[np.ndarray, np.ndarray], Sets]


def bitmap(h: np.ndarray) -> bytes:
    """Parities of the shingles by position: a power of two of 64-bit words."""
    bits = 64
    while bits < len(h):
        bits *= 2
    odd = np.bincount((h & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def profiles(docs: DataFrame, make: Make) -> DataFrame:
    """Sizes, digests and bitmaps of rows (doc_id, text, row); partial counts of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row", "n", "h1", "h2", "bits", "seen"]
        held: list[np.ndarray] = []

        def counts() -> pa.RecordBatch:
            value, seen = np.unique(np.concatenate(held), return_counts=True)
            value, seen = value[seen >= REPORTED], seen[seen >= REPORTED]
            none = pa.nulls(len(value), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(value.view(np.int64)), none, pa.nulls(len(value), pa.binary()), pa.array(seen)], names)

        for batch in batches:
            ids, row = batch.column(0), batch.column(2)
            for lo, hi, data, offsets in blocks(batch.column(1)):
                s = make(data, offsets)
                h1, h2 = s.digests()
                bits = [bitmap(s.h[a:b]) for a, b in zip(s.edge, s.edge[1:])]
                columns = [ids.slice(lo, hi - lo), row.slice(lo, hi - lo), pa.array(s.size.astype(np.int64)), pa.array(h1), pa.array(h2), pa.array(bits, pa.binary()), pa.nulls(hi - lo, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)
                held.append(s.h)
                if sum(map(len, held)) >= COUNTED:
                    yield counts()
                    held = []
        if held:
            yield counts()

    return map_batches(docs, run, "doc_id long, row long, n long, h1 long, h2 long, bits binary, seen long")


def frequent_shingles(profile: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles of very many documents.

    At most FREQUENT of them whatever the input, since the least count is the
    number of all shingles divided by that.
    """
    total = profile.where("seen IS NULL").agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_FREQUENT, total // FREQUENT)
    rows = profile.where("seen IS NOT NULL").groupBy("h1").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= least).select("h1").collect()
    return np.sort(np.array([r.h1 for r in rows], np.int64).view(U64))


def _is_in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    return sorted_values[np.minimum(at, len(sorted_values) - 1)] == x


def prefixes(s: Sets, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask of each set's prefix, frequent shingles last, and places in that order."""
    last = _is_in(frequent, s.h)
    order = np.lexsort((s.h, last, s.doc))
    place = np.arange(len(s.h)) - s.edge[s.doc[order]]
    size = s.size[s.doc[order]]
    out, places = np.zeros(len(s.h), bool), np.zeros(len(s.h), np.int64)
    out[order] = place < size - (4 * size + 4) // 5 + 1
    places[order] = place
    return out, places


def has_partner(token: np.ndarray, ids: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which records, sorted by token and size, may be a first shared shingle.

    Where a shingle is the first that two linked sets share, their sizes allow
    the link, and enough of either set follows it to reach the intersection.
    """
    head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, int)
    count = np.diff(np.concatenate([head, [len(token)]]))
    out = np.zeros(len(token), bool)
    for m in np.unique(count[(count > 1) & (count <= SHORT_LIST)]).tolist():
        first = head[count == m][:, None]
        for i, j in zip(*np.triu_indices(m, 1)):
            a, b = (first + i).ravel(), (first + j).ravel()
            least = needed(size[a] + size[b])
            ok = (ids[a] != ids[b]) & (5 * size[a] >= 4 * size[b]) & (size[a] - place[a] >= least) & (size[b] - place[b] >= least)
            out[a[ok]] = out[b[ok]] = True
    for h, m in zip(head[count > SHORT_LIST].tolist(), count[count > SHORT_LIST].tolist()):
        sizes = size[h : h + m]
        near = np.searchsorted(sizes, sizes * 5 // 4, "right") - np.searchsorted(sizes, (4 * sizes + 4) // 5)
        out[h : h + m] = near > 1
    return out


def meetings(token: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A name for the list of each record, sorted by token, that depends on its members.

    Near copies share very many shingles, all of one list, which then counts once.
    """
    if not len(token):
        return np.zeros(0, U64)
    head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    names = mix(np.add.reduceat(mix(ids.astype(U64)), head))
    return np.repeat(names, np.diff(np.concatenate([head, [len(token)]])))


def _buckets(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(tokens) >> U64(64 - buckets.bit_length() + 1)).astype(np.int64)


def _with_heads(dealt: pa.RecordBatch, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """Dealt rows whose runs are of indices, with the ids and sizes these stand for."""
    heads = [np.frombuffer(x, np.int64) for x in dealt.column("ids").to_pylist()]
    named, sized = (pa.array([v[h].astype(np.int64).tobytes() for h in heads], pa.binary()) for v in (ids, sizes))
    return pa.RecordBatch.from_arrays([dealt.column(0), named, *dealt.columns[2:], sized], [*dealt.schema.names, "sizes"])


def _per_record(table: pa.Table, name: str) -> np.ndarray:
    """A value of each run, repeated for its records."""
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()])
    return np.repeat(np.concatenate([np.frombuffer(x, np.int64) for x in table.column(name).to_pylist()]), counts)


def shared_prefixes(docs: DataFrame, frequent: np.ndarray, make: Make, buckets: int) -> DataFrame:
    """(id, tokens): names of the lists of sets, by digest, that share a shingle of their prefixes."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT hashes

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(0)):
                s = make(data, offsets)
                h1, h2 = s.digests()
                fresh = np.zeros(hi - lo, bool)
                for i, pair in enumerate(zip(h1.tolist(), h2.tolist())):
                    fresh[i] = pair not in seen
                    seen.add(pair)
                if len(seen) > REMEMBERED:  # what is sent twice counts once
                    seen.clear()
                use, place = prefixes(s, known.value)
                use &= fresh[s.doc]
                out = deal(_buckets(s.h[use], buckets), s.doc[use], s.h[use], place[use])
                if out is not None:
                    yield _with_heads(out, h1, s.size)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "bucket"):
            ids, h, place = gather(table, ["<u8", "pos"])
            size = _per_record(table, "sizes")
            order = np.lexsort((ids, size, h))
            ids, h, place, size = ids[order], h[order], place[order], size[order]
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])])
            ids, h, place, size = ids[once], h[once], place[once], size[once]
            use = has_partner(h, ids, size, place)
            ids, meeting = ids[use], meetings(h[use], ids[use])
            if len(ids):
                order = np.lexsort((meeting, ids))
                ids, meeting = ids[order], meeting[order]
                fresh = np.concatenate([[True], (ids[1:] != ids[:-1]) | (meeting[1:] != meeting[:-1])])
                ids, meeting = ids[fresh], meeting[fresh]
                cuts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(ids[cuts[:-1]]), pa.array([meeting[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())], ["id", "tokens"])

    rows = map_batches(docs.select("text"), send, "bucket long, ids binary, counts binary, c0 binary, c1 binary, sizes binary")
    return map_batches(by_bucket(rows, buckets), meet, "id long, tokens binary")


class Bitmaps:
    """Parity bitmaps of sets by width, with halves folded for narrower partners."""

    def __init__(self, sizes: np.ndarray, raw: list[bytes]) -> None:
        self.sizes = sizes
        self.width = np.array([len(b) // 8 for b in raw], np.int64)
        self.row = np.zeros(len(raw), np.int64)
        self.full: dict[int, np.ndarray] = {}
        self.half: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            where = np.flatnonzero(self.width == w)
            self.row[where] = np.arange(len(where))
            m = np.frombuffer(b"".join(raw[i] for i in where.tolist()), U64).reshape(-1, w)
            self.full[w] = m
            if w > 1:
                self.half[w] = m[:, : w // 2] ^ m[:, w // 2 :]

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sizes and bitmaps allow the pairs to link (no link is refused)."""
        na, nb = self.sizes[a], self.sizes[b]
        ok = 5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)
        most = na + nb - 2 * needed(na + nb)
        low, high = np.where(self.width[a] <= self.width[b], a, b), np.where(self.width[a] <= self.width[b], b, a)
        for w in np.unique(self.width[low[ok]]).tolist():
            for source, other in ((self.full, w), (self.half, 2 * w)):
                pick = np.flatnonzero(ok & (self.width[low] == w) & (self.width[high] == other))
                for at in np.array_split(pick, max(1, len(pick) * w // 500_000)):
                    if len(at):
                        apart = np.bitwise_count(self.full[w][self.row[low[at]]] ^ source[other][self.row[high[at]]]).sum(1, dtype=np.int64)
                        ok[at] &= apart <= most[at]
        return ok


def family_edges(token: np.ndarray, member: np.ndarray, maps: Bitmaps) -> np.ndarray:
    """Root of each set after joining those that share a token and may link."""
    n = len(maps.sizes)
    order = np.lexsort((member, token))
    token, member = token[order], member[order]
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | (member[1:] != member[:-1])
    token, member = token[keep], member[keep]
    head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, int)
    size = np.diff(np.concatenate([head, [len(token)]]))
    pairs = []
    for m in np.unique(size[(size > 1) & (size <= SHORT_LIST)]).tolist():
        lists = member[head[size == m][:, None] + np.arange(m)]
        i, j = np.triu_indices(m, 1)
        pairs.append(np.unique((lists[:, i].astype(np.int64) * n + lists[:, j]).reshape(-1)))
    both = np.unique(np.concatenate([*pairs, np.zeros(0, np.int64)]))
    a, b = both // n, both % n
    ok = maps.may_link(a, b)
    root = union_find(n, a[ok], b[ok])
    for h, m in zip(head[size > SHORT_LIST].tolist(), size[size > SHORT_LIST].tolist()):
        pool = member[h : h + m]
        a, b = [], []
        while len(pool):
            same = root[pool] == root[pool[0]]
            frontier, pool = pool[same].tolist(), pool[~same]
            while frontier and len(pool):
                x = frontier.pop()
                hit = maps.may_link(np.full(len(pool), x), pool)
                if hit.any():
                    # With a set come those of its component.
                    hit = np.isin(root[pool], root[pool[hit]])
                    a += [x] * int(hit.sum())
                    b += pool[hit].tolist()
                    frontier += pool[hit].tolist()
                    pool = pool[~hit]
        if a:
            root = union_find(n, np.concatenate([np.arange(n), a]), np.concatenate([root, b]))
    return root


def families(shared: DataFrame, sets: DataFrame, buckets: int) -> DataFrame:
    """Edges (a, b) that join sets which share prefix shingles and may link.

    sets: (h1, n, bits), one row per set.
    """
    tokens = shared.groupBy(F.col("id").alias("h1")).agg(F.collect_list("tokens").alias("tokens"))
    rows = tokens.join(sets.select("h1", "n", "bits"), "h1").select("h1", "n", "bits", "tokens")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, sizes, bits = long_column(batch.column(0)), long_column(batch.column(1)), batch.column(2).to_pylist()
            found = [np.unique(np.frombuffer(b"".join(t), U64)) for t in batch.column(3).to_pylist()]
            index = np.repeat(np.arange(len(reps)), [len(f) for f in found])
            token = np.concatenate([*found, np.zeros(0, U64)])
            out = deal(_buckets(token, buckets), index, token)
            if out is None:
                continue
            maps = [b"".join(bits[i] for i in np.frombuffer(x, np.int64).tolist()) for x in out.column("ids").to_pylist()]
            out = _with_heads(out, reps, sizes)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(maps, pa.binary())], [*out.schema.names, "bits"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "bucket"):
            ids, token = gather(table, ["<u8"])
            heads = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
            sizes = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("sizes").to_pylist()])
            raw = b"".join(table.column("bits").to_pylist())
            reps, first = np.unique(heads, return_index=True)
            width = 8 * np.array([max(1, 1 << int(n - 1).bit_length() - 6) if n > 64 else 1 for n in sizes.tolist()], np.int64)
            at = np.concatenate([[0], np.cumsum(width)])
            maps = Bitmaps(sizes[first], [raw[at[i] : at[i + 1]] for i in first.tolist()])
            root = family_edges(token, np.searchsorted(reps, ids), maps)
            far = np.flatnonzero(root != np.arange(len(reps)))
            yield pa.RecordBatch.from_arrays([pa.array(reps[far]), pa.array(reps[root[far]])], ["a", "b"])

    dealt = map_batches(rows, send, "bucket long, ids binary, counts binary, c0 binary, sizes binary, bits binary")
    return map_batches(by_bucket(dealt, buckets), meet, "a long, b long")


class Lists:
    """Inverted lists of the sets of one family, relative to what most of them have.

    A shingle that more than half of the sets have is common. The list of a
    common shingle holds the sets that lack it, any other list those that have it, so
    no list holds more than half of the sets, however alike they are. Of sets
    that lack x and y of the `common` shingles, |q & s| = shared lists + common - x - y.
    """

    def __init__(self, h: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> None:
        self.sizes, self.n = sizes, len(sizes)
        order = np.argsort(h, kind="stable")
        doc = doc[order]
        first = np.unique(h[order], return_index=True)[1]
        length = np.diff(np.concatenate([first, [len(h)]]))
        of = np.repeat(np.arange(len(first)), length)
        common = np.flatnonzero(2 * length > self.n)
        item, member = [of[2 * length[of] <= self.n]], [doc[2 * length[of] <= self.n]]
        lacks = [np.zeros(0, int)]
        for k in common.tolist():
            held = np.zeros(self.n, bool)
            held[doc[first[k] : first[k] + length[k]]] = True
            lacks.append(np.flatnonzero(~held))
            item.append(np.full(len(lacks[-1]), k))
        item, lacks = np.concatenate(item), np.concatenate(lacks)
        member = np.concatenate([*member, lacks])
        self.common = len(common)
        self.lacks = np.bincount(lacks, minlength=self.n)
        order = np.lexsort((item, member))
        self.own, self.edge = item[order], np.searchsorted(member[order], np.arange(self.n + 1))
        order = np.lexsort((member, item))
        self.docs = member[order]
        self.first = np.searchsorted(item[order], np.arange(len(first)))
        self.length = np.bincount(item, minlength=len(first))

    def members(self, k: int) -> np.ndarray:
        """The sets of list k, in order."""
        return self.docs[self.first[k] : self.first[k] + self.length[k]]

    def search(self, q: int, among: np.ndarray) -> np.ndarray:
        """Sets that link with set q, of those that `among` marks."""
        fits = among & (5 * np.minimum(self.sizes[q], self.sizes) >= 4 * np.maximum(self.sizes[q], self.sizes))
        fits[q] = False
        if not fits.any():
            return np.zeros(0, int)
        # Lists that a set must share with q.
        need = needed(self.sizes[q] + self.sizes) - self.common + self.lacks[q] + self.lacks
        least = int(need[fits].min())
        if least <= 0:  # what is common is enough for some; all others are looked for
            sure = np.flatnonzero(fits & (need <= 0))
            return np.concatenate([sure, self.search(q, fits & (need > 0))])
        own = self.own[self.edge[q] : self.edge[q + 1]]
        if len(own) < least:
            return np.zeros(0, int)
        by_length = own[np.argsort(self.length[own], kind="stable")]
        # DivideSkip's number of long lists.
        long = min(least - 1, int(least / (0.01 * np.log2(max(2, self.length[by_length[-1]])) + 1)))
        short, probed = by_length[: len(own) - long], by_length[len(own) - long :]
        found, count = [], []
        for y, c in _merged([self.members(k).tolist() for k in short.tolist()]):
            if fits[y] and c + long >= need[y]:
                found.append(y)
                count.append(c)
        found, count = np.array(found, int), np.array(count, int)
        for left, k in zip(range(long, 0, -1), probed.tolist()):
            if left % 16 == 0:
                able = count + left >= need[found]
                found, count = found[able], count[able]
            if not len(found):
                break
            count += _is_in(self.members(k), found)
        return found[count >= need[found]]


def _merged(lists: list[list[int]]) -> Iterator[tuple[int, int]]:
    """(member, number of lists that have it) of sorted lists, merged by a heap."""
    now, count = -1, 0
    for y in heapq.merge(*lists):
        if y != now:
            if count:
                yield now, count
            now, count = y, 0
        count += 1
    if count:
        yield now, count


class Forest:
    """Components of a family's sets as links are found, and a link for each join."""

    def __init__(self, lists: Lists) -> None:
        self.lists = lists
        self.root = np.arange(lists.n)
        self.edges: list[tuple[int, int]] = []

    def ask(self, q: int) -> None:
        """Find the links of set q with sets that are not in its component."""
        root = self.root
        near = self.lists.search(q, root != root[q])
        for r in np.unique(root[near]).tolist():
            if r != root[q]:
                self.edges.append((q, int(near[root[near] == r][0])))
                root[root == r] = root[q]


def link_forest(lists: Lists) -> list[tuple[int, int]]:
    """Links that connect the components of a family.

    Of two components one is not the largest, so only sets outside the largest
    need to search.
    """
    forest = Forest(lists)
    asked = np.zeros(lists.n, bool)
    q = 0
    while True:
        asked[q] = True
        forest.ask(q)
        size = np.bincount(forest.root, minlength=lists.n)
        rest = np.flatnonzero(~asked & (forest.root != size.argmax()))
        if not len(rest):
            return forest.edges
        q = int(rest[0])


def links(rows: DataFrame, make: Make, index: type) -> DataFrame:
    """Links (a, b) among the sets of each task; rows: (task, node, text, asks).

    Where some rows ask and others do not, only those that ask search.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "task"):
            ids = long_column(table.column("node").combine_chunks())
            asks = np.array(table.column("asks").to_pylist(), bool)
            h, sizes = [], []
            for _, _, data, offsets in blocks(table.column("text")):
                s = make(data, offsets)
                h.append(s.h)
                sizes.append(s.size)
            sizes = np.concatenate(sizes)
            lists = index(np.concatenate(h), np.repeat(np.arange(len(ids)), sizes), sizes)
            if asks.all():
                edges = link_forest(lists)
            else:
                forest = Forest(lists)
                for q in np.flatnonzero(asks).tolist():
                    forest.ask(q)
                edges = forest.edges
            if edges:
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return map_batches(by_task(rows.select("task", "node", "text", "asks")), run, "a long, b long")


def _dealt(size: Column, seed: int) -> tuple[Column, Column]:
    """(number of blocks of so many sets, the block of a node)."""
    n = F.greatest(F.ceil(size / BLOCK), F.lit(0)).cast("long")
    return n, F.pmod(F.xxhash64(F.lit(seed), F.col("node")), F.greatest(n, F.lit(1)))


def connect(texts: DataFrame, family: DataFrame, scratch: Scratch, make: Make, index: type) -> DataFrame:
    """Links (a, b) that connect what links within families connect.

    texts: (node, family, size, weight, text), size being the sum of the family's weights;
    family: the same without texts.
    """
    yes = F.lit(True).alias("asks")
    first = links(texts.select(F.xxhash64("family", _dealt(F.col("size"), 17)[1]).alias("task"), "node", "text", yes), make, index)
    large = F.col("size") > BLOCK
    if family.where(large).isEmpty():
        return first
    texts, first = scratch.keep(texts.where(large)), scratch.keep(first)
    family = texts.select("node", "family", "size", "weight")

    def rooted(edges: DataFrame) -> DataFrame:
        found = components(edges, scratch).withColumnRenamed("component", "root")
        return family.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))

    # The first of each component that a block found stands for it.
    heads = scratch.keep(rooted(first).where("root = node").select("node", "family", "weight"))
    counts = heads.groupBy("family").agg(F.sum("weight").alias("heads"))
    heads = texts.join(heads.join(counts, "family").select("node", "heads"), "node")
    second = scratch.keep(links(heads.select(F.xxhash64("family", _dealt(F.col("heads"), 19)[1]).alias("task"), "node", "text", yes), make, index))
    # What no block has found has an end outside the largest component.
    placed = scratch.keep(rooted(first.union(second)).select("node", "family", "root", "weight"))
    sizes = placed.groupBy("family", "root").agg(F.sum("weight").alias("k"))
    main = sizes.groupBy("family").agg(F.max_by("root", F.struct("k", "root")).alias("main"), (F.sum("k") - F.max("k")).alias("askers"), F.sum("k").alias("k")).where("askers > 0")
    main = scratch.keep(main)
    askers = join_spread(placed, main, ["family"], "k", F.col("node")).where("root <> main").select("node")
    rows = join_spread(texts, main, ["family"], "k", F.col("node")).where("main IS NOT NULL")
    own, ask = _dealt(F.col("size"), 17), _dealt(F.col("askers"), 23)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other")
    sets = rows.select("node", "family", "text", own[1].alias("mine"), each(ask[0])).select(F.xxhash64("family", "other", "mine").alias("task"), "node", "text", F.lit(False).alias("asks"))
    asked = rows.join(askers, "node").select("node", "family", "text", ask[1].alias("mine"), each(own[0])).select(F.xxhash64("family", "mine", "other").alias("task"), "node", "text", yes)
    return first.union(second).union(links(sets.union(asked), make, index))


def classes(docs: DataFrame, scratch: Scratch, by_row: bool = False, make: Make = shingles, index: type = Lists) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; by_row: with a hash of the text, `row`."""
    d = only(docs, "doc_id", "text").withColumn("row", F.xxhash64("text"))
    buckets = bucket_count(d)
    profile = scratch.keep(profiles(d, make))
    frequent = frequent_shingles(profile)
    mine = profile.where("seen IS NULL").drop("seen")
    full = mine.where("n > 0 AND doc_id IS NOT NULL")
    first = F.struct("doc_id", "row")
    sets = scratch.keep(full.groupBy("n", "h1", "h2").agg(F.min(first).alias("first"), F.min_by("bits", first).alias("bits"), F.count("*").alias("copies")))
    known = d.where("doc_id IS NOT NULL")
    found = components(families(shared_prefixes(known, frequent, make, buckets), sets, buckets), scratch).withColumnRenamed("component", "family")
    found = scratch.keep(found.join(sets.select(F.col("h1").alias("node"), "first", F.greatest(F.lit(1), F.col("n") / SET_SHINGLES).cast("long").alias("weight")), "node"))
    sizes = found.groupBy("family").agg(F.sum("weight").alias("size"))
    most = largest(sizes, "size")
    family = join_counted(found, sizes.withColumn("k", F.col("size")), ["family"], "k", F.col("node"), most)
    family = scratch.keep(family.select("node", "family", "size", "weight", "first.doc_id", "first.row"))
    # Most documents are in no family; their texts are not shuffled.
    texts = may_match(known, family, ["doc_id", "row"])[0].join(family, ["doc_id", "row"]).select("node", "family", "size", "weight", "text")
    linked = scratch.keep(components(connect(texts, family, scratch, make, index), scratch).withColumnRenamed("node", "h1"))
    named = sets.select("n", "h1", "h2", "copies", F.col("first.doc_id").alias("rep")).join(linked, "h1", "left")
    names = named.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("k"))
    named = join_counted(named, names, ["component"], "k", F.col("h1"), most).select("n", "h1", "h2", "copies", F.coalesce("least", "rep").alias("component_id"))
    known_class = join_spread(full.drop("bits"), named, ["n", "h1", "h2"], "copies", F.col("doc_id"))
    rest = mine.where("n = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    keys = ["doc_id", "row"] if by_row else ["doc_id"]
    shown = [*keys, F.col("n").alias("n_shingles"), "component_id"]
    return known_class.select(*shown).union(rest.select(*shown))


def keep_first(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """documents of which one of each component stays, with all their columns.

    It is the one of the smallest doc_id; of several rows of that id in the
    component, one of the smallest hash of the text, and of those that are equal in both, of all
    columns. Rows that link with nothing all stay.
    """
    found = scratch.keep(classes(docs, scratch, by_row=True).where("doc_id IS NOT NULL AND n_shingles > 0"))
    rows = found.groupBy("doc_id", "row", "component_id").agg(F.count("*").alias("copies"))
    least = rows.groupBy("doc_id", "component_id").agg(F.min("row").alias("least"))
    told = scratch.keep(rows.join(least, ["doc_id", "component_id"]).withColumn("stays", (F.col("component_id") == F.col("doc_id")) & (F.col("row") == F.col("least"))))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    all_rows = docs.select(F.struct(*columns).alias("all"), F.col("doc_id").alias("id_key"), F.xxhash64("text").alias("text_key"))

    def at(some: DataFrame, how: str, of: DataFrame) -> DataFrame:
        """Rows of `of` that are, or are not, among some (doc_id, row)."""
        keys = some.select(F.col("doc_id").alias("id_key"), F.col("row").alias("text_key"))
        return of.join(keys, ["id_key", "text_key"], how)

    gone = told.where("NOT stays")
    near, far = may_match(all_rows, gone, ["doc_id", "row"], ["id_key", "text_key"])
    kept = at(gone, "left_anti", near)
    kept = kept if far is None else kept.unionByName(far)
    again = told.where("stays AND copies > 1")
    if not again.isEmpty():
        one = at(again, "left_semi", kept).groupBy("id_key", "text_key").agg(F.min_by("all", F.xxhash64(F.to_json("all"))).alias("all"))
        kept = at(again, "left_anti", kept).unionByName(one)
    return kept.select("all.*")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(tune(spark), "ngrams"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS k FROM g GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.k >= 80 * (x.k + y.k - o.k)
), reach(node, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.b, r.root FROM reach r JOIN link l ON r.node = l.a AND r.root < l.b
), c AS (
  SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node
)
SELECT c.doc_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_shingles, c.component_id FROM c LEFT JOIN n USING (doc_id)
"""
