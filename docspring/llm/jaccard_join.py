"""N-gram Jaccard join (5): PartEnum signatures.

Sets are put in bands of nearly equal size. Two sets of a band whose Jaccard similarity reaches the threshold differ in at
most k elements, so if the feature domain is cut into n1 parts, most of them differ in no more than k2; each part is cut
into n2 subparts, and for every choice of n2 - k2 subparts their content is a signature. Sufficiently similar sets share
one. Sets that share a signature stand in one bucket. Within a bucket the pairs that exact bounds (sizes, odd sketches)
leave possible are spanned by a forest, its edges are compared element by element, and components are contracted; only where
an edge fails are the other possible pairs between components compared. Where sketches leave many of those (sets that are all
just under the threshold, as pages of one template are), the bucket's sets are joined by their elements instead, with a prefix
filter over what is rare in the bucket. So no group gives all its pairs.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspring.llm.common import Scratch, as_bytes, mix, partitions, slices, trimmed, windows_of, words_of

#: A stage on word shingles takes five words and 80 percent, unless it is told otherwise.
SHINGLE = 5
PERCENT = 80
#: (k2, n2) of the signatures, weaker to stronger. A bucket of more than BUCKET sets is crowded: its sets are compared with
#: REPS of it, and if that doesn't join them all they go on to the next signatures; the last are compared chunk by chunk.
SCHEMES = ((1, 3), (2, 5), (3, 7))
BUCKET, REPS = 4096, 8
#: Parts beyond those needed, as a share: thinly filled parts need no signature then.
SPARE = 0.1
#: Bits of a sketch for each element in which similar sets may differ; bits at least and at most.
SKETCH_RATE, SKETCH_LEAST, SKETCH_MOST = 16, 256, 1 << 16
#: Up to so many sets of a bucket are compared in one step.
MATRIX = 96
#: A bucket in which sketches leave more than CLOSE pairs for each set is joined by its elements, up to so many in one worker.
CLOSE, ELEMENTS = 8, 16_000_000
FILTER_BITS = 23
#: Parts that signatures are dealt out to, at least; how many a worker holds before it sends them, and before it lets go of
#: what stands in crowded buckets.
PARTS, OUTBOX, HELD = 256, 1_000_000, 4_000_000


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text (lower-cased A to Z). Fewer words than a shingle make one of all."""
    words = words_of([x.lower() for x in texts])
    at, hashes = windows_of(words.hashes, words.first, size)
    edges = np.searchsorted(at, words.first)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        hashes[lo:hi].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[edges[:-1][edges[:-1] < len(hashes)]] = True
    hashes, edges = hashes[new], np.concatenate([[0], np.cumsum(new)])[edges]
    out = []
    for k in range(len(texts)):
        some = hashes[edges[k] : edges[k + 1]]
        if not len(some) and words.first[k + 1] > words.first[k]:
            n = int(words.first[k + 1] - words.first[k])
            one = words.hashes[words.first[k] : words.first[k + 1]]
            some = mix(windows_of(one, np.array([0, n]), n)[1] + np.uint64(n))
        out.append(some)
    return out


class Bands:
    """Sizes from 1 in bands whose ends are in the ratio of the threshold. A set stands in its own band and in the next."""

    def __init__(self, percent: int):
        self.percent, self.lows = percent, [1]

    def of(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.lows.append(max(self.lows[-1] + 1, math.ceil(self.lows[-1] * 100 / self.percent)))
        return int(np.searchsorted(self.lows, size, "right")) - 1

    def differ(self, band: int) -> int:
        """Elements in which two sets of the band may differ: both of its largest size."""
        while len(self.lows) <= band + 1:
            self.of(self.lows[-1])
        high = self.lows[band + 1] - 1
        return 2 * high * (100 - self.percent) // (100 + self.percent)


def signatures(sets: list[np.ndarray], bands: Bands, step: int, scheme: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit signatures of non-empty sets in their own band (step 0) or in the next (1), and the set that each is of.
    Bands whose sets may not differ at all need none."""
    k2, n2 = scheme
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    band = np.array([bands.of(n) + step for n in sizes.tolist()], np.int64)
    differ = np.array([bands.differ(b) for b in band.tolist()], np.int64)
    some = np.flatnonzero(differ)
    if not len(some):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sizes, band, differ = sizes[some], band[some], differ[some]
    elements = np.concatenate([sets[k] for k in some.tolist()])
    bad = differ // (k2 + 1)  # parts that may differ in more than k2 elements
    need = bad + 1
    n1 = np.where(bad > 0, need + np.ceil(SPARE * need).astype(np.int64), 1)
    salt = ((band * 1_000_003 + k2 * 101 + n2) & 0xFFFFFFFF).astype(np.uint64)
    spot = mix(elements ^ np.repeat(mix(salt), sizes)) >> np.uint64(32)
    sub = ((spot * np.repeat((n1 * n2).astype(np.uint64), sizes)) >> np.uint64(32)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(n1)])  # the first part of each set
    sub += np.repeat(base[:-1] * n2, sizes)
    content = np.zeros(base[-1] * n2, np.uint64)
    np.add.at(content, sub, mix(elements + np.uint64(0x9E3779B97F4A7C15)))
    fill = np.bincount(sub // n2, minlength=base[-1])
    owner = np.repeat(np.arange(len(some)), n1)
    # a part that counts for one of two similar sets has at most k2 elements fewer in the other
    least = fill[np.lexsort((fill, owner))][base[:-1] + n1 - need] - k2
    kept = np.flatnonzero(fill >= least[owner])
    owner = owner[kept]
    content = content.reshape(-1, n2)[kept]
    begin = mix((salt[owner] << np.uint64(32)) + (kept - base[:-1][owner]).astype(np.uint64))
    out = []
    for c, chosen in enumerate(combinations(range(n2), n2 - k2)):
        key = begin + np.uint64(c)
        for j in chosen:
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + content[:, j])
        out.append(key)
    return np.concatenate(out), np.tile(some[owner], len(out))


def sketch(elements: np.ndarray, bands: Bands) -> bytes:
    """For each bit whether an odd number of elements falls on it. Two sketches differ in no more bits than their sets in
    elements; the halves of a sketch put on one another are the sketch of half the size."""
    bits = SKETCH_LEAST
    while bits < SKETCH_MOST and bits < SKETCH_RATE * bands.differ(bands.of(len(elements))):
        bits *= 2
    return np.packbits(np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def stacked(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the size of the shortest."""
    size, rows = min(map(len, sketches)), []
    for x in sketches:
        while len(x) > size:
            half = np.frombuffer(x, np.uint8).reshape(2, -1)
            x = (half[0] ^ half[1]).tobytes()
        rows.append(x)
    return np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)


class Bucket:
    """Sets of one bucket: ids, components, sizes and sketches."""

    def __init__(self, ids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, sketches: list[bytes], percent: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.comps, self.sizes, self.percent = ids[order], comps[order], sizes[order], percent
        self.words = stacked([sketches[k] for k in order.tolist()])

    def possible(self, i: int | np.ndarray, others: np.ndarray) -> np.ndarray:
        """Which of the others (columns) may be linked to i (rows) and is of another component."""
        rows = np.atleast_1d(i)
        apart = np.concatenate([np.bitwise_count(self.words[r, None, :] ^ self.words[None, others, :]).sum(axis=2, dtype=np.int64) for r in np.array_split(rows, max(1, len(rows) * len(others) * self.words.shape[1] >> 20))])
        a, b = self.sizes[rows][:, None], self.sizes[others][None, :]
        p = self.percent
        # 100 * common >= p * union with common = (a + b - apart) / 2 at most
        good = ((100 + p) * apart <= (100 - p) * (a + b)) & (100 * np.minimum(a, b) >= p * np.maximum(a, b))
        return good & (self.comps[rows][:, None] != self.comps[others][None, :])

    def pairs(self, every: bool) -> Iterator[tuple[int, int]]:
        """A forest that spans what is possible, or every possible pair, given out one by one."""
        n = len(self.ids)
        if (self.comps == self.comps[0]).all():
            return
        everyone = np.arange(n)
        matrix = self.possible(everyone, everyone) if n <= MATRIX else None
        if matrix is not None and not matrix.any():
            return
        row = (lambda i, others: matrix[i, others]) if matrix is not None else (lambda i, others: self.possible(i, others)[0])
        if every:
            for i in range(n):
                for j in np.flatnonzero(row(i, everyone[i + 1 :])).tolist():
                    yield int(self.ids[i]), int(self.ids[i + 1 + j])
            return
        left = everyone  # not reached yet
        alone = len(np.unique(self.comps)) == n
        while len(left) > 1:
            queue = left[:1].tolist() if alone else left[self.comps[left] == self.comps[left[0]]].tolist()
            left = left[1:] if alone else np.setdiff1d(left, queue)
            while queue and len(left):
                i = heapq.heappop(queue)  # the least id first: other buckets then give the same edges
                hit = left[row(i, left)]
                if len(hit):
                    if not alone:  # one edge for each component, and all of its sets are reached
                        of = self.comps[hit]
                        hit = hit[np.unique(of, return_index=True)[1]]
                        reached = left[np.isin(self.comps[left], of)]
                    else:
                        reached = hit
                    for j in hit.tolist():
                        yield min(int(self.ids[i]), int(self.ids[j])), max(int(self.ids[i]), int(self.ids[j]))
                    left = np.setdiff1d(left, reached, assume_unique=True)
                    for j in reached.tolist():
                        heapq.heappush(queue, j)


def plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a hash of the text, which tell rows apart that have one id and different texts."""
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def digest_of(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def name_of(digest: bytes, renamed: frozenset[int]) -> int:
    """A set's 64-bit name: the first half of its digest, or the second where sets of different digests share the first."""
    first = int.from_bytes(digest[:8], "little", signed=True)
    return int.from_bytes(digest[8:], "little", signed=True) if first in renamed else first


def shingled(docs: DataFrame, size: int, percent: int, renamed: frozenset[int], digest=digest_of) -> DataFrame:
    """doc_id, text_key, n, and for a set that isn't empty its name, digest and sketch, of each row of plain()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            texts = [x or b"" for x in as_bytes(batch["text"])]
            for lo, hi in slices(texts):
                sets = shingle_sets(texts[lo:hi], size)
                digests = [digest(x) if len(x) else None for x in sets]
                columns = [pa.array([len(x) for x in sets], pa.int64()), pa.array([d and name_of(d, renamed) for d in digests], pa.int64()), pa.array(digests, pa.binary()), pa.array([sketch(x, bands) if len(x) else None for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], batch["text_key"][lo:hi], *columns], names=["doc_id", "text_key", "n", "set_id", "digest", "sketch"])

    return docs.mapInArrow(trimmed(run), "doc_id long, text_key long, n long, set_id long, digest binary, sketch binary")


def few(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of 2**FILTER_BITS bits over the column id: of one size whatever the table's, so it can be sent to all tasks.
    Over a table that is too long for it, it lets more pass, and rows are only moved in vain."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            for at in filter_places(batch.column(0).to_numpy(zero_copy_only=False)):
                bits[at] = True
        if bits.any():
            yield pa.RecordBatch.from_pydict({"part": pa.array([int(bits.sum()) % 8], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
        for batch in batches:
            for x in batch.column(1).to_pylist():
                bits |= np.frombuffer(x, np.uint8)
        if bits.any():  # at most 8 partitions have rows, however many there are
            yield pa.RecordBatch.from_pydict({"bits": pa.array([bits.tobytes()], pa.binary())})

    parts = ids.mapInArrow(fill, "part int, bits binary").repartition(8, "part").mapInArrow(merge, "bits binary").collect()
    return np.bitwise_or.reduce([np.zeros((1 << FILTER_BITS) // 8, np.uint8), *(np.frombuffer(r.bits, np.uint8) for r in parts)])


def lets_through(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), bool)
    for at in filter_places(ids):
        out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
    return out


def filter_places(ids: np.ndarray) -> list[np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64))
    return [((h + np.uint64(k) * (h >> np.uint64(32) | np.uint64(1))) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64) for k in range(3)]


def bucket_rows(docs: DataFrame, scheme: tuple[int, int], percent: int, size: int, parts: int, renamed: frozenset[int], only: np.ndarray | None, digest=digest_of) -> DataFrame:
    """members: the sets that share a signature; equal lists of one task are given once. Crowded buckets are given in chunks,
    with their signature as key and the chunk's number, each chunk with the same REPS sets. only: a filter over the sets that
    matter."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, keys, owners, seen = Bands(percent), [], [], set()
        for batch in batches:
            texts = [x or b"" for x in as_bytes(batch.column(0))]
            for lo, hi in slices(texts, 1_000_000):
                sets = {name_of(digest(x), renamed): x for x in shingle_sets(texts[lo:hi], size) if len(x)}
                ids = np.array([i for i in sets if i not in seen], np.int64)
                if only is not None and len(ids):
                    ids = ids[lets_through(only, ids)]
                if len(seen) > 1_000_000:  # copies are merged where they meet, this only sends fewer
                    seen.clear()
                seen.update(ids.tolist())
                if not len(ids):
                    continue
                for step in (0, 1):
                    key, owner = signatures([sets[i] for i in ids.tolist()], bands, step, scheme)
                    keys.append(key)
                    owners.append(ids[owner])
                if sum(map(len, keys)) >= OUTBOX:
                    yield outgoing(keys, owners, parts)
                    keys, owners = [], []
        if keys:
            yield outgoing(keys, owners, parts)

    def listed(lists: list[bytes]) -> pa.RecordBatch:
        return chunk_batch([None] * len(lists), [None] * len(lists), lists)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, size = [], [], 0
        hot: dict[int, tuple[np.ndarray, int]] = {}  # crowded so far: representatives, chunks given

        def crowded(key: int, owner: np.ndarray) -> Iterator[pa.RecordBatch]:
            reps, n = hot.get(key, (owner[:REPS], 0))
            rest = np.setdiff1d(owner, reps)
            for lo in range(0, len(rest), BUCKET - REPS):
                yield chunk_batch([key], [n], [np.concatenate([reps, rest[lo : lo + BUCKET - REPS]]).tobytes()])
                n += 1
            hot[key] = reps, n

        def settled(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal keys, ids, size
            key, owner = np.concatenate(keys), np.concatenate(ids)
            order = np.argsort(key)
            again = key[order]
            again = np.concatenate([[False], again[1:] == again[:-1]])
            again = order[again | np.concatenate([again[1:], [False]])]
            held = np.ones(len(key), bool)
            held[again] = False
            if hot:
                again = np.union1d(again, np.flatnonzero(np.isin(key, np.fromiter(hot, np.int64, len(hot)).view(np.uint64))))
                held[again] = False
            single = (key[held], owner[held])
            key, owner = key[again], owner[again]
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            if len(key):
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])  # equal sets are one
                key, owner = key[new], owner[new]
            begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            counts = np.diff(np.concatenate([begins, [len(key)]]))
            wide = (counts > BUCKET) | np.isin(key[begins].view(np.int64), np.fromiter(hot, np.int64, len(hot)))
            for b, c in zip(begins[wide].tolist(), counts[wide].tolist(), strict=True):
                yield from crowded(int(key[b].view(np.int64)), owner[b : b + c])
            if last:
                good = ~wide & (counts > 1)
                raw, lists = owner.tobytes(), set()
                for b, c in zip(begins[good].tolist(), counts[good].tolist(), strict=True):
                    lists.add(raw[8 * b : 8 * (b + c)])
                    if len(lists) >= 100_000:
                        yield listed(list(lists))
                        lists = set()
                if lists:
                    yield listed(list(lists))
            else:
                stay = np.repeat(~wide, counts)
                keys, ids = [single[0], key[stay]], [single[1], owner[stay]]
                size = sum(map(len, keys))

        limit = HELD
        for batch in batches:
            for k, own, at in zip(*(batch[c].to_pylist() for c in ("keys", "ids", "which")), strict=True):
                keys.append(np.frombuffer(k, np.uint64))
                ids.append(np.frombuffer(own, np.int64)[np.frombuffer(at, np.uint16)])
                size += len(keys[-1])
                if size >= limit:
                    yield from settled(False)
                    limit = max(HELD, 2 * size)
        if keys:
            yield from settled(True)

    made = docs.select("text").mapInArrow(trimmed(make), "part int, keys binary, ids binary, which binary")
    return made.repartition(partitions(docs.sparkSession), "part").mapInArrow(trimmed(repeated), "key long, chunk int, members array<long>")


def chunk_batch(keys: list, chunks: list, lists: list[bytes]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, lists)]) // 8
    members = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(lists), np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(chunks, pa.int32()), members], names=["key", "chunk", "members"])


def outgoing(keys: list[np.ndarray], owners: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """Signatures and their sets (different ones, and which is each one's), in rows of at most 65,536 for each part."""
    key, owner = np.concatenate(keys), np.concatenate(owners)
    part = (key % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    key, owner, part = key[order], owner[order], part[order]
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
    cuts = [(lo, min(lo + 65_536, b)) for a, b in zip(edges, [*edges[1:], len(part)], strict=True) for lo in range(a, b, 65_536)]
    named = [np.unique(owner[a:b], return_inverse=True) for a, b in cuts]
    return pa.RecordBatch.from_pydict({"part": pa.array([int(part[a]) for a, _ in cuts], pa.int32()), "keys": pa.array([key[a:b].tobytes() for a, b in cuts], pa.binary()), "ids": pa.array([x.tobytes() for x, _ in named], pa.binary()), "which": pa.array([x.astype(np.uint16).tobytes() for _, x in named], pa.binary())})


class Group:
    """Sets of one bucket with their elements: the links between its components, exactly.

    A prefix filter: elements are ordered by how many of the bucket's sets have them, the rare ones first, so sets that are
    alike but for what is their own meet in no posting. Sets come by size; the postings hold the first elements of each, those
    that a set as large or larger can't miss all of, and a set probes with the longer prefix that smaller ones need. Sets that
    are in one component already, given or found, aren't compared."""

    def __init__(self, ids: list[int], comps: list[int], sets: list[np.ndarray], percent: int):
        self.ids, self.percent = ids, percent
        self.top = {c: c for c in comps}
        self.comps = comps
        values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int64)
        rank[np.lexsort((values, counts))] = np.arange(len(values))
        edges = np.cumsum([0, *map(len, sets)])
        self.sets = [np.sort(rank[at[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def find(self, c: int) -> int:
        while self.top[c] != c:
            self.top[c] = c = self.top[self.top[c]]
        return c

    def links(self) -> Iterator[tuple[int, int]]:
        """As many as join the components, at most one less than there are."""
        p, postings = self.percent, defaultdict(list)
        for i in sorted(range(len(self.sets)), key=lambda k: (len(self.sets[k]), self.ids[k])):
            x = self.sets[i]
            n = len(x)
            probe = x[: n - -(-p * n // 100) + 1].tolist()
            for j in sorted({j for e in probe for j in postings.get(e, ())}):
                y = self.sets[j]
                a, b = self.find(self.comps[i]), self.find(self.comps[j])
                if a == b or 100 * len(y) < p * n:
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= p * (n + len(y) - common):
                    self.top[max(a, b)] = min(a, b)
                    yield min(self.ids[i], self.ids[j]), max(self.ids[i], self.ids[j])
            for e in x[: n - -(-2 * p * n // (100 + p)) + 1].tolist():
                postings[e].append(i)


def close_links(members: DataFrame, docs: DataFrame, sets: DataFrame, percent: int, size: int, scratch: Scratch) -> DataFrame:
    """a, b: links that join the components of each unit, by the elements of its sets. members: unit, set_id, comp."""
    texts = texts_of(members.select("set_id").distinct(), docs, sets, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids, comps, held = None, [], [], []

        def joined() -> pa.RecordBatch:
            found = list(Group(ids, comps, held, percent).links()) if len(ids) > 1 else []
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            texts = as_bytes(batch["text"])
            columns = [batch[k].to_pylist() for k in ("unit", "set_id", "comp")]
            for lo, hi in slices(texts, 1_000_000):
                for u, i, c, x in zip(*(col[lo:hi] for col in columns), shingle_sets(texts[lo:hi], size), strict=True):
                    if u != unit:
                        if ids:
                            yield joined()
                        unit, ids, comps, held = u, [], [], []
                    ids.append(i)
                    comps.append(c)
                    held.append(x)
        if ids:
            yield joined()

    rows = members.join(texts.hint("merge"), "set_id").select("unit", "set_id", "comp", "text")
    ordered = rows.repartition(partitions(members.sparkSession), "unit").sortWithinPartitions("unit", "set_id")
    return ordered.mapInArrow(trimmed(run), "a long, b long").distinct()


def proposals(members: DataFrame, percent: int, every: bool) -> DataFrame:
    """From unit, set_id, comp, n, sketch: pairs (a < b) of sets of different components that share a unit and may be linked;
    for each unit a forest that spans them, or all. A unit of more than CLOSE pairs a set gives its number instead (unit), unless
    it has more ELEMENTS than a worker holds: then its pairs are given out as they are found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        unit, pairs, close = None, set(), []

        def out() -> pa.RecordBatch:
            rows = [(a, b, None) for a, b in pairs] + [(None, None, u) for u in close]
            pairs.clear()
            close.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b", "unit"])

        def flush() -> Iterator[pa.RecordBatch]:
            n = len(held[0])
            if n < 2:
                return
            found = Bucket(np.array(held[0], np.int64), np.array(held[1], np.int64), np.array(held[2], np.int64), held[3], percent).pairs(every)
            if every and sum(held[2]) <= ELEMENTS:
                some = list(islice(found, CLOSE * n + 1))
                if len(some) > CLOSE * n:
                    close.append(int(unit))
                else:
                    pairs.update(some)
                return
            for pair in found:
                pairs.add(pair)
                if len(pairs) > 200_000:
                    yield out()

        for batch in batches:
            units = batch["unit"].to_numpy()
            edges = [0, *(np.flatnonzero(units[1:] != units[:-1]) + 1).tolist(), len(units)] if len(units) else [0]
            columns = [batch[k].to_pylist() for k in ("set_id", "comp", "n", "sketch")]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if units[lo] != unit:
                    yield from flush()
                    held, unit = [[], [], [], []], units[lo]
                for h, c in zip(held, columns, strict=True):
                    h += c[lo:hi]
                if len(pairs) > 200_000:
                    yield out()
        yield from flush()
        if pairs or close:
            yield out()

    ordered = members.select("unit", "set_id", "comp", "n", "sketch").repartition(partitions(members.sparkSession), "unit").sortWithinPartitions("unit")
    return ordered.mapInArrow(trimmed(run), "a long, b long, unit long").distinct()


def texts_of(ids: DataFrame, docs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """set_id and one text of each of these sets (set_id). Texts are smaller than sets, so they are what moves, and only those
    that a filter of fixed size lets through."""
    wanted = scratch.stored(sets.select("set_id", "doc_id", "text_key").join(ids.hint("merge"), "set_id", "left_semi"), "wanted")
    only = few(wanted.select("text_key"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(lets_through(only, batch["text_key"].fill_null(0).to_numpy(zero_copy_only=False))))

    found = docs.mapInArrow(trimmed(pick), docs.schema).withColumn("doc_id", F.coalesce("doc_id", F.lit(0))).join(wanted.withColumn("doc_id", F.coalesce("doc_id", F.lit(0))).hint("merge"), ["doc_id", "text_key"])
    return scratch.stored(found.select("set_id", "text").dropDuplicates(["set_id"]), "texts")


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, percent: int, size: int, scratch: Scratch) -> DataFrame:
    """a, b and whether they are linked, by the sets of one text of each."""
    ids = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    texts = texts_of(ids, docs, sets, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = as_bytes(batch["x"]), as_bytes(batch["y"])
            same = []
            for lo, hi in slices(left, 1_000_000):
                sets = [shingle_sets(side[lo:hi], size) for side in (left, right)]
                for x, y in zip(*sets, strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    same.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(same, pa.bool_())], names=["a", "b", "linked"])

    left = texts.select(F.col("set_id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("set_id").alias("b"), F.col("text").alias("y"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(trimmed(run), "a long, b long, linked boolean")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """set_id and comp (the least id of its component) of the sets in links (a, b): least neighbour, then the label's label,
    until nothing changes."""
    edges = scratch.stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.stored(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "set_id"), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.set_id).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.set_id == near.a).select("set_id", "comp", F.least("comp", "near").alias("to"))
        up = labels.select(F.col("set_id").alias("to"), F.col("comp").alias("top"))
        moved = scratch.stored(step.join(up, "to").select("set_id", "comp", F.least("to", "top").alias("new")), "labels")
        labels = moved.select("set_id", F.col("new").alias("comp"))
        if moved.where("comp <> new").isEmpty():
            return labels


def contracted(comps: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """comps (set_id, comp) after more links: only the components that these join are labelled anew."""
    if comps is None:
        return components(links, scratch)
    of = [comps.select(F.col("set_id").alias(c), F.col("comp").alias(f"comp_{c}")) for c in ("a", "b")]
    edges = links.select("a", "b").join(of[0].hint("merge"), "a", "left").join(of[1].hint("merge"), "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")).where("a <> b")
    new = components(scratch.stored(edges.distinct(), "edges"), scratch)
    known = comps.select("set_id", "comp").unionByName(new.join(comps.hint("merge"), "set_id", "left_anti").select("set_id", F.col("set_id").alias("comp")))
    top = new.select(F.col("set_id").alias("comp"), F.col("comp").alias("top"))
    return scratch.stored(known.join(top.hint("merge"), "comp", "left").select("set_id", F.coalesce("top", "comp").alias("comp")), "comps")


def linked_sets(docs: DataFrame, sets: DataFrame, percent: int, size: int, scratch: Scratch, renamed: frozenset[int] = frozenset(), digest=digest_of) -> DataFrame | None:
    """set_id and comp, the least set of its component, for the sets (set_id, doc_id, text_key, n, sketch) that are linked to
    others. Sets that are already joined are compared no further."""
    parts, comps, tested, only = max(PARTS, partitions(docs.sparkSession)), None, None, None

    def settle(units: DataFrame) -> None:
        """Joins all linked sets that share a unit (unit, members): by forests, at first with each set in its largest unit
        alone, then by all pairs of units with a failed edge, or by their elements where those pairs are many."""
        nonlocal comps, tested
        for step in ("largest", "all", "every pair"):
            members = units.select("unit", F.explode("members").alias("set_id"))
            if step == "largest":
                sized = units.select("unit", F.size("members").alias("size"), F.explode("members").alias("set_id"))
                members = sized.groupBy("set_id").agg(F.max(F.struct("size", "unit")).alias("best")).select("best.unit", "set_id")
            elif step == "every pair":
                if tested is None or tested.where(~F.col("linked")).isEmpty():
                    return
                failed = tested.where(~F.col("linked"))
                failed = failed.select(F.col("a").alias("set_id")).unionByName(failed.select(F.col("b").alias("set_id"))).distinct()
                touched = members.join(failed.hint("merge"), "set_id", "left_semi").groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("unit")
                members = members.join(touched.hint("merge"), "unit", "left_semi")
            if comps is None:
                members = members.withColumn("comp", F.col("set_id"))
            else:
                labelled = scratch.stored(members.join(comps.hint("merge"), "set_id", "left").select("unit", "set_id", F.coalesce("comp", "set_id").alias("comp")), "labelled")
                mixed = labelled.groupBy("unit").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("unit")
                members = labelled.join(mixed.hint("merge"), "unit", "left_semi")
            found = proposals(members.join(sets.select("set_id", "n", "sketch").hint("merge"), "set_id"), percent, step == "every pair")
            if step == "every pair":
                found = scratch.stored(found, "proposals")
                close = found.where("unit is not null").select("unit")
                if not close.isEmpty():
                    new = scratch.stored(close_links(members.select("unit", "set_id", "comp").join(close.hint("merge"), "unit", "left_semi"), docs, sets, percent, size, scratch), "links")
                    if not new.isEmpty():
                        comps = contracted(comps, new, scratch)
            pairs = found.where("unit is null").select("a", "b")
            if tested is not None:
                pairs = pairs.join(tested.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
            pairs = scratch.stored(pairs, "pairs")
            if not pairs.isEmpty():
                checked = scratch.stored(verified(pairs, docs, sets, percent, size, scratch), "checked")
                tested = checked if tested is None else tested.unionByName(checked)
                if not (new := checked.where("linked")).isEmpty():
                    comps = contracted(comps, new, scratch)

    for level, scheme in enumerate(SCHEMES):
        rows = scratch.stored(bucket_rows(docs, scheme, percent, size, parts, renamed, only, digest), "buckets")
        small, crowd = rows.where("chunk is null").select("members").distinct(), rows.where("chunk is not null")
        nothing = F.lit(None).cast("long").alias("key")
        units = scratch.stored(small.select(nothing, "members").unionByName(crowd.select("key", "members")).withColumn("unit", F.monotonically_increasing_id()), "units")
        settle(units)
        if crowd.isEmpty():
            break
        members = crowd.select("key", F.explode("members").alias("set_id"))
        labelled = members.withColumn("comp", F.col("set_id")) if comps is None else members.join(comps.hint("merge"), "set_id", "left").select("key", "set_id", F.coalesce("comp", "set_id").alias("comp"))
        mixed = scratch.stored(labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "mixed")
        if mixed.isEmpty():
            break
        if level + 1 < len(SCHEMES):
            only = few(members.join(mixed.hint("merge"), "key", "left_semi").select("set_id").distinct())
            continue
        chunks = crowd.join(mixed.hint("merge"), "key", "left_semi")
        both = chunks.select("key", "chunk", F.col("members").alias("more")).withColumnRenamed("chunk", "later")
        units = chunks.join(both.hint("merge"), "key").where("chunk < later").select(F.array_union("members", "more").alias("members"))
        settle(scratch.stored(units.withColumn("unit", F.monotonically_increasing_id()), "units"))
    return comps


def jaccard_components(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", digest=digest_of) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that is reached by links, its own included) for each row.

    Two documents are linked if 100 * common shingles >= percent * shingles of either. A text without words, or null, has
    an empty set and no links. Texts of equal sets are linked, and go on as one set. Repeated rows and rows of one doc_id
    join each other's components only by their sets; a null doc_id counts as the largest, and its component is null if no
    other id is in it. An empty table gives no rows; other columns, whatever their names, are ignored. Texts of any length
    are taken whole; one text's words and shingles must fit into a worker (some 60 bytes for each of its bytes). Shingles go
    by 64-bit hashes, sets by 128-bit digests: their 64-bit names are changed where two sets would share one.
    """
    scratch = Scratch(docs.sparkSession)
    named = plain(docs, id_col, text_col)
    renamed: frozenset[int] = frozenset()
    while True:
        rows = scratch.stored(shingled(named, shingle, percent, renamed, digest), "rows")
        full = rows.where("set_id is not null")
        one = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))).alias("one")
        sets = full.groupBy("set_id").agg(one, F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("digest").alias("d1"), F.max("digest").alias("d2"))
        sets = scratch.stored(sets.select("set_id", "one.doc_id", "one.text_key", "n", "sketch", (F.col("d1") != F.col("d2")).alias("clash")), "sets")
        # of n sets about n * n / 2**65 share a name: none, or very few
        clash = [r.set_id for r in sets.where("clash").select("set_id").limit(1_000_000).collect()]
        if not clash:
            break
        renamed |= frozenset(clash)
    comps = linked_sets(named, sets, percent, shingle, scratch, renamed, digest)
    least = sets.select("set_id", F.col("doc_id").alias("least"))
    if comps is not None:
        whole = least.join(comps.hint("merge"), "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id"))
        tops = whole.groupBy("comp").agg(F.min("least").alias("component_id"))
        by_set = scratch.stored(whole.join(tops.hint("merge"), "comp").select("set_id", "component_id"), "by-set")
    else:
        by_set = scratch.stored(least.withColumnRenamed("least", "component_id"), "by-set")
    scratch.drop(rows, by_set)
    found = rows.join(by_set.hint("merge"), "set_id", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is their component's; of rows that share that id, all. Rows without words or doc_id stay.
    All columns are kept."""
    found = jaccard_components(docs, percent, shingle, id_col, text_col)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    return docs.alias("d").join(gone.alias("g").hint("merge"), docs[id_col] == F.col("g.id"), "left_anti")
