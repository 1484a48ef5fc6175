"""N-gram Jaccard join by PartEnum signatures, and the components that its links form.

A document's set holds the 64-bit hashes of its distinct five-word shingles.  Rows of equal sets are one class
(known by a 64-bit hash of the set); classes meet, not rows, so copies cost no pairs.

The feature domain is partitioned by hash, and similar sets of sizes n and m differ in d = (n + m) / 7 features at most.

First, whole parts are counted.  In bands of sizes (powers of two) a set has one signature for each part that it
touches, the hash of its features there.  A similar set has all but d of them, so a class goes on only if p - d of
its p signatures occur in other classes.  Sets that touch too few parts for that are counted by single features.
Of what goes on, most of the features must occur in another class that goes on.

Then subsets of parts are enumerated.  In finer bands (each 4/3 of the last) the domain has n1 first-level parts of
SECOND second-level parts each, and a set signs every choice of all but one of the latter.  Where at most one
second-level part differs, one choice at least is equal; n1 exceeds half of d, so there are first-level parts where
that is so.  How many signatures two similar sets must share follows from d and n1; all but that many, less one, are
looked up: those that hold several features first, and of them the rarest, which leaves out what empty parts and
frequent passages make.

Candidates are found by group of equal signatures: each class is compared with one leader only, that with which it
shares most signatures, then, in some rounds, one class of each component in a group with one of the group's
largest; what still shares a signature across components after that is compared in full.  Of all these pairs only
those go on whose parity bits differ in no more places than similar sets may differ in features.  Pairs within a component
need no comparison; ``similar_classes`` returns all links instead.  All links are verified on whole sets.

Defined results: null, empty or wordless texts have an empty set and link with nothing; texts of fewer
than five words are one shingle; rows of one id are one node, linked as any of them is; rows without id
are returned with their own counts and no component; other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, release, staged, table
from .graph import components
from .url_filter import BlockedBloom

WORDS = 5
#: Similarity as a fraction: 75 / 100.
NUMERATOR, DENOMINATOR = 75, 100
#: Ids for which a filter is broadcast ahead of a join (2 bytes each).
FILTERED_IDS = 5_000_000
#: Rounds with pivots before what is left is compared in full.
PIVOT_ROUNDS = 2
#: Parts of a band, as a share of its largest set; small bands get more.
PART_SHARE, SMALL_BAND, SMALL_SHARE = 0.5, 6, 4
#: Second-level parts, and first-level parts as a share of the most features that two sets of a band differ in.
SECOND, FIRST_SHARE = 4, 0.65
#: Choices that are still equal if no, one, two... second-level parts differ.
EQUAL_CHOICES = np.array([SECOND, 1, 0, 0])
#: Choices of fewer features than this come last, the emptier the later; a power of two less one, told in the lowest bits.
LIGHT = 3
#: Parity bits of a set: so many for each of its features, a power of two within these bounds.
BITS_EACH, LEAST_BITS, MOST_BITS = 8, 64, 1 << 15
#: Bits of a set that are more than its features only repeat from here on.
ENOUGH_BITS = 1024
#: Pairs whose parity bits are compared at a time.
TOLD = 1 << 16
#: Features whose signatures one task takes.
TASK_FEATURES = 1 << 20
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles."""
    words = text.encode().lower().split() if text else []  # bytes: only A-Z and ASCII white space count
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    m = min(n, len(h))
    s = np.zeros(len(h) - m + 1, dtype=np.uint64)
    for j in range(m):
        s += mix(h[j : len(h) - m + 1 + j] + np.uint64(j)) * ODD[j % 5]
    return np.unique(mix(s + np.uint64(m)))


def most_differ(n, m):
    """Most features that only one of two similar sets of n and m has."""
    return (n + m) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def largest_partner(n):
    return n * DENOMINATOR // NUMERATOR


def _bounds(most: int = 1 << 31) -> np.ndarray:
    """Largest sizes of the finer bands: the partners of a set lie in its band, the next one or below."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, largest_partner(out[-1])))
    return np.array(out)


BOUNDS = _bounds()


def parts_of(band: int) -> int:
    return int((1 << band) * (SMALL_SHARE if band <= SMALL_BAND else PART_SHARE))


def sign(features: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """[(band, signatures)]; bands below 0 hold the single features of sets that touch too few parts."""
    n = len(features)
    if not n:
        return []
    band = (n - 1).bit_length()
    out = []
    for b in (band, band + 1) if largest_partner(n) > 1 << band else (band,):
        part = mix(features ^ ODD[0]) % np.uint64(parts_of(b))
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sums = np.add.reduceat(mix(features[order] + ODD[1]), first)  # no order within a part
        out.append((b, mix(sums ^ mix(part[first] * ODD[2] + np.uint64(b)))))
        if len(first) <= most_differ(n, largest_partner(n)):
            least = features[: n - -(-n * NUMERATOR // DENOMINATOR) + 1]
            out.append((-1 - b, mix(least ^ ODD[3] + np.uint64(b))))
    return out


def first_parts(band):
    return np.maximum(1, np.ceil(FIRST_SHARE * most_differ(BOUNDS[band], BOUNDS[band]))).astype(np.int64)


def shared_at_least(n, band):
    """Signatures of a finer band that a set of n shares with any similar one."""
    parts, differ = first_parts(band), most_differ(n, np.minimum(largest_partner(n), BOUNDS[band]))
    each, more = differ // parts, differ % parts  # fewest are left if differences are spread evenly
    return more * EQUAL_CHOICES[np.minimum(each + 1, 3)] + (parts - more) * EQUAL_CHOICES[np.minimum(each, 3)]


def choices(features: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """[(finer band, signatures)]: in each first-level part all choices that leave out one second-level part."""
    n = len(features)
    if not n:
        return []
    own = int(np.searchsorted(BOUNDS, n))
    out = []
    for b in (own, own + 1) if largest_partner(n) > BOUNDS[own] else (own,):
        parts = int(first_parts(b))
        cell = (mix(features ^ ODD[1]) % np.uint64(parts)) * np.uint64(SECOND) + mix(features ^ ODD[2]) % np.uint64(SECOND)
        order = np.argsort(cell, kind="stable")
        first = _starts(cell[order])
        grid = np.zeros(parts * SECOND, dtype=np.uint64)
        grid[cell[order][first].astype(np.int64)] = np.add.reduceat(mix(features[order] + ODD[1]), first)
        grid = grid.reshape(parts, SECOND)
        rest = (grid.sum(axis=1, dtype=np.uint64)[:, None] - grid).ravel()
        held = np.zeros(parts * SECOND, dtype=np.int64)
        held[cell[order][first].astype(np.int64)] = np.diff(np.r_[first, n])
        held = held.reshape(parts, SECOND)
        light = np.maximum(0, LIGHT - (held.sum(axis=1)[:, None] - held)).ravel().astype(np.uint64)  # equal choices hold equally many
        sigs = mix(rest ^ mix(np.arange(parts * SECOND, dtype=np.uint64) * ODD[3] + np.uint64(b)))
        out.append((b, (sigs & ~np.uint64(LIGHT)) | light))
    return out


def _packed(values: np.ndarray, counts: np.ndarray, width: int = 8) -> pa.Array:
    """One binary a row: ``counts[i]`` consecutive values each, of their lowest ``width`` bytes."""
    offsets = np.concatenate([[0], np.cumsum(counts * width)]).astype(np.int32)
    raw = np.ascontiguousarray(np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _unpacked(col: pa.Array, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and how many each row has."""
    if not len(col):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    out = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.reshape(-1).view("<u8").astype(np.uint64), np.diff(offsets) // width


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


SIGNED = "bucket int, key long, doc long, h long, band int, n int, p int, sigs binary"
#: Bytes of a value that travel; with its bucket they tell values apart well enough to find candidates.
SENT = 5
#: Text that the signatures of one task may come from; there are LEAST_BUCKETS tasks at least.
TASK_BYTES, LEAST_BUCKETS = 48 << 20, 32


class _Units:
    """Rows for each bucket of a set's signatures, with what holds for the set; sigs packed."""

    def __init__(self, buckets: int, *names: str):
        self.buckets, self.names = buckets, names
        self.values, self.counts = [], []
        self.cols: dict[str, list] = {k: [] for k in ("bucket", *names)}

    def add(self, sigs: np.ndarray, *of_set: int) -> None:
        at = _bucket(sigs, self.buckets)
        order = np.argsort(at, kind="stable")
        found, sizes = np.unique(at, return_counts=True)
        self.values.append(sigs[order])
        self.counts.append(sizes)
        for k, v in zip(self.cols, (found, *of_set), strict=True):
            self.cols[k].append(np.broadcast_to(np.asarray(v), found.shape))

    def batch(self, schema: str) -> pa.RecordBatch | None:
        if not self.values:
            return None
        sigs = _packed(np.concatenate(self.values), np.concatenate(self.counts), SENT)
        arrays, names = [], []
        for field in schema.split(", "):
            name, kind = field.split(" ")
            if name in self.cols:
                arrays.append(pa.array(np.concatenate(self.cols[name]).astype(np.int32 if kind == "int" else np.int64)))
            else:
                arrays.append(sigs if kind == "binary" else pa.nulls(len(sigs), pa.int32() if kind == "int" else pa.int64()))
            names.append(name)
        return pa.RecordBatch.from_arrays(arrays, names=names)


def _signed(buckets: int):
    """Each row's set in one row of bucket -1 (key: the hash of the set), and its signatures of whole parts, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                units, keys, sizes = _Units(buckets, "key", "band", "n", "p"), [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                    features = shingles(text)
                    key = int.from_bytes(xxhash.xxh3_64_digest(features.tobytes()), "little", signed=True)
                    keys.append(key)
                    sizes.append(len(features))
                    if doc is not None and key not in seen:
                        seen.add(key)
                        for band, sigs in sign(features):
                            units.add(sigs, key, band, len(features), len(sigs))
                rows, none = part.num_rows, pa.nulls(part.num_rows, pa.int32())
                heads = [pa.array(np.full(rows, -1, np.int32)), pa.array(keys, pa.int64()), part.column(0), part.column(1), none, pa.array(sizes, pa.int32()), none, pa.nulls(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(heads, names=[f.split(" ")[0] for f in SIGNED.split(", ")])
                made = units.batch(SIGNED)
                if made is not None:
                    yield made

    return run


CHOSEN = "bucket int, doc long, band int, n int, p long, sigs binary"
#: Bits for the number of signatures of each lightness in ``p``.
COUNT_BITS = 15


def light_counts(sigs: np.ndarray) -> int:
    """How many signatures are of each lightness, packed; numbers too large for their bits are cut, which looks up more."""
    found = np.bincount((sigs & np.uint64(LIGHT)).astype(np.int64), minlength=LIGHT + 1)
    return int(sum(min(int(c), (1 << COUNT_BITS) - 1) << (COUNT_BITS * i) for i, c in enumerate(found)))


def _chosen(buckets: int):
    """Signatures of the finer bands of each set (id, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                units = _Units(buckets, "doc", "band", "n", "p")
                col = part.column(1)
                ends, values = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False).view(np.uint64)
                for i, key in enumerate(part.column(0).to_pylist()):
                    for band, sigs in choices(values[ends[i] : ends[i + 1]]):
                        units.add(sigs, key, band, ends[i + 1] - ends[i], light_counts(sigs))
                made = units.batch(CHOSEN)
                if made is not None:
                    yield made

    return run


def _gather(batches: Iterator[pa.RecordBatch], *names: str, width: int = 8) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray] | None:
    """Of a task: columns by row, all packed values, and the row of each.  Short values get their bucket on top."""
    cols: dict[str, list] = {k: [] for k in names}
    values, counts = [], []
    for b in batches:
        for k in names:
            cols[k].append(b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False))
        v, c = _unpacked(b.column(b.schema.get_field_index("sigs")), width)
        if width < 8:
            v |= np.repeat(b.column(b.schema.get_field_index("bucket")).to_numpy().astype(np.uint64), c) << np.uint64(8 * width)
        values.append(v)
        counts.append(c)
    if not values:
        return None
    rows = {k: np.concatenate(v) for k, v in cols.items()}
    counts = np.concatenate(counts)
    return rows, np.concatenate(values), np.repeat(np.arange(len(counts)), counts)


def _starts(a: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, dtype=np.int64)


def _by_bucket(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """Columns of a task by row, and values and their rows of one bucket after another: those of two never meet."""
    got = _gather(batches, *names, width=SENT)
    if got is not None:
        rows, sigs, row = got
        row = row.astype(np.int32)
        bucket = (sigs >> np.uint64(8 * SENT)).astype(np.int32)
        for b in np.unique(bucket):
            own = bucket == b
            yield rows, sigs[own], row[own]


def _partly_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, band, how many of its signatures here another class has, and how many must in all."""
    for rows, sigs, row in _by_bucket(batches, "key", "band", "n", "p"):
        here = np.unique(row)
        order = here[np.lexsort((rows["band"][here], rows["key"][here]))]
        key, band = rows["key"][order], rows["band"][order]
        again = np.r_[False, (key[1:] == key[:-1]) & (band[1:] == band[:-1])]  # the same class from another task
        extra = np.zeros(len(rows["key"]), dtype=bool)
        extra[order[again]] = True
        sigs, row = sigs[~extra[row]], row[~extra[row]]
        order = np.argsort(sigs, kind="stable")
        sizes = np.diff(np.r_[_starts(sigs[order]), len(sigs)])
        count = np.bincount(row[order][np.repeat(sizes > 1, sizes)], minlength=len(rows["key"]))
        found = np.flatnonzero(count)
        n, band = rows["n"][found].astype(np.int64), rows["band"][found]
        differ = most_differ(n, np.minimum(largest_partner(n), 1 << np.maximum(band, 0).astype(np.int64)))
        needed = np.where(band < 0, 1, np.maximum(1, rows["p"][found] - differ))
        yield pa.RecordBatch.from_arrays([pa.array(rows["key"][found]), pa.array(band), pa.array(count[found]), pa.array(needed)], names=["key", "band", "c", "needed"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures that several classes have, each followed by its count; rows as they came."""
    for found in _by_bucket(batches, "doc", "band", "n", "p"):
        yield from _shared_of(*found)


def _shared_of(rows: dict[str, np.ndarray], sigs: np.ndarray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(sigs, kind="stable")
    sigs, row = sigs[order], row[order]
    sizes = np.diff(np.r_[_starts(sigs), len(sigs)])
    keep = np.repeat(sizes > 1, sizes)
    sigs, row, sizes = sigs[keep], row[keep], np.repeat(sizes, sizes)[keep]
    order = np.argsort(row, kind="stable")
    sigs, row, sizes = sigs[order], row[order], sizes[order]
    first = _starts(row)
    if not len(first):
        return
    of = row[first]
    both = np.column_stack([sigs, sizes.astype(np.uint64)]).ravel()
    ends = np.r_[first, len(row)]
    for lo in range(0, len(first), 20_000):
        hi = min(lo + 20_000, len(first))
        arrays = [pa.array(rows[k][of[lo:hi]]) for k in ("doc", "band", "n", "p")]
        yield pa.RecordBatch.from_arrays([*arrays, _packed(both[2 * ends[lo] : 2 * ends[hi]], 2 * np.diff(ends[lo : hi + 1]))], names=["doc", "band", "n", "p", "sigs"])


def _rarest():
    """The first signatures of each class and band, as many as must hold one of any partner's, as far as they are shared:
    in order of lightness, and of how many classes have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gather(batches, "doc", "band", "n", "p")
        if got is None:
            return
        rows, both, row = got
        sigs, sizes, row = both[0::2], both[1::2].astype(np.int64), row[0::2]
        doc, band, light = rows["doc"][row], rows["band"][row], (sigs & np.uint64(LIGHT)).astype(np.int64)
        order = np.lexsort((sigs, sizes, light, band, doc))
        sigs, row, doc, band, light = sigs[order], row[order], doc[order], band[order], light[order]
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (band[1:] != band[:-1]) | (light[1:] != light[:-1])])
        if not len(first):
            return
        counts = np.diff(np.r_[first, len(doc)])
        n, packed = rows["n"][row[first]].astype(np.int64), rows["p"][row[first]].astype(np.int64)
        mask = (1 << COUNT_BITS) - 1
        all_of = np.stack([(packed >> (COUNT_BITS * i)) & mask for i in range(LIGHT + 1)])
        before = np.cumsum(np.vstack([np.zeros(len(first), np.int64), all_of]), axis=0)[light[first], np.arange(len(first))]
        alone = np.maximum(0, all_of[light[first], np.arange(len(first))] - counts)  # of no other class: ahead of shared ones
        whole = first_parts(band[first]) * SECOND
        wanted = np.clip(whole - shared_at_least(n, band[first]) + 1 - before - alone, 0, counts)
        nth = np.arange(len(doc)) - np.repeat(first, counts)
        keep = nth < np.repeat(wanted, counts)
        sigs, doc, size = sigs[keep], doc[keep], rows["n"][row[keep]]
        at = (sigs >> np.uint64(8 * SENT)).astype(np.int32)
        order = np.lexsort((at, doc))
        sigs, doc, at, size = sigs[order], doc[order], at[order], size[order]
        if not len(doc):
            return
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])])
        ends = np.r_[first, len(doc)]
        for lo in range(0, len(first), 20_000):
            hi = min(lo + 20_000, len(first))
            of = first[lo:hi]
            yield pa.RecordBatch.from_arrays([pa.array(at[of]), pa.array(doc[of]), pa.array(size[of].astype(np.int32)), _packed(sigs[ends[lo] : ends[hi]], np.diff(ends[lo : hi + 1]))], names=["bucket", "doc", "n", "sigs"])

    return run


def _dealt(buckets: int):
    """Features of each set (id, set), one row for each bucket of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            offsets = col.offsets.to_numpy()
            values = col.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64)
            sizes = np.diff(offsets)
            row, at = np.repeat(np.arange(len(sizes)), sizes), _bucket(values, buckets)
            order = np.lexsort((at, row))
            values, row, at = values[order], row[order], at[order]
            if not len(row):
                continue
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1])])
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int32)), pa.array(ids[row[first]]), pa.array(sizes[row[first]].astype(np.int32)), _packed(values, np.diff(np.r_[first, len(row)]), SENT)], names=["bucket", "doc", "n", "sigs"])

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, n, and how many of its features here another document has."""
    got = _gather(batches, "doc", "n", width=SENT)
    if got is None:
        return
    rows, values, row = got
    doc, n = rows["doc"][row], rows["n"][row]
    order = np.lexsort((n, doc, values))
    values, doc, n = values[order], doc[order], n[order]
    first = _starts(values)
    counts = np.diff(np.r_[first, len(values)])
    shared = np.repeat(np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first), counts)
    doc, n = doc[shared], n[shared]
    order = np.lexsort((n, doc))
    doc, n = doc[order], n[order]
    if not len(doc):
        return
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (n[1:] != n[:-1])])
    yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(n[first]), pa.array(np.diff(np.r_[first, len(doc)]).astype(np.int64))], names=["doc", "n", "c"])


def _near_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return DENOMINATOR * np.minimum(a, b) >= NUMERATOR * np.maximum(a, b)


def parity(features: np.ndarray) -> bytes:
    """Bits turned by the features that fall on them.  Two sets differ in at least as many features as in bits."""
    n = max(1, len(features))
    width = 1 << (max(n, min(BITS_EACH * n, ENOUGH_BITS)) - 1).bit_length()
    width = min(max(width, LEAST_BITS), MOST_BITS)
    turned = np.bincount((features & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(turned.astype(np.uint8), bitorder="little").tobytes()


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, bits of each set (id, set)."""
    for batch in batches:
        col = batch.column(1)
        ends, values = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False).view(np.uint64)
        bits = [parity(values[ends[i] : ends[i + 1]]) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["doc", "bits"])


class _Parity:
    """Parity bits of the rows of a task; the wider of two is folded to the other's width."""

    def __init__(self, columns: list[pa.Array]):
        found = [_unpacked(c) for c in columns]
        self.values = np.concatenate([v for v, _ in found])
        self.width = np.concatenate([w for _, w in found]).astype(np.int64)
        self.start = np.cumsum(self.width) - self.width

    def _of(self, rows: np.ndarray, width: int, to: int) -> np.ndarray:
        held = self.values[self.start[rows][:, None] + np.arange(width)]
        return held if width == to else np.bitwise_xor.reduce(held.reshape(len(rows), width // to, to), axis=1)

    def may_match(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Which pairs of rows x and y, sets of n and m features, do not differ in too many bits."""
        out = np.zeros(len(x), dtype=bool)
        most, wx, wy = most_differ(n, m), self.width[x], self.width[y]
        for code in np.unique(wx << 32 | wy):
            a, b = int(code) >> 32, int(code) & 0xFFFFFFFF
            own = np.flatnonzero((wx == a) & (wy == b))
            to = min(a, b)
            step = max(1, TOLD * 16 // max(a, b))
            for lo in range(0, len(own), step):
                at = own[lo : lo + step]
                other = np.bitwise_count(self._of(x[at], a, to) ^ self._of(y[at], b, to)).sum(axis=1, dtype=np.int64)
                out[at] = other <= most[at]
        return out


def _pairs(step: int | None):
    """Pairs to compare, as far as their parity bits allow.  step 0: each document with the leader (smallest id) of its
    groups, with votes; step k: in each group, one document of each component with one of the largest; None: all pairs
    across components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        got = _gather(iter(held), "doc", "n", "comp")
        if got is None:
            return
        rows, sigs, row = got
        bits = _Parity([b.column(b.schema.get_field_index("bits")) for b in held])
        del held
        doc, n, comp = rows["doc"][row], rows["n"][row].astype(np.int64), rows["comp"][row]
        if step:  # of each component in a group one document, the same in all groups where it is
            chosen = mix(doc.view(np.uint64) + ODD[4:] * np.uint64(step))
            order = np.lexsort((chosen, comp, sigs))
            sigs, doc, n, comp, row = sigs[order], doc[order], n[order], comp[order], row[order]
            one = np.r_[True, (sigs[1:] != sigs[:-1]) | (comp[1:] != comp[:-1])]
            size = np.diff(np.r_[np.flatnonzero(one), len(sigs)])
            sigs, doc, n, comp, row = sigs[one], doc[one], n[one], comp[one], row[one]
            order = np.lexsort((comp, -size, sigs))  # the largest component leads
        else:
            order = np.lexsort((doc, sigs) if step == 0 else (n, sigs))
        sigs, doc, n, comp, row = sigs[order], doc[order], n[order], comp[order], row[order]
        first = _starts(sigs)
        counts = np.diff(np.r_[first, len(sigs)])

        def likely(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            near = (doc[x] != doc[y]) & (comp[x] != comp[y]) & _near_sizes(n[x], n[y])
            x, y = x[near], y[near]
            near = bits.may_match(row[x], row[y], n[x], n[y])
            return doc[x[near]], doc[y[near]]

        if step is not None:
            yield from _counted(*likely(np.repeat(first, counts), np.arange(len(sigs))))
            return
        low, high = np.minimum.reduceat(comp, first), np.maximum.reduceat(comp, first)
        last = np.repeat(np.where(low != high, first + counts, 0), counts)  # a group of one component has no pairs
        done: list[np.ndarray] = []
        waiting, apart = 0, 1
        at = np.arange(len(sigs))
        while True:  # the next in a group, then the one after it...; sizes rise, so some are done early
            at = at[at + apart < last[at]]
            at = at[_near_sizes(n[at], n[at + apart])]
            if not len(at):
                break
            x, y = likely(at, at + apart)
            if len(x):
                done.append(np.column_stack([np.minimum(x, y), np.maximum(x, y)]))
                waiting += len(x)
            if waiting > 1_000_000:
                done = [np.unique(np.concatenate(done), axis=0)]
                waiting = len(done[0]) // 2
            apart += 1
        if done:
            pairs = np.unique(np.concatenate(done), axis=0)
            yield from _counted(pairs[:, 0], pairs[:, 1])

    return run


def _counted(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(a):
        return
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(np.diff(np.r_[first, len(a)]).astype(np.int64))], names=["a", "b", "votes"])


def sifted(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among ``ids`` (id): a filter of checked size ahead of a join."""
    spark = df.sparkSession
    n = ids.count()
    if 0 < n <= FILTERED_IDS:
        hashes = ids.select(F.xxhash64("id").alias("h"))
        blocks = max(1, -(-n * 16 // 256))
        found = np.zeros((blocks, 8), dtype=np.uint32)

        def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((blocks, 8), dtype=np.uint32)
            for b in batches:
                where, m = BlockedBloom._place(b.column(0).to_numpy(), blocks)
                for lane in range(8):
                    np.bitwise_or.at(out[:, lane], where, m[:, lane])
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["blocks"])

        few = hashes.coalesce(max(1, min(hashes.rdd.getNumPartitions(), 1 + n // 500_000)))
        for r in few.mapInArrow(masks, "blocks binary").toLocalIterator():
            found |= np.frombuffer(r["blocks"], dtype=np.uint32).reshape(blocks, 8)
        sent = spark.sparkContext.broadcast(found)

        @F.pandas_udf("boolean")
        def possible(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            bloom = BlockedBloom(sent.value)
            for h in batches:
                yield pd.Series(bloom.might_hold(h.to_numpy(dtype=np.int64)))

        df = df.where(possible(F.xxhash64(column)))
    return df


def only(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` is among ``ids`` (id)."""
    return sifted(df, column, ids).join(ids.withColumnRenamed("id", column), column, "left_semi")


def _features_column():
    @F.pandas_udf("array<long>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t).view(np.int64) for t in texts])

    return features


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    some = only(sets, "id", staged(needed, "join-needed"))
    left, right = some.select(F.col("id").alias("b"), F.col("set").alias("sb")), some.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "b").join(right, "a").where(both * DENOMINATOR >= (F.size("sa") + F.size("sb") - both) * NUMERATOR).select("a", "b").distinct()


def _live(units: DataFrame, buckets: int) -> DataFrame:
    """key of the classes that share enough signatures of whole parts with others to have a partner."""
    counted = units.repartition(2 * buckets, "bucket").mapInArrow(_partly_shared, "key long, band int, c long, needed long")
    enough = counted.groupBy("key", "band", "needed").agg(F.sum("c").alias("c")).where("c >= needed")
    return staged(enough.select("key").distinct(), "join-live")


def _prefixes(sets: DataFrame, buckets: int) -> DataFrame:
    """bucket, doc, n, sigs, bits: signatures of the classes to look up, and their parity bits."""
    # twice as many tasks as buckets, so that few tasks get several
    shared = sets.mapInArrow(_chosen(buckets), CHOSEN).repartition(2 * buckets, "bucket").mapInArrow(_shared, "doc long, band int, n int, p long, sigs binary")
    rarest = shared.repartition(buckets, "doc").mapInArrow(_rarest(), "bucket int, doc long, n int, sigs binary")
    return staged(rarest.join(sets.mapInArrow(_parities, "doc long, bits binary"), "doc").select("bucket", "doc", "n", "sigs", "bits"), "join-prefix")


def _likely(sets: DataFrame, buckets: int) -> DataFrame:
    """id of the sets most of whose features occur in other sets: a similar pair shares t of either's."""
    counted = sets.mapInArrow(_dealt(buckets), "bucket int, doc long, n int, sigs binary").repartition(2 * buckets, "bucket").mapInArrow(_common, "doc long, n int, c long")
    enough = counted.groupBy("doc", "n").agg(F.sum("c").alias("c")).where(F.col("c") * DENOMINATOR >= F.col("n") * NUMERATOR)
    return staged(enough.select(F.col("doc").alias("id")).distinct(), "join-likely")


def _round(step: int | None, prefix: DataFrame, labels: DataFrame | None, tested: DataFrame | None, buckets: int) -> DataFrame:
    """Pairs (a, b) to compare in this round."""
    if labels is None:
        now = prefix.withColumn("comp", F.col("doc"))
    else:
        now = prefix.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("bucket", "doc", "n", "sigs", "bits", F.coalesce("label", "doc").alias("comp"))
    pairs = now.repartition(2 * buckets, "bucket").mapInArrow(_pairs(step), "a long, b long, votes long").groupBy("a", "b").agg(F.sum("votes").alias("votes"))
    if step == 0:  # one leader for each document, the one it shares most with
        best = F.max(F.struct("votes", (-F.col("a")).alias("a"))).alias("x")
        pairs = pairs.groupBy("b").agg(best).select((-F.col("x.a")).alias("a"), "b")
    else:
        pairs = pairs.select("a", "b")
    return staged(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "join-pairs")


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after the components that ``links`` connect have become one."""
    if labels is None:
        return components(links)
    named = links.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
    found = components(named.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b"))
    moved = labels.join(found.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return staged(moved.union(found.join(labels.select("node"), "node", "left_anti")), "join-labels")


def _likely_sets(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc, h, key, n) of all rows with a text, h its hash; (key, doc, h) of the classes; (id, set) of those that may have partners."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text")).where("text is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // TASK_BYTES))
    signed = staged(texts.mapInArrow(_signed(buckets), SIGNED), "join-signed")
    live = _live(signed.where("bucket >= 0").select("bucket", "key", "band", "n", "p", "sigs"), buckets)
    members = staged(signed.where("bucket < 0").select("doc", "h", "key", "n"), "join-members")
    release(spark, signed)
    first = F.min(F.struct("doc", "h")).alias("m")
    classes = staged(members.where("n > 0 and doc is not null").groupBy("key").agg(first).select("key", "m.doc", "m.h"), "join-classes")
    chosen = staged(classes.join(live, "key", "left_semi"), "join-chosen")
    met = sifted(texts, "doc", chosen.select(F.col("doc").alias("id"))).join(chosen, ["doc", "h"])
    met = staged(met.select(F.col("key").alias("id"), _features_column()("text").alias("set")), "join-sets")
    likely = _likely(met, buckets)
    sets = staged(only(met, "id", likely), "join-sets")
    release(spark, live, chosen, met, likely)
    return members, classes, sets


def _buckets_for(sets: DataFrame) -> int:
    return max(LEAST_BUCKETS, (sets.agg(F.sum(F.size("set"))).first()[0] or 0) // TASK_FEATURES)


def _resolved(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, h, n, component of all rows with a text."""
    spark = docs.sparkSession
    members, classes, sets = _likely_sets(docs, key, text)
    buckets = _buckets_for(sets)
    prefix = _prefixes(sets, buckets)
    labels = tested = None
    for step in [*range(PIVOT_ROUNDS + 1), None]:
        pairs = _round(step, prefix, labels, tested, buckets)
        links = staged(verified(pairs, sets), "join-links") if pairs.limit(1).count() else None
        if links is not None and links.limit(1).count():
            labels = _joined(labels, links)
        tested = staged(tested.union(pairs), "join-tested") if tested is not None else pairs
    release(spark, sets, prefix, tested)
    # rows of one id are one node: their classes are linked
    own = members.where("n > 0 and doc is not null").select("doc", "key").distinct()
    several = own.groupBy("doc").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z")
    if several.limit(1).count():
        labels = _joined(labels, own.join(several, "doc").select("a", F.col("key").alias("b")).where("a <> b").distinct())
    if labels is None:
        named = classes.select("key", F.col("doc").alias("component"))
    else:
        found = classes.join(labels.withColumnRenamed("node", "key"), "key", "left")
        least = found.where("label is not null").groupBy("label").agg(F.min("doc").alias("least"))
        named = found.join(least, "label", "left").select("key", F.coalesce("least", "doc").alias("component"))
    out = staged(members.join(named, "key", "left").select("doc", "h", "n", F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.col("component")).otherwise(F.col("doc")).alias("component")).distinct(), "join-resolved")
    release(spark, members, classes)
    return out


def link_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, label) of the documents with words; label: the smallest id of its component."""
    return _resolved(docs, key, text).where("n > 0 and doc is not null").select(F.col("doc").alias("node"), F.col("component").alias("label")).distinct()


def similar_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: (a, b) between classes of equal sets, and (doc, key), the class of each document.
    Large groups of sets that are all similar have a link for each two."""
    members, classes, sets = _likely_sets(docs, key, text)
    buckets = _buckets_for(sets)
    links = staged(verified(_round(None, _prefixes(sets, buckets), None, None, buckets), sets), "join-links")
    release(docs.sparkSession, classes, sets)
    return links, members.where("n > 0 and doc is not null").select("doc", "key").distinct()


def join_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_shingles and component_id (they replace columns of those names)."""
    k, h, d, g, n, c = (free_name(docs, x) for x in ("key", "hash", "doc", "h", "n", "component"))
    found = _resolved(docs, key, text).select(F.col("doc").alias(d), F.col("h").alias(g), F.col("n").alias(n), F.col("component").alias(c))
    named = docs.withColumns({k: F.col(key).cast("long"), h: F.xxhash64(F.col(text))})
    out = named.join(found, F.col(k).eqNullSafe(F.col(d)) & (F.col(h) == F.col(g)) & F.col(text).isNotNull(), "left")
    return out.withColumns({"n_shingles": F.coalesce(F.col(n), F.lit(0)).cast("long"), "component_id": F.coalesce(c, k)}).drop(k, h, d, g, n, c)


def op3_shingle_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return join_documents(docs).select("doc_id", "n_shingles", "component_id")


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, d.b FROM r JOIN d ON r.b = d.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(b) AS component_id FROM r GROUP BY doc_id) USING (doc_id)
"""

QUERIES = {"op3_shingle_join": op3_shingle_join}
SQL = {"op3_shingle_join": OP3_SQL}
