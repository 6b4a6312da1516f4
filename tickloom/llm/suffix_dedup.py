"""Removal of long repeated passages with a logarithmic family of sorted suffix arrays.

A byte goes if it lies in a LENGTH-byte string that also starts earlier (in a document of smaller id, or before in the
same document).  Strings are judged on the input; matches never cross documents.

A suffix array of every byte would be many times the corpus, so suffixes are sampled by content and only those that can
still match are indexed:

1. Segments.  Each LENGTH-byte string has as its anchor the smallest hash of its GRAM-byte substrings; neighbours that
   share it form a segment (35 strings on average).  Equal strings have equal anchors.  Blocks of documents send (anchor,
   segment hash) of their segments, the earliest of equal ones only, to the shard of the anchor; the others are copies.  A segment whose anchor occurs once is unique; one equal to an
   earlier segment of its anchor is a copy; the first of its kind among different ones of an anchor is open.
2. Suffixes.  Only open segments send the suffixes that start in them, as 96-bit fingerprints (two independent
   hashes) of their first LENGTH bytes, to shards.  There every batch (the rows of a block) becomes a sorted suffix array, is scanned by merging
   against the existing levels for matches, and joins them; levels of equal size merge, so a shard keeps a logarithmic
   number of sorted arrays, each with the earliest start of a suffix.
3. Copies and matched suffixes go back to their documents, where overlapping strings unite to the removed runs.

Equality is that of hashes: two of 64 bits in step 1, 96 bits in step 2.  A frequent passage costs its shard one hash a block that
holds it (of BLOCK_DOCS documents or BLOCK_BYTES) and nothing more: occurrences are never paired.

Defined cases: a null or empty text has nothing removed; texts below LENGTH bytes stay; a null id counts as the
smallest; of rows repeated with their id the one read first counts as earlier; an empty table gives an empty result;
periodic texts (one character repeated, say) match themselves and keep their first period only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import cut, shard_keys, table, text_of

#: Bytes of a repeated string.
LENGTH = 100
#: Bytes of the substrings that anchor strings.
GRAM = 32
#: Strings of a segment at most; longer ones (of periodic texts) are cut.
LONGEST = 512
#: Documents and bytes of a block at most (a longer document is a block of its own).
BLOCK_DOCS, BLOCK_BYTES = 1000, 1_500_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
#: Byte values of a second hash, drawn independently; the powers are those of the first.
_CHECK_BYTES = np.random.default_rng(12).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
OPEN = np.uint32(1 << 31)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """Hashes of all substrings of one length by prefix sums modulo 2**64."""

    powers = np.ones((2, 1), np.uint64)

    def __init__(self, data: np.ndarray, values: np.ndarray = _BYTES):
        n = len(data) + 1
        if self.powers.shape[1] < n:
            powers = np.empty((2, max(n, BLOCK_BYTES + 1)), np.uint64)
            powers[0], powers[1], powers[:, 0] = _BASE, _BACK, 1
            Hasher.powers = np.multiply.accumulate(powers, axis=1, out=powers)
        up, self.down = self.powers
        self.sums = np.zeros(n, np.uint64)
        np.multiply(values[data], up[: n - 1], out=self.sums[1:])
        np.cumsum(self.sums, out=self.sums)

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.empty(0, np.uint64)

    def strings(self, starts: np.ndarray) -> np.ndarray:
        """The hashes of the LENGTH bytes from each start, some at a time."""
        out = np.empty(len(starts), np.uint64)
        for a in range(0, len(starts), 1 << 17):
            part = starts[a : a + (1 << 17)]
            out[a : a + len(part)] = self.of(part, part + LENGTH)
        return out

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * _BASE)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Segments:
    """Segments of the documents that lie side by side in data; edges: where each begins, and the end."""

    def __init__(self, data: np.ndarray, edges: np.ndarray):
        self.hasher = Hasher(data)
        empty = np.empty(0, np.int64)
        self.start, self.count, self.doc, self.number = empty, empty, empty, empty
        self.anchor = self.whole = np.empty(0, np.uint64)
        self.periodic = np.empty(0, bool)
        if len(data) < LENGTH:
            return
        grams = self.hasher.every(GRAM)
        least = _window_min(grams, LENGTH - GRAM + 1)  # of the string at each byte
        valid = np.zeros(len(data) + 1, np.int64)
        fits = np.flatnonzero(np.diff(edges) >= LENGTH)
        valid[edges[fits]] += 1
        valid[edges[fits + 1] - LENGTH + 1] -= 1
        valid = np.cumsum(valid[: len(least)]) > 0
        begins = np.ones(len(least), bool)
        begins[1:] = least[1:] != least[:-1]
        begins[1:] |= ~valid[:-1]
        inside = edges[:-1][edges[:-1] < len(least)]
        begins[inside] = True
        begins &= valid
        at = np.flatnonzero(begins)
        if not len(at):
            return
        stops = begins | ~valid
        after = np.flatnonzero(stops)
        ends = np.append(after, len(least))[np.searchsorted(after, at, "right")]
        if (ends - at).max() > LONGEST:
            pieces = -(-(ends - at) // LONGEST)
            first = np.repeat(at, pieces)
            step = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            ends = np.minimum(np.repeat(ends, pieces), first + (step + 1) * LONGEST)
            at = first + step * LONGEST
        self.start, self.count = at, ends - at
        self.doc = np.searchsorted(edges, at, "right") - 1
        self.number = np.arange(len(at)) - np.searchsorted(self.doc, self.doc, "left")
        self.anchor = least[at]
        self.whole = self.hasher.of(at, ends + LENGTH - 1)
        # an anchor that occurs twice in its segment: strings of it may equal each other
        last = ends - 1 + LENGTH - GRAM
        self.periodic = self.count > LENGTH - GRAM + 1
        hits = np.flatnonzero(self._anchor_hits(grams, at, last, least))
        self.periodic[hits] = True

    def _anchor_hits(self, grams, at, last, least) -> np.ndarray:
        """Whether the anchor occurs more than once among the substrings of the segment."""
        short = np.flatnonzero(~self.periodic)
        width = last[short] - at[short] + 1
        out = np.zeros(len(at), bool)
        if len(short):
            row = np.repeat(np.arange(len(short)), width)
            where = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(at[short], width)
            same = grams[where] == np.repeat(least[at[short]], width)
            out[short] = np.bincount(row, same, len(short)) > 1
        return out


def pack(x: np.ndarray, kind: str) -> bytes:
    """Whole numbers that mostly ascend, for a codec: their differences, first bytes first."""
    d = np.diff(x.astype(kind), prepend=np.zeros(1, kind))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, d.itemsize).T).tobytes()


def unpack(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    d = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(d, dtype=kind)


#: Kinds of document numbers in their block and of places in their document.
DOC, PLACE = "<u2", "<u4"

ROWS = "shard long, block long, meta binary, docs binary, places binary, keys binary, wholes binary, own boolean"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]
_KINDS = [pa.int64(), pa.int64(), *[pa.binary()] * 5, pa.bool_()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], _NAMES)


def _orders(ids: np.ndarray) -> bytes:
    """Ids as differences, which compress well."""
    return np.diff(ids, prepend=np.int64(0)).astype("<i8").tobytes()


def _ids(meta: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(meta, "<i8"))


#: Bytes of the key of a row (see numbered).
KEY = 16


def _keys(joined: bytes) -> list[bytes]:
    return [joined[at : at + KEY] for at in range(0, len(joined), KEY)]


NULL_ID = -(1 << 62)


def _collect(batches, columns, base):
    """Blocks of rows: (block number, list of rows), rows as tuples of the first columns and the text's bytes."""
    rows, size, number = [], 0, 0
    for b in batches:
        for values in zip(*(b.column(i).to_pylist() for i in range(columns)), b.column(columns)):
            raw = (values[-1].as_py() or "").encode()
            if rows and (len(rows) >= BLOCK_DOCS or size + len(raw) > BLOCK_BYTES):
                yield base + number, rows
                rows, size, number = [], 0, number + 1
            rows.append((*values[:-1], raw))
            size += len(raw)
    if rows:
        yield base + number, rows


def _laid_out(rows):
    data = np.frombuffer(b"".join(r[-1] for r in rows), np.uint8)
    return data, np.cumsum([0, *(len(r[-1]) for r in rows)])


def _deal(block, meta, part, shards, docs, places, keys, wholes):
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(len(shards) + 1))
    for s in range(len(shards)):
        at = order[edges[s] : edges[s + 1]]
        if len(at):
            yield (
                shards[s], block, meta, pack(docs[at], DOC), pack(places[at], PLACE),
                keys[at].astype("<u8").tobytes(), wholes[at].astype(wholes.dtype.newbyteorder("<")).tobytes(), False,
            )


def _copies_in_block(anchor: np.ndarray, whole: np.ndarray, doc: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which segments equal an earlier one of their block; they come by document and place."""
    first = np.argsort(ids[doc], kind="stable")
    order = first[np.lexsort((whole[first], anchor[first]))]
    out = np.zeros(len(anchor), bool)
    out[order[1:]] = (anchor[order][1:] == anchor[order][:-1]) & (whole[order][1:] == whole[order][:-1])
    return out


def _send_segments(batches: Iterator[pa.RecordBatch], shards: list[int]) -> Iterator[pa.RecordBatch]:
    """Step 1, from (row, doc_id, text): segments to the shard of their anchor, and a row of each block for itself."""
    from pyspark import TaskContext

    for block, rows in _collect(batches, 2, TaskContext.get().partitionId() << 32):
        s = Segments(*_laid_out(rows))
        ids = np.array([NULL_ID if r[1] is None else r[1] for r in rows], np.int64)
        places = s.number.astype(np.uint32) | np.where(s.periodic, OPEN, np.uint32(0))
        copy = _copies_in_block(s.anchor, s.whole, s.doc, ids)
        sent = np.flatnonzero(~copy)
        anchor = s.anchor[sent]
        out = list(_deal(block, _orders(ids), (anchor % np.uint64(len(shards))).astype(np.int64), shards, s.doc[sent], places[sent], mix(anchor), s.whole[sent]))
        own = b"".join(r[0] for r in rows)
        # numbers of segments, then documents and segments of the copies
        n = np.concatenate([np.bincount(s.doc, minlength=len(rows)), s.doc[copy], s.number[copy]]).astype("<u4").tobytes()
        sizes = np.array([len(r[-1]) for r in rows], "<i8").tobytes()
        shas = b"".join(hashlib.sha256(r[-1]).digest() for r in rows)
        out.append((shards[block % len(shards)], block, _orders(ids), own, n, sizes, shas, True))
        yield _rows(out)


def _by_shard(batches):
    """All rows of one shard at a time.  There are as many shards as partitions, so that a shard is a share of them."""
    shard, rows = None, []
    for b in batches:
        for r in zip(*(b.column(i).to_pylist() for i in range(8))):
            if r[0] != shard and rows:
                yield rows
                rows = []
            shard = r[0]
            rows.append(r)
    if rows:
        yield rows


def _match_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1 in a shard: copies and open segments (places with OPEN) back to their blocks."""
    for rows in _by_shard(batches):
        for r in rows:
            if r[7]:
                yield _rows([r])
        rows = [r for r in rows if not r[7]]
        if not rows:
            continue
        key = np.concatenate([np.frombuffer(r[5], "<u8") for r in rows])
        whole = np.concatenate([np.frombuffer(r[6], "<u8") for r in rows])
        docs = [unpack(r[3], DOC) for r in rows]
        doc, place = np.concatenate(docs), np.concatenate([unpack(r[4], PLACE) for r in rows])
        of = np.repeat(np.arange(len(rows)), [len(r[5]) // 8 for r in rows])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        at = np.flatnonzero(twice | (place >= OPEN))
        if not len(at):
            continue
        ids = np.concatenate([_ids(r[2])[d] for r, d in zip(rows, docs)])[at]
        blocks = np.array([r[1] for r in rows])[of[at]]
        k, w, number = key[at], whole[at], place[at] & ~OPEN
        order = np.lexsort((number, doc[at], blocks, ids, w, k))
        at, k, w = at[order], k[order], w[order]
        new_key = np.append(True, k[1:] != k[:-1])
        new_kind = new_key | np.append(True, w[1:] != w[:-1])
        group = np.cumsum(new_key) - 1
        kinds = np.bincount(group, new_kind)[group]
        is_open = new_kind & ((kinds > 1) | (place[at] >= OPEN))
        keep = np.flatnonzero(~new_kind | is_open)
        back = np.where(is_open, OPEN, np.uint32(0)) | (place[at] & ~OPEN)
        blocks = np.array([r[1] for r in rows])[of[at]]
        out = []
        keep = keep[np.lexsort((place[at[keep]] & ~OPEN, doc[at[keep]], blocks[keep]))]
        cuts = np.flatnonzero(np.diff(blocks[keep])) + 1
        for part in np.split(keep, cuts):
            if len(part):
                out.append((0, int(blocks[part[0]]), None, pack(doc[at[part]], DOC), pack(back[part], PLACE), None, None, False))
        yield _rows(out)


MARKED = "row binary, doc_id long, n_bytes long, sha binary, n_segments long, marks binary"


def _gather_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1 in a block: the marks of each document (null without any)."""

    def done(own, docs, marks):
        ids, rows = _ids(own[2]), _keys(own[3])
        n, copies = np.split(np.frombuffer(own[4], "<u4"), [len(ids)])
        sizes, copies = np.frombuffer(own[5], "<i8"), copies.reshape(2, -1)
        doc, mark = (np.concatenate([c, *x]) for c, x in zip(copies, (docs, marks)))
        order = np.argsort(doc, kind="stable")
        edges = np.searchsorted(doc[order], np.arange(len(ids) + 1))
        binary = [mark[order[a:z]].astype("<u4").tobytes() if z > a else None for a, z in zip(edges, edges[1:])]
        doc_ids = [None if i == NULL_ID else int(i) for i in ids]
        return pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.binary()), pa.array(doc_ids, pa.int64()), pa.array(sizes), pa.array([own[6][32 * i : 32 * i + 32] for i in range(len(ids))], pa.binary()),
             pa.array(n.astype(np.int64)), pa.array(binary, pa.binary())],
            ["row", "doc_id", "n_bytes", "sha", "n_segments", "marks"],
        )

    own, docs, marks = None, [], []
    for b in batches:
        for r in zip(*(b.column(i).to_pylist() for i in range(8))):
            if r[7]:  # a block's own row comes first
                if own is not None:
                    yield done(own, docs, marks)
                own, docs, marks = r, [], []
            else:
                docs.append(unpack(r[3], DOC))
                marks.append(unpack(r[4], PLACE))
    if own is not None:
        yield done(own, docs, marks)


def _send_suffixes(batches: Iterator[pa.RecordBatch], shards: list[int]) -> Iterator[pa.RecordBatch]:
    """Step 2, from (row, doc_id, marks, text): suffixes of open segments to shards, copies to the block's own row."""
    from pyspark import TaskContext

    for block, rows in _collect(batches, 3, TaskContext.get().partitionId() << 32):
        data, edges = _laid_out(rows)
        s = Segments(data, edges)
        firsts = np.searchsorted(s.doc, np.arange(len(rows) + 1))
        marks = [np.frombuffer(r[2], "<u4") for r in rows]
        mark = np.concatenate(marks)
        seg = (mark & ~OPEN).astype(np.int64) + np.repeat(firsts[:-1], [len(m) for m in marks])
        copy, free = seg[mark < OPEN], np.sort(seg[mark >= OPEN])
        n = s.count[free]
        where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s.start[free], n)
        doc = np.repeat(s.doc[free], n)
        key = s.hasher.strings(where)
        s.hasher = None
        check = (Hasher(data, _CHECK_BYTES).strings(where) >> np.uint64(32)).astype(np.uint32)
        ids = np.array([NULL_ID if r[1] is None else r[1] for r in rows], np.int64)
        meta = _orders(ids)
        out = list(_deal(block, meta, (mix(key) % np.uint64(len(shards))).astype(np.int64), shards, doc, where - edges[doc], key, check))
        spans = np.stack([s.doc[copy], s.start[copy] - edges[s.doc[copy]], s.count[copy]]).astype("<i8").tobytes()
        out.append((shards[block % len(shards)], block, b"".join(r[0] for r in rows), None, None, None, spans, True))
        yield _rows(out)


Level = tuple[np.ndarray, np.ndarray, np.ndarray]


class LevelFamily:
    """Sorted suffix arrays of geometric sizes: fingerprints (64 bits by which they sort, 32 more to check) with the
    earliest start (an order number) of each."""

    def __init__(self):
        self.levels: list[Level] = []

    @staticmethod
    def merge(a: Level, b: Level) -> Level:
        keys, starts, checks = (np.concatenate(x) for x in zip(a, b))
        if not len(keys):
            return keys, starts, checks
        order = np.argsort(keys, kind="stable")  # takes two sorted runs in linear time
        same = keys[order][1:] == keys[order][:-1]
        if (same & (checks[order][1:] != checks[order][:-1])).any():  # two strings of one key: seldom
            order = np.lexsort((checks, keys))
        keys, checks = keys[order], checks[order]
        first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])))
        return keys[first], np.minimum.reduceat(starts[order], first), checks[first]

    @staticmethod
    def find(level: Level, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each suffix stands in a level that isn't empty, and whether it does."""
        last = len(level[0]) - 1
        at = np.minimum(np.searchsorted(level[0], keys), last)
        hit = level[0][at] == keys
        todo = np.flatnonzero(hit & (level[2][at] != checks))
        while len(todo):  # on through the strings of one key
            after = np.minimum(at[todo] + 1, last)
            more = (after > at[todo]) & (level[0][after] == keys[todo])
            hit[todo[~more]] = False
            todo = todo[more]
            at[todo] += 1
            todo = todo[level[2][at[todo]] != checks[todo]]
        return at, hit

    def earliest(self, keys: np.ndarray, starts: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The smaller of starts and the earliest start of each suffix in the levels."""
        for level in self.levels:
            at, hit = self.find(level, keys, checks)
            starts = np.where(hit, np.minimum(starts, level[1][at]), starts)
        return starts

    def add(self, keys: np.ndarray, starts: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The earliest start of each suffix so far, of its own batch and the levels, before and after it."""
        if not len(keys):
            return starts
        batch = self.merge((keys, starts, checks), (keys[:0], starts[:0], checks[:0]))
        seen = self.earliest(keys, batch[1][self.find(batch, keys, checks)[0]], checks)
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-1][0]) * 2 > len(self.levels[-2][0]):
            last = self.levels.pop()
            self.levels.append(self.merge(self.levels.pop(), last))
        return seen


def order_numbers(slices: list[tuple[np.ndarray, np.ndarray, np.ndarray]], blocks: list[int]) -> np.ndarray:
    """Numbers in the order of (id, block, document, place), from (ids, documents, places) of each slice of a block, in
    which a document's rows are neighbours: the documents are ranked, their places stand below."""
    ids, docs = (np.concatenate([x[i] for x in slices]) for i in (0, 1))
    block = np.repeat(blocks, [len(x[0]) for x in slices])
    new = np.append(True, (docs[1:] != docs[:-1]) | (block[1:] != block[:-1]))
    first = np.flatnonzero(new)
    rank = np.empty(len(first), np.int64)
    rank[np.lexsort((docs[first], block[first], ids[first]))] = np.arange(len(first))
    return (rank[np.cumsum(new) - 1] << 32) | np.concatenate([x[2] for x in slices]).astype(np.int64)


def _match_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2 in a shard: the suffixes that also start earlier, back to their blocks.

    Batches enter in the order of their first document, so nearly all matches are with existing levels; where blocks
    interleave, a second scan of the finished family finds starts that came in later but lie earlier.
    """
    for rows in _by_shard(batches):
        for r in rows:
            if r[7]:
                yield _rows([r])
        rows = [r for r in rows if not r[7]]
        if not rows:
            continue
        slices = [(unpack(r[3], DOC), unpack(r[4], PLACE)) for r in rows]
        slices = [(_ids(r[2])[d], d, p) for r, (d, p) in zip(rows, slices)]
        order = sorted(range(len(rows)), key=lambda j: (slices[j][0].min(), rows[j][1]))
        rows, slices = [rows[j] for j in order], [slices[j] for j in order]
        number = order_numbers(slices, [r[1] for r in rows])
        ends = np.cumsum([0, *(len(x[0]) for x in slices)])
        family, seen = LevelFamily(), []
        for r, a, z in zip(rows, ends, ends[1:]):
            seen.append(family.add(np.frombuffer(r[5], "<u8"), number[a:z], np.frombuffer(r[6], "<u4")))
        earlier = np.concatenate(seen) < number
        late = np.flatnonzero(~earlier)
        keys, checks = (np.concatenate([np.frombuffer(r[i], kind) for r in rows])[late] for i, kind in ((5, "<u8"), (6, "<u4")))
        earlier[late] = family.earliest(keys, number[late], checks) < number[late]
        out = []
        for r, (_, doc, place), a, z in zip(rows, slices, ends, ends[1:]):
            hit = np.flatnonzero(earlier[a:z])
            if len(hit):
                out.append((0, r[1], None, pack(doc[hit], DOC), pack(place[hit], PLACE), None, None, False))
        yield _rows(out)


def unite(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Maximal runs (begin, end) of the bytes that strings starting in [start, start + count) cover."""
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order], np.maximum.accumulate((starts + counts + LENGTH - 1)[order])
    new = np.append(True, begin[1:] > end[:-1])
    return np.stack([begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]], axis=1)


REMOVED = "row binary, runs binary"


def _gather_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3 in a block: the removed runs of each document."""

    def done(own, docs, places):
        rows, spans = _keys(own[2]), np.frombuffer(own[6], "<i8").reshape(3, -1)
        doc = np.concatenate([spans[0], *docs])
        start = np.concatenate([spans[1], *places])
        count = np.concatenate([spans[2], np.ones(len(doc) - spans.shape[1], np.int64)])
        order = np.argsort(doc, kind="stable")
        edges = np.searchsorted(doc[order], np.arange(len(rows) + 1))
        runs = [unite(start[order[a:z]], count[order[a:z]]).astype("<i8").tobytes() if z > a else b"" for a, z in zip(edges, edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(runs, pa.binary())], ["row", "runs"])

    own, docs, places = None, [], []
    for b in batches:
        for r in zip(*(b.column(i).to_pylist() for i in range(8))):
            if r[7]:
                if own is not None:
                    yield done(own, docs, places)
                own, docs, places = r, [], []
            else:
                docs.append(unpack(r[3], DOC).astype(np.int64))
                places.append(unpack(r[4], PLACE).astype(np.int64))
    if own is not None:
        yield done(own, docs, places)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, runs array<struct<begin: long, end: long>>"


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, runs, text) to the result."""
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        out = []
        for i, binary, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            raw, runs = text.as_py().encode(), np.frombuffer(binary, "<i8").reshape(-1, 2)
            kept, at = hashlib.sha256(), 0
            for begin, end in runs.tolist():
                kept.update(raw[at:begin])
                at = end
            kept.update(raw[at:])
            out.append((i, len(raw), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), kept.hexdigest(), [{"begin": x, "end": y} for x, y in runs.tolist()]))
        cols = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.int64()] * 4 + [pa.string(), kind]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "runs"])


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (binary), doc_id and text of a plain scan of Parquet files.

    A row is known by its file (64-bit hash of the path) and its place in it, however the files are split among tasks, so
    scans of different jobs agree when executors come or go between them.
    """
    at = docs.metadataColumn("_metadata")
    digits = [F.lpad(F.hex(x), KEY, "0") for x in (F.xxhash64(at["file_path"]), at["row_index"])]
    return docs.select(F.unhex(F.concat(*digits)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scan: bool = False) -> DataFrame:
    """The columns of RESULT for every row of docs.

    scan: docs is a plain scan of Parquet files, whose rows are known by file and place; else it is written first.
    """
    spark = docs.sparkSession
    docs = numbered(docs, id_col, text_col) if scan else numbered(cut(docs.select(id_col, text_col)), id_col, text_col)
    shards = shard_keys(spark)
    n = len(shards)

    def trip(sent, match, gather, schema):
        there = sent.repartition(n, "shard").sortWithinPartitions("shard", "block").mapInArrow(match, ROWS)
        back = there.repartition(n, "block").sortWithinPartitions("block", ~F.col("own"))
        return cut(back.mapInArrow(gather, schema))

    sent = docs.select("row", "doc_id", "text").mapInArrow(lambda b: _send_segments(b, shards), ROWS)
    marked = trip(sent, _match_segments, _gather_marks, MARKED)
    opened = F.exists(F.sequence(F.lit(1), F.expr("length(marks) div 4")), lambda i: F.hex(F.substring("marks", i * 4, F.lit(1))) >= "80")
    fully = ~opened & (F.expr("length(marks) div 4") == F.col("n_segments"))
    none = F.array().cast("array<struct<begin: long, end: long>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    untouched = marked.where("marks is null").select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.lower(F.hex("sha")).alias("kept_sha256"), none.alias("runs"))
    gone = marked.where("marks is not null").where(fully).select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), one.alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), whole.alias("runs"))
    partly = marked.where("marks is not null").where(~fully).select(F.col("row").alias("_row"), F.col("doc_id").alias("_id"), "marks")
    sent = docs.join(partly, F.col("row") == F.col("_row")).select("row", "doc_id", "marks", "text").mapInArrow(lambda b: _send_suffixes(b, shards), ROWS)
    runs = trip(sent, _match_suffixes, _gather_runs, REMOVED)
    clear = runs.where("length(runs) = 0").join(marked, "row").select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.lower(F.hex("sha")).alias("kept_sha256"), none.alias("runs"))
    cut_rows = runs.where("length(runs) > 0").withColumnRenamed("row", "_row")
    left = docs.join(cut_rows, F.col("row") == F.col("_row")).select("doc_id", "runs", "text").mapInArrow(_cut_texts, RESULT)
    return untouched.unionByName(gone).unionByName(clear).unionByName(left)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_runs(table(spark, sf_dir, "documents"), scan=True)
