"""Byte-level BPE encoding and decoding with a public rank file.

Pre-tokens are found by classes of code points, vectorised over a slice, with
the result of the pattern ``PATTERN``. A minimal perfect hash over the
vocabulary resolves every pre-token that is a whole vocabulary entry (the bytes
are compared, so a hash collision cannot give a wrong id); the others are
merged by a heap of (rank, position) over a doubly linked list of their bytes.

Defined results: a null or empty text has no ids; ids are little-endian
unsigned 32-bit integers in one binary value; decoding a null gives no bytes;
an id outside the vocabulary raises ValueError. Rows are handled one by one, so
repeated rows and ties give equal results.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hexafact.llm.mapping import add_columns
from hexafact.llm.text import BYTE_VALUE, Hasher, binary, mix

LETTER, NUMBER, SPACE = 1, 2, 3
APOSTROPHE, BLANK = 0x27, 0x20
#: Results of merged pre-tokens that a worker keeps; the oldest go first.
CACHE_ENTRIES = 400_000


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """The pattern's class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(low, high)))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
            for m in regex.finditer(pattern, every):
                table[low + m.start() : low + m.end()] = kind
    return table


def pre_tokens(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions at which a pre-token starts; none crosses a document's end."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    at = np.cumsum(width) - width
    kind = code_point_classes()[points]
    doc_start = np.searchsorted(at, offs[:-1])
    begins = np.empty(n, bool)
    begins[0], begins[1:] = True, kind[1:] != kind[:-1]
    begins[doc_start[doc_start < n]] = True
    last_of_doc = np.zeros(n + 1, bool)
    last_of_doc[doc_start] = True
    last_of_doc[n] = True
    run = np.flatnonzero(begins)
    stop = np.append(run[1:], n)
    run_kind = kind[run]

    # white space before other text gives up its last character: a blank joins what follows, another stands alone
    inner = (run_kind == SPACE) & ~last_of_doc[stop]
    final = stop[inner] - 1
    begins[final] = True
    joined = points[final] == BLANK
    begins[final[joined] + 1] = False

    # a lone apostrophe that begins a pre-token takes a contraction's letters
    alone = run[(stop - run == 1) & (points[run] == APOSTROPHE)]
    alone = alone[begins[alone] & ~last_of_doc[alone + 1]]
    if len(alone):
        one = points[alone + 1]
        two = points[np.minimum(alone + 2, n - 1)] * ((alone + 2 < n) & ~last_of_doc[alone + 2])
        is_one = np.isin(one, [ord(c) for c in "stmd"])
        is_two = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for hit, length in ((is_one, 1), (is_two, 2)):
            p = alone[hit]
            begins[p + 1] = False
            rest = p + 1 + length
            rest = rest[(rest < n) & ~last_of_doc[np.minimum(rest, n)]]
            rest = rest[kind[rest] == LETTER]
            begins[rest] = True
    return at[begins]


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: hash, then displace by bucket; single keys take a free slot each."""

    STEP = np.uint64(0x9FB21C651E98DF25)

    def __init__(self, keys: np.ndarray, shift: np.ndarray | None = None) -> None:
        """``shift``: the displacements of an earlier build over the same keys."""
        n = self.n = len(keys)
        self.buckets = np.uint64(n // 4 + 1)
        if shift is not None:
            self.shift = shift
            return
        self.shift = np.zeros(int(self.buckets), np.int64)
        bucket = (keys % self.buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(int(self.buckets) + 1))
        sizes = np.diff(bounds)
        free = np.ones(n, bool)
        tries = np.arange(1, 513, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            own, base = keys[order[bounds[b] : bounds[b + 1]]], np.uint64(0)
            while True:
                slot = self._slot(own[None, :], (tries + base)[:, None])
                good = free[slot].all(1)
                if len(own) > 1:
                    ordered = np.sort(slot, 1)
                    good &= (ordered[:, 1:] != ordered[:, :-1]).all(1)
                if good.any():
                    k = int(np.argmax(good))
                    self.shift[b] = int(tries[k] + base)
                    free[slot[k]] = False
                    break
                base += np.uint64(len(tries))
        for b, slot in zip(np.flatnonzero(sizes == 1), np.flatnonzero(free), strict=False):
            self.shift[b] = -int(slot) - 1

    def _slot(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(keys ^ (shift * self.STEP)) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot below n for any key; the only possible one for a key of the set."""
        shift = self.shift[(keys % self.buckets).astype(np.int64)]
        return np.where(shift < 0, -shift - 1, self._slot(keys, np.maximum(shift, 0).astype(np.uint64)))


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(Hasher.of(BYTE_VALUE[data]).ranges(start, end) + (end - start).astype(np.uint64))


class Vocabulary:
    """Ranks as look-up tables: bytes by id, the perfect hash, and merges by pair of ids."""

    def __init__(self, content: bytes, shift: np.ndarray | None = None) -> None:
        tokens: dict[int, bytes] = {}
        for line in content.splitlines():
            if line.strip():
                token, rank = line.split()
                tokens[int(rank)] = base64.b64decode(token)
        self.ids = np.array(sorted(tokens), np.int64)
        entries = [tokens[i] for i in self.ids]
        self.size = int(self.ids[-1]) + 1
        self.length = np.full(self.size, -1, np.int64)
        self.length[self.ids] = [len(e) for e in entries]
        self.offset = np.zeros(self.size, np.int64)
        ends = np.cumsum([len(e) for e in entries])
        self.offset[self.ids] = ends - [len(e) for e in entries]
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        keys = _hash(self.data, self.offset[self.ids], ends)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("the vocabulary repeats an entry")
        self.hash = PerfectHash(keys, shift)
        slots = self.hash.slots(keys)
        self.slot_id, self.slot_key = np.empty(len(keys), np.int64), np.empty(len(keys), np.uint64)
        self.slot_id[slots], self.slot_key[slots] = self.ids, keys
        rank = {e: int(i) for e, i in zip(entries, self.ids, strict=True)}
        self.byte_id = [rank[bytes([b])] for b in range(256)]
        self.pairs: dict[int, dict[int, int]] = {i: {} for i in rank.values()}
        for e, i in rank.items():
            for k in range(1, len(e)):
                if e[:k] in rank and e[k:] in rank:
                    self.pairs[rank[e[:k]]][rank[e[k:]]] = i
        self.cache: dict[bytes, bytes] = {}

    def whole(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens that are entries, -1 for others; and all the hashes."""
        keys = _hash(data, start, end)
        slot = self.hash.slots(keys)
        found = self.slot_id[slot]
        size = end - start
        good = np.flatnonzero((self.slot_key[slot] == keys) & (self.length[found] == size))
        ids = np.full(len(keys), -1, np.int64)
        if len(good):
            total = np.cumsum(size[good])
            begin = total - size[good]
            step = np.arange(total[-1])
            same = data[step + np.repeat(start[good] - begin, size[good])] == self.data[step + np.repeat(self.offset[found[good]] - begin, size[good])]
            good = good[np.logical_and.reduceat(same, begin)]
            ids[good] = found[good]
        return ids, keys

    def merged(self, word: bytes) -> bytes:
        """Ids of one pre-token as unsigned 32-bit integers: the lowest rank merges first, the leftmost of equals.

        Heap entries are ``rank * 2**width + position``. An entry is stale, and
        skipped, once its pair of neighbours no longer has its rank.
        """
        known = self.cache.get(word)
        if known is not None:
            return known
        n, pairs = len(word), self.pairs
        width = n.bit_length()
        mask = (1 << width) - 1
        ids = [self.byte_id[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        left = ids[0] if n else 0
        for i in range(1, n):
            right = ids[i]
            r = pairs[left].get(right)
            if r is not None:
                heap.append(r << width | i - 1)
            left = right
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & mask
            j, own, r = after[i], ids[i], top >> width
            if own < 0 or j >= n or pairs[own].get(ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                s = pairs[r].get(ids[k])
                if s is not None:
                    heappush(heap, s << width | i)
            p = before[i]
            if p >= 0:
                s = pairs[ids[p]].get(r)
                if s is not None:
                    heappush(heap, s << width | p)
        out = array("I", [x for x in ids if x >= 0]).tobytes()
        if n <= 64:
            if len(self.cache) >= CACHE_ENTRIES:
                for old in list(islice(self.cache, CACHE_ENTRIES // 4)):
                    del self.cache[old]
            self.cache[word] = out
        return out

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, and each document's bounds in them."""
        start = pre_tokens(data, offs)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        end = np.append(start[1:], len(data))
        ids, keys = self.whole(data, start, end)
        size = np.ones(len(ids), np.int64)
        missed = np.flatnonzero(ids < 0)
        _, sample, which = np.unique(keys[missed], return_index=True, return_inverse=True)
        raw = data.tobytes()
        own = [raw[start[m] : end[m]] for m in missed[sample]]
        parts = [self.merged(w) for w in own]
        part_size = np.array([len(p) // 4 for p in parts], np.int64)
        # equal hashes stand for equal bytes only after a comparison
        lengths = (end - start)[missed]
        odd = np.flatnonzero(lengths != lengths[sample][which]) if len(missed) else missed
        if len(missed):
            total = np.cumsum(lengths)
            begin = total - lengths
            step = np.arange(total[-1])
            first = start[missed][sample][which]
            limit = np.minimum(step + np.repeat(first - begin, lengths), len(data) - 1)
            same = data[step + np.repeat(start[missed] - begin, lengths)] == data[limit]
            odd = np.union1d(odd, np.flatnonzero(~np.logical_and.reduceat(same, begin)))
        if len(odd):
            extra = [self.merged(raw[start[m] : end[m]]) for m in missed[odd]]
            which = which.copy()
            which[odd] = len(parts) + np.arange(len(odd))
            parts += extra
            part_size = np.array([len(p) // 4 for p in parts], np.int64)
        size[missed] = part_size[which] if len(missed) else 0
        ends = np.cumsum(size)
        begins = ends - size
        out = np.empty(int(ends[-1]), np.uint32)
        hit = ids >= 0
        out[begins[hit]] = ids[hit]
        if len(missed):
            flat = np.frombuffer(b"".join(parts), np.uint32)
            part_end = np.cumsum(part_size)
            n = size[missed]
            total = np.cumsum(n)
            step = np.arange(total[-1])
            out[step + np.repeat(begins[missed] - (total - n), n)] = flat[step + np.repeat((part_end - part_size)[which] - (total - n), n)]
        bound = np.append(begins, ends[-1])[np.searchsorted(start, offs)]
        return out, bound

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and the end of each id's bytes."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.max() >= self.size or (self.length[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        size = self.length[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return np.zeros(0, np.uint8), ends
        return self.data[np.arange(ends[-1]) + np.repeat(self.offset[ids] - (ends - size), size)], ends


_LOADED: dict[str, Vocabulary] = {}


def load(content: bytes, shift: np.ndarray | None = None) -> Vocabulary:
    """The vocabulary of a rank file's bytes; a process builds it once."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(content, shift)
    return _LOADED[key]


def _shared(df: DataFrame, vocabulary: str):
    """A broadcast of the rank file's bytes and its perfect hash: a few MB, whatever the data."""
    with open(vocabulary, "rb") as f:
        content = f.read()
    return df.sparkSession.sparkContext.broadcast((content, load(content).hash.shift))


def encode(df: DataFrame, vocabulary: str, text: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add the ids of each text. ``vocabulary`` is a rank file that the driver can read."""
    shared = _shared(df, vocabulary)

    def ids(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> dict:
        flat, bound = load(*shared.value).encode(data, offs)
        return {out: binary([flat[a:b].astype("<u4").tobytes() for a, b in zip(bound[:-1], bound[1:], strict=True)])}

    return add_columns(df, ids, [T.StructField(out, T.BinaryType())], text, keep)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Add the bytes that each row's ids stand for."""
    shared = _shared(df, vocabulary)

    def texts(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> dict:
        flat, ends = load(*shared.value).decode(np.frombuffer(data.tobytes(), "<u4"))
        bound = np.append(0, ends)[offs // 4]
        raw = flat.tobytes()
        return {out: binary([raw[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True)])}

    return add_columns(df, texts, [T.StructField(out, T.BinaryType())], ids, keep)
