"""Removal of bytes in long repeated strings, by a hash-compared suffix sort.

Every string of ``WIDTH`` bytes has an anchor: the place inside it of the least
hash of ``GRAM`` bytes, the leftmost of equals; equal strings have their anchor
at the same offset. Anchors whose hash occurs once in the corpus drop out. The
others are dealt by hash with the bytes around them, as far as a string with
that anchor can reach. In a bucket the suffixes that start at the anchors are
sorted by a mergesort whose comparisons find the common extension by binary
search over prefix polynomial hashes, so a comparison takes a logarithmic
number of look-ups; all groups and runs of a level are merged at once. Common
prefixes of neighbours then tell which suffixes agree to any depth, prefix
hashes to the left complete the strings, and for each anchor the outermost
repeated strings give the bytes to remove.

Hash equality is verified: common prefixes of neighbours, and the left parts of
the strings that are reported, are compared byte by byte; a bucket with a
collision is done again by comparing the strings themselves.

Defined results: null and empty texts have no bytes; repeated rows repeat each
other's strings; different texts under one id are different documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexafact.llm.exchange import DECIDED, ENTRY_SCHEMA, bucket_count, decided, flags, gathered, packed, sliding_min
from hexafact.llm.session import prepare
from hexafact.llm.text import BYTE_VALUE, Hasher, each_slice, mix

WIDTH = 200
GRAM = 32
CHUNK_BYTES = 1 << 20
_SPAN = np.dtype([("start", "<i4"), ("end", "<i4")])
_CONTEXT_SCHEMA = f"{ENTRY_SCHEMA}, lefts binary, rights binary, context binary"


def _hashes(data: np.ndarray) -> Hasher:
    return Hasher.of(BYTE_VALUE[data])


def anchors(data: np.ndarray, offs: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of all strings of ``width`` bytes, and their hashes."""
    size = np.diff(offs)
    if not len(data) or not (size >= width).any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _hashes(data)
    at = np.arange(len(data) - gram + 1)
    key = mix(h.ranges(at, at + gram))
    bits = np.uint64(max(1, int(len(key)).bit_length()))
    ordered = (key >> bits << bits) | at.astype(np.uint64)
    least = sliding_min(ordered, width - gram + 1)
    count = np.maximum(size - width + 1, 0)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offs[:-1], count)
    found = np.unique((least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))
    return found, key[found]


class SuffixSort:
    """Sorts suffixes within groups. Suffix i is ``data[begin[i] : begin[i] + size[i]]``."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, group: np.ndarray) -> None:
        self.data, self.begin, self.size = data, begin, size
        self.hashes = _hashes(data)
        self.order = np.argsort(group, kind="stable")
        g = group[self.order]
        self.head = np.append(True, g[1:] != g[:-1]) if len(g) else np.zeros(0, bool)
        first = np.flatnonzero(self.head)
        count = np.diff(np.append(first, len(g)))
        self.first, self.count = np.repeat(first, count), np.repeat(count, count)
        self._sort()

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b, by binary search over hashes."""
        x, y = self.begin[a], self.begin[b]
        low, high = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = self.hashes.ranges(x, x + mid) == self.hashes.ranges(y, y + mid)
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
        return low

    def _before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0, 1: how suffix a compares with b."""
        n = self.common(a, b)
        end_a, end_b = n == self.size[a], n == self.size[b]
        last = len(self.data) - 1
        x = self.data[np.minimum(self.begin[a] + n, last)].astype(np.int16)
        y = self.data[np.minimum(self.begin[b] + n, last)].astype(np.int16)
        return np.where(end_a & end_b, 0, np.where(end_a, -1, np.where(end_b, 1, np.sign(x - y))))

    def _sort(self) -> None:
        width, slot = 1, np.arange(len(self.order)) - self.first
        active = np.flatnonzero(self.count > 1)
        while len(active):
            own, first, count, q = self.order[active], self.first[active], self.count[active], slot[active]
            run = q // width
            other = run ^ 1
            low = np.minimum(other * width, count)
            high = np.minimum((other + 1) * width, count)
            base = low.copy()
            right = (run & 1) == 1
            todo = np.flatnonzero(low < high)
            while len(todo):
                mid = (low[todo] + high[todo]) >> 1
                c = self._before(self.order[first[todo] + mid], own[todo])
                # how many of the other run come first: a left element goes before its equals
                less = np.where(right[todo], c <= 0, c < 0)
                low[todo] = np.where(less, mid + 1, low[todo])
                high[todo] = np.where(less, high[todo], mid)
                todo = todo[low[todo] < high[todo]]
            target = np.minimum(run, other) * width + (q - run * width) + (low - base)
            self.order[first + target] = own
            width *= 2
            active = active[self.count[active] > width]

    def neighbours(self) -> np.ndarray:
        """Common prefix of each sorted suffix with the one before it, 0 at a group's first."""
        out = np.zeros(len(self.order), np.int64)
        inner = np.flatnonzero(~self.head)
        out[inner] = self.common(self.order[inner - 1], self.order[inner])
        return out


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, step: int = 1 << 14) -> bool:
    """Whether data[a:a+size] equals data[b:b+size] throughout."""
    for i in range(0, len(a), step):
        n = size[i : i + step]
        total = np.cumsum(n)
        at = np.arange(total[-1]) - np.repeat(total - n, n)
        if (data[at + np.repeat(a[i : i + step], n)] != data[at + np.repeat(b[i : i + step], n)]).any():
            return False
    return True


def outermost(data: np.ndarray, anchor: np.ndarray, left: np.ndarray, right: np.ndarray, key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor whose strings repeat: its index, and the largest and smallest distance from a repeated string's start.

    ``anchor`` are places in ``data`` with ``left`` and ``right`` bytes of their document at either side.
    """
    n = len(anchor)
    far, near = np.full(n, -1), np.full(n, width + 1)
    sort = SuffixSort(data, anchor, right, key)
    common = sort.neighbours()
    inner = np.flatnonzero(common > 0)
    good = _same_bytes(data, anchor[sort.order[inner - 1]], anchor[sort.order[inner]], common[inner])
    order, after = sort.order, np.append(common[1:], 0)
    far_mate, near_mate = np.full(n, -1), np.full(n, -1)
    if good:
        for d in range(int(left.max()) + 1 if n else 0):
            need = width - d
            # a suffix without a neighbour that agrees to this depth has no mate
            use = np.flatnonzero((left[order] >= d) & (right[order] >= need) & ((common >= need) | (after >= need)))
            if not len(use):
                continue
            interval = np.cumsum(common < need)[use]
            item = order[use]
            whole = mix(sort.hashes.ranges(anchor[item] - d, anchor[item]) ^ mix(interval.astype(np.uint64)))
            by = np.argsort(whole, kind="stable")
            w = whole[by]
            first = np.append(True, w[1:] != w[:-1])
            head = np.flatnonzero(first)
            size = np.diff(np.append(head, len(w)))
            many = np.repeat(size > 1, size)
            if not many.any():
                continue
            lead = np.repeat(item[by][head], size)[many]
            hit = item[by][many]
            far[hit], far_mate[hit] = d, lead
            fresh = near[hit] > width
            near[hit[fresh]], near_mate[hit[fresh]] = d, lead[fresh]
        for distance, mate in ((far, far_mate), (near, near_mate)):
            hit = np.flatnonzero((mate >= 0) & (distance > 0))
            good = good and (not len(hit) or _same_bytes(data, anchor[hit] - distance[hit], anchor[mate[hit]] - distance[hit], distance[hit]))
    if not good:
        far, near = _compared(data, anchor, left, right, width)
    hit = np.flatnonzero(far >= 0)
    return hit, far[hit], near[hit]


def _compared(data: np.ndarray, anchor: np.ndarray, left: np.ndarray, right: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same without hashes, for a bucket with a collision."""
    raw, n = data.tobytes(), len(anchor)
    far, near = np.full(n, -1), np.full(n, width + 1)
    for d in range(int(left.max()) + 1 if n else 0):
        seen: dict[bytes, list[int]] = {}
        for i in np.flatnonzero((left >= d) & (right >= width - d)).tolist():
            seen.setdefault(raw[anchor[i] - d : anchor[i] - d + width], []).append(i)
        for own in seen.values():
            if len(own) > 1:
                far[own] = d
                near[own] = np.minimum(near[own], d)
    return far, near


def _keys(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column(rows.schema.get_field_index("doc_key")).to_numpy()


def repeated_anchors(docs: DataFrame, width: int, gram: int, buckets: int) -> DataFrame:
    """Flags at anchors whose hash occurs at another place too."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in each_slice(batches, limit=1 << 20):
            at, key = anchors(data, offs, width, gram)
            if not len(at):
                continue
            doc = np.searchsorted(offs[1:], at, "right")
            own, place = _keys(rows)[doc], (at - offs[doc]).astype(np.int32)
            order = np.argsort(key, kind="stable")
            k = key[order]
            head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            size = np.diff(np.append(head, len(k)))
            known = order[np.repeat(size > 1, size)]
            if len(known):
                yield packed(np.full(len(known), DECIDED), np.zeros(len(known), np.uint64), own[known], place[known])
            # two entries stand for a hash that the slice holds more often
            sent = np.concatenate([order[head], order[head[size > 1] + 1]])
            yield packed((mix(key[sent]) % np.uint64(buckets)).astype(np.int64), key[sent], own[sent], place[sent])

    def decide(keys: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        same = k[1:] == k[:-1]
        hit = order[np.append(False, same) | np.append(same, False)] if len(k) else order
        return ids[hit], places[hit]

    return decided(docs.select("doc_key", "text").mapInArrow(send, ENTRY_SCHEMA), decide, [np.uint64, np.int64, np.int32], np.int32)


def _places(value: list[bytes] | None, kind) -> np.ndarray:
    return np.frombuffer(b"".join(value), kind) if value else np.zeros(0, kind)


def repeated_spans(docs: DataFrame, width: int, gram: int, buckets: int) -> DataFrame:
    """Flags with spans of repeated bytes. ``docs`` has doc_key and text, and maybe more."""
    marked = docs.join(gathered(repeated_anchors(docs, width, gram, buckets), "anchor_places"), F.col("doc_key") == F.col("flag_doc_id"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in each_slice(batches, limit=1 << 20):
            places = [np.unique(_places(v, np.int32)) for v in rows.column(rows.schema.get_field_index("anchor_places")).to_pylist()]
            doc = np.repeat(np.arange(len(places)), [len(p) for p in places])
            place = np.concatenate(places).astype(np.int64)
            at, limit = offs[:-1][doc] + place, offs[1:][doc]
            inside = at + gram <= limit
            doc, place, at, limit = doc[inside], place[inside], at[inside], limit[inside]
            if not len(at):
                continue
            left, right = np.minimum(place, width - gram), np.minimum(limit - at, width)
            h = _hashes(data)
            key = mix(h.ranges(at, at + gram))
            own = _keys(rows)[doc]
            whole = mix(h.ranges(at - left, at + right) ^ mix(left.astype(np.uint64) << np.uint64(16) | right.astype(np.uint64)))
            order = np.argsort(whole, kind="stable")
            w = whole[order]
            head = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            size = np.diff(np.append(head, len(w)))
            # equal surroundings within the slice repeat each other wholly; one of them goes on
            lead = np.repeat(order[head], size)
            raw = data.tobytes()
            twin = np.repeat(size > 1, size)
            equal = [raw[at[a] - left[a] : at[a] + right[a]] == raw[at[b] - left[b] : at[b] + right[b]] for a, b in zip(order[twin].tolist(), lead[twin].tolist(), strict=True)]
            collided = order[twin][~np.array(equal, bool)] if equal else order[:0]
            known = order[twin]
            known = known[(left + right)[known] >= width]
            known = known[~np.isin(lead[np.argsort(order)][known], lead[np.argsort(order)][collided])] if len(collided) else known
            if len(known):
                span = np.empty(len(known), _SPAN)
                span["start"], span["end"] = (place - left)[known], (place + right)[known]
                yield _contexts(packed(np.full(len(known), DECIDED), np.zeros(len(known), np.uint64), own[known], span), None)
            sent = np.concatenate([order[head], collided])
            sent = sent[(left + right)[sent] >= width]
            bucket = (mix(key[sent]) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            sent, bucket = sent[by], bucket[by]
            edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
            pieces = [raw[a:b] for a, b in zip((at - left)[sent].tolist(), (at + right)[sent].tolist(), strict=True)]
            l2, r2 = left[sent].astype(np.int16), right[sent].astype(np.int16)
            more = [[l2[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], [r2[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], [b"".join(pieces[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]]
            yield _contexts(packed(bucket, key[sent], own[sent], place[sent].astype(np.int32)), more)

    def decide(keys, ids, places, lefts, rights, context) -> tuple[np.ndarray, np.ndarray]:
        # whole groups of a key at a time, about CHUNK_BYTES of context together
        order = np.argsort(keys, kind="stable")
        size = lefts.astype(np.int64) + rights
        begin = np.cumsum(size) - size
        k, total = keys[order], np.cumsum(size[order])
        edges = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k))
        docs_, spans = [ids[:0]], [np.empty(0, _SPAN)]
        at = 0
        while at < len(edges) - 1:
            low = edges[at]
            goal = (total[low - 1] if low else 0) + CHUNK_BYTES
            at = max(at + 1, int(np.searchsorted(total[edges[1:] - 1], goal, "right")))
            own = order[low : edges[at]]
            if len(own) < 2:
                continue
            context_ = np.concatenate([context[a : a + n] for a, n in zip(begin[own].tolist(), size[own].tolist(), strict=True)])
            left, right = lefts[own].astype(np.int64), rights[own].astype(np.int64)
            hit, far, near = outermost(context_, np.cumsum(left + right) - right, left, right, keys[own], width)
            span = np.empty(len(hit), _SPAN)
            span["start"], span["end"] = places[own][hit] - far, places[own][hit] - near + width
            docs_.append(ids[own][hit])
            spans.append(span)
        return np.concatenate(docs_), np.concatenate(spans)

    return decided(marked.mapInArrow(send, _CONTEXT_SCHEMA), decide, [np.uint64, np.int64, np.int32, np.int16, np.int16, np.uint8], _SPAN)


def _contexts(batch: pa.RecordBatch, more: list[list[bytes]] | None) -> pa.RecordBatch:
    columns = [pa.array(m, pa.binary()) for m in more] if more else [pa.nulls(len(batch), pa.binary())] * 3
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "lefts", "rights", "context"])


def remove(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every document."""
    if not 1 <= gram <= width < 1 << 15:
        raise ValueError("the gram must fit in the width")
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("doc_key"), "text")
    # an anchor with its surroundings counts as several entries
    buckets = bucket_count(docs, 10)
    # both joins read docs by doc_key with the same columns, so its shuffle is written once
    spans = gathered(repeated_spans(docs, width, gram, buckets), "spans")
    marked = docs.join(spans, F.col("doc_key") == F.col("flag_doc_id"), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in each_slice(batches):
            made: list[list] = [[], [], [], []]
            for d, value in enumerate(rows.column(rows.schema.get_field_index("spans")).to_pylist()):
                own = data[offs[d] : offs[d + 1]]
                change = np.zeros(len(own) + 1, np.int64)
                s = _places(value, _SPAN)
                np.add.at(change, s["start"], 1)
                np.add.at(change, s["end"], -1)
                gone = np.cumsum(change[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                for column, x in zip(made, (len(own), int(gone.sum()), int(begins.sum()), own[~gone].tobytes()), strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(m, k) for m, k in zip(made, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return marked.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


__all__ = ["SuffixSort", "anchors", "flags", "outermost", "remove", "repeated_anchors", "repeated_spans"]
