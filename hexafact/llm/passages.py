"""Removal of repeated passages of words, by difference-cover anchors.

A document's word positions that are in a difference cover modulo a period are
its anchors, each hashed with the words that follow it. Any two equal windows
have an offset below the period at which both are on the cover, so they share
an anchor inside, whatever their places. Anchors found in two documents mark
the windows around them as candidates; only these are hashed whole, and a
candidate whose words start in a document with a smaller id is removed. Thus
the shared anchor is extended to every full window that contains it.

Keys are 64-bit hashes for anchors (a collision only adds candidates) and 96
bits for windows.

Defined results: null and empty texts have no words; rows with equal ids are
one document of several texts: passages that they share with each other stay.
A null id is treated as the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexafact.llm.exchange import DECIDED, ENTRY_SCHEMA, bucket_count, decided, gathered, packed, sliding_min
from hexafact.llm.session import prepare
from hexafact.llm.text import Words, each_slice, hash_words, mix, split_words, windowed, windows

WINDOW = 50
#: Perfect difference sets: every difference modulo the period occurs once. Fixed values.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
NULL_ID = np.iinfo(np.int64).min
WINDOW_KEY = np.dtype([("a", "<u8"), ("b", "<u4")])
_GRAM = 3


def cover_for(width: int) -> tuple[int, tuple[int, ...]]:
    """Period and cover for windows of ``width`` words; the anchors keep at least a third of the width."""
    fit = [v for v in COVERS if v <= 0.65 * width]
    return (max(fit), COVERS[max(fit)]) if fit else (1, (0,))


def _ids(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column(rows.schema.get_field_index("doc_id")).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _buckets(hashed: np.ndarray, start: np.ndarray, width: int, n: int) -> np.ndarray:
    """Buckets by the least hash of 3 words inside: neighbours mostly share one."""
    gram = min(_GRAM, width)
    least = sliding_min(windowed(hashed, gram), width - gram + 1)
    return (mix(least[start]) % np.uint64(n)).astype(np.int64)


def anchors(words: Words, hashed: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, document and hash of each anchor."""
    period, cover = cover_for(width)
    on = np.zeros(period, bool)
    on[list(cover)] = True
    length = width - period + 1
    start, doc = windows(words.first, length)
    # an anchor is of use only inside a full window of its document
    full = np.diff(words.first)[doc] >= width
    keep = full & on[(start - words.first[doc]) % period]
    start, doc = start[keep], doc[keep]
    return start, doc, windowed(hashed, length)[start]


def _several(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """order, first entry of each key in that order, and for each key whether two documents hold it."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    head = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    last = np.append(head[1:], len(k)) - 1
    return order, head, d[head] != d[last] if len(k) else np.zeros(0, bool)


def shared_anchors(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Flags at the anchors that two documents hold."""
    period, _ = cover_for(width)
    length = width - period + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in each_slice(batches):
            words = split_words(data, offs)
            if not len(words.start):
                continue
            hashed, ids = hash_words(data, words), _ids(rows)
            start, doc, key = anchors(words, hashed, width)
            if not len(start):
                continue
            place, own = (start - words.first[doc]).astype(np.int32), ids[doc]
            order, head, many = _several(key, own)
            size = np.diff(np.append(head, len(order)))
            known = order[np.repeat(many, size)]
            if len(known):
                yield packed(np.full(len(known), DECIDED), np.zeros(len(known), np.uint64), own[known], place[known])
            # of a key known to be shared, two entries of two documents tell the others; of a key of one document, all places go
            first, last = order[head], order[np.append(head[1:], len(order)) - 1]
            sent = np.concatenate([order[~np.repeat(many, size)], first[many], last[many]])
            yield packed(_buckets(hashed, start[sent], length, buckets), key[sent], own[sent], place[sent])

    def decide(keys: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, head, many = _several(keys, ids)
        hit = order[np.repeat(many, np.diff(np.append(head, len(order))))]
        return ids[hit], places[hit]

    return decided(docs.select("doc_id", "text").mapInArrow(send, ENTRY_SCHEMA), decide, [np.uint64, np.int64, np.int32], np.int32)


def _places(value: list[bytes] | None) -> np.ndarray:
    return np.frombuffer(b"".join(value), np.int32) if value else np.zeros(0, np.int32)


def _with_flags(docs: DataFrame, flagged: DataFrame, out: str) -> DataFrame:
    by_doc = gathered(flagged, out)
    return docs.join(by_doc, F.coalesce(docs["doc_id"], F.lit(NULL_ID)) == by_doc["flag_doc_id"], "left").drop("flag_doc_id")


def later_windows(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Flags at the windows that also start in a document with a smaller id."""
    period, _ = cover_for(width)
    marked = _with_flags(docs.select("doc_id", "text"), shared_anchors(docs, width, buckets), "anchor_places").where("anchor_places is not null")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in each_slice(batches):
            words = split_words(data, offs)
            if not len(words.start):
                continue
            hashed, ids = hash_words(data, words), _ids(rows)
            on = np.zeros(len(hashed) + period + 1, np.int64)
            for d, value in enumerate(rows.column(rows.schema.get_field_index("anchor_places")).to_pylist()):
                p = _places(value)  # a text that shares its id with another may be shorter than the place
                p = p[p < words.first[d + 1] - words.first[d]]
                on[words.first[d] + p] = 1
            total = np.append(0, np.cumsum(on))
            start, doc = windows(words.first, width)
            keep = total[start + period] > total[start]
            start, doc = start[keep], doc[keep]
            if not len(start):
                continue
            key = np.empty(len(start), WINDOW_KEY)
            key["a"] = windowed(hashed, width)[start]
            key["b"] = windowed(hash_words(data, words, 1), width)[start] >> np.uint64(32)
            place, own = (start - words.first[doc]).astype(np.int32), ids[doc]
            least, at = _least(key, own)
            late = own > least
            if late.any():
                yield packed(np.full(late.sum(), DECIDED), np.zeros(late.sum(), WINDOW_KEY), own[late], place[late])
            sent = np.flatnonzero(~late)
            yield packed(_buckets(hashed, start[sent], width, buckets), key[sent], own[sent], place[sent])

    def decide(keys: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        late = ids > _least(keys, ids)[0]
        return ids[late], places[late]

    return decided(marked.mapInArrow(send, ENTRY_SCHEMA), decide, [WINDOW_KEY, np.int64, np.int32], np.int32)


def _least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the smallest document of its key, and the sorting order."""
    order = np.lexsort((keys["b"], keys["a"]))
    k = keys[order]
    new = np.append(True, (k["a"][1:] != k["a"][:-1]) | (k["b"][1:] != k["b"][:-1])) if len(k) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    out = np.empty(len(keys), np.int64)
    if len(k):
        out[order] = np.repeat(np.minimum.reduceat(ids[order], head), np.diff(np.append(head, len(k))))
    return out, order


def remove(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by a blank) of every document."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    buckets = bucket_count(docs, 30)
    marked = _with_flags(docs, later_windows(docs, width, buckets), "late_places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in each_slice(batches):
            words = split_words(data, offs)
            raw, removed, kept = data.tobytes(), [], []
            column = rows.column(rows.schema.get_field_index("late_places")).to_pylist()
            for d, value in enumerate(column):
                a, b = int(words.first[d]), int(words.first[d + 1])
                gone = np.zeros(b - a + 1, np.int64)
                p = _places(value)
                p = p[p + width <= b - a]
                np.add.at(gone, p, 1)
                np.add.at(gone, p + width, -1)
                stay = np.cumsum(gone[:-1]) == 0
                removed.append(b - a - int(stay.sum()))
                kept.append(b" ".join([raw[s:e] for s, e in zip(words.start[a:b][stay].tolist(), words.end[a:b][stay].tolist(), strict=True)]).decode("utf-8", "surrogatepass"))
            made = [pa.array(np.diff(words.first).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([rows.column(0), *made], names=["doc_id", "n_words", "n_removed", "kept"])

    return marked.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
