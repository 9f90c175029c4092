"""N-gram Jaccard self-join by prefix filters under several global orders.

A document is the set of its distinct word shingles. Documents with equal sets
are one entity; only entities are compared. If two sets reach the similarity,
the first tokens of each under any order of all tokens intersect, as each must
lack fewer tokens of the other than its prefix is long. Under the first order
tokens are sorted by how common they are, then by a hash, so prefixes hold the
rarest; under the second by another hash alone. How common a token is comes from
counts over all documents: tokens met twice in a slice of the corpus are counted,
the ``HEAVY`` most common get a class, all others are rare; the class affects the
order only, never the result.

Entities with a common prefix token under the first order form lists, split
where sizes differ too much, and equal lists are merged. A pair from a list is a
candidate if its prefixes under the second order meet too, and if its bitmaps do
not show too many tokens of one that the other lacks; a bitmap has 4 to 8 bits
for each token of its set, and is folded to the smaller of the two. Only
candidates are verified, by the exact count of shared shingles (64-bit hashes).

Lists of mostly the same members, as two least hashes of them tell, become one
family. Rounds keep groups of near copies from making all their pairs. First each
family's members are compared with its smallest one. Then, as long as this finds
links, each member's ``BEST`` most alike candidates in other components are
verified. Last, all candidates still in different components are, so no link
between components is lost. A family larger than ``CHUNK`` is split by the prefix
tokens of the second order, and what is still larger is compared chunk by chunk.
Pairs go to blocks that hold one entity and up to ``BLOCK`` of its partners, so a
block takes the memory of one partner at a time.

Component labels are the smallest doc_id reachable by links. Links inside a
component are not counted: most of them are never looked at.

Defined results: null texts and texts without words have no shingles and are
linked with nothing, equal ones neither; rows with equal ids count as one
document for component_id; a null id has the component of its text, which is
null if all documents linked with it have null ids; an empty table gives an
empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexafact.llm.components import components
from hexafact.llm.exchange import ENTRY_SCHEMA, bucket_count, packed, reduced
from hexafact.llm.session import discard, few, light, materialise, parallelism, prepare, small
from hexafact.llm.text import each_slice, hash_words, mix, split_words, trim, windowed, windows

SHINGLE = 5
PERCENT = 80
HEAVY = 1 << 17
#: Bits of a bitmap for each token, before rounding up to a power of two.
BITS_PER_TOKEN = 4
BLOCK = 1024
CHUNK = 2048
BEST = 3
#: Rounds of most alike candidates, before all others are looked at.
ROUNDS = 3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PAIR = "a bigint, b bigint"


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, and each document's bounds in them."""
    data = _LOWER[data]
    words = split_words(data, offs)
    n = len(offs) - 1
    if not len(words.start):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    hashed = hash_words(data, words)
    start, doc = windows(words.first, width)
    key = windowed(hashed, width)[start]
    count = np.diff(words.first)
    for short in range(1, width):  # the whole sequence is one shingle
        own = np.flatnonzero(count == short)
        if len(own):
            doc = np.concatenate([doc, own])
            key = np.concatenate([key, windowed(hashed, short)[words.first[own]]])
    if (count < width).any():
        order = np.argsort(doc, kind="stable")
        key, doc = key[order], doc[order]
    edge = np.searchsorted(doc, np.arange(n + 1))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        key[a:b].sort()
    new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))
    total = np.append(0, np.cumsum(new))
    return key[new], total[edge]


def entities(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A name for each set: a hash of its size and the sums of two hashes of its tokens."""
    sums = [np.append(np.uint64(0), np.cumsum(mix(tokens ^ np.uint64(k)))) for k in (0x3C6EF372FE94F82B, 0x1F83D9ABFB41BD6B)]
    one, two = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
    return mix(mix(one + np.diff(bounds).astype(np.uint64)) ^ two).view(np.int64)


def _bitmap_bits(size: int) -> int:
    return 1 << max(6, (BITS_PER_TOKEN * size - 1).bit_length())


def _ranks(tokens: np.ndarray, order: int, heavy: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Places of tokens in an order: 6 bits of class, 58 of a hash."""
    rank = mix(tokens ^ np.uint64(0x51ED270B7F4A7C15 * (order + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(6)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
        rank |= np.where(heavy[at] == tokens, level[at], 0).astype(np.uint64) << np.uint64(58)
    return rank


def _prefixes(rank: np.ndarray, bounds: np.ndarray, percent: int, which: np.ndarray) -> list[np.ndarray]:
    """The lowest ranks of each set in ``which``: so many that two sets of the similarity share one."""
    out = []
    for i in which.tolist():
        own = rank[bounds[i] : bounds[i + 1]]
        k = len(own) + percent * len(own) // -100 + 1
        out.append(np.partition(own, k - 1)[:k] if k < len(own) else own)
    return out


def _signatures(tokens: np.ndarray, bounds: np.ndarray, percent: int, which: np.ndarray) -> list[bytes]:
    """For each set in ``which``: a bitmap of its tokens, then 16 bits of each prefix token under the second order."""
    none = tokens[:0]
    bit = mix(tokens + np.uint64(3))
    prefixes = _prefixes(_ranks(tokens, 1, none, none), bounds, percent, which)
    out = []
    for i, prefix in zip(which.tolist(), prefixes, strict=True):
        own = bit[bounds[i] : bounds[i + 1]]
        bits = np.zeros(_bitmap_bits(len(own)), bool)
        bits[own & np.uint64(len(bits) - 1)] = True
        out.append(np.packbits(bits, bitorder="little").tobytes() + np.unique((prefix & np.uint64(0xFFFF)).astype(np.uint16)).tobytes())
    return out


def _bitmap(signature: bytes, size: int) -> np.ndarray:
    return np.frombuffer(signature, np.uint64, _bitmap_bits(size) // 64)


def _codes(signature: bytes, size: int) -> np.ndarray:
    return np.frombuffer(signature, np.uint16, offset=_bitmap_bits(size) // 8)


def _folded(bitmap: np.ndarray, size: int) -> np.ndarray:
    return bitmap if len(bitmap) == size else np.bitwise_or.reduce(bitmap.reshape(-1, size))


def _least_common(a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """How many tokens sets of these sizes share at least, if they reach the similarity."""
    return -(-percent * (a + b) // (100 + percent))


def compatible(a: bytes, b: bytes, size_a: int, size_b: int, percent: int) -> bool:
    """Whether two signatures allow the similarity."""
    common = _least_common(size_a, size_b, percent)
    if common > min(size_a, size_b):
        return False
    x, y = _bitmap(a, size_a), _bitmap(b, size_b)
    words = min(len(x), len(y))
    x, y = _folded(x, words), _folded(y, words)
    if int(np.bitwise_count(x & ~y).sum()) > size_a - common or int(np.bitwise_count(y & ~x).sum()) > size_b - common:
        return False
    return _meet(_codes(a, size_a), _codes(b, size_b))


def _meet(a: np.ndarray, b: np.ndarray) -> bool:
    at = np.searchsorted(a, b)
    return bool((a[np.minimum(at, len(a) - 1)] == b).any())


def _surveyed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """kind 0: doc_id, size, entity, and a signature for one document of each entity in a slice; kind 1: a token met twice in a slice, and in how many of its documents."""
    names = ["kind", "x", "y", "z", "text_key", "signature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in each_slice(batches):
            tokens, bounds = shingle_sets(data, offs, width)
            size = np.diff(bounds)
            n = len(size)
            name = entities(tokens, bounds)
            full = np.flatnonzero(size > 0)
            _, one = np.unique(name[full], return_index=True)
            own: list[bytes | None] = [None] * n
            for i, sig in zip(full[one].tolist(), _signatures(tokens, bounds, percent, full[one]), strict=True):
                own[i] = sig
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), rows.column(0), pa.array(size.astype(np.int64)), pa.array(name, mask=size == 0), rows.column(1), pa.array(own, pa.binary())], names=names)
            # copies of one set are one
            kept = np.zeros(n, bool)
            kept[full[one]] = True
            ordered = np.sort(tokens[np.repeat(kept, size)])
            head = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
            count = np.diff(np.append(head, len(ordered)))[: len(head)]
            often = count > 1
            if often.any():
                k = int(often.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(ordered[head[often]].view(np.int64)), pa.array(count[often].astype(np.int64)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], names=names)

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "kind int, x bigint, y bigint, z bigint, text_key bigint, signature binary")


def _lists(docs: DataFrame, width: int, percent: int, heavy: np.ndarray, level: np.ndarray, buckets: int) -> DataFrame:
    """name, family, members: distinct lists of entities that share a prefix token under the first order.

    A token travels as 32 bits beside its bucket: two tokens that look alike only lengthen a list.
    """
    shared = docs.sparkSession.sparkContext.broadcast((heavy, level))  # HEAVY tokens at most

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, classes = shared.value
        for _, data, offs in each_slice(batches):
            tokens, bounds = shingle_sets(data, offs, width)
            if not len(tokens):
                continue
            name, size = entities(tokens, bounds), np.diff(bounds)
            # copies of one set in the slice send once
            full = np.flatnonzero(size > 0)
            which = full[np.unique(name[full], return_index=True)[1]]
            found = _prefixes(_ranks(tokens, 0, common, classes), bounds, percent, which)
            owner = np.repeat(which, [len(f) for f in found])
            own = mix(np.concatenate(found))
            yield packed((own % np.uint64(buckets)).astype(np.int64), (own >> np.uint64(32)).astype(np.uint32), name[owner], np.minimum(size[owner], 65535).astype(np.uint16))

    def listed(keys: np.ndarray, who: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        # most tokens are met once: they go first
        by = np.argsort(keys, kind="stable")
        k = keys[by]
        same = k[1:] == k[:-1]
        by = by[np.append(False, same) | np.append(same, False)] if len(k) else by
        keys, who, size = keys[by], who[by], size[by]
        by = np.lexsort((who, size, keys))
        k, w, s = keys[by], who[by], size[by].astype(np.int64)
        new = np.append(True, (k[1:] != k[:-1]) | (w[1:] != w[:-1]))[: len(k)]
        k, w, s = k[new], w[new], s[new]
        # sizes from 65535 on are all that: they stay together
        head = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (percent * s[1:] > 100 * s[:-1]))[: len(k)])
        count = np.diff(np.append(head, len(k)))
        head, count = head[count > 1], count[count > 1]
        total = np.append(np.uint64(0), np.cumsum(mix(w.view(np.uint64))))
        name = mix(total[head + count] - total[head])
        _, one = np.unique(name, return_index=True)
        head, count, name = head[one], count[one], name[one]
        family = np.zeros(len(head), np.uint64)
        for k in (11, 12):  # the members with the least hash, twice
            hashed = mix(w.view(np.uint64) ^ mix(np.array([k], np.uint64)))
            least = [hashed[a : a + c].min() for a, c in zip(head.tolist(), count.tolist(), strict=True)]
            family = mix(family ^ np.array(least, np.uint64))
        raw = w.tobytes()
        members = [raw[8 * a : 8 * (a + c)] for a, c in zip(head.tolist(), count.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(family.view(np.int64)), pa.array(members, pa.binary())], names=["name", "family", "members"])

    entries = docs.select("doc_id", "text").mapInArrow(send, ENTRY_SCHEMA)
    found = reduced(entries, listed, [np.uint32, np.int64, np.uint16], "name bigint, family bigint, members binary")
    return found.groupBy("name").agg(F.first("family").alias("family"), F.first("members").alias("members"))


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        members = b.column(1).to_pylist()
        which = pa.array(np.repeat(np.arange(len(members)), [len(m) // 8 for m in members]), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(which), pa.array(np.frombuffer(b"".join(members), np.int64))], names=["name", "member"])


def _families(lists: DataFrame, signatures: DataFrame) -> DataFrame:
    """name, member, size: the members of all lists of a family."""
    flat = lists.select("family", "members").mapInArrow(_flat, "name bigint, member bigint").distinct()
    return light(flat, lists).join(signatures.select(F.col("entity").alias("member"), "size"), "member").select("name", "member", "size")


def _with_smallest(families: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of each family's smallest member and those within reach of it."""
    least = families.groupBy("name").agg(F.min(F.struct("size", "member")).alias("one"))
    both = families.join(light(least, families), "name").where((F.col("member") != F.col("one.member")) & (F.col("size") * percent <= F.col("one.size") * 100))
    return few(both.select(F.least("member", "one.member").alias("a"), F.greatest("member", "one.member").alias("b")).distinct(), families)


def _pair_batch(pair: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pair[:, 0], pa.int64()), pa.array(pair[:, 1], pa.int64())], names=["a", "b"])


def _open(families: DataFrame, roots: DataFrame) -> DataFrame:
    """name, member, root, g of the members of families, of g members, that still have several roots. Families of two are done: their pair was the first."""
    flat = families.join(roots, families["member"] == roots["node"], "left").select("name", "member", F.coalesce("root", "member").alias("root"))
    flat = materialise(flat, "family-members")
    open_ = flat.groupBy("name").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("g")).where("low < high and g > 2").select("name", "g")
    out = materialise(flat.join(light(open_, flat), "name"), "open-families")
    discard(flat)
    return out


def _placed(rows: DataFrame, signatures: DataFrame) -> DataFrame:
    """family, name, low, high, chunk, member, size, root, signature: the blocks that each member goes to.

    Of families of over CHUNK members, those that share a prefix token under the second order too make a family of their own. What
    is larger still is cut into chunks by a hash, and each pair of chunks is a block.
    """
    none = F.lit(0)

    def signed(placed: DataFrame) -> DataFrame:
        return placed.join(signatures, placed["member"] == signatures["entity"]).select("family", "name", "low", "high", "chunk", "member", "size", "root", "signature")

    short = rows.where(F.col("g") <= CHUNK).select(F.col("name").alias("family"), "name", none.alias("low"), none.alias("high"), none.alias("chunk"), "member", "root")
    short = signed(light(short, rows))
    long = rows.where(F.col("g") > CHUNK)
    if long.isEmpty():
        return short

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = batch.column(0).to_numpy()
            codes = [_codes(s, k) for s, k in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            which, flat = np.repeat(np.arange(len(codes)), [len(c) for c in codes]), np.concatenate(codes)
            for at in range(0, len(which), 1 << 16):
                part, code = which[at : at + (1 << 16)], flat[at : at + (1 << 16)].astype(np.uint64)
                made = mix(mix(name[part].view(np.uint64)) + code).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(made), *(batch.column(k).take(pa.array(part)) for k in range(3))], names=["name", "family", "member", "root"])

    joined = light(long, rows).join(signatures, long["member"] == signatures["entity"]).select("name", "member", "root", "size", "signature")
    pieces = materialise(joined.mapInArrow(split, "name bigint, family bigint, member bigint, root bigint"), "split-families")
    counts = pieces.groupBy("name").agg(F.count("*").alias("g"), F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("name", "g")
    chunks = F.ceil(F.col("g") / F.lit(CHUNK)).cast("int")
    pieces = pieces.join(light(counts, pieces), "name").withColumn("chunk", F.pmod(F.xxhash64("member"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    pieces = pieces.select("family", "name", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "member", "root")
    return short.unionByName(signed(pieces))


def _across(rows: DataFrame, signatures: DataFrame, percent: int, best: bool) -> DataFrame:
    """family, a, b: candidates among a family's members in different components, each member's BEST most alike, or all."""
    spark = rows.sparkSession
    placed = _placed(rows, signatures)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        found: list[np.ndarray] = []
        for b in batches:
            for family, name, low, high, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (family, name, low, high) != at:
                    found += close(at, own)
                    if sum(map(len, found)) > 1 << 17:
                        yield made(found)
                        found = []
                    at, own = (family, name, low, high), []
                own.append(row)
        found += close(at, own)
        if found:
            yield made(found)
        own = []
        trim()

    def made(found: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=["family", "a", "b"])

    def close(at: tuple | None, own: list) -> list[np.ndarray]:
        out = []
        own.sort(key=lambda r: (r[2], r[1]))
        chunk, member, size, root = (np.array([r[k] for r in own], np.int64) for k in range(4))
        if not len(own) or (root == root[0]).all():
            return out
        codes = [_codes(r[4], r[2]) for r in own]
        width = np.array([_bitmap_bits(r[2]) // 64 for r in own], np.int64)
        maps: dict[int, np.ndarray] = {}

        def folded(w: int) -> np.ndarray:
            """Bitmaps of those that a member with a bitmap of w may be compared with, at most that long."""
            if w not in maps:
                for old in [x for x in maps if 2 * x < w]:
                    del maps[old]
                maps[w] = np.zeros((len(own), w), np.uint64)
                for k in np.flatnonzero((width == w) | (width == 2 * w)).tolist():
                    maps[w][k] = _folded(_bitmap(own[k][4], own[k][2]), w)
            return maps[w]

        for i in range(len(own)):
            low = i + 1 if not best else int(np.searchsorted(size, -(-percent * size[i] // 100)))
            high = int(np.searchsorted(size, 100 * size[i] // percent, "right"))
            j = low + np.flatnonzero((root[low:high] != root[i]) & ((chunk[low:high] != chunk[i]) | (at[2] == at[3])))
            pairs = []
            for w in np.unique(np.minimum(width[j], width[i])).tolist():
                bits, k = folded(w), j[np.minimum(width[j], width[i]) == w]
                common = _least_common(size[i], size[k], percent)
                lacks = np.bitwise_count(bits[i] & ~bits[k]).sum(1, dtype=np.int64)
                good = lacks <= size[i] - common
                k, common, lacks = k[good], common[good], lacks[good]
                more = np.bitwise_count(bits[k] & ~bits[i]).sum(1, dtype=np.int64)
                good = more <= size[k] - common
                pairs.append((k[good], (lacks + more)[good]))
            if not pairs:
                continue
            j, score = (np.concatenate(x) for x in zip(*pairs, strict=True))
            meeting = (k for k in j[np.argsort(score, kind="stable")].tolist() if _meet(codes[i], codes[k]))
            j = np.array(list(islice(meeting, BEST if best else None)), np.int64)
            if len(j):
                out.append(np.stack([np.full(len(j), at[0]), np.minimum(member[i], member[j]), np.maximum(member[i], member[j])], 1))
        return out

    at = ["family", "name", "low", "high"]
    dealt = placed.repartition(parallelism(spark), *at).sortWithinPartitions(*at)
    return dealt.mapInArrow(run, f"family bigint, {_PAIR}")


def _in_blocks(pairs: DataFrame, payload: DataFrame, kind: str, prepare_one: Callable, agree: Callable) -> DataFrame:
    """Those of ``pairs`` (a, b) for which ``agree`` holds between what ``prepare_one`` makes of their payloads (entity, size, payload).

    A block holds one entity, that with more partners, and up to about BLOCK of its partners; each partner is read once. Pairs are
    distinct, and an entity has one payload.
    """
    spark = pairs.sparkSession
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    ends = [light(degree.select(F.col("node").alias(x), F.col("n").alias(f"n{x}")), pairs) for x in "ab"]
    both = pairs.join(ends[0], "a").join(ends[1], "b")
    first = F.col("na") >= F.col("nb")
    hub, n = F.when(first, F.col("a")).otherwise(F.col("b")), F.greatest("na", "nb")
    both = both.select(hub.alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("entity"), n.alias("n"))
    placed = both.select("hub", F.pmod(F.xxhash64("entity"), F.ceil(F.col("n") / F.lit(BLOCK))).cast("int").alias("part"), "entity")
    placed = materialise(placed, "blocks")
    wanted = placed.unionByName(placed.select("hub", "part", F.col("hub").alias("entity")).distinct())
    rows = light(wanted, placed).join(payload, "entity").select("hub", "part", (F.col("entity") != F.col("hub")).alias("partner"), "entity", "size", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            good = []
            for hub_, _, partner, entity, size, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made = prepare_one(value, size)
                if not partner:
                    own = (hub_, made)
                elif own[0] != hub_:
                    raise ValueError("an entity without a payload")
                elif agree(own[1], made):
                    good.append((min(hub_, entity), max(hub_, entity)))
            if good:
                yield _pair_batch(np.array(good, np.int64))
        trim()

    dealt = rows.repartition(parallelism(spark), "hub", "part").sortWithinPartitions("hub", "part", "partner")
    out = materialise(dealt.mapInArrow(run, _PAIR), kind)
    discard(placed)
    return out


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return 0
    at = np.searchsorted(a, b)
    return int((a[np.minimum(at, len(a) - 1)] == b).sum())


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets reach the similarity. ``texts`` has entity, size and payload (a text), one row for each entity."""

    def tokens(text: str, size: int) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        return shingle_sets(raw, np.array([0, len(raw)]), width)[0]

    def agree(a: np.ndarray, b: np.ndarray) -> bool:
        both = _shared(a, b)
        return 100 * both >= percent * (len(a) + len(b) - both)

    return _in_blocks(pairs, texts, "links", tokens, agree)


def _candidates(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose signatures (entity, size, signature) allow a link."""
    payload = signatures.select("entity", "size", F.col("signature").alias("payload"))
    return _in_blocks(pairs, payload, "candidates", lambda value, size: (value, size), lambda x, y: compatible(x[0], y[0], x[1], y[1], percent))


def join(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    if not 0 < percent <= 100:
        raise ValueError("the similarity is a percentage above 0")
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    survey = materialise(_surveyed(docs, width, percent), "survey")
    members = survey.where("kind = 0").select(F.col("x").alias("doc_id"), F.col("y").alias("n_shingles"), F.col("z").alias("entity"), "text_key")
    common = survey.where("kind = 1").groupBy("x").agg(F.sum("y").alias("n")).orderBy(F.desc("n"), "x").limit(HEAVY).collect()  # HEAVY rows at most
    heavy = np.array([r["x"] for r in common], np.int64).view(np.uint64)
    level = np.array([min(63, 2 * int(r["n"]).bit_length()) for r in common], np.int64)
    by = np.argsort(heavy)
    lists = materialise(_lists(docs, width, percent, heavy[by], level[by], bucket_count(docs, 24)), "lists")
    first = materialise(members.where("entity is not null").groupBy("entity").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "text_key")).alias("one")), "entities")
    signatures = survey.where("signature is not null").select(F.col("z").alias("entity"), F.col("y").alias("size"), "signature")
    listed = lists.select("members").mapInArrow(_members, "entity bigint").distinct()
    signatures = materialise(signatures.join(light(listed, lists), "entity", "left_semi").dropDuplicates(["entity"]), "signatures")

    def check(pairs: DataFrame) -> DataFrame:
        """The links among candidate pairs."""
        need = light(pairs.select(F.explode(F.array("a", "b")).alias("entity")).distinct(), pairs).join(first, "entity").select("entity", F.col("one.doc_id").alias("text_id"), F.col("one.text_key").alias("key"))
        need = materialise(need, "needed")
        wanted = light(need, need)
        texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["text_id"]) & (docs["text_key"] == wanted["key"])).select("entity", F.lit(0).alias("size"), F.coalesce("text", F.lit("")).alias("payload"))
        texts = materialise(texts.dropDuplicates(["entity"]), "texts")
        found = verified(pairs, texts, width, percent)
        discard(need, texts)
        return found

    families = materialise(_families(lists, signatures), "families")
    discard(lists)
    pairs = materialise(_with_smallest(families, percent), "pairs")
    tried = _candidates(pairs, signatures, percent)
    discard(pairs)
    links = check(tried)
    roots = components(links)
    known = [tried]
    best = True
    for turn in range(ROUNDS + 1):
        best = best and turn < ROUNDS
        rows = _open(families, roots)
        across = materialise(_across(rows, signatures, percent, best), "across")
        discard(rows)
        more = materialise(few(across.select("a", "b").distinct(), across).join(light(tried, *known), ["a", "b"], "left_anti"), "pairs")
        # a family without candidates has none later
        left = across.select(F.col("family").alias("name"))
        if small(across):
            families = families.join(F.broadcast(left), "name", "left_semi")
        else:
            families = families.join(materialise(left.distinct(), "families-left"), "name", "left_semi")
            discard(across)
        found = None if more.isEmpty() else check(more)
        fruitful = found is not None and not found.isEmpty()
        if fruitful:
            links = links.unionByName(found)
            roots = components(links)
        if not best:
            break
        tried, known = tried.unionByName(more), [*known, more]
        best = fruitful
    discard(signatures)
    named = first.join(roots, first["entity"] == roots["node"], "left").select("entity", "doc_id", F.coalesce("root", "entity").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    label = named.join(least, "root").select(F.col("entity").alias("e"), "component_id")
    out = members.join(label, members["entity"] == label["e"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64)))], names=["entity"])
