"""Line dedup by a suffix array over line ids.

Every line with a word is a symbol; a document is a sequence of symbols and
ends with an end of its own, and a line that occurs once is such an end too.
Symbols are numbered through all documents in their order (by doc_id), so that
``pos + h`` is the symbol h lines on.

1. Ranks. Prefix doubling gives each position the rank of its first 1, 2, 4, ...
   symbols in sorted order and goes on until no two positions share one, that is
   up to the longest run that occurs twice. Ends sort before all symbols, by
   position. A position alone with its rank keeps it and is only looked up.
   The last ranks, 0 to n - 1, are the suffix array.
2. Common prefixes. The level at which two neighbours of the suffix array part
   bounds their longest common prefix within a factor of two; the ranks of the
   levels below, looked up behind what is known to be common, give it exactly.
3. Intervals. A common prefix of fewer than ``MIN_WORDS`` words counts as none.
   Within the intervals of the suffix array that are left, each position gets the
   longest common prefix with any earlier position (by doc_id, then place): a scan
   in both directions with a stack of (length, earliest position). A partition's
   stack is all that the next one needs, and holds each length at most once.

A position with such a prefix starts a later copy; its maximal run is that whole
prefix, if no run from a line before reaches as far. With ``whole`` the lines of
all maximal runs are deleted. The registered query deletes, from each line that
starts a later copy, only as many lines as hold ``MIN_WORDS`` words, as its SQL
does, so the last lines of a copy stay where fewer words are left.

Rows are sorted by ranges of (rank, next rank, position), so a line in a third of
all documents fills many ranges. The driver sees a few numbers for each range, and
the stacks.

Defined results: null and empty texts have no lines; lines are equal if their
128-bit blake2b digests are; rows with equal id and text are one document and
get the same result; different texts under one id are different documents,
ordered by a hash of the text; null ids come first; lines without a word stay;
an empty table gives an empty result; columns of the input that are called as
the two new ones are replaced, all others stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexafact.llm.mapping import free
from hexafact.llm.session import discard, materialise, parallelism, prepare
from hexafact.llm.text import IS_SPACE, each_slice

MIN_WORDS = 10

#: Rows that one task sorts, where there are few.
TASK_ROWS = 50_000

#: Positions of the suffix array in one packed row.
CHUNK_ROWS = 1 << 17

#: Longer than any common prefix: that of a position with itself.
_ALL = 1 << 62

_LINE_SCHEMA = "doc_id bigint, doc_key bigint, place int, depth int, line_a bigint, line_b bigint"
_DEALT_SCHEMA = "part int, pos bigint, depth int, sep int, a bigint, b bigint, pair bigint, grp bigint, more boolean"
_CHUNK_SCHEMA = "at bigint, pos binary, lcp binary, low bigint, left binary, right binary"


def line_table(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, end, document and words of every line, those without a word too."""
    if not len(data):
        n = len(offs) - 1
        return offs[:-1].copy(), offs[:-1].copy(), np.arange(n), np.zeros(n, np.int64)
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offs[1:], breaks, "right")
    start = np.concatenate([offs[:-1], breaks + 1])
    doc = np.concatenate([np.arange(len(offs) - 1), owner])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    last = np.append(doc[1:] != doc[:-1], True)
    end = np.append(start[1:] - 1, 0)
    end[last] = offs[1:][doc[last]]
    solid = ~IS_SPACE[data]
    begins = np.zeros(len(data) + 1, np.int64)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offs[:-1][(offs[:-1] > 0) & (offs[:-1] < len(data))]
    first[inner] = solid[inner]
    np.cumsum(first, out=begins[1:])
    return start, end, doc, begins[end] - begins[start]


def depths(words: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Lines needed from each line on to hold ``least`` words; 0 if the document ends before. Every line has a word."""
    total = np.append(0, np.cumsum(words))
    reach = np.searchsorted(total, total[:-1] + least)
    limit = np.searchsorted(doc, doc, "right")
    return np.where(reach <= limit, reach - np.arange(len(words)), 0)


def _symbols(docs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in each_slice(batches):
            start, end, doc, words = line_table(data, offs)
            has = words > 0
            start, end, doc, words = start[has], end[has], doc[has], words[has]
            raw = data.tobytes()
            digests = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
            keys = np.frombuffer(digests, np.int64).reshape(-1, 2).T
            ids = rows.column(0).take(pa.array(doc))
            key = rows.column(1).take(pa.array(doc))
            place = (np.arange(len(doc)) - np.searchsorted(doc, doc, "left")).astype(np.int32)
            made = [pa.array(place), pa.array(depths(words, doc, least).astype(np.int32)), *(pa.array(np.ascontiguousarray(k)) for k in keys)]
            yield pa.RecordBatch.from_arrays([ids, key, *made], names=["doc_id", "doc_key", "place", "depth", "line_a", "line_b"])

    return docs.select("doc_id", "doc_key", "text").mapInArrow(run, _LINE_SCHEMA)


def ranks(counted: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Add to distinct keys with a count ``n`` how many rows sort before them: a global running total, by ranges."""
    spark = counted.sparkSession
    local = Window.partitionBy("part").orderBy(*keys)
    dealt = counted.repartitionByRange(parallelism(spark), *keys).withColumn("part", F.spark_partition_id())
    # materialised, so that both uses see one set of ranges
    dealt = materialise(dealt.sortWithinPartitions(*keys), "ranks")
    sums = sorted((r["part"], r["s"]) for r in dealt.groupBy("part").agg(F.sum("n").alias("s")).collect())
    before, total = {}, 0
    for part, s in sums:
        before[part] = total
        total += s
    if not before:
        return dealt.select(*keys, F.lit(0).cast("bigint").alias(rank))
    # a row for each partition
    offset = F.broadcast(spark.createDataFrame(list(before.items()), "part int, offset bigint"))
    own = F.sum("n").over(local.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return dealt.withColumn("own", own).join(offset, "part").select(*keys, (F.col("own") + F.col("offset")).cast("bigint").alias(rank))


def _tasks(spark: SparkSession, rows: int) -> int:
    return max(1, min(parallelism(spark), -(-rows // TASK_ROWS)))


def _read(tables: list[DataFrame]) -> DataFrame:
    """Tables of one schema as one scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(t._written_to for t in tables))


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines that occur more than once, with ``pos``: documents follow each other by doc_id and key, with a place between for the end."""
    # a line in more rows than a task should read is dealt over several, fewer in all than twice the tasks
    most = max(1, lines.count() // parallelism(lines.sparkSession))
    often = materialise(lines.groupBy("line_a", "line_b").agg(F.count("*").alias("n")).where("n > 1").select("line_a", "line_b", F.ceil(F.col("n") / most).alias("salts")), "often")
    dealt = lines.join(F.broadcast(often.where("salts > 1")), ["line_a", "line_b"], "left")
    dealt = dealt.withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("doc_id", "doc_key", "place"), "salts")).otherwise(0)).drop("salts")
    every = often.select("line_a", "line_b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    # rows with equal id and text are one document: each place once
    table = materialise(dealt.join(every, ["line_a", "line_b", "salt"], "left_semi").drop("salt").distinct(), "symbols")
    sizes = table.groupBy("doc_id", "doc_key").agg((F.max("place") + 2).cast("bigint").alias("n"))
    begins = ranks(sizes, ["doc_id", "doc_key"], "start").select(F.col("doc_id").alias("id"), F.col("doc_key").alias("key"), "start")
    same = table["doc_id"].eqNullSafe(begins["id"]) & (table["doc_key"] == begins["key"])
    out = materialise(table.join(begins, same).select("doc_id", "doc_key", "place", "depth", "line_a", "line_b", (F.col("start") + F.col("place")).alias("pos")), "positions")
    discard(often, table)
    return out


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range sorted by (a, b, pos): where each row's group (equal a) and pair (equal a and b; a null is alone) begin in it."""
    found = list(batches)
    if not sum(x.num_rows for x in found):
        return
    table = pa.Table.from_batches(found).combine_chunks()
    a, b = table["a"].to_numpy(), table["b"].fill_null(0).to_numpy()
    end = table["b"].is_null().to_numpy()
    at = np.arange(len(a))
    new_grp = np.append(True, a[1:] != a[:-1])
    new_pair = new_grp | np.append(True, (b[1:] != b[:-1]) | end[1:] | end[:-1])
    grp, pair = (np.maximum.accumulate(np.where(new, at, 0)) for new in (new_grp, new_pair))
    more = ~(new_pair & np.append(new_pair[1:], True))
    part = np.full(len(a), TaskContext.get().partitionId(), np.int32)
    names = ["part", "pos", "depth", "sep", "a", "b", "pair", "grp", "more"]
    out = pa.table([pa.array(part), *(table[c] for c in names[1:6]), pa.array(pair), pa.array(grp), pa.array(more)], names=names)
    yield from out.to_batches(max_chunksize=CHUNK_ROWS)


def _refined(rows: DataFrame, level: int, count: int) -> DataFrame:
    """pos, depth, sep, rank, shared, level for pos, depth, sep, a, b: positions of one rank ``a`` ranked by ``b``, the rank behind.

    ``sep`` is the level at which a position parted from the one before it in the suffix array, ``shared`` whether others have its rank.
    """
    spark = rows.sparkSession
    order = ["a", "b", "pos"]  # ascending: nulls first
    ranged = rows.repartitionByRange(_tasks(spark, count), *order).sortWithinPartitions(*order)
    dealt = materialise(ranged.select("pos", "depth", "sep", "a", "b").mapInArrow(_dealt, _DEALT_SCHEMA), "dealt")
    ends = dealt.groupBy("part").agg(F.count("*").alias("n"), F.min(F.struct("a", "b")).alias("head"), F.max(F.struct("a", "b", "pair", "grp")).alias("tail"))
    offset, before, carried = 0, None, []
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        head, tail = r["head"], r["tail"]
        same_grp = before is not None and before[0] == head["a"]
        same_pair = same_grp and head["b"] is not None and before[1] == head["b"]
        if same_pair:
            carried[-1][5] = True
        pair, grp = before[2] if same_pair else offset, before[3] if same_grp else offset
        carried.append([r["part"], offset, pair, grp, same_pair, False, tail["pair"]])
        before = tail["a"], tail["b"], offset + tail["pair"] if tail["pair"] else pair, offset + tail["grp"] if tail["grp"] else grp
        offset += r["n"]
    # a row for each range
    carry = F.broadcast(spark.createDataFrame(carried, "part int, offset bigint, pair0 bigint, grp0 bigint, head_more boolean, tail_more boolean, tail_pair bigint"))
    pair = F.when(F.col("pair") == 0, F.col("pair0")).otherwise(F.col("offset") + F.col("pair"))
    grp = F.when(F.col("grp") == 0, F.col("grp0")).otherwise(F.col("offset") + F.col("grp"))
    shared = F.col("more") | (F.col("head_more") & (F.col("pair") == 0)) | (F.col("tail_more") & (F.col("pair") == F.col("tail_pair")))
    # at level 0, a and b are a digest, not ranks
    rank, sep = (F.col("a") + pair - grp, F.when(pair != grp, F.lit(level - 1)).otherwise(F.col("sep"))) if level else (pair, F.lit(-1))
    out = materialise(dealt.join(carry, "part").select("pos", "depth", sep.cast("int").alias("sep"), rank.cast("bigint").alias("rank"), shared.alias("shared"), F.lit(level).alias("level")), "suffixes")
    discard(dealt)
    return out


def suffix_array(symbols: DataFrame) -> list[DataFrame]:
    """``_refined`` of each level, for pos, depth, line_a, line_b; the last level shares no rank. Level j ranks by 2 to the j symbols."""
    rows = symbols.select("pos", "depth", F.lit(-1).alias("sep"), F.col("line_a").alias("a"), F.col("line_b").alias("b"))
    levels, count = [], symbols.count()
    while count:
        levels.append(_refined(rows, len(levels), count))
        j = len(levels) - 1
        behind = _read(levels).where(~F.col("shared") | (F.col("level") == j)).select((F.col("pos") - (1 << j)).alias("pos"), F.col("rank").alias("b"))
        rows = levels[-1].where("shared").select("pos", "depth", "sep", F.col("rank").alias("a")).join(behind, "pos", "left")
        count = levels[-1].where("shared").count()
    return levels


def common_prefixes(levels: list[DataFrame]) -> DataFrame:
    """rank, pos, lcp: the suffix array, with each position's common prefix with the one before, 0 if it is shorter than ``depth``."""
    array = _read(levels).where(~F.col("shared"))
    # parted at level j: 2**j to 2**(j + 1) - 1 symbols in common; at level 0, one
    open_ = array.where("sep > 0 and depth > 0 and depth < shiftleft(2L, sep)").select("rank", "sep", F.col("pos").alias("right"))
    known = array.select((F.col("rank") + 1).alias("rank"), F.col("pos").alias("left"))
    pairs = materialise(open_.join(known, "rank").withColumn("lcp", F.expr("shiftleft(1L, sep)")), "neighbours")
    done = pairs.where("false")
    for j in range(len(levels) - 3, -1, -1):
        here = levels[j].where("shared")
        lefts, rights = (here.select(F.col("pos").alias(f"{x}_at"), F.col("rank").alias(f"{x}_rank")) for x in "lr")
        both = done.unionByName(pairs.where(F.col("sep") == j + 1)).withColumn("l_at", F.col("left") + F.col("lcp")).withColumn("r_at", F.col("right") + F.col("lcp"))
        both = both.join(lefts, "l_at", "left").join(rights, "r_at", "left")
        longer = F.when(F.col("l_rank") == F.col("r_rank"), F.lit(1 << j)).otherwise(0)
        last, done = done, materialise(both.select("rank", "sep", "right", "left", (F.col("lcp") + longer).cast("bigint").alias("lcp")), "neighbours")
        if hasattr(last, "_written_to"):
            discard(last)
    found = array.join(done.select("rank", F.col("lcp").alias("long")), "rank", "left")
    lcp = F.coalesce("long", F.when(F.col("sep") == 0, F.lit(1)).otherwise(0))
    return found.select("rank", "pos", F.when((F.col("depth") > 0) & (lcp >= F.col("depth")), lcp).otherwise(0).cast("bigint").alias("lcp"))


def _cut(stack: list[tuple[int, int]], low: int) -> None:
    """Pass a common prefix of ``low``: no entry is longer from here. Entries are (length, earliest position), both rising."""
    if not low:
        stack.clear()
        return
    first = None
    while stack and stack[-1][0] >= low:
        first = stack.pop()[1]
    if first is not None:
        stack.append((low, first))


def _earlier(stack: list[tuple[int, int]], pos: int) -> int:
    """The longest common prefix of ``pos`` with an earlier position of the stack, which ``pos`` then joins."""
    while stack and stack[-1][1] > pos:
        stack.pop()
    best = stack[-1][0] if stack else 0
    stack.append((_ALL, pos))
    return best


def previous(pos: np.ndarray, lcp: np.ndarray, left: list[tuple[int, int]], right: list[tuple[int, int]]) -> list[int]:
    """Longest common prefix with any earlier position, for a stretch of the suffix array between two stacks, which are moved past it."""
    at, low = pos.tolist(), lcp.tolist()
    best = []
    for p, n in zip(at, low, strict=True):
        _cut(left, n)
        best.append(_earlier(left, p))
    for k in range(len(at) - 1, -1, -1):
        best[k] = max(best[k], _earlier(right, at[k]))
        _cut(right, low[k])
    return best


def _moved(incoming: list[tuple[int, int]], low: int, own: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stack behind a stretch with the least common prefix ``low`` and, from empty, the stack ``own``."""
    incoming = list(incoming)
    _cut(incoming, low)
    out, first = [], None
    for n, p in sorted([*incoming, *own], key=lambda e: (-e[0], e[1])):
        if first is None or p < first:
            out.append((n, p))
            first = p
    return out[::-1]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = list(batches)
    if not sum(x.num_rows for x in found):
        return
    table = pa.Table.from_batches(found).combine_chunks()
    rank, pos, lcp = (table[c].to_numpy() for c in ("rank", "pos", "lcp"))
    for a in range(0, len(pos), CHUNK_ROWS):
        p, n = pos[a : a + CHUNK_ROWS], lcp[a : a + CHUNK_ROWS]
        left, right = [], []
        previous(p, n, left, right)
        row = [int(rank[a]), p.tobytes(), n.tobytes(), int(n.min()), *(np.array(x, np.int64).tobytes() for x in (left, right))]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["at", "pos", "lcp", "low", "left", "right"])


def _stack(raw: bytes) -> list[tuple[int, int]]:
    return [tuple(x) for x in np.frombuffer(raw, np.int64).reshape(-1, 2).tolist()]


def longest_previous(array: DataFrame, count: int) -> DataFrame:
    """pos, length: the longest common prefix of each position with an earlier one, where there is any, for ``common_prefixes``."""
    ranged = array.repartitionByRange(_tasks(array.sparkSession, count), "rank").sortWithinPartitions("rank")
    chunks = materialise(ranged.select("rank", "pos", "lcp").mapInArrow(_packed, _CHUNK_SCHEMA), "chunks")
    seams = [(r["at"], r["low"], _stack(r["left"]), _stack(r["right"])) for r in sorted(chunks.select("at", "low", "left", "right").collect(), key=lambda r: r["at"])]
    lefts, rights, stack = {}, {}, []
    for at, low, own, _ in seams:
        lefts[at] = stack
        stack = _moved(stack, low, own)
    stack = []
    for at, low, _, own in reversed(seams):
        rights[at] = stack
        stack = _moved(stack, low, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at, raw_pos, raw_lcp in zip(*(rows.column(c).to_pylist() for c in range(3)), strict=True):
                pos, lcp = np.frombuffer(raw_pos, np.int64), np.frombuffer(raw_lcp, np.int64)
                best = np.array(previous(pos, lcp, list(lefts[at]), list(rights[at])), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pos[best > 0]), pa.array(best[best > 0])], names=["pos", "length"])

    found = materialise(chunks.select("at", "pos", "lcp").mapInArrow(run, "pos bigint, length bigint"), "runs")
    discard(chunks)
    return found


def later_copies(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, doc_key, place, depth, length, maximal: for each place that starts a later copy of ``least`` words, the lines that hold these,
    the lines of its longest copy, and whether no copy from the place before reaches as far. ``docs`` has doc_id, doc_key, text."""
    lines = materialise(_symbols(docs, least), "lines")
    table = _numbered(lines)
    discard(lines)
    levels = suffix_array(table.select("pos", "depth", "line_a", "line_b"))
    if not levels:
        return table.select("doc_id", "doc_key", "place", "depth", F.col("depth").alias("length"), F.lit(True).alias("maximal"))
    found = longest_previous(common_prefixes(levels), table.count())
    discard(*levels)
    runs = table.select("doc_id", "doc_key", "place", "depth", "pos").join(found, "pos")
    reach = F.col("place") + F.col("length")
    ahead = F.lag(reach).over(Window.partitionBy("doc_id", "doc_key").orderBy("place"))
    return runs.select("doc_id", "doc_key", "place", "depth", F.col("length").cast("int").alias("length"), F.coalesce(ahead < reach, F.lit(True)).alias("maximal"))


def dedup(docs: DataFrame, least: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text`` (with ``whole``, to their last line), and the columns n_lines and n_removed."""
    prepare(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    key, run_id, run_key, places, depths_ = (free(names, c) for c in ("doc_key", "run_id", "run_key", "places", "depths"))
    keyed = docs.select(*(f"`{c}`" for c in names), F.xxhash64("text").alias(key))
    runs = later_copies(keyed.select("doc_id", F.col(key).alias("doc_key"), "text"), least)
    if whole:
        runs = runs.where("maximal").withColumn("depth", F.col("length"))
    runs = runs.groupBy("doc_id", "doc_key").agg(F.collect_list(F.struct("place", "depth")).alias("runs"))
    runs = runs.select(F.col("doc_id").alias(run_id), F.col("doc_key").alias(run_key), F.col("runs.place").alias(places), F.col("runs.depth").alias(depths_))
    same = keyed["doc_id"].eqNullSafe(runs[run_id]) & (keyed[key] == runs[run_key])
    joined = keyed.join(runs, same, "left").select(*(f"`{c}`" for c in names), places, depths_)
    schema = T.StructType([f for f in joined.schema.fields if f.name in names] + [T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in each_slice(batches):
            start, end, doc, words = line_table(data, offs)
            bounds = np.searchsorted(doc, np.arange(len(offs)))
            raw = data.tobytes()
            texts, removed = rows.column(names.index("text")).to_pylist(), []
            begins, lengths = (rows.column(rows.schema.get_field_index(c)).to_pylist() for c in (places, depths_))
            for d, (p, n) in enumerate(zip(begins, lengths, strict=True)):
                if not p:
                    removed.append(0)
                    continue
                a, b = bounds[d], bounds[d + 1]
                symbol = a + np.flatnonzero(words[a:b] > 0)
                gone = np.zeros(len(symbol) + 1, np.int64)
                np.add.at(gone, p, 1)
                np.add.at(gone, np.array(p) + n, -1)
                out = symbol[np.cumsum(gone[:-1]) > 0]
                keep = np.ones(b - a, bool)
                keep[out - a] = False
                texts[d] = b"\n".join([raw[start[x] : end[x]] for x in np.flatnonzero(keep) + a]).decode("utf-8", "surrogatepass")
                removed.append(len(out))
            columns = [rows.column(rows.schema.get_field_index(c)) if c != "text" else pa.array(texts, pa.string()) for c in names]
            count = np.bincount(doc[words > 0], minlength=len(offs) - 1)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count.astype(np.int64)), pa.array(removed, pa.int64())], names=[*names, "n_lines", "n_removed"])

    return joined.mapInArrow(run, schema)
