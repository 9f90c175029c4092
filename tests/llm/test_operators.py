"""Each operator against brute force, over texts with every awkward case."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from hexafact.llm import bpe, jaccard, lines, mixing, neighbours, passages, quality, queries, session, sharding, simhash, stages, suffixes, toxicity
from hexafact.llm import components as stars
from hexafact.llm.components import components
from hexafact.llm.text import utf8

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_lines string, fingerprint int, mix_epoch string"


def corpus(seed=1, n=70):
    """Random texts, copies, near copies, shared passages and lines, nulls, blanks, one very long text, odd characters."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefghé日", k=rnd.randint(2, 7))) for _ in range(400)]
    say = lambda k: " ".join(rnd.choices(words, k=k))
    passage, line = say(60), say(12)
    out = []
    for i in range(n):
        t = "\n".join(say(rnd.randint(1, 40)) for _ in range(rnd.randint(1, 5)))
        kind = i % 7
        if kind == 1:
            t = f"{t} {passage} {say(5)}"
        if kind == 2:
            t = f"{t}\n{line}\n{say(3)}"
        if kind == 3 and out and out[-2]:
            t = out[-2]
        if kind == 4 and out and out[-3]:
            w = out[-3].split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        out.append(t)
    out += [None, "", " \t\n", "x", "one two", "a\r\n\x0b b   c", say(3000), "'s don't I'LL 12 ٣ 🙂  \n ", "same same same " * 30, line, line]
    return out


def frame(spark, texts):
    rows = [(i, t, "ab"[i % 2] if i % 9 else None, f"s{i % 3}" if i % 11 else None, len(t or ""), 1.0, "x", 3, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df):
    rows = df.collect()
    out = {r["doc_id"]: r.asDict() for r in rows}
    assert len(out) == len(rows)
    return out


def test_utf8_of_slices():
    import pyarrow as pa

    data, offs = utf8(pa.array(["ab", None, "é"]).slice(1))
    assert data.tobytes() == "é".encode() and offs.tolist() == [0, 0, 2]


def test_simhash(spark, docs, texts, empty):
    got = by_id(neighbours.with_next(docs, 3, queries._edited, "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"))
    plain = by_id(simhash.fingerprint(docs, keep=["doc_id"]))
    for i, t in enumerate(texts):
        t, f = t or "", texts[(i + 1) % len(texts)] or ""
        k = len(t) // 4
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + f[:k]).encode()).hexdigest()
        assert got[i]["fingerprint"] == plain[i]["fingerprint"]
        assert got[i]["next_fingerprint"] == plain[(i + 1) % len(texts)]["fingerprint"]
    fps = {int(p["fingerprint"], 16) for p in plain.values()}
    within = {int(r["fingerprint"], 16): r["n_within"] for r in simhash.search(spark.createDataFrame([(p["fingerprint"],) for p in plain.values()], "fingerprint string"), spark.createDataFrame([(p["fingerprint"],) for p in list(plain.values())[:20]], "fingerprint string"), 9).collect()}
    for f, n in within.items():
        assert n == sum((f ^ x).bit_count() <= 9 for x in fps)
    assert neighbours.with_next(empty, 3, queries._edited, "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string").count() == 0
    like = spark.createDataFrame([("f" * 32, "f" * 31 + "0")], "a string, b string").select(simhash.likeness("a", "b").alias("x")).first()["x"]
    assert like == 1 - 4 / 128


def test_search_in_a_crowded_bucket(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    stored = [f"{i:032x}" for i in range(60)]
    got = {r["fingerprint"]: r["n_within"] for r in simhash.search(spark.createDataFrame([(s,) for s in stored], "fingerprint string"), spark.createDataFrame([(s,) for s in stored[:5]], "fingerprint string"), 2).collect()}
    assert got == {s: sum((int(s, 16) ^ int(x, 16)).bit_count() <= 2 for x in stored) for s in stored[:5]}


def test_matches_of_simhash(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rnd = random.Random(3)
    base = [rnd.getrandbits(128) for _ in range(6)]
    stored = []
    for i in range(150):
        x = rnd.choice(base)
        for b in rnd.sample(range(128), rnd.choice([0, 0, 1, 3, 9, 20, 21, 24])):
            x ^= 1 << b
        stored.append((i, f"{x:032x}"))
    df = spark.createDataFrame(stored, "doc_id long, fingerprint string")
    ids = {}
    for i, f in stored:
        ids.setdefault(f, []).append(i)
    for radius in (0, 1, 2, 3, 20, 31):
        got = {r["fingerprint"]: {(f["fingerprint"], f["doc_id"], f["n_docs"], f["distance"]) for f in r["found"]} for r in simhash.matches(df, df.where("doc_id < 40"), radius).collect()}
        apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
        assert got == {a: {(b, min(o), len(o), apart(a, b)) for b, o in ids.items() if apart(a, b) <= radius} for a in {f for i, f in stored if i < 40}}, radius
    asked = df.where("doc_id = 0")
    assert simhash.pairs(df, asked).count() == simhash.search(df, asked).first()["n_within"]


def test_simhash_radius_reaches_near_copies(spark):
    rnd = random.Random(12)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(3, 7))) for _ in range(2000)]
    rows = []
    for i in range(0, 80, 2):
        w = rnd.choices(words, k=300)
        rows.append((i, " ".join(w)))
        for k in rnd.sample(range(0, 300, 5), 5):
            w[k] = "changed"
        rows.append((i + 1, " ".join(w)))
    prints = simhash.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"]).persist()
    within = {r["fingerprint"]: {f["doc_id"] for f in r["found"]} for r in simhash.matches(prints, prints).collect()}
    assert all(within[r["fingerprint"]] == {r["doc_id"], r["doc_id"] ^ 1} for r in prints.collect())


def test_bpe(docs, texts, empty):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(queries.bpe_digests(docs))
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert queries.bpe_digests(empty).count() == 0
    rnd = random.Random(5)
    vocabulary = bpe.load(open(path, "rb").read())
    parts = ["'", "'s", "'re", "'ll", " ", "  ", "\n", "　", "\x1c", "\x85", "a", "é", "日本", "12", "!", "🙂", "́", "'S", "\x00", "zzq"]
    many = ["".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(3000)] + ["a" * 3000, "ß" * 500]
    raw = [m.encode() for m in many]
    flat, bound = vocabulary.encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
    for m, a, b in zip(many, bound[:-1], bound[1:], strict=True):
        assert flat[a:b].tolist() == reference.encode_ordinary(m), repr(m)
    with pytest.raises(ValueError):
        vocabulary.decode(np.array([50256]))


def test_suffix_removal(spark, texts, docs, empty):
    for width, gram in ((200, 32), (24, 8)):
        got = by_id(suffixes.remove(docs, width, gram))
        raw = [(t or "").encode() for t in texts]
        count = Counter(b[k : k + width] for b in raw for k in range(len(b) - width + 1))
        for i, b in enumerate(raw):
            gone = np.zeros(len(b), bool)
            for k in range(len(b) - width + 1):
                if count[b[k : k + width]] > 1:
                    gone[k : k + width] = True
            spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
            assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(b), int(gone.sum()), spans)
            assert bytes(got[i]["kept"]) == np.frombuffer(b, np.uint8)[~gone].tobytes()
    assert suffixes.remove(empty).count() == 0


def test_suffix_sort_and_collisions():
    rnd = random.Random(2)
    raw = "".join(rnd.choices("ab", k=400)).encode()
    data = np.frombuffer(raw, np.uint8)
    begin = np.arange(300)
    size, group = np.minimum(90, 400 - begin), begin % 3
    s = suffixes.SuffixSort(data, begin, size, group)
    for g in range(3):
        own = [i for i in s.order.tolist() if group[i] == g]
        assert [raw[b : b + size[b]] for b in own] == sorted(raw[b : b + size[b]] for b in own)
    left, right = np.minimum(begin, 10), np.minimum(30, 400 - begin)
    hashed = suffixes.outermost(data, begin, left, right, group, 20)
    far, near = suffixes._compared(data, begin, left, right, 20)
    grouped = [suffixes._compared(data, begin[group == g], left[group == g], right[group == g], 20) for g in range(3)]
    assert len(far) == len(near) == 300
    for g in range(3):
        at = np.flatnonzero(group == g)
        own = {i: (f, n) for i, f, n in zip(*map(np.ndarray.tolist, hashed), strict=True) if group[i] == g}
        for j, i in enumerate(at.tolist()):
            assert own.get(i, (-1, 21)) == (grouped[g][0][j], grouped[g][1][j])


def test_sharding(docs, texts, empty):
    got = by_id(sharding.shard(docs, 4, sample=500, ranges_per_shard=8))
    for i, t in enumerate(texts):
        b = (t or "").encode()
        assert got[i]["size"] == len(b) + 8 and got[i]["text_crc32"] == zlib.crc32(b)
    slots = {}
    for r in got.values():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    assert sharding.shard(empty, 4).count() == 0


def test_sharding_divides_a_hot_group(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('same ', 20), repeat(cast(id as string), 20)) as text")
    sizes = Counter()
    for r in sharding.shard(df, 6, sample=4000, ranges_per_shard=32).collect():
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) < 1.1 * min(sizes.values()) and len(sizes) == 6


def test_quality_counts(docs, texts, empty):
    got = by_id(quality.measure(docs, ["doc_id"]))
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        three = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = [any(three[tuple(w[k : k + 3])] > 1 for k in range(max(0, j - 2), min(j, len(w) - 3) + 1)) for j in range(len(w))]
        own = [x for x in t.split("\n") if WORD.search(x)]
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), sum(covered))
    assert quality.measure(empty, ["doc_id"]).count() == 0


def test_certified_cutoffs(spark):
    from math import comb

    assert quality.tail(3, 50, 0.1) == pytest.approx(sum(comb(50, k) * 0.1**k * 0.9 ** (50 - k) for k in range(4)))
    counts = ", ".join(f"{c} long" for c in quality.COUNTS)
    rows = [(f"s{i % 2}", int(i % 5 > 0), *([100, 500, 0 if i % 5 else 300, 0, 0, 5, 0, 400, 0])) for i in range(6000)]
    found = quality.cutoffs(spark.createDataFrame(rows, f"lang string, quality int, {counts}"), "lang")
    assert set(found) == {"s0", "s1"} and all("symbols" in f and f["symbols"] < 3 for f in found.values())
    few = spark.createDataFrame(rows[:40], f"lang string, quality int, {counts}")
    assert quality.cutoffs(few, "lang") == {"s0": {}, "s1": {}}
    assert few.where(quality.verdict({}, "lang")).count() == 40


def test_toxicity(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 6))) for _ in range(300)]
    bad = ["scoundrel", "villainous", "rascalish"]
    rows, marks = [], []
    for i in range(900):
        w = rnd.choices(words, k=rnd.randint(30, 120))
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            w[rnd.randrange(len(w))] = rnd.choice(bad)
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    rows += [(900, None), (901, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where("doc_id % 3 > 0"))
    got = by_id(toxicity.score(docs, model, keep=["doc_id"]))
    held = [(got[i]["score"] >= 0.5) == bool(t) for i, t in marks if i % 3 == 0]
    assert sum(held) > 0.95 * len(held)
    assert got[900]["score"] == got[901]["score"] and all(0 <= g["score"] <= 1 for g in got.values())
    alike = toxicity.train(docs, labels.where("toxic = 0"))
    assert len({r["score"] for r in toxicity.score(docs, alike).collect()}) == 1
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_toxic_phrases_of_common_words(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(3, 6))) for _ in range(300)]
    phrases = [" ".join(rnd.choices(words, k=8)) for _ in range(3)]
    rows, marks = [], []
    for i in range(900):
        w = rnd.choices(words, k=rnd.randint(60, 120))
        if i % 3 == 0:
            for phrase in phrases:
                w.insert(rnd.randrange(len(w)), phrase)
        rows.append((i, " ".join(w)))
        marks.append((i, int(i % 3 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where("doc_id % 5 > 0"))
    assert not set(model.marked[len(model.ordinary) :].decode().split()) and model.toxic != model.ordinary
    got = by_id(toxicity.score(docs, model, keep=["doc_id"]))
    held = [(got[i]["score"] >= 0.5) == bool(t) for i, t in marks if i % 5 == 0]
    assert sum(held) > 0.95 * len(held)


def test_line_dedup(docs, texts, empty):
    got = by_id(lines.dedup(docs))
    first = set()
    for i, t in enumerate(texts):
        every = (t or "").split("\n")
        at = [k for k, x in enumerate(every) if WORD.search(x)]
        gone = set()
        for a in range(len(at)):
            n, k = 0, 0
            while a + k < len(at) and n < lines.MIN_WORDS:
                n += len(WORD.findall(every[at[a + k]]))
                k += 1
            if n < lines.MIN_WORDS:
                continue
            key = tuple(every[x] for x in at[a : a + k])
            if key in first:
                gone.update(at[a : a + k])
            first.add(key)
        assert (got[i]["n_lines"], got[i]["n_removed"]) == (len(at), len(gone)), i
        assert got[i]["text"] == (None if t is None else "\n".join(x for k, x in enumerate(every) if k not in gone)) or (t is None and not got[i]["text"])
    assert set(got[0]) >= {"lang", "source", "score"}
    assert lines.dedup(empty).count() == 0


def test_line_dedup_of_whole_runs(spark, texts):
    one, two, three = " ".join("abcdefghijklmnopqrst"), "u v w x y", "k l m n o p q r s t"
    rnd = random.Random(6)
    short = [" ".join(rnd.choices("abcdefgh", k=rnd.randint(1, 9))) for _ in range(12)]
    many = [*texts, f"{one}\n{two}", f"{one}\n{two}", f"{three}\none more line\nunlike", f"{three}\none more line\nother text here", *("\n".join(short[a : a + n]) for a, n in zip(rnd.choices(range(8), k=60), rnd.choices(range(1, 9), k=60), strict=True))]
    got = by_id(lines.dedup(spark.createDataFrame(list(enumerate(many)), "doc_id long, text string"), whole=True))
    first = set()
    for i, t in enumerate(many):
        every = (t or "").split("\n")
        at = [k for k, x in enumerate(every) if WORD.search(x)]
        gone = set()
        for a in range(len(at)):
            for b in range(a + 1, len(at) + 1):
                key = tuple(every[x] for x in at[a:b])
                if sum(len(WORD.findall(x)) for x in key) >= lines.MIN_WORDS:
                    if key in first:
                        gone.update(at[a:b])
                    first.add(key)
        assert (got[i]["n_lines"], got[i]["n_removed"]) == (len(at), len(gone)), i
        assert (got[i]["text"] or "") == "\n".join(x for k, x in enumerate(every) if k not in gone), i


def test_longest_copies_of_lines(spark, monkeypatch):
    """Ranks go to the longest run, over many ranges; each place that starts a later copy has its longest one."""
    monkeypatch.setattr(lines, "TASK_ROWS", 40)
    rnd = random.Random(8)
    long = [" ".join(rnd.choices("abcdefgh", k=rnd.randint(1, 6))) for _ in range(41)]
    every = [long, ["start", *long], long[3:30] + ["unlike this"] + long[20:], ["x y z"] * 37, ["other"] + ["x y z"] * 20, long[:9] + ["x y z"] * 5]
    every += [rnd.choices(long[:4], k=rnd.randint(1, 12)) for _ in range(12)]
    docs = spark.createDataFrame([(i, 0, "\n".join(t)) for i, t in enumerate(every)], "doc_id long, doc_key long, text string")
    got = {(r["doc_id"], r["place"]): (r["length"], r["depth"], r["maximal"]) for r in lines.later_copies(docs).collect()}
    ends = [t + [i] for i, t in enumerate(every)]
    places = [(i, p) for i, t in enumerate(every) for p in range(len(t))]
    want, ahead = {}, {}
    for k, (i, p) in enumerate(places):
        n = max((next(m for m in range(99) if ends[i][p + m] != ends[j][q + m] or isinstance(ends[i][p + m], int) or isinstance(ends[j][q + m], int)) for j, q in places[:k]), default=0)
        words = [sum(len(x.split()) for x in every[i][p : p + m]) for m in range(n + 1)]
        if words[n] >= lines.MIN_WORDS:
            want[i, p] = (n, next(m for m in range(n + 1) if words[m] >= lines.MIN_WORDS), ahead.get(i, -1) < p + n)
            ahead[i] = p + n
    assert got == want
    assert max(n for n, _, _ in got.values()) == 41 and sum(m for _, _, m in got.values()) < len(got)
    levels = lines.suffix_array(spark.createDataFrame([(p, 0, ord(x), 0) for p, x in enumerate("mississippi" * 5)], "pos long, depth int, line_a long, line_b long"))
    text = "mississippi" * 5
    assert len(levels) == 7  # the longest run that occurs twice has 44 letters
    ranks = {r["pos"]: r["rank"] for level in levels for r in level.where("not shared").collect()}
    assert sorted(ranks, key=ranks.get) == sorted(range(55), key=lambda p: text[p:])


def test_stacks_between_stretches():
    """A scan in stretches with the stacks between them finds what the whole scan and brute force find."""
    rnd = random.Random(9)
    for size in (1, 2, 5, 200):
        pos = np.array(rnd.sample(range(1000), size))
        lcp = np.array([0] + [rnd.choice([0, 1, 2, 3, 5, 8]) for _ in range(size - 1)])
        both = lambda a, b: int(lcp[min(a, b) + 1 : max(a, b) + 1].min())
        brute = [max((both(a, b) for b in range(size) if pos[b] < pos[a]), default=0) for a in range(size)]
        assert lines.previous(pos, lcp, [], []) == brute
        parts = [(pos[a : a + 7], lcp[a : a + 7]) for a in range(0, size, 7)]
        own = []
        for p, n in parts:
            own.append(([], []))
            lines.previous(p, n, *own[-1])
        lefts, rights = [[]], [[]]
        for k in range(len(parts) - 1):
            lefts.append(lines._moved(lefts[-1], int(parts[k][1].min()), own[k][0]))
            rights.insert(0, lines._moved(rights[0], int(parts[-1 - k][1].min()), own[-1 - k][1]))
        assert [x for (p, n), a, b in zip(parts, lefts, rights, strict=True) for x in lines.previous(p, n, list(a), list(b))] == brute


@pytest.mark.parametrize("width", [50, 12, 5])
def test_passages(docs, texts, empty, width):
    got = by_id(passages.remove(docs, width))
    first = {}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first.setdefault(tuple(w[k : k + width]), i) < i:
                gone[k : k + width] = [True] * width
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    assert passages.remove(empty, width).count() == 0


def test_covers():
    for period, cover in passages.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_mixing(docs, texts, empty):
    tokens = {"a": 1000, "b": 100, "c": 10, None: 0}
    flat, natural = mixing.weights(tokens, 0), mixing.weights(tokens, 1)
    assert len(set(flat.values())) == 1 and natural["a"] == pytest.approx(1000 / 1110)
    own = {s.source: s for s in mixing.plan(tokens, max_repeats=3)}
    repeats = {s: (x.epochs * x.tokens + x.rest) / x.tokens for s, x in own.items() if x.tokens}
    assert min(repeats.values()) == pytest.approx(1) and max(repeats.values()) == pytest.approx(3)
    goal = mixing.solve(tokens, 0.7, None, None)
    assert mixing.entropy(mixing.weights(tokens, goal)) == pytest.approx(0.7, abs=1e-6)
    rows = mixing.mix(docs).collect()
    copies = Counter(r["doc_id"] for r in rows)
    assert set(copies) == set(range(len(texts))) and max(copies.values()) <= 3
    half = mixing.mix(docs, max_repeats=None, budget=sum(len(WORD.findall(t or "")) for t in texts) / 2, target_entropy=0.99).collect()
    assert 0 < len(half) < len(texts)
    assert mixing.mix(empty).count() == 0


def similar(texts, width=5, percent=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_jaccard(spark, docs, texts, empty):
    got = by_id(jaccard.join(docs))
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == similar(texts)
    assert jaccard.join(empty).count() == 0


def test_jaccard_of_chained_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 16)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    many = []
    for i in range(90):
        w = list(base)
        for k in rnd.sample(range(60), rnd.choice([0, 1, 1, 2, 5])):
            w[k] = f"x{rnd.randrange(1000)}"
        many.append(" ".join(w))
        base = w if i % 10 == 9 else base
    df = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")
    got = by_id(jaccard.join(df))
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(many))] == similar(many)


def test_jaccard_of_long_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    rnd = random.Random(21)
    words = [f"v{i}" for i in range(4000)]
    many = []
    for g in range(3):
        base = rnd.choices(words, k=5000)
        for edits in (0, 40, 60, 90, 130, 600):
            w = list(base)
            for k in rnd.sample(range(5000), edits):
                w[k] = f"e{rnd.randrange(10**6)}"
            many.append(" ".join(w))
    got = by_id(jaccard.join(spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")))
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(many))] == similar(many)


def chained(seed):
    """90 near copies, each ten of them from a copy of the ten before."""
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    many = []
    for i in range(90):
        w = list(base)
        for k in rnd.sample(range(60), rnd.choice([0, 1, 1, 2, 5])):
            w[k] = f"x{rnd.randrange(1000)}"
        many.append(" ".join(w))
        base = w if i % 10 == 9 else base
    return many


@pytest.mark.parametrize("chunk", [16, 2048])
def test_jaccard_of_tables_too_large_to_broadcast(spark, monkeypatch, chunk):
    monkeypatch.setattr(session, "SMALL_BYTES", -1)
    monkeypatch.setattr(stars, "FEW", -1)
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    many = chained(9)
    got = by_id(jaccard.join(spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")))
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(many))] == similar(many)


def test_jaccard_takes_few_tasks(spark):
    """Small tables are not exchanged: with hundreds of partitions, each exchange costs as many tasks, however few its rows."""
    many = chained(8)
    df = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    tracker = spark.sparkContext.statusTracker()
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set(merge, "false")
    spark.sparkContext.setJobGroup("few-tasks", "tasks of op10")
    try:
        got = by_id(jaccard.join(df))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset(merge)
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(many))] == similar(many)
    stages = [tracker.getStageInfo(s) for s in {s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds}]
    done = sum(s.numCompletedTasks for s in stages if s)
    assert 0 < done < 1800


def test_components_of_few_and_many_edges(spark, monkeypatch):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(160)] + [(-(1 << 62), 5), (7, 7), (299, 1 << 62)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = [sorted(components(df).collect()), sorted(components(df.where("a = b")).collect())]
    monkeypatch.setattr(stars, "FEW", -1)
    assert found == [sorted(components(df).collect()), []]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_repeated_rows(spark):
    rows = [(1, "a b c d e f " * 20), (1, "a b c d e f " * 20), (2, "other words here " * 20), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(1))
    assert lines.dedup(df).count() == 4
    assert jaccard.join(df).count() == 4
    assert passages.remove(df).count() == 4
    assert suffixes.remove(df).count() == 4
    assert sharding.shard(df, 3).count() == 4
    assert queries.bpe_digests(df).count() == 4
    assert mixing.mix(df).count() >= 4


def test_repeated_rows_of_short_lines(spark):
    short = "\n".join(f"{a} {a}x {a}y" for a in "abcdefgh")
    rows = [(1, short), (1, short), (2, f"start\n{short}\nend"), (3, "unlike"), (None, short), (None, short)]
    for whole in (False, True):
        got = {(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), whole=whole).collect()}
        # documents with null ids come first
        assert {(d, n, k) for d, _, n, k in got} == {(None, 8, 0), (1, 8, 8), (2, 10, 8), (3, 1, 0)}
        assert {t for d, t, _, _ in got if d == 1} == {""} and {t for d, t, _, _ in got if d == 2} == {"start\nend"}


def test_stages_keep_columns(spark, docs):
    """Whatever the other columns are called, they pass unchanged."""
    more = docs
    for c in ("runs", "doc_key", "places", "depths", "run_doc_id", "rest_of_row", "n_removed", "mix_x", "label", "kept_doc_id", "entity", "component_id", "mix_block"):
        more = more.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    before = {r["doc_id"]: {k: v for k, v in r.asDict().items() if k not in ("text", "n_chars")} for r in more.collect()}
    for stage in (stages.without_repeated_lines, stages.without_near_copies, stages.mixed, lambda s, d, _: stages.without_toxic(s, d, "/root/testdata/sf0.001")):
        out = stage(spark, more, "")
        assert out.columns == more.columns and out.dtypes == more.dtypes
        for r in out.collect():
            assert {k: v for k, v in r.asDict().items() if k not in ("text", "n_chars")} == before[r["doc_id"]]


def thue_morse(n):
    """Two texts of 2**n letters whose polynomial hashes modulo 2**64 are equal for every odd base."""
    a = "".join("ab"[k.bit_count() & 1] for k in range(1 << n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_hashes_of_structured_texts(spark):
    one, two = thue_morse(11)
    rest = [f"w{k}" for k in range(49)]
    rows = [(0, " ".join([*rest, one])), (1, " ".join([*rest, two])), (2, " ".join([*rest[:4], one])), (3, " ".join([*rest[:4], two])),
            (4, f"{one}\n{two}"), (5, "\n".join([" ".join(rest[:9]), one])), (6, "\n".join([" ".join(rest[:9]), two]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["n_removed"] for r in passages.remove(df).collect()} == {0}
    joined = {r["doc_id"]: r["component_id"] for r in jaccard.join(df).collect()}
    assert joined[2] == 2 and joined[3] == 3
    assert {r["n_dup_lines"] for r in quality.measure(df, ["doc_id"]).collect()} == {0}
    assert {r["n_removed"] for r in lines.dedup(df).collect()} == {0}
    letters = [" ".join(thue_morse(11)[k]) for k in (0, 1)]
    got = [r["n_removed"] for r in lines.dedup(spark.createDataFrame(list(enumerate(letters)), "doc_id long, text string")).collect()]
    assert got == [0, 0]


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    source = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = out.collect()
    assert rows and {r["doc_id"] for r in rows} <= source and len(corpus_pipeline.STAGES) == 5
