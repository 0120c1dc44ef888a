"""Operators over the corpus, against brute force and planted cases."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from planproof.llm import bagminhash as bm
from planproof.llm import decontam, lm_scoring, packing, quality, toxicity, training_order
from planproof.llm.tokens import default_path, word_ids

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def corpus(rnd, n, words=60):
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    return [" ".join(rnd.choice(vocabulary) for _ in range(words)) for _ in range(n)]


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def bag(t):
    w = re.findall(r"\w+", (t or "").lower())
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 0


def brute_groups(texts):
    bags, root = [bag(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


# ------------------------------------------------------------------ BagMinHash


def test_signature_estimates_weighted_jaccard():
    rnd = np.random.default_rng(1)
    h = rnd.integers(0, 1 << 47, 60).astype(np.uint64)
    h.sort()
    a, b = rnd.integers(1, 40, 60), rnd.integers(1, 40, 60)
    doc = np.repeat([0, 1], 60)
    sig = bm.signatures(doc, np.concatenate([h, h]), np.concatenate([a, b]), 2, m=4096)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03 and (sig != 0).all()
    one = bm.signatures(doc[:60], h, a, 1, m=128)
    both = bm.signatures(doc, np.concatenate([h, h]), np.concatenate([a, b]), 2, m=128)
    assert (one[0] == both[0]).all()


def test_groups_match_brute_force(spark):
    rnd = random.Random(5)
    texts = corpus(rnd, 40)
    for i in range(12):  # near copies, chains of near copies, copies, repeated texts
        w = texts[i].split()
        w[rnd.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
        w[rnd.randrange(len(w))] = "again"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), None, "", "one two", "One, two!", "x y " * 300, "x y " * 310, "x y " * 200] + [texts[3]] * 5
    want = brute_groups(texts)
    got = {r["doc_id"]: r["class_id"] for r in bm.groups(docs(spark, texts)).collect()}
    assert got == want
    kept = {r["doc_id"] for r in bm.keep_one(docs(spark, texts)).collect()}
    assert kept == set(want.values())


def test_overlaps():
    rnd = np.random.default_rng(3)
    bags = [collections.Counter(rnd.integers(0, 12, 30).tolist()) for _ in range(9)]
    d = np.concatenate([np.full(len(b), i) for i, b in enumerate(bags)])
    h = np.concatenate([np.array(list(b), np.uint64) for b in bags])
    n = np.concatenate([np.array(list(b.values())) for b in bags])
    got = bm.overlaps(d, h, n, np.arange(5), np.arange(4, 9))
    assert got.tolist() == [[sum((bags[i] & bags[j]).values()) for j in range(4, 9)] for i in range(5)]


def test_blocks_reach_all_links(spark):
    rnd = random.Random(9)
    base = corpus(rnd, 1, 80)[0].split()
    texts = []
    for i in range(60):
        w = list(base)
        for k in rnd.sample(range(80), 1 + i % 3):
            w[k] = f"w{i}x{k}"
        texts.append(" ".join(w))
    got = {r["doc_id"]: r["class_id"] for r in bm.groups(docs(spark, texts), block=16).collect()}
    assert got == brute_groups(texts)


def test_bags_are_whole():
    rnd = np.random.default_rng(8)
    sets = [(np.sort(rnd.choice(1 << 48, n, replace=False)).astype(np.uint64), rnd.integers(1, 100_000, n)) for n in (0, 1, 7, 300)]
    d, h, n = bm.unpacked([bm.packed(*s) for s in sets])
    for i, (x, c) in enumerate(sets):
        assert (h[d == i] == x).all() and (n[d == i] == c).all()


def test_open_buckets_of_many_components(spark):
    """Texts put together from few passages: all shingles are shared, sizes differ, and many pairs lie about the threshold."""
    rnd = random.Random(31)
    passages = [" ".join(p.split()) for p in corpus(rnd, 14, 12)]
    texts = [" ".join(rnd.sample(passages, rnd.randrange(4, 9))) for _ in range(150)]
    texts += [" ".join(sorted(rnd.sample(passages, 8), key=passages.index)) for _ in range(120)]
    got = {r["doc_id"]: r["class_id"] for r in bm.groups(docs(spark, texts), block=16).collect()}
    assert got == brute_groups(texts)


def test_near_copies_of_the_tables(spark, tables):
    """All pairs at 0.8 or more of the table that share any shingle of fewer than 400 texts, by brute force."""
    rows = [(r["doc_id"], bag(r["text"])) for r in tables[0].collect()]
    # words as the operator takes them
    held = collections.defaultdict(list)
    for i, (_, b) in enumerate(rows):
        for s in b:
            held[s].append(i)
    pairs = {(i, j) for v in held.values() if 1 < len(v) < 400 for x, i in enumerate(v) for j in v[x + 1 :]}
    near = [(rows[i][0], rows[j][0]) for i, j in pairs if jaccard(rows[i][1], rows[j][1]) >= 0.8]
    got = {r["doc_id"]: r["class_id"] for r in bm.groups(tables[0]).collect()}
    assert len(near) > 80 and all(got[a] == got[b] for a, b in near)
    # and no class holds more than its links make
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in near:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    assert got == {i: top(i) for i, _ in rows}


def test_near_duplicate_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert bm.groups(empty).count() == 0 and bm.keep_one(empty).columns == empty.columns
    same = docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f"], [7, 7, None])
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1) for r in bm.groups(same).collect()) == [(-1, -1), (7, 7), (7, 7)]
    assert sorted((r["doc_id"] or -1) for r in bm.keep_one(same).collect()) == [-1, 7]


# ------------------------------------------------------------------ decontamination

ITEM = "Maria Lopez drove 120 km from Berlin to the old harbour while her brother walked 15 miles along the river and paid 40 dollars for lunch"


def test_templates(spark):
    rnd = random.Random(2)
    filler = corpus(rnd, 6)
    changed = ITEM.replace("Maria Lopez", "Ada").replace("120 km", "95 miles").replace("15", "22").replace("Berlin", "Rome")
    twice = "If Tom has 5 apples then Tom gives away 5 apples and Tom keeps the rest of the fruit"
    texts = [filler[0] + " " + ITEM + ". " + filler[1], changed, filler[2], None, "", ITEM.lower(), twice.replace("5", "9").replace("Tom", "Sue"), "If Tom has 5 apples then Tom gives away 7 apples and Tom keeps the rest of the fruit", filler[3]]
    bench = spark.createDataFrame([(1, ITEM), (2, twice), (3, "short one"), (4, None), (5, filler[3].split(" ", 3)[3] + " tail"), (6, "only five plain words here")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.pairs(docs(spark, texts), bench).collect()}
    assert {(0, 1), (1, 1), (5, 1), (6, 2), (8, 5)} == set(got)
    assert not got[0, 1]["reparameterised"] and got[1, 1]["reparameterised"] and got[6, 2]["reparameterised"] and got[0, 1]["coverage"] == 1
    kept = {r["doc_id"] for r in decontam.clean(docs(spark, texts), bench).collect()}
    assert kept == {2, 3, 4, 7}


def test_only_contradicting_windows_are_dropped(spark):
    rnd = random.Random(12)
    head, middle, tail = corpus(rnd, 3, 18)
    item = f"{head} in 1990 {middle} in 1990 {tail}"
    edited = f"{head} in 1990 {middle} in 1991 {tail}"
    recipe = "Stir 2 cups of dry rice into the broth then cover the pot and simmer it gently for 2 hours before serving"
    texts = [edited, recipe.replace("2 cups", "3 cups").replace("2 hours", "5 hours"), f"{corpus(rnd, 1)[0]} {item}"]
    bench = spark.createDataFrame([(1, item), (2, recipe)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.pairs(docs(spark, texts), bench).collect()}
    assert set(got) == {(0, 1), (1, 2), (2, 1)}
    # 51 windows, 8 of them with the edited number; before it stand 39 tokens
    assert got[0, 1]["n_windows"] == 51 - 8 and got[0, 1]["longest_run"] == 39 and got[0, 1]["reparameterised"]
    assert got[1, 2]["reparameterised"] and got[2, 1]["coverage"] == 1 and not got[2, 1]["reparameterised"]


def plain_tokens(text):
    """(token, raw, plain, capital) by regular expressions."""
    out = []
    for m in re.finditer(r"[0-9]+(?:[.,][0-9]+)*|[A-Za-z_]+", text or ""):
        low = m[0].lower()
        if m[0][0].isdigit():
            out.append(("#", low, False, False))
        elif out and out[-1][0] == "#" and low in decontam.UNITS:
            out.append(("@", low, False, False))
        else:
            out.append((low, low, True, m[0][0].isupper()))
    names = []
    for t in out:
        if t[3] and names and names[-1][0] == "&":
            names[-1] = ("&", names[-1][1] + " " + t[1], False, True)
        else:
            names.append(("&", t[1], False, True) if t[3] else t)
    return out, names


def brute_windows(text, reading, size, whole):
    t = plain_tokens(text)[reading]
    for i in range(len(t) - size + 1) if not whole or size == 8 or len(t) == size else ():
        part = t[i : i + size]
        template = sum(x[2] for x in part) >= (5 if size == 8 else -(-3 * size // 5))
        if template or not reading:
            yield i, (template, *(x[0 if template else 1] for x in part)), [x[1] for x in part if template and not x[2]]


def brute_pair(doc, item):
    """(coverage, run) by all pairs of windows, or None."""
    best = (0, 0)
    for reading in (0, 1):
        for size in (5, 6, 7, 8):
            theirs = list(brute_windows(item, reading, size, True))
            met = [(i - j, j, tuple(a), tuple(b), k) for j, h, a in theirs for i, g, b in brute_windows(doc, reading, size, False) if g == h for k in [theirs.index((j, h, a))]]
            if not met:
                continue
            lines = {frozenset(m[1:] for m in met if m[0] == s) for s in {m[0] for m in met}}
            votes = collections.defaultdict(collections.Counter)
            for _, a, b, _ in (w for line in lines for w in line):
                pairs = set(zip(a, b))
                for x, y in pairs:
                    votes[x][y] += len({p for p, _ in pairs}) == len(pairs)
            # a tie is broken by hashes, which this has not: skip such cases
            chosen = {}
            for x, n in votes.items():
                top = [y for y, c in n.items() if c == max(n.values())]
                if x not in n and len(top) > 1:
                    return None
                chosen[x] = x if x in n else top[0]
            kept = [[w for w in line if all(chosen[x] == y for x, y in zip(w[1], w[2]))] for line in lines]
            at = {w[0] for line in kept for w in line}
            templates = [j for j, h, _ in theirs if h[0]]
            cover = max(len(at) / len(theirs), len(at & set(templates)) / len(templates) if templates else 0)
            run = 0
            for line in kept:
                line, begin = sorted(line), None
                for k, w in enumerate(line):
                    if not k or w[3] - line[k - 1][3] > 1 or w[0] - line[k - 1][0] > size:
                        begin = w[0]
                    run = max(run, w[0] - begin + size)
            best = (max(best[0], cover), max(best[1], run))
    return best


def test_slots_match_brute_force(spark):
    rnd = random.Random(21)
    words = "red blue tall wide river stone cart wheel paper green small light near under table chair wall door".split()

    def sentence(n):
        out = []
        for _ in range(n):
            k = rnd.random()
            out.append(str(rnd.randrange(2, 6)) if k < 0.15 else rnd.choice(("Ann", "Bob", "Cleo")) if k < 0.25 else rnd.choice(("km", "kg")) if k < 0.3 else rnd.choice(words))
        return out

    def altered(w):
        swap = {v: rnd.choice("23456789") for v in "2345"} | {n: rnd.choice(("Ann", "Dora", "Eve")) for n in ("Ann", "Bob", "Cleo")}
        w = [swap.get(x, x) if rnd.random() < 0.93 else str(rnd.randrange(9)) for x in w]
        if rnd.random() < 0.5:
            w.insert(rnd.randrange(len(w)), "inserted")
        if rnd.random() < 0.3:
            w = w[: rnd.randrange(len(w) // 2, len(w))]
        return w

    items = [sentence(rnd.choice((5, 6, 7, 9, 14, 24, 37))) for _ in range(25)]
    texts = [" ".join(sentence(8) + altered(rnd.choice(items)) + sentence(6) + (altered(rnd.choice(items)) if rnd.random() < 0.4 else [])) for _ in range(120)]
    items = [" ".join(i) for i in items]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").selectExpr("*", "'x' as hash", "0 as pos", "0 as doc_id", "1 as size")
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["longest_run"]) for r in decontam.pairs(docs(spark, texts).selectExpr("*", "1 as item_id", "2 as slots", "3 as id"), bench).collect()}
    skipped = hits = 0
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            want = brute_pair(t, x)
            if want is None:
                skipped += 1
            elif want[0] >= 0.5 or want[1] >= 13:
                hits += 1
                assert got[d, i] == (pytest.approx(want[0], abs=1e-6), want[1]), (t, x)
            else:
                assert (d, i) not in got, (t, x, want)
    assert hits > 60 and skipped < 60


def test_one_changed_number_hides_nothing(spark):
    """A verbatim sentence counts whatever follows it, and one map of values holds for all alignments."""
    head, tail = "the keeper of the old mill counted 3 brown sacks of grain before the rain began again", "then sold 3 of them to the baker who lived across the narrow bridge beyond the chapel yard"
    item = f"{head} {tail}"
    cut = " ".join("plain words that no item of the set has in it anywhere at all".split() * 2)
    false = f"{head.replace('3', '5')} suddenly {tail.replace('3', '7')}"
    texts = [f"{head} {cut}", f"{head} {tail.replace('3', '7')}", false, f"{head} {cut} {head} {cut} " * 300, item.replace("3", "4") + " " + cut + " " + item.replace("3", "6")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.pairs(docs(spark, texts), bench).collect()}
    assert {0, 1, 3, 4} <= set(got)
    assert got[0]["longest_run"] == got[3]["longest_run"] == len(head.split()) and got[1]["longest_run"] >= len(head.split())
    # two values for one: the first sentence agrees with itself for 17 tokens, the second one's windows with the other value go
    assert (got[2]["n_windows"], got[2]["longest_run"]) == (10 + 8, 17) and got[2]["coverage"] == pytest.approx(brute_pair(false, item)[0], abs=1e-6)
    assert got[4]["coverage"] == 1 and got[4]["reparameterised"]


def test_number_heavy_items_match_verbatim(spark):
    sums, short = "Compute 3 km + 5 km + 7 km - 2 km", "1 4 9 16 25"
    filler = corpus(random.Random(13), 2)
    texts = [f"{filler[0]} {sums} {filler[1]}", sums.replace("3", "4"), f"squares: {short}.", "1 4 9 16 26", filler[0]]
    bench = spark.createDataFrame([(1, sums), (2, short), (3, "1 2 3")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.pairs(docs(spark, texts), bench).collect()}
    assert set(got) == {(0, 1), (2, 2)} and all(r["coverage"] == 1 and not r["reparameterised"] for r in got.values())
    assert {r["doc_id"] for r in decontam.clean(docs(spark, texts), bench).collect()} == {1, 3, 4}


def test_decontam_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.pairs(docs(spark, ["a b c d e f g h i"]), none).count() == 0
    one = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    assert [r["doc_id"] for r in decontam.pairs(docs(spark, ["x alpha beta gamma delta epsilon y", "alpha beta"]), one).collect()] == [0]
    assert decontam.pairs(spark.createDataFrame([], DOCS), one).count() == 0


def test_verbatim_passages_of_the_tables(spark):
    d, b = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/benchmark.parquet")
    grams = collections.defaultdict(set)
    for r in b.collect():
        w = re.findall(r"\w+", r["text"].lower())
        for i in range(len(w) - 7):
            grams[tuple(w[i : i + 8])].add(r["item_id"])
    want = {r["doc_id"] for r in d.collect() for w in [re.findall(r"\w+", r["text"].lower())] if any(tuple(w[i : i + 8]) in grams for i in range(len(w) - 7))}
    assert {r["doc_id"] for r in decontam.pairs(d, b).collect()} == want


# ------------------------------------------------------------------ packing and order


@pytest.mark.parametrize("capacity", [16, 2048])
def test_plan_packs_all(capacity):
    rnd = random.Random(capacity)
    counts = {n: rnd.randrange(1, 40) for n in rnd.sample(range(1, capacity + 1), min(capacity, 60))}
    slots, made = packing.plan(counts, capacity)
    used, items = collections.Counter(), collections.defaultdict(list)
    for i, (length, rank, first, at) in enumerate(slots):
        end = slots[i + 1][1] if i + 1 < len(slots) and slots[i + 1][0] == length else counts[length]
        for k in range(end - rank):
            items[first + k].append((at, length))
            used[length] += 1
    assert used == counts and len(items) == made
    for rows in items.values():
        at = 0
        for a, n in sorted(rows):
            assert a == at
            at += n
        assert at <= capacity
    assert made >= -(-sum(n * c for n, c in counts.items()) // capacity)
    # best fit decreasing, one by one
    room = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = min((r for r in room if r >= n), default=None)
        if fit is None:
            room.append(capacity - n)
        else:
            room[room.index(fit)] -= n
    assert made == len(room)


def test_pack(spark):
    rnd = random.Random(4)
    texts = [*corpus(rnd, 30, 20), None, "", *corpus(rnd, 2, 900)]
    rows = packing.pack(docs(spark, texts), capacity=256).collect()
    words = word_ids(default_path(), "I")
    want = {}
    for i, t in enumerate(texts):
        raw = words.text(t) + b"\0\0\0\0"
        n = len(raw) // 4
        cut = [0] + list(range(n % 256 or 256, n, 256)) + [n]
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            want[i, k] = (a, b - a, zlib.crc32(raw[4 * a : 4 * b]))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for a, n in sorted(v):
            assert a == at
            at += n
        assert at <= 256
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
    twice = packing.pack(docs(spark, ["a b c"] * 5, [1, 1, None, None, 2])).collect()
    assert len(twice) == 5 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 5


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_feistel_is_a_permutation(n):
    x = training_order.feistel(np.arange(n), n)
    assert sorted(x.tolist()) == list(range(n)) and (n < 10 or (x != training_order.feistel(np.arange(n), n, key=5)).any())


def test_training_order(spark, tmp_path):
    texts = [*corpus(random.Random(6), 25, 40), None, ""]
    folder = f"file://{tmp_path}/shards"
    rows = training_order.materialise(docs(spark, texts), folder, length=64, per_shard=4).collect()
    slots = list(training_order.read_slots(folder, 0, 10_000, 64, 4))
    n = len(slots)
    assert {r["slot"] for r in rows} == set(range(n))
    again = list(training_order.read_slots(folder, 5, 3, 64, 4))
    assert all((a == b).all() for a, b in zip(again, slots[5:8]))
    words = word_ids(default_path(), "H")
    got = collections.defaultdict(dict)
    for r in rows:
        ids = slots[r["slot"]][r["offset"] % 64 : r["offset"] % 64 + r["length"]]
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"] and r["shard"] == r["slot"] // 4
        got[r["doc_id"]][r["start"]] = ids
    for i, t in enumerate(texts):
        assert np.concatenate([v for _, v in sorted(got[i].items())]).tobytes() == words.text(t) + b"\0\0"
    assert training_order.materialised(spark.createDataFrame([], DOCS)).count() == 0


# ------------------------------------------------------------------ models


def brute_lm(texts, good):
    """Losses by plain dictionaries, each document by models built anew without it."""

    def model(chosen):
        uni, bi = collections.Counter(), collections.Counter()
        for t in chosen:
            w = ["<s>", *(t or "").split()]
            if len(w) > 1:
                uni.update(w)
                bi.update(zip(w, w[1:]))
        return uni, bi, sum(v for k, v in uni.items() if k != "<s>")

    def loss(m, k, t):
        w = ["<s>", *t.split()]
        total = 0.0
        for h, x in zip(w, w[1:]):
            one = (m[0][x] * k + 1) / (m[2] * k + lm_scoring.VOCABULARY)
            total -= np.log((m[1][h, x] * k + lm_scoring.PRIOR * one) / (m[0][h] * k + lm_scoring.PRIOR))
        return total / (len(w) - 1)

    out = []
    for i, t in enumerate(texts):
        target, back = model(x for j, x in enumerate(texts) if j in good and j != i), model(x for j, x in enumerate(texts) if j != i)
        scale = target[2] / back[2] if target[2] and back[2] else 1.0
        out.append((loss(target, 1, t), loss(back, scale, t)) if t else (None, None))
    return out


def test_lm_matches_plain_counts(spark):
    texts = ["a b a b c", "a b c d", None, "", "zz yy xx", "a b", "a b a b c", "c d " * 400]
    labels = spark.createDataFrame([(0, 1), (1, 1), (1, None), (4, 0), (None, 1), (7, 1)], "doc_id long, quality int")
    table = docs(spark, texts).selectExpr("*", "'x' as block", "1 as part", "2 as n", "3 as target")
    for got in (lm_scoring.cross_entropy_difference(table, labels), lm_scoring.cross_entropy_difference(table.repartition(3), labels, block=6, part=5)):
        got = {r["doc_id"]: r for r in got.collect()}
        for i, (t, b) in enumerate(brute_lm(texts, {0, 1, 7})):
            if t is None:
                assert got[i]["score"] is None and got[i]["n_tokens"] == 0
            else:
                assert got[i]["target_loss"] == pytest.approx(t, abs=1e-6) and got[i]["background_loss"] == pytest.approx(b, abs=1e-6) and got[i]["score"] == pytest.approx(b - t, abs=1e-6)
    assert lm_scoring.cross_entropy_difference(spark.createDataFrame([], DOCS), labels).count() == 0
    alone = lm_scoring.cross_entropy_difference(docs(spark, ["a b", "a b"], [1, None]), labels).collect()
    assert len(alone) == 2 and all(r["n_tokens"] == 2 and r["score"] is not None for r in alone)
    assert lm_scoring.cross_entropy_difference(docs(spark, ["a b"]), labels.where("false")).count() == 1


def test_lm_slices_score_alike():
    rnd = np.random.default_rng(4)
    lengths = np.array([0, 5, 0, 700, 3, 90, 0])
    words, tokens = np.sort(rnd.integers(0, 1 << 62, 50).astype(np.uint64)), rnd.integers(0, 50, int(lengths.sum())).astype(np.int32)
    x = lm_scoring.Block(words, tokens, lengths, np.array([False, True, False, False, True, True, False]))
    whole = x.losses(x.t, x.b, 98, 798)
    old, lm_scoring.SLICE = lm_scoring.SLICE, 10
    try:
        assert (x.losses(x.t, x.b, 98, 798) == whole).all()
    finally:
        lm_scoring.SLICE = old


def test_lm_counts_stay_exact_as_the_corpus_grows(spark):
    """More distinct n-grams than any table of 2^22 slots tells apart; blocks and parts of any size score alike."""
    words = 25
    texts = [" ".join(f"w{i}x{j}" for j in range(words)) for i in range(100_000)] + ["one two one three", None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")
    got = lm_scoring.cross_entropy_difference(table, labels, block=200_000, part=500_000)
    starts, rest = 100_001, 100_000 * words + 4 - words
    scale = 2 * words / rest

    # nothing of these documents occurs elsewhere, so without them their n-grams have no count, and contexts but the first
    def loss(context):
        return -np.log((lm_scoring.PRIOR / (2 * words + lm_scoring.VOCABULARY)) / (context + lm_scoring.PRIOR))

    want = (loss((starts - 1) * scale) + (words - 1) * loss(0)) / words
    low, high, n = got.where("doc_id between 2 and 99999").agg(F.min("background_loss"), F.max("background_loss"), F.count("*")).first()
    assert n == 99_998 and got.count() == 100_002 and low == pytest.approx(want, abs=1e-8) and high == pytest.approx(want, abs=1e-8)


def rank_auc(s, y):
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    return (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_lm_tells_topics_and_repeated_documents(spark):
    """No label and no own count tells the documents of a topic apart, only the labelled others; a second copy does count."""
    rnd = random.Random(14)
    topics = [["".join(rnd.choice(letters) for _ in range(4)) for _ in range(300)] for letters in ("abcdefgh", "efghijkl")]
    texts = [" ".join(rnd.choice(topics[i % 2]) for _ in range(80)) for i in range(300)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 100, 2)], "doc_id long, quality int")
    table = docs(spark, [*texts, texts[201]])
    got = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(table, labels).collect()}
    rest = range(100, 200)
    assert rank_auc(np.array([got[i]["score"] for i in rest]), np.array([1 - i % 2 for i in rest])) > 0.99
    alone = [got[i]["score"] for i in range(203, 300, 2)]
    assert got[201]["score"] == got[300]["score"] < min(alone) - 1


@pytest.mark.parametrize("size", [500, 1500, 2500, 3500, 20_000])
def test_dictionaries_reach_the_ends_of_texts(size):
    text = bytes(random.Random(size).choices(range(97, 123), k=size))
    got = quality._dictionary(quality._blocks(text))  # a single text is too little to train on: its blocks as they are
    assert text[:500] in got and text[-500:] in got
    assert size > 4096 or all(text[i : i + 8] in got for i in range(size - 7))


def test_quality_held_out(spark, tables):
    d, labels = tables
    got = quality.classify(d, labels)
    assert got.count() == d.count() and got.where("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.5)").isEmpty()
    r = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert r > 0.93
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got.take(50))


def test_quality_matches_a_plain_computation(spark, tables):
    """Scores of whole texts from the compressed sizes of their blocks, by the command of the library alone."""
    import zstandard

    d, labels = tables
    m = quality.fit(d, labels, 400)
    good, bad = (zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(x), write_checksum=False, write_content_size=False, write_dict_id=False) for x in (m.good, m.bad))
    rows = d.limit(120).collect()
    got = {r["doc_id"]: r["score"] for r in quality.score(d, m).collect()}
    for r in rows:
        x = (r["text"] or "").encode()
        parts = [x[i : i + 1024] for i in range(0, len(x), 1024)]
        diff = [len(bad.compress(p)) - len(good.compress(p)) for p in parts]
        z = m.weights[0] + m.weights[1] * sum(diff) / (len(x) + 256) + m.weights[2] * sum(len(p) for p, v in zip(parts, diff) if v <= 0) / (len(x) + 256)
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_quality_learns_from_the_fitting_folds_alone(spark, tables):
    d, labels = tables
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    m = quality.fit(d, labels, 400)
    assert m == quality.fit(d.withColumn("text", F.when(out, "spoilt").otherwise(F.col("text"))), labels.withColumn("quality", F.when(out, 0).otherwise(F.col("quality"))), 400)


def test_quality_edges(spark, tables):
    d, labels = tables
    odd = docs(spark, [None, "", "x" * 200_000, "same", "same"], [0, 1, 2, 3, None])
    m = quality.fit(d, labels, 400)
    rows = quality.score(odd, m).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(odd, labels.where("quality = 1")).where("score <> 1").isEmpty()
    assert quality.classify(odd, labels.where("false")).where("score <> 0.5").isEmpty()
    assert quality.score(odd.where("false"), m).count() == 0 and quality.keep_good(odd, labels.where("false")).columns == odd.columns


def test_toxicity_held_out(spark, tables):
    d, labels = tables
    fit_on = labels.where("doc_id % 3 <> 0")
    got = toxicity.classify(d, fit_on).join(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "y"), "doc_id")
    assert got.agg(F.avg((F.col("toxic") == F.col("y")).cast("int"))).first()[0] > 0.9
    odd = docs(spark, [None, "", "a", "a"], [0, 1, 2, None])
    assert toxicity.classify(odd, labels.where("false")).count() == 4 and toxicity.score(odd.where("false"), toxicity.fit(d, labels, max_rows=100)).count() == 0


def test_chain_feeds_probabilities():
    rnd = np.random.default_rng(0)
    y = rnd.integers(0, 2, 300).astype(float)
    m = toxicity.fit_linear(np.arange(300), np.full(300, 5), 300, np.where(y == 1, 0.9, 0.1)[:, None], y)
    assert m.extra[0] > 1


def test_toxicity_matches_a_plain_computation(spark, tables):
    """Probabilities of the chain, word by word, from the fitted weights."""
    from planproof.llm.textblock import MULT, Words, mix

    d, labels = tables
    models = toxicity.fit(d, labels, max_rows=200)
    got = {r["doc_id"]: r for r in toxicity.score(d, models).collect()}
    for r in d.limit(60).collect():
        w = Words(pa.array([r["text"]]))
        slots = {int(mix(np.array([h], np.uint64) * MULT[20])[0] >> np.uint64(16)) & (toxicity.SLOTS - 1) for h in set(w.hash.tolist())}
        # distinct words count, also where two of them share a slot
        words = {int(mix(np.array([h], np.uint64) * MULT[20])[0] >> np.uint64(16)) for h in set(w.hash.tolist())}
        before = []
        for m in models:
            z = m.bias + sum(float(m.slots[x & (toxicity.SLOTS - 1)]) for x in words) + sum(p * v for p, v in zip(before, m.extra))
            before.append(1 / (1 + np.exp(-z)))
        assert len(slots) <= len(words) and [got[r["doc_id"]][f"p_{c[0]}"] for c in toxicity.CHAIN] == pytest.approx(before, abs=1e-6)
        assert got[r["doc_id"]]["toxic"] == int(before[-1] >= 0.5)


LONG = " ".join(f"word{i % 700} of{i % 31}" for i in range(60_000))
#: Columns that the operators use themselves; none of them is read.
CLASH = [f"'x' as {n}" for n in ("_rank", "_bucket", "shard", "slot", "band", "comp", "rep", "score", "y", "turn", "target", "block", "part", "hash", "id", "item_id", "length", "piece", "class_id", "again", "n", "size", "count")]


def test_odd_rows_through_every_operator(spark, tables):
    """Null ids and texts, repeated rows, a very long text, clashing columns; then no rows at all."""
    d, labels = tables
    odd = docs(spark, [LONG, LONG, None, "", "a b c", "a b c"], [1, 1, 2, None, None, 5]).selectExpr("*", *CLASH)
    few = labels.limit(60).unionByName(spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")).selectExpr("*", "'z' as text", "1 as y", "2 as turn")
    bench = spark.createDataFrame([(1, LONG[:300]), (None, LONG[:300]), (2, None), (3, "")], "item_id long, text string").selectExpr("*", "'x' as doc_id", "1 as pos", "2 as nth")
    ids = lambda df: sorted((r["doc_id"] or -1) for r in df.collect())
    every = [-1, -1, 1, 1, 2, 5]
    both = d.limit(40).selectExpr("*", *CLASH).unionByName(odd)
    assert ids(quality.classify(odd, few)) == every and quality.keep_good(both, few).columns == odd.columns
    assert ids(toxicity.classify(odd, few)) == every
    assert ids(lm_scoring.cross_entropy_difference(odd, few)) == every
    assert ids(bm.groups(odd)) == every and ids(bm.keep_one(odd)) == [-1, -1, 1, 2, 5] and bm.keep_one(odd).columns == odd.columns
    assert {(r["doc_id"], r["item_id"]) for r in decontam.pairs(odd, bench).collect()} == {(1, 1)} and ids(decontam.clean(odd, bench)) == [-1, -1, 2, 5]
    packed = packing.pack(odd).collect()
    assert {r["doc_id"] for r in packed} == {1, 2, 5, None} and len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
    placed = training_order.materialised(odd).collect()
    assert {r["doc_id"] for r in placed} == {1, 2, 5, None} and max(sum(r["length"] for r in placed if r["doc_id"] == i) for i in (1, 5)) > 200_000
    none = odd.where("false")
    for f in (lambda x: quality.classify(x, few), lambda x: toxicity.classify(x, few), lambda x: lm_scoring.cross_entropy_difference(x, few), bm.groups, bm.keep_one, lambda x: decontam.pairs(x, bench), lambda x: decontam.clean(x, bench), packing.pack, training_order.materialised):
        assert f(none).count() == 0


# ------------------------------------------------------------------ pipeline


def test_pipeline(spark):
    d = spark.read.parquet(f"{DIR}/documents.parquet")
    at, ids = d, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, DIR).persist()
        assert at.columns == d.columns, name
        ids.append({r[0] for r in at.select("doc_id").collect()})
    assert ids[0] >= ids[1] >= ids[2] == ids[3] and len(ids[2]) > 0.6 * d.count()
    last = corpus_pipeline.STAGES[-1][1](spark, at, DIR)
    assert {r[0] for r in last.select("doc_id").distinct().collect()} == ids[3]
    assert corpus_pipeline.run(spark, DIR).count() == last.count()
