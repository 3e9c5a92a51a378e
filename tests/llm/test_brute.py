"""Operators against slow versions written apart from them, over small fixtures."""

import functools
import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from graphlode.llm import decontaminate, fingerprints, langid, mixing, neardup, sharding, substrings, textkernel as tk, tokenids, toxicity, wfst

M = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def mix64(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M
    return h ^ (h >> 31)


def poly(values):
    h = 0
    for v in values:
        h = (h * BASE + v) & M
    return mix64(h)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def texts(seed, n=40, words=60, vocabulary=300):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(vocabulary)]
    return r, vocab, [" ".join(r.choice(vocab) for _ in range(r.randint(1, words))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


# -- 1


def brute_winnow(text, k, w):
    at = [i for i, c in enumerate(text) if c.isalnum()]
    letters = [ord(text[i].lower()) for i in at]
    grams = [poly(letters[i : i + k]) for i in range(len(letters) - k + 1)]
    if not grams:
        return set()
    chosen = set()
    for s in range(max(1, len(grams) - w + 1)):
        window = grams[s : s + w]
        low = min(window)
        chosen.add(max(s + i for i, h in enumerate(window) if h == low))
    return {(at[i], signed(grams[i])) for i in chosen}


def test_winnowing(spark):
    _, _, rows = texts(1, 30, 40)
    rows += ["ab " * 50, "aaaa" * 30, "", "short"]
    got = defaultdict(set)
    for r in fingerprints.fingerprints(frame(spark, rows), 5, 7).collect():
        got[r.doc_id].add((r.pos, r.hash))
    assert dict(got) == {i: f for i, t in enumerate(rows) if (f := brute_winnow(t, 5, 7))}


def test_winnowing_guarantee(spark):
    r = random.Random(2)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    shared = [letters(fingerprints.K + fingerprints.WINDOW - 1) for _ in range(20)]
    rows = [letters(r.randint(0, 200)) + s + letters(r.randint(0, 200)) for s in shared for _ in range(2)]
    got = defaultdict(set)
    for x in fingerprints.fingerprints(frame(spark, rows)).collect():
        got[x.doc_id].add(x.hash)
    assert all(got[2 * i] & got[2 * i + 1] for i in range(20))


# -- 2


def brute_near(doc, item):
    """The most tokens of the item within SLACK of their places, from any start."""
    where = defaultdict(list)
    for p, t in enumerate(tokens(doc)):
        where[t].append(p)
    it = tokens(item)
    starts = {p - o for o, t in enumerate(it) for p in where[t]}
    return max((sum(any(abs(p - o - g) <= decontaminate.SLACK for p in where[t]) for o, t in enumerate(it)) for g in starts), default=0)


def brute_run(doc, item):
    """The longest run of the item's tokens in the document."""
    dt, it = tokens(doc), tokens(item)
    best, above = 0, [0] * (len(it) + 1)
    for t in dt:
        row = [0] * (len(it) + 1)
        for o, x in enumerate(it):
            if x == t:
                row[o + 1] = above[o] + 1
        best, above = max(best, *row), row
    return best


def brute_matches(docs, items, n, near):
    out = set()
    for item_id, item in enumerate(items):
        length = len(tokens(item))
        for doc_id, d in enumerate(docs if length else []):
            if (run := brute_run(d, item)) >= min(n, length):
                out.add((item_id, doc_id, "exact", run))
            elif brute_near(d, item) >= np.ceil(length * near):
                out.add((item_id, doc_id, "proximity", 0))
    return out


def test_decontamination(spark, tmp_path):
    r, vocab, docs = texts(3, 30, 80, 120)
    items = [" ".join(r.choice(vocab) for _ in range(n)) for n in (30, 20, 13, 6, 3, 40)] + ["answer is fortytwo", "singleton", "..."]
    docs[0] += " " + items[0]
    docs[1] = items[1].upper() + ". " + docs[1]
    docs[2] += " " + " ".join(w for i, w in enumerate(items[0].split()) if i % 9)
    docs[3] += " " + " ".join(items[5].split()[10:25])
    docs[4] += " " + items[3]
    docs[5] += " " + items[4]
    docs[7] += " The answer is: FortyTwo! " + vocab[0]
    docs[8] = "singleton " + docs[8]
    docs[6] += " " + " ".join(x for w in items[1].split() for x in ([w, "zz"] if w == items[1].split()[7] else [w]))
    it = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.item_id, x.doc_id, x.kind, x.run) for x in decontaminate.matches(frame(spark, docs), it).collect()}
    assert got == brute_matches(docs, items, decontaminate.N, decontaminate.NEAR)
    assert {(0, 0), (1, 1), (0, 2), (5, 3), (3, 4), (4, 5), (1, 6), (6, 7), (7, 8)} <= {(a, b) for a, b, _, _ in got}
    index = decontaminate.build_index(frame(spark, docs), str(tmp_path / "index"))
    longer = {(x.item_id, x.doc_id) for x in decontaminate.matches(None, it, least=5, index=index).collect()}
    assert longer == {(a, b) for a, b, _, _ in got if a not in (4, 6, 7)}


def test_edited_items_are_found(spark):
    """Items whose rarest words are replaced, as many as NEAR permits and one more; the documents have every word somewhere."""
    r = random.Random(31)
    common, rare = [f"c{i}" for i in range(40)], [f"rare{i}" for i in range(400)]
    items, docs = [], []
    for length in (5, 6, 7, 10, 13, 14, 20, 30, 57):
        for more in (0, 1):
            lost = length - int(np.ceil(length * decontaminate.NEAR)) + more
            at = set(r.sample(range(length), lost))
            item = [rare.pop() if i in at else r.choice(common) for i in range(length)]
            item[min(set(range(length)) - at)] = rare.pop()
            items.append(" ".join(item))
            edited = [("absent" if i % 2 else "") + r.choice(common) if i in at else w for i, w in enumerate(item)]
            docs.append(" ".join([*r.choices(common, k=r.randint(0, 60)), *edited, *r.choices(common, k=30)]))
            docs += [w for i, w in enumerate(item) if i in at and i % 3]
    docs += [" ".join(r.choices(common, k=200)) for _ in range(5)]
    it = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.item_id, x.doc_id): x.near for x in decontaminate.matches(frame(spark, docs), it).collect() if x.kind == "proximity"}
    want = {(i, d): k for i, item in enumerate(items) for d, doc in enumerate(docs) if (k := brute_near(doc, item)) >= np.ceil(len(tokens(item)) * decontaminate.NEAR)}
    exact = {(i, d) for i, d, kind, _ in brute_matches(docs, items, decontaminate.N, decontaminate.NEAR) if kind == "exact"}
    assert got == {k: v for k, v in want.items() if k not in exact} and len(got) >= 9


# -- 3


def test_coding_round_trip():
    r = np.random.default_rng(4)
    for sizes in ([0, 1, 4, 5, 0, 33], [7], [0]):
        lists = [r.integers(0, 1 << r.choice([7, 9, 17, 25, 32]), n, dtype=np.uint32) for n in sizes]
        at = np.concatenate([[0], np.cumsum(sizes)])
        control, c_at, data, d_at = tokenids.encode(np.concatenate(lists) if lists else np.zeros(0, np.uint32), at)
        for i, x in enumerate(lists):
            assert (tokenids.decode(control[c_at[i] : c_at[i + 1]].tobytes(), data[d_at[i] : d_at[i + 1]].tobytes(), len(x)) == x).all()


def test_ids_give_back_the_texts(spark, tmp_path):
    _, _, rows = texts(5, 20)
    rows += ["", None, "Ünïcode — 😀 text\n\n  x", "the the the"]
    docs = frame(spark, rows)
    raw = tokenids.raw_ids(docs)
    order = tokenids.rank_order(tokenids.frequencies(raw))
    enc = tokenids.encoding()
    counts = Counter(i for t in rows for i in enc.encode_ordinary(t or ""))
    assert list(order) == sorted(counts, key=lambda i: (-counts[i], i))
    coded = tokenids.token_ids(docs)
    for x in coded.where("part = 'ids'").collect():
        ids = order[tokenids.decode(bytes(x.control), bytes(x.data), x.n)] if x.n else []
        assert enc.decode([int(i) for i in ids]) == (rows[x.doc_id] or "")
    # From the stored rows alone, after the texts and their frequencies are gone.
    coded.write.parquet(str(tmp_path / "coded"))
    stored = spark.read.parquet(str(tmp_path / "coded"))
    assert {x.doc_id: x.text for x in tokenids.decoded(stored, tokenids.VOCABULARY).collect()} == {i: t or "" for i, t in enumerate(rows)}
    assert {x.doc_id: x.ids for x in tokenids.decoded(stored).collect()} == {i: enc.encode_ordinary(t or "") for i, t in enumerate(rows)}
    assert stored.where("part = 'ranks'").count() == 1 and tokenids.decoded(stored.where("n = 0")).count() == 2


# -- 4


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    right = langid.identify(docs.where("doc_id % 2 = 1"), model).withColumnRenamed("lang", "found").join(docs, "doc_id").where("n_grams > 200").selectExpr("avg(CAST(found = lang AS INT))").first()[0]
    assert right > 0.97


def test_language_by_hand(spark):
    rows = [("aaa bbb", "x"), ("abab", "x"), ("ccc ddd", "y")]
    model = langid.fit(spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "doc_id long, text string, lang string"))
    seen = {k: Counter() for k in "xy"}
    for t, k in rows:
        c = next(tk.chunks(pa.array([t])))
        for bucket, _ in langid.grams(c):
            seen[k].update(bucket.tolist())
    text = "ab cd"
    buckets = [b for g, _ in langid.grams(next(tk.chunks(pa.array([text])))) for b in g.tolist()]
    want = [np.log((2 if k == "x" else 1) / 3) + sum(np.log((seen[k][g] + langid.ALPHA) / (sum(seen[k].values()) + langid.ALPHA * langid.BUCKETS)) for g in buckets) for k in "xy"]
    score, n = model.scores(next(tk.chunks(pa.array([text]))))
    assert n[0] == len(buckets) == 5 + 4 + 3 and np.allclose(score[0], want, rtol=1e-5)


# -- 5


def best_fit(sizes, capacity):
    rooms, over = [], 0
    for s in sorted(sizes, reverse=True):
        if s > capacity:
            over += 1
            continue
        fits = [(room, i) for i, room in enumerate(rooms) if room >= s]
        if fits:
            rooms[min(fits)[1]] -= s
        else:
            rooms.append(capacity - s)
    return len(rooms) + over


@pytest.mark.parametrize("seed", range(6))
def test_packing(seed):
    r = random.Random(seed)
    sizes = [r.randint(0, 60) if seed % 2 else r.choice([1, 7, 20, 33, 51, 120]) for _ in range(300)]
    runs, bins = sharding.pack(Counter(sizes).items(), 100)
    assert bins == best_fit(sizes, 100)
    load, placed = Counter(), Counter()
    for size, first, end, at, each in runs:
        for k in range(first, end):
            load[at + (k - first) // each] += size
            placed[size] += 1
    assert placed == Counter(sizes) and set(load) <= set(range(bins))
    assert all(v <= 100 or v == 120 for v in load.values())


def test_tree():
    tree, r, have = sharding.BalancedTree(), random.Random(7), set()
    for _ in range(3000):
        k = r.randrange(200)
        if r.random() < 0.5:
            tree.get_or_add(k)
            have.add(k)
        else:
            tree.remove(k)
            have.discard(k)
        q = r.randrange(210)
        got = tree.ceiling(q)
        assert (got[0] if got else None) == min((x for x in have if x >= q), default=None)


def test_shards_hold(spark):
    _, _, rows = texts(8, 120, 40)
    rows += rows[:20]
    got = sharding.shards(frame(spark, rows), 700).collect()
    size, where = Counter(), defaultdict(set)
    for x in got:
        size[x.shard] += x.bytes
        where[rows[x.doc_id]].add(x.shard)
    assert len(got) == len(rows) and all(len(v) == 1 for v in where.values()) and max(size.values()) <= 700
    groups = Counter(rows)
    assert max(x.shard for x in got) + 1 == best_fit([len(t) * n for t, n in groups.items()], 700)


# -- 6


def brute_intervals(rows, length):
    seen = Counter()
    for t in rows:
        w = tokens(t)
        seen.update(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
    out = set()
    for d, t in enumerate(rows):
        w, spans = tokens(t), []
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out |= {(d, a, b) for a, b in spans}
    return out


def test_substrings(spark):
    r, vocab, rows = texts(9, 40, 90, 60)
    passages = [" ".join(r.choice(vocab) for _ in range(n)) for n in (50, 60, 49, 120)]
    for _ in range(25):
        i = r.randrange(len(rows))
        rows[i] += " " + r.choice(passages).upper() + " " + r.choice(vocab)
    rows += ["z " * 200, rows[0]]
    for length in (8, substrings.LENGTH):
        got = {(x.doc_id, x.first, x.end) for x in substrings.repeated_intervals(frame(spark, rows), length).collect()}
        assert got == brute_intervals(rows, length) and got


def test_substrings_of_many_segments_shuffled(spark, monkeypatch):
    """Bits beyond the broadcast's bound: the segments are shuffled, nothing is lost between them."""
    r, vocab, rows = texts(10, 60, 90, 60)
    passage = " ".join(r.choice(vocab) for _ in range(60))
    rows = [None, "", "été " * 70, *(f"{x} {passage}" if i % 7 == 0 else x for i, x in enumerate(rows)), "\u4f60\u597d " * 3, rows[0]]
    monkeypatch.setattr(substrings, "SEGMENT_BYTES", 300)
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", 0)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for length in (8, substrings.LENGTH):
            df = substrings.repeated_intervals(frame(spark, rows), length)
            assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()
            assert {(x.doc_id, x.first, x.end) for x in df.collect()} == brute_intervals(rows, length)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_substrings_segments_are_small(spark):
    """What is read, batched and shuffled of a segment, and what its windows take in a Python worker."""
    r, vocab, _ = texts(11, 1, 9, 5000)
    rows = [" ".join(r.choices(vocab, k=4000)) for _ in range(400)]
    stored = substrings._segments(frame(spark, rows).coalesce(1)).select("doc_ids", "lengths", "text").toArrow()
    assert sorted(i for x in stored["doc_ids"] for i in x.as_py()) == list(range(400))
    assert sum(sum(x.as_py()) for x in stored["lengths"]) == sum(map(len, rows)) > 8e6
    assert max(len(x.as_py()) for x in stored["text"]) < 2 << 20
    tk.tables()
    tracemalloc.start()
    try:
        for text, lengths in zip(stored["text"], stored["lengths"]):
            substrings._Windows(text, lengths, substrings.LENGTH).distinct()
        assert tracemalloc.get_traced_memory()[1] < 50e6
    finally:
        tracemalloc.stop()


# -- 7


def brute_mixture(rows, weights, block_tokens, max_epochs):
    """rows: (doc_id, source, text), no source null. (slot, source, block, epoch, doc_id, start), and the slots that points gave."""
    per = defaultdict(list)
    for i, s, t in rows:
        per[s].append((hashlib.md5(f"mix-1:{i}".encode()).hexdigest(), i, len(tokens(t))))
    n = {s: sum(x[2] for x in docs) for s, docs in per.items()}
    weights = weights or {s: math.floor(math.sqrt(k * math.sqrt(k)) * 1024) + 1 for s, k in n.items()}
    least = min(weights.values())
    order = sorted((s for s in per if s in weights), key=lambda s: hashlib.md5(f"s:{s}".encode()).hexdigest())
    w = {s: round(weights[s] / least * 4096) if isinstance(weights[s], float) else weights[s] for s in order}
    edges, at = {}, 0
    for s in order:
        edges[s] = (at * 2**32 // sum(w.values()), (at + w[s]) * 2**32 // sum(w.values()))
        at += w[s]
    blocks = {s: max(1, -(-n[s] // block_tokens)) for s in order}
    where = {}
    for s in order:
        start = 0
        for _, i, k in sorted(per[s]):
            where[i] = (s, min(start // block_tokens, blocks[s] - 1), start)
            start += k
    full = {s: n[s] // block_tokens for s in order if n[s] >= block_tokens and edges[s][0] < edges[s][1]}
    k, plan, slot = Counter(), [], 0
    while any(k[s] < f for s, f in full.items()):
        u = (slot * 2654435769 + (1 << 31)) % (1 << 32)
        s = next(s for s, (lo, hi) in edges.items() if lo <= u < hi)
        if k[s] < max_epochs * blocks[s]:
            plan.append((slot, s, k[s] % blocks[s], k[s] // blocks[s]))
        k[s] += 1
        slot += 1
    had = {(s, b) for _, s, b, _ in plan}
    late = [(s, b) for s in order for b in range(blocks[s]) if (s, b) not in had]
    whole = plan + [(slot + i, s, b, 0) for i, (s, b) in enumerate(late)]
    return {(t, s, b, e, i, where[i][2]) for t, s, b, e in whole for i in where if where[i][:2] == (s, b)}, plan


@pytest.mark.parametrize("weights", [{"s0": 1.0, "s1": 2.0, "s2": 5.0}, {"s0": 1.0, "s1": 300.0, "s2": 1.0}, None])
def test_mixture(spark, weights):
    _, _, rows = texts(10, 90, 60)
    got = mixing.mixture(frame(spark, rows), weights, 64).collect()
    want, plan = brute_mixture([(i, f"s{i % 3}", t) for i, t in enumerate(rows)], weights, 64, mixing.MAX_EPOCHS)
    assert {(x.slot, x.source, x.block, x.epoch, x.doc_id, x.start) for x in got} == want and len(got) == len(want)
    assert max(Counter(x.doc_id for x in got).values()) <= mixing.MAX_EPOCHS
    if weights and weights["s1"] == 2.0:
        for n in (50, len(plan)):
            share = Counter(s for t, s, _, _ in plan if t < n)
            assert all(abs(share[s] - n * w / 8) <= 3 for s, w in weights.items())


def test_points_of_an_interval():
    r = random.Random(32)
    for _ in range(60):
        width = r.choice([r.randrange(1 << 20, 1 << 32), r.randrange(1 << 24, 1 << 32)])
        lo = r.randrange((1 << 32) - width + 1)
        n = min(3000, 20 * (1 << 32) // width)
        true = [t for t in range(n) if lo <= (t * 2654435769 + (1 << 31)) % (1 << 32) < lo + width]
        assert mixing.visits(lo, lo + width, n) == len(true)
        for k in range(0, len(true), 50):
            assert mixing.slots_of(lo, lo + width, k, len(true) - k) == true[k:]
    for width in (1, 2, 3, 7, 100):
        got = mixing.slots_of(5, 5 + width, 0, 20)
        assert got == [mixing.visit(5, 5 + width, k) for k in range(20)] == sorted(set(got))


def test_small_sources_neither_repeat_the_rest_nor_vanish(spark):
    words = " ".join(f"w{i}" for i in range(1000))
    docs = [(i, words, "a") for i in range(100)] + [(100, "word", "b"), (101, None, "c"), (102, "", None), (103, "x", "d")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for weights in (None, {"a": 1.0, "b": 1e-11, "d": 1.0}):
        got = Counter(x.doc_id for x in mixing.mix(df, weights).collect())
        assert set(got) == set(range(104) if weights is None else [*range(101), 103])
        assert got[100] == 1 and max(got.values()) <= mixing.MAX_EPOCHS and sum(got.values()) <= 120


def test_source_without_a_point_has_its_slots(spark):
    rows = spark.createDataFrame([("a", 5 * 10**9, 1), ("b", 5 * 10**9, 1), ("", 0, 1), (None, 0, 1)], "source string, tokens long, copies long")
    sources = mixing._sources(rows, None, 10**9)
    assert {r.source for r in sources.where("hi <= lo").collect()} == {"", None}
    slots = sorted((r.slot, r.source, r.block, r.epoch) for r in mixing.schedule(sources).collect())
    assert [s for s, *_ in slots] == list(range(len(slots))) and len(slots) < 100
    assert {(s, b) for _, s, b, _ in slots} == {(s, b) for s in "ab" for b in range(5)} | {("", 0), (None, 0)}


def test_slots_come_back_after_mixing(spark):
    _, _, rows = texts(15, 60, 60)
    df = frame(spark, rows)
    want = Counter((x.doc_id, x.slot) for x in mixing.mixture(df, None, 64).collect())
    assert Counter((x.doc_id, x.slot) for x in mixing.with_slot(mixing.mix(df, None, 64), None, 64).collect()) == want


# -- 8


def score(text, lexicon=None):
    return toxicity.score_chunk(next(tk.chunks(pa.array([text]))), lexicon or toxicity.Lexicon())[0][0]


def brute_toxicity(text, learned=lambda w: False):
    """The grammar's rules, clause by clause, without a transducer."""
    kinds = {w: k for k, ws in (("R", toxicity.REPORTS), ("N", toxicity.NEGATIONS), ("T", toxicity.TARGETS), ("V", toxicity.THREATS), ("I", toxicity.INSULTS)) for w in ws}
    total = 0.0
    for line in (text or "").split("\n"):
        quotes_before = 0
        for clause in re.split(r"[.!?;\r]", line):
            marks = [m.group() for m in re.finditer(r"[^\W_]+|[\"“”«»„]", clause)]
            words = [i for i, m in enumerate(marks) if m[0].isalnum()]
            labels = ["Q" if not m[0].isalnum() else "S" if learned(m.lower()) else kinds.get(m.lower(), "O") for m in marks]
            if words:
                inside = (quotes_before + words[0]) % 2  # the marks before the first word are all quotation marks
                insults, threats, targets = [], [], []
                for i in range(words[0], words[-1] + 1):
                    x = labels[i]
                    inside ^= x == "Q"
                    negated = any(labels[j] == "N" for j in range(max(words[0], i - toxicity.SCOPE), i))
                    said = inside or "R" in labels[words[0] : i]
                    if x == "T":
                        targets.append(i)
                    elif x in "ISV" and said:
                        total += 0 if x == "V" and negated else 0.1
                    elif x in "IS" and not negated:
                        insults.append((i, {"I": 0.4, "S": 0.8}[x]))
                    elif x == "V" and not negated:
                        threats.append(i)
                free = []  # targets that no threat takes
                for a, b in zip([-1, *targets], targets):
                    if any(a < t < b for t in threats):
                        total += 1.6
                    else:
                        free.append(b)
                early = [(i, w) for i, w in insults if not targets or i < targets[0]]
                total += 1.6 * (len(insults) - len(early)) + sum(w for _, w in early)
                if early and free:
                    total += 1.6 - max(w for _, w in early)
            quotes_before += sum(x == "Q" for x in labels)
    return round(total, 6)


def test_grammar():
    assert score("You are an idiot, you moron.") == pytest.approx(3.2)
    assert score("you idiot") == score("idiot, you!") == pytest.approx(1.6)
    assert score("idiot") == pytest.approx(0.4)
    assert score("Take out the trash. The circus clown arrived.") < toxicity.REJECT
    assert score("you are not an idiot") == 0
    assert score("you are not an idiot you moron") == pytest.approx(1.6)
    assert score("he said you idiot you moron") == pytest.approx(0.2)
    assert score("“you idiot, you moron”") == pytest.approx(0.2)
    assert score("I will kill you") >= toxicity.REJECT
    assert score("I will never kill you") < toxicity.REJECT
    assert score("kill the process") == 0
    assert score("you idiot. you moron!") == pytest.approx(3.2)
    learned = toxicity.Lexicon([tk.hash_word("grobber") & ~15], {4: [tk.hash_word("zwil")]})
    assert score("a grobber", learned) == score("the zwilling there", learned) == pytest.approx(0.8)
    assert score("a grobber. the zwilling there", learned) >= toxicity.REJECT
    assert score("you grobber", learned) == pytest.approx(1.6) and score("not a grobber", learned) == 0


def test_grammar_on_random_clauses():
    r = random.Random(34)
    words = ["you", "idiot", "trash", "kill", "not", "said", "sun", "grobber", "zwilling", "they", "rain"]
    learned = toxicity.Lexicon([tk.hash_word("grobber") & ~15], {4: [tk.hash_word("zwil")]})
    for _ in range(3000):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", ", ", ' "', '" ', ". ", "!\n", "\n", "; ", " “"]) for _ in range(r.randint(0, 14)))
        assert round(score(text, learned), 6) == brute_toxicity(text, lambda w: w == "grobber" or w.startswith("zwil")), text


def test_toxicity_of_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    lexicon = toxicity.fit(docs, labels)
    words, prefixes = set(lexicon.words.tolist()), {n: set(h.tolist()) for n, h in lexicon.prefix.items()}
    assert words or prefixes

    @functools.cache
    def learned(w):
        return tk.hash_word(w) & ~15 in words or any(len(w) >= n and tk.hash_word(w[:n]) & ~15 in h for n, h in prefixes.items())

    want = {x.doc_id: v for x in docs.select("doc_id", "text").collect() if (v := brute_toxicity(x.text, learned)) >= toxicity.REJECT}
    got = {x.doc_id: x.score for x in toxicity.toxic_documents(docs, labels).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got) and len(got) > 30


def test_composition_is_the_machines_one_after_the_other():
    swap = wfst.build("ab", 0, lambda s, x: ("b" if x == "a" else "a", 0.5, s))
    count = wfst.build("ab", 0, lambda s, x: (x, float(s) if x == "b" else 0.0, min(s + 1, 3)))
    both = wfst.compose(swap, count)
    for labels in ("", "a", "abab", "aabba"):
        w1, y = swap.run(labels)
        w2, z = count.run(y)
        assert both.run(labels) == (w1 + w2, z)


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = {x.doc_id for x in toxicity.toxic_documents(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = labels.where("doc_id % 2 = 1 AND toxic IS NOT NULL").join(docs.select("doc_id").distinct(), "doc_id").collect()
    bad, good = {x.doc_id for x in held if x.toxic}, {x.doc_id for x in held if not x.toxic}
    assert len(found & good) <= 0.02 * len(good)
    assert not bad or len(found & bad) >= 0.6 * len(bad)


# -- 9


def brute_signature(elements, size):
    """One element's permutation as a list that is shuffled in steps."""
    sig = [M] * size
    for e in elements:
        order = list(range(size))
        for j in range(size):
            r = mix64((e + (j + 1) * BASE) & M)
            k = j + (((r >> 32) * (size - j)) >> 32)
            order[j], order[k] = order[k], order[j]
            sig[order[j]] = min(sig[order[j]], (j << 32) | (r & 0xFFFFFFFF))
    return sig


def test_superminhash_by_hand():
    r = random.Random(11)
    owners, elements = [], []
    for d, n in enumerate([1, 2, 17, 200]):
        owners += [d] * n
        elements += [r.getrandbits(64) for _ in range(n)]
    got = neardup.superminhash(np.array(owners), np.array(elements, dtype=np.uint64), 4, 32)
    for d in range(4):
        assert got[d].tolist() == brute_signature([e for o, e in zip(owners, elements) if o == d], 32)


def test_estimates_vary_less_than_minhash():
    r = np.random.default_rng(12)
    errors = []
    for _ in range(60):
        both, a, b = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (20, 10, 10))
        owner = np.repeat([0, 1], 30)
        sig = neardup.superminhash(owner, np.concatenate([both, a, both, b]), 2, 128)
        errors.append((sig[0] == sig[1]).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.02 and np.var(errors) < 0.25 / 128


def jaccard(a, b):
    sa, sb = ({tuple(t[i : i + 3]) for i in range(max(1, len(t) - 2))} for t in (tokens(a), tokens(b)))
    return len(sa & sb) / len(sa | sb)


def test_near_groups(spark):
    r, vocab, rows = texts(13, 30, 100)
    rows = [t + " " + " ".join(r.choice(vocab) for _ in range(40)) for t in rows]
    for i in range(12):
        w = rows[i].split()
        for _ in range(2):
            w[r.randrange(len(w))] = "changed"
        rows.append(" ".join(w))
    rows += [rows[0], rows[3].upper()]
    got = {x.doc_id: x.group_id for x in neardup.near_duplicates(frame(spark, rows)).collect()}
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i], rows[j]) >= 0.6:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    sizes = Counter(root(i) for i in range(len(rows)))
    want = {i: root(i) for i in range(len(rows)) if sizes[root(i)] > 1}
    assert got == want and len(want) >= 24
    kept = {x.doc_id for x in neardup.drop_near_duplicates(frame(spark, rows)).collect()}
    assert kept == {i for i in range(len(rows)) if root(i) == i}


def test_crowded_bands(spark, monkeypatch):
    """Lists in parts give the groups that whole ones give."""
    r, vocab, _ = texts(35, 1, 10)
    base = [r.choice(vocab) for _ in range(80)]
    rows = []
    for _ in range(60):  # a crowd of near copies, and texts that share half with them
        w = list(base)
        for i in r.sample(range(80), 3):
            w[i] = r.choice(vocab)
        rows.append(" ".join(w))
        rows.append(" ".join([*base[:45], *(r.choice(vocab) for _ in range(60))]))
    df = frame(spark, rows)
    want = {x.doc_id: x.group_id for x in neardup.near_duplicates(df).collect()}
    monkeypatch.setattr(neardup, "LIST", 8)
    assert {x.doc_id: x.group_id for x in neardup.near_duplicates(df).collect()} == want and len(want) >= 60


def test_components(spark):
    r = random.Random(14)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {x.node: x.label for x in neardup.components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for a, b in pairs if a != b for x in (a, b)}
