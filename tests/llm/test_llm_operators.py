"""The corpus operators against brute force on small texts, with the odd cases that each must take."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from spanwise.llm import (
    blocks, components, decontaminate, exact_dedup, line_dedup, lm, minhash, packing, sieve, store, substring, suffix_dedup, text, token_counts, tokenizer, toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, keep_id long, node long, component_id long, kept string"
WORDS = "red green blue stone river cloud paper glass metal wood fire water light shadow north south".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def corpus():
    """Texts with copies, edits, shared passages, repeats, nulls, empty and very long ones, ties and odd spaces."""
    rng = random.Random(3)
    base = [prose(rng, rng.choice([3, 20, 60, 150])) for _ in range(25)]
    long = prose(rng, 3000)
    passage = prose(rng, 90)
    texts = [*base, base[3], base[3].replace(" ", "  ", 2), base[3].upper(), None, "", "   ", "\n\n", long, long + " end", "x" * 5000, "one"]
    texts += [prose(rng, 10) + " " + passage + " " + prose(rng, 10) for _ in range(6)]
    texts += [" ".join(w if k != 7 else "edit" for k, w in enumerate(t.split())) for t in base[5:12]]
    texts += ["\n".join([base[1], base[2], base[1], f"line {k} of the page that is nearly always the same {k}"]) for k in range(6)]
    return [(k, t) for k, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", 1, "d", 5, 6, 7, "k") for i, t in rows], SCHEMA)


def odd(rows):
    """The same with rows repeated, and rows without an id."""
    return [*rows, rows[0], rows[30], (None, "without an id " * 9), (None, None)]


def words(t, lower=False):
    raw = (t or "").encode()
    if lower:
        raw = raw.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    return raw.split()


def sha(b):
    return hashlib.sha256(b).hexdigest()


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_rolling_hashes_and_words():
    t = text.Texts.of(pa.array(["ab  cd", None, "", " x\ty\n", "é b"]))
    w = text.Words.of(t)
    data = t.data.tobytes()
    assert [data[s:e] for s, e in zip(w.starts, w.ends)] == [b"ab", b"cd", b"x", b"y", "é".encode(), b"b"]
    assert w.first.tolist() == [0, 2, 2, 2, 4, 6]
    h = w.hashes(t, True)
    assert len(set(h.tolist())) == 6
    r = text.Rolling(text.byte_values(np.frombuffer(b"abcabcab", np.uint8)))
    assert r.windows(3)[0] == r.windows(3)[3] != r.windows(3)[1]
    assert text.ranges(np.array([5, 9, 2]), np.array([2, 0, 3])).tolist() == [5, 6, 2, 3, 4]


def test_words_hash_alike_in_parts(monkeypatch):
    t = text.Texts.of(pa.array(["Ab  cd " * 9, None, "x" * 50 + " cd", "ab"]))
    w = text.Words.of(t)
    whole = [w.hashes(t, lower).tolist() for lower in (True, False)]
    monkeypatch.setattr(text, "HASH_BYTES", 7)
    assert [w.hashes(t, lower).tolist() for lower in (True, False)] == whole
    assert whole[0][0] == whole[0][-1] != whole[1][0] and whole[0][1] == whole[0][-2]


def test_packed_arrays():
    rng = np.random.default_rng(0)
    for values in ([], [0, 0], [1, 2**63 + 5], rng.integers(0, 1 << 62, 99)):
        values = np.array(values, dtype=np.uint64)
        assert (blocks.unpack_n(blocks.pack_n(values)) == values).all()
        values.sort()
        assert (blocks.unpack_sorted(blocks.pack_sorted(values)) == values).all()


@pytest.mark.parametrize("support", [0.001, 0.05, 0.9])
def test_exact_dedup(spark, support):
    rows = odd(corpus())
    key = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), k in zip(rows, key):
        groups.setdefault(k, []).append(i)
    want = []
    for (i, _), k in zip(rows, key):
        keep = min((x for x in groups[k] if x is not None), default=None)
        want.append((i, keep, len(groups[k]), i == keep, sha(k.encode())))
    got = rows_of(exact_dedup.exact_dedup(frame(spark, rows), support=support), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(want, key=repr)
    left = exact_dedup.keep_first(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    kept = sorted({(i, k) for i, _, _, ok, k in want if ok}, key=repr)
    assert Counter(i for i, _ in kept) == Counter(r["doc_id"] for r in left.collect())
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def shingles(t):
    w = words(t, True)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def groups_of(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_corpus():
    """A crowded family: copies of one text with few to many edits, so that buckets hold several groups."""
    rng = random.Random(11)
    base = prose(rng, 120).split()
    rows = corpus()
    for k in range(120):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["new" + str(rng.randrange(5))], [w[at], "more"]])
        rows.append((1000 + k, " ".join(w)))
    return rows


def test_minhash(spark):
    rows = near_corpus()
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    group = groups_of(sets, links)
    want = [(i, len(sets[i]), group[i], group[i] == i) for i, _ in rows]
    names = ("doc_id", "n_shingles", "component_id", "kept")
    assert rows_of(minhash.near_duplicates(frame(spark, rows)), *names) == sorted(want, key=repr)
    extra = [rows[0], (None, "without an id"), (None, None)]
    got = rows_of(minhash.near_duplicates(frame(spark, rows + extra)), *names)
    assert got == sorted([*want, want[0], (None, 1, None, True), (None, 0, None, True)], key=repr)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    left = minhash.keep_one(frame(spark, rows))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i in group if group[i] == i)


def test_banding_follows_the_threshold():
    assert minhash.banding(85) == (16, 4) and minhash.banding(80) == (22, 4)
    for percent in range(1, 101):
        bands, rows = minhash.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-5 and (rows == 1 or bands * rows <= minhash.MOST_PLACES)
    with pytest.raises(ValueError):
        minhash.banding(0)
    one = minhash.superminhash(np.array([0]), np.array([9], np.uint64), 1, 300)
    assert sorted(np.floor(one[0]).astype(int)) == list(range(300))


@pytest.mark.parametrize("percent", [50, 80])
def test_minhash_at_other_thresholds(spark, percent):
    rng = random.Random(percent)
    rows = []
    for k in range(0, 90, 3):  # one word of 60 replaced takes 5 of 56 shingles from both sides
        ws = prose(rng, 60).split()
        rows.append((k, " ".join(ws)))
        for j in (1, 2):
            at = [5 + 10 * x for x in range(1 + k // 3 % 3)]
            rows.append((k + j, " ".join(f"new{j}" if x in at else w for x, w in enumerate(ws))))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    assert any(100 * len(sets[a] & sets[b]) < 85 * len(sets[a] | sets[b]) for a, b in links)
    group = groups_of(sets, links)
    left = minhash.keep_one(frame(spark, rows), percent=percent)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i in group if group[i] == i)


def test_superminhash_estimates():
    rng = np.random.default_rng(5)
    shared, a, b = (rng.integers(0, 1 << 62, n, dtype=np.uint64) for n in (300, 40, 60))
    owner = np.repeat([0, 1], [340, 360])
    errors = []
    for seed in range(20):
        salt = np.uint64(seed * 7919 + 1)
        sig = minhash.superminhash(owner, text.mix(np.concatenate([shared, a, shared, b]) + salt), 2)
        errors.append(float((sig[0] == sig[1]).mean()) - 300 / 400)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < (0.75 * 0.25 / minhash.PLACES) ** 0.5 * 1.3
    assert np.isinf(minhash.superminhash(np.empty(0, int), np.empty(0, np.uint64), 1)).all()
    one = minhash.superminhash(np.array([0]), np.array([9], np.uint64), 1)
    assert sorted(np.floor(one[0]).astype(int)) == list(range(minhash.PLACES))  # each rank once


@pytest.mark.parametrize("chunk", [None, 10])
def test_components(spark, chunk):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(k, k + 1) for k in range(1000, 1400)] + [(2000, k) for k in range(2001, 2100)]
    want = groups_of({x for p in links for x in p}, links)
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(7), chunk)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in got.collect()} == {x: want[x] for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long"), chunk).count() == 0


def test_substring(spark):
    rows = odd(corpus())
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i, key=order)
    want = []
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - 12) if order(first[tuple(w[k : k + 13])]) < order(i) for j in range(13)}
        want.append((i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    out = substring.remove_repeats(frame(spark, rows).repartition(5))
    assert rows_of(out, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert all((r["n_factors"] > 0) == (r["n_removed"] > 0) for r in out.collect())
    assert substring.remove_repeats(frame(spark, [])).count() == 0


def test_removed_words_come_from_factors():
    """A stretch that the index names is removed as far as the reference's own words go along, and no further."""
    own = [b"w%d" % k for k in range(40)]
    assert list(substring.factors(own, own, 13)) == [(0, 40)]
    assert list(substring.factors(own[:12], own[:12], 13)) == []
    other = [*own[:20], b"x", *own[21:30], b"y", *own[31:]]
    assert list(substring.factors(own, other, 13)) == [(0, 20)]  # the rest agrees on 9 words and on 9
    assert list(substring.factors(own, [b"z", *own[1:]], 13)) == [(1, 39)]
    texts = text.Texts.of(pa.array(["a b", " ".join(x.decode() for x in own)]))
    stretch = np.array([[1], [2], [40], [0], [5]], "<i8").tobytes()  # all of the second text, from word 5 of page 0 on
    for reference, removed, found in ((own, 40, 1), (other, 20, 1), ([b"q"] * 40, 0, 0)):
        pages = [b" ".join([b"p"] * 5 + reference[:27]), b" ".join(reference[27:])]
        out = next(substring._finish(13)(blocks.Block(7, [1, 2], texts), [[(0, stretch)], list(enumerate(pages))]))
        assert out.column(2).to_pylist() == [0, removed] and out.column(4).to_pylist() == [0, found]


def test_messages_follow_the_keys():
    """A block sends no message without a key in it, however many ranges there are."""
    keys = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2))
    for n in (1, 7, 1000, 100_000):
        edges = blocks.range_edges(keys, n)
        assert edges[0] == 0 and edges[-1] == 500 and (edges[:-1] < edges[1:]).sum() <= min(n, 500)
        assert all((keys[edges[r] : edges[r + 1]].astype(object) * n >> 64 == r).all() for r in np.flatnonzero(edges[:-1] < edges[1:])[:50])


def repeated(texts, length):
    count = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(t) else 0
        yield len(t), int(gone.sum()), spans, sha(np.frombuffer(t, np.uint8)[~gone].tobytes())


@pytest.mark.parametrize("length, hot", [(400, 100_000), (400, 2), (120, 100_000), (120, 3)])
def test_suffix_dedup(spark, length, hot):
    rows = odd(near_corpus())
    want = [(i, *x) for (i, _), x in zip(rows, repeated([(t or "").encode() for _, t in rows], length))]
    out = suffix_dedup.remove_repeated_bytes(frame(spark, rows).repartition(3), length, hot)
    assert rows_of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    if hot == 2:
        assert suffix_dedup.remove_repeated_bytes(frame(spark, []), length).count() == 0


def test_loser_tree():
    rng = random.Random(2)
    for k in (0, 1, 2, 5, 8):
        runs = [sorted({bytes(rng.choices(b"ab", k=rng.randrange(12))) for _ in range(rng.randrange(20))}) for _ in range(k)]
        coded = [suffix_dedup.encode_run(r) for r in runs]
        assert [suffix_dedup.decode_run(c)[0] for c in coded] == runs
        order, shared = suffix_dedup.loser_tree_merge([suffix_dedup.decode_run(c) for c in coded])
        merged = [runs[r][j] for r, j in order]
        assert merged == sorted(x for r in runs for x in r)
        assert shared[1:] == [suffix_dedup.common_prefix(a, b, 0) for a, b in zip(merged, merged[1:])]


def distance(pattern, stretch):
    row = [0] * (len(stretch) + 1)
    for i, c in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(stretch, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def test_myers_and_pieces():
    rng = random.Random(4)
    for _ in range(200):
        p, s = ("".join(rng.choices("abc", k=n)) for n in (rng.randrange(1, 14), rng.randrange(0, 30)))
        budget = rng.randrange(6)
        best, hit = distance(p, s), decontaminate.myers(p, s, budget)
        # A match that is empty has no end in the text and is not reported.
        assert hit is None if best > budget else hit is None and best == len(p) or hit[0] == best
    assert decontaminate.pieces(10, 2) == [(0, 3), (3, 6), (6, 10)]


def test_decontaminate(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, 20)) for k in range(6)] + [(90, "too short"), (91, None), (92, "")]

    def edited(t, n):
        t = list(t)
        for _ in range(n):
            t[rng.randrange(len(t))] = rng.choice(["", "#", "ab"])
        return "".join(t)

    docs = [(k, prose(rng, 40) + "  " + edited(items[k % 6][1].upper(), n) + "\n" + prose(rng, 30)) for k, n in enumerate([0, 1, 3, 6, 20, 60] * 3)]
    docs += [(50 + k, prose(rng, 80)) for k in range(5)] + [(70, None), (71, ""), (72, items[0][1] * 300)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in docs:
        for k, item in items[:6]:
            norm = decontaminate.normalise(item)
            d = distance(norm, decontaminate.normalise(t)) if len(t or "") < 5000 else (0 if norm in decontaminate.normalise(t) else 99)
            if d <= len(norm) // decontaminate.CHARS_PER_EDIT:
                want.add((i, k, d))
    got = decontaminate.decontaminate(frame(spark, docs), bench)
    assert set(rows_of(got, "doc_id", "item_id", "distance")) == want and len(want) > 10
    clean = decontaminate.keep_uncontaminated(frame(spark, docs), bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {i for i, _, _ in want}
    assert decontaminate.decontaminate(frame(spark, docs), bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(frame(spark, []), bench).count() == 0


def test_short_items_match_exactly_as_whole_words(spark):
    items = [(1, "Blue  Whale"), (2, "c++"), (3, "x" * 23), (4, "y" * 24), (5, " "), (6, None), (7, "")]
    docs = [
        (0, "a blue whale"), (1, "BLUE\nWHALE, he said"), (2, "blue whales swim"), (3, "blue whales; a blue whale"), (4, "a blue whele"), (5, None),
        (6, "in c++17 or c++."), (7, "objc++"), (8, "(" + "x" * 23 + ")"), (9, "x" * 24), (10, "x" * 22), (11, "y" * 23), (12, ""),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(decontaminate.decontaminate(frame(spark, docs), bench), "doc_id", "item_id", "distance", "start", "end")
    short = [(0, 1, 0, 2, 12), (1, 1, 0, 0, 10), (3, 1, 0, 15, 25), (6, 2, 0, 3, 6), (8, 3, 0, 1, 24)]
    assert [r for r in got if r[1] != 4] == sorted(short, key=repr)
    assert {(r[0], r[2]) for r in got if r[1] == 4} == {(11, 1)}
    clean = decontaminate.keep_uncontaminated(frame(spark, docs), bench)
    assert {r["doc_id"] for r in clean.collect()} == {2, 4, 5, 7, 9, 10, 12}


def test_benchmark_slices(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_CHARS", 300)
    rng = random.Random(8)
    bench = spark.createDataFrame([(k, prose(rng, 15)) for k in range(12)], "item_id long, text string")
    docs = frame(spark, [(k, "so " + r["text"] + " it is") for k, r in enumerate(bench.collect())])
    assert len(list(decontaminate.slices(bench))) == decontaminate.n_slices(bench) > 3
    assert decontaminate.keep_uncontaminated(docs, bench).count() == 0
    assert rows_of(decontaminate.decontaminate(docs, bench), "doc_id", "item_id", "distance") == sorted([(k, k, 0) for k in range(12)], key=repr)


def test_lm(spark):
    rows = odd(corpus())
    tokens = [(i, [*words(t, True), b"\n"]) for i, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
    count = Counter(w for (_, ws), h in zip(tokens, held) if not h for w in ws)
    total, distinct = sum(count.values()), len(count)
    got = lm.score_documents(frame(spark, rows).repartition(4)).collect()
    want = []
    for (i, ws), h in zip(tokens, held):
        base = sum(np.log10((count[w] + 1) / (total + distinct + 1)) for w in ws)
        want.append((i, h, len(ws), sum(w in count for w in ws), total, round(base, 6)))
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    assert sorted((*(r[n] for n in names), round(r["base_score"], 6)) for r in got if r["doc_id"] is not None) == sorted(x for x in want if x[0] is not None)
    assert Counter((r["n_tokens"], round(r["base_score"], 6)) for r in got) == Counter((x[2], x[5]) for x in want)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert lm.score_documents(frame(spark, [])).count() == 0


def test_lm_scores_by_brute_force(spark):
    """The model from plain counts: leave-one-out cells on the grid, weights by EM over them, mixed estimates of each token."""
    rows = odd(corpus())
    texts = [(i, [*words(t, True), None], zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2) for i, t in rows]
    one, two, begun = Counter(), Counter(), 0
    for _, ws, held in texts:
        if not held:
            one.update(ws)
            two.update(zip(["begin", *ws], ws))
            begun += 1
    total, distinct = sum(one.values()), len(one)
    seen = lambda c: begun if c == "begin" else one[c]
    level = lambda n: int(np.log2(n)) + 1 if n > 0 else 0
    code = lambda x: round(lm.STEPS * np.log2(x)) + 512 if x > 0 else lm.NONE
    cells = Counter({-1: total, -2: distinct})
    for _, ws, held in texts:
        for c, w in zip(["begin", *ws], ws) if not held else ():
            n, k, m = seen(c) - 1, two[c, w] - 1, one[w] - 1
            cells[level(n) << 20 | code(k / n if n and k else 0) << 10 | code(m)] += 1
    weights, _, _ = lm.learn_weights(cells)
    want = []
    for i, ws, _ in texts:
        score = 0.0
        for c, w in zip(["begin", *ws], ws):
            a, b, u = weights[level(seen(c))]
            score += np.log10(a * two[c, w] / max(seen(c), 1) + b * one[w] / total + u / (distinct + 1))
        want.append((i, round(score, 5)))
    got = [(r["doc_id"], round(r["score"], 5)) for r in lm.score_documents(frame(spark, rows).repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_lm_is_a_distribution(spark):
    """Probabilities of all continuations of a context add up to one, unknown words as one class."""
    docs = [(0, "a b a c"), (1, "a b b"), (3, "c a b")]
    docs = [(i, t) for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    probes = [(100 + k, t) for k, t in enumerate(["a", "b", "c", "zzz", ""])]
    out = lm.score_documents(frame(spark, docs + probes), folds=7, held=9)  # all are training
    assert out.count() == len(docs) + 5
    w, total, distinct = lm.learn_weights({-1: 0, -2: 0})
    assert w[0].sum() == pytest.approx(1) and (total, distinct) == (0, 0)
    w, _, _ = lm.learn_weights({-1: 10, -2: 4, (2 << 20) | (510 << 10) | 512: 6, (1 << 20) | (lm.NONE << 10) | 514: 2, (0 << 20) | (lm.NONE << 10) | lm.NONE: 2})
    assert np.allclose(w.sum(axis=1), 1) and w[2, 0] > 0.5 and w[0, 0] == 0


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(spark, capacity):
    rows = odd(corpus())
    path = tokenizer.default_path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    ids = [(i, [*own.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]
    out = packing.pack_documents(frame(spark, rows), path, capacity).collect()
    want = []
    for i, x in ids:
        for k, (a, n) in enumerate(packing.cut(len(x), capacity)):
            want.append((i, k, a, n, zlib.crc32(np.array(x[a : a + n], "<u4").tobytes())))
            assert n == capacity or k == 0
        assert sum(r[3] for r in want[-k - 1 :]) == len(x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(bins) == len(packing.best_fit(np.array([r["length"] for r in out]), capacity)[2])
    assert packing.pack_documents(frame(spark, []), path).count() == 0


def test_packing_in_rounds(spark):
    rng = random.Random(9)
    items = [(k, rng.choice([rng.randrange(1, 60), rng.randrange(400, 1024), rng.randrange(1, 1025)])) for k in range(3000)]
    df = spark.createDataFrame(items, "item long, size long")
    out = packing.pack_items(df, 1024, items_per_task=200).collect()
    sizes, bins = dict(items), {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], sizes[r["item"]]))
    assert len(out) == 3000
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    whole = len(packing.best_fit(np.array([n for _, n in items]), 1024)[2])
    assert len(bins) <= whole * 1.02 + 1


def test_tokenizer_equals_its_library():
    from tokenizers import Tokenizer

    path = tokenizer.default_path("byte_bpe_50k.json")
    own, fast = Tokenizer.from_file(path), tokenizer.encoder(path)
    rng = random.Random(10)
    texts = ["", " ", "a  b\t\n c", "don't we'll 12345 ÄÖÜ é", "日本語 text", "x" * 3000, "a<|endoftext|>b", "  z", "🙂🙂 ok"]
    texts += ["".join(rng.choices("abc 'sé\n\t1.?🙂", k=60)) for _ in range(200)]
    for t in texts:
        assert fast(t).tolist() == own.encode(t, add_special_tokens=False).ids
    tik = tokenizer.encoder(tokenizer.default_path("byte_bpe_50k.tiktoken"))
    assert tik("plain text 1").tolist() == own.encode("plain text 1", add_special_tokens=False).ids


def test_token_rollup(spark, tmp_path):
    names = {n: tokenizer.default_path(f"{n}.tiktoken") for n in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    encoders = {n: tokenizer.encoder(p) for n, p in names.items()}
    docs = [(t, rng_source) for (_, t), rng_source in zip(corpus(), ["hot", "hot", "a", None] * 30)]

    def changes(rows):
        return spark.createDataFrame([(s, "en", sign, t) for t, s, sign in rows], "source string, lang string, sign int, text string")

    def direct(rows):
        total = {}
        for t, s, sign in rows:
            for n, e in encoders.items():
                x = total.setdefault((s, "en", n), [0, 0, 0])
                x[0] += sign
                x[1] += sign * len(e(t or ""))
                x[2] += sign * len((t or "").encode())
        return sorted(((*k, *v) for k, v in total.items() if any(v)), key=repr)

    rollup = token_counts.TokenRollup(spark, str(tmp_path / "r"), names)
    assert rollup.totals().count() == 0
    one = [(t, s, 1) for t, s in docs]
    two = [(docs[0][0], docs[0][1], -1), ("its revised text", docs[0][1], 1), (docs[2][0], docs[2][1], -1)]
    three = [(t, s, -1) for t, s in docs if s is None]
    columns = ("source", "lang", "tokenizer", "n_docs", "n_tokens", "n_bytes")
    for batch, rows, so_far in (("b1", one, one), ("b2", two, one + two), ("b3", three, one + two + three)):
        assert rollup.commit(batch, changes(rows), sign_col="sign")
        assert not rollup.commit(batch, changes(rows), sign_col="sign")
        assert rows_of(rollup.totals(), *columns) == direct(so_far)
    assert rollup.batches() == ["b1", "b2", "b3"]
    rollup.commit("empty", changes([]).limit(0), sign_col="sign")
    assert rows_of(rollup.totals(), *columns) == direct(one + two + three)
    (tmp_path / "r" / "batch=b4").mkdir()  # a try that failed before its end
    assert rows_of(rollup.totals(), *columns) == direct(one + two + three)
    with pytest.raises(ValueError):
        rollup.commit("../x", changes(one))
    # Compaction changes no total and forgets no batch; a batch folder goes with the compaction after the one that replaced it.
    assert rollup.compact() and not rollup.compact()
    (tmp_path / "r" / "snapshot=7").mkdir()  # one that failed before its end
    assert rows_of(rollup.totals(), *columns) == direct(one + two + three)
    assert rollup.commit("b5", changes(three), sign_col="sign") and not rollup.commit("b1", changes(one), sign_col="sign")
    assert rows_of(rollup.totals(), *columns) == direct(one + two + three + three)
    planned = rollup.totals()
    assert rollup.compact()
    assert rows_of(planned, *columns) == rows_of(rollup.totals(), *columns) == direct(one + two + three + three)
    assert not (tmp_path / "r" / "batch=b1").exists() and (tmp_path / "r" / "batch=b5").exists()
    assert not rollup.commit("b1", changes(one), sign_col="sign") and rollup.batches() == ["b1", "b2", "b3", "b5", "empty"]


def brute_lines(rows):
    """The definition: a line goes if an earlier one is the same, or one word edit away with both long enough."""
    placed = []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            placed.append((i, line.split()))
    number, out, seen = Counter(), {}, []
    for i, ws in placed:
        k = number[i]
        number[i] += 1
        if ws:
            gone = any(ws == o or (min(len(ws), len(o)) >= line_dedup.MIN_WORDS and one_edit(ws, o)) for o in seen)
            if gone:
                out.setdefault(i, []).append(str(k))
            seen.append(ws)
    return sorted((i, number[i], len(out.get(i, [])), ",".join(out.get(i, []))) for i, _ in rows)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    m = 0
    while m < min(len(a), len(b)) and a[-1 - m] == b[-1 - m]:
        m += 1
    return n + m >= max(len(a), len(b)) - 1


def test_line_dedup(spark):
    rng = random.Random(12)
    rows = corpus()
    base = [prose(rng, n).split() for n in (8, 9, 12, 15, 16, 30, 32, 7)]
    for k in range(90):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            w = list(rng.choice(base))
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["new"], [w[at], "more"], [w[at]]])
            lines.append(" ".join(w))
        rows.append((100 + k, "\n".join(lines)))
    for k, n in enumerate((254, 255, 256, 257, 258, 700, 4000)):  # around the length where keys are made another way
        w = prose(rng, n).split()
        for j, at in enumerate((0, n // 2, n - 1, n // 3, n // 3 + 1)):
            edited = [*w[:at], *rng.choice([[], ["new"], [w[at], "more"]]), *w[at + 1 :]]
            rows.append((300 + 20 * k + j, " ".join(edited)))
        rows.append((299 + 20 * k, " ".join(w)))
        rows.append((318 + 20 * k, " ".join([*w[:3], "two", *w[3:-5], "more", *w[-5:]])))
    rows.sort()
    names = ("doc_id", "n_lines", "n_removed", "removed")
    assert sorted(rows_of(line_dedup.line_report(frame(spark, rows)), *names)) == brute_lines(rows)
    left = {r["doc_id"]: r["text"] for r in line_dedup.remove_lines(frame(spark, rows)).collect()}
    for i, _, n, removed in brute_lines(rows):
        if n and i >= 100:
            lines = dict(rows)[i].split("\n")
            assert left[i] == "\n".join(x for k, x in enumerate(lines) if str(k) not in removed.split(","))
    twice = line_dedup.line_report(frame(spark, [*rows, rows[0], (None, "a b c\na b c"), (None, None)]))
    assert twice.count() == len(rows) + 3
    assert {(r["n_lines"], r["n_removed"]) for r in twice.filter("doc_id IS NULL").collect()} == {(2, 1), (1, 0)}
    assert line_dedup.line_report(frame(spark, [])).count() == 0


def test_toxicity(spark):
    rng = random.Random(13)
    bad = ["vilewort", "nastling"]
    docs, labels = [], []
    for k in range(1200):
        w = prose(rng, rng.choice([8, 40, 120])).split()
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((k, " ".join(w)))
        if k % 2:
            labels.append((k, int(toxic), toxic))
    docs += [(5000, None), (5001, ""), (None, "no id"), (5002, "vilewort " * 20000), docs[3]]
    marks = spark.createDataFrame([(i, t, "x") for i, t, _ in labels] + [(None, 1, "x"), (7, None, "x")], "doc_id long, toxic int, text string")
    out = toxicity.score_documents(frame(spark, docs), marks).collect()
    assert len(out) == len(docs)
    truth = {k: any(b in t for b in bad) for k, t in docs[:1200]}
    test = [r for r in out if r["doc_id"] in truth and r["held_out"]]
    assert np.mean([bool(r["predicted"]) == truth[r["doc_id"]] for r in test]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out if r["doc_id"] is not None)
    kept = toxicity.keep_clean(frame(spark, docs), marks)
    assert kept.count() == sum(1 - r["predicted"] for r in out)
    none = toxicity.score_documents(frame(spark, docs), marks.limit(0))
    assert {r["score"] for r in none.collect()} == {0.0}
    assert toxicity.score_documents(frame(spark, []), marks).count() == 0


def test_document_counts_do_not_depend_on_tasks():
    """A term that is in one text of each task counts as often as in one task that holds all texts."""
    rng = random.Random(21)
    texts = [prose(rng, 12) + " vilewort" for _ in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array([t]), pa.array([k % 2], pa.int32())], names=["text", "positive"]) for k, t in enumerate(texts)]

    def summed(tasks):
        out = Counter()
        for task in tasks:
            for part in toxicity._document_counts(iter(task)):
                for slot, u, p in zip(*(part.column(c).to_pylist() for c in range(3))):
                    out[slot, 0] += u
                    out[slot, 1] += p
        return +out

    whole = summed([batches])
    assert summed([[b] for b in batches]) == summed([batches[:7], batches[7:]]) == whole
    want = Counter((slot, k % 2) for k, t in enumerate(texts) for slot in toxicity.features(text.Texts.of(pa.array([t])))[1].tolist())
    assert whole == want and max(whole.values()) == 20


def test_nnpu_steps_back_when_the_risk_turns_negative():
    rng = np.random.default_rng(1)
    pos = toxicity._Sparse([np.array([0, 1 + rng.integers(50)]) for _ in range(30)], 60)
    unl = toxicity._Sparse([np.array([0, 51]) if k < 20 else np.array([52 + rng.integers(8)]) for k in range(100)], 60)
    w, c = toxicity.nnpu_fit(pos, unl, 0.2)
    assert w[0] > 1 and np.isfinite(w).all() and np.isfinite(c)


def test_sieve(spark):
    """Keys always pass, few others do, and rows go only where the condition holds."""
    df = spark.createDataFrame([(k, f"t{k}", "x") for k in range(3000)] + [(None, "n", "x")], "id long, text string, key string")
    keys = spark.createDataFrame([(k,) for k in range(0, 3000, 10)] + [(None,)], "key long")
    got = sieve.marked(df, df["id"], keys).collect()
    passed = {r["id"] for r in got if r["__may"]}
    assert len(got) == 3001 and {None, *range(0, 3000, 10)} <= passed and len(passed) < 600
    assert not any(r["__may"] for r in sieve.marked(df, df["id"], keys.limit(0)).collect())
    gone = keys.selectExpr("key", "key AS other").filter("key % 20 = 0 OR key IS NULL")
    left = sieve.without(df, df["id"], gone, df["id"] == gone["other"])
    assert left.columns == df.columns and {r["id"] for r in left.collect()} == {None, *range(3000)} - set(range(0, 3000, 20))


def test_release_keeps_the_last_table(spark):
    df = spark.range(5)
    before = store.mark()
    first, second = store.write_table(df, "first"), store.write_table(df, "second")
    store.write_bucketed(df, "third-b", 2, "id")
    last = store.write_table(second, "last")
    store.release(before, keep_last=True)
    assert last.count() == 5 and len(store._written) == before[0] + 1 and len(store._named) == before[1]
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        first.collect()
    store.release(before)


def test_crowded_pivots(spark):
    """Many different near copies of one text: the pivot's pairs are dealt over copies of its set, and no link is lost."""
    rng = random.Random(12)
    ws = prose(rng, 150).split()
    rows = [(k, " ".join(f"own{k}" if x == 7 + k % 130 else w for x, w in enumerate(ws))) for k in range(5 * minhash.CROWD)]
    rows += [(10_000 + k, prose(rng, 40)) for k in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: 0 if i < 10_000 else i for i, _ in rows}


def test_strings_of_one_key_are_told_apart():
    """A first hash of two bits: equal keys, different strings."""
    rng = np.random.default_rng(8)
    one, two = rng.integers(0, 4, 500).astype(np.uint64), rng.integers(0, 50, 500).astype(np.uint64)
    want = {}
    for p in zip(one.tolist(), two.tolist()):
        want[p] = want.get(p, 0) + 1
    at, inverse, counts = suffix_dedup.distinct_pairs(one, two)
    assert [(int(one[k]), int(two[k])) for k in at] == sorted(want)
    assert (one[at][inverse] == one).all() and (two[at][inverse] == two).all()
    keys, values = one[at], np.array([counts.astype(np.uint64), two[at]])
    both = np.concatenate([keys, keys])  # two blocks
    order = np.argsort(both, kind="stable")
    new = np.append(True, both[order][1:] != both[order][:-1])
    planes = np.concatenate([values, values], axis=1)[:, order]
    found = suffix_dedup.same_strings(np.cumsum(new) - 1, np.flatnonzero(new), planes)
    assert found.shape == (1, len(both))
    assert found[0].tolist() == [2 * want[int(a), int(b)] for a, b in zip(both[order], planes[1])]
    empty = np.empty(0, np.uint64)
    assert [len(x) for x in suffix_dedup.distinct_pairs(empty, empty)] == [0, 0, 0]
