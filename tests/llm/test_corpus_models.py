"""Spelling variants, the prefix trie and language-model scores against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same
from vistaloom.llm import language_model, ngram_join, prefix_trie, queries, spelling_variants, substring_dedup
from vistaloom.llm.util import Words

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
low = lambda t: (t or "").translate(AZ)
CLASH = {"n": 7, "word": "x", "bucket": 3, "chunk": 1, "kind": 9, "depth": 2, "key": "k", "held_out": "h", "length": "l", "size": 1, "pos": 4, "digest": "d"}


def clashing(df):
    """df with columns named like those inside the operators."""
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


# ---- word hashes ---------------------------------------------------------------------------------------------


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_long_words_of_a_pattern_are_told_apart(spark):
    import pyarrow as pa

    pairs = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (1024, 2048, 4096)]
    assert len(set(Words(pa.array([f"{x} {y}" for x, y in pairs])).hashes().tolist())) == 6
    rows = [(10 * i + j, f"a b c d {t}") for i, (x, y) in enumerate(pairs) for j, t in enumerate((x, y, x))]
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - 2 if d % 10 == 2 else d for d, _ in rows}
    head = " ".join(f"w{i}" for i in range(34))
    rows = [(10 * i + j, f"{head} {t}") for i, (x, y) in enumerate(pairs) for j, t in enumerate((x, y))] + [(98, f"{head} z"), (99, f"{head} z")]
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: 35 if d > 90 else 0 for d, _ in rows}


def test_runs_of_words_have_a_bound(spark):
    with pytest.raises(ValueError):
        Words(__import__("pyarrow").array(["a b"])).grams(513)


# ---- spelling variants ---------------------------------------------------------------------------------------


def variants(counts):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in counts.items():
        own = [o for o in counts if near(w, o)]
        best = min(own, key=lambda o: (-counts[o], o), default=None)
        form = best if best and counts[best] >= 2 * n else None
        out[w] = (form, n, len(own), counts[form] if form else None)
    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w
    return {(w, f, root(w), n, k, fn) for w, (f, n, k, fn) in out.items()}


@pytest.mark.parametrize(("group", "letters"), [(spelling_variants.GROUP, "ab"), (1, "aé"), (4, "abcdefgh")])
def test_variants_of_dense_vocabularies(spark, group, letters):
    rng = random.Random(5)
    words = {"".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 5, 6, 6, 7, 8, 9]))): rng.randint(1, 40) for _ in range(250)}
    words |= {"a" * n: n for n in range(1, 12)} | {"a" * 300: 5, "a" * 301: 11, "a" * 150 + "b" + "a" * 150: 30}
    got = spelling_variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"), group=group)
    assert {tuple(r) for r in got.collect()} == variants(words)
    assert got.count() == len(words)


def test_vocabulary(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["Straße", "STRAßE", "straÞe", "naïve", "nAIve", "colour", "colours", "Čapek", "abc", "x_y_colour9colour"]) + rng.choice(["", "s", ",", "1"]) for _ in range(60))) for i in range(40)]
    rows += [(100, None), (101, ""), (None, "colour " * 5), (102, "ab" * 5000 + " " + "ab" * 5000 + " " + "ab" * 5000), rows[0], (103, "×÷ÿÀ× " * 4), (104, "\n\t 1 2")]
    want = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = low(run)
            h = zlib.crc32(f"{d}:{w}".encode())
            if d is not None and h % 3 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] += 1
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.word: r.n for r in spelling_variants.vocabulary(docs, by=3).collect()}
    assert got == want
    assert {tuple(r) for r in spelling_variants.spelling_variants(docs, by=3).collect()} == variants(want)
    assert spelling_variants.spelling_variants(docs.limit(0)).count() == 0 == spelling_variants.spelling_variants(docs.where("text IS NULL")).count()


# ---- prefix trie ---------------------------------------------------------------------------------------------


def nodes_of(convs):
    """Nodes of {conv_id: [(role, text)]} by plain dictionaries."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, spare = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            spare[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], spare[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()}


def in_order(rows):
    out = defaultdict(list)
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
    rows = [(c, n, r or "", t or "") for c, n, r, t in rows if c is not None]
    for c, n, r, t in sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or 0, digest(x[2], x[3]))):
        out[c].append((r, t))
    return dict(out)


def rebuilt(convs, by, most):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % most
        out[c] = convs.get(int(c - math.fmod(c, by)), [])[:h] + own[h:]
    return out


@pytest.fixture(scope="module")
def told():
    rng = random.Random(3)
    rows = []
    for c in [*range(-12, 60), 10**12, 10**12 + 1]:
        if c in (20, 35, 36):  # absent ones that others begin with
            continue
        start = rng.randint(0, 2)
        for n in range(rng.choice([1, 1, 2, 3, 5, 8, 12])):
            rows.append((c, n, rng.choice(["user", "assistant"]), f"é{start if n == 0 else rng.randint(0, 1)}" * (n % 3 + 1)))
    rows += [(61, None, None, None), (61, None, "user", "x"), (61, 0, "user", None), (61, 0, "user", None), (62, 5, "a:", "b"), (63, 5, "a", ":b"), (None, 0, "user", "lost"), (64, 0, "user", "y" * 100_000)]
    rows += [(c, n, "user", f"same {n}") for c in range(100, 160) for n in range(4)]  # copies
    rows += [(c, n, "user", f"t{n}" if n < c - 199 else f"own {c}") for c in range(200, 230) for n in range(c - 198)]  # each hangs on the one before
    rows += [(300, n, "user", f"long {n % 7}") for n in range(700)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [prefix_trie.HOT, 3])
def test_prefix_trie(spark, told, monkeypatch, hot):
    monkeypatch.setattr(prefix_trie, "HOT", hot)
    table = clashing(spark.createDataFrame(told, "conv_id long, turn long, role string, text string"))
    own = in_order(told)
    got = prefix_trie.rebuilt_trie(table).collect()
    assert {tuple(r) for r in got} == (want := nodes_of(rebuilt(own, 5, 9))) and len(got) == len(want)
    if hot == prefix_trie.HOT:
        got = prefix_trie.prefix_trie(table).collect()
        assert {tuple(r) for r in got} == (want := nodes_of(own)) and len(got) == len(want)
        assert prefix_trie.rebuilt_trie(table.limit(0)).count() == 0


def test_each_depth_is_probed_in_the_round_that_follows_from_the_length():
    import pyarrow as pa

    for length in range(12):
        (out,) = prefix_trie._rounds([pa.record_batch([pa.array(range(length + 1)), pa.array([length] * (length + 1))], ["depth", "length"])])
        rounds = out.column("round").to_pylist()
        for first in range(length + 2):
            lo, hi, n = 0, length + 1, 0
            while lo < hi:
                mid = (lo + hi) // 2
                assert rounds[mid] == n
                lo, hi, n = (lo, mid, n + 1) if mid >= first else (mid + 1, hi, n + 1)
            assert lo == first


# ---- language model ------------------------------------------------------------------------------------------


def test_mixture_weight_is_the_likeliest():
    rng = np.random.default_rng(4)
    n, ratio = rng.integers(1, 50, 40).astype(float), np.r_[0.0, rng.lognormal(0, 2, 39)]
    w = language_model.mixture_weight(n, ratio)
    loss = lambda w: -(n * np.log(w * ratio + 1 - w)).sum() - np.log(w) - np.log(1 - w)
    assert loss(w) <= min(loss(w + 1e-4), loss(w - 1e-4)) and 0 < w < 1


def plain_model(rows, learnt, aside, order):
    """The same model by dictionaries of tuples, with the weights by the library's function over single tokens."""
    tokens = [[*re.findall("[^\x20\x09-\x0d]+", low(t)), None] for _, t in rows]

    def counts(which):
        out = Counter()
        for w, on in zip(tokens, which):
            if on:
                padded = [0] * (order - 1) + w
                out.update(tuple(padded[i + order - 1 - k : i + order]) for i in range(len(w)) for k in range(order))
        for k in range(1, order):
            out[(0,) * k] = out[(None,)]
        known = [g for g in out if len(g) == 1 and g != (0,)]
        return out, len([g for g in known if out[g]]), sum(out[g] for g in known)

    def levels(w, i, c, v, n, weights):
        padded = [0] * (order - 1) + w
        p = [1 / (v + 1)]
        for k in range(len(weights) + 1):
            gram = tuple(padded[i + order - 1 - k : i + order]) if k < order else None
            if gram is None:
                break
            context = n if k == 0 else c[gram[:-1]]
            f = c[gram] / context if context else 0.0
            b = min(context.bit_length(), language_model.LEVELS - 1)
            if k == len(weights):
                return p, b, f
            p.append(weights[k].get(b, 0.0) * f + (1 - weights[k].get(b, 0.0)) * p[-1])
        return p, None, None

    kept, v, n = counts([a and not b for a, b in zip(learnt, aside)])
    weights = []
    for _ in range(order):
        ratios = defaultdict(list)
        for w, on in zip(tokens, aside):
            for i in range(len(w)) if on else ():
                p, b, f = levels(w, i, kept, v, n, weights)
                ratios[b].append(f / p[-1])
        ratios.pop(0, None)
        learnt_w = {b: language_model.mixture_weight(np.ones(len(r)), np.array(r)) for b, r in ratios.items()}
        full = {}
        for b in range(1, language_model.LEVELS):
            below = [x for x in learnt_w if x <= b]
            full[b] = (learnt_w[max(below)] if below else learnt_w[min(learnt_w)]) if learnt_w else 0.5
        weights.append(full)
    whole, v, n = counts(learnt)
    out = []
    for w in tokens:
        base = sum(math.log10((whole[(t,)] + 1) / (n + v + 1)) for t in w)
        score = sum(math.log10(levels(w, i, whole, v, n, weights)[0][-1]) for i in range(len(w)))
        out.append((len(w), sum(whole[(t,)] > 0 for t in w), n, base, score))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(40)], k=rng.randint(0, 60)))) for i in range(150)]
    rows += [(200 + i, "The same TEXT again and again") for i in range(20)] + [(300, None), (301, ""), (302, " \n"), (None, "no id at all"), (303, "w1 " * 3000), rows[3], (304, "unheard of words é")]
    return rows


@pytest.mark.parametrize("order", [1, 3])
def test_scores(spark, texts, order, monkeypatch):
    monkeypatch.setattr(language_model, "CHUNK", 2000)
    docs = clashing(spark.createDataFrame(texts, "doc_id long, text string")).repartition(3)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    got = language_model.score(docs, fold != 2, fold == 2, order=order).collect()
    aside = {(r.doc_id, r.text): r.a for r in docs.select("doc_id", "text", (F.pmod(F.xxhash64(F.lit(13), "doc_id", "text"), F.lit(language_model.HELD)) == 0).alias("a")).collect()}
    learnt = [d is not None and zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in texts]
    want = plain_model(texts, learnt, [a and aside[r] for a, r in zip(learnt, texts)], order)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5])
    want = sorted([(d, d is not None and not a, *w) for (d, _), a, w in zip(texts, learnt, want)], key=key)
    got = sorted([tuple(r) for r in got], key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=2e-3, atol=1e-6)
    assert np.allclose([r[5] for r in got], [r[5] for r in want])


def test_scores_without_anything_to_learn(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = language_model.score(docs, F.lit(False), F.lit(True)).collect()
    assert len(out) == len(texts) and all(r.base_score == 0 == r.score and r.n_known == 0 == r.train_tokens for r in out)
    assert language_model.score(docs.limit(0), F.lit(True), F.lit(False)).count() == 0


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    out = queries.op13_lm_scoring(spark, "/root/testdata/sf0.01").groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).collect()
    assert all(r.s > 0.9 * r.b for r in out) and len(out) == 2


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_prefix_trie"])
def test_new_queries_match_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, queries.QUERIES[name], queries.ORACLE[name])
