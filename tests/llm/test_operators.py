"""Each operator against brute force on small tables with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vistaloom.llm import chat_format, classify, decontaminate, exact_dedup, graph, ngram_join, packing, queries, sharding, substring_dedup, tokens

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()
SPACE = "[^\x20\x09-\x0d]+"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "é", "x1", "omega", "pi", "rho", "sigma"]) + str(rng.randint(0, 40)) for _ in range(n))


def table():
    rng = random.Random(7)
    base = [words(rng, rng.randint(1, 120)) for _ in range(25)]
    long = words(rng, 4000)
    passage = words(rng, 45)
    near = base[3].split(" ")
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(30, base[3].upper()), (31, base[3].lower()), (32, None), (33, ""), (34, "  \n\t"), (35, long), (36, long + " tail"), (37, "one"), (38, "ONE"), (39, "a b c d"), (40, "a b c d")]
    rows += [(50 + i, words(rng, 30) + " " + passage + " " + words(rng, 30)) for i in range(6)] + [(60, passage + " " + passage), (61, " ".join([*near, "extra"])), (None, base[4]), (None, None), (7, base[7]), (7, base[7])]
    return rows


EXTRA = "record string, digest long, bytes string, name string, row int, n int, key int, score double, bucket int, hits string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "r", 1, "b", "n", 1, 2, 3, 0.5, 4, "h", "en") for d, t in table()]
    return spark.createDataFrame(rows, "doc_id long, text string, " + EXTRA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, " + EXTRA)


def low(t):
    return (t or "").translate(AZ)


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for d, t in table():
        groups[low(t)].append(d)
    top = lambda ids: max((x for x in ids if x is not None), default=None)
    want = [(d, top(groups[low(t)]), len(groups[low(t)]), SHA(low(t))) for d, t in table()]
    for digest in (F.xxhash64, lambda c: F.length(c).cast("long")):  # the second one clashes everywhere
        got = exact_dedup.mark_duplicates(docs, largest=True, digest=digest).collect()
        assert Counter(want) == Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got)
        kept = [r for r in got if r.kept]
        assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
        out = exact_dedup.drop_duplicates(docs, largest=True, digest=digest)
        assert out.columns == docs.columns and Counter((r.doc_id, low(r.text)) for r in out.collect()) == Counter((r.keep_id, t) for t in groups for r in kept if r.text_sha256 == SHA(t))
    assert exact_dedup.mark_duplicates(empty).count() == 0 == exact_dedup.drop_duplicates(empty).count()


def test_merge_index_grows_by_batches(spark):
    rows = [(i, f"Text {i % 37}") for i in range(60)]
    index, known = None, []
    for n in range(6):
        batch = rows[10 * n : 10 * n + 10]
        known += batch
        index = exact_dedup.add(index, spark.createDataFrame(batch, "doc_id long, text string"))
        held = index.collect()
        assert sum(r.size for r in held) == len(known)
        assert Counter(r.level for r in {(r.level, r.run): r for r in held}.values()) == Counter({0: n + 1} if n < 3 else {1: 1, 0: n - 3})
    old = spark.createDataFrame(known, "doc_id long, text string")
    new = spark.createDataFrame([(100, "tEXT 3"), (101, "text 99"), (102, "text 36"), (103, None), (103, "text 3 ")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.look_up(index, old, new).collect()} == {100: 3, 102: 36}
    # filters: a digest is sent to the runs that hold it and to few others
    digests = index.select("digest", "run").collect()
    asked = exact_dedup.probed(index.select("digest").distinct(), index).collect()
    holders = defaultdict(set)
    for r in digests:
        holders[r.digest].add(r.run)
    assert all(holders[r.digest] <= set(r.runs) for r in asked)
    runs = len({r.run for r in digests})
    assert runs == 3 and sum(len(r.runs) for r in asked) < sum(map(len, holders.values())) + 4


@pytest.mark.parametrize("largest", [False, True])
def test_look_up_loses_no_text(spark, largest):
    """Digests that clash everywhere, and texts kept under a null identifier."""
    clash = lambda c: F.length(c).cast("long")
    old = [(1, "aaa"), (2, "bbb"), (3, "BBB"), (None, "ccc"), (None, "ddd"), (7, "ddd")]
    index = None
    for part in (old[:3], old[3:]):
        index = exact_dedup.add(index, spark.createDataFrame(part, "doc_id long, text string"), digest=clash)
    new = spark.createDataFrame([(10, "AAA"), (11, "bbb"), (12, "ccc"), (13, "ddd"), (14, "xxx"), (None, "ccc"), (15, None)], "doc_id long, text string")
    got = exact_dedup.look_up(index, spark.createDataFrame(old, "doc_id long, text string"), new, clash, largest).collect()
    want = [(10, 1), (11, 3 if largest else 2), (12, None), (13, 7 if largest else None), (None, None)]
    assert sorted(((r.doc_id, r.keep_id) for r in got), key=repr) == sorted(want, key=repr)


def shingles(t):
    w = re.findall(SPACE, low(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("hot", "rounds"), [(ngram_join.HOT, ngram_join.ROUNDS), (-(1 << 30), 1), (ngram_join.HOT, 0)])
def test_ngram_join(docs, empty, hot, rounds):
    sets = [(d, shingles(t)) for d, t in table()]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        least[root(i)] += [d] if d is not None else []
    want = Counter((d, len(s), (min(least[root(i)], default=None) if s else d)) for i, (d, s) in enumerate(sets))
    assert Counter(tuple(r) for r in ngram_join.near_duplicates(docs, hot=hot, rounds=rounds).collect()) == want
    assert ngram_join.near_duplicates(empty).count() == 0


def test_ngram_join_bounds():
    """_needed against all sizes, and its bound by bands."""
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE MACRO div(x, y) AS x // y")
    sql = lambda text: re.sub(r"([0-9.]+)D\b", r"\1", text.replace(" div ", " // "))
    needed, bound = sql(ngram_join._needed("n", "m", 80)), sql(ngram_join._needed_in_band("n", "band", 80))
    low = con.sql(f"SELECT min({needed} - {bound}), min({needed}), count(*) FROM (SELECT n, m, floor(ln(m) / ln({ngram_join.BAND})) AS band FROM range(1, 700) a(n), range(1, 900) b(m) WHERE n * 100 >= m * 80 AND m * 100 >= n * 80)").fetchall()[0]
    assert low[0] >= 0 and low[1] >= 1 and low[2] > 10_000


@pytest.mark.parametrize("one_task", [True, False])
def test_few_links_settle_without_passes(spark, one_task, monkeypatch):
    """Every pass is a large plan on the driver; few links took two passes at least. Chains, hubs, loops, repeats and nulls."""
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(40)] + [(90, j) for j in range(91, 120)] + [(200, 200), (7, None), (None, None)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)] * 2 + [(-5, 2**62)]
    of = {}
    for a, b in ((a, b) for a, b in links if a is not None and b is not None and a != b):
        x, y = of.setdefault(a, {a}), of.setdefault(b, {b})
        if x is not y:
            x |= y
            of.update(dict.fromkeys(y, x))
    rows, written = spark.createDataFrame(links, "a long, b long"), []
    monkeypatch.setattr(graph, "saved", lambda df, name, keep=graph.saved: written.append(name) or keep(df, name))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", one_task)
    try:
        found = graph.components(rows, "a", "b").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.node: r.component for r in found} == {n: min(own) for n, own in of.items()} and len(found) == len(of)
    assert ("stars" in written) != one_task


def test_contracted_links_of_tasks(monkeypatch):
    """What a task sends holds the same nodes together, a row for each node but the least; at the bound it begins anew."""
    pairs = [(9, 4), (4, 1), (9, 1), (7, 6), (8, 7), (6, 1)]
    batches = lambda: [pa.record_batch([[u], [v]], ["u", "v"]) for u, v in pairs]
    rows = lambda: [(x["u"], x["v"]) for b in graph._forest(iter(batches())) for x in b.to_pylist()]
    assert sorted(rows()) == [(4, 1), (6, 1), (7, 1), (8, 1), (9, 1)]
    monkeypatch.setattr(graph, "HELD", 2)
    assert sorted(rows()) == [(4, 1), (6, 1), (7, 6), (8, 7), (9, 1), (9, 1)]
    assert list(graph._forest(iter([]))) == []


def test_sharding(docs, empty):
    out = sharding.shard(docs, 4, bucket_bytes=4000)
    rows = out.select("record.doc_id", "record.text", "shard", "slot").collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(table())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    digest = sharding.digest(out).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in digest) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in table())
    assert sharding.shard(empty).count() == 0
    assert sorted(sharding.fisher_yates(50, np.random.default_rng(1))) == list(range(50))


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer, models

    ordinary = tokens.unigram_vocabulary()
    exact = Tokenizer(models.Unigram([("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *ordinary], 0, byte_fallback=True))
    texts = [t or "" for _, t in table()] + ["naïve 日本語\n\n  x", "𝔘nicode ☃ \t tab", "aaaa bbbb  cc"]
    model = tokens.Viterbi(ordinary)
    for t in texts:
        assert model.count(t)[1] == (len(exact.encode((" " + t).replace(" ", "▁"), add_special_tokens=False).ids) if t else 0)
    got = tokens.token_counts(docs)
    assert Counter((r.doc_id, r.n_tokens) for r in got.collect()) == Counter((d, model.count(t or "")[1]) for d, t in table())
    assert tokens.token_counts(empty).count() == 0
    ties = tokens.Viterbi([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0)])
    assert ties.count("ab") == (-3.0, 2)  # the longest last piece wins a tie


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    texts = dict(table())
    items = [(1, " ".join(texts[50].split(" ")[20:50])), (2, words(rng, 20)), (3, "ONE"), (4, "a b c"), (5, None), (6, " "), (None, " ".join(texts[51].split(" ")[5:20])), (7, "beta1 x11"), (8, texts[51][:150])]
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    want = Counter()
    for d, t in table():
        w, hit, ids = find(t), set(), set()
        for i, x in items:
            own = find(x)
            n = min(10, len(own))
            for q in range(len(own) - n + 1 if own else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == own[q : q + n]:
                        hit |= set(range(p, p + n))
                        ids |= {str(i)} if i is not None else set()
        want[d, len(w), len(hit), len(ids), SHA(",".join(sorted(ids))), bool(hit)] += 1
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, row int")
    got = decontaminate.contamination(docs, bench)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == want
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_decontamination_of_repetitive_texts(spark):
    """Texts of one or two words repeated thousands of times meet items like them in rows that grow with the text, not with its square."""
    texts = {1: "la " * 20000, 2: "la di " * 3000 + "la la", 3: "la " * 9, 4: "x " * 50 + "la " * 12}
    items = [(1, "la " * 60), (2, "di la " * 40), (3, "la " * 60)]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: (20000, 20000, 2), 2: (6002, 6001, 1), 3: (9, 0, 0), 4: (62, 12, 2)}


@pytest.mark.parametrize("span", [35, 6])
def test_substring_dedup(docs, empty, span):
    seen, texts = Counter(), [(d, re.findall(SPACE, t or "")) for d, t in table()]
    for _, w in texts:
        seen.update(tuple(w[i : i + span]) for i in range(len(w) - span + 1))
    want = Counter()
    for d, w in texts:
        gone = {p for i in range(len(w) - span + 1) if seen[tuple(w[i : i + span])] > 1 for p in range(i, i + span)}
        want[d, len(w), len(gone), SHA(" ".join(x for p, x in enumerate(w) if p not in gone))] += 1
    got = substring_dedup.digest(substring_dedup.remove_repeats(docs, span))
    assert Counter(tuple(r) for r in got.collect()) == want
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_byte_pairs_equal_the_library():
    texts = ["a_b c__d", "x² ½ ª", "don't  he'll\n\n x", " ", "\t\t a", "é_è 12ab", "  \n", "日本語 text", "<|endoftext|>", " x", "¿qué? «x»", "a\x85b\x1cc", *(t or "" for _, t in table())]
    pairs = tokens.BytePairs(*(Path(tokens.default_path(x)).read_text() for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")))
    for t in texts * 2:
        assert pairs.encode(t) == np.array(pairs.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokens.default_path("byte_bpe_50k.json"))
    ids = [(d, np.array([*exact.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for d, t in table()]
    want = Counter((d, a, len(x[a : a + 256]), zlib.crc32(x[a : a + 256].tobytes()), len(x)) for d, x in ids for a in range(0, len(x), 256))
    rows = packing.pack(docs, capacity=256).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1.05 * sum(len(x) for _, x in ids) / 256 + 1
    assert packing.pack(empty).count() == 0


def test_column_generation_reaches_the_bound():
    rng = np.random.default_rng(1)
    demand = np.bincount(rng.integers(300, 900, 5000), minlength=2049)
    found, bound = packing.solve(demand)
    assert sum(x for _, x in found) <= 1.01 * bound
    assert np.allclose(sum(p * x for p, x in found), demand, atol=1e-6)
    whole = packing.patterns(demand)
    assert (sum(p * n for p, n in whole) == demand).all() and all((p * np.arange(2049)).sum() <= 2048 for p, _ in whole)


def covered(intervals):
    """The places of the sequence in the intervals, in their order."""
    return [x for a, b in intervals for x in range(a, b)]


def test_chat_forks(spark):
    """Random trees with many forks against a plain walk from node to parent; and long conversations, of which one leaves another late."""
    rng = random.Random(4)
    told = [[rng.choice("ab") for _ in range(rng.randint(1, 9))] for _ in range(60)]
    long = [f"t{i}" for i in range(3000)]
    told += [long, long[:2500] + ["other"] * 400, long[:1200]]
    rows = [(c, i, ("user", "assistant")[i % 2], t) for c, turns in enumerate(told) for i, t in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes, members = chat_format.prefix_trees(table)
    nodes = {r.node_id: r for r in nodes.collect()}
    assert len(nodes) == len({tuple(t[: i + 1]) for t in told for i in range(len(t))})
    for r in nodes.values():
        if r.depth < 20 or r.depth % 97 == 0:
            up, node = [], r
            while node.parent_id:
                node = nodes[node.parent_id]
                up.append((node.start, node.start + node.n_tokens))
            assert covered(r.ancestors) == covered(up[::-1]) and r.position == len(covered(up)) and len(up) == r.depth
    deep = nodes[next(m.node_id for m in members.where("conv_id = 60 AND step = 2999").collect())]
    assert len(deep.ancestors) <= 2
    for tree in {r.tree_id for r in nodes.values()}:
        spans = sorted((r.start, r.start + r.n_tokens) for r in nodes.values() if r.tree_id == tree)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    got = {r.conv_id: r for r in chat_format.read_back(*chat_format.prefix_trees(table)).collect()}
    for c, turns in enumerate(told):
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == SHA("".join(f"{('user', 'assistant')[i % 2]}\n{t}\n" for i, t in enumerate(turns)))


def test_chat_trees(spark):
    told = [(1, 0, "user", "hi"), (1, 1, "assistant", "a [/INST] b"), (2, 0, "user", "hi"), (2, 1, "assistant", "a [/INST] b"), (2, 2, "user", None), (3, 0, "user", "hi"), (3, 1, "assistant", r"<\s> [\\INST] </s>"), (4, 0, None, "x"), (None, 0, "tool", "</s>"), (5, 3, "system", "s"), (5, None, "user", "first"), (5, 3, "system", "s")]
    rows = spark.createDataFrame([(*x, "c") for x in told], "conv_id long, turn long, role string, text string, node_id string")
    nodes, members = chat_format.prefix_trees(rows)
    nodes = {r.node_id: r for r in nodes.collect()}
    assert len(nodes) == 9  # hi; two answers; an empty turn; x; </s>; first, s, s
    for r in nodes.values():
        up, node = [], r
        while node.parent_id:
            node = nodes[node.parent_id]
            up.append((node.start, node.start + node.n_tokens))
        assert covered(r.ancestors) == covered(up[::-1]) and r.position == sum(b - a for a, b in up) and r.n_tokens == len(r.tokens)
        inner = re.sub(chat_format.CONTROL, "", r.text[r.body_start : r.body_start + r.body_length])
        assert "</s>" not in inner
    for tree in {r.tree_id for r in nodes.values()}:
        spans = sorted((r.start, r.start + r.n_tokens) for r in nodes.values() if r.tree_id == tree)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    got = {r.conv_id: r for r in chat_format.read_back(*chat_format.prefix_trees(rows)).collect()}
    turn = lambda *x: SHA("".join(f"{r}\n{t}\n" for r, t in x))
    assert got[2].turns_sha256 == turn(("user", "hi"), ("assistant", "a [/INST] b"), ("user", "")) and got[2].loss_sha256 == SHA("a [/INST] b") and got[2].loss_chars == 11
    assert got[3].loss_sha256 == SHA(r"<\s> [\\INST] </s>") and got[5].turns_sha256 == turn(("user", "first"), ("system", "s"), ("system", "s")) and got[None].n_turns == 1
    assert chat_format.read_back(*chat_format.prefix_trees(rows.where("false"))).count() == 0


def test_language(spark, empty):
    rng = random.Random(3)
    vocab = {"en": ["the", "ing", "and", "wh", "tion"], "de": ["sch", "ung", "der", "ich", "ß"], "fr": ["eau", "é", "que", "oi", "ç"]}
    text = lambda lang, n: " ".join("".join(rng.choices(vocab[lang], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(lang, rng.randint(5, 40)), lang, 1.0) for i, lang in enumerate(rng.choices(list(vocab), k=400))] + [(900, None, "en", 1.0), (901, "12 34", "en", 1.0), (None, text("de", 20), None, 1.0), (902, "", "fr", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    fold = classify.remainder("doc_id", 3)
    got = classify.identify(docs, fold != 1, fold == 1).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert len(got) == len(rows) and len(held) > 80 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and {r.doc_id: r.lang_pred for r in got if r.doc_id and r.doc_id >= 900} == {900: "und", 901: "und", 902: "und"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert classify.identify(empty, F.lit(True), F.lit(False)).count() == 0


def test_toxicity(spark, docs, empty):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        own = words(rng, rng.randint(5, 60)).split(" ")
        toxic = int(i % 5 == 0)
        if toxic:
            own.insert(rng.randint(0, len(own)), rng.choice(["idiot", "scumbag"]))
        rows.append((i, " ".join(own), toxic))
    told = spark.createDataFrame([(a, b, "x") for a, b, _ in rows] + [(None, None, "x"), (700, "", "x")], "doc_id long, text string, record string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows] + [(700, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    fold = classify.remainder("doc_id", 5)
    got = classify.toxicity(told, labels, fold != 0, fold == 0).collect()
    truth = {a: c for a, _, c in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == len(rows) + 2 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(r.predicted == int(r.score >= 0.5) for r in got) and [r.predicted for r in got if r.doc_id == 700] == [0]
    left = classify.drop_toxic(told, labels, fold != 0)
    assert left.columns == told.columns and Counter(r.doc_id for r in left.collect()) == Counter(r.doc_id for r in got if not r.predicted)
    assert classify.toxicity(empty, labels, F.lit(True), F.lit(False)).count() == 0
    assert classify.toxicity(docs, labels.where("false"), F.lit(True), F.lit(False)).where("predicted = 1").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    from tests.oracle import assert_same

    assert_same(spark, sf_dir, queries.QUERIES[name], queries.ORACLE[name])


def test_toxicity_with_few_labels(spark):
    """Each toxic word is in two labelled texts only; texts without a label that hold one are flagged all the same."""
    plain, rude = "river stone garden window bridge candle market forest".split(), "grumblesnark vexwobble mudflinger".split()
    words = lambda i: " ".join(plain[(i * k + k) % 8] for k in (1, 3, 5))
    rows = [(i, words(i), 0) for i in range(12)] + [(20 + i, f"{words(i)} {rude[i % 3]}", 1) for i in range(6)]
    new = [(40 + i, f"{rude[i]} {words(i + 2)}", 1) for i in range(3)] + [(50 + i, f"{words(i + 1)} {words(i)}", 0) for i in range(6)]
    told = spark.createDataFrame([(a, b) for a, b, _ in rows + new], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in classify.toxicity(told, labels, F.lit(True), F.lit(False)).collect()}
    assert got == {a: c for a, _, c in rows + new}


def test_occurrences_keep_all_slots():
    slots = np.unique(np.random.default_rng(1).integers(0, 1 << 20, 5000)).astype(np.int32)
    for own in (slots, slots[:0], slots[-1:]):
        assert classify.Occurrences(*classify.Occurrences.packed(own)).slots().tolist() == own.tolist()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    for i, (_, stage) in enumerate(pipeline.STAGES):
        after = pipeline.saved(stage(spark, before, sf_dir), "test-stage")
        if i < 4:
            assert after.columns == columns
            ids = {r.doc_id for r in after.select("doc_id").collect()}
            was = {r.doc_id: low(r.text) for r in before.collect()}
            assert ids <= set(was) and len(ids) > 0.7 * len(was)
            if i == 1:
                last = {t: d for d, t in sorted(was.items())}
                assert ids == set(last.values())
            if i == 2:
                groups = ngram_join.near_duplicates(before).collect()
                assert ids == {r.component_id for r in groups}
            if i == 3:
                hit = decontaminate.contamination(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
                assert ids == {r.doc_id for r in hit.where("NOT contaminated").collect()}
        else:
            assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
        before = after
    assert pipeline.run(spark, sf_dir).count() == after.count()


def test_pipeline_tells_rows_apart(spark, sf_dir):
    import corpus_pipeline as pipeline

    one, item = words(random.Random(1), 60), spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    near = one + " end"
    rows = [(None, item), (None, "clean words"), (1, one), (1, "other words that stay"), (None, near), (2, item), (2, "clean too"), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("record", F.lit(1)).withColumn("row", F.lit(2)).withColumn("component", F.lit("x"))
    left = Counter((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, sf_dir).collect())
    assert left == Counter(rows) - Counter([(None, near), (None, item)])
    clean = pipeline.benchmark_passages(spark, docs, sf_dir)
    assert clean.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(r for r in rows if r[1] != item)
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


SCRIPTS = ["Straße im Wald", "日本語の文章", "привет, мир!", "naïve café 24h", "a", "", None, "  ..  ", "x1y 99 bottles", "𝒳𝒴 emoji 😀😀 end", "ÀÉ İstanbul"]


@pytest.mark.parametrize("grams", [classify.LANGUAGE_GRAMS, classify.TOXIC_GRAMS])
def test_grams_are_characters(grams):
    """Against plain slicing of strings in several scripts, from the middle of an array too."""
    import pyarrow as pa
    import pyarrow.compute as pc

    counts = "[^0-9a-z\x80-\U0010ffff]+" if grams.digits else "[^a-z\x80-\U0010ffff]+"
    found = grams(pa.array(["before", *SCRIPTS]).slice(1))
    for i, text in enumerate(SCRIPTS):
        clean = re.sub(counts, " ", f" {pc.utf8_lower(pa.scalar(text or '')).as_py()} ")
        clean = f" {clean.strip()} " if clean.strip() else " "
        for order, (slots, first) in zip(grams.orders, found):
            want = [clean[a : a + order] for a in range(len(clean) - order + 1)]
            want = [g for g in want if g != " " and not (grams.inside and " " in g[1:-1])]
            assert Counter(slots[first[i] : first[i + 1]].tolist()) == Counter(grams.slot(g) for g in want), (text, order)


def test_follow_regularised_leader():
    """Against the published per-coordinate steps, one number at a time; then tf-idf and temperature against their definitions."""
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(3)), np.unique(rng.integers(0, 12, 5)), None) for _ in range(40)]
    rows = [(c, s, rng.random(len(s)) * 3) for c, s, _ in rows]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.05, 0.01
    z, n = [[0.0] * 3 for _ in range(12)], [[0.0] * 3 for _ in range(12)]

    def weight(j, c):
        return 0.0 if abs(z[j][c]) <= l1 else -(z[j][c] - (1 if z[j][c] > 0 else -1) * l1) / ((beta + n[j][c] ** 0.5) / alpha + l2)

    for _ in range(2):
        for label, slots, x in rows:
            w = {(j, c): weight(j, c) for j in slots for c in range(3)}
            e = np.exp([sum(v * w[j, c] for j, v in zip(slots, x)) for c in range(3)])
            for j, v in zip(slots, x):
                for c in range(3):
                    g = v * (e[c] / e.sum() - (c == label))
                    z[j][c] += g - ((n[j][c] + g * g) ** 0.5 - n[j][c] ** 0.5) / alpha * w[j, c]
                    n[j][c] += g * g
    got = classify.follow_regularised_leader(rows, 3, 12, 2, alpha, beta, l1, l2)
    assert np.allclose(got, [[weight(j, c) for c in range(3)] for j in range(12)])
    assert np.allclose(classify._tfidf(np.array([1.0, 3.0]), np.array([2.0, 0.5])), [5.0, 3.75])
    scores = rng.normal(size=(200, 3)) * 4
    labels = (scores + rng.gumbel(size=(200, 3)) * 2).argmax(axis=1)
    t, loss = classify.temperature(scores, labels, 0.0), lambda t: -np.log([np.exp(r[c] / t) / np.exp(r / t).sum() for r, c in zip(scores, labels)]).mean()
    assert loss(t) <= min(loss(t * 1.05), loss(t / 1.05), loss(1.0)) and classify.temperature(scores[:0], labels[:0]) == 1.0
    right = np.eye(3)[labels] * 5  # all rows right: the temperature is inside its grid all the same
    assert 0.1 < classify.temperature(right, labels) < 10
    assert classify.calibration_error(np.array([0.9] * 10), np.array([1] * 9 + [0])) < 1e-9 < 0.48 < classify.calibration_error(np.array([0.99] * 10), np.array([1, 0] * 5))


def test_ratios_and_fit():
    """Ratios: 0 where the classes agree, in order of the evidence. Fit: no direction lowers the penalised loss it is defined by."""
    texts, counts = np.array([900, 100]), np.array([[0, 0, 0, 450, 90, 9], [0, 1, 50, 50, 0, 40]])
    r = classify.log_count_ratios(texts, counts)
    assert abs(r[0]) < 1e-9 and abs(r[3]) < 0.01 and 0 < r[1] < 0.3 < r[2] and r[4] < 0 < r[5] < r[2]
    rng = np.random.default_rng(5)
    own = [np.unique(rng.integers(0, 30, 6)).astype(np.int32) for _ in range(60)]
    label = [int((s < 4).any()) for s in own]
    ratio, share = rng.normal(size=1 << 20), sum(label) / 60
    w, b = classify.fit([(c, classify.Occurrences(*classify.Occurrences.packed(s))) for c, s in zip(label, own)], ratio, share, passes=300)

    def objective(w, b):
        z = np.array([(ratio[s] * w[s]).sum() + b for s in own]) * (2 * np.array(label) - 1)
        return ((w**2).sum() + b * b) / 2 + (np.where(label, classify.MISSED, 1.0) * np.log1p(np.exp(-z))).sum()

    best = objective(w, b)
    for _ in range(50):
        d = np.zeros(1 << 20)
        d[:30] = rng.normal(size=30) * 0.01
        assert objective(w + d, b) > best - 1e-6 and objective(w, b + d[0]) > best - 1e-6


def test_sample_is_bounded_by_bytes(spark):
    rows = spark.createDataFrame([(i, "x" * (i + 1), i % 2) for i in range(60)], "doc_id long, text string, grp int")
    got = classify.bounded_sample(rows, "grp", 10, 1).collect()
    assert Counter(r.grp for r in got) == {0: 10, 1: 10}
    less = classify.bounded_sample(rows, "grp", 10, 1, most_bytes=320).collect()
    assert all(0 < sum(len(r.text) for r in less if r.grp == g) <= 320 for g in (0, 1))
    # Large texts don't end the sample, a class of large texts only keeps one, equal rows count once.
    mixed = spark.createDataFrame([(i, "x" * (10 if i % 2 else 1000), i % 3 // 2) for i in range(100)] + [(None, "same", 0)] * 50 + [(500 + i, "y" * 5000, 7) for i in range(3)], "doc_id long, text string, grp int")
    got = classify.bounded_sample(mixed, "grp", 40, 1, most_bytes=900).collect()
    assert Counter(r.grp for r in got) == {0: sum(1 for i in range(100) if i % 2 and i % 3 < 2) + 1, 1: sum(1 for i in range(100) if i % 2 and i % 3 == 2), 7: 1}


def test_languages_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(classify, "LANGUAGES", 2)
    rows = [(i, "der die das und nicht" if i % 2 else "the and of that with", "de" if i % 2 else "en") for i in range(60)] + [(100 + i, "le la les et", f"x{i}") for i in range(9)]
    names, table, _ = classify.train_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert names == ["de", "en"] and table.shape[1] == 2
