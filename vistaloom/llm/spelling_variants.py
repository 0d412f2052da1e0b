"""Spelling variants: words of a corpus that are one edit apart, and the form that each one stands for.

Near words are found by a self-join of the vocabulary's trie with active-node sets. A set holds, for a node, the nodes whose strings are within the
distance of its own; a child's set follows from its parent's. With distance one a pair of nodes is either one node (distance
0), which gives birth to pairs of its children (a replacement) and to pairs of itself and a child (an insertion), or it has used
up its edit and goes on to children with the same letter. Pairs of words are where both nodes end words.

The trie is parted by prefixes. Words of n and n + 1 code points are one class. Two of them that are one edit apart share either their first c
code points or, from the edit on, the last n - c; so each word goes to the group of its first half and to that of its last half, and a group only has to join the
stretch [lo, hi) that its members need not share, as a trie of its own. A pair belongs to the stretch where it first differs, so it
is found once. A group of more than GROUP words is parted again, in the middle of its stretch; a stretch of one code point has as many
words as there are letters, so every group has a bound. Whatever the prefix, no group grows with the input. Tasks send counts and the best near word of
each word, not pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaloom.llm.util import LOWER, LOWER_AZ, UPPER_AZ, mix, saved, slices

_U = np.uint64
#: Words of a group that isn't parted again, and rows that a task joins at once.
GROUP, BATCH = 1 << 14, 1 << 16
#: Runs of more bytes have their checksum made one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def _crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """crc32 of each span of bytes, going on from the checksum begun of what comes before it."""
    table, state, sizes = _crc_table(), begun.astype(np.uint32) ^ np.uint32(0xFFFFFFFF), ends - starts
    at = np.flatnonzero(sizes <= LONG)
    for p in range(LONG):
        at = at[sizes[at] > p]
        if not len(at):
            break
        own = state[at]
        state[at] = table[(own ^ data[starts[at] + p]) & 0xFF] ^ (own >> 8)
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > LONG):
        state[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(begun[i]))
    return state.astype(np.int64)


def _word_counts(by: int, least: int):
    """(word, n) of the words in each slice of (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=4 << 20):
            texts = batch.column("text").fill_null("").cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = texts.buffers()[2]
            data = LOWER[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
            offsets = offsets - offsets[0]
            lead = data == 0xC3  # U+00C0 to U+00FF are this byte and one more
            second = np.r_[False, lead[:-1]] if len(data) else lead
            letter = ((data >= 0x61) & (data <= 0x7A)) | lead | second
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            first, last = letter.copy(), letter.copy()
            first[1:] &= ~letter[:-1] | edge[1:-1]
            last[:-1] &= ~letter[1:] | edge[1:-1]
            starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
            if not len(starts):
                continue
            row = np.searchsorted(offsets, starts, side="right") - 1
            ids = batch.column("doc_id")
            begun = np.array([zlib.crc32(f"{i}:".encode()) if i is not None else 0 for i in ids.to_pylist()], np.int64)
            h = _crc32(data, starts, ends, begun[row])
            point = letter & ~lead
            letters = np.where(second, data + np.uint8(0x40), data)[point]
            place = np.r_[0, np.cumsum(point)]
            begin, size = place[starts], place[ends] - place[starts]
            cut = (h % by == 0) & ids.is_valid().to_numpy(zero_copy_only=False)[row]
            stays = np.ones(len(letters), bool)
            stays[begin[cut] + h[cut] % size[cut]] = False
            left = np.r_[0, np.cumsum(stays)]
            begin, end, letters = left[begin], left[begin + size], letters[stays]
            keep = end - begin >= least
            begin, end = begin[keep], end[keep]
            if not len(begin):
                continue
            # Words are told apart by 64 bits inside a slice, and by their letters from there on.
            spot = np.zeros(len(letters), np.int64)
            spot[begin] = 1
            inside = np.cumsum(spot) > 0
            begun_at = np.maximum.accumulate(np.where(spot > 0, np.arange(len(letters)), 0))
            sums = np.r_[_U(0), np.cumsum(np.where(inside, mix(((np.arange(len(letters)) - begun_at) << 8 | letters).view(_U), 17), _U(0)), dtype=_U)]
            _, at, n = np.unique(mix(sums[end] - sums[begin] + (end - begin).astype(_U), 3), return_index=True, return_counts=True)
            text = letters.tobytes().decode("latin-1")
            yield pa.record_batch([pa.array([text[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist())], pa.string()), pa.array(n.astype(np.int64))], ["word", "n"])

    return run


def vocabulary(docs: DataFrame, by: int = 97, least: int = 5, often: int = 3) -> DataFrame:
    """word, n: the words of at least `least` code points that docs (doc_id, text) hold `often` times or more.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. Where `by` divides the crc32 of "<doc_id>:<run>" the run's code
    point at that number modulo its length is left out; of rows with a null doc_id none is. A slice of text is one task's; what it sends is its distinct words.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_word_counts(by, least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _key(lo: str, hi: str) -> Column:
    return F.expr(f"concat_ws(' ', class, {lo}, {hi}, substr(word, 1, {lo}), right(word, class - {hi}))")


def _dealt(words: DataFrame, group: int) -> DataFrame:
    """word, n, class, lo, hi, key: each word in the groups where it may have near words, none larger than `group` but for those of one letter."""
    classes = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("class")
    rows = words.select("word", "n", F.length("word").alias("size"), classes).where("class >= 1")
    halves = F.array(F.struct(F.expr("class div 2").alias("lo"), F.col("class").alias("hi")), F.struct(F.lit(0).alias("lo"), F.expr("class div 2").alias("hi")))
    rows = rows.select("word", "n", "class", F.explode(halves).alias("s")).select("word", "n", "class", "s.lo", "s.hi").where("lo < hi")
    rows = rows.withColumn("key", _key("lo", "hi"))
    while True:
        large = rows.where("hi - lo > 1").groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > group)
        large = saved(large.select("key", F.lit(True).alias("large")), "variant-groups")
        if large.isEmpty():
            return rows
        marked = rows.join(large, "key", "left")
        middle = F.expr("(lo + hi) div 2")
        parts = F.when(F.col("large"), F.array(F.struct(middle.alias("lo"), "hi"), F.struct("lo", middle.alias("hi")))).otherwise(F.array(F.struct("lo", "hi")))
        rows = marked.select("word", "n", "class", F.explode(parts).alias("s")).select("word", "n", "class", "s.lo", "s.hi").withColumn("key", _key("lo", "hi"))
        rows = saved(rows, "variant-rows")


class Forest:
    """The tries of several groups, level by level: strings sorted by group and code points, 0 after the end of each."""

    def __init__(self, letters: np.ndarray, group: np.ndarray, longer: np.ndarray, width: np.ndarray):
        self.letters, self.longer, self.width = letters, longer, width
        n, depth = letters.shape
        same = np.zeros(n, np.int64)
        if n > 1:
            differs = letters[1:] != letters[:-1]
            common = np.where(differs.any(axis=1), differs.argmax(axis=1), depth)
            same[1:] = np.where(group[1:] == group[:-1], common, -1)
        same[:1] = -1
        self.same = same

    def level(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(node of each string at this depth, first string of each node)."""
        new = self.same < depth
        return np.cumsum(new) - 1, np.flatnonzero(new)

    def children(self, depth: int) -> dict[str, np.ndarray]:
        """The edges from this depth to the next, by parent and letter: key (parent * 256 + letter), child, and whether shorter or longer words go on below."""
        nodes, _ = self.level(depth)
        child, first = self.level(depth + 1)
        letter = self.letters[first, depth].astype(np.int64)
        some = np.flatnonzero(letter > 0)
        short, long = (np.bincount(child, x, len(first)) > 0 for x in (~self.longer, self.longer))
        parent = nodes[first]
        key = parent[some] * 256 + letter[some]
        begin = np.searchsorted(key, np.arange((nodes[-1] if len(nodes) else 0) + 2) * 256)
        return {"key": key, "child": some, "short": short[some], "long": long[some], "begin": begin}

    def ends(self, depth: int, longer: bool) -> np.ndarray:
        """The string that ends at each node of this depth, -1 where none does."""
        nodes, first = self.level(depth)
        out = np.full(len(first), -1)
        own = np.flatnonzero((self.longer == longer) & (self.width + longer == depth))
        out[nodes[own]] = own
        return out


def _onward(a: np.ndarray, b: np.ndarray, of_a: dict, of_b: dict, b_flag: str) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of children, by equal letters, of pairs (a, b)."""
    n = of_a["begin"][a + 1] - of_a["begin"][a]
    at = np.repeat(of_a["begin"][a], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wanted = np.repeat(b, n) * 256 + (of_a["key"][at] & 255)
    if not len(of_b["key"]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    there = np.minimum(np.searchsorted(of_b["key"], wanted), len(of_b["key"]) - 1)
    hit = (of_b["key"][there] == wanted) & of_a["short"][at] & of_b[b_flag][there]
    return of_a["child"][at[hit]], of_b["child"][there[hit]]


def near_pairs(forest: Forest, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of strings (of the same length, or one a code point longer) that are one edit apart.

    whole: whether the group's stretch reaches to the ends of its words; where it doesn't, a string that goes on after the end of the other
    differs from it behind the stretch, and is left to another group.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    replaced, inserted = (np.zeros(0, np.int64),) * 2, (np.zeros(0, np.int64),) * 2
    most = int(forest.width.max(initial=0))
    edges = forest.children(0) if len(forest.width) else None
    for depth in range(most + 1):
        nxt = forest.children(depth + 1) if depth + 1 < forest.letters.shape[1] else {"key": np.zeros(0, np.int64), "child": np.zeros(0, np.int64), "short": np.zeros(0, bool), "long": np.zeros(0, bool), "begin": np.zeros(len(edges["key"]) + len(forest.width) + 2, np.int64)}
        # A node and its child: one inserted. Each pair once, however the insertion can be told.
        parent = edges["key"] >> 8
        goes = np.zeros((parent[-1] if len(parent) else -1) + 1, bool)
        goes[parent[edges["short"]]] = True
        ends = forest.ends(depth, False)
        _, first = forest.level(depth)
        ended = np.zeros(max(len(goes), len(ends)), bool)
        ended[: len(goes)] |= goes
        ended[: len(ends)] |= ends >= 0
        born = edges["long"] & ended[parent]
        a, b = np.r_[inserted[0], parent[born]], np.r_[inserted[1], edges["child"][born]]
        code = np.unique(a.astype(_U) << _U(32) | b.astype(_U))
        a, b = (code >> _U(32)).astype(np.int64), (code & _U(0xFFFFFFFF)).astype(np.int64)
        longer = forest.ends(depth + 1, True) if depth + 1 <= forest.letters.shape[1] else np.zeros(0, np.int64)
        hit = (ends[a] >= 0) & (longer[b] >= 0) if len(a) else np.zeros(0, bool)
        x, y = ends[a[hit]], longer[b[hit]]
        inside = whole[x] | (forest.letters[x, : depth] != forest.letters[y, : depth]).any(axis=1) if len(x) else np.zeros(0, bool)
        found.append((x[inside], y[inside]))
        if len(replaced[0]):
            p, q = replaced
            hit = (ends[p] >= 0) & (ends[q] >= 0)
            found.append((ends[p[hit]], ends[q[hit]]))
        if depth == most:
            break
        # Two children of one node: one replaced.
        short = np.flatnonzero(edges["short"])
        own = parent[short]
        last = np.searchsorted(own, own, side="right")
        n = last - np.arange(len(short)) - 1
        i = np.repeat(np.arange(len(short)), n)
        j = i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        on = _onward(*replaced, edges, edges, "short")
        replaced = np.r_[on[0], edges["child"][short[i]]], np.r_[on[1], edges["child"][short[j]]]
        inserted = _onward(a, b, edges, nxt, "long")
        edges = nxt
    return np.concatenate([x for x, _ in found] or [np.zeros(0, np.int64)]), np.concatenate([y for _, y in found] or [np.zeros(0, np.int64)])


def _joined(rows: dict[str, list]) -> pa.RecordBatch:
    """(word, near, n, best): how many near words rows of whole groups give each word, and the one of largest n among them (ties: smallest)."""
    words, keys = rows["word"], rows["key"]
    n, size = np.array(rows["n"], np.int64), np.array([len(w) for w in words])
    lo, hi, kind = (np.array(rows[c], np.int64) for c in ("lo", "hi", "class"))
    width, longer = hi - lo, size > kind
    depth = int((width + longer).max())
    letters = np.zeros((len(words), depth), np.uint8)
    for i, (w, a, b) in enumerate(zip(words, lo.tolist(), (width + longer).tolist())):
        letters[i, :b] = np.frombuffer(w[a : a + b].encode("latin-1"), np.uint8)
    group = np.unique(np.array(keys, object), return_inverse=True)[1]
    order = np.lexsort((*letters.T[::-1], group)) if depth else np.argsort(group, kind="stable")
    x, y = near_pairs(Forest(letters[order], group[order], longer[order], width[order]), (hi == kind)[order])
    a, b = np.r_[order[x], order[y]], np.r_[order[y], order[x]]
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    at = np.lexsort((rank[b], -n[b], a))
    a, b = a[at], b[at]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    near = np.diff(np.r_[first, len(a)])
    return pa.record_batch([pa.array([words[i] for i in a[first]], pa.string()), pa.array(near.astype(np.int64)), pa.array(n[b[first]]), pa.array([words[i] for i in b[first]], pa.string())], ["word", "near", "best_n", "best"])


def _tries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, joined some groups at a time."""
    names = ["word", "n", "class", "lo", "hi", "key"]
    held: dict[str, list] = {c: [] for c in names}
    for batch in batches:
        for c in names:
            held[c] += batch.column(c).to_pylist()
        # A string takes as many bytes as the longest stretch of its batch.
        if len(held["key"]) < 2 or len(held["key"]) * max(map(len, held["word"])) < BATCH * 16:
            continue
        last = held["key"][-1]
        cut = len(held["key"])
        while cut and held["key"][cut - 1] == last:
            cut -= 1
        if cut:
            yield _joined({c: x[:cut] for c, x in held.items()})
            held = {c: x[cut:] for c, x in held.items()}
    if held["key"]:
        yield _joined(held)


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): forms followed to the last, by doubling. n at least doubles along a form, so there are no circles."""
    now = saved(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = saved(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group_variants(words: DataFrame, ratio: int = 2, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n; each word once, of code points up to U+00FF).

    Near words differ by one inserted, deleted or replaced code point. The form is the near word of largest n (ties: the smallest) if that is at
    least `ratio` times the word's own; form and form_n are null else. root: the last word that forms lead to, the word itself without one.
    A table without words gives none.
    """
    dealt = _dealt(words.where("word <> ''"), group)
    parts = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_tries, "word string, near long, best_n long, best string")
    near = parts.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("b"))
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("b.best").alias("best"), (-F.col("b.n")).alias("best_n"))
    fits = F.col("best_n") >= ratio * F.col("n")
    found = saved(found.select("word", "n", "n_near", F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")), "variant-forms")
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, by: int = 97, least: int = 5, often: int = 3, group: int = GROUP) -> DataFrame:
    """group_variants() of the vocabulary() of docs (doc_id, text; further columns are left out). Null and empty texts hold no words; repeated
    rows count as often as they stand; texts of any length are taken whole, in one slice; an empty table gives an empty result."""
    return group_variants(saved(vocabulary(docs, by, least, often), "variant-words"), group=group)


_BYTES = "flatten(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN ord(substr(x, i, 1)) < 128 THEN [ord(substr(x, i, 1))::BIGINT] ELSE [195, ord(substr(x, i, 1))::BIGINT - 64] END))"
_TABLE = "(SELECT list(list_reduce(list_concat([b], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END) ORDER BY b) AS t FROM range(256) AS r(b))"
ORACLE = f"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(r, '{UPPER_AZ}', '{LOWER_AZ}') AS w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY 1, 2),
crc AS (SELECT doc_id, w, n, xor(list_reduce(list_concat([4294967295], {_BYTES}), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS h FROM (SELECT *, doc_id::VARCHAR || ':' || w AS x FROM runs), {_TABLE}),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS w, n FROM crc),
v AS (SELECT w, sum(n)::BIGINT AS n FROM cut WHERE length(w) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
del AS (SELECT w, n, i, left(w, i) || substr(w, i + 2) AS rest FROM v, unnest(range(0, length(w))) AS r(i)),
ins AS (SELECT DISTINCT v.w AS a, v.n AS an, d.w AS b, d.n AS bn FROM v JOIN del d ON d.rest = v.w),
near AS (SELECT a.w AS w, b.w AS o, b.n AS n FROM del a JOIN del b ON a.rest = b.rest AND a.i = b.i AND a.w <> b.w AND length(a.w) = length(b.w) UNION ALL SELECT a, b, bn FROM ins UNION ALL SELECT b, a, an FROM ins),
best AS (SELECT w, count(*) AS c, arg_min(o, struct_pack(n := -n, o := o)) AS o, max(n) AS n FROM near GROUP BY 1),
f AS (SELECT v.w, v.n, coalesce(c, 0) AS c, CASE WHEN best.n >= 2 * v.n THEN o END AS form, CASE WHEN best.n >= 2 * v.n THEN best.n END AS fn FROM v LEFT JOIN best USING (w)),
walk AS (SELECT w, w AS here, 0 AS d FROM f UNION ALL SELECT walk.w, f.form, d + 1 FROM walk JOIN f ON f.w = walk.here WHERE f.form IS NOT NULL)
SELECT f.w AS word, form, root, n, c AS n_near, fn AS form_n FROM f JOIN (SELECT w, arg_max(here, d) AS root FROM walk GROUP BY 1) r USING (w)
"""
