import math

import pytest
from pyspark.sql import functions as F

from vistaloom.functions import texts as X
from vistaloom.functions.vectors import dot, normalised, verdict
from vistaloom.operators import evaluation as E
from vistaloom.operators import graph as G
from vistaloom.operators import rules as R
from vistaloom.operators import subtitles as S
from vistaloom.operators import temporal as T
from vistaloom.operators import vectors as V
from vistaloom.sources import files


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x if values else spark.range(1).select(column.alias("x")).first().x


def test_vectors(spark):
    assert one(spark, dot(F.col("a"), F.col("b")), a=[1.0, 2.0], b=[3.0, 4.0]) == 11
    assert one(spark, normalised("a"), a=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert one(spark, normalised("a"), a=[0.0, 0.0]) == [0, 0]
    assert [one(spark, verdict(F.lit(x))) for x in (0.6, 0.5, 0.35)] == ["high", "likely", "different"]


def test_match_ties_and_threshold(spark):
    faces = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, -1.0])], "face_id long, enc array<double>")
    centers = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0])], "cluster_id int, center array<double>")
    got = {r.face_id: (r.match_idx, r.similarity) for r in V.match_to_center(faces, centers, 0.5).collect()}
    assert got == {1: (0, 1.0), 2: (-1, 0.0)}


def test_temporal_edge(spark):
    """A pair under the threshold becomes an edge by closeness in time; frame 0 gives no bonus."""
    faces = spark.createDataFrame([(1, 5, [1.0, 0.0]), (2, 5, [0.5, math.sqrt(0.75)]), (3, 0, [0.5, -math.sqrt(0.75)])], "face_id long, frame_num int, enc array<double>")
    got = [(r.src, r.dst, round(r.weight, 6)) for r in V.similarity_edges(faces, 0.52).collect()]
    assert got == [(1, 2, 0.55)]


def test_components_and_colours(spark):
    nodes = spark.createDataFrame([(i, 1.0) for i in range(8)], "node long, quality double")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (5, 6, 1.0)], "src long, dst long, weight double")
    assert {r.node: r.component for r in G.components(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}
    colour = {r.node: r.colour for r in G.colours(nodes, edges).collect()}
    assert all(colour[a] != colour[b] for a, b in ((0, 1), (1, 2), (2, 3), (5, 6)))
    labels = {r.node: r.label for r in G.propagate(nodes, edges).collect()}
    assert labels[5] == labels[6] and labels[4] == 4 and len({labels[i] for i in range(4)}) <= 2


def test_published_improvement(spark):
    """Golden rows: base, target, difference and percent of nine episodes."""
    rows = [(1, 0.8857, 0.9590, 8.28), (2, 0.9452, 0.9763, 3.29), (3, 0.9390, 0.9866, 5.07), (10, 0.9480, 0.9464, -0.17)]
    table = spark.createDataFrame([(e, m, v) for e, a, b, _ in rows for m, v in (("a", a), ("b", b))], "episode int, method string, value double")
    got = {r.episode: r.percent for r in E.compare_methods(table, ("a", "b")).collect()}
    assert all(got[e] == pytest.approx(p, abs=0.01) for e, _, _, p in rows)


def test_report_with_unpredicted_and_unsupported_classes(spark):
    long = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (3, 1, 0)], "true_label int, pred_label int, cnt int")
    got = {r.label: r for r in E.class_metrics(long).collect()}
    assert got[2].support == 0 and got[2].f1 == 0 and got[1].recall == 0.5 and got[3].precision == 0
    report = {r.label: r for r in E.classification_report(E.class_metrics(long)).collect()}
    assert report["Macro Avg"].recall == 0.5 and report["Weighted Avg"].support == 10


def _rows(spark, values):
    return spark.createDataFrame([(1, i, i, v) for i, v in enumerate(values)], "track long, event_id long, s long, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")


@pytest.mark.parametrize("rule, ends", [(dict(end_rule="first_inactive", keep_tail=False), [3]), (dict(end_rule="last_active"), [2, 5]), (dict(least_s=1.0), [2])])
def test_segments(spark, rule, ends):
    got = T.segments(_rows(spark, [0.0, 1.0, 1.0, 0.0, 0.0, 1.0]), F.col("value") > 0.5, **rule).select(F.unix_seconds(F.col("end").cast("timestamp")).alias("e")).collect()
    assert sorted(r.e for r in got) == ends


def test_ema_holds_on_null(spark):
    got = [r.smooth for r in T.ema(_rows(spark, [1.0, None, 3.0]), 0.5).orderBy("event_id").collect()]
    assert got == [1.0, 1.0, 2.0]


def test_history_vote_needs_three_earlier_votes(spark):
    rows = spark.createDataFrame([(1, i, i, m, s) for i, (m, s) in enumerate([(2, 0.9), (2, 0.9), (-1, 0.0), (2, 0.9), (-1, 0.0)])], "track long, event_id long, ts long, match int, similarity double")
    got = [(r.filled_match, r.from_history) for r in T.history_vote(rows).orderBy("event_id").collect()]
    assert got == [(2, False), (2, False), (-1, False), (2, False), (2, True)]


def test_times(spark):
    assert one(spark, X.parse_time(F.lit("01:02:03.004"))) == 3723004
    assert one(spark, X.parse_time(F.lit("1:2:3"))) is None
    assert one(spark, X.format_time(F.lit(3723004))) == "01:02:03,004"


def test_wrap_leaves_an_empty_first_line(spark):
    assert one(spark, X.wrap(F.lit("abcdef gh ij"), 5)) == ["", "abcdef", "gh ij"]


def test_remap_and_names(spark):
    assert [one(spark, X.remap(F.lit(x), {"a": 7})) for x in ("a", "3.0", "-1", "zz")] == [7, 3, -1, None]
    assert [one(spark, X.episode_number(F.lit(x))) for x in ("result_ep3", "s2EP10", "episode_4", "episode7", "ep_6", "none", "E5", "run7")] == [3, 10, 4, 7, 6, None, None, None]
    assert one(spark, X.report_number(F.lit("Total samples: 1,234\n"), "Total samples")) == 1234


def test_split_drops_lines_without_hyphen(spark):
    subs = spark.createDataFrame([("v", 1, 0, 2150, "- ab\nplain\n- cdef"), ("v", 2, 3000, 4000, "one")], "video string, idx int, start_ms long, end_ms long, text string")
    got = [(r.idx, r.original_index, r.start_ms, r.end_ms, r.text) for r in S.split_dialogues(subs).orderBy("idx").collect()]
    assert got == [(1, 1, 0, 750, "- ab"), (2, 1, 900, 2150, "- cdef"), (3, 2, 3000, 4000, "one")]


def test_srt_blocks_that_do_not_fit_are_skipped(spark):
    text = "﻿1\n00:00:01,000 --> 00:00:02,500\nhi\nyou\n\nx\n00:00:01,000 --> 00:00:02,500\nno\n\n3\nno arrow\nz"
    got = S.parse_blocks(spark.createDataFrame([("v", text)], "video string, value string")).collect()
    assert [(r.idx, r.start_ms, r.end_ms, r.text) for r in got] == [(1, 1000, 2500, "hi\nyou")]


def test_gate_short_circuits(spark):
    rows = spark.createDataFrame([(1, 10), (2, 60), (3, 100)], "id int, size int")
    got = {r.id: (r.is_valid, r.reason) for r in R.gate(rows, {"a": F.col("size") < 80, "b": F.col("size") < 70}, ("small", F.col("size") < 40)).collect()}
    assert got == {1: (False, ["small"]), 2: (False, ["a", "b"]), 3: (True, [])}


def test_files_round_trip(spark, tmp_path):
    subs = spark.createDataFrame([("v", 1, 0, 1000, "hi"), ("v", 2, 1500, 2500, "a\nb")], "video string, idx int, start_ms long, end_ms long, text string")
    files.write_srt(subs, f"{tmp_path}/srt")
    back = files.read_srt(spark, f"{tmp_path}/srt/video=v").orderBy("idx").collect()
    assert [(r.idx, r.start_ms, r.end_ms, r.text) for r in back] == [(1, 0, 1000, "hi"), (2, 1500, 2500, "a\nb")]
    notes = spark.createDataFrame([("v", "1_start", 1, None), ("v", "2_start", 2, 5)], "video string, key string, subtitle_id int, speaker_id int")
    files.write_annotations(notes, f"{tmp_path}/json")
    got = {r.key: (r.subtitle_id, r.speaker_id) for r in files.read_annotations(spark, f"{tmp_path}/json/video=v").collect()}
    assert got == {"1_start": (1, -1), "2_start": (2, 5)}


def test_face_names(spark):
    names = spark.createDataFrame([("a/frame_000012_face_3.jpg",), ("retrieval_frame_000007_mainface_1.jpg",), ("b/retrieval_frame_000008_face_2.jpg.bak",), ("x.png",), (None,)], "path string")
    got = {form: [tuple(r) for r in names.select(*files.face_of(F.col("path"), form)).collect()] for form in files.FACE_NAMES}
    none = (-1, -1)
    assert got == {"detection": [(12, 3), none, none, none, none], "retrieval": [(12, 3), none, (8, 2), none, none], "legacy": [none, (7, 1), none, none, none]}


def test_follow_against_a_plain_loop(spark):
    import random

    from vistaloom.operators.clusters import follow

    rng = random.Random(5)
    rows = [(v, f, v * 1000 + f * 10 + i, float(rng.randint(0, 200)), float(rng.randint(0, 200))) for v in range(2) for f in range(30) for i in range(rng.randint(0, 3))]
    want = {}
    for v in range(2):
        last, n = {}, 0
        for _, f, i, x, y in sorted(r for r in rows if r[0] == v):
            near = [(math.hypot(x - a, y - b), t) for t, (g, a, b) in last.items() if 0 < f - g <= 10 and math.hypot(x - a, y - b) < 50]
            track = min(near)[1] if near else n
            n += not near
            last[track] = (f, x, y)
            want[i] = track
    got = follow(spark.createDataFrame(rows, "video int, frame int, id int, x double, y double"), 50, 10)
    assert {r.id: r.track for r in got.collect()} == want


def test_first_track_against_a_plain_loop(spark):
    import random

    from vistaloom.operators.clusters import follow_first

    rng = random.Random(6)
    rows = [(v, f, v * 1000 + f * 10 + i, rng.randint(-20, 20) * 9 + 0.5, rng.randint(0, 20) * 9.0) for v in range(2) for f in range(0, 60, 3) for i in range(rng.randint(0, 3))] + [(0, None, 5000, 1.0, 1.0), (0, 5, 5001, None, 1.0)]
    want = {5000: None, 5001: None}
    for v in range(2):
        history = {}
        for _, f, i, x, y in sorted(r for r in rows if r[0] == v and None not in r):
            track = next((t for t, (g, a, b) in history.items() if f - g <= 10 and math.hypot(x - a, y - b) < 50), f"{int(x)}_{int(y)}")
            history[track] = (f, x, y)
            want[i] = track
    got = follow_first(spark.createDataFrame(rows, "video int, frame int, id int, x double, y double"), 50, 10).collect()
    assert {r.id: r.track for r in got} == want and len(set(want.values())) > 5


def test_choice_of_method(spark):
    from vistaloom.operators.clusters import choose_method

    few = spark.createDataFrame([("original", n) for n in (3, 3, 30, 30)] + [("adjusted", n) for n in (20, 22, 24, 26)], "method string, n int")
    assert choose_method(few).first().chosen == "adjusted"
    assert choose_method(few.where("method = 'original'")).first().chosen == "original"


def test_queries_reach_rows_of_all_ids(spark, tmp_path):
    from vistaloom.plans import catalogue

    ids = [5, 480, 520, 2990, 3010, 45678]
    spark.createDataFrame([(e, e % 3, e * 1000, 1.0, "view") for e in ids], "event_id long, user_id long, ts long, value double, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    turns = [(39, 0, "a" * 30), (39, 1, "b" * 90), (40, 0, "c" * 300), (40, 1, "d" * 62), (900, 0, "e" * 238), (900, 1, "f" * 700), (900, 2, "g" * 10)]
    spark.createDataFrame([(v, i, "user", x) for v, i, x in turns], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(r.id for r in run("previous_track")) == ids
    assert {r.event_id: r.seconds for r in run("media_info_parse")} == {e: e // 100 * 3600 + e % 60 * 60 + e * 7 % 60 + 0.5 for e in ids}
    begun = [sum(len(y) for w, j, y in turns if w == v and j < i) / 100 for v, i, _ in turns]
    marks = {t + 0.62 for t, (_, i, _) in zip(begun, turns) if i > 0}
    score = lambda k: sum(max(0, max(1 - abs(t + k * 0.02 - m) / 0.5 for m in marks)) for t in begun) / len(begun)
    best, step = max((round(score(k), 9), -k) for k in range(-250, 251))
    got = run("offset_grid_search")
    assert [r.offset_step for r in got] == [-step] and got[0].score == pytest.approx(best, abs=1e-6)


def test_best_offset_counts_equal_starts_and_distant_ones(spark):
    starts, marks = [0.0, 0.0, 5.49, 100.0, 400.0, None], [1.3, 6.79, 10.99, 101.5]
    score = lambda k: sum(max(0, max(1 - abs(t + k * 0.02 - m) / 0.5 for m in marks)) for t in starts if t is not None) / len(starts)
    best, step = max((round(score(k), 9), -k) for k in range(-250, 251))
    got = T.best_offset(spark.createDataFrame([(t,) for t in starts], "t double"), spark.createDataFrame([(m,) for m in marks], "m double")).first()
    assert (got.offset_step, got.score) == (-step, pytest.approx(best, abs=1e-8))


def test_retrieval_with_feedback_against_a_plain_loop(spark):
    import random
    from collections import defaultdict, deque

    rng = random.Random(3)
    unit = lambda: (lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v])([rng.gauss(0.3, 1) for _ in range(4)])
    faces = [(v * 100 + i, v, rng.choice([0, i // 3, 30 - i // 3]), rng.random(), unit()) for v in range(2) for i in range(60)]
    centers = [(c, unit()) for c in range(7)]
    want = {}
    for v in range(2):
        recent = defaultdict(lambda: deque(maxlen=5))
        for i, _, f, q, e in sorted((r for r in faces if r[1] == v), key=lambda r: (r[2] if r[2] > 0 else math.inf, r[0])):
            near = sorted(((sum(x * y for x, y in zip(e, c)), -k) for k, c in centers), reverse=True)[:4]
            near = [(-k, 0.8 * max(0, s) + 0.2 * (sum(recent[-k]) / len(recent[-k]) if recent[-k] else 0), max(0, s)) for s, k in near]
            for k, a, s in sorted(near, key=lambda x: -x[1])[:2]:
                if a > 0.4:
                    recent[k].append(q * s)
                    want[i, k] = a
    table = spark.createDataFrame(faces, "face_id long, video int, frame_num int, quality double, enc array<double>")
    got = V.retrieve_with_feedback(table, spark.createDataFrame(centers, "cluster_id int, center array<double>"), n=2, threshold=0.4, video=F.col("video")).collect()
    assert {(r.face_id, r.cluster_id): r.adjusted for r in got} == pytest.approx(want) and len(got) == len(want) > 50


def test_rerank_with_history_against_a_plain_loop(spark):
    import random
    from collections import deque

    rng = random.Random(8)
    unit = lambda: (lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v])([rng.gauss(0.6, 0.5) for _ in range(4)])
    faces = [(i, i % 3 if i % 11 else None, rng.choice([i // 3, 60 - i // 3]), unit()) for i in range(200)]
    centers = [(c, unit()) for c in range(6)]
    want, turned = {}, 0
    for v in (None, 0, 1, 2):
        history = deque(maxlen=4)
        for i, _, f, e in sorted((r for r in faces if r[1] == v), key=lambda r: (r[2], r[0])):
            sims = {k: sum(x * y for x, y in zip(e, c)) for k, c in centers}
            best = max(sims, key=lambda k: (sims[k], -k))
            match, s = (best if sims[best] > 0.5 else -1), sims[best]
            votes = {}
            for m, x in history:
                if m >= 0:
                    votes.setdefault(m, []).append(x)
            top = next((m for m in votes if len(votes[m]) == max(map(len, votes.values()))), -1)
            if s > 0.4 and top >= 0 and len(votes[top]) >= 2 and top != match and sims[top] > 0.8 * s:
                adjusted = 0.5 * sims[top] + 0.5 * sum(votes[top]) / len(votes[top])
                if adjusted > s:
                    match, s, turned = top, adjusted, turned + 1
            history.append((match, s))
            want[i] = (match, s)
    table = spark.createDataFrame(faces, "face_id long, place int, frame_num int, enc array<double>")
    got = V.rerank_with_history(table, spark.createDataFrame(centers, "cluster_id int, center array<double>"), F.col("place"), threshold=0.5, weight=0.5, size=4).collect()
    assert turned > 5 and len(got) == 200
    assert {r.face_id: r.match_idx for r in got} == {i: m for i, (m, _) in want.items()}
    assert {r.face_id: r.similarity for r in got} == pytest.approx({i: s for i, (_, s) in want.items()})


def test_safe_merges_leave_unsafe_ones_their_place(spark):
    from vistaloom.operators.clusters import merge_small_into_large_safely

    unit = lambda a: [math.cos(a), math.sin(a)]
    rows = [(0, unit(0.01 * i)) for i in range(10)]
    rows += [(1, unit(x)) for x in (0.04, 0.06)] + [(2, unit(x)) for x in (-0.7, 0.8)] + [(3, unit(0.85))] + [(4, unit(2.0))]
    members = spark.createDataFrame([(i, c, 0, e) for i, (c, e) in enumerate(rows)], "face_id long, cluster_id int, frame_num int, enc array<double>")
    plain = V.merge_small_into_large(members, large=10, small=3, threshold=0.6, cap=2)
    assert sorted((r.cluster_i, r.cluster_j) for r in plain.collect()) == [(0, 1), (0, 2)]  # 2 points both ways: its centre is near, its members are not
    safe = merge_small_into_large_safely(members, large=10, small=3, threshold=0.6, cap=2)
    assert sorted((r.cluster_i, r.cluster_j) for r in safe.collect()) == [(0, 1), (0, 3)]


def test_overlapping_clusters_merge_by_their_first_members(spark):
    from vistaloom.operators.clusters import merge_overlapping

    unit = lambda a: [math.cos(a), math.sin(a)]
    rows = [(c, f, unit(a)) for c, a in ((1, 0.0), (2, 0.3), (3, 0.6), (5, 3.0)) for f in range(1, 8)]
    rows += [(4, f, unit(0.6)) for f in range(20, 28)]  # as near as 3, but in other frames
    rows += [(6, f, unit(0.1 + (2.0 if f <= 5 else -0.5))) for f in range(1, 30)]  # its first members are far from its centre
    members = spark.createDataFrame([(i, c, f, e) for i, (c, f, e) in enumerate(rows)], "face_id long, cluster_id int, frame_num int, enc array<double>")
    got = {r.cluster_id: r.merged_id for r in merge_overlapping(members, 0.9).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
