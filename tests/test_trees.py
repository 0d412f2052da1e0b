"""Reports in trees of folders, missing and odd ones; files paired by stem; keys of nested records against a plain recursion."""

import json
import random
from pathlib import Path

from pyspark.sql import functions as F

from vistaloom.functions import nested
from vistaloom.sources import trees

REPORT = """Total samples: 1200
Correct predictions: 1100
Overall Accuracy: 0.9167

Macro Average:
  Precision: 0.8
  Recall: 0.7
Weighted Average:
  Precision: 0.6
  F1-Score: 0.5
Best performing class: 12.
F1-Score: 0.1
"""


def _put(base: Path, name: str, text: str = ""):
    (base / name).parent.mkdir(parents=True, exist_ok=True)
    (base / name).write_text(text)


def test_metrics_tree(spark, tmp_path):
    for method, folder in (("MTCNN+FaceNet", "result_ep1"), ("MTCNN+FaceNet", "result_ep10"), ("other", "result_ep1")):
        _put(tmp_path, f"{method}/{folder}/metrics_summary.txt", f"Overall Accuracy: 0.{len(folder)}")
    _put(tmp_path, "MTCNN+FaceNet/result_ep2/else.txt", "Overall Accuracy: 1")
    got = trees.read_metrics_tree(spark, str(tmp_path), ["MTCNN+FaceNet", "absent"], ["result_ep1", "result_ep2", "result_ep3"])
    assert [tuple(r)[:3] for r in got.collect()] == [("MTCNN+FaceNet", "result_ep1", 1)]
    assert [Path(f).parent.name for f in got.inputFiles()] == ["result_ep1"]  # nothing else is opened
    assert trees.read_metrics_tree(spark, str(tmp_path), ["absent"], ["result_ep1"]).count() == 0
    every = trees.read_episode_reports(spark, str(tmp_path / "MTCNN+FaceNet")).collect()
    assert sorted(r.episode for r in every) == [1, 10]


def test_report_fields_keep_to_their_sections(spark):
    got = spark.createDataFrame([(REPORT,), ("",), (None,), ("Macro Average: Precision: 0.3",), ("Weighted Average: Recall: 1.2.3 F1-Score: .5",)], "report string")
    rows = got.select(*(c.alias(n) for n, c in trees.report_fields(F.col("report")).items())).collect()
    assert rows[0].asDict() == {"total_samples": 1200, "correct_predictions": 1100, "overall_accuracy": 0.9167, "weighted_precision": 0.6, "weighted_recall": None, "weighted_f1": 0.5, "macro_precision": 0.8, "macro_recall": 0.7, "macro_f1": None, "best_class": 12.0, "worst_class": None}
    assert all(v is None for r in rows[1:4] for v in r) and rows[4].weighted_f1 == 0.5 and rows[4].weighted_recall is None


def test_pairs_by_stem(spark, tmp_path):
    for name in ("v/a.mp4", "v/b.b.mkv", "v/c.mov", "v/d.txt", "a/a.wav", "a/a.mp3", "a/b.b.ogg", "a/b.wav", "a/d.mp3", "a/c.flac.bak"):
        _put(tmp_path, name, "x")
    found = trees.pair_by_stem(trees.list_files(spark, str(tmp_path / "v"), trees.VIDEOS), trees.list_files(spark, str(tmp_path / "a"), trees.AUDIOS)).collect()
    assert {(Path(r.video).name, Path(r.audio).name) for r in found} == {("a.mp4", "a.mp3"), ("b.b.mkv", "b.b.ogg")}


def search(data, words, depth, first, level=0, path=""):
    named = lambda k: any(w in k.lower() for w in words)
    below = lambda k: f"{path}.{k}" if path else k
    if isinstance(data, list):
        return [(0, "list", f"[0].{k}", v) for k, v in data[0].items() if named(k)] if not level and data and isinstance(data[0], dict) else []
    out = []
    for k, v in sorted(data.items())[:first] if isinstance(data, dict) and level < depth else []:
        out += [(level, "field", below(k), v)] if named(k) else []
        if isinstance(v, dict):
            out += [(level, "inner", f"{below(k)}.{x}", y) for x, y in v.items() if named(x)] + search(v, words, depth, first, level + 1, below(k))
        elif isinstance(v, list) and v and isinstance(v[0], dict):
            out += [(level, "item", f"{below(k)}[0].{x}", y) for x, y in v[0].items() if named(x)]
    return out


def test_key_search_against_a_recursion(spark):
    rng = random.Random(9)
    names = [*nested.CHARACTER_KEYS, "Label", "x", "y", "z", "my_face_id_2", "q"]

    def made(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice([1, 2.5, "t", True, None])
        if kind < 0.5:
            return [made(depth - 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice(names): made(depth - 1) for _ in range(rng.randint(0, 5))}

    records = [made(5) for _ in range(80)] + [{f"k{i:02}_label": i for i in range(30)}, [], {}, [{"label": 1}, {"label": 2}], None]
    table = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id long, t string").select("id", F.parse_json("t").alias("data"))
    got = sorted((r.id, r.level, r.kind, r.path, json.dumps(json.loads(r.value), sort_keys=True)) for r in nested.find_keys(table, nested.CHARACTER_KEYS, depth=3, first=4).collect())
    want = sorted((i, *x[:3], json.dumps(x[3], sort_keys=True)) for i, r in enumerate(records) for x in search(r, nested.CHARACTER_KEYS, 3, 4))
    assert got == want and len(got) > 100
    numbers = spark.createDataFrame([(1, '{"7": 1, "x": {"1000000": 2, "12": 3}, "frame_no": 4}')], "id long, t string").select("id", F.parse_json("t").alias("data"))
    assert {(r.kind, r.path) for r in nested.find_keys(numbers, nested.FRAME_KEYS, numbers=True).collect()} == {("number", "7"), ("number", "x.12"), ("field", "frame_no")}
