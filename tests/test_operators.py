import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillforge.functions import geometry as gm
from quillforge.functions import text as tx
from quillforge.operators import corpus as cp
from quillforge.operators import ctc
from quillforge.operators import layout as lo
from quillforge.operators import regions as rg
from quillforge.operators import metrics as mt
from quillforge.sources import readers
from quillforge.streaming import jobs as jb
from quillforge.streaming import limits


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_normalize(spark):
    assert one(spark, tx.normalize_text(F.col("t")), t="  a\u00a0\t b \r\n\r\n\r\n\r\nc\re\u0301 ") == "a b\n\nc\n\u00e9"
    assert one(spark, tx.normalize_line(F.col("t")), t="a\nb  c") == "a b c"


def test_script_ratio(spark):
    assert one(spark, tx.script_ratio(F.col("t")), t="\u0e81\u0e82ab") == 0.5
    assert one(spark, tx.script_ratio(F.col("t")), t="... !") == 0.0


def test_word_edits_against_a_plain_version(spark):
    rng = random.Random(1)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    pairs = [(" ".join(rng.choices("abcd\u0e81", k=rng.randrange(0, 9))), " ".join(rng.choices("abcde", k=rng.randrange(0, 9)))) for _ in range(100)]
    got = mt.edit_columns(spark.createDataFrame(pairs, "reference string, hypothesis string")).collect()
    assert [r["word_edits"] for r in got] == [plain(r["reference"].split(), r["hypothesis"].split()) for r in got]


def test_empty_reference(spark):
    rows = mt.edit_columns(spark.createDataFrame([("", ""), ("", "x")], "reference string, hypothesis string"))
    assert [r["c"] for r in rows.select(tx.error_rate(F.col("char_edits"), F.col("n_chars"), F.col("h_chars")).alias("c")).collect()] == [0.0, 1.0]


def test_small_recognizers(spark):
    assert one(spark, tx.safe_filename(F.col("t")), t="../a/b c?.pdf") == "b c_.pdf"
    assert [one(spark, tx.safe_filename(F.col("t")), t=t) for t in ("...", "..", "", "a\\b/", ".x", "e\u0301 .PNG")] == ["document", "document", "document", "document", "x", "\u00e9.png"]
    routes = {"/v1/jobs/batch": "/v1/jobs/batch", "/v1/jobs/ab": "/v1/jobs/{job_id}", "/v1/jobs/ab/download": "/v1/jobs/{job_id}/download", "/v1/jobs/ab/x": "/v1/jobs/ab/x", "/v1/health": "/v1/health", "/v1/jobs/": "/v1/jobs/"}
    assert {t: one(spark, tx.route(F.col("t")), t=t) for t in routes} == routes
    assert one(spark, tx.escape_label(F.col("t")), t='a"b\\c\nd') == 'a\\"b\\\\c\\nd'
    assert one(spark, tx.value_like(F.col("t")), t="1,200.50 LAK") and not one(spark, tx.value_like(F.col("t")), t="total")
    assert one(spark, tx.tags(F.col("t")), t=[" B", "a", "b", " "]) == ["a", "b"]
    assert one(spark, tx.list_style(F.col("t")), t=["1. a", "more", "2) b"]) == "ordered"
    assert one(spark, tx.list_style(F.col("t")), t=["1. a", "- b"]) is None
    assert one(spark, tx.list_items(F.col("t")), t=["1. a", " more", "2) b"]) == ["a more", "b"]
    assert one(spark, tx.list_items(F.col("t")), t=["a", "1. b"]) is None
    assert [one(spark, tx.safe_relative(F.col("t")), t=t) for t in ("a/b", "/a", "a/../b", "C:\\x", "")] == [True, False, False, False, False]
    assert one(spark, tx.clusters(F.col("t")), t="\u0eb1\u0e81\u0eb1b") == ["\u0eb1", "\u0e81\u0eb1", "b"]


def test_sampler_keeps_texts_for_later_documents(spark):
    rows = [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "c"), (2, 1, "a"), (3, 0, "d")]
    frame = spark.createDataFrame(rows, "doc_id long, pos int, line string").repartition(3)
    assert [r["line"] for r in cp.bounded_sample(frame, 10, 2).collect()] == ["a", "b", "c", "d"]
    assert [r["line"] for r in cp.bounded_sample(frame, 3, 2).collect()] == ["a", "b", "c"]
    assert [r["line"] for r in cp.bounded_sample(frame, 10, 2, max_documents=1).collect()] == ["a", "b"]


def test_calibration_chunks(spark):
    points = spark.createDataFrame([(i / 11, 1 - i / 22) for i in range(11)], "confidence double, accuracy double")
    bins = mt.calibration_bins(points)
    assert sorted(r["points"] for r in bins.collect()) == [1, 2, 2, 2, 2, 2]
    got = mt.calibrated(spark.createDataFrame([(-1.0,), (0.0,)], "v double"), bins, "v").collect()
    assert [round(r["calibrated"], 6) for r in got] == [round(1 - 0.5 / 22, 6)] * 2


def test_gate_is_strict(spark):
    same = spark.createDataFrame([("overall", "all", 0.1)], "kind string, name string, cer double")
    better = spark.createDataFrame([("overall", "all", 0.05)], "kind string, name string, cer double")
    assert not mt.gate(mt.compare(same, same, "cer")).first()["accepted"]
    assert mt.gate(mt.compare(same, better, "cer")).first()["accepted"]


def test_greedy_matching(spark):
    rng = random.Random(2)
    rows = [(p, r, q, rng.choice([0.3, 0.5, 0.9])) for p in range(5) for r in range(4) for q in range(4)]
    got = {(m["page"], m["ref"], m["pred"]) for m in lo.greedy(spark.createDataFrame(rows, "page long, ref long, pred long, iou double")).collect()}
    want = set()
    for page in range(5):
        used_r, used_p = set(), set()
        for v, r, p in sorted(((v, r, p) for g, r, p, v in rows if g == page), reverse=True):
            if r not in used_r and p not in used_p:
                want.add((page, r, p))
                used_r.add(r)
                used_p.add(p)
    assert got == want


def test_row_clusters_and_regions(spark):
    lines = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 4, 10), (1, 2, 8, 10), (1, 3, 40, 10)], "page long, ord long, y long, h long")
    assert [r["row"] for r in lo.row_clusters(lines).orderBy("ord").collect()] == [0, 0, 0, 1]
    boxes = spark.createDataFrame([(1, 1000, 1400, 0, 0, 0, 10, 10), (1, 1000, 1400, 1, 15, 0, 10, 10), (1, 1000, 1400, 2, 500, 0, 10, 10), (1, 1000, 1400, 3, 502, 34, 10, 10), (1, 1000, 1400, 4, 500, 80, 10, 10)], "page long, page_width long, page_height long, ord long, x long, y long, w long, h long")
    assert [(r["x"], r["y"], r["w"], r["h"]) for r in rg.merged_regions(boxes).orderBy("ord").collect()] == [(0, 0, 25, 10), (500, 0, 12, 44), (500, 80, 10, 10)]


def test_rotation_turns_back(spark):
    frame = spark.createDataFrame([(5, 7, 20, 30)], "x int, y int, w int, h int")
    box, w, h = gm.Box.of(), F.lit(100), F.lit(200)
    once = gm.rotated(box, F.lit(90), w, h)
    back = gm.rotated(once, F.lit(270), h, w)
    assert tuple(frame.select(back.x, back.y, back.w, back.h).first()) == (5, 7, 20, 30)


def test_beam_against_all_paths():
    rng = np.random.default_rng(4)
    for _ in range(15):
        p = np.log(rng.dirichlet(np.ones(3), size=4))
        total = {}
        for path in itertools.product(range(3), repeat=4):
            labels = tuple(k for k, _ in itertools.groupby(path) if k)
            total[labels] = total.get(labels, 0.0) + math.exp(sum(p[t, k] for t, k in enumerate(path)))
        best = max(total.items(), key=lambda kv: kv[1])
        labels, log_p, ranking, _ = ctc.beam_search(p, 200)
        assert tuple(labels) == best[0] and log_p == ranking == pytest.approx(math.log(best[1]))
        model = ctc.LabelModel(2, 2, {(): {1: 3, 2: 1}, (1,): {2: 5}, (-1,): {1: 1}})
        fused = max(total.items(), key=lambda kv: math.log(kv[1]) + 0.7 * model.sequence(kv[0]) + 0.3 * len(kv[0]))
        got = ctc.beam_search(p, 200, scorer=model.score, weight=0.7, bonus=0.3)
        assert tuple(got.labels) == fused[0] and got.log_prob == pytest.approx(math.log(fused[1])) and got.model_log_prob == pytest.approx(model.sequence(fused[0]))


def test_beam_inputs_and_fusion_columns(spark):
    assert ctc.beam_search(np.zeros((0, 3))) == ([], 0.0, 0.0, 0.0)
    for bad in ({"width": 0}, {"weight": 1.0}, {"bonus": math.inf}, {"blank": 3}):
        with pytest.raises(ValueError):
            ctc.beam_search(np.zeros((2, 3)), **bad)
    with pytest.raises(ValueError):
        ctc.beam_search(np.full((2, 3), -np.inf))
    sequences = spark.createDataFrame([([1, 2, 1],), ([1, 1],), ([],)], "ids array<long>")
    counts = ctc.label_counts(sequences, 2)
    assert {(tuple(r["context"]), r["label"]): r["n"] for r in counts.collect()} == {((), 1): 4, ((), 2): 1, ((-1,), 1): 2, ((1,), 2): 1, ((2,), 1): 1, ((1,), 1): 1}
    model = ctc.LabelModel.collect(counts, 2, 2)
    assert model.score((), 1) == pytest.approx(math.log(2.1 / 2.2)) and model.score((2,), 2) == pytest.approx(math.log(0.1 / 1.2))
    with pytest.raises(ValueError):
        ctc.LabelModel.collect(counts, 2, 2, most=1)
    p = np.log([[0.2, 0.4, 0.4], [0.6, 0.2, 0.2], [0.1, 0.45, 0.45]])
    frame = spark.createDataFrame([(p.tolist(),), (None,)], "x array<array<double>>")
    got = [r["d"] for r in frame.select(ctc.beam_decode(50, model=model, weight=2.0, bonus=0.1)(F.col("x")).alias("d")).collect()]
    want = ctc.beam_search(p, 50, scorer=model.score, weight=2.0, bonus=0.1)
    assert list(got[0]["labels"]) == want.labels and got[0]["ranking"] == pytest.approx(want.ranking) and want.labels != ctc.beam_search(p, 50).labels


def test_ctc_columns(spark):
    assert one(spark, ctc.collapse(F.col("t")), t=[0, 1, 1, 0, 1, 2, 2, 0]) == [1, 1, 2]
    assert one(spark, ctc.collapse(F.col("t")), t=[3]) == [3]
    assert one(spark, ctc.needed_steps(F.col("t")), t=[1, 1, 2, 2, 2]) == 8


REQUESTS = [("a", 0, 100.0, 1), ("a", 1, 101.0, 1), ("a", 2, 102.0, 1), ("a", 3, 111.1, 1), ("b", 4, 100.0, 3), ("b", 5, 110.0, 2), ("b", 6, 120.0, 1)]


def test_quota_table_and_stream(spark, tmp_path):
    schema = "key string, ord long, ts double, cost int"
    frame = spark.createDataFrame(REQUESTS, schema)
    rows = {r["ord"]: (r["admitted"], r["retry_after"]) for r in limits.admit(frame, 2, 10.0).collect()}
    assert [rows[i][0] for i in range(7)] == [True, True, False, True, False, True, True]
    assert rows[2][1] == 8 and rows[4][1] == 10
    assert all(r["remaining"] == 0 for r in limits.admit(frame, 2, 10.0).collect() if not r["admitted"])
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = limits.admit_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 2, 10.0)
    q = stream.writeStream.format("memory").queryName("quota").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r["ord"]: (r["admitted"], r["retry_after"]) for r in spark.table("quota").collect()} == rows


def test_quota_rules():
    q = limits.Quota(2, 10)
    with pytest.raises(ValueError, match="one unit"):
        q.ask(0.0, 0)
    assert q.ask(0.0, 3) == (False, 0, 10) and q.ask(0.0, 2) == (True, 0, 0) and q.ask(9.5) == (False, 0, 1) and q.ask(10.0) == (True, 1, 0)
    assert limits.Quota(0, 10).ask(0.0, 5) == (True, 0, 0)
    with pytest.raises(ValueError, match="window"):
        limits.Quota(1, 0.5)
    k = limits.Keyed(1, 10, most=2)
    assert k.ask("a", 0.0)[0] and k.ask("b", 5.0)[0]
    assert k.ask("c", 6.0) == (False, 0, 10) and k.ask("c", 10.0) == (True, 0, 0)  # a is idle by then
    assert k.ask("b", 11.0) == (False, 0, 4) and k.snapshot()["tracked_clients"] == 2


def test_bounded_keys_in_a_table(spark):
    rows = [("s", "a", 0, 0.0, 1), ("s", "b", 1, 5.0, 1), ("s", "c", 2, 6.0, 1), ("s", "c", 3, 10.0, 1), ("t", "c", 4, 6.0, 1)]
    frame = spark.createDataFrame(rows, "server string, key string, ord long, ts double, cost int").repartition(3)
    got = {r["ord"]: (r["admitted"], r["retry_after"]) for r in limits.admit_bounded(frame, 1, 10.0, 2, "server").collect()}
    assert got == {0: (True, 0), 1: (True, 0), 2: (False, 10), 3: (True, 0), 4: (True, 0)}
    answers = limits.admit_bounded(frame, 1, 10.0, 2, "server")
    assert limits.tracked(answers.where("server = 's'"), 10.0, 10.0, 1, 2).first()["tracked_clients"] == 2


def test_lifecycle_table_and_stream(spark, tmp_path):
    schema = "job_id string, ord long, event string"
    steps = {"a": ["reserve", "enqueue", "start", "succeed", "cancel"], "b": ["enqueue", "reserve", "cancel", "enqueue"], "c": ["reserve", "enqueue", "cancel", "start"], "d": ["reserve", "enqueue", "start", "cancel", "succeed"], "e": ["reserve", "enqueue", "start", "cancel", "fail"]}
    frame = spark.createDataFrame([(j, i, e) for j, es in steps.items() for i, e in enumerate(es)], schema)
    got = {(r["job_id"], r["ord"]): (r["status"], r["taken"]) for r in jb.lifecycle(frame).collect()}
    assert got["a", 3] == ("succeeded", True) and got["a", 4] == ("succeeded", False)
    assert got["b", 0] == (None, False) and got["b", 2] == ("uploading", True) and got["b", 3] == ("cancelled", True)
    assert got["c", 2] == ("cancelled", True) and got["c", 3] == ("cancelled", False)
    assert got["d", 4] == ("cancelled", True) and got["e", 4] == ("failed", True)
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = jb.lifecycle_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("jobs").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {(r["job_id"], r["ord"]): (r["status"], r["taken"]) for r in spark.table("jobs").collect()} == got


def test_journal_is_all_or_nothing(spark):
    kinds = "job_id string, artifact_key string, workspace_pending boolean, failures int"
    at = F.lit("2024-01-01").cast("timestamp")
    journal = spark.createDataFrame([("a", None, True, 0), ("b", "k", True, 2)], kinds).withColumn("retry_at", at)
    change = lambda rows: spark.createDataFrame(rows, f"op string, {kinds}").withColumn("retry_at", at)
    keys = lambda f: sorted((r["job_id"], r["artifact_key"], r["failures"]) for r in f.collect())
    after, bad = jb.journal_step(journal, change([("publish", "a", "x", True, 0), ("add", "c", None, True, 0)]), 9)
    assert bad.count() == 0 and keys(after) == [("a", "x", 0), ("b", "k", 2), ("c", None, 0)]
    after, bad = jb.journal_step(journal, change([("publish", "b", "x", True, 0), ("add", "c", None, True, 0)]), 9)
    assert [r["problem"] for r in bad.collect()] == ["workspace is not owned"] and keys(after) == keys(journal)
    after, bad = jb.journal_step(journal, change([("add", "c", None, True, 0)]), 2)
    assert [r["problem"] for r in bad.collect()] == ["journal is full"] and keys(after) == keys(journal)
    after, _ = jb.journal_step(journal, change([("update", "a", None, False, 0), ("expire", "d", None, True, 0)]), 9)
    assert keys(after) == [("b", "k", 2), ("d", None, 0)]


def test_job_states(spark):
    events = spark.createDataFrame([("j", 1, "queued"), ("j", 2, "succeeded"), ("j", 3, "running"), ("k", 1, "queued")], "job_id string, ord long, status string")
    assert {r["job_id"]: r["status"] for r in jb.latest(events).collect()} == {"j": "succeeded", "k": "queued"}


def test_readers(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"text": "a"}\n\n{"text": 3}\nnope\n[1]\n')
    good, bad = readers.jsonl_texts(spark, str(tmp_path / "t.jsonl"))
    assert [r["text"] for r in good.collect()] == ["a"]
    assert sorted(r["problem"] for r in bad.collect()) == ["no text", "not JSON", "not an object"]
    (tmp_path / "m.jsonl").write_text('# note\n{"id": "1", "document_id": "d", "tags": ["x"]}\n{"id": "2"}\n{broken\n')
    good, bad = readers.manifest(spark, str(tmp_path / "m.jsonl"))
    assert [r["id"] for r in good.collect()] == ["1"] and bad.count() == 2
    (tmp_path / "r.csv").write_text("id,status,reviewer,notes\na,approved,x,\nb,,x,\na,rejected,x,\nc,maybe,x,\n")
    rows, bad = readers.review_decisions(spark, str(tmp_path / "r.csv"))
    assert rows.count() == 3 and sorted(r["problem"] for r in bad.collect()) == ["decided twice", "unknown status"]
    (tmp_path / "s.txt").write_text("a" * 64 + "  x/y\n" + "b" * 64 + "  ../z\nbad\n")
    assert [r["problem"] for r in readers.checksums(spark, str(tmp_path / "s.txt")).collect()] == [None, "unsafe path", "bad line"]
    (tmp_path / "l.txt").write_text("one\n\ntwo\n")
    assert [(r["pos"], r["line"]) for r in readers.text_lines(spark, str(tmp_path / "l.txt")).collect()] == [(0, "one"), (1, ""), (2, "two")]
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4")
    assert [r["kind"] for r in readers.file_hashes(spark, str(tmp_path / "x.pdf")).collect()] == ["pdf"]
