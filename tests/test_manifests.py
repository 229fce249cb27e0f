"""Typed scans, listings and sinks on small files."""

import json

from pyspark.sql import functions as F

from quillforge.functions import values as vl
from quillforge.sources import manifests as mf
from quillforge.sources import sinks

A, B = "a" * 64, "b" * 64


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def problems(bad):
    return sorted((r["line_number"], r["problem"]) for r in bad.collect())


def test_dataset_manifest(spark, tmp_path):
    good = {"id": "1", "document_id": "d", "split": "test", "subset": "form", "source": "s.png", "ground_truth": "g.txt", "tags": ["x"], "sha256": A}
    path = lines(tmp_path / "m.jsonl", ["# note", "", good, {**good, "source": None}, {**good, "id": "2", "sha256": "zz"}, "{broken", {**good, "id": "3"}])
    rows, bad = mf.dataset_manifest(spark, path)
    assert [(r["id"], r["line_number"]) for r in rows.orderBy("id").collect()] == [("1", 3), ("3", 7)]
    assert problems(bad) == [(4, "duplicate id"), (4, "no source"), (5, "bad sha256"), (6, "bad line")]
    assert [r["problem"] for r in mf.dataset_manifest(spark, lines(tmp_path / "e.jsonl", ["# nothing"]))[1].collect()] == ["no entries"]


def test_training_manifest_against_files(spark, tmp_path):
    path = lines(tmp_path / "t.jsonl", [{"id": "1", "image": "a", "text": "x", "sha256": A}, {"id": "2", "image": "b", "text": "y", "sha256": A}, {"id": "3", "image": "c", "text": "z"}, {"id": "4", "image": "a", "text": ""}])
    files = spark.createDataFrame([("a", A), ("b", B)], "path string, sha256 string")
    rows, bad = mf.training_manifest(spark, path, files)
    assert [r["id"] for r in rows.collect()] == ["1"]
    assert problems(bad) == [(2, "sha256 mismatch"), (3, "image missing"), (4, "no text")]


def test_layout_manifests(spark, tmp_path):
    good = {"id": "1", "document_id": "d", "image": "a.png", "layout_ground_truth": "a.json", "split": "train", "subset": "form", "width": 5, "height": 6, "block_counts": {"list": 2}}
    path = lines(tmp_path / "l.jsonl", [good, {**good, "id": "2", "image": "../a"}, {**good, "id": "3", "width": 0}, {**good, "id": "4", "block_counts": {"list": -1}}, {**good, "id": "5", "document_id": ""}])
    rows, bad = mf.layout_training_manifest(spark, path)
    assert [(r["id"], r["block_counts"]) for r in rows.collect()] == [("1", {"list": 2})]
    assert problems(bad) == [(2, "unsafe image"), (3, "page without size"), (4, "negative count"), (5, "no document_id")]
    target = {"id": "1", "image": "a", "mask": "m", "split": "dev", "subset": "x"}
    rows, bad = mf.layout_target_manifest(spark, lines(tmp_path / "g.jsonl", [target, {**target, "id": "2", "split": "other"}, target, {**target, "id": "3", "mask": "/m"}]))
    assert [r["id"] for r in rows.collect()] == ["1"] and problems(bad) == [(2, "bad split"), (3, "duplicate id"), (4, "unsafe mask")]


def test_documents_and_ground_truth(spark, tmp_path):
    box = {"x": 0, "y": 0, "width": 10, "height": 10}
    cell = {"row": 0, "column": 0, "text": "t"}
    table = {"type": "table", "text": "t", "bbox": box, "metadata": {"rows": "1", "columns": "2"}, "cells": [cell, {**cell, "column_span": 2}, {**cell, "row": 1}, {**cell, "row": -1}, {**cell, "column": 1, "row_span": 0}]}
    page = {"number": 1, "width": 100, "height": 50, "blocks": [table, {"type": "list", "text": "x"}, {"type": "list", "text": "x", "bbox": {**box, "x": 95}}, {"type": "table", "text": "", "bbox": {**box, "y": -1}, "metadata": {}}]}
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": "1", "pages": [page]}))
    (tmp_path / "b.json").write_text(json.dumps({"pages": [page, page]}))
    (tmp_path / "c.json").write_text("{nope")
    docs = mf.documents(spark, str(tmp_path / "*.json"))
    found = mf.ground_truth_problems(docs).withColumn("file", F.substring_index("file", "/", -1))
    got = sorted((r["file"], r["block"] if r["block"] is not None else -1, r["cell"] if r["cell"] is not None else -1, r["problem"]) for r in found.collect())
    assert got == [
        ("a.json", 0, 1, "cell overlaps another"), ("a.json", 0, 2, "cell beyond the rows"), ("a.json", 0, 3, "negative cell"), ("a.json", 0, 4, "cell without span"),
        ("a.json", 1, -1, "no box"), ("a.json", 2, -1, "box outside the page"), ("a.json", 3, -1, "negative place"), ("a.json", 3, -1, "no number of columns"), ("a.json", 3, -1, "no number of rows"),
        ("b.json", -1, -1, "not one page"), ("c.json", -1, -1, "bad document"),
    ]
    assert mf.document_blocks(docs).count() == 12


def test_benchmark_report(spark, tmp_path):
    good = {"schema_version": "1", "overall": {"cer": 0.5}, "subsets": {"form": {"cer": 0.25}}, "tags": {"t": {"cer": 1.0}}, "samples": [{"id": "a", "subset": "form", "tags": []}, {"id": "a", "subset": None}]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps({"schema_version": "2"}))
    slices, samples, bad = mf.benchmark_report(spark, str(tmp_path / "*.json"))
    assert sorted((r["kind"], r["name"], r["metrics"]["cer"]) for r in slices.collect()) == [("overall", "all", 0.5), ("subset", "form", 0.25), ("tag", "t", 1.0)]
    assert samples.count() == 2
    assert sorted(r["problem"] for r in bad.collect()) == ["no overall metrics", "no samples", "sample twice", "sample without subset", "unknown schema"]


def test_suites_packs_and_worksheets(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"sources": [{"id": "a", "status": "old"}, {"id": "a", "status": "new", "evidence": {"text_layer": "none", "pages": 3}}, {"id": ""}]}))
    assert [(r["id"], r["status"], r["pages"]) for r in mf.registry(spark, str(tmp_path / "r.json")).collect()] == [("a", "new", 3)]
    (tmp_path / "s.json").write_text(json.dumps({"schema_version": "1", "id": "s", "sources": [{"id": "a", "pages": [3, 1, 3], "expected_text_layer": "none"}, {"id": "b", "pages": [0], "expected_text_layer": ""}, {"id": "c", "pages": [], "expected_text_layer": "x", "max_source_mb": 0}]}))
    rows, bad = mf.diagnostic_suite(spark, str(tmp_path / "s.json"))
    assert [(r["id"], r["pages"], r["rotation_probe"]) for r in rows.collect()] == [("a", [3, 1], False)]
    assert sorted((r["id"], r["problem"]) for r in bad.collect()) == [("b", "bad page"), ("b", "no expected text layer"), ("c", "bad size"), ("c", "no pages")]
    (tmp_path / "p.json").write_text(json.dumps({"schema_version": "1", "pack_id": "p", "pages": [{"id": "x", "image": "i", "ground_truth": "../g", "sha256": A}]}))
    pages, bad = mf.capture_pack(spark, str(tmp_path / "p.json"))
    assert pages.first()["template"] == "plain" and [r["problem"] for r in bad.collect()] == ["unsafe path"]
    (tmp_path / "c.json").write_text(json.dumps({"schema_version": "0", "suite_id": "s", "packs": []}))
    assert sorted(r["problem"] for r in mf.capture_suite(spark, str(tmp_path / "c.json"))[1].collect()) == ["no packs", "unknown schema"]
    (tmp_path / "w.csv").write_text("combined_page,template,page_id,required_capture_modes\n1,plain,a,scan; photo;scan\n1,plain,b,scan\nx,,-c,\n3,form,d,other\n")
    rows, bad = mf.worksheet(spark, str(tmp_path / "w.csv"), ["scan", "photo"])
    assert rows.count() == 0
    assert sorted((r["page_id"], r["problem"]) for r in bad.collect()) == [("-c", "bad page number"), ("-c", "no modes"), ("-c", "no template"), ("-c", "unsafe page id"), ("a", "page number twice"), ("b", "page number twice"), ("d", "unknown mode")]
    (tmp_path / "v.csv").write_text("template,page_id\nplain,a\n")
    assert sorted(r["problem"] for r in mf.worksheet(spark, str(tmp_path / "v.csv"), [])[1].collect()) == ["no column combined_page", "no column required_capture_modes"]


def test_listings(spark):
    entries = [(0, "x", "file", 5, 1), (1, "d", "directory", 9, 2), (2, "y", "file", 7, 2), (3, ".staging/lock-3f", "file", 1, 1), (4, "q/.a.%s.tmp" % ("0" * 32), "file", 2, 1)]
    frame = spark.createDataFrame(entries, "ord long, path string, kind string, size long, links int")
    categories, items, status = mf.inventory(frame, most_entries=4, most_items=2)
    got = {r["category"]: (r["n"], r["bytes"]) for r in categories.collect()}
    assert len(got) == 9 and got["hardlinked_file"] == (1, 7) and got["coordination_lock_candidate"] == (1, 1) and got["directory"] == (1, 0) and got["legacy_temporary_candidate"] == (0, 0)
    assert items.count() == 2 and status.first().asDict() == {"entries_seen": 4, "entry_limit": True, "items_omitted": 2, "status": "partial"}
    schema = "page_no int, key_marker string, upload_marker string, uploads array<struct<key:string,upload_id:string>>"

    def listing(*pages):
        uploads, told = mf.multipart_listing(spark.createDataFrame(pages, schema), "p/")
        r = told.first()
        return uploads.count(), r["pages_accepted"], r["status"], r["issue"]

    one, two = (1, "p/b", "1", [("p/a", "1"), ("p/b", "1")]), (2, None, None, [("p/c", "1")])
    assert listing(one, two) == (3, 2, "complete", None)
    assert listing(one) == (2, 1, "partial", None)
    assert listing(one, (2, None, None, [("p/a", "1")])) == (2, 1, "partial", "duplicate_upload")
    assert listing(one, (2, "p/a", "1", []), (3, None, None, [])) == (2, 1, "partial", "pagination_regression")
    assert listing(one, (2, "p/b", "1", []), (3, None, None, [])) == (2, 1, "partial", "pagination_cycle")
    assert listing((1, None, None, [("other", "1")])) == (0, 0, "partial", "invalid_response")
    journal = spark.createDataFrame([("b", None, 1, "2024-01-01 00:00:00", 0), ("a", "k", 2, "x", -1)], "job_id string, artifact_key string, workspace_pending int, retry_at string, failures int")
    good, bad = mf.journal_rows(journal, 5)
    assert [r["job_id"] for r in good.collect()] == ["b"] and sorted(r["problem"] for r in bad.collect()) == ["bad failures", "bad flag", "bad time"]
    assert "too many entries" in [r["problem"] for r in mf.journal_rows(journal, 1)[1].collect()]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, text string")
    path = str(tmp_path / "out")
    assert sinks.append_jsonl(rows, path).count() == 0
    again = spark.createDataFrame([("2", "c"), ("3", "d")], "id string, text string")
    assert [r["id"] for r in sinks.append_jsonl(again, path).collect()] == ["2"]
    assert spark.read.json(path).count() == 2
    assert sinks.append_jsonl(again.where("id = '3'"), path).count() == 0 and spark.read.json(path).count() == 3
    assert json.loads(sinks.indented_json(rows.where("id = '1'")).first()["value"]) == {"id": "1", "text": "a"}
    text = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("e", 1, "")], "key string, pos int, line string")
    assert {r["key"]: r["text"] for r in sinks.corpus_text(text, "key", "pos").collect()} == {"k": "a\nb\n", "e": ""}
    vocab = spark.createDataFrame([("b", 2), ("a", 1)], "char string, id long")
    assert json.loads(sinks.vocabulary_json(vocab).first()["value"])["characters"] == ["a", "b"]
    queue = spark.createDataFrame([("x", "rejected", "form", "<b>", ["bad & odd"]), ("y", "pending", "form", None, [])], "id string, status string, subset string, text string, problems array<string>")
    sinks.write_queue(queue, str(tmp_path / "q"))
    cards = sinks.queue_cards(queue).collect()
    assert [c["id"] for c in cards] == ["y", "x"] and "&lt;b&gt;" in cards[1]["html"] and "<li>bad &amp; odd</li>" in cards[1]["html"] and "<ul>" not in cards[0]["html"]
    assert spark.read.csv(str(tmp_path / "q/queue.csv"), header=True).count() == 2


def test_draws_are_the_generators(spark):
    import numpy as np

    rows = vl.profiles(spark).where("profile = 'noisy-scan'").withColumn("seed", F.lit(7))
    got = vl.seeded_draws(rows).first()["draw"]
    rng = np.random.default_rng(7)
    want = [rng.uniform(-2.0, 2.0), rng.uniform(1 - 0.12, 1 + 0.12), rng.uniform(1 - 0.16, 1 + 0.16), rng.uniform(0, 0.75), rng.uniform(0, 8.0)]
    assert np.allclose(list(got), want, atol=1e-12)


def test_ordered_fingerprint(spark):
    import hashlib

    from quillforge.operators import audits as au

    rows = [(2, "b", "t\"é", B), (1, "a", "x", A)]
    digest = hashlib.sha256()
    for _, i, t, h in sorted(rows):
        record = json.dumps([i, t, h], ensure_ascii=False, separators=(",", ":")).encode()
        digest.update(len(record).to_bytes(8, "big") + record)
    frame = spark.createDataFrame(rows, "ord long, id string, plain string, sha256 string")
    assert au.ordered_fingerprint(frame).first()["fingerprint"] == digest.hexdigest()
    odd = spark.createDataFrame([(1, "a", " ", A), (2, "a", "x", "zz"), (3, None, "y", B)], "ord long, id string, text string, sha256 string")
    assert sorted((r["ord"], sorted(r["problems"])) for r in au.identities(odd).collect()) == [(1, ["duplicate id", "empty text"]), (2, ["duplicate id", "no pinned hash"]), (3, ["no id"])]


def test_vocabulary_coding(spark):
    import hashlib

    from quillforge.operators import corpus as cp

    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("é", 3), ('"', 4)], "char string, id long")
    texts = spark.createDataFrame([(1, "ab"), (2, "aé "), (3, "xay"), (4, "")], "k long, t string")
    good, bad = cp.encoded(texts, "k", "t", vocab)
    assert {r["k"]: r["ids"] for r in good.collect()} == {1: [1, 2], 2: [1, 3], 4: []}
    assert {r["k"]: r["missing"] for r in bad.collect()} == {3: ["x", "y"]}
    ids = spark.createDataFrame([(1, [1, 1, 0, 1, 2]), (2, [9]), (3, [0])], "k long, ids array<long>")
    assert {r["k"]: r["text"] for r in cp.decoded(ids, "k", vocab).collect()} == {1: "aab", 2: None, 3: ""}
    want = json.dumps({"schema_version": "1", "blank_id": 0, "characters": ["a", "b", "é", '"'], "size": 4}, ensure_ascii=False, sort_keys=True)
    assert cp.vocabulary_checksum(vocab).first()["checksum"] == hashlib.sha256(want.encode()).hexdigest()


def test_sql_functions_agree_with_columns(spark):
    from quillforge.functions import sql
    from quillforge.functions import text as tx

    sql.register(spark)
    rows = spark.createDataFrame([("a  b\r\n\r\n\r\n\r\nc ", "a x  c"), ("", ""), ("", "w")], "r string, h string")
    rows.createOrReplaceTempView("pairs_of_texts")
    got = spark.sql("SELECT text_normalize(r) AS n, wer(r, h) AS w FROM pairs_of_texts").collect()
    assert [g["n"] for g in got] == [r["n"] for r in rows.select(tx.normalize_text(F.col("r")).alias("n")).collect()]
    assert [round(g["w"], 6) for g in got] == [round(1 / 3, 6), 0.0, 1.0]
    beam = spark.sql("SELECT ctc_beam_decode(array(array(-1D, -0.5D), array(-0.1D, -3D))) AS d").first()["d"]
    assert list(beam["labels"]) == [1]


def test_urls(spark):
    bad = {"http://a.example": "not HTTPS", "ftp://a": "not HTTPS", "https://u@a.example": "user info", "https://a.example:444": "another port", "https://127.0.0.1/": "not a public address", "https://[::1]/": "not a public address", "https://8.8.8.8/": None, "https://a.example:443/x": None}
    frame = spark.createDataFrame([(u,) for u in bad], "u string").select("u", vl.url_problem(F.col("u")).alias("p"))
    assert {r["u"]: r["p"] for r in frame.collect()} == bad
