from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from quillforge.llm import quality as q
from quillforge.llm.mixing import targets
from quillforge.llm.registry import ORACLES, QUERIES
from quillforge.llm.tokenize import vocabulary


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "span_dedup", "mixture", "packing"]


def test_stages(spark, tmp_path):
    from tests.llm.conftest import rows
    from tests.llm.test_neardup import brute
    from tests.llm.test_quality import corpus, plain_score
    from tests.llm.test_spans import brute as brute_spans

    texts, marks = corpus(160)
    long = " ".join(f"passage{i}" for i in range(60))
    texts = texts + [t + " again" for t in texts[1:9]] + [long + " " + " ".join(f"tail{i}" for i in range(60)), " ".join(f"head{i}" for i in range(60)) + " " + long] + [None, ""]
    marks = marks + [1] * (len(texts) - len(marks))
    data = [(r[1], r[2], "en", r[0], len(r[2] or "")) for r in rows(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i + 1, m, 0) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept.append(docs.count())
        if name == "near_dedup":
            groups = brute([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
            assert {r["doc_id"] for r in docs.collect()} == {i for i, (_, c) in groups.items() if i == c}
        rows_in, rows_out = before.collect(), docs.collect()
        if name == "quality":
            model = q.fit(before, spark.read.parquet(str(tmp_path / "labels.parquet")))
            assert {r["doc_id"] for r in rows_out} == {r["doc_id"] for r in rows_in if plain_score(model, r["text"] or "") >= corpus_pipeline.REJECT_BELOW}
        if name == "span_dedup":
            assert all(long not in (r["text"] or "") for r in rows_out)
            want = {}
            for r, (n, gone, _, left) in zip(rows_in, brute_spans([r["text"] for r in rows_in], 200), strict=True):
                if not gone or gone < n:
                    want[r["doc_id"]] = left.decode(errors="replace") if gone else r["text"]
            assert {r["doc_id"]: r["text"] for r in rows_out} == want
            assert all(r["n_chars"] == len(r["text"] or "") for r in rows_out)
        if name == "mixture":
            size = {r["doc_id"]: len((r["text"] or "").split()) for r in rows_in}
            source = {r["doc_id"]: r["source"] for r in rows_in}
            times = Counter(r["doc_id"] for r in rows_out)
            assert max(times.values()) <= 3 and {r["doc_id"]: r["text"] for r in rows_out}.items() <= {r["doc_id"]: r["text"] for r in rows_in}.items()
            sums = Counter()
            for d, n in size.items():
                sums[source[d]] += n
            for name_, whole, goal in targets(list(sums.items())):
                took = sum(size[d] * n for d, n in times.items() if source[d] == name_)
                smallest = min((n for d, n in size.items() if source[d] == name_ and n), default=0)
                assert whole == sums[name_] and abs(took - goal) <= max(1, smallest)
        if name == "packing":
            tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
            ids = {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows_in}
            total = Counter()
            for r in rows_out:
                total[r["doc_id"]] += r["length"]
            times = Counter(r["doc_id"] for r in rows_in)
            assert total == Counter({d: ids[d] * n for d, n in times.items()})
            bins = {}
            for r in rows_out:
                bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            for parts in bins.values():
                at = 0
                for offset, length in sorted(parts):
                    assert offset == at
                    at += length
                assert at <= 1024
            assert len(bins) <= 1.02 * sum(total.values()) / 1024 + 1
    bad = sum(1 for m in marks if not m)
    assert len(texts) - bad <= kept[0] <= len(texts) - 0.9 * bad
    source = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    source.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[-1]


def test_awkward_rows(spark, awkward, empty, tmp_path):
    spark.createDataFrame([(6, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (awkward, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            out.collect()
            assert name == "packing" or out.columns == docs.columns


def test_clashing_names_keep_their_values(spark, tmp_path):
    names = ["base", "more", "ranges", "before", "kept", "spans", "n_bytes", "n_removed", "score", "mix_size", "__x", "a.b", "Doc", "rest", "place", "repeats"]
    data = [(i, f"short text number {i} " + ("again and again " * 20 if i % 2 else ""), "s", *(f"{i}-{n}" for n in names)) for i in range(12)]
    docs = spark.createDataFrame(data, ["doc_id", "text", "source", *names])
    spark.createDataFrame([(6, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        for r in out.collect():
            assert [r[n] for n in names] == [f"{r['doc_id']}-{n}" for n in names], name
