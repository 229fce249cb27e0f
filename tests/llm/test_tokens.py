import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillforge.llm import packing as pk
from quillforge.llm import tokenfile as tf
from quillforge.llm.tokenize import Encoder, vocabulary

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.mark.parametrize("name", NAMES)
def test_same_ids_as_the_tokenizer(name):
    rng = random.Random(5)
    texts = ["", "  ", "\n\n", " \n x", "it's don't", "ΣΑΣ İstanbul", "日本語 text", "<|endoftext|> hi", "1234 ab12", "x\x00y", "áb", "ǅ ŉ", "\x1c\x1d", "한"]
    texts += ["".join(rng.choice(" ab1.,'\n\tÉéß²½ªº-Ω") for _ in range(rng.randrange(0, 30))) for _ in range(1500)]
    got, want = Encoder(vocabulary(name)).encode(texts), Tokenizer.from_file(vocabulary(name)).encode_batch_fast(texts, add_special_tokens=False)
    assert all(got.ids[got.offsets[i] : got.offsets[i + 1]].tolist() == e.ids for i, e in enumerate(want))
    assert len(Encoder(vocabulary(name)).encode([]).ids) == 0


def test_any_token_without_decoding_the_rest():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 511, 512, 513, 5000):
        ids = np.where(rng.random(n) < 0.3, rng.integers(0, 256, n), np.where(rng.random(n) < 0.9, rng.integers(0, 65536, n), rng.integers(0, 1 << 32, n))).astype(np.uint32)
        f = tf.TokenFile.parse(tf.pack(np.array([4]), np.array([n]), ids))
        assert np.array_equal(f.all(), ids)
        assert [f.get(i) for i in range(0, n, 3)] == ids[::3].tolist()
    with pytest.raises(ValueError):
        tf.TokenFile.parse(b"other" * 20)


def expected(frame, name):
    t = Tokenizer.from_file(vocabulary(name))
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in frame.collect()))
    return [(i if there else None, np.array(t.encode(x, add_special_tokens=False).ids + [2], "<u4")) for there, i, x in rows]


def test_token_files(awkward, empty, spark, tmp_path):
    tf.write_tokens(awkward, str(tmp_path / "t"), "word_bpe_49k.json", file_bytes=20_000)
    got = sorted(tf.read_documents(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    want = expected(awkward, "word_bpe_49k.json")
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i or 0, len(x), zlib.crc32(x.tobytes())) for i, x in want)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert tf.tokens_query(spark, empty).count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_evolution_packs_as_well_as_exhaustive_search():
    rng = np.random.default_rng(7)
    for _ in range(20):
        lengths = np.sort(rng.integers(1, 30, 8))[::-1].astype(np.int64)
        best = len(lengths)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(lengths):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + lengths[i] <= 40:
                    bins[k] += lengths[i]
                    place(i + 1, bins)
                    bins[k] -= lengths[i]
            bins.append(lengths[i])
            place(i + 1, bins)
            bins.pop()

        place(0, [])
        got = pk.evolve(lengths, [], 1, capacity=40, children=40)
        assert pk.fills(lengths, got).max() <= 40
        assert pk.fitness(lengths, got, 40)[0] <= best + (0 if best <= 2 else 1)


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 1024, 500)
    one, two = pk.fresh(lengths, rng, 0.3, 1024), pk.fresh(lengths, rng, 0.3, 1024)
    child = pk.crossover(lengths, one, two, rng, 1024)
    assert (child >= 0).all() and pk.fills(lengths, child).max() <= 1024 and pk.fills(lengths, child).sum() == lengths.sum()


def test_pieces_and_sequences(awkward, empty):
    got = pk.packing_query(awkward).collect()
    check_packing(got, 1024)
    want = []
    for i, x in expected(awkward, "byte_bpe_50k.json"):
        head = len(x) - (-(-len(x) // 1024) - 1) * 1024
        cuts = [0, *range(head, len(x), 1024), len(x)]
        want += [(i or 0, k, a, b - a, zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert pk.packing_query(empty).count() == 0
    whole = pk.sequences(pk.pack(pk.pieces(awkward, "byte_bpe_50k.json", with_ids=True))).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(r["length"] for r in got) and all(len(r["ids"]) <= 1024 for r in whole)


def test_many_groups_and_repeated_pieces(spark):
    rng = random.Random(9)
    data = [(i % 50, rng.randrange(1, 1025), "x", 7) for i in range(3000)] + [(1, 700, "x", 7)] * 500
    frame = spark.createDataFrame(data, "doc_id long, length long, group string, uid long")
    got = pk.pack(frame, group_rows=500).collect()
    assert len(got) == len(data) and {"group", "uid"} <= set(got[0].asDict())
    used = check_packing(got, 1024)
    assert used <= 1.1 * max(-(-sum(r["length"] for r in got) // 1024), sum(1 for r in got if r["length"] > 512))


def test_evolution_wins_bins_over_its_seed():
    rng = np.random.default_rng(3)
    thirds = []
    for _ in range(300):
        a = int(rng.integers(390, 510))
        b = int(rng.integers(256, 1024 - a - 255))
        thirds += [a, b, 1024 - a - b]
    for lengths in (np.array(thirds), rng.integers(200, 700, 1500), rng.integers(100, 400, 1500)):
        lengths = np.sort(lengths)[::-1].astype(np.int64)
        seed = pk.fitness(lengths, pk.fresh(lengths, rng, 0.0, 1024), 1024)[0]
        got = pk.fitness(lengths, pk.evolve(lengths, [], 11), 1024)[0]
        assert pk.least_bins(lengths, 1024) <= got < seed


def test_least_bins_is_a_bound():
    rng = np.random.default_rng(4)
    for _ in range(40):
        lengths = np.sort(rng.integers(1, 41, rng.integers(1, 9)))[::-1].astype(np.int64)

        def fewest(left, free):
            if not left:
                return len(free)
            n, best = left[0], fewest(left[1:], [*free, 40 - left[0]])
            for i, f in enumerate(free):
                if f >= n:
                    best = min(best, fewest(left[1:], [*free[:i], f - n, *free[i + 1 :]]))
            return best

        assert pk.least_bins(lengths, 40) <= fewest(lengths.tolist(), [])


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_polynomials_modulo_a_power_of_two_confuse(name, n, make, spark, tmp_path):
    x, y = thue_morse(n), thue_morse(n, "b", "a")
    texts = [f"{x} {y}", y, f"{y} {x}", x]
    got, want = Encoder(vocabulary(name)).encode(texts), Tokenizer.from_file(vocabulary(name)).encode_batch_fast(texts, add_special_tokens=False)
    assert all(got.ids[got.offsets[i] : got.offsets[i + 1]].tolist() == e.ids for i, e in enumerate(want))
    from tests.llm.conftest import rows

    frame = make(rows(texts))
    if name == NAMES[1]:
        tf.write_tokens(frame, str(tmp_path / "t"), name)
        got = sorted(tf.read_documents(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    else:
        got = [r for r in sorted(pk.pieces(frame, name, capacity=1 << 20).collect(), key=lambda r: r["doc_id"])]
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(i.tobytes()) for _, i in expected(frame, name)]


def test_a_hit_of_the_memory_counts_only_if_the_characters_are_equal():
    name = NAMES[0]
    e, t = Encoder(vocabulary(name)), Tokenizer.from_file(vocabulary(name))
    e.encode(["alpha beta gamma delta"])
    e.chars = e.chars.copy()
    e.chars[:] = np.roll(e.chars, 1)  # as if other pre-tokens had had these hashes
    got = e.encode(["alpha beta gamma delta alpha"])
    assert got.ids.tolist() == t.encode("alpha beta gamma delta alpha", add_special_tokens=False).ids


def test_well_filled_bins_gather_where_no_bin_can_be_full():
    rng = np.random.default_rng(7)
    lengths = np.sort(3 * rng.integers(67, 234, 3300))[::-1].astype(np.int64)
    assert pk.best_fill(lengths, 1024) == 1023
    assert pk.best_fill(np.array([5, 5, 7]), 11) == 10 and pk.best_fill(np.array([], np.int64), 11) == 0
    plain = pk.fresh(lengths, np.random.default_rng(0), 0, 1024)
    elites = [pk.evolve(lengths, [], seed) for seed in (1, 2)]
    best = pk.evolve(lengths, elites, 3)
    assert best.max() + 1 <= plain.max() + 1 - 8
    assert pk.fills(lengths, best).max() <= 1024
