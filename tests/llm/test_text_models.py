"""Toxicity, piece counts, BPE, token files: against the libraries and on held-out rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, normalizers
from tokenizers.models import Unigram

from barloom.llm import bpe, tokenfiles, toxicity, unigram

SIGNS = "aabcde'stl 1²é\n\t.!?日ßΣ́\x1c\x00\x85\xa0  🙂"


def odd_texts(n, seed=2):
    rng = random.Random(seed)
    fixed = ["", " ", "Hello WORLD's it'll 123 4½", "<|endoftext|> a<|startoftext|>B", "ΣΑΣ ΟΔΟΣ", "İı ẞß", "日本語 😀😀", "a" * 3000]
    return fixed + ["".join(rng.choice(SIGNS) for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(docs):
    return [r.text for r in docs.select("text").collect()] + odd_texts(1500)


def test_backtracking_equals_the_library(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.Backtracking(path)
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_columns(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = bpe.decode_ids(bpe.encode_ids(odd, path), path).collect()
    assert all(list(r.ids) == lib.encode(r.text or "", add_special_tokens=False).ids for r in got)
    assert all(r.decoded == lib.decode(list(r.ids), skip_special_tokens=False) for r in got)
    d = bpe.digests(odd, path)
    assert d.columns == [*odd.columns, "n_tokens", "ids_sha256", "decoded_sha256"] and d.filter("n_tokens = 0").count() == 4
    assert bpe.digests(empty, path).count() == 0


def test_piece_counts_equal_the_library(texts):
    pieces = unigram.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    least = min(s for _, s in pieces)
    lib = Tokenizer(Unigram([("<unk>", least), *pieces, *((f"<0x{b:02X}>", least) for b in range(256))], 0, True))
    lib.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    own = unigram.PieceCounter(pieces)
    assert own.by_word
    assert [own.count(t)[0] for t in texts] == [len(lib.encode(t).ids) for t in texts]


def test_piece_counts_with_fractions_ties_and_joined_unknowns():
    vocab = [("a", -1.5), ("b", -2.25), ("ab", -3.75), ("aa", -3.0), ("bab", -5.5), ("▁", -1.0), ("a▁b", -4.25), ("▁a", -2.5)]
    own = unigram.PieceCounter(vocab, byte_fallback=False)
    lib = Tokenizer(Unigram([("<unk>", -5.5), *vocab], 0, False))
    lib.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    rng = random.Random(4)
    for _ in range(1500):
        t = "".join(rng.choice("aabb cd") for _ in range(rng.randint(1, 40)))
        assert not own.by_word and own.count(t)[0] == len(lib.encode(t).ids)


def test_piece_count_columns(odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = unigram.piece_counts(odd, path)
    assert got.columns == [*odd.columns, "n_pieces", "score"] and got.filter("n_pieces = 0").count() == 3
    assert unigram.piece_counts(empty, path).count() == 0


def test_word_encoder_equals_the_library(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = tokenfiles.WordEncoder(path, memo=500).encode(texts)
    assert all(list(a) == lib.encode(t, add_special_tokens=False).ids for a, t in zip(got, texts))


def test_new_pieces_go_to_the_merges_once():
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    asked = []

    class Counted:
        def tokenize(self, piece):
            asked.append(piece)
            return lib.model.tokenize(piece)

    known = tokenfiles.Pieces(Counted(), 1000)
    odd = [" the", "ä", "\x00\x7f", " \U0001f600", "語彙", "\u2003", "\n\n", "'ll", " " + "zzqx" * 50, "123", "\ufeff"]
    for _ in range(2):
        for piece in odd:
            assert list(np.frombuffer(known[piece], np.uint32)) == lib.encode(piece, add_special_tokens=False).ids
    assert len(asked) == len(odd)
    small = tokenfiles.Pieces(lib.model, 3)
    assert all(small[p] == known[p] and len(small) <= 3 for p in odd)


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 9, 20_000), np.tile(rng.integers(0, 50_000, 40), 500), np.zeros(999, int), rng.integers(0, 50_257, 5), np.empty(0, int)):
        rules, spans, seq = tokenfiles.compress(ids.astype(np.uint32), 50_257)
        assert (tokenfiles.expand(seq, rules, 50_257) == ids).all()
        assert len(ids) < 900 or len(seq) < len(ids)
        assert all(len(tokenfiles.expand(np.array([50_257 + i]), rules, 50_257)) == n for i, n in enumerate(spans))
    arrays = [rng.integers(0, 30, n).astype(np.uint32) for n in (0, 1, 500, 0, 7, 3000, 2)]
    row = dict(zip([c.split()[0] for c in tokenfiles.SHARD.split(", ")], tokenfiles.shard_row(0, 0, list(range(7)), arrays, 50_257)))
    s = tokenfiles.Shard(type("Row", (), row))
    assert all((s.ids(i) == a).all() for i, a in enumerate(arrays))


def test_token_files(spark, docs, odd, empty, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)

    def expected(rows):
        at = 0
        for d, t in rows:
            ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
            yield d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
            at += len(ids)

    tokenfiles.write_ids(docs.repartition(5), path, str(tmp_path / "a"), shard_ids=3000)
    got = sorted(tuple(r) for r in tokenfiles.read_ids(spark, str(tmp_path / "a")).collect())
    assert got == list(expected((r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()))
    tokenfiles.write_ids(odd, path, str(tmp_path / "b"))
    got = sorted((tuple(r) for r in tokenfiles.read_ids(spark, str(tmp_path / "b")).collect()), key=lambda r: r[1])
    assert len(got) == odd.count() and [r[0] for r in got] == sorted((r.doc_id for r in odd.collect()), key=lambda d: (d is not None, d or 0))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    tokenfiles.write_ids(empty, path, str(tmp_path / "c"))
    assert tokenfiles.read_ids(spark, str(tmp_path / "c")).count() == 0


def test_nnpu_finds_positives_among_unlabelled():
    rng = np.random.default_rng(0)
    noise = lambda: rng.choice(np.arange(5, 300), 30, replace=False)
    toxic = lambda: np.append(noise(), rng.choice(5, 2, replace=False))
    p = [toxic() for _ in range(200)]
    u = [toxic() if rng.random() < .1 else noise() for _ in range(2000)]
    w, b = toxicity.nnpu_fit(p, u, 300, 0.1)
    assert np.mean([w[toxic()].sum() + b > 0 for _ in range(300)]) > .9
    assert np.mean([w[noise()].sum() + b > 0 for _ in range(300)]) < .02


def test_held_out_accuracy(spark):
    from barloom.llm import q_llm
    sf = "/root/testdata/sf0.1"
    got = q_llm.QUERIES["op1_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    hits = [r.predicted for r in got if r.toxic == 1]
    false = [r.predicted for r in got if r.toxic == 0]
    assert np.mean(hits) > .8 and np.mean(false) < .04
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels, min_df=1)
    got = toxicity.score(odd.drop("score"), model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.train(odd, labels.filter("toxic = 0")) is None
    assert {r.score for r in toxicity.score(odd.drop("score"), None).collect()} == {0.0}
    assert toxicity.score(empty.drop("score"), model).count() == 0 and toxicity.train(empty, labels) is None
