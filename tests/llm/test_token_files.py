"""Round trips of the file format and of documents; ids against the library."""

import random
import zlib

import numpy as np
import pytest
from findwell.llm import token_files, tokens
from findwell.llm.token_files import Image, read_block, read_token_files, write_image, write_token_files


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 20000])
def test_image_round_trip(n):
    r = np.random.default_rng(n)
    ids = r.integers(0, 49408, n).astype(np.uint32)
    ids[: n // 2] %= 7
    ids[:1] = 2**32 - 1
    counts = np.array([n // 3, 0, n - n // 3])
    f = Image(write_image(np.array([-5, 0, 2**40]), counts, ids))
    assert (f.ids() == ids).all() and f.doc_ids.tolist() == [-5, 0, 2**40] and f.counts.tolist() == counts.tolist()
    if n:
        k = (n - 1) // token_files.BLOCK
        assert (f.block(k)[: n - k * token_files.BLOCK] == ids[k * token_files.BLOCK :]).all()
    with pytest.raises(ValueError):
        Image(b"else")


def test_ids_are_the_library_s():
    enc = tokens.Encoder(tokens.vocabulary())
    r = random.Random(1)
    odd = [chr(i) for i in range(1, 0x180)] + ["'s", "'ll", "ΑΣ", "<|endoftext|>", " ", " ", "́", "ﬁ", " ", "😀", "word "]
    texts = [None, "", "a\x1cb  c", "it's  I'LL　ok\x85z", "x" * 500, "<|startoftext|> y"] + ["".join(r.choice(odd) for _ in range(r.randrange(60))) for _ in range(1500)]
    for t, x in zip(texts, enc.encode_batch(texts), strict=True):
        assert np.frombuffer(x, "<u4").tolist() == enc.tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_cache_of_pieces_is_bounded():
    r, long_ = random.Random(2), "q" * (tokens._LONGEST + 1)
    texts = [" ".join([*("".join(r.choices("abcdeé", k=r.randrange(1, 9))) for _ in range(200)), long_, "ΑΣ", "a~b"][: r.randrange(1, 204)]) for _ in range(40)]
    for most in (0, 50, 400_000):
        enc = tokens.Encoder(tokens.vocabulary(), most)
        sizes = []
        for at in range(0, len(texts), 4):
            got = enc.encode_batch(texts[at : at + 4])
            assert got == [enc.whole(t) for t in texts[at : at + 4]]
            sizes.append(len(enc.known))
        assert long_ not in enc.known and (sizes[-1] == 0 if most == 0 else sizes[-1] == sizes[0] > 50 if most == 50 else sizes[-1] > sizes[0])


def test_documents_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_files, "IMAGE_IDS", 50)
    rows = [(i * 7 % 101, f"text {i} " * (i % 9), "s", 0) for i in range(101)] + [(None, "none", "s", 0)] * 3 + [(None, f"none {i}", "s", 0) for i in range(40)] + [(3, None, "s", 0), (3, "again", "s", 0), (200, "very long " * 30_000, "s", 0)]
    got = read_token_files(write_token_files(spark.createDataFrame(rows, "doc_id long, text string, part string, seq int"))).collect()
    enc, at = tokens.Encoder(tokens.vocabulary()), 0
    crc = lambda t: (len(x := enc.encode(t) + np.array([1], "<u4").tobytes()) // 4, zlib.crc32(x))
    assert sorted((str(d), *crc(t)) for d, t, *_ in rows) == sorted((str(g["doc_id"]), g["n_tokens"], g["ids_crc32"]) for g in got)
    order = sorted(got, key=lambda g: g["start"])
    for g in order:
        assert g["start"] == at
        at += g["n_tokens"]
    ids = [g["doc_id"] for g in order]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert read_token_files(write_token_files(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_files_that_stay_and_one_block(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} " * 300) for i in range(60)], "doc_id long, text string")
    write_token_files(docs, path=f"{tmp_path}/files")
    images = spark.read.parquet(f"{tmp_path}/files")
    one = images.orderBy("part", "seq").first()
    whole = Image(one["image"]).ids()
    assert (read_block(images, one["part"], one["seq"], 1) == whole[token_files.BLOCK : 2 * token_files.BLOCK]).all()
    assert images.agg({"n_ids": "sum"}).first()[0] == sum(len(tokens.Encoder(tokens.vocabulary()).encode(f"word{i} " * 300)) // 4 + 1 for i in range(60))
