"""SentencePiece and token files against the libraries."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from eventfold.llm.queries import vocabulary
from eventfold.llm.sentencepiece_codec import Codec, encode_decode
from eventfold.llm.token_counts import count_tokens, write_flat
from eventfold.llm.token_ids import SegmentEncoder
from eventfold.llm.token_store import IndexPart, MinimalPerfectHash, _index_bytes, read_store, write_store

ODD = ["", None, " ", "  a  b ", "▁a▁ b", "\x00x\r\n", "é é ﬁ Å", "<s> </s> <unk>", "😀😀 ", "\n\n a\n b \n", " " * 300 + "x", "a" * 1000, "аб" * 200, "Thsh " * 300, "中文　字", "<|endoftext|>", "a <|endoftext|> b", "it's we'll  'll", "! Hi!", "\u2160\u00b2\u0663 12'3 x''s \u01c5\u200d"]


def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice("ab \n▁é.th,e中😀\t'12\x1c\x85") for _ in range(rng.randint(0, 80))) for _ in range(1500)]


def test_ids_and_text_are_the_librarys():
    codec, given = Codec(vocabulary("piece_bpe_32k.model"), entries=500), texts() + every_character()
    ids, counts = codec.encode(given)
    back, at, sp = codec.decode(ids, counts), 0, codec.vocabulary.library
    for t, n, d in zip(given, counts, back, strict=True):
        own = ids[at : at + n].tolist()
        at += n
        assert own == sp.encode(t or "", add_eos=True) and d == sp.decode(own)


def test_both_agendas_agree_with_the_library():
    v = Codec(vocabulary("piece_bpe_32k.model")).vocabulary
    words = [" thonerwh", "Übergrößen", "▁", "\n", "  x", "ﬁ😀", " " * 9, "a"]
    marked = [w.replace(" ", "▁") for w in words]
    assert v.merge_many(marked) == [v.merge_long(m) for m in marked] == v._by_library(words)


def test_ids_are_the_agendas(monkeypatch):
    v = Codec(vocabulary("piece_bpe_32k.model")).vocabulary
    segments = [" hello", "x" * 60]
    assert v.encode_segments(segments) == v._by_library(segments)
    for name, wrong in (("merge_many", lambda given: [[0]] * len(given)), ("merge_long", lambda given: [0])):
        with monkeypatch.context() as m, pytest.raises(ValueError):
            m.setattr(v, name, wrong)
            v.encode_segments(segments)


def test_encode_decode_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, ""), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as decoded", "2 as key")
    out = encode_decode(df, vocabulary("piece_bpe_32k.model")).collect()
    assert sorted((str(r["doc_id"]), r["decoded"], len(r["ids"])) for r in out) == [("1", "a b", 3), ("1", "a b", 3), ("2", "", 1), ("None", "", 1)]
    assert encode_decode(df.limit(0), vocabulary("piece_bpe_32k.model")).count() == 0


def every_character():
    rng = random.Random(2)
    kinds = [lambda: rng.randrange(0xD800), lambda: rng.randrange(0x300), lambda: rng.randrange(0xE000, 0x110000)]
    return ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randint(0, 50))) for _ in range(1500)]


@pytest.mark.parametrize("plain", [False, True])
def test_pieces_give_the_librarys_ids(plain):
    """Against the library's own object, not the encoder's."""
    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    if plain:
        library.encode_special_tokens = True
    given = texts() + every_character()
    for t, p in zip(given, SegmentEncoder(path, entries=300, plain=plain).payloads(given, 0), strict=True):
        assert np.frombuffer(p, "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids + [0]


def test_long_texts_are_cut_in_parts(monkeypatch):
    from eventfold.llm import pieces

    monkeypatch.setattr(pieces, "TOGETHER", 50)
    path, given = vocabulary("byte_bpe_50k.json"), ["one two\n\n three " * 60, "x" * 500, "", " a <|endoftext|> b" * 30, "\u3000 word " * 40]
    library = Tokenizer.from_file(path)
    for t, p in zip(given, SegmentEncoder(path).payloads(given, 7), strict=True):
        assert np.frombuffer(p, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids + [7]
    assert len(pieces.parts_of(given[0], 50)) > 10 and "".join(pieces.parts_of(given[0], 50)) == given[0]
    codec = Codec(vocabulary("piece_bpe_32k.model"))
    ids, counts = codec.encode(given)
    assert ids.tolist() == [i for t in given for i in codec.vocabulary.library.encode(t, add_eos=True)] and len(counts) == len(given)


def test_minimal_perfect_hash():
    h = np.random.default_rng(0).integers(0, 2**64, 5000, np.uint64)
    assert sorted(MinimalPerfectHash.build(h).slots(h).tolist()) == list(range(5000))
    part = IndexPart(_index_bytes(h, {k: np.arange(5000) for k in ("shard", "offset", "n")}))
    slots, there = part.find(h)
    assert there.all() and (part.n[slots] == np.arange(5000)).all()
    assert part.find(h + np.uint64(12345))[1].mean() < 0.001
    assert MinimalPerfectHash.build(h[:0]).slots(h[:3]).tolist() == [-1, -1, -1]


@pytest.mark.parametrize("n", [0, 1, 60])
def test_store_and_counts(spark, n):
    given = texts()[:n]
    rows = [(k if k % 7 else None if k else 0, t) for k, t in enumerate(given)] + ([(5, "again"), (5, "again")] if n > 5 else [])
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as key", "3 as part").repartition(3)
    path = vocabulary("byte_bpe_50k.json")
    out = read_store(df, write_store(df, path)).collect()
    e = SegmentEncoder(path)
    assert len(out) == len(rows)
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["start"])
    at = 0
    for r in sorted(out, key=key):  # consecutive, in ascending order, with the ids of its document
        ids = bytes(r["ids"])
        assert r["start"] == at and len(ids) == 4 * r["n_tokens"]
        assert any(p == ids for p in e.payloads([t for k, t in rows if k == r["doc_id"]], 0))
        at += r["n_tokens"]
    bare = read_store(df, write_store(df, path), payload=False).select("doc_id", "start", "n_tokens", "ids").collect()
    assert sorted(map(str, bare)) == sorted(str(Row(doc_id=r["doc_id"], start=r["start"], n_tokens=r["n_tokens"], ids=None)) for r in out)
    want = sorted(zlib.crc32(p) for p in e.payloads([t for _, t in rows], 0))
    assert sorted(zlib.crc32(bytes(r["ids"])) for r in out) == want
    folder, order = write_flat(df, path)
    for block in (7, 4_000_000):
        got = count_tokens(spark, folder, block_ids=block).join(order, ["file", "doc_no"]).collect()
        flat = SegmentEncoder(path, plain=True).payloads([t for _, t in rows], 0)
        assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(k), len(p) // 4) for (k, _), p in zip(rows, flat, strict=True))
        assert all(r["closed"] for r in got)


def test_counts_of_texts_with_every_kind_of_mark(spark, tmp_path):
    from eventfold.llm.queries import op6_token_counts

    given = ["Hi! yes", "!", "! ! !", "a!\n!b", "<|endoftext|>", "plain", "", None, "! <|endoftext|> !"]
    spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    path = vocabulary("byte_bpe_50k.json")
    e = SegmentEncoder(path, plain=True)
    got = op6_token_counts(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == [(k, len(e.library.encode(t or "", add_special_tokens=False).ids) + 1) for k, t in enumerate(given)]
    assert e.yields(0) and not e.yields(50256)
    with pytest.raises(ValueError):
        write_flat(spark.createDataFrame([(1, "a")], "doc_id long, text string"), path, end_id=0)
