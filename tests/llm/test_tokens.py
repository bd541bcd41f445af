"""Operators 4, 5 and 10: ids against the libraries, round trips, file format."""

import hashlib
import io
import json
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gravelsift.llm import packing, pieces, token_files, tokens

PIECE, BYTE, WORD = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))


def texts(n=3000):
    random.seed(4)
    signs = ["the ", "ing", " ", "  ", "\n", "\t", "é", "日", "😀", "▁", "​", "<s>", "<|endoftext|>", "'s", "12", "#!", "\x1f", " ", "é", "ß", "İ", "A", "\x00"]
    return ["".join(random.choice(signs) for _ in range(random.randint(0, 12))) for _ in range(n)]


def test_pieces_equal_the_library():
    sp, model, rows = sentencepiece.SentencePieceProcessor(model_file=PIECE), pieces.piece_model(PIECE), texts()
    got = [[*(i for g in runs for i in g[2]), model.end] for runs in model.encode(rows)]
    assert got == sp.encode(rows, add_eos=True)
    assert [model.decode(i) for i in got] == sp.decode(got)
    for run in ("▁" + "abc" * 40, "▁▁▁hello", "x"):  # the heap and the rows of ranks agree
        assert model.merge(run) == model.merge_many([run])[0]


def test_pieces_round_trip(spark, odd_docs, no_docs):
    got = pieces.round_trip(odd_docs, PIECE).collect()
    assert len(got) == odd_docs.count() and pieces.round_trip(no_docs, PIECE).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.decoded_sha256) for r in got if r.doc_id in (3, 4)} == {(1, empty)}
    back = {r.doc_id: r.text for r in pieces.decode_documents(pieces.encode_documents(odd_docs, PIECE), PIECE).collect()}
    assert back == {r.doc_id: r.text or "" for r in odd_docs.select("doc_id", "text").collect()}


def test_pieces_of_whole_documents_equal_the_library(spark):
    """Every document of sf0.01 beside the library: ids and decoded texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = sp.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
    assert {r.doc_id: tuple(r)[1:] for r in pieces.round_trip(docs, PIECE).collect()} == want
    back = pieces.decode_documents(pieces.encode_documents(docs, PIECE), PIECE)
    assert {r.doc_id: sha(r.text) for r in back.collect()} == {i: x[2] for i, x in want.items()}


@pytest.mark.parametrize("run", ["b", "longer" * 20])
def test_wrong_ids_of_any_run_are_found(run):
    """Short runs, merged side by side, and long ones on the heap are compared with the library when they are first met."""
    model = pieces.PieceModel(PIECE)
    many, one = model.merge_many, model.merge
    model.merge_many = lambda runs: [[5] if r == "▁" + run else ids for r, ids in zip(runs, many(runs), strict=True)]
    model.merge = lambda r: [5] if r == "▁" + run else one(r)
    assert list(model.encode(["a c", "▁▁ d"]))
    with pytest.raises(ValueError, match="not the library's"):
        list(model.encode(["a c", f"a {run} c"]))


def test_byte_and_word_ids_equal_the_library():
    rows = texts()
    byte, own = Tokenizer.from_file(BYTE), tokens.byte_tokenizer(BYTE)
    assert all(own.encode(t).tolist() == e.ids for t, e in zip(rows, byte.encode_batch(rows, add_special_tokens=False), strict=True))
    word, own = Tokenizer.from_file(WORD), tokens.word_tokenizer(WORD)
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(rows)] == [e.ids for e in word.encode_batch(rows, add_special_tokens=False)]


@pytest.mark.parametrize("space", [" ", "\n", "\u00a0", " \n"])
def test_long_runs_of_white_space(space):
    run = space * (2_000_000 // len(space))
    for text in (f"a{run}b", run):
        assert tokens.byte_tokenizer(BYTE).encode(text).tolist() == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids


def test_capital_sigma():
    rows = ["ΟΔΟΣ", "ΟΔΟΣ ΣΑΣ Σ, Σ.", "aΣ İΣ", "ὈΔΥΣΣΕΎΣ", "οδός ΟΔΟΣ's", "ΣΣ1Σ"]
    got = tokens.word_tokenizer(WORD).encode(rows)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [Tokenizer.from_file(WORD).encode(t, add_special_tokens=False).ids for t in rows]


def test_every_character():
    """Each character of Unicode, alone and between others; Greek words in capitals; combining marks."""
    own, library = tokens.word_tokenizer(WORD), Tokenizer.from_file(WORD)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = [" ".join(f"{chr(c)} A{chr(c)}b 7{chr(c)}" for c in points[k : k + 64]) for k in range(0, 0x3400, 64)]
    rows += [f"x{chr(c)}Y" for c in points[0x3400:0xAC00:41] + points[0xF900:0x20000:7]] + ["ΟΔΟΣ ΑΘΗΝΑΣ", "e\u0301 Z\u0301", "\u0558\u208f \ua7cb\U00010940"]
    got = own.encode(rows)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]


def test_other_vocabularies_are_refused(tmp_path):
    for kind, path in ((tokens.ByteTokenizer, WORD), (tokens.WordTokenizer, BYTE)):
        with pytest.raises(ValueError):
            kind(path)
    data = json.load(open(BYTE))
    data["model"]["merges"][:2] = data["model"]["merges"][1::-1]
    (tmp_path / "v.json").write_text(json.dumps(data))
    with pytest.raises(ValueError):
        tokens.ByteTokenizer(str(tmp_path / "v.json"))


def test_a_word_of_a_million_characters():
    for word in ("ab" * 500_000, "é" * 1_000_000):
        assert tokens.byte_tokenizer(BYTE).encode(word).tolist() == Tokenizer.from_file(BYTE).encode(word, add_special_tokens=False).ids
        got = np.frombuffer(tokens.word_tokenizer(WORD).encode([word])[0], "<u4").tolist()
        assert got == Tokenizer.from_file(WORD).encode(word, add_special_tokens=False).ids


def test_cut():
    assert packing.cut(5000, 2048) == [2048, 2048, 512, 256, 128, 8] and packing.cut(1, 2048) == [1] and packing.cut(0, 2048) == []
    with pytest.raises(ValueError):
        packing.split_documents(None, BYTE, 1, longest=1000)


def test_packing(odd_docs, no_docs):
    made = packing.number_sequences(packing.split_documents(odd_docs, BYTE, 1)).collect()
    assert sorted(r.sequence_id for r in made) == list(range(len(made)))
    assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 and len(r.ids) == 4 * r.length and r.offset == 0 for r in made)
    byte = Tokenizer.from_file(BYTE)
    for d in odd_docs.select("doc_id", "text").distinct().collect():
        own = sorted({(r.start, bytes(r.ids)) for r in made if r.doc_id == d.doc_id})
        assert np.frombuffer(b"".join(i for _, i in own), "<u4").tolist() == [*byte.encode(d.text or "", add_special_tokens=False).ids, 1]
    by_length = [r.length for r in sorted(made, key=lambda r: r.sequence_id)]
    assert by_length == sorted(by_length, reverse=True)
    assert packing.number_sequences(packing.split_documents(no_docs, BYTE, 1)).count() == 0


def test_files(spark, odd_docs, no_docs):
    manifest = token_files.write_token_files(odd_docs, WORD, 2, files=3)
    got = token_files.read_token_files(spark, manifest).orderBy("start").collect()
    word = Tokenizer.from_file(WORD)
    want = sorted(((r.doc_id, r.text or "") for r in odd_docs.select("doc_id", "text").collect()))
    ids = [[*word.encode(t, add_special_tokens=False).ids, 2] for _, t in want]
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == ids
    assert [r.start for r in got] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    small = token_files.write_token_files(odd_docs, WORD, 2, files=2, file_bytes=1000)
    assert small.count() > 3 and [(r.doc_id, r.start, r.ids) for r in token_files.read_token_files(spark, small).orderBy("start").collect()] == [(r.doc_id, r.start, r.ids) for r in got]
    asked = spark.createDataFrame([(1,), (7,), (7,), (99,)], "doc_id long")
    some = token_files.read_token_files(spark, small, asked).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.ids) for r in some] == [(r.doc_id, r.start, r.ids) for r in got if r.doc_id in (1, 7)]
    unnamed = token_files.write_token_files(odd_docs.selectExpr("cast(null as long) doc_id", "text"), WORD, 2)
    assert {r.doc_id for r in token_files.read_token_files(spark, unnamed).collect()} == {None} and unnamed.first().n_docs > 0
    empty = token_files.write_token_files(no_docs, WORD, 2)
    assert empty.count() == 0 and token_files.read_token_files(spark, empty).count() == 0


def test_frames_are_checked_and_read_alone():
    sink = io.BytesIO()
    writer = token_files.FrameWriter(sink)
    data = {i: np.arange(i * 20_000, dtype="<u4").tobytes() for i in range(8)}
    for i, d in data.items():
        writer.add(i, d)
    writer.close()
    reader = token_files.FrameReader(io.BytesIO(sink.getvalue()))
    assert {i: d for i, _, d in reader.documents()} == data
    opened = []
    whole, reader.frame = reader.frame, lambda k: opened.append(k) or whole(k)
    assert [(i, zlib.crc32(d)) for i, _, d in reader.documents({5})] == [(5, zlib.crc32(data[5]))]
    assert opened == [reader.index["frame"][5]]  # the frame that holds it, and no other
    reader.frame = whole
    broken = bytearray(sink.getvalue())
    broken[reader.places[2] + 40] ^= 1
    bad = token_files.FrameReader(io.BytesIO(bytes(broken)))
    with pytest.raises(Exception):  # noqa: B017  zstandard's or our own
        bad.frame(2)
    assert bad.frame(1) == reader.frame(1)


def test_files_end_after_so_many_documents(spark):
    docs = spark.range(25).selectExpr("id doc_id", "if(id % 3 = 0, '', 'a') text")
    manifest = token_files.write_token_files(docs, WORD, end_id=2, files=1, file_docs=10)
    assert [(r.n_docs, r.first_doc, r.last_doc) for r in manifest.orderBy("part").collect()] == [(10, 0, 9), (10, 10, 19), (5, 20, 24)]
    assert [r.doc_id for r in token_files.read_token_files(spark, manifest).orderBy("start").collect()] == list(range(25))
