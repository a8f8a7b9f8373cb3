import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest_llm import SCHEMA
from passagelake.llm import bpe, token_files
from passagelake.session import scratch_path
from tokenizers import Tokenizer

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def random_texts(count, seed):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzABC   \t\n\x0b\x1c\x85\xa0　''''sretvmld0123½²٣,.!?-éÉßİΣσςſḰ̈中文日本😀👍‍​﻿ ａＡªº"
    words = "the running internationalization hello don't we're WE'LL I'm a's <|endoftext|> <|startoftext|> <|endof CAFÉ".split()
    return [
        "".join(rng.choice(letters) if rng.random() < 0.6 else rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25)))
        for _ in range(count)
    ]


def library(path):
    return Tokenizer.from_file(path)


def text_of(path):
    with open(path, encoding="utf-8") as file:
        return file.read()


def test_backtracking_equals_the_library(small):
    codec, own = bpe.Codec(text_of(WORD)), library(WORD)
    for text in random_texts(4_000, 1) + [r.text for r in small.collect()]:
        ids = own.encode(text, add_special_tokens=False).ids
        got = codec.encode(text)
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == ids, text
        assert codec.decode(got).decode() == own.decode(ids, skip_special_tokens=False)


def test_full_tables_are_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_SIZE", 3)
    codec, own = bpe.Codec(text_of(WORD)), library(WORD)
    for text in random_texts(200, 2):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_cut_pieces_equal_the_library(monkeypatch):
    encoder, own = token_files.Encoder(text_of(BYTE)), library(BYTE)
    monkeypatch.setattr(token_files, "TABLE_SIZE", 2_000)
    texts = random_texts(4_000, 3) + ["", " ", "  a  b ", "a\n b", "a <|endoftext|> b", "<|endoftext|>", "x" * 200 + " " + "y" * 200]
    for first in range(0, len(texts), 40):
        for text, got in zip(texts[first : first + 40], encoder.encode(texts[first : first + 40]), strict=True):
            assert np.frombuffer(got, encoder.type).tolist() == own.encode(text, add_special_tokens=False).ids, text


def test_columns_equal_the_library(monkeypatch):
    encoder, own = token_files.Encoder(text_of(BYTE)), library(BYTE)
    monkeypatch.setattr(token_files, "TABLE_SIZE", 500)
    texts = ["", "plain words here", "two  spaces here", "", " begins", "ends ", "\n a\u3000 b", "中 文 a b", "x" * 99 + " " + "y" * 99, *random_texts(300, 4)]
    column = pa.array(texts)
    for first in range(0, len(texts), 3):  # slices of a column keep its buffers
        part = column.slice(first, 3)
        ids, ends = encoder.encode_column(part)
        want = [e.ids for e in own.encode_batch(part.to_pylist(), add_special_tokens=False)]
        assert ids.dtype == encoder.type and ids.tolist() == [i for x in want for i in x]
        assert ends.tolist() == np.cumsum([len(x) for x in want]).tolist()
    assert encoder.encode([]) == [] and encoder.encode([""]) == [b""]


def test_a_full_table_keeps_frequent_pieces(monkeypatch):
    encoder, own = token_files.Encoder(text_of(BYTE)), library(BYTE)
    monkeypatch.setattr(token_files, "TABLE_SIZE", 300)
    asked, pieces_of = [], encoder._pieces
    monkeypatch.setattr(encoder, "_pieces", lambda pieces: asked.extend(pieces) or pieces_of(pieces))
    frequent = [f"often{n}" for n in range(50)]
    for turn in range(20):
        text = " ".join(["first", *frequent * 5, *(f"rare{turn}x{n}" for n in range(100))])
        assert np.frombuffer(encoder.encode([text])[0], encoder.type).tolist() == own.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) <= 300
    assert sum(p in set(frequent) for p in asked) == len(frequent)


def test_round_trip_and_real_outputs(spark, small, odd, empty):
    own = library(WORD)
    for frame in (small, odd, empty):
        want = sorted(
            (r.doc_id is not None, r.doc_id or 0, len(ids := own.encode(r.text or "", add_special_tokens=False).ids),
             hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest())
            for r in frame.collect()
        )
        got = bpe.round_trip(frame, WORD).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    row = bpe.decode(bpe.encode(spark.createDataFrame([(1, "Hello there", "", "", 0)], SCHEMA), WORD), WORD).first()
    assert row.text == "hello</w> there</w>"


def want_of(frame, end_id):
    own, at, out = library(BYTE), 0, []
    for r in sorted(frame.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = own.encode(r.text or "", add_special_tokens=False).ids + [end_id]
        out.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_hold_every_document_in_order(small):
    got = token_files.write_and_read(small, BYTE, 0).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want_of(small, 0)


def test_files_of_odd_rows(odd, empty):
    got = token_files.write_and_read(odd, BYTE, 0).collect()
    assert len(got) == odd.count()
    begun = sorted((r.start, r.n_tokens) for r in got)
    assert begun[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(begun, begun[1:]))  # no gap, no overlap
    assert {r.doc_id for r in sorted(got, key=lambda r: r.start)[:2]} == {None}
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((d or -1, n, c) for d, _, n, c in want_of(odd, 0))
    assert token_files.write_and_read(empty, BYTE, 0).count() == 0


def test_parts_can_be_opened_alone(spark, small):
    folder = scratch_path(spark, "parts")
    token_files.write(small, BYTE, folder)
    rows = sorted(spark.read.parquet(f"{folder}/manifest").collect(), key=lambda r: r.part)
    part = token_files.Part.open(folder, rows[0].part, rows[0].width)
    texts = {r.doc_id: r.text for r in small.collect()}
    first = part.ids[part.offsets[0] : part.offsets[1]].tolist()
    assert part.ids.dtype == np.uint16 and first == library(BYTE).encode(texts[part.docs[0]], add_special_tokens=False).ids


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_files.Encoder(text_of(WORD))
