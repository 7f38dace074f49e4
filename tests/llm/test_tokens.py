"""Packing (1) and bit-plane output (6) against brute force and exact round trips."""

import functools
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from garimpo.llm import bitplane, common, packing

@functools.cache
def fresh(path):
    """The library's own tokenizer, untouched."""
    return Tokenizer.from_file(path)


BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " ", "a", "a b", " a  b ", "x\n y", "x \ny's it'll 'S", "É ñandú x", "a  b", "tab\t b", "<|endoftext|> b", "a <|endoftext|> b", "a<|endoftext|>", "<|startoftext|>", "x <|startoftext|>y <|endoftext|>", "A <|ENDOFTEXT|> b", "<|StartOfText|> a", "<|endoftext|", "<|endoftext|><|endoftext|>", "ﬁ <|endoftext|> é", "ﬁ Å ́x ́", "İ ß ΑΣ ΑΣ.", "word " * 700, "中文 字 1234 5.6", "a\r\n\r\n b", "　 a", "é" * 3000]


@pytest.mark.parametrize("path,keep", [(BYTE, True), (WORD, False)])
def test_encoder_matches_library(path, keep):
    enc = common.WordEncoder(path, keep)
    want = [np.array(fresh(path).encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in TEXTS]
    assert list(enc.encode([t.encode() for t in TEXTS])) == want
    enc.MOST = 2
    assert list(enc.encode([t.encode() for t in TEXTS])) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sÉ́ \n\t  　.1<|>ß​\x1c\x85"), max_size=30), st.sampled_from(("", "<|endoftext|>", "<|STARTOFTEXT|>")))
def test_encoder_on_odd_white_space(text, control):
    text = text[: len(text) // 2] + control + text[len(text) // 2 :]
    for path, keep in ((BYTE, True), (WORD, False)):
        want = np.array(fresh(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert list(common.encoder(path, keep).encode([text.encode()])) == [want]


def test_control_strings_may_be_literal():
    for path, keep in ((BYTE, True), (WORD, False)):
        plain = Tokenizer.from_file(path)
        plain.encode_special_tokens = True
        for text in TEXTS:
            assert list(common.WordEncoder(path, keep, True).encode([text.encode()])) == [np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert fresh(BYTE).encode("a <|endoftext|> b", add_special_tokens=False).ids.count(50256) == 1


@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=8), st.sampled_from([1, 8]), st.integers(1, 50))
@settings(max_examples=100, deadline=None)
def test_chunk_round_trip(docs, bits, block):
    ids = np.array([x for d in docs for x in d], np.uint32)
    names, lengths, back = bitplane.decode_chunk(bitplane.encode_chunk(list(range(len(docs))), list(map(len, docs)), ids, bits, block))
    assert names.tolist() == list(range(len(docs))) and lengths.tolist() == list(map(len, docs)) and back.tolist() == ids.tolist()


ROWS = [(3, "b c d", 1), (1, None, 2), (2, "", 3), (None, "null id", 4), (7, "word " * 3000, 5), (7, "word " * 3000, 6), (9, "tie", 7), (9, "also", 8), (10, "a <|endoftext|> b", 9), (11, "<|startoftext|>", 9)] + [(100 + i, "w " * (i % 37 + 400), 9) for i in range(300)]


def frame(spark, rows):
    return spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "doc_id long, text string, length int, ids string")


def ids_of(path, text, end):
    return [*fresh(path).encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("bits", [1, 8])
def test_token_files(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(bitplane, "FILE_CHUNKS", 3)
    path = str(tmp_path / "files")
    rows = ROWS + [(None, f"nameless {i % 3}", 1) for i in range(40)]
    bitplane.write_token_files(frame(spark, rows).repartition(5), path, WORD, False, 2, bits, chunk_ids=500)
    got = [tuple(r) for r in bitplane.read_token_files(spark, path).collect()]
    at, want = 0, []
    signed = lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64).item() if t is not None else 42  # noqa: E731  Spark's hash of a string, and of null
    for name, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]))):
        ids = ids_of(WORD, text, 2)
        want.append((name, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    # The same from the files' bytes alone.
    chunks = sorted((part, before, bytes(c)) for f in (tmp_path / "files").glob("part-*") for part, before, _, c in bitplane.chunks_of(f.read_bytes()))
    plain = [(None if d == bitplane.NULL_ID else d, n) for _, _, c in chunks for d, n in zip(*(x.tolist() for x in bitplane.decode_chunk(c)[:2]), strict=True)]
    assert plain == [(name, n) for name, _, n, _ in want] and len(chunks) > 20


def test_rows_that_share_an_id_are_spread(spark, tmp_path):
    """A third of all rows without an id, and one row many times over, don't meet in one part."""
    path = str(tmp_path / "files")
    rows = [(None, f"nameless {i}", 1) for i in range(300)] + [(5, "the same row", 1)] * 300
    bitplane.write_token_files(frame(spark, rows).repartition(4), path, WORD, False, 2)
    per = {}
    for f in (tmp_path / "files").glob("part-*"):
        for part, _, _, c in bitplane.chunks_of(f.read_bytes()):
            per[part] = per.get(part, 0) + len(bitplane.decode_chunk(c)[0])
    assert sum(per.values()) == 600 and max(per.values()) < 200


def test_token_files_of_nothing(spark, tmp_path):
    path = str(tmp_path / "files")
    bitplane.write_token_files(frame(spark, []), path, WORD, False, 2)
    assert bitplane.read_token_files(spark, path).collect() == []


def test_files_of_something_else_are_refused():
    with pytest.raises(ValueError):
        list(bitplane.chunks_of(b"GBP1" + bytes(200)))


def test_staged_tables_are_cleared(spark):
    import os

    table = common.staged(spark.range(3), "test")
    folder = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    common.small_batches(spark)
    assert os.path.isdir(folder) and common.clear(spark) >= 1 and not os.path.exists(folder)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000" and common.clear(spark) == 0


def check_packing(rows, got, window):
    """Every id in exactly one piece; sequences gapless, at most window long; returns padded ids."""
    texts = {}
    for name, text, _ in rows:
        texts.setdefault(name, []).append(ids_of(BYTE, text, 0))
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == texts.keys()
    for name, pieces in by_doc.items():
        if len(texts[name]) > 1:
            assert sum(p.length for p in pieces) == sum(map(len, texts[name]))
            continue
        ids, at = texts[name][0], 0
        for p in sorted(pieces, key=lambda p: p.start):
            part = ids[at : at + p.length]
            assert p.start == at and p.doc_tokens == len(ids) and len(part) == p.length and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padded = 0
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= window
        padded += 0 if at & (at - 1) == 0 else window - at
    return padded


@pytest.mark.parametrize("window", [16, 1024])
def test_packing(spark, window):
    got = packing.digest(packing.pack(frame(spark, ROWS).repartition(5), BYTE, True, window=window)).collect()
    assert check_packing(ROWS, got, window) == 0


def test_packing_equal_lengths_and_nothing(spark):
    rows = [(i, "same text again", 0) for i in range(500)]
    assert check_packing(rows, packing.digest(packing.pack(frame(spark, rows), BYTE, True)).collect(), 1024) == 0
    assert packing.pack(frame(spark, []), BYTE, True).collect() == []


def test_plan_fills_windows():
    rng = np.random.default_rng(1)
    hist = np.append(np.bincount(rng.integers(1, 64, 5000), minlength=64), 0)
    p = packing.plan(hist, 64)
    fill = {}
    for length, first, n, sequence, offset in zip(*(p[k] for k in ("length", "first", "n", "sequence", "offset")), strict=True):
        fill[sequence] = fill.get(sequence, 0) + length
    assert set(fill.values()) == {64} and (p["left"] <= hist[:64]).all() and p["left"].sum() > 0.9 * hist.sum()
