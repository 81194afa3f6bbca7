import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm_helpers import records
from packloom.llm.packing import best_fit, pack_documents, pack_pieces
from packloom.llm.pretokens import Pretokens, prove_whole_tokens
from packloom.llm.token_counts import count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_are_the_librarys(hostile, library):
    found = records(count_tokens(hostile, PATH, 2048))
    texts = {r["doc_id"]: r["text"] for r in records(hostile) if r["doc_id"] is not None}
    assert len(found) == hostile.count()
    for row in found:
        if row["doc_id"] is not None:
            text = texts[row["doc_id"]] or ""
            n = len(library.encode(text, add_special_tokens=False).ids)
            assert (row["n_tokens"], row["n_bytes"], row["over_limit"]) == (n, len(text.encode()), n > 2048)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_other_vocabularies_go_to_their_library(hostile, name):
    import sentencepiece

    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))
    else:
        count = lambda t: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids)
    texts = {r["doc_id"]: r["text"] or "" for r in records(hostile) if r["doc_id"] is not None}
    for row in records(count_tokens(hostile.where("doc_id < 12"), path, 10)):
        assert row["n_tokens"] == count(texts[row["doc_id"]])


def test_proof_and_bounded_memos(library, monkeypatch):
    whole = prove_whole_tokens(PATH)
    assert len(whole) > 20000 and whole["the"] == np.array(library.encode("the", add_special_tokens=False).ids, "<u4").tobytes()
    monkeypatch.setattr("packloom.llm.pretokens.CHUNKS", 3)
    monkeypatch.setattr("packloom.llm.pretokens.MERGED", 2)
    encoder = Pretokens(PATH, whole)
    texts = ["qwrtz zxcvb, qwrtz plmkj it's", "zxcvb qqqq wwww eeee don't!?!", "qwrtz"]
    for text, chunks in zip(texts, encoder.values(texts), strict=True):
        assert np.frombuffer(b"".join(chunks), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_unknown_words_go_straight_to_the_merges(library):
    encoder = Pretokens(PATH, prove_whole_tokens(PATH))
    encoder.library = None  # no plain word passes the normaliser and the pre-tokeniser again
    texts = ["Qwrtzx zxcvbq,, qwrtzx's", "Çaöüß ñandúqx µªº ½x²³ don't¡¿x", "zß" * 9000 + " " + "qx9" * 300]
    for text, chunks in zip(texts, encoder.values(texts), strict=True):
        assert np.frombuffer(b"".join(chunks), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [7, 2048])
def test_packing_keeps_every_token(hostile, library, capacity):
    found = records(pack_documents(hostile, PATH, capacity))
    texts = {r["doc_id"]: r["text"] for r in records(hostile) if r["doc_id"] is not None}
    copies = {i: sum(r["doc_id"] == i for r in records(hostile)) for i in texts}
    for i, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        expected = []
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            expected.append((n, at, len(part), zlib.crc32(part.tobytes())))
        mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found if r["doc_id"] == i)
        assert mine == sorted(expected * copies[i])
    check_sequences(found, capacity)


def check_sequences(found, capacity):
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return by_sequence


def test_buckets_cost_little_space(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 0, 0, int(x), 0) for i, x in enumerate(rng.integers(1, 100, 3000))]
    pieces = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    found = check_sequences(records(pack_pieces(pieces, 100, bucket_rows=200, open_bins=128)), 100)
    assert len(found) <= 1.05 * sum(r[3] for r in rows) / 100


def test_fullest_bin_closes_first():
    bins, offsets, left = best_fit([6, 5, 9, 4, 1], 10, open_bins=2)
    # 9 needs a new bin, so the bin with 6 closes; 4 fits only beside 5, and 1 beside either: the 9, or the 5 + 4.
    assert bins == [0, 1, 2, 1, bins[4]] and bins[4] in (1, 2) and offsets[:4] == [0, 0, 0, 5] and 0 not in left


def test_empty_table(nothing):
    assert pack_documents(nothing, PATH, 10).count() == 0
    assert count_tokens(nothing, PATH, 10).count() == 0
