"""The encoder's pieces against the untouched library on whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from newsgraph.llm import queries, tokens
from newsgraph.llm.tokens import Encoder, packed, tokenizer_path, unpacked

PATH = tokenizer_path(queries.TOKENIZER)
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH)


def plain(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n a", "a\t b", "it's we'll  'tis", "x" * 300, "a " + "b" * 300,
       "end <|endoftext|> start", "<|endoftext|>", " <|endoftext|> ", "a  <|endoftext|>b  c<|endoftext|><|endoftext|>\n",
       "<|endoftext|", "é ß 　 中文", "1 22 333  4444", "😀  😀 "]


def test_odd_texts():
    assert [ids(x) for x in ENCODER.batch(ODD)] == [plain(x) for x in ODD]
    assert [ids(ENCODER(x)) for x in ODD] == [plain(x) for x in ODD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "b'", "Zü", "12", "!", "<|endoftext|>", "<|", "　", " "]), max_size=12))
def test_any_mix(parts):
    text = "".join(parts)
    assert ids(ENCODER(text)) == plain(text)


def test_whole_documents():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    assert [ids(x) for x in ENCODER.batch(texts)] == [plain(x) for x in texts]


def test_bounded_memory(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY_BYTES", 2000)
    encoder = Encoder(PATH)
    for i in range(30):
        texts = [f"word{i} other{i} " + "long" * 40] * 2
        assert [ids(x) for x in encoder.batch(texts)] == [plain(x) for x in texts]
        assert encoder.held < 2000 + 2000
    assert not any(len(x) > tokens.LONGEST for x in encoder.first | encoder.later | encoder.atoms)


def test_other_tokenizers_take_whole_texts():
    path = tokenizer_path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), Encoder(path)
    assert not encoder.by_pieces
    texts = ["Some  Words here", None, " x "]
    assert [ids(x) for x in encoder.batch(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("values", [[], [1, 2], [70_000, 3]])
def test_packed(values):
    assert unpacked(packed(np.array(values, "<u4"))).tolist() == values


def test_new_pieces_are_encoded_many_in_one_text(monkeypatch):
    encoder, calls = Encoder(PATH), []
    plain_call = encoder._encoded
    monkeypatch.setattr(encoder, "_encoded", lambda texts: calls.append(len(texts)) or plain_call(texts))
    text = "head " + " ".join(f"wörd{i}, <b>{i}</b>\nnext{i}" for i in range(2000))
    assert ids(encoder.batch([text])[0]) == plain(text)
    assert sum(calls) < 200


def test_pieces_that_do_not_end_with_a_token_are_encoded_alone():
    encoder = Encoder(PATH)
    encoder.token_bytes = encoder.token_bytes + 1
    assert [ids(x) for x in encoder.batch(ODD)] == [plain(x) for x in ODD]


def test_batches_are_cut_by_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "TOGETHER_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4, 5], "text": ["a b", None, "c" * 25, "", "d e f"]})
    assert [b.num_rows for b in tokens._by_bytes([batch, batch.slice(0, 0)])] == [2, 2, 1]
    made = pa.Table.from_batches(list(tokens._encode([batch], PATH, 0, None)))
    assert made["doc_id"].to_pylist() == [1, 2, 3, 4, 5]
    assert [unpacked(x).tolist() for x in made["ids"].to_pylist()] == [[*plain(x), 0] for x in batch["text"].to_pylist()]


def test_memory_of_a_worker_keeps_what_comes_again():
    encoder = Encoder(PATH)
    encoder.batch(["once twice twice", "x twice"])
    assert set(encoder.later) == {" twice"}
    assert tokens.MEMORY_BYTES <= 32 << 20
