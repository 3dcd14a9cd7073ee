"""Pieces of texts and what a worker keeps of them, against the library's plain call."""

import random

import numpy as np
import pyarrow as pa
import pytest

from wedgeworks.llm import token_files

#: Characters and strings at which a byte-level tokenizer may cut, and some at which it doesn't.
PARTS = [*"  \n\n\t\r\v\x1c\x85  　᠎​\x00abst5½²ª_-!''’éß×÷жя中🙂́ǆſΩ", "re", "ll", "12", "word", "unquestionably-long-words", "<|endoftext|>", "<|"]


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def some_texts(seed, n=3000):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.choice([0, 1, 2, 3, 4, 6, 30, 200]))) for _ in range(n)]


def same_as_library(encoder, texts):
    ids, many = encoder(*token_files.flat(pa.array(texts, pa.string())))
    want = [[*encoder.tool.encode(t, add_special_tokens=False).ids, token_files.END] for t in texts]
    got = np.split(ids, np.cumsum(many)[:-1])
    for t, x, y in zip(texts, got, want, strict=True):
        assert x.tolist() == y, t


def test_pieces(model):
    same_as_library(token_files.Encoder(model), some_texts(1))


def test_full_memory(model, monkeypatch):
    """Pieces go when there are too many, and those met again stay if there is room."""
    monkeypatch.setattr(token_files, "MEMO", 200)
    monkeypatch.setattr(token_files, "STEP", 50)
    encoder = token_files.Encoder(model)
    for seed in range(3):
        same_as_library(encoder, some_texts(seed, 500))
        assert encoder.n <= 200 + 50 and len(encoder.far) <= 50 + 200 // 16


def test_same_hash(model, monkeypatch):
    """Pieces are told apart by their bytes."""
    monkeypatch.setattr(token_files.Encoder, "_hash", lambda self, keys: np.full(len(keys), (1 << self.bits) - 2))
    same_as_library(token_files.Encoder(model), some_texts(2, 200))


def test_slices():
    """A slice of a column has its own rows alone, and a heavy row is alone."""
    part = pa.RecordBatch.from_arrays([pa.array(["a", "", "bcd" * 40, "é", "x"])], ["t"])
    got = [x.column("t").to_pylist() for x in token_files.slices([part], lambda p: np.diff(token_files.flat(p.column("t"))[1]) + 1, 10)]
    assert got == [["a", ""], ["bcd" * 40], ["é", "x"]]
    assert token_files.flat(part.column("t").slice(3))[0].tobytes() == "éx".encode()


def test_ranks():
    counts = np.array([1, 0, 4, 5, 2])
    ranks = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 1, 2, 3, 70000, 9], np.uint32)
    control, data, quads, size = token_files.encode_ranks(ranks, counts)
    assert (len(control), len(data)) == (quads.sum(), size.sum()) and quads.tolist() == [1, 0, 1, 2, 1]
    assert token_files.decode_ranks(control, data, counts).tolist() == ranks.tolist()
    at, start = np.cumsum(quads) - quads, np.cumsum(size) - size
    one = token_files.decode_ranks(control[at[3] : at[4]], data[start[3] : start[4]], counts[3:4])
    assert one.tolist() == ranks[5:10].tolist()
    with pytest.raises(ValueError):
        token_files.decode_ranks(control, data[:-1], counts)


def test_kept_from_task_to_task(model, monkeypatch):
    """A worker loads the tokenizer once for all tasks of a set of files, and sends the library no piece twice."""
    asked = []
    library = token_files.Encoder._library
    monkeypatch.setattr(token_files.Encoder, "_library", lambda self, texts: asked.extend(texts) or library(self, texts))
    task = token_files._tokenize(model, "files", pa.int64())
    texts = ["some words, and some words more\n" + "unquestionably-long-words" for _ in range(4)]
    part = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array([0] * 4, pa.int64()), pa.array(texts)], ["doc_id", "_tie", "_text"])
    first, first_counts = task([part])
    kept = token_files.encoder(model, "files")
    assert asked and len(asked) == len(set(asked))
    n = len(asked)
    second, counts = task([part])
    assert len(asked) == n and token_files.encoder(model, "files") is kept
    assert first.equals(second) and first_counts.equals(counts)
    found = np.frombuffer(counts.column("counts")[0].as_py(), np.int64)
    assert found[token_files.END] >= 4 and found.sum() == sum(second.column("n_tokens").to_pylist())
    assert token_files.encoder(model, "others") is not kept
    token_files.let_go()
    assert not token_files._ENCODERS
