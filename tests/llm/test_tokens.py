import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewater.llm.token_counts import CHUNK, CompiledTokenizer, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
MACHINE, LIBRARY = CompiledTokenizer(PATH), Tokenizer.from_file(PATH)


def theirs(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_all_documents(spark):
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet")
    expected = dict(zip(table["doc_id"].to_pylist(), theirs(table["text"].to_pylist()), strict=True))
    result = token_counts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), PATH).collect()
    sizes = {i: len(t.encode()) for i, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True)}
    assert {r.doc_id: r.n_tokens for r in result} == expected and {r.doc_id: r.n_bytes for r in result} == sizes
    assert all(r.over_limit == (r.n_tokens > 1024) for r in result)


ALPHABET = [*"  \n\t'''sstmdrevl e 12a.!é你́🙂_<|>", "<|endoftext|>", "'re", "'ll", "'ve", "\u00a0", "\u2028"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join), max_size=8))
def test_any_text(texts):
    assert MACHINE.counts(texts).tolist() == theirs(texts)


def test_chunks_join_wherever_they_are_cut():
    rng = random.Random(7)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(n)) for n in (CHUNK - 1, CHUNK, CHUNK + 1, 3 * CHUNK + 5, 5000)]
    texts += [" " * (3 * CHUNK), "'" * CHUNK + "re", "a" * (CHUNK - 1) + "'ll", " " * (CHUNK - 1) + "x", "\n" * CHUNK + " y", "x" * (CHUNK - 2) + "'r"]
    assert MACHINE.counts(texts).tolist() == theirs(texts)
    alone = [int(MACHINE.counts([t])[0]) for t in texts]
    assert alone == theirs(texts)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        CompiledTokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_states_are_dropped_not_results(monkeypatch):
    import tidewater.llm.token_counts as module

    monkeypatch.setattr(module, "MAX_STATES", 50)
    machine = CompiledTokenizer(PATH)
    texts = [f"some words number {i} and unusual{i} endings" for i in range(200)]
    assert np.concatenate([machine.counts(texts[i : i + 7]) for i in range(0, 200, 7)]).tolist() == theirs(texts)
