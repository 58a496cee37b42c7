import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = st.sampled_from(["a", "B", "the", " ", "  ", "\n", "\t", "\x1c", "\xa0", "'", "'s", "'LL", "1", "23", "é", "É", "ß", "ſ", "µ", "ñ", "日", "😀", "́", "<|endoftext|>", "<|", "...", "&&", "<|startoftext|>", "İ", "Σ", "K"])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_same_ids_as_the_library(name):
    full, fast = Tokenizer.from_file(public_tokenizers.path(name)), tokens.encoder(public_tokenizers.path(name))

    @settings(max_examples=400, deadline=None)
    @given(st.lists(PIECES, max_size=30))
    def same(parts):
        text = "".join(parts)
        assert np.frombuffer(fast.encode(text), "<u4").tolist() == full.encode(text, add_special_tokens=False).ids

    same()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_batches_have_the_same_ids(name, tmp_path, monkeypatch):
    full, fast = Tokenizer.from_file(public_tokenizers.path(name)), tokens.Encoder(public_tokenizers.path(name))
    texts = [None, "", "plain words, it's\nTwo lines", "a  b", "x \u00a0\n\u00a0y", "tab\there", "z" * 300, "<|endoftext|> and \x00 and \x02 signs", "naïve Ünïcode’s", "word " * 50] * 3
    monkeypatch.setattr(tokens, "REMEMBER", 5)
    monkeypatch.setattr(tokens, "CHUNK", 200)
    want = [full.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in fast.encode_all(pa.array(texts))] == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_other_files_go_through_the_whole_tokenizer(name, tmp_path):
    """A file that cuts or normalises otherwise than the two known ones is never cut by their patterns."""
    told = json.load(open(public_tokenizers.path(name)))
    told["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(told))
    full, fast = Tokenizer.from_file(str(other)), tokens.Encoder(str(other))
    texts = ["Some words, it's 12", "", "two  spaces"]
    assert not fast.known
    assert [np.frombuffer(x, "<u4").tolist() for x in fast.encode_all(pa.array(texts))] == [full.encode(t, add_special_tokens=False).ids for t in texts]
    assert fast.flat(pa.array(texts))[1].tolist() == [len(full.encode(t, add_special_tokens=False).ids) for t in texts]
