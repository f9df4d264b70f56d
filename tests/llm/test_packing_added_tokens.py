from __future__ import annotations

from tokenizers import Tokenizer

from attestra.llm import packing


def test_added_tokens_as_in_the_tokenizer_file():
    files = packing.vocabulary()
    untouched = Tokenizer.from_file(files[0])
    assert packing.encode("<|endoftext|> x", files) == [50256, 2124]
    for t in ("<|endoftext|>", "a<|endoftext|>b", "é <|endoftext|><|endoftext|>\n日本", "<|endoftext", "plain text"):
        assert packing.encode(t, files) == untouched.encode(t, add_special_tokens=False).ids, t
