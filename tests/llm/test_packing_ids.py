"""The ids of remembered parts and of merging by ranks are the tokenizer's own."""

import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from netlens.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABETS = [
    "abcdefgh ", "aaab' ", "the cat's I'll we've ", "AbÑñßéü .,!?\n", " \n", "0123456789 .-\n", "$%&*#<|>endoftext ", "\t  　x",
    "日本語 кириллица 😀é ", "ǅǈªº¼ ", "zzzzzzzz",
]


@pytest.fixture(scope="module")
def encoder():
    return packing.PartEncoder(PATH, cache_parts=500)


def test_random_texts(encoder):
    rng = random.Random(11)
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["", " ", "\n", "  ", "a ", " a", "<|endoftext|>", "x <|endoftext|> y", "<|endoftext|", "'s 's"]
    for i in range(20_000):
        letters = rng.choice(ALPHABETS) + (rng.choice(ALPHABETS) if rng.random() < 0.3 else "")
        texts.append("".join(rng.choice(letters) for _ in range(rng.randrange(40))))
    for at in range(0, len(texts), 1_000):
        part = texts[at : at + 1_000]
        want = [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        assert encoder(part) == want
    assert encoder.fast is not None


def test_a_vocabulary_that_ranks_do_not_give(tmp_path):
    """'abc' is merged from a and bc only, and 'ab' comes first: on its own it stays in two."""
    letters = sorted(packing.byte_letters(), key=packing.byte_letters().get)
    vocab = {c: i for i, c in enumerate(letters)} | {"ab": 256, "bc": 257, "abc": 258}
    tokenizer = Tokenizer.from_str(
        '{"version":"1.0","added_tokens":[],"pre_tokenizer":{"type":"ByteLevel","add_prefix_space":false,"trim_offsets":true,"use_regex":true},'
        '"model":' + __import__("json").dumps({"type": "BPE", "vocab": vocab, "merges": [["a", "b"], ["b", "c"], ["a", "bc"]]}) + "}"
    )
    path = str(tmp_path / "own.json")
    tokenizer.save(path)
    encoder = packing.PartEncoder(path)
    assert encoder.fast is None
    for text in ("abc", "x abc ab bc", "aabcc"):
        assert encoder([text]) == [array("I", tokenizer.encode(text).ids).tobytes()]
