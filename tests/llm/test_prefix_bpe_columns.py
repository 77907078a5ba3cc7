"""Decoding a column of ids gives the texts that decoding each list gives."""

import public_tokenizers
import pyarrow as pa

from surfex.llm.prefix_bpe import WordBpe


def test_lists_decode_as_each_does():
    bpe = WordBpe(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    texts = ["", "Two words, a word's 12 ends", "  ", "été 中文 <|endoftext|> x", "a" * 50]
    ids = [bpe.encode(t) for t in texts] * 3
    lists = pa.array([*ids, None], pa.list_(pa.int32()))
    expected = [bpe.decode(i) for i in ids] + [""]
    assert bpe.decode_lists(lists).to_pylist() == expected and bpe.decode_lists(lists).type == pa.string()
    assert bpe.decode_lists(lists.slice(3, 7)).to_pylist() == expected[3:10] and bpe.decode_lists(lists.slice(2, 0)).to_pylist() == []


def test_ids_are_joined_as_bytes():
    bpe = WordBpe(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read(), kept=3)
    text = "one two three one four été 中文 one <|endoftext|> two"
    packed = bytearray()
    for part in (text, "", text):
        bpe.encode_into(part, packed)
    ids = bpe.encode(text)
    assert memoryview(packed).cast("i").tolist() == ids * 2 and len(ids) >= 10
    assert all(type(x) is bytes and x for kept in (bpe.recent, bpe.older, bpe.chunks) for x in kept.values())
