import hashlib
import random
import unicodedata

import public_tokenizers
import pytest
from helpers import documents
from tokenizers import Tokenizer

from surfex.llm.prefix_bpe import WordBpe, decode, encode
from surfex.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return WordBpe(open(PATH).read(), kept=1000), Tokenizer.from_file(PATH)


def same(both, texts):
    own, library = both
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        got = own.encode(text)
        assert got == want.ids, text
        assert own.decode(got) == library.decode(want.ids, skip_special_tokens=False)


def test_every_letter_alone_and_inside_a_word(both):
    letters = [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000]
    same(both, ["".join(letters[k:k + 40]) for k in range(0, len(letters), 40)])
    same(both, [f"a{c}b {c}" for c in letters[:0x3100]])


def test_random_words_and_runs(both):
    rng = random.Random(5)
    same(both, ["".join(rng.choices("abcdeinorstaaaa", k=rng.randint(1, 30))) for _ in range(4000)])
    same(both, ["".join(rng.choices("aA1' .,!\n\té漢字😀́ΣİſK", k=rng.randint(1, 40))) for _ in range(3000)])
    same(both, ["a" * k for k in range(200)] + ["ha" * 3000, "!" * 5000, "<|endoftext|>", "x<|startoftext|>'s y<|endoftext|", "", " ", "it's we'll"])
    same(both, [unicodedata.normalize("NFD", "Éé ñ ü Å ÉCOLE")])


def test_whole_table_against_the_library(spark):
    folder = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op6_prefix_bpe"](spark, folder).collect()
    assert len(rows) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_odd_rows(spark):
    docs = documents(spark, [None, "", " \n", "long " * 100_000, (None, "a"), (1, "a"), (1, "a")])
    rows = decode(encode(docs, PATH), PATH).collect()
    assert sorted(len(r.ids) for r in rows) == [0, 0, 0, 1, 1, 1, 100_000]
    assert {r.decoded for r in rows if r.text == "a"} == {"a</w>"}
    assert encode(documents(spark, []), PATH).count() == 0
