"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word the last token of its encoding is unique: of the tokens that end there (found by one pass of
an Aho-Corasick automaton over the vocabulary) it is the one that is compatible with the last token of the prefix before
it. Back-pointers from the whole word then give the exact ids, in time linear in the word.

Two tokens are compatible if no merge rule would have joined pieces of both: the pieces that ever stand at the boundary
are the right edges of the left token's merge tree and the left edges of the right token's, each until its own merge.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

_END = "\n"  # stands for the word-end suffix; byte-level alphabets have no newline
_NEVER = 1 << 60
# The word rule of the file that the quick path knows, and the same rule for letters below U+0100, which NFC
# leaves alone; white space other than spaces, tabs and line ends takes the long path.
_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LETTERS, _NUMBERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SIMPLE = re.compile("[\t\n\r -~\u00a1-\u00ff]*")
# No letter starts another branch, so runs of letters, the most frequent, may be tried first.
_WORDS = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
_MODELS: dict[int, WordBpe] = {}


def _packed(ids: tuple[int, ...]) -> bytes:
    """Ids as four bytes each: a text's are then joined, not copied one by one."""
    return array("i", ids).tobytes()


class WordBpe:
    """A vocabulary file of the tokenizers library whose BPE marks word ends and drops white space.

    Normalising and cutting into words follow the file's own rules; twice ``kept`` bounds the words whose ids are remembered.
    """

    def __init__(self, text: str, kept: int = 250_000):
        parts = json.loads(text)
        model, suffix = parts["model"], parts["model"].get("end_of_word_suffix")
        if model["type"] != "BPE" or not suffix or parts["decoder"] is not None:
            raise ValueError("a BPE file with word ends and without a decoder is needed")
        rules = Tokenizer.from_str(text)
        self.normalize, self.cut = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        own = lambda token: token[:-len(suffix)] + _END if token.endswith(suffix) and token != suffix else token
        vocabulary = {own(t): i for t, i in model["vocab"].items()}
        self.names = [""] * (1 + max([*vocabulary.values(), *(t["id"] for t in parts["added_tokens"])]))
        for token, i in model["vocab"].items():
            self.names[i] = token
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        for token, i in self.special.items():
            self.names[i] = token
        self.tokens = pa.array(self.names, pa.string())
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")

        self.rank, tree = {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = map(own, pair.split(" ") if isinstance(pair, str) else pair)
            left, right, whole = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.rank[left, right] = r
            tree.setdefault(whole, (left, right, r))
        if any(tree[x][2] >= r for left, right, r in tree.values() for x in (left, right) if x in tree):
            raise ValueError("a merge rule stands before one that it needs")
        self.tree, self.pairs, whole_tokens = tree, {}, set()
        automaton = ahocorasick.Automaton()
        for token, i in sorted(vocabulary.items(), key=lambda x: tree.get(x[1], (0, 0, -1))[2]):
            if i in tree:
                a, b, r = tree[i]
                # Letters encode to the token if both halves do so and the first rule to join pieces of both is its own.
                if a not in whole_tokens or b not in whole_tokens or self._first(a, b) != r:
                    continue
            elif len(token.removesuffix(_END)) != 1:
                continue  # no rule makes it
            whole_tokens.add(i)
            automaton.add_word(token, (i, len(token)))
        automaton.make_automaton()
        self.matches, self.kept = automaton.iter, kept
        self.recent, self.older, self.chunks = {}, {}, {}
        self.letters = [self._letter(b) for b in range(256)]
        self.plain_specials = all("<" in t for t in self.special)
        # The quick path knows the rules of one kind of file; other files go by their own rules alone.
        self.simple = _SIMPLE if [n["type"] for n in parts["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"] and parts["pre_tokenizer"][
            "pretokenizers"][0]["pattern"]["Regex"] == _RULE else re.compile("(?!)")

    @staticmethod
    def _letter(byte: int) -> str:
        """Letter of a byte in the byte-level alphabet: printable ones stand for themselves, the others follow from 256 on."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        return chr(byte if byte in printable else 256 + sum(b not in printable for b in range(byte)))

    def _edge(self, token: int, side: int) -> Iterator[tuple[int, int]]:
        """Pieces at one edge of a token, from the whole inwards, each with the rank of the rule that ends it."""
        ends = _NEVER
        while True:
            yield token, ends
            if token not in self.tree:
                return
            ends, token = self.tree[token][2], self.tree[token][side]

    def _first(self, a: int, b: int) -> int:
        """Rank of the rule that first joins pieces of ``a`` and ``b``; of equal pairs the leftmost merges first."""
        left = list(self._edge(b, 0))
        return min((r for x, x_ends in self._edge(a, 1) for y, y_ends in left if (r := self.rank.get((x, y), _NEVER)) < x_ends and r <= y_ends), default=_NEVER)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` followed by ``b`` stays as it is; remembered for the pair."""
        tree, rank = self.tree, self.rank
        stays, left, y, y_ends = True, [], b, _NEVER
        while True:
            left.append((y, y_ends))
            if y not in tree:
                break
            y, _, y_ends = tree[y]
        x, x_ends = a, _NEVER
        while stays:
            for y, y_ends in left:
                r = rank.get((x, y))
                if r is not None and r < x_ends and r <= y_ends:
                    stays = False
                    break
            if x not in tree:
                break
            _, x, x_ends = tree[x]
        if len(self.pairs) >= 400_000:
            self.pairs.clear()
        self.pairs[a << 20 | b] = stays
        return stays

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of words of the byte-level alphabet, none empty; one pass of the automaton over all of them."""
        text = _END.join(words) + _END
        # By the last letter of a prefix: its last token and where the prefix before it ends; a word starts after the one before.
        last, back, starts = [-1] * (len(text) + 1), [0] * (len(text) + 1), bytearray(len(text) + 1)
        at = -1
        for word in words:
            starts[at] = 1
            at += len(word) + 1
        known, test = self.pairs.get, self._compatible
        for end, (token, size) in self.matches(text):
            if last[end] < 0:
                start = end - size
                if not starts[start]:
                    before = last[start]
                    if before < 0:
                        continue
                    fits = known(before << 20 | token)
                    if not fits and (fits is not None or not test(before, token)):
                        continue
                last[end], back[end] = token, start
        out, end = [], -1
        for word in words:
            start, end = end, end + len(word) + 1
            ids, at = [], end
            while at > start:
                ids.append(last[at])
                at = back[at]
            out.append(tuple(ids[::-1]))
        return out

    def encode(self, text: str) -> list[int]:
        ids = bytearray()
        self.encode_into(text, ids)
        return np.frombuffer(ids, np.int32).tolist()

    def encode_into(self, text: str, ids: bytearray) -> None:
        """Append the ids of a text, four bytes each."""
        at = 0
        if "<" in text or not self.plain_specials:
            for special in self.specials.finditer(text):
                self._plain(text[at:special.start()], ids)
                ids += _packed((self.special[special.group()],))
                at = special.end()
        self._plain(text[at:] if at else text, ids)

    def _plain(self, text: str, ids: bytearray) -> None:
        if self.simple.fullmatch(text):
            self._simple(text, ids)
            return
        for chunk in text.replace("\n", " ").split(" "):
            if self.simple.fullmatch(chunk):
                self._simple(chunk, ids)
                continue
            known = self.chunks.get(chunk)
            if known is None:
                words = [word for word, _ in self.cut(self.normalize(chunk))]
                known = b"".join(map(_packed, self.encode_words(words))) if words else b""
                if len(self.chunks) >= self.kept // 10:
                    self.chunks.clear()
                if len(chunk) < 100:
                    self.chunks[chunk] = known
            ids += known

    def _simple(self, text: str, ids: bytearray) -> None:
        words = _WORDS.findall(text.lower())
        known = list(map(self.recent.get, words))
        if None in known:
            missing = {word for word, ids_ in zip(words, known) if ids_ is None}
            if len(self.recent) >= self.kept:
                self.older, self.recent = self.recent, {}
                missing = set(words)
            new = []
            for word in missing:
                found = self.older.get(word)
                if found is None:
                    new.append(word)
                else:
                    self.recent[word] = found
            if new:
                letters = self.letters
                coded = self.encode_words([w if w.isascii() else "".join([letters[b] for b in w.encode()]) for w in new])
                self.recent.update(zip(new, map(_packed, coded)))
            known = map(self.recent.__getitem__, words)
        ids += b"".join(known)

    def decode(self, ids: list[int] | None) -> str:
        return " ".join(map(self.names.__getitem__, ids or ()))

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """The same for a column of ids, taken and joined by Arrow."""
        offsets = lists.offsets.to_numpy()
        tokens = self.tokens.take(lists.values.slice(offsets[0], offsets[-1] - offsets[0]))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), tokens), " ")


def _model(content: str) -> WordBpe:
    """The worker's one copy of a vocabulary."""
    key = hash(content)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = WordBpe(content)
    return _MODELS[key]


def _sent(df: DataFrame, path: str) -> Callable[[], WordBpe]:
    """The vocabulary, read on the driver and sent to the workers once: a few MB, whatever the data's size."""
    content = df.sparkSession.sparkContext.broadcast(Path(path).read_text())
    return lambda: _model(content.value)


def encode(df: DataFrame, path: str, text: Column | None = None) -> DataFrame:
    """``df`` with ``ids`` array<int>: the whole text's ids, empty for a null or empty text. An own ``ids`` is replaced.

    Strings of special tokens in a text give their ids, as the tokenizers library does. Repeated rows are rows like any
    other; an empty table stays empty. ``path`` is read on the driver.
    """
    model = _sent(df, path)

    def run(texts: pa.Array) -> pa.Array:
        bpe, flat, offsets = model(), bytearray(), array("i", [0])
        for text in texts.to_pylist():
            bpe.encode_into(text or "", flat)
            offsets.append(len(flat) // 4)
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int32)), pa.array(np.frombuffer(flat, np.int32)))

    return df.withColumn("ids", F.arrow_udf(run, "array<int>")(F.col("text") if text is None else text))


def decode(df: DataFrame, path: str, ids: Column | None = None) -> DataFrame:
    """``df`` with ``decoded``: the tokens of ``ids`` joined by spaces, the library's rule for a file without decoder."""
    model = _sent(df, path)

    def run(lists: pa.Array) -> pa.Array:
        return model().decode_lists(lists)

    return df.withColumn("decoded", F.arrow_udf(run, "string")(F.col("ids") if ids is None else ids))
