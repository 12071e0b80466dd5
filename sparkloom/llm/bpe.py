"""BPE encoding and decoding by a tokenization automaton.

compile_merges() builds the automaton by successive merge-gadget construction. It starts from one state with an arc for
every base symbol. The gadget of the k-th merge (u, v) -> w adds, wherever an arc u leads to a state with an arc v, an arc w
from the source of u to the target of v, and forbids v after u from then on. A state is known by the arc that leads to it:
the arcs out of w's state are those out of v's state when the gadget was added (less what later gadgets forbid), and the arcs
into it those into u's source at that time. So the gadgets are stored as four tables (left, right, time, forbidden pairs),
and a cell of the transition table is worked out from them the first time that it is used and kept.

encode() walks the automaton over the symbols of a word: for each prefix the one arc that ends there and that the state
before it allows. decode() emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame

from .common import arrow_schema, held, short_batches

LATIN = "\u024f"


def latin_words() -> re.Pattern:
    """The split pattern of the vocabulary format (a fixed value) for Latin texts alone, whose letters and numbers are the same in all Unicode versions."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(ord(LATIN) + 1) if regex.fullmatch(kind, chr(c)))
    letters, numbers, spaces = of(r"\p{L}"), of(r"\p{N}"), of(r"\s")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")


_WORD = latin_words()


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in printable else spare))
        spare += b not in printable
    return out


class Automaton:
    """Tables of the gadgets; delta: (state, arc) -> may the arc be taken; labels: arc -> text."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], ending: str) -> None:
        self.vocab, self.ending = vocab, ending
        self.size = max(vocab.values(), default=-1) + 1
        self.labels = [""] * self.size
        for label, arc in vocab.items():
            self.labels[arc] = label
        self.left, self.right, self.time = [-1] * self.size, [-1] * self.size, [0] * self.size
        self.alive = [True] * self.size
        self.forbidden: dict[int, int] = {}
        self.delta: dict[int, bool] = {}
        merged = set()
        for k, (a, b) in enumerate(merges, 1):
            self._gadget(k, vocab[a], vocab[b], vocab[a + b], merged)
        base = set(byte_alphabet())
        base |= {c + ending for c in base}
        #: Arc labels as a trie of the symbols; a node: [arc inside a word or -1, arc at its end or -1, next nodes].
        self.trie: list = [-1, -1, {}]
        for label, arc in vocab.items():
            if self._usable(label, arc, base):
                final = bool(ending) and label.endswith(ending)
                node = self.trie
                for c in label.removesuffix(ending) if final else label:
                    node = node[2].setdefault(c, [-1, -1, {}])
                node[1 if final or not ending else 0] = arc
                if not ending:
                    node[0] = arc

    def _usable(self, label: str, arc: int, base: set[str]) -> bool:
        return label in base if self.time[arc] == 0 else self.alive[arc]

    def _gadget(self, k: int, u: int, v: int, w: int, merged: set[int]) -> None:
        if w not in merged:  # a second way to w adds no arc: its own pair can no longer meet
            fits = self.alive[u] and self.alive[v] and self._meet(u, v)
            if fits:
                merged.add(w)
                self.left[w], self.right[w], self.time[w], self.alive[w] = u, v, k, True
            elif not self.time[w]:
                self.time[w], self.alive[w] = k, False
        self.forbidden.setdefault(u * self.size + v, k)

    def _meet(self, x: int, y: int) -> bool:
        """May arc y leave x's state: y's and x's gadgets are undone, latest first, down to base symbols."""
        below = 1 << 60
        while True:
            k = self.forbidden.get(x * self.size + y)
            if k is not None and k < below:
                return False
            a, b = self.time[x], self.time[y]
            if not a and not b:
                return True
            if a > b:
                below, x = a, self.right[x]
            else:
                below, y = b + 1, self.left[y]

    def encode(self, symbols: str) -> list[int]:
        """Arcs of one word, given in the byte alphabet."""
        n, delta, size, trie = len(symbols), self.delta, self.size, self.trie
        ends = [-1] * (n + 1)  # the arc that ends each prefix
        if len(delta) > 500_000:
            delta.clear()
        for j in range(n):
            state, node = ends[j], trie
            if j and state < 0:
                continue
            for i in range(j + 1, n + 1):
                node = node[2].get(symbols[i - 1])
                if node is None:
                    break
                arc = node[0] if i < n else node[1]
                if arc >= 0 and ends[i] < 0:
                    if j:
                        cell = state * size + arc
                        allowed = delta.get(cell)
                        if allowed is None:
                            allowed = delta[cell] = self._meet(state, arc)
                        if not allowed:
                            continue
                    ends[i] = arc
        out, i = [], n
        while i:
            arc = ends[i]
            out.append(arc)
            i -= len(self.labels[arc]) - (len(self.ending) if i == n else 0)
        return out[::-1]


class WordIds(dict):
    """Ids (as bytes) of a pre-split word, plain or already in the byte alphabet; holds at most `most` words."""

    def __init__(self, automaton: Automaton, plain: bool, most: int = 150_000) -> None:
        self.automaton, self.plain, self.most = automaton, plain, most
        self.alphabet = byte_alphabet()

    def __missing__(self, word: str) -> bytes:
        symbols = "".join(map(self.alphabet.__getitem__, word.encode())) if self.plain else word
        ids = np.array(self.automaton.encode(symbols), "<u4").tobytes()
        if len(self) >= self.most:
            self.clear()
        if len(word) <= 40:
            self[word] = ids
        return ids


class Tokenizer:
    """Reads a vocabulary file of word-end BPE and gives ids and texts as the file's own library does."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.words, self.symbol_words = WordIds(self.automaton, True), WordIds(self.automaton, False)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = list(self.automaton.labels)
        for text, i in self.special.items():
            self.labels += [""] * (i + 1 - len(self.labels))
            self.labels[i] = text
        # texts that are not ASCII are normalised, and those beyond Latin split, by the file's own rules in the Unicode version of its library
        rules = tokenizers.Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self.normalise, self.split_words = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _plain(self, text: str) -> bytes:
        text = text.lower() if text.isascii() else self.normalise(text)
        if text.isascii() or max(text) <= LATIN:
            return b"".join(map(self.words.__getitem__, _WORD.findall(text)))
        return b"".join([self.symbol_words[word] for word, _ in self.split_words(text)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.split is None or "<" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load(path: str) -> Tokenizer:
    return held(f"bpe {path}", lambda: Tokenizer(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs (doc_id, text); with keep_ids also ids and decoded.

    Null text counts as empty: 0 tokens and the digests of nothing. A null doc_id stays null, repeated rows give repeated
    rows, an empty table an empty result; other columns are not read.
    """
    path = path or default_path()
    short_batches(docs.sparkSession)
    ddl = SCHEMA + (", ids array<long>, decoded string" if keep_ids else "")
    out = arrow_schema(docs.sparkSession, ddl)

    def run(batches):
        tokenizer = load(path)
        for batch in batches:
            columns = [[] for _ in out]
            for text in batch.column(1):
                ids = tokenizer.encode(text.as_py() or "")
                decoded = tokenizer.decode(ids)
                row = [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                if keep_ids:
                    row += [np.frombuffer(ids, "<u4").tolist(), decoded]
                for c, x in zip(columns[1:], row):
                    c.append(x)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns[1:], list(out)[1:]))], schema=out)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)
