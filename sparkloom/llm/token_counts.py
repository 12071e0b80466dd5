"""Token counts by overlap resynchronisation.

A text of over `chunk` characters is encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced at a
token that both have at the same place: the boundary is proven stable, for BPE merges left of a boundary that nothing
crosses don't depend on what is right of it, and the other way round; with one whole token in common, the left chunk shows
that nothing crosses its start and the right chunk that nothing crosses its end. Where the overlap has no common token, the
right chunk is encoded again from further left, the overlap doubled each time; at last it begins where the left chunk began.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_schema, short_batches

CHUNK, OVERLAP = 1 << 14, 64


class Pieces:
    """A sentencepiece model: token counts, and (start, end) of each token in characters."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)] if texts else []

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = [(p.begin, p.end) for p in self.model.encode(text, return_type="proto").pieces]  # in bytes
        if text.isascii():
            return found
        letters = np.concatenate([[0], np.cumsum(np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80)])
        return list(map(tuple, letters[np.array(found, int).reshape(-1, 2)].tolist()))


class Fast:
    """A model of the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch(texts, add_special_tokens=False)]

    spans = None  # pre-split words keep its own work linear


def load(path: str):
    return Pieces(path) if path.endswith(".model") else Fast(path)


def tokens_of_chunks(spans, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of text, encoded in chunks; spans(part) gives the tokens of a part."""
    if len(text) <= chunk:
        return len(spans(text))
    settled, begin, end = 0, 0, chunk  # tokens spliced off so far; the left chunk, of which left are the tokens after the splice
    left = spans(text[:end])
    while end < len(text):
        to, width, splice = min(len(text), end + chunk), overlap, None
        while splice is None and end - width > begin:
            right = spans(text[end - width : to])
            splice = common(left, right, end - width - begin)
            width, start = 2 * width, end - width
        if splice is None:  # the left chunk is made longer, with the token of its last splice for proof
            start, right = begin, spans(text[begin:to])
            k = right.index(left[0]) if settled and left[0] in right else 0
            if settled and not (right[k] == left[0] and whole(right, k)):
                return len(spans(text))
            splice = (0, k)
        settled, begin, left, end = settled + splice[0], start, right[splice[1] :], to
    return settled + len(left)


def common(left: list[tuple[int, int]], right: list[tuple[int, int]], shift: int) -> tuple[int, int] | None:
    """The last token that both have: its numbers in left and right. Empty spans prove nothing, nor does the token at
    the start of right, which holds the space that the model puts before a text."""
    at = {(a, b): i for i, (a, b) in enumerate(left) if b > a and a >= shift}
    for k in range(len(right) - 1, -1, -1):
        a, b = right[k]
        if b > a > 0 and (i := at.get((a + shift, b + shift))) is not None and whole(left, i) and whole(right, k):
            return i, k
    return None


def whole(tokens: list[tuple[int, int]], i: int) -> bool:
    """Not one of the byte tokens that share a character."""
    a, b = tokens[i]
    before = tokens[i - 1] if i else (-1, a)
    after = tokens[i + 1] if i + 1 < len(tokens) else (b, b)
    return before[1] <= a and after[0] >= b and before != (a, b) and after != (a, b)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 4096, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for each row of docs (doc_id, text).

    Null text counts as empty: 0 bytes, 0 tokens. A null doc_id stays null, repeated rows give repeated rows, an empty table
    an empty result; other columns are not read.
    """
    path = path or default_path()
    short_batches(docs.sparkSession)
    out = arrow_schema(docs.sparkSession, SCHEMA)

    def run(batches):
        model = load(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            short = [i for i, x in enumerate(texts) if len(x) <= chunk or model.spans is None]
            counts = dict(zip(short, model.counts([texts[i] for i in short])))
            tokens = [counts[i] if i in counts else tokens_of_chunks(model.spans, x, chunk) for i, x in enumerate(texts)]
            sizes = [len(x.encode()) for x in texts]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], schema=out)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
