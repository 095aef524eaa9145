"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a batch are put in order, which is the order of a walk through their trie.  The best scores
of all ends within a pre-token (forward scores) depend on what stands before them only, so the walk keeps those of
the path from the root and computes each shared beginning once; at a pre-token's end it stores the token count.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import lean, table, text_slices

SPACE = "▁"
UNKNOWN = -20.0  # log-probability of each byte of a character that no piece has


class Unigram:
    """Pieces of a public vocabulary; the log-probability of the piece with rank r follows Zipf's law, -log((r + 2) H).

    The file's own scores are the order of its merges and no probabilities, and probabilities fitted to a corpus would
    be a trained tokenizer, so the rank is all that is known of a piece; counts are those of this model.
    """

    _held: dict = {}

    def __init__(self, pieces: list[str]):
        total = math.log(sum(1 / (r + 2) for r in range(len(pieces))))
        self.scores = {p: -math.log(r + 2) - total for r, p in reversed(list(enumerate(pieces)))}
        self.longest = max(map(len, pieces), default=1)

    @classmethod
    def of(cls, path: str) -> Unigram:
        if path not in cls._held:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
            cls._held[path] = cls([model.id_to_piece(i) for i in plain])
        return cls._held[path]

    def counts(self, words: list[str]) -> dict[str, int]:
        """Tokens of the best segmentation of each word (most probable, then fewest tokens)."""
        out: dict[str, int] = {}
        scores, longest = self.scores, self.longest
        best, tokens, before = [0.0], [0], ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                width = len(word[end - 1].encode("utf-8", "surrogatepass"))
                top, fewest = best[end - 1] + UNKNOWN * width, tokens[end - 1] + width
                for start in range(max(0, end - longest), end):
                    piece = scores.get(word[start:end])
                    if piece is not None:
                        s, n = best[start] + piece, tokens[start] + 1
                        if s > top or s == top and n < fewest:
                            top, fewest = s, n
                best.append(top)
                tokens.append(fewest)
            out[word] = tokens[-1]
            before = word
        return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])


def _count(path: str):
    def run(batches):
        model = Unigram.of(path)
        for whole in batches:
            for batch in text_slices(whole, 1, 12 << 20):
                words = [(t or "").split() for t in batch.column(1).to_pylist()]
                counts = model.counts([SPACE + w for w in set(chain.from_iterable(words))])
                counts = {w[1:]: n for w, n in counts.items()}
                get = counts.__getitem__
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array([len(w) for w in words], np.int64)), pa.array(np.array([sum(map(get, w)) for w in words], np.int64))], schema=_SCHEMA)

    return run


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` for each row; pre-tokens are what white space separates, each with a leading mark.

    ``vocabulary`` is the path of a piece file that every executor has.  Null and empty texts have no tokens; repeated
    rows each get theirs; other columns aren't read; an empty table gives no rows.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_count(vocabulary)), "doc_id long, n_pretokens long, n_tokens long")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, repeated ones too; null and empty texts have no tokens; an empty table gives no rows."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
