"""Token counts under a unigram vocabulary, by a shared trie.

A text's pre-tokens are its words between white space, each with a leading
word mark. The best segmentation of a pre-token into vocabulary pieces has
the largest sum of piece scores (then the fewest pieces); characters that no
piece covers fall back to one token for each of their UTF-8 bytes.

Distinct pre-tokens are inserted in a trie in sorted order: the forward
scores of a shared prefix are computed once, and stay while the words below
it are passed. Each pre-token's count is stored where it ends, and a text's
count is the sum over its pre-tokens. A task keeps the counts of up to
``HELD`` pre-tokens; more only means that some are computed again.

The vocabulary is a file of pieces (its path is a parameter); a piece of
rank r has the log probability -log(r + 2), rounded to integers of 1e-6, so
that sums are exact.

Defined results: null, empty and blank texts have no pre-tokens and no
tokens; repeated rows count alike; words of any length are segmented whole;
an empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faresight.llm.common import map_arrow, table
from faresight.llm.words import Words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
HELD = 400_000

#: White space ends words; letters keep their case.
_CASED = np.arange(256, dtype=np.uint8)
_CASED[[0x20, 9, 10, 11, 12, 13]] = 0
_CASED[0] = 0xFF          # occurs in no UTF-8 text; stands for the zero byte


def load_vocabulary(path: str = VOCABULARY) -> dict[str, int]:
    """Piece -> score. Control and byte pieces are left out: bytes are only
    the fall-back."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            out.setdefault(model.id_to_piece(i), -round(1e6 * math.log(len(out) + 2)))
    return out


class Trie:
    """Forward scores along the current path of the trie of pre-tokens."""

    def __init__(self, pieces: dict[str, int]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        #: a byte is a little worse than the worst piece
        self.byte = min(pieces.values(), default=0) - 10_000_000
        self.lasts: dict[str, list[int]] = {}   # lengths of the pieces that end in a character
        for p in pieces:
            self.lasts.setdefault(p[-1], []).append(len(p))
        self.lasts = {c: sorted(set(n)) for c, n in self.lasts.items()}

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of each word, words in sorted order."""
        pieces, lasts, byte = self.pieces, self.lasts, self.byte
        score, tokens, before, out = [0], [0], "", []
        for word in words:
            word = MARK + word
            shared, most = 0, min(len(before), len(word))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del score[shared + 1:], tokens[shared + 1:]
            for j in range(shared + 1, len(word) + 1):
                c = word[j - 1]
                n = len(c.encode("utf-8", "replace"))
                if c in pieces:
                    best, few = -1 << 60, 0
                else:
                    best, few = score[j - 1] + n * byte, tokens[j - 1] + n
                for size in lasts.get(c, ()):
                    if size > j:
                        break
                    s = pieces.get(word[j - size:j])
                    if s is not None:
                        s += score[j - size]
                        t = tokens[j - size] + 1
                        if s > best or s == best and t < few:
                            best, few = s, t
                score.append(best)
                tokens.append(few)
            out.append(tokens[-1])
            before = word
        return out


def count_tokens(docs: DataFrame, vocabulary: dict[str, int], doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    state: dict = {}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.update(trie=Trie(held.value), keys=np.zeros(0, np.uint64), counts=np.zeros(0, np.int64))
        w = Words(b.column(1), _CASED)
        keys, first, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
        known, counts = state["keys"], state["counts"]
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        old = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        own = np.zeros(len(keys), np.int64)
        own[old] = counts[at[old]]
        fresh = np.flatnonzero(~old)
        words = [w.word(first[i]).replace(b"\xff", b"\0").decode("utf-8", "replace") for i in fresh]
        order = sorted(range(len(words)), key=words.__getitem__)
        got = state["trie"].counts([words[i] for i in order])
        own[fresh[order]] = got
        if len(known) + len(fresh) > HELD:
            state["keys"], state["counts"] = keys, own
        elif len(fresh):
            both = np.concatenate([known, keys[fresh]])
            by = np.argsort(both, kind="stable")
            state["keys"], state["counts"] = both[by], np.concatenate([counts, own[fresh]])[by]
        total = np.zeros(len(w) + 1, np.int64)
        np.cumsum(own[inverse] if len(w) else own, out=total[1:])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(w.counts()),
                                           pa.array(total[w.first[1:]] - total[w.first[:-1]])],
                                          ["doc_id", "n_pretokens", "n_tokens"])

    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run,
                     f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_pretokens long, n_tokens long")


def op8_token_counts(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), load_vocabulary(vocabulary))
