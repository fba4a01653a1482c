"""Token counts under a unigram model, computed once per shared prefix of the pre-tokens.

Pre-tokens are the words of a text (maximal runs without ASCII white space), each led by the
word-start mark. The distinct unseen ones of a batch are inserted in a trie in sorted order. A
node's forward score is the best total score of pieces that spell the path to it; it depends on
the path alone, so words with a common prefix share it. Insertion in sorted order visits the trie
depth-first, hence only the current branch is held, and the counts at the terminals stay in a
table of at most ``TERMINALS`` words per worker. A document's count is the sum over its words.

Piece scores are ``-ln(rank + RANK_OFFSET)`` (Zipf), rank being the piece's place in the given
public vocabulary; nothing is trained. Ties go to the segmentation with fewer tokens. A character
that no piece covers costs ``UNKNOWN_PENALTY`` more than the rarest piece and counts one token a
UTF-8 byte, as byte fallback spells it.

One pass, no shuffle. Nulls: a null text is empty and has no tokens. Null ids and repeated rows
are returned as they are. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare

WORD_START = "▁"
RANK_OFFSET = 2
UNKNOWN_PENALTY = 10.0
#: Words whose counts a Python worker keeps.
TERMINALS = 1_000_000

_models: dict = {}


def unigram_scores(model_path: str) -> dict[str, float]:
    """Zipf scores of the ordinary pieces of a sentencepiece vocabulary, in its order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return {piece: -math.log(rank + RANK_OFFSET) for rank, piece in enumerate(pieces)}


class PrefixTrie:
    """Forward scores along a trie of words, and token counts at its terminals."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.terminals: dict[str, int] = {}
        self.nodes = 0  # nodes scored so far, each prefix once per batch

    def insert(self, words) -> None:
        """Add the unseen ones of ``words``."""
        if len(self.terminals) > TERMINALS:
            self.terminals.clear()
        scores, longest, unknown = self.scores, self.longest, self.unknown
        branch, score, tokens = "", [0.0], [0]
        for word in sorted(w for w in words if w not in self.terminals):
            text = WORD_START + word
            shared, most = 0, min(len(text), len(branch))
            while shared < most and text[shared] == branch[shared]:
                shared += 1
            del score[shared + 1:], tokens[shared + 1:]
            for end in range(shared + 1, len(text) + 1):
                best, count = -math.inf, 0
                for start in range(max(0, end - longest), end):
                    own = scores.get(text[start:end])
                    if own is not None:
                        total = score[start] + own
                        if total > best or total == best and tokens[start] + 1 < count:
                            best, count = total, tokens[start] + 1
                last = text[end - 1]
                if last not in scores and score[end - 1] + unknown > best:
                    best, count = score[end - 1] + unknown, tokens[end - 1] + len(last.encode())
                score.append(best)
                tokens.append(count)
            self.nodes += len(text) - shared
            self.terminals[word] = tokens[-1]
            branch = text


def _count(model_path: str):
    def run(batches):
        trie = _models.get(model_path) or _models.setdefault(
            model_path, PrefixTrie(unigram_scores(model_path)))
        for batch in batches:
            rows = [(t or "").encode().split() for t in batch.column("_text").to_pylist()]
            rows = [[w.decode() for w in r] for r in rows]
            trie.insert(set().union(*map(set, rows)) if rows else set())
            count = trie.terminals.__getitem__
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(r) for r in rows], pa.int64()),
                 pa.array([sum(map(count, r)) for r in rows], pa.int64())],
                names=["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_pretokens, n_tokens."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return texts.mapInArrow(_count(model_path), f"doc_id {docs.schema[id_col].dataType.simpleString()}, "
                            "n_pretokens long, n_tokens long")
