"""Operator 6, token counts: unigram segmentation of distinct pre-tokens over a shared trie.

A pre-token is a word with the vocabulary's word mark in front. Its best segmentation is the one
with the largest sum of piece scores; a character that no piece covers falls back to one token for
each of its UTF-8 bytes. The forward score of a prefix depends on that prefix alone, so pre-tokens
that share a prefix share its scores: distinct pre-tokens are put in a trie, a walk of the trie
computes one forward state for each of its nodes, and the state at a word's last node is stored as
that word's count. Ties go to fewer tokens, then to the longer last piece.

The vocabulary is a file named by a parameter. A BPE vocabulary has merge ranks instead of
log-probabilities; by Zipf's law the score of the piece of rank r is -ln(r + 2). The driver reads the
pieces (a fixed list, whatever the corpus) and sends them to the tasks.

Scale: no shuffle. Each task keeps the counts of the words it has seen (at most ``REMEMBERED``; then
it starts anew, which changes no result), so a word is segmented once per task, not once per
occurrence. Texts are counted whole; memory is a batch and the words remembered.

Defined cases: null and empty texts have no words and no tokens; a null id stays null; repeated
rows each get their own row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
REMEMBERED = 1_000_000
BYTE_SCORE = -math.log(1e6)


def read_scores(path: str = VOCABULARY) -> dict[str, float]:
    """Piece -> score of a sentencepiece file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i): -math.log(2 - model.get_score(i)) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


class Trie:
    """Trie of pre-tokens walked in sorted order, so only the states on the path to the last word
    are kept: ``state[i]`` is (score, tokens) of the first i characters."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.ends = {piece[i:] for piece in scores for i in range(len(piece))}   # what a piece may end with
        self.nodes = 0

    def step(self, word: str, i: int, state: list[tuple[float, int]]) -> tuple[float, int]:
        """The state of the node for ``word[:i]``, given those above it."""
        scores, ends = self.scores, self.ends
        n = len(word[i - 1].encode("utf-8", "surrogatepass"))
        score, tokens = state[i - 1]
        best = (score + n * BYTE_SCORE, tokens + n)
        for j in range(i - 1, -1, -1):
            piece = word[j:i]
            if piece not in ends:
                break
            own = scores.get(piece)
            if own is not None:
                score, tokens = state[j][0] + own, state[j][1] + 1
                if score > best[0] or (score == best[0] and tokens <= best[1]):
                    best = (score, tokens)
        self.nodes += 1
        return best

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """Tokens of each distinct word."""
        out, state, last = {}, [(0.0, 0)], ""
        for word in sorted(set(words)):
            shared = 0
            for x, y in zip(word, last):
                if x != y:
                    break
                shared += 1
            del state[shared + 1:]
            for i in range(shared + 1, len(word) + 1):
                state.append(self.step(word, i, state))
            out[word], last = state[-1][1], word
        return out


def counter(scores: dict[str, float], remembered: int = REMEMBERED):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = Trie(scores), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                # bytes.split() parts words at ASCII white space alone
                texts = [(t.as_py() or "").encode("utf-8", "surrogatepass").split() for t in part.column(1)]
                new = {w for ws in texts for w in ws if w not in known}
                if len(known) + len(new) > remembered:
                    known, new = {}, {w for ws in texts for w in ws}
                marked = {w: MARK + w.decode("utf-8", "surrogatepass") for w in new}
                tokens = trie.counts(marked.values())
                known.update((w, tokens[m]) for w, m in marked.items())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(ws) for ws in texts], pa.int64()),
                    pa.array([sum(map(known.__getitem__, ws)) for ws in texts], pa.int64())], ["doc_id", "n_words", "n_tokens"])
    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
                 remembered: int = REMEMBERED) -> DataFrame:
    """id, n_words and n_tokens of every document's whole text."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(counter(read_scores(vocabulary), remembered), f"doc_id {kind}, n_words long, n_tokens long")
