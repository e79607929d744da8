"""Count-only unigram tokenization: the number of pieces of the best segmentation, without the pieces.

An Aho-Corasick automaton finds the vocabulary's pieces in a word; dynamic programming over end positions carries
the best score and its piece count. Ties and unknown characters follow the unigram model of the `tokenizers` library:
a candidate replaces an earlier one only with a higher score, and those from earlier starts come first, so of
equal scores the longest last piece stays; a character that is no piece of its own can be unknown at the lowest
score minus 10; neighbouring unknowns count as one piece. Words are cut at white space and get the mark U+2581 in
front, unless they begin with it. Every distinct word is segmented once per task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Remember

MARK = "\u2581"
UNKNOWN_PENALTY = 10.0
NO_MERGE = -1e8


def vocabulary(model_path: str, offset: float = 10.0) -> dict[str, float]:
    """Pieces of a sentencepiece merge model with unigram log probabilities, without control, unknown and byte pieces.

    Such a file has no probabilities: a piece's score is minus the rank of its merge, or -1e9 for pieces that no merge
    makes. Merges are ranked by frequency, so a piece's probability follows from its rank by the law of Zipf and
    Mandelbrot, 1 / (rank + offset), over their sum; pieces without a merge come after all others. Nothing is trained.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not special(i)}
    rank = {piece: -score if score > NO_MERGE else len(scores) for piece, score in scores.items()}
    whole = math.log(sum(1 / (r + offset) for r in rank.values()))
    return {piece: -math.log(r + offset) - whole for piece, r in rank.items()}


class Viterbi:
    def __init__(self, scores: dict[str, float]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        if scores:
            self.automaton.make_automaton()
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY

    def __call__(self, word: str) -> tuple[float, int]:
        """(score, pieces) of the best segmentation."""
        n = len(word)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        if len(self.automaton):
            for end, match in self.automaton.iter(word):
                ending[end + 1].append(match)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            best = None
            for length, s in sorted(ending[end], reverse=True):  # earlier starts first
                start = end - length
                if best is None or s + score[start] > best:
                    best, count[end] = s + score[start], count[start] + 1
            if word[end - 1] not in self.single and (best is None or self.unknown + score[end - 1] > best):
                best, unknown[end] = self.unknown + score[end - 1], True
                count[end] = count[end - 1] + (not unknown[end - 1])
            score[end] = best
        return score[n], count[n]


def count_tokens(docs: DataFrame, scores: dict[str, float], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with n_words, n_tokens (long) and score (double: the sum of the words' best scores).

    Null and empty texts have none. Repeated rows each get their row. Very long words are segmented whole, in
    memory proportional to their length.
    """
    base = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = base.drop("_text").schema.add("n_words", "long").add("n_tokens", "long").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        viterbi = Viterbi(scores)
        known = Remember(lambda w: viterbi(w if w[0] == MARK else MARK + w))
        for batch in batches:
            words, tokens, total = [], [], []
            for text in batch.column(batch.num_columns - 1):
                own = (text.as_py() or "").split()
                found = [known[w] for w in own]
                words.append(len(own))
                tokens.append(sum(c for _, c in found))
                total.append(float(sum(s for s, _ in found)))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(total, pa.float64())], schema.names)

    return base.mapInArrow(run, schema)
