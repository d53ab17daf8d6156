"""Op 7: how many tokens a unigram tokenizer makes of each text, without making them.

An Aho-Corasick automaton lists all vocabulary matches of a word; a dynamic programme over their ends carries the best
score and its number of pieces. Words are those of a blank-splitting pre-tokenizer, each distinct one is counted once per worker.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm import arrays as A
from textloom.llm.common import keyed_texts

BLANK = "▁"
# A character that no piece covers scores this much below the lowest piece.
UNKNOWN_PENALTY = 10.0
# Counted words that a worker remembers before it starts afresh.
REMEMBERED = 500_000

Vocabulary = Sequence[tuple[str, float]]


class UnigramCounter:
    """Piece counts of words under ``(piece, score)`` pairs.

    The best segmentation has the highest sum of scores, added from the left; of equal sums at a place, the piece that starts
    earliest wins. An uncovered character costs the lowest score less ``UNKNOWN_PENALTY``. If ``byte_pieces``, such a
    character counts one piece per UTF-8 byte; else a run of them counts one.
    """

    def __init__(self, vocabulary: Vocabulary, byte_pieces: bool = True):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        self._empty = len(self._automaton) == 0
        self._unknown = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self._byte_pieces = byte_pieces
        self._known: dict[str, int] = {}

    def word(self, word: str) -> int:
        size = len(word)
        best, count, loose = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        matches = iter(()) if self._empty else self._automaton.iter(word)
        ahead = next(matches, None)
        for end in range(1, size + 1):
            score, pieces, unknown, single = None, 0, False, False
            while ahead is not None and ahead[0] == end - 1:  # longest match first, so earliest start first
                length, own = ahead[1]
                start = end - length
                candidate = best[start] + own
                if score is None or candidate > score:
                    score, pieces = candidate, count[start] + 1
                single = single or length == 1
                ahead = next(matches, None)
            if not single:
                candidate = best[end - 1] + self._unknown
                if score is None or candidate > score:
                    score, unknown = candidate, True
                    if self._byte_pieces:
                        pieces = count[end - 1] + len(word[end - 1].encode())
                    else:
                        pieces = count[end - 1] + (not loose[end - 1])
            best[end], count[end], loose[end] = score, pieces, unknown
        return count[size]

    def text(self, text: str) -> int:
        """Pieces of a whole text: blanks become ``BLANK``, one is put before a text without, and every one starts a word."""
        if not text:
            return 0
        words = text.replace(BLANK, " ").split(" ")
        if not words[0]:
            del words[0]
        known = self._known
        try:
            return sum([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        total = 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = known[w] = self.word(BLANK + w)
            total += n
        return total


def piece_vocabulary(model_file: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a SentencePiece model with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ordinary = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in ordinary]


def count_tokens(documents: DataFrame, vocabulary: Vocabulary, byte_pieces: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, n_bytes. Null and empty texts have none; repeated and null keys keep their rows; other columns are ignored.

    Nothing is shuffled; the vocabulary, whose size the caller knows, is broadcast.
    """
    rows = keyed_texts(documents, key, text)
    shared = documents.sparkSession.sparkContext.broadcast(list(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(shared.value, byte_pieces)
        for part, _, bounds in A.blocks(batches):
            counts = [counter.text(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(counts, pa.int64()), pa.array(bounds[1:] - bounds[:-1])], names=["key", "n_tokens", "n_bytes"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(count, f"key {kind}, n_tokens bigint, n_bytes bigint").withColumnRenamed("key", key)
