"""Token counts without tokens: a Viterbi pass that carries the best score and its piece count.

The vocabulary is that of a public piece model: pieces with scores, of which the segmentation with the
highest sum is taken (unigram; sums in double precision, as in the tokenizers library). Aho-Corasick enumerates the pieces that end at each character, longest
first; a later candidate replaces an earlier one only if its sum is strictly higher, which is the rule
of the public tokenizers (earliest start wins a tie). A character that is no piece scores 10 below the
lowest piece and counts a piece for each of its UTF-8 bytes, as with byte fallback. Text gets one space
before it, and spaces count as U+2581.

No piece reaches over the end of a word (this is checked when the vocabulary is read), so sums are
formed word by word, in double precision, and remembered for a bounded number of words.

Defined results: a null or empty text has no pieces and score 0; repeated rows give repeated results;
a text of any length is read whole, word by word; an empty table gives an empty result; other columns
of the input do not matter.
"""

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table
from .textops import slices, text_buffer

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
PENALTY = 10.0
#: Words that a worker remembers, about; then it forgets all.
REMEMBERED = 300_000


def vocabulary(path: str = MODEL) -> list[tuple[str, float]]:
    """Normal pieces and scores of a piece model that has byte pieces and no piece across words."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    if not any(model.is_byte(i) for i in ids):
        raise ValueError(f"{path}: the model has no byte pieces")
    out = [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    for piece, _ in out:
        if SPACE in piece.lstrip(SPACE):
            raise ValueError(f"{path}: piece {piece!r} reaches over the end of a word")
    return out


class Remembered(dict):
    """What a function of a word gave; words of more than 64 characters are not kept."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, word: str):
        got = self.of(word)
        if len(word) <= 64:
            self[word] = got
        return got


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            piece = piece.replace(SPACE, " ")
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in ((p.replace(SPACE, " "), s) for p, s in pieces) if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - PENALTY
        alone = "".join(c for c in "\n\t" if not any(c in p for p, _ in pieces))
        self.word = re.compile(f" +[^ {alone}]*|[^ {alone}]+|[{alone}]" if alone else " +[^ ]*|[^ ]+")
        self.known = Remembered(self.segment)

    def segment(self, word: str) -> tuple[float, int]:
        """Best score and its number of pieces."""
        n = len(word)
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)
        filled = [False] * (n + 1)
        at = 0  # characters whose nodes are complete
        for last, (size, score) in self.automaton.iter(word):
            end = last + 1
            while at < last:
                at += 1
                self._close(word, at, best, count, filled)
            candidate = best[end - size] + score
            if not filled[end] or candidate > best[end]:
                best[end], count[end], filled[end] = candidate, count[end - size] + 1, True
        while at < n:
            at += 1
            self._close(word, at, best, count, filled)
        return best[n], count[n]

    def _close(self, word: str, end: int, best, count, filled) -> None:
        c = word[end - 1]
        if c not in self.single:
            candidate = best[end - 1] + self.unknown
            if not filled[end] or candidate > best[end]:
                best[end], count[end], filled[end] = candidate, count[end - 1] + len(c.encode("utf-8", "surrogatepass")), True

    def text(self, text: str) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found = list(map(self.known.__getitem__, self.word.findall(" " + text.replace(SPACE, " "))))
        return sum([s for s, _ in found]), sum([n for _, n in found])


def counted(pieces):
    def run(batches):
        if not hasattr(pieces, "_counter"):
            pieces._counter = Counter(pieces.value)
        counter = pieces._counter
        for batch in batches:
            _, offsets = text_buffer(batch.column("text"))
            for lo, hi in slices(offsets):
                got = [counter.text(t or "") for t in batch.column("text").slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([n for _, n in got], pa.int64()), pa.array([s for s, _ in got], pa.float64())], names=["doc_id", "n_pieces", "score"])

    return run


def count_tokens(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces and score of each document."""
    pieces = documents.sparkSession.sparkContext.broadcast(vocabulary(model))
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(mapped, counted(pieces), "doc_id long, n_pieces long, score double")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
