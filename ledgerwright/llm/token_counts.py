"""Token counts under a unigram vocabulary: Viterbi that carries counts only.

The vocabulary's pieces and scores come from a file. An Aho-Corasick automaton
enumerates the pieces that end at each position of a word; for each position the
programme keeps the best score and the number of pieces of the path that has it, and
no back pointers. Ties go as in the public tokenizers: candidates for a position are
tried from the earliest start on and replace the kept one only if strictly better.
A character that no piece spells alone costs ten less than the lowest score; it
counts as its UTF-8 bytes where the vocabulary has byte pieces, and otherwise a run of
such characters counts once.

Texts are cut as by a metaspace pre-tokenizer: one space mark in front, every space a
mark, a word at each mark.

Cases: null and empty texts have 0 tokens; repeated rows are counted one by one;
extra columns are not carried.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Memo, chunks

MARK = "▁"
#: Words kept in a worker's memo.
MEMO_WORDS = 500_000


def unigram_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """The normal pieces with their scores, and whether all 256 byte pieces are there."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return plain, sum(sp.is_byte(i) for i in range(n)) == 256


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool):
        self.byte_pieces = byte_pieces
        self.unknown = min((s for _, s in pieces), default=0.0) - 10.0
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.scan = ahocorasick.Automaton()
        for piece, score in pieces:
            self.scan.add_word(piece, (len(piece), score))
        if pieces:
            self.scan.make_automaton()
        self.words = Memo(lambda rest: self.count_word(MARK + rest), MEMO_WORDS)

    def count_word(self, word: str) -> int:
        n = len(word)
        score: list = [0.0] + [None] * n
        count = [0] * (n + 1)
        if self.single.issuperset(word):
            for end, (length, s) in self.scan.iter(word):
                end += 1
                s += score[end - length]
                if score[end] is None or s > score[end]:
                    score[end], count[end] = s, count[end - length] + 1
            return count[n]
        found: list[list] = [[] for _ in range(n + 1)]
        for end, match in self.scan.iter(word) if len(self.scan) else ():
            found[end + 1].append(match)
        unknown = [False] * (n + 1)  # whether the best path ends in unknown characters
        for end in range(1, n + 1):
            for length, s in found[end]:
                s += score[end - length]
                if score[end] is None or s > score[end]:
                    score[end], count[end] = s, count[end - length] + 1
            ch = word[end - 1]
            if ch not in self.single:
                s = score[end - 1] + self.unknown
                if score[end] is None or s > score[end]:
                    more = len(ch.encode()) if self.byte_pieces else int(not unknown[end - 1])
                    score[end], count[end], unknown[end] = s, count[end - 1] + more, True
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        parts = (text if text[0] == MARK else MARK + text).split(MARK)
        del parts[0]
        return sum(map(self.words.__getitem__, parts))


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(*unigram_vocabulary(path))


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens`` long and ``n_words`` long (pre-split words) of every whole text."""

    def run(batches):
        unigram = counter(path)
        for batch in chunks(batches, 1000):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([unigram.count(t) for t in texts], pa.int64()), pa.array([t.count(" ") + (t[0] != " ") if t else 0 for t in texts], pa.int64())],
                names=[id_col, "n_tokens", "n_words"],
            )

    schema = T.StructType([df.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("n_words", T.LongType())])
    return df.select(id_col, text_col).mapInArrow(run, schema)
