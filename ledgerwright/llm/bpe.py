"""BPE encoding and decoding with a tokenization automaton.

The merge list is compiled, rule by rule, into a deterministic automaton over tokens. It
starts with one state and an arc to it for every token. The gadget of merge ``(u, v)`` of
rank r does two things: from the state that ``u`` leads to it takes the arcs on which ``v``
is still the first piece of the label at rank r; and it gives the new token ``uv`` the state
of ``v`` as it is then, with what has been taken from it so far (later gadgets of ``v`` don't
reach ``uv``, since ``v`` is hidden in it). What is left accepts exactly the token sequences
that BPE makes, so each word has one accepting path.

Equal states are one. The compiled tables are arrays: for each state the first pieces that
it has lost and from which rank on, for each token its first pieces with the rank that
hides them, and the state that each token leads to. An arc is there unless one of the
label's first pieces is among the lost ones in time; judged arcs are memoised.

Encoding runs a pre-split word through the tables: Aho-Corasick gives the tokens that end
at each position, and the transition from the state reached at the token's start decides
which of them is on the path. Decoding emits the labels of the arcs.

Cases: a null text counts as empty and has no tokens; special tokens of the file
are cut out of the text first, as the library does; repeated rows are encoded one
by one; extra columns are not carried.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from bisect import bisect_left
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Memo, chunks

#: The byte-level split pattern of the public vocabularies (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Below it the regex module and the tokenizers library class all characters alike.
_LATER = regex.compile("[\u0500-\U0010ffff]")
#: Words and judged arcs kept in a worker's memo.
MEMO_WORDS, MEMO_ARCS = 400_000, 1_000_000
_NEVER = 2**31 - 1


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


def exact_split() -> regex.Pattern:
    """SPLIT with the letters and digits that the tokenizers library knows.

    The two libraries follow different versions of Unicode: characters that are new
    to the older table of Python's own library are asked of the tokenizers library.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    ask = ByteLevel(add_prefix_space=False).pre_tokenize_str
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    other = {}
    for kind, sample in (("L", "a"), ("N", "1")):
        new = (c for c in regex.findall(rf"\p{{{kind}}}", every) if unicodedata.category(c) == "Cn")
        other[kind] = "".join(regex.escape(c) for c in new if len(ask(sample + c)) > 1)
    letter, digit = (rf"[\p{{{k}}}--[{x}]]" if x else rf"\p{{{k}}}" for k, x in other.items())
    rest = f"{other['L']}{other['N']}"
    rest = rf"[[^\s\p{{L}}\p{{N}}]||[{rest}]]" if rest else r"[^\s\p{L}\p{N}]"
    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{digit}+| ?{rest}+|\s+(?!\S)|\s+", regex.V1)


def read_vocabulary(path: str) -> tuple[dict[str, int], dict[str, bytes], list[tuple[str, str]], dict[str, int]]:
    """Ids by token, bytes by token, merges in order, and special tokens with their ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, letters = spec["model"]["vocab"], byte_letters()
    raw = {t: bytes(letters[c] for c in t) for t in vocab if all(c in letters for c in t)}
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
    return vocab, raw, merges, {t["content"]: t["id"] for t in spec.get("added_tokens") or []}


class Tables:
    """The automaton of a merge list (left, right and made token, in the order of ranks) over ``size`` tokens.

    ``state`` of each token; ``lost`` pieces and their ``rank`` of state s at
    ``start[s]:start[s + 1]``, sorted; first ``piece`` and rank that has it ``hidden`` of
    token t at ``first[t]:first[t + 1]``. State 0 has lost nothing and begins a word.
    """

    def __init__(self, merges: list[tuple[int, int, int]], size: int):
        rows: list[dict[int, int]] = [{} for _ in range(size)]
        left: dict[int, tuple[int, int]] = {}
        for rank, (u, v, made) in enumerate(merges):
            if made in left:
                raise ValueError(f"token {made} is made by two merges; the automaton needs one merge per token")
            rows[made] = dict(rows[v])
            rows[u][v] = rank
            left[made] = (u, rank)
        numbers: dict[tuple, int] = {(): 0}
        self.state = array("i", (numbers.setdefault(tuple(sorted(row.items())), len(numbers)) for row in rows))
        self.start, self.lost, self.rank = array("i", [0]), array("i"), array("i")
        for row in numbers:
            self.lost.extend(k for k, _ in row)
            self.rank.extend(r for _, r in row)
            self.start.append(len(self.lost))
        self.first, self.piece, self.hidden = array("i", [0]), array("i"), array("i")
        for token in range(size):
            until = _NEVER
            while True:
                self.piece.append(token)
                self.hidden.append(until)
                if token not in left:
                    break
                token, until = left[token]
            self.first.append(len(self.piece))

    def step(self, key: int) -> int:
        """The state that the arc from state ``key >> 20`` labelled ``key & 0xFFFFF`` leads to, -1 for no arc."""
        state, token = key >> 20, key & 0xFFFFF
        low, high = self.start[state], self.start[state + 1]
        if low < high:
            for k in range(self.first[token], self.first[token + 1]):
                at = bisect_left(self.lost, self.piece[k], low, high)
                if at < high and self.lost[at] == self.piece[k] and self.rank[at] <= self.hidden[k]:
                    return -1
        return self.state[token]


class BpeAutomaton:
    def __init__(self, path: str):
        vocab, raw, merges, self.special = read_vocabulary(path)
        self.labels = {vocab[t]: b for t, b in raw.items()}
        self.labels.update({i: t.encode() for t, i in self.special.items()})
        self.tables = Tables([(vocab[u], vocab[v], vocab[u + v]) for u, v in merges], max(vocab.values()) + 1)
        self._scan = ahocorasick.Automaton()
        for t, b in raw.items():
            self._scan.add_word(b.decode("latin-1"), (vocab[t], len(b)))
        self._scan.make_automaton()
        self._arcs = Memo(self.tables.step, MEMO_ARCS)
        self._split, self._exact = regex.compile(SPLIT).findall, None
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = Memo(self._word, MEMO_WORDS)

    def _word(self, word: str) -> tuple[int, ...]:
        data = word.encode("utf-8").decode("latin-1")
        arcs, n = self._arcs, len(data)
        states, last, size = [0] + [-1] * n, [0] * (n + 1), [0] * (n + 1)
        for end, (token, length) in self._scan.iter(data):
            end += 1
            if states[end] < 0:
                state = states[end - length]
                if state >= 0 and (to := arcs[state << 20 | token]) >= 0:
                    states[end], last[end], size[end] = to, token, length
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= size[at]
        return tuple(reversed(ids))

    def split(self, text: str) -> list[str]:
        if text.isascii() or not _LATER.search(text):
            return self._split(text)
        if self._exact is None:
            self._exact = exact_split().findall
        return self._exact(text)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self._cut is None or not any(s in text for s in self.special):
            return [*chain.from_iterable(map(self.words.__getitem__, self.split(text)))]
        ids: list[int] = []
        for part in self._cut.split(text):
            if part in self.special:
                ids.append(self.special[part])
            else:
                ids.extend(chain.from_iterable(map(self.words.__getitem__, self.split(part))))
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def automaton(path: str) -> BpeAutomaton:
    """One automaton for each worker process and vocabulary file."""
    return BpeAutomaton(path)


class RankEncoder:
    """The same ids as an array, for callers that need no automaton: merges by rank in compiled code.

    It serves vocabularies whose ids rise with the merges' ranks; other files, texts with
    a special token and texts with very long runs of white space go to the automaton.
    """

    def __init__(self, path: str):
        import tiktoken

        vocab, raw, merges, special = read_vocabulary(path)
        made = [vocab[u + v] for u, v in merges]
        rising = all(x < y for x, y in zip(made, made[1:], strict=False))
        ranks = {b: vocab[t] for t, b in raw.items() if t not in special}
        self.path, self._special = path, tuple(special)
        self._fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if rising else None
        self._runs = regex.compile(r"\s{1000}")

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if self._fast is None or any(s in text for s in self._special) or len(text) >= 1000 and self._runs.search(text):
            return np.array(automaton(self.path).encode(text), "<u4")
        return self._fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


@lru_cache(maxsize=2)
def rank_encoder(path: str) -> RankEncoder:
    return RankEncoder(path)


def bpe_round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` array<int> of every whole text, and ``decoded``, the text spelled by those ids."""

    def run(batches):
        bpe = automaton(path)
        for batch in chunks(batches, 200):
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())],
                names=[id_col, "ids", "decoded"],
            )

    schema = T.StructType([df.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``, the text that the ids of ``ids_col`` spell; null ids give null."""
    from pyspark.sql import functions as F

    @F.pandas_udf(T.StringType())
    def spell(col):
        bpe = automaton(path)
        return col.map(lambda x: None if x is None else bpe.decode(x))

    return df.withColumn(out_col, spell(ids_col))
