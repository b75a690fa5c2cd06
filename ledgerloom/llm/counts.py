"""Token counts under a unigram vocabulary, without making the tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import Column, functions as F

SPACE = "▁"
#: What an unknown character costs below the worst piece. Fixed value of the tokenizer.
UNKNOWN = 10.0


class PieceCounts(dict):
    """(best score, pieces) of a stretch of text; remembers a bounded number of them.

    An Aho-Corasick automaton names all pieces that end at a character, the longest
    first. The best path to each character carries its score and its number of
    pieces. As in the tokenizer, a path must be better, not equal, to replace one
    that starts earlier; a character that is no piece may stand for itself at the
    cost of an unknown, and counts as its bytes if the vocabulary has bytes.
    """

    LIMIT = 1 << 19

    def __init__(self, pieces: dict[str, float], by_bytes: bool) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN
        self.by_bytes = by_bytes
        # No piece runs from another character into a space, nor holds a character outside
        # ``inner`` beside others: between such, a text can be cut without changing a path.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        inner = "".join(sorted({c for p in pieces if len(p) > 1 for c in p} - {SPACE}))
        self.stretch = re.compile(
            rf"{SPACE}*[{re.escape(inner)}]+|{SPACE}+|[^{re.escape(inner)}{SPACE}]" if inner else rf"{SPACE}+|[^{SPACE}]", re.S)

    @classmethod
    def of_model(cls, path: str) -> PieceCounts:
        """The plain pieces of a sentencepiece model file and their scores."""
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(m.get_piece_size())
                 if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        return cls({m.id_to_piece(i): m.get_score(i) for i in plain},
                   any(m.is_byte(i) for i in range(m.get_piece_size())))

    def __missing__(self, text: str) -> tuple[float, int]:
        best = [(0.0, 0)] + [(0.0, -1)] * len(text)
        ends: list[list] = [[] for _ in text]
        for end, match in self.automaton.iter(text) if len(self.automaton) else ():
            ends[end].append(match)
        for end, char in enumerate(text):
            top, pieces = None, 0
            for size, score in sorted(ends[end], reverse=True):
                before, n = best[end + 1 - size]
                if top is None or before + score > top:
                    top, pieces = before + score, n + 1
            if char not in self.single:
                before, n = best[end]
                if top is None or before + self.unknown > top:
                    top = before + self.unknown
                    pieces = n + (len(char.encode("utf-8", "surrogatepass")) if self.by_bytes else 1)
            best[end + 1] = (top, pieces)
        if len(self) >= self.LIMIT:
            self.clear()
        self[text] = best[-1]
        return best[-1]

    def text(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        text = SPACE + text.replace(" ", SPACE)
        if not self.cuts:
            return self.__missing__(text)
        score, pieces = 0.0, 0
        for s, n in map(self.__getitem__, self.stretch.findall(text)):
            score += s
            pieces += n
        return score, pieces


def token_counts(text: Column, model: str) -> Column:
    """Struct of n_tokens and score of a text's best segmentation.

    ``model`` is the path of a sentencepiece model, present on every worker; its
    plain pieces and scores are taken as a unigram vocabulary, with the space mark
    before the text. Null and empty texts have no tokens and score 0. Whole texts
    are scored; equal texts give equal counts.
    """
    @F.pandas_udf("n_tokens bigint, score double")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counts = PieceCounts.of_model(model)
        for texts in batches:
            got = [counts.text(t) for t in texts]
            yield pd.DataFrame({"n_tokens": [n for _, n in got], "score": [s for s, _ in got]}).astype(
                {"n_tokens": "int64", "score": "float64"})

    return count(text)
