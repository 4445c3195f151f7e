"""The merge-type sentencepiece model as tables: pieces, ranks and the units into which a text can be cut before merging.

Inside this package a space stands for the model's word mark U+2581, which keeps most strings one byte a character.
"""

from __future__ import annotations

import re
from functools import lru_cache

WORD_MARK = "▁"
#: A run of spaces with the word after it, spaces at the end, or a line feed. `Pieces` proves that no piece crosses these cuts.
UNITS = re.compile(r" *[^ \n]+| +|\n")


class Pieces:
    """What the operators need of a model file. Raises ValueError for models whose units can't be encoded one by one."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.special = frozenset(special)
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        normal = [i for i in range(n) if i not in special and not sp.is_byte(i)]
        self.text = {i: sp.id_to_piece(i).replace(WORD_MARK, " ") for i in normal}
        self.id = {t: i for i, t in self.text.items()}
        self.rank = {t: -sp.get_score(i) for t, i in self.id.items()}
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        if len(self.byte_id) != 256 or any(" " in t.lstrip(" ") or len(t) > 1 and "\n" in t for t in self.id):
            raise ValueError("pieces cross word or line ends, or bytes are missing")
        if sp.decode(sp.encode(" a  ")) != " a  ":
            raise ValueError("the model changes white space")

    def merged(self, text: str) -> list[str]:
        """Joins, best rank first and leftmost first among equals, neighbours whose concatenation is a piece."""
        parts, rank, none = list(text), self.rank, float("inf")
        joins = [rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while joins and (best := min(joins)) < none:
            i = joins.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joins[i]
            if i < len(joins):
                joins[i] = rank.get(parts[i] + parts[i + 1], none)
            if i:
                joins[i - 1] = rank.get(parts[i - 1] + parts[i], none)
        return parts

    def alone(self) -> list[str]:
        """The pieces that encode, alone, as one token: the others can never come out of merging."""
        return [t for t in self.id if self.merged(t) == [t]]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def marked(text: str) -> str:
    """text as the model's normalizer gives it: a space in front, word marks as spaces."""
    return " " + text.replace(WORD_MARK, " ") if text else ""
