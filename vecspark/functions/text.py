"""Text cleaning and tokenising: cleaners as column expressions, tokenisers behind Arrow."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.schema import ConfigParseFailed

#: Words whose tokens a worker keeps, and their longest; junk has words of thousands of letters.
KNOWN_WORDS = 200_000
KNOWN_LENGTH = 40
CLIP_BOS, CLIP_EOS, CLIP_LENGTH = 49406, 49407, 77
CLIP_PIECES = r"<\|startoftext\|>|<\|endoftext\|>|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip_clean(text: Column | str) -> Column:
    """Lower-cased text of only ASCII letters, digits and blanks."""
    return F.lower(F.regexp_replace(_c(text), "[^A-Za-z0-9 ]", ""))


def clip_pieces(text: Column | str) -> Column:
    """The pieces that byte-pair merging works on."""
    return F.regexp_extract_all(_c(text), F.lit(CLIP_PIECES), F.lit(0))


def clip_frame(ids: Column | str, length: int = CLIP_LENGTH) -> Column:
    """Start, tokens, end, cut to a length (the end may go) and filled with zeros."""
    whole = F.slice(F.concat(F.array(F.lit(CLIP_BOS)), _c(ids), F.array(F.lit(CLIP_EOS))), 1, length)
    return F.concat(whole, F.array_repeat(F.lit(0), F.lit(length) - F.size(whole)))


def minilm_clean(text: Column | str, lower: bool = True) -> Column:
    """Blanks around punctuation, white space collapsed, ends trimmed."""
    t = F.lower(_c(text)) if lower else _c(text)
    t = F.regexp_replace(t, r"""([.,!?;:()"'])""", " $1 ")
    return F.regexp_replace(F.regexp_replace(t, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"\s+", " ")


def minilm_frame(ids: Column | str, cls: int, sep: int, length: int = 128) -> tuple[Column, Column]:
    """(ids, mask) cut or filled to a length; cutting drops the end mark."""
    whole = F.slice(F.concat(F.array(F.lit(cls)), _c(ids), F.array(F.lit(sep))), 1, length)
    rest = F.lit(length) - F.size(whole)
    return F.concat(whole, F.array_repeat(F.lit(0), rest)), F.concat(F.transform(whole, lambda x: F.lit(1)), F.array_repeat(F.lit(0), rest))


@dataclass(frozen=True)
class MiniLmConfig:
    lower: bool = True
    unk: str = "[UNK]"
    cls: str = "[CLS]"
    sep: str = "[SEP]"

    @classmethod
    def parse(cls, text: str) -> MiniLmConfig:
        """From JSON in which every key may be missing."""
        try:
            d = json.loads(text)
        except json.JSONDecodeError as e:
            raise ConfigParseFailed(str(e)) from e
        base = cls()
        return cls(d.get("do_lower_case", base.lower), d.get("unk_token", base.unk), d.get("cls_token", base.cls), d.get("sep_token", base.sep))


def read_vocab(path: str) -> dict[str, int]:
    """A line each, numbered from 0; or a JSON object of numbers."""
    text = Path(path).read_text(encoding="utf-8")
    return json.loads(text) if text.lstrip().startswith("{") else {w: i for i, w in enumerate(text.splitlines())}


def clip_vocab(path: str) -> dict[str, int]:
    """A JSON vocabulary in which the mark of a word's end reads as a blank."""
    return {k.replace("</w>", " "): v for k, v in json.loads(Path(path).read_text(encoding="utf-8")).items()}


def clip_merges(path: str) -> dict[tuple[str, str], int]:
    """Pairs and their ranks, from a file with one header line."""
    out: dict[tuple[str, str], int] = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines()[1:]:
        pair = line.split()
        if len(pair) == 2:
            out[pair[0].replace("</w>", " "), pair[1].replace("</w>", " ")] = len(out)
    return out


def clip_from_json(path: str) -> tuple[dict[str, int], dict[tuple[str, str], int]]:
    """Vocabulary and ranks from one tokenizer file that holds both."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    blank = lambda t: t.replace("</w>", " ")
    return {blank(k): v for k, v in model["vocab"].items()}, {(blank(a), blank(b)): i for i, (a, b) in enumerate(model["merges"])}


def _keep(known: dict[str, list[int]], word: str, ids: list[int]) -> None:
    if len(word) <= KNOWN_LENGTH:
        if len(known) >= KNOWN_WORDS:
            known.clear()
        known[word] = ids


class WordPiece:
    """Greedy longest match; where nothing matches, the unknown mark follows the pieces so far and ends the word."""

    def __init__(self, vocab: dict[str, int], config: MiniLmConfig | None = None):
        self.vocab, self.config = vocab, config or MiniLmConfig()
        self.longest = max(map(len, vocab), default=0)
        self._known: dict[str, list[int]] = {}

    def word(self, word: str) -> list[str]:
        out, start = [], 0
        while start < len(word):
            head = "##" if start else ""
            for end in range(min(len(word), start + self.longest), start, -1):
                if head + word[start:end] in self.vocab:
                    out.append(head + word[start:end])
                    start = end
                    break
            else:
                out.append(self.config.unk)
                break
        return out

    def tokens(self, clean: str) -> list[str]:
        return [t for w in clean.split(" ") for t in self.word(w)]

    def ids(self, clean: str) -> list[int]:
        out: list[int] = []
        for w in clean.split(" "):
            own = self._known.get(w)
            if own is None:
                unk = self.vocab.get(self.config.unk, 0)
                own = [self.vocab.get(t, unk) for t in self.word(w)]
                _keep(self._known, w, own)
            out += own
        return out


class ClipBpe:
    """Byte-pair merging of cleaned text; each piece's last character carries a blank."""

    def __init__(self, vocab: dict[str, int], ranks: dict[tuple[str, str], int]):
        self.vocab, self.ranks = vocab, ranks
        self._known: dict[str, list[int]] = {}
        self._pieces = regex.compile(CLIP_PIECES)

    def merge(self, piece: str) -> list[str]:
        if len(piece) <= 1:
            return [f"{piece} "]
        word = [*piece[:-1], f"{piece[-1]} "]
        none = len(self.ranks)
        ranks = [self.ranks.get(p, none) for p in pairwise(word)]
        while ranks and (best := min(ranks)) < none:
            i = 0
            while i < len(ranks):  # a rank names one pair: all its places, from left to right
                if ranks[i] == best:
                    word[i : i + 2] = [word[i] + word[i + 1]]
                    del ranks[i]
                    if i:
                        ranks[i - 1] = self.ranks.get((word[i - 1], word[i]), none)
                    if i < len(ranks):
                        ranks[i] = self.ranks.get((word[i], word[i + 1]), none)
                i += 1
        return word

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for chunk in text.split():  # no piece holds white space
            own = self._known.get(chunk)
            if own is None:
                own = [self.vocab[t] for p in self._pieces.findall(chunk) for t in self.merge(p)]
                _keep(self._known, chunk, own)
            out += own
        return out


def tokenized(df: DataFrame, tokenizer: WordPiece | ClipBpe, text: str, into: str = "ids") -> DataFrame:
    """df with the token ids of a column of cleaned text; the tokenizer goes out once, by broadcast."""
    sent = df.sparkSession.sparkContext.broadcast(tokenizer)

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for part in parts:
            yield part.fillna("").map(lambda x: np.array(own.ids(x), np.int32))

    return df.withColumn(into, ids(F.col(text)))


def characters(config: str) -> list[str]:
    """The character list under PostProcess / character_dict of a recognition config; a blank is added at the end."""
    out: list[str] = []
    inside, at = False, None
    section = False
    for line in config.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        text = line.strip()
        if depth == 0 and not text.startswith("- "):
            section, inside = text.startswith("PostProcess:"), False
            continue
        if section and not inside and text.startswith("character_dict:"):
            inside, at = True, depth
            continue
        if inside:
            if not (text == "-" or text.startswith("- ")) or (at is not None and depth < at):
                break
            out.append(_scalar(line.lstrip()[1:].removeprefix(" ")))
    if not out:
        raise ConfigParseFailed("no character_dict under PostProcess")
    return out if out[-1] == " " else [*out, " "]


def _scalar(text: str) -> str:
    s = text.strip()
    if len(s) >= 2 and s[0] == s[-1] == "'":
        return s[1:-1].replace("''", "'")
    if len(s) >= 2 and s[0] == s[-1] == '"':
        return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), s[1:-1])
    return s if s else text


def ctc_decode(probs: DataFrame, alphabet: list[str], blank: int = 0) -> DataFrame:
    """(b, text, confidence) of per-step class scores (b, t, c, p).

    Each step takes its best class, the first of equals; a class counts unless it is the
    blank or the step before had it too. Classes beyond the alphabet give nothing.
    """
    best = probs.groupBy("b", "t").agg(F.max_by(F.struct("c", "p"), F.struct("p", (-F.col("c")).alias("first"))).alias("x")).select("b", "t", "x.c", "x.p")
    before = F.lag("c").over(Window.partitionBy("b").orderBy("t"))
    letters = F.array(*[F.lit(a) for a in alphabet])
    kept = best.withColumn("before", before).withColumn("letter", F.get(letters, F.col("c") - 1))
    use = (F.col("c") != blank) & ~F.col("c").eqNullSafe(F.col("before")) & F.col("letter").isNotNull()
    rows = F.array_sort(F.collect_list(F.when(use, F.struct("t", "letter", F.col("p").cast("double").alias("p")))))
    mean = F.aggregate("rows", F.lit(0.0), lambda s, x: s + x["p"]) / F.size("rows")
    done = kept.groupBy("b").agg(rows.alias("rows"))
    text = F.array_join(F.transform("rows", lambda x: x["letter"]), "")
    return done.select("b", text.alias("text"), F.when(F.size("rows") > 0, mean).otherwise(F.lit(0.0)).cast("float").alias("confidence"))
