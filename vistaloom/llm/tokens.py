"""Byte-level BPE ids of texts, with a cache of pre-tokens, and count-only Viterbi over a unigram vocabulary."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaloom.llm.util import slices

VOCABULARIES = "/opt/tokenizers"
#: Entries of a worker's cache; it is cleared when full.
CACHE = 400_000


def default_path(name: str) -> str:
    """The place of an installed vocabulary file."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"{VOCABULARIES}/{name}"
    return public_tokenizers.path(name)


#: Fixed value: the pre-tokenisation rule of the byte-level BPE vocabulary, for texts of the characters in PLAIN only, on
#: which the standard library's character classes agree with \p{L} and \p{N}. Other texts go to the tokenizers library whole.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
NOT_PLAIN = r"[^\t\n\r\x20-\x7E\u00A1-\u00A9\u00AB\u00AC\u00AE-\u00B1\u00B4\u00B6-\u00B8\u00BB\u00BF-\u024F]"


class BytePairs:
    """Ids as little-endian unsigned 32-bit bytes, equal to those of the `tokenizers` library on whole texts.

    Merges never cross pre-tokens, so each distinct pre-token is encoded once (by rank, which gives the same ids) and
    then looked up. vocabulary: the library's JSON file; ranks: the same vocabulary as lines of base64 and rank.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True  # strings of special tokens are ordinary text
        by_rank = {base64.b64decode(token): int(rank) for token, rank in map(str.split, ranks.splitlines())}
        self.whole = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=by_rank, special_tokens={}).encode_ordinary
        self.find, self.odd = re.compile(PRETOKEN).findall, re.compile(NOT_PLAIN).search
        self.cache: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if not text.isascii() and self.odd(text) or text.isascii() and not text.isprintable() and self.odd(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        pieces, cache = self.find(text), self.cache
        try:
            return b"".join(map(cache.__getitem__, pieces))
        except KeyError:
            if len(cache) > CACHE:
                cache.clear()
            for piece in pieces:
                if piece not in cache:
                    cache[piece] = array("I", self.whole(piece)).tobytes()
            return b"".join(map(cache.__getitem__, pieces))


# ---- count-only Viterbi --------------------------------------------------------------------------------------

SPACE = "▁"
#: Added to the lowest score for a character that no piece covers (the libraries' fixed penalty).
UNKNOWN_PENALTY = 10.0


def unigram_vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece model file; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=Path(path or default_path("piece_bpe_32k.model")).read_bytes())
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Viterbi:
    """Best score and number of pieces of texts under a unigram vocabulary, without building the pieces.

    An Aho-Corasick automaton lists the pieces that end at each character, longest first; the best path to a character
    is replaced only by a strictly better one, so the longest last piece wins ties, as in the `tokenizers` library.
    A character without a piece of its own can also be spelled as its UTF-8 bytes, at the unknown score.

    Pieces have their space mark in front only, so a best path over a text is the best paths over its words, one after the other;
    a word's result is kept in a cache. With a vocabulary where that doesn't hold, texts are treated whole.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        crossing = any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
        newline = not any("\n" in p for p, _ in pieces)
        pattern = r"(?s).+" if crossing else (rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if newline else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.find = re.compile(pattern).findall
        self.cache: dict[str, tuple[float, int]] = {}

    def best(self, word: str) -> tuple[float, int]:
        score, count = [0.0] * (len(word) + 1), [0] * (len(word) + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(len(word) + 1)]
        if len(self.machine):
            for last, match in self.machine.iter(word):
                ends[last + 1].append(match)
        for end in range(1, len(word) + 1):
            top, pieces = float("-inf"), 0
            for length, own in ends[end]:
                if (s := score[end - length] + own) > top:
                    top, pieces = s, count[end - length] + 1
            if word[end - 1] not in self.single and (s := score[end - 1] + self.unknown) > top:
                top, pieces = s, count[end - 1] + len(word[end - 1].encode())
            score[end], count[end] = top, pieces
        return score[-1], count[-1]

    def count(self, text: str) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        total, pieces, cache = 0.0, 0, self.cache
        for word in self.find((" " + text).replace(" ", SPACE)):
            found = cache.get(word)
            if found is None:
                found = self.best(word)
                if len(word) < 64:
                    if len(cache) > CACHE:
                        cache.clear()
                    cache[word] = found
            total += found[0]
            pieces += found[1]
        return total, pieces


def _counts(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Viterbi(shared.value)
        for batch in slices(batches):
            found = [model.count(x or "") for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array([x[1] for x in found], pa.int64()), pa.array([x[0] for x in found], pa.float64())], ["doc_id", "n_tokens", "score"])

    return run


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]] | None = None) -> DataFrame:
    """doc_id, n_tokens, score of each row of docs (doc_id, text; further columns are left out).

    Null and empty texts have no tokens and score 0. A space is put before the text, as the vocabulary expects. Repeated rows
    stay; an empty table gives an empty result. Nothing is shuffled; the vocabulary is all that is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(unigram_vocabulary() if vocabulary is None else vocabulary)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_counts(shared), "doc_id long, n_tokens long, score double")
