"""Token counts by a count-only Viterbi search.

The best segmentation of a text under a unigram vocabulary is never built: an Aho-Corasick
automaton lists the pieces that end at each place, and dynamic programming carries the best
score and its number of pieces.  Ties and unknown characters follow the common unigram
tokenizer: of equal scores the longer last piece wins, a character that is no piece costs
ten less than the worst piece, and counts as its UTF-8 bytes.  In no piece does a space
follow another character, so words with the spaces before them are segmented one by one,
and the counts of words are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words whose counts a task keeps.
KEPT = 400_000


class Counter:
    """Counts tokens under pieces ``(text, score)``."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.pieces, self._automaton = pieces, None

    def __reduce__(self):
        return Counter, (self.pieces,)

    def _build(self) -> None:
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for text, score in self.pieces:
            self._automaton.add_word(text, (len(text), score))
        self._automaton.make_automaton()
        self._single = {text for text, _ in self.pieces if len(text) == 1}
        known = {c for text, _ in self.pieces for c in text}
        # A character that is in no piece always stands alone.
        self._cut = re.compile("([^" + "".join(map(re.escape, sorted(known))) + "])")
        if any(SPACE in text.lstrip(SPACE) for text, _ in self.pieces):
            self._units = re.compile(".+", re.S)  # a vocabulary whose pieces run over words
        elif "\n" in known:
            self._units = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        else:
            self._units = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self._unknown = min(score for _, score in self.pieces) - 10.0
        self._counts: dict[str, tuple[int, int]] = {}

    def _segment(self, text: str) -> tuple[int, int]:
        """Tokens of a stretch of known characters, and how many of them are bytes."""
        n = len(text)
        score, count, bytes_ = [0.0] + [None] * n, [0] * (n + 1), [0] * (n + 1)
        done = 0
        single, unknown = self._single, self._unknown

        def alone(e: int) -> None:
            # The last candidate for e starts at e - 1.
            if text[e - 1] not in single:
                s = score[e - 1] + unknown
                if score[e] is None or s > score[e]:
                    size = len(text[e - 1].encode())
                    score[e], count[e], bytes_[e] = s, count[e - 1] + size, bytes_[e - 1] + size

        for last, (length, worth) in self._automaton.iter(text):
            e = last + 1
            while done < last:
                done += 1
                alone(done)
            s = score[e - length] + worth
            if score[e] is None or s > score[e]:
                score[e], count[e], bytes_[e] = s, count[e - length] + 1, bytes_[e - length]
        while done < n:
            done += 1
            alone(done)
        return count[n], bytes_[n]

    def _unit(self, unit: str) -> tuple[int, int]:
        tokens = fallback = 0
        for i, part in enumerate(self._cut.split(unit)):
            if i % 2:
                size = len(part.encode("utf-8", "surrogatepass"))
                tokens, fallback = tokens + size, fallback + size
            elif part:
                t, b = self._segment(part)
                tokens, fallback = tokens + t, fallback + b
        return tokens, fallback

    def count(self, text: str) -> tuple[int, int]:
        """Tokens of a text, and how many of them are bytes of unknown characters."""
        if self._automaton is None:
            self._build()
        if not text:
            return 0, 0
        text = text.replace(" ", SPACE)
        if text[0] != SPACE:
            text = SPACE + text
        counts = self._counts
        if len(counts) > KEPT:
            counts.clear()
        tokens = fallback = 0
        for unit in self._units.findall(text):
            got = counts.get(unit)
            if got is None:
                got = counts[unit] = self._unit(unit)
            tokens += got[0]
            fallback += got[1]
        return tokens, fallback


def vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file, read as a unigram vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens, n_bytes`` for each row of ``docs`` (doc_id, text).

    ``n_bytes`` of the tokens are bytes of characters outside the vocabulary.  Null and empty
    texts have no tokens; repeated rows and null doc_ids keep their rows; other columns are
    not read.  The vocabulary file is read on the driver.
    """
    counter = Counter(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [counter.count(x.as_py() or "") for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())],
                ["doc_id", "n_tokens", "n_bytes"],
            )

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_bytes long")
