"""Language identification by cross-parsing entropy.

Per language a suffix automaton is built over a bounded sample of labelled text.
A text is parsed against each automaton into longest matches: a phrase ends
where no training substring continues it, or where it is ``MAX_PHRASE`` letters
long. The language that needs the fewest phrases for the text's length wins.

Every letter of the samples counts as itself. The automata's transitions by the
most frequent letters, with restarts after a mismatch folded in, form one dense
table and those by other letters a sorted list, so that thousands of text segments are parsed in step by table
lookups. Texts are cut to segments of ``segment`` code points for that; all
segments of a text count, and a cut adds at most a phrase to every language.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import released

#: Bounds of the sample a model is fitted on: rows and letters a language, and languages.
TRAIN_ROWS, TRAIN_CHARS, MAX_LANGUAGES = 96, 16_000, 256
SEGMENT = 1024
#: Letters with a column of their own in the table, and entries of the table, at most: with many languages fewer letters have one.
DENSE, ENTRIES = 253, 1 << 25
REST = 0  # the class of everything that isn't a letter


def suffix_automaton(codes: Iterable[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence, by state; state 0 is the root."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        current = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = current
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[current] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[current] = twin
        last = current
    return nexts


@functools.lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    """By code point."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class CrossParser:
    """Languages' automata as one table; ``phrases`` parses many texts at once."""

    #: An entry holds the next state's row below this bit and the phrases that the step ends from it on.
    SHIFT = 29

    def __init__(self, samples: dict[str, list[str]], train_chars: int = TRAIN_CHARS, segment: int = SEGMENT) -> None:
        self.languages, self.segment = sorted(samples), segment
        texts = {k: self._sample(v, train_chars) for k, v in samples.items()}
        # Every letter of the samples has a class. The DENSE most frequent ones and the two classes after them are
        # columns of the table; the transitions of the other letters are kept by state and class.
        times = Counter(c for t in texts.values() for c in t if c.isalpha())
        letters = sorted(times, key=lambda c: (-times[c], c))
        # A suffix automaton has under two states a letter; the table's entries must stay under 1 << SHIFT.
        states = sum(2 * len(t) + 2 for t in texts.values())
        dense = max(0, min(DENSE, ENTRIES // max(states, 1) - 3))
        if states * (dense + 3) >= 1 << self.SHIFT:
            raise ValueError(f"{states} states are too many: fit on fewer letters or languages")
        common, rare = sorted(letters[:dense]), sorted(letters[dense:])
        self.classes = len(common) + 3
        self.total = self.classes + len(rare)
        self.other, self.stop = len(common) + 1, len(common) + 2
        # A letter that no sample has is `other`.
        self.map = np.where(_is_letter(), self.other, REST).astype(np.uint16 if self.total < 1 << 16 else np.int32)
        for k, c in enumerate(common):
            self.map[ord(c)] = k + 1
        for k, c in enumerate(rare):
            self.map[ord(c)] = self.classes + k
        keys, moves = [], []
        self.rare_roots = np.full((len(self.languages), len(rare)), -1, np.int32)
        self.roots, rows, at = [], [], 0
        for language, k in enumerate(self.languages):
            codes = self.codes(texts[k])
            codes = codes[np.concatenate([[True], (codes[1:] != REST) | (codes[:-1] != REST)])] if len(codes) else codes
            nexts = suffix_automaton(codes.tolist())
            found = np.full((len(nexts), self.classes), -1, np.int64)
            for state, row in enumerate(nexts):
                for c, to in row.items():
                    if c < self.classes:
                        found[state, c] = to
                    else:
                        keys.append((state + at) * self.total + c)
                        moves.append((to + at) * self.classes)
                        if state == 0:
                            self.rare_roots[language, c - self.classes] = moves[-1]
            start = found[0]
            # A mismatch ends the phrase, and the next one begins with the letter that ended it; a letter that the
            # sample doesn't have is a phrase of its own.
            restart, ends = np.where(start >= 0, start, 0), np.where(start >= 0, 1, 2)
            entry = np.where(found >= 0, (found + at) * self.classes, (restart + at) * self.classes + (ends << self.SHIFT))
            entry[0] = np.where(start >= 0, (start + at) * self.classes, at * self.classes + (1 << self.SHIFT))
            entry[:, self.stop] = (np.arange(len(found)) + at) * self.classes
            rows.append(entry)
            self.roots.append(at * self.classes)
            at += len(found)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.moves = np.array(keys, np.int64)[order], np.array(moves, np.int32)[order]
        self.table = np.concatenate(rows).astype(np.int32).ravel() if rows else np.zeros(0, np.int32)

    @staticmethod
    def _sample(texts: list[str], size: int) -> str:
        """An even share of every sampled text, ``size`` letters in all."""
        share, out = max(1, size // max(1, len(texts))), []
        for t in texts:
            t = t.lower()
            out.append(t[(len(t) - share) // 2 :][:share] if len(t) > share else t)
        return " ".join(out)

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        return self.map[points]

    def _entries(self, state: np.ndarray, row: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """The table's entries for one class a column."""
        rare = np.flatnonzero(row >= self.classes)
        if not len(rare):
            return self.table.take(state + row)
        out = self.table.take(state + np.where(row < self.classes, row, REST))
        at, c, root = state[:, rare], row[rare], roots[:, rare]
        first = self.rare_roots[:, c - self.classes]
        # As in the table: without a transition the phrase ends, and a letter that the sample doesn't have is one of its own.
        miss = np.where(first >= 0, first + (1 << self.SHIFT), root + np.where(at == root, 1 << self.SHIFT, 2 << self.SHIFT))
        key = at.astype(np.int64) // self.classes * self.total + c
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out[:, rare] = np.where(self.keys[place] == key, self.moves[place], miss)
        return out

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (row) in each language (column), and each text's number of letters."""
        small = [t.lower() for t in texts]
        joined = self.codes("\n".join(s if len(s) == len(t) else t for s, t in zip(small, texts, strict=True)))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        is_letter = np.concatenate([[0], np.cumsum(joined != REST)])
        letters = is_letter[begin + lengths] - is_letter[begin]
        parts = -(-lengths // self.segment)
        owner = np.repeat(np.arange(len(texts)), parts)
        first = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = begin[owner] + first * self.segment
        sizes = np.minimum(self.segment, begin[owner] + lengths[owner] - starts)
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        order = np.argsort(-sizes, kind="stable")
        for at in range(0, len(order), 2048):
            rows = order[at : at + 2048]
            width = int(sizes[rows[0]])
            where = starts[rows][:, None] + np.arange(width)[None, :]
            codes = np.where(np.arange(width)[None, :] < sizes[rows][:, None], joined[np.minimum(where, len(joined) - 1)], self.stop)
            codes = np.ascontiguousarray(codes.T).astype(np.int32)
            state = np.repeat(np.array(self.roots, np.int32)[:, None], len(rows), axis=1)
            roots, ended = state.copy(), np.zeros(state.shape, np.int32)
            for row in codes:
                entry = self._entries(state, row, roots)
                ended += entry >> self.SHIFT
                state = entry & ((1 << self.SHIFT) - 1)
            ended += state != roots  # an open phrase ends with the segment
            np.add.at(counts, owner[rows], ended.T)
        return counts, letters


def fit(docs: DataFrame, train: F.Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> CrossParser:
    """Fits on a bounded sample: of each language the ``train_rows`` labelled rows first in a hash order."""
    labelled = docs.filter(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    place = F.xxhash64(F.col(id_col), F.lit(11))
    # Places of the first rows of every language, by partial aggregation without any text.
    keys = labelled.select(F.col(label_col).cast("string").alias("label"), F.col(id_col).cast("long").alias("id"), place.alias("place"))
    first = F.row_number().over(Window.partitionBy("label").orderBy("place", "id"))
    picked = keys.withColumn("k", first).filter(F.col("k") <= train_rows).select("label", "id").collect()  # train_rows a language at most
    labels = sorted({r["label"] for r in picked})
    if len(labels) > MAX_LANGUAGES:
        raise ValueError(f"{len(labels)} languages; the bound is {MAX_LANGUAGES}")
    ids = [r["id"] for r in picked]
    # Of a sampled text its share of the letters goes to the driver, from the middle of the whole text.
    rows = Counter(r["label"] for r in picked)
    share = F.lit(train_chars)
    for label, n in rows.items():
        share = F.when(F.col(label_col).cast("string") == label, F.lit(max(1, train_chars // n))).otherwise(share)
    begin = F.greatest(F.lit(0), F.floor((F.length(text_col) - share) / 2)).cast("int") + 1
    middle = F.substring(F.col(text_col), begin, share)
    chosen = labelled.filter(F.col(id_col).isin(ids) & F.col(text_col).isNotNull())
    texts = chosen.select(F.col(label_col).cast("string").alias("label"), middle.alias("text"), F.col(id_col).alias("id")).orderBy(place, "id").limit(2 * train_rows * max(1, len(labels)))
    samples: dict[str, list[str]] = {}
    for row in texts.collect():  # in the order of the hash; identifiers that many rows repeat cannot add rows without end
        samples.setdefault(row["label"], []).append(row["text"])
    return CrossParser(samples, train_chars)


def identify(docs: DataFrame, parser: CrossParser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row; whole texts are parsed.

    ``lang_pred`` is ``und`` with score 0 if the text is null or has no letter, or
    if the model has no language. Otherwise the score is the share of phrases that
    the winner saves against the runner-up's count (1 with a single language).
    Ties go to the language first in order.
    """

    def run(batches):
        for b in batches:
            pred, score = _judged(parser, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), "doc_id long, lang_pred string, score double")


def _judged(parser: CrossParser, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    texts, pred, score, at = [t or "" for t in texts], [], [], 0
    while at < len(texts):  # parts of about a million letters
        end, size = at, 0
        while end < len(texts) and (size < 1_000_000 or end == at):
            size += len(texts[end])
            end += 1
        part = texts[at:end]
        at = end
        if not parser.languages:
            pred += ["und"] * len(part)
            score += [0.0] * len(part)
            continue
        counts, letters = parser.phrases(part)
        ranked, known = np.sort(counts, axis=1), letters > 0
        sure = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1) if counts.shape[1] > 1 else np.ones(len(part))
        pred += [parser.languages[k] if ok else "und" for k, ok in zip(counts.argmin(axis=1), known, strict=True)]
        score += np.where(known, np.clip(sure, 0, 1), 0.0).tolist()
    return pred, score


def keep_identified(docs: DataFrame, parser: CrossParser, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in some language: texts that are null or without a letter go."""

    def run(batches):
        for b in batches:
            pred, _ = _judged(parser, b.column(text_col).to_pylist())
            yield b.filter(pa.array([p != "und" for p in pred], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> F.Column:
    """crc32 of the identifier as text; rows without one are never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
