"""Token counts of whole texts under a byte-level BPE, without shuffling pre-tokens.

First tier: a table of the corpus's most frequent pre-tokens with their lengths in
tokens, at most ``FREQUENT`` of them, which every task gets. Second tier: a cache in
each Python worker, filled by the tokenizer library with what the table lacks.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmeter.llm.common import chunks

#: Entries of the table; longest entry; entries that one task may propose.
FREQUENT, FREQUENT_CHARS, PROPOSED = 32_768, 32, 4_096
#: Pre-tokens a task counts at once; beyond, its rarest half starts again from nothing.
#: The table only saves work: what it lacks, or counts too low, is encoded by the library.
COUNTED = 200_000
CACHED, CACHED_CHARS = 200_000, 8_000_000
#: Longer texts are taken in parts, cut where a pre-token is sure to begin.
PART_CHARS = 2_000_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters that the pattern below and the library's own sort alike (letters, numbers,
#: blanks, others) whatever their versions of Unicode. What stands between two blanks and holds
#: another one is a unit of its own, and the library counts it as it counts whole texts.
SETTLED = (
    "\\x00-\u0557\u0900-\u0bff\u0d00-\u208e\u20a0-\ua7cd\uac00-\ud7a3\uf900-\uffff\U0001f300-\U0001f6ff"
)
_UNSETTLED = re.compile(f"[^{SETTLED}]")
#: A blank after anything else: no pre-token goes on across it, and none looks back over it.
_EDGE = re.compile(r"(?<=\S)[ \t\n\r]")
#: The pre-token pattern of byte-level BPE files (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same over ASCII, for the quicker expressions of the standard library; alternatives that
#: begin with different characters are in the order of their frequency.
ASCII = (
    r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
_SPLIT_ASCII = re.compile(ASCII).findall


class Counting:
    """A tokenizer file with the lengths of the pre-tokens met so far."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        content = json.loads(file)
        before = content["pre_tokenizer"] or {}
        if (
            content["model"]["type"] != "BPE" or content["normalizer"] is not None
            or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space")
        ):
            raise ValueError("only byte-level BPE files without normaliser and prefix blank")
        self.whole = Tokenizer.from_str(file)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.alone = Tokenizer.from_str(file)
        self.alone.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = [t["content"] for t in content["added_tokens"]]
        if any(re.search(r"\s", t) for t in self.special):
            raise ValueError("special tokens with blanks")
        if any(t.get("lstrip") or t.get("rstrip") for t in content["added_tokens"]):
            raise ValueError("special tokens that take the blanks beside them")
        self.unsettled = re.compile("|".join([f"[^{SETTLED}]", *map(re.escape, self.special)])).search
        self.split_any = regex.compile(PATTERN).findall
        self.table: dict[str, int] = {}
        self.forget()

    def split(self, text: str) -> list[str]:
        return _SPLIT_ASCII(text) if text.isascii() else self.split_any(text)

    def units(self, text: str) -> list[str]:
        """Strings whose token counts add up to the text's: its pre-tokens, but what holds an
        unsettled character or a special token's string stays whole from edge to edge."""
        if (text.isascii() or not _UNSETTLED.search(text)) and not any(t in text for t in self.special):
            return self.split(text)
        found, start = [], 0
        while hit := self.unsettled(text, start):
            first = hit.start()
            while first > start and not _EDGE.match(text, first):
                first -= 1
            edge = _EDGE.search(text, hit.end())
            end = edge.start() if edge else len(text)
            found += self.split(text[start:first])
            found.append(text[first:end])
            start = end
        return found + self.split(text[start:])

    def use(self, words: list[str], lengths: np.ndarray) -> None:
        self.table = dict(zip(words, lengths.tolist(), strict=True))
        self.forget()

    def forget(self) -> None:
        self.known, self.chars = dict(self.table), 0

    def lengths(self, units: list[str]) -> list[int]:
        """Tokens of each: pre-tokens by the model alone, the others as whole texts."""
        found = [len(e) for e in self.alone.encode_batch(units, add_special_tokens=False)]
        whole = [i for i, unit in enumerate(units) if self.unsettled(unit)]
        for i, e in zip(whole, self.whole.encode_batch([units[i] for i in whole], add_special_tokens=False), strict=True):
            found[i] = len(e)
        return found

    def total(self, units: list[str]) -> int | None:
        """Their tokens, or None if one isn't known."""
        try:
            return sum(map(self.known.__getitem__, units))
        except KeyError:
            return None

    def learn(self, units: set[str]) -> None:
        fresh = [u for u in units if u not in self.known]
        if fresh and (len(self.known) > CACHED + FREQUENT or self.chars > CACHED_CHARS):
            self.forget()
            fresh = [u for u in units if u not in self.known]
        if fresh:
            self.known.update(zip(fresh, self.lengths(fresh), strict=True))
            self.chars += sum(map(len, fresh))


def parts(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > PART_CHARS:
        cut = _CUT.search(text, start + PART_CHARS)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


_COUNTING: dict[int, Counting] = {}


def _counting(file: str) -> Counting:
    if hash(file) not in _COUNTING:
        _COUNTING.clear()
        _COUNTING[hash(file)] = Counting(file)
    return _COUNTING[hash(file)]


def frequent_pre_tokens(docs: DataFrame, file: str, text: str = "text", size: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens of all texts: every task proposes its own, with counts.

    Only proposals are summed over tasks, so nothing is shuffled but ``PROPOSED`` rows
    a task, and the driver gets ``size`` short strings.
    """
    sent = docs.sparkSession.sparkContext.broadcast(file)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting, seen = _counting(sent.value), Counter()
        for batch in chunks(batches, 0):
            for whole in batch.column(0).to_pylist():
                for part in parts(whole or ""):
                    seen.update(counting.units(part))
            if len(seen) > COUNTED:
                seen = Counter(dict(seen.most_common(COUNTED // 2)))
        short = ((w, n) for w, n in seen.items() if len(w) <= FREQUENT_CHARS)
        top = sorted(short, key=lambda x: (-x[1], x[0]))[:PROPOSED]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"]
        )

    proposed = docs.select(F.col(text).alias("text")).mapInArrow(propose, "word string, n long")
    best = proposed.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return [r.word for r in best.collect()]


def count_tokens(
    docs: DataFrame, file: str, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT
) -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row's whole text.

    ``file`` is the content of a tokenizer file. A null text counts as empty: 0 bytes
    and 0 tokens. Special strings inside a text count as the library counts them.
    Repeated rows and rows with a null key are counted each; other columns aren't read.
    """
    counting = Counting(file)
    words = frequent_pre_tokens(docs, file, text, frequent)
    lengths = np.array(counting.lengths(words), np.uint8 if not words else np.uint16)
    context = docs.sparkSession.sparkContext
    sent, known = context.broadcast(file), context.broadcast((words, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = _counting(sent.value)
        counting.use(*known.value)
        for batch in chunks(batches):
            texts = [list(parts(t)) if t else [] for t in batch.column(1).to_pylist()]
            split = [[counting.units(part) for part in whole] for whole in texts]
            flat = list(chain.from_iterable(split))
            # Most texts hold nothing new: only those that do are gone through twice.
            totals = [counting.total(units) for units in flat]
            counting.learn(set(chain.from_iterable(u for u, n in zip(flat, totals, strict=True) if n is None)))
            sums = iter([counting.total(u) if n is None else n for u, n in zip(flat, totals, strict=True)])
            totals = [sum(islice(sums, len(whole))) for whole in split]
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(totals, pa.int64())], names=[key, "n_bytes", "n_tokens"]
            )

    rows = docs.select(F.col(key), F.col(text).alias("text"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, n_bytes long, n_tokens long")
