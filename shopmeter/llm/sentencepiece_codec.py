"""SentencePiece BPE encoding in vectorised merge rounds, and decoding.

A text is cut into words at blanks and line ends, which no piece of the model
crosses. Words not met before are encoded together: one flat array of symbols for
all of them, and in each round every word's best pair is merged wherever it occurs,
from left to right, until no word has a pair left. Each Python worker keeps the
words it has met in a cache of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmeter.llm.common import chunks, kept

BLANK = "▁"
NO_PAIR = np.int32(2**31 - 1)
#: Words a worker remembers, and the longest word it does.
CACHED_WORDS, CACHED_CHARS = 150_000, 64
#: Longer texts are taken in parts, cut at a single blank between two words.
PART_CHARS = 2_000_000


class Codec:
    """A BPE model with byte fallback, as flat lookup arrays."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if (
            spec.name != "identity" or not spec.add_dummy_prefix or spec.remove_extra_whitespaces
            or trainer.model_type != trainer.BPE or not trainer.byte_fallback
            or trainer.treat_whitespace_as_suffix
        ):
            raise ValueError("only BPE models with byte fallback and without normalisation")
        kinds = proto.SentencePiece
        if any(p.type not in (kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        runs = {len(p): i for p, i in normal.items() if not p.strip(BLANK)}
        scores = {p: proto.pieces[i].score for p, i in normal.items()}
        lowest = min(s for p, s in scores.items() if len(p) > 1)
        if any(BLANK in p[1:] for p in normal if p.strip(BLANK)) or any(
            scores[BLANK * n] > lowest for n in runs if n > 1
        ):
            raise ValueError("a blank inside a piece, or blanks that merge before words")
        self.runs, self.single_blank = runs, runs[1]
        self.bytes = np.zeros(256, np.int32)
        self.pieces: list[str] = [""] * len(proto.pieces)
        self.byte_of = {}
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
                self.byte_of[i] = int(p.piece[1:-1], 16)
            elif p.type == kinds.NORMAL:
                self.pieces[i] = p.piece.replace(BLANK, " ")
            elif p.type == kinds.UNKNOWN:
                self.pieces[i] = trainer.unk_surface
        self.line_ends_apart = not any("\n" in p for p in normal)
        # Characters to pieces; those without one are -1 - code point.
        self.symbols = -1 - np.arange(0x110000, dtype=np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.symbols[ord(p)] = i
        # The rank of a piece is the place of its score. Blank runs merge apart.
        words = [p for p in normal if len(p) > 1 and p.strip(BLANK)]
        place = {s: r for r, s in enumerate(sorted({scores[p] for p in words}, reverse=True))}
        if len(place) != len(words):
            raise ValueError("pieces of equal score")
        ranks = {p: place[scores[p]] for p in words}
        self.merged = np.zeros(len(words), np.int32)
        # A piece is "early" if a longer one that holds it merges before it: then
        # merging all its occurrences at once could pass over a better pair.
        self.early = np.zeros(len(words), bool)
        keys, values = [], []
        for p, rank in ranks.items():
            self.merged[rank] = normal[p]
            for cut in range(1, len(p)):
                left, right = p[:cut], p[cut:]
                if left in normal and right in normal:
                    keys.append(normal[left] << 32 | normal[right])
                    values.append(rank)
                    for part in (left, right):
                        if ranks.get(part, -1) > rank:
                            self.early[ranks[part]] = True
        self._hash(np.array(keys, np.int64), np.array(values, np.int32))

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(8, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NO_PAIR, np.int32)
        left, at, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(left):
            free = self.slots[at] == -1
            _, first = np.unique(at, return_index=True)
            first = first[free[first]]
            self.slots[at[first]], self.ranks[at[first]] = keys[left[first]], values[left[first]]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.full(len(left), NO_PAIR, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[open_].astype(np.int64) << 32 | right[open_]
        at = self._slot(keys)
        for _ in range(self.probes):
            found = self.slots[at]
            hit = found == keys
            out[open_[hit]] = self.ranks[at[hit]]
            on = ~hit & (found != -1)
            if not on.any():
                break
            open_, keys, at = open_[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' symbols after all merges: flat, with the words' start positions."""
        n = len(starts)
        lengths = np.diff(np.append(starts, len(symbols)))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        words, word_of = np.arange(n), np.repeat(np.arange(n), lengths)
        while len(symbols):
            ranks = np.full(len(symbols), NO_PAIR, np.int32)
            same = np.flatnonzero(word_of[1:] == word_of[:-1])
            ranks[same] = self.pair_ranks(symbols[same], symbols[same + 1])
            best = np.minimum.reduceat(ranks, starts)
            live = best != NO_PAIR
            if not live.all():
                ended = ~live[word_of]
                done.append((words[~live], lengths[~live], symbols[ended]))
                symbols, ranks = symbols[~ended], ranks[~ended]
                words, lengths, best = words[live], lengths[live], best[live]
                if not len(words):
                    break
                word_of = np.repeat(np.arange(len(words)), lengths)
            hits = np.flatnonzero(ranks == best[word_of])
            owner = word_of[hits]
            # Neighbouring hits overlap: of each unbroken row of them every second merges.
            fresh = np.ones(len(hits), bool)
            fresh[1:] = (hits[1:] != hits[:-1] + 1) | (owner[1:] != owner[:-1])
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
            take = (np.arange(len(hits)) - begin) % 2 == 0
            first = np.ones(len(hits), bool)
            first[1:] = owner[1:] != owner[:-1]
            take &= first | ~self.early[best[owner]]
            hits, owner = hits[take], owner[take]
            symbols[hits] = self.merged[best[owner]]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            symbols, word_of = symbols[keep], word_of[keep]
            lengths = lengths - np.bincount(owner, minlength=len(words))
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        sizes = np.zeros(n, np.int64)
        for ids, counts, _ in done:
            sizes[ids] = counts
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if n else sizes
        out = np.zeros(int(sizes.sum()), np.int32)
        for ids, counts, found in done:
            offset = np.arange(len(found)) - np.repeat(np.cumsum(counts) - counts, counts)
            out[np.repeat(begins[ids], counts) + offset] = found
        return out, begins

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word: with its blank before it, or none if it begins with a line end."""
        spelt = [w if self.line_ends_apart and w[:1] == "\n" else BLANK + w for w in words]
        codes = np.frombuffer("".join(spelt).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(w) for w in spelt], np.int64)
        starts = np.cumsum(lengths) - lengths
        flat, begins = self.merge(self.symbols[codes], starts)
        # Characters without a piece become the pieces of their bytes.
        unknown = flat < 0
        if unknown.any():
            code = np.where(unknown, -1 - flat, 0)
            width = np.where(unknown, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1)
            at = np.cumsum(width) - width
            spread = np.zeros(int(width.sum()), np.int32)
            spread[at[~unknown]] = flat[~unknown]
            raw = np.frombuffer(
                "".join(map(chr, code[unknown])).encode("utf-8", "surrogatepass"), np.uint8
            )
            hole = np.ones(len(spread), bool)
            hole[at[~unknown]] = False
            spread[hole] = self.bytes[raw]
            begins = np.append(at, len(spread))[np.minimum(begins, len(at))]
            flat = spread
        return np.split(flat, begins[1:])

    def blanks(self, n: int) -> list[int]:
        """Ids of n blanks in a row. All their pieces score alike: the leftmost pair goes first."""
        stack: list[int] = []
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and stack[-2] + stack[-1] in self.runs:
                stack[-2:] = [stack[-2] + stack[-1]]
        return [self.runs[length] for length in stack]

    def decode_pieces(self, ids: np.ndarray) -> str:
        """The surface of ids, the blank before the text included."""
        out, raw = [], bytearray()
        for i in ids.tolist():
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)


class Encoder:
    """A codec with the worker's cache of words: ids and surface of each."""

    def __init__(self, model: bytes):
        self.codec, self.known = Codec(model), {}

    def parts(self, text: str) -> Iterator[list[str]]:
        """Lists of words; the words of all lists in a row make up the text."""
        text = text.replace(BLANK, " ")
        if self.codec.line_ends_apart:
            text = text.replace("\n", " \n")
        start = 0
        while len(text) - start > PART_CHARS:
            cut = text.find(" ", start + PART_CHARS)
            while cut > 0 and (text[cut - 1] == " " or text[cut + 1 : cut + 2] in (" ", "")):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield text[start:cut].split(" ")
            start = cut + 1
        yield text[start:].split(" ")

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w and w not in self.known]
        if not fresh:
            return
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
            fresh = [w for w in words if w]
        for word, ids in zip(fresh, self.codec.encode_words(fresh), strict=True):
            self.known[word] = (ids, self.codec.decode_pieces(ids))

    def forget(self) -> None:
        for word in [w for w in self.known if len(w) > CACHED_CHARS]:
            del self.known[word]

    def encode(self, words: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """Ids and surfaces of the words, which are known, blanks in a row merged."""
        if "" not in words:
            found = [self.known[w] for w in words]
            return [x[0] for x in found], [x[1] for x in found]
        codec, ids, surface, run = self.codec, [], [], 0
        for word in words:
            if not word:
                run += 1
                continue
            own, shown = self.known[word]
            if run:
                if own[0] == codec.single_blank:
                    run, own = run + 1, own[1:]
                    shown = shown[1:]
                ids.append(np.array(codec.blanks(run), np.int32))
                surface.append(" " * run)
                run = 0
            ids.append(own)
            surface.append(shown)
        if run:
            ids.append(np.array(codec.blanks(run), np.int32))
            surface.append("".join(codec.pieces[i] for i in codec.blanks(run)))
        return ids, surface


def encode_decode(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's text as token ids, and the ids decoded again.

    Returns ``key``, ``ids`` (array of int) and ``decoded``. A null text counts as
    empty; an empty text has no ids. Repeated rows are encoded each on their own,
    other columns are not read. ``model`` is the content of a model file of a few
    hundred kilobytes, which travels with the tasks.
    """
    if not isinstance(model, bytes):
        raise TypeError("give the content of the model file")
    Codec(model)  # refuse an unsupported model before any task starts
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept("sentencepiece", hash(sent.value), lambda: Encoder(sent.value))
        for batch in chunks(batches, keeps=True):
            split = [list(encoder.parts(t)) if t else [] for t in batch.column(1).to_pylist()]
            encoder.learn(set().union(*(part for parts in split for part in parts)))
            flat, sizes, texts = [], [], []
            for parts in split:
                ids, surface = [], []
                for part in parts:
                    more, shown = encoder.encode(part)
                    ids += more
                    surface += shown
                sizes.append(sum(map(len, ids)))
                flat += ids
                texts.append("".join(surface)[1:])
            encoder.forget()
            values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(texts, pa.string())],
                names=[key, "ids", "decoded"],
            )

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, ids array<int>, decoded string")
