"""Best-fit packing by exact complements (operator 2).

Documents become token ids with an end id 0; longer ones are cut at the sequence length, and every
piece must lie in one sequence. Only the number of pieces of each length matters for the plan, and
there are at most `capacity` lengths, so the plan is made from that histogram, on the driver, in time
and memory that do not depend on the number of documents. The plan is a list of patterns (a multiset of
lengths that shares a sequence, and how many sequences take it). Pieces of equal length are then dealt
to the pattern's places by their rank, which is found with counts per block, never in one task.

Building a pattern starts from the longest length still available. An index holds, for each sum, the first
length of a single, a pair and a triple of available lengths with that sum, so the gap is looked up and, if
one of them fills it exactly, closed. As lengths only ever run out, an entry of the index only moves to
smaller first lengths, and one that has found nothing stays empty. Where nothing closes the gap, the longest
length that fits goes in and the smaller gap is looked up. A pattern is taken as often as the counts allow.

Bound of the plan: a pattern that takes a length c times, and is limited by it, leaves fewer than c pieces of
it, and at most half of what there was; c is at most capacity / length. So a length limits at most
2 + log2(capacity / length) patterns, all lengths together 3 x capacity. A pattern has fewer than
sqrt(2 x capacity) different lengths, and each is one row of the plan, however many of its pieces share a
sequence: sequence and offset follow from a piece's rank by division.

Defined cases: a null text is an empty one and makes a piece of one id (the end id); repeated rows are
packed as often as they occur; equal lengths are ranked by a hash of id and piece; an empty table gives
an empty table. Texts of any length are tokenised whole, one row at a time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch

CAPACITY = 2048
END_ID = 0
#: Parts of words whose ids a worker remembers.
WORD_MEMORY = 300_000
#: Blocks per length within which ranks are counted; more of them means smaller windows.
RANK_ROWS = 20_000

#: Letters up to U+017F without the dotted capital I, whose lower case is two characters.
_LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f"
_SIGNS = "!-&(-/:-@\\[-`{-~"
_PLAIN = re.compile(f"[{_LATIN}0-9{_SIGNS}]+")
_PLAIN_TEXT = re.compile(f"[{_LATIN}0-9{_SIGNS}\\x20\\t-\\r]*")
_PARTS = re.compile(f"[{_LATIN}]+|[0-9]|[{_SIGNS}]+")
_CONTROL_GAPS = re.compile("[\x1c-\x1f]")


class _Memory(dict):
    """Remembers what `make` gave; of two generations the elder goes when the younger is full, so what is frequent stays."""

    def __init__(self, make, bound: int):
        super().__init__()
        self.make, self.bound, self.elder = make, bound // 2, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.bound:
            self.elder = dict(self)
            self.clear()
        found = self.elder.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


class WordIds:
    """Token ids of whole texts, part by part.

    The tokenizer turns every run of white space into one blank and never joins characters across it,
    so the ids of a text are those of its words in turn; most were seen before. Latin letters, digits and
    signs are cut as the tokenizer's own pattern cuts them, and the parts go straight to the merge table;
    in a text that has other characters, words that do go through the whole tokenizer. So do texts that
    hold an added token such as an end marker, which the tokenizer finds before it cuts.
    """

    def __init__(self, tokenizer_file: str, memory: int = WORD_MEMORY):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or "(?!)", re.IGNORECASE)  # some are looked for in the lower-cased text
        self.merge = self.tokenizer.model.tokenize
        self.bytes_as = _byte_letters()
        self.parts = _Memory(self._part, memory)
        self.words = _Memory(self._word, memory // 4)

    def _part(self, part: str) -> bytes:
        text = part if part.isascii() else "".join(map(self.bytes_as.__getitem__, part.encode()))
        return np.array([t.id for t in self.merge(text)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word):
            return b"".join([self.parts[p] for p in _PARTS.findall(word.lower())])
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of the text, without the end id."""
        if _CONTROL_GAPS.search(text) or self.added.search(text):  # blanks for str.split() but not for the tokenizer; added tokens
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _PLAIN_TEXT.fullmatch(text):
            return b"".join(map(self.parts.__getitem__, _PARTS.findall(text.lower())))
        return b"".join(map(self.words.__getitem__, text.split()))


def _byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies: itself, or the next unused one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def pieces_of(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", id_type)] + [T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()))])
    end = np.uint32(END_ID).astype("<u4").tobytes()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = WordIds(tokenizer_file)
        for batch in batches:
            rows = []
            for doc, value in zip(batch.column(0), batch.column(1), strict=True):
                value = value.as_py()
                ids = (words.encode(value) if value else b"") + end
                doc = doc.as_py()
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """length -> number of pieces, to (lengths sharing a sequence, number of such sequences)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    sums, patterns = Sums(left), []
    while (available := np.flatnonzero(left)).size:
        used = Counter({int(available[-1]): 1})
        gap = capacity - int(available[-1])
        while gap:
            found = sums.closing(gap, used)
            if found:
                used.update(found)
                break
            fits = np.flatnonzero(left[: gap + 1])
            longest = next((int(x) for x in fits[::-1] if left[x] > used[int(x)]), None)
            if longest is None:
                break
            used[longest] += 1
            gap -= longest
        times = int(min(left[x] // c for x, c in used.items()))
        for x, c in used.items():
            left[x] -= times * c
        patterns.append((list(used.elements()), times))
    return patterns


class Sums:
    """Index of the sums of one, two and three available lengths; `left` is the caller's count of pieces by length.

    pair[s] and triple[s] are the largest lengths with which a pair or triple of sum s may still begin, longest
    first; those above were looked at and have run out for good.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self.pair = np.arange(len(left)) - 1
        self.triple = np.arange(len(left)) - 2

    def _has(self, lengths: tuple[int, ...], used: Counter) -> bool:
        return all(self.left[x] - used[x] >= lengths.count(x) for x in lengths)

    def closing(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        """One, two or three lengths of this sum, long ones first, of which there are enough beside the used ones."""
        if self._has((gap,), used):
            return (gap,)
        return self._pair(gap, used) or self._triple(gap, used)

    def _pair(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        none, a = Counter(), int(self.pair[gap])
        while 2 * a >= gap and not self._has((a, gap - a), none):
            a -= 1
        self.pair[gap] = a
        while 2 * a >= gap:  # what others of the pattern use up may be free again in the next one
            if self._has((a, gap - a), used):
                return a, gap - a
            a -= 1
        return None

    def _rest(self, a: int, rest: int, used: Counter) -> tuple[int, ...] | None:
        """a and a pair of sum rest that is no longer than a."""
        b = np.arange(min(a, rest - 1, int(self.pair[rest])), (rest + 1) // 2 - 1, -1)
        for x in b[(self.left[b] > 0) & (self.left[rest - b] > 0)].tolist():
            if self._has((a, x, rest - x), used):
                return a, x, rest - x
        return None

    def _triple(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        none = Counter()
        first = np.flatnonzero(self.left[: max(int(self.triple[gap]), 0) + 1])[::-1]
        for k, a in enumerate(first.tolist()):
            if 3 * a < gap:
                break
            if self._rest(a, gap - a, none):
                self.triple[gap] = a
                for other in first[k:].tolist():
                    if 3 * other >= gap and self.left[other] > used[other] and (found := self._rest(other, gap - other, used)):
                        return found
                return None
        self.triple[gap] = 0
        return None


def _places(spark: SparkSession, patterns: list[tuple[list[int], int]]) -> DataFrame:
    """The plan as rows, one for each length of a pattern: pieces of `length` ranked lo to hi-1 lie `each` to a sequence,
    from offset `at` on, in sequences first_sequence onwards. The module's docstring bounds their number.
    """
    rows, next_rank, sequence = [], Counter(), 0
    for lengths, times in patterns:
        offset = 0
        for x, each in Counter(lengths).items():
            lo = next_rank[x]
            rows.append((x, lo, lo + times * each, each, sequence, offset))
            next_rank[x] += times * each
            offset += x * each
        sequence += times
    return spark.createDataFrame(rows, "length_ long, lo long, hi long, each long, first_sequence long, at long")


def pack(spark: SparkSession, docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their sequence_id and offset. Tokenises once: the pieces are written to the shared folder."""
    scratch = Scratch(spark)
    pieces = scratch.keep(pieces_of(docs, tokenizer_file, capacity))
    total = pieces.count()
    blocks = max(1, total // (RANK_ROWS * 16))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(blocks, 64))))
    per_block = pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    histogram = {int(r.length): int(r.n) for r in per_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if not histogram:
        return pieces.drop("block").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    places = _places(spark, plan_patterns(histogram, capacity))
    before = per_block.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("within", within).join(before, ["length", "block"]).withColumn("rank", F.col("within") + F.col("before"))
    # the plan has a bounded number of rows whatever the corpus (see above), hence the broadcast
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("length_")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.expr("first_sequence + (rank - lo) div each").alias("sequence_id"), F.expr("at + (rank - lo) % each * length").alias("offset"))
