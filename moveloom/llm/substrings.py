"""Repeated substrings across documents with suffix arrays (operator 5).

A byte goes if it is covered by a `width`-byte string that also starts in a document with a smaller id.
Sorting every suffix of a corpus moves many times its size, so the sort is distributed by content, such
that all suffixes that agree in `width` bytes meet, and only those are sorted that may have an equal:

1. Equal texts become one, with the smallest id of any; what repeats that one whole needs no search.
2. Each `width`-byte window is filed under one anchor: the least hash among its SEED-byte seeds, the first
   if several are equal. Equal windows have equal anchors, and neighbouring windows mostly share theirs, so
   a text becomes a chain of short strings (the windows of one anchor, overlapping), about one for 14 bytes.
3. Anchor hashes are dealt to buckets, in packed arrays; those that two texts have are sent back.
4. For these anchors, the strings go to the anchor's bucket. There equal strings become one; of anchors that
   have several strings then, a suffix array is built by the difference cover (sort sampled triples, recurse on their names, merge the
   remaining suffixes). Neighbours in it that agree in `width` bytes form groups, each with its smallest id.
5. A string goes back with the smallest ids of its windows, as runs, and the texts that hold it compare their own id.

An anchor or a string that many texts of one chunk have is sent once for the chunk, with the smallest and the largest of
their ids; which texts hold it stays with the chunk. So what a passage sends does not grow with its texts but with the
chunks, however many texts hold it.

Texts are shuffled once, into a bucketed table that later steps read in place.

Defined cases: a null text is an empty one; a text shorter than `width` keeps all; equal ids never remove
each other's bytes; null ids count as larger than any other; an empty table gives an empty table; long
texts are searched whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch
from .suffix_array import window_groups

WIDTH = 50
SEED = 24
#: Bytes of text per bucket of anchors, and anchors per packed row before it is dealt.
BUCKET_BYTES = 8_000_000
#: Bytes of texts in a bucket of their table, which a task reads as a whole.
TEXT_BYTES = 128 << 20
CHUNK_ANCHORS = 400_000
#: Bytes of distinct strings of a chunk.
CHUNK_BYTES = 32_000_000
#: Buckets of strings per bucket of anchors.
FINER = 4
#: Symbols in one suffix array; anchors are never split between two, so one anchor may need more.
BLOCK = 500_000
NO_ID = (1 << 63) - 1
_M = np.uint64(0x9DDFEA08EB382D69)


def _power(length: int) -> np.uint64:
    return np.uint64(pow(int(_M), length, 1 << 64))


def anchors(raw: bytes, width: int = WIDTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first window, number of windows) for each run of windows with one anchor."""
    n = len(raw)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    sums, length = {1: b}, 1  # hashes of 2, 4, 8, ... bytes, doubled
    while 2 * length <= seed:
        h = sums[length]
        sums[2 * length] = h[:-length] * _power(length) + h[length:]
        length *= 2
    h, have, rest = sums[length], length, seed - length
    while rest:  # append what the binary digits of seed still ask for
        part = 1 << (rest.bit_length() - 1)
        h = h[: n - have - part + 1] * _power(part) + sums[part][have : n - part + 1]
        have, rest = have + part, rest - part
    h = (h ^ (h >> np.uint64(32))) * _M
    h ^= h >> np.uint64(29)
    at, span, goal = np.arange(len(h), dtype=np.int32 if n < 1 << 31 else np.int64), 1, width - seed + 1
    while span < goal:  # argmin over 2, 4, ... seeds; the first of equal ones
        step = min(span, goal - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(h[right] < h[left], right, left)
        span += step
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return h[at[first]], first, np.diff(np.append(first, len(at)))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _distinct_texts(scratch: Scratch, docs: DataFrame, total: int) -> DataFrame:
    """The distinct texts, total bytes of them, as a table bucketed by key, so that joins on the key leave it in place.

    Each task sorts its rows by key and sends one text of each, so a group of copies is never gathered. Buckets are so many times
    the shuffle's partitions that one holds TEXT_BYTES on average; the files lie in the shared folder with the other tables.
    """
    spark = scratch.spark
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts *= max(1, -(-total // (parts * TEXT_BYTES)))
    name = f"moveloom_texts_{uuid.uuid4().hex}"
    docs.groupBy("key").agg(F.first("text").alias("text")).write.bucketBy(parts, "key").format("parquet").option("path", f"{scratch.base}/{name}").saveAsTable(name)
    return spark.table(name)


def _posted(texts: DataFrame, buckets: int, width: int) -> DataFrame:
    """Packed anchors: per chunk of texts and bucket the low hash halves and the anchors' numbers in the chunk.

    Kind 1: anchors of one text of the chunk. Kind 2: one mention each of those of several texts. Kind 0, once per chunk:
    its keys, how many distinct anchors each text has, sorted by hash, and the numbers of those of several texts.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        keys: list[str] = []
        held: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal keys, held, size, number
            hashes = np.concatenate(held)
            order = np.argsort(hashes, kind="stable")
            ordered = hashes[order]
            equal = ordered[1:] == ordered[:-1]
            again = np.concatenate([[False], equal])
            several = again | np.concatenate([equal, [False]])
            bucket = _bucket(ordered, buckets)  # buckets are ranges of this order
            chunk, rows, kinds = f"{task}-{number}", [], []
            for kind, some in ((1, ~several), (2, several & ~again)):
                own, low, at = order[some], (ordered[some] & np.uint64(0xFFFFFFFF)).astype(np.uint32), bucket[some]
                cuts = np.searchsorted(at, np.arange(buckets + 1))
                for c in np.flatnonzero(np.diff(cuts)):
                    part = slice(cuts[c], cuts[c + 1])
                    rows.append((int(c), low[part].tobytes(), own[part].astype(np.uint32).tobytes() if kind == 1 else b"", b""))
                    kinds.append(kind)
            counts = np.array([len(x) for x in held], np.uint32).tobytes()
            rows.append((hash_text(chunk) % buckets, "\n".join(keys).encode(), counts, order[several].astype(np.uint32).tobytes()))
            kinds.append(0)
            number += 1
            keys, held, size = [], [], 0
            a, b, c, d = zip(*rows, strict=True)
            columns = [pa.array(a, pa.int32()), pa.array([chunk] * len(a)), pa.array(kinds, pa.int32()), *(pa.array(x, pa.binary()) for x in (b, c, d))]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "kind", "low", "place", "known"])

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                h = np.unique(anchors(text.as_py().encode("utf-8", "surrogatepass"), width)[0])
                if len(h):
                    keys.append(key.as_py())
                    held.append(h)
                    size += len(h)
                if size >= CHUNK_ANCHORS:
                    yield flush()
        if held:
            yield flush()

    return texts.mapInArrow(run, "bucket int, chunk string, kind int, low binary, place binary, known binary")


def hash_text(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def _shared(pdf):
    """Of one bucket: the anchors of kind 1 that another text has too, by chunk; rows of kind 0 pass."""
    import pandas as pd

    rows = pdf[pdf.kind > 0]
    names = ["chunk", "kind", "low", "place", "known"]
    passed = pdf[pdf.kind == 0][names]
    if not len(rows):
        return passed.astype({"chunk": object})
    low = [np.frombuffer(x, np.uint32) for x in rows.low]
    everything = np.concatenate(low)
    order = np.argsort(everything, kind="stable")
    ordered = everything[order]
    equal = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(everything), bool)
    twice[order[1:]] = equal
    twice[order[:-1]] |= equal
    out, at = [], 0
    for chunk, kind, x, place in zip(rows.chunk, rows.kind, low, rows.place, strict=True):
        flags = twice[at : at + len(x)]
        at += len(x)
        if kind == 1 and flags.any():
            out.append((chunk, 1, b"", np.frombuffer(place, np.uint32)[flags].tobytes(), b""))
    return pd.concat([passed, pd.DataFrame(out, columns=names)]).astype({"chunk": object})


def _by_text(pdf):
    """Of one chunk: per text the numbers of its shared anchors."""
    import pandas as pd

    table = pdf[pdf.kind == 0].iloc[0]
    keys, counts = table.low.decode().split("\n"), np.frombuffer(table.place, np.uint32)
    parts = [np.frombuffer(x, np.uint32) for x in (table.known, *pdf[pdf.kind == 1].place)]
    flagged = np.sort(np.concatenate(parts)).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    cuts = np.searchsorted(flagged, starts)
    own = np.flatnonzero(np.diff(cuts))
    return pd.DataFrame([(keys[i], (flagged[cuts[i] : cuts[i + 1]] - starts[i]).astype(np.uint32).tobytes()) for i in own], columns=["key", "shared"])


_STRINGS = "bucket int, chunk string, kind int, info binary, ids binary, data binary"


def _strings(texts: DataFrame, buckets: int, width: int) -> DataFrame:
    """texts (key, text, shared, least) -> packed distinct strings of shared anchors, per chunk of texts and bucket.

    Kind 1: number of the string in the chunk, its window count and the low half of its anchor's hash; the smallest and the
    largest id of its texts; its bytes. Kind 0, once per chunk: where strings stand (number of the text, start, number of
    the string), the ids of the texts, their keys.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        keys: list[str] = []
        owners: list[int] = []
        names: dict[bytes, int] = {}
        hashes: list[int] = []
        places: list[tuple[int, int, int]] = []
        size = 0

        def flush():
            nonlocal keys, owners, names, hashes, places, size, number
            chunk, rows = f"{task}-{number}", []
            where, ids = np.array(places, np.int64).reshape(-1, 3), np.array(owners, np.int64)
            low, high = np.full(len(names), NO_ID, np.int64), np.full(len(names), -(1 << 63), np.int64)
            np.minimum.at(low, where[:, 2], ids[where[:, 0]])
            np.maximum.at(high, where[:, 2], ids[where[:, 0]])
            distinct, h = list(names), np.array(hashes, np.uint64)
            counts = np.array([len(x) for x in distinct], np.int64) - width + 1
            bucket = _bucket(h, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for c in np.flatnonzero(np.diff(cuts)):
                own = order[cuts[c] : cuts[c + 1]]
                info = np.stack([own, counts[own], (h[own] & np.uint64(0xFFFFFFFF)).astype(np.int64)]).astype(np.uint32)
                rows.append((int(c), 1, info.tobytes(), np.stack([low[own], high[own]]).tobytes(), b"".join([distinct[i] for i in own.tolist()])))
            rows.append((hash_text(chunk) % buckets, 0, where.T.astype(np.uint32).tobytes(), ids.tobytes(), "\n".join(keys).encode()))
            number += 1
            keys, owners, names, hashes, places, size = [], [], {}, [], [], 0
            a, k, i, m, d = zip(*rows, strict=True)
            columns = [pa.array(a, pa.int32()), pa.array([chunk] * len(a)), pa.array(k, pa.int32()), *(pa.array(x, pa.binary()) for x in (i, m, d))]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "kind", "info", "ids", "data"])

        for batch in batches:
            for key, text, shared, least in zip(*(batch.column(k) for k in range(4)), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                h, start, count = anchors(raw, width)
                wanted = np.isin(h, np.unique(h)[np.frombuffer(shared.as_py(), np.uint32)])
                for x, s, k in zip(h[wanted].tolist(), start[wanted].tolist(), count[wanted].tolist(), strict=True):
                    string = raw[s : s + k + width - 1]
                    at = names.setdefault(string, len(names))
                    if at == len(hashes):
                        hashes.append(x)
                        size += len(string)
                    places.append((len(keys), s, at))
                keys.append(key.as_py())
                owners.append(least.as_py())
                if len(places) >= CHUNK_ANCHORS // 4 or size >= CHUNK_BYTES:
                    yield flush()
        if places:
            yield flush()

    return texts.select("key", "text", "shared", "least").mapInArrow(run, _STRINGS)


def _covered(width: int):
    """Of one bucket: the smallest ids of the windows of each string, as runs, by chunk, where a text of the chunk has a larger id; rows of kind 0 pass."""

    def run(pdf):
        import pandas as pd

        rows, passed = pdf[pdf.kind == 1], pdf[pdf.kind == 0]
        out = [(c, 0, i, m, d) for c, i, m, d in zip(passed.chunk, passed["info"], passed.ids, passed.data, strict=True)]
        if len(rows):
            info = [np.frombuffer(x, np.uint32).reshape(3, -1) for x in rows["info"]]
            ids = [np.frombuffer(x, np.int64).reshape(2, -1) for x in rows.ids]
            names: dict[bytes, int] = {}
            kind = np.empty(sum(x.shape[1] for x in info), np.int64)
            at = 0
            for x, data in zip(info, rows.data, strict=True):
                lengths = x[1].astype(np.int64) + width - 1
                for e, size in zip(np.cumsum(lengths).tolist(), lengths.tolist(), strict=True):
                    kind[at] = names.setdefault(data[e - size : e], len(names))
                    at += 1
            distinct = list(names)
            class_least = np.full(len(distinct), NO_ID, np.int64)
            np.minimum.at(class_least, kind, np.concatenate([m[0] for m in ids]))
            class_count = np.array([len(d) for d in distinct], np.int64) - width + 1
            class_start = np.concatenate([[0], np.cumsum(class_count)])
            anchor = np.empty(len(distinct), np.uint32)
            anchor[kind] = np.concatenate([x[2] for x in info])
            # the only string of an anchor has no window in common with any other
            group_least = np.repeat(class_least, class_count)
            for some in _blocks(anchor, class_count + width):
                text = np.frombuffer(b"".join([distinct[i] + b"\x00" for i in some]), np.uint8).astype(np.int64)
                # symbols from 2; each string ends in 1, which no window holds
                sizes = class_count[some] + width
                begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                text += 2
                text[begins + sizes - 1] = 1
                inside = np.arange(class_count[some].sum()) - np.repeat(np.concatenate([[0], np.cumsum(class_count[some])[:-1]]), class_count[some])
                group = window_groups(text, np.repeat(begins, class_count[some]) + inside, width)
                smallest = np.full(int(group.max()) + 1, NO_ID, np.int64)
                np.minimum.at(smallest, group, np.repeat(class_least[some], class_count[some]))
                group_least[np.repeat(class_start[some], class_count[some]) + inside] = smallest[group]
            # runs of windows with one smallest id; each ends with its string
            new = np.ones(len(group_least), bool)
            new[1:] = group_least[1:] != group_least[:-1]
            new[class_start[:-1]] = True
            first = np.flatnonzero(new)
            stop = np.append(first[1:], len(group_least))
            owner = np.searchsorted(class_start, first, side="right") - 1
            run_cuts = np.searchsorted(owner, np.arange(len(distinct) + 1))
            at = 0
            for chunk, x, m in zip(rows.chunk, info, ids, strict=True):
                k = kind[at : at + x.shape[1]]
                at += x.shape[1]
                n = run_cuts[k + 1] - run_cuts[k]
                string = np.repeat(np.arange(len(k)), n)
                r = np.repeat(run_cuts[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                wanted = group_least[first[r]] < m[1][string]
                if wanted.any():
                    string, r = string[wanted], r[wanted]
                    begin = class_start[k[string]]
                    runs = np.stack([x[0][string].astype(np.int64), first[r] - begin, stop[r] - begin, group_least[first[r]]])
                    out.append((chunk, 1, runs[:3].astype(np.uint32).tobytes(), runs[3].tobytes(), b""))
        return pd.DataFrame(out, columns=["chunk", "kind", "info", "ids", "data"])

    return run


def _blocks(anchor: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of strings, so many as make one suffix array; those of one anchor stay together, single ones are left out."""
    order = np.argsort(anchor, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(anchor[order])) + 1, len(order))
    several = np.repeat(np.diff(np.concatenate([[0], ends])) > 1, np.diff(np.concatenate([[0], ends])))
    order = order[several]
    if not len(order):
        return
    done = np.cumsum(sizes[order])
    ends = np.append(np.flatnonzero(np.diff(anchor[order])) + 1, len(order))
    begin = 0
    while begin < len(order):
        base = done[begin - 1] if begin else 0
        fit = ends[(ends > begin) & (done[ends - 1] - base <= BLOCK)]
        end = int(fit[-1]) if len(fit) else int(ends[ends > begin][0])
        yield order[begin:end]
        begin = end


def _runs_by_text(pdf):
    """Of one chunk: per text the runs of its windows whose smallest id is smaller than its own, sorted."""
    import pandas as pd

    table = pdf[pdf.kind == 0].iloc[0]
    keys, owners = table.data.decode().split("\n"), np.frombuffer(table.ids, np.int64)
    text, start, string = np.frombuffer(table["info"], np.uint32).reshape(3, -1).astype(np.int64)
    found = pdf[pdf.kind == 1]
    if not len(found):
        return pd.DataFrame([], columns=["key", "runs"])
    parts = np.concatenate([np.frombuffer(x, np.uint32).reshape(3, -1) for x in found["info"]], axis=1).astype(np.int64)
    least = np.concatenate([np.frombuffer(x, np.int64) for x in found.ids])
    order = np.argsort(parts[0], kind="stable")
    parts, least = parts[:, order], least[order]
    low, high = np.searchsorted(parts[0], string, "left"), np.searchsorted(parts[0], string, "right")
    n = high - low  # each place of a string takes the runs of that string
    place = np.repeat(np.arange(len(string)), n)
    r = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    gone = least[r] < owners[text[place]]
    place, r = place[gone], r[gone]
    runs = np.stack([text[place], start[place] + parts[1][r], start[place] + parts[2][r]])
    runs = runs[:, np.lexsort((runs[1], runs[0]))]
    cuts = np.searchsorted(runs[0], np.arange(len(keys) + 1))
    own = np.flatnonzero(np.diff(cuts))
    return pd.DataFrame([(keys[i], runs[1:, cuts[i] : cuts[i + 1]].tobytes()) for i in own], columns=["key", "runs"])


def spans_of(runs: bytes | None, width: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges from runs of window starts, which are sorted."""
    out: list[tuple[int, int]] = []
    if runs:
        for a, b in np.frombuffer(runs, np.int64).reshape(2, -1).T.tolist():
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], b + width - 1))
            else:
                out.append((a, b + width - 1))
    return out


def _kept(texts: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                raw, spans = text.as_py().encode("utf-8", "surrogatepass"), spans_of(runs.as_py(), width)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                rows.append((sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest()))
            removed, n, sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["key", "n_removed", "n_spans", "kept_sha256"])

    return texts.select("key", "text", "runs").mapInArrow(run, "key string, n_removed long, n_spans long, kept_sha256 string")


def repeated_spans(spark: SparkSession, docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Texts (key, text, runs) with the windows to remove, and ids (key, least): the smallest id of each text."""
    scratch = Scratch(spark)
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = docs.groupBy("key").agg(F.min("doc_id").alias("least"), F.first(F.octet_length("text")).cast("long").alias("bytes"))
    ids = scratch.keep(sizes)
    total = ids.agg(F.sum("bytes").alias("b")).first().b or 0
    buckets = int(max(16, total // BUCKET_BYTES))
    texts = _distinct_texts(scratch, docs, total)
    posted = _posted(texts, buckets, width).groupBy("bucket").applyInPandas(_shared, "chunk string, kind int, low binary, place binary, known binary")
    shared = scratch.keep(posted.groupBy("chunk").applyInPandas(_by_text, "key string, shared binary"))
    strings = _strings(texts.join(shared, "key").join(ids.select("key", "least"), "key"), buckets * FINER, width)
    covered = strings.groupBy("bucket").applyInPandas(_covered(width), _STRINGS.replace("bucket int, ", ""))
    runs = scratch.keep(covered.groupBy("chunk").applyInPandas(_runs_by_text, "key string, runs binary"))
    return texts.join(runs, "key", "left"), ids.drop("bytes")


def remove_repeats(spark: SparkSession, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, a row per row of docs."""
    texts, ids = repeated_spans(spark, docs, width)
    per_text = _kept(texts, width).join(ids, "key")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.md5(text).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"))
    # a later copy of a text goes whole: each of its windows starts in the first copy
    whole = (F.coalesce("doc_id", F.lit(NO_ID)) > F.col("least")) & (F.col("n_bytes") >= width)
    return rows.join(per_text, "key").select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(whole, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
