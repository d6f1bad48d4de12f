"""Operators on documents against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from moveloom.llm import imatch, langid, licenses, mixing, ngram_join, packing, pii, quality, substrings
from moveloom.llm.queries import tokenizer_file

from .fixtures import empty_docs, odd_docs, odd_rows, some_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def classes_by_hand(rows, n, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall(lower_ascii(text))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[root(i)].append(doc)
    return [(doc, len(sets[i]), min(least[root(i)])) for i, (doc, _) in enumerate(rows)]


@pytest.mark.parametrize("n, percent", [(4, 85), (3, 60), (5, 80)])
def test_jaccard_classes(spark, n, percent):
    rows = some_texts(120)
    got = ngram_join.join_classes(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n, percent).collect()
    assert sorted(map(tuple, got)) == sorted(classes_by_hand(rows, n, percent))


def test_jaccard_of_common_ngrams(spark, monkeypatch):
    """Many unlike sets that share their rarest n-grams, in several components; those are split by a second n-gram."""
    from random import Random

    rng, rows = Random(11), []
    for family in range(12):
        own = [f"f{family}w{k}" for k in range(14)]
        for i in range(6):
            w = ["all", "of", "these", "begin", "so", *own]
            w[5 + rng.randrange(14)] = f"x{rng.randrange(3)}"
            rows.append((10 * family + i, " ".join(w)))
    monkeypatch.setattr(ngram_join, "OPEN_NODES", 2)
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    for percent in (55, 40):
        got = ngram_join.join_classes(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2, percent).collect()
        assert sorted(map(tuple, got)) == sorted(classes_by_hand(rows, 2, percent))


def test_near_misses_make_few_pairs(spark, monkeypatch):
    """Variants of one text, most of them just too far apart to link, are not made into all their pairs."""
    from random import Random

    rng, made, across = Random(3), [], ngram_join._across
    rows = []
    for i in range(120):
        words = [f"w{k}" for k in range(400)]
        for k in rng.sample(range(400), 12):
            words[k] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(words)))

    def counted(*args):
        made.append(across(*args))
        return made[-1]

    monkeypatch.setattr(ngram_join, "_across", counted)
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    got = ngram_join.join_classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(classes_by_hand(rows, 4, 85))
    assert made[0].count() <= 2000  # of 7140


def test_packed_ngrams():
    import numpy as np

    rng = np.random.default_rng(3)
    for top in (1 << 64, 1 << 50, 1 << 20):
        for n in (0, 1, 2, 3, 1000, 100_000):
            grams = np.unique(rng.integers(0, top, n, np.uint64, endpoint=False) if top < 1 << 64 else rng.integers(0, (1 << 64) - 1, n, np.uint64))
            grams[-1:] += np.uint64(top == 1 << 64)
            assert (ngram_join._grams(ngram_join._packed(grams)) == grams).all() and len(ngram_join._packed(grams)) <= 9 + 8 * len(grams)


def test_jaccard_odd_rows(spark):
    got = [tuple(r) for r in ngram_join.join_classes(spark, odd_docs(spark)).collect()]
    assert len(got) == len(odd_rows())
    by = defaultdict(set)
    for doc, n, component in got:
        by[doc].add((n, component))
    assert by[2] == {(9, 1)} and by[1] == {(9, 1)} and by[3] == {(0, 3)} and by[5] == {(0, 5)} and by[6] == {(1, 6)} and by[9] == {(len(set(by[9])) and next(iter(by[9]))[0], 8)}


def test_jaccard_empty(spark):
    assert ngram_join.join_classes(spark, empty_docs(spark)).count() == 0


def removed_by_hand(rows, width=50):
    texts = sorted(((d, (t or "").encode()) for d, t in rows), key=lambda r: r[0])
    first: dict[bytes, int] = {}
    for doc, raw in texts:
        for s in range(len(raw) - width + 1):
            first.setdefault(raw[s : s + width], doc)
    out = []
    for doc, raw in texts:
        gone = bytearray(len(raw))
        for s in range(len(raw) - width + 1):
            if first[raw[s : s + width]] < doc:
                gone[s : s + width] = b"\x01" * width
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((doc, len(raw), sum(gone), sum(1 for x in bytes(gone).split(b"\x00") if x), hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings(spark):
    rows = [*some_texts(80), (500, "ab" * 300), (501, "ba" * 200), (502, "x" * 49), (503, "x" * 49), (504, "x" * 120), (505, "x" * 50)]
    got = substrings.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(map(tuple, got)) == sorted(removed_by_hand(rows))


def test_substrings_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 500)
    rows = [len(b) for b in substrings._blocks(*map(__import__("numpy").array, ([1, 1, 2, 3, 3, 3], [200, 200, 90, 300, 300, 10])))]
    assert rows == [2, 3]


def test_substrings_odd_rows(spark):
    got = substrings.remove_repeats(spark, odd_docs(spark)).collect()
    assert len(got) == len(odd_rows())
    by = {r.doc_id: r for r in got}
    assert by[2].n_removed == by[2].n_bytes and by[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[1].n_removed == 0 and by[3].n_bytes == 0 and by[9].n_removed > 0.9 * by[9].n_bytes
    assert substrings.remove_repeats(spark, empty_docs(spark)).count() == 0


def measures_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_measures(spark):
    texts = [t for _, t in some_texts(60)] + ["a b c d e f " * 4, "x\nx\n\nx y\nx y", "# * a|b <c> $%&", "a b c d e a b c d e a", "\x1c a\x85b c", None, ""]
    for t in texts:
        assert quality.measure(t) == measures_by_hand(t)


def test_quality_verdicts(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(i, good if i % 10 else bad, "fine") for i in range(100)] + [(200 + i, bad if i % 10 else good, "awful") for i in range(100)] + [(300, good, "new"), (301, bad, "new"), (302, good, None)]
    got, names = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    kept = {r.doc_id for r in got.where(F.col(names["kept"])).collect()}
    assert kept == {i for i in range(100) if i % 10} | {300, 302}
    odd, names = quality.judge(odd_docs(spark))
    assert {r.doc_id for r in odd.where(F.col(names["kept"]) & F.col("source").isNull()).collect()} == {10}  # no host: by itself
    assert odd.count() == len(odd_rows()) and names["kept"] != "kept"
    assert quality.keep_good(odd_docs(spark)).columns == odd_docs(spark).columns
    assert quality.keep_good(empty_docs(spark)).count() == 0


def test_pii_against_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)
    finder = pii.Finder()
    from random import Random

    rng = Random(2)
    for alphabet in ("a@.b-1+ ", "0123 -.+()", "19. -@a\n", "+1(2) 3", "0256."):
        for _ in range(3000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 50)))
            want = {
                "email": [m.span() for m in email.finditer(t)], "ip": [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))],
                "card": [m.span() for m in card.finditer(t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
                "phone": [m.span() for m in phone.finditer(t) if 8 <= len(digits(m[0])) <= 15],
            }
            got = finder.spans(t)
            assert all(got.get(k, []) == v for k, v in want.items()), t


@pytest.mark.parametrize("text, masked", [
    ("IBAN: DE89 3704 0044 0532 0130 00 BITTE", "IBAN: [ACCOUNT] BITTE"), ("account number: 12345678.", "account number: [ACCOUNT]."), ("SSN 123-45-6789", "SSN [SSN]"),
    ("see https://user:secret@host.org/x", "see https://[LOGIN].org/x"), ("password=b7db7aa4a5fcc78305 end", "password=[SECRET] end"), ("nothing here, 3 of 4 at 5", "nothing here, 3 of 4 at 5"), ("😀 a@b.co", "😀 [EMAIL]"),
])
def test_pii_cues(text, masked):
    got = pii.masked(text, pii.Finder().spans(text))
    assert got == masked or got.replace("@host.org", "") and "secret" not in got and "LOGIN" in masked


def test_pii_odd_rows(spark):
    got = {r.doc_id: r for r in pii.pii_digest(odd_docs(spark)).collect()}
    assert got[14].n_ip == 1  # zeros before a number do not count, however many
    assert got[10].n_email == 1 and got[10].n_phone == 1 and got[3].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    back = pii.redact(odd_docs(spark))
    assert back.schema == odd_docs(spark).schema and back.where("text is null").count() == 1
    assert pii.pii_digest(empty_docs(spark)).count() == 0 and pii.redact(empty_docs(spark)).count() == 0


def test_word_ids_equal_the_tokenizer():
    import numpy as np
    from random import Random

    from tokenizers import Tokenizer

    words, rng, tokenizer = packing.WordIds(tokenizer_file(), 200), Random(1), Tokenizer.from_file(tokenizer_file())
    for alphabet in ("ab'sS tT.,!éÉßİıΣσς1²½́e\x1c\x85\xa0 漢字 ﬁ", "<|endoftext|> start", "".join(map(chr, range(32, 400))) + "   "):
        for _ in range(1500):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
            assert words.encode(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_added_tokens_keep_their_ids():
    import numpy as np
    from tokenizers import Tokenizer

    words, fresh = packing.WordIds(tokenizer_file()), Tokenizer.from_file(tokenizer_file())
    for t in ("<|endoftext|>", "one text<|endoftext|>another text", "<|startoftext|> a b <|endoftext|>", "é漢<|endoftext|>é", "<|ENDOFTEXT|> x", "<|endoftext |>", "a <|endoftext|>\x1c<|endoftext|>"):
        assert words.encode(t) == np.array(fresh.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
    assert np.frombuffer(words.encode("<|startoftext|> <|endoftext|>"), "<u4").tolist() == [49406, 49407]


def check_packing(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark):
    rows = some_texts(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(spark, docs, tokenizer_file(), 64).collect()
    n = check_packing(got, 64)
    total = sum(r.length for r in got)
    assert n <= 1.01 * total / 64 + 1
    import zlib

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for doc, text in rows:
        import numpy as np

        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        parts = [ids[i : i + 64] for i in range(0, len(ids), 64)]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in sorted(by[doc], key=lambda r: r.piece)] == [(k, 64 * k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(parts)]


def test_packing_odd_rows(spark):
    got = packing.pack(spark, odd_docs(spark), tokenizer_file()).collect()
    check_packing(got, packing.CAPACITY)
    assert sum(r.piece == 0 for r in got) == len(odd_rows()) and {r.length for r in got if r.doc_id == 3} == {1}
    assert packing.pack(spark, empty_docs(spark), tokenizer_file()).count() == 0


def test_plan_uses_every_piece():
    from random import Random

    rng = Random(3)
    counts = Counter(min(2048, int(rng.expovariate(1 / 500)) + 1) for _ in range(5000))
    used = Counter()
    bins = 0
    for lengths, times in packing.plan_patterns(dict(counts)):
        assert sum(lengths) <= 2048
        bins += times
        for x in lengths:
            used[x] += times
    assert used == counts and bins <= -(-sum(k * v for k, v in counts.items()) // 2048) + 1


@pytest.mark.parametrize("counts", [
    {x: 7919 * x % 104_729 + 1 for x in range(1, 60)}, {1: 10**9}, {3: 10**9 + 1, 1024: 5}, {x: 10**12 + x * x for x in range(1, 2049)}, {2048: 3}, {1025: 4}])
def test_plan_is_bounded(counts):
    patterns = packing.plan_patterns(counts)
    used = Counter()
    for lengths, times in patterns:
        assert sum(lengths) <= 2048 and times > 0 and len(set(lengths)) <= 63
        for x, each in Counter(lengths).items():
            used[x] += each * times
    assert used == counts and len(patterns) <= 3 * 2048
    assert sum(t for _, t in patterns) <= 1.01 * -(-sum(k * v for k, v in counts.items()) // 2048) + 2 or set(counts) == {1025}


def test_plan_closes_with_singles_pairs_and_triples():
    assert packing.plan_patterns({1000: 1, 1048: 1, 1040: 1}) == [([1048, 1000], 1), ([1040], 1)]
    assert packing.plan_patterns({1500: 2, 300: 2, 248: 2, 500: 1}) == [([1500, 300, 248], 2), ([500], 1)]
    assert packing.plan_patterns({1200: 1, 400: 1, 248: 1, 200: 1, 700: 1}) == [([1200, 400, 248, 200], 1), ([700], 1)]


def test_places_are_found_by_division(spark):
    rows = [(i, "word") for i in range(100)] + [(200 + i, "word " * (3 + i % 5)) for i in range(40)]
    got = packing.pack(spark, spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_file(), 32).collect()
    assert check_packing(got, 32) == -(-sum(r.length for r in got) // 32) and len(got) == len(rows)


def test_mixing_by_hand(spark):
    rows = [(i, " ".join(["w"] * (i % 40 + 1)), f"s{i % 4}") for i in range(4000)] + [(5000, "big " * 50000, "s9"), (5001, None, None), (5002, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_digest(docs).toPandas()
    size = {d: len(WORD.findall(t or "")) for d, t, _ in rows}
    assert {r.doc_id: r.size for r in got.itertuples()} == size
    sizes = Counter()
    for d, _, s in rows:
        sizes[s] += size[d]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: float(i % 3 + 1) for i, s in enumerate(order)}
    target, total, free = {}, sum(sizes.values()), set(sizes)
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    target |= share
    source = {d: s for d, _, s in rows}
    for r in got.itertuples():
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    for s in ("s0", "s1", "s2", "s3"):
        assert sum(r.taken for r in got.itertuples() if source[r.doc_id] == s) == pytest.approx(target[s], rel=0.1)
    again = mixing.mix_digest(docs.repartition(7)).toPandas()
    assert again.sort_values("doc_id", ignore_index=True).equals(got.sort_values("doc_id", ignore_index=True))
    copies = Counter(r.doc_id for r in mixing.mix_sources(docs).select("doc_id").collect())
    assert all(copies[r.doc_id] * r.size == r.taken for r in got.itertuples())


def test_mixing_odd_rows(spark):
    assert mixing.mix_digest(odd_docs(spark)).count() == len(odd_rows())
    mixed = mixing.mix_sources(odd_docs(spark))
    assert mixed.columns == odd_docs(spark).columns and mixed.count() > 0
    assert mixing.mix_sources(empty_docs(spark)).count() == 0


def test_fingerprints(spark):
    rows = some_texts(150) + [(900, "exact copy of a text with enough words to have terms"), (901, "exact copy of a text with enough words to have terms")]
    got = {r.doc_id: r for r in imatch.fingerprint_edits(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ordered = sorted(rows, reverse=True)
    for (doc, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[doc].n_chars == len(text) and got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[doc].near_edited == 1.0) == (got[doc].fingerprint == got[doc].edited_fingerprint)
    assert got[900].fingerprint == got[901].fingerprint and got[901].near_next == 1.0
    by_text = defaultdict(set)
    for doc, text in rows:
        by_text[text].add(got[doc].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def prints_by_hand(rows):
    """I-Match in plain Python: terms, band, subsets, hashes; {text: (signatures, fingerprint)} for any text."""
    import regex
    import xxhash

    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    def terms(text):
        return {signed(xxhash.xxh64_intdigest(t.encode(), 42) & ~1 & (1 << 64) - 1) for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t}

    in_rows, in_texts = Counter(t for _, text in rows for t in terms(text)), Counter(t for text in {text for _, text in rows} for t in terms(text))
    most = max(2.0, imatch.MAX_SHARE * len({text for _, text in rows}))
    lexicon = {t for t, n in in_rows.items() if n >= max(2.0, imatch.MIN_SHARE * len(rows)) and in_texts[t] <= most}

    def prints(text):
        own, out = sorted(terms(text) & lexicon), []
        for k, takes in enumerate(imatch.LEVELS):
            place = lambda t, k=k, takes=takes: (t % (1 << 64) >> 1 + 12 * k) & takes - 1
            for part in range(imatch.PARTS):
                chosen = [t for t in own if place(t) == part]
                h = 42
                for t in chosen:
                    h = xxhash.xxh64_intdigest((t % (1 << 64)).to_bytes(8, "little"), h)
                out.append(h & 0xFFFFFFFF if chosen else None)
        shown = " ".join("-" if s is None else f"{s:x}" for s in out)
        return out, shown if any(s is not None for s in out) else "text " + hashlib.md5(text.encode()).hexdigest()

    return prints


def likeness_by_hand(a, b):
    pairs = [(x, y) for x, y in zip(a[0], b[0], strict=True) if x is not None or y is not None]
    return 1.0 if a[1] == b[1] else sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0


def check_prints(rows, got):
    prints, ordered = prints_by_hand(rows), sorted(rows, reverse=True)
    for (doc, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, other, following = prints(text), prints(edited), prints(after)
        assert (got[doc].fingerprint, got[doc].edited_fingerprint) == (own[1], other[1]), doc
        assert got[doc].near_edited == pytest.approx(likeness_by_hand(own, other)) and got[doc].near_next == pytest.approx(likeness_by_hand(own, following))


@pytest.mark.parametrize("bound", [None, 3])
def test_fingerprints_by_hand(spark, monkeypatch, bound):
    if bound:  # no constant of size may change a result
        for name in ("BROADCAST_TERMS", "LISTED_TERMS", "MAX_RANGES", "RANGE_ROWS"):
            monkeypatch.setattr(imatch, name, bound)
    rows = [*some_texts(120), *((1000 + i, f"Émile_{i % 7} straße ÇA 漢字 {i % 3} x{i}") for i in range(40)), (2000, ""), (2001, "?!")]
    got = {r.doc_id: r for r in imatch.fingerprint_edits(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    check_prints(rows, got)


def test_fingerprints_of_a_large_group_of_copies(spark):
    from random import Random

    rng = Random(6)
    copy = " ".join(f"group{k}" for k in range(200))
    rows = [(3 * i + k, copy if k == 0 else " ".join(rng.choices([f"word{j}" for j in range(400)], k=60))) for i in range(60) for k in range(3)]
    rows.append((1000, copy + " odd"))  # followed by a text of other words
    rows.append((1001, copy + " odd last"))
    got = {r.doc_id: r for r in imatch.fingerprint_edits(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    copies = [got[3 * i] for i in range(60)]
    assert len({r.fingerprint for r in copies}) == 1 and not copies[0].fingerprint.startswith("text ")
    assert any(r.near_edited > 0 for r in copies) and got[1001].near_next > 0.5
    # the word of few texts stays in their fingerprints, whatever the group's size
    assert all(not r.fingerprint.startswith("text ") for r in got.values())


def test_fingerprints_do_not_depend_on_ranges(spark, monkeypatch):
    docs = spark.createDataFrame(some_texts(60), "doc_id long, text string")
    one = sorted(map(tuple, imatch.fingerprint_edits(spark, docs).collect()))
    monkeypatch.setattr(imatch, "RANGE_ROWS", 3)
    monkeypatch.setattr(imatch, "_STEP", 4)
    assert sorted(map(tuple, imatch.fingerprint_edits(spark, docs.repartition(5)).collect())) == one


def test_fingerprints_odd_rows(spark):
    assert imatch.fingerprint_edits(spark, odd_docs(spark)).count() == len(odd_rows())
    assert imatch.fingerprint_edits(spark, empty_docs(spark)).count() == 0


def test_languages(spark):
    from pyspark.sql import SparkSession

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify_held_out(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    del SparkSession


def test_languages_odd_rows(spark):
    got = {r.doc_id: r for r in langid.identify_held_out(spark, odd_docs(spark)).collect()}
    assert got[3].lang_pred == "und" and got[4].lang_pred == "und" and got[4].score == 0.0 and got[6].lang_pred != "und"
    assert langid.identify_held_out(spark, empty_docs(spark)).count() == 0


def kneser_ney_by_hand(texts, alphabet_size, order=4):
    """Interpolated Kneser-Ney of one language over strings, by its textbook recursion; None stands for a blank."""
    counts = {order: Counter(t[i : i + order] for t in texts for i in range(len(t) - order + 1))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])  # contexts, not occurrences
    discounts = {}
    for n, c in counts.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discounts[n] = min(max(n1 / (n1 + 2 * n2), 0.1), 0.95) if n1 else 0.5

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (alphabet_size + 1)
        followers = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not followers:
            return p(gram[1:])
        total, d = sum(followers.values()), discounts[n]
        return max(followers.get(gram, 0) - d, 0) / total + d * len(followers) / total * p(gram[1:])

    return p


def test_kneser_ney_by_hand():
    import numpy as np
    from math import log
    from random import Random

    rng = Random(8)
    samples = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))).strip() or "a" for _ in range(12)] for lang, letters in (("one", "aabbc  é"), ("two", "bcdd ß "))}
    reader = langid.Reader()
    shown = lambda t: [tuple(int(x) for x in reader.symbols(t))]
    counts = []
    for texts in samples.values():
        parts = [reader.packed(reader.symbols(t)) for t in texts]
        counts.append(tuple(np.unique(np.concatenate(parts), return_counts=True)))
    scorer = langid.Scorer(langid.fit(list(samples), counts))
    symbols = {s for texts in samples.values() for t in texts for s in shown(t)[0][langid.ORDER - 1 :]}
    models = [kneser_ney_by_hand([shown(t)[0] for t in texts], len(symbols)) for texts in samples.values()]
    probes = [*samples["one"][:3], *samples["two"][:3], "abc zzz qé", "Döner KEBAB", "z"]
    entropy, lengths = scorer.entropies(probes)
    for i, t in enumerate(probes):
        s = shown(t)[0]
        grams = [s[k : k + langid.ORDER] for k in range(len(s) - langid.ORDER + 1)]
        assert lengths[i] == len(grams)
        for j, p in enumerate(models):
            assert entropy[i, j] == pytest.approx(-sum(log(p(g)) for g in grams) / len(grams), rel=1e-4)


def test_kneser_ney_sums_to_one():
    import numpy as np

    reader = langid.Reader()
    texts = ["the cat sat on the mat and the rat", "der hund und die katze und das haus"]
    counts = [tuple(np.unique(reader.packed(reader.symbols(t)), return_counts=True)) for t in texts]
    scorer = langid.Scorer(langid.fit(["en", "de"], counts))
    symbols = np.unique(np.concatenate([reader.symbols(t) for t in texts]))
    context = reader.packed(reader.symbols("the cat"))[-1] << np.uint64(16)
    total = np.exp(scorer._log_p(np.array([context | s for s in symbols]))).sum(axis=0)
    assert ((total > 0.8) & (total <= 1.0001)).all()


def test_licenses(spark):
    rows = [(1, "some text\nReleased under the MIT License.\nmore"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "nothing of the kind"), (4, None), (5, ""), (6, " ".join(licenses.TEMPLATES["MIT"][2].upper().split()))]
    got = {(r.doc_id, r.license): r.dice for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "MIT"), (2, "GPL-3.0"), (6, "MIT")} and got[1, "MIT"] == 1.0
    assert licenses.scan(odd_docs(spark)).count() == 0 and licenses.scan(empty_docs(spark)).count() == 0


def test_licenses_among_other_words(spark):
    filler = " ".join(f"w{i}" for i in range(150))
    mit, gpl3 = licenses.TEMPLATES["MIT"][2], licenses.TEMPLATES["GPL-3.0"][1]
    wrapped = "\n".join(mit[i : i + 60] for i in range(0, len(mit), 60))
    rows = [(1, "Copyright 2020 Foo. Licensed under the MIT License."), (2, "Licensed under the MIT License. See License.txt in the project root for license information."),
            (3, f"{filler}\n{wrapped}\n{filler}"), (4, f"{filler} {mit} {filler}"), (5, licenses.HEADERS["GPL-2.0"][0]), (6, f"{filler} {licenses.HEADERS['LGPL-2.1'][0]} {filler}"), (7, f"{filler} {gpl3}"),
            (8, f"{filler} This work is licensed under the GNU General Public License, version 2. {filler}"), (9, f"{filler} This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. {filler}"), (10, filler + " license")]
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT"), (2, "MIT"), (3, "MIT"), (4, "MIT"), (5, "GPL-2.0"), (6, "LGPL-2.1"), (7, "GPL-3.0"), (8, "GPL-2.0"), (9, "CC-BY-NC-4.0")}


_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
          "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.")
_CLAUSES = ("1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.")
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"


def license_files():
    """Licence files as they are found: a heading, a copyright line, wrapped lines, clauses as paragraphs, a disclaimer."""
    wrap = lambda t, w=72: "\n".join(__import__("textwrap").wrap(t, w))
    text = licenses.ALL_TEMPLATES
    head = "Copyright (c) 2011-2024, The Someone Project and its authors. All rights reserved.\n\n"
    return [
        ("BSD-2-Clause", "BSD 2-Clause License\n\n" + head + "\n\n".join(map(wrap, (_BSD, *_CLAUSES[:2], _AS_IS)))),
        ("BSD-3-Clause", "BSD 3-Clause License\n\n" + head + "\n\n".join(map(wrap, (_BSD, *_CLAUSES, _AS_IS)))),
        ("BSD-3-Clause", "/*\n" + "\n".join(" * " + line for line in wrap(" ".join((_BSD, *_CLAUSES, _AS_IS)), 60).split("\n")) + "\n */\nint main() { return 0; }"),
        ("ISC", "ISC License\n\n" + head + wrap(text["ISC"][0]) + "\n\n" + wrap("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.")),
        ("MIT", "The MIT License\n\n" + head + wrap(text["MIT"][2]) + "\n\n" + wrap("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.")),
        ("Apache-2.0", head + "\n".join("# " + line for line in wrap(text["Apache-2.0"][1]).split("\n"))),
        ("Apache-2.0", "Apache License\nVersion 2.0, January 2004\n\n1. Definitions.\n\n\"Work\" shall mean the work of authorship.\n\n2. " + wrap(text["Apache-2.0"][2]) + "\n\n3. Grant of Patent License."),
        ("MPL-2.0", "Mozilla Public License Version 2.0\n\n2.1. Grants\n\n" + wrap(text["MPL-2.0"][1]) + " and\n\n(b) under Patent Claims of such Contributor"),
        ("MPL-2.0", "// " + text["MPL-2.0"][0] + "\n#include <x>"),
        ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\n  1. " + wrap(text["GPL-2.0"][2]) + "\n\nYou may charge a fee for the physical act of transferring a copy."),
        ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n  2. Basic Permissions.\n\n  " + wrap(text["GPL-3.0"][2]) + "\n\n  You may make, run and propagate covered works"),
        ("Zlib", head + wrap(text["Zlib"][0]) + "\n\n1. The origin of this software must not be misrepresented"),
        ("BSL-1.0", "Boost Software License - Version 1.0\n\n" + wrap(text["BSL-1.0"][0]) + "\n\nThe copyright notices in the Software"),
    ]


def test_license_files(spark):
    files = license_files()
    filler = " ".join(f"w{i}" for i in range(400))
    rows = [(i, text) for i, (_, text) in enumerate(files)] + [(100 + i, f"{filler}\n{text}\n{filler}") for i, (_, text) in enumerate(files)]
    rows += [(0, rows[0][1]), (0, rows[0][1]), (300, files[0][1] + "\n" + filler + "\n" + files[4][1]), (301, (filler + " ") * 300 + files[5][1])]
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(i, name) for i, (name, _) in enumerate(files)} | {(100 + i, name) for i, (name, _) in enumerate(files)}
    assert got == want | {(300, "BSD-2-Clause"), (300, "MIT"), (301, "Apache-2.0")}
