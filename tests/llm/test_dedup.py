"""Near duplicates, repeated strings and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest

from kinspark.llm import components, lcp, minhash, repeats


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", low) if x]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    """The contract on all pairs."""
    rows = [(d, shingles(t)) for d, t in rows if d is not None]
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d, _ in rows}


def near_copies(seed, n, length, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(length)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i * 7 % 1009, " ".join(w)))
    return rows


def check_linked(spark, rows):
    got = minhash.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want, sets = brute_components(rows), {d: len(shingles(t)) for d, t in rows}
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (sets[r.doc_id], want[r.doc_id], want[r.doc_id] == r.doc_id)


@pytest.mark.parametrize("bound", [512, 8])
def test_near_copies_in_small_work_items(spark, monkeypatch, bound):
    monkeypatch.setattr(minhash, "BUCKET_ROWS", bound)
    monkeypatch.setattr(minhash, "CLUSTER_ROWS", bound)
    check_linked(spark, near_copies(1, 90, 120, 6) + [(2000 + i, t) for i, (_, t) in enumerate(near_copies(2, 40, 60, 3))])


def thue_morse(letters):
    word = "a"
    while len(word) < letters:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_patterned_words_of_one_polynomial_hash_are_not_linked(spark):
    """Thue-Morse words of 1024 letters and more, and texts of that pattern in words."""
    pairs = [thue_morse(n) for n in (1024, 2048, 4096)]
    texts = [t for p in pairs for t in p] + [" ".join(t) for t in pairs[1]]
    check_linked(spark, list(enumerate(texts)) + [(50 + i, t) for i, t in enumerate(texts)])


@pytest.mark.parametrize("bound", [512, 4])
def test_stragglers_of_a_group_of_copies(spark, monkeypatch, bound):
    """Many near copies of one text, chains of texts that drift away from it, and pairs among the stragglers."""
    monkeypatch.setattr(minhash, "BUCKET_ROWS", bound)
    monkeypatch.setattr(minhash, "CLUSTER_ROWS", bound)
    rng = random.Random(8)
    rows, word = [], [f"w{rng.randrange(500)}" for _ in range(200)]
    for i in range(60):
        w = list(word)
        for _ in range(rng.choice([1, 1, 2, 5, 6])):
            w[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((rng.randrange(10**6), " ".join(w)))
    for i in range(40):
        word[rng.randrange(200)] = f"d{rng.randrange(10**6)}"
        rows.append((rng.randrange(10**6), " ".join(word)))
    check_linked(spark, rows)


def test_odd_rows_linked(spark, odd, odd_rows, nothing):
    check_linked(spark, [r[:2] for r in odd_rows])
    assert minhash.linked(nothing).count() == 0
    kept = minhash.deduplicated(odd)
    assert kept.columns == odd.columns
    got = Counter(r.doc_id for r in kept.collect())
    want = brute_components([r[:2] for r in odd_rows])
    assert got == Counter({d: 1 for d, c in want.items() if d == c} | {None: 2})


def test_components_of_chains_and_nothing(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(70, 60), (60, 80), (5, 5)], "a long, b long")
    assert {r.v: r.component for r in components.components(edges).collect()} == {i: 0 for i in range(51)} | {60: 60, 70: 60, 80: 60}
    assert components.components(edges.limit(0)).count() == 0


def brute_removed(rows):
    starts = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - 49):
                w = b[i : i + 50]
                starts[w] = min(starts.get(w, d), d)
    out = Counter()
    texts = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if d is not None:
            for i in range(len(b) - 49):
                if starts[b[i : i + 50]] < d:
                    gone[i : i + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
        texts.append((d, kept.decode("utf-8", "ignore") if d is not None else t))
    return out, texts


def passages(seed):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (20, 49, 50, 51, 90, 300)]
    rows = [(i, "".join(rng.choice([*shared, *("".join(rng.choice("abcé ") for _ in range(40)) for _ in range(4))]) for _ in range(rng.randint(0, 8)))) for i in rng.sample(range(200), 60)]
    return rows + [(500, "ab" * 200), (501, "ab" * 100), (502, "a" * 300), (503, "a" * 120), rows[0]]


@pytest.mark.parametrize(("flush", "parts"), [(2_000_000, 4), (300, 4), (300, 64), (2_000_000, 512)])
def test_repeats(spark, monkeypatch, flush, parts):
    monkeypatch.setattr(repeats, "FLUSH", flush)
    monkeypatch.setattr(repeats, "HOLD", flush)
    monkeypatch.setattr(repeats, "PART_BYTES", 1)
    monkeypatch.setattr(repeats, "partitions", lambda spark: parts)
    rows = passages(4)
    got = repeats.removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert Counter(tuple(r) for r in got.collect()) == brute_removed(rows)[0]


def test_strings_of_one_hash_are_told_apart(monkeypatch):
    rng = random.Random(3)
    words = [bytes(rng.choice(b"ab") for _ in range(50)) for _ in range(4)]
    raw = b"".join(words[i] for i in (0, 1, 2, 0, 1, 3))
    values, start = np.frombuffer(raw, np.uint8), np.arange(6) * 50
    monkeypatch.setattr(repeats.Rolling, "slices", lambda self, a, b: np.zeros(len(a), np.uint64))
    got = repeats.equals(values, repeats.Rolling(values), start, np.array([5, 1, 2, 3, 4, 6]))
    assert got.tolist() == [True, False, False, False, True, False]


def test_rows_sent_follow_the_text_not_the_partitions(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(60))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    sizes = []
    for n in ("4", "300"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found, parts = repeats.gathered(docs)
        sizes.append((parts, found.count()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sizes[1][0] == 1 and sizes[1][1] <= sizes[0][1] + 300


def test_odd_rows_without_repeats(odd, odd_rows, nothing):
    assert Counter(tuple(r) for r in repeats.removed(odd).collect()) == brute_removed([r[:2] for r in odd_rows])[0]
    cut = repeats.without_repeats(odd)
    assert cut.columns == odd.columns
    want = Counter((d, t or ("" if d is not None else t)) for d, t in brute_removed([r[:2] for r in odd_rows])[1])
    assert Counter((r.doc_id, r.text) for r in cut.collect()) == want
    assert repeats.removed(nothing).count() == 0 and repeats.without_repeats(nothing).count() == 0


def test_fingerprints_of_one_text_don_t_hang_on_the_batch(odd_rows):
    texts = [r[1] or "" for r in odd_rows] + ["aaaa", "abab" * 50, "é"]
    whole = lcp.fingerprints(texts)
    assert [x.tolist() for x in whole] == [lcp.fingerprints([t])[0].tolist() for t in texts]


MASK = (1 << 64) - 1


def slow_mix(h):
    h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & MASK
    h = (h ^ h >> 29) * 0xFF51AFD7ED558CCD & MASK
    return h ^ h >> 32


def slow_name(names):
    """The polynomial hash of a phrase's names."""
    total = 0
    for i, v in enumerate(names):
        x = (v + 1) * 0xD6E8FEB86659FD93 & MASK
        total += (x ^ x >> 31) * pow(0x9E3779B97F4A7C15, i, 1 << 64)
    return slow_mix(total + len(names) & MASK)


def slow_labels(names):
    def toss(labels):
        out = []
        for i, v in enumerate(labels):
            diff = 1 if i == 0 else v ^ labels[i - 1]
            place = (diff & -diff).bit_length() - 1 if diff else 0
            out.append(2 * place + (v >> place & 1))
        return out

    for _ in range(4):
        names = toss(names)
    return names


def slow_fingerprint(text):
    """Levels of phrases of one text, a symbol at a time."""
    names, found, level = list(text.encode()), [], 0
    while names:
        level += 1
        runs = [(v, len(list(g))) for v, g in itertools.groupby(names)]
        names = [slow_mix(v + 1 & MASK) if n == 1 else slow_mix(slow_mix(v + 1 & MASK) ^ n) for v, n in runs]
        label = slow_labels(names)
        cuts = [0] + [i for i in range(1, len(names) - 1) if label[i] > label[i - 1] and label[i] > label[i + 1]] + [len(names)]
        names = [slow_name(names[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        if level >= lcp.BASE:
            found += names
            if len(names) == 1:
                break
    return sorted({slow_mix(x) >> 32 for x in found})[: lcp.KEPT]


def test_fingerprints_equal_a_slow_parse(odd_rows):
    rng = random.Random(12)
    texts = [r[1] or "" for r in odd_rows if len(r[1] or "") < 5000] + ["".join(rng.choice("ab ") for _ in range(n)) for n in range(40)] + ["aaaa" * 9, "abab" * 50, "é中🙂" * 5]
    for t, sample in zip(texts, lcp.fingerprints(texts), strict=True):
        assert sample.tolist() == slow_fingerprint(t)


def test_likeness_estimates_the_share_of_common_names():
    rng = random.Random(13)
    for _ in range(50):
        a = rng.sample(range(1 << 32), rng.randint(1, 40))
        b = rng.sample(a, rng.randint(0, len(a))) + rng.sample(range(1 << 32), rng.randint(1, 20))
        x, y = (np.unique(np.array(v, np.uint32)) for v in (a, b))
        assert lcp.likeness(x, y) == pytest.approx(len(set(a) & set(b)) / len(set(a) | set(b)))
    many = [np.unique(np.array(rng.sample(range(1 << 32), 4000), np.uint32)) for _ in range(2)]
    mixed = np.unique(np.concatenate([many[0][::2], many[1][::2]]))
    assert abs(lcp.likeness(many[0][: lcp.KEPT], mixed[: lcp.KEPT]) - 1 / 3) < 0.2


def test_substrings_share_names():
    rng = random.Random(5)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(1500)) for _ in range(2))
    x, y, z = lcp.fingerprints([a, b[:37] + a, b])
    assert lcp.likeness(x, x) == 1.0 and lcp.likeness(x, y) > 0.8 and lcp.likeness(x, z) < 0.05


def test_compare(odd, odd_rows, nothing, spark):
    rows = sorted(((d, t or "") for d, t, *_ in odd_rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter()
    for (d, t), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        x, y, z = lcp.fingerprints([t, edited, after])
        want[d, len(t), hashlib.sha256(edited.encode()).hexdigest(), lcp.spell(x), lcp.spell(y), lcp.likeness(x, y), lcp.likeness(x, z)] += 1
    assert Counter(tuple(r) for r in lcp.compare(odd).collect()) == want
    assert lcp.compare(nothing).count() == 0
    one = lcp.compare(spark.createDataFrame([(1, "abc def")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.n_chars == 7


def one_template(seed, n, words=60, changed=(1, 1, 1, 2, 0)):
    """Texts of one template with a word or two replaced, some by words that others have too, some longer or shorter."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice(changed)):
            w[rng.randrange(len(w))] = rng.choice([f"x{rng.randrange(10**9)}", f"y{rng.randrange(5)}"])
        if rng.random() < 0.2:
            w += [f"t{rng.randrange(40)}"] * rng.randint(1, 3)
        if rng.random() < 0.1:
            del w[: rng.randint(1, 5)]
        rows.append((i * 11 % 100003, " ".join(w)))
    return rows


@pytest.mark.parametrize(("bound", "seed"), [(24, 1), (8, 2), (64, 3)])
def test_texts_of_one_template(spark, monkeypatch, bound, seed):
    monkeypatch.setattr(minhash, "BUCKET_ROWS", bound)
    monkeypatch.setattr(minhash, "CLUSTER_ROWS", bound)
    check_linked(spark, one_template(seed, 260) + [(200000 + i, t) for i, (_, t) in enumerate(near_copies(seed, 40, 80, 4))])


def test_prefixes_meet_all_pairs_at_the_threshold(spark):
    rows = one_template(5, 160, 30, (1, 2, 3, 0)) + near_copies(6, 60, 50, 5)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    texts = spark.createDataFrame(rows, "rep long, text string")
    work = minhash.prefixes(texts, texts.selectExpr("rep", "rep AS comp")).collect()
    by = {}
    for r in work:
        by.setdefault(r.shingle, []).append((r.rep, r.alone))
    met = {tuple(sorted((a, b))) for held in by.values() for a, x in held for b, y in held if a < b and not (x and y)}
    sets = [shingles(t) for _, t in rows]
    close = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert close and close <= met
    assert len(met) < len(rows) ** 2 / 4
