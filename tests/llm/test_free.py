"""BPE, n-gram join, suffix and block dedup, classifier and pipeline against plain Python."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from recordworks.llm import block_dedup, bpe, classifier, ngram_join, queries, suffix_dedup

from .edge import empty, frame, texts

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def tokens(docs):
    return bpe.encoded(docs, RANK_FILE, public_tokenizers.PATTERN)


@pytest.mark.parametrize("operator", [tokens, ngram_join.similar_groups, suffix_dedup.without_repeats, block_dedup.without_repeats,
                                      lambda d: classifier.scored(d, classifier.fit([], (0.0, 0.0)))])
def test_empty_tables_and_carried_columns(spark, operator):
    out = operator(empty(spark))
    assert out.count() == 0 and len(set(out.columns)) == len(out.columns)
    row = operator(frame(spark, [(5, "some text")])).first()
    assert row["doc_id"] == 5 and row["row"] == "x" and row["block"] == "x"


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANK_FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_rows(spark, reference):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tokens(frame(spark)).collect())
    want = Counter()
    for i, t in texts():
        ids = reference.encode_ordinary(t or "")
        want[i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())] += 1
    assert got == want


def test_bpe_random_strings(reference):
    pieces, decode, pattern = bpe._codec(open(RANK_FILE, "rb").read(), public_tokenizers.PATTERN)
    rng = random.Random(1)
    for k in range(1500):
        alphabet = ("abcdeinrst ethion", "".join(map(chr, range(0x250))), "漢字かな한국 😀é́ ", "0123 \n\t'sl")[k % 4]
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 50))) * rng.randint(1, 4)
        assert bpe.encode_text(text, pieces, pattern) == " ".join(map(str, reference.encode_ordinary(text)))
    assert len(bpe.encode_text("ab" * 50_000, pieces, pattern)) > 0


def sets_of(text, k):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, k, pct):
    sets = [sets_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in holders[x])
        for j, n in both.items():
            if 100 * n >= pct * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    return sets, [min((x for x in members[find(i)] if x is not None), default=None) for i in range(len(rows))]


@pytest.mark.parametrize("k, pct", [(3, 90), (5, 80)])
def test_ngram_join(spark, k, pct):
    rows = texts()
    sets, roots = components(rows, k, pct)
    want = Counter((i, len(s), r) for (i, _), s, r in zip(rows, sets, roots))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(frame(spark), k, pct).collect()) == want


def test_ngram_join_of_large_classes(spark, monkeypatch):
    """Chains of near copies over several chunks: neighbours link, distant ones don't."""
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    rng, rows = random.Random(5), []
    for c in range(3):
        words = [f"c{c}w{rng.randint(0, 10**9)}" for _ in range(120)]
        for i in range(30):
            words[rng.randrange(120)] = f"x{rng.randint(0, 10**9)}"
            rows.append((1000 * c + 7 * i % 210, " ".join(words)))
    sets, roots = components(rows, 3, 90)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.component_id) for r in ngram_join.similar_groups(docs, 3, 90).collect()) == Counter((i, r) for (i, _), r in zip(rows, roots))
    kept = ngram_join.one_of_each(docs, 3, 90)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots))


@pytest.mark.parametrize("pct", [50, 80, 90, 99])
def test_linked_sets_share_a_segment(pct):
    rng, segments = np.random.default_rng(pct), ngram_join.Segments(pct)
    for n in [1, 2, 3, 5, 9, 17, 31, 32, 33, 64, 127, 500]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            common = int(rng.integers(0, n + 1))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[:common]], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 2)), dtype=np.uint64)]))
            if len(b) and ngram_join.linked(a, b, pct):
                assert set(segments.keys(a).tolist()) & set(segments.keys(b).tolist())


def test_suffix_dedup(spark, monkeypatch):
    rows, length = texts(), 100
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    want = Counter()
    for (doc_id, _), d in zip(rows, data):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        want[doc_id, len(d), int(gone.sum()), runs, sha(bytes(b for b, g in zip(d, gone) if not g))] += 1
    for most in (256, 1):  # bins, and counted windows
        monkeypatch.setattr(suffix_dedup, "MOST_PIECES", most)
        got = suffix_dedup.without_repeats(frame(spark), length).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


@pytest.mark.parametrize("length", [2, 5, 13])
def test_repeats_in_a_bin(length):
    rng = random.Random(length)
    for _ in range(150):
        base = bytes(rng.choice(b"ab") for _ in range(80))
        parts = [base[(x := rng.randint(0, 60)) : x + rng.randint(0, 60)] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(1, 6))]
        seen = Counter(t[i : i + length] for t in parts for i in range(len(t) - length + 1))
        want = [[i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1] for t in parts]
        assert [x.tolist() for x in suffix_dedup.repeated_in(parts, length)] == want


def test_block_dedup(spark):
    rows = texts()
    order = lambda i: 1 << 63 if i is None else i
    least = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - 12):
            key = tuple(w[p : p + 13])
            least[key] = min(least.get(key, 1 << 64), order(i))
    want = Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {q for p in range(len(w) - 12) if least[tuple(w[p : p + 13])] < order(i) for q in range(p, p + 13)}
        want[i, len(w), len(gone), sha(" ".join(x for q, x in enumerate(w) if q not in gone).encode())] += 1
    got = block_dedup.without_repeats(frame(spark), cell_bits=18)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == want


def test_classifier_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.train(docs, labels)
    rows = classifier.scored(docs, model).join(labels.select("doc_id", "quality"), "doc_id").collect()
    held = [(r.score, r.quality) for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    good, poor = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in poor) > 0.9 * len(good) * len(poor)
    edge = classifier.scored(frame(spark), model).collect()
    blank = {r.score for r in edge if not (r.text or "")}
    assert len(edge) == len(texts()) and len(blank) == 1 and all(not r.held_out for r in edge if r.doc_id is None)


def test_classifier_sample_is_bounded(spark, monkeypatch):
    """An id that very many rows repeat, or that has two labels, is one sample."""
    taken = []
    monkeypatch.setattr(classifier, "fit", lambda samples, shares: taken.append((samples, shares)))
    docs = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7L ELSE id + 10 END AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(7, 1), (7, 1), *[(i, i % 2) for i in range(10, 400)], (11, 1), (12, None)], "doc_id long, quality int")
    classifier.train(docs, labels, max_rows=40)
    samples, shares = taken[0]
    assert 20 < len(samples) <= 40 and sum(s[2] for s in samples) <= 20 and abs(sum(shares) - 1) < 1e-9


def test_classifier_without_labels(spark):
    model = classifier.train(frame(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert model.score(b"anything") == 0.5


def test_pipeline_stages(spark):
    docs = frame(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert stage(spark, empty(spark), "").count() == 0
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert last.count() == docs.count() > 0


def test_pipeline_decisions(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    good = corpus_pipeline.keep_good_texts(spark, docs, sf)
    rows = {r.doc_id: r.text for r in good.collect()}
    assert all(len(WORD.findall(t)) >= 50 for t in rows.values())
    single = corpus_pipeline.drop_exact_copies(spark, good, sf)
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]), i)
    assert ids(single) == sorted(first.values())
    left = [(i, rows[i]) for i in sorted(first.values())]
    assert ids(corpus_pipeline.drop_near_copies(spark, single, sf)) == sorted(set(components(left, 5, 80)[1]))


def test_bpe_plain_pattern_splits_alike():
    """The pattern written out for `re` cuts every character below U+10000, and runs of mixed ones, as `regex` does; others are left to `regex`."""
    import regex

    plain, full = bpe.plain_pattern(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN, flags=regex.V1)
    assert plain is not None and bpe.plain_pattern(r"\d+") is None and bpe.plain_pattern(r"(?i)a|\p{L}") is None
    plane = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x10000)]]
    spaced = " ".join(plane) + "".join(f"a{c}1{c} " for c in plane)
    assert plain.findall(spaced) == full.findall(spaced)
    rng, odd = random.Random(5), "a é１2٣\x1c\x1f\x85\xa0\u2028\u3000\n\t's't!漢_ʰ"
    for _ in range(3000):
        text = "".join(rng.choice(odd) for _ in range(rng.randint(1, 30)))
        assert plain.findall(text) == full.findall(text)
    _, _, split = bpe._codec(open(RANK_FILE, "rb").read(), public_tokenizers.PATTERN)
    assert split("x \U0001D400\U0001D401y") == full.findall("x \U0001D400\U0001D401y")


def test_suffix_cores_lose_no_repeat():
    """Pieces of one anchor that share less than a window leave the bin, and what is left has every repeat."""
    rng, kept, whole = random.Random(3), 0, 0
    for k in range(60):
        anchor = bytes(rng.choices(range(97, 123), k=64))
        sides = [bytes(rng.choices(range(97, 123), k=336)) for _ in range(4)]
        texts = []
        for _ in range(rng.randint(2, 8)):  # up to a few bytes around the window's length are shared
            left, right = rng.randint(0, 336), rng.randint(0, 336)
            other = bytes(rng.choices(range(97, 123), k=672))
            texts.append(other[:336] + rng.choice(sides[:2])[336 - left :] + anchor + rng.choice(sides[2:])[:right] + other[336:])
        texts = [t for t in dict.fromkeys(texts) if len(t) >= 400]
        h = int(suffix_dedup.Text(anchor).grams(64).view("int64")[0])
        spans = suffix_dedup.cores_shared(texts, h, 400)
        want = [x.tolist() for x in suffix_dedup.repeated_in(texts, 400)] if texts else []
        part = [(a, x.tolist()) for (a, _), x in zip(spans, suffix_dedup.repeated_in([t[a:b] for t, (a, b) in zip(texts, spans)], 400))] if texts else []
        assert [[a + x for x in found] for a, found in part] == want
        kept, whole = kept + sum(b - a for a, b in spans), whole + sum(map(len, texts))
    assert kept < whole / 2


def test_suffix_bins_are_dealt_by_their_bytes(spark, monkeypatch):
    """What one task of the bins gets stays the same however many pieces there are, and all repeats are found."""
    rng, seen, binned = random.Random(21), [], suffix_dedup._binned
    fresh = lambda n: "".join(rng.choices("abcdefghijklmnoprst", k=n))
    monkeypatch.setattr(suffix_dedup, "TASK_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "_binned", lambda cut, *more: seen.append((cut, binned(cut, *more))) or seen[-1][1])
    for pairs in (20, 200):
        rows = []
        for _ in range(pairs):
            shared = fresh(420)
            rows += [fresh(400) + "A" + shared + "B" + fresh(400), fresh(400) + "C" + shared + "D" + fresh(400)]
        spans = suffix_dedup.repeated_spans(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
        found = [sorted((s.a, s.b) for s in r.spans) for r in spans.collect()]
        assert len(found) == len(rows) and all(min(f)[0] == 401 and max(b for _, b in f) == 821 for f in found)
        cut, marks = seen.pop()
        sizes = cut.select("h", "p", F.length("bytes").alias("size"))
        tasks = marks.select("h", "p", F.spark_partition_id().alias("task")).distinct().join(sizes, ["h", "p"]).groupBy("task").agg(F.sum("size").alias("size"))
        most, total = tasks.agg(F.max("size"), F.sum("size")).first()
        assert most < 60_000 and total > pairs * 800


def test_planted_passages_at_the_querys_length(spark, tmp_path):
    """The registered query on planted passages of over 50 words: caught from 400 bytes on, left alone below, and each row as brute force has it."""
    rng = random.Random(9)
    fresh = lambda n, letters="abcdefghijklmnoprst": "".join(rng.choices(letters, k=n))

    def passage(size, letters="abcdefg", most=5):  # words of a few letters, filled to `size` bytes
        out = ""
        while len(out.encode()) < size - 8:
            out += fresh(min(most, size // 65 - 1), letters) + " "
        return out + fresh(size - len(out.encode()), "xyz")

    passages = [passage(n) for n in (300, 399, 400, 401, 460, 1300)] + [passage(398, "aé漢", 2)[:-1] + "é", passage(399, "aé漢", 2)[:-1] + "é"]
    assert all(len(WORD.findall(p)) > 50 for p in passages) and [len(p.encode()) for p in passages[-2:]] == [399, 400]
    rows, caught = [], {}

    def plant(text, size):
        caught[len(rows)] = size >= 400
        rows.append(text)

    for p in passages:  # in two texts, twice in one text, at both ends; the bytes beside a passage differ
        n = len(p.encode())
        plant(fresh(700) + "A" + p + "B" + fresh(700), n)
        plant(fresh(50) + "C" + p + "D" + fresh(900), n)
        plant("E" + p + "F" + fresh(300) + "G" + p + "H", n)
        plant(p, n)
    hub = passage(420)
    for k in range(300):  # more different pieces than one bin takes
        plant(fresh(400) + chr(33 + k % 15) + hub + chr(65 + k // 15) + fresh(400), 420)
    plant(fresh(5000), 0)
    plant("one two", 0)
    data = [t.encode() for t in rows]
    seen = Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op8_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, d in enumerate(data):
        gone = np.zeros(len(d) + 1, bool)
        for at in range(len(d) - 399):
            if seen[d[at : at + 400]] > 1:
                gone[at : at + 400] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        r = got[i]
        assert (r.n_removed > 0) == caught[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(d), int(gone.sum()), runs, sha(bytes(b for b, g in zip(d, gone) if not g)))
