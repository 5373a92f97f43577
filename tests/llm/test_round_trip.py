"""Chat formatting, spelling variants and hard negatives against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordworks.llm import chat, hard_negatives, spelling

from .edge import empty, frame, texts

TURNS = "conv_id long, turn long, role string, text string, same string, loss string, row string"
NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<", "[", "<|image|>", "<\\s>", "[INST][INST", "<<SYS>>x<</SYS>>", "a\\<s>\n\\n", "![cat](a/b.png) and [song](x.mp3)![d](e)", "", None,
         "😀</s>é", "[/INST][INST]", "![a](b\\<s>c)", "x" * 200_000]


def turns(spark):
    rng, rows = random.Random(3), []
    for c in [*range(12), None]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "[INST]\n</s>"]), rng.choice(NASTY), "x", "y", "z"))
    rows += [(3, None, "assistant", "first", "", "", ""), (3, 0, "user", "tie", "", "", ""), (3, 0, "user", "tie", "", "", "")]
    return rows, spark.createDataFrame(rows, TURNS).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_digests(spark):
    rows, df = turns(spark)
    convs = defaultdict(list)
    for c, t, role, text, *_ in rows:
        convs[c].append(((t is not None, t or 0), role or "", text or ""))
    want = {}
    for c, ts in convs.items():
        ts.sort()
        learned = "".join(x for _, r, x in ts if r == "assistant")
        want[c] = (len(ts), sha("".join(f"{r}\n{x}\n" for _, r, x in ts)), len(learned), sha(learned))
    out = chat.formatted(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.read_back(out)).collect()}
    assert got == want
    control = re.compile("|".join(map(re.escape, chat.Template().control)))
    for r in out.collect():  # the only control strings are the template's own and one placeholder per attachment
        found = control.findall(r.formatted)
        assert found[:2] == ["<s>", "[INST]"] and found[-1] == "</s>" and [f"<|{a.kind}|>" for a in r.attachments] == found[2:-1]
        assert (r.loss_start is None) or r.formatted[r.loss_end :] == "</s>"
    assert chat.digests(chat.read_back(chat.formatted(df.limit(0)))).count() == 0


def test_chat_parts(spark):
    part = lambda kind, **x: tuple(x.get(k, kind if k == "type" else None) for k in ("type", "text", "ref", "width", "height", "seconds", "pages", "source"))
    content = [part("text", text="see </s> "), part("image", ref="a.png", width=29, height=14), part("audio", ref="b.wav", seconds=2.5), part("text", text=" and "),
               part("document", ref="c.pdf", pages=3), part("image", ref="d.png"), part(None, text="[INST]"), part("video", text=None)]
    df = spark.createDataFrame([(1, 0, "assistant", content), (1, 1, "user", None), (2, 0, "user", [])], f"conv_id long, turn int, role string, content array<{chat.PART}>")
    out = {(r.conv_id, r.turn): r for r in chat.read_back(chat.formatted(df, text=None, parts="content")).collect()}
    r = out[1, 0]
    assert r.formatted == "<s>assistant[INST]see <\\/s> <|image|><|audio|> and <|document|><|image|>[\\INST]</s>"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 63), ("document", "c.pdf", 1536), ("image", "d.png", 1)]
    assert r.expanded_tokens == 1603 and r.text == r.loss_text == "see </s>  and [INST]" and r.formatted[r.loss_start : r.loss_end].startswith("see")
    assert out[1, 1].text == out[2, 0].text == "" and out[1, 1].loss_text is None


def test_chat_of_one_long_conversation(spark):
    """A conversation that holds most rows over many partitions is one digest."""
    df = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") % 10 == 9, F.col("id")).otherwise(5).alias("conv_id"), F.col("id").alias("turn"),
                                             F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    got = {r.conv_id: r for r in chat.digests(chat.read_back(chat.formatted(df))).collect()}
    ids = [i for i in range(20_000) if i % 10 != 9]
    assert got[5].n_turns == len(ids) and got[5].turns_sha256 == sha("".join(f"{'user' if i % 2 == 0 else 'assistant'}\nt{i}\n" for i in ids))
    assert len(got) == 2001


def counted(rows):
    lower, c = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            c[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: n for w, n in c.items() if n >= 2 and len(w) >= 7}


def variants(c):
    near, groups = defaultdict(set), defaultdict(set)
    for w in c:
        for i in range(len(w)):
            groups[w[:i] + "*" + w[i + 1 :]].add(w)
            if (short := w[:i] + w[i + 1 :]) in c:
                near[w].add(short)
                near[short].add(w)
    for group in groups.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in c.items():
        if near[w] and c[f := min(near[w], key=lambda x: (-c[x], x))] >= 10 * n:
            form[w] = f

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), c[form[w]] if w in form else None) for w, n in c.items()}


def spelled(rng):
    """Texts with chains of forms, words that are prefixes of each other, runs of one letter, very long words and ties."""
    words = Counter({"aaaaaaa": 3, "aaaaaaaa": 300, "aaaaaaaaa": 2, "aaaaaaaaaaa": 2, "abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "Abcdefghij": 2000, "zbcdefg": 20, "ÉTRANGES": 30, "Étranges": 2,
                     "étrangès": 2, "p" * 5000 + "q" * 5000: 2, "p" * 5000 + "x" + "q" * 5000: 30, "p" * 10_000: 2, "÷ßàáâãä": 2, "×ßàáâãä": 25})
    for _ in range(60):
        base = "".join(rng.choice("ab") for _ in range(rng.randint(7, 10)))
        words[base] += rng.choice([2, 3, 25])
    return [(i, " ".join(w for w, n in words.items() for _ in range(-(-n // 40)))) for i in range(40)]


def test_spelling_variants(spark):
    rows = texts() + spelled(random.Random(2))
    want = variants(counted(rows))
    assert sum(v[0] is not None for v in want.values()) > 10 and any(v[0] != v[1] for v in want.values() if v[0])
    got = spelling.variants(frame(spark, rows)).collect()
    assert len(got) == len(want) and {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    assert spelling.variants(empty(spark)).count() == 0


def test_spelling_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = variants(counted([(r.doc_id, r.text) for r in docs.collect()]))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs).collect()} == want


def mined(rows, anchors, window=(30, 90), k=(5, 10)):
    ids, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    m, out = np.array([r[2] for r in rows], np.int64), []
    for a in sorted({int(i) for i in ids if anchors(i)}):
        own = min((int(labels[j]), m[j].tolist()) for j in np.flatnonzero(ids == a))
        s = m @ np.array(own[1])
        order = np.lexsort((ids, -s))
        for p in [j for j in order if labels[j] == own[0] and ids[j] != a][: k[0]]:
            hits = [j for j in order if labels[j] != own[0] and window[0] * s[p] <= 100 * s[j] <= window[1] * s[p]][: k[1]]
            out += [(a, int(ids[p]), i + 1, int(ids[j]), int(s[p]), int(s[j])) for i, j in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:  # many pages, trees and blocks
        for name, value in (("PAGE", 8), ("FAN", 3), ("SLAB", 40), ("BLOCK", 3), ("TREE_BYTES", 4 * 6 * 8 * 4)):
            monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 6)).astype(np.float32)
    x[300:420] = x[300]  # ties
    x[500] *= 200_000  # scores beyond what a double holds exactly
    labels = rng.integers(0, 4, 700)
    labels[:250] = 1  # a label with a third of all rows
    rows = [(i, int(label), [float(c) for c in v]) for i, (label, v) in enumerate(zip(labels, x))]
    bad = [(1000, None, rows[0][2]), (1001, 1, None), (1002, 1, [1.0, None]), (1003, 1, [float("nan")] * 6), (1004, 2, [float("inf")] * 6), (None, 1, rows[0][2]), (1100, 2, [1e30] * 6)]
    df = spark.createDataFrame(rows + bad, "vec_id long, label int, embedding array<float>").withColumn("cell", F.lit("x")).withColumn("score", F.lit("y")).repartition(5)
    want = mined([(i, label, np.floor(256 * np.array(v, np.float64))) for i, label, v in rows], lambda i: i % 10 == 0)
    out = hard_negatives.hard_negatives(hard_negatives.whole_vectors(df), anchors="id % 10 = 0")
    assert sorted(tuple(r) for r in out.collect()) == want and len(want) > 1000


def test_hard_negatives_of_odd_tables(spark):
    schema = "vec_id long, label int, embedding array<float>"
    mine = lambda rows: [tuple(r) for r in hard_negatives.hard_negatives(hard_negatives.whole_vectors(spark.createDataFrame(rows, schema)), anchors="id % 100 = 0").collect()]
    assert mine([]) == [] and mine([(1, 1, [1.0])]) == [] and mine([(0, 1, [])]) == []
    # an anchor's own repeated rows are no positives; a shorter vector is filled up with zeros
    rows = [(0, 1, [1.0, 1.0]), (0, 1, [1.0, 1.0]), (3, 1, [1.0, 1.0]), (4, 2, [1.0]), (4, 2, [1.0])]
    assert mine(rows) == [(0, 3, 1, 4, 2 * 65536, 65536), (0, 3, 2, 4, 2 * 65536, 65536)]
