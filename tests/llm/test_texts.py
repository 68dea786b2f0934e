"""Classifiers, personal data, pieces, chat and language model on small tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import chat, langid, lm, mixing, pieces, pii, toxicity
from tests.conftest import DATA

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def held(i, n, r):
    return zlib.crc32(str(i).encode()) % n == r


# ---------------------------------------------------------------- language


def test_language(spark):
    got = {r.doc_id: r for r in langid.op6(spark, DATA).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert set(got) == set(truth)
    out = [i for i in truth if got[i].held_out]
    assert all(held(i, 4, 2) for i in out) and sum(got[i].lang_pred == truth[i] for i in out) > 0.95 * len(out)


def test_language_edges(spark, docs):
    model = langid.train(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the and " * 50_000), (4, "the and " * 50_000)], "doc_id long, text string").withColumn("score", F.lit("mine"))
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].rejected and got[1].score == 0
    assert got[4].lang_pred == "en" and not got[4].rejected
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.train(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    nulls = spark.createDataFrame([(None, "the cat", None), (1, None, "en")], "doc_id long, text string, lang string")
    assert langid.train(nulls) is None


def test_unlearned_language_is_rejected():
    rng = random.Random(4)
    letters = ["abdeginorst", "cehlmnoprsu", "aefhiklouvw", "adjmoqrtuxz", "бвгдежзикло"]
    words = [["".join(rng.choice(few) for _ in range(rng.randint(2, 7))) for _ in range(300)] for few in letters]
    made = lambda k: " ".join(rng.choice(words[k]) for _ in range(60))
    model = langid.fit([(made(k), f"l{k}") for k in range(4) for _ in range(500)])
    assert 0.25 < model.threshold < 1
    clean = model.predict([made(k) for k in range(4) for _ in range(250)])[2]
    assert sum(clean) <= 0.01 * len(clean)
    assert sum(model.predict([made(4) for _ in range(100)])[2]) >= 95


# ---------------------------------------------------------------- toxicity


def test_kernel_by_enumeration():
    from itertools import combinations

    def slow(s, t):
        total = 0.0
        for a in combinations(range(len(s)), toxicity.LENGTH):
            for b in combinations(range(len(t)), toxicity.LENGTH):
                if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                    total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    words, marks = ["idiot", "idxiot", "abc", "moron", "i"], ["idiot", "moor"]
    got = toxicity.kernel(toxicity.encode(words, 6, -1), toxicity.encode(marks, 5, -2))
    assert np.allclose(got, [[slow(w, m) for m in marks] for w in words], rtol=1e-4)
    assert np.allclose(toxicity.own(toxicity.encode(words, 6, -1)), [slow(w, w) for w in words], rtol=1e-4)


@pytest.fixture(scope="module")
def toxic():
    rng = random.Random(5)
    plain = ["".join(rng.choice(["an", "er", "the", "ou", "sh", "ti", "re", "ly"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for i in range(400):
        ws = [rng.choice(plain) for _ in range(60)]
        if i % 4 == 0:
            ws[rng.randrange(60)] = rng.choice(["blockhead", "numpty", "wazzock"])
        rows.append((" ".join(ws) + ".", int(i % 4 == 0)))
    return toxicity.fit(rows), plain


def test_toxicity(toxic):
    model, plain = toxic
    score = lambda *t: model.score(list(t))[0]
    bad = score("an er blockhead the", "an BLOCKHEAD!", "an b l o c k h e a d ti", "an block-head ti", "an blockheaad ti")
    assert min(bad) >= toxicity.TOXIC_FROM
    good = score(" ".join(plain), "", None, "the an " * 10_000)
    assert max(good) < toxicity.TOXIC_FROM and good[1] == good[2]
    assert score("x" * 50_000 + "blockhead" + "y" * 50)[0] >= 0  # long words count by windows
    assert toxicity.fit([("a", 0), ("b", 0)]) is None and toxicity.fit([]) is None


def test_toxicity_on_kept_out_rows(spark):
    """Kept-out rows of sf0.1: all toxic rows with an insult are marked, and few clean rows; the other toxic rows hold none."""
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r.predicted for r in toxicity.op3(spark, d).filter("held_out").collect()}
    insults = "trash|idiot|pathetic|worthless|scum|stupid|loser|moron|disgusting|clown"
    rows = spark.read.parquet(f"{d}/labels.parquet").join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").select("doc_id", "toxic", F.lower("text").rlike(insults).alias("hit")).collect()
    kept = [r for r in rows if r.doc_id in got and r.toxic is not None]
    toxic, clean = [r for r in kept if r.toxic and r.hit], [r for r in kept if not r.toxic]
    assert sum(got[r.doc_id] for r in toxic) >= 0.95 * len(toxic)
    assert sum(got[r.doc_id] for r in clean) <= 0.025 * len(clean)


def test_toxicity_query(spark):
    got = toxicity.op3(spark, DATA).collect()
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert len(got) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == held(r.doc_id, 3, 1) for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(empty, None).count() == 0
    assert toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int")) is None


# ---------------------------------------------------------------- personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def slow_base(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans():
    rng = random.Random(2)
    for _ in range(5000):
        t = "".join(rng.choice("a@.-+ 1234567890()_%é") for _ in range(rng.randint(0, 40)))
        assert pii.base(t) == slow_base(t)
    long = "1" * 200_000 + " a@b.c " + "a" * 200_000 + "+1+1"
    assert [s[2] for s in pii.base(long)] == [0]


def test_field_adds_and_keeps(spark):
    card = "4539578763621486"
    rng = random.Random(9)

    def number():
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(body + c for c in "0123456789" if pii.luhn(body + c))

    texts = [f"the {number()} of and 12 in {rng.randint(2, 99)}.{rng.randint(2, 99)}.1.9 to x{i}@mail.com." for i in range(60)] + [f"in {rng.randrange(10**15, 10**16)} the 1999" for _ in range(60)]
    model = pii.fit([pii.labelled(t) for t in texts])
    (b, added), (_, clean) = pii.spans([f"a {card} {card} b", "in 1999 the 12 words and 3.5 of it"], model)
    assert not b and [(s, e) for s, e, _ in added] == [(2, 18), (19, 35)] and {k for *_, k in added} == {2} and not clean
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, f"mail a@b.co {card} {card}", "x")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.find(rows, model).collect()}
    assert got[1].spans == got[2].spans == "" and got[3].spans.startswith("email:5:11,card:") and got[3].n_added == 2
    kept = {r.doc_id: r.text for r in pii.redact(rows, model).collect()}
    assert kept == {1: None, 2: "", 3: "mail <EMAIL> <CARD> <CARD>"}
    assert pii.train(rows.limit(0)) is None


def test_messages_on_a_tree_are_exact():
    rng = np.random.default_rng(3)
    model = pii.Model(rng.normal(size=(pii.N_FEATURES, 5)), *(rng.normal(size=(5, 5)) for _ in range(3)))
    f = pii.build([[("12", 0), ("a@b.c", 1), ("12.5", 2)]])
    own, edges = f.x @ model.node, [tuple(e) for e in f.chain]
    joint = np.exp(own[0][:, None, None] + own[1][None, :, None] + own[2][None, None, :] + model.chain[:, :, None] + model.chain[None, :, :])
    joint /= joint.sum()
    assert edges == [(0, 1), (1, 2)]
    assert np.allclose(model.infer(f)[0][1], joint.sum((0, 2)), atol=1e-3)


def test_similar_tokens_share_a_label():
    f = pii.build([[("4539578763621486", 0), ("x", 5), ("4539-5787-6362-1499", 9), ("4539578763621486", 12), ("1234567", 20), ("1234599", 30)], [("4539578763621486", 0)]])
    assert [tuple(e) for e in f.skip] == [(0, 3)] and [tuple(e) for e in f.alike] == [(0, 2), (2, 3)]
    node = np.zeros((pii.N_FEATURES, 5))
    sure, unsure = pii.Model(node, np.zeros((5, 5)), np.zeros((5, 5)), 2 * np.eye(5)), pii.Model(node, *[np.zeros((5, 5))] * 3)
    for m in (sure, unsure):
        m.node = node.copy()
        m.node[pii.features("4539578763621486")[-1], 3] = 4.0
    near = pii.build([[("4539578763621486", 0), ("45395787636214xx", 9)]])
    assert sure.infer(near)[0][1, 3] > unsure.infer(near)[0][1, 3] + 0.1


# ---------------------------------------------------------------- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def test_n_best_by_enumeration(vocabulary, spark):
    p = vocabulary

    def slow(a):
        """(score, ids) of every segmentation."""
        if not a:
            return [(0.0, ())]
        out = []
        for j in range(1, len(a) + 1):
            if a[:j] in p.ids:
                one = (p.scores[a[:j]], (p.ids[a[:j]],))
            elif j == 1:
                one = (p.floor * len(p.spelled(a[0])), p.spelled(a[0]))
            else:
                continue
            out += [(one[0] + s, one[1] + i) for s, i in slow(a[j:])]
        return sorted(out, reverse=True)

    texts = ["the cat", "ción", "a.b", " x", "日本", "sat on", "t h e"]
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, rank int")
    found = pieces.segmentations(pieces.encoded(rows, p, n=4)).collect()
    for i, text in enumerate(texts):
        got = sorted((r.rank, r.score, tuple(r.piece_ids), r.n_pieces) for r in found if r.doc_id == i)
        every = slow(" " + text)
        assert len(got) == min(4, len(every)) and len({g[2] for g in got}) == len(got)
        assert np.allclose([g[1] for g in got], [s for s, _ in every[: len(got)]])
        scores = {i: s for s, i in every}
        assert all(np.isclose(scores[g[2]], g[1]) and g[3] == len(g[2]) for g in got)


def test_round_trips(vocabulary, spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab ▁\n\tñ日é.,the  ing²½🙂") for _ in range(rng.randint(0, 40))) for _ in range(500)] + [None, "", " ", "x" * 5000, "word " * 5000]
    ids, _, scores, _, good = pieces.encode(texts, vocabulary)
    assert all(good.to_pylist()) and [vocabulary.decode(i) for i in ids.to_pylist()] == [t or "" for t in texts]
    assert scores[500].as_py() == 0
    rows = spark.createDataFrame([(1, "the cat", "mine"), (2, None, "mine"), (1, "the cat", "mine")], "doc_id long, text string, piece_ids string")
    made = pieces.encoded(rows, vocabulary)
    assert [r.text2 for r in pieces.decoded(made, vocabulary, into="text2").orderBy("doc_id").collect()] == ["the cat", "the cat", ""]
    assert pieces.encoded(rows.limit(0), vocabulary).count() == 0


# ---------------------------------------------------------------- chat


def test_viterbi_by_enumeration():
    from itertools import product

    model = chat.fit([("User: a\nb\nAssistant: c", [(0, 0), (2, 1)])] * 3)
    x = chat.features("User: a\nb?\n\nc\nAI: d".split("\n"))[1]
    e = sum(t[:, x[:, j]].T for j, t in enumerate(model.emit))
    value = lambda s: model.start[s[0]] + e[0, s[0]] + sum(model.move[a, b] + e[i, b] for i, (a, b) in enumerate(zip(s, s[1:], strict=False), 1))
    best = max(product(range(6), repeat=len(x)), key=value)
    assert value(tuple(model.path(x))) == pytest.approx(value(best))


def test_chat(spark):
    talk = [(c, t, ["user", "assistant"][t % 2], f"text {c} of turn {t}\nmore words here" + ("?" if t % 2 == 0 else ".")) for c in range(80) for t in range(4)]
    talk += [(500, t, "user" if t % 2 == 0 else "assistant", "hi") for t in range(1200)] + [(501, 0, None, None), (502, None, "user", "x"), (None, 0, "user", "x"), talk[0]]
    rows = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    made = chat.transcripts(rows)
    parts = {(r.conv_id, r.part) for r in made.collect()}
    assert {(500, 0), (500, 1), (500, 2), (502, 0)} <= parts and all(c is not None for c, _ in parts)
    out = chat.parse(made, chat.train(made), keep=["conv_id", "part"]).filter("conv_id < 80").collect()
    roles = {}
    for r in sorted(out, key=lambda r: r.turn):
        roles.setdefault(r.conv_id, []).append(r.role)
        assert r.rendered.startswith(f"<|im_start|>{r.role}\n") and r.rendered.endswith("<|im_end|>")
    assert sum(v == ["user", "assistant"] * 2 for v in roles.values()) >= 72
    assert chat.transcripts(rows.limit(0)).count() == 0
    model = chat.fit([])
    assert model.turns(None) == [] and model.turns("\n \n") == []
    assert model.turns("User: hi\nAssistant: yo") == [("user", "hi"), ("assistant", "yo")]


# ---------------------------------------------------------------- language model


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]


def test_language_model(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    count = Counter(w for r in rows if not held(r.doc_id, 5, 1) for w in tokens(r.text))
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in lm.op10(spark, DATA).collect()}
    for r in rows:
        ws, g = tokens(r.text), got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert g.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
        assert g.score < 0 and g.held_out == held(r.doc_id, 5, 1)


def test_language_model_is_a_distribution(spark):
    words = [b"aa", b"abab", b"b"] * 5
    key, n = lm.visited(words, np.ones(len(words), int))
    kept = np.unique(key[n > 2])
    contexts = lm.Contexts([np.zeros(1, int), np.arange(lm.SYMBOLS), *(kept[kept % 8 == m] // 8 for m in range(2, lm.ORDER + 1))])
    row, sym, _ = contexts.locate(words)
    s = lm.spelling(contexts, *np.unique(row * lm.SYMBOLS + sym, return_counts=True), seed=1)
    assert np.allclose(np.exp(s.logs).sum(1), 1, atol=1e-4)
    chances = dict(zip([b"aa", b"abab", b"q"], np.exp(s.score([b"aa", b"abab", b"q"])), strict=True))
    assert chances[b"abab"] > 0.1 and chances[b"q"] < 0.01
    name = lambda text: sum((256 if c == "^" else ord(c)) * lm.SYMBOLS**i for i, c in enumerate(reversed(text)))
    deepest = contexts.first[5] + np.searchsorted(contexts.numbers[5], name("^abab"))
    assert row[lm.symbols(words)[2][0] + 4] == deepest  # the end of "abab"
    seen = lm.seat(np.array([0, 1, 5, 100_000]), np.array([1.0, 1.0, 1.0, 1e3]), 0.5, np.random.default_rng(0))
    assert seen[0] == 0 and seen[1] == 1 and 1 <= seen[2] <= 5 and 1 < seen[3] < 100_000
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "zz " * 3), (4, "zz " * 3), (5, "q" * 30_000)], "doc_id long, text string")
    model = lm.train(docs, F.col("doc_id") == 1)
    got = sorted((r.doc_id, r.n_tokens, r.n_known) for r in lm.score(docs, model).collect())
    assert got == [(1, 4, 4), (2, 1, 1), (3, 1, 1), (4, 4, 1), (4, 4, 1), (5, 2, 1)]
    none = lm.train(docs.limit(0), F.lit(True))
    assert all(math.isfinite(r.score) and r.train_tokens == 0 for r in lm.score(docs, none).collect())
    assert lm.score(docs.limit(0), model).count() == 0


def test_words_are_split_and_keyed():
    texts = ["The cat sat\ton", None, "", "a" * 20 + " b" + "c" * 8 + " É x\x0by\r\n", "the cat", " \u00a0 ", "Ünï\ud800 the"]
    t = lm.Tokens(texts)
    want = [[w.encode("utf-8", "surrogatepass") for w in tokens(x)] for x in texts]
    assert lm.cut_up(*t.words(np.arange(len(t.key)))) == [w for ws in want for w in ws] and t.count.tolist() == [len(ws) for ws in want]
    rng = random.Random(3)
    words = list({"".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(5000)})
    many = lm.Tokens([" ".join(words + words)])
    assert len(np.unique(many.key)) == len(words) + 1 and (many.key[: len(words)] == many.key[len(words) : -1]).all()


@pytest.mark.parametrize("size", [10**9, 4000])
def test_scores_by_the_seated_restaurants(spark, monkeypatch, size):
    """Scores against the model's formulas in plain Python, with one bucket and with many and hot contexts."""
    monkeypatch.setattr(lm, "BUCKET", size)
    monkeypatch.setattr(lm, "CHUNK", size)
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "of", *(f"w{int(rng.expovariate(0.03))}" for _ in range(3))]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = lm.train(rows, F.col("doc_id") % 4 != 0)
    assert (model.buckets > 3 and len(model.hot) >= 2) if size == 4000 else not len(model.hot)
    count, pairs, follow = Counter(), Counter(), Counter()
    for i, t in enumerate(texts):
        if i % 4:
            ws = [w.encode() for w in tokens(t)]
            count.update(ws)
            pairs.update(zip([b"", *ws], ws))
            follow.update([b"", *ws[:-1]])
    key = lambda w: lm.START_KEY if w == b"" else lm.END_KEY if w == b"\n" else lm.keys(np.frombuffer(w + b"\n" * 16, np.uint8), np.array([0]), np.array([len(w)]))[0]
    names = {int(key(w)): w for w in [*count, b""]}
    logs, own, back = {}, {}, {}
    for r in lm.received(model.held.toArrow()):
        a = r.a
        if r.kind == lm.WORDS:
            k, f = len(a) // 2, r.f
            assert {names[int(h)]: n for h, n in zip(a[:k].view(np.uint64), a[k:], strict=True)} == {names[int(h)]: count[names[int(h)]] for h in a[:k].view(np.uint64)}
            logs |= {names[int(h)]: f[j] for j, h in enumerate(a[:k].view(np.uint64))}
        else:
            k = len(a)
            small = r.i[k:].view(np.uint32)
            context = np.repeat(a.view(np.uint64), r.i[:k])
            own |= {(names[int(u)], int(s)): x for u, s, x in zip(context, small, r.f[: len(small)], strict=True)}
            for j, u in enumerate(a.view(np.uint64)):
                back[names[int(u)]] = r.f[len(small) :][j]
    for h, x in zip(model.hot, model.hot_back, strict=True):
        back[names[int(h)]] = x
    assert set(logs) == set(count) and len(own) == len(pairs) and set(back) == set(follow)
    small = {w: int(key(w) >> np.uint64(32)) for w in count}
    mass = Counter()
    for (u, _), x in own.items():
        mass[u] += x
    assert all(mass[u] + back[u] == pytest.approx(1, abs=1e-5) for u in back)
    for r in lm.score(rows, model).collect():
        total, before = 0.0, b""
        for w in (w.encode() for w in tokens(texts[r.doc_id])):
            parent = np.exp(logs[w] if w in logs else model.unseen([w])[0])
            total += math.log10(own.get((before, small.get(w)), 0.0) + back.get(before, 1.0) * parent)
            before = w
        assert r.score == pytest.approx(total, rel=1e-4)


def test_the_model_prefers_order_and_beats_the_base(spark):
    got = lm.op10(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
    docs = spark.createDataFrame([(i, "one two three four five") for i in range(20)] + [(90, "one two three four five"), (91, "three one five two four")], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in lm.score(docs, lm.train(docs, F.col("doc_id") < 20)).collect()}
    assert scores[90] > scores[91] + 3


def test_tables_of_contexts_are_the_words_customers(spark):
    """Words of one context each: those that come often there have more tables in it, and so a higher probability in the parent."""
    often, rare = ([f"{a}{b}{c}" for b in "xyz" for c in "klmn"] for a in "qw")
    texts = [" ".join(f"go {w}" for w in often)] * 300 + [" ".join(f"go {w}" for w in rare)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    model = lm.train(rows, F.lit(True))
    key = lambda w: int(lm.keys(np.frombuffer(w.encode() + b"\n" * 16, np.uint8), np.array([0]), np.array([len(w)]))[0])
    found = next(r for r in lm.received(model.held.toArrow()) if r.kind == lm.WORDS)
    logs = dict(zip(found.a[: len(found.f)].view(np.uint64).tolist(), found.f.tolist(), strict=True))
    assert np.mean([logs[key(w)] for w in often]) > np.mean([logs[key(w)] for w in rare]) + 0.5


@pytest.mark.parametrize("size", [10**9, 4000])
def test_every_round_passes_the_tables_on(spark, monkeypatch, size):
    """In each round a word has as many customers as it has tables in all contexts, with one bucket and with many and hot contexts."""
    monkeypatch.setattr(lm, "BUCKET", size)
    monkeypatch.setattr(lm, "CHUNK", size)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", f"w{int(rng.expovariate(0.1))}"]) for _ in range(60)) for _ in range(200)]
    rounds, table = [], lm.common.table

    def watched(*args, **named):
        made = table(*args, **named)
        if "kind" in made.columns:
            rounds.append(lm.received(made.filter(F.col("kind").isin(lm.PAIRS, lm.MANY, lm.VOCABULARY, lm.FOLLOWED)).toArrow()))
        return made

    monkeypatch.setattr(lm.common, "table", watched)
    model = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), F.lit(True))
    assert len(model.hot) if size == 4000 else not len(model.hot)
    once, seated, seen = Counter(), None, []
    for g in rounds[0]:
        if g.kind == lm.PAIRS:
            k, n = len(g.i), int(g.i.sum())
            once.update(w for w, c in zip(g.a[k : k + n].tolist(), g.a[k + n :].tolist(), strict=True) if c == 1)
    for rows in rounds:
        if words := [lm.Vocabulary.of(g) for g in rows if g.kind == lm.VOCABULARY]:
            if seated is not None:
                customers = Counter({int(k) >> 24: n for v in words for k, n in zip(v.key.tolist(), v.n.tolist(), strict=True)})
                assert customers == once + seated and all((v.t <= v.n).all() and (v.t > 0).all() for v in words)
                seen.append(customers.total())
        if pairs := [lm.Many.of(g) for g in rows if g.kind == lm.MANY]:
            assert all((m.t <= m.c).all() and (m.t > 0).all() and (m.c > 1).all() for m in pairs)
            seated = Counter()
            for m in pairs:
                for w, t in zip(m.w.tolist(), m.t.tolist(), strict=True):
                    seated[w] += t
    assert len(set(seen)) >= lm.BURN_IN + lm.SAMPLES  # the first state and what the rounds made of it


# ---------------------------------------------------------------- mixing


def test_rates_match_targets(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = mixing.mix(docs, labels, {"en": 1.0, "de": 1.0, "fr": 1.0, "es": 3.0}).collect()
    have = np.zeros(4)
    for r in rows:
        assert r.rate >= 0
        have += np.array(r.p) * r.n_tokens * r.rate * r.copies
    assert np.allclose(have / have.sum(), np.array([1, 1, 3, 1]) / 6, atol=2e-3)  # de, en, es, fr
    left = mixing.unmet(mixing.mix(docs, labels, {"es": 1.0}), ["de", "en", "es", "fr"], {"es": 1.0})
    assert abs(sum(left.values())) < 1e-9 and abs(left["es"]) < 0.02
    words = {r.doc_id: len((r.text or "").split()) for r in docs.collect()}
    assert all(r.n_tokens == words[r.key] for r in rows)


def test_posteriors_and_rates_against_plain_python(spark):
    """Naive Bayes posteriors of a small table, and the least squares that the rates are the limit of."""
    rng = random.Random(4)
    words = {"a": ["one", "two", "six"], "b": ["two", "ten", "red"]}
    made = [(i, " ".join(rng.choice(words["ab"[i % 3 == 0]]) for _ in range(rng.randint(3, 40))), "ab"[i % 3 == 0]) for i in range(120)]
    rows = spark.createDataFrame(made, "doc_id long, text string, lang string")
    count = {d: Counter(w for _, t, l in made if l == d for w in t.split()) for d in "ab"}
    known = set(count["a"]) | set(count["b"])
    log = {d: {w: math.log((count[d][w] + 0.5) / (sum(count[d].values()) + 0.5 * len(known))) for w in known} for d in "ab"}
    prior = {d: math.log(sum(l == d for *_, l in made) / len(made)) for d in "ab"}
    got = {r.key: r for r in mixing.mix(rows, rows, {"a": 1.0, "b": 1.0}).collect()}
    p, n = np.zeros((len(made), 2)), np.zeros(len(made))
    for i, t, _ in made:
        z = np.array([prior[d] + sum(log[d][w] for w in t.split()) for d in "ab"])
        p[i], n[i] = np.exp(z - z.max()) / np.exp(z - z.max()).sum(), len(t.split())
        assert np.allclose(got[i].p, p[i], atol=1e-6)
    weights = (p * n[:, None]).T  # domain x document
    goal = np.full(2, n.sum() / 2)
    rate = np.array([got[i].rate for i in range(len(made))])
    assert np.allclose(weights @ rate, goal, rtol=1e-3) and (rate >= 0).all()


def test_mixing_edges(spark, docs):
    labels = spark.range(200).withColumnRenamed("id", "doc_id")
    odd = docs.limit(60).unionByName(spark.createDataFrame([(900, None, "en", "s", 0), (901, "", None, "s", 0), (902, "qq", "en", "s", 2), (902, "qq", "en", "s", 2)], DOCS))
    rows = mixing.mix(odd, labels)
    got = {r.key: r for r in rows.collect()}
    assert got[900].n_tokens == 0 and got[902].copies == 2 and all(abs(sum(r.p) - 1) < 1e-9 for r in got.values())
    clash = odd.withColumns({c: F.lit(c) for c in ("_x", "key", "h", "times", "row", "id", "x")})
    made = mixing.applied(clash, rows)
    assert made.columns == clash.columns and {r.times for r in made.collect()} == {"times"}
    made = mixing.applied(odd, rows)
    assert made.columns == odd.columns and {r.doc_id for r in made.collect()} <= set(got)
    assert {r.rate for r in mixing.mix(odd, labels.limit(0)).collect()} == {1.0}
    assert mixing.mix(odd.limit(0), labels).count() == 0
