import collections
import random
import re

import numpy as np
import pytest

from tidemark.llm import kneser_ney, quality_rules

BLANK = r"\x20\x09-\x0D"


def base(t):
    t = t or ""
    w = re.findall(f"[^{BLANK}]+", t)
    lines = [x for x in t.split("\n") if re.search(f"[^{BLANK}]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, inside = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            inside.update((i, i + 1, i + 2))
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), failed


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(["a", "b", "cc", "é", "🙂x", "d\ne", "#"]) for _ in range(r.randrange(120))), r.choice(["en", None]), r.choice(["s", "t", ""]), 0) for i in range(400)]
    rows += [(1000, None, None, None, 0), (1001, "", "en", "s", 0), (1002, "x y z " * 40_000, "en", "s", 0), (1003, "\x0b\x1c \n\n a", "en", "s", 0), (None, "one two three " * 3, "en", "s", 0), (5, "again " * 60, "en", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key int")


def test_base_rules(docs):
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.apply_rules(docs).collect()), key=str)
    assert got == sorted(((r.doc_id, *base(r.text)) for r in docs.collect()), key=str)
    assert all(not r.kept for r in quality_rules.apply_rules(docs).collect() if r.base_failed)


def test_base_rules_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = quality_rules.apply_rules(docs).collect()
    want = {r.doc_id: base(r.text) for r in docs.collect()}
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id] for r in got)
    assert all(r.kept == (labels[r.doc_id] == 1) for r in got if r.doc_id in labels and not r.base_failed)


def test_estimates_are_robust(spark):
    """A third of a group far away moves neither location nor distances of the rest."""
    r = np.random.default_rng(3)
    good, bad = r.normal(0, 1, (400, 6)) @ np.diag([1, 2, 0.5, 1, 1, 3.0]) + 5, r.normal(40, 0.1, (150, 6))
    rows = [(i, 0, "g", *map(float, x)) for i, x in enumerate(np.concatenate([good, bad]))]
    frame = spark.createDataFrame(rows, "doc_id long, level int, key string, " + ", ".join(f"x{i} double" for i in range(6)))
    est = quality_rules.estimates(frame)
    assert np.abs(np.array(est.first()["m"]) - 5).max() < 0.4
    far = quality_rules._meet(frame, est, True).select("doc_id", (quality_rules._distance() / est.first()["scale"]).alias("d")).collect()
    assert all((x.d > quality_rules.LIMIT) == (x.doc_id >= 400) for x in far)


def test_empty(spark, docs):
    assert quality_rules.apply_rules(docs.limit(0)).collect() == []


def brute_model(texts):
    """The same model from its definition, by dictionaries."""
    order, grams = kneser_ney.ORDER, collections.Counter()
    for t in texts:
        s = bytes(order - 1) + t.encode()
        grams.update(s[i : i + order] for i in range(len(s) - order + 1))
    counts = {order: grams}
    for m in range(order - 1, 0, -1):
        counts[m] = collections.Counter(g[1:] for g in counts[m + 1])
    cut = {m: kneser_ney.discounts(*(sum(v == k for v in counts[m].values()) for k in (1, 2, 3, 4))) for m in counts}

    def p(gram):
        m = len(gram)
        if m == 0:
            return 1 / 256
        seen = [v for g, v in counts[m].items() if g[:-1] == gram[:-1]]
        if not seen:
            return p(gram[1:])
        d = lambda v: cut[m][min(v, 3) - 1] if v else 0
        own = counts[m].get(gram, 0)
        return (own - d(own) + sum(map(d, seen)) * p(gram[1:])) / sum(seen)

    return p


TRAINED = ["the cat sat on the mat", "the dog sat on a log", "a cat and a dog"] * 2
PROBES = ["the cat", "zzz9", "on the dog!", "", "été", "the cat sat on the mat " * 60]


def brute_perplexity(p, text):
    s = bytes(kneser_ney.ORDER - 1) + text.encode()
    logs = [np.log(p(s[i : i + kneser_ney.ORDER])) for i in range(len(s) - kneser_ney.ORDER + 1)]
    return float(np.exp(-np.mean(logs))) if logs else None


@pytest.mark.parametrize("stretch, buckets", [(kneser_ney.STRETCH, kneser_ney.BUCKETS), (50, 3)])
def test_model_is_kneser_ney(spark, monkeypatch, stretch, buckets):
    """Perplexities are those of the definition, however texts are cut and few n-grams the table holds."""
    monkeypatch.setattr(kneser_ney, "BUCKETS", buckets)
    rows = [(i, t, True) for i, t in enumerate(TRAINED)] + [(10 + i, t, False) for i, t in enumerate(PROBES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, counted boolean").coalesce(1)
    found = kneser_ney.counts(docs)
    grams = found.join(kneser_ney.log_probabilities(found), "gram").select("gram", "n", "logp").cache()
    by = {r.gram: r.logp for r in grams.collect()}
    for tail in range(0, 256**3, 256**3 // 7):  # the shares of a context add up to one
        assert sum(np.exp(by[g]) for g in by if g >> 8 == tail) <= 1 + 1e-6
    got = {r.doc_id: r.perplexity for r in kneser_ney.perplexities(docs, grams).collect()}
    p = brute_model(TRAINED)
    assert len(got) == len(rows)
    for i, t, _ in rows:
        assert got[i] == (pytest.approx(brute_perplexity(p, t), rel=1e-4) if t else None)


def test_stretches_go_on(monkeypatch):
    texts = ["abc" * 50, "", None, "é" * 40, "x"]
    whole = [np.concatenate(x) for x in zip(*kneser_ney.stretches(texts))]
    monkeypatch.setattr(kneser_ney, "STRETCH", 17)
    assert all((a == np.concatenate(b)).all() for a, b in zip(whole, zip(*kneser_ney.stretches(texts))))
    assert len(whole[0]) == 150 + 80 + 1


def brute_mcd(x, share, starts=200):
    """Least determinant over many random starts, by NumPy."""
    r, h, best = np.random.default_rng(0), int(np.ceil(share * len(x))), (np.inf,)
    floor = np.diag(np.array(list(quality_rules.VECTOR.values())) ** 2)
    for _ in range(starts):
        part = x[r.choice(len(x), 8, replace=False)]
        for _ in range(30):
            m, c = part.mean(0), np.cov(part.T, bias=True) + floor
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            part = x[np.argsort(d)[:h]]
        m, c = part.mean(0), np.cov(part.T, bias=True) + floor
        best = min(best, (np.linalg.slogdet(c)[1], m.tolist()))
    return best


def test_determinant_is_the_least(spark):
    """Where medians alone begin badly: outliers correlate against the rest."""
    r = np.random.default_rng(8)
    a = np.eye(6) + 0.9 * np.diag(np.ones(5), 1)
    good, bad = r.normal(0, 1, (300, 6)) @ a, r.normal(0, 0.4, (140, 6)) @ np.linalg.inv(a) + [3, -3, 3, -3, 3, -3]
    x = np.concatenate([good, bad])
    frame = spark.createDataFrame([(i, 0, "g", *map(float, v)) for i, v in enumerate(x)], "doc_id long, level int, key string, " + ", ".join(f"x{i} double" for i in range(6)))
    got = quality_rules.estimates(frame).first()
    logdet, m = brute_mcd(x, quality_rules.SHARE)
    assert got["logdet"] <= logdet + 0.1 and np.abs(np.array(got["m"]) - m).max() < 0.15


def test_small_groups_lean_on_larger_ones(spark):
    """A row is judged by the same limits, whether its group has five rows or fifty."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 9)))
    prose = lambda: " ".join(word() for _ in range(120)) + "."
    rows = [(i, prose(), "en", "big") for i in range(200)] + [(300 + i, prose(), "en", "few") for i in range(4)]
    rows += [(400, prose().replace(" ", " ### "), "en", "few"), (401, prose().replace(" ", " ### "), "en", "big"), (402, prose().replace(" ", "$$$ "), "en", "alone")]
    got = {x.doc_id: x.kept for x in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in got if i < 400) and not any(got[i] for i in (400, 401))


def test_classifier_tells_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    got = {r.doc_id: r.kept for r in kneser_ney.classify(docs, half).collect()}
    long = {r.doc_id for r in docs.collect() if len(r.text.split()) >= 50 and not base(r.text)[5]}
    held = [(r.quality, got[r.doc_id]) for r in labels.where("doc_id % 2 = 1").collect() if r.doc_id in long]
    assert len(got) == 1000 and all(k for q, k in held if q == 1) and not any(k for q, k in held if q == 0)


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, "some text", None, 0.0), (2, None, "en", 0.0), (3, "", "en", 0.0), (None, "x" * 100_000, "en", 0.0), (1, "some text", None, 0.0)], "doc_id long, text string, lang string, perplexity double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = kneser_ney.classify(docs, labels).collect()
    assert len(got) == 5 and all(r.kept for r in got if r.doc_id is not None)
    assert kneser_ney.classify(docs.limit(0), labels).collect() == []
    assert all(r.kept for r in kneser_ney.classify(docs, labels.limit(0)).collect())


def test_the_driver_builds_steps_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    frame = spark.createDataFrame([(i, 0, "{}", *map(float, x)) for i, x in enumerate(rng.normal(size=(60, 6)))], "doc_id long, level int, key string, x0 double, x1 double, x2 double, x3 double, x4 double, x5 double")
    built, build = [], quality_rules._distance
    monkeypatch.setattr(quality_rules, "_distance", lambda: built.append(1) or build())
    assert quality_rules.estimates(frame).count() == 1 and len(built) == 1
