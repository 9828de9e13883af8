"""Operators for training data against brute force, exact round trips or held-out accuracy, and on awkward tables."""

import base64
import hashlib
import itertools
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from corpusloom.llm import ann, bpe, common, components, decontaminate, jaccard, kernel, kneser_ney, langid, line_dedup, pairs, pitman_yor, queries, toxicity, warc  # noqa: E402

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def documents(spark, texts, extra=""):
    """A documents table with a null row, an empty text, a very long one and repeated rows, and columns that clash."""
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(None, None, None, None, None), (900, "", "en", None, 0), (901, " \n\t ", None, "s", 4), (902, LONG, "en", "s", len(LONG)), rows[0], rows[0]]
    df = spark.createDataFrame(rows, DOC)
    for name in ("ids", "score", "runs", "kept_text", "toxicity", "perplexity", "keep", "token", "cls"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice(("an", "the", "or", "ing", "tion", "re", "st", "ou")) for _ in range(rng.randint(1, 3))) for _ in range(900)]
    return lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))


# --- kernel -------------------------------------------------------------------------------------------------------------


def test_kernel_words():
    texts = ["One two  ONE", "", None, "é\x0bÉ\x0cx\x1cy", " a", "a "]
    got, hashes = [], {}
    for lo, hi, data, offsets in kernel.chunks(pa.array(texts), 8):
        scanned = kernel.scan(data, offsets)
        for k in range(hi - lo):
            span = slice(scanned.bounds[k], scanned.bounds[k + 1])
            own = [bytes(scanned.data[a:b]).decode() for a, b in zip(scanned.starts[span], scanned.ends[span], strict=True)]
            got.append(own)
            for w, h in zip(own, scanned.hashes[span], strict=True):
                key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
                assert hashes.setdefault(key, h) == h
    assert got == [["One", "two", "ONE"], [], [], ["é", "É", "x\x1cy"], ["a"], ["a"]] and len(set(hashes.values())) == len(hashes)


# --- 1 ------------------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries._tokenizer_file()
    library, own = tokenizers.Tokenizer.from_file(path), bpe.tokenizer(path)
    rng = random.Random(1)
    pool = [chr(c) for r in ((32, 0x17F), (0x391, 0x3C9), (0x410, 0x44F), (0x3041, 0x3096), (0x4E00, 0x4E40), (0x1F600, 0x1F620), (0x300, 0x320)) for c in range(*r)]
    for i in range(2500):
        text = "".join(rng.choice(pool) if rng.random() < 0.4 else rng.choice("aabbthe 'sre ll\n1230!?ΣİQ\x1c\x85") for _ in range(rng.randint(0, 40))) + "<|endoftext|>" * (i % 40 == 0) + "a" * (i % 30 == 0) * rng.randint(1, 60)
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == expected, text
        assert own.decode(own.encode(text)) == library.decode(expected, skip_special_tokens=False)


def test_automaton_overlaps():
    vocab = {"a": 0, "b": 1, "aa": 2, "aab": 3, "aaaa": 4}
    own = bpe.MergeAutomaton(vocab, [("a", "a"), ("aa", "b"), ("aa", "aa")], "")
    assert [own.encode("a" * n) for n in range(6)] == [[], [0], [2], [2, 0], [4], [4, 0]] and own.encode("aaab") == [2, 0, 1] and own.encode("aab") == [3]


def test_bpe_on_awkward_rows(spark):
    df = documents(spark, ["Hello there", "Grüße"])
    made = bpe.encode_decode(df, queries._tokenizer_file())
    assert made.columns == [*df.columns, "_ids", "n_tokens", "decoded"] and made.count() == df.count()
    rows = made.orderBy("doc_id").collect()
    assert rows[0]["n_tokens"] == 0 and bytes(rows[0]["_ids"]) == b"" and [r["n_tokens"] for r in rows if r["doc_id"] == 0] == [2, 2, 2]
    assert bpe.decode(made.select("_ids"), queries._tokenizer_file(), "_ids").where("decoded is null").count() == 0
    assert bpe.encode_decode(df.limit(0), queries._tokenizer_file()).count() == 0


# --- 2, 3, 5: accuracy --------------------------------------------------------------------------------------------------


def test_language_accuracy(spark):
    made = queries.op2_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, total = made.where("lang = lang_pred").count(), made.count()
    assert total > 20 and right / total > 0.95


def test_language_on_awkward_rows(spark):
    df = documents(spark, ["the cat and the dog", "12 34"]).withColumn("lang_pred", F.lit("x"))
    model = langid.train(df, F.lit(True))
    made = langid.predict(df, model)
    rows = {r["doc_id"]: r for r in made.collect()}
    assert rows[None]["_lang_pred"] == rows[900]["_lang_pred"] == rows[1]["_lang_pred"] == "und" and rows[0]["_lang_pred"] == "en" and rows[0]["score"] == "own score" and 0 <= rows[0]["_score"] <= 1
    empty = langid.train(df.limit(0), F.lit(True))
    assert langid.predict(df, empty).where("_lang_pred <> 'und'").count() == 0 and langid.predict(df.limit(0), model).count() == 0


def kneser_ney_by_hand(texts):
    """log10 p(second | first) of a bigram model with three discounts, as a function; None stands for the end."""
    own = [words(t) for t in texts]
    pairs = Counter(p for w in own for p in zip([None, *w], [*w, None]))

    def discounts(counts):
        n = [sum(c == k for c in counts) + 1 for k in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))]

    cut, seconds = discounts(pairs.values()), Counter(s for _, s in pairs)
    cut2, total2 = discounts(seconds.values()), len(pairs)
    total, freed = Counter(), Counter()
    for (f, _), n in pairs.items():
        total[f] += n
        freed[f] += cut[min(n, 3)]
    freed2 = sum(cut2[min(n, 3)] for n in seconds.values())
    word = lambda s: (seconds[s] - cut2[min(seconds[s], 3)]) / total2 + freed2 / total2 / (len(seconds) + 1)

    def log_p(f, s):
        if not total[f]:
            return math.log10(word(s))
        n = pairs[f, s]
        return math.log10((n - cut[min(n, 3)]) / total[f] + freed[f] / total[f] * word(s))

    return log_p, [*seconds, object()]


def test_kneser_ney_equals_brute_force(spark, prose):
    texts = [prose(300), prose(90), "a b a b a b c", "the the the", "", prose(40), "A  B\na"]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"))
    log_p, vocabulary = kneser_ney_by_hand(texts)
    for f in (None, "a", "the", vocabulary[0]):
        assert math.isclose(sum(10 ** log_p(f, s) for s in vocabulary), 1, rel_tol=1e-9)
    asked = [*texts, "unheard of", "b a", prose(50) + " unheard " + prose(3), "the the the the the"]
    made = kneser_ney.perplexities(spark.createDataFrame([(i, t) for i, t in enumerate([*asked, None])], "i int, text string"), model).collect()
    for r in made:
        if r["text"] is None:
            assert r["perplexity"] is None
        else:
            w = words(r["text"])
            assert math.isclose(math.log10(r["perplexity"]), -sum(log_p(f, s) for f, s in zip([None, *w], [*w, None])) / (len(w) + 1), rel_tol=1e-9), r
    assert len(made) == len(asked) + 1 and kneser_ney.train(spark.createDataFrame([], "text string")) is None


def test_quality(spark):
    made = queries.op3_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    good, bad = (made.where(f"quality = {q}") for q in (1, 0))
    assert good.where("keep").count() / good.count() > 0.97 and bad.where("not keep").count() / bad.count() > 0.9


def test_quality_on_awkward_rows(spark, prose):
    df = documents(spark, [prose(80) for _ in range(6)])
    labels = spark.createDataFrame([(i, 1) for i in range(6)] + [(0, None), (None, 1)], "doc_id long, quality int")
    made = kneser_ney.classify(df, labels)
    assert made.count() == df.count() and made.columns == [*df.columns, "_perplexity", "threshold", "_keep"]
    assert made.where("text is null and _keep").count() == 0
    assert kneser_ney.classify(df, labels.limit(0)).where("text is not null and not _keep").count() == 0
    assert kneser_ney.classify(df.limit(0), labels).count() == 0


def test_toxicity_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    made = queries.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    hit, said, toxic = made.where("predicted = 1 and toxic = 1").count(), made.where("predicted = 1").count(), made.where("toxic = 1").count()
    assert hit / said > 0.85 and hit / toxic > 0.75


def test_positive_unlabelled_risk_and_steps():
    rng = np.random.default_rng(6)
    size, prior, rate, decay = 7, 0.3, 0.05, 1e-3
    sets = [[np.flatnonzero(rng.random(size) < q) for _ in range(n)] for q, n in ((0.6, 9), (0.3, 15))]
    dense = [np.array([np.isin(np.arange(size), x) for x in own], float) for own in sets]
    value = np.append(np.ones(size), -3.0)
    score = lambda v, s: dense[s] @ v[:size] + v[size]

    def parts(v):
        plus, minus = np.log1p(np.exp(-score(v, 0))).mean(), np.log1p(np.exp(score(v, 0))).mean()
        return prior * plus, np.log1p(np.exp(score(v, 1))).mean() - prior * minus

    assert toxicity.risk(score(value, 0), score(value, 1), prior) == pytest.approx(parts(value))
    moment, square, turned = np.zeros(size + 1), np.zeros(size + 1), 0
    for step in range(1, 61):  # the same steps from numerical gradients
        a, b = parts(value)
        turned += b < 0
        of = (lambda v: -parts(v)[1]) if b < 0 else lambda v: sum(parts(v))
        g = np.array([(of(value + h) - of(value - h)) / 2e-6 for h in np.eye(size + 1) * 1e-6]) + np.append(decay * value[:size], 0)
        moment, square = 0.9 * moment + 0.1 * g, 0.999 * square + 0.001 * g * g
        value = value - rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        value[:size] = np.maximum(value[:size], 0)
    weights, bias = toxicity.fit_nnpu(*sets, size, prior, 60, rate, decay)
    assert np.allclose(np.append(weights, bias), value, atol=1e-3) and turned > 0
    z_p, z_u = rng.normal(2, 1, 400), np.append(rng.normal(2, 1, 300), rng.normal(-2, 1, 700))
    scale, offset = toxicity.calibrate(z_p - 1, z_u - 1, 0.3)  # scores that are off by one
    assert scale > 0 and 0.5 < offset / scale < 1.5


def test_regularised_leader_steps():
    rng = np.random.default_rng(5)
    size, n, rows, classes = 11, 3, [], []
    for _ in range(8):
        at = np.flatnonzero(rng.random(size) < 0.4)
        rows.append((at, rng.random(len(at))))
        classes.append(int(rng.integers(n)))
    z, g2 = np.zeros((size, n)), np.zeros((size, n))

    def weight(i, k):
        if abs(z[i, k]) <= langid.L1:
            return 0.0
        return -(z[i, k] - math.copysign(langid.L1, z[i, k])) / ((langid.BETA + math.sqrt(g2[i, k])) / langid.ALPHA + langid.L2)

    for epoch in range(2):
        for r in np.random.default_rng(epoch).permutation(len(rows)):
            at, value = rows[r]
            old = {(i, k): weight(i, k) for i in at for k in range(n)}
            e = [math.exp(sum(v * old[i, k] for i, v in zip(at, value, strict=True))) for k in range(n)]
            for i, v in zip(at, value, strict=True):
                for k in range(n):
                    g = v * (e[k] / sum(e) - (k == classes[r]))
                    z[i, k] += g - (math.sqrt(g2[i, k] + g * g) - math.sqrt(g2[i, k])) / langid.ALPHA * old[i, k]
                    g2[i, k] += g * g
    want = np.array([[weight(i, k) for k in range(n)] for i in range(size)])
    assert np.allclose(langid.fit_ftrl(rows, np.array(classes), n, size, 2), want)
    scores = rng.normal(size=(300, n)) * 3
    truth = (scores / 2 + rng.gumbel(size=scores.shape)).argmax(axis=1)
    loss = lambda t: np.mean([-math.log(math.exp(x[y] / t) / sum(math.exp(v / t) for v in x)) for x, y in zip(scores, truth, strict=True)])
    best = langid.best_temperature(scores, truth)
    assert loss(best) <= min(loss(best * 1.05), loss(best / 1.05)) + 1e-9


def test_toxicity_on_awkward_rows(spark, prose):
    df = documents(spark, [prose(40) + (" idiot" if i % 3 == 0 else "") for i in range(60)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels, F.lit(True))
    made = toxicity.score(df, model)
    rows = {r["doc_id"]: r["_toxicity"] for r in made.collect()}
    assert made.count() == df.count() and all(0 <= x <= 1 for x in rows.values()) and rows[None] < 0.5 and rows[900] < 0.5 and rows[3] > rows[1]
    assert toxicity.train(df, labels.where("toxic = 0"), F.lit(True)) is None
    assert toxicity.score(df, None).where("_toxicity <> 0").count() == 0 and toxicity.train(df.limit(0), labels, F.lit(True)) is None


# --- 4 ------------------------------------------------------------------------------------------------------------------


def components_of(texts, n, percent):
    """Smallest index reachable by links, by comparing all pairs."""
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return [len(s) for s in sets], root


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_equals_brute_force(spark, prose, n, percent):
    rng = random.Random(n)
    bases = [prose(rng.randint(30, 160)) for _ in range(8)]
    texts = ["", "one", "one", "ONE  two", "one two", *bases]
    for b in bases[:5]:
        for _ in range(rng.randint(2, 30)):
            own = b.split()
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = prose(1)
            texts.append(" ".join(own))
    passage = prose(40)
    texts += [passage + " " + prose(rng.randint(1, 8)) for _ in range(25)] + [bases[0]] * 12
    sizes, root = components_of(texts, n, percent)
    made = jaccard.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=n, percent=percent)
    assert sorted(map(tuple, made.collect())) == [(i, sizes[i], root[i]) for i in range(len(texts))]


def test_jaccard_on_awkward_rows(spark, prose):
    made = jaccard.jaccard_classes(documents(spark, [prose(50), prose(50)])).collect()
    by = Counter((r["doc_id"], r["component_id"]) for r in made)
    assert by[0, 0] == 3 and by[None, None] == 1 and by[900, 900] == 1 and by[901, 901] == 1 and len(made) == 8
    assert jaccard.jaccard_classes(documents(spark, [""]).limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "src long, dst long")
    made = {r["node"]: r["component"] for r in components.connected(links).collect()}
    assert made == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# --- 6 ------------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(3, "http://a/", "same"), (1, "http://b/ x\r\n", "same"), (2, None, None), (4, "u", ""), (5, "u", "é" * 50_000), (1, "http://b/", "same"), (None, "n", "same")]
    path = warc.new_archive(spark)
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    made = warc.read_index(spark, path).collect()
    assert all(r["verified"] for r in made) and len(made) == len(rows)
    for r in made:
        html = next(h for p, _, h in rows if p == r["page_id"]) or ""
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in made)
    assert kinds == Counter([(1, "response", None), (1, "revisit", 1), (3, "revisit", 1), (None, "revisit", 1), (2, "response", None), (4, "revisit", 2), (5, "response", None)])
    full = warc.read_records(spark, path)
    assert full.where("not verified").count() == 0 and spark.read.parquet(f"{path}/payloads").count() == 3
    text = [bytes(r["record"]) for r in warc.record_bytes(full).collect()]
    from corpusloom.sources.webarchive import records

    read = [x for t in text for x in records(t)]
    assert sum(h["warc-type"] == "response" for h, _ in read) == 3 and sorted(len(b) for h, b in read if h["warc-type"] == "response") == [0, 4, 100_000]
    for kept in (spark.read.parquet(f"{path}/payloads").limit(2), spark.read.parquet(f"{path}/payloads").withColumn("packed", F.lit(zlib.compress(b"other")))):
        broken = warc.new_archive(spark)
        kept.write.parquet(f"{broken}/payloads")  # a payload lost, or all of them damaged
        spark.read.parquet(f"{path}/headers").write.parquet(f"{broken}/headers")
        for read in (warc.read_index, warc.read_records):
            made = read(spark, broken)
            assert made.count() == len(rows) and made.where("not verified").count() > 0
            with pytest.raises(Exception, match="damaged"):
                warc.verified(made).collect()
    assert warc.verified(full).count() == len(rows)
    empty = warc.new_archive(spark)
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_index(spark, empty).count() == 0


# --- 7 ------------------------------------------------------------------------------------------------------------------


def test_pitman_yor_scores(spark):
    made = queries.op7_pitman_yor(spark, SF).toPandas()
    texts = {r["doc_id"]: words(r["text"]) + [None] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    c = Counter(w for i, own in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in own)
    n, v = sum(c.values()), len(c)
    for r in made.itertuples():
        own = texts[r.doc_id]
        assert r.n_tokens == len(own) and r.n_known == sum(c[w] > 0 for w in own) and r.train_tokens == n and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
    held = made[made.held_out]
    assert held.score.sum() > held.base_score.sum() and (made.score < 0).all()


def predictive(model):
    """p of each word hash and None (unseen), and p(second | first) as a function, from the model's tables."""
    points = {None: 10**model.unseen}
    for r in model.words.collect():
        points |= dict(zip(pairs.unpack(r["hashes"])[0].astype(np.uint64).tolist(), 10 ** pairs.unpack(r["points"])[0], strict=True))
    left, delta = {}, {}
    states = {r["shard"]: r["note"] for r in model.notes.where(f"kind = {pairs.STATE}").collect()}
    near = pairs.points_for_pairs(model.words, model.notes).collect()
    for r in model.pairs.collect():
        cold, first, second, n = pairs.unpack(r["pairs"])
        deltas, lefts = model.deltas(cold, first, second, n, pairs.unpack(states[r["shard"]])[0].astype(float), [(x["hashes"], x["points"]) for x in near if x["shard"] == r["shard"]])
        own = np.concatenate([model.hot, cold.astype(np.uint64)]).tolist()
        for f, s, x in zip(first.tolist(), second.tolist(), deltas, strict=True):
            left[own[f]] = 10 ** lefts[f]
            delta[own[f], own[s]] = 10**x
    return points, left, lambda f, s: points[s] * delta.get((f, s), left.get(f, 1.0))


def test_pitman_yor_is_a_distribution(spark, prose):
    df = spark.createDataFrame([(i, prose(60)) for i in range(30)], "doc_id long, text string")
    model = pitman_yor.train(df, F.lit(True))
    points, left, p = predictive(model)
    assert math.isclose(sum(points.values()), 1, abs_tol=1e-6) and set(left) == set(points) - {None}
    for u in list(left)[:40]:  # each preceding word's restaurant is a distribution
        assert math.isclose(sum(p(u, w) for w in points), 1, abs_tol=1e-6)
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    line = lambda text: pairs.batch_line(pa.array([text]))[0].tolist()
    for r in pitman_yor.score(df, model, F.lit(False)).collect():
        own = line(texts[r["doc_id"]])
        assert math.isclose(r["score"], sum(math.log10(p(u, w)) for u, w in zip(own[:-1], own[1:], strict=True)), rel_tol=1e-6)


def test_pitman_yor_sees_word_order(spark, prose):
    texts = [" ".join(prose(1) + " alpha beta gamma delta " + prose(1) for _ in range(8)) for _ in range(30)]
    shuffled = ["alpha beta gamma delta", "delta gamma beta alpha", "alpha novel", "novel alpha"]
    df = spark.createDataFrame(list(enumerate(texts + shuffled)), "doc_id long, text string")
    model = pitman_yor.train(df, F.col("doc_id") < 30)
    made = {r["doc_id"]: r for r in pitman_yor.score(df, model, F.lit(False)).collect()}
    assert made[30]["score"] > made[31]["score"] + 3 and made[30]["base_score"] == pytest.approx(made[31]["base_score"])


def test_pitman_yor_is_the_same_in_any_partitions(spark, prose):
    texts = [prose(40) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = []
    before, shards_for = spark.conf.get("spark.sql.shuffle.partitions"), pairs.shards_for
    for partitions, shards in ((1, 8), (7, 3)):
        try:
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            pairs.shards_for = lambda _, n=shards: n
            own = df.repartition(partitions)
            model = pitman_yor.train(own, F.col("doc_id") < 40)
            scores.append({r["doc_id"]: r["score"] for r in pitman_yor.score(own, model, F.lit(False)).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            pairs.shards_for = shards_for
    assert scores[0].keys() == scores[1].keys() and all(math.isclose(scores[0][k], scores[1][k], rel_tol=1e-6) for k in scores[0])


def test_pitman_yor_on_awkward_rows(spark, prose):
    df = documents(spark, [prose(30), "unheard of"])
    made = pitman_yor.score(df, pitman_yor.train(df, F.col("doc_id") != 1), F.lit(False)).collect()
    assert len(made) == df.count() and {r["n_tokens"] for r in made if r["doc_id"] in (None, 900, 901)} == {1}
    none = pitman_yor.train(df.limit(0), F.lit(True))
    assert {(r["n_known"], r["train_tokens"]) for r in pitman_yor.score(df, none, F.lit(True)).collect()} == {(0, 0)}
    assert {r["doc_id"]: r["n_tokens"] for r in pitman_yor.score(df, none, F.lit(True)).collect()}[1] == 3
    assert pitman_yor.score(df.limit(0), none, F.lit(True)).count() == 0
    model = pitman_yor.train(df.where("doc_id = 900"), F.lit(True))  # nothing but an end
    assert pitman_yor.score(df, model, F.lit(True)).count() == df.count() and pitman_yor.score(df.limit(0), model, F.lit(True)).count() == 0


def stirling(customers, discount):
    """By number of tables: the summed weight of the ways to seat so many customers of one dish."""
    ways = [1.0] + [0.0] * customers
    for i in range(customers):
        ways = [0.0] + [ways[t - 1] + ways[t] * (i - discount * t) if t <= i else ways[t - 1] for t in range(1, i + 2)] + [0.0] * (customers - i - 1)
    return ways


def test_seating_equals_enumeration():
    customers, parent, strength, discount = np.array([5, 0, 3, 1, 8]), np.array([0.1, 0.2, 0.05, 0.2, 0.3]), 1.0, 0.6
    ways = [stirling(c, discount) for c in customers.tolist()]
    mass, mean = 0.0, np.zeros(5)
    for tables in itertools.product(*(range(1, c + 1) if c else [0] for c in customers.tolist())):
        weight = math.prod(ways[k][t] * parent[k] ** t for k, t in enumerate(tables)) * math.prod(strength + discount * i for i in range(sum(tables)))
        mass, mean = mass + weight, mean + weight * np.array(tables)
    got = pitman_yor.seat(customers, parent, strength, discount, np.arange(5, dtype=np.uint64), sweeps=4000)
    assert np.abs(got - mean / mass).max() < 0.05


def test_seating_counts():
    rng = np.random.default_rng(0)
    n = np.array([0, 1, 2, 10, 100_000])
    t = pitman_yor.seat(n, np.full(5, 0.1), 5.0, 0.5, np.arange(5, dtype=np.uint64))
    assert (t <= n).all() and (t[1:] >= 1).all() and t[0] == 0
    n = rng.zipf(1.7, 3000).clip(1, 5000)
    keys = np.arange(3000, dtype=np.uint64)
    seating = pitman_yor.Seating.fresh(n)
    for k in range(4):
        seating = seating.sweep(np.full(3000, 0.7), 0.4, keys, k)
        assert (seating.customers() == n).all() and (seating.sizes > 0).all() and (seating.tables <= n).all()
        n = np.maximum(1, n + rng.integers(-4, 5, 3000))
        seating = seating.fitted(n)
    some = np.append(keys[::3], keys[-4:] + np.uint64(10))
    carried = seating.carried(keys, some, np.full(len(some), 3))
    assert (carried.customers() == 3).all() and (carried.sizes > 0).all()
    assert (pitman_yor.Seating.unpacked(carried.packed()).sizes == carried.sizes).all()


def test_a_sweep_moves_as_many_customers_as_there_are():
    n, new, discount, dishes = 60, 30.0, 0.7, 500
    ways = np.array(stirling(n, discount)[: n + 1]) * new ** np.arange(n + 1)
    mean = (ways * np.arange(n + 1)).sum() / ways.sum()
    keys, customers, weight = np.arange(dishes, dtype=np.uint64), np.full(dishes, n), np.full(dishes, new)
    seating = pitman_yor.Seating.fresh(customers)
    for k in range(25):
        seating = seating.sweep(weight, discount, keys, k)
        assert (seating.customers() == customers).all() and (seating.sizes > 0).all()
        assert k or seating.tables.mean() > 12
    assert abs(seating.tables.mean() / mean - 1) < 0.03
    customers, weight, keys = np.array([60, 1, 2, 5000, 100_000, 61]), np.array([30.0, 1.0, 1.0, 400.0, 500.0, 30.0]), keys[:6]
    made = pitman_yor.Seating.fresh(customers).sweep(weight, discount, keys, 0)
    assert (made.customers() == customers).all() and (made.tables[3:5] > 100).all()
    for i in range(6):  # a dish is seated alike, whatever lies beside it
        alone = pitman_yor.Seating.fresh(customers[[i]]).sweep(weight[[i]], discount, keys[[i]], 0)
        assert (alone.sizes == made.sizes[made.bounds[i] : made.bounds[i + 1]]).all()


def test_packing():
    for own in ([], [0], [1, 300], [2**40], [2**63 + 5, 1], [0.5, -1.0]):
        assert pairs.unpack(pairs.pack(np.array(own, np.uint64 if own[:1] > [2**60] else None)))[0].tolist() == own
    assert [len(x) for x in pairs.unpack(pairs.pack(np.zeros(0), np.arange(3)))] == [0, 3]
    draws = pitman_yor.gammas(np.full(100_000, 2.5), np.arange(100_000, dtype=np.uint64), 3)
    assert abs(draws.mean() - 2.5) < 0.05 and abs(draws.var() - 2.5) < 0.1


# --- 8 ------------------------------------------------------------------------------------------------------------------


def without_repeats(rows, least):
    """Texts without later repeats, by listing every shortest run of so many words."""
    first, out = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0], 0)):
        own = [(i, x.strip(" \t\n\r\x0b\x0c")) for i, x in enumerate(text.split("\n"))]
        own = [(i, x, len(x.split())) for i, x in own if x]
        gone = set()
        for a in range(len(own)):
            b, total = a, 0
            while b < len(own) and total < least:
                total += own[b][2]
                b += 1
            if total < least:
                break
            if first.setdefault(tuple(x for _, x, _ in own[a:b]), (doc, a)) != (doc, a):
                gone |= set(range(own[a][0], own[b - 1][0] + 1))
        out[doc] = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    return out


def test_line_dedup_equals_brute_force(spark, prose):
    rng = random.Random(8)
    lines = [prose(rng.randint(1, 30)) for _ in range(25)] + ["", "  "]
    block = [prose(20) for _ in range(4)]
    rows = []
    for i in range(60):
        own = [rng.choice(lines) for _ in range(rng.randint(1, 14))]
        if i % 4 == 0:
            own[1:1] = block[rng.randint(0, 1) :]
        rows.append((i, "\n".join(own)))
    rows.append((60, "\n".join([prose(55)] * 3)))
    want = without_repeats(rows, 50)
    made = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["kept_text"] for r in made.collect()} == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup_on_awkward_rows(spark, prose):
    df = documents(spark, [prose(60), prose(60)])
    made = line_dedup.drop_repeated_lines(df)
    assert made.columns == [*df.columns, "_kept_text", "removed_lines", "_runs"] and made.count() == df.count()
    assert made.where("removed_lines > 0").count() == 0  # rows with equal id and text are one document
    copy = df.union(df.where("doc_id = 0").limit(1).withColumn("doc_id", F.lit(50).cast("long")))
    assert [r["doc_id"] for r in line_dedup.drop_repeated_lines(copy).where("_kept_text = '' and removed_lines > 0").collect()] == [50]
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


def test_line_dedup_of_hot_keys(spark, prose, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 3)
    rng = random.Random(4)
    shared = [prose(60), prose(55)]
    rows = [(i, "\n".join([prose(8), shared[i % 2], prose(8)] if i % 5 else [shared[0], shared[1]])) for i in range(30)]
    for keys in (100, 1):
        monkeypatch.setattr(line_dedup, "HOT_KEYS", keys)
        made = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), tails=True)
        assert {r["doc_id"]: r["kept_text"] for r in made.collect()} == without_any_repeats(rows, 50)


MAXIMAL_RUNS = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
t AS (SELECT doc_id, raw, line, regexp_replace(raw, '^[\t-\r ]+|[\t-\r ]+$', '', 'g') AS content FROM l),
s AS (SELECT doc_id, line, content, len(regexp_extract_all(content, '[^\t-\r ]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS nth FROM t WHERE content <> ''),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY nth)::BIGINT AS upto FROM s),
e AS (SELECT a.doc_id, a.nth AS first, b.nth AS last, b.upto - a.upto + a.words AS size, b.words AS tail, a.words AS head FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.nth >= a.nth AND b.upto - a.upto + a.words >= 50),
m AS (SELECT doc_id, first, last FROM e WHERE size - tail < 50 OR size - head < 50),
g AS (SELECT m.doc_id, first, last, list(c.content ORDER BY c.nth) AS run FROM m JOIN c ON c.doc_id = m.doc_id AND c.nth BETWEEN first AND last GROUP BY ALL),
r AS (SELECT doc_id, first, last, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS seen FROM g),
x AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS nth FROM r WHERE seen > 1)
SELECT d.doc_id, count(x.nth) AS removed_lines FROM documents d LEFT JOIN x USING (doc_id) GROUP BY d.doc_id
"""


def test_line_dedup_query_equals_sql_of_maximal_runs(spark):
    """The registered SQL has forward windows only; this has the shortest runs that begin or end at each line."""
    duck = pytest.importorskip("duckdb").connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = dict(duck.execute(MAXIMAL_RUNS).fetchall())
    assert {r["doc_id"]: r["removed_lines"] for r in queries.op8_line_dedup(spark, SF).collect()} == want and sum(want.values()) > 0


def without_any_repeats(rows, least):
    """Texts without later repeats, by listing every run of so many words or more."""
    first, out = {}, {}
    for doc, text in sorted(set(rows)):
        own = [(i, x.strip()) for i, x in enumerate(text.split("\n")) if x.strip()]
        gone = set()
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                run = tuple(x for _, x in own[a:b])
                if sum(len(x.split()) for x in run) >= least and first.setdefault(run, (doc, a)) != (doc, a):
                    gone |= set(range(own[a][0], own[b - 1][0] + 1))
        out[doc] = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    return out


def test_line_dedup_takes_whole_runs(spark, prose):
    rng = random.Random(9)
    lines = [prose(rng.randint(1, 45)) for _ in range(20)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12)))) for i in range(50)]
    shared, copy = [prose(60), prose(45)], "\n".join(prose(n) for n in (30, 30, 12))
    rows += [(50 + i, "\n".join([prose(9), *shared, prose(9)])) for i in range(2)] + [(60, copy), (61, copy)]
    want = without_any_repeats(rows, 50)
    made = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), tails=True)
    assert {r["doc_id"]: r["kept_text"] for r in made.collect()} == want
    assert want[61] == "" and not set(shared) & set(want[51].split("\n"))
    assert without_repeats(rows, 50) != want  # windows that run forward only leave the ends


# --- 9 ------------------------------------------------------------------------------------------------------------------


def recall(spark, table, every=50):
    rows = table.toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    made = ann.nearest(table, every).toPandas()
    hits = total = 0
    for k in np.flatnonzero(ids % every == 0):
        score = ann.cosine(x[k], x)
        best = [j for j in np.lexsort((ids, -score)) if j != k][:5]
        own = made[made.query_id == ids[k]].sort_values("rank")
        hits += len(set(own.vec_id) & set(ids[best]))
        total += 5
        assert own["rank"].tolist() == [1, 2, 3, 4, 5]
        for r in own.itertuples():
            assert math.isclose(r.score, score[list(ids).index(r.vec_id)], rel_tol=1e-12)
    return hits / total


def test_nearest_recall(spark):
    assert recall(spark, spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")) >= 0.9


def test_nearest_recall_with_many_lists_and_few(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 24))
    rows = [(i, (centres[i % 60] + 0.6 * rng.normal(size=24)).tolist()) for i in range(6000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(ann, "LIST_SIZE", 15)  # 400 lists
    assert recall(spark, table, 100) >= 0.9
    monkeypatch.setattr(ann, "CENTROIDS", 8)  # beyond which lists grow with the vectors: 154 of 39
    assert ann.centroid_count(6000) == 154 and recall(spark, table, 100) >= 0.9


def test_nearest_by_dimension(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3 if i % 3 else 2).tolist()) for i in range(400)]
    exact = lambda made: {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in made.collect()}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {}
    for i, v in rows:
        if i % 50 == 0:
            near = sorted((-round(float(ann.cosine(np.array(v), np.array([x]))[0]), 12), j) for j, x in rows if j != i and len(x) == len(v))[:5]
            want |= {(i, r): (j, round(-s, 9)) for r, (s, j) in enumerate(near, 1)}
    assert exact(ann.nearest(table, 50)) == want  # all are compared
    monkeypatch.setattr(ann, "INDEXED", 100)
    monkeypatch.setattr(ann, "LIST_SIZE", 2)
    monkeypatch.setattr(ann, "LEAST_PROBES", 1)
    monkeypatch.setattr(ann, "RATIO", 0.0)  # the first list has too few: such queries read all
    assert exact(ann.nearest(table, 50)) == want


def test_nearest_on_awkward_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (50, [1.0, 1.0]), *((k, [1.0, 0.0]) for k in range(60, 90))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    made = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 6)) for r in ann.nearest(df, 50).collect()}
    assert [made[0, k][0] for k in range(1, 6)] == [1, 2, 60, 61, 62] and [made[50, k][0] for k in range(1, 6)] == [0, 1, 2, 3, 60]
    assert made[100, 1] == (8, 1.0) and (100, 2) not in made
    assert ann.nearest(df.limit(0), 50).count() == 0 and ann.nearest(df.where("vec_id in (0, 3)"), 50).collect()[0]["vec_id"] == 3
    assert ann.nearest(df.where("vec_id = 0"), 50).count() == 0


# --- 10 -----------------------------------------------------------------------------------------------------------------


def smith_waterman(a, b):
    score, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            score[i][j] = max(0, score[i - 1][j - 1] + (2 if x == y else -1), score[i - 1][j] - 1, score[i][j - 1] - 1)
            best = max(best, score[i][j])
    return best


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = (rng.integers(0, 5, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        score, begin, end = decontaminate.align(a, b)
        assert score == smith_waterman(a.tolist(), b.tolist()) and (score == 0 or smith_waterman(a.tolist(), b[begin:end].tolist()) == score)


def test_leaks_equal_brute_force(spark, prose):
    rng = random.Random(10)
    items = [prose(rng.randint(12, 40)) for _ in range(6)]
    texts = [prose(60) for _ in range(10)]
    for item in items:
        for edits in (0, 1, 2, 3):
            own = item.split()
            for _ in range(edits):
                own[rng.randrange(len(own))] = prose(1)
            texts.append(prose(20) + " " + " ".join(own).upper() + ", " + prose(20))
    least = 0.6
    want = set()
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            a, b = (re.findall("[a-z0-9]+", x.lower()) for x in (item, t))
            if smith_waterman(a, b) >= least * 2 * len(a):
                want.add((i, j))
    made = decontaminate.find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), least_score=least)
    assert {(r["doc_id"], r["item_id"]) for r in made.collect()} == want and len(want) >= 20


def test_leaks_with_insertions_and_short_items(spark, prose):
    rng = random.Random(12)
    items = [" ".join(f"i{j}w{k}" for k in range(m)) for j, m in enumerate((2, 4, 5, 8, 12, 20, 30))]
    texts = [prose(60)]
    for item in items:
        own = item.split()
        middle = [*own[: len(own) // 2], "changed", *own[len(own) // 2 + 1 :]]
        copies = [middle, own[1:], own[:1] + own[2:], [x for k, w in enumerate(own) for x in ([w, "put"] if k % 2 else [w])]]
        for _ in range(12):
            copy = list(own)
            for _ in range(rng.randint(1, len(own))):
                at = rng.randrange(len(copy) + 1)
                copy[at : at + rng.choice((0, 0, 0, 1))] = [rng.choice(("put", "in"))]
            copies.append(copy)
        texts += [prose(15) + " " + " ".join(c) + " " + prose(15) for c in copies]
    want = {(i, j) for i, t in enumerate(texts) for j, item in enumerate(items) if smith_waterman(item.split(), t.split()) >= 0.6 * 2 * len(item.split())}
    made = decontaminate.find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), least_score=0.6)
    assert {(r["doc_id"], r["item_id"]) for r in made.collect()} == want and len(want) > 50


def test_leaks_on_awkward_rows(spark, prose):
    df = documents(spark, [prose(30), "two words"])
    items = spark.createDataFrame([(1, None), (2, ""), (3, "word"), (4, "two words"), (5, prose(20)), (5, LONG[-300:])], "item_id long, text string")
    made = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, items).collect()}
    assert made == {(1, 4), (902, 5)}
    assert decontaminate.find_leaks(df, items.limit(0)).count() == 0 and decontaminate.find_leaks(df.limit(0), items).count() == 0


# --- pipeline, helpers --------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = common.written(stage(spark, docs, SF), "stage")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert made.schema == docs.schema and 0 < made.count() <= docs.count()
            docs = made
    assert made.count() == docs.count()
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("labels", "benchmark"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.train(docs, labels, common.crc_fold(F.col("doc_id"), 5) != 0)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    z = {i: sum(weight.get(x, 0.0) for x in features.tolist()) + model.bias for i, features in zip(rows, toxicity.document_features(pa.array([t.lower() for t in rows.values()])), strict=True)}
    rows = {i: t for i, t in rows.items() if z[i] < 0}
    cut = without_any_repeats(list(rows.items()), 50)
    rows = {i: cut[i] for i in sorted(rows) if cut[i].strip() or not rows[i].strip()}
    _, root = components_of(list(rows.values()), 5, 80)
    rows = {i: t for k, (i, t) in enumerate(rows.items()) if root[k] == k}
    benchmark = [w for w in decontaminate._word_hashes([r["text"] for r in items.collect()]) if len(w) >= 2]
    held = zip(rows, decontaminate._word_hashes(list(rows.values())), strict=True)
    leaks = {i for i, own in held if any(np.isin(item, own).mean() >= 0.6 and decontaminate.align(item, own)[0] >= 1.2 * len(item) - 1e-9 for item in benchmark)}
    rows = {i: t for i, t in rows.items() if i not in leaks}
    library = tokenizers.Tokenizer.from_file(queries._tokenizer_file())
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows.items()}
    made = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in made} == want and len(made) == len(want) and leaks
    assert all(r["n_tokens"] == len(want[r["doc_id"]]) and r["decoded_sha256"] == hashlib.sha256(library.decode(want[r["doc_id"]], skip_special_tokens=False).encode()).hexdigest() for r in made)


def test_pipeline_stages_on_awkward_rows(spark, prose, tmp_path):
    import corpus_pipeline

    passage, item = prose(60), prose(14)
    df = documents(spark, [prose(40), prose(40) + " " + item, prose(9) + "\n" + passage, prose(9) + "\n" + passage, prose(50) + " idiot"]).drop("runs")
    spark.createDataFrame([(i, int(i == 4)) for i in range(5)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = df.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = common.written(stage(spark, df, str(tmp_path)), "stage")
        left = Counter(r["doc_id"] for r in made.collect())
        assert {None, 900, 901, 902, 0} <= set(left), name
        if k + 1 < len(corpus_pipeline.STAGES):
            assert made.columns == df.columns and made.where("score = 'own score'").count() == made.count()
            df = made
        if name == "line_dedup":
            assert sum(left.values()) == before and {r["doc_id"] for r in made.collect() if r["text"] and passage in r["text"]} == {2}
        if name == "jaccard_join":
            assert left[0] == 1 and sum(left.values()) == before - 2
        if name == "decontamination":
            assert 1 not in left and sum(left.values()) == before - 3


def test_near_copies_go_by_row(spark, prose):
    import corpus_pipeline

    a, b, c, d = (prose(80) for _ in range(4))
    rows = [(1, a), (2, a + " x"), (2, b), (3, c), (3, c + " y"), (3, c), (None, a), (None, d), (None, d + " z"), (None, d), (4, ""), (4, ""), (None, None), (None, None)]
    made = corpus_pipeline.without_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    left = Counter((r["doc_id"], r["text"]) for r in made)
    assert left[1, a] == left[2, b] == left[4, ""] == 1 and left[None, None] == 2 and sum(left.values()) == 7
    assert sum(n for (i, _), n in left.items() if i == 3) == 1 and left[None, d] + left[None, d + " z"] == 1


def test_written_tables_go(spark):
    made = common.written(spark.range(5).toDF("id"), "t")
    path = made._loom_path.removeprefix("file:")
    assert made.count() == 5 and Path(path).exists()
    common.discard(made)
    assert not Path(path).exists()
