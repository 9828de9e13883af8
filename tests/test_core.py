"""Hand-computed cases for the corpus operators, and the quirks that are decided in SURVEY 2.16."""

import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import vector as V
from corpusloom.operators import annotate, basic, dedup, filters, lexicon, search, stats, vectors
from corpusloom.plans import feedback, spec
from corpusloom.sources import readers, webarchive, writers
from corpusloom.streaming import streams

COUNTS = [("A", {"fire": 2, "flood": 1, "the": 1}), ("B", {"fire": 1}), ("C", {"calm": 2, "fire": 1}), ("D", {"calm": 1})]


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame(COUNTS, "url string, lemmas_counts map<string,bigint>")


@pytest.fixture(scope="module")
def base(counts):
    return stats.tf_df(counts, {"lemmas": 1})


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n][0] for n in names)], ", ".join(f"{n} {values[n][1]}" for n in names))
    return df.select(column.alias("x")).first()["x"]


def test_tf_df(counts, base):
    assert rows(base.select("term", "tf", "df")) == [("calm", 3, 2), ("fire", 4, 3), ("flood", 1, 1), ("the", 1, 1)]
    assert rows(stats.tf_df(counts, {"lemmas": 2}).select("term", "tf", "df"))[1] == ("fire", 8, 3)


def test_idf_and_ratio(counts, base):
    weights = dict(rows(stats.idf_weights(base, 4)))
    assert weights["fire"] == 0 and math.isclose(weights["flood"], 0.847298, abs_tol=1e-6)
    subset = stats.tf_df(counts.where("url in ('A', 'B')"), {"lemmas": 1})
    ratio = {r["term"]: r["weight"] for r in stats.log_tf_ratio(subset, base).collect()}
    assert math.isclose(ratio["fire"], 0.300105, abs_tol=1e-6) and math.isclose(ratio["flood"], 0.587787, abs_tol=1e-6) and "calm" not in ratio


def test_search_both_ways(spark, counts):
    query = {"fire": 1.0, "flood": 0.5}
    maps = {r["url"]: r["score"] for r in search.search_maps(counts, query, {"lemmas_counts": 1}, k1=2, avgdl=4).collect()}
    posts = counts.select("url", F.explode("lemmas_counts").alias("term", "tf"))
    table = spark.createDataFrame(list(query.items()), "term string, weight double")
    joined = {r["url"]: r["score"] for r in search.search_postings(posts, table, "url", k1=2, avgdl=4.0).collect()}
    for got in (maps, joined):
        assert got.keys() == {"A", "B", "C"} and math.isclose(got["A"], 2) and math.isclose(got["B"], 1.6) and math.isclose(got["C"], 3 / 2.625)
    tf = {r["url"]: r["score"] for r in search.search_postings(posts, table, "url", "tf").collect()}
    assert tf == {"A": 2.5, "B": 1, "C": 1}
    assert [r["url"] for r in search.top(search.search_postings(posts, table, "url", k1=2, avgdl=4.0), "url", 2).collect()] == ["A", "B"]
    assert search.search_maps(counts, query, {"lemmas_counts": 1}, avgdl=0).count() == 0  # Q20
    with pytest.raises(ValueError):
        search.term_score("other", F.lit(1), F.lit(1), F.lit(1))


def test_feedback_finds_more(spark, counts):
    posts = counts.select("url", F.explode("lemmas_counts").alias("term", "tf"))
    query = spark.createDataFrame([("flood",)], "term string")
    assert {r["url"] for r in feedback.feedback(posts, query, "url", hits=1, rounds=1).collect()} == {"A", "B", "C"}


@pytest.mark.parametrize("text, strict, want", [("a b\nc", False, (1, 3, 5)), ("a b\nc", True, (2, 3, 5)), ("a b\nc\n", False, (3, 3, 6)), ("a b\nc\n", True, (2, 3, 6)), ("", False, (0, 0, 0)), (None, False, (0, 0, 0))])
def test_word_count(spark, text, strict, want):
    assert tuple(one(spark, X.word_count(F.col("t"), strict), t=(text, "string"))) == want


def test_conll(spark):
    value = [[["Fires", "fire", "NNS"], ["hit", "hit", "VBD"], ["New York", "New York", "NNP"]]]
    kind = "array<array<array<string>>>"
    assert one(spark, X.conll_list(F.col("s"), "lemma", True, "NNP"), s=(value, kind)) == ["fire", "hit", "NNP"]
    assert one(spark, X.conll_list(F.col("s"), "lemma", True), s=(value, kind)) == ["fire", "hit", "new_york"]
    assert one(spark, X.conll_text(F.col("s"), 0), s=(value, kind)) == "Fires hit New_York"
    with pytest.raises(ValueError):
        X.column_number("tag")


def test_sequences(spark):
    kind = "array<string>"
    stop = X.stop_word_filter(["the"])
    assert one(spark, X.bigrams(F.col("a"), [stop]), a=(["the", "big", "fire", "42"], kind)) == ["big fire", "fire 42"]
    for short in (["x"], []):
        assert one(spark, X.bigrams(F.col("a")), a=(short, kind)) == []
    assert one(spark, X.shingles(F.col("a"), 5), a=(list("abcd"), kind)) == []
    assert one(spark, X.shingles(F.col("a"), 5), a=(list("abcdef"), kind)) == ["a b c d e", "b c d e f"]
    assert one(spark, X.counts(F.col("a")), a=(list("abab") + ["c"], kind)) == {"a": 2, "b": 2, "c": 1}
    assert one(spark, X.counts(F.col("a")), a=([], kind)) == {} and one(spark, X.counts(F.col("a")), a=(None, kind)) is None
    assert one(spark, X.filter_words(F.col("a"), [X.alnum_filter()]), a=(["--", "é", "a1"], kind)) == ["a1"]
    assert one(spark, X.bigrams_of_unigrams(F.col("a"), F.col("u")), a=(["big fire", "fire 42", "fire"], kind), u=(["fire", "42"], kind)) == ["fire 42"]
    assert one(spark, X.bigrams_of_set(F.col("m"), F.array(F.lit("big"), F.lit("fire")), True), m=({"big fire": 2, "fire 42": 1}, "map<string,bigint>")) == {"big fire": 2}


def test_aggregates(spark):
    df = spark.createDataFrame([({"a": 1, "b": 1},), ({"a": 2, "b": 3, "c": 1},), (None,)], "m map<string,bigint>")
    assert rows(basic.dict_aggregate(df, ["m"])) == [("m", "a", 3), ("m", "b", 4), ("m", "c", 1)]
    assert one(spark, X.add_counts(F.col("a"), F.col("b")), a=({"x": 1}, "map<string,bigint>"), b=({"x": 2, "y": 1}, "map<string,bigint>")) == {"x": 3, "y": 1}
    assert basic.doc_count(df).first()["n"] == 3 and basic.field_sum(spark.range(0), "id").first()["total"] is None


def test_truthiness(spark):
    df = spark.createDataFrame([("", []), (None, []), ("x", []), ("", [1])], "a string, b array<int>")
    assert basic.filter_empty(df, ["a", "b", "absent"]).count() == 2
    assert basic.get_field(spark.createDataFrame([(0,), (2,), (None,)], "n int"), "n").count() == 1
    assert basic.retain_fields(df, ["c"]).count() == 0


def test_sets(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "u string")
    items = spark.createDataFrame([("a",)], "item string")
    assert rows(basic.in_set(df, "u", items)) == [("a",)] and rows(basic.not_in_set(df, "u", items)) == [("b",)]
    assert "LeftSemi" in basic.in_set(df, "u", items)._jdf.queryExecution().executedPlan().toString()
    lists = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "b"), ("z", "c")], "list string, word string")
    shared, alone = basic.common_items(lists), basic.unique_items(lists)
    assert rows(alone) == [("x-unique", "a"), ("z-unique", "c")] and rows(shared) == [("x-common", "b"), ("y-common", "b")]
    assert rows(basic.intersections(lists)) == [("x-y", "b")]
    assert rows(basic.membership_mask(lists, ["x", "y", "z"])) == [("a", 1), ("b", 3), ("c", 4)]


def test_top_k(spark):
    df = spark.createDataFrame([(i, i % 2, i * 10) for i in range(10)], "id int, part int, v int")
    assert "TakeOrderedAndProject" in basic.sorter(df, [("v", True)], 3)._jdf.queryExecution().executedPlan().toString()
    assert [r["id"] for r in basic.two_level_top(df, [("v", True)], "part", 1, 5).collect()] == [9, 8]


def test_band_parameters():
    assert [dedup.bands_for(t, 128) for t in (0.85, 0.9, 0.8, 0.7, 0.5)] == [(8, 16), (5, 25), (9, 13), (14, 9), (25, 5)] and dedup.bands_for(0.85, 64) == (4, 15)


def test_survivors_are_greedy(spark):
    chain = spark.createDataFrame([("a", 0, "p"), ("b", 0, "p"), ("b", 1, "q"), ("c", 1, "q"), ("d", 2, "r")], "id string, band int, bucket string")
    urls = spark.createDataFrame([("a", "u"), ("d", "u"), ("b", "v"), ("c", "w")], "id string, url string")
    assert rows(dedup.survivors(chain, "id", urls)) == [("a",), ("c",)]
    rng = np.random.default_rng(5)
    for _ in range(3):
        made = [(int(i), int(b), str(rng.integers(0, 12))) for i in range(40) for b in range(3)]
        kept = []
        for i in range(40):
            own = {(b, g) for j, b, g in made if j == i}
            if not any(own & {(b, g) for j, b, g in made if j == k} for k in kept):
                kept.append(i)
        assert [r[0] for r in rows(dedup.survivors(spark.createDataFrame(made, "id int, band int, bucket string"), "id"))] == kept


def test_select_terms(spark):
    terms = spark.createDataFrame([("fire", 3.2, 10, 40), ("forest fire", 2.5, 4, 5), ("NNP", 9.0, 1, 1), ("x1", 5.0, 2, 2), ("-ed", 4.0, 2, 2)], "term string, weight double, subset_df int, base_df int")
    query = spark.createDataFrame([("fire",), ("quake",)], "term string")
    label = {w: [r["term"] for r in stats.select_terms(terms, query, w, min_ur=3, min_br=2).collect()] for w in ("new", "query", "missing")}
    assert label == {"new": ["forest fire"], "query": ["fire"], "missing": ["quake"]}
    for bad in ("rr", "x", ""):
        with pytest.raises(ValueError):
            stats.sort_terms(terms, bad)


def test_cross_filter(spark):
    own = spark.createDataFrame([("u", "a", 1.0, 1), ("u", "b", 1.0, 1), ("b", "a b", 1.0, 1), ("b", "a c", 1.0, 1), ("b", "a", 1.0, 1)], "field string, term string, tf double, df bigint")
    assert [r[1] for r in rows(stats.cross_filter(own, "u", "b"))] == ["a b", "a", "b"]


def at(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


@pytest.fixture(scope="module")
def circle(spark):
    return spark.createDataFrame([(i, w, at(x)) for i, (w, x) in enumerate((("a", 0), ("b", 20), ("c", 35), ("d", 100)))], "idx long, word string, vec array<double>")


def test_angles(spark):
    assert math.isclose(one(spark, V.angular(V.dot(F.col("a"), F.col("b"))), a=(at(0), "array<double>"), b=(at(100), "array<double>")), 0.555556, abs_tol=1e-6)
    assert all(math.isnan(x) for x in one(spark, V.normalize(F.col("a")), a=([0.0, 0.0], "array<double>")))


def test_emscan(spark, circle):
    seeds = circle.where("word = 'a'").select("idx")
    assert rows(vectors.emscan(vectors.similarity_edges(circle, 0.9), seeds)[0]) == [(0, 0)]
    edges = vectors.similarity_edges(circle, 0.9)
    members, nodes, graph = vectors.emscan(edges, seeds, method="dcg", dcg_length=2, min_dcg=0.6)
    assert rows(members) == [(0, 0), (1, 1), (2, 2)]
    assert rows(vectors.without_isolated_seeds(nodes, graph)) == rows(members) and "<edge" in vectors.graphml(nodes, graph)
    gain = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 1)], "r int, m int").agg(F.sum(F.col("m") * vectors.dcg_gain(F.col("r")))).first()[0]
    assert math.isclose(gain, 2.130930, abs_tol=1e-6)
    with pytest.raises(ValueError):
        vectors.similarity_edges(circle, 0)


def test_neighbours_and_small_problems(spark, circle):
    found = vectors.neighbours(circle, spark.createDataFrame([("a",)], "word string"), 2)
    assert [(r["word"], r["rank"]) for r in found.orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    given = spark.createDataFrame([("new", at(99))], "word string, vec array<double>")
    assert vectors.neighbours(circle, given, 1).first()["word"] == "d"
    assert vectors.mds(circle, "euc").count() == 4
    gold = spark.createDataFrame([("a", 1), ("b", 1), ("d", -1)], "word string, value int")
    ranked = [r["word"] for r in vectors.project(circle, vectors.densifier(circle, gold)).collect()]
    assert ranked[-1] == "d"
    dense = {r["word"]: r["vec"] for r in vectors.to_dense(vectors.to_sparse(circle), 2).collect()}
    assert all(np.allclose(dense[r["word"]], r["vec"]) for r in circle.collect())


def test_sparse_dot_searches_all_vectors(spark, tmp_path):
    from corpusloom import catalog

    rng = np.random.default_rng(4)
    x = {i: rng.normal(size=6) for i in (0, 1, 2, 99, 100, 101, 250)}
    spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in x.items()], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    made = {(r["a_word"], r["b_word"]): r["dot"] for r in catalog.sparse_dot(spark, str(tmp_path)).collect()}
    assert set(made) == {(f"w{a}", f"w{b}") for a in (0, 100) for b in x}
    for (a, b), dot in made.items():
        u, v = x[int(a[1:])], x[int(b[1:])]
        assert math.isclose(dot, u @ v / math.sqrt((u @ u) * (v @ v)), abs_tol=1e-5)


def test_lexicon(spark):
    own = spark.createDataFrame([("blaze", "big hot fire"), ("ember", "hot bit"), ("blaze", "a second one")], "headword string, definition string")
    assert [r[0] for r in rows(lexicon.numbered(own))] == ["blaze", "blaze_2", "ember"]
    bags = lexicon.bags(own.where("definition <> 'a second one'"), spark.createDataFrame([("fire",), ("hot",), ("big",)], "term string"))
    found = {(r["word"], r["headword"]): r for r in lexicon.similar(bags, spark.createDataFrame([("ember",)], "w string"), True).collect()}
    assert math.isclose(found["ember", "blaze"]["similarity"], 0.577350, abs_tol=1e-6) and found["ember", "blaze"]["common"] == ["hot"] and ("ember", "ember") in found
    assert rows(lexicon.headwords_of(own, spark.createDataFrame([("hot",)], "w string"))) == [("blaze", ["hot"]), ("ember", ["hot"])]


def test_domains_and_languages(spark):
    parts = one(spark, filters.domain_parts(F.col("u")), u=("http://News.Example.co.uk/x", "string"))
    assert tuple(parts) == ("news", "example", "co.uk")
    df = spark.createDataFrame([("http://a.example.com/",), ("nothing",), (None,)], "url string")
    assert filters.domain_filter(df, ["com"]).count() == 1 and filters.domain_filter(df, ["com"], retain=False).count() == 0
    texts = spark.createDataFrame([("the cat and the dog is here",), ("der Hund und die Katze",), ("12345",), (None,)], "t string")
    assert [r[0] for r in texts.select(filters.detect_language([F.col("t")])).collect()] == ["en", "de", None, None]
    assert filters.language_filter(texts, ["t"], ["en"], ["function_words", "trigrams"]).count() == 1


def test_readers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in" / "x.json.gz", "wt") as f:
        f.write('{"url": "u0"}\n{"url": "u1"}\n')
    from corpusloom import schemas

    ids = readers.json_documents(spark, str(tmp_path / "in"), schemas.RAW_DOCUMENT, add_id="record_id")
    assert sorted((r["record_id"], r["url"]) for r in ids.collect()) == [("x.json.gz-0", "u0"), ("x.json.gz-1", "u1")]
    (tmp_path / "v.txt").write_text("a 1 2\nb 3\nc x y\nd 4 5\n")
    assert [r["word"] for r in readers.text_vectors(spark, str(tmp_path / "v.txt"), 2).orderBy("word").collect()] == ["a", "d"]
    (tmp_path / "s.txt").write_text("p\nq\np\n")
    assert rows(readers.word_set(spark, str(tmp_path / "s.txt"))) == [("p",), ("q",)]
    (tmp_path / "q.tsv").write_text("a\t2\nb\na\t3\n")
    assert rows(readers.query_file(spark, str(tmp_path / "q.tsv"))) == [("a", 3.0), ("b", 1.0)]
    (tmp_path / "st.json").write_text(json.dumps([{"f": {"TF": {"a": 2}, "DF": {"a": 1}}}]))
    assert rows(readers.term_stats_json(spark, str(tmp_path / "st.json"))) == [("f", "a", 2.0, 1)]
    (tmp_path / "c.conll").write_text("1\tA\n2\tb\n\n1\tC\n")
    made = readers.conll_documents(spark, str(tmp_path / "c.conll"))
    assert made.first()["content"] == [[["1", "A"], ["2", "b"]], [["1", "C"]]]
    np.savez(tmp_path / "v.npz", words=np.array(["a", "b"]), vectors=np.eye(2))
    assert [r["vec"] for r in readers.npz_vectors(spark, str(tmp_path / "v.npz")).orderBy("idx").collect()] == [[1.0, 0.0], [0.0, 1.0]]
    assert readers.dictionary(spark, str(tmp_path / "q.tsv")).where("definition = ''").count() == 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], None)], "k string, v array<string>, n int")
    assert writers.tsv_line(df).first()[0] == "a\tx\ty\t"
    writers.json_lines(df, str(tmp_path / "out"))
    assert "n" not in spark.read.json(str(tmp_path / "out")).columns
    own = spark.createDataFrame([("f", "a", 2.0, 1)], "field string, term string, tf double, df bigint")
    assert json.loads(writers.term_stats_json(own).first()[0]) == {"f": {"TF": {"a": 2.0}, "DF": {"a": 1}}}
    vec = spark.createDataFrame([(0, "a", [1.0, 2.0])], "idx long, word string, vec array<double>")
    writers.vectors_to_text(vec, str(tmp_path / "vec"))
    assert readers.text_vectors(spark, str(tmp_path / "vec")).first()["vec"] == [1.0, 2.0]
    text = one(spark, writers.conll_text(F.col("s")), s=([[["1", "A"]], [["1", "B"]]], "array<array<array<string>>>"))
    assert text == "1\tA\n\n1\tB\n\n"


def record(kind, uri, block):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_warc(spark, tmp_path):
    page = b"<html><body><p>" + b"word " * 40 + b"</p><script>no</script></body></html>"
    ok = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + page
    gone = b"HTTP/1.1 404 Not Found\r\n\r\nx"
    odd = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=nothing\r\n\r\nx"
    data = b"".join(gzip.compress(record(k, u, b)) for k, u, b in (("warcinfo", "", b""), ("response", "http://a/", ok), ("response", "http://b/", gone), ("response", "http://c/", odd)))
    (tmp_path / "f.warc.gz").write_bytes(data)
    (tmp_path / "bad.warc.gz").write_bytes(b"\x1f\x8bbroken")
    made = webarchive.warc_documents(spark, str(tmp_path)).collect()
    assert [(r["url"], r["content"].split()[0]) for r in made] == [("http://a/", "word")] and "no" not in made[0]["content"]
    assert webarchive.canonical_charset("cp-1250") == "cp1250" and webarchive.archive_stem("p/a.warc.gz") == "p/a"
    assert webarchive.http_body(b"HTTP/1.0 301 Moved\r\n\r\n") is None
    with pytest.raises(ValueError):
        webarchive.archive_stem("a.txt")
    assert webarchive.paragraphs("<p>" + "long text " * 20 + "</p><p><a href=x>" + "link " * 30 + "</a></p>").startswith("long")


def test_specifications(spark, tmp_path):
    text = spec.config_file("count_tf")
    with pytest.raises(ValueError, match="input"):
        spec.load(text, output="x")
    assert spec.load(text, input="a", output="b")["source"]["path"] == "a"
    with pytest.raises(ValueError):
        spec.build([{"step": "os.system"}])
    df = spark.createDataFrame([("u", ["a", "b", "a"], [])], "url string, lemmas array<string>, lemmas_bigrams array<string>")
    steps = spec.load(text, input="a", output="b")["pipeline"]
    assert spec.build(steps)(df).first()["lemmas_counts"] == {"a": 2, "b": 1}
    for preset in spec.PRESETS.glob("*.json"):
        made = spec.load(preset.read_text(), input="a", output="b", jaccard=0.85, unique="u", urls="u", query={"a": 1.0}, avgdl=10.0, num_docs=5)
        spec.build([*made["pipeline"], *([made["reducer"]] if "reducer" in made else [])])
    kept = spec.build([{"step": "get_field", "field": "url", "connection": "filter"}])(df)
    assert kept.columns == df.columns and kept.count() == 1


def test_annotator(spark):
    df = spark.createDataFrame([("The cat saw Rome. It ran!",), (None,), ("",)], "t string")
    made = annotate.annotate(df, ["t", "absent"]).collect()
    assert [len(r["t_corenlp"] or []) for r in made] == [2, 0, 0] and made[0]["t_corenlp"][0][3][2] == "NNP"
    assert list(annotate.text_chunks("a\nb\nc", 2)) == ["a\nb\n", "c"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"url": "u", "content": "a b a"}\n{"url": "v", "content": ""}\n')
    from corpusloom import schemas

    stream = streams.documents(spark, str(tmp_path / "in"), schemas.RAW_DOCUMENT)
    streams.to_memory(streams.term_frequencies(streams.steps(stream, [{"step": "filter_empty", "fields": ["content"]}]), X.tokens(F.col("content")), "f"), "terms", "complete").awaitTermination()
    assert rows(spark.table("terms")) == [("f", "a", 2, 1), ("f", "b", 1, 1)]
    with pytest.raises(ValueError):
        streams.steps(stream, [{"step": "doc_count"}])


def test_names_and_numbers(spark):
    assert one(spark, X.base_name(F.col("p")), p=("a/b.c/x.json.gz", "string")) == "x" and one(spark, X.set_name(F.col("p")), p=("a/list.txt", "string")) == "list"
    assert one(spark, X.replace_extension(F.col("p"), "tsv"), p=("a/x.json.gz", "string")) == "a/x.tsv.gz" and one(spark, X.replace_extension(F.col("p"), "tsv"), p=("x.doc", "string")) == "x.doc"
    df = spark.createDataFrame([(["a", "b"],)], "v array<string>")
    assert tuple(df.select(*X.item_getter(F.col("v"), 1, 5, 0, defaults=["x", "y"])).first()) == ("b", "y", "a")


def test_record_ids_of_survivors(spark):
    words = [f"w{i}" for i in range(30)]
    rows_ = [(f"x.json-{i}", f"u{i % 11}", words if i % 2 else [f"v{i}x{j}" for j in range(30)]) for i in range(12)]
    df = spark.createDataFrame(rows_, "record_id string, url string, words array<string>")
    run = spec.build([{"step": "minhash", "fields": ["words"], "key": "record_id", "keep": ["url"]}, {"step": "lsh", "id_field": "url", "threshold": 0.85, "out_field": "record_id"}])
    # of the copies the first line stays (1, not 11 or 3); line 11 has line 0's url and is a copy anyway
    assert {r["record_id"] for r in run(df).collect()} == {"x.json-1", *(f"x.json-{i}" for i in range(0, 12, 2))}


def test_any_step_can_be_rewired(spark):
    df = spark.createDataFrame([("u", ["a"]), ("", []), (None, ["b"])], "url string, lemmas array<string>")
    values = spec.build([{"step": "filter_empty", "fields": ["url"], "connection": "map"}])(df)
    assert [tuple(r) for r in values.collect()] == [(True,)]
    kept = spec.build([{"step": "counts", "fields": ["lemmas"], "connection": "filter"}])(df)
    assert kept.columns == df.columns and kept.count() == 3
    assert spec.build([{"step": "retain_fields", "fields": ["url"], "connection": "filter"}])(df).count() == 2
    with pytest.raises(ValueError):
        spec.build([{"step": "minhash", "fields": ["lemmas"], "key": "url", "connection": "filter"}])(df)


def test_warc_records_that_hold_a_separator(spark, tmp_path):
    inner = b"<p>a</p>\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n<p>b</p>"
    block = b"HTTP/1.1 200 OK\r\n\r\n" + inner
    data = record("RESPONSE", "http://a/", block) + record("response", "http://b/", b"HTTP/1.1 200 OK\r\n\r\nx") + record("request", "http://c/", block)
    (tmp_path / "p.warc").write_bytes(data)
    (tmp_path / "q.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (data, record("response", "http://d/", b"HTTP/1.1 200 OK\r\n\r\n\xff"))))
    made = rows(webarchive.warc_documents(spark, str(tmp_path), "html").select("url", "content"))
    assert made == sorted([("http://a/", inner.decode()), ("http://b/", "x")] * 2 + [("http://d/", "\ufffd")])


def test_files_of_vectors_and_statistics(spark, tmp_path):
    for name, word in (("a", "x"), ("b", "y")):
        np.savez(tmp_path / f"{name}.npz", words=np.array([word]), vectors=np.eye(1))
    made = readers.npz_vectors(spark, str(tmp_path)).collect()
    assert len({r["idx"] for r in made}) == 2
    writers.vectors_to_npz(spark.createDataFrame([(0, "a", [1.0, 2.0])], "idx long, word string, vec array<double>"), str(tmp_path / "out.npz"))
    assert readers.npz_vectors(spark, str(tmp_path / "out.npz")).first()["vec"] == [1.0, 2.0]
    own = spark.createDataFrame([("f", f"t{i}", 2.0, 1) for i in range(40)], "field string, term string, tf double, df bigint")
    writers.term_stats_json(own, 7).write.text(str(tmp_path / "stats"))
    assert rows(readers.term_stats_json(spark, str(tmp_path / "stats"))) == rows(own)


def test_windowed_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps({"url": u, "at": f"2024-01-01T00:0{m}:00Z"}) + "\n" for u, m in (("u", 0), ("u", 1), ("v", 7))))
    from pyspark.sql.types import StructType

    stream = lambda: streams.documents(spark, str(tmp_path / "in"), StructType.fromDDL("url string, at timestamp"))
    streams.to_memory(streams.windowed_counts(stream(), "at", "1 hour", "5 minutes"), "windows", "complete").awaitTermination()
    assert sorted(r["n"] for r in spark.table("windows").collect()) == [1, 2]
    streams.to_parquet(streams.first_by_url(stream(), "at", "1 hour"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["u", "v"]


def test_command_line(spark, tmp_path):
    from corpusloom import cli

    at = lambda name: str(tmp_path / name)
    lines = lambda name: sorted(r[0] for r in spark.read.text(at(name)).collect())
    (tmp_path / "vec").write_text("a 1 0\nb 0.9 0.1\nc 0 1\nd 0.1 0.9\n")
    (tmp_path / "lists").write_text("p\ta\np\tb\nq\tc\nq\td\nq\ta\n")
    (tmp_path / "words").write_text("a\nnew 0 1\n")
    (tmp_path / "one").write_text("a\n")
    (tmp_path / "gold").write_text("a\t1\nc\t-1\n")
    (tmp_path / "dict").write_text("headword\tdefinition\nblaze\tbig hot fire\nember\thot bit\n")
    (tmp_path / "hot").write_text("ember\n")
    (tmp_path / "stop").write_text("bit\n")
    (tmp_path / "stats").write_text(json.dumps({"f": {"TF": {"fire": 4, "calm": 3}, "DF": {"fire": 3, "calm": 2}}}))
    (tmp_path / "sub").write_text(json.dumps({"f": {"TF": {"fire": 3}, "DF": {"fire": 2}}}))
    (tmp_path / "terms").write_text("fire\t3.0\t2\t3\nx1\t2.0\t1\t1\n")
    (tmp_path / "query").write_text("fire\nquake\n")
    (tmp_path / "docs.json").write_text('{"url": "u", "n": 1}\n')
    for arguments in (
        ["knn", at("vec"), at("words"), at("knn"), "-k", "2", "-n"], ["emscan", at("vec"), at("one"), at("emscan"), "first", "-g", at("graph")],
        ["embedding-bounds", at("vec"), at("lists"), at("bounds"), "--confusion", at("confusion"), "--write-real", at("real"), "--sets", at("sets")],
        ["topic-stats", at("vec"), at("lists"), at("topics"), "--words", at("topic_words")], ["densifier", at("vec"), at("gold"), at("dense")], ["mds", at("vec"), at("mds")],
        ["definition-similarity", at("dict"), at("hot"), at("similar"), "-v", "--stop-words", at("stop")], ["def-to-hw", at("dict"), at("hot"), at("headwords")],
        ["weight-words", at("stats"), at("idf"), "-n", "4"], ["weight-words", at("sub"), at("ratio"), "-b", at("stats"), "-p"], ["weight-query", at("query"), at("terms"), at("weighted")],
        ["select-terms", at("terms"), at("query"), at("selected"), "--min-ur", "1"], ["select-terms", at("terms"), at("query"), at("every"), "--min-ur", "1", "--unchecked"],
        ["filter-tfdf", at("stats"), at("filtered"), "-f", "f", "-u", "3"], ["join-tfdf", at("joined"), at("stats"), at("sub")], ["json-to-tsv", at("docs.json"), at("tsv"), "-f", "url", "-f", "absent"],
        ["run", "wc", "-i", at("docs.json"), "-o", at("run")],
    ):
        cli.main(arguments)
    assert [x.split("\t")[:2] for x in lines("knn")] == [["a", "a"], ["a", "b"], ["new", "c"], ["new", "d"]]
    assert lines("emscan") == ["a", "b"] and "<graphml" in (tmp_path / "graph").read_text()
    assert len(lines("bounds")) == 2 and "p\tp\t2" in lines("confusion") and "q\td" in lines("real") and "p-q\ta" in lines("sets") and "p-unique\tb" in lines("sets")
    assert lines("topics") and any("[" in x for x in lines("topic_words")) and len(lines("dense")) == len(lines("mds")) == 4
    assert any(x.startswith("ember\tblaze\t") and x.endswith("hot") for x in lines("similar")) and lines("headwords") == []
    assert len(lines("idf")) == 2 and lines("ratio")[0].startswith("fire\t") and lines("weighted") == ["fire\t3.0"]
    assert [x.split("\t")[0] for x in lines("selected")] == ["fire"] and [x.split("\t")[0] for x in lines("every")] == ["fire", "x1"]
    assert rows(spark.read.parquet(at("filtered")).select("term")) == [("fire",)] and rows(spark.read.parquet(at("joined")).where("term = 'fire'").select("tf")) == [(7.0,)]
    assert lines("tsv") == ["u\t"]


def test_centroids_beyond_the_broadcast_bound(spark, circle, monkeypatch):
    lists = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "c"), ("q", "d"), ("r", "a")], "list string, word string")
    members = circle.join(lists, "word")
    want = rows(vectors.nearest_centroid(members))
    monkeypatch.setattr(vectors, "CENTROIDS", 2)
    assert rows(vectors.nearest_centroid(members)) == want and len(want) == 5


def test_broadcasts_are_bounded(spark):
    df = spark.createDataFrame([("é" * 100, [1, 2])] * 5, "t string, v array<int>")
    assert df.select(basic.row_bytes(df)).first()[0] == 200 + 8 + 40
    hinted = lambda **how: "ResolvedHint" in basic.broadcast_if_small(df, **how)._jdf.queryExecution().analyzed().toString()
    assert hinted() and not hinted(rows=4) and not hinted(size=1000)


@pytest.mark.parametrize("part", [7, 16, 23, 64, 1 << 20])
def test_large_conll_files_are_read_in_parts(spark, tmp_path, part):
    words = [[[f"{i}", "é" * (i % 5)] for i in range(n % 4 + 1)] for n in range(30)]
    (tmp_path / "c.conll").write_text("".join("".join("\t".join(t) + "\n" for t in s) + "\n" for s in words))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", part)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        made = readers.conll_sentences_of(spark, str(tmp_path))
        assert sorted(r["sentence"] for r in made.collect()) == sorted(words)
        assert part > 64 or made.rdd.getNumPartitions() > 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_annotations_are_held_a_piece_at_a_time(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["aaaa", None, "b" * 30, "", "cc", "dd"], "n": list(range(6))})
    cut = list(annotate.pieces(batch, ["t"], 5))
    assert [r for p in cut for r in p.column("n").to_pylist()] == list(range(6)) and [p.num_rows for p in cut] == [3, 2, 1]
    df = spark.createDataFrame([(i, "A b. " * 20000 if i % 7 else None) for i in range(30)], "i int, t string").coalesce(1)
    got = {r["i"]: r["n"] for r in annotate.annotate(df, ["t"]).select("i", F.size("t_corenlp").alias("n")).collect()}
    assert got == {i: 20000 if i % 7 else -1 for i in range(30)} or got == {i: 20000 if i % 7 else None for i in range(30)}


def test_pairs_of_definitions_are_not_shuffled(spark):
    own = spark.createDataFrame([(f"h{i}", f"w{i % 3} all s{i % 7}") for i in range(60)], "headword string, definition string")
    words = own.where("headword in ('h0', 'h21', 'h5')").select("headword")
    made = lexicon.similar(lexicon.bags(own, lexicon.vocabulary(own)), words, True, whole=True)
    bag = {f"h{i}": {f"w{i % 3}", "all", f"s{i % 7}"} for i in range(60)}
    assert {(r["word"], r["headword"]): r["common"] for r in made.collect()} == {(a, b): sorted(bag[a] & bag[b]) for a in ("h0", "h21", "h5") for b in bag}
    assert all(math.isclose(r["similarity"], len(r["common"]) / 3) for r in made.collect())
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastNestedLoopJoin" in plan and "Exchange" not in plan[: plan.index("BroadcastNestedLoopJoin")]


def test_steps_without_edges(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 4))
    x[[20, 40, 60, 80]] = x[3]  # equal vectors: ties go to the smaller number
    x[7] = 0
    own = vectors.normalized(spark.createDataFrame([(i * 3 % 101, r.tolist()) for i, r in enumerate(x)], "idx long, vec array<double>"))
    cluster = own.where("idx % 4 = 0").select("idx")
    edges = vectors.similarity_edges(own, 0.5).cache()
    for cells in (1, 3):
        monkeypatch.setattr(vectors, "CELL_NUMBERS", 90 * 4 // cells)
        monkeypatch.setattr(vectors, "ROWS_AT_ONCE", 900)
        for how in ({"method": "first"}, {"method": "dcg"}, {"method": "dcg", "min_dcg": 0.0}, {"method": "ratio"}, {"method": "ratio", "cluster_ratio": 0.2}):
            assert rows(vectors.emscan_step_of(own, cluster, 0.5, **how)) == rows(vectors.emscan_step(edges, cluster, **how)), (cells, how)
        near = vectors.nearest_edges(own, 0.5)
        assert rows(near.select("src", "dst")) == rows(vectors.nearest_other(edges).select("src", "dst"))
    for a, b in list(zip(vectors.emscan(near, cluster), vectors.emscan(edges, cluster), strict=True))[1:]:
        assert [tuple(round(v, 9) for v in r) for r in rows(a)] == [tuple(round(v, 9) for v in r) for r in rows(b)]
    assert near.count() < edges.count()


def test_term_sums_of_parts(spark, monkeypatch):
    from collections import Counter

    texts = ["a b a b", "b", "", None, "a b", "c a b a"]
    df = spark.createDataFrame([(t.split() if t is not None else None,) for t in texts], "t array<string>").coalesce(1)
    lists = [t.split() for t in texts if t]
    for field, own in (("u", lists), ("b", [[f"{x} {y}" for x, y in zip(t[:-1], t[1:], strict=True)] for t in lists])):
        tf, dfs = Counter(x for t in own for x in t), Counter(x for t in own for x in set(t))
        for at_once in (1, 3, 1 << 20):
            monkeypatch.setattr(stats, "TOKENS_AT_ONCE", at_once)
            made = stats.tf_df_of_tokens(df, F.col("t"), "u", 2.0, "b").where(F.col("field") == field)
            assert rows(made.select("term", "tf", "df")) == sorted((x, 2.0 * n, dfs[x]) for x, n in tf.items())
    assert stats.term_parts(df, F.col("t"), "u", "b").groupBy("field", "term").count().where("count > 1").isEmpty()  # summed before a shuffle


@pytest.mark.parametrize("part", [61, 1 << 20])
def test_large_statistics_are_many_objects(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(writers, "PART_TERMS", 10)
    own = spark.createDataFrame([(f, f"t{{{i}", i / 2, i) for i in range(150) for f in "fg"], "field string, term string, tf double, df bigint")
    made = writers.term_stats_json(own, 7)
    assert 28 < made.count() <= 35
    made.coalesce(1).write.text(str(tmp_path / "stats"))
    (tmp_path / "list.json").write_text('[\n{"h": {"TF": {"a": 2, "b": 1}, "DF": {"a": 1, "c": 9}}},\n{"TF": {"x": 1.5}}\n]\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", part)
    try:
        assert rows(readers.term_stats_json(spark, str(tmp_path / "stats"))) == rows(own)
        assert rows(readers.term_stats_json(spark, str(tmp_path / "list.json"))) == [("all", "x", 1.5, 0), ("h", "a", 2.0, 1), ("h", "b", 1.0, 0)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_search_of_tokens_equals_search_of_postings(spark):
    texts = {1: "fire flood fire", 2: "", 3: None, 4: "calm sea", 5: "flood sea sea calm fire", 6: "fire"}
    df = spark.createDataFrame([(k, t.split() if t is not None else None) for k, t in [*texts.items(), (6, "sea fire fire")]], "id int, t array<string>")
    query = spark.createDataFrame([("fire", 1.0), ("sea", 0.5), ("fire flood", 2.0)], "term string, weight double")
    parts = {"a": F.col("t"), "b": X.bigrams(F.col("t"))}
    posts = {f: stats.term_counts(df, "id", c).select("id", F.lit(f).alias("field"), "term", "tf") for f, c in parts.items()}
    near = lambda found: [(k, round(x, 9)) for k, x in rows(found)]
    for how in ({}, {"scorer": "tf"}, {"avgdl": 3.0, "field_weights": {"a": 1.0, "b": 2.0}}, {"min_score": 1.0}):
        both = search.search_tokens(df, query, "id", parts, {"b": F.size("t") - 1}, **how)
        assert near(both) == near(search.search_postings(posts["a"].union(posts["b"]), query, "id", **how)) and both.count() > 1
        assert near(search.search_tokens(df, query, "id", {"a": F.col("t")}, **how)) == near(search.search_postings(posts["a"], query, "id", **how))
    plan = search.search_tokens(df, query, "id", {"a": F.col("t")})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [id#") < plan.index("LeftSemi")  # the query's terms are chosen before they are grouped
    asked = query.select("term").where("term = 'sea'")
    for rounds in (1, 2):
        assert near(feedback.feedback_tokens(df, asked, "id", F.col("t"), hits=1, rounds=rounds)) == near(feedback.feedback(stats.term_counts(df, "id", F.col("t")), asked, "id", hits=1, rounds=rounds))


def test_shingles_of_words(spark):
    from hashlib import md5

    rng = np.random.default_rng(8)
    h = np.concatenate([rng.integers(0, dedup.PRIME, 700), [0, 1, dedup.PRIME - 1]])
    scale, shift = (np.array(x, np.int64) for x in zip(*dedup.permutations(128), strict=True))
    want = [min((int(a) * int(x) + int(b)) % dedup.PRIME for x in h) for a, b in zip(scale, shift, strict=True)]
    assert dedup.least_of_permutations(h, scale, shift).tolist() == want
    texts = ["a b c d é f", "x", None, "a b c d é a b c d é a b", ""]
    df = spark.createDataFrame([(i, t.split() if t is not None else None) for i, t in enumerate(texts)], "id int, t array<string>")
    made = dedup.signatures(df, "id", F.col("t"), 16, words=5)
    assert rows(made) == rows(dedup.signatures(df, "id", X.shingles(F.col("t"), 5), 16)) and made.count() == 2
    assert [r["minhash"] is None for r in dedup.signatures(df, "id", F.col("t"), 16, True, words=5).orderBy("id").collect()] == [False, True, True, False, True]
    own = {0: ["a b c d é", "b c d é f"], 3: ["a b c d é", "b c d é a", "c d é a b", "d é a b c", "é a b c d"]}
    summary = dedup.shingle_summary(df, "id", X.shingles(F.col("t"), 5))
    assert "Generate" not in summary._jdf.queryExecution().optimizedPlan().toString()
    assert rows(summary) == [(k, len(v), min(md5(x.encode()).hexdigest() for x in v)) for k, v in own.items()]
    assert one(spark, dedup.hash32(F.col("s")), s=("a b c d é", "string")) == int(md5("a b c d é".encode()).hexdigest()[:8], 16)
