"""Every operator against a plain version, on the small tables and on awkward rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import brute
import corpus_pipeline
from tailfield.llm import contamination, licences, near_duplicates, pages, pieces, quality, repeats, scoring, secrets, urls
from tailfield.llm.queries import QUERIES, piece_model

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    *[T.StructField(x, T.StringType()) for x in ("kept", "n_words", "spans", "hits", "f", "node", "label", "_key", "host")],
])


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    """The documents of the smallest tables with awkward ones added: {id: text}."""
    random.seed(11)
    out = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    base = list(out.values())
    out |= {
        9000: None, 9001: "", 9002: " \n\t ", 9003: "one", 9004: "one Two", 9005: "ONE two", 9006: "x" * 30_000, 9007: "a b c " * 9000,
        9008: items[0].upper() + "; Ärger ÉTÉ", 9009: "é漢𝔘 " * 400, 9010: base[3], 9011: base[3] + " and a few more words", 9012: base[5] * 3,
        9013: 'token = "abcdef0123" AKIA' + "Q" * 16 + " " + "0f" * 20 + "\nmy auth header Zk93hfKQ82hLpq0wMX7tbbV4 here", 9014: "\x00<s></s>▁▁ ﬁ\u00a0",
        9015: "AKIA", 9016: "\n".join(["the same line"] * 30), 9017: "Released under the MIT License.",
    }
    for k in range(40):
        parts = random.choices(base, k=random.randint(1, 4))
        out[9100 + k] = "".join(t[(o := random.randrange(max(len(t) - 50, 1))): o + random.choice([60, 99, 100, 101, 400])] for t in parts)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, "en", "s", len(t or ""), *["clash"] * 9) for i, t in rows.items()]
    return spark.createDataFrame([*data, data[0], data[0]], DOCS).repartition(5)


@pytest.fixture(scope="module")
def items(spark):
    own = spark.read.parquet(f"{SF}/benchmark.parquet")
    return own.union(spark.createDataFrame([(700, None), (701, ""), (702, "Ärger été"), (703, "zzz yyy")], own.schema))


def by_id(df):
    """{doc_id: row}; repeated rows must agree."""
    out = {}
    for r in df.collect():
        assert out.setdefault(r.doc_id, r) == r
    return out


def test_quality(docs, rows):
    got = by_id(quality.quality_rules(docs))
    assert set(got) == set(rows)
    for i, t in rows.items():
        want = brute.quality(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op9_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("n_words >= 50")
    poor, clean = got.where("quality = 0"), got.where("quality = 1")
    assert poor.where("kept").count() <= 0.05 * poor.count()
    assert clean.where("not kept").count() <= 0.02 * clean.count()


def test_near_duplicates(docs, rows):
    got = by_id(near_duplicates.near_duplicates(docs))
    want = brute.near_components(list(rows.items()))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    kept = near_duplicates.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_strangers_of_a_family_are_linked(spark):
    """A chain: each text is near the next, and only the ends are near the hub's copies."""
    random.seed(4)
    text = [f"w{k}" for k in range(400)]
    chain = []
    for k in range(60):
        for at in random.sample(range(400), 6):
            text[at] = f"v{k}_{at}"
        chain.append((k, " ".join(text)))
    df = spark.createDataFrame(chain, "doc_id long, text string")
    want = brute.near_components(chain)
    assert {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(df).collect()} == {i: c for i, (_, c) in want.items()}


def test_contamination(docs, rows, items):
    got = by_id(contamination.decontamination(docs, items))
    want = brute.contaminated(list(rows.items()), [tuple(r) for r in items.collect()])
    for i, (n, hit, ids) in want.items():
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(ids), sha(",".join(ids)), hit > 0), i
    kept = contamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, w in want.items() if not w[1]}


def test_proximity_finds_shifted_terms(spark):
    words = " ".join(f"term{k}" for k in range(10))
    items = spark.createDataFrame([(1, words)], "item_id long, text string")
    far = " ".join(f"x term{k}" for k in range(10))
    docs = spark.createDataFrame([(1, words), (2, far), (3, "term0 only")], "doc_id long, text string")
    index, needed = contamination.build_index(docs, contamination.item_words(items))
    near = lambda slack: {r["_key"] for r in contamination.proximity_matches(index, needed, slack).collect()}
    assert near(0) == {1}
    assert near(10) == {1, 2}


def test_native_plan(spark):
    plan = QUERIES["op3_benchmark_decontamination"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_suffix_dedup(docs, rows):
    got = by_id(repeats.suffix_dedup(docs))
    for i, (n, gone, spans, kept) in brute.kept_bytes(list(rows.items())).items():
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, sha(kept)), i


def test_scores(docs, rows):
    plain = docs.dropDuplicates(["doc_id"])
    got = by_id(scoring.lm_scores(plain))
    for i, (held, n, known, train, base, score) in brute.lm(list(rows.items()), scoring.MU).items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train), i
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=2e-4)


def test_scores_of_held_out_texts_beat_single_tokens(spark):
    got = QUERIES["op5_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_pieces(docs, rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    got = by_id(pieces.sentencepiece_round_trip(docs, piece_model()))
    for i, t in rows.items():
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        raw = b"".join(k.to_bytes(4, "little") for k in ids)
        assert tuple(got[i])[1:] == (len(ids), sha(raw), sha(library.decode(ids))), i


def test_long_segments_use_the_heap():
    model = pieces.vocabulary(piece_model())
    for text in ("▁" + "internationalisation" * 20, "▁" * 60, "▁" + "漢字é" * 40):
        assert model.heap(text) == model.library.encode(text[1:])


def test_secrets(docs, rows):
    got = by_id(secrets.secret_scans(docs))
    for i, t in rows.items():
        want = brute.secrets(t)
        said = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, e, k in want)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for *_, k in want) for x in range(3)), i
        assert r.base_sha256 == sha(said)
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
    assert "novel:" in got[9013].spans
    clean = secrets.redact_documents(docs)
    assert clean.columns == docs.columns
    left = by_id(clean)
    assert left[9000].text is None
    assert left[9013].text == 'token = "[secret]'[:0] + "[secret]" + '" [secret] [secret]\nmy auth header [secret] here'
    assert left[9013].n_chars == len(left[9013].text)


def test_licences(docs):
    got = by_id(licences.license_scans(docs))
    assert got[9017].families == "MIT"
    assert got[9000].n_paragraphs == got[9001].n_paragraphs == 0
    assert got[9004].n_licences == 0


def test_licences_held_out(spark):
    """Every line with a licence cue is found in documents that the classifier was not fitted on, and nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in docs.join(licences.license_scans(docs), "doc_id").collect():
        assert r.n_licences == sum(bool(licences.CUE.search(x)) for x in r.text.split("\n")), r.doc_id


def test_pages(spark):
    head = "<html><head><title>t</title><script>x='<p>'</script></head><body><nav><a href=/>Home</a></nav>"
    texts = {
        1: head + "<article><header><h1>A &amp; B</h1></header><p>One<p>two\n  <i>three</i>&nbsp;4<ul><li>a<li>b</ul><div class='ad box'>buy</div></article><footer>f</footer>",
        2: head + "<div class=main-text><p>Words that matter &lt;here&gt;</div><div id=cookie-notice>ok</div><form>name</form>",
        3: None, 4: "", 5: "plain text only", 6: "<p>broken <b>bold", 7: head,
    }
    rows = [(i, f"http://h.example.com/{i}", t) for i, t in texts.items()] + [(8, None, "<p>x</p>")]
    # The same banner on every page of a host is template, wherever it stands; what differs stays.
    rows += [(20 + k, "http://t.example.com/", f"<div>Our shop has the best offers today</div><div>story number {k} is unlike the others {k * 7}</div>") for k in range(6)]
    got = {r.page_id: r for r in pages.html_extraction(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {1: "A & B\n\nOne\n\ntwo three 4\n\na\n\nb", 2: "Words that matter <here>", 3: "", 4: "", 5: "plain text only", 6: "broken bold", 7: "", 8: "x"}
    want |= {20 + k: f"story number {k} is unlike the others {k * 7}" for k in range(6)}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_urls_and_cascades(spark):
    addresses = {
        1: "http://www.Example.com/en/7x?q", 2: "https://a.com/en/", 3: "https://net/de/8", 4: "x://b.example.net/de/81", 5: None, 6: "no scheme", 7: "http://spam-farm.org/",
        8: "http://org/es/#x", 9: "http://notcom/en/", 10: "http://", 11: "http://com/en", 12: "ftp://É.COM/en/é",
    }
    df = spark.createDataFrame([(i, u) for i, u in addresses.items()] * 2, "page_id long, url string")
    got = {r.page_id: tuple(r)[1:] for r in urls.url_filters(df).collect()}
    assert got == {
        1: ("www.example.com", "/en/7x", "example.com/en/7", "allow"), 2: ("a.com", "/en/", "com/en/", "block"), 3: ("net", "/de/8", "net/de/", "allow"),
        4: ("b.example.net", "/de/81", "example.net/de/8", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("spam-farm.org", "/", None, "block"),
        8: ("org", "/es/", "org/es/", "block"), 9: ("notcom", "/en/", None, "allow"), 10: ("", "", None, "allow"), 11: ("com", "/en", None, "allow"), 12: ("É.com", "/en/é", "com/en/", "block"),
    }


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("key"), "id").alias("key"))
    listed = universe.where("pmod(xxhash64(key), 7) = 0")
    cascades = urls.build_cascades(listed, universe)
    asked = universe.select("key", urls.listed(universe, F.array("key"), cascades)[0].alias("hit"))
    assert asked.where("hit <> (pmod(xxhash64(key), 7) = 0)").count() == 0
    assert len(cascades[0].levels) > 2


def test_empty_tables(spark, docs, items):
    none, no_items = docs.where("false"), items.where("false")
    for df in (
        quality.quality_rules(none), near_duplicates.near_duplicates(none), contamination.decontamination(none, items), repeats.suffix_dedup(none),
        scoring.lm_scores(none), pieces.sentencepiece_round_trip(none, piece_model()), secrets.secret_scans(none), licences.license_scans(none),
        pages.html_extraction(spark.createDataFrame([], "page_id long, url string, html string")), urls.url_filters(spark.createDataFrame([], "page_id long, url string")),
    ):
        assert df.count() == 0
    assert contamination.decontamination(docs, no_items).where("contaminated").count() == 0


def test_null_ids(spark):
    rows = [(None, "some words that stand here " * 5), (None, None), (1, "some words that stand here " * 5), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for found in (
        quality.quality_rules(df), near_duplicates.near_duplicates(df), repeats.suffix_dedup(df), scoring.lm_scores(df), secrets.secret_scans(df),
        pieces.sentencepiece_round_trip(df, piece_model()), licences.license_scans(df), contamination.decontamination(df, spark.createDataFrame([(1, "some words")], "item_id long, text string")),
    ):
        assert found.count() == 4


def test_pipeline(spark):
    """The last rows are those of plain stages over the documents."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in QUERIES["op9_quality_rules"](spark, SF).where("kept").collect()}
    left = {i: t for i, t in docs.items() if i in kept}
    left = {i: left[i] for i, (_, c) in brute.near_components(list(left.items()), 80, 5).items() if c == i}
    left = {i: left[i] for i, w in brute.contaminated(list(left.items()), items).items() if not w[1]}
    got = by_id(corpus_pipeline.run(spark, SF))
    assert set(got) == set(left)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for i, t in left.items():
        at, parts = 0, []
        for s, e, _ in brute.secrets(t):
            if s >= at:
                parts += [t[at:s], "[secret]"]
            at = max(at, e)
        assert got[i].decoded_sha256 == sha(library.decode(library.encode("".join([*parts, t[at:]])))), i
