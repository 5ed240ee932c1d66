import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from graphmill.errors import ParseError
from graphmill.functions.segmentation import PAIRS, Dictionary
from graphmill.functions.stemming import fold, porter
from graphmill.operators.fulltext import FullTextIndex, parse_search, sanitise

WORDS = """running runs runner authenticate authentication authenticating relational conditional rationally valenci digitizer
conformably radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness
formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner
gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective
bowdlerize probate rate cease controll roll caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized
hopping tanned falling hissing fizzed failing filing happy sky apology by says yes ox naïve Ünïcode résumé works_on x a1b2 2024 generalizations""".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(11)
    docs = [(rnd.choice(["knowledge", "statement"]), f"{rnd.choice(WORDS)} {i}", *[" ".join(rnd.choice(WORDS) for _ in range(rnd.choice([0, 2, 12]))) for _ in range(3)]) for i in range(150)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(key, data, tags, synonyms, tokenize='porter unicode61')")
    db.executemany("INSERT INTO f(rowid, key, data, tags, synonyms) VALUES (?, ?, ?, ?, ?)", [(i, *d[1:]) for i, d in enumerate(docs)])
    df = spark.createDataFrame([(*d, "content") for d in docs], "catalog string, key string, d string, t string, s string, content string")
    index = FullTextIndex.build(df, texts={"key": F.col("key"), "data": F.col("d"), "tags": F.col("t"), "synonyms": F.col("s")})
    keep = FullTextIndex(index.postings.persist(), index.docs.persist(), index.stats.persist(), True, index.weights)
    return docs, db, keep


@pytest.mark.parametrize("query", ["running", "authentication sing", "works_on", "cat OR pony", "runner NOT rate", "a1b2 OR rate cease NOT sky AND yes", "naive", "run run", "unicode resume OR happy", "absent", "_ cats"])
def test_same_as_sqlite(corpus, query):
    docs, db, index = corpus
    true = {docs[i][:2]: rank for i, rank in db.execute("SELECT rowid, bm25(f, 10, 1, 5, 3) FROM f WHERE f MATCH ?", (sanitise(query),))}
    got = {(r["catalog"], r["key"]): r["rank"] for r in index.search(query, limit=None).collect()}
    assert got.keys() == true.keys() and all(abs(got[k] - true[k]) < 1e-9 for k in true)


def test_pages_and_catalog(corpus):
    docs, _, index = corpus
    every = index.search("running OR cats", limit=None).orderBy("rank", "catalog", "key").collect()
    assert index.search("running OR cats", limit=5, offset=3).collect() == every[3:8]
    some = index.search("running OR cats", "statement", None).collect()
    assert {r["key"]: r["rank"] for r in some} == {r["key"]: r["rank"] for r in every if r["catalog"] == "statement"}


def test_stems_are_those_of_sqlite():
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(w, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, instance)")
    plain = [w for w in WORDS if "_" not in w]
    db.executemany("INSERT INTO f(rowid, w) VALUES (?, ?)", enumerate(plain))
    true = {plain[doc]: term for term, doc in db.execute("SELECT term, doc FROM v")}
    assert {w: porter(fold(w)) for w in plain} == true


@pytest.mark.parametrize("bad", ["", "  ", "''", "a = b", "$x", "rust AND", "OR x", "a NOT", "NOT a", "a\\b"])
def test_syntax_errors(bad):
    with pytest.raises(ParseError):
        parse_search(bad, lambda w: [w])


def test_ideographs(spark):
    words = Dictionary(["南京市", "南京", "长江", "大桥", "ab"])
    for text in ("南京市长江大桥 and 大", "no", "a中b", "中文，字", ""):
        for cut in (PAIRS, words):
            got = spark.createDataFrame([(text,)], "t string").select(cut.column(F.col("t"))).first()[0]
            assert got.split() == cut.text(text).split()
    assert words.text("南京市长江大桥中x").split() == ["南京市", "长江", "大桥", "中", "x"]
    index = FullTextIndex.build(spark.createDataFrame([("knowledge", "k", '{"data":"南京市长江大桥","tags":[]}')], "catalog string, key string, content string"))
    assert index.search("南京").count() == 1 and index.search("长江大桥").count() == 1 and index.search("北京").count() == 0


def test_a_segmenter_of_ones_own(spark, tmp_path):
    words = Dictionary(["南京市", "长江", "大桥"])
    docs = spark.createDataFrame([("knowledge", "k", '{"data":"南京市长江大桥","tags":[]}')], "catalog string, key string, content string")
    for index in (FullTextIndex.build(docs, segmenter=words), FullTextIndex.build(docs, segmenter=words).save(str(tmp_path / "i"))):
        assert index.search("长江大桥").count() == 1 and index.search("江大").count() == 0


def test_frequent_words_are_spread(spark, tmp_path, monkeypatch):
    from graphmill.operators import fulltext

    monkeypatch.setattr(fulltext, "HOT_POSTINGS", 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would unite parts as small as these
    docs = spark.range(60).selectExpr("'knowledge' AS catalog", "concat('k', id) AS key", """concat('{"tags":[],"data":"common ', if(id < 3, 'rare', 'x'), '"}') AS content""")
    try:
        index = FullTextIndex.build(docs).save(str(tmp_path / "i"), buckets=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index.search("common", limit=None).count() == 60 and index.search("common rare").count() == 3
    assert index.postings.where("term = 'common'").select(F.input_file_name()).distinct().count() > 1


def test_save_and_load(spark, corpus, tmp_path):
    index = corpus[2].save(str(tmp_path / "i"), buckets=4)
    assert index.search("running", limit=None).count() == corpus[2].search("running", limit=None).count()
    plan = index.search("running")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term)" in plan or "In(term" in plan or "EqualTo(term" in plan


def test_empty(spark):
    empty = spark.createDataFrame([], "catalog string, key string, content string")
    assert FullTextIndex.build(empty).search("x").count() == 0
