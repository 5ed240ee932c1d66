import json

import pytest
from pyspark.sql import functions as F

from graphmill import cli
from graphmill.errors import AlreadyExists, ModelUnavailable, NotFound, ShelfError, ValidationError
from graphmill.functions.content import Content
from graphmill.sources.embedding import HashEmbedder, NoEmbedder, Settings, list_models, pool, register_model, resolve_model
from graphmill.operators.fulltext import FullTextIndex, knowledge_docs
from graphmill.sources.store import Shelf
from graphmill.workspace import Workspace


def test_life_of_a_row(spark, tmp_path):
    shelf = Shelf(spark, tmp_path / "s", embedder=HashEmbedder(8))
    made = shelf.create_knowledge("rhone", Content("A long river of the Alps", tags=["x"]))
    assert made.name == "rhone" and len(made.embedding) == 8
    with pytest.raises(AlreadyExists):
        shelf.create_knowledge("rhone", Content("again"))
    shelf.create_statement("rhone", "is,a", "river", Content("fact"))
    assert shelf.get("statement", 'rhone,"is,a",river').predicate == "is,a"
    assert [r.key for r in shelf.search("rivers").collect()] == ['rhone,"is,a",river', "rhone"]  # a word of a key weighs ten times one of the data
    shelf.embedder = None
    changed = shelf.update("knowledge", "rhone", Content("It is quick and deep"))
    assert changed.created_at == made.created_at and changed.embedding == made.embedding  # the old vector stays
    assert shelf.search("deep").count() == 1 and shelf.search("river", "knowledge").count() == 0
    with pytest.raises(NotFound):
        shelf.update("knowledge", "nothing", Content())
    shelf.set_embedding("knowledge", "rhone", None)
    shelf.set_embedding("knowledge", "nothing", [1.0])
    assert shelf.with_embeddings("knowledge").count() == 0 and shelf.without_embeddings("knowledge").count() == 1
    with pytest.raises(ModelUnavailable):
        shelf.backfill()
    shelf.embedder = HashEmbedder(8)
    assert shelf.backfill() == {"created": 1, "skipped": 0, "errors": 0} and shelf.backfill() == {"created": 0, "skipped": 1, "errors": 0}
    assert shelf.similar("deep and quick", limit=1).first().name == "rhone"
    before = shelf.knowledge.collect()
    shelf.compact()
    assert shelf.knowledge.collect() == before and shelf.statement.count() == 1
    shelf.rebuild_index()
    assert shelf.search("deep").count() == 1
    shelf.export(tmp_path / "copy")
    assert Shelf(spark, tmp_path / "copy").knowledge.collect() == before
    shelf.delete("knowledge", "rhone")
    assert shelf.get("knowledge", "rhone") is None and shelf.search("deep").count() == 0 and shelf.statement.count() == 1
    with pytest.raises(NotFound):
        shelf.delete("knowledge", "rhone")
    shelf.create_knowledge("rhone", Content("new life"))
    assert json.loads(shelf.get("knowledge", "rhone").content)["data"] == "new life"


def test_base_and_log(spark, tmp_path):
    """Filters reach the base, unfinished folders do not count, and what a new base replaces is kept once."""
    shelf = Shelf(spark, tmp_path / "s")
    rows = spark.range(50).select(F.concat(F.lit("n"), "id").alias("name"), F.lit('{"tags":[]}').alias("content"), F.expr("timestamp_ntz'2024-01-01'").alias("created_at"))
    shelf.load("knowledge", rows.unionByName(rows.limit(5)))
    with pytest.raises(AlreadyExists):
        shelf.load("knowledge", rows)
    shelf.put_many("knowledge", rows.where("name < 'n2'").withColumn("content", F.lit("new")))
    shelf.delete_many("knowledge", rows.where("name LIKE 'n4%'").select("name"))
    want = {f"n{i}": "new" if f"n{i}" < "n2" else '{"tags":[]}' for i in range(50) if not f"n{i}".startswith("n4")}
    read = lambda: {r.name: r.content for r in Shelf(spark, tmp_path / "s").knowledge.collect()}
    assert read() == want
    plan = shelf.knowledge.where("name = 'n7'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,n7)" in plan
    (tmp_path / "s" / "knowledge" / "log" / "99999999999999999999").mkdir()
    (tmp_path / "s" / "knowledge" / "base-99999999999999999999").mkdir()
    assert read() == want
    shelf.compact()
    assert read() == want and len(shelf._bases("knowledge")) == 2
    shelf.delete_many("knowledge", rows.where("name = 'n7'").select("name"))
    shelf.compact()
    del want["n7"]
    assert read() == want and len(shelf._bases("knowledge")) == 2 and len(shelf._batches("knowledge")) == 1


def test_index_is_kept(spark, tmp_path, monkeypatch):
    """Opened again, a shelf searches with the index it has and what has changed since; it is not built anew."""
    shelf = Shelf(spark, tmp_path / "s")
    rows = spark.createDataFrame([(f"k{i}", json.dumps({"data": t, "tags": []})) for i, t in enumerate(["old stones", "old trees", "young trees"])], "name string, content string")
    shelf.create_many("knowledge", rows)
    assert {r.key for r in shelf.search("old").collect()} == {"k0", "k1"}
    shelf.put_many("knowledge", rows.where("name = 'k1'").withColumn("content", F.lit('{"data":"older houses","tags":[]}')))
    shelf.delete("knowledge", "k0")
    shelf.create_knowledge("k9", Content("an old wall with trees"))
    monkeypatch.setattr(Shelf, "rebuild_index", lambda self: pytest.fail("built again"))
    again = Shelf(spark, tmp_path / "s")
    found = {r.key: r.rank for r in again.search("trees").collect()}
    assert {r.key for r in again.search("old").collect()} == {"k9"} and found.keys() == {"k2", "k9"}
    fresh = FullTextIndex.build(knowledge_docs(again.knowledge))
    assert {r.key: pytest.approx(r.rank) for r in fresh.search("trees").collect()} == found


def test_texts_are_embedded_in_batches(spark, tmp_path):
    from graphmill.sources.store import embed_column

    class Batches(HashEmbedder):
        """Refuses one text; counts its calls in a file, as it works in other processes."""

        def __init__(self, calls):
            super().__init__(4)
            self.calls = calls

        def embed_batch(self, texts):
            with open(self.calls, "a") as out:
                out.write("x")
            if any("bad" in t for t in texts):
                raise ModelUnavailable("refused")
            return [self.embed(t) for t in texts]

        def embed(self, text):
            if "bad" in text:
                raise ModelUnavailable("refused")
            return super().embed(text)

    df = spark.range(100).select(F.concat(F.lit("t"), "id").alias("t")).coalesce(1)
    assert embed_column(df, "t", Batches(tmp_path / "calls")).where("embedding IS NOT NULL").count() == 100
    assert (tmp_path / "calls").read_text() == "xx"
    mixed = df.limit(3).unionByName(spark.createDataFrame([("bad",), (None,)], "t string"))
    assert embed_column(mixed, "t", Batches(tmp_path / "calls")).where("embedding IS NULL").count() == 2


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from graphmill import session
    from graphmill.errors import ConfigurationError

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: type("C", (), {"get": lambda self, k: None})()
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    class Session:
        conf = type("C", (), {"get": lambda self, k, d=None: d})()
        sparkContext = Context()

    with pytest.raises(ConfigurationError):
        session.shared_dir(Session())


def test_many_rows(spark, tmp_path):
    shelf = Shelf(spark, tmp_path / "s")
    rows = spark.range(20).select(F.concat(F.lit("n"), "id").alias("name"), F.lit('{"tags":[]}').alias("content"))
    shelf.create_many("knowledge", rows)
    with pytest.raises(AlreadyExists):
        shelf.create_many("knowledge", rows.limit(1))
    with pytest.raises(AlreadyExists):
        shelf.create_many("knowledge", spark.createDataFrame([("d", "{}"), ("d", "{}")], "name string, content string"))
    shelf.create_many("knowledge", rows.unionByName(spark.createDataFrame([("z", "{}")], "name string, content string")), skip_existing=True)
    assert shelf.knowledge.count() == 21
    shelf.delete_many("knowledge", rows.select("name").limit(5))
    assert shelf.knowledge.count() == 16
    shelf.embedder = HashEmbedder(4)
    assert shelf.backfill() == {"created": 15, "skipped": 0, "errors": 1}  # content without tags is malformed


def test_archives(spark, tmp_path):
    space = Workspace(spark, tmp_path / "home", lambda _: None)
    (tmp_path / "pic.PNG").write_bytes(b"1234")
    assert space.store_file("default", tmp_path / "pic.PNG", "a/pic.PNG") == "a/pic.PNG"
    shelf = space.shelf()
    content = json.loads(shelf.get("knowledge", "a/pic.PNG").content)
    assert content["tags"] == ["archive", "image", "png"] and json.loads(content["data"])["size_bytes"] == 4 and content["figures"] == ["archive://a/pic.PNG"]
    assert shelf.get("statement", "a/pic.PNG,is_a,archive") is not None
    assert shelf.list_archives() == ["a/pic.PNG"] and shelf.archive_path("none") is None and shelf.archive_files().first().length == 4
    with pytest.raises(ValidationError):
        shelf.store_archive(tmp_path / "pic.PNG", "../out")


def test_workspace_and_commands(spark, tmp_path, capsys):
    space = Workspace(spark, tmp_path / "home", lambda _: None)
    assert space.list() == [("default", str(tmp_path / "home" / "default"), True)]
    do = lambda *words: cli.run(space, cli.parser().parse_args(words))
    do("connect", str(tmp_path / "other"), "--name", "o")
    with pytest.raises(ShelfError):
        space.connect(tmp_path / "other", "o")
    do("knowledge-create", "k1", "--data", "some data", "--tags", "a, b", "--scopes", "proj,", "--synonyms", "s1,,s2")
    assert json.loads(do("knowledge-get", "k1"))["content"] == {"format": "markdown", "data": "some data", "tags": ["a", "b"], "synonyms": ["s1", "s2"], "figures": None, "scopes": ["proj", ""]}
    assert "not found" in do("knowledge-get", "k2")
    do("statement-create", "k1", "is", "thing", "--synonyms", '{"subject": ["x"]}', "--shelf", "o")
    assert json.loads(do("query", '["$statement"]', "--shelf", "o"))[0].keys() == {"triple", "subject", "predicate", "object", "content", "created_at"}
    assert json.loads(do("search", "data"))[0]["key"] == "k1" and do("query", '["$knowledge", ["$eq", "name", "x"]]') == "No results found."
    assert json.loads(cli.respond(space, '["$knowledge"]'))[0]["name"] == "k1"
    assert cli.respond(space, ".quit") is None and "connected" in cli.respond(space, ".list") and cli.respond(space, "") == "" and "unknown" in cli.respond(space, "x")
    do("statement-delete", "k1", "is", "thing", "--shelf", "o")
    do("export", "default", str(tmp_path / "out"))
    assert len(space.query_all('["$knowledge"]').collect()) == 1
    again = Workspace(spark, tmp_path / "home", lambda _: None)
    assert [n for n, _, c in again.list() if c] == ["default", "o"]
    do("disconnect", "o")
    with pytest.raises(ShelfError):
        space.shelf("o")
    assert cli.scopes("") == [] and cli.scopes(",") == [""] and cli.scopes("p,") == ["p", ""] and cli.listed("a,,b", True) == ["a", "", "b"]


def test_embedding_settings(tmp_path):
    assert Settings.read(tmp_path).dimensions == 1024 and isinstance(NoEmbedder(), NoEmbedder)
    (tmp_path / "shelf.toml").write_text('[embedding]\nprovider = "remote"\ndimensions = 8\npooling = "cls"\nmodel = "org/m"')
    models = tmp_path / "models"
    files = tmp_path / "files"
    files.mkdir()
    for name in ("model.onnx", "tokenizer.json"):
        (files / name).write_text("")
    register_model("org/m", files, models)
    settings = Settings.read(tmp_path, models)
    assert (settings.provider, settings.dimensions, settings.pooling) == ("remote", 8, "cls") and settings.model_path == models / "org/m" / "model.onnx"
    assert list_models(files.parent) == ["files"] and list_models(tmp_path / "none") == []
    assert resolve_model("no/such", models) is None
    (tmp_path / "shelf.toml").write_text("not toml [")
    assert Settings.read(tmp_path).provider == "local"
    with pytest.raises(ModelUnavailable):
        NoEmbedder().embed("x")


def test_pooling():
    import numpy as np

    hidden, mask = np.array([[1.0, 0], [3, 2], [9, 9]]), np.array([1, 1, 0])
    assert pool(hidden, mask, "mean").tolist() == [2, 1] and pool(hidden, mask, "cls").tolist() == [1, 0] and pool(hidden, mask, "last_token").tolist() == [3, 2]
