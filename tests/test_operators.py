import io
import json
import re
import zipfile
from math import log

import pytest
from pyspark.sql import functions as F

from brindle.functions import text as tx
from brindle.operators import chat, chunks, dense, evaluation, fusion, index, layout, modeled, retrievers
from brindle.operators.providers import ExtractiveModel, HashedEmbedding, LetterEmbedding, OverlapJudge, RuleModel
from brindle.sources import collection, files, pdf
from brindle.streaming.ingest import fetch, ingest_directory, ingest_pages, status_counts

MIXED = [("n1", "Spark 的 数据 engine runs fast"), ("n2", "数据 library, a X y2k"), ("n3", None), ("n4", "")]


def test_tokens(spark):
    rows = spark.createDataFrame(MIXED, "node_id string, text string")
    got = {r.node_id: list(r.t) for r in rows.select("node_id", tx.tokens("text").alias("t")).collect()}
    assert got == {"n1": ["spark", "engine", "runs", "fast", "数", "据"], "n2": ["library", "y2k", "数", "据"], "n3": [], "n4": []}


@pytest.mark.parametrize("variant", index.VARIANTS)
def test_bm25_formulas(spark, variant):
    docs = [("d1", "apple banana apple"), ("d2", "banana cherry"), ("d3", "cherry cherry durian egg"), ("d4", "fig")]
    nodes = spark.createDataFrame(docs, "node_id string, text string")
    asked = spark.createDataFrame([(1, "apple cherry cherry"), (2, "nothing here")], "query_id long, query string")
    words = {k: t.split() for k, t in docs}
    n, avgdl = 4, sum(map(len, words.values())) / 4
    df = {t: sum(t in w for w in words.values()) for t in {t for w in words.values() for t in w}}
    raw = {t: log(n - d + 0.5) - log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    expect = {}
    for k, w in words.items():
        total = 0.0
        for t in ["apple", "cherry", "cherry"]:
            tf, norm = w.count(t), 1 - 0.75 + 0.75 * len(w) / avgdl
            if variant == "okapi":
                total += (raw[t] if raw[t] >= 0 else 0.25 * mean) * tf * 2.5 / (tf + 1.5 * norm)
            elif variant == "plus":
                total += log((n + 1) / df[t]) * (1 + tf * 2.5 / (1.5 * norm + tf))
            else:
                c = tf / norm
                total += (log(n + 1) - log(df[t] + 0.5)) * 2.5 * (c + 0.5) / (1.5 + c + 0.5)
        if round(total, 6) > 0:
            expect[k] = round(total, 6)
    got = index.bm25(index.build_index(nodes), asked, 10, variant=variant).collect()
    assert {r.node_id: r.score for r in got if r.query_id == 1} == pytest.approx(expect)
    assert not [r for r in got if r.query_id == 2]
    with pytest.raises(ValueError):
        index.bm25(index.build_index(nodes), asked, variant="x")


def test_fusion_rules(spark):
    rows = [(1, 0, 1, "a", 2.0), (1, 0, 2, "b", 1.0), (1, 1, 1, "b", 5.0), (1, 1, 2, "c", 5.0), (2, 0, 1, "x", None)]
    lists = spark.createDataFrame(rows, "query_id long, list_idx int, rank int, node_id string, score double")
    pick = lambda df: [(r.node_id, r.score) for r in df.where("query_id = 1").orderBy("rank").collect()]
    assert pick(fusion.rrf(lists)) == [("b", round(1 / 61 + 1 / 62, 9)), ("a", round(1 / 61, 9)), ("c", round(1 / 62, 9))]
    assert pick(fusion.weighted(lists, {0: 1.0, 1: 0.5})) == [("b", 2.5), ("c", 2.5), ("a", 1.0)]
    assert pick(fusion.concat(lists, 2)) == [("b", 5.0), ("c", 5.0)]
    equal = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0)], "query_id long, node_id string, score double")
    assert {r.score for r in fusion.normalized(equal).collect()} == {1.0}
    with pytest.raises(ValueError):
        fusion.hybrid([equal.withColumn("rank", F.lit(1))], method="x")


def test_greedy_sentences(spark):
    text = " ".join(f"Sentence number {k} has words." for k in range(60)) + " " + "x" * 900 + "."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "One.")], "doc_id long, text string")
    parts = [s.strip() for s in re.findall(r"[^.]*\.", text)]
    expect, group, used = [], [], 0
    for s in (p[k : k + 252] if len(p) >= 256 else p for p in parts for k in (range(0, len(p), 252) if len(p) >= 256 else [0])):
        size = int(len(s) / 4) + 1
        if group and used + size > 64:
            expect.append(" ".join(group))
            group, used = [], 0
        group.append(s)
        used += size
    expect.append(" ".join(group))
    got = chunks.by_sentence(docs, 64).orderBy("doc_id", "pos").collect()
    assert [r.text for r in got if r.doc_id == 1] == expect
    assert [(r.doc_id, r.text) for r in got if r.doc_id != 1] == [(3, "One.")]
    lapped = [r.text for r in chunks.by_sentence(docs.where("doc_id = 1"), 64, 20).orderBy("pos").collect()]
    assert lapped[0] == expect[0] and lapped[1] == " ".join(parts[6:8]) + " " + expect[1]


def test_windows_cover_the_text(spark):
    docs = spark.createDataFrame([(k, "".join(chr(97 + j % 26) for j in range(k))) for k in (0, 1, 9, 10, 11, 25)], "doc_id long, text string")
    for doc, text in docs.collect():
        rows = [r.text for r in chunks.fixed(docs.where(F.col("doc_id") == doc), 10, 3).orderBy("pos").collect()]
        assert rows[0] + "".join(r[3:] for r in rows[1:]) == text and all(len(r) <= 10 for r in rows)
    with pytest.raises(ValueError):
        chunks.by_token(docs, 5, 5)


def test_tree_is_complete(spark):
    docs = spark.createDataFrame([(1, "z" * 5000), (2, "")], "doc_id long, text string")
    nodes = chunks.hierarchy(docs).cache()
    leaves = chunks.leaves(nodes)
    assert sum(len(r.text) for r in leaves.where("doc_id = 1").collect()) == 5000
    assert {r.level for r in leaves.collect()} == {2}


def test_embedding_and_dense(spark):
    rows = spark.createDataFrame([(1, "red green"), (2, "green red"), (3, "blue"), (4, None)], "node_id long, text string")
    vectors = rows.select("node_id", HashedEmbedding(16).embed(F.col("text")).alias("vector")).cache()
    hits = dense.dense_hits(vectors, vectors.where("node_id = 1").select(F.lit(7).alias("query_id"), F.col("vector").alias("q")), 2)
    assert [(r.node_id, r.score) for r in hits.orderBy("rank").collect()] == [(1, 1.0), (2, 1.0)]


def test_precision(spark):
    rows = [(1, 1, 1), (1, 2, 0), (1, 3, 1), (2, 1, 0)]
    got = evaluation.context_precision(spark.createDataFrame(rows, "query_id long, rank int, relevant int")).collect()
    assert {r.query_id: r.context_precision for r in got} == {1: round((1 + 2 / 3) / 2, 6), 2: 0.0}


def test_layout(spark):
    lines = ["int total = 0; for (;;) { total += 1; count(total); } return total; }{ end; }", "short; x", "word " * 30]
    parts = [list(r.p) for r in spark.createDataFrame(list(enumerate(lines)), "n int, text string").orderBy("n").select(layout.split_code_line(F.col("text")).alias("p")).collect()]
    assert "".join(parts[0]).replace(" ", "") == lines[0].replace(" ", "") and len(parts[0]) > 3 and parts[1:] == [[lines[1]], [lines[2]]]
    pages = spark.createDataFrame([(1,), (2,)], "page long")
    with pytest.raises(IndexError):
        layout.page_range(pages, 1, 3)
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0, "a"), (1, 1, 1.0, 0.0, "b"), (1, 2, 2.0, 0.0, " "), (1, 3, 3.0, 0.0, "c")], "page long, line long, y0 double, x0 double, text string")
    got = layout.paragraphs(lines).groupBy("par").agg(F.count("*").alias("n"), F.min("y").alias("y")).orderBy("y").collect()
    assert [(r.n, r.y) for r in got] == [(2, 0.0), (1, 3.0)]


def test_files(spark, tmp_path):
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as f:
        f.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p><w:r><w:t>World</w:t></w:r></w:p></w:body></w:document>')
    xlsx = io.BytesIO()
    with zipfile.ZipFile(xlsx, "w") as f:
        f.writestr("xl/sharedStrings.xml", "<sst><si><t>name</t></si></sst>")
        f.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>')
    (tmp_path / "a.docx").write_bytes(docx.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "b.xlsx").write_bytes(xlsx.getvalue())
    (tmp_path / "c.txt").write_bytes("é one.".encode("latin-1"))
    (tmp_path / "d.json").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "e.zip").write_text("x")
    base = str(tmp_path)
    words = {r.path.rsplit("/")[-1]: (r.text, r.error) for r in files.load_word(spark, f"{base}/*.docx").collect()}
    assert words["a.docx"][0] == "Hello\nWorld"
    assert "BadZipFile" in words["bad.docx"][1]
    assert files.load_excel(spark, f"{base}/b.xlsx").first().text == "name 5"
    assert files.load_text(spark, f"{base}/c.txt", "iso-8859-1").first().text == "é one."
    assert files.load_json(spark, f"{base}/d.json", lines=True).count() == 2
    assert [r.path.rsplit("/")[-1] for r in files.list_files(spark, base).collect()] == ["a.docx", "b.xlsx", "bad.docx", "c.txt", "d.json"]
    assert files.list_files(spark, base, extensions=("TXT",)).count() == 1
    with pytest.raises(ValueError):
        files.load_pdf(spark, base, "other")
    with pytest.raises(ImportError):
        files.load_pdf(spark, base, "pypdf")


def test_ingest_takes_each_file_once(spark, tmp_path):
    source, table, mark = tmp_path / "in", str(tmp_path / "nodes"), str(tmp_path / "mark")
    source.mkdir()
    (source / "a.txt").write_text("First one. Second one.")
    (source / "bad.docx").write_bytes(b"no zip")
    (source / "e.txt").write_text("  ")
    ingest_directory(spark, str(source), table, mark)
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as f:
        f.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Of a file.</w:t></w:r></w:p></w:body></w:document>')
    (source / "b.md").write_text("# T\nThird one.\n# U\nFourth.")
    (source / "w.docx").write_bytes(docx.getvalue())
    (source / "p.html").write_text("<body><p>Para</p><li>Item</li></body>")
    (source / "j.json").write_text('{"k": {"m": [1, "x"]}}')
    (source / "x.pdf").write_bytes(b"%PDF")
    (source / "c.bin").write_text("No.")
    for _ in range(2):
        ingest_directory(spark, str(source), table, mark)
    rows = spark.read.parquet(table).collect()
    assert sorted(r.text for r in rows) == ["# T\nThird one.", "# U\nFourth.", "First one. Second one.", "Item", "Of a file.", "Para", "k m 0 1", "k m 1 x"]
    status = spark.read.parquet(f"{table}-status")
    got = {r.path.rsplit("/")[-1]: (r.n_nodes, r.error is None) for r in status.collect()}
    assert got == {"a.txt": (1, True), "bad.docx": (0, False), "e.txt": (0, True), "b.md": (2, True), "w.docx": (1, True), "p.html": (2, True), "j.json": (2, True), "x.pdf": (0, False)}
    assert {r.status: (r.docs, r.nodes) for r in status_counts(status).collect()} == {"ok": (5, 8), "skipped": (1, 0), "failed": (2, 0)}


def test_collections(spark, tmp_path):
    path = str(tmp_path / "c")
    nodes = spark.createDataFrame([("n1", "one one two"), ("n2", "three")], "node_id string, text string")
    collection.append_nodes(spark, path, nodes)
    collection.append_nodes(spark, path, nodes)
    assert collection.describe(collection.attach(spark, path)) == {"columns": {"node_id": "string", "text": "string"}, "rows": 2}
    collection.create_hybrid_collection(str(tmp_path / "h"), nodes, LetterEmbedding())
    rows = {r.node_id: r for r in collection.attach(spark, str(tmp_path / "h")).collect()}
    assert rows["n1"].sparse == {"one": 2.0, "two": 1.0} and sum(x * x for x in rows["n1"].vector) == pytest.approx(1)
    collection.write_markdown(spark.createDataFrame([("a/b c.pdf", "# x")], "path string, md string"), str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["# x"]
    assert collection.sample_corpus(spark).count() == 10


def test_web_pages(spark):
    urls = spark.createDataFrame([("http://a",), ("http://b",)], "url string")

    def read(url):
        if url.endswith("b"):
            raise OSError("gone")
        return "<body>Some text. <b>More</b></body>"

    pages = fetch(urls, read)
    assert {r.url: r.error for r in pages.collect()} == {"http://a": None, "http://b": "OSError: gone"}
    assert [r.text for r in ingest_pages(pages.where("error is null")).collect()] == ["Some text. More"]


def test_json_and_markdown_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": {"b": [1, {"c": "x"}]}, "d": []}')
    (tmp_path / "bad.json").write_text("{")
    assert files.flat_json('{"a": {"b": [1, {"c": "x"}]}, "d": []}', 0) == "a b 1\na b c x\nd []"
    assert files.flat_json('{"a": {"b": 1}}', 1) == "b 1" and files.flat_json('{"a": {"b": 1}}', 0, 20) == 'a {"b": 1}'
    got = {r.path.rsplit("/")[-1]: (r.text, r.error) for r in files.load_json(spark, f"{tmp_path}/*.json", levels=1).collect()}
    assert got["a.json"] == ("b 1\nc x\nd []", None) and "JSONDecodeError" in got["bad.json"][1]
    (tmp_path / "m.md").write_text("intro\n# A\n```\n# no\n```\n## B\nend")
    assert [r.text for r in files.load_markdown(spark, f"{tmp_path}/m.md").orderBy("part").collect()] == ["intro", "# A\n```\n# no\n```", "## B\nend"]
    listed = files.list_files(spark, str(tmp_path))
    assert files.listing_size(listed).first() == (3, sum(p.stat().st_size for p in tmp_path.iterdir()))
    assert files.load_directory(spark, str(tmp_path), extensions=("md",)).count() == 1 and files.auto_load(spark, f"{tmp_path}/m.md").count() == 1


def test_retrievers_and_chat(spark, tmp_path):
    nodes = collection.sample_corpus(spark)
    asked = spark.createDataFrame([(1, "rows between tasks"), (2, "vector for a text")], "query_id long, query string")
    found = retrievers.build_hybrid(nodes, retrievers.KINDS, embedding=LetterEmbedding(), fetch_k=5, method="weighted", weights={"vector": 0.5})
    assert {r.query_id: r.node_id for r in found.retrieve(asked, 3).where("rank = 1").collect()} == {1: "1", 2: "3"}
    assert "vector: Vectors, weight 0.5" in found.describe()
    for kinds, embedding in (("vector",), None), (("other",), None):
        with pytest.raises(ValueError):
            retrievers.build_hybrid(nodes, kinds, embedding=embedding)
    whole = index.build_index(nodes)
    index.write_index(whole, f"{tmp_path}/i")
    stored = index.load_index(spark, f"{tmp_path}/i")
    for variant in index.VARIANTS:
        hits = [sorted(map(tuple, index.bm25(i, asked, 4, variant=variant).collect())) for i in (whole, stored)]
        assert hits[0] == hits[1] and hits[0]
    more = spark.createDataFrame([(10, "rows and rows of tasks")], "node_id long, text string")
    assert index.bm25(index.append_nodes(stored, more), asked, 1).where("query_id = 1").first().node_id == index.bm25(index.append_nodes(whole, more), asked, 1).where("query_id = 1").first().node_id
    memory = spark.createDataFrame([(7, 0, "user", "Tell of a shuffle."), (7, 1, "assistant", "Yes.")], "conv_id long, turn int, role string, text string")
    questions = spark.createDataFrame([(7, 1, 70, "What moves rows?"), (7, 2, 71, "And postings?"), (8, 1, 80, "What is cosine?")], "conv_id long, turn int, query_id long, query string")
    after = chat.converse(questions, retrievers.Bm25(whole), nodes, ExtractiveModel(), memory, chat.ChatConfig(condense=False, similarity_top_k=1))
    texts = {(r.conv_id, r.turn): r.text for r in after.collect()}
    assert texts[(7, 3)] == "A shuffle moves rows between tasks." and texts[(7, 5)].startswith("Postings") and texts[(8, 1)] == "Cosine compares the directions of vectors."
    assert chat.reset(after, questions.where("conv_id = 7")).select("conv_id").distinct().count() == 1
    assert chat.condensed(questions.where("query_id = 71"), memory, RuleModel()).first().query == "Tell of a shuffle. And postings?"


def line_pdf():
    class LinePdf:
        """A file of lines instead of a PDF; a form feed ends a page."""

        def _pages(self, content):
            return content.decode().split("\f")

        def page_count(self, content):
            return len(self._pages(content))

        def spans(self, content):
            box = lambda n: {"x0": 0.0, "y0": 10.0 * n, "x1": 9.0, "y1": 10.0 * n + 9}
            return [{"page": p, "line": n, "span": 0, **box(n), "font": "Mono" if t.startswith("$") else "Arial", "size": 20.0 if t.startswith("T") else 10.0, "flags": 0, "text": t} for p, page in enumerate(self._pages(content), 1) for n, t in enumerate(page.split("\n"))]

        def links(self, content):
            return [{"page": 1, "x0": 0.2, "y0": 10.0, "x1": 9.0, "y1": 19.0, "uri": "http://x"}]

        def tables(self, content):
            return [{"page": 1, "y": 15.0, "headers": ["a"], "rows": [["1"]]}] if self._pages(content) else []

        def pictures(self, content):
            return [{"page": 2, "number": 1, "image": b"png"}] if self._pages(content) else []

        def render(self, content, page, options):
            return f"{options.format}{options.zoom:.1f}:{self._pages(content)[page - 1][:5]}".encode()

    return LinePdf()


def test_pdf_files(spark, tmp_path):
    (tmp_path / "f.pdf").write_text("Title of it\nsee here\n \n- item\nline one\nline two\n \n$ ls\n \n$ cd\fsecond")
    (tmp_path / "bad.pdf").write_bytes(b"\xff\xfe")
    found = pdf.files_at(spark, f"{tmp_path}/*.pdf")
    pages = {(r.path.rsplit("/")[-1], r.page): r.md for r in pdf.convert_pages(found, line_pdf(), image_dir="img/").collect()}
    one = "# Title of it\n\n[see here](http://x)\n\n| a |\n|---|\n| 1 |\n\n- item\n\nline one line two\n\n```\n$ ls\n$ cd\n```"
    assert pages == {("f.pdf", 1): one, ("f.pdf", 2): "![page002_img01.png](img/page002_img01.png)\n\nsecond"}
    assert [r.md for r in pdf.convert(found, line_pdf()).collect()] == [one + "\n\n---\n\nsecond"]
    options = pdf.RenderOptions(dpi=144, image_format=".PNG")
    images = {r.name: bytes(r.image) for r in pdf.render_pages(found, line_pdf(), options).collect()}
    assert images == {"f_page_001.png": b"png2.0:Title", "f_page_002.png": b"png2.0:secon"}
    assert pdf.render_pages(found, line_pdf(), first=2, last=2).count() == 1
    with pytest.raises(IndexError):
        pdf.render_pages(found, line_pdf(), first=1, last=3)
    with pytest.raises(ValueError):
        pdf.RenderOptions(image_format="gif")


def test_console():
    said, asked = [], iter(["", " What? ", "quit", "never"])
    assert chat.chat_loop(str.upper, lambda _: next(asked), said.append) == 1 and said == ["WHAT?"]


def test_chat_settings(monkeypatch):
    monkeypatch.setenv("BRINDLE_CHAT_SIMILARITY_TOP_K", "9")
    monkeypatch.setenv("BRINDLE_CHAT_CONDENSE", "true")
    config = chat.ChatConfig.from_environment(memory_token_limit=5)
    assert (config.similarity_top_k, config.condense, config.memory_token_limit) == (9, True, 5)


def test_evaluation_pipeline(spark, tmp_path):
    nodes = collection.sample_corpus(spark)
    metrics = evaluation.default_metrics(OverlapJudge(), LetterEmbedding())
    scored = evaluation.run_pipeline(nodes, retrievers.Bm25(index.build_index(nodes)), ExtractiveModel(), metrics, k=3).cache()
    assert scored.count() == 10
    assert {r.faithfulness for r in scored.collect()} == {1.0} and {r.context_recall for r in scored.collect()} == {1.0}
    report = evaluation.write_report(scored, list(metrics), str(tmp_path / "r"), 1.5)
    assert report["n"] == 10 and report["scores"]["context_precision"] == 1.0 and report["elapsed_seconds"] == 1.5
    assert json.loads(spark.read.text(f"{tmp_path}/r/summary").first().value) == report


def test_models_that_fail(spark):
    class Silent:
        def complete(self, prompt):
            return F.lit(None).cast("string")

    docs = spark.createDataFrame([(1, "One sentence here. Another one there. " * 20 + "\n\nA short one."), (2, None), (3, "Single.")], "doc_id long, text string")
    assert {r.doc_id: r.n for r in modeled.split_by_llm(docs, Silent()).groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {1: 1, 3: 1}
    assert [r.text for r in modeled.propositions(modeled.paragraphs_of(docs.where("doc_id = 1")), Silent()).orderBy("par").collect()] == [("One sentence here. Another one there. " * 20).strip(), "A short one."]
    assert modeled.split_agentic(docs, Silent(), LetterEmbedding()).count() == 2
    merged = docs.limit(1).select(modeled.merged_metadata(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m")).first().m
    assert merged == {"a": "1", "b": "3"}
    with pytest.raises(ValueError):
        chunks.auto_split(docs, "nothing")


def test_entry_survives_without_the_extra_package(monkeypatch):
    import builtins

    import __spark_entry__ as entry

    real = builtins.__import__

    def blocked(name, *a, **b):
        if name.startswith(("corpus_pipeline", "brindle.llm")):
            raise ImportError(name)
        return real(name, *a, **b)

    monkeypatch.setattr(builtins, "__import__", blocked)
    assert "bm25_okapi_topk" in entry.queries() and not [n for n in entry.queries() if n.startswith("op")]
    assert set(entry.oracle_sql()) <= set(entry.queries())
