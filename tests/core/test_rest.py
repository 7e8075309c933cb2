"""Chunkers, store, statistics, sources, sinks, counters and streams."""

import base64
import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tessellane.operators import chunking, remote, stats, store
from tessellane.sources import files, sinks
from tessellane.streaming import counters, ingest

TEXT = ("Alpha beta gamma. " * 9 + "\n\n" + "Delta epsilon zeta! " * 7 + "\n") * 5


@pytest.mark.parametrize("size", [100, 260, 500])
def test_windows(size):
    got = chunking.windows(TEXT, size, 30)
    assert all(TEXT[s:e] == t and e - s <= size for t, s, e, _ in got)
    assert got[0][1] == 0 and got[-1][2] == len(TEXT)
    assert all(a[2] - b[1] == 30 for a, b in zip(got, got[1:], strict=False))


def test_windows_without_a_cut_are_full():
    text = "x" * 130 + ". " + "y" * 150
    assert [(s, e) for _, s, e, _ in chunking.windows(text, 100, 10)] == [(0, 100), (90, 190), (180, 280), (270, 282)]


@pytest.mark.parametrize("bad", [(99, 0), (3000, 0), (100, 50), (100, -1)])
def test_windows_refuse(bad, spark):
    with pytest.raises(ValueError):
        chunking.chunks(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "lab", size=bad[0], overlap=bad[1])


def test_other_chunkers():
    assert [c[0] for c in chunking.packed_sentences("一二三。四五。" + "x" * 12, 6, 2)] == ["一二三。", "三。四五。", "x" * 6, "x" * 6]
    kit = chunking.headed_paragraphs("# One\n\naaaa\n\n# Two\n\nbbbb", 10, 4)
    assert [(c[0], c[3]) for c in kit] == [("# One\naaaa", "# Two"), ("aaaa\n# Two", "# Two"), ("# Two\nbbbb", "# Two")]
    ten, nine = "x" * 10, "x" * 9
    assert [c[0] for c in chunking.headed_paragraphs("x" * 25, 10, 2)] == [ten, f"{ten}\n{ten}", f"{ten}\n{nine}", f"{nine}\nx"]
    assert [c[0] for c in chunking.sentence_windows("short\n\n" + "长句子很长。" * 3, 6, 3)][0] == "short"
    long_first = "甲" * 50 + "。乙。丙。"
    assert chunking.sentence_windows(long_first, 10, 5)[0][0].startswith("甲")  # and it ends
    for cut in chunking.CHUNKERS.values():
        assert cut("") == [] and cut("  \n\n ") == []


def test_chunk_tables(spark):
    docs = spark.createDataFrame([(1, TEXT, 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, chunk int")
    rows = chunking.chunks(docs, "lab", size=200, overlap=20).collect()
    assert {r.doc_id for r in rows} == {1} and [r.ordinal for r in rows] == list(range(1, len(rows) + 1))
    assert [r.chunk for r in chunking.fixed_chunks(docs, 1000).collect()] == [TEXT[i : i + 1000] for i in range(0, len(TEXT), 1000)]


def test_store(spark):
    docs = store.digested(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string"))
    none = docs.limit(0)
    first = store.new_documents(docs, none)
    assert sorted(r.doc_id for r in first.collect()) == [1, 3]
    assert store.new_documents(docs, first).count() == 0
    cut = store.reindexed(spark.createDataFrame([(1, TEXT)], "doc_id long, text string"), size=200, overlap=20)
    assert cut.where("embedding is not null").count() == 0 and store.pending(cut, "k").count() == cut.count()
    done = store.attached(cut, cut.select("id", F.array(F.lit(1.0)).alias("embedding")), "k")
    assert store.pending(done, "k").count() == 0 and store.pending(done, "other").count() == cut.count()
    listed = {r.doc_id: (r.chunks, r.embedded) for r in store.listing(docs, done.select("doc_id", "embedding")).collect()}
    assert listed[1] == (cut.count(), cut.count()) and listed[3] == (0, 0)
    assert store.without(docs, spark.createDataFrame([(1,)], "doc_id long")).count() == 2


def test_statistics(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "g string, n int")
    assert sorted((r.g, r.percent) for r in stats.largest_remainder(df, "g").collect()) == [("a", 34), ("b", 33), ("c", 33)]
    texts = spark.createDataFrame([("low lower lowest low low",)], "text string")
    merges = stats.train_merges(texts, 4)
    assert merges[0] == (108, 111, 256) and merges[1] == (256, 119, 257)
    ids = stats.encode("lowest é", merges)
    assert stats.decode(ids, merges) == "lowest é" and len(ids) < len("lowest é".encode())
    put = spark.createDataFrame([("k", "old", 1), ("k", "new", 2)], "k string, v string, at int")
    assert stats.last_put(put, "k", "v", "at").first().v == "new"
    refs = spark.createDataFrame([(1, "2到3"), (2, "9")], "source int, text string")
    got = sorted((r.source, r.target, r.title) for r in stats.resolved(refs, spark.createDataFrame([(2, "two"), (3, "three")], "entry int, title string")).collect())
    assert got == [(1, 2, "two"), (1, 3, "three"), (2, 9, None)]


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


PDF = b"%PDF-1.4\n1 0 obj\nstream\n" + zlib.compress(b"BT (Hello) Tj [(Wor) -20 (ld)] TJ (meta) /X ET") + b"\nendstream\nendobj"


def test_decoders():
    assert files.decode("汉字".encode("gbk"), "pro") == "汉字" and files.decode("検索".encode("shift_jis"), "kit") == "検索"
    assert files.decode(b"\xef\xbb\xbfa\r\nb", "lab") == "a\nb" and files.decode(b"\xef\xbb\xbfa", "kit") == "﻿a"
    assert files.decode(b"\xff\xfe\xfd", "easy") == b"\xff\xfe\xfd".decode("latin-1")
    with pytest.raises(ValueError):
        files.decode(b"\x81", "lab")
    assert files.docx_text(docx(" a ", "", "b")) == "a\nb"
    assert files.pdf_text(PDF) == "Hello Wor ld meta" and files.pdf_text(PDF, "easy") == "HelloWorld"
    assert files.html_nodes("<p>a</p><script>s()</script><p> b</p> ") == "a\ns()\n b"
    assert files.html_nodes("<p>a</p><script>s()</script><p> b</p>", True) == "a\n b"
    with pytest.raises(ValueError):
        files.read_file("x.bin", b"", "pro")
    assert files.read_file("x.bin", b"", "kit") is None
    assert files.read_file("x.csv", b"a , b\nc,d\n", "easy") == "a | b\nc | d"


def pdf(*streams):
    return b"%PDF-1.4\n" + b"\n".join(b"1 0 obj\nstream\r\n" + d + b"\r\nendstream\nendobj" for d in streams)


def test_pdf_strings():
    made = pdf(zlib.compress("[(a\\)b) 3 (é)] TJ (c\\\\d) Tj (e(f)g) Tj [1 2] 0 d (x\\ty)Tj".encode()), b"(raw) Tj", zlib.compress(b"(next) Tj"))
    assert files.pdf_text(made) == "a)b é c\\d f x\\ty next"
    assert files.pdf_text(made, "easy") == "c\\dx\tya)bÃ©next"
    assert files.pdf_text(pdf(b"not deflated")) == "" and files.pdf_text(b"") == ""
    with pytest.raises(ValueError):
        files.pdf_text(made, "lab")  # pypdf isn't there
    assert files.docx_text(docx(" a &amp; b", "c"), profile="easy") == " a & bc"


def test_folders_and_tables(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, content in {"b.md": b"# T\n| n | c |\n|---|---|\n| x | 1 |\n", "sub/a.txt": b"text", "blank.txt": b"  ", "d.docx": docx("para"), ".hid.txt": b"h", "x.bin": b"z", "bad.docx": b"no"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.name: r.text for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert got.keys() - {".hid.txt"} == {"b.md", "a.txt", "d.docx"} and got["d.docx"] == "para"
    assert {r.name for r in files.read_folder(spark, str(tmp_path), "kit").collect()} == {"b.md"}
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(["# Land", "| n | c |", "|---|:-:|", "| x | 1 |", "text", "## City", "| h |", "|--|", "| y |"])], "path string, line int, text string")
    rows = sorted((r.line, r.heading, r.cells) for r in files.markdown_tables(lines).collect())
    assert rows == [(3, "Land", ["x", "1"]), (8, "City", ["y"])]
    page = ["### One", "- 证据等级：A", "- 来源：https://a http://b", "see https://c", "- 备注：争议 https://d", "<!-- 成本标签: 钱=0 时间=少 毅力=否 收益=大 口径=x -->", "### One", "- 证据等级：D", "TODO"]
    notes = files.entries(spark.createDataFrame([("f", i, t) for i, t in enumerate(["before", *page])], "path string, line int, text string"))
    got = sorted((r.line, r.title, r.grade, r.disputed, r.todo, r.links, r.benefit) for r in notes.collect())
    assert got == [(1, "One", "A", 1, 0, 3, "大"), (7, "One", None, 0, 1, 0, None)]
    assert tuple(files.entry_counts(notes).first()) == (2, 1, 0, 0, 1, 1, 3, 1, 0, 0)
    (tmp_path / "cases.json").write_text('[{"q": "a", "kw": "b"}]')
    assert files.read_cases(spark, str(tmp_path / "cases.json")).first().kw == "b"
    up = spark.createDataFrame([(base64.b64encode(b"hi").decode(),)], "x string")
    assert bytes(up.select(files.uploaded(F.col("x")).alias("b")).first().b) == b"hi"
    with pytest.raises(Exception, match="too large"):
        up.select(files.uploaded(F.col("x"), 1).alias("b")).first()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, t string")
    sinks.save_index({"one": df, "two": df}, str(tmp_path / "ix"))
    back = sinks.load_index(spark, str(tmp_path / "ix"))
    assert back.keys() == {"one", "two"} and back["one"].first().t == "a"
    assert sinks.as_json(df).first().json == '{"n":1,"t":"a"}'
    assert sinks.from_json(sinks.as_json(df), df.schema.simpleString()[7:-1].replace(":", " ")).collect() == df.collect()
    sinks.write_markdown(df, str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).first().value == "| 1 | a |"


SAMPLES = [("d", 0, 10.0), ("d", 2, 30.0), ("d", 4, 5.0), ("d", 6, 25.0), ("e", 0, 1.0), ("e", 2, 2.0)]


def test_counters(spark):
    df = spark.createDataFrame(SAMPLES, "key string, s int, value double").selectExpr("key", "timestamp_seconds(s) as ts", "value")
    rows = counters.running_total(counters.rates(df, "key", "ts", "value"), "key", "ts", "delta").orderBy("key", "ts").collect()
    assert [r.delta for r in rows] == [None, 20.0, 0.0, 20.0, None, 1.0]
    assert [r.rate for r in rows] == [None, 10.0, 0.0, 10.0, None, 0.5] and [r.total for r in rows] == [0, 20, 20, 40, 0, 1]
    few = counters.recent(df, "key", "ts", "value", 2).orderBy("key", "ts").collect()
    assert [r.recent_max for r in few] == [10, 30, 30, 25, 1, 2]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    df = spark.createDataFrame(SAMPLES, "key string, s int, value double").selectExpr("key", "timestamp_seconds(s) as ts", "value")
    df.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    q = counters.stream_rates(stream, "key", "ts", "value").writeStream.format("memory").queryName("rated").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.key, r.delta, r.total) for r in spark.table("rated").collect() if r.delta is not None)
    assert got == [("d", 0.0, 20.0), ("d", 20.0, 20.0), ("d", 20.0, 40.0), ("e", 1.0, 1.0)]
    docs = tmp_path / "docs"
    spark.createDataFrame([("x", "a"), ("y", "a"), ("z", "b")], "name string, text string").coalesce(1).write.parquet(str(docs))
    seen = []
    for i in range(2):
        s = spark.readStream.schema("name string, text string").parquet(str(docs))
        kept = store.DocumentStore(spark, str(tmp_path / "store"))
        ingest.ingest(s, kept, str(tmp_path / f"c{i + 2}"), then=lambda k, n: seen.append((n, k.table("documents").count()))).awaitTermination(120)
    assert sorted(r.name for r in kept.table("documents").collect()) == ["x", "z"] and seen == [(0, 2), (0, 2)]
    running = ingest.ingest(spark.readStream.schema("name string, text string").parquet(str(docs)), store.DocumentStore(spark, str(tmp_path / "other")), str(tmp_path / "c9"), every="1 second")
    running.processAllAvailable()
    running.stop()
    assert store.DocumentStore(spark, str(tmp_path / "other")).table("documents").count() == 2


def test_windows_of_streams_and_tables(spark):
    df = spark.createDataFrame([("k", 0, 1.0), ("k", 50, 2.0), ("k", 200, 4.0)], "key string, s int, value double").selectExpr("key", "timestamp_seconds(s) as ts", "value")
    total = F.sum("value").alias("total")
    assert sorted(r.total for r in counters.windowed(df, "ts", "1 minute", "1 minute", ["key"], total).collect()) == [3.0, 4.0]
    assert sorted(r.total for r in counters.windowed(df, "ts", "1 minute", "1 minute", ["key"], total, slide="30 seconds").collect()) == [1.0, 2.0, 3.0, 4.0, 4.0]
    assert sorted(r.total for r in counters.sessions(df, "ts", "1 minute", "1 minute", ["key"], total).collect()) == [3.0, 4.0]


def test_document_store(spark, tmp_path):
    kept = store.DocumentStore(spark, str(tmp_path / "store"), size=200, overlap=20)
    assert kept.table("documents").count() == 0 and kept.listing().count() == 0
    docs = spark.createDataFrame([("a.md", TEXT), ("b.md", "short text"), ("c.md", "short text"), ("d.md", None)], "name string, text string")
    assert kept.add(docs) == 2 and kept.add(docs) == 0
    assert kept.add(spark.createDataFrame([("e.md", "late")], "name string, text string"), 5) == 1
    assert kept.add(spark.createDataFrame([("f.md", "later")], "name string, text string"), 5) == 0
    listed = {r.name: r for r in kept.listing().collect()}
    assert set(listed) == {"a.md", "b.md", "e.md"} and listed["b.md"].chunks == 1 and listed["a.md"].chunks > 3 and listed["a.md"].embedded == 0
    assert kept.listing().first().name == "e.md"
    many = kept.table("chunks").count()
    failing = remote.Embedder(lambda texts: [[float("nan")] for _ in texts], "m")
    with pytest.raises(Exception, match="not finite"):
        kept.embed(failing)
    model = remote.Embedder(lambda texts: [[float(len(t)), float(len(texts))] for t in texts], "m")
    assert kept.embed(model, round_size=4) == many and kept.embed(model) == 0
    rows = kept.table("chunks").collect()
    assert all(r.embedding[0] == len(r.text) and r.embedding[1] <= 32 and r.embedding_key == model.key for r in rows)
    assert kept.embed(remote.Embedder(model.call, "other")) == many
    kept.delete(kept.table("documents").where("name = 'a.md'").select("id"))
    assert kept.table("chunks").count() == 2 and kept.statistics().first().n_docs_src == 2
    kept.reindex(size=100, overlap=10)
    assert kept.table("chunks").where("embedding is not null").count() == 0
    again = store.DocumentStore(spark, str(tmp_path / "store"))
    assert {r.name for r in again.table("documents").collect()} == {"b.md", "e.md"}


def test_remote_hooks(spark):
    with pytest.raises(ValueError):
        remote.post("http://example.org", {})
    assert remote.in_order([{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}], 2) == [[1.0], [2.0]]
    for bad in ([[1.0]], [[1.0], []], [[1.0], [1.0, 2.0]], [[1.0], [float("inf")]]):
        with pytest.raises(ValueError):
            remote.checked(bad, 2)
    with pytest.raises(ValueError):
        remote.in_order([{"index": 0, "embedding": [1.0]}, {"index": 0, "embedding": [1.0]}], 2)
    q = spark.createDataFrame([(1, "a"), (2, "fails"), (3, "empty")], "query_id int, text string")

    def call(x):
        if x == "fails":
            raise ValueError("no")
        return "" if x == "empty" else f" better\n{x} "

    assert {r.query_id: r.text for r in remote.rewritten(q, call).collect()} == {1: "better a", 2: "fails", 3: "empty"}
    assert remote.rewritten(q) is q
    extractive = spark.createDataFrame([(i, f"own {i}") for i in range(1, 5)], "query_id int, answer string")
    prompts = spark.createDataFrame([(1, "good", 2), (2, "uncited", 2), (3, "fails", 2)], "query_id int, prompt string, n_sources int")

    def chat(p):
        if p == "fails":
            raise ValueError("no")
        return "told [S2]" if p == "good" else "told [S3]"

    got = {r.query_id: (r.answer, r.kind) for r in remote.answered(extractive, prompts, chat).collect()}
    assert got == {1: ("told [S2]", "generated"), 2: ("own 2", "extractive"), 3: ("own 3", "extractive"), 4: ("own 4", "extractive")}
    assert {r.kind for r in remote.answered(extractive, prompts).collect()} == {"extractive"}


def test_sql_names(spark):
    import random

    from tessellane.functions import sql, text

    assert set(sql.register(spark)) == {"tok_pro", "tok_lab", "tok_easy", "tok_kit", "split_sentences", "hard_split", "estimate_tokens", "chunk_lab", "chunk_easy", "chunk_kit", "chunk_pro"}
    rng = random.Random(4)
    texts = ["".join(rng.choice(["Ab", "回", "滚的", "か", "한", " ", "，", "9_", "。", "the ", "㐀", "!", "\n"]) for _ in range(rng.randrange(25))) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    df.createOrReplaceTempView("texts")
    for name in ("tok_pro", "tok_lab", "tok_easy", "tok_kit", "split_sentences", "estimate_tokens", "hard_split"):
        ours = df.select(getattr(text, name)(F.col("text")).alias("x")).collect()
        assert [r.x for r in spark.sql(f"select {name}(text) as x from texts").collect()][:-2] == [r.x for r in ours][:-2], name
    rows = spark.sql("select c.ordinal, c.chunk from (select 'One. Two.' as t) v, lateral chunk_easy(v.t) c").collect()
    assert [tuple(r) for r in rows] == [(1, "One. Two.")]


def test_texts_links_and_anchors(spark):
    from tessellane.functions import text

    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)).select(c.alias("x")).first().x
    assert one(text.without_back_link(F.col("t")), t="[← 回总目录](../x.md)\n\nText") == "Text"
    assert one(text.rewritten_links(F.col("t"), "https://h/"), t='[a](b.md) [c](https://x) [d](#y) [e](./f.md "T")') == '[a](https://h/b.md) [c](https://x) [d](#y) [e](https://h/f.md "T")'
    assert one(text.plain_html(F.col("t")), t="<p>a <b>b</b></p>") == "a b"
    assert one(text.utc_stamp(F.to_timestamp(F.lit("2024-01-31 12:00:00"))), t="") == "2024-01-31T12:00:00Z"
    assert one(text.longest_common_han(F.col("a"), F.col("b")), a="看居民医保吧和x医保卡", b="城乡居民医保") == 4
    check = lambda wide, narrow, title: one(text.anchored(F.col("w"), F.col("n"), F.col("t")), w=wide, n=narrow, t=title)
    assert check("call 12356 now", "", "热线 12356") == "strong" and check("含糖饮料", "", "少喝含糖饮料") == "strong"
    assert check("你自己还", "", "个税自己报") == "weak" and check("你自己还", "自己", "个税自己报") == "strong" and check("无关", "", "标题") == "none"


def test_byte_pairs_as_columns(spark):
    merges = [(108, 111, 256), (256, 119, 257)]
    df = spark.createDataFrame([("low lo é",), (None,), ("",)], "t string")
    rows = df.select(stats.encoded(F.col("t"), merges).alias("ids")).select("ids", stats.decoded(F.col("ids"), merges).alias("t")).collect()
    assert [r.t for r in rows] == ["low lo é", None, ""] and rows[0].ids[:3] == [257, 32, 256]


def test_entry_answers(spark):
    import __spark_entry__

    got, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(got) and len(got) > 50
    assert all(callable(f) for f in got.values())
