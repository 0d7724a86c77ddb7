"""HTML and EPUB round trips, records at the edges, streams."""

import json

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.sources import epub, html, records
from lectern.streaming import memory as streaming


def test_units_of_loose_html():
    page = "<html><head><style>p{}</style></head><body><h1>Chapter Two</h1><p>One <em>two</em><p>Three<div><p>x</p></div><ul><li>Item <b>bold</b><li>Next</ul></body>"
    assert [(t, x, m) for _, t, x, m, _ in html.units(page)] == [
        ("h1", "Chapter Two", "Chapter Two"), ("p", "One two", "One [[ZXEM1X]]two[[/ZXEM1X]]"), ("p", "Three", "Three"),
        ("li", "Item bold", "Item [[ZXB1X]]bold[[/ZXB1X]]"), ("li", "Next", "Next"),
    ]


@given(st.lists(st.tuples(st.sampled_from(["", "b", "em", "i"]), st.text(alphabet="abc&<é", min_size=1, max_size=5)), min_size=1, max_size=6))
def test_marking_and_markup_are_inverse(parts):
    import html as h

    inner = " ".join(f"<{t}>{h.escape(x)}</{t}>" if t else h.escape(x) for t, x in parts)
    (node,) = html.leaf_blocks(html.parse(f"<p>{inner}</p>"))
    marked, markers = html.marked_text(node)
    assert html.markup_of(marked, markers) == " ".join(f"<{t}>{h.escape(x, quote=False)}</{t}>" if t else h.escape(x, quote=False) for t, x in parts)


def test_epub_round_trip(spark, tmp_path):
    rows = [("b1", "T & U", "A", "fr", f"Chapter {c}", p, "p", f"Texte [[ZXB1X]]{c}.{p}[[/ZXB1X]] fin", [{"marker_id": "ZXB1X", "tag_name": "b", "attrs": {}}]) for c in (1, 2) for p in (1, 2)]
    schema = "book_id string, title string, author string, language string, chapter string, pos int, tag string, text string, markers array<struct<marker_id:string,tag_name:string,attrs:map<string,string>>>"
    assert epub.write(spark.createDataFrame(rows, schema), str(tmp_path)).collect()[0].n_bytes > 0
    (tmp_path / "broken.epub").write_bytes(b"no zip")
    items = epub.items(spark, str(tmp_path))
    assert [(r.title, r.spine_pos, r.name) for r in items.orderBy("spine_pos").collect()] == [("T & U", 1, "OEBPS/ch001.xhtml"), ("T & U", 2, "OEBPS/ch002.xhtml")]
    units = epub.units(items).where("tag = 'p'").orderBy("spine_pos", "block_pos").collect()
    assert [u.marked_text for u in units] == [r[7] for r in rows]
    assert epub.pick_chapter(items, 2).collect()[0].spine_pos == 2
    assert epub.reference_chapter(items, 1).count() == 1


def test_corrections_skip_broken_lines(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text(json.dumps({"source": "s", "draft": "d", "final": "f", "flags_fixed": ["x"]}) + "\n{broken\n" + json.dumps({"source": "", "final": "f"}) + "\n")
    assert [r.source for r in records.corrections(spark, str(p)).collect()] == ["s"]


def test_cast_config(spark, tmp_path):
    p = tmp_path / "c.toml"
    p.write_text('[aliases]\nAl = "Alice"\n[relationships]\n"Alice|Bob" = "friends"\n[glossary.x]\nsource = ["x"]\n[genders]\nAlice = "female"\n')
    c = records.cast_config(spark, p)
    assert c["aliases"].first().canonical == "Alice" and c["relations"].first().type == "friends" and c["glossary"].first().preferred == []


def test_stream_merges_once(spark, tmp_path):
    src, mem, ck = (str(tmp_path / x) for x in ("in", "mem", "ck"))
    schema = "chunk_id bigint, source string, draft string, final string, flags array<string>"
    spark.createDataFrame([(1, "s", "d", "f", [])], schema).write.parquet(src)
    spark.createDataFrame([], "chunk_id bigint, source string, draft string, final string").write.mode("overwrite").json(mem)
    for n in (1, 1):
        streaming.keep_corrections(spark.readStream.schema(schema).parquet(src), mem, ck).awaitTermination()
        assert spark.read.schema("source string").json(mem).count() == n
        spark.createDataFrame([(2, "s", "d", "f", [])], schema).write.mode("append").parquet(src)


def test_event_windows(spark):
    e = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 1.0D value union all select timestamp'2024-01-01 00:50:00', 'a', 2.0D")
    assert [(r.n, r.total) for r in streaming.event_counts(e).collect()] == [(2, 3.0)]
    assert F is not None


def test_translate_books(spark, tmp_path):
    from lectern.operators import models
    from lectern.plans import pipeline

    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "b.epub").write_bytes(epub.build("T", "A", "en", [("Chapter 1", "<p>One <b>two</b>.</p><p>One <b>two</b>.</p>"), ("Contents", "<p>no</p>")]))
    books = epub.items(spark, str(src))
    assert [r.spine_pos for r in books.orderBy("spine_pos").collect()] == [1, 2]
    assert pipeline.translate_books(books, models.Stub(), str(out)).count() == 1
    got = epub.units(epub.items(spark, str(out))).where("tag = 'p'").orderBy("block_pos").collect()
    assert [r.marked_text for r in got] == ["[Translated One [[ZXB1X]]two[[/ZXB1X]].]"] * 2
