from folioforge.operators import chunking
from folioforge.settings import Settings

A = "Alpha alpha alpha alpha alpha."
B = "Bravo bravo bravo bravo bravo."
C = " ".join(f"c{i}" for i in range(30))
E = " ".join(f"S{i} word word word word word." for i in range(10))


def doc(spark, secs, title="Release Notes", meta="\n\r\nMetadata:\n\tteam - platform", did="g"):
    s = "document_id string, title string, suffix_semantic string, suffix_keyword string, sections array<struct<type:string,link:string,text:string,heading:string,image_file_id:string,csv_file_id:string,csv_text:string>>, content string"
    return spark.createDataFrame([(did, title, meta, "k", secs, "a clashing column")], s)


def text(t, link="l"):
    return ("text", link, t, None, None, None, None)


def test_boundaries_links_and_affixes(spark):
    d = doc(spark, [text(t, f"u{i}") for i, t in enumerate([A, B, C, "Delta delta.", E])])
    c = chunking.chunk(d, Settings(chunk_tokens=40, min_content=8)).orderBy("chunk_index").collect()
    assert [x.content for x in c] == [f"{A}\n\n{B}", f"{C}\n\nDelta delta.", " ".join(E.split(" ")[:36]) + " ", " ".join(E.split(" ")[36:])]
    assert [[(k.offset, k.link) for k in x.source_links] for x in c] == [[(0, "u0"), (25, "u1")], [(0, "u2"), (80, "u3")], [(0, "u4")], [(0, "u4")]]
    assert {x.title_prefix for x in c} == {"Release Notes\n\r\n"} and [x.chunk_index for x in c] == [0, 1, 2, 3]


def test_empty_null_and_odd_sections(spark):
    assert [r.content for r in chunking.chunk(doc(spark, [])).collect()] == [""]
    assert [r.content for r in chunking.chunk(doc(spark, None, None)).collect()] == [""]
    c = chunking.chunk(doc(spark, [text(None), text("a"), ("image", "i", "seen", None, "f1", None, None), text("b")])).collect()
    assert [(r.content, r.image_file_id) for r in c] == [("a", None), ("seen", "f1"), ("b", None)]


def test_long_title_gives_its_room_back():
    limit, prefix, semantic, _ = chunking.budget("t " * 100, "m " * 30, True, Settings(chunk_tokens=300), chunking.count_words)
    assert (limit, prefix, semantic) == (300, "", "")
    assert chunking.budget("t", "m " * 80, True, Settings(chunk_tokens=300), chunking.count_words)[2] == ""


def test_sheets_as_rows(spark):
    rows = chunking.sheet_chunks(["a_b", "c"], [["1", "x"], ["2", ""], ["3", "y"]], "S", 20)
    assert rows == ["S\nColumns: a_b (a b), c\na_b=1, c=x\na_b=2\na_b=3, c=y"]
    wide = chunking.sheet_chunks(["a", "b"], [["p q r", "s t u"], ["1", "2"]], "", 4)
    assert wide == ["a=p q r", "b=s t u", "a=1, b=2"]
    d = doc(spark, [("tabular", "l", None, "S", None, "f", "a,b\n1,2\n\n3,4\n")])
    assert [r.content for r in chunking.chunk(d).collect()] == ["S\nColumns: a, b\na=1, b=2\na=3, b=4"]


def test_large_chunks_have_their_own_size(spark):
    c = spark.createDataFrame([("d", 512, i, f"t{i}") for i in range(9)], "document_id string, max_chunk_size int, chunk_index int, content string")
    r = chunking.large_chunks(c).orderBy("large_index").collect()
    assert [(x.max_chunk_size, x.content) for x in r] == [(2048, "t0\n\nt1\n\nt2\n\nt3"), (2048, "t4\n\nt5\n\nt6\n\nt7")]
