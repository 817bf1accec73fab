"""Text operators against plain Python on hand-made rows."""
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamgrid.functions import messages as ms
from loamgrid.functions import text as tx
from loamgrid.functions import urls
from loamgrid.operators import chunking as ch
from loamgrid.operators import html as hm
from loamgrid.operators import rules as rl
from loamgrid.sources.readers import admit_pages


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


def test_clean_text(spark):
    assert one(spark, tx.clean_text, "a\r\nb\rc", "a\ta", "x  \ny", "a\n\n\n\n\n\nb", "a    b", "same\n same \nother", "  pad ") == [
        "a\nb\nc", "a  a", "x\ny", "a\n\nb", "a b", "same\nother", "pad"]


def test_language_threshold(spark):
    arabic = "ا"
    texts = [arabic * 12 + "a" * 88, arabic * 13 + "a" * 87, "", "plain", "ࢠ" * 50]
    assert one(spark, ms.language, *texts) == ["english", "urdu", "english", "english", "english"]
    assert one(spark, ms.has_rtl, "ࢠ", "ﭐ", "abc") == [True, True, False]


def test_greeting_and_correction(spark):
    assert one(spark, ms.is_greeting, " Hello! ", "hello there", "good morning") == [True, False, True]
    assert one(spark, ms.correction_text, "that is wrong it is 5", "wrong", "fine") == ["it is 5", "Updated", None]


def test_answer_json(spark):
    raw = ['Yes.\n[METADATA]{"suggestions": ["a", "b"]}', "No [METADATA] {broken", "Plain", 'X[METADATA]{"other": 1}']
    assert one(spark, ms.answer_text, *raw) == ["Yes.", "No", "Plain", "X"]
    assert one(spark, ms.answer_suggestions, *raw) == [["a", "b"], [], [], []]


def test_cache_key_equates_wordings(spark):
    a, b, c = one(spark, ms.cache_key, "What is the fee?", "fee", "fees")
    assert a == b != c


def test_urls(spark):
    base = F.lit("https://Ex.org/a/b.html?q=1")
    links = ["/c/?utm_source=x&k=1#top", "d", "//o.net/e/", "mailto:a@b.c", "#here", "?z=2", "HTTPS://UP.org", "javascript:void(0)"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(links)], "i int, x string")
    got = [r[0] for r in rows.orderBy("i").select(urls.normalise(urls.resolve(F.col("x"), base))).collect()]
    assert got == ["https://ex.org/c?k=1", "https://ex.org/a/d", "https://o.net/e", None, "https://ex.org/a/b.html", "https://ex.org/a/b.html?z=2",
                   "https://up.org/", None]


def test_breadcrumb_and_titles(spark):
    assert one(spark, tx.breadcrumb, "https://x.org/a-b/fees.php", "https://x.org/", "nonsense") == ["Home > A B > Fees", "Home", "Home"]
    assert one(spark, tx.file_title, "https://x.org/my_file-name.pdf") == ["My File Name"]
    assert one(spark, tx.attachment_title, "https://x.org/3cce6efe_fee%20list.pdf") == ["fee list (PDF)"]
    assert one(spark, tx.slug, "  New Name & Space!! ") == ["new-name-space"]


def sections_of(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return [(r.heading, r.content) for r in ch.split_sections(df).orderBy("section_no").collect()]


def test_sections(spark):
    assert sections_of(spark, "intro\n# One\nbody one\n## Two\n\nbody two\n### Bare") == [
        ("intro", "intro"), ("One", "body one"), ("Two", "body two"), ("Bare", "Bare")]
    assert sections_of(spark, "ADMISSION RULES\ntext here\nFEE TABLE\nmore") == [("ADMISSION RULES", "text here"), ("FEE TABLE", "more")]
    assert sections_of(spark, "no heading at all") == [("", "no heading at all")]


def packed_in_python(text, target=2000, least=80):
    """Straight statement of the packing rule for texts without headings."""
    def flush(done, cur):
        return done + [cur.strip()] if len(cur.strip()) >= least else done

    def fill(units, joiner, split):
        done, cur = [], ""
        for u in units:
            if len(cur) + len(u) <= target:
                cur = cur + (joiner if cur else "") + u
            else:
                done = flush(done, cur)
                cur = u
                if split and len(u) > target:
                    done, cur = done + fill(sentences(u), " ", False), ""
        return flush(done, cur)

    def sentences(p):
        found = re.findall(r"[^.!?]+(?:[.!?](?!\s+[a-z])[^.!?]*)*[.!?]*", p) or [p]
        return [s.strip() for s in found if s.strip()]
    if len(text.strip()) <= target:
        return [text.strip()]
    return fill([p.strip() for p in re.split(r"\n{2,}", text) if len(p.strip()) >= 5], "\n\n", True)


PARAGRAPHS = ["p" * 1999, "q" * 2000, "r" * 2001, "s" * 79, "t" * 80, "word " * 300, "one. two three. Four five. six " * 90]


@pytest.mark.parametrize("pick", [(0, 3), (1, 4, 4), (2, 5), (6, 3, 5), (5, 5, 5), (4,), (6, 6), (3, 0, 2, 6)])
def test_packing(spark, pick):
    text = "\n\n".join(PARAGRAPHS[i].strip() for i in pick)
    df = spark.createDataFrame([(text,)], "text string")
    parts = ch.section_chunks(F.array(F.struct(F.lit("").alias("heading"), F.col("text").alias("content"))))
    got = [r["text"] for r in df.select(parts.alias("c")).first()["c"]]
    assert got == packed_in_python(text)


def test_overlap_and_counts(spark):
    body = "\n\n".join(f"{c * 1500}" for c in "abc")
    rows = ch.semantic_chunks(spark.createDataFrame([(1, body), (2, "short"), (3, None)], "doc_id int, text string")).orderBy("chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.total_chunks) for r in rows] == [(1, 0, 3), (1, 1, 3), (1, 2, 3)]
    assert rows[1].content == "[...continued]\n" + "a" * 600 + "\n\n" + "b" * 1500


@pytest.mark.parametrize("size,kept", [(79, 0), (80, 1), (81, 1)])
def test_short_texts(spark, size, kept):
    assert ch.semantic_chunks(spark.createDataFrame([(1, "x" * size)], "doc_id int, text string")).count() == kept


def test_paged_numbering(spark):
    pages = [("d", p, "\n\n".join(f"{chr(97 + p + i) * 1500}" for i in range(p))) for p in (1, 2, 3)] + [("e", 1, "z" * 100)]
    rows = ch.chunk_paged_documents(spark.createDataFrame(pages, "doc_id string, page_no int, text string"))
    got = sorted((r.doc_id, r.chunk_index, r.page_number, r.total_chunks) for r in rows.collect())
    assert got == [("d", 0, 1, 6), ("d", 1, 2, 6), ("d", 2, 2, 6), ("d", 3, 3, 6), ("d", 4, 3, 6), ("d", 5, 3, 6), ("e", 0, 1, 1)]


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=60))
def test_shingles_match_python(spark, text):
    got = one(spark, tx.shingles, text)[0]
    low = text.lower()
    assert set(got) == {low[i:i + 5] for i in range(len(low) - 4)}


PAGE = """<html><head><title>Site | T</title></head><body><nav><p>menu menu menu</p></nav><div class="sidebar">side bar text</div>
<ul><li><a href="https://facebook.com/x">follow us on the net</a></ul>
<main><h1>Main heading</h1><p>First paragraph here<p>Second <b>paragraph here<ul><li>Item number one<li>Item number two</ul>
<table><tr><th>Header cell<td>Value cell 1</table><h4>Minor heading</h4><p>short</p><p>First paragraph here</p></main><footer>foot foot foot</footer></body></html>"""


def test_page_blocks(spark):
    row = hm.extract_pages(spark.createDataFrame([(1, PAGE)], "page_id int, html string")).first()
    assert row.title == "Main heading"
    assert [(b.tag, b.text) for b in row.blocks] == [
        ("h1", "Main heading"), ("p", "First paragraph here"), ("p", "Second paragraph here"), ("li", "Item number one"), ("li", "Item number two"),
        ("th", "Header cell"), ("td", "Value cell 1"), ("h4", "Minor heading")]
    assert row.content.startswith("## Main heading\n\nFirst paragraph here\nSecond paragraph here\n• Item number one")
    assert "| Value cell 1" in row.content and "### Minor heading" in row.content


def test_profile(spark):
    page = """<body><h4>Jo Doe</h4><table><tr><td>Designation: Senior Lecturer</tr><tr><td>Department: Physics</tr></table><p>Mail jo.doe@x.org</p>
<p>Phone 091-1234567</p><div><h3>Education</h3></div><p>PhD in Physics</p><p>MSc in Physics</p></body>"""
    row = hm.extract_profile(spark.createDataFrame([("u", page)], "url string, html string")).first()
    assert (row.name, row.email, row.phone, row.designation, row.department) == ("Jo Doe", "jo.doe@x.org", "091-1234567", "Senior Lecturer", "Physics")
    assert "## Education\nPhD in Physics\nMSc in Physics" in row.content


def test_links_of_real_markup(spark):
    html = """<a class=x href=/plain>1</a><A HREF='q?a=1&amp;utm_source=m&amp;b=2'>2</A><!-- <a href="/hidden">no</a> --><a href="../up/./x/">3</a><a href="../../../../far">4</a><a href="mailto:a@b.c">5</a>"""
    rows = hm.extract_links(spark.createDataFrame([(1, "https://X.org/a/b/c.html", html)], "page_id int, url string, html string")).orderBy("link_no").collect()
    assert [r.link for r in rows] == ["https://x.org/plain", "https://x.org/a/b/q?a=1&b=2", "https://x.org/a/up/x", "https://x.org/far", None]


def test_pages_fail_alone(spark):
    deep = "<div>" * 3000 + "<p>Some text deep inside</p>"
    rows = [(1, deep), (2, "<![foo bar]><p>More text than ten</p>"), (3, "<body><p>A plain page of text</p></body>"), (4, None), (5, "<b>" * 2500 + "bold words here")]
    got = {r.page_id: r for r in hm.extract_pages(spark.createDataFrame(rows, "page_id int, html string")).collect()}
    assert got[1].content == "Some text deep inside" and got[3].content == "A plain page of text" and got[4].content == "" and got[5].problem is None
    assert got[2].problem is not None or got[2].content == "More text than ten"
    status = {r.page_id: r.status for r in admit_pages(hm.extract_pages(spark.createDataFrame(rows, "page_id int, html string")), min_html=1, min_text=1).collect()}
    assert status[3] == "accepted" and status[2] == ("failed" if got[2].problem else "accepted")


def test_admission(spark):
    pages = spark.createDataFrame([("h" * 199, "t" * 60), ("h" * 200, "t" * 49), ("h" * 200, "t" * 50), (None, None)], "html string, content string")
    assert [r.reason for r in admit_pages(pages).collect()] == ["insufficient_html", "insufficient_text", None, "insufficient_html"]


def test_page_classes(spark):
    rows = [("https://x.org/profile.php?id=1", "T", "computer science"), ("https://x.org/alumni", "", ""), ("https://x.org/", "Fee table", ""),
            ("https://x.org/", "", "a lecturer of pharmacy"), ("https://x.org/", "", "nothing")]
    df = spark.createDataFrame(rows, "u string, t string, c string")
    got = [tuple(r[0]) for r in df.select(rl.classify_page(F.col("u"), F.col("t"), F.col("c"))).collect()]
    assert got == [("faculty", "Faculty", "cs_it"), ("alumni", "Alumni", "general"), ("academic", "Finance", "general"), ("faculty", "Faculty", "pharmacy"),
                   ("general", "General", "general")]
    assert one(spark, rl.namespace_of, "Policy", "policies", None, "CS & IT") == ["policies", "general", "general", "dept-cs"]


def test_markup_is_read_in_lots(monkeypatch):
    """Only a few pages of a batch are Python objects at once; the tokens are the same."""
    import pyarrow as pa

    from loamgrid.operators import markup as mk
    lots, read = [], mk._read_lot
    monkeypatch.setattr(mk, "_read_lot", lambda pages: lots.append(len(pages)) or read(pages))
    pages = pa.array(["<p class=x>one<li>two", None, ""] * 70)
    assert mk.markup_tokens.func(pages).equals(read(pages)) and sum(lots) == len(pages) and max(lots) <= mk.LOT_PAGES
    assert len(mk.markup_tokens.func(pages[:0])) == 0


def test_needed_words_of_patterns():
    """Patterns in brackets are tried only where a word they need occurs (they were tried on every text)."""
    assert rl.alternatives(r"a(b|c)?d|[|]x|e\|f\(|g") == [r"a(b|c)?d", "[|]x", r"e\|f\(", "g"]
    assert rl.needed_words(r"\bexam(ination)?s?\b") == ["exam"] and rl.needed_words("re-?checking") == ["checking"]
    assert rl.needed_words(r"\b(bba|business\s+admin)\b") == ["bba", "business"] and rl.needed_words(r"financial[\s.-]?aid") == ["financial"]
    assert rl.needed_words("(a|b)") == rl.needed_words("(a(b|c))d") == rl.needed_words("x{0}y") == rl.needed_words(r"\d+") == []
    assert rl.needed_words("colou?rs") == ["colo"] and rl.needed_words("ab*cde") == ["cde"] and rl.needed_words("abc+d") == ["abc"]


def test_matches_equals_the_whole_pattern(spark):
    import loamgrid.functions.vocabulary as vocabulary
    texts = ["", "exams are held", "reexamined", "re-checking", "the bba program", "xbba", "it is", "digit", "business  admin", "businessadmin", "financial-aid", "financialaid", "financial  aid",
             "need based", "pharmd", "d.pharm", "dxpharm", "nursing", "merit \n award", "cost of", "answer\tsheet", "exam_", "éexamé", "mba\n", "news  letter", "code of conduct"]
    df = spark.createDataFrame([(x,) for x in texts], "low string").coalesce(1)
    patterns = [r.pattern for r in (*vocabulary.CHUNK_RULES, *vocabulary.PAGE_RULES, *vocabulary.ROUTING_RULES, *vocabulary.PROFILE_DEPARTMENTS)] + [vocabulary.PROFILE_PATTERN]
    got = df.select(F.array(*[rl.matches(F.col("low"), p) for p in patterns]), F.array(*[F.col("low").rlike("(?i)" + rl.ascii_words(p)) for p in patterns])).collect()
    assert all(row[0] == row[1] for row in got)


def test_keywords_stay_in_the_row(spark, monkeypatch):
    """Ranks by weight, words before pairs, then first use; no text is shuffled, and lots of texts change nothing."""
    from loamgrid.operators import chunking as ch
    texts = [(1, "Tuition fees and tuition waiver 2024: tuition-fees"), (2, None), (3, ""), (4, "the and 12345 abc"), (5, "exam results exam results"), (6, "solo"), (7, "x" * 20 + " " + "y" * 20)]
    df = spark.createDataFrame(texts, "id long, content string")
    want = {(1, 1, "tuition", 2.0), (1, 2, "tuition fees", 1.5), (1, 3, "fees tuition", 1.5), (1, 4, "tuition waiver", 1.5), (1, 5, "waiver tuition-fees", 1.5), (1, 6, "fees", 1.0),
            (1, 7, "waiver", 1.0), (1, 8, "tuition-fees", 1.0), (5, 1, "exam results", 3.0), (5, 2, "exam", 2.0), (5, 3, "results", 2.0), (5, 4, "results exam", 1.5), (6, 1, "solo", 1.0),
            (7, 1, "x" * 20, 1.0), (7, 2, "y" * 20, 1.0)}
    for lot in (1, 4, 1_000_000):
        monkeypatch.setattr(ch, "LOT_WORDS", lot)
        found = ch.keywords(df)
        assert {tuple(r) for r in found.collect()} == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    lists = {r.id: r.keywords for r in ch.with_keywords(df).collect()}
    assert lists[2] is lists[3] is lists[4] is None and lists[5] == ["exam results", "exam", "results", "results exam"] and ch.keywords(df.where("id < 0")).count() == 0


def test_page_chunks_read_each_page_once(spark):
    """The markup is read by one Python step: chunks are not made a second time for their keywords."""
    from loamgrid.plans.ingest import page_chunks
    pages = spark.createDataFrame([(1, "https://a.org/x", "<html></html>")], "page_id long, url string, html string")
    plan = page_chunks(pages, drop_repeats=False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapIn") + plan.count("LogicalRDD") <= 2 and "Join" not in plan
