import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking as ch
from lodestone.operators import cleaning, validation
from lodestone.sources import documents as src


def one(spark, column, t):
    return spark.createDataFrame([(t,)], "t string").select(column.alias("x")).first().x


def test_cleaning_strings(spark):
    t = F.col("t")
    assert one(spark, cleaning.join_hyphens(t), "require-\nments, well-known") == "requirements, well-known"
    assert one(spark, cleaning.unwrap(t), "one\ntwo more.\nthree\n\n(a) four\nfive\n• six") == "one two more.\nthree\n\n(a) four five\n• six"
    assert one(spark, cleaning.clean(t), " a \t b\r\n\n\n\n\nc ") == "a b\n\nc"


def test_unwrap_against_a_fold(spark):
    def fold(text):
        out = []
        for line in text.split("\n"):
            s = line.strip()
            if s and out and out[-1] and not re.match(r"^([•\-–▪*]|\(?[a-z0-9]{1,3}[.)]|\d+(\.\d+)*\s)", s) and not out[-1].endswith((".", ":", ";")):
                out[-1] += " " + s
            else:
                out.append(s)
        return "\n".join(out)

    rnd = random.Random(1)
    texts = ["\n".join(rnd.choice(["", "  ", "word", "ends.", "a) item", "1.2 item", "- x", "more: "]) for _ in range(rnd.randint(1, 12))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cleaning.unwrap(F.col("t")).alias("x")).collect()
    assert all(r.x == fold(r.t) for r in rows)


def test_running_heads(spark):
    pages = [("d", i, f"Bank Guideline {i}\n" + "\n".join("body " + chr(96 + i) * (j + 1) for j in range(8)) + f"\nPage {i} of 7") for i in range(1, 8)] + [("e", i, "Head\nx") for i in (1, 2)]
    df = spark.createDataFrame(pages, "document_id string, page_number int, text string")
    found = cleaning.repeated_lines(df, 0.5)
    assert {(r.document_id, r.line) for r in found.collect()} == {("d", "bank guideline #"), ("d", "page # of #")}
    out = {(r.document_id, r.page_number): r.text for r in cleaning.remove_lines(df, found).collect()}
    assert out["d", 3].startswith("body c\n") and out["d", 3].endswith("body cccccccc") and out["e", 1] == "Head\nx"


def test_validation(spark):
    long = "Long enough text for a page that is kept by the checks, as it has more than eighty characters. "
    pages = [("a", 0, 1, long), ("a", 0, 2, "short"), ("a", 0, 3, long.upper()), ("b", 1, 1, long + "b"), ("c", 2, 1, "  " + long + " b"), ("c", 2, 2, ""), ("d", 3, 1, "tiny")]
    df = spark.createDataFrame(pages, "document_id string, doc_order int, page_number int, text string")
    status = {(r.document_id, r.page_number): r.status for r in validation.check_pages(df).collect()}
    assert status["a", 1] == "kept" and status["a", 2] == "near_empty" and status["a", 3] == "duplicate"
    checked, report = validation.ingest(df)
    r = report.first()
    assert (r.documents, r.duplicate_documents, r.pages_processed, r.near_empty_pages, r.failed_pages, r.empty_documents) == (4, 1, 5, 2, 0, 1)
    twin = spark.createDataFrame([*pages, ("z", 9, 1, (long + "b").lower())], df.schema)
    assert {r.document_id: r.same_as for r in validation.duplicate_documents(twin).collect()}["z"] == "b"
    assert "Pages processed: 5" in validation.summary(report)


def span(text, size=9.0, flags=0, font="Serif"):
    return [(text, size, flags, font)]


def test_line_kinds(spark):
    cases = [
        ("Outline of the harbour rules", span("x", 12.5), "heading"),
        ("Outline of the harbour rules", span("x", 10.9), "body"),
        ("Tide tables", span("x", 9.0, 16), "heading"),
        ("Tide tables", span("x", 9.0, 0, "Serif-BOLD"), "heading"),
        ("Tide tables", [("x", 9.0, 16, "Serif"), (" ", 9.0, 0, "Serif"), ("y", 9.0, 0, "Serif")], "body"),
        ("Tides rise; tides fall.", span("x", 20.0), "body"),
        ("Ebb", span("x", 20.0), "body"),
        ("w" * 111, span("x", 20.0), "body"),
        ("CHAPTER IV", span("x"), "marker"),
        ("Annex 7b", span("x"), "marker"),
        ("7.2", span("x", 9.0, 16), "marker"),
        ("7.2", span("x"), "body"),
        ("B.", span("x", 20.0), "body"),
    ]
    rows = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(cases)], "i int, t string, s array<struct<text: string, size: double, flags: int, font: string>>")
    got = {r.i: r.k for r in rows.select("i", src.classify(F.col("t"), F.col("s"), F.lit(9.0)).alias("k")).collect()}
    assert [got[i] for i in range(len(cases))] == [k for _, _, k in cases]


KINDS = {"h": (14.0, 0), "b": (9.0, 0)}


def page_of(spark, *lines):
    """A page of (block, kind, text) lines: h(eading), b(ody) or m(arker)."""
    filler = [("d", 9, 0, 0, span("plain body text " * 20), None)]
    rows = [("d", 1, block, i, span(text, *KINDS.get(kind, (9.0, 16))), None) for i, (block, kind, text) in enumerate(lines)]
    out = {r.page_number: r for r in src.page_lines(spark.createDataFrame(rows + filler, src.SPANS)).collect()}
    return out[1].text.split("\n"), out[1].headings


def test_markers_lead_headings_and_wait_for_them_across_blocks(spark):
    assert page_of(spark, (0, "m", "Section 3"), (1, "h", "Moorings *"), (2, "b", "They hold.")) == (["", "Section 3 Moorings", "", "", "They hold.", ""], ["Section 3 Moorings"])
    assert page_of(spark, (0, "m", "TITLE II"), (0, "m", "4."), (0, "h", "Buoys")) == (["", "TITLE II 4. Buoys", "", ""], ["TITLE II 4. Buoys"])


def test_markers_without_a_heading_stand_alone(spark):
    assert page_of(spark, (0, "m", "Article 5"), (0, "b", "Ships wait.")) == (["", "Article 5", "", "Ships wait.", ""], ["Article 5"])
    assert page_of(spark, (0, "b", "Ships wait."), (1, "m", "6.")) == (["Ships wait.", "", "", "6.", ""], [])


def test_headings_of_one_block_are_one(spark):
    assert page_of(spark, (0, "h", "Rules of the"), (0, "h", "inner harbour"), (0, "b", "Slow.")) == (["", "Rules of the inner harbour", "", "Slow.", ""], ["Rules of the inner harbour"])
    assert page_of(spark, (0, "h", "Rules of the"), (1, "h", "inner harbour"))[1] == ["Rules of the", "inner harbour"]
    assert page_of(spark, (0, "h", "Rules"), (0, "m", "2."), (1, "h", "Lights"))[1] == ["Rules 2. Lights"]


def test_a_blank_page_and_an_error(spark):
    rows = [("d", 1, 0, 0, span("  "), None), ("broken", None, None, None, None, "ValueError: encrypted")]
    spans = spark.createDataFrame(rows, src.SPANS)
    assert src.page_lines(spans).count() == 0
    assert [tuple(r) for r in src.parse_errors(spans).collect()] == [("broken", "ValueError: encrypted")]


def test_a_file_that_cannot_be_read_is_a_row(spark, tmp_path):
    (tmp_path / "good.bin").write_bytes(b"one line")
    (tmp_path / "bad.bin").write_bytes(b"!")

    def parse(content):
        if content == b"!":
            raise ValueError("no such format")
        yield 1, 0, 0, [{"text": content.decode(), "size": 9.0, "flags": 0, "font": "f"}]

    spans = src.read_spans(spark, str(tmp_path), parse)
    assert {r.document_id: r.error for r in spans.collect()} == {"good": None, "bad": "ValueError: no such format"}
    assert [r.text for r in src.page_lines(spans).collect()] == ["one line\n"]


def test_manifest(spark):
    row = {"document_id": "harbour_1", "title": "Harbour rules", "authority": "ESMA", "document_type": "opinion", "publication_date": "2019-11-30", "source_url": "https://example.com/h.pdf"}
    docs = src.manifest(spark, [row], {"harbour_1": {"sha256": "0a", "version": None}})
    assert docs.first().sha256 == "0a" and docs.first().language == "en"
    with pytest.raises(ValueError) as e:
        src.manifest(spark, [row, row, row | {"document_id": "Harbour-2", "document_type": "poem"}, {"document_id": "harbour_3"}])
    for part in ("harbour_1: duplicate", "Harbour-2: not a document id", "unknown document_type poem", "harbour_3: title is missing"):
        assert part in str(e.value)


def test_fetching(tmp_path):
    calls = []

    def get(url, agent):
        calls.append(agent)
        return b"%PDF-1" if agent.startswith("Mozilla") else b"<html>"

    target = str(tmp_path / "x.pdf")
    digest = src.fetch_pdf("https://example.com", target, get=get)
    assert len(calls) == 2 and src.fetch_pdf("https://example.com", target, digest, get) == digest and len(calls) == 2
    with pytest.raises(ValueError, match="not a PDF"):
        src.fetch_pdf("https://example.com", target, get=lambda u, a: b"no")


# ---- chunks

PAGES = "document_id string, pages array<struct<page_number: int, text: string, section: string, headings: array<string>>>"


def book(seed, pages=6):
    """Pages of short and long paragraphs, some of which begin with a heading of their page."""
    rnd = random.Random(seed)
    sentence = lambda: " ".join(["Boats", *(rnd.choice(["sea", "wind", "tide", "rope"]) for _ in range(rnd.randint(1, 14)))]) + rnd.choice(".!?;")
    out = []
    for n in range(1, pages + 1):
        heads = [f"Part {n}.{k} of the log" for k in range(rnd.randint(0, 2))]
        paras = [" ".join(sentence() for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(0, 4))]
        for h in heads:
            paras.insert(rnd.randint(0, len(paras)), rnd.choice([h, h + " and more"]))
        out.append({"page_number": n, "text": "\n".join(rnd.choice([p, " " + p, p + "\n"]) for p in paras), "section": rnd.choice([None, f"Given {n}"]), "headings": heads})
    return out


def paragraphs(pages):
    """Brute force: (text, page, section)."""
    out, now = [], None
    for p in pages:
        now = now if now is not None else p["section"]
        for t in filter(None, (x.strip() for x in p["text"].split("\n"))):
            now = next((h for h in p["headings"] if t.startswith(h)), now)
            out.append((t, p["page_number"], now))
    return out


@pytest.fixture(scope="module")
def books(spark):
    made = {f"b{i}": book(i) for i in range(12)}
    rows = [(k, random.Random(1).sample(v, len(v))) for k, v in made.items()]
    return made, spark.createDataFrame([*rows, ("none", []), ("null", None)], PAGES)


def test_paragraphs_and_their_sections(books):
    made, df = books
    got = {}
    for r in ch.units(df).orderBy("document_id", "ord").collect():
        assert r.ord == len(got.setdefault(r.document_id, [])) and r.tokens == len(r.text.split())
        got[r.document_id].append((r.text, r.page, r.section))
    assert got == {k: paragraphs(v) for k, v in made.items() if paragraphs(v)}


def test_pieces_of_long_paragraphs(spark):
    text = 'One two three. Four five! (Six) seven; "Eight nine ten eleven twelve thirteen fourteen" Not. lower here.'
    df = spark.createDataFrame([("d", 0, text, 1, "s", 18), ("d", 1, "short one.  Here", 1, "s", 3)], "document_id string, ord int, text string, page int, section string, tokens int")
    got = [(r.ord, r.sub, r.text, r.tokens) for r in ch.split_long(df, 5).orderBy("ord", "sub").collect()]
    assert got == [
        (0, 0, "One two three.", 3), (0, 1, "Four five!", 2), (0, 2, "(Six) seven;", 2), (0, 3, '"Eight nine ten eleven twelve', 5),
        (0, 4, 'thirteen fourteen" Not. lower here.', 5), (1, 0, "short one.  Here", 3),
    ]


def test_fixed_windows(books):
    made, df = books
    for most, overlap in ((10, 3), (1000, 10), (7, 0), (5, 9)):
        got = {}
        for r in ch.chunk(df, "fixed", ch.Sizes(most, overlap)).orderBy("document_id", "position").collect():
            assert r.chunk_id == f"{r.document_id}:fixed:{r.position:05d}" and r.position == len(got.setdefault(r.document_id, []))
            got[r.document_id].append((r.text, r.section, r.page_start, r.page_end, r.token_count))
        for k, pages in made.items():
            words = [(w, p, s) for t, p, s in paragraphs(pages) for w in t.split()]
            step = max(1, most - overlap)
            count = 1 + max(0, -(-(len(words) - most) // step))
            want = [words[i * step : i * step + most] for i in range(count if words else 0)]
            assert got.get(k, []) == [(" ".join(w for w, _, _ in x), x[0][2], x[0][1], max(p for _, p, _ in x), len(x)) for x in want]


def test_packing():
    rnd = random.Random(8)
    assert ch.packed(np.array([4, 4, 4, 10, 2]), 9, 4) == [(0, 2), (1, 3), (2, 4), (4, 5)]
    for _ in range(500):
        counts = np.array([rnd.randint(0, 9) for _ in range(rnd.randint(0, 25))])
        runs = ch.packed(counts, 15, 6)
        assert [i for n, (a, b) in enumerate(runs) for i in range(runs[n - 1][1] if n else 0, b)] == list(range(len(counts)))
        for (a, b), (c, _) in zip(runs, runs[1:]):
            assert counts[a:b].sum() <= 21 and counts[a:b].sum() + counts[b] > 15  # full before it ends
            assert counts[c:b].sum() <= 6 and (c == a or counts[c - 1 : b].sum() > 6)  # as much as the overlap holds


def test_small_sections_are_merged():
    assert ch.sections(np.array([3, 4, 50, 5, 5]), ["a", "b", "c", "d", "d"], 60) == [(0, 3), (3, 5)]
    assert ch.sections(np.array([3, 58, 30, 1]), ["a", "b", "c", None], 60) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert ch.sections(np.array([], int), [], 60) == []


@pytest.mark.parametrize("strategy", ["recursive", "section", "parent_child"])
def test_packed_chunks(books, strategy):
    made, df = books
    sizes = ch.Sizes(24, 6, 10)
    most = 10 if strategy == "parent_child" else 24
    rows = ch.chunk(df, strategy, sizes).orderBy("document_id", "position").collect()
    assert {r.document_id for r in rows} == {k for k, v in made.items() if paragraphs(v)}
    for k, pages in made.items():
        mine = [r for r in rows if r.document_id == k]
        assert [r.chunk_id for r in mine] == [f"{k}:{strategy}:{i:05d}" for i in range(len(mine))]
        texts = [t for t, _, _ in paragraphs(pages)]
        page_of = {t: p for t, p, _ in paragraphs(pages) if texts.count(t) == 1 and " " in t and not any(t in x for x in texts if x != t)}
        for r in mine:
            assert r.token_count == len(r.text.split()) <= most + 6 and r.page_start <= r.page_end
            assert all(r.page_start <= page_of[t] <= r.page_end for t in r.text.split("\n") if t in page_of)
            if strategy == "parent_child":
                assert r.text in r.parent_text and r.parent_id.startswith(f"{k}:parent:") and len(r.parent_text.split()) <= 48
        # every word is in some chunk, in order
        text = " ".join(t for t, _, _ in paragraphs(pages)).split()
        assert set(text) == {w for r in mine for w in r.text.split()}
        if strategy == "section":
            names = [s for _, _, s in paragraphs(pages)]
            assert {r.section for r in mine} <= set(names) and (not mine or mine[0].section == next((s for s in names if s), None) or names[0] is None)


def test_sections_carry_over(spark):
    pages = [(1, "", None, ["A", "B"]), (2, "", None, []), (3, "", None, ["C"]), (4, "", None, [])]
    docs = spark.createDataFrame([("d", pages), ("e", [(1, "", None, [])])], PAGES)
    got = {r.document_id: [p.section for p in r.pages] for r in ch.carry_sections(docs).collect()}
    assert got == {"d": ["A", "B", "C", "C"], "e": [None]}
