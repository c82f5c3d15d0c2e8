"""Cases that an earlier form of the operators left out."""

import random
from collections import Counter

import pytest

from briefwerk.llm import decontaminate, html, jaccard, personal

from .data import docs, rows_of, words


def kept_texts(frame):
    return Counter((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect())


# ---------------------------------------------------------------- decontamination


def test_clean_rows_outlive_a_contaminated_namesake(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    benchmark = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    bad = [(None, f"see {passage} here", "en", "a"), (5, f"and {passage}", "en", "a"), (5, passage, "de", "b"), (6, passage, "en", "a")]
    good = [(None, "clean and short", "en", "a"), (None, "clean too", "en", "a"), (None, None, None, None), (5, "a clean namesake", "en", "a")]
    good += [(5, "a clean namesake", "en", "a"), (7, "", "en", "a")]
    left = decontaminate.decontaminated(docs(spark, bad + good + bad), benchmark)
    assert kept_texts(left) == Counter((i, t) for i, t, _, _ in good)


def test_items_without_an_id_are_searched_as_the_sql_does(spark, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(6)
    long = words(rng, 15)
    items = [(None, "two words"), (None, long), (3, "two words"), (4, words(rng, 12)), (None, None), (5, None)]
    texts = ["here are two words in it", f"begin {long} end", "nothing at all", long[:20], f"{items[3][1]} and two words", None, ""]
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "table", lambda _s, _d, name: docs(spark, rows) if name == "documents" else benchmark)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = rows_of(decontaminate.op8_decontaminate(spark, ""), *names)
    with duckdb.connect() as con:
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
        con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
        want = con.execute(f"SELECT {', '.join(names)} FROM ({decontaminate.OP8_SQL}) ORDER BY doc_id").fetchall()
    assert got == want
    assert [r[2] for r in got] == [2, 15, 0, 0, 14, 0, 0] and got[1][3] == 1
    left = decontaminate.decontaminated(docs(spark, rows), benchmark)
    assert kept_texts(left) == Counter(rows[k][:2] for k in (2, 3, 5, 6))


# ---------------------------------------------------------------- near-duplicates


def test_one_row_of_each_class_stays(spark):
    rng = random.Random(2)
    a, b, c, d = (words(rng, 80) for _ in range(4))
    lonely = [(None, "a lonely text without any id or namesake", "en", "a"), (None, "", "en", "a"), (None, None, None, None), (20, "!!", "en", "a")]
    rows = [(None, a, "en", "a"), (None, f"{a} x", "en", "a"), (None, f"{a} y", "en", "a"), (3, f"{a} z", "en", "a")]  # ids beside none
    rows += [(None, b, "en", "a"), (None, f"{b} x", "en", "a")]  # no id at all
    rows += [(9, words(rng, 50), "en", "a"), (9, c, "en", "a"), (8, f"{c} x", "en", "a")]  # an id with two texts
    rows += [(6, d, "en", "a")] * 3 + [(7, d, "en", "a")] * 2  # exact copies
    left = kept_texts(jaccard.deduplicated(docs(spark, lonely * 2 + rows)))
    want = Counter({(i, t): 2 for i, t, _, _ in lonely[1:]})
    want += Counter([lonely[0][:2], (3, f"{a} z"), rows[6][:2], (8, f"{c} x"), (6, d)])
    without = [k for k in left if k[0] is None and k[1] in (b, f"{b} x")]
    assert len(without) == 1 and left[without[0]] == 1
    assert left == want + Counter(without)
    marks = jaccard.near_duplicates(docs(spark, rows)).where("kept").groupBy("class_id").count().collect()
    assert sorted((r["class_id"] or 0, r["count"]) for r in marks) == [(0, 1), (3, 1), (6, 1), (8, 1), (9, 1)]


# ---------------------------------------------------------------- personal data


def offered(text):
    return [text[s:e] for k, s, e, _ in personal.strings(text, personal.base_spans(text)) if k < 0]


def test_candidates_have_every_form():
    for value in ("030 555 1234", "(743) 555-3824", "+(49) 30/555.1234", "4111 1111 1111 1112", "030/5551234", "anna@firma", "a@b", "anna at firma dot de",
                  "anna (at) firma [dot] de", "anna [at] firma.de", "7f" * 50, "AB12-99"):
        assert offered(f"so it is {value} and more") == [value], value
    assert offered("AB12 555 1234 5th we met at firma.de") == ["AB12", "555 1234"]
    assert offered("10.0.0.1 " * 30 + "5551234") == ["5551234"]
    for text in ("a at " * 60_000, "1 (a " * 50_000, "a at b dot " * 30_000, "1 1a " * 50_000, "+1 " * 60_000, "10.0.0.1 " * 30_000):
        list(personal.strings(text, personal.base_spans(text)))


def test_a_cue_word_is_enough_among_varying_neighbours(spark):
    rng = random.Random(4)
    rows = [(k, f"{words(rng, 6)} Tel: +49 30 555{rng.randrange(1000, 9999)} {words(rng, 5)}", "en", "a") for k in range(20)]
    rows += [(20 + k, f"{words(rng, 6)} Email: n{rng.randrange(10**6)}@firma{k}.de {words(rng, 5)}", "en", "a") for k in range(20)]
    rows += [(40 + k, f"{words(rng, 6)} Card: 4111 1111 1111 1111 {words(rng, 5)} Card: {n} {words(rng, 3)}", "en", "a") for k, n in enumerate(
        ("5500 0000 0000 0004", "3400 0000 0000 009", "6011 0000 0000 0004", "3000 0000 0000 04", "4012 8888 8888 1881", "4222 2222 2222 2"))]
    open_ = {100: ("Tel:", "030 555 1234", "phone"), 101: ("Tel:", "(743) 555-3824", "phone"), 102: ("Email:", "anna@firma", "email"),
             103: ("Email:", "anna at firma dot de", "email"), 104: ("Card:", "4111 1111 1111 1112", "card"), 105: ("Email:", "n" * 90 + "@firma", "email")}
    for i, (cue, value, _) in open_.items():
        rows.append((i, f"so {i} {cue} {value} bye {i}x", "en", "a"))
    texts = {r.doc_id: r.text for r in personal.masked(docs(spark, rows)).collect()}
    for i, (cue, _, kind) in open_.items():
        assert texts[i] == f"so {i} {cue} <{kind}> bye {i}x"


# ---------------------------------------------------------------- pages


def test_odd_tags_drop_no_text():
    more = "<p>More text, here, of the page.</p>"
    for start, text in {
        "<p title=it's>Hello</p>": "Hello", "<p data-x=\"5\" tall\">Hello</p>": "Hello", "<p title=\"x > y\" class='a'>Hello</p>": "Hello",
        "<p title=it's>Hello</p><p>it's on</p>": "Hello\nit's on", "<p title=\"open>Hello</p>": "Hello", "<p>a<label>b</p>": "ab", "<p>a<button>b</p>": "a\nb",
        "<p>a<select><option>b</p>": "a\nb", "<p>a<object>b</p>": "ab", "<p>a<label>b</p><p><label>gone</label>c</p>": "ab\nc",
        "<p>a<svg/>b</p>": "ab", "<p>a<svg><text>gone</text></svg>b</p>": "ab", "<p>a<math/>b</p>": "ab", "<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p>": "a x=2",
        "<p>a<object><object>gone</object>gone</object>b</p>": "ab", "<p>a<script>if (a < b) gone</script>b</p>": "ab", "<p>a<!-- <label> -->b</p>": "ab",
    }.items():
        assert html.Page(f"<article>{start}{more}</article>").text() == f"{text}\nMore text, here, of the page.", start
    assert html.Page("<article><p>a</p><script>gone").text() == "a"
    for source in ("<object>" * 100_000, "<label>a" * 100_000, "<a b=\"" * 50_000, "<a b='x>" * 50_000, "<svg" * 100_000):
        html.Page(source).text()


def test_names_of_wrappers_leave_no_article_out():
    body = "<h1>The title</h1><p>First paragraph, with some words, and more of them here.</p><p>Second paragraph, with some words, too.</p>"
    text = "The title\nFirst paragraph, with some words, and more of them here.\nSecond paragraph, with some words, too."
    side = '<div class="sidebar"><p>Beside it, some words, that nobody asked for.</p></div><div id="comments"><p>So good, really.</p></div>'
    for page in (
        f'<div class="content-sidebar-wrap"><main>{body}</main>{side}</div>', f'<div class="has-sidebar"><article>{body}</article></div>{side}',
        f'<div class="no-comments"><div class="x">{body}</div></div>{side}', f'<form id="search-form"><div class="x">{body}</div>{side}</form>',
        f'<div class="elementor-widget">{body}</div>{side}', f'<div class="related-wrap"><div class="sidebar-content">{body}</div>{side}</div>',
        f'<article>{body}<div class="related"><p>Other texts, of us.</p></div></article><div class="related"><article><p>Teaser.</p></article></div>',
    ):
        assert html.Page(f"<body>{page}</body>").text() == text, page
    # long letters of readers are no article
    assert html.Page(f'<body><div class="x">{body}</div><div id="comments">{"<p>So good, really, I mean it.</p>" * 30}</div></body>').text() == text


def test_headline_and_lead_outside_the_inner_container():
    inner = "".join(f"<p>Paragraph {k}, with some words, and more of them in here, too.</p>" for k in range(8))
    text = "\n".join(["The title", "The lead.", *(f"Paragraph {k}, with some words, and more of them in here, too." for k in range(8))])
    for outer in ("article", "main", 'div class="post"'):
        page = f'<body><{outer}><h1>The title</h1><p>The lead.</p><div class="entry-content">{inner}</div><div class="share">Share it</div></{outer.split()[0]}></body>'
        assert html.Page(page).text() == text, outer
        assert html.Page(page).text(html.Page(page).path(html.Page(page).best()[0])) == text
