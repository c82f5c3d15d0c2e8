"""Language, quality, toxicity, tokens, personal data, pages and mixtures: brute force, round trips, held-out accuracy."""

import hashlib
import html as entities
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from briefwerk.llm import html, language, mixture, personal, quality, tokens, toxicity

from .data import docs, rows_of, words

SF = Path("/root/testdata/sf0.01")
ODD = [(9001, None, None, None), (9002, "", "en", "a"), (9003, "?! 12 --", "en", "a"), (9004, "x " * 60_000, "en", "a"), (9005, "Ü", None, "b")]
STEMS = {"aa": ["lor", "ipsum", "dolor", "amet"], "bb": ["zwisch", "kraut", "stein", "pfad"], "cc": ["ñand", "quell", "tierra", "rojo"]}


def rest(doc_id, of):
    return zlib.crc32(str(doc_id).encode()) % of


def invented(rng, lang, n):
    return " ".join(rng.choice(STEMS[lang]) + rng.choice(["", "a", "en", "is"]) for _ in range(n))


# ---------------------------------------------------------------- op 1


def test_language_held_out(spark):
    rng = random.Random(1)
    rows = [(k, invented(rng, lang, rng.randrange(5, 80)), lang, "s") for k, lang in enumerate(["aa", "bb", "cc"] * 60)]
    # the text that is far from all others is not one of those that are learned from
    rows += [(i, t, None if i == 9004 else g, s) for i, t, g, s in ODD] + [(9006, rows[0][1], "aa", "s")] * 2
    frame = docs(spark, rows)
    found = {r.doc_id: r for r in language.identify(frame, language.fit(frame)).collect()}
    assert len(found) == len({r[0] for r in rows})
    want = {r[0]: r[2] for r in rows if r[0] < 9000}
    assert all(found[i].nearest == lang for i, lang in want.items() if rest(i, 4) == 2)
    for i in (9001, 9002, 9003):
        assert (found[i].lang, found[i].nearest, found[i].score) == ("und", "und", 0.0)
    assert all(0 <= r.score <= 1 for r in found.values())
    assert found[9004].rejected and found[9004].lang == "und"  # at a distance from all


def test_language_learns_only_from_its_fold(spark):
    rng = random.Random(2)
    rows = [(k, invented(rng, "aa", 30), "aa", "s") for k in range(80)]
    swapped = [(i, t, "zz" if rest(i, 4) == 2 else g, s) for i, t, g, s in rows]
    assert language.fit(docs(spark, swapped)).names == ["aa"]


def test_samples_stay_bounded_where_one_id_has_many_rows(spark):
    rng = random.Random(2)
    rows = [(7 if k % 3 == 0 else 100 + k, invented(rng, "aa", 9), "aa", "s") for k in range(900)] + [(7, "the same lor ipsum", "aa", "s")] * 300
    frame = docs(spark, rows)
    labels = spark.createDataFrame([(i, 1) for i in {r[0] for r in rows}], "doc_id bigint, quality int")
    seen = quality.sampled(frame, labels, "quality", 4, 2, {1: 1.0}).count()
    assert seen == len({r[0] for r in rows if rest(r[0], 4) != 2})
    model = language.fit(frame, sample=60)
    assert model.names == ["aa"]


def test_language_without_anything_to_learn(spark):
    assert language.fit(docs(spark, [])).names == []
    (row,) = language.identify(docs(spark, [(1, "abc", None, "a")]), language.fit(docs(spark, []))).collect()
    assert (row.nearest, row.score) == ("und", 0.0)


# ---------------------------------------------------------------- op 2

PAGE = (
    '<html><head><title>T</title><style>p{{}}</style></head><body class="x{n}"><nav><ul><li><a href="/">Home, and more</a></ul></nav>'
    '<div class="cookie-notice">We use cookies, many of them, on all our pages.</div><header><p>Site header, always the same one</p></header>'
    '<div class="wrap w{n}"><div class="post-body"><h1>Title &amp; {n}</h1><p>First paragraph, with   some\nwords, and more.<p>Second &eacute; one<br>goes on'
    '<div class="ad">Buy this, now, cheap, here.</div><ul><li>one<li>two</ul><form><input name="q">Search, please</form>'
    '<div id="comments"><p>I liked this a lot, really, a lot, it was good, thanks.</p></div></div>'
    '<aside>Related, things, to, read, after, this, one</aside></div><footer>&copy; all, rights, reserved</footer><script>if (a < b) "</p>"</script>'
)
TEXT = "Title & {n}\nFirst paragraph, with some words, and more.\nSecond é one goes on\none\ntwo"


def test_pages_by_consensus(spark):
    rows = [(k, f"https://Site.example.org:80/{k}", PAGE.format(n=k)) for k in range(12)]
    # a page whose own best container would be another one
    long = '<div class="box">' + "<p>Very long text, beside the article, and longer than it is.</p>" * 9 + "</div>"
    rows.append((50, "http://user@site.example.org/odd", PAGE.format(n=50).replace("<aside>", long + "<aside>")))
    rows += [(60, None, PAGE.format(n=60)), (61, "x", None), (62, "http://a.b/", ""), (63, "http://a.b/", "plain &lt;text"), (64, "http://a.b/", "<p>cut <a href='x")]
    rows += [(65, "http://a.b/c", "<article><p>Some text, here, for you.</p></article>")] * 2
    frame = spark.createDataFrame([(*r, "t", "v") for r in rows], "page_id bigint, url string, html string, text string, _path string")
    got = rows_of(html.extract(frame), "page_id", "url", "text", "n_chars")
    want = {k: TEXT.format(n=k) for k in [*range(12), 50, 60]}
    want |= {61: "", 62: "", 63: "plain <text", 64: "cut", 65: "Some text, here, for you."}
    assert len(got) == len(rows)
    for page_id, url, text, n_chars in got:
        assert text == want[page_id], page_id
        assert n_chars == len(text) and (page_id, url) in [(r[0], r[1]) for r in rows]
    assert html.extract(frame.limit(0)).count() == 0


@pytest.mark.skipif(not SF.exists(), reason="needs the given tables")
def test_pages_equal_a_plain_reading_of_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html.op2_html(spark, str(SF)).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1)>", "\0", inner.replace("<br>", " "))).split("\0")
        assert got[r.page_id] == "\n".join(x for x in (" ".join(entities.unescape(p).split()) for p in parts) if x)


# ---------------------------------------------------------------- op 3

RULES = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_spans(text):
    out = []
    for kind, rule in enumerate(RULES):
        for m in rule.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = (
                True, kind == 1 and all(int(p) <= 255 for p in m.group().split(".")),
                12 <= len(digits) <= 19 and personal.luhn(digits), 9 <= len(digits) <= 15,
            )[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_fixed_rules_equal_plain_regular_expressions():
    rng = random.Random(6)
    bits = ["a", "Z9", "@", ".", "x@y.de", "1", "22", "255.1.2.3", "256", "4111 1111 1111 1111", "4111-1111", "+", "+49 (0)30 123-456", " ", "-", "é", "%", "😀", "0012"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 25)))
        assert personal.base_spans(text) == plain_spans(text), text


def test_long_runs_take_no_retries():
    for text in ("1" * 300_000, "a" * 300_000, "1." * 100_000, "a@" * 100_000, "+1 " * 60_000, "1 " * 100_000, "@" * 100_000):
        personal.base_spans(text)
        list(personal.strings(text, []))


def test_contexts_discover_unseen_identifiers(spark):
    rng = random.Random(7)
    rows = [(k, f"{words(rng, 6)} my phone is +49 30 555{rng.randrange(1000, 9999)} {words(rng, 5)}", "en", "a") for k in range(20)]
    rows += [(100, "so my phone is 030/5551234 thanks", "en", "a"), (101, "paid 030/5551234 in all", "en", "a"), (102, "my phone is off", "en", "a")]
    rows += [(103, "héé my phone is 030/5559999", "en", "a")] * 2 + ODD
    found = personal.personal_spans(docs(spark, rows))
    by_id = defaultdict(list)
    for r in found.collect():
        by_id[r.doc_id].append([tuple(s) for s in r.added])
    assert by_id[100] == [[(3, 15, 26)]] and by_id[103] == [[(3, 16, 27)]] * 2
    assert by_id[101] == [[]] and by_id[102] == [[]] and by_id[9001] == [[]] and by_id[0] == [[]]
    hidden = personal.masked(docs(spark, rows))
    assert hidden.columns == docs(spark, rows).columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in hidden.collect()}
    assert texts[100] == ("so my phone is <phone> thanks", 29) and texts[9001] == (None, None) and texts[9002] == ("", 0)
    assert texts[101][0] == rows[21][1] and "<phone>" in texts[3][0] and "+49" not in texts[3][0]
    assert personal.masked(docs(spark, [])).count() == 0


@pytest.mark.skipif(not SF.exists(), reason="needs the given tables")
def test_base_columns_of_the_query(spark):
    got = {r.doc_id: r for r in personal.op3_personal(spark, str(SF)).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        spans = plain_spans(r.text or "")
        listed = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        row, count = got[r.doc_id], Counter(k for k, _, _ in spans)
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(count[k] for k in range(4))
        assert set(listed.split(",")) - {""} <= set(row.spans.split(","))


# ---------------------------------------------------------------- op 4


def test_spliced_counts_equal_whole_encodings():
    made, rng = tokens.load(tokens.NAME), random.Random(5)
    whole = lambda t: len(made.encode(t, add_special_tokens=False))
    bits = ["a", "b", " ", "  ", "\n", "'", "'re", "é", "漢字", "🙂", "1", "22", "<|endoftext|>", "<|end", "oftext|>", "The", " token", "\t", "-"]
    for _ in range(150):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 400)))
        assert tokens.spliced_count(made, text, 60, 8) == whole(text)
    for text in ("a" * 5000, " " * 3000 + "x", "1" * 4000, "漢" * 3000, "<|endoftext|>" * 400, "ab " * 2000, "'" * 3000, "\n \n" * 1500):
        assert tokens.spliced_count(made, text, 100, 10) == whole(text)


def test_remembered_pieces_equal_whole_encodings():
    made, rng = tokens.load(tokens.NAME), random.Random(15)
    bits = ["a", "b", " ", " ", "  ", "\n", " \n", "'", "'re", "é", "\x1c", "\x85", "\u2003", "\xa0", "1", "<|endoftext|>", "<|end", "The", "\t"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    assert tokens.counts(texts).tolist() == [len(made.encode(t, add_special_tokens=False)) for t in texts]
    assert all("".join(tokens._pieces(t)) == t for t in texts)


def test_token_counts(spark):
    made = tokens.load(tokens.NAME)
    rows = [*ODD, (1, "a b <|endoftext|> c", "en", "a"), (1, "a b <|endoftext|> c", "en", "a"), (None, "über 'll", "en", "a")]
    got = rows_of(tokens.token_counts(docs(spark, rows), chunk=1000), "doc_id", "n_bytes", "n_tokens", "over_limit")
    n = [len(made.encode(t or "", add_special_tokens=False)) for _, t, _, _ in rows]
    want = [(r[0], len((r[1] or "").encode()), k, k > 512) for r, k in zip(rows, n, strict=True)]
    assert got == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))
    assert tokens.token_counts(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- op 5


def plain_mixture(rows, entropy, repeats, budget, block_tokens):
    count = [len(re.findall(r"[^ \t\n\r\f]+", t or "")) for _, t, _, _ in rows]
    total = defaultdict(int)
    for (_, _, _, s), n in zip(rows, count, strict=True):
        total[s] += n
    total = {s: n for s, n in total.items() if n}
    everything = sum(total.values())
    budget = everything if budget is None else budget

    def tempered(a):
        w = {s: (n / everything) ** a for s, n in total.items()}
        z = math.fsum(w.values())
        return {s: x / z for s, x in w.items()}

    def ok_entropy(a):
        w = tempered(a)
        return len(w) < 2 or -math.fsum(x * math.log(x) for x in w.values()) / math.log(len(w)) >= entropy

    def ok_repeats(a):
        return max(x * budget / total[s] for s, x in tempered(a).items()) <= repeats

    grid = [k / mixture.GRID for k in range(mixture.GRID + 1)]
    a = max(max([x for x in grid if ok_entropy(x)], default=0.0), min([x for x in grid if ok_repeats(x)], default=1.0))
    out, blocks = [], max(1, -(-budget // block_tokens))
    for s, w in tempered(a).items():
        share, at = round(w * budget), 0
        if not share:
            continue
        for epoch in range(-(-share // total[s])):
            names = [f"{epoch}:{'' if r[0] is None else r[0]}:{'' if r[1] is None else hashlib.md5(r[1].encode()).hexdigest()}" for r in rows]
            mine = [(hashlib.md5(name.encode()).hexdigest(), n, r[0]) for r, n, name in zip(rows, count, names, strict=True) if r[3] == s]
            for _, n, doc_id in sorted(mine, key=lambda m: m[:2]):
                if at < share:
                    out.append((at * blocks // share, doc_id, s, epoch, n))
                at += n
    return out


@pytest.mark.parametrize("settings", [{}, {"entropy": 1.0, "repeats": 3.0}, {"entropy": 0.5, "repeats": 1.5, "budget": 900, "block_tokens": 64}])
def test_mixture_equals_plain_reading(spark, settings):
    rng = random.Random(9)
    rows = [(k, words(rng, rng.randrange(1, 30)), "en", "hot" if k % 3 else f"s{k % 7}") for k in range(240)]
    rows += [(900, None, "en", "hot"), (901, "", "en", "s1"), (902, "  ", "en", "empty"), (903, "no source here", "en", None), (None, "no id at all", "en", "s2")]
    full = {"entropy": mixture.ENTROPY, "repeats": mixture.REPEATS, "budget": None, "block_tokens": mixture.BLOCK_TOKENS} | settings
    found = mixture.mixture(docs(spark, rows), **full, carry=("text", "score"))
    got = rows_of(found, "block", "doc_id", "source", "pass", "n_tokens")
    assert got == sorted(plain_mixture(rows, **full), key=lambda r: tuple((v is None, str(v)) for v in r))
    places = defaultdict(list)
    for r in found.collect():
        places[r.block].append(r.place)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    bare = mixture.mixture(docs(spark, rows), **full)
    assert rows_of(bare, "block", "place", "doc_id") == rows_of(found, "block", "place", "doc_id")


def test_rows_without_ids_are_permuted_like_others(spark):
    rows = [(None, f"one two {k}", "en", "hot") for k in range(200)]
    found = mixture.mixture(docs(spark, rows), block_tokens=30, carry=("text",)).collect()
    assert sorted(r.text for r in found) == sorted(t for _, t, *_ in rows)
    order = [int(r.text.split()[-1]) for r in sorted(found, key=lambda r: (r.block, r.place))]
    assert len({r.block for r in found}) == 20 and sum(abs(a - b) == 1 for a, b in zip(order, order[1:])) < 20


def test_mixture_of_nothing(spark):
    assert mixture.mixture(docs(spark, [])).count() == 0
    assert mixture.mixture(docs(spark, [(1, None, "en", "a")])).count() == 0


# ---------------------------------------------------------------- ops 6 and 10


def labelled(spark, rng, column):
    rows, marks = [], []
    for k in range(400):
        bad = k % 4 == 0
        text = invented(rng, "aa", rng.randrange(10, 60))
        if column == "quality" and bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if column == "toxic" and bad:
            parts = text.split()
            for w in ("vermin", "scoundrel"):
                parts.insert(rng.randrange(len(parts)), w)
            text = " ".join(parts)
        rows.append((k, text, "aa", "s"))
        marks.append((k, int(not bad) if column == "quality" else int(bad)))
    marks += [(9001, 1), (None, 1), (5000, None), (77, marks[77][1])]
    return rows + ODD, spark.createDataFrame([(*m, 3) for m in marks], f"doc_id bigint, {column} int, text int"), dict(marks[:400])


def test_quality_held_out(spark):
    rows, labels, marks = labelled(spark, random.Random(12), "quality")
    frame = docs(spark, rows)
    model = quality.fit(frame, labels, piece=256)
    got = {r.doc_id: r for r in quality.quality(frame, model).collect()}
    held = [i for i in marks if rest(i, 4) == 2]
    assert np.mean([got[i].predicted == marks[i] for i in held]) >= 0.95
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert got[9001].score == got[9002].score
    kept = quality.accepted(frame, model)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.predicted)


def test_toxicity_held_out(spark):
    rows, labels, marks = labelled(spark, random.Random(13), "toxic")
    frame = docs(spark, rows)
    model = toxicity.fit(frame, labels)
    got = {r.doc_id: r for r in toxicity.toxicity(frame, model).collect()}
    held = [i for i in marks if rest(i, 3) == 1]
    assert np.mean([got[i].predicted == marks[i] for i in held]) >= 0.95
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert got[9001].score == got[9002].score < 0.5


@pytest.mark.parametrize("operator, column", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_ignore_held_out_labels_and_stand_missing_ones(spark, operator, column):
    rows, labels, marks = labelled(spark, random.Random(14), column)
    frame, of, out = docs(spark, rows), (4 if column == "quality" else 3), (2 if column == "quality" else 1)
    flipped = spark.createDataFrame([(i, 1 - m if rest(i, of) == out else m) for i, m in marks.items()], f"doc_id bigint, {column} int")
    plain = spark.createDataFrame(list(marks.items()), f"doc_id bigint, {column} int")
    score = lambda model: rows_of(getattr(operator, "quality" if of == 4 else "toxicity")(frame, model), "doc_id", "score")
    assert score(operator.fit(frame, flipped)) == score(operator.fit(frame, plain))
    for few in (plain.limit(0), plain.where(f"{column} = 1")):
        assert all(0 <= s <= 1 for _, s in score(operator.fit(frame, few)))
    empty = docs(spark, [])
    assert getattr(operator, "quality" if of == 4 else "toxicity")(empty, operator.fit(empty, plain)).count() == 0


def test_grams_are_all_there():
    text, place = toxicity.presence(["abc de", None, "", "abc de"])
    want = sum(len({" abc de "[k : k + n] for k in range(8 - n + 1)}) for n in toxicity.ORDERS)
    assert Counter(text.tolist()) == {0: want, 3: want}
    assert (place[text == 0] == place[text == 3]).all()
