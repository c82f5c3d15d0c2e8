import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from briefwerk import fixed
from briefwerk.functions import redaction as r
from briefwerk.functions.dialect import java
from briefwerk.operators import blocklist, redact


def expected(text, terms=()):
    """One document at a time, with Python's own regex engine."""
    counts = {}
    rules = [(label, re.compile(p, re.IGNORECASE if ic else 0)) for label, ic, p in fixed.REDACTION_RULES]
    rules += [(fixed.BLOCKLIST_LABEL, re.compile(re.escape(t), re.IGNORECASE)) for t in terms]
    for label, rule in rules:
        text, n = rule.subn(label, text)
        if n:
            counts[label] = counts.get(label, 0) + n
    return text, counts


def run(spark, texts, terms=()):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    done = redact.redact(df, "text", tuple(terms)).select("i", "redacted_text", redact.redaction_map().alias("m"))
    return [(row.redacted_text, row.m) for row in done.orderBy("i").collect()]


CASES = [
    ("IBAN: CH56 0483 5012 3456 7800 9", "IBAN: [IBAN] 9"),
    ("CH5604835012345678009", "CH5604835012345678009"),
    ("BE68 5390 0754 7034", "[IBAN]"),
    ("AHV 756.1234.5678.90.", "AHV [AHV]."),
    ("a.b+c@mail.example.ch!", "[EMAIL]!"),
    ("Tel. 044 123 45 67, +41 79 123 45 67", "Tel. [TELEFON], [TELEFON]"),
    ("+1 (743) 555-3824 und 0844 843 844", "+1 (743) 555-3824 und 0844 843 844"),
    ("CHF 1'234.50 und 12.00 EUR", "[BETRAG] und [BETRAG]"),
    ("CHF 580000", "[BETRAG]000"),
    ("CHF -45.00", "CHF -45.00"),
    ("Lindenstrasse 12, 8001 Bern", "[ADRESSE]"),
    ("lindenstrasse 12\n8001 bern", "[ADRESSE]"),
    ("General-Guisan-Strasse 40, 8001 Bern", "General-Guisan-Strasse 40, 8001 Bern"),
    ("Dr. med. Anna Weber kam", "[BEHANDLER] kam"),
    ("Prof. Dr. med. Anna Weber", "[BEHANDLER]. med. Anna Weber"),
    ("CHF 100756.1234.5678.90", "[BETRAG]756.1234.5678.90"),
    ("[IBAN] steht schon da", "[IBAN] steht schon da"),
    ("", ""),
]


def test_rules_and_quirks(spark):
    got = run(spark, [text for text, _ in CASES])
    assert [g[0] for g in got] == [want for _, want in CASES]
    assert got == [expected(text) for text, _ in CASES]


def test_blocklist(spark):
    text = "Hallo Olga Brandt, brandtner, IBAN BE68 5390 0754 7034 a.c a+c"
    for terms in (("Olga Brandt",), ("brandt", "Olga Brandt"), ("IBAN",), ("a.c",), ("name", "Hallo"), ("x\\Ey", "(")):
        assert run(spark, [text], terms) == [expected(text, terms)]


def test_null_text_has_no_redactions(spark):
    assert run(spark, [None]) == [(None, {})]


FRAGMENTS = [
    "CH56", "0483", "5012", "3456", "7800", "9", " ", "  ", "\n", "756.1234.5678.90", "a@b.ch", "ä", "é", "x",
    ".", "'", "+41", "079", "044", "123", "45", "67", "CHF", "eur", "USD ", "12", "1'000", ".50", "Linden",
    "strasse", "weg", "Str.", "8001", "Bern", "Dr.", "Prof.", "med.", "Keller", "Weber-Frey", ",", "-", "ſ", "K",
    " ", "²", "[IBAN]", "[", "]",
]


def test_random_letters_equal_python(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(FRAGMENTS) + rng.choice(["", "", " "]) for _ in range(40)) for _ in range(1500)]
    got = run(spark, texts)
    differing = [(t, g, expected(t)) for t, g in zip(texts, got) if g != expected(t)]
    assert not differing, differing[:2]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(FRAGMENTS[:-3]), max_size=25).map(" ".join), min_size=20, max_size=60))
def test_counts_equal_placeholders(spark, texts):
    for text, (redacted, counts) in zip(texts, run(spark, texts)):
        tokens = re.findall(fixed.PLACEHOLDER, redacted)
        assert sum(counts.values()) == len(tokens)
        rest = iter(text)
        assert all(c in rest for c in re.sub(fixed.PLACEHOLDER, "", redacted))


def test_long_texts(spark):
    """Tables of numbers and runs of letters must neither overflow the stack nor stall."""
    texts = ["CHF 1" + " 123" * 20000, "x" * 100000, "CH56" + " 1234" * 20000, "a." * 30000 + "@x.ch", "A-" * 30000]
    got = run(spark, texts)
    assert got[0][0] == "[BETRAG]"
    assert got[1] == (texts[1], {})


def test_prepare_marks_scans(spark):
    df = spark.createDataFrame([(1, "a@b.ch und c@d.ch"), (2, " \n"), (3, None)], "i int, text string")
    rows = {row.i: row for row in redact.prepare(df).collect()}
    assert (rows[1].is_scanned, rows[1].redacted_text, rows[1].n_redactions) == (False, "[EMAIL] und [EMAIL]", 2)
    assert rows[1].redactions == {"[EMAIL]": 2}
    for i in (2, 3):
        assert (rows[i].is_scanned, rows[i].redacted_text, rows[i].redactions) == (True, None, {})


def test_summary_and_rows(spark):
    df = spark.createDataFrame([("a", "x@y.ch"), ("a", "x@y.ch 756.1234.5678.90"), ("b", "nichts")], "g string, text string")
    got = {tuple(row) for row in redact.redaction_summary(df, "g").collect()}
    assert got == {("a", "[EMAIL]", 2, 2), ("a", "[AHV]", 1, 1)}
    rows = redact.redaction_rows(redact.redact(df), "g").groupBy("g", "label").agg(F.sum("n").alias("n"))
    assert {tuple(row) for row in rows.collect()} == {("a", "[EMAIL]", 2), ("a", "[AHV]", 1)}


@pytest.mark.parametrize(
    "text,labels",
    [
        ("AHV: 756.1234.5678.90", "AHV"),
        ("Rechnung von Muster, CHF 89.00", ""),
        ("Mobil 079 123 45 67", "Telefon (CH)"),
        ("+41 79 1234567 und 756.1234.5678.90", "AHV, Telefon (CH)"),
        ("Festnetz 044 123 45 67", ""),
        ("1079 123 45 67", ""),
    ],
)
def test_leaks(values, text, labels):
    assert values(r.leak_labels, [text]) == [labels]
    hits = values(r.leak_hits, [text])[0]
    assert ", ".join(h.label for h in hits) == labels


def test_leak_snippets_are_the_first_hits(values):
    hits = values(r.leak_hits, ["x 0041 76 111 22 33 y 079 123 45 67"])[0]
    assert [(h.label, h.snippet) for h in hits] == [("Telefon (CH)", "0041 76 111 22 33")]


def test_placeholder_tally(spark):
    df = spark.createDataFrame([("[NAME] [NAME] [BETRAG] [name] [ÄÖÜ] []",)], "anonymized_text string")
    got = {tuple(row) for row in redact.placeholder_tally(df).collect()}
    assert got == {("[NAME]", 2), ("[BETRAG]", 1), ("[ÄÖÜ]", 1)}


def test_many_terms_in_the_plan(spark):
    terms = tuple(f"Person {k} Muster" for k in range(600))
    texts = ["an person 17 muster und Person 599 MUSTER", "Person 600 Muster", ""]
    assert run(spark, texts, terms) == [expected(t, terms) for t in texts]


def test_terms_with_one_beginning_are_searched_before_they_are_kept(spark):
    terms = spark.range(20_000).select(F.col("id").alias("line_no"), F.concat(F.lit("gemeinsamer Anfang "), F.col("id")).alias("term"))
    docs = spark.createDataFrame([(1, "der gemeinsamer Anfang ist hier"), (2, "GEMEINSAMER Anfang 77 da")], "i int, text string")
    found = {r.i: [t.line_no for t in r._found] for r in blocklist.candidates(docs, terms, "i", "text").collect()}
    assert set(found) == {2} and sorted(found[2]) == [7, 77]


def test_long_blocklist_equals_trying_every_term(spark):
    rng = random.Random(3)
    syllables = ["ma", "mü", "ler", "ka", "Na", "me", "[", "]", "x", " ", "ß", "SS", "É", "ſ", "İ", "Σ", "ς", "\\E", "."]
    terms = list(dict.fromkeys("".join(rng.choice(syllables) for _ in range(rng.randint(1, 6))) for _ in range(60)))
    terms = [t for t in terms if t.strip()]
    texts = ["".join(rng.choice(syllables) for _ in range(40)) for _ in range(80)] + ["nothing to see"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    table = spark.createDataFrame(list(enumerate(terms)), "line_no int, term string")
    every = F.array(*[F.lit(r.term_pattern(t)) for t in terms])
    brute = docs.select("i", r.fold_terms(F.col("text"), every).alias("f")).orderBy("i").collect()
    for threshold in ("10m", "-1"):  # broadcast and shuffled
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        done = blocklist.redact_terms(docs, table, "i", "text").orderBy("i").collect()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert [(d.redacted_text, d.n_name) for d in done] == [(b.f.text, b.f.hits) for b in brute]


ODD_PIECES = (
    "CH56", "BE68 5390 0754 7034", "A", "\u00c4", "\U0001d400", "_", "7", "756.", "756.1234.5678.90", "0", "044 123 45 67", "+41 44 123 45 67",
    "a.b", "%", "@", "x@y.ch", "@y.ch", "\u00fc", "Dr. ", "PD Dr. Lea Frei", "med. dent. Max", "Prof.", " ", "\n", "-", ".", "\u0667",
)


def test_rules_match_what_the_plain_patterns_match(spark):
    dice = random.Random(3)
    texts = ["".join(dice.choice(ODD_PIECES) for _ in range(dice.randint(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for label, ignore_case, pattern in fixed.REDACTION_RULES:
        plain = F.regexp_replace("text", java(pattern, ignore_case), F.lit(label))
        differing = df.select("text", r.redact_rule(F.col("text"), label).alias("got"), plain.alias("want")).where("got <> want")
        assert differing.take(3) == [], label


def test_rules_test_a_character_before_they_look_back():
    for label in ("[IBAN]", "[AHV]", "[TELEFON]", "[BEHANDLER]"):
        assert not r.PATTERNS[label].startswith("(?<"), label
    assert "|(?<!" not in r.PATTERNS["[TELEFON]"]


def test_text_before_the_first_address_is_not_searched(spark):
    # every dot begins a word that goes on to the blank: a search from each of them takes the square of the length
    long = "a." * 100_000 + " an x@y.ch, " + "z"
    begun = time.time()
    assert run(spark, [long]) == [(long.replace("x@y.ch", "[EMAIL]"), {"[EMAIL]": 1})]
    assert time.time() - begun < 15


def test_amounts_and_addresses_equal_the_plain_patterns(spark):
    parts = ["CHF", "chf", "uſd", "EUR", " ", ".", "'", ",", "1", "12", "123", "1234", "٣", "𝟏𝟐𝟑", "\n", "A", "ÿ", "é", "-",
             "ſtrasse", "rİng", "weg", "str.", " 3000 Bern", " 12, "]
    rnd = random.Random(3)
    rows = [("".join(rnd.choices(parts, k=rnd.randint(1, 12))),) for _ in range(20_000)]
    rows += [(f"{rnd.choice(parts)}{rnd.choice(parts)}weg{rnd.choice(parts)}12, 3000 Bern",) for _ in range(5_000)]
    texts = spark.createDataFrame(rows, "text string")
    for label in ("[BETRAG]", "[ADRESSE]"):
        ignore_case, plain = next((i, p) for at, i, p in fixed.REDACTION_RULES if at == label)
        wanted = F.regexp_replace("text", java(plain, ignore_case), label)
        assert texts.where(wanted != F.col("text")).count() > 100
        assert texts.where(~wanted.eqNullSafe(F.regexp_replace("text", r.PATTERNS[label], label))).isEmpty()


def test_amounts_are_told_by_their_first_character_and_not_tried_shorter():
    assert r.PATTERNS["[BETRAG]"].startswith("(?=[CEUceu0123456789")
    assert "{1,3}+(" in r.PATTERNS["[BETRAG]"]
