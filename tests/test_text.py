import random
import re
import unicodedata

import pytest

from briefwerk.functions import text as t


def test_ascii_part(values):
    cases = {
        "Müller": "Muller", "": "unknown", "tea? #cup": "tea-cup", "oak___elm": "oak-elm",
        "Straße": "Strae", "a–b": "ab", "ﬁx": "fix", "½": "12", "日本": "unknown", "-x-": "x",
    }
    assert values(t.ascii_part, list(cases)) == list(cases.values())


def test_ascii_part_equals_normalisation_on_random_text(values):
    rng = random.Random(5)
    pools = [range(0x20, 0x250), range(0x1E00, 0x2200), range(0x2460, 0x2500), range(0xFB00, 0xFB10),
             range(0xFF00, 0xFF60), range(0x1D400, 0x1D4FF), range(0x300, 0x340), range(0x3300, 0x33FF)]
    texts = ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(30)) for _ in range(300)]

    def expected(text):
        kept = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
        return re.sub("[^A-Za-z0-9]+", "-", kept).strip("-") or "unknown"

    assert values(t.ascii_part, texts) == [expected(x) for x in texts]


def test_safe_filename(values):
    cases = {
        "Qq" * 120 + ".pdf": "Qq" * 88 + ".pdf", "Lease": "Lease.pdf", "X.PDF": "X.pdf",
        "a.b.pdf": "a-b.pdf", "A" * 175 + "-BCD.pdf": "A" * 175 + ".pdf", ".pdf": "unknown.pdf",
    }
    assert values(t.safe_filename, list(cases)) == list(cases.values())


def test_stem_and_suffix(values):
    names = ["a.pdf", ".x", "a.tar.gz", "x.", "noext"]
    assert values(t.name_stem, names) == ["a", ".x", "a.tar", "x.", "noext"]
    assert values(t.name_suffix, names) == [".pdf", ".pdf", ".gz", ".pdf", ".pdf"]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Muster AG\nBern, 1. Oktober 2025\nRechnung Oktober 2025", "20251001"),
        ("Amt\nSt. Gallen, 15. November 2025\nRechnung", "20251115"),
        ("Post\nBiel/Bienne, 31. Dezember 2025\nKontoauszug", "20251231"),
        ("EKZ\n" + "x" * 900 + "\nMusterstadt, 15. November 2025", None),
        ("Periode: 01.12.2025 – 31.12.2025\nSaldo: CHF 4727.40", None),
        ("Bern, 45. Mai 2025", None),
        ("Bern, 45. Mai 2025\nBern, 4. Mai 2025", None),
        ("Bern, 31. Februar 2025", "20250231"),
        ("Bern, 1. Mai 1999", None),
        ("Bern, 1. Mai 2101", None),
        ("Bern, 28. März 2026", "20260328"),
        ("bern,3.MÄR. 2026", "20260303"),
        ("Montag, 3. Dezember 2025", "20251203"),
        (None, None),
    ],
)
def test_letter_date(values, text, expected):
    assert values(t.letter_date, [text]) == [expected]


def test_month_number(values):
    names = ["Januar", "Mär.", "März", "Mar", "maerz", "DEZ.", "Brumaire"]
    assert values(t.month_number, names) == [1, 3, 3, 3, 3, 12, None]


def test_field_match(values):
    rows = [("PostFinance AG", ["postfinance"]), ("x", ["y", "X"]), ("x", ["y"]), ("x", []), ("", ["!!"])]
    got = values(t.field_match, rows, "a string, e array<string>")
    assert got == [True, True, False, None, True]


def test_is_blank_and_strip(values):
    assert values(t.is_blank, ["", " \n\t", "  ", "x", None]) == [True, True, True, False, True]
    assert values(t.strip, ["  a b\n", "", "x"]) == ["a b", "", "x"]
