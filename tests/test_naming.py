import random
from pathlib import PurePath

import pytest

from briefwerk.operators.naming import unique_names, unique_original_names
from briefwerk.operators.running import running


def one_by_one(rows, taken, portable):
    """Serve the files in order, as a single process would."""
    got, out = set(taken), {}
    for folder, base, order in sorted(rows, key=lambda r: r[2]):
        stem, suffix = (base[:-4], ".pdf") if portable else (PurePath(base).stem, PurePath(base).suffix or ".pdf")
        n, name = 1, base
        while (folder, name) in got:
            n += 1
            marker = f"-{n}"
            cut = stem[: 176 - len(marker)].rstrip("-") if portable else stem
            name = cut + marker + suffix
        got.add((folder, name))
        out[order] = name
    return out


def run(spark, rows, taken, portable):
    df = spark.createDataFrame(rows, "dir string, name string, file string")
    held = spark.createDataFrame(taken, "dir string, name string") if taken else None
    number = unique_names if portable else unique_original_names
    return {r.file: r.final_name for r in number(df, name="name", taken=held).collect()}


LONG = "L" * 170 + "-" + "M" * 8


@pytest.mark.parametrize("seed,earlier", [(2, 6)])
def test_portable_names_equal_serving_one_by_one(spark, seed, earlier):
    rng = random.Random(seed)
    bases = ["a", "a-2", "a-3", "a-2-2", "a-4", "b", "a-2-3", "c-20250101", LONG[:174], LONG[:176], LONG[:175],
             LONG[:170] + "-2", "b-10"]
    weights = [8, 3, 2, 2, 1, 4, 1, 3, 3, 3, 2, 2, 1]
    rows = [(rng.choice("xy"), rng.choices(bases, weights)[0] + ".pdf", f"f{i:04d}") for i in rng.sample(range(5000), 60)]
    names = ["a", "a-2", "a-5", "a-6", "a-7", "b-2", "b-3", "a-2-2", LONG[:170] + "-3", LONG[:173] + "-4", "z"]
    taken = sorted({(rng.choice("xy"), rng.choice(names) + ".pdf") for _ in range(earlier)})
    assert run(spark, rows, taken, True) == one_by_one(rows, taken, True)


def test_original_names_equal_serving_one_by_one(spark):
    rng = random.Random(7)
    bases = ["a.pdf", "a", "a-2.pdf", "a-3", "a-2-2.pdf", "b.txt", "b", "b-2.txt", ".x", "x.", "c.tar.gz"]
    rows = [(rng.choice("xy"), rng.choice(bases), f"f{i:04d}") for i in rng.sample(range(5000), 60)]
    taken = sorted({(rng.choice("xy"), rng.choice([*bases, "a-4.pdf", "a-5.pdf", "b-2.pdf"])) for _ in range(8)})
    assert run(spark, rows, taken, False) == one_by_one(rows, taken, False)


def test_many_names_asked_for_as_such_take_few_rounds(spark, monkeypatch):
    from briefwerk.operators import naming

    rounds = []
    monkeypatch.setattr(naming, "gated", lambda *rows, known=naming.gated: (rounds.append(1), known(*rows))[1])
    rows = [("d", f"x-{k}.pdf", f"a{k:04d}") for k in range(2, 502)] + [("d", "x.pdf", f"b{k}") for k in range(4)]
    rows += [("d", "x.pdf", "a0250x")]
    assert run(spark, rows, [], True) == one_by_one(rows, [], True)
    assert len(rounds) <= 3


def test_long_runs_of_earlier_names(spark):
    taken = [("d", "y.pdf")] + [("d", f"y-{k}.pdf") for k in range(2, 400) if k % 7] + [("e", "y-3.pdf")]
    rows = [(d, "y.pdf", f"{d}{k:03d}") for d in "de" for k in range(120)]
    assert run(spark, rows, taken, True) == one_by_one(rows, taken, True)


def test_free_and_taken_original_name(spark):
    assert run(spark, [("d", "test.pdf", "f")], [], False) == {"f": "test.pdf"}
    assert run(spark, [("d", "test.pdf", "f")], [("d", "test.pdf")], False) == {"f": "test-2.pdf"}


def test_running_spreads_a_hot_group(spark):
    """Most rows share one group; numbers and sums must not depend on how it was cut."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    hot = F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string"))
    df = spark.range(6000).select(hot.alias("g"), F.sha1(F.col("id").cast("string")).alias("o"), (F.col("id") % 17).alias("v"))
    got = running(df, ["g"], ["o"], "k", {"s": "v"})
    w = Window.partitionBy("g").orderBy("o")
    want = df.select("g", "o", "v", F.row_number().over(w).cast("bigint").alias("k"), F.sum("v").over(w).alias("s"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_gated_sums_equal_going_through_the_rows(spark):
    """Whatever the number of runs; one group holds most of the rows."""
    from briefwerk.operators.gated import gated

    rng = random.Random(11)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), k, rng.randrange(-2, 60)) for k in range(400)]
    counted, want = {}, []
    for g, k, gate in rows:
        counts = counted.get(g, 0) < gate
        counted[g] = counted.get(g, 0) + counts
        want.append((g, k, gate, counts))
    df = spark.createDataFrame(rows, "g string, k bigint, gate bigint")
    for partitions in (None, 5):
        got = [tuple(r) for r in gated(df, ["g"], ["k"], "gate", partitions=partitions).collect()]
        assert sorted(got, key=lambda r: r[1]) == want
    assert gated(df.limit(0), ["g"], ["k"], "gate").count() == 0


def test_thresholds_in_chunks_equal_one_list(monkeypatch):
    from briefwerk.operators import gated

    monkeypatch.setattr(gated, "CHUNK", 4)
    rng = random.Random(12)
    for _ in range(50):
        gates, known = [rng.randrange(-3, 40) for _ in range(60)], gated.Thresholds()
        thresholds = [known.add(gate) for gate in gates]
        for start in range(-3, 45):
            m = start
            for gate in gates:
                m += m < gate
            assert m == start + sum(t > start for t in thresholds)
