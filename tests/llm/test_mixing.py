import re

from pyspark.sql import functions as F

from quernel.llm import mixing


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by repeated resharing of what capped sources leave."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] >= cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= over


def rows():
    out = []
    for i in range(400):
        source = ["a", "b", "c", None, "d"][(i * i) % 5] if i % 3 else "a"
        out.append((i, " ".join(["w"] * (i % 37)) if i % 50 else None, source))
    return [*out, (1007, "same row", "a"), (1007, "same row", "a"), (None, "no id\x1f here", "e")]


def test_targets_and_sampling(as_table):
    data = rows()
    got = mixing.mixing_query(as_table(data, "doc_id long, text string, source string")).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + size(t)
    targets = fill(sizes)
    by_id = {}
    for i, t, s in data:
        by_id.setdefault(i, []).append((size(t), s))
    assert len(got) == len(data)
    taken = {}
    for r in got:
        s = by_id[r.doc_id][0][1]
        assert r.size in [x for x, _ in by_id[r.doc_id]] and r.source_size == sizes[s]
        assert abs(r.target - targets[s]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - targets[s]) <= 40
    again = mixing.mixing_query(as_table(data, "doc_id long, text string, source string")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_emitted_rows_are_the_copies(as_table):
    docs = as_table(rows(), "doc_id long, text string, source string")
    counted = mixing.mix_sources(docs).agg(F.sum("copies"), F.sum(F.col("copies") * F.col("size"))).first()
    out = mixing.emit_mix(docs)
    assert out.columns == [*docs.columns, "copy"] or set(out.columns) == {*docs.columns, "copy"}
    assert tuple(out.agg(F.count("*"), F.sum(mixing.n_spaced_words(F.col("text")))).first()) == tuple(counted)


def test_empty_and_sizeless(as_table):
    assert mixing.mixing_query(as_table([], "doc_id long, text string, source string", name="none")).count() == 0
    got = mixing.mixing_query(as_table([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_repeated_rows_keep_their_columns(as_table):
    rows = [(1, "one two three", "a", "X", "p", "q", "r"), (1, "one two three", "a", "Y", "p", "q", "r"), (2, "x", "b", "Z", "p", "q", "r")]
    docs = as_table(rows, "doc_id long, text string, source string, file string, at string, mark string, copy string", extra=False)
    out = mixing.emit_mix(docs, weights=(1,), cap=3)
    assert sorted(out.columns) == sorted(docs.columns)
    assert {r.file for r in out.where("doc_id = 1").collect()} == {"X", "Y"}
    assert {(r.at, r.mark) for r in out.collect()} == {("p", "q")}


def test_crossings_far_along(spark):
    one = spark.range(60).select((F.lit(10**11) * (F.col("id") + 1) ** 4 + F.col("id")).cast("long").alias("n"), F.lit(int(2.7 * (1 << 30))).alias("rate"), F.lit((1 << 30) - 1).cast("long").alias("offset"))
    for r in one.withColumn("c", mixing.crossed(F.col("n"), F.col("rate"), F.col("offset"))).collect():
        assert r.c == (r.n * r.rate + r.offset) >> 30


def test_rows_are_not_shuffled_or_broadcast_whole(as_table, monkeypatch):
    """In several waves of files, too, texts are in no exchange."""
    from quernel.llm import common

    docs = as_table(rows(), "doc_id long, text string, source string").repartition(6)
    docs.write.mode("overwrite").parquet(path := docs.inputFiles()[0].rsplit("/", 1)[0] + "-dealt")
    docs = docs.sparkSession.read.parquet(path)
    whole = sorted(map(str, mixing.emit_mix(docs).collect()))
    monkeypatch.setattr(common, "MARK_BYTES", 20_000)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    out = mixing.emit_mix(docs)
    assert sorted(map(str, out.collect())) == whole
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "Aggregate" not in plan and out._jdf.queryExecution().executedPlan().toString().count(" Exchange ") == 0


def test_targets_of_many_sources(spark):
    """Equal sizes too, empty and null sources, and no sources at all."""
    import random

    rnd = random.Random(6)
    for sizes in ([10] * 300, [rnd.choice([0, 1, 10, 10, 1000]) for _ in range(500)], [rnd.randrange(10_000) for _ in range(700)], [5], [0], []):
        given = {(f"s{i:04}" if i else None): n for i, n in enumerate(sizes)}
        rows = spark.createDataFrame(list(given.items()), "source string, size long").repartition(5)
        got = {r.source: r for r in mixing.source_targets(rows, (5, 2, 1), 3).collect()}
        expected = fill(given)
        assert {s: r.source_size for s, r in got.items()} == given
        assert all(abs(got[s].target - t) <= 1e-9 * max(1, t) for s, t in expected.items())
        assert abs(sum(r.target for r in got.values()) - sum(sizes)) <= 1e-6 * max(1, sum(sizes))
