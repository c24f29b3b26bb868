import hashlib
import random
import re

import duckdb

from quernel.llm import fim


def by_hand(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"


def cases():
    rnd = random.Random(3)
    parts = ["word", "Words", " ", "\n", "\r\n", "é", "日本", "😀", "á", "<", "<S", "<P", ">", "M>", "<M", "123", "\0", "\t", "_", "ſ", " ", "Z"]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 30))) for _ in range(600)]
    return [None, "", "a", " ", "holds <S> itself", "<M>", "<P>x", *made, *made[:5]]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_whole_results_equal_brute_force(as_table):
    rows = [*enumerate(cases()), (None, "no id at all"), (None, None), (7, "an id again")]
    expected = sorted(((i, *(told := by_hand(i, t))[:4], digest(told[4]), digest(t or "")) for i, t in rows), key=str)
    got = sorted((tuple(r) for r in fim.transform_digests(as_table(rows)).collect()), key=str)
    assert got == expected
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_sql_agrees(as_table, tmp_path):
    as_table([(i, t) for i, t in enumerate(cases()) if "\0" not in (t or "")], extra=False)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cur = con.execute(fim.FIM_SQL)
    names = [c[0] for c in cur.description]
    expected = sorted(cur.fetchall(), key=str)
    spark = as_table([], name="none").sparkSession
    df = fim.transform_digests(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert df.columns == names
    assert sorted((tuple(r) for r in df.collect()), key=str) == expected


def test_long_texts_are_cut_in_pieces(monkeypatch, as_table):
    long = [("word é " * 400_000), "x" * 3_000_000, "1" * 2_000_000, "ab<P " * 100_000]
    cutter = fim.Cutter()
    for text in long:
        starts = cutter.starts(text)
        assert [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)] == starts[:-1].tolist()
    monkeypatch.setattr(fim, "PIECE", 3)
    for text in cases()[:200]:
        assert [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text or "")] == cutter.starts(text or "")[:-1].tolist()
    got = {r.doc_id: r for r in fim.transform_digests(as_table(list(enumerate(long)))).collect()}
    for i, text in enumerate(long):
        assert (got[i].n, got[i].form, got[i].output_sha256, got[i].restored_sha256) == ((told := by_hand(i, text))[0], told[1], digest(told[4]), digest(text))


def test_texts_are_restored_from_outputs(as_table):
    rows = [(i, t) for i, t in enumerate(cases())]
    df = as_table(rows)
    out = fim.transform(df)
    assert out.columns == df.columns
    for r in out.collect():
        _, form, _, _, expected = by_hand(r.doc_id, rows[r.doc_id][1])
        assert r.text == expected and fim.restored(r.text, form) == (rows[r.doc_id][1] or "") and r.n == "x"
    assert fim.transform_digests(as_table([], name="none")).count() == 0
