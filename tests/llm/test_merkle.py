"""The manifest against trees built row by row, for every stride, and its edge cases."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle, queries
from plumbline.plans.compare import compare
from plumbline.session import shared_dir

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, IDX int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def grown(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def steps(levels, i):
    out = []
    for nodes in levels[:-1]:
        a = i - i % 8
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1:a + 8])))
        i //= 8
    return out


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, steps) of every row."""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r)))
    names = sorted(langs, key=lambda n: (n is not None, (n or "").encode()))
    trees = [grown([x[2] for x in sorted(langs[n])]) for n in names]
    top = grown([t[-1][0] for t in trees])
    out = []
    for j, name in enumerate(names):
        for i, (known, key, d) in enumerate(sorted(langs[name])):
            out.append((key if known else None, d, trees[j][-1][0], top[-1][0], steps(trees[j], i) + steps(top, j)))
    return sorted(out, key=str)


def rows_of(n_hot, n_langs):
    rows = [(i * 7 % n_hot, f"s{i % 3}", "en", i, f"Text {i} É") for i in range(n_hot)]
    rows += [(i, None, f"l{i}", None, "x" * (i + 1)) for i in range(n_langs)]
    rows += [(1, "s", None, 3, None), (None, None, None, None, None), (None, None, None, None, None), (5, "s", "", 0, ""), (5, "s", "", 0, ""), (5, "t", "", 0, "y" * 200_000), (2, "a", "É", 1, "-"), (3, "a", "z", 1, "1:-")]
    return [(*r, "mine", 4) for r in rows]


def proven(manifest):
    rows = merkle.proofs(manifest).collect()
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.steps]) for r in rows], key=str)


@pytest.mark.parametrize("stride, n_hot, n_langs", [(1, 70, 70), (2, 600, 3), (3, 600, 70), (3, 513, 0)])
def test_proofs_like_brute_force(spark, stride, n_hot, n_langs):
    rows = rows_of(n_hot, n_langs)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    manifest = merkle.build(df, FIELDS, "lang", "doc_id", {"doc_id": F.col("doc_id")}, stride=stride)
    expected = brute(rows)
    assert proven(manifest) == expected
    assert manifest.root() == expected[0][3]
    # only every few levels are on disk: one of 600 leaves has four levels above them
    assert len(manifest.groups.levels) == 1 + -(-(4 if n_hot > 512 else 3) // stride)
    folded = merkle.proofs(manifest).select((merkle.fold(F.col("leaf"), F.col("steps")) == F.col("root")).alias("ok"))
    assert folded.where("ok").count() == len(rows)


def test_stored_manifest_is_read_back(spark):
    df = spark.createDataFrame(rows_of(80, 2), SCHEMA)
    path = shared_dir(spark, "kept")
    built = merkle.build(df, FIELDS, "lang", "doc_id", {"doc_id": F.col("doc_id")}, path=path)
    again = merkle.load(spark, path, ["doc_id"])
    assert proven(again) == proven(built) and again.root() == built.root()


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(4, "s", "en", 2, "ab"), (4, "s", "en", 2, "ab")]])
def test_no_row_and_few(spark, rows):
    manifest = merkle.build(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA), FIELDS, "lang", "doc_id", {"doc_id": F.col("doc_id")})
    assert proven(manifest) == brute(rows) and manifest.root() == (brute(rows)[0][3] if rows else None)


def test_query_like_sql_on_odd_rows(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(rows_of(90, 12), SCHEMA).select(*FIELDS)
    monkeypatch.setattr(queries, "table", lambda *_: df)
    con = duckdb.connect()
    con.register("frame", df.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, source, lang, CAST(n_chars AS BIGINT) AS n_chars, text FROM frame")
    got = queries.op12(spark, "")
    ok, why, _ = compare(got, queries.OP12_SQL, con)
    assert ok, why
    assert 0 < got.where("not verified").count() < got.count()
