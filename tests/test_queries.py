"""Every registered query that has SQL gives the same rows as DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from wordloom.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(df):
    def plain(x):
        if x is None or x != x:
            return None
        return round(float(x), 5) if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(str(tuple(map(plain, r))) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, sf, duck, name):
    assert rows(plans.QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(plans.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL) - {"learned_patterns"}))
def test_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_member_discovery_has_no_cuts(spark, tmp_path):
    """Long forms, short, long and rare members, and any language."""
    long = "donaudampfschifffahrt"
    rows = [("de", f"{long} {long}skapitän {long}en {long}er ü"), ("fr", "eau eaux beau seau"), (None, "ok oko")]
    spark.createDataFrame(rows, "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    forms = {w for _, t in rows for w in t.split()}
    inside = {m: {(f, f[:i]) for f in forms for i in range(len(f)) if f.startswith(m, i) and len(m) < len(f)} for m in forms}
    want = {(m, len({f for f, _ in x}), len({c for _, c in x})) for m, x in inside.items() if len({f for f, _ in x}) >= plans.SUPPORT}
    assert {m for m, _, _ in want} == {long, "eau"}
    assert {(r.member, r.forms, r.contexts) for r in plans.QUERIES["member_discovery"](spark, str(tmp_path)).collect()} == want


def test_batches_and_voices_take_all_documents(spark, tmp_path):
    docs = [(i, (None, "en", "de", "fr")[i % 4], i) for i in range(999, 0, -3)]
    labels = [(i, (None, 0, 1)[i % 5 % 3]) for i in range(3, 600, 3)]
    spark.createDataFrame(docs, "doc_id long, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    found = plans.QUERIES["batch_positions"](spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {(d, k // 40 + 1, k % 40 + 1) for k, d in enumerate(sorted(i for i, *_ in docs))}
    voiced = {i for i, lang, _ in docs if lang} | {i for i, q in labels if q is not None}
    found = {r.bucket: r.n for r in plans.QUERIES["three_voices"](spark, str(tmp_path)).collect()}
    assert sum(found.values()) == len(voiced) and found.get("blind_only", 0) + found.get("blind_engine", 0) == len({i for i, q in labels if q is not None} - {i for i, lang, _ in docs if lang})
