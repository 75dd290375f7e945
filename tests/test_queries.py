"""Every query with an oracle, against DuckDB on the smallest tables; the others for a stable schema and rows."""

import math

import duckdb
import pytest

from tidegraph.plans import queries as engine

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_oracle(spark, duck, name):
    df = engine.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    result = duck.execute(engine.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert got == expected


@pytest.mark.parametrize("name", ["gr3_louvain", "gr9_sampled_subgraph", "as4_manifest", "ev5_bootstrap", "as1_feature_matrix"])
def test_rows(spark, name):
    assert engine.QUERIES[name](spark, FOLDER).count() > 0


@pytest.fixture(scope="module")
def worthless(duck, tmp_path_factory):
    """The events, and one of amount 0 by a node that has no other: its out-edges weigh 0 in all."""
    folder = tmp_path_factory.mktemp("worthless")
    one = "SELECT max(event_id) + 1, TIMESTAMP '2024-01-01 05:00:00', max(user_id) + 1, 'view', 0.0, '{\"k\": 5}' FROM events"
    duck.execute(f"COPY (SELECT * FROM events UNION ALL {one}) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["gr1_pagerank_k20", "gr1_pagerank_converged", "win4_pagerank_pct", "gr11_pagerank_and_degree", "gr2_backend_agreement", "as1_matrix_fixed", "as1_feature_matrix"])
def test_a_node_that_pays_nothing(spark, worthless, name):
    df = engine.QUERIES[name](spark, worthless)
    numbers = [c for c, kind in df.dtypes if kind in ("float", "double")]
    assert not [r for r in df.select(*numbers).collect() if any(v is not None and not math.isfinite(v) for v in r)]
    if name == "gr2_backend_agreement":
        assert df.where("max_difference <> 0 OR rank_correlation <> 1 OR hub_place <> 1").isEmpty()


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["tx_id", "day_idx", "src_out_degree", "src_in_degree", "dst_out_degree", "dst_in_degree"]
    assert df.count() == 344
    assert set(entry.oracle_sql()) <= set(entry.queries())
