"""The driver's contract, and the catalogue against SQL at the smallest size."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__  # noqa: E402
from corpusloom import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = ["bm25_search", "tf_log_ratio_dfs", "select_terms_missing", "token_counts", "lsh_unique", "conll_to_list", "knn", "emscan_first_loop", "centroid_stats", "set_bitmask", "definition_similarity", "filter_dict_field_set"]


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        made.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return made


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_catalogue(spark, duck, name):
    made = catalog.QUERIES[name](spark, SF)
    columns = sorted(made.columns)
    result = duck.execute(catalog.SQL[name])
    names = [c[0] for c in result.description]
    key = lambda row: tuple(str(round(x, 5) + 0.0 if isinstance(x, float) else x) for x in row)
    want = sorted(key([r[names.index(c)] for c in columns]) for r in result.fetchall())
    assert sorted(key([r[c] for c in columns]) for r in made.collect()) == want
