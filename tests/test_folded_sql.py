"""Queries over folded texts next to their SQL, on a sharp s written large and small."""

import duckdb
import pytest
from oracle import compare

from cueweave.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["phrase_match", "translate"])
def test_sharp_s_is_folded_on_both_sides(spark, folder, name):
    texts = ["SS der", "ß der", "ss der ß der", "ẞ der", "s der"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "Iß der"), (2, "ß der"), (3, "ss")], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    assert compare(spark, con, folder, QUERIES[name], ORACLES[name]) is None
