import os

import duckdb
import pytest

from folialis.llm import queries
from folialis.sources.tables import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "p1_found": ["paper_id_a", "paper_id_b"], "p3_found": ["paper_id", "field_name"], "p4_found": ["paper_id", "kind", "ref_id"], "p5_found": ["group_id", "doi_from", "venue_from"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = sorted(map(tuple, df.collect()), key=str)
    assert rows and (name == "p6_ids" or len(set(map(str, rows))) == len(rows))
    if name in queries.SQL:
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        r = c.execute(queries.SQL[name])
        names = [x[0] for x in r.description]
        assert rows == sorted((tuple(dict(zip(names, x, strict=True))[k] for k in df.columns) for x in r.fetchall()), key=str)
