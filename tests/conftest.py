import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from folialis.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("4", 4, "3g", **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


PAPERS = (
    "id long, title string, authors string, year int, venue string, doi string, keywords string, link string, summary string, notes string, category_id long, read boolean, status string, starred boolean, "
    "pdf_path string, pdf_size long, fulltext string, created_at timestamp_ntz, updated_at timestamp_ntz, notes_updated_at timestamp_ntz, deleted_at timestamp_ntz"
)


@pytest.fixture(scope="session")
def make_papers(spark):
    """Papers from dictionaries; what is left out is '', 0, false or null."""
    from datetime import datetime

    kinds = dict(x.strip().split(" ") for x in PAPERS.split(","))
    blank = {"string": "", "int": 0, "boolean": False, "timestamp_ntz": None, "long": None}

    def make(*rows):
        filled = []
        for i, r in enumerate(rows, 1):
            x = {k: blank[t] for k, t in kinds.items()} | {"id": i, "status": "unread", "pdf_size": 0, "created_at": datetime(2024, 1, 1, 0, i // 60, i % 60), "updated_at": datetime(2024, 1, 1, 0, i // 60, i % 60)} | r
            filled.append(tuple(x[k] for k in kinds))
        return spark.createDataFrame(filled, PAPERS)

    return make
