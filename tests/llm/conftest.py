import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Columns that clash with names the operators use inside.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, g bigint, fp bigint, base string, term string, score string, shard string, h string, th string, l int"


@pytest.fixture
def documents(spark):
    def make(rows):
        """rows: texts, or (doc_id, text)."""
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", "s", len(t or ""), 7, 7, 7, "b", "t", "s", "x", "h", "t", 1) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make
