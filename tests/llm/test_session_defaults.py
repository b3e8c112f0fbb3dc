"""Operators cut lineage in a session that names no shared folder."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from test_plain_session import run  # noqa: E402


def test_embedding_dedup(tmp_path):
    run("from veloquent.llm.queries import op7_embed_dedup\nassert op7_embed_dedup(spark, '/root/testdata/sf0.001').count() == 500", tmp_path)
