import hashlib
import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from provlens.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session("tests", "local[4]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    return session


def canon(value):
    """Canonical JSON written independently of the package."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + canon(value[k]) for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canon, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def chain(archive, n, start=0, prev="0" * 64):
    """Honest audit entries for one archive."""
    out = []
    for i in range(start, start + n):
        entry = {"seq": i, "prev_hash": prev, "timestamp": f"2026-01-01T00:00:{i % 60:02d}Z", "actor": "a\"b",
                 "action": "ingest_evidence", "target": f"prov:evidence/sha256:{sha(str(i))}",
                 "parameters": {"size_bytes": str(i), "é": "ü\n"}, "result": "success", "schema_version": "0.1.0"}
        prev = sha(canon(entry))
        out.append({"archive_id": archive, "pos": i, **entry, "entry_hash": prev})
    return out
