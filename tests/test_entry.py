"""The entry file without its optional part, and checkpoint folders of clusters."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from tillroll import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["tillroll.llm", "corpus_pipeline", "public_tokenizers", "tokenizers", "zstandard"])
def test_retail_queries_stand_alone(missing):
    """Whatever the text operators cannot import, the other queries are there."""
    code = ("import sys; sys.modules[%r] = None; import __spark_entry__ as e; from tillroll.plans.catalog import all_queries; "
            "assert set(all_queries()) <= set(e.queries()); assert len(e.oracle_sql()) > 90; print(len(e.queries()) - len(all_queries()))") % missing
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-500:]
    if missing != "tokenizers":  # that one is needed in tasks only
        assert done.stdout.split()[-1] == "0"


def fake(master, folder=None, conf=None):
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: folder, setCheckpointDir=lambda p: None)
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: conf or d))


def test_clusters_name_their_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            session.ensure_checkpoint_dir(fake(master))
        assert session.ensure_checkpoint_dir(fake(master, conf="hdfs://shared")) == "hdfs://shared"
        assert session.ensure_checkpoint_dir(fake(master, folder="hdfs://own")) == "hdfs://own"
    for master in ("local", "local[*]", "local[8]"):
        assert os.path.isdir(session.ensure_checkpoint_dir(fake(master)))
