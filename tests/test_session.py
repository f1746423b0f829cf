import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from presswork import session as S


def test_a_cluster_must_name_its_shared_folder():
    def of(master, named=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named), sparkContext=SimpleNamespace(master=master))

    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            S.shared_dir(of(master))
        assert S.shared_dir(of(master, "file:///shared/")) == "file:///shared"
    for master in ("local", "local[4]"):
        assert S.shared_dir(of(master)).startswith("file://")


def test_forget_deletes_a_cut_table(spark):
    t = S.cut(spark.range(5), "five")
    path = t._presswork_path.removeprefix("file://").removeprefix("file:")
    assert t.count() == 5 and os.path.isdir(path)
    S.forget(t)
    assert not os.path.exists(path)
    S.forget(None)


def test_what_is_left_goes_with_the_application(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {os.getcwd()!r})
from presswork.session import build_session, cut
s = build_session("x", "1", **{{"spark__checkpoint__dir": "file://{tmp_path}"}})
cut(s.range(3)).count()
import os
assert any(f.endswith(".parquet") for _, _, fs in os.walk({str(tmp_path)!r}) for f in fs)
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, capture_output=True)
    assert not [f for _, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".parquet")]
