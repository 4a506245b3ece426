from types import SimpleNamespace

import pytest

from syllabica.session import shared_dir


def fake(master, configured=""):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: configured or default),
        sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"),
    )


def test_shared_folder_comes_from_the_session():
    assert shared_dir(fake("spark://host", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(fake("local[2]")) == shared_dir(fake("local[2]"))
    with pytest.raises(ValueError):
        shared_dir(fake("spark://host"))
