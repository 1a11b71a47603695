import pytest

from skeinrank.sources.manifest import Conflict, Folder, Manifest


def test_versions_and_conflicts(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "store"))
    one, two = Manifest(folder), Manifest(Folder(spark, str(tmp_path / "store")))
    assert one.read() is None
    first = one.commit({"live": []})
    assert first["version"] == 1 and two.read() == first
    second = one.commit(first | {"live": ["a"]})
    with pytest.raises(Conflict):
        two.commit(first | {"live": ["b"]})
    assert two.read() == second and folder.names("manifests") == ["000000000001.json", "000000000002.json"]
    for _ in range(5):
        second = one.commit(second)
    one.prune(3)
    assert one.read() == second and len(folder.names("manifests")) == 3
    assert folder.size("manifests") > 0 and folder.size("absent") == 0 and folder.names("absent") == []
