"""Only changed files are opened."""

import json
import os

from vitrine.sources.cached import CachedJson
from vitrine.sources.versions import Versions


def test_only_changed_files_are_read(spark, tmp_path):
    folder = tmp_path / "catalog"
    (folder / "sub").mkdir(parents=True)

    def put(name, title, at):
        (folder / name).write_text(json.dumps({"id": name, "title": title}, indent=1))
        os.utime(folder / name, (at, at))

    def titles():
        return sorted((r.id, r.title) for r in cache.read().collect())

    for i in range(4):
        put(f"c{i}.json", f"T{i}", 1_700_000_000 + i)
    put("sub/d.json", "D", 1_700_000_000)
    (folder / "notes.txt").write_text("no document")
    cache = CachedJson(Versions(spark, str(tmp_path / "cache")), "catalog", str(folder), "id string, title string")
    assert cache.refresh() == 5 and [t for _, t in titles()] == ["T0", "T1", "T2", "T3", "D"]
    assert cache.refresh() == 0 and cache.store.version() == 1  # nothing is committed when nothing changed
    put("c1.json", "new", 1_700_000_100)
    put("e.json", "E", 1_700_000_100)
    (folder / "c3.json").unlink()
    assert cache.refresh() == 2 and [t for _, t in titles()] == ["T0", "new", "T2", "E", "D"]
    put("c1.json", "NEW", 1_700_000_200)  # same size, another time
    assert cache.refresh() == 1 and ("c1.json", "NEW") in titles()
    for name in ("c0.json", "c2.json", "e.json"):
        (folder / name).unlink()
    assert cache.refresh() == 0 and titles() == [("c1.json", "NEW"), ("sub/d.json", "D")]
    again = CachedJson(Versions(spark, str(tmp_path / "cache")), "catalog", str(folder), "id string, title string")
    assert again.refresh() == 0 and again.store.read("catalog_rows").count() <= 4  # stale rows were written off
