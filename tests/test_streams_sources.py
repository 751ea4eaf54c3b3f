"""Streams and sources on small literal inputs."""

import json
import struct
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from vitrine import plans
from vitrine.operators import catalog as C
from vitrine.sources import catalog as S
from vitrine.sources.catalog import all_sources
from vitrine.streaming import playback as P
from vitrine.streaming.playback import affinity


def test_sources(spark):
    met = spark.createDataFrame([(json.dumps({"title": "T", "artistDisplayName": "A", "primaryImage": "//x/1.jpg"}),), (json.dumps({"title": "none"}),)], "payload string")
    got = all_sources({"met": met, "other": met}, ["met", "gone"]).collect()
    assert [(r.source_url, r.proposed_title, r.proposed_artist) for r in got] == [("https://x/1.jpg", "T", "A")]


def test_affinity_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 30, False), (2, "2024-01-01 00:00:00", 45, True), (3, "2024-01-01 00:00:00", 3600, False)]
    events = spark.createDataFrame(rows, "artwork_id long, ts string, display_time_sec int, skipped boolean").selectExpr("artwork_id", "cast(ts as timestamp) ts", "display_time_sec", "skipped")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = affinity(stream).writeStream.format("memory").queryName("affinity").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {r.artwork_id: round(r.affinity, 4) for r in spark.table("affinity").collect()} == {1: 1.05, 2: 0.9, 3: 5.0}


def test_museum_rules(spark):
    def rows(source, *payloads):
        given = spark.createDataFrame([(json.dumps(p),) for p in payloads], "payload string")
        return [(r.source_url, r.thumbnail_url, r.proposed_title, r.proposed_artist) for r in all_sources({source: given}).collect()]

    iiif = "https://i/x/full/max/0/d.jpg"
    small = iiif.replace("max", "400,")
    names = {"title": [{"@language": "nl", "@value": "N"}, {"@language": "en", "@value": "E"}]}
    assert rows("rijksmuseum", {"title": "T", "creator": names, "relation": ["u", {"@id": iiif}]}, {"title": "S", "creator": "C", "relation": {"@id": iiif}}, {"title": "none"}) == [(iiif, small, "T", "E"), (iiif, small, "S", "C")]
    media = [{"type": "3D", "content": "m"}, {"type": "Images", "content": "c", "thumbnail": "t"}]
    assert rows("smithsonian", {"title": "T", "content": {"descriptiveNonRepeating": {"online_media": {"media": media}}, "freetext": {"name": [{"content": "A"}]}}}) == [("c", "t", "T", "A")]
    assert rows("nasa", {"data": [{"title": "T"}], "links": [{"href": "a~thumb.jpg"}, {"href": "a~orig.jpg"}]}) == [("a~orig.jpg", "a~thumb.jpg", "T", "Unknown Artist")]
    good = {"title": "T", "url": "u", "thumburl": "v", "mime": "image/png", "width": 9000, "height": 10, "extmetadata": {"License": {"value": "CC0"}}}
    assert rows("wikimedia", good, good | {"mime": "image/svg+xml"}, good | {"width": 20}, good | {"extmetadata": {}}) == [("u", "v", "T", "Unknown Artist")]
    with pytest.raises(ValueError):
        rows("other", good)


def test_payloads_are_parsed_once(spark, capsys):
    """Each list of addresses stands once in a source's plan: neither a filter nor a second use parses it again."""
    given = spark.createDataFrame([("{}",)], "payload string")
    for source in ("rijksmuseum", "smithsonian", "loc"):
        S.normalised(given, source).explain(True)
        plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
        assert plan.count(S.FIELDS[source][2]) == 1, plan


def test_payloads_are_dealt_out(spark, tmp_path):
    """A file of one row group would be one task for each source."""
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    placed = plans.QUERIES["s13_s16_s19_payloads"](spark, str(tmp_path)).select("source_api", F.spark_partition_id().alias("p"))
    assert all(r.n > 1 for r in placed.groupBy("source_api").agg(F.countDistinct("p").alias("n")).collect())


def test_odd_linked_art(spark):
    """Texts that look like lists or nodes, and lists of other things."""
    iiif = "https://i/x/full/max/0/d.jpg"
    creators = ["[not a list", " [\"in a list\"]", [{"@id": "i"}], {"title": "plain"}, {"title": ["u", {"@language": "en", "@value": ""}], "@id": "j"}, 7, None, []]
    rows = [(k, json.dumps({"title": str(k), "creator": c, "relation": [1, None, "[", {"@id": iiif}]})) for k, c in enumerate(creators)]
    got = S.normalised(spark.createDataFrame(rows, "id int, payload string"), "rijksmuseum", keep=("id",)).orderBy("id").collect()
    assert [r.proposed_artist for r in got] == ["[not a list", "in a list", "i", "plain", "j", "7", "Unknown Artist", "[]"] and {r.source_url for r in got} == {iiif}


def streamed(spark, tmp_path, name, batches, form, mode):
    """What a form gives after each of a few batches, each a file."""
    folder = tmp_path / name
    for k, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = form(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def events(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts"))


def test_last_seen_and_relay(spark, tmp_path):
    day = "2024-01-01 00:0{}:00".format
    batches = [events(spark, [("a", day(1)), ("b", day(2))], "display_id string, ts string"), events(spark, [("a", day(5)), ("a", day(3))], "display_id string, ts string")]
    seen = {}
    for r in streamed(spark, tmp_path, "seen", batches, P.last_seen, "update"):
        seen[r.display_id] = max(seen.get(r.display_id, r.last_seen), r.last_seen)
    assert {k: v.minute for k, v in seen.items()} == {"a": 5, "b": 2}
    schema = "command_id long, target_display string, action string, ts string"
    commands = [events(spark, [(1, "a", "next", day(1)), (2, "gone", "next", day(1))], schema), events(spark, [(1, "a", "next", day(1)), (3, "a", "stop", day(2))], schema)]
    displays = spark.createDataFrame([("a",), ("a",), ("b",)], "display_id string")
    got = streamed(spark, tmp_path, "sent", commands, lambda c: P.relay(c, displays), "append")
    assert sorted((r.command_id, r.action) for r in got) == [(1, "next"), (3, "stop")]


def test_bags(spark, tmp_path):
    schema = "display_id string, playlist_id long, ts string"
    asked = [events(spark, [("a", 1, f"2024-01-01 00:00:{i:02}")], schema) for i in range(6)] + [events(spark, [("a", 2, "2024-01-01 01:00:00")], schema)]
    members = spark.createDataFrame([(1, 10, 1.0), (1, 11, 0.0), (1, 12, 5.0)], "playlist_id long, artwork_id long, weight double")
    got = [r.artwork_id for r in sorted(streamed(spark, tmp_path, "bag", asked, lambda r: P.bags(r, members), "append"), key=lambda r: r.ts)]
    assert sorted(got[:3]) == sorted(got[3:]) == [10, 11, 12]


def test_sessions(spark, tmp_path):
    times = [("u", f"2024-01-01 {h}:00") for h in ("00:00", "00:20", "02:00")] + [("u", "2024-01-02 00:00:00")]
    batches = [events(spark, [t], "user string, ts string") for t in times]
    got = streamed(spark, tmp_path, "visits", batches, lambda e: P.sessions(e, "user"), "append")
    assert sorted(r.n for r in got) == [1, 2]


def test_upserts(spark, tmp_path):
    path = str(tmp_path / "state")
    sink = P.upsert_into(path, ["k"], "t", every=3)
    want = {}
    for number in range(8):
        rows = [(k, number * 10 + k, f"v{number}") for k in range(number % 3, 6, 2)]
        want.update({k: v for k, _, v in rows})
        batch = spark.createDataFrame(rows, "k long, t long, v string")
        sink(batch, number)
        if number == 4:
            sink(batch, number)  # written again after a failure
        assert {r.k: r.v for r in P.upserted(spark, path, ["k"], "t").collect()} == want
    assert len(P._committed(spark, path)) <= 3
    with pytest.raises(ValueError):
        P.upsert_into(str(tmp_path / "lost"), ["k"], "t")(batch, 5)
    assert P.upserted(spark, str(tmp_path / "none"), ["k"], "t") is None


def test_files(spark, tmp_path):
    folder = tmp_path / "catalog"
    folder.mkdir()
    for name, collection in (("a.json", "a"), ("_hidden.json", "h"), ("index.json", "i")):
        (folder / name).write_text(json.dumps({"id": collection, "items": [{"title": "T"}, {"title": "U"}]}))
    got = S.collections(spark, str(folder))
    assert sorted((r.collection, r.item_index, r.title) for r in got.collect()) == [("a", 0, "T"), ("a", 1, "U")]
    S.write_collections(got, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert S.static_json(spark, str(folder), "index.json").first()["id"] == "i" and S.static_json(spark, str(folder), "no.json") is None
    (tmp_path / "x.csv").write_text("name,born\nA,1900\n")
    assert S.author_rows(spark, str(tmp_path / "x.csv")).first().asDict() == {"name": "A", "born": "1900"}
    tiff = b"II*\0" + struct.pack("<IHHHIIHHIII", 8, 2, 256, 4, 1, 700, 257, 3, 1, 500, 0)
    files = spark.createDataFrame([("a", tiff), ("b", b"nothing"), ("c", None)], "path string, content binary")
    assert {r.path: (r.width, r.height) for r in S.tiff_dimensions(files).collect()} == {"a": (700, 500), "b": (None, None), "c": (None, None)}
    C.publish(spark.createDataFrame([("a", 1, 5, "x"), ("a", 0, 6, "y")], "collection string, item_index int, bytes long, sha256 string"), ["a"], str(tmp_path / "pub"))
    row = spark.read.json(str(tmp_path / "pub/registry")).first()
    assert (row.item_count, row.bytes, row.core) == (2, 11, True) and spark.read.parquet(str(tmp_path / "pub/collections/collection=a")).count() == 2


def test_loc_and_guard(spark):
    tile = "https://tile.loc.gov/storage-services/service/x"
    rows = [{"title": "Poster", "contributor": ["ann lee"], "image_url": ["https://loc.gov/static/i.svg", f"{tile}_150px.jpg", f"{tile}r.jpg", f"{tile}v.jpg"]}, {"title": "Web guide", "image_url": [tile]}, {"title": "No file", "image_url": ["i.svg"]}, {"title": "One", "creator": "bo", "image_url": [tile]}]
    got = all_sources({"loc": spark.createDataFrame([(json.dumps(r),) for r in rows], "payload string")}).collect()
    assert [(r.source_url, r.thumbnail_url, r.proposed_artist) for r in got] == [(f"{tile}v.jpg", f"{tile}_150px.jpg", "Ann Lee"), (tile, tile, "Bo")]
    pairs = [("Claude Monet", "monet, claude"), ("L. C. Tiffany", "Claude Monet"), (None, "x"), ("Ann", None), ("Ann", "Unknown Artist"), ("Bo Li", "Li Bo"), ("Jan Steenn", "jan steen")]
    want = []
    for w, g in pairs:
        low = (g or "").lower()
        last = (w or "").lower().split()[-1] if w else ""
        want.append(not w or low in ("", "unknown", "unknown artist") or (len(last) > 2 and last in low) or SequenceMatcher(None, low, w).ratio() >= 0.6)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, w string, g string")
    assert [r.ok for r in df.select("i", C.artist_ok(F.col("w"), F.col("g")).alias("ok")).orderBy("i").collect()] == want


def test_packs(spark):
    index = spark.createDataFrame([(0, "a", False), (1, "b", True), (2, "c", True), (3, "lost", False)], "place int, id string, default boolean")
    manifests = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", None)], "id string, title string")
    none = spark.createDataFrame([], "key string, value string")
    subs, settings = C.install_packs(index, manifests, none, spark.createDataFrame([("pack:a",)], "url string"))
    assert sorted(r.id for r in subs.collect()) == ["b", "c"]
    assert {r.key: r.value for r in settings.collect()} == {"default_playlist": "c", "pack_seeded": "v2:2"}
    seeded = spark.createDataFrame([("pack_seeded", "v2:2")], "key string, value string")
    again = C.install_packs(index, manifests, seeded, spark.createDataFrame([("pack:a",)], "url string"))
    assert all(x.isEmpty() for x in again)
    no_subs = spark.createDataFrame([], "id string, url string, title string")
    assert C.stand_down(none, no_subs).first().satisfied is False and C.stand_down(seeded, no_subs).first().satisfied is True
    made, placed = C.add_collections(spark.createDataFrame([("N", 0, "u"), ("N", 1, "u"), ("N", 2, "v"), ("O", 0, "w")], "title string, item_index int, source_url string"), spark.createDataFrame([("O",)], "name string"), spark.createDataFrame([("O", "z", 4)], "name string, source_url string, display_order long"))
    assert [r.name for r in made.collect()] == ["N"] and sorted(map(tuple, placed.collect())) == [("N", "u", 0), ("N", "v", 1), ("O", "w", 5)]
    files = spark.createDataFrame([("/r/p/a.JPG",), ("/r/_Library/b.jpg",), ("/r/p/c.txt",)], "path string")
    lists, works, links = C.folder_sync(files, spark.createDataFrame([], "name string"), spark.createDataFrame([("a.JPG",)], "filename string"), spark.createDataFrame([], "playlist string, filename string"))
    assert [r.name for r in lists.collect()] == ["p"] and works.isEmpty() and [tuple(r) for r in links.collect()] == [("p", "a.JPG", 0)]
