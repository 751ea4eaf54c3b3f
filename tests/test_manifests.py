"""Manifest faults against a plain walk over the document, on documents broken in random places."""

import copy
import json
import random
import re

from pyspark.sql import functions as F

from vitrine.operators.manifests import manifest_faults

WHOLE = {
    "manifest_version": 2, "id": "m", "title": "M", "cover_image": "c.jpg", "publisher": {"id": "p", "name": "P"}, "default_license": "PD", "future": {"x": [1]},
    "items": [
        {"id": "a", "title": "A", "tags": ["x"], "access": "free", "image": {"full_url": "u", "width": 10, "height": 20, "focal_point": [0.5, 0.5], "aspect_crops": {"16:9": [0, 0, 1, 1], "9:16": [0.1, 0, 0.9, 1]}, "license": "CC0"}},
        {"id": "b", "title": "B", "access": "entitlement:shop:1", "image": {"local_file": "b.jpg", "license": "CC-BY 4.0", "attribution": "me"},
         "interpretation": {"author": "Ann", "license": "CC-BY", "attribution": "Ann", "sections": [{"body": "b"}, {"body": "c"}], "points_of_interest": [{"bbox": [0, 0, 1, 1], "commentary": "c"}], "audio": [{"url": "u", "license": "CC0"}]}},
    ],
}
ODD = [None, "", "  ", " ", "text", "cc-by-sa", 0, 2, 2.0, 1.5, -1, True, False, [], {}, [0.5, 0.5], [0, 0, 1, 1], [0, 0, 1, "x"], [True, 0.1], [{}], ["a"], {"body": "x"}, {"16:9": [0, 1]}, "entitlement:Shop:", "entitlement:Shop:9", 10**25]


def full(v):
    return isinstance(v, str) and v.strip() != ""


def unit(v, n):
    return isinstance(v, list) and len(v) == n and all(isinstance(x, (int, float)) and 0 <= x <= 1 for x in v)


def expected(doc):
    """The rules one by one, as sentences about the document."""
    if not isinstance(doc, dict):
        return ["manifest must be a JSON object"]
    out = []
    say = lambda wrong, text: out.append(text) if wrong else None
    filled = " is required (non-empty string)"

    def licence(o, path, by_default=False):
        lic = o.get("license")
        if lic is None:
            say(not by_default, f"{path}.license is required (no manifest default_license set)")
        elif not full(lic):
            say(True, f"{path}.license must be a non-empty string")
        else:
            say(lic.strip().lower().startswith("cc-by") and not full(o.get("attribution")), f"{path}.attribution is required when license is '{lic}'")

    def listed(o, name, path, check):
        v = o.get(name)
        if isinstance(v, list):
            for n, x in enumerate(v):
                check(x, f"{path}.{name}[{n}]")
        else:
            say(v is not None, f"{path}.{name} must be an array")

    def as_object(check):
        return lambda v, path: check(v, path) if isinstance(v, dict) else say(True, f"{path} must be an object")

    @as_object
    def image(v, path):
        say(not full(v.get("full_url")) and not full(v.get("local_file")), f"{path}: one of full_url or local_file is required (non-empty string)")
        for side in ("width", "height"):
            say(side in v and not isinstance(v[side], int), f"{path}.{side} must be an integer")
        say(v.get("focal_point") is not None and not unit(v["focal_point"], 2), f"{path}.focal_point must be [x, y] with each value a number in 0..1")
        crops = v.get("aspect_crops")
        say(crops is not None and not isinstance(crops, dict), f"{path}.aspect_crops must be an object")
        for name, box in crops.items() if isinstance(crops, dict) else ():
            say(not unit(box, 4), f"{path}.aspect_crops['{name}'] must be [x0,y0,x1,y1] with each value a number in 0..1")
        licence(v, path, full(doc.get("default_license")))

    @as_object
    def point(v, path):
        say(not full(v.get("commentary")), f"{path}.commentary{filled}")
        say(not unit(v.get("bbox"), 4), f"{path}.bbox must be [x, y, w, h] with each value a number in 0..1")

    @as_object
    def track(v, path):
        say(not full(v.get("url")), f"{path}.url{filled}")
        licence(v, path)

    @as_object
    def interpretation(v, path):
        say(not full(v.get("author")), f"{path}.author is required (interpretation is separately authored)")
        licence(v, path)
        listed(v, "sections", path, lambda s, p: say(not (isinstance(s, dict) and full(s.get("body"))), f"{p} must be an object with a non-empty 'body'"))
        listed(v, "points_of_interest", path, point)
        listed(v, "audio", path, track)

    @as_object
    def item(v, path):
        for name in ("id", "title"):
            say(not full(v.get(name)), f"{path}.{name}{filled}")
        say("tags" in v and not (isinstance(v["tags"], list) and all(isinstance(x, str) for x in v["tags"])), f"{path}.tags must be an array of strings")
        say("access" in v and not (isinstance(v["access"], str) and re.match(r"(free|entitlement:[a-z0-9_-]+:.+)$", v["access"], re.I)), f"{path}.access must be 'free' or 'entitlement:<provider>:<id>'")
        image(v["image"], f"{path}.image") if "image" in v else say(True, f"{path}.image is required")
        if "interpretation" in v:
            interpretation(v["interpretation"], f"{path}.interpretation")

    say(doc.get("manifest_version") != 2, f"manifest_version must be 2 (got {doc.get('manifest_version')!r})")
    for name in ("id", "title"):
        say(not full(doc.get(name)), name + filled)
    say("cover_image" in doc and not full(doc["cover_image"]), "cover_image must be a non-empty string (URL) when present")
    if "publisher" in doc:
        as_object(lambda v, path: [say(not full(v.get(k)), f"publisher.{k}{filled}") for k in ("id", "name")])(doc["publisher"], "publisher")
    items = doc.get("items")
    say(not isinstance(items, list), "items is required (array)")
    for n, v in enumerate(items if isinstance(items, list) else ()):
        item(v, f"items[{n}]")
    return out


def places(v, path=()):
    yield path
    for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
        yield from places(x, (*path, k))


def broken(rng):
    doc = copy.deepcopy(WHOLE)
    for _ in range(rng.randint(1, 3)):
        *way, last = rng.choice([p for p in places(doc) if p])
        at = doc
        for k in way:
            at = at[k]
        if rng.random() < 0.4:
            del at[last]
        else:
            at[last] = copy.deepcopy(rng.choice(ODD))
    return doc


def test_every_rule_and_its_path(spark):
    rng = random.Random(4)
    docs = [WHOLE, *(broken(rng) for _ in range(1500)), *ODD, {"items": [1, None, {}, WHOLE["items"][1]]}]
    # versions that JSON and Python print apart
    docs = [d for d in docs if not (isinstance(d, dict) and isinstance(d.get("manifest_version"), (float, list, dict)) and d["manifest_version"] != 2 or isinstance(d, dict) and d.get("manifest_version") == "\xa0")]
    texts = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(-1, None), (-2, ""), (-3, "{"), (-4, '{"id":"a","id":"b"}')]
    got = {r.i: r.f for r in spark.createDataFrame(texts, "i int, j string").repartition(8).select("i", manifest_faults(F.col("j")).alias("f")).collect()}
    for i, d in enumerate(docs):
        assert got[i] == expected(d), d
    assert got[0] == [] and all(got[-k] == ["manifest must be a JSON object"] for k in (1, 2, 3, 4))
    assert len({t for d in docs for f in expected(d) for t in [re.sub(r"\d+|got .*|'.*?'", "", f)]}) > 35
