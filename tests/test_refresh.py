"""Archives taken up by what has changed in them, against a rebuild from the last one."""

import json
import zipfile

import pytest
from test_matchdocs import document
from test_store import rows_of

from crease.plans import layout, refresh, upkeep
from crease.sources import matchdocs


def pack(path, documents, extra=()):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, d in documents.items():
            z.writestr(f"{name}.json", json.dumps(d))
        for name, text in extra:
            z.writestr(name, text)


def variant(revision, season, runs):
    d = document(revision)
    d["info"]["season"] = season
    d["innings"][0]["overs"][0]["deliveries"][0]["runs"] = {"batter": runs, "extras": 0, "total": runs}
    return d


def test_refresh_by_change(spark, tmp_path, monkeypatch):
    store, archive = str(tmp_path / "store"), tmp_path / "all.zip"
    run = lambda etag, **k: refresh.refresh(spark, store, str(archive), "all", etag, complete=True, **k)
    first = {"m1": variant(1, "2020", 50), "m2": variant(1, "2020", 4), "m3": variant(2, "2021", 6), "m4": variant(1, "2021", 120)}
    pack(archive, first, [("bad.json", "{"), ("readme.json", "{}")])
    done = run("e1")
    assert (done["taken"], done["rejected"], done["deleted"]) == (4, 1, 0)
    assert run("e1") == {"action": "not-modified", "taken": 0, "rejected": 0, "deleted": 0}
    gold = upkeep.store(spark, store)
    assert gold.snapshot() == 1

    second = {"m1": variant(2, "2022", 3), "m2": variant(1, "2020", 99), "m3": variant(2, "2021", 6), "m5": variant(1, "2020", 30)}
    pack(archive, second)
    with monkeypatch.context() as m:  # breaks off before anything is seen
        m.setattr("crease.plans.store.Change.publish", lambda self: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            run("e2")
    assert gold.snapshot() == 1 and refresh.feed_marks(gold).first().etag == "e1"
    done = run("e2")
    assert (done["taken"], done["rejected"], done["deleted"]) == (2, 0, 1)  # m1 is revised, m5 new, m4 gone; m2 has no new revision
    assert {(r.match_id, r.revision) for r in refresh.known_matches(gold).collect()} == {("m1", 2), ("m2", 1), ("m3", 2), ("m5", 1)}

    now = tmp_path / "now.zip"
    pack(now, second | {"m2": first["m2"]})
    docs, _ = matchdocs.split_valid(matchdocs.read_archives(spark, str(now)))
    silver = {"deliveries": matchdocs.deliveries(docs), "matches": matchdocs.matches(docs)}
    players = spark.createDataFrame([], "player_id string, name string, external_id string")
    views, rebuilt = upkeep.gold_views(gold, players), layout.gold_tables(silver | {"players": players})
    for name, view in views.items():
        assert rows_of(view) == rows_of(rebuilt[name].select(*view.columns)), name
    done = run("e2", force=True)
    assert done["taken"] == 4 and gold.read("matches").count() == 4
